"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h long, copies int"


def awkward_rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "Delta", "été", "straße", "ниже", "日本", "x", "don't", "a.b,c", "10", "THE"]
    passage = " ".join(rng.choice(words) + str(k) for k in range(40))
    texts = [
        None, "", " ", "\n", "one", "one", "two words", "Two Words", "two  words", "two\nwords", " two words ",
        passage, passage + " tail end", "head start " + passage, "mid " + passage.replace(" ", "\n", 5) + " x",
        " ".join(rng.choice(words) for _ in range(30_000)), "a" * 70_000, "é" * 5_000, "tab\tseparated\x0bwords\x0c\r\nend",
        "no break space", "text <|endoftext|> and <|startoftext|>x", "trailing space ", "   many   spaces   ", "Σίσυφος ΣΑΣ",
        "para one.\npara two.\n\nsection two, clause; more", "para one.\npara 2.\n\nsection two, clause; more",
    ]
    for _ in range(60):
        texts.append(" ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(1, 120))))
    texts += texts[30:40]
    texts += [t + " extra" for t in texts[40:46]]
    rows = [(k, t, "en", f"src{k % 3}" if k % 7 else None, len(t or ""), False, k, 5) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows.append((None, passage, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    rows.append(rows[0])
    rows.append((3, "another text under a used id", "en", "src1", 1, None, None, None))
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)
