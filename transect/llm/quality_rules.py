"""Quality by a sparse rule ensemble (RuleFit, Friedman and Popescu, 2008), compiled into Spark expressions.

Statistics of whole texts are column expressions. On a bounded sample of labelled rows (``MAX_ROWS``, chosen by a hash of
doc_id) small boosted trees are grown; each path from a root is a rule, a conjunction of comparisons; a logistic
regression with an L1 penalty gives most rules weight zero. What is left compiles into one column expression, so scoring
is a projection over the documents.

Of labels that contradict each other for one doc_id, the mean counts, 0.5 or more as good; rows of one doc_id are samples of
their own; null texts are empty, and score by their statistics like any other; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_few

MAX_ROWS = 12_000
THRESHOLD = 0.5
_TREES, _DEPTH, _BINS, _SHRINK, _LEAST = 24, 3, 32, 0.3, 10
_PENALTY, _STEPS = 2e-3, 400


def statistics(text: Column) -> dict[str, Column]:
    """Of a whole text; null counts as empty. Words are runs outside 0x20 and 0x09-0x0D."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    size = F.greatest(chars, F.lit(1))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / size

    def single(character: str) -> Column:
        return (chars - F.length(F.replace(text, F.lit(character), F.lit("")))) / size

    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_chars": chars / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_chars": chars / F.size(lines),
        "symbols": share("[^\\p{L}\\p{N}\\s]"),
        "upper": share("\\p{Lu}"),
        "digits": share("\\p{N}"),
        "bars": single("|"),
        "exclamations": single("!"),
        "stops": single("."),
        "commas": single(","),
    }


NAMES = ("log_chars", "word_chars", "distinct_words", "distinct_lines", "line_chars", "symbols", "upper", "digits", "bars", "exclamations", "stops", "commas")

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold): value > threshold, or not


def _grow(x: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, rules: list[Rule], fitted: np.ndarray) -> None:
    """A regression tree on Newton steps; every node below the root is a rule."""
    g, h = residual[rows].sum(), weight[rows].sum()
    best = (1e-6, -1, 0)
    if len(path) < _DEPTH and len(rows) >= 2 * _LEAST:
        for j, cuts in enumerate(edges):
            if not len(cuts):
                continue
            gs = np.cumsum(np.bincount(codes[rows, j], residual[rows], len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(codes[rows, j], weight[rows], len(cuts) + 1))[:-1]
            ns = np.cumsum(np.bincount(codes[rows, j], minlength=len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < _LEAST) | (len(rows) - ns < _LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] < 0:
        fitted[rows] = g / (h + 1)
        return
    _, j, k = best
    above = codes[rows, j] > k
    for side, part in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (j, side, float(edges[j][k])))
        rules.append(longer)
        _grow(x, edges, codes, residual, weight, part, longer, rules, fitted)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """The distinct rules of boosted trees, in the order in which they were found."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _BINS + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: list[Rule] = []
    for _ in range(_TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(2 * _LEAST, len(y) // 2), replace=False)) if len(y) > 4 * _LEAST else np.arange(len(y))
        fitted = np.zeros(len(y))
        before = len(rules)
        _grow(x, edges, codes, y - p, p * (1 - p), rows, (), rules, fitted)
        if len(rules) == before:
            break
        score[rows] += _SHRINK * fitted[rows]
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, threshold in rule:
        out &= (x[:, j] > threshold) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = _PENALTY, steps: int = _STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; columns of z are 0/1."""
    mean, scale = z.mean(0), np.maximum(z.std(0), 0.02)
    s = (z - mean) / scale
    rate = 4 * len(y) / (np.linalg.norm(s, 2) ** 2 + len(y))
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(s @ v + c))) - y
        new = v - rate * (s.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * g.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    w = w / scale
    return w, float(b - mean @ w)


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score_column(self, stats: dict[str, Column]) -> Column:
        """Chance of good quality from columns of the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, above, threshold in rule:
                value = stats[NAMES[j]]
                holds = holds & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(holds, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * applies(rule, x)
        return 1 / (1 + np.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{NAMES[j]} {'>' if a else '<='} {t:.5g}" for j, a, t in r) for r, w in sorted(zip(self.rules, self.weights, strict=True), key=lambda x: -abs(x[1]))]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """With one class alone, or no row, there are no rules, and the score is the share of that class (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    weights, intercept = lasso_logistic(np.stack([applies(r, x) for r in rules], axis=1).astype(float), y)
    kept = np.flatnonzero(np.abs(weights) > 1e-9)
    return Ensemble([rules[k] for k in kept], [float(weights[k]) for k in kept], intercept)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", usable: Column | None = None, max_rows: int = MAX_ROWS) -> Ensemble:
    """Learns from at most max_rows (give or take chance) labelled rows; ``usable`` says of a doc_id whether it may be learnt from."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(usable if usable is not None else F.lit(True))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    total = known.count()
    spot = F.xxhash64(F.col("doc_id"), F.lit("sample")) / F.lit(2.0**64) + 0.5
    chosen = known.filter(spot < F.lit(max_rows / max(total, 1)))
    rows = with_few(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), chosen, "doc_id", 2 * max_rows)
    stats = statistics(F.col("text"))
    found = np.array(sorted(tuple(r) for r in rows.select(F.col("doc_id").cast("double"), "y", *[stats[n].cast("double").alias(n) for n in NAMES]).orderBy(F.xxhash64("doc_id"), *NAMES).limit(2 * max_rows).collect()), float).reshape(-1, len(NAMES) + 2)
    return fit(found[:, 2:], found[:, 1])


def score(docs: DataFrame, ensemble: Ensemble, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row for each row of docs."""
    stats = statistics(F.col("text"))
    measured = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", *[stats[n].cast("double").alias(n) for n in NAMES])
    return measured.select("doc_id", ensemble.score_column({n: F.col(n) for n in NAMES}).alias("score"))
