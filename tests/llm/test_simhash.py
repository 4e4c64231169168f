import numpy as np
import xxhash

from tests.llm.helpers import awkward, awkward_rows, empty
from transect.llm import simhash
from transect.llm.graph import components


def brute_fingerprint(text, shingle=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Of all pairs within 3 bits: the number of each row's component."""
    fps = np.array(fps, np.uint64)
    of = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    changed = True
    while changed:
        changed = False
        for k, others in enumerate(near):
            least = of[others].min()
            if (of[others] != least).any() or of[k] != least:
                of[others] = least
                of[k] = least
                changed = True
    return of


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    of = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, of, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((str(d), f, str(least.get(c))) for (d, _), f, c in zip(rows, fps, of, strict=True))


def found(df):
    return sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in df.collect())


def test_awkward_rows(spark):
    assert found(simhash.near_duplicates(awkward(spark))) == expected([r[:2] for r in awkward_rows()])


def test_driver_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert found(simhash.near_duplicates(docs)) == expected([tuple(r) for r in docs.collect()])


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 60, np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(30):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                s ^= 1 << bit
            fps.add(s)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(simhash.links(table)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(fps, brute_components(fps), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    verdict = simhash.near_duplicates(docs).collect()
    want = sorted(str(r.doc_id) for r in verdict if r.doc_id == r.component_id)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in components(path).collect()}
    assert roots == {k: 0 for k in range(1, 201)} | {501: 500}


def test_every_variant_reaches_its_bucket():
    """Against all variants listed one by one, from few buckets to many more than fingerprints."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near, pairs = simhash._masks()
    for log_buckets in (6, 10, 17, 20):
        ball = simhash._Ball(log_buckets)
        want = {(int(b), int(f)) for f in fps for b in ball.bucket(f ^ (near if int(f).bit_count() % 2 else np.r_[near, pairs]))}
        found = [(int(b), int(f)) for buckets, cuts, own in simhash.scattered(fps, ball, log_buckets) for k, b in enumerate(buckets) for f in own[cuts[k] : cuts[k + 1]]]
        assert len(found) == len(set(found)) and set(found) == want


def test_links_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BUCKET_VARIANTS", 16)
    monkeypatch.setattr(simhash, "_PAIRS", 4096)
    rng = np.random.default_rng(4)
    fps = list(rng.integers(0, 2**64, 60, dtype=np.uint64))
    for _ in range(150):  # chains of up to three flipped bits
        fps.append(fps[rng.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4), dtype=np.uint64)))
    fps = np.unique(np.array(fps, np.uint64))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    own = fps.view(np.int64).tolist()
    groups = {}
    for f, c in zip(own, brute_components(fps), strict=True):
        groups.setdefault(c, set()).add(f)
    found = {}
    for f in own:
        found.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
