import numpy as np
import pyarrow as pa
import pytest

from hazardspark.llm import negatives
from tests.llm.helpers import DATA

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, n=5):
    """Hard negatives by their definition. Rows: (id, label, vector)."""
    kept = []
    for i, label, vector in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    out = []
    by = lambda p: (-p[0], p[1] is None, p[1])
    for a, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, l) for b, (i, l, v) in enumerate(kept) if b != a]
        for p, pid, _ in sorted([s for s in scored if s[2] == label], key=by)[:positives]:
            near = sorted([s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p], key=by)[:n]
            out += [(anchor, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(near)]
    return sorted(out, key=repr)


def mined(df, **options):
    return sorted((tuple(r) for r in negatives.mine(df, **options).collect()), key=repr)


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(negatives, "_LEAST", 40)


def test_whole_table_against_brute_force(spark, small_buckets):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    assert want and mined(df) == want


def test_lengths_clusters_ties_and_repeats(spark, small_buckets):
    """Lengths over several magnitudes, tight clusters (where the lists prune) and equal vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rng.normal(size=12) * (0.001 if i % 3 else 0.4)
        rows.append((i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v * 10 ** rng.uniform(-2, 2)]))
    rows += [(1000 + i, i % 3, [1.0] * 12) for i in range(300)]  # equal vectors, a third of all rows
    rows += [rows[0], rows[0], (100, 2, rows[5][2]), (None, 1, rows[0][2]), (None, 2, rows[0][2])]
    want = brute(rows)
    assert want and mined(spark.createDataFrame(rows, SCHEMA)) == want


def test_lists_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    centres *= 4000 / np.sqrt((centres**2).sum(axis=1))[:, None]
    vectors = np.rint(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 16)) * 20)
    table = pa.table({
        "bucket": [0] * 1000, "no": range(1000), "vec_id": range(1000), "label": [0] * 1000,
        "vector": vectors.astype(int).tolist(), "norm": np.sqrt((vectors**2).sum(axis=1)),
    })
    bucket = negatives.Bucket(negatives._index(table).to_pylist()[0], 1000)
    anchors = vectors[::100].astype(np.int64)
    norms = np.sqrt((anchors**2).sum(axis=1))
    least = norms**2 * 0.95
    scores = anchors @ vectors.T.astype(np.int64)
    for i, rows in enumerate(bucket.feasible(anchors, norms, least)):
        assert rows is not None and len(rows) < 500
        assert set(np.flatnonzero(scores[i] >= least[i])) <= set(rows.tolist())


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 1.0]), (3, None, [1.0, 1.0]), (4, 2, None),
        (5, 2, [1.0, None]), (6, 2, [1.0, float("nan")]), (8, 2, [float("inf"), 1.0]), (9, 2, []), (10, 2, [1.0]),
        (11, 2, [1.0, 1.0, 7.0]), (100, 1, [0.0, 0.0]), (200, 3, [-1.0, -1.0]), (201, 3, [1.0, 1.0]),
        (300, 9, []), (-100, 1, [2.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as no", "'x' as bucket", "0.5 as norm")
    want = brute(rows)
    assert want and mined(df) == want


def test_empty_and_too_long(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0])], SCHEMA)) == []
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, 1, [1e30])], SCHEMA))
