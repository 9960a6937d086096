import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import mixing as m
from tests.llm.helpers import ODD_TEXTS, documents, table


def test_targets_reshare_the_excess():
    got = m.targets([100, 1000, 1000, 10])
    assert sum(got) == pytest.approx(1.5 * 2110)
    assert got[0] == 200 and got[3] == 20 and all(t <= 2 * s for t, s in zip(got, [100, 1000, 1000, 10]))
    assert got[1] == pytest.approx(2 * got[2]) or got[1] == 2000
    assert m.targets([]) == [] and m.targets([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    index, sizes = np.arange(size), np.full(size, size)
    one = m.permuted(index, sizes, np.full(size, 11, np.uint64))
    two = m.permuted(index, sizes, np.full(size, 12, np.uint64))
    assert sorted(one) == list(range(size)) == sorted(two)
    assert size < 64 or (one != two).any()


def test_mix_of_the_test_data(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    plan = m.MixPlan(docs)
    rows = plan.taken()
    first = sorted(map(tuple, rows.collect()), key=str)
    assert first == sorted(map(tuple, m.MixPlan(docs).taken().collect()), key=str)
    assert rows.where(F.col("taken") > 2 * F.col("size")).count() == 0 and rows.count() == docs.count()
    per = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.sum("size").alias("s"), F.first("source_size").alias("n")).collect()
    assert all(abs(r["t"] - r["w"]) <= 2 * plan.mix.block and r["s"] == r["n"] for r in per)
    # Every slot is filled, and no pass takes a block twice.
    assert plan.slots.count() == sum(plan.quotas)
    assert plan.slots.groupBy("source_id", "pass", "block").count().where("count > 1").count() == 0
    sizes = [r["count"] for r in plan.slots.groupBy("shard").count().collect()]
    assert sorted(sizes)[1:] == [plan.mix.shard_blocks] * (len(sizes) - 1)


def test_documents_of_the_mix(spark):
    docs = table(spark, "documents")
    taken = {r["doc_id"]: r["taken"] for r in m.MixPlan(docs).taken().collect() if r["taken"]}
    mixed = m.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    original = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in mixed.collect():
        got = r["text"].split()
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(got)
        assert r["n_chars"] == len(r["text"]) and set(got) <= set(original[r["doc_id"]])
    assert words == taken


def test_odd_rows(spark):
    texts = ODD_TEXTS + ["repeated row of words"] * 3
    ids = [None, *range(1, len(ODD_TEXTS)), 99, 99, 99]
    sources = [None, "b", "a"] * len(texts)
    docs = documents(spark, texts, ids=ids, sources=sources[: len(texts)])
    mix = m.Mix(block=4, shard_blocks=8)
    plan = m.MixPlan(docs, mix)
    rows = plan.taken().collect()
    assert [s for s, _ in plan.sources] == ["a", "b", None] and len(rows) == len(texts)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    counted = sum(len((r["text"] or "").encode().split()) for r in m.mixed_documents(docs, mix).collect())
    assert counted == sum(r["taken"] for r in rows)
    assert m.MixPlan(docs.limit(0)).taken().count() == 0 and m.mixed_documents(docs.limit(0)).count() == 0
    blank = documents(spark, [None, "", " "])
    assert [r["taken"] for r in m.MixPlan(blank).taken().collect()] == [0, 0, 0]
