import random

import pytest
import xxhash

from hazardspark.llm import simhash as s
from hazardspark.llm.common import connected
from hazardspark.session import materialize
from tests.llm.helpers import ODD_TEXTS, documents, local_rows


def print_of(text):
    """The fingerprint, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, limit):
    """Smallest member reachable, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("crowd", [256, 3])
def test_components_equal_all_pairs(spark, crowd):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for base in values[:6]:  # families with chains and near misses
        v = base
        for _ in range(40):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.7 else 7 << rng.randrange(60)
            values.append(v)
    values += [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    values = sorted(set(values))
    rows = [(i, 0, signed(v)) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id long, text_hash long, fp long")
    got = {r["fp"]: r["component_id"] for r in s.components(prints, crowd=crowd).collect()}
    want, first = groups(values, 2), {}
    for i, v in enumerate(values):
        first[want[v]] = min(i, first.get(want[v], i))
    assert got == {signed(v): first[want[v]] for v in values}


def test_documents_and_odd_texts(spark):
    texts = ODD_TEXTS + [r[1] for r in local_rows("documents")]
    docs = documents(spark, texts).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    rows = s.near_duplicates(docs).collect()
    prints = {i: print_of(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    root = groups(set(prints.values()), 2)
    low = {}
    for i, p in prints.items():
        low[root[p]] = min(i, low.get(root[p], i))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: low[root[p]] for i, p in prints.items()}


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [long, long, long + " x", "other text of its own", "other text of its own", None, ""], ids=[7, 7, 3, 4, 4, None, 9])
    kept = sorted((r["doc_id"], r["text"]) for r in s.keep_one(docs).collect())
    apart = (print_of(long) ^ print_of(long + " x")).bit_count() > 2
    assert [k[0] for k in kept] == sorted([3, 4, 9] + [7] * apart)
    assert s.keep_one(docs).columns == docs.columns
    assert s.keep_one(docs.limit(0)).count() == 0 and s.near_duplicates(docs.limit(0)).count() == 0


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (55, 55)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges, "a", "b", "t", materialize).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_connected_ends_at_stars(spark):
    """Each table of a round is written once; a graph of stars needs no round."""
    labels = []

    def keep(df, label):
        labels.append(label)
        return materialize(df, label)

    stars = spark.createDataFrame([(9, 1), (1, 8), (7, 1), (30, 20), (20, 30), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(stars, "a", "b", "t", keep).collect()}
    assert got == {1: 1, 7: 1, 8: 1, 9: 1, 20: 20, 30: 20} and len(labels) == 1
    assert connected(stars.limit(0), "a", "b", "t", keep).count() == 0
    labels.clear()
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {tuple(r) for r in connected(chain, "a", "b", "t", keep).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert len(labels) == 3
