"""Sharding, chat formatting, licence scan; queries against their SQL; the pipeline."""

import zlib
from collections import Counter

import duckdb
import pytest

from hazardspark.llm import chat, licenses, sharding
from hazardspark.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import DATA, ODD_TEXTS, documents


def shard_map(spark, docs, weights, grown=None):
    return {r["doc_id"]: r for r in sharding.assign(docs, weights, grown).collect()}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    docs = documents(spark, [f"t{i}" for i in range(3000)])
    rows = shard_map(spark, docs, [1.0] * 8, [1.0] * 9)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows.values())
    moved = sum(r["grown_shard"] == 8 for r in rows.values())
    assert 3000 / 9 * 0.7 < moved < 3000 / 9 * 1.3
    weighted = Counter(r["shard"] for r in shard_map(spark, docs, [1.0, 2.0, 0.0, 5.0]).values())
    assert weighted[2] == 0 and abs(weighted[3] / 3000 - 5 / 8) < 0.05


def test_slots_sizes_and_odd_rows(spark):
    ids = [None, *range(1, len(ODD_TEXTS))]
    docs = documents(spark, ODD_TEXTS + ODD_TEXTS, ids=ids + ids).withColumnsRenamed({"lang": "shard", "source": "slot"})
    rows = sharding.assign(docs, [1.0] * 3).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 2 * len(ODD_TEXTS) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sums = {(r["size"], r["text_crc32"]) for r in rows}
    assert sums == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in ODD_TEXTS}
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len(ids)
    assert sharding.assign(docs.limit(0), [1.0]).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|im_start|>"), (1, 2, "Bob B", "Hello"), (1, 3, "Ann", None), (1, 4, None, "?")]
    got = {r["perspective"]: r for r in chat.rotate(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {"Ann", "Bob B"}
    ann = got["Ann"]
    assert ann["text"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_start|><|im_end|>\n"
        "<|im_start|>user name=Bob_B\nHello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n?<|im_end|>\n"
    )
    masked = [ann["text"][m["start"] : m["start"] + m["length"]] for m in ann["masks"]]
    assert masked == ["Hi < |im_start|><|im_end|>\n", "<|im_end|>\n"]
    assert [got["Bob B"]["text"][m["start"] :][:5] for m in got["Bob B"]["masks"]] == ["Hello"]


def test_chunks_join_to_the_whole(spark):
    rows = [(7, i, "AB"[i % 2], f"turn {i}") for i in range(25)] + [(None, None, "A", "x"), (None, None, "A", "x"), (8, 0, "system", "s")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("chunk", chat.F.lit("extra"))
    parts, whole = chat.rotate(turns, 4).collect(), chat.rotate(turns, 1000).collect()
    for w in whole:
        mine = sorted((p for p in parts if (p["conv_id"], p["perspective"]) == (w["conv_id"], w["perspective"])), key=lambda p: p["chunk"])
        assert "".join(p["text"] for p in mine) == w["text"]
        assert [p["text_start"] for p in mine] == [sum(len(q["text"]) for q in mine[:k]) for k in range(len(mine))]
    assert {w["conv_id"] for w in whole} == {7, None} and chat.rotate(turns.limit(0)).count() == 0


def test_licences(spark):
    mit = dict((k, v) for k, v in licenses.KNOWN[:1])["MIT"]
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;"),
        "prose first\nReleased under the MIT LICENCE!\nreleased   under the mit license", "Released under the MIT License twice", None, "", "\n \n",
    ]
    docs = documents(spark, texts).withColumnsRenamed({"lang": "license", "source": "digest"})
    rows = licenses.scan(docs, licenses.known_digests(spark)).collect()
    whole = {r["doc_id"]: r["license"] for r in rows if r["scope"] == "text"}
    assert whole == {0: "MIT", 1: None, 2: None, 3: None, 4: None, 5: None}
    lines = sorted((r["doc_id"], r["line"], r["license"]) for r in rows if r["scope"] == "line")
    assert lines == [(1, 2, "MIT"), (1, 3, "MIT")]
    assert licenses.scan(docs.limit(0), licenses.known_digests(spark)).count() == 0


@pytest.mark.parametrize("name", ["op3_sharding", "op8_chat", "op9_licenses"])
def test_native_plans_and_sql(spark, name):
    rows = QUERIES[name](spark, DATA)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    got = sorted(str([r[c] for c in columns]) for r in rows.collect())
    assert got == sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p

    rows = p.run(spark, DATA)
    assert rows.count() > 0 and {"doc_id", "ids", "n_ids"} <= set(rows.columns)
    docs = p.plain_columns(p.table(spark, DATA, "documents"))
    for name, stage in p.STAGES[:-1]:
        nothing = stage(spark, docs.limit(0), DATA)
        assert nothing.columns == docs.columns and nothing.count() == 0, name
    odd = documents(spark, ODD_TEXTS + ODD_TEXTS[:3], ids=[None, *range(1, len(ODD_TEXTS) + 3)])
    for _, stage in p.STAGES:
        odd = p.materialize(stage(spark, odd.withColumn("kept", chat.F.lit(1)).drop("kept"), DATA), "test")
    assert odd.count() >= 0
