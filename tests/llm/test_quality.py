import re
from collections import Counter

from pyspark.sql import functions as F

from hazardspark.llm import quality_rules as q
from tests.llm.helpers import ODD_TEXTS, documents, local_rows, table

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    """The base statistics, word by word."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def test_statistics_equal_a_direct_count(spark):
    texts = ODD_TEXTS + ["a b c d e a b c d e f a b c d e", "p q r s t p q r s t p q", "a\n a\na\na ", "<x> | y & z $5 100% #1 *"]
    texts += [r[1] for r in local_rows("documents")][:60]
    got = q.with_statistics(documents(spark, texts)).select("doc_id", *[f"_stats.{c}" for c in q.BASE]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: counts(t) for i, t in enumerate(texts)}


def test_base_rule_and_empty_labels(spark):
    docs = documents(spark, [None, "few words", "w%d " * 3, " ".join(f"w{i}" for i in range(30)), "a b c d e " * 10])
    assert q.fit(docs, spark.createDataFrame([], LABELS)) == []
    rows = q.judge(docs, []).select("doc_id", "base_failed", "kept").collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == {i: (i != 3, i == 3) for i in range(5)}
    assert q.judge(docs.limit(0), []).count() == 0


def test_learned_rules_are_precise(spark):
    good = [" ".join(f"word{i}{k}" for k in range(30)) for i in range(60)]
    bad = [" ".join(f"w{i}{k}###" for k in range(30)) for i in range(30)]
    bad += [" ".join(f"LOUD{i}{k}" for k in range(30)) for i in range(30)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 0, 0), (5, None, None)], LABELS)
    rules = q.fit(docs, labels)
    kept = {r[0] for r in q.keep_good(docs, labels).select("doc_id").collect()}
    assert len(rules) >= 2 and kept == set(range(60))
    assert q.keep_good(docs, labels).columns == docs.columns


def test_labels_of_the_test_data(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    judged = q.judge(docs, q.fit(docs, labels)).join(labels, "doc_id").where("not base_failed")
    wrong = judged.where((F.col("quality") == 1) != F.col("kept")).count()
    assert wrong <= 0.02 * judged.count()


def test_main_path_has_no_python(spark):
    plan = q.judge(documents(spark, ["x"]), [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
