import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import langid, toxicity
from hazardspark.llm.common import id_remainder
from tests.llm.helpers import ODD_TEXTS, documents, table

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "documents", FOLDER)
    model = langid.fit(langid.learnable(docs), per_language=80)
    assert set(model.families()) == {"germanic", "romance"}
    assert ("de", "en") in model.pairs and ("family germanic", "family romance") in model.pairs
    assert ("de", "fr") not in model.pairs  # only within a family
    rows = langid.predict(docs.where(id_remainder("doc_id", 3) == 1), model)
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count()
    assert rows.where("score < 0 or score > 1").count() == 0


def test_odd_languages(spark):
    empty = langid.fit(documents(spark, []))
    assert empty.predict("some text") == ("und", 0.0)
    docs = documents(spark, ODD_TEXTS).withColumnsRenamed({"source": "score"})
    model = langid.fit(docs)
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == len(ODD_TEXTS)
    assert all(rows[i]["lang_pred"] == ("en" if langid.has_letter(t) else "und") for i, t in enumerate(ODD_TEXTS))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    nulls = documents(spark, ["abc def"] * 3, langs=[None] * 3)
    assert langid.fit(nulls).langs == []


def test_counts_do_not_depend_on_the_piece(monkeypatch):
    text = "Ein längerer Satz, der mehrmals steht. " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert np.array_equal(whole, langid.counts(text))


def test_toxic_documents(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    model = toxicity.fit(docs, labels)
    held = docs.where(id_remainder("doc_id", 5) == 0).join(labels, "doc_id")
    rows = toxicity.score(held.select("doc_id", "text", "toxic"), model).withColumn("hit", F.col("score") >= 0.5)
    toxic, hits = rows.where("toxic = 1").count(), rows.where("toxic = 1 and hit").count()
    clean, wrong = rows.where("toxic = 0").count(), rows.where("toxic = 0 and hit").count()
    assert hits >= 0.85 * toxic and wrong <= 0.01 * clean


def _skewed(rng, n):
    """Toxic texts name one group far more often than clean ones do."""
    fillers = [f"word{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = list(rng.choice(fillers, 12)) + (["idiot"] if toxic and rng.random() < 0.8 else [])
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")
        elif rng.random() < 0.3:
            words.append("christian")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_the_penalty_closes_the_gap_between_groups(spark):
    texts, labels = _skewed(np.random.default_rng(2), 300)
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], LABELS)

    def gap(penalty):
        model = toxicity.fit(docs, marks, penalty=penalty)
        assert model.score("word1 idiot word2") > 0.5
        return abs(model.score("word1 muslim word2") - model.score("word1 christian word2"))

    assert gap(30.0) < 0.5 * gap(0.0)


def test_counterfactual_words():
    swapped = toxicity.counterfactuals({"a", "muslim", "he"})
    assert {"a", "christian", "he"} in swapped and {"a", "muslim", "she"} in swapped
    assert toxicity.counterfactuals({"a"}) == []


def test_odd_toxicity(spark):
    docs = documents(spark, ODD_TEXTS).withColumnsRenamed({"source": "score"})
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 1), (2, 0, None)], LABELS)):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == len(ODD_TEXTS) and all(r["score"] < 0.5 for r in rows)
    both = spark.createDataFrame([(i, 1, i % 2) for i in range(len(ODD_TEXTS))], LABELS)
    model = toxicity.fit(docs, both, least_texts=1)
    assert all(0 <= model.score(t) <= 1 for t in ODD_TEXTS)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_gradient():
    """The fit lowers a small loss to its known optimum: two equal words, two labels."""
    rows = [np.array([0]), np.array([1])] * 20
    w, b = toxicity.fit_rows(rows, np.array([1.0, 0.0] * 20), [], 2)
    assert w[0] == pytest.approx(-w[1], rel=0.01) and w[0] > 1 and abs(b) < 0.1
