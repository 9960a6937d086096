"""Toxicity by a counterfactually regularised linear classifier.

The classifier is logistic over the distinct words of a whole text. Besides the
usual loss it pays for every change of its score when the identity terms of a
labelled text are swapped for others of their group (women for men, one faith for
another), so that naming a group neither raises nor lowers the score.

It is fitted on a bounded sample: at most ``sample`` distinct labelled texts of each
label, chosen by hash, and at most ``terms`` words that occur in ``least_texts`` of
them. The word counts are made by Spark; what reaches the driver is the sample as
word numbers.

Edge cases: a null, blank or wordless text gets the score of the bias alone; rows
with a null label or id teach nothing; without labels of both kinds the score is the
share of toxic labels (0.0 if there are none). Repeated rows score alike; several
labels of one id count as the highest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from hazardspark.llm.common import id_remainder, least_hashes, slices
from hazardspark.session import materialize

WORD = r"[^\W\d_]+"
_WORD = re.compile(WORD)

# Groups of terms that stand for one another in a counterfactual.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "foreigner", "refugee", "native"),
    ("immigrants", "foreigners", "refugees", "natives"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("femme", "homme"), ("femmes", "hommes"),
    ("frau", "mann"), ("frauen", "männer"),
    ("mujer", "hombre"), ("mujeres", "hombres"),
)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def counterfactuals(found: set[str], groups=IDENTITY_GROUPS) -> list[set[str]]:
    """The text's words with the terms of one group moved on by one, two, ... places."""
    out = []
    for group in groups:
        here = [t for t in group if t in found]
        if not here:
            continue
        rest = found.difference(group)
        for step in range(1, len(group)):
            out.append(rest | {group[(group.index(t) + step) % len(group)] for t in here})
    return out


@dataclass
class ToxicityModel:
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def score_words(self, found: set[str]) -> float:
        known = self.terms
        total = self.bias + float(self.weights[sorted(known[w] for w in found if w in known)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))


class _Rows:
    """Texts as word numbers, laid end to end."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.lengths)
        self.n, self.size = len(rows), size

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.flat], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=r[self.owner], minlength=self.size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(
    rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], size: int,
    penalty: float = 1.0, ridge: float = 1e-3, rounds: int = 250, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + penalty * mean squared score change over ``pairs``
    (row, words after the swap) + ridge, by Adam over all rows.

    Both labels weigh the same, and a word counts by its log ratio of document
    frequencies in the two, so that words as frequent in both stay near zero.
    """
    data = _Rows(rows, size)
    swapped = _Rows([p[1] for p in pairs], size)
    origin = np.array([p[0] for p in pairs], np.int64)
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    scale = np.abs(np.log((data.back(labels) + 1) / (ones + 2)) - np.log((data.back(1 - labels) + 1) / (zeros + 2)))
    share = np.where(labels > 0, 0.5 / ones, 0.5 / zeros)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = _sigmoid(data.times(w * scale) + b)
        residual = (p - labels) * share
        if len(pairs):
            q = _sigmoid(swapped.times(w * scale) + b)
            change = 2 * penalty * (p[origin] - q) / len(pairs)
            own = np.bincount(origin, weights=change * p[origin] * (1 - p[origin]), minlength=len(rows))
            other = -change * q * (1 - q)
            grad = data.back(residual + own) + swapped.back(other)
            grad_b = residual.sum() + own.sum() + other.sum()
        else:
            grad, grad_b = data.back(residual), residual.sum()
        g = np.append(grad * scale + ridge * w, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w * scale, b


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic and text of at most ``sample`` distinct texts of each label."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(id_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    # Labels first: only about so many are looked up, and each text counts once.
    marks = materialize(marks.withColumn("_h", F.xxhash64("doc_id")), "toxicity-labels")
    chosen = least_hashes(marks, "toxic", "_h", sample).drop("_h")
    return (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).drop("h")
    )


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, terms: int = 20_000, least_texts: int = 3,
    penalty: float = 1.0, groups=IDENTITY_GROUPS,
) -> ToxicityModel:
    """Fit on labelled documents whose id's crc32 modulo 5 is not 0."""
    rows = training_sample(docs, labels, sample).mapInArrow(_split_words, "doc_id long, toxic int, words array<string>")
    stored = materialize(rows, "toxicity-sample")
    counts = (
        stored.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_texts).orderBy(F.desc("n"), "word").limit(terms)
    )
    model = ToxicityModel({r["word"]: i for i, r in enumerate(counts.collect())})
    identity = {t for g in groups for t in g}
    swaps = sorted(identity.difference(model.terms))
    for term in swaps:  # terms met only in counterfactuals keep a weight of their own
        model.terms[term] = len(model.terms)
    known = model.terms
    wanted = F.array(*[F.lit(t) for t in sorted(identity)])
    number = stored.select(
        "doc_id", "toxic", F.explode_outer("words").alias("word"), F.arrays_overlap("words", wanted).alias("named")
    )
    number = number.join(F.broadcast(counts.select("word")), "word", "left_semi").unionByName(
        number.where(F.col("word").isin(sorted(identity)))
    )
    found = number.groupBy("doc_id", "toxic").agg(F.collect_set("word").alias("words")).collect()
    found = sorted((r["doc_id"], r["toxic"], r["words"]) for r in found)
    labels_of = np.array([float(toxic > 0) for _, toxic, _ in found])
    if not len(found) or labels_of.min() == labels_of.max():
        share = labels_of.mean() if len(found) else 0.0
        model.bias = 30.0 if share else -30.0
        model.weights = np.zeros(len(known))
        return model
    number_of = [np.array(sorted(known[w] for w in ws), np.int64) for _, _, ws in found]
    pairs = [
        (i, np.array(sorted(known[w] for w in swap), np.int64))
        for i, (_, _, ws) in enumerate(found) for swap in counterfactuals(set(ws), groups)
    ]
    model.weights, model.bias = fit_rows(number_of, labels_of, pairs, len(known), penalty)
    return model


def _split_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.string()))],
            ["doc_id", "toxic", "words"],
        )


def score(docs: DataFrame, model: ToxicityModel, score_col: str = "score") -> DataFrame:
    """Add the score; other columns stay as they are."""
    kept = [f for f in docs.schema.fields if f.name != score_col]
    schema = StructType(list(kept)).add(score_col, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(values, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
