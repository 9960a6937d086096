"""Language identification in two levels with linear support vector machines.

First the family is decided, one machine per pair of families; then, inside the
family, one machine per pair of its languages. Features are hashed byte n-grams of
the lower-cased whole text (square roots of relative frequencies). The machines are
fitted by Spark ML on a bounded sample: at most ``per_language`` distinct texts of
each language, chosen by hash.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows with a
null language or a null id teach nothing; one learned language is predicted for
all; without any learned language every row is ``und``. Repeated rows get equal
results; equal votes go to the alphabetically first name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from hazardspark.llm.common import id_remainder, least_hashes, slices
from hazardspark.session import materialize

DIM = 2048
PIECE = 1 << 20  # bytes of a text that are counted at once

# Families of common languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# ASCII signs and digits separate words; letters and the bytes of other letters stay.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def counts(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of bytes, over the whole text piece by piece."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) + b" "
    total = np.zeros(DIM)
    for start in range(0, len(data), PIECE):
        codes = np.frombuffer(data[start : start + PIECE + 2], np.uint8).astype(np.uint32)
        if len(codes) < 3:
            continue
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        word = (b != 32) | (c != 32)
        pair, triple = (b * 257 + c * 65537), (a + b * 257 + c * 65537)
        for value, salt in ((pair, 0x9E3779B1), (triple, 0x85EBCA6B)):
            slot = ((value[word] + np.uint32(1)) * np.uint32(salt)) >> np.uint32(32 - 11)
            total += np.bincount(slot, minlength=DIM)
    return total


def features(text: str) -> np.ndarray:
    raw = counts(text)
    whole = raw.sum()
    return np.sqrt(raw / whole) if whole else raw


@dataclass
class LanguageModel:
    """Languages, and for each pair of names its weights (positive: the first)."""

    langs: list[str]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def families(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for lang in self.langs:
            out.setdefault(family_of(lang), []).append(lang)
        return out

    def _duel(self, x: np.ndarray, names: list[str]) -> tuple[str, float]:
        """Winner by summed votes and how sure its duels were (0 to 1)."""
        votes = dict.fromkeys(names, 0.0)
        sure: dict[str, list[float]] = {n: [] for n in names}
        for one, two in combinations(sorted(names), 2):
            if (one, two) not in self.pairs:
                continue
            w, b = self.pairs[one, two]
            p = 1 / (1 + np.exp(-2 * np.clip(x @ w + b, -20, 20)))
            votes[one] += p
            votes[two] += 1 - p
            sure[one].append(p)
            sure[two].append(1 - p)
        best = min(votes, key=lambda n: (-votes[n], n))
        return best, float(min(sure[best], default=1.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        x, families = features(text), self.families()
        family, p = self._duel(x, [f"family {f}" for f in families])
        lang, q = self._duel(x, families[family.removeprefix("family ")])
        return lang, p * q


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang")
        rows = [features(t).astype(np.float32) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * DIM
        yield pa.RecordBatch.from_arrays([langs, pa.ListArray.from_arrays(offsets, flat)], ["lang", "x"])


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` distinct texts of each language, by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    spots = known.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    chosen = least_hashes(materialize(spots, "language-texts"), "lang", "h", per_language)
    # per_language rows for each language: a bounded broadcast.
    return (
        known.select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
        .join(F.broadcast(chosen), ["lang", "h", "doc_id"]).dropDuplicates(["lang", "h"])
    )


def fit(docs: DataFrame, per_language: int = 400, rounds: int = 20) -> LanguageModel:
    """Fit all machines on a sample of ``docs`` (columns doc_id, text, lang)."""
    rows = training_sample(docs, per_language).select("text", "lang")
    stored = materialize(rows.mapInArrow(_features_of, "lang string, x array<float>"), "language-sample")
    langs = sorted(r["lang"] for r in stored.select("lang").distinct().collect())
    model = LanguageModel(langs)
    families = model.families()
    data = stored.select("lang", array_to_vector("x").alias("features")).coalesce(4).cache()

    def machine(one: tuple[str, list[str]], two: tuple[str, list[str]]) -> None:
        rows = data.where(F.col("lang").isin(one[1] + two[1]))
        rows = rows.withColumn("label", F.col("lang").isin(one[1]).cast("double"))
        # All features have one scale, so they are not standardised.
        svm = LinearSVC(maxIter=rounds, regParam=1e-4, standardization=False).fit(rows)
        model.pairs[one[0], two[0]] = (svm.coefficients.toArray(), float(svm.intercept))

    for one, two in combinations(sorted(families), 2):
        machine((f"family {one}", families[one]), (f"family {two}", families[two]))
    for members in families.values():
        for one, two in combinations(sorted(members), 2):
            machine((one, [one]), (two, [two]))
    data.unpersist()
    return model


def predict(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its score; other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            kept = [c for c in batch.schema.names if c not in (lang_col, score_col)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())],
                [*kept, lang_col, score_col],
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([f for f in docs.schema.fields if f.name not in (lang_col, score_col)])
    return docs.mapInArrow(run, schema.add(lang_col, StringType()).add(score_col, DoubleType()))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32 of the id, modulo 3, is not 1."""
    return docs.where(id_remainder("doc_id", 3) != 1)


def keep_identified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """Only documents whose language is found with at least ``least_score``."""
    found = predict(docs, fit(learnable(docs)), "_lang_pred", "_lang_score")
    return found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least_score)).select(*docs.columns)
