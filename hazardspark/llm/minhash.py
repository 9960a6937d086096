"""Document fingerprints by one-permutation MinHash.

The word shingles of a whole text are hashed once. The top bits of a hash choose a
bin, the smallest remaining value of each bin is its minimum. An empty bin copies the
minimum of another bin, tried in an order of its own that is the same for every
document (optimal densification), until a filled one is found. Of each minimum the
low ``bits`` bits are stored. Two fingerprints agree in a bin by chance with
probability 2^-bits, which the likeness corrects for.

Hashes are vectorised: the bytes of a word are combined by a running polynomial
modulo 2^64, mixed, and five mixed words are combined to a shingle.

Edge cases: a text of fewer words than a shingle has one shingle, the whole sequence;
a null or blank text has none and the fingerprint ``none``: it is like another such
text (1) and unlike any other (0). Equal texts have equal fingerprints. The next
document is the next row by doc_id, then text hash (null ids first); after the last
comes the first, so a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardspark.llm.common import slices

BINS, BITS, WIDTH = 256, 4, 5
NONE = "none"
PIECE = 1 << 22  # bytes hashed at once

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Fingerprinter:
    """Fingerprints of texts; holds the tables that do not depend on a text."""

    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH):
        if bins & (bins - 1) or 64 % bits or bins * bits % 8:
            raise ValueError("bins must be a power of two and bits divide 64")
        self.bins, self.bits, self.width = bins, bits, width
        # For each empty bin the order in which it asks the others.
        rng = np.random.Generator(np.random.Philox(key=[bins, 7]))
        self.order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
        self.power = _powers(_BASE, 1 << 12)
        self.inverse = _powers(_INVERSE, 1 << 12)

    def _power_tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.power):
            size = 1 << (n - 1).bit_length()
            self.power, self.inverse = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.power[:n], self.inverse[:n]

    def word_hashes(self, data: bytes) -> np.ndarray:
        """Hashes of the words of ``data``, piece by piece, cut at white space."""
        if len(data) <= PIECE:
            return self._word_hashes(np.frombuffer(data, np.uint8))
        out, start = [], 0
        while start < len(data):
            end = min(len(data), start + PIECE)
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            out.append(self._word_hashes(np.frombuffer(data[start:end], np.uint8)))
            start = end
        return np.concatenate(out)

    def _word_hashes(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, np.uint64)
        inside = np.concatenate([[False], ~_SPACES[codes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        power, inverse = self._power_tables(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
            return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        n, width = len(words), self.width
        if not n:
            return words
        size = min(n, width)
        out = np.full(n - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = _mix(out * np.uint64(_BASE) + words[k : n - size + 1 + k])
        return out

    def minima(self, text: str) -> np.ndarray | None:
        """Low bits of all bins, or None for a text without words."""
        hashes = self.shingles(self.word_hashes(text.encode("utf-8", "surrogatepass")))
        if not len(hashes):
            return None
        shift = np.uint64(64 - self.bins.bit_length() + 1)
        mine = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        bin_of = (hashes >> shift).astype(np.int64)
        np.minimum.at(mine, bin_of, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
        filled = np.zeros(self.bins, bool)
        filled[bin_of] = True
        empty = np.flatnonzero(~filled)
        if len(empty):
            turns = self.order[empty]
            mine[empty] = mine[turns[np.arange(len(empty)), filled[turns].argmax(axis=1)]]
        return (_mix(mine) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, low: np.ndarray | None) -> str:
        if low is None:
            return NONE
        bits = (low[:, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1
        return np.packbits(bits.astype(np.uint8).ravel()).tobytes().hex()

    def unpack(self, packed: str) -> np.ndarray | None:
        if packed == NONE:
            return None
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(packed), np.uint8)).reshape(-1, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1))

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated share of common shingles, corrected for chance agreement."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 2.0**-self.bits
        return float(np.clip(((a == b).mean() - chance) / (1 - chance), 0.0, 1.0))

    def fingerprint(self, text: str | None) -> str:
        return self.pack(self.minima(text or ""))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits)
        for batch in slices(batches):
            prints = [maker.fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, fingerprint string"
    )


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows in id order, cut into ``parts`` runs that each end with the row that follows.

    Columns doc_id, text, run and ``guest`` (true for the following row). The run
    bounds are quantiles of the ids (one small list on the driver), and the first row
    of each run is repeated as the guest of the run before, so one shuffle of the
    texts puts every document beside its next.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or []))
    run = _run_of(bounds)
    rows = rows.withColumn("run", run)
    # First row of each run: at most ``parts`` rows.
    heads = rows.groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("head")).collect()
    heads = sorted((h["run"], h["head"]["doc_id"], h["head"]["tie"]) for h in heads)
    guests = [(heads[k][0], *heads[(k + 1) % len(heads)]) for k in range(len(heads))]
    schema = "to long, _run long, _doc_id long, _tie long"
    table = spark.createDataFrame(guests, schema)
    same = (F.col("run") == F.col("_run")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie"))
    copies = rows.join(F.broadcast(table), same).groupBy("to", "doc_id", "tie").agg(F.first("text").alias("text"))
    copies = copies.select("doc_id", "text", "tie", F.col("to").alias("run"), F.lit(True).alias("guest"))
    return (
        rows.withColumn("guest", F.lit(False)).unionByName(copies)
        .repartitionById(len(heads) or 1, F.col("run").cast("int"))
        .sortWithinPartitions("run", "guest", "doc_id", "tie")
    )


def _run_of(bounds: list[int]):
    """Number of the bounds up to the id, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(0).cast("long")
    middle = len(bounds) // 2
    if len(bounds) == 1:
        low, high = F.lit(0).cast("long"), F.lit(1).cast("long")
    else:
        low, high = _run_of(bounds[:middle]), F.lit(middle + 1) + _run_of(bounds[middle + 1 :])
    return F.when(F.col("doc_id") >= F.lit(bounds[middle]), high).otherwise(low)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and the likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits)
        held = None  # the row that waits for its next: run, doc_id, text, minima

        for batch in slices(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text")]
            for part, guest, doc_id, text in zip(*columns):
                low = maker.minima(text)
                if held is not None and held[0] == part:
                    _, own_id, own, own_low = held
                    changed = edited(own, text)
                    changed_low = maker.minima(changed)
                    out.append((
                        own_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        maker.pack(own_low), maker.pack(changed_low),
                        maker.likeness(own_low, changed_low), maker.likeness(own_low, low),
                    ))
                held = None if guest else (part, doc_id, text, low)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return with_next(docs).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, _TYPES)))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = ["long", "long", "string", "string", "string", "double", "double"]
