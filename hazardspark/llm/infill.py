"""Fill-in-the-middle rewriting with a learned rank index of the token boundaries.

A text of n tokens has n + 1 boundaries. :class:`BoundaryIndex` maps the rank of a
boundary to its offset: straight segments are fitted to all boundary offsets of the
whole text so that none is further than ``error`` from its line, and the rounding
differences are stored as one signed byte each. A cut is predicted by its segment
and corrected exactly by its stored difference.

Two draws of a document's own hash are the cuts between prefix, middle and suffix;
two more choose the form. The output carries the markers ``<P>``, ``<S>`` and ``<M>``
and gives the text back exactly, since a text with a marker of its own stays plain.

Edge cases: a null text is the empty text and stays plain; a null id is hashed as no
digits; blank texts are one token; equal ids draw equally, repeated rows give equal
rows; other columns of the table are ignored; an empty table gives no rows. Texts are
worked on one at a time, so a very long one costs its own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 100  # code points; the rounded difference fits a signed byte
_STRETCH = 256  # boundaries looked at first when a segment grows


def token_boundaries(text: str) -> np.ndarray:
    """Offsets (code points) of all token boundaries of ``text``, 0 and its end included.

    A token is a word with the white space before it; white space at the end is one too.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    tail = [len(points)] if len(points) and space[-1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


class BoundaryIndex:
    """Piecewise linear map from rank to offset with exact corrections."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error <= 126:
            raise ValueError("error must lie between 1 and 126")
        starts, slopes = [], []
        at, n = 0, len(offsets)
        while at < n:
            length, slope = self._grow(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at += length
        self.starts = np.array(starts, np.int64)
        self.slopes = np.array(slopes)
        self.origins = offsets[self.starts]
        self.size = n
        ranks = np.arange(n)
        segment = np.repeat(np.arange(len(starts)), np.diff(np.append(self.starts, n)))
        self.residuals = (offsets - self._line(ranks, segment)).astype(np.int8)

    @staticmethod
    def _grow(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Ranks that one line through boundary ``at`` serves, and its slope.

        The slopes that keep a further boundary within ``error`` form an interval; the
        segment ends where the running intersection of these intervals is empty.
        """
        low, high, done, stretch = -np.inf, np.inf, 1, _STRETCH
        while at + done < len(offsets):
            ahead = np.arange(done, min(done + stretch, len(offsets) - at))
            rise = (offsets[at + ahead] - offsets[at]).astype(float)
            lows = np.maximum(np.maximum.accumulate((rise - error) / ahead), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / ahead), high)
            bad = lows > highs
            if bad.any():
                stop = int(bad.argmax())
                if stop:
                    low, high = lows[stop - 1], highs[stop - 1]
                done += stop
                break
            low, high, done, stretch = lows[-1], highs[-1], done + len(ahead), stretch * 2
        return done, 0.0 if done == 1 else float(low + high) / 2

    def _line(self, rank, segment):
        return self.origins[segment] + np.rint(self.slopes[segment] * (rank - self.starts[segment])).astype(np.int64)

    def cut(self, rank: int) -> int:
        """Offset of boundary ``rank``: the prediction of its segment plus the stored difference."""
        segment = int(np.searchsorted(self.starts, rank, side="right")) - 1
        return int(self._line(rank, segment)) + int(self.residuals[rank])


def rewrite(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return prefix + middle + suffix


def restore(form: str, output: str) -> str:
    """The text that :func:`rewrite` was given, from its output and form."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


_SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string, "
    "segments int"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
_COLUMNS = [field.split()[0] for field in _SCHEMA.split(", ")]


def _split(doc_id, text: str, h: list[int], plain_percent: int, spm_percent: int, error: int) -> tuple:
    index = BoundaryIndex(token_boundaries(text), error)
    n = index.size - 1
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, n, "plain", None, None, text, text, len(index.starts)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = index.cut(one), index.cut(two)
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    output = rewrite(form, text[:a], text[a:b], text[b:])
    return doc_id, n, form, a, b - a, output, restore(form, output), len(index.starts)


def _transform(plain_percent: int, spm_percent: int, error: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns = batch.to_pydict()
            rows = [
                _split(i, t or "", list(h), plain_percent, spm_percent, error)
                for i, t, *h in zip(*[columns[c] for c in ("doc_id", "text", "h1", "h2", "h3", "h4")])
            ]
            out = [list(c) for c in zip(*rows)]
            if digests:
                for k in (5, 6):
                    out[k] = [hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in out[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _COLUMNS)

    return run


def fill_in_middle(
    docs: DataFrame, plain_percent: int = 50, spm_percent: int = 80, error: int = ERROR, seed: int = 42,
    digests: bool = False,
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output, restored (the text
    rebuilt from output and form) and segments (of the index) of every row.

    With ``digests`` the two texts are given as SHA-256 (lower-case hex, UTF-8) only.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", *[h.alias(f"h{k + 1}") for k, h in enumerate(draws(doc_id, seed))])
    return rows.mapInArrow(_transform(plain_percent, spm_percent, error, digests), _SCHEMA)
