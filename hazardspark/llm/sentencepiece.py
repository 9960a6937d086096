"""SentencePiece encoding by streaming Viterbi, and decoding.

The best path by summed piece scores is found from left to right. Only the scores
of the last ``longest piece`` positions are needed to go on; from these live
positions the backpointers are followed, and where they all meet in one boundary the
ids before it are committed and forgotten. A text of any length needs a window, not
a table.

In most vocabularies no piece reaches across the start of a word, so all paths meet
there. Such boundaries are read off the vocabulary; words between them are encoded
once and kept in a bounded cache of each worker.

A character without a piece becomes its UTF-8 bytes (byte fallback), or the unknown
id in a model without byte pieces. Edge cases: a null text has null ids; an empty
text has none; control signs and any other code point round-trip through byte
pieces; a literal word-boundary sign decodes to a space, as in the library.
Repeated rows get equal ids; equal scores prefer the longer last piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from hazardspark.llm.common import slices

MARK = "▁"  # stands for a space
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 120_000  # words a worker remembers
CACHED_LENGTH = 64  # longer words are not remembered
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with scores; ``byte_ids`` is empty in a model without byte pieces."""

    scores: dict[str, tuple[int, float]]
    decoded: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file (identity normalisation only)."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that do not change the text are supported")
        normal = [p.score for p in proto.pieces if p.type == _NORMAL]
        top, low = max(normal), min(normal)
        scores, decoded, byte_ids, unknown = {}, [], {}, 0
        for i, p in enumerate(proto.pieces):
            out = p.piece.replace(MARK, " ").encode()
            if p.type == _NORMAL:
                scores[p.piece] = (i, p.score)
            elif p.type == _USER:
                scores[p.piece] = (i, len(p.piece.encode()) * top - 0.1)
            elif p.type == _BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                unknown, out = i, " ⁇ ".encode()
            else:
                out = b""
            decoded.append(out)
        return cls(
            scores, decoded, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
            unknown, low - _UNKNOWN_PENALTY, rules.add_dummy_prefix,
        )

    @property
    def longest(self) -> int:
        return max(map(len, self.scores))


class StreamingViterbi:
    """Feed characters, take ids as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = vocabulary.longest
        self.by_length = [set() for _ in range(self.longest + 1)]
        for piece in vocabulary.scores:
            self.by_length[len(piece)].add(piece)
        self.lengths = [n for n in range(self.longest, 0, -1) if self.by_length[n]]
        self.reset()

    def reset(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.best = [0.0]
        self.back = [0]
        self.most_kept = 0  # longest window so far

    def _ids(self, piece: str) -> list[int]:
        known = self.v.scores.get(piece)
        if known:
            return [known[0]]
        if self.v.byte_ids:
            return [self.v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.v.unknown_id]

    def _path(self, end: int) -> list[int]:
        """Ids from the last boundary to position ``end``."""
        cuts = [end]
        while cuts[-1]:
            cuts.append(self.back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self._ids(self.text[a:b])]

    def _meeting(self) -> int:
        """The boundary that all paths from live positions pass."""
        end = len(self.text)
        live = set(range(max(0, end - self.longest + 1), end + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        return live.pop()

    def feed(self, chars: str) -> list[int]:
        """Ids that became certain by reading ``chars``."""
        out: list[int] = []
        scores = self.v.scores
        for start in range(0, len(chars), self.longest):
            part = chars[start : start + self.longest]
            end0 = len(self.text)
            self.text += part
            text, best, back = self.text, self.best, self.back
            for end in range(end0 + 1, len(text) + 1):
                top, at = None, end - 1
                for n in self.lengths:
                    if n <= end:
                        known = scores.get(text[end - n : end])
                        if known is not None:
                            score = best[end - n] + known[1]
                            if top is None or score > top:
                                top, at = score, end - n
                if text[end - 1] not in scores:
                    score = best[end - 1] + self.v.unknown_score
                    if top is None or score > top:
                        top, at = score, end - 1
                best.append(top)
                back.append(at)
            self.most_kept = max(self.most_kept, len(text))
            cut = self._meeting()
            if cut:
                out += self._path(cut)
                low = best[cut]
                self.text = text[cut:]
                self.best = [b - low for b in best[cut:]]
                self.back = [max(0, b - cut) for b in back[cut:]]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self.reset()
        return out


class WordTable:
    """The same recurrence for many short words at once, position by position.

    Pieces are found by a rolling hash in two tables, each slot of which holds one
    piece; the hash is compared in full.
    """

    LENGTHS = (8, 16, 32, 64)
    CHARS = 1 << 15  # characters of one step, padding included
    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: Vocabulary, viterbi: StreamingViterbi):
        self.v, self.viterbi = vocabulary, viterbi
        pieces = list(vocabulary.scores)
        self.ids = np.array([-1] + [vocabulary.scores[p][0] for p in pieces], np.int32)
        self.scores = np.array([-np.inf] + [vocabulary.scores[p][1] for p in pieces])
        self.hashes = np.zeros(len(pieces) + 1, np.uint64)
        for k, p in enumerate(pieces, 1):
            h = 0
            for c in p:
                h = (h * int(self._BASE) + ord(c) + 1) & (2**64 - 1)
            self.hashes[k] = h
        if len(set(self.hashes.tolist())) != len(self.hashes):
            raise ValueError("two pieces have one hash")
        self.shift = np.uint64(64 - 20)
        for seed in range(1, 1000, 2):
            if self._placed(np.uint64(seed * 0xD1B54A32D192ED03 & (2**64 - 1)), np.uint64(seed * 0x94D049BB133111EB & (2**64 - 1))):
                return
        raise ValueError("the pieces do not fit the tables")

    def _placed(self, one: np.uint64, two: np.uint64) -> bool:
        self.one, self.two = one, two
        self.first = np.zeros(1 << 20, np.int32)
        self.second = np.zeros(1 << 20, np.int32)
        numbers = np.arange(1, len(self.hashes), dtype=np.int32)
        with np.errstate(over="ignore"):
            slot = (self.hashes[1:] * one) >> self.shift
            self.first[slot] = numbers
            rest = numbers[self.first[slot] != numbers]
            slot = (self.hashes[rest] * two) >> self.shift
        self.second[slot] = rest
        return bool((self.second[slot] == rest).all())

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, 0 for none."""
        k = self.first[(h * self.one) >> self.shift]
        miss = np.flatnonzero(self.hashes[k] != h)
        if len(miss):
            rest = h[miss]
            other = self.second[(rest * self.two) >> self.shift]
            k[miss] = np.where(self.hashes[other] == rest, other, 0)
        return k

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {n: [] for n in self.LENGTHS}
        for k, w in enumerate(words):
            fits = next((n for n in self.LENGTHS if len(w) <= n), 0)
            if not fits or "\0" in w:
                out[k] = self._slow(w)
            else:
                groups[fits].append(k)
        for size, members in groups.items():
            rows = self.CHARS // size
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for k, ids in zip(part, self._step([words[k] for k in part], size)):
                    out[k] = ids
        return out

    def _slow(self, word: str) -> bytes:
        return np.array(self.viterbi.feed(word) + self.viterbi.finish(), np.int32).tobytes()

    def _step(self, words: list[str], size: int) -> list[bytes]:
        count = len(words)
        packed = "".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
        chars = np.ascontiguousarray(np.frombuffer(packed, np.uint32).reshape(count, size).T).astype(np.uint64)
        chars += np.uint64(1)
        found, score = [], []
        h = np.zeros_like(chars)
        with np.errstate(over="ignore"):
            for n in range(1, min(size, self.viterbi.longest) + 1):
                h = h[: size - n + 1] * self._BASE + chars[n - 1 :]
                k = self._find(h.ravel()).reshape(h.shape)
                s = self.scores[k]
                if n == 1:
                    s[k == 0] = self.v.unknown_score
                found.append(k)
                score.append(s)
        best = np.full((size + 1, count), -np.inf)
        best[0] = 0
        length = np.zeros((size + 1, count), np.int64)
        piece = np.zeros((size + 1, count), np.int32)
        for end in range(1, size + 1):
            for n in range(min(end, len(found)), 0, -1):
                value = best[end - n] + score[n - 1][end - n]
                better = value > best[end]
                np.copyto(best[end], value, where=better)
                np.copyto(length[end], n, where=better)
                np.copyto(piece[end], found[n - 1][end - n], where=better)
        where, row = np.array([len(w) for w in words]), np.arange(count)
        ids, used = np.zeros((count, size), np.int32), np.zeros(count, np.int64)
        unknown = np.zeros(count, bool)
        while len(row):
            k = piece[where[row], row]
            used[row] += 1
            ids[row, size - used[row]] = self.ids[k]
            unknown[row[k == 0]] = True
            where[row] -= length[where[row], row]
            row = row[where[row] > 0]
        raw = ids.tobytes()
        return [
            self._slow(w) if odd else raw[4 * ((j + 1) * size - n) : 4 * (j + 1) * size]
            for j, (w, n, odd) in enumerate(zip(words, used.tolist(), unknown.tolist()))
        ]


class Encoder:
    """Texts to ids and back, with the words between certain boundaries cached."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.viterbi = StreamingViterbi(vocabulary)
        self.table = WordTable(vocabulary, self.viterbi)
        self.known: dict[str, bytes] = {}
        long_pieces = [p for p in vocabulary.scores if len(p) > 1]
        alone = [c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in long_pieces)]
        split = not any(MARK in p.lstrip(MARK) for p in long_pieces)
        sep = "".join(map(re.escape, alone))
        # Between two matches no piece can reach from the one into the other.
        self.words = (
            re.compile(f"{MARK}*[^{MARK}{sep}]+|{MARK}+" + (f"|[{sep}]" if sep else "")) if split else None
        )

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of every text; the unknown words of all texts are encoded together."""
        prefix = MARK if self.v.prefix else ""
        marked = [prefix + t.replace(" ", MARK) if t else t for t in texts]
        if self.words is None:
            return [None if t is None else np.array(self.viterbi.feed(t) + self.viterbi.finish(), np.int32) for t in marked]
        split = [self.words.findall(t) if t else [] for t in marked]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set().union(*split)
        long_words = {w for w in new if len(w) > CACHED_LENGTH}
        listed = sorted(new - long_words)
        self.known.update(zip(listed, self.table.encode(listed)))
        known = self.known
        if long_words:
            known = dict(known)
            known.update((w, self.table._slow(w)) for w in long_words)
        return [
            None if t is None else np.frombuffer(b"".join([known[w] for w in ws]), np.int32) for t, ws in zip(texts, split)
        ]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.v.decoded.__getitem__, ids.tolist()))
        if self.v.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _ship(spark: SparkSession, model: str) -> Broadcast:
    """The vocabulary, as plain values, on every executor."""
    return spark.sparkContext.broadcast({"vocabulary": vars(Vocabulary.load(model))})


def _encoder(shipped: Broadcast) -> Encoder:
    """The encoder of a shipped vocabulary, kept beside it in the worker between tasks."""
    if "encoder" not in shipped.value:
        shipped.value["encoder"] = Encoder(Vocabulary(**shipped.value["vocabulary"]))
    return shipped.value["encoder"]


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_())
    )


def encode(docs: DataFrame, model: str = MODEL, verify: bool = False) -> DataFrame:
    """Replace ``text`` by ``ids`` and ``n_ids``; with ``verify`` also ``round_trip``:
    whether decoding the ids gives the text back."""
    shipped = _ship(docs.sparkSession, model)
    own = ("text", "ids", "n_ids", "round_trip")
    kept = [f for f in docs.schema.fields if f.name not in own]
    schema = StructType(list(kept)).add("n_ids", LongType()).add("ids", ArrayType(IntegerType()))
    if verify:
        schema = schema.add("round_trip", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = encoder.encode_all(texts)
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([None if i is None else len(i) for i in ids], pa.int64()), _lists(ids)]
            if verify:
                same = [None if t is None else encoder.decode(i) == t.replace(MARK, " ") for t, i in zip(texts, ids)]
                columns.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Replace ``ids`` by ``text`` (null ids: null)."""
    shipped = _ship(rows.sparkSession, model)
    kept = [f for f in rows.schema.fields if f.name not in ("ids", "text")]
    schema = StructType(list(kept)).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for batch in slices(batches):
            texts = [None if i is None else encoder.decode(np.array(i, np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())], schema.names
            )

    return rows.mapInArrow(run, schema)
