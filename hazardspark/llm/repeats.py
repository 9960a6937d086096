"""Removal of long byte strings that occur more than once, by suffix sorting in parts.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else in
the corpus. The starts of such strings are found by suffix arrays over parts of the
corpus that are chosen so that equal strings always lie in one part:

1. The least hash of the short grams inside a window of ``length`` bytes names its part;
   equal windows have equal grams. Neighbouring windows mostly share their least gram, so
   a run of windows is one stretch of text of less than twice ``length`` bytes. Only
   hashes leave the texts, and grams that occur once drop out.
2. Equal stretches are one from there on, with the number of times they occur. Each
   different stretch of a repeated gram is cut out of one text and sent to its part.
3. Equal windows of two stretches have the gram at the same place, so two stretches that
   share a window agree on one of a few pieces around the gram; stretches that occur
   once and agree with no other are left out. The rest of a part (cut at gram borders
   into pieces of about ``PIECE`` bytes) is sorted by two-stage suffix sorting,
   stretches that occur twice or more twice, and common prefixes of neighbours in the
   order mark the repeated windows.
4. These go back to all texts that have the stretch, are joined to runs and removed.

A gram with more than ``CROWD`` different stretches is split: the windows of a stretch
are dealt in blocks by their distance to the gram, and the bytes that all windows of a
block share choose the part. The last blocks are single windows, whose part holds one
stretch only. So no part grows with the corpus, and nothing is dropped or capped.

Stretches are told apart by 128 bits of hashes (gram and stretch), texts by 128 bits.
Texts travel only where needed: a table of bits of fixed size (8 MB) names the texts to
send; when it is full it lets more through, never fewer.

Edge cases: a null text is empty; texts shorter than ``length`` keep all bytes; a
repeated row, also with the same id, repeats all its strings; other columns are ignored;
an empty table gives no rows. A long text is hashed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.llm.suffixes import Collection, repeated_starts
from hazardspark.session import materialize

LENGTH = 400
GRAM = 16
PIECE = 1 << 20  # bytes sorted together, but for a gram that has more
CROWD = 2048  # stretches of a gram sorted in one part
BLOCKS = (32, 1)  # windows of a block, for grams with more stretches
PIECES = 6  # places of a window's start before its gram that are told apart
_STEP = (1 << 20) - 1024  # windows hashed at once; positions take 20 bits
_MIX = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BITS = 26
_PAGE = 15  # bits of one row of the sieve: 4 kB


def sieve(keys: DataFrame, *key: str) -> DataFrame:
    """Bits of the hashed keys as at most 2048 rows of 4 kB."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << _BITS))
    paged = keys.select(F.shiftright(place, _PAGE).alias("_page"), (place % (1 << _PAGE)).alias("_bit"))
    return paged.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def sifted(df: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """The rows whose key may be in the sieve; a key that is in it always stays."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << _BITS))
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return (
        df.withColumns({"_page": F.shiftright(place, _PAGE), "_bit": place % (1 << _PAGE)})
        .join(F.broadcast(bits), "_page")
        .where(f"shiftright({byte}, cast(_bit % 8 as int)) & 1 = 1")
        .select(*df.columns)
    )


def _records(columns: Sequence, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    words = np.ndarray(n + 8, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    x = words[:n] * _MIX[0] ^ (words[8 : n + 8] * _MIX[1] >> np.uint64(7))
    x ^= x >> np.uint64(31)
    x *= _MIX[2]
    return x ^ (x >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima before and after block borders."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one least gram: start, number of windows, place and hash of the gram.

    ``ends`` holds, for each byte, the end of its text; windows stay inside a text.
    """
    width, bits = length - GRAM + 1, np.uint64((1 << 20) - 1)
    for base in range(0, len(data) - length + 1, _STEP):
        n = min(_STEP, len(data) - length + 1 - base)
        hashes = _gram_hashes(data[base : base + n + length - 1])
        keyed = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
        gram = (_sliding_least(keyed, width) & bits).astype(np.int64)
        place = np.arange(base, base + n)
        valid = ends[base : base + n] - place >= length
        first = valid & np.append(True, (gram[1:] != gram[:-1]) | ~valid[:-1])
        start = np.flatnonzero(first)
        total = np.append(0, np.cumsum(valid))
        count = total[np.append(start[1:], n)] - total[start]
        yield base + start, count, base + gram[start], hashes[gram[start]]


_RUN = "k1 long, k2 long, doc_id long, start long, count int, gram int, h long, c long"


def _text_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            keys = [np.array(batch.column(k), np.int64) for k in ("k1", "k2")]
            row = 0
            while row < len(text):  # texts of about a piece at once
                last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
                last = min(last, len(text))
                edges = offsets[row : last + 1] - offsets[row]
                here = data[offsets[row] : offsets[last]]
                ends = np.repeat(edges[1:], np.diff(edges))
                view = memoryview(here)
                for start, count, gram, h in window_runs(here, ends, length):
                    at = np.searchsorted(edges, start, side="right") - 1
                    stops = (start + count + length - 1).tolist()
                    c = _signed([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), stops)])
                    ids = batch.column("doc_id").take(pa.array(row + at))
                    yield _records(
                        [keys[0][row + at], keys[1][row + at], ids, start - edges[at], count, gram - start,
                         h.view(np.int64), c], _RUN,
                    )
                row = last

    return run


_STRETCH = "h long, c long, n long, gram int, content binary"


def _cut_stretches(length: int):
    """The stretches asked of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                wanted = batch.column("wanted")[i].as_py()
                rows = [
                    (w["h"], w["c"], w["n"], w["gram"], text[w["start"] : w["start"] + w["count"] + length - 1])
                    for w in wanted
                ]
                yield _records(list(zip(*rows)), _STRETCH)

    return run


_SPAN = "h long, c long, first long, last long"


def sharing(rows: dict[tuple, tuple], length: int) -> dict[tuple, tuple]:
    """The stretches that occur twice or may share a window with another one of their gram.

    ``rows`` holds n, content and place of the gram by (h, c). A window that starts from
    ``at`` to ``at + step - 1`` bytes before the gram has all bytes from ``at`` before the
    gram up to ``length - step`` bytes on.
    """
    rest = length - GRAM
    step = max(1, rest // PIECES)
    sides = [(at, max(GRAM, length - step - at)) for at in range(0, rest + 1, step)]
    seen: dict[tuple, tuple] = {}
    keep = {key for key, row in rows.items() if row[0] > 1}
    for key, (_, content, gram) in rows.items():
        for before, after in sides:
            if before <= gram and gram + after <= len(content):
                piece = key[0], before, content[gram - before : gram + after]
                other = seen.setdefault(piece, key)
                if other is not key:
                    keep.add(key)
                    keep.add(other)
    return {key: row for key, row in rows.items() if key in keep}


def _repeated_windows(length: int):
    """Runs of repeated windows (``first`` to before ``last``) in the stretches of a part."""

    def sort(rows: dict[tuple, tuple]) -> pa.RecordBatch:
        content = [r[1] for r in rows.values()]
        together = Collection(content + [r[1] for r in rows.values() if r[0] > 1])
        place = np.flatnonzero(repeated_starts(together, length))
        starts = together.starts[: len(content)]
        place = place[: np.searchsorted(place, together.ends[len(content) - 1])]
        own = np.searchsorted(starts, place, side="right") - 1
        first = np.append(True, np.diff(place) > 1)[: len(place)]
        last = np.append(np.diff(place) > 1, True)[: len(place)]
        keys = np.array(list(rows), np.int64).reshape(-1, 2)[own[first]]
        return _records([keys[:, 0], keys[:, 1], (place - starts[own])[first], (place - starts[own])[last] + 1], _SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, some, part = {}, 0, {}, None
        for batch in batches:
            for h, c, n, gram, content in zip(*[batch.column(k).to_pylist() for k in ("h", "c", "n", "gram", "content")]):
                if h != part:
                    some = sharing(some, length)
                    size += sum(len(r[1]) * (2 if r[0] > 1 else 1) for r in some.values())
                    rows.update(some)
                    some, part = {}, h
                    if size >= PIECE:
                        yield sort(rows)
                        rows, size = {}, 0
                if (h, c) not in some:
                    some[h, c] = n, content, gram
        rows.update(sharing(some, length))
        if rows:
            yield sort(rows)

    return run


_BLOCK = _STRETCH + ", parent_h long, parent_c long, at long"


def _split_stretches(length: int, block: int):
    """The windows of crowded stretches, in blocks by their distance to the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, c, n, gram, content in zip(*[batch.column(k).to_pylist() for k in ("h", "c", "n", "gram", "content")]):
                windows = len(content) - length + 1
                for b in range((gram - windows + 1) // block, gram // block + 1):
                    first = max(0, gram - b * block - block + 1)
                    last = min(windows - 1, gram - b * block)
                    shared = content[gram - b * block : gram - b * block - block + 1 + length]
                    part = content[first : last + length]
                    seed = (h * 31 + b) % (1 << 64)
                    hashes = _signed([xxhash.xxh3_64_intdigest(shared, seed), xxhash.xxh3_64_intdigest(part)])
                    out.append((*hashes.tolist(), n, gram - first, part, h, c, first))
                if len(out) > 2000:
                    yield _records(list(zip(*out)), _BLOCK)
                    out = []
            if out:
                yield _records(list(zip(*out)), _BLOCK)

    return run


def repeated_in(stretches: DataFrame, length: int, crowd: int = CROWD, blocks: Sequence[int] = BLOCKS) -> DataFrame:
    """h, c, first, last: runs of repeated windows in different ``stretches`` (one row per h, c)."""
    crowded = stretches.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("h")
    calm, found = stretches, None
    if blocks and not crowded.isEmpty():
        crowded = materialize(crowded, "repeats-crowded")
        calm = stretches.join(crowded, "h", "left_anti")
        parts = stretches.join(crowded, "h", "left_semi").mapInArrow(_split_stretches(length, blocks[0]), _BLOCK)
        parts = materialize(parts, "repeats-blocks")
        sums = parts.groupBy("h", "c").agg(
            F.sum("n").alias("n"), F.min("gram").alias("gram"), F.min("content").alias("content")
        )
        sums = materialize(sums, "repeats-block-classes")
        often = sums.groupBy("h").agg(F.sum("n").alias("m")).where("m > 1").select("h")
        deeper = repeated_in(materialize(sums.join(often, "h"), "repeats-deeper"), length, crowd, blocks[1:])
        found = parts.select("h", "c", "parent_h", "parent_c", "at").join(deeper, ["h", "c"]).select(
            F.col("parent_h").alias("h"), F.col("parent_c").alias("c"),
            (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"),
        )
    spark = stretches.sparkSession
    total = stretches.agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * PIECE)))
    dealt = calm.repartition(parts, "h").sortWithinPartitions("h", "c")
    out = dealt.mapInArrow(_repeated_windows(length), _SPAN)
    return out if found is None else out.unionByName(found)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the two hashes that stand for the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per different text with repeats: k1, k2, doc_id (one row that has it) and ``covers``,
    the stretches of bytes (first, last) to remove, in no order and overlapping."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = keyed(docs)
    runs = texts.where(F.octet_length("text") >= length).mapInArrow(_text_runs(length), _RUN)
    runs = materialize(runs, "repeats-runs")
    often = runs.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    kept = materialize(sifted(runs, sieve(often, "h"), "h"), "repeats-kept")
    row = F.struct("k1", "k2", "doc_id", "start", "count", "gram")
    classes = kept.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("one"))
    classes = materialize(classes, "repeats-classes")
    often = classes.groupBy("h").agg(F.sum("n").alias("m")).where("m > 1").select("h")
    wanted = classes.join(often, "h").groupBy("one.k1", "one.k2", "one.doc_id").agg(
        F.collect_list(F.struct("h", "c", "n", "one.gram", "one.start", "one.count")).alias("wanted")
    )
    wanted = materialize(wanted, "repeats-wanted")
    stretches = _beside_texts(texts, wanted).mapInArrow(_cut_stretches(length), _STRETCH)
    # Rows that repeat a document cut the same stretches; the task that sorts them keeps one.
    found = repeated_in(materialize(stretches, "repeats-stretches"), length)
    found = materialize(found, "repeats-found")
    places = kept.groupBy("k1", "k2", "start", "h", "c").agg(F.min("doc_id").alias("doc_id"))
    cover = F.struct(
        (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") - 1 + length).alias("last")
    )
    return places.join(found, ["h", "c"]).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.collect_list(cover).alias("covers")
    )


def _beside_texts(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that ``lists`` (k1, k2, doc_id and a list) name, each beside its list."""
    some = sifted(texts, sieve(lists, "k1", "k2", "doc_id"), "k1", "k2", "doc_id")
    lists = lists.withColumnsRenamed({"k1": "_k1", "k2": "_k2", "doc_id": "_id"})
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return some.join(lists, same).drop("_k1", "_k2", "_id")


_CUT = "k1 long, k2 long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _remove(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                covers = batch.column("covers")[i].values.flatten()
                first, last = (np.array(v) for v in covers)
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order])
                fresh = np.append(True, first[1:] > reach[:-1])
                first, last = first[fresh], reach[np.append(fresh[1:], True)]
                kept = b"".join(text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)]))
                digest = hashlib.sha256(kept).hexdigest()
                yield _records(
                    [[batch.column("k1")[i].as_py()], [batch.column("k2")[i].as_py()], [int((last - first).sum())],
                     [len(first)], [None if digests else kept], [digest]], _CUT,
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes, may be cut inside a character)
    and kept_sha256 of every row; with ``digests`` kept is left out."""
    texts = keyed(docs)
    spans = materialize(repeated_spans(docs, length), "repeats-spans")
    cut = _beside_texts(texts, spans.select("k1", "k2", "doc_id", "covers")).mapInArrow(_remove(digests), _CUT)
    cut = cut.groupBy("k1", "k2").agg(*[F.first(c).alias(f"_{c}") for c in ("n_removed", "n_spans", "kept", "kept_sha256")])
    whole = texts.select(
        "doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("_sha256"),
        *([] if digests else [F.col("text").cast("binary").alias("_whole")]),
    )
    joined = whole.join(cut, ["k1", "k2"], "left")
    kept = [] if digests else [F.when(F.col("_n_spans").isNull(), F.col("_whole")).otherwise(F.col("_kept")).alias("kept")]
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("_n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_n_spans", F.lit(0)).cast("long").alias("n_spans"), *kept,
        F.coalesce("_kept_sha256", "_sha256").alias("kept_sha256"),
    )
