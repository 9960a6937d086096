"""Chat formatting by perspective rotation.

Every participant of a dialogue becomes the assistant once: its turns are rendered as
assistant turns and masked as training targets, all other speakers as named users;
system turns stay what they are. Built-in functions only.

A dialogue is rendered in chunks of turn numbers, so that a very long one is never one
row or one task; ``text_start`` tells where a chunk begins in the whole rendering.
Masks are (start, length) in code points of the chunk, over the speaker's words and
the end mark.

Edge cases: a null text is empty; a null speaker is an unnamed user and takes no
perspective; null turns come first, in chunk -1; turns with one number are ordered by
speaker and text; repeated rows are repeated turns; null conversation ids form one
dialogue; a dialogue of system turns alone has no perspective; marks inside a text
are broken up so that they cannot open a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.llm.common import bucket_starts

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
CHUNK = 64


def safe(text: Column) -> Column:
    """A text that cannot contain a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def header(speaker: Column, perspective: Column) -> Column:
    name = F.regexp_replace(speaker, r"[^\p{L}\p{N}_-]+", "_")
    return (
        F.when(speaker == perspective, F.lit(f"{OPEN}assistant\n"))
        .when(speaker == SYSTEM, F.lit(f"{OPEN}system\n"))
        .when(speaker.isNull(), F.lit(f"{OPEN}user\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    )


def rotate(turns: DataFrame, chunk_turns: int = CHUNK) -> DataFrame:
    """One row per dialogue, perspective and chunk: conv_id, perspective, chunk,
    n_turns, text, masks (array of start, length), text_start."""
    rows = turns.select(
        "conv_id", "turn", F.col("role").alias("speaker"), "text",
        F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-1)).cast("long").alias("chunk"),
    )
    people = (
        rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM))
        .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    )
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    start, body = header(F.col("speaker"), F.col("perspective")), F.concat(safe(F.col("text")), F.lit(CLOSE))
    seen = seen.select(
        "conv_id", "perspective", "chunk", "turn", "speaker", F.concat(start, body).alias("part"),
        F.length(start).alias("head"), (F.col("speaker") == F.col("perspective")).alias("own"),
    )
    group = ["conv_id", "perspective", "chunk"]
    before = Window.partitionBy(*group).orderBy("turn", "speaker", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    mask = F.when(
        F.col("own"),
        F.struct((F.col("at") + F.col("head")).cast("long").alias("start"), (F.length("part") - F.col("head")).cast("long").alias("length")),
    )
    chunks = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "part"))).alias("parts"),
        F.array_sort(F.collect_list(mask)).alias("masks"),
    )
    chunks = chunks.select(
        *group, "n_turns", F.array_join(F.array_sort(F.col("parts"), _turn_order)["part"], "").alias("text"), "masks"
    )
    lengths = bucket_starts(seen, ["conv_id", "perspective"], "chunk", {"text_start": F.length("part")})
    lengths = lengths.select(*[F.col(c).alias(f"_{c}") for c in group], "text_start")
    return chunks.join(lengths, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]).select(
        *group, "n_turns", "text", "masks", "text_start"
    )


def _turn_order(a: Column, b: Column) -> Column:
    """Nulls first, as in a window; ``array_sort`` alone puts them last."""
    out = F.lit(0)
    for name in ("part", "speaker", "turn"):
        x, y = a[name], b[name]
        out = (
            F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1)
            .when(x < y, -1).when(x > y, 1).otherwise(out)
        )
    return out
