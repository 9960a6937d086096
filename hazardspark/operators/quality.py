"""Cleaning and data-quality operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from hazardspark.functions.numeric import nan_to_null, rounded
from hazardspark.operators.ordering import side_by_side

# fixed values: header spellings of the inventory
COLUMN_ALIASES = {
    "sl.no.": "sl_no",
    "sl.no": "sl_no",
    "material involved": "material_involved",
    "movement type": "movement_type",
}
# White space as Unicode sees it, spelled so that both regex engines agree.
SPACE_RUN = r"[\s\x0B\x85\p{Z}]+"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(value: Column) -> Column:
    """Text to double; anything that is not a plain finite number is NULL."""
    text = value.cast("string")
    return nan_to_null(F.when(text.rlike(_NUMBER), text.try_cast("double")))


def standardize_columns(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    def name(raw: str) -> str:
        norm = re.sub(r"\s+", " ", raw.strip().lower())
        return aliases.get(norm, re.sub(r"[ .]", "_", norm))

    return df.toDF(*[name(c) for c in df.columns])


def filter_region(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.lower(F.trim(F.col(col))) == value.strip().lower())


def normalize_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Collapse white space; missing text and its printed forms become ''."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def clean(c: str) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), SPACE_RUN, " "))
        return F.when(text.isin("None", "nan"), F.lit("")).otherwise(text)

    return df.withColumns({c: clean(c) for c in cols})


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _coords_ok(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def valid_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    typed = df.withColumns({lat: to_number(F.col(lat)), lon: to_number(F.col(lon))})
    return typed.where(_coords_ok(F.col(lat), F.col(lon)))


def _stages(df: DataFrame, lat: str, lon: str) -> tuple[DataFrame, dict[str, Column]]:
    """Distinct rows with ``_n`` copies and ``_some``, typed coordinates, and the counts of all cleaning stages."""
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in df.columns])
    each = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).withColumn("_some", some)
    typed = each.withColumns({lat: to_number(F.col(lat)), lon: to_number(F.col(lon))})
    ok = _coords_ok(F.col(lat), F.col(lon))
    zero = F.lit(0)
    return typed, {
        "input_rows": F.coalesce(F.sum("_n"), zero),
        "after_drop": F.coalesce(F.sum(F.when(F.col("_some"), F.col("_n"))), zero),
        "after_dedup": F.count_if(F.col("_some")),
        "invalid_coords": F.count_if(F.col("_some") & ~ok),
        "clean_rows": F.count_if(F.col("_some") & ok),
    }


def cleaning_report(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Row counts of all cleaning stages from one pass over distinct rows."""
    typed, counts = _stages(df, lat, lon)
    return typed.agg(*[count.alias(name) for name, count in counts.items()])


def clean_to(df: DataFrame, path: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Write the clean rows to ``path`` and return the report of :func:`cleaning_report`.

    Clean rows are the distinct rows that are not all NULL and whose coordinates are
    valid numbers. The counts are observed while the rows are written, so the report
    takes no job of its own. They are taken behind the only shuffle, in the tasks that
    write: a lost executor repeats work before it, which counts nothing.
    """
    typed, counts = _stages(df, lat, lon)
    seen = Observation()
    typed = typed.observe(seen, *[count.alias(name) for name, count in counts.items()])
    typed.where(F.col("_some") & _coords_ok(F.col(lat), F.col(lon))).drop("_n", "_some").write.parquet(path)
    return df.sparkSession.createDataFrame([tuple(seen.get[name] for name in counts)], ", ".join(f"{name} bigint" for name in counts))


def missing_profile(df: DataFrame) -> DataFrame:
    """NULLs per column, from one aggregate."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing"))
        for c in df.columns])
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows after the first of each repeated key."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


# fixed values: name tokens of column roles
LAT_TOKENS = ("lat", "latitude", "y")
LON_TOKENS = ("lon", "long", "longitude", "x")
DATE_TOKENS = ("date", "year", "history", "time", "occurred")
TYPE_TOKENS = ("type", "movement", "material", "failure", "class", "category")
LAT_RANGE = (20, 35)
LON_RANGE = (70, 98)


def detect_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns that look like latitude, longitude, date or type.

    Names decide; only if a coordinate has no such name is the data looked at,
    with one aggregate over the numeric columns.
    """
    def by_token(name: str, tokens: tuple[str, ...]) -> bool:
        return any(t in re.split("_", name) for t in tokens)

    names = {c: c.lower().strip() for c in df.columns}
    lat = [c for c, n in names.items() if by_token(n, LAT_TOKENS) or ("lat" in n and "relat" not in n)]
    lon = [c for c, n in names.items() if by_token(n, LON_TOKENS) or "lon" in n]
    if not lat or not lon:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        if numeric:
            probe = df.agg(*[
                F.bool_and(F.col(f"`{c}`").between(*bounds)).alias(f"{kind}:{c}")
                for c in numeric for kind, bounds in (("lat", LAT_RANGE), ("lon", LON_RANGE))
            ]).first()
            lat = lat or [c for c in numeric if probe[f"lat:{c}"]][:1]
            lon = lon or [c for c in numeric if probe[f"lon:{c}"]][:1]
    return {
        "latitude": lat,
        "longitude": lon,
        "date": [c for c, n in names.items() if any(t in n for t in DATE_TOKENS)],
        "type": [c for c, n in names.items() if any(t in n for t in TYPE_TOKENS)],
    }


def value_counts(df: DataFrame, col: str, blank: str = "Unspecified") -> DataFrame:
    text = F.col(col).cast("string")
    shown = F.when(text.isNull() | (F.trim(text) == ""), F.lit(blank)).otherwise(text)
    counts = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def coord_summary(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    la, lo = to_number(F.col(lat)), to_number(F.col(lon))
    ok = _coords_ok(la, lo)
    return df.agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"),
        F.min(F.when(ok, la)).alias("lat_min"), F.max(F.when(ok, la)).alias("lat_max"),
        F.min(F.when(ok, lo)).alias("lon_min"), F.max(F.when(ok, lo)).alias("lon_max"))


def column_stats(df: DataFrame, cols: list[str], ddof: int = 1, digits: int | None = None) -> DataFrame:
    """min, max, mean, standard deviation and missing count, one row per column."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    rows = []
    for c in cols:
        v = F.col(c).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column_name"), rounded(F.min(v), digits).alias("min"),
            rounded(F.max(v), digits).alias("max"), rounded(F.avg(v), digits).alias("mean"),
            rounded(std(v), digits).alias("std"), F.count_if(v.isNull()).alias("missing")))
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def component_balance(df: DataFrame, cols: list[str], target: float) -> DataFrame:
    """min, max and mean of a row-wise sum against its target."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return df.agg(
        F.min(total).alias("sum_min"), F.max(total).alias("sum_max"), F.avg(total).alias("sum_mean"),
        F.count_if(F.abs(total - F.lit(target)) > F.lit(0.01 * target)).alias("off_by_over_1pct"))


def enrichment_check(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row count and keys kept, and the gaps of every added column."""
    added = [c for c in after.columns if c not in before.columns]
    counts = before.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    per_key = counts.groupBy(key).agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    kept = per_key.agg(
        F.sum("_b").alias("rows_before"), F.sum("_a").alias("rows_after"),
        F.count_if((F.col("_b") > 0) & (F.col("_a") == 0)).alias("keys_lost"))
    gaps = after.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in added])
    kept = kept.select("*", (F.col("rows_before") == F.col("rows_after")).alias("rows_kept"))
    return side_by_side(kept, gaps)


def to_physical_units(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Stored integers to physical units by dividing with the layer factor."""
    return df.withColumns({c: F.col(c).cast("double") / F.lit(float(f)) for c, f in factors.items()})
