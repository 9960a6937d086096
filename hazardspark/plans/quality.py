"""Cleaning and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import quality
from hazardspark.plans.registry import query
from hazardspark.session import new_path

ISNUM = r"regexp_full_match({0}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"
LAT = f"CASE WHEN {ISNUM.format('latitude')} THEN CAST(latitude AS DOUBLE) END"
LON = f"CASE WHEN {ISNUM.format('longitude')} THEN CAST(longitude AS DOUBLE) END"
TYPED = f"typed AS (SELECT district, material, {LAT} AS latitude, {LON} AS longitude FROM fx_raw_points)"
OK = "coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, FALSE)"
SOME = "(district IS NOT NULL OR material IS NOT NULL OR latitude IS NOT NULL OR longitude IS NOT NULL)"


@query("b1_standardize_columns", "", "SELECT c_custkey AS sl_no, c_name AS slide_name, c_mktsegment AS material_involved, c_acctbal AS acct_bal FROM customer")
def b1(t):
    raw = t.customer.select(
        F.col("c_custkey").alias(" Sl.No."), F.col("c_name").alias("Slide\n Name"),
        F.col("c_mktsegment").alias("Material  Involved"), F.col("c_acctbal").alias("Acct.Bal"))
    return quality.standardize_columns(raw)


@query("b2_filter_region", "fx_points", "SELECT * FROM fx_points WHERE lower(trim(district)) = 'nation_3'")
def b2(t):
    return quality.filter_region(t.fx_points, "district", " Nation_3 ")


@query("b3_normalize_text", "", r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ') AS text,
  CASE WHEN lang = 'de' THEN 'None' WHEN lang = 'fr' THEN ' nan ' WHEN lang = 'es' THEN NULL ELSE lang END AS lang FROM documents)
SELECT doc_id, CASE WHEN text IN ('None', 'nan') THEN '' ELSE text END AS text,
  CASE WHEN trim(coalesce(lang, '')) IN ('None', 'nan') THEN '' ELSE coalesce(lang, '') END AS lang FROM n""")
def b3(t):
    lang = F.col("lang")
    shown = F.when(lang == "de", "None").when(lang == "fr", " nan ").when(lang == "es", F.lit(None)).otherwise(lang)
    return quality.normalize_text(t.documents.select("doc_id", "text", shown.alias("lang")))


@query("b4_drop_all_null", "fx_raw_points", f"SELECT * FROM fx_raw_points WHERE {SOME}")
def b4(t):
    return quality.drop_all_null(t.fx_raw_points)


@query("b5_drop_exact_duplicates", "", "SELECT DISTINCT text, lang, source FROM documents")
def b5(t):
    return quality.drop_exact_duplicates(t.documents.select("text", "lang", "source"))


@query("b6_valid_coords", "fx_raw_points", f", {TYPED} SELECT * FROM typed WHERE {OK}")
def b6(t):
    return quality.valid_coords(t.fx_raw_points)


CLEANING = f"""
, kept AS (SELECT * FROM fx_raw_points WHERE {SOME}), uniq AS (SELECT DISTINCT * FROM kept)
, typed AS (SELECT {LAT} AS latitude, {LON} AS longitude FROM uniq)
SELECT (SELECT count(*) FROM fx_raw_points) AS input_rows, (SELECT count(*) FROM kept) AS after_drop,
  (SELECT count(*) FROM uniq) AS after_dedup, (SELECT count(*) FROM typed WHERE NOT {OK}) AS invalid_coords,
  (SELECT count(*) FROM typed WHERE {OK}) AS clean_rows"""


@query("b7_cleaning_report", "fx_raw_points", CLEANING)
def b7(t):
    return quality.cleaning_report(t.fx_raw_points)


@query("b7_observed_report", "fx_raw_points", CLEANING)
def b7_observed(t):
    """The same counts, observed while the clean rows are written."""
    return quality.clean_to(t.fx_raw_points, new_path(t.spark, "clean"))


@query("b6_clean_rows", "fx_raw_points", f"""
, uniq AS (SELECT DISTINCT * FROM fx_raw_points WHERE {SOME})
, typed AS (SELECT district, material, {LAT} AS latitude, {LON} AS longitude FROM uniq) SELECT * FROM typed WHERE {OK}""")
def b6_clean(t):
    """The rows that the write leaves."""
    path = new_path(t.spark, "clean")
    quality.clean_to(t.fx_raw_points, path)
    return t.spark.read.parquet(path)


@query("b8_missing_profile", "fx_raw_points", " , x AS (SELECT 1) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM fx_raw_points"
    for c in ("district", "material", "latitude", "longitude")))
def b8(t):
    return quality.missing_profile(t.fx_raw_points)


@query("b9_duplicate_count", "fx_points", """
SELECT 'coordinates' AS over, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM fx_points GROUP BY latitude, longitude)
UNION ALL SELECT 'text', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def b9(t):
    pts = quality.duplicate_count(t.fx_points, ["latitude", "longitude"])
    docs = quality.duplicate_count(t.documents, ["text"])
    return pts.select(F.lit("coordinates").alias("over"), "duplicates").unionByName(
        docs.select(F.lit("text").alias("over"), "duplicates"))


@query("b10_detect_roles", "fx_points", """
SELECT count(*) FILTER (WHERE latitude BETWEEN 20 AND 35 AND longitude BETWEEN 70 AND 98) AS rows_in_range,
  'a' AS latitude, 'b' AS longitude, 'event_year' AS date, 'movement_kind' AS type FROM fx_points""")
def b10(t):
    pts = t.fx_points.select(F.col("latitude").alias("a"), F.col("longitude").alias("b"),
                             F.lit(2000).alias("event_year"), F.col("material").alias("movement_kind"))
    roles = quality.detect_roles(pts)
    inside = F.col(roles["latitude"][0]).between(*quality.LAT_RANGE) & F.col(roles["longitude"][0]).between(*quality.LON_RANGE)
    return pts.agg(F.count_if(inside).alias("rows_in_range"), *[F.lit(",".join(v)).alias(k) for k, v in roles.items()])


@query("b11_value_counts", "fx_raw_points", """
SELECT CASE WHEN material IS NULL OR trim(material) = '' THEN 'Unspecified' ELSE material END AS value, count(*) AS n
FROM fx_raw_points GROUP BY 1""")
def b11(t):
    return quality.value_counts(t.fx_raw_points, "material")


@query("b12_coord_summary", "fx_raw_points", f", {TYPED}" + f"""
SELECT count(*) FILTER (WHERE {OK}) AS valid, count(*) FILTER (WHERE NOT {OK}) AS invalid,
  min(latitude) FILTER (WHERE {OK}) AS lat_min, max(latitude) FILTER (WHERE {OK}) AS lat_max,
  min(longitude) FILTER (WHERE {OK}) AS lon_min, max(longitude) FILTER (WHERE {OK}) AS lon_max FROM typed""")
def b12(t):
    return quality.coord_summary(t.fx_raw_points)


def _stats_sql(std):
    return " , x AS (SELECT 1) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 8) AS mean,
  round({std}({c}), 8) AS std, count(*) - count({c}) AS missing FROM fx_soil""" for c in ("clay", "sand", "silt", "bulk_density"))


def _stats(t, ddof):
    out = quality.column_stats(t.fx_soil, ["clay", "sand", "silt", "bulk_density"], ddof)
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query("b13_column_stats_sample", "fx_soil", _stats_sql("stddev_samp"))
def b13(t):
    return _stats(t, 1)


@query("b13_column_stats_population", "fx_soil", _stats_sql("stddev_pop"))
def b13_pop(t):
    return _stats(t, 0)


@query("b14_component_balance", "fx_soil", """
SELECT min(clay + sand + silt) AS sum_min, max(clay + sand + silt) AS sum_max, round(avg(clay + sand + silt), 8) AS sum_mean,
  count(*) FILTER (WHERE abs(clay + sand + silt - 1000) > 10) AS off_by_over_1pct FROM fx_soil""")
def b14(t):
    out = quality.component_balance(t.fx_soil, ["clay", "sand", "silt"], 1000.0)
    return out.withColumn("sum_mean", F.round("sum_mean", 8))


@query("b15_enrichment_check", "fx_points fx_soil", """
, a AS (SELECT p.*, CASE WHEN s.clay < 350 THEN s.clay END AS clay FROM fx_points p JOIN fx_soil s ON s.sl_no = p.sl_no WHERE s.bulk_density < 158)
SELECT (SELECT count(*) FROM fx_points) AS rows_before, (SELECT count(*) FROM a) AS rows_after,
  (SELECT count(*) FROM fx_points WHERE sl_no NOT IN (SELECT sl_no FROM a)) AS keys_lost,
  (SELECT count(*) FROM fx_points) = (SELECT count(*) FROM a) AS rows_kept,
  (SELECT count(*) FROM a WHERE clay IS NULL) AS missing_clay""")
def b15(t):
    soil = t.fx_soil.where(F.col("bulk_density") < 158).select("sl_no", F.when(F.col("clay") < 350, F.col("clay")).alias("clay"))
    return quality.enrichment_check(t.fx_points, t.fx_points.join(soil, "sl_no"), "sl_no")


@query("b16_to_physical_units", "fx_soil", """
SELECT sl_no, clay / 10e0 AS clay, sand / 10e0 AS sand, silt / 10e0 AS silt, bulk_density / 100e0 AS bulk_density FROM fx_soil""")
def b16(t):
    return quality.to_physical_units(t.fx_soil, {"clay": 10, "sand": 10, "silt": 10, "bulk_density": 100})
