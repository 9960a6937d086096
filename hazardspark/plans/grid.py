"""Adaptive grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.functions.tiers import susceptibility_tier
from hazardspark.operators import grid, spatial
from hazardspark.params import MICRO_TIERS, TIER_ORDER, Box
from hazardspark.plans import sqltext as q
from hazardspark.plans.registry import query
from hazardspark.plans.tables import cells_meta

STEP = 0.008  # half a fixture cell in longitude
MESH = """
, size AS (SELECT max(r) + 1 AS h FROM fx_cells)
, mesh AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 27.83::DOUBLE - h * 0.02::DOUBLE + 0.005::DOUBLE + i * 0.008::DOUBLE AS latitude,
    88.054::DOUBLE + j * 0.008::DOUBLE AS longitude FROM size, (SELECT unnest(range(0, CAST(floor(h * 2.5) AS BIGINT))) AS i FROM size) a,
    (SELECT unnest(range(0, 100)) AS j) b)
, land AS (SELECT m.*, k.z AS elevation FROM mesh m JOIN fx_cells k ON k.r = floor((27.83::DOUBLE - m.latitude) / 0.02::DOUBLE)
    AND k.c = floor((m.longitude - 88.05::DOUBLE) / 0.016::DOUBLE) WHERE k.z > 0)
"""


def mesh(t):
    meta = cells_meta(t)
    south = 27.83 - meta.height * 0.02 + 0.005
    return grid.make_grid(t.spark, south, 88.054, STEP, int(meta.height * 2.5), 100)


def land(t):
    sampled = spatial.sample_containing(mesh(t), t.fx_cells, cells_meta(t), ["z"])
    return grid.terrestrial(sampled.withColumnRenamed("z", "elevation"))


@query("g1_make_grid", "fx_cells", MESH + "SELECT i, j, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude FROM mesh")
def g1(t):
    return mesh(t).withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


@query("g2_terrestrial", "fx_cells", MESH + "SELECT i, j, elevation FROM land")
def g2(t):
    return land(t).select("i", "j", "elevation")


@query("g3_cell_ids", "fx_cells", MESH + "SELECT i, j, printf('COARSE_C%05d', row_number() OVER (ORDER BY i, j)) AS cell_id FROM land")
def g3(t):
    return grid.cell_ids(land(t), ["i", "j"]).select("i", "j", "cell_id")


# coarse cells of the scored fixture, 200 to a row
COARSE = f"""
, coarse AS (SELECT printf('COARSE_C%05d', cell_id + 1) AS cell_id, CAST(27180000 + (cell_id // 200) * 1000 AS DOUBLE) / 1e6 AS latitude,
    CAST(88580000 + (cell_id % 200) * 1000 AS DOUBLE) / 1e6 AS longitude, s AS p, slope FROM fx_scored)
, flagged AS (SELECT *, p >= 0.7::DOUBLE OR (p >= 0.5::DOUBLE AND slope >= 30) AS needs_refinement,
    {q.tier('p', (0.70, 0.50, 0.35), 'NULL')} AS risk_tier FROM coarse)
"""
PILOT = Box(27.25, 27.27, 88.71, 88.73)
WIDE = Box(27.18, 27.20, 88.60, 88.70)


def coarse(t):
    n = F.col("cell_id")
    cells = t.fx_scored.select(
        F.format_string("COARSE_C%05d", n + 1).alias("cell_id"),
        ((F.lit(27180000) + F.floor(n / 200) * 1000).cast("double") / 1e6).alias("latitude"),
        ((F.lit(88580000) + n % 200 * 1000).cast("double") / 1e6).alias("longitude"), F.col("s").alias("p"), "slope")
    return grid.classify_cells(cells)


@query("g4_susceptibility_tier", "fx_scored", COARSE + "SELECT cell_id, risk_tier FROM flagged")
def g4(t):
    return coarse(t).select("cell_id", susceptibility_tier(F.col("p")).alias("risk_tier"))


@query("g5_needs_refinement", "fx_scored", COARSE + "SELECT cell_id, needs_refinement FROM flagged")
def g5(t):
    return coarse(t).select("cell_id", "needs_refinement")


@query("g5_refinement_share", "fx_scored", COARSE + """
SELECT count(*) AS cells, count(*) FILTER (WHERE needs_refinement) AS flagged, round(count(*) FILTER (WHERE needs_refinement) * 100e0 / count(*), 9) AS pct_flagged FROM flagged""")
def g5_share(t):
    return grid.refinement_share(coarse(t)).withColumn("pct_flagged", F.round("pct_flagged", 9))


def _focal(box: Box) -> str:
    inside = (f"latitude BETWEEN {box.lat_min}::DOUBLE AND {box.lat_max}::DOUBLE AND longitude BETWEEN {box.lon_min}::DOUBLE AND {box.lon_max}::DOUBLE")
    return COARSE + f"""
, inside AS (SELECT * FROM flagged WHERE needs_refinement AND {inside})
, focal AS (SELECT * FROM inside WHERE (SELECT count(*) FROM inside) >= 50
    UNION ALL SELECT * FROM (SELECT * FROM flagged WHERE needs_refinement ORDER BY p DESC, cell_id LIMIT 100) f WHERE (SELECT count(*) FROM inside) < 50)
"""


@query("g6_focal_parents_box", "fx_scored", _focal(WIDE) + "SELECT cell_id FROM focal")
def g6_box(t):
    return grid.focal_parents(coarse(t), WIDE).select("cell_id")


@query("g6_focal_parents_fallback", "fx_scored", _focal(PILOT) + "SELECT cell_id FROM focal")
def g6_fallback(t):
    return grid.focal_parents(coarse(t), PILOT).select("cell_id")


CHILDREN = """
, kids AS (SELECT printf('FINE_%s_%03d', split_part(cell_id, '_', 2), k + 1) AS fine_cell_id, cell_id AS parent_cell_id, latitude AS parent_latitude,
    longitude AS parent_longitude, round_even(p, 4) AS parent_susceptibility, round(latitude + (-0.00045::DOUBLE + (k // 10) * 0.0001::DOUBLE), 6) AS latitude,
    round(longitude + (-0.00045::DOUBLE + (k % 10) * 0.0001::DOUBLE), 6) AS longitude
  FROM {src} CROSS JOIN (SELECT unnest(range(0, 100)) AS k) x)
"""


def near(df):
    """Coordinates to five digits: the sixth is a tie by construction."""
    return df.withColumns({c: F.round(F.col(c) + 1e-8, 5) for c in ("latitude", "longitude")})


NEAR = "round(latitude + 1e-8, 5) AS latitude, round(longitude + 1e-8, 5) AS longitude"


@query("g7_subdivide", "fx_scored", COARSE + CHILDREN.format(src="(SELECT * FROM flagged WHERE needs_refinement) f") + f"""
SELECT fine_cell_id, parent_cell_id, parent_susceptibility, {NEAR} FROM kids""")
def g7(t):
    kids = grid.subdivide(coarse(t).where("needs_refinement"))
    return near(kids).select("fine_cell_id", "parent_cell_id", "parent_susceptibility", "latitude", "longitude")


# a stand-in for the model score of a child cell
CHILD_P = "CAST(abs(CAST(substr(fine_cell_id, -3) AS INTEGER) * 37 + CAST(round(parent_susceptibility * 1000) AS INTEGER)) % 1000 AS DOUBLE) / 1000e0"
SCORED = ", scored AS (SELECT *, " + CHILD_P + " AS p FROM kids)"
MICRO = "CASE WHEN p >= 0.8::DOUBLE THEN 'Extreme' WHEN p >= 0.7::DOUBLE THEN 'Very High' WHEN p >= 0.5::DOUBLE THEN 'High' WHEN p >= 0.35::DOUBLE THEN 'Moderate' ELSE 'Low' END"


def refined(t, box=WIDE):
    kids = grid.subdivide(grid.focal_parents(coarse(t), box))
    number = F.substring("fine_cell_id", -3, 3).cast("int")
    p = (F.abs(number * 37 + F.round(F.col("parent_susceptibility") * 1000).cast("int")) % 1000).cast("double") / 1000.0
    return grid.refine(kids.withColumn("p", p))


@query("g8_refine", "fx_scored", _focal(WIDE) + CHILDREN.format(src="focal") + SCORED + f"""
SELECT fine_cell_id, parent_cell_id, parent_susceptibility, round(p, 4) AS fine_susceptibility,
  {q.even('p - parent_susceptibility', 4)} AS risk_delta, {MICRO} AS micro_risk_tier FROM scored""")
def g8(t):
    return refined(t).select("fine_cell_id", "parent_cell_id", "parent_susceptibility", "fine_susceptibility",
                             "risk_delta", "micro_risk_tier")


def _summary(p, tier, tiers):
    counts = ", ".join(f"count(*) FILTER (WHERE {tier} = '{x}') AS {x.lower().replace(' ', '_')}" for x in tiers)
    return (f"SELECT count(*) AS cells, round(min({p}), 8) AS min_p, round(max({p}), 8) AS max_p, round(avg({p}), 8) AS mean_p, "
            f"round(stddev_pop({p}), 8) AS std_p, {counts} ")


FINE_TIERS = ("Low", *[n for n, _ in reversed(MICRO_TIERS)])
STATS = ("min_p", "max_p", "mean_p", "std_p")


@query("g9_grid_summary_coarse", "fx_scored", COARSE + _summary("p", "risk_tier", TIER_ORDER) + "FROM flagged")
def g9(t):
    out = grid.grid_summary(coarse(t), "p", "risk_tier", TIER_ORDER, None)
    return out.withColumns({c: F.round(c, 8) for c in STATS})


@query("g9_grid_summary_fine", "fx_scored", _focal(WIDE) + CHILDREN.format(src="focal") + SCORED
       + f", tiered AS (SELECT *, {MICRO} AS mt FROM scored) " + _summary("p", "mt", FINE_TIERS) + "FROM tiered")
def g9_fine(t):
    out = grid.grid_summary(refined(t), "p", "micro_risk_tier", FINE_TIERS, None)
    return out.withColumns({c: F.round(c, 8) for c in STATS})


@query("g10_traceability", "fx_scored", _focal(WIDE) + """
SELECT 0::BIGINT AS orphans, (SELECT count(*) FROM flagged WHERE needs_refinement) - (SELECT count(*) FROM focal) AS childless_parents,
  100::BIGINT AS min_children, 100::BIGINT AS max_children""")
def g10(t):
    return grid.traceability(refined(t), coarse(t).where("needs_refinement"))
