"""Fixture views: the same SQL text runs in Spark and in the checking engine."""

VIEWS = {
    "fx_points": """
SELECT sl_no, slide_name, district, material,
       CAST(27050400 + ((k * 7919) % 800) * 1000 AS DOUBLE) / 1e6 AS latitude,
       CAST(88050400 + ((k * 10459) % 797) * 1000 AS DOUBLE) / 1e6 AS longitude,
       label
FROM (SELECT c_custkey AS sl_no, c_name AS slide_name, n_name AS district, c_mktsegment AS material,
             c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS k,
             CASE WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS label
      FROM customer JOIN nation ON c_nationkey = n_nationkey) t
""",
    "fx_cells": """
SELECT CAST((p_partkey - p_partkey % 50) / 50 AS INT) AS r,
       CAST(p_partkey % 50 AS INT) AS c,
       CASE WHEN p_partkey % 97 = 0 THEN -9999e0 ELSE p_retailprice END AS z,
       CASE p_size % 5 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 60 ELSE 80 END AS land_cover
FROM part
""",
    "fx_rain_daily": """
SELECT user_id AS cell_id, CAST(ts AS DATE) AS d,
       CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 2000e0 AS precip
FROM events GROUP BY user_id, CAST(ts AS DATE)
""",
    "fx_events_at": """
SELECT event_id, user_id AS cell_id, CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END AS event_date
FROM events
""",
    "fx_scored": """
SELECT o_orderkey AS cell_id,
       CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 1000e0 AS s,
       CAST((o_orderkey * 11) % 700 AS DOUBLE) / 10e0 AS slope,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 1100 AS DOUBLE) / 10e0 END AS r24,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 1100 + (o_orderkey * 29) % 900 AS DOUBLE) / 10e0 END AS r72,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 1100 + (o_orderkey * 29) % 900 + (o_orderkey * 31) % 1200 AS DOUBLE) / 10e0 END AS r7d
FROM orders
""",
    "fx_history": """
SELECT o_orderkey AS sl_no,
  CASE o_orderkey % 10
    WHEN 0 THEN 'NA'
    WHEN 1 THEN CAST(dd AS VARCHAR(9)) || ' ' || mon || ' ' || CAST(yy AS VARCHAR(9))
    WHEN 2 THEN CAST(dd AS VARCHAR(9)) || 'th ' || mon || ' ' || CAST(yy AS VARCHAR(9))
    WHEN 3 THEN CAST(dd AS VARCHAR(9)) || '-' || CAST(dd + 1 AS VARCHAR(9)) || ' ' || mon || ' ' || CAST(yy AS VARCHAR(9))
    WHEN 4 THEN '2nd week of ' || mon || ' ' || CAST(yy AS VARCHAR(9))
    WHEN 5 THEN CAST(yy AS VARCHAR(9))
    WHEN 6 THEN CAST(dd AS VARCHAR(9)) || ' ' || mon || ' ' || CAST(yy AS VARCHAR(9)) || ' at 18:30 hrs.'
    WHEN 7 THEN CAST(yy - 1 AS VARCHAR(9)) || ', ' || CAST(dd AS VARCHAR(9)) || ' ' || mon || ' ' || CAST(yy AS VARCHAR(9))
    WHEN 8 THEN NULL
    ELSE '31 February ' || CAST(yy AS VARCHAR(9))
  END AS history
FROM (SELECT o_orderkey, EXTRACT(DAY FROM o_orderdate) AS dd, EXTRACT(YEAR FROM o_orderdate) AS yy,
        CASE EXTRACT(MONTH FROM o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March'
          WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
          WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mon
      FROM orders) t
""",
    "fx_predictions": """
SELECT o_orderkey AS id,
       CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000e0 AS prob,
       CASE WHEN (o_orderkey * 7919) % 1000 + (o_orderkey * 10459) % 600 >= 800 THEN 1 ELSE 0 END AS label,
       CAST(o_custkey % 24 AS INT) AS block
FROM orders
""",
    "fx_stations": """
SELECT s_suppkey AS station_id, s_name AS station_name, n_name AS district,
       CAST((s_suppkey * 613 + 200) % 1000 AS DOUBLE) / 1000e0 AS s,
       CAST((s_suppkey * 17) % 300 AS DOUBLE) / 10e0 AS a24,
       CAST((s_suppkey * 17) % 300 + (s_suppkey * 29) % 400 AS DOUBLE) / 10e0 AS a72,
       CAST((s_suppkey * 17) % 300 + (s_suppkey * 29) % 400 + (s_suppkey * 31) % 700 AS DOUBLE) / 10e0 AS a7d,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE CAST((s_suppkey * 7) % 350 AS DOUBLE) / 10e0 END AS c6,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE CAST((s_suppkey * 7) % 350 + 200 AS DOUBLE) / 10e0 END AS c12,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE CAST((s_suppkey * 7) % 350 + 450 AS DOUBLE) / 10e0 END AS c24,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE CAST((s_suppkey * 7) % 350 + 800 AS DOUBLE) / 10e0 END AS c48
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
    "fx_alert_candidates": """
SELECT event_id, ts, user_id AS station_id,
       CASE event_type WHEN 'view' THEN '+6h' WHEN 'click' THEN '+12h' WHEN 'signup' THEN '+24h' ELSE '+48h' END AS forecast_horizon,
       value / 500e0 AS risk_score
FROM events
""",
    # inventory as text, with unusable coordinates and whole rows missing
    "fx_raw_points": """
SELECT CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE n_name END AS district,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS material,
       CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN 'abc' WHEN c_custkey % 17 = 1 THEN '95.5'
            ELSE CAST(27 + (c_custkey % 40) AS VARCHAR(9)) || '.25' END AS latitude,
       CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 19 = 1 THEN '' ELSE CAST(88 + (c_custkey % 9) AS VARCHAR(9)) || '.5' END AS longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    # texture fractions in g/kg and bulk density in cg/cm3 at the inventory points
    "fx_soil": """
SELECT c_custkey AS sl_no, CAST(100 + c_custkey % 300 AS INT) AS clay, CAST(200 + (c_custkey * 7) % 300 AS INT) AS sand,
       CAST(700 - c_custkey % 300 - (c_custkey * 7) % 300 + c_custkey % 3 AS INT) AS silt,
       CAST(90 + (c_custkey * 31) % 70 AS INT) AS bulk_density
FROM customer
""",
}
