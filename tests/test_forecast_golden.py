"""The one published input/output pair: eight stations, four horizons."""

import pytest
from pyspark.sql import functions as F

from hazardspark.operators import alerts, forecast

# fixed values: id, s, antecedent 24h / 72h / 7d, cumulative forecast 6 / 12 / 24 / 48 h
STATIONS = [
    ("STN_01_GANGTOK", 0.892, 18.5, 45.0, 95.0, 24.0, 48.0, 72.0, 110.0),
    ("STN_02_RONGLI", 0.865, 22.0, 52.0, 108.0, 28.0, 55.0, 85.0, 130.0),
    ("STN_03_PAKYONG", 0.820, 15.0, 38.0, 80.0, 20.0, 40.0, 65.0, 95.0),
    ("STN_04_MANGAN", 0.785, 26.0, 60.0, 115.0, 35.0, 68.0, 98.0, 145.0),
    ("STN_05_NAMCHI", 0.640, 10.0, 25.0, 55.0, 12.0, 26.0, 44.0, 70.0),
    ("STN_06_GEYZING", 0.580, 8.0, 20.0, 45.0, 10.0, 22.0, 36.0, 60.0),
    ("STN_07_SORENG", 0.420, 6.0, 15.0, 35.0, 8.0, 18.0, 30.0, 50.0),
    ("STN_08_OFFLINE", 0.710, 12.0, 30.0, 65.0, None, None, None, None),
]
# fixed values: projected 24h / 72h / 7d, trigger index, risk, tier
EXPECTED = {
    ("STN_01_GANGTOK", "+6h"): (37.9, 65.2, 119.0, 0.6287, 0.7468, "High"),
    ("STN_01_GANGTOK", "+12h"): (57.2, 85.5, 143.0, 0.8429, 0.8493, "Very High"),
    ("STN_01_GANGTOK", "+24h"): (72.0, 102.0, 153.4, 0.984, 0.9167, "Very High"),
    ("STN_01_GANGTOK", "+48h"): (38.0, 128.5, 177.9, 0.8027, 0.83, "Very High"),
    ("STN_02_RONGLI", "+6h"): (44.5, 75.7, 136.0, 0.7288, 0.7772, "Very High"),
    ("STN_02_RONGLI", "+12h"): (66.0, 98.3, 163.0, 0.9462, 0.88, "Very High"),
    ("STN_02_RONGLI", "+24h"): (85.0, 119.7, 177.6, 1.0, 0.9055, "Very High"),
    ("STN_02_RONGLI", "+48h"): (45.0, 152.0, 207.1, 0.84, 0.8298, "Very High"),
    ("STN_03_PAKYONG", "+6h"): (31.2, 54.8, 100.0, 0.5252, 0.6537, "High"),
    ("STN_03_PAKYONG", "+12h"): (47.5, 71.7, 120.0, 0.7042, 0.7367, "High"),
    ("STN_03_PAKYONG", "+24h"): (65.0, 90.3, 133.6, 0.8855, 0.8208, "Very High"),
    ("STN_03_PAKYONG", "+48h"): (30.0, 110.0, 152.1, 0.76, 0.7626, "Very High"),
    ("STN_04_MANGAN", "+6h"): (54.5, 90.0, 150.0, 0.8557, 0.7835, "Very High"),
    ("STN_04_MANGAN", "+12h"): (81.0, 118.0, 183.0, 1.0, 0.8495, "Very High"),
    ("STN_04_MANGAN", "+24h"): (98.0, 138.0, 196.6, 1.0, 0.8495, "Very High"),
    ("STN_04_MANGAN", "+48h"): (47.0, 171.0, 227.1, 0.8507, 0.7813, "Very High"),
    ("STN_05_NAMCHI", "+6h"): (19.5, 34.9, 67.0, 0.3379, 0.4646, "Moderate"),
    ("STN_05_NAMCHI", "+12h"): (31.0, 46.8, 81.0, 0.4643, 0.5187, "Moderate"),
    ("STN_05_NAMCHI", "+24h"): (44.0, 60.7, 91.1, 0.5989, 0.5763, "High"),
    ("STN_05_NAMCHI", "+48h"): (26.0, 80.0, 109.3, 0.6008, 0.5771, "High"),
    ("STN_06_GEYZING", "+6h"): (16.0, 28.3, 55.0, 0.2762, 0.4049, "Moderate"),
    ("STN_06_GEYZING", "+12h"): (26.0, 38.7, 67.0, 0.3857, 0.4504, "Moderate"),
    ("STN_06_GEYZING", "+24h"): (36.0, 49.3, 74.6, 0.489, 0.4934, "Moderate"),
    ("STN_06_GEYZING", "+48h"): (24.0, 68.0, 92.1, 0.5196, 0.5061, "Moderate"),
    ("STN_07_SORENG", "+6h"): (12.5, 21.8, 43.0, 0.2145, 0.2924, "Low"),
    ("STN_07_SORENG", "+12h"): (21.0, 30.5, 53.0, 0.3071, 0.3279, "Low"),
    ("STN_07_SORENG", "+24h"): (30.0, 40.0, 60.0, 0.4, 0.3636, "Moderate"),
    ("STN_07_SORENG", "+48h"): (20.0, 56.0, 75.0, 0.4277, 0.3742, "Moderate"),
}
PEAKS = {
    "STN_01_GANGTOK": (0.9167, "+24h"), "STN_02_RONGLI": (0.9055, "+24h"), "STN_03_PAKYONG": (0.8208, "+24h"),
    "STN_04_MANGAN": (0.8495, "+12h"), "STN_05_NAMCHI": (0.5771, "+48h"), "STN_06_GEYZING": (0.5061, "+48h"),
    "STN_07_SORENG": (0.3742, "+48h"), "STN_08_OFFLINE": (0.71, "N/A (Offline)"),
}


@pytest.fixture(scope="module")
def stations(spark):
    ddl = "station_id string, s double, a24 double, a72 double, a7d double, c6 double, c12 double, c24 double, c48 double"
    df = spark.createDataFrame(STATIONS, ddl)
    return df.withColumns({"station_name": F.col("station_id"), "district": F.lit("D"),
                           "latitude": F.lit(27.2), "longitude": F.lit(88.5)})


def test_golden_rows(stations):
    rows = {(r.station_id, r.forecast_horizon): r for r in forecast.station_forecast(stations).collect()}
    assert len(rows) == 32
    for key, want in EXPECTED.items():
        r = rows[key]
        got = (r.projected_rolling_24h_mm, r.projected_rolling_72h_mm, r.projected_rolling_7d_mm)
        assert got == pytest.approx(want[:3], abs=0.1001), key
        assert (r.rainfall_trigger_index, r.forecast_risk_score) == pytest.approx(want[3:5], abs=1.0001e-4), key
        assert r.risk_category == want[5], key
        assert (r.risk_mode, r.forecast_status) == ("forecast_composite", "available")


def test_offline_station_falls_back_to_s(stations):
    fc = forecast.station_forecast(stations)
    for r in fc.where(F.col("station_id") == "STN_08_OFFLINE").collect():
        assert r.forecast_risk_score == 0.71 and r.risk_category == "High"
        assert r.rainfall_trigger_index is None and r.projected_rolling_24h_mm is None
        assert (r.risk_mode, r.forecast_status) == ("static_baseline_only", "unavailable")
    check = forecast.fallback_check(fc).first()
    assert (check.offline_rows, check.risk_equals_s, check.nothing_invented) == (4, True, True)


def test_peaks_earliest_on_tie(stations):
    rows = forecast.peak_horizon(forecast.station_forecast(stations)).collect()
    assert {r.station_id: (r.peak_forecast_risk, r.peak_horizon) for r in rows} == PEAKS


def test_hotspot_alert_counts(stations):
    """22 alerts: 9 HIGH and 13 VERY HIGH."""
    feed = alerts.hotspot_alerts(forecast.station_forecast(stations), F.to_timestamp(F.lit("2024-01-01")))
    counts = {r.alert_severity: r["count"] for r in feed.groupBy("alert_severity").count().collect()}
    assert counts == {"HIGH": 9, "VERY HIGH": 13}


def test_published_threshold_row(spark):
    """Precision, recall and F1 follow from the published counts at 0.35."""
    from hazardspark.operators import metrics

    rows = [(1, 0.9)] * 173 + [(0, 0.9)] * 60 + [(1, 0.1)] * 9 + [(0, 0.1)] * 111
    r = metrics.confusion(spark.createDataFrame(rows, "label int, prob double"), 0.35).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (173, 60, 9, 111)
    assert (r.precision, r.recall, r.f1) == pytest.approx((0.7425, 0.9505, 0.8337), abs=5e-5)
