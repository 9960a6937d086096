"""SQL text fragments shared by the checks."""

from __future__ import annotations

RIDX = (
    "(0.40 * least(greatest({0} / 75e0, 0e0), 1e0) + 0.35 * least(greatest({1} / 100e0, 0e0), 1e0)"
    " + 0.25 * least(greatest({2} / 150e0, 0e0), 1e0))"
)


def ridx(r24: str, r72: str, r7d: str) -> str:
    """Trigger index, NULL unless all three windows are known."""
    body = RIDX.format(r24, r72, r7d).replace("0.40", "0.40::DOUBLE").replace("0.35", "0.35::DOUBLE").replace(
        "0.25", "0.25::DOUBLE")
    return f"CASE WHEN {r24} IS NULL OR {r72} IS NULL OR {r7d} IS NULL THEN NULL ELSE {body} END"


def risk(s: str, r: str) -> str:
    mix = f"0.5e0 * {s} + 0.3e0 * {r} + 0.2e0 * ({s} * {r})"
    return (
        f"CASE WHEN {r} IS NULL THEN least(greatest({s}, 0e0), 1e0) "
        f"ELSE least(greatest({mix}, 0e0), 1e0) END"
    )


def tier(x: str, edges=(0.75, 0.55, 0.35), missing: str = "'Unknown'") -> str:
    a, b, c = edges
    return (
        f"CASE WHEN {x} IS NULL THEN {missing} WHEN {x} >= {a}::DOUBLE THEN 'Very High' "
        f"WHEN {x} >= {b}::DOUBLE THEN 'High' WHEN {x} >= {c}::DOUBLE THEN 'Moderate' ELSE 'Low' END"
    )


def severity(x: str) -> str:
    return f"CASE WHEN {x} >= 0.75::DOUBLE THEN 'VERY HIGH' WHEN {x} >= 0.55::DOUBLE THEN 'HIGH' END"


def even(x: str, digits: int) -> str:
    """Half-even rounding of the shortest decimal form, as Spark's bround does it."""
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
