"""Classes of spreads, pairs, rows and rates.

These functions, like those of ``display``, take and return SQL expression text:
the trees are large, and one ``expr`` call parses in the JVM what would be some
hundred calls from Python. A spread that is null means that there is no pair.
"""

from __future__ import annotations

from .constants import (
    BPS,
    DECENT_BPS,
    EXCELLENT_BPS,
    EXTREME_BPS,
    GOOD_BPS,
    HIGH_BPS,
    MEDIUM_BPS,
    MIN_SPREAD_BPS,
    VERY_HIGH_BPS,
)


def both_positive(a: str, b: str) -> str:
    return f"({a} > 0 AND {b} > 0)"


def both_negative(a: str, b: str) -> str:
    return f"({a} < 0 AND {b} < 0)"


def same_sign(a: str, b: str) -> str:
    return f"({both_positive(a, b)} OR {both_negative(a, b)})"


def spread_class(spread: str) -> str:
    return f"""CASE
        WHEN {spread} IS NULL THEN ''
        WHEN {spread} >= {EXTREME_BPS}D THEN 'arb-extreme'
        WHEN {spread} >= {VERY_HIGH_BPS}D THEN 'arb-very-high'
        WHEN {spread} >= {HIGH_BPS}D THEN 'arb-high'
        WHEN {spread} >= {MEDIUM_BPS}D THEN 'arb-medium'
        ELSE 'arb-low' END"""


def opportunity_class(long_rate: str, short_rate: str, spread: str) -> str:
    return f"""CASE
        WHEN {spread} IS NULL THEN ''
        WHEN {spread} >= {VERY_HIGH_BPS}D AND {same_sign(long_rate, short_rate)} THEN 'arb-combo-extreme-capture'
        WHEN {spread} >= {EXCELLENT_BPS}D THEN 'arb-combo-excellent'
        WHEN {spread} >= {GOOD_BPS}D THEN 'arb-combo-good'
        WHEN {spread} >= {DECENT_BPS}D THEN 'arb-combo-decent'
        ELSE 'arb-combo-minimal' END"""


def row_class(long_rate: str, short_rate: str, spread: str) -> str:
    same = same_sign(long_rate, short_rate)
    return f"""CASE
        WHEN {spread} >= {EXTREME_BPS}D AND {same} THEN 'row-extreme-capture'
        WHEN {spread} >= {VERY_HIGH_BPS}D AND {same} THEN 'row-high-capture'
        WHEN {spread} >= {VERY_HIGH_BPS}D THEN 'row-high-spread'
        ELSE '' END"""


def rate_class(rate: str, low: str, high: str, exchanges: str) -> str:
    """Class of one rate, given the lowest and highest of its token and their number."""
    spread = f"({high} - {low}) * {BPS}D"
    extreme = f"({low} > 0 OR {high} < 0) AND {spread} >= {VERY_HIGH_BPS}D"
    return f"""CASE
        WHEN {exchanges} < 2 THEN 'rate-neutral'
        WHEN {extreme} AND {rate} = {high} THEN 'rate-extreme-short'
        WHEN {extreme} AND {rate} = {low} THEN 'rate-extreme-long'
        WHEN {spread} < {MIN_SPREAD_BPS}D THEN 'rate-neutral'
        WHEN {rate} = {high} AND {spread} >= {MEDIUM_BPS}D THEN 'rate-short-candidate'
        WHEN {rate} = {low} AND {spread} >= {MEDIUM_BPS}D THEN 'rate-long-candidate'
        WHEN {rate} = {high} THEN 'rate-short-opportunity'
        WHEN {rate} = {low} THEN 'rate-long-opportunity'
        WHEN {rate} > 0 THEN 'rate-positive'
        WHEN {rate} < 0 THEN 'rate-negative'
        ELSE 'rate-neutral' END"""
