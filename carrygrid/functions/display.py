"""Display text of the board, as SQL expression text (see ``classes``)."""

from __future__ import annotations

from .classes import both_negative, both_positive, same_sign
from .constants import (
    DAYS_PER_YEAR,
    EXTREME_BPS,
    CARRY_PERIODS_PER_DAY,
    MISSING,
    VERY_HIGH_BPS,
)

_SPLIT = "134217729D"  # 2^27 + 1 cuts a double into two halves of 26 bits
_EXACT = "9007199254740992D"  # 2^53: below it every integer is a double
_TWO_63 = "9223372036854775808D"
_TWO_126 = "8.507059173023462E37D"


def fixed(value: str, places: int) -> str:
    """Fixed-point text of a double, rounded from its exact binary value.

    Exact halves go away from zero, so 0.125 is ``0.13``; 1.005, which is stored
    a little below, is ``1.00``. Neither ``format_number`` nor ``format_string``
    rounds like that. The product with 10^places is taken together with its
    rounding error (split halves times a small integer are exact), which tells
    on which side of the half the value lies. From 2^53 on, where the product has no half
    any more, the whole part of the value itself is cut off first: what is left has few bits, so
    its product is exact. Whole numbers are added up from two parts, up to 2^126.
    """
    x = f"({value})"
    a, scale = f"abs{x}", 10**places
    product = f"({a} * {scale}D)"
    high = f"({a} * {_SPLIT} - ({a} * {_SPLIT} - {a}))"
    error = f"(({high} * {scale}D - {product}) + ({a} - {high}) * {scale}D)"
    up = f"CASE WHEN ({product} - floor({product}) - 0.5D) + {error} >= 0 THEN 1 ELSE 0 END"
    units = f"(floor({product}) + {up})"
    step = f"0.{'1'.zfill(places)}" if places else "1"  # decimal literal: exact, sets the places
    return f"""CASE
        WHEN {product} < {_EXACT} THEN concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, string({units} * {step}))
        ELSE element_at(transform(array({x}), v -> {_large("v", places)}), 1) END"""


def _large(v: str, places: int) -> str:
    """The same from 2^53 on: v = high * 2^63 + whole + part, each exact. Rare, so not worth any generated code."""
    a, scale = f"abs({v})", 10**places
    high = f"floor({a} / {_TWO_63})"
    whole = f"floor({a} - {high} * {_TWO_63})"
    part = f"(CASE WHEN {a} < {_EXACT} THEN floor(({a} - floor({a})) * {scale}D + 0.5D) ELSE 0 END)"
    units = f"(CAST({high} AS DECIMAL(19,0)) * 9223372036854775808 + CAST({whole} AS DECIMAL(19,0)) + CAST({part} div {scale} AS DECIMAL(19,0)))"
    tail = f", '.', lpad(string({part} % {scale}), {places}, '0')" if places else ""
    sign = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END"
    return f"CASE WHEN {a} < {_TWO_126} THEN concat({sign}, string(CAST({units} AS DECIMAL(38,0))){tail}) ELSE string({v}) END"


def unit_scaled(value: str) -> str:
    """The number in its unit: thousands, millions or billions."""
    v = f"double({value})"
    return f"({v} / CASE WHEN {v} >= 1e9D THEN 1e9D WHEN {v} >= 1e6D THEN 1e6D ELSE 1e3D END)"


def number_text(value: str, scaled: str | None = None) -> str:
    """1.50K / 2.00M / 3.25B; below a thousand, and negatives, in full.

    ``scaled`` may name a column that already holds `unit_scaled`, which keeps
    the expression small.
    """
    v = f"double({value})"
    suffix = f"CASE WHEN {v} >= 1e9D THEN 'B' WHEN {v} >= 1e6D THEN 'M' ELSE 'K' END"
    in_unit = fixed(scaled or unit_scaled(value), 2)
    return f"CASE WHEN {v} >= 1e3D THEN concat({in_unit}, {suffix}) ELSE {fixed(v, 0)} END"


def dollars(value: str, scaled: str | None = None) -> str:
    return f"concat('$', {number_text(value, scaled)})"


def rate_apr(rate: str) -> str:
    """8-hour fraction to percent per year."""
    return f"({rate} * {CARRY_PERIODS_PER_DAY}D * {DAYS_PER_YEAR}D * 100D)"


def rate_text(rate: str, mode: str = "rate") -> str:
    if mode == "annualized":
        return f"concat({fixed(rate_apr(rate), 2)}, '%')"
    if mode != "rate":
        raise ValueError(f"unknown display mode: {mode}")
    return f"concat({fixed(f'{rate} * 100D', 3)}, '%')"


def spread_text(spread_bps: str, unit: str = "percentage") -> str:
    if unit == "percentage":
        text = f"concat({fixed(f'{spread_bps} / 100D', 3)}, '%')"
    elif unit == "bps":
        text = f"concat({fixed(spread_bps, 0)}, ' bps')"
    else:
        raise ValueError(f"unknown spread unit: {unit}")
    return f"CASE WHEN {spread_bps} IS NULL THEN '{MISSING}' ELSE {text} END"


def arb_label(long_exchange: str, short_exchange: str, long_rate: str, short_rate: str, spread: str) -> str:
    """``L:AAA S:BBB`` with a mark for wide spreads; a dash when there is no pair."""
    same = same_sign(long_rate, short_rate)
    return f"""CASE WHEN {spread} IS NULL THEN '{MISSING}' ELSE concat(
        CASE WHEN {spread} >= {EXTREME_BPS}D AND {same} THEN '🔥 '
             WHEN {spread} >= {VERY_HIGH_BPS}D AND {same} THEN '🎯 '
             WHEN {spread} >= {VERY_HIGH_BPS}D THEN '⚡ ' ELSE '' END,
        'L:', upper(left({long_exchange}, 3)), ' S:', upper(left({short_exchange}, 3))) END"""


def capture_text(long_rate: str, short_rate: str, spread: str) -> str:
    """Note on a same-sign pair of 25 bps or more, else null."""
    tail = f"{fixed(spread, 0)}, 'bps spread'"
    wide = f"{spread} >= {VERY_HIGH_BPS}D"
    return f"""CASE
        WHEN {wide} AND {both_positive(long_rate, short_rate)} THEN concat('Both positive, ', {tail})
        WHEN {wide} AND {both_negative(long_rate, short_rate)} THEN concat('Both negative, ', {tail}) END"""
