"""Reading numbers that arrive as JSON numbers, strings, blanks or nulls."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrygrid.schema import AMOUNT


def optional_decimal(text: Column, dtype: T.DecimalType) -> Column:
    """Null or blank is null; anything unreadable is null too (see `unreadable`).

    The cast ignores white space itself, but fails on blanks by an exception,
    which is slow; hence the trim.
    """
    return F.nullif(F.trim(text), F.lit("")).try_cast(dtype)


def unreadable(text: Column, dtype: T.DataType) -> Column:
    """True where there is text but it is no number of the type."""
    return optional_decimal(text, dtype).isNull() & text.rlike(r"\S")


def epoch_ms(text: Column) -> Column:
    return text.try_cast("bigint")


def no_number(text: Column) -> Column:
    """True where there is text but no number; for numbers that are not stored, of whatever size."""
    return F.trim(text).try_cast("double").isNull() & text.rlike(r"\S")


def given(text: Column) -> Column:
    """The text of a number, null where it is blank."""
    return F.nullif(F.trim(text), F.lit(""))


def first_price(mark: Column, underlying: Column, last_traded: Column) -> Column:
    return F.coalesce(mark, underlying, last_traded)


_LIMB = 13  # digits; the sum of a few products of two limbs fits a decimal(38, 0)
_LIMBS = 4


def _ten(power: int) -> Column:
    return F.lit(Decimal(10**power)).cast(T.DecimalType(power + 1, 0))


def _limbs(x: Column) -> Column:
    """The digits of |x| times 10^18 in limbs of 13 digits, lowest first; null above 10^30."""
    near, far = x.try_cast(T.DecimalType(38, 18)), x.try_cast(T.DecimalType(38, 8))

    def digits(d: Column, s: int) -> Column:
        return F.concat(
            F.abs(d - d % 1).cast(T.DecimalType(31, 0)).cast("string"),
            F.lpad((F.abs(d % 1).cast(T.DecimalType(18, s)) * _ten(s)).cast(T.DecimalType(19, 0)).cast("string"), s, "0"),
            F.lit("0" * (18 - s)),
        )

    text = F.coalesce(_let(near, lambda d: digits(d, 18)), _let(far, lambda d: digits(d, 8)))
    padded = F.lpad(text, _LIMB * _LIMBS, "0")
    return _let(padded, lambda p: F.array(*[F.substring(p, _LIMB * (_LIMBS - 1 - k) + 1, _LIMB).cast(T.DecimalType(_LIMB, 0)) for k in range(_LIMBS)]))


def _carry(x: Column) -> tuple[Column, Column]:
    """(x div base, x mod base), both exact."""
    wide = x.cast(T.DecimalType(38, 0))
    low = wide % _ten(_LIMB)
    return ((wide - low) / _ten(_LIMB)).cast(T.DecimalType(38, 0)), low


def exact_product(a: Column, b: Column) -> Column:
    """a times b (numbers or their text) as a stored amount, rounded once, halves away from zero.

    Both are cut into limbs, whose products are added place by place, so no place is lost
    before the one rounding: 18 places and 10^20 on either side, 8 places up to 10^30. What no stored
    amount can hold is null, never an error.
    """
    # The sign of a number that rounds to 0 in either type still is that of its text.
    negative = F.trim(a.cast("string")).startswith("-") != F.trim(b.cast("string")).startswith("-")

    def signed(amount: Column) -> Column:
        return F.when(negative, -amount).otherwise(amount).try_cast(AMOUNT)

    limbed = _let(F.concat(_limbs(a), _limbs(b)), lambda x: _let(_sums(x), lambda s: _let(_rounded(s), lambda r: signed(_amount(r)))))
    # Most numbers have at most nine places on either side; their product is exact in one type, and so rounded once as well.
    short = T.DecimalType(18, 9)
    plain = [x.try_cast(short) for x in (a, b)]
    exact = [p == x.try_cast(T.DecimalType(38, 18)) for p, x in zip(plain, (a, b))]
    return F.when(exact[0] & exact[1], F.try_multiply(*plain).try_cast(AMOUNT)).otherwise(limbed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(limbs: Column) -> Column:
    """Sums of the products of limbs, by place."""
    left, right = ([F.get(limbs, F.lit(k + first)) for k in range(_LIMBS)] for first in (0, _LIMBS))
    return F.array(
        *[
            reduce(Column.__add__, [left[i] * right[k - i] for i in range(_LIMBS) if 0 <= k - i < _LIMBS]).cast(T.DecimalType(38, 0))
            for k in range(2 * _LIMBS - 1)
        ]
    )


def _rounded(sums: Column) -> Column:
    """The product in units of 10^-10 from its sums, which count 10^-36: 26 digits, or two limbs, below. Null beyond 30 digits."""
    s = [F.get(sums, F.lit(k)) for k in range(2 * _LIMBS - 1)]
    fits = (s[3] < Decimal(10**17)) & (s[4] < Decimal(10**4))
    for beyond in s[5:]:
        fits &= beyond == 0

    def total(second: Column) -> Column:
        carried, rest = _carry(second)
        half_up = F.when(rest * 2 >= _ten(_LIMB), 1).otherwise(0)
        return (
            (s[2] + carried + half_up).cast(T.DecimalType(31, 0))
            + (s[3].try_cast(T.DecimalType(17, 0)) * _ten(_LIMB)).cast(T.DecimalType(31, 0))
            + (s[4].try_cast(T.DecimalType(4, 0)) * _ten(2 * _LIMB)).cast(T.DecimalType(31, 0))
        ).cast(T.DecimalType(32, 0))

    return F.when(fits, _let(s[1] + _carry(s[0])[0], total))


def _amount(units: Column) -> Column:
    places = units % _ten(10)
    whole = ((units - places) / _ten(10)).cast(T.DecimalType(22, 0))
    return whole + places.cast(T.DecimalType(10, 0)) * F.lit(Decimal("0.0000000001")).cast(T.DecimalType(10, 10))


def open_interest_usd(base_quantity: Column, price: Column) -> Column:
    """Base units times price; null when either is missing or the product is out of range."""
    return exact_product(base_quantity, price)
