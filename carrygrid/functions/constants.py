"""Fixed values that results depend on."""

# Basis-point thresholds.
MIN_SPREAD_BPS = 2.0
DECENT_BPS = 4.0
MEDIUM_BPS = 5.0
GOOD_BPS = 8.0
HIGH_BPS = 10.0
EXCELLENT_BPS = 15.0
VERY_HIGH_BPS = 25.0
EXTREME_BPS = 50.0

CARRY_PERIODS_PER_DAY = 3
DAYS_PER_YEAR = 365
CARRY_INTERVAL_MINUTES = 480
DEFAULT_LOOKBACK_HOURS = 24

BPS = 10000.0
MISSING = "–"  # shown where a value is absent
