"""Keys of the payloads of exchanges and of the served documents."""

RATE = "funding_rate"
INDEX = "funding_index"
PREMIUM = "funding_premium"
RATE_8H = "funding_rate_8h"
BUCKET = "funding_bucket"
TIME = "funding_ts"
