"""Column-level helpers; every function returns a ``Column`` (JVM-side)."""

from shiplens.functions.nullsafe import flag, null_max, safe_div
from shiplens.functions.noise import key_digest, keyed_normal
from shiplens.functions.numeric import half_even
from shiplens.functions.text import money_text, pct_text, count_text, thousands_text

__all__ = [
    "flag", "null_max", "safe_div", "key_digest", "keyed_normal",
    "half_even", "money_text", "pct_text", "count_text", "thousands_text",
]
