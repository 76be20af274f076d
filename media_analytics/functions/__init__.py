"""Scalar column functions and fixed values."""

from .constants import *  # noqa: F401,F403
from .scalar import (age_days, bucket_order, cut, duration_minutes, is_weekend,  # noqa: F401
                     ntz_literal, percent_text, posting_period, ratio_or_null, safe_div,
                     short_number)
