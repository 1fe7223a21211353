from spendlens.functions.numeric import (  # noqa: F401
    as_col, as_date, clamp, dbl, half_even, js_number_text, js_round, month_diff,
    month_start, pct_tenths, safe_ratio,
)
