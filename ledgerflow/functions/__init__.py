"""Column-expression helpers (JVM side, codegen friendly; no Python UDFs)."""
from .timecols import (micros_between, add_micros, day_delta, add_days, ts_lit,
                       ts_text, parse_interval, US_PER_DAY)
from .fixedpoint import exact_sum, exact_sums, settled
from .scaling import minmax_expr, minmax_inverse_expr, time_features, piecewise_linear

__all__ = [
    "micros_between", "add_micros", "day_delta", "add_days", "ts_lit", "ts_text",
    "parse_interval", "US_PER_DAY", "exact_sum", "exact_sums", "settled", "minmax_expr",
    "minmax_inverse_expr", "time_features", "piecewise_linear",
]
