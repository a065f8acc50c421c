"""Scaling / numeric-encoding expressions."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax_params(lo, hi, feature_range=(0.0, 1.0)):
    """(scale, offset) of a min-max scaler, computed like scikit-learn:
    ``scale = (b - a) / (hi - lo)`` (a zero range divides by 1) and
    ``offset = a - lo * scale``; the transform is ``x * scale + offset``."""
    a, b = float(feature_range[0]), float(feature_range[1])
    rng = float(hi) - float(lo)
    scale = (b - a) / (rng if rng != 0.0 else 1.0)
    return scale, a - float(lo) * scale


def minmax_param_cols(lo: Column, hi: Column, feature_range=(0.0, 1.0)):
    """Column version of :func:`minmax_params` (per-group scalers)."""
    a, b = float(feature_range[0]), float(feature_range[1])
    rng = hi.cast("double") - lo.cast("double")
    scale = F.lit(b - a) / F.when(rng != 0.0, rng).otherwise(F.lit(1.0))
    return scale, F.lit(a) - lo.cast("double") * scale


def minmax_expr(x: Column, scale, offset, clip: bool = False,
                feature_range=(0.0, 1.0)) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    y = x.cast("double") * scale + offset
    if clip:
        y = F.least(F.greatest(y, F.lit(float(feature_range[0]))),
                    F.lit(float(feature_range[1])))
    return y


def minmax_inverse_expr(y: Column, scale, offset) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    return (y.cast("double") - offset) / scale


def time_features(tau: Column, w: Sequence[float], b: Sequence[float],
                  w0: float, b0: float, fn: str = "sin") -> Column:
    """Periodic + linear time features: ``[f(tau*w_i + b_i)..., tau*w0 + b0]``.

    The weights are supplied (they are not trained here)."""
    if len(w) != len(b):
        raise ValueError("w and b must have the same length")
    f = {"sin": F.sin, "sine": F.sin, "cos": F.cos, "cosine": F.cos}[fn]
    t = tau.cast("double")
    periodic = [f(t * F.lit(float(wi)) + F.lit(float(bi))) for wi, bi in zip(w, b)]
    return F.array(*periodic, t * F.lit(float(w0)) + F.lit(float(b0)))


def piecewise_linear(x: Column, edges: Column) -> Column:
    """Piecewise-linear encoding of ``x`` over bin ``edges`` (ascending array
    of B+1 values): one ratio per bin, ``(x - e_i) / (e_{i+1} - e_i)``, clamped
    to [0, 1] except below the first bin and above the last one.  Fewer than
    two edges (a constant column has one) make no bin: the result is empty."""
    n_bins = F.size(edges) - 1
    xd = x.cast("double")

    def ratio(i):
        lo = F.element_at(edges, i + 1)
        hi = F.element_at(edges, i + 2)
        r = (xd - lo) / (hi - lo)
        r = F.when(i > 0, F.greatest(r, F.lit(0.0))).otherwise(r)
        return F.when(i < n_bins - 1, F.least(r, F.lit(1.0))).otherwise(r)

    bins = F.when(n_bins > 0, F.sequence(F.lit(0), F.greatest(n_bins, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(bins, ratio)
