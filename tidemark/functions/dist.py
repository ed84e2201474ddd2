"""Distribution tails used by the inference summaries (no SciPy in the image).

Student t and F tails are regularised incomplete beta functions.  Each comes twice: in plain Python
for the few numbers of a summary on the driver, and as Column expressions, so that a grouped fit's
p-values stay in the JVM.  Both take the complement of x as well (a tail knows both without
cancellation) and hold for any degrees of freedom: the logarithm of the beta function is formed from a ratio of
gamma functions, not from their difference, and the continued fraction needs far fewer than ``_STEPS``
steps where it is used.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 120
_TINY = 1e-300
#: Arguments are shifted up by this before Stirling's series is used.
_SHIFT = 30
#: B₂ₖ / (2k (2k - 1)), the coefficients of Stirling's series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def _stirling_rest(z):
    """ln Γ(z) less its leading terms, for z of at least ``_SHIFT``."""
    inverse = 1.0 / (z * z)
    out = _STIRLING[-1]
    for c in _STIRLING[-2::-1]:
        out = out * inverse + c
    return out / z


def _log_beta(a, b, log, log1p, add_up):
    """ln B(a, b) = ln Γ(b) - (ln Γ(a + b) - ln Γ(a)), for numbers or Columns; ``add_up`` sums a function of 0 to ``_SHIFT`` - 1."""
    top, low = a + _SHIFT, b + _SHIFT
    log_gamma_b = (low - 0.5) * log(low) - low + 0.5 * math.log(2 * math.pi) + _stirling_rest(low)
    rise = (top - 0.5) * log1p(b / top) + b * log(top + b) - b + _stirling_rest(top + b) - _stirling_rest(top)
    return log_gamma_b - rise - add_up(lambda i: log(b + i) - log1p(b / (a + i)))


def _sum(f) -> float:
    return sum(f(i) for i in range(_SHIFT))


def _sum_col(f) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda total, i: total + f(i))


def _one_and_odd(a, b, x, y, m, choose):
    """1 + d₂ₘ₊₁ of the fraction 1/(1 + d₁/(1 + d₂/(1 + …))) (DLMF 8.17.22), formed from the smaller one of x and y = 1 - x: so it
    keeps its digits where d₂ₘ₊₁ is almost -1 (many degrees of freedom)."""
    scale = (a + 2 * m) * (a + 2 * m + 1)
    by_y = (a * (2 * m + 1 - b) + m * (3 * m + 2 - b) + (a + m) * (a + b + m) * y) / scale
    return choose(y < 0.5, by_y, 1 - (a + m) * (a + b + m) * x / scale)


def _link(a, b, x, y, m, choose):
    """Numerator and denominator m of the fraction's even part."""
    even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    odd_before = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
    return -odd_before * even, _one_and_odd(a, b, x, y, m, choose) + even


def _pick(condition, yes, no):
    return yes if condition else no


def _pick_col(condition, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def _fraction(a: float, b: float, x: float, y: float) -> float:
    """Ratios of successive numerators and denominators are multiplied up until they settle."""
    value = above = _one_and_odd(a, b, x, y, 0, _pick) or _TINY
    below = 0.0
    for m in range(1, _STEPS + 1):
        c, d = _link(a, b, x, y, m, _pick)
        above, below = (d + c / above) or _TINY, 1.0 / ((d + c * below) or _TINY)
        value *= above * below
        if above * below == 1.0:
            break
    return 1.0 / value


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x, where the caller has it exactly."""
    y = 1.0 - x if y is None else y
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    # the front factor xᵃ yᵇ / B(a, b) is the same seen from either end
    log_x, log_y = (math.log1p(-v) if v < 0.5 else math.log(1.0 - v if w is None else w) for v, w in ((y, x), (x, y)))
    front = math.exp(a * log_x + b * log_y - _log_beta(max(a, b), min(a, b), math.log, math.log1p, _sum))
    if x * (a + b + 2.0) < a + 1.0:
        return front * _fraction(a, b, x, y) / a
    return 1.0 - front * _fraction(b, a, y, x) / b


def t_sf(t: float, dof: float) -> float:
    """P(T > t) for Student t with ``dof`` degrees of freedom."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    square = t * t
    half = 0.5 * betainc(dof / 2.0, 0.5, dof / (dof + square), square / (dof + square))
    return half if t >= 0 else 1.0 - half


def t_ppf(q: float, dof: float) -> float:
    """Quantile of Student t (bisection on the tail; used for 95 % intervals)."""
    if not (0 < q < 1) or not dof or dof <= 0:
        return math.nan
    if q < 0.5:
        return -t_ppf(1.0 - q, dof)
    high = 1.0
    while t_sf(high, dof) > 1.0 - q and high < 1e300:
        high *= 2.0
    low = 0.0
    while True:
        middle = 0.5 * (low + high)
        if middle in (low, high):
            return middle
        low, high = (middle, high) if t_sf(middle, dof) > 1.0 - q else (low, middle)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if math.isinf(f):
        return 0.0
    whole = d2 + d1 * f
    return betainc(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole)


def chi2_sf_2dof(x: float) -> float:
    """P(X > x) for chi-square with 2 degrees of freedom (Omnibus and JB tests)."""
    return math.exp(-x / 2.0)


# ---------------------------------------------------------------------------
# Column forms


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each worked out once however often the body uses it."""
    return F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), body), F.lit(0))


def _fraction_col(a: Column, b: Column, x: Column, y: Column) -> Column:
    away = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    first = away(_one_and_odd(a, b, x, y, F.lit(0.0), _pick_col))
    start = _let(lambda s: F.struct(s["f"].alias("above"), F.lit(0.0).alias("below"), s["f"].alias("value")), f=first)

    def step(s, m):
        c, d = _link(a, b, x, y, m, _pick_col)
        linked = _let(lambda t: F.struct(away(t["d"] + t["c"] / s["above"]).alias("above"), (1.0 / away(t["d"] + t["c"] * s["below"])).alias("below")),
                      c=c, d=d)
        return F.get(F.transform(F.array(linked), lambda t: F.struct(
            t["above"].alias("above"), t["below"].alias("below"), (s["value"] * t["above"] * t["below"]).alias("value"))), F.lit(0))

    steps = F.transform(F.sequence(F.lit(1), F.lit(_STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, step, lambda s: 1.0 / s["value"])


def betainc_col(a: Column, b: Column, x: Column, y: Column) -> Column:
    """I_x(a, b) with y = 1 - x; null where an argument is missing or not positive."""
    def front(s):
        log_x = F.when(s["y"] < 0.5, F.log1p(-s["y"])).otherwise(F.log(s["x"]))
        log_y = F.when(s["x"] < 0.5, F.log1p(-s["x"])).otherwise(F.log(s["y"]))
        return F.exp(s["a"] * log_x + s["b"] * log_y - _log_beta(s["most"], s["least"], F.log, F.log1p, _sum_col))

    def own(s):
        # seen from the end where the fraction settles
        direct = s["x"] * (s["a"] + s["b"] + 2.0) < s["a"] + 1.0
        turned = {k: F.when(direct, s[p]).otherwise(s[q]) for k, p, q in (("p", "a", "b"), ("q", "b", "a"), ("u", "x", "y"), ("v", "y", "x"))}
        part = _let(lambda t: _fraction_col(t["p"], t["q"], t["u"], t["v"]) / t["p"], **turned)
        return _let(lambda t: F.when(direct, t["part"]).otherwise(1.0 - t["part"]), part=front(s) * part)

    inside = _let(own, a=a, b=b, x=x, y=y, most=F.greatest(a, b), least=F.least(a, b))
    return F.when((a > 0) & (b > 0), F.when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0)).otherwise(inside))


def t_sf_col(t: Column, dof: Column) -> Column:
    """P(T > t) of a row's t and degrees of freedom."""
    t, dof = t.cast("double"), dof.cast("double")
    square = t * t
    half = 0.5 * betainc_col(dof / 2.0, F.lit(0.5), dof / (dof + square), square / (dof + square))
    finite = _let(lambda s: F.when(t >= 0, s["half"]).otherwise(1.0 - s["half"]), half=half)
    return F.when(t == float("inf"), F.lit(0.0)).when(t == float("-inf"), F.lit(1.0)).when(dof > 0, finite)


@lru_cache(maxsize=16)
def t_sf_of(t: str, dof: str) -> Column:
    """``t_sf_col`` of two named columns; the expression is built once for each pair of names."""
    return t_sf_col(F.col(t), F.col(dof))


def f_sf_col(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) of a row's F and degrees of freedom."""
    f, d1, d2 = f.cast("double"), d1.cast("double"), d2.cast("double")
    whole = d2 + d1 * f
    return F.when(f == float("inf"), F.lit(0.0)).otherwise(betainc_col(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole))
