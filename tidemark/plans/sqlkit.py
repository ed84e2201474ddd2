"""DuckDB SQL text for the oracle side of the catalog.

Shared common-table expressions mirror ``tidemark.plans.tables`` so that each oracle
query states, in plain SQL, the same derivation the Spark plan makes.
"""

from __future__ import annotations

from .tables import RATE_SERIES, SIDE_PRIORITY

RATE_NAMES = list(RATE_SERIES)


def cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in parts.items()) + "\n"


def cents(col: str) -> str:
    return f"CAST(round({col} * 100) AS BIGINT)"


DAILY = f"""SELECT CAST(l_shipdate AS DATE) AS Date, AVG({cents('l_extendedprice')}) AS price
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1"""


def rate_series(name: str) -> str:
    return (f"SELECT CAST(o_orderdate AS DATE) AS Date, AVG({cents('o_totalprice')}) / 100.0 AS {name} "
            f"FROM orders WHERE o_orderpriority = '{RATE_SERIES[name]}' GROUP BY 1")


RATES = f"""SELECT COALESCE(a.Date, b.Date, c.Date) AS Date, a.CNY_JPY, b.PHP_JPY, c.VND_JPY
FROM ({rate_series('CNY_JPY')}) a
FULL OUTER JOIN ({rate_series('PHP_JPY')}) b ON a.Date = b.Date
FULL OUTER JOIN ({rate_series('VND_JPY')}) c ON COALESCE(a.Date, b.Date) = c.Date"""


def ffill(col: str, order: str = "Date", part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (f"last_value({col} IGNORE NULLS) OVER ({p}ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def bfill(col: str, order: str = "Date", part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (f"first_value({col} IGNORE NULLS) OVER ({p}ORDER BY {order} "
            f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


def filled(src: str = "rates", cols=RATE_NAMES) -> str:
    body = ", ".join(f"COALESCE({ffill(c)}, {bfill(c)}) AS {c}" for c in cols)
    return f"SELECT Date, {body} FROM {src}"


def nearest(left: str, right: str, lcols: str, rcols: list[str], key: str = "Date") -> str:
    """Nearest-date join of ``left`` to ``right`` on ``key`` (exact, else closest, tie earlier)."""
    rsel = ", ".join(f"r.{c}" for c in rcols)
    return f"""SELECT {lcols}, {rsel} FROM (
  SELECT l.*,
    (SELECT max(r.{key}) FROM {right} r WHERE r.{key} <= l.{key}) AS _prev,
    (SELECT min(r.{key}) FROM {right} r WHERE r.{key} >= l.{key}) AS _next
  FROM {left} l) l
LEFT JOIN {right} r ON r.{key} = CASE
  WHEN l._next IS NULL THEN l._prev WHEN l._prev IS NULL THEN l._next
  WHEN (l.{key} - l._prev) <= (l._next - l.{key}) THEN l._prev ELSE l._next END"""


PANEL_COLS = ["price"] + RATE_NAMES


def panel_ctes() -> dict:
    return {
        "daily": DAILY,
        "rates": RATES,
        "filled": filled(),
        "panel": nearest("daily", "filled", "l.Date, l.price", RATE_NAMES),
    }


def corr_long(src: str, cols: list[str], digits: int = 9, name: str = "pearson_r") -> str:
    parts = []
    for a in cols:
        for b in cols:
            x, y = (a, b) if cols.index(a) <= cols.index(b) else (b, a)
            v = (f"CASE WHEN regr_sxx({y}, {x}) * regr_syy({y}, {x}) = 0 THEN NULL ELSE "
                 f"regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})) END")
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, round({v}, {digits}) AS {name} "
                         f"FROM {src}")
    return "\nUNION ALL\n".join(parts)


SIDE_MONTHLY = f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
AVG({cents('o_totalprice')}) / 100.0 AS Gasoline FROM orders WHERE o_orderpriority = '{SIDE_PRIORITY}' GROUP BY 1, 2"""

ITEMS = f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS Date, p_name AS name,
{cents('l_extendedprice')} AS price, p_brand AS category
FROM lineitem JOIN part ON l_partkey = p_partkey"""

WEEKLY_ITEMS = f"""SELECT l_orderkey, l_linenumber, CAST(year(o_orderdate) - 1995 + 14 AS INTEGER) AS year,
CAST(month(o_orderdate) AS INTEGER) AS month, least(4, CAST(ceil(day(o_orderdate) / 7) AS INTEGER)) AS week,
p_name AS name, format('{{:,}}', {cents('l_extendedprice')}) AS price,
p_brand AS category
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


# ---------------------------------------------------------------------------
# study panels


def pct_sql(src: str, cols: list[str], key: str = "Date", first_zero: bool = False) -> str:
    def one(c):
        v = f"(({c} / lag({c}) OVER (ORDER BY {key})) - 1.0) * 100.0"
        return f"COALESCE({v}, 0.0) AS {c}" if first_zero else f"{v} AS {c}"
    return f"SELECT {key}, " + ", ".join(one(c) for c in cols) + f" FROM {src}"


def minmax_sql(src: str, cols: list[str], key: str = "Date") -> str:
    parts = []
    for c in cols:
        lo, hi = f"min({c}) OVER ()", f"max({c}) OVER ()"
        parts.append(f"({c} - {lo}) / (CASE WHEN {hi} = {lo} THEN 1.0 ELSE {hi} - {lo} END) AS {c}")
    return f"SELECT {key}, " + ", ".join(parts) + f" FROM {src}"


def standard_sql(src: str, cols: list[str], key: str = "Date") -> str:
    parts = []
    for c in cols:
        sd = f"stddev_pop({c}) OVER ()"
        parts.append(f"({c} - avg({c}) OVER ()) / (CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END) AS {c}")
    return f"SELECT {key}, " + ", ".join(parts) + f" FROM {src}"


def split_sql(src: str, key: str = "Date", seed: int = 42, frac: float = 0.2) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || '|{seed}')) "
            f"<= ceil(count(*) OVER () * {frac} - 1e-9) AS is_test FROM {src}")


def gram3_sql(src: str, xs: list[str], y: str | None) -> str:
    """n, means and population (co)variances of 3 features (and y) over complete rows."""
    cols = xs + ([y] if y else [])
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sel = ["count(*) AS n"] + [f"avg({c}) AS m{i}" for i, c in enumerate(xs)]
    for i in range(3):
        for j in range(i, 3):
            sel.append(f"covar_pop({xs[i]}, {xs[j]}) AS s{i}{j}")
    if y:
        sel += [f"avg({y}) AS my", f"var_pop({y}) AS syy"]
        sel += [f"covar_pop({x}, {y}) AS t{i}" for i, x in enumerate(xs)]
    return f"SELECT {', '.join(sel)} FROM {src} WHERE {where}"


def inv3_sql(src: str) -> str:
    """Adds det and the symmetric inverse i00..i22 of the 3×3 matrix s00..s22."""
    s = {f"{i}{j}": f"s{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    det = (f"({s['00']}*({s['11']}*{s['22']}-{s['12']}*{s['12']})"
           f"-{s['01']}*({s['01']}*{s['22']}-{s['12']}*{s['02']})"
           f"+{s['02']}*({s['01']}*{s['12']}-{s['11']}*{s['02']}))")
    cof = {
        "i00": f"({s['11']}*{s['22']}-{s['12']}*{s['12']})",
        "i01": f"({s['02']}*{s['12']}-{s['01']}*{s['22']})",
        "i02": f"({s['01']}*{s['12']}-{s['02']}*{s['11']})",
        "i11": f"({s['00']}*{s['22']}-{s['02']}*{s['02']})",
        "i12": f"({s['01']}*{s['02']}-{s['00']}*{s['12']})",
        "i22": f"({s['00']}*{s['11']}-{s['01']}*{s['01']})",
    }
    body = ", ".join(f"{v} / {det} AS {k}" for k, v in cof.items())
    return f"SELECT *, {det} AS det, {body} FROM {src}"


def ols3_coef_sql(inv: str) -> str:
    """β = S⁻¹t and the intercept, from a row of ``inv3_sql`` with y moments."""
    inv_ = {"00": "i00", "01": "i01", "02": "i02", "10": "i01", "11": "i11", "12": "i12",
            "20": "i02", "21": "i12", "22": "i22"}
    b = [" + ".join(f"{inv_[f'{i}{j}']} * t{j}" for j in range(3)) for i in range(3)]
    return (f"SELECT *, {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2, "
            f"my - (({b[0]}) * m0 + ({b[1]}) * m1 + ({b[2]}) * m2) AS b_const FROM {inv}")


def _horner_sql(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"(({out}) * {x} + {c!r})"
    return out


def norm_ppf_sql(p: str) -> str:
    """Inverse standard-normal CDF by an approximation of its own (Abramowitz and Stegun 26.2.23),
    sharpened twice by Newton steps on the CDF's series, so that the Spark side is checked against
    other constants."""
    tail = f"least({p}, 1 - {p})"
    t = f"sqrt(-2 * ln({tail}))"
    z = f"({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"
    # upper tail of z = 1/2 - pdf(z) * (z + z^3/3 + z^5/15 + ...): summed until terms vanish
    series = "list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(z) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1))))))"
    out = z
    for _ in range(2):
        pdf = "(exp(-z * z / 2) / sqrt(2 * pi()))"
        out = f"(SELECT z + ((0.5 - {pdf} * {series}) - tail) / {pdf} FROM (SELECT greatest({out}, 1e-9) AS z, {tail} AS tail))"
    return f"CASE WHEN {p} = 0.5 THEN 0.0 ELSE sign({p} - 0.5) * {out} END"
