"""SQL text of a study's inference summary and report, by methods of its own.

Tails are integrals by Simpson's rule (the Spark side sums a continued fraction), the 97.5 % point comes from Newton
steps on that integral (bisection there), and the condition number from power iterations on the matrix and its
inverse (an eigenvalue solver there).
"""

from __future__ import annotations

from . import sqlkit as Q

X3 = Q.RATE_NAMES
COLS4 = Q.PANEL_COLS
_INV = {(i, j): f"i{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}


def f_tail(d1: str, d2: str, f: str, steps: int = 20000) -> str:
    """P(F > f) = 2 / B ∫ sin(u)^(d2 - 1) cos(u)^(d1 - 1) du from 0 to atan(√(d2 / (d1 f)))."""
    top = f"atan(sqrt(({d2}) / (({d1}) * greatest({f}, 1e-300))))"
    area = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(sin(i * ({top}) / {steps}.0), ({d2}) - 1) * pow(cos(i * ({top}) / {steps}.0), ({d1}) - 1)))")
    return (f"(2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)) * {area} * ({top}) / {steps}.0 / 3)")


def two_sided(t: str, dof: str) -> str:
    return f_tail("1", dof, f"({t}) * ({t})")


def _quantile_ctes() -> dict:
    """tq: the 97.5 % point of Student t with n - 4 degrees of freedom."""
    out = {"tq0": "SELECT n - 4.0 AS v, CAST(1.96 AS DOUBLE) AS t FROM st"}
    pdf = "(exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + t * t / v, -(v + 1) / 2))"
    for k in range(6):
        out[f"tq{k + 1}"] = f"SELECT v, t + ({two_sided('t', 'v')} - 0.05) / (2 * {pdf}) AS t FROM tq{k}"
    out["tq"] = "SELECT t FROM tq6"
    return out


def _power(name: str, source: str, cell) -> dict:
    """The largest eigenvalue of a symmetric 4 × 4 matrix (cell(i, j) over a row of ``source``)."""
    product = [" + ".join(f"m{i}{j} * v{j}" for j in range(4)) for i in range(4)]
    cells = ", ".join(f"{cell(i, j)} AS m{i}{j}" for i in range(4) for j in range(4))
    names = ", ".join(f"m{i}{j}" for i in range(4) for j in range(4))
    size = "sqrt(" + " + ".join(f"pow({x}, 2)" for x in product) + ")"
    return {
        f"{name}m": f"SELECT {cells} FROM {source}",
        f"{name}p(k, {', '.join(f'v{i}' for i in range(4))}, {names})":
            f"SELECT 0, CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), {names} FROM {name}m UNION ALL "
            f"SELECT k + 1, {', '.join(f'({x}) / {size}' for x in product)}, {names} FROM {name}p WHERE k < 1500",
        name: "SELECT " + " + ".join(f"v{i} * ({x})" for i, x in enumerate(product)) + f" AS value FROM {name}p WHERE k = 1500",
    }


def study_ctes(ctes: dict, src: str) -> dict:
    """From a panel ``src`` (Date, price, rates): split, fit, residual moments, summary inputs."""
    pred = "(b_const + b0 * {0}.CNY_JPY + b1 * {0}.PHP_JPY + b2 * {0}.VND_JPY)"
    quad = " + ".join(f"co.m{i} * {_INV[i, j]} * co.m{j}" for i in range(3) for j in range(3))
    out = dict(ctes, sp=Q.split_sql(src), train="SELECT * FROM sp WHERE NOT is_test", g=Q.gram3_sql("train", X3, "price"),
               inv=Q.inv3_sql("g"), co=Q.ols3_coef_sql("inv"))
    out["res"] = f"SELECT train.Date, train.price - {pred.format('train')} AS e FROM train, co"
    out["mom"] = "SELECT count(*) AS n, sum(e * e) AS sse, avg(e) AS me FROM res"
    out["cm"] = ("SELECT n, sse, sum((e - me) ^ 2) / n AS c2, sum((e - me) ^ 3) / n AS c3, sum((e - me) ^ 4) / n AS c4 FROM res, mom GROUP BY n, sse")
    out["dw"] = "SELECT sum((e - pe) ^ 2) AS ssd FROM (SELECT e, lag(e) OVER (ORDER BY Date) AS pe FROM res)"
    out["st"] = ("SELECT CAST(cm.n AS DOUBLE) AS n, 1 - cm.sse / (g.syy * g.n) AS r2, cm.sse AS sse, c3 / c2 ^ 1.5 AS skew, c4 / (c2 * c2) AS kurt, "
                 "dw.ssd / cm.sse AS dw FROM cm, g, dw")
    se = [f"sqrt(cm.sse / (cm.n - 4) * (1.0 / cm.n + ({quad}) / cm.n))"] + [f"sqrt(cm.sse / (cm.n - 4) * i{i}{i} / cm.n)" for i in range(3)]
    terms = zip(("const", *X3), ("b_const", "b0", "b1", "b2"), se)
    out["tab"] = " UNION ALL ".join(f"SELECT {k} AS no, '{term}' AS term, {b} AS coef, {s} AS std_err, cm.n - 4.0 AS v FROM co, cm"
                                    for k, (term, b, s) in enumerate(terms))
    out["z"] = ("SELECT *, skew * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) "
                "/ ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2, (kurt - 3.0 * (n - 1) / (n + 1)) "
                "/ sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, "
                "6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM st")
    out["z2"] = "SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM z"
    z1 = "ln(y / sqrt(2 / (w2 - 1)) + sqrt(y * y / (2 / (w2 - 1)) + 1)) / sqrt(0.5 * ln(w2))"
    z2 = "(1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))"
    out["om"] = f"SELECT pow({z1}, 2) + pow({z2}, 2) AS k2 FROM z2"
    mean = lambda i: "1.0" if i == 0 else f"m{i - 1}"
    square = lambda i, j: f"n * ({mean(i)} * {mean(j)}" + (f" + s{min(i, j) - 1}{max(i, j) - 1})" if i and j else ")")
    inner = " + ".join(f"m{i} * {_INV[i, j]} * m{j}" for i in range(3) for j in range(3))

    def inverse(i, j):
        if i and j:
            return f"{_INV[i - 1, j - 1]} / n"
        if i or j:
            return "-(" + " + ".join(f"{_INV[max(i, j) - 1, k]} * m{k}" for k in range(3)) + ") / n"
        return f"(1.0 + {inner}) / n"

    return out | _quantile_ctes() | _power("top", "inv", square) | _power("low", "inv", inverse)


def cte_text(ctes: dict) -> str:
    return Q.cte(**ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_STATS = {
    "n": "n", "df_model": "3", "df_resid": "n - 4", "r2": "r2", "adj_r2": "1 - (1 - r2) * (n - 1) / (n - 4)",
    "f_stat": "(r2 / 3) / ((1 - r2) / (n - 4))", "f_pvalue": f_tail("3", "n - 4", "(r2 / 3) / ((1 - r2) / (n - 4))"),
    "log_likelihood": "-n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1)", "aic": "n * (ln(2 * pi()) + ln(sse / n) + 1) + 8",
    "bic": "n * (ln(2 * pi()) + ln(sse / n) + 1) + 4 * ln(n)", "omnibus": "k2", "omnibus_p": "exp(-k2 / 2)", "skew": "skew",
    "kurtosis": "kurt", "durbin_watson": "dw", "jarque_bera": "n / 6.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4.0)",
    "jb_p": "exp(-n / 12.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4.0))", "cond_no": "sqrt(top.value * low.value)",
}


def stats_select(digits: int = 6) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{k}' AS stat, round({v}, {digits}) AS value FROM st, om, top, low" for k, v in _STATS.items())


def coef_select(digits: int = 6) -> str:
    r = lambda e, name: f"round({e}, {digits}) AS {name}"
    return ("SELECT term, " + ", ".join([r("coef", "coef"), r("std_err", "std_err"), r("coef / std_err", "t"),
                                         r(two_sided("coef / std_err", "v"), "p_value"),
                                         r("coef - tq.t * std_err", "ci_low"), r("coef + tq.t * std_err", "ci_high")]) + " FROM tab, tq")


def _row(section: str, row_name: str, col: str, value: str, source: str) -> str:
    return (f"SELECT '{section}' AS section, {row_name} AS row_name, '{col}' AS col_name, CAST(round({value}, 6) AS DOUBLE) + CAST(0 AS DOUBLE) AS value, "
            f"CAST(NULL AS VARCHAR) AS text FROM {source}")


_SP_PRED = "(b_const + b0 * sp.CNY_JPY + b1 * sp.PHP_JPY + b2 * sp.VND_JPY)"
_SP_R2 = f"1 - avg((sp.price - {_SP_PRED}) ^ 2) / var_pop(sp.price)"


def regression_ctes(ctes: dict, src: str) -> dict:
    return dict(study_ctes(ctes, src), ga=Q.gram3_sql(src, X3, None), va=Q.inv3_sql("ga"), stats=stats_select(), coefs=coef_select())


def regression_parts() -> list[str]:
    """Coefficients, test scores, VIF, summary and coefficient table of ``regression_ctes``."""
    parts = [_row("coefficients", "term", "coef", "coef", "tab")]
    parts += [_row("test_scores", "'ols'", k, e, "sp, co WHERE is_test") for k, e in (("mse", f"avg((sp.price - {_SP_PRED}) ^ 2)"), ("r2", _SP_R2))]
    quad = " + ".join(f"m{i} * {_INV[i, j]} * m{j}" for i in range(3) for j in range(3))
    parts.append(_row("vif", "'const'", "vif", f"1 + {quad}", "va"))
    parts += [_row("vif", f"'{x}'", "vif", f"s{i}{i} * i{i}{i}", "va") for i, x in enumerate(X3)]
    parts.append(_row("ols_summary", "stat", "value", "value", "stats"))
    return parts + [_row("ols_coefficients", "term", k, k, "coefs") for k in ("coef", "std_err", "t", "p_value", "ci_low", "ci_high")]


def report_sql(ctes: dict, src: str, title: str) -> str:
    """The whole report as (section, row_name, col_name, value, text), values to six digits."""
    parts = [f"SELECT 'title' AS section, '' AS row_name, '' AS col_name, CAST(count(*) AS DOUBLE) AS value, '{title}' AS text FROM {src}"]
    figures = {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})", "q25": "quantile_cont({0}, 0.25)",
               "q50": "quantile_cont({0}, 0.5)", "q75": "quantile_cont({0}, 0.75)", "max": "max({0})"}
    parts += [_row("describe", f"'{v}'", k, e.format(v), src) for v in COLS4 for k, e in figures.items()]
    parts.append(f"SELECT 'correlation' AS section, var_x AS row_name, var_y AS col_name, round(pearson_r, 6) AS value, "
                 f"CAST(NULL AS VARCHAR) AS text FROM ({Q.corr_long(src, COLS4)})")
    parts += regression_parts()
    parts.append(f"SELECT 'remarks' AS section, 'r2' AS row_name, 'verdict' AS col_name, round({_SP_R2}, 6) AS value, CASE WHEN {_SP_R2} < 0.3 THEN 'weak' "
                 f"WHEN {_SP_R2} >= 0.7 THEN 'strong' ELSE 'moderate' END AS text FROM sp, co WHERE is_test")
    return cte_text(regression_ctes(ctes, src)) + "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


def variants_sql(variants: list[tuple[str, dict, str]]) -> str:
    """The regression sections of several panels (name, CTEs, source), each with the variant's name."""
    out = []
    for name, ctes, src in variants:
        body = cte_text(regression_ctes(ctes, src)) + "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in regression_parts())
        # the price's own unit is large: its error is given in millions
        out.append(f"SELECT '{name}' AS variant, section, row_name, col_name, CASE WHEN col_name = 'mse' THEN round(value / 1e6, 3) ELSE value END AS value FROM ({body})")
    return "\nUNION ALL\n".join(out)
