"""The estimators as registered queries over the tables, with their SQL.

Doubles are rounded to four places in both, so that the order of sums doesn't show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import associations as A
from ..operators import cointegration as CO
from ..operators import discontinuity as D
from ..operators import dynamic as D2
from ..operators import experiments as E
from ..operators import instruments as I
from ..operators import latent as LA
from ..operators import learners as L
from ..operators import links as LK
from ..operators import marginal_effects as ME
from ..operators import matching as M
from ..operators import panels as P
from ..operators import propensity as O
from ..operators import quantile_regression as QR
from ..operators import replicated as RP
from ..operators import resampling as R
from ..operators import series as T
from ..operators import stationarity as ST
from ..operators import synthetic as Z
from ..sources import frames as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 4

LINES = """(SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS y, (l_discount >= 0.05)::INT AS t, l_linenumber % 2 AS z, l_quantity AS x1, l_tax AS x2,
    l_discount AS d, l_returnflag AS stratum, l_linestatus AS segment, l_suppkey AS cluster FROM lineitem)"""
ORDERS = """(SELECT o_orderkey AS id, o_custkey AS unit, o_totalprice AS y, (o_custkey % 2)::INT AS t, (year(o_orderdate) >= 1999)::INT AS post,
    (year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1 AS quarter, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""
CUSTOMERS = """(SELECT c_custkey AS id, c_acctbal AS y, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS t, (c_acctbal >= 0)::INT AS observed, c_nationkey AS nation FROM customer)"""


#: The normal quantile of a 95 % interval.
Z_QUANTILE = 1.959963984540054


def _interval(sql: str, estimate: str, se: str, df: str | None) -> str:
    """The interval and two-sided p-value: the t quantile by its expansion in 1 / df, the t statistic as a normal one (Wallace), and the normal tail by a rational form."""
    q, z = str(Z_QUANTILE), f"abs({estimate} / {se})"
    if df:
        terms = [(Z_QUANTILE**3 + Z_QUANTILE) / 4, (5 * Z_QUANTILE**5 + 16 * Z_QUANTILE**3 + 3 * Z_QUANTILE) / 96, (3 * Z_QUANTILE**7 + 19 * Z_QUANTILE**5 + 17 * Z_QUANTILE**3 - 15 * Z_QUANTILE) / 384, (79 * Z_QUANTILE**9 + 776 * Z_QUANTILE**7 + 1482 * Z_QUANTILE**5 - 1920 * Z_QUANTILE**3 - 945 * Z_QUANTILE) / 92160]
        q = f"({Z_QUANTILE} + {terms[0]} / {df} + {terms[1]} / {df} ** 2 + {terms[2]} / {df} ** 3 + {terms[3]} / {df} ** 4)"
        z = f"(8.0 * {df} + 1) / (8.0 * {df} + 3) * sqrt({df} * ln(1 + ({estimate} / {se}) ** 2 / {df}))"
    u = "(1 / (1 + 0.3275911 * z_ / sqrt(2)))"
    p = f"{u} * (0.254829592 + {u} * (-0.284496736 + {u} * (1.421413741 + {u} * (-1.453152027 + {u} * 1.061405429)))) * exp(-z_ * z_ / 2)"
    return f"SELECT *, {p} AS p_value, {estimate} - {q} * {se} AS ci_lower, {estimate} + {q} * {se} AS ci_upper FROM (SELECT *, {z} AS z_ FROM ({sql}))"


def query(sql: str | None = None, exact: str = "", doubles: str = "", interval: str = "") -> Callable[[Query], Query]:
    """Registers a query; the SQL's columns are ``exact`` as they are and ``doubles`` rounded.  ``interval`` names estimate, error and, for Student's t, degrees of freedom."""
    if sql and interval:
        estimate, se, *df = interval.split()
        sql, doubles = _interval(sql, estimate, se, df[0] if df else None), doubles + " p_value ci_lower ci_upper"

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.round(c, PLACES).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = "SELECT " + ", ".join([*exact.split(), *[f"round({c}, {PLACES}) AS {c}" for c in doubles.split()]]) + f" FROM ({sql})"
        return f

    return register


@query(f"""SELECT segment, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS estimate, sqrt(q1 + q0) AS se, (q1 + q0) ** 2 / (q1 ** 2 / (n1 - 1) + q0 ** 2 / (n0 - 1)) AS df, n1 AS n_treated, n0 AS n_control
    FROM {LINES} JOIN (SELECT segment, var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) AS q1, var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0) AS q0,
    count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0 FROM {LINES} GROUP BY 1) USING (segment) GROUP BY segment, q1, q0, n1, n0""", "segment n_treated n_control", "estimate se df", "estimate se df")
def ate_simple(spark: SparkSession, sf: str) -> DataFrame:
    return E.simple_ate(S.line_items(spark, sf), "y", "t", ["segment"])


@query(f"""SELECT sum(n * d) / sum(n) AS estimate, sqrt(sum(n * n * q)) / sum(n) AS se, count(*) AS n_strata, 0 AS n_left_out, sum(n)::BIGINT AS n, min(n) - 2 AS df FROM (SELECT stratum, count(*) AS n,
    avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS d, var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0) AS q FROM {LINES} GROUP BY 1)""", "n_strata n_left_out n df", "estimate se", "estimate se df")
def ate_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratified_ate(S.line_items(spark, sf), "y", "t", "stratum")


_P = f"(SELECT *, avg(t) OVER (PARTITION BY stratum, x1) AS p FROM {LINES})"


@query(f"""WITH r AS (SELECT *, CASE WHEN t = 1 THEN 1 / p ELSE 1 / (1 - p) END AS w FROM {_P} WHERE p > 0 AND p < 1), m AS (SELECT t, sum(w * y) / sum(w) AS m, sum(w) AS w, sum(w * w) AS ww FROM r GROUP BY 1),
    v AS (SELECT r.t, sum(r.w * r.w * (y - m) ** 2) / any_value(m.w) ** 2 AS v, count(*) AS n FROM r JOIN m ON r.t = m.t GROUP BY 1)
    SELECT max(m) FILTER (t = 1) - max(m) FILTER (t = 0) AS estimate, sqrt(sum(v)) AS se, max(w * w / ww) FILTER (t = 1) AS ess_treated, max(w * w / ww) FILTER (t = 0) AS ess_control, sum(n)::BIGINT AS n FROM m JOIN v USING (t)""", "n", "estimate se ess_treated ess_control", "estimate se")
def ate_weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf)
    p = rows.groupBy("stratum", "x1").agg(F.avg("t").alias("p")).where("p > 0 AND p < 1")
    return E.hajek_ate(rows.join(F.broadcast(p), ["stratum", "x1"]), "y", "t", "p")


@query(f"""WITH m AS (SELECT avg(t) AS mt, avg(x1) AS mx, avg(y) AS my, count(*) AS n FROM {LINES}), c AS (SELECT t - mt AS dt, x1 - mx AS dx, y - my AS dy, n FROM {LINES}, m),
    s AS (SELECT sum(dt * dt) AS tt, sum(dx * dx) AS xx, sum(dt * dx) AS tx, sum(dt * dy) AS ty, sum(dx * dy) AS xy, sum(dy * dy) AS yy FROM c),
    b AS (SELECT *, tt * xx - tx * tx AS det, (xx * ty - tx * xy) / (tt * xx - tx * tx) AS bt, (tt * xy - tx * ty) / (tt * xx - tx * tx) AS bx FROM s),
    e AS (SELECT dy - bt * dt - bx * dx AS e, 1.0 / n + (dt * dt * xx - 2 * dt * dx * tx + dx * dx * tt) / det AS h, (xx * dt - tx * dx) / det AS k, n FROM c, b)
    SELECT any_value(bt) AS estimate, sqrt(sum(k * k * e * e / (1 - h) ** 2)) AS se, any_value(n) AS n, any_value(n) - 3 AS df, 1 - sum(e * e) / any_value(yy) AS r2 FROM e, b""", "n df", "estimate se r2", "estimate se df")
def ate_regression(spark: SparkSession, sf: str) -> DataFrame:
    return E.regression_ate(S.line_items(spark, sf), "y", "t", ["x1"])


@query("WITH a AS (SELECT unnest(['x1', 'x2', 'd']) AS covariate, unnest([x1, x2, d]) AS v, t FROM " + LINES + """) SELECT covariate, (avg(v) FILTER (t = 1) - avg(v) FILTER (t = 0)) / sqrt((var_samp(v) FILTER (t = 1) + var_samp(v) FILTER (t = 0)) / 2) AS smd,
    var_samp(v) FILTER (t = 1) / var_samp(v) FILTER (t = 0) AS variance_ratio FROM a GROUP BY 1""", "covariate", "smd variance_ratio")
def balance(spark: SparkSession, sf: str) -> DataFrame:
    return E.smd_table(S.line_items(spark, sf), "t", ["x1", "x2", "d"])


_MANSKI = f"""(SELECT *, p * m1 + (1 - p) * lo AS a_lo, p * m1 + (1 - p) * hi AS a_hi, (1 - p) * m0 + p * lo AS b_lo, (1 - p) * m0 + p * hi AS b_hi, m1 - m0 AS naive
    FROM (SELECT segment, min(y) AS lo, max(y) AS hi, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0, avg(t) AS p, count(*) AS n FROM {LINES} GROUP BY 1))"""
_MANSKI_ROWS = f"""(SELECT *, upper - lower AS width FROM (SELECT segment, naive, n, unnest(['none', 'response_up', 'response_down', 'selection', 'selection_response_up', 'selection_response_down']) AS assumption,
    unnest([a_lo - b_hi, 0, a_lo - b_hi, a_lo - b_hi, 0, least(naive, 0)]) AS lower, unnest([a_hi - b_lo, a_hi - b_lo, 0, naive, greatest(naive, 0), 0]) AS upper FROM {_MANSKI}))"""


@query(f"SELECT * FROM {_MANSKI_ROWS}", "segment assumption n", "naive lower upper width")
def bounds_manski(spark: SparkSession, sf: str) -> DataFrame:
    return E.manski_bounds(S.line_items(spark, sf), "y", "t", ["segment"])


@query(f"SELECT segment, arg_min(assumption, (width, assumption)) AS narrowest, arg_max(assumption, (width, assumption)) AS widest, min(width) AS least_width, max(width) AS greatest_width FROM {_MANSKI_ROWS} GROUP BY 1", "segment narrowest widest", "least_width greatest_width")
def bounds_compared(spark: SparkSession, sf: str) -> DataFrame:
    return E.narrowest_bounds(bounds_manski(spark, sf), ["segment"])


_ASSIGNED = f"""(SELECT max(y) - min(y) AS r, avg(y) FILTER (z = 1) - avg(y) FILTER (z = 0) AS itt, avg(t) FILTER (z = 1) - avg(t) FILTER (z = 0) AS g, count(*) AS n FROM {LINES})"""


@query(f"""SELECT least(greatest(sign(g) * itt / abs(g) - (1 - abs(g)) * r / abs(g), -r), r) AS lower, least(greatest(sign(g) * itt / abs(g) + (1 - abs(g)) * r / abs(g), -r), r) AS upper, abs(g) AS complier_share, itt / g AS wald, n FROM {_ASSIGNED}""", "n", "lower upper complier_share wald")
def bounds_manski_iv(spark: SparkSession, sf: str) -> DataFrame:
    return E.manski_iv(S.line_items(spark, sf), "y", "t", "z")


@query(f"SELECT (itt - 0.1 * r) / (g + 0.1) AS lower, (itt + 0.1 * r) / (g + 0.1) AS upper, itt / g AS late, n FROM {_ASSIGNED}", "n", "lower upper late")
def late_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return E.late_bounds(S.line_items(spark, sf), "y", "t", "z")


@query(f"SELECT unnest(['monotone', 'none', 'instrument']) AS assumption, unnest([itt / g - 0.5 / abs(g), -r, itt - r * (1 - g)]) AS lower, unnest([itt / g + 0.5 / abs(g), r, itt + r * (1 - g)]) AS upper, n FROM {_ASSIGNED}", "assumption n", "lower upper")
def strata_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return I.strata_bounds(S.line_items(spark, sf), "y", "t", "z", direct_effect=0.5)


@query("SELECT c.name AS \"column\", count(*) AS n, 0 AS n_null, 0 AS n_not_finite, count(*) FILTER (v NOT IN (0, 1)) AS n_not_binary, min(v) AS least, max(v) AS greatest, stddev_pop(v) AS spread FROM (SELECT unnest(['y', 't', 'x1']) AS name, unnest([y::DOUBLE, t, x1]) AS v FROM " + LINES + ") c GROUP BY 1", '"column" n n_null n_not_finite n_not_binary', "least greatest spread")
def input_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.input_report(S.line_items(spark, sf), ["y", "t", "x1"])


@query(f"SELECT q1 - q0 AS estimate, sqrt(q * (1 - q) * (1 / n1 + 1 / n0)) AS se, q1 AS observed_treated, q0 AS observed_control FROM (SELECT avg(observed) FILTER (t = 1) AS q1, avg(observed) FILTER (t = 0) AS q0, avg(observed) AS q, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0 FROM {CUSTOMERS})", "", "estimate se observed_treated observed_control", "estimate se")
def attrition(spark: SparkSession, sf: str) -> DataFrame:
    return E.attrition_test(S.customers(spark, sf), "t", "observed")


@query(f"""WITH a AS (SELECT avg(observed) FILTER (t = 1) AS q1, avg(observed) FILTER (t = 0) AS q0, count(*) FILTER (t = 1 AND observed = 1) AS n1, count(*) FILTER (t = 0 AND observed = 1) AS n0,
    avg(y) FILTER (t = 1 AND observed = 1) AS m1, avg(y) FILTER (t = 0 AND observed = 1) AS m0 FROM {CUSTOMERS}), k AS (SELECT *, (q1 >= q0)::INT AS arm, floor(abs(q1 - q0) / greatest(q1, q0) * CASE WHEN q1 >= q0 THEN n1 ELSE n0 END)::BIGINT AS cut FROM a),
    r AS (SELECT y, row_number() OVER (ORDER BY y) AS up, row_number() OVER (ORDER BY y DESC) AS down, cut FROM {CUSTOMERS} c JOIN k ON c.t = k.arm WHERE observed = 1),
    m AS (SELECT avg(y) FILTER (down > cut) AS below, avg(y) FILTER (up > cut) AS above FROM r)
    SELECT CASE WHEN arm = 1 THEN below - m0 ELSE m1 - above END AS lower, CASE WHEN arm = 1 THEN above - m0 ELSE m1 - below END AS upper, cut AS n_trimmed, abs(q1 - q0) / greatest(q1, q0) AS share, n0 + n1 AS n_observed FROM k, m""", "n_trimmed n_observed", "lower upper share")
def bounds_lee(spark: SparkSession, sf: str) -> DataFrame:
    return E.lee_bounds(S.customers(spark, sf), "y", "t", "observed")


_TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"""WITH q AS (SELECT segment, t, quantile_cont(y, {[*_TAUS, 0.25, 0.75]}) AS q, stddev_samp(y) AS sd, count(*) AS n FROM {LINES} GROUP BY 1, 2), h AS (SELECT *, 1.06 * least(sd, (q[7] - q[6]) / 1.34) * n ** -0.2 AS h FROM q),
    e AS (SELECT segment, t, n, h, unnest({_TAUS}::DOUBLE[]) AS tau, unnest(q[1:5]) AS v FROM h), f AS (SELECT e.segment, e.t, tau, any_value(v) AS v, any_value(e.n) AS n, avg(exp(-0.5 * pow((y - v) / h, 2)) / (h * sqrt(2 * pi()))) AS f FROM e JOIN {LINES} l ON e.segment = l.segment AND e.t = l.t GROUP BY 1, 2, 3)
    SELECT segment, tau, max(v) FILTER (t = 1) - max(v) FILTER (t = 0) AS qte, sqrt(sum(tau * (1 - tau) / (n * f * f))) AS se, sum(n)::BIGINT AS n FROM f GROUP BY 1, 2""", "segment n", "tau qte se", "qte se")
def quantile_effects(spark: SparkSession, sf: str) -> DataFrame:
    return E.quantile_effects(S.line_items(spark, sf), "y", "t", _TAUS, ["segment"])


@query(f"""WITH c AS (SELECT quantile_cont(nation, [0.2, 0.4, 0.6, 0.8]) AS c FROM {CUSTOMERS}), d AS (SELECT t, y, observed, (nation >= c[1])::INT + (nation >= c[2])::INT + (nation >= c[3])::INT + (nation >= c[4])::INT AS s FROM {CUSTOMERS}, c),
    a AS (SELECT s, count(*) AS size, avg(observed) FILTER (t = 1) AS q1, avg(observed) FILTER (t = 0) AS q0, count(*) FILTER (t = 1 AND observed = 1) AS n1, count(*) FILTER (t = 0 AND observed = 1) AS n0, avg(y) FILTER (t = 1 AND observed = 1) AS m1, avg(y) FILTER (t = 0 AND observed = 1) AS m0 FROM d GROUP BY 1),
    k AS (SELECT *, (q1 >= q0)::INT AS arm, floor(abs(q1 - q0) / greatest(q1, q0) * CASE WHEN q1 >= q0 THEN n1 ELSE n0 END)::BIGINT AS cut FROM a),
    r AS (SELECT d.s, y, cut, row_number() OVER (PARTITION BY d.s ORDER BY y) AS up, row_number() OVER (PARTITION BY d.s ORDER BY y DESC) AS down FROM d JOIN k ON d.s = k.s AND d.t = k.arm WHERE observed = 1),
    m AS (SELECT s, avg(y) FILTER (down > cut) AS below, avg(y) FILTER (up > cut) AS above FROM r GROUP BY 1), b AS (SELECT size, CASE WHEN arm = 1 THEN below - m0 ELSE m1 - above END AS lo, CASE WHEN arm = 1 THEN above - m0 ELSE m1 - below END AS hi FROM k JOIN m USING (s))
    SELECT sum(size * lo) / sum(size) AS lower, sum(size * hi) / sum(size) AS upper, count(*) AS n_strata, 0 AS n_left_out FROM b""", "n_strata n_left_out", "lower upper")
def bounds_lee_tightened(spark: SparkSession, sf: str) -> DataFrame:
    return E.lee_bounds_tightened(S.customers(spark, sf), "y", "t", "observed", "nation")


@query(f"""WITH m AS (SELECT z, avg(y) AS my, avg(t) AS md, var_samp(y) / count(*) AS vy, var_samp(t) / count(*) AS vd, covar_samp(y, t) / count(*) AS c, count(*) AS n FROM {LINES} GROUP BY 1),
    w AS (SELECT max(my) FILTER (z = 1) - max(my) FILTER (z = 0) AS itt, max(md) FILTER (z = 1) - max(md) FILTER (z = 0) AS first_stage, sum(vy) AS vy, sum(vd) AS vd, sum(c) AS c, sum(n)::BIGINT AS n FROM m)
    SELECT itt / first_stage AS late, sqrt(vy - 2 * (itt / first_stage) * c + (itt / first_stage) ** 2 * vd) / abs(first_stage) AS se, itt, first_stage, first_stage ** 2 / vd AS first_stage_f, first_stage AS compliers, (SELECT md FROM m WHERE z = 0) AS always, 1 - (SELECT md FROM m WHERE z = 1) AS never, n FROM w""", "n", "late se itt first_stage first_stage_f compliers always never", "late se")
def late_wald(spark: SparkSession, sf: str) -> DataFrame:
    return E.wald_late(S.line_items(spark, sf), "y", "t", "z")


@query(f"""WITH p AS (SELECT stratum, x1, avg(t) AS p, avg(y) FILTER (t = 1) AS mu1, avg(y) FILTER (t = 0) AS mu0 FROM {LINES} GROUP BY 1, 2 HAVING avg(t) > 0 AND avg(t) < 1),
    r AS (SELECT mu1 - mu0 + t * (y - mu1) / p - (1 - t) * (y - mu0) / (1 - p) AS psi FROM {LINES} JOIN p USING (stratum, x1)) SELECT avg(psi) AS estimate, stddev_pop(psi) / sqrt(count(*)) AS se, count(*) AS n, 0 AS n_clipped FROM r""", "n n_clipped", "estimate se", "estimate se")
def ate_doubly_robust(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf)
    arm = lambda a: F.avg(F.when(F.col("t") == a, F.col("y")))
    fits = rows.groupBy("stratum", "x1").agg(F.avg("t").alias("p"), arm(0).alias("mu0"), arm(1).alias("mu1")).where("p > 0 AND p < 1")
    return E.doubly_robust(rows.join(F.broadcast(fits), ["stratum", "x1"]), "y", "t", F.col("p"), F.col("mu0"), F.col("mu1"))


@query(f"""WITH c AS (SELECT t, post, avg(y) AS m, var_samp(y) / count(*) AS q, count(*) AS n FROM {ORDERS} GROUP BY 1, 2) SELECT sum(CASE WHEN t = post THEN m ELSE -m END) AS estimate, sqrt(sum(q)) AS se, sum(n)::BIGINT AS n FROM c""", "n", "estimate se", "estimate se")
def did_two_by_two(spark: SparkSession, sf: str) -> DataFrame:
    return P.did_2x2(S.orders(spark, sf), "y", "t", "post")


@query(f"""WITH b AS (SELECT t, post, avg(y) AS m, count(*) AS n FROM {ORDERS} GROUP BY 1, 2),
    s AS (SELECT unit, sum((CASE WHEN o.t = o.post THEN 1 ELSE -1 END) * (y - m) / b.n) AS s FROM {ORDERS} o JOIN b ON o.t = b.t AND o.post = b.post GROUP BY 1),
    k AS (SELECT sum(CASE WHEN t = post THEN m ELSE -m END) AS estimate, sum(n)::BIGINT AS n FROM b)
    SELECT estimate, sqrt((SELECT sum(s * s) * count(*) / (count(*) - 1) FROM s) * (n - 1) / (n - 4)) AS se, n, (SELECT count(*) - 1 FROM s) AS df FROM k""", "n df", "estimate se", "estimate se df")
def did_clustered(spark: SparkSession, sf: str) -> DataFrame:
    return P.did_regression(S.orders(spark, sf), "y", "t", "post", "unit").drop("r2")


_PANEL = f"(SELECT priority AS unit, quarter, avg(y) AS y, avg((status = 'F')::INT) AS d FROM {ORDERS} GROUP BY 1, 2)"


@query(f"""WITH p AS {_PANEL}, w AS (SELECT unit, quarter, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY quarter) + avg(y) OVER () AS y, d - avg(d) OVER (PARTITION BY unit) - avg(d) OVER (PARTITION BY quarter) + avg(d) OVER () AS d FROM p),
    b AS (SELECT sum(y * d) / sum(d * d) AS b, sum(d * d) AS dd, count(*) AS n, count(DISTINCT unit) AS u, count(DISTINCT quarter) AS q FROM w), s AS (SELECT unit, sum(d * (y - b * d)) AS s FROM w, b GROUP BY 1)
    SELECT any_value(b) AS estimate, sqrt(sum(s * s) * any_value(u / (u - 1) * (n - 1) / (n - 1 - (u + q - 1)))) / any_value(dd) AS se, any_value(n) AS n, any_value(u - 1) AS df FROM s, b""", "n df", "estimate se")
def twfe_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = S.orders(spark, sf).groupBy(F.col("priority").alias("unit"), "quarter").agg(F.avg("y").alias("y"), F.avg((F.col("status") == "F").cast("double")).alias("d"))
    # Of five clusters the t law's expansion in the SQL would not do for the interval.
    return P.twfe(panel, "y", "d", "unit", "quarter").drop("p_value", "ci_lower", "ci_upper")


_COHORT = f"""(SELECT *, CASE unit % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 END AS g FROM (SELECT unit, quarter // 4 AS year, avg(y) AS y FROM {ORDERS} GROUP BY 1, 2))"""


@query(f"""WITH p AS {_COHORT}, c AS (SELECT DISTINCT g AS cohort FROM p WHERE g IS NOT NULL), b AS (SELECT unit, cohort, y AS y0 FROM p JOIN c ON p.year = c.cohort - 1),
    x AS (SELECT cohort, year, g, y - y0 AS dy FROM p JOIN b ON p.unit = b.unit AND p.year >= cohort)
    SELECT cohort, year AS period, avg(dy) FILTER (g = cohort) - avg(dy) FILTER (g IS NULL OR g > year) AS att, count(*) FILTER (g = cohort) AS n_treated, count(*) FILTER (g IS NULL OR g > year) AS n_control
    FROM x GROUP BY 1, 2 HAVING count(*) FILTER (g = cohort) > 0 AND count(*) FILTER (g IS NULL OR g > year) > 0""", "cohort period n_treated n_control", "att")
def did_group_time(spark: SparkSession, sf: str) -> DataFrame:
    return P.group_time_effects(_cohorts(spark, sf), "y", "unit", "year", "g")


def _cohorts(spark: SparkSession, sf: str) -> DataFrame:
    panel = S.orders(spark, sf).groupBy("unit", F.floor(F.col("quarter") / 4).cast("long").alias("year")).agg(F.avg("y").alias("y"))
    g = F.when(F.col("unit") % 3 == 0, 5).when(F.col("unit") % 3 == 1, 7).cast("long")
    return panel.withColumn("g", g)


@query(f"SELECT period - cohort AS event_time, sum(att * n_treated) / sum(n_treated) AS att FROM (SELECT cohort, year AS period, avg(dy) FILTER (g = cohort) - avg(dy) FILTER (g IS NULL OR g > year) AS att, count(*) FILTER (g = cohort) AS n_treated, count(*) FILTER (g IS NULL OR g > year) AS n_control FROM (SELECT cohort, p.year, g, p.y - y0 AS dy FROM {_COHORT} p JOIN (SELECT unit, cohort, y AS y0 FROM {_COHORT} q JOIN (VALUES (5), (7)) v(cohort) ON q.year = cohort - 1) b ON p.unit = b.unit AND p.year >= cohort) GROUP BY 1, 2) WHERE n_treated > 0 AND n_control > 0 GROUP BY 1", "event_time", "att")
def did_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return P.aggregate_effects(did_group_time(spark, sf), "dynamic")


@query("""WITH d AS (SELECT event_type AS series, ts::DATE AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT series, day, v, v - avg(v) OVER (PARTITION BY series) AS e FROM d),
    l AS (SELECT series, v, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM c WINDOW w AS (PARTITION BY series ORDER BY day))
    SELECT series, avg(v) AS mean, sqrt(greatest(sum(e * e) + 2 * (0.75 * coalesce(sum(e * e1), 0) + 0.5 * coalesce(sum(e * e2), 0) + 0.25 * coalesce(sum(e * e3), 0)), 0)) / count(*) AS se, count(*) AS n FROM l GROUP BY 1""", "series n", "mean se", "mean se")
def hac_mean(spark: SparkSession, sf: str) -> DataFrame:
    return P.newey_west_mean(S.daily_events(spark, sf), "series", "day", "v", 3)


@query("""WITH d AS (SELECT event_type AS series, ts::DATE AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT series, day, v, n, lag(v, 1) OVER w AS v_l1, lag(v, 2) OVER w AS v_l2, lag(n, 1) OVER w AS n_l1, lag(n, 2) OVER w AS n_l2,
    row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY series ORDER BY day)) SELECT * FROM l WHERE r > 2""", "series day n n_l1 n_l2", "v v_l1 v_l2")
def lagged_design(spark: SparkSession, sf: str) -> DataFrame:
    return P.lagged(S.daily_events(spark, sf), "series", "day", ["v", "n"], 2)


@query(f"""WITH c AS (SELECT z - avg(z) OVER () AS z, t - avg(t) OVER () AS t, y - avg(y) OVER () AS y FROM {LINES}), s AS (SELECT sum(z * z) AS zz, sum(z * t) AS zt, sum(z * y) AS zy, sum(t * t) AS tt, sum(y * y) AS yy, count(*) AS n FROM c)
    SELECT zy / zt AS estimate, sqrt((yy - zy * zy / zz) / (n - 2) / (zt * zt / zz)) AS se, (zt * zt / zz) / ((tt - zt * zt / zz) / (n - 2)) AS first_stage_f, zt * zt / zz / tt AS first_stage_r2, n, n - 2 AS df FROM s""", "n df", "estimate se first_stage_f first_stage_r2", "estimate se df")
def iv_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return I.tsls(S.line_items(spark, sf), "y", "t", ["z"])


def _rdd(by: str, where: str = "true", h: str = "15", y: str = "y") -> str:
    """Level, its variance and covariance with that of t, per side of 25, by local lines with a triangular kernel."""
    return f"""(WITH r AS (SELECT {by}, (x1 >= 25)::INT AS side, x1 - 25 AS r, {y} AS y, t, 1 - abs(x1 - 25) / {h} AS k FROM {LINES} WHERE abs(x1 - 25) < {h} AND {where}),
    s AS (SELECT {by}, side, sum(k) AS s0, sum(k * r) AS s1, sum(k * r * r) AS s2, sum(k * y) AS y0, sum(k * r * y) AS y1, sum(k * t) AS d0, sum(k * r * t) AS d1, count(*) AS n FROM r GROUP BY {by}, side),
    c AS (SELECT *, s0 * s2 - s1 * s1 AS det, (s2 * y0 - s1 * y1) / det AS ay, (s0 * y1 - s1 * y0) / det AS by_, (s2 * d0 - s1 * d1) / det AS ad, (s0 * d1 - s1 * d0) / det AS bd FROM s),
    e AS (SELECT r.*, n, ay, ad, y - ay - by_ * r AS ey, t - ad - bd * r AS ed, k * (s2 - s1 * r) / det AS w FROM r JOIN c USING ({by}, side))
    SELECT {by}, side, any_value(n) AS n, any_value(ay) AS ay, any_value(ad) AS ad, sum(w * w * ey * ey) AS vy, sum(w * w * ey * ed) AS vyd, sum(w * w * ed * ed) AS vd FROM e GROUP BY {by}, side)"""


@query(f"SELECT h.segment, h.ay - l.ay AS estimate, sqrt(h.vy + l.vy) AS se, l.n AS n_left, h.n AS n_right, l.n + h.n - 4 AS df FROM {_rdd('segment')} h JOIN {_rdd('segment')} l ON h.segment = l.segment AND h.side = 1 AND l.side = 0", "segment n_left n_right df", "estimate se", "estimate se df")
def rdd_sharp(spark: SparkSession, sf: str) -> DataFrame:
    return D.sharp_rdd(S.line_items(spark, sf), "y", "x1", 25.0, 15.0, ["segment"])


@query(f"""SELECT segment, estimate, sqrt(vy - 2 * estimate * vyd + estimate ** 2 * vd) / abs(first_stage) AS se, first_stage, first_stage ** 2 / vd AS first_stage_f, abs(first_stage) AS compliance, n_left, n_right, n_left + n_right - 4 AS df
    FROM (SELECT h.segment, (h.ay - l.ay) / (h.ad - l.ad) AS estimate, h.ad - l.ad AS first_stage, h.vy + l.vy AS vy, h.vyd + l.vyd AS vyd, h.vd + l.vd AS vd, l.n AS n_left, h.n AS n_right FROM {_rdd('segment')} h JOIN {_rdd('segment')} l ON h.segment = l.segment AND h.side = 1 AND l.side = 0)""",
    "segment n_left n_right df", "estimate se first_stage first_stage_f compliance", "estimate se df")
def rdd_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return D.fuzzy_rdd(S.line_items(spark, sf), "y", "t", "x1", 25.0, 15.0, ["segment"])


def _rdd_all(h: str, where: str = "true") -> str:
    return f"SELECT h.ay - l.ay AS estimate, sqrt(h.vy + l.vy) AS se, l.n AS n_left, h.n AS n_right, l.n + h.n - 4 AS df FROM {_rdd('1 AS g', where, h).replace('GROUP BY 1 AS g', 'GROUP BY g').replace('USING (1 AS g', 'USING (g').replace('SELECT 1 AS g, side, any', 'SELECT g, side, any').replace('SELECT 1 AS g, side, sum', 'SELECT g, side, sum')} h JOIN {_rdd('1 AS g', where, h).replace('GROUP BY 1 AS g', 'GROUP BY g').replace('USING (1 AS g', 'USING (g').replace('SELECT 1 AS g, side, any', 'SELECT g, side, any').replace('SELECT 1 AS g, side, sum', 'SELECT g, side, sum')} l ON h.side = 1 AND l.side = 0"


@query(" UNION ALL ".join(f"SELECT {15.0 * f}::DOUBLE AS bandwidth, * FROM ({_rdd_all(str(15.0 * f))})" for f in (0.5, 0.75, 1.0, 1.5)), "n_left n_right df", "bandwidth estimate se", "estimate se df")
def rdd_bandwidths(spark: SparkSession, sf: str) -> DataFrame:
    return D.bandwidth_sensitivity(S.line_items(spark, sf), "y", "x1", 25.0, 15.0, (0.5, 0.75, 1.0, 1.5))


@query(" UNION ALL ".join(f"SELECT {d}::DOUBLE AS hole, * FROM ({_rdd_all('15', f'abs(x1 - 25) >= {d}')})" for d in (0.0, 1.0, 2.0, 4.0)), "n_left n_right df", "hole estimate se", "estimate se df")
def rdd_donut(spark: SparkSession, sf: str) -> DataFrame:
    return D.donut_rdd(S.line_items(spark, sf), "y", "x1", 25.0, 15.0, [0.0, 1.0, 2.0, 4.0])


@query("SELECT floor((o_totalprice - 200000) / 5000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1", "bin n")
def density_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return D.histogram(S.orders(spark, sf), "y", 200_000.0, 5_000.0)


@query()
def bunching_mass(spark: SparkSession, sf: str) -> DataFrame:
    return D.bunching(S.orders(spark, sf), "y", 200_000.0, 5_000.0, 3, within=(-200, 199), rates=(0.1, 0.2), replicates=50)


@query(f"""WITH c AS (SELECT y AS s, min(id) AS c FROM {CUSTOMERS} WHERE t = 0 GROUP BY 1), m AS (SELECT a.id AS treated_id, c.c AS control_id, abs(a.y - c.s) AS distance, c.s FROM {CUSTOMERS} a JOIN c ON abs(a.y - c.s) <= 5 WHERE a.t = 1)
    SELECT treated_id, control_id, distance, 1 AS match FROM m QUALIFY row_number() OVER (PARTITION BY treated_id ORDER BY distance, s, control_id) = 1""", "treated_id control_id match", "distance")
def match_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return M.nearest_match(S.customers(spark, sf), "id", "t", "y", 5.0)


_FOLDS = f"(SELECT f, regr_slope(y, x1) AS by_, regr_intercept(y, x1) AS ay, regr_slope(t, x1) AS bt, regr_intercept(t, x1) AS at_, regr_slope(d, x1) AS bd, regr_intercept(d, x1) AS ad FROM {LINES} JOIN (SELECT unnest(range(5)) AS f) ON id % 5 <> f GROUP BY 1)"


@query(f"""WITH r AS (SELECT y - ay - by_ * x1 AS ry, t - least(greatest(at_ + bt * x1, 0.01), 0.99) AS rt FROM {LINES} JOIN {_FOLDS} ON id % 5 = f), b AS (SELECT sum(rt * ry) / sum(rt * rt) AS b, avg(rt * rt) AS j, count(*) AS n FROM r)
    SELECT any_value(b) AS estimate, sqrt(var_samp(rt * (ry - b * rt) / j) / any_value(n)) AS se, any_value(n) AS n FROM r, b""", "n", "estimate se", "estimate se")
def dml_partial_linear(spark: SparkSession, sf: str) -> DataFrame:
    return L.double_ml(S.line_items(spark, sf), "y", "t", ["x1"], F.col("id") % 5)


@query(f"""WITH r AS (SELECT f AS fold, y, d, y - ay - by_ * x1 AS ry, d - ad - bd * x1 AS rt FROM {LINES} JOIN {_FOLDS} ON id % 5 = f), g AS (SELECT * FROM r UNION ALL SELECT NULL, y, d, ry, rt FROM r), b AS (SELECT fold, sum(rt * ry) / sum(rt * rt) AS b, avg(rt * rt) AS j, count(*) AS n FROM g GROUP BY 1)
    SELECT g.fold, any_value(b) AS estimate, sqrt(var_samp(rt * (ry - b * rt) / j) / any_value(n)) AS se, any_value(n) AS n, 1 - sum(rt * rt) / (var_pop(d) * count(*)) AS r2_treatment, 1 - sum(ry * ry) / (var_pop(y) * count(*)) AS r2_outcome FROM g JOIN b ON g.fold IS NOT DISTINCT FROM b.fold GROUP BY 1""", "fold n", "estimate se r2_treatment r2_outcome", "estimate se")
def dml_continuous(spark: SparkSession, sf: str) -> DataFrame:
    return L.double_ml_continuous(S.line_items(spark, sf), "y", "d", ["x1"], F.col("id") % 5)


_ARM_FOLDS = f"""(SELECT f, regr_slope(y, x1) FILTER (t = 1) AS b1, regr_intercept(y, x1) FILTER (t = 1) AS a1, regr_slope(y, x1) FILTER (t = 0) AS b0, regr_intercept(y, x1) FILTER (t = 0) AS a0, regr_slope(t, x1) AS bt, regr_intercept(t, x1) AS at_ FROM {LINES} JOIN (SELECT unnest(range(5)) AS f) ON id % 5 <> f GROUP BY 1)"""
_SCORED = f"(SELECT y, t, a1 + b1 * x1 AS g1, a0 + b0 * x1 AS g0, least(greatest(at_ + bt * x1, 0.025), 0.975) AS p FROM {LINES} JOIN {_ARM_FOLDS} ON id % 5 = f)"


@query(f"SELECT avg(s) AS estimate, sqrt(var_samp(s) / count(*)) AS se, count(*) AS n FROM (SELECT g1 - g0 + t * (y - g1) / p - (1 - t) * (y - g0) / (1 - p) AS s FROM {_SCORED})", "n", "estimate se", "estimate se")
def dml_interactive(spark: SparkSession, sf: str) -> DataFrame:
    return L.interactive_dml(S.line_items(spark, sf), "y", "t", ["x1"], F.col("id") % 5)


@query(f"""WITH a AS (SELECT t, t * (y - g0) - (1 - t) * p / (1 - p) * (y - g0) AS a FROM {_SCORED}), m AS (SELECT avg(a) / avg(t) AS b, avg(t) AS q FROM a) SELECT any_value(b) AS estimate, sqrt(var_samp((a - t * b) / q) / count(*)) AS se, count(*) AS n FROM a, m""", "n", "estimate se", "estimate se")
def dml_treated(spark: SparkSession, sf: str) -> DataFrame:
    return L.interactive_dml(S.line_items(spark, sf), "y", "t", ["x1"], F.col("id") % 5, target="atte")


@query(f"""WITH c AS (SELECT corr(y, x1) AS a, corr(y, t) AS b, corr(x1, t) AS c, count(*) AS n FROM {LINES}), p AS (SELECT 'y' AS a, 'x1' AS b, c.a AS correlation, (c.a - c.b * c.c) / sqrt((1 - c.b ** 2) * (1 - c.c ** 2)) AS partial, n FROM c
    UNION ALL SELECT 'y', 't', c.b, (c.b - c.a * c.c) / sqrt((1 - c.a ** 2) * (1 - c.c ** 2)), n FROM c UNION ALL SELECT 'x1', 't', c.c, (c.c - c.a * c.b) / sqrt((1 - c.a ** 2) * (1 - c.b ** 2)), n FROM c)
    SELECT *, atanh(partial) * sqrt(n - 4) AS z FROM p""", "a b n", "correlation partial z")
def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return A.partial_correlations(S.line_items(spark, sf), ["y", "x1", "t"]).drop("p_value")


@query(f"""WITH n AS (SELECT priority, status, post, count(*) AS n FROM {ORDERS} GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY post, priority) AS na, sum(n) OVER (PARTITION BY post, status) AS nb, sum(n) OVER (PARTITION BY post) AS ns FROM n),
    g AS (SELECT post, sum(2 * n * ln(n * ns / (na * nb))) AS g, (count(DISTINCT priority) - 1) * (count(DISTINCT status) - 1) AS df FROM m GROUP BY 1) SELECT sum(g) AS g, sum(df)::BIGINT AS df, 0 AS n_left_out FROM g""", "df n_left_out", "g")
def g_squared_test(spark: SparkSession, sf: str) -> DataFrame:
    return A.g_squared(S.orders(spark, sf), "priority", "status", ["post"]).drop("p_value")


@query(f"""WITH m AS (SELECT avg(t) AS mt, avg(x1) AS mx, avg(y) AS my, count(*) AS n FROM {LINES}), c AS (SELECT t - mt AS t, x1 - mx AS x, y - my AS y, n FROM {LINES}, m), s AS (SELECT sum(t * t) AS tt, sum(x * x) AS xx, sum(t * x) AS tx, sum(t * y) AS ty, sum(x * y) AS xy, any_value(n) AS n FROM c),
    b AS (SELECT *, tt * xx - tx * tx AS det, tx / tt AS a, (xx * ty - tx * xy) / (tt * xx - tx * tx) AS bt, (tt * xy - tx * ty) / (tt * xx - tx * tx) AS bm FROM s),
    e AS (SELECT t * (x - a * t) / tt / (1 - 1.0 / b.n - t * t / tt) AS sa, (xx * t - tx * x) / det * (y - bt * t - bm * x) / (1 - 1.0 / b.n - (t * t * xx - 2 * t * x * tx + x * x * tt) / det) AS st, (tt * x - tx * t) / det * (y - bt * t - bm * x) / (1 - 1.0 / b.n - (t * t * xx - 2 * t * x * tx + x * x * tt) / det) AS sm, a, bt, bm, b.n FROM c, b)
    SELECT bt AS direct, sqrt(vt) AS se_direct, a * bm AS indirect, sqrt(a * a * vm + bm * bm * va) AS se_indirect, bt + a * bm AS total, a * bm / (bt + a * bm) AS mediated, n FROM (SELECT any_value(a) AS a, any_value(bt) AS bt, any_value(bm) AS bm, any_value(n) AS n, sum(sa * sa) AS va, sum(st * st) AS vt, sum(sm * sm) AS vm FROM e)""",
    "n", "direct se_direct indirect se_indirect total mediated", "indirect se_indirect")
def mediation_baron_kenny(spark: SparkSession, sf: str) -> DataFrame:
    return A.baron_kenny(S.line_items(spark, sf), "y", "t", "x1")


_RANKS = f"""(SELECT count(*) AS n, sum(r) FILTER (d > 0) AS t_plus, sum(r) AS sum_r, sum(r * r) AS sum_rr FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r
    FROM (SELECT round(y / 100) * 100 - 4000 AS d FROM {CUSTOMERS}) WHERE d <> 0))"""


@query(f"SELECT g AS gamma, (t_plus - g / (1 + g) * sum_r) / sqrt(g / (1 + g) / (1 + g) * sum_rr) AS z_lower, (t_plus - 1 / (1 + g) * sum_r) / sqrt(g / (1 + g) / (1 + g) * sum_rr) AS z_upper FROM {_RANKS}, (SELECT unnest([1.0, 1.5, 2.0, 3.0]::DOUBLE[]) AS g)", "", "gamma z_lower z_upper")
def sensitivity_rosenbaum(spark: SparkSession, sf: str) -> DataFrame:
    ranks = A.signed_ranks(S.customers(spark, sf), F.round(F.col("y") / 100) * 100 - 4000)
    return A.rosenbaum_bounds(ranks, [1.0, 1.5, 2.0, 3.0]).select("gamma", "z_lower", "z_upper")


@query(f"""SELECT priority, rr, greatest(rr, 1 / rr) + sqrt(greatest(rr, 1 / rr) * (greatest(rr, 1 / rr) - 1)) AS e_value FROM (SELECT priority, avg((status = 'F')::INT) FILTER (t = 1) / avg((status = 'F')::INT) FILTER (t = 0) AS rr FROM {ORDERS} GROUP BY 1)""", "priority", "rr e_value")
def sensitivity_e_value(spark: SparkSession, sf: str) -> DataFrame:
    f = (F.col("status") == "F").cast("double")
    rr = S.orders(spark, sf).groupBy("priority").agg((F.avg(F.when(F.col("t") == 1, f)) / F.avg(F.when(F.col("t") == 0, f))).alias("rr"))
    return A.e_values(rr, "rr")


@query()
def bootstrap_ate(spark: SparkSession, sf: str) -> DataFrame:
    return R.bootstrap_means(S.line_items(spark, sf), "y", "t", "id", 50)


def _paths(spark: SparkSession, sf: str, placebo: bool) -> DataFrame:
    panel = S.orders(spark, sf).groupBy((F.col("unit") % 15).alias("unit"), "quarter").agg(F.avg("y").alias("y"))
    panel = panel.withColumn("first", F.when(F.col("unit") < 2, 20))
    return Z.synthetic_paths(panel, Z.synthetic_weights(panel, "unit", "quarter", "y", "first", placebo), "unit", "quarter", "y", "first")


@query()
def synthetic_control_path(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf, False)


@query()
def synthetic_control_placebo(spark: SparkSession, sf: str) -> DataFrame:
    return Z.placebo_p_values(Z.synthetic_effects(_paths(spark, sf, True)))


_IV = f"""(SELECT n, yy, dd, yd, (y1 * y1 * s22 - 2 * y1 * y2 * s12 + y2 * y2 * s11) / det AS qyy, (d1 * d1 * s22 - 2 * d1 * d2 * s12 + d2 * d2 * s11) / det AS qdd,
    (y1 * d1 * s22 - (y1 * d2 + y2 * d1) * s12 + y2 * d2 * s11) / det AS qyd FROM (SELECT count(*) AS n, count(*) * var_pop(y) AS yy, count(*) * var_pop(d) AS dd, count(*) * covar_pop(y, d) AS yd, count(*) * covar_pop(y, t) AS y1,
    count(*) * covar_pop(y, z) AS y2, count(*) * covar_pop(d, t) AS d1, count(*) * covar_pop(d, z) AS d2, count(*) * var_pop(t) AS s11, count(*) * var_pop(z) AS s22, count(*) * covar_pop(t, z) AS s12, s11 * s22 - s12 * s12 AS det FROM {LINES}))"""
_KAPPA = f"""(SELECT *, (m - sqrt(m * m - 4 * g * (yy * dd - yd * yd))) / (2 * g) AS k FROM (SELECT *, (yy - qyy) * (dd - qdd) - (yd - qyd) ** 2 AS g, yy * (dd - qdd) + dd * (yy - qyy) - 2 * yd * (yd - qyd) AS m FROM {_IV}))"""


def _k_class_sql(fuller: float) -> str:
    return f"""SELECT b AS estimate, sqrt((yy - 2 * b * yd + b * b * dd) / (n - 2) / qdd) AS se, kf AS kappa, n, df FROM (SELECT *, k - {fuller} / (n - 3) AS kf, (yd - kf * (yd - qyd)) / (dd - kf * (dd - qdd)) AS b, n - 2 AS df FROM {_KAPPA})"""


@query(_k_class_sql(0.0), "n df", "estimate se kappa", "estimate se df")
def iv_liml(spark: SparkSession, sf: str) -> DataFrame:
    return I.k_class(S.line_items(spark, sf), "y", "d", ["t", "z"])


@query(_k_class_sql(1.0), "n df", "estimate se kappa", "estimate se df")
def iv_fuller(spark: SparkSession, sf: str) -> DataFrame:
    return I.k_class(S.line_items(spark, sf), "y", "d", ["t", "z"], fuller=1.0)


@query()
def iv_gmm(spark: SparkSession, sf: str) -> DataFrame:
    return I.gmm(S.line_items(spark, sf), "y", "d", ["t", "z"])


@query(f"SELECT qdd / 2 / ((dd - qdd) / (n - 3)) AS f, 19.93::DOUBLE AS critical, CASE WHEN qdd / 2 / ((dd - qdd) / (n - 3)) > 19.93 THEN 'strong' WHEN qdd / 2 / ((dd - qdd) / (n - 3)) > 10 THEN 'weak' ELSE 'very_weak' END AS strength, 2::BIGINT AS n_instruments, n FROM {_IV}", "strength n_instruments n", "f critical")
def iv_strength(spark: SparkSession, sf: str) -> DataFrame:
    return I.instrument_strength(S.line_items(spark, sf), "d", ["t", "z"])


@query(f"""SELECT qyy / 2 / s AS statistic, exp(-qyy / 4 / s) AS p_value, (qyd - sqrt(qyd * qyd - qdd * c)) / qdd AS lower, (qyd + sqrt(qyd * qyd - qdd * c)) / qdd AS upper, n
    FROM (SELECT *, (yy - qyy) / (n - 3) AS s, qyy + 2 * ln(0.05) * 2 * s AS c FROM {_IV})""", "n", "statistic p_value lower upper")
def iv_anderson_rubin(spark: SparkSession, sf: str) -> DataFrame:
    return I.anderson_rubin(S.line_items(spark, sf), "y", "d", ["t", "z"])


@query()
def iv_control_function(spark: SparkSession, sf: str) -> DataFrame:
    return I.control_function(S.line_items(spark, sf), "y", "d", ["t", "z"])


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return S.line_items(spark, sf).withColumns({f: (F.col("stratum") == f).cast("int") for f in "AN"})


_S = f"(SELECT *, avg(t) OVER (PARTITION BY stratum) AS p FROM {LINES})"


@query(f"""WITH c AS (SELECT p, sum(t) AS a, sum(1 - t) AS b FROM {_S} GROUP BY 1), k AS (SELECT *, sum(b) OVER (ORDER BY p) - b AS under FROM c), m AS (SELECT avg(t) AS q, avg(CASE WHEN t = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, count(*) AS n FROM {_S})
    SELECT any_value(n) AS n, 1 - any_value(ll / (q * ln(q) + (1 - q) * ln(1 - q))) AS pseudo_r2, sum(a * (under + b / 2)) / sum(a) / sum(b) AS auc FROM k, m""", "n", "pseudo_r2 auc")
def propensity_logit(spark: SparkSession, sf: str) -> DataFrame:
    # The digits that differ between rows of one stratum by rounding are cut, so that ties stay ties.
    return O.propensity_fit(O.with_propensity(_flagged(spark, sf), "t", ["A", "N"]).withColumn("p", F.round("p", 12)), "t")


@query(f"""WITH r AS (SELECT *, CASE WHEN t = 1 THEN 1 / p ELSE 1 / (1 - p) END AS w FROM {_S}), m AS (SELECT t, sum(w * y) / sum(w) AS m, sum(w) AS w, sum(w * w) AS ww FROM r GROUP BY 1),
    v AS (SELECT r.t, sum(r.w * r.w * (y - m) ** 2) / any_value(m.w) ** 2 AS v, count(*) AS n FROM r JOIN m ON r.t = m.t GROUP BY 1)
    SELECT max(m) FILTER (t = 1) - max(m) FILTER (t = 0) AS estimate, sqrt(sum(v)) AS se, max(w * w / ww) FILTER (t = 1) AS ess_treated, max(w * w / ww) FILTER (t = 0) AS ess_control, sum(n)::BIGINT AS n, 0 AS n_clipped, 0 AS n_trimmed FROM m JOIN v USING (t)""", "n n_clipped n_trimmed", "estimate se ess_treated ess_control", "estimate se")
def ate_ipw_logit(spark: SparkSession, sf: str) -> DataFrame:
    return O.ipw_observational(_flagged(spark, sf), "y", "t", ["A", "N"])


@query(f"""WITH o AS (SELECT regr_slope(y, x1) FILTER (t = 1) AS b1, regr_intercept(y, x1) FILTER (t = 1) AS a1, regr_slope(y, x1) FILTER (t = 0) AS b0, regr_intercept(y, x1) FILTER (t = 0) AS a0 FROM {LINES}),
    r AS (SELECT a1 + b1 * x1 AS mu1, a0 + b0 * x1 AS mu0, CASE WHEN t = 1 THEN 1 / p ELSE -1 / (1 - p) END AS h, y - CASE WHEN t = 1 THEN a1 + b1 * x1 ELSE a0 + b0 * x1 END AS r, p FROM {_S}, o),
    e AS (SELECT sum(h * r) / sum(h * h) AS e FROM r), q AS (SELECT mu1 - mu0 + e * (1 / p + 1 / (1 - p)) AS g, h * (r - e * h) AS s, e FROM r, e), a AS (SELECT avg(g) AS estimate FROM q)
    SELECT any_value(estimate) AS estimate, sqrt(avg((s + g - estimate) ** 2) / count(*)) AS se, any_value(e) AS epsilon, count(*) AS n FROM q, a""", "n", "estimate se epsilon", "estimate se")
def ate_tmle(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.with_propensity(_flagged(spark, sf), "t", ["A", "N"])
    return O.tmle(O.with_outcome_models(rows, "y", "t", ["x1"]), "y", "t")


@query(f"""WITH r AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY md5('0:' || b || ':' || id)) AS k FROM {CUSTOMERS}, (SELECT unnest(range(1, 41)) AS b)), m AS (SELECT sum(t) AS n1, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS estimate FROM {CUSTOMERS}),
    g AS (SELECT b, avg(y) FILTER (k <= n1) - avg(y) FILTER (k > n1) AS g FROM r, m GROUP BY 1)
    SELECT any_value(estimate) AS estimate, (count(*) FILTER (abs(g) >= abs(estimate) * (1 - 1e-9)) + 1) / (count(*) + 1) AS p_value, count(*) FILTER (abs(g) >= abs(estimate) * (1 - 1e-9)) AS n_extreme, count(*) AS replicates FROM g, m""", "n_extreme replicates", "estimate p_value")
def permutation_ate(spark: SparkSession, sf: str) -> DataFrame:
    return O.permutation_test(S.customers(spark, sf), "y", "t", "id", 40)


_SUMMARY = "avg(cate) AS estimate, stddev_samp(cate) / sqrt(count(*)) AS se, stddev_samp(cate) AS spread, min(cate) AS least, max(cate) AS greatest, count(*) AS n"
_ARMS = f"(SELECT regr_slope(y, x1) FILTER (t = 1) AS b1, regr_intercept(y, x1) FILTER (t = 1) AS a1, regr_slope(y, x1) FILTER (t = 0) AS b0, regr_intercept(y, x1) FILTER (t = 0) AS a0 FROM {LINES})"


@query(f"SELECT segment, {_SUMMARY} FROM (SELECT segment, a1 - a0 + (b1 - b0) * x1 AS cate FROM {LINES}, {_ARMS}) GROUP BY 1", "segment n", "estimate se spread least greatest", "estimate se")
def cate_t_learner(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_summary(L.t_learner(S.line_items(spark, sf), "y", "t", ["x1"]), ["segment"])


@query(f"""WITH g AS (SELECT s.*, CASE WHEN t = 1 THEN y - a0 - b0 * x1 ELSE a1 + b1 * x1 - y END AS g FROM {_S} s, {_ARMS}), f AS (SELECT regr_slope(g, x1) FILTER (t = 1) AS b1, regr_intercept(g, x1) FILTER (t = 1) AS a1,
    regr_slope(g, x1) FILTER (t = 0) AS b0, regr_intercept(g, x1) FILTER (t = 0) AS a0 FROM g) SELECT segment, {_SUMMARY} FROM (SELECT segment, p * (a0 + b0 * x1) + (1 - p) * (a1 + b1 * x1) AS cate FROM g, f) GROUP BY 1""", "segment n", "estimate se spread least greatest", "estimate se")
def cate_x_learner(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.with_propensity(_flagged(spark, sf), "t", ["A", "N"])
    return L.effect_summary(L.x_learner(rows, "y", "t", ["x1"]), ["segment"])


@query(f"""WITH m AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM {LINES}), r AS (SELECT segment, x1, t - p AS u, y - a - b * x1 AS v FROM {_S}, m),
    g AS (SELECT sum(u * u) AS s0, sum(u * u * x1) AS s1, sum(u * u * x1 * x1) AS s2, sum(u * v) AS c0, sum(u * v * x1) AS c1 FROM r), f AS (SELECT (s2 * c0 - s1 * c1) / (s0 * s2 - s1 * s1) AS a, (s0 * c1 - s1 * c0) / (s0 * s2 - s1 * s1) AS b FROM g)
    SELECT segment, {_SUMMARY} FROM (SELECT segment, a + b * x1 AS cate FROM r, f) GROUP BY 1""", "segment n", "estimate se spread least greatest", "estimate se")
def cate_r_learner(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.with_propensity(_flagged(spark, sf), "t", ["A", "N"])
    return L.effect_summary(L.r_learner(rows, "y", "t", ["x1"]), ["segment"])


@query(f"""WITH q AS (SELECT quantile_cont(y, [0.25, 0.75, 0.1, 0.5, 0.9]) AS q, stddev_samp(y) AS sd, count(*) AS n FROM {LINES}), w AS (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS tau, unnest(q[3:5]) AS quantile, 1.06 * least(sd, (q[2] - q[1]) / 1.34) * n ** -0.2 AS h FROM q),
    f AS (SELECT tau, any_value(quantile) AS quantile, avg(exp(-0.5 * pow((y - quantile) / h, 2))) / (any_value(h) * sqrt(2 * pi())) AS f FROM {LINES}, w GROUP BY 1), r AS (SELECT tau, quantile, f, t, quantile + (tau - (y <= quantile)::INT) / f AS r FROM {LINES}, f),
    m AS (SELECT tau, t, avg(r) AS m, count(*) AS n, sum(r * r) - sum(r) ** 2 / count(*) AS ss, var_pop(r) / count(*) AS v FROM r GROUP BY 1, 2)
    SELECT f.tau, any_value(quantile) AS quantile, any_value(f) * 1e6 AS density_e6, max(m) FILTER (t = 1) - max(m) FILTER (t = 0) AS estimate, sqrt(sum(v)) AS se, sum(n)::BIGINT AS n, sum(n)::BIGINT - 2 AS df FROM m JOIN f USING (tau) GROUP BY 1""", "n", "tau quantile density_e6 estimate se", "estimate se df")
def quantile_effects_rif(spark: SparkSession, sf: str) -> DataFrame:
    out = L.rif_effects(S.line_items(spark, sf), "y", "t", [0.1, 0.5, 0.9])
    return out.withColumn("density_e6", F.col("density") * 1e6).drop("density")


@query(f"""WITH o AS (SELECT * FROM {ORDERS} WHERE post = 0), a AS (SELECT t, regr_slope(y, quarter) AS b, regr_intercept(y, quarter) AS a, avg(quarter) AS m, regr_sxx(y, quarter) AS s FROM o GROUP BY 1),
    c AS (SELECT unit, sum((y - a - b * quarter) * (quarter - m) / s) AS s FROM o JOIN a USING (t) GROUP BY 1)
    SELECT (SELECT sum(CASE WHEN t = 1 THEN b ELSE -b END) FROM a) AS estimate, sqrt(sum(s * s) * count(*) / (count(*) - 1) * (n - 1) / (n - 4)) AS se, n, count(*) AS n_clusters, count(*) - 1 AS df FROM c, (SELECT count(*) AS n FROM o) GROUP BY n""", "n n_clusters", "estimate se", "estimate se df")
def did_parallel_trends(spark: SparkSession, sf: str) -> DataFrame:
    return P.parallel_trends(S.orders(spark, sf).where("post = 0"), "y", "t", "quarter", "unit")


@query(f"SELECT unit, count(*) AS n, stddev_pop(y) AS y_spread FROM {ORDERS} GROUP BY 1", "unit n", "y_spread")
def panel_unit_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.unit_means(S.orders(spark, sf), ["y"], "unit")
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y") - F.col("y_bar")) ** 2)).alias("y_spread"))


@query(f"""WITH c AS (SELECT y AS s, min(id) AS c FROM {CUSTOMERS} WHERE t = 0 GROUP BY 1), m AS (SELECT a.id, a.nation, c.c, abs(a.y - c.s) AS distance, c.s FROM {CUSTOMERS} a JOIN c ON abs(a.y - c.s) <= 5 WHERE a.t = 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY distance, c.s, c.c) = 1)
    SELECT avg(m.nation - b.nation) AS estimate, sqrt(var_samp(m.nation - b.nation) / count(*)) AS se, count(*) AS n_matched FROM m JOIN {CUSTOMERS} b ON m.c = b.id""", "n_matched", "estimate se", "estimate se")
def match_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.customers(spark, sf)
    return M.matched_effect(rows, M.nearest_match(rows, "id", "t", "y", 5.0), "id", "nation")


@query(f"SELECT count(*) AS n_units, count(*) FILTER (a <> b) AS n_varying FROM (SELECT unit, min(status) AS a, max(status) AS b FROM {ORDERS} GROUP BY 1)", "n_units n_varying")
def treatment_constancy(spark: SparkSession, sf: str) -> DataFrame:
    return P.constant_within(S.orders(spark, sf), "status", "unit")


@query(f"SELECT unit, min(quarter) FILTER (status = 'F') AS first_treated, coalesce(max(quarter) FILTER (status <> 'F') > min(quarter) FILTER (status = 'F'), false) AS switches_off FROM {ORDERS} GROUP BY 1", "unit first_treated switches_off")
def staggered_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return P.staggered_panel(S.orders(spark, sf).withColumn("d", (F.col("status") == "F").cast("int")), "unit", "quarter", "d")


@query(f"SELECT unit, " + ", ".join(f"max(y) FILTER (quarter = {q}) AS y_{q}, max(t) FILTER (quarter = {q}) AS t_{q}" for q in (0, 1, 2)) + f" FROM {ORDERS} GROUP BY 1", "unit t_0 t_1 t_2", "y_0 y_1 y_2")
def stage_histories(spark: SparkSession, sf: str) -> DataFrame:
    return P.stage_histories(S.orders(spark, sf), "unit", "quarter", ["y", "t"], [0, 1, 2])


def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Forty units by year, a third of them never treated."""
    panel = S.orders(spark, sf).groupBy((F.col("unit") % 40).alias("unit"), F.floor(F.col("quarter") / 4).cast("long").alias("year")).agg(F.avg("y").alias("y"))
    return panel.withColumns({"treated": (F.col("unit") % 2 == 0).cast("int"), "first": F.when(F.col("unit") % 3 == 0, 5).when(F.col("unit") % 3 == 1, 7).cast("long")})


@query()
def did_event_study(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_study(_balanced(spark, sf), "y", "treated", "unit", "year", 5, 2, 3)


@query()
def did_sun_abraham(spark: SparkSession, sf: str) -> DataFrame:
    return P.sun_abraham(_balanced(spark, sf), "y", "unit", "year", "first")[0]


@query()
def did_sun_abraham_total(spark: SparkSession, sf: str) -> DataFrame:
    return P.sun_abraham(_balanced(spark, sf), "y", "unit", "year", "first")[1]


@query()
def did_compared(spark: SparkSession, sf: str) -> DataFrame:
    """The average effect by three methods."""
    panel = _balanced(spark, sf)
    on = panel.withColumn("d", F.coalesce(F.col("year") >= F.col("first"), F.lit(False)).cast("int"))
    named = lambda m, t: t.select(F.lit(m).alias("method"), "estimate", "se", "ci_lower", "ci_upper")
    boot = P.group_time_bootstrap(panel, "y", "unit", "year", "first", 50)
    return named("two_way", P.twfe(on, "y", "d", "unit", "year")).unionByName(named("sun_abraham", P.sun_abraham(panel, "y", "unit", "year", "first")[1])).unionByName(named("group_time", boot))


@query()
def did_wild_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.orders(spark, sf)
    return P.wild_bootstrap(rows, "y", ["t", "post", F.col("t") * F.col("post")], 3, "unit", 99)


@query()
def did_group_time_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return P.group_time_bootstrap(_cohorts(spark, sf), "y", "unit", "year", "g", 50, "dynamic")


_DAYS = "(SELECT event_type AS series, ts::DATE AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH l AS (SELECT series, v - avg(v) OVER w AS v, n - avg(n) OVER w AS n FROM {_DAYS} WINDOW w AS (PARTITION BY series)), g AS (SELECT series, d.day, d.v, d.n, regr_slope(d.v, d.n) OVER w AS b, avg(d.v) OVER w AS mv, avg(d.n) OVER w AS mn, count(*) OVER w AS c, regr_sxx(d.v, d.n) OVER w AS sxx FROM {_DAYS} d WINDOW w AS (PARTITION BY series)),
    s AS (SELECT series, day, b, mv, mn, c, sxx, (v - mv - b * (n - mn)) AS e, (v - mv - b * (n - mn)) * (n - mn) AS x FROM g), a AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY series ORDER BY day)),
    k AS (SELECT series, any_value(b) AS b, any_value(mv - b * mn) AS a, any_value(c) AS n, sqrt(sum(e * e) + 4.0 / 3 * sum(e * e1) + 2.0 / 3 * sum(e * e2)) / any_value(c) AS sa, sqrt(sum(x * x) + 4.0 / 3 * sum(x * x1) + 2.0 / 3 * sum(x * x2)) / any_value(sxx) AS sb FROM a GROUP BY 1)
    SELECT series, 'n' AS term, b AS estimate, sb AS se, n, 2 AS bandwidth FROM k""", "series term n bandwidth", "estimate se", "estimate se")
def hac_regression(spark: SparkSession, sf: str) -> DataFrame:
    return P.hac_ols(S.daily_events(spark, sf), "v", ["n"], "series", "day", 2).where("term = 'n'")


@query(f"""WITH l AS (SELECT series, v, n, lag(v) OVER w AS v1, lag(n) OVER w AS n1 FROM {_DAYS} WINDOW w AS (PARTITION BY series ORDER BY day)), s AS (SELECT series, count(*) AS n, regr_sxx(v, v1) AS aa, regr_sxx(v, n1) AS bb, regr_sxy(n1, v1) AS ab, regr_sxy(v, v1) AS va, regr_sxy(v, n1) AS vb, regr_syy(v, v1) AS vv FROM l WHERE v1 IS NOT NULL GROUP BY 1),
    f AS (SELECT *, vv - va * va / aa AS r0, vv - (va * va * bb - 2 * va * vb * ab + vb * vb * aa) / (aa * bb - ab * ab) AS r1 FROM s) SELECT series, 'n' AS cause, 'v' AS effect, (r0 - r1) / (r1 / (n - 3)) AS f, 1 AS df1, n - 3 AS df2, n FROM f""", "series cause effect df1 df2 n", "f")
def granger_causality(spark: SparkSession, sf: str) -> DataFrame:
    return T.granger(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1).where("cause = 'n'").drop("p_value")


@query(f"""WITH l AS (SELECT series, v, lag(v) OVER w AS v1 FROM {_DAYS} WINDOW w AS (PARTITION BY series ORDER BY day)), s AS (SELECT series, count(*) AS n, regr_slope(v, v1) AS b, regr_syy(v, v1) - regr_sxy(v, v1) ** 2 / regr_sxx(v, v1) AS rss FROM l WHERE v1 IS NOT NULL GROUP BY 1)
    SELECT series, n, b, rss / (n - 2) AS sigma, -n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1) AS loglik, n * (ln(2 * pi()) + ln(rss / n) + 1) + 4 AS aic, n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * ln(n) AS bic, n * (ln(2 * pi()) + ln(rss / n) + 1) + 4 * ln(ln(n)) AS hqc FROM s""", "series n", "b sigma loglik aic bic hqc")
def autoregression(spark: SparkSession, sf: str) -> DataFrame:
    out = T.vector_autoregression(S.daily_events(spark, sf), "series", "day", ["v"], 1)
    return out.select("series", "n", F.col("coef")[1].alias("b"), F.col("sigma")[0].alias("sigma"), "loglik", "aic", "bic", "hqc")


@query()
def lag_selection(spark: SparkSession, sf: str) -> DataFrame:
    return T.select_lags(S.daily_events(spark, sf), "series", "day", ["v", "n"], 3)


@query(f"""WITH l AS (SELECT series, v, lag(v) OVER w AS v1 FROM {_DAYS} WINDOW w AS (PARTITION BY series ORDER BY day)), s AS (SELECT series, count(*) AS n, regr_slope(v - v1, v1) AS b, (regr_syy(v - v1, v1) - regr_sxy(v - v1, v1) ** 2 / regr_sxx(v - v1, v1)) / (count(*) - 2) / regr_sxx(v - v1, v1) AS v FROM l WHERE v1 IS NOT NULL GROUP BY 1)
    SELECT series, b / sqrt(v) AS statistic, b / sqrt(v) < -2.862 AS stationary, n FROM s""", "series stationary n", "statistic")
def unit_root(spark: SparkSession, sf: str) -> DataFrame:
    return T.unit_root_test(S.daily_events(spark, sf), "series", "day", "v", 0).drop("p_value")


@query(f"""WITH c AS (SELECT series, day, v - avg(v) OVER (PARTITION BY series) AS e FROM {_DAYS}), s AS (SELECT series, e, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM c WINDOW w AS (PARTITION BY series ORDER BY day))
    SELECT series, sum(s * s) / count(*) ** 2 / ((sum(e * e) + 4.0 / 3 * sum(e * e1) + 2.0 / 3 * sum(e * e2)) / count(*)) AS statistic, count(*) AS n, sum(s * s) / count(*) ** 2 / ((sum(e * e) + 4.0 / 3 * sum(e * e1) + 2.0 / 3 * sum(e * e2)) / count(*)) < 0.463 AS stationary FROM s GROUP BY 1""", "series n stationary", "statistic")
def stationarity(spark: SparkSession, sf: str) -> DataFrame:
    return T.stationarity_test(S.daily_events(spark, sf), "series", "day", "v", 2).drop("p_value")


@query()
def local_projection(spark: SparkSession, sf: str) -> DataFrame:
    return T.local_projections(S.daily_events(spark, sf), "series", "day", "v", "n", 1, 3)


@query(f"""WITH c AS (SELECT z - avg(z) OVER () AS z, t - avg(t) OVER () AS t, y - avg(y) OVER () AS y FROM {LINES}), s AS (SELECT sum(z * z) AS zz, sum(z * t) AS zt, sum(z * y) AS zy, count(*) AS n FROM c),
    e AS (SELECT z, y - zy / zz * z AS ey, t - zt / zz * z AS et, zz, zt, zy, n FROM c, s) SELECT unnest(['first', 'reduced']) AS stage, 'z' AS term, unnest([any_value(zt / zz), any_value(zy / zz)]) AS estimate, unnest([sqrt(sum(et * et) / (any_value(n) - 2) / any_value(zz)), sqrt(sum(ey * ey) / (any_value(n) - 2) / any_value(zz))]) AS se, any_value(n) AS n, any_value(n) - 2 AS df,
    unnest([any_value(zt * zt / zz) / (sum(et * et) / (any_value(n) - 2)), any_value(zy * zy / zz) / (sum(ey * ey) / (any_value(n) - 2))]) AS partial_f FROM e""", "stage term n df", "estimate se partial_f", "estimate se df")
def iv_stages(spark: SparkSession, sf: str) -> DataFrame:
    return I.iv_stages(S.line_items(spark, sf), "y", "t", ["z"])


_WALD = f"""(SELECT z, t, y, cluster, zy / zt AS b, zt, zz, n FROM (SELECT cluster, z - avg(z) OVER () AS z, t - avg(t) OVER () AS t, y - avg(y) OVER () AS y FROM {LINES}), (SELECT regr_sxx(y, z) AS zz, regr_sxy(t, z) AS zt, regr_sxy(y, z) AS zy, count(*) AS n FROM {LINES}))"""


@query(f"SELECT any_value(b) AS estimate, sqrt(sum((z * (y - b * zt / zz * z)) ** 2)) / abs(any_value(zt)) AS se, any_value(n) AS n, any_value(n) - 2 AS df FROM {_WALD}", "n df", "estimate se", "estimate se df")
def iv_robust(spark: SparkSession, sf: str) -> DataFrame:
    return I.tsls(S.line_items(spark, sf), "y", "t", ["z"], errors="HC0").drop("first_stage_f", "first_stage_r2")


@query(f"SELECT any_value(b) AS estimate, sqrt(sum(s * s) * count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 2)) / abs(any_value(zt)) AS se, any_value(n) AS n, count(*) - 1 AS df FROM (SELECT cluster, sum(z * (y - b * t)) AS s, any_value(b) AS b, any_value(n) AS n, any_value(zt) AS zt FROM {_WALD} GROUP BY 1)", "n df", "estimate se", "estimate se df")
def iv_clustered(spark: SparkSession, sf: str) -> DataFrame:
    return I.tsls(S.line_items(spark, sf), "y", "t", ["z"], errors="cluster", cluster="cluster", structural=True).drop("first_stage_f", "first_stage_r2")


@query(f"""SELECT any_value(b) AS estimate, sqrt(sum((z * (y - b * t)) ** 2)) / abs(any_value(zt)) AS se, any_value(n) AS n, any_value(n) - 2 AS df, (SELECT avg(t) FILTER (z = 1) - avg(t) FILTER (z = 0) FROM {LINES}) AS compliers, (SELECT avg(t) FILTER (z = 0) FROM {LINES}) AS always, (SELECT 1 - avg(t) FILTER (z = 1) FROM {LINES}) AS never FROM {_WALD}""", "n df", "estimate se compliers always never", "estimate se df")
def cace(spark: SparkSession, sf: str) -> DataFrame:
    return I.cace(S.line_items(spark, sf), "y", "t", "z").drop("first_stage_f", "first_stage_r2")


@query(f"""WITH p AS (SELECT avg(z) AS p FROM {LINES}), k AS (SELECT y, x1, t * (z - p) / (p * (1 - p)) AS k1, (1 - t) * ((1 - z) - (1 - p)) / (p * (1 - p)) AS k0, 1 - t * (1 - z) / (1 - p) - (1 - t) * z / p AS k FROM {LINES}, p)
    SELECT avg(k) AS compliers, sum(k1 * y) / sum(k1) AS y1, sum(k0 * y) / sum(k0) AS y0, sum(k * x1) / sum(k) AS mean_x1, count(*) AS n FROM k""", "n", "compliers y1 y0 mean_x1")
def complier_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf)
    p = rows.agg(F.avg("z").alias("p"))
    return E.complier_means(rows.crossJoin(F.broadcast(p)), "y", "t", "z", "p", ["x1"])


@query()
def iv_likelihood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return I.conditional_likelihood_ratio(S.line_items(spark, sf), "y", "d", ["t", "z"])


_SHARES = "(SELECT c_nationkey AS location, c_mktsegment AS sector, sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY c_nationkey) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_SHOCKS = "(SELECT c_mktsegment AS sector, avg(o_totalprice) FILTER (year(o_orderdate) >= 1999) / avg(o_totalprice) FILTER (year(o_orderdate) < 1999) - 1 AS shock FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
_NATIONS = "(SELECT c_nationkey AS location, avg(o_totalprice) / 1000 AS y, avg(c_acctbal) / 1000 AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def _regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    both = S.read(spark, sf, "orders").join(S.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = both.select(F.col("c_nationkey").alias("location"), F.col("c_mktsegment").alias("sector"), F.col("o_totalprice").alias("price"), "c_acctbal", (F.year("o_orderdate") >= 1999).alias("late"))
    sums = both.groupBy("location", "sector").agg(F.sum("price").alias("s"))
    total = sums.groupBy("location").agg(F.sum("s").alias("all"))
    when = lambda late: F.avg(F.when(F.col("late") == late, F.col("price")))
    shares = sums.join(total, "location").select("location", "sector", (F.col("s") / F.col("all")).alias("share"))
    return both.groupBy("location").agg((F.avg("price") / 1000).alias("y"), (F.avg("c_acctbal") / 1000).alias("d")), shares, both.groupBy("sector").agg((when(True) / when(False) - 1).alias("shock"))


@query(f"SELECT location, sum(share * shock) AS instrument, sum(share) AS share_sum FROM {_SHARES} JOIN {_SHOCKS} USING (sector) GROUP BY 1", "location", "instrument share_sum")
def shift_share(spark: SparkSession, sf: str) -> DataFrame:
    return I.shift_share(*_regions(spark, sf)[1:], "location", "sector")


@query(f"""WITH z AS (SELECT location, sum(share * shock) AS z FROM {_SHARES} JOIN {_SHOCKS} USING (sector) GROUP BY 1), c AS (SELECT z - avg(z) OVER () AS z, y - avg(y) OVER () AS y, d - avg(d) OVER () AS d FROM {_NATIONS} JOIN z USING (location)), s AS (SELECT sum(z * d) AS zd, sum(z * y) AS zy, count(*) AS n FROM c)
    SELECT any_value(zy / zd) AS estimate, sqrt(sum((z * (y - zy / zd * d)) ** 2) * any_value(n) / (any_value(n) - 2)) / abs(any_value(zd)) AS se, any_value(n) AS n, any_value(n) - 2 AS df FROM c, s""", "n df", "estimate se")
def shift_share_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows, shares, shocks = _regions(spark, sf)
    return I.shift_share_iv(rows, shares, shocks, "y", "d", "location", "sector").select("estimate", "se", "n", "df")


@query(f"""WITH r AS (SELECT sector, any_value(shock) * sum(share * (d - m)) AS raw FROM {_SHARES} JOIN {_SHOCKS} USING (sector) JOIN {_NATIONS} USING (location), (SELECT avg(d) AS m FROM {_NATIONS}) GROUP BY 1) SELECT sector, raw / sum(abs(raw)) OVER () AS weight FROM r""", "sector", "weight")
def shift_share_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows, shares, shocks = _regions(spark, sf)
    return I.rotemberg_weights(rows, shares, shocks, "d", "location", "sector")


@query()
def selection_heckman(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf).withColumn("s", (F.col("x1") + 20 * F.col("z") > 25).cast("int"))
    return A.heckman(rows.withColumn("s", F.when(F.col("id") % 7 == 0, 1 - F.col("s")).otherwise(F.col("s"))), "y", "s", ["x1", "z"], ["x1"])


@query(f"""WITH o AS (SELECT t, avg(observed) AS p, avg(y) FILTER (observed = 1) AS m, min(y) FILTER (observed = 1) AS lo, max(y) FILTER (observed = 1) AS hi, count(*) AS n FROM {CUSTOMERS} GROUP BY 1), w AS (SELECT max(p) FILTER (t = 1) AS p1, max(p) FILTER (t = 0) AS p0, max(m) FILTER (t = 1) AS m1, max(m) FILTER (t = 0) AS m0, min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS n, greatest(p1 - p0, 0) AS s FROM o)
    SELECT CASE WHEN s > 0 THEN greatest(least((p1 * m1 - s * hi) / p0, hi), lo) ELSE m1 END - m0 AS lower, CASE WHEN s > 0 THEN greatest(least((p1 * m1 - s * lo) / p0, hi), lo) ELSE m1 END - m0 AS upper, p0 AS always_survive, s AS saved, n FROM w""", "n", "lower upper always_survive saved")
def survivor_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return A.survivor_bounds(S.customers(spark, sf), "y", "t", "observed")


@query(f"""SELECT (1e-4 * 0 + b / v) / (1e-4 + 1 / v) AS estimate, 1 / sqrt(1e-4 + 1 / v) AS se, 1e-4 / (1e-4 + 1 / v) AS shrinkage, n FROM (SELECT regr_slope(y, t) AS b, (regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t)) / (count(*) - 2) / regr_sxx(y, t) AS v, count(*) AS n FROM {LINES})""", "n", "estimate se shrinkage", "estimate se")
def bayes_conjugate(spark: SparkSession, sf: str) -> DataFrame:
    return A.conjugate_effect(S.line_items(spark, sf), "y", "t", prior_sd=100.0)


@query(f"SELECT stratum, segment, (a + 1.0) / (n + 2) AS mean, sqrt((a + 1.0) * (n - a + 1) / ((n + 2.0) ** 2 * (n + 3))) AS sd, a AS treated, n FROM (SELECT stratum, segment, sum(t)::BIGINT AS a, count(*) AS n FROM {LINES} GROUP BY 1, 2)", "stratum segment treated n", "mean sd")
def bayes_propensity(spark: SparkSession, sf: str) -> DataFrame:
    return A.stratified_propensity(S.line_items(spark, sf), "t", ["stratum", "segment"])


_MEDIATED = f"""(SELECT n, tm / tt AS a, (my * tt - ty * tm) / (tt * mm - tm * tm) AS b, sqrt((yy - (ty * ty * mm - 2 * ty * my * tm + my * my * tt) / (tt * mm - tm * tm)) / (n - 3)) AS sy, sqrt((mm - tm * tm / tt) / (n - 2)) AS sm
    FROM (SELECT count(*) AS n, count(*) * var_pop(t) AS tt, count(*) * var_pop(x1) AS mm, count(*) * var_pop(y) AS yy, count(*) * covar_pop(t, x1) AS tm, count(*) * covar_pop(t, y) AS ty, count(*) * covar_pop(x1, y) AS my FROM {LINES}))"""


@query(f"SELECT unnest([-0.5, 0.0, 0.5]) AS rho, a * (b - unnest([-0.5, 0.0, 0.5]) * sy / sm) AS indirect, CASE WHEN abs(b * sm / sy) <= 1 THEN b * sm / sy END AS rho_at_zero FROM {_MEDIATED}", "", "rho indirect rho_at_zero")
def mediation_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return A.mediation_sensitivity(S.line_items(spark, sf), "y", "t", "x1", [-0.5, 0.0, 0.5])


@query(f"""WITH r AS (SELECT t, x1 - 25 AS m, y FROM {LINES}), a AS (SELECT t, count(*) AS n, avg(m) AS mm, regr_sxx(y, m) AS sxx, regr_intercept(y, m) AS a, regr_slope(y, m) AS b FROM r GROUP BY 1),
    e AS (SELECT t, n, a, (1.0 / n - mm * (m - mm) / sxx) * (y - a - b * m) / (1 - 1.0 / n - (m - mm) ** 2 / sxx) AS s FROM r JOIN a USING (t)), v AS (SELECT t, any_value(n) AS n, any_value(a) AS a, sum(s * s) AS v FROM e GROUP BY 1)
    SELECT max(a) FILTER (t = 1) - max(a) FILTER (t = 0) AS estimate, sqrt(sum(v)) AS se, sum(n)::BIGINT AS n, sum(n)::BIGINT - 4 AS df FROM v""", "n df", "estimate se", "estimate se df")
def mediation_controlled(spark: SparkSession, sf: str) -> DataFrame:
    return A.controlled_direct_effect(S.line_items(spark, sf), "y", "t", "x1", 25.0).drop("r2")


@query(f"""WITH e AS (SELECT greatest(min(p) FILTER (t = 1), min(p) FILTER (t = 0)) AS low, least(max(p) FILTER (t = 1), max(p) FILTER (t = 0)) AS high FROM (SELECT t, x2 AS p FROM {LINES})) SELECT low, high, count(*) FILTER (x2 < low OR x2 > high) AS n_outside, count(*) AS n, low <= high AS overlap FROM {LINES}, e GROUP BY 1, 2""", "n_outside n overlap", "low high")
def common_support(spark: SparkSession, sf: str) -> DataFrame:
    return M.common_support(S.line_items(spark, sf), "t", "x2")


@query(f"SELECT count(*) AS n, 0 AS n_separated, count(*) FILTER (p < 0.01) AS n_low, count(*) FILTER (p > 0.99) AS n_high, min(p) AS least, max(p) AS greatest, stddev_pop(p) AS spread, stddev_pop(p) / avg(p) AS variation FROM {_S}", "n n_separated n_low n_high", "least greatest spread variation")
def propensity_separation(spark: SparkSession, sf: str) -> DataFrame:
    return O.separation(O.with_propensity(_flagged(spark, sf), "t", ["A", "N"]))


@query(f"SELECT stratum, avg(CASE WHEN t = 1 THEN m / p ELSE (1 - m) / (1 - p) END) AS w FROM {_S}, (SELECT avg(t) AS m FROM {LINES}) GROUP BY 1", "stratum", "w")
def weights_stabilized(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.stabilized_weights(O.with_propensity(_flagged(spark, sf), "t", ["A", "N"]), "t")
    return rows.groupBy("stratum").agg(F.avg("w").alias("w"))


@query(f"SELECT t AS arm, count(*) AS n, regr_r2(y, x1) AS r2, sqrt((regr_syy(y, x1) - regr_sxy(y, x1) ** 2 / regr_sxx(y, x1)) / count(*)) AS rmse FROM {LINES} GROUP BY 1", "arm n", "r2 rmse")
def outcome_models(spark: SparkSession, sf: str) -> DataFrame:
    return O.outcome_model_fit(S.line_items(spark, sf), "y", "t", ["x1"])


@query()
def propensity_penalised(spark: SparkSession, sf: str) -> DataFrame:
    return O.model_table(S.line_items(spark, sf), "t", ["x1", "x2"], ridge=1e-4)


@query()
def ate_ipw_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return O.ipw_observational(S.line_items(spark, sf), "y", "t", ["x1", "x2"], trim=(0.01, 0.99), stabilize=True)


@query()
def match_propensity(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.customers(spark, sf).withColumn("half", (F.col("nation") % 2).cast("int"))
    return M.psm_ate(rows, "y", "half", ["nation", "observed"], "id", 0.01)


@query()
def match_once(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_without_replacement(S.customers(spark, sf), "id", "t", "y", 0.5)


@query(f"""WITH c AS (SELECT y AS s, min(id) AS c FROM {CUSTOMERS} WHERE t = 0 GROUP BY 1), m AS (SELECT a.id, a.nation, c.c, abs(a.y - c.s) AS distance, c.s FROM {CUSTOMERS} a JOIN c ON abs(a.y - c.s) <= 5 WHERE a.t = 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY distance, c.s, c.c) = 1),
    p AS (SELECT m.c, m.nation AS a, b.nation AS b FROM m JOIN {CUSTOMERS} b ON m.c = b.id), u AS (SELECT any_value(b) AS b, avg(a) AS a FROM p GROUP BY c)
    SELECT avg(a - b) AS estimate, sqrt((avg((a - b) ** 2) + (SELECT sum((b - a) ** 2) FROM u) / (SELECT count(*) FROM {CUSTOMERS} WHERE t = 0)) / count(*)) AS se, count(*) AS n_matched, (SELECT count(*) FROM u) AS n_controls_used FROM p""", "n_matched n_controls_used", "estimate se", "estimate se")
def match_variance(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.customers(spark, sf)
    return M.matching_variance(rows, M.nearest_match(rows, "id", "t", "y", 5.0), "id", "t", "nation")


@query()
def match_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.customers(spark, sf)
    return M.matched_balance(rows, M.nearest_match(rows, "id", "t", "y", 5.0, k=2), "id", "t", ["nation", "y"])


@query()
def rdd_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    return D.optimal_bandwidth(S.line_items(spark, sf), "y", "x1", 25.0, by=["segment"], pilot=5.0)


@query()
def rdd_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    return D.cross_validation_bandwidth(S.line_items(spark, sf), "y", "x1", 25.0, [5.0, 10.0, 15.0, 20.0])


@query()
def rdd_bias_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return D.sharp_rdd(S.line_items(spark, sf), "y", "x1", 25.0, 12.0, bias_bandwidth=18.0)


@query()
def rdd_orders(spark: SparkSession, sf: str) -> DataFrame:
    return D.order_sensitivity(S.line_items(spark, sf), "y", "x1", 25.0, 15.0)


@query(" UNION ALL ".join(f"SELECT '{c}' AS covariate, h.ay - l.ay AS estimate, sqrt(h.vy + l.vy) AS se, l.n AS n_left, h.n AS n_right, l.n + h.n - 4 AS df FROM {_rdd('one', 'true', '15', c)} h JOIN {_rdd('one', 'true', '15', c)} l ON h.side = 1 AND l.side = 0" for c in ("x2", "d")).replace(LINES, f"(SELECT *, 1 AS one FROM {LINES})"), "covariate n_left n_right df", "estimate se", "estimate se df")
def rdd_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return D.covariate_balance(S.line_items(spark, sf), ["x2", "d"], "x1", 25.0, 15.0)


@query()
def rdd_density(spark: SparkSession, sf: str) -> DataFrame:
    return D.density_test(S.orders(spark, sf), "y", 200_000.0)


@query()
def kink_sharp(spark: SparkSession, sf: str) -> DataFrame:
    return D.sharp_kink(S.line_items(spark, sf), "y", "x1", 25.0, 15.0, 1.5)


@query()
def kink_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return D.fuzzy_kink(S.line_items(spark, sf), "y", "d", "x1", 25.0, 15.0)


@query(f"""WITH l AS (SELECT covariate, v, x1 - 25 AS r, x1 >= 25 AS up FROM (SELECT x1, 'y' AS covariate, y AS v FROM {LINES} UNION ALL SELECT x1, 'discount', x2 * 10000 FROM {LINES}) WHERE abs(x1 - 25) <= 15),
    b AS (SELECT covariate, up, regr_slope(v, r) AS b, regr_intercept(v, r) AS a, avg(r) AS m, regr_sxx(v, r) AS s, count(*) AS n FROM l GROUP BY 1, 2),
    q AS (SELECT covariate, up, any_value(b.b) AS b, any_value(n) AS n, sum(((r - m) * (v - a - b.b * r)) ** 2) / any_value(s) ** 2 AS q FROM l JOIN b USING (covariate, up) GROUP BY 1, 2)
    SELECT covariate, sum(CASE WHEN up THEN b ELSE -b END) AS estimate, sqrt(sum(q)) AS se, CAST(sum(n) - 4 AS BIGINT) AS df, max(n) FILTER (NOT up) AS n_left, max(n) FILTER (up) AS n_right FROM q GROUP BY 1""",
    "covariate n_left n_right df", "estimate se", "estimate se df")
def kink_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return D.kink_covariates(S.line_items(spark, sf).withColumn("discount", F.col("x2") * 10000), ["y", "discount"], "x1", 25.0, 15.0, kernel="uniform")


@query()
def kink_checks(spark: SparkSession, sf: str) -> DataFrame:
    return D.kink_checks(S.line_items(spark, sf).withColumn("discount", F.col("x2") * 10000), "d", ["y", "discount"], "x1", 25.0, 15.0, 15)


@query()
def dml_panel(spark: SparkSession, sf: str) -> DataFrame:
    return L.panel_double_ml(S.line_items(spark, sf), "y", "d", ["x1", "x2"], "cluster")


@query(f"SELECT regr_slope(y, x1) FILTER (t = 1) * avg(x1) + regr_intercept(y, x1) FILTER (t = 1) - regr_slope(y, x1) FILTER (t = 0) * avg(x1) - regr_intercept(y, x1) FILTER (t = 0) AS estimate, sqrt((regr_syy(y, x1) FILTER (t = 1) - (regr_sxy(y, x1) FILTER (t = 1)) ** 2 / regr_sxx(y, x1) FILTER (t = 1)) / (count(*) FILTER (t = 1) - 1) / count(*) FILTER (t = 1) + (regr_syy(y, x1) FILTER (t = 0) - (regr_sxy(y, x1) FILTER (t = 0)) ** 2 / regr_sxx(y, x1) FILTER (t = 0)) / (count(*) FILTER (t = 0) - 1) / count(*) FILTER (t = 0)) AS se, count(*) AS n FROM {LINES}", "n", "estimate se", "estimate se")
def cate_t_learner_mean(spark: SparkSession, sf: str) -> DataFrame:
    return L.t_learner_ate(S.line_items(spark, sf), "y", "t", ["x1"])


@query(f"SELECT segment, {_SUMMARY} FROM (SELECT segment, a1 - a0 + (b1 - b0) * x1 AS cate FROM {LINES}, {_ARMS}) GROUP BY 1", "segment n", "estimate se spread least greatest", "estimate se")
def cate_s_learner(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_summary(L.s_learner(S.line_items(spark, sf), "y", "t", ["x1"]), ["segment"])


@query()
def policy_q_learning(spark: SparkSession, sf: str) -> DataFrame:
    return L.q_learning(S.line_items(spark, sf), [("t", ["x1"]), ("z", ["x2"])], "y")[0]


@query()
def policy_q_value(spark: SparkSession, sf: str) -> DataFrame:
    return L.q_learning(S.line_items(spark, sf), [("t", ["x1"]), ("z", ["x2"])], "y")[1]


@query()
def policy_a_learning(spark: SparkSession, sf: str) -> DataFrame:
    return L.a_learning(S.line_items(spark, sf), "y", "t", ["x1"])


@query()
def quantile_effects_panel(spark: SparkSession, sf: str) -> DataFrame:
    return L.rif_effects(S.line_items(spark, sf), "y", "t", [0.25, 0.5, 0.75], ["x1"], unit="cluster")


@query()
def series_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return T.vector_forecast(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1, 3)


@query()
def series_responses(spark: SparkSession, sf: str) -> DataFrame:
    return T.impulse_responses(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1, 3)


@query(f"""WITH g AS (SELECT series, day, v - avg(v) OVER w - regr_slope(v, n) OVER w * (n - avg(n) OVER w) AS e FROM {_DAYS} WINDOW w AS (PARTITION BY series)), l AS (SELECT series, e, lag(e) OVER (PARTITION BY series ORDER BY day) AS e1 FROM g),
    s AS (SELECT series, count(*) AS n, sum((e - e1) * e1) / sum(e1 * e1) AS b, sum((e - e1) ** 2) AS dd, sum((e - e1) * e1) AS de, sum(e1 * e1) AS ee FROM l WHERE e1 IS NOT NULL GROUP BY 1)
    SELECT series, b / sqrt((dd - de * de / ee) / (n - 1) / ee) AS statistic, b / sqrt((dd - de * de / ee) / (n - 1) / ee) < -3.34 AS cointegrated, n FROM s""", "series cointegrated n", "statistic")
def series_cointegration(spark: SparkSession, sf: str) -> DataFrame:
    return T.cointegration_test(S.daily_events(spark, sf), "series", "day", "v", ["n"], 0)


@query(f"SELECT 'z' AS instrument, CASE WHEN abs(corr(z, x1)) >= abs(corr(z, x2)) THEN 'x1' ELSE 'x2' END AS covariate, greatest(abs(corr(z, x1)), abs(corr(z, x2))) AS correlation, greatest(abs(corr(z, x1)), abs(corr(z, x2))) > 0.99 AS collinear, count(*) AS n FROM {LINES}", "instrument covariate collinear n", "correlation")
def instrument_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return A.instrument_overlap(S.line_items(spark, sf), ["z"], ["x1", "x2"])


@query()
def bayes_logistic(spark: SparkSession, sf: str) -> DataFrame:
    return A.logistic_posterior(S.line_items(spark, sf), "t", ["x1", "x2"])


@query()
def mte_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    return A.polynomial_mte(S.line_items(spark, sf), "y", "t", ["x1", "x2"])


@query()
def mte_effects(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.with_propensity(S.line_items(spark, sf), "t", ["x1", "x2"])
    return A.effects_from_mte(A.polynomial_mte(S.line_items(spark, sf), "y", "t", ["x1", "x2"]), rows, "t", "p")


@query()
def cace_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return A.complier_mixture(S.line_items(spark, sf), "y", "t", "z", rounds=20)


# Estimators of the third round.  With t alone a linear quantile is each arm's own: any value between two neighbours is as good, and the lower is taken unless the arm's size times tau is a whole number.
@query(f"""WITH q AS (SELECT quantile_disc(y, 0.37) FILTER (t = 1) - quantile_disc(y, 0.37) FILTER (t = 0) AS a, quantile_disc(y, 0.83) FILTER (t = 1) - quantile_disc(y, 0.83) FILTER (t = 0) AS b, count(*) AS n FROM {LINES})
    SELECT unnest([0.37, 0.83]) AS tau, unnest([a, b]) AS estimate, n FROM q""", "n", "tau estimate")
def quantile_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return QR.conditional_quantile_effects(S.line_items(spark, sf), "y", "t", [], [0.37, 0.83]).select("tau", "estimate", "n")


@query()
def quantile_regression(spark: SparkSession, sf: str) -> DataFrame:
    return QR.quantile_regression(S.line_items(spark, sf), "y", ["t", "x1", "x2"], [0.25, 0.5])


@query(f"""WITH q AS (SELECT quantile_cont(y, 0.25) FILTER (t = 1) - quantile_cont(y, 0.25) FILTER (t = 0) AS a, quantile_cont(y, 0.5) FILTER (t = 1) - quantile_cont(y, 0.5) FILTER (t = 0) AS b, count(*) AS n, count(DISTINCT cluster) AS n_units FROM {LINES})
    SELECT unnest([0.25, 0.5]) AS tau, unnest([a, b]) AS estimate, n, n_units FROM q""", "n n_units", "tau estimate")
def quantile_gaps_panel(spark: SparkSession, sf: str) -> DataFrame:
    return L.panel_quantile_gaps(S.line_items(spark, sf), "y", "t", "cluster", [0.25, 0.5], 20).select("tau", "estimate", "n", "n_units")


@query()
def quantile_gaps_panel_errors(spark: SparkSession, sf: str) -> DataFrame:
    return L.panel_quantile_gaps(S.customers(spark, sf), "y", "t", "nation", [0.25, 0.5, 0.75], 40)


@query()
def mte_local(spark: SparkSession, sf: str) -> DataFrame:
    return ME.local_iv(S.line_items(spark, sf), "y", "t", ["x1", "x2"], key="id", replicates=10)


@query()
def mte_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.with_propensity(S.line_items(spark, sf), "t", ["x1", "x2"])
    curve = ME.local_iv(S.line_items(spark, sf), "y", "t", ["x1", "x2"])
    return ME.policy_effects(curve, rows.withColumn("moved", F.least(F.col("p") + 0.02, F.lit(0.99))), "p", "moved", "t")


@query()
def dynamic_effects(spark: SparkSession, sf: str) -> DataFrame:
    panel = S.orders(spark, sf).groupBy((F.col("unit") % 100).alias("unit"), "quarter").agg(F.avg("y").alias("y"), F.avg("t").alias("d"), F.count(F.lit(1)).alias("x"))
    return D2.dynamic_effects(panel, "y", "d", ["x"], "unit", "quarter", 2, how="panel")


@query(f"""WITH c AS (SELECT series, day, v - avg(v) OVER w AS v, n - avg(n) OVER w AS n FROM {_DAYS} WINDOW w AS (PARTITION BY series)), l AS (SELECT series, v - lag(v) OVER w AS dv, n - lag(n) OVER w AS dn, lag(v) OVER w AS v1, lag(n) OVER w AS n1 FROM c WINDOW w AS (PARTITION BY series ORDER BY day)),
    s AS (SELECT series, count(*) AS n, var_pop(v1) AS a, covar_pop(v1, n1) AS b, var_pop(n1) AS d, covar_pop(v1, dv) AS p, covar_pop(v1, dn) AS q, covar_pop(n1, dv) AS r, covar_pop(n1, dn) AS s, var_pop(dv) AS e, covar_pop(dv, dn) AS f, var_pop(dn) AS g FROM l WHERE v1 IS NOT NULL GROUP BY 1),
    m AS (SELECT *, (a * d - b * b) * (e * g - f * f) AS dd, p * (p * g - q * f) + q * (q * e - p * f) AS h11, p * (r * g - s * f) + q * (s * e - r * f) AS h12, r * (r * g - s * f) + s * (s * e - r * f) AS h22 FROM s),
    t AS (SELECT series, n, (d * h11 - 2 * b * h12 + a * h22) / dd AS tr, (h11 * h22 - h12 * h12) * (a * d - b * b) / dd ** 2 AS det FROM m), l2 AS (SELECT series, n, (tr + sqrt(greatest(tr * tr - 4 * det, 0))) / 2 AS l0, (tr - sqrt(greatest(tr * tr - 4 * det, 0))) / 2 AS l1 FROM t)
    SELECT series, unnest([0, 1])::BIGINT AS r, unnest([l0, l1]) AS eigenvalue, unnest([-n * (ln(1 - l0) + ln(1 - l1)), -n * ln(1 - l1)]) AS trace, n FROM l2""", "series r n", "eigenvalue trace")
def series_reduced_rank(spark: SparkSession, sf: str) -> DataFrame:
    return CO.johansen_test(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1).select("series", "r", "eigenvalue", "trace", "n")


@query()
def series_error_correction(spark: SparkSession, sf: str) -> DataFrame:
    return CO.error_correction(S.daily_events(spark, sf), "series", "day", ["v", "n"], 2, rank=1)


@query()
def series_error_correction_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return CO.error_correction_forecast(S.daily_events(spark, sf), "series", "day", ["v", "n"], 2, 3, rank=1)


@query()
def series_error_correction_causality(spark: SparkSession, sf: str) -> DataFrame:
    return CO.error_correction_causality(S.daily_events(spark, sf), "series", "day", ["v", "n"], 2, rank=1)


def _controls(spark: SparkSession, sf: str) -> DataFrame:
    panel = S.orders(spark, sf).groupBy((F.col("unit") % 15).alias("unit"), "quarter").agg(F.avg("y").alias("y"))
    return panel.withColumn("first", F.when(F.col("unit") < 2, 20))


@query()
def synthetic_control_augmented(spark: SparkSession, sf: str) -> DataFrame:
    return Z.augmented_synthetic_control(_controls(spark, sf), "unit", "quarter", "y", "first")


@query()
def synthetic_control_donors(spark: SparkSession, sf: str) -> DataFrame:
    panel = _controls(spark, sf)
    weights = Z.synthetic_weights(panel, "unit", "quarter", "y", "first")
    return Z.donor_diagnostics(weights, Z.synthetic_paths(panel, weights, "unit", "quarter", "y", "first"))


@query()
def synthetic_control_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return Z.leave_one_out(_controls(spark, sf), "unit", "quarter", "y", "first")


@query()
def control_function_probit(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf).withColumn("high", (F.col("y") > 50_000).cast("int"))
    return RP.nonlinear_control_function(rows, "high", "d", ["t", "z"], "id", ["x1"], replicates=10)


@query(f"""WITH s AS (SELECT regr_slope(x1, t) AS a, var_pop(t) AS tt, var_pop(x1) AS mm, covar_pop(t, x1) AS tm, covar_pop(t, y) AS ty, covar_pop(x1, y) AS my, count(*) AS n FROM {LINES}), b AS (SELECT a, n, (ty * mm - my * tm) / (tt * mm - tm * tm) AS c, (my * tt - ty * tm) / (tt * mm - tm * tm) AS b FROM s)
    SELECT unnest(['total', 'direct', 'indirect', 'mediated']) AS effect, unnest([c + a * b, c, a * b, a * b / (c + a * b)]) AS estimate, n FROM b""", "effect n", "estimate")
def mediation_simulated(spark: SparkSession, sf: str) -> DataFrame:
    return RP.mediation_effects(S.line_items(spark, sf), "y", "t", "x1", "id", simulations=1, replicates=5).select("effect", "estimate", "n")


@query()
def mediation_simulated_logit(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.line_items(spark, sf).withColumn("m", (F.col("x1") > 25).cast("int"))
    return RP.mediation_effects(rows, "y", "t", "m", "id", ["x2"], mediator="logit", simulations=3, replicates=10)


@query()
def bayes_doubly_robust(spark: SparkSession, sf: str) -> DataFrame:
    return RP.bayesian_doubly_robust(S.line_items(spark, sf), "y", "t", ["x1", "x2"], draws=50)


@query()
def bayes_doubly_robust_strata(spark: SparkSession, sf: str) -> DataFrame:
    return RP.bayesian_doubly_robust(S.line_items(spark, sf), "y", "t", ["x1"], strata=["stratum", "segment"], draws=50)


@query(f"""WITH a AS (SELECT t, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM {LINES} GROUP BY 1), r AS (SELECT segment, (SELECT a FROM a WHERE t = 1) - (SELECT a FROM a WHERE t = 0) + ((SELECT b FROM a WHERE t = 1) - (SELECT b FROM a WHERE t = 0)) * x1 AS c FROM {LINES})
    SELECT segment, avg(c) AS estimate, count(*) AS n FROM r GROUP BY 1""", "segment n", "estimate")
def cate_factors(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_summary(LA.factor_cate(S.line_items(spark, sf), "y", "t", ["x1"], 1), ["segment"]).select("segment", "estimate", "n")


@query()
def cate_factor_products(spark: SparkSession, sf: str) -> DataFrame:
    return L.effect_summary(LA.factor_cate(S.line_items(spark, sf), "y", "t", ["x1", "x2", "z"], 2, "fa", squares=True), ["segment"])


@query()
def cate_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return LA.mixture_ate(LA.mixture_cate(S.line_items(spark, sf), "y", "t", ["x1", "x2"], 2, 10))


@query()
def series_links(spark: SparkSession, sf: str) -> DataFrame:
    return LK.lagged_links(S.daily_events(spark, sf), "series", "day", ["v", "n"], 2)


@query()
def series_proxy_shock(spark: SparkSession, sf: str) -> DataFrame:
    days = S.daily_events(spark, sf).withColumn("z", F.col("n") + F.dayofweek("day"))
    return LK.proxy_impacts(days, "series", "day", ["v", "n"], 1, "z", "n")


@query()
def series_history(spark: SparkSession, sf: str) -> DataFrame:
    return LK.historical_decomposition(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1)


@query(f"SELECT series, day, x_diff FROM (SELECT series, day, v - lag(v) OVER (PARTITION BY series ORDER BY day) AS x_diff FROM {_DAYS}) WHERE x_diff IS NOT NULL", "series day", "x_diff")
def series_difference(spark: SparkSession, sf: str) -> DataFrame:
    return T.difference(S.daily_events(spark, sf).withColumnRenamed("v", "x"), "series", "day", "x").select("series", "day", "x_diff")


@query(f"SELECT d, count(*) AS n, min(x) AS least, max(x) AS greatest FROM (SELECT x2 AS x, (x2 > (SELECT quantile_cont(x2, 1.0 / 3) FROM {LINES}))::INT + (x2 > (SELECT quantile_cont(x2, 2.0 / 3) FROM {LINES}))::INT AS d FROM {LINES}) GROUP BY 1", "d n", "least greatest")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.quantile_bins(S.line_items(spark, sf), "x2")
    return rows.groupBy(F.col("x2_bin").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("x2").alias("least"), F.max("x2").alias("greatest"))


@query(f"""WITH e AS (SELECT greatest(quantile_cont(y, 0.05) FILTER (t = 1), quantile_cont(y, 0.05) FILTER (t = 0)) AS low, least(quantile_cont(y, 0.95) FILTER (t = 1), quantile_cont(y, 0.95) FILTER (t = 0)) AS high FROM {LINES})
    SELECT low, high, count(*) FILTER (y < low OR y > high) AS n_outside, count(*) AS n, low <= high AS overlap FROM {LINES}, e GROUP BY 1, 2""", "n_outside n overlap", "low high")
def common_support_margin(spark: SparkSession, sf: str) -> DataFrame:
    return M.common_support(S.line_items(spark, sf), "t", "y", margin=0.05)


@query(f"""WITH w AS (SELECT sector, raw / sum(abs(raw)) OVER () AS weight FROM (SELECT sector, any_value(shock) * sum(share * (d - m)) AS raw FROM {_SHARES} JOIN {_SHOCKS} USING (sector) JOIN {_NATIONS} USING (location), (SELECT avg(d) AS m FROM {_NATIONS}) GROUP BY 1))
    SELECT coalesce(sum(-weight) FILTER (weight < 0), 0) AS negative_share, sum(weight * weight) AS herfindahl, count(*) AS n_sectors, (SELECT string_agg(sector, ',' ORDER BY abs(weight) DESC, sector DESC) FROM (SELECT * FROM w ORDER BY abs(weight) DESC, sector LIMIT 3)) AS top FROM w""", "n_sectors top", "negative_share herfindahl")
def shift_share_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows, shares, shocks = _regions(spark, sf)
    return I.rotemberg_summary(I.rotemberg_weights(rows, shares, shocks, "d", "location", "sector"), "sector", 3)


@query()
def selection_chances(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.selection_hazard(S.line_items(spark, sf), "t", ["x1", "z"])
    return rows.groupBy("stratum").agg(F.avg("p_selected").alias("p_selected"), F.avg("hazard").alias("hazard"), F.count(F.lit(1)).alias("n"))


@query()
def bounds_lee_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return E.lee_intervals(S.customers(spark, sf), "y", "t", "observed", "id", 50)


@query()
def bounds_lee_tightened_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return E.lee_intervals(S.customers(spark, sf), "y", "t", "observed", "id", 30, x="nation")


@query()
def unit_root_selected(spark: SparkSession, sf: str) -> DataFrame:
    return ST.unit_root_selected(S.daily_events(spark, sf), "series", "day", "v")


_ONE_LAG = f"(SELECT *, v - l AS d, lag(v - l) OVER (PARTITION BY series ORDER BY day) AS d1 FROM (SELECT series, day, v - avg(v) OVER (PARTITION BY series) AS v, lag(v) OVER (PARTITION BY series ORDER BY day) - avg(v) OVER (PARTITION BY series) AS l FROM {_DAYS}))"


@query(f"""WITH z AS (SELECT series, regr_sxx(d, l) AS sxx, regr_sxy(d, l) AS sxy, regr_syy(d, l) AS syy, count(*) AS n FROM {_ONE_LAG} WHERE l IS NOT NULL GROUP BY 1),
    o AS (SELECT series, count(*) AS n, regr_sxx(d, l) AS pp, regr_sxx(d, d1) AS qq, regr_sxy(d1, l) AS pq, regr_sxy(d, l) AS py, regr_sxy(d, d1) AS qy, regr_syy(d, l) AS yy FROM {_ONE_LAG} WHERE d1 IS NOT NULL GROUP BY 1),
    f AS (SELECT series, 0 AS lags, n, sxy / sxx AS b, 1 / sxx AS i, syy - sxy * sxy / sxx AS rss, 2 AS k FROM z UNION ALL SELECT series, 1, n, (qq * py - pq * qy) / (pp * qq - pq * pq), qq / (pp * qq - pq * pq), yy - ((qq * py - pq * qy) * py + (pp * qy - pq * py) * qy) / (pp * qq - pq * pq), 3 FROM o)
    SELECT series, arg_min(lags, c)::BIGINT AS lags, arg_min(b / sqrt(rss / (n - k) * i), c) AS statistic, arg_min(b / sqrt(rss / (n - k) * i), c) < -2.862 AS stationary, arg_min(n, c) AS n FROM (SELECT *, n * ln(rss / n) + ln(n) * k AS c FROM f) GROUP BY 1""", "series lags stationary n", "statistic")
def unit_root_by_bic(spark: SparkSession, sf: str) -> DataFrame:
    return ST.unit_root_selected(S.daily_events(spark, sf), "series", "day", "v", "c", "bic", 1).drop("p_value")


@query(f"""WITH l AS (SELECT series, day, v, lag(v) OVER (PARTITION BY series ORDER BY day) AS l FROM {_DAYS}), f AS (SELECT series, regr_slope(v - l, l) AS b, regr_intercept(v - l, l) AS a, count(*) AS n, regr_sxx(v - l, l) AS sxx FROM l WHERE l IS NOT NULL GROUP BY 1),
    e AS (SELECT series, day, v - l - a - b * l AS e, b, n, sxx FROM l JOIN f USING (series) WHERE l IS NOT NULL), g AS (SELECT series, any_value(b) AS b, any_value(n) AS n, any_value(sxx) AS sxx, sum(e * e) / any_value(n) AS short, (sum(e * e) + 4.0 / 3 * sum(e * e1) + 2.0 / 3 * sum(e * e2)) / any_value(n) AS long
    FROM (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY series ORDER BY day)) GROUP BY 1), t AS (SELECT *, sqrt(short * n / (n - 2) / sxx) AS se FROM g)
    SELECT series, n, sqrt(short / long) * b / se - 0.5 * (long - short) / sqrt(long) * n / sqrt(sxx) AS statistic, n * b - 0.5 * n * n / sxx * (long - short) AS rho_statistic, sqrt(short / long) * b / se - 0.5 * (long - short) / sqrt(long) * n / sqrt(sxx) < -2.862 AS stationary FROM t""", "series n stationary", "statistic rho_statistic")
def unit_root_long_run(spark: SparkSession, sf: str) -> DataFrame:
    return ST.phillips_perron(S.daily_events(spark, sf), "series", "day", "v", "c", 2).drop("p_value")


@query(f"""WITH r AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY day) AS r FROM {_DAYS}), f AS (SELECT series, regr_slope(v, r) AS b, regr_intercept(v, r) AS a FROM r GROUP BY 1), e AS (SELECT series, r, v - a - b * r AS e FROM r JOIN f USING (series)),
    s AS (SELECT series, e, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY series ORDER BY r)), t AS (SELECT series, sum(s * s) / count(*) ** 2 / ((sum(e * e) + 4.0 / 3 * sum(e * e1) + 2.0 / 3 * sum(e * e2)) / count(*)) AS statistic, count(*) AS n FROM s GROUP BY 1)
    SELECT series, statistic, n, statistic < 0.146 AS stationary FROM t""", "series n stationary", "statistic")
def stationarity_around_trend(spark: SparkSession, sf: str) -> DataFrame:
    return ST.stationarity_around(S.daily_events(spark, sf), "series", "day", "v", "ct", 2).drop("p_value")


@query()
def stationarity_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return ST.confirmed_stationarity(S.daily_events(spark, sf), "series", "day", "v")


@query()
def shocks_long_run(spark: SparkSession, sf: str) -> DataFrame:
    return T.impulse_responses(S.daily_events(spark, sf), "series", "day", ["v", "n"], 1, 3, long_run=True)


_KINK = f"""(SELECT segment, x1::DOUBLE - 25 AS r, y / 5000 AS y, n, sd, span, 1.06 * least(sd, iqr / 1.34) * n ** -0.2 AS pilot FROM {LINES}
    JOIN (SELECT segment, count(*) AS n, stddev_pop(x1) AS sd, max(x1) - min(x1) AS span, quantile_cont(x1::DOUBLE, 0.75) - quantile_cont(x1::DOUBLE, 0.25) AS iqr FROM {LINES} GROUP BY 1) USING (segment))"""


@query(f"SELECT segment, greatest(least(any_value(pilot) * any_value(n) ** (4.0 / 45), any_value(span) / 2), any_value(span) / 20) AS bandwidth, any_value(pilot) AS pilot, any_value(n) AS n FROM {_KINK} GROUP BY 1", "segment n", "bandwidth pilot")
def kink_bandwidth_rule(spark: SparkSession, sf: str) -> DataFrame:
    return D.kink_bandwidth(S.line_items(spark, sf).withColumn("y", F.col("y") / 5000), "y", "x1", 25.0, "rot", by=["segment"])


@query(f"""WITH c AS (SELECT *, r >= 0 AS up, r * r AS q FROM {_KINK}), s AS (SELECT segment, up, count(*) AS k, count(*) FILTER (abs(r) <= pilot) AS near, regr_sxx(y, r) AS pp, regr_sxx(y, q) AS qq, regr_sxy(q, r) AS pq, regr_sxy(y, r) AS py, regr_sxy(y, q) AS qy, regr_syy(y, r) AS yy, any_value(n) AS n, any_value(pilot) AS pilot, any_value(span) AS span FROM c GROUP BY 1, 2),
    b AS (SELECT *, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2, sqrt((yy - ((qq * py - pq * qy) * py + (pp * qy - pq * py) * qy) / (pp * qq - pq * pq)) / k) AS e FROM s),
    h AS (SELECT segment, any_value(n) AS n, any_value(pilot) AS pilot, any_value(span) AS span, avg(e) AS e, sum(near) / (2 * any_value(pilot) * any_value(n)) AS f, greatest(avg(abs(2 * b2)), 0.01) AS c FROM b GROUP BY 1)
    SELECT segment, greatest(least(3.43 * e * n ** (-1.0 / 9) * (f / c ** 2) ** (1.0 / 9), span / 2), span / 20) AS bandwidth, pilot, n FROM h""", "segment n", "bandwidth pilot")
def kink_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    return D.kink_bandwidth(S.line_items(spark, sf).withColumn("y", F.col("y") / 5000), "y", "x1", 25.0, by=["segment"])


@query()
def kink_bandwidth_cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    return D.kink_cross_validation(S.line_items(spark, sf).withColumn("y", F.col("y") / 5000), "y", "x1", 25.0)
