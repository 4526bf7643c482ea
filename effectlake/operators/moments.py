"""Grouped moments, cross-products and least squares: what most estimators reduce their rows to.

``by`` names the columns of the segments; every estimator returns a row per
segment, or one row where ``by`` is empty.  All sums are partial before they are
shuffled, so a segment that holds a third of all rows costs one row per task.

Rows where a column in use is null or not finite are left out and counted.
Columns are centred on their own segment's means before products are summed, and
scaled before systems are solved, so that neither offsets nor units cost digits;
intercepts are put back afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import stats

#: Up to so many segments are solved on the driver and broadcast to their rows; more are solved in tasks and joined by a shuffle.
LIMIT = 10_000
#: Columns whose products are gathered as covariances in one pass; the buffers of more would be too wide for generated code.
ONE_PASS = 6


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def grouped(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left and the columns of right, null keys being equal; without keys right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({c: f"{c}__" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by])
    return left.join(named, same).drop(*[f"{c}__" for c in by])


def each_row(table: DataFrame, f: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """f of each row of a table that has a row per segment: on the driver for few, in tasks for many.  None leaves the row out."""
    found = table.take(LIMIT + 1)
    names = StructType.fromDDL(schema).names
    if len(found) <= LIMIT:
        made = [x for x in (f(r.asDict()) for r in found) if x is not None]
        return F.broadcast(table.sparkSession.createDataFrame([tuple(x[n] for n in names) for x in made], schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [x for x in (f(r) for r in batch.to_dict("records")) if x is not None]
            yield pd.DataFrame([[x[n] for n in names] for x in made], columns=names)

    return table.mapInPandas(run, schema)


def types(df: DataFrame, names: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"`{c}` {kinds[c]}" for c in names]


def inferred(table: DataFrame, alpha: float = 0.05, df: str | None = None, estimate: str = "estimate", se: str = "se") -> DataFrame:
    """table and p_value, ci_lower, ci_upper: two-sided, by Student's t where ``df`` names its degrees of freedom and they aren't null, else by the normal.  Null where there is no error."""

    def add(r: dict) -> dict:
        b, s, k = r[estimate], r[se], r[df] if df else None
        if b is None or s is None or not s > 0 or not np.isfinite(s) or (k is not None and not k > 0):
            return {**r, "p_value": None, "ci_lower": None, "ci_upper": None}
        q = stats.t_quantile(1 - alpha / 2, k) if k is not None else stats.normal_quantile(1 - alpha / 2)
        return {**r, "p_value": stats.two_sided(b, s, k), "ci_lower": b - q * s, "ci_upper": b + q * s}

    return each_row(table, add, ", ".join([*types(table, table.columns), "p_value double", "ci_lower double", "ci_upper double"]))


def frame(df: DataFrame, columns: dict[str, str | Column], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """by, keep and the named columns as doubles, without the rows where one of these is null or not finite."""
    rows = df.select(*by, *[c for c in keep if c not in by], *[number(c).alias(name) for name, c in columns.items()])
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    return rows.where(reduce(lambda a, b: a & b, ok))


def centred(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """The rows with ``columns`` less their means over all rows, and the means."""
    row = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}
    return rows.withColumns({c: F.col(c) - means[c] for c in columns}), means


def with_means(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rows and at_, their segment's means of ``columns``."""
    means = grouped(rows, by, F.array(*[F.avg(c) for c in columns]).alias("at_"))
    return join_by(rows, each_row(means, lambda r: r, ", ".join([*types(rows, by), "at_ array<double>"])), by)


def cross_products(df: DataFrame, columns: Sequence[Column], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """by..., n, and xx: the upper triangle, by rows, of the (weighted) sums of products of ``columns``."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [F.sum(w * columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    sums = grouped(df, by, F.count(F.lit(1)).alias("n"), *pairs)
    names = [f"p{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))]
    return sums.select(*by, "n", F.array(*names).alias("xx"))


def centred_products(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by..., n, at (the columns' means), and xx: the upper triangle of the (weighted) sums of products of an intercept and the columns, each less its segment's own mean.

    Up to ONE_PASS columns are covariances, which merge without a loss of digits, from one pass; more columns, and weights, take a pass for the means first."""
    k = len(columns)
    if k > ONE_PASS or weight is not None:
        own = with_means(rows, columns, by)
        shifted = [F.lit(1.0), *[F.col(c) - F.col("at_")[i] for i, c in enumerate(columns)]]
        w = F.lit(1.0) if weight is None else F.col(weight)
        pairs = [F.sum(w * shifted[i] * shifted[j]) for i in range(k + 1) for j in range(i, k + 1)]
        return grouped(own, by, F.count(F.lit(1)).alias("n"), F.any_value("at_").alias("at"), F.array(*pairs).alias("xx"))
    n = F.count(F.lit(1))
    product = lambda i, j: n * (F.var_pop(columns[i]) if i == j else F.covar_pop(columns[i], columns[j]))
    triangle = [n.cast("double"), *[F.lit(0.0)] * k, *[product(i, j) for i in range(k) for j in range(i, k)]]
    return grouped(rows, by, n.alias("n"), F.array(*[F.avg(c) for c in columns]).cast("array<double>").alias("at"), F.array(*triangle).alias("xx"))


def square(triangle: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = triangle
    return out + np.triu(out, 1).T


def inverted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of a symmetric matrix of products, and which of its columns have one of their own: not those that others make up or that do not vary.

    Columns are scaled to length 1 for it, so that a column's unit of measurement makes no difference."""
    scale = np.sqrt(np.abs(np.diag(m)))
    scale[scale == 0] = np.inf
    unit = m / np.outer(scale, scale)
    inverse = np.linalg.pinv(unit, rcond=1e-12, hermitian=True)
    return inverse / np.outer(scale, scale), np.diag(unit @ inverse) > 1 - 1e-6


def left_over(m: np.ndarray, given: Sequence[int], of: Sequence[int]) -> np.ndarray:
    """Products of columns ``of`` after least squares on columns ``given``."""
    g, o = list(given), list(of)
    return m[np.ix_(o, o)] - m[np.ix_(o, g)] @ inverted(m[np.ix_(g, g)])[0] @ m[np.ix_(g, o)]


def log_determinant(m: np.ndarray) -> float:
    """Minus infinity where there is none."""
    scale = np.sqrt(np.abs(np.diag(m)))
    if not (scale > 0).all():
        return -np.inf
    sign, size = np.linalg.slogdet(m / np.outer(scale, scale))
    return float(size + 2 * np.log(scale).sum()) if sign > 0 else -np.inf


def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares of the last column of a square of cross-products on the others: coefficients (NaN for a column without one of its own), inverse of X'X, residual sum of squares."""
    inverse, known = inverted(m[:-1, :-1])
    beta = inverse @ m[:-1, -1]
    rss = max(float(m[-1, -1] - beta @ m[:-1, -1]), 0.0)
    return np.where(known, beta, np.nan), inverse, rss


class LeastSquares:
    """Least squares of y on an intercept and xs, per segment.

    One pass gives means and centred products, and with ``robust`` or ``cluster`` a
    second the sum of squared scores for robust variances ("HC0", "HC1", "HC3") or of
    squared sums of scores per cluster.  ``table`` has by..., n, k, beta (the intercept
    first), line (coefficients that predict, also where beta has none), cov (k x k by rows), rss, tss and n_clusters; ``extra`` is
    the number of further coefficients that small-sample factors are to count.  ``rows``
    are those in use, each less its segment's means (x0_, x1_, ..., y_), and ``small``
    their solution.  With ``weight`` scores are weighted too.  Segments without rows give n 0 and nulls."""

    def __init__(
        self, df: DataFrame, y: str | Column, xs: Sequence[str | Column], by: Sequence[str] = (), robust: str | None = None, cluster: str | None = None,
        weight: str | Column | None = None, extra: int = 0, intercept: bool = True, keep: Sequence[str] = (),
    ):
        self.by, k0 = list(by), len(xs)
        names = [f"x{i}_" for i in range(k0)]
        columns = {**dict(zip(names, xs, strict=True)), "y_": y, **({"w_": weight} if weight is not None else {})}
        # Segments go by names of their own here, which no column of the fit shares.
        keys = [f"by{i}__" for i in range(len(by))]
        renamed = df.select("*", *[F.col(c).alias(k_) for c, k_ in zip(by, keys, strict=True)]) if by else df
        own = frame(renamed, columns, keys, [*([cluster] if cluster else []), *[c for c in keep if c not in by]])
        self._own, self._keys, self._names = own, keys, [*names, "y_"]
        k = k0 + 1 if intercept else k0
        kinds = [f"`{k_}` {kind}" for k_, kind in zip(keys, [dict(df.dtypes)[c] for c in by], strict=True)]
        if intercept:
            grams = centred_products(own, self._names, keys, "w_" if weight is not None else None)
        else:
            grams = cross_products(own, [*map(F.col, names), F.col("y_")], keys, F.col("w_") if weight is not None else None)
            grams = grams.withColumn("at", F.array(*[F.lit(0.0)] * (k0 + 1)))

        def back(at: np.ndarray) -> np.ndarray:
            """From the solution in centred columns to that in the columns as they are."""
            to = np.eye(k)
            if intercept:
                to[0, 1:] = -at
            return to

        def fit(r: dict) -> dict:
            base = {**{c: r[c] for c in keys}, "n": r["n"], "k": k, "n_clusters": None}
            if not r["n"]:
                return {**base, **dict.fromkeys(("beta", "line", "inverse", "cov", "rss", "tss", "slope", "at"))}
            m, at = square(r["xx"], k + 1), np.array(r["at"][:k0], float)
            beta, inverse, rss = solve(m)
            line = inverse @ m[:-1, -1]  # predicts alike where columns make up each other, when no one of them has a coefficient
            tss = float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0]) if intercept else float(m[-1, -1])
            to = back(at)
            shift = np.eye(k)[0] * (r["at"][-1] - line[1:] @ at) if intercept else np.zeros(k)
            out = beta + shift
            spare = r["n"] - k
            cov = to @ inverse @ to.T * rss / spare if spare > 0 else np.full_like(inverse, np.nan)
            return {**base, "beta": out.tolist(), "slope": line.tolist(), "line": (line + shift).tolist(), "inverse": inverse.ravel().tolist(), "cov": cov.ravel().tolist(), "rss": rss, "tss": tss, "at": list(r["at"])}

        shape = ["n long", "k int", "beta array<double>", "line array<double>", "cov array<double>", "rss double", "tss double", "n_clusters long"]
        first = each_row(grams, fit, ", ".join([*kinds, *shape, "slope array<double>", "inverse array<double>", "at array<double>"]))
        named = dict(zip(keys, by, strict=True))
        self._at = first.select(*keys, F.col("at").alias("at_"))
        self.table, self.small = first.drop("slope", "inverse", "at").withColumnsRenamed(named), first.select(*keys, "n", "slope", "inverse", "at").withColumnsRenamed(named)
        if robust is None and cluster is None:
            return
        joined = join_by(own, first.select(*keys, "slope", "inverse", "at"), keys)
        cols = [*([F.lit(1.0)] if intercept else []), *[F.col(c) - F.col("at")[i] for i, c in enumerate(names)]]
        e = F.col("y_") - F.col("at")[k0] - sum((F.col("slope")[i] * c for i, c in enumerate(cols)), F.lit(0.0))
        if weight is not None:
            e = e * F.col("w_")
        if robust == "HC3":
            e = e / (1 - sum((F.col("inverse")[i * k + j] * cols[i] * cols[j] for i in range(k) for j in range(k)), F.lit(0.0)))
        scores = joined.select(*keys, *([F.col(cluster).alias("cluster_")] if cluster else []), e.alias("e_"), *[c.alias(f"c{i}") for i, c in enumerate(cols)])
        scores = scores.select(*keys, *(["cluster_"] if cluster else []), *[(F.col("e_") * F.col(f"c{i}")).alias(f"s{i}") for i in range(k)])
        if cluster:
            scores = scores.groupBy(*keys, "cluster_").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
        meats = cross_products(scores, [F.col(f"s{i}") for i in range(k)], keys).withColumnsRenamed({"n": "g_", "xx": "meat"})

        def sandwich(r: dict) -> dict:
            cov, n = None, r["n"]
            if n and r["meat"] is not None and n > k:
                inverse, to = np.array(r["inverse"]).reshape(k, k), back(np.array(r["at"][:k0], float))
                factor = n / (n - k) if robust == "HC1" else 1.0
                if cluster:
                    g, spare = r["g_"], n - k - extra
                    factor = g / (g - 1) * (n - 1) / spare if g > 1 and spare > 0 else float("nan")
                cov = (factor * to @ inverse @ square(r["meat"], k) @ inverse @ to.T).ravel().tolist()
            return {**r, "cov": cov, "n_clusters": r["g_"] if cluster else None}

        self.table = each_row(join_by(first, meats, keys), sandwich, ", ".join([*kinds, *shape])).withColumnsRenamed(named)

    @property
    def rows(self) -> DataFrame:
        both = join_by(self._own, self._at, self._keys)
        return both.withColumns({c: F.col(c) - F.col("at_")[i] for i, c in enumerate(self._names)}).drop("at_").withColumnsRenamed(dict(zip(self._keys, self.by, strict=True)))

    def coefficient(self, i: int, alpha: float = 0.05, degrees: str = "rows") -> DataFrame:
        """by..., estimate, se, n, df, r2, p_value, ci_lower, ci_upper of coefficient i; df is n - k, or the clusters less one."""

        by = self.by

        def pick(r: dict) -> dict:
            beta, cov, k = r["beta"], r["cov"], r["k"]
            known = beta is not None and beta[i] is not None and np.isfinite(beta[i])
            var = cov[i * k + i] if known and cov is not None else None
            return {
                **{c: r[c] for c in by}, "estimate": float(beta[i]) if known else None, "se": float(np.sqrt(max(var, 0))) if var is not None and np.isfinite(var) else None, "n": r["n"],
                "df": int(r["n_clusters"] - 1 if degrees == "clusters" and r["n_clusters"] is not None else r["n"] - k), "r2": 1 - r["rss"] / r["tss"] if r["tss"] else None,
            }

        table = each_row(self.table, pick, ", ".join([*types(self.table, self.by), "estimate double", "se double", "n long", "df long", "r2 double"]))
        return inferred(table, alpha, "df")

    def first(self) -> dict:
        """beta, cov (a matrix), se, n, k, rss and tss where there are no segments."""
        r = self.table.first().asDict()
        if r["beta"] is None:  # without rows nothing is known
            r |= {"beta": [np.nan] * r["k"], "line": [np.nan] * r["k"], "cov": [np.nan] * r["k"] ** 2}
        cov = np.full((r["k"], r["k"]), np.nan) if r["cov"] is None else np.array(r["cov"], float).reshape(r["k"], r["k"])
        return {**r, "beta": np.array(r["beta"], float), "line": np.array(r["line"], float), "cov": cov, "se": np.sqrt(np.maximum(np.diag(cov), 0))}


def ols(df: DataFrame, y: str | Column, xs: Sequence[str | Column], robust: str | None = None, cluster: str | None = None) -> dict:
    return LeastSquares(df, y, xs, (), robust, cluster).first()


def gram_rows(df: DataFrame, columns: dict[str, str | Column], by: Sequence[str] = ()) -> DataFrame:
    """by..., n, at, xx for an intercept and the columns, each less its segment's mean: slopes are the same, products lose no digits."""
    return centred_products(frame(df, columns, by), list(columns), by)
