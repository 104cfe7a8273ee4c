"""Statistics over DataFrames: sums in Spark, and closed-form work on the few resulting numbers on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import average_ranks

# -- distributions (regularised incomplete beta and gamma by continued fraction and series)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return _beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def t_limit(p: float, df: float) -> float:
    """The t that is exceeded either way with chance p."""
    lo, hi = 0.0, 1.0
    while t_p(hi, df) > p:
        hi *= 2
    for _ in range(100):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if t_p(middle, df) > p else (lo, middle)
    return hi


def range_p(q: float, groups: int, df: float) -> float:
    """Tail of the studentised range, by quadrature over the normal and over the spread of the estimated deviation."""
    z, w = np.polynomial.legendre.leggauss(200)
    z, w = 8 * z, 8 * w
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = lambda x: 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in x.ravel()]).reshape(x.shape)
    s, u = np.polynomial.legendre.leggauss(40)
    spread = 8 / math.sqrt(2 * df)
    s = np.maximum(1 + spread * s, 1e-6)
    density = np.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    inner = groups * ((phi * w)[None, :] * (below(np.broadcast_to(z, (len(s), len(z)))) - below(z[None, :] - q * s[:, None])) ** (groups - 1)).sum(1)
    weight = density * u
    return float(np.clip(1 - (weight * inner).sum() / weight.sum(), 0, 1))


def f_p(f: float, d1: float, d2: float) -> float:
    return _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else float("nan")


def chi2_p(x: float, df: float) -> float:
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 300):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


# -- description


def descriptive(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.75)).alias("q3"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.mode(v, True).alias("mode"),
    )


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, n, r) of every two columns; Spearman correlates average ranks."""
    spark = df.sparkSession
    if method == "spearman":
        for c in columns:
            df = df.join(average_ranks(df, c).select(c, F.col("rank").alias(f"__{c}")), c, "left")
        name = lambda c: f"__{c}"
    else:
        name = lambda c: c
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.count("*"), *[F.corr(name(a), name(b)) for a, b in pairs]).first()
    return spark.createDataFrame([(a, b, row[0], row[k + 1], t_p(row[k + 1] * math.sqrt((row[0] - 2) / max(1 - row[k + 1] ** 2, 1e-300)), row[0] - 2)) for k, (a, b) in enumerate(pairs)], "a string, b string, n long, r double, p double")


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance matrix) of rows without nulls, in one pass."""
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = full.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    k = len(columns)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k + 1 :], strict=True):
        cov[i, j] = cov[j, i] = v if v is not None else np.nan
    return row[0], np.array(row[1 : k + 1], dtype=float), cov


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares from moments: coefficients with t and p, R2, adjusted R2, F, AIC, variance inflation."""
    n, mean, cov = moments(df, [y, *xs])
    k = len(xs)
    inverse = np.linalg.pinv(cov[1:, 1:]) if k else np.zeros((0, 0))
    beta = inverse @ cov[1:, 0]
    total = cov[0, 0] * (n - 1)
    residual = max(total - float(beta @ cov[1:, 0]) * (n - 1), 0.0)
    sigma2 = residual / max(n - k - 1, 1)
    error = np.sqrt(np.maximum(np.diag(inverse) * sigma2 / (n - 1), 0))
    r2 = 1 - residual / total if total else 0.0
    f = (r2 / k) / max((1 - r2) / (n - k - 1), 1e-300) if k else 0.0
    t = beta / np.maximum(error, 1e-300)
    return {
        "n": n, "intercept": float(mean[0] - beta @ mean[1:]), "coefficients": dict(zip(xs, beta.tolist(), strict=True)), "t": dict(zip(xs, t.tolist(), strict=True)),
        "p": {x: t_p(v, n - k - 1) for x, v in zip(xs, t.tolist(), strict=True)}, "r2": float(r2), "adjusted_r2": 1 - float(1 - r2) * (n - 1) / max(n - k - 1, 1), "f": f, "f_p": f_p(f, k, n - k - 1) if k else 1.0,
        "aic": n * math.log(max(residual, 1e-300) / n) + 2 * (k + 1), "vif": dict(zip(xs, (np.diag(inverse) * np.diag(cov[1:, 1:])).tolist(), strict=True)),
    }


def stepwise(df: DataFrame, y: str, xs: list[str]) -> list[str]:
    """Predictors chosen forward and backward by AIC, all from one pass of moments."""
    n, _, cov = moments(df, [y, *xs])

    def aic(chosen: tuple[int, ...]) -> float:
        at = [c + 1 for c in chosen]
        total = cov[0, 0] * (n - 1)
        if at:
            total -= float(cov[0, at] @ np.linalg.pinv(cov[np.ix_(at, at)]) @ cov[at, 0]) * (n - 1)
        return n * math.log(max(total, 1e-300) / n) + 2 * (len(at) + 1)

    chosen: tuple[int, ...] = ()
    while True:
        options = [tuple(sorted((*chosen, i))) for i in range(len(xs)) if i not in chosen] + [tuple(c for c in chosen if c != i) for i in chosen]
        best = min(options, key=aic, default=chosen)
        if aic(best) >= aic(chosen) - 1e-9:
            return [xs[i] for i in chosen]
        chosen = best


def hierarchical(df: DataFrame, y: str, blocks: list[list[str]]) -> list[dict]:
    """R2 and its gain as blocks of predictors are added."""
    out, before, xs = [], 0.0, []
    for block in blocks:
        xs = [*xs, *block]
        got = ols(df, y, xs)
        out.append({"predictors": list(xs), "r2": got["r2"], "gain": got["r2"] - before, "f": got["f"]})
        before = got["r2"]
    return out


# -- tests


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, between and within sums of squares, F, p, eta squared."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n > 0")
    row = g.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n"), F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0)))).first()
    k, n, grand, within = row
    between = g.agg(F.sum(F.col("n") * (F.col("m") - grand) ** 2)).first()[0]
    f = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within else float("nan")
    return df.sparkSession.createDataFrame([(k, n, between, within, f, f_p(f, k - 1, n - k), between / (between + within))], "groups long, n long, ss_between double, ss_within double, f double, p double, eta2 double")


def tukey(df: DataFrame, value: str, group: str, most: int = 100) -> DataFrame:
    """(a, b, difference, q, p) of every two groups by Tukey's test, at most ``most`` groups."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n > 0").orderBy(group).limit(most + 1).collect()
    if len(g) > most:
        raise ValueError(f"more than {most} groups")
    left = sum(r["n"] for r in g) - len(g)
    within = sum((r["n"] - 1) * (r["v"] or 0.0) for r in g) / max(left, 1)
    rows = []
    for i, x in enumerate(g):
        for y in g[i + 1 :]:
            q = abs(y["m"] - x["m"]) / math.sqrt(max(within, 1e-300) / 2 * (1 / x["n"] + 1 / y["n"]))
            rows.append((str(x[group]), str(y[group]), y["m"] - x["m"], q, range_p(q, len(g), left)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, difference double, q double, p double")


#: Cells of a two-way table whose sums are worked on together.
MAX_CELLS = 10_000


def anova_two_way(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """(source, ss, df, f, p) of the main effects and interaction, from cell sums (sequential sums of squares); at most ``MAX_CELLS`` cells."""
    sums = df.groupBy(a, b).agg(F.count(value).alias("n")).filter("n > 0").count()
    if sums > MAX_CELLS:
        raise ValueError(f"{sums} cells, more than {MAX_CELLS}")
    cells = df.groupBy(a, b).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).filter("n > 0").collect()
    n = sum(r["n"] for r in cells)
    levels = [sorted({r[c] for r in cells}, key=str) for c in (a, b)]
    dummies = lambda r, which: [1.0] + [float(r[a] == v) for v in levels[0][1:]] * (which > 0) + [float(r[b] == v) for v in levels[1][1:]] * (which > 1)
    sse = []
    for which in range(3):
        x = np.array([dummies(r, which) for r in cells]) * np.sqrt([r["n"] for r in cells])[:, None]
        y = np.array([r["s"] / math.sqrt(r["n"]) for r in cells])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        sse.append(sum(r["q"] for r in cells) - float(((x @ beta) ** 2).sum()))
    error = sum(r["q"] - r["s"] ** 2 / r["n"] for r in cells)
    parts = [(a, sse[0] - sse[1], len(levels[0]) - 1), (b, sse[1] - sse[2], len(levels[1]) - 1), (f"{a}:{b}", sse[2] - error, len(cells) - len(levels[0]) - len(levels[1]) + 1)]
    left = n - len(cells)
    rows = [(s, ss, d, (ss / d) / (error / left) if d > 0 and left > 0 and error > 0 else None) for s, ss, d in parts]
    return df.sparkSession.createDataFrame([(s, ss, d, f, None if f is None else f_p(f, d, left)) for s, ss, d, f in rows] + [("residual", error, left, None, None)], "source string, ss double, df long, f double, p double")


def t_test(df: DataFrame, value: str, group: str, a, b, equal: bool = False) -> DataFrame:
    """One row: n, mean and variance of two groups, t, degrees of freedom (Welch unless equal), p, Cohen's d."""
    side = lambda x: F.when(F.col(group) == x, F.col(value))
    n1, m1, v1, n2, m2, v2 = df.agg(*[f(side(x)) for x in (a, b) for f in (F.count, F.avg, F.var_samp)]).first()
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    error = math.sqrt(pooled * (1 / n1 + 1 / n2) if equal else v1 / n1 + v2 / n2)
    free = n1 + n2 - 2 if equal else (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    t = (m1 - m2) / error
    return df.sparkSession.createDataFrame([(n1, n2, m1, m2, v1, v2, t, float(free), t_p(t, free), (m1 - m2) / math.sqrt(pooled))], "n1 long, n2 long, mean1 double, mean2 double, var1 double, var2 double, t double, df double, p double, cohen_d double")


def t_test_one(df: DataFrame, value: str, mu: float, sure: float = 0.95) -> DataFrame:
    """One row: n, mean, deviation, t, p and the interval that holds the mean with ``sure``."""
    n, m, s = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    error = s / math.sqrt(n)
    t = (m - mu) / error
    wide = t_limit(1 - sure, n - 1) * error
    return df.sparkSession.createDataFrame([(n, m, s, t, t_p(t, n - 1), m - wide, m + wide)], "n long, mean double, std double, t double, p double, lower double, upper double")


def t_test_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return t_test_one(df.select((F.col(a) - F.col(b)).alias("d")).dropna(), "d", 0.0)


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """ANOVA of the distances from the group means."""
    m = df.groupBy(group).agg(F.avg(value).alias("__m"))
    return anova(df.join(m, group).withColumn("__d", F.abs(F.col(value) - F.col("__m"))), "__d", group)


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, rank_sum) with average ranks of ties: the sums of Mann-Whitney and Kruskal-Wallis. Ranks come from value counts."""
    return df.join(average_ranks(df, value), value).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, H corrected for ties, p."""
    g = rank_sums(df.filter(F.col(value).isNotNull()), value, group)
    k, n, part = g.agg(F.count("*"), F.sum("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "groups long, n long, h double, p double")
    ties = df.filter(F.col(value).isNotNull()).groupBy(value).count().agg(F.sum(F.expr("cast(count as double) * count * count - count"))).first()[0]
    h = (12 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - ties / (float(n) ** 3 - n) or 1e-300)
    return df.sparkSession.createDataFrame([(k, n, h, chi2_p(h, k - 1))], "groups long, n long, h double, p double")


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    rows = {r[group]: r for r in rank_sums(df.filter(F.col(group).isin(a, b)), value, group).collect()}
    n1, n2 = rows[a]["n"], rows[b]["n"]
    u = rows[a]["rank_sum"] - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return df.sparkSession.createDataFrame([(n1, n2, u, z, math.erfc(abs(z) / math.sqrt(2)))], "n1 long, n2 long, u double, z double, p double")


def cronbach(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, alpha, item_total): alpha of all items (item null) and without each one, and each item's correlation with the sum of the others."""
    _, _, cov = moments(df, columns)

    def alpha(at: list[int]) -> float | None:
        k, c = len(at), cov[np.ix_(at, at)]
        return float(k / (k - 1) * (1 - np.trace(c) / c.sum())) if k > 1 and c.sum() else None

    def with_rest(i: int) -> float | None:
        with_all, own = cov[i].sum(), cov[i, i]
        spread = own * (cov.sum() - 2 * with_all + own)
        return float((with_all - own) / math.sqrt(spread)) if spread > 0 else None

    every = list(range(len(columns)))
    rows = [(None, alpha(every), None)] + [(c, alpha([j for j in every if j != i]), with_rest(i)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "item string, alpha double, item_total double")


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, entropy, weight) by the entropy method: min-max scaling plus 1e-9, shares, entropy over ln n."""
    n, *ends = df.agg(F.count("*"), *[f(c) for c in columns for f in (F.min, F.max)]).first()
    scaled = {c: (F.col(c) - ends[2 * i]) / ((ends[2 * i + 1] - ends[2 * i]) or 1.0) + 1e-9 for i, c in enumerate(columns)}
    sums = df.agg(*[F.sum(scaled[c]) for c in columns]).first()
    got = df.agg(*[-F.sum(scaled[c] / sums[i] * F.log(scaled[c] / sums[i])) / math.log(max(n, 2)) for i, c in enumerate(columns)]).first()
    gap = [1 - e for e in got]
    return df.sparkSession.createDataFrame([(c, got[i], gap[i] / sum(gap)) for i, c in enumerate(columns)], "column_name string, entropy double, weight double")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, lo, hi): equal-width bins from 1; the largest value is in the last."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, n long, lo double, hi double")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(value) - lo) / width) + 1, F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("lo", lo + (F.col("bin") - 1) * width).withColumn("hi", lo + F.col("bin") * width)


def pca(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, eigenvalue, share, kept, loadings) of the correlation matrix; kept by Kaiser's rule (above 1), loadings by column, signed so
    that the largest is positive."""
    _, _, cov = moments(df, columns)
    s = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(s, s))
    rows = []
    for k, i in enumerate(np.argsort(-values), 1):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        rows.append((k, float(values[i]), float(values[i] / values.sum()), bool(values[i] > 1), dict(zip(columns, (v * math.sqrt(max(values[i], 0))).tolist(), strict=True))))
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, kept boolean, loadings map<string,double>")


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """The rows with their cluster, on standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    full = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(full).transform(full)
    return KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster").fit(scaled).transform(scaled).drop("__v", "__s")


def elbow(df: DataFrame, columns: list[str], most: int = 8, seed: int = 42) -> DataFrame:
    """(k, cost, chosen): within-cluster sums of squares for 2 to ``most`` clusters; chosen is the one farthest below the line between the ends."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    full = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(full).transform(full).select("__s")
    cost = [float(KMeans(k=k, seed=seed, featuresCol="__s").fit(scaled).summary.trainingCost) for k in range(2, most + 1)]
    line = [cost[0] + (cost[-1] - cost[0]) * i / max(len(cost) - 1, 1) for i in range(len(cost))]
    best = int(np.argmax(np.array(line) - np.array(cost)))
    return df.sparkSession.createDataFrame([(k + 2, c, k == best) for k, c in enumerate(cost)], "k int, cost double, chosen boolean")


def logit(df: DataFrame, y: str, xs: list[str], multinomial: bool = False) -> dict:
    """Logistic regression without penalty: coefficients, odds ratios, log-likelihoods and pseudo R2 of the binary model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    full = VectorAssembler(inputCols=xs, outputCol="__v", handleInvalid="skip").transform(df.withColumn("__y", F.col(y).cast("double")))
    model = LogisticRegression(featuresCol="__v", labelCol="__y", probabilityCol="__p", family="multinomial" if multinomial else "binomial").fit(full)
    if multinomial:
        return {"coefficients": model.coefficientMatrix.toArray().tolist(), "intercepts": model.interceptVector.toArray().tolist()}
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("__p")[1]
    n, one, ll = model.transform(full).agg(F.count("*"), F.sum("__y"), F.sum(F.when(F.col("__y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()
    null = one * math.log(one / n) + (n - one) * math.log(1 - one / n)
    cox = 1 - math.exp(2 * (null - ll) / n)
    b = dict(zip(xs, model.coefficients.toArray().tolist(), strict=True))
    return {"intercept": model.intercept, "coefficients": b, "odds_ratios": {k: math.exp(v) for k, v in b.items()}, "log_likelihood": ll, "cox_snell": cox, "nagelkerke": cox / (1 - math.exp(2 * null / n))}


def drivers(df: DataFrame, outcome: str, columns: list[str], q: float = 0.75, least: int = 20) -> DataFrame:
    """(driver, n_high, n_rest, mean_high, mean_rest, lift_percent, cohen_d, r): how columns differ where the outcome is in its top quarter."""
    cut = df.agg(F.percentile(outcome, F.lit(q)).alias("__cut"))
    d = df.crossJoin(cut).withColumn("__high", F.col(outcome) >= F.col("__cut"))
    facts = []
    for c in columns:
        hi, lo = F.when(F.col("__high"), F.col(c)), F.when(~F.col("__high"), F.col(c))
        facts.append(F.struct(
            F.lit(c).alias("driver"), F.count(hi).alias("n_high"), F.count(lo).alias("n_rest"), F.avg(hi).alias("mean_high"), F.avg(lo).alias("mean_rest"),
            F.var_samp(hi).alias("__a"), F.var_samp(lo).alias("__b"), F.corr(c, outcome).alias("r"),
        ))
    out = d.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    gap = F.col("mean_high") - F.col("mean_rest")
    return out.filter(F.col("n_high") + F.col("n_rest") >= least).withColumn("lift_percent", F.try_divide(gap, F.abs("mean_rest")) * 100).withColumn("cohen_d", F.try_divide(gap, F.sqrt((F.col("__a") + F.col("__b")) / 2))).drop("__a", "__b")


def similarity(df: DataFrame, metric: str, at: str, value: str, top: int) -> DataFrame:
    """(a, b, n, r): for each metric the ``top`` others it correlates with best over common points."""
    x, y = df.select(F.col(metric).alias("a"), F.col(at).alias("t"), F.col(value).alias("x")), df.select(F.col(metric).alias("b"), F.col(at).alias("t"), F.col(value).alias("y"))
    r = x.join(y, "t").filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return r.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "b"))).filter(F.col("__k") <= top).drop("__k")


def trend(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, n, slope, intercept, r2) over the position in the series."""
    at = df.withColumn("__i", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("double"))
    return at.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(value, "__i").alias("slope"), F.regr_intercept(value, "__i").alias("intercept"), F.regr_r2(value, "__i").alias("r2"))


def outliers(df: DataFrame, by: list[str], value: str, iqr: float = 1.5, z: float = 2.5) -> DataFrame:
    """The rows beyond the quartile fences or the z limit of their group, marked with which."""
    q = df.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"), F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    d = df.join(q, by)
    wide = iqr * (F.col("__q3") - F.col("__q1"))
    d = d.withColumn("by_iqr", (F.col(value) < F.col("__q1") - wide) | (F.col(value) > F.col("__q3") + wide)).withColumn("by_z", F.coalesce(F.abs(F.try_divide(F.col(value) - F.col("__m"), "__s")) > z, F.lit(False)))
    return d.filter("by_iqr or by_z").drop("__q1", "__q3", "__m", "__s")


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """One row: n and the Kolmogorov-Smirnov distance to the normal distribution of the sample's mean and deviation, with its p."""
    from .series import normal_cdf

    n, m, s = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    below = F.col("upto")
    d = average_ranks(df, value).withColumn("__hi", below / n).withColumn("__lo", (below - F.col("c")) / n).withColumn("__f", normal_cdf((F.col(value) - m) / s))
    gap = d.agg(F.max(F.greatest(F.abs(F.col("__hi") - F.col("__f")), F.abs(F.col("__lo") - F.col("__f"))))).first()[0]
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * gap
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) if x > 0.2 else 1.0
    return df.sparkSession.createDataFrame([(n, gap, min(max(p, 0.0), 1.0))], "n long, d double, p double")


def scatter(df: DataFrame, x: str, y: str, rows: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(a seeded sample of about so many points, one row with n and r of all points)."""
    every = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    whole = every.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    n = whole.first()["n"]
    return every.sample(min(1.0, rows / max(n, 1)), seed), whole


def group_lift(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, lift_percent): group means against the mean of all rows."""
    every = df.agg(F.avg(value).alias("__m"))
    got = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return got.crossJoin(every).withColumn("lift_percent", F.try_divide(F.col("mean") - F.col("__m"), F.abs("__m")) * 100).drop("__m")


def peers(df: DataFrame, entity: str, which, columns: list[str]) -> DataFrame:
    """(column_name, own, peer_mean, peer_std, z, percentile) of one entity among all entities."""
    row = df.agg(*[F.max(F.when(F.col(entity) == which, F.col(c))).alias(f"__{i}") for i, c in enumerate(columns)])
    facts = []
    for i, c in enumerate(columns):
        own, others = F.col(f"__{i}"), F.when(F.col(entity) != which, F.col(c))
        facts.append(F.struct(
            F.lit(c).alias("column_name"), F.first(own).alias("own"), F.avg(others).alias("peer_mean"), F.stddev_samp(others).alias("peer_std"),
            F.avg(F.when(F.col(entity) != which, (F.col(c) <= own).cast("int"))).alias("percentile"),
        ))
    out = df.select(entity, *columns).crossJoin(row).agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")  # one row on the right
    return out.withColumn("z", F.try_divide(F.col("own") - F.col("peer_mean"), F.col("peer_std")))


def factor_loadings(df: DataFrame, columns: list[str], factors: int, rounds: int = 100) -> dict[str, list[float]]:
    """Principal-axis factor loadings from the correlation matrix: communalities are iterated on its diagonal."""
    _, _, cov = moments(df, columns)
    s = np.sqrt(np.diag(cov))
    r = cov / np.outer(s, s)
    h = 1 - 1 / np.maximum(np.diag(np.linalg.pinv(r)), 1e-9)
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(-values)[:factors]
        loading = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        new = np.minimum((loading**2).sum(1), 1.0)
        if np.abs(new - h).max() < 1e-8:
            break
        h = new
    return dict(zip(columns, loading.tolist(), strict=True))


#: Rows the Shapiro-Wilk test looks at: its tail is not known beyond.
SHAPIRO_ROWS = 5000


def shapiro(df: DataFrame, value: str, seed: int = 42) -> DataFrame:
    """One row: n, rows used, W and p of the Shapiro-Wilk test by Royston's approximation; of more than ``SHAPIRO_ROWS`` values a seeded sample."""
    from statistics import NormalDist

    values = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = values.count()
    if n > SHAPIRO_ROWS:
        values = values.sample(min(1.0, 1.1 * SHAPIRO_ROWS / n), seed).limit(SHAPIRO_ROWS)
    x = np.sort(values.toPandas()["v"].to_numpy())
    k = len(x)
    if k < 3 or x[0] == x[-1]:
        return df.sparkSession.createDataFrame([(n, k, None, None)], "n long, used long, w double, p double")
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (k + 0.25)) for i in range(1, k + 1)])
    u, c = 1 / math.sqrt(k), m / math.sqrt(m @ m)
    a = np.zeros(k)
    a[-1] = c[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
    if k > 5:
        a[-2] = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[1] = -a[-2]
    elif k > 3:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    else:
        a[-1] = math.sqrt(0.5)
    a[0] = -a[-1]
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if k == 3:
        p = max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    else:
        log = math.log(k)
        if k <= 11:
            g = np.polyval([0.459, -2.273], k)
            y = -math.log(max(g - math.log1p(-w), 1e-300))
            mean, spread = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], k), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], k))
        else:
            y = math.log1p(-w) if w < 1 else -745.0
            mean, spread = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
        p = 0.5 * math.erfc((y - mean) / spread / math.sqrt(2))
    return df.sparkSession.createDataFrame([(n, k, w, float(p))], "n long, used long, w double, p double")
