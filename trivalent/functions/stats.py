"""Statistics as column expressions, and window forms that sort rather than compare pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(n: Column, d: Column, digits: int | None = None) -> Column:
    """n / d, null where d is 0."""
    value = n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95% score interval; its ends are exact at no and at all successes, and null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    den = 1 + Z95 * Z95 / F.nullif(n, F.lit(0.0))
    centre = (p + Z95 * Z95 / (2 * F.nullif(n, F.lit(0.0)))) / den
    half = Z95 * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + Z95 * Z95 / (4 * F.nullif(n * n, F.lit(0.0)))) / den
    return F.when(n == 0, None).when(k == 0, 0.0).otherwise(centre - half), F.when(n == 0, None).when(k == n, 1.0).otherwise(centre + half)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """The exact two-sided test on discordant pairs: twice the smaller binomial tail, at most 1."""
    n = (b + c).cast("double")
    acc = F.struct(F.lit(0.0).alias("log_c"), F.exp(-n * F.lit(0.6931471805599453)).alias("tail"))

    def step(a: Column, i: Column) -> Column:
        log_c = a["log_c"] + F.ln(n - i + 1) - F.ln(i.cast("double"))
        return F.struct(log_c.alias("log_c"), (a["tail"] + F.exp(log_c - n * F.lit(0.6931471805599453))).alias("tail"))

    smaller = F.least(b, c).cast("int")
    steps = F.when(smaller > 0, F.sequence(F.lit(1), smaller)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, acc, step, lambda a: a["tail"])))


def newcombe(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Difference of paired rates and its 95% interval by Newcombe's method 10."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    p1, p2 = (a + b) / F.nullif(n, F.lit(0.0)), (a + c) / F.nullif(n, F.lit(0.0))
    (l1, u1), (l2, u2) = wilson(a + b, n), wilson(a + c, n)
    den = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    phi = F.when(den > 0, (a * d - b * c) / F.nullif(den, F.lit(0.0))).otherwise(0.0)
    square = lambda x: x * x
    low = F.sqrt(F.greatest(F.lit(0.0), square(p1 - l1) - 2 * phi * (p1 - l1) * (u2 - p2) + square(u2 - p2)))
    high = F.sqrt(F.greatest(F.lit(0.0), square(p2 - l2) - 2 * phi * (p2 - l2) * (u1 - p1) + square(u1 - p1)))
    return p1 - p2, p1 - p2 - low, p1 - p2 + high


def holm(df: DataFrame, p: str, family: list[str], name: str = "p_holm", tie: str | None = None) -> DataFrame:
    """Step-down adjusted p-values within each family."""
    order = Window.partitionBy(*family).orderBy(p, *([tie] if tie else []))
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("step_", step).withColumn(name, F.max("step_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step_")


def auroc(df: DataFrame, score: str, positive: str, groups: list[str]) -> DataFrame:
    """Area under the ROC curve by groups, ties one half, null unless both classes are there: from counts by score, in one sort."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count_if(F.col(positive)).alias("p_"), F.count_if(~F.col(positive)).alias("n_"))
    below = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below_", F.coalesce(F.sum("n_").over(below), F.lit(0)))
    sums = counts.groupBy(*groups).agg(
        F.sum("p_").alias("positives"), F.sum("n_").alias("negatives"), F.sum(F.col("p_") * (F.col("below_") + F.col("n_") / 2)).alias("wins"), F.sum(F.col("p_") * F.col("n_")).alias("ties")
    )
    pairs = F.col("positives") * F.col("negatives")
    return sums.withColumn("auroc", ratio(F.col("wins"), pairs)).withColumn("tie_share", ratio(F.col("ties"), pairs))
