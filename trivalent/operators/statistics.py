"""Sampling, thresholds, tests and resampling over case tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.stats import auroc, ratio
from trivalent.functions.text import col, sha
from trivalent.session import shared_dir


def hash_rank(seed: str, *parts: str) -> Column:
    """Order by the hash of seed and parts, joined by NUL."""
    return sha(F.concat_ws("\0", F.lit(seed), *[F.col(p).cast("string") for p in parts]))


def stratified_sample(df: DataFrame, strata: list[str], unit: str, k: int, seed: str) -> DataFrame:
    """The k units of the least hash in each stratum."""
    order = Window.partitionBy(*strata).orderBy(hash_rank(seed, unit), unit)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def length_strata(df: DataFrame, length: str, k: int, tie: str, within: list[str]) -> DataFrame:
    """stratum: how many of the edges sorted[n * i // k], i = 1..k-1, are at most the length."""
    order = Window.partitionBy(*within).orderBy(length, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*within))
    placed = df.withColumn("nth_", F.row_number().over(order) - 1).withColumn("n_", n)
    edges = [F.max(F.when(F.col("nth_") == F.floor(F.col("n_") * i / k), F.col(length))).over(Window.partitionBy(*within)) for i in range(1, k)]
    return placed.withColumn("stratum", sum(((F.col(length) >= e).cast("int") for e in edges), F.lit(0))).drop("nth_", "n_")


def round_robin(df: DataFrame, bucket: str, unit: str, quota: int, seed: str) -> DataFrame:
    """quota units, one of each bucket in turn, each bucket in hash order."""
    order = Window.partitionBy(bucket).orderBy(hash_rank(seed, unit), unit)
    return df.withColumn("round", F.row_number().over(order) - 1).orderBy("round", bucket).limit(quota)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_ = 1").drop("nth_")


def oracle_threshold(df: DataFrame, score: str, positive: str, groups: list[str], candidates: list[float]) -> DataFrame:
    """The threshold of the best balanced accuracy (score > threshold flags); ties go to the one nearest a half."""
    pos, s = F.col(positive), F.col(score)
    aggs = [a for i, t in enumerate(candidates) for a in (F.count_if(pos & (s > t)).alias(f"tp{i}"), F.count_if(~pos & (s <= t)).alias(f"tn{i}"))]
    sums = df.where(s.isNotNull()).groupBy(*groups).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"), *aggs)
    rate = lambda i: (ratio(F.col(f"tp{i}"), F.col("p")) + ratio(F.col(f"tn{i}"), F.col("n"))) / 2
    options = F.array(*[F.struct(F.round(rate(i), 9).alias("ba"), F.lit(-abs(t - 0.5)).alias("near"), F.lit(t).alias("threshold")) for i, t in enumerate(candidates)])
    best = F.array_max(options)
    return sums.select(*groups, best["threshold"].alias("threshold"), F.round(best["ba"], 6).alias("balanced_accuracy"))


#: Shares that a group's clusters are dealt over at most, and the clusters that make a share.
SHARES, SHARE_CLUSTERS = 200, 2000


def cluster_bootstrap(df: DataFrame, groups: list[str], cluster: str, value: str, weight: str, reps: int = 4000, seed: int = 0x5EED) -> DataFrame:
    """Percentile interval of sum(value) / sum(weight), clusters drawn with replacement; a row for each group, its ends the 2.5 and 97.5 % order statistics.

    Clusters are summed first and dealt over shares by hash. How many of a replicate's draws fall into each share is one
    multinomial draw, the same in every task since it has the group's own seed; within its share a task draws how often each
    cluster stands. So a large group's draws are spread over up to SHARES tasks, and replicates meet as sums.
    """
    types = dict(df.dtypes)
    sums = df.groupBy(*groups, F.col(cluster).alias("cluster_")).agg(F.sum(value).cast("double").alias("v"), F.sum(weight).cast("double").alias("w"))
    sums = sums.withColumn("bin_", F.pmod(F.xxhash64("cluster_"), F.lit(SHARES)).cast("int"))
    bins = sums.groupBy(*groups, "bin_").agg(F.count("*").alias("n_"))
    group = Window.partitionBy(*groups)  # at most SHARES rows a group
    shares = F.least(F.lit(SHARES), F.ceil(F.sum("n_").over(group) / SHARE_CLUSTERS)).cast("int")
    bins = bins.withColumn("share_", F.pmod(F.col("bin_"), shares)).withColumn("sizes_", F.sort_array(F.collect_list(F.struct("share_", "n_")).over(group)))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in [*groups, "bin_"]]
    placed = sums.alias("x").join(bins.alias("y"), same).select("x.*", "y.share_", "y.sizes_", F.xxhash64(F.lit(seed), *[F.col(f"x.{g}").cast("string") for g in groups]).alias("key_"))
    schema = ", ".join([*(f"{g} {types[g]}" for g in groups), "n_ long", "vs array<double>", "ws array<double>"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        share, key = int(pdf["share_"].iloc[0]), int(pdf["key_"].iloc[0]) % (1 << 63)
        sizes = np.zeros(share + 1 + max(x["share_"] for x in pdf["sizes_"].iloc[0]), np.int64)
        for x in pdf["sizes_"].iloc[0]:
            sizes[x["share_"]] += x["n_"]
        n = int(sizes.sum())
        drawn = np.random.default_rng(key).multinomial(n, sizes / n, reps)[:, share]
        pdf = pdf.sort_values("cluster_", kind="stable")
        v, w = pdf["v"].to_numpy(), pdf["w"].to_numpy()
        rng = np.random.default_rng([key, share + 1])
        vs, ws, left = np.zeros(reps), np.zeros(reps), drawn.copy()
        for i in range(0, len(v), 4096):  # the draws of one slice of clusters after the other
            part = slice(i, i + 4096)
            size = len(v[part])
            here = rng.binomial(left, size / (len(v) - i))
            left -= here
            for r in range(0, reps, 250):
                times = rng.multinomial(here[r : r + 250], np.full(size, 1 / size))
                vs[r : r + 250] += times @ v[part]
                ws[r : r + 250] += times @ w[part]
        row = [*(pdf[g].iloc[0] for g in groups), len(v), np.append(v.sum(), vs), np.append(w.sum(), ws)]  # the first is that of the clusters as they are
        return pd.DataFrame([row], columns=[x.split()[0] for x in schema.split(", ")])

    parts = placed.groupBy(*groups, "share_").applyInPandas(draw, schema)
    each = parts.select(*groups, "n_", F.posexplode(F.arrays_zip("vs", "ws")).alias("at", "z")).groupBy(*groups, "at").agg(F.sum("n_").alias("n_"), ratio(F.sum("z.vs"), F.sum("z.ws")).alias("x"))
    found = each.groupBy(*groups).agg(F.max("n_").alias("clusters"), F.max(F.when(F.col("at") == 0, F.col("x"))).alias("estimate"), F.sort_array(F.collect_list(F.when(F.col("at") > 0, F.col("x")))).alias("x"))  # reps values
    place = lambda share: F.get("x", F.least(F.size("x") - 1, F.round(F.size("x") * share).cast("int")))
    return found.select(*groups, "clusters", "estimate", place(0.025).alias("lower"), place(0.97475).alias("upper"))


def wilcoxon(df: DataFrame, groups: list[str], difference: str) -> DataFrame:
    """Signed-rank test by the normal approximation with ties: w_plus, n, z and the two-sided p; zero differences are left out."""
    rows = df.where(F.col(difference) != 0).groupBy(*groups, F.abs(difference).alias("d")).agg(F.count("*").alias("t"), F.count_if(F.col(difference) > 0).alias("up"))
    before = Window.partitionBy(*groups).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2
    sums = rows.withColumn("r", rank).groupBy(*groups).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    rows = sums.select(*groups, "n", "w_plus", ((F.col("w_plus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).alias("z"))
    return rows.withColumn("p", F.round(two_sided("z"), 6)).withColumn("z", F.round("z", 6))


def two_sided(z: Column | str) -> Column:
    """The two-sided p of a standard normal z: the sum of the normal density over 4,000 steps of Simpson's rule from |z| to 40; null of null."""
    size = F.abs(col(z))
    from_, steps = F.least(size, F.lit(40.0)), 4000
    width = F.least(F.lit(10.0), F.lit(40.0) - from_) / steps
    at = lambda i: F.exp(-F.pow(from_ + width * i, 2) / 2)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + at(i) * F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2))
    return F.when(size.isNotNull(), F.least(F.lit(1.0), total * width / 3 * 2 / math.sqrt(2 * math.pi)))


@dataclass(frozen=True)
class Fit:
    """A fitted model: a table of the strata (stratum_, alpha, haa, hab), the slopes, and the inverse of their curvature with the strata eliminated."""

    strata: DataFrame
    slopes: np.ndarray
    inverse: np.ndarray


def _fit(df: DataFrame, strata: str, features: list[str], label: str, ridges: tuple[float, float], steps: int) -> Fit:
    """Logistic regression with an intercept for each stratum and shared slopes; ridges are the strata's and the slopes'.

    Newton's steps with the intercepts eliminated: a row of sums for each stratum, its intercept among them, stays a table, and
    what reaches the driver is its Schur complement, a matrix of slopes squared. So strata may be as many as they like.
    """
    k, (ridge_a, ridge_b) = len(features), ridges
    rows = df.select(F.col(strata).alias("stratum_"), *[F.col(f).cast("double").alias(f"x{i}_") for i, f in enumerate(features)], F.col(label).cast("double").alias("y_"))
    x = [F.col(f"x{i}_") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    b = np.zeros(k)
    table = rows.select("stratum_").distinct().withColumn("alpha", F.lit(0.0))
    for _ in range(steps):
        known = table.select(F.col("stratum_").alias("s_"), "alpha")
        eta = F.col("alpha") + sum((c * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
        placed = rows.join(known, F.col("stratum_").eqNullSafe(F.col("s_"))).withColumn("p_", p).withColumn("r_", F.col("y_") - F.col("p_")).withColumn("w_", F.col("p_") * (1 - F.col("p_")))
        r, w = F.col("r_"), F.col("w_")
        sums = placed.groupBy("stratum_").agg(
            F.first("alpha").alias("alpha"), F.sum(r).alias("ga"), F.sum(w).alias("haa"), *[F.sum(r * c).alias(f"gb{i}") for i, c in enumerate(x)], *[F.sum(w * c).alias(f"h{i}") for i, c in enumerate(x)],
            *[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs],
        )
        sums = _stored(sums.withColumns({"ga": F.col("ga") - ridge_a * F.col("alpha"), "haa": F.col("haa") + ridge_a}))
        h = [F.col(f"h{i}") for i in range(k)]
        total = sums.agg(*[F.sum(F.col(f"gb{i}") - h[i] * F.col("ga") / F.col("haa")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col(f"h{i}_{j}") - h[i] * h[j] / F.col("haa")).alias(f"s{i}_{j}") for i, j in pairs], F.max(F.abs(F.col("ga") / F.col("haa"))).alias("a"), *[F.max(F.abs(c / F.col("haa"))).alias(f"a{i}") for i, c in enumerate(h)]).first()
        gradient = np.array([total[f"g{i}"] or 0.0 for i in range(k)]) - ridge_b * b
        curvature = ridge_b * np.eye(k)
        for i, j in pairs:
            curvature[i, j] += total[f"s{i}_{j}"] or 0.0
            curvature[j, i] = curvature[i, j]
        move = np.linalg.solve(curvature, gradient) if k else np.zeros(0)
        shift = (F.col("ga") - sum((h[i] * float(m) for i, m in enumerate(move)), F.lit(0.0))) / F.col("haa")
        table = sums.select("stratum_", (F.col("alpha") + shift).alias("alpha"), "haa", F.array(*h).cast("array<double>").alias("hab"))
        b = b + move
        # no intercept moves by more than this
        most = (total["a"] or 0.0) + sum((total[f"a{i}"] or 0.0) * abs(m) for i, m in enumerate(move))
        if max(most, np.abs(move).max() if k else 0.0) < 1e-8:
            break
    return Fit(table, b, np.linalg.inv(curvature) if k else np.zeros((0, 0)))


def stratified_logit(df: DataFrame, strata: str, features: list[str], label: str, ridge: float = 1e-3, steps: int = 25) -> DataFrame:
    """Logistic regression with an intercept for each stratum and shared slopes: estimates and standard errors."""
    fit = _fit(df, strata, features, label, (ridge, ridge), steps)
    rows = [(f, float(round(b, 6)), float(round(e, 6))) for f, b, e in zip(features, fit.slopes, np.sqrt(np.diag(fit.inverse)), strict=True)]
    slopes = df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double")
    # the variance of an intercept: its own, and through the slopes
    part = [F.col("hab")[i] / F.col("haa") for i in range(len(features))]
    variance = 1 / F.col("haa") + sum((part[i] * part[j] * float(fit.inverse[i, j]) for i in range(len(part)) for j in range(len(part))), F.lit(0.0))
    named = F.concat(F.lit(f"{strata}="), F.coalesce(F.col("stratum_").cast("string"), F.lit("None")))
    return fit.strata.select(named.alias("term"), F.round("alpha", 6).alias("estimate"), F.round(F.sqrt(variance), 6).alias("std_error")).unionByName(slopes)


#: The ridges of strata and of slopes, and the most Newton steps, of the contrast and the cross-validation.
RIDGES, STEPS = (0.1, 0.01), 50


def log_odds_ratio(df: DataFrame, strata: str, contrast: str, covariates: list[str], label: str) -> float | None:
    """The contrast's coefficient beside an intercept a stratum and the covariates, from the strata that have both labels; None without any."""
    both = df.groupBy(strata).agg(F.count_distinct(label).alias("n_")).where("n_ = 2").select(F.col(strata).alias("kept_"))
    rows = _stored(df.join(both, F.col(strata).eqNullSafe(F.col("kept_")), "left_semi").select(strata, contrast, *covariates, label))
    if rows.limit(1).count() == 0:
        return None
    return float(_fit(rows, strata, [contrast, *covariates], label, RIDGES, STEPS).slopes[0])


def cross_validated(df: DataFrame, strata: str, cluster: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """Every row with its fold, by the hash of stratum and cluster, and out_of_fold: features times the slopes that the other folds give."""
    fold = F.conv(F.left(sha(F.concat_ws("|", F.col(strata).cast("string"), F.col(cluster).cast("string"))), F.lit(8)), 16, 10).cast("long") % folds
    rows = _stored(df.withColumn("fold", fold))
    slopes = []
    for k in range(folds):
        slopes.append(_fit(rows.where(F.col("fold") != k), strata, features, label, RIDGES, STEPS).slopes.tolist())
    score = lambda b: sum((F.col(x) * v for x, v in zip(features, b, strict=True)), F.lit(0.0))
    return rows.withColumn("out_of_fold", F.coalesce(*[F.when(F.col("fold") == k, score(b)) for k, b in enumerate(slopes)]))


def within_strata_auroc(df: DataFrame, score: str, positive: str, strata: str) -> DataFrame:
    """The share of ordered pairs of a positive and a negative of the same stratum, over all strata."""
    each = auroc(df, score, positive, [strata])
    pairs = F.col("positives") * F.col("negatives")
    return each.agg(F.sum(pairs).alias("pairs"), F.round(ratio(F.sum(F.when(pairs > 0, F.col("wins"))), F.sum(pairs)), 6).alias("auroc"))


def length_bins(df: DataFrame, length: str, within: list[str], least: int = 20) -> DataFrame:
    """bin: how many of its stratum's three quartiles a row's length exceeds; null in strata of fewer than least rows."""
    quarts = df.groupBy(*within).agg(F.percentile(length, [0.25, 0.5, 0.75]).alias("q_"), F.count("*").alias("n_")).withColumnsRenamed({w: f"{w}_" for w in within})
    joined = df.join(quarts, [F.col(w).eqNullSafe(F.col(f"{w}_")) for w in within], "left")
    over = F.when(F.col("n_") >= least, F.size(F.filter("q_", lambda q: F.col(length) > q)))
    return joined.withColumn("bin", over).drop("q_", "n_", *[f"{w}_" for w in within])


def _stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: the fits pass over it many times."""
    path = shared_dir(df.sparkSession, "fit")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def out_of_sample(df: DataFrame, score: str, positive: str, groups: list[str], fit: Column, candidates: list[float]) -> DataFrame:
    """The best threshold of the rows that fit, and its balanced accuracy on the others, beside that of a half."""
    df = df.select(*groups, score, positive, fit.alias("fit_"))
    fit = F.col("fit_")
    best = oracle_threshold(df.where(fit), score, positive, groups, candidates).select(*groups, "threshold")  # a row a group
    rows = df.where(~fit & F.col(score).isNotNull()).join(best, groups)
    p, s = F.col(positive), F.col(score)

    def accuracy(t: Column) -> Column:
        return (ratio(F.count_if(p & (s > t)), F.count_if(p)) + ratio(F.count_if(~p & (s <= t)), F.count_if(~p))) / 2

    return rows.groupBy(*groups, "threshold").agg(F.round(accuracy(F.col("threshold")), 6).alias("at_threshold"), F.round(accuracy(F.lit(0.5)), 6).alias("at_half"))


def permutation_test(df: DataFrame, groups: list[str], value: str, chosen: str, most: int = 16) -> DataFrame:
    """Exact two-sided test of the difference of means: all ways to choose as many values as are chosen; a few values a group, more than `most` are an error."""
    rows = df.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(chosen).alias("c")))).alias("x"))
    n = F.when(F.size("x") <= most, F.size("x")).otherwise(F.raise_error(F.lit(f"more than {most} values in a group")))
    rows = rows.select(*groups, "x", n.alias("n"), F.size(F.filter("x", lambda e: e["c"])).alias("k"), F.aggregate("x", F.lit(0.0), lambda a, e: a + e["v"]).alias("total"))
    splits = rows.where((F.col("k") > 0) & (F.col("k") < F.col("n"))).withColumn("mask", F.explode(F.expr("sequence(0, shiftleft(1, n) - 1)"))).where(F.bit_count("mask") == F.col("k"))
    of_mask = F.aggregate(F.transform("x", lambda e, i: F.when(F.getbit("mask", i) == 1, e["v"]).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    of_chosen = F.aggregate("x", F.lit(0.0), lambda a, e: a + F.when(e["c"], e["v"]).otherwise(0.0))
    gap = lambda part: part / F.col("k") - (F.col("total") - part) / (F.col("n") - F.col("k"))
    each = splits.select(*groups, gap(of_chosen).alias("observed"), gap(of_mask).alias("drawn"))
    return each.groupBy(*groups).agg(F.round(F.first("observed"), 6).alias("difference"), F.round(F.count_if(F.abs("drawn") >= F.abs("observed") - 1e-12) / F.count("*"), 6).alias("p"), F.count("*").alias("splits"))


def paired_bootstrap(df: DataFrame, groups: list[str], dataset: str, positive: str, a: str, b: str, kind: str = "ba", reps: int = 2000, seed: int = 0x5EED) -> DataFrame:
    """Percentile interval of the mean over datasets of a's balanced accuracy (flags) or AUROC (scores) less b's, cases redrawn within each class, the same for both.

    A redraw of cases is a multinomial draw of how often each distinct (class, a, b) stands, so a group's task holds a
    row for each distinct combination and not one for each case. For AUROC, round the scores first.
    """
    if kind not in ("ba", "auroc"):
        raise ValueError(f"unknown statistic {kind}")
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(positive).isNotNull())
    cells = known.groupBy(*groups, F.col(dataset).alias("dataset_"), F.col(positive).alias("y_"), F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_")).agg(F.count("*").alias("n_"))
    schema = ", ".join([*(f"{g} {dict(df.dtypes)[g]}" for g in groups), "cases long", "estimate double", "lower double", "upper double"])

    def score(values: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The statistic for each row of times, how often each cell stands."""
        p, n = times[:, y], times[:, ~y]
        with np.errstate(invalid="ignore", divide="ignore"):
            if kind == "ba":
                parts = np.stack([(p * values[y]).sum(1) / p.sum(1), (n * (1 - values[~y])).sum(1) / n.sum(1)])
                return np.nanmean(np.where(np.isfinite(parts), parts, np.nan), axis=0)
            levels, at = np.unique(values, return_inverse=True)
            up, down = np.zeros((len(times), len(levels))), np.zeros((len(times), len(levels)))
            np.add.at(up.T, at[y], p.T)
            np.add.at(down.T, at[~y], n.T)
            below = np.cumsum(down, axis=1) - down / 2
            return (up * below).sum(1) / (up.sum(1) * down.sum(1))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dataset_", "y_", "a_", "b_"], kind="stable")
        rng, found = np.random.default_rng(seed), []
        for _, part in pdf.groupby("dataset_", sort=True, dropna=False):
            y, n = part["y_"].to_numpy(bool), part["n_"].to_numpy()
            if kind == "auroc" and (y.all() or not y.any()):
                continue
            times = np.zeros((reps + 1, len(part)))
            times[0] = n
            for side in (y, ~y):
                if side.any():
                    times[1:, side] = rng.multinomial(n[side].sum(), n[side] / n[side].sum(), reps)
            found.append(score(part["a_"].to_numpy(), y, times) - score(part["b_"].to_numpy(), y, times))
        mean = np.mean(found, axis=0) if found else np.full(reps + 1, np.nan)
        low, high = np.percentile(mean[1:], [2.5, 97.5])
        row = [*(pdf[g].iloc[0] for g in groups), int(pdf["n_"].sum()), *[float(x) if np.isfinite(x) else None for x in (mean[0], low, high)]]
        return pd.DataFrame([row], columns=[x.split()[0] for x in schema.split(", ")])

    return cells.groupBy(*groups).applyInPandas(draw, schema)
