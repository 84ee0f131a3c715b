"""Resampling that is exact, shared by many models, or nested: generating functions, one set of redraws, and a generator that is a function of its counter."""

from __future__ import annotations

import decimal
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power(counts: dict[int, int], n: int) -> dict[int, int]:
    """The coefficients of (sum of count * x^place)^n, places from 0 on, all whole numbers.

    The polynomial is packed into one decimal number, a slot of digits for each place, and raised by squaring; decimals
    multiply in quasi-linear time, so there is no n-fold convolution and no rounding.
    """
    if n == 0 or not counts:
        return {0: 1} if n == 0 else {}
    width = len(str(sum(counts.values()) ** n)) + 1
    top = max(counts)
    text = "".join(str(counts.get(p, 0)).zfill(width) for p in range(top, -1, -1))
    size = width * (top * n + 2)
    context = decimal.Context(prec=size, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN, traps=[decimal.Inexact, decimal.Overflow, decimal.InvalidOperation])
    base, found = decimal.Decimal(text), decimal.Decimal(1)
    while n:
        if n & 1:
            found = context.multiply(found, base)
        n >>= 1
        if n:
            base = context.multiply(base, base)
    digits = format(found, "f").rjust(-(-len(format(found, "f")) // width) * width, "0")
    slots = [digits[i : i + width] for i in range(0, len(digits), width)][::-1]
    zero = "0" * width
    return {p: int(s) for p, s in enumerate(slots) if s != zero}


def _at(outcomes: list[tuple[Fraction | int, int]], share: Fraction, whole: int) -> Fraction | int | None:
    """The first outcome, in order, up to which this share of all draws lies."""
    reached = 0
    for x, ways in outcomes:
        reached += ways
        if reached >= share * whole:
            return x
    return None


LOWER, UPPER = Fraction(1, 40), Fraction(39, 40)


def family_bootstrap(df: DataFrame, groups: list[str], family: str, value: str, valid: str | None = None) -> DataFrame:
    """The exact bootstrap distribution of as many drawn families as there are: of the sum of their values (whole numbers), and with `valid` of the share of valid ones.

    lower and upper are the ends of the 95% interval of the sum, lower_share and upper_share those over the valid count as
    it is; joint_lower and joint_upper are of the share whose denominator is drawn with its numerator, exact as well (draws without a valid one have no share; null where none has). Families are counted by their value first, so a group's
    task holds a row for each distinct outcome. All counts are whole numbers, so no end is moved by rounding.
    """
    sums = df.groupBy(*groups, family).agg(F.sum(value).cast("long").alias("v"), (F.sum(valid) if valid else F.lit(1)).cast("long").alias("m"))
    cells = sums.groupBy(*groups, "v", "m").agg(F.count("*").alias("n"))
    shares = ["lower_share", "upper_share", "joint_lower", "joint_upper"]
    schema = ", ".join([*(f"{g} {dict(df.dtypes)[g]}" for g in groups), "families long, mean double, lower long, upper long, p_not_above_zero double", *(f"{s} double" for s in shares)])

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [(int(v), int(m), int(n)) for v, m, n in zip(pdf["v"], pdf["m"], pdf["n"], strict=True)]
        n, least = sum(c for *_, c in cells), min(v for v, _, _ in cells)
        one: dict[int, int] = {}
        for v, _, c in cells:
            one[v - least] = one.get(v - least, 0) + c
        dist = [(p + n * least, ways) for p, ways in sorted(power(one, n).items())]
        whole = n**n
        row = [n, float(Fraction(sum(x * w for x, w in dist), whole)), int(_at(dist, LOWER, whole)), int(_at(dist, UPPER, whole)), float(Fraction(sum(w for x, w in dist if x <= 0), whole))]
        row += _shares(cells, n, least, row[2], row[3]) if valid else [None] * 4
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in groups), *row]], columns=[*groups, "families", "mean", "lower", "upper", "p_not_above_zero", *shares])

    return cells.groupBy(*groups).applyInPandas(exact, schema)


#: Up to so many families half of the draws have fewer than 2^62 ways, and shares are found from halves; above, from one packed number.
HALVES = 26
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _shares(cells: list[tuple[int, int, int]], n: int, least: int, lower: int, upper: int) -> list[float | None]:
    """Ends over the valid count as it is, and of the share drawn with its denominator."""
    given = sum(m * c for _, m, c in cells)
    ends = (_ends_of_halves if n <= HALVES else _ends_of_all)(cells, n, least)
    return [float(Fraction(x, given)) if given else None for x in (lower, upper)] + [None if x is None else float(x) for x in ends]


def _ends_of_all(cells: list[tuple[int, int, int]], n: int, least: int) -> list[Fraction | None]:
    """The ends from all outcomes: the place of x^v y^m is v + step * m."""
    step = (max(v for v, _, _ in cells) - least) * n + 1
    both: dict[int, int] = {}
    for v, m, c in cells:
        both[v - least + step * m] = both.get(v - least + step * m, 0) + c
    shares: dict[Fraction, int] = {}
    for p, ways in power(both, n).items():
        if p >= step:
            x = Fraction(p % step + n * least, p // step)
            shares[x] = shares.get(x, 0) + ways
    dist, whole = sorted(shares.items()), sum(shares.values())
    return [_at(dist, LOWER, whole), _at(dist, UPPER, whole)] if dist else [None, None]


def _sums(cells: list[tuple[int, int, int]], draws: int, least: int) -> Sums:
    """The sums of v and m over so many draws, and in how many ways each comes about; cell by cell, so that no order of draws is listed."""
    span = draws * max(m for _, m, _ in cells) + 1
    fits = (max(v for v, _, _ in cells) - least) * (draws + 1) * span < 2**62
    known = {0: (np.zeros(1, np.int64 if fits else object), np.ones(1, np.int64))}
    for i, (v, m, c) in enumerate(cells, 1):
        grown = {}
        for u in range(draws + 1) if i < len(cells) else (draws,):
            parts = [(known[u - t][0] + t * ((v - least) * span + m), known[u - t][1] * (math.comb(u, t) * c**t)) for t in range(u + 1) if u - t in known]
            place, ways = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(place, kind="stable")
            place, ways = place[order], ways[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            grown[u] = place[first], np.add.reduceat(ways, first)
        known = grown
    place, ways = known[draws]
    return place // span + draws * least, place % span, ways


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products of numbers below 2^63, by limbs of 21 bits; at most 2^20 of them."""
    limbs = lambda x: [(x >> 21 * i) & 0x1FFFFF for i in range(3)]
    return sum(int(x @ y) << 21 * (i + j) for i, x in enumerate(limbs(a)) for j, y in enumerate(limbs(b)))


def _not_above(k: int, bits: int, left: Sums, right: Sums) -> int:
    """In how many ways a sum of both halves has v * 2^bits <= k * m. Sorts left, so that the next k near by finds it almost in order."""
    wide = any(abs(k) * int(m.max()) + (int(np.abs(v).max()) << bits) >= 2**62 for v, m, _ in (left, right))
    exact = lambda x: x.astype(object) if wide else x
    order = np.argsort(exact(left[0]) * (1 << bits) - exact(left[1]) * k, kind="stable")
    for x in left:
        x[:] = x[order]
    del order
    place, ways = exact(left[0]) * (1 << bits) - exact(left[1]) * k, np.concatenate([[0], np.cumsum(left[2])])
    found = 0
    for i in range(0, len(right[0]), 1 << 20):
        v, m, w = (x[i : i + (1 << 20)] for x in right)
        found += _dot(w, ways[np.searchsorted(place, exact(m) * k - exact(v) * (1 << bits), side="right")])
    return found


def _ends_of_halves(cells: list[tuple[int, int, int]], n: int, least: int) -> list[Fraction | None]:
    """The ends from the outcomes of half of the draws: whole numbers count the draws up to a share, of which two halves make each.

    Shares of denominators up to `most` lie further apart than 2^-bits, so a step of that size in which the count passes
    what is wanted holds one share. Memory is that of the sums that half of the draws can have, never of all their pairs.
    """
    none = sum(c for _, m, c in cells if m == 0) ** n
    if not (whole := sum(c for *_, c in cells) ** n - none):
        return [None, None]
    left = _sums(cells, n // 2, least)
    right = left if n % 2 == 0 else _sums(cells, n - n // 2, least)
    zero = [tuple(x[half[1] == 0] for x in half) for half in (left, right)]
    below = _not_above(0, 0, *zero) if all(len(z[0]) for z in zero) else 0  # without a valid one, and a sum up to zero
    most = n * max(m for _, m, _ in cells)
    bits = 2 * most.bit_length() + 1
    guess = (sum(v * c for v, _, c in cells) << bits) // sum(m * c for _, m, c in cells)

    def end(share: Fraction) -> Fraction:
        need = math.ceil(share * whole)
        over = lambda k: _not_above(k, bits, left, right) - below - need
        low = high = guess
        wide = abs(guess) // 8 + 1
        at_low = at_high = over(guess)
        while at_low >= 0:
            high, at_high, low, wide = low, at_low, low - wide, wide * 2
            at_low = over(low)
        while at_high < 0:
            low, at_low, high, wide = high, at_high, high + wide, wide * 2
            at_high = over(high)
        a, b, turn = Fraction(at_low), Fraction(at_high + 1), 0
        while high - low > 1:  # by the line between the ends, an end that stays weighing half; each third time in the middle
            turn += 1
            k = (low + high) // 2 if turn % 3 == 0 else low + int((high - low) * (-a / (b - a)))
            k = min(max(k, low + 1), high - 1)
            if (at := over(k)) < 0:
                low, a, b = k, Fraction(at), b / 2
            else:
                high, b, a = k, Fraction(at + 1), a / 2
        return Fraction(low + high, 2 << bits).limit_denominator(most)

    return [end(LOWER), end(UPPER)]


def _statistic(kind: str, values: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Balanced accuracy of flags or AUROC of scores, of one model, for each row of times: how often each cell stands. Unknown values (NaN) are left out."""
    known = np.isfinite(values)
    p, n = times[:, y & known].astype(float), times[:, ~y & known].astype(float)
    up, down = values[y & known], values[~y & known]
    with np.errstate(invalid="ignore", divide="ignore"):
        if kind == "ba":
            rates = np.stack([(p @ up) / p.sum(1), (n @ (1 - down)) / n.sum(1)])
            there = np.isfinite(rates)
            return np.where(there, rates, 0).sum(0) / there.sum(0)
        levels = np.unique(np.concatenate([up, down]))
        high, low = np.zeros((len(times), len(levels))), np.zeros((len(times), len(levels)))
        np.add.at(high.T, np.searchsorted(levels, up), p.T)
        np.add.at(low.T, np.searchsorted(levels, down), n.T)
        return (high * (np.cumsum(low, axis=1) - low / 2)).sum(1) / (high.sum(1) * low.sum(1))


def _interval(x: np.ndarray) -> list[float | None]:
    x = x[np.isfinite(x)]
    return [float(v) for v in np.percentile(x, [2.5, 97.5])] if len(x) else [None, None]


def shared_redraws(df: DataFrame, groups: list[str], dataset: str, case: str, positive: str, model: str, value: str, models: list, kind: str = "ba", reps: int = 2000, seed: int = 0x5EED) -> DataFrame:
    """Every model's mean over datasets of balanced accuracy (flags as 0 and 1) or AUROC (scores), all by the same redraws of cases within each class.

    A row for each group and model: estimate with its 95% interval, its rank, the share of redraws that it leads, its margin
    over the next with interval; and for the group the spread of all models, range and standard deviation, with intervals.
    Cases that all models treat alike are one cell, and a redraw of cases is one multinomial draw over a class's cells: so a
    task holds cells, not cases, and no model has redraws of its own. For AUROC, round the scores first. Values that are null
    are left out of their model's statistic.
    """
    if kind not in ("ba", "auroc"):
        raise ValueError(f"unknown statistic {kind}")
    names = [f"m{i}_" for i in range(len(models))]
    keys = [*groups, F.col(dataset).alias("dataset_"), F.col(positive).alias("y_")]
    wide = df.where(F.col(positive).isNotNull()).groupBy(*keys, F.col(case).alias("case_")).agg(*[F.max(F.when(F.col(model) == m, F.col(value).cast("double"))).alias(n) for m, n in zip(models, names, strict=True)])
    cells = wide.groupBy(*groups, "dataset_", "y_", *names).agg(F.count("*").alias("n_"))
    numbers = ["estimate", "lower", "upper", "top_share", "margin", "margin_lower", "margin_upper", "range", "range_lower", "range_upper", "sd", "sd_lower", "sd_upper"]
    schema = ", ".join([*(f"{g} {dict(df.dtypes)[g]}" for g in groups), f"model {dict(df.dtypes)[model]}", "cases long", "place int", *(f"{x} double" for x in numbers)])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dataset_", "y_", *names], kind="stable", na_position="first")
        rng, each = np.random.default_rng(seed), []
        for _, part in pdf.groupby("dataset_", sort=True, dropna=False):
            y, n = part["y_"].to_numpy(bool), part["n_"].to_numpy()
            times = np.zeros((reps + 1, len(part)), np.int64)
            times[0] = n  # the cases as they are
            for side in (y, ~y):
                if side.any():
                    times[1:, side] = rng.multinomial(n[side].sum(), n[side] / n[side].sum(), reps)
            each.append([_statistic(kind, part[m].to_numpy(float), y, times) for m in names])
        with np.errstate(invalid="ignore"):
            each = np.array(each)
            known = np.isfinite(each)
            mean = np.where(known, each, 0).sum(0) / np.maximum(known.sum(0), 1)
            mean[known.sum(0) == 0] = np.nan
        order = sorted(range(len(models)), key=lambda i: (-mean[i, 0] if np.isfinite(mean[i, 0]) else np.inf, i))
        best = np.where(np.isfinite(mean), mean, -np.inf).max(0)
        spread = [np.ptp(mean, axis=0), np.std(mean, axis=0, ddof=1) if len(models) > 1 else np.full(reps + 1, np.nan)]
        rows = []
        for place, i in enumerate(order, 1):
            margin = mean[i] - mean[order[place]] if place < len(order) else np.full(reps + 1, np.nan)
            row = [mean[i, 0], *_interval(mean[i, 1:]), np.mean(mean[i, 1:] >= best[1:]), margin[0], *_interval(margin[1:])]
            for s in spread:
                row += [s[0], *_interval(s[1:])]
            rows.append([*(pdf[g].iloc[0] for g in groups), models[i], int(pdf["n_"].sum()), place, *[None if x is None or not np.isfinite(x) else float(x) for x in row]])
        return pd.DataFrame(rows, columns=[*groups, "model", "cases", "place", *numbers])

    return cells.groupBy(*groups).applyInPandas(draw, schema)


#: Fixed values of the 32-bit generator that is a function of seed and counter: the step, and the mixing shifts and masks.
STEP, SHIFTS, MASKS = 0x6D2B79F5, (15, 7, 14), (1, 61)


def mulberry32(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first, first + 1 ... of the generator of this seed, from 0 to below 1. Its state is seed + counter * STEP, so no draw needs the one before."""
    state = (np.uint64(seed & 0xFFFFFFFF) + (np.arange(first + 1, first + 1 + n, dtype=np.uint64) * np.uint64(STEP))) & np.uint64(0xFFFFFFFF)
    mask = np.uint64(0xFFFFFFFF)
    right = lambda x, k: x >> np.uint64(k)
    t = ((state ^ right(state, SHIFTS[0])) * (state | np.uint64(MASKS[0]))) & mask
    t ^= (t + (((t ^ right(t, SHIFTS[1])) * (t | np.uint64(MASKS[1]))) & mask)) & mask
    return (t ^ right(t, SHIFTS[2])) / 4294967296.0


#: Replicates that a task draws at once for one dataset.
BLOCK = 250


def nested_bootstrap(df: DataFrame, groups: list[str], dataset: str, cluster: str, value: str, weight: str, reps: int = 2000, seed: int = 0x5EED) -> DataFrame:
    """Clusters redrawn within their dataset: the mean over datasets of sum(value) / sum(weight), with its 95% interval (interpolated percentiles).

    A group's draws are one stream: for each replicate the datasets in order, and for each as many draws as it has clusters,
    in order of their names. The generator gives any stretch of the stream, so (dataset, block of replicates) are
    tasks of their own that see only their clusters' sums.
    """
    types = dict(df.dtypes)
    sums = df.groupBy(*groups, F.col(dataset).alias("dataset_"), F.col(cluster).alias("cluster_")).agg(F.sum(value).cast("double").alias("v"), F.sum(weight).cast("double").alias("w"))
    sizes = sums.groupBy(*groups, "dataset_").agg(F.count("*").alias("n_"))
    lists = sizes.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("dataset_", "n_"))).alias("sizes_"))  # a row for each dataset of a group
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-reps // BLOCK) - 1))).alias("block_")
    placed = sums.alias("x").join(lists.alias("y"), same("x", "y") or F.lit(True)).select("x.*", "y.sizes_", blocks)
    schema = ", ".join([*(f"{g} {types[g]}" for g in groups), "dataset_ string, rep_ long, x_ double"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_", kind="stable")
        own, sizes = pdf["dataset_"].iloc[0], [(s["dataset_"], s["n_"]) for s in pdf["sizes_"].iloc[0]]
        names = [d for d, _ in sizes]
        before, total, n = sum(s for _, s in sizes[: names.index(own)]), sum(s for _, s in sizes), len(pdf)
        v, w = pdf["v"].to_numpy(), pdf["w"].to_numpy()
        first = int(pdf["block_"].iloc[0]) * BLOCK
        wanted = range(first, min(first + BLOCK, reps))
        found = [(b, np.floor(mulberry32(seed, b * total + before, n) * n).astype(np.int64)) for b in wanted]
        rows = [(b, v[i].sum(), w[i].sum()) for b, i in found]
        if not first:
            rows.append((-1, v.sum(), w.sum()))  # the clusters as they are
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in groups), str(own), b, x / y if y else None] for b, x, y in rows], columns=[*groups, "dataset_", "rep_", "x_"])

    each = placed.groupBy(*groups, "dataset_", "block_").applyInPandas(draw, schema).groupBy(*groups, "rep_").agg(F.avg("x_").alias("x_"))
    drawn = F.when(F.col("rep_") >= 0, F.col("x_"))
    return each.groupBy(*groups).agg(F.max(F.when(F.col("rep_") < 0, F.col("x_"))).alias("estimate"), F.percentile(drawn, 0.025).alias("lower"), F.percentile(drawn, 0.975).alias("upper"))


def whole_groups(df: DataFrame, facet: str, groups: int, order) -> DataFrame:
    """The rows of the first so many groups by an order of their keys, every group whole; fewer groups than asked for are an error. order takes the key's column name."""
    keys = df.where(F.col(facet).isNotNull()).select(F.col(facet).cast("string").alias("key_")).distinct()
    chosen = keys.orderBy(order("key_"), "key_").limit(groups)
    enough = chosen.agg(F.count("*").alias("n_")).select(F.when(F.col("n_") < groups, F.raise_error(F.lit(f"fewer than {groups} groups"))).otherwise(F.lit(True)).cast("boolean").alias("ok_"))
    kept = df.join(chosen, F.col(facet).cast("string") == F.col("key_"), "left_semi")
    return kept.crossJoin(F.broadcast(enough)).where("ok_").drop("ok_")  # one row

