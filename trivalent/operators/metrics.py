"""Relational metrics over case decisions; rates are null where nothing was decided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.stats import ratio


def n_if(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def confusion(cases: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fn, fp, tn and undecided, with the detection and the false-positive rate."""
    pos, flag = F.col("positive"), F.col("flagged")
    rows = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), n_if(pos & flag, "tp"), n_if(pos & ~flag, "fn"), n_if(~pos & flag, "fp"), n_if(~pos & ~flag, "tn"), n_if(flag.isNull(), "incomplete")
    )
    return rows.withColumn("detection_rate", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 6)).withColumn("false_positive_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn"), 6))


def condition_rates(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of each condition under each rule; the floor counts undecided positives against detection."""
    pos, v = F.col("positive"), F.col("verdict")
    rows = verdicts.groupBy(*keys).agg(
        F.count("*").alias("cases"), n_if(pos, "positives"), n_if(~pos, "negatives"), n_if(pos & (v == "flagged"), "detected"), n_if(pos & (v == "passed"), "missed"),
        n_if(~pos & (v == "flagged"), "clean_flags"), n_if(~pos & (v == "passed"), "clean_passes"), n_if(v == "abstained", "abstained"), n_if(v == "incomplete", "incomplete"),
    )
    c = F.col
    return rows.withColumns({
        "detection_rate": ratio(c("detected"), c("detected") + c("missed"), 4), "detection_rate_floor": ratio(c("detected"), c("positives"), 4),
        "clean_flag_rate": ratio(c("clean_flags"), c("clean_flags") + c("clean_passes"), 4), "abstention_rate": ratio(c("abstained"), c("cases"), 4),
    })


def pair(cases: DataFrame, by: str, left, right, on: list[str], carry: list[str]) -> DataFrame:
    """Cases under two values of one column, side by side: a_ and b_ before each carried column."""
    side = lambda value, p: cases.where(F.col(by) == value).select(*on, *[F.col(c).alias(f"{p}_{c}") for c in carry])
    return side(left, "a").join(side(right, "b"), on)


def paired_deltas(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of full text (a) against windows (b); pairs with an undecided side are counted apart."""
    pos, f, w = F.col("positive"), F.col("a_flagged"), F.col("b_flagged")
    both = f.isNotNull() & w.isNotNull()
    rows = pairs.groupBy(*keys).agg(
        F.count("*").alias("cases"), n_if(~both, "undecided_either"), n_if(pos & both, "paired_positives"), n_if(pos & f & w, "pos_both"), n_if(pos & f & ~w, "pos_full_only"),
        n_if(pos & ~f & w, "pos_window_only"), n_if(pos & ~f & ~w, "pos_neither"), n_if(~pos & both, "paired_negatives"), n_if(~pos & f & w, "neg_both"),
        n_if(~pos & f & ~w, "neg_full_only"), n_if(~pos & ~f & w, "neg_window_only"),
    )
    c = F.col
    return rows.withColumns({
        "detection_delta": ratio(c("pos_window_only") - c("pos_full_only"), c("paired_positives"), 4), "clean_flag_delta": ratio(c("neg_window_only") - c("neg_full_only"), c("paired_negatives"), 4),
    })


def cell_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of a model on a test; balanced accuracy is the mean of the class rates that there are."""
    scored, pos = F.col("status") == "scored", F.col("positive")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), n_if(scored, "scored"), n_if(scored & pos, "positives_scored"), n_if(scored & pos & F.col("flagged"), "true_positives"),
        n_if(scored & ~pos, "negatives_scored"), n_if(scored & ~pos & F.col("flagged"), "false_positives"), n_if(F.col("status").endswith("abstention"), "abstentions"),
        n_if(F.col("status") == "other", "other"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.median("tokens"), 6).alias("median_tokens"),
    )
    tpr, fpr = ratio(F.col("true_positives"), F.col("positives_scored")), ratio(F.col("false_positives"), F.col("negatives_scored"))
    balanced = F.coalesce((tpr + (1 - fpr)) / 2, tpr, 1 - fpr)
    return out.withColumns({"tpr": F.round(tpr, 6), "fpr": F.round(fpr, 6), "balanced_accuracy": F.round(balanced, 6)})


def paired_flips(pairs: DataFrame, test: str) -> DataFrame:
    """How model b changes the outcomes of model a, by test and, as `ALL`, over all tests."""
    pos, fa, fb = F.col("positive"), F.col("a_flagged"), F.col("b_flagged")
    sa, sb = F.col("a_status") == "scored", F.col("b_status") == "scored"
    aa, ab = F.col("a_status").endswith("abstention"), F.col("b_status").endswith("abstention")
    both, ca, cb = sa & sb, fa == pos, fb == pos
    return pairs.rollup(test).agg(
        F.count("*").alias("cases"), n_if(both, "both_scored"), n_if(both & ca & cb, "both_correct"), n_if(both & ~ca & ~cb, "both_wrong"), n_if(both & ca & ~cb, "only_a_correct"),
        n_if(both & ~ca & cb, "only_b_correct"), n_if(both & pos & fa & ~fb, "positives_lost"), n_if(both & pos & ~fa & fb, "positives_gained"),
        n_if(both & ~pos & ~fa & fb, "false_alarms_added"), n_if(both & ~pos & fa & ~fb, "false_alarms_removed"), n_if(sa & ab, "scored_to_abstained"),
        n_if(aa & sb, "abstained_to_scored"), n_if(aa & ab, "both_abstained"),
    ).withColumn(test, F.coalesce(test, F.lit("ALL")))


def macro_average(cells: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """The mean of the groups' means, each group counting once."""
    return cells.groupBy(*outer, *inner).agg(F.avg(value).alias("v_")).groupBy(*outer).agg(F.round(F.avg("v_"), 4).alias(f"macro_{value}"), F.count("*").alias("groups"))


def ranked(cells: DataFrame, value: str, within: list[str], tie: str) -> DataFrame:
    """Each row's rank by value, the leader's margin over the next, and the leader."""
    order = Window.partitionBy(*within).orderBy(F.desc_nulls_last(value), tie)
    best = Window.partitionBy(*within).orderBy(F.desc_nulls_last(value))
    return cells.withColumn("rank", F.rank().over(best)).withColumn("place", F.row_number().over(order)).withColumn("margin", F.round(F.col(value) - F.lead(value).over(order), 6))


def all_if_known(value: str, name: str) -> Column:
    """A sum that is null if any part of it is unknown."""
    return F.when(F.count("*") == F.count(value), F.sum(value)).alias(name)


def nearest_rank(value: str, share: float, name: str) -> Column:
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias(name)


def distribution(value: str) -> list[Column]:
    """n, mean, interpolated median and 95th percentile, largest and least, to four places."""
    each = {"mean": F.avg(value), "median": F.percentile(value, 0.5), "p95": F.percentile(value, 0.95), "max": F.max(value), "min": F.min(value)}
    return [F.count(value).alias("n"), *[F.round(v.cast("double"), 4).alias(k) for k, v in each.items()]]


#: Into so many shares the whole-text runs of one kind and case are dealt, each of which meets all segmenting runs of it.
SHARES = 32


def full_and_window_runs(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cases of whole-text runs beside those of segmenting runs of the same engine, rule, data, selector, turn selection and limit (no limit is a limit too), another run always.

    runs: run, engine, rule, dataset, selector, case_limit, turn_selection, strategy (`full_text` or another), segmenting. verdicts: run, case_id, flagged.

    Verdicts take on what their run is like and meet by that and the case, in one join: there are as many rows as pairs of alike runs
    times their cases, and no step moves or keeps them. The whole-text side is dealt into shares, to each of which the other is copied.
    """
    same = ["engine", "rule", "dataset", "selector", "turn_selection"]

    def side(rows: DataFrame, run: str, flag: str) -> DataFrame:
        # a limit that is null is equal to another: two plain keys in its place
        alike = rows.select("run", *same, F.col("case_limit").isNull().alias("no_limit_"), F.coalesce("case_limit", F.lit(0)).alias("limit_"))
        return verdicts.select("run", "case_id", F.col("flagged").alias(flag)).join(alike, "run").withColumnRenamed("run", run)

    full = side(runs.where("strategy = 'full_text'"), "full_run", "full_flagged").withColumn("share_", F.pmod(F.hash("full_run"), F.lit(SHARES)))
    window = side(runs.where("segmenting"), "window_run", "window_flagged").withColumn("share_", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = full.join(window, [*same, "no_limit_", "limit_", "case_id", "share_"]).where(F.col("full_run") != F.col("window_run"))
    return met.select("full_run", "window_run", "case_id", "full_flagged", "window_flagged")


def bands(score: str, edges: list[float]) -> list[Column]:
    """Counts of scores in [edge, next edge), the last closed."""
    s = F.col(score)
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out.append(n_if((s >= a) & ((s < b) if i < len(edges) - 2 else (s <= b)), f"bin_{i}"))
    return out


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
