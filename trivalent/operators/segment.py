"""Segmentation: one text to many segments. Segment rows have idx, segment, start_word and end_word beside the columns they come with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import is_blank, lcg, sha, spaced_words, trailing_space, words


def validate(window: int, stride: int) -> None:
    if not all(isinstance(x, int) and x >= 1 for x in (window, stride)) or stride > window:
        raise ValueError("window and stride must be whole, positive, and the stride no larger than the window")


def _windows(n: Column, stride: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def full_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(text)).withColumns({"idx": F.lit(0), "segment": F.col(text)})


def sliding(df: DataFrame, window: int, stride: int, text: str = "text") -> DataFrame:
    """Windows of words rejoined with one space; windows that start before the end are all kept, even if the one before reached it."""
    validate(window, stride)
    split = df.withColumn("w_", words(text)).withColumn("n_", F.size("w_"))
    each = split.select("*", F.posexplode(_windows(F.col("n_"), stride)).alias("idx", "start_word"))
    end = F.least(F.col("start_word") + window, F.col("n_"))
    return each.withColumn("end_word", end).withColumn("segment", F.array_join(F.slice("w_", F.col("start_word") + 1, F.lit(window)), " ")).drop("w_", "n_")


def sliding_preserve(df: DataFrame, window: int, stride: int, text: str = "text") -> DataFrame:
    """The same windows cut from the text as it is: white space goes with the word after it, and at the end with the last."""
    validate(window, stride)
    split = df.where(~is_blank(text)).withColumn("w_", spaced_words(text)).withColumn("n_", F.size("w_")).withColumn("t_", trailing_space(text))
    each = split.select("*", F.posexplode(_windows(F.col("n_"), stride)).alias("idx", "start_word"))
    end = F.least(F.col("start_word") + window, F.col("n_"))
    piece = F.array_join(F.slice("w_", F.col("start_word") + 1, F.lit(window)), "")
    return each.withColumn("end_word", end).withColumn("segment", F.when(end == F.col("n_"), F.concat(piece, "t_")).otherwise(piece)).drop("w_", "n_", "t_")


def source_spans(turns: DataFrame, window: int, stride: int, case: str = "case_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Windows within each turn, none across turns, numbered through the case; a turn stops at the first window that reaches its end."""
    validate(window, stride)
    spans = sliding(turns, window, stride, text).drop("idx")
    last = Window.partitionBy(case, order).orderBy("start_word").rowsBetween(Window.unboundedPreceding, -1)
    n = F.max("end_word").over(Window.partitionBy(case, order))
    kept = spans.withColumn("n_", n).withColumn("far_", F.max("end_word").over(last)).where(F.col("far_").isNull() | (F.col("far_") < F.col("n_"))).drop("n_", "far_")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(case).orderBy(order, "start_word")) - 1)


def random_chunks(df: DataFrame, low: int, high: int, seed: Column, text: str = "text") -> DataFrame:
    """Disjoint chunks of random length, seeded by row; no number is drawn where the length is certain."""
    if not 1 <= low <= high:
        raise ValueError("chunk lengths must be positive and ordered")
    split = df.withColumn("w_", words(text)).withColumn("n_", F.size("w_")).withColumn("seed_", seed)
    zero = F.struct(F.col("seed_").cast("long").alias("state"), F.lit(0).alias("at"), F.array().cast("array<struct<start_word:int,end_word:int>>").alias("cuts"))

    def step(a: Column, _: Column) -> Column:
        rest = F.col("n_") - a["at"]
        upper, lower = F.least(F.lit(high), rest), F.least(F.lit(low), rest)
        drawn = lcg(a["state"])
        sure = lower >= upper
        length = F.when(sure, lower).otherwise(lower + F.floor(drawn / F.lit(4294967296.0) * (upper - lower + 1)).cast("int"))
        cut = F.array(F.struct(a["at"].alias("start_word"), (a["at"] + length).alias("end_word")))
        moved = F.struct(F.when(sure, a["state"]).otherwise(drawn).alias("state"), (a["at"] + length).alias("at"), F.concat(a["cuts"], cut).alias("cuts"))
        return F.when(rest > 0, moved).otherwise(a)

    rounds = F.when(F.col("n_") > 0, F.sequence(F.lit(1), F.ceil(F.col("n_") / low).cast("int"))).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(rounds, zero, step, lambda a: a["cuts"])
    each = split.select("*", F.posexplode(cuts).alias("idx", "c_")).select("*", "c_.start_word", "c_.end_word")
    piece = F.array_join(F.slice("w_", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " ")
    return each.withColumn("segment", piece).drop("w_", "n_", "seed_", "c_")


def coverage_new_words(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that reach further than all before them."""
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("far_", F.max("end_word").over(before)).where(F.col("far_").isNull() | (F.col("end_word") > F.col("far_"))).drop("far_")


def coverage_to_end(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments up to the first that reaches the end of the text."""
    whole = Window.partitionBy(*keys)
    n = F.max("end_word").over(whole)
    first = F.min(F.when(F.col("end_word") >= F.col("n_"), F.col("idx"))).over(whole)
    return segments.withColumn("n_", n).withColumn("first_", first).where(F.col("idx") <= F.col("first_")).drop("n_", "first_")


def identify(segments: DataFrame, case: str = "case_id") -> DataFrame:
    """Segment ids `case/idx`, hashes, and sizes."""
    return segments.withColumns({
        "segment_id": F.concat_ws("/", F.col(case).cast("string"), F.col("idx").cast("string")), "text_sha256": sha("segment"),
        "n_words": F.size(words("segment")), "n_bytes": F.octet_length("segment"),
    })


def blobs(segments: DataFrame) -> DataFrame:
    """Each distinct text once, with its sizes and how many segments it is: what a store of texts holds. segments: text_sha256, segment, n_words, n_bytes."""
    return segments.groupBy("text_sha256").agg(F.first("segment").alias("text"), F.first("n_words").alias("n_words"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("segments"))


def whole_source(segments: DataFrame, sources: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """is_whole_source: whether a segment is all of its source's text, by hash."""
    whole = sources.select(*keys, sha(text).alias("whole_"))
    return segments.join(whole, keys, "left").withColumn("is_whole_source", F.coalesce(F.col("text_sha256") == F.col("whole_"), F.lit(False))).drop("whole_")


def first_native(segments: DataFrame, order: list[str], sha_col: str = "text_sha256") -> DataFrame:
    """native is true for the first segment of each distinct input, which alone needs scoring; source_id names it."""
    same = Window.partitionBy(sha_col).orderBy(*order)
    return segments.withColumn("nth_", F.row_number().over(same)).withColumn("source_id", F.first("segment_id").over(same)).withColumn("native", F.col("nth_") == 1).drop("nth_")
