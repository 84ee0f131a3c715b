"""Previews of what a text hides: bounded decodings appended to it, in column functions; only the Unicode normalisation is a pandas UDF.

A view is a decoding of the text itself, never of another view: normalised without invisible characters, with
`\\uXXXX` resolved, percent-decoded, or what a Base64 token says where that is readable text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivalent.functions.text import col, is_blank, words

#: Views, characters a view, characters of all views, characters of a Base64 token, and its least words.
VIEWS, VIEW_CHARS, ALL_CHARS, TOKEN_CHARS, TOKEN_WORDS = 8, 8192, 32768, 16384, 3
#: Invisible characters, Base64 tokens, control characters that readable text has not, and the preview's wording.
INVISIBLE = r"[\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF]"
TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])"
CONTROL = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F]"
TITLE, HEAD = "\n\n[Decoded text previews]\n", "[View %d]\n"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def unescaped(text: Column) -> Column:
    """The text with its escapes resolved by the JSON parser: written as JSON, an escape of the text has two backslashes, and loses one; null where there is none."""
    written = F.to_json(F.struct(text.alias("v")))
    resolved = F.regexp_replace(written, r"\\\\u([0-9a-fA-F]{4})", r"\\u$1")
    return F.when(text.rlike(r"\\u[0-9a-fA-F]{4}"), F.from_json(resolved, "v string")["v"])


def percent_decoded(text: Column) -> Column:
    """Null where nothing is encoded, or anything that is isn't valid UTF-8."""
    valid = text.rlike("%[0-9a-fA-F]{2}") & ~text.rlike("%(?![0-9a-fA-F]{2})")
    plain = F.try_url_decode(F.replace(F.when(valid, text), F.lit("+"), F.lit("%2B")))
    return F.when(plain.contains("\ufffd") & ~text.contains("\ufffd"), None).otherwise(plain)


def readable_base64(text: Column) -> Column:
    """What the text's Base64 tokens say, in order, where it is canonical, valid UTF-8, without control characters and of some words."""

    def said(token: Column) -> Column:
        raw = F.try_to_binary(token, F.lit("base64"))
        decoded = raw.cast("string")
        whole = (F.length(token) <= TOKEN_CHARS) & (F.length(token) % 4 == 0) & (F.regexp_replace(F.base64(raw), r"[\r\n]", "") == token)
        return F.when(whole & F.is_valid_utf8(decoded) & ~decoded.rlike(CONTROL) & (F.size(words(decoded)) >= TOKEN_WORDS), decoded)

    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), said)


def decoded_views(text: Column | str, normal: Column | str) -> Column:
    """The views of a text, whose NFKC form is `normal`: distinct, within the limits, first come first kept."""
    t = col(text)
    single = F.array(F.regexp_replace(col(normal), INVISIBLE, ""), unescaped(t), percent_decoded(t))
    told = F.filter(F.array_distinct(F.array_compact(F.concat(single, readable_base64(t)))), lambda v: (v != t) & ~is_blank(v))
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(ALL_CHARS).alias("room"))

    def take(a: Column, v: Column) -> Column:
        cut = F.left(v, F.least(F.lit(VIEW_CHARS), a["room"]))
        fits = (F.size(a["kept"]) < VIEWS) & (a["room"] > 0) & ~F.array_contains(a["kept"], v)
        return F.when(fits, F.struct(F.array_append(a["kept"], cut).alias("kept"), (a["room"] - F.length(cut)).alias("room"))).otherwise(a)

    return F.aggregate(told, empty, take, lambda a: a["kept"])


def decoded_preview(df: DataFrame, text: str = "text", name: str = "preview") -> DataFrame:
    """The text with its views appended; itself where there are none, null where it is null."""
    rows = df.withColumn("normal_", nfkc(text))
    rows = rows.withColumn("views_", decoded_views(text, "normal_"))
    shown = F.array_join(F.transform("views_", lambda v, i: F.concat(F.format_string(HEAD, i + 1), v)), "\n")
    return rows.withColumn(name, F.when(F.size("views_") > 0, F.concat(F.col(text), F.lit(TITLE), shown)).otherwise(F.col(text))).drop("normal_", "views_")
