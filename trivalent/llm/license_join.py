"""License scans by an exact set-similarity join with containment.

Blocks are windows of `block_words` words of a text, each half a window after the last, so that every passage of
half a window stands whole in some block, across line breaks too. A template matches a block that holds at least
`threshold` of its distinct words. The join is that of prefix filtering: template words are ordered by how many
blocks of the whole corpus hold them, rarest first (one counting pass over all documents, of which only a count
per template word leaves the tasks); a template is indexed under its first |T| - need + 1 words only, where need =
ceil(threshold |T|); a block is looked up under its own words, must have at least need words in common order
(length filter), and enough words left on both sides after the first common one (positional filter); what remains
is counted exactly. Templates are a fixed library, so they travel with the tasks; documents never shuffle.

A matching template gives its label, but for templates of which one has all the words of another and more (a notice
and its variant), where both match the same block: where none of the further words is there, the larger matches by
the smaller one's words alone and gives no label; where all are there, the smaller gives none unless it has a place
of its own, its wording outside the larger one's or enough words beside those of the larger one. `matches` has both.

Beside the join, plain phrases give the base labels.

Defined cases: a null, empty or wordless text has no places, labels or matches; very long texts are scanned whole;
repeated rows each return; with no documents or no templates there are no matches; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import HashIndex, mapped, ranges, text_bytes, text_slices, words_of

#: Phrases of the base labels: fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, words) of well-known notices and grants: fixed values.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
BLOCK_WORDS = 96
FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "matches array<struct<label:string,template:int,block_word:long,containment:double>>"
)


def hashes_of(words: list[str]) -> np.ndarray:
    """The hash of each single word, as words_of gives it."""
    if not words:
        return np.zeros(0, np.uint64)
    raw, at = text_bytes(pa.array(words))
    return words_of(raw, at)[3]


class Templates:
    """The templates in the corpus's order of words, with the prefix index."""

    def __init__(self, templates, threshold: float, counts: dict[str, int] | None = None) -> None:
        self.labels = [label for label, _ in templates]
        sets = [sorted(set(text.split())) for _, text in templates]
        counts = counts or {}
        self.words = sorted({w for s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.index = HashIndex(hashes_of(self.words))
        place = {w: i for i, w in enumerate(self.words)}
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for s in sets], np.int64)
        self.holds = np.zeros((len(self.words), len(sets)), np.int32)
        under: list[list[tuple[int, int]]] = [[] for _ in self.words]
        for t, s in enumerate(sets):
            ordered = sorted(place[w] for w in s)
            self.holds[ordered, t] = 1
            for i, w in enumerate(ordered[: len(s) - self.need[t] + 1]):
                under[w].append((t, i))
        self.under = np.array([x for u in under for x in u], np.int64).reshape(-1, 2)
        self.border = np.concatenate([[0], np.cumsum([len(u) for u in under])]).astype(np.int64)
        self.above = [{u for u, other in enumerate(sets) if set(s) < set(other)} for s in sets]
        #: Each template's wording and how often it has each word, as places from 1, like the index gives them.
        self.wording = [np.array([place[w] + 1 for w in text.split()], np.int64) for _, text in templates]
        self.times = [np.bincount(w, minlength=len(self.words) + 1) for w in self.wording]

    def runs(self, t: int, own: np.ndarray) -> int:
        """How often the words of a block have the wording of template t, word for word."""
        wording = self.wording[t]
        return int((np.lib.stride_tricks.sliding_window_view(own, len(wording)) == wording).all(1).sum()) if len(own) >= len(wording) else 0

    def apart(self, t: int, u: int, own: np.ndarray, counts: np.ndarray) -> bool:
        """Whether template t has a place in the block beside those of u, which has all its words and more."""
        if self.runs(t, own) > self.runs(u, own) * self.runs(t, self.wording[u]):
            return True
        words, more = self.times[t] > 0, (self.times[u] > 0) & (self.times[t] == 0)
        places = max(1, (counts[more] // self.times[u][more]).min())
        return int((counts > places * self.times[u])[words].sum()) >= self.need[t]

    def naming(self, found: list[int], own: np.ndarray) -> list[int]:
        """Those of the templates found in a block, of which own has the words' places, that give their label."""
        nested = [(t, u) for t in found for u in self.above[t] if u in found]
        if not nested:
            return found
        counts = np.bincount(own, minlength=len(self.words) + 1)
        more = {(t, u): counts[(self.times[u] > 0) & (self.times[t] == 0)] > 0 for t, u in nested}
        gone = {u for (t, u), there in more.items() if not there.any()}
        gone |= {t for (t, u), there in more.items() if u not in gone and there.all() and not self.apart(t, u, own, counts)}
        return [t for t in found if t not in gone]


def block_words(index: HashIndex, hashes: np.ndarray, border: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, word place from 0), sorted, and the first block of each row; block b of a row begins at its word b * width // 2."""
    half = width // 2
    n = np.diff(border)
    blocks = np.maximum(1, -(-n // half) - 1)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = index(hashes)
    at = np.flatnonzero(place)
    row = np.searchsorted(border, at, "right") - 1
    inner = (at - border[row]) // half
    span = len(index.hashes) + 1
    each = [np.where((inner >= k) & (inner - k < blocks[row]), (first[row] + inner - k) * span + place[at] - 1, -1) for k in (0, 1)]
    pairs = np.unique(np.concatenate(each))
    pairs = pairs[pairs >= 0]
    return pairs // span, pairs % span, first


def join(known: Templates, block: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, template, common words) of every block that holds enough of a template."""
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(block)))
    group = np.cumsum(new) - 1
    left = sizes[group] - (np.arange(len(block)) - starts[group])
    n = np.diff(known.border)[word]
    entry = ranges(known.border[word], n)
    template, at = known.under[entry, 0], known.under[entry, 1]
    group, left = np.repeat(group, n), np.repeat(left, n)
    need = known.need[template]
    fit = (sizes[group] >= need) & (np.minimum(known.sizes[template] - at, left) >= need)
    pairs = np.unique(group[fit] * len(known.labels) + template[fit])
    group, template = pairs // max(1, len(known.labels)), pairs % max(1, len(known.labels))
    if not len(group):
        return group, template, group
    all_words = ranges(starts[group], sizes[group])
    common = np.add.reduceat(known.holds[word[all_words], np.repeat(template, sizes[group])], np.cumsum(sizes[group]) - sizes[group])
    good = common >= known.need[template]
    return block[starts[group[good]]], template[good], common[good]


def word_counts(docs: DataFrame, templates=TEMPLATES, width: int = BLOCK_WORDS, text_col: str = "text") -> dict[str, int]:
    """How many blocks of all documents hold each template word."""
    known = Templates(templates, 1.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for _, _, raw, at in text_slices(batch.column(0)):
                _, _, border, hashes = words_of(raw, at)
                total += np.bincount(block_words(known.index, hashes, border, width)[1], minlength=len(known.words))
        yield pa.RecordBatch.from_arrays([pa.array(known.words), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}


def scan(texts: pa.Array, known: Templates, phrases, width: int) -> list[pa.Array]:
    out: list[list] = [[] for _ in range(8)]
    spelled = [(hashes_of(p.split()), label) for p, label in phrases]
    for a, b, raw, at in text_slices(texts):
        _, _, border, hashes = words_of(raw, at)
        places, labels = [], []
        for k, (phrase, _) in enumerate(spelled):
            m = len(phrase)
            found = np.flatnonzero(hashes[: max(0, len(hashes) - m + 1)] == phrase[0])
            for i in range(1, m):
                found = found[hashes[found + i] == phrase[i]]
            row = np.searchsorted(border, found, "right") - 1
            inside = found + m <= border[row + 1]
            places.append(found[inside])
            labels.append(np.full(inside.sum(), k))
        place, label = np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(labels or [np.zeros(0, np.int64)])
        base: list[list[tuple[int, str]]] = [[] for _ in range(b - a)]
        for p, d, k in zip(place.tolist(), (np.searchsorted(border, place, "right") - 1).tolist(), label.tolist(), strict=True):
            base[d].append((p - int(border[d]), spelled[k][1]))
        block, word, first = block_words(known.index, hashes, border, width)
        block, template, common = join(known, block, word)
        doc = np.searchsorted(first, block, "right") - 1
        matches: list[list[dict]] = [[] for _ in range(b - a)]
        by_block: dict[tuple[int, int], list[int]] = {}
        for d, i, t, c in zip(doc.tolist(), (block - first[doc]).tolist(), template.tolist(), common.tolist(), strict=True):
            matches[d].append({"label": known.labels[t], "template": t, "block_word": i * (width // 2), "containment": c / int(known.sizes[t])})
            by_block.setdefault((d, i), []).append(t)
        names: list[set[str]] = [set() for _ in range(b - a)]
        for (d, i), some in by_block.items():
            start = int(border[d]) + i * (width // 2)
            names[d] |= {known.labels[t] for t in known.naming(some, known.index(hashes[start : min(start + width, int(border[d + 1]))]))}
        for d, n in enumerate(np.diff(border).tolist()):
            starts, own = [p for p, _ in base[d]], {x for _, x in base[d]}
            best = max((m["containment"] for m in matches[d]), default=0.0)
            row = (n, len(starts), min(starts, default=None), max(starts, default=None), sorted(own), sorted(own | names[d]), 1.0 if starts else best, matches[d])
            for column, x in zip(out, row, strict=True):
                column.append(x)
    kind = pa.struct([("label", pa.string()), ("template", pa.int32()), ("block_word", pa.int64()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(kind)]
    return [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]


def license_scan(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, width: int = BLOCK_WORDS, id_col: str | None = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For each document the base phrases' places and labels, all labels, the best containment (1 for a phrase), and every matching block."""
    longest = max((len(text.split()) for _, text in templates), default=0)
    width = max(width, 2 * longest)  # a passage of half a window stands whole in some block
    known = Templates(templates, threshold, word_counts(docs, templates, width, text_col))
    return mapped(docs, lambda texts: scan(texts, known, phrases, width), FIELDS, id_col, text_col)


def _nested(templates, threshold: float) -> list[str]:
    """SQL rows of each pair of templates (t, u), u with all of t's words and more: what the rule of naming asks of a block."""
    spelled = [text.split() for _, text in templates]
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for t, a in enumerate(spelled):
        for u, b in enumerate(spelled):
            if set(a) < set(b):
                more, own = sorted(set(b) - set(a)), sorted(set(a))
                inside = sum(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
                rows.append(f"({t}, {u}, {quoted(more)}, {[b.count(w) for w in more]}, {quoted(own)}, {[b.count(w) for w in own]}, {quoted(a)}, {quoted(b)}, {inside}, {math.ceil(threshold * len(own) - 1e-9)})")
    return rows or ["(-1, -1, ['x'], [1], ['x'], [1], ['x'], ['x'], 0, 1)"]


def sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, width: int = BLOCK_WORDS) -> str:
    """The query's rows in DuckDB SQL, by comparing every block to every template, and every block with nested templates to their wordings."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    sets = [sorted(set(text.split())) for _, text in templates]
    values = ", ".join(f"({t}, '{label}', {quoted(s)})" for t, ((label, _), s) in enumerate(zip(templates, sets, strict=True)))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    half = width // 2
    times = lambda words: f"list_transform({words}, lambda x: len(list_filter(bw, lambda y: y = x)))"
    runs = lambda wording: f"len(list_filter(range(1, len(bw) - len({wording}) + 2), lambda o: bw[o:o + len({wording}) - 1] = {wording}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
ph AS (SELECT * FROM (VALUES {", ".join(f"('{label}', {quoted(p.split())})" for p, label in phrases)}) AS t(label, p)),
pl AS (SELECT rid, label, o FROM (SELECT rid, w, unnest(range(0, len(w))) AS o FROM d), ph WHERE w[o + 1] = p[1] AND w[o + 1:o + len(p)] = p),
b AS (SELECT rid, count(*) AS n_base, min(o) AS first_word, max(o) AS last_word, list(DISTINCT label) AS base FROM pl GROUP BY rid),
t AS (SELECT * FROM (VALUES {values}) AS t(t, label, s)),
bl AS (SELECT rid, i, w[i * {half} + 1:i * {half} + {width}] AS bw FROM (SELECT rid, w, unnest(range(0, greatest(1, ceil(len(w) / {half}.0)::BIGINT - 1))) AS i FROM d)),
bs AS (SELECT rid, i, list_distinct(bw) AS own FROM bl),
m AS MATERIALIZED (SELECT rid, i, t, label, len(list_intersect(own, s)) / len(s)::DOUBLE AS containment FROM bs, t WHERE len(list_intersect(own, s)) >= ceil({threshold}::DOUBLE * len(s) - 1e-9)),
ab AS (SELECT * FROM (VALUES {", ".join(_nested(templates, threshold))}) AS a(t, u, more, more_times, own, own_times, t_wording, u_wording, inside, need)),
ne AS (SELECT x.rid, x.i, ab.*, bw FROM ab JOIN m x ON x.t = ab.t JOIN m y ON y.t = ab.u AND y.rid = x.rid AND y.i = x.i JOIN bl ON bl.rid = x.rid AND bl.i = x.i),
nc AS (SELECT *, {times("more")} AS more_n, {times("own")} AS own_n, {runs("t_wording")} AS t_runs, {runs("u_wording")} AS u_runs FROM ne),
nd AS (SELECT *, list_sum(more_n) = 0 AS none_there, list_min(more_n) > 0 AS all_there, greatest(1, list_min(list_transform(more_n, lambda x, j: x // more_times[j]))) AS places FROM nc),
na AS (SELECT *, t_runs > u_runs * inside OR len(list_filter(list_transform(own_n, lambda x, j: x > places * own_times[j]), lambda x: x)) >= need AS apart FROM nd),
gu AS (SELECT DISTINCT rid, i, u FROM na WHERE none_there),
gt AS (SELECT DISTINCT rid, i, t FROM na WHERE all_there AND NOT apart AND NOT EXISTS (SELECT 1 FROM gu WHERE gu.rid = na.rid AND gu.i = na.i AND gu.u = na.u)),
l AS (SELECT m.rid, list(DISTINCT m.label) AS labels FROM m WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.rid = m.rid AND gu.i = m.i AND gu.u = m.t) AND NOT EXISTS (SELECT 1 FROM gt WHERE gt.rid = m.rid AND gt.i = m.i AND gt.t = m.t) GROUP BY m.rid),
s AS (SELECT rid, max(containment) AS best, count(*) AS n_matches FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score,
  coalesce(n_matches, 0) AS n_matches
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""
