"""Queries over markdown notes; a note is made from the key of each event."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query
from trivalent.sources import markdown

_LOG = "# Notes\n### R{n} — opening\nfirst {n}\n## October 4\n### L{n}a - second\n\nmore\nlines {n}\n## 2026-11-02\ndropped\n### R7 — third 2026-09-30\n"
_FOUND = "## Part\n### 3.1 Rates of {n}\n**O{n}: Title that\n  wraps** tail\n- Strength: **Strong** over {n}\n  runs\n- Caveat: few\n- Evidence ✔ R{n}\n\n**O9b: Later is retracted**\n## End\n**O8: bare**\n"
_REFS = "[a](../reports/n{n}.md#top) and `runs/r{n}/out.json`, [a](../reports/n{n}.md), [w](https://e.org/x.md), [p](evals/private/k{n})."


def _notes(spark, sf, body):
    e = F.col("event_id").cast("string")
    return fx.table(spark, sf, "events").select(e.alias("path"), F.lit("evals/notes").alias("folder"), F.lit("2026-08-01").alias("document_date"), F.replace(F.lit(body), F.lit("{n}"), e).alias("text"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS path FROM events) SELECT path, 'R' || path AS entry_id, 0 AS ordinal, 'opening' AS title, '2026-08-01' AS dated, 'first ' || path AS body FROM e
UNION ALL SELECT path, 'L' || path || 'a', 1, 'second', '2026-10-04', 'more' || chr(10) || 'lines ' || path FROM e UNION ALL SELECT path, 'R7', 2, 'third 2026-09-30', '2026-09-30', '' FROM e""")
def note_log_entries(spark, sf):
    return markdown.log_entries(_notes(spark, sf, _LOG))


@query("""WITH e AS (SELECT event_id::VARCHAR AS path FROM events)
SELECT path, 'O' || path AS finding_id, 0 AS ordinal, '3.1' AS section, 'Rates of ' || path AS section_title, 'Title that wraps' AS title, 'strong' AS strength, '**Strong** over ' || path || ' runs' AS strength_note, 'few' AS confounds, 'active' AS status, true AS spot_checked FROM e
UNION ALL SELECT path, 'O9b', 1, '3.1', 'Rates of ' || path, 'Later is retracted', NULL, NULL, NULL, 'retracted', false FROM e UNION ALL SELECT path, 'O8', 2, NULL, NULL, 'bare', NULL, NULL, NULL, 'active', false FROM e""")
def note_findings(spark, sf):
    return markdown.findings(_notes(spark, sf, _FOUND)).drop("follow_up", "body")


@query("""WITH e AS (SELECT event_id::VARCHAR AS path FROM events) SELECT path, 'document' AS kind, 'evals/reports/n' || path || '.md' AS value FROM e UNION ALL SELECT path, 'path', 'evals/private/k' || path FROM e""")
def note_references(spark, sf):
    return markdown.evidence_refs(_notes(spark, sf, _REFS))
