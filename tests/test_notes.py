"""Markdown notes: entries, findings and references, against what reading the texts tells."""

from pyspark.sql import functions as F

from trivalent.sources import markdown

LOG = """# Log
intro
### R0 — before any section
zero
## Week of October 3
### R1 — first run
body one

more
### L2a - own date 2026-09-30, kept
two
## 2026-11-02 later
lost line
### R3 – third
#### not a heading of an entry
"""
NOTES = """## Part
### 2.1 Detection
**O1: Short title.** tail
- Strength: **Moderate**, one suite
  and a second line
- Evidence ✔ (R12, R3–R12)
- Caveat: small
  - Follow-up: nested
- Follow-up: again

**O2b: A title that
  wraps** rest
- Strength: provisional only
## Other
**O3: bare**
"""
REFS = "see [a](../reports/x.md#top), [b](evals/runs/r1/), [w](https://e.org/a.md), [r](runs/y.md) and `../runs/z.json`, `private/p.txt.` twice [b](evals/runs/r1/)"


def test_log_entries(spark):
    docs = spark.createDataFrame([("a", LOG, "2026-08-01"), ("b", None, None), ("c", "", "2026-08-02")], "path string, text string, document_date string")
    got = [(r.path, r.entry_id, r.ordinal, r.title, r.dated, r.body) for r in markdown.log_entries(docs).orderBy("path", "ordinal").collect()]
    assert got == [
        ("a", "R0", 0, "before any section", "2026-08-01", "zero"),
        ("a", "R1", 1, "first run", "2026-10-03", "body one\n\nmore"),
        ("a", "L2a", 2, "own date 2026-09-30, kept", "2026-09-30", "two"),
        ("a", "R3", 3, "third", "2026-11-02", "#### not a heading of an entry"),
    ]


def test_findings(spark):
    docs = spark.createDataFrame([("a", NOTES), ("b", None)], "path string, text string")
    one, two, three = markdown.findings(docs).orderBy("ordinal").collect()
    assert (one.finding_id, one.section, one.section_title, one.title, one.strength, one.status, one.spot_checked) == ("O1", "2.1", "Detection", "Short title.", "moderate", "active", True)
    assert one.strength_note == "**Moderate**, one suite and a second line" and one.confounds == "small" and one.follow_up == "again"
    assert (two.finding_id, two.title, two.strength, two.status, two.spot_checked, two.section) == ("O2b", "A title that wraps", None, "provisional", False, "2.1")
    assert (three.finding_id, three.title, three.section, three.section_title, three.strength_note, three.status) == ("O3", "bare", None, None, None, "active")
    assert one.body.startswith("**O1: Short") and one.body.endswith("again") and three.body == "**O3: bare**"


def test_references(spark):
    docs = spark.createDataFrame([("a", "evals/notes", REFS)], "path string, folder string, text string")
    assert sorted((r.kind, r.value) for r in markdown.evidence_refs(docs).collect()) == [
        ("document", "evals/reports/x.md"), ("path", "evals/runs/r1"), ("path", "evals/runs/z.json"),
    ]
    row = docs.select(markdown.log_refs(F.lit("R12, R3–R12 and L1; R1234 not")).alias("x"), markdown.repo_path(F.lit("evals/a/b"), F.lit("../../../c/./d//e"), "evals").alias("p")).first()
    assert row.x == ["R12", "R3", "L1"] and row.p == "c/d/e"
