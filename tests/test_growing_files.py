"""Files read by ranges of bytes, in batches and while they grow; and audits as state."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trivalent.sources import files, lines
from trivalent.streaming import events as streams


def plain(data: bytes):
    parts = data.split(b"\n")
    return [(i + 1, True, x.decode()) for i, x in enumerate(parts[:-1])] + ([(len(parts), False, parts[-1].decode())] if parts[-1] else [])


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_of_any_size_give_the_lines_of_the_file(spark, tmp_path, size, monkeypatch):
    rng = random.Random(size)
    for read in (3, 1 << 20):
        monkeypatch.setattr(lines, "READ", read)
        for tail in (b"", b"unfinished"):
            data = b"".join(b"x" * rng.choice([0, 0, 1, 5, 40]) + b"\n" for _ in range(40)) + "é😀\n".encode() + tail
            (tmp_path / "f").write_bytes(data)
            found = [x for part in lines.cut(f"file://{tmp_path}/f", 0, len(data), size) for b in lines.lines(part) for x in b.to_pylist()]
            assert [(x["ended"], x["value"].decode()) for x in found] == [p[1:] for p in plain(data)]
            assert all(data[x["at"] : x["at"] + len(x["value"])] == x["value"] for x in found)


def test_lines_are_numbered_across_ranges_and_files(spark, tmp_path):
    data = {"a": b"".join(f"line {i}\n".encode() for i in range(500)) + b"tail", "b": b"\n\nx\n", "c": b"", "_hidden": b"no\n"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = lines.read_lines(spark, f"file://{tmp_path}", size=100).collect()
    for name in "abc":
        assert sorted((r.line, r.ended, r.text) for r in rows if r.file.endswith(f"/{name}")) == plain(data[name])
    assert not any("_hidden" in r.file for r in rows)
    assert lines.read_lines(spark, f"file://{tmp_path}/c").count() == 0


def test_hashes_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"abc" * 1000)
    (tmp_path / "y").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in files.inventory(spark, f"file://{tmp_path}").collect()}
    assert found == {"x": (3000, hashlib.sha256(b"abc" * 1000).hexdigest()), "y": (0, hashlib.sha256(b"").hexdigest())}
    with pytest.raises(ValueError, match="hash"):
        files.pinned(spark, f"file://{tmp_path}/x", "0" * 64)


def test_a_file_that_grows_gives_the_rows_of_one_read(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    log = folder / "run.jsonl"
    event = lambda i: json.dumps({"type": "dispatch", "n": i}) + "\n"
    run = lambda: sorted((r.at, r.text) for r in streams.merged(lines.follow(spark, f"file://{folder}", size=50), ["file", "at"], out).collect())
    log.write_text("".join(map(event, range(5))) + event(5)[:7])  # the sixth is being written
    assert len(run()) == 5
    with log.open("a") as f:
        f.write(event(5)[7:] + event(6))
    assert len(run()) == 7
    assert len(run()) == 7  # nothing new
    with log.open("a") as f:
        f.write("".join(map(event, range(7, 30))))
    (folder / "other.jsonl").write_text(event(100))
    found = run()
    whole = lines.read_lines(spark, f"file://{folder}").where("ended").collect()
    assert sorted(t for _, t in found) == sorted(r.text for r in whole) and len(found) == 31


def test_a_killed_run_counts_no_batch_twice_or_in_part(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    log = folder / "run.jsonl"
    log.write_text("a\nb\n")
    stream = lambda: lines.follow(spark, f"file://{folder}")
    streams.merged(stream(), ["file", "at"], out)
    log.write_text("a\nb\nc\nd\n")

    def dies(batch, n):
        batch.limit(1).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")  # what it leaves is half of the batch
        raise RuntimeError("killed")

    query = stream().writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(dies).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert sorted(r.text for r in streams.merged(stream(), ["file", "at"], out).collect()) == ["a", "b", "c", "d"]


def test_a_file_written_anew_is_an_error(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "f").write_text("one\ntwo\n")
    streams.merged(lines.follow(spark, f"file://{folder}"), ["file", "at"], out)
    (folder / "f").write_text("eno\nowt\nthree\n")
    with pytest.raises(Exception, match="written anew"):
        streams.merged(lines.follow(spark, f"file://{folder}"), ["file", "at"], out)


def test_updates_merge_by_key_and_are_refused_without(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = lambda data: spark.createDataFrame(data, "k string, v int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    counts = lambda: streams.read_table(spark, f"file://{tmp_path}/in", files_per_trigger=1).groupBy("k").agg(F.sum("v").alias("v"))
    rows([("a", 1), ("b", 2)])
    run = lambda: sorted(map(tuple, streams.merged(counts(), ["k"], out, "update").collect()))
    assert run() == [("a", 1), ("b", 2)]
    rows([("a", 5)])
    assert run() == [("a", 6), ("b", 2)]
    with pytest.raises(ValueError, match="update"):
        streams.drain(counts(), "update")


def test_audits_by_windows_and_by_state_agree_on_any_events(spark):
    from pyspark.sql import Row

    from trivalent.operators import audit
    from trivalent.streaming import audit as live

    rng = random.Random(3)
    protocols = {"r0": "live", "r1": "exact_input", "r2": "derived", "r3": "exact_input"}
    plan = [(r, f"s{i}", f"c{i // 2}", f"t{i % 3}", i) for r in protocols for i in range(4)]
    kinds = ["dispatch", "dispatch", "response", "response", "observation", "observation", "derived_observation", "error", "rateLimit", "note", "metadata"]
    events = []
    for r in protocols:
        for at in range(120):
            kind = rng.choice(kinds) if at or r == "r3" else "metadata"
            kind = "complete" if r == "r1" and at in (90, 91) else kind
            i = rng.randrange(5)  # the fifth is not planned
            pick = lambda right, wrong: right if rng.random() < 0.8 else wrong
            events.append((r, at, kind, pick(f"q{i}", None), f"s{i}", pick(f"c{i // 2}", "cx"), pick(f"t{i % 3}", "tx"), pick("g", None), pick(0.5, rng.choice([None, 7.0])), pick(f"s{rng.randrange(4)}", None), pick("quota", audit.PROVENANCE_FAILURE), rng.choice([4, 3])))
    df, planned = spark.createDataFrame(events, audit.EVENTS), spark.createDataFrame(plan, "run string, segment string, case_id string, sha string, ordinal int")
    runs = spark.createDataFrame([(r, "g", p) for r, p in protocols.items()], "run string, config string, protocol string")
    got = sorted((x.run, x.at, x.fault) for x in audit.audit(df.repartition(3), planned, runs).collect())
    want, notes = [], {r: live.Notes() for r in protocols}
    for e in sorted(audit.with_plan(df, planned, runs).collect(), key=lambda e: (e.run, e.at)):
        assert isinstance(e, Row)
        want += [(e.run, e.at, f) for f in live.judge(e, notes[e.run])]
    assert got == sorted(want)
    faults = {f for _, _, f in got}
    assert {"call_not_allowed", "live_not_allowed", "other_case", "provenance_failure", "no_metadata", "after_completion", "incomplete_completion", "repeated_inference", "reuse_before_source"} <= faults
