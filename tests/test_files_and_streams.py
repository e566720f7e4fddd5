"""File layouts as the reference writes them, and streams fed in several batches."""

import dataclasses
import datetime
import io
import json
import pathlib
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from aligner.operators import matchdb, telemetry
from aligner.plans import maps
from aligner.plans.resolve import resolve_with
from aligner.session import shared_dir
from aligner.sources import files, sinks
from aligner.sources.tree import Archive, RunTreeReader, last_line, last_line_ahead, read_tree
from aligner.streaming import core, jobs


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_one_object_per_file_and_parent_folder(spark, tmp_path):
    _put(tmp_path / "traces" / "a.json", json.dumps({"id": "a", "input": {"query": "q"}, "output": {"target": "t", "confidence": 0.5}}, indent=2))
    _put(tmp_path / "traces" / "b.json", json.dumps({"id": "b", "input": {"query": "q"}, "output": None}))
    _put(tmp_path / "traces" / "c.json", '{"id": "c", ')
    assert [r["id"] for r in files.read_traces(spark, str(tmp_path / "traces"), multi_line=True).collect()] == ["a"]
    _put(tmp_path / "obs" / "trace9" / "obs-1.json", json.dumps({"id": "obs-1", "name": "web_search", "output": {"sources": [1]}}, indent=1))
    got = files.read_observations(spark, str(tmp_path / "obs"), multi_line=True).head()
    assert (got["trace_id"], got["name"], json.loads(got["output"])) == ("trace9", "web_search", {"sources": [1]})
    _put(tmp_path / "run" / "trace-2.json", json.dumps({"id": "2"}))
    _put(tmp_path / "run" / "trace-1.json", json.dumps({"id": "1"}))
    _put(tmp_path / "run" / "other.json", json.dumps({"id": "3"}))
    assert [r["id"] for r in files.read_run_traces(spark, str(tmp_path / "run")).collect()] == ["1", "2"]
    _put(tmp_path / "scores" / "a.jsonl", '{"id": "s", "name": "confidence", "value": 1}\nnot json\n\n')
    scores = files.read_scores(spark, str(tmp_path / "scores"))
    assert scores.count() == 1 and scores.head()["value"] == 1.0


def test_mapping_sheet(spark, tmp_path):
    _put(tmp_path / "mappings.tsv", f"{files.MAPPINGS_HEADER}\tEntry\n steel \t Steel {{GLO}}\textra \nlone\n\n")
    got = [tuple(r) for r in files.read_mappings_tsv(spark, str(tmp_path / "mappings.tsv")).collect()]
    assert got == [("steel", "Steel {GLO}\textra"), ("lone", "")]


def test_experiment_folder(spark, tmp_path):
    run = tmp_path / "exp1" / "run1"
    _put(run / "meta.yaml", 'run_id: "r1"\nname: a: b\nstart_time: 17\nend_time: None\nno colon here\n')
    _put(run / "params" / "model", "m1\n")
    _put(run / "metrics" / "mrr", "100 0.5 0\n200 0.75 1\n")
    _put(run / "metrics" / "odd", "100 n/a 0\n")
    _put(run / "tags" / "note", "free text\nwith lines")
    _put(run / "artifacts" / "pipeline_config.json", "{}")
    tree = files.read_filestore(spark, str(tmp_path))
    meta = {r["key"]: (r["value"], r["int_value"]) for r in files.parse_meta(tree.filter(F.col("path").endswith("meta.yaml"))).collect()}
    assert meta == {"run_id": ("r1", None), "name": ("a: b", None), "start_time": ("17", 17), "end_time": (None, None)}
    fields = {(r["field"], r["key"]): (r["value"], r["number"]) for r in files.parse_fields(tree).collect()}
    assert fields == {("params", "model"): ("m1", None), ("metrics", "mrr"): ("0.75", 0.75), ("metrics", "odd"): ("n/a", None), ("tags", "note"): ("free text\nwith lines", None)}
    detail = files.run_detail(tree).head()
    assert detail["metrics"] == {"mrr": "0.75", "odd": "n/a"} and detail["artifacts"] == ["pipeline_config.json"] and detail["meta"]["start_time"] == "17"


def test_a_tree_is_read_in_buckets_of_folders(spark, tmp_path):
    runs = spark.range(600).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 90).alias("e"), "id")
    path = lambda name: F.concat(F.lit("/"), "e", F.lit("/run"), "id", F.lit(name))
    tree = runs.select(path("/metrics/loss").alias("path"), F.concat(F.lit("1 0.5 0\n2 "), "id", F.lit(" 1\n \n")).alias("content")).unionByName(
        runs.select(path("/artifacts/deep/a.json").alias("path"), F.lit("{}").alias("content")))
    root = sinks.write_filestore(tree, str(tmp_path))
    _put(tmp_path / "7" / "meta.yaml", "name: seven")
    _put(tmp_path / "7" / "traces" / "t1" / "tags" / "mode", "x")
    _put(tmp_path / "7" / "run1" / "metrics" / "none", "")
    _put(tmp_path / "stray.txt", "in no experiment")
    (tmp_path / "empty").mkdir()
    for options in ({}, {"group": 1, "buckets": 7}, {"group": 1000, "buckets": 1}):
        got = {r["path"][len(root):]: r["content"] for r in read_tree(spark, root, names_only="artifacts", **options).collect()}
        want = {f"/{0 if i % 3 == 0 else i % 90}/run{i}/{n}": c for i in range(600) for n, c in (("metrics/loss", f"2 {i} 1"), ("artifacts/deep/a.json", None))}
        assert got == want | {"/7/meta.yaml": "name: seven", "/7/traces/t1/tags/mode": "x", "/7/run1/metrics/none": ""}
    assert read_tree(spark, str(tmp_path / "empty")).count() == 0
    spread = read_tree(spark, root, group=1000, buckets=4).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 500


def test_archived_runs_are_read_as_if_unpacked(spark, tmp_path):
    runs = spark.range(600).select((F.col("id") % 90).alias("e"), "id")
    path = lambda name: F.concat(F.lit("/exp/"), "e", F.lit("/run"), "id", F.lit(name))
    tree = runs.select(path("/metrics/loss").alias("path"), F.concat(F.lit("1 0.5 0\n2 "), "id", F.lit(" 1\n \n")).alias("content")).unionByName(
        runs.select(path("/artifacts/deep/a.json").alias("path"), F.lit("{}").alias("content"))).unionByName(
        runs.select(path("/tags/note").alias("path"), F.when(F.col("id") % 2 == 0, "free\ntext ").alias("content")))
    twice = tree.unionByName(tree).unionByName(spark.createDataFrame([("/exp/stray.txt", "in no experiment")], "path string, content string"))
    loose = sinks.write_filestore(tree, str(tmp_path / "loose"))
    packed = sinks.write_filestore(twice, str(tmp_path / "packed"), archives=True, archive_files=70)
    got, want = ({r["path"][len(root):]: r["content"] for r in read_tree(spark, f"{root}/exp", names_only="artifacts").collect()} for root in (packed, loose))
    assert len(want) == 1800 and got == want
    assert read_tree(spark, f"{packed}/exp").count() == 1800
    held = [p for p in (tmp_path / "packed").rglob("*") if p.is_file() and p.name.endswith(".tar.gz")]
    assert len(held) >= 1800 / 70 and sum(p.stat().st_size for p in held) < 1800 * 100
    _put(tmp_path / "packed" / "exp" / "7" / "loose" / "meta.yaml", "name: beside")
    assert read_tree(spark, f"{packed}/exp").count() == 1801


def test_plain_archives_are_written_and_read_without_a_member_object_each(monkeypatch):
    rows = [("/exp/1/run/meta.yaml", "name: a\n"), ("/exp/1/run/tags/empty", None), ("/exp/1/run/note", "é" * 700)]
    plain = b"".join(sinks._pieces(rows))
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as out:
        for path, content in rows:
            file, raw = tarfile.TarInfo(path.split("/", 2)[2]), (content or "").encode()
            file.size = len(raw)
            out.addfile(file, io.BytesIO(raw))
    assert plain == buffer.getvalue()
    monkeypatch.setattr(tarfile, "TarInfo", None)
    assert b"".join(sinks._pieces(rows)) == plain
    assert len(b"".join(sinks._pieces([]))) == tarfile.RECORDSIZE


@pytest.mark.parametrize("odd", ["none", "long", "letters", "link", "folder", "broken"])
def test_archives_with_other_headers_are_read_by_tarfile(tmp_path, monkeypatch, odd):
    (tmp_path / "exp").mkdir()
    name = str(tmp_path / "exp" / "a.tar.gz")
    files = [("1/run/meta.yaml", b"name: a"), ("top.txt", b"x" * 600), ("1/run/metrics/loss", b"1 2 3\n" * 30_000 + b"4 5 6\n\n"), ("1/run/artifacts/b", b"hidden"),
             ({"long": "1/" + "r" * 120, "letters": "1/r\u00e9n"}.get(odd, "1/run") + "/params/p", b"v"), ("1/run/tags/t", b"")]
    with tarfile.open(name, "w:gz") as out:
        for i, (path, raw) in enumerate(files):
            file = tarfile.TarInfo(path)
            if i == 3 and odd in ("link", "folder"):
                other = tarfile.TarInfo("1/other")
                other.type, other.linkname = (tarfile.SYMTYPE, "run") if odd == "link" else (tarfile.DIRTYPE, "")
                out.addfile(other)
            file.size = len(raw)
            out.addfile(file, io.BytesIO(raw))
    if odd == "broken":
        (tmp_path / "exp" / "a.tar.gz").write_bytes((tmp_path / "exp" / "a.tar.gz").read_bytes()[:60])
    reader = RunTreeReader(str(tmp_path / "exp"), 64, 4, "artifacts")
    if odd == "broken":
        with pytest.raises((tarfile.ReadError, EOFError)):
            list(reader.read(Archive(name)))
        return
    if odd in ("none", "folder"):
        monkeypatch.setattr(tarfile, "open", None)
    got = [row for batch in reader.read(Archive(name)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    want = {"1/run/metrics/loss": "4 5 6", "1/run/artifacts/b": None}
    assert got == [(f"{tmp_path}/exp/{p}", want.get(p, raw.decode())) for p, raw in files if "/" in p]


@pytest.mark.parametrize("content", [b"", b" \n", b"1 2 3", b" 1 2 3 \n", b"\n 4 5\n\n", b"1 2\n3 4", b"1 2\n3 4\n  \n\n", b"1 2\r\n3 4\r\n", b"a\n" * 50])
@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_the_last_line_reading_ahead(content, block):
    assert last_line_ahead(io.BytesIO(content), block) == last_line(io.BytesIO(content), len(content))


def test_a_long_series_costs_one_block():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += n
            return super().read(n)

    series = b"".join(b"%d 0.%07d %d\n" % (i, i, i) for i in range(500_000))
    assert len(series) > 10_000_000
    assert last_line(Counted(series), len(series)) == b"499999 0.0499999 499999" and Counted.taken == 1 << 16
    for text, want in [(b"", b""), (b"\n \n", b""), (b"one", b"one"), (b"a\nb\n\n\n\n\n\n", b"b"), (b"first\r\n" + b"x" * 50, b"x" * 50), (b"\n  padded  \n", b"  padded")]:
        assert {last_line(io.BytesIO(text), len(text), block) for block in (1, 3, 1000)} == {want}


def _cells(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts string, workbook int, row int, col int, value string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _day():
    return F.date_trunc("day", F.col("ts").cast("timestamp"))


def _arriving(spark, path, batches):
    """A stream that sees one file per batch, in order."""
    import os
    import time
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(path))
        newest = sorted((p for p in path.glob("*.parquet")), key=os.path.getmtime)[-1]
        os.utime(newest, (time.time() - 1000 + 10 * i,) * 2)
    return core.read_stream(spark, str(path), batches[0].schema, files_per_batch=1)


def test_cell_changes_are_remembered_between_batches(spark, tmp_path):
    first = _cells(spark, [(1, "2024-01-01 00:00:00", 1, 1, 0, "a"), (2, "2024-01-01 00:00:01", 1, 1, 0, " a "), (3, "2024-01-01 00:00:02", 1, 0, 0, "header"), (4, "2024-01-01 00:00:03", 1, 2, 0, "x")])
    second = _cells(spark, [(5, "2024-01-02 00:00:00", 1, 1, 0, "a"), (6, "2024-01-02 00:00:01", 1, 1, 0, ""), (7, "2024-01-02 00:00:02", 1, 2, 0, "y"), (8, "2024-01-02 00:00:03", 1, 2, 0, "x")])
    changed = jobs.stream_changed_cells(_arriving(spark, tmp_path / "in", [first, second]), ["ts", "seq"], _day())
    assert sorted((r["seq"], r["value"]) for r in changed.collect()) == [(1, "a"), (4, "x"), (7, "y"), (8, "x")]


def test_direct_edit_takes_the_source_of_its_row(spark, tmp_path):
    first = _cells(spark, [(1, "2024-01-01 00:00:00", 1, 1, 0, "src1"), (2, "2024-01-01 00:00:01", 1, 1, 2, "T1")])
    second = _cells(spark, [(3, "2024-01-02 00:00:00", 1, 1, 2, "T2"), (4, "2024-01-02 00:00:01", 1, 5, 2, "T3"), (5, "2024-01-02 00:00:02", 1, 9, 2, "T9")])
    columns = spark.createDataFrame([(0, 2)], "input_col int, output_col int")
    stored = spark.createDataFrame([(1, 5, 0, "old")], "workbook int, row int, input_col int, source string")
    edits = jobs.stream_direct_edits(_arriving(spark, tmp_path / "in", [first, second]), columns, stored, ["ts", "seq"], _day())
    assert sorted((r["seq"], r["source"], r["target"]) for r in edits.collect()) == [(2, "src1", "T1"), (3, "src1", "T2"), (4, "old", "T3")]


def test_late_results_and_rerun_batches(spark, tmp_path):
    records = spark.sql("SELECT id AS trace_id, CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS TIMESTAMP_NTZ) AS ts, 's' AS source, "
                        "concat('t', id) AS target, 'cached' AS method, 1.0D AS confidence FROM range(3)")
    newest_first = [records.filter("trace_id = 2"), records.filter("trace_id < 2")]
    stream = _arriving(spark, tmp_path / "in", newest_first)
    history = jobs.stream_history(stream)
    assert [(r["target"], r["entries"]) for r in history.collect()] == [("t2", 3)]
    root, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    aliases = jobs.stream_match_db(stream, root, checkpoint)
    before = sorted(map(tuple, aliases.collect()))
    core.write_batch(matchdb.rebuild_aliases(newest_first[0]), root, 0)  # the same batch again
    again = jobs.stream_match_db(stream, root, checkpoint)  # nothing new to process
    assert sorted(map(tuple, again.collect())) == before and len(before) == 3
    assert [r["trace_id"] for r in jobs.stream_bounded_history(stream, 2).orderBy("trace_id").collect()] == [1, 2]


def test_match_db_snapshot_round_trip(spark, tmp_path):
    aliases = spark.sql("SELECT 'T' AS target, 's' AS source, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 1L AS trace_id, 'cached' AS method, 1.0D AS confidence, true AS verified")
    path = sinks.write_match_db(aliases, str(tmp_path), "v1")
    assert files.read_match_db(spark, path).collect() == aliases.collect()


def test_a_batch_reads_the_newest_snapshot_and_what_came_since(spark, tmp_path):
    schema = "workbook int, row int, col int, seq int, value string"
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    values = ["a", "a", "b", "b", "c", "c", "a"]

    def arrive(seqs):
        for seq in seqs:
            spark.createDataFrame([(1, 1, 0, seq, values[seq]), (1, 2, 0, seq, "same")], schema).coalesce(1).write.mode("append").json(folder)
            stream = core.read_stream(spark, folder, schema, "json", files_per_batch=1)
            out = jobs.stream_changed_cells(stream, ["seq"], F.lit(0), root, checkpoint, snapshot_every=2)
        return sorted((r["seq"], r["row"], r["value"]) for r in out.collect())

    arrive(range(5))
    for old in (0, 1, 2):  # batch 5 reads the snapshot of batch 3 and batch 4 only
        shutil.rmtree(f"{root}/state/values/batch={old}")
    shutil.rmtree(f"{root}/state/snapshots/batch=1")
    assert arrive([5, 6]) == [(0, 1, "a"), (0, 2, "same"), (2, 1, "b"), (4, 1, "c"), (6, 1, "a")]


def test_batches_are_paired_at_any_distance(spark, tmp_path):
    start, done = "batch_id long, timestamp timestamp_ntz, user_prompt string, item_count long", "batch_id long, timestamp timestamp_ntz, success_count long, error_count long, total_time_ms double"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")

    def arrive(starts, completes):
        for folder, rows, schema in (("starts", starts, start), ("completes", completes, done)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
        out = jobs.stream_batches(core.read_stream(spark, str(tmp_path / "starts"), start), core.read_stream(spark, str(tmp_path / "completes"), done), root, checkpoint)
        return sorted((r["batch_id"], r["item_count"], r["success_count"]) for r in out.collect())

    # 2 is completed before its start is seen, 3 long after, 4 never; the completion of 5 lies before its start
    first = arrive([(1, day(0), "p", 10), (3, day(0), "p", 30), (4, day(0), None, 40), (5, day(9), "p", 50)],
                   [(1, day(0), 9, 1, None), (2, day(1), 19, 1, 2.0), (5, day(1), 1, 1, 1.0)])
    assert first == [(1, 10, 9), (3, 30, None), (4, 40, None), (5, 50, None)]
    second = arrive([(2, day(0), "p", 20)], [(3, day(40), 28, 2, 1.0), (3, day(50), 1, 1, 1.0)])
    assert second == [(1, 10, 9), (2, 20, 19), (3, 30, 28), (4, 40, None), (5, 50, None)]
    assert arrive([], []) == second
    held = spark.read.parquet(core.batch_path(f"{root}/open", 1)).collect()
    assert sorted(r["batch_id"] for r in held) == [3, 4, 5, 5]  # paired batches leave the state


def test_the_key_side_is_prepared_once_per_version(spark, tmp_path):
    forward = spark.createDataFrame([("Foo", "T1", 0), ("cold rolled", "T2", 1)], "source string, target string, key_ord int")
    targets = spark.createDataFrame([("T1", 0), ("T2", 1), ("steel sheet", 2)], "target string, key_ord int")
    terms = targets.select(F.col("target").alias("term"))
    root, checkpoint, shared = (str(tmp_path / n) for n in ("out", "cp", "maps"))
    arriving = [spark.createDataFrame([row], "query_id long, query string") for row in [(1, "Foo"), (2, "cold roled"), (3, "sheet of zinc")]]

    def run(batches, known=forward, out=root, at=checkpoint):
        out = jobs.stream_resolve(_arriving(spark, tmp_path / "in", batches), known, targets, terms, root=out, checkpoint=at, maps_root=shared)
        return sorted((r["query_id"], r["target"], r["method"]) for r in out.collect())

    listed = lambda: sorted(str(p) for p in (tmp_path / "maps").rglob("*") if p.is_file())
    staged_root = pathlib.Path(shared_dir(spark)) / "aligner"
    want = [(1, "T1", "cached"), (2, "T2", "fuzzy"), (3, "steel sheet", "ProfileRank")]
    assert run(arriving[:1]) == want[:1]
    before, tables = listed(), set(staged_root.iterdir())
    assert run(arriving[1:]) == want  # two more batches, in a later run
    assert listed() == before
    key_side = {"fuzzy-keys", "token-terms", "token-blocks", "maps"}
    assert not {p.name.rsplit("-", 1)[0] for p in set(staged_root.iterdir()) - tables} & key_side
    shuffled = forward.orderBy(F.desc("key_ord"))
    assert run(arriving[:1], shuffled, str(tmp_path / "o2"), str(tmp_path / "cp2"))[0] == want[0] and listed() == before
    changed = forward.withColumn("target", F.when(F.col("source") == "Foo", "T2").otherwise(F.col("target")))
    assert run(arriving[:1], changed, str(tmp_path / "o3"), str(tmp_path / "cp3"))[0] == (1, "T2", "cached")
    assert len(listed()) > len(before)


def test_a_preparation_that_broke_off_leaves_no_version(spark, tmp_path):
    forward = spark.createDataFrame([("Foo", "T1", 0)], "source string, target string, key_ord int")
    targets = spark.createDataFrame([("T1", 0)], "target string, key_ord int")
    terms = targets.select(F.col("target").alias("term"))
    root, version = str(tmp_path / "maps"), maps.version_of(forward, targets, terms)
    maps.prepare(forward, targets, terms, folder=f"{root}/tables/{version}-half")  # no record written
    assert maps.load(spark, root, version) is None
    maps.maps_of(forward, targets, terms, root, use_fuzzy=False)
    assert maps.load(spark, root, version) is None and maps.load(spark, root, version, use_fuzzy=False).forward is None
    made = maps.maps_of(forward, targets, terms, root)
    assert maps.load(spark, root, version).terms.blocks == made.terms.blocks == 1
    empty = maps.prepare(forward.limit(0), targets.limit(0), terms.limit(0))
    queries = spark.createDataFrame([(1, "Foo"), (2, None)], "query_id long, query string")
    assert sorted((r["query_id"], r["target"]) for r in resolve_with(queries, empty).collect()) == [(1, "No matches found"), (2, "Empty value")]


def test_a_run_half_written_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "telemetry")

    def short(n, target):
        rows = [(i, datetime.datetime(2024, 1, 1 + i % 2), "s", f"q{i}", target, "cached", 0.5, 0.1) for i in range(n)]
        return telemetry.log_short_circuit(spark.createDataFrame(
            rows, "trace_id long, ts timestamp_ntz, session_id string, source string, target string, method string, confidence double, total_time double"))

    def seen(kind="traces", **part):
        return files.read_committed(spark, root, kind, **part).count()

    class Killed(Exception):
        pass

    def killed(*_):
        raise Killed

    sinks.write_telemetry(short(4, "A"), root, "r1")
    assert [seen(k) for k in files.TELEMETRY_KINDS] == [4, 4, 8, 4, 4]
    broken = dataclasses.replace(short(9, "B"), scores=short(9, "B").scores.withColumn("value", F.raise_error(F.lit("lost"))))
    for run in ("r1", "r2"):  # ends between two folders: traces and observations of the attempt are there
        with pytest.raises(Exception, match="lost"):
            sinks.write_telemetry(broken, root, run)
    assert len(list((tmp_path / "telemetry" / "traces").glob("run=*/attempt=*"))) == 3
    assert [seen(k) for k in files.TELEMETRY_KINDS] == [4, 4, 8, 4, 4]
    with monkeypatch.context() as m:  # all tables are there, the record is not
        m.setattr(sinks, "read_commits", killed)
        with pytest.raises(Killed):
            sinks.write_telemetry(short(9, "B"), root, "r1")
    assert seen() == 4
    sinks.write_telemetry(short(6, "C"), root, "r1")
    sinks.write_telemetry(short(3, "D"), root, "r2")
    targets = {r["output"]["target"] for r in files.read_committed(spark, root, "traces", run="r1").collect()}
    assert targets == {"C"} and seen() == 9 and seen(run="r2") == 3 and seen(day="2024-01-02") == 4
    assert read_commits_of(spark, root) == [("r1", 1), ("r1", 2), ("r2", 1)]


def read_commits_of(spark, root):
    return sorted((r["run"], r["number"]) for r in files.read_commits(spark, root).collect())


def test_many_batches_are_read_from_few_folders(spark, tmp_path):
    log = core.Levels(spark, str(tmp_path / "log"), "k long, n long", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), base=3)
    assert log.read().count() == 0
    one = lambda i: spark.createDataFrame([(i % 4, 1), (99, i)], "k long, n long").coalesce(1)
    opened = []
    for i in range(14):
        log.write(one(i), i)
        opened.append(len(log.folders()))
    assert opened == [1, 2, 1, 2, 3, 2, 3, 4, 1, 2, 3, 2, 3, 4]  # sums of the digits to base 3
    want = [(0, 4), (1, 4), (2, 3), (3, 3), (99, sum(range(14)))]
    assert sorted(map(tuple, log.read().collect())) == want
    log.write(one(13), 13)  # the last batch again
    assert sorted(map(tuple, log.read().collect())) == want
    core.write_batch(one(14), log.root, 14)  # lost before its mark
    assert sorted(map(tuple, log.read().collect())) == want
    for old in range(9):
        shutil.rmtree(core.batch_path(log.root, old))
    assert sorted(map(tuple, log.read().collect())) == want
    eight = core.Levels(spark, str(tmp_path / "many"), "k long", lambda rows: rows)
    for n in range(201):  # the folders follow from the last mark alone
        (tmp_path / "many" / "marks" / str(n)).mkdir(parents=True)
        assert len(eight.folders()) <= 16
