import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity as I
from millrace.functions import text as X
from millrace.operators import annotation as A
from millrace.operators import models as M
from millrace.operators import transcripts as R
from millrace.sources import files as S
from millrace.streaming import incremental as T
from millrace.streaming.stateful import closed_runs, run_to_table, score_once


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\nbroken\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"k": 3}\n')
    assert sorted(r.k for r in S.read_jsonl(spark, f"{tmp_path}/a.jsonl", "k int", tolerant=True).collect() if r.k) == [1, 2]
    assert [r.k for r in S.read_jsonl_marked(spark, f"{tmp_path}/a.jsonl", "k int").collect() if r["_corrupt"]] == [None]
    with pytest.raises(Exception):  # noqa: B017
        S.read_jsonl(spark, f"{tmp_path}/a.jsonl", "k int").collect()
    assert S.read_either(spark, f"{tmp_path}/b.jsonl", "k int").first().k == 3


def test_batches_name_their_rater(spark, tmp_path):
    for rater in ("one", "two"):
        (tmp_path / rater).mkdir()
        (tmp_path / rater / "0.jsonl").write_text('{"id": 1}\n')
    assert sorted(r.rater for r in S.read_batches(spark, f"{tmp_path}/*/*.jsonl", "id int").collect()) == ["one", "two"]


def test_markdown_to_specifications(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.md").write_text("---\nname: a\ndescription: d\ntools: [Read, Bash]\n---\nbody")
    (tmp_path / "x" / "b.md").write_text("---\nname: 0\n---\n")
    (tmp_path / "x" / "c.txt").write_text("no")
    specs = S.parse_specifications(S.read_markdown(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in specs.withColumn("ok", S.is_specification(specs)).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].ok and not got["b.md"].ok
    assert got["a.md"].tools == ["Read", "Bash"] and got["a.md"].body_head == "body" and got["b.md"].tools is None and got["b.md"].name == "0"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    S.append_new(df, f"{tmp_path}/t", "k")
    S.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), f"{tmp_path}/t", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    S.write_batches(df, f"{tmp_path}/b", 1, "k")
    assert spark.read.json(f"{tmp_path}/b").select("batch").distinct().count() == 2
    S.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["k", "v"]
    S.write_jsonl(df, f"{tmp_path}/j", compressed=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    lines = S.macros(spark.createDataFrame([("a", "1"), ("b", None)], "name string, value string")).collect()
    assert [r.line for r in lines] == ["\\newcommand{\\a}{1}", "\\newcommand{\\b}{??}"]


def test_inventory_and_transcript_files(spark):
    trees = spark.createDataFrame([("r", [("x/.claude/agents/a.md", 1, "s"), ("z.txt", 2, "t"), (".mcp.json", 3, "u")])], "repo string, cfg array<struct<p:string,s:int,sha:string>>")
    got = {r.path: r.kind for r in S.inventory_rows(trees, {"agent": r"\.claude/agents/.*\.md$", "mcp": r"\.mcp\.json$"}).collect()}
    assert got == {"x/.claude/agents/a.md": "agent", ".mcp.json": "mcp"}
    files = spark.createDataFrame([("d/agent-r1.jsonl", 1), ("e/agent-r1.jsonl", 2), ("d/agent-r2.jsonl", 1)], "path string, mtime int")
    assert {r.run_id: r.path for r in S.newest_per_run(files, r"agent-(r\d+)").collect()} == {"r1": "e/agent-r1.jsonl", "r2": "d/agent-r2.jsonl"}
    assert S.without_excluded(files, spark.createDataFrame([("r1",)], "agent_id string")).count() == 1
    assert spark.range(1).select(S.server_count(F.lit('{"mcpServers": {"a": 1, "b": 2}}')), S.server_count(F.lit("{"))).first()[:] == (2, None)


def test_transcript_helpers(spark):
    events = spark.createDataFrame([("r", 0, "user", [("text", None, None, None, "do r00007-m", None)]), ("r", 1, "user", [("tool_result", "1", None, None, "denied by policy", True)])], R.EVENTS)
    assert R.first_request(events).first().request == "do r00007-m" and R.denials(events, "policy").first().n_denials == 1
    files = spark.createDataFrame([("a", 1, "run r00007"), ("b", 2, "run r00007"), ("c", 3, "none")], "path string, mtime int, request string")
    assert [(r.run_id, r.path) for r in R.linked_to_runs(files, r"(r\d{5})").collect()] == [("r00007", "b")]
    one = spark.createDataFrame([("r00007-m", {"f": "x \n"}, "word here")], "run string, after map<string,string>, said string")
    got = one.select(
        I.build_of(F.col("run"), [5, 10], ["a", "b", "c"]), R.objective("holds", F.col("after"), F.col("said"), "f", "x"), R.objective("gone", F.col("after"), F.col("said"), "g"), R.objective("says", F.col("after"), F.col("said"), expected="word"),
        R.settings_intact(F.lit("debug: TRUE\nport: 8080"), {"port": "8080"}, "debug"), R.prompt("go {x}!", x=F.col("run")), R.intact(F.col("after"), F.create_map(F.lit("f"), F.lit("x"))),
    ).first()
    assert tuple(got) == ("b", True, True, True, True, "go r00007-m!", False)


def test_labels_and_coders(spark):
    coders = spark.createDataFrame([("d", "x"), ("d", "y")], "sample_digest string, initials string")
    assert A.check_coders(coders, "d").count() == 2
    for bad in ([("e", "x")], [("d", "x"), ("d", "x")]):
        with pytest.raises(Exception, match="digest differs|name used twice"):
            A.check_coders(spark.createDataFrame(bad, "sample_digest string, initials string"), "d").collect()
    votes = spark.createDataFrame([(i, r, "a" if i % 2 else "b") for i in range(6) for r in "pqr"], "i int, r string, v string")
    assert all(r.alpha == pytest.approx(1.0) and r.n_items == 6 for r in A.reliability(votes, "i", "r", "v").collect())


def test_one_vs_rest_separates(spark):
    rows = [(i, [float(i % 2) * 4 - 2, 0.1 * (i % 5)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    got = M.one_vs_rest(df.where("id < 50"), df.where("id >= 50"), "v", "y", 1).collect()
    assert all((r.score > 0.5) == bool(r.y) for r in got)
    assert all(r.score is None for r in M.one_vs_rest(df, df.where("id < 6"), "v", "y", 1).collect())


def test_append_and_score_once(spark, tmp_path):
    src, sink, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"k": "a", "v": 1}))
    T.append_log(spark, src, "k string, v int", f"{tmp_path}/log", f"{tmp_path}/ck0").awaitTermination()
    for n in (1, 2):
        if n == 2:
            (tmp_path / "in" / "2.json").write_text('{"k": "a", "v": 9}\n{"k": "b", "v": 2}')
        stream = spark.readStream.schema("k string, v int").json(src)
        score_once(stream, "k", ["v"], sink, ck).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1
    assert {r.k: r.v for r in spark.read.parquet(sink).collect()} == {"a": 1, "b": 2}


def test_score_once_never_reads_its_table(spark, tmp_path):
    src, sink, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("b", None, "z"), (None, 5, "n")], "k string, v int, w string").write.parquet(src)
    run = lambda: score_once(spark.readStream.schema("k string, v int, w string").parquet(src), "k", ["v", "w"], sink, ck).awaitTermination()
    run()
    first = sorted(map(tuple, spark.read.parquet(sink).collect()), key=repr)
    assert first == sorted([("a", 1, "x"), ("b", None, "z"), (None, 5, "n")], key=repr)
    (tmp_path / "out").rename(tmp_path / "kept")  # the state alone tells what was scored
    spark.createDataFrame([("a", 0, "q"), ("b", 7, "q"), ("c", 2, None), (None, 1, "q")], "k string, v int, w string").write.mode("append").parquet(src)
    run()
    assert list(map(tuple, spark.read.parquet(f"{sink}/part-*").collect())) == [("c", 2, None)]


def test_runs_close_when_time_has_passed(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    batches = [
        [("a", 0), ("a", 50), ("b", 10), ("a", 500)],
        [("a", 25), ("a", 530), ("b", 200), ("a", 460), (None, 520)],  # out of order: 25 falls into a run, 460 joins one
        [("z", 5000), ("a", 560)],
        [("a", 40), ("z", 5100)],  # 40 is behind the watermark
        [("y", 20000)],
    ]
    src, sink, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    closed = []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows], "k string, t timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
        run_to_table(closed_runs(spark.readStream.schema("k string, t timestamp_ntz").parquet(src), "t", "k", 60, "600 seconds"), sink, ck)
        seconds = lambda t: int((t - start).total_seconds())
        closed.append(list((r.k, seconds(r["first"]), seconds(r["last"]), r.n) for r in spark.read.schema("k string, first timestamp_ntz, last timestamp_ntz, n long").parquet(sink).collect()))
    over = [("a", 0, 50, 3), ("a", 460, 560, 4), ("b", 10, 10, 1), ("b", 200, 200, 1), (None, 520, 520, 1)]
    assert closed[0] == closed[1] == [] and sorted(closed[2], key=repr) == sorted(closed[3], key=repr) == sorted(over, key=repr)
    assert sorted(closed[4], key=repr) == sorted([*over, ("z", 5000, 5000, 1), ("z", 5100, 5100, 1)], key=repr)


def test_formats(spark):
    got = spark.range(1).select(X.percent(F.lit(0.955)), X.thousands(F.lit(12345)), X.interval(F.lit(0.1), F.lit(0.25)), X.prettify(F.lit("a-b_c"))).first()
    assert tuple(got) == ("95.5%", "12,345", "10.0–25.0", "a b c")
    h = spark.range(1).select(I.split_headers(F.lit("HTTP/2 200\nLink: x\nA: b: c\n\nbody")).alias("h")).first().h
    assert h.headers == {"link": "x", "a": "b: c"} and h.body == "body"
    m = spark.range(1).select(I.month_counts(F.create_map(F.lit("m202501"), F.lit(1), F.lit("x"), F.lit(2))), I.authors(F.array(F.lit("a"), F.lit(None)), F.array(F.lit("Q@x"), F.lit("Q@x")))).first()
    assert tuple(m) == ({"202501": 1}, ["a", "q@x"])


def test_json_documents_over_lines(spark, tmp_path):
    from millrace.sources.files import read_json_documents

    (tmp_path / "a.json").write_text('{\n "n": 1,\n "tags": ["x",\n "y"]\n}')
    (tmp_path / "b.json").write_text('[{"n": 2},\n {"n": 3, "tags": []}]')
    rows = read_json_documents(spark, str(tmp_path), "n long, tags array<string>").collect()
    assert sorted((r.n, r.tags) for r in rows) == [(1, ["x", "y"]), (2, None), (3, [])]


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda: sorted(r.k for r in S.read_replaced(spark, path).collect())
    S.replace_table(spark.range(5).select(F.col("id").alias("k")), path)
    before = S.read_replaced(spark, path)
    half = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        S.replace_table(half, path)
    assert rows() == list(range(5)) and len(list((tmp_path / "t").glob("version=*"))) == 2  # the torn version is there, but not in force
    S.replace_table(S.read_replaced(spark, path).select((F.col("k") + 10).alias("k")), path)  # from itself
    assert rows() == list(range(10, 15)) and sorted(r.k for r in before.collect()) == list(range(5))
    S.drop_versions(spark, path)
    assert rows() == list(range(10, 15)) and len(list((tmp_path / "t").glob("version=*"))) == 1
    assert not list((tmp_path / "t").glob("current-*"))
