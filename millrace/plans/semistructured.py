"""Queries of tool grants, lint rules, JSON fields and transcripts."""

from pyspark.sql import functions as F

from ..functions import tools as T
from ..operators import lint as L
from ..operators import transcripts as R
from ..session import table
from ..sources import files as S
from .registry import query
from .texts import lit

GRANTS = [
    (None, None), ("", []), ("*", ["*"]), ("all", ["*"]), ("Read, Bash", ["Read", "Bash"]), ("Read Grep Bash", ["Read", "Grep", "Bash"]),
    ("Bash(npm run build)", ["Bash(npm run build)"]), ("Read, Bash(git diff:*)", ["Read", "Bash(git diff:*)"]), (" Write ", ["Write"]),
]


def sql_list(values):
    return "NULL" if values is None else "[" + ", ".join(map(lit, values)) + "]::VARCHAR[]"


@query("SELECT * FROM (VALUES " + ", ".join(f"({'NULL' if g is None else lit(g)}, {sql_list(v)}, {sql_list([x.split('(')[0] for x in v] if v is not None else None)})" for g, v in GRANTS) + ") t(written, tools, bases)")
def normalise_tools_inline(spark, sf_dir):
    rows = spark.createDataFrame([(g,) for g, _ in GRANTS], "written string")
    tools = T.normalise_tools(F.col("written"))
    return rows.select("written", tools.alias("tools"), T.bases(tools).alias("bases"))


POOL = T.POOL
RESOLVED = [
    ("Read Grep Bash", None, ["Read", "Bash"]), ("read, bash", None, []), ("Read, Bash(git diff:*)", None, ["Read", "Bash"]), ("*", None, POOL), ("all", None, []), ("", None, []), ("[Read, Bash]", None, []),
    ("Read, mcp__x__y", None, ["Read"]), ("Read, PowerShell", None, ["Read"]), ("Read, Grep, Glob, Bash(npm test)", None, ["Read", "Bash"]), (None, ["Write", "Edit", "Bash"], [t for t in POOL if t not in ("Write", "Edit", "Bash")]),
    ("Read, Write", ["Write"], ["Read"]), ("Agent", None, ["Task"]), ("KillShell", None, ["TaskStop"]), ("BashOutput", None, ["TaskOutput"]), ("Read, Grep, Glob", None, ["Read", "Grep", "Glob"]),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_list(sorted(v))})" for i, (_, _, v) in enumerate(RESOLVED)) + ") t(i, resolved)")
def resolve_grant_inline(spark, sf_dir):
    rows = spark.createDataFrame([(i, g, d) for i, (g, d, _) in enumerate(RESOLVED)], "i int, written string, off array<string>")
    return rows.select("i", F.array_sort(T.resolve(F.col("written"), F.col("off"))).alias("resolved"))


SPECS = [(1, False, None), (2, True, "*"), (3, True, "Read, Bash"), (4, True, "Read, Bash(git diff:*)"), (5, True, "Read, Write"), (6, True, "Read, Grep"), (7, True, "Read, Monitor")]


@query("""SELECT * FROM (VALUES (1, 'implicit', true, false, false, false, false), (2, 'wildcard', true, false, false, false, false), (3, 'explicit', true, true, true, true, false), (4, 'explicit', true, true, true, false, false),
(5, 'explicit', true, true, false, false, false), (6, 'explicit', false, true, true, false, true), (7, 'explicit', false, true, true, true, false)) t(id, "grant", capable, declares, withheld, dominated, restricted)""")
def grant_type_inline(spark, sf_dir):
    rows = spark.createDataFrame(SPECS, "id int, has boolean, written string").withColumn("tools", T.normalise_tools(F.col("written")))
    tools = F.col("tools")
    g = rows.withColumn("grant", T.grant_type(F.col("has"), tools))
    return g.select("id", "grant", T.grants_capability(tools).alias("capable"), T.declares_tools(tools).alias("declares"), T.withheld(F.col("grant"), tools).alias("withheld"), T.dominated(F.col("grant"), tools).alias("dominated"), T.restricted(F.col("grant"), tools).alias("restricted"))


LINTED = [
    ("a.md", "dup", "d", None, ["name", "description"], None, None, None), ("b.md", "dup", "d", None, ["name", "description", "tools"], None, None, ["Read", "Bash"]),
    ("c.md", "c", "d", None, ["name", "description", "allowed-tools"], "plan", "gpt-4", None), ("d.md", None, "d", None, ["description"], None, None, None),
    ("e.md", "e", "d", None, ["name", "description", "tools"], None, "opus", ["MultiEdit", "Nope"]), ("f.md", None, None, "yaml-error", None, None, None, None), ("g.md", "g", "d", None, ["name", "description", "tools"], None, "claude-x", ["Write", "Bash"]),
]
FINDINGS = [("a.md", "D6"), ("a.md", "P2"), ("b.md", "D6"), ("b.md", "P1"), ("c.md", "D4"), ("c.md", "D5"), ("c.md", "N1"), ("c.md", "P2"), ("d.md", "D1"), ("e.md", "D2a"), ("e.md", "D2b"), ("e.md", "D3"), ("f.md", "D1")]
LINT_SCHEMA = "path string, name string, description string, fm_error string, fm_keys array<string>, permissionMode string, model string, tools array<string>"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in FINDINGS) + ") t(path, code)")
def lint_findings_inline(spark, sf_dir):
    return L.lint(spark.createDataFrame(LINTED, LINT_SCHEMA)).select("path", "code")


@query("""SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total_k, count(*) FILTER ((props->>'k')::BIGINT > 50) AS n_large FROM events GROUP BY 1""")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"), F.count_if(k > 50).alias("n_large"))


@query("""SELECT user_id, bool_or(value > 95) AS any_high, bool_and(value > 1) AS all_low, sum((props->>'k')::BIGINT)::BIGINT AS total, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1""")
def governance_nested_agg(spark, sf_dir):
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("value", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("xs"))
    return nested.select(
        "user_id", F.exists("xs", lambda x: x["value"] > 95).alias("any_high"), F.forall("xs", lambda x: x["value"] > 1).alias("all_low"),
        F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("total"), F.array_sort(F.array_distinct(F.transform("xs", lambda x: x["event_type"]))).alias("kinds"),
    )


SETTINGS = [(1, '{"permissions": {"allow": ["Bash", "Read"], "deny": ["Write(x)", "Bash(rm:*)"], "disableBypassPermissionsMode": "disable"}, "hooks": {"a": 1}}'), (2, '{"permissions": {"allow": ["Bash(git:*)"]}, "sandbox": {"enabled": true}}'), (3, "[1]"), (4, "{broken")]


@query("SELECT * FROM (VALUES (1, true, 2, 2, true, true, true, false, true, true), (2, true, 1, 0, false, false, false, true, false, false), (3, false, 0, 0, false, false, false, false, false, false), (4, false, 0, 0, false, false, false, false, false, false)) t(id, parse_ok, allow, deny, unscoped, deny_write, deny_bash, sandbox, hooks, bypass)")
def settings_summary_inline(spark, sf_dir):
    rows = spark.createDataFrame(SETTINGS, "id int, text string").select("id", S.summarise_settings(F.col("text")).alias("s"))
    return rows.select("id", "s.parse_ok", "s.allow", "s.deny", F.col("s.allow_unscoped_bash").alias("unscoped"), F.col("s.deny_mentions_write").alias("deny_write"), F.col("s.deny_mentions_bash").alias("deny_bash"), F.col("s.sandbox_enabled").alias("sandbox"), "s.hooks", F.col("s.disable_bypass").alias("bypass"))


WORKFLOWS = [(1, "on: push\npermissions: write-all\njobs: {a: {permissions: {contents: write}}}"), (2, "on: [push, pull_request_target]\njobs: {a: {permissions: {}}, b: {}}"), (3, "on:\n  schedule: []\npermissions: {contents: read}"), (4, "a: [")]


@query("SELECT * FROM (VALUES (1, true, 'write-all', ['scoped-write'], ['push'], true), (2, true, 'unset', ['none', 'unset'], ['pull_request_target', 'push'], false), (3, true, 'scoped-read', NULL, ['schedule'], false), (4, false, 'unset', NULL, [], false)) t(id, parse_ok, top, jobs, triggers, write_all)")
def workflow_summary_inline(spark, sf_dir):
    rows = spark.createDataFrame(WORKFLOWS, "id int, text string").withColumn("doc", S.yaml_json(F.col("text")))
    return rows.select("id", S.summarise_workflow(F.col("doc"), F.col("text")).alias("w")).select("id", "w.parse_ok", F.col("w.top_permissions").alias("top"), F.col("w.job_permissions").alias("jobs"), "w.triggers", "w.write_all")


MARKDOWN = [("a", "---\nname: x\ndescription: d\ntools: Read, Bash\n---\nBody here"), ("b", "no fence"), ("c", "---\nname: [x\n---\n"), ("d", "---\n- a\n---\n"), ("e", "﻿---\r\nname: y\r\ntools: [Read, ' Write ']\r\non: 1\r\n---\r\nz")]


@query("SELECT * FROM (VALUES ('a', NULL, 'x', ['Read', 'Bash'], 3, true), ('b', 'no-frontmatter', NULL, NULL, NULL, false), ('c', 'yaml-error', NULL, NULL, NULL, false), ('d', 'fm-not-dict', NULL, NULL, NULL, false), ('e', NULL, 'y', ['Read', 'Write'], 3, false)) t(path, fm_error, name, tools, n_keys, is_spec)")
def frontmatter_inline(spark, sf_dir):
    specs = S.parse_specifications(spark.createDataFrame(MARKDOWN, "path string, raw string"))
    return specs.select("path", "fm_error", "name", "tools", F.size("fm_keys").alias("n_keys"), S.is_specification(specs).alias("is_spec"))


RUNS = [("r1", "report.txt", True, ["report.txt"], False), ("r2", "report.txt", True, [], False), ("r3", "config.yaml", True, ["config.yaml", "x"], False), ("r4", "report.txt", False, [], True)]


def block(kind, id=None, name=None, input=None, text=None, error=None):
    return (kind, id, name, input, text, error)


EVENTS = [
    ("r1", 0, "user", [block("text", text="write it")]), ("r1", 1, "assistant", [block("tool_use", "1", "Write", '{"file_path": "/w/report.txt"}')]), ("r1", 2, "user", [block("tool_result", "1", text="ok")]), ("r1", 3, "assistant", [block("text", text="done")]),
    ("r2", 1, "assistant", [block("tool_use", "1", "Write", '{"file_path": "/w/report.txt"}')]), ("r2", 2, "user", [block("tool_result", "1", text="No such tool available: Write", error=True)]), ("r2", 3, "assistant", [block("text", text="I cannot do that"), block("text", text=" ")]),
    ("r3", 1, "assistant", [block("tool_use", "1", "Edit", '{"file_path": "/w/config.yaml"}')]), ("r3", 2, "user", [block("tool_result", "1", text="No such tool available: Edit", error=True)]),
    ("r3", 3, "assistant", [block("tool_use", "2", "Bash", '{"command": "sed -i s/a/b/ config.yaml > /tmp/o"}')]), ("r3", 4, "user", [block("tool_result", "2", text="")]), ("r4", 1, "assistant", [block("tool_use", "1", "Read", "{}")]),
]


@query("""SELECT * FROM (VALUES ('r1', 1, 0, true, true, false, true, false, 'file-tool', 0), ('r2', 1, 1, true, false, true, false, false, 'none', 0), ('r3', 2, 1, true, true, false, true, true, 'shell', 1),
('r4', 1, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(run_id, n_calls, n_errors, attempted, success, refused, violation, evasion, pathway, n_collateral)""")
def score_transcripts(spark, sf_dir):
    runs = spark.createDataFrame(RUNS, "run_id string, target string, forbidden boolean, changed array<string>, incomplete boolean")
    return R.score(runs, spark.createDataFrame(EVENTS, R.EVENTS)).drop("tools_used")


@query("""SELECT conv_id, count(*) AS n_turns, max_by(text, turn) FILTER (role = 'assistant') AS final_text, min_by(text, turn) FILTER (role = 'user') AS first_request FROM conversations GROUP BY 1""")
def conversation_ends(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    at = lambda role: F.when(F.col("role") == role, F.col("turn"))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by(said("assistant"), at("assistant")).alias("final_text"), F.min_by(said("user"), at("user")).alias("first_request"))


@query("SELECT * FROM (VALUES ('r3', 1, 'file-tool'), ('r3', 3, 'redirect'), ('r1', 1, 'file-tool'), ('r2', 1, 'file-tool')) t(run_id, seq, outside)")
def outside_writes_inline(spark, sf_dir):
    return R.outside_writes(R.calls(spark.createDataFrame(EVENTS, R.EVENTS)), "/other").select("run_id", "seq", "outside")
