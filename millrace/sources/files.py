"""Readers and writers: JSON Lines, Markdown with frontmatter, YAML and JSON settings, reports, resumable sinks."""

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.sampling import fixed_batches

CORRUPT = "_corrupt"


def read_jsonl(spark, path, schema, tolerant=False):
    """JSON Lines, plain or gzip by suffix; blank lines are skipped. Tolerant reading drops malformed lines, else they raise."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_jsonl_marked(spark, path, schema):
    """JSON Lines with malformed lines kept in the column _corrupt."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if isinstance(schema, T.StructType) else f"{schema}, {CORRUPT} string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_json_documents(spark, path, schema):
    """Files that each hold one JSON document, or an array of them, over any number of lines; malformed files are rows of NULLs."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_batches(spark, glob, schema, level=2):
    """A folder of batch files, with the rater named by the folder `level` steps up the path."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    return rows.withColumn("rater", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -level))


def exists(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_either(spark, path, schema):
    """The plain file, else its gzip form."""
    return read_jsonl(spark, path if exists(spark, path) else f"{path}.gz", schema)


def read_markdown(spark, root):
    """Every Markdown file below a folder: path and raw text."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def _yaml(texts: pd.Series) -> pd.Series:
    import yaml

    def one(t):
        if t is None:
            return None
        try:
            d = yaml.safe_load(t)
        except yaml.YAMLError:
            return json.dumps({"error": "yaml-error"})
        if not isinstance(d, dict):
            return json.dumps({"error": "fm-not-dict"})
        keys = ["on" if k is True else str(k) for k in d]
        return json.dumps({"keys": sorted(keys), "value": dict(zip(keys, d.values(), strict=True))}, default=str, ensure_ascii=False)

    return texts.map(one)


def yaml_json(column):
    """YAML text as JSON {keys, value} or {error}; no native YAML reader exists. A bare `on` is the key on, not true."""
    return F.pandas_udf(_yaml, "string")(column)


FIELDS = ("name", "description", "model", "permissionMode")


def parse_specifications(files):
    """Specification records from path and raw text: frontmatter fields, tool list, error class, body, content hash."""
    base = files.withColumn("fm", X.frontmatter(F.col("raw"))).withColumn("body", X.body(F.col("raw")))
    parsed = base.withColumn("doc", yaml_json(F.col("fm")))
    tools_text, tools_list = F.get_json_object("doc", "$.value.tools"), F.from_json(F.get_json_object("doc", "$.value.tools"), "array<string>")
    from ..functions.tools import normalise_list, normalise_tools

    is_list = F.coalesce(tools_text.startswith("["), F.lit(False)) & tools_list.isNotNull()
    return parsed.select(
        "path",
        F.octet_length("raw").cast("long").alias("bytes"),
        F.substring(F.sha2("raw", 256), 1, 16).alias("hash"),
        F.when(F.col("fm").isNull(), "no-frontmatter").otherwise(F.get_json_object("doc", "$.error")).alias("fm_error"),
        *[F.get_json_object("doc", f"$.value.{f}").alias(f) for f in FIELDS],
        F.from_json(F.get_json_object("doc", "$.keys"), "array<string>").alias("fm_keys"),
        F.when(is_list, normalise_list(tools_list)).otherwise(normalise_tools(tools_text)).alias("tools"),
        F.char_length("body").alias("body_chars"),
        F.substring(X.strip(F.col("body")), 1, 400).alias("body_head"),
    )


def is_specification(specs):
    return F.col("fm_error").isNull() & F.coalesce(F.col("name") != "", F.lit(False)) & F.coalesce(F.col("description") != "", F.lit(False))


def summarise_settings(text):
    """Struct of flags and counts from a settings document; parse_ok is false for anything but an object."""
    ok = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    listed = lambda name: F.coalesce(F.from_json(F.get_json_object(text, f"$.permissions.{name}"), "array<string>"), F.array().cast("array<string>"))
    allow, deny = listed("allow"), listed("deny")
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("parse_ok"),
        F.size(allow).alias("allow"),
        F.size(deny).alias("deny"),
        F.size(listed("ask")).alias("ask"),
        F.get_json_object(text, "$.permissions.defaultMode").alias("default_mode"),
        F.exists(allow, lambda a: F.trim(a).isin("Bash", "Bash(*)", "Bash(**)")).alias("allow_unscoped_bash"),
        F.exists(deny, lambda x: x.rlike(r"^(Write|Edit|NotebookEdit)\b")).alias("deny_mentions_write"),
        F.exists(deny, lambda x: x.startswith("Bash")).alias("deny_mentions_bash"),
        F.coalesce(F.get_json_object(text, "$.sandbox.enabled") == "true", F.lit(False)).alias("sandbox_enabled"),
        F.coalesce(~F.get_json_object(text, "$.hooks").isin("{}", "[]", "null", "false", ""), F.lit(False)).alias("hooks"),
        F.coalesce(F.get_json_object(text, "$.permissions.disableBypassPermissionsMode") == "disable", F.lit(False)).alias("disable_bypass"),
    )


def permission_class(value):
    """Class of a workflow's permissions, given as JSON text (NULL where unset)."""
    bare = F.trim(value)
    return (
        F.when(value.isNull(), "unset")
        .when(bare.isin("write-all", "read-all"), bare)
        .when(bare == "{}", "none")
        .when(bare.startswith("{"), F.when(F.exists(F.map_values(F.from_json(bare, "map<string,string>")), lambda v: v == "write"), "scoped-write").otherwise("scoped-read"))
        .otherwise("other")
    )


def summarise_workflow(doc, text):
    """Struct of a CI workflow from its YAML as JSON (yaml_json) and its text: permission classes, triggers, markers."""
    on = F.get_json_object(doc, "$.value.on")
    triggers = F.when(on.startswith("["), F.from_json(on, "array<string>")).when(on.startswith("{"), F.json_object_keys(on)).when(on.isNotNull(), F.array(on)).otherwise(F.array().cast("array<string>"))
    jobs = F.map_values(F.from_json(F.get_json_object(doc, "$.value.jobs"), "map<string,string>"))
    return F.struct(
        F.get_json_object(doc, "$.error").isNull().alias("parse_ok"),
        permission_class(F.get_json_object(doc, "$.value.permissions")).alias("top_permissions"),
        F.transform(jobs, lambda j: permission_class(F.get_json_object(j, "$.permissions"))).alias("job_permissions"),
        F.array_sort(triggers).alias("triggers"),
        text.rlike(r"contents:\s*write").alias("contents_write"),
        text.contains("write-all").alias("write_all"),
        F.array_contains(triggers, "pull_request_target").alias("pull_request_target"),
    )


def server_count(text):
    """Number of servers in an MCP configuration, NULL if it is no JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(F.size(F.json_object_keys(F.get_json_object(text, "$.mcpServers"))), F.lit(0)))


def inventory_rows(trees, kinds):
    """One row per file of nested inventories; the kind is that of the first pattern that its path shows."""
    flat = trees.select("repo", F.explode("cfg").alias("f")).select("repo", F.col("f.p").alias("path"), F.col("f.s").alias("size"), F.col("f.sha").alias("sha"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(kinds.items())):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    return flat.withColumn("kind", kind).where("kind IS NOT NULL")


def newest_per_run(files, pattern):
    """Path of the newest file of each run, the run's id being found in the path; path, mtime."""
    found = files.withColumn("run_id", F.regexp_extract("path", pattern, 1)).where("run_id <> ''")
    return found.groupBy("run_id").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def without_excluded(files, excluded, prefix="agent-"):
    """Files whose stem, less a prefix, is not on the exclusion list."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), f"^{prefix}", "")
    return files.withColumn("agent_id", stem).join(excluded.select("agent_id"), "agent_id", "left_anti")


def write_jsonl(df, path, compressed=False):
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def append_new(df, path, *keys):
    """Append the rows whose key is not in the sink yet."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def write_report(df, path):
    """A table as one JSON document per row."""
    df.write.mode("overwrite").json(path)


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


CURRENT = "current"  # no hidden name, as Spark reads it


def replace_table(df, path):
    """Replace a table whole: readers see the old one or the new one, never a part.

    Rows go to a folder of their own; only when all are there is the file that names the
    folder in force renamed into place, in one step of the file system. A writer that fails
    before changes nothing, and a table may be read while it is replaced. Older versions
    stay for readers that have begun; see `drop_versions`.
    """
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    draft = at(f"{CURRENT}-{uuid.uuid4().hex}")
    out = draft.getFileSystem(conf).create(draft, False)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, at(CURRENT), options)
    return version


def version_in_force(spark, path):
    return spark.read.text(f"{path}/{CURRENT}").first()["value"]


def read_replaced(spark, path):
    """The version of a table that is in force now; it stays the same for whoever has read its name."""
    return spark.read.parquet(f"{path}/{version_in_force(spark, path)}")


def drop_versions(spark, path):
    """Delete all versions but the one in force, once nobody reads or writes the others."""
    kept, folder = version_in_force(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name not in (kept, CURRENT) and name.startswith(("version=", f"{CURRENT}-")):
            files.delete(status.getPath(), True)


def write_batches(df, path, size, *order):
    """Rows in fixed batches, a folder per batch."""
    fixed_batches(df, size, *order).write.mode("overwrite").partitionBy("batch").json(path)


def macros(metrics, name="name", value="value"):
    """Metric rows as lines of macro definitions; a value that could not be computed is marked ??."""
    return metrics.select(F.concat(F.lit("\\newcommand{\\"), F.col(name), F.lit("}{"), F.coalesce(F.col(value), F.lit("??")), F.lit("}")).alias("line"))


def estimate_line(label="estimate"):
    """One printed line of an estimate row."""
    return F.format_string("%s: %.1f%% (%.1f–%.1f), n=%d, pooled %.1f%%", F.col(label), F.col("mean") * 100, F.col("lo") * 100, F.col("hi") * 100, F.col("n_clusters"), F.col("pooled") * 100)


def manifest(tables):
    """Rows and bytes of text of each named table: what a provenance record states, computed from the data."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def provenance(df, name, date, status, text):
    """What a provenance record states of a table: rows, columns, first and last date, bytes of a text column, rows by status."""
    per = df.groupBy(F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), F.sum(F.octet_length(F.col(text))).alias("bytes")
    )
    counts = F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce("status", F.lit("none")), F.lit("="), F.col("n").cast("string")))), " ")
    return per.agg(F.sum("n").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("n_bytes"), counts.alias("statuses")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "first", "last", "n_bytes", "statuses"
    )


def comparison_lines(rows, label, figures, digits=2):
    """Rows as lines of an aligned table: a label and its figures, absent ones as a dash."""
    cell = lambda c: F.lpad(F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("-")), 10, " ")
    cells = [F.when(F.col(c).isNull(), F.lpad(F.lit("-"), 10, " ")).otherwise(cell(c)) for c in figures]
    return rows.select(F.concat(F.rpad(F.col(label).cast("string"), 16, " "), *cells).alias("line"))
