"""Rules over specification records: one row per finding (path, level, code, message)."""

from pyspark.sql import functions as F

from ..functions import tools as T

NEAR = [*T.NEAR_MISS_FIELDS, "tool"]


def _finding(level, code, message, when):
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")))


def lint(specs):
    """Findings of all rules.

    specs: path, name, description, fm_error, fm_keys, permissionMode, model, tools (NULL
    where none is declared). Files that are no specification get D1 alone; files without
    a tool list get no rule about tools; D6 looks at names among all files given.
    """
    admitted = F.col("fm_error").isNull() & F.coalesce(F.col("name") != "", F.lit(False)) & F.coalesce(F.col("description") != "", F.lit(False))
    why = F.coalesce("fm_error", F.when(F.coalesce(F.col("name") != "", F.lit(False)), "missing description").otherwise("missing name"))
    listed = admitted & F.col("tools").isNotNull() & ~F.coalesce(T.is_wildcard(F.col("tools")), F.lit(False))
    known = specs.withColumns({"_ok": admitted, "_why": why, "_listed": listed})
    unknown = F.filter("tools", lambda t: ~T.is_known(t))
    odd_keys = F.array_except("fm_keys", T.strings(T.SCHEMA_FIELDS))
    shells = F.filter("tools", lambda t: T.base_tool(t).isin(*T.SHELLS) & ~t.contains("("))
    single = F.array(
        _finding("error", "D1", F.concat(F.lit("not a specification: "), F.col("_why")), ~F.col("_ok")),
        _finding("info", "D4", F.lit("permissionMode is ignored in auto mode"), F.col("_ok") & F.col("permissionMode").isNotNull()),
        _finding("warn", "D5", F.concat(F.lit("model not recognised: "), F.col("model")), F.col("_ok") & F.col("model").isNotNull() & ~F.col("model").rlike(T.MODEL_PATTERN)),
        _finding("info", "P2", F.lit("no tool list: every tool is inherited"), F.col("_ok") & ~F.col("_listed")),
        _finding("warn", "D3", F.lit("no listed tool is known"), F.col("_listed") & (F.size("tools") > 0) & (F.size(unknown) == F.size("tools"))),
        _finding("error", "P1", F.concat(F.lit("file tools withheld but unscoped shell granted: "), F.array_join(F.array_sort(F.array_distinct(shells)), ", ")), F.col("_listed") & ~T.can_write(F.col("tools")) & (F.size(shells) > 0)),
    )
    keys = F.transform(
        odd_keys,
        lambda k: F.struct(F.lit("warn").alias("level"), F.lit("N1").alias("code"), F.concat(F.lit("field not read: "), k, F.when(k.isin(*NEAR), F.lit(" (tools?)")).otherwise("")).alias("message")),
    )
    names = F.transform(
        unknown,
        lambda t: F.struct(F.lit("warn").alias("level"), F.when(T.base_tool(t).isin(*T.LEGACY_TOOLS), "D2a").otherwise("D2b").alias("code"), F.concat(F.lit("unknown tool: "), t).alias("message")),
    )
    none = F.array().cast("array<struct<level:string,code:string,message:string>>")
    every = F.concat(F.filter(single, lambda f: f.isNotNull()), F.when(F.col("_ok"), F.coalesce(keys, none)).otherwise(none), F.when(F.col("_listed"), F.coalesce(names, none)).otherwise(none))
    own = known.select("path", F.explode(every).alias("f")).select("path", "f.*")
    return own.unionByName(duplicate_names(known.where("_ok")))


def duplicate_names(specs):
    """D6: every file whose trimmed name another file declares too; which of them loads is not told."""
    named = specs.select("path", T.strip(F.col("name")).alias("name"))
    counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hit = named.join(counts, "name")
    return hit.select("path", F.lit("error").alias("level"), F.lit("D6").alias("code"), F.concat(F.lit("name declared by several files: "), F.col("name"), F.lit(" x"), F.col("c").cast("string")).alias("message"))


def failed(findings):
    """Whether any finding is an error (the exit status of a check)."""
    return findings.agg(F.coalesce(F.bool_or(F.col("level") == "error"), F.lit(False)).alias("failed"))
