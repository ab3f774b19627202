"""Labels and raters: validation, coder files, reliability, coverage, sensitivity to the rater."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tools as T
from .relational import key_difference, rater_pairs
from .statistics import fisher_exact, krippendorff

# Domains of the label fields.
DOMAINS = {
    "role": "REQ ARCH IMPL TEST REVIEW SEC DEBUG REFACT DOCS OPS DATA UX EXPLORE PLAN NONSE UNCLEAR".split(),
    "mode": "inspect change mixed unclear".split(),
    "polarity": "prohibit require other".split(),
    "category": "ENGINEERED TEMPLATE_COLLECTION TUTORIAL_LEARNING PERSONAL_CONFIG DEMO_EXPERIMENT NON_SOFTWARE UNCLEAR".split(),
    "confidence": "high medium low".split(),
    "topics": "FS_MODIFY EXEC VCS SCOPE SECRETS EXTERNAL DESTRUCTIVE QUALITY OUTPUT ESCALATE HONESTY DELEGATION OTHER".split(),
    "restriction": "full partial none".split(),
    "shell_use": "change verify inspect none".split(),
    "claim": "claims_done declines_or_cannot ambiguous".split(),
}
# End of fixed values.


def valid(df, fields, lists=()):
    """Rows whose fields all lie in their domains; list fields need an entry and no foreign one."""
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.coalesce(F.col(f).isin(*DOMAINS[f]), F.lit(False))
    for f in lists:
        ok = ok & F.coalesce((F.size(f) > 0) & (F.size(F.array_except(f, T.strings(DOMAINS[f]))) == 0), F.lit(False))
    return df.where(ok)


def check_coders(coders, digest):
    """Coder files of the right sample; a wrong digest or a rater's name used twice is an error when the rows are read."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("initials")) > 1
    wrong = F.when(F.col("sample_digest") != digest, "digest differs").when(twice, "name used twice")
    checked = coders.withColumn("_bad", wrong)
    return checked.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.col("_bad"), F.lit(": "), F.col("initials"))).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def coder_statistics(answers):
    """Per coder and part: items, coded, unsure, and the upper median of seconds (no interpolation)."""
    return answers.groupBy("coder", "part").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count("label").alias("n_coded"),
        F.count_if("unsure").alias("n_unsure"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seconds DESC)").alias("median_seconds"),
    )


def item_table(rows, item, spec, repo):
    """Distinct items with how many rows and repositories they stand in."""
    per = rows.groupBy(item, repo).agg(F.count(spec).alias("c"))
    return per.groupBy(item).agg(F.sum("c").alias("n_specs"), F.count(F.lit(1)).alias("n_repos"))


def third_rater(reference, other, item, field):
    """Alpha of a further rater against another over common items, with how many items it lacks."""
    both = reference.select(item, F.col(field).alias("x")).join(other.select(item, F.col(field).alias("y")), item)
    missing = key_difference(reference, other, item).where("status = 'missing'").agg(F.count(F.lit(1)).alias("n_missing"))
    return krippendorff(both, "x", "y").crossJoin(missing)


def reliability(votes, item, rater, value):
    """Agreement and alpha of every two raters."""
    raters = sorted(r[0] for r in votes.select(rater).distinct().limit(100).collect())
    parts = []
    for i, a in enumerate(raters):
        for b in raters[i + 1 :]:
            one, two = (votes.where(F.col(rater) == r).select(item, F.col(value).alias(n)) for r, n in ((a, "x"), (b, "y")))
            parts.append(krippendorff(one.join(two, item), "x", "y").select(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), "n_items", "agreement", "alpha"))
    return reduce(lambda p, q: p.unionByName(q), parts)


def smallest_build_difference(cells, cell, build, k, n):
    """Over all pairs of builds within a cell: number of comparisons, least p, least and greatest group size."""
    a, b = cells.select(cell, F.col(build).alias("b1"), F.col(k).alias("k1"), F.col(n).alias("n1")), cells.select(cell, F.col(build).alias("b2"), F.col(k).alias("k2"), F.col(n).alias("n2"))
    pairs = a.join(b, cell).where("b1 < b2")
    tables = pairs.select(cell, "b1", "b2", F.col("k1").alias("a"), (F.col("n1") - F.col("k1")).alias("b"), F.col("k2").alias("c"), (F.col("n2") - F.col("k2")).alias("d"))
    p = fisher_exact(tables, [cell, "b1", "b2"])
    sizes = pairs.agg(F.least(F.min("n1"), F.min("n2")).alias("n_least"), F.greatest(F.max("n1"), F.max("n2")).alias("n_most"))
    return p.agg(F.count(F.lit(1)).alias("n_tests"), F.min("p_value").alias("min_p")).crossJoin(sizes)


def registered(specs, census):
    """Per specification: whether its configuration root was probed, and whether its name is among the root's own agents."""
    probed = census.where("ok").select("repo", "config_root", F.array_except("agents", "builtin").alias("own"))
    j = specs.join(probed, ["repo", "config_root"])
    return j.select("repo", "config_root", "name", F.array_contains("own", F.col("name")).alias("registered"))


def with_label(rows, labels, key, column, name):
    """Rows under another rater's labels, for re-estimation."""
    return rows.drop(name).join(labels.select(key, F.col(column).alias(name)), key, "left")


def summarise_runs(scores):
    """Per task, configuration and model: runs, changes, finds and how changes were made."""
    return scores.groupBy("task", "config", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("found").alias("n_found"), F.count_if(F.col("pathway") == "file-tool").alias("n_file_tool"), F.count_if(F.col("pathway") == "shell").alias("n_shell")
    )


def document_references(sources):
    """Of LaTeX sources (path, text): labels, citations, macros and figures used but never defined."""
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    used = {"label": r"\\(?:ref|autoref|eqref)\{([^}]+)\}", "macro": r"(\\[A-Za-z]+)"}
    made = {"label": r"\\label\{([^}]+)\}", "macro": r"\\(?:re)?newcommand\{(\\[A-Za-z]+)\}"}
    parts = []
    for kind in used:
        u = sources.select(F.explode(found(used[kind])).alias("name")).distinct()
        m = sources.select(F.explode(found(made[kind])).alias("name")).distinct()
        parts.append(u.join(m, "name", "left_anti").select(F.lit(kind).alias("kind"), "name"))
    return parts[0].unionByName(parts[1])


__all__ = ["DOMAINS", "check_coders", "coder_statistics", "document_references", "item_table", "rater_pairs", "registered", "reliability", "smallest_build_difference", "summarise_runs", "third_rater", "valid", "with_label"]
