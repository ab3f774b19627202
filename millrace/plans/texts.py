"""Queries of text expressions and of hashes."""

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import statistics as S
from ..session import table
from .registry import query


def lit(s):
    return "'" + s.replace("'", "''") + "'"


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10))) AS s FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(s, '^\s*([-*+>#]+|[0-9]+[.)])\s*', ''), '^\s+|\s+$', '', 'g') AS s FROM p)
SELECT doc_id, count(*) FILTER (length(s) BETWEEN 12 AND 600) AS n_sentences, coalesce(sum(length(s)) FILTER (length(s) BETWEEN 12 AND 600), 0)::BIGINT AS n_chars FROM c GROUP BY 1""")
def sentence_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n_chars"))


@query(r"""SELECT doc_id, CASE WHEN length(l) = 0 THEN 'none' WHEN length(regexp_replace(l, '[^\x{0}-\x{24F}]', '', 'g'))::DOUBLE / length(l) > 0.7 THEN 'latin' ELSE 'other' END AS script
FROM (SELECT doc_id, regexp_replace(text, '\P{L}', '', 'g') AS l FROM documents)""")
def script_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.script(F.col("text")).alias("script"))


@query(rf"""SELECT doc_id, length(text)::INT AS chars, len(regexp_extract_all(text, '\S+'))::INT AS words, length(text) - length(replace(text, '!', '')) AS exclamations,
(len(regexp_extract_all(text, '\*\*')) // 2)::INT AS bold, len(regexp_extract_all(text, '\b(NEVER|MUST|ALWAYS|IMPORTANT|CRITICAL|DO NOT|REQUIRED|MANDATORY|WARNING|NOTE|ONLY)\b'))::INT AS emphasis,
len(regexp_extract_all(text, {lit(X.HYPE)}))::INT AS hype, regexp_matches(substr(text, 1, 400), {lit(X.PERSONA)}) AS persona, regexp_matches(text, {lit(X.READ_ONLY)}) AS read_only,
regexp_matches(text, '(?i)<example>|\bexamples?:') AS examples, regexp_matches(text, '(?i)\bproactive(ly)?\b') AS proactive FROM documents""")
def text_features(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", X.text_features(F.col("text")).alias("f"))
    return f.select("doc_id", "f.*")


SENTENCES = {
    "You must not edit files.": "prohibition",
    "Never commit secrets.": "prohibition",
    "You should avoid large diffs": "prohibition",
    "It doesn’t write anything": "prohibition",
    "Always run the tests first.": "obligation",
    "Ensure that the build passes": "obligation",
    "Prefer small changes.": "recommendation",
    "You may use the network.": "permission",
    "The sky is blue.": None,
    "should not, but must": "prohibition",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({lit(s)}, {lit(m) if m else 'NULL'}, {str(s == 'You should avoid large diffs' or s.startswith('It doesn') or s.startswith('should not')).lower()})" for s, m in SENTENCES.items()) + ") t(sentence, modality, weak)")
def modality_inline(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in SENTENCES], "sentence string")
    return rows.select("sentence", X.modality(F.col("sentence")).alias("modality"), F.coalesce(X.weak_only(F.col("sentence")), F.lit(False)).alias("weak"))


ROLES = [("code-reviewer", "Reviews the code", "reviewer", "review/audit"), ("test-writer", "", "tester", "test"), ("reviewer-tester", "", None, "review/audit"), ("x", "Deploys with kubernetes", None, "devops/infra"), ("y", "nothing", None, None), ("security architect", None, None, "security")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else lit(v) for v in r) + ")" for r in ROLES) + ") t(name, description, strict_role, broad_role)")
def roles_inline(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in ROLES], "name string, description string")
    return rows.select("name", "description", X.strict_role(F.col("name")).alias("strict_role"), X.broad_role(F.col("name"), F.col("description")).alias("broad_role"))


WORDS = ["and", "the", "that", "for", "with", "was", "this", "from"]


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{{2,}}'), lambda w: w IN ({', '.join(map(lit, WORDS))}))) AS w FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents), s AS (SELECT unnest(w) AS a, doc_id FROM t), c AS (SELECT a, count(*)::DOUBLE AS c FROM s GROUP BY 1),
p AS (SELECT x.a, y.a AS b, count(*)::DOUBLE AS c FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.a < y.a GROUP BY 1, 2),
g AS (SELECT u.w AS a, v.w AS b FROM (SELECT unnest([{', '.join(map(lit, WORDS))}]) AS w) u, (SELECT unnest([{', '.join(map(lit, WORDS))}]) AS w) v WHERE u.w < v.w)
SELECT g.a, g.b, round(CASE WHEN p.c IS NULL THEN -1 WHEN p.c = n THEN 1 ELSE ln(p.c / n / (ca.c / n * cb.c / n)) / -ln(p.c / n) END, 9)::DOUBLE AS npmi
FROM g LEFT JOIN p ON g.a = p.a AND g.b = p.b LEFT JOIN c ca ON ca.a = g.a LEFT JOIN c cb ON cb.a = g.b, n""")
def token_sets_npmi(spark, sf_dir):
    out = S.npmi(table(spark, sf_dir, "documents"), "doc_id", X.tokens(F.col("text")), WORDS)
    return out.withColumn("npmi", F.round("npmi", 9))


@query("""SELECT doc_id, count(*) FILTER (length(s) >= 40) AS n_long, count(*) FILTER (contains(s, ',')) AS n_comma FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY 1""")
def conditional_sentence_counts(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda s: F.char_length(s) >= 40)).cast("long").alias("n_long"), F.size(F.filter(lines, lambda s: s.contains(","))).cast("long").alias("n_comma"))


@query("""SELECT doc_id, substr(sha1(source || chr(10) || text), 1, 16) AS item_id, substr(sha256(text), 1, 16) AS short_hash, substr(sha256(source || chr(0) || lang), 1, 16) AS file_id,
substr(sha1(source || chr(10) || chr(0) || chr(10) || text), 1, 16) AS text_key FROM documents""")
def content_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    c = F.col
    return docs.select("doc_id", I.item_id(c("source"), c("text")).alias("item_id"), I.short_sha256(c("text")).alias("short_hash"), I.file_id(c("source"), c("lang")).alias("file_id"), I.text_key(c("source"), c("text")).alias("text_key"))


BLOBS = {"": "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "hello\n": "ce013625030ba8dba906f756967f9e9ca394464a"}


@query("SELECT * FROM (VALUES " + ", ".join(f"({len(k)}, '{v}')" for k, v in BLOBS.items()) + ") t(n, sha)")
def git_blob_hash(spark, sf_dir):
    rows = spark.createDataFrame([(k,) for k in BLOBS], "content string")
    return rows.select(F.char_length("content").alias("n"), I.git_blob_sha(F.col("content")).alias("sha"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE substr(text, 1, 60) || ' … ' || right(text, 30) END AS head_tail, CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 20) || '…' END AS short FROM documents""")
def truncated_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.head_tail(t, 60, 30).alias("head_tail"), X.ellipsis(t, 20).alias("short"))


PATHS = [("a/.claude/agents/x.md", "a/", "x.md", False, False), (".claude/agents/n/y.md", "", "n/y.md", True, True), ("p/.claude/agents/q/.claude/agents/z.md", "p/.claude/agents/q/", "z.md", False, False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({lit(p)}, {lit(r)}, {lit(f)}, {n}, {o})" for p, r, f, n, o in PATHS) + ") t(path, config_root, rel_path, nested, root_is_repo_root)")
def locate_inline(spark, sf_dir):
    rows = spark.createDataFrame([(p[0],) for p in PATHS], "path string")
    return rows.select("path", X.locate(F.col("path")).alias("l")).select("path", "l.*")
