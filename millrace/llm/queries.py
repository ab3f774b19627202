"""The queries of the text operators, each over its whole tables, and their SQL."""

from pyspark.sql import functions as F

from ..session import table


def op6_exact_dedup(spark, sf_dir):
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""


def op8_line_dedup(spark, sf_dir):
    from .lines import drop_repeated_lines

    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



def op4_substring_dedup(spark, sf_dir):
    from .substrings import remove_seen_windows

    out = remove_seen_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH s AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 11)) AS pos FROM s WHERE len(w) >= 13),
h AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS key FROM p),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM h),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM s),
c AS (SELECT t.doc_id, t.pos, word,
             coalesce(max(CASE WHEN gone THEN t.pos END) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
      FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.pos = m.pos)
SELECT s.doc_id, len(w) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM s LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
                         string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id) g ON s.doc_id = g.doc_id
"""


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))



def op10_suffix_array_dedup(spark, sf_dir):
    from .suffixes import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



def op1_toxicity(spark, sf_dir):
    from .labelled import with_split
    from .toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents")
    return with_split(score_texts(docs, fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op2_quality(spark, sf_dir):
    from .labelled import with_split
    from .quality import fit, score_texts

    docs = table(spark, sf_dir, "documents")
    return with_split(score_texts(docs, fit(docs, table(spark, sf_dir, "labels"))), 0.3)



def op3_minhash_near_dedup(spark, sf_dir):
    from .nearcopies import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    from .contamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))



def op7_pii_surrogates(spark, sf_dir):
    """The key is a secret of the session's owner (millrace.surrogates.key), or a fresh one that nobody keeps."""
    import secrets

    from .surrogates import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"), spark.conf.get("millrace.surrogates.key", None) or secrets.token_hex(32))


def op11_ranked_search(spark, sf_dir):
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM
      (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) x GROUP BY 1, 2),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * big_n) // big_l) AS m FROM n, g),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def op12_merkle_manifest(spark, sf_dir):
    from .manifest import lowered_thirds, manifest

    return manifest(table(spark, sf_dir, "documents"), lowered_thirds()).drop("proof")


def _encoded(column, value=None):
    value = value or f"{column}::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _levels(name, tree, levels):
    """CTEs of a forest's levels over {name}0 (tree, i, h, n), of siblings on each, and of every leaf's fold and proof."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT {tree}, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  count(*) OVER (PARTITION BY {tree}) AS n FROM (SELECT * FROM {name}{k}) x GROUP BY {tree}, i // 8)""")
        out.append(f"""{name}s{k} AS (SELECT a.{tree} AS {tree}, a.i AS i, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.{tree} IS NOT DISTINCT FROM b.{tree} AND a.i // 8 = b.i // 8 GROUP BY 1, 2)""")
    return ",\n".join(out)


def _op12_sql(levels=7, above=3):
    """For groups of at most 8 ** levels rows and 8 ** above groups."""
    fields = lambda text: " || ".join([_encoded("doc_id"), _encoded("source"), _encoded("lang"), _encoded("n_chars"), _encoded("text", text)])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # The CRC by its definition, bit by bit.
    bits = "list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda p: [1000 + ascii(substr(doc_id::VARCHAR, p::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor({bits}, lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
    joins, chain = "", []
    for name, count, at, tree in (("v", levels, "d.i", "lang"), ("t", above, "g.i", "one")):
        for k in range(count):
            own = "d.lang" if name == "v" else "g.one"
            joins += f"\nJOIN {name}s{k} ON {name}s{k}.{tree} IS NOT DISTINCT FROM {own} AND {name}s{k}.i = {at} // {8**k}"
            chain.append(f"{name}s{k}")
    folds = "start"
    steps = []
    for k, c in enumerate(chain):
        steps.append(f"f{k} AS (SELECT *, CASE WHEN {c}_n = 1 THEN {folds} ELSE sha256({c}_l || {folds} || {c}_r) END AS fold{k} FROM {'w' if k == 0 else f'f{k - 1}'})")
        folds = f"fold{k}"
    return f"""
WITH d0 AS (SELECT doc_id, lang, sha256({fields('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({fields(low)}) END AS bent FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d0),
v0 AS (SELECT lang, i, leaf AS h, n FROM d),
{_levels('v', 'lang', levels)},
t0 AS (SELECT 1 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM v{levels}),
{_levels('t', 'one', above)},
w AS (SELECT d.doc_id, d.leaf, coalesce(d.bent, d.leaf) AS start, g.h AS subroot, t{above}.h AS root, {", ".join(f"{c}.{x} AS {c}_{x}" for c in chain for x in "nlr")}
FROM d JOIN t0 g ON g.lang IS NOT DISTINCT FROM d.lang JOIN t{above} ON true {joins}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{c}_l || {c}_r" for c in chain)}) AS proof_sha256, {folds} AS folded_root, {folds} = root AS verified FROM f{len(chain) - 1}
"""


OP12_SQL = _op12_sql()


def op13_source_mix(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


_NUMBER = "('0x' || substr(md5('17|' || {}), 1, 15))::BIGINT"
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(concat_ws('|', '17', doc_id, coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
-- Sources by what they hold for their weight: the first so many are held to three times their words.
s2 AS (SELECT *, row_number() OVER o AS k, sum(size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weights, sum(size) OVER () - 3 * coalesce(sum(size) OVER p, 0) AS free FROM s1
       WINDOW o AS (ORDER BY size::DOUBLE / weight, place), p AS (ORDER BY size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT min(k) AS k, arg_min(free, k)::BIGINT AS free, arg_min(weights, k)::BIGINT AS weights FROM s2 WHERE weight * free::DOUBLE / weights <= 3 * size),
s4 AS (SELECT source, place, size, s2.k < s3.k AS capped, CASE WHEN s2.k < s3.k THEN 3.0::DOUBLE * size ELSE weight * s3.free::DOUBLE / s3.weights END AS target, total::BIGINT AS total, s3.free AS free FROM s2, s3),
b AS (SELECT least(1024, greatest(1, any_value(total) // (1000 * count(*))))::BIGINT AS block, any_value(free)::BIGINT AS free FROM s4),
q0 AS (SELECT place, unnest(range(1, 3 * ceil(size / block::DOUBLE)::BIGINT + 1)) AS a, target FROM s4, b WHERE NOT capped),
q1 AS (SELECT place, row_number() OVER (ORDER BY -target / (2 * a - 1), place) AS r FROM q0),
q AS (SELECT place, count(*) AS seats FROM q1, b WHERE r <= (2 * free + block) // (2 * block) GROUP BY place),
e AS (SELECT d.*, s4.size AS source_size, s4.place, s4.capped, s4.target, b.block, ('0x' || substr(d.key, 1, 15))::BIGINT % greatest(1, ceil(s4.size / (1024 * block)::DOUBLE)::BIGINT) AS shard
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source, b),
h AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, ceil(sum(size) / any_value(block)::DOUBLE)::BIGINT AS n FROM e WHERE size > 0 AND NOT capped GROUP BY 1, 2),
h0 AS (SELECT place, shard, n, shard_size, unnest(range(1, 3 * n + 1)) AS a FROM h),
h1 AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY -shard_size::DOUBLE / (2 * a - 1), shard) AS r FROM h0),
h2 AS (SELECT h.place, h.shard, h.n, count(q.place) AS quota FROM h LEFT JOIN h1 ON h.place = h1.place AND h.shard = h1.shard LEFT JOIN q ON h1.place = q.place AND h1.r <= q.seats GROUP BY 1, 2, 3),
h3 AS (SELECT place, shard, quota // n AS times, quota % n AS extra, list_sort(list_transform(range(n), lambda j: {_NUMBER.format("place || '|' || shard || '|' || j")})) AS numbers FROM h2),
p AS (SELECT e.*, times, CASE WHEN extra > 0 THEN numbers[extra] ELSE -1 END AS bound,
             coalesce(sum(size) OVER (PARTITION BY e.place, e.shard ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM e JOIN h3 ON e.place = h3.place AND e.shard = h3.shard WHERE size > 0 AND NOT capped)
SELECT doc_id, size, source_size, target, (times * size + list_sum(list_transform(range(start // block, (start + size - 1) // block + 1),
       lambda j: CASE WHEN {_NUMBER.format("place || '|' || shard || '|' || j")} <= bound THEN least(start + size, (j + 1) * block) - greatest(start, j * block) ELSE 0 END)))::BIGINT AS taken FROM p
UNION ALL SELECT doc_id, size, source_size, target, 3 * size FROM e WHERE size = 0 OR capped
"""


QUERIES = {
    "op7_pii_surrogates": (op7_pii_surrogates, None),
    "op3_minhash_near_dedup": (op3_minhash_near_dedup, None),
    "op5_decontamination": (op5_decontamination, None),
    "op1_toxicity": (op1_toxicity, None),
    "op2_quality": (op2_quality, None),
    "op10_suffix_array_dedup": (op10_suffix_array_dedup, None),
    "op9_bpe": (op9_bpe, None),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12_SQL),
    "op13_source_mix": (op13_source_mix, OP13_SQL),
}
