"""Content identities: short hashes, canonical keys, version order, dates."""

from pyspark.sql import functions as F


def short_sha1(*parts, sep="\n", length=16):
    return F.substring(F.sha1(F.concat_ws(sep, *parts).cast("binary")), 1, length)


def item_id(name, description):
    return short_sha1(F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))


def text_key(description, body):
    """Identity of a description and a body; a zero byte stands between them."""
    return F.substring(F.sha1(F.concat(F.coalesce(description, F.lit("")), F.lit("\n\0\n"), F.coalesce(body, F.lit(""))).cast("binary")), 1, 16)


def file_id(repo, path):
    return F.substring(F.sha2(F.concat(repo, F.lit("\0"), path).cast("binary"), 256), 1, 16)


def short_sha256(text):
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def git_blob_sha(content):
    """Object id of a file: the header counts bytes, not characters."""
    data = content.cast("binary")
    header = F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), data))


def grant_key(**fields):
    """Canonical JSON of named fields in sorted order; absent ones are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def version_key(version):
    """Version as an array of numbers: arrays compare like tuples."""
    return F.transform(F.split(F.regexp_extract(version, r"\d+(?:\.\d+)*", 0), r"\."), lambda x: x.try_cast("int"))


def month_key(date):
    return F.date_format(date, "yyyyMM")


def months_before(snapshot, n):
    """Keys of the `n` months up to and with that of the snapshot, latest first."""
    start = F.trunc(snapshot, "month")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.add_months(start, -i), "yyyyMM"))


def month_windows(snapshot, n):
    """First day and end of each of `n` months, oldest first; the last ends at the snapshot."""
    start = F.trunc(snapshot, "month")
    return F.transform(
        F.sequence(F.lit(n - 1), F.lit(0)),
        lambda i: F.struct(F.add_months(start, -i).alias("start"), F.least(F.add_months(start, 1 - i), snapshot).alias("stop")),
    )


def page_count(link_header):
    """Number of the last page in an HTTP Link header, 1 without one."""
    return F.coalesce(F.regexp_extract(link_header, r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1).try_cast("int"), F.lit(1))


def split_headers(raw):
    """Header map (names in lower case) and body of a raw HTTP answer."""
    head = F.split(raw, r"\r?\n\r?\n", 2)
    lines = F.filter(F.split(head[0], r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split(x, ":", 2)[0])).alias("k"), F.trim(F.split(x, ":", 2)[1]).alias("v")))
    return F.struct(F.map_from_entries(pairs).alias("headers"), F.get(head, F.lit(1)).alias("body"))


def month_counts(node):
    """Entries of a map whose keys are m and six digits, under the digits."""
    return F.transform_keys(F.map_filter(node, lambda k, _: k.rlike(r"^m\d{6}$")), lambda k, _: F.substring(k, 2, 6))


def authors(logins, emails):
    """Distinct authors: login, else e-mail in lower case; nameless ones dropped."""
    return F.filter(F.array_distinct(F.transform(F.arrays_zip(logins.alias("l"), emails.alias("e")), lambda x: F.coalesce(x["l"], F.lower(x["e"])))), lambda x: x.isNotNull() & (x != ""))


def run_id(order, model, config, task, rep):
    return F.format_string("r%05d-%s-%s-%s-%02d", order, model, config, task, rep)


def run_number(run):
    return F.regexp_extract(run, r"^r(\d{5})", 1).try_cast("int")


def build_of(run, edges, names):
    """Build period of a run: named by how many edges its number has reached."""
    number, out = run_number(run), F.lit(names[0])
    for edge, name in zip(edges, names[1:], strict=True):
        out = F.when(number >= edge, name).otherwise(out)
    return out
