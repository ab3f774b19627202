"""PII: replace detected entities by keyed surrogates of the same type and format.

Only DataFrame expressions. Mentions are found by one pattern per type; mentions that
differ in case or punctuation alone have one canonical form, and so one surrogate
(coreference). Surrogates are drawn from a keyed hash, checked over the whole corpus
for collisions with each other and with real values, and redrawn where they collide
(distinctness). The mention's own punctuation, letter case and script are kept.
"""


from pyspark.sql import functions as F

from .common import row_key, stored, text_or_empty

EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Titles that tell a gender or none, in English, German, Spanish and French.
MALE_TITLES = r"Mr|Herr|Señor|Sr|Monsieur|M(?=\.)"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Mlle"
OTHER_TITLES = "Dr|Prof"
# End of fixed values.
NAME = r"\p{Lu}[\p{L}'-]{1,100}+(?![\p{L}'-])"
TITLE = f"(?:{FEMALE_TITLES}|{MALE_TITLES}|{OTHER_TITLES})"
#: Each pattern tries a run of letters, digits and signs once, or a bounded stretch of it, so that time is in proportion to the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++(?<![\p{L}\p{N}._%+-]{257})@(?:[\p{L}\p{N}-]{1,63}+\.){1,30}\p{L}{2,63}+",
    "secret": EDGE + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + END,
    # Keys that tell themselves by their first letters.
    "token": EDGE + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+)" + END,
    "iban": EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "ssn": EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END,
    # North American groups; a country code and groups; German, French and Spanish groups after a leading 0.
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,5}|0[0-9]{1,4}[ /-][0-9]{6,8}|0[0-9](?:[ .][0-9]{2}){4})" + END,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "card": EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})" + END,
    "name": EDGE + TITLE + r"\.? " + NAME + f"(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Types whose value is its letters and digits alone, whatever stands between them.
PLAIN = ("secret", "iban", "ssn", "phone", "card")
ROUNDS = 8


def kind_of(mention):
    """Type of a mention: the first pattern, in order, that it matches whole."""
    case = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        # Look-around at the ends holds for a mention on its own.
        case = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(case)
    return case


def bare_name(mention):
    return F.regexp_replace(mention, r"^" + TITLE + r"\.? ", "")


def gender_of(mention):
    return (
        F.when(mention.rlike(f"^(?:{FEMALE_TITLES})[. ]"), F.lit("f")).when(mention.rlike(f"^(?:{MALE_TITLES})[. ]"), F.lit("m")).otherwise(F.lit("n"))
    )


def parts_of(kind, mention):
    """What mentions of one entity share: one value, or for a name each of its words, so that a person keeps a surname under any title."""
    value = F.when(kind.isin(*PLAIN), F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))).otherwise(F.lower(mention))
    words = F.split(F.lower(bare_name(mention)), " ")
    gender = F.when(F.size(words) > 1, gender_of(mention)).otherwise("n")
    part = lambda k, v, g: F.struct(k.alias("kind"), v.alias("value"), g.alias("gender"))
    surname = part(F.lit("surname"), F.element_at(words, -1), F.lit("n"))
    given = part(F.lit("given"), F.element_at(words, 1), gender)
    named = F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "name", named).otherwise(F.array(part(kind, value, F.lit("n"))))


def _stream(key, kind, value, turn):
    """512 hex digits of a keyed hash."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), kind, value, turn.cast("string")), 256) for i in range(8)])


def _draw(stream, at, count):
    """A number below `count` from the two hex digits at a place (a column, from 0)."""
    return F.conv(F.substring(stream, (at * 2) % 510 + 1, F.lit(2)), 16, 10).cast("int") % count


def _chars(text):
    return F.filter(F.split(text, ""), lambda c: c != "")


def _same_class(stream, text, hexadecimal=False):
    """Each letter or digit replaced by another of its class and script; the rest stays."""
    digits = 16 if hexadecimal else 10

    def one(c, i):
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), F.lit(1072) + _draw(stream, i, 32)).when(c.rlike(r"\p{IsGreek}"), 945 + _draw(stream, i, 17)).otherwise(97 + _draw(stream, i, 26))
        drawn = F.decode(F.unhex(F.lpad(F.hex(letter), 4, "0")), "UTF-16BE")
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _draw(stream, i, digits) + 1, F.lit(1))).otherwise(c)
        return F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string")).when(c.rlike(r"\p{L}"), drawn).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _octets(stream, text):
    """Octets with as many digits as before."""
    low = lambda n: F.when(n == 3, 100).when(n == 2, 10).otherwise(0)
    wide = lambda n: F.when(n == 3, 156).when(n == 2, 90).otherwise(10)
    return F.array_join(F.transform(F.split(text, r"\."), lambda o, i: (low(F.length(o)) + _draw(stream, i * 3, wide(F.length(o)))).cast("string")), ".")


def luhn_sum(digits):
    """Luhn sum of a string of digits; 0 modulo 10 for a valid number."""
    reverse = _chars(F.reverse(digits))
    each = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(stream, text):
    """Other digits; valid under Luhn's rule exactly if the original is."""
    drawn = _same_class(stream, text)
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("int")
    last = F.when(luhn_sum(text) % 10 == 0, check).otherwise((check + 1 + _draw(stream, F.length(text), 9)) % 10)
    return F.concat(body, last.cast("string"))


def _name(stream, value, gender):
    """A name word of the same script, with an ending of the gender that its titles tell."""

    def syllables(first, vowels, n):
        take = lambda s, at: F.substring(F.lit(s), _draw(stream, F.lit(at), len(s)) + 1, F.lit(1))
        return F.concat(*[x for j in range(n) for x in (take(first, 2 * j), take(vowels, 2 * j + 1))])

    ending = lambda f, m, n: F.when(gender == "f", f).when(gender == "m", m).otherwise(n)
    latin = F.concat(syllables("bdfglmnrstv", "aeiou", 3), ending("na", "n", "l"))
    cyrillic = F.concat(syllables("бвгдлмнрст", "аеиоу", 3), ending("на", "н", "ль"))
    greek = F.concat(syllables("βγδλμνρστ", "αεηιο", 3), ending("να", "νος", "λ"))
    return F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).when(value.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def _remainder(text):
    """What a string of digits and lower-case letters, these as 10 to 35, leaves divided by 97."""

    def step(left, c):
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)
        return F.when(value < 10, (left * 10 + value) % 97).otherwise((left * 100 + value) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(stream, text):
    """Another account of the same country; its check digits are right exactly if the original's are."""
    country, rest = F.substring(text, F.lit(1), F.lit(2)), _same_class(stream, F.substring(text, F.lit(5), F.length(text)))
    was = _remainder(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4))))
    check = F.pmod(was - _remainder(F.concat(rest, country, F.lit("00"))), F.lit(97))
    return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), rest)


def _token(stream, text):
    """The first letters, by which a key is known, stay."""
    head = F.regexp_extract(text, "^(?:akia|gh[a-z]_)", 0)
    return F.concat(head, _same_class(stream, F.substring(text, F.length(head) + 1, F.length(text))))


def _email(stream, text):
    """Everything but the top-level domain and the punctuation changes."""
    top = F.regexp_extract(text, r"\.\p{L}+$", 0)
    return F.concat(_same_class(stream, F.substring(text, F.lit(1), F.length(text) - F.length(top))), top)


def candidate(key, kind, value, gender, turn):
    stream = _stream(key, kind, value, turn)
    return (
        F.when(kind == "email", _email(stream, value))
        .when(kind == "secret", _same_class(stream, value, hexadecimal=True))
        .when(kind == "iban", _iban(stream, value))
        .when(kind == "token", _token(stream, value))
        .when(kind == "ip", _octets(stream, value))
        .when(kind == "card", _card(stream, value))
        .when(kind.isin("given", "surname"), _name(stream, value, gender))
        .otherwise(_same_class(stream, value))
    )


def mapping(values, key):
    """kind, value, surrogate for distinct values (kind, value, gender): no two of a kind alike, none a real value.

    Values whose draws still collide after ROUNDS turns (a format with hardly any free
    values) get the number of their rank appended: distinctness goes before format.
    """
    real = values.select("kind", F.col("value").alias("surrogate"))
    open_, fixed = values, None
    for turn in range(ROUNDS):
        drawn = open_.select("kind", "value", candidate(key, F.col("kind"), F.col("value"), F.col("gender"), F.lit(turn)).alias("surrogate"))
        firsts = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        free = firsts.join(real, ["kind", "surrogate"], "left_anti")
        if fixed is not None:
            free = free.join(fixed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        free = stored(free.select("kind", "value", "surrogate"), "surrogates")
        fixed = free if fixed is None else fixed.unionByName(free)
        open_ = stored(open_.join(free, ["kind", "value"], "left_anti"), "open-values")
        if open_.isEmpty():
            return fixed
    rest = open_.select("kind", "value", F.concat(candidate(key, F.col("kind"), F.col("value"), F.col("gender"), F.lit(ROUNDS)), F.abs(F.xxhash64("kind", "value")).cast("string")).alias("surrogate"))
    return fixed.unionByName(rest)


def _render(kind, mention, surrogate):
    """A surrogate in the mention's own punctuation, case and title."""
    source = F.when(kind == "name", bare_name(mention)).otherwise(mention)
    fresh = surrogate
    title = F.when(kind == "name", F.regexp_extract(mention, r"^" + TITLE + r"\.? ", 0)).otherwise(F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def place(state, c):
        plain = c.rlike(r"[\p{L}\p{N}]")
        drawn = F.substring(fresh, state["at"], F.lit(1))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(drawn)).otherwise(drawn)
        return F.struct(F.concat(state["out"], F.when(plain, cased).otherwise(c)).alias("out"), (state["at"] + plain.cast("int")).alias("at"))

    spliced = F.aggregate(_chars(mention), start, place, lambda s: F.concat(s["out"], F.when(F.length(fresh) >= s["at"], F.substring(fresh, s["at"], F.length(fresh))).otherwise("")))
    upper = source.rlike(r"\p{Lu}") & ~source.rlike(r"\p{Ll}")
    spliced = F.when((kind == "secret") & upper, F.upper(spliced)).otherwise(spliced)
    each = F.transform(_chars(fresh), lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    named = F.when(upper, F.upper(fresh)).otherwise(F.initcap(fresh))
    return F.when(kind.isin(*PLAIN), spliced).when(kind == "name", F.concat(title, named)).otherwise(F.array_join(each, ""))


def replace_entities(docs, key, id_col="doc_id", text_col="text"):
    """doc_id, text (entities replaced), n_entities, kinds (sorted types found): one row per input row.

    The key, a secret, and the set of values in the corpus alone decide the surrogates;
    without a key there are none, as anyone could redraw them. Null and empty texts come
    back empty; very long texts are read whole. Rows that repeat, or share an id, or lack
    one, are answered each, from their own text. Extra columns and clashing names do not
    matter; an empty table gives an empty result. The time is in proportion to the texts,
    unbroken runs of letters, digits and dots included; a run of over 256 signs before an @
    and a word of over 101 letters are no e-mail address and no name. Ties between values that draw one
    surrogate go to the lesser value. Names are found after a title; a given name known
    by titles of both genders, or none, gets a neutral ending.
    """
    if not key:
        raise ValueError("a secret key is needed")
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row_key(F.col(id_col), text))
    some = base.where(F.col("text").rlike(ANY))
    none = base.where(~F.col("text").rlike(ANY)).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    described = F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind")))
    valued = F.transform("found", lambda e: F.struct(e["mention"].alias("mention"), e["kind"].alias("kind"), parts_of(e["kind"], e["mention"]).alias("parts")))
    # Few texts hold entities; what was found in them is kept, so that the patterns run over the corpus twice in all.
    mentions = stored(some.withColumn("found", described).withColumn("found", valued), "mentions")
    met = stored(mentions.select("k1", "k2", F.explode(F.array_distinct(F.flatten(F.transform("found", lambda e: e["parts"])))).alias("e")).select("k1", "k2", "e.*"), "entities")
    known = F.when(F.col("gender") != "n", F.col("gender"))
    genders = F.when(F.min(known) == F.max(known), F.min(known)).otherwise("n").alias("gender")
    chosen = stored(mapping(stored(met.groupBy("kind", "value").agg(genders), "values"), key), "surrogates")
    per_text = met.join(chosen, ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "surrogate")).alias("pairs"))
    joined = mentions.join(per_text, ["k1", "k2"]).withColumn("by_value", F.map_from_entries("pairs"))
    drawn = lambda e: F.array_join(F.transform(e["parts"], lambda p: F.element_at(F.col("by_value"), F.concat_ws("|", p["kind"], p["value"]))), " ")
    fresh = F.transform("found", lambda e: _render(e["kind"], e["mention"], drawn(e)))
    pieces = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.col("fresh").alias("f")), lambda z: F.concat(z["p"], F.coalesce(z["f"], F.lit("")))), "")
    return (
        joined.withColumn("fresh", fresh)
        .select("doc_id", rebuilt.alias("text"), F.size("found").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("found", lambda e: e["kind"]))).alias("kinds"))
        .unionByName(none)
    )
