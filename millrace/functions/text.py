"""Text expressions: segmentation, modality, script, lexicon features, roles, coercion."""

from pyspark.sql import functions as F

from .tools import strip, strings

# Patterns and role tables that results depend on.
PROHIBITION = r"(?i)\b(never|must\s+not|mustn['’]?t|shall\s+not|do\s+not|don['’]?t|does\s+not|doesn['’]?t|should\s+not|shouldn['’]?t|cannot|can['’]?t|may\s+not|not\s+allowed|not\s+permitted|forbidden|prohibited|under\s+no\s+circumstances|refrain\s+from|avoid|no\s+(?:editing|edits|changes|modifications|writes|writing))\b"
STRICT_PROHIBITION = r"(?i)\b(never|must\s+not|mustn['’]?t|shall\s+not|do\s+not|don['’]?t|may\s+not|not\s+allowed|not\s+permitted|forbidden|prohibited|under\s+no\s+circumstances|refrain\s+from|no\s+(?:editing|edits|changes|modifications|writes|writing))\b"
OBLIGATION = r"(?i)\b(must|always|shall|required\s+to|is\s+required|are\s+required|need\s+to|needs\s+to|have\s+to|has\s+to|ensure|make\s+sure|mandatory)\b"
RECOMMENDATION = r"(?i)\b(should|prefer|preferably|recommended|ideally|try\s+to|consider|where\s+possible|when\s+possible|if\s+possible)\b"
PERMISSION = r"(?i)\b(may|can|allowed\s+to|feel\s+free|permitted\s+to|you\s+are\s+free\s+to)\b"
EMPHASIS = r"\b(NEVER|MUST|ALWAYS|IMPORTANT|CRITICAL|DO NOT|DON'T|REQUIRED|MANDATORY|WARNING|NOTE|ONLY)\b"
PERSONA = r"(?im)^\s*(you\s+are|you['’]re|act\s+as|as\s+an?\s)"
HYPE = r"(?i)\b(world[- ]class|elite|expert|senior|principal|master|guru|ninja|rockstar|10x|legendary|top[- ]tier|seasoned|veteran|god\s*mode)\b"
READ_ONLY = r"(?i)\b(read[- ]only|readonly|never\s+(?:modify|edit|write|change|create|delete)|(?:do|does|must|should|shall)\s*n['’]?o?t\s+(?:modify|edit|write|change|create|delete|touch|alter)|no\s+(?:code\s+)?(?:edits|changes|modifications)|without\s+(?:modifying|editing|changing)|not\s+(?:make|making)\s+(?:any\s+)?(?:changes|edits)|you\s+(?:do\s+not|don['’]?t)\s+(?:write|edit|modify))\b"
REFUSAL = r"(?i)\b(can(?:no|')t|unable|not able|won'?t|will not|not permitted|not allowed|read-only|do(?:n'?t| not) have (?:the )?(?:ability|permission|access|tools?)|decline|refrain|must not|cannot (?:create|modify|delete|run|write|execute))\b"
FOUND_BUG = r"(?i)len\(xs\)\s*-\s*1|n\s*-\s*1|off[- ]by[- ]one|divid\w*\s+by\s+(?:the\s+)?(?:len|count|number)|\(len\(xs\)\s*-\s*1\)|wrong denominator|denominator"
STRICT_ROLES = {
    "reviewer": r"(^|[-_ ])(code[-_ ]?)?review(er)?([-_ ]|$)|(^|[-_ ])auditor([-_ ]|$)",
    "security": r"(^|[-_ ])(security|appsec|pentest(er)?|vulnerability)([-_ ]|$)",
    "docs": r"(^|[-_ ])(doc|docs|documentation)([-_ ]|$)|technical[-_ ]?writer|doc[-_ ]?writer",
    "tester": r"(^|[-_ ])(test(er)?|qa|test[-_ ]?writer|test[-_ ]?runner|test[-_ ]?automator)([-_ ]|$)",
    "implementer": r"(^|[-_ ])(implementer|developer|coder|builder)([-_ ]|$)",
    "debugger": r"(^|[-_ ])(debugger|bug[-_ ]?fixer|fixer|troubleshooter)([-_ ]|$)",
    "architect": r"(^|[-_ ])architect([-_ ]|$)",
    "planner": r"(^|[-_ ])(planner|orchestrator|coordinator)([-_ ]|$)",
}
BROAD_ROLES = {
    "review/audit": (r"\b(review(er)?|audit(or|ing)?|critic|inspector|linter)\b", r"\b(code review|reviews? (the )?code|audits?)\b"),
    "test": (r"\b(test(er|ing)?|tdd|qa|e2e|spec-?writer)\b", r"\b(unit test|integration test|test suite|coverage)\b"),
    "security": (r"\b(security|sec|vuln(erability)?|threat|pentest|appsec)\b", r"\b(vulnerabilit|security (review|audit)|owasp|injection)\b"),
    "docs": (r"\b(doc(s|umentation)?|readme|changelog|writer|scribe)\b", r"\b(documentation|write (the )?docs|changelog)\b"),
    "architecture": (r"\b(architect(ure)?|adr|design(er)?)\b", r"\b(architectur|design decision|system design)\b"),
    "debug/fix": (r"\b(debug(ger)?|bug|fix(er)?|troubleshoot|triage|resolver)\b", r"\b(debug|fix(es|ing)? (bugs|errors|issues)|root cause)\b"),
    "implement": (r"\b(implement(er|ation)?|coder|builder|developer|engineer|generator|writer)\b", r"\b(implement(s|ing)?|writes? code|builds?)\b"),
    "refactor": (r"\b(refactor(er)?|cleanup|optimizer|simplifier)\b", r"\b(refactor|clean ?up|reduce (complexity|duplication))\b"),
    "data/db": (r"\b(database|db|sql|migration|etl|schema|query)\b", r"\b(database|sql|schema|query plan)\b"),
    "devops/infra": (r"\b(devops|infra(structure)?|deploy(ment)?|docker|k8s|kubernetes|terraform|ci|cd|release|ops)\b", r"\b(deploy|infrastructur|pipeline|kubernetes|terraform)\b"),
    "frontend": (r"\b(frontend|ui|ux|react|vue|svelte|css|styling)\b", r"\b(front-?end|user interface|component)\b"),
    "backend/api": (r"\b(backend|api|server|endpoint|microservice)\b", r"\b(back-?end|rest api|endpoint)\b"),
    "research": (r"\b(research(er)?|explorer?|investigator|analyst|scout)\b", r"\b(research|investigat|explores?)\b"),
    "planning": (r"\b(plan(ner)?|orchestrat(or)?|coordinator|manager|lead|supervisor|dispatcher)\b", r"\b(orchestrat|coordinat|plans? (the )?work|delegat)\b"),
    "ml/ai": (r"\b(ml|ai|llm|prompt|model|embedding|rag)\b", r"\b(machine learning|llm|prompt engineering)\b"),
    "mobile": (r"\b(mobile|android|ios|flutter|swift|react-?native)\b", r"\b(mobile app|android|ios)\b"),
}
# End of fixed values.

CASCADE = {"prohibition": PROHIBITION, "obligation": OBLIGATION, "recommendation": RECOMMENDATION, "permission": PERMISSION}


def modality(sentence):
    """First class of the cascade that the sentence shows, else NULL."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CASCADE.items()):
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def weak_only(sentence):
    """A prohibition by weaker markers alone."""
    return (modality(sentence) == "prohibition") & ~sentence.rlike(STRICT_PROHIBITION)


def sentences(text, shortest=12, longest=600):
    """Segments after terminal punctuation or line breaks, code fences left out, list marks stripped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)```.*?```", "\n")
    parts = F.split(plain, r"(?<=[.!?。！？])\s+|\n+")
    clean = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"^\s*(?:[-*+>#]+|\d+[.)])\s*", "")))
    return F.filter(clean, lambda s: F.char_length(s).between(shortest, longest))


def script(text):
    """latin if over 70 % of the letters are below U+0250, other if not, none without letters."""
    letters = F.char_length(F.regexp_replace(text, r"\P{L}", ""))
    latin = F.char_length(F.regexp_replace(text, r"[^\p{L}&&[\x{0}-\x{24F}]]", ""))
    return F.when(letters == 0, "none").when(latin / letters > 0.7, "latin").otherwise("other")


def text_features(text):
    """Lexicon and layout counts of one text as a struct."""
    t = F.coalesce(text, F.lit(""))
    bold = F.regexp_count(t, F.lit(r"\*\*"))
    return F.struct(
        F.char_length(t).alias("chars"),
        F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))).alias("words"),
        F.regexp_count(t, F.lit(EMPHASIS)).alias("emphasis"),
        F.floor(bold / 2).cast("int").alias("bold"),
        (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))).alias("exclamations"),
        F.regexp_count(t, F.lit(HYPE)).alias("hype"),
        F.substring(t, 1, 400).rlike(PERSONA).alias("persona"),
        t.rlike(READ_ONLY).alias("read_only"),
        t.rlike(r"(?i)<example>|\bexamples?:").alias("examples"),
        t.rlike(r"(?i)\bproactive(ly)?\b").alias("proactive"),
    )


def tokens(text):
    """Distinct lower-case tokens of three characters or more that start with a letter."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9+#.-]{2,}"), F.lit(0)))


def strict_role(name):
    """The one role whose pattern the name shows; NULL for none or several."""
    shown = F.filter(F.array(*[F.when(F.lower(name).rlike(p), F.lit(r)) for r, p in STRICT_ROLES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(shown) == 1, F.try_element_at(shown, F.lit(1)))


def broad_role(name, description):
    """Role of the highest score, ten for the name and three for the description; the first of equals, NULL at zero."""
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    scored = F.array(
        *[F.struct((10 * n.rlike(p).cast("int") + 3 * d.rlike(q).cast("int")).alias("score"), F.lit(-i).alias("order"), F.lit(r).alias("role")) for i, (r, (p, q)) in enumerate(BROAD_ROLES.items())]
    )
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["role"])


def collapse_mode(mode):
    """inspect against change (mixed counts as change); unclear and NULL stay apart."""
    return F.when(mode == "inspect", "inspect").when(mode.isin("change", "mixed"), "change").when(mode == "unclear", "unclear")


def truthy(column, kind="string"):
    """Presence in the loose sense: not NULL, empty, zero or false."""
    if kind == "string":
        return F.coalesce(column != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return F.coalesce(column.cast("double") != 0, F.lit(False)) if kind == "number" else F.coalesce(column, F.lit(False))


def prettify(name, longest=40):
    return F.substring(F.translate(name, "-_", "  "), 1, longest)


def head_tail(text, head, tail, mark=" … "):
    """Both ends of a long text around a mark; short texts whole."""
    return F.when(F.char_length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail))))


def ellipsis(text, longest):
    return F.when(F.char_length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, longest), F.lit("…")))


def locate(path, marker=".claude/agents/"):
    """config_root, rel_path, nested and root_is_repo_root of the last place of a marker in a path."""
    root = F.regexp_extract(path, f"^(.*){marker.replace('.', chr(92) + '.')}(.*)$", 1)
    rel = F.regexp_extract(path, f"^(.*){marker.replace('.', chr(92) + '.')}(.*)$", 2)
    return F.struct(root.alias("config_root"), rel.alias("rel_path"), rel.contains("/").alias("nested"), (root == "").alias("root_is_repo_root"))


def frontmatter(text):
    """The block between the opening fence lines, NULL without one."""
    found = F.regexp_extract(text, r"(?s)\A\x{FEFF}?---\s*\n(.*?)\n---\s*(\n|$)", 1)
    return F.when(text.rlike(r"(?s)\A\x{FEFF}?---\s*\n(.*?)\n---\s*(\n|$)"), found)


def body(text):
    return F.regexp_replace(text, r"(?s)\A\x{FEFF}?---\s*\n(.*?)\n---\s*(\n|$)", "")


def percent(x, places=1):
    return F.format_string(f"%.{places}f%%", x * 100)


def thousands(n):
    return F.format_number(n, 0)


def interval(lo, hi, places=1):
    return F.format_string(f"%.{places}f–%.{places}f", lo * 100, hi * 100)


def scientific(x):
    return F.format_string("%.1e", x)


def known_codes(values, domain):
    """Codes outside a label's domain become NULL."""
    return F.when(values.isin(*domain), values)


def recode(column, positive):
    """Two-way recode against the rest, NULL staying NULL."""
    return F.when(column.isNull(), None).otherwise(F.when(column == positive, positive).otherwise(f"not {positive}"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["strings"]
