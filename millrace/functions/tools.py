"""Tool grants: normal form, predicates, and the set of tools a grant resolves to."""

from pyspark.sql import functions as F

# Names and sets that results depend on.
VALID_TOOLS = "Read Write Edit NotebookEdit Glob Grep Bash PowerShell BashOutput KillBash KillShell WebFetch WebSearch TodoWrite Task Agent Skill ToolSearch Monitor TaskStop TaskOutput SendMessage ListAgents Artifact EnterWorktree ExitWorktree ExitPlanMode EnterPlanMode AskUserQuestion dispatch_agent".split()
INVALID_TOOLS = "Browser Cd CodeInterpreter Computer CreateFile DeleteFile Fetch FileEdit FileRead FileWrite GlobTool GrepTool LS Memory MultiEdit Note NotebookRead Plan Python Replace RunCommand SearchTool Shell SlashCommand StickerRequest Terminal Think TodoRead View WebFetchTool".split()
LEGACY_TOOLS = "MultiEdit LS View Replace NotebookRead TodoRead GlobTool GrepTool SlashCommand StickerRequest WebFetchTool Cd".split()
WRITE_SETS = {
    "narrow": "Write Edit NotebookEdit".split(),
    "primary": "Write Edit NotebookEdit Bash PowerShell".split(),
    "broad": "Write Edit NotebookEdit Bash PowerShell Agent Task Skill EnterWorktree".split(),
}
SHELLS = "Bash PowerShell Monitor".split()
SCHEMA_FIELDS = "name description tools disallowedTools model permissionMode maxTurns skills mcpServers hooks memory background isolation color effort initialPrompt".split()
NEAR_MISS_FIELDS = "allowed-tools allowedTools allowed_tools tools_allowed".split()
MODEL_PATTERN = "(?i)^(opus|sonnet|haiku|fable|inherit|claude-)"
#: Rules of the resolver as observed: names it renames, names a grant never yields.
ALIASES = {"Agent": "Task", "KillShell": "TaskStop", "BashOutput": "TaskOutput"}
POOL = "Task Bash CronCreate CronDelete CronList DesignSync Edit EnterWorktree ExitWorktree NotebookEdit Read ReportFindings ScheduleWakeup SendMessage Skill TaskOutput TaskStop ToolSearch WebFetch WebSearch Workflow Write".split()
SEARCH_TOOLS = "Grep Glob".split()
# End of fixed values.

TOKEN = r"[A-Za-z_][\w.-]*\([^)]*\)|\S+"
STAR = ["*"]


def strings(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(text):
    """Trim all white space, not spaces alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise_tools(text):
    """A grant written as text: NULL stays, '*' and 'all' are ['*'], else items by comma or, without one, by token."""
    bare = strip(text)
    parts = F.when(bare.contains(","), F.split(bare, ",")).otherwise(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)))
    items = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.when(text.isNull(), F.lit(None)).when(F.lower(bare).isin("*", "all"), strings(STAR)).otherwise(items)


def normalise_list(items):
    """A grant written as a list: items are trimmed, empty ones dropped, NULL stays."""
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def base_tool(tool):
    """The name before a specifier in brackets."""
    return strip(F.regexp_replace(tool, r"\(.*$", ""))


def bases(tools):
    return F.array_distinct(F.transform(tools, base_tool))


def is_wildcard(tools):
    return tools == strings(STAR)


def declares_tools(tools):
    return F.coalesce(tools.isNotNull() & (F.size(tools) > 0) & ~is_wildcard(tools), F.lit(False))


def grants_capability(tools, write_set="primary"):
    """Whether a grant can change things; none declared means everything."""
    return tools.isNull() | F.coalesce(is_wildcard(tools), F.lit(False)) | F.coalesce(F.arrays_overlap(bases(tools), strings(WRITE_SETS[write_set])), F.lit(False))


def grant_type(has_key, tools):
    """implicit (no key or nothing in it), wildcard or explicit."""
    return F.when(~has_key | tools.isNull(), "implicit").when(is_wildcard(tools), "wildcard").otherwise("explicit")


def can_write(tools):
    return F.arrays_overlap(bases(tools), strings(WRITE_SETS["narrow"]))


def can_shell(tools):
    return F.arrays_overlap(bases(tools), strings(SHELLS))


def shell_scoped_only(tools):
    return F.exists(tools, lambda t: t.startswith("Bash(")) & ~F.array_contains(tools, "Bash")


def is_known(tool, vocabulary=None):
    return base_tool(tool).isin(*(vocabulary or VALID_TOOLS)) | tool.startswith("mcp__") | (tool == "*")


def dominated(grant, tools):
    """Explicit, no file-writing tool, yet an unscoped shell."""
    return F.coalesce((grant == "explicit") & ~can_write(tools) & can_shell(tools) & ~shell_scoped_only(tools), F.lit(False))


def withheld(grant, tools):
    return F.coalesce((grant == "explicit") & ~can_write(tools), F.lit(False))


def restricted(grant, tools):
    return F.coalesce((grant == "explicit") & ~can_write(tools) & ~can_shell(tools), F.lit(False))


def near_miss(keys):
    return F.coalesce(F.arrays_overlap(keys, strings(NEAR_MISS_FIELDS)) & ~F.array_contains(keys, "tools"), F.lit(False))


def resolve(text, disallowed=None):
    """Tools a written grant resolves to, by the observed rules.

    Nothing written or '*' is the pool. Names count with their case; aliases are renamed;
    specifiers fall away; names outside the pool (other servers' tools among them) yield
    nothing, but the search tools stay unless a shell is granted beside them; 'all' is an
    unknown name here. What is disallowed is taken off.
    """
    named = F.transform(F.filter(F.split(strip(text), r"[,\s]+(?![^(]*\))"), lambda x: x != ""), base_tool)
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    renamed = F.transform(named, lambda t: F.coalesce(F.try_element_at(alias, t), t))
    shell = F.array_contains(renamed, "Bash")
    kept = F.filter(renamed, lambda t: t.isin(*POOL) | (t.isin(*SEARCH_TOOLS) & ~shell))
    out = F.when(text.isNull() | (strip(text) == "*"), strings(POOL)).otherwise(F.array_distinct(kept))
    if disallowed is not None:
        out = F.when(disallowed.isNull(), out).otherwise(F.array_except(out, F.transform(disallowed, lambda t: F.coalesce(F.try_element_at(alias, base_tool(t)), base_tool(t)))))
    return out


def add_gated(effective, requested, gated):
    """Names that need a credential are added back where they were asked for."""
    return F.array_union(effective, F.array_intersect(requested, strings(gated)))


def search_dropped(requested, effective):
    """Search tools asked for but not resolved."""
    return F.size(F.array_except(F.array_intersect(bases(requested), strings(SEARCH_TOOLS)), effective)) > 0


def class_counts(unresolved, classes, default="never_valid"):
    """How many unresolved names are of each class of a name -> class map."""
    known = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    labels = F.transform(unresolved, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(default)))
    names = sorted({*classes.values(), default})
    return F.map_from_arrays(strings(names), F.array(*[F.size(F.filter(labels, lambda x, n=n: x == n)) for n in names]))


def overlap(requested, names):
    """Names of a list that a grant asks for, sorted; empty where none."""
    return F.array_sort(F.array_intersect(F.coalesce(requested, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names])))
