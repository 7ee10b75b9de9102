"""What is derived from one session's or message's own fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlake.functions.text import col

# Beginnings of messages that are no one's own words.
SKIP_PREFIXES = [
    "[Request interrupted",
    "<local-command-caveat>",
    "<command-name>",
    "<command-message>",
    "<command-instruction>",
    "<system-reminder>",
    "<system-notification>",
    "[COMPACTION CONTEXT",
    "<ultrawork-mode>",
]
# Beginnings that tell what started a session; the second list without regard to case.
AUTOMATION = [
    ("<system-notification>", "system-notification"),
    ("<command-message>", "command-message"),
    ("<command-instruction>", "command-instruction"),
    ("<local-command-caveat>", "command-caveat"),
    ("<ultrawork-mode>", "ultrawork-mode"),
    ("[search-mode]", "search-mode"),
    ("[analyze-mode]", "analyze-mode"),
    ("[SYSTEM DIRECTIVE", "system-directive"),
    ("[COMPACTION CONTEXT", "compaction-context"),
    ("[GAS TOWN]", "ci-dispatch"),
    ("[gas town]", "ci-dispatch"),
]
DISPATCHES = ["gt boot", "gt prime", "gt hook", "run `gt hook`", "run `gt boot`"]
DISPATCHED, CONTINUES = "polecat dispatched", "summarize the task tool output above"
REMINDER = "<system-reminder>"
RUNNER = "agent-do"  # the command whose first argument names a tool


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def skipped(c: Column | str) -> Column:
    """Whether a message begins with one of SKIP_PREFIXES."""
    text, out = stripped(c), F.lit(False)
    for p in SKIP_PREFIXES:
        out |= text.startswith(p)
    return out


def real_prompt(c: Column | str) -> Column:
    return ~skipped(c) & (F.length(stripped(c)) >= 20)


def real_response(c: Column | str) -> Column:
    return ~skipped(c) & (F.length(stripped(c)) > 0)


def has_code(c: Column | str) -> Column:
    return col(c).contains("```") | col(c).contains("def ") | col(c).contains("function ")


def tool_mentions(c: Column | str, runner: str = RUNNER) -> Column:
    """Distinct tools after the runner, in order of name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf"{runner}\s+(\w+)"), 1)))


def content_hash(first: Column | str, last: Column | str) -> Column:
    """12 hex digits over the beginnings of the first prompt and the last response."""
    cut = lambda c: F.substring(F.coalesce(col(c), F.lit("")), 1, 500)
    return F.substring(F.md5(F.concat(cut(first), F.lit("|"), cut(last))), 1, 12)


def title(explicit: Column | str, first_prompt: Column | str) -> Column:
    """The title given, or the first line of the first prompt cut to 80 characters."""
    return F.coalesce(F.nullif(col(explicit), F.lit("")), F.substring(F.substring_index(col(first_prompt), "\n", 1), 1, 80))


def title_of_tree(first_prompt: Column | str) -> Column:
    """The first line that doesn't begin like a tag among the first line and the four after it, cut to 80 characters."""
    lines = F.transform(F.slice(F.split(stripped(first_prompt), "\n"), 1, 5), lambda x: F.trim(x))
    return F.substring(F.coalesce(F.try_element_at(F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith("<") & ~x.startswith("[")), F.lit(1)), F.try_element_at(lines, F.lit(1))), 1, 80)


def project_path(cwd: Column | str, folder: Column | str) -> Column:
    """The working directory, or the folder's name with - for /."""
    return F.coalesce(F.nullif(col(cwd), F.lit("")), F.translate(col(folder), "-", "/"))


def project_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(col(path), F.lit("/")), "/"), -1)


def file_mention_project(richtext: Column | str) -> Column:
    """The folder of the first file mentioned in rich text, or null."""
    path = F.nullif(F.regexp_extract(col(richtext), r'"fsPath"\s*:\s*"([^"]+)"', 1), F.lit(""))
    return F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit(""))


def workspace_path(uri: Column | str) -> Column:
    return F.when(col(uri).startswith("file://"), F.url_decode(F.regexp_replace(col(uri), "^file://", "")))


def automation_class(c: Column | str) -> Column:
    """The label of a session that no person began, or ''."""
    start = stripped(F.substring(F.coalesce(col(c), F.lit("")), 1, 500))
    low, out = F.lower(start), None
    for p, label in AUTOMATION:
        out = F.when(start.startswith(p), label) if out is None else out.when(start.startswith(p), label)
    out = out.when(low.contains(DISPATCHED), "ci-dispatch")
    for p in DISPATCHES:
        out = out.when(low.startswith(p), "ci-dispatch")
    return out.when(low.startswith(CONTINUES), "subagent-continuation").otherwise("")


def worker_class(c: Column | str, folder: Column | str) -> Column:
    """The label of a session that another one began, or ''; rules in their fixed order."""
    prompt = F.coalesce(col(c), F.lit(""))
    start, path = F.substring(prompt, 1, 800), F.lower(F.coalesce(col(folder), F.lit("")))
    low = F.lower(start)
    has = lambda *words: _all(low.contains(w) for w in words)
    number = F.regexp_extract(path, r"worker-(\d+)", 1)
    numbered = lambda name: F.concat(F.lit(name), F.when(number != "", F.concat(F.lit("-"), number)).otherwise(""))
    kind = F.regexp_extract(F.substring(prompt, 1, 500), r'subagent_type["\s:]+([a-zA-Z0-9_-]+)', 1)
    auto = automation_class(prompt)
    return (
        F.when(auto != "", auto)
        .when(F.lower(stripped(prompt)) == "warmup", "warmup")
        .when(has("torus loop"), "torus-loop")
        .when(has("autopilot") & (has("no human review") | has("no questions")), "autopilot")
        .when(stripped(start).startswith("@") & (has("@spirit.md") | has("@wheel.md")), "torus-orchestrated")
        .when(path.contains("merkabah-workers"), numbered("merkabah-worker"))
        .when(path.contains("torusv3-workers"), numbered("torusv3-worker"))
        .when(has("# worker prompt") & (has("torusv3") | has("one task")), "torusv3-worker")
        .when(path.contains("ophanim") | has("@vision.md", "@altar.json") | has("# wings.md", "one task"), "ophanim-worker")
        .when(stripped(start).startswith("# Worker Prompt"), "worker")
        .when(has("subagent_type"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("task-subagent")))
        .otherwise("")
    )


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out &= p
    return out


def child_type(c: Column | str) -> Column:
    """What a child session does, by words of its first prompt."""
    prompt = F.coalesce(col(c), F.lit(""))
    up = F.upper(F.substring(prompt, 1, 500))
    return (
        F.when(up.contains("PROMETHEUS"), "prometheus")
        .when(up.contains("SINGLE TASK ONLY"), "single-task")
        .when(up.contains("OH-MY-OPENCODE"), "oh-my-opencode")
        .when(up.contains("FILE-ANALYSIS") | F.substring(prompt, 1, 100).contains("Analyze this file"), "file-analysis")
        .otherwise("worker")
    )


def display(summary: Column | str, first_prompt: Column | str, title_: Column | str, most: int = 80) -> Column:
    """What stands for a session in a list, on one line."""
    text = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in (summary, first_prompt, title_)], F.lit("(no description)"))
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def flatten_content(v: Column, text_only: bool = False, dots: str = "always") -> Column:
    """Plain text of content (VARIANT) that is a string, a list of items, or anything else.

    Texts that begin with a reminder are left out; results of tools become a note of 50 characters, with dots always or only
    where they were cut, unless text_only.
    """
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    items = F.try_variant_get(v, "$", "array<variant>")

    def of(x: Column) -> Column:
        item_type, own = F.try_variant_get(x, "$.type", "string"), F.try_variant_get(x, "$.text", "string")
        result = F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit(""))
        tail = F.lit("...") if dots == "always" else F.when(F.length(result) > 50, "...").otherwise("")
        note = F.concat(F.lit("(tool_result: "), F.substring(result, 1, 50), tail, F.lit(")"))
        return (
            F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
            .when((item_type == "text") & (own != "") & ~stripped(own).startswith(REMINDER), own)
            .when((item_type == "tool_result") & F.lit(not text_only), note)
        )

    joined = F.array_join(F.filter(F.transform(items, of), lambda x: x.isNotNull()), " ")
    return F.when(kind == "STRING", F.when(stripped(text).startswith(REMINDER), "").otherwise(text)).when(items.isNotNull(), joined).otherwise(text)
