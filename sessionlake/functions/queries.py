"""Query strings as Column expressions over a table of queries: inline filters, phrasing, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import col

# What people write around the topic of a search, which the last group takes.
PHRASES = [
    r"^(?:please\s+)?(?:find|show|list|get|pull\s+up|look\s+up|look\s+for|search\s+for)\s+(?:me\s+)?(?:the\s+)?(?:sessions?|conversations?|chats?|threads?)\s+(?:where\s+)?(?:we\s+)?(?:were\s+)?(?:worked|work|working|talked|discussed|built|fixed|debugged|implemented|created|added|changed)\s+(?:on|about|with|for)?\s+(.+)$",
    r"^(?:which|what)\s+(?:sessions?|conversations?|chats?|threads?)\s+(?:did\s+)?(?:we\s+)?(?:worked|work|working|talk|talked|discuss|discussed|build|built|fix|fixed|debug|debugged|implement|implemented)\s+(?:on|about|with|for)?\s+(.+)$",
    r"^(?:sessions?|conversations?|chats?|threads?)\s+(?:where\s+)?(?:we\s+)?(?:were\s+)?(?:worked|work|working|talked|discussed|built|fixed|debugged|implemented|created|added|changed)\s+(?:on|about|with|for)?\s+(.+)$",
    r"^(?:where\s+)?(?:we\s+)?(?:were\s+)?(?:worked|work|working|talked|discussed|built|fixed|debugged|implemented|created|added|changed)\s+(?:on|about|with|for)\s+(.+)$",
    r"^(?:please\s+)?(?:find|show|list|get|pull\s+up|look\s+up|look\s+for|search\s+for)\s+(?:me\s+)?(?:the\s+)?(?:sessions?|conversations?|chats?|threads?)\s+(?:about|on|for|with)\s+(.+)$",
]
# What goes from the front of a search of another form, one after the other.
FRONTS = [
    r"^(?:please\s+)?(?:find|show|list|get|pull\s+up|look\s+up|look\s+for|search\s+for)\s+(?:me\s+)?",
    r"^(?:the\s+)?(?:sessions?|conversations?|chats?|threads?)\s+(?:about|on|for|with)\s+",
]
KEYS = ("harness", "project", "after", "before")
INLINE = r"(?i)(?<!\S)(harness|project|after|before):(\"[^\"]+\"|'[^']+'|\S+)"


def topic(c: Column | str) -> Column:
    """What a search phrased in words is about; '' for an empty one."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    text = F.trim(F.regexp_replace(text, "^[\"']+|[\"']+$", ""))
    text = F.trim(F.regexp_replace(text, r"(?i)\bplease\b[.?!]*$", ""))
    found = [F.nullif(F.regexp_replace(F.regexp_extract(text, "(?i)" + p, 1), "^[ \"']+|[ \"']+$", ""), F.lit("")) for p in PHRASES]
    rest = text
    for front in FRONTS:
        rest = F.trim(F.regexp_replace(rest, "(?i)" + front, ""))
    return F.coalesce(*found, rest)


def date_value(c: Column | str, now: Column) -> Column:
    """A date as written: a number of hours, days, weeks or 30-day months before now; ISO; or year-month-day and month-day with - or /. Null for others."""
    text = F.lower(col(c))
    amount, unit = F.regexp_extract(text, r"^(\d{1,6})([hdwm])$", 1), F.regexp_extract(text, r"^(\d{1,6})([hdwm])$", 2)
    hours = F.try_element_at(F.create_map(*[x for k, v in (("h", 1), ("d", 24), ("w", 168), ("m", 720)) for x in (F.lit(k), F.lit(v))]), unit)
    back = F.timestamp_seconds(F.unix_seconds(now) - F.nullif(amount, F.lit("")).cast("long") * hours * 3600)
    iso = F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(col(c)))
    slashed = F.when(col(c).rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.try_to_timestamp(F.translate(col(c), "/", "-"), F.lit("yyyy-M-d")))
    short = F.when(col(c).rlike(r"^\d{1,2}[-/]\d{1,2}$"), F.try_to_timestamp(F.concat(F.year(now), F.lit("-"), F.translate(col(c), "/", "-")), F.lit("yyyy-M-d")))
    return F.coalesce(back, iso, slashed, short)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^([\"'])(.*)\\1$", "$2")


def parse_hybrid(queries: DataFrame, now: Column, raw: str = "raw", explicit: tuple[str, ...] = ()) -> DataFrame:
    """Adds text, tags, harness, project, after_ts, before_ts. The last of several filters counts; columns named in
    `explicit` (harness, project) that are there already win over inline ones."""
    plain = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"#tag:\S+", " ")
    keys = F.transform(F.regexp_extract_all(plain, F.lit(INLINE), 1), lambda k: F.lower(k))
    values = F.regexp_extract_all(plain, F.lit(INLINE), 2)
    inline = {k: F.when(F.array_contains(keys, k), unquoted(F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["k"] == k), -1)["v"])) for k in KEYS}
    own = {k: F.coalesce(F.col(k), inline[k]) if k in explicit else inline[k] for k in ("harness", "project")}
    return queries.withColumns({
        "text": topic(F.regexp_replace(plain, INLINE, " ")), "tags": F.regexp_extract_all(F.coalesce(F.col(raw), F.lit("")), F.lit(r"#tag:(\S+)"), 1),
        "harness": own["harness"], "project": own["project"], "after_ts": date_value(inline["after"], now), "before_ts": date_value(inline["before"], now),
    })


def parse_plain(queries: DataFrame, now: Column, raw: str = "raw") -> DataFrame:
    """The older form: every word:value is taken out of the text; the last of each of four keys is kept, harness in lower case."""
    pattern = r"(\w+):(\S+)"
    keys = F.transform(F.regexp_extract_all(F.col(raw), F.lit(pattern), 1), lambda k: F.lower(k))
    pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(F.col(raw), F.lit(pattern), 2).alias("v"))
    last = {k: F.when(F.array_contains(keys, k), F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]) for k in KEYS}
    return queries.withColumns({"text": F.trim(F.regexp_replace(F.col(raw), pattern, "")), "harness": F.lower(last["harness"]), "project": last["project"], "after_ts": date_value(last["after"], now), "before_ts": date_value(last["before"], now)})
