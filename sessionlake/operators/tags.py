"""Tags of sessions by tables of rules: weights for each match or once, the best fifteen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns of tools, each match of which counts 2. {0} takes the first capture, in lower case.
TOOLS = [
    (r"agent-do\s+(\w+)", "tool:agent-do-{0}"),
    (r"\bgit\s+(commit|push|pull|rebase|merge|branch|checkout)", "tool:git"),
    (r"\bnpm\s+(install|run|test|build|start)", "tool:npm"),
    (r"\bdocker\s+(build|run|compose|push|pull)", "tool:docker"),
    (r"\bpytest\b", "tool:pytest"),
    (r"\bpython\s+-m\s+pytest", "tool:pytest"),
    (r"\brg\b|\bripgrep\b", "tool:ripgrep"),
    (r"\blsp_\w+", "tool:lsp"),
    (r"\bast_grep", "tool:ast-grep"),
    (r"\bgrep\b", "tool:grep"),
    (r"\bfind\b", "tool:find"),
    (r"\bls\b", "tool:ls"),
    (r"\bcat\b", "tool:cat"),
    (r"\bsed\b", "tool:sed"),
    (r"\bawk\b", "tool:awk"),
    (r"\bjq\b", "tool:jq"),
    (r"\bcurl\b", "tool:curl"),
    (r"\bwget\b", "tool:wget"),
    (r"\bvim\b|\bvi\b", "tool:vim"),
    (r"\btmux\b", "tool:tmux"),
    (r"\bvscode\b|\bcode\b", "tool:vscode"),
]
# Patterns of activities, which count 1.5 once.
ACTIVITIES = [
    (r"\b(fix|debug|troubleshoot|diagnose|trace|profile)\b", "debugging"),
    (r"\b(implement|add|create|build|write|develop)\b", "implementing"),
    (r"\b(refactor|restructure|reorganize|rewrite|clean|simplify)\b", "refactoring"),
    (r"\b(test|spec|coverage|assert|validate|verify)\b", "testing"),
    (r"\b(document|comment|explain|describe|annotate)\b", "documenting"),
    (r"\b(review|audit|analyze|inspect|examine)\b", "reviewing"),
    (r"\b(optimize|improve|enhance|speed|performance)\b", "optimizing"),
    (r"\b(deploy|release|publish|ship|launch)\b", "deploying"),
    (r"\b(migrate|upgrade|update|patch|version)\b", "migrating"),
    (r"\b(integrate|connect|link|bind|wire)\b", "integrating"),
]
# Patterns of technologies, each match of which counts 1.
TECHNOLOGIES = [
    (r"\breact\b", "react"),
    (r"\bvue\b", "vue"),
    (r"\bangular\b", "angular"),
    (r"\bsvelte\b", "svelte"),
    (r"\bnext\.?js\b", "nextjs"),
    (r"\bnuxt\b", "nuxt"),
    (r"\bast?ro\b", "astro"),
    (r"\bpython\b", "python"),
    (r"\bjavascript\b|\bjs\b", "javascript"),
    (r"\btypescript\b|\bts\b", "typescript"),
    (r"\bruby\b", "ruby"),
    (r"\bjava\b", "java"),
    (r"\bgo\b|\bgolang\b", "go"),
    (r"\brust\b", "rust"),
    (r"\bc\+\+\b|\bcpp\b", "cpp"),
    (r"\bc#\b|\bcsharp\b", "csharp"),
    (r"\bphp\b", "php"),
    (r"\bpostgres\b|\bpostgresql\b", "postgres"),
    (r"\bmysql\b", "mysql"),
    (r"\bsqlite\b", "sqlite"),
    (r"\bmongodb\b|\bmongo\b", "mongodb"),
    (r"\bredis\b", "redis"),
    (r"\bfirebase\b", "firebase"),
    (r"\bdynamodb\b", "dynamodb"),
    (r"\bprisma\b", "prisma"),
    (r"\bdrizzle\b", "drizzle"),
    (r"\btypeorm\b", "typeorm"),
    (r"\bsqlalchemy\b", "sqlalchemy"),
    (r"\bsequelize\b", "sequelize"),
    (r"\bjest\b", "jest"),
    (r"\bvitest\b", "vitest"),
    (r"\bmocha\b", "mocha"),
    (r"\brspec\b", "rspec"),
    (r"\bunittest\b", "unittest"),
    (r"\bwebpack\b", "webpack"),
    (r"\bvite\b", "vite"),
    (r"\besbuild\b", "esbuild"),
    (r"\brollup\b", "rollup"),
    (r"\bpnpm\b", "pnpm"),
    (r"\byarn\b", "yarn"),
    (r"\bcloudflare\b", "cloudflare"),
    (r"\baws\b", "aws"),
    (r"\bazure\b", "azure"),
    (r"\bgcp\b|\bgoogle\s+cloud\b", "gcp"),
    (r"\bvercel\b", "vercel"),
    (r"\bnetlify\b", "netlify"),
    (r"\bheroku\b", "heroku"),
    (r"\bdocker\b", "docker"),
    (r"\bkubernetes\b|\bk8s\b", "kubernetes"),
    (r"\bexpress\b", "express"),
    (r"\bfastapi\b", "fastapi"),
    (r"\bdjango\b", "django"),
    (r"\brails\b", "rails"),
    (r"\bflask\b", "flask"),
    (r"\bhono\b", "hono"),
    (r"\bfastify\b", "fastify"),
    (r"\bgraphql\b", "graphql"),
    (r"\brest\b", "rest"),
    (r"\bgit\b", "git"),
    (r"\bai\b|\bllm\b|\bgpt\b", "ai"),
    (r"\bapi\b", "api"),
    (r"\bauth\b|\bauthentication\b", "auth"),
    (r"\bcache\b|\bcaching\b", "caching"),
    (r"\bsearch\b", "search"),
    (r"\bindex\b|\bindexing\b", "indexing"),
]

Rule = tuple[str, str, float, str]  # pattern, tag, weight, how: each match, or once
RULES: list[Rule] = [(p, t, 2.0, "each") for p, t in TOOLS] + [(p, t, 1.5, "once") for p, t in ACTIVITIES] + [(p, t, 1.0, "each") for p, t in TECHNOLOGIES]


def tag_scores(texts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """session_id, tag, score, rule (the first that gave the tag). texts: session_id, text — all text of a session in one row.

    All rules run over a row as one array of counts, without a join; patterns are matched without regard to case.
    """
    plain, captured = [], []
    for i, r in enumerate(rules):
        (captured if "{0}" in r[1] else plain).append((i, r))
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda r: F.regexp_count(text, F.lit("(?iU)" + r[0]))
    found = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r[1]).alias("tag"), (count(r) * r[2] if r[3] == "each" else F.when(count(r) > 0, r[2]).otherwise(0.0)).cast("double").alias("score")) for i, r in plain])
    parts = [found]
    for i, (pattern, tag, weight, _) in captured:
        before, after = tag.split("{0}")
        hits = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), 1)
        parts.append(F.transform(hits, _captured(i, before, after, weight)))
    rows = texts.select("session_id", F.explode(F.filter(F.concat(*parts), lambda x: x["score"] > 0)).alias("x")).select("session_id", "x.*")
    return rows.groupBy("session_id", "tag").agg(F.sum("score").alias("score"), F.min("rule").alias("rule"))


def _captured(rule: int, before: str, after: str, weight: float):
    return lambda h: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit(before), F.lower(h), F.lit(after)).alias("tag"), F.lit(weight).cast("double").alias("score"))


def session_tags(texts: DataFrame, sessions: DataFrame, rules: list[Rule] = RULES, most: int = 15) -> DataFrame:
    """session_id, tag, score, place for the best tags of each session; its project and harness count half a point."""
    half = lambda name, c, rule: sessions.filter(F.coalesce(F.col(c), F.lit("")) != "").select(F.col("id").alias("session_id"), F.concat(F.lit(name), F.lower(c)).alias("tag"), F.lit(0.5).alias("score"), F.lit(rule).alias("rule"))
    both = tag_scores(texts, rules).unionByName(half("project:", "project_name", len(rules))).unionByName(half("harness:", "harness", len(rules) + 1))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "rule", "tag"))
    return both.withColumn("place", place).filter(F.col("place") <= most).drop("rule")


def session_text(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, text: title, first and last prompt, last response and all messages. sessions has id and these fields."""
    own = messages.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("body"))
    fields = [F.nullif(F.col(c), F.lit("")) for c in ("title", "first_prompt", "last_prompt", "last_response")]
    return sessions.select(F.col("id").alias("session_id"), *[f.alias(f"f{i}") for i, f in enumerate(fields)]).join(own, "session_id", "left").select("session_id", F.concat_ws(" ", *[f"f{i}" for i in range(len(fields))], "body").alias("text"))


def tag_counts(annotations: DataFrame) -> DataFrame:
    return annotations.filter("type = 'tag'").groupBy("value").agg(F.count("*").alias("n"))


def sessions_with_tag(annotations: DataFrame, tag: str) -> DataFrame:
    return annotations.filter((F.col("type") == "tag") & (F.col("value") == tag)).select("session_id").distinct()


def annotation_search(annotations: DataFrame, text: str) -> DataFrame:
    """Annotations whose value has the text, without regard to case, newest first."""
    return annotations.filter(F.lower("value").contains(text.lower())).orderBy(F.desc("ts"), "session_id")


def annotations_of(annotations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Annotations of some sessions (id) with their place in each, oldest first."""
    own = annotations.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "type", "value")))
