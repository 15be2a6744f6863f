"""Content signals, roles, importance, repository type and file selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from .folds import fold


def content_signals(content: Column) -> Column:
    """X16 as a struct of flags over the first 4 KB."""
    return F.struct(*[c.alias(name) for name, c in signal_columns(content).items()])


def signal_columns(content: Column) -> dict[str, Column]:
    """X16 by name: a query that needs a few signals computes only those."""
    c = F.substring(F.coalesce(content, F.lit("")), 1, 4096)
    # counts of line starts in one scan each; a code line is not blank and no comment
    lines = lambda p: F.regexp_count(c, F.lit(r"(?m)^[ \t\r\f]*+" + p))
    n = lines(r"(?!#|//)\S")
    exports = lines(r"(?:from |export |module\.exports|__all__)")
    constants = lines(r"[A-Z][A-Z_0-9]+\s*=")
    routes = sum((F.regexp_count(c, F.lit(p)) for p in V.ROUTE_PATTERNS), F.lit(0))
    # a plain substring that every match needs is cheaper than the pattern, and mostly absent
    has = lambda *words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    frameworks = F.filter(F.array(*[F.when(has(*V.FRAMEWORK_WORDS[name]) & c.rlike(p), F.lit(name)) for name, p in V.FRAMEWORK_PATTERNS.items()]), lambda x: x.isNotNull())
    return {
        "has_main_guard": (c.contains("if __name__") & c.contains("__main__")),
        "has_main_function": (has("main") & c.rlike(r"def\s+main\s*\(|func\s+main\s*\(|public\s+static\s+void\s+main")),
        "starts_server": ((has("app.listen", "createServer", "uvicorn.run") & c.rlike(r"app\.listen\s*\(|createServer\s*\(|uvicorn\.run")) | (has("Flask", "FastAPI", "uvicorn", "Django") & c.rlike(r"\.run\s*\("))),
        "has_class_defs": (has("class", "interface", "struct", "enum") & (F.regexp_count(c, F.lit(r"(?:class|interface|struct|enum)\s+\w+")) >= 2)),
        "has_route_defs": (routes >= 2),
        "exports_only": ((n > 0) & (exports > 0.7 * n)),
        "mostly_constants": ((n > 3) & (constants > 0.4 * n)),
        "ml_frameworks": frameworks,
        "has_ml_model_def": (has("nn.", "keras", "layers.") & c.rlike(V.MODEL_PATTERN)),
        "has_ml_training": (has(".backward()", "optimizer.", "model.") & c.rlike(V.TRAINING_PATTERN)),
        "has_ml_pipeline": (has("Data", "transforms", "tf.data") & c.rlike(V.PIPELINE_PATTERN)),
    }


def graph_role_candidates(i: Column, o: Column, avg_in: Column, avg_out: Column, max_in: Column, max_out: Column) -> Column:
    """Step 10 of the ladder: struct(confidence, role) from degrees alone."""
    ri, ro = i / max_in, o / max_out
    make = lambda conf, role: F.struct(conf.cast("double").alias("confidence"), F.lit(role).alias("role"))
    return (
        F.when((i >= 3) & (o >= 2) & (ri >= 0.3) & (ro >= 0.2), make(0.75 + 0.2 * ri, "core_module"))
        .when((o >= 3) & (ro >= 0.3) & (i <= avg_in), make(0.70 + 0.2 * ro, "orchestrator"))
        .when((i >= 3) & (ri >= 0.3) & (o <= avg_out), make(0.75 + 0.2 * ri, "shared_utility"))
        .when((i >= 1) & (i < 3) & (o <= 2), make(F.lit(0.60), "internal_helper"))
        .when((i == 0) & (o == 0), make(F.lit(0.50), "leaf"))
        .when((i == 0) & (o >= 1), make(F.lit(0.45), "leaf"))
        .otherwise(make(F.lit(0.30), "leaf"))
    )


def classify(files: DataFrame, deg: DataFrame, averages: DataFrame, entries: DataFrame) -> DataFrame:
    """L1: role and confidence per file; the highest confidence wins, ties go to the earlier rule.

    ``files``: path, name, extension, content.  ``averages`` is one row and is joined as such.
    """
    f = (
        files.join(deg.withColumnRenamed("file", "path"), "path", "left")
        .na.fill(0, ["in_degree", "out_degree"])
        .join(entries.select(F.col("file").alias("path"), F.col("score").alias("entry_score")), "path", "left")
        .crossJoin(F.broadcast(averages))  # one row
        .withColumn("s", content_signals(F.col("content")))
    )
    path, name, i, o = F.col("path"), F.col("name"), F.col("in_degree"), F.col("out_degree")
    source = F.lower("extension").isin(V.SOURCE_EXTENSIONS)
    entry = F.col("entry_score").isNotNull() | name.isin(V.ROLE_ENTRY_NAMES)
    entry_conf = F.least(F.lit(0.95), 0.6 + 0.05 * F.coalesce("entry_score", F.lit(0)))
    entry_conf = F.greatest(entry_conf, F.when(F.col("s.starts_server"), 0.92).when(F.col("s.has_main_guard") | F.col("s.has_main_function"), 0.90).otherwise(0.0))
    ml = F.size("s.ml_frameworks") > 0
    graph = graph_role_candidates(i, o, F.col("avg_in"), F.col("avg_out"), F.col("max_in"), F.col("max_out"))
    not_entry_leaf = ~((graph["role"] == "leaf") & (graph["confidence"] == 0.45) & entry)
    ladder = [
        ("documentation", name.isin(V.DOC_NAMES) | (F.lower("extension").isin(".md", ".rst", ".txt") & S.is_doc_path(path)), F.lit(0.95)),
        ("test", S.matches_any(path, V.TEST_PATTERNS) | S.matches_any(name, V.TEST_PATTERNS), F.lit(0.92)),
        ("build", name.isin(V.BUILD_NAMES) | S.is_ci_path(path), F.lit(0.90)),
        ("config", name.isin(V.CONFIG_NAMES) | F.col("s.mostly_constants"), F.lit(0.88)),
        ("data", S.matches_any(path, V.DATA_PATTERNS), F.lit(0.85)),
        ("type_definition", S.matches_any(name, V.TYPE_PATTERNS) | (F.col("s.has_class_defs") & (i > F.col("avg_in")) & (o <= 1)), F.lit(0.80)),
        ("barrel", F.col("s.exports_only") | (name.isin("__init__.py", "index.ts", "index.js") & (o > 3) & (i <= 2)), F.lit(0.82)),
        ("entry_point", entry, entry_conf),
        ("router", F.col("s.has_route_defs"), F.lit(0.85)),
        ("ml_model", ml & F.col("s.has_ml_model_def"), F.lit(0.90)),
        ("ml_training", ml & F.col("s.has_ml_training") & ~F.col("s.has_ml_model_def"), F.lit(0.85)),
        ("ml_pipeline", ml & F.col("s.has_ml_pipeline") & ~F.col("s.has_ml_model_def") & ~F.col("s.has_ml_training"), F.lit(0.82)),
    ]
    made = [F.when(cond, F.struct(conf.cast("double").alias("confidence"), F.lit(-n).alias("n"), F.lit(role).alias("role"))) for n, (role, cond, conf) in enumerate(ladder)]
    made.append(F.when(source & not_entry_leaf & (graph["confidence"] > 0.30), F.struct(graph["confidence"].alias("confidence"), F.lit(-99).alias("n"), graph["role"].alias("role"))))
    made.append(F.struct(F.lit(0.30).alias("confidence"), F.lit(-100).alias("n"), F.lit("leaf").alias("role")))
    best = F.array_max(F.filter(F.array(*made), lambda x: x.isNotNull()))
    return f.withColumn("__best", best).select(*files.columns, "in_degree", "out_degree", F.col("__best.role").alias("role"), F.round("__best.confidence", 2).alias("role_confidence"))


def importance(profiles: DataFrame, terms: tuple[str, ...] = ("loc", "out_degree", "in_degree", "functions")) -> DataFrame:
    """Adds importance = 25 * sum of value / maximum over terms whose maximum is above 0."""
    tops = profiles.agg(*[F.max(F.coalesce(F.col(t), F.lit(0))).alias(f"__max_{t}") for t in terms])
    p = profiles.crossJoin(F.broadcast(tops))  # one row
    parts = [F.when(F.col(f"__max_{t}") > 0, 25.0 * F.coalesce(F.col(t), F.lit(0)) / F.col(f"__max_{t}")).otherwise(0.0) for t in terms]
    return p.withColumn("importance", F.round(sum(parts[1:], parts[0]), 2)).drop(*[f"__max_{t}" for t in terms])


def role_summary(profiles: DataFrame, top: int = 10) -> DataFrame:
    """Files and share per role, commonest first."""
    total = profiles.agg(F.count(F.lit(1)).alias("__all"))
    return profiles.groupBy("role").agg(F.count(F.lit(1)).alias("files")).crossJoin(F.broadcast(total)).select("role", "files", F.round(100.0 * F.col("files") / F.col("__all"), 1).alias("pct")).orderBy(F.desc("files"), "role")


def repo_type(profiles: DataFrame, has_entries: bool = False, by: list[str] | None = None) -> DataFrame:
    """One row with the repository's kind; one for each repository where ``by`` names its columns."""
    by = by or []
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = profiles.groupBy(*by).agg(
        has(F.col("role").isin("ml_model", "ml_training", "ml_pipeline")).alias("ml"),
        has(F.col("role") == "router").alias("router"),
        has((F.col("role") == "entry_point") | F.lit(has_entries)).alias("entry"),
        has((F.col("role") == "build") & F.array_contains("tags", "infrastructure")).alias("docker"),
        has(F.col("role") == "config").alias("config"),
        has(F.lower("extension").isin(V.TEMPLATE_EXTENSIONS)).alias("templates"),
    )
    kind = F.when(F.col("ml"), "ml_pipeline").when(F.col("router") & F.col("templates"), "web_app").when(F.col("router") & (F.col("docker") | F.col("config")), "microservice").when(F.col("router"), "web_app").when(F.col("entry"), "cli_tool").otherwise("library")
    return flags.select(*by, kind.alias("repo_type"))


def selection_score(role: Column, central: Column, entry: Column, in_degree: Column, path: Column) -> Column:
    """W8."""
    low, name = F.lower(path), F.lower(S.basename(path))
    has = lambda c, *words: sum((F.when(c.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    bonus = F.coalesce(S.lookup(V.SELECTION_ROLES, role), F.when(role.isNotNull(), F.lit(0)))
    s = 1.0 + F.coalesce(bonus, F.lit(0)) + F.when(central, 5).otherwise(0) + F.when(entry, 8).otherwise(0) + F.least(1.5 * in_degree, F.lit(7.0))
    s = s + F.when(has(low, "route", "controller", "api"), 4).otherwise(0) + F.when(has(low, "model", "schema"), 3).otherwise(0)
    s = s + F.when(has(name, "readme"), 6).otherwise(0) - F.when(has(name, "test", "spec", "mock"), 3).otherwise(0) - F.when(has(name, "migration", "generated", "vendor", "lock"), 5).otherwise(0)
    return F.round(F.greatest(s, F.lit(0.0)), 2)


def with_membership(profiles: DataFrame, central: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Adds whether a file is among the central ones and the entry points (column file each)."""
    mark = lambda df, name: df.select(F.col("file").alias(key), F.lit(True).alias(name)).distinct()
    return profiles.join(mark(central, "central"), key, "left").join(mark(entries, "entry"), key, "left").na.fill(False, ["central", "entry"])


def budget_select(files: DataFrame, group: str, max_files: int = V.SELECT_FILES, max_tokens: int = V.SELECT_TOKENS) -> DataFrame:
    """Per group, take by score while the token budget lasts, skipping what overflows.

    The first file alone may overflow: it is taken truncated and selection ends.  A fold
    over the group's files in order that holds only what it took.
    ``files``: group, path, score, size, pos.  Returns group, path, tokens, truncated, rank.
    """

    def step(state: dict, row: tuple) -> None:
        path, tokens = row
        took = state["took"]
        if state["over"] or len(took) >= max_files:
            return
        if state["used"] + tokens <= max_tokens:
            state["used"] += tokens
            took.append((path, tokens, False, len(took)))
        elif not took:
            state["over"] = True
            took.append((path, max_tokens, True, 0))

    rows = files.select(group, F.col("path").cast("string").alias("path"), "score", "pos", S.token_estimate(F.col("size")).alias("tokens"))
    return fold(rows, group, [F.desc("score"), F.col("pos")], ["path", "tokens"], lambda: {"used": 0, "over": False, "took": []}, step, lambda s: s["took"], "path string, tokens long, truncated boolean, rank int")
