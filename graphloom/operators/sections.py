"""Report sections, explanations and prompts: validation, fallbacks, skip rules and facts as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S

SECTION = "struct<title:string,content:string,code_snippets:array<string>,visualization_type:string,visualization_data:struct<nodes:array<struct<id:string,type:string>>,edges:array<struct<source:string,target:string,type:string>>>>"


def strip_fence(text: Column) -> Column:
    """The body of a fenced answer."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\s*", ""), r"\s*```$", ""))


def sections(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers (JSON text, fenced or not) as clean sections.

    Strings are trimmed, missing lists are empty, a blank view type is null, node and edge
    types are normalised, and ``failed`` marks sections without content, as are all that do
    not parse.  Other columns stay.
    """
    s = F.from_json(strip_fence(F.col(column)), SECTION)
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    viz = F.col("__s.visualization_data")
    nodes = F.transform(viz["nodes"], lambda n: F.struct(n["id"].alias("id"), F.when(n["type"].isNotNull(), S.node_type(n["type"])).alias("type")))
    edges = F.transform(viz["edges"], lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.when(e["type"].isNotNull(), S.edge_type(e["type"])).alias("type")))
    out = answers.withColumn("__s", s)
    content = clean(F.col("__s.content"))
    return out.select(
        *[F.col(c) for c in answers.columns if c != column],
        clean(F.col("__s.title")).alias("title"),
        content.alias("content"),
        F.coalesce("__s.code_snippets", F.array().cast("array<string>")).alias("code_snippets"),
        F.nullif(clean(F.col("__s.visualization_type")), F.lit("")).alias("visualization_type"),
        F.when(viz.isNotNull(), F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("visualization_data"),
        (content == "").alias("failed"),
    )


def failure(status: Column, timed_out: Column) -> Column:
    """struct(title, action) for a failed request; a null status never reached the server."""
    kinds = [
        (timed_out, "This is taking too long", "retry"),
        (status.isNull(), "Can't reach the server", "retry"),
        (status == 202, "Still analyzing this repository", "retry"),
        (status.isin(401, 403), "Sign in to continue", "sign-in"),
        (status == 404, "This analysis has expired", "reanalyze"),
        (status == 429, "Too many requests", "retry"),
        (status == 402, "Quota exhausted", "none"),
        (status >= 500, "The server had a problem", "retry"),
    ]
    out = None
    for test, title, action in kinds:
        row = F.struct(F.lit(title).alias("title"), F.lit(action).alias("action"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out.otherwise(F.struct(F.lit("We couldn't build this view").alias("title"), F.lit("none").alias("action")))


def kind_label(path: Column) -> Column:
    """Upper-case extension, FILE without one (a leading dot makes none)."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(S.basename(path), r"^.+\.([^.]*)$", 1)), F.lit("")), F.lit("FILE"))


def folder_label(path: Column) -> Column:
    """The folder, root without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("root")


def step_key(nodes: Column, layer: Column) -> Column:
    """A step's files, else its layer."""
    return F.coalesce(F.nullif(F.array_join(nodes, ","), F.lit("")), layer, F.lit(""))


def question_key(nodes: Column, layer: Column, n: Column) -> Column:
    return F.concat(step_key(nodes, layer), F.lit("::q"), n.cast("string"))


def explainable(files: DataFrame, least: float = 10.0) -> DataFrame:
    """files of an explainable kind with enough importance."""
    return files.where(F.lower("extension").isin(V.EXPLAINED_EXTENSIONS) & (F.coalesce("importance", F.lit(0.0)) >= least))


def explain_status(extension: Column, content: Column) -> Column:
    """Why a file is not explained; null if it is."""
    return F.when(~F.lower(extension).isin(V.EXPLAINED_EXTENSIONS), "not_source").when(content.isNull(), "unreadable").when(F.trim(content) == "", "empty")


def whole_source(content: Column, size: Column) -> Column:
    """L3: the content if it was read or may be; null beyond the limit."""
    return F.when(size <= V.MAX_FILE_BYTES, content)


def selected_content(files: DataFrame, selected: DataFrame, chars: int = V.SELECTED_CHARS) -> DataFrame:
    """The first characters of selected files. ``files``: path, content; ``selected``: path."""
    return files.join(selected.select("path").distinct(), "path", "left_semi").select("path", F.substring("content", 1, chars).alias("content"))


def file_prompt(path: Column, role: Column, imports: Column, content: Column) -> Column:
    """U4: prompt for one file from its facts; the text is cut in the middle."""
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Role: "), role), F.concat(F.lit("Imports: "), F.coalesce(F.nullif(F.array_join(F.slice(imports, 1, V.PROMPT_ITEMS), ", "), F.lit("")), F.lit("none"))), S.middle_cut(content, V.SELECTED_CHARS))


def complete(prompts: DataFrame, model: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """Adds answer, tokens and error, calling ``model`` on each prompt of a batch; a failing call fails alone."""
    columns = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers, errors = [], []
            for text in pdf[column]:
                try:
                    answers.append(model(text))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(type(e).__name__)
            yield pdf[columns].assign(answer=answers, error=errors)

    from pyspark.sql import types as T

    out = prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))
    return out.withColumn("tokens", S.token_estimate(F.length(F.col(column)) + F.coalesce(F.length("answer"), F.lit(0))))


def explain_stats(calls: DataFrame) -> DataFrame:
    """One row: files explained, tokens, milliseconds and errors."""
    return calls.agg(F.count_if(F.col("error").isNull()).alias("files"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def complexity_tiles(files: DataFrame, most: int = V.TILES) -> DataFrame:
    """V7: the first tiles in scan order, a missing or zero complexity as 1 (a capped report)."""
    return files.orderBy("pos").limit(most).select("path", F.coalesce(F.nullif("complexity", F.lit(0)), F.lit(1)).alias("value"))


def extension_languages(files: DataFrame) -> DataFrame:
    """Files per language by extension alone; unmapped ones drop out."""
    lang = S.lookup(V.EXTENSION_LANGUAGES, F.lower(S.extension(F.col("path"))))
    return files.select(lang.alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def module_inputs(modules: DataFrame, connections: DataFrame, most: int = V.PROMPT_ITEMS) -> DataFrame:
    """Per module its heaviest connections in and out, as text for a prompt.

    Every module keeps its ``most`` first; ranks run inside a module's connections.
    """

    def side(key: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("weight"), other)
        top = connections.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        line = F.concat(F.col(other), F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))
        return top.groupBy(F.col(key).alias("module")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))), lambda r: r["x"]), ", ").alias(name))

    return modules.select("module").join(side("target", "source", "used_by"), "module", "left").join(side("source", "target", "uses"), "module", "left").na.fill("none", ["used_by", "uses"])


def prompt_facts(edges: DataFrame, central: DataFrame, profiles: DataFrame, roles: DataFrame) -> DataFrame:
    """Numbered fact lines: import total, five central files, ten important ones, role counts."""
    n = edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("block"), F.lit(0).alias("place"), F.concat(F.lit("imports: "), F.col("n").cast("string")).alias("fact"))

    def top(df: DataFrame, block: int, order: list, text: Column, most: int) -> DataFrame:
        rows = df.orderBy(*order).limit(most)
        return rows.select(F.lit(block).alias("block"), F.row_number().over(Window.orderBy(*order)).alias("place"), text.alias("fact"))

    out = n.unionByName(top(central, 1, [F.desc("score"), F.col("file")], F.concat(F.lit("central: "), F.col("file").cast("string")), 5))
    out = out.unionByName(top(profiles, 2, [F.desc("importance"), F.col("id")], F.concat(F.lit("important: "), F.col("id").cast("string")), 10))
    return out.unionByName(top(roles, 3, [F.desc("files"), F.col("role")], F.concat("role", F.lit(": "), F.col("files").cast("string")), 30))


def context(hits: DataFrame, chars: int = V.SELECTED_CHARS) -> DataFrame:
    """Per question the hits as numbered blocks in order of score, and their sources.

    ``hits``: question, file_path, start_line, score, text.
    """
    head = F.concat(F.lit("### "), "file_path", F.lit(" (line "), F.col("start_line").cast("string"), F.lit(")"))
    block = F.concat_ws("\n", head, S.numbered(F.substring("text", 1, chars), F.col("start_line")))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_path", "start_line", block.alias("b"))))
    g = hits.groupBy("question").agg(rows.alias("all"))
    return g.select("question", F.array_join(F.transform("all", lambda x: x["b"]), "\n\n").alias("context"), F.array_distinct(F.transform("all", lambda x: x["file_path"])).alias("sources"))


def progress(batch: Column, batches: int, low: int, high: int) -> Column:
    """Per cent after a batch, spread evenly between two marks."""
    return (F.lit(low) + F.floor(batch * (high - low) / batches)).cast("int")
