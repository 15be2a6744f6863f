"""Degrees, central files, topological roles and entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.scalars import basename


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (source, target): adjacency as a set."""
    return edges.select("source", "target").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """A2: (file, in_degree, out_degree) over distinct neighbours, for nodes with an edge.

    One aggregation over both directions: pairs are made distinct once (map-side combined)
    and counted per end, so no outer join is needed.
    """
    pairs = neighbour_pairs(edges)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("file").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_role(i: Column, o: Column) -> Column:
    """G2."""
    return F.when((i == 0) & (o > 0), "entry_point").when((o == 0) & (i > 0), "leaf_utility").when((i >= 3) & (o >= 1), "core_module").when(i > o, "utility").when(o > i, "orchestrator").otherwise("connector")


def central_files(edges: DataFrame, top: int = V.CENTRAL_TOP) -> DataFrame:
    """Most central files by 3 * in + out, ties by name (a top-k report)."""
    d = degrees(edges).withColumn("score", 3 * F.col("in_degree") + F.col("out_degree"))
    return d.orderBy(F.desc("score"), "file").limit(top).withColumn("role", degree_role(F.col("in_degree"), F.col("out_degree")))


def edge_stats(imports: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """A3: one row of edge totals; a resolved import of another tracked file is an edge."""
    tracked = files.select(F.col(key).alias("__k")).distinct()
    met = imports.join(tracked, F.col("target") == F.col("__k"), "left")
    edge = F.col("__k").isNotNull() & (F.col("source") != F.col("target"))
    return met.agg(F.count_if(edge).alias("total_edges"), F.count_if(edge).alias("resolved_edges"), F.count_if(~F.coalesce(edge, F.lit(False))).alias("unresolved_count"))


def unresolved_reason(raw: Column, resolved: Column, source: Column, tracked: Column) -> Column:
    """Why an import made no edge; null if it made one."""
    return (
        F.when(resolved.isNotNull() & (resolved == source), "self_import")
        .when(resolved.isNotNull() & tracked, F.lit(None).cast("string"))
        .when(resolved.isNotNull(), "resolved_but_not_tracked")
        .when(raw.startswith(".") | raw.startswith("/"), "local_path_not_found")
        .when(raw.startswith("@/") | raw.startswith("~/") | raw.startswith("#"), "path_alias_unresolved")
        .otherwise("external_or_unmapped_package")
    )


def to_edges(imports: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Imports whose target is tracked and not the source itself."""
    tracked = files.select(F.col(key).alias("target")).distinct()
    return imports.join(tracked, "target", "left_semi").where("source <> target").select(*imports.columns)


def entry_points(files: DataFrame, deg: DataFrame, least: int = 3) -> DataFrame:
    """Files scoring at least ``least``, with reasons and signals.

    ``files`` has path, name, extension, depth, content (null where not read).
    """
    source = F.lower("extension").isin(V.SOURCE_EXTENSIONS)
    head = F.when(source, F.substring(F.coalesce("content", F.lit("")), 1, 4096)).otherwise("")
    served = F.col("head").rlike(r"app\.listen\s*\(|createServer\s*\(")
    framework = F.col("head").rlike(r"\.run\s*\(") & F.col("head").rlike("Flask|FastAPI|uvicorn")
    rules = [
        (F.col("name").isin(V.ENTRY_NAMES), 3, "entry_point_name", None),
        (F.col("name").isin(V.PROJECT_FILES), 1, "config_file", None),
        (F.col("head").contains("if __name__") & F.col("head").contains("__main__"), 4, "has_main_guard", "main_guard"),
        (F.col("head").rlike(r"def\s+main\s*\("), 2, "has_main_function", "main_fn"),
        (F.col("head").rlike(r"func\s+main\s*\("), 4, "has_main_function", "main_fn"),
        (F.col("head").rlike(r"public\s+static\s+void\s+main"), 4, "has_main_method", "main_fn"),
        (served, 3, "starts_server", "starts_server"),
        (framework, 3, "starts_server", "starts_server"),
        (F.col("head").rlike("React|useState|useEffect|Component"), 0, None, "is_react"),
        ((F.col("out_degree") > 0) & (F.col("in_degree") == 0), 2, "graph_source_node", None),
        ((F.col("depth") == 0) & source, 1, "root_level", None),
    ]
    f = files.join(deg.withColumnRenamed("file", "path"), "path", "left").na.fill(0, ["in_degree", "out_degree"]).withColumn("head", head)
    score = sum((F.when(c, points).otherwise(0) for c, points, _, _ in rules), F.lit(0))
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, _, r, _ in rules if r]), lambda x: x.isNotNull())
    signals = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(s)) for c, _, _, s in rules if s]), lambda x: x.isNotNull())))
    out = f.select(F.col("path").alias("file"), score.alias("score"), reasons.alias("reasons"), signals.alias("signals"))
    return out.where(F.col("score") >= least).orderBy(F.desc("score"), "file")


def topology_score(i: Column, o: Column, path: Column) -> Column:
    """G3 without content: name, graph and depth terms."""
    name = basename(path)
    return F.when(name.isin(V.ENTRY_NAMES), 3).otherwise(0) + F.when((o > 0) & (i == 0), 2).otherwise(0) + F.when(~path.contains("/"), 1).otherwise(0)


def repo_averages(files: DataFrame, deg: DataFrame) -> DataFrame:
    """A4: one row of maxima (at least 1) and means of degrees over all files."""
    d = files.select(F.col("path").alias("file")).join(deg, "file", "left").na.fill(0, ["in_degree", "out_degree"])
    return d.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("max_in"), F.greatest(F.max("out_degree"), F.lit(1)).alias("max_out"), F.avg("in_degree").alias("avg_in"), F.avg("out_degree").alias("avg_out"))
