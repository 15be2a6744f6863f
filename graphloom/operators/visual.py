"""Payload builders: treemap, mindmap, search, DOT and Mermaid exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from .graph import settle


def directory_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes below every folder, one row per folder of every path."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(S.depth(F.col("path")), F.lit(0)))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, F.lit(1), k), "/"))
    return files.where(S.depth(F.col("path")) > 0).select(F.explode(prefixes).alias("dir"), "size").groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def treemap_stats(files: DataFrame, metric: str) -> DataFrame:
    """Totals over all files; least, most and ninth decile over measured ones."""
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.least(F.count(F.lit(1)), F.lit(V.TREEMAP_FILES)).alias("shown"),
        (F.count(F.lit(1)) > V.TREEMAP_FILES).alias("truncated"),
        F.count(metric).alias("measured"),
        F.min(metric).alias("least"),
        F.max(metric).alias("most"),
        F.percentile(metric, 0.9).alias("p90"),
    )


def tree_rows(files: DataFrame, value: str = "size") -> DataFrame:
    """V2 for any number of files: id, parent, name, kind and value of a tree's nodes, the root's id being empty.

    A folder whose one child is a folder goes with it, as ``a/b``; the root stays.  A file's
    value is its size, or 1, and a folder's the sum below it.  ``files``: path, value, of
    different paths.  Folders above a file are listed with it, so the work grows with the
    files times their depth, and no task sees a folder's children.
    """
    parts = F.split("path", "/")
    leaf = files.select("path", F.when(F.coalesce(F.col(value), F.lit(0)) == 0, 1).otherwise(F.col(value)).cast("long").alias("value"))
    chain = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))  # the folders above, from the root
    met = leaf.select("value", chain.alias("above")).select("value", F.posexplode("above").alias("k", "id"), "above")
    folders = met.groupBy("id").agg(F.sum("value").alias("value"), F.first("k").alias("depth"), F.max((F.size("above") - 1 == F.col("k")).cast("int")).alias("files"))
    folders = settle(folders.withColumn("up", F.when(F.col("depth") > 0, F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("id", "/[^/]*$", "")))))
    inner = folders.where("depth > 0").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("inner"))
    folders = settle(folders.join(inner, "id", "left").withColumn("kept", (F.col("depth") == 0) | (F.col("files") > 0) | (F.coalesce("inner", F.lit(0)) != 1)))
    # the nearest folder above that stays
    stays = folders.where("kept")
    over = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.array_join(F.slice(F.split("id", "/"), F.lit(1), k), "/"))
    near = stays.where("depth > 0").select("id", F.explode(over).alias("a")).join(stays.select(F.col("id").alias("a"), F.col("depth").alias("ad")), "a").groupBy("id").agg(F.max_by("a", "ad").alias("parent"))
    named = stays.join(near, "id", "left")
    name = F.when(F.col("id") == "", "root").when(F.col("parent") == "", F.col("id")).otherwise(F.expr("substring(id, length(parent) + 2)"))
    top = named.select("id", "parent", name.alias("name"), F.lit("folder").alias("kind"), "value")
    own = F.when(F.size(parts) == 1, "").otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return top.unionByName(leaf.select(F.col("path").alias("id"), own.alias("parent"), F.element_at(parts, -1).alias("name"), F.lit("file").alias("kind"), "value"))


def treemap(rows: list[dict], most: int = V.TREEMAP_FILES) -> dict:
    """V2: nested tree of the largest files; single-folder chains below the root collapse.

    Built on the driver from at most ``most`` rows (path, size and metrics; a null metric's
    key is left out, zero stays).
    """
    root: dict = {"name": "root", "children": {}}
    for r in sorted(rows, key=lambda r: (-(r.get("size") or 0), r["path"]))[:most]:
        at = root
        *dirs, name = r["path"].split("/")
        for part in dirs:
            at = at["children"].setdefault(part + "/", {"name": part, "children": {}})
        leaf = {"name": name, "path": r["path"], "value": r.get("size") or 1}
        leaf |= {k: r[k] for k in ("loc", "complexity", "language", "complexity_source") if r.get(k) is not None}
        at["children"][name] = leaf

    def close(node: dict, top: bool) -> dict:
        if "children" not in node:
            return node
        kids = [close(c, False) for c in node["children"].values()]
        if not top and len(kids) == 1 and "children" in kids[0]:
            return {"name": f"{node['name']}/{kids[0]['name']}", "children": kids[0]["children"]}
        return {"name": node["name"], "children": kids}

    return close(root, True)


def mindmap(files: DataFrame, group: str, names: int = V.MINDMAP_NAMES) -> DataFrame:
    """Group, number of files and first names; apply it to the first profiles only."""
    w = Window.partitionBy(group).orderBy("name", "id")
    r = files.withColumn("n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= names, F.struct("n", "name"))))
    return r.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("files"), F.array_join(F.transform(first, lambda x: x["name"]), ",").alias("names"))


def node_search(nodes: DataFrame, text: str, label: str, files: str, description: str) -> DataFrame:
    """label 3, files 2, description 1 for containing the text; above 0 only."""
    low = text.lower()
    has = lambda c, points: F.when(F.lower(F.col(c)).contains(low), points).otherwise(0)
    return nodes.withColumn("score", has(label, 3) + has(files, 2) + has(description, 1)).where("score > 0")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K5: one row with the DOT text. ``nodes``: id, group, label (apply after the node cap)."""
    q = lambda c: F.concat(F.lit('"'), S.dot_escape(F.col(c)), F.lit('"'))
    line = F.concat(F.lit("    "), q("id"), F.lit(" [label="), q("label"), F.lit("];"))
    groups = nodes.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    block = F.concat(F.lit("  subgraph "), F.concat(F.lit('"cluster_'), S.dot_escape(F.col("group")), F.lit('"')), F.lit(" {\n"), F.col("body"), F.lit("\n  }"))
    clusters = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", block.alias("b")))), lambda x: x["b"]), "\n").alias("n"))
    arrows = edges.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(";")))), "\n").alias("e"))
    return clusters.crossJoin(F.broadcast(arrows)).select(F.concat(F.lit("digraph dependencies {\n"), F.coalesce("n", F.lit("")), F.lit("\n"), F.coalesce("e", F.lit("")), F.lit("\n}")).alias("dot"))


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """K6: one row with Mermaid text of the ``most`` important nodes and edges among them."""
    top = nodes.orderBy(F.desc("importance"), "id").limit(most)
    named = top.withColumn("alias", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("group", "id")) - 1).cast("string")))
    body = named.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), F.col("alias"), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')))), "\n").alias("n"))
    a, b = named.select(F.col("id").alias("source"), F.col("alias").alias("sa")), named.select(F.col("id").alias("target"), F.col("alias").alias("ta"))
    arrows = edges.select("source", "target").distinct().join(F.broadcast(a), "source").join(F.broadcast(b), "target").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), F.col("sa"), F.lit(" --> "), F.col("ta")))), "\n").alias("e"))
    return body.crossJoin(F.broadcast(arrows)).select(F.concat(F.lit("graph TD\n"), F.coalesce("n", F.lit("")), F.lit("\n"), F.coalesce("e", F.lit(""))).alias("mermaid"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """K4: JSON of a graph already capped by ``ranking.collapsed_graph``."""
    take = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps({"nodes": sorted(take(nodes), key=lambda n: str(n["id"])), "edges": sorted(take(edges), key=lambda e: (str(e["source"]), str(e["target"])))}, separators=(",", ":"))


def export(kind: str, builders: dict[str, Callable[[], str]]) -> str:
    """K8: the text of a known format; only its builder runs, and an unknown format raises."""
    if kind not in builders:
        raise ValueError(f"unknown format {kind}: one of {', '.join(sorted(builders))}")
    return builders[kind]()
