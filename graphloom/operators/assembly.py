"""The assembled graph: semantic layers, cards, insights, cycle summary, module and architecture views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from . import graph, ranking, rollup


def layer_pairs(edges: DataFrame, layer_of: DataFrame) -> DataFrame:
    """Distinct import pairs with the layers of both ends; files without a layer drop out.

    ``layer_of``: path, layer.
    """
    pairs = edges.select("source", "target").distinct()
    a, b = (layer_of.select(F.col("path").alias(end), F.col("layer").alias(f"{end}_layer")) for end in ("source", "target"))
    return pairs.join(a, "source").join(b, "target")


def semantic_layers(edges: DataFrame, layer_of: DataFrame) -> DataFrame:
    """Per layer its label (common folder and file count), files and internal import pairs."""
    base = layer_of.groupBy("layer").agg(F.count(F.lit(1)).alias("file_count"))
    inner = layer_pairs(edges, layer_of).where("source_layer = target_layer").groupBy(F.col("source_layer").alias("layer")).agg(F.count(F.lit(1)).alias("internal_edges"))
    files = F.concat(F.col("file_count").cast("string"), F.lit(" files"))
    label = F.concat_ws(" — ", "common_dir", files)
    out = base.join(rollup.common_dir(layer_of, "layer"), "layer", "left").join(inner, "layer", "left").na.fill(0, ["internal_edges"])
    return out.select("layer", label.alias("label"), "file_count", "internal_edges")


def layer_tiers(edges: DataFrame, layer_of: DataFrame) -> DataFrame:
    """Tiers of layers from their distinct, sorted import pairs.

    In-place sweeps in list order on the driver: there are at most as many layers as names.
    """
    pairs = layer_pairs(edges, layer_of).where("source_layer <> target_layer").select("source_layer", "target_layer").distinct()
    found = sorted((r[0], r[1]) for r in pairs.collect())
    names = sorted(r[0] for r in layer_of.select("layer").distinct().collect())
    tier = graph.tiers_sequential(names, found)
    return edges.sparkSession.createDataFrame([(n, tier[n]) for n in names], "layer string, tier int")


def freshness(profiles: DataFrame) -> DataFrame:
    """One row with a fingerprint of all files' path, size, role and degrees; only equality matters.

    A sum of hashes instead of a hash of sorted tokens, so that no task sees all files.
    """
    token = F.concat_ws(":", "path", F.col("size").cast("string"), F.coalesce("role", F.lit("")), F.col("in_degree").cast("string"), F.col("out_degree").cast("string"))
    number = F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("decimal(38,0)")
    return profiles.agg(F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(number).cast("string"))).alias("fingerprint"))


def assembled_files(profiles: DataFrame, layers: DataFrame, buckets: DataFrame) -> DataFrame:
    """File rows with layer, container, flags. ``profiles`` is flagged; ``buckets``: layer, path, bucket."""
    box = buckets.select("path", rollup.container_id("layer").alias("container"))
    return profiles.join(layers, "path", "left").join(box, "path", "left").select("path", "layer", "container", "importance", "in_degree", "out_degree", F.array_join("flags", ",").alias("flags"))


def cycle_summary(cycles: DataFrame) -> DataFrame:
    """has_cycles, cycle_count and a summary text. ``cycles``: path (array of names)."""
    only = F.array_join(F.transform(F.min("path"), lambda x: x.cast("string")), " → ")
    n = F.count(F.lit(1))
    text = F.when(n == 0, "No circular dependencies detected.").when(n == 1, F.concat(F.lit("1 circular dependency detected: "), only)).otherwise(F.concat(n.cast("string"), F.lit(" circular dependencies detected.")))
    return cycles.agg((n > 0).alias("has_cycles"), n.alias("cycle_count"), text.alias("summary"))


def insights(cyclic: DataFrame, flagged: DataFrame, central: DataFrame, entries: DataFrame) -> DataFrame:
    """A26 as rows: kind (cycle, cycle_import, orphan, central, entry_point), component of what is on cycles, place among central files, and the item.

    ``cyclic``: source, target and component of all edges on cycles (``strong.inside``).  A
    row per file and per import, since simple cycles can be too many to list; each of them
    is a round of these imports, and every one of these imports is on one.
    """
    none = F.lit(None).cast("long")
    row = lambda df, kind, item, place=none, component=none: df.select(F.lit(kind).alias("kind"), component.alias("component"), place.alias("place"), item.cast("string").alias("item"))
    ranked = central.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "file")).cast("long"))  # the top thirty
    return (
        row(cyclic.select("component", "source").distinct(), "cycle", F.col("source"), component=F.col("component"))
        .unionByName(row(cyclic, "cycle_import", F.concat_ws(",", F.col("source").cast("string"), F.col("target").cast("string")), component=F.col("component")))
        .unionByName(row(flagged.where(F.array_contains("flags", "orphan")), "orphan", F.col("id")))
        .unionByName(row(ranked, "central", F.col("file"), F.col("n")))
        .unionByName(row(entries, "entry_point", F.col("file")))
    )


def layer_cards(flagged: DataFrame, edges: DataFrame, layer_of: DataFrame) -> DataFrame:
    """Per layer its files, flag counts in display order, outgoing import rows, and card height.

    ``flagged``: path, flags; ``edges``: raw import rows with source and target.
    """
    order = F.array(*[F.lit(x) for x in V.FLAG_ORDER])
    files = layer_of.groupBy("layer").agg(F.count(F.lit(1)).alias("files"))
    flags = flagged.join(layer_of, "path").select("layer", F.explode("flags").alias("flag")).groupBy("layer", "flag").agg(F.count(F.lit(1)).alias("n"))
    shown = flags.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("flag")).alias("at"), "flag", "n"))).alias("all"))
    a, b = (layer_of.select(F.col("path").alias(end), F.col("layer").alias(f"{end}_layer")) for end in ("source", "target"))
    out = edges.join(a, "source").join(b, "target").where("source_layer <> target_layer").groupBy(F.col("source_layer").alias("layer")).agg(F.count(F.lit(1)).alias("out_count"))
    card = files.join(shown, "layer", "left").join(out, "layer", "left").na.fill(0, ["out_count"])
    rows = 1 + F.coalesce(F.size("all"), F.lit(0)) + F.when(F.col("out_count") > 0, 1).otherwise(0)
    text = F.array_join(F.transform(F.coalesce("all", F.array()), lambda x: F.concat(x["flag"], F.lit(":"), x["n"].cast("string"))), ",")
    return card.select("layer", "files", text.alias("flag_counts"), "out_count", (F.lit(V.CARD_CHROME) + F.lit(V.CARD_ROW) * rows).cast("long").alias("height"))


def expanded_box(children: DataFrame, collapsed: tuple[int, int], group: str = "container") -> DataFrame:
    """Box of an opened container: the larger of its closed size and its children's extent plus padding."""
    edge = lambda at, size: F.greatest(F.lit(0), F.max(F.col(at) + F.col(size)))
    return children.groupBy(group).agg(
        F.greatest(F.lit(collapsed[0]), edge("x", "width") + 2 * V.BOX_PADDING).cast("long").alias("width"),
        F.greatest(F.lit(collapsed[1]), edge("y", "height") + V.BOX_HEADER + V.BOX_PADDING).cast("long").alias("height"),
    )


def infer_type(name: Column) -> Column:
    """Kind of a folder by words in its name."""
    low, out = F.lower(name), None
    for kind, pattern in V.FOLDER_KINDS.items():
        test = low.rlike(pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("module")


def module_view(modules: DataFrame, weights: DataFrame) -> DataFrame:
    """One node per module with inferred type, radius and size class."""
    m = modules.join(weights, "module")
    return m.select("module", infer_type(F.col("module")).alias("type"), F.round(S.module_radius(F.col("file_count")), 3).alias("radius"), S.size_class(F.col("in_weight") + F.col("out_weight")).alias("size"))


def drill_in(module: str, members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V9: files of one module and the imports among them. ``members``: id, module."""
    inside = members.where(F.col("module") == module).select(F.col("id").alias("node"))
    return inside, graph.induced(edges, inside)


def mermaid_modules(modules: DataFrame, connections: DataFrame, most: int = 50) -> DataFrame:
    """K7: one row of Mermaid text of the first ``most`` modules by importance; weights above 1 label the arrows."""
    top = modules.orderBy(F.desc("importance"), "module").limit(most)
    named = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("importance"), "module")) - 1).withColumn("alias", F.concat(F.lit("m"), F.col("n").cast("string")))
    line = F.concat(F.lit("    "), "alias", F.lit('["'), "module", F.lit(" ("), F.col("file_count").cast("string"), F.lit(' files)"]'))
    body = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))), lambda r: r["x"]), "\n").alias("nodes"))
    ends = [F.broadcast(named.select(F.col("module").alias(end), F.col("alias").alias(f"{end}_alias"))) for end in ("source", "target")]  # ``most`` rows
    arrow = F.when(F.col("weight") > 1, F.concat(F.lit(' -- "'), F.col("weight").cast("string"), F.lit('" --> '))).otherwise(" --> ")
    drawn = connections.join(ends[0], "source").join(ends[1], "target").select("source", "target", F.concat(F.lit("    "), "source_alias", arrow, "target_alias").alias("x"))
    arrows = drawn.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "x"))), lambda r: r["x"]), "\n").alias("edges"))
    text = F.concat_ws("\n", F.lit("flowchart LR"), F.nullif("nodes", F.lit("")), F.nullif("edges", F.lit("")))
    return body.crossJoin(F.broadcast(arrows)).select(text.alias("mermaid"))  # one row each


def lanes(nodes: DataFrame) -> DataFrame:
    """Distinct layers with their fixed rank, unknown ones last."""
    order = F.array(*[F.lit(x) for x in V.LANE_ORDER])
    layer = F.lower(F.coalesce(F.nullif("type", F.lit("")), F.lit("other")))
    place = F.array_position(order, F.col("lane"))
    return nodes.select(layer.alias("lane")).distinct().withColumn("rank", F.when(place > 0, place - 1).otherwise(99).cast("long"))


def known_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between two known, different ids."""
    k = ids.select("id").distinct()
    inner = edges.where("source <> target").join(k.withColumnRenamed("id", "source"), "source", "left_semi")
    return inner.join(k.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def architecture(nodes: DataFrame) -> DataFrame:
    """V3: file nodes with lane and unambiguous label. ``nodes``: id, role."""
    labels = ranking.disambiguate(nodes.select("id").distinct())
    return nodes.join(labels, "id").select("id", "label", S.node_layer(F.col("role"), F.col("id")).alias("type"))


def folder_fallback(profiles: DataFrame, most: int = 40) -> DataFrame:
    """V3, second fallback: top folders as nodes where no import was resolved (a capped report)."""
    name = S.module(F.col("path"), 1)
    return profiles.select(name.alias("id")).distinct().orderBy("id").limit(most).select("id", S.layer_of_path(F.col("id")).alias("type"))


def diagnostics(edges: DataFrame, files: DataFrame, unresolved: int | Column, supported: list[str]) -> DataFrame:
    """One row: share of imports resolved and the languages present that no extractor reads."""
    n = edges.agg(F.count(F.lit(1)).alias("__resolved"))
    seen = files.agg(F.collect_set("language").alias("__languages"))  # a language each
    lost = F.array_sort(F.array_except("__languages", F.array(*[F.lit(x) for x in [*supported, "Unknown"]])))
    share = rollup.diagnostics(F.col("__resolved"), unresolved if isinstance(unresolved, Column) else F.lit(unresolved))
    return n.crossJoin(F.broadcast(seen)).select(share.alias("resolved_share"), F.array_join(lost, ",").alias("unsupported"))  # one row each


def tile_text(path: Column, language: Column, value: Column, loc: Column, complexity: Column) -> Column:
    """A tile's description; what was not measured says so."""
    number = lambda c: F.format_number(c, 0)
    return F.concat_ws(", ", path, language, F.concat(number(value), F.lit(" bytes")), F.concat(loc.cast("string"), F.lit(" lines")), F.when(complexity.isNull(), "complexity not measured").otherwise(F.concat(F.lit("complexity "), complexity.cast("string"))))


def hotspot_note(value: Column, loc: Column, language: Column, least: Column, most: Column, p90: Column) -> Column:
    """Remark on a tile's complexity against the repository's; null values were not measured."""
    dense = value / loc
    pct = F.floor((value - least) / (most - least) * 100 + 0.5).cast("string")
    kind = F.coalesce(F.concat(language, F.lit(" files")), F.lit("this file type"))
    return (
        F.when(value.isNull(), F.concat(F.lit("Complexity not measured — no parser for "), kind, F.lit(". Area still reflects file size.")))
        .when(most == least, "Only one distinct complexity value in this repository.")
        .when(value >= most, "Highest complexity in the repository.")
        .when(value >= p90, "Top 10% by complexity — a likely maintenance hotspot.")
        .when((loc > 300) & (dense < 0.05), "Long but simple — lots of lines, little branching.")
        .when((loc > 0) & (loc < 120) & (dense > 0.2), "Small but dense — heavy branching packed into few lines.")
        .otherwise(F.concat(F.lit("Around the "), pct, F.lit("th percentile for complexity here.")))
    )
