"""Roll-ups of files and edges to modules, layers, containers and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S


def modules(files: DataFrame, edges: DataFrame, module_of: Column, source_module: Column, target_module: Column) -> DataFrame:
    """Per module, file and language counts, mean importance, internal edges."""
    f = files.withColumn("module", module_of)
    base = f.groupBy("module").agg(F.count(F.lit(1)).alias("file_count"), F.countDistinct("language").alias("languages"), F.round(F.sum(F.round(F.col("importance") * 100).cast("long")) / (F.count(F.lit(1)) * 100), 2).alias("importance"))
    inner = edges.withColumn("module", source_module).where(F.col("module") == target_module).groupBy("module").agg(F.count(F.lit(1)).alias("internal_edges"))
    return base.join(inner, "module", "left").na.fill(0, ["internal_edges"])


def counts_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Counts per value as an array of structs, commonest first, ties by value."""
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("value")))), lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n"))).alias(name))


def module_connections(edges: DataFrame, source_module: Column, target_module: Column) -> DataFrame:
    """Raw edges between different modules."""
    return edges.select(source_module.alias("source"), target_module.alias("target")).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def module_weights(module_list: DataFrame, connections: DataFrame) -> DataFrame:
    """Incoming and outgoing weight of every module."""
    both = connections.select(F.explode(F.array(F.struct(F.col("source").alias("module"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")), F.struct(F.col("target").alias("module"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")))).alias("e")).select("e.*")
    w = both.groupBy("module").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"))
    return module_list.join(w, "module", "left").na.fill(0, ["in_weight", "out_weight"])


def edge_levels(edges: DataFrame, dim: DataFrame) -> DataFrame:
    """Edge counts at file, container and layer level; same-key pairs go per level.

    ``dim``: file, container, layer.  Counts of the coarser levels sum the file counts, and
    both come from the same file-level aggregate.
    """
    files = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    d1 = dim.select(F.col("file").alias("source"), F.col("container").alias("sc"), F.col("layer").alias("sl"))
    d2 = dim.select(F.col("file").alias("target"), F.col("container").alias("tc"), F.col("layer").alias("tl"))
    j = files.join(d1, "source").join(d2, "target")
    level = lambda name, s, t: j.select(F.lit(name).alias("level"), F.col(s).cast("string").alias("source"), F.col(t).cast("string").alias("target"), "n").where("source <> target")
    every = level("file", "source", "target").unionByName(level("container", "sc", "tc")).unionByName(level("layer", "sl", "tl"))
    return every.groupBy("level", "source", "target").agg(F.sum("n").alias("n"))


def layer_connections(edges: DataFrame, source_layer: Column, target_layer: Column) -> DataFrame:
    """A10: distinct adjacency pairs between different layers."""
    pairs = edges.select("source", "target", source_layer.alias("sl"), target_layer.alias("tl")).where(F.col("sl").isNotNull() & F.col("tl").isNotNull() & (F.col("sl") != F.col("tl"))).distinct()
    return pairs.groupBy(F.col("sl").alias("source"), F.col("tl").alias("target")).agg(F.count(F.lit(1)).alias("pairs"))


def modal_importer_layer(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """The commonest layer among distinct importers of a file, ties by name."""
    pairs = edges.select("source", "target").distinct().join(layers.withColumnRenamed("file", "source"), "source")
    counts = pairs.groupBy("target", "layer").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("target").agg(F.min(F.struct((-F.col("n")).alias("m"), "layer")).alias("x")).select(F.col("target").alias("file"), F.col("x.layer").alias("layer"), (-F.col("x.m")).alias("importers"))


def assign_layers(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer by role; leaf and barrel files take the modal layer of importers with a layer of their own."""
    p = profiles.select("path", "role").withColumn("static", F.when(F.col("role") == "documentation", "documentation").when(F.col("role").isin("leaf", "barrel"), F.lit(None)).otherwise(S.lookup(V.ROLE_LAYERS, F.col("role"))))
    modal = modal_importer_layer(edges, p.where("static is not null").select(F.col("path").alias("file"), F.col("static").alias("layer")))
    return p.join(modal.select(F.col("file").alias("path"), F.col("layer").alias("by_use")), "path", "left").select("path", F.coalesce("static", "by_use", F.lit("other")).alias("layer"))


def common_dir(paths: DataFrame, group: str) -> DataFrame:
    """Longest common folder of a group's files in folders; null without one.

    Least and greatest folder path of a group share exactly the group's common prefix.
    """
    d = paths.where(F.col("path").contains("/")).select(group, F.slice(F.split("path", "/"), 1, S.depth(F.col("path"))).alias("d"))
    ends = d.groupBy(group).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("a"))
    return ends.select(group, F.nullif(F.array_join(F.slice("a", 1, n.cast("int")), "/"), F.lit("")).alias("common_dir"))


def folder_buckets(files: DataFrame, group: str = "layer") -> DataFrame:
    """(group, path, bucket): first folder after the group's common folder.

    Files at that folder itself go to a bucket named after it, or ``root``; '-files' is
    appended while the name clashes with a folder's.
    """
    flat = files.groupBy(group).agg(F.max(~F.col("path").contains("/")).alias("__flat"))
    pre = files.join(flat.join(common_dir(files, group), group, "left").select(group, F.when(F.col("__flat"), "").otherwise(F.coalesce("common_dir", F.lit(""))).alias("pre")), group)
    rest = F.when(F.col("pre") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("pre") + 2, F.length("path")))
    b = pre.withColumn("__rest", rest).withColumn("__folder", F.when(F.col("__rest").contains("/"), F.split_part("__rest", F.lit("/"), F.lit(1))))
    home = F.when(F.col("pre") == "", "root").otherwise(S.basename(F.col("pre")))
    # of a group's folders only those that the home's name could clash with are gathered
    alike = b.where(F.col("__folder").startswith(home) & F.replace(F.substring(F.col("__folder"), F.length(home) + 1, F.length("__folder")), F.lit("-files"), F.lit("")).eqNullSafe(F.lit("")))
    names = alike.groupBy(group).agg(F.collect_set("__folder").alias("__names"))
    b = b.join(names, group, "left").withColumn("__names", F.coalesce("__names", F.array().cast("array<string>")))
    options = F.transform(F.sequence(F.lit(0), F.size("__names")), lambda i: F.concat(home, F.array_join(F.array_repeat(F.lit("-files"), i), "")))
    b = b.withColumn("__home", F.element_at(F.array_except(options, F.col("__names")), 1))
    return b.select(*files.columns, F.coalesce("__folder", "__home").alias("bucket"))


def needs_communities(buckets: DataFrame, group: str = "layer") -> DataFrame:
    """Groups with fewer than two buckets or one above 70 % of files."""
    c = buckets.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return c.select(group, ((F.col("k") < 2) | (F.col("top") > V.FALLBACK_SHARE * F.col("all"))).alias("fallback"))


def merge_singles(buckets: DataFrame, group: str = "layer") -> DataFrame:
    """In groups of three files or more, one-file buckets become ``standalone``."""
    one = F.count(F.lit(1)).over(Window.partitionBy(group, "bucket")) == 1
    enough = F.count(F.lit(1)).over(Window.partitionBy(group)) >= V.STANDALONE_FROM
    return buckets.withColumn("bucket", F.when(one & enough, "standalone").otherwise(F.col("bucket")))


def container_id(group: str) -> Column:
    """layer__slug."""
    return F.concat(F.col(group), F.lit("__"), S.slug(F.col("bucket")))


def containers(buckets: DataFrame, group: str = "layer") -> DataFrame:
    """Containers with id layer__slug and number of files, by id."""
    return buckets.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("files")).select(container_id(group).alias("id"), group, F.col("bucket").alias("name"), "files").orderBy("id")


def container_files(buckets: DataFrame, group: str = "layer") -> DataFrame:
    """The files of each container, a row each."""
    return buckets.select(container_id(group).alias("id"), "path")


def stages(profiles: DataFrame) -> DataFrame:
    """Conceptual stages of roles that have one: tier, kind, shape, file count."""
    tier = S.lookup({k: v[0] for k, v in V.ROLE_STAGES.items()}, F.col("role"))
    kind = S.lookup({k: v[1] for k, v in V.ROLE_STAGES.items()}, F.col("role"))
    p = profiles.withColumn("tier", tier).withColumn("kind", kind).where("tier is not null")
    return p.groupBy("role", "tier", "kind").agg(F.count(F.lit(1)).alias("files")).withColumn("shape", S.lookup(V.STAGE_SHAPES, F.col("kind")))


def stage_edges(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct import pairs between different stage roles."""
    known = roles.where(F.col("role").isin(list(V.ROLE_STAGES)))
    pairs = edges.select("source", "target").distinct().join(known.select(F.col("path").alias("source"), F.col("role").alias("sr")), "source").join(known.select(F.col("path").alias("target"), F.col("role").alias("tr")), "target")
    return pairs.where("sr <> tr").groupBy(F.col("sr").alias("source"), F.col("tr").alias("target")).agg(F.count(F.lit(1)).alias("imports"))


def mark_responses(stage_edge_list: DataFrame) -> DataFrame:
    """Of a mutual pair the later edge is a response. Needs pos."""
    back = stage_edge_list.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("pos").alias("__p"))
    first = back.groupBy("source", "target").agg(F.min("__p").alias("__p"))
    return stage_edge_list.join(first, ["source", "target"], "left").withColumn("direction", F.when(F.col("__p") < F.col("pos"), "response").otherwise("request")).drop("__p")


def technologies(texts: DataFrame, text: str, rules: list[tuple[str, str]] = V.TECHNOLOGY_RULES) -> DataFrame:
    """Adds the label of the first rule whose needle is inside the text; null without one.

    The rules are a literal list, so the theta join is an expression in the scan's stage.
    """
    low = F.lower(F.col(text))
    made = F.when(low.contains(rules[0][0]), rules[0][1])
    for needle, label in rules[1:]:
        made = made.when(low.contains(needle), label)
    return texts.withColumn("technology", made)


def stage_technologies(imports: DataFrame, roles: DataFrame, rules: list[tuple[str, str]] = V.TECHNOLOGY_RULES, most: int = V.STAGE_TECHNOLOGIES) -> DataFrame:
    """Per stage role its first technologies by name. ``imports``: path, raw; ``roles``: path, role."""
    staged = roles.where(F.col("role").isin(list(V.ROLE_STAGES)))
    met = technologies(imports.join(staged, "path"), "raw", rules).where("technology is not null")
    return met.groupBy("role").agg(F.array_join(F.slice(F.array_sort(F.collect_set("technology")), 1, most), ",").alias("technologies"))  # as many as rules


def language_counts(files: DataFrame) -> DataFrame:
    """A1."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")


def diagnostics(edges_total: Column, unresolved: Column) -> Column:
    """Share of imports resolved, 1 without any."""
    return F.when(edges_total + unresolved == 0, 1.0).otherwise(F.round(edges_total / (edges_total + unresolved), 3))
