"""Dataflow diagrams: node kinds, merging a suggested flow, bridging, expansion, highlights and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.scalars import lookup
from . import graph

#: shape of a suggested flow: lists of nodes and edges
FLOW = "struct<nodes:array<struct<id:string,label:string,type:string,kind:string,description:string,source_files:array<string>>>,edges:array<struct<source:string,target:string,label:string,data_type:string>>,repo_type:string>"


def node_kind(label: Column, kind: Column, in_degree: Column, out_degree: Column) -> Column:
    """End for dashboards; an io node starts unless it only receives; a process is an action."""
    io = F.when((F.coalesce(in_degree, F.lit(0)) > 0) & (F.coalesce(out_degree, F.lit(0)) == 0), "end").otherwise("start")
    return F.when(F.lower(F.coalesce(label, F.lit(""))).contains("dashboard"), "end").when(kind == "io", io).when(F.coalesce(kind, F.lit("process")) == "process", "action").otherwise(kind)


def flow_nodes(nodes: DataFrame) -> DataFrame:
    """Fixed projection with defaults. ``nodes``: id, label, type, shape, tier, description, in_degree, out_degree."""
    kind = node_kind(F.col("label"), F.col("type"), F.col("in_degree"), F.col("out_degree"))
    return nodes.select("id", F.coalesce("label", F.col("id").cast("string")).alias("label"), kind.alias("kind"), F.coalesce("shape", lookup(V.STAGE_SHAPES, F.coalesce("type", F.lit("process")))).alias("shape"), F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("description", F.lit("")).alias("description"))


def suggested(flows: DataFrame, column: str = "json", most_nodes: int = V.FLOW_NODES, most_edges: int = V.FLOW_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of suggested flows that hold up, per row key ``flow``.

    The first 15 nodes and 25 edges count; nodes need an id of their own, edges two known
    different ends and are taken once.  A flow without nodes or edges left gives none of
    either (the static one serves then).  ``flows``: flow, ``column`` (JSON text).
    """
    parsed = flows.select("flow", F.from_json(column, FLOW).alias("f"))
    n = parsed.select("flow", F.posexplode(F.slice("f.nodes", 1, most_nodes)).alias("pos", "n")).select("flow", "pos", "n.*").where("coalesce(id, '') <> ''")
    first = n.groupBy("flow", "id").agg(F.min(F.struct("pos", "label", "type", "kind", "description")).alias("n")).select("flow", "id", "n.*")
    kind = F.when(F.col("type").isin(list(V.STAGE_SHAPES)), F.col("type")).otherwise(F.coalesce(lookup(V.OLD_KINDS, F.col("kind")), F.lit("process")))
    nodes = first.select("flow", "pos", "id", F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"), kind.alias("type"), lookup(V.STAGE_SHAPES, kind).alias("shape"), F.coalesce("description", F.lit("")).alias("description"))
    e = parsed.select("flow", F.posexplode(F.slice("f.edges", 1, most_edges)).alias("pos", "e")).select("flow", "pos", "e.*").where("source <> target")
    for end in ("source", "target"):
        e = e.join(nodes.select("flow", F.col("id").alias(end)), ["flow", end], "left_semi")
    data = F.when(F.col("data_type").isin(V.FLOW_DATA), F.col("data_type")).otherwise("internal")
    edges = e.groupBy("flow", "source", "target").agg(F.min(F.struct("pos", "label", data.alias("data_type"))).alias("e")).select("flow", "source", "target", "e.pos", F.coalesce("e.label", F.lit("")).alias("label"), "e.data_type")
    nodes = nodes.join(edges.select("flow").distinct(), "flow", "left_semi")
    return nodes, mark_directions(edges, ["flow"])


def flow_outcomes(flows: DataFrame, column: str = "json") -> DataFrame:
    """V4: per flow whether the suggestion holds, and if not why the static flow serves.

    quota_exceeded where none was allowed, llm_failed where no JSON came, and
    invalid_llm_response where nothing of it holds up.  ``flows``: flow, allowed, ``column``.
    """
    held = suggested(flows, column)[0].select("flow").distinct().withColumn("__held", F.lit(True))
    reason = F.when(~F.coalesce("allowed", F.lit(False)), "quota_exceeded").when(F.try_parse_json(column).isNull(), "llm_failed").when(F.col("__held").isNull(), "invalid_llm_response")
    return flows.join(held, "flow", "left").select("flow", reason.isNull().alias("is_llm_enriched"), reason.alias("fallback_reason"))


def mark_directions(edges: DataFrame, keys: list[str]) -> DataFrame:
    """J11 within ``keys``: an edge whose reverse came before answers it."""
    back = edges.select(*keys, F.col("source").alias("target"), F.col("target").alias("source"), F.col("pos").alias("__p")).groupBy(*keys, "source", "target").agg(F.min("__p").alias("__p"))
    return edges.join(back, [*keys, "source", "target"], "left").withColumn("direction", F.when(F.col("__p") < F.col("pos"), "response").otherwise("request")).drop("__p")


def capped_adjacency(edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """The first edges of a capped report: sources in order, at most ``max_nodes`` of them."""
    first = edges.select("source").distinct().orderBy("source").limit(max_nodes)
    return edges.select("source", "target").distinct().join(F.broadcast(first), "source").orderBy("source", "target").limit(max_edges)  # max_nodes rows


def kinds_shown(nodes: DataFrame, edges: DataFrame, kinds: list[str], edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes with a dimmed mark by kind; an edge of a shown type dims if either end does."""
    n = nodes.withColumn("dim", ~F.col("kind").isin(kinds))
    dim = lambda end: n.select(F.col("id").alias(end), F.col("dim").alias(f"{end}_dim"))
    e = edges.where(F.col("type").isin(edge_types)).join(dim("source"), "source").join(dim("target"), "target")
    return n, e.withColumn("dim", F.col("source_dim") | F.col("target_dim")).drop("source_dim", "target_dim")


def flagged_shown(files: DataFrame, active: list[str]) -> DataFrame:
    """files with any of the active flags; all files where none is active."""
    return files if not active else files.where(F.arrays_overlap("flags", F.array(*[F.lit(x) for x in active])))


def traces(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """G26 for any number of starts (column node): (start, node, way) of all that a start leads to (down) or comes from (up).

    Responses are left out, so that a trace does not run back along its own answers; so is
    the start itself.  One loop for all starts and both ways: a row is a node, a way and a
    word of 64 starts, with a bit for each start that has reached it, and a round passes on
    the bits that are new.  Rounds are as many as the longest trace is deep.
    """
    asked = edges.where("direction is null or direction <> 'response'").select("source", "target").distinct()
    ways = graph.settle(asked.select(F.lit("down").alias("way"), F.col("source").alias("node"), F.col("target").alias("to")).unionByName(asked.select(F.lit("up").alias("way"), F.col("target").alias("node"), F.col("source").alias("to"))))
    numbered = graph.settle(graph.in_order(starts.select("node").distinct(), ["node"]).select("node", (F.col("place") - 1).alias("n")))
    word, bit = F.floor(F.col("n") / 64), F.expr("shiftleft(1L, int(n % 64))")
    key = ["way", "word", "node"]
    first = numbered.select(F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way"), word.alias("word"), "node", bit.alias("had"))
    state = first.groupBy(*key).agg(F.bit_or("had").alias("had")).withColumn("new", F.col("had"))
    while True:
        state = graph.settle(state)
        front = state.where("new <> 0")
        if front.isEmpty():
            break
        come = front.join(ways, ["way", "node"]).groupBy("way", "word", F.col("to").alias("node")).agg(F.bit_or("new").alias("come"))
        had = F.coalesce("had", F.lit(0).cast("long"))
        state = state.drop("new").join(come, key, "full").select(*key, had.bitwiseOR(F.coalesce("come", F.lit(0).cast("long"))).alias("had"), F.coalesce("come", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(had)).alias("new"))
    names = numbered.select(word.alias("word"), (F.col("n") % 64).cast("int").alias("bit"), F.col("node").alias("start"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("had"), i) == 1)
    return state.select(*key, F.explode(set_bits).alias("bit")).join(names, ["word", "bit"]).where("node <> start").select("start", "node", "way")


def highlights(nodes: DataFrame, edges: DataFrame, trace_from=None, search: str = "", hover=None, kinds: list[str] | None = None, selected=None) -> DataFrame:
    """Id and highlight: a trace wins over a search, that over hovering, that over the kind filter and the selection."""
    off = F.lit("off")
    if trace_from is not None:
        met = traces(edges, nodes.where(F.col("id") == trace_from).select(F.col("id").alias("node")))
        up, down = (met.where(F.col("way") == name).select(F.col("node").alias("id"), F.lit(True).alias(name)) for name in ("up", "down"))
        mode = F.when(F.col("id") == trace_from, "select").when(F.col("up"), "trace-up").when(F.col("down"), "trace-down").otherwise("dim")
        return nodes.select("id").join(up, "id", "left").join(down, "id", "left").select("id", mode.alias("highlight"))
    if search.strip():
        low = search.strip().lower()
        return nodes.select("id", F.when(F.lower("label").contains(low), "hover").otherwise("dim").alias("highlight"))
    if hover is not None:
        near = graph.neighbours(edges).where(F.col("node") == hover).select(F.col("other").alias("id"), F.lit(True).alias("near"))
        return nodes.select("id").join(near, "id", "left").select("id", F.when(F.col("near") | (F.col("id") == hover), "hover").otherwise(off).alias("highlight"))
    mode = F.when(F.lit(selected is not None) & (F.col("id") == F.lit(selected)), "select").when(~F.col("kind").isin(kinds) if kinds is not None else F.lit(False), "dim").otherwise(off)
    return nodes.select("id", mode.alias("highlight"))


def edge_highlights(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """An edge dims with either end and shares a trace that both its ends are on."""
    side = lambda end: marked.select(F.col("id").alias(end), F.col("highlight").alias(f"{end}_h"))
    a, b = F.col("source_h"), F.col("target_h")
    mode = F.when((a == "dim") | (b == "dim"), "dim").when((a == b) & a.isin("trace-up", "trace-down"), a).otherwise("off")
    return edges.select("source", "target").distinct().join(side("source"), "source").join(side("target"), "target").select("source", "target", mode.alias("highlight"))


def flow_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G28 of a flow: (id, component) of every node; responses and unknown ends do not connect."""
    kept = edges.where("direction <> 'response' and source <> target")
    for end in ("source", "target"):
        kept = kept.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    c = graph.components(kept).select(F.col("node").alias("id"), "component")
    return nodes.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inferred edges that chain a flow's islands: source, target, label.

    Islands by size, then highest tier, then name, the one with a dashboard last.  An island
    is left at its node of the highest tier without an edge onward, and entered at that of
    the lowest tier without one inward (any, if all have).  ``nodes``: id, label, tier.
    """
    island = flow_components(nodes, edges)
    n = nodes.join(island, "id")
    ends = [edges.where("source <> target").select(F.col(end).alias("id"), F.lit(True).alias(mark)).distinct() for end, mark in (("source", "onward"), ("target", "inward"))]
    n = n.join(ends[0], "id", "left").join(ends[1], "id", "left")
    dashboard = F.max(F.lower("label").contains("dashboard"))
    leave = F.min(F.struct(F.coalesce("onward", F.lit(False)).alias("has"), (-F.col("tier")).alias("t"), "id"))
    enter = F.min(F.struct(F.coalesce("inward", F.lit(False)).alias("has"), F.col("tier").alias("t"), "id"))
    c = n.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("tier").alias("tier"), dashboard.alias("last"), leave.alias("leave"), enter.alias("enter"))
    placed = graph.in_order(c.select("*", F.col("leave.id").alias("out"), F.col("enter.id").alias("into")).drop("leave", "enter"), [F.col("last"), F.desc("size"), F.desc("tier"), F.col("component")])
    nxt = placed.select((F.col("place") - 1).alias("place"), "into")
    return placed.select("place", "out").join(nxt, "place").select(F.col("out").alias("source"), F.col("into").alias("target"), F.lit("continues").alias("label"))


def final_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a way on end the flow, those without a way in start it (data stores stay)."""
    real = edges.where("direction <> 'response'")
    out, into = (real.select(F.col(c).alias("id"), F.lit(True).alias(m)).distinct() for c, m in (("source", "out"), ("target", "into")))
    kind = F.when(F.col("out").isNull(), "end").when(F.col("into").isNull() & (F.col("kind") != "data_store"), "start").otherwise(F.col("kind"))
    return nodes.join(out, "id", "left").join(into, "id", "left").select("id", kind.alias("kind"))


def split_dashboards(nodes: DataFrame) -> DataFrame:
    """A dashboard becomes the flow's entry and its exit."""
    both = F.when(F.lower("label").contains("dashboard"), F.array(F.struct(F.concat("id", F.lit("-entry")).alias("id"), F.lit("start").alias("kind")), F.struct(F.concat("id", F.lit("-exit")).alias("id"), F.lit("end").alias("kind")))).otherwise(F.array(F.struct("id", "kind")))
    return nodes.select(F.explode(both).alias("x")).select("x.*")


def expand_technologies(nodes: DataFrame, expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product nodes of opened stages, and the edges to them.

    ``nodes``: id, tier, technologies (array of id, label, kind, role); ``expanded``: id.
    """
    t = nodes.join(expanded.select("id").distinct(), "id", "left_semi").select("id", "tier", F.explode("technologies").alias("t"))
    name = F.concat("id", F.lit("::tech::"), "t.id")
    made = t.select(name.alias("id"), F.col("t.label").alias("label"), F.col("t.kind").alias("kind"), (F.coalesce("tier", F.lit(0)) + 1).alias("tier"))
    data = F.when(F.col("t.kind") == "data_store", "db").otherwise("internal")
    return made, t.select(F.col("id").alias("source"), name.alias("target"), F.lit("uses").alias("label"), data.alias("data_type"))


def fold_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of layers as edges of the folded nodes that hold them, once per type.

    ``edges``: from_id, to_id, type; ``members``: id, node.
    """
    side = lambda end, name: members.select(F.col("id").alias(end), F.col("node").alias(name))
    return edges.join(side("from_id", "a"), "from_id").join(side("to_id", "b"), "to_id").where("a <> b").select("a", "b", "type").distinct()


def tier_grid(nodes: DataFrame, column: int = 220, row: int = 80) -> DataFrame:
    """A column per tier, nodes below one another by id."""
    n = F.row_number().over(Window.partitionBy("tier").orderBy("id")) - 1
    return nodes.select("id", (F.coalesce("tier", F.lit(0)) * column).cast("long").alias("x"), (n * row).cast("long").alias("y"))


def square_grid(boxes: DataFrame, gap: int = 40) -> DataFrame:
    """ceil(sqrt n) columns of cells as large as the largest box, in order of id."""
    size = boxes.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("columns"), F.max("width").alias("w"), F.max("height").alias("h"))
    n = graph.in_order(boxes, ["id"]).crossJoin(F.broadcast(size)).withColumn("n", F.col("place") - 1)  # one row
    return n.select("id", (F.col("n") % F.col("columns") * (F.col("w") + gap)).cast("long").alias("x"), (F.floor(F.col("n") / F.col("columns")) * (F.col("h") + gap)).cast("long").alias("y"))


def closest_handles(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sides that face each other: the axis with the larger gap between the boxes wins.

    ``boxes``: id, x, y, width, height and parent, whose place adds to the child's.
    """
    up = boxes.select(F.col("id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    b = boxes.join(up, "parent", "left").select("id", (F.col("x") + F.coalesce("px", F.lit(0))).alias("x"), (F.col("y") + F.coalesce("py", F.lit(0))).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    side = lambda end, p: b.select(F.col("id").alias(end), *[F.col(c).alias(f"{p}{c}") for c in "xywh"])
    e = edges.select("source", "target").join(side("source", "a"), "source").join(side("target", "b"), "target")
    dx = (F.col("bx") + F.col("bw") / 2) - (F.col("ax") + F.col("aw") / 2)
    dy = (F.col("by") + F.col("bh") / 2) - (F.col("ay") + F.col("ah") / 2)
    level = F.abs(dx) - (F.col("aw") + F.col("bw")) / 2 >= F.abs(dy) - (F.col("ah") + F.col("bh")) / 2
    out = F.when(level, F.when(dx >= 0, "right").otherwise("left")).otherwise(F.when(dy >= 0, "bottom").otherwise("top"))
    into = F.when(level, F.when(dx >= 0, "left").otherwise("right")).otherwise(F.when(dy >= 0, "top").otherwise("bottom"))
    return e.select("source", "target", out.alias("source_side"), into.alias("target_side"))


def frames(nodes: DataFrame) -> DataFrame:
    """A frame for each kind present."""
    return nodes.select(F.concat(F.lit("category-frame-"), "kind").alias("id"), "kind").distinct()


def edge_ids(edges: DataFrame, order: list[str]) -> DataFrame:
    """E-source-target-n by the edge's place."""
    return graph.in_order(edges, order).select("source", "target", F.concat_ws("-", F.lit("e"), "source", "target", (F.col("place") - 1).cast("string")).alias("id"))
