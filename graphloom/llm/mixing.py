"""Operator 2: mixing sources to target weights.

Method: a low-discrepancy source schedule.  Slot i maps the golden-ratio point
frac(i * phi) through the cumulative targets to a source; the k-th slot of a source takes
block k of that source's shuffled word line, blocks being equal in words.  The line repeats
up to ``cap`` times and ends there.  What a document gives is what its blocks in drawn
slots hold: the schedule alone decides, and meets each target to a few blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, range_parts, spread_bits, spread_rank

WORDS = r"[^\x20\x09-\x0D]+"
#: fixed values: the golden ratio's fraction, and that of 2**20 times it
GOLDEN, GOLDEN_20 = "0.6180339887498949D", "0.607787409740351D"
#: words of a block at most, and blocks at least as far as the words go round
BLOCK, SLOTS = 4096, 65536


def row_keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two longs, __ra and __rb, equal for rows equal in id, source and text."""
    columns = [F.col(id_col), F.col(source_col), F.col(text_col)]
    nulls = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *nulls).alias("__ra"), F.xxhash64(F.lit(1), *columns[::-1], *nulls).alias("__rb")]


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds ``target``, and ``__p`` of the order by name, to one row per source (__src, __none, source_size).

    Shares by weight; a source stops at ``cap`` times its size and the excess is shared
    again by weight.  With sources sorted by cap / weight the fixed point is closed: a
    source is capped if and only if the level left by the sources before it exceeds its
    ratio.  Both orders run over ranges of sources, so there may be any number of them.
    """
    name = ["__none", "__src"]
    s = spread_rank(range_parts(sizes, name, "mix-names"), [], "__p", [F.col(c) for c in name], "__k").withColumnRenamed("__p", "__named")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__k") % len(weights) + 1).cast("int"))
    s = s.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(cap)).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = ["__ratio", *name]
    s = range_parts(s, order, "mix-ratios")
    whole = s.agg(F.sum("source_size").cast("double").alias("__total"), F.sum("__w").alias("__all"))
    s = spread_rank(s, [], "__p", [F.col(c) for c in order], "__r", __caps="__cap", __ws="__w").crossJoin(F.broadcast(whole))  # one row
    s = s.withColumn("__level", (F.col("__total") - F.col("__caps")) / (F.col("__all") - F.col("__ws")))
    # the first free source in this order sets the level of all free ones
    free = s.where(F.col("__cap") > F.col("__level") * F.col("__w"))
    s = s.crossJoin(F.broadcast(free.agg(F.min_by("__level", F.struct(*order)).alias("__lambda"))))  # one row
    s = s.withColumn("target", F.when(F.col("__lambda").isNull() | (F.col("__cap") <= F.col("__lambda") * F.col("__w")), F.col("__cap")).otherwise(F.col("__lambda") * F.col("__w")))
    return s.select("__src", "__none", "source_size", "target", F.col("__named").alias("__p"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, __src, __none, rank): which source each slot draws from and its rank there.

    ``sources`` has __src, __none, target and, of ``range_parts``, __p.  Cumulative targets
    are sums of whole words.
    Points find their source by an equi-join on grid cells, as many as the sources need, so
    any number of sources works without a broadcast.
    """
    name = ["__none", "__src"]
    s = sources.select(*name, "__p", F.round("target").cast("long").alias("__want")).where("__want > 0")
    s = spread_rank(s, [], "__p", [F.col(c) for c in name], "__k", __lo="__want")
    total, many = s.agg(F.sum("__want"), F.count(F.lit(1))).first()
    if not total:
        return sources.sparkSession.range(0).select(F.col("id").alias("slot"), F.lit("").alias("__src"), F.lit(False).alias("__none"), F.col("id").alias("rank"))
    cells = 1 << max(12, (4 * many).bit_length())
    s = s.withColumn("__hi", F.col("__lo") + F.col("__want"))
    # a thousandth of a cell on either side keeps roundings from hiding a source
    cell = lambda c, slack: F.least(F.greatest(F.floor(F.col(c) / F.lit(float(total)) * cells + slack), F.lit(0)), F.lit(cells - 1))
    grid = s.select(*name, "__lo", "__hi", F.explode(F.sequence(cell("__lo", -0.001), cell("__hi", 0.001))).alias("__cell"))
    i = sources.sparkSession.range(slots).withColumnRenamed("id", "slot")
    # two exact-enough products, so that the fraction keeps its bits for any number of slots
    i = i.withColumn("__x", F.expr(f"(slot >> 20) * {GOLDEN_20} % 1 + (slot & 1048575) * {GOLDEN} % 1")).withColumn("__x", F.expr("__x % 1"))
    i = i.withColumn("__cell", F.least(F.floor(F.col("__x") * cells), F.lit(cells - 1))).withColumn("__x", F.col("__x") * float(total))
    drawn = i.join(grid, "__cell").where("__x >= __lo and __x < __hi").select("slot", "__src", "__none")
    drawn = drawn.withColumn("__b", F.shiftright("slot", spread_bits(slots)))
    return spread_rank(drawn, ["__src", "__none"], "__b", [F.col("slot")], "rank").select("slot", "__src", "__none", "rank")


def _line(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int | None, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Every row at its place on its source's shuffled line, with the place where the source's drawn blocks end; the drawn slots; words of a slot."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__src"),
        F.col(source_col).isNull().alias("__none"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        *row_keys(id_col, text_col, source_col),
    ).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = materialize(sized, "mix-rows")
    sources = materialize(targets(sized.groupBy("__src", "__none").agg(F.sum("size").alias("source_size")), weights, cap), "mix-sources")
    total = sources.agg(F.sum(F.round("target").cast("long"))).first()[0] or 0
    block = block or max(1, min(BLOCK, total // SLOTS))
    plan = materialize(schedule(sources, -(-total // block)), "mix-plan")
    drawn = plan.groupBy("__src", "__none").agg((F.count(F.lit(1)) * block).alias("__drawn"))
    ends = sources.join(drawn, ["__src", "__none"], "left").withColumn("__end", F.least(F.coalesce("__drawn", F.lit(0)), F.col("source_size") * cap)).drop("__drawn", "__p")
    sources = materialize(ends, "mix-ends")  # written, so that a hot source is a skewed join, which is split
    digits = max(1, spread_bits(sized.count()) // 4)
    sized = sized.withColumn("__b", F.substring("__h", 1, digits))
    line = spread_rank(sized, ["__src", "__none"], "__b", [F.col("__h"), F.col("doc_id"), F.col("size"), F.col("__ra"), F.col("__rb")], "__r", __at="size").join(sources, ["__src", "__none"])
    return line, plan, block


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as pieces: one row per (document, slot) with the words it gives there.

    Columns: doc_id, size, source_size, target, __key (struct, unique per input row), slot,
    words.  Every document has a row; one that gives nothing has slot null and words 0.
    ``block`` is the words of a slot; by default all words over ``SLOTS``, from 1 to ``BLOCK``.
    A null or blank text has size 0; a text of any length is one document that its blocks
    cut.  A null source is a source of its own, sorted last.  Rows with null or repeated ids
    and rows equal in all are separate documents, in any order among themselves.  An empty
    table gives an empty result.  Sources of size 0 have target 0.  Other columns are
    ignored, whatever their names.
    """
    line, plan, block = _line(docs, weights, cap, block, seed, id_col, text_col, source_col)
    # places on the repeated line as far as its blocks are drawn, cut at block borders
    some = (F.col("size") > 0) & (F.col("__at") < F.col("__end"))
    turns = line.withColumn("__turn", F.explode_outer(F.when(some, F.sequence(F.lit(0), F.expr("(__end - __at - 1) div source_size").cast("int")))))
    turns = turns.withColumn("__from", F.col("__at") + F.col("__turn") * F.col("source_size")).withColumn("__to", F.least(F.col("__from") + F.col("size"), F.col("__end")))
    cut = turns.withColumn("rank", F.explode_outer(F.sequence(F.expr(f"__from div {block}"), F.expr(f"(__to - 1) div {block}"))))
    cut = cut.withColumn("__held", F.least(F.col("__to"), (F.col("rank") + 1) * block) - F.greatest(F.col("__from"), F.col("rank") * block))
    out = cut.join(plan, ["__src", "__none", "rank"], "left")
    words = F.when(F.col("slot").isNotNull(), F.col("__held")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", F.struct("__src", "__none", "__r").alias("__key"), "__ra", "__rb", "slot", words.alias("words"))


def mix_taken(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words taken per document: doc_id, size, source_size, target, taken, plus __ra and __rb (row_keys).

    The sum of what ``mix`` has of it, from the document's place and the end of the drawn
    blocks alone: all its repeats are whole but the last, which the end may cut.
    """
    line, _, _ = _line(docs, weights, cap, block, seed, id_col, text_col, source_col)
    whole = F.expr("(__end - __at - 1) div source_size")
    cut = F.least(F.col("size"), F.col("__end") - F.col("__at") - whole * F.col("source_size"))
    some = (F.col("size") > 0) & (F.col("__at") < F.col("__end"))
    return line.select("doc_id", "size", "source_size", "target", F.when(some, whole * F.col("size") + cut).otherwise(0).cast("long").alias("taken"), "__ra", "__rb")
