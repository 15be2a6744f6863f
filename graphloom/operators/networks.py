"""Neural-network layers: parameter counts, widths and structure tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.scalars import lookup

#: fixed values: names of positional arguments per layer type
POSITIONAL = {
    "Conv1d": ["in_channels", "out_channels", "kernel_size", "stride", "padding"], "Conv2d": ["in_channels", "out_channels", "kernel_size", "stride", "padding"],
    "Conv3d": ["in_channels", "out_channels", "kernel_size", "stride", "padding"], "ConvTranspose2d": ["in_channels", "out_channels", "kernel_size", "stride", "padding"],
    "Conv1D": ["filters", "kernel_size", "strides"], "Conv2D": ["filters", "kernel_size", "strides"], "Conv3D": ["filters", "kernel_size", "strides"],
    "MaxPooling2D": ["pool_size", "strides"], "AveragePooling2D": ["pool_size", "strides"], "Linear": ["in_features", "out_features", "bias"],
    "LazyLinear": ["in_features", "out_features", "bias"], "BatchNorm1d": ["num_features"], "BatchNorm2d": ["num_features"], "BatchNorm3d": ["num_features"],
    "MaxPool2d": ["kernel_size", "stride", "padding"], "AvgPool2d": ["kernel_size", "stride", "padding"], "Dropout": ["p"],
    "Embedding": ["num_embeddings", "embedding_dim"], "LSTM": ["input_size", "hidden_size", "num_layers"], "GRU": ["input_size", "hidden_size", "num_layers"],
    "RNN": ["input_size", "hidden_size", "num_layers"], "Dense": ["units"], "LayerNorm": ["normalized_shape"], "GroupNorm": ["num_groups", "num_channels"],
    "MultiheadAttention": ["embed_dim", "num_heads"],
}
ALIASES = {"filters": "out_channels", "strides": "stride", "pool_size": "kernel_size"}
GATES = {"LSTM": 4, "GRU": 3, "RNN": 1}
CONV_DIMS = {"Conv1d": 1, "Conv2d": 2, "Conv3d": 3, "ConvTranspose1d": 1, "ConvTranspose2d": 2, "ConvTranspose3d": 3, "Conv1D": 1, "Conv2D": 2, "Conv3D": 3}


def parameter_count(kind: Column, params: Column) -> Column:
    """Parameters of a layer; null where an argument needed is not a number."""
    num = lambda name: F.try_element_at(params, F.lit(name)).try_cast("bigint")
    has = lambda name: F.map_contains_key(params, name)
    bias = F.when(F.lower(F.try_element_at(params, F.lit("bias"))) == "false", 0).otherwise(1)
    dims = lookup(CONV_DIMS, kind)
    axes = F.filter(F.split(F.regexp_replace(F.coalesce(F.try_element_at(params, F.lit("kernel_size")), F.lit("3")), r"[()\[\]\s]", ""), ","), lambda x: x != "")
    sizes = F.transform(axes, lambda x: x.try_cast("bigint"))
    product = F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, x: a * x)
    volume = F.when(F.size(sizes) == 1, F.pow(F.element_at(sizes, 1), dims).cast("bigint")).otherwise(product)
    groups = F.when(has("groups"), num("groups")).otherwise(F.lit(1))
    ic, oc = num("in_channels"), num("out_channels")
    conv = F.floor(ic * oc * volume / groups).cast("bigint") + oc * bias
    out = F.coalesce(num("out_features"), num("units"))
    e, i, h = num("embed_dim"), num("input_size"), num("hidden_size")
    layers = F.when(has("num_layers"), num("num_layers")).otherwise(F.lit(1))
    ways = F.when(F.lower(F.try_element_at(params, F.lit("bidirectional"))) == "true", 2).otherwise(1)
    shape = F.transform(F.filter(F.split(F.regexp_replace(F.try_element_at(params, F.lit("normalized_shape")), r"[()\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    return (
        F.when(dims.isNotNull(), conv)
        .when(kind.isin("Linear", "LazyLinear", "Dense"), num("in_features") * out + out * bias)
        .when(kind.startswith("BatchNorm"), 2 * num("num_features"))
        .when(kind == "GroupNorm", 2 * num("num_channels"))
        .when(kind == "LayerNorm", 2 * F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x))
        .when(kind == "MultiheadAttention", 4 * e * e + 4 * e * bias)
        .when(kind.isin("Embedding", "EmbeddingBag"), num("num_embeddings") * num("embedding_dim"))
        .when(kind.isin(list(GATES)), layers * lookup(GATES, kind) * (i * h + h * h + h) * ways)
    )


def propagate_widths(layers: DataFrame) -> DataFrame:
    """Fills in_features of width-less dense layers from the layer before, per model.

    ``layers``: model, pos, type, params.  The width at a layer is the last one emitted since
    the last layer that lost it, a window over the model's layers.
    """
    get = lambda n: F.try_element_at("params", F.lit(n))
    out = F.coalesce(get("out_features"), get("units"), get("out_channels"), get("hidden_size"), get("embedding_dim"))
    w = Window.partitionBy("model").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("type").isin("Flatten", "GlobalAveragePooling2D")
    r = layers.withColumn("__since", F.coalesce(F.sum(lost.cast("int")).over(w), F.lit(0))).withColumn("__out", out)
    since = Window.partitionBy("model", "__since").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__width", F.last("__out", ignorenulls=True).over(since))
    fill = F.col("type").isin("Dense", "LazyLinear") & F.coalesce(get("in_features"), get("in_channels")).isNull() & F.col("__width").isNotNull()
    return r.select("model", "pos", "type", F.when(fill, F.map_concat("params", F.create_map(F.lit("in_features"), F.col("__width")))).otherwise(F.col("params")).alias("params"))


def whole_number(text: Column) -> Column:
    """First positive integer of a literal, alone or in a tuple or list; null for anything else."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    return F.when(text.rlike(r"^\s*[(\[]?[-\d\s,]*[)\]]?\s*$"), F.get(F.filter(found, lambda x: x > 0), F.lit(0)))


def stated_width(kind: Column, params: Column) -> Column:
    """The width that a layer's own arguments state."""
    arg = lambda *names: F.coalesce(*(F.try_element_at(params, F.lit(n)) for n in names))
    hidden = F.coalesce(whole_number(arg("hidden_size")), whole_number(arg("input_size")))
    ways = F.when(arg("bidirectional") == "True", 2).otherwise(1)
    named = {"out_channels": V.NN_CONV, "embedding_dim": ["Embedding", "EmbeddingBag"], "embed_dim": ["MultiheadAttention"]}
    out = F.when(kind.isin("Linear", "LazyLinear", "Dense"), whole_number(arg("out_features", "units"))).when(kind.isin(list(GATES)), hidden * ways)
    for name, kinds in named.items():
        out = out.when(kind.isin(kinds), whole_number(arg(name)))
    return out


def shapes(layers: DataFrame, model: list[str]) -> DataFrame:
    """Adds extent (of the map, relative to the input), width and head (a layer behind a map that has ended).

    A map ends at the first flat layer.  Until then its extent is one over the product of all
    strides since the last global pool, which brings it to the least extent.  The width is
    the last one stated since a layer that neither states nor keeps one.
    """
    kind, arg = F.col("type"), lambda n: whole_number(F.try_element_at("params", F.lit(n)))
    upto = Window.partitionBy(*model).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c, w=upto: F.sum(c.cast("int")).over(w)
    pool, whole = kind.isin(V.NN_POOL), kind.isin(V.NN_GLOBAL_POOL)
    by = F.when(pool, F.coalesce(arg("stride"), arg("kernel_size"))).when(kind.isin(V.NN_CONV), arg("stride"))
    stated = stated_width(kind, F.col("params"))
    r = layers.select("*", (count(kind.isin(V.NN_FLAT)) > 0).alias("__flat"), count(whole).alias("__pools"), F.coalesce(by, F.lit(1)).cast("double").alias("__by"), stated.alias("__stated"), count(stated.isNull() & ~kind.isin(V.NN_KEEP_WIDTH)).alias("__lost"))
    since_pool = Window.partitionBy(*model, "__pools").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since_loss = Window.partitionBy(*model, "__lost").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(F.col("__pools") > 0, V.NN_LEAST_EXTENT).otherwise(1.0)
    # a global pool's own stride counts for nothing
    extent = F.when(~F.col("__flat"), F.bround(start / F.product(F.when(whole, 1.0).otherwise(F.col("__by"))).over(since_pool), 6))
    mapped = count(~F.col("__flat") & (pool | whole | kind.isin(V.NN_CONV))) > 0
    return r.select(*layers.columns, extent.alias("extent"), F.last("__stated", ignorenulls=True).over(since_loss).alias("width"), (F.col("__flat") & mapped).alias("head"))


def _log_size(value: Column, low: Column | float, high: Column | float) -> Column:
    """A size between two bounds that grows with the logarithm of a number; the lower one where there is none."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.coalesce(F.least(high, F.greatest(low, low + (high - low) * F.log2(value + 1) / 10)), low)


def blocks(layers: DataFrame, model: list[str]) -> DataFrame:
    """Shapes, and the size of each layer's block: height by the map's extent, thickness by the width.

    Where no map is left the height goes by what the layer states, up to less behind a map.
    """
    low, high, thin, thick = V.NN_BLOCK
    arg = lambda n: F.try_element_at("params", F.lit(n))
    channels = F.map_contains_key("params", "out_channels")
    mapped = F.col("extent").isNotNull()
    tall = low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.log2(F.greatest("extent", F.lit(V.NN_LEAST_EXTENT))) / 6))
    names = ("out_features", "units", "hidden_size", "embedding_dim")
    stated = F.coalesce(*(arg(n) for n in names))
    flat = F.when(~channels & stated.isNotNull(), _log_size(whole_number(stated), low, low + (high - low) * F.when(F.col("head"), V.NN_HEAD).otherwise(1.0))).otherwise(V.NN_UNKNOWN_HEIGHT)
    wide = F.when(channels, whole_number(arg("out_channels"))).when(mapped, F.col("width"))
    r = shapes(layers, model)
    lone = F.col("category") == "pretrained"
    height = F.when(lone, V.NN_UNKNOWN_HEIGHT).when(mapped, tall).otherwise(flat)
    out = r.select(*layers.columns, F.when(~lone, F.col("extent")).alias("extent"), F.when(~lone, F.col("width")).alias("width"), F.bround(height, 1).alias("height"), F.lit(V.NN_DEPTH).alias("depth"), F.bround(F.when(lone, thin).otherwise(_log_size(wide, thin, thick)), 1).alias("thick"))
    return out


def resized_runs(layers: DataFrame, wanted: DataFrame, signature: str = "type") -> DataFrame:
    """Runs of equal layers made as long as wanted (1 to 64), by the places of any of their layers; places are counted anew.

    ``layers``: model, pos, signature; ``wanted``: model, pos, n.  Of several wishes for a run
    that of the first place holds.
    """
    from .ranking import with_island

    w = Window.partitionBy("model").orderBy("pos")
    r = with_island(layers, ["model"], ["pos"], signature)
    first = r.withColumn("__k", F.row_number().over(Window.partitionBy("model", "island").orderBy("pos")))
    asked = r.select("model", "island", "pos").join(wanted.select("model", "pos", "n"), ["model", "pos"]).groupBy("model", "island").agg(F.min(F.struct("pos", "n")).alias("__n")).select("model", "island", F.greatest(F.lit(1), F.least("__n.n", F.lit(V.NN_MOST_REPEATS))).alias("__n"))
    met = first.join(asked, ["model", "island"], "left")
    copies = F.when(F.col("__n").isNull(), 1).when(F.col("__k") == 1, F.col("__n")).otherwise(0)
    out = met.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))))
    return out.withColumn("pos", (F.row_number().over(w.orderBy("pos", "__copy")) - 1).cast("long")).select(*layers.columns)


def dedupe_models(layers: DataFrame) -> DataFrame:
    """Of models equal in name and layers keep the one of the first file."""
    sig = layers.groupBy("path", "model").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "type", F.array_sort(F.map_entries("params")).alias("p")))))).alias("signature"))
    first = sig.groupBy("model", "signature").agg(F.min("path").alias("path"))
    return layers.join(first.select("path", "model"), ["path", "model"], "left_semi")


def candidates(files: DataFrame, imports: DataFrame, key: str = "path") -> DataFrame:
    """Python files and notebooks whose role or any import's first part is of machine learning.

    ``files``: key, path, role; ``imports``: key, raw.
    """
    root = F.split_part(F.regexp_replace("raw", r"^\.+", ""), F.lit("."), F.lit(1))
    ml = imports.where(root.isin(V.NN_FRAMEWORKS)).select(key).distinct().withColumn("__ml", F.lit(True))
    kept = files.where(F.col("path").endswith(".py") | F.col("path").endswith(".ipynb")).join(ml, key, "left")
    return kept.where(F.col("role").isin(V.NN_ROLES) | F.col("__ml")).select(*files.columns)
