"""R6, R9 for many questions: nearest vectors by cosine from an index of coarse cells, equal to a full scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import new_folder, settle

#: rows from which the cells' centres are learnt, cells at most, vectors and questions that one task compares at a time
SAMPLE, CELLS, PIECE, BLOCK = 20_000, 1024, 8192, 1024
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    _, power = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -power[:, None])
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sound(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Rows whose vector has a direction (and the dimension): no null, no infinity, not all zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.withColumn(vector, v).where(good if dim is None else good & (F.size(v) == dim))


def centres_of(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Directions that cells gather around: a few rounds of spherical k-means from spread rows."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


class Index:
    """Vectors in a folder per cell; for each cell the number of vectors and the radius around its centre."""

    def __init__(self, vectors: DataFrame, *, key: str = "id", vector: str = "vector", cells: int | None = None) -> None:
        """Centres come from at most ``SAMPLE`` rows, those of the smallest key hashes, and steer cost alone: every row is indexed.

        Rows without a direction, or of another dimension than the first row, are nearest to
        nothing.  Keys that repeat are rows of their own.
        """
        spark = self.spark = vectors.sparkSession
        self.key, self.folder = key, new_folder(spark)
        rows = _sound(vectors.select(key, F.col(vector).alias("v")), "v")
        one = rows.select(F.size("v").alias("n")).first()
        self.dim = one["n"] if one else 0
        rows = rows.where(F.size("v") == self.dim)
        kind = rows.schema[key].dataType.simpleString()
        self.kind = kind
        got = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").collect()
        if not got:
            self.centres, self.count, self.radius = np.zeros((0, self.dim)), np.zeros(0), np.zeros(0)
            return
        x = _unit(np.array([r["v"] for r in got]))
        n = rows.count()
        cells = cells or int(min(CELLS, max(1, np.sqrt(n) / 2)))
        self.centres = centres_of(x, min(cells, len(x)))
        shared = spark.sparkContext.broadcast(self.centres)

        def assign(batches):
            for b in batches:
                x = _unit(_matrix(b.column("v")))
                cos = x @ shared.value.T
                cell = cos.argmax(axis=1)
                far = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(x)), cell], 0))
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], [key, "v", "cell", "far"])

        placed = rows.mapInArrow(assign, f"{key} {kind}, v array<double>, cell int, far double")
        placed.repartition("cell").write.partitionBy("cell").parquet(self.folder)
        about = self.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row per cell
        self.count, self.radius = np.zeros(len(self.centres)), np.zeros(len(self.centres))
        for r in about:
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["far"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}, v array<double>, far double, cell int").parquet(self.folder)

    def needed(self, questions: DataFrame, k: int) -> DataFrame:
        """(question, v, cell): the cells that may hold one of a question's k nearest.

        Those nearest lie within the least distance that is sure to hold k vectors; a cell
        whose centre is further than that and its radius has none of them.
        """
        shared = self.spark.sparkContext.broadcast((self.centres, self.count, self.radius))
        kind = questions.schema["question"].dataType.simpleString()

        def run(batches):
            centres, count, radius = shared.value
            for b in batches:
                x = _unit(_matrix(b.column("v")))
                far = np.sqrt(np.maximum(2 - 2 * (x @ centres.T), 0))
                upper = far + radius
                order = np.argsort(upper, axis=1)
                held = np.cumsum(count[order], axis=1)
                at = np.minimum((held < k).sum(axis=1), len(centres) - 1)
                sure = np.take_along_axis(upper, np.take_along_axis(order, at[:, None], axis=1), axis=1)
                sure = np.where(held[:, -1:] < k, np.inf, sure)
                row, cell = np.nonzero((far - radius <= sure + 1e-6) & (count > 0))
                yield pa.RecordBatch.from_arrays([b.column("question").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32))], ["question", "v", "cell"])

        return questions.mapInArrow(run, f"question {kind}, v array<double>, cell int")

    def search(self, questions: DataFrame, k: int, *, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
        """(question, key, score, place): each question's k nearest rows, ties by key.  ``questions``: question, vector.

        Questions meet a cell's vectors in blocks of both, so tasks are bounded however many
        questions a cell has or vectors it holds; each block pair gives k rows a question.
        Questions without a direction have no rows.
        """
        key, kind = self.key, self.kind
        asked = _sound(questions.select("question", F.col("vector").alias("v")), "v", self.dim)
        q_kind = asked.schema["question"].dataType.simpleString()
        out = f"question {q_kind}, {key} {kind}, score double"
        if not len(self.centres):
            return self.spark.createDataFrame([], f"{out}, place int")
        pairs = settle(self.needed(asked, k))
        met = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
        pieces = F.create_map(*[F.lit(x) for c in range(len(self.centres)) for x in (c, int(-(-self.count[c] // piece)) or 1)])
        blocks = F.create_map(*[F.lit(x) for c in range(len(self.centres)) for x in (c, -(-met.get(c, 0) // block) or 1)])
        # only folders of cells that are asked for are read
        own = self.rows().where(F.col("cell").isin(sorted(met))).withColumn("piece", F.pmod(F.xxhash64(key, "v"), pieces[F.col("cell")]).cast("int"))
        own = own.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
        q = pairs.withColumn("block", F.pmod(F.xxhash64("question", "v"), blocks[F.col("cell")]).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces[F.col("cell")] - 1)))
        both = own.select("cell", "piece", "block", F.lit(None).cast(q_kind).alias("question"), key, "v", F.lit(0).alias("side")).unionByName(q.select("cell", "piece", "block", "question", F.lit(None).cast(kind).alias(key), "v", F.lit(1).alias("side")))

        def compare(group: pa.Table) -> pa.Table:
            group = group.sort_by([("side", "ascending"), (key, "ascending")])
            split = int(np.searchsorted(group.column("side").to_numpy(), 1))
            x = _matrix(group.column("v").combine_chunks())
            x, y = _unit(x[:split]) if split else x[:0], _unit(x[split:]) if split < len(x) else x[:0]
            rows, asks = [], []
            for j in range(len(y) if len(x) else 0):
                s = x @ y[j]
                least = np.partition(s, -k)[-k] if len(s) > k else -2.0
                near = np.flatnonzero(s >= least - SLACK)
                # judged one by one, so that equal vectors score alike wherever they stand
                exact = np.einsum("nd,d->n", x[near], y[j])
                best = near[np.lexsort((near, -exact))][:k]  # rows are in order of keys
                rows += best.tolist()
                asks += [split + j] * len(best)
            scores = np.array([float(np.einsum("d,d->", x[i], y[j - split])) for i, j in zip(rows, asks, strict=True)], float)
            return pa.table({"question": group.column("question").take(pa.array(asks, pa.int64())), key: group.column(key).take(pa.array(rows, pa.int64())), "score": pa.array(scores)})

        found = both.groupBy("cell", "piece", "block").applyInArrow(compare, out)
        w = Window.partitionBy("question").orderBy(F.desc("score"), key)
        return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
