"""Chunking and exact cosine retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import ranking


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine of a vector column with a literal query, in double precision on the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(v, v)) * F.lit(float(sum(x * x for x in query)) ** 0.5)
    return dot(v, q) / norm


def cosine_topk(chunks: DataFrame, query: list[float], k: int = V.TOP_K, exclude_layers: list[str] | None = None, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The k nearest chunks (a top-k report); predicates reach the scan before any product."""
    c = chunks if not exclude_layers else chunks.where(~F.col("layer").isin(exclude_layers))
    return c.withColumn("score", cosine(F.col(vector), query)).drop(vector).orderBy(F.desc("score"), tie).limit(k)


def search(chunks: DataFrame, question: str, query: list[float]) -> DataFrame:
    """Technical questions get 8 hits outside the excluded layers, others 5."""
    technical = any(k in question.lower() for k in V.TECHNICAL_KEYWORDS)
    hits = cosine_topk(chunks, query, V.TOP_K_TECHNICAL if technical else V.TOP_K, V.EXCLUDED_LAYERS if technical else None)
    return ranking.best_hits(hits, ["file_path", "start_line", "end_line"])


def split_text(text: str, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Recursive character splitting: the first separator present cuts, long parts split on with
    the next ones, and neighbouring parts join up to ``size`` with ``overlap`` carried over."""
    sep, rest = "", ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        cut = text.split(sep)
        parts = [cut[0], *(sep + p for p in cut[1:])]
    else:
        parts = list(text)
    parts = [p for p in parts if p]
    out: list[str] = []
    ready: list[str] = []

    def join() -> None:
        held: list[str] = []
        length = 0
        for p in ready:
            if length + len(p) > size and held:
                out.append("".join(held).strip())
                while length > overlap or (length + len(p) > size and length > 0):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        if held:
            out.append("".join(held).strip())
        ready.clear()

    for p in parts:
        if len(p) < size:
            ready.append(p)
        else:
            join()
            if rest:
                out.extend(split_text(p, size, overlap, rest))
            else:
                out.append(p)
    join()
    return [c for c in out if c]


def chunk(files: DataFrame, repo_id: str) -> DataFrame:
    """Chunks with id and line range; blank files are skipped.

    ``files``: path, content.  A chunk's place is searched forward from the last start; one
    not found has lines 0, 0.
    """
    prefix = repo_id[:20]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                last = -1
                for i, c in enumerate(split_text(content)):
                    at = content.find(c, last + 1)
                    start = end = 0
                    if at >= 0:
                        last = at
                        start = content.count("\n", 0, at) + 1
                        end = start + c.count("\n")
                    rows.append((f"{prefix}_{hashlib.md5(path.encode()).hexdigest()[:10]}_{i}", path, i, start, end, c))
            yield pd.DataFrame(rows, columns=["id", "file_path", "n", "start_line", "end_line", "text"])

    kept = files.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("path", "content")
    return kept.mapInPandas(run, "id string, file_path string, n int, start_line long, end_line long, text string")


def hashing_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic local stand-in for an embedding service: hashed words, unit length."""
    import hashlib
    import math

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 20, chars: int = 2000) -> DataFrame:
    """Adds vector, calling the embedder on batches of texts cut to ``chars``."""
    columns = chunks.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t[:chars] for t in pdf["text"]]
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            if len(vectors) != len(texts):
                raise ValueError("the embedder returned another number of vectors")
            yield pdf[columns].assign(vector=vectors)

    from pyspark.sql import types as T

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
