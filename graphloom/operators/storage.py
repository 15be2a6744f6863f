"""Stored analyses: ownership, deletion, vector tables, signatures, validators of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V


def visible(rows: DataFrame, user: str | Column, owner: str = "owner") -> DataFrame:
    """rows without an owner and the user's own."""
    return rows.where(F.col(owner).isNull() | (F.col(owner) == (F.lit(user) if isinstance(user, str) else user)))


def valid_repo_id(name: Column) -> Column:
    """twelve lower-case hexadecimal digits."""
    return F.coalesce(name.rlike(r"\A[a-f0-9]{12}\z"), F.lit(False))


def clone_folder(folders: DataFrame, repo_id: str) -> DataFrame:
    """Folders named after the repository's id, the first by name."""
    return folders.where(F.col("name").endswith(f"_{repo_id}")).orderBy("name").limit(1)


def stale_clones(folders: DataFrame, now: Column, hours: int = V.CLONE_HOURS) -> DataFrame:
    """Clones last touched longer ago than ``hours``."""
    return folders.where(F.unix_seconds(F.col("mtime")) < F.unix_seconds(now) - hours * 3600)


def head_or_time(head: Column, mtime: Column) -> Column:
    """The commit, or the time of the last change where there is none."""
    return F.coalesce(head, F.concat(F.lit("mtime-"), F.unix_seconds(mtime).cast("string")))


def write_vectors(chunks: DataFrame, path: str) -> int:
    """K3: appends embedded chunks by repository and returns how many rows are there of what was written.

    Spark commits all or nothing, so the count must be that of ``chunks``.
    """
    spark = chunks.sparkSession
    chunks.write.mode("append").partitionBy("repo_id").parquet(path)
    ids = chunks.select("id").distinct()
    return spark.read.parquet(path).join(ids, "id", "left_semi").select("id").distinct().count()


def without_repo(rows: DataFrame, repo: DataFrame) -> DataFrame:
    """All rows but those of the repositories to delete (column repo_id)."""
    return rows.join(repo.select("repo_id").distinct(), "repo_id", "left_anti").select(*rows.columns)


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and their messages without those to delete (column session_id)."""
    g = gone.select("session_id").distinct()
    return sessions.join(g, "session_id", "left_anti"), messages.join(g, "session_id", "left_anti")


def missing_columns(schema: list[str], required: list[str]) -> list[str]:
    """Required columns that a table lacks, in order."""
    have = set(schema)
    return [c for c in required if c not in have]


def etag(payload: Column) -> Column:
    """K9: md5 of a payload's canonical JSON text."""
    return F.md5(F.to_json(payload))


def not_modified(tag: Column, asked: Column) -> Column:
    """K9: whether the asker's tag, quoted or weak, is the present one."""
    return F.coalesce(F.regexp_replace(asked, r'^(?:W/)?"?|"$', "") == tag, F.lit(False))


def origins(analyses: DataFrame) -> DataFrame:
    """Per owner/repo@commit the repository id that was analysed first; later ones point to it."""
    name = F.concat("owner", F.lit("/"), "repo", F.lit("@"), "commit")
    return analyses.groupBy(name.alias("signature")).agg(F.min(F.struct("at", "repo_id")).alias("x")).select("signature", F.col("x.repo_id").alias("origin"))


def same_file(hits: DataFrame, path: str | Column, most: int = V.SAME_FILE_HITS) -> DataFrame:
    """The best hits of one file (a top-k report)."""
    return hits.where(F.col("file_path") == path).orderBy(F.desc("score"), "id").limit(most)
