"""Operator 12: Merkle manifest of a dataset.

Method: a bottom-up build whose levels are written tables, and a top-down push of proofs.
A node is a row with the digests of its children, so a level is an aggregate of at most
``FAN`` rows to a group; one tree per source, and one over the sources' subroots.  Going
down, each level's rows join what their parents inherited, and each child puts its own
siblings before the inherited part of the proof.  Only inner nodes meet in joins: documents
unfold from the rows of the lowest level, so proofs of documents are never exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from .common import materialize, range_parts, spread_rank

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TREE = ["__src", "__none", "__at"]
_STEP = "array<struct<left:string,right:string>>"


def encode(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value, so no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encode, values)), 256)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings from the leaf's level up to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(proof, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


@dataclass
class Manifest:
    """Written levels of the sources' trees and of the tree over their subroots, lowest first."""

    own: list[DataFrame]
    top: list[DataFrame]


def _levels(nodes: DataFrame, width: int, carry: list[str], fan: int, name: str) -> list[DataFrame]:
    """Levels above ``nodes`` (tree, place from 0, digest): rows of a tree, a place and up to ``fan`` children.

    ``width`` is the size of the largest tree.  A tree that has come to one node keeps it unchanged on higher levels (``lone``).
    """
    out = []
    while width > 1 or not out:
        kid = F.struct("__at", "digest", *(carry if not out else []))
        rows = nodes.groupBy("__src", "__none", F.floor(F.col("__at") / fan).alias("__run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        lone = (F.col("__run") == 0) & (F.size("kids") == 1)
        digest = F.when(lone, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("kids.digest"), ""), 256))
        nodes = materialize(rows.select("__src", "__none", F.col("__run").alias("__at"), "kids", lone.alias("lone"), digest.alias("digest")), f"{name}-{len(out) + 1}")
        out.append(nodes)
        width = -(-width // fan)
    return out


def build(docs: DataFrame, leaf_col: str, order: list[str], *, source_col: str = "source", carry: list[str] | None = None, fan: int = FAN) -> Manifest:
    """Trees over rows that hold their leaf's digest; ``order`` ranks a source's leaves, nulls first, ties by digest.

    Rows equal in order and leaf stand in any order, which no digest shows.  ``carry`` names
    columns that the lowest level keeps.  Sources may hold any share of the rows: ranks come
    from ranges of the order, and no group has more than ``fan`` rows.  No rows, no root.
    """
    carry = carry or []
    held = docs.select(F.coalesce(source_col, F.lit("")).alias("__src"), F.col(source_col).isNull().alias("__none"), F.col(leaf_col).alias("digest"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)))
    # texts are read and hashed here, once; ranges are drawn over digests
    held = materialize(held, "merkle-leaves")
    by = [*(f"__o{i}" for i in range(len(order))), "digest"]
    placed = spread_rank(range_parts(held, ["__none", "__src", *by], "merkle-ranges"), ["__src", "__none"], "__p", [F.col(c) for c in by], "__at")
    widest = held.groupBy("__src", "__none").count().agg(F.max("count")).first()[0] or 0
    own = _levels(placed, widest, [f"__c{i}" for i in range(len(carry))], fan, "merkle-own")
    roots = graph.in_order(own[-1].select("__src", "__none", "digest"), [F.desc("__none"), "__src"])
    tops = roots.select(F.lit("").alias("__src"), F.lit(False).alias("__none"), (F.col("place") - 1).alias("__at"), "digest", F.col("__src").alias("__c0"), F.col("__none").alias("__c1"))
    return Manifest(own, _levels(tops, roots.count(), ["__c0", "__c1"], fan, "merkle-top"))


def _push(inherited: DataFrame, levels: list[DataFrame], carried: list[str]) -> DataFrame:
    """From (tree, place 0, proof, ...) down to the children of the lowest level."""
    keep = [c for c in inherited.columns if c not in (*_TREE, "proof")]
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].select(*_TREE, "lone", "kids")
        rows = level.join(inherited, _TREE)
        rows = rows.select("*", F.col("kids.digest").alias("__all"), F.posexplode("kids").alias("__i", "__kid"))
        left = F.array_join(F.slice("__all", F.lit(1), F.col("__i")), "")
        right = F.array_join(F.slice("__all", F.col("__i") + 2, F.size("__all")), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(_STEP)
        proof = F.when(F.col("lone"), F.col("proof")).otherwise(F.concat(step, F.col("proof")))
        own = [F.col(f"__kid.{c}").alias(c) for c in (["digest", *carried] if depth == 0 else [])]
        inherited = rows.select("__src", "__none", F.col("__kid.__at").alias("__at"), proof.alias("proof"), *keep, *own)
    return inherited


def prove(manifest: Manifest, carry: list[str]) -> DataFrame:
    """A row per leaf: the carried columns, ``leaf``, ``subroot``, ``root`` and ``proof`` (siblings left and right, per level up to the root)."""
    start = manifest.top[-1].select(*_TREE, F.array().cast(_STEP).alias("proof"), F.col("digest").alias("root"))
    roots = _push(start, manifest.top, ["__c0", "__c1"])
    trees = roots.select(F.col("__c0").alias("__src"), F.col("__c1").alias("__none"), F.lit(0).cast("long").alias("__at"), "proof", "root", F.col("digest").alias("subroot"))
    rows = _push(trees, manifest.own, [f"__c{i}" for i in range(len(carry))])
    return rows.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), F.col("digest").alias("leaf"), "subroot", "root", "proof")


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows that the audit tampers with: those whose id's crc32, as decimal text, 5 divides; a null id never."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audit(docs: DataFrame, *, fan: int = FAN) -> DataFrame:
    """Manifest of ``docs``, and the verdict on every row after part of the texts was put in lower case.

    Every row is a leaf: null values are written ``-``, an empty text ``0:``, a text of any
    length is hashed whole.  Rows with a null id come first in their source, repeated rows
    are leaves of their own beside each other, a null source is the first source.  An empty
    table gives no rows.  Other columns are not part of a leaf.
    """
    values = [F.col(c) for c in FIELDS]
    changed = F.when(tampered(docs), leaf(*values[:-1], lowered(values[-1])))
    rows = docs.select("doc_id", F.col("source").cast(T.StringType()).alias("source"), leaf(*values).alias("__leaf"), changed.alias("__changed"))
    carry = ["doc_id", "__changed"]
    proved = prove(build(rows, "__leaf", ["doc_id"], carry=carry, fan=fan), carry)
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("__changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
