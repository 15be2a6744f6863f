"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, merkle, mixing, prefixtrie, quality, sharding, simhash, suffixes, toxicity, vectors, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = winnow.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_taken(_table(spark, sf_dir, "documents")).drop("__ra", "__rb")


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup_substrings(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a turn of one text part; users attach something to three turns in four."""
    talk = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    kinds = F.array(F.lit(None).cast("string"), F.lit("image"), F.lit("audio"), F.lit("document"))
    kind = F.when((F.col("role") == "user") & (F.col("conv_id") >= 0), F.get(kinds, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int")))
    extra = F.array(chat.part(kind, None, F.concat_ws("/", "conv_id", "turn"), F.length(F.coalesce("text", F.lit(""))) % 5 + 1))
    text = chat.text_part(F.col("text"))
    turns = talk.unionByName(probe).withColumn("parts", F.when(kind.isNull(), text).otherwise(F.concat(text, extra)))
    back = chat.read_back(chat.format_chat(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    others = F.flatten(F.transform("turns", lambda t: F.filter(t["parts"], lambda p: p["kind"] != "text")))
    listed = F.array_join(F.transform(others, lambda p: F.concat(p["kind"], F.lit(" "), p["ref"], F.lit(" "), p["units"].cast("string"), F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.sha2(listed, 256).alias("attachments_sha256"),
        "expanded_tokens",
    )


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    misspelt = F.size(F.filter("hits", lambda h: h["distance"] > 0))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("hits").cast("long").alias("n_hits"), misspelt.cast("long").alias("n_misspelt"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.rebuild(prefixtrie.sequences(_table(spark, sf_dir, "conversations"))))


#: SQL of crc32 over decimal text, by the usual byte table
CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) r(b))"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"


def _op12_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** ``levels`` leaves, level by level."""

    def encoded(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def hashed(text: str) -> str:
        return f"sha256({encoded('doc_id')} || {encoded('source')} || {encoded('lang')} || {encoded('n_chars')} || {encoded(text)})"

    def tree(name: str) -> str:
        step = "{n}{k} AS (SELECT src, pos // 16 AS pos, list(h ORDER BY pos) AS kids, count(*) = 1 AND pos // 16 = 0 AS lone, CASE WHEN count(*) = 1 AND pos // 16 = 0 THEN first(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {n}{j} GROUP BY src, pos // 16)"
        return ",\n".join(step.format(n=name, k=k, j=k - 1) for k in range(1, levels + 1))

    def steps(name: str, place: str, before: str) -> str:
        """One CTE per level: siblings are appended to the proof and folded in."""
        out = []
        for k in range(1, levels + 1):
            i = f"({place} // {16 ** (k - 1)}) % 16"
            left, right = f"list_aggregate(list_prepend('', kids[1:{i}]), 'string_agg', '')", f"list_aggregate(list_prepend('', kids[{i} + 2:]), 'string_agg', '')"
            sides = "l.h IS NOT NULL AND NOT lone"
            out.append(f"""{name}p{k} AS (SELECT d.* EXCLUDE (proof, folded), proof || CASE WHEN {sides} THEN {left} || {right} ELSE '' END AS proof,
  CASE WHEN {sides} THEN sha256({left} || folded || {right}) ELSE folded END AS folded
  FROM {before} d JOIN {name}{k} l ON d.{'src' if name == 'own' else 'one'} = l.src AND {place} // {16 ** k} = l.pos)""")
            before = f"{name}p{k}"
        return ",\n".join(out)

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {CRC_TABLE},
docs AS (
  SELECT doc_id, source IS NULL AS none, coalesce('s' || source, '') AS src, {hashed('text')} AS h,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {hashed(low)} ELSE {hashed('text')} END AS changed
  FROM documents, crc),
own0 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM docs),
{tree('own')},
top0 AS (SELECT '' AS src, src AS name, h, row_number() OVER (ORDER BY src) - 1 AS pos FROM own{levels}),
{tree('top')},
start AS (SELECT doc_id, '' AS one, d.src, d.h AS leaf, d.pos, t.h AS subroot, t.pos AS tat, '' AS proof, changed AS folded FROM own0 d JOIN top0 t ON d.src = t.name),
{steps('own', 'd.pos', 'start')},
{steps('top', 'd.tat', f'ownp{levels}')}
SELECT doc_id, leaf, subroot, l.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = l.h AS verified
FROM topp{levels}, top{levels} l
"""


OP13_SQL = rf"""
WITH {CRC_TABLE},
t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS u,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), u) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
b AS (
  SELECT c.conv_id, n, u, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND n <= h
  UNION ALL SELECT c.conv_id, n, u, words FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
r AS (SELECT conv_id, words, u, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS d FROM b),
p AS (
  SELECT conv_id, d, words, sha256(string_agg(u, '') OVER (PARTITION BY conv_id ORDER BY d)) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM p GROUP BY prefix, d),
tied AS (SELECT node.*, up.prefix AS above FROM node LEFT JOIN p up ON up.conv_id = node.conv_id AND up.d = node.d - 1),
kids AS (SELECT above AS prefix, count(*) AS n FROM tied WHERE above IS NOT NULL GROUP BY above),
sub AS (
  SELECT a.prefix, sum((node.n_convs - 1) * node.words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM node LEFT JOIN kids ON kids.prefix = node.prefix JOIN p a ON a.conv_id = node.conv_id AND a.d <= node.d GROUP BY a.prefix),
stop AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, arg_max(prefix, d) AS prefix FROM p GROUP BY conv_id) GROUP BY prefix)
SELECT tied.conv_id, tied.d::BIGINT AS depth, up.conv_id AS parent_conv_id, tied.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(stop.h, sha256('')) AS ends_sha256
FROM tied LEFT JOIN node up ON up.prefix = tied.above LEFT JOIN kids ON kids.prefix = tied.prefix
JOIN sub ON sub.prefix = tied.prefix LEFT JOIN stop ON stop.prefix = tied.prefix
"""


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h
  FROM documents),
src AS (
  SELECT src, none, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY none, src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY src, none),
lev AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM src),
lev2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM lev),
best AS (SELECT first(lvl ORDER BY cap / w, none, src) AS lam FROM lev2 WHERE cap > lvl * w),
tgt AS (
  SELECT src, none, source_size,
         CASE WHEN lam IS NULL OR cap <= lam * w THEN cap ELSE lam * w END AS target
  FROM lev2 LEFT JOIN best ON true),
share AS (
  SELECT src, none, sum(round(target)::BIGINT) OVER (ORDER BY none, src) AS hi, sum(round(target)::BIGINT) OVER (ORDER BY none, src) - round(target)::BIGINT AS lo,
         sum(round(target)::BIGINT) OVER () AS total
  FROM tgt),
plan AS (SELECT max(total)::BIGINT AS total, greatest(1, least(4096, max(total) // 65536))::BIGINT AS block FROM share),
slots AS (
  SELECT ((i >> 20) * 0.607787409740351::DOUBLE % 1 + (i & 1048575) * 0.6180339887498949::DOUBLE % 1) % 1 * total::DOUBLE AS x
  FROM (SELECT total, unnest(range(((total + block - 1) // block)::BIGINT)) AS i FROM plan)),
drawn AS (SELECT src, none, count(*) AS n FROM share JOIN slots ON x >= lo AND x < hi GROUP BY src, none),
line AS (
  SELECT s.*, t.source_size, t.target, least(coalesce(d.n, 0) * block, 3 * t.source_size)::BIGINT AS stop,
         coalesce(sum(s.size) OVER (PARTITION BY s.src, s.none ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized s JOIN tgt t ON s.src = t.src AND s.none = t.none LEFT JOIN drawn d ON s.src = d.src AND s.none = d.none, plan)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0::BIGINT
            ELSE ((stop // source_size) * size + greatest(0, least(pos + size, stop % source_size) - pos))::BIGINT END AS taken
FROM line
"""

OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, CASE WHEN role = 'user' AND conv_id >= 0 THEN [NULL, 'image', 'audio', 'document'][(conv_id + turn) % 4 + 1] END AS kind, length(text) % 5 + 1 AS units FROM t),
j AS (SELECT *, coalesce(sum((kind IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS j FROM a),
e AS (
  SELECT *, length('<|turn:' || role || '|>') + coalesce(length('<|' || kind || ':' || j || '|>'), 0)
            + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) + 7 AS n,
         len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]')) + CASE kind WHEN 'image' THEN 256 * units WHEN 'audio' THEN 25 * units WHEN 'document' THEN 512 * units ELSE 0 END AS tokens
  FROM j)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars, count(kind)::BIGINT AS n_attachments,
       sha256(coalesce(string_agg(kind || ' ' || conv_id || '/' || turn || ' ' || units || chr(10), '' ORDER BY turn) FILTER (WHERE kind IS NOT NULL), '')) AS attachments_sha256,
       sum(tokens)::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id
"""


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
       (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 +
         (((strpos('0123456789abcdef', substr(h, (1 + (5 * i) // 4)::BIGINT, 1)) - 1) * 16
           + strpos('0123456789abcdef', substr(h, (2 + (5 * i) // 4)::BIGINT, 1)) - 1) // (2 ** (3 - (5 * i) % 4))::BIGINT) % 32)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m ON p.body = m.body
"""

OP1_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dg AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN bw ON dg.g = bw.g AND dg.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnow_decontaminate": op1_winnow_decontaminate,
        "op2_mix_sources": op2_mix_sources,
        "op3_hypergeometric_shards": op3_hypergeometric_shards,
        "op4_suffix_runs": op4_suffix_runs,
        "op5_quality_trees": op5_quality_trees,
        "op6_vector_tiles": op6_vector_tiles,
        "op7_simhash_groups": op7_simhash_groups,
        "op8_chat_parts": op8_chat_parts,
        "op9_license_rules": op9_license_rules,
        "op10_warc_bundles": op10_warc_bundles,
        "op11_toxic_terms": op11_toxic_terms,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_winnow_decontaminate": OP1_SQL, "op2_mix_sources": OP2_SQL, "op6_vector_tiles": OP6_SQL, "op8_chat_parts": OP8_SQL, "op10_warc_bundles": OP10_SQL, "op12_merkle_manifest": _op12_sql(), "op13_prefix_trie": OP13_SQL}
