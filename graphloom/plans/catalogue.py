"""Every registered graph-engine query over the test tables, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from ..operators import degrees as D
from ..operators import diff as C
from ..operators import graph as G
from ..operators import strong as Z
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import retrieval as Q
from ..operators import roles as L
from ..operators import rollup as U
from . import adapters as A

RATES = {"click": 0.002, "view": 0.001, "purchase": 0.01, "signup": 0.0, "error": 0.0005}
QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]

QUERIES: dict = {}
SQL: dict[str, str] = {}

IMPORTS = """imports AS (
  SELECT l_orderkey AS ord, l_linenumber AS line, l_linestatus AS type, l_partkey AS source,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target
  FROM lineitem WHERE l_returnflag = 'R')"""
EDGES = IMPORTS + """,
edges AS (SELECT * FROM imports WHERE target IS NOT NULL AND target <> source AND target IN (SELECT p_partkey FROM part)),
pairs AS (SELECT DISTINCT source, target FROM edges)"""
DEG = EDGES + """,
ends AS (SELECT source AS file, 0 AS i, 1 AS o FROM pairs UNION ALL SELECT target, 1, 0 FROM pairs),
deg AS (SELECT file, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY file)"""
FILES = """files AS (
  SELECT p_partkey AS id, p_type || '/' || p_brand || '/' || p_name || '_' || p_partkey AS path, p_name AS name, p_type AS folder,
         p_brand AS language, round(p_retailprice * 100)::BIGINT AS size, p_size AS loc, p_size % 7 AS functions FROM part)"""
PROFILES = DEG + ",\n" + FILES + """,
profiles AS (SELECT f.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM files f LEFT JOIN deg ON f.id = deg.file)"""
IMPORTANCE = PROFILES + """,
tops AS (SELECT max(loc) AS ml, max(out_degree) AS mo, max(in_degree) AS mi, max(functions) AS mf FROM profiles),
scored AS (SELECT profiles.*, round(CASE WHEN ml > 0 THEN 25.0::DOUBLE * loc / ml ELSE 0 END + CASE WHEN mo > 0 THEN 25.0::DOUBLE * out_degree / mo ELSE 0 END
  + CASE WHEN mi > 0 THEN 25.0::DOUBLE * in_degree / mi ELSE 0 END + CASE WHEN mf > 0 THEN 25.0::DOUBLE * functions / mf ELSE 0 END, 2) AS importance FROM profiles, tops)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def scored(spark: SparkSession, d: str) -> DataFrame:
    return L.importance(A.profiles(spark, d))


@query("central_top30", f"""WITH {DEG}
SELECT file, in_degree, out_degree, 3 * in_degree + out_degree AS score,
       CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'entry_point' WHEN out_degree = 0 AND in_degree > 0 THEN 'leaf_utility'
            WHEN in_degree >= 3 AND out_degree >= 1 THEN 'core_module' WHEN in_degree > out_degree THEN 'utility'
            WHEN out_degree > in_degree THEN 'orchestrator' ELSE 'connector' END AS role
FROM deg ORDER BY score DESC, file LIMIT 30""")
def central_top30(spark, d):
    return D.central_files(A.edges(spark, d))


@query("edge_stats", f"""WITH {IMPORTS},
t AS (SELECT imports.*, p_partkey AS k FROM imports LEFT JOIN part ON target = p_partkey)
SELECT count(*) FILTER (WHERE k IS NOT NULL AND source <> target)::BIGINT AS total_edges,
       count(*) FILTER (WHERE k IS NOT NULL AND source <> target)::BIGINT AS resolved_edges,
       count(*) FILTER (WHERE k IS NULL OR source = target)::BIGINT AS unresolved_count FROM t""")
def edge_stats(spark, d):
    return D.edge_stats(A.imports(spark, d), A.files(spark, d), key="id")


@query("unresolved_reasons", f"""WITH {IMPORTS}
SELECT CASE WHEN target = source THEN 'self_import' WHEN target % 10 = 3 THEN 'resolved_but_not_tracked' WHEN target IS NULL AND line % 2 = 0 THEN 'local_path_not_found'
            WHEN target IS NULL THEN 'external_or_unmapped_package' END AS reason, count(*)::BIGINT AS n
FROM imports WHERE target = source OR target IS NULL OR target % 10 = 3 GROUP BY 1""")
def unresolved_reasons(spark, d):
    raw = F.when(F.col("line") % 2 == 0, F.concat(F.lit("./"), F.col("source").cast("string"))).otherwise(F.concat(F.lit("pkg"), F.col("source").cast("string")))
    reason = D.unresolved_reason(raw, F.col("target").cast("string"), F.col("source").cast("string"), F.col("target") % 10 != 3)
    return A.imports(spark, d).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("entry_points_topology", f"""WITH {PROFILES}
SELECT id, CASE WHEN out_degree > 0 AND in_degree = 0 THEN 2 ELSE 0 END AS score FROM profiles WHERE out_degree > 0 AND in_degree = 0""")
def entry_points_topology(spark, d):
    p = A.profiles(spark, d)
    return p.select("id", D.topology_score(F.col("in_degree"), F.col("out_degree"), F.col("path")).alias("score")).where("score >= 2")


@query("module_rollup", f"""WITH {IMPORTANCE},
m AS (SELECT folder || '/' || language AS module, count(*)::BIGINT AS file_count, count(DISTINCT language)::BIGINT AS languages, round(sum(round(importance * 100)::BIGINT)::DOUBLE / (count(*) * 100), 2) AS importance FROM scored GROUP BY 1),
e AS (SELECT a.folder || '/' || a.language AS module, count(*)::BIGINT AS internal_edges FROM edges JOIN files a ON source = a.id JOIN files b ON target = b.id
      WHERE a.folder = b.folder AND a.language = b.language GROUP BY 1)
SELECT m.module, file_count, languages, importance, coalesce(internal_edges, 0)::BIGINT AS internal_edges FROM m LEFT JOIN e ON m.module = e.module""")
def module_rollup(spark, d):
    return U.modules(scored(spark, d), _pathed(spark, d), S.module(F.col("path"), 2), S.module(F.col("sp"), 2), S.module(F.col("tp"), 2))


def _pathed(spark, d) -> DataFrame:
    f = A.files(spark, d).select("id", "path")
    e = A.edges(spark, d)
    return e.join(f.select(F.col("id").alias("source"), F.col("path").alias("sp")), "source").join(f.select(F.col("id").alias("target"), F.col("path").alias("tp")), "target")


@query("module_connections", f"""WITH {EDGES}, {FILES}
SELECT a.folder AS source, b.folder AS target, count(*)::BIGINT AS weight FROM edges JOIN files a ON edges.source = a.id JOIN files b ON edges.target = b.id
WHERE a.folder <> b.folder GROUP BY 1, 2""")
def module_connections(spark, d):
    return U.module_connections(_pathed(spark, d), S.module(F.col("sp"), 1), S.module(F.col("tp"), 1))


@query("module_weights", f"""WITH {EDGES}, {FILES},
c AS (SELECT a.folder AS s, b.folder AS t, count(*) AS w FROM edges JOIN files a ON edges.source = a.id JOIN files b ON edges.target = b.id WHERE a.folder <> b.folder GROUP BY 1, 2)
SELECT module, coalesce((SELECT sum(w) FROM c WHERE t = module), 0)::BIGINT AS in_weight, coalesce((SELECT sum(w) FROM c WHERE s = module), 0)::BIGINT AS out_weight
FROM (SELECT DISTINCT folder AS module FROM files)""")
def module_weights(spark, d):
    return U.module_weights(A.files(spark, d).select(S.module(F.col("path"), 1).alias("module")).distinct(), module_connections(spark, d))


@query("module_languages", f"""WITH {FILES}, c AS (SELECT folder AS module, language AS value, count(*)::BIGINT AS n FROM files GROUP BY 1, 2)
SELECT module, string_agg(value || ':' || n, ',' ORDER BY n DESC, value) AS languages FROM c GROUP BY 1""")
def module_languages(spark, d):
    c = U.counts_map(A.files(spark, d).withColumn("module", S.top_folder(F.col("path"))), "module", "language", "m")
    return c.select("module", F.array_join(F.transform("m", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",").alias("languages"))


LEVELS = f"""WITH {EDGES}, {FILES},
f AS (SELECT source, target, count(*) AS n FROM edges GROUP BY 1, 2),
j AS (SELECT f.*, a.folder || '/' || a.language AS sc, b.folder || '/' || b.language AS tc, a.folder AS sl, b.folder AS tl FROM f JOIN files a ON source = a.id JOIN files b ON target = b.id),
levels AS (
  SELECT 'file' AS level, source::VARCHAR AS source, target::VARCHAR AS target, sum(n)::BIGINT AS n FROM j GROUP BY 1, 2, 3
  UNION ALL SELECT 'container', sc, tc, sum(n)::BIGINT FROM j WHERE sc <> tc GROUP BY 1, 2, 3
  UNION ALL SELECT 'layer', sl, tl, sum(n)::BIGINT FROM j WHERE sl <> tl GROUP BY 1, 2, 3)"""


@query("edge_levels", LEVELS + " SELECT * FROM levels")
def edge_levels(spark, d):
    dim = A.files(spark, d).select(F.col("id").alias("file"), S.module(F.col("path"), 2).alias("container"), S.module(F.col("path"), 1).alias("layer"))
    return U.edge_levels(A.edges(spark, d), dim)


@query("portals", LEVELS + " SELECT source, target, n FROM levels WHERE level = 'layer'")
def portals(spark, d):
    return edge_levels(spark, d).where("level = 'layer'").select("source", "target", "n")


def _layer_sql(c: str) -> str:
    rules = " ".join("WHEN " + " OR ".join(f"contains({c}, '{k}')" for k in words) + f" THEN '{layer}'" for layer, words in V.LAYER_KEYWORDS)
    return f"CASE {rules} ELSE 'other' END"


@query("layer_tag", f"SELECT page_id, {_layer_sql('lower(url)')} AS layer FROM pages")
def layer_tag(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.layer_of_path(F.col("url")).alias("layer"))


@query("layer_connections", f"""WITH {EDGES}, {FILES}
SELECT a.name AS source, b.name AS target, count(*)::BIGINT AS pairs FROM pairs JOIN files a ON pairs.source = a.id JOIN files b ON pairs.target = b.id WHERE a.name <> b.name GROUP BY 1, 2""")
def layer_connections(spark, d):
    f = A.files(spark, d).select("id", "name")
    e = A.edges(spark, d).join(f.select(F.col("id").alias("source"), F.col("name").alias("sn")), "source").join(f.select(F.col("id").alias("target"), F.col("name").alias("tn")), "target")
    return U.layer_connections(e, F.col("sn"), F.col("tn"))


@query("modal_importer_layer", f"""WITH {EDGES}, {FILES},
c AS (SELECT target AS file, folder AS layer, count(*)::BIGINT AS importers FROM pairs JOIN files ON source = id GROUP BY 1, 2)
SELECT file, layer, importers FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY importers DESC, layer) = 1""")
def modal_importer_layer(spark, d):
    return U.modal_importer_layer(A.edges(spark, d), A.files(spark, d).select(F.col("id").alias("file"), F.col("folder").alias("layer")))


@query("importance", f"WITH {IMPORTANCE} SELECT id, importance FROM scored")
def importance(spark, d):
    return scored(spark, d).select("id", "importance")


@query("role_graph_rules", f"""WITH {PROFILES},
a AS (SELECT greatest(max(in_degree), 1) AS mi, greatest(max(out_degree), 1) AS mo, avg(in_degree) AS ai, avg(out_degree) AS ao FROM profiles),
r AS (SELECT id, in_degree AS i, out_degree AS o, in_degree / mi AS ri, out_degree / mo AS ro, ai, ao FROM profiles, a)
SELECT id, CASE WHEN i >= 3 AND o >= 2 AND ri >= 0.3 AND ro >= 0.2 THEN 'core_module' WHEN o >= 3 AND ro >= 0.3 AND i <= ai THEN 'orchestrator'
  WHEN i >= 3 AND ri >= 0.3 AND o <= ao THEN 'shared_utility' WHEN i >= 1 AND i < 3 AND o <= 2 THEN 'internal_helper' ELSE 'leaf' END AS role,
  round(CASE WHEN i >= 3 AND o >= 2 AND ri >= 0.3 AND ro >= 0.2 THEN 0.75::DOUBLE + 0.2::DOUBLE * ri WHEN o >= 3 AND ro >= 0.3 AND i <= ai THEN 0.70::DOUBLE + 0.2::DOUBLE * ro
  WHEN i >= 3 AND ri >= 0.3 AND o <= ao THEN 0.75::DOUBLE + 0.2::DOUBLE * ri WHEN i >= 1 AND i < 3 AND o <= 2 THEN 0.6 WHEN i = 0 AND o = 0 THEN 0.5 WHEN i = 0 AND o >= 1 THEN 0.45 ELSE 0.3 END, 2) AS confidence
FROM r""")
def role_graph_rules(spark, d):
    p = A.profiles(spark, d)
    a = p.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("mi"), F.greatest(F.max("out_degree"), F.lit(1)).alias("mo"), F.avg("in_degree").alias("ai"), F.avg("out_degree").alias("ao"))
    r = p.crossJoin(F.broadcast(a)).withColumn("r", L.graph_role_candidates(F.col("in_degree"), F.col("out_degree"), F.col("ai"), F.col("ao"), F.col("mi"), F.col("mo")))
    return r.select("id", F.col("r.role").alias("role"), F.round("r.confidence", 2).alias("confidence"))


FLAGS = IMPORTANCE + """,
hub AS (SELECT greatest(1, least(10, coalesce((SELECT in_degree FROM profiles WHERE in_degree > 0 ORDER BY in_degree DESC LIMIT 1 OFFSET (SELECT greatest(1, ceil(count(*) * 0.05::DOUBLE))::BIGINT - 1 FROM profiles WHERE in_degree > 0)), 0))) AS h),
cyc AS (SELECT source AS a, target AS b FROM pairs UNION SELECT a, target FROM cyc JOIN pairs ON b = source),
god AS (SELECT greatest(1, least(40000, coalesce((SELECT size FROM profiles WHERE size > 0 ORDER BY size DESC LIMIT 1 OFFSET (SELECT greatest(1, ceil(count(*) * 0.02::DOUBLE))::BIGINT - 1 FROM profiles WHERE size > 0)), 0))) AS g),
flagged AS (SELECT scored.*, in_degree = 0 AND NOT (out_degree > 0 AND in_degree = 0) AS orphan, id IN (SELECT a FROM cyc WHERE a = b) AS in_cycle, in_degree >= h AS hub, out_degree > 0 AND in_degree = 0 AS entry_point, size >= g AS god_file FROM scored, hub, god)"""


def flagged(spark, d, strong: DataFrame | None = None) -> DataFrame:
    s = scored(spark, d).withColumn("is_entry", (F.col("out_degree") > 0) & (F.col("in_degree") == 0))
    strong = strong if strong is not None else Z.strong_components(A.edges(spark, d))
    c = strong.select(F.col("node").alias("id"), F.lit(True).alias("in_cycle"))
    return R.flags(G.settle(s.join(c, "id", "left").na.fill(False, ["in_cycle"])))


@query("hub_flags", f"""WITH RECURSIVE {FLAGS}
SELECT id, concat_ws(',', CASE WHEN orphan THEN 'orphan' END, CASE WHEN in_cycle THEN 'in_cycle' END, CASE WHEN hub THEN 'hub' END, CASE WHEN entry_point THEN 'entry_point' END, CASE WHEN god_file THEN 'god_file' END) AS flags FROM flagged""")
def hub_flags(spark, d):
    return flagged(spark, d).select("id", F.array_join("flags", ",").alias("flags"))


@query("flag_counts", f"""WITH RECURSIVE {FLAGS}
SELECT flag, n AS files FROM (SELECT 'orphan' AS flag, count(*) FILTER (WHERE orphan)::BIGINT AS n FROM flagged UNION ALL SELECT 'in_cycle', count(*) FILTER (WHERE in_cycle)::BIGINT FROM flagged UNION ALL SELECT 'hub', count(*) FILTER (WHERE hub)::BIGINT FROM flagged
UNION ALL SELECT 'entry_point', count(*) FILTER (WHERE entry_point)::BIGINT FROM flagged UNION ALL SELECT 'god_file', count(*) FILTER (WHERE god_file)::BIGINT FROM flagged) WHERE n > 0""")
def flag_counts(spark, d):
    return R.flag_counts(flagged(spark, d))


COLLAPSED = IMPORTANCE + """,
kept AS (SELECT id FROM scored ORDER BY importance DESC, id LIMIT 99)"""


@query("collapsed_nodes", f"""WITH {COLLAPSED}
SELECT CASE WHEN id IN (SELECT id FROM kept) THEN id::VARCHAR ELSE '__collapsed__' END AS id, sum(in_degree)::BIGINT AS in_degree, sum(out_degree)::BIGINT AS out_degree FROM scored GROUP BY 1""")
def collapsed_nodes(spark, d):
    return R.collapsed_graph(scored(spark, d), A.edges(spark, d))[0]


@query("collapsed_edges", f"""WITH {COLLAPSED},
r AS (SELECT DISTINCT CASE WHEN source IN (SELECT id FROM kept) THEN source::VARCHAR ELSE '__collapsed__' END AS source, CASE WHEN target IN (SELECT id FROM kept) THEN target::VARCHAR ELSE '__collapsed__' END AS target FROM pairs)
SELECT * FROM r WHERE NOT (source = '__collapsed__' AND target = '__collapsed__')""")
def collapsed_edges(spark, d):
    return R.collapsed_graph(scored(spark, d), A.edges(spark, d))[1]


@query("first_edges", f"""WITH {EDGES} SELECT source, target, ord, line, type FROM edges QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY ord, line, type) = 1""")
def first_edges(spark, d):
    return R.first_edges(A.edges(spark, d), ["ord", "line"])


IMPORTANT = FLAGS + """,
important AS (SELECT id FROM (SELECT id FROM scored ORDER BY importance DESC, id LIMIT 15) UNION SELECT id FROM flagged WHERE orphan OR in_cycle OR hub OR entry_point OR god_file)"""


@query("important_ids", f"WITH RECURSIVE {IMPORTANT} SELECT id FROM important")
def important_ids(spark, d):
    return R.important_ids(flagged(spark, d))


@query("recall_tour", f"""WITH RECURSIVE {IMPORTANT}
SELECT id, row_number() OVER (ORDER BY importance DESC, (orphan OR in_cycle OR hub OR entry_point OR god_file) DESC, id) AS place FROM flagged WHERE id IN (SELECT id FROM important)""")
def recall_tour(spark, d):
    f = flagged(spark, d)
    return R.recall_order(f.join(R.important_ids(f), "id", "left_semi")).select("id", F.col("order").cast("long").alias("place"))


CHANGES = """old AS (SELECT doc_id AS path, md5(text) AS c, md5(lang) AS i, md5(source) AS e, CASE WHEN doc_id % 21 = 0 THEN md5(right(text, 9)) ELSE md5(lang) END AS s, doc_id % 17 = 0 AS p FROM documents WHERE doc_id % 13 <> 0),
n0 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || '# changed' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0),
new AS (SELECT doc_id AS path, md5(text) AS c, md5(lang) AS i, md5(source) AS e, CASE WHEN doc_id % 21 = 0 THEN md5(right(text, 9)) ELSE md5(lang) END AS s, doc_id % 17 = 0 AS p FROM n0),
changes AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'DELETED' WHEN o.path IS NULL THEN 'STRUCTURAL' WHEN o.c = n.c THEN 'NONE' WHEN n.p AND o.p THEN 'COSMETIC'
  WHEN o.i = n.i AND o.e = n.e AND o.s = n.s THEN 'COSMETIC' ELSE 'STRUCTURAL' END AS change FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


@query("change_map", f"WITH {CHANGES} SELECT path, change FROM changes")
def change_map(spark, d):
    return C.change_classes(*A.snapshots(spark, d))


@query("change_classes", f"WITH {CHANGES} SELECT change, count(*)::BIGINT AS files FROM changes GROUP BY change")
def change_classes(spark, d):
    return change_map(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query("update_policy", f"""WITH {CHANGES}, c AS (SELECT count(*) FILTER (WHERE change = 'STRUCTURAL')::BIGINT AS structural, count(*)::BIGINT AS files FROM changes WHERE change <> 'DELETED')
SELECT structural, files, CASE WHEN structural = 0 THEN 'SKIP' WHEN structural >= 30 OR structural > 0.5 * files THEN 'FULL_UPDATE' WHEN structural >= 10 THEN 'ARCHITECTURE_UPDATE' ELSE 'PARTIAL_UPDATE' END AS policy FROM c""")
def update_policy(spark, d):
    return C.update_policy(change_map(spark, d))


@query("diff_tour", f"""WITH {CHANGES}
SELECT path, change, (path % 97)::BIGINT AS importance, CASE change WHEN 'STRUCTURAL' THEN 0 ELSE 1 END AS rank,
       row_number() OVER (PARTITION BY change ORDER BY path % 97 DESC, path) AS place FROM changes WHERE change IN ('STRUCTURAL', 'COSMETIC')""")
def diff_tour(spark, d):
    files = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("importance"))
    return C.diff_tour(change_map(spark, d), files).withColumn("place", F.col("place").cast("long"))


@query("patched_edges", f"""WITH {EDGES}
SELECT source, target, ord, line FROM edges WHERE source % 7 <> 0 AND source % 11 <> 0 AND target % 11 <> 0
UNION ALL SELECT source, target, ord, line FROM edges WHERE source % 7 = 0 AND source % 11 <> 0 AND line = 1""")
def patched_edges(spark, d):
    e = A.edges(spark, d).select("source", "target", "ord", "line")
    f = A.files(spark, d).select(F.col("id").alias("path"))
    fresh = e.where("source % 7 = 0 and source % 11 <> 0 and line = 1")
    return C.patched_edges(e, fresh, f.where("path % 7 = 0"), f.where("path % 11 = 0"))


@query("chunk_loc", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n'), lambda x: regexp_replace(x, '\s', '', 'g') <> ''))::BIGINT AS loc FROM documents""")
def chunk_loc(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.loc(F.col("text")).cast("long").alias("loc"))


@query("token_estimate", "SELECT doc_id, greatest(n_chars // 4, 1)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("n_chars")).alias("tokens"))


@query("size_format", "SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM (SELECT p_partkey, p_size::BIGINT * p_partkey AS n FROM part)")
def size_format(spark, d):
    return A.table(spark, d, "part").select("p_partkey", S.human_size(F.col("p_size").cast("long") * F.col("p_partkey")).alias("size"))


@query("content_hashes", "SELECT doc_id, md5(text) AS content_hash, md5(array_to_string(list_sort(list_distinct([lower(lang), lower(source)])), '|')) AS set_hash FROM documents")
def content_hashes(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"), S.set_hash(F.array("lang", "source", "lang")).alias("set_hash"))


@query("content_signals", r"""SELECT doc_id, contains(c, 'if __name__') AND contains(c, '__main__') AS has_main_guard, regexp_matches(c, 'def\s+main\s*\(|func\s+main\s*\(|public\s+static\s+void\s+main') AS has_main_function,
  len(regexp_extract_all(c, '(?:class|interface|struct|enum)\s+\w+')) >= 2 AS has_class_defs, regexp_matches(c, '(?:\.backward\(\)|optimizer\.(?:step|zero_grad)|model\.fit\(|model\.train\(\))') AS has_ml_training
FROM (SELECT doc_id, substr(text, 1, 4096) AS c FROM documents)""")
def content_signals(spark, d):
    s = L.signal_columns(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", *[s[n].alias(n) for n in ("has_main_guard", "has_main_function", "has_class_defs", "has_ml_training")])


VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


@query("cosine_topk", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {VEC}) DESC, vec_id LIMIT 8")
def cosine_topk(spark, d):
    return Q.cosine_topk(A.chunks(spark, d), QUERY_VECTOR, 8).select("id", F.round("score", 6).alias("score"))


@query("cosine_topk_filtered", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS score FROM embeddings WHERE label % 3 <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {VEC}) DESC, vec_id LIMIT 5")
def cosine_topk_filtered(spark, d):
    return Q.cosine_topk(A.chunks(spark, d), QUERY_VECTOR, 5, V.EXCLUDED_LAYERS).select("id", F.round("score", 6).alias("score"))


@query("hit_dedupe", f"""WITH h AS (SELECT label AS file_path, vec_id % 5 AS start_line, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS score, vec_id AS id FROM embeddings)
SELECT file_path, start_line, score, id FROM h QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY score DESC, id) = 1""")
def hit_dedupe(spark, d):
    h = A.chunks(spark, d).select("file_path", "start_line", F.round(Q.cosine(F.col("vector"), QUERY_VECTOR), 6).alias("score"), "id")
    return R.best_hits(h, ["file_path", "start_line"])


@query("technical_question", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{k}')" for k in V.TECHNICAL_KEYWORDS) + " AS technical FROM conversations")
def technical_question(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", S.is_technical(F.col("text")).alias("technical"))


@query("numbered_context", "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (turn + i) || ' | ' || x), chr(10)) AS context FROM conversations")
def numbered_context(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", S.numbered(F.col("text"), F.col("turn") + 1).alias("context"))


@query("session_message_counts", "SELECT conv_id, count(*)::BIGINT AS messages, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS answers, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_message_counts(spark, d):
    return A.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn"))


@query("message_order", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def message_order(spark, d):
    return A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("url_validation", r"""SELECT page_id, CASE WHEN contains(url, '\') OR contains(url, '..') THEN 'traversal' WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN contains(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '@') THEN 'credentials' ELSE 'host' END AS reason FROM pages""")
def url_validation(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.parse_repo_url(F.col("url")).alias("u")).select("page_id", "u.reason")


@query("url_normalize", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^', 'https://'), '^https://www\.', 'https://') AS url FROM pages")
def url_normalize(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.normalize_url(F.regexp_replace("url", r"^https?://(www\.)?", " www.")).alias("url"))


@query("page_links", """SELECT page_id, count(*)::BIGINT AS links, count(DISTINCT h)::BIGINT AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY page_id""")
def page_links(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("h").alias("targets"))


@query("quota_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, sum(round(value * 100)::BIGINT)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM events GROUP BY 1, 2")
def quota_daily(spark, d):
    return M.quota_daily(A.usage(spark, d))


@query("spend_usd", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, sum(round(value * 100)::BIGINT)::BIGINT AS tokens, round(sum(round(value * 100)::BIGINT)::BIGINT / 1000 * (CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RATES.items()) + " END), 4) AS usd FROM events GROUP BY 1, 2")
def spend_usd(spark, d):
    return M.spend(A.usage(spark, d), RATES)


@query("quota_breach", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, sum(round(value * 100)::BIGINT)::BIGINT AS tokens, greatest(0, 20000 - sum(round(value * 100)::BIGINT))::BIGINT AS remaining, sum(round(value * 100)::BIGINT) > 20000 AS blocked FROM events GROUP BY 1, 2")
def quota_breach(spark, d):
    return M.quota_breach(A.usage(spark, d), 20_000)


def _bucket_sql(c: str, bounds: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {b} THEN '{b}'" for b in bounds) + " ELSE '+Inf' END"


@query("stage_histogram", f"SELECT event_type AS stage, CASE WHEN user_id % 5 = 0 THEN 'error' ELSE 'success' END AS outcome, {_bucket_sql('value', V.STAGE_BUCKETS)} AS le, count(*)::BIGINT AS n, round(sum(value), 2) AS seconds FROM events GROUP BY 1, 2, 3")
def stage_histogram(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("user_id") % 5 == 0, "error").otherwise("success").alias("outcome"), F.col("value").cast("decimal(18,2)").alias("seconds"))
    return M.stage_histogram(e).withColumn("seconds", F.col("seconds").cast("double"))


@query("keepalive_gaps", "SELECT user_id, event_id, gap AS gap_us FROM (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap > 15000000")
def keepalive_gaps(spark, d):
    return M.keepalive_gaps(A.table(spark, d, "events"), "user_id")


@query("seq_complete", """WITH s AS (SELECT conv_id, turn + 1 AS seq FROM conversations WHERE (conv_id + turn) % 7 <> 3 UNION ALL SELECT conv_id, turn + 1 FROM conversations WHERE (conv_id + turn) % 11 = 4 AND (conv_id + turn) % 7 <> 3)
SELECT conv_id, max(seq)::BIGINT AS total_events, list_sort(list(seq)) = range(1, max(seq) + 1) AS complete, (max(seq) - count(DISTINCT seq))::BIGINT AS missing, (count(*) - count(DISTINCT seq))::BIGINT AS repeated FROM s GROUP BY conv_id""")
def seq_complete(spark, d):
    kept = A.table(spark, d, "conversations").where("(conv_id + turn) % 7 <> 3").select("conv_id", (F.col("turn") + 1).alias("seq"))
    twice = A.table(spark, d, "conversations").where("(conv_id + turn) % 11 = 4 and (conv_id + turn) % 7 <> 3").select("conv_id", (F.col("turn") + 1).alias("seq"))
    return M.sequence_complete(kept.unionByName(twice), "conv_id", "seq")


@query("offered_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS load FROM events")
def offered_load(spark, d):
    return M.offered_load(A.table(spark, d, "events"), "user_id", 3600).select("event_id", "load")


@query("rate_limiter", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS rn FROM events),
r AS (SELECT user_id, rn, [t] AS held, 1 AS ok, 0 AS no FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, ok + CASE WHEN len(live) < 2 THEN 1 ELSE 0 END, no + CASE WHEN len(live) < 2 THEN 0 ELSE 1 END
  FROM (SELECT e.user_id, e.rn, t, ok, no, list_filter(held, lambda x: x > t - 21600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, max(ok)::BIGINT AS accepted, max(no)::BIGINT AS rejected FROM r GROUP BY user_id""")
def rate_limiter(spark, d):
    return M.rate_limiter(A.table(spark, d, "events"), "user_id", 2, 6 * 3600)


@query("breaker_states", """WITH RECURSIVE e AS (SELECT user_id AS provider, epoch_us(ts) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type = 'purchase') AS rn FROM events),
r AS (SELECT provider, 0::BIGINT AS rn, 'closed' AS state, 0 AS run, 0::BIGINT AS since, 0::BIGINT AS opened FROM (SELECT DISTINCT provider FROM e) UNION ALL
  SELECT provider, rn, CASE WHEN now = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN now = 'half_open' OR run + 1 >= 5 THEN 'open' ELSE now END, CASE WHEN now = 'open' THEN run WHEN ok THEN 0 ELSE run + 1 END,
    CASE WHEN now <> 'open' AND NOT ok AND (now = 'half_open' OR run + 1 >= 5) THEN t ELSE since END, opened + CASE WHEN now <> 'open' AND NOT ok AND (now = 'half_open' OR run + 1 >= 5) THEN 1 ELSE 0 END
  FROM (SELECT e.provider, e.rn, t, ok, run, since, opened, CASE WHEN state = 'open' AND t - since >= 60000000 THEN 'half_open' ELSE state END AS now FROM r JOIN e ON e.provider = r.provider AND e.rn = r.rn + 1))
SELECT provider, state, opened FROM r QUALIFY row_number() OVER (PARTITION BY provider ORDER BY rn DESC) = 1""")
def breaker_states(spark, d):
    return M.breaker_states(A.table(spark, d, "events").select("ts", F.col("user_id").alias("provider"), (F.col("event_type") == "purchase").alias("ok")))


@query("islands_fold", """WITH s AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS st FROM events),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s)
SELECT user_id, island, min(event_type) AS event_type, count(*)::BIGINT AS repeat FROM i GROUP BY 1, 2""")
def islands_fold(spark, d):
    return R.islands(A.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("treemap_rollup", f"""WITH {FILES},
d AS (SELECT folder AS dir, size FROM files UNION ALL SELECT folder || '/' || language, size FROM files)
SELECT dir, count(*)::BIGINT AS files, sum(size)::BIGINT AS size FROM d GROUP BY dir""")
def treemap_rollup(spark, d):
    from ..operators import visual

    return visual.directory_sizes(A.files(spark, d))


@query("treemap_stats", f"WITH {FILES} SELECT count(*)::BIGINT AS total, least(count(*), 250)::BIGINT AS shown, count(*) > 250 AS truncated, count(loc)::BIGINT AS measured, min(loc) AS least, max(loc) AS most, quantile_cont(loc, 0.9)::DOUBLE AS p90 FROM files")
def treemap_stats(spark, d):
    from ..operators import visual

    return visual.treemap_stats(A.files(spark, d), "loc")


@query("mindmap_groups", f"""WITH {FILES}, top AS (SELECT id, name, language FROM files ORDER BY size DESC, id LIMIT 50),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY name, id) AS n FROM top)
SELECT language AS grp, count(*)::BIGINT AS files, string_agg(name, ',' ORDER BY n) FILTER (WHERE n <= 10) AS names FROM r GROUP BY language""")
def mindmap_groups(spark, d):
    from ..operators import visual

    return visual.mindmap(A.files(spark, d).orderBy(F.desc("size"), "id").limit(V.MINDMAP_FILES), "language")


@query("node_search", f"""WITH {FILES}, s AS (SELECT id, CASE WHEN contains(lower(name), 'bolt') THEN 3 ELSE 0 END + CASE WHEN contains(lower(path), 'bolt') THEN 2 ELSE 0 END + CASE WHEN contains(lower(language), 'bolt') THEN 1 ELSE 0 END AS score FROM files) SELECT id, score FROM s WHERE score > 0""")
def node_search(spark, d):
    from ..operators import visual

    return visual.node_search(A.files(spark, d), "bolt", "name", "path", "language").select("id", "score")


WORDS = ["simple", "HARD", "5", "42", "moderate complexity", "3/5", "complex (high)", "", "very complex", "nonsense", "-3", "low"]
WANT = [1, 5, 5, 9, 3, 3, 5, 3, 7, 3, 1, 1]


@query("complexity_words", f"SELECT p_partkey AS id, {WANT}[p_partkey % {len(WANT)} + 1]::INTEGER AS score FROM part")
def complexity_words(spark, d):
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % len(WORDS)).cast("int"))
    return A.files(spark, d).select("id", S.complexity_score(word).alias("score"))


def _named(c: str, table: dict, other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


ALIASES = [list(V.ROLES), list(V.EDGE_TYPES), list(V.NODE_TYPES)]


@query("role_names", f"""WITH a AS (SELECT p_partkey AS id, {[*ALIASES[0], "?"]}[p_partkey % {len(V.ROLES) + 1} + 1] AS r, {[*ALIASES[1], "?"]}[p_partkey % {len(V.EDGE_TYPES) + 1} + 1] AS e, {[*ALIASES[2], "?"]}[p_partkey % {len(V.NODE_TYPES) + 1} + 1] AS n FROM part)
SELECT id, {_named("r", V.ROLES, "'unknown'")} AS role, {_named("e", V.EDGE_TYPES, "'imports'")} AS edge_type, {_named("n", V.NODE_TYPES, "'other'")} AS node_type FROM a""")
def role_names(spark, d):
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in [*names, "?"]]), (F.col("id") % (len(names) + 1)).cast("int"))
    spoken = lambda names: F.concat(F.lit(" "), F.upper(F.translate(pick(names), "_", "-")))
    f = A.files(spark, d)
    return f.select("id", S.role_name(spoken(ALIASES[0])).alias("role"), S.edge_type(F.upper(pick(ALIASES[1]))).alias("edge_type"), S.node_type(F.upper(pick(ALIASES[2]))).alias("node_type"))


@query("nn_param_counts", f"""WITH {FILES} SELECT id, CASE id % 9 WHEN 0 THEN 72 * loc + 8 WHEN 1 THEN 10 * loc WHEN 2 THEN 72 * loc WHEN 4 THEN loc * 10 + 10 WHEN 5 THEN 2 * loc WHEN 6 THEN loc * 16 WHEN 7 THEN 8 * (loc * 4 + 20) WHEN 8 THEN 4 * loc * loc + 4 * loc END::BIGINT AS params FROM files""")
def nn_param_counts(spark, d):
    """A layer per file, of nine kinds."""
    from ..operators import networks

    n = F.col("loc").cast("string")
    kinds = [
        ("Conv2d", {"in_channels": n, "out_channels": "8", "kernel_size": "3"}), ("Conv2d", {"in_channels": n, "out_channels": n, "kernel_size": "(3, 3)", "groups": n}), ("Conv2d", {"in_channels": n, "out_channels": "8", "kernel_size": "3", "bias": "False"}),
        ("Conv2d", {"in_channels": n, "out_channels": "8", "kernel_size": "k"}), ("Linear", {"in_features": n, "out_features": "10"}), ("BatchNorm2d", {"num_features": n}), ("Embedding", {"num_embeddings": n, "embedding_dim": "16"}),
        ("LSTM", {"input_size": n, "hidden_size": "4", "bidirectional": "True", "num_layers": "1"}), ("MultiheadAttention", {"embed_dim": n, "num_heads": "1"}),
    ]
    args = [F.create_map(*[x for k, v in p.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))]) for _, p in kinds]
    pick = (F.col("id") % len(kinds)).cast("int")
    rows = A.files(spark, d).select("id", F.get(F.array(*[F.lit(k) for k, _ in kinds]), pick).alias("type"), F.get(F.array(*args), pick).alias("params"))
    return rows.select("id", networks.parameter_count(F.col("type"), F.col("params")).cast("long").alias("params"))


@query("technology_match", f"""WITH {FILES} SELECT id, CASE WHEN contains(lower(name), 'gear') THEN 'Gears' WHEN contains(lower(name), 'e') THEN 'Others' END AS technology FROM files""")
def technology_match(spark, d):
    return U.technologies(A.files(spark, d), "name", [("gear", "Gears"), ("e", "Others")]).select("id", "technology")


@query("bidirectional_response", f"""WITH {EDGES}, s AS (SELECT source, target, min(ord * 100 + line) AS pos FROM edges GROUP BY 1, 2)
SELECT a.source, a.target, CASE WHEN b.pos < a.pos THEN 'response' ELSE 'request' END AS direction FROM s a LEFT JOIN s b ON a.source = b.target AND a.target = b.source""")
def bidirectional_response(spark, d):
    s = A.edges(spark, d).groupBy("source", "target").agg(F.min(F.col("ord") * 100 + F.col("line")).alias("pos"))
    return U.mark_responses(s).select("source", "target", "direction")


@query("budget_selection", f"""WITH RECURSIVE {PROFILES},
s AS (SELECT folder, id::VARCHAR AS path, greatest(size // 4, 1)::BIGINT AS tokens, row_number() OVER (PARTITION BY folder ORDER BY round(greatest(0, 1.0::DOUBLE + CASE WHEN in_degree >= 5 THEN 5 ELSE 0 END + least(1.5::DOUBLE * in_degree, 7)), 2) DESC, id) AS rn FROM profiles),
r AS (SELECT folder, 0::BIGINT AS rn, 0::BIGINT AS used, 0 AS took, false AS over, false AS kept, NULL::VARCHAR AS path, 0::BIGINT AS tokens FROM (SELECT DISTINCT folder FROM s) UNION ALL
  SELECT s.folder, s.rn, CASE WHEN over OR took >= 30 THEN used WHEN used + s.tokens <= 80000 THEN used + s.tokens WHEN took = 0 THEN 80000 ELSE used END, took + CASE WHEN NOT over AND took < 30 AND (used + s.tokens <= 80000 OR took = 0) THEN 1 ELSE 0 END,
    over OR (took = 0 AND s.tokens > 80000), NOT over AND took < 30 AND (used + s.tokens <= 80000 OR took = 0), s.path, least(s.tokens, 80000) FROM r JOIN s ON r.folder = s.folder AND s.rn = r.rn + 1)
SELECT folder, path, tokens, over AND took = 1 AS truncated, took - 1 AS rank FROM r WHERE kept""")
def budget_selection(spark, d):
    p = A.profiles(spark, d).withColumn("score", L.selection_score(F.lit(None).cast("string"), F.col("in_degree") >= 5, F.lit(False), F.col("in_degree"), F.col("path")))
    return L.budget_select(p.select(F.col("folder"), F.col("id").alias("path"), "score", "size", F.col("id").alias("pos")), "folder")


@query("selection_scores", f"""WITH {PROFILES} SELECT id, round(greatest(0, 1.0::DOUBLE + CASE WHEN in_degree >= 5 THEN 5 ELSE 0 END + least(1.5::DOUBLE * in_degree, 7)), 2) AS score FROM profiles""")
def selection_scores(spark, d):
    p = A.profiles(spark, d)
    return p.select("id", L.selection_score(F.lit(None).cast("string"), F.col("in_degree") >= 5, F.lit(False), F.col("in_degree"), F.col("path")).alias("score"))


def _reach_sql(start: str, a: str, b: str, depth: int | None) -> str:
    limit = f" AND depth < {depth}" if depth else ""
    return f"""WITH RECURSIVE {DEG},
r(node, depth) USING KEY (node) AS (SELECT {start}, 0 UNION (SELECT DISTINCT {b}, depth + 1 FROM r JOIN pairs ON node = {a} WHERE {b} NOT IN (SELECT node FROM recurring.r){limit}))
SELECT node, depth FROM r"""


@query("bfs_depth3", _reach_sql("(SELECT min(source) FROM pairs)", "source", "target", 3))
def bfs_depth3(spark, d):
    e = A.edges(spark, d)
    return G.reach(e, e.agg(F.min("source").alias("node")), 3)


@query("trace_up", _reach_sql("(SELECT max(target) FROM pairs)", "target", "source", None))
def trace_up(spark, d):
    e = A.edges(spark, d)
    return G.reach(e, e.agg(F.max("target").alias("node")), None, reverse=True)


@query("components", f"""WITH RECURSIVE {EDGES},
ways AS MATERIALIZED (SELECT source AS a, target AS b FROM pairs UNION SELECT target, source FROM pairs),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM ways
  UNION (SELECT o.node, min(r.component) FROM recurring.r AS o JOIN ways ON o.node = ways.a JOIN r ON r.node = ways.b GROUP BY o.node, o.component HAVING min(r.component) < o.component))
SELECT node, component FROM r""")
def components(spark, d):
    return G.components(A.edges(spark, d))


DAG = f"""WITH RECURSIVE {EDGES}, dag AS MATERIALIZED (SELECT source, target FROM pairs WHERE source < target),
levels(node, level) USING KEY (node) AS (SELECT node, 0 FROM (SELECT source AS node FROM dag UNION SELECT target FROM dag)
  UNION (SELECT o.node, max(f.level) + 1 FROM levels AS f JOIN dag ON f.node = source JOIN recurring.levels AS o ON o.node = target GROUP BY o.node, o.level HAVING max(f.level) + 1 > o.level))"""


@query("dag_tiers", DAG + " SELECT node, level AS tier FROM levels")
def dag_tiers(spark, d):
    return G.dag_tiers(A.dag(spark, d))


@query("file_tiers", f"""WITH RECURSIVE {EDGES}, cyc AS (SELECT source AS a, target AS b FROM pairs UNION SELECT a, target FROM cyc JOIN pairs ON b = source),
strong AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS component FROM cyc x JOIN cyc y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
named AS MATERIALIZED (SELECT node, coalesce(component, node) AS component FROM (SELECT source AS node FROM pairs UNION SELECT target FROM pairs) LEFT JOIN strong USING (node)),
flat AS MATERIALIZED (SELECT DISTINCT a.component AS source, b.component AS target FROM pairs JOIN named a ON source = a.node JOIN named b ON target = b.node WHERE a.component <> b.component),
levels(node, level) USING KEY (node) AS (SELECT DISTINCT component, 0 FROM named
  UNION (SELECT o.node, max(f.level) + 1 FROM levels AS f JOIN flat ON f.node = source JOIN recurring.levels AS o ON o.node = target GROUP BY o.node, o.level HAVING max(f.level) + 1 > o.level))
SELECT named.node, component, level AS tier FROM named JOIN levels ON levels.node = component""")
def file_tiers(spark, d):
    return Z.tiers(A.edges(spark, d))


@query("kahn_levels", DAG + " SELECT node, level FROM levels")
def kahn_levels(spark, d):
    return G.kahn_levels(A.dag(spark, d))


# the last predecessor in order lies one level up, so a level needs the ranks of the one before only
KAHN = DAG + """,
base AS (SELECT level, sum(n) OVER (ORDER BY level) - n AS before FROM (SELECT level, count(*) AS n FROM levels GROUP BY level)),
ranks AS (SELECT node, 0 AS level, row_number() OVER (ORDER BY node) AS rank FROM levels WHERE level = 0
  UNION ALL SELECT node, level, (before + row_number() OVER (ORDER BY last, node))::BIGINT FROM (
    SELECT l.node, l.level, before, max(ranks.rank) AS last FROM ranks JOIN dag ON ranks.node = source JOIN levels l ON l.node = target AND l.level = ranks.level + 1 JOIN base ON base.level = l.level GROUP BY ALL))"""


@query("kahn_order", KAHN + " SELECT node, rank FROM ranks")
def kahn_order(spark, d):
    return G.kahn_order(A.dag(spark, d))


@query("whole_kahn_order", f"""WITH RECURSIVE {EDGES}, cyc AS (SELECT source AS a, target AS b FROM pairs UNION SELECT a, target FROM cyc JOIN pairs ON b = source),
lost AS MATERIALIZED (SELECT DISTINCT b AS node FROM cyc WHERE a IN (SELECT a FROM cyc WHERE a = b)), dag AS MATERIALIZED (SELECT source, target FROM pairs WHERE target NOT IN (FROM lost)),
levels(node, level) USING KEY (node) AS (SELECT node, 0 FROM (SELECT source AS node FROM pairs UNION SELECT target FROM pairs) WHERE node NOT IN (FROM lost)
  UNION (SELECT o.node, max(f.level) + 1 FROM levels AS f JOIN dag ON f.node = source JOIN recurring.levels AS o ON o.node = target GROUP BY o.node, o.level HAVING max(f.level) + 1 > o.level)){KAHN[len(DAG):]}
SELECT node, rank FROM ranks UNION ALL SELECT node, (SELECT count(*) FROM ranks) + row_number() OVER (ORDER BY node) FROM lost""")
def whole_kahn_order(spark, d):
    """G10, O3 on all edges: what peeling frees, in its order, and then what lies on cycles or behind them, by name."""
    e = A.edges(spark, d)
    freed = G.settle(G.kahn_order(e))
    lost = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(freed, "node", "left_anti")
    return freed.unionByName(G.in_order(lost, ["node"]).select("node", (F.lit(freed.count()) + F.col("place")).cast("long").alias("rank")))


@query("cycles_len2_3", f"""WITH {EDGES}
SELECT 2 AS length, a.source || ',' || a.target AS path FROM pairs a JOIN pairs b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target
UNION ALL SELECT 3, a.source || ',' || a.target || ',' || b.target FROM pairs a JOIN pairs b ON a.target = b.source JOIN pairs c ON b.target = c.source AND c.target = a.source
WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target""")
def cycles_len2_3(spark, d):
    c = G.cycles_bounded(A.edges(spark, d), 3)
    return c.select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


# every file's first import: a graph with one way out of each node, whose cycles have any length
FIRST_CYCLES = """main AS MATERIALIZED (SELECT source, first(target ORDER BY ord, line, target) AS target FROM edges GROUP BY source),
walk AS (SELECT source AS a, target AS b FROM main UNION SELECT a, target FROM walk JOIN main ON b = source),
ring AS (SELECT a AS id, min(b) AS root FROM walk WHERE a IN (SELECT a FROM walk WHERE a = b) GROUP BY a),
steps AS (SELECT DISTINCT root, root AS id, 0 AS n FROM ring UNION ALL SELECT root, target, n + 1 FROM steps JOIN main ON id = source WHERE target <> root),
cycles AS (SELECT string_agg(id::VARCHAR, ',' ORDER BY n) AS path, count(*)::INTEGER AS length FROM steps GROUP BY root)"""


def first_imports(spark, d) -> DataFrame:
    e = A.edges(spark, d).groupBy("source").agg(F.min(F.struct("ord", "line", "target")).alias("e"))
    return e.select("source", "e.target")


@query("long_cycles", f"WITH RECURSIVE {EDGES}, {FIRST_CYCLES} SELECT length, path FROM cycles")
def long_cycles(spark, d):
    return Z.cycles(first_imports(spark, d)).select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("label_disambiguation", r"""WITH RECURSIVE u AS (SELECT DISTINCT regexp_replace(url, '^https?://|[?#].*$|/$', '', 'g') AS id FROM pages),
r AS (SELECT 0 AS round, id, string_split(id, '/') AS parts, 1 AS k, true AS grow FROM u UNION ALL
  SELECT round + 1, id, parts, k + CASE WHEN clash AND k < len(parts) THEN 1 ELSE 0 END, clash AND k < len(parts) FROM (
    SELECT *, min(id) OVER (PARTITION BY array_to_string(parts[-k:], '/')) <> max(id) OVER (PARTITION BY array_to_string(parts[-k:], '/')) AS clash, bool_or(grow) OVER () AS more FROM r) WHERE more)
SELECT id, array_to_string(parts[-k:], '/') AS label FROM r WHERE round = (SELECT max(round) FROM r)""")
def label_disambiguation(spark, d):
    return R.disambiguate(A.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://|[?#].*$|/$", "").alias("id")).distinct())


@query("folder_labels", f"""WITH {FILES}, u AS (SELECT DISTINCT folder || '/' || language AS id FROM files), b AS (SELECT id, string_split(id, '/') AS parts, string_split(id, '/')[-1] AS g FROM u),
m AS (SELECT *, count(*) OVER (PARTITION BY g) AS members, max(len(parts)) OVER (PARTITION BY g) AS deepest FROM b),
l AS (SELECT id, g, k, deepest, array_to_string(parts[-k:], '/') AS label FROM (SELECT *, unnest(range(CASE WHEN members > 1 THEN 2 ELSE 1 END, greatest(deepest, 2) + 1)) AS k FROM m)),
ok AS (SELECT g, k, count(DISTINCT label) = count(DISTINCT id) AS ok, max(deepest) AS deepest FROM l GROUP BY g, k), best AS (SELECT g, coalesce(min(k) FILTER (WHERE ok), max(deepest)) AS best FROM ok GROUP BY g)
SELECT id, label FROM l JOIN best ON l.g = best.g AND k = best""")
def folder_labels(spark, d):
    return R.folder_labels(A.files(spark, d).select(S.dirname(F.col("path")).alias("id")).distinct())


@query("language_counts", f"WITH {FILES} SELECT language, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY language")
def language_counts(spark, d):
    return U.language_counts(A.files(spark, d))


@query("common_dirs", f"WITH {FILES} SELECT language, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) || '/' || language END AS common_dir FROM files GROUP BY language")
def common_dirs(spark, d):
    return U.common_dir(A.files(spark, d), "language")


@query("folder_buckets", f"""WITH {FILES} SELECT folder AS layer, language AS bucket, count(*)::BIGINT AS files FROM files GROUP BY 1, 2""")
def folder_buckets(spark, d):
    b = U.folder_buckets(A.files(spark, d).select(F.col("folder").alias("layer"), "path"))
    return b.groupBy("layer", "bucket").agg(F.count(F.lit(1)).alias("files"))


@query("containers", f"""WITH {FILES} SELECT folder || '__' || replace(lower(language), '#', '-') AS id, folder AS layer, language AS name, count(*)::BIGINT AS files FROM files GROUP BY 1, 2, 3
""")
def containers(spark, d):
    b = U.folder_buckets(A.files(spark, d).select(F.col("folder").alias("layer"), "path"))
    return U.containers(b)


@query("communities")
def communities(spark, d):
    f = A.files(spark, d).select(F.col("language").alias("layer"), F.col("id").cast("string").alias("path"))
    e = A.edges(spark, d).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return G.label_propagation(f, e)


@query("middle_cut", "SELECT doc_id, length(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || '... [truncated] ...' || chr(10) || right(text, 500) END)::BIGINT AS chars, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || '... [truncated] ...' || chr(10) || right(text, 500) END) AS digest FROM documents")
def middle_cut(spark, d):
    cut = S.middle_cut(F.col("text"), 1000)
    return A.table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


@query("text_chunks")
def text_chunks(spark, d):
    return Q.chunk(A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), "tables")
