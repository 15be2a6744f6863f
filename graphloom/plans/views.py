"""Registered queries of the assembled graph, the views and the dataflow, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from ..operators import assembly as Y
from ..operators import degrees as D
from ..operators import flow as W
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import roles as L
from ..operators import rollup as U
from ..operators import strong as Z
from ..operators import tours as T
from ..operators import visual as X
from . import adapters as A
from .catalogue import EDGES, FILES, FIRST_CYCLES, FLAGS, IMPORTANCE, PROFILES, flagged, long_cycles, module_connections, module_weights, query, scored

ROLES = sorted(V.ROLE_LAYERS)
ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"


def roled(spark, d) -> DataFrame:
    """Files with one of all roles by key: id, path, role, in and out degree, importance, language, size."""
    names = F.array(*[F.lit(r) for r in ROLES])
    return scored(spark, d).withColumn("role", F.get(names, (F.col("id") % len(ROLES)).cast("int")))


def _case(c: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


STATIC = {k: v for k, v in V.ROLE_LAYERS.items() if k not in ("leaf", "barrel")} | {"documentation": "documentation"}
ROLED = IMPORTANCE + f""",
roled AS (SELECT *, {ROLE_SQL}[id % {len(ROLES)} + 1] AS role FROM scored)"""
LAYERED = ROLED + f""",
stat AS (SELECT id, path, role, {_case("role", STATIC)} AS layer FROM roled),
votes AS (SELECT target AS id, layer, count(*) AS n FROM pairs JOIN stat ON source = stat.id WHERE layer IS NOT NULL GROUP BY 1, 2),
modal AS (SELECT id, layer FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, layer) = 1),
layered AS (SELECT s.id, s.path, s.role, coalesce(s.layer, m.layer, 'other') AS layer FROM stat s LEFT JOIN modal m ON s.id = m.id)"""


def layered(spark, d) -> DataFrame:
    """Layers of files by their keys: path (the key), layer."""
    return U.assign_layers(roled(spark, d).select(F.col("id").alias("path"), "role"), A.edges(spark, d))


@query("layer_assignment", f"WITH {LAYERED} SELECT id AS path, layer FROM layered")
def layer_assignment(spark, d):
    return layered(spark, d)


@query("semantic_layers", f"""WITH {ROLED}, s AS (SELECT id, path, folder, {_case("role", V.ROLE_LAYERS)} AS layer FROM roled),
i AS (SELECT a.layer, count(*)::BIGINT AS n FROM pairs JOIN s a ON source = a.id JOIN s b ON target = b.id WHERE a.layer = b.layer GROUP BY 1)
SELECT s.layer, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) || ' — ' ELSE '' END || count(*) || ' files' AS label, count(*)::BIGINT AS file_count, coalesce(max(i.n), 0)::BIGINT AS internal_edges
FROM s LEFT JOIN i ON s.layer = i.layer GROUP BY s.layer""")
def semantic_layers(spark, d):
    r = roled(spark, d).select("id", F.col("id").alias("key"), "path", S.lookup(V.ROLE_LAYERS, F.col("role")).alias("layer"))
    e = A.edges(spark, d).select("source", "target").distinct()
    names = r.select("id", "path")
    pathed = e.join(names.select(F.col("id").alias("source"), F.col("path").alias("sp")), "source").join(names.select(F.col("id").alias("target"), F.col("path").alias("tp")), "target").select(F.col("sp").alias("source"), F.col("tp").alias("target"))
    return Y.semantic_layers(pathed, r.select("path", "layer"))


@query("semantic_connections", f"""WITH {ROLED}, s AS (SELECT id, {_case("role", V.ROLE_LAYERS)} AS layer FROM roled)
SELECT a.layer AS source, b.layer AS target, count(*)::BIGINT AS pairs FROM pairs JOIN s a ON source = a.id JOIN s b ON target = b.id WHERE a.layer <> b.layer GROUP BY 1, 2""")
def semantic_connections(spark, d):
    pairs = Y.layer_pairs(A.edges(spark, d), roled(spark, d).select(F.col("id").alias("path"), S.lookup(V.ROLE_LAYERS, F.col("role")).alias("layer")))
    return U.layer_connections(pairs, F.col("source_layer"), F.col("target_layer"))


@query("layer_tiers")
def layer_tiers(spark, d):
    return Y.layer_tiers(A.edges(spark, d), layered(spark, d))


@query("graph_freshness", f"""WITH {ROLED} SELECT md5(count(*) || ':' || sum(('0x' || substr(md5(path || ':' || size || ':' || role || ':' || in_degree || ':' || out_degree), 1, 15))::BIGINT)) AS fingerprint FROM roled""")
def graph_freshness(spark, d):
    return Y.freshness(roled(spark, d))


BOXED = LAYERED + """,
boxes AS (SELECT l.id, l.layer, folder AS bucket, count(*) OVER (PARTITION BY l.layer, folder) AS n, count(*) OVER (PARTITION BY l.layer) AS all_n FROM layered l JOIN files f ON l.id = f.id),
boxed AS (SELECT id, layer, CASE WHEN n = 1 AND all_n >= 3 THEN 'standalone' ELSE bucket END AS bucket FROM boxes)"""


def boxed(spark, d) -> DataFrame:
    """Buckets of every layer's files with lone ones merged: layer, path, bucket, id."""
    f = layered(spark, d).withColumnRenamed("path", "id").join(A.files(spark, d).select("id", "path"), "id")
    return U.merge_singles(U.folder_buckets(f))


@query("merged_containers", f"""WITH {BOXED} SELECT layer || '__' || regexp_replace(regexp_replace(lower(bucket), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id, layer, bucket AS name, count(*)::BIGINT AS files FROM boxed GROUP BY 1, 2, 3""")
def merged_containers(spark, d):
    return U.containers(boxed(spark, d))


@query("bucket_fallback", f"""WITH {BOXED}, c AS (SELECT layer, bucket, count(*) AS n FROM boxes GROUP BY 1, 2) SELECT layer, count(*) < 2 OR max(n) > 0.70 * sum(n) AS fallback FROM c GROUP BY layer""")
def bucket_fallback(spark, d):
    f = layered(spark, d).withColumnRenamed("path", "id").join(A.files(spark, d).select("id", "path"), "id")
    return U.needs_communities(U.folder_buckets(f))


@query("assembled_files", f"""WITH RECURSIVE {BOXED.replace(IMPORTANCE, FLAGS, 1)}
SELECT g.id AS path, b.layer, b.layer || '__' || regexp_replace(regexp_replace(lower(bucket), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS container, importance, in_degree, out_degree,
  concat_ws(',', CASE WHEN orphan THEN 'orphan' END, CASE WHEN in_cycle THEN 'in_cycle' END, CASE WHEN hub THEN 'hub' END, CASE WHEN entry_point THEN 'entry_point' END, CASE WHEN god_file THEN 'god_file' END) AS flags
FROM flagged g JOIN boxed b ON g.id = b.id""")
def assembled_files(spark, d):
    return Y.assembled_files(flagged(spark, d).withColumn("path", F.col("id")), layered(spark, d), boxed(spark, d).withColumn("path", F.col("id")))


@query("layer_cards", f"""WITH RECURSIVE {LAYERED.replace(IMPORTANCE, FLAGS, 1)},
f AS (SELECT layer, flag, n FROM (SELECT layer, unnest(['orphan', 'in_cycle', 'hub', 'entry_point', 'god_file']) AS flag, unnest([count(*) FILTER (WHERE orphan), count(*) FILTER (WHERE in_cycle), count(*) FILTER (WHERE hub), count(*) FILTER (WHERE entry_point), count(*) FILTER (WHERE god_file)]) AS n, unnest([1, 2, 3, 4, 5]) AS at FROM flagged g JOIN layered l ON g.id = l.id GROUP BY layer) WHERE n > 0),
t AS (SELECT layer, string_agg(flag || ':' || n, ',' ORDER BY list_position(['orphan', 'in_cycle', 'hub', 'entry_point', 'god_file'], flag)) AS flag_counts, count(*) AS k FROM f GROUP BY layer),
o AS (SELECT a.layer, count(*) AS n FROM edges JOIN layered a ON source = a.id JOIN layered b ON target = b.id WHERE a.layer <> b.layer GROUP BY 1)
SELECT l.layer, count(*)::BIGINT AS files, coalesce(max(flag_counts), '') AS flag_counts, coalesce(max(o.n), 0)::BIGINT AS out_count, (56 + 16 * (1 + coalesce(max(t.k), 0) + CASE WHEN coalesce(max(o.n), 0) > 0 THEN 1 ELSE 0 END))::BIGINT AS height
FROM layered l LEFT JOIN t ON l.layer = t.layer LEFT JOIN o ON l.layer = o.layer GROUP BY l.layer""")
def layer_cards(spark, d):
    return Y.layer_cards(flagged(spark, d).select(F.col("id").alias("path"), "flags"), A.edges(spark, d), layered(spark, d))


@query("cycle_summary", f"""WITH RECURSIVE {EDGES}, {FIRST_CYCLES} SELECT count(*) > 0 AS has_cycles, count(*)::BIGINT AS cycle_count,
CASE count(*) WHEN 0 THEN 'No circular dependencies detected.' WHEN 1 THEN '1 circular dependency detected: ' || replace(min(path), ',', ' → ') ELSE count(*) || ' circular dependencies detected.' END AS summary FROM cycles""")
def cycle_summary(spark, d):
    return Y.cycle_summary(long_cycles(spark, d).select(F.split("path", ",").alias("path")))


@query("insights", f"""WITH RECURSIVE {FLAGS},
strong AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS component FROM cyc x JOIN cyc y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
central AS (SELECT file, row_number() OVER (ORDER BY 3 * in_degree + out_degree DESC, file) AS place FROM deg)
SELECT 'cycle' AS kind, component, NULL::BIGINT AS place, node::VARCHAR AS item FROM strong
UNION ALL SELECT 'cycle_import', a.component, NULL, source || ',' || target FROM pairs JOIN strong a ON source = a.node JOIN strong b ON target = b.node WHERE a.component = b.component
UNION ALL SELECT 'orphan', NULL, NULL, id::VARCHAR FROM flagged WHERE orphan
UNION ALL SELECT 'central', NULL, place, file::VARCHAR FROM central WHERE place <= 30 UNION ALL SELECT 'entry_point', NULL, NULL, id::VARCHAR FROM flagged WHERE entry_point""")
def insights(spark, d):
    e = A.edges(spark, d)
    strong = Z.strong_components(e)
    f = flagged(spark, d, strong)
    return Y.insights(G.settle(Z.inside(e, strong)), f, D.central_files(e), f.where("is_entry").select(F.col("id").alias("file")))


@query("role_summary", f"WITH {ROLED} SELECT role, count(*)::BIGINT AS files, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM roled), 1) AS pct FROM roled GROUP BY role")
def role_summary(spark, d):
    return L.role_summary(roled(spark, d))


@query("repo_type", f"""WITH {FILES}, r AS (SELECT folder, ['ml_model', 'router', 'leaf', 'config', 'entry_point', 'build', 'leaf'][(id * 7 + loc) % 7 + 1] AS role, language LIKE '%3' AS web, id FROM files WHERE true)
SELECT folder, CASE WHEN bool_or(role = 'ml_model' AND id % 11 = 0) THEN 'ml_pipeline' WHEN bool_or(role = 'router' AND id % 5 = 0) THEN CASE WHEN bool_or(web AND id % 13 = 0) THEN 'web_app' WHEN bool_or(role = 'build' AND id % 17 = 0) OR bool_or(role = 'config' AND id % 7 = 0) THEN 'microservice' ELSE 'web_app' END
  WHEN bool_or(role = 'entry_point') THEN 'cli_tool' ELSE 'library' END AS repo_type FROM r GROUP BY folder""")
def repo_type(spark, d):
    """A14 of every folder as a repository; rare roles are thinned out so that all kinds occur."""
    f = A.files(spark, d)
    drawn = F.get(F.array(*[F.lit(x) for x in ("ml_model", "router", "leaf", "config", "entry_point", "build", "leaf")]), ((F.col("id") * 7 + F.col("loc")) % 7).cast("int"))
    rare = {"ml_model": 11, "router": 5, "build": 17, "config": 7}
    role = F.col("drawn")
    for name, n in rare.items():
        role = F.when((F.col("drawn") == name) & (F.col("id") % n != 0), "leaf").otherwise(role)
    p = f.withColumn("drawn", drawn).select("folder", role.alias("role"), F.array(F.lit("infrastructure")).alias("tags"), F.when(F.col("language").endswith("3") & (F.col("id") % 13 == 0), ".html").otherwise(".py").alias("extension"))
    return L.repo_type(p, by=["folder"])


_tier = {k: str(v[0]) for k, v in V.ROLE_STAGES.items()}
_kind = {k: v[1] for k, v in V.ROLE_STAGES.items()}


@query("stages", f"""WITH {ROLED} SELECT role, ({_case("role", _tier)})::INTEGER AS tier, {_case("role", _kind)} AS kind, count(*)::BIGINT AS files, {_case(_case("role", _kind), V.STAGE_SHAPES)} AS shape FROM roled WHERE {_case("role", _kind)} IS NOT NULL GROUP BY role""")
def stages(spark, d):
    return U.stages(roled(spark, d))


@query("stage_edges", f"""WITH {ROLED}, k AS (SELECT id, role FROM roled WHERE {_case("role", _kind)} IS NOT NULL)
SELECT a.role AS source, b.role AS target, count(*)::BIGINT AS imports FROM pairs JOIN k a ON source = a.id JOIN k b ON target = b.id WHERE a.role <> b.role GROUP BY 1, 2""")
def stage_edges(spark, d):
    return U.stage_edges(A.edges(spark, d), roled(spark, d).select(F.col("id").alias("path"), "role"))


MODULES = f"""{IMPORTANCE}, m AS (SELECT folder AS module, count(*)::BIGINT AS file_count, round(sum(round(importance * 100)::BIGINT)::DOUBLE / (count(*) * 100), 2) AS importance FROM scored GROUP BY 1),
c AS (SELECT a.folder AS source, b.folder AS target, count(*)::BIGINT AS weight FROM edges JOIN files a ON edges.source = a.id JOIN files b ON edges.target = b.id WHERE a.folder <> b.folder GROUP BY 1, 2),
w AS (SELECT module, coalesce((SELECT sum(weight) FROM c WHERE target = module), 0)::BIGINT AS i, coalesce((SELECT sum(weight) FROM c WHERE source = module), 0)::BIGINT AS o FROM m)"""


def modules(spark, d) -> DataFrame:
    return scored(spark, d).groupBy(S.module(F.col("path"), 1).alias("module")).agg(F.count(F.lit(1)).alias("file_count"), F.round(F.sum(F.round(F.col("importance") * 100).cast("long")) / (F.count(F.lit(1)) * 100), 2).alias("importance"))


_infer = "CASE " + " ".join(f"WHEN regexp_matches(lower(m.module), '{p}') THEN '{k}'" for k, p in V.FOLDER_KINDS.items()) + " ELSE 'module' END"


@query("module_view", f"""WITH {MODULES} SELECT m.module, {_infer} AS type, round(least(22 + 5 * sqrt(file_count), 55), 3) AS radius, CASE WHEN i + o >= 10 THEN 'xl' WHEN i + o >= 6 THEN 'lg' WHEN i + o >= 3 THEN 'md' WHEN i + o >= 1 THEN 'sm' ELSE 'xs' END AS size FROM m JOIN w ON m.module = w.module""")
def module_view(spark, d):
    return Y.module_view(modules(spark, d), module_weights(spark, d))


@query("module_drill_in", f"""WITH {EDGES}, {FILES}, one AS (SELECT min(folder) AS module FROM files), k AS (SELECT id FROM files, one WHERE folder = module)
SELECT DISTINCT source, target FROM edges WHERE source IN (FROM k) AND target IN (FROM k)""")
def module_drill_in(spark, d):
    f = A.files(spark, d).select("id", F.col("folder").alias("module"))
    first = f.agg(F.min("module")).first()[0]
    return Y.drill_in(first, f, A.edges(spark, d))[1].select("source", "target").distinct()


@query("module_mermaid", f"""WITH {MODULES}, t AS (SELECT module, file_count, 'm' || (row_number() OVER (ORDER BY importance DESC, module) - 1) AS alias, row_number() OVER (ORDER BY importance DESC, module) AS n FROM m QUALIFY n <= 50)
SELECT 'flowchart LR' || chr(10) || (SELECT string_agg('    ' || alias || '["' || module || ' (' || file_count || ' files)"]', chr(10) ORDER BY n) FROM t)
  || coalesce(chr(10) || (SELECT string_agg('    ' || a.alias || CASE WHEN weight > 1 THEN ' -- "' || weight || '" --> ' ELSE ' --> ' END || b.alias, chr(10) ORDER BY source, target) FROM c JOIN t a ON source = a.module JOIN t b ON target = b.module), '') AS mermaid""")
def module_mermaid(spark, d):
    return Y.mermaid_modules(modules(spark, d), module_connections(spark, d))


TOP = IMPORTANCE + """,
top AS (SELECT id, name, folder, importance FROM scored ORDER BY importance DESC, id LIMIT 20),
inner_edges AS (SELECT DISTINCT source, target FROM edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top))"""


def _top(spark, d) -> tuple[DataFrame, DataFrame]:
    top = scored(spark, d).orderBy(F.desc("importance"), "id").limit(20).select(F.col("id").cast("string").alias("id"), F.col("folder").alias("group"), F.col("name").alias("label"), "importance")
    e = A.edges(spark, d).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct()
    return top, G.induced(e, top.select(F.col("id").alias("node")))


@query("dot_export", f"""WITH {TOP}, g AS (SELECT folder, string_agg('    "' || id || '" [label="' || name || '"];', chr(10) ORDER BY '    "' || id || '" [label="' || name || '"];') AS body FROM top GROUP BY folder)
SELECT 'digraph dependencies {{' || chr(10) || (SELECT string_agg('  subgraph "cluster_' || folder || '" {{' || chr(10) || body || chr(10) || '  }}', chr(10) ORDER BY folder) FROM g) || chr(10)
  || coalesce((SELECT string_agg('  "' || source || '" -> "' || target || '";', chr(10) ORDER BY '  "' || source || '" -> "' || target || '";') FROM inner_edges), '') || chr(10) || '}}' AS dot""")
def dot_export(spark, d):
    return X.dot(*_top(spark, d))


@query("mermaid_export", f"""WITH {TOP}, a AS (SELECT id, name, 'n' || (row_number() OVER (ORDER BY folder, id::VARCHAR) - 1) AS alias FROM top)
SELECT 'graph TD' || chr(10) || (SELECT string_agg('  ' || alias || '["' || name || '"]', chr(10) ORDER BY '  ' || alias || '["' || name || '"]') FROM a) || chr(10)
  || coalesce((SELECT string_agg('  ' || s.alias || ' --> ' || t.alias, chr(10) ORDER BY '  ' || s.alias || ' --> ' || t.alias) FROM inner_edges JOIN a s ON source = s.id JOIN a t ON target = t.id), '') AS mermaid""")
def mermaid_export(spark, d):
    return X.mermaid(*_top(spark, d))


@query("graph_etag", f"""WITH {TOP} SELECT md5(to_json(list({{'id': id::VARCHAR, 'group': folder}} ORDER BY id::VARCHAR))) AS etag FROM top""")
def graph_etag(spark, d):
    from ..operators import storage

    top = _top(spark, d)[0].select("id", "group")
    return top.agg(F.array_sort(F.collect_list(F.struct("id", "group"))).alias("all")).select(storage.etag(F.col("all")).alias("etag"))


@query("lanes", f"""WITH {ROLED}, l AS (SELECT DISTINCT coalesce(nullif(lower(CASE WHEN id % 5 = 0 THEN role ELSE {_case("role", V.ROLE_LAYERS)} END), ''), 'other') AS lane FROM roled)
SELECT lane, CASE WHEN list_position([{", ".join(f"'{x}'" for x in V.LANE_ORDER)}], lane) > 0 THEN list_position([{", ".join(f"'{x}'" for x in V.LANE_ORDER)}], lane) - 1 ELSE 99 END::BIGINT AS rank FROM l""")
def lanes(spark, d):
    r = roled(spark, d)
    return Y.lanes(r.select(F.when(F.col("id") % 5 == 0, F.col("role")).otherwise(S.lookup(V.ROLE_LAYERS, F.col("role"))).alias("type")))


@query("known_layer_edges", f"""WITH {EDGES}, k AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0) SELECT source, target, ord, line FROM edges WHERE source IN (FROM k) AND target IN (FROM k)""")
def known_layer_edges(spark, d):
    return Y.known_edges(A.edges(spark, d).select("source", "target", "ord", "line"), A.files(spark, d).where("id % 3 <> 0"))


@query("architecture_nodes", f"""WITH {ROLED}, l AS (SELECT id, path, string_split(path, '/')[-1] AS label, {_case("role", V.ROLE_LAYERS)} AS lane FROM roled)
SELECT path AS id, label, CASE WHEN lane <> 'other' THEN lane ELSE CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(path), '{k}')" for k in words) + f" THEN '{layer}'" for layer, words in V.LAYER_KEYWORDS)} ELSE 'other' END END AS type FROM l""")
def architecture_nodes(spark, d):
    return Y.architecture(roled(spark, d).select(F.col("path").alias("id"), "role"))


@query("folder_nodes", f"""WITH {FILES}, m AS (SELECT DISTINCT folder AS id FROM files ORDER BY id LIMIT 40)
SELECT id, CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(id), '{k}')" for k in words) + f" THEN '{layer}'" for layer, words in V.LAYER_KEYWORDS)} ELSE 'other' END AS type FROM m""")
def folder_nodes(spark, d):
    return Y.folder_fallback(A.files(spark, d))


@query("diagnostics", f"""WITH {EDGES}, {FILES}, u AS (SELECT count(*) AS n FROM imports WHERE target IS NULL OR target = source)
SELECT (SELECT round(count(*)::DOUBLE / (count(*) + (SELECT n FROM u)), 3) FROM edges) AS resolved_share, (SELECT coalesce(string_agg(language, ',' ORDER BY language), '') FROM (SELECT DISTINCT language FROM files) WHERE language NOT IN ('Brand#11', 'Brand#22', 'Unknown')) AS unsupported""")
def diagnostics(spark, d):
    lost = A.imports(spark, d).where("target is null or target = source").count()
    return Y.diagnostics(A.edges(spark, d), A.files(spark, d), lost, ["Brand#11", "Brand#22"])


TILES = FILES + """,
tiles AS (SELECT id, path, language, size, loc, CASE WHEN id % 4 <> 0 THEN (size // 1000) % 97 + 1 END AS complexity FROM files),
ends AS (SELECT min(complexity) AS lo, max(complexity) AS hi, quantile_cont(complexity, 0.9)::DOUBLE AS p90 FROM tiles)"""


def tiles(spark, d) -> DataFrame:
    return A.files(spark, d).withColumn("complexity", F.when(F.col("id") % 4 != 0, F.floor(F.col("size") / 1000) % 97 + 1))


@query("hotspot_notes", f"""WITH {TILES} SELECT id, CASE WHEN complexity IS NULL THEN 'Complexity not measured — no parser for ' || language || ' files. Area still reflects file size.' WHEN hi = lo THEN 'Only one distinct complexity value in this repository.'
WHEN complexity >= hi THEN 'Highest complexity in the repository.' WHEN complexity >= p90 THEN 'Top 10% by complexity — a likely maintenance hotspot.' WHEN loc * 10 > 300 AND complexity / (loc * 10) < 0.05 THEN 'Long but simple — lots of lines, little branching.'
WHEN loc * 10 > 0 AND loc * 10 < 120 AND complexity / (loc * 10) > 0.2 THEN 'Small but dense — heavy branching packed into few lines.' ELSE 'Around the ' || floor((complexity - lo) / (hi - lo) * 100 + 0.5)::BIGINT || 'th percentile for complexity here.' END AS note FROM tiles, ends""")
def hotspot_notes(spark, d):
    t = tiles(spark, d)
    stats = X.treemap_stats(t, "complexity").select("least", "most", "p90")
    j = t.crossJoin(F.broadcast(stats))  # one row
    return j.select("id", Y.hotspot_note(F.col("complexity"), F.col("loc") * 10, F.col("language"), F.col("least"), F.col("most"), F.col("p90")).alias("note"))


@query("tile_texts", f"""WITH {TILES} SELECT id, path || ', ' || language || ', ' || format('{{:,}}', size) || ' bytes, ' || loc || ' lines, ' || CASE WHEN complexity IS NULL THEN 'complexity not measured' ELSE 'complexity ' || complexity END AS text FROM tiles""")
def tile_texts(spark, d):
    t = tiles(spark, d)
    return t.select("id", Y.tile_text(F.col("path"), F.col("language"), F.col("size"), F.col("loc"), F.col("complexity").cast("long")).alias("text"))


@query("node_universe", f"""WITH {EDGES} SELECT source AS id FROM edges UNION SELECT target FROM edges UNION SELECT p_partkey FROM part""")
def node_universe(spark, d):
    return G.universe(A.edges(spark, d), A.files(spark, d))


@query("induced_edges", f"""WITH {EDGES} SELECT source, target, ord, line FROM edges WHERE source % 4 = 1 AND target % 4 = 1""")
def induced_edges(spark, d):
    keep = A.files(spark, d).where("id % 4 = 1").select(F.col("id").alias("node"))
    return G.induced(A.edges(spark, d).select("source", "target", "ord", "line"), keep)


@query("neighbours", f"""WITH {EDGES} SELECT source AS node, target AS other FROM pairs UNION SELECT target, source FROM pairs""")
def neighbours(spark, d):
    return G.neighbours(A.edges(spark, d))


@query("profile_order", f"""WITH {IMPORTANCE} SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS place FROM scored""")
def profile_order(spark, d):
    return R.profile_order(scored(spark, d), "id").select("id", F.col("place").cast("long").alias("place"))


@query("selected_flags", f"WITH RECURSIVE {FLAGS} SELECT id FROM flagged WHERE hub OR god_file")
def selected_flags(spark, d):
    return W.flagged_shown(flagged(spark, d), ["hub", "god_file"]).select("id")


# the returned lines as a flow between files: kinds by key, responses by order
FLOW = EDGES + """,
steps AS (SELECT source, target, min(ord * 100 + line) AS pos FROM edges GROUP BY 1, 2),
flow AS (SELECT a.*, CASE WHEN b.pos < a.pos THEN 'response' ELSE 'request' END AS direction FROM steps a LEFT JOIN steps b ON a.source = b.target AND a.target = b.source),
nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 7 THEN 'Dashboard ' || p_partkey ELSE p_name END AS label, ['io', 'process', 'transform', 'data_store'][p_partkey % 4 + 1] AS kind, p_size AS tier FROM part)"""


def flow(spark, d) -> tuple[DataFrame, DataFrame]:
    e = A.edges(spark, d).groupBy("source", "target").agg(F.min(F.col("ord") * 100 + F.col("line")).alias("pos"))
    kinds = F.array(*[F.lit(x) for x in ("io", "process", "transform", "data_store")])
    n = A.files(spark, d).select("id", F.when(F.col("id") % 50 == 7, F.concat(F.lit("Dashboard "), F.col("id").cast("string"))).otherwise(F.col("name")).alias("label"), F.get(kinds, (F.col("id") % 4).cast("int")).alias("kind"), F.col("loc").alias("tier"))
    return n, U.mark_responses(e)


DEG_SQL = "dd AS (SELECT file, sum(i) AS i, sum(o) AS o FROM (SELECT source AS file, 0 AS i, 1 AS o FROM pairs UNION ALL SELECT target, 1, 0 FROM pairs) GROUP BY file)"


@query("flow_nodes", f"""WITH {FLOW}, {DEG_SQL}
SELECT id, label, CASE WHEN contains(lower(label), 'dashboard') THEN 'end' WHEN kind = 'io' THEN CASE WHEN coalesce(i, 0) > 0 AND coalesce(o, 0) = 0 THEN 'end' ELSE 'start' END WHEN kind = 'process' THEN 'action' ELSE kind END AS kind,
  {_case("kind", V.STAGE_SHAPES)} AS shape, tier, '' AS description FROM nodes LEFT JOIN dd ON nodes.id = dd.file""")
def flow_nodes(spark, d):
    n, _ = flow(spark, d)
    deg = D.degrees(A.edges(spark, d)).withColumnRenamed("file", "id")
    return W.flow_nodes(n.join(deg, "id", "left").select("id", "label", F.col("kind").alias("type"), F.lit(None).cast("string").alias("shape"), "tier", F.lit(None).cast("string").alias("description"), "in_degree", "out_degree"))


@query("shown_kinds", f"""WITH {FLOW}, t AS (SELECT source, target, CASE WHEN pos % 3 = 0 THEN 'db' ELSE 'http' END AS type FROM flow)
SELECT source, target, a.kind NOT IN ('io', 'process') OR b.kind NOT IN ('io', 'process') AS dim FROM t JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id WHERE type = 'http'""")
def shown_kinds(spark, d):
    n, e = flow(spark, d)
    typed = e.select("source", "target", F.when(F.col("pos") % 3 == 0, "db").otherwise("http").alias("type"))
    return W.kinds_shown(n, typed, ["io", "process"], ["http"])[1].select("source", "target", "dim")


@query("traced_highlights", f"""WITH RECURSIVE {FLOW}, asked AS MATERIALIZED (SELECT source, target FROM flow WHERE direction <> 'response'), s AS (SELECT max(target) AS id FROM pairs),
up(id) USING KEY (id) AS (SELECT id FROM s UNION (SELECT DISTINCT source FROM up JOIN asked ON up.id = target WHERE source NOT IN (FROM recurring.up))),
down(id) USING KEY (id) AS (SELECT id FROM s UNION (SELECT DISTINCT target FROM down JOIN asked ON down.id = source WHERE target NOT IN (FROM recurring.down)))
SELECT id, CASE WHEN id = (SELECT id FROM s) THEN 'select' WHEN id IN (FROM up) THEN 'trace-up' WHEN id IN (FROM down) THEN 'trace-down' ELSE 'dim' END AS highlight FROM nodes""")
def traced_highlights(spark, d):
    n, e = flow(spark, d)
    return W.highlights(n, e, trace_from=e.agg(F.max("target")).first()[0])


@query("many_traces", f"""WITH RECURSIVE {FLOW}, asked AS MATERIALIZED (SELECT source, target FROM flow WHERE direction <> 'response'), s AS (SELECT DISTINCT source AS id FROM pairs ORDER BY id LIMIT 64),
down AS (SELECT id AS start, id AS node FROM s UNION SELECT start, target FROM down JOIN asked ON node = source),
up AS (SELECT id AS start, id AS node FROM s UNION SELECT start, source FROM up JOIN asked ON node = target)
SELECT start, node, 'down' AS way FROM down WHERE node <> start UNION ALL SELECT start, node, 'up' FROM up WHERE node <> start""")
def many_traces(spark, d):
    _, e = flow(spark, d)
    return W.traces(e, e.select(F.col("source").alias("node")).distinct().orderBy("node").limit(64))


@query("hover_highlights", f"""WITH {FLOW}, h AS (SELECT min(source) AS id FROM pairs), near AS (SELECT target AS id FROM pairs, h WHERE source = h.id UNION SELECT source FROM pairs, h WHERE target = h.id UNION SELECT id FROM h)
SELECT id, CASE WHEN id IN (FROM near) THEN 'hover' ELSE 'off' END AS highlight FROM nodes""")
def hover_highlights(spark, d):
    n, e = flow(spark, d)
    return W.highlights(n, e, hover=e.agg(F.min("source")).first()[0])


@query("edge_highlights", f"""WITH {FLOW}, m AS (SELECT id, CASE WHEN contains(lower(label), 'e') THEN 'hover' ELSE 'dim' END AS h FROM nodes)
SELECT source, target, CASE WHEN a.h = 'dim' OR b.h = 'dim' THEN 'dim' ELSE 'off' END AS highlight FROM pairs JOIN m a ON source = a.id JOIN m b ON target = b.id""")
def edge_highlights(spark, d):
    n, e = flow(spark, d)
    return W.edge_highlights(e, W.highlights(n, e, search="E"))


ISLANDS = FLOW + """,
ways AS MATERIALIZED (SELECT source AS a, target AS b FROM flow WHERE direction <> 'response' UNION SELECT target, source FROM flow WHERE direction <> 'response'),
comp(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT o.id, min(c.component) FROM recurring.comp AS o JOIN ways ON o.id = ways.a JOIN comp AS c ON c.id = ways.b GROUP BY o.id, o.component HAVING min(c.component) < o.component))"""


@query("flow_components", f"WITH RECURSIVE {ISLANDS} SELECT id, component FROM comp")
def flow_components(spark, d):
    return W.flow_components(*flow(spark, d))


@query("flow_bridges", f"""WITH RECURSIVE {ISLANDS},
n AS (SELECT nodes.*, component, nodes.id IN (SELECT source FROM flow) AS onward, nodes.id IN (SELECT target FROM flow) AS inward FROM nodes JOIN comp ON nodes.id = comp.id),
c AS (SELECT component, count(*) AS size, max(tier) AS tier, bool_or(contains(lower(label), 'dashboard')) AS last, first(id ORDER BY onward, tier DESC, id) AS out, first(id ORDER BY inward, tier, id) AS into_ FROM n GROUP BY component),
p AS (SELECT *, row_number() OVER (ORDER BY last, size DESC, tier DESC, component) AS place FROM c)
SELECT a.out AS source, b.into_ AS target, 'continues' AS label FROM p a JOIN p b ON b.place = a.place + 1""")
def flow_bridges(spark, d):
    return W.bridges(*flow(spark, d))


@query("final_kinds", f"""WITH {FLOW}, r AS (SELECT * FROM flow WHERE direction <> 'response')
SELECT id, CASE WHEN id NOT IN (SELECT source FROM r) THEN 'end' WHEN id NOT IN (SELECT target FROM r) AND kind <> 'data_store' THEN 'start' ELSE kind END AS kind FROM nodes""")
def final_kinds(spark, d):
    return W.final_kinds(*flow(spark, d))


@query("split_dashboards", f"""WITH {FLOW} SELECT id::VARCHAR AS id, kind FROM nodes WHERE NOT contains(lower(label), 'dashboard') UNION ALL SELECT id || '-entry', 'start' FROM nodes WHERE contains(lower(label), 'dashboard') UNION ALL SELECT id || '-exit', 'end' FROM nodes WHERE contains(lower(label), 'dashboard')""")
def split_dashboards(spark, d):
    n, _ = flow(spark, d)
    return W.split_dashboards(n.withColumn("id", F.col("id").cast("string")))


@query("technology_nodes", f"""WITH {FLOW} SELECT id || '::tech::' || t AS id, upper(t) AS label, CASE t WHEN 'redis' THEN 'data_store' ELSE 'action' END AS kind, tier + 1 AS tier FROM (SELECT id, tier, unnest(CASE WHEN id % 2 = 0 THEN ['redis', 'google'] ELSE ['redis'] END) AS t FROM nodes WHERE id % 3 = 0)""")
def technology_nodes(spark, d):
    n, _ = flow(spark, d)
    tech = lambda t, kind: F.struct(F.lit(t).alias("id"), F.lit(t.upper()).alias("label"), F.lit(kind).alias("kind"), F.lit("").alias("role"))
    made = F.when(F.col("id") % 2 == 0, F.array(tech("redis", "data_store"), tech("google", "action"))).otherwise(F.array(tech("redis", "data_store")))
    n = n.select(F.col("id").cast("string").alias("id"), "tier", made.alias("technologies"))
    return W.expand_technologies(n, n.where("cast(id as long) % 3 = 0"))[0]


@query("folded_edges", f"""WITH {EDGES} SELECT DISTINCT source // 10 AS a, target // 10 AS b, type FROM edges WHERE source // 10 <> target // 10""")
def folded_edges(spark, d):
    e = A.edges(spark, d).select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "type")
    return W.fold_edges(e, A.files(spark, d).select("id", F.floor(F.col("id") / 10).alias("node")))


@query("tier_grid", f"""WITH {FLOW} SELECT id, (tier * 220)::BIGINT AS x, ((row_number() OVER (PARTITION BY tier ORDER BY id) - 1) * 80)::BIGINT AS y FROM nodes""")
def tier_grid(spark, d):
    return W.tier_grid(flow(spark, d)[0])


BOXES = "boxes AS (SELECT p_partkey AS id, 100 + p_size AS width, 50 + p_partkey % 20 AS height FROM part)"


def boxes(spark, d) -> DataFrame:
    return A.files(spark, d).select("id", (F.lit(100) + F.col("loc")).alias("width"), (F.lit(50) + F.col("id") % 20).alias("height"))


@query("square_grid", f"""WITH {BOXES}, s AS (SELECT ceil(sqrt(count(*)))::BIGINT AS c, max(width) AS w, max(height) AS h FROM boxes), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM boxes)
SELECT id, (n % c * (w + 40))::BIGINT AS x, (n // c * (h + 40))::BIGINT AS y FROM n, s""")
def square_grid(spark, d):
    return W.square_grid(boxes(spark, d))


@query("closest_handles", f"""WITH {EDGES}, {BOXES}, raw AS (SELECT *, (id * 37 % 1000) AS x0, (id * 91 % 700) AS y0, CASE WHEN id % 5 = 0 THEN id % 7 + 1 END AS parent FROM boxes),
p AS (SELECT r.id, r.x0 + coalesce(q.x0, 0) AS x, r.y0 + coalesce(q.y0, 0) AS y, r.width AS w, r.height AS h FROM raw r LEFT JOIN raw q ON r.parent = q.id),
e AS (SELECT source, target, (b.x + b.w / 2) - (a.x + a.w / 2) AS dx, (b.y + b.h / 2) - (a.y + a.h / 2) AS dy, (a.w + b.w) / 2 AS ww, (a.h + b.h) / 2 AS hh FROM pairs JOIN p a ON source = a.id JOIN p b ON target = b.id)
SELECT source, target, CASE WHEN abs(dx) - ww >= abs(dy) - hh THEN CASE WHEN dx >= 0 THEN 'right' ELSE 'left' END WHEN dy >= 0 THEN 'bottom' ELSE 'top' END AS source_side,
  CASE WHEN abs(dx) - ww >= abs(dy) - hh THEN CASE WHEN dx >= 0 THEN 'left' ELSE 'right' END WHEN dy >= 0 THEN 'top' ELSE 'bottom' END AS target_side FROM e""")
def closest_handles(spark, d):
    b = boxes(spark, d).select("*", (F.col("id") * 37 % 1000).alias("x"), (F.col("id") * 91 % 700).alias("y"), F.when(F.col("id") % 5 == 0, F.col("id") % 7 + 1).alias("parent"))
    return W.closest_handles(A.edges(spark, d).select("source", "target").distinct(), b)


@query("expanded_boxes", f"""WITH {BOXES} SELECT id // 25 AS container, greatest(300, max(id * 37 % 1000 + width) + 32)::BIGINT AS width, greatest(90, max(id * 91 % 700 + height) + 56)::BIGINT AS height FROM boxes GROUP BY 1""")
def expanded_boxes(spark, d):
    b = boxes(spark, d).select("*", (F.col("id") * 37 % 1000).alias("x"), (F.col("id") * 91 % 700).alias("y"), F.floor(F.col("id") / 25).alias("container"))
    return Y.expanded_box(b, (300, 90))


@query("flow_frames", f"""WITH {FLOW} SELECT DISTINCT 'category-frame-' || kind AS id, kind FROM nodes""")
def flow_frames(spark, d):
    return W.frames(flow(spark, d)[0])


@query("flow_edge_ids", f"""WITH {FLOW} SELECT source, target, 'e-' || source || '-' || target || '-' || (row_number() OVER (ORDER BY pos, source, target) - 1) AS id FROM flow""")
def flow_edge_ids(spark, d):
    return W.edge_ids(flow(spark, d)[1], ["pos", "source", "target"])


@query("capped_adjacency", f"""WITH {EDGES}, s AS (SELECT DISTINCT source FROM edges ORDER BY source LIMIT 30) SELECT source, target FROM pairs WHERE source IN (FROM s) ORDER BY source, target LIMIT 100""")
def capped_adjacency(spark, d):
    return W.capped_adjacency(A.edges(spark, d), 30, 100)


# conversations as suggested flows: turns are nodes, each leads to the next, and back from the last
@query("suggested_flow_edges", """WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
e AS (SELECT conv_id AS flow, 'n' || turn AS source, 'n' || CASE WHEN pos = n - 1 THEN 0 WHEN pos = 3 THEN 99 ELSE turn + 1 END AS target, pos FROM t WHERE pos < 25),
ok AS (SELECT flow, source, target, min(pos)::INTEGER AS pos FROM e WHERE source <> target AND source IN (SELECT 'n' || turn FROM t WHERE t.conv_id = e.flow AND t.pos < 15) AND target IN (SELECT 'n' || turn FROM t WHERE t.conv_id = e.flow AND t.pos < 15) GROUP BY 1, 2, 3)
SELECT a.flow, a.source, a.target, a.pos, '' AS label, 'internal' AS data_type, CASE WHEN b.pos < a.pos THEN 'response' ELSE 'request' END AS direction FROM ok a LEFT JOIN ok b ON a.flow = b.flow AND a.source = b.target AND a.target = b.source""")
def suggested_flow_edges(spark, d):
    return W.suggested(_suggestions(spark, d))[1]


def _suggestions(spark, d) -> DataFrame:
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    nodes = F.transform("turns", lambda t: F.struct(name(t).alias("id"), F.when(t % 2 == 0, "io").otherwise("odd").alias("type"), F.lit("decision").alias("kind")))
    last = F.size("turns") - 1
    edges = F.transform("turns", lambda t, i: F.struct(name(t).alias("source"), F.when(i == last, "n0").when(i == 3, "n99").otherwise(name(t + 1)).alias("target"), F.lit("bogus").alias("data_type")))
    return c.select(F.col("conv_id").alias("flow"), F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("json"))


@query("suggested_flow_nodes", """WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id AS flow, pos::INTEGER AS pos, 'n' || turn AS id, 'n' || turn AS label, CASE WHEN turn % 2 = 0 THEN 'io' ELSE 'transform' END AS type, CASE WHEN turn % 2 = 0 THEN 'parallelogram' ELSE 'hexagon' END AS shape, '' AS description
FROM t WHERE pos < 15 AND n > 1 """)
def suggested_flow_nodes(spark, d):
    return W.suggested(_suggestions(spark, d))[0]


@query("flow_outcomes", """WITH r AS (SELECT conv_id AS flow, CASE WHEN conv_id % 7 = 2 THEN 'quota_exceeded' WHEN conv_id % 7 = 1 THEN 'llm_failed' WHEN conv_id % 7 = 3 OR count(*) = 1 THEN 'invalid_llm_response' END AS fallback_reason FROM conversations GROUP BY conv_id)
SELECT flow, fallback_reason IS NULL AS is_llm_enriched, fallback_reason FROM r""")
def flow_outcomes(spark, d):
    """V4: suggestions of which some were not allowed, some are cut short and some are no flow."""
    k = F.col("flow") % 7
    json = F.when(k == 1, F.expr("left(json, length(json) - 1)")).when(k == 3, "[]").otherwise(F.col("json"))
    return W.flow_outcomes(_suggestions(spark, d).withColumn("json", json).withColumn("allowed", k != 2))


# of all shortest paths the one met first is the smallest, node by node
@query("shortest_flow_path", f"""WITH RECURSIVE {EDGES}, dag AS MATERIALIZED (SELECT DISTINCT source, target FROM pairs WHERE source < target), s AS (SELECT min(source) AS id FROM dag),
r(node, depth, path) USING KEY (node) AS (SELECT id, 0, [id] FROM s
  UNION (SELECT target, depth + 1, min(list_append(path, target)) FROM r JOIN dag ON node = source WHERE target NOT IN (SELECT node FROM recurring.r) GROUP BY target, depth))
SELECT (unnest(range(len(path))))::INTEGER AS place, unnest(path) AS node FROM (SELECT path FROM r ORDER BY depth DESC, node LIMIT 1)""")
def shortest_flow_path(spark, d):
    """From the smallest file to the one farthest from it."""
    e = A.dag(spark, d)
    start = e.agg(F.min("source").alias("node"))
    goal = G.reach(e, start).orderBy(F.desc("depth"), "node").first()
    path = (G.shortest_path(e, [start.first()["node"]], [goal["node"]]) if goal else None) or []
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "place int, node long")


@query("learn_order", f"""WITH RECURSIVE {FLAGS}, dag AS MATERIALIZED (SELECT source, target FROM pairs WHERE source < target),
levels(node, level) USING KEY (node) AS (SELECT node, 0 FROM (SELECT source AS node FROM dag UNION SELECT target FROM dag)
  UNION (SELECT o.node, max(f.level) + 1 FROM levels AS f JOIN dag ON f.node = source JOIN recurring.levels AS o ON o.node = target GROUP BY o.node, o.level HAVING max(f.level) + 1 > o.level)),
base AS (SELECT level, sum(n) OVER (ORDER BY level) - n AS before FROM (SELECT level, count(*) AS n FROM levels GROUP BY level)),
ranks AS (SELECT node, 0 AS level, row_number() OVER (ORDER BY node) AS rank FROM levels WHERE level = 0
  UNION ALL SELECT node, level, (before + row_number() OVER (ORDER BY last, node))::BIGINT FROM (
    SELECT l.node, l.level, before, max(ranks.rank) AS last FROM ranks JOIN dag ON ranks.node = source JOIN levels l ON l.node = target AND l.level = ranks.level + 1 JOIN base ON base.level = l.level GROUP BY ALL)),
important AS (SELECT id FROM (SELECT id FROM scored ORDER BY importance DESC, id LIMIT 15) UNION SELECT id FROM flagged WHERE orphan OR in_cycle OR hub OR entry_point OR god_file)
SELECT i.id, (i.id % 5)::BIGINT AS tier, rank FROM important i LEFT JOIN ranks ON i.id = node""")
def learn_order(spark, d):
    return T.learn(A.dag(spark, d), flagged(spark, d).withColumn("tier", F.col("id") % 5))


@query("question_order")
def question_order(spark, d):
    hits = A.table(spark, d, "events").select((F.col("user_id") + 1).alias("file_path"), F.col("event_id").alias("place"))
    return T.by_question(hits, A.dag(spark, d))


@query("cycle_questions", f"""WITH RECURSIVE {FLAGS}, {FIRST_CYCLES}, members AS (SELECT unnest(string_split(path, ','))::BIGINT AS id, path FROM cycles),
partner AS (SELECT id, min(other) AS partner FROM (SELECT id, unnest(string_split(path, ',')) AS other FROM members) WHERE other <> id::VARCHAR GROUP BY id),
q AS (SELECT g.id, size, partner, unnest([CASE WHEN orphan THEN 1 END, CASE WHEN in_cycle THEN 2 END, CASE WHEN hub THEN 3 END, CASE WHEN entry_point THEN 4 END, CASE WHEN god_file THEN 5 END]) AS flag FROM flagged g LEFT JOIN partner p ON g.id = p.id)
SELECT id, CASE flag WHEN 1 THEN 'Nothing imports this file. Why is it in the repo?' WHEN 2 THEN 'This and ' || coalesce(partner, 'another module') || ' import each other — why, and would you fix it?' WHEN 3 THEN 'A lot depends on this. What breaks if you change it?'
  WHEN 4 THEN 'Walk me through what happens when a request arrives.' ELSE 'This file is ~' || format('{{:,}}', greatest(1, size // 40)) || ' lines. How would you split it?' END AS question FROM q WHERE flag IS NOT NULL""")
def cycle_questions(spark, d):
    cycles = long_cycles(spark, d).select(F.split("path", ",").alias("path"))
    f = flagged(spark, d).select(F.col("id").cast("string").alias("id"), "flags", "size")
    return T.questions(f, cycles).select(F.col("id").cast("long").alias("id"), F.explode("questions").alias("question"))


@query("file_facts", f"""WITH {PROFILES} SELECT id, upper(name) || ' | imported by ' || in_degree || ' | imports ' || out_degree AS facts FROM profiles""")
def file_facts(spark, d):
    return A.profiles(spark, d).select("id", F.array_join(T.facts(F.upper("name"), F.col("in_degree"), F.col("out_degree")), " | ").alias("facts"))


@query("has_cycle", f"""WITH RECURSIVE {EDGES}, cyc AS (SELECT source AS a, target AS b FROM pairs UNION SELECT a, target FROM cyc JOIN pairs ON b = source)
SELECT 'all' AS graph, count(*) > 0 AS cyclic FROM cyc WHERE a = b UNION ALL SELECT 'dag', false""")
def has_cycle(spark, d):
    rows = [("all", G.has_cycle(A.edges(spark, d))), ("dag", G.has_cycle(A.dag(spark, d)))]
    return spark.createDataFrame(rows, "graph string, cyclic boolean")


@query("kahn_leftovers", f"""WITH RECURSIVE {EDGES}, cyc AS (SELECT source AS a, target AS b FROM pairs UNION SELECT a, target FROM cyc JOIN pairs ON b = source), loops AS (SELECT a FROM cyc WHERE a = b)
SELECT DISTINCT b AS node FROM cyc WHERE a IN (FROM loops)""")
def kahn_leftovers(spark, d):
    return G.leftovers(A.edges(spark, d))


RANKS = """dag AS MATERIALIZED (SELECT source, target FROM pairs WHERE source < target),
levels(node, level) USING KEY (node) AS (SELECT node, 0 FROM (SELECT source AS node FROM dag UNION SELECT target FROM dag)
  UNION (SELECT o.node, max(f.level) + 1 FROM levels AS f JOIN dag ON f.node = source JOIN recurring.levels AS o ON o.node = target GROUP BY o.node, o.level HAVING max(f.level) + 1 > o.level)),
loose AS (SELECT id AS node, 0 AS level FROM files WHERE id NOT IN (SELECT node FROM levels)),
every AS (FROM levels UNION ALL FROM loose),
base AS (SELECT level, sum(n) OVER (ORDER BY level) - n AS before FROM (SELECT level, count(*) AS n FROM every GROUP BY level)),
ranks AS (SELECT node, 0 AS level, row_number() OVER (ORDER BY node) AS rank FROM every WHERE level = 0
  UNION ALL SELECT node, level, (before + row_number() OVER (ORDER BY last, node))::BIGINT FROM (
    SELECT l.node, l.level, before, max(ranks.rank) AS last FROM ranks JOIN dag ON ranks.node = source JOIN every l ON l.node = target AND l.level = ranks.level + 1 JOIN base ON base.level = l.level GROUP BY ALL))"""


@query("guided_tour", f"WITH RECURSIVE {IMPORTANCE}, {RANKS} SELECT node AS id, rank FROM ranks ORDER BY rank LIMIT 25")
def guided_tour(spark, d):
    return G.tour(A.dag(spark, d), scored(spark, d).select("id", "importance"))


@query("membership_flags", f"""WITH {PROFILES}, c AS (SELECT file FROM deg ORDER BY 3 * in_degree + out_degree DESC, file LIMIT 30) SELECT id, id IN (FROM c) AS central, out_degree > 0 AND in_degree = 0 AS entry FROM profiles""")
def membership_flags(spark, d):
    p = A.profiles(spark, d)
    return L.with_membership(p, D.central_files(A.edges(spark, d)), p.where("out_degree > 0 and in_degree = 0").select(F.col("id").alias("file"))).select("id", "central", "entry")


@query("treemap_tree", f"""WITH {FILES}, k AS (SELECT folder, count(DISTINCT language) = 1 AS lone, sum(size)::BIGINT AS value FROM files GROUP BY folder),
b AS (SELECT f.folder, language, lone, sum(size)::BIGINT AS value FROM files f JOIN k ON f.folder = k.folder GROUP BY ALL)
SELECT path AS id, folder || '/' || language AS parent, string_split(path, '/')[-1] AS name, 'file' AS kind, size AS value FROM files
UNION ALL SELECT folder || '/' || language, CASE WHEN lone THEN '' ELSE folder END, CASE WHEN lone THEN folder || '/' || language ELSE language END, 'folder', value FROM b
UNION ALL SELECT folder, '', folder, 'folder', value FROM k WHERE NOT lone UNION ALL SELECT '', NULL, 'root', 'folder', sum(value)::BIGINT FROM k HAVING count(*) > 0""")
def treemap_tree(spark, d):
    return X.tree_rows(A.files(spark, d).select("path", "size"))


@query("tour_steps", f"""WITH RECURSIVE {FLAGS}, s AS (SELECT id, name, importance, row_number() OVER (ORDER BY importance DESC, id) AS place, in_degree, out_degree FROM scored)
SELECT place, id, upper(name) AS title, 'imported by ' || in_degree || '; imports ' || out_degree AS facts FROM s WHERE place <= 15""")
def tour_steps(spark, d):
    top = scored(spark, d).orderBy(F.desc("importance"), "id").limit(V.TOUR_TOP).withColumn("flags", F.array().cast("array<string>"))
    steps = R.recall_order(top)
    facts = F.array_join(F.slice(T.facts(F.col("name"), F.col("in_degree"), F.col("out_degree")), 2, 2), "; ")
    return steps.select(F.col("order").cast("long").alias("place"), "id", F.upper("name").alias("title"), facts.alias("facts"))


@query("stage_technologies", f"""WITH {ROLED}, t AS (SELECT role, CASE WHEN contains(lower(b.name), 'gear') THEN 'Gears' WHEN contains(lower(b.name), 'bolt') THEN 'Bolts' WHEN contains(lower(b.name), 'e') THEN 'Others' END AS technology FROM edges JOIN roled a ON source = a.id JOIN files b ON target = b.id WHERE {_case("role", _kind)} IS NOT NULL)
SELECT role, string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies FROM t WHERE technology IS NOT NULL GROUP BY role""")
def stage_technologies(spark, d):
    names = A.files(spark, d).select(F.col("id").alias("target"), F.col("name").alias("raw"))
    imports = A.edges(spark, d).join(names, "target").select(F.col("source").alias("path"), "raw")
    return U.stage_technologies(imports, roled(spark, d).select(F.col("id").alias("path"), "role"), [("gear", "Gears"), ("bolt", "Bolts"), ("e", "Others")])


@query("dependency_payload", f"""WITH {MODULES} SELECT (SELECT count(*) FROM files)::BIGINT AS nodes, (SELECT count(*) FROM pairs)::BIGINT AS edges, (SELECT count(*) FROM m)::BIGINT AS modules, (SELECT count(*) FROM c)::BIGINT AS connections""")
def dependency_payload(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(A.files(spark, d), "nodes")
    for part in (n(A.edges(spark, d).select("source", "target").distinct(), "edges"), n(modules(spark, d), "modules"), n(module_connections(spark, d), "connections")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


@query("tile_colours", f"""WITH {FILES}, c AS (SELECT id, loc % 16 * 17 AS r, size % 16 * 17 AS g, id % 16 * 17 AS b FROM files), l AS (SELECT id, list_transform([r, g, b], lambda x: CASE WHEN x / 255 <= 0.03928 THEN x / 255 / 12.92 ELSE ((x / 255 + 0.055) / 1.055) ** 2.4 END) AS v FROM c)
SELECT id, round(0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3], 6) AS luminance, CASE WHEN 0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] > 0.179 THEN 'dark' ELSE 'light' END AS ink FROM l""")
def tile_colours(spark, d):
    c = [F.col("loc") % 16 * 17, F.col("size") % 16 * 17, F.col("id") % 16 * 17]
    return A.files(spark, d).select("id", F.round(S.luminance(*c), 6).alias("luminance"), S.ink(*c).alias("ink"))


@query("exported_formats", "SELECT * FROM (VALUES ('dot', 'digraph'), ('json', '{'), ('mermaid', 'graph TD'), ('module', 'flowchart LR')) v(format, head)")
def exported_formats(spark, d):
    """K8: each known format's first words; an unknown one raises."""
    nodes, edges = _top(spark, d)
    build = {"json": lambda: X.graph_json(nodes, edges), "dot": lambda: X.dot(nodes, edges).first()[0], "mermaid": lambda: X.mermaid(nodes, edges).first()[0], "module": lambda: Y.mermaid_modules(modules(spark, d), module_connections(spark, d)).first()[0]}
    heads = {"json": 1, "dot": 7, "mermaid": 8, "module": 12}
    return spark.createDataFrame([(f, X.export(f, build)[: heads[f]]) for f in sorted(build)], "format string, head string")
