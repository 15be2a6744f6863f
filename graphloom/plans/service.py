"""Registered queries of scalars, sections, stored analyses, retrieval and operations, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from ..operators import diff as C
from ..operators import metrics as M
from ..operators import retrieval as Q
from ..operators import sections as P
from ..operators import storage as K
from ..operators.nearest import Index
from ..sources import events as E
from ..sources import files as H
from ..sources.snapshots import Snapshots
from . import adapters as A
from .catalogue import EDGES, FILES, IMPORTANCE, PROFILES, RATES, VEC, QUERY_VECTOR, _bucket_sql, query, scored
from .views import MODULES, ROLED, modules, module_connections, roled


def _list(items: list) -> str:
    return "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + ")"


def _case(c: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


# -- file trees ---------------------------------------------------------------------------
NAMES = ["main.py", "index.ts", "Dockerfile", ".env", "package-lock.json", "photo.PNG", "x_test.go", "types.d.ts", "README.md", "a.ipynb", "notes", ".hidden", "Util.java", "key.pem", "a.b.tsx", ".gitignore", "mod.spec.js", "__init__.py", "_app.tsx"]
DIRS = ["src", "docs", "node_modules", ".github/workflows", "tests", "lib/fixtures", "app", "__tests__", "src/_parts"]
TREE = f"""tree AS (SELECT p_partkey AS id, {str(DIRS)}[p_partkey % {len(DIRS)} + 1] || '/p' || (p_partkey % 40) || '/' || {str(NAMES)}[p_partkey % {len(NAMES)} + 1] AS path,
  {str(NAMES)}[p_partkey % {len(NAMES)} + 1] AS name, round(p_retailprice * 100)::BIGINT * (p_partkey % 9) AS size FROM part)"""


def tree(spark, d) -> DataFrame:
    """Parts as a file tree with all kinds of names: id, path, name, size."""
    pick = lambda items: F.get(F.array(*[F.lit(x) for x in items]), (F.col("id") % len(items)).cast("int"))
    f = A.files(spark, d).select("id", F.concat(pick(DIRS), F.lit("/p"), (F.col("id") % 40).cast("string"), F.lit("/"), pick(NAMES)).alias("path"), pick(NAMES).alias("name"), (F.col("size") * (F.col("id") % 9)).alias("size"))
    return f


EXT = r"lower(regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1))"


@query("scan_rules", rf"""WITH {TREE}, t AS (SELECT *, {EXT} AS ext FROM tree)
SELECT id, name, regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1) AS extension, len(string_split(path, '/')) - 1 AS depth, regexp_replace(path, '/?[^/]*$', '') AS folder,
  coalesce({_case("name", V.FILENAME_LANGUAGES)}, {_case("ext", V.EXTENSION_LANGUAGES)}, 'Unknown') AS language,
  list_bool_or(list_transform(string_split(path, '/')[:-2], lambda x: starts_with(x, '.') OR x IN {_list(V.IGNORED_DIRS)})) AS pruned,
  CASE WHEN name IN {_list(V.IGNORED_FILES)} THEN 'ignored_filename' WHEN name IN {_list(V.SECRET_NAMES)} OR starts_with(name, '.env') OR regexp_matches(name, '(\.pem|\.key|\.pfx|\.p12)$') THEN 'secret_file' WHEN ext IN {_list(V.IGNORED_EXTENSIONS)} THEN 'ignored_extension'
    WHEN starts_with(name, '.') AND name NOT IN {_list(list(V.FILENAME_LANGUAGES))} THEN 'hidden_file' WHEN ext <> '.ipynb' AND size > 524288 THEN 'exceeds_max_size_512KB' WHEN ext = '.ipynb' AND size > 52428800 THEN 'exceeds_max_size_51200KB' END AS reason FROM t""")
def scan_rules(spark, d):
    p = F.col("path")
    return tree(spark, d).select("id", S.basename(p).alias("name"), S.extension(p).alias("extension"), S.depth(p).alias("depth"), S.dirname(p).alias("folder"), S.language(p).alias("language"), S.pruned_dir(p).alias("pruned"), S.skip_reason(p, F.col("size")).alias("reason"))


PRUNED = f"list_bool_or(list_transform(string_split(path, '/')[:-2], lambda x: starts_with(x, '.') OR x IN {_list(V.IGNORED_DIRS)}))"
REASON = rf"""CASE WHEN name IN {_list(V.IGNORED_FILES)} THEN 'ignored_filename' WHEN name IN {_list(V.SECRET_NAMES)} OR starts_with(name, '.env') OR regexp_matches(name, '(\.pem|\.key|\.pfx|\.p12)$') THEN 'secret_file'
  WHEN ext IN {_list(V.IGNORED_EXTENSIONS)} THEN 'ignored_extension' WHEN starts_with(name, '.') AND name NOT IN {_list(list(V.FILENAME_LANGUAGES))} THEN 'hidden_file' END"""


@query("scanned_tree", rf"""WITH {TREE}, t AS (SELECT DISTINCT path, name, {EXT} AS ext FROM tree)
SELECT path, coalesce({_case("name", V.FILENAME_LANGUAGES)}, {_case("ext", V.EXTENSION_LANGUAGES)}, 'Unknown') AS language, strlen('text of ' || path)::BIGINT AS size, {REASON} AS reason, CASE WHEN {REASON} IS NULL THEN 'text of ' || path END AS content FROM t WHERE NOT {PRUNED}""")
def scanned_tree(spark, d):
    """The whole tree, written out by tasks and scanned."""
    root = f"{H.shared_folder(spark)}/tree"
    rows = tree(spark, d).select("path").distinct()
    H.write_tree(rows.withColumn("content", F.concat(F.lit("text of "), "path")), root)
    return H.scan(spark, root).select("path", "language", "size", "reason", "content")


@query("path_patterns", f"""WITH {TREE} SELECT id, regexp_matches(path, '(?i){"|".join(f"(?:{p})" for p in V.TEST_PATTERNS)}') AS test, regexp_matches(name, '(?i){"|".join(f"(?:{p})" for p in V.TYPE_PATTERNS)}') AS types, regexp_matches(path, '(?i){"|".join(f"(?:{p})" for p in V.DATA_PATTERNS)}') AS data,
  list_has_any(string_split(lower(path), '/'), ['docs', 'doc', 'documentation', 'wiki']) AS doc, contains(lower(path), '.github/workflows') AS ci FROM tree""")
def path_patterns(spark, d):
    p, n = F.col("path"), F.col("name")
    return tree(spark, d).select("id", S.matches_any(p, V.TEST_PATTERNS).alias("test"), S.matches_any(n, V.TYPE_PATTERNS).alias("types"), S.matches_any(p, V.DATA_PATTERNS).alias("data"), S.is_doc_path(p).alias("doc"), S.is_ci_path(p).alias("ci"))


@query("repo_limits", f"WITH {FILES} SELECT count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, count(*) <= 2000 AND sum(size) <= 104857600 AS accepted FROM files")
def repo_limits(spark, d):
    return H.within_limits(A.files(spark, d))


@query("preloaded_content", f"""WITH {FILES}, s AS (SELECT id, size, sum(CASE WHEN size < 150000 THEN size ELSE 0 END) OVER (ORDER BY id) AS upto FROM files) SELECT id, size FROM s WHERE size < 150000 AND upto <= 10485760""")
def preloaded_content(spark, d):
    return H.preload(A.files(spark, d), "id", 150_000).select("id", "size")


@query("extension_languages", rf"""WITH {TREE}, t AS (SELECT {_case(EXT, V.EXTENSION_LANGUAGES)} AS language FROM tree) SELECT language, count(*)::BIGINT AS files FROM t WHERE language IS NOT NULL GROUP BY 1""")
def extension_languages(spark, d):
    return P.extension_languages(tree(spark, d))


@query("explainable_files", rf"""WITH {TREE}, {IMPORTANCE.replace("imports AS", "imports AS", 1)} SELECT t.id FROM tree t JOIN scored s ON t.id = s.id WHERE {EXT.replace("name", "t.name")} IN {_list(V.EXPLAINED_EXTENSIONS)} AND importance >= 10""")
def explainable_files(spark, d):
    f = tree(spark, d).select("id", S.extension(F.col("path")).alias("extension")).join(scored(spark, d).select("id", "importance"), "id")
    return P.explainable(f).select("id")


@query("explain_status", rf"""WITH {TREE}, c AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN '  ' ELSE path END AS content FROM tree)
SELECT id, CASE WHEN {EXT} NOT IN {_list(V.EXPLAINED_EXTENSIONS)} THEN 'not_source' WHEN content IS NULL THEN 'unreadable' WHEN trim(content) = '' THEN 'empty' END AS status, CASE WHEN size <= 524288 THEN content END AS source FROM c""")
def explain_status(spark, d):
    c = tree(spark, d).withColumn("content", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, "  ").otherwise(F.col("path")))
    return c.select("id", P.explain_status(S.extension(F.col("path")), F.col("content")).alias("status"), P.whole_source(F.col("content"), F.col("size")).alias("source"))


@query("path_labels", rf"""WITH {TREE} SELECT id, coalesce(nullif(upper(regexp_extract(name, '^.+\.([^.]*)$', 1)), ''), 'FILE') AS kind, regexp_replace(path, '/[^/]*$', '') AS folder FROM tree""")
def path_labels(spark, d):
    return tree(spark, d).select("id", P.kind_label(F.col("path")).alias("kind"), P.folder_label(F.col("path")).alias("folder"))


# -- scalars -------------------------------------------------------------------------------
@query("name_scalars", f"""WITH {FILES} SELECT id, trim(regexp_replace(lower(folder), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN loc >= 10 THEN 'xl' WHEN loc >= 6 THEN 'lg' WHEN loc >= 3 THEN 'md' WHEN loc >= 1 THEN 'sm' ELSE 'xs' END AS size_class,
  regexp_replace(path, '[^0-9A-Za-z_]', '_', 'g') AS mermaid, replace(replace('a\\' || name || '"', '\\', '\\\\'), '"', '\\"') AS dot, string_split(path, '/')[1] AS top, round(least(22 + 5 * sqrt(loc), 55), 6) AS radius,
  CASE WHEN size >= 1000000 THEN (size + 50000) // 1000000 || '.' || (size + 50000) // 100000 % 10 || 'M' WHEN size >= 1000 THEN (size + 50) // 1000 || '.' || (size + 50) // 100 % 10 || 'K' ELSE size::VARCHAR END AS compact FROM files""")
def name_scalars(spark, d):
    f = A.files(spark, d)
    return f.select("id", S.slug(F.col("folder")).alias("slug"), S.size_class(F.col("loc")).alias("size_class"), S.mermaid_id(F.col("path")).alias("mermaid"), S.dot_escape(F.concat(F.lit("a\\"), "name", F.lit('"'))).alias("dot"), S.top_folder(F.col("path")).alias("top"), F.round(S.module_radius(F.col("loc")), 6).alias("radius"), S.compact_number(F.col("size")).alias("compact"))


@query("sampled_hashes", """SELECT doc_id, CASE WHEN strlen(text) <= 10240 THEN md5(text) ELSE md5(encode(text)[1:8192] || encode(text)[-2048:]) END AS content_hash, md5(to_json(list_sort([source, lang, source]))) AS signature FROM documents""")
def sampled_hashes(spark, d):
    t = A.table(spark, d, "documents")
    return t.select("doc_id", S.sample_hash(F.col("text").cast("binary")).alias("content_hash"), S.list_hash(F.array("source", "lang", "source")).alias("signature"))


@query("layer_shapes", f"""WITH {FILES}, t AS (SELECT id, loc || CASE id % 3 WHEN 0 THEN ' x ' WHEN 1 THEN '×' ELSE ', ' END || (size % 300 - 20) AS text FROM files), n AS (SELECT id, list_transform(regexp_split_to_array(trim(text), '[×x,\\s]+'), lambda v: v::INT) AS dims FROM t)
SELECT id, CASE WHEN list_min(dims) > 0 THEN array_to_string(dims, '|') END AS shape FROM n""")
def layer_shapes(spark, d):
    sep = F.when(F.col("id") % 3 == 0, " x ").when(F.col("id") % 3 == 1, "×").otherwise(", ")
    text = F.concat(F.col("loc").cast("string"), sep, (F.col("size") % 300 - 20).cast("string"))
    dims = S.parse_shape(text)
    return A.files(spark, d).select("id", F.when(dims.isNotNull(), F.array_join(F.transform(dims, lambda x: x.cast("string")), "|")).alias("shape"))


@query("client_ips", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id % 250 WHEN user_id % 3 = 1 THEN '1.1.1.1' ELSE '2.2.2.' || user_id % 250 END AS ip FROM events""")
def client_ips(spark, d):
    u = F.concat(F.lit("2.2.2."), (F.col("user_id") % 250).cast("string"))
    chain = F.when(F.col("user_id") % 3 == 0, "5.5.5.5").when(F.col("user_id") % 3 == 1, "9.9.9.9, 1.1.1.1 , 3.3.3.3").otherwise(F.concat(u, F.lit(",8.8.8.8")))
    peer = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    return A.table(spark, d, "events").select("event_id", S.client_ip(chain, peer, 2).alias("ip"))


@query("node_layers", f"""WITH {ROLED}, l AS (SELECT id, path, {_case("role", V.ROLE_LAYERS)} AS lane FROM roled) SELECT id, CASE WHEN lane <> 'other' THEN lane ELSE CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(path), '{k}')" for k in words) + f" THEN '{layer}'" for layer, words in V.LAYER_KEYWORDS)} ELSE 'other' END END AS layer FROM l""")
def node_layers(spark, d):
    return roled(spark, d).select("id", S.node_layer(F.col("role"), F.col("path")).alias("layer"))


@query("failure_kinds", """SELECT event_id, CASE s WHEN 0 THEN 'Can''t reach the server' WHEN 1 THEN 'Still analyzing this repository' WHEN 2 THEN 'Sign in to continue' WHEN 3 THEN 'Sign in to continue' WHEN 4 THEN 'This analysis has expired' WHEN 5 THEN 'Too many requests' WHEN 6 THEN 'Quota exhausted' WHEN 7 THEN 'The server had a problem' WHEN 8 THEN 'We couldn''t build this view' ELSE 'This is taking too long' END AS title,
  CASE s WHEN 2 THEN 'sign-in' WHEN 3 THEN 'sign-in' WHEN 4 THEN 'reanalyze' WHEN 6 THEN 'none' WHEN 8 THEN 'none' ELSE 'retry' END AS action FROM (SELECT event_id, event_id % 10 AS s FROM events)""")
def failure_kinds(spark, d):
    codes = F.array(*[F.lit(x).cast("int") for x in (None, 202, 401, 403, 404, 429, 402, 503, 400, 500)])
    n = (F.col("event_id") % 10).cast("int")
    return A.table(spark, d, "events").select("event_id", P.failure(F.get(codes, n), n == 9).alias("f")).select("event_id", "f.title", "f.action")


@query("step_keys", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN conv_id || ',' || turn ELSE '' END AS key, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN conv_id || ',' || turn ELSE '' END || '::q' || turn AS question FROM conversations""")
def step_keys(spark, d):
    none = F.array().cast("array<string>")
    nodes = F.when(F.col("turn") % 3 == 1, F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))).otherwise(none)
    layer = F.when(F.col("turn") % 3 == 0, F.col("role"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", P.step_key(nodes, layer).alias("key"), P.question_key(nodes, layer, F.col("turn")).alias("question"))


# -- sections and prompts ------------------------------------------------------------------
@query("report_sections", """SELECT conv_id, turn, trim(text) AS title, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(role) END AS content, CASE WHEN turn % 4 = 1 THEN 'graph' END AS visualization_type, CASE WHEN turn % 4 = 1 THEN 'routes|inherits|imports' END AS types, turn % 4 = 3 AS failed FROM conversations WHERE text IS NOT NULL""")
def report_sections(spark, d):
    c = A.table(spark, d, "conversations").where("text is not null")
    viz = F.when(F.col("turn") % 4 == 1, F.struct(F.array(F.struct(F.lit("a").alias("id"), F.lit("Controller").alias("type"))).alias("nodes"), F.array(F.struct(F.lit("a").alias("source"), F.lit("a").alias("target"), F.lit("extends").alias("type")), F.struct(F.lit("a").alias("source"), F.lit("a").alias("target"), F.lit("?").alias("type"))).alias("edges")))
    made = F.struct(F.concat(F.lit(" "), "text", F.lit("  ")).alias("title"), F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("role")).alias("content"), F.when(F.col("turn") % 4 == 1, " graph ").otherwise(" ").alias("visualization_type"), viz.alias("visualization_data"))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(made), F.lit("\n```"))).otherwise(F.to_json(made))
    s = P.sections(c.select("conv_id", "turn", answer.alias("answer")))
    types = F.concat_ws("|", F.get("visualization_data.nodes", F.lit(0))["type"], F.array_join(F.transform("visualization_data.edges", lambda e: e["type"]), "|"))
    return s.select("conv_id", "turn", F.col("title"), "content", "visualization_type", F.when(F.col("visualization_data").isNotNull(), types).alias("types"), "failed")


@query("module_inputs", f"""WITH {MODULES}, a AS (SELECT target AS module, source || ' (' || weight || ')' AS x, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) AS n FROM c), b AS (SELECT source AS module, target || ' (' || weight || ')' AS x, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS n FROM c)
SELECT module, coalesce((SELECT string_agg(x, ', ' ORDER BY n) FROM a WHERE a.module = m.module AND n <= 10), 'none') AS used_by, coalesce((SELECT string_agg(x, ', ' ORDER BY n) FROM b WHERE b.module = m.module AND n <= 10), 'none') AS uses FROM m""")
def module_inputs(spark, d):
    return P.module_inputs(modules(spark, d), module_connections(spark, d))


@query("prompt_facts", f"""WITH {ROLED}, c AS (SELECT file, row_number() OVER (ORDER BY 3 * in_degree + out_degree DESC, file) AS n FROM deg), p AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS n FROM scored), r AS (SELECT role, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, role) AS n FROM roled GROUP BY role)
SELECT 0 AS block, 0 AS place, 'imports: ' || count(*) AS fact FROM edges UNION ALL SELECT 1, n::INTEGER, 'central: ' || file FROM c WHERE n <= 5 UNION ALL SELECT 2, n::INTEGER, 'important: ' || id FROM p WHERE n <= 10 UNION ALL SELECT 3, n::INTEGER, role || ': ' || k FROM r WHERE n <= 30""")
def prompt_facts(spark, d):
    from ..operators import degrees, roles

    e = A.edges(spark, d)
    return P.prompt_facts(e, degrees.central_files(e), scored(spark, d), roles.role_summary(roled(spark, d)))


@query("file_prompts", """SELECT doc_id, md5('File: ' || source || '/' || doc_id || chr(10) || 'Role: ' || lang || chr(10) || 'Imports: ' || CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE source || ', ' || lang END || chr(10) || CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 6000) || chr(10) || '... [truncated] ...' || chr(10) || right(text, 6000) END) AS prompt_hash FROM documents""")
def file_prompts(spark, d):
    imports = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    p = P.file_prompt(F.concat_ws("/", "source", "doc_id"), F.col("lang"), imports, F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", F.md5(p).alias("prompt_hash"))


@query("explain_stats", """SELECT count(*) FILTER (WHERE turn % 5 <> 0)::BIGINT AS files, sum(greatest((length(text) + CASE WHEN turn % 5 <> 0 THEN least(length(text), 10) ELSE 0 END) // 4, 1))::BIGINT AS tokens, sum(turn * 10)::BIGINT AS ms, count(*) FILTER (WHERE turn % 5 = 0)::BIGINT AS errors FROM conversations""")
def explain_stats(spark, d):
    def model(text: str) -> str:
        if text.startswith("!"):
            raise TimeoutError
        return text[:10]

    c = A.table(spark, d, "conversations").select((F.col("turn") * 10).alias("ms"), "text", F.when(F.col("turn") % 5 == 0, F.concat(F.lit("!"), F.substring("text", 2, 1 << 30))).otherwise(F.concat(F.lit("."), F.substring("text", 2, 1 << 30))).alias("prompt"))
    return P.explain_stats(P.complete(c, model))


@query("complexity_tiles", f"WITH {FILES} SELECT path, CASE WHEN id % 3 = 0 OR loc % 5 = 0 THEN 1 ELSE loc % 5 END AS value FROM files ORDER BY id LIMIT 80")
def complexity_tiles(spark, d):
    f = A.files(spark, d).withColumn("complexity", F.when(F.col("id") % 3 != 0, F.col("loc") % 5)).withColumn("pos", F.col("id"))
    return P.complexity_tiles(f)


@query("progress_marks", "SELECT conv_id, turn, (10 + floor(turn * 70 / 12))::INTEGER AS percent FROM conversations")
def progress_marks(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", P.progress(F.col("turn"), 12, 10, 80).alias("percent"))


@query("nn_candidates", rf"""WITH {TREE}, {EDGES.replace("imports AS", "imports AS", 1)}, r AS (SELECT id, path, {str(sorted(V.ROLE_LAYERS))}[id % {len(V.ROLE_LAYERS)} + 1] AS role FROM tree)
SELECT id FROM r WHERE (path LIKE '%.py' OR path LIKE '%.ipynb') AND (role IN {_list(V.NN_ROLES)} OR id IN (SELECT source FROM pairs WHERE target % 10 IN (1, 2)))""")
def nn_candidates(spark, d):
    from ..operators import networks

    roles = F.array(*[F.lit(r) for r in sorted(V.ROLE_LAYERS)])
    f = tree(spark, d).withColumn("role", F.get(roles, (F.col("id") % len(V.ROLE_LAYERS)).cast("int")))
    raw = F.when(F.col("target") % 10 == 1, "torch.nn.functional").when(F.col("target") % 10 == 2, ".timm").otherwise("torchless.nn")
    return networks.candidates(f, A.edges(spark, d).select(F.col("source").alias("id"), raw.alias("raw")), "id").select("id")


# -- stored analyses -----------------------------------------------------------------------
@query("visible_rows", "SELECT doc_id, doc_id % 5 = 3 AS valid FROM documents WHERE doc_id % 4 = 0 OR source = 'src1'")
def visible_rows(spark, d):
    t = A.table(spark, d, "documents").withColumn("owner", F.when(F.col("doc_id") % 4 != 0, F.col("source")))
    name = F.when(F.col("doc_id") % 5 == 3, F.substring(F.md5("source"), 1, 12)).when(F.col("doc_id") % 5 == 2, "ABCDEF012345").when(F.col("doc_id") % 5 == 1, F.lit("abcdef01234\n")).otherwise("../etc/passwd")
    return K.visible(t, "src1").select("doc_id", K.valid_repo_id(name).alias("valid"))


@query("chunks_without_repo", "SELECT vec_id AS id, label AS repo_id FROM embeddings WHERE label % 3 <> 1")
def chunks_without_repo(spark, d):
    c = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repo_id"))
    return K.without_repo(c, c.where("repo_id % 3 = 1"))


@query("deleted_sessions", "SELECT conv_id AS session_id, count(*)::BIGINT AS messages FROM conversations WHERE conv_id % 4 <> 2 GROUP BY conv_id")
def deleted_sessions(spark, d):
    m = A.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    s = m.select("session_id").distinct()
    s, m = K.delete_sessions(s, m, s.where("session_id % 4 = 2"))
    return s.join(m, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


@query("upserted_sessions", "SELECT conv_id, max(turn) + CASE WHEN conv_id % 3 = 0 THEN 100 ELSE 0 END AS updated FROM conversations GROUP BY conv_id UNION ALL SELECT -1, 7")
def upserted_sessions(spark, d):
    """A stored table, its change of every third session, and its rows after both."""
    s = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    new = s.where("conv_id % 3 = 0").select("conv_id", (F.col("updated") + 100).alias("updated")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(7).alias("updated")))
    stored = Snapshots(spark, f"{H.shared_folder(spark)}/sessions", s.schema, ["conv_id"])
    stored.write(s)
    stored.upsert(new)
    return stored.read()


@query("snapshot_round_trip", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def snapshot_round_trip(spark, d):
    """Fingerprints written in two versions, folded into one and read back."""
    f = A.table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    stored = Snapshots(spark, f"{H.shared_folder(spark)}/snapshot", f.schema, ["doc_id"])
    stored.write(f.where("doc_id % 2 = 0"))
    stored.upsert(f)
    stored.compact()
    return stored.read()


@query("vector_rows", "SELECT count(*)::BIGINT AS written, count(*)::BIGINT AS found FROM conversations WHERE text IS NOT NULL")
def vector_rows(spark, d):
    """Turns embedded in batches, written by repository, and counted."""
    c = A.table(spark, d, "conversations").where("text is not null").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string")).alias("repo_id"), "text")
    n = K.write_vectors(Q.embed(c, Q.hashing_embedder(16)), f"{H.shared_folder(spark)}/vectors")
    return c.agg(F.count(F.lit(1)).alias("written")).withColumn("found", F.lit(n).cast("long"))


@query("stale_clones", "SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 < (SELECT max(epoch_us(ts) // 1000000) FROM events) - 86400")
def stale_clones(spark, d):
    e = A.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("mtime"))
    return K.stale_clones(e.crossJoin(F.broadcast(e.agg(F.max("mtime").alias("now")))), F.col("now")).select("event_id")  # one row


@query("commit_names", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'mtime-' || epoch_us(ts) // 1000000 END AS name FROM events")
def commit_names(spark, d):
    return A.table(spark, d, "events").select("event_id", K.head_or_time(F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.col("ts").cast("timestamp")).alias("name"))


@query("origin_repos", "SELECT event_type || '/' || user_id % 7 || '@' || user_id % 3 AS signature, first('r' || event_id ORDER BY ts, 'r' || event_id) AS origin FROM events GROUP BY 1")
def origin_repos(spark, d):
    text = lambda c: c.cast("string")
    e = A.table(spark, d, "events").select(F.col("event_type").alias("owner"), text(F.col("user_id") % 7).alias("repo"), text(F.col("user_id") % 3).alias("commit"), F.col("ts").alias("at"), F.concat(F.lit("r"), text(F.col("event_id"))).alias("repo_id"))
    return K.origins(e)


@query("unmodified_pages", "SELECT page_id, page_id % 3 <> 2 AS fresh FROM pages")
def unmodified_pages(spark, d):
    tag = K.etag(F.struct("page_id", "url"))
    asked = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"'), tag, F.lit('"'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('W/"'), tag, F.lit('"'))).otherwise('"other"')
    return A.table(spark, d, "pages").select("page_id", K.not_modified(tag, asked).alias("fresh"))


# -- retrieval -----------------------------------------------------------------------------
@query("same_file_hits", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS score FROM embeddings WHERE label = 4 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {VEC}) DESC, vec_id LIMIT 3")
def same_file_hits(spark, d):
    h = A.chunks(spark, d).withColumn("score", Q.cosine(F.col("vector"), QUERY_VECTOR))
    return K.same_file(h, F.lit(4)).select("id", F.round("score", 6).alias("score"))


@query("many_questions", """SELECT q.vec_id AS question, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) <= 5""")
def many_questions(spark, d):
    """The stated set of questions, every twentieth vector, against all vectors."""
    e = A.table(spark, d, "embeddings")
    found = Index(e, key="vec_id", vector="embedding").search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector")), 5)
    return found.select("question", F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))


@query("adaptive_search", f"""WITH h AS (SELECT label AS file_path, vec_id % 5 AS start_line, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {VEC}) AS s FROM embeddings WHERE label % 3 <> 0 ORDER BY s DESC, id LIMIT 8)
SELECT file_path, start_line, round(s, 6) AS score, id FROM h QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY s DESC, id) = 1""")
def adaptive_search(spark, d):
    h = Q.search(A.chunks(spark, d), "Which SERVICE handles the request?", QUERY_VECTOR)
    return h.select("file_path", "start_line", F.round("score", 6).alias("score"), "id")


@query("answer_context", """WITH h AS (SELECT conv_id, turn, 'f' || turn AS file_path, (turn * 7 % 5)::DOUBLE AS score, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id AS question, md5(string_agg('### ' || file_path || ' (line ' || turn || ')' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (turn + i - 1) || ' | ' || x), chr(10)), chr(10) || chr(10) ORDER BY score DESC, file_path)) AS context_hash, string_agg(file_path, ',' ORDER BY score DESC, file_path) AS sources FROM h GROUP BY conv_id""")
def answer_context(spark, d):
    h = A.table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("question"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_path"), F.col("turn").alias("start_line"), (F.col("turn") * 7 % 5).cast("double").alias("score"), "text")
    return P.context(h).select("question", F.md5("context").alias("context_hash"), F.array_join("sources", ",").alias("sources"))


@query("chunk_names", """SELECT doc_id::VARCHAR AS file_path, 'tables_' || left(md5(doc_id::VARCHAR), 10) || '_0' AS first_id FROM documents WHERE trim(text) <> ''""")
def chunk_names(spark, d):
    """The first chunk of every text that is not blank."""
    c = Q.chunk(A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), "tables")
    return c.where("n = 0").select("file_path", F.col("id").alias("first_id"))


# -- operations ----------------------------------------------------------------------------
@query("sse_round_trip", """SELECT event_id, event_type, user_id FROM events WHERE event_id % 5 <> 2""")
def sse_round_trip(spark, d):
    """Numbered frames in one text per user, with broken ones between, and back."""
    e = A.table(spark, d, "events")
    data = F.to_json(F.struct("event_id", "event_type", "user_id"))
    frame = F.when(F.col("event_id") % 5 == 2, F.concat(F.lit("id: 9\ndata: {broken\n\n"))).otherwise(E.frame(F.col("event_id"), data))
    texts = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f"))))["f"], "").alias("value"))
    back = E.parse_frames(texts).select(F.from_json("data", "event_id long, event_type string, user_id long").alias("x"))
    return back.select("x.*")


@query("label_counters", "SELECT event_type, user_id % 2 = 0 AS cached, count(*)::BIGINT AS calls, sum(round(value * 100)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def label_counters(spark, d):
    e = A.table(spark, d, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("cached"), F.round(F.col("value") * 100).cast("long").alias("tokens"))
    return M.label_counters(e, ["event_type", "cached"], ["tokens"])


@query("latency_histogram", f"""WITH b AS (SELECT unnest([{", ".join(f"'{x}'" for x in [*V.LATENCY_BUCKETS, "+Inf"])}]) AS le, unnest(range({len(V.LATENCY_BUCKETS) + 1})) AS at), e AS (SELECT event_type AS provider, {_bucket_sql("value / 10", V.LATENCY_BUCKETS)} AS le FROM events)
SELECT p.provider, b.le, (SELECT count(*) FROM e JOIN b o ON e.le = o.le WHERE e.provider = p.provider AND o.at <= b.at)::BIGINT AS n FROM (SELECT DISTINCT provider FROM e) p, b""")
def latency_histogram(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("value") / 10).alias("seconds"))
    return M.latency_histogram(e, ["provider"])


@query("quota_gate", f"""WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type AS provider, round(value * 100)::BIGINT AS tokens FROM events),
s AS (SELECT day, sum(usd) AS usd FROM (SELECT day, round(sum(tokens) / 1000 * (CASE provider {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RATES.items())} END), 4) AS usd FROM u GROUP BY day, provider) GROUP BY day),
q AS (SELECT day, user_id, sum(tokens)::BIGINT AS tokens FROM u GROUP BY 1, 2)
SELECT q.day, user_id, tokens, greatest(0, 20000 - tokens)::BIGINT AS remaining, CASE WHEN tokens > 20000 THEN 'user_quota' WHEN usd > 6.0 THEN 'global_cap' ELSE 'ok' END AS gate FROM q LEFT JOIN s ON q.day = s.day""")
def quota_gate(spark, d):
    u = A.usage(spark, d)
    return M.gate(u, M.spend(u, RATES), 20_000, 6.0)


@query("retry_outcomes", """WITH t AS (SELECT event_id // 6 AS call, event_id % 6 + 1 AS attempt, event_type = 'purchase' AS ok, event_type <> 'error' AS retryable FROM events),
e AS (SELECT call, min(attempt) FILTER (WHERE ok OR NOT retryable OR attempt > 3) AS stop, max(attempt) AS seen FROM t GROUP BY call)
SELECT e.call, CASE WHEN stop IS NULL THEN 'pending' WHEN t.ok THEN 'ok' ELSE 'failed' END AS outcome, coalesce(stop, seen)::BIGINT AS tries, [0, 5, 20, 50][least(coalesce(stop, seen), 4)]::BIGINT AS waited FROM e LEFT JOIN t ON e.call = t.call AND e.stop = t.attempt""")
def retry_outcomes(spark, d):
    e = A.table(spark, d, "events").select(F.floor(F.col("event_id") / 6).alias("call"), (F.col("event_id") % 6 + 1).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "error").alias("retryable"))
    return M.retried(e, "call")


@query("backoff_waits", "SELECT user_id, (2.0 * 2 ** (user_id % 6))::DOUBLE AS doubling, CASE user_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 30 END AS listed FROM (SELECT DISTINCT user_id FROM events)")
def backoff_waits(spark, d):
    n = F.col("user_id") % 6 + 1
    return A.table(spark, d, "events").select("user_id").distinct().select("user_id", M.backoff(n, 2.0).alias("doubling"), M.fixed_backoff(n).alias("listed"))


@query("patched_central", f"""WITH {EDGES}, p AS (SELECT DISTINCT source, target FROM edges WHERE source % 11 <> 0 AND target % 11 <> 0 AND source % 7 <> 0 UNION SELECT source, target FROM edges WHERE source % 7 = 0 AND source % 11 <> 0 AND line = 1),
e AS (SELECT source AS file, 0 AS i, 1 AS o FROM p UNION ALL SELECT target, 1, 0 FROM p), g AS (SELECT file, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM e GROUP BY file)
SELECT file, in_degree, out_degree FROM g ORDER BY 3 * in_degree + out_degree DESC, file LIMIT 30""")
def patched_central(spark, d):
    e = A.edges(spark, d).select("source", "target", "ord", "line")
    f = A.files(spark, d).select(F.col("id").alias("path"))
    fresh = e.where("source % 7 = 0 and source % 11 <> 0 and line = 1")
    return C.patch_graph(e, fresh, f.where("path % 7 = 0"), f.where("path % 11 = 0"))[1].select("file", "in_degree", "out_degree")


@query("deleted_changes", """SELECT count(*)::BIGINT AS deleted FROM documents WHERE (doc_id % 13 <> 0 OR doc_id % 11 <> 0) AND doc_id % 6 = 0""")
def deleted_changes(spark, d):
    files = A.table(spark, d, "documents").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"))
    return C.deleted_count(C.change_classes(*A.snapshots(spark, d)), files)


@query("missing_columns", "SELECT 'layer' AS name UNION ALL SELECT 'provider'")
def missing_columns(spark, d):
    have = A.chunks(spark, d).drop("layer").columns
    return spark.createDataFrame([(c,) for c in K.missing_columns(have, ["id", "layer", "file_path", "provider"])], "name string")


@query("in_degree_profiles", f"WITH {PROFILES} SELECT id, in_degree, out_degree FROM profiles")
def in_degree_profiles(spark, d):
    return A.profiles(spark, d).select("id", "in_degree", "out_degree")


@query("selected_content", "SELECT doc_id::VARCHAR AS path, md5(left(text, 12000)) AS head FROM documents WHERE doc_id % 3 = 1")
def selected_content(spark, d):
    f = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    return P.selected_content(f, f.where("doc_id % 3 = 1")).select("path", F.md5("content").alias("head"))


@query("clone_folders", "SELECT min(url || '_' || substr(md5(url), 1, 12)) AS name FROM pages WHERE substr(md5(url), 1, 12) = (SELECT min(substr(md5(url), 1, 12)) FROM pages)")
def clone_folders(spark, d):
    name = F.substring(F.md5("url"), 1, 12)
    p = A.table(spark, d, "pages")
    return K.clone_folder(p.select(F.concat_ws("_", "url", name).alias("name")), p.agg(F.min(name)).first()[0])


@query("path_lookup", f"WITH {FILES} SELECT id, path FROM files WHERE path = (SELECT max(path) FROM files)")
def path_lookup(spark, d):
    f = A.files(spark, d).select("id", "path")
    return f.where(F.col("path") == f.agg(F.max("path")).first()[0])
