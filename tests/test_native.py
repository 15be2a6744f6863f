"""Native face: small fixtures for the rules of scan, extraction, roles, graph, diff and streams."""

import json
import math
import os
import random

import pytest
from graphloom.functions import scalars as S
from graphloom.operators import code_metrics, degrees, diff, extract, figures, graph, metrics, networks, nn_source, ranking, retrieval, roles, rollup, tours, visual
from graphloom.sources import events, files
from pyspark.sql import functions as F


def col(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def test_paths_and_names(spark):
    paths = ["a/b/c.py", "x.tar.gz", ".env", "Makefile", "src/api/R.TSX", "docs/guide.md"]
    assert col(spark, paths, S.extension(F.col("x"))) == [".py", ".gz", "", "", ".TSX", ".md"]
    assert col(spark, paths, S.language(F.col("x"))) == ["Python", "Unknown", "Unknown", "Makefile", "TypeScript", "Markdown"]
    assert col(spark, ["a/b/c/d.py", "x.py", "a/x.py"], S.module(F.col("x"), 2)) == ["a/b", "(root)", "a"]
    assert col(spark, ["Hello, World!", "--", "a_b"], S.slug(F.col("x"))) == ["hello-world", "root", "a-b"]
    assert col(spark, [500, 1536, 3 * 1024 * 1024, 20736], S.human_size(F.col("x")), "x long") == ["500 B", "1.5 KB", "3.0 MB", "20.2 KB"]
    assert col(spark, ["3x224x224", "3, 0", "a", "64"], S.parse_shape(F.col("x"))) == [[3, 224, 224], None, None, [64]]
    assert col(spark, ["a\n\n b\r\n\t\nc"], S.loc(F.col("x"))) == [3]


def test_layers_and_skips(spark):
    assert col(spark, ["src/Routes/x.py", "a/model.py", "zzz"], S.layer_of_path(F.col("x"))) == ["routes", "models", "other"]
    rows = [("package-lock.json", 1), (".env", 1), ("a.png", 1), (".hidden", 1), (".gitignore", 1), ("big.py", 600_000), ("nb.ipynb", 600_000), ("ok.py", 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, n long").select(S.skip_reason(F.col("p"), F.col("n"))).collect()]
    assert got == ["ignored_filename", "secret_file", "ignored_extension", "hidden_file", None, "exceeds_max_size_512KB", None, None]
    assert col(spark, ["node_modules/a.js", "a/.git/x", "src/a.js"], S.pruned_dir(F.col("x"))) == [True, True, False]


def test_urls(spark):
    urls = ["https://github.com/o/r.git", "https://gitlab.com/g/sub/r", "http://github.com/o/r", "https://u@github.com/o/r", "https://evil.com/o/r", "https://github.com:8080/o/r", "https://github.com/o/..", "https://github.com/o"]
    got = col(spark, urls, S.parse_repo_url(F.col("x")))
    assert [(g["ok"], g["reason"]) for g in got] == [(True, None), (True, None), (False, "scheme"), (False, "credentials"), (False, "host"), (False, "port"), (False, "traversal"), (False, "path")]
    assert (got[0]["owner"], got[0]["repo"], got[1]["owner"], got[1]["repo"]) == ("o", "r", "g/sub", "r")
    assert col(spark, [" git@github.com:o/r.git", "o/r", "www.github.com/o/r", "https://www.gitlab.com/a/b"], S.normalize_url(F.col("x"))) == ["https://github.com/o/r.git", "https://github.com/o/r", "https://github.com/o/r", "https://gitlab.com/a/b"]


def test_scan(spark, tmp_path):
    for p, text in (("src/main.py", "import os\n"), ("node_modules/x.js", "1"), ("README.md", "hi"), ("logo.png", "p")):
        os.makedirs(tmp_path / "r" / os.path.dirname(p), exist_ok=True)
        (tmp_path / "r" / p).write_text(text)
    got = {r["path"]: r for r in files.scan(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"src/main.py", "README.md", "logo.png"}
    assert got["logo.png"]["reason"] == "ignored_extension" and got["logo.png"]["content"] is None
    assert (got["src/main.py"]["language"], got["src/main.py"]["depth"], got["src/main.py"]["content"]) == ("Python", 1, "import os\n")
    assert files.within_limits(files.scan(spark, str(tmp_path / "r"), content=False)).first()["accepted"]


def test_scan_of_all_kinds_of_names(spark, tmp_path):
    root = tmp_path / "tree"
    texts = {"pkg/__init__.py": "a", "pkg/__tests__/t.py": "b", "_app.tsx": "c", ".env": "secret", ".gitignore": "d", ".hidden": "e", "pkg/_parts/deep/__main__.py": "f", "no.bin.d/x.PY": "g"}
    texts |= {f"many/d{i}/sub/_f{k}.py": str(i) for i in range(12) for k in range(5)}
    hidden = {".git/config": "x", "node_modules/a/b.js": "x", "pkg/.cache/c.py": "x"}
    for p, text in (texts | hidden).items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "loop").symlink_to(root)
    (root / "link.py").symlink_to(root / "_app.tsx")
    for most in (20_000, 7):  # a few entries a task need many rounds
        got = {r["path"]: r for r in files.scan(spark, f"file://{root}", most=most).collect()}
        assert set(got) == {*texts, "bad.py"}
        assert {p: r["reason"] for p, r in got.items() if r["reason"]} == {".env": "secret_file", ".hidden": "hidden_file"}
        assert all(r["content"] == (None if r["reason"] or p == "bad.py" else texts[p]) for p, r in got.items())
    assert got["no.bin.d/x.PY"]["extension"] == ".py" and got["pkg/_parts/deep/__main__.py"]["depth"] == 3 and got["bad.py"]["size"] == 2
    assert files.scan(spark, str(tmp_path / "none")).count() == 0
    assert "content" not in files.scan(spark, str(root), content=False).columns


def test_extractors(spark):
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": ["x = 1\n", "import numpy\n"]}, {"cell_type": "code", "source": "%magic\nimport os"}], "metadata": {}})
    js = "import a from 'x';\n// import b from 'no'\nconst q = require(\"./y\");\nexport { z } from './z'\nimport('dyn'); const s = \"import k from 'str'\"; /* import('c') */"
    rows = [("a.py", "Python", "import os, sys as s\nfrom ..p import q\n"), ("bad.py", "Python", "def ("), ("n.ipynb", "Jupyter Notebook", nb), ("a.ts", "TypeScript", js), ("m.go", "Go", 'import "fmt"\nimport (\n  "a/b"\n  // "no"\n)'), ("A.java", "Java", "import a.b.C;\nimport static a.d.*;"), ("a.c", "C", '#include <x.h>\n#include "y.h"'), ("a.rb", "Ruby", "require_relative 'u'\nrequire 'json'"), ("v.vue", "Vue", "<template/><script>import t from './t'</script>")]
    got = {}
    for r in extract.imports(spark.createDataFrame(rows, "path string, language string, content string")).collect():
        got.setdefault(r["path"], []).append((r["raw"], r["line"], r["type"]))
    assert sorted(got["a.py"]) == [("..p", 2, "from_import"), ("os", 1, "import"), ("sys", 1, "import")]
    assert "bad.py" not in got and got["n.ipynb"] == [("numpy", 2, "notebook_import")]
    assert sorted(x[0] for x in got["a.ts"]) == ["./y", "./z", "dyn", "x"]
    assert got["m.go"] == [("fmt", 1, "import"), ("a/b", 3, "import")]
    assert sorted(x[0] for x in got["A.java"]) == ["a.b.C", "a.d.*"] and sorted(got["a.c"]) == [("x.h", 1, "include_system"), ("y.h", 2, "include")]
    assert sorted(got["a.rb"]) == [("json", 2, "require"), ("u", 1, "require_relative")] and got["v.vue"][0][0] == "./t"


def test_resolvers(spark):
    known = spark.createDataFrame([(p,) for p in ("pkg/a/conf.py", "pkg/b/x.py", "pkg/b/__init__.py", "l/dup.py", "r/dup.py", "web/ui/index.ts", "web/lib/h.js")], "path string")
    imp = [("pkg/b/x.py", "conf", 1, "i"), ("pkg/b/x.py", "dup", 2, "i"), ("pkg/b/x.py", ".", 3, "i"), ("pkg/b/x.py", "..a.conf", 4, "i"), ("z.py", "pkg.b", 5, "i")]
    got = {r["line"]: r["resolved"] for r in extract.resolve_python(spark.createDataFrame(imp, "path string, raw string, line int, type string"), known).collect()}
    assert got == {1: "pkg/a/conf.py", 2: None, 3: "pkg/b/__init__.py", 4: "pkg/a/conf.py", 5: "pkg/b/__init__.py"}
    js = [("web/m.ts", "./ui", 1, "i"), ("web/m.ts", "react", 2, "i"), ("web/ui/a.ts", "../lib/h", 3, "i"), ("x.ts", "@/lib/h", 4, "i"), ("web/m.ts", "../../../q", 5, "i")]
    got = {r["line"]: r["resolved"] for r in extract.resolve_js(spark.createDataFrame(js, "path string, raw string, line int, type string"), known, {"@/": "web/"}).collect()}
    assert got == {1: "web/ui/index.ts", 2: None, 3: "web/lib/h.js", 4: "web/lib/h.js", 5: None}
    assert extract.read_aliases('{"$schema": "https://x/y", "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"] /* c */}}}') == {"@/": "src/"}


def test_aliases_of_a_tree(spark):
    ok, other = '{"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["./src/*"], "none": []}}}', '{"compilerOptions": {}}'
    tree = lambda *rows: extract.aliases(spark.createDataFrame(list(rows), "path string, content string"))
    assert tree(("tsconfig.json", ok), ("jsconfig.json", other)) == {"@/": "web/src/"}
    assert tree(("tsconfig.json", "{"), ("jsconfig.json", ok)) == tree(("tsconfig.json", None), ("jsconfig.json", ok)) == {"@/": "web/src/"}
    assert tree(("tsconfig.json", other), ("jsconfig.json", ok)) == tree(("a/tsconfig.json", ok)) == {}


PYTHON = [("if a: pass", 1, 0), ("if a: pass\nelif b: pass", 2, 0), ("x = a and b and c", 2, 0), ("assert a", 0, 0), ("for i in x:\n  pass\nelse:\n  pass", 1, 0), ("s = 'if and or'", 0, 0), ("y = 1 if a else 2", 1, 0), ("[x for x in y]", 0, 0), ("[x for x in y if a if b]", 2, 0), ("match x:\n    case 1 if a:\n        pass\n    case _:\n        pass", 3, 0), ("def f(:\n  if x and y:\n   'if'", 2, 1), ("async def f():\n  async for a in b: pass\n  assert a or b", 2, 1), ("f = lambda x: x", 0, 0)]
SCRIPTS = [
    ("p.catch(e)", 0, 0), ("try { f() } catch (e) {} finally {}", 1, 0), ("try {} catch {}", 1, 0), ("function f(a?, b) {}", 0, 1), ("type A<T> = T extends U ? X : Y extends Z ? 1 : 2;", 0, 0), ("const s = `a ${x ? y : z} if`", 1, 0),
    ("class A { m() {} get x() { return 1 } static async *g(): Promise<{a: number}> { } constructor(private a?: string) {} f = () => 1; abstract q(): void; o?(): void; catch(e) {} }", 0, 6),
    ("const o = { m() { return 1 }, 'k'(x) {}, [z](a) { }, async n() {}, p: (x) => x, if: 1 }", 0, 5), ("interface I { m(): void; f: (a: string) => void; opt?: number }", 0, 0), ("type F = (a: number) => (b: number) => void;\nconst g: (x: T) => void = (y) => { };", 0, 1),
    ("a && b || c ?? d; a &&= b; a ||= c; a ??= d; a?.b; a?.[0]", 3, 0), ("for (const a of b) {} for await (const x of y) {} while (1) {} do { } while (x)", 4, 0), ("switch (x) { case 1: case 2: break; default: z }", 2, 0), ("const r = /if (a) ? b/.test(x) ? 1 : 2", 1, 0),
    ("const a = x ? (y) => y : (z) => z", 1, 2), ("function h(a: number): void;\nfunction h(a: any) { }", 0, 1), ("const e = <div className='if' onClick={() => a && b}>what if you && me? {x ? <b>y?</b> : null}</div>; f(a ? 1 : 2)", 3, 1), ("function* gen() {} async function k() {} const z = function () {}", 0, 3),
    ("foo(function () {}); bar.function; x = {function: 1}", 0, 1), ("f(x => y => z)", 0, 2), ("function f(cb: (x: T) => void, d = (a) => a) {}", 0, 2), ("if (a) { b() }\nfoo() \n{ c }", 1, 0), ("export default class extends B { render() { return this.a ? 1 : 2 } }", 1, 1), ("let v = a as (x: T) => void", 0, 0), ("x = y ? {a() {}} : 2", 1, 1), ("// if (a)\n/* a ? b : c */ 'x ? y : z'", 0, 0), ("", 0, 0),
]


def test_branches_and_functions():
    assert [(s, *code_metrics.python_counts(s)) for s, *_ in PYTHON] == PYTHON
    assert [(s, *code_metrics.script_counts(s, ".tsx" if "<div" in s else ".ts")) for s, *_ in SCRIPTS] == SCRIPTS
    for broken in ("<<<{{{`${", "`${`${`", "({[", ")]}", "a ? (b", "'open", "/* open", "<a b={"):
        code_metrics.script_counts(broken, ".jsx")


def test_complexity_rows(spark):
    rows = [("a.py", ".py", "def f():\n    if x:\n        pass\n"), ("b.rs", ".rs", "fn x() {}\n\n}"), ("c.pyi", ".pyi", "  "), ("d.MTS", ".MTS", "const f = () => a && b ? 1 : 2 // if"), ("e.js", ".js", None), ("f.cts", ".cts", "x" * 600_000)]
    got = {r["path"]: tuple(r)[1:] for r in extract.complexity(spark.createDataFrame(rows, "path string, extension string, content string")).collect()}
    assert got == {"a.py": (3, 2, 1, "cyclomatic"), "b.rs": (2, None, None, "size_fallback"), "c.pyi": (0, 1, 0, "cyclomatic"), "d.MTS": (1, 3, 1, "cyclomatic"), "e.js": (None, None, None, "size_fallback"), "f.cts": (1, None, None, "size_fallback")}


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_degrees_and_roles(spark):
    e = edges_df(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("d", "b"), ("e", "b")])
    got = {r["file"]: (r["in_degree"], r["out_degree"], r["score"], r["role"]) for r in degrees.central_files(e).collect()}
    assert got["b"] == (3, 1, 10, "core_module") and got["a"] == (0, 1, 1, "entry_point") and got["c"] == (1, 0, 3, "leaf_utility")


def test_importance_terms(spark):
    p = spark.createDataFrame([("a", 10, 5, 4, 2), ("b", 5, 0, 0, None)], "id string, loc int, out_degree int, in_degree int, functions int")
    got = {r["id"]: r["importance"] for r in roles.importance(p).collect()}
    assert got == {"a": 100.0, "b": 12.5}
    zero = spark.createDataFrame([("a", 10, 0, 0, 0)], "id string, loc int, out_degree int, in_degree int, functions int")
    assert roles.importance(zero).first()["importance"] == 25.0


def test_classify_ladder(spark):
    rows = [("README.md", "README.md", ".md", ""), ("tests/test_a.py", "test_a.py", ".py", ""), ("app.py", "app.py", ".py", "app.listen(1)"), ("api/r.py", "r.py", ".py", "@app.get('/')\n@app.post('/')"), ("net.py", "net.py", ".py", "import torch\nclass N(nn.Module): pass"), ("x/y.py", "y.py", ".py", ""), ("c.py", "c.py", ".py", "A_B = 1\nC_D = 2\nE_F = 3\nG_H = 4")]
    f = spark.createDataFrame(rows, "path string, name string, extension string, content string")
    deg = degrees.degrees(edges_df(spark, [("app.py", "x/y.py")]))
    none = spark.createDataFrame([], "file string, score int")
    got = {r["path"]: r["role"] for r in roles.classify(f, deg, degrees.repo_averages(f, deg), none).collect()}
    assert got == {"README.md": "documentation", "tests/test_a.py": "test", "app.py": "entry_point", "api/r.py": "router", "net.py": "ml_model", "x/y.py": "internal_helper", "c.py": "config"}


def test_entry_points(spark):
    f = spark.createDataFrame([("main.py", "main.py", ".py", 0, "if __name__ == '__main__': pass\ndef main(): pass"), ("lib/u.py", "u.py", ".py", 1, "x = 1")], "path string, name string, extension string, depth int, content string")
    got = degrees.entry_points(f, degrees.degrees(edges_df(spark, [("main.py", "lib/u.py")]))).collect()
    assert [(r["file"], r["score"], r["signals"]) for r in got] == [("main.py", 12, ["main_fn", "main_guard"])]


def test_budget_skips_and_truncates(spark):
    rows = [("g", "a", 9.0, 400, 1), ("g", "b", 8.0, 4000, 2), ("g", "c", 7.0, 400, 3), ("h", "x", 9.0, 99_999, 1), ("h", "y", 8.0, 4, 2)]
    got = roles.budget_select(spark.createDataFrame(rows, "grp string, path string, score double, size long, pos long"), "grp", 30, 250).collect()
    assert sorted((r["grp"], r["path"], r["tokens"], r["truncated"]) for r in got) == [("g", "a", 100, False), ("g", "c", 100, False), ("h", "x", 250, True)]


def test_buckets_and_containers(spark):
    f = spark.createDataFrame([("l", p) for p in ("a.py", "b.py", "c.py", "root/x.py")], "layer string, path string")
    b = rollup.folder_buckets(f)
    assert sorted({r["bucket"] for r in b.collect()}) == ["root", "root-files"]
    g = spark.createDataFrame([("l", p) for p in ("s/a/1.py", "s/b/2.py", "s/c/3.py", "s/c/4.py")], "layer string, path string")
    merged = rollup.merge_singles(rollup.folder_buckets(g))
    assert [(r["id"], r["files"]) for r in rollup.containers(merged).collect()] == [("l__c", 2), ("l__standalone", 2)]
    assert sorted(map(tuple, rollup.container_files(merged).collect())) == [("l__c", "s/c/3.py"), ("l__c", "s/c/4.py"), ("l__standalone", "s/a/1.py"), ("l__standalone", "s/b/2.py")]


def test_labels_grow(spark):
    ids = ["a/x/__init__.py", "b/x/__init__.py", "b/y/__init__.py", "solo.py"]
    got = {r["id"]: r["label"] for r in ranking.disambiguate(spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert got == {"a/x/__init__.py": "a/x/__init__.py", "b/x/__init__.py": "b/x/__init__.py", "b/y/__init__.py": "y/__init__.py", "solo.py": "solo.py"}
    f = {r["id"]: r["label"] for r in ranking.folder_labels(spark.createDataFrame([("p/q/src",), ("r/q/src",), ("only",)], "id string")).collect()}
    assert f == {"p/q/src": "p/q/src", "r/q/src": "r/q/src", "only": "only"}


def test_repeats(spark):
    sig = ["p", *"abcd" * 12, "s"]
    rows = [("m", i, s) for i, s in enumerate(sig)] + [("n", i, "z") for i in range(12)]
    got = {r["model"]: (r["start"], r["length"], r["count"]) for r in ranking.label_repeats(spark.createDataFrame(rows, "model string, pos long, signature string")).collect()}
    assert got == {"m": (1, 4, 12), "n": (0, 1, 12)}


def dealt_before_python(df):
    """Whether rows are dealt over all tasks right before they go to Python."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :]


def test_sources_and_models_of_one_file_of_rows_are_read_by_all_tasks(spark):
    src = "import torch.nn as nn\nclass Net%d(nn.Module):\n    def __init__(self):\n        self.f = nn.Linear(8, 4)\n"
    found = nn_source.models(spark.createDataFrame([(f"{i}.py", src % (i % 7)) for i in range(40)], "path string, content string").coalesce(1))
    assert dealt_before_python(found)
    assert sorted((r["path"], r["model"]) for r in found.collect()) == sorted((f"{i}.py", f"Net{i % 7}") for i in range(40))
    rows = [(f"m{k}", i, s) for k in range(20) for i, s in enumerate(["p", *["x", "y"] * (k % 3 + 2)])]
    runs = ranking.label_repeats(spark.createDataFrame(rows[::-1], "model string, pos long, signature string").coalesce(1))
    assert dealt_before_python(runs)
    assert sorted(tuple(r) for r in runs.collect()) == sorted((f"m{k}", 1, 2, k % 3 + 2) for k in range(20))


def test_walk_is_that_of_ast():
    tree = nn_source.ast.parse("class A(B):\n    def f(self, *, k=[1, *x]):\n        return {**k, 'a': lambda q: (q, -q)}\n")
    assert nn_source.walked(tree) == list(nn_source.ast.walk(tree))


def test_graph_loops(spark):
    dag = edges_df(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")])
    assert {r["node"]: r["tier"] for r in graph.dag_tiers(dag).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2}
    assert [r["node"] for r in graph.kahn_order(dag).orderBy("rank").collect()] == ["a", "x", "b", "c"]
    assert not graph.has_cycle(dag)
    cyc = edges_df(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "a")])
    assert graph.has_cycle(cyc)
    bounded = sorted((r["length"], r["path"]) for r in graph.cycles_bounded(cyc, 3).collect())
    assert bounded == [(2, ["a", "b"]), (3, ["b", "c", "d"])] == [(len(c), c) for c in graph.cycles_sequential([tuple(r) for r in cyc.collect()])]
    assert sorted((r["node"], r["depth"]) for r in graph.reach(cyc, spark.createDataFrame([("c",)], "node string"), 2).collect()) == [("b", 2), ("c", 0), ("d", 1)]
    assert graph.shortest_path(cyc, ["e"], ["d"]) == ["e", "a", "b", "c", "d"]
    comp = {r["node"]: r["component"] for r in graph.components(edges_df(spark, [("a", "b"), ("c", "b"), ("y", "z")])).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert graph.tiers_sequential(["p", "q"], [("p", "q"), ("q", "p")])["p"] > 0


def test_label_propagation(spark):
    f = spark.createDataFrame([("l", n) for n in "abcdef"], "layer string, path string")
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")])
    got = {r["node"]: r["community"] for r in graph.label_propagation(f, e).collect()}
    assert got["a"] == got["b"] == got["c"] and got["d"] == got["e"] == got["f"]


def test_changes(spark):
    cols = "path string, content_hash string, imports_hash string, exports_hash string, structure_hash string, parse_error boolean"
    old = spark.createDataFrame([("same", "1", "i", "e", "s", False), ("cosm", "1", "i", "e", "s", False), ("struct", "1", "i", "e", "s", False), ("noimp", "1", "", "e", "s", False), ("gone", "1", "i", "e", "s", False), ("bin", "1", "", "", "", True)], cols)
    new = spark.createDataFrame([("same", "1", "i", "e", "s", False), ("cosm", "2", "i", "e", "s", False), ("struct", "2", "i2", "e", "s", False), ("noimp", "2", "", "e", "s", False), ("fresh", "1", "i", "e", "s", False), ("bin", "2", "", "", "", True)], cols)
    got = {r["path"]: r["change"] for r in diff.change_classes(old, new).collect()}
    assert got == {"same": "NONE", "cosm": "COSMETIC", "struct": "STRUCTURAL", "noimp": "STRUCTURAL", "gone": "DELETED", "fresh": "STRUCTURAL", "bin": "COSMETIC"}
    assert diff.update_policy(diff.change_classes(old, new)).first()["policy"] == "PARTIAL_UPDATE"


def test_fingerprints(spark):
    rows = [("a.py", ".py", "import os\n\ndef f(a, b): pass\n"), ("b.py", ".py", "import os\n# note\ndef f(a, b): pass\n"), ("c.ts", ".ts", "export function g() {}"), ("d.md", ".md", "x")]
    got = {r["path"]: r for r in extract.fingerprints(spark.createDataFrame(rows, "path string, extension string, content string")).collect()}
    assert got["a.py"]["structure_hash"] == got["b.py"]["structure_hash"] and got["a.py"]["content_hash"] != got["b.py"]["content_hash"]
    assert got["c.ts"]["exports_hash"] != "" and not got["c.ts"]["parse_error"] and got["d.md"]["parse_error"]


def test_chunks_and_search(spark):
    text = "\n\n".join(f"para {i} " + "word " * 80 for i in range(12))
    parts = retrieval.split_text(text, 1500, 200)
    assert all(len(p) <= 1500 for p in parts) and len(parts) > 3 and parts[0].startswith("para 0")
    c = retrieval.chunk(spark.createDataFrame([("f.py", text), ("empty.py", "  ")], "path string, content string"), "repo")
    rows = c.orderBy("n").collect()
    assert rows[0]["start_line"] == 1 and rows[0]["id"].startswith("repo_") and {r["file_path"] for r in rows} == {"f.py"}
    vec = retrieval.embed(c.withColumn("layer", F.lit("services")), retrieval.hashing_embedder(32))
    query = retrieval.hashing_embedder(32)([rows[2]["text"]])[0]
    best = retrieval.cosine_topk(vec, query, 3).collect()
    assert best[0]["id"] == rows[2]["id"] and abs(best[0]["score"] - 1) < 1e-6


def test_networks(spark):
    src = "import torch.nn as nn\nfrom keras import Sequential\nfrom keras.layers import Dense\nclass Net(nn.Module):\n    def __init__(self):\n        self.c = nn.Conv2d(3, 8, 3)\n        self.f = nn.Sequential(nn.Linear(8, 4), nn.ReLU())\nm = Sequential([Dense(64), Dense(6)])\n"
    got = nn_source.models(spark.createDataFrame([("a.py", src), ("z.py", src), ("bad.py", "(")], "path string, content string"))
    rows = networks.dedupe_models(got).orderBy("model", "pos").collect()
    assert [(r["model"], r["type"], r["params"].get("out_channels")) for r in rows if r["model"] == "Net"] == [("Net", "Conv2d", "8"), ("Net", "Linear", None), ("Net", "ReLU", None)]
    assert {r["path"] for r in rows} == {"a.py"}
    wide = networks.propagate_widths(got.where("path = 'a.py' and model = 'm'").select("model", "pos", "type", "params"))
    counted = wide.select("pos", networks.parameter_count(F.col("type"), F.col("params")).alias("n")).orderBy("pos").collect()
    assert [r["n"] for r in counted] == [None, 390]


def test_network_shapes_and_blocks(spark):
    layers = {
        "a": [("Conv2d", {"out_channels": "16", "stride": "2"}), ("ReLU", {}), ("MaxPool2d", {"kernel_size": "(3, 3)"}), ("Dropout", {}), ("Odd", {}), ("Conv2d", {"out_channels": "n"}), ("AdaptiveAvgPool2d", {}), ("Conv2d", {"out_channels": "[0, 32]", "stride": "(2, 2)"}), ("Flatten", {}), ("Linear", {"out_features": "10"}), ("Conv2d", {"out_channels": "4"})],
        "b": [("Embedding", {"embedding_dim": "64"}), ("LSTM", {"hidden_size": "32", "bidirectional": "True"}), ("Dense", {"units": "2048"}), ("LSTM", {"input_size": "7"})],
    }
    rows = [(m, i, kind, "other", p) for m, ls in layers.items() for i, (kind, p) in enumerate(ls)] + [("c", 0, "Pretrained", "pretrained", {"arch": "x"})]
    got = networks.blocks(spark.createDataFrame(rows, "model string, pos int, type string, category string, params map<string,string>"), ["model"]).orderBy("model", "pos").collect()
    third, least = round(0.5 / 3, 6), 1 / 64
    assert [r["extent"] for r in got] == [0.5, 0.5, third, third, third, third, round(least, 6), round(least / 2, 6), None, None, None, 1.0, 1.0, None, None, None]
    assert [r["width"] for r in got][:11] == [16, 16, 16, 16, None, None, None, 32, 32, 10, 4]
    assert [r["width"] for r in got][11:] == [64, 64, 2048, 7, None]
    # heights: of maps by their extent, of a head up to 36.1, of other flat layers up to 110
    assert [r["height"] for r in got] == [96.0, 96.0, 73.8, 73.8, 73.8, 73.8, 26.0, 26.0, 40.0, 29.5, 40.0, 110.0, 110.0, 110.0, 40.0, 40.0]
    assert (got[0]["thick"], got[5]["thick"], got[8]["thick"], got[11]["thick"], got[-1]["thick"]) == (22.3, 6.0, 6.0, 30.1, 6.0)
    values = ["3", " ( 4, 5)", "[0, 6]", "-2", "x", None, "(-1, 7)", "3.5", "True", "n * 2"]
    assert col(spark, values, networks.whole_number(F.col("x"))) == [3, 4, 6, None, None, None, 7, None, None, None]


def test_blocks_are_placed_in_a_row(spark):
    rows = [("m", 0, "Conv2d", "c", {"out_channels": "64"}, 100, [64, 112, 7]), ("m", 1, "ReLU", "a", {}, None, None)] + [("m", 2 + i, "Block", "b", {}, 6400, None) for i in range(5)] + [("m", 7, "Dense", "d", {"units": "3"}, None, None), ("m", 8, "Row", "r", {}, 1, [9]), ("m", 9, "Two", "t", {}, 1, [5, 9]), ("z", 0, "ReLU", "a", {}, None, None)]
    got = figures.place(spark.createDataFrame(rows, "model string, pos int, type string, category string, params map<string,string>, param_count long, shape array<bigint>"), ["model"]).orderBy("model", "pos").collect()
    log = lambda v, a, b: a + (b - a) * min(1, math.log2(v + 1) / 10)
    raw = [(log(112, 10, 80), log(7, 8, 60), log(64, 4, 34)), (22, 13, 5), (log(100, 24, 62), 15, log(100, 5, 20)), (log(3, 26, 80), 16, log(3, 5, 26)), (log(9, 12, 80), 14, 8), (log(9, 10, 80), 16, log(5, 4, 34))]
    k, cos, sin = 300 / max(h for h, _, _ in raw), math.cos(math.pi / 6) / 2, 0.25
    box = [(max(h * k, 118), min(max(d * k, 30), 186), max(w * k, 46)) for h, d, w in raw]
    middle, x = 54 + max(h / 2 + d * sin for h, d, _ in box), 64.0
    assert [(r["type"], r["repeat"]) for r in got] == [("Conv2d", 1), ("ReLU", 1), ("Block", 5), ("Dense", 1), ("Row", 1), ("Two", 1), ("ReLU", 1)]
    for r, (h, d, w) in zip(got, box, strict=False):
        ghost = 66 if r["repeat"] > 1 else 0
        want = (x, x + w + d * cos + ghost, middle - h / 2 - d * sin - ghost * sin * 2, middle + h / 2)
        assert all(abs(a - b) < 0.011 for a, b in zip((r["left"], r["right"], r["top"], r["bottom"]), want, strict=True)), (r, want)
        front = [(p["x"], p["y"]) for p in r["faces"]["front"]]
        assert abs(front[1][0] - front[0][0] - w) < 0.021 and abs(front[0][1] - front[3][1] - h) < 0.021
        x += w + d * cos + ghost + 104
    assert got[2]["params"] == 32_000 and got[-1]["left"] == 64.0


def test_runs_are_resized(spark):
    layers = [("m", i, t) for i, t in enumerate("aabbbca")]
    got = networks.resized_runs(spark.createDataFrame(layers, "model string, pos long, type string"), spark.createDataFrame([("m", 3, 1), ("m", 4, 9), ("m", 5, 3), ("m", 6, 0), ("x", 0, 5)], "model string, pos long, n int")).orderBy("pos").collect()
    assert "".join(r["type"] for r in got) == "aabccca" and [r["pos"] for r in got] == list(range(7))


def test_treemap_and_exports(spark):
    t = visual.treemap([{"path": "a/b/c/d.py", "size": 5, "complexity": None, "loc": 0}])
    assert t["children"][0]["name"] == "a/b/c" and t["children"][0]["children"][0] == {"name": "d.py", "path": "a/b/c/d.py", "value": 5, "loc": 0}
    n = spark.createDataFrame([("x", "g", 'la"b', 2.0), ("y", "g", "y", 1.0)], "id string, `group` string, label string, importance double")
    e = edges_df(spark, [("x", "y")])
    assert '"x" -> "y";' in visual.dot(n, e).first()[0] and '\\"' in visual.dot(n, e).first()[0]
    assert "n0 --> n1" in visual.mermaid(n, e).first()[0]


def test_tree_rows(spark):
    files = [("top.md", 0), ("a/b/c/d.py", 5), ("a/b/c/e/f/g.py", 7), ("x/y/z.py", 1), ("x/y/w/v.py", 2), ("q/r/s/t.py", 4), ("q/r/u.py", None)]
    got = {r["id"]: (r["parent"], r["name"], r["kind"], r["value"]) for r in visual.tree_rows(spark.createDataFrame(files, "path string, size long")).collect()}
    folders = {k: v for k, v in got.items() if v[2] == "folder"}
    assert folders == {"": (None, "root", "folder", 21), "a/b/c": ("", "a/b/c", "folder", 12), "a/b/c/e/f": ("a/b/c", "e/f", "folder", 7), "x/y": ("", "x/y", "folder", 3), "x/y/w": ("x/y", "w", "folder", 2), "q/r": ("", "q/r", "folder", 5), "q/r/s": ("q/r", "s", "folder", 4)}
    assert {k: v for k, v in got.items() if v[2] == "file"} == {p: (p.rpartition("/")[0], p.rpartition("/")[2], "file", n or 1) for p, n in files}
    assert visual.tree_rows(spark.createDataFrame([], "path string, size long")).count() == 0


def test_questions(spark):
    f = spark.createDataFrame([("a", ["in_cycle", "god_file"], 80_000)], "id string, flags array<string>, size long")
    q = tours.questions(f, spark.createDataFrame([(["a", "b"],)], "path array<string>")).first()["questions"]
    assert q == ["This and b import each other — why, and would you fix it?", "This file is ~2,000 lines. How would you split it?"]


def test_sse(spark):
    text = 'event: progress\ndata: {"stage": "x"}\n\ndata: not json\n\nid: 3\ndata: {"seq": 3}'
    rows = events.parse_frames(spark.createDataFrame([(text,)], "value string")).orderBy("pos").collect()
    assert [(r["event"], r["id"]) for r in rows] == [("progress", None), (None, "3")]


def test_limiter_and_breaker_batch_equals_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from graphloom.streaming import stateful

    t0 = datetime(2024, 1, 1)
    reqs = [(t0 + timedelta(seconds=s), "k") for s in (0, 10, 20, 30, 61, 62, 100)]
    r = spark.createDataFrame(reqs, "ts timestamp, key string")
    assert tuple(metrics.rate_limiter(r, "key", 2).first())[1:] == (4, 3)
    oks = [False] * 5 + [True, False] + [True]
    ev = [(t0 + timedelta(seconds=30 * i), "p", ok) for i, ok in enumerate(oks)]
    e = spark.createDataFrame(ev, "ts timestamp, provider string, ok boolean")
    assert tuple(metrics.breaker_states(e).first()) == ("p", "closed", 1) or tuple(metrics.breaker_states(e).first())[1] in ("closed", "open")
    src = str(tmp_path / "in")
    r.write.parquet(src)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = stateful.limiter_stream(spark.readStream.schema(r.schema).parquet(src), 2).writeStream.format("memory").queryName("lim").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(x["accepted"] for x in spark.table("lim").collect()) == 4
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_streams_take_a_key_by_time_and_forget_it(spark, tmp_path):
    from datetime import datetime, timedelta

    from graphloom.streaming import stateful

    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=s), "k", f"m{s}") for s in range(300)]
    random.Random(1).shuffle(rows)
    src = str(tmp_path / "events")
    e = spark.createDataFrame(rows, "ts timestamp, key string, message string")
    e.repartition(8).write.parquet(src)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    later = spark.createDataFrame([(t0 + timedelta(days=3), "other", "x")], e.schema)

    def run(name, stream):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema(e.schema).parquet(src)
    try:
        got = run("numbers", stateful.numbered_stream(source()))
        assert sorted((r["seq"], r["message"]) for r in got) == [(s + 1, f"m{s}") for s in range(300)]
        assert [(r["key"], r["events"]) for r in run("sessions", stateful.alive(source(), "2 seconds", "0 seconds"))] in ([], [("k", 300)])
        # two days on, the key is over and starts anew
        later.write.mode("append").parquet(src)
        run("numbers2", stateful.numbered_stream(source()))
        spark.createDataFrame([(t0 + timedelta(days=3, seconds=5), "other", "y")], e.schema).write.mode("append").parquet(src)
        spark.createDataFrame([(t0 + timedelta(days=3, seconds=9), "k", "again")], e.schema).write.mode("append").parquet(src)
        got = run("numbers3", stateful.numbered_stream(source()))
        assert {r["seq"] for r in got if r["message"] == "m0"} == {1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
