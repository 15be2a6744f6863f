"""Import extraction per language, complexity and structure signatures (table functions).

Extraction needs parsers, tokenizers and places of matches, so it is one Arrow-batched pandas
map over the files; resolution and reasons are joins and expressions.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import code_metrics

ROWS = "path string, raw string, line int, type string"


def python_imports(source: str) -> list[tuple[str, int, str]]:
    """(raw, line, type); a syntax error gives none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, node.lineno, "import") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("." * node.level + (node.module or ""), node.lineno, "from_import"))
    return out


def notebook_cells(content: str) -> list[tuple[int, str]]:
    """(number among all cells from 1, source) of code cells of a Python notebook."""
    try:
        nb = json.loads(content)
    except ValueError:
        return []
    if not isinstance(nb, dict):
        return []
    if str((nb.get("metadata", {}).get("kernelspec") or {}).get("language", "python")).lower() != "python":
        return []
    text = lambda s: "".join(s) if isinstance(s, list) else str(s or "")
    return [(n, text(c.get("source"))) for n, c in enumerate(nb.get("cells", []), 1) if isinstance(c, dict) and c.get("cell_type") == "code"]


def notebook_imports(content: str) -> list[tuple[str, int, str]]:
    """Per code cell; the line is the cell's number. A cell with magics does not parse and gives none."""
    return [(raw, n, f"notebook_{kind}") for n, cell in notebook_cells(content) for raw, _, kind in python_imports(cell)]


def notebook_source(content: str) -> str:
    """Code cells as one source, magic lines blanked."""
    return "\n".join("\n".join("" if x.lstrip().startswith(("%", "!")) else x for x in cell.split("\n")) for _, cell in notebook_cells(content))


def strip_js(source: str) -> str:
    """Blanks comments, keeps strings and line ends; aware of quotes, templates and regex literals."""
    out, i, n, last = [], 0, len(source), ""
    while i < n:
        c = source[i]
        if c == "/" and source[i + 1 : i + 2] == "/":
            while i < n and source[i] != "\n":
                i += 1
            continue
        if c == "/" and source[i + 1 : i + 2] == "*":
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append("\n" * source.count("\n", i, end))
            i = end
            continue
        if c in "'\"`":
            j = i + 1
            while j < n and source[j] != c and (c == "`" or source[j] != "\n"):
                j += 2 if source[j] == "\\" else 1
            out.append(source[i : j + 1])
            i, last = j + 1, c
            continue
        if c == "/" and (not last or last in "=(,:[!&|?{};+-*%<>~^"):
            j, klass = i + 1, False
            while j < n and source[j] != "\n" and (klass or source[j] != "/"):
                klass = source[j] == "[" or (klass and source[j] != "]")
                j += 2 if source[j] == "\\" else 1
            out.append(" ")
            i, last = j + 1, "/"
            continue
        out.append(c)
        if not c.isspace():
            last = c
        i += 1
    return "".join(out)


_JS = re.compile(r"""(?:^|[;}\s])(?:import|export)\s+(?:[\w*{}\s,$]+?\s+from\s*)?(['"])([^'"\n]+)\1|\b(?:require|import)\s*\(\s*(['"])([^'"\n]+)\3\s*\)""")


def js_imports(source: str) -> list[tuple[str, int, str]]:
    """Import and export sources, require and dynamic import of literals."""
    code = strip_js(source)
    return [(m[2] or m[4], code.count("\n", 0, m.start(2) if m[2] else m.start(4)) + 1, "import") for m in _JS.finditer(code)]


def script_blocks(source: str) -> str:
    """Bodies of all script elements, else the whole."""
    found = re.findall(r"<script[^>]*>(.*?)</script>", source, re.S | re.I)
    return "\n".join(found) if found else source


def go_imports(source: str) -> list[tuple[str, int, str]]:
    """Single and grouped imports outside comments."""
    code = strip_js(source)
    out = []
    for m in re.finditer(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', code, re.M):
        out.append((m[1], code.count("\n", 0, m.start(1)) + 1, "import"))
    for m in re.finditer(r"^\s*import\s*\((.*?)\)", code, re.M | re.S):
        top = code.count("\n", 0, m.start(1)) + 1
        for k, line in enumerate(m[1].split("\n")):
            got = re.search(r'"([^"]+)"', line)
            if got:
                out.append((got[1], top + k, "import"))
    return out


#: fixed values: regular import forms, (pattern, type) per language; group 1 is the raw import
_REGULAR = {
    "Java": [(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "import")],
    "Kotlin": [(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "import")],
    "C": [(r"#include\s*<([^>]+)>", "include_system"), (r'#include\s*"([^"]+)"', "include")],
    "C++": [(r"#include\s*<([^>]+)>", "include_system"), (r'#include\s*"([^"]+)"', "include")],
    "Ruby": [(r"require_relative\s+['\"]([^'\"]+)['\"]", "require_relative"), (r"(?<!_)require\s+['\"]([^'\"]+)['\"]", "require")],
    "Rust": [(r"(?:use|mod)\s+([\w:]+)", "use")],
    "PHP": [(r"(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", "include"), (r"use\s+([\w\\]+)", "use")],
}


def _regular(language: str):
    rules = [(re.compile(p), kind) for p, kind in _REGULAR[language]]

    def find(source: str) -> list[tuple[str, int, str]]:
        return [(m[1], source.count("\n", 0, m.start(1)) + 1, kind) for p, kind in rules for m in p.finditer(source)]

    return find


#: Extractor of each language
EXTRACTORS = {"Python": python_imports, "JavaScript": js_imports, "TypeScript": js_imports, "Go": go_imports, "Jupyter Notebook": notebook_imports, "Vue": lambda s: js_imports(script_blocks(s)), "Svelte": lambda s: js_imports(script_blocks(s)), **{x: _regular(x) for x in _REGULAR}}


def imports(files: DataFrame) -> DataFrame:
    """L4: import rows of all files (path, language, content): path, raw, line, type.

    One pass over the files whose language has an extractor; repeated imports have a row
    and a line each.  Files without content give none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *r) for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) if isinstance(c, str) for r in EXTRACTORS[lang](c)]
            yield pd.DataFrame(rows, columns=["path", "raw", "line", "type"])

    known = files.where(F.col("language").isin(list(EXTRACTORS)) & F.col("content").isNotNull())
    return known.select("path", "language", "content").mapInPandas(run, ROWS)


def resolve_relative(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds resolved for includes of a path that exists, by type of import row.

    Quoted C and PHP includes and relative Ruby requires (as they are, then with .rb) start at
    the file's folder; a Java or Kotlin class is a path from the root.  Other rows stay null.
    """
    here = F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), "raw")
    klass = F.translate("raw", ".", "/")
    options = (
        F.when(F.col("type") == "include", F.array(here))
        .when(F.col("type") == "require_relative", F.array(here, F.concat(here, F.lit(".rb"))))
        .when((F.col("type") == "import") & F.col("path").endswith(".java"), F.array(F.concat(klass, F.lit(".java"))))
        .when((F.col("type") == "import") & F.col("path").endswith(".kt"), F.array(F.concat(klass, F.lit(".kt")), F.concat(klass, F.lit(".java"))))
    )
    r = rows.withColumn("__id", F.xxhash64("path", "raw", "line", "type"))
    cand = r.select("__id", F.posexplode(options).alias("__n", "__c")).withColumn("__c", normal_path(F.col("__c")))
    hit = cand.join(known.select(F.col("path").alias("__c")).distinct(), "__c").groupBy("__id").agg(F.min_by("__c", "__n").alias("resolved"))
    return r.join(hit, "__id", "left").select(*rows.columns, "resolved")


def resolve_python(rows: DataFrame, known: DataFrame) -> DataFrame:
    """X11: adds resolved. Package, module, then a unique suffix match; relative imports climb.

    Candidates are exploded and met by one equi-join with the known paths; suffixes of known
    paths are exploded likewise, so no theta join is needed.
    """
    parts = F.filter(F.split(F.regexp_replace("raw", r"^\.+", ""), r"\."), lambda x: x != "")
    dots = F.length(F.regexp_extract("raw", r"^(\.*)", 1))
    folder = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    base = F.array_join(F.concat(F.when(dots > 0, folder).otherwise(F.array().cast("array<string>")), parts), "/")
    r = rows.withColumn("__id", F.xxhash64("path", "raw", "line", "type")).withColumn("__base", base).withColumn("__rel", dots > 0)
    cand = r.select("__id", F.posexplode(F.array(F.concat("__base", F.lit("/__init__.py")), F.concat("__base", F.lit(".py")))).alias("__n", "__c"))
    hit = cand.join(known.select(F.col("path").alias("__c")).distinct(), "__c").groupBy("__id").agg(F.min_by("__c", "__n").alias("__exact"))
    tails = known.select("path", F.split("path", "/").alias("s")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.array_join(F.slice("s", k, F.size("s")), "/"))).alias("__c"))
    suffix = r.where(~F.col("__rel") & (F.col("__base") != "")).select("__id", F.explode(F.array(F.concat("__base", F.lit("/__init__.py")), F.concat("__base", F.lit(".py")))).alias("__c"))
    loose = suffix.join(tails, "__c").groupBy("__id").agg(F.countDistinct("path").alias("__k"), F.min("path").alias("__path")).where("__k = 1").select("__id", "__path")
    return r.join(hit, "__id", "left").join(loose, "__id", "left").select(*rows.columns, F.coalesce("__exact", "__path").alias("resolved"))


#: fixed values: candidate endings in order
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json"]


def normal_path(path: Column) -> Column:
    """Folds '.' and '..'; null if it leaves the root."""
    keep = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(keep, F.array().cast("array<string>"), step), "/")


def resolve_js(rows: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds resolved. Aliases, then relative or rooted paths; bare names stay null.

    Endings are tried in order: as is, with each extension, as a folder's index file.
    """
    raw = F.col("raw")
    target = F.when(raw.startswith("."), F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), raw)).when(raw.startswith("/"), F.substring(raw, F.lit(2), F.length(raw)))
    for prefix, to in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        target = F.when(raw.startswith(prefix), F.concat(F.lit(to), F.substring(raw, F.lit(len(prefix) + 1), F.length(raw)))).otherwise(target)
    endings = JS_ENDINGS + [f"/index{e}" for e in JS_ENDINGS if e]
    r = rows.withColumn("__id", F.xxhash64("path", "raw", "line", "type")).withColumn("__t", normal_path(target))
    cand = r.where("__t is not null").select("__id", F.posexplode(F.array(*[F.concat("__t", F.lit(e)) for e in endings])).alias("__n", "__c"))
    hit = cand.join(known.select(F.col("path").alias("__c")).distinct(), "__c").groupBy("__id").agg(F.min_by("__c", "__n").alias("resolved"))
    return r.join(hit, "__id", "left").select(*rows.columns, "resolved")


def aliases(files: DataFrame) -> dict[str, str]:
    """The aliases of a scanned tree: those of the root's tsconfig.json, or else jsconfig.json, whichever can be read.

    ``files``: path, content; two of them at most are looked at.
    """
    found = {r["path"]: r["content"] for r in files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("path", "content").collect()}
    for name in ("tsconfig.json", "jsconfig.json"):
        got = read_aliases(found[name]) if found.get(name) is not None else None
        if got is not None:
            return got
    return {}


def read_aliases(config: str) -> dict[str, str] | None:
    """Prefixes of compilerOptions.paths, first target each; comments outside strings go. None for what is no JSON object."""
    try:
        options = json.loads(strip_js(config)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return None
    base = str(options.get("baseUrl", ".")).strip("./")
    out = {}
    for k, v in (options.get("paths") or {}).items():
        if v:
            to = str(v[0]).removesuffix("*").removeprefix("./")
            out[k.removesuffix("*")] = f"{base}/{to}" if base else to
    return out


def complexity(files: DataFrame) -> DataFrame:
    """Loc, complexity, functions, complexity_source; nulls where not measured."""
    scripts = {".js", ".jsx", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx"}

    def measured(ext: str, source: str) -> tuple[int, int] | None:
        if ext not in scripts and ext not in (".py", ".pyi") or len(source.encode(errors="ignore")) > V.MAX_FILE_BYTES:
            return None
        branches, functions = code_metrics.script_counts(source, ext) if ext in scripts else code_metrics.python_counts(source)
        return branches + 1, functions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, ext, c in zip(pdf["path"], pdf["extension"], pdf["content"], strict=True):
                lines = None if c is None else sum(bool(x.strip()) for x in c.splitlines())
                got = None if c is None else measured(ext.lower(), c)
                rows.append((path, lines, *(got or (None, None)), "cyclomatic" if got else "size_fallback"))
            out = pd.DataFrame(rows, columns=["path", "loc", "complexity", "functions", "complexity_source"])
            yield out.astype({"loc": "Int64", "complexity": "Int64", "functions": "Int64"})

    return files.select("path", "extension", "content").mapInPandas(run, "path string, loc long, complexity long, functions long, complexity_source string")


def python_signature(source: str) -> tuple[list[str], list[str], list[str]] | None:
    """(imports, exports, declarations with argument names); null if unparseable."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    exports, names = [], []
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, ast.List | ast.Tuple):
            exports += [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            names.append(f"def {n.name}({','.join(a.arg for a in n.args.args)})")
        elif isinstance(n, ast.ClassDef):
            names.append(f"class {n.name}({','.join(ast.unparse(b) for b in n.bases)})")
    return [r for r, _, _ in python_imports(source)], exports, names


def js_signature(source: str) -> tuple[list[str], list[str], list[str]]:
    code = strip_js(source)
    exports = re.findall(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)", code)
    names = re.findall(r"\b(?:function|class|interface|enum)\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", code)
    return [r for r, _, _ in js_imports(source)], exports, [a or b for a, b in names]


def fingerprints(files: DataFrame) -> DataFrame:
    """Content, imports, exports and structure hashes per file (path, extension, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, ext, c in zip(pdf["path"], pdf["extension"], pdf["content"], strict=True):
                got = None
                if c is not None:
                    got = python_signature(c) if ext == ".py" else js_signature(c) if ext in (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs") else None
                rows.append((path, c, *(got or ([], [], [])), got is None))
            yield pd.DataFrame(rows, columns=["path", "content", "imports", "exports", "names", "parse_error"])

    from ..functions.scalars import list_hash, set_hash

    got = files.select("path", "extension", "content").mapInPandas(run, "path string, content string, imports array<string>, exports array<string>, names array<string>, parse_error boolean")
    return got.select("path", F.md5("content").alias("content_hash"), set_hash(F.col("imports")).alias("imports_hash"), set_hash(F.col("exports")).alias("exports_hash"), F.when(F.col("parse_error"), "").otherwise(list_hash(F.col("names"))).alias("structure_hash"), "parse_error")


def snippets(sections: DataFrame, selected: DataFrame, most: int = 5, chars: int = 2000) -> DataFrame:
    """Files named in backticks, in order, up to the first repeat or ``most``.

    ``sections``: section, text; ``selected``: path, content.
    """
    named = sections.select("section", F.posexplode(F.regexp_extract_all("text", F.lit(r"`([\w./-]+\.\w+)`"), F.lit(1))).alias("pos", "path"))
    w = Window.partitionBy("section").orderBy("pos")
    again = F.row_number().over(Window.partitionBy("section", "path").orderBy("pos")) > 1
    marked = named.withColumn("again", again).withColumn("stop", F.max(F.col("again").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = marked.where("stop = 0").join(selected.select("path", F.substring("content", 1, chars).alias("snippet")), "path")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("section", "n", "path", "snippet")
