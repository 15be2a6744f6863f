"""Neural-network models read from Python sources with ``ast``, never run.

A file's names are resolved through its imports first; then each way to write a model gives
rows of layers: module classes, sequential containers, ``add`` calls, functional graphs,
pretrained factories and, in files that import a framework, functions that only make layers.
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import networks

ROWS = "path string, nth int, model string, base string, pos int, id string, type string, category string, params map<string,string>"
TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
#: length of a source up to which a task remembers what it gives, for equal files
SHORT = 4096


def walked(node: ast.AST) -> list[ast.AST]:
    """All nodes below, in the order of ``ast.walk``, which makes a generator for each."""
    out = [node]
    for n in out:
        for name in n._fields:
            value = getattr(n, name, None)
            if isinstance(value, ast.AST):
                out.append(value)
            elif isinstance(value, list):
                out += [x for x in value if isinstance(x, ast.AST)]
    return out


class Names:
    """What a file's names stand for: imports, and which classes are modules."""

    def __init__(self, nodes: list[ast.AST]) -> None:
        self.of: dict[str, str] = {}
        classes: dict[str, list[str]] = {}
        for node in nodes:
            if isinstance(node, ast.Import):
                for a in node.names:
                    # ``import a.b`` binds a alone
                    self.of[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    self.of[a.asname or a.name] = f"{node.module}.{a.name}" if node.module else a.name
            elif isinstance(node, ast.ClassDef):
                classes[node.name] = [self.dotted(b) for b in node.bases]
        # a class is a module if a base is, however far up
        self.modules = {name for name, bases in classes.items() if any(self.full(b) in V.NN_BASES for b in bases)}
        while more := {n for n, bases in classes.items() if n not in self.modules and self.modules.intersection(bases)}:
            self.modules |= more

    @staticmethod
    def dotted(node: ast.AST) -> str:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if isinstance(node, ast.Name):
            parts.append(node.id)
        elif parts:
            parts.append("?")
        return ".".join(reversed(parts))

    def full(self, dotted: str) -> str:
        head, dot, rest = dotted.partition(".")
        return self.of.get(head, head) + dot + rest

    def layer(self, node: ast.AST) -> str | None:
        """The layer type a call makes."""
        if not isinstance(node, ast.Call):
            return None
        name = self.dotted(node.func)
        full, leaf = self.full(name), name.split(".")[-1]
        if leaf in V.NN_CONTAINERS:
            return None
        if full.rpartition(".")[0] + "." in V.NN_PREFIXES or leaf in V.NN_CATEGORIES:
            return leaf
        return None

    def pretrained(self, node: ast.AST) -> str | None:
        """The architecture that a factory of trained models gives."""
        if not isinstance(node, ast.Call):
            return None
        full = self.full(self.dotted(node.func))
        text = lambda i: node.args[i].value if len(node.args) > i and isinstance(node.args[i], ast.Constant) and isinstance(node.args[i].value, str) else None
        if full.endswith(".from_pretrained"):
            owner = full.removesuffix(".from_pretrained").split(".")[-1]
            return None if owner.lower().endswith(tuple(V.NN_NOT_MODELS)) else text(0) or owner
        if full == "timm.create_model":
            return text(0) or "timm_model"
        if full == "torch.hub.load":
            return text(1) or "hub_model"
        for prefix in V.NN_PRETRAINED:
            if full.startswith(prefix):
                return full.removeprefix(prefix).split(".")[0]
        return None


def _value(node: ast.AST) -> str:
    return ast.unparse(node)


def layer_of(names: Names, call: ast.Call) -> tuple[str, str, dict[str, str]]:
    """(type, category, parameters by name) of a layer call; a wrapper stands for what it wraps."""
    kind, two_ways = names.layer(call), False
    if kind in V.NN_WRAPPERS and call.args and names.layer(call.args[0]):
        two_ways = kind == "Bidirectional"
        call = call.args[0]
        kind = names.layer(call)
    params = {k.arg: _value(k.value) for k in call.keywords if k.arg}
    for name, value in zip(networks.POSITIONAL.get(kind, []), call.args, strict=False):
        params.setdefault(name, _value(value))
    for old, new in networks.ALIASES.items():
        if old in params:
            params.setdefault(new, params[old])
    if two_ways:
        params["bidirectional"] = "True"
    return kind, "recurrent" if two_ways else V.NN_CATEGORIES.get(kind, "other"), params


def held(names: Names, node: ast.AST) -> list[ast.Call]:
    """Layer calls in a value: itself, or those inside containers, lists and dicts, in order."""
    if isinstance(node, ast.List | ast.Tuple):
        return [c for e in node.elts for c in held(names, e)]
    if isinstance(node, ast.Dict):
        return [c for e in node.values for c in held(names, e)]
    if isinstance(node, ast.ListComp):
        return held(names, node.elt)
    if not isinstance(node, ast.Call):
        return []
    if names.dotted(node.func).split(".")[-1] in V.NN_CONTAINERS:
        return [c for a in node.args for c in held(names, a)]
    return [node] if names.layer(node) else []


def is_sequential(names: Names, node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and names.dotted(node.func).split(".")[-1] == "Sequential"


def models_of(source: str) -> list[tuple[str, str, list[tuple[str, ast.Call]], Names]]:
    """(model, kind, [(layer id, call)], names) of all models in a source; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    nodes = walked(tree)
    names = Names(nodes)
    out: list[tuple[str, str, list[tuple[str, ast.Call]], Names]] = []
    used: set[int] = set()

    def add(model: str, kind: str, layers: list[tuple[str, ast.Call]]) -> None:
        if layers:
            used.update(id(c) for _, c in layers)
            out.append((model, kind, layers, names))

    def label(target: ast.AST) -> str:
        return _value(target).removeprefix("self.")

    def assigned(body: list[ast.stmt]) -> Iterator[tuple[str, ast.expr]]:
        for node in body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1:
                yield label(node.targets[0]), node.value
            elif isinstance(node, ast.AnnAssign) and node.value is not None:
                yield label(node.target), node.value
            elif isinstance(node, ast.If | ast.For | ast.With):
                yield from assigned(node.body + getattr(node, "orelse", []))

    # classes: what their set-up assigns
    for node in nodes:
        if isinstance(node, ast.ClassDef) and node.name in names.modules:
            setup = next((f for f in node.body if isinstance(f, ast.FunctionDef) and f.name in ("__init__", "setup", "build")), None)
            layers = []
            for name, value in assigned(setup.body if setup else []):
                calls = held(names, value)
                layers += [(name if len(calls) == 1 else f"{name}.{k}", c) for k, c in enumerate(calls)]
            add(node.name, "class", layers)
            if setup and layers:
                used.update(map(id, walked(setup)))
    scopes = [tree, *(n for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))]
    for scope in scopes:
        body = scope.body
        # containers of their own, filled at once or by add
        grown: dict[str, list[tuple[str, ast.Call]]] = {}
        for name, value in assigned(body):
            if is_sequential(names, value) and id(value) not in used:
                grown[name] = [(f"{name}.{k}", c) for k, c in enumerate(held(names, value)) if id(c) not in used]
        for node in body:
            call = node.value if isinstance(node, ast.Expr) else None
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "add" and call.args:
                name = label(call.func.value)
                if name in grown:
                    grown[name] += [(f"{name}.{len(grown[name]) + k}", c) for k, c in enumerate(held(names, call.args[0]))]
        for name, layers in grown.items():
            add(name, "sequential", layers)
        # functional graphs: layers called on what came before, up to the outputs of Model(...)
        made: dict[str, tuple[str, ast.Call, list[str]]] = {}
        values = dict(assigned(body))
        for name, value in assigned(body):
            if isinstance(value, ast.Call) and names.layer(value.func):
                inputs = [_value(x) for a in value.args for x in (a.elts if isinstance(a, ast.List | ast.Tuple) else [a])]
                # a name used again stands for what it held when it was read
                made[name] = (name, value.func, [made.get(i, i) for i in inputs])
            elif isinstance(value, ast.Call) and names.full(names.dotted(value.func)) in V.NN_BASES and made:
                ends = [k.value for k in value.keywords if k.arg == "outputs"] or value.args[1:2]
                order: list[tuple[str, ast.Call]] = []

                def visit(step) -> None:
                    if isinstance(step, tuple):
                        for before in step[2]:
                            visit(before)
                        if id(step[1]) not in {id(c) for _, c in order}:
                            order.append((step[0], step[1]))

                for end in ends:
                    for x in end.elts if isinstance(end, ast.List | ast.Tuple) else [end]:
                        visit(made.get(_value(x)))
                add(name, "functional", [(f"{n}.{k}", c) for k, (n, c) in enumerate(order)])
        # factories of trained models
        for name, value in values.items():
            arch = names.pretrained(value)
            if arch is not None and id(value) not in used:
                used.add(id(value))
                out.append((name, f"pretrained:{arch}", [(name, value)], names))
    # functions that only make layers, in files that import a framework
    if any(x.split(".")[0] in V.NN_FRAMEWORKS for x in names.of.values()):
        for scope in scopes:
            # a class's set-up is used with all it holds
            if isinstance(scope, ast.FunctionDef | ast.AsyncFunctionDef) and id(scope) not in used:
                loose = [c for n in scope.body for c in walked(n) if names.layer(c) and id(c) not in used]
                inner = {id(x) for c in loose for a in c.args for x in walked(a)}
                loose = [c for c in loose if id(c) not in inner]
                if len(loose) >= V.NN_LOOSE:
                    add(scope.name, "heuristic", [(f"{scope.name}.{k}", c) for k, c in enumerate(sorted(loose, key=lambda c: (c.lineno, c.col_offset)))])
    return out


def layer_rows(source: str) -> list[tuple]:
    """(nth model, model, base, pos, id, type, category, parameters) of a source."""
    out = []
    for nth, (model, kind, calls, names) in enumerate(models_of(source)):
        if kind.startswith("pretrained:"):
            out.append((nth, model, kind, 0, model, "Pretrained", "pretrained", {"arch": kind.partition(":")[2]}))
            continue
        out += [(nth, model, kind, pos, name, *layer_of(names, c)) for pos, (name, c) in enumerate(calls)]
    return out


def models(files: DataFrame) -> DataFrame:
    """Layer rows of all models in Python files and notebooks (path, content).

    A notebook is read as one source with its magics blanked, or cell by cell if that does
    not parse.  Files without content or models give none.  Parsing takes far longer than
    reading, so files are dealt over all tasks, however few bytes they have.
    """

    def read(notebook: bool, content: str) -> list[tuple]:
        if not notebook:
            return layer_rows(content)
        from .extract import notebook_cells, notebook_source

        whole = notebook_source(content)
        try:
            ast.parse(whole)
        except (SyntaxError, ValueError):
            cells = [layer_rows(cell) for _, cell in notebook_cells(content)]
            return [(1000 * k + r[0], *r[1:]) for k, rows in enumerate(cells) for r in rows]
        return layer_rows(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = functools.lru_cache(256)(read)
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if content is not None:
                    found = (seen if len(content) <= SHORT else read)(path.endswith(".ipynb"), content)
                    rows += [(path, *r[:7], sorted(r[7].items())) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = files.select("path", "content").repartition(tasks, "path").mapInArrow(run, ROWS)
    return networks.blocks(got, ["path", "nth"])


def named(layers: DataFrame, name: str) -> DataFrame:
    """Layers of the models of one name; of all where it is blank."""
    return layers if not name.strip() else layers.where(F.lower("model") == name.strip().lower())


def twins(layers: DataFrame, signature: str = "type") -> DataFrame:
    """How many adjacent equal layers each layer stands among. ``layers``: model, pos, signature."""
    from .ranking import with_island

    r = with_island(layers, ["model"], ["pos"], signature)
    return r.join(r.groupBy("model", "island").agg(F.count(F.lit(1)).alias("twins")), ["model", "island"]).select("model", "pos", "twins")
