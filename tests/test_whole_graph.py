"""Graph queries over whole small fixtures, against brute force."""

import random

import pytest
from graphloom import queries as Q  # noqa: F401  registers all queries
from graphloom.operators import graph
from graphloom.plans import catalogue
from pyspark.sql import functions as F


@pytest.fixture
def tables(spark, tmp_path):
    """Writes edges as orders of two returned lines and every node as a part; gives the folder."""

    def write(edges, brand=lambda n: "b"):
        lines = [(k, j, "O", n, 1, 1.0, "R") for k, pair in enumerate(edges) for j, n in enumerate(pair, 1)]
        parts = [(n, "t", brand(n), f"p{n}", 10.0, 1) for n in sorted({n for pair in edges for n in pair})]
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_name string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


def test_components_equal_union_find(spark, tables):
    rng = random.Random(3)
    edges = [(rng.randrange(1, 120), rng.randrange(1, 120)) for _ in range(60)] + [(500 + i, 501 + i) for i in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        a, b = sorted(map(root, e))
        up[b] = a
    got = {r["node"]: r["component"] for r in catalogue.QUERIES["components"](spark, tables(edges)).collect()}
    assert got == {n: root(n) for n in up}


def fifo(edges):
    """Kahn's order with a sorted queue, and longest-path levels."""
    near, left = {}, {n: 0 for e in edges for n in e}
    for a, b in set(edges):
        near.setdefault(a, []).append(b)
        left[b] += 1
    queue = sorted(n for n in left if not left[n])
    level, order = dict.fromkeys(left, 0), []
    while queue:
        n = queue.pop(0)
        order.append(n)
        for m in sorted(near.get(n, [])):
            level[m] = max(level[m], level[n] + 1)
            left[m] -= 1
            if not left[m]:
                queue.append(m)
    return order, level


def test_dag_queries_equal_brute_force(spark, tables):
    rng = random.Random(5)
    edges = [(rng.randrange(1, 600), rng.randrange(1, 600)) for _ in range(300)] + [(50, 700), (700, 701), (701, 702)]
    d = tables([e for e in edges if e[0] != e[1]])
    order, level = fifo([e for e in edges if e[0] < e[1]])
    assert {r["node"]: r["tier"] for r in catalogue.QUERIES["dag_tiers"](spark, d).collect()} == level
    assert {r["node"]: r["level"] for r in catalogue.QUERIES["kahn_levels"](spark, d).collect()} == level
    got = catalogue.QUERIES["kahn_order"](spark, d).collect()
    assert [r["node"] for r in sorted(got, key=lambda r: r["rank"])] == order and [*range(1, len(order) + 1)] == sorted(r["rank"] for r in got)


def test_communities_cover_every_file(spark, tables):
    edges = [(a, b) for k in (1, 400, 900) for a, b in [(k, k + 1), (k + 1, k + 2), (k, k + 2)]] + [(1500, 1)]
    got = {int(r["node"]): (r["layer"], r["community"]) for r in catalogue.QUERIES["communities"](spark, tables(edges, lambda n: "x" if n < 1000 else "y")).collect()}
    want = {n: ("x", str(k + 1)) for k in (1, 400, 900) for n in range(k, k + 3)} | {1500: ("y", "1500")}
    assert got == want


def test_trace_up_has_no_depth_limit(spark, tables):
    d = tables([(i, i + 1) for i in range(1, 12)] + [(12, 4), (3, 12)])
    assert {r["node"]: r["depth"] for r in catalogue.QUERIES["trace_up"](spark, d).collect()} == {12: 0, 11: 1, 3: 1, 10: 2, 2: 2, 9: 3, 1: 3, 8: 4, 7: 5, 6: 6, 5: 7, 4: 8}


def test_flags_have_every_file_on_a_cycle(spark, tables):
    rng = random.Random(7)
    edges = [(rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(70)] + [(200 + i, 200 + (i + 1) % 6) for i in range(6)] + [(205, 300), (300, 301), (301, 300), (1, 200), (400, 401)]
    edges = [e for e in edges if e[0] != e[1]]

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want = {n for e in edges for n in e if n in reached(n)}
    d = tables(edges)
    flags = {r["id"]: r["flags"].split(",") for r in catalogue.QUERIES["hub_flags"](spark, d).collect()}
    assert {n for n, f in flags.items() if "in_cycle" in f} == want and {*range(200, 206), 300, 301} <= want
    assert {r["flag"]: r["files"] for r in catalogue.QUERIES["flag_counts"](spark, d).collect()}["in_cycle"] == len(want)
    assert want <= {r["id"] for r in catalogue.QUERIES["important_ids"](spark, d).collect()}


def test_models_of_files_with_ids_over_six_digits(spark, tables):
    # cut to six digits, the paths of files 123456 and 1234566 would be one
    ids = [123456, 1234566, 123466, 1234561, 123451, 7]
    got = catalogue.QUERIES["deduped_models"](spark, tables(list(zip(ids, ids[1:], strict=False)))).collect()
    want: dict = {}
    for n in ids:
        path = "f" + str(n).zfill(6)[:6]
        want[n % 10, n % 4] = min(path, want.get((n % 10, n % 4), path))
    assert sorted((r["model"], r["path"]) for r in got) == sorted((f"net{m}", path) for (m, _), path in want.items())


@pytest.fixture
def most_sent(spark):
    """Runs a frame's query and tells the most rows of any table that was broadcast for it."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda seq: (seq.apply(k) for k in range(seq.size()))

    def run(make):
        bus.waitUntilEmpty()
        ran = {e.executionId() for e in each(store.executionsList())}
        make().collect()
        bus.waitUntilEmpty()
        rows = []
        for e in each(store.executionsList()):
            if e.executionId() in ran or "BroadcastExchange" not in e.physicalPlanDescription():
                continue
            told = store.executionMetrics(e.executionId())
            for node in each(store.planGraph(e.executionId()).allNodes().toSeq()):
                if node.name() == "BroadcastExchange":
                    ids = [m.accumulatorId() for m in each(node.metrics()) if m.name() == "number of output rows"]
                    rows += [int(told.apply(i).replace(",", "")) for i in ids if told.contains(i)]
        return max(rows, default=0)

    return run


#: queries whose tables of a row per file must not go through the driver
NOT_SENT = ["selected_flags", "flag_counts", "important_ids", "question_order", "has_cycle"]


@pytest.mark.parametrize("name", NOT_SENT)
def test_no_table_of_a_row_per_file_is_sent_through_the_driver(spark, tables, most_sent, monkeypatch, name):
    monkeypatch.setattr(graph, "SENT_ROWS", 40, raising=False)
    rng = random.Random(11)
    edges = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(500)) if a != b]
    d = tables(edges)
    spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 200).alias("user_id")).write.parquet(f"{d}/events.parquet")
    assert most_sent(lambda: catalogue.QUERIES[name](spark, d)) <= 40


def round_trips(edges):
    """Files and imports of all simple cycles, found by walking each of them."""
    near, files, imports = {}, set(), set()
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def walk(path):
        for b in near.get(path[-1], ()):
            if b == path[0]:
                files.update(path)
                imports.update(zip(path, [*path[1:], b], strict=True))
            elif b > path[0] and b not in path:
                walk([*path, b])

    for root in near:
        walk([root])
    return files, imports


def cycle_rows(spark, folder):
    rows = [r for r in catalogue.QUERIES["insights"](spark, folder).collect() if r["kind"].startswith("cycle")]
    files = {int(r["item"]): r["component"] for r in rows if r["kind"] == "cycle"}
    imports = {tuple(map(int, r["item"].split(","))): r["component"] for r in rows if r["kind"] == "cycle_import"}
    assert len(rows) == len(files) + len(imports)
    return files, imports


def test_insights_see_cycles_through_every_import(spark, tables):
    rng = random.Random(8)
    # 1's first import leads nowhere, its second and third are on cycles
    edges = [(1, 2), (1, 3), (3, 1), (1, 4), (4, 5), (5, 1), (5, 6), (1, 3)] + [(20 + i, 20 + (i + 1) % 7) for i in range(7)] + [(22, 1)]
    edges += [e for e in ((rng.randrange(40, 52), rng.randrange(40, 52)) for _ in range(24)) if e[0] != e[1]]
    files, imports = cycle_rows(spark, tables(edges))
    assert (set(files), set(imports)) == round_trips(edges)
    assert {imports[e] for e in [(1, 3), (3, 1), (1, 4), (4, 5), (5, 1)]} == {1} and (1, 2) not in imports and (5, 6) not in imports
    assert [files[i] for i in range(20, 27)] == [20] * 7
    assert all(files[a] == files[b] == c for (a, b), c in imports.items())


def test_insights_refuse_no_graph_for_its_cycles(spark, tables):
    """Sixteen files that all import each other have some 10^12 simple cycles, more than can be listed."""
    edges = [(a, b) for a in range(1, 17) for b in range(1, 17) if a != b]
    files, imports = cycle_rows(spark, tables(edges))
    assert files == dict.fromkeys(range(1, 17), 1) and imports == dict.fromkeys(edges, 1)
