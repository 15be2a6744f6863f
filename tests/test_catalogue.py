"""Every registered query against its SQL in DuckDB; those without SQL against brute force."""

import math
import os
from collections import Counter

import duckdb
import graphloom.queries  # noqa: F401  registers every module's queries
import pytest
from graphloom.operators import graph
from graphloom.plans import adapters, catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=str)


def test_every_query_without_sql_has_a_test_here():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"layer_tiers", "question_order", "communities", "text_chunks"}


def links(spark):
    return sorted({(r["source"], r["target"]) for r in adapters.edges(spark, SF).collect()})


def test_layer_tiers_equal_sweeps(spark):
    layer = {r["path"]: r["layer"] for r in catalogue.QUERIES["layer_assignment"](spark, SF).collect()}
    pairs = sorted({(layer[a], layer[b]) for a, b in links(spark) if layer[a] != layer[b]})
    tier = dict.fromkeys(layer.values(), 0)
    for _ in range(len(tier) + 1):
        for a, b in pairs:
            tier[b] = max(tier[b], tier[a] + 1)
    assert {r["layer"]: r["tier"] for r in catalogue.QUERIES["layer_tiers"](spark, SF).collect()} == tier


def shortest(edges, start, goal):
    near, came, queue = {}, {start: None}, [start]
    for a, b in sorted(edges):
        near.setdefault(a, []).append(b)
    while queue:
        n = queue.pop(0)
        if n == goal:
            path = [n]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for m in near.get(n, []):
            if m not in came:
                came[m] = n
                queue.append(m)
    return None


def test_shortest_path_has_no_length_limit(spark):
    dag = [(a, b) for a, b in links(spark) if a < b]
    got = [r["node"] for r in sorted(catalogue.QUERIES["shortest_flow_path"](spark, SF).collect(), key=lambda r: r["place"])]
    start, nodes = min(a for a, _ in dag), {x for e in dag for x in e}
    paths = [p for p in (shortest(dag, start, n) for n in sorted(nodes)) if p]
    assert got == max(paths, key=len) and len(got) > 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 40), (40, 5)], "source long, target long")
    assert graph.shortest_path(chain, [99, 0], [12]) == list(range(13))
    assert graph.shortest_path(chain, [12], [0]) is None and graph.shortest_path(chain, [7], [7]) == [7]


def test_question_order_is_by_kahn_rank_then_place(spark):
    rank = {r["node"]: r["rank"] for r in catalogue.QUERIES["kahn_order"](spark, SF).collect()}
    first = {}
    for r in adapters.table(spark, SF, "events").select("user_id", "event_id").collect():
        first[r["user_id"] + 1] = min(r["event_id"], first.get(r["user_id"] + 1, r["event_id"]))
    want = sorted(((i, rank.get(i), p) for i, p in first.items()), key=lambda x: (x[1] is None, x[1] or 0, x[2]))
    assert [tuple(r) for r in catalogue.QUERIES["question_order"](spark, SF).collect()] == want


def test_communities_equal_sweeps_over_dictionaries(spark):
    group = {str(r["id"]): r["language"] for r in adapters.files(spark, SF).collect()}
    near = {n: set() for n in group}
    for a, b in links(spark):
        a, b = str(a), str(b)
        if a != b and group[a] == group[b]:
            near[a].add(b)
            near[b].add(a)
    label = {n: n for n in group}
    for _ in range(20):
        before = dict(label)
        for n in sorted(n for n in near if near[n]):
            votes = [label[m] for m in near[n]]
            label[n] = min(set(votes), key=lambda x: (-votes.count(x), x))
        if before == label:
            break
    got = {r["node"]: (r["layer"], r["community"]) for r in catalogue.QUERIES["communities"](spark, SF).collect()}
    assert got == {n: (group[n], label[n]) for n in group}


def test_chunks_cover_their_texts_within_bounds(spark):
    texts = {str(r["doc_id"]): r["text"] for r in adapters.table(spark, SF, "documents").select("doc_id", "text").collect()}
    chunks = {}
    for r in catalogue.QUERIES["text_chunks"](spark, SF).collect():
        chunks.setdefault(r["file_path"], []).append(r)
    assert set(chunks) == {i for i, t in texts.items() if t.strip()}
    for path, rows in chunks.items():
        text, at = texts[path], -1
        for r in sorted(rows, key=lambda r: r["n"]):
            assert 0 < len(r["text"]) <= 1500
            at = text.index(r["text"], at + 1)
            assert (r["start_line"], r["end_line"]) == (text.count("\n", 0, at) + 1, text.count("\n", 0, at) + 1 + r["text"].count("\n"))
        # nothing is lost between chunks; overlaps may say a word twice
        said = Counter(w for r in rows for w in r["text"].split())
        assert all(said[w] >= n for w, n in Counter(text.split()).items())
