"""Mixing, sharding, vectors, chat, licenses and WARC against brute force and round trips."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
from graphloom.llm import chat, licenses, mixing, sharding, vectors, warc
from graphloom.llm.common import components, new_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 900])), "hot" if i % 3 else f"s{i % 7}") for i in range(n)]
    return rows + [(None, None, None), (1, "a b", "hot"), (1, "a b", "hot"), (2, "", None), (3, "x " * 9000, "s1")]


def test_mix_meets_targets_and_caps(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_taken(docs, block=512).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[(r["source_size"], r["target"])] += r["taken"]
    assert sum(by.values()) > 0
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = float(sum(sizes.values())), set(order), {}
    while True:
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        left -= sum(want[s] for s in over)
        open_ -= over
    want |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    assert sorted(round(x, 6) for x in want.values() if x) == sorted(round(t, 6) for _, t in by if t)
    # six sources' discrepancy, in blocks
    assert all(abs(taken - target) <= 4 * 512 for (_, target), taken in by.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_taken(docs.repartition(7), block=512).collect()))


def test_mix_taken_sums_the_mix(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    for block in (7, 512):
        pieces = mixing.mix(docs, block=block).groupBy("__key").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("words").alias("taken")).select("doc_id", "size", "taken")
        assert sorted(map(str, pieces.collect())) == sorted(map(str, mixing.mix_taken(docs, block=block).select("doc_id", "size", "taken").collect()))


def test_mix_takes_what_its_schedule_draws(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    draws = {"hot": 3, "s1": 2, "s2": 500, None: 1}

    def other(sources, slots):
        plan = [(k, s or "", s is None, k) for s, n in draws.items() for k in range(n)]
        return spark.createDataFrame(plan, "slot long, __src string, __none boolean, rank long")

    monkeypatch.setattr(mixing, "schedule", other)
    taken = Counter()
    for r in mixing.mix_taken(docs, block=100).collect():
        taken[r["source_size"]] += r["taken"]
    want = Counter()
    for s, size in sizes.items():
        want[size] += min(3 * size, 100 * draws.get(s, 0))
    assert taken == want
    monkeypatch.setattr(mixing, "schedule", lambda sources, slots: other(sources, slots).limit(0))
    assert sum(r["taken"] for r in mixing.mix_taken(docs, block=100).collect()) == 0


def test_mix_orders_many_sources(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 500:03d}") for i in range(2000)]
    got = {(r["source_size"], r["target"]) for r in mixing.mix_taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    left, free, want = float(sum(size.values())), set(size), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}:
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(want[s] for s in over)
        free -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert {(a, round(b, 6)) for a, b in got} == {(size[s], round(want[s], 6)) for s in size}


def test_mix_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", False, 500.0), ("b", False, 300.0), ("c", False, 7.0), ("d", True, 0.0)], "__src string, __none boolean, target double").withColumn("__p", F.lit(0))
    plan = mixing.schedule(sources, 5000).collect()
    assert sorted(r["slot"] for r in plan) == list(range(5000))
    for s, t in (("a", 500.0), ("b", 300.0), ("c", 7.0)):
        own = sorted((r["slot"], r["rank"]) for r in plan if r["__src"] == s)
        assert [k for _, k in own] == list(range(len(own)))
        assert all(abs(k - slot * t / 807.0) < 8 for slot, k in own)


def test_mix_of_nothing(spark):
    assert mixing.mix_taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = mixing.mix_taken(spark.createDataFrame([(1, " ", "a")], "doc_id long, text string, source string")).first()
    assert (one["size"], one["target"], one["taken"]) == (0, 0.0, 0)


def test_shards(spark):
    import zlib

    rows = documents()
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash"))).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    few = sharding.shard(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]


def test_matrix_margins_and_law():
    rows, cols = [100, 0, 37, 13], [50, 49, 51]
    m = sharding.communication_matrix(rows, cols, 3)
    assert [sum(x) for x in m] == rows and [sum(x) for x in zip(*m, strict=True)] == cols
    rng = random.Random(9)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6.0) < 0.06 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    big = sharding.hypergeometric(rng, 10**10, 9 * 10**10, 10**9)
    assert abs(big - 10**8) < 10**5


def cos(a, b):
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=40)
            rows += [(len(rows) + k, (base + rng.normal(size=40) * s).tolist(), label) for k, s in enumerate([0, 0, 0.1, 0.14, 0.15, 0.16, 0.3])]
    rows += [(900, [0.0] * 40, 0), (901, None, 0), (902, [1.0, float("nan")] * 20, 0), (903, [float("inf")] + [1.0] * 39, 0), (904, rows[0][1], None), (905, [1.0, None] * 20, 0), (906, [], 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (0, rows[0][1], 0), (909, [-0.0, 1.0], 1), (910, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("class", F.lit(1))
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(np.array(rows[i][1]), np.array(rows[j][1])) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    want = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min(rows[k][0] for k in seen)
        want.append((rows[i][0], len(links[i]), least, least == rows[i][0]))
    for block, tile in ((16_384, 1024), (40, 16), (7, 3)):
        got = [tuple(r) for r in vectors.near_vectors(df, block=block, tile=tile).collect()]
        assert sorted(got) == sorted(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_length(spark):
    v = [1.0, 2.0, 3.0]
    near = [1.0, 2.0, 3.001]
    rows = [(0, [x * 1e160 for x in v]), (3, [x * 1e160 for x in near]), (4, [x * 1e160 for x in near]), (9, v), (11, [x * 1e-300 for x in v]), (12, [5e-324, 0.0, 0.0]), (13, [1e308, 0.0, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (4, 0), 3: (4, 0), 4: (4, 0), 9: (4, 0), 11: (4, 0), 12: (1, 12), 13: (1, 12)}


def test_crowded_cells_are_dealt_by_their_count(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 6)) + rng.normal(size=(9000, 6)) * 1e-3, rng.normal(size=(2000, 6))])
    df = spark.createDataFrame([(i, "a", 6, 1, v.tolist()) for i, v in enumerate(x)], "class long, label string, dim int, n long, v array<double>")
    turned, cells = vectors.deal(df, spark.sparkContext.broadcast({6: vectors.axes(vectors.unit(x))}), 200)
    rows = {r["block"]: r["n"] for r in turned.join(cells, ["label", "dim", "base", "piece"]).groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(rows.values()) == 11_000 and max(rows.values()) <= 300 and len(rows) >= 40
    span = {r["block"]: (r["lo"], r["hi"]) for r in cells.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    met = {(r["a"], r["b"]) for r in vectors.meetings(cells, 0.98).collect()}
    gap = (2 - 2 * 0.98) ** 0.5
    assert met >= {(a, b) for a in span for b in span if a <= b and span[b][0] - span[a][1] <= gap and span[a][0] - span[b][1] <= gap}


def test_vectors_of_floats_and_long_ones(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 5000)).astype(np.float32)
    rows = [(i, base[i % 30].tolist(), "x") for i in range(60)] + [(100 + i, (base[i] + rng.normal(size=5000).astype(np.float32) * 0.05).tolist(), "x") for i in range(30)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {i: (2, (i % 30 if i < 60 else i - 100)) for i, _, _ in rows}


def test_link_blocks_hold_a_tile_of_pairs_only():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(700, 16)) * 0.01
    links, root = vectors.link_blocks(x, 700, None, np.ones(700), 0.98, 100)
    assert (links == 699).all() and (root == 0).all()
    links, root = vectors.link_blocks(x, 300, None, np.ones(700), 0.98, 64)
    assert (links[:300] == 400).all() and (links[300:] == 300).all() and (root == 0).all()


def test_chat_parts_and_round_trip(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see <|image:0|> & "), part("image", ref="a.png", units=2), part("audio", ref="b.wav", units=10), part("text", "[x]|")]),
        (1, 1, "assistant", [part("text", "<|end|> &lt; fine")]),
        (1, 2, None, None),
        (1, 3, "user", [part("image", ref="c.png", units=1), part("text", ""), part(None, "no kind")]),
        (2, None, "assistant", [part("text", None), part("document", ref="c.pdf"), part("odd|>", ref="z"), part("text", "after")]),
        (None, 0, "assistant", []),
        (3, 5, "a|>b", [part("text", "é😀")]),
        (3, 5, "a|>b", [part("text", "é😀")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit(0)).withColumn("n", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    back = lambda conv: [(t["role"], [tuple(p) for p in t["parts"]]) for t in got[conv]["turns"]]
    assert back(1) == [(rows[0][2], rows[0][3]), (rows[1][2], rows[1][3]), ("", []), ("user", [rows[3][3][0], part("text", "no kind")])]
    assert back(2) == [("assistant", [*rows[4][3][1:3], part("text", "after")])]
    assert back(None) == [("assistant", [])] and got[None]["loss_text"] == "" and got[None]["loss_spans"] == []
    assert back(3) == [("a|>b", [part("text", "é😀")])] * 2
    # a placeholder in a text is escaped, the real ones have a number each over all turns
    assert [got[1]["formatted"].count(x) for x in ("<|image:0|>", "<|audio:1|>", "<|image:2|>")] == [1, 1, 1]
    assert [(a["n"], a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 0, 1, "image", "a.png", 512), (1, 0, 2, "audio", "b.wav", 250), (2, 3, 0, "image", "c.png", 256)]
    assert got[1]["expanded_tokens"] == 512 + 250 + 256 + sum(len(re.findall(r"[^\W_]+|[^\w\s]|_", p[1] or "")) for r in rows[:4] for p in r[3] or [])
    assert got[1]["loss_text"] == "<|end|> &lt; fine" and got[2]["loss_text"] == "after"
    for r in got.values():
        cut = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
        assert cut == r["loss_text"].replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;").replace("|", "&#124;")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_of_many_turns_is_linear(spark):
    import time

    turns = spark.range(60_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t ', id) text")
    parts = F.array(chat.part(F.lit("text"), F.col("text")), chat.part(F.lit("image"), None, F.col("text"), F.lit(1)))
    began = time.time()
    r = chat.read_back(chat.format_chat(turns.withColumn("parts", parts))).selectExpr("size(turns) n", "loss_text", "turns[59999].parts[1].ref ref", "size(attachments) a").first()
    assert (r["n"], r["a"], r["ref"]) == (60_000, 60_000, "t 59999") and r["loss_text"] == "".join(f"t {i}" for i in range(1, 60_000, 2))
    assert time.time() - began < 60


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p]
    return len(ws), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (5000, ""), (5001, "CC-BY cc by, cc_by! ccby GNU General\nPublic... License. All rights reserved all rights RESERVED"), (5001, "x"), (5002, "cc by " * 30_000)]
    got = sorted((str(r["doc_id"]), *map(str, (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit(1))).collect())
    assert got == sorted((str(i), *map(str, base(t))) for i, t in docs)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labels(text):
    return licenses.Scanner().scan(text.encode())[5]


def test_license_rules():
    assert len(licenses.rules()) > 200
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under the Apache License, Version 2.0 (the License)") == ["apache-2.0"]
    assert labels("the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version") == ["gpl", "gpl-2.0-or-later"]
    assert labels("under CC BY-SA 4.0 see https://creativecommons.org/licenses/by-sa/4.0/") == ["cc-by", "cc-by-sa-4.0"] or "cc-by-sa-4.0" in labels("licensed under CC BY-SA 4.0")
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels("nothing to see here") == []


def spelled(items):
    """Every text of a parsed pattern: an open repeat counts with its least length, a class with its first member."""
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name in ("ANY", "NOT_LITERAL"):
            ways = ["x"]
        elif name == "IN":
            ways = ["1"] if str(arg[0][0]) == "CATEGORY" else [chr(x) for _, x in arg]
        elif name == "BRANCH":
            ways = [w for part in arg[1] for w in spelled(part)]
        elif name == "SUBPATTERN":
            ways = spelled(arg[-1])
        elif name in ("ASSERT", "ASSERT_NOT"):
            ways = [""]
        else:
            least, most, part = arg
            ways = [w * n for w in spelled(part) for n in range(least, most + 1 if most == 1 else least + 1)]
        out = [a + w for a in out for w in ways]
    return out


def test_license_prefilter_tries_every_rule_that_matches():
    scanner, every = licenses.Scanner(), licenses.Scanner()
    every.keywords = frozenset([*scanner.keywords, b"all"])
    every.by_keyword = {b"all": licenses.rules()}
    texts = set()
    for r in licenses.rules():
        body = r.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
        mine = spelled(re._parser.parse(body))
        assert all(r.pattern.search(f" {x} ".encode()) for x in mine)
        texts |= set(mine)
    assert len(texts) > 2000
    for x in sorted(texts):
        assert scanner.scan(f"all {x}".encode()) == every.scan(f"all {x}".encode()), x
    assert labels("released under the GPLv3") == ["gpl-3.0-only"]
    assert labels("Licensed under Apache2") == ["apache-2.0"]
    assert labels("available under the Zero Clause BSD") == ["0bsd"]
    assert labels("Beer-Ware License") == ["beerware"]


def test_license_endorsement_takes_any_list_of_names():
    rest = "nor the names of its contributors may be used to endorse or promote products derived from this software"
    for names in ("X", "the Regents of the University of Somewhere and the Laboratory for Applied Things", "one, " * 200):
        assert labels(f"Neither the name of {names} {rest}") == ["bsd-3-clause"]
    assert labels("Neither the name of X is known. This software is provided as is. It may be used to endorse or promote products") == []
    assert labels("Neither the name of X nor " * 3000 + rest) == ["bsd-3-clause"]


def plain_scan(text):
    """Labels and score by every rule on the whole text, and every pair of hits."""
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    norm = (" " + " ".join(ws) + " ").encode()
    hits = [(m.start(), m.end(), r.priority, r.label) for r in licenses.rules() for m in r.pattern.finditer(norm)]
    inside = lambda h, o: o[0] <= h[0] and h[1] <= o[1]
    kept = []
    for h in hits:
        wider = [o for o in hits if inside(h, o) and (o[0], o[1]) != (h[0], h[1]) and o[2] >= h[2]]
        equal = [o for o in hits if (o[0], o[1]) == (h[0], h[1]) and (o[2] > h[2] or (o[2] == h[2] and o[3] < h[3]))]
        if not wider and not equal:
            kept.append(h)
    best = {label: 60 for phrase, label in licenses.BASE if f" {phrase} " in norm.decode()}
    for _, _, priority, label in kept:
        best[label] = max(priority, best.get(label, 0))
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1 - best[label] / 100
    return sorted(best), 1 - doubt


def test_license_labels_and_score_equal_brute_force(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(4)
    notices = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "released under the GPLv3 or later", "all rights reserved", "CC BY-SA 4.0", "the GNU Lesser General Public License version 2.1", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Redistribution and use in source and binary forms"]
    texts += [" filler words ".join(rng.sample(notices, rng.randrange(1, 6))) for _ in range(60)]
    scanner = licenses.Scanner()
    for t in texts:
        got = scanner.scan(t.encode())
        want = plain_scan(t)
        assert (got[5], round(got[6], 9)) == (want[0], round(want[1], 9)), t[:200]
    assert sum(bool(scanner.scan(t.encode())[5]) for t in texts) > 50


def test_license_suppression():
    hits = [(0, 10, 50, "outer"), (2, 5, 50, "inner"), (3, 8, 80, "strong"), (0, 10, 50, "outer"), (8, 14, 10, "over")]
    assert licenses.suppress(hits) == [(0, 10, 50, "outer"), (3, 8, 80, "strong"), (8, 14, 10, "over")]


def test_warc_round_trip(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(1000, "http://a/\r\nX: y", "same"), (1001, None, "same"), (1001, None, "same"), (None, "u", "same"), (1002, "u", None), (1003, "u", ""), (None, None, "alone"), (1004, "u", "WARC/1.1\r\n\r\n"), (1005, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("most", F.lit(0))
    for least in (0, 3):
        got = sorted(map(str, (tuple(r) for r in warc.round_trip(df, min_bytes=least).collect())))
        top = {}
        for i, _, h in pages:
            if i is not None:
                top[h or ""] = max(i, top.get(h or "", i))
        want = []
        for i, _, h in pages:
            raw = (h or "").encode()
            whole = i == top.get(h or "") or len(raw) < least
            want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if whole else "revisit", None if whole else top[h or ""]))
        assert got == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_random_access(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 4000)) for i in range(3000)]
    path = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.fetch(spark, path, [7, 1234, 2999]).collect()}
    assert got == {f"{warc.ID}{i}": pages[i][2] for i in (7, 1234, 2999)}
    bundle = spark.read.parquet(f"{path}/bundles").first()
    frames = warc.read_seek_table(bytes(bundle["content"]))
    assert len(frames) > 1 and max(r["frame"] for r in bundle["records"]) == len(frames) - 1
