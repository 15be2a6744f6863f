"""Winnowing, SimHash and the classifier against brute force and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from graphloom.llm import quality, simhash, textnp, winnow
from graphloom.llm import queries as Q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute_hits(text, items):
    ws, hit, names = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        if not n:
            continue
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    names.add(str(item))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def planted():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "Gamma", "δelta", "9", "x"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(40)), (2, text(13)), (3, text(5)), (3, text(14)), (None, text(20)), (4, ""), (5, None), (6, "zulu"), (7, text(40))]
    docs = [(None, text(30)), (0, None), (1, ""), (2, "zulu zulu"), (2, "zulu zulu"), (3, "!!!")]
    for i in range(60):
        src = rng.choice([t for _, t in items if t]).split()
        a = rng.randrange(len(src))
        docs.append((10 + i, text(rng.randrange(30)) + "-" + ".".join(src[a : a + rng.randrange(1, 30)]) + "\n" + text(rng.randrange(200))))
    docs.append((99, text(30_000)))
    # repetitive texts: runs of one word and of two in turn, longer and shorter than the items'
    items += [(8, "aa " * 60), (9, "b c " * 20 + "b b d"), (10, "d " + "aa " * 15 + "d")]
    docs += [(100, "aa " * 400), (101, "b c " * 200 + "b b d " + "c b " * 30), (102, "d " + "aa " * 15 + "d " + "aa " * 14 + "x " + "aa " * 13), (103, "aa " * 12)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_winnowing_equals_brute_force(spark, block_bytes):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_hit", "'x' as `__spans`")
    got = winnow.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    rows = sorted(tuple(r) for r in got.select("text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").na.fill("~null", ["text"]).collect())
    want = sorted(("~null" if t is None else t, *brute_hits(t, items)) for _, t in docs)
    assert rows == want


def test_winnowing_of_repeated_words_tries_few_pairs():
    import time

    index = winnow.Index([(1, "a " * 2000)], 13)
    data = np.frombuffer(b"a " * 20_000, np.uint8)
    began = time.process_time()
    counts, found = index.scan(data, np.array([0, len(data)]))
    assert counts.tolist() == [20_000] and winnow._union(found[0][0]) == 20_000 and found[0][1] == {0}
    assert time.process_time() - began < 6  # 40 million pairs of places take a minute


def test_winnowing_on_tables(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op1_winnow_decontaminate(spark, SF).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs}
    assert any(x[4] for x in got.values())


def test_winnowing_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(none, items).count() == 0
    one = winnow.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (one["n_words"], one["n_hit"], one["contaminated"]) == (2, 0, False)


def brute_fp(text, k=4):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    sh = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    """rows: (id, fp); smallest id reachable per row."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted((str(i), f"{f:016x}", str(least.get(root(f)))) for i, f in rows)


def rolled_fp(text, k, seed=0):
    """SimHash of one text, shingle by shingle, from the hashes of its words."""
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    n, mask = min(k, len(ws)), (1 << 64) - 1

    def mixed(x):
        return int(textnp.mix(np.array([x & mask], np.uint64))[0])

    words_of = [mixed(sum((b + 1) * pow(textnp.BASE, i, 1 << 64) for i, b in enumerate(w)) + len(w)) for w in ws]
    hashes = []
    for i in range(len(ws) - n + 1 if ws else 0):
        g = 0
        for h in words_of[i : i + n]:
            g = g * textnp.GRAM + h
        hashes.append(mixed(mixed(g) + seed * textnp.BASE) if seed else mixed(g))
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_kept(rows):
    """Ids that stay of (id, text): the smallest of each group of either two-word fingerprint within 7 bits and five-word ones within 15."""
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append((i is None, i or 0, i))
    texts = sorted(ids)
    one, two, five, up = [rolled_fp(t, 2) for t in texts], [rolled_fp(t, 2, 1) for t in texts], [rolled_fp(t, 5) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if min((one[a] ^ one[b]).bit_count(), (two[a] ^ two[b]).bit_count()) <= 7 and (five[a] ^ five[b]).bit_count() <= 15:
                up[root(a)] = root(b)
    least = {}
    for n, t in enumerate(texts):
        least[root(n)] = min(min(ids[t]), least.get(root(n), (True, float("inf"))))
    return sorted(str(x[2]) for x in least.values())


def test_keep_one_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "Eta", "theta", "iota", "kappa"]) + str(rng.randrange(30))
    docs = [(None, None), (0, ""), (7, " "), (5000, "one two")]
    for k in range(25):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            ws = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                ws[rng.randrange(len(ws))] = word()
            docs.append((rng.randrange(10_000), " ".join(ws)))
        docs.append(docs[-1])
    got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == brute_kept(docs)


def test_simhash_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (7, ""), (1000, "  \n"), (1001, "one two"), (1001, "One  TWO"), (None, "a b c d e")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect())
    assert rows == brute_groups([(i, brute_fp(t)) for i, t in docs])


@pytest.mark.parametrize(("distance", "count", "hot"), [(4, 3, 4096), (4, 3, 7), (4, 2, 7), (4, 2, 4096), (7, 4, 4096), (7, 4, 3), (1, 2, 2)])
def test_simhash_links_on_random_fingerprints(spark, monkeypatch, distance, count, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1]
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.append(f)
            for _ in range(rng.randrange(1, distance + 2)):
                f ^= 1 << rng.randrange(64)
    # a crowd that shares two segments, with links in and beyond reach
    crowd = rng.getrandbits(64)
    fps += [crowd ^ rng.getrandbits(14) for _ in range(60)]
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.link_forest(spark.createDataFrame(signed, "fp long"), distance, count).collect()

    def closed(pairs):
        up = {f: f for f in fps}

        def root(f):
            while up[f] != f:
                f = up[f]
            return f

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return [root(f) for f in fps]

    got = [(a % (1 << 64), b % (1 << 64)) for a, b in edges]
    assert closed(got) == closed([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance])


def test_simhash_segments_cover_the_distance():
    for distance in range(12):
        for count in range(2, 7):
            cut = simhash.segments(distance, count)
            assert sum(b for _, b, _ in cut) == 64 and sum(r + 1 for _, _, r in cut) == distance + 1


def test_simhash_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    got = simhash.near_duplicates(spark.createDataFrame([(1, long), (2, long.upper()), (3, "w")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)]
    assert next(r["fingerprint"] for r in got if r["doc_id"] == 1) == f"{simhash.fingerprint(long.encode()) % (1 << 64):016x}"


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = [(3, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "q r s t u", "s"), (None, "q r s t u", "s"), (9, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, docs[1][1]), (None, docs[3][1]), (9, None)], "doc_id long, text string").collect()))


def jaccard(a, b):
    """Similarity of the sets of five-word shingles."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies_by_exact_similarity(spark):
    """Documents of the test tables and copies with some words changed, added or left out."""
    rng = random.Random(4)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(300).collect()]
    docs, pairs = [(i, t) for i, t in enumerate(texts)], []
    for i, t in enumerate(texts):
        for _ in range(3):
            ws = t.split()[:600]
            for _ in range(rng.randrange(1, max(2, len(ws) // 25))):
                k = rng.randrange(len(ws))
                ws[k : k + rng.choice([0, 1, 1, 1])] = rng.choice([[], [rng.choice(ws)], ["new" + str(rng.randrange(99))]])
            docs += [(len(docs), " ".join(t.split()[:600])), (len(docs) + 1, " ".join(ws))]
            pairs.append((docs[-2], docs[-1], jaccard(docs[-2][1], docs[-1][1])))
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    alike = [group[a[0]] == group[b[0]] for a, b, j in pairs if j >= 0.8]
    edge = [group[a[0]] == group[b[0]] for a, b, j in pairs if 0.8 <= j < 0.85]
    far = [group[a[0]] == group[b[0]] for (a, b, j) in pairs if j < 0.4]
    # different documents that are not alike stay apart
    lone = [(a, b) for a, b in zip(docs[:300:2], docs[1:300:2], strict=True) if jaccard(a[1], b[1]) < 0.3]
    print(len(alike), sum(alike) / len(alike), len(edge), sum(edge) / len(edge), len(far), len(lone))
    assert len(alike) > 300 and sum(alike) >= 0.95 * len(alike)
    assert len(edge) > 30 and sum(edge) >= 0.85 * len(edge)
    assert sum(group[a[0]] == group[b[0]] for a, b in lone) <= 0.01 * len(lone)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op5_quality_trees(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.9
    assert ((s >= 0.3) == (y == 1)).mean() > 0.9


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "word", "z"), (2, "word", "z"), (3, "x" * 3_000_000 + " y" * 1_000_000, "w")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality.score(docs, quality.train(docs, none)).collect()
    assert len(flat) == 5 and {r["score"] for r in flat} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def plain_features(text):
    """The statistics of one document, by loops over its bytes, words and lines."""
    raw = text.encode()
    kinds = [0] * 13
    of = {}
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            of[b] = 11
        elif b >= 0x80:
            of[b] = 12
        elif c in "()[]{}<>'\"-":
            of[b] = 9
        elif c == "|":
            of[b] = 8
        elif c in "!?":
            of[b] = 7
        elif c in ".,;:":
            of[b] = 6
        elif c == "\n":
            of[b] = 5
        elif c in " \t\r":
            of[b] = 4
        elif c.isdigit():
            of[b] = 3
        elif c.isupper():
            of[b] = 2
        elif c.islower():
            of[b] = 1
        else:
            of[b] = 10 if 0x21 <= b < 0x7F else 0
    for b in raw:
        kinds[of[b]] += 1
    chars = max(len(raw) - kinds[12], 1)
    ws = re.findall(rb"[^\x20\x09-\x0D\x00]+", raw)
    ls = [x for x in raw.split(b"\n") if x]
    n, m = max(len(ws), 1), max(len(ls), 1)
    most = lambda v: max((v.count(x) for x in set(v)), default=0)
    same = lambda v: sum(a == b for a, b in zip(v, v[1:], strict=False))
    mean = sum(map(len, ws)) / n
    spread = max(sum(len(w) ** 2 for w in ws) / n - mean * mean, 0) ** 0.5
    shout = sum(sum(of[b] == 2 for b in w) >= max(0.5 * len(w), 2) for w in ws)
    odd = sum(of[w[-1]] in (7, 10) for w in ws)
    share = [kinds[k] / chars for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)]
    return [np.log1p(len(raw)), np.log1p(len(ws)), *share, mean, spread, len(set(ws)) / n, most(ws) / n, same(ws) / n, shout / n, odd / n, sum(len(w) == 1 for w in ws) / n, sum(of[w[0]] == 2 for w in ws) / n, len(ws) / m, len(set(ls)) / m, most(ls) / m, same(ls) / m]


def test_statistics_equal_loops(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", "  \n\n ", "A", "a a a\na a a\n\nb?", "ÄÖ ü 日本語!", "x|y (z) [1] 'q' -", "THE END! THE END!"]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert np.allclose(got, np.array([plain_features(t) for t in texts]), rtol=1e-9, atol=1e-9)


def test_flat_trees_equal_a_walk_from_node_to_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    f = quality.fit(x, (x[:, 0] * x[:, 2] + x[:, 4] > 0).astype(float))
    assert len(f.feature) == quality.TREES
    for row, score in zip(x[:80], f.score(x[:80]), strict=True):
        raw = f.base
        for feature, cut, value in zip(f.feature, f.cut, f.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            raw += value[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-12


def test_one_bound_holds_for_all_that_is_learnt(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    quality.train(docs, labels, sample=30)
    quality.train(docs, labels)
    assert seen[0] == 30 and seen[1] == 8 * docs.select("doc_id").distinct().where(~quality.held_out(F.col("doc_id"))).count()


def test_trees_learn_a_simple_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    f = quality.fit(x[:1500], y[:1500])
    assert (((f.score(x[1500:]) > 0.5) == y[1500:]).mean()) > 0.95
