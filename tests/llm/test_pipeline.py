"""The pipeline stage by stage against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline
from graphloom.llm import quality
from pyspark.sql import functions as F

from .test_text_operators import brute_hits, brute_kept

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_equal_brute_force(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        columns = columns or docs.columns
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        had = rows(before)
        if name != "shard":
            assert docs.columns == columns
        if name == "quality":
            scored = quality.score(before, quality.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert sorted(rows(docs)) == sorted(rows(scored.where("score >= 0.3")))
        elif name == "near_dedup":
            assert sorted(str(i) for i, _, _ in rows(docs)) == brute_kept([(i, t) for i, t, _ in had])
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(rows(docs)) == sorted(r for r in had if not brute_hits(r[1], items)[4])
        elif name == "mix":
            size = lambda t: len((t or "").split())
            got = Counter(i for i, _, _ in rows(docs))
            assert all(got[i] <= 3 for i in got) and set(got) <= {i for i, _, _ in had}
            taken = Counter()
            for _, t, s in rows(docs):
                taken[s] += size(t)
            sources = sorted({s for _, _, s in had})
            weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
            total = Counter()
            for _, t, s in had:
                total[s] += size(t)
            left, free, want = float(sum(total.values())), set(sources), {}
            while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]}:
                want |= {s: 3.0 * total[s] for s in over}
                left -= sum(want[s] for s in over)
                free -= over
            want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            longest = max(size(t) for _, t, _ in had)
            assert all(abs(taken[s] - want[s]) <= longest for s in sources)
        else:
            got = docs.collect()
            counts = Counter(r["shard"] for r in got)
            assert len(got) == len(had) and max(counts.values()) - min(counts.values()) <= 1
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in had)


def test_run_keeps_only_its_result(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_stages_survive_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
    odd = [(None, None, None, None, None, "x", "y"), (1, "", "en", "a", 0, None, None), (1, "", "en", "a", 0, None, None), (2, "one two three", "en", "a", 13, "", ""), (2, "one two three", "en", "a", 13, "", ""), (2, "other words here", None, "b", 1, "", ""), (3, "w " * 50_000, "en", None, 5, "", "")]
    for name, stage in corpus_pipeline.STAGES:
        for n, data in (("odd", odd), ("none", [])):
            got = stage(spark, spark.createDataFrame(data, schema), SF)
            got.write.parquet(str(tmp_path / f"{name}-{n}"))
            assert got.where(F.lit(True)).count() >= 0
            if n == "none":
                assert got.count() == 0


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    clash = ["score", "predicted", "n_words", "contaminated", "__spans", "__key", "__n", "__row", "__own", "component_id", "fp", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.columns == docs.columns and got.count() > 0
        wrong = " or ".join(f"`{c}` is null or `{c}` <> concat('{c}:', doc_id)" for c in clash)
        assert got.where(wrong).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
