"""The jobs: reruns, growing input, and what the command line takes."""

import json
import random

from pyspark.sql import functions as F

from jobs import build_index, grade_conversations
from tarnfell.operators import assistant, index


def turns_of(rng, conversations, first, last):
    words = ["fine", "alarm", "sum 75,000", "and", "so"]
    return [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices(words, [6, 1, 1, 6, 6], k=4))) for c in conversations for t in range(first, last)]


def plain_grades(turns):
    """Every conversation walked through turn by turn."""
    out = []
    for conv in {t[0] for t in turns}:
        phase = "gather"
        for _, turn, role, said in sorted(t for t in turns if t[0] == conv):
            was, step = phase, {"gather": "gather", "followup": "followup", "end": "ignored"}[phase]
            if phase != "end" and role == "user" and "alarm" in said:
                phase, step = "end", "flagged"
            elif phase == "gather" and role == "assistant" and "75,000" in said:
                phase, step = "followup", "recommend"
            out.append((conv, turn, was, phase, step))
    return sorted(out)


def grades(spark, out):
    return sorted(tuple(r) for r in grade_conversations.read(spark, out).select("conv_id", "turn", "phase", "next_phase", "step").collect())


def test_turns_are_graded_once_as_they_come(spark, tmp_path):
    rng = random.Random(6)
    new, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    batches = [turns_of(rng, range(40), 0, 5), turns_of(rng, range(20, 60), 5, 9), turns_of(rng, range(60), 9, 12)]
    schema, args = grade_conversations.TURNS, (new, out, progress, "alarm", "[0-9,]{4,}")
    held = []
    for n, turns in enumerate(batches):
        spark.createDataFrame(turns, schema).coalesce(1).write.mode("append").parquet(new)
        held += turns
        assert grade_conversations.run(spark, *args) == len(turns)
        assert grades(spark, out) == plain_grades(held)
        assert grade_conversations.run(spark, *args) == 0  # nothing is new
        assert grades(spark, out) == plain_grades(held)
        assert {r["batch"] for r in grade_conversations.read(spark, out).select("batch").distinct().collect()} == set(range(n + 1))


def test_a_batch_that_was_broken_off_is_replaced(spark, tmp_path):
    turns = turns_of(random.Random(7), range(30), 0, 8)
    new, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(turns, grade_conversations.TURNS).write.parquet(new)
    for progress in ("one", "two"):  # the second has lost its checkpoint and starts at batch 0 again
        grade_conversations.run(spark, new, out, f"{tmp_path}/{progress}", "alarm", "[0-9,]{4,}")
        assert grades(spark, out) == plain_grades(turns)


def test_phases_by_milestones_are_those_of_the_windows(spark):
    turns = turns_of(random.Random(8), range(25), 0, 12) + [(99, 0, "user", None), (None, 0, "user", "alarm"), (None, 1, "assistant", "fine")]
    df = spark.createDataFrame(turns, grade_conversations.TURNS).repartition(4)
    bad, done = F.col("text").contains("alarm"), F.col("text").contains("75,000")
    firsts = assistant.milestones(df, "conv_id", ("turn", "role"), bad, done)
    got = assistant.phases_by(df.filter("conv_id IS NOT NULL"), "conv_id", ("turn", "role"), bad, done, firsts)
    want = assistant.phases(df.filter("conv_id IS NOT NULL"), "conv_id", ("turn", "role"), F.coalesce(bad, F.lit(False)), F.coalesce(done, F.lit(False)))
    pick = lambda d: sorted(map(tuple, d.select("conv_id", "turn", "phase", "next_phase", "step").collect()))
    assert pick(got) == pick(want)


def test_no_turns(spark, tmp_path):
    spark.createDataFrame([], grade_conversations.TURNS).write.parquet(f"{tmp_path}/in")
    assert grade_conversations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress", "a", "b") == 0
    assert grade_conversations.read(spark, f"{tmp_path}/out").count() == 0


def test_a_rebuilt_index_is_the_same(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(30))), i % 5) for i in range(300)] + [(None, "a b", 0), (300, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, shelf int").write.parquet(f"{tmp_path}/docs")
    seen = []
    for _ in range(2):
        rows = build_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", keep=["shelf"], buckets=16)
        seen.append(sorted(map(tuple, build_index.read(spark, f"{tmp_path}/out").collect())))
    assert seen[0] == seen[1] and rows["docs"] == 301 and rows["postings"] == len(seen[0]) == sum(len(set(t.split())) for i, t, _ in docs[:300])
    spark.createDataFrame([(1, None, 0)], "doc_id long, text string, shelf int").write.parquet(f"{tmp_path}/none")
    assert build_index.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2") == {"docs": 1, "postings": 0}


def test_configs_fit_the_jobs():
    import inspect
    import os

    here = os.path.dirname(build_index.__file__)
    for job in (build_index, grade_conversations):
        with open(f"{here}/{job.__name__.split('.')[-1]}.json") as f:
            config = json.load(f)
        inspect.signature(job.run).bind(None, **config)


# ------------------------------------------------------------------------------------------------- the index


def plain_bm25(docs, asked, k, keep=lambda d: True):
    import math

    split = {i: (t or "").lower().split() for i, t, _ in docs}
    n, mean = len(docs), sum(map(len, split.values())) / len(docs)
    df = {}
    for w in split.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for d in docs:
        w, s = split[d[0]], 0.0
        for t in set((asked or "").lower().split()):
            f = w.count(t)
            if f:
                s += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if s and keep(d):
            out.append((-round(s, 10), d[0]))
    return [(r, i, round(-s, 8)) for r, (s, i) in enumerate(sorted(out)[:k], 1)]


def test_searches_equal_a_plain_ranking_and_skip_what_cannot_matter(spark, tmp_path):
    rng = random.Random(10)
    common, rare = ["the", "of", "and", "in"], [f"r{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randrange(1, 40)) + rng.choices(rare, k=rng.randrange(3))), i % 3) for i in range(900)]
    docs += [(900 + i, "R7 r7 r7 The", 0) for i in range(12)] + [(950, None, 1), (951, "", 1)]
    asked = [(1, "r7 the of"), (2, "the and"), (3, "nowhere"), (4, None), (5, "r1 r2 R3 the the in"), (6, "")]
    df = spark.createDataFrame(docs, "id long, body string, shelf int").repartition(3)
    index.build(df, "id", "body", f"{tmp_path}/ix", keep=["shelf"], block_docs=16, buckets=16)
    queries = spark.createDataFrame(asked, "q long, said string")
    for keep, plain in ((None, lambda d: True), (F.col("shelf") == 1, lambda d: d[2] == 1)):
        got = {}
        for r in index.search(queries, "q", "said", f"{tmp_path}/ix", 5, keep).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 8)))
        assert got == {q: hits for q, said in asked if (hits := plain_bm25(docs, said, 5, plain))}
    s = index.Search(queries.filter("q = 1"), "q", "said", f"{tmp_path}/ix", 5)
    rest = s.second_pass(s.first_pass())
    assert rest.filter("needed AND term = 'the'").count() == 0  # without the rare word no document is looked at
    assert rest.filter("needed").count() < s.bounds.count() / 3
    assert len(s.buckets) <= 3
    plan = s.stored()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert index.search(queries.limit(0), "q", "said", f"{tmp_path}/ix").count() == 0


def moved(spark):
    """Rows that the stages so far have written for other tasks."""
    jvm, sc = spark._jvm, spark.sparkContext
    none, quantiles = jvm.java.util.ArrayList(), sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_moves_texts_and_not_their_postings(spark, tmp_path):
    from collections import Counter

    rng = random.Random(11)
    spaces = [" ", "  ", "\t", "\n", "\x1c", "\x85", " ", " ", "　"]
    docs = [(f"d{i}", "".join(rng.choice(spaces) + rng.choice(["Ab", "ÄB", "İ", "x​y"]) + str(j) for j in range(rng.randrange(60)))) for i in range(200)]
    docs += [("none", None), ("blank", "  \n"), ("closed", "a b a "), (None, "a b")]
    df = spark.createDataFrame(docs, "id string, t string").repartition(3).cache()
    df.count()
    before = moved(spark)
    index.build(df, "id", "t", f"{tmp_path}/ix", block_docs=16, buckets=4)
    assert moved(spark) - before < 2 * len(docs)
    split = {i: (t or "").lower().split() for i, t in docs if i}
    mean = sum(map(len, split.values())) / len(split)
    want = sorted((w, i, n, round(n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(s) / mean)), 12)) for i, s in split.items() for w, n in Counter(s).items())
    assert sorted((r.term, r.id, r.tf, round(r.weight, 12)) for r in index.postings(spark, f"{tmp_path}/ix").collect()) == want
    assert {r.id: r.dl for r in spark.read.parquet(f"{tmp_path}/ix/docs").collect()} == {i: len(s) for i, s in split.items()}
    for r in index.stored(spark, f"{tmp_path}/ix").collect():
        assert r.n == len(r.entries) and r.top == max(e.weight for e in r.entries)


def test_a_search_moves_lists_and_not_their_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PACK", 7, raising=False)
    rng = random.Random(12)
    docs = [(f"d{i:03}", " ".join(["the", "of", "and", "in"] * rng.randrange(1, 4) + rng.choices([f"r{j}" for j in range(30)], k=2)), i % 4) for i in range(600)]
    docs += [(f"copy{i}", "the r3 r3 of", 1) for i in range(15)] + [("none", None, 1)]  # more equals than hits
    asked = [(f"q{i}", f"The of and in r{i}") for i in range(20)] + [("other", "elsewhere")]
    spark.createDataFrame(docs, "id string, body string, shelf int").write.parquet(f"{tmp_path}/docs")
    index.build(spark.read.parquet(f"{tmp_path}/docs"), "id", "body", f"{tmp_path}/ix", keep=["shelf"], block_docs=64, buckets=4)
    queries = spark.createDataFrame(asked, "q string, said string")
    for keep, plain in ((F.col("shelf") == 1, lambda d: d[2] == 1), (F.col("shelf") == 9, lambda d: False), (None, lambda d: True)):
        before, got = moved(spark), {}
        for r in index.search(queries, "q", "said", f"{tmp_path}/ix", 5, keep).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 8)))
        assert got == {q: hits for q, said in asked if (hits := plain_bm25(docs, said, 5, plain))}
    assert moved(spark) - before < 6000
