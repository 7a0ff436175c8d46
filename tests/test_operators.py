"""Operators, sources, sinks and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import catalog, graph, hooks, match, metrics, policy, retrieval
from tarnfell.sources import readers, sinks
from tarnfell.streaming import streams


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_the_budget_applies_after_the_nearest_are_chosen(spark):
    df = spark.createDataFrame([(i, [1.0, i / 100], i) for i in range(100)], "id int, v array<double>, price int")
    assert rows(retrieval.dense(df, "id", "v", [1.0, 0.0], 2, F.col("price") >= 50, over=5)) == []
    assert [r[0] for r in rows(retrieval.dense(df, "id", "v", [1.0, 0.0], 2))] == [0, 1]


def test_bm25_statistics_come_from_all_documents(spark):
    df = spark.createDataFrame([(1, "a a b", 1), (2, "a c", 9), (3, None, 1)], "id int, t string, p int")
    every = dict(rows(retrieval.bm25(df, "id", "t", "a a", None)))
    kept = dict(rows(retrieval.bm25(df, "id", "t", "a", None, F.col("p") < 5)))
    assert set(every) == {1, 2} and kept == {1: pytest.approx(every[1])}


def test_fusion_ties_go_to_the_first_list(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id int, score double")
    b = spark.createDataFrame([(3, 5.0), (4, 4.0)], "id int, score double")
    assert [r[0] for r in rows(retrieval.hybrid(a, b, "id", 4), "rank")] == [1, 3, 2, 4]


def test_validation_falls_back_to_the_best(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id int, s int")
    assert rows(retrieval.validated(df, "s", [F.desc("s")])) == [(1, 1)]
    assert retrieval.validated(df.filter("id > 5"), "s", [F.desc("s")]).count() == 0


def test_numbers_from_nought(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert rows(catalog.renumber(df, ["k"]), "id") == [(i, i) for i in range(1000)]


def test_last_duplicate_wins(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k1 string, k2 string")
    right = spark.createDataFrame(
        [(1, "a", "q", 1.0), (2, "a", "q", 2.0), (3, "n", "y", 3.0)],
        "pos int, k1 string, k2 string, price double",
    )
    found = catalog.fallback_lookup(left, right, ["k1", "k2"], F.col("pos"), ["price"], {"price": F.lit(-1.0)})
    assert {r["k1"]: r["found_price"] for r in found.collect()} == {"a": 2.0, "b": 3.0, "c": -1.0}


def test_ranges_of_an_empty_catalogue(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "p double")
    assert rows(catalog.budget_ranges(df, "p"), "tier") == [("high", 0.0, 0.0), ("low", 0.0, 0.0), ("medium", 0.0, 0.0)]


def test_both_matchers_agree(spark):
    dims = ["a", "b"]
    items = spark.createDataFrame(
        [(i, float(i), "low medium high".split()[i % 3], "low high".split()[i % 2]) for i in range(20)],
        "id long, price double, a string, b string",
    )
    ranges = spark.createDataFrame(
        [("low", 0.0, 5.0), ("medium", 5.0, 9.0), ("high", 100.0, 200.0)],
        "tier string, low double, high double",
    )
    grid = match.combo_grid(spark, dims)
    one, two = (
        rows(f(grid, items, ranges, dims, "id", "price").select("combo_key", "id", "match_score", "within_budget"), "combo_key")
        for f in (match.best_match, match.best_match_direct)
    )
    assert one == two and len(one) == 27


def test_ranking_metrics(spark):
    df = spark.createDataFrame(
        [("q", 1, 0.5, False), ("q", 2, 1.0, True), ("q", 3, 1.0, True)],
        "q string, rank int, rel double, hit boolean",
    )
    r = metrics.ranking(df, ["q"], "rank", F.col("rel"), F.col("hit"), 10).first()
    assert (r.recall_at_k, r.precision_at_k, r.mrr, r.first_relevant_rank, r.exact_rank, r.relevant_in_top_k) == (1.0, 0.2, 0.5, 2, 3, 2)


def test_recency_skips_nulls_first(spark):
    df = spark.createDataFrame([("u", i, None if i % 2 else float(i)) for i in range(20)], "u string, seq int, v double")
    assert rows(metrics.recency(df, ["u"], ["seq"], "v")) == [("u", 18.0, 14.0, 9.0)]


def test_rewards(spark):
    df = spark.createDataFrame(
        [("x", 0.9, 1.0), ("x", 0.1, 0.0), ("y", 0.5, None), (None, 1.0, 1.0), ("z", 0.0, 1.0)],
        "action string, s double, r double",
    )
    assert rows(policy.action_rewards(df, F.col("action"), "s", "r")) == [("x", 0.9, 2, 1.0)]
    assert policy.select_action(df, F.col("action"), "s", "r", "none") == "x"


def test_staged_search_runs_nothing_twice():
    ran = []

    def trial(p):
        ran.append(dict(p))
        return -abs(p["a"] - 2) - (p["b"] != "y")

    best, seen = policy.staged_search(trial, {"a": 0, "b": "x"}, [("a", [0, 1, 2, 3]), ("b", ["x", "y"]), ("a", [1, 2])])
    assert best == {"a": 2, "b": "y"} and len(ran) == len(seen)


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = spark.createDataFrame(
        [("a", "b", "P", 1, 0), ("b", "c", "P", 2, 1), ("c", "a", "P", 1, 2), ("a", "b", "P", 1, 3), ("d", "e", "Q", 1, 4)],
        "src string, dst string, predicate string, weight int, seq long",
    )
    nodes = spark.createDataFrame(
        [(n, "Laptop" if n in "ab" else "Brand", n.upper(), None, i) for i, n in enumerate("abcde")],
        "id string, type string, name string, tier string, seq long",
    )
    return nodes, edges


def test_hops_and_bags(spark, small_graph):
    seeds = spark.createDataFrame([("a",)], "id string")
    near = graph.khop(small_graph[1], seeds, 1)
    assert dict(rows(near)) == {"a": 0, "b": 1, "c": 1}
    assert graph.induced(small_graph[1], near).count() == 4  # both edges from a to b


def test_pagerank(spark, small_graph):
    nodes, edges = small_graph
    ranks = dict(rows(graph.pagerank(nodes, edges, spark.createDataFrame([("a",)], "id string"), iterations=60)))
    want = dict.fromkeys("abcde", 0.2)
    for _ in range(60):  # by the definition
        new = dict.fromkeys("abcde", 0.0)
        for s, d in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")):
            new[d] += want[s]
        want = {n: 0.85 * (new[n] + want["e"] * (n == "a")) + 0.15 * (n == "a") for n in want}
    assert ranks == pytest.approx(want, abs=1e-4)


def test_retrieval_over_a_graph(spark, small_graph):
    told, items = graph.retrieve(*small_graph, spark.createDataFrame([("c",)], "id string"), hops=1)
    assert told.count() == 4 and told.filter("sentence is null").count() == 0
    assert {r[0] for r in rows(items)} == {"a", "b"}


def test_common_entities_link_nothing(spark):
    df = spark.createDataFrame([(i, e) for i in range(5) for e in ("p", "q", "r")] + [(9, "p"), (9, "q")], "i int, e string")
    assert graph.similar_pairs(df, "i", "e", 3, bucket_max=6).count() == 10
    assert graph.similar_pairs(df, "i", "e", 3, bucket_max=5).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Description,Price\nFoo,"x, y","54,999"\nBar,z,oops\n')
    assert rows(readers.csv_catalog(spark, str(tmp_path / "a.csv")), "Name") == [("Bar", "z", None), ("Foo", "x, y", 54999)]
    assert readers.csv_texts(spark, {"toys": str(tmp_path)}).filter("text like 'CATEGORY: toys\nName: Foo%'").count() == 1
    (tmp_path / "log.jsonl").write_text('{"pipeline": "p", "question": "q"}\n\nbroken {\n{"pipeline": "r"}\n')
    assert [r["pipeline"] for r in readers.jsonl(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()] == ["p", "r"]
    assert readers.parquet_or_empty(spark, str(tmp_path / "none"), readers.CASES).count() == 0
    assert readers.graph(spark, str(tmp_path / "g"), 2) is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "id int, v string, question string")
    sinks.append_rows(make((1, "a", "q"), (2, "b", " ")), path, ["question"])
    sinks.upsert(make((1, "c", "q"), (3, "d", "q")), path, "id")
    assert rows(sinks.read(spark, path).select("id", "v"), "id") == [(1, "c"), (3, "d")]
    sinks.delete(spark, path, F.col("id") == 3)
    assert rows(sinks.read(spark, path).select("id"), "id") == [(1,)]
    assert json.loads(sinks.json_report(sinks.read(spark, path)))["v"] == "c"
    assert "c" in sinks.report(sinks.read(spark, path))


def test_models_behind_hooks(spark):
    df = spark.createDataFrame([(1, "hi"), (2, None)], "id int, p string")
    assert rows(hooks.generated(df, F.col("p")).select("id", "answer"), "id") == [(1, "echo: hi"), (2, None)]
    answers = spark.createDataFrame([(1, '```json\n{"a": 7, "b": "3"'), (2, "no")], "id int, t string")
    assert rows(hooks.judged(answers, "t", ["a", "b"]).select("id", "a", "b"), "id") == [(1, 7, 3), (2, 0, 0)]
    batch = spark.createDataFrame(
        [(["k0", "k1"], '[{"index": "1", "question": "q", "answer": "a"}, {"index": 7, "question": "q", "answer": "a"}, {"index": 0, "question": " ", "answer": "a"}]')],
        "slots array<string>, t string",
    )
    assert rows(hooks.routed(batch, "t", "slots")) == [("k1", "q", "a")]


def test_work_is_done_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    for k in ("c1", "c2"):  # a lost checkpoint makes the same rows come again
        stream = spark.readStream.schema("id long").parquet(source)
        streams.generate_once(stream, "id", lambda b: b.withColumn("x", F.lit(1)), out, str(tmp_path / k)).awaitTermination()
    assert streams.generated(spark, out).count() == 5


def test_medians_by_counts(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 1.0], [float(i * 7 % 101) for i in range(500)], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "p double").repartition(4)
        got = spark.range(1).select(catalog.median(df, "p").alias("m")).first()["m"]
        half = sorted(values)
        n = len(half)
        assert got == ((half[(n - 1) // 2] + half[n // 2]) / 2 if n else None)
    assert rows(catalog.order_statistics(spark.createDataFrame([], "p double"), "p")) == [(0, None, None, None, None)]


def test_waiting_as_long_as_the_service_says():
    waited, answers = [], ["429 retry in 2.5s", "RESOURCE_EXHAUSTED", None]

    def client(prompts):
        if said := answers.pop(0):
            raise RuntimeError(said)
        return list(prompts)

    assert hooks.with_backoff(lambda: client, 3, 5.0, waited.append)()(["x"]) == ["x"] and waited == [3.5, 10.0]
    answers[:] = ["other failure"]
    with pytest.raises(RuntimeError, match="other"):
        hooks.with_backoff(lambda: client, 3, 5.0, waited.append)()(["x"])
    answers[:] = ["429"] * 9
    with pytest.raises(RuntimeError, match="429"):
        hooks.with_backoff(lambda: client, 1, 0.0, waited.append)()(["x"])


def test_vectors_of_another_width_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "v")
    good = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    sinks.recreate(good, path, "v")
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], None]):
        with pytest.raises(Exception, match="has not the width 2"):
            sinks.recreate(spark.createDataFrame(list(enumerate(bad)), "id int, v array<double>").coalesce(1), path, "v")
    assert rows(sinks.read(spark, path)) == [(1, [1.0, 2.0])]


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("x,y\n1,2\n")
    (tmp_path / "two.csv").write_text("y,x\n3,4\n")
    (tmp_path / "three.csv").write_text("x,y\n5,6\n")
    (tmp_path / "none.csv").write_text("")
    got = {r.text for r in readers.csv_texts(spark, {"c": str(tmp_path)}).collect()}
    assert got == {"CATEGORY: c\nx: 1\ny: 2\n", "CATEGORY: c\ny: 3\nx: 4\n", "CATEGORY: c\nx: 5\ny: 6\n"}


def test_walks_are_kept_until_a_rebuild(spark):
    memo, made = graph.OneTime(), []

    def walk():
        made.append(1)
        return (spark.range(3),)

    assert memo.get("k", walk)[0].count() == memo.get("k", walk)[0].count() == 3 and len(made) == memo.walks == 1
    memo.clear()
    memo.get("k", walk)
    assert len(made) == 2


def test_an_ended_conversation_stays_ended(spark):
    from tarnfell.operators import assistant

    data = [
        (1, 0, "user", False, False),
        (1, 1, "assistant", False, True),
        (1, 2, "user", False, False),
        (1, 3, "user", True, False),
        (1, 4, "assistant", False, True),
        (2, 0, "user", True, False),
        (2, 1, "assistant", False, True),
    ]
    df = spark.createDataFrame(data, "c int, turn int, role string, bad boolean, done boolean")
    got = assistant.phases(df, "c", ["turn"], F.col("bad"), F.col("done")).select("c", "turn", "phase", "next_phase", "step")
    assert rows(got, "c", "turn") == [
        (1, 0, "gather", "gather", "gather"), (1, 1, "gather", "followup", "recommend"), (1, 2, "followup", "followup", "followup"), (1, 3, "followup", "end", "flagged"),
        (1, 4, "end", "end", "ignored"), (2, 0, "gather", "end", "flagged"), (2, 1, "end", "end", "ignored"),
    ]


def test_policies_without_cases(spark):
    none = spark.createDataFrame([], "action string, s double, r double")
    assert rows(policy.summary(none, F.col("action"), "s", "r", "safe")) == [("default_no_similar_evaluated_cases", "safe", 0, [])]


def test_contents_of_messages(spark):
    from tarnfell.functions import text

    data = {
        "plain": "plain",
        '"quoted \\"x\\""': 'quoted "x"',
        '[{"type":"text","text":"a"},"b",{"type":"image"}]': "ab",
        "[not json": "[not json",
        None: "",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in data], "c string")
    assert {r.c: r.t for r in df.select("c", text.content_text(F.col("c")).alias("t")).collect()} == data


def test_vectors_of_no_words(spark):
    from tarnfell.functions import vectors

    df = spark.createDataFrame([(None,), ("",), ("!",), ("word",)], "t string")
    got = [r.v for r in df.select(vectors.hash_embed(F.col("t"), 8).alias("v")).collect()]
    assert got[0] == got[1] == got[2] == [0.0] * 8 and sum(x * x for x in got[3]) == 1.0


def test_no_names_find_nothing(spark, small_graph):
    assert graph.find_items(small_graph[0], []).count() == 0
    told, seeds = graph.retrieve_for_names(*small_graph, ["nobody"])
    assert told.count() == seeds.count() == 0


def test_alike_items_meet_the_grid_once(spark):
    items = spark.range(500).selectExpr("id AS item", "if(id % 2 = 0, 'low', 'high') AS f1", "double(id % 50) AS price")
    ranges = spark.createDataFrame([("low", 0.0, 10.0), ("medium", 10.0, 60.0), ("high", 90.0, 99.0)], "tier string, low double, high double")
    grid = match.combo_grid(spark, ["f1"])
    found = match.best_match_direct(grid, items, ranges, ["f1"], "item", "price")
    rows = lambda df: sorted(map(tuple, df.select("combo_key", "item", "match_score", "within_budget").collect()))
    assert rows(found) == rows(match.best_match(grid, items, ranges, ["f1"], "item", "price")) and len(rows(found)) == 9
    assert "Aggregate [budget_tier" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_lists_are_dealt_over_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from tarnfell.plans import catalog_queries

    monkeypatch.setattr(catalog_queries, "LISTED", 500, raising=False)
    lines = [(i // 5, i % 5 + 1, float(i % 50), 100.0 + i, "AN"[i % 2]) for i in range(6000)] + [(9, 11, 1.0, 1.0, "A")]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog_queries.retrieval_metrics(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 12 and got.count() == 1200
