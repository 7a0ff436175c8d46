"""Many walks at once against exact ones, and similar items against all pairs."""

import itertools
import random

import numpy as np
import pytest

from tarnfell.operators import graph, walks


def exact(n, edges, seeds, damping=0.85):
    """The stationary ranks by solving for them."""
    m, out = np.zeros((n, n)), np.zeros(n)
    for s, d, w in edges:
        out[s] += w
    for s, d, w in edges:
        m[d, s] += w / out[s]
    start = np.zeros(n)
    start[list(seeds)] = 1 / len(seeds)
    for s in range(n):
        if not out[s]:
            m[:, s] = start
    return np.linalg.solve(np.eye(n) - damping * m, (1 - damping) * start)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(15)
    edges = [(0, i, 1) for i in range(1, 60)]  # a hub
    edges += [(rng.randrange(60), rng.randrange(50), rng.randrange(1, 4)) for _ in range(150)]  # some nodes lead nowhere
    seeds = {q: rng.sample(range(60), rng.randrange(1, 4)) for q in range(100)}
    return edges, seeds


def test_a_hundred_walks_are_within_their_bound(spark, some):
    edges, seeds = some
    every = spark.createDataFrame([(q, s, d, w) for q in seeds for s, d, w in edges], "query_id int, src int, dst int, weight int")
    starts = spark.createDataFrame([(q, i) for q, ids in seeds.items() for i in ids + ids[:1]], "query_id int, id int")
    found = walks.push(every, starts, least=1e-3).toPandas()
    assert set(found["query_id"]) == set(seeds)
    for q, got in found.groupby("query_id"):
        want, left = exact(60, edges, seeds[q]), got["left"].iloc[0]
        ranks = np.zeros(60)
        ranks[got["id"]] = got["rank"]
        assert left <= 60 * 1e-3 and np.abs(ranks - want).sum() <= left + 1e-9
        assert abs(ranks.sum() + left - 1) < 1e-9


def test_neighbourhoods_and_their_edges(spark, some):
    edges, seeds = some
    plain = spark.createDataFrame(edges, "src int, dst int, weight int")
    starts = spark.createDataFrame([(q, i) for q in range(12) for i in seeds[q]], "query_id int, id int")
    found = walks.near(plain, starts, 1)
    inner = walks.induced(plain, found)
    got, held = {}, {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.id] = r.hop
    for r in inner.collect():
        held.setdefault(r.query_id, []).append((r.src, r.dst, r.weight))
    for q in range(12):
        want = {i: 0 for i in seeds[q]}
        for s, d, _ in edges:
            for a, b in ((s, d), (d, s)):
                if a in seeds[q]:
                    want.setdefault(b, 1)
        assert got[q] == want
        assert sorted(held[q]) == sorted(e for e in edges if e[0] in want and e[1] in want)
    one = walks.ranks(plain, starts.filter("query_id = 3"), 1, least=1e-4).toPandas()
    nodes = sorted(got[3])
    want = exact(len(nodes), [(nodes.index(s), nodes.index(d), w) for s, d, w in held[3]], [nodes.index(i) for i in seeds[3]])
    assert np.abs(one.sort_values("id")["rank"].to_numpy() - want[[nodes.index(i) for i in sorted(one["id"])]]).sum() <= one["left"].iloc[0] + 1e-9
    assert walks.ranks(plain, starts.limit(0), 1).count() == 0
    alone = walks.ranks(plain.limit(0), spark.createDataFrame([(1, 5)], "query_id int, id int"), 1, least=0.5).first()
    assert alone.id == 5 and alone.rank + alone.left == pytest.approx(1)  # without edges the walk stays where it starts


def test_what_leads_to_a_hub_is_not_listed_for_each_walk(spark, monkeypatch):
    edges = [(f"leaf{i}", "hub", 1) for i in range(300)] + [("hub", "top", 2), ("top", "hub", 1), ("top", "side", 1), ("side", "leaf9", 1)]
    plain = spark.createDataFrame(edges, "src string, dst string, weight int")
    starts = spark.createDataFrame([(q, i) for q in range(5) for i in (f"leaf{q}", "top")] + [(9, "hub")], "query_id int, id string")
    whole = walks.induced(plain, walks.near(plain, starts, 2)).select("query_id", "src", "dst", "weight")
    want = {(r.query_id, r.id): (r.rank, r.left) for r in walks.push(whole, starts, least=1e-4).collect()}
    handed, push = [], walks.push
    monkeypatch.setattr(walks, "push", lambda e, *a, **k: handed.append(e.count()) or push(e, *a, **k))
    got = {(r.query_id, r.id): (r.rank, r.left) for r in walks.ranks(plain, starts, 2, least=1e-4).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert handed[0] < 50 < whole.count()


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_similar_items_equal_all_pairs(spark, least):
    rng = random.Random(least)
    links = [(i, f"e{int(rng.paretovariate(0.7)) % 40}") for i in range(80) for _ in range(rng.randrange(9))]
    links += links[:30] + [(None, "e1"), (5, None)] + [(i, f"all{i % 2}") for i in range(80)]
    df = spark.createDataFrame(links, "i int, e string").repartition(3)
    held = {}
    for i, e in links:
        if i is not None and e is not None:
            held.setdefault(e, set()).add(i)
    own = {}
    for e, items in held.items():
        if len(items) <= 35:
            for i in items:
                own.setdefault(i, set()).add(e)
    want = sorted((a, b, len(own[a] & own[b])) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= least)
    assert sorted(map(tuple, graph.similar_pairs(df, "i", "e", least, bucket_max=35).collect())) == want
    assert want or least == 5


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_without_a_bound_every_entity_links(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "CHUNK", 3)
    monkeypatch.setattr(graph, "PAIRS", 100)
    rng = random.Random(least)
    links = [(f"i{i}", f"e{int(rng.paretovariate(0.7)) % 12}") for i in range(90) for _ in range(rng.randrange(9))]
    links += links[:30] + [(None, "e1"), ("i5", None)] + [(f"i{i}", f"all{j}") for i in range(60) for j in range(i % 2 + 1)]
    own = {}
    for i, e in links:
        if i is not None and e is not None:
            own.setdefault(i, set()).add(e)
    want = sorted((a, b, len(own[a] & own[b])) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= least)
    df = spark.createDataFrame(links, "i string, e string").repartition(3)
    assert sorted(map(tuple, graph.similar_pairs(df, "i", "e", least, bucket_max=None).collect())) == want
    assert len(want) > 50 and graph.similar_pairs(df.limit(0), "i", "e", least, bucket_max=None).count() == 0


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """A catalogue whose tiers and brands have more items than any bound that the queries had."""
    path = str(tmp_path_factory.mktemp("common"))
    rows = spark.range(900).selectExpr(
        "id AS p_partkey", "IF(id % 2 = 0, 'red rod', 'old widget') AS p_name", "'Brand#7' AS p_brand", "IF(id % 3 = 0, 'PROMO', 'STANDARD') AS p_type", "int(id % 50) AS p_size", "900.5 AS p_retailprice"
    )
    rows.withColumn("p_retailprice", rows.p_retailprice.cast("double")).write.parquet(f"{path}/part.parquet")
    return path


def test_common_tiers_make_items_similar(spark, common):
    from tarnfell.plans import graph_queries

    got = graph_queries.kg_similar_edges(spark, common).groupBy("weight").count().collect()
    # Six entities, of which the two names differ in two and the two types in one.
    alike, kind, name, both = 2 * (150 * 149 + 300 * 299), 2 * 2 * 150 * 300, 2 * (150 * 150 + 300 * 300), 2 * 2 * 150 * 300
    assert {r["weight"]: r["count"] for r in got} == {6: alike, 5: kind, 4: name, 3: both}


@pytest.mark.parametrize("least", [3e-2, 2e-3])
def test_walks_among_classes_equal_walks_along_listed_pairs(spark, least):
    rng = random.Random(31)
    kinds = [[f"t{rng.randrange(3)}-{k}" for k in range(4)] + [f"brand{rng.randrange(4)}"] for _ in range(14)]
    own = {f"i{i}": rng.choice(kinds) for i in range(70)} | {"few": ["t0-0", "t1-1"], "none": []}
    tiers = [(i, e) for i, es in own.items() for e in es]
    edges = [(i, e, 1) for i, e in tiers] + [(i, f"size{rng.randrange(5)}", rng.randrange(1, 3)) for i in own for _ in range(2) if i != "none"]
    shared = {(a, b): len(set(own[a]) & set(own[b])) for a, b in itertools.permutations(own, 2)}
    every = edges + [(a, b, n) for (a, b), n in shared.items() if n >= 3]
    starts = [(q, i) for q in range(8) for i in rng.sample(sorted(own), rng.randrange(1, 3))] + [(20, "few"), (21, "none"), (22, "i3"), (22, "none"), (22, "i3")]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string, weight int")
    seeds = spark.createDataFrame(starts, "query_id long, id string")
    want = {(r.query_id, r.id): r["rank"] for r in walks.ranks(frame(every), seeds, 1, least=least, most=6).collect()}
    classes = graph.classes_of(spark.createDataFrame(tiers, "i string, e string"), "i", "e")
    pairs = graph.similar_classes(classes.select("es").distinct())
    found = walks.ranks_alike(frame(edges), classes, pairs, seeds, least=least, most=6)
    got = {(r.query_id, r.id): r["rank"] for r in found.collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert (len(want) > 300) == (least < 1e-2)


def test_walks_reach_items_of_common_tiers(spark, common):
    import duckdb

    from tarnfell.plans import graph_queries, registry

    got = sorted(map(tuple, graph_queries.kg_similar_walks(spark, common).collect()))
    assert any(id_.isdigit() and int(id_) != query for query, _, id_, _ in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{common}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLES["kg_similar_walks"]).fetchall())


def test_items_of_one_file_are_many_tasks(spark, monkeypatch):
    from tarnfell.operators import lineage

    items = spark.range(200).coalesce(1).selectExpr("string(id) AS id", "id AS pos", "'n' AS name", "'Small. Size 3 kg.' AS description", "1.0 AS price", "'low' AS f1")
    made = graph.item_edges(items, ["f1"])
    monkeypatch.setattr(lineage, "ROWS", 20)
    dealt = graph.item_edges(items, ["f1"])
    assert made.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 10
    assert sorted(map(str, made.collect())) == sorted(map(str, dealt.collect()))


def test_checkpoints_that_grew_are_not_broadcast(spark, tmp_path):
    from tarnfell.operators import lineage

    spark.range(50).write.parquet(f"{tmp_path}/t")
    made = lineage.merged(spark.read.parquet(f"{tmp_path}/t").selectExpr("id", "explode(sequence(0, 99)) AS n"))
    plan = spark.range(5).join(made, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
