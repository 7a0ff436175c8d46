"""Registered queries: knowledge graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import text
from tarnfell.operators import catalog, graph, reindex, walks
from tarnfell.operators.lineage import cut, fresh_folder
from tarnfell.plans.registry import query
from tarnfell.plans.shared import DIMS, KEYWORDS, SQL_BAND, SQL_TIERED, described, parts, table, tiered
from tarnfell.sources import keyed

BRANDS = [f"brand#{i}" for i in range(25, 0, -1)]
CASES = {"light": ["small", "ring"], "heavy": ["large", "anvil"], "trade": ["promo"]}
SPECS = {"HAS_SIZE": r"\b(size \d+)\b", "WEIGHS": r"\b(\d(?:\.\d+)?\s*kg)\b"}


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_items(tiered(spark, sf_dir))


def _as_items(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").alias("pos"),
        F.col("p_name").alias("name"),
        "description",
        (F.col("p_retailprice") * 100).alias("price"),
        *DIMS,
    )


def _entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.item_edges(_items(spark, sf_dir), DIMS, BRANDS, CASES, SPECS)


_I = f"(SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, description AS d, lower(description) AS l, p_retailprice * 100 AS price, p_size, {', '.join(DIMS)} FROM {SQL_TIERED})"
_BRAND = "CASE " + " ".join(f"WHEN contains(l, '{b}') THEN '{b}'" for b in BRANDS) + " ELSE 'unknown_brand' END"
_EDGES = " UNION ALL ".join(
    [
        *(f"SELECT id AS src, '{f}::' || {f} AS dst, 'HAS_{f.upper()}_TIER' AS predicate, 'Tier' AS type FROM {_I}" for f in DIMS),
        f"SELECT id, 'Brand::' || {_BRAND}, 'MADE_BY', 'Brand' FROM {_I}",
        f"SELECT id, 'PriceBand::' || {SQL_BAND.format('price')}, 'IN_PRICE_BAND', 'PriceBand' FROM {_I}",
        *(f"SELECT id, 'UseCase::{c}', 'SUITED_FOR', 'UseCase' FROM {_I} WHERE {' OR '.join(f"contains(l, '{w}')" for w in ws)}" for c, ws in CASES.items()),
        f"SELECT id, 'SIZE::size_' || p_size, 'HAS_SIZE', 'SIZE' FROM {_I}",
        f"SELECT id, 'WEIGH::' || p_size || '_kg', 'WEIGHS', 'WEIGH' FROM {_I} WHERE p_size < 10",
        f"SELECT id, id || '::chunk::' || i, 'HAS_CHUNK', 'Chunk' FROM {_I}, (SELECT unnest([0, 1]) AS i)",
        f"SELECT id || '::chunk::0', id || '::chunk::1', 'NEXT_CHUNK', 'Chunk' FROM {_I}",
    ]
)


@query(f"SELECT src, dst, predicate, CAST(1 AS INT) AS weight FROM ({_EDGES})")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(_entity_edges(spark, sf_dir)).drop("seq")


@query(f"SELECT id, 'Laptop' AS type, name AS label FROM {_I} UNION ALL SELECT DISTINCT dst, type, CASE type WHEN 'SIZE' THEN replace(string_split(dst, '::')[-1], '_', ' ') WHEN 'WEIGH' THEN replace(string_split(dst, '::')[-1], '_', ' ') ELSE string_split(dst, '::')[-1] END FROM ({_EDGES}) WHERE predicate <> 'NEXT_CHUNK'")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes_of(_items(spark, sf_dir), _entity_edges(spark, sf_dir))
    return nodes.select("id", "type", text.node_label(F.col("id"), F.col("type"), F.col("name"), F.col("tier")).alias("label"))


@query(f"""SELECT part, kind, count(*) AS n FROM (SELECT 'edge' AS part, predicate AS kind FROM ({_EDGES}) UNION ALL SELECT 'node', 'Laptop' FROM part UNION ALL SELECT 'node', type FROM (SELECT DISTINCT dst, type FROM ({_EDGES}))) GROUP BY ALL""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _entity_edges(spark, sf_dir)
    return graph.stats(graph.nodes_of(_items(spark, sf_dir), edges), graph.edges_of(edges))


@query("""WITH l AS (SELECT p_partkey AS i, 'b' || p_brand AS e FROM part UNION SELECT p_partkey, 's' || p_size FROM part UNION SELECT p_partkey, 'n' || p_name FROM part),
          s AS (SELECT e FROM l GROUP BY e HAVING count(*) BETWEEN 2 AND 200)
          SELECT x.i AS a, y.i AS b, count(*) AS overlap FROM l x JOIN l y ON x.e = y.e AND x.i < y.i WHERE x.e IN (SELECT e FROM s) GROUP BY ALL HAVING count(*) >= 2""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("s"), F.col("p_size").cast("string")), F.concat(F.lit("n"), "p_name"))
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.explode(own).alias("e"))
    return graph.similar_pairs(links, "i", "e", 2)


# ------------------------------------------------------------------------- the graph of places: customers, nations, ...


def _geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def edges(df: DataFrame, src, dst, predicate: str, weight, part: int, order: str) -> DataFrame:
        return df.select(
            src.alias("src"),
            dst.alias("dst"),
            F.lit(predicate).alias("predicate"),
            weight.cast("int").alias("weight"),
            (F.lit(part * 10**12) + F.col(order)).cast("long").alias("seq"),
        )

    def nodes(df: DataFrame, id_, kind: str, name: str, part: int, order: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(
            id_.alias("id"),
            F.lit(kind).alias("type"),
            F.col(name).alias("name"),
            none.alias("tier"),
            (F.lit(part * 10**12) + F.col(order)).cast("long").alias("seq"),
        )

    c, s, n, r = t("customer"), t("supplier"), t("nation"), t("region")
    one = F.lit(1)
    all_edges = graph.union(
        [
            edges(c, key("C", "c_custkey"), key("N", "c_nationkey"), "LIVES_IN", one, 1, "c_custkey"),
            edges(s, key("S", "s_suppkey"), key("N", "s_nationkey"), "SELLS_IN", one, 2, "s_suppkey"),
            edges(n, key("N", "n_nationkey"), key("R", "n_regionkey"), "PART_OF", F.col("n_nationkey") % 3 + 1, 3, "n_nationkey"),
            edges(n, key("R", "n_regionkey"), key("N", "n_nationkey"), "HAS_PART", one, 4, "n_nationkey"),
        ]
    )
    all_nodes = graph.union(
        [
            nodes(c, key("C", "c_custkey"), "Laptop", "c_name", 1, "c_custkey"),
            nodes(s, key("S", "s_suppkey"), "Supplier", "s_name", 2, "s_suppkey"),
            nodes(n, key("N", "n_nationkey"), "Nation", "n_name", 3, "n_nationkey"),
            nodes(r, key("R", "r_regionkey"), "Region", "r_name", 4, "r_regionkey"),
        ]
    )
    return all_nodes, all_edges


_GEO = """e AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'LIVES_IN' AS predicate, 1 AS weight, CAST(1000000000000 + c_custkey AS BIGINT) AS seq FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'SELLS_IN', 1, 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF', n_nationkey % 3 + 1, 3000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'HAS_PART', 1, 4000000000000 + n_nationkey FROM nation),
 nodes AS (SELECT 'C' || c_custkey AS id, 'Laptop' AS type, c_name AS name FROM customer UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Region', r_name FROM region)"""
SEEDS, ROUNDS = ("S1", "S2", "R3"), 20
_SEEDS = "(SELECT unnest(['S1', 'S2', 'R3']) AS id)"
def _near(seeds: str, hops: int = 2) -> str:
    """The nodes around the seeds, hop by hop."""
    steps, seen = [f"h0 AS (SELECT id, 0 AS hop FROM {seeds})"], "SELECT id FROM h0"
    for h in range(1, hops + 1):
        steps.append(f"h{h} AS (SELECT DISTINCT dst AS id, {h} AS hop FROM u JOIN h{h - 1} ON src = id WHERE dst NOT IN ({seen}))")
        seen += f" UNION ALL SELECT id FROM h{h}"
    every = " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(hops + 1))
    return f"u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {', '.join(steps)}, near AS ({every})"


def _ranks(seeds: str) -> str:
    """Power iteration, unrolled as often as the query's."""
    start = f"CASE WHEN id IN (SELECT id FROM {seeds}) THEN 1.0::DOUBLE ELSE 0 END / (SELECT count(*) FROM near WHERE id IN (SELECT id FROM {seeds}))"
    rounds = [
        f"""n{i} AS MATERIALIZED (SELECT a.id, a.p, a.dangling, 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (dangling), 0) FROM n{i - 1}) * a.p) + 0.15::DOUBLE * a.p AS rank
            FROM n{i - 1} a LEFT JOIN (SELECT dst AS id, sum(share * rank) AS got FROM st JOIN n{i - 1} b ON b.id = st.src GROUP BY dst) g USING (id))"""
        for i in range(1, ROUNDS + 1)
    ]
    return f"""inn AS (SELECT * FROM e WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)), outs AS (SELECT src, sum(weight) AS w FROM inn GROUP BY src),
      st AS (SELECT src, dst, sum(weight)::DOUBLE / any_value(w) AS share FROM inn JOIN outs USING (src) GROUP BY src, dst),
      n0 AS MATERIALIZED (SELECT id, {start} AS p, id NOT IN (SELECT src FROM outs) AS dangling, 1.0::DOUBLE / count(*) OVER () AS rank FROM near), {', '.join(rounds)}"""


_NEAR, _RANKS = _near(_SEEDS), _ranks(_SEEDS)
_ALL_TRIPLETS = f"""SELECT a.name AS subject, predicate, b.name AS object, src AS subject_id, dst AS object_id, round((x.rank + y.rank) / 2, 6) AS score, seq
  FROM inn JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst JOIN n{ROUNDS} x ON x.id = src JOIN n{ROUNDS} y ON y.id = dst ORDER BY score DESC, seq"""
_TRIPLETS = f"{_ALL_TRIPLETS} LIMIT 25"
_SAID_AS = "subject || ' ' || lower(predicate) || ' ' || object || '.'"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, SEEDS))).alias("id"))


@query(f"WITH {_GEO}, {_NEAR} SELECT id, hop FROM near")
def khop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.khop(_geo(spark, sf_dir)[1], _seeds(spark))


def _ppr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _geo(spark, sf_dir)
    near = graph.khop(edges, _seeds(spark))
    inner = graph.induced(edges, near)
    return nodes, inner, graph.pagerank(near, inner, _seeds(spark), iterations=ROUNDS, tolerance=None)


def _triplets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, inner, ranks = _ppr(spark, sf_dir)
    return nodes, graph.triplets(nodes, inner, ranks)


@query(f"WITH {_GEO}, {_NEAR}, {_RANKS} SELECT id, round(rank, 6) AS rank FROM n{ROUNDS}")
def personalised_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ppr(spark, sf_dir)[2].select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_GEO}, {_NEAR}, {_RANKS} SELECT subject, predicate, object, subject_id, object_id, score, {_SAID_AS} AS sentence FROM ({_TRIPLETS})")
def ppr_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _triplets(spark, sf_dir)[1].drop("seq")
    return found.withColumn("sentence", text.verbalise(F.col("subject"), F.col("predicate"), F.col("object")))


@query(f"WITH {_GEO}, {_NEAR}, {_RANKS}, t AS ({_TRIPLETS}), m AS (SELECT subject_id AS id, score, seq FROM t UNION ALL SELECT object_id, score, seq FROM t) SELECT id, round(sum(score), 6) AS mass FROM m WHERE id LIKE 'N%' GROUP BY id ORDER BY sum(score) DESC, min(seq) LIMIT 8")
def mass_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = _triplets(spark, sf_dir)
    return graph.mass_ranking(found, nodes.filter("type = 'Nation'")).select("id", F.round("mass", 6).alias("mass"))


_ANSWER = "The first supplier is Supplier#000000001 in nation 5."


@query(f"WITH {_GEO}, {_NEAR}, {_RANKS}, t AS ({_TRIPLETS}), w AS (SELECT subject_id AS id FROM t UNION SELECT object_id FROM t) SELECT round(avg(CAST(contains('{_ANSWER.lower()}', lower(subject)) OR contains('{_ANSWER.lower()}', lower(object)) AS INT)), 3) AS triplet_coverage, (SELECT round(avg(CAST(id IN (SELECT id FROM w) AS INT)), 3) FROM {_SEEDS}) AS seed_recall, round(avg(score), 6) AS avg_path_score FROM t")
def kg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coverage(_triplets(spark, sf_dir)[1], _seeds(spark), _ANSWER)


@query("""WITH g AS (SELECT CAST(c_custkey AS VARCHAR) AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS r FROM customer), v AS (SELECT CAST(o_custkey AS VARCHAR) AS id, row_number() OVER (ORDER BY round(sum(o_totalprice), 6) DESC, o_custkey) - 1 AS r FROM orders GROUP BY o_custkey)
          SELECT id, round(coalesce(0.4::DOUBLE / (61 + g.r), 0) + coalesce(0.6::DOUBLE / (61 + v.r), 0), 8) AS score FROM g FULL JOIN v USING (id)""")
def kg_vector_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of all customers, by balance and by what they have ordered."""
    ranked = lambda df, order: catalog.renumber(df, order, "rank").select("id", "rank")
    g = ranked(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_acctbal", "c_custkey"),
        [F.desc("c_acctbal"), F.col("c_custkey")],
    )
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    v = ranked(spent.withColumn("id", F.col("o_custkey").cast("string")), [F.desc(F.round("spent", 6)), F.col("o_custkey")])
    return graph.fuse_rankings(g, v).select("id", F.round("score", 8).alias("score"))


_ASKED = "Nation NATION_7 of region ASIA or europe and supplier"


def _embed_sql(expr: str, tag: str) -> str:
    return f"""{tag}t AS (SELECT id, unnest(regexp_extract_all(lower({expr}), '[a-z0-9]+')) AS t FROM {tag}s), {tag}b AS (SELECT id, CAST('0x' || right(md5(t), 2) AS INT) AS b FROM {tag}t),
      {tag}c AS (SELECT id, b % 64 AS i, sum(CASE WHEN (b // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM {tag}b GROUP BY ALL), {tag}v AS (SELECT id, i, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS x FROM {tag}c)"""


@query(f"""WITH {_GEO}, ns AS (SELECT id, type || ' ' || name AS txt FROM nodes), qs AS (SELECT 'q' AS id, '{_ASKED}' AS txt),
           {_embed_sql('txt', 'n')}, {_embed_sql('txt', 'q')}, d AS (SELECT nv.id, sum(nv.x * qv.x) AS score FROM nv JOIN qv ON nv.i = qv.i GROUP BY nv.id)
           SELECT id, name AS label, round(score, 4) AS score FROM (SELECT nodes.id, nodes.name, coalesce(score, 0) AS score FROM nodes LEFT JOIN d USING (id) ORDER BY round(coalesce(score, 0), 9) DESC, CASE type WHEN 'Laptop' THEN 1 WHEN 'Supplier' THEN 2 WHEN 'Nation' THEN 3 ELSE 4 END, CAST(substring(nodes.id, 2) AS INT) LIMIT 10) WHERE score > 0""")
def hash_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flat_search(_geo(spark, sf_dir)[0], _ASKED, 10)


def _told_sql(seeds: str, hops: int, k: int, before: str = "") -> str:
    return f"""WITH {_GEO}, {before} {_near(seeds, hops)}, {_ranks(seeds)} SELECT subject, predicate, object, subject_id, object_id, score, {_SAID_AS} AS sentence FROM ({_ALL_TRIPLETS} LIMIT {k})"""


_WALK = {"iterations": ROUNDS, "tolerance": None}
NAMES = ("Customer#000000007", "customer#000000003", "nobody", "Customer#00000001")
_NAMED = "(SELECT unnest(['C7', 'C3', 'C10']) AS id)"


@query(_told_sql("(SELECT 'N3' AS id)", 1, 50))
def explain_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _geo(spark, sf_dir)
    return graph.explain(nodes, edges, "N3", **_WALK).drop("seq")


@query(_told_sql(_NAMED, 1, 25))
def kg_retrieve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.retrieve_for_names(*_geo(spark, sf_dir), NAMES, **_WALK)[0].drop("seq")


@query(f"WITH {_GEO}, {_near(_NAMED)}, {_ranks(_NAMED)}, t AS ({_TRIPLETS}), m AS (SELECT subject_id AS id, score, seq FROM t UNION ALL SELECT object_id, score, seq FROM t) SELECT id, round(sum(score), 6) AS mass FROM m WHERE id LIKE 'C%' GROUP BY id ORDER BY sum(score) DESC, min(seq) LIMIT 8")
def kg_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _geo(spark, sf_dir)
    return graph.retrieve(nodes, edges, graph.find_items(nodes, NAMES), **_WALK)[1].select("id", F.round("mass", 6).alias("mass"))


@query("SELECT CAST(unnest([0, 1, 3]) AS INT) AS ord, unnest(['C7', 'C3', 'C10']) AS id")
def kg_find_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_items(_geo(spark, sf_dir)[0], NAMES)


@query("SELECT unnest(['f1::high', 'Brand::brand#7', 'UseCase::trade']) AS id")
def kg_text_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes_of(_items(spark, sf_dir), _entity_edges(spark, sf_dir))
    return graph.text_seeds(nodes, "An old widget of Brand#7 for the trade", {"f1": ["widget"], "f2": ["gadget"]}, BRANDS, list(CASES))


@query(_told_sql("(SELECT 'C5' AS id)", 1, 25))
def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.local_search(*_geo(spark, sf_dir), "CUSTOMER#000000005", [], [], **_WALK)[0].drop("seq")


_UNNAMED = "nation 7 where the seventh nation is"
_FLAT = f"""ns AS (SELECT id, type || ' ' || name AS txt FROM nodes), qs AS (SELECT 'q' AS id, '{_UNNAMED}' AS txt), {_embed_sql('txt', 'n')}, {_embed_sql('txt', 'q')},
    fd AS (SELECT nv.id, sum(nv.x * qv.x) AS score FROM nv JOIN qv ON nv.i = qv.i GROUP BY nv.id),
    flat AS (SELECT fd.id FROM fd JOIN nodes ON nodes.id = fd.id ORDER BY round(score, 9) DESC, CASE type WHEN 'Laptop' THEN 1 WHEN 'Supplier' THEN 2 WHEN 'Nation' THEN 3 ELSE 4 END, CAST(substring(fd.id, 2) AS INT) LIMIT 1),"""


@query(_told_sql("(SELECT id FROM flat)", 1, 25, _FLAT))
def local_search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing bears that name, so the nearest node of the hashed space is walked around."""
    return graph.local_search(*_geo(spark, sf_dir), _UNNAMED, [], [], **_WALK)[0].drop("seq")


@query(f"WITH {_GEO}, {_near(_NAMED, 1)}, {_ranks(_NAMED)}, t AS ({_TRIPLETS}) SELECT CAST(3 AS INT) AS walks, count(*) AS n FROM t")
def kg_one_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys, asked for twice each, and one of them again after a rebuild: three walks."""
    nodes, edges = _geo(spark, sf_dir)
    memo = graph.OneTime()
    walk = lambda: graph.retrieve_for_names(nodes, edges, NAMES, **_WALK)
    for key in ("a", "b", "a", "b"):
        memo.get(key, walk)
    memo.clear()
    told, _ = memo.get("a", walk)
    return told.agg(F.count(F.lit(1)).alias("n")).withColumn("walks", F.lit(memo.walks))


_SAID = "r1 or n3 and supplier 000000001 then r1"


@query(f"""WITH {_GEO}, t AS (SELECT regexp_extract_all(lower('{_SAID}'), '[a-z0-9]+') AS t), w AS (SELECT list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS w FROM t),
           s AS (SELECT CAST(generate_subscripts(w, 1) - 1 AS INT) AS n, unnest(w) AS token FROM w), k AS (SELECT lower(name) AS token, id FROM nodes UNION SELECT lower(id), id FROM nodes)
           SELECT min(n) AS "at", min_by(token, n) AS token, id FROM s JOIN k USING (token) GROUP BY id""")
def literal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.literal_map(_geo(spark, sf_dir)[0], _SAID)


@query("SELECT 'f1::high' AS id, CAST(0 AS INT) AS ord UNION ALL SELECT 'f3::low', 1 UNION ALL SELECT 'PriceBand::mid', 2 UNION ALL SELECT 'Brand::brand#7', 3 UNION ALL SELECT 'UseCase::heavy', 5")
def entity_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes_of(_items(spark, sf_dir), _entity_edges(spark, sf_dir))
    return graph.link_entities(nodes, {"f1": "high", "f3": "low"}, 95_000, ["Brand#7", "nobody"], ["heavy", "unheard"])


@query(f"SELECT id, {_BRAND} AS brand, array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f"contains(l, '{w}')" for w in ws)} THEN '{c}' END" for c, ws in CASES.items())}], lambda c: c IS NOT NULL), ',') AS use_cases FROM {_I}")
def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return _items(spark, sf_dir).select(
        "id",
        text.brand(d, BRANDS).alias("brand"),
        F.array_join(text.use_cases(d, CASES), ",").alias("use_cases"),
    )


@query(f"SELECT id, 'HAS_SIZE' AS predicate, 'size ' || p_size AS value, 'SIZE::size_' || p_size AS entity FROM {_I} UNION ALL SELECT id, 'WEIGHS', p_size || ' kg', 'WEIGH::' || p_size || '_kg' FROM {_I} WHERE p_size < 10")
def spec_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(
        "id",
        F.explode(text.spec_triplets(F.col("name"), F.col("description"), SPECS)).alias("t"),
    ).select("id", "t.*")
    return rows.withColumn("entity", F.concat(text.entity_type(F.col("predicate")), F.lit("::"), text.normalise(F.col("value"))))


# ------------------------------------------------------------------------------------------------- many walks at once


def _sql_walks(edges: str, seeds: str, hops: int, rounds: int, least: str, k: int) -> str:
    """Neighbourhoods, edges within them and pushed residuals, all by query, unrolled hop by hop and round by round."""
    steps, seen = [f"h0 AS (SELECT DISTINCT query_id, id, 0 AS hop FROM ({seeds}))"], "SELECT query_id, id FROM h0"
    for h in range(1, hops + 1):
        steps.append(f"h{h} AS (SELECT DISTINCT query_id, u.dst AS id, {h} AS hop FROM u JOIN h{h - 1} ON src = id WHERE (query_id, u.dst) NOT IN ({seen}))")
        seen += f" UNION ALL SELECT query_id, id FROM h{h}"
    pushed = [
        f"""m{i} AS MATERIALIZED (SELECT query_id, id, sum(rank) AS rank, sum(held) AS held FROM (
              SELECT query_id, id, rank + CASE WHEN held > {least} THEN 0.15::DOUBLE * held ELSE 0 END AS rank, CASE WHEN held > {least} THEN 0 ELSE held END AS held FROM m{i - 1}
              UNION ALL SELECT query_id, st.dst, 0, 0.85::DOUBLE * held * share FROM m{i - 1} JOIN st USING (query_id) WHERE st.src = id AND held > {least}
              UNION ALL SELECT query_id, s0.id, 0, 0.85::DOUBLE * lost * s FROM s0 JOIN (SELECT query_id, sum(held) AS lost FROM m{i - 1} WHERE held > {least} AND (query_id, id) NOT IN (SELECT query_id, src FROM outs) GROUP BY query_id) USING (query_id))
            GROUP BY query_id, id)"""
        for i in range(1, rounds + 1)
    ]
    return f"""
        WITH {edges}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {', '.join(steps)},
        near AS MATERIALIZED ({' UNION ALL '.join(f'SELECT query_id, id FROM h{h}' for h in range(hops + 1))}),
        inn AS MATERIALIZED (SELECT a.query_id, src, dst, weight FROM e JOIN near a ON a.id = src JOIN near b ON b.id = dst AND b.query_id = a.query_id),
        outs AS (SELECT query_id, src, sum(weight) AS w FROM inn GROUP BY ALL),
        st AS MATERIALIZED (SELECT query_id, src, dst, sum(weight)::DOUBLE / any_value(w) AS share FROM inn JOIN outs USING (query_id, src) GROUP BY query_id, src, dst),
        s0 AS (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS s FROM h0),
        m0 AS (SELECT query_id, id, 0.0::DOUBLE AS rank, s AS held FROM s0), {', '.join(pushed)},
        r AS (SELECT query_id, id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, id) AS INT) AS place FROM m{rounds} WHERE rank > 0)
        SELECT query_id, place, id, round(rank, 6) AS rank FROM r WHERE place <= {k}"""


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("rank", 9)), "id")
    top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.select("query_id", "place", "id", F.round("rank", 6).alias("rank"))


@query(_sql_walks(_GEO, "SELECT c_custkey AS query_id, unnest(['C' || c_custkey, 'S' || (c_custkey % 10 + 1), 'R' || (c_custkey % 5)]) AS id FROM customer WHERE c_custkey % 20 = 0", 2, 12, "0.0001", 5))
def kg_many_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for every twentieth customer, from the customer, a supplier and a region."""
    _, edges = _geo(spark, sf_dir)
    key = F.col("c_custkey")
    ids = F.array(*[F.concat(F.lit(p), n.cast("string")) for p, n in (("C", key), ("S", key % 10 + 1), ("R", key % 5))])
    seeds = table(spark, sf_dir, "customer").filter(key % 20 == 0).select(key.alias("query_id"), F.explode(ids).alias("id"))
    return _top(walks.ranks(edges, seeds, 2, least=1e-4, most=12), 5)


#: In items of an entity, where a bound is the query's; the engine's own is 200, which few of these tiers stay under in
#: larger catalogues.
_BUCKET = 400


def _similar_sql(most: str) -> str:
    return f"""x AS (SELECT src, dst, predicate FROM ({_EDGES}) WHERE type <> 'Chunk'), l AS (SELECT DISTINCT src AS i, dst AS e FROM ({_EDGES}) WHERE type IN ('Tier', 'Brand')),
    {most}
    e AS (SELECT src, dst, 1 AS weight FROM x UNION ALL SELECT * FROM sim)"""


_SIMILAR = _similar_sql(f"""s AS (SELECT e FROM l GROUP BY e HAVING count(*) BETWEEN 2 AND {_BUCKET}),
    sim AS (SELECT x.i AS src, y.i AS dst, CAST(count(*) AS INT) AS weight FROM l x JOIN l y ON x.e = y.e AND x.i <> y.i WHERE x.e IN (SELECT e FROM s) GROUP BY ALL HAVING count(*) >= 3),""")
#: The same without a bound.
_ALL_SIMILAR = _similar_sql("sim AS (SELECT x.i AS src, y.i AS dst, CAST(count(*) AS INT) AS weight FROM l x JOIN l y ON x.e = y.e AND x.i <> y.i GROUP BY ALL HAVING count(*) >= 3),")


def _tiers_and_brands(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type").isin("Tier", "Brand"))


@query(f"WITH {_ALL_SIMILAR} SELECT src, dst, 'SIMILAR_TO' AS predicate, weight FROM sim")
def kg_similar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIMILAR_TO both ways between all items that share three tiers or brands."""
    pairs = graph.similar_pairs(_tiers_and_brands(_entity_edges(spark, sf_dir)), "src", "dst", bucket_max=None)
    return graph.similar_edges(pairs).select("src", "dst", "predicate", "weight")


@query(_sql_walks(_ALL_SIMILAR, "SELECT p_partkey AS query_id, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 20 = 0", 1, 8, "0.0005", 5))
def kg_similar_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for every twentieth item, one hop around it, along its entities and the items like it."""
    edges = cut(_entity_edges(spark, sf_dir).filter("type <> 'Chunk'").select("src", "dst", "type", F.lit(1).alias("weight")))
    classes = cut(graph.classes_of(_tiers_and_brands(edges), "src", "dst"))
    pairs = graph.similar_classes(cut(classes.select("es").distinct()))
    seeds = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").cast("string").alias("id"))
    return _top(walks.ranks_alike(edges, classes, pairs, seeds, least=5e-4, most=8), 5)


# ------------------------------------------------------------------------------------------------- a graph brought up to date

_NOW = """(SELECT p_partkey, CASE WHEN p_partkey % 50 = 3 THEN 'small widget' ELSE p_name END AS p_name, CASE WHEN p_partkey % 50 = 4 THEN 'Brand#1' ELSE p_brand END AS p_brand, p_type, p_size, p_retailprice
          FROM part WHERE p_partkey % 50 <> 5)"""
_NOW_EDGES = _EDGES.replace("FROM part)", f"FROM {_NOW})")
_NOW_SIMILAR = _SIMILAR.replace(_EDGES, _NOW_EDGES)


@query(f"""WITH {_NOW_SIMILAR} SELECT 'edge' AS part, src AS a, dst AS b, predicate AS told FROM ({_NOW_EDGES})
           UNION ALL SELECT 'node', CAST(p_partkey AS VARCHAR), 'Laptop', p_name FROM {_NOW} UNION ALL SELECT DISTINCT 'node', dst, type, '' FROM ({_NOW_EDGES})
           UNION ALL SELECT 'pair', src, dst, CAST(weight AS VARCHAR) FROM sim WHERE src < dst""")
def kg_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph after some items were renamed, given another brand or dropped: only what they touch is written."""
    all_items, path = _items(spark, sf_dir), fresh_folder(spark, "reindexed")
    edges = _entity_edges(spark, sf_dir)
    pairs = graph.similar_pairs(edges.filter(F.col("type").isin("Tier", "Brand")), "src", "dst", bucket_max=_BUCKET)
    kind = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    nodes = graph.nodes_of(all_items, edges)
    stored = keyed.Keyed(spark, f"{path}/edges", ["item_id", "seq"], kind(edges), 16, by=["item_id"])
    stored_nodes = keyed.Keyed(spark, f"{path}/nodes", ["id"], kind(nodes), 16)
    stored_pairs = keyed.Keyed(spark, f"{path}/pairs", ["a", "b"], kind(pairs), 16, by=["a"])
    for t, rows in ((stored, edges), (stored_nodes, nodes), (stored_pairs, pairs)):
        t.upsert(rows)

    key = F.col("p_partkey")
    now = parts(spark, sf_dir).filter((key % 50).isin(3, 4)).drop("description")
    now = now.withColumn("p_name", F.when(key % 50 == 3, "small widget").otherwise(F.col("p_name")))
    now = described(now.withColumn("p_brand", F.when(key % 50 == 4, "Brand#1").otherwise(F.col("p_brand"))))
    new = _as_items(catalog.with_tiers(now, "description", KEYWORDS))
    gone = all_items.filter("pos % 50 = 5").select("id")
    own = graph.item_edges(new, DIMS, BRANDS, CASES, SPECS)
    found = reindex.change(all_items, stored.read(), stored_pairs.read(), new, own, gone, bucket_max=_BUCKET)
    old = stored.read().join(found.items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    stored.change(found.edges, old.select("item_id", "seq"))
    stored_nodes.change(found.nodes, found.touched)
    stored_pairs.change(found.pairs, found.pairs_gone)

    none = F.lit("")
    as_rows = lambda df, part, *c: df.select(F.lit(part).alias("part"), *[x.cast("string").alias(n) for x, n in zip(c, ("a", "b", "told"))])
    label = F.when(F.col("type") == "Laptop", F.col("name")).otherwise(none)
    out = as_rows(stored.read(), "edge", F.col("src"), F.col("dst"), F.col("predicate"))
    out = out.unionByName(as_rows(stored_nodes.read(), "node", F.col("id"), F.col("type"), label))
    return out.unionByName(as_rows(stored_pairs.read(), "pair", F.col("a"), F.col("b"), F.col("overlap")))
