"""Registered queries: retrieval, scoring, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text, vectors
from tarnfell.operators import catalog, hooks, retrieval
from tarnfell.plans.registry import query
from tarnfell.plans.shared import DIMS, KEYWORDS, SQL_INDEX, SQL_TIERED, parts, sql_any, table, tiered

ASKED = "the der les of and"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\t-\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '')"
_TERMS = ", ".join(f"'{w}'" for w in sorted(set(ASKED.split())))


def _sql_bm25(keep: str, k: int) -> str:
    return f"""
        SELECT doc_id, score FROM (
          WITH d AS (SELECT doc_id, n_chars, {_WORDS} AS w FROM documents),
          n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
          tf AS (SELECT doc_id, n_chars, len(w) AS dl, q.term, len(list_filter(w, lambda x: x = q.term)) AS f FROM d, (SELECT unnest([{_TERMS}]) AS term) q),
          df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term)
          SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM tf JOIN df USING (term), n WHERE f > 0 AND {keep} GROUP BY doc_id)
        ORDER BY score DESC, doc_id LIMIT {k}"""


def _bm25(spark: SparkSession, sf_dir: str, keep=None, k: int = 10) -> DataFrame:
    found = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ASKED, None, keep)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(k)


@query(_sql_bm25("true", 10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(_sql_bm25("n_chars <= 2000", 10))
def bm25_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, F.col("n_chars") <= 2000)


#: A fixed query vector of the width of the embeddings.
VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[])"
_DENSE = f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id"


def _dense(spark: SparkSession, sf_dir: str, k: int = 10, keep=None, over: int = 10) -> DataFrame:
    return retrieval.dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR, k, keep, over)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE} LIMIT 10)")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM (SELECT vec_id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50) WHERE label <= 2 ORDER BY score DESC, vec_id LIMIT 5)")
def dense_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 5, F.col("label") <= 2).withColumn("score", F.round("score", 6))


def _sql_fused(k: int) -> str:
    return f"""
        SELECT doc_id, rrf_score, CAST(row_number() OVER (ORDER BY rrf_score DESC, seen) AS INT) AS rank FROM (
          WITH d AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_DENSE} LIMIT 20)),
          s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_sql_bm25('true', 20)})),
          b AS (SELECT doc_id, r, r AS seen FROM d UNION ALL SELECT doc_id, r, 1000 + r FROM s)
          SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS rrf_score, min(seen) AS seen FROM b GROUP BY doc_id)
        ORDER BY rank LIMIT {k}"""


@query(f"SELECT doc_id, rrf_score FROM ({_sql_fused(1000)})")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [
        retrieval.ranked(_dense(spark, sf_dir, 20).withColumnRenamed("vec_id", "doc_id"), "doc_id"),
        retrieval.ranked(_bm25(spark, sf_dir, k=20), "doc_id"),
    ]
    return retrieval.fuse(hits, "doc_id").select("doc_id", F.round("rrf_score", 8).alias("rrf_score"))


@query(_sql_fused(10))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid(_dense(spark, sf_dir, 20).withColumnRenamed("vec_id", "doc_id"), _bm25(spark, sf_dir, k=20), "doc_id", 10)
    return hits.select("doc_id", F.round("rrf_score", 8).alias("rrf_score"), "rank")


# ------------------------------------------------------------------------------------------------- tiers and scoring

WANTED = {"f1": "high", "f2": "medium", "f3": "high", "f4": "medium", "f5": "low"}
_MATCHES = " + ".join(f"CAST({SQL_INDEX.format(f)} >= {rules.TIERS.index(t)} AS INT)" for f, t in WANTED.items())
_SCORED = f"(SELECT p_partkey, p_name, p_retailprice, {_MATCHES} AS match_score FROM {SQL_TIERED} WHERE p_retailprice <= 950)"


@query(f"SELECT p_partkey, {', '.join(DIMS)} FROM {SQL_TIERED}")
def feature_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).select("p_partkey", *DIMS)


@query(f"SELECT p_partkey, p_name, match_score FROM {_SCORED} ORDER BY match_score DESC, 1.0 / (60 + p_partkey) DESC, p_partkey LIMIT 3")
def score_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiered(spark, sf_dir).withColumn("rrf", 1.0 / (60 + F.col("p_partkey")))
    return retrieval.score_and_rank(
        rows,
        DIMS,
        WANTED,
        F.lit(950),
        "p_retailprice",
        "rrf",
        "p_partkey",
    ).select("p_partkey", "p_name", "match_score")


@query(f"""SELECT p_partkey, match_score FROM (SELECT *, row_number() OVER (ORDER BY match_score DESC, p_partkey) AS rn, max(match_score) OVER () AS top
           FROM {_SCORED}) WHERE match_score >= 2 OR (top < 2 AND rn = 1)
           UNION ALL SELECT -p_partkey, match_score FROM {_SCORED} WHERE p_partkey = (SELECT p_partkey FROM {_SCORED} ORDER BY match_score DESC, p_partkey LIMIT 1)""")
def validate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates within the budget; and, with its key negated, what is left where none is good enough."""
    rows = tiered(spark, sf_dir).filter(F.col("p_retailprice") <= 950).withColumn(
        "match_score",
        retrieval.match_count(DIMS, WANTED),
    ).select("p_partkey", "match_score")
    order = [F.desc("match_score"), F.col("p_partkey")]
    none = retrieval.validated(rows, "match_score", order, len(WANTED) + 1)
    return retrieval.validated(rows, "match_score", order).unionByName(none.withColumn("p_partkey", -F.col("p_partkey")))


@query(f"SELECT p_partkey FROM {_SCORED} WHERE match_score = 5")
def relevance_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiered(spark, sf_dir).filter(F.col("p_retailprice") <= 950)
    return rows.filter(retrieval.match_count(DIMS, WANTED) == len(WANTED)).select("p_partkey")


@query(f"""SELECT p_brand AS method, count(*) AS n, round(avg(CAST(m = 5 AND p_retailprice <= 950 AS INT)), 6) AS strict, round(avg(CAST(m >= 3 AS INT)), 6) AS relaxed
           FROM (SELECT *, {_MATCHES} AS m FROM {SQL_TIERED}) GROUP BY p_brand""")
def search_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiered(spark, sf_dir).withColumn("m", retrieval.match_count(DIMS, WANTED))
    found = retrieval.precision(rows, "p_brand", (F.col("m") == 5) & (F.col("p_retailprice") <= 950), F.col("m") >= 3)
    return found.select(F.col("p_brand").alias("method"), "n", F.round("strict", 6).alias("strict"), F.round("relaxed", 6).alias("relaxed"))


# ----------------------------------------------------------------------------------------------------------- text

_CLAUSES = "list_filter(list_transform(regexp_split_to_array(text, '[.,;]\\s*'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
TOPICS = {"Articles": ["the", "der", "les"], "Joins": ["and", "und", " et "], "Places": ["in", "dans"]}
_TOPIC = "CASE " + " ".join(f"WHEN {sql_any('lower(s)', k)} THEN '{t}'" for t, k in TOPICS.items()) + " ELSE 'General' END"
_TOPIC_CHUNKS = ", ".join(
    f"CASE WHEN len(list_filter(c, lambda s: {_TOPIC} = '{t}')) > 0 THEN '{t} info: ' || array_to_string(list_filter(c, lambda s: {_TOPIC} = '{t}'), '. ') END" for t in [*TOPICS, "General"]
)


@query(f"""SELECT doc_id, CAST(generate_subscripts(ch, 1) - 1 AS INT) AS chunk_index, unnest(ch) AS chunk FROM (
           SELECT doc_id, list_concat(list_filter([{_TOPIC_CHUNKS}], lambda x: x IS NOT NULL), [text]) AS ch FROM (SELECT doc_id, text, {_CLAUSES} AS c FROM documents))""")
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.posexplode(text.topic_chunks(F.col("text"), TOPICS)).alias("chunk_index", "chunk"),
    )


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:12] AS p FROM documents),
          e AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS ord, unnest(p) AS sentence FROM s)
          SELECT doc_id, ord, sentence, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS next_ord FROM e""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("ord", "sentence"))
    return rows.withColumn("next_ord", F.lead("ord").over(W.partitionBy("doc_id").orderBy("ord")))


@query()
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.char_chunks()(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk"))


@query("""SELECT p_partkey, 'CATEGORY: parts' || chr(10) || coalesce('p_name: ' || p_name || chr(10), '') || coalesce('p_brand: ' || p_brand || chr(10), '') || coalesce('p_size: ' || p_size || chr(10), '') AS text FROM part""")
def row_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.row_to_text(table(spark, sf_dir, "part"), F.lit("parts"), ["p_name", "p_brand", "p_size"]).select("p_partkey", "text")


@query("""SELECT doc_id, list_transform(v, lambda x: round(x, 6)) AS v FROM (
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
            b AS (SELECT doc_id, CAST('0x' || right(md5(t), 2) AS INT) AS b FROM t),
            c AS (SELECT doc_id, b % 64 AS i, sum(CASE WHEN (b // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM b GROUP BY ALL),
            n AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM c GROUP BY doc_id),
            g AS (SELECT doc_id, i, coalesce(s, 0) / CASE WHEN coalesce(n, 0) > 0 THEN n ELSE 1 END AS x FROM (SELECT doc_id, unnest(range(64)) AS i FROM documents) LEFT JOIN c USING (doc_id, i) LEFT JOIN n USING (doc_id))
            SELECT doc_id, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM g GROUP BY doc_id)""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.hash_embed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("v"))


_ASK = "'I need a laptop with High GPU intensity, ' || CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'odd' END || ' display quality, low portability, medium multitasking, high processing speed and a budget of ' || CAST(50 + p_size AS VARCHAR) || ',000'"
_TIERS_SQL = ", ".join(
    f"nullif(lower(regexp_extract(q, '(?i)(low|medium|high)\\s+{d.lower()}', 1)), '') AS t{i}" for i, d in enumerate(rules.DIMENSIONS)
)


@query(f"""SELECT p_partkey, CASE WHEN t0 || t1 || t2 || t3 || t4 IS NOT NULL THEN t1 END AS display, CASE WHEN t0 || t1 || t2 || t3 || t4 IS NOT NULL THEN CAST(b AS DOUBLE) END AS budget,
              'I need a laptop with high GPU intensity, ' || d || ' display quality, low portability, medium multitasking, high processing speed and a budget of ' || b || '.' AS sentence
           FROM (SELECT p_partkey, {_TIERS_SQL}, CAST(50 + p_size AS VARCHAR) || '000' AS b, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'odd' END AS d FROM (SELECT p_partkey, p_size, {_ASK} AS q FROM part))""")
def requirement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("p_size") % 3 == 0, "low").when(F.col("p_size") % 3 == 1, "medium").otherwise("odd")
    ask = F.concat(
        F.lit("I need a laptop with High GPU intensity, "),
        level,
        F.lit(" display quality, low portability, medium multitasking, high processing speed and a budget of "),
        (F.col("p_size") + 50).cast("string"),
        F.lit(",000"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", ask.alias("q"))
    r = text.requirements(F.col("q"))
    return rows.select(
        "p_partkey",
        r["tiers"]["Display quality"].alias("display"),
        r["budget"].alias("budget"),
        text.requirement_sentence(F.col("q")).alias("sentence"),
    )


_NOISY = "CASE conv_id % 3 WHEN 0 THEN 'Thinking... so' || chr(10) || '...done thinking. Alright, ' || text WHEN 1 THEN '<think>hm' || chr(10) || '</think>I''ll say: ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end' ELSE text || ' <think>cut off' END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_NOISY} AS t FROM conversations),
           b AS (SELECT conv_id, turn, CASE WHEN contains(t, 'Thinking...') AND contains(t, '...done thinking.') THEN regexp_replace(string_split(t, '...done thinking.')[-1], '^\\s+|\\s+$', '', 'g') ELSE t END AS t FROM a),
           c AS (SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(t, 'Thinking...', ''), '...done thinking.', ''), 'Alright,', ''), 'I''ll', 'I will'), '^\\s+|\\s+$', '', 'g') AS t FROM b)
           SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM c""")
def response_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("conv_id") % 3
    noisy = F.when(k == 0, F.concat(F.lit("Thinking... so\n...done thinking. Alright, "), t)).when(
        k == 1,
        F.concat(F.lit("<think>hm\n</think>I'll say: "), t, F.lit("\n\n\n\nend")),
    ).otherwise(F.concat(t, F.lit(" <think>cut off")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_response(noisy).alias("clean"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n_items FROM events""")
def json_array_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit("Sure:\n["), F.col("props"), F.lit(","), F.col("props"), F.lit("] done")),
    ).otherwise("nothing [ broken")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.size(text.json_array(answer, "struct<k:bigint>")).alias("n_items"),
    )


@query("""SELECT conv_id, array_to_string(list_concat(list_filter([max_by(text, turn) FILTER (role = 'system')], lambda x: x IS NOT NULL),
             coalesce(list(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text ORDER BY turn, role, text) FILTER (role IN ('user', 'assistant')), [])), chr(10) || chr(10)) AS transcript
          FROM conversations GROUP BY conv_id""")
def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("m"))
    return rows.select("conv_id", text.transcript(F.col("m")).alias("transcript"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop offers for parts: supplied part lines stand for them, in the order of their keys."""
    p = parts(spark, sf_dir).select("p_partkey", F.concat("p_name", F.lit(" (spec / 16GB)")).alias("name"), "p_retailprice")
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("offer"),
        (F.col("l_suppkey") % 3).alias("kind"),
    )
    return p.join(li, p.p_partkey == li.l_partkey)


@query("""WITH c AS (SELECT p_partkey, p_name || ' (spec / 16GB)' AS name, p_retailprice, l_extendedprice / l_quantity AS offer, l_suppkey % 3 AS kind, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey),
          r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber, offer) AS pos FROM c),
          t AS (SELECT *, CASE kind WHEN 0 THEN regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '') ELSE 'other thing' END AS title FROM r WHERE pos <= 5),
          f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS n FROM t WHERE kind = 0 AND offer / p_retailprice BETWEEN 0.4 AND 2.5)
          SELECT p_partkey, CAST(pos AS INT) AS pos, round(offer, 6) AS offer FROM f WHERE n = 1""")
def live_price_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    rows = rows.withColumn(
        "pos",
        F.row_number().over(W.partitionBy("p_partkey").orderBy("l_orderkey", "l_linenumber", "offer")),
    ).filter("pos <= 5")
    bare = text.bare_name(F.col("name"))
    rows = rows.withColumn("title", F.when(F.col("kind") == 0, bare).otherwise("other thing"))
    fit = rows.filter(text.title_matches(bare, F.col("title")) & (F.col("offer") / F.col("p_retailprice")).between(0.4, 2.5))
    return catalog.first_by(fit, ["p_partkey"], [F.col("pos")]).select("p_partkey", "pos", F.round("offer", 6).alias("offer"))


@query("""WITH p AS (SELECT p_partkey, p_name AS name, p_size * 1000.0::DOUBLE AS price, 1 AS n FROM part UNION ALL SELECT p_partkey, p_brand, p_size, 2 FROM part)
          SELECT p_partkey, name, price, CASE n WHEN 1 THEN 'Name: ' || name || ', fine' ELSE 'about ' || name END AS context FROM p""")
def answer_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    answer = F.concat(
        F.lit("## Top\n\n1. **"),
        "p_name",
        F.lit("** — ₹"),
        size,
        F.lit(",000\n2. **"),
        "p_brand",
        F.lit("** - "),
        size,
        F.lit("\nno pick"),
    )
    contexts = F.array(F.concat(F.lit("about "), "p_brand"), F.concat(F.lit("Name: "), "p_name", F.lit(", fine")))
    rows = table(spark, sf_dir, "part").select("p_partkey", contexts.alias("contexts"), F.explode(text.picks(answer)).alias("p"))
    return rows.select("p_partkey", "p.name", "p.price", text.context_of(F.col("p.name"), F.col("contexts")).alias("context"))


@query("""SELECT p_partkey, CAST(p_size * 1000 AS BIGINT) AS digits, p_name AS bare, p_size % 2 = 0 AS matches FROM part""")
def offer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("New "), F.upper("p_name"))).otherwise("zzz")
    return p.select(
        "p_partkey",
        text.price_digits(F.concat(F.lit("Rs. "), F.col("p_size").cast("string"), F.lit(",000"))).alias("digits"),
        text.bare_name(F.concat("p_name", F.lit(" (9th gen/ 16GB)"))).alias("bare"),
        text.title_matches(F.col("p_name"), title).alias("matches"),
    )


# ------------------------------------------------------------------------------------------------- the whole search

_REQUEST, _IMAGINED = "a small red widget of brand#7", "red widget brand#7 promo"
_HALF = """SELECT id, b % 64 AS i, sum(CASE WHEN (b // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM (SELECT id, CAST('0x' || right(md5(t), 2) AS INT) AS b FROM (SELECT id, unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) AS t FROM {1})) GROUP BY ALL"""
_UNIT = "SELECT id, i, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS x FROM ({0})"
_ASKED_WORDS = ", ".join(f"'{w}'" for w in sorted(set(f"{_IMAGINED} {_REQUEST}".split())))
_PIPELINE = f"""
    WITH p AS (SELECT p_partkey AS id, p_retailprice, description AS txt FROM {SQL_TIERED}),
    q AS (SELECT unnest([1, 2]) AS id, unnest(['{_IMAGINED}', '{_REQUEST}']) AS txt),
    pv AS ({_UNIT.format(_HALF.format('txt', 'p'))}), qv AS ({_UNIT.format(_HALF.format('txt', 'q'))}),
    b AS (SELECT i, sum(x) / 2 AS x FROM qv GROUP BY i), nb AS (SELECT sqrt(sum(x * x)) AS n FROM b),
    dd AS (SELECT pv.id, round(sum(pv.x * b.x) / any_value(n), 10) AS score FROM pv JOIN b USING (i), nb GROUP BY pv.id),
    dz AS (SELECT p.id, p_retailprice, coalesce(score, 0) AS score FROM p LEFT JOIN dd USING (id) ORDER BY score DESC, p.id LIMIT 100),
    dr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM dz WHERE p_retailprice <= 950 ORDER BY r LIMIT 10),
    d AS (SELECT id, p_retailprice, list_filter(regexp_split_to_array(lower(txt), '\\s+'), lambda w: w <> '') AS w FROM p), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    tf AS (SELECT id, p_retailprice, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term)) AS f FROM d, (SELECT unnest([{_ASKED_WORDS}]) AS term) t),
    df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term),
    bm AS (SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 10) AS score FROM tf JOIN df USING (term), n WHERE f > 0 AND p_retailprice <= 950 GROUP BY id),
    sr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY r LIMIT 10),
    u AS (SELECT id, r, r AS seen FROM dr UNION ALL SELECT id, r, 1000 + r FROM sr),
    f AS (SELECT id, round(sum(1.0 / (60 + r)), 8) AS rrf_score, min(seen) AS seen FROM u GROUP BY id)
    SELECT id AS p_partkey, rrf_score, CAST(row_number() OVER (ORDER BY rrf_score DESC, seen) AS INT) AS rank FROM f ORDER BY rank LIMIT 10"""


@query(_PIPELINE)
def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a request to a ranking, with an imagined answer, blended vectors, both searches and a budget."""
    rows = parts(spark, sf_dir).withColumn("v", vectors.hash_embed(F.col("description")))
    found = retrieval.hybrid_pipeline(
        rows,
        "p_partkey",
        "description",
        "v",
        64,
        _REQUEST,
        lambda q: _IMAGINED,
        vectors.hash_embed,
        F.col("p_retailprice") <= 950,
    )
    return found.select("p_partkey", F.round("rrf_score", 8).alias("rrf_score"), "rank")


@query(f"""SELECT p_brand AS winner, strict FROM (SELECT p_brand, round(avg(CAST(m = 5 AND p_retailprice <= 950 AS INT)), 6) AS strict FROM (SELECT *, {_MATCHES} AS m FROM {SQL_TIERED}) GROUP BY p_brand)
           WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') ORDER BY strict DESC, CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END LIMIT 1""")
def search_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.winner(search_precision(spark, sf_dir), "method", "strict", ["Brand#3", "Brand#1", "Brand#2"])


@query(f"""WITH a AS (SELECT p_partkey, p_name || ' ' || p_type AS q, CASE WHEN p_size % 10 <> 0 THEN description ELSE ' ' END AS d FROM {SQL_TIERED}),
           u AS (SELECT DISTINCT q, d FROM a WHERE trim(d) <> ''), k AS (SELECT row_number() OVER () AS id, q, d FROM u), q AS (SELECT id, q AS txt FROM k), d AS (SELECT id, d AS txt FROM k),
           qv AS ({_UNIT.format(_HALF.format('txt', 'q'))}), dv AS ({_UNIT.format(_HALF.format('txt', 'd'))}),
           c AS (SELECT id, sum(qv.x * dv.x) AS c FROM qv JOIN dv USING (id, i) GROUP BY id)
           SELECT p_partkey, CASE WHEN k.id IS NOT NULL THEN round(greatest(0, least(1, (coalesce(c, 0) + 1) / 2)), 3) END AS answer_relevancy FROM a LEFT JOIN k USING (q, d) LEFT JOIN c USING (id)""")
def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_type").alias("q"),
        F.when(F.col("p_size") % 10 != 0, F.col("description")).otherwise(" ").alias("d"),
    )
    return hooks.answer_relevancy(rows, "q", "d").select("p_partkey", "answer_relevancy")
