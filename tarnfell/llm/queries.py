"""The registered queries of the subpackage: name -> (query, oracle SQL or None)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.llm import audit, bpe, hmm, licenses, mixing, pii, pstable, simhash, threshold, tokencount, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_threshold_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def capture_days(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: page n counts as fetched on day n mod 365 of 2024."""
    return pages.select(
        "page_id",
        "url",
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetch_day"),
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the hosts that occur and the domains above them, dated by a hash of the name.

    A quarter of the names is on it: put on the list, taken off after 90 days and put on it again 60 days later.
    """
    names = pages.select(F.explode(urlfilter.suffixes(urlfilter.host(F.col("url")))).alias("pattern")).distinct()
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("pattern").cast("binary")), k, 1)) - 1
    marked = names.withColumn("first", digit(1)).filter("first < 4").withColumn(
        "dated",
        F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 10 + digit(3)),
    )
    events = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(n).alias("after")) for a, n in (("add", 0), ("remove", 90), ("add", 150))])
    return marked.select("pattern", "dated", F.explode(events).alias("e")).select(
        "pattern",
        "e.action",
        F.date_add("dated", F.col("e.after")).alias("dated"),
    )


def op5_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urlfilter.evaluate(capture_days(pages), dated_list(pages))
    return found.select("page_id", "host", "fetch_day", "blocked", "pattern", "since")


def op6_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_hidden_markov,
        op2_byte_bpe,
        op3_threshold_algorithm,
        op4_entropy_balancing,
        op5_temporal_list_join,
        op6_simhash_bk_tree,
        op7_diagonal_voting,
        op8_weak_supervision_pii,
        op9_p_stable,
        op10_toxicity_nnpu,
        op11_token_counts,
        op12_filter_interactions,
    )
}



def _license_sql() -> str:
    """Every pair of words against every template's, diagonals, spans, and the longest chain of each by growing all chains."""
    templates = [
        *((p, label, True) for p, label in licenses.PHRASES.items()),
        *((t, label, False) for label, ts in licenses.TEMPLATES.items() for t in ts),
    ]
    rows = []
    for number, (text, label, phrase) in enumerate(templates):
        w = text.split()
        n = len(w) - 1
        needed = n if phrase else math.ceil(licenses.SHARE * n - 1e-9)
        rows += [f"('{a}', '{b}', {number}, '{label}', {phrase}, {i}, {n}, {needed}, {n + licenses.SLACK * (n - needed)})" for i, (a, b) in enumerate(zip(w, w[1:]))]
    return f"""
        WITH RECURSIVE t(a, b, template, label, phrase, place, pairs, needed, width) AS (VALUES {', '.join(rows)}),
        d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses._UPPER}', '{licenses._LOWER}'), '{licenses.WORD}') AS w FROM documents),
        g AS (SELECT doc, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS a FROM d),
        p AS (SELECT doc, pos, a, lead(a) OVER (PARTITION BY doc ORDER BY pos) AS b FROM g),
        h AS (SELECT doc, pos, template, label, phrase, place, pairs, needed, width, pos - place AS diagonal FROM p JOIN t USING (a, b)),
        x AS (SELECT DISTINCT doc, template, phrase, diagonal FROM h),
        y AS (SELECT *, CASE WHEN NOT phrase AND diagonal - lag(diagonal) OVER (PARTITION BY doc, template ORDER BY diagonal) <= {licenses.SLACK} THEN 0 ELSE 1 END AS apart FROM x),
        z AS (SELECT *, sum(apart) OVER (PARTITION BY doc, template ORDER BY diagonal) AS span FROM y),
        s AS (SELECT h.*, z.span FROM h JOIN z USING (doc, template, diagonal)),
        c(doc, template, span, began, pos, place, n) AS (
          SELECT doc, template, span, pos, pos, place, 1 FROM s WHERE NOT phrase
          UNION SELECT c.doc, c.template, c.span, c.began, s.pos, s.place, c.n + 1 FROM c JOIN s ON s.doc = c.doc AND s.template = c.template AND s.span = c.span AND s.pos > c.pos AND s.place > c.place AND s.pos - c.began < s.width),
        m AS (SELECT doc, template, max(n) AS chain FROM c GROUP BY doc, template),
        k AS (SELECT DISTINCT template, label, pairs, needed FROM t),
        more AS (SELECT doc, list(label) FILTER (chain >= needed) AS labels, max(chain / pairs) AS part FROM m JOIN k USING (template) GROUP BY doc),
        base AS (SELECT doc, label, diagonal FROM h WHERE phrase GROUP BY doc, template, label, diagonal, pairs HAVING count(*) = pairs),
        found AS (SELECT doc, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(label) AS labels FROM base GROUP BY doc)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               array_to_string(list_sort(list_distinct(coalesce(found.labels, []))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(found.labels, []), coalesce(more.labels, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0) END AS score
        FROM d LEFT JOIN found USING (doc) LEFT JOIN more USING (doc)"""


ORACLES: dict[str, str] = {
    "op12_filter_interactions": """
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                      regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
        s AS (SELECT filter_order, step, filter_order[step] AS letter, list_transform(string_split(filter_order, ''), lambda x: instr('ABCDE', x)) AS places
              FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
        c AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[places[step]] AS here, list_bool_or(list_transform(places[:step - 1], lambda p: fails[p])) AS gone,
                     list_sum(list_transform(fails, lambda x: CAST(x AS INT))) AS n_fails FROM g, s),
        r AS (SELECT part, filter_order, step, letter,
                     coalesce(sum(n) FILTER (NOT here AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT coalesce(gone, false)), 0) AS removed,
                     coalesce(sum(n) FILTER (here AND coalesce(gone, false)), 0) AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
                     coalesce(sum(n) FILTER (here AND NOT coalesce(gone, false) AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT coalesce(gone, false) AND toxic), 0) AS toxic_lost
              FROM c GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM r
    """,
    "op7_diagonal_voting": _license_sql(),
    "op3_threshold_algorithm": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_temporal_list_join": """
        WITH hosts AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '') AS host,
                              CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS DATE) AS fetch_day FROM pages),
        parts AS (SELECT *, string_split(host, '.') AS l FROM hosts WHERE host IS NOT NULL),
        keys AS (SELECT page_id, fetch_day, unnest(CASE WHEN len(l) < 2 THEN [host]
                        ELSE list_transform(range(0, len(l) - 1), lambda i: array_to_string(l[i + 1:], '.')) END) AS pattern FROM parts),
        named AS (SELECT DISTINCT pattern, md5(pattern) AS h FROM keys),
        marked AS (SELECT pattern, CAST(DATE '2024-01-01' + CAST((instr('0123456789abcdef', h[2]) - 1) * 10 + instr('0123456789abcdef', h[3]) - 1 AS INT) AS DATE) AS d
                   FROM named WHERE instr('0123456789abcdef', h[1]) - 1 < 4),
        active AS (SELECT pattern, d AS valid_from, CAST(d + 90 AS DATE) AS valid_to FROM marked UNION ALL SELECT pattern, CAST(d + 150 AS DATE), NULL FROM marked),
        met AS (SELECT page_id, pattern, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS n
                FROM keys JOIN active USING (pattern) WHERE fetch_day >= valid_from AND (valid_to IS NULL OR fetch_day < valid_to))
        SELECT page_id, host, fetch_day, m.pattern IS NOT NULL AS blocked, m.pattern, m.valid_from AS since
        FROM hosts LEFT JOIN (SELECT page_id, pattern, valid_from FROM met WHERE n = 1) m USING (page_id)
    """,
    "op9_p_stable": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
        r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
        c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
}
