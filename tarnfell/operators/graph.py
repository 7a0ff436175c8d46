"""Knowledge graphs as two DataFrames: nodes (id, type, name, feature, tier, price, text, ord, item_id, seq) and edges
(src, dst, predicate, weight, seq).  Edges are a bag: two of the same kind are two.  ``seq`` orders what ties; graphs
that are made of items have (the item's place, the edge's place within it), however many edges an item has."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text, vectors
from tarnfell.operators.lineage import cut, merged, spread


def _seq(pos: Column, at: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), at.cast("long").alias("at"))


def item_edges(
    items: DataFrame,
    features: Sequence[str],
    brands: Sequence[str] = tuple(rules.BRANDS),
    cases: Mapping[str, Sequence[str]] = rules.USE_CASES,
    specs: Mapping[str, str] = rules.SPECS,
    bands: Sequence[tuple[str, float]] = rules.PRICE_BANDS,
) -> DataFrame:
    """All edges of items (id: string, pos: long, name, description, price, one column a feature) but SIMILAR_TO.

    One pass: each item makes an array of its edges with the entities they lead to, and the array is exploded.  Items are
    spread first, as a small file of them makes a table many times its size.
    """
    none = F.lit(None).cast("string")

    def edge(
        dst: Column,
        predicate: Column,
        type_: Column,
        name: Column = none,
        feature: Column = none,
        tier: Column = none,
        body: Column = none,
        ord_: Column | None = None,
        src: Column | None = None,
    ) -> Column:
        return F.struct(
            (F.col("id") if src is None else src).alias("src"),
            dst.alias("dst"),
            predicate.alias("predicate"),
            type_.alias("type"),
            name.alias("name"),
            feature.alias("feature"),
            tier.alias("tier"),
            body.alias("text"),
            (F.lit(None) if ord_ is None else ord_).cast("int").alias("ord"),
        )

    tiers = F.array(
        *[
            F.when(
                F.col(f).isNotNull(),
                edge(F.concat(F.lit(f"{f}::"), F.col(f)), text.tier_predicate(F.lit(f)), F.lit("Tier"), feature=F.lit(f), tier=F.col(f)),
            )
            for f in features
        ]
    )
    brand, band = text.brand(F.col("description"), brands), text.price_band(F.col("price"), bands)
    fixed = F.array(
        edge(F.concat(F.lit("Brand::"), brand), F.lit("MADE_BY"), F.lit("Brand"), brand),
        edge(F.concat(F.lit("PriceBand::"), band), F.lit("IN_PRICE_BAND"), F.lit("PriceBand"), band),
    )
    uses = F.transform(
        text.use_cases(F.col("description"), cases),
        lambda u: edge(F.concat(F.lit("UseCase::"), u), F.lit("SUITED_FOR"), F.lit("UseCase"), u),
    )
    found = F.transform(
        text.spec_triplets(F.col("name"), F.col("description"), specs),
        lambda t: edge(
            F.concat(text.entity_type(t["predicate"]), F.lit("::"), text.normalise(t["value"])),
            t["predicate"],
            text.entity_type(t["predicate"]),
            t["value"],
        ),
    )
    chunk = lambda i: F.concat(F.col("id"), F.lit("::chunk::"), i.cast("string"))
    said = F.coalesce(text.sentences(F.col("description")), F.array().cast("array<string>"))
    has = F.transform(said, lambda s, i: edge(chunk(i), F.lit("HAS_CHUNK"), F.lit("Chunk"), body=s, ord_=i))
    follows = F.filter(
        F.transform(
            said,
            lambda s, i: F.when(i > 0, edge(chunk(i), F.lit("NEXT_CHUNK"), F.lit("Chunk"), body=s, ord_=i, src=chunk(i - 1))),
        ),
        lambda e: e.isNotNull(),
    )
    every = F.concat(F.filter(tiers, lambda e: e.isNotNull()), fixed, uses, found, has, follows)
    rows = spread(items, "id").select("id", "pos", F.posexplode(every).alias("at", "e"))
    return rows.select("e.*", F.col("id").alias("item_id"), _seq(F.col("pos"), F.col("at")).alias("seq"))


def edges_of(entity_edges: DataFrame) -> DataFrame:
    return entity_edges.select("src", "dst", "predicate", F.lit(1).alias("weight"), "seq")


def nodes_of(items: DataFrame, entity_edges: DataFrame) -> DataFrame:
    """Items and entities, each once; of several attributes of an entity the last one counts, of its place the first."""
    own = items.select(
        "id",
        F.lit("Laptop").alias("type"),
        "name",
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("string").alias("tier"),
        F.col("price").cast("double").alias("price"),
        F.col("description").alias("text"),
        F.lit(None).cast("int").alias("ord"),
        F.lit(None).cast("string").alias("item_id"),
        _seq(F.col("pos"), F.lit(-1)).alias("seq"),
    )
    attributes = ("type", "name", "feature", "tier", "text", "ord")
    chunk = F.col("type") == "Chunk"
    met = entity_edges.filter(F.col("predicate") != "NEXT_CHUNK").groupBy(F.col("dst").alias("id")).agg(
        F.max_by(F.struct(*attributes, F.when(chunk, F.col("item_id")).alias("item_id")), "seq").alias("a"),
        F.min("seq").alias("seq"),
    )
    entities = met.select(
        "id",
        "a.type",
        "a.name",
        "a.feature",
        "a.tier",
        F.lit(None).cast("double").alias("price"),
        "a.text",
        "a.ord",
        "a.item_id",
        "seq",
    )
    return own.unionByName(entities)


#: Items of a class that travel as one row, pairs of items that a task lists, and tasks at most (each lists row by row).
CHUNK, PAIRS, TASKS = 1024, 1 << 22, 4096
#: Parts into which items and classes that share an entity are dealt, so that a common one isn't one task's.
SALT = 8


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def _everywhere(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def classes_of(links: DataFrame, item: str, entity: str, least: int = 3) -> DataFrame:
    """(i, es): the items that have ``least`` entities, each with all of its own, sorted: items of one class have the same."""
    once = links.select(F.col(item).alias("i"), F.col(entity).alias("e")).filter("i IS NOT NULL AND e IS NOT NULL")
    return once.groupBy("i").agg(F.sort_array(F.collect_set("e")).alias("es")).filter(F.size("es") >= least)


def similar_classes(classes: DataFrame, least: int = 3) -> DataFrame:
    """(es, other, overlap) for classes (es, sorted entities) es <= other that share ``least`` entities, each with itself too.

    As items do in :func:`similar_pairs`, classes meet by their rare entities.
    """
    rare = classes.select("es", F.explode("es").alias("e"))
    rare = rare.join(rare.groupBy("e").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "e")
    ranked = rare.groupBy("es").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("rs"))
    posted = merged(ranked.select("es", "rs", F.posexplode(F.slice("rs", F.lit(1), F.size("rs") - (least - 1))).alias("at", "e")))
    x, y = _dealt(posted, "es").alias("x"), _everywhere(posted).alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.es") <= F.col("y.es")))
    before = lambda side: F.slice(F.col(f"{side}.rs"), F.lit(1), F.col(f"{side}.at"))
    first = met.filter(~F.arrays_overlap(before("x"), before("y")))
    pairs = first.select(F.col("x.es").alias("es"), F.col("y.es").alias("other"), F.size(F.array_intersect("x.es", "y.es")).cast("long").alias("overlap"))
    return pairs.filter(F.col("overlap") >= least)


def _all_similar_pairs(links: DataFrame, item: str, entity: str, least: int) -> DataFrame:
    """(a, b, overlap) whatever the number of an entity's items.

    Items with the same entities are one class, and classes meet instead of items.  The pairs are then listed chunk by chunk:
    of each class some ``CHUNK`` items are a row, which meets those of the classes like it.  What is held is two chunks.
    """
    own = merged(classes_of(links, item, entity, least))
    sizes = cut(own.groupBy("es").agg(F.count(F.lit(1)).alias("n")))
    alike = merged(similar_classes(sizes.select("es"), least))
    dealt = _dealt(own, "i").join(_everywhere(sizes), ["es", "salt"])
    no = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / CHUNK))
    chunks = cut(dealt.groupBy("es", no.alias("no")).agg(F.collect_list("i").alias("ids")))
    side = lambda es, no, ids: chunks.select(F.col("es").alias(es), F.col("no").alias(no), F.col("ids").alias(ids))
    many = alike.join(sizes, "es").join(sizes.select(F.col("es").alias("other"), F.col("n").alias("m")), "other")
    total = many.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    tasks = max(1, min(TASKS, int(total // PAIRS) + 1))
    # Dealt by all of a pair, which is what stays if the chunks are few and go to every task, and by the second chunk if not.
    numbered = alike.join(side("other", "m", "ids").drop("ids"), "other").repartition(tasks, "es", "other", "m")
    met = numbered.join(side("es", "no", "xs"), "es").filter((F.col("es") != F.col("other")) | (F.col("no") <= F.col("m")))
    met = met.join(side("other", "m", "ys").repartition(tasks, "other", "m"), ["other", "m"])
    same = (F.col("es") == F.col("other")) & (F.col("no") == F.col("m"))
    rows = met.select("xs", "ys", "overlap", same.alias("same")).select(F.explode("xs").alias("x"), "ys", "overlap", "same")
    rows = rows.select("x", F.explode("ys").alias("y"), "overlap", "same").filter(~F.col("same") | (F.col("x") < F.col("y")))
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def similar_pairs(links: DataFrame, item: str, entity: str, least: int = 3, bucket_max: int | None = 200) -> DataFrame:
    """(a, b, overlap) for items a < b that share ``least`` entities; an entity with more than ``bucket_max`` items
    links none (that is the definition), so no entity's pairs grow without bound.  With None every entity links.

    Two items that share ``least`` of their entities share one even if each leaves out its last ``least - 1``.  In order
    of rarity those are the commonest, so items meet by their rare entities only, and a pair is looked at where it meets
    first.  An item's own entities, as many as its row gave, travel with it.
    """
    if bucket_max is None:
        return _all_similar_pairs(links, item, entity, least)
    once = links.select(F.col(item).alias("i"), F.col(entity).alias("e")).filter("i IS NOT NULL AND e IS NOT NULL").distinct()
    rare = once.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, bucket_max))
    own = once.join(rare, "e").groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("es"))
    own = own.filter(F.size("es") >= least)
    posted = own.select("i", "es", F.posexplode(F.slice("es", F.lit(1), F.size("es") - (least - 1))).alias("at", "e"))
    x, y = posted.alias("x"), posted.alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.i") < F.col("y.i")))
    before = lambda side: F.slice(F.col(f"{side}.es"), F.lit(1), F.col(f"{side}.at"))
    first = met.filter(~F.arrays_overlap(before("x"), before("y")))
    pairs = first.select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.size(F.array_intersect("x.es", "y.es")).cast("long").alias("overlap"))
    return pairs.filter(F.col("overlap") >= least)


def similar_edges(pairs: DataFrame, after: int = (1 << 63) - 1) -> DataFrame:
    """SIMILAR_TO both ways, after all other edges."""
    rows = pairs.select(
        F.explode(
            F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
        ).alias("e"),
        "overlap",
    )
    return rows.select(
        "e.*",
        F.lit("SIMILAR_TO").alias("predicate"),
        F.col("overlap").cast("int").alias("weight"),
        _seq(F.lit(after), F.xxhash64("e.src", "e.dst")).alias("seq"),
    )


def khop(edges: DataFrame, seeds: DataFrame, hops: int = rules.HOPS) -> DataFrame:
    """(id, hop) of all nodes at ``hops`` or less from a seed (id), whatever an edge's direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        next_ = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        front = cut(next_.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges both ends of which are in ``ids`` (id)."""
    some = ids.select("id").distinct()
    return edges.join(some.withColumnRenamed("id", "src"), "src", "left_semi").join(some.withColumnRenamed("id", "dst"), "dst", "left_semi")


def pagerank(
    ids: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = 0.85,
    iterations: int = 100,
    tolerance: float | None = 1e-6,
    every: int = 5,
) -> DataFrame:
    """(id, rank): personalised PageRank over ``ids``; mass of nodes without edges goes where the walk starts.

    Seeds that aren't there don't count; without any the walk starts everywhere.  Stops at ``tolerance`` a node, if
    one is given, looked at every few iterations, when lineage is cut as well.
    """
    some = seeds.select("id").distinct().withColumn("s", F.lit(1.0))
    nodes = ids.select("id").distinct().join(some, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    n, mass = nodes.agg(F.count(F.lit(1)), F.sum("s")).first()
    if not n:
        return nodes.select("id", F.col("s").alias("rank"))
    start = F.col("s") / mass if mass else F.lit(1.0 / n)
    nodes = nodes.select("id", start.alias("p"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("w"))
    steps = cut(
        edges.groupBy("src", "dst").agg(F.sum("weight").alias("e")).join(out, "src").select(
            "src",
            "dst",
            (F.col("e") / F.col("w")).alias("share"),
        )
    )
    state = cut(
        nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("__has")), "id", "left").select(
            "id",
            "p",
            F.coalesce("__has", F.lit(True)).alias("dangling"),
            F.lit(1.0 / n).alias("rank"),
        )
    )
    before = state
    for i in range(1, iterations + 1):
        got = steps.join(
            state.select(F.col("id").alias("src"), "rank"),
            "src",
        ).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        lost = state.select(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost")).scalar()
        rank = damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p")) + (1 - damping) * F.col("p")
        state = state.drop("rank").join(got, "id", "left").select("id", "p", "dangling", rank.alias("rank"))
        if i % every == 0 or i == iterations:
            state = cut(state)
            if tolerance is not None:
                apart = state.select("id", "rank").join(
                    before.select("id", F.col("rank").alias("was")),
                    "id",
                ).agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
                if apart < every * n * tolerance:
                    break
            before = state
    return state.select("id", "rank")


def triplets(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, k: int | None = rules.TOP_TRIPLETS, digits: int = 6) -> DataFrame:
    """(subject, predicate, object, subject_id, object_id, score, seq): the k edges whose ends rank highest."""
    named = nodes.select(
        "id",
        text.node_label(F.col("id"), F.col("type"), F.col("name"), F.col("tier")).alias("label"),
    ).join(ranks, "id", "left").select("id", "label", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    s, o = named.select(
        F.col("id").alias("src"),
        F.col("label").alias("subject"),
        F.col("rank").alias("r1"),
    ), named.select(F.col("id").alias("dst"), F.col("label").alias("object"), F.col("rank").alias("r2"))
    rows = edges.join(s, "src").join(o, "dst").select(
        "subject",
        "predicate",
        "object",
        F.col("src").alias("subject_id"),
        F.col("dst").alias("object_id"),
        F.round((F.col("r1") + F.col("r2")) / 2, digits).alias("score"),
        "seq",
    )
    return rows if k is None else rows.orderBy(F.desc("score"), "seq").limit(k)


def mass_ranking(found: DataFrame, items: DataFrame, k: int = rules.TOP_ITEMS) -> DataFrame:
    """(id, mass): items (id) by the scores of the triplets that touch them."""
    ends = found.select(F.explode(F.array("subject_id", "object_id")).alias("id"), "score", "seq")
    return ends.join(items.select("id"), "id", "left_semi").groupBy("id").agg(
        F.sum("score").alias("mass"),
        F.min("seq").alias("first"),
    ).orderBy(F.desc("mass"), "first").limit(k).select("id", "mass")


def fuse_rankings(graph: DataFrame, vector: DataFrame, weight: float = 0.4, k: int = rules.RRF_K) -> DataFrame:
    """(id, score) from two rankings (id, rank from 0): a weighted sum of reciprocal ranks."""
    both = graph.select("id", F.col("rank").alias("g")).join(vector.select("id", F.col("rank").alias("v")), "id", "full_outer")
    part = lambda w, r: F.coalesce(w / (k + F.col(r) + 1), F.lit(0.0))
    return both.select("id", (part(F.lit(weight), "g") + part(F.lit(1 - weight), "v")).alias("score"))


def coverage(found: DataFrame, seeds: DataFrame, answer: str) -> DataFrame:
    """One row: how many triplets the answer mentions, how many seeds the triplets touch, their mean score."""
    low = F.lit(answer.lower())
    said = F.contains(low, F.lower("subject")) | F.contains(low, F.lower("object"))
    own = found.agg(F.avg(said.cast("double")).alias("c"), F.avg("score").alias("s"))
    touched = found.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    hit = seeds.select("id").distinct().join(
        touched.withColumn("t", F.lit(1.0)),
        "id",
        "left",
    ).agg(F.avg(F.coalesce("t", F.lit(0.0))).alias("r"))
    zero = F.lit(0.0)
    return own.crossJoin(hit).select(
        F.round(F.coalesce("c", zero), 3).alias("triplet_coverage"),
        F.round(F.when(F.col("c").isNull(), zero).otherwise(F.coalesce("r", zero)), 3).alias("seed_recall"),
        F.round(F.coalesce("s", zero), 6).alias("avg_path_score"),
    )


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): counts of node types and predicates."""
    count = lambda df, part, c: df.groupBy(F.coalesce(c, F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "node", "type").unionByName(count(edges, "edge", "predicate"))


def flat_search(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(id, label, score): the k nodes nearest to hashed words of the query; of those only what is above nought."""
    label = text.node_label(F.col("id"), F.col("type"), F.col("name"), F.col("tier"))
    rows = nodes.filter("type <> 'Chunk'").select(
        "id",
        label.alias("label"),
        "seq",
        vectors.hash_embed(F.concat_ws(" ", "type", label)).alias("v"),
    )
    scored = rows.withColumn("score", vectors.dot(F.col("v"), vectors.hash_embed(F.lit(query))))
    return scored.orderBy(F.desc(F.round("score", 9)), "seq").limit(k).filter("score > 0").select(
        "id",
        "label",
        F.round("score", 4).alias("score"),
    )


def literal_map(nodes: DataFrame, query: str) -> DataFrame:
    """(at, token, id): words and then pairs of words of the query that are a node's label or id, each node once."""
    tokens = text.terms(F.lit(query))
    spoken = nodes.sparkSession.range(1).select(F.posexplode(F.concat(tokens, text.bigrams(tokens))).alias("at", "token"))
    known = nodes.filter("type <> 'Chunk'")
    label = F.lower(text.node_label(F.col("id"), F.col("type"), F.col("name"), F.col("tier")))
    names = known.select(
        F.explode(
            F.array(F.struct(label.alias("token"), F.lit(0).alias("o")), F.struct(F.lower("id").alias("token"), F.lit(1).alias("o")))
        ).alias("n"),
        "id",
        "seq",
    ).groupBy("n.token").agg(F.min_by("id", F.struct("seq", "n.o")).alias("id"))
    return spoken.join(names, "token").groupBy("id").agg(F.min(F.struct("at", "token")).alias("f")).select("f.at", "f.token", "id")


def link_entities(
    nodes: DataFrame,
    tiers: Mapping[str, str],
    budget: float | None,
    brands: Sequence[str] = (),
    cases: Sequence[str] = (),
    bands: Sequence[tuple[str, float]] = rules.PRICE_BANDS,
) -> DataFrame:
    """(id, ord): existing nodes that stand for requirements, in the order tiers, price band, brands, use cases."""
    band = next((n for n, upper in bands if budget is not None and 0 <= budget < upper), "flagship")
    wanted = [
        *(f"{f}::{t}" for f, t in tiers.items()),
        *([f"PriceBand::{band}"] if budget is not None else []),
        *(f"Brand::{b.lower()}" for b in brands),
        *(f"UseCase::{c}" for c in cases),
    ]
    listed = nodes.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, dict.fromkeys(wanted)))).alias("ord", "id")
    ) if wanted else nodes.sparkSession.createDataFrame([], "ord int, id string")
    return listed.join(nodes.select("id"), "id", "left_semi").select("id", "ord")


def find_item(nodes: DataFrame, name: str) -> DataFrame:
    """The item of that name, else the first whose name has it in it."""
    low = F.lower(F.lit(name))
    rows = nodes.filter("type = 'Laptop'").withColumn("exact", F.lower("name") == low)
    return rows.filter(F.col("exact") | F.contains(F.lower("name"), low)).orderBy(F.desc("exact"), "seq").limit(1).drop("exact")


def find_items(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, ord) for each name that an item bears, else has in it; names that none has are left out."""
    if not names:
        return nodes.sparkSession.createDataFrame([], "id string, ord int")
    asked = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n.lower()).alias("low")) for i, n in enumerate(names)])
    low = F.lower("name")
    hit = F.filter(asked, lambda n: F.contains(low, n["low"]))
    rows = nodes.filter("type = 'Laptop'").select("id", "seq", low.alias("low"), F.explode(hit).alias("n"))
    return rows.groupBy("n.ord").agg(F.min_by("id", F.struct(F.col("low") != F.col("n.low"), "seq")).alias("id")).select("id", "ord")


def around(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, k: int, **walk) -> DataFrame:
    """The k triplets within ``hops`` of the seeds that rank highest, with their sentences; ``walk`` goes to :func:`pagerank`."""
    near = khop(edges, seeds, hops)
    inner = induced(edges, near)
    found = cut(triplets(nodes.join(near.select("id"), "id", "left_semi"), inner, pagerank(near, inner, seeds, **walk), k))
    return found.withColumn("sentence", text.verbalise(F.col("subject"), F.col("predicate"), F.col("object")))


def retrieve(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    hops: int = rules.HOPS,
    k: int = rules.TOP_TRIPLETS,
    items: int = rules.TOP_ITEMS,
    **walk,
) -> tuple[DataFrame, DataFrame]:
    """Triplets around the seeds, with their sentences, and the items that they speak for."""
    told = around(nodes, edges, seeds, hops, k, **walk)
    return told, mass_ranking(told, nodes.filter("type = 'Laptop'"), items)


def retrieve_for_names(
    nodes: DataFrame,
    edges: DataFrame,
    names: Sequence[str],
    hops: int = 1,
    k: int = rules.TOP_TRIPLETS,
    **walk,
) -> tuple[DataFrame, DataFrame]:
    """Triplets around items of these names, and the items themselves in the order of the names."""
    seeds = cut(find_items(nodes, names))
    return around(nodes, edges, seeds, hops, k, **walk), seeds


def text_seeds(
    nodes: DataFrame,
    said: str,
    hints: Mapping[str, Sequence[str]],
    brands: Sequence[str] = tuple(rules.BRANDS),
    cases: Sequence[str] = tuple(rules.USE_CASES),
) -> DataFrame:
    """(id): nodes that a free text speaks of: of each hinted feature the highest tier that exists, brands, use cases, an item."""
    low = said.lower()
    wanted = [
        (f"tier {f}", i, f"{f}::{t}")
        for f, words in hints.items()
        if any(w in low for w in words)
        for i, t in enumerate(reversed(rules.TIERS))
    ]
    wanted += [(f"Brand::{b}", 0, f"Brand::{b}") for b in brands if b in low]
    wanted += [(f"UseCase::{c}", 0, f"UseCase::{c}") for c in cases if c in low]
    rows = nodes.sparkSession.createDataFrame(wanted, "slot string, turn int, id string")
    linked = rows.join(nodes.select("id"), "id", "left_semi").groupBy("slot").agg(F.min_by("id", "turn").alias("id")).select("id")
    return linked.unionByName(find_item(nodes, said).select("id")).distinct()


def local_search(
    nodes: DataFrame,
    edges: DataFrame,
    said: str,
    brands: Sequence[str] = tuple(rules.BRANDS),
    cases: Sequence[str] = tuple(rules.USE_CASES),
    k: int = rules.TOP_TRIPLETS,
    **walk,
) -> tuple[DataFrame, DataFrame]:
    """Triplets one hop around a single node, and that node: the item of that name, else a brand or a use case that is
    spoken of, else the node nearest in the hashed space."""
    low = said.lower()
    spoken = [f"Brand::{b}" for b in brands if b in low] + [f"UseCase::{c}" for c in cases if c in low]
    listed = nodes.sparkSession.createDataFrame(
        [(1 + i, n) for i, n in enumerate(spoken)],
        "turn int, id string",
    ).join(nodes.select("id"), "id", "left_semi")
    first = find_item(nodes, said).select(F.lit(0).alias("turn"), "id")
    last = flat_search(nodes, said, 1).select(F.lit(1 + len(spoken)).alias("turn"), "id")
    seed = cut(first.unionByName(listed.select("turn", "id")).unionByName(last).orderBy("turn").limit(1).select("id"))
    return around(nodes, edges, seed, 1, k, **walk), seed


def explain(nodes: DataFrame, edges: DataFrame, id_: str, hops: int = 1, k: int = 50, **walk) -> DataFrame:
    """The triplets around one node: why it was named."""
    seed = nodes.filter(F.col("id") == id_).select("id")
    return around(nodes, edges, seed, hops, k, **walk)


class OneTime:
    """Results that are worked out once for each key, until :meth:`clear` (after a rebuild); they are kept as
    checkpoints, so that later calls read them instead of walking again."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[DataFrame, ...]] = {}
        self.walks = 0

    def get(self, key: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        if key not in self._held:
            self._held[key] = tuple(cut(df) for df in make())
            self.walks += 1
        return self._held[key]

    def clear(self) -> None:
        self._held.clear()


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """One graph of several parts."""
    return reduce(DataFrame.unionByName, frames)
