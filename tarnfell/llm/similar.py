"""Near duplicates at a similarity: SimHash BK-trees in shards, each link checked exactly.

Two texts link if the Jaccard similarity of their sets of ``SHINGLE``-word shingles is ``LEAST`` or more.  At 0.8 a
SimHash fingerprint differs in 15 of 100 bits, so the fingerprints here have 256 bits, of the set's hashes mixed four
ways, and trees are searched at ``RADIUS``, over five deviations beyond what 0.8 gives (over three for sets of only
five shingles).  Blocks that any two such fingerprints must share would have less than four bits and divide nothing;
so shards are keyed by ``BANDS`` bands of ``ROWS`` least hashes of the sets instead.  A pair at 0.8 exactly shares no
shard once in 150,000 (:func:`recall`), more similar ones less often.

* In each shard a BK-tree (children keyed by their integer distance to the parent) gives every fingerprint its nearest
  one within the radius: a forest of candidate links, at most one a member, which are checked on the sets themselves.
* What has linked is one component.  In shards that still have several, the members outside the shard's main component
  go into a tree, and all members of the shard are searched in it; whatever the tree finds in another component is
  checked on the sets at once, in the same task.  So every pair that shares a shard and lies within the radius is
  either checked or known to be connected, no pair is ever listed, and what moves is a row a member and tile.
* A shard is cut into tiles of bounded size, one pair of tiles a group, so no task holds a whole shard; texts that
  many others are checked against are dealt out in copies.

Texts with the same set of shingles are one set, and only sets that share a shard with others are moved.

Defined results: a null or empty text has no shingles and is like others without any; fewer words than a shingle: the
whole sequence is one shingle; texts of any length are read whole; repeated rows and repeated ids keep their rows; an
empty table gives no rows; columns that aren't asked for play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.llm.components import components
from tarnfell.llm.scratch import materialize
from tarnfell.llm.simhash import BKTree, set_bits

SHINGLE, LEAST, BANDS, ROWS, SEED = 5, 0.8, 30, 5, 42
LANES, RADIUS = 4, 72
#: Members of a tile in the first search; in the second, members in a tree and members that are searched in it.
TILE, MINOR, OTHERS = 1024, 256, 512
#: Checks against one set that a task gets at most.
DEALT = 64
#: Shingles hashed at once.
CHUNK = 2048

_RNG = np.random.default_rng(SEED)
_DRAWN = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_MASK, _FACTOR = _DRAWN[0], 2 * _DRAWN[1] + np.uint64(1)
_LANE = _RNG.integers(0, 1 << 63, LANES, dtype=np.uint64)


def recall(similarity: float = LEAST) -> float:
    """The chance that a pair of this similarity shares a shard."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles; lower-cases A-Z only, words end at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(
        np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    )


def bands(found: np.ndarray) -> list[int]:
    """One signed number for each band of a set; none for the empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[None, at : at + CHUNK] ^ _MASK) * _FACTOR).min(axis=1), out=least)
    return np.array(
        [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)],
        np.uint64,
    ).view(np.int64).tolist()


def wide_fingerprint(found: np.ndarray) -> bytes:
    """256 bits: a bit is 1 if set in over half the set's hashes, for each of four mixings of them."""
    out = np.zeros(LANES, np.uint64)
    for lane in range(LANES):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), 1 << 16):
            h = found[at : at + (1 << 16)] ^ _LANE[lane]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones += set_bits(h ^ (h >> np.uint64(31)))
        out[lane] = np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def _batch(schema: T.StructType, *columns: list | np.ndarray) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to)], schema=to)


def add_sets(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``key`` (the name of the set of shingles), ``copy`` (of the text) and ``bands``."""
    import xxhash

    held = docs.select(*keep, F.xxhash64("text").alias("copy"), "text")
    schema = T.StructType(
        [
            *held.schema.fields[:-1],
            T.StructField("key", T.LongType(), False),
            T.StructField("bands", T.ArrayType(T.LongType(), False), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = np.empty(batch.num_rows, np.uint64), []
            for i, t in enumerate(batch.column(len(keep) + 1)):
                s = shingles(t.as_py())
                keys[i] = xxhash.xxh64_intdigest(s.tobytes(), SEED)
                found.append(bands(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(keys.view(np.int64)), pa.array(found, pa.list_(pa.int64()))],
                names=schema.fieldNames(),
            )

    return held.mapInArrow(run, schema)


_SET = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("fp", T.BinaryType()),
        T.StructField("items", T.BinaryType()),
    ]
)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bands, text) to the fingerprint and the items of each set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingles(t.as_py()) for t in part.column(2)]
            yield _batch(
                _SET,
                part.column(0).to_pylist(),
                part.column(1).to_pylist(),
                [wide_fingerprint(s) for s in found],
                [s.tobytes() for s in found],
            )


_EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def _value(fp: pa.Scalar) -> int:
    return int.from_bytes(fp.as_buffer().to_pybytes(), "little")


def _items(items: pa.Scalar) -> np.ndarray:
    return np.frombuffer(items.as_py(), np.uint64)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, side, key, fp), sorted by group and side, to (nearest stored, new): at most one link a row.

    In a tile of its own (side 0) each fingerprint is searched, then stored; between two tiles those of side -1 are
    stored and those of side 1 searched.
    """
    group, tree, names = None, BKTree(), []
    for batch in batches:
        src, dst = [], []
        groups, sides, keys = (batch.column(c).to_pylist() for c in range(3))
        for i, key in enumerate(keys):
            if groups[i] != group:
                group, tree, names = groups[i], BKTree(), []
            value = _value(batch.column(3)[i])
            if sides[i] >= 0 and (near := tree.nearest(value, RADIUS)) is not None:
                src.append(names[near])
                dst.append(key)
            if sides[i] <= 0 and tree.add(value) == len(names):
                names.append(key)
        if src:
            yield _batch(_EDGE, src, dst)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (src, dst, items of both) that link; the set of a src is kept while it repeats."""
    held, of = None, None
    for batch in batches:
        src, dst, left, right = batch.columns
        good = []
        for i, key in enumerate(src.to_pylist()):
            if key != held:
                held, of = key, _items(left[i])
            if jaccard(of, _items(right[i])) >= LEAST:
                good.append(i)
        if good:
            yield pa.RecordBatch.from_arrays([src.take(pa.array(good)), dst.take(pa.array(good))], names=["src", "dst"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst: keys) whose sets are similar."""
    shares = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("n"))
    left = sets.join(shares, sets.key == shares.src).select(
        "src",
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("share"),
        F.col("items").alias("left"),
    )
    dealt = pairs.join(shares, "src").withColumn("share", F.pmod(F.xxhash64("dst"), F.col("n")).cast("int"))
    right = sets.select(F.col("key").alias("dst"), F.col("items").alias("right"))
    return dealt.join(right, "dst").join(left, ["src", "share"]).select("src", "dst", "left", "right").mapInArrow(_check, _EDGE)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, other, key, part, minor, band, bands, fp, items), sorted by group and other, to links between parts.

    The rows that aren't ``other`` make the tree; the others are searched in it, one by one.  A pair is checked in the
    first band that its sets share only, and once, not both ways.
    """
    group, tree, stored, parent = None, BKTree(), [], {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        src, dst = [], []
        groups, others, keys, parts, minors, band = (batch.column(c).to_pylist() for c in range(6))
        for i, key in enumerate(keys):
            if groups[i] != group:
                group, tree, stored, parent = groups[i], BKTree(), [], {}
            value = _value(batch.column(7)[i])
            if not others[i]:
                node = tree.add(value)
                if node == len(stored):
                    stored.append([])
                stored[node].append((key, parts[i], batch.column(6)[i].values.to_numpy(), _items(batch.column(8)[i])))
                continue
            mine, near = None, None
            for node in tree.within(value, RADIUS):
                for of, part, there, items in stored[node]:
                    if part == parts[i] or minors[i] and key <= of or root(part) == root(parts[i]):
                        continue
                    if mine is None:
                        mine, near = _items(batch.column(8)[i]), batch.column(6)[i].values.to_numpy()
                    few, many = sorted((len(items), len(mine)))
                    if few < LEAST * many - 1e-9 or near[np.argmax(near == there)] != band[i] or jaccard(mine, items) < LEAST:
                        continue
                    parent[root(part)] = root(parts[i])
                    src.append(part)
                    dst.append(parts[i])
        if src:
            yield _batch(_EDGE, src, dst)


def _parts(n: int, name: str) -> Column:
    return F.greatest(F.ceil(F.col(name) / n), F.lit(1)).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _dealt(df: DataFrame) -> DataFrame:
    """One task a group and more: rows sorted by all their leading numbers."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, df.columns[0]).sortWithinPartitions(*df.columns[:3])


def near_duplicates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of every row of ``docs`` (text) and ``component``: the same for all that links reach from one another."""
    rows = materialize(add_sets(docs, keep), "similar")
    # One row a set: however many texts have it, they meet before they move.
    keys = materialize(
        rows.filter(F.size("bands") > 0).groupBy("key").agg(F.min("copy").alias("copy"), F.first("bands").alias("bands")),
        "similar-keys",
    )
    entries = keys.select("key", F.explode("bands").alias("band"))
    full = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shards = materialize(entries.join(full, "band").select("band", "n", "key"), "similar-shards")
    # Each set that is in a shard with others, once.
    wanted = keys.join(shards.select("key").distinct(), "key")
    texts = docs.select("text", F.xxhash64("text").alias("copy")).join(wanted, "copy").groupBy("key").agg(
        F.first("bands").alias("bands"),
        F.min("text").alias("text"),
    )
    sets = materialize(texts.select("key", "bands", "text").mapInArrow(_sets, _SET), "similar-sets")

    tiles = _parts(TILE, "n")
    tiled = shards.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("key", "band"), F.col("tiles")).cast("int"))
    met = tiled.select("band", "key", "tile", _each(F.col("tiles")).alias("o"))
    group = F.xxhash64("band", F.least("tile", "o"), F.greatest("tile", "o"))
    met = met.select(group.alias("group"), F.signum(F.col("tile") - F.col("o")).cast("int").alias("side"), "key")
    near = _dealt(met.join(sets.select("key", "fp"), "key").select("group", "side", "key", "fp")).mapInArrow(_nearest, _EDGE)
    edges = materialize(_linked(materialize(near.distinct(), "similar-near"), sets), "similar-edges")
    first = components(edges)

    # What is left: links between members of a shard that lie in different components, one of them not the shard's main.
    named = materialize(
        shards.join(first, shards.key == first.node, "left").select("band", "key", F.coalesce("component", "key").alias("part")),
        "similar-parts",
    )
    sizes = named.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("band").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"),
        F.sum("n").alias("members"),
        F.max("n").alias("most"),
        F.count(F.lit(1)).alias("parts"),
    ).filter("parts > 1 and members > 2")
    several = several.withColumn("minors", F.col("members") - F.col("most")).select(
        "band",
        "main",
        _parts(MINOR, "minors").alias("trees"),
        _parts(OTHERS, "members").alias("tiles"),
    )
    whole = named.join(several, "band").withColumn("minor", F.col("part") != F.col("main"))
    inside = whole.filter("minor").select(
        "*",
        F.pmod(F.xxhash64("key", "band"), F.col("trees")).cast("int").alias("i"),
        _each(F.col("tiles")).alias("j"),
    ).withColumn("other", F.lit(0))
    asked = whole.select(
        "*",
        _each(F.col("trees")).alias("i"),
        F.pmod(F.xxhash64("band", "key"), F.col("tiles")).cast("int").alias("j"),
    ).withColumn("other", F.lit(1))
    met = inside.unionByName(asked).select(F.xxhash64("band", "i", "j").alias("group"), "other", "key", "part", "minor", "band")
    crossed = _dealt(
        met.join(sets, "key").select("group", "other", "key", "part", "minor", "band", "bands", "fp", "items")
    ).mapInArrow(_cross, _EDGE)
    more = components(materialize(crossed, "similar-crossed")).toDF("component", "joined")
    found = rows.join(first, rows.key == first.node, "left").select(*keep, F.coalesce("component", "key").alias("component"))
    return found.join(more, "component", "left").select(*keep, F.coalesce("joined", "component").alias("component"))
