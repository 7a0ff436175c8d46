"""SimHash near-duplicates with BK-trees.

A fingerprint has one bit per position of the shingles' 64-bit hashes, set if more than half of them set it.
Fingerprints link at ``RADIUS`` or fewer differing bits.  The search is exact: 64 bits are cut into ``BLOCKS`` =
``RADIUS`` + 2 blocks, and by the pigeonhole principle two linked fingerprints agree in at least two of them, so every
distinct fingerprint enters one shard for each two blocks, keyed by their 25 or 26 bits.  Each shard has a BK-tree (children keyed
by their integer distance to the parent), searched along the edges that the triangle inequality leaves.

A shard holds distinct fingerprints only (copies meet in one row before), and a shard larger than ``SHARD_MAX`` is
cut into tiles: the tree of each tile is searched by the fingerprints of every tile, one pair of tiles a task, so
no task holds more than two tiles and no link is lost.  A task doesn't emit pairs; it joins what it links in a
union-find and emits one edge to the smallest member for each fingerprint that has a link.  The edges meet in
:func:`tarnfell.llm.components.components`.

Defined results: a null or empty text has fingerprint 0 and links like any other; fewer words than a shingle:
the whole sequence is one shingle; repeated rows and repeated ids keep their rows; a null id keeps its row and
never names a component unless no other id is there (then it is null); a column named as the fingerprint is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.llm.components import components
from tarnfell.llm.names import others, unused
from tarnfell.llm.scratch import materialize

SHINGLE, SEED, RADIUS, BLOCKS, SHARD_MAX = 3, 42, 3, 5, 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANE
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return ones


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; lower-cases A-Z only, words end at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())],
            np.uint64,
        )
    return int(_WEIGHT[2 * set_bits(hashes) > len(hashes)].sum())


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``keep``) with ``name``, the fingerprint as a signed long."""
    keep = tuple(others(docs.columns if keep is None else keep, name))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType(), False)])
    source = docs.select(*keep, F.col(text).alias(unused(keep, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


class BKTree:
    """Nodes in insertion order; the children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of ``value``, new or not."""
        node = 0 if self.values else -1
        while node >= 0:
            d = (self.values[node] ^ value).bit_count()
            if d == 0:
                return node
            if (after := self.children[node].get(d)) is None:
                self.children[node][d] = len(self.values)
                break
            node = after
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def nearest(self, value: int, radius: int) -> int | None:
        """The node nearest to ``value`` (the first such), at ``radius`` or less."""
        best, rest = None, [0] if self.values else []
        while rest:
            node = rest.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius and (best is None or d < radius or node < best):
                best, radius = node, d
            rest += [k for e, k in self.children[node].items() if d - radius <= e <= d + radius]
        return best

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The nodes at ``radius`` or less from ``value``."""
        rest = [0] if self.values else []
        while rest:
            node = rest.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            kids = self.children[node]
            if len(kids) <= 2 * radius + 1:
                rest += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                rest += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


def shard_links(stored: list[int], asked: list[int] | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest of the links in a shard, or between two tiles of one: (fingerprint, smallest of its group)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    tree = BKTree()
    for value in stored:
        if asked is None and tree.values:
            for node in tree.within(value, radius):
                a, b = root(value), root(tree.values[node])
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    for value in asked or ():
        for node in tree.within(value, radius):
            a, b = root(value), root(tree.values[node])
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


_EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each key (a task's rows come sorted by key): side and fp."""
    key, held = None, []
    for batch in batches:
        keys, sides, fps = (c.to_numpy() for c in batch.columns)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != key:
                yield key, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            key = keys[a]
            held.append((sides[a:b], fps[a:b]))
    if held:
        yield key, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for _, sides, fps in _runs(batches):
        if len(fps) < 2:
            continue
        stored = fps[sides <= 0].tolist()
        asked = fps[sides > 0].tolist() if sides.any() else None
        mask = (1 << 64) - 1
        out += shard_links([x & mask for x in stored], None if asked is None else [x & mask for x in asked])
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["src", "dst"])


def link(fps: DataFrame, shard_max: int = SHARD_MAX) -> DataFrame:
    """Edges (src, dst: signed fingerprints) that connect what links; ``fps``: distinct fingerprints in ``fp``."""
    spark, cuts = fps.sparkSession, [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    masks = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in two) for two in combinations(range(BLOCKS), 2)]
    keyed = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)))) for i, m in enumerate(masks)]
    entries = fps.select("fp", F.explode(F.array(*keyed)).alias("shard"))
    large = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_max)
    # Nearly every shard is one group of one task; the large ones are cut into pairs of tiles.
    tagged = entries.join(
        large.select("shard", F.ceil(F.col("n") / shard_max).cast("int").alias("tiles")),
        "shard",
        "left",
    ).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("fp", "shard"), F.col("tiles")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(
            F.least(o, F.col("tile")).alias("i"),
            F.greatest(o, F.col("tile")).alias("j"),
            F.when(o == F.col("tile"), 0).when(o > F.col("tile"), -1).otherwise(1).alias("side"),
        ),
    )
    dealt = tagged.withColumn("tile", tile).select("fp", "shard", F.explode(others).alias("o"))
    rows = dealt.select((F.xxhash64("shard", "o.i", "o.j")).alias("key"), F.col("o.side").alias("side"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_link_shards, _EDGE)


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id (smallest id reachable), ``carry``."""
    rows = materialize(add_fingerprints(docs, keep=("doc_id", *carry)), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = materialize(link(fps.select("fp")), "simhash-edges")
    parts = components(edges)  # node, component; only nodes that have an edge
    named = parts.join(fps, parts.node == fps.fp).groupBy("component").agg(F.min("first_id").alias("linked_id"))
    of = parts.join(named, "component").select(F.col("node").alias("fp"), "linked_id")
    names = fps.join(of, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id"))
    names = materialize(names, "simhash-names")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(names, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", *carry)
