"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; on the unit sphere a cosine of ``COSINE`` is a distance of ``sqrt(2 - 2 * COSINE)``.  Each of
``TABLES`` tables hashes a vector by ``PROJECTIONS`` quantised random projections, ``floor((a . v + b) / WIDTH)``, and
vectors of one label that meet in a bucket are compared exactly, in double precision.  With the values set here two
vectors at the threshold itself miss each other in all tables once in about 4,000 pairs, nearer ones less often.

Exact copies become one representative first, so a vector that is repeated without end costs one row a table.  A
bucket that holds more than ``BUCKET_MAX`` representatives is cut into tiles, and each pair of tiles is a group of its
own; no bucket is capped and no task holds more than two tiles.  A pair counts in the first table in which it meets, so
that links can be summed without being listed: a group returns one row for each of its linked members, with the
number of its partners and the smallest member that a union-find reached.

Defined results: a vector is a row, whatever its id: rows that repeat an id link, or don't, by what they hold, and an
id never joins two components.  A component is named by the smallest id in it.  Vectors that are null or zero, or hold
null or non-finite components, and vectors without a label or an id, link with nothing and are their own components;
vectors of different lengths are never compared; components of any magnitude are scaled before they are squared;
further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.components import components
from tarnfell.llm.scratch import materialize

COSINE, TABLES, PROJECTIONS, WIDTH, BUCKET_MAX, SEED = 0.98, 36, 14, 1.5, 1024, 17


def projections(dims: int, tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dims))
    return rng.standard_normal((tables * each, dims)), rng.uniform(0, width, tables * each)


def signatures(unit: np.ndarray, tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """A 64-bit bucket for each row of ``unit`` and each table."""
    a, b = projections(unit.shape[1], tables, each, width)
    cells = np.floor((unit @ a.T + b) / width).astype(np.int64).reshape(len(unit), tables, each)
    mixed = np.full((len(unit), tables), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(each):
            mixed = (mixed ^ cells[:, :, k].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def collision_chance(distance: float, each: int = PROJECTIONS, width: float = WIDTH) -> float:
    """The chance that two vectors at ``distance`` share a bucket of one table."""
    c = width / distance
    one = 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))
    return one**each


def recall(cosine: float = COSINE, tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH) -> float:
    """The chance that a pair at ``cosine`` meets in some table."""
    return 1 - (1 - collision_chance(math.sqrt(2 - 2 * cosine), each, width)) ** tables


def directions(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` at length 1; their largest component becomes 1 first, or squares could vanish or overflow."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rep", "label", "v", "copies", "signs"]
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for n in np.unique(sizes):
            part = batch.filter(pa.array(sizes == n))
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            signs = signatures(directions(x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signs.size + 1, TABLES, dtype=np.int32)), pa.array(signs.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=names)


#: Groups up to this size are compared together, lag by lag; larger ones by a product of matrices each.
SMALL = 48


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.Table]:
    """Runs of whole groups: rows of one key stay together (a task's rows come sorted by key)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            keys = t.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            rows = len(keys) - cut
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros (lists of different lengths are never in one group)."""
    lists = column.combine_chunks()
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == sizes[:1]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max()), flat.dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def pairs(keys: np.ndarray, side: np.ndarray, unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of the linked pairs within groups of sorted ``keys``; of tiles, only pairs across."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        i, j = np.nonzero(np.triu(unit[a : a + n] @ unit[a : a + n].T >= cosine, 1))
        found.append((i + a, j + a))
    rest = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    last = np.repeat(starts + sizes, sizes)
    for lag in range(1, SMALL):
        rest = rest[rest + lag < last[rest]]
        if not len(rest):
            break
        near = np.einsum("ij,ij->i", unit[rest], unit[rest + lag]) >= cosine
        found.append((rest[near], rest[near] + lag))
    i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    across = side[i] * side[j] <= 0
    return i[across], j[across]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            keys, at, side, ids, counts = (t.column(k).to_numpy() for k in range(5))
            unit = directions(_matrix(t.column(5)).astype(np.float64))
            i, j = pairs(keys, side, unit, cosine)
            signs = _matrix(t.column(6))
            # A pair counts in the first table in which it meets.
            before = np.arange(signs.shape[1]) < at[i][:, None]
            first = ~((signs[i] == signs[j]) & before).any(axis=1)
            i, j = i[first], j[first]
            partners = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
            root = np.arange(len(ids))
            while len(i):  # pointer jumping towards the first position within reach
                new = root.copy()
                low = np.minimum(root[i], root[j])
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            hit = np.flatnonzero(partners)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[hit]), pa.array(partners[hit].astype(np.int64)), pa.array(ids[root[hit]])],
                names=["src", "n", "dst"],
            )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    ) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    bits = F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        "label",
        F.col("embedding").alias("v"),
        sound.alias("sound"),
        F.when(sound, F.sha2(bits, 256)).alias("key"),
    )
    rows = materialize(rows, "pstable-rows")
    # Exact copies (of one label) become one representative: the first row of them, as ids may repeat.
    copies = rows.filter("sound").groupBy("label", "key").agg(
        F.min("row").alias("rep"),
        F.min("vec_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("v").alias("v"),
    )
    copies = materialize(copies, "pstable-copies")
    kinds = {f.name: f.dataType.simpleString() for f in copies.schema}
    hashed = copies.select("rep", "label", "v", "copies").mapInArrow(
        _hash,
        f"rep long, label {kinds['label']}, v {kinds['v']}, copies long, signs array<long>",
    )
    hashed = materialize(hashed, "pstable-hashed")
    meets = hashed.select("rep", F.xxhash64("label", F.size("v")).alias("label"), F.posexplode("signs").alias("at", "bucket"))
    sizes = meets.groupBy("label", "at", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / bucket_max).cast("int")
    met = meets.join(sizes, ["label", "at", "bucket"]).withColumn("tiles", tiles).withColumn(
        "tile",
        F.pmod(F.xxhash64("rep", "at"), tiles).cast("int"),
    )
    others = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(
            F.least(o, F.col("tile")).alias("i"),
            F.greatest(o, F.col("tile")).alias("j"),
            F.signum(F.col("tile") - o).cast("int").alias("side"),
        ),
    )
    dealt = met.select("rep", "label", "at", "bucket", F.explode(others).alias("o"))
    keyed = dealt.select(F.xxhash64("label", "at", "bucket", "o.i", "o.j").alias("key"), "at", F.col("o.side").alias("side"), "rep")
    full = keyed.join(hashed.select("rep", "copies", "v", "signs"), "rep").select("key", "at", "side", "rep", "copies", "v", "signs")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = full.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(cosine), "src long, n long, dst long")
    found = materialize(found, "pstable-links")
    links = found.groupBy("src").agg(F.sum("n").alias("linked"))
    parts = components(found.select("src", "dst"))
    known = copies.drop("v").join(links.withColumnRenamed("src", "rep"), "rep", "left").join(
        parts.withColumnRenamed("node", "rep"),
        "rep",
        "left",
    ).withColumn("component", F.coalesce("component", "rep"))
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(names, "component").select(
        "label",
        "key",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    out = rows.select("vec_id", "label", "key").join(materialize(known, "pstable-known"), ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
