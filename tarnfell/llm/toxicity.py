"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; everything else in the training fold, labelled or not, is unlabelled
text.  A linear model over hashed words and word beginnings is trained with numpy on the class-prior-corrected
risk  ``prior * R(pos, +1) + max(0, R(unl, -1) - prior * R(pos, -1))``; the corrected part can't be driven below
nought by learning the samples by heart.

The two training samples are bounded by parameters (``positives``, ``unlabelled``: rows that differ in id or text) and
taken by a hash of the id, so reruns agree; labels, lang, source and doc_id never enter a score.  The model is 4 bytes a feature (1 MB), whatever
the corpus, and scoring is one pass over the text without a shuffle.

Defined results: a null or empty text gets the score of no features; without positives every score is 0; a null id
is treated as the text '' when folds are drawn; texts of any length are read whole; repeated rows are scored one by one
and sampled once; of several labels of one id a toxic one counts; a column that bears the score's name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.llm.names import others, unused

SPACE = 1 << 18
PREFIXES = (3, 4, 5, 6)
_STRIP = "\"'.,;:!?()[]{}<>|*#&%$-_/\\"


class Features:
    """The hashed features of texts; what tokens stand for is remembered, up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.seen: dict[str, bytes] = {}
        self.most = most

    def token(self, token: str) -> bytes:
        word = token.strip(_STRIP)
        names = [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word else []
        return np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % SPACE for n in names], np.int32).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct features of a whole text, in order."""
        tokens = set((text or "").lower().split())
        if len(self.seen) > self.most:
            self.seen = {}
        seen = self.seen
        for t in tokens:
            if t not in seen:
                seen[t] = self.token(t)
        return np.unique(np.frombuffer(b"".join(map(seen.__getitem__, tokens)), np.int32))


def margin(w: np.ndarray, x: np.ndarray) -> float:
    return float(w[x].sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> float:
        if not self.prior:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(margin(self.weights, x) + self.bias, -500, 500))))


def contrast(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 0.01, sure: float = 4.0) -> np.ndarray:
    """The log ratio of a feature's shares in the two samples; 0 where too few positives have it or chance could explain it."""
    p, u = (np.bincount(np.concatenate([*docs, np.zeros(0, np.int32)]), minlength=SPACE) for docs in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    share = (p + u) / (n + m)
    apart = (p / n - u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
    ratio = np.log((p + 0.5) / (n + 1)) - np.log((u + 0.5) / (m + 1))
    return np.where((p >= max(2, least * n)) & (apart >= sure), np.maximum(ratio, 0), 0)


def boundary(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The margin with the least class-prior-corrected 0-1 risk on the samples; the middle, where several have it."""
    zp, zu = np.sort(zp), np.sort(zu)
    at = np.unique(np.concatenate([zp, zu]))
    at = np.concatenate([at[:1] - 1, (at[:-1] + at[1:]) / 2, at[-1:] + 1])
    missed = np.searchsorted(zp, at) / len(zp)
    flagged = 1 - np.searchsorted(zu, at) / len(zu)
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float((at[best[0]] + at[best[-1]]) / 2)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative corrected logistic risk of margins on both samples, and its slope in each margin."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    value, of_p, of_u = prior * np.logaddexp(0, -zp).mean() + max(0.0, rest), prior * (sp - 1) / len(sp), np.zeros(len(su))
    if rest > 0:
        of_p, of_u = of_p - prior * sp / len(sp), su / len(su)
    return float(value), of_p, of_u


def fit(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    steps: int = 400,
    rate: float = 0.03,
    decay: float = 1e-4,
) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; features are scaled by their contrast."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(SPACE, np.float32), 0.0, 0.0)
    scale = contrast(positive, unlabelled)
    kept = np.flatnonzero(scale > 0)
    scale, number = scale[kept], np.full(SPACE, -1)
    number[kept] = np.arange(len(kept))
    w, bias = np.ones(len(kept)), -2.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)

    def pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        at = number[np.concatenate([*docs, np.zeros(0, np.int32)])]
        row = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        return at[at >= 0], row[at >= 0], len(docs)

    def margins(p: tuple) -> np.ndarray:
        return np.bincount(p[1], (w * scale)[p[0]], p[2]) + bias

    def gradient(p: tuple, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(p[0], slope[p[1]], len(kept)) * scale, slope.sum())

    pos, unl = pack(positive), pack(unlabelled)
    for step in range(1, steps + 1):
        _, of_p, of_u = risk(margins(pos), margins(unl), prior)
        g = gradient(pos, of_p) + gradient(unl, of_u)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(w - move[:-1] - rate * decay * w, 0.0)  # what speaks for toxicity at first sight never speaks against it
        bias -= move[-1]
    bias -= boundary(margins(pos), margins(unl), prior)
    weights = np.zeros(SPACE, np.float32)
    weights[kept] = w * scale
    return Model(weights, float(bias), prior)


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    name = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _featured(docs: DataFrame, sample: DataFrame) -> list[np.ndarray]:
    """The features of the sample's rows (doc_id, hash of the text; a bounded number), made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([make(t.as_py()).tobytes() for t in b.column(2)], pa.binary())],
                names=["doc_id", "h", "x"],
            )

    # Rows that are equal meet before they move, so no more comes here than the sample has.
    met = docs.join(F.broadcast(sample), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "h")
    rows = met.mapInArrow(run, "doc_id long, h long, x binary").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    return [np.frombuffer(x, np.int32) for x in rows.column("x").to_pylist()]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = 3000, unlabelled: int = 9000) -> Model:
    """A model from at most so many confirmed toxic rows and so many rows of any sort, all of the training folds."""
    marked = labels.filter(
        "doc_id is not null and toxic is not null"
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id", folds))
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    texts = docs.filter("doc_id is not null").filter(~held_out("doc_id", folds)).select("doc_id", "text", F.xxhash64("text").alias("h"))

    def sample(rows: DataFrame, most: int) -> DataFrame:
        # At most so many rows of two numbers: safe to broadcast.
        return rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most)

    pos = sample(texts.join(marked.filter("toxic = 1"), "doc_id"), positives)
    return fit(_featured(texts, pos), _featured(texts, sample(texts, unlabelled)), prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of toxicity of the whole text; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = others(docs.columns, name)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Features(), shared.value
        for b in batches:
            scores = [known.score(make(t)) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores, pa.float64())], names=schema.fieldNames())

    return docs.select(*kept, F.col(text).alias(unused(kept, "text"))).mapInArrow(run, schema)
