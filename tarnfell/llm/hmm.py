"""Scoring by a hidden Markov language model.

Tokens are the words between ASCII white space, with A-Z in lower case, and one end of text.  A token is emitted in
two steps: the state emits the token's class, and the class emits the token.  The ``OWN`` most frequent words (by a
count threshold) are classes of their own; every other word belongs to one of ``HASHED`` classes by its last letters,
and its chance within the class comes from its count, ``(c + 0.1) / (C + 0.1 * (V + 1))`` with the class's tokens C and
distinct words V, so that unseen words have their share.  The likelihood of a text is then that of its classes, by
the scaled forward recursion over the whole text, times the words' chances within their classes.

* Counts: every worker counts its texts, one shuffle adds the counts up; the table stays distributed.
* Frequent words, at most ``HEAD`` of at most ``LONG`` bytes by a threshold on the count, go to the workers; the others
  meet their counts in a join, so no worker needs the vocabulary.  The thresholds come from a histogram of the counts
  by sixteenths of a power of two, a thousand rows at most.
* Baum-Welch: each round, workers run forward and backward over all training texts, whole, and the expected counts are
  added up by (parameter) in a shuffle; what comes to the driver has the size of the model.  Forward probabilities are
  kept at every ``BLOCK`` tokens only and worked out again block by block on the way back, so memory is bounded and
  the counts are those of the uncut recursion.  The rounds end when the likelihood has settled, or after ``ROUNDS``.
* The states are placed by a first model, from at most ``WARM_TEXTS`` whole texts of at most ``WARM_TOKENS`` tokens.

Defined results: a null or empty text is one end token; a text of any length is one sequence; a null id counts as the
text '' when folds are drawn; repeated rows are counted and scored one by one; without training texts all counts are 0
and the states are uniform; further columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.scratch import materialize

OWN, HASHED, SUFFIX, HEAD, LONG = 2000, 1024, 3, 200_000, 64
STATES, ROUNDS, SETTLED, BLOCK, WARM_TEXTS, WARM_TOKENS, WARM_ROUNDS, SEED = 8, 4, 1e-3, 300_000, 400, 1024, 25, 11
SMOOTH = 0.1
END = ""


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def hashed_class(word: str) -> int:
    return zlib.crc32(word[-SUFFIX:].encode("utf-8", "surrogatepass")) % HASHED


def _hashed_class(word: Column | str) -> Column:
    return (F.crc32(F.right(word, F.lit(SUFFIX)).cast("binary")) % HASHED).cast("int")


# ---------------------------------------------------------------------------------------------------- the recursions


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.start), len(self.emit)


class Batch:
    """Sequences side by side, the longest first: step t has the ``many[t]`` sequences that are longer than t."""

    def __init__(self, sequences: Sequence[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.steps = int(sizes[0])
        self.many = np.searchsorted(-sizes, -np.arange(1, self.steps + 1), "right")
        self.at = np.concatenate([[0], np.cumsum(self.many)])
        self.symbols = np.empty(self.at[-1], np.int64)
        for column, k in enumerate(self.order):
            s = sequences[k]
            self.symbols[self.at[: len(s)] + column] = s


def likelihood(model: Model, sequences: Sequence[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each sequence's probability, by the scaled forward recursion."""
    b = Batch(sequences)
    out = np.zeros(len(sequences))
    alpha = model.start[None, :]
    for t in range(b.steps):
        n, a = b.many[t], b.at[t]
        alpha = (alpha[:n] @ model.move if t else alpha) * model.emit[b.symbols[a : a + n]]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        out[:n] += np.log(scale)
    found = np.empty(len(out))
    found[b.order] = out
    return found


def expected(model: Model, sequences: Sequence[np.ndarray], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts (K), moves (K x K) and emissions (classes x K), and the log likelihood.

    Steps are taken in blocks of some ``block`` tokens; of each the forward probabilities before it are kept, and those
    within it only while the way back passes through.
    """
    b, (k, classes) = Batch(sequences), model.shape
    cuts = [0]
    while cuts[-1] < b.steps:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(b.at, b.at[cuts[-1]] + block, "right")) - 1))

    def forward(t0: int, t1: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base = b.at[t0]
        emitted = model.emit[b.symbols[base : b.at[t1]]]
        alpha, scales = np.empty_like(emitted), np.empty(len(emitted))
        for t in range(t0, t1):
            n, a = b.many[t], b.at[t] - base
            now = alpha[a : a + n]
            np.multiply(before[:n] @ model.move if t else model.start[None, :], emitted[a : a + n], out=now)
            scales[a : a + n] = scale = now.sum(1)
            now /= scale[:, None]
            before = now
        return emitted, alpha, scales

    entry: list[np.ndarray | None] = [None]
    for t0, t1 in zip(cuts[:-2], cuts[1:-1]):  # all blocks but the last
        alpha = forward(t0, t1, entry[-1])[1]
        entry.append(alpha[b.at[t1 - 1] - b.at[t0] :].copy())
    moves, weights, beta, found = np.zeros((k, k)), np.zeros((classes, k)), np.ones((b.many[-1], k)), 0.0
    for t0, t1, before in reversed(list(zip(cuts[:-1], cuts[1:], entry))):
        base = b.at[t0]
        emitted, alpha, scales = forward(t0, t1, before)
        found += float(np.log(scales).sum())
        for t in range(t1 - 1, t0 - 1, -1):
            n, a = b.many[t], b.at[t] - base
            ahead = emitted[a : a + n] * beta / scales[a : a + n, None]
            alpha[a : a + n] *= beta
            if t:
                last = before if t == t0 else alpha[b.at[t - 1] - base : a]
                moves += last[:n].T @ ahead
                beta = np.ones((b.many[t - 1], k))
                beta[:n] = ahead @ model.move.T
        symbols = b.symbols[base : b.at[t1]]
        weights += np.stack([np.bincount(symbols, alpha[:, s], classes) for s in range(k)], 1)
    return alpha[: b.many[0]].sum(0), moves * model.move, weights, found


def improve(starts: np.ndarray, moves: np.ndarray, weights: np.ndarray, unigram: np.ndarray) -> Model:
    """The model that the expected counts give, smoothed towards the classes' shares."""
    start = starts + 1.0
    move = moves + 0.5 + 0.5 * np.eye(len(moves))
    emit = weights + 5.0 * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def bundles(sequences: Sequence[np.ndarray], most: int = BLOCK, wide: int = 1024) -> Iterator[list[int]]:
    """Positions of sequences of like length, in bundles of bounded size (a longer one alone)."""
    held, size = [], 0
    for i in np.argsort([len(s) for s in sequences], kind="stable")[::-1].tolist():
        if held and (size + len(sequences[i]) > most or len(held) == wide):
            yield held
            held, size = [], 0
        held.append(i)
        size += len(sequences[i])
    if held:
        yield held


def _sum_expected(model: Model, sequences: Sequence[np.ndarray]) -> np.ndarray:
    """Starts, moves, emissions and the log likelihood of all sequences, end to end."""
    k, classes = model.shape
    total = np.zeros(k + k * k + classes * k + 1)
    for held in bundles(sequences):
        total += np.concatenate([np.ravel(x) for x in expected(model, [sequences[i] for i in held])])
    return total


def _improved(flat: np.ndarray, model: Model, unigram: np.ndarray) -> Model:
    k, classes = model.shape
    return improve(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(classes, k), unigram)


def warm(sequences: Sequence[np.ndarray], unigram: np.ndarray, states: int = STATES, rounds: int = WARM_ROUNDS) -> Model:
    """A first model from a bounded number of texts; states start from a random tilt of the classes' shares."""
    rng = np.random.default_rng(SEED)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states))) + 1e-12
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(0))
    for _ in range(rounds if len(sequences) else 0):
        model = _improved(_sum_expected(model, sequences), model, unigram)
    return model


# ----------------------------------------------------------------------------------------------------------- the data


def held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())],
            names=["word", "c"],
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(tokens(text))
            if len(seen) > 300_000:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text); the end of text is the empty word."""
    return texts.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """What every worker knows of the most frequent words."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray


def frequent(counts: DataFrame, *most: int) -> list[int]:
    """For each number the least count such that at most so many words, none over ``LONG`` bytes, have it or more."""
    by = F.floor(F.log2("c") * 16).alias("by")
    sizes = counts.filter(_short()).groupBy(by).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("by")).collect()
    found = []
    for limit in most:
        total, least = 0, 1 << 62
        for r in sizes:
            if (total := total + r["n"]) > limit:
                break
            least = r["c"]
        found.append(least)
    return found


def _short() -> Column:
    return F.octet_length("word") <= LONG


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        number = {w: i for i, w in enumerate(head.words)}
        logs = np.log10(head.counts + SMOOTH)
        for batch in batches:
            n, known, every, within, classes, tails = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                words = tokens(text)
                at = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                rare = np.flatnonzero(at < 0).tolist()
                kind = head.classes[at]
                tail = [words[i].decode("utf-8", "surrogatepass") for i in rare]
                kind[rare] = [OWN_END + hashed_class(w) for w in tail]
                known_logs = np.where(at >= 0, logs[at], 0.0) if len(logs) else np.zeros(len(words))
                n.append(len(words))
                known.append(len(words) - len(rare))
                every.append(known_logs.sum())
                within.append(known_logs[kind >= OWN_END].sum())
                classes.append(kind.astype(np.uint16).tobytes())
                tails.append(tail)
            columns = [
                *batch.columns[:3],
                pa.array(n, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(every, pa.float64()),
                pa.array(within, pa.float64()),
                pa.array(classes, pa.binary()),
                pa.array(tails, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns,
                names=["row", "doc_id", "held_out", "n_tokens", "n_head", "head_logs", "head_within", "classes", "tail"],
            )

    return run


#: Classes below this number are single words.
OWN_END = OWN + 1


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _e_step(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = _sum_expected(shared.value, _sequences(batch.column(0)))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    return run


def baum_welch(
    classes: DataFrame,
    model: Model,
    unigram: np.ndarray,
    rounds: int = ROUNDS,
    settled: float = SETTLED,
) -> tuple[Model, list[float]]:
    """Rounds over all rows of ``classes`` (classes: 16-bit numbers), until the likelihood gains less than ``settled``.

    Returns the model, and the log likelihood of all texts under the model that each round began with.  The driver
    gets sums of the model's size.
    """
    sc, (k, n) = classes.sparkSession.sparkContext, model.shape
    history: list[float] = []
    for _ in range(rounds):
        shared = sc.broadcast(model)
        sums = classes.select("classes").mapInArrow(_e_step(shared), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        shared.unpersist()
        flat = np.zeros(k + k * k + n * k + 1)
        flat[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
        model = _improved(flat, model, unigram)
        history.append(float(flat[-1]))
        if len(history) > 1 and history[-1] - history[-2] < settled * abs(history[-2]):
            break
    return model, history


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shared.value
        for batch in batches:
            sequences = _sequences(batch.column(1))
            out, words = np.zeros(len(sequences)), np.zeros(len(sequences))
            for held in bundles(sequences, most=2_000_000):
                out[held] = likelihood(model, [sequences[i] for i in held])
            for i, s in enumerate(sequences):
                words[i] = shares[s].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out / math.log(10) - words)], names=["row", "path"])

    return run


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    counts = materialize(word_counts(texts.filter(~F.col("held_out"))), "hmm-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    own, head = frequent(counts, OWN, HEAD)
    rows = counts.filter((F.col("c") >= head) & _short()).toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # at most HEAD
    words, c = rows.column("word").to_pylist(), rows.column("c").to_numpy()
    classes = np.array([i if n >= own else OWN_END + hashed_class(w) for i, (w, n) in enumerate(zip(words, c.tolist()))], np.int64)
    shared = sc.broadcast(Head([w.encode("utf-8", "surrogatepass") for w in words], c, np.append(classes, 0)))
    # Tokens and distinct words of each hashed class: at most HASHED rows.
    of_class = counts.filter((F.col("c") < own) | ~_short()).groupBy(_hashed_class("word").alias("k")).agg(
        F.sum("c").alias("c"),
        F.count(F.lit(1)).alias("v"),
    ).collect()
    within, unigram = np.zeros(OWN_END + HASHED), np.zeros(OWN_END + HASHED)
    within[OWN_END:] = math.log10(SMOOTH)
    unigram[: OWN_END][: int((c >= own).sum())] = c[c >= own]
    for r in of_class:
        within[OWN_END + r["k"]] = math.log10(r["c"] + SMOOTH * (r["v"] + 1))
        unigram[OWN_END + r["k"]] = r["c"]
    unigram = (unigram + SMOOTH) / (unigram + SMOOTH).sum()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_logs double, head_within double, classes binary, tail array<string>"
    coded = materialize(texts.mapInArrow(_encode(shared), schema), "hmm-coded")
    training = coded.filter(~F.col("held_out"))
    sample = training.filter(F.col("n_tokens") <= WARM_TOKENS).orderBy(F.xxhash64("doc_id"), "row").limit(WARM_TEXTS).select("row", "classes")
    first = warm(_sequences(sample.toArrow().sort_by([("row", "ascending")]).column("classes")), unigram, states)
    model, _ = baum_welch(training, first, unigram, rounds)

    rare = coded.select("row", F.explode("tail").alias("word")).join(counts.filter((F.col("c") < head) | ~_short()), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    rare = rare.groupBy("row").agg(F.sum(log).alias("rare_logs"), F.count("c").alias("n_rare"))
    paths = coded.select("row", "classes").mapInArrow(_score(sc.broadcast((model, within))), "row long, path double")
    rows = coded.drop("classes", "tail").join(paths, "row").join(rare, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("head_logs") + rare_logs - F.col("n_tokens") * F.lit(math.log10(total + SMOOTH * (distinct + 1)))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("path") + F.col("head_within") + rare_logs).alias("score"),
    )
