"""Token counts of whole texts by a look-up in two tiers, without moving a single pre-token.

A pre-token is a run of white space and the word after it.  Byte-level tokenizers split a text further, but never across
such a place, so a text's count is the sum of its pre-tokens' counts.  Three steps:

1. every task keeps a summary of its most frequent pre-tokens (Misra-Gries, at most ``FREQUENT`` of them); what moves is
   one summary a task, and summaries are merged in two rounds of bounded groups;
2. the driver counts the tokens of the merged summary's pre-tokens once and broadcasts them as one compact table, whose
   size is bounded by ``FREQUENT`` entries of at most ``LONGEST`` characters;
3. every text is looked up pre-token by pre-token: first in that table, which stays, then in the worker's own cache of
   misses, which is emptied when full.  What neither knows is encoded by the library, a batch's misses at once.

Neither tier decides a result: counts are the library's for any table.  Tokenizers whose splits can't be told apart that
way (other pre-tokenizers, normalizers, sentencepiece models) encode each text as a whole.

Defined results: a null text counts as empty, with no tokens; repeated rows and ties are counted row by row; an empty
table gives an empty table; texts of any length are worked on in pieces of bounded length, cut between pre-tokens;
special strings within a text are what the library makes of them by default; other columns pass through, but for one that
bears the new column's name, which is replaced.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.llm.names import others, unused

#: Entries of a summary and of the table that is broadcast, and the characters that one of them has at most.
FREQUENT, LONGEST = 8192, 64
#: Groups in which summaries are merged first.
GROUPS = 512
#: Characters that are worked on at once, unless a single pre-token is longer.
SLICE_CHARS = 1 << 20
#: Entries of a worker's cache.
CACHED = 500_000

# What the tokenizers' patterns take for white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_PRE_TOKENS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
_BETWEEN = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_SUMMARY = "part int, tokens array<string>, counts array<long>"


def pieces(text: str) -> Iterator[str]:
    """``text`` cut between pre-tokens into pieces of some ``SLICE_CHARS`` characters."""
    begun = 0
    while len(text) - begun > SLICE_CHARS:
        cut = _BETWEEN.search(text, begun + SLICE_CHARS)
        if not cut:
            break
        yield text[begun : cut.start()]
        begun = cut.start()
    yield text[begun:] if begun else text


def runs(texts: Iterable[str], cut: Callable[[str], Iterable[str]] = pieces) -> Iterator[list[tuple[int, str]]]:
    """(number of its text, piece) in lists of bounded length."""
    run, held = [], 0
    for number, text in enumerate(texts):
        for piece in cut(text):
            if run and held + len(piece) > SLICE_CHARS:
                yield run
                run, held = [], 0
            run.append((number, piece))
            held += len(piece)
    if run:
        yield run


# ------------------------------------------------------------------------------------------------- tokenizers


@functools.lru_cache(4)
def lengths_of(path: str) -> tuple[Callable[[Sequence[str]], list[int]], bool]:
    """How many tokens the library of ``path`` makes of each text, and whether texts may be cut between pre-tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
    whole = re.compile(f"[{SPACE}]").search
    apart = all(
        not (whole(t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"]
    )
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(list(texts), add_special_tokens=False)], plain and apart


class Counts:
    """Token counts of texts by way of a table that stays and a cache that is emptied when full."""

    def __init__(self, path: str, table: dict[str, int], most: int = CACHED) -> None:
        (self.lengths, self.cuts), self.table, self.most = lengths_of(path), table, most
        self.seen = dict(table)
        self.asked = self.encoded = 0

    def __call__(self, texts: Sequence[str]) -> list[int]:
        out = [0] * len(texts)
        for run in runs(texts, pieces if self.cuts else lambda t: [t]):
            if not self.cuts:
                for (number, _), n in zip(run, self.lengths([p for _, p in run]), strict=True):
                    out[number] += n
                continue
            cut = [_PRE_TOKENS(p) for _, p in run]
            new = list(set().union(*cut) - self.seen.keys())
            self.seen.update(zip(new, self.lengths(new), strict=True))
            for (number, _), units in zip(run, cut, strict=True):
                out[number] += sum(map(self.seen.__getitem__, units))
            self.asked += sum(map(len, cut))
            self.encoded += len(new)
            for unit in new:
                if len(unit) > LONGEST:
                    del self.seen[unit]
            if len(self.seen) > self.most + len(self.table):
                self.seen = dict(self.table)
        return out


# ------------------------------------------------------------------------------------------------- tier one


def trimmed(counts: Counter[str], most: int) -> Counter[str]:
    """The ``most`` largest counts less the next one: summaries cut so keep every token whose share is over 1 / most."""
    if len(counts) <= most:
        return counts
    ranked = counts.most_common(most + 1)
    least = ranked[-1][1]
    return Counter({t: n - least for t, n in ranked[:-1] if n > least})


def merged(tokens: Iterable[Sequence[str]], counts: Iterable[Sequence[int]], most: int) -> Counter[str]:
    total: Counter[str] = Counter()
    for t, n in zip(tokens, counts):
        total.update(dict(zip(t, n)))
        if len(total) > 4 * most:
            total = trimmed(total, most)
    return trimmed(total, most)


def frequent(df: DataFrame, text: str = "text", most: int = FREQUENT) -> list[str]:
    """Pre-tokens that are frequent in ``df``, the most frequent first; all rows are counted, at most ``most`` come back."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for run in runs(t or "" for t in batch.column(0).to_pylist()):
                for _, piece in run:
                    total.update(_PRE_TOKENS(piece))
                if len(total) > 16 * most:
                    total = trimmed(total, 4 * most)
        yield row(TaskContext.get().partitionId() % GROUPS, Counter({t: n for t, n in total.items() if len(t) <= LONGEST}))

    def row(part: int, total: Counter[str]) -> pa.RecordBatch:
        ranked = sorted(trimmed(total, most).items(), key=lambda x: (-x[1], x[0]))
        lists = [pa.array([[x[i] for x in ranked]], pa.list_(kind)) for i, kind in ((0, pa.string()), (1, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], names=["part", "tokens", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        lists = ((x.as_py() for x in table.column(c)) for c in ("tokens", "counts"))
        return pa.Table.from_batches([row(0, merged(*lists, most))])

    first = df.select(text).mapInArrow(summaries, _SUMMARY).filter(F.size("tokens") > 0)
    final = first.groupBy("part").applyInArrow(merge, _SUMMARY).groupBy("part").applyInArrow(merge, _SUMMARY)
    found = final.select("tokens").first()
    return list(found["tokens"]) if found else []


def packed(path: str, tokens: Sequence[str]) -> bytes:
    """The table of pre-tokens and their token counts as Arrow bytes."""
    lengths, cuts = lengths_of(path)
    some = list(tokens) if cuts else []
    table = pa.table({"token": pa.array(some, pa.string()), "n": pa.array(lengths(some) if some else [], pa.uint16())})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


@functools.lru_cache(2)
def worker_counts(path: str, table: bytes) -> Counts:
    """A worker's counts: made once, kept from task to task."""
    found = pa.ipc.open_stream(table).read_all()
    return Counts(path, dict(zip(found.column("token").to_pylist(), found.column("n").to_pylist())))


# ------------------------------------------------------------------------------------------------- the operator


def count(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns in ``keep``) with the number of tokens of each text."""
    spark = df.sparkSession
    tokens = frequent(df, text) if lengths_of(path)[1] else []
    table = spark.sparkContext.broadcast(packed(path, tokens))
    kept = others(df.columns if keep is None else keep, n_tokens)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(n_tokens, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(path, table.value)
        for batch in batches:
            n = pa.array(counts([t or "" for t in batch.column(len(kept)).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], n], names=schema.fieldNames())

    return df.select(*kept, F.col(text).alias(unused(kept, "text"))).mapInArrow(run, schema)


def report(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return count(sized, path, keep=("doc_id", "n_bytes")).withColumn("over_limit", F.col("n_tokens") > limit)
