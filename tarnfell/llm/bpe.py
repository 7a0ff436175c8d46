"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (base64 token, rank) is turned into a ``tokenizers`` BPE model: every byte string is spelt with the
printable characters of the byte-level alphabet, and every split of a token into two known tokens becomes a
merge whose priority is the token's rank.  Offsets come back in code points of the input text.  Decoding looks
each id up in the byte table and concatenates bytes, so that characters which were split over several tokens are
whole again; :func:`pieces` gives the text of each token, holding back incomplete characters until they end.

Defined results: a null text is encoded as the empty text (no ids); an empty text has no ids; unknown ids make
decoding fail with ``KeyError``; other columns pass through untouched, but for one that bears a new column's name, which
is replaced.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.llm.names import others, unused

#: Code points that one call of the library gets at most, unless a single text is longer.
SLICE_CHARS = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character for each byte: Latin-1 graphics stand for themselves, the rest follow from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def build(path: str, pattern: str):
    """The ``tokenizers`` model that merges as the ranks say, within each match of ``pattern``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, alphabet = load_ranks(path), byte_alphabet()
    spell = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], ranks[right], spell[left], spell[right]))
    merges.sort()
    model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=[m[3:] for m in merges], ignore_merges=True)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tok


@functools.lru_cache(4)
def byte_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def slices(texts: Sequence[str]) -> Iterator[list[str]]:
    """``texts`` in runs of bounded length."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > SLICE_CHARS:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


#: Patterns of which no match begins before a single space and ends after it, and none looks further than that space.
SPACE_SAFE = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
_WIDE = re.compile(r" \s|\s |\x00").search


class UnitEncoder:
    """Encodes texts unit by unit and remembers what each gave (ids as int32 bytes).

    With a pattern of ``SPACE_SAFE``, a text may be cut before every space that stands alone between two other
    characters: each unit is then encoded as it would be within the text.  Texts with wider white space, and all
    texts under other patterns, are cut into the matches of the pattern.  Natural text repeats its words, so most
    units are looked up and the library merges only new ones.  The memory is emptied when full; no result changes.
    """

    def __init__(self, path: str, pattern: str, most: int = 500_000) -> None:
        import regex

        self.tok, self.matches, self.safe, self.most, self.seen = build(path, pattern), regex.compile(pattern).findall, pattern in SPACE_SAFE, most, {}

    def units(self, text: str) -> list[str]:
        if self.safe and not _WIDE(text):
            return text.replace(" ", "\x00 ").split("\x00")
        return self.matches(text)

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = [self.units(t) for t in texts]
        if len(self.seen) > self.most:
            self.seen = {}
        seen = self.seen
        new = [u for u in {u for c in cut for u in c} if u not in seen]
        for u, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            seen[u] = np.array(e.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(seen.__getitem__, c)), np.int32) for c in cut]


@functools.lru_cache(2)
def unit_encoder(path: str, pattern: str) -> UnitEncoder:
    return UnitEncoder(path, pattern)


def int_lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def decode_ids(ids: Sequence[int], path: str) -> bytes:
    return b"".join(map(byte_table(path).__getitem__, ids))


def pieces(ids: Sequence[int], path: str) -> list[str]:
    """The text of each token; bytes of an unfinished character are carried to the token that ends it."""
    step, table = codecs.getincrementaldecoder("utf-8")("replace"), byte_table(path)
    out = [step.decode(table[i]) for i in ids]
    if out:
        out[-1] += step.decode(b"", final=True)
    return out


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    offsets: str | None = None,
    round_trip: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns in ``keep``) with ``ids`` (array<int>) and, if names are given, ``offsets`` (array of start
    and end, in code points) and ``round_trip`` (whether decoding the ids gives the text's bytes again)."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    pair = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())])
    if offsets:
        fields.append(
            T.StructField(
                offsets,
                T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
            )
        )
    if round_trip:
        fields.append(T.StructField(round_trip, T.BooleanType()))
    kept = others(df.columns if keep is None else keep, *(f.name for f in fields))
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun = 0
            for texts in slices([t or "" for t in batch.column(len(kept)).to_pylist()]):
                part = batch.slice(begun, len(texts))
                begun += len(texts)
                if offsets:
                    coded = build(path, pattern).encode_batch(texts, add_special_tokens=False)
                    found = [np.array(e.ids, np.int32) for e in coded]
                else:
                    found = unit_encoder(path, pattern)(texts)
                more: list[pa.Array] = [int_lists(found)]
                if offsets:
                    more.append(pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in coded], pa.list_(pair)))
                if round_trip:
                    more.append(pa.array([decode_ids(f.tolist(), path) == t.encode() for f, t in zip(found, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *more], names=schema.fieldNames())

    return df.select(*kept, F.col(text).alias(unused(kept, "text"))).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for (null ids: null)."""
    kept = others(df.columns, data)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(data, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            # One row at a time: a batch has far too many ids to be Python numbers all at once.
            rows = zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist())
            out = [decode_ids(flat[a:b].tolist(), path) if full else None for a, b, full in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.binary())], names=schema.fieldNames())

    return df.select(*kept, F.col(ids).alias(unused(kept, "ids"))).mapInArrow(run, schema)


@functools.lru_cache(4)
def _digits(path: str) -> dict[int, bytes]:
    return {rank: b"%d" % rank for rank in byte_table(path)}


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids again, and keep the hashes of both; one pass, so ids stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, digits = unit_encoder(path, pattern), _digits(path)
        for batch in batches:
            n, coded, decoded = [], [], []
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                for ids in map(np.ndarray.tolist, encoder(texts)):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(b",".join(map(digits.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
