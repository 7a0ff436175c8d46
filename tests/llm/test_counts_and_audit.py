"""Token counts in two tiers and the audit of filters, against the libraries and plain simulations."""

import itertools
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tarnfell.llm import audit, tokencount  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "é" * 3000 + "  中文　空白 ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c ", "\x00nul\x00 \x1c\x1d x",
       "x " * 30_000, "9" * 40_000, "it's we'll  don't", "wide  space here​᠎", "same words here", "same words here"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "x") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, "x"), (3, "a", "en", "s", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").repartition(3)


# ----------------------------------------------------------------------------------------------------- token counts


def test_white_space_is_the_library_s():
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(JSON).pre_tokenizer.pre_tokenize_str
    cut = tokencount._PRE_TOKENS
    for c in itertools.chain(range(1, 0x3100), range(0x3100, 0xD800, 61), (0xE000, 0xFEFF, 0x1F600)):
        text = f"!{chr(c)}{chr(c)}!"
        places = {a for _, (a, _) in split(text)}  # the library's splits hold all of ours
        at = 0
        for unit in cut(text):
            assert at in places, hex(c)
            at += len(unit)


def test_counts_are_the_library_s(odd, library):
    got = tokencount.report(odd, JSON).collect()
    want = {(r.doc_id, r.text): library(r.text) for r in odd.collect()}
    assert len(got) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted((i is None, i, n) for (i, t), n in [*want.items(), ((3, "a"), 1)])
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        assert by[i].n_bytes == len((t or "").encode()) and by[i].over_limit == (by[i].n_tokens > 512)
    assert tokencount.report(odd.filter("doc_id = -1"), JSON).count() == 0
    counted = tokencount.count(odd, JSON)
    assert counted.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_tokens"] and counted.schema["n_tokens"].dataType.typeName() == "long"


def test_neither_tier_decides_a_count(library, monkeypatch):
    rng = random.Random(3)
    alphabet = [*"abcXYZ019 .,'!?\n\t", "  ", "é", "中", " ", "　", "\x1c", "<|endoftext|>", "'s", " the", " and"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(400)]
    want = [library(t) for t in texts]
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 37)  # many cuts within texts
    full = {u: library(u) for t in texts for u in tokencount._PRE_TOKENS(t)}
    for table, most in (({}, 0), ({}, 5), (full, 5), (dict(list(full.items())[:50]), 10_000)):
        counts = tokencount.Counts(JSON, table, most)
        assert counts(texts) == want
        assert counts.encoded == 0 if table is full else counts.encoded > 0
    assert all("".join(tokencount.pieces(t)) == t for t in texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        plain = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    some = odd.filter("doc_id < 10")
    assert {r.doc_id: r.n_tokens for r in tokencount.report(some, path).collect()} == {i: plain(t or "") for i, t in enumerate(ODD[:10])}


def test_frequent_pre_tokens_of_all_rows_are_in_the_table(spark):
    rng = random.Random(4)
    texts = [" ".join(["start", *(f"w{rng.randrange(10**6)}" for _ in range(60)), *["often"] * 12, "hot" if i >= 100 else "cold"]) for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    found = tokencount.frequent(docs, most=60)
    assert found[0] == " often" and {"start", " hot", " cold"} & set(found) >= {"start"} and len(found) <= 60
    assert tokencount.frequent(docs.limit(0)) == []
    exact = tokencount.frequent(docs)
    assert {"start", " often", " hot", " cold"} <= set(exact[:5] + exact[:9000]) and exact[:2] == [" often", "start"]


# ----------------------------------------------------------------------------------------------------- the audit


def plain_failures(t):
    w = t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t)]


def plain_audit(docs, labels):
    first = {}
    for d in docs:
        if d[0] is not None:
            t = d[1] or ""
            first[t] = min(first.get(t, d[0]), d[0])
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = [(d[2] or "", d[0], [*plain_failures(d[1] or ""), d[0] is not None and first[d[1] or ""] < d[0]]) for d in docs]
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone, stay = [r for r in left if r[2][k]], [r for r in left if not r[2][k]]
                failing = [r for r in mine if r[2][k]]
                out[part, order, step] = (
                    len(stay), len(gone), len(failing) - len(gone), sum(sum(r[2]) == 1 for r in failing),
                    sum(r[1] in good for r in gone if r[1] is not None), sum(r[1] in toxic for r in gone if r[1] is not None),
                )
                total[part, f] = total.get((part, f), 0) + len(gone)
                left = stay
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_a_simulation_of_every_order(spark):
    rng = random.Random(5)
    texts = ["", None, " ", "word " * 250, "A" * 50, "a" * 97 + "ABC", "a" * 96 + "ABCD", "one word #", "p | q", "x\ty\nz\x0b\x0cq\rr"]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) + end for n in (199, 200, 201, 400) for end in ("", " $", " UPPER" * 9)]
    texts += [" ".join(f"w{i % m}" for i in range(400)) for m in (199, 200, 201)]
    docs = [(i, t, rng.choice(["en", "de", None, ""]), "s", 1) for i, t in enumerate(texts * 3)]
    docs += [(7, docs[7][1], "en", "s", 1)] * 2 + [(7, docs[3][1], "de", "s", 1), (None, "word " * 250, "en", "s", 1), (None, None, "en", "s", 1), (-5, "", "de", "s", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (7, 0, 1), (7, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "'x' AS part", "'y' AS good", "'z' AS n", "'q' AS A", "'r' AS digest").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.report(df, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.report(df.limit(0), marks).count() == 0
    bare = audit.report(df, marks.limit(0)).collect()
    assert len(bare) == len(got) and all(r.good_lost == r.toxic_lost == 0 for r in bare)


def test_one_large_group_of_copies_meets_in_no_task(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same text', concat('text ', id)) AS text", "'en' AS lang")
    marks = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    last = [r for r in audit.report(docs, marks).collect() if r.filter_order == "EABCD"]
    assert [r.removed for r in sorted(last, key=lambda r: r.step)] == [1333, 2667, 0, 0, 0]
    assert {r.step: r.good_lost for r in last}[1] == 1


def test_labels_are_never_broadcast(spark, tmp_path):
    """A small file may hold millions of labels, and each is listed once a salt."""
    docs = spark.range(20).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang")
    spark.range(9).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels")
    marks = spark.read.parquet(f"{tmp_path}/labels")
    plan = audit.flagged(docs, marks)._jdf.queryExecution().sparkPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line and "salt" in line]
    assert met and all("SortMergeJoin" in line for line in met)
