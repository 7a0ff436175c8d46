"""Weak supervision: texts with very many spans, what votes against a span, and the model against plain versions."""

import math
import random
import time
from collections import defaultdict

import pytest

pytest.importorskip("tarnfell.llm")
from pyspark.sql import functions as F  # noqa: E402

from tarnfell.llm import pii  # noqa: E402


def test_running_sums_and_pieces_equal_plain_ones(spark):
    rng = random.Random(1)
    data = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 300, 1000)]
    df = spark.createDataFrame([(x,) for x in data], "x array<int>")
    got = df.select("x", pii.running(F.col("x"), lambda a, b: a + b).alias("s"), pii.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]
        assert r.m == [max(r.x[:i], default=0) for i in range(len(r.x))]


def plain_masked(text, spans):
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], pii.MASKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_masks_stand_where_the_spans_are(spark):
    rng = random.Random(2)
    words = ["a@b.co", "1.2.3.4", "+1 (234) 567-8901", "4111 1111 1111 1111", "é", "😀", "word " * 300, "x" * 1024, "\n", "ghp_" + "aB3" * 9, "x@1.2.3.4"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts += ["é" * 1018 + " " + "a@b.co", "é" * 1017 + " a@b.co" + "😀" * 1024, "a@b.co" + " " * 1018]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, text in enumerate(texts):
        listed = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)]
        assert clean[i] == plain_masked(text, listed)


def test_a_text_with_very_many_spans_ends(spark):
    n = 200_000
    mails = " ".join(f"u{i}@x.org" for i in range(n))
    mixed = " ".join(f"u{i}@x.org token ghp_{i:032d}" for i in range(40_000))
    df = spark.createDataFrame([(0, mails), (1, mixed), (2, "none")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: (r.n_email, r.last) for r in pii.report(df).select("doc_id", "n_email", F.substring_index("spans", ",", -1).alias("last")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    took = time.monotonic() - began
    assert got[0] == (n, f"email:{len(mails) - len(f'u{n - 1}@x.org')}:{len(mails)}") and got[1][0] == 40_000
    assert clean[0] == " ".join(["<EMAIL>"] * n) and clean[1] == " ".join(["<EMAIL> token <SECRET>"] * 40_000) and clean[2] == "none"
    assert took < 300, took  # about as long as a small table takes; the time of a quadratic way is some half an hour


LOOKALIKES = [
    "Dear Customer Service, we", "Dear Hiring Manager, I", "Dear Sir Madam, the", "the file name: Main Report was", "see section 123-45-6789 of",
    "company name is Delta Works and", "Dear Valued Guests, our", "part 219-09-9999 fits",
]


def test_what_only_looks_like_it_stays(spark):
    rng = random.Random(3)
    real = lambda i: rng.choice([f"my name is Zorblax Weber{'abcdefg'[i % 7]} and", f"Dear Anna Miller, {i}", f"SSN 123-45-{1000 + i}", f"his SSN, on file, was 219-09-{1000 + i}"])
    for planted in (0, 200):  # without anything real, and among it
        texts = [f"{rng.randint(0, 99)} words, {x} on" for x in LOOKALIKES for _ in range(100)]
        texts += [f"so {real(i)} then" for i in range(planted)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.spans for r in pii.report(df).collect()}
        false = sum(bool(got[i]) for i in range(800))
        found = sum(bool(got[i]) for i in range(800, 800 + planted))
        assert false <= 0.05 * 800 and found >= 0.9 * planted, (planted, false, found)


def plain_em(patterns):
    """{(kind, votes): posterior} by loops over the patterns."""
    post = {(k, v): (sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1) for k, v, _ in patterns}
    for _ in range(pii.ROUNDS):
        new = {}
        for kind in {k for k, _, _ in patterns}:
            rows = [(v, n, post[kind, v]) for k, v, n in patterns if k == kind]
            share = (sum(n * p for _, n, p in rows) + 1) / (sum(n for _, n, _ in rows) + 2)
            rates = []
            for j, belief in enumerate(pii.BELIEF):
                weigh = max(4.0, pii.TRUST * sum(n for v, n, _ in rows if v[j] >= 0))
                hit = sum(n * p for v, n, p in rows if v[j] == 1) + weigh * belief
                miss = sum(n * (1 - p) for v, n, p in rows if v[j] == 1) + weigh * (1 - belief)
                cast = sum(n * p for v, n, p in rows if v[j] >= 0), sum(n * (1 - p) for v, n, p in rows if v[j] >= 0)
                rates.append((hit / (cast[0] + weigh), miss / (cast[1] + weigh)))
            for v, _, _ in rows:
                odds = math.log(share / (1 - share))
                for x, (h, m) in zip(v, rates):
                    odds += math.log(h / m) if x == 1 else math.log((1 - h) / (1 - m)) if x == 0 else 0.0
                new[kind, v] = 1 / (1 + math.exp(-odds))
        post = new
    return post


def plain_model(spans):
    """{feature: odds} of a list of (kind, votes, shape)."""
    counts = defaultdict(int)
    for kind, votes, _ in spans:
        counts[kind, votes] += 1
    post = plain_em([(k, v, n) for (k, v), n in counts.items()])
    yes, no, odds = defaultdict(float), defaultdict(float), {}
    for kind, votes, shape in spans:
        for feature in (kind, *shape):
            yes[feature] += post[kind, votes]
            no[feature] += 1 - post[kind, votes]
    for f in yes:
        kind = f.split(".")[0]
        lean = pii.PRIOR * (yes[f] + no[f]) / (yes[kind] + no[kind])
        share = math.log((yes[f] + lean) / (yes[kind] + pii.PRIOR)) - math.log((no[f] + lean) / (no[kind] + pii.PRIOR))
        odds[f] = math.log((yes[f] + 1) / (no[f] + 1)) if f == kind else share
    return odds


def test_the_model_equals_a_plain_one(spark):
    rng = random.Random(4)
    some = ["Dear Anna Miller, ", "my name is Zed Black ", "Dear Team Leader ", "ssn 123-45-6789 ", "order 000-12-1234 ", "token=ghp_" + "a1B2" * 8 + " ", "x" * 20 + " ", "a@b.org "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    found = pii.candidates(spark.createDataFrame([(t,) for t in texts], "text string"))
    spans = [(e.kind, tuple(e.votes), tuple(e.shape)) for r in found.select("found").collect() for e in r.found]
    want, got = plain_model(spans), pii.train(found).first().model
    assert set(got) == set(want) and all(math.isclose(got[f], want[f], abs_tol=1e-9) for f in want)
