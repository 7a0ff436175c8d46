"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, copies."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tarnfell.llm import bpe, components, hmm, licenses, mixing, pii, pstable, queries, simhash, threshold, toxicity, urlfilter  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "",
    None,
    " ",
    "a",
    "mit LICENSE",
    "x " * 30_000,
    "9" * 40_000,
    "é" * 3000 + "  中",
    "MIT License mit license",
    "same words here again",
    "same words here again",
    "\x00nul\x00",
    "+1 (234) 567-8901 a@b.co 1.2.3.4 4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity: null ids and sources, repeated rows, a clashing column."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x") for i, t in enumerate(ODD)] + [
        (None, "no id", "en", "s1", 0, "x"),
        (3, "a", "en", "s0", 0, "x"),
        (3, "a", "en", "s0", 0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------------------------------------------------ 1: model


def tiny_model():
    rng = np.random.default_rng(0)
    return hmm.Model(np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)


def paths(m, s):
    """(probability, states) of every path."""
    for z in itertools.product(range(len(m.start)), repeat=len(s)):
        p = m.start[z[0]] * m.emit[s[0], z[0]]
        for i in range(1, len(s)):
            p *= m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]]
        yield p, z


def test_recursions_equal_the_sum_over_all_paths():
    m, rng = tiny_model(), np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n) for n in (1, 2, 4, 7, 3, 1)]
    assert np.allclose(hmm.likelihood(m, sequences), [math.log(sum(p for p, _ in paths(m, s))) for s in sequences])
    starts, moves, weights = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:
        whole = sum(p for p, _ in paths(m, s))
        for p, z in paths(m, s):
            starts[z[0]] += p / whole
            for i in range(1, len(s)):
                moves[z[i - 1], z[i]] += p / whole
            for i, x in enumerate(s):
                weights[x, z[i]] += p / whole
    likely = sum(hmm.likelihood(m, sequences))
    for block in (1, 2, 5, 1000):
        for got, want in zip(hmm.expected(m, sequences, block), (starts, moves, weights, likely)):
            assert np.allclose(got, want)


def test_expected_counts_of_a_long_text_are_those_of_the_uncut_recursion(spark):
    m, rng = tiny_model(), np.random.default_rng(6)
    long = rng.integers(0, 5, 5000)
    alpha, beta, scales = np.zeros((5000, 3)), np.ones((5000, 3)), np.zeros(5000)
    for t, x in enumerate(long):
        alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * m.emit[x]
        scales[t] = alpha[t].sum()
        alpha[t] /= scales[t]
    for t in range(4998, -1, -1):
        beta[t] = m.move @ (m.emit[long[t + 1]] * beta[t + 1]) / scales[t + 1]
    at = alpha * beta
    moves = sum(np.outer(alpha[t], m.emit[long[t + 1]] * beta[t + 1] / scales[t + 1]) * m.move for t in range(4999))
    want = (at[0], moves, np.stack([at[long == x].sum(0) for x in range(5)]), np.log(scales).sum())
    for block in (512, 10**6):
        for got, w in zip(hmm.expected(m, [long, long[:7]], block), [a + b for a, b in zip(want, hmm.expected(m, [long[:7]]))]):
            assert np.allclose(got, w)
    texts = spark.createDataFrame([(long.astype(np.uint16).tobytes(),), (long[:9].astype(np.uint16).tobytes(),)], "classes binary")
    model, history = hmm.baum_welch(texts, m, np.full(5, 0.2), rounds=6, settled=0)
    assert len(history) >= 2 and all(a <= b + 20 for a, b in itertools.pairwise(history)) and history[-1] > history[0]


def test_thresholds_hold_their_bounds(spark):
    rng = random.Random(18)
    data = [(f"w{i}", rng.choice([1, 1, 2, 3, 5, 8, 1000, 1001, 70_000])) for i in range(3000)] + [("x" * 1000, 10**6)]
    df = spark.createDataFrame(data, "word string, c long")
    for most, least in zip((0, 5, 400, 3000, 9000), hmm.frequent(df, 0, 5, 400, 3000, 9000)):
        assert sum(c >= least and len(w) <= hmm.LONG for w, c in data) <= most
    assert hmm.frequent(df, 9000) == [1]


def test_scores_of_odd_documents(spark, odd, none):
    got = rows(hmm.score(odd, rounds=1))
    assert len(got) == odd.count() and hmm.score(none, rounds=1).count() == 0
    train = [t for i, t in ((r.doc_id, r.text) for r in odd.collect()) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts: dict[bytes, int] = {}
    for t in train:
        for w in hmm.tokens(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text_of = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        words = hmm.tokens(text_of[r["doc_id"]])
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n and r["n_known"] == sum(w in counts for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_hidden_states_beat_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ba be bi bo bu".split(), "ka ke ki ko ku".split()][i % 2]) for _ in range(60)) for i in range(300)]
    got = rows(hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), states=4, rounds=2).filter("held_out"))
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got) and len(got) > 10
    assert all(r["score"] > r["base_score"] for r in got)


# -------------------------------------------------------------------------------------------------------- 2: tokeniser


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(odd, none, reference_encoding):
    text_of = {r.doc_id: r.text or "" for r in odd.collect()}
    got = rows(bpe.digests(odd, RANKS, public_tokenizers.PATTERN))
    assert len(got) == odd.count()
    for r in got:
        t = text_of[r["doc_id"]]
        ids = reference_encoding.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(t.encode()).hexdigest(),
        )
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_random_texts_encode_as_the_ranks_say(reference_encoding):
    rng, encoder, tok = random.Random(1), bpe.unit_encoder(RANKS, public_tokenizers.PATTERN), bpe.build(RANKS, public_tokenizers.PATTERN)
    for _ in range(4000):
        t = "".join(rng.choice("aaab  \n\t1'sé€😀\u0085 　lll中国-.\x1c\x00 ") for _ in range(rng.randint(0, 40)))
        want = reference_encoding.encode_ordinary(t)
        assert encoder([t])[0].tolist() == want == tok.encode(t, add_special_tokens=False).ids


def test_offsets_and_split_characters(spark):
    df = spark.createDataFrame([(1, "a 😀 né")], "doc_id long, text string")
    r = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, offsets="at", round_trip="same"), RANKS).first()
    assert r.same and bytes(r.decoded).decode() == r.text and r["at"][-1]["end"] == len(r.text)
    assert "".join(bpe.pieces(r.ids, RANKS)) == r.text
    clash = bpe.encode(df.withColumn("IDS", F.lit(1)), RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "ids"] and clash.first().ids == r.ids


# ------------------------------------------------------------------------------------------------------------ 3: top k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (400, 6)).round(2)
    x[50:80] = x[50]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (1000, None),
        (1001, [None] * 6),
        (1002, [math.inf] * 6),
        (None, x[0].tolist()),
        (1003, []),
        (7, x[9].tolist()),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {
        (r.query_id, r["rank"]): (r.vec_id, r.score)
        for r in threshold.top_k(df, F.col("vec_id") % 50 == 0, candidates=64, queries=3).collect()
    }
    whole = [
        (i, np.floor(256 * np.array(v)))
        for i, v in data
        if i is not None and v and all(y is not None and math.isfinite(y) for y in v)
    ]
    for q, v in whole:
        if q % 50 == 0:
            best = sorted(((i, int(u @ v)) for i, u in whole if i != q), key=lambda z: (-z[1], z[0]))[:5]
            assert [got[q, k + 1] for k in range(5)] == best
    assert threshold.top_k(df.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame(
        [(50, [1.0, 2.0], "x")] * 300 + [(7, [1.0, 1.0], "x")] * 300,
        "vec_id long, embedding array<double>, score string",
    )
    assert {
        (r["rank"], r.vec_id, r.score)
        for r in threshold.top_k(one, F.col("vec_id") % 50 == 0, candidates=16, queries=8).collect()
    } == {(i, 7, 3 * 65536) for i in range(1, 6)}


def test_the_bound_stops_early():
    rng = np.random.default_rng(2)
    lists = threshold.Lists(np.arange(5000), np.abs(rng.normal(0, 100, (5000, 2))).round())
    _, _, made = lists.best(np.array([-1]), np.array([[100.0, 1.0]]))
    assert made < 1000


# ------------------------------------------------------------------------------------------------------------- 4: mix


def test_mix_meets_targets(spark, odd, none):
    rng = random.Random(4)
    data = [(i, "w " * (1 + int(rng.paretovariate(1.2) * 5) % 900), rng.choice(["a", "b", "c", None, "d"])) for i in range(3000)]
    got = rows(mixing.report(spark.createDataFrame(data, "doc_id long, text string, source string")))
    source = {i: s for i, _, s in data}
    sums, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sums[s], taken[s], target[s] = sums.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    weights = dict(zip(["a", "b", "c", "d", None], (3, 1, 2, 3, 1)))
    left, free, want = 1.5 * sum(sums.values()), set(sums), {}
    while free:
        over = [s for s in free if left * weights[s] / sum(weights[f] for f in free) > 2 * sums[s]]
        for s in over or list(free):
            want[s] = 2.0 * sums[s] if over else left * weights[s] / sum(weights[f] for f in free)
        if not over:
            break
        left -= sum(want[s] for s in over)
        free -= set(over)
    assert target == pytest.approx(want)
    assert taken == pytest.approx(want, rel=0.01)
    assert mixing.report(odd).count() == odd.count() and mixing.report(none).count() == 0


def test_rates_are_the_optimum_of_a_plain_solver(spark):
    rng = random.Random(20)
    data = [(s, rng.uniform(0.05, 1.95), c, rng.randint(0, 5000)) for s in "abcdef" for c in range(1, 12)]
    size = {s: sum(w for t, _, _, w in data if t == s) for s in "abcdef"}
    share = {s: next(g for t, g, _, _ in data if t == s) for s in "abcdef"}
    rows_ = [(s, share[s] * size[s], c, w) for s, _, c, w in data]
    mean = sum(c * w for _, _, c, w in rows_) / sum(w for _, _, _, w in rows_)
    got = {
        (r.source, r["class"]): r.rate
        for r in mixing.balance(spark.createDataFrame(rows_, "source string, goal double, class int, words long"), mean).collect()
    }
    for s in "abcdef":
        w = np.array([x for t, _, _, x in rows_ if t == s], float)
        d = np.array([c for t, _, c, _ in rows_ if t == s]) - mean
        chance = lambda a, m: 1 / (1 + np.exp(-(a + m * d)))

        def level(m):
            low, high = -60.0, 60.0
            for _ in range(200):
                a = (low + high) / 2
                low, high = (a, high) if 2 * (w * chance(a, m)).sum() < share[s] * w.sum() else (low, a)
            return low

        low, high = -20.0, 20.0
        for _ in range(200):  # what speaks against the lean grows with it
            m = (low + high) / 2
            low, high = (m, high) if (w * chance(level(m), m) * d).sum() + mixing.SOFT * w.sum() * m < 0 else (low, m)
        p = chance(level(low), low)
        mine = np.array([got[s, c] for t, _, c, _ in rows_ if t == s]) / 2
        assert np.allclose(mine, p, atol=1e-6)
        cost = lambda q: (
            w * (q * np.log(q) + (1 - q) * np.log1p(-q))
        ).sum() + (w * q * d).sum() ** 2 / (2 * mixing.SOFT * w.sum())
        for _ in range(30):  # no other rates that take the target cost less
            step = np.random.default_rng(rng.randrange(10**6)).normal(size=len(w)) * 1e-3
            step -= w * (step @ w) / (w @ w)
            assert cost(np.clip(mine + step, 1e-9, 1 - 1e-9)) >= cost(mine) - 1e-6
    assert max(got.values()) - min(got.values()) > 0.5


def test_rows_without_ids_and_repeated_rows_are_dealt_out(spark):
    data = [(None, "w " * 7, "a")] * 6000 + [(5, "w " * 9, "a")] * 6000 + [(i, "w " * (1 + i % 30), "b") for i in range(10, 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = rows(mixing.report(df))
    assert len(got) == len(data) and {r["taken"] for r in got if r["doc_id"] is None} <= {0, 7, 14}
    assert sum(r["doc_id"] == 5 for r in got) == 6000 and all(r["size"] == 9 for r in got if r["doc_id"] == 5)
    for size in {r["source_size"] for r in got}:
        of = [r for r in got if r["source_size"] == size]
        assert sum(r["taken"] for r in of) == pytest.approx(of[0]["target"], rel=0.005)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    data = [(i, "w " * (1 + i % 40), f"s{i % 9}") for i in range(900)]
    got = rows(mixing.report(spark.createDataFrame(data, "doc_id long, text string, source string")))
    assert len(got) == 900 and sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.01)


def test_reruns_agree(odd):
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows(mixing.report(odd)))) == sorted(map(key, rows(mixing.report(odd.repartition(7)))))


# ------------------------------------------------------------------------------------------------------------- 5: urls


def test_captures_are_judged_as_of_their_day(spark):
    entries = spark.sql(
        "SELECT * FROM VALUES ('bad.com', 'add', DATE'2024-01-10'), ('bad.com', 'remove', DATE'2024-02-10'), ('x.bad.com', 'add', DATE'2024-02-01'), (null, 'add', DATE'2024-01-01'), ('odd.org', 'add', DATE'2024-01-05'), ('odd.org', 'remove', DATE'2024-01-05') AS t(pattern, action, dated)"
    )
    urls = [
        "http://x.bad.com/a",
        "HTTPS://u:p@BAD.com:80/",
        "http://notbad.com",
        "http://odd.org",
        None,
        "",
        "nonsense",
        "http://x.bad.com/a",
    ]
    days = ["2024-01-09", "2024-01-10", "2024-02-09", "2024-02-10", None]
    data = [(u, d) for u in urls for d in days]
    got = rows(urlfilter.evaluate(spark.createDataFrame(data, "url string, d string").withColumn("fetch_day", F.to_date("d")), entries))
    assert len(got) == len(data)
    for r in got:
        host = (re.match(r"(?i)https?://(?:[^/@]*@)?([^/:]+)", r["url"] or "") or [None, ""])[1].lower()
        under = host == "bad.com" or host.endswith(".bad.com")
        want = None
        if r["d"]:
            if under and "2024-01-10" <= r["d"] < "2024-02-10":
                want = "bad.com"
            if (host == "x.bad.com") and r["d"] >= "2024-02-01":
                want = "x.bad.com"
        assert (r["blocked"], r["pattern"]) == (want is not None, want)


def test_any_date_is_judged(spark):
    entries = spark.sql(
        "SELECT * FROM VALUES ('bad.com', 'add', DATE'2024-01-10'), ('old.com', 'add', DATE'1950-01-01'), ('old.com', 'remove', DATE'2150-01-01'), ('late.com', 'add', DATE'2200-05-05') AS t(pattern, action, dated)"
    )
    data = [
        (f"http://a.{h}/", d)
        for h in ("bad.com", "old.com", "late.com")
        for d in ("1949-12-31", "1950-01-01", "2100-02-01", "2149-12-31", "2150-01-01", "2200-05-04", "2200-05-05", "9999-12-31")
    ]
    got = rows(urlfilter.evaluate(spark.createDataFrame(data, "url string, d string").withColumn("fetch_day", F.to_date("d")), entries))
    held = {"a.bad.com": ("2024-01-10", "99999"), "a.old.com": ("1950-01-01", "2150-01-01"), "a.late.com": ("2200-05-05", "99999")}
    assert len(got) == len(data) and all(r["blocked"] == (held[r["host"]][0] <= r["d"] < held[r["host"]][1]) for r in got)


# ---------------------------------------------------------------------------------------------------------- 6: simhash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(spark, odd, none):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(200)) for _ in range(30)]
    texts = [*base, *(b + " tail" for b in base), *base[:5], "", None, "one two", "one two"]
    got = {
        r.doc_id: r
        for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    }
    fps = [plain_fingerprint(t) for t in texts]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == plain_components(range(len(fps)), links)
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


def test_shards_lose_no_link(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre} | {
        centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        for _ in range(300)
    } | {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = plain_components(sorted(fps), [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 3])
    for most in (4096, 40):  # whole shards, and shards cut into tiles
        found = {r.node % (1 << 64): r.component for r in components.components(simhash.link(df, most)).collect()}
        groups = lambda of: {frozenset(i for i in of if of[i] == c) for c in set(of.values())}
        assert groups(found) == {g for g in groups(want) if len(g) > 1}


def test_trees_find_what_is_near():
    rng, tree = random.Random(8), simhash.BKTree()
    values = [rng.getrandbits(12) for _ in range(400)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[n] for n in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_long_paths_are_one_component(spark):
    df = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.components(df).select("component").distinct().count() == 1
    assert components.components(df.filter("src < 0")).count() == 0


# --------------------------------------------------------------------------------------------------------- 7: licenses


def test_phrases_stand_where_they_stand(spark, odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    texts |= {
        100: "The GNU General Public License, version 3. apache-license Apache\nLicense mit licenses",
        101: "permission is HEREBY granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files",
    }
    more = spark.createDataFrame([(i, t) for i, t in texts.items() if i is not None and i >= 100], "doc_id long, text string")
    got = rows(licenses.scan(odd.select("doc_id", "text").unionByName(more)))
    assert len(got) == odd.count() + 2 and licenses.scan(none).count() == 0
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in got:
        w = re.findall(licenses.WORD, texts[r["doc_id"]].translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
        found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
    by = {r["doc_id"]: r for r in got}
    assert by[101]["labels"] == "mit" and by[101]["base_labels"] == "" and 0.8 < by[101]["score"] <= 1
    assert by[100]["labels"] == "apache,gpl"


def plain_labels(text, slack=licenses.SLACK, share=licenses.SHARE):
    """The labels and the score of a text, template by template, hit by hit."""
    w = re.findall(licenses.WORD, text.translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
    labels, score = set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, template in ((k, t) for k, ts in licenses.TEMPLATES.items() for t in ts):
        pairs = list(itertools.pairwise(template.split()))
        hits = [(i, j) for i, pair in enumerate(itertools.pairwise(w)) for j, other in enumerate(pairs) if pair == other]
        needed = math.ceil(share * len(pairs) - 1e-9)
        width = len(pairs) + slack * (len(pairs) - needed)
        spans, last = [], None
        for d in sorted({i - j for i, j in hits}):
            if last is None or d - last > slack:
                spans.append(set())
            spans[-1].add(d)
            last = d
        for span in spans:
            of = sorted(h for h in hits if h[0] - h[1] in span)
            best = 0
            for start, _ in of:
                chains = {}
                for i, j in (h for h in of if start <= h[0] < start + width):
                    chains[i, j] = 1 + max((n for (a, b), n in chains.items() if a < i and b < j), default=0)
                best = max(best, *chains.values())
            score = max(score, best / len(pairs))
            if best >= needed:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_added_labels_equal_a_plain_scan(spark):
    rng = random.Random(21)
    templates = [t.split() for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [
        "all rights all rights nothing else",
        "licensed under licensed under licensed under cc by",
        "gnu lesser gnu lesser general public",
        "reserved rights all",
        "all rights all rights reserved",
    ]
    for _ in range(250):
        w = list(rng.choice(templates)) * rng.choice([1, 1, 2])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 0, 1])] = rng.choice([["x"], [], ["y", "z"], w[at : at + 3], ["the", "license"]])
        if rng.random() < 0.2:
            rng.shuffle(w)
        texts.append(" ".join([*["pre"] * rng.randint(0, 3), *w, *rng.choice(templates)[: rng.randint(0, 5)]]))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        labels, score = plain_labels(t)
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(score, 9)), t
    assert all(got[i].labels == "" and got[i].score < 0.9 for i in range(4)) and got[4].labels == "proprietary"
    assert len({r.labels for r in got.values()}) > 8


# -------------------------------------------------------------------------------------------------------------- 8: pii

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True,
                "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark, odd, none):
    rng = random.Random(9)
    pieces = [
        "a@b.co", "x.y@z", "@", "1.2.3.4.5.6.7.8", "999.1.1.1", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "1 2 3", "+1 (234) 567-8901", "+12", "é", " ", "  ", "-", ".", "_", "a_b@c.d_e@f.gh", "00000000000000000000", "😀",
    ]
    texts = [r.text for r in odd.collect()] + [
        "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8)))
        for _ in range(400)
    ] + ["a" * 60_000, "1 2-3 " * 20_000, "1." * 20_000, "+1 " + "(" * 50_000]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t[:80], listed, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[2] for x in want) for k in KINDS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert pii.report(odd).count() == odd.count() and pii.report(none).count() == 0


def test_secrets_are_added_and_all_spans_masked(spark):
    rng = random.Random(10)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'word token = "{token()}" word' for _ in range(60)] + [
        f"mail me at user{i}@mail.example.com or call +1 (555) 010-{i:04d} now" for i in range(60)
    ] + ["supercalifragilisticexpialidocious words", "a_b_c_d_e_f_g_h_1_2_3_4"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, found string")
    clean = {r.doc_id: r.text for r in pii.redact(df.drop("found")).collect()}
    assert all("<SECRET>" in clean[i] for i in range(60))
    assert all(clean[i] == "mail me at <EMAIL> or call <PHONE> now" for i in range(60, 120))
    assert clean[120] == texts[120]


def mod97_made(country, rest):
    """An account number with the check digits that make it valid."""
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - value % 97:02d}{rest}"


def planted(rng, n):
    """(text, [(kind, what)]) of added kinds, and texts that only look like them."""
    draw = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    alnum, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    plain = "lorem ipsum dolor sit amet consectetur".split()
    out = []
    for _ in range(n):
        iban = mod97_made(rng.choice(["DE", "FR", "NL"]), draw(16, digits))
        grouped = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
        number = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        name = f"{rng.choice(['Anna', 'Peter', 'Zorblax'])} {rng.choice(['Miller', 'Garcia', 'Weber'])}"
        key, wrong = f"ghp_{draw(32, alnum)}", iban[:-1] + str((int(iban[-1]) + 1) % 10)
        w = lambda: " ".join(rng.choice(plain) for _ in range(rng.randint(2, 6)))
        out += [
            (f"{w()} IBAN: {iban}, {w()}", [("iban", iban)]), (f"{w()} account {grouped} {w()}", [("iban", grouped)]),
            (f"{w()} SSN {number} {w()}", [("national", number)]), (f"{w()} my name is {name}, {w()}", [("name", name)]),
            (f"{w()} token={key} {w()}", [("secret", key)]),
            (f"{w()} order 000-{draw(2, digits)}-{draw(4, digits)} {w()}", []), (f"{w()} section {wrong[:2]}{draw(12, digits)}x {w()}", []),
            (f"{w()} Dear reader, {w()}", []), (f"{w()} the_quick_brown_fox_jumps {w()}", []),
        ]
    return out


def test_added_kinds_are_found_and_little_else(spark):
    for n, least in ((60, 0.97), (1, 0.8)):  # a corpus, and a handful of documents
        data = planted(random.Random(22), n)
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
        got = {r.doc_id: r.spans for r in pii.report(df).collect()}
        want = {(i, f"{k}:{t.index(x)}:{t.index(x) + len(x)}") for i, (t, found) in enumerate(data) for k, x in found}
        have = {(i, s) for i, spans in got.items() for s in spans.split(",") if s and s.split(":")[0] not in pii.BASE}
        assert len(want & have) >= least * len(want), (n, sorted(want - have)[:5])
        assert len(want & have) >= 0.97 * len(have), (n, sorted(have - want)[:5])


def test_account_numbers_pass_their_check(spark):
    rng = random.Random(23)
    numbers = [
        mod97_made(c, "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.choice([8, 12, 16, 20]))))
        for c in ("DE", "GB", "NO")
        for _ in range(30)
    ]
    wrong = [x[:-1] + ("1" if x[-1] != "1" else "2") for x in numbers]
    df = spark.createDataFrame([(x,) for x in numbers + wrong + [f"{x[:4]} {x[4:8]} {x[8:]}" for x in numbers]], "s string")
    plain = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97 == 1
    got = df.select("s", pii.mod97(F.col("s")).alias("good")).collect()
    assert all(r.good == plain(r.s) for r in got) and sum(r.good for r in got) == 180


def test_reliabilities_follow_the_votes(spark):
    data = [("k", [1, 1, 1, 1], 50), ("k", [0, 0, -1, 0], 50), ("k", [1, 0, -1, 1], 5)]
    got = {
        tuple(r.votes): r.posterior
        for r in pii.reliabilities(spark.createDataFrame(data, "kind string, votes array<int>, n long")).collect()
    }
    assert got[1, 1, 1, 1] > 0.95 and got[0, 0, -1, 0] < 0.05


# ---------------------------------------------------------------------------------------------------------- 9: vectors


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate(
        [
            centres,
            centres + rng.normal(0, 0.06, centres.shape),
            centres + rng.normal(0, 0.06, centres.shape),
            np.repeat(centres[:1], 60, 0),
            centres[1] + rng.normal(0, 0.05, (90, 16)),
        ]
    )
    data = [(i, v.tolist(), i % 2 if i < 60 else 0) for i, v in enumerate(x)] + [
        (900, None, 0),
        (901, [0.0] * 16, 0),
        (902, [None] * 16, 0),
        (903, [math.nan] * 16, 0),
        (904, centres[0].tolist(), None),
        (905, [1.0, 2.0], 0),
        (None, centres[0].tolist(), 0),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([d[2] for d in data[: len(x)]])
    links = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    names = plain_components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(links))])
    for most in (1024, 30):  # whole buckets, and tiles
        got = {r.vec_id: r for r in pstable.near_duplicates(df, bucket_max=most).collect()}
        assert len(got) == len(data)
        assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
        assert {i: got[i].component_id for i in range(len(x))} == names
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905)) and not got[None].kept
    assert pstable.near_duplicates(df.filter("vec_id < 0")).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    a, b, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], lambda v: [x + 0.01 for x in v]
    data = [
        (5, a, 0),
        (5, b, 0),
        (1, near(a), 0),
        (2, near(a), 0),
        (3, a, 0),
        (4, near(b), 0),
        (9, a, 1),
        (9, a, 1),
        (30, [1e-170, 1e-171, 0.0], 0),
        (31, [1e200, 1e199, 0.0], 0),
        (32, [1.0, 0.1, 0.0], 0),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("x"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pstable.near_duplicates(df.repartition(3)).collect())
    # a, its two neighbours and its copy link; 1, 0.1, 0 links with them as well, at a cosine of 0.995.
    unit = [np.array(v) / max(map(abs, v)) for _, v, _ in data]
    cos = lambda u, v: float(u @ v / math.sqrt((u @ u) * (v @ v)))
    links = [[i != j and data[i][2] == data[j][2] and cos(unit[i], unit[j]) >= 0.98 for j in range(len(data))] for i in range(len(data))]
    part = plain_components(range(len(data)), [(i, j) for i in range(len(data)) for j in range(len(data)) if links[i][j]])
    want = []
    for i, (vec_id, _, _) in enumerate(data):
        name = min(data[j][0] for j in range(len(data)) if part[j] == part[i])
        want.append((vec_id, sum(links[i]), name, vec_id == name))
    assert got == sorted(want) and {r[1] for r in got if r[0] == 5} == {1, 6}


def test_recall_of_the_tables():
    assert pstable.recall() > 0.999


# --------------------------------------------------------------------------------------------------------- 10: toxicity


def test_held_out_accuracy(spark, odd, none):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        docs.append((i, " ".join([word() for _ in range(60)] + (["nastiest", "vileness"] if toxic else []))))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    right = [(got[i] >= 0.5) == (i % 8 == 0) for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) > 0.97 * len(right)
    model = toxicity.train(none, lab)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert all(r.score == 0 for r in toxicity.score(odd, toxicity.train(d, lab.filter("toxic = 5"))).collect())


def test_risk_and_boundary_equal_plain_versions():
    rng = np.random.default_rng(19)
    for prior in (0.05, 0.3, 0.9):
        for shift in (-3.0, 0.0, 3.0):
            zp, zu = rng.normal(1, 2, 12), rng.normal(shift, 2, 17)
            loss = lambda z, y: math.log1p(math.exp(-y * z))
            plain = lambda p, u: prior * sum(loss(z, 1) for z in p) / len(p) + max(
                0,
                sum(loss(z, -1) for z in u) / len(u) - prior * sum(loss(z, -1) for z in p) / len(p),
            )
            value, of_p, of_u = toxicity.risk(zp, zu, prior)
            assert value == pytest.approx(plain(zp, zu)) and value >= 0
            for z, slopes, at in ((zp, of_p, 0), (zu, of_u, 1)):
                for i in range(len(z)):
                    up, down = ([zp.copy(), zu.copy()] for _ in range(2))
                    up[at][i] += 1e-6
                    down[at][i] -= 1e-6
                    assert slopes[i] == pytest.approx((plain(*up) - plain(*down)) / 2e-6, abs=1e-6)
            cut = toxicity.boundary(zp, zu, prior)
            zero_one = lambda c: prior * np.mean(zp <= c) + max(0, np.mean(zu > c) - prior * np.mean(zp > c))
            assert zero_one(cut) <= min(zero_one(c) for c in [*zp, *zu, -99.0, 99.0, *(zp + 1e-9), *(zu - 1e-9)]) + 1e-9


def test_a_repeated_row_is_sampled_once(spark):
    docs = spark.createDataFrame([(1, "bad word")] * 500 + [(i, f"good word{i}") for i in range(2, 60)], "doc_id long, text string")
    sample = spark.createDataFrame(
        [(r.doc_id, r.h) for r in docs.selectExpr("doc_id", "xxhash64(text) h").distinct().collect()],
        "doc_id long, h long",
    )
    assert len(toxicity._featured(docs.selectExpr("doc_id", "text", "xxhash64(text) h"), sample)) == 59


def test_the_risk_is_not_negative_and_labels_are_no_input(spark):
    x = [np.array([1, 2], np.int32)] * 50
    model = toxicity.fit(x, [np.array([3], np.int32)] * 400 + x, 0.11)
    assert model.score(x[0]) > 0.5 > model.score(np.array([3], np.int32))


# ------------------------------------------------------------------------------------------------- queries, pipeline


def test_columns_with_clashing_names(spark):
    names = "score fp ids decoded found spans __text class rate copies target size content toxicity pattern host blocked since row".split()
    df = spark.createDataFrame(
        [(1, "mail a@b.co", "en", "s", 5), (2, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    df = df.select("*", *[F.lit("mine").alias(n) for n in names])
    model = toxicity.fit([np.array([1], np.int32)] * 9, [np.array([2], np.int32)] * 80, 0.1)
    assert toxicity.score(df, model).count() == 2 and toxicity.score(df, model).schema["score"].dataType.typeName() == "double"
    assert simhash.add_fingerprints(df).schema["fp"].dataType.typeName() == "long" and simhash.add_fingerprints(df).count() == 2
    clean = pii.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["mail <EMAIL>", None] and clean[0].found == clean[0].spans == "mine"
    assert mixing.report(df).count() == licenses.scan(df).count() == pii.report(df).count() == simhash.near_duplicates(df).count() == 2
    urls = df.select(
        "doc_id",
        F.lit("http://a.b.c").alias("url"),
        F.lit("2024-01-01").alias("fetch_day"),
        "pattern",
        "host",
        "blocked",
        "row",
    )
    assert urlfilter.evaluate(urls, spark.createDataFrame([], "pattern string, action string, dated date")).first().host == "a.b.c"


def test_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 13))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_the_oracle(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    df, found = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(
        (tuple(plain(r[c]) for c in names) for r in df.collect()),
        key=repr,
    ) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


def test_stages_ignore_further_columns(spark, tmp_path):
    import corpus_pipeline

    names = "content id c rows component copies copy size key band __row found spans toxicity ids".split()
    df = spark.createDataFrame(
        [(i, f"some words of text {i} mail a@b.co", "en", "s", 9) for i in range(9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    df = df.select("*", *[F.lit("mine").alias(n) for n in names])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() > 0, name
    assert corpus_pipeline.encode(spark, df, "").count() == 9


def test_pipeline(spark, tmp_path, none):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        docs.append(
            (
                i,
                " ".join([word() for _ in range(50)] + (["nastiest", "vileness"] if toxic else []) + (["a@b.co"] if i % 5 == 0 else [])),
                "en",
                f"s{i % 3}",
                300,
            )
        )
        labels.append((i, 1, int(toxic)))
    docs += [(700 + i, docs[i + 1][1], "en", "s1", 300) for i in range(20)] + [(None, None, None, None, None), (801, "", "en", None, 0)]
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text_of, now = {d[0]: d[1] for d in docs}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now.collect())
    calm, once, masked, mixed, coded = seen
    assert {r.doc_id for r in calm} >= {i for i in text_of if i is None or i % 6 or i >= 600} - {
        r
        for r in text_of
        if r and 700 <= r < 720 and (r - 699) % 6 == 0
    }
    assert sum(r.doc_id is not None and r.doc_id < 600 and r.doc_id % 6 == 0 for r in calm) <= 3
    kept = [plain_fingerprint(r.text) for r in once]
    assert all((a ^ b).bit_count() > 3 for a, b in itertools.combinations(kept, 2))
    assert {plain_fingerprint(r.text) for r in calm} <= {
        f
        for k in kept
        for f in {plain_fingerprint(r.text) for r in calm}
        if (f ^ k).bit_count() <= 3
    }
    assert len(masked) == len(once) and not any("a@b.co" in (r.text or "") for r in masked)
    times = {i: sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in masked}}
    assert set(times.values()) <= {0, 1, 2} and len(coded) == len(mixed) and all(r.round_trip for r in coded)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id = -1"), str(tmp_path)).count() == 0
