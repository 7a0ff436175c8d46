"""Jobs that were once cut short: small inputs on which the rest of the job shows."""

import itertools
import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tarnfell.llm import licenses, pii, similar, simhash, urlfilter  # noqa: E402

# -------------------------------------------------------------------------------------------- pipeline: near duplicates


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_duplicates_are_those_at_four_fifths(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 2, 3, 6):  # 3 edits are about 0.78, so some texts join by a third only
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = word()
            texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(40))}" for _ in range(25)]  # alike, but less than enough
    texts += [texts[0], texts[0].upper(), "a b", "A  b", None, "", " "]
    sets = [plain_shingles(t) for t in texts]
    name = {i: i for i in range(len(texts))}
    for i, j in itertools.combinations(name, 2):
        if alike(sets[i], sets[j]):
            a, b = name[i], name[j]
            name = {k: min(a, b) if v in (a, b) else v for k, v in name.items()}
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(name.values()))
    assert len(set(name.values())) < len(texts) - 50
    assert similar.recall() > 0.99999


def test_tiles_lose_no_link_and_one_of_equal_rows_stays(spark, monkeypatch):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(90)]
        for _ in range(60):  # edits of edits: long paths, and many pairs that are nearly alike enough
            base = list(base) if rng.random() < 0.7 else base
            w = list(base)
            for at in rng.sample(range(len(w)), rng.choice([0, 1, 1, 2, 3])):
                w[at] = word()
            texts.append(" ".join(w))
            base = w if rng.random() < 0.3 else base
    sets = [plain_shingles(t) for t in texts]
    name = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if name[i] != name[j] and alike(sets[i], sets[j]):
            low, high = sorted((name[i], name[j]))
            name = [low if k == high else k for k in name]
    for n in ("TILE", "MINOR", "OTHERS"):
        monkeypatch.setattr(similar, n, 7)
    monkeypatch.setattr(similar, "DEALT", 2)
    many = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(
        [*many, *many[:9], *many[:9], *[(None, "none here", None, None, None)] * 3],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(name)) and len(kept) == len(set(name)) + 1
    assert 4 < len(set(name)) < 150


def test_trees_give_the_nearest():
    rng = random.Random(17)
    values = [rng.getrandbits(256) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(256), rng.randint(0, 80))) for v in values]
    tree = simhash.BKTree()
    nodes = [tree.add(v) for v in values[:90]]
    for v in values:
        best = min((((v ^ u).bit_count(), n) for u, n in zip(values, nodes)), default=None)
        got = tree.nearest(v, 72)
        assert got == (best[1] if best[0] <= 72 else None) or (tree.values[got] ^ v).bit_count() == best[0]


# ------------------------------------------------------------------------------------------------- op5: parent domains


def test_every_parent_domain_is_looked_up(spark):
    deep = ".".join(f"l{i}" for i in range(120))
    hosts = ["a.b.c.d.e.f.example.com", "a.b.c.d.e.f.g.h.example.com", f"{deep}.example.com", "a.b.c.d.e.f.g.example.org", "example.com"]
    captures = spark.createDataFrame(
        [(i, f"http://{h}/x", "2024-02-01") for i, h in enumerate(hosts)],
        "page_id long, url string, fetch_day string",
    )
    entries = spark.createDataFrame([("example.com", "add", "2024-01-01")], "pattern string, action string, dated string")
    got = {r.page_id: (r.blocked, r.pattern) for r in urlfilter.evaluate(captures, entries).collect()}
    assert got == {i: (h.endswith("example.com"), "example.com" if h.endswith("example.com") else None) for i, h in enumerate(hosts)}


# --------------------------------------------------------------------------------------------------------- op8: secrets


def test_secrets_with_prefixes_and_mixed_case_are_masked(spark):
    rng = random.Random(15)
    draw = lambda n, of="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(of) for _ in range(n))
    makes = [
        lambda: f"ghp_{draw(32)}1234", lambda: f"gho_{draw(32)}1234", lambda: f"sk_live_{draw(20)}1234", lambda: f"pk_test_{draw(20)}1234",
        lambda: f"xoxb-{draw(12, '0123456789')}-{draw(20)}", lambda: f"eyJhbGciOiJIUzI1NiJ9.eyJ{draw(24)}12.{draw(20)}-_{draw(18)}9", lambda: f"{draw(30)}aZ4821",
    ]
    secrets = [make() for make in makes for _ in range(10)]
    texts = [f'word token = "{s}" word' for s in secrets] + [f"see counter_of_rows_seen_{i} in the text" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert [clean[i] for i in range(len(secrets))] == ['word token = "<SECRET>" word'] * len(secrets)
    assert [clean[i] for i in range(len(secrets), len(texts))] == texts[len(secrets) :]


# -------------------------------------------------------------------------------------------------------- op7: licenses


def test_a_part_of_a_license_repeated_is_not_the_whole(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    twenty = [f"v{i}" for i in range(21)]
    drift = " ".join(" ".join(twenty[i : i + 3]) + " x" * 40 for i in range(0, 20, 2))  # every place, far apart
    chain = " ".join(twenty[i] + " " + twenty[i + 1] + " y" for i in range(20)) + " z" * 9  # every place, a word or two put in at each
    put_in = " ".join([*twenty[:8], "a", "b", "c", *twenty[8:15], "d", "e", "f", *twenty[15:]])  # two places short, as allowed
    texts = [
        "all rights all rights",
        "public license public license public license public license",
        "all rights reserved",
        "the gnu lesser general public license",
        drift,
        put_in,
        f"{ten} q {ten}",
        chain,
    ]
    templates = {**licenses.TEMPLATES, "long": [" ".join(twenty)], "ten": [f"{ten} end of it"]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df, templates=templates).collect()}
    assert got[0] == ("", 0.5) and got[1] == ("", 0.25)
    assert got[2] == ("proprietary", 1.0) and got[3] == ("gpl,lgpl", 1.0)
    assert got[4][0] == "" and got[4][1] < 0.2 and got[5] == ("long", 0.9)
    assert got[6][0] == "" and got[6][1] == 0.75 and got[7][0] == ""


def test_only_the_last_stage_s_table_stays(spark, tmp_path):
    import glob

    from tarnfell.llm import scratch

    docs = [(i, f"text {i} of some words " * 9, "en", f"s{i % 2}", 9) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = scratch.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    was = set(glob.glob(f"{own}/*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    new = set(glob.glob(f"{own}/*")) - was
    left = [p for n in new for p in glob.glob(f"{n}/*")]
    assert len(new) == 1 and [p.rsplit("/", 1)[1] for p in left] == [corpus_pipeline.STAGES[-1][0]]
