"""The traps of the functions, against small examples worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tarnfell.functions import rules, text, vectors
from tarnfell.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("price", "band"),
    [
        (0, "budget"),
        (49_999, "budget"),
        (50_000, "mid"),
        (99_999, "mid"),
        (200_000, "flagship"),
        (-1, "flagship"),
        (None, "flagship"),
        (float("nan"), "flagship"),
    ],
)
def test_price_bands_are_half_open(spark, price, band):
    assert value(spark, text.price_band(F.lit(price).cast("double"))) == band


@pytest.mark.parametrize(
    ("said", "tier"),
    [
        ("an RTX 4090 card", "high"),
        ("Intel UHD", "low"),
        ("rtx 3050", "medium"),
        ("", "medium"),
        (None, "medium"),
        ("rtx 4090 and intel uhd", "high"),
    ],
)
def test_tiers_look_for_high_first(spark, said, tier):
    assert value(spark, text.tier(F.lit(said).cast("string"), rules.KEYWORDS["GPU intensity"])) == tier


def test_topic_chunks_split_at_every_dot(spark):
    assert value(spark, text.topic_chunks(F.lit("Weighs 1.5 kg, RTX 3060; nice"))) == [
        "GPU info: RTX 3060",
        "Portability info: 5 kg",
        "General info: Weighs 1. nice",
        "Weighs 1.5 kg, RTX 3060; nice",
    ]


def test_sentences(spark):
    assert value(spark, text.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert value(spark, text.sentences(F.lit(". ".join("abcdefghijklmnop")), 12))[-1] == "l."


def test_the_first_listed_brand_wins_even_within_words(spark):
    assert value(spark, text.brand(F.lit("a chpx by Lenovo"))) == "hp"
    assert value(spark, text.brand(F.lit(None).cast("string"))) == "unknown_brand"


def test_specs(spark):
    found = value(spark, text.spec_triplets(F.lit("X"), F.lit("NVIDIA GeForce RTX  3060, 16 GB RAM, 512GB SSD, 144 Hz, 2.3 kg, 144 Hz")))
    assert [tuple(r) for r in found] == [
        ("HAS_GPU", "nvidia geforce rtx 3060"),
        ("HAS_RAM", "16 gb ram"),
        ("HAS_STORAGE", "512gb ssd"),
        ("HAS_REFRESH_RATE", "144 hz"),
        ("WEIGHS", "2.3 kg"),
    ]
    assert value(spark, text.entity_type(F.lit("WEIGHS"))) == "WEIGH"
    assert value(spark, text.normalise(F.lit("NVIDIA GeForce RTX 3060 "))) == "rtx_3060"
    assert value(spark, text.tier_predicate(F.lit("Processing speed"))) == "HAS_PROCESSING_TIER"


def test_sentences_of_triplets(spark):
    say = lambda s, p, o: value(spark, text.verbalise(F.lit(s), F.lit(p), F.lit(o)))
    assert say("A", "HAS_GPU_TIER", "high") == "A has high-tier Gpu."
    assert say("A", "IN_PRICE_BAND", "mid") == "A falls in the mid price band."
    assert say("A", "HAS_CHUNK", "b") == "A has_chunk b."


def test_requirements(spark):
    q = "I need a laptop with High GPU intensity, low display quality, low portability, medium multitasking, high processing speed and a budget of 85,000"
    assert value(spark, text.requirement_sentence(F.lit(q))).endswith("high processing speed and a budget of 85000.")
    r = value(spark, text.requirements(F.lit(q)))
    assert r["budget"] == 85000 and r["tiers"]["GPU intensity"] == "high"
    assert value(spark, text.requirements(F.lit("high gpu intensity, budget of 5"))) is None
    assert value(spark, text.sane_budget(F.lit("12"), F.lit("about 60,000 or 75,000"))) == 75000
    assert value(spark, text.mentions_budget(F.lit("1,,,, and ,,,,"))) is False
    assert value(spark, text.mentions_budget(F.lit("up to 2,500"))) is True


def test_answers(spark):
    a = "## Top\n\n1. **Foo X** — ₹54,999.50\n2. **Bar** - 1000\n3. **Bad** — ₹,\n"
    assert [tuple(p) for p in value(spark, text.picks(F.lit(a)))] == [("Foo X", 54999.5), ("Bar", 1000.0)]
    contexts = F.array(F.lit("has foo inside"), F.lit("Name: Foo, fine"))
    assert value(spark, text.context_of(F.lit(" Foo "), contexts)) == "Name: Foo, fine"
    assert value(spark, text.context_of(F.lit(""), contexts)) == ""
    assert value(spark, text.clean_response(F.lit("<think>a\nb</think>Alright, I'll go\n\n\n\nnow <think>cut"))) == "I will go\n\nnow"
    assert value(
        spark,
        text.usable_questions(F.lit("1. What is it?\n2) short\nError: no\n3 - Where is the thing?"), 5),
    ) == ["What is it?", "Where is the thing?"]


def test_json(spark):
    assert text.load_object('noise {"a": 1, "b": "x') == {"a": 1}
    assert text.load_object('```json\n{"a": {"b": 2}}\n```') == {"a": {"b": 2}}
    with pytest.raises(ValueError):
        text.load_object("nothing")
    assert value(spark, text.json_array(F.lit('say [{"k": 1}] ok'), "struct<k:int>"))[0]["k"] == 1
    assert value(spark, text.json_array(F.lit("no"), "struct<k:int>")) == []


def test_prices_and_titles(spark):
    assert value(spark, text.price_digits(F.lit("₹54,999.00"))) == 5499900
    assert value(spark, text.price_digits(F.lit("none"))) is None
    assert value(spark, text.bare_name(F.lit("Foo 5 (i7/ 16GB)"))) == "Foo 5"
    assert value(spark, text.bare_name(F.lit("(all)"))) == "(all)"
    assert value(spark, text.title_matches(F.lit("Foo Bar 5"), F.lit("the FOO 5"))) is True
    assert value(spark, text.title_matches(F.lit("--"), F.lit("x"))) is False


def test_correctness(spark):
    score = lambda a, c, p: value(spark, text.correctness(F.lit(a), F.lit(c), F.lit(p)))
    assert score(3, 3, 1.0) == pytest.approx(1.0)
    assert score(3, None, 0.0) == pytest.approx(0.42)
    assert score(3, 0, 0.0) == pytest.approx(0.42)
    assert value(spark, text.price_closeness(F.lit(10.0), F.lit(20.0), F.lit(0.0), F.lit(100.0))) == pytest.approx(0.9)


def test_tokenisers(spark):
    assert value(spark, text.words(F.lit("A b  C"))) == ["a", "b", "c"]
    assert value(spark, text.terms(F.lit("RTX-3060 é9"))) == ["rtx", "3060", "9"]
    assert value(spark, text.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a b", "b c"]


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, vectors.unit(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert value(spark, vectors.fit_width(a, 3)) == [3, 4, 0]
    assert value(spark, vectors.relevancy(F.lit(-2.0))) == 0
    assert sum(x * x for x in value(spark, vectors.hash_embed(F.lit("red widget")))) == pytest.approx(1)
    assert set(value(spark, vectors.hash_embed(F.lit("")))) == {0.0}


def test_char_chunks(spark):
    long = "word " * 300
    chunks = spark.range(1).select(text.char_chunks(100, 20)(F.lit(long)).alias("c")).first()["c"]
    assert max(map(len, chunks)) <= 100 and len(chunks) > 15
    assert spark.range(1).select(text.char_chunks()(F.lit("")).alias("c")).first()["c"] == [""]


def test_transcript(spark):
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text"))
            for t, r, x in ((2, "assistant", "yo"), (0, "system", "be"), (1, "user", "hi"), (3, "tool", "no"))
        ]
    )
    assert value(spark, text.transcript(rows)) == "be\n\nUser: hi\n\nAssistant: yo"


def test_an_object_is_read_in_one_pass():
    cases = {
        '{"a": 1, "b": {"c": 2': {"a": 1},
        '{"a": {"b": 1} x': {"a": {"b": 1}},
        '{"a": {"b": 1}, "c": 5, "d": tru': {"a": {"b": 1}},
        '{"z": 0, "a": 1 garbage, "b": 2}': {"z": 0},
        '{"a": 12': {"a": 12},
        '{"a": 1} and {"b": 2}': {"a": 1},
        '{"a": "x, y}", "b": [1, {"c": 2}': {"a": "x, y}"},
        '<think>{"n": 0}</think>{"a": 1,': {"a": 1},
        "{": {},
        "{,": {},
    }
    for said, want in cases.items():
        assert text.load_object(said) == want, said
    for said in ('{"a": ', '{"a', '{"a": {"b": 1, "c": 2', "{x", '{"a" , "b": 1}'):
        with pytest.raises(ValueError):
            text.load_object(said)
    members = ", ".join(f'"k{i}": "{"x, y} " * 20}"' for i in range(20_000))  # three megabytes of commas and braces
    assert len(text.load_object("{" + members + ', "cut": "of')) == 20_000


def test_a_json_map_may_have_lines(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{\n  "a": 1,\n  "b": 2\n}\n')
    assert {r.key: r.value for r in readers.json_map(spark, str(tmp_path), "int").collect()} == {"a": 1, "b": 2}


def test_texts_to_be_cut_go_to_python_a_few_at_a_time(spark):
    rows = spark.createDataFrame([(1, None), (2, "a. " * 400)], "id int, said string").select("id", text.char_chunks()(F.col("said")).alias("c"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [len(r.c) > 1 for r in rows.sort("id").collect()] == [False, True]
