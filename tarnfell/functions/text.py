"""Column functions over text; all of them stay in the JVM but :func:`n_words`, :func:`char_chunks` and :func:`repaired_json`."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.functions import rules
from tarnfell.functions.binding import let

_BLANK, _string, _decoder = re.compile(r"[ \t\n\r]*"), json.decoder.scanstring, json.JSONDecoder()

#: White space of Unicode and the four separators U+001C to U+001F; spelt out, since classes by property are slow.
SPACE = r"[\t-\r\x1C-\x1F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether one of ``words`` is in ``text``, as a substring."""
    return text.rlike("|".join(re.escape(w) for w in words))


def words(text: Column) -> Column:
    """Lower-case words between white space (the ranking tokeniser)."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


@F.arrow_udf(T.IntegerType())
def n_words(text: pa.Array) -> pa.Array:
    """The number of :func:`words` of texts that aren't null; lower case leaves white space as it is."""
    return pa.array([len(t.split()) for t in text.to_pylist()], pa.int32())


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case (the graph's tokeniser)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    )


def tier(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """high, else low, else medium, by substring; null text is medium."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(any_of(low, keywords["high"]), "high").when(any_of(low, keywords["low"]), "low").otherwise("medium")


def sentences(text: Column, most: int = 12) -> Column:
    """The first sentences, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.slice(F.filter(parts, lambda s: s != ""), 1, most)


def topic_chunks(text: Column, topics: Mapping[str, Sequence[str]] = rules.TOPICS) -> Column:
    """One chunk a topic from its clauses, a general one from the others, then the whole text."""
    clauses = F.filter(F.transform(F.split(text, r"[.,;]\s*"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")

    def topic(s: Column) -> Column:
        found = F.lit("General")
        for name, keywords in reversed(topics.items()):
            found = F.when(any_of(F.lower(s), keywords), name).otherwise(found)
        return found

    tagged = F.transform(clauses, lambda s: F.struct(topic(s).alias("topic"), s.alias("clause")))

    def chunk(clauses: Column, name: Column) -> Column:
        own = F.transform(F.filter(clauses, lambda t: t["topic"] == name), lambda t: t["clause"])
        return let(own, lambda o: F.when(F.size(o) > 0, F.concat(name, F.lit(" info: "), F.array_join(o, ". "))))

    names = F.array(*[F.lit(t) for t in [*topics, "General"]])
    chunks = let(tagged, lambda clauses: F.transform(names, lambda name: chunk(clauses, name)))
    return F.concat(F.filter(chunks, lambda c: c.isNotNull()), F.array(text))


def char_chunks(size: int = 500, overlap: int = 100, separators: Sequence[str] = ("\n\n", "\n", ". ", "! ", "? ", ", ", " ", "")):
    """A UDF: text -> chunks of at most ``size`` characters, cut at the coarsest separator that serves.

    Texts go to Python a few at a time; a batch for Arrow would hold ten thousand whole texts and all their chunks.
    """

    def merge(parts: list[str]) -> list[str]:
        out, held, length = [], [], 0
        for p in parts:
            if held and length + len(p) > size:
                out.append("".join(held))
                while held and (length > overlap or length + len(p) > size):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        return [*out, "".join(held)] if held else out

    def cut(text: str, rest: Sequence[str]) -> list[str]:
        at = next((i for i, s in enumerate(rest) if not s or s in text), len(rest) - 1)
        sep, finer = rest[at], rest[at + 1 :]
        parts = list(text) if not sep else [p for i, p in enumerate(re.split(f"(?={re.escape(sep)})", text)) if p]
        out, fit = [], []
        for p in parts:
            if len(p) <= size:
                fit.append(p)
                continue
            out += merge(fit)
            fit = []
            out += cut(p, finer) if finer else [p]
        return out + merge(fit)

    def split(text: str | None) -> list[str]:
        return [c for c in (x.strip() for x in cut(text or "", separators)) if c] or [text or ""]

    return F.udf(split, T.ArrayType(T.StringType()), useArrow=False)


def first_of(text: Column, names: Sequence[str], default: str) -> Column:
    """The first of ``names`` that occurs in ``text``, in the order of the list."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for name in reversed(names):
        found = F.when(F.contains(low, F.lit(name)), name).otherwise(found)
    return found


def brand(text: Column, brands: Sequence[str] = tuple(rules.BRANDS)) -> Column:
    return first_of(text, brands, "unknown_brand")


def use_cases(text: Column, cases: Mapping[str, Sequence[str]] = rules.USE_CASES) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(any_of(low, keywords), F.lit(name)) for name, keywords in cases.items()]), lambda c: c.isNotNull())


def normalise(value: Column) -> Column:
    """An entity id that ignores spelling and case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), "nvidia geforce", ""), "geforce", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def spec_triplets(name: Column, text: Column, specs: Mapping[str, str] = rules.SPECS) -> Column:
    """Distinct (predicate, value) in the order in which the patterns stand and match."""
    low = F.lower(F.concat_ws(" ", name, text))
    squeezed = lambda m: F.regexp_replace(F.regexp_replace(m, r"\s+", " "), r"^\s+|\s+$", "")
    found = [F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), _pair(predicate, squeezed)) for predicate, p in specs.items()]
    return F.array_distinct(F.concat(*found))


def _pair(predicate: str, clean):
    return lambda m: F.struct(F.lit(predicate).alias("predicate"), clean(m).alias("value"))


def entity_type(predicate: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(predicate, "^HAS_", ""), "S$", "")


def tier_predicate(feature: Column) -> Column:
    return F.concat(F.lit("HAS_"), F.upper(F.element_at(F.split(feature, " "), 1)), F.lit("_TIER"))


def node_label(id_: Column, type_: Column, name: Column, tier_: Column, item: str = "Laptop") -> Column:
    """The name; else the tier, else the last part of the id (items: their name as it is, else the id)."""
    none = F.lit("")
    return F.when(type_ == item, F.coalesce(name, id_)).otherwise(
        F.coalesce(F.nullif(name, none), F.nullif(tier_, none), F.element_at(F.split(id_, "::"), -1))
    )


def verbalise(subject: Column, predicate: Column, object_: Column) -> Column:
    """A sentence for a triplet."""
    feature = F.initcap(F.translate(F.regexp_extract(predicate, "^HAS_(.*)_TIER$", 1), "_", " "))
    verb = F.when(predicate == "MADE_BY", "is made by").when(
        predicate == "SUITED_FOR",
        "is well suited for",
    ).when(predicate == "SIMILAR_TO", "is similar to").otherwise(F.lower(predicate))
    return (
        F.when(predicate.rlike("^HAS_.*_TIER$"), F.concat(subject, F.lit(" has "), object_, F.lit("-tier "), feature, F.lit(".")))
        .when(predicate == "IN_PRICE_BAND", F.concat(subject, F.lit(" falls in the "), object_, F.lit(" price band.")))
        .otherwise(F.concat(subject, F.lit(" "), verb, F.lit(" "), object_, F.lit(".")))
    )


# ------------------------------------------------------------------------------------------- requirements and answers


def requirement_sentence(text: Column) -> Column:
    """The canonical sentence, or null where the text doesn't hold one."""
    part = [F.regexp_extract(text, rules.REQUIREMENT, i) for i in range(1, 7)]
    low = [F.lower(p) for p in part[:5]]
    whole = F.format_string(
        "I need a laptop with %s GPU intensity, %s display quality, %s portability, %s multitasking, %s processing speed and a budget of %s.",
        *low,
        F.regexp_replace(part[5], ",", ""),
    )
    return F.when(text.rlike(rules.REQUIREMENT), whole)


def requirements(text: Column, dimensions: Sequence[str] = rules.DIMENSIONS) -> Column:
    """struct(tiers map, budget) from a question; null unless every dimension and a budget are there."""
    tiers = [F.lower(F.regexp_extract(text, rf"(?i)(low|medium|high)\s+{re.escape(d.lower())}", 1)) for d in dimensions]
    budget = F.regexp_replace(F.regexp_extract(text, r"(?i)budget of\s*([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    whole = budget.isNotNull()
    for t in tiers:
        whole = whole & (t != "")
    pairs = [x for d, t in zip(dimensions, tiers) for x in (F.lit(d), t)]
    return F.when(whole, F.struct(F.create_map(*pairs).alias("tiers"), budget.alias("budget")))


def sane_budget(budget: Column, text: Column, least: int = 25_000) -> Column:
    """The stated budget; where it is too small, the largest number in the text that isn't."""
    stated = F.coalesce(F.regexp_replace(budget.cast("string"), r"[,₹\s]", "").try_cast("long"), F.lit(0))
    seen = F.transform(F.regexp_extract_all(text, F.lit(r"[\d,]{5,}"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").try_cast("long"))
    return F.when(stated >= least, stated).otherwise(F.coalesce(F.array_max(F.filter(seen, lambda n: n >= least)), stated))


def sane_tier(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("medium")))
    return F.when(low.isin(*rules.TIERS), low).otherwise("medium")


def mentions_budget(text: Column, least: int = 1000) -> Column:
    """Whether a number of four characters or more reaches ``least`` (runs of commas alone don't)."""
    return F.exists(
        F.regexp_extract_all(text, F.lit(r"[\d,]{4,}"), F.lit(0)),
        lambda n: F.coalesce(F.regexp_replace(n, ",", "").try_cast("long") >= least, F.lit(False)),
    )


def picks(answer: Column) -> Column:
    """(name, price) of the numbered bold entries of an answer."""
    names, prices = (F.regexp_extract_all(answer, F.lit(rules.PICK), F.lit(g)) for g in (1, 2))
    made = F.zip_with(
        names,
        prices,
        lambda n, p: F.struct(F.trim(n).alias("name"), F.regexp_replace(p, ",", "").try_cast("double").alias("price")),
    )
    return F.filter(made, lambda x: x["price"].isNotNull())


def context_of(name: Column, contexts: Column) -> Column:
    """The first context that has 'name: <name>', else the first that has the name, else empty."""
    low = F.lower(F.trim(name))
    first = lambda test: F.get(F.filter(contexts, test), F.lit(0))
    return F.when(low == "", "").otherwise(
        F.coalesce(
            first(lambda c: F.contains(F.lower(c), F.concat(F.lit("name: "), low))),
            first(lambda c: F.contains(F.lower(c), low)),
            F.lit(""),
        )
    )


def clean_response(text: Column) -> Column:
    """A model's answer without its thinking, closed or cut off, and without its stock phrases."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    done = "...done thinking."
    last = F.element_at(F.split(text, re.escape(done)), -1)
    out = F.when(F.contains(text, F.lit("Thinking...")) & F.contains(text, F.lit(done)), strip(last)).otherwise(text)
    out = F.replace(F.replace(out, F.lit("Thinking..."), F.lit("")), F.lit(done), F.lit(""))
    out = strip(F.replace(out, F.lit("Alright,"), F.lit("")))
    out = strip(F.replace(out, F.lit("I'll"), F.lit("I will")))
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def unfenced(text: Column) -> Column:
    """JSON without the fence of its code block."""
    return F.trim(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def json_array(text: Column, schema: str) -> Column:
    """The JSON array in a text, or an empty one."""
    kind = f"array<{schema}>"
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), kind), F.array().cast(kind))


def load_object(text: str) -> dict:
    """The JSON object in a text, closed where it was cut off; ValueError if there is none.

    Members are read one after the other, each once.  Where the text ends after a member, or the object is closed, all of
    them count.  Where it goes on with something else, the object ends after its last member that is an object itself,
    else before the last comma that follows a whole member.
    """
    text = re.sub(r"(?s)<think>.*?</think>|<think>.*$", "", text.strip())
    begun = text.find("{")
    if begun < 0:
        raise ValueError("no object")
    skip = lambda i: _BLANK.match(text, i).end()
    found, ends, at = [], 0, skip(begun + 1)  # ends: members up to the last that is an object
    whole = text[at : at + 1] in ("", ",")  # a comma follows what is held so far, or nothing does
    if text[at : at + 1] == "}":
        return {}
    while text[at : at + 1] == '"':
        try:
            key, at = _string(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                break
            value, at = _decoder.raw_decode(text, skip(at + 1))
        except ValueError:
            break
        nested, at = text[at - 1] == "}", skip(at)
        after = text[at : at + 1]
        if after in ("", "}"):
            return dict([*found, (key, value)])
        if nested:
            ends = len(found) + 1
        if after != "," and not nested:
            break
        found.append((key, value))
        if after != ",":
            break
        whole, at = True, skip(at + 1)
    if ends:
        return dict(found[:ends])
    if not whole:
        raise ValueError("no object")
    return dict(found)


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """The object as canonical JSON, or null."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(load_object(t or ""), sort_keys=True)
        except ValueError:
            return None

    return texts.map(one)


def usable_questions(text: Column, most: int) -> Column:
    """Lines of a model's answer without their numbers, of more than 8 characters, that aren't errors."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[\d.)\-\s]+", "")))
    return F.slice(F.filter(lines, lambda s: (F.length(s) > 8) & ~s.startswith("Error:")), 1, most)


def transcript(messages: Column) -> Column:
    """The last system message, then the turns as User: and Assistant:, from an array of (turn, role, text)."""
    ordered = F.array_sort(messages)
    system = F.element_at(F.transform(F.filter(ordered, lambda m: m["role"] == "system"), lambda m: m["text"]), -1)
    said = F.transform(
        F.filter(ordered, lambda m: m["role"].isin("user", "assistant")),
        lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"]),
    )
    none = F.array().cast("array<string>")
    has = F.exists(messages, lambda m: m["role"] == "system")
    return F.array_join(F.concat(F.when(has, F.array(system)).otherwise(none), said), "\n\n")


# --------------------------------------------------------------------------------------------------------- prices


def price_band(price: Column, bands: Sequence[tuple[str, float]] = rules.PRICE_BANDS) -> Column:
    out = F.when(price.isNull() | F.isnan(price.cast("double")) | (price < 0), "flagship")
    for name, upper in bands:
        out = out.when(price < upper, name)
    return out.otherwise("flagship")


def budget_tier(price: Column, low_upper: Column, medium_upper: Column) -> Column:
    return F.when(price <= low_upper, "low").when(price <= medium_upper, "medium").otherwise("high")


def limit(budget: Column) -> Column:
    """A budget of nought, or none, is no limit."""
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, F.lit(rules.UNLIMITED)).otherwise(budget)


def combo_key(tiers: Sequence[Column], budget: Column, dimensions: Sequence[str] = rules.DIMENSIONS) -> Column:
    parts = [F.concat(F.lit(f"{d}:"), F.lower(F.coalesce(t, F.lit("medium")))) for d, t in zip(dimensions, tiers)]
    return F.concat_ws("|", *parts, F.concat(F.lit("Budget:"), budget))


def price_closeness(price: Column, target: Column, low: Column, high: Column) -> Column:
    return F.greatest(
        F.lit(0.0),
        1 - F.abs(F.coalesce(price, F.lit(0.0)) - F.coalesce(target, F.lit(0.0))) / F.greatest(high - low, F.lit(1.0)),
    )


def correctness(agreement: Column, ceiling: Column, closeness: Column, fields: int = 5) -> Column:
    top = F.coalesce(F.nullif(ceiling, F.lit(0)), F.lit(fields))
    return rules.FIELD_WEIGHT * F.least(F.lit(1.0), agreement / top) + rules.PRICE_WEIGHT * closeness


def price_digits(text: Column) -> Column:
    """All digits of a price text as one number."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("long")


def bare_name(name: Column) -> Column:
    """A product name without the parenthesis at its end, unless nothing else is there."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")), F.lit("")), name)


def title_matches(query: Column, title: Column, least: float = 0.45) -> Column:
    q, t = F.array_distinct(terms(query)), F.array_distinct(terms(F.coalesce(title, F.lit(""))))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q) >= least).otherwise(F.lit(False))


def turn_key(*parts: Column | str) -> Column:
    """A short stable key of a scored turn."""
    told = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.substring(F.sha2(F.to_json(F.array(*told)), 256), 1, 20)


def batch_size(batch: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(batch / F.greatest(F.lit(1), n)).cast("int"))


# ------------------------------------------------------------------------------------- messages, keys, prompts


def clipped(parts: Column, most: int, size: int) -> Column:
    """The first parts that aren't blank, each cut to a size, as prompts take them."""
    return F.transform(F.slice(F.filter(parts, lambda p: F.trim(p) != ""), 1, most), lambda p: F.substring(p, 1, size))


def content_text(content: Column) -> Column:
    """The text of a message's content (JSON): a string, or a list of strings and of blocks that have a text.

    What isn't JSON is the text itself; null is empty.
    """
    whole = F.from_json(F.concat(F.lit('{"c":'), content, F.lit("}")), "c string")["c"]
    blocks = F.from_json(content, "array<string>")

    def block(b: Column) -> Column:
        return F.when(b.startswith("{"), F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b)

    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b.isNotNull()), block), "")
    return F.when(content.isNull(), "").when(
        F.ltrim(content).startswith("["),
        F.coalesce(listed, content),
    ).when(F.ltrim(content).startswith('"'), F.coalesce(whole, content)).otherwise(content)


def canonical_json(values: Column) -> Column:
    """A map as JSON with its keys in order, so that equal maps are equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def grid_sentence(tiers: Column, budget_tier_: Column, dimensions: Sequence[str] = rules.DIMENSIONS) -> Column:
    """The requirement of a combination, from its tiers (a map by dimension) and the tier of its budget."""
    parts = [F.concat(tiers[d], F.lit(" " + (d if d.split()[0].isupper() else d.lower()))) for d in dimensions]
    return F.concat(F.lit("I need a laptop with "), F.concat_ws(", ", *parts), F.lit(", and a "), budget_tier_, F.lit(" budget."))


def flagged(verdict: Column) -> Column:
    """Whether the moderator's JSON says so; anything that can't be read doesn't."""
    return F.coalesce(F.get_json_object(verdict, "$.flagged") == "true", F.lit(False))


def confirmed(verdict: Column, reply: Column) -> Column:
    """Whether all requirements are there: the model's JSON says so, and the reply names a budget."""
    return F.coalesce(
        F.get_json_object(verdict, "$.all_captured") == "true",
        F.lit(False),
    ) & F.coalesce(mentions_budget(reply), F.lit(False))
