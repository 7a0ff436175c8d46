"""Models behind interfaces: what generates, judges or embeds is injected and runs over Arrow batches; the defaults
need no network, so that pipelines can be tested."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import text, vectors

Generate = Callable[[Sequence[str]], Sequence[str]]


def echo() -> Generate:
    """The offline model: it says what it was told, shortened."""
    return lambda prompts: [f"echo: {p[:200]}" for p in prompts]


def with_retries(make: Callable[[], Generate], tries: int = 6, wait_s: float = 5.0) -> Callable[[], Generate]:
    """A client that is asked again after failures; the last failure is raised."""

    def made() -> Generate:
        client = make()

        def ask(prompts: Sequence[str]) -> Sequence[str]:
            for left in reversed(range(tries)):
                try:
                    return client(prompts)
                except Exception:
                    if not left:
                        raise
                    time.sleep(wait_s)
            return []

        return ask

    return made


def with_backoff(
    make: Callable[[], Generate],
    tries: int = 3,
    wait_s: float = 5.0,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[[], Generate]:
    """A client that waits when it is told that it asked too often, as long as the service says (and a second), else
    longer each time; every other failure is raised at once, and the last one of these as well."""

    def made() -> Generate:
        client = make()

        def ask(prompts: Sequence[str]) -> Sequence[str]:
            for i in range(tries + 1):
                try:
                    return client(prompts)
                except Exception as e:
                    if i == tries or not re.search("429|RESOURCE_EXHAUSTED", str(e)):
                        raise
                    said = re.search(r"(?i)retry in ([\d.]+)s", str(e))
                    sleep(float(said[1]) + 1.0 if said else wait_s * (i + 1))
            return []

        return ask

    return made


def topped_up(questions: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """``count`` questions: the first of them, or all and then the very first again as often as it takes."""
    some = questions.orderBy(*order).limit(count)
    n = some.count()
    if not n or n >= count:
        return some
    again = some.orderBy(*order).limit(1).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(count - n)))).drop("__again")
    return some.unionByName(again)


def generated(df: DataFrame, prompt: Column, name: str = "answer", make: Callable[[], Generate] = echo, batch: int = 64) -> DataFrame:
    """``df`` with a model's answer to each prompt, batch by batch; null prompts get null."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    rows = df.withColumn("__prompt", prompt)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            asked = frame["__prompt"]
            out = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            some = asked[asked.notna()]
            for a in range(0, len(some), batch):
                part = some.iloc[a : a + batch]
                out.loc[part.index] = list(client(part.tolist()))
            yield frame.drop(columns="__prompt").assign(**{name: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInPandas(run, f"{fields}, `{name}` string")


def embedded(
    df: DataFrame,
    body: Column,
    name: str = "embedding",
    make: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """``df`` with vectors: hashed words inside the JVM, or what an injected model gives."""
    if make is None:
        return df.withColumn(name, vectors.hash_embed(body))

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for t in texts:
            yield pd.Series(list(np.asarray(model(t.fillna("").tolist()), float)))

    return df.withColumn(name, embed(body))


def answer_relevancy(
    df: DataFrame,
    question: str,
    answer: str,
    name: str = "answer_relevancy",
    make: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """``df`` with how near each answer is to its question, from 0 to 1; null where one of them is blank.

    Each different pair is embedded once, however often it was logged.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    pairs = df.filter(said(question) & said(answer)).select(F.col(question).alias("__q"), F.col(answer).alias("__a")).distinct()
    pairs = embedded(embedded(pairs, F.col("__q"), "__qv", make), F.col("__a"), "__av", make)
    scored = pairs.select("__q", "__a", F.round(vectors.relevancy(vectors.cosine(F.col("__qv"), F.col("__av"))), 3).alias(name))
    return df.join(scored, (df[question] == F.col("__q")) & (df[answer] == F.col("__a")), "left").drop("__q", "__a")


def judged(df: DataFrame, answer: str, criteria: Sequence[str]) -> DataFrame:
    """``df`` with the judge's scores, one column a criterion: from JSON that may be fenced or cut off; missing is 0."""
    parsed = text.repaired_json(text.unfenced(F.col(answer)))
    scores = F.from_json(parsed, "map<string,string>")
    return df.withColumn("__s", scores).withColumns(
        {c: F.coalesce(F.element_at("__s", c).try_cast("int"), F.lit(0)) for c in criteria}
    ).drop("__s")


def routed(df: DataFrame, answer: str, slot: str) -> DataFrame:
    """Items of a batch answer by their index: (slot, question, answer); unknown indexes and blank fields are left out."""
    items = text.json_array(F.col(answer), "struct<index:string,question:string,answer:string>")
    rows = df.select(slot, F.size(slot).alias("__n"), F.explode(items).alias("i"))
    at = F.col("i.index").try_cast("int")
    good = rows.filter(
        at.between(0, F.col("__n") - 1)
        & (F.trim(F.coalesce("i.question", F.lit(""))) != "")
        & (F.trim(F.coalesce("i.answer", F.lit(""))) != "")
    )
    return good.select(F.get(slot, at).alias("slot"), "i.question", "i.answer")
