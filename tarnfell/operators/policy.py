"""Choosing retrieval actions from past cases, and searching parameters in stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import rules
from tarnfell.operators.lineage import cut


def good_cases(df: DataFrame, score: str = "score", correctness: str = "correctness") -> DataFrame:
    zero = F.lit(0.0)
    return df.filter((F.coalesce(score, zero) >= rules.CASE_SCORE) & (F.coalesce(correctness, zero) >= rules.CASE_CORRECT))


def action_rewards(df: DataFrame, action: Column, similarity: str, reward: str) -> DataFrame:
    """(action, weighted_reward, case_count, similarity_mass), best first: rewards weighted by similarity."""
    s, r = F.col(similarity), F.col(reward)
    rows = df.filter(action.isNotNull() & r.isNotNull() & (s > 0))
    out = rows.groupBy(action.alias("action")).agg(
        F.round(F.sum(s * r) / F.sum(s), 6).alias("weighted_reward"),
        F.count(F.lit(1)).alias("case_count"),
        F.round(F.sum(s), 6).alias("similarity_mass"),
    )
    return out.orderBy(F.desc("weighted_reward"), F.desc("similarity_mass"), "action")


def select_action(df: DataFrame, action: Column, similarity: str, reward: str, default: Any) -> Any:
    """The best action, or ``default`` without usable cases."""
    best = action_rewards(good_cases(df, similarity, reward), action, similarity, reward).first()
    return best["action"] if best else default


def summary(cases: DataFrame, action: Column, similarity: str, reward: str, default: str) -> DataFrame:
    """One row that can be audited: policy, selected action, number of similar cases, and all candidates, best first.

    Candidates are different actions: as many as the search over parameters has, whatever the number of cases.
    """
    good = good_cases(cases, similarity, reward)
    number = good.agg(F.count(F.lit(1)).alias("similar_case_count"))
    one = F.struct(
        (-F.col("weighted_reward")).alias("__r"),
        (-F.col("similarity_mass")).alias("__m"),
        "action",
        "weighted_reward",
        "case_count",
        "similarity_mass",
    )
    listed = action_rewards(good, action, similarity, reward).agg(F.array_sort(F.collect_list(one)).alias("c"))
    candidates = F.transform(
        "c",
        lambda c: F.struct(
            c["action"].alias("action"),
            c["weighted_reward"].alias("weighted_reward"),
            c["case_count"].alias("case_count"),
            c["similarity_mass"].alias("similarity_mass"),
        ),
    )
    rows = number.crossJoin(listed)  # one row each
    some = F.size("c") > 0
    policy_ = F.when(some, "similarity_weighted_reward").otherwise("default_no_similar_evaluated_cases")
    return rows.select(
        policy_.alias("policy"),
        F.when(some, F.get("c", F.lit(0))["action"]).otherwise(default).alias("selected_action"),
        "similar_case_count",
        candidates.alias("candidate_actions"),
    )


def staged_search(
    trial: Callable[[Mapping[str, Any]], float],
    start: Mapping[str, Any],
    stages: Sequence[tuple[str, Sequence[Any]]],
    prefer: Mapping[str, Any] | None = None,
) -> tuple[dict[str, Any], dict[tuple, float]]:
    """Coordinate descent: each stage tries the values of one parameter and keeps the best; no trial is run twice.

    Ties go to the value nearest to ``prefer``, then to the first.  A trial is one query; only its figure comes here.
    """
    prefer, best, seen = prefer or {}, dict(start), {}

    def run(params: Mapping[str, Any]) -> float:
        key = tuple(sorted(params.items()))
        if key not in seen:
            seen[key] = trial(params)
        return seen[key]

    for name, values in stages:
        def rank(i: int, v: Any, name: str = name) -> tuple:
            near = -abs(v - prefer[name]) if name in prefer else 0
            return run({**best, name: v}), near, -i

        best[name] = max(enumerate(values), key=lambda iv: rank(*iv))[1]
    return best, seen


def staged(
    start: DataFrame,
    question: str,
    stages: Sequence[tuple[Sequence[str], Sequence[Any]]],
    evaluate: Callable[[DataFrame], DataFrame],
    near: tuple[str, float],
) -> tuple[DataFrame, DataFrame]:
    """Coordinate descent for a whole table of questions, one job a stage: (the best action of each, all trials).

    ``start`` holds a question and its first action, one column a parameter.  A stage gives every question's best action
    each of its values, in all of its columns; ``evaluate`` adds ``figure`` to actions that weren't tried before, and null
    where there is none.  The largest figure wins; ties go to the value of ``near`` that is nearest to its figure, then to the
    first.  A stage without any figure changes nothing.
    """
    params = [c for c in start.columns if c != question]
    key = [question, *params]
    trials = cut(evaluate(start).select(*key, "figure"))
    best = trials
    for columns, values in stages:
        listed = F.posexplode(F.array(*[F.lit(v).cast(start.schema[columns[0]].dataType) for v in values])).alias("__at", "__v")
        rest = [c for c in key if c not in columns]
        variants = best.select(*rest, listed).select("*", *[F.col("__v").cast(start.schema[c].dataType).alias(c) for c in columns]).drop("__v")
        new = variants.select(key).distinct().join(trials, key, "left_anti")
        trials = cut(trials.unionByName(evaluate(new).select(*key, "figure")))
        order = F.struct(-F.col("figure"), F.abs(F.col(near[0]) - near[1]), "__at")
        won = variants.join(trials.filter("figure IS NOT NULL"), key).groupBy(question).agg(F.min_by(F.struct(*params, "figure"), order).alias("w"))
        met = best.join(won, question, "left")
        best = cut(met.select(question, *[F.when(F.col("w").isNull(), F.col(c)).otherwise(F.col(f"w.{c}")).alias(c) for c in (*params, "figure")]))
    return best, trials
