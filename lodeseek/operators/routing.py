"""Provider choice per task, as lookups over an availability table."""

from __future__ import annotations

from typing import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.config import FALLBACK_PROVIDER, PROVIDER_HINTS, TASK_PROVIDER
from lodeseek.functions.text import col_of


def wanted_provider(task, hint) -> Column:
    """A known hint wins; else the task's default; unknown tasks use the summary default."""
    t, h = col_of(task), col_of(hint)
    default = F.coalesce(*(F.when(t == k, F.lit(v)) for k, v in TASK_PROVIDER.items()), F.lit(TASK_PROVIDER["summary"]))
    return F.when(h.isin(*PROVIDER_HINTS), h).otherwise(default)


def resolve_provider(task, hint, available: Mapping[str, bool]) -> Column:
    """The wanted provider when available, else the fallback; null when neither is."""
    usable = F.array(*(F.lit(p) for p, ok in available.items() if ok)) if any(available.values()) else F.array().cast("array<string>")
    wanted = wanted_provider(task, hint)
    fallback = F.when(F.array_contains(usable, FALLBACK_PROVIDER), F.lit(FALLBACK_PROVIDER))
    return F.when(F.array_contains(usable, wanted), wanted).otherwise(fallback)


def planned_providers(hint) -> Column:
    """Struct of the summary and code providers for a hint."""
    return F.struct(wanted_provider(F.lit("summary"), hint).alias("summary"),
                    wanted_provider(F.lit("code"), hint).alias("code"))


def used_models(summary_provider, code_provider, models: Mapping[str, str]) -> Column:
    """Map of stage to ``provider/model`` actually used."""
    def named(provider: Column) -> Column:
        model = F.coalesce(*(F.when(provider == p, F.lit(m)) for p, m in models.items()), F.lit(""))
        return F.concat(provider, F.lit("/"), model)

    return F.create_map(
        F.lit("routing"), named(F.lit(FALLBACK_PROVIDER)), F.lit("summary"), named(col_of(summary_provider)),
        F.lit("code_synthesis"), named(col_of(code_provider)))


class Providers:
    """Named call hooks with one fallback: ``name -> (prompt -> text)``."""

    def __init__(self, hooks: Mapping[str, Callable[[str], str]]):
        self.hooks = dict(hooks)

    def available(self, name: str) -> bool:
        return name in self.hooks

    def build(self, name: str) -> Callable[[str], str]:
        if name not in self.hooks:
            raise ValueError(f"no such provider or no key: {name}")
        return self.hooks[name]

    def invoke(self, prompts: DataFrame, prompt: str, provider: str) -> DataFrame:
        """Adds ``output`` and ``used``: the asked provider, then the fallback; both failing gives
        a null output under the asked name."""
        hooks = self.hooks

        @F.pandas_udf("struct<output:string,used:string>")
        def run(text: pd.Series, name: pd.Series) -> pd.DataFrame:
            def one(t, asked):
                for candidate in (asked, FALLBACK_PROVIDER):
                    try:
                        return hooks[candidate](t), candidate
                    except Exception:  # noqa: BLE001 - the next provider may still answer
                        continue
                return None, asked

            return pd.DataFrame([one(t, n) for t, n in zip(text, name)], columns=["output", "used"])

        return prompts.withColumn("_r", run(prompt, provider)).select(*prompts.columns, "_r.output", "_r.used")


def analyzed(queries: DataFrame, rewriter: Callable[[str], tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds ``rewritten_query`` and ``techniques``; a failing or empty rewrite keeps the query."""
    from lodeseek.operators.filters import known_techniques

    if rewriter is None:
        return queries.withColumn("rewritten_query", F.col("query")).withColumn(
            "techniques", F.array().cast("array<string>"))
    @F.pandas_udf("struct<rewritten:string,techniques:array<string>>")
    def run(query: pd.Series) -> pd.DataFrame:
        def one(q):
            try:
                text, labels = rewriter(q)
                return (text or "").strip() or q, list(labels)
            except Exception:  # noqa: BLE001 - the original query always works
                return q, []

        return pd.DataFrame([one(q) for q in query], columns=["rewritten", "techniques"])

    out = queries.withColumn("_r", run("query"))
    return out.select(*queries.columns, F.col("_r.rewritten").alias("rewritten_query"),
                      known_techniques("_r.techniques").alias("techniques"))
