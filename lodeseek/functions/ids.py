"""Identity rules. Ground truth depends on these being exact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodeseek.functions.text import col_of

# Separator runs and id prefixes.
NOT_WORD = r"[^\p{L}\p{N}_]+"
ENTITY_PREFIX = "ent_"
EMPTY_SLUG = "unknown"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside the lambdas of array functions, which share no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(text) -> Column:
    joined = F.regexp_replace(F.lower(col_of(text).cast("string")), NOT_WORD, "_")
    trimmed = F.regexp_replace(joined, "^_+|_+$", "")
    return let(trimmed, lambda t: F.when(t == "", F.lit(EMPTY_SLUG)).otherwise(t))


def entity_id(name) -> Column:
    n = col_of(name)
    return F.when(n.startswith(ENTITY_PREFIX), n).otherwise(F.concat(F.lit(ENTITY_PREFIX), slug(n)))


def bare(identifier) -> Column:
    i = col_of(identifier)
    return F.when(
        i.startswith(ENTITY_PREFIX), F.regexp_replace(i, f"^{ENTITY_PREFIX}", "")
    ).otherwise(slug(i))


def bare_entity(identifier) -> Column:
    """:func:`bare` of what :func:`entity_id` made."""
    return col_of(identifier).substr(F.lit(len(ENTITY_PREFIX) + 1), F.lit(2**31 - 1))


def relation_id(source, rel_type, target) -> Column:
    return F.concat_ws("_", F.lit("rel"), bare(source), slug(rel_type), bare(target))


def text_chunk_id(n) -> Column:
    return F.concat(F.lit("chunk_"), col_of(n).cast("string"))


def code_chunk_id(path, symbol, start_line) -> Column:
    return F.concat_ws("#", col_of(path), col_of(symbol), col_of(start_line).cast("string"))
