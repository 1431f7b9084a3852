"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Leaves are (domain, language, source). A token target flows down the tree by the siblings' weights. A node takes at most
what its subtree can give (tokens times the allowed epochs); what it can't take goes to its siblings in proportion to
their weights, and only if all of them are full does an ancestor's sibling get it. With the siblings sorted by
capacity over weight that fixed point is a closed form, so each level is one window over the small tree table.

A leaf with budget b and T tokens gives floor(b / T) whole epochs and from the next epoch the shortest prefix, in an order
seeded per epoch, that reaches the rest. Prefixes are cut without sorting a leaf: the order key is an MD5, token sums per leading hex digits
(4,096 bins) show the one bin where the cut falls, and only that bin is sorted. The cut is a value of the
key, so selecting is a filter on the documents and no text is shuffled.

Tokens are white-space separated words. A document without tokens (null or empty text) is taken in every epoch before
the cut and costs nothing. Null language or source is the name ``none``. Equal keys (repeated ids) are cut together. An empty
table or a zero target selects nothing. Extra columns are carried; one named ``epoch`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeseek.llm.common import SPACE, Scratch, text_of

LEVELS = ("domain", "language", "leaf")
#: Production parameters: integer weights among siblings; names without one have weight 1.
DOMAIN_WEIGHTS = {"web": 3, "curated": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Target as a share (numerator, denominator) of the corpus tokens, and most epochs of any document.
TARGET_SHARE = (3, 4)
MAX_EPOCHS = 3
SEED = 17
BIN_DIGITS = 3


def token_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def domain_of(source: Column) -> Column:
    """The example taxonomy: sources whose name ends in 0 to 4 are crawled, the others curated."""
    return F.when(F.substring(source, -1, 1).isin("0", "1", "2", "3", "4"), "web").otherwise("curated")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, value).otherwise(out)
    return out.cast("double")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, domain, language, leaf, tokens; the only pass over the texts that counts."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), domain_of(source).alias("domain"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("language"), source.alias("leaf"),
                       token_count(text_of()).alias("tokens"))


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide ``budget`` of each parent among its children (capacity, weight): the share of each in ``share``.

    Children in order of capacity / weight fill up one after the other; the first that doesn't fix the level of the rest.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    level = (F.col("budget") - spent) / F.sum("weight").over(after)
    out = children.withColumn("_level", level).withColumn("_full", F.col("capacity") / F.col("weight") <= F.col("_level"))
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*parent))
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("weight") * F.greatest(common, F.lit(0.0))))
    return out.withColumn("share", share).drop("_level", "_full", "budget")


def budgets(totals: DataFrame, share: tuple[int, int] = TARGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals`` (domain, language, leaf, tokens) with the ``share`` of the target each leaf gets."""
    capacity = (F.col("tokens") * max_epochs).cast("double")
    domains = totals.groupBy("domain").agg(F.sum(capacity).alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("_root", F.lit(0))
    target = F.floor(F.sum("tokens").over(Window.partitionBy("_root")) * share[0] / share[1]).cast("double")
    domains = domains.withColumn("budget", target).withColumn("weight", _weight("domain", DOMAIN_WEIGHTS))
    domains = fill(domains, ["_root"], "domain")
    languages = totals.groupBy("domain", "language").agg(F.sum(capacity).alias("capacity"))
    languages = languages.join(domains.select("domain", F.col("share").alias("budget")), "domain")
    languages = fill(languages.withColumn("weight", _weight("language", LANGUAGE_WEIGHTS)), ["domain"], "language")
    sources = totals.withColumn("capacity", capacity)
    sources = sources.join(languages.select("domain", "language", F.col("share").alias("budget")), ["domain", "language"])
    sources = fill(sources.withColumn("weight", _weight("leaf", SOURCE_WEIGHTS)), ["domain", "language"], "leaf")
    return sources.select("domain", "language", "leaf", "tokens", "share")


def order_key(epoch: Column, doc_id: Column, seed: int = SEED) -> Column:
    """Seeded order of one epoch: an MD5 in hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id, F.lit(""))))


def cuts(rows: DataFrame, scratch: Scratch, share: tuple[int, int] = TARGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per leaf: whole (epochs taken whole), rest (tokens still wanted), cut (last key of the partial epoch, '' for none)."""
    keys = list(LEVELS)
    rows = scratch.put(rows, "leaves")
    totals = scratch.put(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "totals")
    plan = budgets(totals, share, max_epochs).withColumn("budget", F.floor("share").cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = scratch.put(plan.select(*keys, "tokens", "budget", "whole", "rest"), "plan")
    partial = rows.withColumnRenamed("tokens", "n").join(plan.where("rest > 0"), keys)
    partial = partial.withColumn("key", order_key(F.col("whole"), F.col("doc_id"), seed)).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = partial.groupBy(*keys, "rest", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = bins.withColumn("_to", F.sum("n").over(upto)).where((F.col("_to") >= F.col("rest")) & (F.col("_to") - F.col("n") < F.col("rest")))
    edge = scratch.put(edge.select(*keys, "bin", (F.col("rest") - F.col("_to") + F.col("n")).alias("left")), "edge")
    inside = partial.join(edge, keys + ["bin"]).groupBy(*keys, "left", "key").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0))).where(F.col("_before") < F.col("left"))
    last = taken.groupBy(*keys).agg(F.max("key").alias("cut"))
    return scratch.put(plan.join(last, keys, "left").withColumn("cut", F.coalesce("cut", F.lit(""))), "cuts")


def mix(docs: DataFrame, scratch: Scratch, share: tuple[int, int] = TARGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The selected documents, one row per epoch that has them: all columns of ``docs`` and ``epoch``."""
    plan = cuts(leaves(docs), scratch, share, max_epochs, seed)
    plan = plan.select(*[F.col(c).alias(f"_m_{c}") for c in (*LEVELS, "whole", "cut")])
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    language = F.coalesce(F.col("lang").cast("string"), F.lit("none"))
    joined = docs.join(scratch.small(scratch.put(plan, "choice")), (domain_of(source) == F.col("_m_domain"))
                       & (language == F.col("_m_language")) & (source == F.col("_m_leaf")))
    key = order_key(F.col("_m_whole"), F.col("doc_id").cast("string"), seed)
    copies = (F.col("_m_whole") + F.when(key <= F.col("_m_cut"), 1).otherwise(0)).cast("int")
    chosen = joined.withColumn("_m_copies", copies).where("_m_copies > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("_m_copies") - 1))
    return chosen.withColumn("_m_epoch", epoch).select(*[c for c in docs.columns if c != "epoch"], F.col("_m_epoch").alias("epoch"))
