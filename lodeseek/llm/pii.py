"""Personal data: fixed patterns, and more spans from weak supervision, in DataFrame functions only.

Base spans (e-mail, address, card, phone) follow fixed patterns and checks. Further candidates are the words that hold a digit or an
``@``. Labelers vote on each (yes, no, abstain): patterns, gazetteers of the word before and of endings, and the context. Spark counts the
vote patterns of the corpus; expectation-maximisation over those counts (at most 3 ** labelers rows) estimates how far
each labeler is to be trusted and how likely each vote pattern is personal. With these probabilities as soft labels
a classifier over shape and context features is trained by summing soft counts, and decides each candidate. Added spans never touch
base spans, which stay as they are.

Positions come from splitting a text at its matches and adding up lengths. Patterns have no nested backtracking, so very long words and
digit runs stay linear. Null text is empty. Rows that repeat id and text get equal results. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeseek.llm.common import Scratch, text_of

#: Kinds in the order of the contract, then those the classifier adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number")
#: The contract's patterns; groups are possessive and a local part starts where its run of characters does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Gazetteers: words before personal data, words before plain numbers, common host endings.
CUES = ("token", "key", "secret", "password", "passwd", "login", "phone", "tel", "mobile", "fax", "call", "mail", "email", "card",
        "account", "iban", "ssn", "passport", "ip", "host", "address", "id")
PLAIN = ("version", "page", "chapter", "section", "figure", "table", "line", "year", "volume", "number", "part", "by", "license", "nc")
ENDINGS = (".com", ".org", ".net", ".edu", ".io", ".de", ".fr", ".es")
ROUNDS, SURE = 60, 0.9


def _found(docs: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Matches in order: doc_id, text_hash, kind, i, found, gap (characters since the last match), before (up to 40 of them)."""
    cut = docs.select("doc_id", "text_hash", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"),
                      F.split("text", pattern, -1).alias("gap"))
    rows = cut.select("doc_id", "text_hash", F.posexplode(F.zip_with("m", F.slice("gap", F.lit(1), F.size("m")), lambda m, g: F.struct(
        m.alias("found"), F.length(g).alias("gap"), F.substring(g, -40, 40).alias("before")))).alias("i", "x"))
    return rows.select("doc_id", "text_hash", F.lit(kind).alias("kind"), "i", "x.found", "x.gap", "x.before")


def matches(docs: DataFrame) -> DataFrame:
    """All matches of ``docs`` (doc_id, text_hash, text): kind, start, end (code points), found, before.

    The scans emit matches only; these meet once by document, where equal rows merge and lengths add up to positions.
    """
    text = F.col("text")
    parts = [_found(docs.where(when), pattern, kind) for kind, pattern, when in (
        ("email", EMAIL, text.contains("@")), ("ip", IP, text.rlike(r"[0-9]\.[0-9]")), ("card", CARD, text.rlike(r"[0-9][\x20-]?[0-9]")),
        ("phone", PHONE, text.contains("+")), ("word", CANDIDATE, text.rlike("[0-9@]")))]
    rows = reduce(DataFrame.unionByName, parts).repartition("doc_id", "text_hash")
    rows = rows.groupBy("doc_id", "text_hash", "kind", "i", "gap", "found", "before").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    return rows.select("doc_id", "text_hash", "kind", (end - F.length("found")).alias("start"), end.alias("end"), "found", "before")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def base_spans(found: DataFrame) -> DataFrame:
    """The matches that pass the checks of their kind: doc_id, text_hash, kind, start, end."""
    digits, octets = _digits(F.col("found")), F.transform(F.split("found", r"\."), lambda p: F.ltrim(p, F.lit("0")))
    kind = F.col("kind")
    good = F.when(kind == "email", True).when(
        kind == "ip", F.forall(octets, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))).when(
        kind == "card", F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits))).when(
        kind == "phone", F.length(digits).between(9, 15))
    return found.where(good).select("doc_id", "text_hash", "kind", "start", "end")


def candidates(found: DataFrame) -> DataFrame:
    """Words with a digit or ``@``, without outer punctuation, and what the labelers and the classifier look at."""
    rows = found.where("kind = 'word'")
    lead = F.length(F.regexp_extract("found", r"^[^\p{L}0-9+]*+", 0))
    core = F.regexp_replace(F.regexp_replace("found", r"^[^\p{L}0-9+]*+", ""), r"(?<=[\p{L}0-9])[^\p{L}0-9]+$", "")
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("word", core).where(F.length("word") > 0)
    rows = rows.withColumn("end", F.col("start") + F.length("word"))
    before = F.lower(F.regexp_extract(F.rtrim(F.regexp_replace("before", r"[^\p{L}]+", " ")), r"(\p{L}+)$", 1))
    glue = F.regexp_extract(F.concat(F.col("before"), F.regexp_extract("found", r"^[^\p{L}0-9+]*+", 0)), r"([=:#\"'(])[\x20\"'(]*$", 1)
    return rows.select("doc_id", "text_hash", "start", "end", "word", before.alias("cue"), glue.alias("glue"),
                       F.length(_digits(F.col("word"))).alias("digits"), F.length("word").alias("size"))


def votes() -> list[Column]:
    """The labelers: 1 yes, 0 no, -1 abstain."""
    word, digits, size = F.col("word"), F.col("digits"), F.col("size")

    def vote(*cases: tuple[Column, int]) -> Column:
        out = F.lit(-1)
        for when, value in reversed(cases):
            out = F.when(when, value).otherwise(out)
        return out

    hexed = word.rlike(r"^[0-9a-fA-F]{16,}$") & word.rlike("[a-fA-F]")
    return [
        vote((hexed, 1), (word.rlike(r"^[\p{L}]+[0-9]{1,2}$"), 0)),
        vote((word.contains("@") & word.rlike(r"@[A-Za-z0-9-]+\."), 1), (word.rlike(r"^[0-9]+(\.[0-9]+){3}$"), 1)),
        vote((F.col("cue").isin(*CUES), 1), (F.col("cue").isin(*PLAIN), 0)),
        vote((F.col("glue").isin("=", ":", "#"), 1), (F.col("glue") == "", 0)),
        vote((F.lower(F.substring(word, -4, 4)).isin(*ENDINGS), 1)),
        vote((digits <= 4, 0), ((digits == size) & (digits >= 12) & ~F.coalesce(F.call_function("luhn_check", word), F.lit(False)), 0),
             ((digits == size) & (digits >= 12), 1)),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability that a vote pattern is personal, by expectation-maximisation over the counts of the patterns.

    Each labeler has its own rates of yes, no and abstention under either truth; they start from the majority vote.
    """
    if not patterns:
        return {}
    truth = {p: min(0.95, max(0.05, 0.5 + 0.2 * (p.count(1) - p.count(0)))) for p, _ in patterns}
    width, total = len(patterns[0][0]), sum(n for _, n in patterns)
    for _ in range(rounds):
        yes = sum(n * truth[p] for p, n in patterns)
        share = min(1 - 1e-6, max(1e-6, yes / total))
        rates = [[[0.1, 0.1, 0.1], [0.1, 0.1, 0.1]] for _ in range(width)]
        for p, n in patterns:
            for j, v in enumerate(p):
                rates[j][1][v + 1] += n * truth[p]
                rates[j][0][v + 1] += n * (1 - truth[p])
        for j in range(width):
            for side in (0, 1):
                whole = sum(rates[j][side])
                rates[j][side] = [r / whole for r in rates[j][side]]
        for p, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[j][1][v + 1] / rates[j][0][v + 1]) for j, v in enumerate(p))
            truth[p] = 1 / (1 + math.exp(-min(50, max(-50, odds))))
    return truth


def features() -> list[Column]:
    """What the classifier sees of a candidate, as ``name=value`` with few values each."""
    word, size = F.col("word"), F.col("size")
    share = F.floor(F.col("digits") * 4 / size).cast("string")
    shape = F.when(word.contains("@"), "at").when(word.rlike("^[0-9]+$"), "digits").when(word.rlike("^[0-9.]+$"), "dotted").when(
        word.rlike("^[0-9a-f]+$"), "hex").when(word.rlike(r"^[0-9a-zA-Z]+$"), "mixed").otherwise("other")
    cue = F.when(F.col("cue").isin(*CUES), "cue").when(F.col("cue").isin(*PLAIN), "plain").otherwise("none")
    return [F.concat(F.lit(n + "="), v) for n, v in (
        ("share", share), ("shape", shape), ("cue", cue), ("glue", F.when(F.col("glue") == "", "none").otherwise("some")),
        ("size", F.least(F.lit(8), F.floor(F.log2(size.cast("double")))).cast("string")))]


def added_spans(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans the trained classifier takes for personal: doc_id, text_hash, kind, start, end."""
    rows = candidates(found).withColumn("votes", F.array(*votes())).withColumn("features", F.array(*features()))
    rows = scratch.put(rows, "candidates")
    counts = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** labelers rows
    truth = estimate(sorted((tuple(r["votes"]), r["n"]) for r in counts))
    kinds = "doc_id {}, text_hash long, kind string, start long, end long".format(found.schema["doc_id"].dataType.simpleString())
    if not truth:
        return found.sparkSession.createDataFrame([], kinds)
    soft = found.sparkSession.createDataFrame([(list(p), v) for p, v in truth.items()], "votes array<int>, truth double")
    sums = rows.join(F.broadcast(soft), "votes").select("truth", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("truth").alias("yes"), F.sum(1 - F.col("truth")).alias("no")).collect()  # one row per feature value
    yes = sum(r["yes"] for r in sums if r["feature"].startswith("shape=")) + 1
    no = sum(r["no"] for r in sums if r["feature"].startswith("shape=")) + 1
    weights = {r["feature"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, float(w))])
    odds = F.aggregate(F.transform("features", lambda f: F.coalesce(F.element_at(table, f), F.lit(0.0))), F.lit(math.log(yes / no)), lambda a, w: a + w)
    chosen = rows.where(1 / (1 + F.exp(-odds)) >= SURE)
    kind = F.when(F.col("word").rlike(r"[\p{L}]"), ADDED[0]).otherwise(ADDED[1])
    return chosen.select("doc_id", "text_hash", kind.alias("kind"), F.col("start").cast("long"), F.col("end").cast("long"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (span list), spans (base and added) of every row."""
    named = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = scratch.put(matches(named), "matches")
    base, added = base_spans(found), added_spans(found, scratch)
    both = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    # base spans that reach into an added one start before its end: the widest before it, and the first at or after it
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(coming, F.lit(1 << 60)) >= F.col("end"))
    both = both.withColumn("_clear", clear).where(F.col("base") | F.col("_clear"))
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *ADDED)]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    grouped = both.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        _joined(F.collect_list(F.when(F.col("base"), span))).alias("base"), _joined(F.collect_list(span)).alias("spans"))
    grouped = scratch.put(grouped, "spans")
    out = named.select("doc_id", "text_hash").join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
