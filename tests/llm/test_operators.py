"""Each operator against brute force on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import chat, contamination, exact, hashing, language, licenses, mixing, near, pii, repeats, toxicity
from lodeseek.llm.common import Scratch

SCHEMA = ("doc_id long, text string, lang string, source string, digest string, key string, score double, n long, words string, "
          "id long, epoch string, w string, symbols string, component long, base string, licenses string")
EXTRA = len(SCHEMA.split(",")) - 4


def prose(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *([None] * EXTRA)) for r in rows], SCHEMA)


LONG = prose(1, 20_000, 5000)
BASE = prose(2, 120)
AWKWARD = [
    (1, None, "en", "src1"), (2, "", "en", None), (3, "   \n\t ", None, "src1"), (4, BASE, "en", "src2"), (5, BASE.replace(" ", "\n ", 3), "en", "src2"),
    (6, BASE.replace("w1", "v1", 1), "de", "src7"), (7, LONG, "en", "src2"), (8, "one", "en", "src3"), (8, "one", "en", "src3"), (9, "!!! ??", "en", "src3"),
    (None, BASE, "en", "src2"), (None, None, None, None), (10, "a" * 50_000, "en", "src9"), (11, " ".join(["x y"] * 400), "en", "src9"),
    (12, "pre " + " ".join(LONG.split()[500:700]) + " post", "en", "src1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


def scratch(spark):
    return Scratch(spark, "test")


def test_exact(spark, docs, empty):
    rows = exact.dedup(docs, scratch(spark)).collect()
    assert len(rows) == len(AWKWARD)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in AWKWARD]
    for r in rows:
        same = [i for i, t in norm if hashlib.sha256(t.encode()).digest() == bytes(r["digest"])]
        assert r["group_size"] == len(same) and r["keep_id"] == min((i for i in same if i is not None), default=None)
    assert sum(r["kept"] for r in rows) == len({t for _, t in norm})
    kept = exact.kept_rows(docs, scratch(spark))
    assert kept.columns == docs.columns and kept.count() == len({t for _, t in norm})
    assert exact.dedup(empty, scratch(spark)).count() == 0


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint8).reshape(-1, 32).copy()
    for n in (1, 2, 3, 7, 3000):
        seeds, slots = exact.perfect_hash(digests[:n])
        assert sorted(slots) == list(range(n)) and (exact.find_slots(digests[:n], seeds, n) == slots).all()


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([("a", " ".join(LONG.split()[510:540])), ("b", "one"), ("c", None), ("d", "!!"), ("d", prose(5, 40))], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in contamination.scan(docs, items, scratch(spark)).collect()}
    assert got[7, 20_000]["n_hit"] == 30 and not got[7, 20_000]["contaminated"]
    assert got[12, 202]["n_hit"] == 30 and got[12, 202]["contaminated"] and got[12, 202]["items"] == ["a"]
    assert got[8, 1]["contaminated"] and got[8, 1]["items"] == ["b"]
    assert {k for k, r in got.items() if r["n_hit"]} == {(7, 20_000), (12, 202), (8, 1)}
    assert contamination.clean_rows(docs, items, scratch(spark)).count() == len(AWKWARD) - 3
    assert contamination.scan(empty, items, scratch(spark)).count() == 0
    assert contamination.scan(docs, items.limit(0), scratch(spark)).where("n_hit > 0").count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.leaves(docs).collect()
    total = sum(r["tokens"] for r in rows)
    out = mixing.mix(docs, scratch(spark), share=(1, 2), max_epochs=2)
    assert out.columns == [c for c in docs.columns if c != "epoch"] + ["epoch"]
    assert out.agg(F.max("epoch")).first()[0] <= 2
    assert mixing.mix(docs, scratch(spark), share=(0, 1)).count() == 0 and mixing.mix(empty, scratch(spark)).count() == 0
    every = mixing.mix(docs, scratch(spark), share=(1, 1), max_epochs=1)
    assert every.agg(F.sum(mixing.token_count(F.coalesce("text", F.lit(""))))).first()[0] == total


def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 10_000), ("curated", "en", "c", 10_000)]
    totals = spark.createDataFrame(rows, "domain string, language string, leaf string, tokens long")
    got = {r["leaf"]: r["share"] for r in mixing.budgets(totals, (1, 2), 1).collect()}
    assert got["a"] == 100 and got["a"] + got["b"] == pytest.approx(10_050 * 3 / 5) and got["c"] == pytest.approx(10_050 * 2 / 5)


def test_near(spark, docs, empty):
    got = near.classes(docs, scratch(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["class_id"] == by[5]["class_id"] == by[6]["class_id"] == 4 and by[1]["class_id"] == 1 and by[2]["class_id"] == 2
    assert by[9]["class_id"] == 9 and by[12]["class_id"] == 12 and by[7]["class_id"] == 7
    assert near.classes(empty, scratch(spark)).count() == 0
    assert near.kept_rows(docs, scratch(spark)).where("doc_id in (5, 6)").count() == 0


def test_near_family_and_rounds(spark):
    """A chain of edits: neighbours are similar, the ends are not, all are one class."""
    words, rows = prose(3, 200, 10_000).split(), []
    for i in range(45):
        rows.append((i, " ".join(words), "en", "s"))
        words = words[:i * 4] + [f"n{i}"] + words[i * 4 + 1:]
    assert {r["class_id"] for r in near.classes(frame(spark, rows), scratch(spark)).collect()} == {0}


def test_near_prefix_join_finds_what_large_buckets_hold_apart(spark, monkeypatch):
    """Texts around one passage, without any other comparison inside buckets, against all pairs."""
    monkeypatch.setattr(near, "SMALL", 1)
    monkeypatch.setattr(near, "_neighbours", lambda members, texts: members.where("false").select(F.col("doc").alias("a"), F.col("doc").alias("b")))
    passage, rows = prose(5, 150, 10_000), []
    for i in range(40):
        own = prose(100 + i // 2, 100, 10_000).split()
        if i % 2:
            own[50] = "other"
        rows.append((i, f"{passage} {' '.join(own)}", "en", "s"))
    hasher = hashing.WordHasher()
    words = [hasher(r[1].split()) for r in rows]
    group = list(range(40))
    for a in range(40):
        for b in range(a + 1, 40):
            if near.alignment(words[a], words[b]) >= near.THRESHOLD:
                group = [group[a] if g == group[b] else g for g in group]
    got = {r["doc_id"]: r["class_id"] for r in near.classes(frame(spark, rows), scratch(spark)).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) == 20


def test_alignment_is_ordered():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 9999, 300).astype(np.uint32)
    b = a.copy()
    b[[50, 150]] += 1
    assert near.alignment(a, a) == 1.0 and near.alignment(a, b) == pytest.approx(286 / (296 * 2 - 286))
    assert near.alignment(a, np.r_[a[150:], a[:150]]) == 0.0


def brute_repeats(rows, window):
    first, out = {}, {}
    split = re.compile(r"[^\x20\x09-\x0D]+")
    ordered = sorted(((i if i is not None else repeats.NO_ID, t) for i, t, *_ in rows), key=lambda r: r[0])
    for i, t in ordered:
        w = split.findall(t or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, i), i)
    for i, t in ordered:
        w = split.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[None if i == repeats.NO_ID else i, len(w)] = (sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats(spark, docs, empty):
    run = ["z"] * 70
    more = [(20, " ".join(prose(9, 30).split() + run), "en", "s"), (21, " ".join(run + prose(10, 30).split()), "en", "s"),
            (22, " ".join(["p q r"] * 60), "en", "s"), (23, " ".join(["p q r"] * 90), "en", "s")]
    rows = AWKWARD + more
    got = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_digest"]) for r in repeats.dedup(frame(spark, rows), scratch(spark)).collect()}
    assert got == brute_repeats(rows, repeats.WINDOW)
    assert repeats.dedup(empty, scratch(spark)).count() == 0


def test_repeats_between_runs_and_passages(spark):
    """Passages, long runs and periods mixed at random."""
    rng, rows = random.Random(5), []
    pool = [prose(100 + k, rng.choice([52, 60, 90]), 300) for k in range(12)]
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            k = rng.random()
            parts.append(rng.choice(pool) if k < .35 else " ".join([f"r{rng.randrange(3)}"] * rng.choice([10, 28, 40, 60])) if k < .6
                         else " ".join([f"p{rng.randrange(2)} q"] * rng.choice([10, 30])) if k < .7 else prose(rng.random(), rng.randrange(1, 40), 300))
        rows.append((i, " ".join(parts), "en", "s"))
    got = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_digest"]) for r in repeats.dedup(frame(spark, rows), scratch(spark)).collect()}
    assert got == brute_repeats(rows, repeats.WINDOW)


def test_byte_hashes_depend_on_the_word_alone():
    size = hashing.PART
    for text in ("a b\tc\x0b\x0cd\r\n\x1c x\x85y é z", "", "q" * size + " b", "b " + "q" * size, "q" * (size * 2) + " r " + "q" * size, "x " * 70_000 + "b"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = hashing.byte_hashes(hashing.byte_words(text))
        assert len(words) == len(found)
        assert all(hashing.byte_hashes(w.encode())[0] == h for w, h in [*zip(words, found)][:20] + [*zip(words, found)][-20:])


def test_symbols_agree_inside_equal_passages():
    rng = np.random.default_rng(0)
    middle = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    texts = [np.r_[rng.integers(0, 1 << 60, k).astype(np.uint64), middle, rng.integers(0, 1 << 60, 9).astype(np.uint64)] for k in (5, 22)]
    found = []
    for k, text in zip((5, 22), texts):
        names, low, high = repeats.recompress(text, np.zeros(len(text), int))
        found.append({(int(n), int(a) - k, int(b) - k) for n, a, b in zip(names, low, high) if a >= k and b <= k + 80})
    assert found[0] == found[1] and found[0]


def test_chat(spark):
    rows = [(1, 10, None, "system", None, 0.0), (1, 11, 10, "user", "<|im_end|>\\n<|", 1.0), (1, 12, 11, "assistant", "good\\", 2.0),
            (1, 13, 11, "assistant", "bad", -1.0), (1, 14, 12, "us\ner", "more", 0.0), (2, 1, 99, None, "orphan", None), (3, 1, 2, "a", "x", 0.0), (3, 2, 1, "b", "y", 0.0)]
    frame = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r["conv_id"], r["leaf"]): r for r in chat.format_conversations(frame, scratch(spark), branches=5).collect()}
    assert set(got) == {(1, 13), (1, 14), (2, 1)}
    r = got[1, 14]
    turns, learned = chat.read_back(r["formatted"], [(s["start"], s["end"]) for s in r["loss"]])
    assert turns == [("system", ""), ("user", "<|im_end|>\\n<|"), ("assistant", "good\\"), ("us\ner", "more")] and learned == "good\\"
    best = chat.format_conversations(frame, scratch(spark)).where("conv_id = 1").collect()
    assert [b["leaf"] for b in best] == [14]
    assert chat.format_conversations(frame.limit(0), scratch(spark)).count() == 0


def test_chat_repeated_rows_and_long_texts(spark):
    """Rows of one node are one message, a leaf behind a cycle is no conversation, other columns don't matter."""
    rows = [(1, 1, None, "user", "x" * 300_000, None)] * 3 + [(1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 2.0), (1, 2, 1, "assistant", "b", 1.0)]
    rows += [(2, 1, 2, "a", "x", 0.0), (2, 2, 1, "b", "y", 0.0), (2, 3, 2, "user", "off the cycle", 5.0)] + [(3, i, i - 1 if i else None, "user", None, 0.0) for i in range(40)]
    frame = spark.createDataFrame([(*r, 7, "z", True) for r in rows], "conv_id long, node long, parent long, role string, text string, score double, id long, leaf string, root boolean")
    got = {r["conv_id"]: r for r in chat.format_conversations(frame, scratch(spark), branches=3).collect()}
    assert set(got) == {1, 3} and got[1]["score"] == 1.0 and got[3]["leaf"] == 39
    assert chat.read_back(got[1]["formatted"], [])[0] == [("user", "x" * 300_000), ("assistant", "b")]
    assert len(chat.read_back(got[3]["formatted"], [])[0]) == 40


def test_chat_without_conversation_id(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (4, 0, "user", "x")]
    messages = chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: chat.read_back(r["formatted"], [])[0] for r in chat.format_conversations(messages, scratch(spark)).collect()}
    assert got == {None: [("user", "hi"), ("assistant", "yes")], 4: [("user", "x")]}


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["<|", "|>", "\\", "n", "\n", "<", "im_end", "é", ""]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text == chat.unescape(chat.escape(text, True)) and "<|" not in chat.escape(text)


def test_language_chain_matches_brute_force():
    samples = [(lang, " ".join(random.Random(i).choice(words) for _ in range(40))) for i in range(120)
               for lang, words in (("aa", ["bath", "path", "with", "thing"]), ("bb", ["über", "schön", "stück", "grün"]))]
    model = language.fit(samples)
    words = ["bath", "schön", "grün", "path", "with"] * 15
    scores = model.emissions(words)
    step, p = np.exp(model.transitions), np.exp(scores - scores.max(1, keepdims=True))
    ahead, back = [np.ones(2)], [np.ones(2)]
    for x in p:
        ahead.append((ahead[-1] @ step) * x / ((ahead[-1] @ step) * x).sum())
    for x in p[::-1]:
        back.append(step @ (x * back[-1]) / (step @ (x * back[-1])).sum())
    both = np.array([a * b / (a * b).sum() for a, b in zip(ahead[1:], back[:-1][::-1])])
    assert np.allclose(language.label_shares(model, scores, np.array([len(words)]))[0], both.mean(0))
    label = language.Labeller(model)
    assert label(["bath with path", None, "", "12 ²", "schön grün"]) [1:4] == [("und", 0.0)] * 3
    assert [x[0] for x in label(["bath with path", "schön grün"])] == ["aa", "bb"]
    assert language.Labeller(None)(["x"]) == [("und", 0.0)]


def test_language_on_rows(spark, docs, empty):
    out = language.predict(docs, language.train(docs)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    kept = language.accepted(docs, scratch(spark))
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = '' or doc_id = 9").count() == 0
    assert language.predict(empty, language.train(empty)).count() == 0


def test_block_index_is_exact():
    """Like vectors share blocks, so a search opens few of them, and finds what a dense product finds."""
    rng = np.random.default_rng(3)
    rows, topics = [], [np.sort(rng.choice(400, 30, replace=False)) for _ in range(12)]
    for i in range(900):
        ids = np.sort(rng.choice(topics[i % 12], rng.integers(4, 12), replace=False))
        w = rng.random(len(ids)) + 0.1
        rows.append((i, int(rng.integers(2)), 7 * i % 900, ids, w / np.sqrt((w ** 2).sum())))
    index = toxicity.BlockIndex.build(rows, 400)
    dense = np.zeros((900, 400))
    for i, _, _, ids, w in rows:
        dense[i, ids] = w
    for i in range(0, 900, 23):
        _, _, digest, ids, w = rows[i]
        places, cosines = index.search(ids, w, 10)
        assert np.allclose(cosines, np.sort(dense[:, ids] @ w)[::-1][:10], atol=1e-5)
        others, cosines = index.search(ids, w, 10, without=digest)
        assert i not in index.ids[others] and np.allclose(cosines, np.sort(np.delete(dense[:, ids] @ w, i))[::-1][:10], atol=1e-5)
    assert index.opened < 0.5 * index.bounded
    few = toxicity.BlockIndex.build(rows[:3], 400)
    assert len(few.search(*rows[0][3:], 10)[0]) <= 3


def test_toxicity_against_brute_force(spark, empty):
    """Scores of all rows from plain dictionaries: cosines with every example but the text itself, votes, curve."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(90)]
    texts = [t + (" scum" if i % 7 == 0 else "") for i, t in enumerate(texts)] + texts[:5] + ["", None, "12 !", "abc " * 30_000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "scum", None, None)]
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, scratch(spark))
    vector = toxicity.Vectors(model.terms, model.idf)
    by_id = {i: t for i, t, *_ in rows}
    examples = [(int(i), toxic, dict(zip(*map(list, vector(by_id[int(i)]))))) for i, toxic in zip(model.index.ids, model.index.toxic)]
    for r in toxicity.score(frame(spark, rows), model).collect():
        text = "scum" if r["doc_id"] is None else by_id[r["doc_id"]]
        mine = dict(zip(*map(list, vector(text))))
        if not mine:
            assert r["score"] == pytest.approx(model.without_terms) and not r["evidence"]
            continue
        near_by = sorted(((sum(w * theirs.get(t, 0.0) for t, w in mine.items()), i, toxic) for i, toxic, theirs in examples if by_id[i] != text), reverse=True)
        votes = [(1 / (toxicity.NEAR + max(0.0, 1 - c)), toxic) for c, _, toxic in near_by[:toxicity.NEIGHBOURS] if c > 0]
        raw = (sum(v * t for v, t in votes) + model.prior) / (sum(v for v, _ in votes) + 1)
        assert r["score"] == pytest.approx(0.98 * np.interp(raw, *model.curve) + 0.02 * raw, abs=1e-4)
        assert text not in [by_id[i] for i in r["evidence"]]
        assert list(r["nearness"]) == pytest.approx([c for c, *_ in near_by[:3] if c > 0], abs=1e-5)


def test_toxicity_on_rows(spark, docs, empty):
    rng = random.Random(8)
    bad = ["vile", "nasty"]
    rows = [(i, prose(i, 60) + (" " + rng.choice(bad) if i % 4 == 0 else ""), "en", "s") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    train = frame(spark, rows)
    model = toxicity.fit(train, labels, scratch(spark))
    got = {r["doc_id"]: r for r in toxicity.score(train, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held) and got[0]["evidence"]
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, toxicity.fit(empty, labels, scratch(spark))).count() == 0


def test_pii(spark, docs, empty):
    text = ("mail a.b@c.de_x@y.com! ip 10.0.0.255 and 1.2.3.256 card 4111 1111-1111 1111, bad 4111111111111112 tel +1 (487) 555-7209. "
            + "é" * 5 + " z@q.r token = \"" + "ab12" * 10 + "\"")
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, "1 " * 30_000 + "." * 10 + "a" * 30_000 + "@", "en", "s"), (3, None, "en", "s")]
    got = sorted(pii.scan(frame(spark, rows), scratch(spark)).collect(), key=lambda r: r["doc_id"])
    assert len(got) == 4 and got[0] == got[1]
    spans = [s.split(":") for s in got[0]["base"].split(",")]
    assert [(k, text[int(a):int(b)]) for k, a, b in spans] == [
        ("email", "a.b@c.de"), ("email", "_x@y.com"), ("ip", "10.0.0.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (487) 555-7209"), ("email", "z@q.r")]
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (3, 1, 1, 1)
    assert got[2]["base"] == "" and got[3]["spans"] == ""
    assert pii.scan(docs, scratch(spark)).count() == len(AWKWARD) and pii.scan(empty, scratch(spark)).count() == 0


def test_expectation_maximisation_finds_the_reliable_labeler():
    truth = pii.estimate([((1, 1, -1), 90), ((1, 0, -1), 10), ((0, 0, 1), 80), ((0, 0, -1), 100), ((0, 1, -1), 5)])
    assert truth[1, 1, -1] > 0.9 and truth[0, 0, -1] < 0.1 and pii.estimate([]) == {}


def test_licenses(spark, docs, empty):
    long = ("big", prose(40, 60, 5000))
    templates = spark.createDataFrame([*licenses.NOTICES, long, ("none", None), ("two", "hello there")], "license string, text string")
    rows = [(1, "x " * 23 + "Licensed under the Apache License, Version 2.0. " + "y " * 50 + "ALL rights\nreserved", "en", "s"), (2, "all rights", "en", "s"),
            (3, prose(41, 31) + " " + long[1] + " " + prose(42, 30), "en", "s"), (4, " ".join(long[1].split()[:30]), "en", "s"), (5, "well hello there", "en", "s"), (6, None, "en", "s")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows), templates, scratch(spark)).collect()}
    assert got[1] == ["all-rights-reserved", "apache-2.0"] and got[2] == [] and got[4] == [] and got[5] == ["two"] and got[6] == []
    assert licenses.scan(docs, templates, scratch(spark)).where(F.size("licenses") > 0).count() == 0
    assert licenses.scan(empty, templates, scratch(spark)).count() == 0
    assert got[3] == ["big"]


def test_toxicity_learns_from_few_texts_and_all_terms(spark):
    """A few toxic texts are enough; no text of the sample is without a vector, and copies count once."""
    plain = [" ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in prose(i, 20).split()) for i in range(60)]
    rows = [(i, t + (" scum" if i % 12 == 0 else ""), "en", "s") for i, t in enumerate(plain)] + [(100, plain[1], "en", "s")]
    labels = spark.createDataFrame([(i, int(i % 12 == 0)) for i in range(60)] + [(100, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, scratch(spark))
    learned = {r[1]: r[0] for r in reversed(rows) if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert sorted(model.index.ids) == sorted(learned.values())
    assert set(model.terms) == {t for text in learned for w in text.split() for t in toxicity.terms_of(w)}
    texts = [r[1] for r in rows[:60]] + ["scum", "", None, "xyz"]
    vector = toxicity.Vectors(model.terms, model.idf)
    got = model.judge_all([vector(t) for t in texts], [toxicity.digest_of(t) for t in texts])
    assert got == [model.judge_all([vector(t)], [toxicity.digest_of(t)])[0] for t in texts]
    assert got[60][0] > max(got[i][0] for i in range(60) if i % 12) and got[61:] == [(model.without_terms, [], [])] * 3


@pytest.mark.parametrize("bound", [near.HEAVY_BYTES, -1])
def test_prefix_join_finds_all_pairs(spark, monkeypatch, bound):
    """A large group, near misses of it and a common passage: the prefix join brings every pair at the threshold, through either plan."""
    monkeypatch.setattr(near, "LIGHT", 4)
    rng, hasher = random.Random(9), hashing.WordHasher()
    base, passage = prose(21, 60).split(), prose(22, 30).split()
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        texts.append(words)
    texts += [prose(100 + i, 30).split() + passage for i in range(30)]
    texts += [t[:-1] + ["end"] for t in texts[60:70]]
    hashes = [hasher(t) for t in texts]
    component = [0 if i < 40 else i for i in range(len(texts))]
    rows = spark.createDataFrame([(i, c, c != 0) for i, c in enumerate(component)], "doc long, component long, minor boolean")
    words = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in enumerate(hashes)], "doc long, words binary")
    got = {(r["a"], r["b"]) for r in near._prefix_pairs(rows, words, scratch(spark), bound).collect()}
    need = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if component[a] != component[b] and near.alignment(hashes[a], hashes[b]) >= near.THRESHOLD}
    assert need and need <= got and len(got) < len(texts) ** 2 / 4


def test_prefixes_hold_only_tokens_that_can_meet(spark):
    """Texts around a common passage: a token of one text joins nothing and isn't a row, and no light token is counted as a row of its own."""
    hasher, passage = hashing.WordHasher(), prose(51, 20)
    texts = [hasher(f"{prose(500 + i, 100)} {passage}".split()) for i in range(50)] + [hasher(prose(60, 100).split())] * 2
    rows = spark.createDataFrame([(i, i, True, bytearray(t.tobytes())) for i, t in enumerate(texts)], "doc long, component long, minor boolean, words binary")
    prefix, store = near._prefixes(rows, scratch(spark), near.HEAVY_BYTES).collect(), scratch(spark)
    assert {50, 51} <= {r["doc"] for r in prefix} and len(prefix) < 52 * 21 / 2
    ranks = near._slot_ranks(rows, store)
    counted = rows.mapInArrow(near._token_counts(spark.sparkContext.broadcast(ranks)), "token long, n long, lo long, hi long")
    assert counted.count() < 17 * spark.sparkContext.defaultParallelism


def test_near_repeated_ids_and_short_texts(spark, empty):
    """Two texts under one id keep their own words; eight words and nine that share them link."""
    rng = random.Random(4)
    rows, pairs = [], []
    for i in range(120):
        words = [f"q{rng.randrange(10**6)}" for _ in range(8)]
        rows += [(1000 + 2 * i, " ".join(words), None, None), (1001 + 2 * i, " ".join([*words, "more"]), None, None)]
        pairs.append((1000 + 2 * i, 1001 + 2 * i))
    rows += [(1, prose(31, 80), None, None), (1, prose(32, 80), None, None), (2, prose(32, 79), None, None)]
    got = {}
    for r in near.classes(frame(spark, rows), scratch(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert all(got[b] == {a} for a, b in pairs) and got[2] == {1}


def test_contamination_of_repeated_ids(spark):
    """Two texts under one id, or without one, have their own hits; only the contaminated one goes."""
    item = prose(41, 20)
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    rows = [(5, item, None, None), (5, prose(42, 30), None, None), (None, item, None, None), (None, prose(43, 30), None, None), (5, item, None, None)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination.scan(frame(spark, rows), items, scratch(spark)).collect())
    assert got == [("5", 20, 20, True), ("5", 20, 20, True), ("5", 30, 0, False), ("None", 20, 20, True), ("None", 30, 0, False)]
    assert sorted(str(r["doc_id"]) for r in contamination.clean_rows(frame(spark, rows), items, scratch(spark)).collect()) == ["5", "None"]


def test_language_reads_long_runs_whole():
    """Text without spaces is labelled by all its letters: two runs that differ only far inside differ in their words."""
    left, right = "a" * 30 + "bcd" * 20 + "a" * 30, "a" * 30 + "xyz" * 20 + "a" * 30
    assert "".join(language.WORD.findall(left)) == left and language.WORD.findall(left) != language.WORD.findall(right)
    assert all(len(w) <= 24 for w in language.WORD.findall(left))
    pools = [("en", " ".join(["the", "house", "and", "garden", "with", "wood"] * 12)), ("xx", "qzxqzxqzxq" * 40)] * 30
    label = language.Labeller(language.fit(pools))
    assert label(["the house and the garden", "with" + "qzxqzxqzxq" * 30 + "with"])[1][0] == "xx"
