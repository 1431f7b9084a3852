"""Embedding near dedup, centroid clustering and conversation repair against brute force on awkward rows."""

import hashlib
import math
import random
from itertools import groupby

import numpy as np
import pytest

from lodeseek.llm import centroids, embedding_near, queries, repair
from lodeseek.llm.common import Scratch
from lodeseek.llm.graph import components

VECTORS = "vec_id long, embedding array<double>, label int, n long, x string, node string, component string, digest string, cluster int, distance long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], VECTORS)


def near_rows():
    rng = np.random.default_rng(7)
    rows, at = [], 0
    for label, dims, n in ((1, 64, 60), (2, 64, 50), (3, 5, 80), (4, 1, 12), (5, 300, 20)):
        base = rng.normal(size=(n, dims))
        for v in base:
            rows.append((at, v.tolist(), label))
            at += 1
            if rng.random() < 0.5:
                near = v + rng.normal(size=dims) * np.linalg.norm(v) / math.sqrt(dims) * rng.choice([0.05, 0.2, 0.38, 0.6])
                rows.append((at, (near * rng.choice([1, 1e-3, 50])).tolist(), label))
                at += 1
    one = rows[0][1]
    rows += [(at, one, 1), (at + 1, one, 1), (at + 1, one, 1), (at + 2, one, 2), (at + 3, one, None), (None, one, 1), (at + 4, None, 1),
             (at + 5, [], 1), (at + 6, [0.0] * 64, 1), (at + 7, [float("nan")] + one[1:], 1), (at + 8, [float("inf")] + one[1:], 1),
             (at + 9, [None] + one[1:], 1), (at + 10, one[:63], 1), (at + 11, (np.array(one) * 1e300).tolist(), 1), (None, [1.0, 2.0], 9), (None, None, None)]
    return rows


def near_brute(rows):
    def units(i, v, label):
        if label is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    unit, group = [units(*r) for r in rows], list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((r[0], n, least[g], r[0] == least[g]) for r, n, g in zip(rows, links, group)), key=str)


@pytest.mark.parametrize("bucket", [embedding_near.BUCKET, 5])
def test_embedding_links(spark, bucket):
    """With small buckets the hashes are longer and the buckets that are still large are compared block by block."""
    rows = near_rows()
    got = embedding_near.dedup(vectors(spark, rows), Scratch(spark, "test"), bucket).collect()
    assert sorted((tuple(r) for r in got), key=str) == near_brute(rows)
    assert embedding_near.dedup(vectors(spark, []), Scratch(spark, "test")).count() == 0


def test_embedding_codes():
    """Estimates are unbiased within the grid's error, and no pair at the threshold is settled as below it."""
    rng = np.random.default_rng(1)
    for size in (4, 64, 256):
        a = rng.normal(size=(4000, size))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(1)[:, None] * a
        b = 0.93 * a + math.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
        (ca, sa, fa), (cb, sb, fb) = embedding_near.encode(a), embedding_near.encode(b)
        (signs, grid), (signs_b, grid_b) = embedding_near.decode(ca, sa), embedding_near.decode(cb, sb)
        estimate = ((signs * grid_b).sum(1) / fa + (signs_b * grid).sum(1) / fb) / 2 / math.sqrt(size)
        bound = (embedding_near.deviation(size, sa, fa) + embedding_near.deviation(size, sb, fb)) / 2
        assert abs(estimate.mean() - 0.93) < 0.02 and (estimate >= 0.93 - bound).all()
        # of random pairs nearly all are settled, where there are dimensions enough to tell
        if size >= 64:
            other = np.roll(np.arange(len(a)), 1)
            assert ((signs * grid[other]).sum(1) / fa / math.sqrt(size) < 0.93 - bound).mean() > 0.999
        assert (1 - embedding_near.agreement(size)) ** embedding_near.bands(size, 1) <= 1.01 * embedding_near.MISS


def test_embedding_recall(spark):
    """Pairs just above the threshold among many others: all are found."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.935 * a + math.sqrt(1 - 0.935 ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r["vec_id"]: r["component_id"] for r in embedding_near.dedup(vectors(spark, rows), Scratch(spark, "test"), 64).collect()}
    assert sum(got[1500 + i] == i for i in range(1500)) >= 1499


def assign(rows, centres):
    return [min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centres)) for v in rows]


@pytest.mark.parametrize("size", [1.0, 1e12])
def test_centroids(spark, size):
    """Ties, repeated rows and ids, left-out vectors; with large components distances pass 64 bits and are capped in the output only."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2, 3, 64) / 4 * size).tolist(), 0) for i in range(90)]
    rows += [rows[3], rows[4], (None, rows[5][1], None), (200, None, 1), (201, [], 1), (202, [1.0] * 63, 1), (203, [float("nan")] * 64, 1),
             (204, [None] * 64, 1), (205, [float("inf")] * 64, 1)]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(good, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in ranked[:40]]
    for _ in range(5):
        near = assign([v for _, v in good], centres)
        for c in range(40):
            mine = [v for (_, v), (_, n) in zip(good, near) if n == c]
            centres[c] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centres[c]
    near = assign([v for _, v in good], centres)
    top = (1 << 63) - 1
    inertia = {c: sum(d for d, n in near if n == c) for c in range(40)}
    expected = [(i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top)) for (i, _), (d, c) in zip(good, near)]
    got, last = centroids.cluster(vectors(spark, rows), Scratch(spark, "test"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert [[int(x) for x in c] for c in last] == centres
    none, _ = centroids.cluster(vectors(spark, []), Scratch(spark, "test"))
    assert none.count() == 0


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(2)
    rows, centres = rng.integers(-400, 400, (500, 2)), rng.integers(-400, 400, (40, 2))
    lists = centroids.SortedLists(centres)
    number, best = lists.nearest(rows)
    exact = ((rows[:, None] - centres) ** 2).sum(2)
    assert (number == exact.argmin(1)).all() and (best == exact.min(1)).all() and lists.computed < 0.4 * exact.size


def repair_brute(rows):
    """(cost, audit, repaired rows) by trying all edits, state by state."""
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def close(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                new = (cost + 3, audit + "I", out + [(names[forced[state]], "")])
                best[forced[state]] = min(best.get(forced[state], new), new)
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        after: dict[str, tuple] = {}
        for state, (cost, audit, out) in close(best).items():
            ways = [(state, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((forced[state], (cost + 3 + more, audit + "R", out + [(names[forced[state]], text)])))
                if role[:1] == forced[state] or (role[:1] == "s" and state == ""):
                    ways.append((role[:1], (cost + more, audit + "K", out + [(role, text)])))
            for to, new in ways:
                after[to] = min(after.get(to, new), new)
        best = after
    close(best)
    return min(best[s] for s in ("", "a") if s in best)


def summary_brute(rows):
    tie = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    rows = [(turn, role if role is not None else " ", text if text is not None else " ") for turn, role, text in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))
    seen, named = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        named.append((role, text, fault))
    cost, audit, out = repair_brute(named)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == kind for *_, f in named) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(named, named[1:]))
    return (gaps, *count, illegal, cost), audit, out


@pytest.mark.parametrize("block", [repair.BLOCK, 4])
def test_repair(spark, block):
    """A block of four rows cuts most conversations, so costs and entry states pass through the doubling joins."""
    rng = random.Random(4)
    texts = ["Yes.", "Yes.", "no", "", " \n", None, "Well!  ", "So?\t", "a\x0bb", "long " * 30_000 + "end.", "ok。"]
    rows = [(conv, rng.choice([None, 3, *range(9)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            for conv in [*range(25), None] for _ in range(rng.randrange(1, 14))]
    rows += [(77, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{i}."])) for i in range(150)]
    rows += [(78, i, "system", "Same.") for i in range(30)] + [(79, 1, "user", "Same.")] * 20 + [(80, None, "assistant", "")] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, g int")
    out = repair.repair(df, Scratch(spark, "test"), block)
    summary = {r["conv_id"]: tuple(r)[1:] for r in out.summary.collect()}
    edits = sorted(out.edits.collect(), key=lambda r: (str(r["conv_id"]), r["at"], r["seq"]))
    found = {k: list(v) for k, v in groupby(edits, key=lambda r: r["conv_id"])}
    assert set(summary) == {r[0] for r in rows} and set(found) <= set(summary)
    for conv in summary:
        numbers, audit, texts_out = summary_brute([r[1:] for r in rows if r[0] == conv])
        assert summary[conv] == numbers, conv
        assert "".join(r["edit"] for r in found.get(conv, [])) == audit, conv
        assert [(r["role"], r["text"]) for r in found.get(conv, []) if r["edit"] != "D"] == texts_out, conv
    none = repair.repair(df.where("conv_id < 0"), Scratch(spark, "test"))
    assert none.summary.count() == none.edits.count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in (None, 5) for t in [None, *range(30)] for r, x in (("assistant", "A. b! c? d"), (None, None))]
    got = queries.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate({46: None, 33: None, 63: None}) if kind == 2 else x
        expected += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_components(spark):
    """Chains, cycles, stars and double links against a plain union."""
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(i, i + 1) for i in range(100, 120)] + [(120, 100), (120, 100), (100, 120), (300, 300)]
    pairs += [(200, 200 + i) for i in range(1, 9)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    group = {n: n for p in pairs for n in p}
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {n: new if g == old else g for n, g in group.items()}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert len(got) == len(linked) and {r["node"]: r["component"] for r in got} == {n: group[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
