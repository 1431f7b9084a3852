"""Web and video acquisition."""

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import acquire as Q

ASKED = "query_id long, query string"


def hit(**fields):
    return {"title": "T", **fields}


def test_search_parse_and_urls(spark):
    def search(query):
        return [hit(href="http://a", body="sa"), hit(title=None, link="http://b", snippet="sb"), hit(body="no url"), hit(url="http://c")] * 3

    asked = spark.createDataFrame([(1, "x")], ASKED)
    hits = Q.usable_hits(Q.raise_if_blocked(Q.search_hits(asked, search)))
    rows = hits.orderBy("hit_rank").collect()
    assert len(rows) == 8 and [r["url"] for r in rows[:3]] == ["http://a", "http://b", "http://c"] and rows[1]["title"] == ""
    scores = [r["score"] for r in Q.score_hits(hits).orderBy("rank").collect()]
    assert scores == [round(1 - n / 8, 4) for n in range(8)]


def test_pages_fall_back_to_snippets(spark):
    hits = spark.createDataFrame([(1, n, "t", f"u{n}", f"s{n}") for n in range(5)], "query_id long, hit_rank int, title string, url string, snippet string")
    pages = spark.createDataFrame([("u0", 200, "<body><article>ok</article></body>"), ("u1", 429, "<p>no</p>"), ("u2", 403, None), ("u3", 200, "<script>x</script>")],
                                  "url string, status int, html string")
    got = {r["url"]: r["text"] for r in Q.with_page_text(hits, pages).collect()}
    assert got == {"u0": "ok", "u1": "s1", "u2": "s2", "u3": "s3", "u4": "s4"}


def test_refused_and_failing_searches(spark, tmp_path):
    log = str(tmp_path / "calls")

    def search(query):
        with open(log, "a") as f:
            f.write(query + "\n")
        if query == "blocked":
            raise RuntimeError("Ratelimit 429")
        raise TimeoutError("slow")

    asked = spark.createDataFrame([(1, "blocked"), (2, "slow")], ASKED).coalesce(1)
    from lodeseek.runtime import stage
    hits = stage(Q.search_hits(asked, search, sleep=lambda s: None))
    assert {r["query_id"]: r["status"] for r in hits.collect()} == {1: "blocked", 2: "failed"}
    assert open(log).read().split() == ["blocked"] + ["slow"] * 3
    with pytest.raises(Exception, match="403/429"):
        Q.raise_if_blocked(hits).collect()
    assert Q.usable_hits(Q.raise_if_blocked(hits.where("query_id = 2"))).count() == 0


def test_whole_web_search(spark):
    asked = spark.createDataFrame([(1, "x")], ASKED)
    pages = spark.createDataFrame([("http://a", 200, "<article>body text</article>")], "url string, status int, html string")
    got = Q.web_search(asked, lambda q: [hit(href="http://a", body="s")], pages, F.lit("2026-01-01T00:00:00+00:00")).first()
    assert (got["rank"], got["text"], got["score"], got["fetched_at"][:4]) == (0, "body text", 1.0, "2026")


def test_videos(spark):
    as_of = F.lit("2026-07-01 00:00:00").cast("timestamp")
    found = spark.createDataFrame(
        [("q", n, f"v{n}", p) for n, p in enumerate(["2026-06-01", "2026-06-01", "2026-06-01", "2025-01-01", "2026-01-02"])],
        "query_id string, hit_rank int, video_id string, p string").withColumn("published_at", F.col("p").cast("timestamp"))
    stats = spark.createDataFrame([("v0", "5000"), ("v1", "100"), ("v2", "9000"), ("v3", "99999"), ("v4", None)], "video_id string, view_count string")
    ranked = Q.rank_videos(found, stats, as_of)
    assert [(r["video_id"], r["rank"], r["score"]) for r in ranked.orderBy("rank").collect()] == [("v2", 0, 1.0), ("v0", 1, 0.5)]
    texts = spark.createDataFrame([("v0", "words"), ("v2", "")], "video_id string, transcript string")
    left = Q.with_transcripts(ranked, texts).collect()
    assert [(r["video_id"], r["rank"], r["score"]) for r in left] == [("v0", 1, 0.5)]


@pytest.mark.parametrize("limit", [1_000, 7])
def test_transcripts(spark, limit):
    rows = [("a", n, t) for n, t in enumerate(["one", " ", "two", "", "three"])] + [("b", n, "x" * 99) for n in range(60)]
    segments = spark.createDataFrame(rows, "video_id string, n int, text string")
    got = {r["video_id"]: r["transcript"] for r in Q.transcripts(segments, ["video_id"], ["n"], limit=limit).collect()}
    assert got["a"] == "one two three" and got["b"] == " ".join(["x" * 99] * 60)[:3000]


def test_cache(spark):
    asked = spark.createDataFrame([("q1", "hello"), ("q2", "other")], "query_id string, query string")
    results = spark.createDataFrame([("q1", "v1")], "query_id string, video_id string")
    stored = Q.to_cache(results, asked)
    import hashlib
    assert stored.first()["cache_key"] == hashlib.sha256(b"hello").hexdigest()[:16]
    again = Q.cached(results.limit(0), stored, asked, asked)
    assert [tuple(r) for r in again.collect()] == [("q1", "v1")]


def test_pages_reach_python_in_small_batches(spark):
    """Not ten thousand pages at once, as in an Arrow batch."""
    from lodeseek.functions.html import extract_text

    out = spark.createDataFrame([("<body>a<nav>b</nav> c</body>",), (None,)], "html string").select(extract_text("html").alias("t"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r["t"] for r in out.collect()] == ["a c", ""]


def test_web_extract_returns_whole_texts(spark, tmp_path):
    """Only the first 2,000 characters came out before."""
    from lodeseek.plans import registry

    registry.load_all()
    words = [f"word{n}" for n in range(3000)]
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{w}</p>" for w in words) + "</article></body>"
    spark.createDataFrame([(1, page), (2, "<p>short</p>"), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["web_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: " ".join(words), 2: "short", 3: ""}
