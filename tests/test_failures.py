"""One failing part leaves the rest of a batch alone."""

from pyspark.sql import functions as F

from lodeseek.functions.html import page_text
from lodeseek.operators import acquire, answer
from lodeseek.operators.answer import rerank


def test_an_unclosed_element_ends_with_its_parent():
    assert page_text("<body><div><nav>menu</div><p>kept text</p></body>", 100) == "kept text"
    assert page_text("<body><nav>a<p>b</nav>c<article>d<header>e</article>f</body>", 100) == "d"
    assert page_text("<p>one</b><br>two", 100) == "one two"


def test_a_failing_scorer_keeps_own_scores(spark):
    rows = [(1, 0, "a", 0.2), (1, 1, "b", 0.9)]
    candidates = spark.createDataFrame(rows, "query_id long, pos long, rerank_text string, score double")
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")

    def broken(query, text):
        raise ValueError("no model")

    got = rerank(candidates, broken, queries).orderBy("rank").collect()
    assert [(r["rerank_text"], r["score"]) for r in got] == [("b", 0.9), ("a", 0.2)]


def test_a_refused_search_leaves_the_other_queries(spark):
    def search(query, limit=None):
        if query == "bad":
            raise acquire.Blocked("403")
        return [{"title": "t", "href": "u", "body": "s"}]

    queries = spark.createDataFrame([(1, "bad"), (2, "good")], "query_id long, query string").coalesce(1)
    pages = spark.createDataFrame([], "url string, status int, html string")
    got = acquire.web_search(queries, search, pages, F.lit("now")).collect()
    assert [(r["query_id"], r["text"]) for r in got] == [(2, "s")]


def test_ranks_past_a_million_keep_the_source_order(spark):
    code = spark.createDataFrame([(1, 5_000_000, "c", "s", "t")], "query_id long, rank long, chunk_id string, signature string, text string")
    entity = spark.createDataFrame([(1, 0, "e", "n", "d", 0.5)], "query_id long, rank long, id string, name string, description string, score double")
    web = spark.createDataFrame([], "query_id long, rank long, url string, fetched_at string, title string, text string, snippet string, score double")
    video = spark.createDataFrame([], "query_id long, rank long, url string, fetched_at string, title string, transcript string, score double")
    got = answer.merge_candidates(code, entity, web, video).orderBy("pos").collect()
    assert [r["source_type"] for r in got] == ["code", "textbook"]


def test_rerank_fails_by_query(spark):
    """A scorer that fails for one query, or leaves out a candidate of another, leaves only those with their own scores."""
    rows = [(q, n, "web", f"{q}{n}", None, None, f"text {n}", 0.9 - n / 10) for q in ("good", "bad", "short") for n in range(4)]
    candidates = spark.createDataFrame(rows, "query_id string, pos long, source_type string, ref string, url string, fetched_at string, rerank_text string, score double")
    asked = spark.createDataFrame([(q, q) for q in ("good", "bad", "short")], "query_id string, query string")

    def scorer(queries, texts):
        assert len(set(queries)) == 1 and len(texts) == 4
        if queries[0] == "bad":
            raise RuntimeError("no model")
        return [None if queries[0] == "short" and n == 2 else float(n) for n in range(4)]

    got = {}
    for r in rerank(candidates, scorer, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["ref"], r["score"]))
    assert got["good"] == [(f"good{n}", float(n)) for n in (3, 2, 1, 0)]
    for q in ("bad", "short"):
        assert [ref for ref, _ in got[q]] == [f"{q}{n}" for n in range(4)] and all(s < 1 for _, s in got[q])
