"""Identity rules, text expressions, page text, vectors."""

import fnmatch

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.config import env_flag, env_number, env_text
from lodeseek.functions import ids, text
from lodeseek.functions.html import page_text
from lodeseek.functions.vectors import cosine, embed_text, hashing_embedder, retrying


def test_slug(values):
    cases = {
        "Neo4J": "neo4j", "Neo4j": "neo4j", "Chain-of-Thought": "chain_of_thought", "  LangChain+Neo4j ": "langchain_neo4j",
        "!!!": "unknown", "": "unknown", "임베딩(Embedding)": "임베딩_embedding", "\t a\n": "a", "_x_": "x",
    }
    assert values(ids.slug("x"), list(cases)) == list(cases.values())


def test_entity_and_relation_ids(values, spark):
    assert values(ids.entity_id("x"), ["ReAct", "ent_react", "ent_Foo Bar"]) == ["ent_react", "ent_react", "ent_Foo Bar"]
    rel = ids.relation_id(F.lit("ent_react"), F.lit("EXTENDS"), F.lit("Chain of Thought"))
    assert spark.range(1).select(rel).first()[0] == "rel_react_extends_chain_of_thought"
    assert values(ids.code_chunk_id("x", F.lit("f"), F.lit(1)), ["a.py"]) == ["a.py#f#1"]
    assert values(ids.text_chunk_id("x"), ["7"]) == ["chunk_7"]


def test_python_space_rules(values):
    odd = ["  a b ", "\x1ca\x1f", "　x y ", "", " \t ", "a\x0bb\x0cc\x85d"]
    assert values(text.py_strip("x"), odd) == [s.strip() for s in odd]
    assert values(text.collapse_space("x"), odd) == [" ".join(s.split()) for s in odd]
    assert values(text.words("x"), odd) == [s.split() for s in odd]
    assert values(text.has_text("x"), odd) == [bool(s.strip()) for s in odd]


def test_path_parts(values):
    assert values(text.first_segment("x"), ["a/b/c", "", "/x"]) == ["a", "?", "?"]
    assert values(text.file_stem("x"), ["d/01.intro.md", "README", ".hidden"]) == ["01.intro", "README", ".hidden"]
    assert values(text.file_suffix("x"), ["a/B.PY", "x.min.js", "noext", "d.d/file"]) == [".py", ".js", "", ""]


def test_glob_matches_fnmatch(values):
    paths = ["explain/data.js", "a/b/explain/data.js", "explain/data.jsx", "xexplain/data.js", "a/t.py", "a/[x].py"]
    for pattern in ("explain/data.js", "*.py", "a/?.py", "a/[a-t].py", "a/[!t].py"):
        got = values(text.matches_glob("x", [pattern]), paths)
        assert got == [fnmatch.fnmatchcase(p, pattern) or fnmatch.fnmatchcase(p, "*/" + pattern) for p in paths]


def test_find_from(values, spark):
    df = spark.createDataFrame([("abcabc", "abc", 1), ("abcabc", "abc", 4), ("abc", "z", 2)], "t string, p string, c int")
    assert [r[0] for r in df.select(text.find_from("t", "p", "c")).collect()] == [3, 0, 2]


def test_small_text_rules(values):
    assert values(text.failure_reason("x"), ["E: 429", "Too Many Requests", "bad json"]) == ["rate_limit", "rate_limit", "parse_error"]
    assert values(text.percent("x"), [0.125, 0.995], "x double") == [13, 100]
    assert values(text.newline_count("x"), ["a\nb\n"]) == [2]


def test_env(monkeypatch):
    monkeypatch.setenv("K", "")
    assert env_text("K", "d") == "d" and env_number("K", 3) == 3 and env_flag("K", True) is True
    monkeypatch.setenv("K", "bad")
    assert env_number("K", 3) == 3 and env_number("K", 1.5, float) == 1.5 and env_flag("K", True) is False
    monkeypatch.setenv("K", "Yes")
    assert env_flag("K", False) is True


@pytest.mark.parametrize("html, expected", [
    ("<body><nav>no</nav><article><h1>T</h1><script>x()</script><p>a  b</p></article><p>out</p></body>", "T a b"),
    ("<body><main>m <b>x</b></main>rest</body>", "m x"),
    ("<body><header>h</header>b<style>s</style> c</body>", "b c"),
    ("just text &amp; more", "just text & more"),
    ("<article>one</article><article>two</article>", "one"),
    ("", ""),
])
def test_page_text(html, expected):
    assert page_text(html, 2000) == expected


def test_page_text_limit():
    assert page_text("<p>" + "a" * 50 + "</p>", 10) == "a" * 10


def test_cosine_and_embedding(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got == pytest.approx([2 ** -0.5, 0.0])
    texts = ["hello world", "", "world hello", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embed_text("t", batch=2)).collect()
    expected = hashing_embedder()(texts)
    assert np.allclose([r[0] for r in rows], expected) and np.allclose(expected[0], expected[2])
    assert np.linalg.norm(expected[1]) == 0


def test_retrying_embedder():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise TimeoutError
        return [[1.0]] * len(texts)

    waits = []
    call = retrying(flaky, retries=6, base_delay=1.0, jitter=lambda: 0, sleep=waits.append)
    assert call(["a", "b"]) == [[1.0], [1.0]] and waits == [1.0, 2.0]

    class Denied(Exception):
        status_code = 401

    def denied(texts):
        calls.append("denied")
        raise Denied

    calls.clear()
    with pytest.raises(Denied):
        retrying(denied, sleep=waits.append)(["a"])
    assert calls == ["denied"]

    def broken(texts):
        calls.append("broken")
        raise TimeoutError

    calls.clear()
    with pytest.raises(TimeoutError):
        retrying(broken, retries=3, jitter=lambda: 0, sleep=lambda s: None)(["a"])
    assert len(calls) == 3
