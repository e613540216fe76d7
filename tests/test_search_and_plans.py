import pyarrow as pa
import pytest

from lakemill.functions.stemmer import stem
from lakemill.operators import search as search_module
from lakemill.operators.filters import apply_filters
from lakemill.operators.search import SearchIndex, inverted_index, parse_query, search, search_page
from lakemill.plans.operations import ResultCache, layout_advice, params_key, plan_facts, timed
from lakemill.streaming.incremental import stream_csv, windowed_counts


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "the quick brown fox"), (2, "quick quick rabbit and the fox"), (3, "Brown bread; quick!"), (4, None), (5, "fox brown")]
    return spark.createDataFrame(rows, "_row_id long, body string")


@pytest.mark.parametrize("text, kind", [("hello", "simple"), ('"exact phrase"', "phrase"), ("hello AND world", "boolean"), ('"foo" OR "bar"', "boolean"), ("hello -world", "simple")])
def test_kinds(text, kind):
    assert parse_query(text).kind == kind


def test_empty_query():
    with pytest.raises(ValueError):
        parse_query("  ")


@pytest.mark.parametrize("text, ids", [("quick", [2, 1, 3]), ("quick fox", [1, 2]), ('"brown fox"', [1]), ("rabbit or bread", [2, 3]), ("quick -fox", [3]), ("the", []), ("fox AND brown", [5, 1])])
def test_matches(texts, text, ids):
    assert sorted(r["_row_id"] for r in search(texts, text).collect()) == sorted(ids)


def test_rank(texts):
    got = {r["_row_id"]: r["score"] for r in search(texts, "rabbit").collect()}
    assert got[2] == pytest.approx(0.057309, abs=1e-6)
    assert [r["_row_id"] for r in search(texts, "quick").collect()] == [2, 1, 3]
    page = search_page(texts, "quick", page=2, page_size=2)
    assert page.total == 3 and [r["_row_id"] for r in page.rows.collect()] == [3]


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("running", "run"), ("hoping", "hope"), ("agreed", "agre"), ("generously", "generous"), ("happy", "happi"), ("relational", "relat"), ("national", "nation"), ("skies", "sky"), ("news", "news"), ("knightly", "knight"), ("consolations", "consol"), ("consistency", "consist"), ("boy", "boy"), ("by", "by"), ("communication", "communic"), ("argument", "argument"), ("falling", "fall"), ("controlling", "control")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_search_by_stems(spark):
    df = spark.createDataFrame([(1, "running shoes"), (2, "she runs home"), (3, "a runner")], "_row_id long, body string")
    assert sorted(r["_row_id"] for r in search(df, "run", stems=True).collect()) == [1, 2]
    assert [r["_row_id"] for r in search(df, '"runs shoe"', stems=True).collect()] == [1]
    assert search(df, "run", stems=False).count() == 0


def test_index(texts):
    rows = {(r["term"], r["_row_id"]): r["places"] for r in inverted_index(texts, "body").collect()}
    assert rows["quick", 2] == [1, 2] and ("fox", 4) not in rows


@pytest.mark.parametrize("query", ["quick", "quick fox", '"brown fox"', '"quick the fox"', "rabbit or bread", "quick -fox", "-fox", "the", "fox AND brown", '"quick quick"', "breads"])
def test_search_by_an_index_is_that_of_the_texts(spark, texts, tmp_path, query):
    index = SearchIndex(spark, f"file://{tmp_path}/index").build(texts, ["body"])
    want = [(r["_row_id"], pytest.approx(r["score"])) for r in search(texts, query).collect()]
    got = [(r["row_id"], r["score"]) for r in index.search(query).collect()]
    assert got == want


def test_an_index_holds_a_row_per_term_of_many_texts(spark, tmp_path, monkeypatch):
    """Not one per text and term; pieces of few words and a repeated id give the same places."""
    rows = [(k % 300, f"words of text word{k} words") for k in range(301)]
    df = spark.createDataFrame(rows, "_row_id long, body string").coalesce(1)
    index = SearchIndex(spark, f"file://{tmp_path}/index").build(df, ["body"])
    assert spark.read.parquet(f"file://{tmp_path}/index/terms").count() == 301 + 3
    assert index.search("words text").count() == 300 and index.search("word300 word0").count() == 1
    batch = pa.RecordBatch.from_pydict({"row_id": [k for k, _ in rows], "words": [t.split() for _, t in rows]})
    told = lambda: sorted((t, i, p) for b in search_module._postings([batch]) for r in b.to_pylist() for t, i, p in zip([r["term"]] * len(r["rows"]), r["rows"], map(tuple, r["places"])))
    want = told()
    monkeypatch.setattr(search_module, "SORTED_WORDS", 7)
    monkeypatch.setattr(search_module, "REMEMBERED", 2)
    assert told() == want and ("word", 5, (1, 5)) in want


def test_index_is_built_once_and_dropped(spark, texts, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(LookupError):
        index.search("fox")
    assert not index.exists and index.build(texts, ["body"]).exists
    index.build(texts.limit(0), ["body"])  # complete: kept
    assert index.search("fox").count() == 3
    assert index.drop() and not index.exists and not index.drop()
    assert index.build(texts.limit(0), ["body"]).search("fox").count() == 0


def test_pushed_filter(spark, tmp_path, people):
    people.write.parquet(f"file://{tmp_path}/p")
    facts = plan_facts(apply_filters(spark.read.parquet(f"file://{tmp_path}/p"), [{"column": "age", "operator": ">", "value": 3}]))
    assert facts.pushed and not facts.advice and not facts.python
    assert plan_facts(spark.read.parquet(f"file://{tmp_path}/p")).advice


def test_cache():
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    calls = []
    run = lambda: calls.append(1) or "x"
    assert cache.get_or_compute(1, {"a": 1}, run) == cache.get_or_compute(1, {"a": 1}, run) == "x" and len(calls) == 1
    now[0] = 11
    cache.get_or_compute(1, {"a": 1}, run)
    assert len(calls) == 2
    cache.set(2, "k", 1), cache.set(3, "k", 1)
    assert cache.get(1, params_key({"a": 1})) is None and cache.invalidate(2) == 1
    assert cache.warm(3, [({"z": 1}, run), ({"z": 2}, lambda: 1 / 0)]) == 1
    assert params_key({"a": 1, "b": 2}) == params_key({"b": 2, "a": 1}) and len(params_key({})) == 16
    assert timed(lambda: 5)[0] == 5


def test_advice(people):
    advice = {(a.column, a.layout, a.together_with) for a in layout_advice(people, searched=["name"])}
    assert ("age", "sort", None) in advice and ("city", "bloom", None) in advice and ("joined", "sort", "age") in advice and not any(a[0] == "name" for a in advice)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("d,v\n2024-01-15,1\n15/01/2024,x\n")
    rows = stream_csv(spark, f"file://{tmp_path}/in", {"d": "date", "v": "numeric"})
    q = rows.writeStream.format("memory").queryName("typed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r["d"]), r["v"]) for r in spark.table("typed").collect()} == {("2024-01-15", 1.0), ("2024-01-15", None)}
    events = spark.sql("SELECT timestamp'2024-01-01 03:00:00' AS ts, 'a' AS event_type, 2.0D AS value")
    assert windowed_counts(events).first()["n"] == 1
