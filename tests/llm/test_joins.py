"""Near duplicates, URL filters, vectors and the language model against brute force."""

import collections
import math
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemill.llm import components, elias_fano, embedding_dedup, lm_scoring, neighbours, ngram_join, url_filter
from lakemill.llm.bytewords import mix
from lakemill.llm.components import connected_components
from lakemill.llm.queries import ORACLES, QUERIES, SITE_RULES
from lakemill.llm.scratch import Scratch


def classes(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    links = rng.integers(0, 200, (120, 2)).tolist() + [(1000 + i, 1001 + i) for i in range(20)] + [(5, 5), (None, 3), (7, None), (1000, 1001)]
    clean = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = classes({n for e in clean for n in e}, clean)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("key", ["a", "b"])
def test_edges_of_one_node_are_dealt_over_tasks(spark, key):
    """A star's centre, at either end, is joined in several partitions, none of which holds most of its edges."""
    links = [(i, 0) if key == "b" else (9999, i) for i in range(1, 900)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = components._with_least(spark.createDataFrame(links, "a long, b long").repartition(2), key)
        sizes = [r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 899 and max(sizes) <= 600
    want = classes({n for e in links for n in e}, links)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


# Near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = collections.defaultdict(list)
    for i, text in rows:
        if i is not None and shingles(text):
            sets[i].append(shingles(text))
    held = collections.defaultdict(set)
    for i, some in sets.items():
        for s in some:
            for t in s:
                held[t].add(i)
    links = set()
    for i, some in sets.items():
        for j in {j for s in some for t in s for j in held[t] if j < i}:
            if any(100 * len(a & b) >= 75 * len(a | b) for a in some for b in sets[j]):
                links.add((i, j))
    return classes({i for i, _ in rows if i is not None}, links)


def check_near_duplicates(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_classes(rows)
    got = ngram_join.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(shingles(t))) for i, t in rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_near_duplicates(docs):
    check_near_duplicates(docs)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    check_near_duplicates(odd_docs.withColumns({"high": F.lit(1), "n": F.lit("q"), "component": F.lit(None)}))
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_an_id_with_unlike_texts_joins_all_of_their_classes(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    check_near_duplicates(spark.createDataFrame([(5, text("a")), (5, text("b")), (5, text("c")), (1, text("a")), (2, text("b")), (3, text("c")), (7, text("d"))], "doc_id long, text string"))


def test_large_group_of_near_copies_around_the_bound(spark):
    """Edits that put pairs on both sides of 0.75, a passage in many documents, and very short texts."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 7)))
    base, passage = [word() for _ in range(110)], [word() for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in rng.choice(110, rng.integers(0, 7), replace=False):
            w[k] = word()
        rows.append((i, " ".join(w)))
    for i in range(240, 400):
        rows.append((i, " ".join([*(word() for _ in range(rng.integers(5, 60))), *passage])))
    rows += [(400 + i, " ".join(base[: i % 9])) for i in range(40)]
    check_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))


def group_sizes(monkeypatch, schema):
    """The rows of the largest group of each ``applyInPandas`` with this schema, as they come."""
    from pyspark.sql import GroupedData

    sizes, real = [], GroupedData.applyInPandas

    def apply(self, f, out):
        if out == schema:
            sizes.append(self.count().agg(F.max("count")).first()[0])
        return real(self, f, out)

    monkeypatch.setattr(GroupedData, "applyInPandas", apply)
    return sizes


@pytest.mark.parametrize("tokens", [1_000_000, 1000])
def test_large_cluster_is_compared_in_bounded_groups(spark, tokens, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20 if tokens > 1000 else 512)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens, raising=False)
    rng = np.random.default_rng(9)
    base, rows = [f"w{k}" for k in range(50)], []
    for i in range(300):
        w = list(base)
        for k in rng.choice(50, rng.integers(0, 4), replace=False):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    sizes = group_sizes(monkeypatch, "a long, b long")
    check_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(sizes) == 1 and 20 < sizes[0] <= 100


# URL filters


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in SITE_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    import re

    words = set(re.findall("[A-Za-z0-9]+", host + path)) & set(url_filter.BLOCKED_WORDS)
    return host, path, best[0] if best else None, best[1] if best else "block" if words else "allow"


URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/7", "https://a.example.com/en/72?x=1", "https://example.com/en/8#t", "http://COM/en/", "http://com/en", "http://xcom/en/1", "http://x.net/de/8", "http://example.net/de/81", "http://www.example.net/de/7",
        "http://a.org/es/?q", "http://a.org?x=/es/", "http://casino.example.org/fr", "http://x.org/free-casino/1", "http://x.org/casinos", "a://b://c/en/", "http://u@h.com:80/en/", "http://\u00dc.com/en/\u00fc", "http://a.com/en/casino", "http://x.com/en/" + "y" * 100_000]


@pytest.mark.parametrize("joined", [False, True])
def test_urls(spark, joined, monkeypatch):
    if joined:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 10)
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(URLS)] + [(None, "http://com/en/1", 2, "h"), (1, "", 3, "h")], "page_id long, url string, token int, host string")
    rules = [url_filter.site_rule(*r) for r in SITE_RULES] + list(url_filter.DEFAULT_RULES)
    got = url_filter.judge(pages, rules).collect()
    want = [(i, *brute_url(u)) for i, u in enumerate(URLS)] + [(None, *brute_url("http://com/en/1")), (1, *brute_url(""))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {tuple(r)[3:] for r in url_filter.judge(pages, []).collect()} == {(None, "allow")}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_rules_without_a_token_over_the_bound(spark, monkeypatch):
    """They run in blocks, by Python's patterns; the longest host and path rule still wins."""
    rules = [url_filter.Rule(rf"^[^/]*\.x{{{k}}}(?P<end>/|$)", "block", None, ()) for k in range(1, 9)] + [url_filter.Rule(r"^(?=[^/]*%)", "block", "%", ()), url_filter.site_rule("allow", "a.xx/p")]
    urls = ["http://a.xx/p/1", "http://a.xx/q", "http://a.xxxxxxxxx/", "http://%.org/", "http://b.xxx", None, "http://a.xx/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    assert [r[4] for r in want] == ["allow", "block", "allow", "block", "block", "allow", "block"]
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 300)
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == want


@pytest.mark.parametrize("rule, verdict", [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")])
def test_verdicts_of_the_contract(spark, tmp_path, rule, verdict):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, f"http://{rule}x"), (2, f"https://a.{rule}/casino")], "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = QUERIES["op5_url_filter"](spark, f"file://{tmp_path}")
    assert [(r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == 2 * [(rule, verdict)]
    rows = duckdb.sql(ORACLES["op5_url_filter"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert [r[3:] for r in rows] == 2 * [(rule, verdict)]


def test_urls_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    found = con.execute(ORACLES["op5_url_filter"])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.01").select(columns).collect())) == sorted(found.fetchall())


# Vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows, centre = [], rng.normal(size=(6, 16))
    for i in range(700):
        v = centre[i % 6] + rng.normal(0, 0.12, 16) if i % 3 else rng.normal(size=16)
        rows.append((i, v.tolist()))
    rows += [(700 + i, centre[0].tolist()) for i in range(30)] + [(800, (2 * centre[0]).tolist()), (801, None), (802, []), (803, [0.0] * 16), (804, [float("nan")] * 16), (805, [1.0] * 15 + [None]), (806, [float("inf")] * 16), (None, centre[0].tolist()), (807, [1.0, 2.0]), (808, [2.0, 4.0]), (809, [-0.0, 1.0]), (810, [0.0, 1.0])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, raw string"), rows


def fine(i, v):
    return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicate_vectors(vectors, monkeypatch):
    df, rows = vectors
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    links = []
    ok = [(i, np.array(v)) for i, v in rows if fine(i, v)]
    for k, (i, a) in enumerate(ok):
        links += [(i, j) for j, b in ok[:k] if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95]
    n = collections.Counter(x for link in links for x in link)
    want = classes([i for i, _ in rows if i is not None], links)
    got = embedding_dedup.near_duplicate_vectors(df, recall=0.99999).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == ((n[i], want[i], want[i] == i) if i is not None else (0, None, False)), i
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_planted_near_copies(spark, kind):
    """Pairs just over 0.95 among unlike vectors, at the registered recall."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    for i in range(0, 1200, 2):  # near copies at cosines from 0.95 to 0.97
        u = x[i] / np.linalg.norm(x[i])
        side = rng.normal(size=64)
        side -= side @ u * u
        c = rng.uniform(0.9501, 0.97)
        x[i + 1] = c * u + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    n = np.linalg.norm(x, axis=1)
    links = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T / n[:, None] / n[None, :] >= 0.95, 1)))}
    assert len(links) == 600
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    found = {(i, j) for i, j in links if got[i]["n_links"] and got[j]["component_id"] == got[i]["component_id"]}
    assert len(found) >= 0.97 * len(links) and sum(r["n_links"] for r in got.values()) == 2 * len(found)


def test_nearest(spark, vectors):
    df, rows = vectors
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=20).collect()
    ok = {i: np.array(v) for i, v in rows if fine(i, v)}
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in ok if i % 5 == 0}
    hit = total = 0
    for q, some in found.items():
        assert [x for x, _ in some] == [x for x, _ in sorted(some, key=lambda x: (-x[1], x[0]))] and len(some) <= 20 and q not in dict(some)
        for x, s in some:
            assert s == pytest.approx(float(ok[q] @ ok[x]), rel=1e-12)
        want = sorted((-(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
        if len(ok[q]) == 2:  # three other rows of this length
            assert [i for _, i in want] == [x for x, _ in some] and len(some) == 3
        hit, total = hit + len({i for _, i in want} & set(dict(some))), total + len(want)
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id IN (1, 5, 7)"), F.col("vec_id") == 5).collect()
    assert {r["vec_id"] for r in few} <= {1, 7}


def test_large_bucket_is_compared_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "_BIN", 80)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(0, 0.01, 16) if i < 300 else rng.normal(size=16)).tolist()) for i in range(400)]
    sizes = group_sizes(monkeypatch, "a long, b long, links long")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["n_links"] == 299 and got[i]["component_id"] == 0 for i in range(300))
    assert len(sizes) == 1 and 20 < sizes[0] <= 200


def brute_nearest(rows, queries, k=20):
    ids = np.array(sorted({i for i, _ in rows}))
    out = {}
    for q in queries:
        own = min((v for i, v in rows if i == q), key=lambda v: np.array(v).tobytes())
        best = collections.defaultdict(lambda: -math.inf)
        for (i, _), s in zip(rows, (np.array([v for _, v in rows]) @ np.array(own)).tolist()):
            best[i] = max(best[i], s)
        out[q] = sorted((i for i in ids.tolist() if i != q), key=lambda i: (-best[i], i))[:k]
    return out


def found_nearest(df, every, k=20):
    out = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % every == 0, k=k).collect(), key=lambda r: r["rank"]):
        out[r["query_id"]].append(r["vec_id"])
    return out


def test_nearest_outside_of_tight_groups(spark):
    """Most rows lie in a few tight groups, whose distances tell nothing of the other rows'."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(6, 64))
    x = [centre[rng.integers(6)] + rng.normal(0, 0.01, 64) if i % 5 < 3 else rng.normal(size=64) for i in range(4000)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    got = found_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 13)
    assert all(len(got[q]) == 20 for q in range(0, 4000, 13))
    for dense in (True, False):
        want = brute_nearest(rows, [q for q in range(0, 4000, 13) if (q % 5 < 3) == dense])
        assert sum(len({*got[q]} & {*some}) for q, some in want.items()) / (20 * len(want)) >= 0.9, dense


@pytest.mark.parametrize("n", [1, 2, 15, 21])
def test_nearest_of_few_rows_is_all_of_them(spark, n):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 24)))]
    got = found_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1)
    assert {q: got[q] for q in range(n)} == brute_nearest(rows, range(n))


@pytest.mark.parametrize("kind", ["uniform", "mixed"])
def test_share_of_the_rows_that_visits_open(kind):
    """Without Spark: buckets and visits of the tables open well under a half of unstructured rows, the worst case, and few of grouped ones."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    if kind == "mixed":
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    tables = neighbours.Tables.fit(ids[::5], x[::5], 1.0, len(x), 20, 6)
    code = tables.buckets(x)
    asked = ids[::250]
    q = tables.asked(x[asked])
    _, there, drift, spread = tables.expected(q, asked)
    opened, scored, hit = 0, 0, 0
    for i, own in enumerate(asked):
        found = np.array([np.isin(code[t], some) for t, some in enumerate(tables.visits(q[i], float(there[i]), drift[i], float(spread[i]), 0.93))])
        opened, scored = opened + found.any(axis=0).mean() / len(asked), scored + found.sum() / len(x) / len(asked)
        near = x @ x[own]
        near[own] = -9
        hit += found.any(axis=0)[np.argsort(-near)[:20]].sum() / 20 / len(asked)
    assert hit >= 0.9 and opened < (0.48 if kind == "uniform" else 0.1) and scored < (0.7 if kind == "uniform" else 0.2), (hit, opened, scored)


def test_nearest_of_a_large_bucket_and_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=12)
    rows = [(i, (centre + rng.normal(0, 0.001, 12)).tolist() if i < 300 else rng.normal(size=12).tolist() if i < 500 else rng.normal(size=5).tolist() if i < 600 else rng.normal(size=3).tolist()) for i in range(620)]
    got = found_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10)
    assert all(len(got[q]) == (20 if q < 600 else 19) for q in range(0, 620, 10))
    hit = 0
    for q in range(0, 620, 10):
        same = [(i, v) for i, v in rows if len(v) == len(rows[q][1])]
        hit += len({*got[q]} & {*brute_nearest(same, [q])[q]}) / len(got[q])
    assert hit / 62 >= 0.9


def test_nearest_counts_a_repeated_id_once(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=16)
    rows = [(0, near.tolist())] + [(1, (3 * near + rng.normal(0, 0.01, 16)).tolist()) for _ in range(60)] + [(i, rng.normal(size=16).tolist()) for i in range(2, 30)]
    got = found_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 30)
    assert len(got[0]) == len(set(got[0])) == 20 and got[0][0] == 1


def test_nearest_deals_queries_into_blocks(vectors, monkeypatch):
    from pyspark.sql import GroupedData

    df, sizes, real = vectors[0], [], GroupedData.cogroup

    def cogroup(self, other):
        sizes.append(other.count().agg(F.max("count")).first()[0] or 0)
        return real(self, other)

    monkeypatch.setattr(GroupedData, "cogroup", cogroup)
    want = found_nearest(df, 5)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 4000, raising=False)
    assert found_nearest(df, 5) == want
    assert sizes[0] > 100 and max(sizes[1:]) < 40


def test_recall_on_the_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op9_nearest"](spark, "/root/testdata/sf0.1").collect()}
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        want |= {(ids[q], i) for i in ids[np.argsort(-s, kind="stable")[:20]]}
    assert len(got & want) / len(want) >= 0.9


# Language model


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(0, 100_000, 7)), [0, 2**63, 2**64 - 1], [3] * 700 + [2**40] * 3])
def test_elias_fano(values):
    code = elias_fano.EliasFano.of(np.array(values, np.uint64))
    assert code.get(np.arange(len(values))).tolist() == values
    some = np.arange(0, len(values), 3)[::-1]
    assert code.get(some).tolist() == [values[k] for k in some]
    wanted = np.unique(np.array([0, 4, 5, 6, 9, 50_001, *values[::3], 2**64 - 1], np.uint64))
    at, equal = code.successors(wanted, block=64)
    assert at.tolist() == np.searchsorted(np.array(values, np.uint64), wanted).tolist() and equal.tolist() == [int(w) in set(values) for w in wanted]
    begin, end = np.full(len(wanted), len(values) // 3), np.full(len(wanted), len(values) * 2 // 3)
    at, equal = code.successors_within(begin, end, wanted)
    part = values[len(values) // 3 : len(values) * 2 // 3]
    assert (at - begin).tolist() == np.searchsorted(np.array(part, np.uint64), wanted).tolist() and equal.tolist() == [int(w) in set(part) for w in wanted]


def a_trie():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0).astype(np.uint64)
    contexts = np.unique(pairs[:, 0])
    trie = elias_fano.BigramTrie.of(pairs[:, 0], pairs[:, 1], -np.arange(len(pairs)) / 7.0, contexts * 3)
    every = np.stack(np.meshgrid(np.arange(310), np.arange(310), indexing="ij"), axis=-1).reshape(-1, 2).astype(np.uint64)
    return pairs, set(contexts.tolist()), trie, every


def test_trie():
    pairs, contexts, trie, every = a_trie()
    trie = elias_fano.BigramTrie.mapped(trie.to_bytes())
    counts, has, value = trie.find(every[:, 0], every[:, 1], step=1000)
    number = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    assert has.tolist() == [tuple(q) in number for q in every.tolist()]
    assert counts.tolist() == [3 * q[0] if q[0] in contexts else 0 for q in every.tolist()]
    for q, h, p in zip(every.tolist(), has, value):
        assert not h or abs(p + number[tuple(q)] / 7.0) <= len(pairs) / 7 / 256 + 1e-9
    empty = elias_fano.BigramTrie.mapped(elias_fano.BigramTrie.of(*[np.empty(0, np.uint64)] * 2, np.empty(0), np.empty(0, np.int64)).to_bytes())
    assert not empty.find(every[:, 0], every[:, 1])[1].any()


def test_trie_searches_by_its_pointers():
    pairs, _, trie, every = a_trie()
    pointers = trie.pointers.get(np.arange(trie.pointers.n)).astype(np.int64)
    cut = pointers.copy()
    cut[5:] = pointers[5]  # the contexts after the fifth have no place left to look in
    trie.pointers = elias_fano.EliasFano.of(cut)
    _, has, _ = trie.find(every[:, 0], every[:, 1])
    assert {tuple(q) for q in every[has].tolist()} == {tuple(p) for p in pairs[: pointers[5]].tolist()}


def check_scores(docs, rows, held, mu=20.0, df=None):
    df = docs if df is None else df
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(df, held, mu=mu).collect()}
    tokens = {i: [*plain(t), None] for i, t in rows}
    learnt = [w for i, w in tokens.items() if not got[i]["held_out"]]
    c, pairs = collections.Counter(x for w in learnt for x in w), collections.Counter(p for w in learnt for p in zip([0, *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        p = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
        score = sum(math.log10((pairs[h, x] + mu * p(x)) / ((len(learnt) if h == 0 else c[h]) + mu)) for h, x in zip([0, *w[:-1]], w))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) <= 0.03 * len(w)
    return got


def plain(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("shard", [None, 3000])
def test_scores(docs, shard, monkeypatch):
    if shard:
        monkeypatch.setattr(lm_scoring, "SHARD", shard)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = check_scores(docs, rows, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}


@pytest.mark.parametrize("head, shard", [(500, 2_500_000), (5, 3000)])
def test_words_beyond_the_head_keep_their_own_probability(docs, head, shard, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_scores(docs, rows, F.col("doc_id") % 3 == 0)


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_slice_and_of_a_trie():
    """Bytes a token at the peak; 64 and 163 before texts were cut, dealt and coded in steps."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 50_000) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    none = SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.int64)))
    dealing, n = lm_scoring._Dealing(8, 400, none), 401_000

    def deal():
        for x in dealing.bigrams(batch)[1]:
            assert len(x) == 6

    assert peak(deal) < 50 * n
    words = np.sort(rng.integers(0, 1 << 60, n).astype(np.uint64))
    args = (words, mix(words), np.linspace(0, 1, n), np.ones(n, np.int64))
    assert peak(lambda: elias_fano.BigramTrie.of(*args)) < 90 * n


def test_memory_of_looking_up_a_shard(monkeypatch):
    """A shard's rows are looked up some at a time, with the same sums."""
    rng = np.random.default_rng(2)
    none = SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.int64)))
    dealing, n, each = lm_scoring._Dealing(1, 400, none), 1_500_000, 25_000
    words = rng.integers(0, 1 << 60, 200_000).astype(np.uint64)
    tokens = [(words[rng.zipf(1.2, each) % 200_000], words[rng.integers(0, 200_000, each)] & np.uint64((1 << 48) - 1)) for _ in range(n // each)]
    rows = [(k, *lm_scoring._packed(w, b, np.sort(rng.integers(0, 100, each)).astype(np.uint16))) for k, (w, b) in enumerate(tokens)]
    got = pd.DataFrame(rows, columns=["slice", "word", "fan", "before", "times", "docs"])
    pairs = np.unique(np.array([(w, b) for x in tokens[:4] for w, b in zip(*x)], np.uint64), axis=0)
    trie = elias_fano.BigramTrie.of(pairs[:, 0], pairs[:, 1], np.linspace(-3, 1, len(pairs)), np.arange(len(np.unique(pairs[:, 0]))))
    run = lambda: list(lm_scoring._found(dealing, got, trie, 20.0, 0.1, 1e6))
    assert peak(run) < 60 * n  # all of them at once take over 100
    some = run()
    monkeypatch.setattr(lm_scoring, "_ASKED", 1 << 40)
    whole = run()
    assert len(some) == len(whole) == len(got)
    assert all(x[0] == y[0] and all(map(np.array_equal, x[1:], y[1:])) for x, y in zip(some, whole))


def test_scores_of_odd_rows(odd_docs, no_docs):
    got = lm_scoring.score_texts(odd_docs, F.col("doc_id") == 3).collect()
    assert len(got) == odd_docs.count() and {r["doc_id"] for r in got if r["held_out"]} == {3, None}
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (4, 5, 6))
    none = lm_scoring.score_texts(odd_docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
    assert lm_scoring.score_texts(no_docs, F.lit(False)).count() == 0


def test_a_kept_model_scores_other_texts_in_cuts(docs, monkeypatch):
    """Levels are read from the table that they were written to; a shard's queries may be cut."""
    monkeypatch.setattr(lm_scoring, "SHARD", 4000)
    model = lm_scoring.train(docs)
    assert model.tries.count() == model.dealing.shards > 3
    want = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "SHARD", 700)
    assert {r["doc_id"]: r["score"] for r in model.score(docs).collect()} == pytest.approx(want)


def test_more_words_than_the_head_at_its_size(spark):
    """300 000 distinct words: each keeps the probability of its own count."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3000)) + " common words") for i in range(100)] + [(100, "w5x7 w5x7 unseen common"), (101, "")]
    check_scores(None, rows, F.col("doc_id") >= 100, df=spark.createDataFrame(rows, "doc_id long, text string"))
