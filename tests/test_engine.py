"""The engine against hand-computed values, and every query against its SQL."""

import contextlib
import dataclasses
import http.server
import math
import threading

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.config import DEFAULTS
from findery.functions import hashing, html, stem, text, urls, vectors
from findery.functions.models import encode, hashing_encoder
from findery.operators import dedup, frontier, graph, index, indexing, search, store
from findery.plans import registry
from findery.session import snapshot
from findery.sources import batch, web
from findery.streaming import crawl

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect())


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    found = registry.QUERIES[name](spark, data)
    got = rows(found)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    asked = duck.sql(registry.ORACLE_SQL[name])
    names, want = list(asked.columns), asked.fetchall()
    assert sorted(found.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_idf(spark):
    for n, df, want in ((10, 1, 1.992430164690206), (10, 10, 0.04652001563489291), (3, 5, -0.3184537311185346)):
        assert math.isclose(one(spark, index.idf(F.lit(n), F.lit(df))), want, rel_tol=1e-12)


def test_bm25_of_one_term(spark):
    found = spark.createDataFrame([(1, 7, "t", 2, 3, 10, 10.0, 8)], "query_id int, doc_id int, term string, tf int, df int, n_docs int, avg_length double, length int")
    assert math.isclose(index.bm25(found, 5).first()["score"], 1.748293594355729, rel_tol=1e-12)
    assert index.prefilter(found.withColumn("n_docs", F.lit(7)).withColumn("df", F.lit(2)), 5).first()["score"] == 6
    assert index.bm25(found.withColumn("avg_length", F.lit(0.0)), 5).count() == 0
    missing = found.withColumn("length", F.lit(None).cast("int"))
    assert index.bm25(missing, 5, lengths_missing=True).first()["score"] > 0


def test_pagerank_leaks(spark):
    links = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    for k, want in ((1, (0.05, 0.19166666666666665, 0.475)), (10, (0.05, 0.07125, 0.1318125))):
        got = {r["node"]: r["rank"] for r in graph.pagerank(links, nodes, k).collect()}
        assert all(math.isclose(got[n], w, rel_tol=1e-9) for n, w in zip("ABC", want))
    assert graph.pagerank(links.limit(0), nodes.limit(0)).count() == 0


def test_blend(spark):
    near = spark.createDataFrame([(1, 5, 0.6), (1, 6, 0.1)], "query_id int, doc_id int, cosine double")
    ranks = spark.createDataFrame([(5, 0.02), (6, 0.05)], "doc_id int, rank double")
    got = {r["doc_id"]: r["score"] for r in search.blend(near, ranks).collect()}
    assert math.isclose(got[5], 0.541762004493847, rel_tol=1e-12)
    none = search.blend(near, ranks.limit(0)).collect()
    assert math.isclose(none[0]["score"], 0.42, rel_tol=1e-12)


def test_softmax_and_cosine(spark):
    assert math.isclose(one(spark, vectors.softmax(F.array(F.lit(1.0), F.lit(2.0))))[1], 0.7310585786300049, rel_tol=1e-12)
    assert one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(0.0))))[0] == 1.0
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_simhash_bit_order_and_empty(spark):
    docs = spark.createDataFrame([(1, ["abc"]), (2, []), (3, ["ab", "abcd"]), (4, None)], "doc_id int, tokens array<string>")
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", hashing.simhash(F.col("tokens")).alias("x")).collect()}
    assert got[1] == 1004948388347281417 and got[2] == got[4] == 0 and got[3] != 0


def test_jaccard_bound(spark):
    a = " ".join(f"w{i}" for i in range(50))
    near = one(spark, hashing.jaccard_distance(F.lit(a), F.lit(a + " x")))
    far = one(spark, hashing.jaccard_distance(F.lit(a), F.lit(" ".join(a.split()[:49]))))
    assert near < 0.02 and not far < 0.02
    assert one(spark, hashing.jaccard_distance(F.lit(""), F.lit(" "))) == 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=30))
def test_banded_search_is_exact(spark, values):
    values += [values[0] ^ 1, values[0] ^ 0b1111, values[0] ^ (1 << 40)]
    values = [(v + 2**63) % 2**64 - 2**63 for v in values]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id int, sim_hash long")
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i != j and i % 3 == 0 and bin((a ^ b) % 2**64).count("1") < 5}
    assert {(r["a"], r["b"]) for r in dedup.hamming_search(frame.filter("doc_id % 3 = 0"), frame).collect()} == want


def brute_verdicts(texts, hashes):
    """By the rule as it is stated: distances of all earlier documents, and for each document the kept ones among them."""
    near, kept = {}, {}
    words = {i: set((t or "").split()) for i, t in texts.items()}
    for i in sorted(texts):
        near[i] = []
        for j in sorted(texts):
            if j < i and bin((hashes[i] ^ hashes[j]) % 2**64).count("1") < 5:
                both = len(words[i] | words[j])
                distance = 1 - len(words[i] & words[j]) / both if both else 0.0
                if distance < 0.02:
                    near[i].append((distance, j))
        own = [x for x in near[i] if kept[x[1]] is None]
        kept[i] = min(own)[1] if own else None
    return near, kept


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_equal_brute_force(spark, seed):
    """Chains of texts each of which is near the next only, copies of them, hashes that differ, small and empty texts."""
    rng = np.random.default_rng(seed)
    texts, hashes = {}, {}
    ids = iter(rng.permutation(400).tolist())
    for size in (40, 120, 333):
        words = [f"w{size}x{k}" for k in range(size)]
        for step in range(12):
            words[int(rng.integers(size))] = f"n{size}x{step}"
            for _ in range(int(rng.integers(1, 4))):
                i = next(ids)
                texts[i], hashes[i] = " ".join(words), int(rng.choice([0, 1, 0b11, 0b11111000]))
    for t in ("", " ", None, "a b", "b a"):
        i = next(ids)
        texts[i], hashes[i] = t, 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, members = dedup.classes(docs, spark.createDataFrame(list(hashes.items()), "doc_id long, sim_hash long"))
    pairs = snapshot(dedup.jaccard_pairs(sets))
    near, kept = brute_verdicts(texts, hashes)
    reps = {r["rep"] for r in members.collect()}
    want = {(j, i): d for i, x in near.items() for d, j in x if i in reps and j in reps}
    got = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in got) and len(got) > 10
    best = {r["doc_id"]: r["match"] for r in dedup.best_match(pairs, members).collect()}
    assert best == {i: min(x)[1] for i, x in near.items() if x}
    found = {r["doc_id"]: (r["kept"], r["content_of"]) for r in dedup.verdicts(members, pairs).collect()}
    assert found == {i: (k is None, i if k is None else k) for i, k in kept.items()}


def test_a_long_chain_is_decided(spark):
    members = spark.createDataFrame([(k, k) for k in range(24)], "doc_id long, rep long")
    pairs = spark.createDataFrame([(k, k + 1, 0.01) for k in range(23)], "a long, b long, jaccard double")
    assert [r["kept"] for r in dedup.verdicts(members, pairs).orderBy("doc_id").collect()] == [True, False] * 12
    assert dedup.verdicts(members, pairs.limit(0)).filter("kept").count() == 24


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [1.0, 2.0]), (503, x[7].tolist())]
    held = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(20)] + [(99, None)], "query_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for most in (1 << 20, 300):
        monkeypatch.setattr(search, "MOST_BYTES", most)
        got = {}
        for r in search.nearest(asked, held, 4).collect():
            got.setdefault(r["query_id"], []).append((-round(r["cosine"], 9), r["doc_id"]))
        every = {k: sorted([(-round(float(u[k] @ u[j]), 9), j) for j in range(300)] + [(-round(float(u[k] @ u[7]), 9), 503)])[:4] for k in range(20)}
        assert {k: sorted(v) for k, v in got.items()} == every
    assert search.nearest(asked.limit(0), held, 4).count() == 0 and search.nearest(asked, held.limit(0), 4).count() == 0


def test_no_queries_terms_or_candidates(spark):
    docs = spark.createDataFrame([(1, 3, ["a", "b"])], "doc_id long, status int, tokens array<string>")
    queries = spark.createDataFrame([(1, "a")], "query_id long, term string")
    for asked, held in ((queries.limit(0), docs), (queries, docs.limit(0)), (queries.withColumn("term", F.lit("zz")), docs)):
        posted, lengths = index.postings(held), index.lengths(held)
        assert index.ranked_bm25(asked, posted, lengths, 5).count() == 0 and index.term_map(index.matches(asked, posted, lengths)).count() == 0
    assert index.ranked_bm25(queries, index.stored_postings(docs), index.lengths(docs), 5).count() == 1
    shown = docs.select("doc_id", F.lit("c").alias("content_id"), *(F.lit(None).cast("string").alias(c) for c in ("url", "title", "description", "length", "depth", "rank")))
    content = spark.createDataFrame([("c", 0.5)], "content_id string, ai_score double")
    assert indexing.results(shown, content, docs.select("doc_id").limit(0)).count() == 0
    assert indexing.results(shown, content, docs.select("doc_id")).first()["ai_score"] == 0.5
    none = indexing.index_documents(docs.select("doc_id", F.lit("a b").alias("text"), "tokens").limit(0), queries.select(F.col("term").alias("word")))
    assert none.documents.count() == none.content.count() == none.postings.count() == 0


def test_urls(spark):
    clean = lambda u: one(spark, urls.clean(F.lit(u)))
    assert clean("HTTPS://a.b/x//?q#f") == "https://a.b/x"
    assert clean("mailto:x@y") is None and clean(clean("http://a.b/c/")) == "http://a.b/c"
    frame = spark.createDataFrame([("http://a.b/c/d", "../e"), ("http://a.b/c/d", "//x.y/z"), ("http://a.b/c", None)], "base string, href string")
    assert [r[0] for r in frame.select(urls.resolve_any("base", "href")).collect()] == ["http://a.b/e", "http://x.y/z", None]
    bases = ["http://a.b/c/d?q=1#f", "http://a.b/c/d/", "http://a.b", "https://u@a.b:8/x/y/z"]
    hrefs = ["../e", "x.html", "./x", "../../../e", "..", ".", "/a/./b/../c", "?p=2", "#top", "", "//x.y/z", "mailto:x", "e/../../f?x=/../y", "/", "g/", "a/..", "https://o.p/q"]
    both = spark.createDataFrame([(a, b) for a in bases for b in hrefs], "base string, href string")
    found = both.select("base", "href", urls.resolve(F.col("base"), F.col("href")).alias("x"), urls.resolve_any("base", "href").alias("y")).collect()
    differ = [tuple(r) for r in found if r["x"] != r["y"]]
    assert not differ


def test_parser():
    page = '<html><head><title>T &amp; x</title><meta name="description" content="D"></head><body><nav>menu <a href="/n">n</a></nav><p>a<b>b</p><img alt="two words"><img alt="x-y"><a href="/f" hreflang="fr">f</a><aside><div>no</aside>end'
    assert html.parse_page(page) == ("T & x", "D", "a b two words f end", ["/n"])
    assert html.parse_page(None) == (None, None, "", [])


def test_text_functions(spark):
    assert one(spark, text.umlaut_fold(F.lit("Äöß"))) == "Aeoess"
    assert one(spark, text.preprocess(F.lit("The cats, THE Tübingen!"), lemmas=F.create_map(F.lit("cats"), F.lit("cat")))) == ["cat", "tuebingen"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    web_text = "See https://a.b/c?d=1 @you #Tag don't :-) x@y.z well-known <3"
    assert one(spark, text.tokens(F.lit(web_text), text.WEB_TOKEN)) == ["see", "https://a.b/c?d=1", "@you", "#tag", "don't", ":-)", "x@y.z", "well-known", "<3"]
    docs = spark.createDataFrame([(1, ["cats", "x", "cats"]), (2, [])], "doc_id int, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    assert {r["doc_id"]: r["tokens"] for r in text.lemmatise(docs, lemmas).collect()} == {1: ["cat", "x", "cat"], 2: []}
    assert one(spark, text.embed_input(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"


STEMS = """consign consigned:consign consigning:consign consistency:consist consistently:consist consolatory:consolatori
consolidated:consolid consolingly:consol consols:consol constable:constabl constancy:constanc knackeries:knackeri kneaded:knead knees:knee
knightly:knight knitting:knit knives:knive generous:generous generate:generat happy:happi running:run hoping:hope hopping:hop cry:cri by say
dying:die ties:tie cries:cri gas this gaps:gap kiwis:kiwi relational:relat inning agreed:agre controlling:control youth it's:it"""


def test_stems(spark):
    pairs = [(x.split(":") * 2)[:2] for x in STEMS.split()]
    assert one(spark, stem.stems(F.array(*(F.lit(a) for a, _ in pairs)))) == [b for _, b in pairs]
    assert one(spark, stem.stems(F.lit(None).cast("array<string>"))) is None


def test_query_lines(spark):
    lines = spark.createDataFrame([("1\tfoo bar",), ("x foo",), ("2",), ("",)], "value string")
    assert [tuple(r) for r in batch.parse_queries(lines).collect()] == [(1, "foo bar")]
    assert sorted(r[0] for r in batch.bad_lines(lines).collect()) == ["2", "x foo"]


def test_results_are_not_overwritten(spark, tmp_path):
    found = spark.createDataFrame([(1, 1, "u", 0.12345)], "query_id int, rank int, url string, score double")
    batch.write_results(found, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1\t1\tu\t0.123"
    with pytest.raises(Exception, match="exist"):
        batch.write_results(found, str(tmp_path / "out"))
    batch.write_results(found, str(tmp_path / "out"), overwrite=True)


def test_frontier_and_store(spark):
    docs = spark.createDataFrame([("u", 1, 3)], "url string, depth int, status int")
    offers = spark.createDataFrame([("u", 0, 0), ("v", 2, 1), ("v", 1, 2)], "url string, depth int, nth int")
    assert sorted(map(tuple, frontier.offer(docs, offers).collect())) == [("u", 1, 3), ("v", 2, 0)]
    base = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "k int, x string, y string")
    delta = spark.createDataFrame([(1, None, "z")], "k int, x string, y string")
    assert sorted(map(tuple, store.update(base, delta, "k").collect())) == [(1, "a", "z"), (2, "b", "c")]
    codes = spark.createDataFrame([(200,), (404,), (0,), (500,), (None,)], "c int")
    assert [r[0] for r in codes.select(frontier.after_download(F.col("c"))).collect()] == [2, 254, 254, 1, 255]


def test_crawl_of_stored_pages(spark):
    pages = spark.createDataFrame(
        [("http://a.b/", '<a href="/x">x</a><p>thing'), ("http://a.b/x", '<a href="/y">y</a><a href="http://c.d/">c</a>'), ("http://a.b/y", "<p>thing")], "url string, html string"
    )
    seeds = web.seeds(spark, ["http://a.b"])
    gate = lambda p: F.array_contains("tokens", "thing")
    docs, links = crawl.crawl(seeds, lambda f: web.stored(f, pages), depth=2, relevant=gate)
    got = {r["url"]: (r["depth"], r["status"]) for r in docs.collect()}
    assert got == {"http://a.b": (0, 3), "http://a.b/x": (1, 254), "http://a.b/y": (2, 3), "http://c.d": (2, 254)}
    assert links.count() == 3
    rules = {"a.b": "User-agent: *\nDisallow: /y", "c.d": None}
    asked = []

    def robots(sites):
        asked.extend(r["host"] for r in sites.collect())
        return sites.select("host", F.when(F.col("host") == "a.b", rules["a.b"]).alias("rules"))

    docs, _ = crawl.crawl(seeds, lambda f: web.stored(f, pages), depth=2, relevant=gate, robots=robots)
    assert {r["url"] for r in docs.collect()} == {"http://a.b", "http://a.b/x", "http://c.d"} and sorted(asked) == ["a.b", "c.d"]


class _Site(http.server.BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):
        if self.path == "/busy" and not _Site.tries:
            _Site.tries += 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        kind = "text/plain" if self.path == "/robots.txt" else "Text/HTML; charset=utf-8"
        body = {"/robots.txt": b"User-agent: *\nDisallow: /no", "/large": b"x" * (3 << 20)}.get(self.path, b"<p>ok")
        if self.path == "/gone":
            self.send_response(404)
            self.end_headers()
            return
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_fetching_from_a_server(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    get = web.http_fetch(5)
    assert get(f"{site}/busy") == (200, "<p>ok") and _Site.tries == 1
    assert get(f"{site}/gone") == (404, None) and get(f"{site}/robots.txt") == (0, None) and get(f"{site}/large") == (None, None)
    sites = spark.createDataFrame([(urls_host, f"http://{urls_host}") for urls_host in (site[7:], "127.0.0.1:1")], "host string, site string")
    assert {r["host"]: r["rules"] for r in web.robots_rules(sites).collect()} == {site[7:]: "User-agent: *\nDisallow: /no", "127.0.0.1:1": None}
    asked = spark.createDataFrame([("k", f"{site}/x", 0)], "doc_id string, url string, depth int")
    assert [tuple(r) for r in web.download(asked, lambda: web.http_fetch(5)).collect()] == [("k", f"{site}/x", 0, 200, "<p>ok")]
    server.shutdown()


def test_training_triplets(spark):
    rows = spark.createDataFrame([("q", "p", "n", 1)], "query string, positive string, negative string, more int")
    assert web.triplets(rows).first().asDict() == {"anchor": "q", "positive": "p", "negative": "n"}


def test_stream_of_pages(spark, data, tmp_path):
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(f"{data}/page[s].parquet")
    gate = lambda p: F.lit(True)
    crawl.index_stream(pages, str(tmp_path / "out"), str(tmp_path / "state"), relevant=gate).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_robots_and_models(spark):
    links = spark.createDataFrame([("http://a.b/no/x",), ("http://a.b/yes",), ("http://c.d/no",)], "url string")
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /no/")], "host string, rules string")
    assert sorted(r[0] for r in web.allowed(links, robots).collect()) == ["http://a.b/yes", "http://c.d/no"]
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    held = spark.createDataFrame([(1, [1.0])], "doc_id int, embedding array<float>")
    filled = search.fill_embeddings(docs, held, F.col("text"), lambda t: encode(hashing_encoder(4), t))
    assert {r["doc_id"]: len(r["embedding"]) for r in filled.collect()} == {1: 1, 2: 4}


def test_mean_pool_below_zero(spark, duck, tmp_path):
    """A mean that rounds to zero from below is -0.000000 in the SQL."""
    rows = [(1, 7, [-3e-7] * 64), (2, 7, [-3e-7] * 64), (3, 8, [3e-7] * 63 + [-0.25])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["label"]: r["pooled"] for r in registry.mean_pool(spark, str(tmp_path)).collect()}
    sql = registry.ORACLE_SQL["mean_pool"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == dict(duck.sql(sql).fetchall()) and got[7].startswith("-0.000000 ")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def random_index(spark):
    rng = np.random.default_rng(3)
    docs = [(i, 3 if i % 4 else 2, [f"t{int(t)}" for t in rng.zipf(1.3, rng.integers(0, 40)) % 50]) for i in range(400)]
    asked = [(q, f"t{t}") for q in range(9) for t in {int(x) for x in rng.integers(0, 60, 6)}]
    return spark.createDataFrame(docs, "doc_id long, status int, tokens array<string>").repartition(5), spark.createDataFrame(asked, "query_id long, term string")


def test_ranking_by_document_shuffles_only_each_tasks_best(spark, monkeypatch):
    docs, asked = random_index(spark)
    held = index.stored_by_document(docs)
    posted, lengths = index.postings(docs), index.lengths(docs)
    want = rows(index.ranked_bm25(asked, posted, lengths, 5, 9))
    for terms, queries in ((index.MOST_TERMS, index.MOST_QUERIES), (20, 4)):
        monkeypatch.setattr(index, "MOST_TERMS", terms)
        monkeypatch.setattr(index, "MOST_QUERIES", queries)
        found = index.best_bm25(asked, held, 5, 9)
        assert rows(found) == want
    plan = plan_of(index.best_bm25(asked, held, 5, 9))
    assert "Generate explode" not in plan and plan.rindex("Exchange") < plan.index("MapInArrow")
    assert rows(index.postings_of(held)) == rows(posted)
    assert not index.has_repeats(held) and index.has_repeats(held.unionByName(held))


def test_prefilter_by_document(spark):
    docs, asked = random_index(spark)
    found = index.best_cheap(asked, index.stored_by_document(docs), 7)
    assert rows(found) == rows(index.prefilter(index.matches(asked, index.postings(docs), index.lengths(docs)), 7))


def test_tasks_keep_their_best_in_bounded_slices(spark, monkeypatch):
    """As in a task, with slices of a few documents: the same best as in one slice."""
    docs, asked = random_index(spark)
    shared = []
    monkeypatch.setattr(index, "_rank_task", lambda s, *a: shared.append(s) or (lambda x: x))
    with contextlib.suppress(Exception):
        index._candidates(asked, index.by_document(docs), 5)
    monkeypatch.undo()
    held = index.by_document(docs).filter("status = 3").select("doc_id", "length", "terms", "tfs").toArrow().combine_chunks().to_batches()
    whole = [b.to_pylist() for b in index._rank_task(shared[0], 5, 1.5, 0.75)(iter(held))]
    monkeypatch.setattr(index, "MOST_HELD", 30)
    assert [b.to_pylist() for b in index._rank_task(shared[0], 5, 1.5, 0.75)(iter(held))] == whole and len(whole[0]) == 45


def test_term_lists_are_made_without_a_shuffle(spark, data):
    plan = plan_of(registry.doc_term_map(spark, data))
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_repeated_ids_are_summed_up(spark, data, duck, tmp_path):
    """Documents whose ids come twice are one in the SQL's postings."""
    twice = spark.read.parquet(f"{data}/documents.parquet")
    twice.unionByName(twice.filter("doc_id % 7 = 0")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sql = registry.ORACLE_SQL["tfidf_prefilter"].replace("FROM documents)", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet'))")
    assert rows(registry.tfidf_prefilter(spark, str(tmp_path))) == sorted((str(r[1]), str(r[0]), str(r[3]), str(r[2])) for r in duck.sql(sql).fetchall())


def test_words_share_shuffles_counts_only(spark):
    texts = ["ÄB über x1y 12 a1 1a ß", "", None, "the The THE b2 ñandú", "a\u0308b the-über's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = text.words_share(docs, spark.createDataFrame([("the",), ("ueber",), ("ss",)], "word string"))
    got = {r["doc_id"]: (r["n_words"], round(r["share"], 6)) for r in found.collect()}
    assert got == {0: (3, round(2 / 3, 6)), 1: (0, 0), 2: (0, 0), 3: (4, 0.75), 4: (5, 0.4)}
    assert "hashpartitioning(doc_id" in (plan := plan_of(found)) and "word#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x)


def test_texts_are_not_shuffled_for_relevance(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", text.tokens(F.col("text")).alias("tokens"))
    words = spark.read.parquet(f"{data}/benchmark.parquet").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    found = indexing.relevant(docs, words, dataclasses.replace(DEFAULTS, any_topic=("thing",), all_topics=("the", "and", "of")))
    assert found.count() and "BroadcastHashJoin" in (plan := plan_of(found)) and "hashpartitioning" not in plan


def test_pagerank_rounds_join_lists(spark, monkeypatch):
    """A source's targets come in lists; a source with many has several, and ranks stay the same."""
    edges = [(0, k) for k in range(1, 40)] + [(k, (k * 7) % 40) for k in range(1, 40)]
    links = spark.createDataFrame(edges, "src long, dst long").distinct()
    nodes = spark.createDataFrame([(k,) for k in range(40)], "node long")
    want = {r["node"]: round(r["rank"], 12) for r in graph.pagerank(links, nodes).collect()}
    monkeypatch.setattr(graph, "LIST", 5)
    lists = graph.link_lists(links)
    assert lists.filter("src = 0").count() > 1 and lists.agg(F.sum(F.size("dsts"))).first()[0] == links.count()
    assert {r["node"]: round(r["rank"], 12) for r in graph.pagerank(links, nodes).collect()} == want
    rank, out = {k: 1 / 40 for k in range(40)}, {s: sum(a == s for a, _ in set(edges)) for s, _ in edges}
    for _ in range(10):
        given = dict.fromkeys(rank, 0.0)
        for s, d in set(edges):
            given[d] += rank[s] / out[s]
        rank = {k: 0.15 / 40 + 0.85 * given[k] for k in rank}
    assert all(math.isclose(want[k], rank[k], abs_tol=1e-11) for k in rank)
