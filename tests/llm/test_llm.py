"""The training-data operators against brute force, exact round trips and odd input."""

import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from findery import llm
from findery.llm import ann, chat, langid, mixing, nearjoin, packing, quality, records, toxicity, warc
from findery.llm.common import Scratch
from findery.llm.tokens import Encoder, default_tokenizer, read_spec

DOC = "doc_id long, text string, lang string, source string, n_chars long, doc_id_ string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "a"), (3, long, "a"), (4, long, "a"), (4, long, "a"), (None, "no id here at all", "b"), (5, " \n ", None), (6, "日本 语 x" * 9, "b")]
    return docs_of(spark, rows)


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found, asked = llm.QUERIES[name](spark, data), con.sql(llm.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(asked.columns)
    order = [list(asked.columns).index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in found.collect()) == sorted(str([r[k] for k in order]) for r in asked.fetchall())


def test_encoder_equals_library():
    spec = read_spec(default_tokenizer())
    t = Tokenizer.from_str(spec)
    rng = np.random.default_rng(3)
    letters = list("ab Z1 é.,!'\n\t  s%|日本 #\xa0\x01")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["a  b", "a   b", " a", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>", "don't"]
    small = Encoder(spec, max_words=50)
    for e in (Encoder(spec), small):
        got = [x for i in range(0, len(texts), 500) for x in e.encode(texts[i : i + 500])]
        assert all(x.tolist() == y.ids for x, y in zip(got, t.encode_batch(texts, add_special_tokens=False)))
    assert small.encode([None, ""])[0].size == 0


def test_records_round_trip_and_damage(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/r"
    shards = records.write_token_records(odd, folder, default_tokenizer(), 2)
    got = records.read_token_records(spark, folder, shards).orderBy("start").toPandas()
    assert len(got) == odd.count() and (got["start"].values == np.cumsum(got["n_tokens"]) - got["n_tokens"]).all()
    assert got["doc_id"].dropna().is_monotonic_increasing
    end = zlib.crc32(np.array([2], dtype="<u4").tobytes())
    assert got[got["doc_id"] == 1].iloc[0]["ids_crc32"] == end
    first = shards[0]
    index = records.read_index(folder, first["number"])
    seek = list(records.read_records(folder, first["number"], first["width"], index[::-1]))
    assert [d for d, _ in seek] == index["doc_id"][::-1].tolist()
    path = tmp_path / "r" / f"{first['number']:06d}.rec"
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_records(folder, first["number"], first["width"]))


def test_packing(spark, odd):
    got = packing.pack(odd, default_tokenizer(), capacity=64).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].values == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 64
    one = got[got["doc_id"] == 3].sort_values("piece")
    assert (one["length"].values[1:] == 64).all() and (one["start"].values == np.cumsum(one["length"]) - one["length"]).all()
    assert packing.pack(odd.limit(0), default_tokenizer()).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    for groups, least in ((8, 51), (12, 34), (20, 13)):
        made, used = packing.plan(counts, 100, groups, least), np.zeros(101, dtype=int)
        for n, held in made:
            assert sum(a * b for a, b in held.items()) <= 100
            for a, b in held.items():
                used[a] += n * b
        assert (used == counts).all()
    assert sum(n for n, _ in packing.best_plan(counts, 100)) <= 1.02 * -(-counts @ np.arange(101) // 100)


def brute_near(rows):
    sets = {i: set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := re.findall(r"[^\W_]+", (t or "").lower())) else set() for i, t in rows}
    links, root = defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("tile", [512, 7])
def test_near_join_equals_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    base = [" ".join(f"t{k}x{j}" for j in range(80)) for k in range(3)]
    rows = []
    for i in range(60):
        words = base[i % 3].split()
        for k in rng.integers(0, 80, rng.integers(0, 3)):
            words[k] = f"n{rng.integers(5)}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A, b!"), (104, rows[0][1])]
    found = nearjoin.near_classes(docs_of(spark, [(i, t, "s") for i, t in rows]), tile=tile)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found.collect()}
    assert got == brute_near(rows)


def test_near_duplicates_go_by_row(spark, data):
    import corpus_pipeline as pipeline

    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(7, a, "s"), (7, b, "s"), (3, b + " more", "s"), (None, c, "s"), (None, d, "s"), (9, d, "t"), (5, e, "s"), (5, e, "t"), (None, "", "s"), (None, None, "s"), (8, "", "s"), (8, "", "s")]
    got = pipeline.near_duplicates(spark, docs_of(spark, rows), data)
    want = [(7, a), (3, b + " more"), (None, c), (9, d), (5, e), (None, ""), (None, None), (8, ""), (8, "")]
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, want))


def test_near_duplicates_move_few_texts(spark, data, monkeypatch):
    """Joins that shuffle shuffle the texts of documents in shared buckets only; what stays is as before, also where a sieve lets all through."""
    import corpus_pipeline as pipeline
    from findery.llm import common

    rng = np.random.default_rng(4)
    words = rng.integers(1 << 40, 1 << 60, (300, 400))
    rows = [(i, " ".join(f"{x:x}" for x in w), "s") for i, w in enumerate(words.tolist())]
    rows += [(1000 + i, rows[i][1], "t") for i in range(10)] + [(2000 + i, rows[i][1] + " more", "t") for i in range(10)]
    want = [i for i, *_ in rows if i < 1000]
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))

    name, out = "spark.sql.autoBroadcastJoinThreshold", Scratch(spark)
    old = spark.conf.get(name)
    docs = out.keep(docs_of(spark, rows), "docs")
    spark.conf.set(name, "-1")  # as with large tables
    try:
        before = moved()
        got = out.keep(pipeline.near_duplicates(spark, docs, data), "got")
        assert moved() - before < 0.5 * sum(len(t) for _, t, _ in rows)
        monkeypatch.setattr(common, "SIEVE_BITS", 8)
        again = out.keep(pipeline.near_duplicates(spark, docs, data), "again")
    finally:
        spark.conf.set(name, old)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in again.collect()) == want


def test_sieve(spark):
    from findery.llm.common import sieve

    df = spark.range(20_000).selectExpr("if(id = 5, null, id) AS k", "id AS word", "id AS bits")
    keys = spark.range(0, 20_000, 100).selectExpr("id AS k")
    got = sieve(df, keys, "k", "in")
    assert got.columns == [*df.columns, "in"] and got.count() == 20_000
    assert got.filter("k % 100 = 0 AND NOT in").count() == 0 and got.filter("in").count() < 250
    assert sieve(df, keys.limit(0), "k", "in").filter("in").count() == 0
    assert sieve(df, keys.unionByName(keys.selectExpr("CAST(NULL AS long) AS k")), "k", "in").filter("k IS NULL").first()["in"]


def test_bands_reach_the_recall():
    bands, rows = nearjoin.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:700] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0] * 3), (None, x[3].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for i in range(0, 1500, 50):
        s = np.round(u @ u[i], 12)
        s[i] = -9
        want = np.lexsort((np.arange(1500), -s))[:5]
        mine = got[got["query_id"] == i].sort_values("rank")
        assert len(mine) == 5
        hit += len(set(want) & set(mine["vec_id"]))
    assert hit >= 0.9 * 150 and got["query_id"].max() < 1500
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def brute_mixture(blocks, weights):
    """(source, block) in order of an earliest-deadline-first schedule without end, without the blocks that are not there."""
    total, names, t, out = sum(weights.values()), sorted(weights, key=lambda s: (s is None, s or "")), 0, []
    begun = dict.fromkeys(names, 0)
    while len(out) < sum(blocks.values()):
        free = [s for s in names if begun[s] * total // weights[s] <= t]
        s = min(free, key=lambda s: (-(-(begun[s] + 1) * total // weights[s]), names.index(s)))
        if begun[s] < blocks[s]:
            out.append((s, begun[s]))
        begun[s] += 1
        t += 1
        done = begun.values()
        assert all(-1 < weights[x] * t / total - n < 1 for x, n in zip(names, done))
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, None: 2, "c": 1}, {"a": 1, "b": 1, None: 1, "c": 1}, {"a": 1, "b": 600, None: 7, "c": 33}])
def test_mixing_equals_a_simulation(spark, weights):
    sizes = {"a": 50, "b": 31, None: 12, "c": 1}
    rows = [(None if k % 9 == 0 else k % 40, f"{s} {k % 30}", s) for s, n in sizes.items() for k in range(n)]
    got = mixing.mix(docs_of(spark, rows), weights, block_docs=3).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows))) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    found = list(dict.fromkeys((r["source"], r["block"]) for r in got))
    assert found == brute_mixture({s: -(-n // 3) for s, n in sizes.items()}, weights)
    assert sorted(str((r["doc_id"], r["source"])) for r in got) == sorted(str((i, s)) for i, _, s in rows)


def test_mixing_rows(spark, odd):
    got = mixing.mix(odd, block_docs=2).toPandas()
    assert sorted(got["position"]) == list(range(odd.count()))
    assert mixing.mix(odd.limit(0)).count() == 0
    late = mixing.mix(odd, {"a": 1}, block_docs=1).orderBy("position").collect()
    assert [r["source"] == "a" for r in late] == [True] * 4 + [False] * (odd.count() - 4) and [r["late"] for r in late] == [r["source"] != "a" for r in late]


def test_mixing_more_sources_than_groups(spark):
    rows = [(i, "x", f"s{min(i % 97, i % 60)}") for i in range(3000)] + [(i, "y", None) for i in range(300)]
    got = mixing.mix(docs_of(spark, rows), block_docs=1, groups=8).orderBy("position").toPandas()
    assert got["position"].tolist() == list(range(3300)) and sorted(got["doc_id"]) == sorted(r[0] for r in rows)
    share = (got["source"].isna().cumsum() / (got["position"] + 1)).iloc[200:2000]
    assert share.max() / share.min() < 1.15  # as long as most have documents left, it is even


def test_whole_number_weights():
    assert mixing.whole([10, 20, 30]) == [1, 2, 3] and mixing.whole([0.5]) == [1]
    rounded = mixing.whole([10**9, 1, 10**9 - 1])
    assert sum(rounded) in range(16_383, 16_388) and rounded[1] == 1


def test_mixture_keeps_every_row_in_schedule_order(spark):
    rows = [(i, f"t{i}", "hot") for i in range(200)] + [(1000 + i, f"s{i}", "small") for i in range(3)]
    rows += [(None, "no id", "hot"), (None, "no id either", "small"), (7, "other text", "hot"), (7, "other text", "hot")]
    docs = docs_of(spark, rows)
    got = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixture(docs, block_docs=1).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(rows, key=key)
    place = mixing.mix(docs, block_docs=1).orderBy("position").collect()
    assert [r[2] for r in got] == [r["source"] for r in place] and [r[0] for r in got] == [r["doc_id"] for r in place]
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "u", "a"), (1, 1, "b", "c"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "c"), (4, 0, None, None), (None, 0, "u", "z"), (5, 0, "u", "<|im_end|>")]
    got = {r["conv_id"]: (r["n_copies"], r["text"]) for r in chat.chat_documents(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 4, 5} and got[1][0] == 2 and got[1][1].startswith("<|im_start|>u\na<|im_end|>") and got[5][1].count("<|im_end|>") == 1


def test_warc_faults_are_found(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    whole = warc.serialise(pages)
    assert warc.audit(whole, whole).count() == 0
    assert warc.audit(whole, whole.filter("page_id <> 7")).select("page_id", "verdict").collect() == [(7, "missing")]
    assert warc.audit(whole.filter("page_id <> 7"), whole).first()["verdict"] == "extra"
    assert warc.audit(whole.limit(0), whole.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    bodies = [b"a" * 10, b"", b"x\r\n\r\nWARC/1.0 in a body", b"z" * 5000]
    recs = [b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies]
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "p.warc").write_bytes(b"".join(recs))
        (tmp_path / side / "z.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
        (tmp_path / side / "none.warc").write_bytes(b"")
    whole = warc.read_warc(spark, f"file://{tmp_path}/a")
    starts = np.cumsum([0, *map(len, recs)])
    plain = whole.filter("archive = 'p.warc'").orderBy("offset").collect()
    assert [(r["offset"], r["length"], r["digest"]) for r in plain] == [(s, len(x), hashlib.sha256(x).hexdigest()) for s, x in zip(starts, recs)]
    assert whole.filter("archive = 'z.warc.gz'").count() == 4 and whole.count() == 8
    bad = bytearray(b"".join(recs))
    bad[starts[3] + 100] ^= 1
    (tmp_path / "b" / "p.warc").write_bytes(bad)
    found = warc.audit(whole, warc.read_warc(spark, f"file://{tmp_path}/b")).collect()
    assert [(r["archive"], r["offset"], r["verdict"]) for r in found] == [("p.warc", starts[3], "corrupt")]
    # in pieces of any size the same records are found; damaged heads and lengths cost no other record but those that they hide
    data = b"".join(recs)
    for n in (1, 7, 64, 1 << 20):
        parts = lambda d: iter([d[i : i + n] for i in range(0, len(d), n)])  # noqa: B023, E731
        assert [x[:2] for x in warc.record_bounds(parts(data))] == [(s, len(x)) for s, x in zip(starts, recs)]
        assert [x[:2] for x in warc.record_bounds(parts(b"X" + data[1:]))] == [(s, len(x)) for s, x in zip(starts, recs)]
        assert sum(x[1] for x in warc.record_bounds(parts(data[:-3000]))) == len(data) - 3000
        for wrong in (b"04", b"09", b"12", b"xx"):
            odd_one = data.replace(b"Content-Length: 10", b"Content-Length: " + wrong, 1)
            assert [x[0] for x in warc.record_bounds(parts(odd_one))] == [starts[k] for k in range(4) if k != 1 or wrong != b"12"]
        zipped = b"".join(map(gzip.compress, recs))
        assert len(list(warc.member_bounds(parts(zipped)))) == 4
        hurt = zipped[:5] + b"\xff" * 20 + zipped[25:]
        sizes = [len(gzip.compress(x)) for x in recs]
        assert [x[:2] for x in warc.member_bounds(parts(hurt))] == list(zip(np.cumsum([0, *sizes]).tolist(), sizes))
        assert sum(x[1] for x in warc.member_bounds(parts(hurt[: sizes[0]] + b"junk" * 900))) == sizes[0] + 3600


def test_quality_of_odd_rows(spark, odd):
    got = quality.judge(odd).toPandas()
    assert len(got) == odd.count() and not got[got["n_words"] == 0]["kept"].any()
    again = quality.judge(docs_of(spark, [(1, "a b c d e " * 3, "s"), (2, "a b c d e f g h i j k", "s")])).toPandas().set_index("doc_id")
    assert again["n_repeat_words"].to_dict() == {1: 15, 2: 0} and quality.judge(odd.limit(0)).count() == 0


def test_language(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = llm.QUERIES["op5_language_id"](spark, data).join(docs, "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.9 and got["score"].between(0, 1).all()
    model = langid.fit(docs)
    assert langid.predict(model, None) == langid.predict(model, "12 !") == ("und", 0.0)
    empty = langid.fit(docs.limit(0))
    assert langid.predict(empty, "text") == ("und", 0.0)


def test_language_stage_rejects_what_was_not_learned(spark, data):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = np.random.default_rng(5)
    letters = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(50))
    other = ["Привет, как дела? Сегодня хорошая погода, и мы идём гулять в парк.", "这是一个关于数据处理的句子", "これは言語識別をテストするための文です", "هذه جملة باللغة العربية", letters]
    more = spark.createDataFrame([(-1 - k, x, None, "odd", len(x)) for k, x in enumerate(other)], docs.schema)
    both = pipeline.language(spark, docs.unionByName(more), data)
    assert both.filter("source = 'odd'").count() == 0 and both.count() == docs.count()
    assert pipeline.language(spark, docs.limit(0), data).count() == 0
    model = langid.fit(docs)
    k, text = model.langs.index("en"), docs.filter("lang = 'en'").first()["text"]
    found = np.concatenate(langid.grams([text], model.bits)[0])
    found = found[found < 1 << model.bits]
    counts = np.exp(model.table[:-1, k].astype(float)) * model.total[k] - np.bincount(found, minlength=1 << model.bits)
    assert langid.without(model, "en", text) == pytest.approx(np.log(counts / counts.sum())[found].mean(), rel=1e-3)
    assert pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), data).count() == docs.count()


def test_language_scores_equal_brute_force(spark, data):
    """Every text's log-probabilities, n-gram by n-gram in plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    train = langid.train_rows(docs)
    model = langid.fit(train)
    mult, char, mask = int(langid.cp.MULT), int(langid.cp.CHAR), (1 << 64) - 1

    def buckets(text):
        x = re.sub(r"[\W\d_]+", " ", " " + text.lower())
        for n in (1, 2, 3):
            for i in range(len(x) - n + 1):
                h = 0
                for c in x[i : i + n]:
                    h = (h * char + ord(c)) & mask
                yield ((h + n) * mult & mask) >> (64 - model.bits)

    counts = {k: defaultdict(int) for k in model.langs}
    rows = {k: 0 for k in model.langs}
    for r in train.filter("text is not null and lang is not null").collect():
        if re.search(r"[^\W\d_]", r["text"]):
            rows[r["lang"]] += 1
            for b in buckets(r["text"]):
                counts[r["lang"]][b] += 1
    every = defaultdict(int)
    for c in counts.values():
        for b, n in c.items():
            every[b] += n
    total, weight = sum(every.values()), 0.1 * (1 << model.bits)

    def log_of(lang, b):
        return np.log((counts[lang][b] + weight * (every[b] + 1) / (total + (1 << model.bits))) / (sum_of[lang] + weight))

    sum_of = {k: sum(c.values()) for k, c in counts.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in llm.QUERIES["op5_language_id"](spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and len(r["text"]) < 1500}
    assert len(texts) > 20
    for i, text in texts.items():
        if not re.search(r"[^\W\d_]", text):
            assert got[i] == ("und", 0.0)
            continue
        y = [np.log(rows[k] / sum(rows.values())) + sum(log_of(k, b) for b in buckets(text)) for k in model.langs]
        k = int(np.argmax(y))
        assert got[i][0] == model.langs[k] and got[i][1] == pytest.approx(1 / np.exp(np.array(y) - y[k]).sum(), rel=1e-3)


def test_language_of_odd_rows(spark, odd, data):
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"))
    got = odd.select("doc_id", "text", langid.identify(spark, model, F.col("text")).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (3, 4)}) == 1
    many = spark.createDataFrame([(i, f"text {i % 700}", f"l{i % 700:03d}") for i in range(2100)] + [(-1, "more", "zz")] * 5, "doc_id long, text string, lang string")
    few = langid.fit(many, bits=8, most_languages=600)
    assert len(few.langs) == 600 and "zz" in few.langs and few.langs[:599] == [f"l{i:03d}" for i in range(599)]
    assert len(langid.fit(many, bits=8, most_languages=1000).langs) == 701


def test_toxicity_cut():
    clean, hot = np.array([-3.0, -2, 1.5, -1]), np.array([2.0, 3])
    assert toxicity.cut(np.append(clean, hot), np.array([0, 0, 0, 0, 1, 1])) == pytest.approx(1.75)
    assert toxicity.cut(np.array([-2.0, 2]), np.array([0, 1])) == 0
    assert toxicity.cut(np.array([1.0, 1, 1]), np.array([0, 1, 1])) < 1


def test_toxicity_gradients_and_learning():
    rng = np.random.default_rng(4)
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    net["E"][:-1] = rng.normal(size=net["E"][:-1].shape)
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.ODDS))
    rows = rng.integers(0, 40, size=(3, toxicity.WINDOW, 5))
    rows[..., 4] = len(net["E"]) - 1
    there, y, w = np.arange(toxicity.WINDOW) < np.array([[16], [5], [1]]), np.array([1.0, 0, 1]), np.ones(3)
    x[~there] = 0
    used = np.array([True, False, True])
    loss, g = toxicity.learn(net, x, rows, y, there, w, used)
    assert not g["E"][-1].any()
    for name, at in (("Wf", (0, 0)), ("Wb", (9, 3)), ("Ub", (1, 2)), ("Vf", (2, 3)), ("v", (4,)), ("w", (1,)), ("bb", (20,)), ("E", (int(rows[0, 3, 1]), 2)), ("E", (int(rows[2, 0, 0]), 5)), ("E", (int(rows[0, 15, 2]), 0))):
        old, step = net[name][at], 1e-3
        net[name][at] = old + step
        up = toxicity.learn(net, x, rows, y, there, w, used)[0]
        net[name][at] = old - step
        down = toxicity.learn(net, x, rows, y, there, w, used)[0]
        net[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3
    clean = [" ".join(f"w{k}" for k in rng.integers(0, 400, 60)) for _ in range(400)]
    texts = [t + " idiot w1 scum" if i % 4 == 0 else t for i, t in enumerate(clean)]
    model = toxicity.train(texts[:300], np.array([int(i % 4 == 0) for i in range(300)]))
    p = toxicity.predict(model, texts[300:] + ["", None])
    label = np.array([i % 4 == 0 for i in range(300, 400)])
    assert (p[:100][label] >= 0.7).mean() > 0.9 and (p[:100][~label] >= 0.7).mean() < 0.1
    assert toxicity.predict(toxicity.train([], np.array([], dtype=int)), ["x"])[0] < 0.5


def test_pipeline_stages(spark, data):
    import corpus_pipeline as pipeline

    docs, out = spark.read.parquet(f"{data}/documents.parquet"), Scratch(spark)
    columns = docs.columns
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        last, kept = kept, out.keep(stage(spark, kept, data), "stage")
        assert kept.columns == columns and 0 < kept.count() <= last.count()
        if stage is pipeline.near_duplicates:
            want = brute_near([(r["doc_id"], r["text"]) for r in last.collect()])
            assert {r["doc_id"] for r in kept.collect()} == {root for root, _ in want.values()}
    packed = out.keep(pipeline.pack(spark, kept, data), "packed")
    assert packed.select("doc_id").distinct().count() == kept.count()


# ---------------------------------------------------------------- whole tables against the plain library


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(read_spec(default_tokenizer()))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op8_equals_the_library(spark, data, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in llm.QUERIES["op8_token_records"](spark, data).collect()}
    want, start = {}, 0
    for i, text in docs:
        ids = [*library(text), 2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want


def test_op10_equals_the_library(spark, data, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = llm.QUERIES["op10_best_fit_packing"](spark, data).toPandas()
    total = 0
    assert set(got["doc_id"]) == set(docs)
    for i, g in got.sort_values("piece").groupby("doc_id"):
        ids = [*library(docs[i]), 0]
        total += len(ids)
        assert g["piece"].tolist() == list(range(-(-len(ids) // 2048))) and (g["length"].values[1:] == 2048).all()
        at = 0
        for start, length, found in zip(g["start"], g["length"], g["ids_crc32"]):
            assert start == at and found == crc(ids[at : at + length])
            at += length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].values == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-total // 2048) + 2


def test_added_tokens_are_the_librarys(spark, library):
    docs = docs_of(spark, [(1, "a <|endoftext|> b", "s"), (2, "<|endoftext|>", "s"), (3, "a <| endoftext |> b", "s")])
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs, default_tokenizer()).collect()}
    want = {r["doc_id"]: [*library(r["text"]), 0] for r in docs.collect()}
    assert got == {i: (len(ids), crc(ids)) for i, ids in want.items()} and 50256 in want[1]


def test_op2_recall_on_embeddings(spark, data):
    held = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = np.array(sorted(held))
    x = np.stack([held[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got, hits, asked = llm.QUERIES["op2_adaptive_ann"](spark, data).toPandas(), 0, 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        others = np.flatnonzero(np.arange(len(ids)) != k)
        want = {int(ids[j]) for j in others[np.lexsort((ids[others], -s[others]))][:5]}
        mine = got[got["query_id"] == ids[k]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine["score"].is_monotonic_decreasing
        assert np.allclose(mine["score"], [s[np.searchsorted(ids, i)] for i in mine["vec_id"]], atol=1e-12, rtol=0)
        hits, asked = hits + len(want & set(mine["vec_id"])), asked + 5
    assert hits >= 0.9 * asked and set(got["query_id"]) == set(ids[ids % 50 == 0].tolist())


def test_scan_abandons_and_finds(spark):
    """With bounds of the nearest, what is left after the blocks holds every true neighbour, and is little."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    x = ann.unit(centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64)))
    turn = ann.rotation(64)
    columns, asked = ann.in_columns(x @ turn), x[:200] @ turn
    q, v, begun = ann.scan(columns, asked, np.full(200, np.inf), 6)
    found = set(zip(q.tolist(), v.tolist()))
    near = np.argsort(-(x[:200] @ x.T), axis=1)[:, :6]
    hits = sum((k, int(j)) in found for k in range(200) for j in near[k])
    assert hits >= 0.97 * 1200 and begun < 0.2 * 200 * 4000 and len(q) < 0.02 * 200 * 4000
    bounded, _, fewer = ann.scan(columns, asked, 2 - 2 * np.sort(x[:200] @ x.T, axis=1)[:, -6] + 1e-9, 6)
    assert fewer <= begun and len(bounded) <= len(q)


def test_quality_verdicts_of_hosts(spark):
    """The formula in plain Python: a rejected host, a strict one, a small one that is shrunk, a NULL one, and one at the bound."""
    good, soft, bad = "these are twelve plain words that no rule of them all minds " * 1, " ".join(f"w{k}#" for k in range(14)), "too few words"
    hosts = {f"g{k}": [good] * 30 for k in range(8)} | {"bad": [bad] * 28 + [good] * 2, "soft": [soft] * 10 + [good] * 20, "small": [bad, good], None: [good] * 10 + [soft]}
    rows = [(i, t, s) for i, (s, t) in enumerate((s, t) for s, texts in hosts.items() for t in texts)]
    got = quality.judge(docs_of(spark, rows)).toPandas().set_index("doc_id")
    fails = {s: [t != good for t in texts] for s, texts in hosts.items()}
    rates = [sum(f) / len(f) for f in fails.values()]
    mean, var = np.mean(rates), np.var(rates, ddof=1)
    k = min(1000.0, max(1.0, mean * (1 - mean) / var - 1))
    want = {s: (sum(f) + mean * k) / (len(f) + k) for s, f in fails.items()}
    verdict = {s: "rejected" if x > 0.5 else "strict" if x > 1.1 * mean else "trusted" for s, x in want.items()}
    assert verdict["bad"] == "rejected" and verdict["soft"] == "strict" and verdict["g0"] == "trusted" and want["small"] < 0.5
    for i, text, s in rows:
        r = got.loc[i]
        assert r["host_rate"] == pytest.approx(want[s]) and r["host_verdict"] == verdict[s]
        assert r["kept"] == (text != bad and (verdict[s] == "trusted" or (verdict[s] == "strict" and text == good)))
    assert not got[got["host_verdict"] == "rejected"]["kept"].any()
    tied = quality.judge(docs_of(spark, [(1, bad, "a"), (2, good, "a"), (3, bad, "b"), (4, good, "b")])).toPandas()
    assert set(tied["host_rate"]) == {0.5} and set(tied["host_verdict"]) == {"trusted"}  # at both bounds, so above neither


# ---------------------------------------------------------------- odd input, through all operators and stages


CLASHING = ("_p", "_row", "_h", "n", "w", "x", "node", "rank", "score", "late", "slot", "salt", "host", "bucket", "source_", "start", "length", "toxic", "chunk", "vec", "ids")


@pytest.fixture(scope="module")
def strange(spark, odd):
    return odd.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))).withColumnRenamed("doc_id_", "_language")


def test_odd_documents_through_operators(spark, strange, data):
    from findery.llm.toxicity import toxicity as score

    model = langid.fit(strange)
    tox = toxicity.train(["you idiot", "a fine day", "idiot again", "nice"], np.array([1, 0, 1, 0]), turns=1, epochs=1)
    for docs in (strange, strange.limit(0)):
        n = docs.count()
        assert quality.judge(docs).count() == n
        assert docs.select(langid.identify(spark, model, F.col("text")).alias("r")).count() == n
        assert docs.select(score(spark, tox, F.col("text")).alias("r")).filter("r between 0 and 1").count() == n
        assert nearjoin.near_classes(docs).count() == docs.filter("doc_id is not null").count()
        assert mixing.mix(docs).count() == n and mixing.mixture(docs).columns == docs.columns
        folder = Scratch(spark).sub("r")
        assert records.read_token_records(spark, folder, records.write_token_records(docs, folder, default_tokenizer(), 2)).count() == n
        packed = packing.pack(docs, default_tokenizer(), capacity=512).toPandas()
        assert (packed["piece"] == 0).sum() == n
    same = {(r["class_id"], r["n_links"]) for r in nearjoin.near_classes(strange).filter("doc_id in (3, 4)").collect()}
    assert same == {(3, 2)}
    scores = strange.select("doc_id", score(spark, tox, F.col("text")).alias("r")).filter("doc_id in (3, 4)").collect()
    assert len({r["r"] for r in scores}) == 1


def test_odd_documents_through_stages(spark, strange, data):
    import corpus_pipeline as pipeline

    out = Scratch(spark)
    for docs in (strange, strange.limit(0)):
        now = out.keep(docs, "docs")
        for name, stage in pipeline.STAGES[:-1]:
            last, now = now, out.keep(stage(spark, now, data), "stage")
            assert now.dtypes == docs.dtypes and now.count() <= last.count()
            if name.startswith("mixing"):
                assert sorted(map(str, now.collect())) == sorted(map(str, last.collect()))
        packed = out.keep(pipeline.pack(spark, now, data), "packed")
        assert packed.filter("piece = 0").count() == now.count()


def test_odd_vectors(spark):
    names = "vec_id long, embedding array<double>, vec int, list int, qid int, bound int, score int"
    more = (1, 2, 3, 4, 5)
    rows = [(k % 4, [1.0, float(k % 3)], *more) for k in range(40)] + [(100, [1.0, 0.0], *more), (150, None, *more), (None, [1.0, 1.0], *more), (200, [1e300, 1e300], *more), (250, [1e-300, 0.0], *more), (300, [], *more)]
    got = ann.search(spark.createDataFrame(rows, names), F.col("vec_id") % 50 == 0).toPandas()
    assert set(got["query_id"]) == {0, 100, 200, 250} and (got["query_id"] != got["vec_id"]).all()
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist() == [0, 1, 2, 3, 250]  # equal scores: smaller ids first
    long = spark.createDataFrame([(k * 50, [float(k == j) + 0.01 for j in range(3000)]) for k in range(8)], "vec_id long, embedding array<double>")
    assert ann.search(long, F.lit(True)).groupBy("query_id").count().filter("count = 5").count() == 8
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.search(one, F.lit(True)).count() == 0


def test_odd_turns(spark):
    kind = "conv_id long, turn int, role string, text string, place int, n_turns int, x1 int"
    long = "word " * 100_000
    rows = [(1, 0, "u", long), (1, 1, "a", "b"), (2, 0, "u", long), (3, None, None, None), (3, None, None, None), (4, None, None, None), (5, 0, "u", ""), (5, 0, "u", ""), (6, 0, "u", "")]
    turns = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], kind)
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.chat_documents(turns).collect()}
    assert got.keys() == {1, 3, 5} and got[1][2].count("word") == 100_000 and got[3][0] == got[5][0] == 2
    assert chat.chat_documents(turns.limit(0)).count() == 0


def test_odd_pages_and_records(spark):
    kind = "page_id long, url string, html string, archive int, offset int, digest string"
    rows = [(None, "u", "x"), (None, "u", "x"), (1, None, None), (1, "u", "y" * 200_000), (2, "", ""), (2, "", "")]
    pages = spark.createDataFrame([(*r, 1, 2, "d") for r in rows], kind)
    whole = warc.serialise(pages)
    assert whole.count() == 6 and whole.groupBy("archive", "offset").count().filter("count > 1").count() == 0
    assert warc.audit(whole, whole).count() == 0 and warc.audit(whole, whole.limit(0)).filter("verdict = 'missing'").count() == 6
    made = "archive string, page_id long, offset long, length long, digest string"
    a = spark.createDataFrame([(None, 1, 0, 5, "a"), ("x", 2, 0, 5, "b"), ("x", 3, None, 5, "c"), ("x", 4, 70_000, 5, "d")], made)
    b = spark.createDataFrame([(None, 1, 0, 6, "a"), ("x", 2, 0, 5, "b"), ("x", 3, None, 5, "e"), ("x", 4, 70_000, 5, "d"), ("x", 4, 70_000, 5, "d")], made)
    found = {(r["archive"], r["offset"]): r["verdict"] for r in warc.audit(a, b).collect()}
    assert found == {(None, 0): "corrupt", ("x", None): "corrupt", ("x", 70_000): "extra"}


def test_archives_of_one_name_in_two_folders(spark, tmp_path):
    rec = b"WARC/1.0\r\nContent-Length: 1\r\n\r\n%s\r\n\r\n"
    for side in "ab":
        for k, sub in enumerate(("p", "q")):
            (tmp_path / side / sub).mkdir(parents=True)
            (tmp_path / side / sub / "same.warc").write_bytes(rec % (b"z" if side == "b" and k else b"x"))
    found = warc.audit(warc.read_warc(spark, f"file://{tmp_path}/a"), warc.read_warc(spark, f"file://{tmp_path}/b/*")).collect()
    assert [(r["archive"], r["verdict"]) for r in found] == [("q/same.warc", "corrupt")]
