"""Operators on small frames: nulls, empty and repeated rows, clashing columns, empty tables; and brute force."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, hnsw, kdshard, langid, minhash, packing, quality, toxicity, urlgraph, warczip, wordcode
from tidewatch.llm.queries import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, score double, kept boolean, _d0 string, shard int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(400))


def rows():
    base = " ".join(f"tok{i}" for i in range(120))
    texts = [(1, base), (2, base), (2, base), (3, base.replace("tok60", "other")), (4, None), (5, ""), (6, " \n\t "), (None, LONG),
             (7, LONG), (8, "short one"), (9, "Zeile eins\nZeile eins\n" * 40), (10, "x" * 3000), (11, "#### $$$$ |||| " * 60)]
    return [(i, t, None if i == 4 else "en", "s", 0.5, True, "z", 3) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_near_duplicates(docs, none):
    got = collections.defaultdict(set)
    for r in minhash.near_duplicate_classes(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert got[1] == {1, 2, 3} and got[7] == {None, 7} and got[4] == {4} and got[5] == {5} and got[6] == {6}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert minhash.near_duplicate_classes(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies with different numbers of edits, most of them no link of each other: buckets of more than
    ``small`` texts go through the finer bands. The classes are those of all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 8)), replace=False):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    df = collections.Counter(x for s in sets for x in s)
    idf = {x: 1 + np.log((1 + len(texts)) / (1 + n)) / np.log(2 + len(texts)) for x, n in df.items()}
    root = list(range(len(texts)))
    sim = {}
    for i in range(len(texts)):
        for j in range(i):
            sim[i, j] = sum(idf[x] for x in sets[i] & sets[j]) / sum(idf[x] for x in sets[i] | sets[j])
            if sim[i, j] >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 3 < len(set(root)) < 150
    for small in (4, 10**6):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(frame, small=small).collect()}
        assert got == dict(enumerate(root)), small


def test_pairs_of_a_large_bucket_are_all_tested(spark):
    """Tiles give every pair of a bucket that reaches the threshold, whatever its samples say."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    freq = minhash.Frequencies(120, np.ones((2, minhash._SLOTS), np.int64))
    key = lambda i: bytes([i])
    sums = spark.createDataFrame([(key(i), b, t) for i, (b, t) in enumerate(minhash.binned(freq, pa.array(texts)))],
                                 "k binary, bins binary, total double")
    large = spark.createDataFrame([(1, key(i), key(i), key(0), 120) for i in range(120)],
                                  "bucket long, k binary, root binary, main binary, n long")
    pairs = [(i, j) for i in range(120) for j in range(i + 1, 120)]
    sim = minhash.weighted_jaccard(freq, *(pa.array([texts[p[s]] for p in pairs]) for s in (0, 1)))
    want = {p for p, x in zip(pairs, sim) if x >= 0.8}
    got = {(r["a"][0], r["b"][0]) for r in minhash.tiled_pairs(large, sums, 0.8, tile=25).collect()}
    assert want <= got and 0 < len(want) < len(got) < len(pairs) / 2


def test_frequencies_do_not_depend_on_the_other_documents(spark):
    """100 documents with a common template and words of their own, 0.79 alike, among four million other
    shingles: no two are near-duplicates."""
    own = F.expr("array_join(transform(sequence(1, 32), i -> concat('o', id, 'y', i)), ' ')")
    mine = spark.range(100).select("id", F.concat(F.lit(" ".join(f"t{i}" for i in range(404)) + " "), own).alias("text"))
    other = spark.range(1000, 1102, 1, 8).select("id", F.expr("array_join(transform(sequence(1, 40000), i -> concat('f', id, 'x', i)), ' ')").alias("text"))
    docs = spark.createDataFrame(mine.collect(), mine.schema).union(other)
    got = minhash.near_duplicate_classes(docs, "id").collect()
    assert len(got) == 202 and all(r["class_id"] == r["doc_id"] for r in got)


def test_frequencies_are_counted_over_blocks(spark):
    texts = ["a b c d e f a b c d e", "A b c d e", "x", "b c d e f", None, "x", "  "] * 3 + ["only here"]
    sh = [set(minhash.weighted(d, o)[1].tolist()) for x in texts for _, d, o in minhash.V.slices(pa.array([(x or "").lower()]))]
    want = {x: n for x, n in collections.Counter(y for s in sh for y in s).items() if n > 1}
    docs = spark.createDataFrame([(i // 4, x) for i, x in enumerate(texts)], "block long, text string")
    freq, known = minhash.document_frequencies(docs)
    got = {b: dict() for b in range(6)}
    for r in known.collect():
        got[r["block"]].update(zip(minhash._unpack_sorted(r["shingles"]).tolist(), minhash._unpack(r["counts"]).tolist()))
    assert freq.documents == 16 and got == {b: {x: want[x] for s in sh[4 * b:4 * b + 4] for x in s if x in want} for b in range(6)}


def test_components_of_a_path_and_a_star(spark):
    key = lambda i: bytearray(f"{i:04d}".encode())
    path = [(key(i), key(i + 1)) for i in range(40)] + [(key(100), key(i)) for i in range(101, 130)]
    got = {bytes(r["k"]): bytes(r["root"]) for r in minhash.components(spark.createDataFrame(path, "a binary, b binary")).collect()}
    assert {v for k, v in got.items() if k <= b"0040"} == {b"0000"} and {v for k, v in got.items() if k >= b"0100"} == {b"0100"}
    assert len(got) == 41 + 30


def test_bpe(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    tok = bpe._tokenizer(path)
    got = bpe.encode_documents(docs, path, block_chars=500, with_ids=True).collect()
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode_documents(none, path).count() == 0


def test_bpe_of_long_words(spark):
    """Words of more tokens than 16 bits of byte length hold."""
    path = tokenizer_path("word_bpe_49k.json")
    tok = bpe._tokenizer(path)
    texts = ["1234567890" * 10_000, "\u5929\u5730\u7384\u9ec4\u5b87\u5b99" * 8_000, "plain words"]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in got:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert len(got) == 3 and max(r["n_tokens"] for r in got) >= 100_000


def test_decode_through_pieces(spark):
    path = tokenizer_path("word_bpe_49k.json")
    tok = bpe._tokenizer(path)
    ids = tok.encode("Hello there, friends", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(df, path).collect()}
    assert got == {1: tok.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_quality_counts(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality_verdicts(docs).collect()}
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for k in range(len(w) - 2) if n[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 7}
    assert quality.quality_verdicts(none).count() == 0 and quality.keep_good(none).count() == 0


def test_languages(spark, docs, none):
    train = [(i, "the and with this that from " * 5, "en") for i in range(30)] + [(i, "der die und nicht ein mit " * 5, "de") for i in range(30)]
    m = langid.fit_languages(spark.createDataFrame([*train, (None, None, None)], "doc_id long, text string, lang string"))
    got = spark.createDataFrame([(1, "and that with the"), (2, "und nicht mit der"), (3, None), (4, "123 !"), (5, "")],
                                "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.languages_of(got, m).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3]["score"] == 0
    empty = langid.fit_languages(none.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.languages_of(docs, empty).collect()} == {"und"}


def test_second_language_among_many(spark):
    """A quarter in another script is found however many languages are nearer to the rest of the text."""
    word = lambda k, i: "".join("bcdfghklmnprst"[(k * 7 + i * 3 + j * 5) % 14] + "aeiou"[(k + i + j) % 5] for j in range(3))
    latin = [" ".join(["the", "and", "of", "to", "in", "that", *(word(k, i) for i in range(6))] * 400) for k in range(12)]
    greek = " ".join(["και", "το", "της", "που", "είναι", "για"] * 800)
    train = [(i, t, f"l{k:02d}") for k, t in enumerate(latin) for i in range(5)] + [(i, greek, "el") for i in range(5)]
    m = langid.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    text = " ".join(latin[0].split()[:36] + greek.split()[:12])
    got = langid.mixtures(m, pa.array([text]))[0]
    assert got["lang_pred"] == "l00" and "el" in got["languages"]
    assert abs(got["shares"][got["languages"].index("el")] - 0.25) < 0.02


def test_toxicity(spark, docs, none):
    clean = [(f"good plain words number {i % 7} about the weather and the sea " * 4, 0) for i in range(60)]
    bad = [(f"good plain words you idiot number {i % 7} scum about the sea " * 4, 1) for i in range(60)]
    m = toxicity.fit_toxicity(spark.createDataFrame(clean + bad, "text string, toxic int"))
    df = spark.createDataFrame([(1, "the weather and the sea " * 9), (2, "the weather IDIOT! scum and the sea " * 9), (3, None), (4, "")],
                               "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, m).collect()}
    assert s[2] > 0.5 > s[1] and s[3] == s[4] <= s[1]
    found = df.select("doc_id", toxicity.passages_column(m, F.col("text")).alias("p")).collect()
    assert {r["doc_id"]: bool(r["p"]) for r in found} == {1: False, 2: True, 3: False, 4: False}
    nothing = toxicity.fit_toxicity(none.select("text", F.lit(1).alias("toxic")))
    assert all(r["score"] < 0.5 for r in toxicity.toxicity_scores(docs, nothing).collect())


def test_urls(spark):
    page = [(1, "http://A.example.ORG/es/x", None), (2, "https://example.org/en/1a?q", ""), (3, "http://x.org", "<a href='//b.net/'>"),
            (4, "http://x.org/", None), (5, "http://q.com/de/9#t", '<a href="http://spam.net/p">'), (6, "no scheme", None), (7, None, None),
            (8, "http://spam.net/p", '<a href="http://q.com/">'), (9, "http://b.net/z", None), (9, "http://b.net/z", None)]
    df = spark.createDataFrame([(*p, "x") for p in page], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in urlgraph.judge_urls(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4, 6, 7)] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/1a", "example.org/en/1", "block"),
        ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert got[5]["verdict"] == "block" and got[8]["verdict"] == "block" and got[9]["verdict"] == "allow"
    assert urlgraph.judge_urls(df).count() == 10 and urlgraph.judge_urls(df.limit(0)).count() == 0


def test_urls_behind_long_chains(spark):
    """A host that leads to a blocked host over 30 links is blocked."""
    page = [(i, f"http://h{i}.test/x", f'<a href="http://h{i + 1}.test/x">') for i in range(30)] + [(30, "http://h30.test/bad", None)]
    df = spark.createDataFrame(page, "page_id long, url string, html string")
    got = urlgraph.judge_urls(df, rules=(("block", "h30.test/bad"),)).collect()
    assert len(got) == 31 and {r["verdict"] for r in got} == {"block"}


def test_edges_of_deep_host_names(spark):
    labels = [f"l{i}" for i in range(40)]
    hosts = [".".join(labels), "x." + ".".join(labels[-3:]), "a.b", "c", ""]
    got = urlgraph.host_edges(spark.createDataFrame([(h, None) for h in hosts], "host string, html string")).collect()
    up = {(".".join(labels[i:]), ".".join(labels[i + 1:])) for i in range(38)} | {(hosts[1], ".".join(labels[-3:]))}
    assert len(got) == 2 * len(up) and {(r["src"], r["dst"]) for r in got} == up | {(b, a) for a, b in up}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[50:90] = v[0]  # copies
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8),
                                                        (1003, [1.0, None]), (None, v[1].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    use = hnsw.usable(df)
    got = collections.defaultdict(list)
    for r in hnsw.search(hnsw.build_index(use, shard_rows=200), use.filter("id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert len(got[q]) == 10 and all(s == d[i] for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(want))
    assert hit >= 54 and [i for i, _ in got[0]] == list(range(50, 60))
    assert hnsw.search(hnsw.build_index(use.limit(0)), use.limit(0)).count() == 0


def test_neighbours_over_many_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2400, 16)).astype(np.float32)
    v[100:130], v[500] = v[0], v[400]  # copies, among the queries too
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3000 + i, x[:5].tolist()) for i, x in enumerate(v[:300])],
                               "vec_id long, embedding array<float>")
    use = hnsw.usable(df)
    index, asked = hnsw.build_index(use, shard_rows=120), use.filter("id % 20 = 0")
    plan = hnsw.search(index, asked)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()  # graphs stay where they lie
    rows = sorted(map(tuple, plan.collect()))
    assert rows == sorted(map(tuple, hnsw.search(index, asked, block=13).collect()))
    monkeypatch.setattr(hnsw, "SLICE_QUERIES", 4)
    few = hnsw.build_index(use, shard_rows=3000)
    sliced = {(r[0], r[2]): r[3] for r in hnsw.search(few, asked).collect()}
    hit = n = 0
    for lo, hi, dim in ((0, 2400, 16), (3000, 3300, 5)):
        w = v[:hi - lo, :dim].astype(float)
        for q in range(lo, hi, 20):
            d = np.sqrt(((w - w[q - lo]) ** 2).sum(1))
            want = [lo + int(i) for i in np.lexsort((np.arange(len(w)), d)) if lo + i != q][:10]
            mine = [(i, s) for a, _, i, s in rows if a == q]
            assert len(mine) == 10 and all(s == d[i - lo] for i, s in mine)
            hit, n = hit + len({i for i, _ in mine} & set(want)) + sum((q, i) in sliced for i in want), n + 20
    assert index.select("shard").distinct().count() > 20 and hit >= 0.98 * n


def test_index_is_read_a_few_graphs_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "INDEX_GROUP", 256 << 10)
    v = np.random.default_rng(8).normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1)
    graphs = hnsw.build_index(hnsw.usable(df), shard_rows=100)
    path = graphs.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    for f in sorted(os.listdir(path)):
        if f.endswith(".parquet"):
            m = pq.ParquetFile(f"{path}/{f}").metadata
            assert all(m.row_group(g).total_byte_size < 2 * hnsw.INDEX_GROUP for g in range(m.num_row_groups)), f


def test_packing(docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    library = wordcode._library(path, True)

    def e(text):
        return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    pieces = packing.pack_documents(docs, path, size=64).collect()
    ids = collections.Counter()
    for i, t, *_ in rows():
        ids[i, e(t or "") + b"\0\0\0\0"] += 1
    by = collections.defaultdict(list)
    seq = collections.defaultdict(list)
    for r in pieces:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, raw), times in ids.items():
        mine = by[i, len(raw) // 4]
        assert sum(r["length"] for r in mine) == times * len(raw) // 4
        for r in mine:
            assert zlib.crc32(raw[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    for parts in seq.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack_documents(none, path, size=64).count() == 0


def test_shards(spark, docs, none):
    got = kdshard.kd_shards(kdshard.document_items(docs), 2).collect()
    assert len(got) == len(rows())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of a hot text").otherwise(
        F.concat(F.lit("t"), F.col("id") * 7919)).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    out = kdshard.kd_shards(kdshard.document_items(many), 8)
    size = {r["shard"]: (r["b"], r["n"], r["m"]) for r in out.groupBy("shard").agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()}
    assert sorted(size) == list(range(8)) and all(n == m + 1 for _, n, m in size.values())
    assert max(b for b, _, _ in size.values()) < 1.05 * min(b for b, _, _ in size.values())
    assert kdshard.kd_shards(kdshard.document_items(none), 8).count() == 0


def test_archives(spark):
    big = "<p>ümlaut</p>" * 20
    page = [(3, "u3", big), (1, None, big), (2, "u\r\n2", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "", ""), (1, "x", big)]
    df = spark.createDataFrame(page, "page_id long, url string, html string")
    manifest = warczip.write_archives(df, archive_bytes=300)
    got = warczip.read_archives(manifest).collect()
    assert len(got) == len(page) and sum(r["records"] for r in manifest.collect()) == len(page)
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] > 100) == {
        (1, "response", None): 1, (1, "revisit", 1): 1, (3, "revisit", 1): 1, (None, "revisit", 1): 1}
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)
    assert {r["url"] for r in got} == {p[1] for p in page}
    assert all(r["payload_digest"] == hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got if r["payload"] is not None)
    assert warczip.read_archives(warczip.write_archives(df.limit(0))).count() == 0
