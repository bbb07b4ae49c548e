"""Operators without SQL against plain versions: link-graph walks, k-d cuts, the rule model, the pipeline's stages."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import kdshard, quality, urlgraph


def walk(edges, seeds, ahead, damping=0.85):
    """Plain personalised PageRank, to convergence in doubles."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for a, b, w in edges:
        step[(at[b], at[a]) if ahead else (at[a], at[b])] += w
    step /= np.maximum(step.sum(0), 1e-300)
    start = np.array([seeds.get(h, 0.0) for h in hosts])
    rank = np.zeros(len(hosts))
    for _ in range(400):
        rank = (1 - damping) * start + damping * step @ rank
    return dict(zip(hosts, rank))


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_plain_pagerank(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"h{rnd.randrange(12)}", f"h{rnd.randrange(30)}"): rnd.randint(1, 5) for _ in range(60)}
    edges = [(a, b, float(w)) for (a, b), w in edges.items() if a != b] + [(f"c{i}", f"c{i + 1}", 1.0) for i in range(15)]
    trust, distrust = {"h1": 0.5, "h2": 0.25, "h9": 0.25}, {"h3": 0.5, "c15": 0.5}
    hosts = {*trust, *distrust}
    got = urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(
        [(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in hosts], "host string, trust double, distrust double"))
    got = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    for k, want in ((0, walk(edges, trust, True)), (1, walk(edges, distrust, False))):
        for h, x in want.items():
            # what is still to come is a small part of each host's own rank
            assert got.get(h, (0.0, 0.0))[k] == pytest.approx(x, rel=1e-3, abs=1e-300), h


def test_propagation_without_edges_or_seeds(spark):
    edges = spark.createDataFrame([], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    assert [r["host"] for r in urlgraph.propagate(edges, seeds).collect()] == ["a"]
    assert urlgraph.propagate(edges, seeds.limit(0)).count() == 0


def plain_cuts(sizes, leaves):
    """Weighted medians of rows in order: the leaf of each row, by the middle of its bytes."""
    if leaves == 1:
        return [0] * len(sizes)
    goal, before, left = sum(sizes) * (leaves // 2) / leaves, 0, 0
    for x in sizes:
        if before + x / 2 >= goal:
            break
        before, left = before + x, left + 1
    half = leaves // 2
    return plain_cuts(sizes[:left], half) + [half + s for s in plain_cuts(sizes[left:], leaves - half)]


def test_shards_equal_plain_medians(spark):
    """One dimension (the length) and no equal texts: the leaves are the plain medians'."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) + str(n) for n in rnd.sample(range(10, 4000), 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in kdshard.kd_shards(kdshard.document_items(docs), 8).collect()}
    order = sorted(range(300), key=lambda i: len(texts[i]))
    assert [got[i] for i in order] == plain_cuts([len(texts[i]) + 1 for i in order], 8)


def test_groups_stay_whole_where_sizes_allow(spark):
    """Pairs of equal texts: a cut inside a pair moves to its nearer end, since that moves a shard by under 2 %."""
    texts = [f"text number {i // 2} " + "x" * (i // 2 % 50) for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = kdshard.kd_shards(kdshard.document_items(docs), 8).collect()
    held = collections.defaultdict(set)
    size = collections.Counter()
    for r in rows:
        held[r["text_crc32"]].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in held.values())
    assert max(size.values()) < 1.05 * min(size.values())


def test_rule_model_equals_plain_em():
    """The fitted posterior is the fixed point of a plain EM on single documents."""
    rnd = random.Random(7)
    names = ("a", "b", "c", "d")
    docs = []
    for _ in range(3000):
        good = rnd.random() < 0.7
        docs.append(tuple(0 if rnd.random() < 0.2 else (1 if (rnd.random() < q) == good else -1) for q in (0.9, 0.8, 0.7, 0.55)))
    patterns = sorted(collections.Counter(docs).items())
    m = quality.fit_rules(patterns, names)

    def posterior(votes):
        x = math.log(m.prior / (1 - m.prior)) + sum(math.log(g[v] / b[v]) for g, b, v in zip(m.good, m.bad, votes))
        return 1 / (1 + math.exp(-x))

    p = np.array([posterior(d) for d in docs])
    votes = np.array(docs)
    for i in range(4):
        for v in (-1, 0, 1):
            for side, mass, first in ((m.good, p, {1: 0.6, 0: 0.2, -1: 0.2}), (m.bad, 1 - p, {1: 0.2, 0: 0.2, -1: 0.6})):
                want = (mass[votes[:, i] == v].sum() + quality.PSEUDO * first[v]) / (mass.sum() + quality.PSEUDO)
                assert side[i][v] == pytest.approx(want, abs=2e-4)
    assert m.prior == pytest.approx(0.7, abs=0.05)
    # the better rules weigh more
    pull = [math.log(g[1] / b[1]) for g, b in zip(m.good, m.bad)]
    assert pull[0] > pull[1] > pull[2] > pull[3]


def test_posterior_rejects_poor_texts_that_pass_the_base(spark):
    """Menus and symbol noise have enough words and no repeats; the votes against them overlap."""
    rnd = random.Random(12)
    clean = [(i, prose(2000 + i, rnd.randint(60, 400))) for i in range(600)]
    poor = []
    for i in range(60):
        words = prose(5000 + i, rnd.randint(80, 200), 3).split()
        poor.append((1000 + i, " | ".join(words) if i % 2 else " ".join(w + rnd.choice(["###", "$$$", "%%%", "&&&"]) for w in words)))
    some = [(3000 + i, prose(9000 + i, 150) + " costs 5% & more #1") for i in range(20)]  # a few symbols are no fault
    frame = spark.createDataFrame(clean + poor + some, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(frame).collect()}
    assert not any(got[i]["base_failed"] for i, _ in clean + poor + some)
    assert sum(not got[i]["kept"] for i, _ in poor) >= 57
    assert sum(not got[i]["kept"] for i, _ in clean + some) <= 6


def test_noisy_words_are_words_with_a_symbol(spark):
    texts = ["a b c", "a# b |", "## a#b#c", "x" * 200_000 + " #", "#", "a\t$b\nc", " % "]
    got = quality.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["_q_noisy"] for r in got] == [sum(any(c in "#*$%&|<>" for c in w) for w in t.split()) for t in texts]


# ---- the pipeline -------------------------------------------------------------------------

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, text_key string"


def prose(seed, words=120, least=1):
    rnd = random.Random(seed)
    stems = ["mar", "ten", "ol", "vis", "ber", "tak", "sun", "lo", "grim", "pel", "dor", "win"]
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(least, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def pipeline_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, prose(i) + (" you vile stupid idiot scum worthless filth" * 3 if toxic else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[1][1]), (1001, rows[2][1].replace("mar", "mer", 1)), (1, rows[1][1]), (1002, None), (1003, ""), (1004, "short text"),
             (1005, "#### $$$$ |||| " * 60), (None, prose(900)), (1006, prose(901, 3000)), (1007, "word " * 200)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 0.5, True, "z") for i, t in rows], KIND)
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages(spark, pipeline_folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{pipeline_folder}/documents.parquet")
    before = collections.Counter(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, pipeline_folder), f"test-{name}")
        assert out.dtypes == docs.dtypes, name
        after = collections.Counter(r["doc_id"] for r in out.collect())
        gone = before - after
        assert not after - before, name
        if name == "toxicity":
            assert sum(i in gone for i in range(0, 400, 8)) >= 48 and not any(i in gone for i in range(400) if i % 8)
            assert {1002, 1003, None} <= set(after)
        if name == "quality":
            assert {1002, 1003, 1004, 1005, 1007} <= set(gone) and {None, 1006} <= set(after)
            assert sum(i in gone for i in range(400)) <= 8
        if name == "near_duplicates":
            assert after[1] == 1 and 1000 in gone and 1001 in gone and {2, None, 1006} <= set(after)
            assert sum(i in gone for i in range(400)) <= 1
        before, docs = after, out
    packed = corpus_pipeline.pack(spark, docs, pipeline_folder)
    tokens = collections.Counter()
    fill = collections.defaultdict(list)
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(tokens) == set(before)
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 1024


def test_pipeline_of_an_empty_table(spark, pipeline_folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{pipeline_folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_their_predecessors_rows(spark, pipeline_folder, monkeypatch):
    """run() gives each stage what the one before kept, in order."""
    seen = []

    def stage(name):
        def f(spark, docs, folder):
            seen.append((name, docs.count()))
            return docs.where(F.col("doc_id") > {"a": 10, "b": 50, "c": 300}.get(name, -1))
        return f
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in "abc"])
    out = corpus_pipeline.run(spark, pipeline_folder)
    n = spark.read.parquet(f"{pipeline_folder}/documents.parquet")
    assert [x for x, _ in seen] == ["a", "b", "c"]
    assert [c for _, c in seen] == [n.count(), n.where("doc_id > 10").count(), n.where("doc_id > 50").count()]
    assert out.count() == n.where("doc_id > 300").count()
