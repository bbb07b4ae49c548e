"""Vectorised kernels against plain Python."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import bpe, hnsw, langid, minhash, packing, quality, textvec, toxicity, warczip
from tidewatch.llm.queries import tokenizer_path

TEXTS = ["", None, "one", "a b c d", "a b c d e", "a b c d e f a b c d e", "  x\ty \n z ", "ünï cödé wörds hier sind", "a" * 5000]


def test_words_hash_alike_wherever_they_stand():
    arr = pa.array(["foo bar", "bar", "xfoo foo bar\tfoo"])
    (_, data, offs), = textvec.slices(arr)
    w = textvec.words(data, offs)
    h = w.hashes().tolist()
    text = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert text == ["foo", "bar", "bar", "xfoo", "foo", "bar", "foo"]
    assert w.row.tolist() == [0, 0, 1, 2, 2, 2, 2]
    seen = collections.defaultdict(set)
    for t, x in zip(text, h):
        seen[t].add(x)
    assert all(len(v) == 1 for v in seen.values()) and len(set(h)) == 3


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_shingle_counts(most):
    for _, data, offs in textvec.slices(pa.array(TEXTS), most):
        row, sh, n = minhash.weighted(data, offs)
        for r in range(len(offs) - 1):
            words = bytes(data[offs[r]:offs[r + 1]]).decode().split()
            want = collections.Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
            assert sorted(n[row == r].tolist()) == sorted(want.values())


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(5)
    sh = textvec.mix(np.arange(1, 4001, dtype=np.uint64)) >> np.uint64(20)
    near = []
    for trial in range(20):
        pick = np.sort(rng.choice(sh, 300, replace=False))
        w = rng.uniform(1, 3, 300)
        other = w * np.where(rng.random(300) < 0.2, rng.uniform(0.2, 1, 300), 1)
        _, a = minhash.samples(np.zeros(300, int), pick, w)
        _, b = minhash.samples(np.zeros(300, int), pick, other)
        near.append((a == b).mean() - np.minimum(w, other).sum() / np.maximum(w, other).sum())
    assert abs(np.mean(near)) < 0.03


def test_weighted_jaccard_of_pairs():
    freq = minhash.Frequencies(10, np.ones((2, minhash._SLOTS), np.int64))
    a = pa.array(["a b c d e f", "x", "p q r s t u v"])
    b = pa.array(["a b c d e f", "y", "p q r s t u w"])
    got = minhash.weighted_jaccard(freq, a, b)
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] == pytest.approx(0.5)


def _segments_by_force(scores):
    """Ruzzo-Tompa by definition: the best segment (shortest of equals), then left and right of it."""
    best = None
    for i, j in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[i:j])
        if s > 0 and (best is None or (s, -(j - i), -i) > (best[0], -(best[2] - best[1]), -best[1])):
            best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    right = [(x, a + j, b + j) for x, a, b in _segments_by_force(scores[j:])]
    return [*_segments_by_force(scores[:i]), best, *right]


def test_maximal_segments():
    rnd = random.Random(3)
    for _ in range(150):
        scores = [rnd.choice([-3, -2, -1, 1, 2, 4]) + rnd.random() * 1e-3 for _ in range(rnd.randrange(0, 11))]
        got = sorted((a, b) for _, a, b in toxicity.maximal_segments(list(enumerate(scores))))
        assert got == sorted((a, b) for _, a, b in _segments_by_force(scores))


def test_patterns_cover_and_fit():
    rnd = random.Random(1)
    for size, m in ((16, 9), (64, 40), (1024, 200)):
        histogram = {rnd.randrange(1, size): rnd.randrange(1, 50) for _ in range(m)}
        found = packing.patterns(histogram, size)
        assert all(sum(k * v for k, v in col.items()) <= size for _, col in found)
        for length, n in histogram.items():
            assert sum(u * col.get(length, 0) for u, col in found) >= n - 1e-6
        uses, left = packing.rounded(histogram, found)
        for length, n in histogram.items():
            assert sum(k * col.get(length, 0) for k, col in uses) + left[length] == n and left[length] >= 0
    assert packing.patterns({}, 16) == []


def test_left_over_rests_need_no_padding():
    over = [{"doc_id": i, "text_key": i, "start": 0, "length": n, "rid": i} for i, n in enumerate([700, 700, 3, 1023])]
    cuts, end = packing._lay(over, 1024, 5)
    total = collections.Counter()
    for doc, _, parts in cuts:
        assert [p[0] for p in parts] == list(itertools.accumulate([0] + [p[1] for p in parts[:-1]]))
        for _, n, seq, _ in parts:
            total[seq] += n
    assert sum(total.values()) == 2426 and all(packing.padded(n, 1024) == n for n in total.values()) and max(total) < end


def test_bpe_words_equal_library():
    path = tokenizer_path("word_bpe_49k.json")
    tok = bpe._tokenizer(path)
    special, _ = bpe._specials(path)
    for t in ["Hello, World's END\x85x", "ΑΣ Σίσυφος ΣΑΣ", "été İstanbul", "a<|endoftext|>B <|startoftext|>", "\x00nul \x00\x00",
              "a\x1cb", "日本語 テキスト", "x" * 300, "I'll we're 1234", "　wide　space"]:
        ids = []
        for w in bpe.normal_words(t, path):
            if w[:1] == "\x00" and w[:2] != "\x00\x00":
                ids.append(special[w[1:]])
            else:
                ids += tok.encode(w[1:] if w[:1] == "\x00" else w, add_special_tokens=False).ids
        assert ids == tok.encode(t, add_special_tokens=False).ids, t


def test_graph_recall_and_ties():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(800, 16))
    v[400:] = v[:400] * 0.01 + v[0]  # a tight cluster beside a loose cloud
    find = hnsw.Searcher(hnsw.Graph.load(hnsw.build(v, 1).dump()))
    hit = 0
    for q in v[::20]:
        want = np.argsort(((v - q) ** 2).sum(1), kind="stable")[:10]
        hit += len(set(find(q, 10, 100)[0].tolist()) & set(want.tolist()))
    assert hit >= 0.95 * 400
    few = hnsw.Searcher(hnsw.build(v[:3], 1))
    assert len(few(v[0], 10, 50)[0]) == 3


def _inserted(v: np.ndarray, links: int, most: int, ef: int) -> list[list[int]]:
    """Lists of a layer after insertion one by one, by the nearest of the nodes before."""
    def square(a, b):
        return float(((v[a].astype(float) - v[b].astype(float)) ** 2).sum())

    def diverse(i, cand, n):
        taken = []
        for c in cand:
            if len(taken) < n and all(square(c, t) > square(i, c) for t in taken):
                taken.append(c)
        rest = [c for c in cand if c not in taken][:n - len(taken)]
        return [c for c in cand if c in taken or c in rest]

    lists = []
    for i in range(len(v)):
        lists.append(diverse(i, sorted(range(i), key=lambda j: square(i, j))[:ef], links))
        for j in lists[i]:
            if len(lists[j]) == 2 * most:
                lists[j] = diverse(j, sorted(lists[j], key=lambda c: square(j, c)), most)
            lists[j] = lists[j] + [i]
    return lists


def test_graph_is_that_of_insertion_one_by_one():
    v = np.random.default_rng(3).normal(size=(400, 6))
    v[:40] *= 0.1  # hubs, whose lists are thinned several times
    g = hnsw.build(v, 5, links=4, ef=20)
    levels = np.zeros(len(v), int)
    for k, own in enumerate(g.nodes):
        levels[own] = k
        want = _inserted(v[own], 4, 8 if k == 0 else 4, 20)
        assert [[j for j in row if j >= 0] for row in g.table[k].tolist()] == [own[x].tolist() for x in want]
    assert len(g.nodes) > 2 and g.entry == levels.argmax()


def test_queries_side_by_side_are_as_one_by_one():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 12))
    find, queries = hnsw.Searcher(hnsw.build(v, 1)), rng.normal(size=(150, 12))
    nodes, dist = find.many(queries, 10, 60)
    for q, a, d in zip(queries, nodes, dist):
        one = find(q, 10, 60)
        assert one[0].tolist() == a.tolist() and one[1].tolist() == d.tolist()
        assert np.array_equal(d, np.sqrt(((v[a] - q) ** 2).sum(1))) and len(set(a.tolist())) == 10
    apart = hnsw.build(v, 1)
    apart.table[0][:] = -1  # every node cut off
    got = hnsw.Searcher(apart).many(queries[:3], 10, 60)[0]
    assert all(set(a.tolist()) == set(np.argsort(((v - q) ** 2).sum(1))[:10].tolist()) for a, q in zip(got, queries))


def test_rules_find_the_odd_documents():
    good, bad = (1,) * 8, (-1, -1, -1, 0, 0, 0, 0, 1)
    m = quality.fit_rules([(good, 900), (bad, 100)], tuple("abcdefgh"))
    assert 0.8 < m.prior < 0.95 and m.good[0][1] > 0.9 and m.bad[0][-1] > 0.6
    assert quality.fit_rules([], tuple("abcdefgh")).prior == 0.8


def test_mixture_of_languages():
    names = ("aa", "bb")
    logp = np.full((langid.SLOTS, 2), -12.0, np.float32)
    for k, text in enumerate(("lorem ipsum dolor", "quick brown foxes")):
        (_, data, offs), = textvec.slices(pa.array([text]))
        logp[langid.grams(data, offs)[2], k] = -3.0
    m = langid.LanguageModel(names, logp)
    one, two, none = langid.mixtures(m, pa.array(["lorem ipsum " * 9, "lorem dolor " * 9 + "quick foxes " * 3, ""]))
    assert one["languages"] == ["aa"] and none is None
    assert two["languages"] == ["aa", "bb"] and two["shares"][0] == pytest.approx(0.75, abs=0.02)


def test_zip_ranges_read_zip64_and_comments(tmp_path):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"x" * 99, zipfile.ZIP_DEFLATED)
    raw = buf.getvalue()
    z = warczip.ZipRanges(lambda at, n: raw[at:at + n], len(raw))
    at, n = z.stored_at("a")
    assert raw[at:at + n] == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        z.stored_at("b")
    with pytest.raises(ValueError):
        warczip.ZipRanges(lambda at, n: b"nothing"[at:at + n], 7)
