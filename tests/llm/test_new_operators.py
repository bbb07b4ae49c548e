"""Best-fit packing, cross-tokenizer alignment and ranked search: brute force, odd texts, nulls, repeats, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import align, bestfit, lexical, wordcode
from tidewatch.llm.queries import tokenizer_path

KIND = "doc_id long, text string, piece string, n_a string, score double, n long, rank int, item_id long, sequence_id long"
ODD = ["", None, " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n b c", "x <|endoftext|> y z", "<|endoftext|>", "tab\tb c\td",
       "a\x00b c", "a\x1cb \x85 c", "it's don't 'S", "1" * 3000 + " b", "　x y z", "foo \n bar", "日本語 テキスト 😀😀 x",
       "a▁b c", "<s> </s> <unk> <0x41>", "ｆｕｌｌ ﬁ", "The THE the. The\nthe", "word " * 400]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    bits = [" ", " ", " ", "\n", "a", "b1", "é", "日", "'s", ".", "\t", "\x85", "\xa0", "<|endoftext|>", "\x1d", " ", "😀", "\x00", "▁", "Z"]
    return ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(n)]


def table(spark, texts):
    rows = [(None if i == 5 else i, t, "p", "q", 0.5, 7, 1, 9, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[20], rows[20]], KIND), [(r[0], r[1]) for r in rows + [rows[20], rows[20]]]


def library_ids(text, special=True):
    return wordcode._library(tokenizer_path("byte_bpe_50k.json"), special).encode(text, add_special_tokens=False).ids


# ---- units ---------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [3, 600_000])
@pytest.mark.parametrize("special", [True, False])
def test_units_give_the_librarys_ids(limit, special):
    coder = wordcode.ByteCoder(tokenizer_path("byte_bpe_50k.json"), special, limit)
    texts = odd_texts(800)
    seen = 0
    for lo, ids, bounds in coder.batches(pa.array([*texts, *texts], pa.string()).slice(3)):
        for i in range(len(bounds) - 1):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library_ids([*texts, *texts][lo + i + 3] or "", special)
            seen += 1
    assert seen == 2 * len(texts) - 3


def test_chunks_hold_whole_texts():
    texts = pa.array(["aa", None, "b" * 50, "", "c", "dd"])
    parts = [(lo, some.to_pylist()) for lo, some in wordcode.chunks(texts, 4)]
    assert [t for _, p in parts for t in p] == texts.to_pylist() and [lo for lo, _ in parts] == [0, 2, 3]


# ---- best-fit packing ---------------------------------------------------------------------

def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= size and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_search_keeps_every_piece_and_reaches_the_fewest_bins():
    rnd = random.Random(3)
    for _ in range(150):
        size = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, size) for _ in range(rnd.randint(0, 10))]
        bins = bestfit.swap_search(bestfit.best_fit(collections.Counter(items), size), size)
        held = collections.Counter()
        for pattern, n in bins.items():
            assert bestfit._fill(pattern) <= size
            for length, k in pattern:
                held[length] += k * n
        assert held == collections.Counter(items) and bins.total() == fewest(items, size)


def test_search_empties_bins_and_raises_squared_fill():
    """Thirds: best fit by decreasing length leaves bins that exchanges empty."""
    rnd = random.Random(5)
    histogram = {x: 20 + rnd.randint(0, 40) for x in range(335, 395)}
    first = bestfit.best_fit(histogram, 1024)
    last = bestfit.swap_search(first, 1024)

    def squares(bins):
        return sum(bestfit._fill(p) ** 2 * n for p, n in bins.items())

    assert last.total() < first.total() and squares(last) > squares(first)
    once = bestfit.swap_search(first, 1024, moves=1)
    assert squares(first) < squares(once) <= squares(last)


def test_best_exchange_is_the_largest_net_move():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.randint(1, 30) for _ in range(rnd.randint(1, 5))] for _ in range(2))
        gap = rnd.randint(1, 12)
        pat = [tuple(sorted(collections.Counter(x).items(), reverse=True)) for x in (a, b)]
        net, out, back = bestfit._best(bestfit._Sums(pat[0]), bestfit._Sums(pat[1]), gap)
        pairs = [[(x[i], x[j]) for i in range(len(x)) for j in range(i)] for x in (a, b)]
        moves = [(x,) for x in a]
        tried = [sum(o) for o in moves] + [sum(o) - y for o in [*moves, *pairs[0]] for y in b] + [x - sum(p) for x in a for p in pairs[1]]
        assert net == max([t for t in tried if 0 < t <= gap], default=0)
        assert net == sum(out) - sum(back)


@pytest.mark.parametrize("size", [16, 64])
def test_best_fit_sequences(spark, size):
    path = tokenizer_path("byte_bpe_50k.json")
    docs, rows = table(spark, odd_texts(150, 4))
    out = bestfit.best_fit_sequences(docs, path, size=size)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = collections.Counter()
    seqs = collections.defaultdict(list)
    for r in out.collect():
        got[tuple(r)[:5]] += 1
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = library_ids(t or "") + [2]
        total += len(ids)
        cuts = [0] + list(range(len(ids) % size or size, len(ids) + 1, size)) if len(ids) > size else [0, len(ids)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())] += 1
    assert got == want
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    assert len(seqs) <= -(-total // size) + 2
    assert bestfit.best_fit_sequences(docs.limit(0), path, size=size).count() == 0


# ---- alignment ------------------------------------------------------------------------------

def aligned_by_force(text):
    """(A ids, B ids, links, groups text) of a text; empty if a tokenizer does not give it back."""
    a_path, b_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    if not text:
        return [], [], [], ""
    a, b = library_ids(" " + text, False), align._pieces(b_path).encode(text)
    sizes = []
    for ids, tokens in ((a, align.byte_tokens(a_path)), (b, align.piece_bytes(b_path))):
        parts = [tokens[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return [], [], [], ""
        sizes.append(np.cumsum([len(p) for p in parts]).tolist())
    ended = [dict(zip(ends, ids)) for ids, ends in ((a, sizes[0]), (b, sizes[1]))]
    links = [(ended[0][x], ended[1][x]) for x in sizes[0] if x in ended[1]]
    said, mine = [], [[], []]
    for x in range(1, sizes[0][-1] + 1):
        for side in (0, 1):
            if x in ended[side]:
                mine[side].append(str(ended[side][x]))
        if x in ended[0] and x in ended[1]:
            said.append("|".join(map(",".join, mine)))
            mine = [[], []]
    return a, b, links, ";".join(said)


def test_pointer_jumping_labels_components():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        n = int(rnd.integers(1, 40))
        ends = [np.append(np.flatnonzero(rnd.random(n) < p), n) if n else np.array([0]) for p in rnd.random(2)]
        ends = [np.unique(e[e > 0]) for e in ends]
        to_a, to_b = align.terminals(*ends)
        cuts = np.intersect1d(*ends)
        for to, e in ((to_a, ends[0]), (to_b, ends[1])):
            assert (ends[1][to] == cuts[np.searchsorted(cuts, e)]).all()


def test_alignment_equals_brute_force(spark):
    a_path, b_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    docs, rows = table(spark, odd_texts(500, 6))
    out, pairs = align.align_documents(docs, a_path, b_path, groups=True)
    force = [(i, *aligned_by_force(t)) for i, t in rows]
    count = collections.Counter(link for f in force for link in f[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = collections.Counter(
        (i, len(a), len(b), said.count(";") + 1 if said else 0, len(links), hashlib.sha256(said.encode()).hexdigest() if said else "",
         said, sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)) for i, a, b, links, said in force)
    assert collections.Counter(tuple(r) for r in out.collect()) == want
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(count)
    assert sum(1 for f in force if f[1]) > 200 and sum(1 for f in force if not f[1]) > 20
    rest, none = align.align_documents(docs.limit(0), a_path, b_path)
    assert rest.count() == 0 and none.count() == 0


def test_alignment_with_a_small_unit_table_and_a_long_text():
    a_path, b_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    long = " ".join(f"w{i}x" for i in range(5000)) + " " + "9" * 20_000 + " end"
    texts = pa.array(["one two", long, "zwei drei one"], pa.string())
    for limit in (2, 10_000):
        got = [r for b in align.Aligner(a_path, b_path, limit).batch(pa.array([1, 2, 3]), texts, True) for r in b.to_pylist()]
        for r, t in zip(got, texts.to_pylist()):
            a, b, links, said = aligned_by_force(t)
            assert (r["n_a"], r["n_b"], r["n_links"], r["groups"]) == (len(a), len(b), len(links), said)


def test_pairs_stay_under_the_bound():
    a, b = align.byte_tokens(tokenizer_path("byte_bpe_50k.json")), align.piece_bytes(tokenizer_path("piece_bpe_32k.model"))
    assert align.pair_bound(a, b) < 2_000_000


# ---- ranked search ------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_force(docs, items, top=20):
    held = [(i, collections.Counter(WORD.findall(t.translate(FOLD)))) for i, t in docs if t is not None]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = collections.Counter()
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                    for w in WORD.findall((text or "").translate(FOLD)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for k, (s, _, _, i) in enumerate(sorted(scored)[:top]):
            out[item, k + 1, i, -s] += 1
    return out


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "THE", "The", "ſ", "İ"]
    texts = ODD + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60))) for _ in range(250)] + ["same words here"] * 30
    docs, rows = table(spark, texts)
    items = [(1, "w1 w2 w2 the"), (2, None), (3, ""), (4, "unknown term"), (None, "same words HERE"), (1, "日本 é İ ſ"), (7, "w3-w4_w5 w3")]
    asked = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, doc_id int, rank string")
    want = ranked_by_force(rows, items)
    # rows that tie in everything, ids too, may stand in either order: they are equal rows
    assert collections.Counter(tuple(r) for r in lexical.rank_documents(docs, asked).collect()) == want
    assert want.total() >= 80
    monkeypatch.setattr(lexical, "HITS", 5)  # many small steps, and a block an item
    few = lexical.rank_documents(docs.repartition(7), asked, top=3, block_chars=1)
    assert collections.Counter(tuple(r) for r in few.collect()) == ranked_by_force(rows, items, 3)
    assert few.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert lexical.rank_documents(docs.limit(0), asked).count() == 0
    assert lexical.rank_documents(docs, asked.limit(0)).count() == 0


def test_heaps_keep_the_best_with_ties():
    rnd = np.random.default_rng(4)
    heaps, seen = lexical.Heaps(3, 5), []
    for _ in range(20):
        scores = rnd.integers(-2, 6, (rnd.integers(1, 9), 3))
        ids = rnd.integers(0, 1000, len(scores))
        heaps.offer(scores, ids, np.zeros(len(ids), np.int64))
        seen += [(int(s), int(d), i) for row, d in zip(scores, ids) for i, s in enumerate(row)]
    for i in range(3):
        best = sorted((-s, d) for s, d, k in seen if k == i and s > 0)[:5]
        assert [(-s, d) for s, d in zip(heaps.score[heaps.item == i], heaps.doc[heaps.item == i])] == best
