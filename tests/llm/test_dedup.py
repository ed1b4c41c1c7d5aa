"""The four dedup operators against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterlake.llm.exact_dedup import BLANKS, PatriciaTrie, exact_dedup
from rasterlake.llm.jaccard_join import Slices, jaccard_components, linked
from rasterlake.llm.substring_dedup import deep_nodes, prefix_groups, substring_dedup
from rasterlake.llm.suffix_dedup import Family, suffix_dedup

LAST = (1 << 63) - 1


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def order(i):
    return LAST if i is None else i


@pytest.mark.parametrize("memory", [48 << 20, 3000])
def test_exact_dedup(docs, memory):
    rows, groups = rows_of(docs), defaultdict(list)
    strip = lambda t: t.translate({ord(c): None for c in BLANKS})
    for i, t in rows:
        groups[strip(t)].append((-len(t), order(i), i))
    want = []
    for i, t in rows:
        g = groups[strip(t)]
        keep = min(g)[2]
        want.append((i, keep, len(g), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    same(exact_dedup(docs, memory).collect(), want)


def test_trie_spills_subtrees():
    trie, keys = PatriciaTrie(), [b"", b"a", b"abc", b"abd", b"b", b"bcd" * 50, b"abc"]
    for n, k in enumerate(keys):
        trie.insert(k, (-1, n, 1))
    spilled = dict(trie.spill_to(250))
    assert trie.size <= 250
    both = spilled | dict(trie.drain())
    assert both == {b"": (-1, 0, 1), b"a": (-1, 1, 1), b"abc": (-1, 2, 2), b"abd": (-1, 3, 1), b"b": (-1, 4, 1), b"bcd" * 50: (-1, 5, 1)}


def brute_bytes(rows, width):
    texts = [t.encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{"width": 200}, {"width": 30, "batch": 50, "memory": 40}, {"width": 12, "gram": 3, "batch": 160, "memory": 500}, {"width": 30, "crowd": 2}, {"width": 30, "crowd": 0, "batch": 20, "memory": 10}])
def test_suffix_dedup(docs, options):
    got = suffix_dedup(docs, **options).drop("kept").collect()
    same(got, brute_bytes(rows_of(docs), options["width"]))


def test_family_of_suffix_arrays():
    """Levels hold all distinct windows in byte order, with the number of their places; every place of a repeated one is reported."""
    rng = np.random.default_rng(7)
    width, family, texts, counts = 6, Family(6), [], Counter()
    for _ in range(40):
        batch = [bytes(rng.choice([0, 97, 98, 255], int(rng.integers(6, 14))).astype(np.uint8)) for _ in range(int(rng.integers(1, 5)))]
        n = rng.integers(1, 3, len(batch))
        data, first = np.frombuffer(b"".join(batch), np.uint8), np.cumsum([0, *map(len, batch)])[:-1]
        family.add(data, first, np.array([len(t) - width + 1 for t in batch]), n, len(texts))
        texts += batch
        for t, k in zip(batch, n.tolist()):
            for p in range(len(t) - width + 1):
                counts[t[p : p + width]] += k
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        for x in family.levels:
            own = [bytes(s) for s in x.suffixes]
            assert own == sorted(set(own)) and x.total.tolist() == [counts[s] for s in own]
        assert sorted(bytes(s) for x in family.levels for s in x.suffixes) == sorted(counts)
    got = {(c, w) for c, a, b in zip(*family.answers()) for w in range(a, b + 1)}
    assert got == {(c, p) for c, t in enumerate(texts) for p in range(len(t) - width + 1) if counts[t[p : p + width]] > 1}


def test_suffix_dedup_returns_what_is_left(spark):
    docs = spark.createDataFrame([(1, "-" + "abcdefghij" * 2 + "é"), (2, "abcdefghij" + "xy")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup(docs, width=10, gram=3, with_kept=True).collect()}
    assert {k: bytes(v).decode() for k, v in got.items()} == {1: "-é", 2: "xy"}


def brute_words(rows, width):
    texts, least = [t.encode().split() for _, t in rows], {}
    for (i, _), t in zip(rows, texts):
        for p in range(len(t) - width + 1):
            w = tuple(t[p : p + width])
            least[w] = min(least.get(w, LAST), order(i))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if least[tuple(t[p : p + width])] < order(i):
                gone[p : p + width] = [True] * width
        kept = b" ".join(w for w, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{"width": 13}, {"width": 5, "gram": 2, "limit": 8, "memory": 50}, {"width": 5, "crowd": 2}, {"width": 5, "crowd": 0, "memory": 10}])
def test_substring_dedup(docs, options):
    got = substring_dedup(docs, **options).drop("kept").collect()
    same(got, brute_words(rows_of(docs), options["width"]))


def test_many_rows_without_an_id(spark):
    rng = np.random.default_rng(12)
    said = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = said(8)
    rows = [(1, passage)] + [(None, f"{said(5 + k % 9)} {passage if k % 2 else said(8)} {said(4)}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(suffix_dedup(docs, width=30).drop("kept").collect(), brute_bytes(rows, 30))
    same(substring_dedup(docs, width=5).drop("kept").collect(), brute_words(rows, 5))


def test_prefix_groups_fit_and_share_their_prefix():
    rng = np.random.default_rng(1)
    suffixes = rng.integers(0, 3, (500, 4))
    seen = []
    for rows, depth in prefix_groups(suffixes, 20):
        assert len(rows) <= 20 or depth == 4
        assert (suffixes[rows, :depth] == suffixes[rows[0], :depth]).all()
        rows, nodes = deep_nodes(suffixes, rows, depth)
        seen += [tuple(suffixes[rows[i]]) for i in nodes]
    assert sorted(seen) == sorted(set(map(tuple, suffixes.tolist())))


def shingles(text, n):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in text.encode().split()]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = defaultdict(list)
    for k, s in enumerate(sets):
        if s:
            distinct[s].append(k)
    for group in distinct.values():
        for k in group:
            parent[root(k)] = root(group[0])
    keys = list(distinct)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[root(distinct[x][0])] = root(distinct[y][0])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), LAST), order(i))
    # rows without words are alone, even if they share an id
    return [(i, len(s), (least[root(k)] if s else order(i)) if (least[root(k)] if s else order(i)) != LAST else None) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, n, percent):
    same(jaccard_components(docs, n, percent).collect(), brute_components(rows_of(docs), n, percent))


def test_near_copies_of_one_text(spark):
    """A chain and a crowd of near copies, at the bound itself and one below."""
    rows = [(i, " ".join(f"w{k if k >= i else -k}" for k in range(120))) for i in range(0, 60, 2)]
    rows += [(1000 + i, " ".join(f"c{k}" if k != i else f"d{i}" for k in range(200))) for i in range(150)]
    rows += [(2000, " ".join(f"z{k}" for k in range(21))), (2001, " ".join(f"z{k}" for k in range(20))), (2002, " ".join(f"y{k}" for k in range(10))), (2003, " ".join(f"y{k}" for k in range(11)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3):
        same(jaccard_components(docs, n, 90).collect(), brute_components(rows, n, 90))


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(1 << 62, size=size, dtype=np.uint64) * np.uint64(4))
        most = len(a) * (100 - percent) // (100 + percent)
        drop, put = rng.integers(0, most + 1), rng.integers(0, most + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(1 << 62, size=put, dtype=np.uint64) * np.uint64(4)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            for common in (None, np.sort(rng.choice(a, len(a) // 3, False)), np.union1d(a, b)):
                assert np.intersect1d(Slices(percent, common).signatures(a), Slices(percent, common).signatures(b)).size
            assert list(linked([a], [b], percent, False, columns=7)) == [(0, 0)]
        else:
            assert list(linked([a], [b], percent, False)) == []
