"""Periodic runs, vector codes and the shingle-set join against brute force, and on odd input."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import none, odd, rows  # noqa: F401  fixtures
from tidemark.llm import catalog, ngramjoin, periodicruns, vectorcodes


def brute_runs(text, words=6, periods=4):
    n, found = len(text), []
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and text[j] == text[j + q]:
                j += 1
            if j > i and j - i + q >= max(words, periods * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    inner = [r for r in found if not any(r[2] % q == 0 and q < r[2] and s <= r[0] and s + n_ >= r[0] + r[1] for s, n_, q in found)]
    return sorted(inner, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(0, 39), st.integers(1, 9)), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (7, 3)]))
def test_runs_against_brute_force(parts, least):
    texts = [[t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))] if a + p <= len(t) else t for t, a, p in parts]
    assert periodicruns.runs(texts, *least) == [brute_runs(t, *least) for t in texts]


def test_long_runs():
    one, mixed = [b"x"] * 30_000, [b"a", b"b", b"a", b"c"] * 5_000 + [b"a", b"b"]
    assert periodicruns.runs([one, mixed, []]) == [[(0, 30_000, 1)], [(0, 20_002, 4)], []]
    assert periodicruns.collapse(mixed, [(0, 20_002, 4)]) == mixed[:4]


def test_find_runs_on_odd_input(spark, odd, none):  # noqa: F811
    want = []
    for r in rows(odd):
        text = (r["text"] or "").encode().split()
        found = brute_runs(text)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r["doc_id"], len(text), tuple(found), " ".join(t.decode() for i, t in enumerate(text) if i not in drop)))
    out = [(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in rows(periodicruns.find_runs(odd))]
    assert Counter(out) == Counter(want) and any(r[2] for r in out)
    assert periodicruns.find_runs(none).count() == 0


def test_planted_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 7 * 9))) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(catalog.with_repeats(docs))}
    for i in range(300):
        t, h = [f"w{k}" for k in range(i % 7 * 9)], zlib.crc32(str(i).encode())
        if h % 10 == 0 and t:
            g = h // 10
            a = g % len(t)
            p = 1 + (len(t) - a) // (3 + g % 8)
            t = [t[k] if k < a else t[a + (k - a) % p] for k in range(len(t))]
        assert got[i].split() == t
    assert got[None] == "a b"


def test_best_run_by_exact_ratio(spark, tmp_path):
    texts = ["x y " * 9 + "x q " + "r s t " * 6, "a " * 7 + "b c " * 14, "z", None]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in rows(catalog.QUERIES["op11_kruskal_periodic_runs"](spark, str(tmp_path))):
        found = brute_runs((texts[r["doc_id"] - 1] or "").encode().split()) if zlib.crc32(str(r["doc_id"]).encode()) % 10 else None
        if found:
            best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"], r["n_runs"]) == (*best, math.floor(Fraction(1000 * best[1], best[2])), len(found))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 90), st.sampled_from([2, 9, 1500, 2**29]), st.integers(1, 5))
def test_tree_finds_the_nearest_and_lowest(seed, entries, spread, width):
    rng = np.random.default_rng(seed)
    book, queries = rng.integers(-spread, spread, (entries, width)), rng.integers(-spread, spread, (40, width))
    away = ((queries[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
    entry, distance = vectorcodes.nearest(book, queries)
    assert entry.tolist() == away.argmin(axis=1).tolist() and distance.tolist() == away.min(axis=1).tolist()


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-10_000, 10_000, (16, 4))
    book = np.concatenate([c + rng.integers(-20, 20, (16, 4)) for c in centres])
    search = vectorcodes.Search(book, book + rng.integers(-5, 5, book.shape))
    search.visit(vectorcodes.tree(book), np.arange(len(book)))
    assert search.compared < len(book) ** 2 / 4


def brute_codes(data, entries, rounds=4):
    """data: whole-number vectors by id; gives codes, errors and codebooks."""
    width = data.shape[1] // 4
    parts = [data[:, k * width:(k + 1) * width] for k in range(4)]
    books = [p[:entries].copy() for p in parts]

    def assign(k):
        away = ((parts[k][:, None] - books[k][None]) ** 2).sum(axis=2)
        return away.argmin(axis=1), away.min(axis=1)
    for _ in range(rounds):
        for k in range(4):
            at, _ = assign(k)
            books[k] = np.array([parts[k][at == e].sum(axis=0) // (at == e).sum() if (at == e).any() else books[k][e] for e in range(len(books[k]))])
    found = [assign(k) for k in range(4)]
    return ["".join(f"{a[i]:02x}" for a, _ in found) for i in range(len(data))], sum(d for _, d in found), books


def test_codes_on_odd_input(spark):
    rng = random.Random(2)
    good = [[rng.choice([-0.5, 0.25, 0.1, rng.uniform(-3, 3)]) for _ in range(8)] for _ in range(60)]
    table = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(good)]
    odd_rows = [(100, None, 1), (101, [float("nan"), *good[0][1:]], 1), (102, [float("inf"), *good[0][1:]], 1), (103, [None, *good[0][1:]], 1), (104, good[0][:5], 7), (105, [], None)]
    schema = "vec_id long, embedding array<float>, label int, code string, _id string, sums int"
    frame = spark.createDataFrame([(*r, "c", "i", 3) for r in [*table, table[-1], table[-1], (None, good[3], None), *odd_rows]], schema).repartition(5)
    kept = [*table, table[-1], table[-1], (None, good[3], None)]
    data = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in kept], np.int64)
    codes, errors, books = brute_codes(data, 9)
    out = rows(vectorcodes.compress(frame, entries=9))
    total = Counter()
    for (_, _, label), e in zip(kept, errors.tolist()):
        total[label] += e
    want = Counter((i, c, e, total[label]) for (i, _, label), c, e in zip(kept, codes, errors.tolist()))
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out if r["code"]) == want
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in out if not r["code"]) == [(104, None, None), (105, None, total[None])]
    assert {r["codebooks_sha256"] for r in out} == {vectorcodes.digest(books)}
    assert vectorcodes.compress(frame.limit(0)).count() == 0
    assert rows(vectorcodes.compress(frame.filter("vec_id = 105")))[0]["code"] is None


def brute_sets(table):
    sets = []
    for _, t in table:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append(frozenset(zip(*[w[j:len(w) - k + 1 + j] for j in range(k)])) if w else frozenset())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, s in enumerate(sets):
        for y in range(x if s else 0):
            both = len(s & sets[y])
            if 100 * both >= 80 * (len(s) + len(sets[y]) - both):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, (i, _) in enumerate(table):
        r = root(x)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return Counter((i, len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(table))


def near_texts(seed, count):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 5, 8, 30, 80, 120, 130, 200]))] for _ in range(20)]
    table = []
    for i in range(count):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + max(1, len(b) // 18))):
            b[rng.randrange(len(b))] = f"W{rng.randrange(400)}"
        table.append((i if rng.random() < 0.97 else None, " ".join(b)))
    return table


def test_sets_against_brute_force(spark, odd, none, monkeypatch):  # noqa: F811
    table = near_texts(3, 400)
    table += [(5000, None), (5001, ""), (None, " \t"), (5002, "One"), (5003, "one"), table[3], table[3]]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    want = brute_sets(table)
    assert len({c for _, _, c in want}) > 50
    assert Counter(tuple(r) for r in ngramjoin.near_duplicates(frame).collect()) == want
    monkeypatch.setattr(ngramjoin, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(ngramjoin, "FILTER_BITS", 64)
    assert Counter(tuple(r) for r in ngramjoin.near_duplicates(frame).collect()) == want
    given_ = [(r["doc_id"], r["text"]) for r in rows(odd)]
    assert Counter(tuple(r) for r in ngramjoin.near_duplicates(odd).collect()) == brute_sets(given_)
    assert ngramjoin.near_duplicates(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=30))
def test_search_finds_every_partner(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    index = ngramjoin.Index(list(range(len(sets))), arrays)
    for a, query in zip(sets, arrays):
        assert {index.ids[m] for m in index.search(query)} == {i for i, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)}
