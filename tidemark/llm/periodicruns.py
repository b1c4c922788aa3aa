"""Runs of words that repeat with a period, from suffix classes united by decreasing common prefix."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least words of a run, least periods it holds.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of texts searched at once; a longer text is searched alone, so memory follows the longest text.
GROUP_BYTES = 1 << 20
#: Odd numbers that mix a window's words and its document into 64 bits; a clash of mixes only costs time.
MIXERS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def least_prefix(words: int, periods: int) -> int:
    """Words that two suffixes one period apart share at least, in any run of so many words and periods."""
    return min(max(words, periods * q) - q for q in range(1, words + 1))


def _classes(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """For sorted keys: where each element's class of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_order(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, shared)``: suffixes that share ``window`` words with another of their document, in an order in which equal
    prefixes are neighbours, and the words each shares with the one before it (0 at a new class).

    ``ids`` are word numbers from 1, documents are followed by ``window`` zeros, and ``ends`` has each place's end of document.
    Windows that come once are found by a hash and left out; the others are ordered by whole words and doubled prefixes.
    """
    n = len(ids)
    inside = np.flatnonzero(np.arange(n) + window <= ends)
    mix = owner[inside].astype(np.uint64) * MIXERS[-1]
    for k in range(window):
        mix = (mix ^ (mix >> np.uint64(29))) * MIXERS[k % 63] + ids[inside + k].astype(np.uint64)
    values = np.sort(mix)
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = inside[twice[np.minimum(np.searchsorted(twice, mix), len(twice) - 1)] == mix]
    # A shared prefix goes on for at most a window beyond the last place that shares one.
    marked = np.zeros(n + 1, np.int64)
    np.add.at(marked, found, 1)
    np.add.at(marked, np.minimum(found + window + 1, n), -1)
    places = np.flatnonzero(np.cumsum(marked[:n]) > 0)

    span = int(ids.max()) + 1
    keys = [owner[places].astype(np.int64)]
    for k in range(0, window, 2):
        pair = ids[places + k].astype(np.int64) * span
        keys.append(pair + (ids[np.minimum(places + k + 1, n - 1)] if k + 1 < window else 0))
    order = np.lexsort(keys[::-1])
    places = places[order]
    start = _classes(tuple(k[order] for k in keys))
    rank = np.full(n, -1, np.int32)
    rank[places] = start
    ranks, length = [rank], window
    while True:
        size = np.bincount(start, minlength=len(start))
        slots = np.flatnonzero(size[start] > 1)
        if not len(slots):
            break
        here = places[slots]
        first, second = rank[here].astype(np.int64), rank[here + length].astype(np.int64)
        order = np.argsort(first * (len(places) + 1) + second, kind="stable")
        places[slots] = here[order]
        start[slots] = slots[_classes((first[order], second[order]))]
        rank = rank.copy()
        rank[places[slots]] = start[slots]
        ranks.append(rank)
        length *= 2

    again = np.flatnonzero(ranks[0][places[1:]] == ranks[0][places[:-1]]) + 1
    a, b = places[again - 1], places[again]
    same = np.zeros(len(again), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        left, right = ranks[level][np.minimum(a + same, n - 1)], ranks[level][np.minimum(b + same, n - 1)]
        same += np.where((left >= 0) & (left == right), window << level, 0)
    going = np.ones(len(again), bool)
    for _ in range(window - 1):
        going &= ids[np.minimum(a + same, n - 1)] == ids[np.minimum(b + same, n - 1)]
        same += going
    shared = np.zeros(len(places), np.int64)
    shared[again] = same
    return places, shared


def seeds(places: np.ndarray, shared: np.ndarray, words: int, periods: int) -> list[tuple[int, int, int]]:
    """``(place, distance, prefix)`` of suffixes that become neighbours in their class and are near enough to make a run.

    Neighbours in the suffix order are united by decreasing common prefix, in a
    union-find whose classes hold their places in order; the smaller class goes
    into the larger one. Two places that become neighbours when classes meet
    share exactly the prefix of that step, and no place between them shares as
    much, so their distance is the smallest period of what they cover.
    """
    parent = list(range(len(places)))
    held: list[list[int] | None] = [[p] for p in places.tolist()]
    out: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def met(a: int, b: int, prefix: int) -> None:
        gap = b - a
        if gap + prefix >= max(words, periods * gap):
            out.append((a, gap, prefix))

    joins = np.flatnonzero(shared)
    joins = joins[np.argsort(-shared[joins], kind="stable")]
    for slot, prefix in zip(joins.tolist(), shared[joins].tolist()):
        x, y = root(slot - 1), root(slot)
        if len(held[x]) < len(held[y]):
            x, y = y, x
        large, small = held[x], held[y]
        last, at = None, -1
        for p in small:
            i = bisect_left(large, p)
            if i != at:
                if last is not None:
                    met(last, large[at], prefix)
                if i:
                    met(large[i - 1], p, prefix)
            last, at = p, i
        if at < len(large):
            met(last, large[at], prefix)
        if 16 * len(small) > len(large):
            large += small
            large.sort()  # two ordered runs: a merge
        else:
            for p in small:
                insort(large, p)
        parent[y], held[y] = x, None
    return out


def runs(texts: list[list[bytes]], words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each list of words, by start, then period.

    A run is a longest stretch with a smallest period, of at least ``words``
    words and ``periods`` periods (two or more).
    """
    if words < 1 or periods < 2:
        raise ValueError("a run has at least one word and two periods")
    window = least_prefix(words, periods)
    sizes = np.array([len(t) for t in texts], np.int64)
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not (sizes > window).any():
        return result
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(chain.from_iterable(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + window)])[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes + window)
    ends = np.repeat(begin + sizes, sizes + window)
    ids = np.zeros(len(owner), np.int64)
    ids[np.arange(len(owner)) < ends] = pd.factorize(flat)[0] + 1
    places, shared = suffix_order(ids, owner, ends, window)
    for place, gap, prefix in seeds(places, shared, words, periods) if len(places) else ():
        if ids[place - 1] != ids[place + gap - 1] or place == begin[owner[place]]:  # no word before it goes on
            d = owner[place]
            result[d].append((int(place - begin[d]), gap + prefix, gap))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in result]


def collapse(text: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run, and each run's first period where no other run drops it."""
    if not found:
        return text
    keep = np.ones(len(text), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [text[i] for i in np.flatnonzero(keep)]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts, of ``GROUP_BYTES`` at most unless one text is longer."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > GROUP_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """id, n_words, ``runs`` (array of start, length, period, by start, then period) and ``collapsed`` of every row.

    Words are parted by ASCII blanks; ``collapsed`` joins the kept ones by one
    blank. A null, empty or blank text has no words and no runs. Rows are taken
    one by one: repeated rows and null ids get their own results. Nothing is
    shuffled; other columns of the input, whatever their names, are not read.
    """
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for a, b in _groups([len(t or b"") for t in raw]):
                texts = [(t or b"").split() for t in raw[a:b]]
                found = runs(texts, words, periods)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[dict(zip(RUN.names, r)) for r in f] for f in found], run_type),
                    pa.array([b" ".join(collapse(t, f)).decode() for t, f in zip(texts, found)], pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(search, schema)
