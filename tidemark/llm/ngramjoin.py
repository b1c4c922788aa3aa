"""Word-shingle sets that overlap: a T-occurrence search over inverted lists, dealt out in blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components
from tidemark.session import materialize

#: Words of a shingle, per cent of the union that two sets share at least.
SHINGLE_WORDS, PERCENT = 5, 80
#: Bytes of texts whose words are hashed together.
GROUP_BYTES = 1 << 20
#: Share of all shingles (those of the smallest hashes) that are counted first; sets up to SMALL are counted whole.
SAMPLE, SMALL = 0.3, 100
#: Bits of the filter of sets that go on. It only spares work, an exact join follows.
FILTER_BITS = 1 << 24
#: Members and shingles of a block that meet in one task at most; larger blocks are cut in pieces that meet pairwise.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 21
#: Weight of the logarithm in the number of long lists; small, since probes end early and merged rows do not.
MU = 0.001


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Shingles that a set shares with any partner at least."""
    return -(-percent * size // 100)


def pair_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles that sets of these sizes must share."""
    return -(-percent * (a + b) // (100 + percent))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text.

    Letters A-Z count as lower case, words are parted by ASCII blanks. Fewer
    words than a shingle has make one shingle; null and blank texts have none.
    """
    for a, b in _groups([len(t or b"") for t in texts]):
        words = [(t or b"").lower().split() for t in texts[a:b]]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
        # Shingles of the whole stretch at once; those that cross texts are not taken.
        rows = max(len(hashes) - size + 1, 0)
        whole = np.full(rows, size, np.uint64)
        for i in range(size):
            whole = _mix(whole + hashes[i:i + rows])
        end = 0
        for w in words:
            begin, end = end, end + len(w)
            if len(w) >= size:
                yield _distinct(whole[begin:end - size + 1].view(np.int64))
                continue
            h = np.full(min(len(w), 1), len(w), np.uint64)
            for i in range(len(w)):
                h = _mix(h + hashes[begin + i])
            yield h.view(np.int64)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > GROUP_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _class_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a whole set; empty sets have none."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _mark(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _counted(shingles: np.ndarray, sample: float) -> np.ndarray:
    """The shingles of a set that are counted first. Partners of a set that is counted whole are counted whole too."""
    whole = len(shingles) * PERCENT <= SMALL * 100
    return shingles if whole else shingles[:np.searchsorted(shingles, int((sample - 0.5) * 2**64))]


def _judged(n: int, shingles: np.ndarray, sample: float) -> int:
    """Counted shingles that every partner of the set counts too."""
    return n if n <= SMALL else int(np.searchsorted(shingles, int((sample - 0.5) * 2**64)))


def _describe(sample: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), _class_key(s), _judged(len(s), s, sample)) for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in sets], pa.int64()), pa.array([k for _, k, _ in sets], pa.binary()),
                                              pa.array([None if k is None else _mark(k) for _, k, _ in sets], pa.int64()), pa.array([j for _, _, j in sets], pa.int64())],
                                             names=["doc_id", "n", "key", "mark", "judged"])
    return run


def _sample(sample: float):
    """``(key, mark, n)``: a counted shingle of a class (n = 0). A shingle that several classes of a batch hold is sent for
    two of them, the others count it at once (rows of key = mark with n over 0), so a frequent one costs two rows a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, marks, seen = [], [], set()
            for s in shingle_sets(batch.column(0).to_pylist()):
                key = _class_key(s)
                if key is None or key in seen:
                    continue
                seen.add(key)
                part = _counted(s, sample)
                parts.append(part)
                marks.append(np.full(len(part), _mark(key), np.int64))
            token, mark = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, marks))
            order = np.argsort(token, kind="stable")
            token, mark = token[order], mark[order]
            third = np.zeros(len(token), bool)
            third[2:] = token[2:] == token[:-2]
            own, n = np.unique(mark[third], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token[~third], own])), pa.array(np.concatenate([mark[~third], own])),
                                              pa.array(np.concatenate([np.zeros(int((~third).sum()), np.int64), n.astype(np.int64)]))], names=["token", "mark", "n"])
    return run


def _whole(bits: np.ndarray):
    """``(key, n, shingles)`` of the classes whose mark is in the filter, once a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            for s in shingle_sets(batch.column(0).to_pylist()):
                key = _class_key(s)
                if key is not None:
                    at = _mark(key) % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1:
                        found[key] = s
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found.values()])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([len(s) for s in found.values()], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "n", "shingles"])
    return run


def promising(texts: DataFrame, classes: DataFrame, sample: float = SAMPLE) -> DataFrame:
    """Keys of the classes that may have a partner, by counting a consistent sample of all shingles.

    A set with a partner lacks at most n - T of its shingles there, so of its
    counted ones all but that many come in another class. Counts may be too
    high (equal sets of several batches), never too low.
    """
    postings = texts.mapInArrow(_sample(sample), "token long, mark long, n long")
    same = Window.partitionBy("token")
    shared = (postings.withColumns({"_low": F.min("mark").over(same), "_high": F.max("mark").over(same)})
              .groupBy("mark").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise((F.col("_low") != F.col("_high")).cast("long"))).alias("shared")))
    missing = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    known = classes.select("key", "n", "judged", F.col("mark").alias("_mark")).join(shared, F.col("_mark") == F.col("mark"), "left")
    return known.filter(F.coalesce("shared", F.lit(0)) >= F.col("judged") - missing).select("key", F.col("_mark").alias("mark"))


def filter_bits(marks: DataFrame) -> np.ndarray:
    """Filter of marks: as many bits whatever the number of marks, gathered as at most ``FILTER_BITS / 64`` words."""
    at = marks.select(F.pmod("mark", F.lit(FILTER_BITS)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """``(token, cid)``: of each set as many of its rarest shingles as it may miss in a partner and one more, those that another set holds.

    Rarity, then the hash, is one order for all sets, so partners share a row.
    """
    postings = sets.select("cid", F.explode("shingles").alias("token"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    held = postings.join(often, "token")
    own = Window.partitionBy("cid")
    ranked = held.withColumns({"_place": F.row_number().over(own.orderBy("rows", "token")), "_held": F.count(F.lit(1)).over(own)}).join(sets.select("cid", "n"), "cid")
    alone = F.col("n") - F.col("_held")
    return ranked.filter(F.col("_place") + alone <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("token", "cid")


class Index:
    """Inverted lists over sets, whose members go by size; a T-occurrence search after DivideSkip.

    The longest lists of a query are set aside, the short ones are merged on a
    heap. A member that comes in enough short lists is looked up in the long
    ones by binary search, as long as it can still reach the overlap.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sizes = [ids[i] for i in order], [len(sets[i]) for i in order]
        tokens = np.concatenate([np.zeros(0, np.int64), *[sets[i] for i in order]])
        members = np.repeat(np.arange(len(order)), self.sizes)
        by_token = np.argsort(tokens, kind="stable")
        self.members = members[by_token].tolist()
        self.tokens, starts = np.unique(tokens[by_token], return_index=True)
        self.starts = np.append(starts, len(tokens)).tolist()

    def search(self, query: np.ndarray, skip=lambda member: False) -> Iterator[int]:
        """Members that share enough with the query; ``skip`` leaves out members before they are looked up."""
        size, least = len(query), least_overlap(len(query))
        first, last = bisect_left(self.sizes, least), bisect_left(self.sizes, size * 100 // PERCENT + 1)
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)][self.tokens[at[at < len(self.tokens)]] == query[at < len(self.tokens)]]
        lists = []
        for t in at.tolist():
            a, b = self.starts[t], self.starts[t + 1]
            a, b = bisect_left(self.members, first, a, b), bisect_left(self.members, last, a, b)
            if a < b:
                lists.append((b - a, a, b))
        if len(lists) < least:
            return
        lists.sort(reverse=True)
        long = min(least - 1, int(least / (MU * log2(lists[0][0] + 1) + 1)))
        merged = heapq.merge(*[self.members[a:b] for _, a, b in lists[long:]])
        for member, places in groupby(merged):
            found = sum(1 for _ in places)
            if found < least - long or skip(member):
                continue
            need = pair_overlap(size, self.sizes[member])
            for k, (_, a, b) in enumerate(lists[:long]):
                if found >= need or found + long - k < need:
                    break
                i = bisect_left(self.members, member, a, b)
                found += i < b and self.members[i] == member
            if found >= need:
                yield member


def _search_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's queries with members of other components, as few as unite what belongs together."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = rows[~rows["query"]]
    component = dict(zip(rows["cid"].tolist(), rows["component"].tolist()))
    index = Index(held["cid"].tolist(), held["shingles"].tolist())
    links = []
    asked = rows[rows["query"]].sort_values("cid")
    for cid, shingles in zip(asked["cid"].tolist(), asked["shingles"]):
        for member in index.search(shingles, lambda m: root(component[index.ids[m]]) == root(component[cid])):
            a, b = sorted((root(component[cid]), root(component[index.ids[member]])))
            if a != b:
                parent[b] = a
                links.append((cid, index.ids[member]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _pieces(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def block_links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)`` links between sets of a block; ``blocks`` holds block, cid, component and asked: queries meet all members.

    A block of more members or queries than fit a task is cut: every piece of
    its queries meets every piece of its members.
    """
    sized = blocks.join(sets.select("cid", "n"), "cid")
    asks = F.col("asked").cast("long")
    pieces = sized.groupBy("block").agg(_pieces(F.count(F.lit(1)), F.sum("n")).alias("members"), _pieces(F.sum(asks), F.sum(asks * F.col("n"))).alias("queries"))
    cut = blocks.join(pieces, "block")

    def piece(of: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(of).cast("long")).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    members = cut.select("block", "cid", "component", piece("members", 1).alias("i"), every("queries").alias("j"), F.lit(False).alias("query"))
    queries = cut.filter("asked").select("block", "cid", "component", every("members").alias("i"), piece("queries", 2).alias("j"), F.lit(True).alias("query"))
    dealt = members.unionByName(queries).join(sets.select("cid", "shingles"), "cid")
    return dealt.groupBy("block", "i", "j").applyInPandas(_search_block, "a long, b long")


def linked(sets: DataFrame) -> DataFrame:
    """``(node, label)`` of all sets that have a partner; ``sets`` is a written table of cid, n and shingles.

    Sets that share a rarest shingle with the smallest of its list form a block
    around that set. First each block's smallest set alone is searched, which
    unites most of a group of near copies with one query. Then the lists that
    still hold several components make blocks again, in which all members
    outside the largest component are queries.
    """
    prefixes = materialize(shared_prefixes(sets), "prefixes")
    lists = prefixes.groupBy("token").agg(F.min("cid").alias("block"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    stars = materialize(prefixes.join(lists, "token").select("block", "cid").distinct(), "stars")
    near = materialize(block_links(stars.select("block", "cid", F.col("cid").alias("component"), (F.col("block") == F.col("cid")).alias("asked")), sets), "links")
    label = F.coalesce("label", "cid").alias("component")
    found = prefixes.join(components(near, "a", "b"), F.col("cid") == F.col("node"), "left").select("token", "cid", label)
    found = materialize(found, "found")
    several = found.groupBy("token").agg(F.min("cid").alias("block"), F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high")
    blocks = materialize(found.join(several, "token").select("block", "cid", "component").distinct(), "blocks")
    largest = (blocks.groupBy("block", "component").agg(F.count(F.lit(1)).alias("_rows")).groupBy("block")
               .agg(F.max_by("component", F.struct("_rows", "component")).alias("_largest")))
    asked = blocks.join(largest, "block").select("block", "cid", "component", (F.col("component") != F.col("_largest")).alias("asked"))
    rest = materialize(block_links(asked, sets), "links")
    return components(near.unionByName(rest), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two rows are linked if their sets share ``PERCENT`` of their union; equal
    sets meet by a 128-bit digest first. component_id is the smallest id that
    links reach, the row's own included; null ids do not count, a component
    without any has a null one. Null, empty and blank texts have no shingle and
    are linked with nothing. Shingles are compared by 64-bit hashes. Repeated
    rows stay; other columns of the input, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    texts = rows.select("_text")
    columns = [("n", T.LongType()), ("key", T.BinaryType()), ("mark", T.LongType()), ("judged", T.LongType())]
    described = materialize(rows.mapInArrow(_describe(SAMPLE), T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in columns]])), "described")
    classes = materialize(described.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("_first"), *[F.first(c).alias(c) for c in ("n", "mark", "judged")]), "classes")
    kept = materialize(promising(texts, classes), "promising")
    whole = texts.mapInArrow(_whole(filter_bits(kept)), "key binary, n long, shingles array<long>")
    sets = whole.join(kept.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("cid", F.monotonically_increasing_id())
    sets = materialize(sets, "sets")
    parts = linked(sets.select("cid", "n", "shingles")).join(sets.select("cid", "key"), F.col("node") == F.col("cid")).select("label", "key")
    by_class = materialize(classes.join(parts, "key", "left").select("key", "_first", "label"), "labels")
    least = by_class.filter("label is not null").groupBy("label").agg(F.min("_first").alias("_least"))
    by_class = by_class.join(least, "label", "left").select("key", F.when(F.col("label").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("component_id"))
    some = described.filter("n > 0").join(by_class, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(described.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
