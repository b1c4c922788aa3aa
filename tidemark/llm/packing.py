"""Packing tokenised documents into sequences by a linear grouping scheme."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import numbered
from tidemark.session import materialize

#: Tokens of a sequence, id that ends a document, and the two files of one public vocabulary.
CAPACITY, END_ID = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Groups of large pieces; pieces of at most a quarter of a sequence are small.
GROUPS, SMALL_PART = 64, 4
#: Rounds of the configuration programme; it may be left early, since any of its bases is a packing.
ROUNDS = 3000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])

#: Characters whose class is the same in every Unicode version, so that both tokenizers split them alike.
PLAIN = re.compile(r"[\t\n\x20-\x7e¡-ɏ‐-‧]*\Z")


@lru_cache(4)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(4)
def _ranks(name: str):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> np.ndarray:
    """Ids of a text without special tokens.

    Texts of plain characters go through the same vocabulary in its rank form,
    which gives the same ids in a fifth of the time; any other text, and one that
    spells a special token, goes through the tokenizer file itself.
    """
    if PLAIN.match(text) and "<|" not in text:
        return np.array(_ranks(ranks).encode_ordinary(text), np.uint32)
    return np.array(_tokenizer(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: only what is longer than a sequence is cut, and only its first piece may be shorter."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str = TOKENIZER, ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and checksum of every piece of every whole text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(token_ids(text or "", tokenizer, ranks), np.uint32(end_id)).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            frame = pd.DataFrame(out, columns=PIECES.names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, PIECES)


@lru_cache(2)
def configurations(sizes: tuple[int, ...], demand: tuple[int, ...], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of packing ``demand`` items of few ``sizes``: configurations and how often each is used.

    Starts from one size a sequence. Each round a knapsack over the current
    prices finds the configuration worth most; one worth more than a sequence
    enters the basis and the one it drives out leaves.
    """
    n, sizes, demand = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, np.ones(n))
        worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        smallest = int(sizes.min())
        for room in range(smallest, capacity + 1):
            value = np.where(sizes <= room, worth[room - np.minimum(sizes, room)] + prices, -1.0)
            best = int(value.argmax())
            if value[best] > worth[room - 1] + 1e-12:
                worth[room], chosen[room] = value[best], best
            else:
                worth[room] = worth[room - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        entering, room = np.zeros(n), capacity
        while room >= smallest:
            if chosen[room] < 0:
                room -= 1
                continue
            entering[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
        change = np.linalg.solve(basis, entering)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * change, 0)
        basis[:, out], amount[out] = entering, step
    return [(basis[:, k].astype(int), float(amount[k])) for k in range(n) if amount[k] > 0]


class Plan:
    """A packing of piece counts: runs of pieces of one length and the sequences they fill.

    A run says that ranks ``rank`` .. of a length go, ``each`` to a sequence, into
    consecutive sequences from ``sequence`` on, at ``offset``. Sequences that are
    filled alike are handled together, so the work depends on the number of
    lengths, not on the number of pieces.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
        self.sequences = 0

    def fill(self, first: int, many: int, room: int, length: int, each: int) -> int:
        """Puts ``each`` pieces of ``length`` into every one of ``many`` sequences; returns the room left."""
        self.runs.append((length, int(self.used[length]), first, each, self.capacity - room))
        self.used[length] += many * each
        self.left[length] -= many * each
        return room - length * each

    def opened(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def keep(self, first: int, many: int, room: int) -> None:
        if many and room:
            self.open[room].append((first, many))

    def best_fit(self, length: int) -> None:
        """All pieces left of a length, each into the fullest sequence it fits, new ones when none is left."""
        while self.left[length]:
            room = next((r for r in range(length, self.capacity) if self.open.get(r)), None)
            if room is None:
                first, many, room = self.opened(1), 1, self.capacity
                more = max(0, int(self.left[length]) // (self.capacity // length) - 1)
                self.opened(more)
                many += more
            else:
                first, many = self.open[room].pop()
            each = room // length
            whole = min(many, int(self.left[length]) // each)
            if whole:
                self.keep(first, whole, self.fill(first, whole, room, length, each))
            if whole < many and 0 < self.left[length] < each:
                self.keep(first + whole, 1, self.fill(first + whole, 1, room, length, int(self.left[length])))
                whole += 1
            self.keep(first + whole, many - whole, room)

    def grouped(self, groups: int, small: int, spare: int) -> None:
        """Large pieces: equal groups by length, each rounded up to its longest, packed by configurations, then the actual pieces put in place.

        The ``spare`` shortest pieces of a configuration are left out: best fit
        then chooses them by their real lengths and uses what rounding up lost.
        """
        lengths = np.arange(self.capacity - 1, small, -1)
        total = int(self.left[lengths].sum())
        if not total:
            return
        share = -(-total // groups)
        queues, queue, room = [], [], share
        for length in lengths:
            have = int(self.left[length])
            while have:
                took = min(have, room)
                queue.append([int(length), took])
                have, room = have - took, room - took
                if not room:
                    queues.append(queue)
                    queue, room = [], share
        if queue:
            queues.append(queue)
        sizes, demand = tuple(q[0][0] for q in queues), tuple(sum(n for _, n in q) for q in queues)
        for config, amount in configurations(sizes, demand, self.capacity):
            many = int(amount + 1e-9)
            if not many:
                continue
            first = self.opened(many)
            parts = [(first, many, self.capacity)]
            slots = np.repeat(np.arange(len(config)), config)
            for g in slots[:max(1, len(slots) - spare)]:
                after = []
                for start, width, space in parts:
                    while width and queues[g]:
                        length, have = queues[g][-1]
                        took = min(width, have)
                        after.append((start, took, self.fill(start, took, space, length, 1)))
                        start, width = start + took, width - took
                        queues[g][-1][1] -= took
                        if not queues[g][-1][1]:
                            queues[g].pop()
                    if width:
                        after.append((start, width, space))
                parts = after
            for part in parts:
                self.keep(*part)


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> Plan:
    """Packs ``counts[length]`` pieces: full ones alone, large ones by groups and configurations, what is left and small ones by best fit.

    Whole configurations and configurations without their shortest piece are both tried; the fewer sequences win.
    """
    tried = []
    for spare in (1, 0):
        out = Plan(counts, capacity)
        if out.left[capacity]:
            first = out.opened(int(out.left[capacity]))
            out.fill(first, int(out.left[capacity]), capacity, capacity, 1)
        out.grouped(groups, capacity // small_part, spare)
        for length in range(capacity - 1, 0, -1):
            out.best_fit(length)
        tried.append(out)
    return min(tried, key=lambda p: p.sequences)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Only the number of pieces of each length, at most ``capacity`` numbers, goes
    to the driver, which plans with it. Pieces get a rank within their length,
    and rank and plan give place: no sequence, length or document is ever
    gathered. Null texts are empty and hold the end id alone; rows that repeat
    an id are packed each; other columns, whatever their names, are not read.
    """
    cut = materialize(pieces(docs, id_col, text_col, capacity, tokenizer, ranks, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    runs = np.array(sorted(plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    at = runs[:, 0] << 44 | runs[:, 1]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.IntegerType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(at, n << 44 | r, side="right") - 1]
        nth = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": (run[:, 4] + nth % run[:, 3] * n).astype(np.int32)})

    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32"], "_nth", buckets=4096)
    return ranked.withColumn("_at", place("length", "_nth")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "_at.sequence_id", F.col("_at.offset").cast("long").alias("offset"))
