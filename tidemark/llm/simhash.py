"""Near duplicates: SimHash fingerprints that meet in Golay-code keys and are verified there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import HANDLE, components, handles, rows_of
from tidemark.session import materialize

#: Words of a shingle, seed of the shingle hash, bits in which linked fingerprints may differ.
SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: The binary Golay code has 23-bit words, 12 of them message bits, and this generator polynomial.
GOLAY_BITS, CHECK_BITS, GENERATOR = 23, 11, 0b101011100011
#: Segments of a fingerprint, lowest bits first; none is longer than a code word.
SEGMENTS = (22, 21, 21)
#: Shingles hashed at once, so that memory is bounded whatever a text's length.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the word shingles: a bit is set if it is set in over half the shingles' hashes.

    Letters A-Z count as lower case. Fewer words than a shingle has make one
    shingle; null and blank texts have fingerprint zero.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    size = min(SHINGLE_WORDS, len(tokens))
    last = len(tokens) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, last, CHUNK):
        end = min(start + CHUNK, last)
        parts = zip(*[tokens[start + k:end + k] for k in range(size)])
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64, end - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits, and for each of the 2048 remainders the one error pattern of at most three bits."""
    bits = np.zeros(GOLAY_BITS, np.int64)
    for i in range(GOLAY_BITS):
        value = 1 << i
        for shift in range(i - CHECK_BITS, -1, -1):
            if value >> (shift + CHECK_BITS) & 1:
                value ^= GENERATOR << shift
        bits[i] = value
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for a in range(GOLAY_BITS):
        for b in range(a, GOLAY_BITS):
            for c in range(b, GOLAY_BITS):
                chosen = {a, b, c}
                errors[np.bitwise_xor.reduce(bits[list(chosen)])] = sum(1 << i for i in chosen)
    errors[0] = 0
    return bits, errors


def codewords(values: np.ndarray) -> np.ndarray:
    """Index of the code word nearest to each 23-bit value (the code is perfect: one lies within three bits)."""
    bits, errors = _decoder()
    rest = np.zeros(values.shape, np.int64)
    for i in range(GOLAY_BITS):
        rest ^= np.where(values >> i & 1, bits[i], 0)
    return (values ^ errors[rest]) >> CHECK_BITS


def golay_keys(prints: np.ndarray) -> list[np.ndarray]:
    """Blocking keys of each fingerprint.

    Two fingerprints at most two bits apart agree on one of three segments, and
    on another they are at most two bits apart: then some value is within one
    bit of both, and the code word of that value is an index of both. So a key
    is a segment as it is and one index of the next segment, an index being the
    code word of the segment or of one of its one-bit neighbours. A segment
    three bits off its code word has six indices, a nearer one has one.
    """
    values, segments = prints.view(np.uint64), []
    shift = 0
    for width in SEGMENTS:
        segments.append((values >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    keys = []
    for k, exact in enumerate(segments):
        j = (k + 1) % len(SEGMENTS)
        flips = np.array([0, *(1 << i for i in range(SEGMENTS[j]))], np.int64)
        indices = codewords(segments[j][:, None] ^ flips[None, :])
        keys.append((k << 34 | exact << 12)[:, None] | indices)
    return [np.unique(row) for row in np.concatenate(keys, axis=1)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(prints: pd.Series) -> pd.Series:
    return pd.Series(golay_keys(prints.to_numpy(np.int64)))


def meeting_words(prints: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """For each fingerprint and one of its keys: the words at most one bit away that lead to this key.

    A word is the fingerprint with one bit of the two open segments flipped, or
    none; its key is that of its next segment's code word. Fingerprints of a key
    that share a word differ in at most two bits, and two that differ in at most
    two bits share a word, and with it the key the word leads to.
    """
    shifts = [sum(SEGMENTS[:k]) for k in range(len(SEGMENTS))]
    values, kinds, indices = prints.view(np.uint64), keys >> 34, keys & (1 << GOLAY_BITS - CHECK_BITS) - 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(prints)
    for k in range(len(SEGMENTS)):
        rows = np.flatnonzero(kinds == k)
        near, far = (k + 1) % len(SEGMENTS), (k + 2) % len(SEGMENTS)
        segment = (values[rows] >> np.uint64(shifts[near]) & np.uint64((1 << SEGMENTS[near]) - 1)).astype(np.int64)
        flips = np.array([0, *(1 << i for i in range(SEGMENTS[near]))], np.int64)
        leads = codewords(segment[:, None] ^ flips[None, :]) == indices[rows][:, None]
        # A flip in the other open segment leaves the next one, and so the key, as it is.
        leads = np.concatenate([leads, np.repeat(leads[:, :1], SEGMENTS[far], axis=1)], axis=1)
        bits = [0, *(1 << shifts[near] + i for i in range(SEGMENTS[near])), *(1 << shifts[far] + i for i in range(SEGMENTS[far]))]
        words = (values[rows][:, None] ^ np.array(bits, np.uint64)[None, :]).view(np.int64)
        for row, word, held in zip(rows, words, leads):
            out[row] = word[held]
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _words(prints: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series(meeting_words(prints.to_numpy(np.int64), keys.to_numpy(np.int64)))


def links(prints: DataFrame) -> DataFrame:
    """``(fp, hub)`` links that connect what the two-bit rule connects; ``prints`` holds distinct fingerprints as ``fp``.

    Fingerprints meet in the keys they share, and are verified there: a member of
    a shared key goes on with the words that lead to this key, and those that
    share key and word differ in at most two bits. All keys of a fingerprint
    together have 131 words at most, and at most 65 fingerprints share one, so a
    group of near copies of any size costs rows a member, never its pairs.
    """
    keyed = materialize(prints.select("fp", F.explode(_keys("fp")).alias("key")), "keys")
    shared = materialize(keyed.groupBy("key").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).filter("_a <> _b").select("key"), "shared")
    members = keyed.join(shared, "key", "left_semi")
    met = members.select("key", "fp", F.explode(_words("fp", "key")).alias("word"))
    return (met.withColumn("hub", F.min("fp").over(Window.partitionBy("key", "word")))
            .filter("fp <> hub").select("fp", "hub").distinct())


def components_of(rows: DataFrame) -> DataFrame:
    """Adds ``root`` and ``component_id``, the smallest id reachable over links, to written rows that hold ``doc_id`` and ``fp``.

    Copies meet by fingerprint first; keys and links are made for distinct
    fingerprints only. A component without any id has a null one. Empty texts
    have fingerprint zero and link like any other.
    """
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")), "distinct")
    parts = components(links(distinct.select("fp")), "fp", "hub")
    tagged = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "_first", F.coalesce("label", "fp").alias("root"))
    tagged = materialize(tagged, "roots")
    least = materialize(tagged.groupBy("root").agg(F.min("_first").alias("component_id")), "least")
    by_print = materialize(tagged.join(least, "root").select("fp", "root", "component_id"), "parts")
    return rows.join(by_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows stay, each with the same component; null ids do not count for
    it, a component without any id has a null one. Other columns, whatever their
    names, are not read.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col).cast("binary")).alias("fp")), "prints")
    return components_of(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of its smallest id (rows without id last), with its columns as they were."""
    known = handles(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id", "_text")
    rows = materialize(known.select("doc_id", *HANDLE, fingerprints(F.col("_text").cast("binary")).alias("fp")), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *HANDLE))
    stay = components_of(rows).groupBy("root").agg(best.alias("_best")).select(*[F.col(f"_best.{c}").alias(c) for c in HANDLE])
    return rows_of(docs, stay, id_col, text_col)
