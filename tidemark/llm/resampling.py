"""Importance resampling: documents likely under a target model rather than the raw one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import unit
from tidemark.session import materialize

#: Hash buckets of n-grams, and added count of every bucket.
BUCKETS, SMOOTH = 1 << 14, 1.0
#: Most labelled documents that the target model is fitted on, chosen by a hash of their id: 8 bytes each are broadcast.
TARGET_ROWS = 50_000
#: Bytes hashed at once; longer texts are cut between words, without changing a count.
CHUNK = 1 << 20

#: Odd multipliers of the hashes: any odd numbers do.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 1 << 64)
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def ngram_buckets(raw: np.ndarray, ends_at: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the 3-byte grams, words and pairs of words of some bytes.

    A word's hash is a difference of running sums, so no word is looped over.
    Words keep their case and signs. Two choices are made for both models alike:
    digits share one code, since numbers are too many to be learned one by one,
    and a word said twice running is one event whatever the word, since its
    buckets would otherwise be as many as the words. Texts that lie side by side
    end at ``ends_at`` (the last one too): no n-gram crosses an end.
    """
    codes = raw.astype(np.uint64)
    codes[(raw >= 48) & (raw <= 57)] = 48
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if ends_at is not None:
        # A word that runs on into the next text is cut there.
        inner = np.unique(ends_at[(ends_at > 0) & (ends_at < len(raw))])
        inner = inner[~space[inner - 1] & ~space[inner]]
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    up, down = _powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX
    # A word said twice running is one event, whatever the word.
    pairs = np.where(hashes[:-1] == hashes[1:], MIX, (hashes[:-1] * BASE + hashes[1:]) * MIX)
    grams = (codes[:-2] * np.uint64(65536) + codes[1:-1] * np.uint64(256) + codes[2:]) * BASE + np.uint64(1)
    if ends_at is not None:
        text_of = np.searchsorted(ends_at, starts, "right")
        pairs = pairs[text_of[:-1] == text_of[1:]]
        whole = np.ones(len(grams), bool)
        for back in (1, 2):
            first = ends_at - back
            whole[first[(first >= 0) & (first < len(grams))]] = False
        grams = grams[whole]
    every = np.concatenate([hashes, pairs, grams * MIX])
    return (every >> np.uint64(40)).astype(np.int64) % BUCKETS


def long_parts(text: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """``(bytes, sign)``: the counts of these parts, added and taken off, are those of the whole text.

    A text is cut at starts of words, every part but the first begins with the
    word before its cut, and that word (with its blanks) is taken off once. So
    words, pairs and byte grams at a cut count once, wherever it falls. A word
    is never cut, however long.
    """
    raw = np.frombuffer(text, np.uint8)
    heads, start, cut = np.zeros(0, np.int64), 0, 0
    if len(raw) > CHUNK:
        blank = (raw == 32) | (raw >= 9) & (raw <= 13)
        heads = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    while len(raw) - start > CHUNK:
        k = int(np.searchsorted(heads, max(start + CHUNK, cut + 1)))
        if k >= len(heads):
            break
        cut = int(heads[k])
        yield raw[start:cut], 1
        # The last word before the cut: where the text starts, if there is none.
        start = int(heads[k - 1]) if k else 0
        yield raw[start:cut], -1
    yield raw[start:], 1


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of a whole text, a part at a time if it is very long."""
    out = np.zeros(BUCKETS, np.int64)
    for part, sign in long_parts(text):
        out += sign * np.bincount(ngram_buckets(part), minlength=BUCKETS)
    return out


def summed_counts(texts: Iterable[bytes]) -> np.ndarray:
    """Sum of the counts of every text, in any order and grouping: short texts are hashed side by side, parted only between texts."""
    out, held, size = np.zeros(BUCKETS, np.int64), [], 0

    def add() -> None:
        nonlocal out
        if held:
            out += np.bincount(ngram_buckets(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])), minlength=BUCKETS)
    for text in texts:
        if len(text) >= CHUNK:
            out += gram_counts(text)
            continue
        if size + len(text) > CHUNK:
            add()
            held, size = [], 0
        held.append(text)
        size += len(text)
    add()
    return out


def corpus_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts and of the target's. Every text is counted; each task sends one row a bucket at most."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for good in (True, False):
                grams = summed_counts(batch["text"][batch["is_target"] == good])
                raw += grams
                if good:
                    target += grams
        held = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": held, "raw": raw[held], "target": target[held]})
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "raw", "target")])
    sums = rows.select("text", "is_target").mapInPandas(count, schema).groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for bucket, a, b in sums.collect():
        raw[bucket], target[bucket] = a, b
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target model over the raw model for each bucket."""
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def largest(rows: DataFrame, key: str, order: str, k: int, bins: int = 1024) -> DataFrame:
    """Adds ``chosen``: true for the ``k`` rows of largest ``key`` (ties by ``order``).

    The border is narrowed by histograms of at most ``bins`` counts; only the rows
    of the last bin are sorted. ``rows`` is read once a round, so it should be written.
    Many rows of one key are told apart by a hash of ``order``; rows that share
    that too (repeated ids) are alike, and as many as are due are counted off.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if k <= 0 or n == 0:
        return rows.withColumn("chosen", F.lit(False))
    if k >= n:
        return rows.withColumn("chosen", F.lit(True))
    above, inside = 0, n
    while inside > 4096 and high > low:
        width = (high - low) / bins
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1)).cast("int")
        held = rows.filter((F.col(key) >= low) & (F.col(key) <= high)).groupBy(place.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("b")).collect()
        for bin_ in held:
            if above + bin_["n"] >= k:
                break
            above += bin_["n"]
        inside, stuck = bin_["n"], (bin_["low"], bin_["high"]) == (low, high)
        low, high = bin_["low"], bin_["high"]
        if stuck:
            break
    border = rows.filter((F.col(key) >= low) & (F.col(key) <= high))
    if inside <= 4096:
        nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), order))
        chosen = border.withColumn("chosen", nth <= k - above)
    elif key != "_tie":
        tied = materialize(border.withColumn("_tie", unit(F.col(order))), "ties")
        chosen = largest(tied, "_tie", order, k - above, bins).drop("_tie")
    else:
        chosen = counted_off(border, k - above)
    return (rows.filter(F.col(key) > high).withColumn("chosen", F.lit(True)).unionByName(chosen)
            .unionByName(rows.filter(F.col(key) < low).withColumn("chosen", F.lit(False))))


def counted_off(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``chosen``: true for any ``k`` rows, by the counts of parts, so that no task sees more than a part."""
    parts = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "parts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return parts.join(starts, "_part").withColumn("chosen", nth <= k).drop("_part", "_at", "_before")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, weight_per_gram, key and kept of every document.

    The target model counts hashed n-grams of at most ``target_rows`` documents
    labelled 1, the raw model those of all documents. A document's log weight is the sum of its
    n-grams' log ratios. Adding Gumbel noise, fixed by the id, and taking the
    largest keys samples without replacement in proportion to the weights.
    ``share`` of the documents is taken; left out, the share of ones among the labels.

    Ids labelled more than once count as 1 if any label is 1. Null and blank
    texts have no n-grams and log weight 0. Without a label 1 all weights are 0.
    """
    names = materialize(labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_label")).filter("_label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("_label").alias("_label")), "labels")
    good, known = names.agg(F.coalesce(F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)), F.lit(0)), F.count(F.lit(1))).first()
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    fit = names.filter("_label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).select("doc_id", F.lit(True).alias("_good"))
    marked = rows.join(F.broadcast(fit), "doc_id", "left").select("text", F.col("_good").isNotNull().alias("is_target"))
    raw, target = corpus_counts(marked)
    ratios = log_ratios(raw, target) if good else np.zeros(BUCKETS)

    @F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("n", T.LongType())]))
    def weigh(texts: pd.Series) -> pd.DataFrame:
        totals, sizes = [], []
        for item in texts:
            total = size = 0
            for part, sign in long_parts(item):
                found = ngram_buckets(part)
                total, size = total + sign * float(ratios[found].sum()), size + sign * len(found)
            totals.append(total)
            sizes.append(size)
        return pd.DataFrame({"w": np.array(totals, float), "n": np.array(sizes, np.int64)})

    gumbel = -F.log(-F.log(unit(F.col("doc_id"), F.lit("gumbel"))))
    scored = rows.select("doc_id", weigh("text").alias("_w")).select(
        "doc_id", F.col("_w.w").alias("log_weight"), F.when(F.col("_w.n") > 0, F.col("_w.w") / F.col("_w.n")).otherwise(0.0).alias("weight_per_gram"),
        (F.col("_w.w") + gumbel).alias("key"))
    scored = materialize(scored, "weights")
    take = share if share is not None else (good / known if known else 1.0)
    return largest(scored, "key", "doc_id", round(take * scored.count())).withColumnRenamed("chosen", "kept")
