"""Exact duplicates by naming blocks, then pairs of names, with integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HANDLE, handles, rows_of
from tidemark.session import materialize

#: Characters of a block, buckets of names, and parts a frequent value is spread over.
BLOCK_CHARS, BUCKETS, SALTS = 4096, 65536, 64
#: A value is frequent from this many rows on, and from a thousandth of all rows on: there are a thousand such values at most.
FREQUENT, SHARE = 1000, 1000


def frequent_hashes(rows: DataFrame, hash_col: str) -> list[int]:
    """Hashes that at least ``FREQUENT`` rows and a thousandth of all rows share; so never more than a thousand."""
    counts = materialize(rows.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_n")), "frequent")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(FREQUENT, total // SHARE)
    return [r[0] for r in counts.filter(F.col("_n") >= least).select(hash_col).collect()]


def named(rows: DataFrame, key: list[str], name: str, spread: list[str]) -> DataFrame:
    """Gives equal ``key`` values one integer and different ones different integers.

    Values are dealt into hash buckets and sorted there; a value's name is made
    of its place in its bucket and the bucket, so no two values share one and
    no global order is needed. Frequent values, of which there are a bounded
    number, are first sorted inside each of their salts, drawn from ``spread``;
    one row for each salt and value goes on to the second sort.
    """
    dealt = rows.withColumn("_hash", F.xxhash64(*key)).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    hot = frequent_hashes(dealt, "_hash")
    plain = [c for c in rows.columns if c not in key]

    def numbers(frame, parity):
        place = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*key)).cast("long")
        return frame.withColumn(name, (place * BUCKETS + F.col("_bucket")) * 2 + parity)

    rare = numbers(dealt.filter(~F.col("_hash").isin(hot)) if hot else dealt, 0).select(*plain, name)
    if not hot:
        return rare
    inside = Window.partitionBy("_bucket", "_salt").orderBy(*key)
    salted = (dealt.filter(F.col("_hash").isin(hot)).withColumn("_salt", F.pmod(F.xxhash64(*spread, F.lit(1)), F.lit(SALTS)).cast("int"))
              .withColumn("_local", F.dense_rank().over(inside)).withColumn("_new", F.lag("_local", 1, 0).over(inside) != F.col("_local")))
    # Read twice, so written once; only first rows carry their value.
    local = materialize(salted.select(*plain, *[F.when(F.col("_new"), F.col(k)).alias(k) for k in key], "_bucket", "_salt", "_local", "_new"), "names")
    at = ["_bucket", "_salt", "_local"]
    names = numbers(local.filter("_new"), 1).select(*at, name)
    return rare.unionByName(local.join(names, at).select(*plain, name))


def identities(docs: DataFrame, row: list[str], text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(*row, level, name)``: two rows share level and name exactly if their texts are equal.

    Level 0 names blocks of ``block_chars`` characters. Each further level names
    adjacent pairs (a last single one pairs with 0), until a text has one name; there
    are as many levels as the logarithm of the longest text's blocks. Texts that
    are done leave the rounds. Rows that repeat ``row`` must have equal texts.
    """
    count = F.greatest(F.ceil(F.length(text) / block_chars).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(text), i * block_chars + 1, F.lit(block_chars)))
    blocks = docs.select(*row, count.alias("_blocks"), F.posexplode(cut).alias("_pos", "_block"))
    rows, level, done = named(blocks, ["_block"], "_name", row), 0, None
    while True:
        rows = materialize(rows, "level")
        ended = rows.filter("_blocks = 1").select(*row, F.lit(level).alias("level"), F.col("_name").alias("name"))
        done = ended if done is None else done.unionByName(ended)
        rest = rows.filter("_blocks > 1")
        if rest.isEmpty():
            return done
        half = F.col("_pos") % 2
        pairs = rest.groupBy(*row, F.floor(F.col("_pos") / 2).cast("int").alias("_pos"), F.ceil(F.col("_blocks") / 2).cast("int").alias("_blocks")).agg(
            F.max(F.when(half == 0, F.col("_name"))).alias("_left"), F.coalesce(F.max(F.when(half == 1, F.col("_name"))), F.lit(0)).alias("_right"))
        rows, level = named(pairs, ["_left", "_right"], "_name", row), level + 1


def verdicts(docs: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(_rid, _fp, keep_id, group_size, stays)`` for every distinct row id and text."""
    rows = handles(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", "_text")
    names = identities(rows.select(*HANDLE, "_text"), HANDLE, "_text", block_chars).dropDuplicates(HANDLE)
    copies = rows.groupBy(*HANDLE).agg(F.first("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"))
    tagged = materialize(names.join(copies, HANDLE).withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int")), "identity")
    # Copies meet in two steps, so that a group of any size never meets in one task.
    part = materialize(tagged.groupBy("level", "name", "_salt").agg(
        F.max(F.struct("_id", "_rid")).alias("_best"), F.sum("_copies").alias("_n")), "groups")
    whole = part.groupBy("level", "name").agg(F.max("_best").alias("_best"), F.sum("_n").alias("group_size"))
    by_salt = part.select("level", "name", "_salt").join(whole, ["level", "name"])
    return tagged.join(by_salt, ["level", "name", "_salt"]).select(
        *HANDLE, F.col("_best._id").alias("keep_id"), "group_size", (F.col("_best._rid") == F.col("_rid")).alias("stays"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, dropped ones too.

    Of equal texts the row with the largest id stays (null counts as the
    smallest); of rows that repeat that id and text exactly one stays. A null
    text equals an empty one. Nothing is normalised; other columns of the input,
    whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    slim = handles(rows, "doc_id", "_text").withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256)).drop("_text")
    joined = slim.join(verdicts(docs, id_col, text_col, block_chars), HANDLE)
    return joined.withColumn("_nth", F.row_number().over(Window.partitionBy(*HANDLE).orderBy("text_sha256"))).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("_nth") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that stay, by the rules of ``exact_groups``, with their columns as they were."""
    return rows_of(docs, verdicts(docs, id_col, text_col, block_chars).filter("stays").select(*HANDLE), id_col, text_col)
