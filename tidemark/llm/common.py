"""Helpers the text operators share: words, gapless numbers, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Words are runs of anything but these six characters.
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of words; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of words: word ends are counted, so no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*key: Column) -> Column:
    """Uniform number strictly between 0 and 1, the same on every rerun and in SQL (52 bits of an MD5)."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("\0")) for k in key])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def numbered(df: DataFrame, group: str, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within each group, in no task a whole group.

    Rows of a group are dealt into hash buckets of ``order``; a table of bucket
    sizes (at most groups x buckets rows) gives each bucket its first number and
    only the rows of one bucket are sorted together.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within))
    return (ranked.join(first, [group, "_bucket"])
            .withColumn(name, (F.col("_first") + F.col("_rank") - 1).cast("long"))
            .drop("_bucket", "_first", "_rank"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node of an undirected edge table; the label is
    the smallest node of its component.

    Each round takes the smallest neighbouring label, hooks whole labels onto
    the smallest one any of their nodes saw and follows that hook once, so the
    number of rounds grows with the logarithm of a component's diameter. Rounds
    are written tables: a lost executor costs one round, and joins on a hub are
    joins of plain scans, which adaptive execution can split.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("_near"))
                         .select(F.col("u").alias("node"), F.least("u", "_near").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("_near")))
        seen = materialize(labels.join(near, F.col("node") == F.col("u"))
                           .select("node", "label", F.least("label", "_near").alias("_low")), "seen")
        if seen.filter("_low < label").isEmpty():
            return labels
        hooks = materialize(seen.groupBy(F.col("label").alias("_old")).agg(F.min("_low").alias("_hook")), "hooks")
        labels = materialize(seen.join(hooks, F.col("_low") == F.col("_old"))
                             .select("node", F.least("_low", "_hook").alias("label")), "labels")


#: What a row is known by while its text stays behind.
HANDLE = ["_rid", "_fp"]


def handles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds a row's handle: its id as text (null apart from every id) and a hash of its text (null as empty)."""
    known = F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_col).cast("string")))
    return docs.withColumns({"_rid": known, "_fp": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def rows_of(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose handle is in ``stay``, one for each, with their columns as they were."""
    packed = handles(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), f"_row.{id_col}", f"_row.{text_col}")
    joined = packed.join(stay, HANDLE, "left_semi")
    first = joined.withColumn("_nth", F.row_number().over(Window.partitionBy(*HANDLE).orderBy("_rid"))).filter("_nth = 1")
    return first.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
