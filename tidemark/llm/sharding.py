"""Placement of rows in a weighted tree of regions, racks and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered

#: ``tree[region][rack]`` lists the weights of the rack's shards; shards are numbered in reading order.
Tree = Sequence[Sequence[Sequence[float]]]

EVEN_8: Tree = (((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0)))


def with_new_shard(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own.

    Every other subtree keeps its weight, so every other draw stays as it was
    and rows move only into the new shard.
    """
    return (*tree, ((weight,),))


def _draw(weights: Column, key: Column, *path: Column) -> Column:
    """Child with the shortest exponential waiting time: child i wins with probability weight i over their sum.

    A draw depends on the key, the child's place and its own weight alone. A
    child whose weight grows only wins rows, one whose weight shrinks only loses
    rows, and between two other children nothing moves.
    """
    def wait(weight, i):
        u = (F.shiftrightunsigned(F.xxhash64(key, *path, i), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct(F.when(weight > 0, -F.log(u) / weight).alias("wait"), i.alias("child"))
    return F.array_min(F.filter(F.transform(weights, wait), lambda x: x["wait"].isNotNull()))["child"]


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) if not isinstance(v, (list, tuple)) else _array(v) for v in values])


def place(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Adds ``name``, the shard of each row.

    The descent draws a region by the regions' weights, then a rack of it, then
    a shard of that rack: fan-outs add up, so a thousand shards cost some thirty
    hashes a row. A change of weight moves rows only into or out of the subtrees
    whose weight changed. No row needs another row, so nothing is shuffled.

    A null key is a key like any other; equal keys share a shard. Weights must
    not be negative; a subtree of weight zero gets no rows.
    """
    flat = [w for region in tree for rack in region for w in rack]
    if not flat or min(flat) < 0 or sum(flat) <= 0:
        raise ValueError("a tree needs weights of at least zero and a positive sum")
    numbers, first = [], 0
    for region in tree:
        numbers.append([])
        for rack in region:
            numbers[-1].append(first)
            first += len(rack)
    regions = _array([sum(map(sum, region)) for region in tree])
    racks = _array([[sum(rack) for rack in region] for region in tree])
    shards = _array(tree)
    out = df.withColumn("_key", key)
    out = out.withColumn("_region", _draw(regions, F.col("_key"), F.lit("region")))
    out = out.withColumn("_rack", _draw(F.get(racks, F.col("_region")), F.col("_key"), F.lit("rack"), F.col("_region")))
    out = out.withColumn("_shard", _draw(F.get(F.get(shards, F.col("_region")), F.col("_rack")),
                                         F.col("_key"), F.lit("shard"), F.col("_region"), F.col("_rack")))
    start = F.get(F.get(F.array(*[F.array(*map(F.lit, n)) for n in numbers]), F.col("_region")), F.col("_rack"))
    return out.withColumn(name, (start + F.col("_shard")).cast("int")).drop("_key", "_region", "_rack", "_shard")


def shard_documents(docs: DataFrame, tree: Tree = EVEN_8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of documents by the law ``key``: the id and the tree decide, and one more shard takes rows only into itself.

    Returns doc_id, size (UTF-8 bytes of the text and 1; a null text has none),
    text_crc32 (of a null text: of no bytes), law, shard, slot (gapless from 0 in
    each shard), grown_shard. Repeated ids share a shard and get slots of their
    own; other columns of the input, whatever their names, are not read.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"),
                       F.crc32(raw).cast("long").alias("text_crc32"))
    placed = place(place(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), with_new_shard(tree), "grown_shard")
    return (numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))
