"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import unit, word_count
from tidemark.session import materialize

#: Weights that sources take in turn, words of the mix for each word of the input, and most copies of a document.
WEIGHTS, SHARE, MOST_COPIES = (3.0, 1.0, 2.0), 1.5, 2
#: Ranges that the ranks of a source are cut into at a time, and rows of the last range that are sorted together.
RANGES, BORDER_ROWS = 4096, 4096

SOURCE = ["_no_source", "_source"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``(_no_source, _source, source_size, rows, target)`` for every source of a table of sources and sizes.

    The source at place i by code point (null last) has weight ``weights[i % len]``.
    A target stops at ``most`` times its source's size; what is over is shared
    anew by weight until no target is above. Only two sums travel to the driver in each round.
    """
    totals = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # Places by ranges of names: no task holds all sources, however many there are.
    spread = materialize(totals.repartitionByRange(*SOURCE).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*SOURCE)) - 1
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    placed = materialize(spread.join(starts, "_part").select(
        *SOURCE, "source_size", "rows", turn.alias("_weight"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "sources")
    whole, weight = placed.agg(F.sum("source_size"), F.sum("_weight")).first()
    total, rate, capped = share * (whole or 0), 0.0, -1
    held, left = 0.0, weight or 0.0
    while left > 0:
        rate = (total - held) / left
        above = F.col("_cap") <= F.lit(rate) * F.col("_weight")
        n, held, left = placed.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)),
                                   F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0))).first()
        if n == capped:
            break
        capped = n
    return placed.select(*SOURCE, "source_size", "rows", F.least("_cap", F.lit(rate) * F.col("_weight")).alias("target"))


def _rank(odds: Column, key: Column) -> Column:
    """Pareto rank: random odds divided by inclusion odds, brought to the range from 0 to 1 without changing the order."""
    u = unit(key)
    ratio = (u / (1 - u)) / odds
    return F.when(odds > 0, ratio / (1 + ratio))


def _borders(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``(_no_source, _source, _low, _high, _before)``: ranks between which a source reaches what it needs, and the words before.

    Histograms of sums narrow the ranks of all sources at once, until few rows
    are left between. Sources that their ranks never fill have no border.
    """
    zone = plan.select(*SOURCE, "_need", F.lit(0.0).alias("_low"), F.lit(1.0).alias("_high"), F.lit(0).cast("long").alias("_before"))
    seen = None
    while True:
        inside = ranked.drop("_need").join(zone, SOURCE).filter(F.col("_q").between(F.col("_low"), F.col("_high")))
        place = F.coalesce(F.least(F.floor(F.try_divide(F.col("_q") - F.col("_low"), F.col("_high") - F.col("_low")) * RANGES), F.lit(RANGES - 1)), F.lit(0)).cast("int")
        sums = inside.groupBy(*SOURCE, "_need", "_before", place.alias("_place")).agg(
            F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"), F.min("_q").alias("_low"), F.max("_q").alias("_high"))
        earlier = Window.partitionBy(*SOURCE).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        zone = materialize(sums.filter((F.col("_before") <= F.col("_need")) & (F.col("_before") + F.col("_words") > F.col("_need")))
                           .select(*SOURCE, "_need", "_low", "_high", "_before", "_rows"), "borders")
        wide = zone.filter((F.col("_rows") > BORDER_ROWS) & (F.col("_low") < F.col("_high"))).agg(F.count(F.lit(1)), F.sum("_rows")).first()
        if not wide[0] or tuple(wide) == seen:
            return zone.select(*SOURCE, "_low", "_high", "_before")
        seen, zone = tuple(wide), zone.drop("_rows")


def sample(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``copies`` to rows of ``(_no_source, _source, _uid, size)``; ``_uid`` tells all rows apart.

    A document is due target / source_size copies in the mean. Whole copies are
    certain. For the rest its inclusion odds are those of the remaining share,
    times its size over the mean size of its source: long documents hold more
    of the words that are due. Documents are ranked by random odds over
    inclusion odds, and taken in that order while the words still missing
    allow it; of the others the one that comes nearest to the last gap, if any
    does, closes it. So a source misses its target by less than the size of a
    small document.

    Only the rows around the place where a source reaches its target are
    sorted, however many it has (``_borders``).
    """
    plan = targets.withColumn("_due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("_whole", F.floor("_due")).withColumn("_share", F.col("_due") - F.col("_whole"))
    plan = plan.withColumn("_need", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
    odds = F.col("_share") / (1 - F.col("_share")) * (F.col("size") * F.col("rows") / F.nullif(F.col("source_size"), F.lit(0)))
    ranked = materialize(rows.join(plan, SOURCE).withColumn("_q", _rank(odds, F.col("_uid"))), "ranked")
    placed = ranked.join(_borders(ranked, plan), SOURCE, "left")
    near = placed.filter("_q between _low and _high")
    order = Window.partitionBy(*SOURCE).orderBy("_q", "_uid")
    near = materialize(near.withColumn("_upto", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                       .withColumn("_in", F.col("_upto") <= F.col("_need")), "near")
    gap = near.groupBy(*SOURCE).agg((F.max("_need") - F.coalesce(F.max(F.when(F.col("_in"), F.col("_upto"))), F.max("_before"))).alias("_gap"))
    later = placed.filter("_q > _high").select(*SOURCE, "_q", "_uid", "size").unionByName(near.filter("not _in").select(*SOURCE, "_q", "_uid", "size"))
    miss = F.abs(F.col("size") - F.col("_gap"))
    closing = (later.join(gap, SOURCE).filter(miss < F.col("_gap")).groupBy(*SOURCE)
               .agg(F.min(F.struct(miss.alias("m"), "_q", "_uid")).alias("_close")))
    closing = materialize(closing, "closing")
    columns = [*rows.columns, "source_size", "target", "_whole"]
    # A source whose ranks never reach its target (rounding) has no border and takes them all.
    rest = (placed.filter("_low is null or _q is null or _q < _low or _q > _high")
            .withColumn("_in", F.coalesce(F.col("_q").isNotNull() & (F.col("_low").isNull() | (F.col("_q") < F.col("_low"))), F.lit(False))).select(*columns, "_in"))
    every = rest.unionByName(near.select(*columns, "_in")).join(closing, SOURCE, "left")
    close = F.coalesce((F.col("_uid") == F.col("_close._uid")) & ~F.col("_in"), F.lit(False))
    return every.withColumn("copies", (F.col("_whole") + F.when(F.col("_in") | close, 1).otherwise(0)).cast("long")).drop("_whole", "_in", "_close")


#: What tells documents apart while their texts stay behind: id (null apart from every id), text and source.
HANDLE = ["_rid", "_fp", *SOURCE]


def _handled(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source, known = F.col(source_col).cast("string"), F.col(id_col).cast("string")
    return docs.withColumns({"_rid": F.coalesce(F.concat(F.lit("="), known), F.lit("")), "_fp": F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")),
                             "_no_source": source.isNull(), "_source": F.coalesce(source, F.lit(""))})


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, handle, size and ``_uid`` of every row. Rows that are alike are numbered by counts of parts, so no task holds them all."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_of"))
    slim = _handled(slim, "doc_id", "_text", "_of").select("doc_id", *HANDLE, word_count(F.col("_text")).alias("size"))
    slim = materialize(slim.withColumn("_part", F.spark_partition_id()), "rows")
    counts = slim.groupBy("doc_id", *HANDLE, "size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*HANDLE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.withColumn("_first", before).withColumn("_j", F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_n"))))
    uid = F.concat_ws("|", "_rid", "_fp", F.col("_j").cast("string"))
    return materialize(numbered.select("doc_id", *HANDLE, "size", uid.alias("_uid")), "sizes")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    Size is the number of words; null and blank texts have none and take none.
    Ranks come from id, text and, for rows that are alike in both, a number, so
    reruns agree and every row is a document of its own, null and repeated ids
    included. Other columns, whatever their names, are not read.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = sample(sized, source_targets(sized, weights, share, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as ``mix_documents`` takes it, with its columns as they were.

    Of rows that are alike in id, text and source one stands for all, as often as they are taken together.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    taken = sample(sized, source_targets(sized, weights, share, most))
    copies = materialize(taken.groupBy(*HANDLE).agg(F.sum("copies").alias("copies"), (F.count(F.lit(1)) > 1).alias("_many")).filter("copies > 0"), "copies")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = _handled(packed, f"_row.{id_col}", f"_row.{text_col}", f"_row.{source_col}").join(copies, HANDLE)
    if not copies.filter("_many").isEmpty():
        alike = found.filter("_many").groupBy(*HANDLE, "copies").agg(F.first("_row").alias("_row"))
        found = found.filter("not _many").select("_row", "copies").unionByName(alike.select("_row", "copies"))
    repeated = found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
