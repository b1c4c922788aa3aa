"""Range summaries: a question over any stretch of a series merges a logarithmic number of blocks.

A series is written once, packed by time chunk. Rows get their position from
the counts of chunks, blocks of 1, 2, 4, ... rows are summarised by a merge that
only has to be associative, and a stretch of positions is the union of at most
two blocks of each size. Blocks are made inside stretches of ``LEAF`` rows; the
summaries of those stretches are rows for the next round, so no task or row
holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chunks as C
from tidemark.session import materialize

#: Binary logarithm of the rows whose blocks are made in one row.
LEAF = 9
#: Questions reach so many rows by blocks of every size; a longer stretch adds largest blocks.
REACH = 18


@dataclass(frozen=True)
class Summary:
    """``lift`` makes the summary of one row (a struct), ``merge`` that of two neighbouring stretches."""

    lift: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Series:
    """A written series: ``packed`` has the rows of a key and time chunk, ``_before`` the rows of all earlier chunks."""

    packed: DataFrame
    keys: tuple[str, ...]
    width: int

    def rows(self) -> DataFrame:
        """keys, ``pos`` (from 0) and ``row``."""
        return self.packed.select(*self.keys, "_before", F.posexplode("_rows").alias("_at", "row")).select(
            *self.keys, (F.col("_before") + F.col("_at")).alias("pos"), "row")

    def place(self, left: DataFrame, at: str = "ts", out: str = "pos") -> DataFrame:
        """Adds the position of the newest row at or before ``at``; -1 where there is none."""
        asked = C.with_chunk(left, at, self.width)
        # Chunks without rows take part with a count of none, so that each asked chunk knows what lies before it.
        counts = (self.packed.select(*self.keys, C.CHUNK, F.size("_rows.ts").alias("_n"))
                  .unionByName(asked.select(*self.keys, C.CHUNK).distinct().withColumn("_n", F.lit(0)))
                  .groupBy(*self.keys, C.CHUNK).agg(F.sum("_n").alias("_n")))
        before = C.carry(counts, self.keys, {"_earlier": ("_n", "sum")})
        times = self.packed.select(*self.keys, C.CHUNK, F.col("_rows.ts").alias("_times"))
        # The chunks meet first, so rows go through one join.
        found = asked.join(before.join(times, [*self.keys, C.CHUNK], "left"), [*self.keys, C.CHUNK], "left")
        upto = F.coalesce(F.size(F.filter("_times", lambda t: t <= F.col(at))), F.lit(0))
        return found.withColumn(out, F.coalesce("_earlier", F.lit(0)) + upto - 1).drop("_earlier", "_times", C.CHUNK)


    def tail(self, left: DataFrame, n: int, out: str = "tail") -> DataFrame:
        """Adds the last ``n`` rows up to ``pos`` (which exists), oldest first. Rows are packed by position, ``n`` to a block, next to the block before."""
        block = F.floor(F.col("pos") / n)
        packed = (self.rows().withColumn("_block", F.explode(F.array(block, block + 1))).groupBy(*self.keys, "_block")
                  .agg(F.array_sort(F.collect_list("row")).alias("_rows")))
        base = F.greatest(F.col("_block") - 1, F.lit(0)) * n
        first = F.greatest(F.col("pos") - n + 1, F.lit(0))
        joined = left.withColumn("_block", block).join(packed, [*self.keys, "_block"])
        return C.pin(joined, out, F.slice("_rows", (first - base + 1).cast("int"), (F.col("pos") - first + 1).cast("int"))).drop("_rows", "_block")


def series(rows: DataFrame, cols: Sequence[str], width: int, keys: Sequence[str] = ("asset",), ts: str = "ts") -> Series:
    """Writes ``rows`` packed by time chunk; their source is read once, whatever is asked later."""
    entry = F.struct(F.col(ts).alias("ts"), *[c for c in cols if c != ts])
    packed = materialize(C.with_chunk(rows, ts, width).groupBy(*keys, C.CHUNK).agg(F.array_sort(F.collect_list(entry)).alias("_rows")), "series")
    before = C.carry(packed.select(*keys, C.CHUNK, F.size("_rows.ts").alias("_n")), keys, {"_before": ("_n", "sum")})
    return Series(packed.join(before, [*keys, C.CHUNK]), tuple(keys), width)


def _round(rows: DataFrame, keys: Sequence[str], summary: Summary, low: int) -> DataFrame:
    """Blocks of 2^low to 2^(low + LEAF) rows from ``(keys, idx, summary)`` of blocks of 2^low rows."""
    out = rows.groupBy(*keys, F.shiftright("idx", LEAF).alias("_leaf")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "summary"))).alias("_items"))

    def above(levels, _):
        below = F.element_at(levels, -1)
        # A last block without a partner is not complete; no question asks for it.
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(below) / 2), F.lit(1)).cast("int")), lambda i: summary.merge(F.get(below, 2 * i - 2), F.get(below, 2 * i - 1)))
        return F.concat(levels, F.array(F.when(F.size(below) > 1, pairs).otherwise(F.slice(below, 1, 0))))

    bottom = F.array(F.transform("_items", lambda r: r["summary"]))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(LEAF)), bottom, above)
    flat = out.select(*keys, "_leaf", F.posexplode(levels).alias("_up", "_blocks"))
    return flat.select(*keys, "_leaf", "_up", F.posexplode("_blocks").alias("_at", "summary")).select(
        *keys, (F.col("_up") + low).alias("level"), (F.col("_leaf") * F.pow(F.lit(2.0), F.lit(LEAF) - F.col("_up")).cast("long") + F.col("_at")).alias("idx"), "summary")


def blocks(of: Series, summary: Summary) -> DataFrame:
    """keys, level, idx and summary of all complete blocks: block ``idx`` of a level covers rows ``idx * 2^level`` and on."""
    level0 = of.rows().select(*of.keys, F.col("pos").alias("idx"), summary.lift(F.col("row")).alias("summary"))
    done = None
    for low in range(0, REACH, LEAF):
        made = materialize(_round(level0, of.keys, summary, low), "blocks")
        # The top of a round is the bottom of the next one.
        done = made if done is None else done.unionByName(made.filter(F.col("level") > low))
        level0 = made.filter(F.col("level") == low + LEAF).select(*of.keys, "idx", "summary")
        if level0.isEmpty():
            break
    return done


def cover(spans: DataFrame) -> DataFrame:
    """``spans`` has ``first`` and ``last``; each becomes the blocks it is the union of, as level, idx and ``start``."""
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    cut = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(REACH)))).withColumn("_size", size)
    cut = cut.withColumns({"_left": F.expr("(first + _size - 1) div _size"), "_right": F.expr("(last + 1) div _size")})
    cut = cut.filter(F.col("_left") < F.col("_right"))
    # Of each size the stretch takes a block on the left that has no partner inside, one on the right, and all of the largest.
    inner, top = F.col("_left") + F.col("_left") % 2, F.col("level") == REACH
    idx = F.filter(F.array(F.when(F.col("_left") % 2 == 1, F.col("_left")), F.when((inner < F.col("_right")) & (F.col("_right") % 2 == 1), F.col("_right") - 1)), lambda x: x.isNotNull())
    taken = cut.withColumn("idx", F.explode(F.when(top, F.sequence(F.col("_left"), F.col("_right") - 1)).otherwise(idx)))
    return taken.withColumn("start", F.col("idx") * F.col("_size")).drop("_left", "_right", "_size", "first", "last")


def ask(questions: DataFrame, spans: Column, table: DataFrame, summary: Summary, keys: Sequence[str] = ("asset",), out: str = "answers") -> DataFrame:
    """One array of summaries for each row of ``questions``, which must be distinct: one for each of its ``spans``.

    ``spans`` is an array of structs of first and last position, all of which exist.
    Rows without any span get a null.
    """
    names = questions.columns
    parts = cover(questions.select("*", F.posexplode(spans).alias("_no", "_span")).select(*names, "_no", "_span.first", "_span.last"))
    met = parts.join(table, [*keys, "level", "idx"])
    each = met.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_no", "start", "summary"))).alias("_parts"))
    none = F.lit(None).cast(table.schema["summary"].dataType)
    nos = F.sequence(F.lit(0), F.element_at("_parts", -1)["_no"])
    folded = F.transform(nos, lambda no: F.aggregate(
        F.filter("_parts", lambda p: p["_no"] == no), none, lambda a, p: F.when(a.isNull(), p["summary"]).otherwise(summary.merge(a, p["summary"]))))
    return C.pin(each, out, folded).drop("_parts")
