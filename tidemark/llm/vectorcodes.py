"""Vector codes: a product quantiser fitted in whole numbers, whose nearest entries a GNAT over each codebook finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

#: Parts of a vector, entries of a codebook, rounds of fitting, and what a component is multiplied with before it is floored.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a tree node; a node of that many entries is a leaf.
DEGREE = 8
#: Relative slack of a square root, well over what rounding can take.
SLACK = 2.0**-48


@dataclass
class Node:
    """Split points of a set of entries, and for each split and child the least and greatest distance between them."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``, as whole numbers."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    # Whole numbers below 2^53 are exact in a double, for which products of matrices are fast.
    kind = np.float64 if 4 * max(a.shape[1], 1) * most * most < 2**53 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def tree(entries: np.ndarray, members: np.ndarray | None = None, degree: int = DEGREE) -> Node:
    """GNAT over the rows of ``entries``: splits lie far apart, every other member is in the child of its nearest split."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= degree:
        return Node(members, np.zeros((0, 0)), np.zeros((0, 0)), [])
    chosen = [0]
    gaps = squared(entries[members], entries[members[:1]])[:, 0]
    gaps[0] = -1
    while len(chosen) < degree:
        k = int(gaps.argmax())
        chosen.append(k)
        gaps = np.minimum(gaps, squared(entries[members], entries[members[k:k + 1]])[:, 0])
        gaps[chosen] = -1
    points = np.sort(members[chosen])
    rest = np.setdiff1d(members, points)
    away = squared(entries[rest], entries[points])
    nearest = away.argmin(axis=1)
    far = np.sqrt(away)
    low, high, children = np.full((degree, degree), np.inf), np.full((degree, degree), -np.inf), []
    for j in range(degree):
        inside = nearest == j
        children.append(tree(entries, rest[inside], degree) if inside.any() else None)
        if inside.any():
            low[:, j], high[:, j] = far[inside].min(axis=0) * (1 - SLACK), far[inside].max(axis=0) * (1 + SLACK)
    return Node(points, low, high, children)


class Search:
    """Nearest entries of a batch of vectors: the smallest squared distance, of equal ones the smallest entry number.

    A subtree is left out only when its stored distance range to some split
    point lies strictly outside the query's distance to that split, plus and
    minus the best distance so far. Ranges and roots are rounded outward, so a
    rounding error can only cause a visit; what is visited is compared as whole
    numbers, ties included.
    """

    def __init__(self, entries: np.ndarray, queries: np.ndarray):
        self.entries, self.queries = entries, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), np.iinfo(np.int64).max)
        self.compared = 0

    def visit(self, node: Node, rows: np.ndarray) -> None:
        away = squared(self.queries[rows], self.entries[node.points])
        self.compared += away.size
        place = away.argmin(axis=1)
        found, entry = away[np.arange(len(rows)), place], node.points[place]
        better = (found < self.best[rows]) | (found == self.best[rows]) & (entry < self.entry[rows])
        self.best[rows[better]], self.entry[rows[better]] = found[better], entry[better]
        if not node.children:
            return
        roots = np.sqrt(away)
        least, most = roots * (1 - SLACK), roots * (1 + SLACK)
        for own in (True, False):  # the child of the nearest split first, which shrinks the radius for the others
            for j, child in enumerate(node.children):
                here = np.flatnonzero((place == j) == own)
                if child is None or not len(here):
                    continue
                radius = (np.sqrt(self.best[rows[here]]) * (1 + SLACK))[:, None]
                out = (node.low[:, j] > (most[here] + radius) * (1 + SLACK)) | (node.high[:, j] * (1 + SLACK) < least[here] - radius)
                here = here[~out.any(axis=1)]
                if len(here):
                    self.visit(child, rows[here])


def nearest(entries: np.ndarray, queries: np.ndarray, root: Node | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(entry number, squared distance)`` of each query."""
    search = Search(entries, queries)
    if len(queries):
        search.visit(root or tree(entries), np.arange(len(queries)))
    return search.entry, search.best


def _parts(batch: pa.RecordBatch, books: list[np.ndarray]) -> list[np.ndarray]:
    """Whole-number vectors of a batch, one matrix for each part."""
    width = books[0].shape[1]
    flat = batch.column("_ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    whole = flat.reshape(-1, width * len(books))
    most = max([int(np.abs(whole).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books)])
    if 4 * max(whole.shape[1], 1) * most * most >= 2**63:
        raise ValueError("components are too large for a squared distance to be a long")
    return [whole[:, k * width:(k + 1) * width] for k in range(len(books))]


def _sums(books: list[np.ndarray]):
    """Counts and componentwise sums of the parts each entry gets: one row for each entry and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in batches:
            for k, part in enumerate(_parts(batch, books)):
                entry, _ = nearest(books[k], part, trees[k])
                counts[k] += np.bincount(entry, minlength=len(books[k]))
                np.add.at(sums[k], entry, part)
        used = [(k, e) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()), pa.array([int(counts[k][e]) for k, e in used], pa.int64()),
            pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        for batch in batches:
            found = [nearest(books[k], part, trees[k]) for k, part in enumerate(_parts(batch, books))]
            marks = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = reduce(np.add, [distance for _, distance in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m.tobytes().hex() for m in marks], pa.string()), pa.array(error, pa.int64())],
                                             names=[*batch.schema.names[:-1], "code", "error"])
    return run


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(_id, _label, _ints)`` of the rows whose vector is there and finite in every component."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("_vector").isNotNull() & finite).select("_id", "_label", F.transform("_vector", lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("_ints"))


def fit(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of written ``(_id, _ints)`` rows: they start as the parts of the rows of the smallest ids, and each round
    replaces an entry by the floored mean of the parts it is nearest to; unused entries stay.

    Rows that repeat an id go by vector, null ids last. Only entries (at most
    ``parts x entries``) and their sums come to the driver.
    """
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_ints").limit(entries).select("_ints").collect()
    width = dimension // parts
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), dimension)
    books = [start[:, k * width:(k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("_ints").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        for r in total.collect():
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """id, code (two hex digits a part), error, label_error (errors of equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are
    dropped. The dimension is the length most rows have (of equal counts the
    longer); rows of another length, and all rows if the dimension is not a
    multiple of ``parts`` (or zero), stay with a null code and error. Repeated
    rows count as often as they come. At most 256 entries fit two hex digits.
    Other columns, whatever their names, are not read.
    """
    if not 0 < entries <= 256 or parts <= 0:
        raise ValueError("a code has one to 256 entries a part")
    rows = materialize(whole_numbers(vectors, id_col, vector_col, label_col, scale), "ints")
    common = rows.groupBy(F.size("_ints").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dimension = common[0]["size"] if common and common[0]["size"] % parts == 0 else 0
    fits = rows.filter(F.size("_ints") == dimension) if dimension else rows.limit(0)
    books = fit(fits, dimension, parts, entries, rounds)
    schema = T.StructType([rows.schema["_id"], rows.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = fits.mapInArrow(_codes(books), schema)
    others = rows.filter(F.size("_ints") != dimension) if dimension else rows
    coded = materialize(coded.unionByName(others.select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
