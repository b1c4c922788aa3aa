"""Document chunks, ingest without repeats, lexical retrieval, evidence checks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.operators import select
from tidemark.session import materialize

CHUNK_CHARS = 1400
OVERLAP = 160
SCAN = 80
#: Pieces of texts in an Arrow batch.
PIECES = 4096
#: Chunks of a block, queries scored at once in it, and blocks a query looks at before its bound is known.
BLOCK_CHUNKS = 256
QUERY_SLAB = 512
FIRST_BLOCKS = 4
#: What a context block says before its hits, and without any.
NOTICE = "Contexto recuperado por Python. Use apenas como memoria auxiliar; dados frescos do payload e Risk Manager prevalecem."
NOTHING_FOUND = "Nenhum contexto recuperado."


def split_text(body: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP, scan: int = SCAN) -> list[str]:
    """Overlapping pieces that end at a line break, else a space, when one is there.

    A piece starts ``overlap`` characters before the end of the last one, moved
    to a nearby word start. Where that would not move forward (a break right at
    the start of a long unbroken line), the next piece starts at the cut.

    The places of breaks are listed once; each end and start is then a binary
    search in them, whatever the size of the pieces.
    """
    clean = "\n".join(map(str.rstrip, body.strip().splitlines()))
    ends = {mark: [m.start() for m in re.finditer(mark, clean)] for mark in "\n "}
    blanks = [m.start() for m in re.finditer(r"[ \n\t]", clean)]

    def last(places: list[int], low: int, high: int) -> int | None:
        k = bisect_left(places, high)
        return places[k - 1] if k and places[k - 1] > low else None

    def end_of(start: int) -> int:
        limit = start + size
        if limit >= len(clean):
            return len(clean)
        return last(ends["\n"], start, limit) or last(ends[" "], start, limit) or limit

    def start_after(start: int, end: int) -> int:
        back = max(0, end - overlap)
        k = bisect_left(blanks, back)
        if back and k < len(blanks) and blanks[k] < min(back + scan, end - 1):
            back = blanks[k] + 1
        return max(back, end) if back <= start else back

    spans, at = [], 0
    while at < len(clean):
        spans.append((at, end_of(at)))
        at = len(clean) if spans[-1][1] == len(clean) else start_after(*spans[-1])
    return [piece for a, b in spans if (piece := clean[a:b].strip())]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, chunk_index, text) of the pieces of (id, body) rows, ``PIECES`` at a time."""
    for batch in batches:
        ids, bodies = batch.columns
        found: list[tuple[int, int, str]] = []
        for row, body in enumerate(bodies):
            for piece in enumerate(split_text(body.as_py() or "")):
                found.append((row, *piece))
                if len(found) == PIECES:
                    yield _batch(ids, bodies.type, found)
                    found = []
        if found:
            yield _batch(ids, bodies.type, found)


def _batch(ids: pa.Array, text_type: pa.DataType, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rows, numbers, texts = zip(*found)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(texts, text_type)], ["id", "chunk_index", "text"])


def chunk_documents(documents: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """One row per chunk: id, chunk_index, text, token_estimate. Parallel over documents; no row holds all pieces of one.

    Texts go to the splitter in Arrow batches: short ones are many, and a call for each would cost more than its work.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(body).cast("string").alias("body"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])
    pieces = rows.mapInArrow(_pieces, schema).withColumnRenamed("id", id_col)
    return pieces.withColumn("token_estimate", text.token_estimate(F.col("text")))


def new_documents(incoming: DataFrame, existing: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Incoming documents whose content is not stored yet, the lowest id of equal ones."""
    key = text.document_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("text"))
    rest = incoming.columns
    keyed = incoming.withColumn("content_hash", key)
    first = keyed.groupBy("content_hash").agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("_row"))
    rows = first.select("content_hash", *[F.col(f"_row.{c}").alias(c) for c in rest])
    return rows if existing is None else rows.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")


def with_document(chunks: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks next to the columns of the document they were cut from; chunks without one are left out."""
    return chunks.join(documents, id_col)


def words_holding(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, token) pairs where the token occurs inside the word.

    A token has no separators, so it occurs in a text exactly when it occurs in
    one of its words. Words meet tokens on the token's first three letters (an
    equi join over the distinct vocabulary) and are then checked in full.
    """
    size = F.length("word")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substring(F.col("word"), i, F.lit(3))))
    long = words.filter(size >= 3).select("word", F.explode(grams).alias("_gram"))
    keyed = tokens.select("token", F.substring("token", 1, 3).alias("_gram"))
    return long.join(keyed, "_gram").filter(F.contains(F.col("word"), F.col("token"))).select("word", "token")


class Postings:
    """Chunks in blocks of similar impact, with the asked tokens each of them holds.

    A chunk's impact is the number of asked tokens it holds, which bounds the
    hits any query has in it. ``held`` (block, chunk_id, published, tid) and
    ``asked`` (query_id, tokens, tids) are written tables. A block has a bounded
    number of chunks, so a token that all chunks hold is spread over all blocks.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame):
        asked = queries.select("query_id", text.query_tokens(F.col("query")).alias("_t"))
        tokens = materialize(asked.select("query_id", F.size("_t").alias("tokens"), F.explode("_t").alias("token")), "tokens")
        vocabulary = materialize(tokens.select("token").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
        published = F.col("published_at") if "published_at" in chunks.columns else F.lit(None)
        # Texts are cut into words once. The words that hold a token are written before they meet the chunks, so that their
        # size is known: mostly they are few, and then the words of a chunk stay in its task.
        listed = materialize(chunks.select("chunk_id", F.coalesce(published.cast("bigint"), F.lit(0).cast("bigint")).alias("published"), text.words_of(F.col("text")).alias("words")), "words")
        words = listed.select("chunk_id", "published", F.explode("words").alias("word"))
        table = materialize(words_holding(words.select("word").distinct(), vocabulary.select("token")).join(vocabulary, "token"), "holding")
        found = words.join(table, "word").groupBy("chunk_id", "published").agg(F.collect_set("tid").alias("tids"))
        found = materialize(found.withColumn("impact", F.floor(F.log2(F.size("tids"))).cast("int")), "found")
        sizes = found.groupBy("impact").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CHUNKS).alias("_parts"))
        part = F.pmod(F.xxhash64("chunk_id"), F.col("_parts"))
        self.held = materialize(found.join(sizes, "impact").select(
            (part * 64 + F.col("impact")).alias("block"), "chunk_id", "published", "tids"), "held")
        self.asked = materialize(tokens.join(vocabulary, "token").groupBy("query_id", "tokens").agg(F.collect_list("tid").alias("tids")), "asked")

    def bounds(self) -> DataFrame:
        """(block, query_id, bound, newest): no chunk of the block has more hits of the query, or is newer."""
        blocks = self.held.groupBy("block").agg(F.max(F.size("tids")).alias("_most"), F.max("published").alias("newest"))
        present = self.held.select("block", F.explode("tids").alias("tid")).distinct()
        held = present.join(self.asked.select("query_id", F.explode("tids").alias("tid")), "tid").groupBy("block", "query_id").agg(F.count(F.lit(1)).alias("_held"))
        return held.join(blocks, "block").select("block", "query_id", F.least(F.col("_held"), F.col("_most").cast("bigint")).alias("bound"), "newest")

    def score(self, pairs: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, chunk_id, published, hits, tokens) of all chunks with a hit in the asked (block, query_id) pairs, or of each pair's best."""
        asks = pairs.select("block", "query_id").join(self.asked, "query_id")
        kind = {f.name: f.dataType.simpleString() for f in [*self.held.schema, *self.asked.schema]}
        schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, published bigint, hits bigint, tokens int"
        return self.held.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(_scorer(limit), schema)


def _scorer(limit: int | None):
    def run(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["published", "chunk_id"], ascending=False, ignore_index=True)
        known, columns = np.unique(np.concatenate([*held["tids"], np.zeros(0, np.int64)]), return_inverse=True)
        has = np.zeros((len(known), len(held)), np.float32)
        has[columns, np.repeat(np.arange(len(held)), held["tids"].map(len))] = 1
        rows, places, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(asks) if len(held) else 0, QUERY_SLAB):
            part = asks["tids"].iloc[start:start + QUERY_SLAB]
            wanted = np.concatenate([*part])
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            inside = known[at] == wanted
            ask = np.zeros((len(part), len(known)), np.float32)
            ask[np.repeat(np.arange(len(part)), part.map(len))[inside], at[inside]] = 1
            counts = (ask @ has).astype(np.int64)  # whole numbers well below 2^24, so exact
            if limit is not None and counts.shape[1] > limit:
                # Chunks stand in the order that breaks ties, the first one wins.
                keys = counts * counts.shape[1] + np.arange(counts.shape[1])[::-1]
                best = np.argpartition(-keys, limit - 1, axis=1)[:, :limit]
                kept = np.zeros_like(counts)
                np.put_along_axis(kept, best, np.take_along_axis(counts, best, axis=1), axis=1)
                counts = kept
            q, c = np.nonzero(counts)
            rows.append(q + start)
            places.append(c)
            hits.append(counts[q, c])
        q, c = np.concatenate(rows), np.concatenate(places)
        return pd.DataFrame({"query_id": asks["query_id"].to_numpy()[q], "chunk_id": held["chunk_id"].to_numpy()[c], "published": held["published"].to_numpy()[c],
                             "hits": np.concatenate(hits), "tokens": asks["tokens"].to_numpy()[q]})
    return run


def query_chunk_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hits, tokens, score) for every pair with a hit.

    ``queries``: query_id, query; ``chunks``: chunk_id, text. Pairs come out of
    the blocks they meet in; tokens of pairs are never shuffled.
    """
    postings = Postings(queries, chunks)
    pairs = postings.score(materialize(postings.bounds().select("block", "query_id"), "bounds"))
    return pairs.select("query_id", "chunk_id", "hits", "tokens", F.round(F.col("hits") / F.col("tokens"), 4).alias("score"))


def candidates(chunks: DataFrame, source_types: Sequence[str] | None = None, max_age: int | None = None,
               now: int | None = None, cap: int | None = None) -> DataFrame:
    """Chunks that pass the filters, with ``cap`` the newest of them; an empty type list filters nothing."""
    when = F.coalesce("published_at", "created_at")
    rows = chunks
    if source_types:
        rows = rows.filter(F.col("source_type").isin(*source_types))
    if max_age is not None:
        rows = rows.filter(when >= F.lit(now - max_age))
    return rows if cap is None else rows.orderBy(when.desc(), F.desc("chunk_id")).limit(cap)


def search(queries: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """Best chunks per query by (score, published, id): query_id, chunk_id, hits, tokens, score, published_at, rank.

    Each query first looks at the few blocks that promise most. Its last place
    there is a bound that all better chunks must pass, so only blocks whose own
    bound reaches it (with a newer chunk where they are equal) are looked at
    next. A block gives at most ``limit`` rows for a query. Exact for any data; hits
    are compared before they are divided, which orders as the rounded score does
    for queries of up to 5,000 different tokens.
    """
    postings = Postings(queries, chunks)
    order = [F.desc("hits"), F.desc("published"), F.desc("chunk_id")]
    bounds = materialize(select.top_per_key(postings.bounds(), ["query_id"], [F.desc("bound"), F.desc("newest"), "block"], 1 << 30, "_place"), "bounds")
    first = materialize(select.top_per_key(postings.score(bounds.filter(F.col("_place") <= FIRST_BLOCKS), limit), ["query_id"], order, limit), "first")
    last = first.filter(F.col("rank") == limit).select("query_id", F.col("hits").alias("_hits"), F.col("published").alias("_published"))
    open_ = F.col("_hits").isNull() | (F.col("bound") > F.col("_hits")) | (F.col("bound") == F.col("_hits")) & (F.col("newest") >= F.col("_published"))
    rest = bounds.filter(F.col("_place") > FIRST_BLOCKS).join(last, "query_id", "left").filter(open_)
    found = select.top_per_key(first.drop("rank").unionByName(postings.score(rest, limit)), ["query_id"], order, limit)
    scored = found.withColumn("score", F.round(F.col("hits") / F.col("tokens"), 4))
    return scored.join(chunks.select("chunk_id", "published_at"), "chunk_id").drop("published")


def retrieval_log(queries: DataFrame, found: DataFrame, now: int, purpose: str) -> DataFrame:
    """One log row per query, also for queries without a result."""
    ids = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_ids"))
    picked = F.to_json(F.transform(F.coalesce("_ids", F.array().cast("array<struct<rank:int,chunk_id:bigint>>")), lambda x: x["chunk_id"]))
    return queries.join(ids, "query_id", "left").select(
        "query_id", "query", F.lit(now).alias("ts"), F.lit(purpose).alias("purpose"), picked.alias("selected_chunk_ids"))


def context_blocks(queries: DataFrame, found: DataFrame, title: str = "RAG CONTEXT", chars: int = 900) -> DataFrame:
    """Rendered context of every query; ``found`` carries rank, source_type, source, title, text. A query without hits is told so."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". source_type="), "source_type", F.lit(" source="), "source", F.lit(" published_at="),
        F.coalesce(F.col("published_at").cast("string"), F.lit("unknown")), F.lit(" score="), F.col("score").cast("string"),
        F.lit("\n   title="), "title", F.lit("\n   text="), F.substring("text", 1, chars))
    hits = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    body = F.when(F.col("_l").isNull(), NOTHING_FOUND).otherwise(F.concat(F.lit(f"{NOTICE}\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.concat(F.lit(f"[{title}]\n"), body, F.lit("\n")).alias("block"))


def screen_hits(hits: DataFrame, corpus: str, chars: int = 1600) -> DataFrame:
    """Mark search hits of a foreign corpus, with blocked flags, paths or instruction text.

    Adds ``rejected`` and the cut text.
    """
    folded = text.fold_ascii(F.col("text"))
    foreign = (F.trim(F.coalesce("corpus", F.lit(""))) != "") & (F.trim("corpus") != corpus)
    flags = F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in text.BLOCKED_FLAGS]))
    bad = foreign | flags | text.blocked_path(F.col("path")) | text.looks_like_instruction(folded, text.CHUNK_PATTERNS)
    return hits.withColumn("rejected", F.coalesce(bad, F.lit(False))).withColumn("text", F.substring("text", 1, chars))


def absent_citations(reports: DataFrame, supplied: DataFrame, keys: Sequence[str], cited: str = "cited", item: str = "news_id") -> DataFrame:
    """Cited ids that were not supplied: one row per report and id."""
    asked = reports.select(*keys, F.explode(cited).alias(item))
    return asked.join(supplied.select(*[k for k in keys if k in supplied.columns], item).distinct(),
                      [*[k for k in keys if k in supplied.columns], item], "left_anti")


def path_exists(document: Column, path: Column) -> Column:
    """Dotted path is a key of the JSON document, whatever its value."""
    parts = F.split(path, r"\.")
    leaf = F.element_at(parts, -1)
    parent = F.concat(F.lit("$"), F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                                                            lambda p: F.concat(F.lit("."), p)), ""))
    keys = F.json_object_keys(F.call_function("get_json_object", document, parent))
    return F.coalesce(F.array_contains(keys, leaf), F.lit(False))


def unsupported_paths(reports: DataFrame, roots: Sequence[str], id_col: str, paths: str = "paths", document: str = "snapshot") -> DataFrame:
    """Cited evidence paths whose root is not allowed or that the snapshot lacks."""
    rows = reports.select(id_col, document, F.explode(paths).alias("path"))
    clean = F.regexp_replace("path", r"^original_snapshot\.", "")
    root = F.element_at(F.split(clean, r"\."), 1)
    good = root.isin(*roots) & path_exists(F.col(document), clean)
    return rows.filter(~good).select(id_col, "path")


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode fenced JSON answers; ``invalid`` names the broken rule or is null."""
    body = F.from_json(text.unwrap_fence(F.col(raw)), "action STRING, conviction DOUBLE, reasoning STRING", {"mode": "PERMISSIVE"})
    rows = responses.withColumn("_b", body)
    bad = (F.when(F.col("_b.action").isNull() & F.col("_b.conviction").isNull(), "NOT_JSON")
           .when(~F.coalesce(F.col("_b.action").isin("BUY", "SELL", "HOLD"), F.lit(False)), "INVALID_ACTION")
           .when(~F.coalesce(F.col("_b.conviction").between(0, 100), F.lit(False)), "INVALID_CONVICTION"))
    return rows.select("*", F.col("_b.action").alias("action"), F.col("_b.conviction").alias("conviction"), bad.alias("invalid")).drop("_b")


def case_documents(logs: DataFrame) -> DataFrame:
    """Audited decisions as documents of type decision_case."""
    names = ("log_id", "llm_action", "action", "ts", "llm_reasoning", "brief", "reason", "price", "rsi", "rsi_status", "macd",
             "macd_status", "atr", "kline_age", "news_age", "market_stale", "news_stale", "risk_level", "red_flag", "terms",
             "exposure", "drawdown")
    body = text.case_text(**{n: F.col(n) for n in names})
    title = F.concat(F.lit("trade_log "), F.col("log_id").cast("string"), F.lit(": LLM "), "llm_action", F.lit(" final "), "action")
    return logs.select(F.col("log_id").alias("doc_id"), F.lit("decision_case").alias("source_type"),
                       F.concat(F.lit("trade_logs:"), F.col("log_id").cast("string")).alias("source"), title.alias("title"),
                       body.alias("text"), F.col("ts").alias("published_at"))


def news_documents(news: DataFrame) -> DataFrame:
    """Headlines as documents of type news_summary."""
    line = lambda label, name: F.concat(F.lit(label), F.col(name).cast("string"), F.lit("\n"))
    body = F.concat(line("Fonte: ", "source"), line("Timestamp: ", "ts"), line("Headline: ", "headline"))
    return news.select(F.col("news_id").alias("doc_id"), F.lit("news_summary").alias("source_type"), "source",
                       F.col("headline").alias("title"), body.alias("text"), F.col("ts").alias("published_at"))
