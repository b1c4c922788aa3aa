"""Queries of the numbered operators and their SQL twins, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exactdedup, langid, linerules, mixing, ngramjoin, packing, periodicruns, resampling, sharding, simhash, sitelines, urlfilter, vectorcodes
from tidemark.llm.common import words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_hash_tree_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@query
def op2_golay_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_redirect_url_filter(spark, sf_dir):
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


@query
def op4_pareto_mixing(spark, sf_dir):
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


@query
def op5_importance_resampling(spark, sf_dir):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_block_naming_dedup(spark, sf_dir):
    return exactdedup.exact_groups(_table(spark, sf_dir, "documents"))


@query
def op7_bigru_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


@query
def op8_linear_grouping_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op9_line_first_quality(spark, sf_dir):
    return linerules.judge(_table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op10_site_line_dedup(spark, sf_dir):
    """Lines that a site repeats on many of its pages, those that rotate included."""
    return sitelines.drop_site_lines(_table(spark, sf_dir, "pages"), sitelines.LOOSE_RATIO, least_seen=sitelines.LOOSE_SEEN)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document (by the checksum of its id) repeats a stretch of its words to its end."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(mark % 10 == 0, words(F.col("text"))).alias("_words"), F.floor(mark / 10).cast("int").alias("_g"))
    rows = rows.withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("int"))
    left = F.col("_n") - F.col("_a")
    stretch = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(left / F.col("_p")).cast("int")))
    planted = F.concat_ws(" ", F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(stretch, F.lit(1), left)))
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op11_kruskal_periodic_runs(spark, sf_dir):
    found = periodicruns.find_runs(with_repeats(_table(spark, sf_dir, "documents")))
    larger = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    best = found.withColumn("_best", F.aggregate("runs", none, larger))
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in periodicruns.RUN.names])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{n}").alias(n) for n in periodicruns.RUN.names],
                       F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_gnat_vector_codes(spark, sf_dir):
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings"))


@query
def op13_divideskip_shingle_join(spark, sf_dir):
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"))


WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    def host(u):
        return f"translate(regexp_extract(regexp_extract(coalesce({u}, ''), '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"

    def path(u):
        return f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))

    def decide(value):
        cases = " ".join(f"WHEN (host = {_lit(h)} OR ends_with(host, {_lit('.' + h)})) AND starts_with(path, {_lit(p)}) THEN {_lit(value(v, h + p))}" for v, h, p in rules)
        return f"CASE {cases} END"

    def value(pattern):
        return " || ".join(f"regexp_extract(t, {_lit(pattern)}, {k})" for k in (1, 2, 3))

    U = urlfilter
    parts = "string_split(bp0, '/')"
    dots = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda x: [x])), lambda acc, x: CASE x[1] WHEN '.' THEN acc WHEN '..' THEN acc[1:greatest(len(acc) - 1, least(len(acc), 1))] ELSE acc || x END)"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), {_lit(U.HIDDEN)}, '', 'g'), {_lit(U.TAGS)})) AS t FROM p),
said AS (
  SELECT url, CASE WHEN regexp_matches(t, {_lit(U.CANONICAL)}) THEN {value(U.HREF)}
                   WHEN regexp_matches(t, {_lit(U.REFRESH)}) THEN regexp_extract({value(U.CONTENT)}, {_lit(U.MOVED)}, 1) ELSE '' END AS u FROM tags),
found AS (SELECT url, trim(replace(u, '&amp;', '&')) AS target FROM said),
full_ AS (
  SELECT url, CASE WHEN regexp_matches(target, {_lit(U.WEB)}) THEN target WHEN regexp_matches(target, {_lit(U.SCHEME)}) THEN NULL WHEN starts_with(target, '//') THEN 'http:' || target
                   WHEN regexp_matches(target, '^[?#]') THEN 'http://' || {host('url')} || {path('url')}
                   WHEN starts_with(target, '/') THEN 'http://' || {host('url')} || target
                   ELSE 'http://' || {host('url')} || CASE WHEN regexp_extract({path('url')}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({path('url')}, '(?s)^(.*/)', 1) END || target END AS target
  FROM found WHERE target <> ''),
raw AS (SELECT {host('url')} AS ah, {path('url')} AS ap, {host('target')} AS bh, {path('target')} AS bp0 FROM full_ WHERE target IS NOT NULL),
links AS (SELECT ah, ap, bh, CASE WHEN contains(bp0, '/.') THEN array_to_string({dots}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE bp0 END AS bp FROM raw),
real AS (SELECT * FROM links WHERE ah <> '' AND bh <> '' AND (ah, ap) <> (bh, bp)),
both_ AS (SELECT ah, ap, bh, bp FROM real UNION SELECT bh, bp, ah, ap FROM real),
reach AS (SELECT ah, ap, ah AS host, ap AS path FROM both_ UNION SELECT r.ah, r.ap, b.bh, b.bp FROM reach r JOIN both_ b ON b.ah = r.host AND b.ap = r.path),
inherited AS (SELECT ah AS host, ap AS path, min({decide(lambda v, r: v)}) AS verdict FROM reach GROUP BY ah, ap)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, i.verdict, 'allow') AS verdict
FROM (SELECT page_id, host, path, {decide(lambda v, r: r)} AS rule, {decide(lambda v, r: v)} AS verdict FROM p) r
JOIN p USING (page_id, host, path) LEFT JOIN inherited i ON i.host = r.host AND i.path = r.path
"""


def _mix_sql() -> str:
    weights = ", ".join(str(w) for w in mixing.WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || doc_id, '') || '|' || md5(coalesce(text, '')) || '|' || row_number() OVER (PARTITION BY doc_id, text, source) AS uid, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS rows_, list_extract([{weights}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT))::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, {float(mixing.MOST_COPIES)} * source_size AS cap, row_number() OVER (ORDER BY {float(mixing.MOST_COPIES)} * source_size / w, source NULLS LAST) AS n FROM s),
r AS (SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM c),
l AS (SELECT rate FROM r WHERE cap > rate * w ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, rows_, least(cap, (SELECT rate FROM l) * w) AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS due FROM t),
q AS (SELECT *, floor(due) AS whole, due - floor(due) AS rest, greatest(target - floor(due) * source_size, 0.0) AS need FROM p),
u AS (SELECT d.*, q.source_size, q.target, q.whole, q.need, q.rest / (1 - q.rest) * (d.size * q.rows_ / nullif(q.source_size, 0)::DOUBLE) AS odds, (CAST('0x' || substr(md5(uid), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, CASE WHEN odds > 0 THEN ((u / (1 - u)) / odds) / (1 + (u / (1 - u)) / odds) END AS rank_ FROM u),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank_, uid ROWS UNBOUNDED PRECEDING) AS upto FROM k),
g AS (SELECT *, rank_ IS NOT NULL AND upto <= need AS taken_, need - coalesce(max(CASE WHEN rank_ IS NOT NULL AND upto <= need THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM o),
f AS (SELECT source, arg_min(uid, (abs(size - gap), rank_, uid)) AS closing FROM g WHERE rank_ IS NOT NULL AND NOT taken_ AND abs(size - gap) < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target, CAST(g.size * (g.whole + CASE WHEN g.taken_ OR coalesce(f.closing = g.uid, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g LEFT JOIN f ON g.source IS NOT DISTINCT FROM f.source
"""


def _line_sql() -> str:
    L = linerules
    line_words, chars = f"len(regexp_extract_all(x, '{WORD}'))", f"length(translate(x, {BLANKS}, ''))"
    symbols, upper = f"len(regexp_extract_all(x, {_lit(L.SYMBOLS)}))", r"len(regexp_extract_all(x, '\p{Lu}'))"
    unended = f"({line_words} >= {L.SENTENCE_WORDS} AND NOT regexp_matches(x, {_lit(L.ENDS)}) AND NOT regexp_matches(x, {_lit(L.ENDED)}))"
    fails = (f"({unended} OR len(regexp_extract_all(x, {_lit(L.SEPARATORS)})) > {L.MOST_SEPARATORS}"
             f" OR (regexp_matches(x, {_lit(L.BOILERPLATE)}) AND length(x) < {L.BOILERPLATE_CHARS}) OR 100 * {symbols} > {L.MOST_SYMBOLS} * {chars}"
             f" OR (100 * {upper} > {L.MOST_CAPITALS} * {chars} AND {line_words} >= {L.SENTENCE_WORDS}))")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{WORD}')) AS word, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS i FROM d),
v AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s AS win FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v WHERE win IS NOT NULL) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS ks(k) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
y AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dups, sum(CASE WHEN {fails} THEN {chars} ELSE 0 END) AS lost FROM x WHERE {chars} > 0 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS n_words, CAST(length(translate(t, {BLANKS}, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, {_lit(L.SYMBOLS)})) AS BIGINT) AS n_symbols, CAST(coalesce(y.dups, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(y.lost, 0) AS BIGINT) AS lost_chars
      FROM d LEFT JOIN y USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {L.LEAST_WORDS} OR 100 * n_repeat_words > {L.MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {L.LEAST_WORDS} OR 100 * n_repeat_words > {L.MOST_REPEATED} * n_words) AND 100 * lost_chars <= {L.MOST_LOST} * word_chars AS kept
FROM m
"""


def _site_sql() -> str:
    host = f"translate(regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    text = f"regexp_replace(coalesce(html, ''), {_lit(sitelines.UNSEEN)}, '', 'g')"
    text = f"regexp_replace({text}, {_lit(sitelines.BLOCK_TAGS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, sign in sitelines.ENTITIES:
        text = f"replace({text}, {_lit(entity)}, {_lit(sign)})"
    return rf"""
WITH p AS (SELECT page_id, {host} AS host, list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
lists AS (SELECT host, list(line) AS common FROM seen JOIN totals USING (host) WHERE pages >= {sitelines.LEAST_PAGES} AND n >= {sitelines.LOOSE_SEEN} AND n > {sitelines.LOOSE_RATIO}::DOUBLE * pages GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), FALSE)) AS kept FROM p LEFT JOIN lists USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS lines, CAST(len(lines) - len(kept) AS BIGINT) AS dropped_lines, array_to_string(kept, chr(10)) AS text FROM k
"""


def _words_sql(text: str) -> str:
    """CTEs ``d`` (doc_id, n) and ``w`` (doc_id, i from 0, word)."""
    return f"""d AS (SELECT doc_id, regexp_extract_all({text}, '{WORD}') AS ws, CAST(len(regexp_extract_all({text}, '{WORD}')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM d)"""


def _runs_sql() -> str:
    steps = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"
    words_, periods = periodicruns.LEAST_WORDS, periodicruns.LEAST_PERIODS
    window = periodicruns.least_prefix(words_, periods)
    return f"""
WITH {_words_sql("coalesce(text, '')")},
h AS (SELECT doc_id, n, xor({steps}, 4294967295) AS h FROM d),
m AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS k FROM h),
x AS (SELECT m.doc_id, m.n, r.i, CASE WHEN a IS NULL OR r.i < a THEN r.i ELSE a + (r.i - a) % (1 + (n - a) // k) END AS j FROM m JOIN w r USING (doc_id)),
t AS (SELECT x.doc_id, x.n, x.i, w.word FROM x JOIN w ON w.doc_id = x.doc_id AND w.i = x.j),
g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER s AS win, count(*) OVER s AS c FROM t WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
q AS (SELECT DISTINCT l.doc_id, r.i - l.i AS q FROM g l JOIN g r ON l.doc_id = r.doc_id AND l.win = r.win AND r.i > l.i WHERE l.c = {window} AND r.c = {window} AND {periods} * (r.i - l.i) <= l.n),
e AS (SELECT q.doc_id, q.q, l.i, l.i - row_number() OVER (PARTITION BY q.doc_id, q.q ORDER BY l.i) AS grp
      FROM q JOIN t l ON l.doc_id = q.doc_id JOIN t r ON r.doc_id = q.doc_id AND r.i = l.i + q.q AND r.word = l.word),
z AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest({words_}, {periods} * q)),
r AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.doc_id = z.doc_id AND y.q < z.q AND z.q % y.q = 0 AND y.s <= z.s AND y.s + y.l >= z.s + z.l)),
best AS (SELECT doc_id, s, l, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
list AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.l) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN list USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _codes_sql(dimension: int = 64) -> str:
    V = vectorcodes
    width = dimension // V.PARTS

    def nearest_sql(k):
        away = "CAST(list_inner_product(y, y) + list_inner_product(c, c) - 2 * list_inner_product(y, c) AS BIGINT)"
        return f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(y) AS y, min({{'d': {away}, 'e': e}}) AS best FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)"

    rounds = "".join(f"""{nearest_sql(k)},
m{k} AS (SELECT part, e, list(mean ORDER BY i) AS c FROM (SELECT part, best.e AS e, i, floor(sum(y[i]) / count(*)) AS mean FROM a{k}, range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY part, e),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, e)),
""" for k in range(V.ROUNDS))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({V.SCALE} * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * {width} + 1 : part * {width} + {width}] AS y FROM v, range({V.PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, y AS c FROM p QUALIFY e < {V.ENTRIES}),
{rounds}{nearest_sql(V.ROUNDS)},
code AS (SELECT vec_id, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{V.ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)::VARCHAR), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{V.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM code JOIN v USING (vec_id), book
"""


def _sets_sql() -> str:
    size, percent = ngramjoin.SHINGLE_WORDS, ngramjoin.PERCENT
    lowered = f"translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    return f"""
WITH RECURSIVE {_words_sql(lowered)},
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER s AS win, count(*) OVER s AS c FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, win FROM g JOIN d USING (doc_id) WHERE c = least({size}, n)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both_ FROM s l JOIN s r ON l.win = r.win AND l.doc_id <> r.doc_id GROUP BY l.doc_id, r.doc_id),
e AS MATERIALIZED (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * both_ >= {percent} * (x.n + y.n - both_)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS least_ FROM reach GROUP BY a)
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_, doc_id)) AS component_id FROM d LEFT JOIN z USING (doc_id) LEFT JOIN low USING (doc_id)
"""


ORACLES: dict[str, str] = {
    "op11_kruskal_periodic_runs": _runs_sql(),
    "op12_gnat_vector_codes": _codes_sql(),
    "op13_divideskip_shingle_join": _sets_sql(),
    "op3_redirect_url_filter": _url_sql(),
    "op4_pareto_mixing": _mix_sql(),
    "op6_block_naming_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
    "op9_line_first_quality": _line_sql(),
    "op10_site_line_dedup": _site_sql(),
}
