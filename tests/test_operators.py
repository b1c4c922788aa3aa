"""Selection, quantiles, documents, ledgers, files and sinks against direct computation."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tests.harness import SF_DIR, compare, connect
from tidemark import schemas
from tidemark.operators import asof, chunks, ranges, select
from tidemark.plans import documents, ledger, memory
from tidemark.sources import files, sinks

T0 = 1_800_000_000


@pytest.mark.parametrize("density,spacing,fan", [(0.05, 600, 256), (0.5, 900, 3), (1.0, 420, 2), (0.02, 420, 2), (0.3, 660, 5)])
def test_greedy_spacing_equals_a_scan(spark, density, spacing, fan):
    rng = random.Random(int(density * 100))
    rows = [(k, T0 + 60 * i) for k in ("a", None) for i in range(1500) if rng.random() < density]
    got = select.greedy_spacing(spark.createDataFrame(rows, "k string, ts bigint"), ["k"], spacing, width=spacing * (1 + fan % 4), fan=fan)
    want = []
    for k in ("a", None):
        allowed = 0
        for _, ts in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if ts >= allowed:
                want.append((k, ts))
                allowed = ts + spacing
    assert sorted((str(r.k), r.ts) for r in got.collect()) == sorted((str(k), ts) for k, ts in want)


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=900) * 50, np.full(500, 1.25)])
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": values}))
    got = {r.fraction: r.quantile for r in chunks.exact_order_values(df, ["k"], "v", (0.1, 0.25, 0.5, 0.9)).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(values, q))
    near = {r.fraction: r.quantile for r in chunks.exact_order_values(df, ["k"], "v", (0.5, 0.95), rank="nearest").collect()}
    ordered = np.sort(values)
    assert near == {q: ordered[round((len(values) - 1) * q)] for q in (0.5, 0.95)}


def test_running_sum_and_rank_cross_chunks(spark):
    rows = [("a", i * 7, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id bigint, v double")
    got = sorted((r.id, r.s) for r in chunks.running_sum(df, ["k"], "id", "v", 50, "s").collect())
    assert [s for _, s in got] == list(np.cumsum([r[2] for r in rows]))
    ranks = sorted((r.id, r.rank) for r in chunks.global_rank(df, ["k"], "id", 50).collect())
    assert [r for _, r in ranks] == list(range(1, 401))


def test_pieces_cover_the_whole_text_and_end():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    body = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)
    pieces = documents.split_text(body)
    assert all(len(p) <= 1400 for p in pieces)
    flat = "\n".join(line.rstrip() for line in body.strip().splitlines())
    at = 0
    for p in pieces:
        found = flat.find(p, max(0, at - 200))
        assert 0 <= found <= at + 1
        at = found + len(p)
    assert at == len(flat)
    assert "".join(documents.split_text("ab\n" + "x" * 5000)).count("x") >= 5000
    assert documents.split_text("  \n ") == []


def test_hits_use_substring_semantics(spark):
    q = spark.createDataFrame([(1, "Grow the market"), (2, "zzz")], "query_id bigint, query string")
    c = spark.createDataFrame([(10, "growth in MARKETS"), (11, "regrow"), (12, "nothing")], "chunk_id bigint, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in documents.query_chunk_hits(q, c).collect()}
    assert got == {(1, 10): 1.0, (1, 11): 0.5}


def test_replay_rejects_audited_rows_and_finds_a_cent(spark):
    schema = "account bigint, id bigint, action string, price double, size_pct double, fee double"
    rows = [(1, 1, "BUY", 100.0, 50.0, None), (1, 2, "SELL", 120.0, 80.0, None), (1, 3, "SELL", 90.0, 100.0, None)]
    closing = ledger.closing_state(ledger.replay_orders(spark.createDataFrame(rows, schema)))
    end = closing.first()
    assert end.asset_after == 0.0 and end.avg_cost == 0.0
    seen = spark.createDataFrame([(1, end.cash_after, end.asset_after)], "account bigint, cash double, asset double")
    assert ledger.reconcile(closing, seen).first().state == "CLOSED"
    assert ledger.reconcile(closing, seen.withColumn("cash", F.col("cash") + 0.01)).first().state == "MISMATCH"
    with pytest.raises(Exception, match="cannot be replayed"):
        ledger.replay_orders(spark.createDataFrame([(1, 1, "BUY", 100.0, 50.0, 0.1)], schema)).collect()


def _csv(folder, name, header, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def test_candle_files_check_header_and_prune_by_name(spark, tmp_path):
    names = ",".join(f.name for f in schemas.CANDLE_CSV)
    row = lambda ts: f"{ts},2027,1.0,2.0,0.5,1.5,3.0,A,1m,s"
    _csv(tmp_path / "in", f"{T0}_{T0 + 60}.csv", names, [row(T0), row(T0 + 60)])
    _csv(tmp_path / "in", f"{T0 + 120}_{T0 + 180}.csv", names, [row(T0 + 120)])
    assert files.candle_csv(spark, str(tmp_path / "in")).count() == 3
    some = files.candle_chunks(spark, str(tmp_path / "in"), start=T0 + 100).collect()
    assert [(r.ts, r.window_start) for r in some] == [(T0 + 120, T0 + 120)]
    _csv(tmp_path / "bad", "1_2.csv", names.replace("close", "last"), [row(T0)])
    with pytest.raises(Exception):
        files.candle_csv(spark, str(tmp_path / "bad")).collect()
    _csv(tmp_path / "mixed", "3_4.csv", names, [row(T0), row(T0).replace("3.0", "many"), f"{T0},2027,1.0"])
    good, broken = files.candle_csv_quarantine(spark, str(tmp_path / "mixed"))
    assert good.count() == 1 and broken.count() == 2
    assert sorted(r.wrong[0] for r in broken.collect()) == ["high", "volume"]
    _csv(tmp_path / "named", "today.csv", names, [row(T0)])
    with pytest.raises(Exception, match="start_end"):
        files.candle_chunks(spark, str(tmp_path / "named")).collect()
    known = files.file_hashes(spark, str(tmp_path / "in"), "*.csv")
    kept = spark.createDataFrame(known.toPandas())
    with (tmp_path / "in" / f"{T0}_{T0 + 60}.csv").open("a") as f:
        f.write(row(T0 + 60) + "\n")
    changed = files.changed_files(files.file_hashes(spark, str(tmp_path / "in"), "*.csv"), kept)
    assert [(r.name, r.state) for r in changed.collect()] == [(f"{T0}_{T0 + 60}.csv", "changed")]


def test_archive_rows_are_realigned(spark, tmp_path):
    tail = "1.0,2.0,0.5,1.5,3.0,0,0,1,0,0,x"
    (tmp_path / "a.csv").write_text(f"{T0}000,{tail}\n{(T0 + 81) * 1_000_000},{tail}\n")
    rows, stats = files.archive_csv(spark, str(tmp_path / "a.csv"), "A")
    assert sorted(r.ts for r in rows.collect()) == [T0, T0 + 120]
    assert stats.first().realigned_rows == 1 and stats.first().maximum_realign_seconds == 39


def test_archives_of_all_assets(spark, tmp_path):
    tail = "1.0,2.0,0.5,1.5,3.0,0,0,1,0,0,x"
    for name, late in (("007", 0), ("B", 9)):
        (tmp_path / f"asset={name}").mkdir()
        (tmp_path / f"asset={name}" / "a.csv").write_text(f"{T0 - late}000,{tail}\n")
    rows, stats = files.archive_csv(spark, str(tmp_path), None)
    assert sorted((r.asset, r.ts) for r in rows.collect()) == [("007", T0), ("B", T0)]
    assert sorted((r.asset, r.realigned_rows, r.maximum_realign_seconds) for r in stats.collect()) == [("007", 0, 0), ("B", 1, 9)]
    problem, n = compare(entry_point.queries()["S05_archive_scan_all"](spark, SF_DIR), connect(), entry_point.oracle_sql()["S05_archive_scan_all"])
    assert problem is None and n > 3000


def test_reports_stay_bounded(spark, monkeypatch):
    """No report holds more than one account: their number grows with the accounts."""
    read = []
    monkeypatch.setattr(files, "campaign_reports", lambda s, paths, f=files.campaign_reports: read.append(paths[0]) or f(s, paths))
    sf = SF_DIR
    problem, n = compare(entry_point.queries()["S08_campaign_reports"](spark, sf), connect(sf), entry_point.oracle_sql()["S08_campaign_reports"])
    sizes = [r[0] for r in spark.read.schema(files.REPORT).option("multiLine", True).json(read[0]).select(F.size("results")).collect()]
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", (F.col("event_id") % 3).alias("v")).count().agg(F.max("count")).first()[0]
    assert problem is None and n > 0 and max(sizes) <= e


def test_reports_share_files(spark, monkeypatch, tmp_path):
    """Very many accounts make many reports, not many files."""
    e = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 9000 + T0).cast("timestamp_ntz").alias("ts"), (F.col("id") * 7 % 500).alias("user_id"),
                                F.element_at(F.array(F.lit("view"), F.lit("error"), F.lit("purchase")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
                                (F.col("id") % 11).cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    read = []
    monkeypatch.setattr(files, "campaign_reports", lambda s, paths, f=files.campaign_reports: read.append(paths[0]) or f(s, paths))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    problem, n = compare(entry_point.queries()["S08_campaign_reports"](spark, str(tmp_path)), con, entry_point.oracle_sql()["S08_campaign_reports"])
    reports = spark.read.schema(files.REPORT).option("multiLine", True).json(read[0])
    assert problem is None and n > 1000
    assert reports.count() > 500 and len(set(reports.inputFiles())) <= 4


def test_chunks_leave_in_bounded_batches(spark, monkeypatch):
    """Many short texts go to the splitter together; pieces keep their order and id, whatever its type."""
    import pyarrow as pa
    monkeypatch.setattr(documents, "PIECES", 3)
    bodies = ["a b", None, "  ", "x" * 5000, "é\x1fü \r\n z"]
    ids = [2 ** 60 + 1, None, 3, 4, 2 ** 60 + 2]
    made = [*documents._pieces(iter([pa.record_batch({"id": pa.array(ids), "body": pa.array(bodies)})]))]
    want = [(i, n, p) for i, body in zip(ids, bodies) for n, p in enumerate(documents.split_text(body or ""))]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want and max(b.num_rows for b in made) == 3
    got = documents.chunk_documents(spark.createDataFrame([*zip(ids, bodies)], "k bigint, body string"), "k", "body")
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)


def test_words_of_texts_are_cut_once(spark, monkeypatch):
    """The words that hold a token are written first, so few of them meet the chunks without a shuffle of all words."""
    plans = {}
    monkeypatch.setattr(documents, "materialize", lambda df, name, f=documents.materialize: plans.update({name: df._jdf.queryExecution().toString()}) or f(df, name))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id int, query string")
    chunks_ = spark.createDataFrame([(1, "alphabet soup"), (2, "Gamma, beta and alpha"), (3, None), (4, "none of them")], "chunk_id bigint, text string")
    got = sorted(tuple(r) for r in documents.query_chunk_hits(queries, chunks_).collect())
    assert got == [(1, 1, 1, 2, 0.5), (1, 2, 2, 2, 1.0), (2, 2, 1, 1, 1.0)]
    assert [n for n, p in plans.items() if "regexp_extract_all" in p and "chunk_id" in p] == ["words"] and "BroadcastHashJoin" in plans["found"]


def test_memory_reads_one_row_of_runs(spark):
    """A point finds its runs packed in one row; no row for each point and run is made."""
    rng = random.Random(12)
    action = lambda: rng.choice(["BUY", "SELL"])
    rows = [(rng.randrange(2), i, T0 + rng.randrange(9000), action(), action(), 50.0, None) for i in range(300)]
    logs = spark.createDataFrame(rows, "account int, decision_id bigint, ts bigint, proposed_action string, risk_action string, conviction double, snapshot string")
    out = memory.decision_memory(logs.select("account", "decision_id", "ts"), logs, window=1800, limit=3)
    assert "explode(sequence" not in out._jdf.queryExecution().toString()
    got = {r.decision_id: [(e.repeat_count, e.newest_ts) for e in r.episodes] for r in out.collect()}
    want = {}
    for account, i, ts, *_ in rows:
        runs = []
        for r in sorted((r for r in rows if r[0] == account and r[1] != i and ts - 1800 <= r[2] <= ts), key=lambda r: (r[2], r[1])):
            same = runs and runs[-1][0] == r[3:5]
            runs = [*runs[:-1], (r[3:5], runs[-1][1] + 1, r[2])] if same else [*runs, (r[3:5], 1, r[2])]
        want[i] = [(n, newest) for _, n, newest in runs[-3:]]
    assert got == want


@pytest.mark.parametrize("source_rows", [None, 5])
def test_decision_memory_without_broadcasts(spark, source_rows):
    """Large logs meet by shuffle alone: places in a series keep their partitions, and the answers are the same."""
    rows = [(i % 5, i, T0 + 7 * i, "BUY" if i % 3 else "SELL", "BUY" if i % 7 else "SELL", 50.0, None) for i in range(600)]
    logs = spark.createDataFrame(rows, "account int, decision_id bigint, ts bigint, proposed_action string, risk_action string, conviction double, snapshot string")
    def answers():
        out = memory.decision_memory(logs.select("account", "decision_id", "ts"), logs, window=1800, limit=3, source_rows=source_rows)
        return {r.decision_id: [(e.repeat_count, e.newest_ts) for e in r.episodes] for r in out.collect()}
    known = answers()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = answers()
        twice = ranges.series(logs, [], 600, ("account",))
        placed = twice.place(twice.place(logs.select("account", "ts"), "ts", "a"), "ts", "b").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == known and any(known.values())
    assert sorted((r.ts, r.a, r.b) for r in placed) == [(T0 + 7 * i, i // 5, i // 5) for i in range(600)]


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'
        "<item><title> One   two </title><pubDate>Fri, 15 Jan 2027 08:00:00 +0000</pubDate></item>"
        "<item><title></title></item><item><title>Three</title><dc:date>2027-01-15T08:00:00Z</dc:date></item>"
        "<item><title>Four</title><pubDate>Fri, 15 Jan 2027 08:00:00 GMT</pubDate></item></channel></rss>")
    got = files.rss_items(spark, str(tmp_path / "f.xml"), "src", 2).collect()
    assert sorted((r.headline, r.ts) for r in got) == [("One two", T0), ("Three", T0)]


def test_feeds_of_many_sources(spark, tmp_path):
    """No source is left out, whatever its name; the registered query matches its SQL on a table of 1100 of them."""
    names = [f"s{i}" for i in range(1100)] + ["007", "2027-01-15", "a/b c=d%", None]
    docs = spark.createDataFrame([(i, f"head  {i}", n) for i, n in enumerate(names)], "doc_id bigint, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    problem, n = compare(entry_point.queries()["S07_feed_items"](spark, str(tmp_path)), con, entry_point.oracle_sql()["S07_feed_items"])
    assert problem is None and n == len(names)
    for name in ("a", "b"):
        (tmp_path / "feeds" / f"source={name}").mkdir(parents=True)
        (tmp_path / "feeds" / f"source={name}" / "f.xml").write_text("<channel><item><title>One</title></item><item><title>Two</title></item></channel>")
    assert sorted((r.source, r.headline) for r in files.rss_items(spark, str(tmp_path / "feeds"), None, 1).collect()) == [("a", "One"), ("b", "One")]


def test_upsert_is_idempotent_and_insert_counts(spark, tmp_path):
    schema = "asset string, ts bigint, open double, high double, low double, close double, volume double, ingest_seq bigint"
    rows = [("A", T0 + 60 * i, 1.0, 2.0, 0.5, float(i), 1.0, i) for i in range(5)]
    path = str(tmp_path / "bars")
    for _ in range(2):
        sinks.upsert_bars(spark.createDataFrame(rows + [("A", T0, 1.0, 2.0, 0.5, 9.0, 1.0, 99)], schema), path)
    got = {r.ts: r.close for r in spark.read.parquet(path).collect()}
    assert len(got) == 5 and got[T0] == 9.0
    n = lambda keys: sinks.insert_absent(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int"), str(tmp_path / "n"), "k", ["i"])
    assert (n("aab"), n("abc")) == (2, 1)
    with pytest.raises(ValueError, match="manifest"):
        sinks.import_partition(spark.createDataFrame(rows, schema), path, 6)


def test_reports_and_documents_are_read(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"campaign_id":"c","status":"COMPLETED","config":{"asset":"A","news_mode":"historical"},"results":[{"variant":"v","window_id":"w",'
                                     '"timestamp":5,"status":"OK","llm_action":"BUY","risk_action":"HOLD","horizons":{"5":{"maturity":"matured","risk":{"status":"good","directional_edge_after_cost_pct":0.5}}}}]}')
    path = str(tmp_path / "r.json")
    rows = files.report_horizons(files.campaign_reports(spark, [path, path])).collect()
    assert [(r.mode, r.horizon_min, r.risk_status, r.edge_pct) for r in rows] == [("historical", 5, "good", 0.5)]
    (tmp_path / "d.md").write_text("intro\n# Title here\nbody")
    doc = files.text_documents(spark, str(tmp_path / "d.md"), "study_note").first()
    assert (doc.title, doc.source_type) == ("Title here", "study_note")


def test_copy_counts(spark):
    a, b = spark.range(3), spark.range(4)
    diff = sinks.count_differences({"x": a, "y": a}, {"x": a, "y": b, "z": b}).collect()
    assert sorted((r.table, r.left_rows, r.right_rows) for r in diff) == [("y", 3, 4), ("z", None, 4)]
    assert sinks.copy_columns(a.withColumn("q", F.lit(1)), ["q", "zz"]).columns == ["q"]


def test_a_failed_publication_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.range(5)
    sinks.publish_table(good, path)
    held = sinks.read_published(spark, path)
    broken = good.select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish_table(broken, path)
    assert sinks.read_published(spark, path).count() == 5
    sinks.publish_table(spark.range(7), path, keep=3)
    assert sinks.read_published(spark, path).count() == 7 and held.count() == 5
    for n in (8, 9):
        sinks.publish_table(spark.range(n), path, keep=1)
    assert sinks.read_published(spark, path).count() == 9 and len(sinks.versions(spark, path)) == 1


def opened_files(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()))


def test_chunk_files_are_opened_by_window(spark, tmp_path):
    names = schemas.CANDLE_CSV.names
    rows = [(T0 + 60 * i, "x", 1.0, 2.0, 0.5, 1.5, 3.0, a, "1m", "s") for i in range(100) for a in "AB"]
    path = str(tmp_path / "c")
    n = sinks.write_chunks(spark.createDataFrame(rows, schemas.CANDLE_CSV).select(*names), path, 600)
    assert n == len(list((tmp_path / "c").glob("*_*.csv"))) and opened_files(files.candle_chunks(spark, path)) == n
    some = files.candle_chunks(spark, path, T0 + 700, T0 + 1300)
    first, last = (T0 + 700) // 600, (T0 + 1300) // 600
    assert opened_files(some) == last - first + 1 and {r.ts for r in some.collect()} == {t for t in range(T0, T0 + 6000, 60) if T0 + 700 <= t <= T0 + 1300}


def test_insert_reads_the_partitions_of_its_keys(spark, tmp_path):
    path, frame = str(tmp_path / "k"), lambda keys: spark.createDataFrame([(f"k{k}", k) for k in keys], "k string, i int")
    assert sinks.insert_absent(frame(range(500)), path, "k", ["i"]) == 500
    stored = spark.read.parquet(path)
    asked = frame([3, 4]).withColumn(sinks.KEY_PART, F.pmod(F.xxhash64("k"), F.lit(sinks.KEY_PARTS)).cast("int"))
    held = stored.filter(F.col(sinks.KEY_PART).isin([r[0] for r in asked.select(sinks.KEY_PART).distinct().collect()])).select("k")
    assert opened_files(held) <= 2 and sinks.keys_of(stored, "k", asked).filter("k in ('k3', 'k4')").count() == 2
    assert sinks.insert_absent(frame([3, 4, 900]), path, "k", ["i"]) == 1 and spark.read.parquet(path).count() == 501


def test_label_tables_are_published_whole(spark, tmp_path):
    labels = spark.createDataFrame([("A", T0, 15, 2), ("A", T0, 60, -1)], "asset string, ts bigint, horizon int, label int")
    for _ in range(2):
        sinks.write_labels(labels, str(tmp_path / "l"), "abc")
    got = sinks.read_published(spark, str(tmp_path / "l")).filter("horizon = 60").collect()
    assert [(r.label, r.source_fingerprint) for r in got] == [(-1, "abc")]
    sinks.write_table(labels.withColumn("asset", F.lit('x,"y"')), str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert {r.asset for r in back} == {'x,"y"'}


@pytest.mark.parametrize("keys", [("asset",), ()])
@pytest.mark.parametrize("n", [1, 3, 700])
def test_trailing_context_is_the_newest_rows_so_far(spark, keys, n):
    rnd = random.Random(3)
    right = [(a, rnd.randrange(-500, 5000), i, float(i)) for a in "AB" for i in range(150)] + [("A", 100, 1000 + i, 0.0) for i in range(20)]
    left = [(a, rnd.randrange(-900, 9000), i) for a in "ABC" for i in range(60)]
    bars = spark.createDataFrame(right, "asset string, ts long, k int, v double")
    found = asof.trailing_context(spark.createDataFrame(left, "asset string, ts long, id int"), bars, n, ["k", "v"], 100, keys, order=("k",))
    got = {(r.asset, r.id): [tuple(x) for x in r.tail] for r in found.collect()}
    for asset, at, i in left:
        seen = sorted(r[1:] for r in right if (not keys or r[0] == asset) and r[1] <= at)
        assert got[asset, i] == seen[-n:]
