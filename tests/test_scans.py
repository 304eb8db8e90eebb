"""Texts are scanned once, sums are of whole cents, and what is whole already isn't written again."""

import duckdb
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.plans import catalog, graphs  # noqa: F401  the catalog registers first
from ledgerline.plans.filings import risk_table
from ledgerline.sources.domain import Domain
from ledgerline.streaming.deltas import Deltas
from ledgerline.streaming.intake import paged

SMALL = "/root/testdata/sf0.001"


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_risks_are_found_in_one_scan_of_the_texts(spark):
    plan = optimized(risk_table(Domain(spark, SMALL)))
    assert "regexp_instr" not in plan and "regexp_replace" not in plan


def test_cents_are_those_of_the_sql(spark):
    values = [0.0, 1.005, -1.005, 2.675, 0.285, 1.115, -0.005, 12.95155, 99999.99, None]
    want = [r[0] for r in duckdb.connect().execute(f"select (x::double::decimal(12,2) * 100)::bigint from (values {', '.join(f'({v})' if v is not None else '(null)' for v in values)}) t(x)").fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", S.units(F.col("x"), 2).alias("u"))
    assert [r.u for r in rows.orderBy("i").collect()] == want
    assert "decimal" not in optimized(Domain(spark, SMALL).yearly()).split("Window")[0].split("Join")[-1]  # below the join of orders and lines


def test_plain_rows_are_those_of_the_plain_graph_and_read_no_document_text(spark):
    d = Domain(spark, SMALL)
    rows = graphs.plain_rows(d)[1]
    assert not any(name.startswith("edges_of") or name == "documents" for name in d._once)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, graphs.plain_graph(d)[1].select(rows.columns).collect()))


def test_arriving_texts_are_squeezed_once(spark):
    rows = spark.createDataFrame([(1, "h", 3, "processed", "a \n b" * 900), (2, "i", 1, "failed", "x")], "doc_id long, file_hash string, n_bytes long, status string, text string")
    got = paged(rows)
    assert optimized(got).count("regexp_replace") == 1
    one, two = got.orderBy("doc_id").collect()
    assert [len(p.text) for p in one.pages] == [2000, 700] and one.pages[0].text.startswith("a ba b") and two.pages is None


def test_a_lone_delta_without_a_fold_is_not_written_again(spark, tmp_path):
    table = Deltas(spark, str(tmp_path / "t"), "id long", F.col("id"), 4)
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    ids = lambda: sorted(r.id for r in table.read().collect())
    table.append(frame(*range(20)), 0)
    table.compact()
    assert table._current() == {"base": "delta-0", "recent": None, "upto": 0} and ids() == list(range(20))
    table.append(frame(50), 0)  # folded already: changes nothing
    table.append(frame(30), 1)
    table.compact()
    table.compact()
    assert ids() == [*range(20), 30] and max(table.files().values()) <= 2
    for number in range(2, 5):
        table.append(frame(*range(100 * number, 100 * number + 30)), number)
        table.compact()
        assert max(table.files().values()) <= 2
    assert len(ids()) == 21 + 90 and len(set(ids())) == 111


def test_a_batch_of_the_graph_stream_has_a_file_for_each_core(spark, monkeypatch):
    from ledgerline.plans import streams

    seen = {}

    def run(session, source, schema, folder, files_per_batch=64, **_):
        seen["files"], seen["batch"] = len(session.read.parquet(source).inputFiles()), files_per_batch
        nodes = session.createDataFrame([], "id string, type string, label string")
        return nodes, nodes

    monkeypatch.setattr(streams, "run_graph", run)
    streams.graph_deltas(Domain(spark, SMALL))
    assert seen["batch"] == 4 and 10 < seen["files"] <= 40


def test_runs_hash_alike_wherever_they_are():
    import numpy as np

    from ledgerline.llm import line_dedup as L

    words = np.random.default_rng(5).integers(0, 2**63, 400, dtype=np.uint64)
    words[300:360] = words[10:70]
    for n in (12, 50):
        runs = L._runs(L._sums(words), n)
        assert (runs[300 : 361 - n] == runs[10 : 71 - n]).all() and len(runs) == 401 - n
        assert len(np.unique(runs)) == 401 - n - (61 - n)
        swapped = words[:n][::-1].copy()
        assert L._runs(L._sums(swapped), n)[0] != runs[0] and len(L._runs(L._sums(words[: n - 1]), n)) == 0


def test_a_bitmap_takes_as_many_jobs_for_many_shuffle_partitions_as_for_few(spark):
    import numpy as np

    from ledgerline.llm.shared import bitmap, in_bitmap

    jobs, settings = {}, {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    keys = spark.range(0, 3_000_000, 1000).select(F.when(F.col("id") > 0, F.col("id") * 1_000_003).alias("key"))
    try:
        for n in ("4", "40"):
            for k, v in (settings | {"spark.sql.shuffle.partitions": n}).items():
                spark.conf.set(k, v)
            spark.sparkContext.setJobGroup(f"bitmap {n}", "")
            bits = bitmap(keys, "key")
            jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bitmap {n}"))
            assert in_bitmap(bits, np.arange(1000, 3_000_000, 1000) * 1_000_003).all() and np.unpackbits(bits).sum() <= 2999
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs["4"] == jobs["40"] <= 3
