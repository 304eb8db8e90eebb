"""Text, statement and table operators on small inputs with known results."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions.values import DEFAULT_RISK
from ledgerline.operators import graph as G
from ledgerline.operators import maintain as M
from ledgerline.operators import statements as P
from ledgerline.operators import text as T
from ledgerline.sources import sinks, stored


def test_chunks_overlap_within_pages_and_are_numbered_densely(spark):
    pages = [Row(page_number=1, text="Revenue grew by a lot. " * 30), Row(page_number=2, text="Costs of materials went up in the second half. " * 30)]
    rows = spark.createDataFrame([(1, 1, pages)], "document_id long, company_id long, pages array<struct<page_number: int, text: string>>")
    got = T.chunks(rows, size=500, overlap=100).orderBy("chunk_index").collect()
    assert len(got) >= 3 and got[0].page_start == 1
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert all(50 <= len(r.content) <= 500 and r.page_start == r.page_end for r in got)


def test_risks_by_first_page_with_cap_and_default(spark):
    pages = spark.createDataFrame([(1, 3, "Regulatory compliance matters."), (1, 5, "Forex moves. Data security."), (1, 6, "More forex."), (1, 2, "Table of contents: forex"), (2, 1, "Nothing here.")], "document_id long, page_number int, text string")
    got = T.tag_risks(pages)
    assert [(r.risk.split(" ")[0], r.page_number) for r in got.orderBy("n").collect()] == [("Regulatory", 3), ("Cybersecurity", 5), ("Foreign", 5)]
    assert got.select("n").distinct().count() == 3
    assert T.tag_risks(pages, most=1).count() == 1
    docs = spark.createDataFrame([(1, "T1"), (2, "T2")], "document_id long, ticker string")
    assert [r.document_id for r in T.with_default_risk(got, docs).where(F.col("risk") == DEFAULT_RISK).collect()] == [2]


def test_snippets_are_cut_at_200(spark):
    pages = spark.createDataFrame([(1, 1, "x " * 100 + "litigation " + "y " * 300)], "document_id long, page_number int, text string")
    text = T.tag_risks(pages).first().description
    assert len(text) == 200 and text.endswith("...")


def test_guidance_takes_the_first_category_once(spark):
    long = "We expect capital expenditure and debt reduction to go together over the coming two years. Short. "
    chunks = spark.createDataFrame([(1, 9, 1, 0, 4, 4, long), (2, 8, 1, 0, 4, 5, long), (3, 8, 1, 1, 1, 1, "Short text.")], "id long, document_id long, company_id long, chunk_index int, page_start int, page_end int, content string")
    rows = T.top_guidance(T.dedup_guidance(T.classify_guidance(T.sentences(chunks)))).collect()
    assert [(r.document_id, r.category, r.page, r.guidance_id) for r in rows] == [(9, "CapEx & Capital Allocation", "Page 4", "1_0")]


PAGE = """<table><thead><tr><th></th><th>Mar 2021</th><th class="x">Mar 2022</th><th>Mar 2023</th><th>Mar 2024</th><th>Mar 2025</th><th>TTM</th></tr></thead>
<tbody><tr><td>Sales&nbsp;+</td><td>10</td><td>1,00,000</td><td>0</td><td>1,46,000</td><td>1,53,670</td><td>9</td></tr>
<tr><td>Net Profit</td><td>1</td><td>20</td><td>-</td><td>30</td><td>26,233</td><td>9</td></tr><tr><td>OPM %</td><td>1%</td><td>20%</td><td></td><td>24%</td><td>23%</td><td>9</td></tr></tbody></table>"""


def test_statement_of_the_last_four_years(spark):
    rows = P.growth(P.measures(P.items(spark.createDataFrame([(1, PAGE)], "company_id long, html string")))).orderBy("col_index").collect()
    assert [r.period for r in rows] == ["FY2022", "FY2023", "FY2024", "FY2025"]
    assert float(rows[3].revenue) == 153670e7 and float(rows[3].net_profit) == 26233e7 and float(rows[3].operating_margin) == 0.23
    assert [None if r.revenue_growth is None else float(r.revenue_growth) for r in rows] == [None, -1.0, 0.46, 0.0525]
    assert rows[1].net_profit is None and rows[0].eps is None


def test_money_and_percent_forms(spark):
    rows = spark.sql("select cast(v as decimal(20,4)) v from values (12345678901.0), (-2500000000.0), (0.05), (null) t(v)")
    got = rows.select(S.money_short(F.col("v"), F.lit("INR")).alias("a"), S.money_short(F.col("v"), F.lit("USD")).alias("b"), S.money_adaptive(F.col("v")).alias("c"), S.percent(F.col("v"), "+").alias("d")).collect()
    assert [r.a for r in got] == ["₹1234.6Cr", "₹-250.0Cr", "₹0.0Cr", "N/A"]
    assert [r.b for r in got] == ["$12.3B", "$-2.5B", "$0.0B", "N/A"]
    assert [r.c for r in got] == ["12.35B", "-2.50B", "0.05", None]
    assert got[2].d == "+5.0%" and got[3].d == "N/A"


def test_quotients_round_as_doubles(spark, tmp_path):
    """The SQL divides doubles: a decimal half whose double lies below it goes down."""
    from ledgerline.plans.catalog import ORACLES, QUERIES

    from .oracle import check

    values = [("12951.55", 1000, "12.9515"), ("-16894.85", 1000, "-16.8948"), ("10000.45", 1000, "10.0005"), ("0.00", 3, "0.0000"), (None, 3, None), ("1.00", 3, "0.3333")]
    rows = spark.createDataFrame([(v, n) for v, n, _ in values], "v string, n int").select(S.ratio(F.col("v").cast("decimal(20,4)"), F.col("n")).alias("q"))
    assert [None if r.q is None else str(r.q) for r in rows.collect()] == [q for _, _, q in values]
    for name in ("documents", "conversations", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.createDataFrame([(i, 10 + i // 2, f"{1995 + i}-05-05", 123468.15) for i in range(6)], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double")
    orders.withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(0, 129515.50, 0.1), (1, 168948.50, 0.1), (2, 1005.00, 1.0), (3, 1015.00, 1.0), (4, 1145.00, 1.0), (5, 8015.00, 1.0)]  # profits whose thousandth is a half
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("csv_files", "node_properties", "table_unpivot"):
        check(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_upsert_keeps_what_is_not_given(spark):
    stored = spark.createDataFrame([(1, "Acme", "ACM", "Steel", "{}", 5)], "id long, name string, ticker string, sector string, ratios_json string, nation int")
    kind = "ticker string, name string, sector string, ratios_json string, new_id long"
    incoming = spark.createDataFrame([("acm", "x", "", '{"a": "1"}', 7), (None, "ACME", "Tin", None, 8), ("NEW", "Newco", "Oil", None, 9), ("new", "Other", None, "{}", 10), (None, "newco", "Gas", None, 11)], kind)
    assert [r.match_id for r in M.match_companies(incoming, stored).orderBy("new_id").collect()] == [1, 1, None, None, None]
    got = {tuple(r) for r in M.upsert_companies(stored, incoming).collect()}
    assert got == {(1, "Acme", "ACM", "Tin", '{"a": "1"}', 5), (9, "Newco", "NEW", "Gas", "{}", None)}
    assert {tuple(r) for r in M.upsert_companies(stored, incoming.limit(0)).collect()} == {(1, "Acme", "ACM", "Steel", "{}", 5)}


def test_statuses_keep_their_times(spark):
    docs = spark.createDataFrame([(1, "processed", "a"), (2, "extracting", None), (3, "pending", None), (4, None, "d")], "id long, status string, processed_at string")
    changes = spark.createDataFrame([(2, "storing", "t1"), (2, "processed", "t2"), (3, "storing", "t1"), (9, "failed", "t1")], "id long, new_status string, at string")
    assert sorted(map(tuple, M.set_status(docs, changes).collect()), key=str) == [(1, "processed", "a"), (2, "processed", "t2"), (3, "storing", None), (4, None, "d")]


def test_intake_of_twins_and_rows_without_a_hash(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "c"), (7, "d")], "id long, file_hash string")
    stored = spark.createDataFrame([("b", "failed"), ("c", "extracting"), ("d", "processed"), ("d", "failed"), (None, "processed")], "file_hash string, status string")
    assert {r.id: r.first_id for r in M.first_of_hash(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {r.id: r.action for r in M.plan_intake(rows, stored).collect()} == {1: "new", 2: "reuse", 3: "new", 4: "new", 5: "reprocess", 6: "busy", 7: "reuse"}


def test_links_in_any_quotes(spark):
    html = """<a href="one">1</a><a class=x href='two' title='T'>2</a><a title="q" href=three>3</a><a data-href="no">4</a>"""
    got = spark.createDataFrame([(html,)], "html string").select(F.inline(P.anchors(F.col("html")))).collect()
    assert [(r.href, r.title) for r in got] == [("one", ""), ("two", "T"), ("three", "q"), ("", "")]


def test_graphs_and_csv_from_files(spark, tmp_path):
    nodes = spark.createDataFrame([("comp_1", "A", "company", "c", 1, 1, '{"name":"é \\"x\\""}'), ("fin_1", "F", "metric", "c", 2, 1, None)], sinks.NODE)
    edges = spark.createDataFrame([("x", "comp_1", "fin_1", "REPORTED_FINANCIALS", 1, "{}"), ("y", "comp_1", "gone", "EVIDENCES", 1, "{}")], sinks.EDGE)
    for _ in range(2):  # saving again replaces the files
        sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = sinks.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.select(*nodes.columns).collect())) == sorted(map(tuple, nodes.collect()))
    assert [r.id for r in e.collect()] == ["comp_1_REPORTED_FINANCIALS_fin_1"]
    summary = spark.read.json(str(tmp_path / "g/summary")).first()
    assert (summary.version, summary.summary.total_nodes, summary.summary.total_edges) == ("2.0", 2, 2)
    rows = spark.createDataFrame([("T1", "FY1", 'a"b,c'), ("T2", "FY2", None)], "ticker string, period string, currency string")
    sinks.write_csv(rows, str(tmp_path / "c"), ["period", "currency"])
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).select("ticker", "period").collect()} == {("T1", "FY1"), ("T2", "FY2")}
    sinks.write_csv(rows.limit(0), str(tmp_path / "n"), ["period", "currency"])
    (file,) = (tmp_path / "n").glob("*.csv")
    assert file.read_text() == "period,currency\n"


def test_each_ticker_has_a_csv_file_of_its_own(spark, tmp_path):
    from ledgerline.plans import catalog, tables  # noqa: F401  the catalog registers first
    from ledgerline.sources.domain import Domain

    back = tables.csv_files(Domain(spark, "/root/testdata/sf0.001"))
    folders = sorted(file.split("/")[-2] for file in back.inputFiles())
    assert folders == sorted(f"ticker={r.ticker}" for r in back.select("ticker").distinct().collect()) and len(folders) > 16
    lines = [("007", "FY1", "USD"), ("A/B", "FY1", "INR"), ("007", "FY2", None), ("A/B", "FY2", "a,b")]
    rows = spark.createDataFrame(lines, "ticker string, period string, currency string").repartition(4)
    sinks.write_csv(rows, str(tmp_path), ["period", "currency"])
    files = list(tmp_path.glob("ticker=*/*.csv"))
    assert len(files) == 2 and all(f.read_text().startswith("period,currency\n") for f in files)
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path), ["period", "currency"]).collect()), key=str) == sorted(lines, key=str)


def test_partitions_are_replaced_and_batches_added(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, part int, v string")
    sinks.append(rows((1, 0, "a"), (2, 1, "a")), table, "part")
    sinks.append(rows((3, 1, "a")), table, "part")
    sinks.append(rows().limit(0), table, "part")
    sinks.replace(rows((4, 1, "b")), table, "part")
    assert {tuple(r) for r in spark.read.parquet(table).select("id", "part", "v").collect()} == {(1, 0, "a"), (4, 1, "b")}


def test_tables_of_a_relational_store(spark):
    """Read in ranges of the key, from an in-memory store; rows without a key aren't lost."""
    url = "jdbc:derby:memory:filings;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(1, 101)] + [(None, "none")], "id long, name string")
    stored.append_table(rows, url, "companies")
    stored.append_table(rows.limit(0), url, "companies")
    got = stored.read_table(spark, url, "companies", rows=30)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0] or 0, r[1]) for r in got.collect()) == sorted((r[0] or 0, r[1]) for r in rows.collect())
    assert [tuple(r) for r in stored.lookup(got, "id", [7, 500]).collect()] == [(7, "n7")]
    stored.append_table(rows.limit(0), url, "nothing")
    assert stored.read_table(spark, url, "nothing").count() == 0


def test_caps_can_be_left_out(spark):
    pages = [Row(page_number=i, text=f"Page {i} speaks of litigation, forex, logistics and of much else besides, at some length.") for i in range(1, 90)]
    rows = spark.createDataFrame([(1, 1, pages)], "document_id long, company_id long, pages array<struct<page_number: int, text: string>>")
    assert T.chunks(rows).count() == 60 and T.chunks(rows, most_pages=None).count() == 89
    each = rows.select("document_id", F.inline("pages"))
    assert T.tag_risks(each, most=2).count() == 2 and T.tag_risks(each, most=None).count() == 3


def test_subgraph_is_the_induced_neighbourhood(spark):
    nodes = spark.createDataFrame([("comp_1", "company"), ("doc_1", "document"), ("fin_1", "metric"), ("risk_1", "risk"), ("fin_2", "metric")], "id string, type string")
    edges = spark.createDataFrame([("comp_1", "doc_1", "ANNUAL_FILING", 0), ("comp_1", "fin_1", "REPORTED_FINANCIALS", 1), ("comp_1", "risk_1", "HAS_RISK", 2), ("doc_1", "fin_1", "EVIDENCES", 3), ("doc_1", "fin_2", "EVIDENCES", 4), ("doc_1", "gone", "EVIDENCES", 5), ("comp_1", "doc_1", "ANNUAL_FILING", 6)], "source string, target string, label string, seq int")
    kept = G.first_edges(G.valid_edges(edges, nodes))
    assert kept.count() == 5
    assert G.subgraph_edges(kept, G.members(kept, nodes)).count() == 4


def test_a_second_intake_of_the_same_files_adds_nothing(spark, tmp_path):
    from ledgerline.streaming.intake import run_intake

    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "doc_id long, text string")
    rows.repartition(1).write.parquet(source)
    assert {r.doc_id for r in run_intake(spark, source, rows.schema, folder)["stored"].collect()} == {1, 3, 4}
    spark.createDataFrame([(9, "b"), (10, "c")], rows.schema).repartition(1).write.mode("append").parquet(source)
    assert {r.doc_id for r in run_intake(spark, source, rows.schema, folder)["stored"].collect()} == {1, 3, 4, 10}
    tables = run_intake(spark, source, rows.schema, folder)
    assert tables["risks"].count() == 4 and {r.document_id for r in tables["logs"].where("stage = 'graph_ingestion'").collect()} == {1, 3, 4, 10}


def test_plain_edges_are_the_first_valid_ones(spark):
    nodes = spark.createDataFrame([("comp_1", "A", "company", 0), ("comp_1", "B", "company", 1), ("doc_1", "D", "document", 0)], "id string, label string, type string, seq int")
    edges = spark.createDataFrame([("comp_1", "doc_1", "FILED", 0), ("comp_1", "doc_1", "FILED", 5), ("comp_1", "gone", "FILED", 0), ("gone", "doc_1", "FILED", 0), ("doc_1", "comp_1", "OF", 0), (None, "doc_1", "FILED", 0)], "source string, target string, label string, seq int")
    last = G.upsert_nodes(nodes)
    got = G.named_edges(edges, last)
    want = G.first_edges(G.valid_edges(edges, last)).drop("id", "seq")
    assert sorted(map(tuple, got.select("source", "target", "label").collect())) == sorted(map(tuple, want.select("source", "target", "label").collect())) == [("comp_1", "doc_1", "FILED"), ("doc_1", "comp_1", "OF")]
    assert {(r.source_label, r.target_label, r.target_type) for r in got.collect()} == {("B", "D", "document"), ("D", "B", "company")}
    assert sorted(map(tuple, G.named_relations(got).collect())) == sorted(map(tuple, G.relations(got.select("source", "target", "label"), last).collect()))


def test_summaries_write_no_properties(spark):
    from ledgerline.plans import catalog, graphs  # noqa: F401  the catalog registers first
    from ledgerline.sources.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    graphs.subgraph_summary(d)
    kept = [x.columns for name, x in d._once.items() if name.startswith(("nodes", "edges", "plain"))]
    assert kept and not any("properties" in columns for columns in kept)


def test_the_inspector_lists_all_stored_properties(spark):
    from ledgerline.plans import catalog, graphs  # noqa: F401  the catalog registers first
    from ledgerline.sources.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    lines = graphs.node_inspect(d).where("direction = '='")
    kept = graphs.kept_nodes(d)
    stored = kept.select("id", F.explode(F.map_keys(F.from_json("properties", "map<string,string>"))).alias("key")).unionByName(kept.select("id", F.lit("type").alias("key")))
    assert sorted(map(tuple, lines.select("node", "label").collect())) == sorted(map(tuple, stored.collect()))
    assert {r.label: r.other for r in lines.where("node = 'comp_1'").collect()}["name"] == "Customer#000000001"
    assert {r.other_label for r in lines.where("node = 'comp_1'").collect()} == {"T1"}


def test_lines_of_some_companies_only_are_summed(spark):
    from ledgerline.sources.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    ids = spark.createDataFrame([(4,), (7,)], "id long")
    some = d.of(ids).yearly()
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in d.yearly().where("company_id in (4, 7)").collect()}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert any("LeftSemi" in line and "l_orderkey" in line for line in plan.splitlines())


def test_nodes_of_named_edges_are_never_broadcast(spark):
    nodes = spark.createDataFrame([("comp_1", "A", "company"), ("doc_1", "D", "document")], "id string, label string, type string")
    edges = spark.createDataFrame([("comp_1", "doc_1", "FILED")], "source string, target string, label string")
    rows = G.named_edges(edges, nodes)
    assert rows.count() == 1 and "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
