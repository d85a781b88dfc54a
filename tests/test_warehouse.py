"""Keys of several columns, layout in place of indexes, scripts in both dialects, breakdowns from one pass, a whole run."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import breakdowns, profile, quality, warehouse
from millrace.operators.kpis import Measure
from millrace.plans import catalog, charts, kpi_match, project
from millrace.plans.catalog import Keys, Link, as_frame, describe, from_frame
from millrace.plans.design import design, keys_script, reclassified, tables_script
from millrace.plans.graph import Edge, edges, walks
from millrace.sources import jdbc, sandbox

KEYS = {
    "offer": Keys(("part", "shop"), {"part": ("part", "id")}),
    "part": Keys(("id",)),
    "sale": Keys(("no",), {}, (Link(("p", "s"), "offer", ("part", "shop")),)),
}


@pytest.fixture(scope="module")
def tabs(spark):
    return {
        "offer": spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "part int, shop int, title string"),
        "part": spark.createDataFrame([(1, "nut"), (2, "bolt")], "id int, name string"),
        # The pair (2, 2) is no offer, though each of its values occurs in one.
        "sale": spark.createDataFrame([(1, 1, 1, 10.0), (2, 1, 2, 20.0), (3, 2, 2, 30.0), (4, None, 2, 40.0), (5, 2, 1, 50.0), (6, 9, 1, 60.0)], "no int, p int, s int, amount double"),
    }


@pytest.fixture(scope="module")
def metas(tabs):
    return catalog.discover(tabs, KEYS)


def test_composite_keys_in_graph_and_catalogue(spark, metas):
    assert edges(metas)["sale"] == [Edge("sale", "p", "offer", "part", (("s", "shop"),))]
    assert Edge("offer", "part", "sale", "p", (("shop", "s"),)) in edges(metas)["offer"]
    assert [w[-1].target for fresh in walks(metas, "sale", 3) for w in fresh] == ["offer", "part"]
    frame = as_frame(spark, metas)
    assert from_frame(frame) == sorted(metas, key=lambda t: t.name)
    assert catalog.overview(frame).first()["foreign_key_count"] == 2
    assert "FOREIGN KEY (p, s) REFERENCES offer (part, shop)" in catalog.create_statement(next(t for t in metas if t.name == "sale"))


def test_joins_and_orphans_take_the_whole_key(tabs, metas):
    way = next(w for fresh in walks(metas, "sale", 3) for w in fresh if w[-1].target == "part")
    path = breakdowns.Path(way, "part", ("name",))
    got = breakdowns.by_path(tabs, "sale", Measure("SUM", "amount"), path).collect()
    assert [tuple(r) for r in got] == [("bolt", 50.0), ("nut", 30.0)]
    assert warehouse.orphans(tabs["sale"], ("p", "s"), tabs["offer"], ("part", "shop")).first()[0] == 2
    assert warehouse.orphans(tabs["sale"], "p", tabs["offer"], "part").first()[0] == 1
    d = design(metas, {"sale": "fact", "offer": "dimension", "part": "dimension"})
    checks = {(r["check"], r["table_name"]): (r["detail"], r["value"], r["status"]) for r in warehouse.validate(tabs, d).collect()}
    assert checks["orphans", "fact_sale"] == ("(p, s) -> dim_offer.(part, shop)", 2, "error") and checks["unique_key", "dim_offer"][2] == "passed"
    assert next(p for p in d.parts if p.source == "sale").measures == ("amount",)


def test_declared_keys_of_several_columns(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for sql in (
        "CREATE TABLE part (id INT NOT NULL CONSTRAINT part_pk PRIMARY KEY)",
        "CREATE TABLE offer (shop INT NOT NULL, part INT NOT NULL REFERENCES part(id), code INT NOT NULL CONSTRAINT one_code UNIQUE, CONSTRAINT offer_pk PRIMARY KEY (part, shop))",
        "CREATE TABLE sale (nr INT NOT NULL PRIMARY KEY, a INT, b INT, c INT, d INT, CONSTRAINT first_offer FOREIGN KEY (a, b) REFERENCES offer (part, shop), CONSTRAINT second_offer FOREIGN KEY (c, d) REFERENCES offer (part, shop))",
    ):
        connection.createStatement().execute(sql)
    connection.close()
    keys = jdbc.declared_keys(spark, url, "APP")
    assert keys["SALE"].composite == (Link(("A", "B"), "OFFER", ("PART", "SHOP")), Link(("C", "D"), "OFFER", ("PART", "SHOP"))) and not keys["SALE"].foreign
    assert keys["OFFER"] == Keys(("PART", "SHOP"), {"PART": ("PART", "ID")})
    told = jdbc.constraints(spark, url, "SALE", "APP")
    assert ("foreign key", "SECOND_OFFER", ("C", "D"), "OFFER", ("PART", "SHOP")) in told and told[0][0] == "primary key"
    assert ("unique", ("CODE",)) in {(c[0], c[2]) for c in jdbc.constraints(spark, url, "OFFER", "APP")}


def test_layout_needs_no_shuffle_and_reads_its_months(spark, sf):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders")}
    d = design(catalog.discover(frames, catalog.BENCH_KEYS), {"orders": "fact", "customer": "dimension"})
    assert warehouse.layout(d, frames) == {"dim_customer": (("c_custkey",), None), "fact_orders": (("o_custkey",), "o_orderdate")}
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        assert set(warehouse.materialise(spark, frames, d, "laid", 4).values()) == {"created"}
        spark.conf.set(limit, "-1")
        fact = spark.table("laid.fact_orders").where(F.col(warehouse.MONTH) == "1996-03-01")
        joined = fact.join(spark.table("laid.dim_customer"), F.col("o_custkey") == F.col("c_custkey"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(dw_month" in plan
        assert joined.count() == frames["orders"].where("date_trunc('month', o_orderdate) = '1996-03-01'").count()
        assert all("dw_month=1996-03-01" in f for f in fact.inputFiles())
    finally:
        spark.conf.set(limit, before)
        spark.sql("DROP DATABASE IF EXISTS laid CASCADE")


def test_scripts_run_in_a_database(tabs, metas):
    d = design(metas, {"sale": "fact", "offer": "dimension", "part": "dimension"})
    con = duckdb.connect()
    con.execute("CREATE SCHEMA src")
    for name, df in tabs.items():
        frame = df.toPandas()  # noqa: F841
        con.execute(f"CREATE TABLE src.{name} AS SELECT * FROM frame")
    con.execute(tables_script(d, metas, "made", "src", "duckdb"))
    con.execute(keys_script(d, metas, "made", "duckdb"))
    assert con.execute("SELECT count(*) FROM made.fact_sale WHERE dw_created_at IS NOT NULL").fetchone() == (6,)
    assert {r[0] for r in con.execute("SELECT index_name FROM duckdb_indexes()").fetchall()} == {"idx_dim_offer_pk", "idx_dim_part_pk", "idx_fact_sale_p_s"}
    with pytest.raises(duckdb.ConstraintException):
        con.execute("INSERT INTO made.dim_part SELECT * FROM made.dim_part")
    told = keys_script(d, metas, "made", "postgres")
    assert 'ALTER TABLE "made"."dim_offer" ADD PRIMARY KEY ("part", "shop");' in told and 'CREATE INDEX "idx_fact_sale_p_s" ON "made"."fact_sale" ("p", "s");' in told
    with pytest.raises(ValueError):
        keys_script(d, metas, "made", "spark")


def test_a_table_called_otherwise(metas):
    one, told = reclassified(metas, {}, "part", "fact")
    two, told = reclassified(metas, told, "offer", "dimension")
    assert {p.source: p.kind for p in two.parts}["part"] == "fact" and told == {"part": "fact", "offer": "dimension"} and one.parts
    for wrong in (("part", "view"), ("nothing", "fact")):
        with pytest.raises(ValueError):
            reclassified(metas, {}, *wrong)


def test_one_pass_gives_what_single_breakdowns_give(spark, sf):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    frames["customer"] = frames["customer"].where("c_custkey % 5 > 0")  # some orders reach no customer
    metas = catalog.discover(frames, catalog.BENCH_KEYS)
    paths = tuple(charts.dimension_paths(metas, "orders"))
    asked = {"n": Measure("COUNT"), "sum": Measure("SUM", "o_totalprice", filter="o_orderstatus = 'F'"), "people": Measure("COUNT_DISTINCT", identifier="o_custkey")}
    made = breakdowns.by_all(frames, "orders", asked, ("o_orderdate",), ("o_orderpriority",), paths, 7)
    assert made._jdf.queryExecution().executedPlan().toString().count("orders.parquet") <= 2  # one scan for each half of the union
    got = {}
    for r in made.collect():
        got.setdefault((r["measure"], r["dimension"]), []).append((r["place"], r["label"] if r["period"] is None else r["period"], r["value"]))
    for name, m in asked.items():
        want = {"o_orderdate": breakdowns.by_month(frames["orders"], m, "o_orderdate"), "o_orderpriority": breakdowns.by_column(frames["orders"], m, "o_orderpriority", 7)}
        want |= {p.table: breakdowns.by_path(frames, "orders", m, p, 7) for p in paths}
        for dimension, df in want.items():
            assert sorted(got[name, dimension]) == [(k + 1, *r) for k, r in enumerate(map(tuple, df.collect()))], (name, dimension)


def test_a_failing_table_is_a_stub_in_the_profile(spark):
    def lost():
        return spark.read.parquet("/no/such/place")

    good = spark.createDataFrame([(1, "1"), (1, "1"), (2, None)], "id int, t string")
    columns, whole = profile.profile_each(spark, {"good": good, "lost": lost, "broken": good.select(F.raise_error(F.lit("down")).alias("e"))})
    told = {r["table_name"]: r for r in whole.collect()}
    assert told["good"]["error"] is None and told["good"]["duplicate_count"] == 1
    assert all(told[t]["error"] and told[t]["total_count"] == 0 for t in ("lost", "broken"))
    assert sorted(map(tuple, columns.collect())) == sorted(map(tuple, profile.profile_all({"good": good})[0].select(*columns.columns).collect()))
    assert quality.scores(columns, whole).first()["uniqueness"] == pytest.approx(66.67)


def test_customers_are_who_the_words_say(spark):
    df = spark.createDataFrame([(1, 1, 5.0)], "subscriber_id int, account_id int, amount double")
    for column, found in (("subscriber_id", True), ("account_id", False)):
        own = df.select(column, "amount")
        metas = [describe("sale", own)]
        match = kpi_match.Match(kpi_match.DOMAINS["retail"][0], "sale", Measure("SUM", "amount"), 90)
        assert any(c.form == "segmentation" for c in charts.candidates([match], metas, {"sale": own})) == found


def test_dashboard_is_computed_anew(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    metas = catalog.discover({"orders": orders}, catalog.BENCH_KEYS)
    matches = [kpi_match.Match(kpi_match.DOMAINS["retail"][0], "orders", Measure("SUM", "o_totalprice"), 90, value=1.0, status=s) for s in ("approved", "recommended")]
    half = orders.where("o_orderkey % 2 = 0")
    new, shown = charts.refreshed(matches, metas, {"orders": half}, {"kpi0_timeseries": charts.Setting("kpi0_timeseries", hidden=True)})
    assert new[0].value == pytest.approx(half.agg(F.sum("o_totalprice")).first()[0]) and new[1].value == 1.0
    assert shown and "kpi0_timeseries" not in {c.key for c in shown}
    with pytest.raises(ValueError):
        charts.refreshed(matches[1:], metas, {"orders": half})


def test_sandbox_knows_its_last_sync(spark):
    assert sandbox.last_sync(spark, "nowhere") is None
    try:
        spark.sql("CREATE DATABASE bare")
        assert sandbox.last_sync(spark, "bare") is None and sandbox.total_rows(spark, "bare") == 0
        sandbox.load(spark, "synced", {"a": spark.range(4), "b": spark.range(3)})
        first = sandbox.last_sync(spark, "synced")
        sandbox.load(spark, "synced", {"a": spark.range(5)})
        assert sandbox.last_sync(spark, "synced") > first and sandbox.total_rows(spark, "synced") == 8
    finally:
        for name in ("bare", "synced"):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_a_whole_run_cleans_builds_and_validates(spark, sf, tmp_path):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "nation")}
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    frames["orders"] = orders.unionByName(orders.where("o_orderkey % 10 = 0"))
    try:
        waiting, _ = project.run_all(spark, "waits", frames, catalog.BENCH_KEYS, str(tmp_path / "a"))
        assert project.stage_status(waiting)["cleaning"] == "requires_review" and "pending" in waiting.steps
        done, shown = project.run_all(spark, "done", frames, catalog.BENCH_KEYS, str(tmp_path / "b"), accept=("impute_median",))
        assert {s.operation for s in done.applied} == {"drop_duplicates", "impute_median"} and set(done.steps) == {"applied"}
        assert done.approved and {status for _, status in done.made} == {"created"} and {c[4] for c in done.checks} == {"passed"}
        fact = spark.table("done_warehouse.fact_orders")
        median = next(s.value for s in done.applied if s.operation == "impute_median")
        assert fact.where("o_totalprice IS NULL").isEmpty() and fact.count() == orders.count()
        assert fact.where(F.col("o_orderkey") % 3 == 0).select("o_totalprice").distinct().collect() == [(median,)]
        value = {m.kpi.name: m.value for m in done.kpis}
        assert value["Total Transactions"] == orders.count() and value["Total Revenue"] == pytest.approx(fact.agg(F.sum("o_totalprice")).first()[0]) and shown
        told = project.stage_status(done)
        assert told["warehouse"] == told["cleaning"] == told["dashboard"] == "completed"
    finally:
        for name in ("waits_warehouse", "done_warehouse"):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_dashboard_is_cut_from_one_pass(spark, sf, monkeypatch):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "customer", "nation")}
    metas = catalog.discover(frames, catalog.BENCH_KEYS)
    kpis = kpi_match.DOMAINS["retail"]
    matches = [kpi_match.Match(kpis[0], "orders", Measure("SUM", "o_totalprice"), 90), kpi_match.Match(kpis[1], "orders", Measure("COUNT"), 90)]
    asked = charts.candidates(matches, metas, frames)
    cut = charts.one_pass([c for c in asked if c.cut], frames)
    assert len(cut) == len([c for c in asked if c.cut]) >= 4
    for c in asked:
        if c.cut:
            assert cut[c.key] == charts.to_rows(c.frame()), c.key
    shown = charts.dashboard(matches, metas, frames)
    monkeypatch.setattr(charts, "one_pass", lambda *_: {})
    assert [(c.key, c.rows, c.kind) for c in shown] == [(c.key, c.rows, c.kind) for c in charts.dashboard(matches, metas, frames)]
