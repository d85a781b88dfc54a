"""Stored state, the project's stages, charts as chosen, decisions, and one run from sources to dashboard."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import formats
from millrace.operators import kpis, profile, relationships, state, warehouse, workspace
from millrace.operators.kpis import Measure
from millrace.plans import catalog, charts, kpi_match, project
from millrace.plans.catalog import Column, ForeignKey, Keys, Table
from millrace.plans.charts import Chart, Setting
from millrace.plans.design import create_script, design
from millrace.sources import files, jdbc, stored


def snapshot(spark, *tables):
    return state.snapshot_rows([{"table_name": t, "columns": c} for t, c in tables], spark)


ORDERS = ("orders", [{"name": "id", "type": "integer", "nullable": False}, {"column_name": "amount", "data_type": "numeric", "is_nullable": True}])


def test_refresh_stores_only_what_changed(spark, tmp_path):
    at = str(tmp_path)
    one, two = snapshot(spark, ORDERS), snapshot(spark, ORDERS, ("customers", [{"name": "id", "type": "integer", "nullable": False}]))
    assert state.newest(spark, at, "snapshots") is None
    assert state.refresh_catalogue(one, at)[1:] == ("No changes.", True)
    assert state.refresh_catalogue(one, at)[1:] == ("No changes.", False)
    changes, advice, kept = state.refresh_catalogue(two, at)
    assert [(r["change"], r["table_name"], r["severity"]) for r in changes.collect()] == [("table_added", "customers", "info")] and kept and advice == "No action needed."
    changes, advice, kept = state.refresh_catalogue(one, at)
    assert changes.first()["severity"] == "critical" and kept and "Review" in advice
    assert state.versions(spark, at, "snapshots").count() == 3 and state.newest(spark, at, "snapshots").count() == 2


def test_profiles_are_stored_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    state.store(profile.facts(df), str(tmp_path), "profiles")
    state.store(profile.facts(df.limit(1)), str(tmp_path), "profiles")
    assert {r["column_name"]: r["total_count"] for r in state.newest(spark, str(tmp_path), "profiles").collect()} == {"id": 1, "t": 1}


@pytest.mark.parametrize("values", [[], [None, 3.0], [1.0, 2.0, 3.0, 10.0], [5.0] * 9 + [7.0], [float(k * 37 % 1001) for k in range(3000)], [1.0, float("nan"), 2.0]])
def test_exact_medians(spark, values):
    import statistics

    known = [v for v in values if v is not None and v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = [r["median"] for r in profile.medians(df, ["x"]).collect()]
    assert got == ([statistics.median(known)] if known else [])


def test_medians_hold_no_column_in_one_task(spark, sf):
    plan = profile.numbers(spark.read.parquet(f"{sf}/orders.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and " median(" not in plan and "percentile(" not in plan


def test_filtered_kpis_are_one_pass(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    asked = {"all": Measure("COUNT"), "open": Measure("SUM", "o_totalprice", filter="o_orderstatus = 'O'"), "buyers": Measure("COUNT_PER_DISTINCT", None, "o_custkey", "o_orderkey < 100"), "none": Measure("NULL_RATE", "o_orderdate", filter="o_orderkey < 0")}
    made = kpis.batch(orders, asked)
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["name"]: r["value"] for r in made.collect()} == {k: kpis.single(orders, m).first()["value"] for k, m in asked.items()}


def test_a_failing_table_leaves_its_kpis_empty(spark):
    kpi = kpi_match.DOMAINS["retail"][0]
    asked = [kpi_match.Match(kpi, t, Measure("SUM", c), 90) for t, c in (("a", "x"), ("b", "lacking"), ("c", "x"))]
    found = kpi_match.compute(asked, {"a": spark.createDataFrame([(1.0,)], "x double"), "b": spark.range(1)})
    assert [m.value for m in found] == [1.0, None, None]
    old = kpi_match.with_status(found, {0}, "approved")
    assert [m.status for m in kpi_match.regenerated(kpi_match.with_status(old, {1}, "skipped"), asked)] == ["approved", "skipped", "recommended"]
    assert [m.status for m in kpi_match.with_status(old, {0}, "recommended")] == ["recommended"] * 3


def test_relationship_decisions(spark):
    links = spark.createDataFrame([("a", "b_id", "b", "id", 60, "pending"), ("a", "c_id", "c", "id", 55, "pending"), ("d", "b_id", "b", "id", 90, "auto_accepted")], "from_table string, from_column string, to_table string, to_column string, confidence int, status string")
    said = spark.createDataFrame([("a", "c_id", "c", "id", "rejected")], "from_table string, from_column string, to_table string, to_column string, status string")
    assert {r["from_column"] + r["from_table"]: r["status"] for r in relationships.decide(links, said, accept_from=60).collect()} == {"b_ida": "accepted", "c_ida": "rejected", "b_idd": "auto_accepted"}
    assert [r["confidence"] for r in relationships.listed(links).collect()] == [90, 60, 55] and relationships.listed(links, "pending", "name").count() == 2
    assert relationships.signals({"name_score": 71, "overlap_score": 10, "targeted": True, "confidence": 44})["value_overlap"] is False


def test_charts_as_chosen(spark):
    pool = [Chart(k, k.title(), "categorical", "L", "count", "M", lambda: None, ({"label": "a", "value": 1.0},), "bar") for k in "abc"]
    chosen = charts.changed(charts.changed({}, "b", title="Sales", place=0), "b", kind="table", title=None)
    chosen |= {"a": Setting("a", title=" My Custom Title "), "c": Setting("c", hidden=True)}
    assert [(c.key, c.title, c.kind) for c in charts.overlaid(pool, chosen)] == [("b", "Sales", "table"), ("a", "A", "bar")]
    assert charts.meant_title("  ") is charts.meant_title("Untitled") is None and charts.kinds_for("Percentage") == ("donut", "bar", "card") and charts.kinds_for(None) == ("bar", "card", "table")
    made = charts.query_chart(spark, "SELECT id AS k, id * 2 AS v, 'x' AS t FROM range(3)", "k", "v", "Q")
    assert made.rows == tuple({"label": str(k), "value": 2.0 * k} for k in range(3))
    assert charts.query_chart(spark, "SELECT * FROM nothing_here", "k", "v", "Q").kind == "empty"
    assert [r["value"] for r in charts.query_chart(spark, "SELECT 'x' AS k, 'no number' AS v", "k", "v", "Q").rows] == [None]
    with pytest.raises(ValueError, match="no column z"):
        charts.query_chart(spark, "SELECT 1 AS k", "k", "z", "Q")


def test_one_failing_chart_stops_no_other(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    metas = catalog.discover({"orders": orders}, catalog.BENCH_KEYS)
    kpi = kpi_match.DOMAINS["retail"][0]
    found = [kpi_match.Match(kpi, "orders", Measure("SUM", c), 90) for c in ("lacking", "o_totalprice")]
    shown = charts.dashboard(found, metas, {"orders": orders}, most=9)
    assert any(c.kind == "line" for c in shown) and shown[-1].kind == "empty" and "lacking" in shown[-1].error


def test_overview_and_report():
    tables = tuple(Table(n, (Column("id", "integer", primary=True),), k) for k, n in enumerate("zyx"))
    p = project.Project("Shop", connected=True, tables=tables, links=("pending",), score=79)
    seen = project.overview(p)
    assert (seen["status"], seen["current"], seen["progress"], seen["row_count"], seen["quality"]) == ("needs_review", "relationships", 30, 3, (79, "Needs Review"))
    assert project.overview(project.Project("New"))["status"] == "setup_incomplete" and [t[0] for t in seen["tables"]] == list("xyz")
    kpi = kpi_match.DOMAINS["retail"][0]
    done = project.Project("Shop", score=80, kpis=(kpi_match.Match(kpi, "t", Measure("SUM", "x"), 90, 1530.0, "approved"), kpi_match.Match(kpi, "t", Measure("SUM", "y"), 90)))
    made = project.report(done)
    assert made["sections"][1] == ("Key Performance Indicators", "Total Revenue: $1.5K") and made["total_kpis"] == 1 and "Score: 80/100" in made["sections"][0][1]


def test_formats_of_tooltips_and_columns(spark):
    assert [formats.tip_text(*x) for x in ((2.5e6, "currency"), (-1500.0, "count"), (12.0, ""), (0.256, "rate"), (3.14159, "days"))] == ["$2.5M", "-1.5K", "12", "0.3%", "3.14"]
    rows = [(v, u) for v in (None, 0.0, 7.0, -1234.5, 99999.0, 1530.0, 2.48e7, 3.4e8) for u in ("currency", " INR", "%", "days", "count", "ratio", "points", None)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v double, u string").orderBy("k").select(formats.kpi_column(F.col("v"), F.col("u"))).collect()
    assert [r[0] for r in got] == [formats.kpi_text(*r) for r in rows]


def test_csv_beyond_its_first_lines(spark, tmp_path):
    plain = "id;name\n" + "".join(f"{k};plain\n" for k in range(3000))
    (tmp_path / "late.csv").write_bytes(plain.encode() + "3000;café\n".encode("cp1252"))
    (tmp_path / "odd.csv").write_bytes(plain.encode() + b"3000;caf\xe9\x81\n")
    (tmp_path / "lines.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    rows = files.read_csv(spark, str(tmp_path / "late.csv")).where("id = 3000").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(3000, "café")]
    assert files.csv_dialect(spark, str(tmp_path / "odd.csv"))["encoding"] == "latin1"
    assert [r["b"] for r in files.read_csv(spark, str(tmp_path / "lines.csv")).orderBy("a").collect()] == ["two\nlines", "x"]
    taken = files.upload(spark, str(tmp_path / "lines.csv"), str(tmp_path / "landing"), "p1")
    assert taken == files.upload(spark, str(tmp_path / "lines.csv"), str(tmp_path / "landing"), "p1") and files.read_csv(spark, taken).count() == 2
    with pytest.raises(ValueError):
        files.upload(spark, str(tmp_path / "x.exe"), str(tmp_path), "p1")


def test_copy_text(spark, tmp_path):
    (tmp_path / "dump").write_text("1\tone\n2\t\\N\n")
    assert sorted(map(tuple, files.read_copy_text(spark, str(tmp_path / "dump"), "id int, t string").collect())) == [(1, "one"), (2, None)]


def test_stored_tables_and_refresh(spark):
    item, sale = spark.range(5).withColumnRenamed("id", "item_id"), spark.createDataFrame([(1, 1, 2.0)], "sale_id int, item_id long, amount double")
    frames = {"item": item, "sale": sale}
    metas = catalog.discover(frames, {"item": Keys(("item_id",)), "sale": Keys(("sale_id",), {"item_id": ("item", "item_id")})})
    d = design(metas)
    try:
        status = warehouse.refresh(spark, frames | {"broken": item.select(F.raise_error(F.lit("down")).cast("int").alias("e"))}, d, "copies", "made")
        assert status["item"] == "copied" and status["broken"].startswith("error") and set(status.values()) - {status["broken"]} == {"copied", "created"}
        assert stored.tables(spark, "copies") == ["item", "sale"] and {"copies", "made"} <= set(stored.schemas(spark)) and "made" not in stored.schemas(spark, ("made",))
        told = project.table_detail(spark, metas[0], item, "copies.item")
        assert told["statistics"]["row_count"] == 5 and told["statistics"]["size_bytes"] > 0 and len(told["sample_rows"]) == 5 and "PRIMARY KEY (item_id)" in told["ddl"]
        assert workspace.run(spark, "SELECT count(*) AS n FROM item", database="copies").rows == ({"n": 5},) and spark.catalog.currentDatabase() == "default"
        assert stored.server(spark)["version"] == spark.version
    finally:
        spark.sql("DROP DATABASE IF EXISTS copies CASCADE")
        spark.sql("DROP DATABASE IF EXISTS made CASCADE")
    seen = project.warehouse_preview(frames, metas, d)
    assert seen["status"] == "passed" and seen["script"] == create_script(d, metas, "warehouse") and any(c["check"] == "rows" for c in seen["checks"])
    lost = project.warehouse_preview(frames | {"item": item.limit(0)}, metas, d)
    assert lost["status"] in ("error", "warning")


def test_modes_of_kpis(spark):
    frames = {"item": spark.range(5), "sale": spark.range(2)}
    d = design([Table("item", (Column("id", "bigint", primary=True),), 5), Table("sale", (Column("amount", "numeric"), Column("item_id", "bigint", foreign=ForeignKey("item", "id"))), 2)])
    name = next(p.name for p in d.parts if p.source == "sale")
    assert kpi_match.frames_of("warehouse", frames, {name: spark.range(7)}, d)["sale"].count() == 7 and kpi_match.frames_of("source", frames, {name: spark.range(7)}, d)["sale"].count() == 2
    with pytest.raises(ValueError):
        kpi_match.frames_of("other", frames, {}, d)


def test_workspace_history_and_demo(spark, tmp_path):
    saved = workspace.Saved(spark, str(tmp_path / "q"))
    saved.save("one", "SELECT 1 AS x")
    saved.delete("one")
    assert [r["action"] for r in saved.history().collect()] == ["deleted", "saved"] and saved.list().count() == 0
    got = workspace.run(spark, "SELECT NULL AS a, 1.5 AS b, 2 AS c, true AS d, 'x' AS e")
    assert [workspace.column_kind(got, c) for c in "abcde"] == ["unknown", "numeric", "integer", "boolean", "text"]
    demo = workspace.Demo(spark, {"q": ("Title", "SELECT 1 AS x")})
    assert demo.titles() == {"q": "Title"} and demo.frame("q").count() == 1
    with pytest.raises(PermissionError):
        demo.frame("DROP TABLE x")


def test_jdbc_schemas_and_indexes(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for sql in ("CREATE TABLE a (id INT NOT NULL PRIMARY KEY, x INT, y INT)", "CREATE INDEX a_xy ON a (y, x)", "CREATE TABLE pay_p2022_03 (id INT)"):
        connection.createStatement().execute(sql)
    connection.close()
    assert jdbc.schemas(spark, url) == ["APP"] and jdbc.schemas(spark, url, ("APP",)) == []
    assert jdbc.indexes(spark, url, "A", "APP")["A_XY"] == (False, ("Y", "X"))
    with pytest.raises(ValueError):
        jdbc.read(spark, url, "A", search_path='x"; DROP')


def test_one_run_from_sources_to_dashboard(spark, sf, tmp_path):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders", "nation")}
    frames["orders"] = frames["orders"].unionByName(frames["orders"].where("o_orderkey % 10 = 0"))
    done, shown = project.run_all(spark, "bench", frames, catalog.BENCH_KEYS, str(tmp_path))
    assert len(done.tables) == 3 and 0 < done.score < 100 and "applied" in done.steps and shown and all(c.rows for c in shown)
    counted = next(m for m in done.kpis if m.kpi.name == "Total Transactions")
    assert counted.value == frames["orders"].distinct().count() and project.stage_status(done)["dashboard"] == "completed"
    assert frames["orders"].count() > counted.value
