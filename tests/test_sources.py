import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning, profile, quality, relationships, warehouse, workspace
from millrace.plans.catalog import Keys, as_frame, discover, from_frame
from millrace.plans.design import design
from millrace.sources import dump, files, jdbc, sandbox
from millrace.streaming import refresh


@pytest.mark.parametrize("encoding, delimiter", [("utf-8", ","), ("cp1252", ","), ("utf-8-sig", ";")])
def test_csv_dialect(spark, tmp_path, encoding, delimiter):
    path = tmp_path / "a.csv"
    path.write_text(delimiter.join(["id", "name", "x"]) + "\n" + "".join(delimiter.join([str(k), "café", "1.5"]) + "\n" for k in range(20)), encoding=encoding)
    found = files.csv_dialect(spark, str(path))
    assert found["delimiter"] == delimiter
    rows = files.read_csv(spark, str(path), delimiter).collect()
    assert len(rows) == 20 and rows[0]["name"] == "café" and rows[3][0] == 3


def test_results_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').orderBy("id").collect()
    assert [r["t"] for r in back] == ['a "b", c', None]


def test_nan_and_health(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "id int, x double")
    assert files.without_nan(df).where("x IS NULL").count() == 1
    assert profile.counts(df).where("column_name = 'x'").first()["null_count"] == 1
    assert files.healthy(df)[0] and not files.healthy(df.select(F.raise_error(F.lit("down")).alias("e")))[0]


def test_jdbc_keys_and_scan(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    s = connection.createStatement()
    for sql in ("CREATE TABLE a (id INT NOT NULL PRIMARY KEY)", "CREATE TABLE b (id INT NOT NULL PRIMARY KEY, a_id INT REFERENCES a(id))", "INSERT INTO a VALUES 1, 2", "INSERT INTO b VALUES (5, 1)"):
        s.execute(sql)
    connection.close()
    keys = jdbc.declared_keys(spark, url, "APP")
    assert keys["B"] == Keys(("ID",), {"A_ID": ("A", "ID")})
    assert jdbc.read(spark, url, "A").count() == 2


def test_sandbox_warehouse_and_catalogue(spark):
    tabs = {"item": spark.range(5).withColumnRenamed("id", "item_id"), "sale": spark.createDataFrame([(1, 1, 2.0), (2, 9, 3.0), (3, None, 4.0)], "sale_id int, item_id long, amount double")}
    keys = {"item": Keys(("item_id",)), "sale": Keys(("sale_id",), {"item_id": ("item", "item_id")})}
    metas = discover(tabs, keys)
    assert from_frame(as_frame(spark, metas)) == sorted(metas, key=lambda t: t.name)
    d = design(metas, {"sale": "fact", "item": "dimension"})
    assert set(warehouse.materialise(spark, tabs, d, "made").values()) == {"created"}
    assert "dw_updated_at" in spark.table("made.dim_item").columns
    checks = {(r["check"], r["table_name"]): (r["value"], r["status"]) for r in warehouse.validate(tabs, d).collect()}
    assert checks["orphans", "fact_sale"] == (1, "error") and checks["rows", "dim_item"] == (5, "passed")
    assert {r["table_name"]: r["row_count"] for r in sandbox.load(spark, "box", tabs).collect()} == {"item": 5, "sale": 3}
    spark.sql("DROP DATABASE made CASCADE")
    spark.sql("DROP DATABASE box CASCADE")


def test_cleaning_keeps_the_source(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (2, 4.0), (3, 6.0)], "id int, x double")
    steps = [cleaning.Step("drop_duplicates", "t"), cleaning.Step("impute_median", "t", "x", 5.0)]
    assert [(b, a) for _, b, a in cleaning.preview({"t": df}, steps)] == [(1, 0), (1, 0)]
    made, told = cleaning.apply(spark, {"t": df}, [*steps, cleaning.Step("cast_type", "t", "lacking")], str(tmp_path))
    out = made["t"]
    assert [s.status for s, _ in told] == ["pending", "applied", "applied"] and "lacking" in told[0][1]
    failing = cleaning.preview({"t": df}, [cleaning.Step("impute_median", "t", "lacking", 1.0), *steps])
    assert [(b, a) for _, b, a in failing] == [(0, 0), (1, 0), (1, 0)]
    assert sorted(map(tuple, out.collect())) == [(1, 5.0), (2, 4.0), (3, 6.0)] and df.count() == 4
    kinds = [i["issue_type"] for i in map(lambda r: r.asDict(), quality.issues(*profile.profile_all({"t": df})).collect())]
    assert sorted(kinds) == ["duplicate_rows", "high_null_rate"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert profile.duplicate_rows(df).first()["duplicate_percentage"] == 0.0
    assert profile.profile(df, "t").count() == 0
    assert relationships.infer(spark, [], {}).count() == 0
    assert quality.scores(*profile.profile_all({"t": df})).first()["overall"] == 100


def test_workspace(spark, tmp_path):
    found = workspace.run(spark, "SELECT 1 AS a, DATE'2024-01-02' AS d, CAST(1.5 AS DECIMAL(5,2)) AS x")
    assert found.rows == ({"a": 1, "d": "2024-01-02", "x": 1.5},) and "Physical Plan" in found.plan
    assert workspace.run(spark, "SELECT nope").error
    saved = workspace.Saved(spark, str(tmp_path / "q"))
    saved.save("one", "SELECT 1 AS v")
    saved.save("one", "SELECT 2 AS v")
    assert saved.run("one").first()["v"] == 2
    saved.delete("one")
    assert saved.list().count() == 0


def test_streaming_counts_equal_batch_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    landing = tmp_path / "in"
    events.write.parquet(str(landing))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = refresh.landing(spark, str(landing), schema)
    refresh.refresh(stream, str(tmp_path / "copy"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == events.count()
    refresh.counts(stream, "ts", "event_type").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, refresh.counts(events, "ts", "event_type").collect()))


ODD = [(1, "tab\there", 1.5, True), (2, "line\nend\\", None, False), (3, "\\N", 0.0, None), (4, "", -1.0, True), (5, None, 2.0, True), (6, "COPY t (k) FROM stdin;", 3.0, True), (7, "é\u3042\r", 4.0, False)]


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_dump_cut_at_any_byte(spark, tmp_path, split):
    df = spark.createDataFrame(ODD, "k int, t string, x double, b boolean")
    lines = [r["value"] for r in dump.as_lines(df).orderBy("value").collect()]
    more = [r["value"] for r in dump.as_lines(spark.range(3)).collect()]
    text = ["-- a dump", "SET x = 1;", "", "COPY public.odd (k, t, x, b) FROM stdin;", *lines, "\\.", "", 'COPY "Other" (id) FROM stdin;', *more, "\\.", "COPY public.none (a) FROM stdin;", "\\.", "SELECT 1;", "COPY public.odd (b, k) FROM stdin;", "t\t99", "\\."]
    path = tmp_path / "dump.sql"
    path.write_bytes("\n".join(text).encode())
    index = dump.sections(spark, str(path), split)
    assert [r["table_name"] for r in index.collect()] == ["odd", "Other", "none", "odd"]
    got = dump.read_table(spark, str(path), "odd", "k int, b boolean", split, index)
    assert got.columns == ["k", "b"] and sorted(map(tuple, got.collect())) == sorted([(k, b) for k, _, _, b in ODD] + [(99, True)])
    first = index.where("first < 200")
    whole = dump.read_table(spark, str(path), "odd", "k int, t string, x double, b boolean", split, first)
    assert sorted(map(tuple, whole.collect())) == sorted(ODD)
    assert dump.read_table(spark, str(path), "none", "a int", split, index).count() == 0
    assert [r[0] for r in dump.read_table(spark, str(path), "Other", "id long", split, index).orderBy("id").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        dump.read_table(spark, str(path), "lacking", "a int", split, index)
