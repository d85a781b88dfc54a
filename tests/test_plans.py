"""Catalogue decisions on a schema of a rental shop, without data."""

from millrace.plans.catalog import Column, ForeignKey, Table, accepted, create_statement
from millrace.plans.charts import Chart, curate, finished, validity
from millrace.plans.design import design, fact_score
from millrace.plans.graph import dimension_paths, own_dimensions
from millrace.plans.kpi_match import match


def table(name, rows, *columns):
    made = []
    for c in columns:
        column, kind, *rest = c.split()
        foreign = next((ForeignKey(*r[1:].split(".")) for r in rest if r[0] == ">"), None)
        made.append(Column(column, kind, primary="pk" in rest, foreign=foreign))
    return Table(name, tuple(made), rows)


SHOP = [
    table("address", 600, "address_id integer pk", "address text", "district text", "city_id integer >city.city_id", "last_update timestamp"),
    table("category", 16, "category_id integer pk", "name text", "last_update timestamp"),
    table("city", 600, "city_id integer pk", "city text", "last_update timestamp"),
    table("customer", 599, "customer_id integer pk", "store_id integer >store.store_id", "first_name text", "last_name text", "email text", "address_id integer >address.address_id", "create_date date"),
    table("film", 1000, "film_id integer pk", "title text", "rental_rate numeric", "replacement_cost numeric", "last_update timestamp"),
    table("film_category", 1000, "film_id integer pk >film.film_id", "category_id integer pk >category.category_id", "last_update timestamp"),
    table("inventory", 4581, "inventory_id integer pk", "film_id integer >film.film_id", "store_id integer >store.store_id", "last_update timestamp"),
    table("payment", 16049, "payment_id integer pk", "customer_id integer >customer.customer_id", "rental_id integer >rental.rental_id", "amount numeric", "payment_date timestamp"),
    table("rental", 16044, "rental_id integer pk", "rental_date timestamp", "inventory_id integer >inventory.inventory_id", "customer_id integer >customer.customer_id", "return_date timestamp"),
    table("store", 2, "store_id integer pk", "address_id integer >address.address_id", "last_update timestamp"),
]


def test_paths_pass_junctions_and_prefer_labels():
    paths = dimension_paths(SHOP, "rental")
    by = {p.table: p for p in paths}
    assert by["customer"].label == ("first_name", "last_name") and len(by["customer"].edges) == 1
    assert by["film"].label == ("title",) and len(by["film"].edges) == 2
    assert len(by["category"].edges) == 4
    assert "film_category" not in by and not by["store"].named
    assert [p.named for p in paths] == sorted((p.named for p in paths), reverse=True)


def test_design_classifies_and_can_be_overridden():
    d = design(SHOP)
    assert {p.source for p in d.facts} >= {"payment", "rental"}
    assert d.kind == "snowflake"
    assert {p.source for p in design(SHOP, {"payment": "dimension", "nothing": "fact"}).dimensions} >= {"payment"}
    assert fact_score(SHOP[7], SHOP) == 30 + 20 + 15 + 15


def test_best_table_is_a_fact_if_none_scores():
    assert [p.source for p in design([table("a", 0, "x text"), table("b", 0, "y date")]).facts] == ["b"]


def test_retail_kpis_match():
    found = {m.kpi.name: m for m in match("retail", SHOP, design(SHOP))}
    assert found["Total Revenue"].measure.column == "amount"
    assert found["Unique Customers"].measure.identifier == "customer_id"
    assert found["Total Products"].table == "film" and found["Total Customers"].table == "customer"
    assert match("unknown", SHOP, design(SHOP)) == []


def test_own_dimensions():
    dates, groups = own_dimensions(SHOP[8])
    assert dates == ["rental_date", "return_date"] and groups == ["inventory_id", "customer_id"]


def test_accepted_links_and_ddl():
    bare = [table("a", 1, "id integer pk"), table("b", 1, "id integer pk", "a_id integer")]
    linked = accepted(bare, [("b", "a_id", "a", "id")])
    assert "FOREIGN KEY (a_id) REFERENCES a (id)" in create_statement(linked[1])
    assert dimension_paths(bare, "b") == []


def chart(form, n):
    return finished(Chart("k", "T", form, "L", "", "M", lambda: None), [{"label": str(i), "value": i} for i in range(n)])


def test_chart_forms():
    assert chart("categorical", 1) is None
    assert [chart("categorical", n).kind for n in (2, 6, 7, 20, 21)] == ["donut", "donut", "bar", "bar", "horizontal_bar"]
    assert len(chart("categorical", 21).rows) == 10 and chart("categorical", 21).title == "Top 10 T"
    assert chart("time_series", 3).kind == "line" and chart("segmentation", 2).kind == "bar"


def test_curation_is_varied():
    pool = [chart("categorical", 3), chart("categorical", 2), chart("time_series", 9), chart("categorical", 30), chart("categorical", 9), chart("segmentation", 4), chart("time_series", 8)]
    assert [c.kind for c in curate(pool)] == ["line", "bar", "horizontal_bar", "donut", "bar"]
    assert len(curate(pool)[3].rows) == 2


def test_validity():
    assert validity([]) == "no rows" and validity([{"label": "a", "value": 1}]) == "a single point"
    assert validity([{"label": "a", "value": 1}, {"label": "a", "value": 2}]) == "labels twice"
