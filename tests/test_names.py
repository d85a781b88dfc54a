import pytest

from millrace.functions import names
from millrace.functions.formats import card_text, kpi_text
from millrace.sources.jdbc import parse_dsn


@pytest.mark.parametrize(
    "value, unit, text",
    [(24800000, "currency", "$24.8M"), (1530, "USD", "$1.5K"), (1.53, "$", "$1.53"), (None, "currency", None), (16245, "count", "16,245"), (34.62, "percentage", "34.62%"), (5.42, "days", "5.42 days"), (123456, "inr", "₹1.2L"), (7.0, None, "7")],
)
def test_kpi_text(value, unit, text):
    assert kpi_text(value, unit) == text


def test_card_text():
    assert [card_text(1500, "count"), card_text(-5e6, "currency"), card_text(None, ""), card_text(12.345, "percentage")] == ["1.5K", "$-5000000.00", "N/A", "12.3%"]


@pytest.mark.parametrize("column, like, token", [("customer_id", True, "customer"), ("CustomerId", True, "customer"), ("CustomerID", False, None), ("order_item_id", True, "order_item"), ("amount", False, None), ("_id", False, None)])
def test_key_like(column, like, token):
    assert names.is_key_like(column) == like
    assert names.entity(column) == token


def test_similarity():
    assert names.indel_ratio("user", "customer") == pytest.approx(8 / 12)
    assert names.indel_ratio("doc", "document") == pytest.approx(6 / 11)
    assert names.singular("categories") == "category" and names.singular("boxes") == "box" and names.singular("class") == "class"
    assert names.tables_for("cust", ["orders", "customers"]) == ["customers"]
    assert names.tables_for("project", ["users", "projects"]) == ["projects"]


def test_keyword_scores():
    assert [names.keyword_score(c, ["amount", "total"]) for c in ("amount", "total_amount", "xamountx", "none")] == [100, 85, 70, 0]
    assert names.table_score("payment_history", ["payment"]) == 70
    assert names.is_partition_child("payment_p2022_03") and not names.is_partition_child("payment")


def test_dsn_keeps_no_password():
    found = parse_dsn("postgresql://me:secret@db.example:5433/shop?sslmode=require")
    assert found == {"host": "db.example", "port": 5433, "database": "shop", "user": "me", "options": {"sslmode": "require"}}
