"""KPI catalogues of six domains. All of this is fixed values: names, units, aggregations and the words that match a schema."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Kpi:
    name: str
    category: str
    unit: str
    aggregation: str
    measure: str = ""
    identifier: str = ""
    tables: str = ""
    missing: str = ""
    on_fact: bool = True

    def words(self, kind: str) -> list[str]:
        return getattr(self, kind).split()


_MONEY = "amount price revenue total value cost fee sale income payment"
_BUYER = "customer_id client_id buyer_id user_id"

DOMAINS: dict[str, list[Kpi]] = {
    "retail": [
        Kpi("Total Revenue", "Revenue", "currency", "SUM", measure=_MONEY),
        Kpi("Total Transactions", "Volume", "count", "COUNT"),
        Kpi("Average Transaction Value", "Revenue", "currency", "AVG", measure=_MONEY),
        Kpi("Unique Customers", "Customers", "count", "COUNT_DISTINCT", identifier=f"{_BUYER} member_id account_id"),
        Kpi("Revenue Per Customer", "Customers", "currency", "SUM_PER_DISTINCT", measure="amount price revenue total value cost fee sale", identifier=_BUYER),
        Kpi("Transactions Per Customer", "Customers", "count", "COUNT_PER_DISTINCT", identifier=_BUYER),
        Kpi("Maximum Transaction Value", "Revenue", "currency", "MAX", measure="amount price revenue total value sale"),
        Kpi("Total Products", "Inventory", "count", "COUNT", identifier="product_id item_id sku_id film_id goods_id", tables="product item sku film merchandise goods catalog", on_fact=False),
        Kpi("Total Customers", "Customers", "count", "COUNT", identifier="customer_id client_id buyer_id member_id user_id", tables="customer client buyer member user account", on_fact=False),
        Kpi("Null Return Rate", "Quality", "percentage", "NULL_RATE", missing="return_date end_date completed_at closed_at delivered_at"),
    ],
    "banking": [
        Kpi("Total Transaction Volume", "Volume", "currency", "SUM", measure="amount value sum balance debit credit transfer"),
        Kpi("Total Transactions", "Volume", "count", "COUNT"),
        Kpi("Active Accounts", "Customers", "count", "COUNT_DISTINCT", identifier="account_id acct_id customer_id client_id member_id"),
        Kpi("Average Transaction Amount", "Volume", "currency", "AVG", measure="amount value balance debit credit"),
        Kpi("Maximum Transaction Amount", "Risk", "currency", "MAX", measure="amount value balance debit credit"),
        Kpi("Total Accounts", "Customers", "count", "COUNT", identifier="account_id acct_id customer_id client_id", tables="account acct customer client holder", on_fact=False),
    ],
    "finance": [
        Kpi("Total Revenue", "Revenue", "currency", "SUM", measure="revenue income sales amount receipts earnings turnover"),
        Kpi("Total Expenses", "Costs", "currency", "SUM", measure="expense cost expenditure outflow payment spend"),
        Kpi("Average Transaction Amount", "Revenue", "currency", "AVG", measure="amount value revenue expense cost"),
        Kpi("Total Entries", "Volume", "count", "COUNT"),
    ],
    "healthcare": [
        Kpi("Total Patients", "Volume", "count", "COUNT", identifier="patient_id person_id member_id", tables="patient person individual member", on_fact=False),
        Kpi("Total Appointments", "Volume", "count", "COUNT", tables="appointment visit encounter consultation booking"),
        Kpi("Total Billing Amount", "Revenue", "currency", "SUM", measure="amount bill charge cost fee payment claim"),
        Kpi("Average Billing Per Patient", "Revenue", "currency", "SUM_PER_DISTINCT", measure="amount bill charge cost fee", identifier="patient_id person_id member_id"),
    ],
    "manufacturing": [
        Kpi("Total Units Produced", "Production", "count", "SUM", measure="units_produced quantity produced output manufactured units"),
        Kpi("Total Production Runs", "Volume", "count", "COUNT"),
        Kpi("Average Units Per Run", "Production", "count", "AVG", measure="units_produced quantity output units"),
        Kpi("Total Defective Units", "Quality", "count", "SUM", measure="defective defect rejected scrap waste failed"),
    ],
    "logistics": [
        Kpi("Total Shipments", "Volume", "count", "COUNT"),
        Kpi("Total Shipment Value", "Revenue", "currency", "SUM", measure="value amount cost freight charge rate price"),
        Kpi("Average Shipment Value", "Revenue", "currency", "AVG", measure="value amount cost freight charge"),
        Kpi("Unique Destinations", "Coverage", "count", "COUNT_DISTINCT", identifier="destination_id address_id location_id city_id zip_code postal_code"),
    ],
}
