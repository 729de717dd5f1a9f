"""Data contracts of the supplied tables, as the documents a user would write."""

from __future__ import annotations


def _column(name, type_, nullable=False, unique=False, **rules) -> dict:
    return {"name": name, "type": type_, "nullable": nullable, "unique": unique, "description": name, **rules}


def _contract(dataset, sla, columns, min_rows=1, key=None) -> dict:
    return {
        "dataset": dataset, "version": "v1.0.0", "owner": f"{dataset}-team", "description": f"{dataset} table",
        "freshness_sla_minutes": sla, "status": "ACTIVE",
        "constraints": {"min_rows": min_rows, "primary_key": key}, "columns": columns,
    }


ORDERS = _contract("orders", 1440, [
    _column("o_orderkey", "integer", unique=True),
    _column("o_custkey", "integer"),
    _column("o_orderstatus", "string", allowed_values=["F", "O"]),
    _column("o_totalprice", "float", min=1000.0, max=400000.0),
    _column("o_orderdate", "timestamp"),
    _column("o_orderpriority", "string", allowed_values=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    _column("o_clerk", "string"),
], min_rows=100, key="o_orderkey")

LINEITEM = _contract("lineitem", 1440, [
    _column("l_orderkey", "integer", unique=True),
    _column("l_quantity", "float", min=1, max=45),
    _column("l_discount", "float", min=0.0, max=0.10),
    _column("l_returnflag", "string", allowed_values=["A", "N", "R"]),
    _column("l_linestatus", "string", allowed_values=["O", "F"]),
    _column("l_shipdate", "timestamp"),
])

CUSTOMER = _contract("customer", 1440, [
    _column("c_custkey", "integer", unique=True),
    _column("c_name", "string", unique=True),
    _column("c_nationkey", "integer", min=0, max=24),
    _column("c_acctbal", "float", min=0),
    _column("c_mktsegment", "string", allowed_values=["BUILDING", "MACHINERY", "HOUSEHOLD"]),
])

EVENTS = _contract("events", 60, [
    _column("event_id", "integer", unique=True),
    _column("ts", "timestamp"),
    _column("user_id", "integer"),
    _column("event_type", "string", allowed_values=["click", "purchase", "signup", "view"]),
    _column("value", "float", min=0.5, max=300.0),
    _column("props", "string", nullable=True),
], min_rows=100)

TRANSACTIONS = _contract("transactions", 15, [
    _column("transaction_id", "integer", unique=True),
    _column("customer_id", "integer"),
    _column("merchant_id", "integer"),
    _column("amount", "float", min=1.0, max=300.0),
    _column("ts", "timestamp"),
    _column("status", "string", allowed_values=["APPROVED", "FAILED"]),
    _column("channel", "string", allowed_values=["WEB", "MOBILE_APP", "POS", "ATM", "WIRE"]),
])

CUSTOMER_FEATURES = _contract("customer_features", 60, [
    _column("customer_id", "integer", unique=True),
    _column("feature_timestamp", "timestamp"),
    _column("cust_txn_count_1h", "integer", min=0),
    _column("cust_txn_count_24h", "integer", min=0),
    _column("cust_txn_amount_sum_24h", "float", min=0.0),
], min_rows=10, key="customer_id")

PREDICTIONS = _contract("model_predictions_log", 15, [
    _column("prediction_id", "string", unique=True),
    _column("customer_id", "string"),
    _column("risk_score", "float", min=0.0, max=1.0),
    _column("prediction", "integer", allowed_values=[0, 1]),
    _column("model_version", "string"),
    _column("created_at", "timestamp"),
])

# child table -> (child column, parent table, parent column) in the supplied tables
FOREIGN_KEYS = {
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"),
                 ("l_suppkey", "supplier", "s_suppkey")],
    "orders": [("o_custkey", "customer", "c_custkey")],
    "customer": [("c_nationkey", "nation", "n_nationkey")],
    "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "nation": [("n_regionkey", "region", "r_regionkey")],
    "events": [("user_id", "supplier", "s_suppkey"), ("user_id", "customer", "c_custkey")],
}
