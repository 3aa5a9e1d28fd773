"""Column lists of the driver tables, used to generate oracle SQL text
without a Spark session (names and Spark type names)."""

TABLE_SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "dirty_orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("order_priority", "string"),
                     ("total_cents", "string"), ("order_date", "string"), ("order_status", "string")],
    "dirty_events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                     ("event_type", "string"), ("value", "double")],
}

NUMERIC_TYPE_NAMES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def type_family(t: str) -> str:
    if t in NUMERIC_TYPE_NAMES or t.startswith("decimal"):
        return "numeric"
    if t in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    if t == "boolean":
        return "boolean"
    return "text"
