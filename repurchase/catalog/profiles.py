"""Profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import TX, order_lines, table
from repurchase.catalog.labels import LABEL_FUTURE, label_future
from repurchase.catalog.registry import query
from repurchase.operators import profile as P

# Columns of the profiled tables with the names Spark gives their types.
LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def union(parts) -> str:
    return " union all ".join(parts)


@query(
    "p1_schema",
    union(
        f"select {i} as position, '{c}' as column_name, '{kind}' as dtype, count({c}) as non_null from lineitem"
        for i, (c, kind) in enumerate(LINE_TYPES.items())
    ),
)
def _(spark, sf_dir):
    return P.profile_schema(table(spark, sf_dir, "lineitem"))


def numeric_sql(source: str, c: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont({c}::double, {q}), 4) as p{int(q * 100)}" for q in P.QUARTILES)
    return (
        f"select '{c}' as column_name, count({c}) as count, round(avg({c}::double), 4) as mean,"
        f" round(stddev_samp({c}::double), 4) as std, min({c}::double) + 0.0::double as min, {quartiles},"
        f" max({c}::double) + 0.0::double as max from {source}"
    )


NUMBERS = [c for c, kind in LINE_TYPES.items() if kind in ("bigint", "int", "double")]


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75") if c in df.columns})


@query("p2_describe_numeric", union(numeric_sql("lineitem", c) for c in NUMBERS))
def _(spark, sf_dir):
    return rounded(P.describe_numeric(table(spark, sf_dir, "lineitem")))


@query("p2_describe_nullable", f"with {TX} " + union(numeric_sql("tx", c) for c in ("goods_price", "member_status")))
def _(spark, sf_dir):
    return rounded(P.describe_numeric(order_lines(spark, sf_dir, "goods_price", "member_status")))


@query("p2_describe_sketch")
def _(spark, sf_dir):
    return rounded(P.describe_numeric(table(spark, sf_dir, "lineitem"), exact=False))


NULLABLE = ("customer_gender", "customer_province", "customer_city", "goods_price", "member_id", "order_id")


@query(
    "p3_null_counts",
    f"with {TX} " + union(f"select '{c}' as column_name, count(*) - count({c}) as count_null from tx" for c in NULLABLE),
)
def _(spark, sf_dir):
    return P.null_counts(order_lines(spark, sf_dir, *NULLABLE))


def text_sql(source: str, c: str) -> str:
    text = f"cast({c} as varchar)"
    counted = f"(select {text} as v, count(*) as n from {source} where {c} is not null group by 1)"
    return (
        f"select '{c}' as column_name, coalesce(sum(n), 0)::bigint as count, count(*) as \"unique\","
        f" (select v from {counted} order by n desc, v limit 1) as top, max(n) as freq, min(v) as first, max(v) as last"
        f" from {counted}"
    )


PLACES = ("customer_province", "customer_city")


@query("p4_describe_categorical", f"with {TX} " + union(text_sql("tx", c) for c in PLACES))
def _(spark, sf_dir):
    return P.describe_categorical(order_lines(spark, sf_dir, *PLACES), PLACES)


ORDER_NUMBERS = [c for c, kind in ORDER_TYPES.items() if kind in ("bigint", "double")]
ORDER_TEXTS = [c for c in ORDER_TYPES if c not in ORDER_NUMBERS]
DTYPE_SQL = "case column_name " + " ".join(f"when '{c}' then '{kind}'" for c, kind in ORDER_TYPES.items()) + " end as dtype"
NULLS_SQL = union(f"select '{c}' as column_name, count(*) - count({c}) as count_null from orders" for c in ORDER_TYPES)


@query(
    "p5_summary_table",
    f"with numbers as ({union(numeric_sql('orders', c) for c in ORDER_NUMBERS)}),"
    f" texts as ({union(text_sql('orders', c) for c in ORDER_TEXTS)}),"
    " merged as (select column_name, count, null as \"unique\", min, max, p25, p50, p75, null as top, null as freq,"
    " null as first, null as last from numbers union all select column_name, count, \"unique\", null, null, null, null, null,"
    " top, freq, first, last from texts)"
    f" select *, {DTYPE_SQL} from merged join ({NULLS_SQL}) using (column_name)",
)
def _(spark, sf_dir):
    return rounded(P.summary_table(table(spark, sf_dir, "orders")))


@query("p6_value_counts", f"with {TX}, {LABEL_FUTURE} select label, count(*) as count from labelled group by 1")
def _(spark, sf_dir):
    return P.value_counts(label_future(spark, sf_dir), "label")


@query("p7_shape", "select count(*) as rows, 11 as columns from lineitem")
def _(spark, sf_dir):
    return P.shape(table(spark, sf_dir, "lineitem"))


@query("p8_time_range", "select min(o_orderdate) as first, max(o_orderdate) as last from orders")
def _(spark, sf_dir):
    return P.time_range(table(spark, sf_dir, "orders"), "o_orderdate")
