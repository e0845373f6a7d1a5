"""Sources, sinks, projection, casts and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import ORDER_LINES, SNAPSHOT, TX, UNTIL, cents, order_lines, order_spans, table
from repurchase.catalog.labels import TRAIN_SQL
from repurchase.catalog.registry import query
from repurchase.catalog.snapshot import round_std, snapshot_sql
from repurchase.operators import clean as C
from repurchase.operators.labels import history, label_future
from repurchase.operators.profile import null_counts
from repurchase.operators.snapshot import snapshot_features
from repurchase.runtime import scratch_path
from repurchase.schema import ORDER_LINE_COLUMNS
from repurchase.sources import storage, transactions

LINE_KEY = ("order_id", "line_number", "goods_id", "supplier_id")
KEY_SQL = ", ".join(LINE_KEY)
# The class id is declared long, wider than the column that stands in for it.
TX_COLUMNS = [name for name, _ in ORDER_LINE_COLUMNS if name in ORDER_LINES]

TX_SQL = ", ".join("goods_class_id::bigint as goods_class_id" if c == "goods_class_id" else c for c in TX_COLUMNS)

# Text takes several times the room of the tables it comes from. A packed file is read by one task, so files are short.
PACKED = {"compression": "lz4", "maxRecordsPerFile": 500_000}


@query("s1_tx_view", f"with {TX} select * from tx")
def _(spark, sf_dir):
    return order_lines(spark, sf_dir)


@query("s1_read_csv", f"with {TX} select {TX_SQL} from tx")
def _(spark, sf_dir):
    # Written in the column layout of the source file; the fixtures have no line id, so it stays empty.
    lines = order_lines(spark, sf_dir, *TX_COLUMNS)
    kinds = dict(ORDER_LINE_COLUMNS)
    file_columns = []
    for name in kinds:
        value = F.col(name) if name in TX_COLUMNS else F.lit(None).cast(kinds[name])
        if kinds[name] == "timestamp_ntz":
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        file_columns.append(value.alias(name))
    path = scratch_path(spark, "order-lines")
    lines.select(*file_columns).write.options(header=True, **PACKED).csv(path)
    return transactions.read_transactions(spark, path).select(*TX_COLUMNS)


@query("s1_read_parquet", f"with {TX} select {TX_SQL} from tx")
def _(spark, sf_dir):
    path = scratch_path(spark, "order-lines")
    order_lines(spark, sf_dir, *TX_COLUMNS).write.parquet(path)
    return transactions.read_transactions(spark, path, "parquet")


@query(
    "s1_stored_by_month",
    f"with {TX} select {TX_SQL} from tx where order_pay_time <= timestamp '{UNTIL}'",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "order-lines")
    transactions.save_transactions(order_lines(spark, sf_dir, *TX_COLUMNS), path)
    return history(transactions.read_transactions(spark, path, "parquet"), UNTIL).select(*TX_COLUMNS)


# Faults planted into the text of some lines: name, condition, column, text. The last one cuts the line short.
FAULTS = (
    ("time", "line_number = 2 and order_id % 5 = 0", "order_pay_time", "31/12/1999"),
    ("number", "line_number = 4 and order_id % 7 = 0", "order_amount", "12,50".replace(",", ";")),
    ("id", "line_number = 5 and order_id % 3 = 0", "customer_id", "12c"),
    ("flag", "line_number = 7 and order_id % 2 = 0", "member_status", "yes"),
)
SHORT = "line_number = 6 and order_id % 4 = 0"
FAULT_SQL = " ".join(f"when {condition} then '{name}'" for name, condition, _, _ in FAULTS)
REJECTS_SQL = (
    f"with {TX}, told as (select *, case when {SHORT} then 'short' {FAULT_SQL} end as fault from tx),"
    " named as (select fault, goods_id, case fault "
    + " ".join(f"when '{name}' then '{column}'" for name, _, column, _ in FAULTS)
    + " end as column_name, case fault "
    + " ".join(f"when '{name}' then '{text}'" for name, _, _, text in FAULTS)
    + " end as text from told)"
)


def faulty_files(spark, sf_dir) -> str:
    """Order lines as CSV text, some of them with a fault; returns the folder."""
    lines = order_lines(spark, sf_dir)
    faults = {column: F.when(F.expr(condition), F.lit(text)) for _, condition, column, text in FAULTS}
    cells = []
    for name, kind in ORDER_LINE_COLUMNS:
        value = F.col(name) if name in ORDER_LINES else F.lit(None)
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp_ntz" else value.cast("string")
        cells.append(F.coalesce(faults.get(name, F.lit(None)), value, F.lit("")))
    text = F.concat_ws(",", *cells)
    text = F.when(F.expr(SHORT), F.substring_index(text, ",", 9)).otherwise(text)
    header = spark.createDataFrame([(",".join(name for name, _ in ORDER_LINE_COLUMNS),)], "value string")
    path = scratch_path(spark, "faulty-lines")
    lines.select(text.alias("value")).unionByName(header).write.options(**PACKED).text(path)
    return path


@query(
    "s1_rejected_lines",
    f"{REJECTS_SQL} select column_name, text, count(*) as lines from named where fault is not null group by 1, 2"
    " union all select 'good', null, count(*) from named where fault is null",
)
def _(spark, sf_dir):
    good, rejects = transactions.split_transactions(spark, faulty_files(spark, sf_dir))
    counted = rejects.groupBy("column_name", "text").agg(F.count("*").alias("lines"))
    return counted.unionByName(good.agg(F.count("*").alias("lines")).select(F.lit("good").alias("column_name"), F.lit(None).cast("string").alias("text"), "lines"))


GOOD_SQL = f"with {TX} select {TX_SQL} from tx where not coalesce({SHORT}, false)" + "".join(
    f" and not coalesce({condition}, false)" for _, condition, _, _ in FAULTS
)


@query("s1_good_lines", GOOD_SQL)
def _(spark, sf_dir):
    return transactions.split_transactions(spark, faulty_files(spark, sf_dir))[0].select(*TX_COLUMNS)


@query("s2_roundtrip", f"with {TX}, {snapshot_sql(UNTIL)} select * from snapshot")
def _(spark, sf_dir):
    path = scratch_path(spark, "features")
    storage.save_features(snapshot_features(order_lines(spark, sf_dir), UNTIL, SNAPSHOT), path)
    return round_std(storage.load_features(spark, path))


def template(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.lit(0.0).alias("result"))


@query("s2_bucketed_join", f"with {TX}, {TRAIN_SQL} select * from train")
def _(spark, sf_dir):
    """Features and labels stored in buckets by customer, joined without moving either."""
    lines, known = order_lines(spark, sf_dir), order_spans(spark, sf_dir)
    parts = (snapshot_features(lines, UNTIL, SNAPSHOT, known), label_future(lines.select("customer_id", "order_pay_time"), UNTIL))
    stored = []
    for name, part in zip(("features", "labels"), parts):
        path = scratch_path(spark, name)
        stored.append(storage.save_buckets(part, path.rpartition("/")[2].replace("-", "_"), path, 8))
    return round_std(stored[0].join(stored[1], "customer_id"))


def measured(spark, sf_dir, *columns: str) -> tuple[DataFrame, storage.Statistics]:
    """Order lines stored with the statistics taken while they were written."""
    path = scratch_path(spark, "measured-lines")
    storage.save_features(order_lines(spark, sf_dir, *columns), path, measure=True)
    return storage.load_features(spark, path), storage.load_statistics(spark, path)


NULL_COLUMNS = ("customer_gender", "customer_province", "goods_price", "member_id", "order_id", "order_pay_time")


@query(
    "p3_nulls_from_statistics",
    f"with {TX} "
    + " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as count_null from tx" for c in NULL_COLUMNS),
)
def _(spark, sf_dir):
    lines, known = measured(spark, sf_dir, *NULL_COLUMNS)
    return null_counts(lines, known=known)


@query("p8_time_range_from_statistics", f"with {TX} select min(order_pay_time) as first, max(order_pay_time) as last from tx")
def _(spark, sf_dir):
    _, known = measured(spark, sf_dir, "order_pay_time", "order_id")
    return spark.createDataFrame([known.span("order_pay_time")], "first timestamp_ntz, last timestamp_ntz")


@query("s3_template", "select c_custkey as customer_id, 0.0::double as result from customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "template")
    template(spark, sf_dir).write.option("header", True).csv(path)
    return storage.read_template(spark, path)


@query("s4_submission", "select c_custkey as customer_id, case when c_acctbal > 5000 then 1.0::double else 0.0 end as result from customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "submission")
    bought = F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("result")
    storage.write_submission(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), bought), path)
    return storage.read_template(spark, path)


@query("s5_ids", "select c_custkey as customer_id from customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "ids")
    storage.write_ids(template(spark, sf_dir), path)
    return storage.read_ids(spark, path)


@query(
    "c1_projection",
    "select l_orderkey as order_id, l_partkey as goods_id, l_quantity, l_extendedprice, l_discount from lineitem",
)
def _(spark, sf_dir):
    renamed = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "order_id", "l_partkey": "goods_id"})
    kept = renamed.drop("l_tax", "l_shipdate", "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber")
    return kept.select("order_id", "goods_id", "l_quantity", "l_extendedprice", "l_discount")


@query("c2_cast_ids", f"with {TX} select order_id, customer_id, goods_id, goods_class_id::bigint as goods_class_id, member_id from tx")
def _(spark, sf_dir):
    ids = ("order_id", "customer_id", "goods_id", "goods_class_id", "member_id")
    lines = order_lines(spark, sf_dir, *ids)
    # As found in a file that stores ids with a decimal point.
    return C.cast_ids(lines.withColumns({c: F.col(c).cast("double") for c in ids}))


FLAGS = ("customer_gender", "member_status", "is_member_actived", "order_status", "goods_has_discount")


@query(
    "c3_flags",
    f"with {TX} select {KEY_SQL}, {', '.join(f'cast(coalesce({c}, 0) as int) as {c}' for c in FLAGS)} from tx",
)
def _(spark, sf_dir):
    return C.clean_flags(order_lines(spark, sf_dir, *LINE_KEY, *FLAGS))


@query(
    "c4_parse_times",
    "select o_orderkey, case when o_orderstatus = 'P' then null else o_orderdate end as order_pay_time from orders",
)
def _(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "not paid").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("order_pay_time"))
    return C.parse_times(orders, ["order_pay_time"])


@query("c5_to_day", "select event_id, cast(ts as date) as ts from events")
def _(spark, sf_dir):
    return C.to_day(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"])


@query(
    "c6_fill_const",
    f"with {TX} select {KEY_SQL}, coalesce(customer_gender, 0) as customer_gender,"
    " coalesce(goods_price, 0.0) as goods_price from tx",
)
def _(spark, sf_dir):
    lines = order_lines(spark, sf_dir, *LINE_KEY, "customer_gender", "goods_price")
    return C.fill_const(lines, {"customer_gender": 0, "goods_price": 0.0})


@query(
    "c7_fill_mean",
    f"with {TX}, means as (select {cents('goods_price')} / count(goods_price) as price, {cents('member_status')} /"
    " count(member_status) as status from tx)"
    f" select {KEY_SQL}, coalesce(goods_price, (select price from means)) as goods_price,"
    " coalesce(member_status::double, (select status from means)) as member_status from tx",
)
def _(spark, sf_dir):
    lines = order_lines(spark, sf_dir, *LINE_KEY, "goods_price", "member_status")
    return C.fill_mean(lines, ["goods_price", "member_status"], decimals=4)


PLACES = ("customer_province", "customer_city")
MODES_SQL = ", ".join(
    f"{c}_mode as (select {c} as mode from tx where {c} is not null group by 1 order by count(*) desc, 1 limit 1)" for c in PLACES
)


@query(
    "c8_fill_mode",
    f"with {TX}, {MODES_SQL} select {KEY_SQL}, "
    + ", ".join(f"coalesce({c}, (select mode from {c}_mode)) as {c}" for c in PLACES)
    + " from tx",
)
def _(spark, sf_dir):
    return C.fill_mode(order_lines(spark, sf_dir, *LINE_KEY, *PLACES), PLACES)


RATIO = (
    "case when l_discount = 0 then cast('{inf}' as double) when l_tax = 0 then cast('-{inf}' as double)"
    " when l_linenumber = 1 then cast('nan' as double) when l_linenumber = 2 then null else l_extendedprice end"
)


def ratios(spark, sf_dir) -> DataFrame:
    """Line items with a column of infinities, NaN, nulls and ordinary numbers."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.expr(RATIO.format(inf="infinity")).alias("ratio")
    )


@query(
    "c9_clean_inf",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity, case when l_discount = 0 or l_tax = 0 or l_linenumber in"
    " (1, 2) then 0.0 else l_extendedprice end as ratio from lineitem",
)
def _(spark, sf_dir):
    return C.clean_inf(ratios(spark, sf_dir), ["ratio"])


def range_sql(source: str, column: str, floating: bool) -> str:
    finite = f"case when isfinite({column}::double) then {column}::double end"
    bad = f"{column} is null or not isfinite({column}::double)" if floating else f"{column} is null"
    return (
        f"select '{column}' as column_name, min({finite}) + 0.0::double as min, max({finite}) + 0.0::double as max,"
        f" coalesce(sum(abs({finite} - cast(trunc({finite}) as bigint))), 0) < 0.01 as is_int,"
        f" count(*) filter (where {column} is null) as null_count, count(*) filter (where {bad}) as non_finite_count"
        f" from {source}"
    )


TARGET_SQL = (
    "case when not is_int then 'float' when min >= -128 and max <= 127 then 'byte' when min >= -32768 and max <= 32767"
    " then 'short' when min >= -2147483648 and max <= 2147483647 then 'int' when min is not null then 'long'"
    " else 'double' end as target_type"
)
RATIO_SOURCE = f"(select l_orderkey, l_linenumber, l_partkey, l_quantity, {RATIO.format(inf='infinity')} as ratio from lineitem)"
RANGES = {"l_orderkey": False, "l_linenumber": False, "l_partkey": False, "l_quantity": True, "ratio": True}
RANGES_SQL = " union all ".join(range_sql(RATIO_SOURCE, c, floating) for c, floating in RANGES.items())


@query("c10_range_report", f"select *, {TARGET_SQL} from ({RANGES_SQL})")
def _(spark, sf_dir):
    return C.range_report(ratios(spark, sf_dir))


@query(
    "c10_narrow_types",
    f"with {TX} select {KEY_SQL}, order_total_num::tinyint as order_total_num, order_status::tinyint as order_status,"
    " member_status::tinyint as member_status, goods_price::float"
    " as goods_price from tx",
)
def _(spark, sf_dir):
    columns = ("order_total_num", "order_status", "member_status", "goods_price")
    narrowed, _ = C.narrow_types(order_lines(spark, sf_dir, *LINE_KEY, *columns), columns)
    return narrowed


@query(
    "c7_fill_from_statistics",
    f"with {TX}, means as (select round(avg(goods_price), 4) as price from tx)"
    f" select {KEY_SQL}, round(coalesce(goods_price, (select price from means)), 4) as goods_price from tx",
)
def _(spark, sf_dir):
    lines, known = measured(spark, sf_dir, *LINE_KEY, "goods_price")
    return C.fill_mean(lines, ["goods_price"], known=known).withColumn("goods_price", F.round("goods_price", 4))


@query(
    "c10_narrow_from_statistics",
    f"with {TX} select {KEY_SQL}, order_total_num::tinyint as order_total_num, order_status::tinyint as order_status,"
    " member_status::tinyint as member_status, goods_price::float"
    " as goods_price from tx",
)
def _(spark, sf_dir):
    columns = ("order_total_num", "order_status", "member_status", "goods_price")
    lines, known = measured(spark, sf_dir, *LINE_KEY, *columns)
    return C.narrow_types(lines, columns, known)[0]


@query("c11_from_statistics", f"select column_name from ({RANGES_SQL}) where non_finite_count > 0")
def _(spark, sf_dir):
    path = scratch_path(spark, "measured-ratios")
    storage.save_features(ratios(spark, sf_dir), path, measure=True)
    report = C.known_report(storage.load_features(spark, path), storage.load_statistics(spark, path))
    return C.non_finite_columns(report)


@query("c11_non_finite", f"select column_name from ({RANGES_SQL}) where non_finite_count > 0")
def _(spark, sf_dir):
    return C.non_finite_columns(C.range_report(ratios(spark, sf_dir)))
