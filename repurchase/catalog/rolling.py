"""Rolling-window features."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import (
    DENSE, DENSE_START, DENSE_UNTIL, EVENT_TX, ROLLING, SINCE_UNTIL, START, TX, daily_sql, event_lines, order_lines,
)
from repurchase.catalog.labels import horizon_sql
from repurchase.catalog.registry import query
from repurchase.operators import rolling as R
from repurchase.plans.dataset import build_dataset, rolling_datasets
from repurchase.schema import RollingSpec

COLUMNS = ("customer_id", "order_pay_time", "order_total_payment", "order_total_num")
EXTRA = ("mean", "median", "min", "std", "diff_mean", "decay_sum")


class WindowSql:
    """SQL aggregates of one trailing window over ``daily``."""

    def __init__(self, value: str, until: str, length: int, shift: int = 0, active: str = "!= 0"):
        self.value, self.length, self.shift = value, length, shift
        self.age = f"date_diff('day', day, date '{until}')"
        self.inside = f"{self.age} between {shift + 1} and {shift + length}"
        self.active = f"{self.inside} and {value} {active}"

    def over(self, aggregate: str, expression: str, where: str | None = None) -> str:
        return f"{aggregate}({expression}) filter (where {where or self.inside})"

    def _extreme(self, aggregate: str, pick: str) -> str:
        seen = self.over(aggregate, self.value)
        count = self.over("count", self.value)
        return f"case when {count} < {self.length} then {pick}(coalesce({seen}, 0.0), 0.0::double) else {seen} end"

    def sum(self) -> str:
        return f"coalesce({self.over('sum', self.value)}, 0.0::double)"

    def mean(self) -> str:
        return f"{self.sum()} / {self.length}"

    def max(self) -> str:
        return self._extreme("max", "greatest")

    def min(self) -> str:
        return self._extreme("min", "least")

    def decay_sum(self) -> str:
        weighted = f"{self.value} * pow(0.9::double, {self.age} - {self.shift + 1})"
        return f"coalesce({self.over('sum', weighted)}, 0.0::double)"

    def std(self) -> str:
        return f"list_aggregate({self._days()}, 'stddev_samp')"

    def _days(self) -> str:
        """All days of the window, those without a row as 0."""
        seen = f"coalesce({self.over('list', self.value)}, [])"
        return f"list_concat({seen}, list_resize([]::double[], {self.length} - len({seen}), 0.0::double))"

    def median(self) -> str:
        days = f"list_sort({self._days()})"
        return f"(list_extract({days}, {(self.length + 1) // 2}) + list_extract({days}, {self.length // 2 + 1})) / 2"

    def diff_mean(self) -> str:
        ends = [
            f"coalesce({self.over('sum', self.value, f'{self.age} = {self.shift + k}')}, 0.0::double)"
            for k in (1, self.length)
        ]
        return f"({ends[0]} - {ends[1]}) / {self.length - 1}"

    def active_days(self) -> str:
        return f"cast({self.over('count', '*', self.active)} as int)"

    def last(self) -> str:
        return f"cast(coalesce({self.over('min', f'{self.age} - {self.shift}', self.active)}, {self.length}) as int)"

    def first(self) -> str:
        return f"cast(coalesce({self.over('max', f'{self.age} - {self.shift}', self.active)}, 0) as int)"


def feature_sql(spec: RollingSpec, until: str) -> dict[str, str]:
    """Feature name -> SQL aggregate over ``daily``; sums of doubles rounded to 4 digits."""
    made: dict[str, str] = {}

    def put(name: str, sql: str) -> None:
        made[name] = f"round({sql}, 4)"

    for shift, tail in ((0, ""), (spec.shift, "_2")):
        for i in spec.payment_windows:
            w = WindowSql("day_payment", until, i, shift)
            put(f"decay_sum_{i}{tail}", w.decay_sum())
            put(f"max_{i}{tail}", w.max())
            if not shift:
                put(f"sum_{i}", w.sum())
            for name in ("mean", "median", "min", "std", *(() if shift else ("diff_mean",))):
                if name in spec.extra:
                    put(f"{name}_{i}{tail}", getattr(w, name)())
        for i in spec.goods_windows:
            w = WindowSql("day_num", until, i, shift)
            put(f"goods_mean_{i}{tail}", w.mean())
            put(f"goods_max_{i}{tail}", w.max())
            put(f"goods_sum_{i}{tail}", w.sum())
            for name in ("median", "min", "diff_mean", "decay_sum", *(() if shift else ("std",))):
                if name in spec.extra:
                    put(f"goods_{name}_{i}{tail}", getattr(w, name)())
    for prefix, value, active, windows in (
        ("", "day_payment", "!= 0", spec.payment_windows), ("goods_", "day_num", "> 0", spec.goods_windows),
    ):
        for i in windows:
            w = WindowSql(value, until, i, active=active)
            made[f"{prefix}has_sales_days_in_last_{i}"] = w.active_days()
            made[f"{prefix}last_has_sales_day_in_last_{i}"] = w.last()
            made[f"{prefix}first_has_sales_day_in_last_{i}"] = w.first()
    return made


def rolling_sql(spec: RollingSpec, until: str, pick=lambda name: True, label: bool = False, population="history") -> str:
    columns = [f"{sql} as {name}" for name, sql in feature_sql(spec, until).items() if pick(name)]
    if label:
        columns.append(horizon_sql(until, spec.horizon))
    having = f" having min(day) < date '{until}'" if population == "history" else ""
    return f"select customer_id, {', '.join(columns)} from daily group by customer_id{having}"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.round(name, 4) for name, kind in df.dtypes if kind == "double"})


def order_daily(spark, sf_dir) -> DataFrame:
    return R.daily_sums(order_lines(spark, sf_dir, *COLUMNS), START, decimals=4)


def event_daily(spark, sf_dir) -> DataFrame:
    return R.daily_sums(event_lines(spark, sf_dir), DENSE_START, decimals=4)


ORDER_DAILY = f"with {TX}, {daily_sql(START)}"
EVENT_DAILY = f"with {EVENT_TX}, {daily_sql(DENSE_START)}"


@query("w1_daily_payment", f"{ORDER_DAILY} select customer_id, day, day_payment from daily")
def _(spark, sf_dir):
    return order_daily(spark, sf_dir).drop("day_num")


@query("w2_daily_num", f"{ORDER_DAILY} select customer_id, day, day_num from daily")
def _(spark, sf_dir):
    return order_daily(spark, sf_dir).drop("day_payment")


MATRIX_DAYS = [date(2024, 1, 15) + timedelta(days=i) for i in range(7)]
MATRIX_SQL = ", ".join(
    f"coalesce(sum(day_payment) filter (where day = date '{d}'), 0.0) as d_{d:%Y%m%d}" for d in MATRIX_DAYS
)


@query("w3_daily_matrix", f"{EVENT_DAILY} select customer_id, {MATRIX_SQL} from daily group by 1")
def _(spark, sf_dir):
    return R.daily_matrix(event_daily(spark, sf_dir), MATRIX_DAYS, "day_payment")


def family(spec: RollingSpec, pick):
    """One feature family over the order lines."""

    def run(spark, sf_dir):
        features = R.rolling_features(order_daily(spark, sf_dir), SINCE_UNTIL, spec)
        return rounded(features.select("customer_id", *[c for c in features.columns[1:] if pick(c)]))

    return run


def payment(prefix: str, lagged: bool = False):
    return lambda name: name.startswith(prefix) and not name.startswith("goods_") and name.endswith("_2") == lagged


def goods(lagged: bool):
    return lambda name: (
        name.startswith(("goods_mean", "goods_max", "goods_sum")) and name.endswith("_2") == lagged
    )


FAMILIES = {
    "w4_decay_sum": payment("decay_sum"),
    "w5_max": payment("max"),
    "w6_sum": payment("sum"),
    "w7_lagged": lambda name: payment("decay_sum", True)(name) or payment("max", True)(name),
    "w8_active_days": payment("has_sales"),
    "w9_days_since_last": payment("last_has"),
    "w10_days_since_first": payment("first_has"),
    "w11_goods": goods(False),
    "w12_goods_lagged": goods(True),
    "w13_goods_activity": lambda name: name.startswith("goods_") and "sales_day" in name,
}
for _key, _pick in FAMILIES.items():
    query(_key, f"{ORDER_DAILY} {rolling_sql(ROLLING, SINCE_UNTIL, _pick)}")(family(ROLLING, _pick))

FULL = replace(ROLLING, extra=EXTRA)
PLAIN_NAMES = set(feature_sql(ROLLING, SINCE_UNTIL))


def is_extra(name: str) -> bool:
    return name not in PLAIN_NAMES


query("w14_extra", f"{ORDER_DAILY} {rolling_sql(FULL, SINCE_UNTIL, is_extra)}")(family(FULL, is_extra))


@query("rolling_all", f"{ORDER_DAILY} {rolling_sql(ROLLING, SINCE_UNTIL)}")
def rolling_all(spark, sf_dir):
    return rounded(R.rolling_features(order_daily(spark, sf_dir), SINCE_UNTIL, ROLLING))


@query("rolling_train_set", f"{ORDER_DAILY} {rolling_sql(ROLLING, SINCE_UNTIL, label=True)}")
def rolling_train_set(spark, sf_dir):
    tx = order_lines(spark, sf_dir, *COLUMNS)
    return rounded(build_dataset(tx, SINCE_UNTIL, True, "rolling", start=START, spec=ROLLING, decimals=4))


# Floats of the sums themselves: rounding to digits first would put some of them on the other side of a float.
NARROWED = ", ".join(
    f"({sql.removeprefix('round(').removesuffix(', 4)') if sql.startswith('round(') else sql})::float as {name}"
    for name, sql in feature_sql(ROLLING, SINCE_UNTIL).items()
)


@query(
    "rolling_train_set_narrowed",
    f"{ORDER_DAILY} select customer_id, {NARROWED}, {horizon_sql(SINCE_UNTIL, ROLLING.horizon)} from daily group by customer_id"
    f" having min(day) < date '{SINCE_UNTIL}'",
)
def _(spark, sf_dir):
    """The narrowest types, told as floats on both sides, as the types depend on the data."""
    tx = order_lines(spark, sf_dir, *COLUMNS)
    features = build_dataset(tx, SINCE_UNTIL, True, "rolling", start=START, spec=ROLLING, decimals=4, narrow=True)
    if "double" in dict(features.dtypes).values():
        raise ValueError("a feature was not narrowed")
    told = [F.col(c).cast("float").alias(c) for c in features.columns if c not in ("customer_id", "label")]
    return features.select("customer_id", *told, "label")


# The last of them lies after customers who bought only before all its windows.
CUTOFFS = ("2001-01-01", "2001-04-02", SINCE_UNTIL)
MANY_SQL = " union all ".join(
    f"select *, date '{u}' as until from ({rolling_sql(ROLLING, u, label=True)})" for u in CUTOFFS
)


@query("l3_train_many_cutoffs", f"{ORDER_DAILY} {MANY_SQL}")
def _(spark, sf_dir):
    tx = order_lines(spark, sf_dir, *COLUMNS)
    return rounded(rolling_datasets(tx, START, CUTOFFS, True, ROLLING, decimals=4))


@query("rolling_everyone", f"{ORDER_DAILY} {rolling_sql(ROLLING, SINCE_UNTIL, label=True, population='all')}")
def _(spark, sf_dir):
    return rounded(
        R.rolling_features(order_daily(spark, sf_dir), SINCE_UNTIL, ROLLING, label=True, population="all")
    )


@query("rolling_dense", f"{EVENT_DAILY} {rolling_sql(replace(DENSE, extra=EXTRA), DENSE_UNTIL, label=True)}")
def rolling_dense(spark, sf_dir):
    spec = replace(DENSE, extra=EXTRA)
    return rounded(R.rolling_features(event_daily(spark, sf_dir), DENSE_UNTIL, spec, label=True))
