"""Queries over the TPC-H-like tables and documents, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.functions import cost, scalars
from evenload.operators import metrics, placed, sampling, workloads
from evenload.plans import placement, planners
from evenload.scratch import materialize, scratch_root
from evenload.sources import text as text_io

P = 8
CFG = PlanConfig(partitions=P)
#: Loads of queries that show them are counted, not sampled.
EXACT = replace(CFG, sampler="exact")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A key with about 40 % of its rows on 0.
HOT = "case when l_orderkey % 5 < 2 then 0 else l_orderkey % 64 end"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with (_file, _row), whose order is that of its rows."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, qty): lineitem by the hot key."""
    return table(spark, sf_dir, "lineitem").select(F.expr(HOT).cast("long").alias("k"), F.col("l_quantity").alias("qty"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, price, status): all orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, line, qty): all of lineitem under the order key 500 further on, so both join sides have unmatched keys."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 500).alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty")
    )


# Joins.

_SIDES = """
with o as (select o_orderkey as k, o_totalprice as price, o_orderstatus as status from orders),
l as (select l_orderkey + 500 as k, l_linenumber as line, l_quantity as qty from lineitem)
"""


def _join(how: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = placed.placed_join(orders(spark, sf_dir), lines(spark, sf_dir), ["k"], how, CFG, **options)
        return out.select("k", "price", "status", F.col("line").cast("double").alias("line"), "qty")

    return run


for _how in ("inner", "left", "right", "full"):
    query(f"join_{_how}", f"{_SIDES} select k, price, status, line::double as line, qty from o {_how} join l using (k)")(_join(_how))
query("join_input_only", f"{_SIDES} select k, price, status, line::double as line, qty from o join l using (k)")(_join("inner", input_only=True))
query("left_join_input_only", f"{_SIDES} select k, price, status, line::double as line, qty from o left join l using (k)")(_join("left", input_only=True))
query("right_join_input_only", f"{_SIDES} select k, price, status, line::double as line, qty from o right join l using (k)")(_join("right", input_only=True))


@query("subtract_by_key", f"{_SIDES} select line, qty, l.k from l where not exists (select 1 from o where o.k = l.k)")
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is not there, repeated rows kept."""
    return placed.subtract_by_key(lines(spark, sf_dir), orders(spark, sf_dir), ["k"], CFG).select("k", "line", "qty")


@query(
    "join_nullsafe",
    """select c.k::double as k, c_custkey, n_name from (select c_custkey, nullif(c_nationkey, 3) as k from customer) c
    join (select n_name, nullif(n_nationkey, 3) as k from nation) n on c.k is not distinct from n.k""",
)
def join_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys match null keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k"))
    n = table(spark, sf_dir, "nation").select("n_name", F.expr("nullif(n_nationkey, 3)").alias("k"))
    return placed.placed_join(c, n, ["k"], "inner", CFG, null_safe=True).select(F.col("k").cast("double").alias("k"), "c_custkey", "n_name")


for _strategy in ("hash", "range", "best_fit", "minmax"):

    @query(f"join_{_strategy}", f"{_SIDES} select k, count(*) as n, sum(qty) as qty from o join l using (k) group by k")
    def join_by(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        """The same join under another placement, grouped where it lies."""
        cfg = replace(CFG, strategy=strategy)
        out = placed.placed_join(orders(spark, sf_dir), lines(spark, sf_dir), ["k"], "inner", cfg)
        return out.groupBy("pid", "k").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")).drop("pid")


@query("flagship", "select o_orderkey as k, sum(l_extendedprice * (1 - l_discount)) as revenue from orders join lineitem on o_orderkey = l_orderkey group by 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per order: a placed join, summed where it lies."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice", "l_discount")
    out = placed.placed_join(o, l, ["k"], "inner", CFG)
    return out.groupBy("pid", "k").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue")).drop("pid")


# Aggregations.


@query("reduce_by_key", "select user_id, sum(value) as value from events group by 1")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum per key, merged in each input partition first."""
    return placed.reduce_by_key(table(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], {"value": "sum"}, CFG).drop("pid")


@query("group_by_key", "select user_id, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by 1")
def group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's values as a sorted list."""
    out = placed.group_by_key(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", CFG)
    return out.select("user_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@query("combine_by_key", "select l_suppkey, sum(l_quantity) / count(*) as mean from lineitem group by 1")
def combine_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean by three functions: start, merge, finish."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    out = placed.combine_by_key(
        table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", zero,
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"], CFG,
    )
    return out.select("l_suppkey", F.col("result").alias("mean"))


@query("distinct_pairs", "select distinct l_partkey, l_suppkey from lineitem")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of pairs."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("row_count", "select count(distinct o_custkey) as n from orders")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of distinct keys."""
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().agg(F.count("*").alias("n"))


# Cost model.

_V = """with v as (select coalesce(a.k, b.k) as k, coalesce(a.n, 0)::double as v1, coalesce(b.n, 0)::double as v2 from
(select o_orderkey as k, count(*) as n from orders group by 1) a full join
(select l_orderkey + 500 as k, count(*) as n from lineitem group by 1) b on a.k = b.k)
"""
#: The load of a key by operator type, as SQL over v1 and v2.
WEIGHT_SQL = {
    "join": "v1 * v2 + v1 + v2",
    "leftOuterJoin": "case when v2 <> 0 then v1 * v2 + v1 + v2 else 2 * v1 + v2 end",
    "rightOuterJoin": "case when v1 <> 0 then v1 * v2 + v1 + v2 else 2 * v2 + v1 end",
    "fullOuterJoin": "case when v1 = 0 then v1 + 2 * v2 when v2 = 0 then 2 * v1 + v2 else v1 * v2 + v1 + v2 end",
    "subtractByKey": "case when v2 <> 0 then v1 + v2 else 2 * v1 + v2 end",
    "joinnull": "v1 + v2",
    "leftOuterJoinnull": "v1 + v2",
    "rightOuterJoinnull": "v1 + v2",
}
for _type, _sql in WEIGHT_SQL.items():

    @query(f"key_weight_{_type}", f"{_V} select k, v1, v2, {_sql} as weight from v")
    def weights(spark: SparkSession, sf_dir: str, optype: str = _type) -> DataFrame:
        """Loads of a two-input operator."""
        loads = placement.key_loads(orders(spark, sf_dir), lines(spark, sf_dir), ["k"], optype, EXACT)
        return loads.select("k", "v1", "v2", "weight")


for _type, _sql in {"groupByKey": "v + 1", "combine": "v + 1", "sort": "2 * v"}.items():

    @query(f"key_weight_{_type}", f"select k, v, {_sql} as weight from (select {HOT} as k, count(*)::double as v from lineitem group by 1)")
    def one_sided(spark: SparkSession, sf_dir: str, optype: str = _type) -> DataFrame:
        """Loads of a one-input operator."""
        loads = placement.key_loads(hot(spark, sf_dir), None, ["k"], optype, EXACT)
        return loads.select("k", F.col("v1").alias("v"), "weight")


@query("key_weight_symmetric", f"select k, v * v + 2 * v as weight from (select {HOT} as k, count(*)::double as v from lineitem group by 1)")
def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join costed from one side alone."""
    return placement.key_loads(hot(spark, sf_dir), None, ["k"], "join", EXACT, assume_symmetric=True).select("k", "weight")


@query(
    "key_weight_reduceByKey",
    f"select k, count(distinct part)::double as v, count(distinct part) + 1.0::double as weight from (select {HOT} as k, l_suppkey % 4 as part from lineitem) group by 1",
)
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After map-side combining: a row of each of four input partitions that holds the key, and the result."""
    li = table(spark, sf_dir, "lineitem").select(F.expr(HOT).cast("long").alias("k"), (F.col("l_suppkey") % 4).cast("int").alias("part"))
    loads = placement.key_loads(li.repartitionById(4, F.col("part")), None, ["k"], "reduceByKey", EXACT, combined=True)
    return loads.select("k", F.col("v1").alias("v"), "weight")


# Balance.

_HOT_LOADS = f"""with h as (select ({HOT}) as k from lineitem), every as (select unnest(range({P}))::int as pid),
loads as (select every.pid, count(h.k) as rows, count(distinct h.k) as keys from every left join h on h.k % {P} = every.pid group by 1)
"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(hot(spark, sf_dir), ["k"], None, P)


@query("rows_per_partition", f"{_HOT_LOADS} select pid, rows from loads")
def rows_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each physical partition under hashing."""
    return metrics.balance(_hashed(spark, sf_dir), P).select("pid", "rows")


@query("keys_per_partition", f"{_HOT_LOADS} select pid, keys from loads")
def keys_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of each physical partition under hashing."""
    return metrics.balance(_hashed(spark, sf_dir), P, ["k"]).select("pid", "keys")


@query("bytes_per_partition", f"{_HOT_LOADS} select pid, rows, rows * 16 as bytes from loads")
def bytes_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated bytes of each partition under hashing."""
    return metrics.bytes_of(placement.with_pid(hot(spark, sf_dir), ["k"], None, P), P)


@query("hash_load", f"with k as (select {HOT} as k, 2.0::double * count(*) as w from lineitem group by 1), every as (select unnest(range({P}))::int as pid) select pid, coalesce(sum(w), 0) as load from every left join k on k % {P} = pid group by 1")
def hash_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of each hash bucket."""
    return placement.bucket_loads(placement.key_loads(hot(spark, sf_dir), None, ["k"], "sort", EXACT), P)


@query("fos_hash", f"{_HOT_LOADS} select round(stddev_pop(rows) / avg(rows), 9) as fos from loads")
def fos_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly hashing spreads the hot key."""
    return metrics.fos(metrics.balance(_hashed(spark, sf_dir), P)).select(F.round("fos", 9).alias("fos"))


_OUT = f"""with o as (select o_orderkey % 64 as k, count(*) as n from orders group by 1),
h as (select ({HOT}) as k, count(*) as n from lineitem group by 1), every as (select unnest(range({P}))::int as pid),
outs as (select h.k % {P} as pid, h.n * o.n as n from h join o using (k)),
ins as (select k % {P} as pid, n from h union all select k % {P}, n from o),
o_of as (select every.pid, coalesce(sum(n), 0) as rows from every left join outs using (pid) group by 1),
i_of as (select every.pid, coalesce(sum(n), 0) as rows from every left join ins using (pid) group by 1)
"""


def _out_and_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """Balance of the rows that a join of the hot key emits, and of those that it reads.

    A key emits the product of its rows, so output rows are counted and not made.
    """
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 64).alias("k"))
    sides = [metrics.balance(placement.place(x, ["k"], None, P), P) for x in (hot(spark, sf_dir).select("k"), o)]
    loads = placement.key_loads(hot(spark, sf_dir), o, ["k"], "join", EXACT)
    made = loads.groupBy(F.col("bucket").alias("pid")).agg(F.sum(F.col("v1") * F.col("v2")).cast("long").alias("rows"))
    out = metrics.every_partition(spark, P).join(made, "pid", "left").select("pid", F.coalesce("rows", F.lit(0)).alias("rows"))
    return out, sides


@query("fos_output", f"{_OUT} select round(stddev_pop(rows) / avg(rows), 9) as fos from o_of")
def fos_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly the join's output lies."""
    return metrics.fos(_out_and_in(spark, sf_dir)[0]).select(F.round("fos", 9).alias("fos"))


@query("fos_in_plus_out", f"{_OUT} select round(stddev_pop(o_of.rows + i_of.rows) / avg(o_of.rows + i_of.rows), 9) as fos from o_of join i_of using (pid)")
def fos_in_plus_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly rows read and emitted lie together."""
    out, sides = _out_and_in(spark, sf_dir)
    return metrics.fos(metrics.accumulated([out, *sides])).select(F.round("fos", 9).alias("fos"))


@query("accumulated_load", f"{_OUT} select pid, rows::bigint as rows from i_of")
def accumulated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition, summed over two exchanges."""
    return metrics.accumulated(_out_and_in(spark, sf_dir)[1])


@query("exchange_count", "select 2::int as placed, 3::int as grouped_by_key")
def exchange_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of a placed join that is grouped where it lies, and of one grouped by key alone."""
    out = placed.placed_join(orders(spark, sf_dir), lines(spark, sf_dir), ["k"], "inner", replace(CFG, strategy="hash"))
    here, away = out.groupBy("pid", "k").count(), out.groupBy("k").count()
    return spark.createDataFrame([(metrics.exchanges(here), metrics.exchanges(away))], "placed int, grouped_by_key int")


# Planners.


def _planned(spark: SparkSession, sf_dir: str, cfg: PlanConfig) -> tuple[DataFrame, DataFrame]:
    """Loads of orders' lines by a key with several heavy values, and the plan."""
    li = table(spark, sf_dir, "lineitem").select(F.expr("(l_orderkey % 40) * (l_orderkey % 40)").alias("k"))
    loads = materialize(placement.key_loads(li, None, ["k"], "sort", cfg), "loads")
    return loads, placement.make_plan(loads, ["k"], cfg)


_KEYS = f"""with k as (select (l_orderkey % 40) * (l_orderkey % 40) as k, 2.0::double * count(*) as w from lineitem group by 1),
b as (select k, w, (k % {P})::int as pid from k), loads as (select pid, sum(w) as load from b group by 1),
mean as (select sum(w) / {P} as mean from k)
"""


@query("overloaded_buckets", f"{_KEYS} select pid, load from loads, mean where load > 1.2 * mean")
def overloaded_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash buckets beyond the tolerated load."""
    loads, _ = _planned(spark, sf_dir, replace(EXACT, strategy="hash"))
    by_bucket = placement.bucket_loads(loads, P).withColumn("mean", F.expr(f"sum(load) over () / {P}"))
    return by_bucket.where("load > 1.2 * mean").select("pid", "load")


@query(
    "evicted_keys",
    f"""{_KEYS.replace("with k", "with recursive k", 1)}, ranked as (
    select b.k, b.w, b.pid, row_number() over (partition by b.pid order by b.w desc, b.k) as r
    from b join loads using (pid), mean where load > 1.2 * mean),
    walk as (select k, w, pid, r, w as held, false as out from ranked where r = 1 union all
      select n.k, n.w, n.pid, n.r, case when held + n.w <= 1.2 * mean then held + n.w else held end, held + n.w > 1.2 * mean
      from walk join ranked n on n.pid = walk.pid and n.r = walk.r + 1, mean)
    select k, w as weight, pid as bucket from walk where out""",
)
def evicted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that overloaded buckets give up."""
    loads, _ = _planned(spark, sf_dir, replace(EXACT, strategy="hash"))
    listed, fixed = placement.collected(loads, ["k"], EXACT)
    gone = planners.shed(listed, P, CFG.tolerance, fixed).movable
    return spark.createDataFrame([(*x.key, x.weight, x.bucket) for x in gone], "k long, weight double, bucket int")


# Plans in SQL: first and best fit walk over the evicted keys one by one, with the buckets' loads in a list.

_EVICTED = f"""{_KEYS.replace("with k", "with recursive k", 1)}, ranked as (
  select b.k, b.w, b.pid, row_number() over (partition by b.pid order by b.w desc, b.k) as r
  from b join loads using (pid), mean where load > 1.2 * mean),
shed as (select k, w, pid, r, w as held, false as gone from ranked where r = 1 union all
  select n.k, n.w, n.pid, n.r, case when held + n.w <= 1.2 * mean then held + n.w else held end, held + n.w > 1.2 * mean
  from shed join ranked n on n.pid = shed.pid and n.r = shed.r + 1, mean),
every as (select unnest(range({P}))::int as pid),
kept as (
  select every.pid, coalesce(load, 0) - coalesce((select sum(w) from shed where gone and shed.pid = every.pid), 0) as load
  from every left join loads using (pid)),
begin as (
  select (select list(load order by pid) from kept) as loads,
    (select list(pid order by load, pid) from kept) as emptiest,
    (select list({{'k': k, 'w': w}} order by pid, r) from shed where gone) as keys,
    (select list({{'k': k, 'w': w}} order by w desc, k) from shed where gone) as heaviest),
"""
_FIRST_FIT = f"""{_EVICTED}
walk as (
  select 0 as step, loads, [-1 for x in keys] as put from begin union all
  select step + 1,
    case when fits then [case when i = bucket then loads[i + 1] + w else loads[i + 1] end for i in range({P})] else loads end,
    case when fits then [case when i = spot then bucket else put[i + 1] end for i in range(len(put))] else put end
  from (
    select step, walk.loads, put, step % len(keys) as spot, emptiest[1 + step // len(keys)] as bucket, keys[1 + step % len(keys)].w as w,
      put[1 + step % len(keys)] < 0 and keys[1 + step % len(keys)].w <= mean - walk.loads[1 + emptiest[1 + step // len(keys)]] as fits
    from walk, begin, mean where step < {P} * len(keys))),
done as (select walk.loads, put, keys from walk, begin order by step desc limit 1),
placed as (select unnest(keys).k as k, unnest(keys).w as w, unnest(put) as pid from done),
rest as (select k, row_number() over (order by w desc, k) - 1 as r from placed where pid < 0),
left_over as (select list(i order by loads[i + 1], i) as emptiest from done, (select unnest(range({P})) as i)),
plan as (select k, pid from placed where pid >= 0 union all select k, emptiest[1 + r % {P}] from rest, left_over)
"""
_BEST_FIT = f"""{_EVICTED}
walk as (
  select 0 as step, loads, []::int[] as put from begin union all
  select step + 1, [case when i = bucket then loads[i + 1] + w else loads[i + 1] end for i in range({P})], list_append(put, bucket)
  from (
    select step, walk.loads, put, heaviest[1 + step].w as w,
      coalesce(
        list_min([{{'room': mean - walk.loads[i + 1], 'pid': i}} for i in range({P}) if mean - walk.loads[i + 1] >= heaviest[1 + step].w]),
        list_max([{{'room': mean - walk.loads[i + 1], 'pid': i}} for i in range({P})])).pid as bucket
    from walk, begin, mean where step < len(heaviest))),
done as (select put, heaviest from walk, begin order by step desc limit 1),
plan as (select unnest(heaviest).k as k, unnest(put) as pid from done)
"""
_RANGES = f"""{_KEYS}, cum as (select k, w, sum(w) over (order by k) as cum, sum(w) over () as grand from k),
plan as (select k, least({P - 1}, floor((cum - w) * {P} / grand)) as pid from cum)
"""
_PLANS = {"range": _RANGES, "first_fit": _FIRST_FIT, "best_fit": _BEST_FIT}
_BALANCE = f""", buckets as (select unnest(range({P}))::int as pid),
after as (select coalesce(plan.pid, b.pid)::int as pid, sum(w) as load from b left join plan using (k) group by 1)
select pid, coalesce(loads.load, 0) as hashed, coalesce(after.load, 0) as planned from buckets left join loads using (pid) left join after using (pid)"""

for _strategy in ("range", "first_fit", "best_fit", "minmax"):

    @query(f"{_strategy}_plan", f"{_PLANS[_strategy]} select k, pid::int as pid from plan" if _strategy in _PLANS else None)
    def plan(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        """Keys and the partition they move to."""
        loads, moved = _planned(spark, sf_dir, replace(EXACT, strategy=strategy))
        if isinstance(moved, placement.Bounds):
            return placement.with_pid(loads, ["k"], moved, P).select("k", "pid")
        return moved.select("k", "pid")

    @query(f"{_strategy}_balance", f"{_PLANS[_strategy]} {_BALANCE}" if _strategy in _PLANS else None)
    def plan_balance(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        """The load of each partition under hashing and under the plan."""
        loads, moved = _planned(spark, sf_dir, replace(EXACT, strategy=strategy))
        after = placement.with_pid(loads, ["k"], moved, P).groupBy("pid").agg(F.sum("weight").alias("planned"))
        before = placement.bucket_loads(loads, P)
        return before.join(after, "pid", "left").select("pid", F.col("load").alias("hashed"), F.coalesce("planned", F.lit(0.0)).alias("planned"))


def _minmax_sql() -> str:
    """The least largest load of contiguous segments, by dynamic programming: a common table expression per segment."""
    parts = [
        _KEYS + ", cum as (select row_number() over (order by k) as i, sum(w) over (order by k) as cum from k)",
        "ends as (select i, cum from cum union all select 0, 0.0)",
        "s1 as (select i, cum as best from ends)",
    ]
    for j in range(2, P + 1):
        parts.append(
            f"s{j} as (select b.i, min(greatest(s{j - 1}.best, b.cum - a.cum)) as best from ends b join ends a on a.i <= b.i join s{j - 1} on s{j - 1}.i = a.i group by 1)"
        )
    return ",\n".join(parts) + f" select best as peak, true as in_order from s{P} order by i desc limit 1"


@query("minmax_peak", _minmax_sql())
def minmax_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest load of the min-max segments, and whether segments follow the order of keys."""
    loads, moved = _planned(spark, sf_dir, replace(EXACT, strategy="minmax"))
    per = placement.with_pid(loads, ["k"], moved, P).groupBy("pid").agg(
        F.sum("weight").alias("load"), F.min("k").alias("low"), F.max("k").alias("high")
    )
    follows = per.withColumn("in_order", F.expr("low > lag(high, 1, -1L) over (order by pid)"))
    return follows.agg(F.max("load").alias("peak"), F.bool_and("in_order").alias("in_order"))


@query("stock_range_place", f"select ({HOT})::bigint as k, count(*) as n, 1::bigint as parts from lineitem group by 1")
def stock_range_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by Spark's own ranges: a key's rows and the partitions that hold them."""
    sent = placement.range_place(hot(spark, sf_dir), ["k"], P).withColumn("pid", F.spark_partition_id())
    return sent.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("parts"))


# Splitting ranges and sorting.

_CUM = f"""with k as (select {HOT} as k, count(*)::double as w from lineitem group by 1),
c as (select k, w, sum(w) over (order by k) as cum, sum(w) over () / {P} as step from k), s as (select *, cum - w as prev from c)
"""


def _hot_split(spark: SparkSession, sf_dir: str, descending: bool = False) -> DataFrame:
    counts = hot(spark, sf_dir).groupBy("k").agg(F.count("*").alias("weight"))
    return placement.split_range(counts, "k", P, descending=descending)


@query(
    "split_range_bounds",
    f"""{_CUM} select j::int as j, k as bound_key, round((j * step - greatest(prev, (j - 1) * step)) / (cum - greatest(prev, (j - 1) * step)), 9) as ratio
    from s, (select unnest(range(1, {P})) as j) where prev < j * step and j * step <= cum""",
)
def split_range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range bounds that may fall inside a heavy key."""
    return placement.split_bounds(_hot_split(spark, sf_dir), "k", P).withColumn("ratio", F.round("ratio", 9))


@query(
    "split_range_loads",
    f"""{_CUM} select pid::int as pid, k, round(least(cum, (pid + 1) * step) - greatest(prev, pid * step), 6) as load
    from s, (select unnest(range({P})) as pid) where least(cum, (pid + 1) * step) > greatest(prev, pid * step)""",
)
def split_range_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each key every range gets."""
    return placement.split_shares(_hot_split(spark, sf_dir), "k", P).withColumn("load", F.round("load", 6))


@query("balanced_sort", f"select row_number() over (order by k) as position, k from (select {HOT} as k from lineitem)")
def balanced_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global order over even partitions, the heavy key split."""
    return placement.balanced_sort(hot(spark, sf_dir).select("k"), "k", P).select("position", "k")


@query("balanced_sort_desc", f"select row_number() over (order by k desc) as position, k from (select {HOT} as k from lineitem)")
def balanced_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in falling order."""
    return placement.balanced_sort(hot(spark, sf_dir).select("k"), "k", P, descending=True).select("position", "k")


@query("balanced_sort_fos", "select true as even")
def balanced_sort_fos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the largest partition of the balanced sort is within a tenth of the mean."""
    held = placement.cut_keys(_hot_split(spark, sf_dir), "k", P)
    sent = placement.split_place(hot(spark, sf_dir).select("k"), "k", held, P).repartitionById(P, F.col("pid"))
    return metrics.max_over_mean(metrics.balance(sent, P)).select((F.col("peak") < 1.1).alias("even"))


@query("range_rank", "select o_orderkey, rank() over (order by o_totalprice desc, o_orderkey) as r from orders")
def range_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank over stock ranges: rows before the range and rows within."""
    from evenload.plans.prefix import running_total

    o = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("p"), F.lit(1).alias("one"))
    return running_total(o, ["p", "o_orderkey"], "one").select("o_orderkey", F.col("cum").alias("r"))


@query("sort_words", "select row_number() over (order by w) as position, w as word from (select unnest(string_split(c_name || ' ' || c_mktsegment, ' ')) as w from customer)")
def sort_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words in order."""
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"))
    return workloads.sort_words(rows, P)


# Samples.

_SAMPLE = """with e as (select event_id, user_id, event_id % 8 as part, md5(event_id::varchar) as o from events),
r as (select *, row_number() over (partition by part order by o) as rn, count(*) over (partition by part) as n from e),
s as (select part::int as part_id, user_id, event_id, n as part_rows, least(50, n) as part_sample from r where rn <= 50)
"""


def _event_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.by_rank(e, (F.col("event_id") % 8).cast("int"), [F.md5(F.col("event_id").cast("string"))], 50)


@query("sample_by_rank", f"{_SAMPLE} select part_id, event_id, user_id, part_rows, part_sample from s")
def sample_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of each part, with its rows and sample."""
    return _event_sample(spark, sf_dir).select("part_id", "event_id", "user_id", "part_rows", F.col("part_sample").cast("long").alias("part_sample"))


@query("sketch_weights", f"{_SAMPLE} select part_id, user_id, count(*) as freq, max(part_rows / part_sample) as weight from s group by 1, 2")
def sketch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frequencies of a sample and rows per sampled row."""
    return sampling.key_sketch(_event_sample(spark, sf_dir), ["user_id"])


@query("distinct_key_sketch", f"{_SAMPLE} select distinct part_id, user_id from s")
def distinct_key_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys occur in each part's sample."""
    return sampling.distinct_keys(_event_sample(spark, sf_dir), ["user_id"])


@query("reservoir_weight", "select count(*)::double as rows from lineitem")
def reservoir_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rows of a reservoir sample: they add up to all rows."""
    sketch = sampling.key_sketch(sampling.reservoir(hot(spark, sf_dir).select("k"), 500), ["k"])
    return sketch.agg(F.round(F.sum(F.col("freq") * F.col("weight")), 3).alias("rows"))


@query("rejection_weight", "select count(*)::double as rows from lineitem")
def rejection_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for samples whose size follows the rows of each partition."""
    sketch = sampling.key_sketch(sampling.exact_rate(hot(spark, sf_dir).select("k"), 100, 0.2), ["k"])
    return sketch.agg(F.round(F.sum(F.col("freq") * F.col("weight")), 3).alias("rows"))


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot keys in four input partitions of known rows."""
    li = table(spark, sf_dir, "lineitem").select(F.expr(HOT).cast("long").alias("k"), (F.col("l_suppkey") % 4).cast("int").alias("part"))
    return li.repartitionById(4, F.col("part"))


_FOUR = "with f as (select (l_suppkey % 4)::int as part_id, count(*) as part_rows from lineitem group by 1)"


def _sizes(sample: DataFrame) -> DataFrame:
    """Rows, sample and distinct sampled rows of each input partition."""
    return sample.groupBy("part_id").agg(F.max("part_rows").alias("part_rows"), F.max("part_sample").alias("part_sample"), F.count("*").alias("rows"))


@query("reservoir_sizes", f"{_FOUR} select part_id, part_rows, least(500, part_rows) as part_sample, least(500, part_rows) as rows from f")
def reservoir_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each input partition a reservoir holds."""
    return _sizes(sampling.reservoir(_four(spark, sf_dir), 500))


@query(
    "rejection_sizes",
    f"{_FOUR}, s as (select *, least(part_rows, greatest(100, least(floor(0.2::double * part_rows)::bigint, 1000))) as size from f) select part_id, part_rows, size as part_sample, size as rows from s",
)
def rejection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each input partition a sample at a rate holds."""
    return _sizes(sampling.exact_rate(_four(spark, sf_dir), 100, 0.2, 10.0))


@query("weighted_sizes", f"{_FOUR} select round(part_rows / least(200, part_rows), 9) as weight, sum(least(200, part_rows))::bigint as n from f group by 1")
def weighted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled keys by weight: one over the chance of being sampled."""
    keys = sampling.weighted_keys(_four(spark, sf_dir), ["k"], 200)
    return keys.groupBy(F.round("weight", 9).alias("weight")).agg(F.count("*").alias("n"))


@query("full_fraction_sketch", f"select (l_suppkey % 4)::int as part_id, ({HOT})::bigint as k, count(*) as freq, 1.0::double as weight from lineitem group by 1, 2")
def full_fraction_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of samples that hold all rows of all input partitions: exact frequencies of weight 1."""
    return sampling.key_sketch(sampling.reservoir(_four(spark, sf_dir), 10**9, fraction=1.0), ["k"])


@query("reservoir_sketch")
def reservoir_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frequencies of reservoir samples of the input partitions."""
    return sampling.key_sketch(sampling.reservoir(hot(spark, sf_dir).select("k"), 500), ["k"])


@query("rejection_sketch")
def rejection_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frequencies of samples at a rate."""
    return sampling.key_sketch(sampling.exact_rate(hot(spark, sf_dir).select("k"), 100, 0.2), ["k"])


@query("bernoulli_sample")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the same chance."""
    return sampling.bernoulli(hot(spark, sf_dir), 0.1)


@query("weighted_sample")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled keys and one over their chance."""
    return sampling.weighted_keys(hot(spark, sf_dir), ["k"], 200)


@query("partition_fraction_sketch")
def partition_fraction_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservoir samples of half of eight input partitions, chosen by hash."""
    keyed = hot(spark, sf_dir).select("k").repartition(8)
    return sampling.key_sketch(sampling.reservoir(keyed, 200, fraction=0.5), ["k"])


# Scalars.


@query("sample_size", "select n, greatest(100, least(floor(n * 0.2::double)::bigint, 100000))::bigint as size from (select count(*) as n from lineitem group by l_suppkey)")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of a partition by its rows."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.select("n", sampling.sample_size_column(F.col("n"), F.lit(100), 0.2, 1000.0).alias("size"))


@query(
    "poisson_bound",
    "select n, round(greatest(n + case when n < 6 then 12 when n < 16 then 9 else 6 end * sqrt(n), 1e-10), 6) as bound from (select l_orderkey, count(*)::double as n from lineitem group by 1)",
)
def poisson_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean that makes a sample of n very likely."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n"))
    return n.select("n", F.round(scalars.poisson_upper_column(F.col("n")), 6).alias("bound"))


@query(
    "bernoulli_bound",
    """with n as (select l_suppkey, count(*)::double as n from lineitem group by 1), g as (select n, -ln(0.0001::double) / n as g, 0.1::double as f from n)
    select n, round(least(1, greatest(1e-10, f + g + sqrt(g * g + 2 * g * f))), 6) as rate from g""",
)
def bernoulli_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that makes a tenth of n rows very likely."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"))
    return n.select("n", F.round(scalars.binomial_upper_column(1e-4, F.col("n"), F.lit(0.1)), 6).alias("rate"))


@query(
    "size_code",
    """with s as (select o_custkey, floor(sum(o_totalprice))::bigint as size from orders group by 1),
    c as (select size, case when size = 0 then 0 when size <= 1 then 1 else least(255, ceil(ln(size::double) / ln(1.1::double))) end::int as code from s)
    select size, code, case when code = 0 then 0 else floor(pow(1.1::double, code::double)) end::bigint as decoded from c""",
)
def size_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as powers of a base in one byte, and back.

    A sum of doubles that ends near a whole number falls on either side of it by the order of its
    terms, so the terms are added in the order of the table, as the SQL does in one thread.
    """
    sums = placed.ordered_sum(in_order(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", ["_file", "_row"])
    s = sums.select(F.floor("o_totalprice").cast("long").alias("size"))
    coded = s.select("size", scalars.size_code(F.col("size")).alias("code"))
    return coded.withColumn("decoded", scalars.size_decode(F.col("code")))


# Text.


def _written(spark: SparkSession, df: DataFrame, name: str, keys: str | None = None) -> DataFrame:
    """Lines written by a sink and read again."""
    import uuid

    path = f"{scratch_root(spark)}/evenload/{name}-{uuid.uuid4().hex}"
    if keys:
        text_io.write_keys(df, keys, path)
    else:
        text_io.write_tuples(df, path)
    return text_io.read_lines(spark, path)


@query("text_tuples", "select '(' || n_nationkey || ',' || n_name || ')' as value from nation")
def text_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as tuples and read as lines."""
    return _written(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "tuples")


@query("text_pairs", "select o_orderkey as k, o_orderpriority as v from orders")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lines written, read and parsed."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", F.lit("more")).alias("line"))
    return text_io.parse_pairs(_written(spark, o, "pairs", "line"))


@query("text_edges", "select distinct (l_suppkey % 50)::varchar as src, (l_partkey % 50)::varchar as dst from lineitem")
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines written, read and parsed; repeated edges count once."""
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.expr("l_suppkey % 50"), F.lit(" \t "), F.expr("l_partkey % 50"), F.lit(" x")).alias("line"))
    return text_io.parse_edges(_written(spark, l, "edges", "line"))


@query(
    "word_split",
    """with l as (select unnest(string_split(text, chr(10))) as line from documents),
    w as (select unnest(case when line = '' then [''] when regexp_full_match(line, ' +') then [] else string_split(regexp_replace(line, ' +$', ''), ' ') end) as word from l)
    select word, count(*) as n from w group by 1""",
)
def word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all lines, counted."""
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    words = text_io.parse_words(rows).withColumn("n", F.lit(1).cast("long"))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


# Iteration and generation.


def pagerank_sql(iterations: int) -> str:
    """PageRank unrolled: a common table expression per round."""
    parts = [
        "e as (select distinct (o_custkey % 97 + 10)::varchar as src, (o_orderkey * 7 % 97)::varchar as dst from orders)",
        "d as (select src, count(*) as degree from e group by 1)",
        "r0 as (select src as url, 1.0::double as rank from d)",
    ]
    for i in range(iterations):
        parts.append(
            f"r{i + 1} as (select dst as url, 0.15 + 0.85 * sum(rank / degree) as rank from e join d using (src) join r{i} on url = src group by dst)"
        )
    return f"with {', '.join(parts)} select url, round(rank, 6) as rank from r{iterations}"


@query("pagerank", pagerank_sql(5))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds over edges with sources without in-links and targets without out-links."""
    e = table(spark, sf_dir, "orders").select(
        F.expr("cast(o_custkey % 97 + 10 as string)").alias("src"), F.expr("cast(o_orderkey * 7 % 97 as string)").alias("dst")
    )
    return workloads.pagerank(e, 5).select("url", F.round("rank", 6).alias("rank"))


@query("skewed_word_count")
def skewed_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated pairs, counted by key under a plan."""
    return workloads.count_by_key(workloads.skewed_pairs(spark, 4, 1000, 100, 5, P), replace(CFG, strategy="best_fit"))
