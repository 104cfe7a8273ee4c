"""Semantic queries: measures, dimensions, filters, joins, grains, periods, subtotals, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, timegrain
from ..operators import pivot
from ..semantic import And, Filter, Or, Order, Period, QuerySpec
from .registry import query
from .tables import engine, read

_STAR = "lineitem l left join orders o on l_orderkey=o_orderkey left join customer c on o_custkey=c_custkey left join nation n on c_nationkey=n_nationkey left join region r on n_regionkey=r_regionkey"
_REV = "sum(l_extendedprice*(1-l_discount))"


def _round(df, *columns, n=4):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), n))
    return df


@query(f"""with a as (select n_nationkey nation, date_trunc('month', o_orderdate)::date order_month, {_REV} revenue from {_STAR} group by all),
 b as (select a.*, p.revenue revenue_prev, (a.revenue-p.revenue)/nullif(p.revenue,0) revenue_change from a left join a p on a.nation=p.nation and a.order_month = p.order_month + interval 1 month)
 select nation, order_month, round(revenue,2) revenue, round(revenue_prev,2) revenue_prev, round(revenue_change,6) revenue_change, coalesce(n_name, nation::varchar) nation_label
 from (select * from b order by revenue desc, nation, order_month limit 20) x left join nation on nation = n_nationkey""")
def flagship(spark, d):
    spec = QuerySpec(("revenue",), ("nation", "order_month"), period=Period("order_month", "month", 1), order=(Order("revenue", True), Order("nation"), Order("order_month")), limit=20, labels=True)
    return _round(_round(engine(spark, d).query(spec), "revenue", "revenue_prev", n=2), "revenue_change", n=6)


def _simple(name, measures, dims, sql, where=None, having=None, digits=4, **more):
    @query(sql, name)
    def run(spark, d):
        df = engine(spark, d).query(QuerySpec(tuple(measures), tuple(dims), where, having, **more))
        return _round(df, *[m for m in df.columns if m not in dims and dict(df.dtypes)[m] in ("double",)], n=digits)


_G = "l_returnflag returnflag, l_linestatus linestatus"
_simple("agg_sum", ["quantity", "gross"], ["returnflag", "linestatus"], f"select {_G}, round(sum(l_quantity),4) quantity, round(sum(l_extendedprice),4) gross from lineitem group by all")
_simple("agg_count", ["lines", "open_lines"], ["returnflag", "linestatus"], f"select {_G}, count(l_orderkey) \"lines\", nullif(count(case when l_linestatus='O' then l_orderkey end),0) open_lines from lineitem group by all")
_simple("agg_count_distinct", ["parts"], ["returnflag"], "select l_returnflag returnflag, count(distinct l_partkey) parts from lineitem group by all")
_simple("agg_min_max_avg", ["min_price", "max_price", "avg_price"], ["returnflag"], "select l_returnflag returnflag, min(l_extendedprice) min_price, max(l_extendedprice) max_price, round(avg(l_extendedprice),4) avg_price from lineitem group by all")
_simple("agg_stddev", ["std_price"], ["linestatus"], "select l_linestatus linestatus, round(stddev_pop(l_extendedprice),4) std_price from lineitem group by all")


@query("select l_returnflag returnflag, " + ", ".join(f"round(quantile_disc(l_extendedprice, {q / 100}),4)::double p{q}_price" for q in (50, 90, 95, 99)) + " from lineitem group by all")
def agg_percentile(spark, d):
    names = [f"p{q}_price" for q in (50, 90, 95, 99)]
    return _round(engine(spark, d).query(QuerySpec(tuple(names), ("returnflag",))), *names)


_simple("star_join", ["revenue"], ["brand", "priority"], f"select p_brand brand, o_orderpriority priority, round({_REV},4) revenue from lineitem left join part on l_partkey=p_partkey left join orders on l_orderkey=o_orderkey group by all")
_simple("snowflake_join", ["revenue", "lines"], ["region", "segment"], f"select r_name region, c_mktsegment segment, round({_REV},4) revenue, count(l_orderkey) \"lines\" from {_STAR} group by all")
_simple("join_elimination", ["lines"], ["orderkey"], "select l_orderkey orderkey, count(*) \"lines\" from lineitem group by all")
_simple("multi_measure_same_fact", ["revenue", "returned_quantity", "lines", "open_lines"], ["returnflag"], f"select l_returnflag returnflag, round({_REV},4) revenue, round(sum(case when l_returnflag='R' then l_quantity end),4) returned_quantity, count(*) \"lines\", nullif(count(case when l_linestatus='O' then l_orderkey end),0) open_lines from lineitem group by all")
_simple("no_dimension", ["revenue", "order_value"], [], f"select (select round({_REV},2) from lineitem) revenue, (select round(sum(o_totalprice),2) from orders) order_value", digits=2)
_simple("extended_measure", ["returned_late", "returned_quantity"], ["priority"], "select o_orderpriority priority, round(sum(case when l_linestatus='F' and l_returnflag='R' then l_quantity end),4) returned_late, round(sum(case when l_returnflag='R' then l_quantity end),4) returned_quantity from lineitem left join orders on l_orderkey=o_orderkey group by all")
_simple("composite_measure", ["average_line", "return_rate", "return_rate_late"], ["linestatus"], f"select l_linestatus linestatus, round({_REV}/count(*),4) average_line, round(coalesce(sum(case when l_returnflag='R' then l_quantity end),0)/sum(l_quantity),4) return_rate, round((coalesce(sum(case when l_returnflag='R' and l_linestatus='F' then l_quantity end),0)+coalesce(sum(case when l_returnflag='R' then l_quantity end),0))/sum(l_quantity),4) return_rate_late from lineitem group by all")
_simple("formula_measure", ["discount_share"], ["returnflag"], f"select l_returnflag returnflag, round((sum(l_extendedprice)-{_REV})/sum(l_extendedprice),4) discount_share from lineitem group by all")
_simple("drill_across", ["revenue", "order_value", "order_count"], ["segment", "order_year"], f"with a as (select c_mktsegment segment, date_trunc('year',o_orderdate)::date order_year, {_REV} revenue from {_STAR} group by all), b as (select c_mktsegment segment, date_trunc('year',o_orderdate)::date order_year, sum(o_totalprice) order_value, count(*) order_count from orders left join customer on o_custkey=c_custkey group by all) select coalesce(a.segment,b.segment) segment, coalesce(a.order_year,b.order_year) order_year, round(revenue,4) revenue, round(order_value,4) order_value, order_count from a full join b on a.segment is not distinct from b.segment and a.order_year is not distinct from b.order_year")
_simple("cross_fact_formula", ["value_per_revenue"], ["priority"], f"with a as (select o_orderpriority priority, {_REV} x from lineitem left join orders on l_orderkey=o_orderkey group by all), b as (select o_orderpriority priority, sum(o_totalprice) y from orders group by all) select priority, round(y/x,4) value_per_revenue from b left join a using(priority)")
_simple("derived_dimension", ["lines"], ["size_band"], "select case when p_size<10 then 'small' when p_size<30 then 'medium' else p_size::varchar end size_band, count(*) \"lines\" from lineitem left join part on l_partkey=p_partkey group by all")
_simple("format_measure", ["return_percent"], ["linestatus"], "select l_linestatus linestatus, printf('%.1f', round(coalesce(sum(case when l_returnflag='R' then l_quantity end),0)/sum(l_quantity)*100,1)) || '%' return_percent from lineitem group by all")

# filters
_LINES = "select l_returnflag returnflag, count(*) \"lines\" from lineitem left join orders on l_orderkey=o_orderkey where {} group by all"
for _name, _tree, _sql in (
    ("filter_in", Filter("priority", "in", ("1-URGENT", "2-HIGH", "")), "o_orderpriority in ('1-URGENT','2-HIGH','') or o_orderpriority is null"),
    ("filter_not_in", Filter("priority", "notIn", ("1-URGENT",)), "o_orderpriority not in ('1-URGENT') or o_orderpriority is null"),
    ("filter_between", Filter("order_month", "between", ("1996-01-01", "1996-06-01")), "date_trunc('month',o_orderdate) between date '1996-01-01' and date '1996-06-01'"),
    ("filter_like", Filter("priority", "contains", ("HIGH",)), "contains(o_orderpriority,'HIGH')"),
    ("filter_not_like", Filter("priority", "notContains", ("HIGH",)), "not contains(o_orderpriority,'HIGH')"),
    ("filter_compare", And((Filter("order_day", "gt", ("1997-01-01",)), Filter("order_day", "lte", ("1998-01-01",)), Filter("orderstatus", "notEquals", ("P",)))), "o_orderdate::date > date '1997-01-01' and o_orderdate::date <= date '1998-01-01' and o_orderstatus <> 'P'"),
    ("filter_null", Or((Filter("priority", "notSet"), Filter("orderstatus", "set"))), "o_orderpriority is null or o_orderstatus is not null"),
    ("filter_empty", Filter("priority", "notEmpty"), "o_orderpriority <> ''"),
    ("filter_date_range", Filter("order_day", "inDateRange", ("1996-02-01", "1996-02-29")), "o_orderdate::date between date '1996-02-01' and date '1996-02-29'"),
    ("filter_before_after", And((Filter("order_day", "afterDate", ("1996-02-01",)), Filter("order_day", "beforeOrOnDate", ("1996-12-31",)))), "o_orderdate::date > date '1996-02-01' and o_orderdate::date <= date '1996-12-31'"),
    ("filter_or", Or((Filter("priority", "equals", ("5-LOW",)), And((Filter("orderstatus", "equals", ("O",)), Filter("order_year", "equals", ("1996-01-01",)))))), "o_orderpriority='5-LOW' or (o_orderstatus='O' and year(o_orderdate)=1996)"),
    ("filter_time_range", Filter("order_day", "between", timegrain.relative_range("last_quarter", "1997-05-20")), "o_orderdate::date between date '1997-01-01' and date '1997-03-31'"),
    ("filter_period_key", Filter("order_day", "between", timegrain.key_range("1997Q3")), "o_orderdate::date between date '1997-07-01' and date '1997-09-30'"),
):
    _simple(_name, ["lines"], ["returnflag"], _LINES.format(_sql), where=_tree)

_simple("having_measure", ["revenue"], ["brand"], f"select p_brand brand, round({_REV},4) revenue from lineitem left join part on l_partkey=p_partkey group by all having {_REV} > 1000000", having=Filter("revenue", "gt", (1_000_000,)))
_simple("filter_tree", ["revenue", "lines"], ["brand", "priority"], f"select p_brand brand, o_orderpriority priority, round({_REV},4) revenue, count(*) \"lines\" from lineitem left join part on l_partkey=p_partkey left join orders on l_orderkey=o_orderkey where l_returnflag='R' group by all having o_orderpriority='5-LOW' or count(*) > 150", where=And((Filter("returnflag", "equals", ("R",)), Or((Filter("priority", "equals", ("5-LOW",)), Filter("lines", "gt", (150,)))))))
_simple("order_custom", ["lines"], ["priority"], "select o_orderpriority priority, count(*) \"lines\" from lineitem left join orders on l_orderkey=o_orderkey group by o_orderpriority order by case o_orderpriority when '5-LOW' then 1 when '3-MEDIUM' then 2 else 9999 end, priority limit 3", order=(Order("priority", values=("5-LOW", "3-MEDIUM")), Order("priority")), limit=3)
_simple("order_numeric", ["lines"], ["part_size"], "select p_size part_size, count(*) \"lines\" from lineitem left join part on l_partkey=p_partkey group by p_size order by p_size::decimal(22,2) desc limit 7", order=(Order("part_size", True, numeric=True),), limit=7)
_simple("page_query", ["lines"], ["brand"], "select p_brand brand, count(*) \"lines\" from lineitem left join part on l_partkey=p_partkey group by all order by 2 desc, 1 limit 5 offset 10", order=(Order("lines", True), Order("brand")), limit=5, offset=10)
_simple("top_k", ["revenue"], ["nation_name"], f"select n_name nation_name, round({_REV},4) revenue from {_STAR} group by all order by {_REV} desc, 1 limit 10", order=(Order("revenue", True), Order("nation_name")), limit=10)


@query("select l_shipdate::date - o_orderdate::date as days, count(*) \"lines\" from lineitem join orders on l_orderkey=o_orderkey group by all")
def datediff_dimension(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days")).agg(F.count("*").alias("lines"))


@query("select l.* from lineitem l join orders on l_orderkey=o_orderkey where l_returnflag='R' and l_linestatus='F' and o_orderpriority='1-URGENT'")
def measure_detail(spark, d):
    return engine(spark, d).detail("returned_late", Filter("priority", "equals", ("1-URGENT",)))


@query("select c_mktsegment segment, count(*) order_count from orders join customer on o_custkey=c_custkey where c_mktsegment in ('BUILDING','MACHINERY') and o_orderstatus in ('O','F') group by all")
def row_level_security(spark, d):
    e = engine(spark, d, policies={"segment": ("BUILDING", "MACHINERY")})
    return e.query(QuerySpec(("order_count",), ("segment",), Filter("orderstatus", "in", ("O", "F"))))


@query("select c_mktsegment segment, count(*) order_count from orders left join customer on o_custkey=c_custkey group by all")
def column_level_security(spark, d):
    return engine(spark, d, denied=frozenset({"order_value"})).query(QuerySpec(("order_count", "order_value"), ("segment",)))


@query("select distinct c_mktsegment segment from customer where contains(c_mktsegment,'I') order by 1 desc limit 3")
def dimension_values(spark, d):
    return engine(spark, d).members("segment", "I", 3)


@query("select count(*) total from (select distinct p_brand, o_orderpriority from lineitem left join part on l_partkey=p_partkey left join orders on l_orderkey=o_orderkey)")
def count_query(spark, d):
    return engine(spark, d).count(QuerySpec(("lines",), ("brand", "priority")))


@query("select distinct 'brand' dimension from part where p_brand='Brand#11' union all select distinct 'segment' from customer where c_mktsegment='Brand#11'")
def dimensions_by_value(spark, d):
    e = engine(spark, d)
    each = [e.members(n).filter(F.col(n) == "Brand#11").select(F.lit(n).alias("dimension")) for n in ("brand", "segment")]
    return each[0].unionByName(each[1])


# grains and periods
for _g, _sql in (("year", "strftime(o_orderdate,'%Y')"), ("quarter", "year(o_orderdate)||'Q'||quarter(o_orderdate)"), ("month", "strftime(o_orderdate,'%Y-%m')"), ("week", "isoyear(o_orderdate)||lpad(weekofyear(o_orderdate)::varchar,2,'0')"), ("day", "strftime(o_orderdate,'%Y-%m-%d')")):

    @query(f"select {_sql} period, count(*) orders from orders group by all", f"grain_{_g}")
    def _grain(spark, d, g=_g):
        return read(spark, d, "orders").groupBy(timegrain.period_key(F.col("o_orderdate"), g).alias("period")).agg(F.count("*").alias("orders"))


@query("select strftime(ts,'%Y-%m-%d %H') period, count(*) events from events group by all")
def grain_hour(spark, d):
    return read(spark, d, "events").groupBy(timegrain.period_key(F.col("ts"), "hour").alias("period")).agg(F.count("*").alias("events"))


@query("select year(o_orderdate)||lpad((case when month(o_orderdate)=1 and weekofyear(o_orderdate)>=52 then 0 when month(o_orderdate)=12 and weekofyear(o_orderdate)=1 then 53 else weekofyear(o_orderdate) end)::varchar,2,'0') period, count(*) orders from orders group by all")
def grain_calendar_week(spark, d):
    return read(spark, d, "orders").groupBy(timegrain.calendar_week_key(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("orders"))


def _pop(name, dim, unit, n, interval, grain, result="rate", extra=()):
    dims, more = (dim, *extra), "".join(f", o_orderpriority {x}" for x in extra)
    change = {"rate": "(a.order_value-p.order_value)/nullif(p.order_value,0)", "difference": "a.order_value-p.order_value", "ratio": "a.order_value/nullif(p.order_value,0)"}[result]
    on = "".join(f" and a.{x} is not distinct from p.{x}" for x in extra)
    sql = f"with a as (select date_trunc('{grain}',o_orderdate)::date {dim}{more}, sum(o_totalprice) order_value from orders group by all) select a.{dim}{''.join(f', a.{x}' for x in extra)}, round(a.order_value,2) order_value, round(p.order_value,2) order_value_prev, round({change},4) order_value_change from a left join a p on a.{dim} = (p.{dim} + interval {interval})::date{on}"

    @query(sql, name)
    def run(spark, d):
        df = engine(spark, d).query(QuerySpec(("order_value",), dims, period=Period(dim, unit, n, result=result)))
        return _round(_round(df, "order_value", "order_value_prev", n=2), "order_value_change")


_pop("pop_previous_period", "order_month", "month", 1, "1 month", "month", extra=("priority",))
_pop("pop_previous_quarter", "order_quarter", "quarter", 1, "3 month", "quarter")
_pop("pop_previous_year", "order_year", "year", 1, "1 year", "year", "difference")
_pop("pop_previous_week", "order_week", "week", 1, "7 day", "week")
_pop("pop_previous_day", "order_day", "day", 1, "1 day", "day", "ratio")
_pop("pop_wow", "order_day", "week", 1, "7 day", "day")
_pop("pop_mom", "order_month", "month", 1, "1 month", "month", "difference")
_pop("pop_yoy", "order_month", "year", 1, "1 year", "month", "ratio")
_pop("pop_custom_offset", "order_month", "month", 5, "5 month", "month")


@query("with a as (select date_trunc('month',o_orderdate)::date order_month, o_orderpriority priority, sum(o_totalprice) v from orders group by all) select a.order_month, a.priority, round(a.v,2) order_value, round(p.v,2) order_value_prev, round(a.v/p.v,4) order_value_change from a left join a p on p.order_month=date '1996-01-01' and a.priority=p.priority")
def pop_fixed(spark, d):
    df = engine(spark, d).query(QuerySpec(("order_value",), ("order_month", "priority"), period=Period("order_month", fixed="1996-01-01", result="ratio")))
    return _round(_round(df, "order_value", "order_value_prev", n=2), "order_value_change")


@query("with a as (select date_trunc('month',o_orderdate)::date order_month, sum(o_totalprice) v from orders group by all) select a.order_month, round(a.v,2) order_value, round(p.v,2) order_value_prev, round((a.v-p.v)/p.v,4) order_value_change from a join a p on a.order_month=(p.order_month + interval 1 month)::date where (a.v-p.v)/p.v > 0.05 order by (a.v-p.v)/p.v desc, 1 limit 5")
def pop_filter_order(spark, d):
    spec = QuerySpec(("order_value",), ("order_month",), period=Period("order_month", "month", 1), having=Filter("order_value_change", "gt", (0.05,)), order=(Order("order_value_change", True), Order("order_month")), limit=5)
    return _round(_round(engine(spark, d).query(spec), "order_value", "order_value_prev", n=2), "order_value_change")


_MONTHLY = "with a as (select date_trunc('month',o_orderdate)::date order_month, sum(o_totalprice) v from orders group by all)"


@query(_MONTHLY + " select a.order_month, round(a.v,2) order_value, round(p.v,2) order_value_prev, round((a.v-p.v)/p.v,4) order_value_change from a left join a p on a.order_month=(p.order_month + interval 1 month)::date where a.order_month between date '1996-03-01' and date '1996-08-01'")
def pop_filtered(spark, d):
    where = Filter("order_month", "between", ("1996-03-01", "1996-08-01"))
    df = engine(spark, d).query(QuerySpec(("order_value",), ("order_month",), where, period=Period("order_month", "month", 1)))
    return _round(_round(df, "order_value", "order_value_prev", n=2), "order_value_change")


@query(_MONTHLY + " select a.order_month, round(a.v,2) order_value, round(p.v,2) order_value_prev, round(a.v/p.v,4) order_value_change from a left join a p on p.order_month=date '1995-01-01' where a.order_month >= date '1997-06-01'")
def pop_fixed_filtered(spark, d):
    where = Filter("order_month", "gte", ("1997-06-01",))
    df = engine(spark, d).query(QuerySpec(("order_value",), ("order_month",), where, period=Period("order_month", fixed="1995-01-01", result="ratio")))
    return _round(_round(df, "order_value", "order_value_prev", n=2), "order_value_change")


@query("with a as (select date_trunc('month',o_orderdate)::date order_month, o_orderpriority priority, sum(o_totalprice) v from orders where o_orderdate::date between date '1996-05-01' and date '1996-06-15' group by all), p as (select date_trunc('month',o_orderdate)::date order_month, o_orderpriority priority, sum(o_totalprice) v from orders where o_orderdate::date between date '1995-05-01' and date '1995-06-15' group by all) select a.order_month, a.priority, round(a.v,2) order_value, round(p.v,2) order_value_prev, round(a.v-p.v,4) order_value_change from a left join p on a.order_month=(p.order_month + interval 1 year)::date and a.priority=p.priority")
def pop_partial_period(spark, d):
    where = Filter("order_day", "inDateRange", ("1996-05-01", "1996-06-15"))
    df = engine(spark, d).query(QuerySpec(("order_value",), ("order_month", "priority"), where, period=Period("order_month", "year", 1, result="difference")))
    return _round(_round(df, "order_value", "order_value_prev", n=2), "order_value_change")


# level of detail
@query(f"with a as (select r_name region, c_mktsegment segment, {_REV} revenue from {_STAR} group by all) select region, segment, round(revenue,4) revenue, round((select sum(revenue) from a b where b.region=a.region),4) region_revenue from a")
def lod_fixed(spark, d):
    return _round(engine(spark, d).level_of_detail(QuerySpec(("revenue",), ("region", "segment")), "revenue", ("region",), "region_revenue"), "revenue", "region_revenue")


@query(f"with a as (select r_name region, c_mktsegment segment, {_REV} revenue from {_STAR} where o_orderstatus='F' group by all), b as (select c_mktsegment segment, {_REV} x from {_STAR} group by all) select region, segment, round(revenue,4) revenue, round(x,4) segment_revenue from a left join b using(segment)")
def lod_exclude(spark, d):
    return _round(engine(spark, d).level_of_detail(QuerySpec(("revenue",), ("region", "segment"), Filter("orderstatus", "equals", ("F",))), "revenue", ("segment",), "segment_revenue"), "revenue", "segment_revenue")


@query(f"select l_returnflag returnflag, round({_REV},4) revenue, (select round({_REV},4) from lineitem where l_linestatus='O') open_revenue from lineitem group by all")
def dsl_calculate(spark, d):
    return _round(engine(spark, d).level_of_detail(QuerySpec(("revenue",), ("returnflag",)), "revenue", (), "open_revenue", Filter("linestatus", "equals", ("O",))), "revenue", "open_revenue")


# subtotals and pivots
_simple("rollup_table", ["revenue", "avg_price"], ["region", "segment"], f"select r_name region, c_mktsegment segment, grouping(r_name, c_mktsegment)::bigint grouping_id, round({_REV},4) revenue, round(avg(l_extendedprice),4) avg_price from {_STAR} group by rollup(r_name, c_mktsegment)", subtotals="rollup")
_simple("cube_subtotals", ["lines", "parts"], ["returnflag", "linestatus"], "select l_returnflag returnflag, l_linestatus linestatus, grouping(l_returnflag, l_linestatus)::bigint grouping_id, count(*) \"lines\", count(distinct l_partkey) parts from lineitem group by cube(l_returnflag, l_linestatus)", subtotals="cube")
_simple("grouping_sets", ["quantity"], ["returnflag", "priority"], "select l_returnflag returnflag, o_orderpriority priority, grouping(l_returnflag, o_orderpriority)::bigint grouping_id, round(sum(l_quantity),4) quantity from lineitem left join orders on l_orderkey=o_orderkey group by grouping sets ((l_returnflag, o_orderpriority), (l_returnflag), (o_orderpriority), ())", subtotals=(("returnflag", "priority"), ("returnflag",), ("priority",), ()))


@query("select o_orderpriority, " + ", ".join(f"round(sum(case when o_orderstatus='{s}' then o_totalprice end),2) \"{s}_total\", count(case when o_orderstatus='{s}' then 1 end) \"{s}_n\"" for s in "FOP") + " from orders group by all")
def pivot_matrix(spark, d):
    out = pivot.matrix(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], {"total": F.round(F.sum("o_totalprice"), 2), "n": F.count("o_orderkey")})
    return out.na.fill(0, [f"{s}_n" for s in "FOP"])


_RETURNS = "select l_linestatus, l_returnflag, (sum(l_extendedprice)-sum(l_extendedprice*(1-l_discount)))/nullif(sum(l_extendedprice),0) share, sum(l_quantity) quantity from lineitem group by all"


@query(f"with x as ({_RETURNS}) select l_linestatus, " + ", ".join(f"round(max(case when l_returnflag='{v}' then share end),6) \"{v}_discount_share\", round(max(case when l_returnflag='{v}' then quantity end),2) \"{v}_quantity\"" for v in "ANR") + " from x group by all")
def pivot_formula(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(((F.sum("l_extendedprice") - F.sum(F.expr("l_extendedprice * (1 - l_discount)"))) / F.sum("l_extendedprice")).alias("discount_share"), F.sum("l_quantity").alias("quantity"))
    got = pivot.spread(rows, ["l_linestatus"], "l_returnflag", ["A", "N", "R"], ["discount_share", "quantity"])
    return _round(_round(got, *[f"{v}_quantity" for v in "ANR"], n=2), *[f"{v}_discount_share" for v in "ANR"], n=6)


@query("with x as (select o_orderpriority priority, date_trunc('year',o_orderdate)::date y, sum(o_totalprice) v, count(*)::double c from orders group by all) " + " union all ".join(f"select priority, '{m}' measure, " + ", ".join(f"round(max(case when y=date '{y}-01-01' then {e} end),2) \"{y}-01-01\"" for y in (1995, 1996, 1997)) + " from x group by priority" for m, e in (("order_value", "v"), ("order_count", "c"))))
def pivot_measures_on_rows(spark, d):
    import datetime

    years = [datetime.date(y, 1, 1) for y in (1995, 1996, 1997)]
    got = pivot.spread(engine(spark, d).query(QuerySpec(("order_value", "order_count"), ("priority", "order_year"))), ["priority"], "order_year", years, ["order_value", "order_count"], on_rows=True)
    return _round(got, *[str(y) for y in years], n=2)


@query("select case when grouping(o_orderstatus)=1 then 'all states' else o_orderstatus end o_orderstatus, case when grouping(o_orderpriority)=1 then 'all priorities' else o_orderpriority end o_orderpriority, grouping(o_orderstatus,o_orderpriority)::bigint as level, round(sum(o_totalprice),2) v from orders group by cube(o_orderstatus,o_orderpriority)")
def subtotal_labels(spark, d):
    dims = ["o_orderstatus", "o_orderpriority"]
    got = pivot.subtotals(read(spark, d, "orders"), dims, {"v": F.round(F.sum("o_totalprice"), 2)}, "cube")
    return pivot.labelled(got, dims, {"o_orderstatus": "all states", "o_orderpriority": "all priorities"})


@query("with a as (select l_returnflag, l_linestatus, avg(l_extendedprice) v from lineitem group by all) select l_returnflag, l_linestatus, grouping(l_returnflag,l_linestatus)::bigint as level, round(sum(v),4) v from a group by rollup(l_returnflag,l_linestatus)")
def summed_subtotals(spark, d):
    a = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("v"))
    return _round(pivot.summed_subtotals(a, ["l_returnflag", "l_linestatus"], ["v"]), "v")


@query("with a as (select p_brand, count(*) n from part group by all), b as (select *, row_number() over (order by n desc, p_brand) as row_number from a) select * from b where row_number between 6 and 10")
def matrix_page(spark, d):
    return pivot.page(read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), [F.desc("n"), "p_brand"], 2, 5).withColumn("row_number", F.col("row_number").cast("long"))


@query("select o_orderpriority, round(sum(o_totalprice),0)::bigint integer_value, round(sum(o_totalprice)/1e6,2) millions, round(avg(o_totalprice),1) decimal_value from orders group by all")
def format_units(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"))
    return g.select("o_orderpriority", formats.formatted(F.col("s"), "integer").alias("integer_value"), formats.formatted(F.col("s"), "unit:M").alias("millions"), formats.formatted(F.col("a"), "decimal1").alias("decimal_value"))


@query("with g as (select o_orderpriority, sum(o_totalprice) s, avg(o_totalprice) a, count(*) n from orders group by all) select o_orderpriority, s > 0 as ok, if(n > 2900, 'many', 'few') size, o_orderpriority || '-' || n::varchar label, round((a + n) * 2, 2) calc from g")
def dsl_row(spark, d):
    from ..functions.formula import compile_formula

    g = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"), F.count("*").alias("n"))
    c = lambda text: compile_formula(text, F.col)
    return g.select("o_orderpriority", c("[s] > 0").alias("ok"), c("if([n] > 2900, 'many', 'few')").alias("size"), c("Concatenate([o_orderpriority], '-', [n])").alias("label"), F.round(c("([a] + [n]) × 2"), 2).alias("calc"))


@query("with a as (select l_returnflag, l_linestatus, sum(l_quantity) q from lineitem group by all) select l_returnflag, l_linestatus, round(q,2) quantity, round(q / sum(q) over (partition by l_returnflag),6) share from a")
def proportion(spark, d):
    from ..semantic.engine import proportion as share

    g = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))
    return _round(_round(share(g, "quantity", ["l_returnflag"]), "quantity", n=2), "share", n=6)


@query("select o_orderpriority priority, round(sum(o_totalprice),2) total, count(*) n from orders where o_orderstatus='F' and o_totalprice between 1000 and 200000 group by all order by total desc limit 4")
def semantic_sql(spark, d):
    from ..semantic.sql import semantic_sql as run

    return run(engine(spark, d), "SELECT priority, SUM(order_value) AS total, order_count AS n FROM ad.semantic WHERE orderstatus = 'F' AND order_price BETWEEN 1000 AND 200000 ORDER BY total DESC LIMIT 4", extra={"order_price": ("orders", "o_totalprice")}).withColumn("total", F.round("total", 2))
