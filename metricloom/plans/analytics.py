"""Queries of the analytic operators: attribution, alerts, series, statistics, metadata, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, attribution, forecasting, meta, pivot, series, text
from .registry import query
from .tables import CATALOG, NAMES, read

_PERIODS = "select {g} member, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) as current, coalesce(sum(case when year(o_orderdate)=1996 then o_totalprice end),0) base from orders left join customer on o_custkey=c_custkey where year(o_orderdate) in (1996,1997) group by all"


def _members(spark, d, column):
    o = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("y", F.year("o_orderdate"))
    side = lambda y: o.filter(F.col("y") == y).groupBy(F.col(column).alias("member")).agg(F.sum("o_totalprice").alias("v"))
    return attribution.period_full_join(side(1997), side(1996), ["member"], "v")


def _round(df, *columns, n=6):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), n))
    return df


@query(f"with m as ({_PERIODS.format(g='c_nationkey')}) select member, round(current,2) as current, round(base,2) base from m")
def period_full_join(spark, d):
    return _round(_members(spark, d, "c_nationkey"), "current", "base", n=2)


@query(f"with m as ({_PERIODS.format(g='c_mktsegment')}), t as (select sum(base) b, sum(current-base) x from m) select member, round(current,2) as current, round(base,2) base, round(current-base,2) delta, round((current-base)/base,6) delta_rate, round((current-base)/b,6) contribution, round(((current-base)/b)/(x/b),6) contribution_share from m, t")
def contribution_additive(spark, d):
    return _round(_round(attribution.additive(_members(spark, d, "c_mktsegment")), "current", "base", "delta", n=2), "delta_rate", "contribution", "contribution_share")


_FACTORS = "with f as (select o_orderpriority k, sum(case when year(o_orderdate)=1996 then o_totalprice end) a0, sum(case when year(o_orderdate)=1997 then o_totalprice end) a1, count(case when year(o_orderdate)=1996 then 1 end)::double b0, count(case when year(o_orderdate)=1997 then 1 end)::double b1 from orders group by all) "


def _factors(spark, d):
    y = F.year("o_orderdate")
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("a0"), F.sum(F.when(y == 1997, F.col("o_totalprice"))).alias("a1"), F.count(F.when(y == 1996, 1)).cast("double").alias("b0"), F.count(F.when(y == 1997, 1)).cast("double").alias("b1")
    )


@query(_FACTORS + "select k, round((a1-a0)/(a0-b0),6) minuend, round(-(b1-b0)/(a0-b0),6) subtrahend from f")
def contribution_subtraction(spark, d):
    a, b = attribution.subtraction(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"), F.col("a0") - F.col("b0"))
    return _factors(spark, d).select("k", F.round(a, 6).alias("minuend"), F.round(b, 6).alias("subtrahend"))


@query(_FACTORS + "select k, round((a1*b1-a0*b0)*ln(a1/a0)/(ln(a1*b1)-ln(a0*b0))/(a0*b0),6) first, round((a1*b1-a0*b0)*ln(b1/b0)/(ln(a1*b1)-ln(a0*b0))/(a0*b0),6) as second from f")
def contribution_multiplication(spark, d):
    c = F.col
    part = lambda x: F.round(attribution.multiplication(c(f"{x}0"), c(f"{x}1"), c("a0") * c("b0"), c("a1") * c("b1")), 6)
    return _factors(spark, d).select("k", part("a").alias("first"), part("b").alias("second"))


@query(_FACTORS + "select k, round(a1/b0-a0/b0,4) dividend, round(a1/b1-a1/b0,4) divisor from f")
def contribution_division(spark, d):
    a, b = attribution.division(*map(F.col, ("a0", "a1", "b0", "b1")))
    return _factors(spark, d).select("k", F.round(a, 4).alias("dividend"), F.round(b, 4).alias("divisor"))


@query(_FACTORS + ", t as (select sum(a0) ta0, sum(a1) ta1, sum(b0) tb0, sum(b1) tb1 from f) select k, round((a1/b1-a0/b0)*(b0/tb0)+(b1/tb1-b0/tb0)*(a1/b1-ta0/tb0),4) effect from f, t")
def contribution_two_factor(spark, d):
    f = _factors(spark, d)
    t = f.agg(*[F.sum(x).alias(f"t{x}") for x in ("a0", "a1", "b0", "b1")])
    return f.crossJoin(t).select("k", F.round(attribution.two_factor(*map(F.col, ("a0", "a1", "b0", "b1", "ta0", "ta1", "tb0", "tb1"))), 4).alias("effect"))


@query(f"with m as ({_PERIODS.format(g='c_nationkey')}), e as (select member, base/(select sum(base) from m) * (case when current>0 and base>0 then (case when current=base then current else (current-base)/(ln(current)-ln(base)) end)*(ln(current)-ln(base)) else current-base end) effect from m) select member, round(effect,4) effect, round(effect/(select sum(effect) from e),6) effect_share from e order by abs(effect) desc, member limit 20")
def lmdi_by_dimension(spark, d):
    return _round(_round(attribution.lmdi_by_dimension(_members(spark, d, "c_nationkey"), "base").select("member", "effect", "effect_share"), "effect", n=4), "effect_share")


@query(f"with m as ({_PERIODS.format(g='c_nationkey')}), s as (select *, current/sum(current) over () s1, base/sum(base) over () s0 from m), k as (select *, (1/(1+exp(-(s1-s0))))/(1/(1+exp(-s0))) k from s), r as (select *, sum(abs(base)+abs(current)) over w / sum(abs(base)+abs(current)) over () x, sum(abs(current-base)) over w / sum(abs(current-base)) over () y from k window w as (order by k, current, base rows unbounded preceding)), t as (select (x-lag(x) over (order by k, current, base))*(y+lag(y) over (order by k, current, base))/2 a from r) select 'nation' dim, round(1-2*sum(a),6) gini from t")
def gini_change(spark, d):
    return _round(attribution.gini_of_change(_members(spark, d, "c_nationkey").withColumn("dim", F.lit("nation")), ["dim"]), "gini")


@query("with m as (select p_brand, sum(l_quantity) q from lineitem join part on l_partkey=p_partkey group by all), r as (select p_brand, q, row_number() over w as rank, q/sum(q) over () share, sum(q) over (w rows unbounded preceding)/sum(q) over () running_share from m window w as (order by q desc, p_brand)) select p_brand, q, rank, round(share,6) share, round(running_share,6) running_share, running_share - share < 0.8 in_cut from r")
def pareto(spark, d):
    m = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("q"))
    return _round(attribution.pareto(m, "p_brand", "q").withColumn("rank", F.col("rank").cast("long")), "share", "running_share")


@query("with t as (select sum(case when year(o_orderdate)=1997 then o_totalprice end) as current, sum(case when year(o_orderdate)=1996 then o_totalprice end) base from orders) select round(current,2) as current, round(base,2) base, round(current-base,2) delta, round((current-base)/base*100,3) delta_percent from t")
def attribution_overview(spark, d):
    y = F.year("o_orderdate")
    return _round(attribution.overview(read(spark, d, "orders"), "o_totalprice", y == 1997, y == 1996), "current", "base", "delta", n=2)


@query(f"with m as ({_PERIODS.format(g='c_nationkey')}), s as (select member, current, base, current-base delta, case when sign(current-base)=(select sign(sum(current)-sum(base)) from m) then 'same' else 'opposite' end trend from m where current<>base), r as (select *, row_number() over (partition by trend order by abs(delta) desc, member) as rank from s) select trend, rank, member, round(current,2) as current, round(base,2) base, round(delta,2) delta from r where rank<=3")
def attribution_detail(spark, d):
    return _round(attribution.detail(_members(spark, d, "c_nationkey"), "member").withColumn("rank", F.col("rank").cast("long")), "current", "base", "delta", n=2)


@query("with m as (select c_mktsegment a, o_orderpriority b, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) as current, coalesce(sum(case when year(o_orderdate)=1996 then o_totalprice end),0) base from orders join customer on o_custkey=c_custkey where year(o_orderdate) in (1996,1997) group by all) select a, b, round((current-base)/sum(base) over w,6) contribution, round(current/sum(current) over w,6) proportion, row_number() over (partition by a order by abs((current-base)/s) desc, b) as rank from (select *, sum(base) over (partition by a) s from m) window w as (partition by a)")
def dismantling_tree(spark, d):
    y = F.year("o_orderdate")
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(y.isin(1996, 1997))
    zero = lambda yy: F.coalesce(F.sum(F.when(y == yy, F.col("o_totalprice"))), F.lit(0.0))
    m = o.groupBy(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(zero(1997).alias("current"), zero(1996).alias("base"))
    return _round(attribution.dismantling_level(m, ["a"], "b").select("a", "b", "contribution", "proportion", F.col("rank").cast("long").alias("rank")), "contribution", "proportion")


@query("with v as (select event_type metric, user_id % 7 member, sum(value) - 100 v from events group by all), n as (select *, v/sum(abs(v)) over (partition by metric) n from v) select member, count(*) metrics, round(min(n),6) lowest, round(max(n),6) highest, round(sum(abs(n)),6) weight, case when min(n)>0 then 'driver' when max(n)<0 then 'detractor' else 'opposing' end kind from n group by all having count(*)>1")
def common_contributors(spark, d):
    v = read(spark, d, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 7).alias("member")).agg((F.sum("value") - 100).alias("v"))
    return _round(attribution.common_contributors(v, "metric", "member", "v"), "lowest", "highest", "weight")


# alerts
_SERIES = "select event_type k, ts::date p, sum(value) * (case when day(ts) = 13 then 6 when day(ts) = 20 then 0.001 else 1 end) v from events group by event_type, ts::date, day(ts)"
_STATS = "s as (select k, count(v) n, median(v) med, quantile_cont(v,0.25) q1, quantile_cont(v,0.75) q3, median(case when abs(v)>1e-12 then abs(v) end) b from x group by k), m as (select x.k, median(abs(v-med)) mad from x join s using(k) group by all)"


def _events(spark, d):
    day = F.dayofmonth("ts")
    factor = F.when(day == 13, 6.0).when(day == 20, 0.001).otherwise(1.0)
    return read(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("p"), factor.alias("f")).agg(F.sum("value").alias("s")).select("k", "p", (F.col("s") * F.col("f")).alias("v"))


@query(f"with x as ({_SERIES}), {_STATS}, r as (select x.*, s.*, mad, lag(v) over (partition by x.k order by p) prev from x join s using(k) join m using(k)), z as (select k, p, v, greatest(case when b>0 and abs(v)<=greatest(b*0.01,1e-9) then 3 when mad>0 and abs(0.6745*(v-med)/mad)>=5 then 3 when mad>0 and abs(0.6745*(v-med)/mad)>=3.5 then 2 when q3>q1 and (v<q1-3*(q3-q1) or v>q3+3*(q3-q1)) then 2 else 0 end, case when abs(prev)>1e-12 and ((v-prev)/abs(prev)<=-0.9 or (v-prev)/abs(prev)>=3) then 3 when abs(prev)>1e-12 and abs((v-prev)/abs(prev))>=1.5 then 2 else 0 end) severity from r where n>=3) select k, p, round(v,4) v, severity from z where severity>0")
def alert_self(spark, d):
    return _round(alerts.self_anomalies(_events(spark, d), ["k"], "p", "v"), "v", n=4)


@query(f"with x as ({_SERIES}), {_STATS}, r as (select x.k, p, v, (q3>q1 and v>q3+2.5*(q3-q1)) or (med>0 and v>=med*5) up, (q3>q1 and v<q1-2.5*(q3-q1)) or (med>0 and v<=greatest(med*0.02,1e-9)) dn from x join s using(k) where n>=4) select k, p, round(v,4) v, case when up then 'high' else 'low' end direction, case when bool_or(up) over (partition by k) and bool_or(dn) over (partition by k) then 3 else 2 end severity from r where up or dn")
def alert_path(spark, d):
    return _round(alerts.path_anomalies(_events(spark, d), ["k"], "p", "v"), "v", n=4)


@query(f"with x as ({_SERIES}) select k, p, round(v,4) v from x where v > 3300 and p not in (select p from x where k='view' and v > 3300)")
def alert_expression(spark, d):
    x = _events(spark, d)
    return _round(alerts.expression_anomalies(x.filter("k = 'view' and v > 3300"), x.filter("v > 3300"), ["p"]).select("k", "p", "v"), "v", n=4)


@query(f"with x as ({_SERIES}) select k, p, round(v,4) v, 'high' as rule, 3 severity from x where v>2000 union all select k, p, round(v,4), 'odd', 2 from x where v<10 or v>3000")
def alert_threshold(spark, d):
    return _round(alerts.thresholds(_events(spark, d), [("high", "v", "gt", (2000,), 3), ("odd", "v", "outside", (10, 3000), 2)]), "v", n=4)


@query("select event_id, user_id, value, 'expensive' as rule, 2 severity from events where value >= 99 union all select event_id, user_id, value, 'zero', 3 from events where value = 0")
def alert_document_scan(spark, d):
    return alerts.thresholds(read(spark, d, "events").select("event_id", "user_id", "value"), [("expensive", "value", "gte", (99,), 2), ("zero", "value", "zero", (), 3)])


@query("with t as (select c_mktsegment, sum(case when year(o_orderdate)=1997 then o_totalprice end) as current, sum(case when year(o_orderdate)=1996 then o_totalprice end) base from orders join customer on o_custkey=c_custkey group by all) select c_mktsegment, round(current,2) as current, round(base,2) base, round((current-base)/base,6) as change from t where abs((current-base)/base) < 0 or (current-base)/base <= -0.01 or (current-base)/base >= 0.01")
def monitor_rule(spark, d):
    y = F.year("o_orderdate")
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _round(_round(alerts.monitor(o, ["c_mktsegment"], "o_totalprice", y == 1997, y == 1996, "notBetween", (-0.01, 0.01)), "current", "base", n=2), "change")


_FENCES = " union all ".join(f"select '{c}' column_name, count(*) n, count({c}) n_values, count(case when {c}<>0 then 1 end)=0 all_zero, count(case when {c}<a-1.5*(b-a) or {c}>b+1.5*(b-a) then 1 end) mild, count(case when {c}<a-3*(b-a) or {c}>b+3*(b-a) then 1 end) extreme from lineitem, (select quantile_cont({c},0.25) a, quantile_cont({c},0.75) b from lineitem)" for c in ("l_extendedprice", "l_discount", "l_tax"))


@query(_FENCES)
def sanity_checks(spark, d):
    return alerts.sanity(read(spark, d, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"])


# series
@query("select range::date period, year(range) as year, quarter(range) as quarter, month(range) as month, weekofyear(range) as \"week\", isodow(range) weekday, isodow(range)<6 is_workday from range(date '2024-01-01', date '2024-04-01', interval 1 day)")
def calendar_spine(spark, d):
    from ..functions.timegrain import calendar

    c = calendar(spark, "2024-01-01", "2024-03-31")
    return c.select("period", *[F.col(x).cast("long").alias(x) for x in ("year", "quarter", "month", "week", "weekday")], "is_workday")


@query("select date_trunc('month',range)::date m, count(case when isodow(range)<6 then 1 end) workdays from range(date '1996-01-01', date '1997-01-01', interval 1 day) group by all")
def workdays(spark, d):
    from ..functions.timegrain import calendar

    c = calendar(spark, "1996-01-01", "1996-12-31")
    return c.groupBy(F.to_date(F.date_trunc("month", "period")).alias("m")).agg(F.count(F.when(F.col("is_workday"), 1)).alias("workdays"))


@query("with h as (select unnest([date '1996-01-01', date '1996-05-01', date '1996-12-25']) h), x as (select distinct date_trunc('month',o_orderdate)::date m from orders where year(o_orderdate)=1996), c as (select m, unnest(range(m, m + interval 1 month, interval 1 day))::date p from x) select m, count(case when isodow(p)<6 and p not in (select h from h) then 1 end)::int workdays, count(case when isodow(p)<6 then 1 end)::int by_formula from c group by m")
def workdays_of_months(spark, d):
    from ..functions.formula import compile_formula
    from ..functions.timegrain import workdays_in

    m = read(spark, d, "orders").filter(F.year("o_orderdate") == 1996).select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).distinct()
    return m.select("m", workdays_in(F.col("m"), "month", ("1996-01-01", "1996-05-01", "1996-12-25")).alias("workdays"), compile_formula("Workday([m])", F.col).alias("by_formula"))


@query("select o_orderpriority k, date_trunc('month',o_orderdate)::date p, round(avg(o_totalprice),4) v, count(*) points from orders group by all")
def series_collapse(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("p"), F.col("o_totalprice").alias("v"))
    return _round(series.collapse(o, ["k"], "p", "v", "mean"), "v", n=4)


def _gappy(spark, d):
    # users have days without events, event types have none
    return read(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("p")).agg(F.sum("value").alias("v"))


@query("with x as (select user_id k, ts::date p, sum(value) v from events group by all), e as (select k, min(p) a, max(p) b from x group by k), c as (select k, unnest(range(a, b + interval 1 day, interval 1 day))::date p from e), j as (select c.k, c.p, v, row_number() over (partition by c.k order by c.p) i from c left join x on c.k=x.k and c.p=x.p), f as (select *, last_value(case when v is not null then i end ignore nulls) over w pi, last_value(v ignore nulls) over w pv, first_value(case when v is not null then i end ignore nulls) over z ni, first_value(v ignore nulls) over z nv from j window w as (partition by k order by p rows between unbounded preceding and 1 preceding), z as (partition by k order by p rows between 1 following and unbounded following)) select k, p, round(coalesce(v, pv+(nv-pv)*(i-pi)/(ni-pi)),4) v, v is null missing from f")
def gap_fill(spark, d):
    return _round(series.fill(_gappy(spark, d), ["k"], "p", "v", "1 day", "interpolate"), "v", n=4)


@query("with x as (select user_id k, ts::date p, sum(value) v from events group by all), e as (select k, min(p) a, max(p) b from x group by k), c as (select k, unnest(range(a, b + interval 1 day, interval 1 day))::date p from e) select c.k, c.p, round(coalesce(v,0),4) v, v is null missing from c left join x on c.k=x.k and c.p=x.p")
def gap_fill_zero(spark, d):
    return _round(series.fill(_gappy(spark, d), ["k"], "p", "v", "1 day", "zero"), "v", n=4)


@query("with x as (select event_type k, ts::date p, sum(value) v from events group by all), l as (select k, max(p) q, arg_max(v,p) z, arg_min(v,p) a, count(*) n from x group by k), r as (select *, row_number() over (partition by k order by p desc) r from x) select l.k, s::int as step, (q + s::int) p, round(z,4) naive, round(z+(z-a)/greatest(n-1,1)*s,4) drift, round(r.v,4) seasonal from l, range(1,11) t(s) left join r on r.k=l.k and r.r = 7-((s-1)%7)")
def forecast_simple(spark, d):
    x = read(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("p")).agg(F.sum("value").alias("v"))
    return _round(series.simple_forecast(x, ["k"], "p", "v", 10, "day", 7), "naive", "drift", "seasonal", n=4)


@query()
def forecast_auto(spark, d):
    x = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("p")).agg(F.sum("o_totalprice").alias("v"))
    return forecasting.auto_forecast(x, ["k"], "p", "v", 6, 12)


@query("with x as (select o_orderpriority k, date_trunc('month',o_orderdate) p, sum(o_totalprice) v from orders group by all), l as (select k, v, lag(v) over (partition by k order by p) g from x) select k, round(avg(abs(v-g)),2) mae, round(sum(abs(v-g))/sum(abs(v)),6) wape, round(avg(2*abs(v-g)/(abs(v)+abs(g))),6) smape, round(avg(abs(v-g))/avg(abs(v-g)),6) mase from l where g is not null group by k")
def forecast_metrics(spark, d):
    from pyspark.sql import Window

    x = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.date_trunc("month", "o_orderdate").alias("p")).agg(F.sum("o_totalprice").alias("v"))
    x = x.withColumn("g", F.lag("v").over(Window.partitionBy("k").orderBy("p"))).filter("g is not null").withColumn("s", F.abs(F.col("v") - F.col("g")))
    return _round(_round(series.error_metrics(x, ["k"], "v", "g", "s"), "mae", n=2), "wape", "smape", "mase")


@query("with x as (select user_id k, ts::date p, sum(value) v from events group by all), e as (select k, min(p) a, max(p) b, count(*) n, stddev_pop(v) s from x group by k) select k, (b-a+1)::bigint expected, n points, round(0.45*n/(b-a+1)+0.25*least(1.0,n/40.0)+0.2+0.1*(case when s>1e-12 then 1 else 0.8 end),6) score from e")
def series_quality(spark, d):
    return series.quality_score(series.fill(_gappy(spark, d), ["k"], "p", "v", "1 day"), ["k"], "v")


@query("with x as (select c_mktsegment k, sum(case when year(o_orderdate)=1997 then o_totalprice end) a, sum(case when year(o_orderdate)=1996 then o_totalprice end) t from orders join customer on o_custkey=c_custkey group by all), r as (select k, ceil(a/t*10000-1e-9)/10000 rate from x) select k, rate, case when rate>=1 then 'achieved' when rate<0.9 then 'behind' else 'close' end goal_status from r")
def goal_achievement(spark, d):
    y = F.year("o_orderdate")
    x = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("k")).agg(F.sum(F.when(y == 1997, F.col("o_totalprice"))).alias("a"), F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("t"))
    return series.goal_achievement(x, "a", "t").select("k", "rate", "goal_status")


_ERFC = "(t*exp(-z*z-1.26551223+t*(1.00002368+t*(0.37409196+t*(0.09678418+t*(-0.18628806+t*(0.27886807+t*(-1.13520398+t*(1.48851587+t*(-0.82215223+t*0.17087277))))))))))"


@query(
    "with x as (select o_orderpriority, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) actual, sum(case when year(o_orderdate)=1996 then o_totalprice end)*0.3 forecast, stddev_samp(o_totalprice)*2*sqrt(count(*)) sigma, sum(case when year(o_orderdate)=1996 then o_totalprice end)*1.3 target from orders group by all),"
    " a as (select *, actual+forecast projected, (target-actual-forecast)/sigma g from x), b as (select *, abs(g)/sqrt(2) z, 1/(1+0.5*abs(g)/sqrt(2)) t from a),"
    f" c as (select *, case when g>=0 then {_ERFC}/2 else 1-{_ERFC}/2 end p from b)"
    " select o_orderpriority, round(actual,2) actual, round(projected,2) projected, round(least(1,greatest(0,p)),6) probability, round(greatest(0,target-projected),2) gap, round(greatest(0,target-actual)/4,2) required_pace, case when actual>=target then 'ACHIEVED' when p>=0.7 then 'ON_TRACK' when p>=0.3 then 'AT_RISK' else 'OFF_TRACK' end status from c"
)
def pace_to_goal(spark, d):
    y = F.year("o_orderdate")
    x = read(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.coalesce(F.sum(F.when(y == 1997, F.col("o_totalprice"))), F.lit(0.0)).alias("actual"), (F.sum(F.when(y == 1996, F.col("o_totalprice"))) * 0.3).alias("forecast"), (F.stddev_samp("o_totalprice") * 2 * F.sqrt(F.count("*"))).alias("sigma"), (F.sum(F.when(y == 1996, F.col("o_totalprice"))) * 1.3).alias("target"),
    )
    goals = x.select("o_orderpriority", "actual", "forecast", "sigma", F.lit(4).alias("remaining"), "target", F.lit("HIGHER").alias("direction"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    got = series.pace_to_goal(goals).select("o_orderpriority", "actual", "projected", "probability", "gap", "required_pace", "status")
    return _round(_round(got, "actual", "projected", "gap", "required_pace", n=2), "probability")


_TWO = "with m as (select date_trunc('month',o_orderdate)::date p, sum(o_totalprice) x, count(*)::double y from orders group by all)"


def _two(spark, d):
    return read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("p")).agg(F.sum("o_totalprice").alias("x"), F.count("*").cast("double").alias("y"))


@query(_TWO + ", l as (select *, x-lag(x) over w dx, y-lag(y) over w dy, (x-lag(x) over w)/abs(lag(x) over w) px, (y-lag(y) over w)/abs(lag(y) over w) py, rank() over (order by x)+(count(*) over (partition by x)-1)/2.0 rx, rank() over (order by y)+(count(*) over (partition by y)-1)/2.0 ry from m window w as (order by p)) select count(*) n, round(corr(x,y),6) pearson, round(corr(rx,ry),6) spearman, round(corr(dx,dy),6) pearson_diff, round(corr(px,py),6) pearson_change from l")
def cross_metric_corr(spark, d):
    return _round(series.correlations(_two(spark, d), "p", "x", "y"), "pearson", "spearman", "pearson_diff", "pearson_change")


_DAILY = "with x as (select event_type m, ts::date p, sum(value) v from events where not (event_type='error' and day(ts)=9) group by all), c as (select a.m a, b.m b from (select distinct m from x) a join (select distinct m from x) b on a.m<b.m)"


def _daily(spark, d):
    v = read(spark, d, "events").filter("not (event_type = 'error' and dayofmonth(ts) = 9)").groupBy(F.col("event_type").alias("m"), F.to_date("ts").alias("p")).agg(F.sum("value").alias("v"))
    kinds = v.select("m").distinct()
    pairs = kinds.select(F.col("m").alias("a")).join(kinds.select(F.col("m").alias("b")), F.expr("a < b")).withColumn("priority", F.lit(0.85))
    return series.pair_measures(v, pairs, "m", "p", "v", 3)


@query(
    _DAILY + ", j as (select c.a, c.b, x.p, x.v x, y.v y from c join x on x.m=c.a join x y on y.m=c.b and y.p=x.p), k as (select c.a, c.b, (select count(*) from x where m=c.a)+(select count(*) from x where m=c.b) t from c),"
    " l as (select *, x-lag(x) over w dx, y-lag(y) over w dy, (x-lag(x) over w)/lag(x) over w px, (y-lag(y) over w)/lag(y) over w py, row_number() over w i, count(*) over (partition by a, b) n from j window w as (partition by a, b order by p)),"
    " h as (select a, b, any_value(n) n, corr(x,y) pearson, corr(dx,dy) difference, corr(px,py) as change, corr(case when i-1<=floor((n-1)/2) then dx end, case when i-1<=floor((n-1)/2) then dy end) r1, corr(case when i-1>floor((n-1)/2) then dx end, case when i-1>floor((n-1)/2) then dy end) r2 from l group by a, b),"
    " g as (select u.a, u.b, s lag, corr(u.x, z.y) r from l u, range(-3,4) t(s), l z where z.a=u.a and z.b=u.b and z.i=u.i+s group by all), f as (select a, b, lag, r from g qualify row_number() over (partition by a, b order by round(abs(r),9) desc, abs(lag), lag desc)=1)"
    " select h.a, h.b, 0.85::double priority, h.n, round(h.n/(k.t-h.n),6) coverage, round(pearson,6) pearson, round(difference,6) difference, round(change,6) as change, round((1-abs(r1-r2)/2)*case when r1*r2>=0 then 1 else 0.25 end,6) stability, f.lag::int best_lag, round(f.r,6) lag_r from h join k using (a,b) join f using (a,b)"
)
def pair_measures(spark, d):
    return _round(_daily(spark, d), "coverage", "pearson", "difference", "change", "stability", "lag_r")


@query()
def pair_relations(spark, d):
    return series.pair_relations(_daily(spark, d), least=20, coverage=0.8, effect=0.05, most_q=1.0).drop("difference", "change")


@query(_TWO + ", i as (select row_number() over (order by p) i, x, y from m) select g::int lag, count(*) n, round(corr(a.x,b.y),6) r from i a, range(-6,7) t(g) join i b on b.i=a.i+g group by g")
def lagged_corr(spark, d):
    return _round(series.lagged(_two(spark, d), "p", "x", "y"), "r")


@query("with x as (select p_brand k, (count(*) % 97)/100.0 p from part group by all), r as (select k, p, p*count(*) over ()/row_number() over (order by p, k) raw from x) select k, p, round(least(1, min(raw) over (order by p desc, k desc rows unbounded preceding)),6) q from (select k, p, p*count(*) over ()/rank() over (order by p, k) raw from x)")
def benjamini_hochberg(spark, d):
    x = read(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(((F.count("*") % 97) / 100.0).alias("p0"))
    # ties of p get the same q, whatever their order
    out = series.benjamini_hochberg(x, "p0", alias="q")
    return out.select("k", F.col("p0").alias("p"), F.round("q", 6).alias("q"))


# windows
@query("select event_id, lead(event_type) over (partition by user_id order by ts, event_id) next_type from events")
def window_lead(spark, d):
    from pyspark.sql import Window

    return read(spark, d, "events").select("event_id", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_type"))


@query("select event_id, round(last_value(case when event_type='purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding),4) previous from events")
def window_previous(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, d, "events").select("event_id", F.round(F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w), 4).alias("previous"))


@query("select p_brand, p_partkey, p_retailprice, rank from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part) where rank <= 3")
def top_k_per_group(spark, d):
    return pivot.top_k(read(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "p_retailprice", F.col("rank").cast("long").alias("rank"))


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r, count(*) over (partition by p_brand) n from part) select p_brand, p_partkey, case when r=1 then 'max' when r=n then 'min' else 'middle' end kind from r where r=1 or r=n or r=(n+1)//2")
def representatives(spark, d):
    return pivot.representatives(read(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "kind")


@query("select event_type stage, count(*) as events, count(distinct user_id) units, round(count(distinct user_id)/(select count(distinct user_id) from events where event_type='view'),6) of_first from events where event_type in ('view','click','purchase') group by all")
def funnel_counts(spark, d):
    return _round(pivot.funnel(read(spark, d, "events"), "event_type", ["view", "click", "purchase"], "user_id"), "of_first")


@query("with n as (select event_type as before, lead(event_type) over (partition by user_id order by ts, event_id) as after from events) select before, after, count(*) n from n where after is not null group by all")
def transition_matrix(spark, d):
    return pivot.transitions(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("select event_id, value from events where ts::date = (select max(ts::date) from events)")
def latest_snapshot(spark, d):
    return pivot.latest(read(spark, d, "events").withColumn("day", F.to_date("ts")), "day").select("event_id", "value")


@query("with x as (select coalesce(nullif(trim(event_type),''),'missing') event_type, sum(value) total from events group by all) select event_type, round(total,2) total, round(total/sum(total) over (),6) share, row_number() over (order by total desc, event_type) as rank from x qualify rank<=3")
def breakdown_share(spark, d):
    return _round(_round(pivot.distribution(read(spark, d, "events"), "event_type", F.sum("value"), 3).withColumn("rank", F.col("rank").cast("long")), "total", n=2), "share")


@query("with x as (select p_brand, count(*)::double total from part group by all) select p_brand, total, round(total/sum(total) over (),6) share, row_number() over (order by total desc, p_brand) as rank from x qualify rank<=5")
def dim_distribution(spark, d):
    return _round(pivot.distribution(read(spark, d, "part"), "p_brand", F.count("*").cast("double")).withColumn("rank", F.col("rank").cast("long")), "share")


@query("with recursive t(n, parent, path) as (select r_regionkey+1000, null::int, r_name from region union all select n_nationkey, n_regionkey+1000, t.path||'/'||n_name from nation join t on n_regionkey+1000=t.n) select n, parent, path from t")
def org_tree_recursive(spark, d):
    from pyspark.sql.types import IntegerType

    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    rows = region.select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast(IntegerType()).alias("up"), F.col("r_name").alias("name")).unionByName(nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("up"), F.col("n_name").alias("name")))
    return spark.sql("with recursive t(n, parent, path) as (select id, up, name from {rows} where up is null union all select r.id, r.up, concat(t.path, '/', r.name) from {rows} r join t on r.up = t.n) select n, parent, path from t", rows=rows)


# metadata
_PROFILE = " union all ".join(
    f"select '{c}' column_name, '{t}' base_type, count(*) n, count(*)-count({c}) n_null, count(distinct {c}) n_distinct, min({c})::varchar min_value, max({c})::varchar max_value, {mean} mean, min(length({c}::varchar))::int min_length, max(length({c}::varchar))::int max_length, null::varchar pattern from customer"
    for c, t, mean in (("c_custkey", "NUMERIC", "round(avg(c_custkey),6)"), ("c_mktsegment", "STRING", "null::double"), ("c_name", "STRING", "null::double"), ("c_nationkey", "NUMERIC", "round(avg(c_nationkey),6)"))
)


@query(_PROFILE)
def profile_columns(spark, d):
    return _round(meta.profile(read(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"]), "mean")


@query("select p_brand as value, count(*) n from part group by all order by 2 desc, 1 limit 10")
def top_values(spark, d):
    return meta.top_values(read(spark, d, "part"), "p_brand")


@query("with x as (select count(distinct o_custkey) n, count(distinct case when o_custkey in (select c_custkey from customer) then o_custkey end) c from orders) select n n_values, c n_common, c/n share, case when c>=3 and c/n>=0.95 then 'full' when c>=3 and c/n>=0.6 then 'partial' else 'none' end verdict from x")
def inclusion_dependency(spark, d):
    return meta.inclusion(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer"), "c_custkey")


_SHARES = " union all ".join(f"select '{t}' table_name, '{c}' column_name, '{to}' to_table, '{k}' to_column, count(distinct case when {c} in (select {k} from {to}) then {c} end) / count(distinct {c}) share from {t}" for t, c, to, k in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey")))


@query(f"with x as ({_SHARES}), y as (select *, case when share>=0.99 then 0.95 when share>=0.9 then 0.85 when share>=0.7 then 0.7 when share>=0.5 then 0.6 end::double confidence from x) select * from y where confidence is not null")
def fk_discovery(spark, d):
    t = {n: read(spark, d, n) for n in ("orders", "lineitem", "customer", "nation")}
    return meta.foreign_keys(t, {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey"})


@query("select 'lineitem.l_partkey' as reference, l_partkey as value, count(*) n from lineitem where l_partkey not in (select p_partkey from part) group by all union all select 'events.user_id', user_id, count(*) from events where user_id not in (select c_custkey from customer) group by all union all select 'customer.c_custkey', c_custkey, count(*) from customer where c_custkey not in (select s_suppkey from supplier) group by all")
def fk_orphans(spark, d):
    t = {n: read(spark, d, n) for n in ("lineitem", "part", "events", "customer", "supplier")}
    out = None
    for child, column, parent, key in (("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"), ("customer", "c_custkey", "supplier", "s_suppkey")):
        one = meta.orphans(t[child], column, t[parent], key).select(F.lit(f"{child}.{column}").alias("reference"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("with a as (select distinct l_linestatus v from lineitem), b as (select distinct o_orderstatus v from orders) select (select count(*) from a) n_a, (select count(*) from b) n_b, (select count(*) from a join b using(v))::bigint n_common, 0.8::double confidence")
def shared_enum(spark, d):
    return _round(meta.shared_enum(read(spark, d, "lineitem"), "l_linestatus", read(spark, d, "orders"), "o_orderstatus"), "confidence")


@query("select 'orders' table_name, count(*) n, 'o_custkey' as column_name, count(distinct o_custkey) n_distinct from orders union all select 'orders', count(*), 'o_orderstatus', count(distinct o_orderstatus) from orders union all select 'part', count(*), 'p_brand', count(distinct p_brand) from part")
def table_histogram(spark, d):
    t = {n: read(spark, d, n) for n in ("orders", "part")}
    got = meta.table_histogram(t, {"orders": ["o_custkey", "o_orderstatus"], "part": ["p_brand"]})
    return got.select("table_name", "n", F.explode("distinct_counts").alias("column_name", "n_distinct"))


@query("select * from (values ('lineitem','fact'),('orders','fact'),('customer','dimension'),('nation','lookup'),('region','lookup')) t(table_name, kind)")
def table_classification(spark, d):
    t = {n: read(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    kinds = meta.classify(t, [(j.table, j.to) for j in CATALOG.joins], {n: df.count() for n, df in t.items()})
    return spark.createDataFrame(sorted(kinds.items()), "table_name string, kind string")


@query("select * from (values (1,'lineitem','orders'),(2,'orders','customer'),(3,'customer','nation')) t(hop, from_table, to_table)")
def join_path(spark, d):
    (path, _), *_ = CATALOG.paths("lineitem", "nation")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(path, 1)], "hop int, from_table string, to_table string")


@query("select * from (values ('customer',1),('orders',2),('lineitem',3)) t(table_name, distance)")
def impact_analysis(spark, d):
    return spark.createDataFrame(CATALOG.impact("nation"), "table_name string, distance int")


@query("select * from (values ('order_day'),('order_month'),('order_quarter'),('order_week'),('order_year'),('nation'),('nation_name'),('orderkey'),('orderstatus'),('priority'),('region'),('segment')) t(dimension)")
def compatible_dimensions(spark, d):
    return spark.createDataFrame([(x,) for x in CATALOG.compatible_dimensions("order_value")], "dimension string")


@query("select * from (values (1,'order_week'),(2,'order_day')) t(place, dimension)")
def drill_dimensions(spark, d):
    return spark.createDataFrame(list(enumerate(CATALOG.drill_dimensions("order_value", ("order_month",))[:2], 1)), "place int, dimension string")


# text
@query("with q as (select vec_id i, embedding e from embeddings where vec_id % 100 = 0), p as (select q.i query_id, v.vec_id, list_cosine_similarity(q.e::double[], v.embedding::double[]) similarity from q, embeddings v where v.vec_id <> q.i) select query_id, vec_id, round(similarity,6) similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from p qualify rank <= 3")
def cosine_top_k(spark, d):
    v = read(spark, d, "embeddings")
    return _round(text.cosine_top_k(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", 3).withColumn("rank", F.col("rank").cast("long")), "similarity")


@query("with t as (select distinct o_orderpriority term from orders), n as (select distinct replace(o_orderpriority,'-',' ') as name from orders) select term, name, levenshtein(lower(term),lower(name))::int distance from t, n where levenshtein(lower(term),lower(name))<=2")
def fuzzy_match(spark, d):
    o = read(spark, d, "orders")
    return text.fuzzy_match(o.select("o_orderpriority"), "o_orderpriority", o.select(F.regexp_replace("o_orderpriority", "-", " ").alias("name")).distinct(), "name")


@query("with h as (select conv_id, bool_or(regexp_matches(\"text\",'[?]')) a, bool_or(regexp_matches(lower(\"text\"),'the ')) b, bool_or(length(\"text\")>100 and regexp_matches(\"text\",'^.')) c from conversations group by all) select conv_id, round((2*a::int+1*b::int)/3.0,6)::double score, a::int+b::int hits, case when (2*a::int+b::int)/3.0>=0.9 then 'A' when (2*a::int+b::int)/3.0>=0.75 then 'B' when (2*a::int+b::int)/3.0>=0.6 then 'C' else 'D' end grade from h")
def sop_scoring(spark, d):
    return _round(text.rule_score(read(spark, d, "conversations"), ["conv_id"], "text", [("question", "[?]", 2.0), ("article", "(?i)the ", 1.0)]), "score")


#: Questions and, as SQL over t (today), the days they ask for.
_TIMES = {
    "最近7天的销售额": ("t - 6", "t", "t - 13", "t - 7", "day"),
    "近两周": ("t - 13", "t", "t - 27", "t - 14", "week"),
    "上周": ("date_trunc('week', t) - interval 7 day", "date_trunc('week', t) - interval 1 day", "date_trunc('week', t) - interval 14 day", "date_trunc('week', t) - interval 8 day", "week"),
    "过去三个月": ("date_trunc('month', t) - interval 2 month", "last_day(t)", "date_trunc('month', t) - interval 5 month", "last_day(t - interval 3 month)", "month"),
    "上季度": ("date_trunc('quarter', t) - interval 3 month", "date_trunc('quarter', t) - interval 1 day", "date_trunc('quarter', t) - interval 6 month", "date_trunc('quarter', t) - interval 3 month - interval 1 day", "month"),
    "去年上半年": ("date_trunc('year', t) - interval 12 month", "date_trunc('year', t) - interval 6 month - interval 1 day", "date_trunc('year', t) - interval 18 month", "date_trunc('year', t) - interval 12 month - interval 1 day", "month"),
    "本月同比": ("date_trunc('month', t)", "last_day(t)", "date_trunc('month', t) - interval 1 year", "last_day(t - interval 1 year)", "month"),
    "2026-02-02至2026-02-15按周": ("date '2026-02-02'", "date '2026-02-15'", "date '2026-02-02' - 14", "date '2026-02-02' - 1", "week"),
    "2026年2月30日": ("null", "null", "null", "null", None),
}


@query("with d as (select date '2026-07-23' t) " + " union all ".join(f"select '{q}' question, {', '.join(f'({x})::date::varchar {n}' for x, n in zip(v[:4], ('first_day', 'last_day', 'previous_first', 'previous_last'), strict=True))}, {f'{chr(39)}{v[4]}{chr(39)}' if v[4] else 'null::varchar'} grain from d" for q, v in _TIMES.items()))
def parse_time(spark, d):
    read = {q: text.parse_time(q, "2026-07-23") for q in _TIMES}
    rows = [(q, *((g["start"], g["end"], g["previous_start"], g["previous_end"], g["grain"]) if g else (None,) * 5)) for q, g in read.items()]
    return spark.createDataFrame(rows, "question string, first_day string, last_day string, previous_first string, previous_last string, grain string")


@query("with g as (select p_brand, count(*) n, avg(p_retailprice) a from part group by all) select p_brand, n, round(a,4) price, case when a < 1400 then 'low' when a < 1500 then 'mid' else 'high' end band, concat_ws('-', p_brand, n) label from g")
def hr_profile_bands(spark, d):
    g = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))
    return g.select("p_brand", "n", F.round("price", 4).alias("price"), F.when(F.col("price") < 1400, "low").when(F.col("price") < 1500, "mid").otherwise("high").alias("band"), F.concat_ws("-", "p_brand", F.col("n").cast("string")).alias("label"))


@query("select count(*) n from region", "source_parquet")
def source_parquet(spark, d):
    from ..sources.readers import Sources

    return Sources(spark, {n: f"{d}/{n}.parquet" for n in NAMES}).read("region").agg(F.count("*").alias("n"))
