"""Further queries: drill-downs, all-dimension attribution, tests, peers, retrieval, transcripts, detail behind a pivot cell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timegrain
from ..operators import attribution, meta, series, stats, text
from ..semantic import And, Filter, QuerySpec
from .registry import query
from .tables import CATALOG, engine, read


def _round(df, *columns, n=6):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), n))
    return df


def _orders(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("y", F.year("o_orderdate"))


@query("with c as (select c_nationkey member, o_orderpriority child, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) as current, coalesce(sum(case when year(o_orderdate)=1996 then o_totalprice end),0) base from orders left join customer on o_custkey=c_custkey group by all), b as (select member, row_number() over (order by abs(sum(current-base)) desc, member) member_rank from c group by member qualify member_rank<=5), r as (select c.*, member_rank, row_number() over (partition by member order by abs(current-base) desc, child) as rank from c join b using(member)) select member, member_rank, child, round(current,2) as current, round(base,2) base, round(current-base,2) delta, rank from r where rank<=5")
def drill_down(spark, d):
    y = F.col("y")
    got = attribution.drill_down(_orders(spark, d), "c_nationkey", "o_orderpriority", F.col("o_totalprice"), y == 1997, y == 1996)
    return _round(got.withColumn("rank", F.col("rank").cast("long")).withColumn("member_rank", F.col("member_rank").cast("long")), "current", "base", "delta", n=2)


_FLOORS = "with r as (select c_mktsegment, o_orderpriority, grouping(c_mktsegment) ga, grouping(o_orderpriority) gb, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) as current, coalesce(sum(case when year(o_orderdate)=1996 then o_totalprice end),0) base from orders left join customer on o_custkey=c_custkey group by rollup(c_mktsegment, o_orderpriority))"
_FLOORS += ", a as (select x.*, (x.current-x.base)/p.base contribution, x.current/p.current proportion, row_number() over (order by abs(x.current-x.base) desc, x.c_mktsegment) as rank from r x, r p where x.ga=0 and x.gb=1 and p.ga=1 and p.gb=1)"
_FLOORS += ", b as (select x.*, (x.current-x.base)/p.base contribution, x.current/p.current proportion, row_number() over (partition by x.c_mktsegment order by abs(x.current-x.base) desc, x.o_orderpriority) as rank, p.rank above from r x join a p on p.c_mktsegment=x.c_mktsegment where x.ga=0 and x.gb=0)"


@query(_FLOORS + " select 1::int as level, c_mktsegment, o_orderpriority, round(current,2) as current, round(base,2) base, round(current-base,2) delta, round(contribution,6) contribution, round(proportion,6) proportion, rank from a union all select 2, c_mktsegment, o_orderpriority, round(current,2), round(base,2), round(current-base,2), round(contribution,6), round(proportion,6), rank from b where above<=3")
def dismantling_floors(spark, d):
    y = F.col("y")
    got = attribution.dismantling_tree(_orders(spark, d), ["c_mktsegment", "o_orderpriority"], F.col("o_totalprice"), y == 1997, y == 1996, top=3)
    return _round(_round(got.withColumn("rank", F.col("rank").cast("long")), "current", "base", "delta", n=2), "contribution", "proportion")


_DIMS = " union all ".join(f"select '{c}' dimension, {c}::varchar member, coalesce(sum(case when year(o_orderdate)=1997 then o_totalprice end),0) as current, coalesce(sum(case when year(o_orderdate)=1996 then o_totalprice end),0) base from orders left join customer on o_custkey=c_custkey group by all" for c in ("c_mktsegment", "o_orderpriority", "o_orderstatus"))


@query(f"with m as ({_DIMS}) select dimension, member, round(current,2) as current, round(base,2) base, round((current-base)/sum(base) over (partition by dimension),6) contribution from m")
def attribution_dimensions(spark, d):
    y = F.col("y")
    got = attribution.over_dimensions(_orders(spark, d), ["c_mktsegment", "o_orderpriority", "o_orderstatus"], F.col("o_totalprice"), y == 1997, y == 1996)
    return _round(_round(got, "current", "base", n=2), "contribution")


@query("with t as (select sum(case when year(o_orderdate)=1997 then o_totalprice end) a, sum(case when year(o_orderdate)=1996 then o_totalprice end) b, count(case when year(o_orderdate)=1997 then 1 end)::double c, count(case when year(o_orderdate)=1996 then 1 end)::double e from orders) select 'order_value' operand, round(a-b,2) delta, round((a-b)/b*100,4) as percent from t union all select 'order_count', round(c-e,2), round((c-e)/e*100,4) from t")
def operand_fluctuation(spark, d):
    e = engine(spark, d)
    side = [e.query(QuerySpec(("order_value", "order_count"), (), Filter("order_year", "equals", (f"{y}-01-01",)))).first().asDict() for y in (1997, 1996)]
    got = attribution.operand_changes(*[{k: float(v) for k, v in s.items()} for s in side])
    return _round(_round(spark.createDataFrame(got, "operand string, delta double, percent double"), "delta", n=2), "percent", n=4)


@query("select * from (values ('a',2.0::double),('b',-0.5::double)) t(operand, coefficient)")
def linear_coefficients(spark, d):
    got = attribution.linear_coefficients("2 * {a} - {b} / 2 + 3")
    return spark.createDataFrame(sorted(got.items()), "operand string, coefficient double")


@query("select p_brand, count(*) n, round(avg(p_retailprice),4) mean, round((avg(p_retailprice)-(select avg(p_retailprice) from part))/(select avg(p_retailprice) from part)*100,6) lift_percent from part group by all")
def group_lift(spark, d):
    return _round(_round(stats.group_lift(read(spark, d, "part"), "p_brand", "p_retailprice"), "mean", n=4), "lift_percent")


@query("with s as (select s_suppkey k, s_acctbal v from supplier), o as (select v from s where k=7) select 's_acctbal' column_name, round((select v from o),4) own, round(avg(v),4) peer_mean, round(stddev_samp(v),4) peer_std, round(((select v from o)-avg(v))/stddev_samp(v),6) z, round(avg((v<=(select v from o))::int),6) percentile from s where k<>7")
def peer_comparison(spark, d):
    return _round(_round(stats.peers(read(spark, d, "supplier"), "s_suppkey", 7, ["s_acctbal"]), "own", "peer_mean", "peer_std", n=4), "z", "percentile")


_TWO = "with m as (select date_trunc('month',o_orderdate)::date p, sum(o_totalprice) x, count(*)::double y from orders group by all)"


def _two(spark, d):
    return read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("p")).agg(F.sum("o_totalprice").alias("x"), F.count("*").cast("double").alias("y"))


@query(_TWO + ", s as (select avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy from m) select p, round(x,2) x, y, round((x-mx)/sx,6) zx, round((y-my)/sy,6) zy from m, s where abs((x-mx)/sx)>=3 and abs((y-my)/sy)>=3")
def joint_anomalies(spark, d):
    return _round(_round(series.joint_anomalies(_two(spark, d), "p", "x", "y"), "x", n=2), "zx", "zy")


@query(_TWO + ", h as (select x, y, ntile(2) over (order by p) h from m), c as (select corr(case when h=1 then x end, case when h=1 then y end) r1, corr(case when h=2 then x end, case when h=2 then y end) r2 from h) select round(r1,6) r1, round(r2,6) r2, sign(r1)=sign(r2) and abs(r1-r2)<=0.3 stable from c")
def correlation_stability(spark, d):
    return _round(series.stability(_two(spark, d), "p", "x", "y"), "r1", "r2")


@query()
def metric_candidates(spark, d):
    return spark.createDataFrame(series.metric_candidates(CATALOG), "a string, b string, priority double, why string")


_GRAMS = "list_concat(list_concat(list_transform(range(1, greatest(length({t})-0, 1)), lambda i: substr({t}, i, 2)), list_transform(range(1, greatest(length({t})-1, 1)), lambda i: substr({t}, i, 3))), list_concat(list_transform(range(1, greatest(length({t})-2, 1)), lambda i: substr({t}, i, 4)), list_transform(regexp_extract_all({t}, '[^\\s_]+'), lambda w: '#' || w)))"
_WEIGHTS = "select {k} k, ('0x'||substr(md5(g),1,15))::bigint%1024 slot, sum(case when ('0x'||substr(md5(g),16,1))::int<8 then 1.0 else -1.0 end) w from (select {k}, unnest({g}) g from {f}) group by all"
_NAMES = [m.name for m in CATALOG.measures]
_ASKED = ["revenues", "order counts", "zzz", "average line value"]


@query(
    f"with n as (select unnest({_NAMES!r}) name_), q as (select unnest({_ASKED!r}) query_), nw as ({_WEIGHTS.format(k='name_', g=_GRAMS.format(t='lower(name_)'), f='n')}), qw as ({_WEIGHTS.format(k='query_', g=_GRAMS.format(t='lower(query_)'), f='q')}),"
    " nn as (select k, sqrt(sum(w*w)) l from nw group by k), qn as (select k, sqrt(sum(w*w)) l from qw group by k),"
    " s as (select qw.k as query, nw.k as name, sum(qw.w*nw.w)/any_value(qn.l)/any_value(nn.l) score from qw join nw using(slot) join qn on qn.k=qw.k join nn on nn.k=nw.k group by all)"
    " select query, name, round(score,6) score, row_number() over (partition by query order by score desc, name)::int as rank from s where score>=0.45 qualify rank<=2"
)
def retrieve_names(spark, d):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return _round(text.retrieve(spark.createDataFrame([(q,) for q in _ASKED], "query string"), names, 2), "score")


@query("with c as (select conv_id, turn, role, length(coalesce(\"text\",'')) n, case when lag(role) over w is not distinct from role and lag(turn) over w is not null then 0 else 1 end c from conversations window w as (partition by conv_id order by turn)), s as (select *, sum(c) over (partition by conv_id order by turn rows unbounded preceding) segment from c) select conv_id, segment::bigint segment, role, count(*) turns, sum(n)::bigint chars, round(sum(n)*60.0/240,1)::double as seconds from s group by all")
def call_segments(spark, d):
    return text.segments(read(spark, d, "conversations"), ["conv_id"], "turn", "role", "text").withColumn("segment", F.col("segment").cast("long"))


@query("select o_orderkey, floor(date_diff('day', o_orderdate::date, date '2002-01-01')/365.25)::bigint as years, floor(mm)::bigint as months from (select *, (year(date '2002-01-01')-year(o_orderdate))*12 + 1-month(o_orderdate) - case when day(o_orderdate)>1 then 1 else 0 end mm from orders)")
def tenure(spark, d):
    end = F.to_date(F.lit("2002-01-01"))
    start = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.floor(F.datediff(end, start) / 365.25).alias("years"), F.floor(F.months_between(end, start)).alias("months"))


@query("select o.* from orders o join customer on o_custkey=c_custkey where c_mktsegment='BUILDING' and o_orderdate::date between date '1996-04-01' and date '1996-06-30'")
def pivot_drill(spark, d):
    return engine(spark, d).detail("order_value", And((Filter("segment", "equals", ("BUILDING",)), Filter("order_day", "between", timegrain.key_range("1996Q2")))))


@query("with t as (select o_orderpriority, o_orderkey, o_totalprice, o_orderdate from orders), r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank from t) select o_orderpriority, o_orderkey, rank from r where rank<=2")
def order_within_group(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2").select("o_orderpriority", "o_orderkey", "rank")


@query("select n_nationkey, n_name from nation union all select r_regionkey + 1000, r_name from region", "union_all")
def union_all(spark, d):
    return read(spark, d, "nation").select("n_nationkey", "n_name").unionByName(read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name")))


_TREE = "with t as (select sum(case when year(o_orderdate)=1997 then o_totalprice end) a1, sum(case when year(o_orderdate)=1996 then o_totalprice end) a0, count(case when year(o_orderdate)=1997 then 1 end)::double b1, count(case when year(o_orderdate)=1996 then 1 end)::double b0 from orders)"


@query(_TREE + " select '0' as path, '/' as name, round(a1/b1-a0/b0,4) delta, null::double contribution from t union all select '0.0', 'order_value', round(a1-a0,4), round(a1/b0-a0/b0,4) from t union all select '0.1', 'order_count', b1-b0, round(a1/b1-a1/b0,4) from t")
def decision_tree(spark, d):
    from ..operators.trees import decision_tree as tree

    e = engine(spark, d)
    side = [e.query(QuerySpec(("order_value", "order_count"), (), Filter("order_year", "equals", (f"{y}-01-01",)))).first().asDict() for y in (1997, 1996)]
    nodes = tree("[order_value] / [order_count]", *[{k: float(v) for k, v in s.items()} for s in side])
    return _round(spark.createDataFrame([(n["path"], n["name"], n["delta"], n["contribution"]) for n in nodes], "path string, name string, delta double, contribution double"), "delta", "contribution", n=4)


@query("select o_orderpriority priority, count(*) order_count from orders where o_orderdate::date between date '1996-01-01' and date '1996-03-31' group by all order by 2 desc, 1 limit 3")
def question(spark, d):
    from ..semantic.question import read_question

    got = read_question("1996年第1季度 top 3 order count by priority", CATALOG, "2026-07-24", date="order_day")
    return engine(spark, d).query(got.spec)


@query("select o_orderpriority priority, date_trunc('quarter', o_orderdate)::date order_quarter, count(*) order_count from orders where o_orderdate::date between date '1996-01-01' and date '1996-12-31' and o_orderstatus in ('F','O') group by all order by 1, 2 limit 12")
def semantic_load(spark, d):
    from ..semantic.guard import spec_of

    payload = {"measures": ["order_count"], "dimensions": ["priority"], "timeDimensions": [{"dimension": "order_day", "granularity": "quarter", "dateRange": ["1996-01-01", "1996-12-31"]}], "filters": [{"member": "orderstatus", "operator": "equals", "values": ["F", "O"]}], "order": {"priority": "asc", "order_quarter": "asc"}, "limit": 12}
    return engine(spark, d).query(spec_of(payload, CATALOG))


_RISK = "with x as (select o_orderpriority, o_orderstatus, sum(case when year(o_orderdate)=1997 then o_totalprice end) a, sum(case when year(o_orderdate)=1996 then o_totalprice end) t from orders group by all)"


@query(_RISK + " select o_orderpriority, count(case when a < t then 1 end) risky from x group by all having count(case when a < t then 1 end)>=2")
def joint_goal_risk(spark, d):
    y = F.year("o_orderdate")
    x = read(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum(F.when(y == 1997, F.col("o_totalprice"))).alias("a"), F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("t"))
    status = F.when(F.col("a") < 0.9 * F.col("t"), "OFF_TRACK").when(F.col("a") < F.col("t"), "AT_RISK").otherwise("ON_TRACK")
    return series.joint_goal_risk(x.withColumn("status", status), ["o_orderpriority"])


@query(f"with p as (select p_partkey k_, lower(p_name) t from part), w as ({_WEIGHTS.format(k='k_', g=_GRAMS.format(t='t'), f='p')}), n as (select k, sqrt(sum(w*w)) l from w group by k) select k p_partkey, slot, round(w/nullif(l,0),6) weight from w join n using (k)")
def gram_vectors(spark, d):
    return _round(text.gram_vectors(read(spark, d, "part"), "p_partkey", "p_name"), "weight")


_COLUMNS = {"customer": ("c_custkey", "c_nationkey", "c_acctbal"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal")}


def _profiles(t: str) -> str:
    return " union all ".join(f"select '{c}' c, count(*) n, count(*)-count({c}) z, count(distinct {c}) d from {t}" for c in _COLUMNS[t])


@query(f"with a as ({_profiles('customer')}), b as ({_profiles('supplier')}), s as (select a.c a, b.c b, 'NUMERIC' base_type, 0.6*least(a.d,b.d)/greatest(a.d,b.d)+0.4*(1-abs(a.z/a.n-b.z/b.n)) score from a, b) select a, b, base_type, round(score,6) score from s where score>=0.45")
def profile_similarity(spark, d):
    a, b = (meta.profile(read(spark, d, t), list(c)) for t, c in _COLUMNS.items())
    return _round(meta.profile_similarity(a, b, 0.45), "score")


_TOKENS = {
    "T-D-3": "t - 3", "T-W-0": "date_trunc('week', t)", "T-W-2E": "date_trunc('week', t) - interval 8 day", "T-M-1": "date_trunc('month', t) - interval 1 month", "T-M-0E": "last_day(t)",
    "T-Q-1": "date_trunc('quarter', t) - interval 3 month", "T-Q-0E": "date_trunc('quarter', t) + interval 3 month - interval 1 day", "T-Y-2": "date_trunc('year', t) - interval 2 year", "T-Y-0E": "date_trunc('year', t) + interval 1 year - interval 1 day",
}


@query("with o as (select distinct o_orderdate::date t from orders) " + " union all ".join(f"select t as day, '{k}' token, ({v})::date::varchar resolved from o" for k, v in _TOKENS.items()))
def relative_tokens(spark, d):
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = None
    for token in _TOKENS:
        one = days.select("day", F.lit(token).alias("token"), timegrain.token_day(token, F.col("day")).cast("string").alias("resolved"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select 'missing' change, 'o_clerk' as column_name union all select 'added', 'o_orderpriority' union all select 'type', 'o_totalprice'")
def schema_difference(spark, d):
    declared = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(12,2)", "o_orderdate": dict(read(spark, d, "orders").dtypes)["o_orderdate"], "o_clerk": "string"}
    return spark.createDataFrame([(kind, c) for c, kind in meta.schema_difference(declared, read(spark, d, "orders"))], "change string, column_name string")


@query("with x as (select l_returnflag g, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice) r, count(*) over (partition by l_returnflag) n from lineitem), p as (select unnest([0.5,0.9,0.95,0.99])::double q) select g l_returnflag, q, min(v) as value from x, p where r >= ceil(q*n) group by all")
def agg_percentile_ranked(spark, d):
    from ..operators.ranking import grouped_percentiles

    return grouped_percentiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.95, 0.99])
