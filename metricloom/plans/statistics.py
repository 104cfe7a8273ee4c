"""Queries of the statistical operators. Tail probabilities in SQL are closed forms, or the normal tail by the same polynomial."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .analytics import _SERIES, _events
from .registry import query
from .tables import read


def _round(df, *columns, n=6):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), n))
    return df


def _tail(x: str) -> str:
    """Two-sided normal tail of x in SQL."""
    t = f"(1/(1+0.5*abs({x})/sqrt(2)))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({c}+{t}*{poly})"
    return f"({t}*exp(-({x})*({x})/2+{poly}))"


def _student(t: str, df: str) -> str:
    """Two-sided tail of Student's t with many degrees of freedom: the normal tail of a transform of t."""
    return _tail(f"(({t})*(1-1/(4.0*({df})))/sqrt(1+({t})*({t})/(2.0*({df}))))")


def _row(spark, values: dict[str, float | int | None], kinds: dict[str, str]):
    return spark.createDataFrame([tuple(values[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))


@query(
    "with d as (select event_type, value v, value-avg(value) over (partition by event_type) c from events), k as (select event_type, v, count(*) n from d group by all), m as (select event_type, v from k qualify row_number() over (partition by event_type order by n desc, v)=1)"
    " select d.event_type, count(d.v) n, round(avg(d.v),6) mean, round(stddev_samp(d.v),6) std, min(d.v) \"min\", round(quantile_cont(d.v,0.25),6) q1, round(median(d.v),6) median, round(quantile_cont(d.v,0.75),6) q3, max(d.v) \"max\", round(avg(c*c*c)/power(avg(c*c),1.5),6) skewness, round(avg(c*c*c*c)/power(avg(c*c),2)-3,6) kurtosis, any_value(m.v) as \"mode\" from d join m using (event_type) group by all"
)
def stats_descriptive(spark, d):
    return _round(stats.descriptive(read(spark, d, "events"), "value", ["event_type"]), "mean", "std", "q1", "median", "q3", "skewness", "kurtosis")


_PAIRS = " union all ".join(f"select '{a}' a, '{b}' b, count(*) n, corr({a},{b}) r from lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))


@query(f"with c as ({_PAIRS}) select a, b, n, round(r,6) r, round({_student('r*sqrt((n-2)/(1-r*r))', 'n-2')},4) p from c")
def stats_correlation(spark, d):
    return _round(_round(stats.correlation_matrix(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r"), "p", n=4)


@query(f"with x as (select rank() over (order by p_size)+(count(*) over (partition by p_size)-1)/2.0 a, rank() over (order by p_retailprice)+(count(*) over (partition by p_retailprice)-1)/2.0 b from part), c as (select count(*) n, corr(a,b) r from x) select 'p_size' a, 'p_retailprice' b, n, round(r,6) r, round({_student('r*sqrt((n-2)/(1-r*r))', 'n-2')},4) p from c")
def stats_spearman(spark, d):
    return _round(_round(stats.correlation_matrix(read(spark, d, "part"), ["p_size", "p_retailprice"], "spearman"), "r"), "p", n=4)


_TWO = (
    "with m as (select count(*) n, avg(l_extendedprice) my, avg(l_quantity) m1, avg(l_discount) m2, var_samp(l_extendedprice) vy, var_samp(l_quantity) v1, var_samp(l_discount) v2, covar_samp(l_extendedprice,l_quantity) c1, covar_samp(l_extendedprice,l_discount) c2, covar_samp(l_quantity,l_discount) c12 from lineitem),"
    " b as (select *, v1*v2-c12*c12 det, (c1*v2-c2*c12)/(v1*v2-c12*c12) b1, (c2*v1-c1*c12)/(v1*v2-c12*c12) b2 from m), s as (select *, (vy-b1*c1-b2*c2)*(n-1) sse, (b1*c1+b2*c2)/vy r2 from b),"
    " e as (select *, sqrt(sse/(n-3)/(n-1)*v2/det) e1, sqrt(sse/(n-3)/(n-1)*v1/det) e2 from s)"
)


@query(_TWO + f" select n, 'l_quantity' predictor, round(b1,4) coefficient, round(b1/e1,4) t, round({_student('b1/e1', 'n-3')},4) p, round(v1*v2/det,6) vif, round(my-b1*m1-b2*m2,4) as intercept, round(r2,6) r2, round(1-(1-r2)*(n-1)/(n-3),6) adjusted_r2 from e union all select n, 'l_discount', round(b2,4), round(b2/e2,4), round({_student('b2/e2', 'n-3')},4), round(v1*v2/det,6), round(my-b1*m1-b2*m2,4), round(r2,6), round(1-(1-r2)*(n-1)/(n-3),6) from e")
def stats_regression(spark, d):
    g = stats.ols(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    rows = [(g["n"], x, g["coefficients"][x], g["t"][x], g["p"][x], g["vif"][x], g["intercept"], g["r2"], g["adjusted_r2"]) for x in ("l_quantity", "l_discount")]
    got = spark.createDataFrame(rows, "n long, predictor string, coefficient double, t double, p double, vif double, intercept double, r2 double, adjusted_r2 double")
    return _round(_round(got, "coefficient", "t", "p", "intercept", n=4), "vif", "r2", "adjusted_r2")


@query(_TWO + " select 1::int step, 'l_quantity' added, round(c1*c1/(v1*vy),6) r2, round(c1*c1/(v1*vy),6) gain from e union all select 2, 'l_discount', round(r2,6), round(r2-c1*c1/(v1*vy),6) from e")
def stats_hierarchical(spark, d):
    got = stats.hierarchical(read(spark, d, "lineitem"), "l_extendedprice", [["l_quantity"], ["l_discount"]])
    return _round(spark.createDataFrame([(i, g["predictors"][-1], g["r2"], g["gain"]) for i, g in enumerate(got, 1)], "step int, added string, r2 double, gain double"), "r2", "gain")


@query()
def stats_stepwise(spark, d):
    chosen = stats.stepwise(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place int, predictor string")


_GROUPS = "with g as (select {g} g, count({v}) n, avg({v}) m, var_samp({v}) v from {f} group by all), t as (select count(*) k, sum(n) n, sum(n*m)/sum(n) grand, sum((n-1)*v) w from g), b as (select sum(g.n*(m-grand)**2) b from g, t), f as (select k, n, b, w, (b/(k-1))/(w/(n-k)) f from t, b)"
#: Tail of F with four and n - k degrees of freedom, for five groups.
_F4 = "case when k=5 then power((n-k)/((n-k)+4*f), (n-k)/2.0)*(1+(n-k)/2.0*(4*f)/((n-k)+4*f)) end"


@query(_GROUPS.format(g="event_type", v="value", f="events") + f" select k as \"groups\", n::bigint n, round(b,2) ss_between, round(w,2) ss_within, round(f,6) f, round({_F4},6) p, round(b/(b+w),6) eta2 from f")
def stats_anova(spark, d):
    return _round(_round(stats.anova(read(spark, d, "events"), "value", "event_type"), "ss_between", "ss_within", n=2), "f", "p", "eta2")


@query("with x as (select event_type, abs(value-avg(value) over (partition by event_type)) z from events), " + _GROUPS.format(g="event_type", v="z", f="x")[5:] + f" select k as \"groups\", n::bigint n, round(f,6) f, round({_F4},6) p from f")
def stats_levene(spark, d):
    return _round(stats.levene(read(spark, d, "events"), "value", "event_type").select("groups", "n", "f", "p"), "f", "p")


@query()
def stats_anova_two_way(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.anova_two_way(o, "o_totalprice", "c_mktsegment", "o_orderstatus")


@query()
def stats_tukey(spark, d):
    return stats.tukey(read(spark, d, "events"), "value", "event_type")


@query(
    "with s as (select count(case when event_type='click' then value end) n1, count(case when event_type='view' then value end) n2, avg(case when event_type='click' then value end) m1, avg(case when event_type='view' then value end) m2, var_samp(case when event_type='click' then value end) v1, var_samp(case when event_type='view' then value end) v2 from events),"
    f" t as (select *, (m1-m2)/sqrt(v1/n1+v2/n2) t, (v1/n1+v2/n2)**2/((v1/n1)**2/(n1-1)+(v2/n2)**2/(n2-1)) df from s) select n1, n2, round(m1,6) mean1, round(m2,6) mean2, round(v1,6) var1, round(v2,6) var2, round(t,6) t, round(df,4) df, round({_student('t', 'df')},4) p, round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)),6) cohen_d from t"
)
def stats_ttest(spark, d):
    return _round(_round(stats.t_test(read(spark, d, "events"), "value", "event_type", "click", "view"), "mean1", "mean2", "var1", "var2", "t", "cohen_d"), "df", "p", n=4)


@query(f"with s as (select count(value) n, avg(value) m, stddev_samp(value) s from events), t as (select *, (m-49.5)/(s/sqrt(n)) t from s) select n, round(m,6) mean, round(s,6) std, round(t,6) t, round({_student('t', 'n-1')},4) p from t")
def stats_ttest_one(spark, d):
    return _round(_round(stats.t_test_one(read(spark, d, "events"), "value", 49.5).select("n", "mean", "std", "t", "p"), "mean", "std", "t"), "p", n=4)


@query(f"with s as (select count(*) n, avg(l_discount-l_tax) m, stddev_samp(l_discount-l_tax) s from lineitem), t as (select *, m/(s/sqrt(n)) t from s) select n, round(m,6) mean, round(s,6) std, round(t,4) t, round({_student('t', 'n-1')},4) p from t")
def stats_ttest_paired(spark, d):
    return _round(_round(stats.t_test_paired(read(spark, d, "lineitem"), "l_discount", "l_tax").select("n", "mean", "std", "t", "p"), "mean", "std"), "t", "p", n=4)


_RANKS = "with c as (select value v, count(*) c from events {w} group by all), r as (select v, c, sum(c) over (order by v rows unbounded preceding) - (c-1)/2.0 k from c), g as (select event_type g, count(*) n, sum(k)::double s from events join r on value=v {w} group by all)"


@query(_RANKS.format(w="") + " select g as event_type, n, s rank_sum from g")
def stats_rank_sums(spark, d):
    return stats.rank_sums(read(spark, d, "events"), "value", "event_type")


@query(_RANKS.format(w="") + ", t as (select sum(c::double*c*c-c) t, sum(c)::double n from c), h as (select count(*) k, any_value(t.n) n, (12/(any_value(t.n)*(any_value(t.n)+1))*sum(s*s/g.n)-3*(any_value(t.n)+1))/(1-any_value(t)/(any_value(t.n)**3-any_value(t.n))) h from g, t) select k as \"groups\", n::bigint n, round(h,6) h, round(case when k=5 then exp(-h/2)*(1+h/2) end,6) p from h")
def stats_kruskal(spark, d):
    return _round(stats.kruskal(read(spark, d, "events"), "value", "event_type"), "h", "p")


@query(_RANKS.format(w="where event_type in ('click','view')") + f", u as (select max(case when g='click' then n end) n1, max(case when g='view' then n end) n2, max(case when g='click' then s end) s from g), z as (select n1, n2, s-n1*(n1+1)/2.0 u, (s-n1*(n1+1)/2.0-n1*n2/2.0)/sqrt(n1*n2*(n1+n2+1)/12.0) z from u) select n1, n2, u, round(z,6) z, round({_tail('z')},4) p from z")
def stats_mann_whitney(spark, d):
    return _round(_round(stats.mann_whitney(read(spark, d, "events"), "value", "event_type", "click", "view"), "z"), "p", n=4)


@query(
    "with m as (select count(value) n, avg(value) m, stddev_samp(value) s from events), c as (select value v, count(*) c from events where value is not null group by all), r as (select v, c, sum(c) over (order by v rows unbounded preceding) k from c),"
    f" f as (select k/n hi, (k-c)/n lo, case when v>=m then 1-{_tail('(v-m)/s')}/2 else {_tail('(v-m)/s')}/2 end f, n from r, m), g as (select any_value(n) n, max(greatest(abs(hi-f),abs(lo-f))) d from f), x as (select n, d, (sqrt(n)+0.12+0.11/sqrt(n))*d x from g)"
    " select n, round(d,6) d, round(least(1,greatest(0,case when x>0.2 then 2*list_sum(list_transform(range(1,101), lambda k: (case when k%2=1 then 1 else -1 end)*exp(-2*k*k*x*x))) else 1 end)),6) p from x"
)
def stats_ks(spark, d):
    return _round(stats.ks_normal(read(spark, d, "events"), "value"), "d", "p")


@query()
def stats_shapiro(spark, d):
    return stats.shapiro(read(spark, d, "part"), "p_retailprice")


@query("with v as (select var_samp(l_quantity) a, var_samp(l_discount) b, var_samp(l_tax) c, var_samp(l_quantity+l_discount+l_tax) t, var_samp(l_discount+l_tax) bc, var_samp(l_quantity+l_tax) ac, var_samp(l_quantity+l_discount) ab from lineitem), q as (select corr(l_quantity,l_discount+l_tax) q1, corr(l_discount,l_quantity+l_tax) q2, corr(l_tax,l_quantity+l_discount) q3 from lineitem) select item, round(alpha,6) alpha, round(item_total,6) item_total from (select null::varchar item, 1.5*(1-(a+b+c)/t) alpha, null::double item_total from v union all select 'l_quantity', 2*(1-(b+c)/bc), q1 from v, q union all select 'l_discount', 2*(1-(a+c)/ac), q2 from v, q union all select 'l_tax', 2*(1-(a+b)/ab), q3 from v, q)")
def stats_cronbach(spark, d):
    return _round(stats.cronbach(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "alpha", "item_total")


@query("with m as (select min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) e, count(*) n from part), x as (select (p_size-a)/(b-a)+1e-9 u, (p_retailprice-c)/(e-c)+1e-9 w, n from part, m), s as (select sum(u) su, sum(w) sw, max(n) n from x), h as (select -sum(u/su*ln(u/su))/ln(max(s.n)) eu, -sum(w/sw*ln(w/sw))/ln(max(s.n)) ew from x, s) select 'p_size' column_name, round(eu,6) entropy, round((1-eu)/(2-eu-ew),6) weight from h union all select 'p_retailprice', round(ew,6), round((1-ew)/(2-eu-ew),6) from h")
def entropy_weight(spark, d):
    return _round(stats.entropy_weights(read(spark, d, "part"), ["p_size", "p_retailprice"]), "entropy", "weight")


@query("with m as (select min(l_extendedprice) a, max(l_extendedprice) b from lineitem) select least(floor((l_extendedprice-a)/((b-a)/8))+1,8)::bigint bin, count(*) n from lineitem, m group by all")
def histogram(spark, d):
    return stats.histogram(read(spark, d, "lineitem"), "l_extendedprice", 8).select(F.col("bin").cast("long").alias("bin"), "n")


@query("with c as (select quantile_cont(l_extendedprice,0.75) c from lineitem), h as (select l_quantity x, l_extendedprice y, l_extendedprice>=c hi from lineitem, c) select 'l_quantity' driver, count(case when hi then 1 end) n_high, count(case when not hi then 1 end) n_rest, round(avg(case when hi then x end),6) mean_high, round(avg(case when not hi then x end),6) mean_rest, round(corr(x,y),6) r, round((avg(case when hi then x end)-avg(case when not hi then x end))/abs(avg(case when not hi then x end))*100,6) lift_percent, round((avg(case when hi then x end)-avg(case when not hi then x end))/sqrt((var_samp(case when hi then x end)+var_samp(case when not hi then x end))/2),6) cohen_d from h")
def driver_analysis(spark, d):
    return _round(stats.drivers(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]), "mean_high", "mean_rest", "r", "lift_percent", "cohen_d")


@query("with x as (select event_type m, ts::date t, sum(value) v from events group by all), r as (select a.m a, b.m b, count(*) n, corr(a.v,b.v) r from x a join x b using(t) where a.m<>b.m group by all) select a, b, n, round(r,6) r from r qualify row_number() over (partition by a order by r desc, b)<=2")
def measure_similarity(spark, d):
    x = read(spark, d, "events").groupBy(F.col("event_type").alias("m"), F.to_date("ts").alias("t")).agg(F.sum("value").alias("v"))
    return _round(stats.similarity(x, "m", "t", "v", 2), "r")


@query("with x as (select event_type k, ts::date p, sum(value) v from events group by all), i as (select k, v, row_number() over (partition by k order by p)-1 i from x) select k, count(*) n, round(regr_slope(v,i),6) slope, round(regr_intercept(v,i),4) as intercept, round(regr_r2(v,i),6) r2 from i group by k")
def trend(spark, d):
    x = read(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("p")).agg(F.sum("value").alias("v"))
    return _round(_round(stats.trend(x, ["k"], "p", "v"), "slope", "r2"), "intercept", n=4)


@query(f"with x as ({_SERIES}), q as (select k, quantile_cont(v,0.25) a, quantile_cont(v,0.75) b, avg(v) m, stddev_samp(v) s from x group by k) select k, p, round(v,4) v, (v<a-1.5*(b-a) or v>b+1.5*(b-a)) by_iqr, abs((v-m)/s)>2.5 by_z from x join q using(k) where by_iqr or by_z")
def outliers(spark, d):
    return _round(stats.outliers(_events(spark, d), ["k"], "v"), "v", n=4)


@query()
def stats_pca(spark, d):
    return stats.pca(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query()
def stats_kmeans(spark, d):
    return stats.kmeans(read(spark, d, "part"), ["p_size", "p_retailprice"], 3).select("p_partkey", "cluster")
