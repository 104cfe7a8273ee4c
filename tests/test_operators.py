import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import alerts, attribution, forecasting, meta, pivot, ranking, series, stats, text
from metricloom.sources import writers
from metricloom.sources.readers import Database, Sources
from metricloom.streaming import scans


def test_division_contribution_from_the_worked_case(spark):
    df = spark.createDataFrame([(6.0, 4.0, 20.0, 10.0)], "a0 double, a1 double, b0 double, b1 double")
    c = [F.col(x) for x in ("a0", "a1", "b0", "b1")]
    first, second = df.select(*attribution.division(*c)).first()
    assert first == pytest.approx(-0.1) and second == pytest.approx(0.2) and first + second == pytest.approx(0.1)


def test_decompositions_add_up(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(1, 50, (12, 2)))] + [("new", 5.0, 0.0), ("gone", 0.0, 4.0)]
    df = spark.createDataFrame(rows, "member string, current double, base double")
    got = attribution.additive(df).agg(F.sum("contribution"), F.sum("contribution_share")).first()
    total = sum(r[1] for r in rows) / sum(r[2] for r in rows) - 1
    assert got[0] == pytest.approx(total) and got[1] == pytest.approx(1)
    effects = df.select(F.sum(attribution.lmdi(F.col("current"), F.col("base")))).first()[0]
    assert effects == pytest.approx(sum(r[1] - r[2] for r in rows))
    p = attribution.pareto(df, "member", "current").collect()
    assert p[-1]["running_share"] == pytest.approx(1) and [r["rank"] for r in p] == list(range(1, 15))
    g = attribution.gini_of_change(df.withColumn("d", F.lit(1)), ["d"]).first()["gini"]
    assert -1 < g < 1
    zero = spark.createDataFrame([("a", 0.0, 0.0)], "member string, current double, base double").withColumn("d", F.lit(1))
    assert attribution.gini_of_change(zero, ["d"]).first()["gini"] is None


def test_two_factor_sums_to_the_change_of_the_ratio(spark):
    rows = [(3.0, 5.0, 10.0, 12.0), (8.0, 7.0, 20.0, 22.0)]
    df = spark.createDataFrame(rows, "a0 double, a1 double, b0 double, b1 double")
    t = df.agg(*[F.sum(x).alias(f"t{x}") for x in ("a0", "a1", "b0", "b1")])
    c = [F.col(x) for x in ("a0", "a1", "b0", "b1", "ta0", "ta1", "tb0", "tb1")]
    got = df.crossJoin(t).select(F.sum(attribution.two_factor(*c))).first()[0]
    assert got == pytest.approx(12 / 34 - 11 / 30)


def test_truncation_is_towards_zero(spark):
    df = spark.createDataFrame([(1.23456,), (-1.23456,)], "x double")
    assert [r[0] for r in df.select(attribution.truncated(F.col("x"), 3)).collect()] == pytest.approx([1.234, -1.234])


def test_self_alerts_of_the_city_case(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate((100.0, 900.0, 0.0, 110.0, 105.0))], "k string, i int, v double")
    got = {r["v"]: r["severity"] for r in alerts.self_anomalies(df, ["k"], "i", "v").collect()}
    assert got[900.0] == 3 and got[0.0] == 3 and 105.0 not in got
    path = {r["v"]: (r["direction"], r["severity"]) for r in alerts.path_anomalies(df, ["k"], "i", "v").collect()}
    assert path == {900.0: ("high", 3), 0.0: ("low", 3)}
    assert alerts.self_anomalies(df.limit(2), ["k"], "i", "v").count() == 0
    quiet = spark.createDataFrame([("k", i, 5.0) for i in range(6)] + [("k", 9, None)], "k string, i int, v double")
    assert alerts.self_anomalies(quiet, ["k"], "i", "v").count() == 0


def test_benjamini_hochberg_of_the_worked_case(spark):
    df = spark.createDataFrame([(0, 0.001), (1, 0.02), (2, 0.5), (3, None)], "i int, p double")
    got = {r["i"]: r["q"] for r in series.benjamini_hochberg(df, "p").collect()}
    assert got[0] == pytest.approx(0.003) and got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.5) and got[3] is None


def test_forecast_paths_against_one_origin_at_a_time():
    rng = np.random.default_rng(5)
    y, season, h = 50 + np.cumsum(rng.normal(size=60)) + 5 * np.sin(np.arange(60) * np.pi / 6), 12, 5
    every = forecasting.paths(y, h, season)
    for o in (24, 25, 40, 55):  # what a model says after o points does not depend on those to come
        cut = forecasting.paths(y[:o], h, season)
        assert all(np.allclose(every[k][o - 1], cut[k][-1], equal_nan=True) for k in every)
        assert np.allclose(every["drift"][o - 1], y[o - 1] + (y[o - 1] - y[0]) / (o - 1) * np.arange(1, h + 1))
        assert np.allclose(every["seasonal_naive"][o - 1], [y[o - season + k % season] for k in range(h)])
    table = forecasting.error_table(y, every["naive"], 24)
    assert table.shape == (60 - h - 23, h)
    assert np.allclose(table[3], y[27 : 27 + h] - y[26])
    rows, sure = forecasting.best_forecast(y, 8, season, 1.0)
    assert len(rows) == 8 and 0 <= sure <= 1 and (np.diff(rows.upper95 - rows.lower95) >= -1e-9).all()


def test_forecast_and_pace(spark):
    rows = [("up", i, 10.0 + 2 * i) for i in range(40)] + [("short", i, 1.0) for i in range(5)] + [("wave", i, 50 + 10 * math.sin(i * math.pi / 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = forecasting.auto_forecast(df, ["k"], "i", "v", 4, 12).toPandas()
    up = got[got.k == "up"].sort_values("step")
    assert np.allclose(up.value, [90, 92, 94, 96], atol=1.5) and set(got[got.k == "short"].status) == {"INSUFFICIENT_DATA"}
    wave = got[got.k == "wave"]
    assert set(wave.model) == {"seasonal_naive"} == set(wave.baseline) and set(wave.status) == {"QUALIFIED"} and len(wave) == 4
    assert (got.lower95.dropna() <= got.lower80.dropna()).all() and (got.lower80.dropna() <= got.value.dropna()).all() and (got.value.dropna() <= got.upper80.dropna()).all()
    holes = spark.createDataFrame([("h", i, None if i % 3 == 0 else float(i)) for i in range(60)] + [("few", i, None if i == 7 else float(i)) for i in range(60)], "k string, i int, v double")
    got = {r.k: (r.status, r.missing_rate) for r in forecasting.auto_forecast(holes, ["k"], "i", "v", 1).collect()}
    assert got["h"][0] == "INSUFFICIENT_DATA" and got["h"][1] == pytest.approx(1 / 3) and got["few"][0] == "QUALIFIED"
    goals = spark.createDataFrame(
        [("a", 120.0, 0.0, 0.0, 3, 100.0, "HIGHER"), ("b", 50.0, 60.0, 5.0, 3, 100.0, "HIGHER"), ("c", 50.0, 40.0, 5.0, 3, 100.0, "HIGHER"), ("d", 50.0, 50.0, 10.0, 2, 100.0, "LOWER"), ("e", 90.0, 0.0, 0.0, 0, 100.0, "HIGHER"), ("f", 50.0, 50.0, 1.0, 2, 100.0, "RANGE")],
        "k string, actual double, forecast double, sigma double, remaining int, target double, direction string",
    ).withColumn("lower", F.when(F.col("k") == "f", 90.0)).withColumn("upper", F.when(F.col("k") == "f", 110.0))
    got = {r["k"]: r for r in series.pace_to_goal(goals).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ACHIEVED", "b": "ON_TRACK", "c": "OFF_TRACK", "d": "AT_RISK", "e": "OFF_TRACK", "f": "ON_TRACK"}
    assert got["b"]["probability"] == pytest.approx(0.5 * (1 + math.erf(2 / math.sqrt(2))), abs=1e-6) and got["c"]["required_pace"] == pytest.approx(50 / 3)


def test_distributions():
    assert stats.t_p(2.228, 10) == pytest.approx(0.05, abs=2e-4) and stats.f_p(4.10, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.chi2_p(5.991, 2) == pytest.approx(0.05, abs=1e-4) and stats.chi2_p(0.5, 4) == pytest.approx(0.9735, abs=1e-4)
    assert stats.t_p(0, 5) == pytest.approx(1) and stats.chi2_p(0, 3) == 1


def test_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = 2 + 3 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(*map(float, a), float(b), int(b > 2)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double, l int")
    got = stats.ols(df, "y", ["a", "b", "c"])
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert [got["intercept"], *got["coefficients"].values()] == pytest.approx(want.tolist()) and got["p"]["a"] < 1e-9 < got["p"]["c"] and got["vif"]["a"] == pytest.approx(1, abs=0.1)
    assert stats.stepwise(df, "y", ["a", "b", "c"])[:2] == ["a", "b"]
    steps = stats.hierarchical(df, "y", [["a"], ["b"]])
    assert steps[1]["gain"] == pytest.approx(steps[1]["r2"] - steps[0]["r2"]) and steps[1]["gain"] > 0
    logit = stats.logit(df.withColumn("l", F.when(F.rand(1) < 0.1, 1 - F.col("l")).otherwise(F.col("l"))), "l", ["a", "b"])
    assert logit["coefficients"]["a"] > 0 > logit["coefficients"]["b"] and 0 < logit["cox_snell"] < logit["nagelkerke"] < 1
    p = stats.pca(df, ["a", "b", "y"]).collect()
    assert sum(r["share"] for r in p) == pytest.approx(1) and sum(r["eigenvalue"] for r in p) == pytest.approx(3)


def test_group_tests(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (3.0, 4.0, 5.0, 6.0)] + [("c", v) for v in (9.0, 9.0, 10.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = stats.anova(df, "v", "g").first()
    assert a["ss_between"] + a["ss_within"] == pytest.approx(float(np.var([v for _, v in rows]) * len(rows))) and a["p"] < 0.01
    t = stats.t_test(df, "v", "g", "a", "b", equal=True).first()
    assert t["t"] == pytest.approx(-2 / math.sqrt(5 / 3 * 0.5)) and t["df"] == 6
    assert {r["g"]: r["rank_sum"] for r in stats.rank_sums(df, "v", "g").collect()} == {"a": 12.0, "b": 24.0, "c": 30.0}
    assert stats.kruskal(df, "v", "g").first()["p"] < 0.05 and stats.levene(df, "v", "g").first()["groups"] == 3
    assert stats.mann_whitney(df, "v", "g", "a", "b").first()["u"] == 2.0
    two = spark.createDataFrame([(x, y, float(2 * i + 3 * j + (k % 2))) for i, x in enumerate("ab") for j, y in enumerate("pq") for k in range(4)], "x string, y string, v double")
    got = {r["source"]: r for r in stats.anova_two_way(two, "v", "x", "y").collect()}
    assert got["x"]["ss"] == pytest.approx(16) and got["y"]["ss"] == pytest.approx(36) and got["x:y"]["ss"] == pytest.approx(0, abs=1e-9) and got["residual"]["df"] == 12
    assert stats.t_test_paired(spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 5.0)], "a double, b double"), "a", "b").first()["n"] == 3


def test_entropy_cronbach_histogram(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 5.0), (3.0, 6.0, 2.0), (4.0, 8.0, 9.0)], "a double, b double, c double")
    w = stats.entropy_weights(df, ["a", "b", "c"]).collect()
    assert sum(r["weight"] for r in w) == pytest.approx(1) and w[0]["weight"] == pytest.approx(w[1]["weight"])
    alpha = {r["item"]: r["alpha"] for r in stats.cronbach(df, ["a", "b"]).collect()}
    assert alpha[None] == pytest.approx(2 * (1 - (5 / 3 + 20 / 3) / 15)) and alpha["a"] is None
    h = stats.histogram(df, "a", 3).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 1, 2] and h[-1]["hi"] == pytest.approx(4)
    assert stats.histogram(df.limit(0), "a", 3).count() == 0


def test_profiles_and_keys(spark):
    people = spark.createDataFrame([(1, "a@b.co"), (2, "c@d.org"), (3, None)], "p_id int, mail string")
    got = {r["column_name"]: r for r in meta.profile(people).collect()}
    assert got["mail"]["pattern"] == "email" and got["mail"]["n_null"] == 1 and got["p_id"]["mean"] == 2.0
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "o_id int, o_person int")
    assert [tuple(r) for r in meta.orphans(orders, "o_person", people, "p_id").collect()] == [(9, 1)]
    assert meta.inclusion(orders, "o_person", people, "p_id").first()["verdict"] == "none"
    assert meta.schema_difference({"o_id": "int", "gone": "int", "o_person": "string"}, orders) == [("gone", "missing"), ("o_person", "type")]
    assert meta.triples({"o": orders}, [("o", "o_person", "p", "p_id")]).filter("p = 'references'").count() == 1
    a, b = meta.profile(people, ["p_id"]), meta.profile(orders, ["o_id"])
    assert meta.profile_similarity(a, b).first()["score"] == pytest.approx(0.6 * 0.75 + 0.4)
    enum = meta.shared_enum(people, "mail", people, "mail").first()
    assert enum["confidence"] == pytest.approx(0.95)


def test_text_operators(spark):
    df = spark.createDataFrame([(1, "Call 138-0013-8000 or Mail x.y@z.com, card 1234 5678 9012 3456")], "i int, t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "Call <phone> or Mail <email>, card <card>"
    assert spark.createDataFrame([("ＡＢｃ， d!  e",)], "t string").select(text.normalised(F.col("t"))).first()[0] == "abc d e"
    names = spark.createDataFrame([("revenue",), ("returns",)], "n string")
    got = text.fuzzy_match(spark.createDataFrame([("revenu",), ("xyz",)], "t string"), "t", names, "n").collect()
    assert [tuple(r) for r in got] == [("revenu", "revenue", 1)]


def test_series_filling_and_lags(spark):
    df = spark.createDataFrame([("k", "2024-01-01", 1.0), ("k", "2024-01-04", 4.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    assert [r["v"] for r in series.fill(df, ["k"], "d", "v", "1 day", "interpolate").orderBy("d").collect()] == [1.0, 2.0, 3.0, 4.0]
    assert [r["v"] for r in series.fill(df, ["k"], "d", "v", "1 day").orderBy("d").collect()] == [1.0, None, None, 4.0]
    xs = np.sin(np.arange(40) / 3)
    two = spark.createDataFrame([(i, float(xs[i]), float(xs[i - 2]) if i > 1 else 0.0) for i in range(40)], "i int, x double, y double")
    assert max(series.lagged(two, "i", "x", "y", 4).collect(), key=lambda r: r["r"])["lag"] == 2


def test_pivots(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 9), ("b", 3, 9), ("a", 3, 1)], "k string, i int, v int")
    assert {(r["k"], r["kind"]): r["v"] for r in pivot.representatives(df, ["k"], "v", "i").collect()} == {("a", "max"): 5, ("a", "middle"): 3, ("a", "min"): 1, ("b", "max"): 9, ("b", "min"): 9}
    assert {(r["before"], r["after"]): r["n"] for r in pivot.transitions(df, ["k"], ["i"], "v").collect()} == {(5, 3): 1, (3, 1): 1, (9, 9): 1}
    cube = pivot.subtotals(df, ["k"], {"s": F.sum("v"), "n": F.countDistinct("v")}, "cube")
    assert {(r["k"], r["level"]): (r["s"], r["n"]) for r in cube.collect()} == {("a", 0): (9, 3), ("b", 0): (18, 1), (None, 1): (27, 4)}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    writers.to_csv_later(df, f"{tmp_path}/a.csv").result()
    writers.append(df, f"{tmp_path}/t.parquet")
    writers.append(df, f"{tmp_path}/t.parquet")
    s = Sources(spark, {"c": f"{tmp_path}/a.csv", "p": f"{tmp_path}/t.parquet", "q": "select 1 as one", "d": df, "tmp_x": df})
    assert s.read("c").count() == 2 and s.read("p").count() == 4 and s.read("q").first()[0] == 1 and s.test("d")
    assert s.names() == ["c", "d", "p", "q"] and s.sample("p", 3).count() == 3 and s.schema("d").count() == 2
    writers.to_turtle(meta.triples({"d": df}, []), f"{tmp_path}/kg")
    assert spark.read.text(f"{tmp_path}/kg").filter("value like '<table:d> <a> <Table> .'").count() == 1
    assert "LogicalRDD" in writers.plan_text(df) or "LocalRelation" in writers.plan_text(df) or writers.plan_text(df)
    assert Database("oracle", "h", 1521, "s").url() == "jdbc:oracle:thin:@//h:1521/s" and "databaseName=s" in Database("sqlserver", "h", 1, "s").url() and Database("mysql", "h", 3306, "s").url().startswith("jdbc:mysql://h:3306/s?")
    with pytest.raises(ValueError):
        Database("other", "h", 1, "s").url()


def test_stream_scan_waits_out_the_cooldown(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 50.0), ("a", "2024-01-01 00:05:00", 60.0), ("b", "2024-01-01 00:05:00", 1.0)]
    src = f"{tmp_path}/in"

    def feed(rows):
        spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(src)
        scans.scan_stream(stream, [("high", "v", "gt", (10,), 3)], ["k"], "ts", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
        return sorted((r["k"], str(r["ts"])) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    feed(rows)
    assert run() == [("a", "2024-01-01 00:00:00")]
    feed([("a", "2024-01-01 00:10:00", 70.0), ("b", "2024-01-01 00:10:00", 99.0)])
    assert run() == [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00")]
    feed([("a", "2024-01-01 00:20:00", 70.0), ("a", "2024-01-01 00:34:00", 71.0), ("a", "2024-01-01 00:36:00", 72.0)])
    assert [t for k, t in run() if k == "a"] == ["2024-01-01 00:00:00", "2024-01-01 00:20:00", "2024-01-01 00:36:00"]
    told = {str(r["ts"]): (r["measure"], r["value"], r["severity"], r["rule"]) for r in spark.read.parquet(f"{tmp_path}/out").filter("k = 'a'").collect()}
    assert told["2024-01-01 00:36:00"] == ("v", 72.0, 3, "high")


def test_a_batch_run_again_tells_nothing_twice(spark):
    alerts_ = spark.createDataFrame([("r", "a", "2024-01-01 00:00:00", 3, "m", 1.0), ("r", "a", "2024-01-01 00:10:00", 3, "m", 2.0), ("r", "a", "2024-01-01 00:16:00", 3, "m", 3.0)], "rule string, k string, ts string, severity int, measure string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = scans.cooled(alerts_, None, ["rule", "k"], "ts")
    assert got.columns == alerts_.columns and sorted(r["value"] for r in got.collect()) == [1.0, 3.0]
    last = alerts_.filter("value = 1").select("rule", "k", "ts")
    assert [r["value"] for r in scans.cooled(alerts_, last, ["rule", "k"], "ts").collect()] == [3.0]


def test_ranks_and_running_totals_in_bins(spark):
    rng = np.random.default_rng(7)
    v = [float(x) for x in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(900, None)], "i int, v double").repartition(5)
    got = {r["v"]: (r["c"], r["rank"]) for r in ranking.average_ranks(df, "v", bins=7).collect()}
    for x in set(v):
        places = [k + 1 for k, y in enumerate(sorted(v)) if y == x]
        assert got[x] == (len(places), sum(places) / len(places))
    run = ranking.running(df.filter("v is not null"), "v", {"n": F.lit(1), "s": F.col("v")}, descending=True, ties=("i",), bins=7).collect()
    order = sorted(((x, i) for i, x in enumerate(v)), key=lambda p: (-p[0], p[1]))
    at = {i: (k + 1, sum(x for x, _ in order[: k + 1])) for k, (_, i) in enumerate(order)}
    assert all((r["n"], r["s"]) == at[r["i"]] for r in run)
    other = spark.createDataFrame([(float(i), float((i * 7) % 11)) for i in range(60)], "a double, b double")
    rank = lambda x: np.array([np.mean([k + 1 for k, y in enumerate(sorted(x)) if y == t]) for t in x])
    a, b = np.arange(60.0), np.array([(i * 7) % 11 for i in range(60)], dtype=float)
    assert stats.correlation_matrix(other, ["a", "b"], "spearman").first()["r"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])


def test_more_attribution(spark):
    assert attribution.linear_coefficients("2 * {a} - ({b} + {a}) / 2 + 3") == {"a": 1.5, "b": -0.5}
    assert attribution.linear_coefficients("{a} / {b}") is None and attribution.linear_coefficients("{a} * {b}") is None
    assert attribution.linear_coefficients("-{a} + 10%") == {"a": -1.0}
    assert attribution.operand_changes({"a": 3.0, "b": None}, {"a": 2.0}) == [("a", 1.0, 50.0), ("b", None, None)]
    df = spark.createDataFrame([("x", "p", 1, 10.0), ("x", "q", 0, 4.0), ("y", "p", 1, 1.0), (None, "p", 0, 2.0)], "a string, b string, c int, v double")
    got = {(r["dimension"], r["member"]): (r["current"], r["base"]) for r in attribution.over_dimensions(df, ["a", "b"], F.col("v"), F.col("c") == 1, F.col("c") == 0).collect()}
    assert got == {("a", "x"): (10.0, 4.0), ("a", "y"): (1.0, 0.0), ("a", None): (0.0, 2.0), ("b", "p"): (11.0, 2.0), ("b", "q"): (0.0, 4.0)}
    drilled = attribution.drill_down(df, "a", "b", F.col("v"), F.col("c") == 1, F.col("c") == 0, top=1).collect()
    assert [(r["member"], r["child"]) for r in drilled] == [("x", "p")]


def test_more_text(spark):
    assert text.comment_references([("o", "c", "references customers.id"), ("o", "d", "FK -> days(day_id)"), ("o", "e", None), ("o", "f", "nothing")]) == [("o", "c", "customers", "id"), ("o", "d", "days", "day_id")]
    q, n = spark.createDataFrame([("revenues",), ("zzz",)], "query string"), spark.createDataFrame([("revenue",), ("returns",)], "name string")
    assert [(r["query"], r["name"]) for r in text.retrieve(q, n, 1).collect()] == [("revenues", "revenue")]
    loading = stats.factor_loadings(spark.createDataFrame([(float(i), float(2 * i + i % 3), float(i % 5)) for i in range(60)], "a double, b double, c double"), ["a", "b", "c"], 1)
    assert abs(loading["a"][0]) > 0.9 and abs(loading["c"][0]) < 0.5


def test_tables_of_the_studentised_range_and_t():
    for q, groups, df in ((3.877, 3, 10), (3.578, 3, 20), (3.917, 5, 120), (4.046, 4, 16)):
        assert stats.range_p(q, groups, df) == pytest.approx(0.05, abs=0.001)
    assert stats.t_limit(0.05, 10) == pytest.approx(2.2281, abs=1e-3) and stats.t_limit(0.05, 1e6) == pytest.approx(1.95996, abs=1e-3)


def test_more_statistics(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(e), "abc"[i % 3], float(rng.normal(i % 3 == 2))) for i, (x, e) in enumerate(zip(rng.normal(size=300), rng.exponential(size=300), strict=True))]
    df = spark.createDataFrame(rows, "i int, x double, e double, g string, v double")
    normal, skewed = stats.shapiro(df, "x").first(), stats.shapiro(df, "e").first()
    assert normal["p"] > 0.01 and skewed["p"] < 1e-6 and skewed["w"] < normal["w"] <= 1 and normal["used"] == 300
    assert stats.shapiro(df.filter("i < 2"), "x").first()["w"] is None
    # three values: W is known in closed form
    three = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert stats.shapiro(three, "x").first()["w"] == pytest.approx(0.5 * 9 / ((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2))
    pairs = {(r["a"], r["b"]): r["p"] for r in stats.tukey(df, "v", "g").collect()}
    assert pairs["a", "c"] < 0.01 and pairs["b", "c"] < 0.01 and pairs["a", "b"] > 0.05
    with pytest.raises(ValueError):
        stats.tukey(df, "v", "i")
    one = stats.t_test_one(df, "x", 0.0).first()
    assert one["lower"] < one["mean"] < one["upper"] and one["upper"] - one["mean"] == pytest.approx(stats.t_limit(0.05, 299) * one["std"] / math.sqrt(300))
    curve = stats.elbow(spark.createDataFrame([(float(c * 50 + rng.normal()), float(c % 2 * 50 + rng.normal())) for c in range(3) for _ in range(30)], "x double, y double"), ["x", "y"], 6).collect()
    assert [r["k"] for r in curve if r["chosen"]] == [3]
    assert {r["component"]: r["kept"] for r in stats.pca(df, ["x", "e", "v"]).collect()}[1] is True


def test_percentiles_and_quantiles_by_ranks(spark):
    rng = np.random.default_rng(2)
    v = {"a": rng.integers(0, 50, 400).astype(float), "b": rng.normal(size=37), None: np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("a", None)], "k string, x double")
    got = {(r["k"], r["q"]): r["value"] for r in ranking.grouped_percentiles(df, ["k"], "x", [0.0, 0.25, 0.5, 0.99, 1.0], bins=9).collect()}
    for k, xs in v.items():
        s = sorted(xs)
        assert all(got[k, q] == s[max(math.ceil(q * len(s)) - 1, 0)] for q in (0.0, 0.25, 0.5, 0.99, 1.0))
    every = np.concatenate([xs for xs in v.values()])
    assert np.allclose(ranking.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], bins=7), np.quantile(every, [0, 0.25, 0.5, 0.9, 1]))
    assert ranking.quantiles(df.limit(0), "x", [0.5]) == [None]


def test_pairs_of_metrics_need_changes_that_go_together(spark):
    rng = np.random.default_rng(8)
    steps = rng.normal(size=80)
    left, right, apart = np.cumsum(steps), np.cumsum(2 * steps + rng.normal(scale=0.1, size=80)), np.cumsum(rng.normal(1, 1, 80))
    rows = [(m, i, float(x)) for m, xs in (("l", left), ("r", right), ("t", apart + np.arange(80)), ("few", left[:20])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "m string, p int, v double")
    pairs = spark.createDataFrame([("l", "r", 1.0), ("l", "t", 0.7), ("few", "r", 1.0), ("l", "none", 1.0)], "a string, b string, priority double")
    told = series.pair_relations(series.pair_measures(df, pairs, "m", "p", "v")).collect()
    assert [(r["a"], r["b"], r["direction"], r["best_lag"]) for r in told] == [("l", "r", "same", 0)]
    assert told[0]["effect"] > 0.95 and told[0]["q"] < 1e-6 and told[0]["coverage"] == 1.0 and 0.9 < told[0]["confidence"] <= 1


def test_breakdown_over_floors(spark):
    rows = [("x", "p", "1", 1, 10.0), ("x", "p", "2", 0, 4.0), ("x", "q", "1", 1, 1.0), ("y", "p", "1", 0, 6.0), (None, "p", "1", 1, 2.0)]
    df = spark.createDataFrame(rows, "a string, b string, c string, y int, v double")
    got = {(r["level"], r["a"], r["b"], r["c"]): r for r in attribution.dismantling_tree(df, ["a", "b", "c"], F.col("v"), F.col("y") == 1, F.col("y") == 0).collect()}
    assert got[1, "x", None, None]["contribution"] == pytest.approx(7 / 10) and got[1, None, None, None]["current"] == 2.0 and got[1, "x", None, None]["rank"] == 1
    assert got[2, "x", "p", None]["contribution"] == pytest.approx(6 / 4) and got[2, "x", "p", None]["proportion"] == pytest.approx(10 / 11) and got[3, "x", "p", "2"]["delta"] == -4.0
    assert (2, None, "p", None) in got and len([k for k in got if k[0] == 3]) == 5
    few = attribution.dismantling_tree(df, ["a", "b", "c"], F.col("v"), F.col("y") == 1, F.col("y") == 0, top=1).collect()
    assert {(r["level"], r["a"], r["b"]) for r in few if r["level"] == 2} == {(2, "x", "p"), (2, "x", "q")} and len([r for r in few if r["level"] == 3]) == 2
