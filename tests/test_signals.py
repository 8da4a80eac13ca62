import datetime as dt
import random

from pyspark.sql import functions as F

from mercata.operators import analytics, recommend, signals as sig, trends

MONDAY = dt.date(2024, 1, 1)


def points(spark, series, capture="a", at="2024-06-01T00:00:00Z", tf="today 3-m"):
    """series: keyword -> list of weekly values, None for a missing week."""
    rows = [(k, "ES-MD", tf, capture, at, MONDAY + dt.timedelta(weeks=i), float(x))
            for k, xs in series.items() for i, x in enumerate(xs) if x is not None]
    return spark.createDataFrame(rows, "keyword string, geo string, timeframe string, "
                                 "capture_id string, captured_at string, d date, value double")


def signals_of(spark, pts, categories=("Pan", "leche")):
    cats = spark.createDataFrame([(c,) for c in categories], ["category"])
    return {(r["keyword"], r["window_start"]): r
            for r in sig.compute_signals(pts, cats, "2024-06-01T00:00:00Z").collect()}


def test_confidence_tiers_and_directions(spark):
    rising = [20, 24, 30, 36, 43, 52, 63, 76, 92]
    series = {"steady": [15, 15, 15, 15], "short": [50, 60, 70], "up": rising,
              "gap": rising[:4] + [None] + rising[4:], "edge": [100, 115, 97.75, 0, 0, 5]}
    s = signals_of(spark, points(spark, series))

    def week(k, i):
        return s[(k, MONDAY + dt.timedelta(weeks=i))]
    assert week("up", 6)["confidence"] == "medium"
    assert week("up", 7)["confidence"] == "high"
    assert week("steady", 2)["confidence"] == "low"
    assert week("steady", 3)["confidence"] == "medium"
    assert week("short", 2)["confidence"] == "low"
    assert {s[k]["confidence"] for k in s if k[0] == "gap"} == {"low"}
    edge = [(week("edge", i)["delta_pct"], week("edge", i)["direction"]) for i in range(6)]
    assert edge == [(0.0, "flat"), (15.0, "rising"), (-15.0, "falling"), (-100.0, "falling"),
                    (0.0, "flat"), (100.0, "rising")]
    assert week("up", 0)["window_end"] == MONDAY + dt.timedelta(days=6)


def test_newest_capture_wins_and_is_the_provenance(spark):
    old = points(spark, {"k": [50, 60]}, "old", "2024-05-01T00:00:00Z")
    new = points(spark, {"k": [90]}, "new", "2024-05-02T00:00:00Z")
    bad = points(spark, {"k": [1, 1]}, "zzz", "not a time")
    s = signals_of(spark, old.union(new).union(bad))
    first, second = (s[("k", MONDAY + dt.timedelta(weeks=i))] for i in (0, 1))
    assert (first["interest_avg"], first["snapshot_ids"]) == (90.0, ["new"])
    assert (second["interest_avg"], second["snapshot_ids"]) == (60.0, ["old"])


def test_rank_is_dense_and_per_timeframe(spark):
    a = points(spark, {"x": [5], "y": [9], "z": [5], "w": [1]})
    b = points(spark, {"w": [99]}, tf="today 12-m")
    rows = sig.compute_signals(a.union(b), spark.createDataFrame([("X",)], ["category"]),
                               "t").collect()
    ranks = {(r["keyword"], r["timeframe"]): r["rank"] for r in rows}
    assert ranks == {("y", "today 3-m"): 1, ("x", "today 3-m"): 2, ("z", "today 3-m"): 2,
                     ("w", "today 3-m"): 3, ("w", "today 12-m"): 1}
    assert {r["category"] for r in rows if r["keyword"] == "x"} == {"X"}


def test_order_of_the_points_does_not_matter(spark):
    rng = random.Random(3)
    series = {f"k{i}": [rng.uniform(0, 99) for _ in range(12)] for i in range(6)}
    p = points(spark, series)
    one = sorted(map(str, signals_of(spark, p).values()))
    two = sorted(map(str, signals_of(spark, p.repartition(7).orderBy(F.rand(5))).values()))
    assert one == two


def test_discovery_parents(spark):
    rows = [("a", 0, 5.0, 50.0), ("b", 0, 0.5, 90.0), ("c", 0, 3.0, 50.0), ("d", 1, 9.0, 99.0),
            ("e", 0, 2.0, -1.0)]
    s = spark.createDataFrame(
        [(k, MONDAY + dt.timedelta(weeks=w), MONDAY + dt.timedelta(weeks=w, days=6), i, d)
         for k, w, i, d in rows],
        "keyword string, window_start date, window_end date, interest_avg double, "
        "delta_pct double")
    names = [r["keyword"] for r in sig.discovery_parents(s, "2024-01-10").collect()]
    assert names == ["a", "c", "e"]
    assert [r["keyword"] for r in sig.discovery_parents(s, "2023-01-01").collect()] == ["d"]
    assert sig.discovery_parents(s, "2024-01-10", top_n=0).count() == 0


def test_recommendations(spark):
    s = spark.createDataFrame(
        [("s1", "pan", "rising", "low"), ("s2", "te", "rising", "medium"),
         ("s3", "pan", "falling", "high"), ("s4", None, "rising", "high")],
        "id string, category string, direction string, confidence string")
    p = spark.createDataFrame(
        [("pan", 1, 5)] * 3 + [("pan", 2, 1), ("pan", 2, 0), ("te", 2, None), ("te", 3, 4),
                               ("pan", None, 9)],
        "category string, store_id int, qty int")
    got = {(r["signal_id"], r["store_id"]): r for r in recommend.build(s, p, "t").collect()}
    assert {k: r["action"] for k, r in got.items()} == {
        ("s1", "1"): "feature_in_window", ("s1", "2"): "watch", ("s2", "3"): "stock_up",
        ("s3", "1"): "watch", ("s3", "2"): "watch"}
    assert got[("s1", "1")]["headline"] == "Sube el interés por pan en Madrid"
    assert got[("s1", "1")]["body"] == "Tienes 3 productos de esta categoría en stock."


def test_labels(spark):
    def weak(*labels):
        df = spark.createDataFrame([(x,) for x in labels], "confidence string")
        return df.agg(analytics.weakest("confidence").alias("w")).first()["w"]
    assert weak("high", "medium") == "medium"
    assert weak("high", "odd") == "low"
    assert weak("high", None) == "low"
    assert weak() == "low"
    read = spark.createDataFrame([(4999,), (5000,)], ["n"]).select(
        analytics.census(F.col("n"), 5000).alias("c"), analytics.census(F.col("n")).alias("d")).collect()
    assert [(r["c"], r["d"]) for r in read] == [("high", "high"), ("low", "high")]


def test_rescale_and_lost_batches(spark):
    def s(*xs):
        return [("2024-01-01", float(x)) for x in xs]
    rows = [(1, "a", 0, "a", s(0, 0)), (1, "a", 0, "lost", s(50, 50)),
            (1, "a", 1, "a", s(10, 30)), (1, "a", 1, "ref", s(7, 9)),
            (1, "a", 2, "a", s(40, 40)), (1, "a", 2, "half", s(10, 20)),
            (1, "a", 3, "a", s()), (1, "a", 3, "gone", s(9))]
    df = spark.createDataFrame(rows, "capture int, anchor string, batch int, keyword string, "
                               "series array<struct<date:string,value:double>>")
    got = {r["keyword"]: [p["value"] for p in r["series"]]
           for r in trends.rescale(df).collect()}
    assert got == {"a": [10.0, 30.0], "lost": [], "ref": [7.0, 9.0], "half": [5.0, 10.0],
                   "gone": []}


def test_payloads(spark):
    payload = """{"interest_over_time":{"timeline_data":[
      {"timestamp":"1704067200","values":[{"query":"pan","extracted_value":7},
        {"extracted_value":"8.5"},{"query":"other","extracted_value":1}]},
      {"values":[{"query":"pan","extracted_value":9}]},
      {"timestamp":"1704672000","values":[{"query":"pan","extracted_value":"N/A"},
        {"query":"te","extracted_value":true}]}]}}"""
    df = spark.createDataFrame([(["pan", "te", "cafe"], payload)], ["keywords", "payload"])
    got = {r["keyword"]: [tuple(p) for p in r["series"]]
           for r in trends.parse_timeseries(df).collect()}
    assert got == {"pan": [("2024-01-01", 7.0)], "te": [("2024-01-01", 8.5)], "cafe": []}
    rising = """{"related_queries":{"top":[{"query":"no"}],"rising":[
      {"query":"a","value":"+250%","extracted_value":250},
      {"query":"b","value":"Breakout","extracted_value":91000},
      {"query":"c","value":"Aumento puntual","extracted_value":89800},
      {"query":"d","value":"+1.200 %","extracted_value":1200},
      {"query":"","value":"+9%","extracted_value":9},
      {"query":"e","value":"+50%","extracted_value":"N/A"},
      {"query":"a","value":"+300%","extracted_value":300}]}}"""
    caps = spark.createDataFrame([("pan", "ES-MD", "", "2024-01-02T03:04:05Z", rising)],
                                 ["parent_keyword", "geo", "gprop", "captured_at", "payload"])
    parsed = trends.parse_rising(caps)
    assert [(r["query"], r["growth_pct"], r["is_breakout"]) for r in
            parsed.orderBy("pos").collect()] == [
        ("a", 250.0, False), ("b", None, True), ("c", None, True), ("d", 1200.0, False),
        ("e", None, True), ("a", 300.0, False)]
    rows = trends.rising_rows(parsed).collect()
    assert sorted((r["query"], r["growth_pct"]) for r in rows if r["growth_pct"]) == [
        ("a", 250.0), ("d", 1200.0)]
    assert {r["captured_date"] for r in rows} == {"2024-01-02"} and len(rows) == 5
    assert trends.parse_rising(spark.createDataFrame([("{}",)], ["payload"])).count() == 0


def test_unreadable_payloads_have_failed(spark):
    from mercata import schemas
    from mercata.plans import demand
    good = '{"related_queries":{"rising":[{"query":"q","value":"+5%","extracted_value":5}]}}'
    rows = [("good", good), ("good", good[:-9]), ("empty", '{"related_queries":{"rising":[]}}'), ("none", "{}"),
            ("broken", good[:-3]), ("text", "<html>"), ("blank", " "), ("null", None), ("shape", '{"related_queries": 7}')]
    asked = spark.createDataFrame(rows, "parent_keyword string, payload string").withColumns(
        {"geo": F.lit("g"), "gprop": F.lit(""), "captured_at": F.lit("2024-01-01T00:00:00Z")})
    bad = {r["parent_keyword"] for r in trends.unreadable(asked, schemas.RISING_PAYLOAD).collect()}
    assert bad == {"good", "broken", "text", "blank", "null", "shape"}
    parsed = trends.rising_rows(trends.parse_rising(asked))
    parents = spark.createDataFrame([(p,) for p in {p for p, _ in rows} | {"silent"}], "keyword string")
    got = {r["parent"]: (r["status"], r["rows"]) for r in demand.outcomes(parents, asked, parsed, parsed).collect()}
    assert got == {"good": ("stored", 1), "empty": ("empty", 0), "none": ("empty", 0), **{
        p: ("failed", 0) for p in ("broken", "text", "blank", "null", "shape", "silent")}}
    captures = spark.createDataFrame([(1, ["a", "b"], '{"interest_over_time":{"timeline_data":[]}}'), (2, ["a"], "{"), (3, ["c"], None)],
                                     "batch int, keywords array<string>, payload string")
    series = trends.parse_timeseries(captures).collect()
    assert sorted((r["batch"], r["keyword"], len(r["series"])) for r in series) == [(1, "a", 0), (1, "b", 0)]


def test_universe_anchor_and_batches(spark):
    seeds = spark.createDataFrame([(0, "Pan"), (1, "pan"), (2, " Té "), (3, "")],
                                  "pos int, keyword string")
    products = spark.createDataFrame([("PAN",), ("aceite",), ("  ",), (None,)],
                                     "category string")
    u = trends.keyword_universe(seeds, products)
    assert [r["keyword"] for r in u.collect()] == ["aceite", "Pan", " Té "]
    prior = spark.createDataFrame(
        [("Pan", 5.0, "2024-02-05"), ("aceite", 9.0, "2024-02-05"), ("gone", 1.0, "2024-03-04"),
         (" Té ", 0.0, "2024-02-05"), ("Pan", 99.0, "2024-01-01")],
        "keyword string, interest_avg double, window_start string")
    assert trends.pick_anchor(prior, u).first()["anchor"] == "Pan"
    assert trends.pick_anchor(prior.limit(0), u).first()["anchor"] == "aceite"
    names = spark.createDataFrame([(f"k{i:02d}", f"k{i:02d}") for i in range(11)],
                                  ["key", "keyword"])
    anchor = spark.createDataFrame([("k03",)], ["anchor"])
    got = {}
    for r in trends.batches(names, anchor).orderBy("batch", "slot").collect():
        got.setdefault(r["batch"], []).append(r["keyword"])
    assert got == {0: ["k03", "k00", "k01", "k02", "k04"],
                   1: ["k03", "k05", "k06", "k07", "k08"], 2: ["k03", "k09", "k10"]}
    alone = trends.batches(names.filter("key = 'k03'"), anchor).collect()
    assert [(r["batch"], r["keyword"]) for r in alone] == [(0, "k03")]


def test_signals_and_recommendations_meet_their_contracts(spark):
    from mercata.operators import contracts
    uid = "11111111-1111-1111-1111-111111111111"
    p = points(spark, {"pan": [10, 20, 30], "leche": [5, 5, 5]}, capture=uid)
    s = sig.compute_signals(p, spark.createDataFrame([("Pan",), ("leche",)], ["category"]), "t")
    assert contracts.valid_rows(s, contracts.signal()).count() == s.count() == 6
    products = spark.createDataFrame([("Pan", uid, 4), ("leche", uid, 1)],
                                     ["category", "store_id", "qty"])
    r = recommend.build(s, products, "t")
    assert contracts.valid_rows(r, contracts.recommendation()).count() == r.count() == 6
    assert recommend.of_store(r, uid, 4).count() == 4


def test_a_repeated_run_changes_nothing(spark):
    from mercata.operators import upsert
    s = signals_of(spark, points(spark, {"k": [1, 2, 3]})).values()
    df = spark.createDataFrame([(r["id"], r["keyword"], str(r["window_start"])) for r in s],
                               ["id", "keyword", "window_start"])
    twice = upsert.replace_upsert(df, df, ["keyword", "window_start"])
    assert sorted(map(str, twice.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_recommendations_are_counted_without_pairs(spark):
    from mercata.operators import recommend
    signals = spark.createDataFrame(
        [(f"s{i}", ["a", "b", "", None][i % 4], ["rising", "falling", "flat"][i % 3], ["high", "low"][i // 3 % 2], f"w{i % 2}") for i in range(40)],
        "id string, category string, direction string, confidence string, window_start string")
    products = spark.createDataFrame(
        [(s, p, ["a", "b"][p % 2], s % 3) for s in range(12) for p in range(s % 7 + 1)],
        "store_id long, product_id long, category string, qty long")
    pairs = recommend.build(signals, products, "now").join(
        signals.select(F.col("id").alias("signal_id"), "window_start", "category"), "signal_id")
    by = ["window_start", "category", "action", "confidence"]
    want = pairs.groupBy(*by).agg(F.count(F.lit(1)), F.count_distinct("store_id"))
    got = recommend.mix(signals, products)
    assert got.columns == [*by, "recommendations", "stores"]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} != set()
    # a category's stores meet its signals as one row per count
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
