import random
import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from mercata.functions import geo, ids, intent, num, text, vocab


def one(spark, column, **values):
    values = values or {"x": 0}
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("v")).first()["v"]


def test_fold_agrees_with_unicode_data(spark):
    texts = ["Café", "NIÑO", "Ünïted Ağrı Łódź", "été", "Άθήνα й", "ß", "", "x²"]
    got = spark.createDataFrame([(t,) for t in texts], ["t"]).select(
        "t", text.fold("t").alias("f"), text.tokens("t").alias("k")).collect()
    for r in got:
        nfd = unicodedata.normalize("NFD", r["t"])
        want = "".join(c for c in nfd if not unicodedata.combining(c)).lower()
        assert r["f"] == want
        assert r["k"] == re.findall("[a-z0-9]+", want)


def test_half_even_agrees_with_round(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-500, 500) for _ in range(2000)]
    xs += [i / 8 for i in range(-40, 40)] + [2.675, 1.005, 0.125, -0.001]
    got = spark.createDataFrame([(x,) for x in xs], ["x"]).select(
        "x", num.half_even("x").alias("two"), num.half_even("x", 4).alias("four")).collect()
    for r in got:
        assert r["two"] == round(r["x"], 2)
        assert r["four"] == round(r["x"], 4)


def test_numbers(spark):
    cases = {"12": 12.0, " 3.5 ": 3.5, "-1e3": -1000.0, "N/A": None, "true": None, "NaN": None,
             "inf": None, "1d": None, "": None, "1e999": None, "5.": 5.0, ".5": 0.5}
    rows = spark.createDataFrame([(k,) for k in cases], ["s"]).select(
        "s", num.number("s").alias("n"), num.whole_number("s").alias("w")).collect()
    for r in rows:
        assert r["n"] == cases[r["s"]], r
        whole = cases[r["s"]]
        assert r["w"] == (int(whole) if whole is not None and whole == int(whole) else None)


def test_multiples(spark):
    rows = spark.createDataFrame([(round(i * 0.01, 2),) for i in range(2000)], ["p"])
    assert rows.filter(~num.is_multiple("p", 0.01)).count() == 0
    assert not one(spark, num.is_multiple("p", 0.01), p=1.005)


def test_ids_are_name_based_uuids(spark):
    row = spark.createDataFrame([("café", "ES-MD", "today 3-m", "2026-08-03", "2026-08-09")],
                                ["k", "g", "t", "a", "b"]).select(
        ids.signal_id("k", "g", "t", "a", "b").alias("s"),
        ids.recommendation_id("k", "g").alias("r"),
        ids.rising_id("k", "g", "t", "a", "b").alias("q")).first()
    ns, rising = uuid.UUID(vocab.SIGNAL_NAMESPACE), uuid.UUID(vocab.RISING_NAMESPACE)
    assert row["s"] == str(uuid.uuid5(
        ns, "demand_signal|café|ES-MD|today 3-m|2026-08-03|2026-08-09"))
    assert row["r"] == str(uuid.uuid5(ns, "recommendation|café|ES-MD"))
    assert row["q"] == str(uuid.uuid5(rising, "café|ES-MD|today 3-m|2026-08-03|2026-08-09"))


def test_haversine_and_slug(spark):
    d = one(spark, geo.haversine_km("a", "b", "c", "d"), a=40.0, b=-3.0, c=41.0, d=-3.0)
    assert abs(d - 111.194927) < 1e-5
    assert one(spark, text.slug("n"), n="Príncipe Pío") == "principe-pio"


def test_intents(spark):
    cases = {
        "algo para el dolor de cabeza en Malasaña":
            ("ok", ["dolor de cabeza", "analgésico", "paracetamol", "ibuprofeno"],
             ["pharmacy"], "Malasaña"),
        "cargador usb c": ("ok", ["cargador", "usb c", "charger"], ["electronics"], None),
        "pilas in Puente Nuevo cerca": ("ok", ["pilas", "batteries", "cerca"],
                                        ["hardware", "electronics"], "Puente Nuevo"),
        "dolor dolor de cabeza": ("ok", ["dolor", "analgésico", "dolor de cabeza",
                                         "paracetamol", "ibuprofeno"], ["pharmacy"], None),
        "???": ("incomplete", None, None, None),
        "necesito algo": ("incomplete", None, None, None),
        "": ("ok", [], [], None),
        "abren en madrid": ("ok", ["abren", "madrid"], [], None),
    }
    rows = spark.createDataFrame([(q,) for q in cases], ["raw_query"])
    for r in intent.parse(rows).collect():
        assert (r["status"], r["keywords"], r["category_hints"],
                r["location_text"]) == cases[r["raw_query"]], r
        assert (r["missing_fields"] == ["keywords"]) == (r["status"] == "incomplete")


def test_let_binds_once(spark):
    v = text.let(F.lit(3), lambda x: x * x + x)
    assert one(spark, v) == 12


def test_strip_and_folds_follow_unicode(spark):
    rows = [(" \tCafé\n　",), ("ﬁn ① Ａ ½",), ("हुआ",), ("é ṩ ῼ",), (None,), ("ṩ",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.strip("t").alias("s"), text.fold("t").alias("f"), text.fold_compatible("t").alias("k"),
                    text.keyword_key("t").alias("key")).collect()

    def plain(t, form):
        return "".join(c for c in unicodedata.normalize(form, t.lower()) if not unicodedata.combining(c))
    for (t,), r in zip(rows, got, strict=True):
        if t is None:
            assert list(r) == [None] * 4
            continue
        assert r["s"] == t.strip() and r["key"] == t.strip().lower()
        assert unicodedata.normalize("NFC", r["f"]) == unicodedata.normalize("NFC", plain(t, "NFD"))
        assert r["k"] == plain(t, "NFKD").lower()


def test_padding_of_any_kind_is_one_category(spark):
    from mercata.operators import analytics, filters
    df = spark.createDataFrame([("grocery", 1), ("\tgrocery\n", 5), (" grocery", 1), ("\n", 1)],
                               "category string, qty int")
    assert [tuple(r) for r in analytics.category_mix(df).collect()] == [("grocery", 100.0, 3)]
    assert analytics.stock_out_risk(df).first()["total_count"] == 3
    assert filters.drop_blank(df, "category").count() == 3
