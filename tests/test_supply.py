import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mercata.functions import geo, vocab
from mercata.operators import (catalog, contracts, filters, ingest, listing, matching, places,
                               stock, upsert)
from mercata.plans import search
from mercata.sources import documents, geojson, tables


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = (math.sin(math.radians(c - a) / 2) ** 2
         + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2)
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("crowded", [2000, 3])
@pytest.mark.parametrize("radius,lat,lng", [(2.0, 40.4, -3.7), (150.0, 0.0, 179.9),
                                            (300.0, 89.0, 20.0), (50.0, -60.0, -179.99)])
def test_radius_join_equals_brute_force(spark, radius, lat, lng, crowded):
    rng = random.Random(radius)
    spread = radius / 111 * 3

    def place():
        y = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
        x = lng + rng.uniform(-spread, spread) / max(0.05, math.cos(math.radians(y)))
        return y, (x + 180) % 360 - 180
    shops = [(i, *place()) for i in range(150)]
    centres = [(i, *place()) for i in range(60)]
    met = places.radius_join(spark.createDataFrame(centres, ["qid", "lat", "lng"]),
                             spark.createDataFrame(shops, ["shop_id", "lat", "lng"]), radius, crowded=crowded)
    got = [(r["qid"], r["shop_id"]) for r in met.collect()]
    want = {(q, s) for q, a, b in centres for s, c, d in shops if km(a, b, c, d) <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_region(spark):
    shops = spark.createDataFrame([(1, 40.0, -3.0), (2, 40.01, -3.0), (3, 41.0, -3.0)],
                                  ["shop_id", "lat", "lng"])
    regions = spark.createDataFrame([("z", "B", 40.0, -3.0), ("y", "A", 40.0, -3.0)],
                                    ["region_id", "name", "lat", "lng"])
    got = places.nearest_region(shops, regions)
    assert {r["shop_id"]: r["region_id"] for r in got.collect()} == {1: "y", 2: "y", 3: None}
    assert places.assignment_totals(got).first() == (2, 1)


def test_centres(spark):
    s = spark.createDataFrame(
        [(1, 1.0, 2.0, "Sol"), (2, None, None, " SÓL"), (3, None, None, "Narnia"),
         (4, None, None, None)], "qid int, lat double, lng double, location_text string")
    g = spark.createDataFrame([("sol", 40.0, -3.0)], ["name", "lat", "lng"])
    got = {r["qid"]: (r["lat"], r["resolved_from"], r["centre_status"])
           for r in places.resolve_centres(s, g).collect()}
    assert got == {1: (1.0, "coordinates", "ok"), 2: (40.0, "gazetteer", "ok"),
                   3: (None, None, "incomplete"), 4: (40.4168, "default_center", "ok")}


SHOPS = [("osm:node:1", 40.4168, -3.7038, ["grocery"], "Uno"),
         ("osm:node:2", 40.4170, -3.7040, ["pharmacy", "grocery"], "Dos"),
         ("osm:node:3", 40.4300, -3.7038, ["grocery"], "Tres"),
         ("osm:node:4", 41.5, -3.7038, ["grocery"], "Lejos")]
STOCK = [("osm:node:1", "A", "leche entera", "grocery", 1.2, 3),
         ("osm:node:1", "B", "milk leche", "grocery", 0.9, 1),
         ("osm:node:1", "C", "leche rota", "grocery", 0.1, 0),
         ("osm:node:2", "D", "lechera", "grocery", 0.5, 9),
         ("osm:node:3", "E", "Leche!", "grocery", 2.0, 4),
         ("osm:node:4", "F", "leche", "grocery", 0.2, 4)]


def run_search(spark, queries):
    shops = spark.createDataFrame(SHOPS, ["shop_id", "lat", "lng", "categories", "name"])
    inv = spark.createDataFrame(STOCK, "shop_id string, sku string, name string, "
                                "category string, price double, qty int")
    q = spark.createDataFrame(queries, "qid int, raw_query string, lat double, lng double")
    places_ = spark.createDataFrame([("sol", 40.4168, -3.7038)], ["name", "lat", "lng"])
    return search.search(q, shops.withColumn("address", F.lit(None).cast("string")),
                         inv.withColumn("currency", F.lit("EUR")), places_)


def test_search_ranks_near_shops_with_stock(spark):
    run = run_search(spark, [(1, "leche en Sol", None, None), (2, "leche", None, None),
                             (3, "necesito", None, None), (4, "pan en Narnia", None, None),
                             (5, "azafrán", None, None), (6, "leche", 41.5, -3.7)])
    got = {}
    for r in run.results.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["shop_name"], r["sku"], r["total_qty"],
                                             r["item_count"]))
    near = [("Uno", "B", 4, 2), ("Tres", "E", 4, 1)]
    assert got == {1: near, 2: near, 6: [("Lejos", "F", 4, 1)]}
    errors = {r["qid"]: r["missing_fields"] for r in run.errors.collect()}
    assert errors == {3: ["keywords"], 4: ["query_location"]}
    notes = search.notifications(run).filter("qid = 1").orderBy("shop_id", "price").collect()
    assert [r["sku"] for r in notes] == ["B", "A", "E"]


def test_walking_distance_is_reported_but_not_tested(spark):
    shops = spark.createDataFrame(SHOPS, ["shop_id", "lat", "lng", "categories", "name"])
    s = spark.createDataFrame([("w", ["x"], [], 40.4168, -3.7038)],
                              "want_id string, keywords array<string>, category_hints array<string>, "
                              "lat double, lng double")
    stock = shops.select("shop_id", F.lit("1").alias("sku"), F.lit("x").alias("name"),
                         F.lit("").alias("category"), F.lit(1.0).alias("price"), F.lit(1).alias("qty"))
    walk = spark.createDataFrame([(40.4168, -3.7038, "osm:node:3", 9.5)],
                                 ["lat", "lng", "shop_id", "walking_km"])
    got = {r["shop_id"]: (r["distance_type"], r["distance_km"])
           for r in matching.matched_shops(s, shops, stock, 2.0, walk).collect()}
    assert got["osm:node:3"] == ("walking", 9.5)
    assert got["osm:node:1"] == ("haversine", 0.0) and len(got) == 3


def test_accented_and_multiword_keywords_never_match(spark):
    df = spark.createDataFrame([("Café molido", "grocery")], ["name", "category"])

    def hit(words, **kw):
        k = F.array(*[F.lit(w) for w in words])
        return df.filter(filters.whole_word_match(k, "name", "category", **kw)).count() == 1
    assert hit(["MOLIDO"]) and hit(["grocery"])
    assert not hit(["café"]) and not hit(["café molido"]) and not hit(["mol"])
    assert hit(["café"], fold=True)


def test_sort_modes(spark):
    r = spark.createDataFrame([(1, 1, 5.0, 0.1), (1, 2, 3.0, 0.2), (1, 3, 5.0, 0.2)],
                              ["qid", "rank", "price", "distance_km"])

    def order(by):
        return [x["rank"] for x in matching.sort_results(r, by).collect()]
    assert order("relevance") == [1, 2, 3] and order("price_asc") == [2, 1, 3]
    assert order("price_desc") == [1, 3, 2] and order("distance") == [1, 2, 3]


def test_map_documents_are_json(spark):
    run = run_search(spark, [(1, "leche", None, None), (2, "azafrán", None, None)])
    lines = geojson.documents(run.results, run.searches.withColumn(
        "generated_at", F.lit("now")), 2.0)
    docs = {}
    for r in lines.orderBy("qid", "line").collect():
        docs[r["qid"]] = docs.get(r["qid"], "") + r["text"]
    one, two = json.loads(docs[1]), json.loads(docs[2])
    assert one["metadata"]["result_count"] == len(one["features"]) == 2
    assert one["features"][0]["geometry"]["coordinates"] == [-3.7038, 40.4168]
    assert one["features"][0]["properties"]["address"] is None
    assert two["features"] == [] and two["metadata"]["result_count"] == 0


def test_pages_partition_the_rows(spark):
    rows = [(s, k) for s in range(5) for k in range(random.Random(s).randint(1, 30))]
    df = spark.createDataFrame(rows, ["shop_id", "sku"]).repartition(6)
    total = listing.page_totals(df, 7).first()
    seen = []
    for n in range(1, total["total_pages"] + 1):
        seen += [tuple(r) for r in listing.page(df, ["shop_id", "sku"], n, 7).collect()]
    assert seen == sorted(rows) and total["total_items"] == len(rows)
    last, walked = [-1, -1], []
    while batch := [tuple(r) for r in
                    listing.page_after(df, ["shop_id", "sku"], last, 20).collect()]:
        walked += batch
        last = list(batch[-1])
    assert walked == sorted(rows)
    assert listing.page_totals(df.limit(0), 7).first() == (0, 0)


def brute_levels(events, opening):
    level, out = dict(opening), {}
    for shop, sku, ts, i, kind, delta in sorted(events, key=lambda e: (e[2], e[3])):
        k = (shop, sku)
        if kind != "new_item" and k not in level:
            continue
        level[k] = delta if kind == "new_item" else max(0, level.get(k, 0) + delta)
        out[i] = level[k]
    return out, level


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_running_levels_equal_the_step_by_step_clamp(spark, bucket):
    rng = random.Random(bucket)
    events, start = [], dt.datetime(2024, 1, 1)
    for i in range(3000):
        key = ("s1", "hot") if rng.random() < 0.4 else (f"s{rng.randint(1, 4)}", "x")
        kind = rng.choices(["sale", "restock", "new_item"], [6, 3, 0.4])[0]
        delta = {"sale": -rng.randint(1, 5), "restock": rng.randint(5, 9),
                 "new_item": rng.randint(0, 9)}[kind]
        events.append((*key, start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 40)), i,
                       kind, delta))
    opening = {("s1", "hot"): 7, ("s9", "x"): 3}
    df = spark.createDataFrame(events, "shop_id string, sku string, ts timestamp, event_id long, "
                               "type string, delta long")
    held = spark.createDataFrame([(*k, q) for k, q in opening.items()], ["shop_id", "sku", "qty"])
    want, closing = brute_levels(events, opening)
    got = {r["event_id"]: r["qty_now"]
           for r in stock.running_levels(df, held, bucket).collect()}
    assert got == want
    ends = {(r["shop_id"], r["sku"]): r["qty"]
            for r in stock.closing_levels(df, held, bucket).collect()}
    assert ends == {k: v for k, v in closing.items() if k != ("s9", "x")}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "r1"), ("b", 2, "r2")], ["shop_id", "v", "region_id"])
    new = spark.createDataFrame([("b", 9, 1), ("b", 8, 2), ("c", 3, 1)], ["shop_id", "v", "at"])
    got = upsert.replace_upsert(old, new, ["shop_id"], order="at")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", 1, "r1"), ("b", 8, None), ("c", 3, None)]
    again = upsert.replace_upsert(got, new, ["shop_id"], order="at")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))

    stored = spark.createDataFrame([("a", 5, "x", 4.0), ("b", 6, "y", 3.0)],
                                   "sku string, qty int, source string, rating double")
    inc = spark.createDataFrame([("b", 1, "z", ["source"]), ("c", 2, "w", [])],
                                "sku string, qty int, source string, carries array<string>")
    rows = upsert.merge_upsert(stored, inc, ["sku"], ["source", "rating"],
                               {"source": "template"}).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a", 5, "x", 4.0), ("b", 1, "z", 3.0), ("c", 2, "template", None)]


def test_contracts(spark):
    schema = ("shop_id string, sku string, name string, category string, price double, "
              "currency string, qty int, synthetic boolean, source string, rating double, "
              "review_count int, updated_at string")
    good = ("osm:way:1", "GRO-0001", "x", "grocery", 4.69, "EUR", 0, True, None, None, None, "t")
    bad = ("way:1", "GRO-1", "", "toys", 4.695, None, -1, False, "y", 6.0, -2, None)
    df = spark.createDataFrame([good, bad], schema)
    assert contracts.valid_rows(df, contracts.inventory()).count() == 1
    wrong = contracts.quarantined(df, contracts.inventory()).first()["violations"]
    assert len(wrong) == 12
    with pytest.raises(Exception, match="not a multiple"):
        contracts.enforce(df, contracts.inventory()).collect()
    assert contracts.enforce(df.limit(1), contracts.inventory()).count() == 1
    intents = spark.createDataFrame(
        [("ok", "q", ["a"], [], None), ("ok", "q", ["a", "a"], [], None),
         ("ok", "q", ["a"], ["toys"], None), ("incomplete", "q", None, None, ["keywords"]),
         ("incomplete", "q", ["a"], None, ["keywords"]), ("ok", "q", ["a"], [], ["x"])],
        "status string, raw_query string, keywords array<string>, "
        "category_hints array<string>, missing_fields array<string>")
    ok = contracts.check(intents, contracts.intent()).collect()
    assert [len(r["violations"]) for r in ok] == [0, 1, 1, 0, 1, 1]


def test_map_documents_to_shops(spark, tmp_path):
    doc = {"version": 0.6, "elements": [
        {"type": "node", "id": 1, "lat": 40.4, "lon": -3.7, "tags": {
            "name": "Farmacia", "amenity": "pharmacy", "shop": "supermarket",
            "addr:street": "Mayor", "addr:housenumber": "3", "addr:city": "Madrid"}},
        {"type": "way", "id": 2, "center": {"lat": 40.5, "lon": -3.6},
         "tags": {"name": "Super", "shop": "convenience", "addr:postcode": "28001"}},
        {"type": "node", "id": 3, "lat": 40.4, "lon": -3.7, "tags": {"shop": "hardware"}},
        {"type": "node", "id": 4, "lat": 40.4, "lon": -3.7, "tags": {"name": "Bar"}},
        {"type": "node", "id": 5, "lat": 48.0, "lon": -3.7,
         "tags": {"name": "Lejos", "shop": "hardware"}}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    want = [("osm:node:1", ["pharmacy", "grocery"], "Mayor 3, Madrid"),
            ("osm:way:2", ["grocery"], "28001")]
    for elements in (documents.read_osm(spark, str(tmp_path / "doc.json")),
                     documents.osm_elements(documents.read_texts(spark, str(tmp_path)))):
        rows = ingest.valid_shops(ingest.shop_records(elements, "overpass_live", "t"))
        got = [(r["shop_id"], r["categories"], r["address"])
               for r in rows.orderBy("shop_id").collect()]
        assert got == want
    out = str(tmp_path / "cache")
    documents.write_shop_cache(rows, out)
    array = tmp_path / "array.json"
    array.write_text(json.dumps([r.asDict() for r in rows.collect()], indent=2))
    for back in (documents.read_shop_cache(spark, out),
                 documents.read_shop_cache(spark, str(array), one_document=True)):
        assert {r["source"] for r in back.collect()} == {"cache"} and back.count() == 2


def test_catalog_documents(spark):
    cat = json.dumps({"_comment": "x", "grocery": [
        {"sku": "GRO-0001", "name": "Pan de molde", "base_price_eur": 2.0}],
        "pharmacy": [{"sku": "PHA-0001", "name": "Jarabe", "base_price_eur": 5.0}]})
    entries = documents.catalog_entries(spark.createDataFrame([(cat,)], ["payload"]))
    assert sorted((r["category"], r["pos"], r["sku"]) for r in entries.collect()) == [
        ("grocery", 0, "GRO-0001"), ("pharmacy", 0, "PHA-0001")]
    items = [{"id": 7, "title": "Pan de molde", "category": "groceries", "price": 1.0},
             {"id": 8, "title": "Sofá", "category": "furniture", "price": 99.999,
              "rating": 4.0, "reviews": [{"rating": 1}, {"rating": 2}], "tags": ["Casa", "sofá"]},
             {"id": 9, "title": "Sofá", "category": "furniture", "price": 1.0},
             {"id": 10, "title": "Gafas", "category": "sunglasses", "price": 1.0}]
    for payload in (json.dumps({"products": items}), json.dumps(items)):
        dump = documents.product_dump(spark.createDataFrame([(payload,)], ["payload"]))
        fresh = catalog.external_entries(dump).orderBy("sku").collect()
        assert [(r["sku"], r["base_price_eur"], r["review_count"]) for r in fresh] == [
            ("GRO-1007", 1.0, 0), ("HRD-1008", 100.0, 2), ("HRD-1009", 1.0, 0)]
        pool = catalog.catalog_pool(entries, dump)
        got = {(r["category"], r["name"]): r for r in pool.collect()}
        assert len(got) == pool.count() == 3
        assert got[("hardware", "Sofá")]["tags"] == ["hardware", "sofá", "casa"]
        assert got[("grocery", "Pan de molde")]["base_price"] == 2.0
    wide = catalog.widen(pool)
    sizes = {r["category"]: r["count"] for r in wide.groupBy("category").count().collect()}
    assert sizes == {"grocery": 5, "pharmacy": 5, "hardware": 5}
    some = catalog.widen(pool, minimum=3).filter("category = 'pharmacy' and variant")
    assert sorted((r["name"], r["base_price"]) for r in some.collect()) == [
        ("Jarabe (formato ahorro)", 7.25), ("Jarabe (pack 2 unidades)", 9.5)]


def test_gazetteer_and_barrios(spark):
    doc = '{"_comment":"x","puerta del sol":{"lat":40.4168,"lng":-3.7038}}'
    g = documents.gazetteer(spark.createDataFrame([(doc,)], ["payload"]))
    r = ingest.region_records(g, "2024-01-01T00:00:00Z").first()
    assert (r["region_id"], r["name"], r["lat"]) == ("puerta-del-sol", "Puerta Del Sol", 40.4168)
    texts = ["malasana", "por CHAMBERÍ o Sol", "cerca de Sol", "Vigo", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["b"] for r in rows.select(places.match_barrio("t").alias("b")).collect()]
    assert got == ["Malasaña", "Chamberí", "Sol", None, None]
    assert len(vocab.BARRIOS) == 24


def test_refresh_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError):
        tables.read_current(spark, path)
    tables.refresh(spark, spark.range(3), path)
    broken = spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop")))
                                   .otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        tables.refresh(spark, broken, path)
    assert tables.read_current(spark, path).count() == 3
    tables.refresh(spark, spark.range(4), path)
    assert tables.read_current(spark, path).count() == 4


def test_inbox_and_log(spark, tmp_path):
    run = run_search(spark, [(1, "leche", None, None), (2, "leche", 40.43, -3.70)])
    notes = search.notifications(run)
    tables.write_inbox(notes, str(tmp_path / "inbox"))
    tables.write_inbox(notes, str(tmp_path / "inbox"))
    assert spark.read.json(str(tmp_path / "inbox")).count() == 2 * notes.count()
    e = spark.createDataFrame([("sale", "s", "S", "k", "n", 1, 2, None, 1.0)],
                              "type string, shop_id string, shop string, sku string, name string, "
                              "qty_now bigint, sold bigint, added bigint, ts double")
    for _ in range(2):
        tables.append_events(e, str(tmp_path / "log"))
    assert tables.read_event_log(spark, str(tmp_path / "log")).count() == 2


def test_documents_are_written_in_line_order(spark, tmp_path):
    run = run_search(spark, [(1, "leche", None, None), (2, "azafrán", None, None)])
    lines = geojson.documents(run.results, run.searches.withColumn(
        "generated_at", F.lit("now")), 2.0).orderBy(F.col("line").desc())
    geojson.write_documents(lines, str(tmp_path / "maps"))
    for qid, n in ((1, 2), (2, 0)):
        parts = list((tmp_path / "maps" / f"qid={qid}").glob("part-*"))
        assert len(parts) == 1
        assert len(json.loads(parts[0].read_text())["features"]) == n


def test_documents_in_buckets(spark, tmp_path):
    run = run_search(spark, [(i, "leche" if i % 2 else "azafrán", None, None) for i in range(12)])
    lines = geojson.documents(run.results, run.searches.withColumn("generated_at", F.lit("now")), 2.0)
    geojson.write_documents(lines.orderBy(F.col("line").desc()), str(tmp_path / "maps"), buckets=3)
    assert len(list((tmp_path / "maps").glob("bucket=*"))) <= 3
    for qid in range(12):
        text = "".join(r["text"] for r in geojson.read_document(spark, str(tmp_path / "maps"), qid, 3).collect())
        assert len(json.loads(text)["features"]) == (2 if qid % 2 else 0)
    assert geojson.read_document(spark, str(tmp_path / "maps"), 99, 3).count() == 0


def test_a_document_with_a_gap_is_held_back(spark):
    run = run_search(spark, [(1, "leche", None, None), (2, "azafrán", None, None)])
    searches = run.searches.withColumn("generated_at", F.lit("now"))
    holed = run.results.withColumn("price", F.when(F.col("rank") != 2, F.col("price")))
    assert [tuple(r) for r in geojson.gaps(holed).collect()] == [(1, 1, "price")]
    assert {r["qid"] for r in geojson.documents(holed, searches, 2.0).collect()} == {2}
    assert {r["qid"] for r in geojson.documents(run.results, searches, 2.0).collect()} == {1, 2}


def test_the_layer_of_all_shops(spark):
    rows = [("b", 1.0, 2.0, ["grocery", "pharmacy"], "B"), ("a", 3.0, 4.0, ["hardware"], 'A "x"'), ("c", 0.0, 0.0, [], "C")]
    for shops in (rows, rows[2:]):
        df = spark.createDataFrame(shops, "shop_id string, lat double, lng double, categories array<string>, name string")
        doc = json.loads("".join(r["text"] for r in geojson.shop_layer(df).orderBy("line").collect()))
        own = [{"shop_id": i, "shop_name": n, "category": c[0]} for i, _, _, c, n in sorted(shops) if c]
        assert doc["metadata"]["shop_count"] == len(own) and [f["properties"] for f in doc["features"]] == own


def test_centres_by_near_region_and_geocode(spark):
    s = spark.createDataFrame([
        (1, None, None, "sol", "Retiro", None), (2, None, None, "sol", "", None), (3, None, None, "sol", " Mi CALLE ", None),
        (4, None, None, "sol", "Narnia", None), (5, None, None, "narnia", None, "r1"), (6, None, None, None, None, "r9"),
        (7, 1.0, 2.0, None, None, "r1"), (8, None, None, None, "Sol", "r1"), (9, 1.0, None, None, None, None),
        (10, 1.0, 2.0, "Narnia", "Narnia", None), (11, None, None, "sol", None, None)],
        "qid int, lat double, lng double, location_text string, near string, region_id string")
    places_ = spark.createDataFrame([("sol", 40.0, -3.0), ("Retiro", 41.0, -3.0)], ["name", "lat", "lng"])
    cache = spark.createDataFrame([("mi calle", 42.0, -3.0), ("sol", 0.0, 0.0)], ["name", "lat", "lng"])
    regions = spark.createDataFrame([("r1", 43.0, -3.0)], ["region_id", "lat", "lng"])
    got = {r["qid"]: (r["lat"], r["resolved_from"], r["centre_status"])
           for r in places.resolve_centres(s, places_, regions=regions, geocodes=cache).collect()}
    assert got == {
        1: (41.0, "gazetteer", "ok"), 2: (40.4168, "default_center", "ok"), 3: (42.0, "geocode", "ok"),
        4: (None, None, "incomplete"), 5: (43.0, "coordinates", "ok"), 6: (None, None, "unknown_region"),
        7: (None, None, "conflict"), 8: (None, None, "conflict"), 9: (None, None, "conflict"),
        10: (1.0, "coordinates", "ok"), 11: (40.0, "gazetteer", "ok")}


def test_counts_of_a_contract_come_with_the_write(spark, tmp_path):
    rows = [("osm:node:1", 1), ("bad", 2), ("osm:node:2", -1), ("worse", -5)]
    df = spark.createDataFrame(rows, "shop_id string, qty int")
    rules = [contracts.matches("shop_id", contracts.SHOP_ID), contracts.at_least("qty", 0)]
    report = {r["rule"]: r["rows"] for r in contracts.store_checked(df, rules, str(tmp_path / "t")).collect()}
    assert report == {"rows": 4, "valid": 1, "quarantined": 3, "shop_id: pattern": 2, "qty: below 0": 2}
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["shop_id"], r["valid"], len(r["violations"])) for r in stored.collect()} == {
        ("osm:node:1", "true", 0), ("bad", "false", 1), ("osm:node:2", "false", 1), ("worse", "false", 2)}


def test_regions_with_their_shops(spark):
    from mercata.plans import shops as shop_plan
    shops = spark.createDataFrame(SHOPS, ["shop_id", "lat", "lng", "categories", "name"])
    regions = spark.createDataFrame([("sol", "Sol", 40.4168, -3.7038), ("far", "Afar", 10.0, 0.0)],
                                    ["region_id", "name", "lat", "lng"])
    assigned, counted = shop_plan.regions(shops, regions)
    assert [(r["name"], r["shop_count"]) for r in counted.collect()] == [("Afar", 0), ("Sol", 2)]
    assert assigned.filter("region_id is null").count() == 2


def test_a_crowded_cell_is_joined_whole(spark):
    rng = random.Random(4)
    hot = [(i, 40.4 + (rng.uniform(0, 1e-4) if i % 2 else 0), -3.7) for i in range(900)]
    cold = [(900 + i, 40.2 + rng.uniform(0, 0.5), -3.7) for i in range(100)]
    centres = spark.createDataFrame([(i, 40.4, -3.7) for i in range(20)], ["qid", "lat", "lng"])
    shops = spark.createDataFrame(hot + cold, ["shop_id", "lat", "lng"])
    want = 20 * sum(km(40.4, -3.7, a, b) <= 1.0 for _, a, b in hot + cold)
    for crowded in (2000, 40):
        met = places.radius_join(centres, shops, 1.0, crowded=crowded)
        assert met.count() == met.select("qid", "shop_id").distinct().count() == want
    # 90 % of the shops share a cell, half of them a point: no leaf part is much over the mean
    leaf, _ = places.quad_leaves(shops, geo.Grid(1.0), crowded=40)
    part = F.pmod(F.xxhash64("shop_id"), F.col("_parts"))
    sizes = [r["count"] for r in leaf.groupBy("_level", "_nrow", "_ncolumn", part).count().collect()]
    assert max(sizes) <= 2 * 40 and sum(sizes) == 1000


def test_missing_skus_are_left_out_where_the_pairs_are_formed(spark):
    from mercata.operators import catalog
    shops = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["a"])], "shop_id long, categories array<string>")
    stock = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 99)], "shop_id long, sku long")
    parts = spark.createDataFrame([("a", 10, "x"), ("a", 11, "y"), ("a", 12, "z"), ("b", 20, "u"), ("b", 21, "v")],
                                  "category string, sku long, name string")
    rows = catalog.missing_skus(spark.createDataFrame([(1,), (2,), (3,), (4,)], "shop_id long"), shops, stock, parts)
    assert sorted((r["shop_id"], r["sku"]) for r in rows.collect()) == [(1, 12), (2, 21), (3, 10), (3, 11), (3, 12)]
    assert "LeftAnti" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_stock_is_added_up_before_it_meets_the_centres(spark):
    from mercata.operators import matching
    shops = spark.createDataFrame([(1, ["a"], 40.4, -3.7), (2, ["b"], 40.4, -3.69), (3, ["a"], 40.9, -3.7)],
                                  "shop_id long, categories array<string>, lat double, lng double")
    stock = spark.createDataFrame([(1, 10, "red pen", "a", 2.0, 3), (1, 11, "blue pen", "a", 1.0, 4), (2, 12, "pen", "b", 1.0, 1),
                                   (3, 13, "pen", "a", 1.0, 1)], "shop_id long, sku long, name string, category string, price double, qty long")
    asked = matching.with_want(spark.createDataFrame(
        [(i, ["Pen", "red"], ["a"] if i == 4 else [], 40.4, -3.7 + i / 1000) for i in range(5)],
        "qid long, keywords array<string>, category_hints array<string>, lat double, lng double"))
    near = matching.matched_shops(asked, shops, stock, 2.0)
    got = sorted((round(r["lng"], 3), r["shop_id"], r["total_qty"], r["item_count"], r["cheapest"]["sku"]) for r in near.collect())
    assert got == sorted([(round(-3.7 + i / 1000, 3), 1, 7, 2, 11) for i in range(5)]
                         + [(round(-3.7 + i / 1000, 3), 2, 1, 1, 12) for i in range(4)])
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ASIN(") < plan.index("Aggregate")


def test_lists_are_made_once_and_handed_out(spark):
    """Queries that share want and centre share the texts; no list moves a second time."""
    run = run_search(spark, [(i, "leche", None, None) for i in range(40)] + [(99, "pan", 41.5, -3.7)])
    assert run.listed.count() == 2 and run.results.count() == 80
    read = geojson.features(run.listed).select("list_id", "rank", F.sha2("feature", 256).alias("h"))
    out = search.handed_out(run.searches, read)
    assert out.count() == 80 and out.select("h").distinct().count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the text is made below a generator, which is below the join
    assert plan.index("Join") < plan.index("Generate inline") < plan.index("sha2")
    # ranked where it is dealt, met by the queries there
    window = plan.index("Window")
    assert plan[:window].count("Exchange hashpartitioning(list_id") <= 1
    assert "ENSURE_REQUIREMENTS" not in plan[window:plan.index("REPARTITION_BY_NUM")]


def test_an_inbox_holds_the_cheapest_items_of_all_words(spark):
    shops = spark.createDataFrame([(1, ["a"], 40.4, -3.7), (2, ["b"], 40.4, -3.69)],
                                  "shop_id long, categories array<string>, lat double, lng double")
    stock = spark.createDataFrame(
        [(s, 100 * s + i, ["red pen", "red cup", "blue pen", "cup"][i % 4], "a", float((i * 7) % 5), i % 6)
         for s in (1, 2) for i in range(24)],
        "shop_id long, sku long, name string, category string, price double, qty long")
    asked = matching.with_want(spark.createDataFrame(
        [(1, "q", ["Pen", "red"], [], 40.4, -3.7), (2, "q", ["red", "pen"], ["a"], 40.4, -3.7), (3, "q", ["cup"], [], 40.4, -3.7)],
        "qid long, raw_query string, keywords array<string>, category_hints array<string>, lat double, lng double"))
    rows = stock.collect()
    for limit in (3, None):
        got = {(r["qid"], r["shop_id"]): [i["sku"] for i in r["items"]]
               for r in search.inbox(asked, shops, stock, 2.0, limit).collect()}
        want = {}
        for q, words in ((1, {"pen", "red"}), (2, {"pen", "red"}), (3, {"cup"})):
            for s in (1, 2):
                hit = sorted((r["price"], r["sku"]) for r in rows if r["shop_id"] == s and r["qty"] > 0 and words & set(r["name"].split()))
                if q != 2 or s == 1:
                    want[q, s] = [sku for _, sku in hit[:limit]]
        assert got == want


def test_centres_on_one_spot_are_shared_out(spark):
    centres = spark.createDataFrame([(i, 40.4, -3.7) for i in range(300)], "qid long, lat double, lng double")
    shops = spark.createDataFrame([(i, 40.4 + i / 5000, -3.7) for i in range(60)], "shop_id long, lat double, lng double")
    for crowded in (2000, 10):
        met = places.radius_join(centres, shops, 2.0, crowded=crowded, pairs=500)
        assert met.columns.count("distance_km") == 1 and not [c for c in met.columns if c in ("_share", "_shares", "_cell")]
        n = shops.filter((F.col("lat") - 40.4) * F.lit(math.radians(1) * vocab.EARTH_RADIUS_KM) <= 2.0).count()
        assert met.count() == 300 * n == met.select("qid", "shop_id").distinct().count()
        # one spot, several tasks
        assert met.groupBy(F.spark_partition_id()).count().count() > 1


def test_stock_is_summed_in_pieces_by_its_rows(spark, monkeypatch):
    from mercata.workload import views
    sf = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in views.inventory(spark, sf).collect()}
    monkeypatch.setattr(views, "ROWS_TOGETHER", 100)
    pieces = views.inventory(spark, sf)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert f", {n}), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in pieces.collect()} == whole


def test_shops_go_to_the_lists_of_a_cell_together(spark, monkeypatch):
    """Pairs of lists and shops are made where the lists are ranked and handed out."""
    rng = random.Random(8)
    shops = [(f"osm:node:{i}", 40.4 + rng.uniform(0, 0.05), -3.7 + rng.uniform(0, 0.05), ["grocery"], f"S{i}") for i in range(40)]
    items = [(s[0], f"{s[0]}-{i}", "leche pan"[:5 if i % 2 else 9], "grocery", float(rng.randint(1, 3)), i % 3)
             for s in shops for i in range(4)]
    asked = [(i, ["leche", "pan"][i % 2], 40.4 + rng.uniform(0, 0.05), -3.7 + rng.uniform(0, 0.05)) for i in range(30)] * 2
    shop_rows = spark.createDataFrame(shops, ["shop_id", "lat", "lng", "categories", "name"]).withColumn(
        "address", F.lit(None).cast("string"))
    stock = spark.createDataFrame(items, "shop_id string, sku string, name string, category string, price double, qty int")
    queries = spark.createDataFrame([(k, *q[1:]) for k, q in enumerate(asked)], "qid int, raw_query string, lat double, lng double")
    places_ = spark.createDataFrame([("sol", 40.4168, -3.7038)], ["name", "lat", "lng"])
    want = set()
    for k, (_, word, lat, lng) in enumerate(asked):
        rows = []
        for s in shops:
            hit = sorted((i[4], i[1], i[5]) for i in items if i[0] == s[0] and i[5] > 0 and word in i[2].split())
            if hit and km(lat, lng, s[1], s[2]) <= 2.0:
                rows.append((km(lat, lng, s[1], s[2]), -sum(h[2] for h in hit), hit[0][0], s[0], hit[0][1], len(hit)))
        want |= {(k, n + 1, r[3], -r[1], r[4], r[5]) for n, r in enumerate(sorted(rows))}
    for pairs, together in ((1_000_000, 100), (50, 3)):
        monkeypatch.setattr(matching, "PAIRS", pairs)
        monkeypatch.setattr(matching, "SHOPS_TOGETHER", together)
        run = search.search(queries, shop_rows, stock.withColumn("currency", F.lit("EUR")), places_)
        got = [(r["qid"], r["rank"], r["shop_id"], r["total_qty"], r["sku"], r["item_count"]) for r in run.results.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert run.searches.schema["list_id"].metadata["parts"] > 4
    plan = run.results._jdf.queryExecution().executedPlan().toString()
    # neither from the distance to the ranking nor from there to the queries
    above = plan[:plan.index("ASIN(")]
    assert "Window" in above and "Exchange" not in above


def test_centres_do_not_pass_through_the_driver(spark):
    import re
    centres = spark.range(300).select(F.col("id").alias("qid"), F.lit(40.4).alias("lat"), (F.lit(-3.7) + F.col("id") / 9000).alias("lng"))
    shops = spark.createDataFrame([(i, 40.4 + i / 5000, -3.7) for i in range(60)], "shop_id long, lat double, lng double")
    for crowded in (2000, 10):
        met = places.radius_join(centres, shops, 2.0, crowded=crowded)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*Project \[qid", plan)
        points = [(r["lat"], r["lng"]) for r in shops.collect()]
        assert met.count() == sum(km(c["lat"], c["lng"], *p) <= 2.0 for c in centres.collect() for p in points)
