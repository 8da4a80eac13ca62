"""Documents to tables: shops, catalog, contracts and upserts."""

import uuid

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import catalog, contracts, filters, ingest, upsert
from ..plans import shops as shop_plan
from ..session import shared_dir
from ..sources import documents, keyed, tables
from . import views as v
from .registry import half_even_sql, query, sql_list, with_

FETCHED = "2002-01-01T00:00:00Z"

# --- shops from map documents -------------------------------------------------

# One document per nation with its suppliers as elements: every fifth is a way
# with a centre, every seventh has no name, every eleventh no known tag, every
# thirteenth lies outside the city.
_TAGS = [("amenity", "pharmacy"), ("shop", "supermarket"), ("shop", "hardware"),
         ("shop", "computer"), ("shop", "copyshop"), ("shop", "chemist")]


def osm_payloads(spark, sf):
    k = F.col("s_suppkey")
    pair = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("v")) for a, b in _TAGS])
    tag = F.element_at(pair, (k % 6 + 1).cast("int"))
    lat = F.when(k % 13 == 0, F.lit(39.0)).otherwise(
        F.lit(40.2) + (k * 37 % 500).cast("double") / 1000)
    lng = F.lit(-4.0) + (k * 53 % 600).cast("double") / 1000
    way = k % 5 == 0

    def maybe(cond, key, value):
        return F.when(cond, F.create_map(F.lit(key), value)).otherwise(
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    tags = F.map_concat(
        maybe(k % 11 > 0, "x", F.lit("y")),
        F.when(k % 11 > 0, F.create_map(tag["k"], tag["v"])).otherwise(
            F.create_map(F.lit("shop"), F.lit("bakery"))),
        maybe((k % 12 == 0) & (k % 11 > 0) & (tag["k"] == "shop"), "amenity", F.lit("pharmacy")),
        maybe(k % 7 > 0, "name", F.col("s_name")),
        maybe(k % 2 == 0, "addr:street", F.lit("Calle Mayor")),
        maybe(k % 4 == 0, "addr:housenumber", k.cast("string")),
        maybe(k % 3 == 0, "addr:postcode", F.lit("28001")),
        maybe(k % 9 == 0, "addr:city", F.lit("Madrid")))
    element = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), (k + 1).alias("id"),
        F.when(~way, lat).alias("lat"), F.when(~way, lng).alias("lon"),
        F.when(way, F.struct(lat.alias("lat"), lng.alias("lon"))).alias("center"),
        tags.alias("tags"))
    rows = v.table(spark, sf, "supplier")
    return rows.select(F.to_json(F.struct(F.lit(0.6).alias("version"),
                                          F.array(element).alias("elements"))).alias("payload"))


OSM = """v_osm AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'way' ELSE 'node' END AS type,
    CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name,
    CASE WHEN s_suppkey % 11 = 0 THEN [] ELSE list_sort([x FOR x IN list_distinct([
      [1, 2, 3, 4, 5, 1][(s_suppkey % 6 + 1)::INT],
      CASE WHEN s_suppkey % 12 = 0 AND s_suppkey % 6 > 0 THEN 1 END]) IF x IS NOT NULL]) END
      AS kinds,
    CASE WHEN s_suppkey % 13 = 0 THEN 39.0::DOUBLE
      ELSE 40.2::DOUBLE + ((s_suppkey * 37) % 500)::DOUBLE / 1000::DOUBLE END AS lat,
    -4.0::DOUBLE + ((s_suppkey * 53) % 600)::DOUBLE / 1000::DOUBLE AS lng,
    nullif(concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN 'Calle Mayor'
      || CASE WHEN s_suppkey % 4 = 0 THEN ' ' || s_suppkey::VARCHAR ELSE '' END END,
      nullif(concat_ws(' ', CASE WHEN s_suppkey % 3 = 0 THEN '28001' END,
        CASE WHEN s_suppkey % 9 = 0 THEN 'Madrid' END), '')), '') AS address
  FROM supplier),
v_records AS (
  SELECT 'osm:' || type || ':' || (k + 1)::VARCHAR AS shop_id, (k + 1) AS osm_id, name,
    array_to_string([['pharmacy', 'grocery', 'hardware', 'electronics', 'stationery'][x]
      FOR x IN kinds], '|') AS categories, round(lat, 6) AS lat, round(lng, 6) AS lng, address
  FROM v_osm WHERE name IS NOT NULL AND len(kinds) > 0 AND lat BETWEEN 40.2 AND 40.7
    AND lng BETWEEN -4.0 AND -3.4)"""


def records(spark, sf):
    elements = documents.osm_elements(osm_payloads(spark, sf))
    return ingest.shop_records(elements, "overpass_live", FETCHED)


def _plain(rows):
    return rows.select("shop_id", "osm_id", "name",
                       F.array_join("categories", "|").alias("categories"),
                       F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "address")


@query("shop_records", with_(OSM, select="SELECT * FROM v_records"))
def shop_records(spark, sf):
    return _plain(ingest.valid_shops(records(spark, sf)))


def known(spark, sf):
    """Shops stored earlier: those with an address, under an old name, with a
    region."""
    r = records(spark, sf).filter(F.col("address").isNotNull())
    return r.withColumns({"name": F.lit("old name"), "source": F.lit("cache"),
                          "region_id": F.lit("sol")})


@query("new_shops", with_(OSM, select="SELECT shop_id FROM v_records WHERE address IS NULL"))
def new_shops(spark, sf):
    _, fresh = shop_plan.ingest_shops(
        documents.osm_elements(osm_payloads(spark, sf)), known(spark, sf),
        "overpass_live", FETCHED)
    return fresh.select("shop_id")


@query("shop_upsert", with_(OSM, select="""
SELECT shop_id, name, NULL::VARCHAR AS region_id FROM v_records"""))
def shop_upsert(spark, sf):
    """A replaced shop loses the region the new row does not carry."""
    table, _ = shop_plan.ingest_shops(
        documents.osm_elements(osm_payloads(spark, sf)), known(spark, sf),
        "overpass_live", FETCHED)
    return table.select("shop_id", "name", "region_id")


@query("gazetteer_regions", """
SELECT replace(lower(n_name), ' ', '-') AS region_id,
  upper(n_name[1]) || lower(n_name[2:]) AS name,
  round(40.2::DOUBLE + ((n_nationkey * 97) % 500)::DOUBLE / 1000::DOUBLE, 6) AS lat,
  round(-4.0::DOUBLE + ((n_nationkey * 61) % 600)::DOUBLE / 1000::DOUBLE, 6) AS lng
FROM nation""")
def gazetteer_regions(spark, sf):
    """One payload per place, each with a comment key."""
    r = v.regions(spark, sf)
    place = F.to_json(F.create_map("name", F.struct("lat", "lng")))
    payload = F.concat(F.lit('{"_comment":"approximate",'), F.expr("substring(_p, 2)"))
    g = documents.gazetteer(r.withColumn("_p", place).select(payload.alias("payload")))
    rows = ingest.region_records(g, FETCHED)
    return rows.select("region_id", "name", F.round("lat", 6).alias("lat"),
                       F.round("lng", 6).alias("lng"))


# --- catalog --------------------------------------------------------------------

_KINDS = ["groceries", "beauty", "smartphones", "furniture", "motorcycle", "sunglasses",
          "mens-watches", "tablets"]


def dump(spark, sf):
    """Every part as a row of an external product document."""
    k = F.col("p_partkey")
    kind = F.element_at(text.words(_KINDS), (k % 8 + 1).cast("int"))
    reviews = F.transform(F.sequence(F.lit(1), (k % 4).cast("int") + 1),
                          lambda i: F.struct(i.cast("double").alias("rating")))
    product = F.struct(
        k.alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.concat(F.lit(" "), "p_name", F.lit(" by "), "p_brand", F.lit(" ")).alias("description"),
        kind.alias("category"), (F.col("p_retailprice") / 7).alias("price"),
        F.when(k % 3 > 0, F.concat(F.lit("img-"), k.cast("string"))).alias("thumbnail"),
        (F.lit(3.0) + (k % 20).cast("double") / 10).alias("rating"),
        F.array(F.lower("p_type"), F.lit("Oferta")).alias("tags"),
        F.when(k % 4 > 0, F.slice(reviews, 2, 10)).alias("reviews"))
    payload = F.to_json(F.struct(F.array(product).alias("products")))
    rows = v.table(spark, sf, "part").select(k, payload.alias("payload"))
    return documents.product_dump(rows.select("payload")).withColumn("pos", F.col("id"))


_KIND_SQL = f"{sql_list(_KINDS)}[(p_partkey % 8 + 1)::INT]"


def _map_sql(mapping):
    return "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in mapping.items()) + "}"


DUMP = f"""v_dump AS (
  SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, {_KIND_SQL} AS kind,
    p_name || ' by ' || p_brand AS description, p_retailprice / 7 AS price,
    3.0::DOUBLE + (p_partkey % 20)::DOUBLE / 10 AS rating, [lower(p_type), 'oferta'] AS extra,
    p_partkey % 4 AS reviews FROM part)"""


@query("external_entries", with_(DUMP, select=f"""
SELECT category, {_map_sql(vocab.CATEGORY_PREFIX)}[category] || '-' || (1000 + id)::VARCHAR
    AS sku, title AS name, {half_even_sql('price')} AS base_price_eur,
  round(rating, 6) AS rating, reviews AS review_count
FROM (SELECT *, {_map_sql(vocab.CATALOG_CATEGORY)}[kind] AS category FROM v_dump)
WHERE category IS NOT NULL"""))
def external_entries(spark, sf):
    return catalog.external_entries(dump(spark, sf)).select(
        "category", "sku", "name", "base_price_eur", F.round("rating", 6).alias("rating"),
        F.col("review_count").cast("long").alias("review_count"))


def template_payloads(spark, sf):
    """One catalog document per brand and category, with a comment key."""
    p = v.table(spark, sf, "part").withColumn("category", v.category())
    entry = F.struct(
        F.concat(F.lit("T-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")).alias("name"),
        F.col("p_retailprice").alias("base_price_eur"), F.lit("template").alias("source"))
    docs = p.select("category", F.to_json(F.create_map("category", F.array(entry))).alias("_p"))
    return docs.select(F.concat(F.lit('{"_comment":"templates",'),
                                F.expr("substring(_p, 2)")).alias("payload"))


TEMPLATES = f"""v_templates AS (
  SELECT {v.CATEGORY_SQL} AS category, 'T-' || p_partkey::VARCHAR AS sku, p_partkey AS pos,
    p_name || ' ' || p_brand || ' ' || p_size::VARCHAR AS name,
    p_retailprice AS base_price_eur FROM part)"""


def templates(spark, sf):
    rows = documents.catalog_entries(template_payloads(spark, sf))
    return rows.withColumn("pos", F.expr("cast(substring(sku, 3) as bigint)"))


@query("catalog_entries", with_(TEMPLATES, select="""
SELECT category, sku, name, base_price_eur FROM v_templates"""))
def catalog_entries(spark, sf):
    return templates(spark, sf).select("category", "sku", "name", "base_price_eur")


@query("catalog_replace", with_(TEMPLATES, DUMP, select=f"""
SELECT category, 'template' AS source, sku, name, base_price_eur, NULL::DOUBLE AS rating, NULL::BIGINT AS review_count
FROM v_templates WHERE pos % 3 > 0
UNION ALL
SELECT category, 'dummyjson', {_map_sql(vocab.CATEGORY_PREFIX)}[category] || '-' || (1000 + id)::VARCHAR, title,
  {half_even_sql('price')}, round(rating, 6), reviews FROM (
  SELECT *, {_map_sql(vocab.CATALOG_CATEGORY)}[kind] AS category FROM v_dump) WHERE category IS NOT NULL
UNION ALL
SELECT category, NULL, sku, name, base_price_eur, NULL, NULL FROM v_templates WHERE pos % 3 = 0"""))
def catalog_replace(spark, sf):
    """The old external rows go, also when the same are replaced again; rows of another
    source, or of none, stay as they are."""
    fresh = catalog.external_entries(dump(spark, sf))
    old = fresh.withColumns({"name": F.lit("old"), "sku": F.concat("sku", F.lit("-old"))})
    own = templates(spark, sf).withColumn("source", F.when(F.col("pos") % 3 > 0, F.col("source"))).drop("pos")
    first = catalog.replace_source(own.unionByName(old, allowMissingColumns=True), fresh)
    return catalog.replace_source(first, fresh).select(
        "category", "source", "sku", "name", "base_price_eur", F.round("rating", 6).alias("rating"),
        F.col("review_count").cast("long").alias("review_count"))


_TAG_RE = "[A-Za-zÁÉÍÓÚáéíóúñÑ]{4,}"


def _tags_sql(name, category, extra="[]"):
    found = (f"list_concat(list_concat([{category}], "
             f"[lower(w) FOR w IN regexp_extract_all({name}, '{_TAG_RE}')[1:4]]), {extra})")
    return (f"(SELECT [a[i] FOR i IN range(1, len(a) + 1) IF list_position(a, a[i]) = i][1:8] "
            f"FROM (SELECT {found} AS a))")


POOL = f"""v_pool0 AS (
  SELECT category, 0 AS source_order, pos, name, name || '. '
    || {_map_sql(vocab.BLURBS)}[category] AS description, base_price_eur AS base_price,
    {_tags_sql('name', 'category')} AS tags, NULL::VARCHAR AS image_url FROM v_templates),
v_ext AS (
  SELECT * FROM (SELECT *, {_map_sql(vocab.POOL_CATEGORY)}[kind] AS category FROM v_dump)
  WHERE category IS NOT NULL),
v_pool AS (
  SELECT * FROM v_pool0 UNION ALL
  SELECT category, 1, id, title, left(trim(description), 400), greatest(0.5::DOUBLE, price),
    {_tags_sql('title', 'category', 'extra')}, CASE WHEN id % 3 > 0 THEN 'img-' || id::VARCHAR END FROM v_ext e
  WHERE NOT EXISTS (SELECT 1 FROM v_pool0 p WHERE p.category = e.category AND p.name = e.title)
  QUALIFY row_number() OVER (PARTITION BY category, title ORDER BY id) = 1)"""


def pool(spark, sf):
    return catalog.catalog_pool(templates(spark, sf), dump(spark, sf))


@query("catalog_pool", with_(TEMPLATES, DUMP, POOL, select="""
SELECT category, source_order, pos, name, round(base_price, 6) AS base_price,
  array_to_string(tags, '|') AS tags, name || '. ' || description || ' Categoría: '
  || category || '. Etiquetas: ' || array_to_string(tags, ', ') AS embedding_text, image_url FROM v_pool"""))
def catalog_pool(spark, sf):
    return pool(spark, sf).select(
        "category", "source_order", "pos", "name", F.round("base_price", 6).alias("base_price"),
        F.array_join("tags", "|").alias("tags"),
        catalog.embedding_text("name", "description", "category", "tags").alias("embedding_text"), "image_url")


# Brands as the "categories" of the variant step: small enough to be thin.
@query("catalog_variants", with_(f"""v_base AS (
  SELECT p_brand || '/' || p_size::VARCHAR AS category, min(p_partkey) AS pos, p_name AS name,
    arg_min(p_retailprice, p_partkey) AS base_price FROM part GROUP BY 1, 3),
v_size AS (SELECT category, count(*) AS n FROM v_base GROUP BY 1),
v_var AS (
  SELECT b.category, s.i, b.pos, b.name || ' (' || s.suffix || ')' AS name,
    {half_even_sql('b.base_price * s.f')} AS base_price, n,
    row_number() OVER (PARTITION BY b.category ORDER BY s.i, b.pos) AS rn
  FROM v_base b JOIN v_size z ON b.category = z.category AND n < 20,
    (VALUES (0, 'pack 2 unidades', 1.9::DOUBLE), (1, 'formato ahorro', 1.45::DOUBLE),
      (2, 'tamaño viaje', 0.6::DOUBLE), (3, 'edición premium', 1.8::DOUBLE)) s(i, suffix, f))""",
    select="""
SELECT category, name, base_price, false AS variant FROM v_base
UNION ALL SELECT category, name, base_price, true FROM v_var WHERE rn <= 20 - n"""))
def catalog_variants(spark, sf):
    p = v.table(spark, sf, "part")
    group = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    base = p.groupBy(group.alias("category"), F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("pos"),
        F.min_by("p_retailprice", "p_partkey").alias("base_price"))
    rows = catalog.widen(base.withColumn("source_order", F.lit(0)), minimum=20)
    return rows.select("category", "name", "base_price", "variant")


@query("missing_skus", with_(v.SHOPS, v.INVENTORY, select=f"""
SELECT s.shop_id, p_partkey AS sku, p_name AS name
FROM v_shops s JOIN part ON {v.CATEGORY_SQL} = s.categories[1]
WHERE s.shop_id IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate::DATE >= (
    SELECT max(l_shipdate)::DATE - 30 FROM lineitem))
  AND NOT EXISTS (SELECT 1 FROM v_inventory i WHERE i.shop_id = s.shop_id
    AND i.sku = p_partkey)"""))
def missing_skus(spark, sf):
    """For the shops that sold something in the newest month."""
    day = F.col("l_shipdate").cast("date")
    lines = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shop_id"), day.alias("day"))
    newest = lines.agg(F.max("day")).scalar()
    asked = lines.filter(F.col("day") >= F.date_sub(newest, 30)).select("shop_id").distinct()
    parts = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"),
        v.category().alias("category"))
    return catalog.missing_skus(asked, v.shops(spark, sf), v.inventory(spark, sf), parts).select(
        "shop_id", "sku", "name")


# --- upserts and contracts --------------------------------------------------------

@query("inventory_upsert", with_("""v_side AS (
  SELECT l_suppkey AS shop_id, l_partkey AS sku, l_linestatus AS side,
    max(l_extendedprice) AS price, sum(l_quantity)::INT % 13 AS qty
  FROM lineitem GROUP BY 1, 2, 3),
v_old AS (SELECT * FROM v_side WHERE side = 'F'),
v_new AS (SELECT * FROM v_side WHERE side = 'O')""", select="""
SELECT coalesce(n.shop_id, o.shop_id) AS shop_id, coalesce(n.sku, o.sku) AS sku,
  coalesce(n.price, o.price) AS price, coalesce(n.qty, o.qty) AS qty,
  CASE WHEN n.price > 50000 THEN 'dummyjson' WHEN o.sku IS NOT NULL THEN 'stored'
    ELSE 'template' END AS source,
  CASE WHEN o.sku IS NOT NULL THEN 4.5 END::DOUBLE AS rating
FROM v_old o FULL JOIN v_new n ON o.shop_id = n.shop_id AND o.sku = n.sku"""))
def inventory_upsert(spark, sf):
    """Finished lines are stored, open ones come in; dear ones carry a source. The table is
    written, upserted and read back."""
    def side(status):
        rows = v.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status)
        return rows.groupBy(F.col("l_suppkey").alias("shop_id"),
                            F.col("l_partkey").alias("sku")).agg(
            F.max("l_extendedprice").alias("price"),
            (F.sum("l_quantity").cast("int") % 13).alias("qty"))
    stored = side("F").withColumns({"source": F.lit("stored"), "rating": F.lit(4.5)})
    incoming = side("O").withColumns({
        "source": F.lit("dummyjson"),
        "carries": F.when(F.col("price") > 50000, F.array(F.lit("source")))
        .otherwise(F.array().cast("array<string>"))})
    keys, path = ["shop_id", "sku"], shared_dir(spark, f"inventory-{uuid.uuid4().hex}")
    keyed.create(stored, path, keys, parts=8)

    def merge(old, new):
        return upsert.merge_upsert(old, new, keys, ["source", "rating"], {"source": "template"})
    keyed.upsert(incoming, path, keys, merge, stored.schema, parts=8)
    return keyed.read(spark, path, stored.schema).drop(keyed.PART)


CHECKED = """v_checked AS (
  SELECT shop_id, sku, concat_ws('; ',
    CASE WHEN NOT regexp_matches(sku_code, '^[A-Z]{3}-[0-9]{4}$') THEN 'sku: pattern' END,
    CASE WHEN abs(p / 0.01 - rint) > 1e-9 * greatest(abs(p / 0.01), abs(rint), 1)
      THEN 'price: not a multiple of 0.01' END,
    CASE WHEN q < 0 THEN 'qty: below 0' END) AS violations
  FROM (SELECT *, round_even(p / 0.01, 0) AS rint FROM (
    SELECT shop_id, sku, 'PHA-' || lpad(sku::VARCHAR, CASE WHEN sku % 17 = 0 THEN 3 ELSE 4 END,
        '0') AS sku_code, CASE WHEN sku % 19 = 0 THEN price / 3 ELSE price END AS p,
      CASE WHEN sku % 23 = 0 THEN qty - 5 ELSE qty END AS q FROM v_inventory)))"""


def published(spark, sf):
    """Inventory under its contract form; some SKUs, prices and stocks are off."""
    i, k = v.inventory(spark, sf), F.col("sku")
    code = F.concat(F.lit("PHA-"), F.when(k % 17 == 0, F.lpad(k.cast("string"), 3, "0"))
                    .otherwise(F.lpad(k.cast("string"), 4, "0")))
    return i.select(
        F.col("shop_id").alias("shop"), k.alias("part"),
        F.concat(F.lit("osm:node:"), F.col("shop_id").cast("string")).alias("shop_id"),
        code.alias("sku"), "name", "category",
        F.when(k % 19 == 0, F.col("price") / 3).otherwise(F.col("price")).alias("price"),
        "currency", F.when(k % 23 == 0, F.col("qty") - 5).otherwise(F.col("qty")).alias("qty"),
        F.lit(True).alias("synthetic"), F.lit("template").alias("source"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("review_count"), F.lit(FETCHED).alias("updated_at"))


@query("contract_violations", with_(v.INVENTORY, CHECKED, select="""
SELECT shop_id AS shop, sku AS part, violations FROM v_checked WHERE violations <> ''"""))
def contract_violations(spark, sf):
    bad = contracts.quarantined(published(spark, sf), contracts.inventory())
    return bad.select("shop", "part", F.array_join("violations", "; ").alias("violations"))


@query("contract_report", with_(v.INVENTORY, CHECKED, select="""
SELECT rule, rows FROM (
  SELECT 'rows' AS rule, count(*) AS rows FROM v_checked UNION ALL
  SELECT 'valid', count(*) FROM v_checked WHERE violations = '' UNION ALL
  SELECT 'quarantined', count(*) FROM v_checked WHERE violations <> '')
UNION ALL SELECT rule, count(*) FROM (
  SELECT unnest(string_split(violations, '; ')) AS rule FROM v_checked WHERE violations <> '') GROUP BY rule"""))
def contract_report(spark, sf):
    """Counted while the rows are written: all, valid, quarantined, and each broken rule."""
    report = contracts.store_checked(published(spark, sf), contracts.inventory(), shared_dir(spark, f"checked-{uuid.uuid4().hex}"))
    return report.filter((F.col("rows") > 0) | F.col("rule").isin("rows", "valid", "quarantined"))


@query("cached_shops", with_(v.SHOPS, select="""
SELECT 'osm:node:' || shop_id::VARCHAR AS shop_id, shop_id AS osm_id, name, array_to_string(categories, '|') AS categories,
  round(lat, 6) AS lat, round(lng, 6) AS lng, address, 'cache' AS source FROM v_shops"""))
def cached_shops(spark, sf):
    """Written as a snapshot and read back: every row is relabelled."""
    path = shared_dir(spark, f"cache-{uuid.uuid4().hex}")
    rows = v.shops(spark, sf).select(
        F.concat(F.lit("osm:node:"), F.col("shop_id").cast("string")).alias("shop_id"), F.col("shop_id").alias("osm_id"),
        "name", "categories", "lat", "lng", "address", F.lit("overpass_live").alias("source"), F.lit(FETCHED).alias("fetched_at"))
    documents.write_shop_cache(rows, path)
    return documents.read_shop_cache(spark, path).select(
        "shop_id", "osm_id", "name", F.array_join("categories", "|").alias("categories"),
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "address", "source")


@query("refreshed_stock", with_(v.INVENTORY, select="SELECT shop_id, sku, name, price, qty FROM v_inventory WHERE qty > 0"))
def refreshed_stock(spark, sf):
    """A table replaced whole, twice; readers see the last finished version."""
    path = shared_dir(spark, f"stock-{uuid.uuid4().hex}")
    rows = v.inventory(spark, sf).select("shop_id", "sku", "name", "price", "qty")
    tables.refresh(spark, rows, path)
    tables.refresh(spark, filters.in_stock(tables.read_current(spark, path)), path)
    return tables.read_current(spark, path)


@query("event_log", with_(v.EVENTS, select="""
SELECT type, shop_id, sku, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS ts, CASE WHEN type = 'sale' THEN -delta END::BIGINT AS sold,
  CASE WHEN type = 'restock' THEN delta END::BIGINT AS added FROM v_events"""))
def event_log(spark, sf):
    """Events appended to the log in two parts and read back."""
    path = shared_dir(spark, f"log-{uuid.uuid4().hex}")
    e = v.events(spark, sf)
    rows = e.select("type", "shop_id", F.lit("shop").alias("shop"), "sku", F.lit("item").alias("name"),
                    F.lit(0).cast("long").alias("qty_now"), F.when(F.col("type") == "sale", -F.col("delta")).alias("sold"),
                    F.when(F.col("type") == "restock", F.col("delta")).alias("added"),
                    (F.unix_millis("ts") / 1000).alias("ts"), (F.col("event_id") % 2).alias("part"))
    for part in (0, 1):
        tables.append_events(rows.filter(F.col("part") == part).drop("part"), path)
    return tables.read_event_log(spark, path).select("type", "shop_id", "sku", "ts", "sold", "added")


@query("valid_inventory", with_(v.INVENTORY, CHECKED, select="""
SELECT shop_id AS shop, count(*) AS items FROM v_checked WHERE violations = '' GROUP BY 1"""))
def valid_inventory(spark, sf):
    good = contracts.valid_rows(published(spark, sf), contracts.inventory())
    return good.groupBy("shop").agg(F.count(F.lit(1)).alias("items"))


@query("readable_stock", """
SELECT count(*) AS rows, count(n) AS numbers, count(w) AS whole, sum(w)::BIGINT AS total FROM (
  SELECT CASE WHEN x NOT IN ('true', 'N/A', 'NaN') THEN x::DOUBLE END AS n,
    CASE WHEN x NOT IN ('true', 'N/A', 'NaN') AND x::DOUBLE = floor(x::DOUBLE)
      THEN x::DOUBLE::BIGINT END AS w FROM (
    SELECT CASE l_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'N/A' WHEN 2 THEN 'NaN'
      WHEN 3 THEN l_discount::VARCHAR ELSE l_quantity::VARCHAR END AS x FROM lineitem))""")
def readable_stock(spark, sf):
    from ..functions import num
    k = F.col("l_orderkey") % 7
    x = (F.when(k == 0, "true").when(k == 1, "N/A").when(k == 2, "NaN")
         .when(k == 3, F.col("l_discount").cast("string"))
         .otherwise(F.col("l_quantity").cast("string")))
    rows = v.table(spark, sf, "lineitem").select(x.alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(num.number("x")).alias("numbers"),
                    F.count(num.whole_number("x")).alias("whole"),
                    F.sum(num.whole_number("x")).alias("total"))


@query("named_parts", """
SELECT p_partkey, p_name FROM part WHERE p_retailprice >= 910 AND p_brand <> 'Brand#3'""")
def named_parts(spark, sf):
    """Blank and null names are dropped; columns are named on read."""
    v.table(spark, sf, "part")
    rows = tables.read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_brand",
                                                             "p_retailprice"])
    name = F.when(F.col("p_retailprice") < 910, "  ").when(
        F.col("p_brand") != "Brand#3", F.col("p_name"))
    return filters.drop_blank(rows.withColumn("p_name", name), "p_name").select(
        "p_partkey", "p_name")
