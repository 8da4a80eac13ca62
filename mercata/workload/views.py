"""Test tables in the roles of shops, stock, points, events and queries.

Each view exists twice: as a DataFrame and as a common table expression for
the SQL twin of a query.
"""

from pyspark.sql import functions as F

from ..functions import vocab

TYPE_CATEGORY = {"STANDARD": "pharmacy", "ECONOMY": "grocery", "MEDIUM": "hardware",
                 "PROMO": "electronics", "LARGE": "stationery", "SMALL": "grocery"}
AS_OF = "2001-12-31"
COMPUTED_AT = "2002-01-01T00:00:00Z"
TIMEFRAME = "today 12-m"


def table(spark, sf, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt_out(rows):
    """Rows of a table in fewer files than there are cores, over all cores.

    A file of one row group is one task; text work on it would leave the others idle.
    A table in many files is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def category(c="p_type"):
    out = F.lit(None).cast("string")
    for kind, name in TYPE_CATEGORY.items():
        out = F.when(F.col(c) == kind, name).otherwise(out)
    return out


CATEGORY_SQL = "CASE p_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_CATEGORY.items()) + " END"
_LIST_SQL = "[" + ", ".join(f"'{c}'" for c in vocab.CATEGORIES) + "]"


def shops(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    kinds = F.array(*[F.lit(c) for c in vocab.CATEGORIES])
    k = F.col("s_suppkey")

    def kind(i):
        return F.element_at(kinds, (i % 5 + 1).cast("int"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("shop_id"), F.col("s_name").alias("name"),
        F.when(k % 3 == 0, F.array(kind(k), kind(k + 2))).otherwise(F.array(kind(k)))
        .alias("categories"),
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("neighbourhood"),
        (F.lit(40.2) + (k * 37 % 500).cast("double") / 1000).alias("lat"),
        (F.lit(-4.0) + (k * 53 % 600).cast("double") / 1000).alias("lng"),
        F.when(k % 4 > 0, F.concat(F.lit("Calle "), k.cast("string"))).alias("address"),
        (F.lit(3.6) + (k % 14).cast("double") / 10).alias("rating"))


SHOPS = f"""v_shops AS (
  SELECT s_suppkey AS shop_id, s_name AS name,
    CASE WHEN s_suppkey % 3 = 0 THEN [{_LIST_SQL}[(s_suppkey % 5 + 1)::INT],
         {_LIST_SQL}[((s_suppkey + 2) % 5 + 1)::INT]]
         ELSE [{_LIST_SQL}[(s_suppkey % 5 + 1)::INT]] END AS categories,
    n_nationkey AS nation, n_name AS neighbourhood,
    40.2::DOUBLE + ((s_suppkey * 37) % 500)::DOUBLE / 1000::DOUBLE AS lat,
    -4.0::DOUBLE + ((s_suppkey * 53) % 600)::DOUBLE / 1000::DOUBLE AS lng,
    CASE WHEN s_suppkey % 4 > 0 THEN 'Calle ' || s_suppkey::VARCHAR END AS address,
    3.6::DOUBLE + (s_suppkey % 14)::DOUBLE / 10::DOUBLE AS rating
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


ROWS_TOGETHER = 250_000  # of lineitem in one task


def inventory(spark, sf):
    """Stock is summed to (shop, sku) before it meets the product names.

    Lines are dealt out by part, in pieces by their number, so that what a task sums, joins
    and later sorts does not grow with the table; the join finds them in place.
    """
    lines = table(spark, sf, "lineitem")
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS_TOGETHER))
    lines = lines.select("l_suppkey", "l_partkey", "l_extendedprice", "l_quantity").repartition(pieces, "l_partkey")
    held = lines.groupBy(
        F.col("l_suppkey").alias("shop_id"), F.col("l_partkey").alias("sku")).agg(
        F.max("l_extendedprice").alias("price"),
        (F.sum("l_quantity").cast("int") % 13).alias("qty"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"),
        category().alias("category"))
    return held.join(p, "sku").withColumn("currency", F.lit("EUR"))


INVENTORY = f"""v_inventory AS (
  SELECT l_suppkey AS shop_id, l_partkey AS sku, p_name AS name,
    {CATEGORY_SQL} AS category, max(l_extendedprice) AS price,
    sum(l_quantity)::INT % 13 AS qty, 'EUR' AS currency
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def products(spark, sf):
    """Inventory rows as products of a store."""
    return inventory(spark, sf).select(
        F.col("shop_id").alias("store_id"), F.col("sku").alias("product_id"),
        "name", "category", "price", "qty")


def points(spark, sf):
    """Interest readings: part type per region, two captures of each series."""
    geo = (table(spark, sf, "supplier")
           .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("geo")))
    kind = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.lower(category()).alias("keyword"))
    return (table(spark, sf, "lineitem")
            .select("l_suppkey", "l_partkey", "l_linestatus", "l_shipdate", "l_quantity")
            .join(kind, "l_partkey").join(geo, "l_suppkey").select(
                "keyword", "geo", F.lit(TIMEFRAME).alias("timeframe"),
                F.col("l_linestatus").alias("capture_id"),
                F.when(F.col("l_linestatus") == "O", "2002-01-01T00:00:00Z")
                .otherwise("2001-12-25T00:00:00Z").alias("captured_at"),
                F.col("l_shipdate").cast("date").alias("d"),
                F.col("l_quantity").alias("value")))


POINTS = f"""v_points AS (
  SELECT {CATEGORY_SQL} AS keyword, r_name AS geo, '{TIMEFRAME}' AS timeframe,
    l_linestatus AS capture_id,
    CASE WHEN l_linestatus = 'O' THEN '2002-01-01T00:00:00Z'
         ELSE '2001-12-25T00:00:00Z' END AS captured_at,
    l_shipdate::DATE AS d, l_quantity AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def regions(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("region_id"), F.col("n_name").alias("name"),
        (F.lit(40.2) + (k * 97 % 500).cast("double") / 1000).alias("lat"),
        (F.lit(-4.0) + (k * 61 % 600).cast("double") / 1000).alias("lng"))


REGIONS = """v_regions AS (
  SELECT n_nationkey AS region_id, n_name AS name,
    40.2::DOUBLE + ((n_nationkey * 97) % 500)::DOUBLE / 1000::DOUBLE AS lat,
    -4.0::DOUBLE + ((n_nationkey * 61) % 600)::DOUBLE / 1000::DOUBLE AS lng
  FROM nation)"""


def queries(spark, sf):
    """Every customer's search text: the part of their number, worded by
    segment, with a place, coordinates, both or neither."""
    c = table(spark, sf, "customer")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    text = (F.when(F.col("c_acctbal") < 0, F.lit("necesito algo para"))
            .when(seg == "BUILDING", F.concat(F.lit("necesito "), "p_name",
                                              F.lit(" en "), "n_name"))
            .when(seg == "AUTOMOBILE", F.concat("p_name", F.lit(" en Atlantis")))
            .when(seg == "MACHINERY", F.concat(F.lit("pilas "), "p_name"))
            .when(seg == "HOUSEHOLD", F.concat(F.lit("some "), "p_name",
                                               F.lit(" for fever in "), "n_name"))
            .otherwise(F.col("p_name")))
    located = seg == "FURNITURE"
    lat = F.lit(40.2) + (k * 97 % 500).cast("double") / 1000
    lng = F.lit(-4.0) + (k * 61 % 600).cast("double") / 1000
    return (c.join(p, k == F.col("p_partkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(k.alias("qid"), text.alias("raw_query"),
                    F.when(located, lat).alias("lat"),
                    F.when(located, lng).alias("lng")))


QUERIES = """v_queries AS (
  SELECT c_custkey AS qid,
    CASE WHEN c_acctbal < 0 THEN 'necesito algo para'
         WHEN c_mktsegment = 'BUILDING' THEN 'necesito ' || p_name || ' en ' || n_name
         WHEN c_mktsegment = 'AUTOMOBILE' THEN p_name || ' en Atlantis'
         WHEN c_mktsegment = 'MACHINERY' THEN 'pilas ' || p_name
         WHEN c_mktsegment = 'HOUSEHOLD'
           THEN 'some ' || p_name || ' for fever in ' || n_name
         ELSE p_name END AS raw_query,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN
      40.2::DOUBLE + ((c_custkey * 97) % 500)::DOUBLE / 1000::DOUBLE END AS lat,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN
      -4.0::DOUBLE + ((c_custkey * 61) % 600)::DOUBLE / 1000::DOUBLE END AS lng
  FROM customer JOIN part ON c_custkey = p_partkey
  JOIN nation ON c_nationkey = n_nationkey)"""


def as_movements(df):
    """Stock movements; the log names shops by their full id."""
    i, kind = F.col("event_id"), F.col("event_type")
    sold, added = kind.isin("purchase", "view"), kind.isin("signup", "click")
    delta = F.when(sold, -(1 + i % 5)).when(added, 5 + i % 16).otherwise(8 + i % 18)
    name = F.when(sold, "sale").when(added, "restock").otherwise("new_item")
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("osm:node:"), (F.col("user_id") % 7).cast("string")).alias("shop_id"),
        F.concat(F.lit("PHA-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("sku"),
        name.alias("type"), delta.cast("long").alias("delta"))


def events(spark, sf):
    return as_movements(table(spark, sf, "events"))


EVENTS = """v_events AS (
  SELECT event_id, ts, 'osm:node:' || (user_id % 7)::VARCHAR AS shop_id,
    'PHA-' || lpad(user_id::VARCHAR, 4, '0') AS sku,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'sale'
      WHEN event_type IN ('signup', 'click') THEN 'restock' ELSE 'new_item' END AS type,
    CASE WHEN event_type IN ('purchase', 'view') THEN -(1 + event_id % 5)
      WHEN event_type IN ('signup', 'click') THEN 5 + event_id % 16
      ELSE 8 + event_id % 18 END AS delta
  FROM events)"""


def known_shops(spark, sf):
    """Shops under their full id, with region."""
    return shops(spark, sf).select(
        F.concat(F.lit("osm:node:"), F.col("shop_id").cast("string")).alias("shop_id"),
        "name", F.col("nation").cast("string").alias("region_id"))


_MODIFIER = ["comprar", "precio", "donde comprar", "como usar", "", "oferta", "que es",
             "significado"]
_TAIL = ["led", "mercadona", "en ingles", "para mujer", "talla", "y precio", "", "pack"]


def rising(spark, sf):
    """Discovered queries: every sentence of every document, and every part
    worded the way shoppers do. The parent of a sentence is the first word of
    its document, of a part its colour and kind reversed or as named."""
    d = dealt_out(table(spark, sf, "documents").select("doc_id", "text", "n_chars"))
    d = d.withColumn("parent_keyword", F.regexp_extract("text", r"^\s*([^\s]+)", 1))
    d = d.select("doc_id", "n_chars", "parent_keyword",
                 F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "query"))
    d = d.withColumn("query", F.trim("query")).filter(F.col("query") != "")
    docs = d.select(
        F.concat_ws("-", F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"),
                    F.lpad(F.col("pos").cast("string"), 6, "0")).alias("id"),
        "parent_keyword", "query",
        F.when((F.col("doc_id") + F.col("pos")) % 3 > 0, F.col("n_chars").cast("double"))
        .alias("growth_pct"), ((F.col("doc_id") + F.col("pos")) % 3 == 0).alias("is_breakout"))
    k = F.col("p_partkey")

    def word(values, at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at % 8 + 1).cast("int"))
    w = F.split("p_name", " ")
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p-"), F.lpad(k.cast("string"), 12, "0")).alias("id"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise(
            F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0)))).alias("parent_keyword"),
        F.trim(F.concat_ws(" ", word(_MODIFIER, k), F.col("p_name"),
                           word(_TAIL, F.floor(k / 8)))).alias("query"),
        F.when(k % 3 > 0, F.col("p_retailprice")).alias("growth_pct"),
        (k % 3 == 0).alias("is_breakout"))
    return docs.unionByName(parts)


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RISING = rf"""v_rising AS (
  SELECT 'd-' || lpad(doc_id::VARCHAR, 12, '0') || '-' || lpad((pos - 1)::VARCHAR, 6, '0')
      AS id, parent_keyword, trim(s, ' ') AS query,
    CASE WHEN (doc_id + pos - 1) % 3 > 0 THEN n_chars::DOUBLE END AS growth_pct,
    (doc_id + pos - 1) % 3 = 0 AS is_breakout
  FROM (SELECT doc_id, n_chars, regexp_extract(text, '^\s*([^\s]+)', 1) AS parent_keyword,
          unnest(string_split_regex(text, '[.!?\n]+')) AS s,
          generate_subscripts(string_split_regex(text, '[.!?\n]+'), 1) AS pos
        FROM documents)
  WHERE trim(s, ' ') <> ''
  UNION ALL
  SELECT 'p-' || lpad(p_partkey::VARCHAR, 12, '0'),
    CASE WHEN p_partkey % 2 = 0 THEN p_name
         ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END,
    trim({_sql_list(_MODIFIER)}[(p_partkey % 8 + 1)::INT] || ' ' || p_name || ' '
      || {_sql_list(_TAIL)}[((p_partkey // 8) % 8 + 1)::INT]),
    CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END, p_partkey % 3 = 0
  FROM part)"""
