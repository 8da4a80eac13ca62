"""Vector search, picks and chat."""

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import chat, listing, picks, places, vector
from ..plans import semantic
from ..session import cut_lineage
from . import views as v
from .registry import half_even_sql, query, sql_list, with_

# --- vectors --------------------------------------------------------------------

COSINE = "round(list_cosine_similarity(a.e, b.e), 12)"
VECTORS = """v_vec AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"""


def vector_rows(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("scope"))


def vector_queries(rows, scoped):
    scope = F.col("scope") if scoped else F.lit(None).cast("string")
    return rows.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"),
                       scope.alias("scope"))


@query("vector_top_k", with_(VECTORS, select=f"""
SELECT a.vec_id AS qid, b.vec_id AS id, round({COSINE}, 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS pos
FROM v_vec a, v_vec b QUALIFY pos <= 20"""))
def vector_top_k(spark, sf):
    rows = vector_rows(spark, sf)
    top = vector.top_k(rows, vector_queries(rows, False), 20)
    return top.select("qid", "id", F.round("similarity", 6).alias("similarity"),
                      F.col("pos").cast("long").alias("pos"))


@query("vector_top_k_pruned", with_(VECTORS, select=f"""
SELECT a.vec_id AS qid, b.vec_id AS id, round({COSINE}, 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS pos
FROM v_vec a JOIN v_vec b ON a.label = b.label QUALIFY pos <= 10"""))
def vector_top_k_pruned(spark, sf):
    """The search by label again, by blocks around pivots with distance bounds."""
    rows = vector_rows(spark, sf)
    top = vector.pruned_top_k(rows, vector_queries(rows, True), 10, pivots=16)
    return top.select("qid", "id", F.round("similarity", 6).alias("similarity"),
                      F.col("pos").cast("long").alias("pos"))


@query("vector_top_k_in_label", with_(VECTORS, select=f"""
SELECT a.vec_id AS qid, b.vec_id AS id, round({COSINE}, 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS pos
FROM v_vec a JOIN v_vec b ON a.label = b.label QUALIFY pos <= 10"""))
def vector_top_k_in_label(spark, sf):
    rows = vector_rows(spark, sf)
    top = vector.top_k(rows, vector_queries(rows, True), 10)
    return top.select("qid", "id", F.round("similarity", 6).alias("similarity"),
                      F.col("pos").cast("long").alias("pos"))


@query("closest_products", with_(VECTORS, select=f"""
SELECT b.vec_id AS id, round({COSINE}, 6) AS similarity FROM v_vec b,
  (SELECT [CASE WHEN i % 3 = 0 THEN 0.5 ELSE -0.25 END FOR i IN range(64)]::DOUBLE[] AS e) a
WHERE b.label = 3 ORDER BY {COSINE} DESC, b.vec_id LIMIT 20"""))
def closest_products(spark, sf):
    rows = vector_rows(spark, sf).withColumnRenamed("scope", "neighbourhood")
    wanted = [0.5 if i % 3 == 0 else -0.25 for i in range(64)]
    hits = vector.match_products(rows, wanted, 20, "3")
    return hits.select("id", F.round("similarity", 6).alias("similarity"))


@query("unit_vectors", with_(VECTORS, select="""
SELECT vec_id AS id, round(sqrt(list_sum([x * x FOR x IN u])), 6) AS length,
  round(u[1], 6) AS first FROM (
  SELECT vec_id, [x * (vec_id + 1) / sqrt(list_sum([y * y * (vec_id + 1) * (vec_id + 1)
    FOR y IN e])) FOR x IN e] AS u FROM v_vec)"""))
def unit_vectors(spark, sf):
    rows = vector_rows(spark, sf)
    stretched = F.transform(F.col("embedding").cast("array<double>"),
                            lambda x: x * (F.col("id") + 1))
    unit = rows.withColumn("u", vector.normalise(stretched))
    return unit.select("id", F.round(vector.norm("u"), 6).alias("length"),
                       F.round(F.get("u", F.lit(0)), 6).alias("first"))


SEMANTIC = f"""v_prod AS (
  SELECT p_partkey AS id, p_name AS name, [{v.CATEGORY_SQL}, lower(p_brand)] AS tags,
    coalesce((SELECT sum(qty) FROM v_inventory i WHERE i.sku = p_partkey), 0)::BIGINT
      AS stock_qty,
    (SELECT min(shop_id) FROM v_inventory i WHERE i.sku = p_partkey) AS store_id, e
  FROM part JOIN v_vec ON p_partkey = vec_id),
v_near AS (
  SELECT a.vec_id AS qid, q.p_name AS item_name, q.p_brand AS brand, b.*,
    {COSINE} AS sim, row_number() OVER (PARTITION BY a.vec_id
      ORDER BY {COSINE} DESC, b.id) AS pos
  FROM v_vec a JOIN part q ON q.p_partkey = a.vec_id, v_prod b QUALIFY pos <= 40),
v_hay AS (
  SELECT *, lower(name) || ' ' || array_to_string(tags, ' ') AS hay,
    list_distinct(regexp_extract_all(lower(item_name), '[\\p{{L}}\\p{{N}}_]{{3,}}')) AS toks
  FROM v_near),
v_final AS (
  SELECT *, sim + CASE WHEN contains(lower(name), lower(item_name)) THEN 0.30::DOUBLE
      WHEN len(toks) > 0 THEN 0.15::DOUBLE * len([x FOR x IN toks IF contains(hay, x)])
        / len(toks) ELSE 0 END
    + CASE WHEN contains(hay, lower(brand)) THEN 0.10::DOUBLE ELSE 0 END
    + CASE WHEN stock_qty > 0 THEN 0.05::DOUBLE ELSE 0 END AS score FROM v_hay)"""


def catalogue(spark, sf):
    """Parts as products; only some have an embedding."""
    held = v.inventory(spark, sf).groupBy("sku").agg(
        F.sum("qty").alias("stock_qty"), F.min("shop_id").alias("store_id"))
    p = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.array(v.category(), F.lower("p_brand")).alias("tags"))
    vectors = vector_rows(spark, sf).select("id", "embedding")
    return (p.join(vectors, "id", "left").join(held, F.col("sku") == F.col("id"), "left")
            .withColumn("scope", F.lit(None).cast("string"))
            .withColumn("stock_qty", F.coalesce("stock_qty", F.lit(0))))


@query("semantic_search", with_(VECTORS, v.INVENTORY, v.SHOPS, SEMANTIC, select=f"""
SELECT f.qid, f.id, s.name AS store_name, f.stock_qty,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS place,
  {half_even_sql('score', 4)} AS match_score
FROM v_final f LEFT JOIN v_shops s ON f.store_id = s.shop_id QUALIFY place <= 20"""))
def semantic_search(spark, sf):
    asked = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("qid"), F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("brand_hint"))
    queries = vector_queries(vector_rows(spark, sf), False).join(asked, "qid")
    stores = v.shops(spark, sf).select(
        F.col("shop_id").alias("store_id"), F.col("name").alias("store_name"),
        F.col("rating").alias("store_rating"))
    hits = semantic.search(queries, catalogue(spark, sf), stores)
    return hits.select("qid", "id", "store_name", "stock_qty",
                       F.col("place").cast("long").alias("place"), "match_score")


@query("semantic_scopes", f"""
SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN b WHEN 1 THEN c WHEN 3 THEN c END AS scope,
  p_name || CASE WHEN p_partkey % 4 = 2 THEN ' anywhere in Madrid' WHEN p_partkey % 4 = 0 THEN ' near ' || b
    ELSE ' near ' || c END AS interpreted
FROM (SELECT *, {sql_list(vocab.BARRIOS)}[(p_partkey % {len(vocab.BARRIOS)} + 1)::INT] AS b,
        {sql_list(vocab.BARRIOS)}[(p_partkey // 3 % {len(vocab.BARRIOS)} + 1)::INT] AS c FROM part)""")
def semantic_scopes(spark, sf):
    """The place asked for wins over the one in the text; an unknown one counts as none."""
    names = F.array(*[F.lit(b) for b in vocab.BARRIOS])

    def barrio(i):
        return F.element_at(names, (i % len(vocab.BARRIOS) + 1).cast("int"))
    k = F.col("p_partkey")
    mode, n = k % 4, len(vocab.BARRIOS)
    rows = v.table(spark, sf, "part").select(
        k.alias("qid"), "p_name", F.when(mode == 0, F.upper(barrio(k))).when(mode == 3, "Atlantis").alias("neighbourhood"),
        F.when(mode != 2, F.concat(F.lit("en "), F.lower(barrio(F.floor(k / 3))))).alias("location"))
    return semantic.scoped(rows).select("qid", "scope", semantic.interpreted("p_name", "scope").alias("interpreted"))


# --- picks ----------------------------------------------------------------------

PICKS = """v_items AS (
  SELECT neighbourhood, category, rating AS score,
    lpad(i.shop_id::VARCHAR, 9, '0') || '-' || lpad(sku::VARCHAR, 9, '0') AS id
  FROM v_inventory i JOIN v_shops s ON i.shop_id = s.shop_id WHERE qty > 0),
v_best AS (
  SELECT * FROM v_items QUALIFY row_number() OVER (PARTITION BY neighbourhood, category
    ORDER BY score DESC, id) <= 12),
v_step AS (
  SELECT DISTINCT neighbourhood, 0 AS pick, ''::VARCHAR AS last, []::VARCHAR[] AS taken,
    NULL::VARCHAR AS id FROM v_best
  UNION ALL
  SELECT s.neighbourhood, s.pick + 1,
    arg_min(b.category, (b.category = s.last, -b.score, b.id)),
    list_append(any_value(s.taken), arg_min(b.id, (b.category = s.last, -b.score, b.id))),
    arg_min(b.id, (b.category = s.last, -b.score, b.id))
  FROM v_step s JOIN v_best b ON s.neighbourhood = b.neighbourhood
    AND NOT list_contains(s.taken, b.id)
  WHERE s.pick < 12 GROUP BY s.neighbourhood, s.pick)"""


@query("diverse_picks", with_(v.INVENTORY, v.SHOPS, PICKS, select="""
SELECT neighbourhood, pick, id, last AS category FROM v_step WHERE pick > 0""").replace(
    "WITH ", "WITH RECURSIVE ", 1))
def diverse_picks(spark, sf):
    stores = v.shops(spark, sf).select(F.col("shop_id").alias("store_id"), "rating",
                                       "neighbourhood")
    rated = listing.with_rating(v.products(spark, sf), stores)
    rows = rated.join(stores.select("store_id", "neighbourhood"), "store_id").select(
        "neighbourhood", "category", F.col("rating").alias("score"), "qty",
        F.concat_ws("-", F.lpad(F.col("store_id").cast("string"), 9, "0"),
                    F.lpad(F.col("product_id").cast("string"), 9, "0")).alias("id"))
    return picks.diverse_picks(rows).drop("score")


_BARRIO_SQL = f"{sql_list(vocab.BARRIOS)}[(nation % {len(vocab.BARRIOS)} + 1)::INT]"
REQUESTED = PICKS.replace("SELECT neighbourhood, category, rating AS score,", f"""SELECT s.scope AS neighbourhood,
    category, rating AS score,""").replace("JOIN v_shops s ON i.shop_id = s.shop_id", f"""JOIN (
    SELECT shop_id, rating, {_BARRIO_SQL} AS scope FROM v_shops UNION ALL SELECT shop_id, rating, '*' FROM v_shops) s
    ON i.shop_id = s.shop_id""")


@query("picks_by_request", with_(v.INVENTORY, v.SHOPS, REQUESTED, f"""v_asked AS (
  SELECT conv_id AS qid, CASE conv_id % 3 WHEN 0 THEN {sql_list(vocab.BARRIOS)}[(conv_id % {len(vocab.BARRIOS)} + 1)::INT]
    ELSE '*' END AS barrio FROM conversations WHERE turn = 0)""", select="""
SELECT qid, nullif(barrio, '*') AS barrio, pick::INT AS pick, id, last AS category
FROM v_asked JOIN v_step ON neighbourhood = barrio WHERE pick > 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def picks_by_request(spark, sf):
    """Opening turns as requests: a barrio in other letters, an unknown place, or none."""
    names = F.array(*[F.lit(b) for b in vocab.BARRIOS])

    def barrio(i):
        return F.element_at(names, (i % len(vocab.BARRIOS) + 1).cast("int"))
    stores = v.shops(spark, sf).select(F.col("shop_id").alias("store_id"), "rating",
                                       barrio(F.col("nation")).alias("neighbourhood"))
    rated = listing.with_rating(v.products(spark, sf), stores)
    rows = rated.join(stores.select("store_id", "neighbourhood"), "store_id").select(
        "neighbourhood", "category", F.col("rating").alias("score"), "qty",
        F.concat_ws("-", F.lpad(F.col("store_id").cast("string"), 9, "0"),
                    F.lpad(F.col("product_id").cast("string"), 9, "0")).alias("id"))
    k = F.col("conv_id")
    requests = v.table(spark, sf, "conversations").filter("turn = 0").select(k.alias("qid"), F.when(
        k % 3 == 0, F.concat(F.lit(" "), F.upper(barrio(k)))).when(k % 3 == 1, "Atlantis").alias("neighbourhood"))
    return picks.requested_picks(rows, requests).drop("score")


# Every sentence a place might be named in: documents with a barrio appended
# in three spellings, so that the exact, contained and missing cases occur.
_NAMES = sql_list(vocab.BARRIOS)


@query("barrio_matches", f"""
WITH t AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper({_NAMES}[(doc_id % 24 + 1)::INT])
    WHEN 1 THEN text || ' ' || {_NAMES}[(doc_id % 24 + 1)::INT] ELSE text END AS said
  FROM documents),
f AS (SELECT doc_id, trim(strip_accents(lower(said))) AS s FROM t)
SELECT doc_id, coalesce(
  [b FOR b IN {_NAMES} IF strip_accents(lower(b)) = s][1],
  [b FOR b IN {_NAMES} IF contains(s, strip_accents(lower(b)))][1]) AS barrio FROM f""")
def barrio_matches(spark, sf):
    names = F.array(*[F.lit(b) for b in vocab.BARRIOS])
    d = F.col("doc_id")
    named = F.element_at(names, (d % 24 + 1).cast("int"))
    said = F.when(d % 3 == 0, F.upper(named)).when(
        d % 3 == 1, F.concat_ws(" ", "text", named)).otherwise(F.col("text"))
    rows = v.table(spark, sf, "documents").select("doc_id", "text").select(
        "doc_id", said.alias("said"))
    return rows.select("doc_id", places.match_barrio("said").alias("barrio"))


# --- chat -------------------------------------------------------------------------

# The store of a conversation is its number among the shops. Odd replies name
# two parts; messages of even turns name a colour only.
TURNS = f"""v_chat AS (
  SELECT c.conv_id * 1000 + c.turn AS turn_id, c.conv_id % n AS store_id,
    c.text || CASE WHEN c.turn % 2 = 0 THEN ' quiero ' || split_part(p.p_name, ' ', 2)
      ELSE '' END AS message,
    c.text || CASE WHEN c.turn % 2 = 1 THEN ' ' || p.p_name || ' ' || p2.p_name ELSE '' END
      AS reply
  FROM conversations c, (SELECT count(*) AS n, (SELECT count(*) FROM part) AS m FROM supplier)
  JOIN part p ON p.p_partkey = (c.conv_id * 7 + c.turn) % m
  JOIN part p2 ON p2.p_partkey = (c.conv_id * 11 + c.turn) % m),
v_prod AS (
  SELECT shop_id AS store_id, sku AS product_id, name, category, price, qty,
    lower(name) || ' ' || category AS hay FROM v_inventory),
v_said AS (
  SELECT turn_id, product_id, name, position(lower(name) IN strip_accents(lower(reply))) AS spot
  FROM v_chat JOIN v_prod USING (store_id)
  WHERE contains(strip_accents(lower(reply)), lower(name))),
v_named AS (
  SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY spot, name, product_id)
    AS place, product_id, 'mentioned' AS how FROM v_said QUALIFY place <= 3),
v_words AS (
  SELECT turn_id, store_id, unnest(list_distinct(regexp_extract_all(
    strip_accents(lower(message)), '[\\p{{L}}\\p{{N}}_]{{4,}}'))) AS w FROM v_chat
  WHERE turn_id NOT IN (SELECT turn_id FROM v_said)),
v_hits AS (
  SELECT turn_id, product_id, name, count(*) AS hits FROM v_words JOIN v_prod USING (store_id)
  WHERE qty > 0 AND contains(hay, w) GROUP BY 1, 2, 3),
v_guess AS (
  SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY hits DESC, name, product_id)
    AS place, product_id, 'keywords' AS how FROM v_hits QUALIFY place <= 3)"""


def chat_turns(spark, sf):
    c = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    p = v.table(spark, sf, "part").select("p_partkey", "p_name")
    n = v.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    m = p.agg(F.count(F.lit(1)).alias("m")).scalar()
    c = c.withColumns({"_a": (F.col("conv_id") * 7 + F.col("turn")) % m,
                       "_b": (F.col("conv_id") * 11 + F.col("turn")) % m,
                       "store_id": F.col("conv_id") % n})
    c = (c.join(p.select(F.col("p_partkey").alias("_a"), F.col("p_name").alias("_na")), "_a")
         .join(p.select(F.col("p_partkey").alias("_b"), F.col("p_name").alias("_nb")), "_b"))
    odd = F.col("turn") % 2 == 1
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "store_id",
        F.concat("text", F.when(odd, "").otherwise(F.concat(
            F.lit(" quiero "), F.get(F.split("_na", " "), F.lit(1))))).alias("message"),
        F.concat("text", F.when(odd, F.concat(F.lit(" "), "_na", F.lit(" "), "_nb"))
                 .otherwise("")).alias("reply"))


@query("chat_suggestions", with_(v.INVENTORY, TURNS, select="""
SELECT * FROM v_named UNION ALL SELECT * FROM v_guess"""))
def chat_suggestions(spark, sf):
    turns = chat_turns(spark, sf)
    products = cut_lineage(chat.asked_of(v.products(spark, sf), turns)).withColumn("tags", F.array("category"))
    rows = chat.suggestions(turns, products)
    return rows.withColumn("place", F.col("place").cast("long"))


@query("chat_history", """
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20""")
def chat_history(spark, sf):
    return chat.last_turns(v.table(spark, sf, "conversations")).select(
        "conv_id", "turn", "role", "text")


@query("store_digest", with_(v.INVENTORY, select="""
SELECT store_id, product_count, string_agg(line, chr(10) ORDER BY rn) || CASE
  WHEN product_count > 120 THEN chr(10) || '…y ' || (product_count - 120)::VARCHAR
    || ' artículos más' ELSE '' END AS digest
FROM (SELECT shop_id AS store_id, '- ' || name || ' — ' || price::VARCHAR || '€ (stock: '
        || qty::VARCHAR || ')' AS line, count(*) OVER (PARTITION BY shop_id) AS product_count,
        row_number() OVER (PARTITION BY shop_id ORDER BY (qty > 0)::INT DESC, name, sku) AS rn
      FROM v_inventory) WHERE rn <= 120 GROUP BY 1, 2"""))
def store_digest(spark, sf):
    return chat.store_digest(v.products(spark, sf))
