"""Product search by meaning."""

from pyspark.sql import functions as F

from ..operators import listing, places, vector


def search(queries, products, stores):
    """Queries: `qid, vector, scope, item_name, brand_hint`; products: `id,
    embedding, scope, name, tags, stock_qty, store_id`; stores: `store_id,
    store_name, store_rating`."""
    near = vector.top_k(products, queries)
    facts = products.select("id", "name", "tags", "stock_qty", "store_id")
    asked = queries.select("qid", "item_name", "brand_hint")
    ranked = vector.rerank(near.join(facts, "id").join(asked, "qid"))
    return listing.with_store_facts(ranked, stores)


def scoped(requests):
    """Adds `scope`, the barrio of a request: the one asked for (`neighbourhood`), else the
    one its text names (`location`); null, everywhere, if neither names a barrio."""
    return requests.withColumn("scope", F.coalesce(
        places.match_barrio("neighbourhood"), places.match_barrio("location")))


def interpreted(item_name, barrio):
    return F.when(F.col(barrio).isNotNull(), F.concat(
        F.col(item_name), F.lit(" near "), F.col(barrio))).otherwise(
        F.concat(F.col(item_name), F.lit(" anywhere in Madrid")))
