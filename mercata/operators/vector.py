"""Exact cosine search over product embeddings."""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import num, text, vocab
from ..session import cut_lineage


def norm(v):
    return F.sqrt(F.aggregate(text.col(v), F.lit(0.0), lambda s, x: s + x * x))


def usable(v, size=None):
    """A vector that has a direction: no null entry, not all zero, of the given length."""
    v = text.col(v).cast("array<double>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(v) == size), F.lit(False))


def normalise(v):
    """Unit length; a zero vector stays as it is."""
    v = text.col(v).cast("array<double>")
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a, b):
    """Null for a zero vector, which has no direction."""
    a, b = text.col(a).cast("array<double>"), text.col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def match_products(products: DataFrame, query, k=20, neighbourhood=None):
    """The k products closest to one query vector.

    Products without a usable vector of the query's length take no part.
    """
    rows = products.filter(usable("embedding", len(query)))
    if neighbourhood is not None:
        rows = rows.filter(F.col("neighbourhood") == neighbourhood)
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("similarity", cosine("embedding", vector))
    return scored.orderBy(F.col("similarity").desc(), "id").limit(k)


TILE = 1 << 21  # similarities a worker holds at a time


def _block_top(k, tile=TILE):
    """Best k products of one block for each query of one block.

    Similarities are formed for a few queries at a time, `tile` in all, and only those that
    can be among the best k are sorted; what a task holds beside the two blocks does not
    grow with their product. The function carries what it needs, so workers do not import
    this package.
    """
    def unit(column):
        import numpy as np
        flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64)
        m = flat.reshape(len(column), -1)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(queries, products):
        import numpy as np
        import pyarrow as pa
        asked, held, near = [], [], []
        if queries.num_rows and products.num_rows:
            products = products.sort_by("id")  # equal scores: the smaller id first
            wanted, stock = unit(queries["vector"]), unit(products["embedding"]).T
            n = stock.shape[1]
            step = max(1, tile // n)
            for start in range(0, len(wanted), step):
                sims = wanted[start:start + step] @ stock
                # the last digits of a product depend on its place in the block
                floor = np.partition(sims, n - k, axis=1)[:, n - k] - 1e-11 if n > k else np.full(len(sims), -2.0)
                row, at = np.nonzero(sims >= floor[:, None])
                value = np.round(sims[row, at], 12)
                order = np.lexsort((at, -value, row))
                row, at, value = row[order], at[order], value[order]
                first = np.searchsorted(row, np.arange(len(sims)))
                best = np.arange(len(row)) - first[row] < k
                asked.append(row[best] + start)
                held.append(at[best])
                near.append(value[best])
        rows, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, held))
        return pa.table({"qid": queries["qid"].take(pa.array(rows)), "id": products["id"].take(pa.array(places)),
                         "similarity": pa.array(np.concatenate(near) if near else np.zeros(0))})
    return run


QUERIES_TOGETHER = 1_024  # of one block, while the grid has room


def _grid(queries, product_blocks, query_blocks, tasks):
    """(product blocks, query blocks): about `tasks` cells, so that neither side is copied
    more often than the root of that; few queries are not cut at all."""
    if query_blocks is None:
        side = math.isqrt(max(tasks - 1, 0)) + 1
        query_blocks = 1 if product_blocks else min(side, max(1, -(-queries.count() // QUERIES_TOGETHER)))
    return product_blocks or max(1, -(-tasks // query_blocks)), query_blocks


def _vector(df, c):
    """Floats travel as they are; the worker computes in doubles."""
    as_is = df.schema[c].dataType.simpleString() == "array<float>"
    return F.col(c) if as_is else F.col(c).cast("array<double>").alias(c)


def top_k(products: DataFrame, queries: DataFrame, k=vocab.SEARCH_CANDIDATES, *,
          product_blocks=None, query_blocks=None) -> DataFrame:
    """The k closest products of every query: `qid, id, similarity, pos`.

    Products: `id, embedding, scope`; queries: `qid, vector, scope` (null scope searches
    everything). Ids may have any type that sorts. A query meets only the products of its
    scope, and products that no query asks about are left out before they move. The
    products of a scope are hashed into blocks, and the queries too where they are many;
    every pair of blocks is a task, about as many as shuffle partitions unless
    `product_blocks` or `query_blocks` says otherwise. Each side is copied to the blocks of
    the other: few queries leave the products where they are, and as many queries as
    products copy both only as often as the root of the tasks. Every product block gives at
    most k rows per query. Equal to 12 digits is a tie, which goes to the smaller id.
    Vectors that are null, all zero or hold a null, and pairs of unequal length, give no row.
    """
    spark = products.sparkSession
    blocks, query_blocks = _grid(queries, product_blocks, query_blocks,
                                 int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = queries.filter(usable("vector")).withColumn("size", F.size("vector")).select(
        "qid", _vector(queries, "vector"), "size",
        F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int").alias("qb"), "scope",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("pb"))
    p = products.filter(usable("embedding")).withColumn("size", F.size("embedding")).select(
        "id", _vector(products, "embedding"), "size", "scope",
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("pb"))
    part = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb")
    scoped = p.filter(F.col("scope").isNotNull()).select("*", F.lit(False).alias("all"))
    # everything is copied once more only for queries without a scope
    p = scoped.unionByName(p.withColumns({"scope": F.lit(None).cast(p.schema["scope"].dataType),
                                          "all": F.lit(True)}))
    p = p.select("*", part)
    keys = ["all", "scope", "size", "pb", "qb"]
    q = q.withColumn("all", F.col("scope").isNull())
    asked = q.select("all", F.col("scope").alias("_scope"), F.col("size").alias("_size")).distinct()
    p = p.join(asked.withColumnRenamed("all", "_all"), (p["all"] == F.col("_all"))
               & p["scope"].eqNullSafe(F.col("_scope")) & (p["size"] == F.col("_size")), "left_semi")
    id_type = products.schema["id"].dataType.simpleString()
    qid_type = queries.schema["qid"].dataType.simpleString()
    near = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(
        _block_top(k), f"qid {qid_type}, id {id_type}, similarity double")
    order = W.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return near.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


PIVOTS = 64  # that cut the products of one vector length into blocks
BLOCK_ROWS = 20_000  # products of a block that one task searches


def _to_pivots(pivots, kind):
    """Adds the nearest pivot of a row's vector and the distance to it, or, for `away`, the
    distances to all of them. Distances are between unit vectors."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            size = batch.column("size").to_numpy()
            vectors = batch.column("vector")
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = np.asarray(vectors.flatten(), np.float64)
            near = np.zeros(len(size), np.int32)
            dist = np.zeros(len(size))
            away = [None] * len(size)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                m = flat[offsets[rows][:, None] + np.arange(n)]
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                far = np.sqrt(np.maximum(2 - 2 * m @ pivots[n].T, 0)) if n in pivots else np.zeros((len(rows), 1))
                near[rows], dist[rows] = far.argmin(1), far.min(1)
                for i, row in enumerate(rows.tolist() if kind == "away" else ()):
                    away[row] = far[i]
            more = [pa.array(away, pa.list_(pa.float64()))] if kind == "away" else [pa.array(near), pa.array(dist)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(
                ["away"] if kind == "away" else ["pivot", "dist"])])
    return run


def _chosen_pivots(products, count):
    """Unit vectors by length: the first `count` distinct ones by hash, a bounded number."""
    import numpy as np
    by = W.partitionBy("size").orderBy(F.xxhash64("vector"), "vector")
    some = (products.select("size", "vector").withColumn("_n", F.row_number().over(by))
            .filter(F.col("_n") <= count).select("size", "vector").distinct().collect())
    out = {}
    for r in sorted(some, key=lambda r: (r["size"], r["vector"])):
        out.setdefault(r["size"], []).append(r["vector"])
    return {n: np.array(v) / np.linalg.norm(np.array(v), axis=1, keepdims=True) for n, v in out.items()}


def pruned_top_k(products: DataFrame, queries: DataFrame, k=vocab.SEARCH_CANDIDATES, *, pivots=PIVOTS,
                 block_rows=BLOCK_ROWS, report=False):
    """`top_k` with the same answers, visiting only blocks that can hold one of them.

    Every product belongs to the block of its nearest pivot; a block knows its radius. By the
    triangle inequality no product of a block is nearer to a query than its distance to the
    pivot less the radius, which bounds the similarity. A query first visits its best
    blocks, best first, until they hold k products; the k-th similarity found there is a
    floor, and of the other blocks only those whose bound reaches it are visited. This pays
    where vectors lie in clusters; on vectors without any, every block is visited.

    With `report` also returns `qid, blocks, visited`.
    """
    scope_type = products.schema["scope"].dataType
    qid_type, id_type = (d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (products, "id")))
    p = products.filter(usable("embedding")).select(
        "id", "scope", F.col("embedding").cast("array<double>").alias("vector")).withColumn("size", F.size("vector"))
    centres = _chosen_pivots(p, pivots)
    scope = scope_type.simpleString()
    p = p.mapInArrow(_to_pivots(centres, "near"),
                     f"id {id_type}, scope {scope}, vector array<double>, size int, pivot int, dist double")
    q = queries.filter(usable("vector")).select("qid", "scope", F.col("vector").cast("array<double>").alias("vector")) \
        .withColumn("size", F.size("vector"))
    q = q.mapInArrow(_to_pivots(centres, "away"),
                     f"qid {qid_type}, scope {scope}, vector array<double>, size int, away array<double>")
    q = q.withColumn("all", F.col("scope").isNull())
    # queries without a scope search blocks of all products
    own = p.filter(F.col("scope").isNotNull()).withColumn("all", F.lit(False))
    p = own.unionByName(p.withColumns({"scope": F.lit(None).cast(scope_type), "all": F.lit(True)}))
    block = ["all", "scope", "size", "pivot"]
    blocks = cut_lineage(p.groupBy(*block).agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n"))
                         .withColumn("parts", F.ceil(F.col("n") / block_rows)))

    def same(names):
        """Equal columns, nulls included, of a side whose names begin with an underscore."""
        conditions = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
        return reduce(lambda a, b: a & b, conditions)

    def aside(names):
        return [F.col(c).alias(f"_{c}") for c in names]
    names = ["all", "scope", "size"]
    b = blocks.select(*aside(names), "pivot", "radius", "n", "parts")
    gap = F.greatest(F.get("away", F.col("pivot")) - F.col("radius"), F.lit(0.0))
    visits = q.drop("vector").join(b, same(names)).withColumn("bound", F.lit(1.0) - gap * gap / 2).select(
        "qid", *block, "n", "parts", "bound")
    best = W.partitionBy("qid").orderBy(F.col("bound").desc(), "pivot")
    before = F.coalesce(F.sum("n").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    visits = cut_lineage(visits.withColumn("first", before < k))

    def searched(which):
        """Best k of each part of each visited block for the queries that visit it."""
        def subs(rows):
            return rows.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        asked = subs(which.select("qid", *block, "parts")).join(q.select("qid", "vector"), "qid")
        wanted = which.select(*aside(block), "parts").distinct()
        held = p.join(wanted, same(block)).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts"))) \
            .select("id", F.col("vector").alias("embedding"), *block, "sub")
        by = [*block, "sub"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(
            _block_top(k), f"qid {qid_type}, id {id_type}, similarity double")
    order = W.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")

    def top(rows):
        return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    found = cut_lineage(top(searched(visits.filter("first"))))
    floor = found.filter(F.col("pos") == k).select("qid", F.col("similarity").alias("floor"))
    # a hair of slack: the bound and the similarity are rounded apart
    others = visits.filter("NOT first").join(floor, "qid", "left").filter(
        F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9))
    hits = top(found.drop("pos").unionByName(searched(others)))
    if not report:
        return hits
    seen = visits.filter("first").select("qid").unionByName(others.select("qid")).groupBy("qid").agg(
        F.count(F.lit(1)).alias("visited"))
    total = visits.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"))
    return hits, total.join(seen, "qid").select("qid", "blocks", "visited")


def rerank(candidates: DataFrame, results=vocab.SEARCH_RESULTS) -> DataFrame:
    """Similarity plus boosts for name, tokens, brand and stock, per query.

    Needs `qid, pos, similarity, name, tags, stock_qty, item_name, brand_hint`.
    Tags are compared as stored, names folded. Ties keep similarity order.
    """
    c = candidates.withColumns({
        "_item": text.fold_compatible(F.coalesce("item_name", F.lit(""))),
        "_name": text.fold_compatible("name"),
        "_brand": text.fold_compatible(F.coalesce("brand_hint", F.lit("")))})
    c = c.withColumn("_hay", F.concat("_name", F.lit(" "), F.array_join(
        F.coalesce("tags", F.array().cast("array<string>")), " ")))
    c = c.withColumn("_tokens", F.array_distinct(text.unicode_words("_item", 3)))
    found = F.size(F.filter("_tokens", lambda t: F.contains(F.col("_hay"), t)))
    named = (F.length("_item") > 0) & F.contains(F.col("_name"), F.col("_item"))
    name = F.when(named, F.lit(vocab.NAME_BOOST)).when(
        F.size("_tokens") > 0, F.lit(vocab.TOKEN_BOOST) * found / F.size("_tokens")
    ).otherwise(F.lit(0.0))
    brand = F.when((F.length("_brand") > 0) & F.contains(F.col("_hay"), F.col("_brand")),
                   F.lit(vocab.BRAND_BOOST)).otherwise(F.lit(0.0))
    stock = F.when(F.coalesce("stock_qty", F.lit(0)) > 0,
                   F.lit(vocab.STOCK_BOOST)).otherwise(F.lit(0.0))
    c = c.withColumn("_score", F.coalesce("similarity", F.lit(0.0)) + name + brand + stock)
    order = W.partitionBy("qid").orderBy(F.col("_score").desc(), "pos")
    return (c.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= results)
            .withColumn("match_score", num.half_even("_score", 4))
            .drop("_item", "_name", "_brand", "_hay", "_tokens", "_score"))
