"""Diverse product picks: never the same category twice in a row if avoidable."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text, vocab


def _take_turns(rows, limit):
    """`limit` picks from an array of (place, id, category, score), best first.

    Each turn takes the best of another category than the last pick's, or the best of all
    if only that category is left.
    """
    none = F.slice(rows, 1, 0)
    start = F.struct(rows.alias("rest"), none.alias("taken"))

    def turn(state, _):
        last = F.get(state["taken"], F.size(state["taken"]) - 1)["category"]
        other = F.filter(state["rest"], lambda r: ~r["category"].eqNullSafe(last))
        best = F.coalesce(F.get(other, F.lit(0)), F.get(state["rest"], F.lit(0)))
        return text.let(best, lambda pick: F.when(pick.isNull(), state).otherwise(F.struct(
            F.filter(state["rest"], lambda r: r["place"] != pick["place"]).alias("rest"),
            F.concat(state["taken"], F.array(pick)).alias("taken"))))
    turns = F.sequence(F.lit(1), F.lit(limit))
    return F.aggregate(turns, start, turn, lambda state: state["taken"])


def requested_picks(products: DataFrame, requests: DataFrame, limit=vocab.PICKS_LIMIT) -> DataFrame:
    """Picks for requests `qid, neighbourhood` (free text): `qid, barrio, pick, id, category, score`.

    A barrio that the text names limits them to it; without one, or with an unknown one, they
    come from everywhere. Each asked barrio is picked for once.
    """
    from .places import match_barrio
    asked = requests.select("qid", match_barrio("neighbourhood").alias("barrio"))
    scopes = asked.select("barrio").distinct()
    own = products.join(scopes.filter("barrio IS NOT NULL"), products["neighbourhood"] == F.col("barrio"), "left_semi")
    # everywhere goes as a neighbourhood without a name
    rows = own.unionByName(products.withColumn("neighbourhood", F.lit("")))
    picked = diverse_picks(rows, limit).withColumnRenamed("neighbourhood", "_scope")
    return asked.join(picked, F.coalesce("barrio", F.lit("")) == F.col("_scope")).drop("_scope")


def diverse_picks(products: DataFrame, limit=vocab.PICKS_LIMIT) -> DataFrame:
    """Picks per neighbourhood from `neighbourhood, id, category, score, qty`.

    Only the best `limit` products of a category can be picked, and only the
    `limit + 1` categories with the best heads: a later category always has at
    least two better untouched heads before it. Both cuts are exact and run
    before the rows meet, so a group is at most limit*(limit+1) rows however
    large the neighbourhood is.
    """
    p = products.filter(F.col("qty") > 0).select(
        "neighbourhood", "id", F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    best = [F.col("score").desc(), F.col("id")]
    head = W.partitionBy("neighbourhood", "category").orderBy(*best)
    p = p.withColumn("_n", F.row_number().over(head)).filter(F.col("_n") <= limit)
    heads = W.partitionBy("neighbourhood").orderBy(*best)
    open_categories = (p.filter(F.col("_n") == 1)
                       .withColumn("_c", F.row_number().over(heads))
                       .filter(F.col("_c") <= limit + 1)
                       .select("neighbourhood", "category"))
    p = p.join(open_categories, ["neighbourhood", "category"], "left_semi").drop("_n")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "category", "score")))
    rows = F.transform(ranked, lambda r, i: F.struct(
        i.alias("place"), r["id"].alias("id"), r["category"].alias("category"), r["score"].alias("score")))
    return p.groupBy("neighbourhood").agg(rows.alias("_rows")) \
        .select("neighbourhood", F.posexplode(_take_turns(F.col("_rows"), limit)).alias("_at", "_pick")) \
        .select("neighbourhood", (F.col("_at") + 1).alias("pick"), "_pick.id", "_pick.category", "_pick.score")
