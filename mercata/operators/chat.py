"""Product suggestions, history and inventory digest for store chats."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text, vocab
from ..session import cut_lineage

WORD = 4  # letters of a message word that is looked for
NEEDLES_TOGETHER = 50_000  # in one automaton
TEXTS_TOGETHER = 20_000  # texts of one store in one task


def _searched(on, key):
    """Streams the texts of a group past one automaton of its needles.

    The function carries what it needs, so workers do not import this package.
    """
    def run(needles, texts):
        import ahocorasick
        import pyarrow as pa
        out = {name: [] for name in [*on, key, "needle", "at"]}
        if needles.num_rows and texts.num_rows:
            automaton = ahocorasick.Automaton()
            for needle in needles["needle"].to_pylist():
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            same = {name: texts[name][0].as_py() for name in on}
            for name, text in zip(texts[key].to_pylist(), texts["haystack"].to_pylist(), strict=True):
                first = {}
                for end, needle in automaton.iter(text):
                    first.setdefault(needle, end - len(needle) + 2)
                for column in on:
                    out[column] += [same[column]] * len(first)
                out[key] += [name] * len(first)
                out["needle"] += first
                out["at"] += first.values()
        kinds = {"needle": pa.string(), "at": pa.int32()}
        return pa.table({name: pa.array(v, kinds.get(name) or texts.schema.field(name).type) for name, v in out.items()})
    return run


def occurrences(texts: DataFrame, needles: DataFrame, on, key) -> DataFrame:
    """Every needle in every text with the same `on`: the keys, `key`, `needle`, `at`.

    `at` is the first place, from 1. All needles of a group are looked for at once, by an
    automaton past which its texts stream. Groups of many texts or many needles are dealt
    into parts, each a task of its own, by measured counts; a text meets every needle of
    its group in exactly one of them. Texts: `on`, `key`, `haystack`; needles: `on`,
    `needle`; empty needles occur nowhere.
    """
    needles = needles.filter(F.length("needle") > 0).select(*on, "needle").distinct()
    texts = texts.filter(F.col("haystack").isNotNull())
    parts = texts.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / TEXTS_TOGETHER).alias("_parts"))
    slices = needles.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / NEEDLES_TOGETHER).alias("_slices"))
    sizes = parts.join(slices, on)

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    t = texts.join(sizes, on).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts"))).withColumn(
        "_slice", every("_slices")).select(*on, "_part", "_slice", key, "haystack")
    n = needles.join(sizes, on).withColumn("_slice", F.pmod(F.xxhash64("needle"), F.col("_slices"))).withColumn(
        "_part", every("_parts")).select(*on, "_part", "_slice", "needle")
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*on, key]] + ["needle string", "at int"])
    by = [*on, "_part", "_slice"]
    return n.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_searched(on, key), schema)


def asked_of(products: DataFrame, turns: DataFrame) -> DataFrame:
    """The products of stores that have a turn; no other can be suggested."""
    return products.join(turns.select("store_id").distinct(), "store_id", "left_semi")


def suggestions(turns: DataFrame, products: DataFrame,
                limit=vocab.CHAT_SUGGESTIONS) -> DataFrame:
    """Up to three products per turn: `turn_id, place, product_id, how`.

    Turns: `turn_id, store_id, message, reply`; products: `store_id,
    product_id, name, tags, qty`, listed by name. Products the reply names
    come in order of mention; a turn that names none gets in-stock products by
    number of message words (4+ letters) found in name or tags. Products of a
    store with equal text are looked up once.
    """
    p = products.withColumn("_name", text.fold_compatible("name")).withColumn(
        "_hay", F.concat("_name", F.lit(" "), F.array_join(
            F.coalesce("tags", F.array().cast("array<string>")), " ")))
    replies = turns.select("turn_id", "store_id", text.fold_compatible("reply").alias("haystack"))
    names = p.select("store_id", F.col("_name").alias("needle"))
    said = cut_lineage(occurrences(replies, names, ["store_id"], "turn_id")).select(
        "turn_id", "store_id", F.col("needle").alias("_name"), F.col("at").alias("_at"))
    listed = F.struct("name", "product_id")
    # the first few products of every distinct text are all that can be shown
    lead = W.partitionBy("store_id", "_name").orderBy(listed)
    by_name = p.withColumn("_n", F.row_number().over(lead)).filter(F.col("_n") <= limit)
    first = W.partitionBy("turn_id").orderBy("_at", listed)
    mentioned = (said.join(by_name, ["store_id", "_name"])
                 .withColumn("place", F.row_number().over(first))
                 .filter(F.col("place") <= limit)
                 .select("turn_id", "place", "product_id", F.lit("mentioned").alias("how")))

    quiet = turns.join(said.select("turn_id").distinct(), "turn_id", "left_anti")
    asked = quiet.select("turn_id", "store_id", F.explode(F.array_distinct(
        text.unicode_words(text.fold_compatible("message"), WORD))).alias("needle"))
    stocked = p.filter(F.col("qty") > 0)
    # what a store was asked meets its own texts only, equal ones once
    sold = stocked.select("store_id", "_hay", F.col("_hay").alias("haystack")).distinct()
    found = occurrences(sold, asked, ["store_id"], "_hay").select("store_id", "_hay", "needle")
    hits = (asked.join(found, ["store_id", "needle"])
            .groupBy("turn_id", "store_id", "_hay")
            .agg(F.count(F.lit(1)).alias("_hits")))
    lead = W.partitionBy("store_id", "_hay").orderBy(listed)
    by_hay = stocked.withColumn("_n", F.row_number().over(lead)).filter(F.col("_n") <= limit)
    most = W.partitionBy("turn_id").orderBy(F.col("_hits").desc(), listed)
    guessed = (hits.join(by_hay, ["store_id", "_hay"])
               .withColumn("place", F.row_number().over(most))
               .filter(F.col("place") <= limit)
               .select("turn_id", "place", "product_id", F.lit("keywords").alias("how")))
    return mentioned.unionByName(guessed)


def last_turns(turns, limit=vocab.CHAT_TURNS):
    """The newest turns of every conversation, oldest of them first."""
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    return kept.drop("_n")


def store_digest(products, limit=vocab.DIGEST_LINES):
    """Inventory text per store: in stock first, by name, then "and N more".

    The count is an aggregate of its own, so that only the first `limit` rows
    of a store ever reach the window.
    """
    stocked = (F.col("qty") > 0).cast("int")
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both the lines and the counts follow without another shuffle, and in as many tasks
    products = products.repartition(parts, "store_id")
    order = W.partitionBy("store_id").orderBy(stocked.desc(), "name", "product_id")
    lines = (products.withColumn("_n", F.row_number().over(order))
             .filter(F.col("_n") <= limit)
             .withColumn("_line", F.concat(
                 F.lit("- "), "name", F.lit(" — "), F.col("price").cast("string"),
                 F.lit("€ (stock: "), F.col("qty").cast("string"), F.lit(")"))))
    texts = lines.groupBy("store_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", "_line"))),
        lambda x: x["_line"]), "\n").alias("lines"))
    counts = products.groupBy("store_id").agg(F.count(F.lit(1)).alias("product_count"))
    more = F.when(F.col("product_count") > limit, F.concat(
        F.lit("\n…y "), (F.col("product_count") - limit).cast("string"),
        F.lit(" artículos más"))).otherwise(F.lit(""))
    return counts.join(texts, "store_id").select(
        "store_id", "product_count", F.concat("lines", more).alias("digest"))
