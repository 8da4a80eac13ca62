"""Captured JSON documents as DataFrames.

The parsers take rows of text, so a folder of captures is read by as many
tasks as it has files and a table of payloads like any other table.
"""

from pyspark.sql import DataFrame, functions as F

from .. import schemas


def read_texts(spark, path, column="payload"):
    """One row per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", column)


def osm_elements(payloads: DataFrame, column="payload") -> DataFrame:
    doc = F.from_json(column, schemas.OSM_DOCUMENT)
    return payloads.select(F.explode(doc["elements"]).alias("e")).select("e.*")


def read_osm(spark, path):
    docs = spark.read.schema(schemas.OSM_DOCUMENT).option("multiLine", True).json(path)
    return docs.select(F.explode("elements").alias("e")).select("e.*")


def read_shop_cache(spark, path, one_document=False):
    """Cached shop records; every row is relabelled as cached.

    Lines as `write_shop_cache` writes them, or one JSON array per file.
    """
    rows = spark.read.schema(schemas.SHOPS).option("multiLine", one_document).json(path)
    return rows.withColumn("source", F.lit("cache"))


def write_shop_cache(shops, path):
    shops.write.mode("overwrite").json(path)


def _entries(payloads, column):
    """(key, raw value) of a JSON object; `_` keys are comments."""
    pairs = F.from_json(column, "map<string,string>")
    rows = payloads.select(F.explode(pairs).alias("key", "value"))
    return rows.filter(~F.startswith("key", F.lit("_")))


def catalog_entries(payloads, column="payload"):
    """`category, pos` and the entry fields of a category -> list document."""
    rows = _entries(payloads, column).select(
        F.col("key").alias("category"),
        F.posexplode(F.from_json("value", schemas.CATALOG_ENTRIES)).alias("pos", "e"))
    return rows.select("category", "pos", "e.*")


def gazetteer(payloads, column="payload"):
    """`name, lat, lng` of a place -> coordinates document."""
    rows = _entries(payloads, column).select(
        F.col("key").alias("name"),
        F.from_json("value", "struct<lat:double,lng:double>").alias("p"))
    return rows.select("name", "p.lat", "p.lng")


def product_dump(payloads, column="payload"):
    """`pos` and the product fields; the document may be a bare array."""
    wrapped = F.when(F.startswith(F.ltrim(column), F.lit("[")), F.concat(
        F.lit('{"products":'), column, F.lit("}"))).otherwise(F.col(column))
    doc = F.from_json(wrapped, schemas.PRODUCT_DUMP)
    return payloads.select(F.posexplode(doc["products"]).alias("pos", "p")).select(
        "pos", "p.*")
