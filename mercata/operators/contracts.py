"""Row contracts: every rule that fails is named in `violations`."""

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import num, text, vocab

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SHOP_ID = r"^osm:(node|way|relation):[0-9]+$"
SKU = r"^[A-Z]{3}-[0-9]{4}$"


def present(c):
    return f"{c}: required", F.col(c).isNotNull()


def filled(c):
    return f"{c}: empty", F.length(c) >= 1


def one_of(c, values):
    return f"{c}: not allowed", F.col(c).isin(*values)


def matches(c, pattern, label="pattern"):
    return f"{c}: {label}", F.col(c).rlike(pattern)


def uuid(c):
    return matches(c, UUID, "not a uuid")


def date(c):
    ok = F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")
    return f"{c}: not a date", ok & F.col(c).cast("string").try_cast("date").isNotNull()


def at_least(c, low):
    return f"{c}: below {low}", F.col(c) >= F.lit(low)


def between(c, low, high):
    return f"{c}: outside {low}..{high}", F.col(c).between(low, high)


def multiple_of(c, step):
    return f"{c}: not a multiple of {step}", num.is_multiple(c, step)


def items(c, allowed=None, at_least_one=False, unique=True):
    a = F.col(c)
    ok = a.isNotNull()
    if at_least_one:
        ok &= F.size(a) >= 1
    if unique:
        ok &= F.size(F.array_distinct(a)) == F.size(a)
    if allowed is not None:
        ok &= text.covers(text.words(allowed), a)
    return f"{c}: bad items", ok


def every(c, label, test):
    """All elements of an array pass `test`."""
    return f"{c}: {label}", F.forall(c, test)


def unless_null(c, rule):
    message, ok = rule
    return message, F.col(c).isNull() | ok


def only_if(condition, rule):
    message, ok = rule
    return message, ~F.coalesce(condition, F.lit(False)) | ok


def absent(c):
    return f"{c}: must be absent", F.col(c).isNull()


def shop():
    return [
        matches("shop_id", SHOP_ID), at_least("osm_id", 1), filled("name"),
        items("categories", vocab.CATEGORIES, at_least_one=True),
        between("lat", *vocab.LAT_BOUNDS), between("lng", *vocab.LNG_BOUNDS),
        one_of("source", ["overpass_live", "cache", "geofabrik"]),
        present("fetched_at"),
    ]


def inventory():
    return [
        matches("shop_id", SHOP_ID), matches("sku", SKU), filled("name"),
        one_of("category", vocab.CATEGORIES), at_least("price", 0.0),
        multiple_of("price", 0.01), one_of("currency", ["EUR"]),
        at_least("qty", 0), one_of("synthetic", [True]),
        unless_null("source", one_of("source", ["template", "dummyjson"])),
        unless_null("rating", between("rating", 0.0, 5.0)),
        unless_null("review_count", at_least("review_count", 0)),
        present("updated_at"),
    ]


def stock_event():
    return [
        one_of("type", ["sale", "restock", "new_item"]),
        matches("shop_id", SHOP_ID), present("shop_name"), matches("sku", SKU),
        present("name"), at_least("qty_now", 0), present("ts"),
        unless_null("sold", at_least("sold", 1)),
        unless_null("added", at_least("added", 1)),
    ]


def snapshot():
    return [
        uuid("id"), filled("keyword"), filled("geo"), filled("timeframe"),
        filled("provider"), present("captured_at"), present("series"),
        every("series", "bad date", lambda p: p["date"].rlike(r"^\d{4}-\d{2}-\d{2}$")
              & p["date"].try_cast("date").isNotNull()),
        every("series", "negative value", lambda p: p["value"] >= 0),
        unless_null("region_breakdown", every(
            "region_breakdown", "bad value",
            lambda p: (F.length(p["region"]) >= 1) & p["value"].between(0, 100))),
    ]


def signal():
    return [
        uuid("id"), filled("keyword"), filled("geo"), filled("timeframe"),
        date("window_start"), date("window_end"), at_least("interest_avg", 0.0),
        present("delta_pct"), one_of("direction", ["rising", "falling", "flat"]),
        at_least("rank", 1), one_of("confidence", vocab.CONFIDENCE_ORDER),
        every("snapshot_ids", "not a uuid", lambda x: x.rlike(UUID)),
        present("computed_at"),
    ]


def recommendation():
    return [
        uuid("id"), uuid("store_id"), uuid("signal_id"), filled("headline"),
        filled("body"), one_of("action", ["stock_up", "feature_in_window", "watch"]),
        one_of("confidence", vocab.CONFIDENCE_ORDER), filled("caveat"),
        present("created_at"),
    ]


def rising():
    return [
        uuid("id"), filled("parent_keyword"), filled("query"),
        present("is_breakout"), filled("geo"), present("gprop"),
        present("captured_at"), date("captured_date"),
    ]


def intent():
    return [
        one_of("status", ["ok", "incomplete"]), filled("raw_query"),
        only_if(F.col("status") == "ok", items("keywords", at_least_one=True)),
        only_if(F.col("status") == "ok", items("category_hints", vocab.CATEGORIES)),
        only_if(F.col("status") == "ok", absent("missing_fields")),
        only_if(F.col("status") == "incomplete",
                items("missing_fields", at_least_one=True, unique=False)),
        only_if(F.col("status") == "incomplete", absent("keywords")),
    ]




def violations(rules):
    """Messages of the rules that do not hold; a null test does not hold."""
    return F.array_compact(F.array(*[
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(message))
        for message, ok in rules]).cast("array<string>"))


def check(df: DataFrame, rules) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def observed(df: DataFrame, rules, observation) -> DataFrame:
    """`check`, counting rows, valid rows and breaches of each rule as the rows pass.

    The counts are in `observation` when the first action on the result is done, without
    another scan; rule i of the list is `rule_i`.
    """
    checked = check(df, rules)
    counts = [F.count_if(F.array_contains("violations", message)).alias(f"rule_{i}")
              for i, (message, _) in enumerate(rules)]
    return checked.observe(observation, F.count(F.lit(1)).alias("rows"),
                           F.count_if(F.size("violations") == 0).alias("valid"), *counts)


def store_checked(df: DataFrame, rules, path):
    """Writes valid rows under `valid=true` and the others, with what they break, under
    `valid=false`, in one pass; returns `rule, rows`: all, valid, quarantined, each rule."""
    seen = Observation()
    (observed(df, rules, seen).withColumn("valid", F.size("violations") == 0)
     .write.mode("overwrite").partitionBy("valid").parquet(path))
    got = seen.get
    report = [("rows", got["rows"]), ("valid", got["valid"]), ("quarantined", got["rows"] - got["valid"])]
    report += [(message, got[f"rule_{i}"]) for i, (message, _) in enumerate(rules)]
    return df.sparkSession.createDataFrame(report, "rule string, rows long")


def valid_rows(df, rules):
    return check(df, rules).filter(F.size("violations") == 0).drop("violations")


def quarantined(df, rules):
    return check(df, rules).filter(F.size("violations") > 0)


def enforce(df, rules):
    """Fail the job on the first row that breaks the contract."""
    bad = F.array_join(violations(rules), "; ")
    ok = F.when(F.length(bad) > 0, F.raise_error(bad)).otherwise(F.lit(True))
    return df.filter(F.coalesce(ok.cast("boolean"), F.lit(True)))


def missing_fields(df, required, out="missing_fields"):
    """Names of the required columns that are null in the row."""
    return df.withColumn(out, F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in required])))


def missing_over(df, keys, required):
    """Required fields some row of the group lacks, in the declared order."""
    flags = [F.max(F.col(c).isNull()).alias(c) for c in required]
    grouped = df.groupBy(*keys).agg(*flags)
    return grouped.select(*keys, F.array_compact(F.array(*[
        F.when(F.col(c), F.lit(c)) for c in required])).alias("missing_fields"))
