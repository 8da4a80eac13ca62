"""Joins on distance and place names."""

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, text, vocab
from ..session import cut_lineage

CROWDED = 2_000  # places in a cell from which it is split
PAIRS = 1_000_000  # centres times places of one key in one share of the join
LEVELS = 12  # halvings at most; what still stands together is dealt into parts


def _met(c, p, key, pairs):
    """Join on `key`, where each key has shares by measured counts: few bytes make many pairs,
    so neither the tasks nor their number may follow the bytes. Places go to every share of
    their key, a centre to one."""
    count = F.count(F.lit(1))
    sizes = c.groupBy(*key).agg(count.alias("_nc")).join(p.groupBy(*key).agg(count.alias("_np")), key)
    sizes = sizes.select(*key, F.ceil(F.col("_nc") * F.col("_np") / pairs).cast("int").alias("_shares"))
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # merged: a centre has a row per cell here, which Spark's estimate of its size leaves out, and
    # broadcast whole the centres pass through the driver
    dealt = c.join(sizes.hint("merge"), key).withColumn("_share", F.pmod(F.xxhash64(*c.columns), F.col("_shares")).cast("int"))
    every = p.join(sizes, key).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    # both sides, as either may be the one that is broadcast
    dealt, every = (side.drop("_shares").repartition(parts, *key, "_share") for side in (dealt, every))
    return dealt.join(every, [*key, "_share"]).drop(*key, "_share")


def _distances(met, radius_km):
    distance = geo.haversine_km("_clat", "_clng", "_plat", "_plng")
    return met.withColumn("distance_km", distance).filter(F.col("distance_km") <= radius_km)


def quad_leaves(places, grid, crowded=CROWDED, levels=LEVELS):
    """(`places` with their leaf, leaves with the grid cell they lie in).

    A quadtree below each cell of the grid, from measured counts: a node with more than
    `crowded` places is split in four, down to `levels`; a leaf that is still too full,
    because its places stand on one spot, is dealt into `_parts`. Only counts of occupied
    cells travel up the tree.
    """
    row, column = grid.place_at(levels, "lat", "lng")
    p = places.withColumns({"_row": row, "_column": column})
    fine = ["_row", "_column"]
    cells = cut_lineage(p.groupBy(*fine).agg(F.count(F.lit(1)).alias("_n")))
    up = cells.select(*fine, "_n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))

    node = ["_level", "_nrow", "_ncolumn"]
    up = up.withColumns({"_nrow": F.expr(f"shiftright(_row, {levels} - _level)"),
                         "_ncolumn": F.expr(f"shiftright(_column, {levels} - _level)")})
    counts = up.groupBy(*node).agg(F.sum("_n").alias("_total"))
    split = counts.filter((F.col("_total") > crowded) & (F.col("_level") < levels)).select(*node)
    # the nodes above a cell that are split are the first ones, so their number is its leaf's level
    depth = up.join(split, node, "left_semi").groupBy(*fine).agg(F.count(F.lit(1)).cast("int").alias("_level"))
    leaf_of = cells.join(depth, fine, "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    leaf_of = leaf_of.withColumns({"_nrow": F.expr(f"shiftright(_row, {levels} - _level)"),
                                   "_ncolumn": F.expr(f"shiftright(_column, {levels} - _level)")})
    leaf_of = cut_lineage(leaf_of.join(counts, node).withColumn("_parts", F.ceil(F.col("_total") / crowded).cast("int"))
                          .select(*fine, *node, "_parts"))
    leaves = leaf_of.select(*node, "_parts").distinct().withColumn(
        "_cell", F.expr("shiftright(_nrow, _level)") * F.lit(grid.columns) + F.expr("shiftright(_ncolumn, _level)"))
    return p.join(leaf_of, fine).drop(*fine), leaves


def radius_join(centres: DataFrame, places: DataFrame, radius_km, *,
                place_id="shop_id", crowded=CROWDED, pairs=PAIRS) -> DataFrame:
    """Every place within the radius of every centre, with `distance_km`.

    An equi join on grid cells with the exact test after it, so no pair outside
    neighbouring cells is formed. Where a cell holds more than `crowded` places the grid is
    refined there (`quad_leaves`): no key of the join has more places than that, and a
    centre meets only the leaves its bounding box touches. The pairs grow with the product of
    both tables; they are shared out by about `pairs`, however many centres stand together.
    """
    grid = geo.Grid(radius_km)
    known = places.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    cells = known.groupBy(grid.cell("lat", "lng").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    c = centres.withColumn("_cell", F.explode(grid.cells_around("lat", "lng")))
    if (cells.agg(F.max("_n")).first()[0] or 0) <= crowded:
        p = known.withColumn("_cell", grid.cell("lat", "lng")).withColumnsRenamed({"lat": "_plat", "lng": "_plng"})
        c = c.withColumnsRenamed({"lat": "_clat", "lng": "_clng"})
        return _distances(_met(c, p, ["_cell"], pairs), radius_km)
    p, leaves = quad_leaves(known, grid, crowded)
    key = ["_level", "_nrow", "_ncolumn", "_part"]
    p = p.withColumn("_part", F.pmod(F.xxhash64(place_id), F.col("_parts")).cast("int")).drop("_parts") \
        .withColumnsRenamed({"lat": "_plat", "lng": "_plng"})
    c = c.join(leaves.hint("merge"), "_cell").filter(grid.touches(
        F.col("_level"), F.col("_nrow"), F.col("_ncolumn"), F.col("lat"), F.col("lng"))).drop("_cell")
    c = c.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts") \
        .withColumnsRenamed({"lat": "_clat", "lng": "_clng"})
    return _distances(_met(c, p, key, pairs), radius_km)


def nearest_region(shops, regions, cap_km=vocab.REGION_CAP_KM):
    """Shops with the closest region centroid; null beyond the cap.

    Only regions inside the cap can win, so the radius join finds them all. A
    tie goes to the first region by name.
    """
    centres = regions.select("region_id", F.col("name").alias("_rname"), "lat", "lng")
    met = radius_join(centres, shops.select("shop_id", "lat", "lng"), cap_km)
    best = met.groupBy("shop_id").agg(
        F.min(F.struct("distance_km", "_rname", "region_id")).alias("_b"))
    out = shops.drop("region_id").join(best, "shop_id", "left")
    return out.select(*[c for c in shops.columns if c != "region_id"],
                      F.col("_b.region_id").alias("region_id"),
                      F.col("_b.distance_km").alias("region_km"))


def assignment_totals(assigned):
    return assigned.agg(F.count("region_id").alias("assigned"),
                        F.count_if(F.col("region_id").isNull()).alias("unassigned"))


def _by_folded_name(places, lat, lng):
    """One point per folded name, the first by name."""
    return (places
            .select(text.fold_compatible(text.strip("name")).alias("_place"), "name",
                    F.col("lat").alias(lat), F.col("lng").alias(lng))
            .groupBy("_place").agg(F.min(F.struct("name", lat, lng)).alias("_g"))
            .select("_place", f"_g.{lat}", f"_g.{lng}"))


def resolve_centres(searches, gazetteer, default=vocab.DEFAULT_CENTRE, regions=None, geocodes=None):
    """Coordinates, else the named place, else the default centre.

    A search may carry, beside `lat, lng` and the place its text names (`location_text`):
    `near`, a place that goes before the text's, also when it is empty; and `region_id`,
    looked up in `regions`, which gives coordinates and goes with nothing else. A place is
    looked up in the gazetteer, then in `geocodes` (`name, lat, lng`: what a geocoder has
    answered before). A name that neither has makes the search `incomplete`; it never falls
    back to the default. `conflict`: half a coordinate pair, or a region with coordinates or
    `near`; `unknown_region`: a region that is not listed.
    """
    def given(name, kind="string"):
        return F.col(name) if name in searches.columns else F.lit(None).cast(kind)
    s = searches.withColumns({"_near": given("near"), "_region": given("region_id")})
    if regions is None:
        s = s.withColumns({"_rlat": F.lit(None).cast("double"), "_rlng": F.lit(None).cast("double")})
    else:
        s = s.join(regions.select(F.col("region_id").alias("_region"), F.col("lat").alias("_rlat"),
                                  F.col("lng").alias("_rlng")).dropDuplicates(["_region"]), "_region", "left")
    pair = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    half = F.col("lat").isNotNull() != F.col("lng").isNotNull()
    by_region = F.col("_region").isNotNull()
    conflict = half | (by_region & (F.col("lat").isNotNull() | F.col("lng").isNotNull() | F.col("_near").isNotNull()))
    place = F.coalesce("_near", "location_text")
    named = F.coalesce(F.length(place) > 0, F.lit(False)) & ~by_region & ~pair
    s = s.withColumn("_place", F.when(named, text.fold_compatible(text.strip(place))))
    s = s.join(_by_folded_name(gazetteer, "_glat", "_glng"), "_place", "left")
    if geocodes is None:
        s = s.withColumns({"_nlat": F.lit(None).cast("double"), "_nlng": F.lit(None).cast("double")})
    else:
        s = s.join(_by_folded_name(geocodes, "_nlat", "_nlng"), "_place", "left")
    status = (F.when(conflict, "conflict")
              .when(by_region & F.col("_rlat").isNull(), "unknown_region")
              .when(named & F.coalesce("_glat", "_nlat").isNull(), "incomplete").otherwise("ok"))
    how = F.when(status != "ok", F.lit(None).cast("string")).when(by_region | pair, "coordinates").when(
        F.col("_glat").isNotNull(), "gazetteer").when(F.col("_nlat").isNotNull(), "geocode").otherwise("default_center")

    def point(c, at):
        return F.when(by_region, F.col(f"_r{c}")).when(pair, F.col(c)).when(
            how == "default_center", F.lit(at)).otherwise(F.coalesce(f"_g{c}", f"_n{c}"))
    rest = [c for c in searches.columns if c not in ("lat", "lng")]
    return s.select(*rest, F.when(status == "ok", point("lat", default[0])).alias("lat"),
                    F.when(status == "ok", point("lng", default[1])).alias("lng"),
                    how.alias("resolved_from"), status.alias("centre_status"))


def match_barrio(c, barrios=vocab.BARRIOS):
    """Canonical barrio of a free text: exact, else first one named in it."""
    listed = F.array(*[F.struct(F.lit(text.folded_constant(b)).alias("f"),
                                F.lit(b).alias("b")) for b in barrios])

    def named_in(folded):
        exact = F.filter(listed, lambda x: x["f"] == folded)
        named = F.filter(listed, lambda x: F.contains(folded, x["f"]))
        return F.coalesce(F.get(exact, F.lit(0))["b"], F.get(named, F.lit(0))["b"])
    return text.let(text.strip(text.fold_compatible(c)), named_in)
