"""Projections and row filters."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text, vocab


def allowed_columns(df: DataFrame, allowed) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def in_stock(df, qty="qty"):
    return df.filter(F.coalesce(F.col(qty), F.lit(0)) > 0)


def equal_where_given(df, **wanted):
    """Equality filters; a value of None means the filter was not asked for."""
    given = {c: v for c, v in wanted.items() if v is not None}
    return reduce(lambda d, cv: d.filter(F.col(cv[0]) == cv[1]), given.items(), df)


def category_gate(categories, hints):
    """Open without hints, else one shared category is needed."""
    c, h = text.col(categories), text.col(hints)
    return (F.coalesce(F.size(h), F.lit(0)) <= 0) | F.arrays_overlap(c, h)


def whole_word_match(keywords, *fields, fold=False):
    """A keyword equals a whole ASCII word of the fields.

    Without `fold` accented and multi-word keywords never match; that is the
    published behaviour.
    """
    if fold:
        found = text.tokens(F.concat_ws(" ", *fields))
        wanted = F.transform(text.col(keywords), text.fold_compatible)
    else:
        found = text.ascii_tokens(*fields)
        wanted = F.transform(text.col(keywords), F.lower)
    return F.arrays_overlap(found, wanted)


def inside_city(df, lat="lat", lng="lng"):
    return df.filter(F.col(lat).between(*vocab.LAT_BOUNDS)
                     & F.col(lng).between(*vocab.LNG_BOUNDS))


def drop_blank(df, column):
    return df.filter(text.strip(F.col(column).cast("string")) != "")


def closed_windows(signals, as_of):
    """Windows that ended before `as_of`; every window if none has ended."""
    closed = F.col("window_end") < F.lit(as_of).cast("date")
    any_closed = signals.agg(F.coalesce(F.max(closed), F.lit(False))).scalar()
    return signals.filter(closed | ~any_closed)


def in_tier(include="commercial"):
    if include not in ("commercial", "all"):
        raise ValueError(f"unsupported include: {include}")
    return F.lit(True) if include == "all" else F.col("relevance_tier") == "commercial"


def tier(board, include="commercial"):
    """Applied after clustering, never before."""
    return board.filter(in_tier(include))


def result_facets(results, category=None, in_stock_only=False):
    results = equal_where_given(results, category=category)
    return results.filter(F.col("stock_qty") > 5) if in_stock_only else results


def region_scope(events, region=None):
    """Events of one region; a null region belongs to no scope."""
    return equal_where_given(events, region_id=region)
