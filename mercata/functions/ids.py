"""Name-based row ids: the same natural key always gives the same uuid."""

from pyspark.sql import Column, functions as F

from . import vocab
from .text import col


def uuid5(namespace, name) -> Column:
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))),
                   F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef",
                          "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3),
        F.lit("-"), F.substring(h, 21, 12))


def _key(*parts):
    return F.concat_ws("|", *[
        F.lit(p[1:]) if isinstance(p, str) and p.startswith("=")
        else col(p).cast("string") for p in parts])


def snapshot_id(keyword, geo, timeframe, captured_date):
    return uuid5(vocab.SIGNAL_NAMESPACE, _key(
        "=trend_snapshot", keyword, geo, timeframe, captured_date))


def signal_id(keyword, geo, timeframe, start, end):
    return uuid5(vocab.SIGNAL_NAMESPACE, _key(
        "=demand_signal", keyword, geo, timeframe, start, end))


def recommendation_id(store_id, signal):
    return uuid5(vocab.SIGNAL_NAMESPACE, _key("=recommendation", store_id, signal))


def rising_id(parent, query, geo, gprop, captured_date):
    return uuid5(vocab.RISING_NAMESPACE,
                 _key(parent, query, geo, gprop, captured_date))
