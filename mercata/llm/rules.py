"""Quality rules: learned decision lists over native text statistics.

Everything that touches documents is DataFrame expressions; learning works on the driver
on a bounded table of statistics of labelled rows.
"""

from typing import NamedTuple

import numpy as np
from pyspark.sql import functions as F

SPACE = "[\\x20\\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
REPEAT_WORDS = 8
LABELLED_ROWS = 20_000  # at most so many labelled rows are learned from
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 32
MIN_PRECISION, MIN_COVERED = 0.9, 5
MIN_WORDS, REPEAT_PERCENT = 20, 30


def _let(value, body):
    """Evaluate `value` once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words):
    """Words in windows that stand twice or more in the text, the first included."""
    n = F.size(words)
    hashes = F.when(n >= REPEAT_WORDS, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (REPEAT_WORDS - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(words, i, REPEAT_WORDS)))).otherwise(F.array().cast("array<bigint>"))

    def covered(found):
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(e):
            again = F.filter(e, lambda s, j: F.coalesce(F.get(e, j - 1)["h"] == s["h"], F.lit(False))
                             | F.coalesce(F.get(e, j + 1)["h"] == s["h"], F.lit(False)))
            return _let(F.array_sort(F.transform(again, lambda s: s["i"])), of_places)

        def of_places(places):
            gains = F.transform(places, lambda p, j: F.least(
                F.lit(REPEAT_WORDS), p - F.coalesce(F.get(places, j - 1), p - REPEAT_WORDS)))
            return F.aggregate(gains, F.lit(0), lambda a, b: a + b)
        return _let(ordered, of_sorted)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def statistics(docs, text_col="text"):
    """`docs` with a struct `stats` of native counts of the whole text; null is empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words,
    n_upper, n_bangs and n_lines, all long.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.struct("*").alias("row")
    split = docs.select(own, text.alias("text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\t\\n\\x0B\\f\\r]"))
    words = F.col("words")
    counted = split.select("row", F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines")).alias("stats"))
    return counted.select("row.*", "stats") if docs.columns else counted.select("stats")


def features(stats):
    """Numbers that rules test, by name, as expressions over the struct of `statistics`."""
    def per(a, b):
        return F.round(F.coalesce(F.try_divide(stats[a], stats[b]), F.lit(0.0)), 6)
    return {
        "n_words": stats["n_words"].cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeat_words_per_word": per("n_repeat_words", "n_words"),
        "distinct_per_word": per("n_distinct_words", "n_words"),
        "upper_per_char": per("n_upper", "word_chars"),
        "bangs_per_word": per("n_bangs", "n_words"),
    }


class Condition(NamedTuple):
    feature: str
    above: bool  # value >= cut, else value < cut
    cut: float

    def test(self, table):
        return table[self.feature] >= self.cut if self.above else table[self.feature] < self.cut


class DecisionList(NamedTuple):
    """Ordered rules; the first whose conditions all hold rejects, otherwise a row stays."""
    rules: tuple  # of tuples of Condition

    def keeps(self, values):
        """Ordered Spark conditional expression over `features`."""
        verdict = None
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule:
                value = values[c.feature]
                holds = holds & ((value >= c.cut) if c.above else (value < c.cut))
            verdict = F.when(holds, F.lit(False)) if verdict is None else verdict.when(holds, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def _holds(rule, table, n):
    mask = np.ones(n, bool)
    for c in rule:
        mask &= c.test(table)
    return mask


def _grow(table, bad, weight, cuts, max_conditions):
    """Add the condition with the best information gain until no good row is covered."""
    rule, mask = [], np.ones(len(bad), bool)
    while len(rule) < max_conditions and (mask & ~bad).any():
        p, n = (weight * (mask & bad)).sum(), (weight * (mask & ~bad)).sum()
        best, chosen = 1e-9, None
        for name, places in cuts.items():
            value = table[name]
            for cut in places:
                for above in (True, False):
                    now = mask & ((value >= cut) if above else (value < cut))
                    q, m = (weight * (now & bad)).sum(), (weight * (now & ~bad)).sum()
                    if q:
                        gain = q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))
                        if gain > best:
                            best, chosen = gain, Condition(name, above, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        mask &= chosen.test(table)
    return rule


def _prune(rule, table, bad):
    """The shortest prefix that is best on rows the rule was not grown on."""
    def worth(size):
        mask = _holds(rule[:size], table, len(bad))
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return rule[:max(range(1, len(rule) + 1), key=lambda size: (worth(size), -size))] if rule else rule


def cover(table, quality, fold, max_rules=MAX_RULES, max_conditions=MAX_CONDITIONS, cuts=CUTS,
          min_precision=MIN_PRECISION, min_covered=MIN_COVERED):
    """Sequential covering of the rows with quality 0.

    Two thirds of the rows (fold 0 and 1) grow a rule, the rest prune it; a rule joins
    the list if enough of what it covers, on all rows, has quality 0. Covered rows are
    taken out before the next. Ties: the first feature by name order given, the lowest
    cut. Without labels of both kinds the list is empty and keeps everything.
    """
    bad = quality == 0
    left = np.ones(len(bad), bool)
    places = {}
    for name, value in table.items():
        found = np.unique(np.quantile(value, np.linspace(0, 1, cuts + 1))) if len(value) else np.zeros(0)
        mine = np.unique(np.quantile(value[bad], np.linspace(0, 1, cuts + 1))) if bad.any() else np.zeros(0)
        places[name] = np.unique(np.round(np.concatenate([found, mine]), 6))[1:]
    rules = []
    while len(rules) < max_rules:
        grow, prune = left & (fold < 2), left & (fold >= 2)
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        part = {name: value[grow] for name, value in table.items()}
        rule = _grow(part, bad[grow], np.ones(int(grow.sum())), places, max_conditions)
        rule = _prune(rule, {name: value[prune] for name, value in table.items()}, bad[prune])
        mask = left & _holds(rule, table, len(bad))
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        if not rule or p + n < min_covered or p < min_precision * (p + n):
            break
        rules.append(tuple(rule))
        left &= ~mask
    return DecisionList(tuple(rules))


def learn(docs, labels, id_col="doc_id", text_col="text", label_col="quality", labelled_rows=LABELLED_ROWS, **settings):
    """A DecisionList from the statistics of labelled documents.

    At most `labelled_rows` labels, the first by hash of their id, are joined with the
    documents and their statistics brought to the driver; rows with a null id or label
    or without a document are left out, and repeated labels count once each.
    """
    some = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_label")) \
        .where("_id IS NOT NULL AND _label IS NOT NULL") \
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(labelled_rows)
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    # broadcast: at most labelled_rows rows of two numbers
    known = statistics(texts.join(F.broadcast(some), "_id"), "_text")
    values = features(F.col("stats"))
    rows = known.select("_id", "_label", F.pmod(F.xxhash64("_id"), F.lit(3)).alias("_fold"),
                        *[v.alias(k) for k, v in values.items()]).orderBy("_id", "_label", *values).toPandas()
    table = {name: rows[name].to_numpy() for name in values}
    return cover(table, rows["_label"].to_numpy(), rows["_fold"].to_numpy(), **settings)


def judge(docs, rules, text_col="text"):
    """`docs` with the struct `stats`, base_failed and kept; one row per input row.

    base_failed: fewer than 20 words, or more than 30 percent of the words in repeated
    windows of eight. kept: false if base_failed, else whether no rule of the list holds.
    A null or empty text has no words and fails; equal rows give equal results; an empty
    table gives no rows. An input column named stats, base_failed or kept is replaced.
    """
    clash = [c for c in docs.columns if c in ("stats", "base_failed", "kept")]
    counted = statistics(docs.drop(*clash), text_col)
    s = F.col("stats")
    failed = (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * REPEAT_PERCENT)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.keeps(features(s))))
