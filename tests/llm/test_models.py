import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercata.llm import language, neighbours, queries, rules
from mercata.session import ship

from . import helpers as h

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return h.with_clashes(spark, h.odd_documents())


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in queries.documents(spark, SF).collect()}
    assert rows.keys() == truth.keys()
    held = [d for d in truth if h.crc_fold(d, 4) == 2]
    assert all(rows[d].held_out == (d in set(held)) for d in truth)
    assert np.mean([rows[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert sum(r.rejected for r in rows.values()) == 0


@pytest.fixture(scope="module")
def model(spark):
    ship(spark)
    return queries.language_model(queries.documents(spark, SF))


def test_languages_of_odd_documents(docs, model):
    got = language.identify(docs, model).collect()
    assert len(got) == len(h.odd_documents())
    texts = collections.defaultdict(list)
    for i, t, *_ in h.odd_documents():
        texts[i].append(t)
    for r in got:
        lettered = any(c.isalpha() for t in texts[r.doc_id] for c in t or "")
        assert (r.lang_pred != "und") == lettered
        assert r.rejected or lettered


def test_foreign_text_is_rejected(spark, model):
    rows = [(1, "zxqj vkwz qqpx zzkj wvxq jjkq zzxv qkjx"), (2, "日本語のテキストはここにあります"), (3, "12 !!")]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in found)
    kept = language.in_known_language(queries.documents(spark, SF), model)
    assert kept.columns == queries.documents(spark, SF).columns and kept.count() == 1000


def test_kneser_ney_sums_to_one():
    grams = np.array([0x20002000200061 + i for i in range(5)], np.uint64)
    grams = np.concatenate([grams, grams + np.uint64(1 << 16), np.array([0x61006200630064], np.uint64)])
    model = language.LanguageModel(np.unique(grams), np.arange(1, len(np.unique(grams)) + 1))
    history = np.uint64(0x2000200020) << np.uint64(16)
    keys = history + np.arange(language.ALPHABET, dtype=np.uint64)
    assert abs(np.exp(model.log_probabilities(keys)).sum() - 1) < 1e-9


def plain_kneser_ney(counts):
    """Chance of a 4-character tuple by interpolated Kneser-Ney with one discount per order."""
    tables, weights = {}, dict(counts)
    for order in range(4, 0, -1):
        once, twice = (sum(w == n for w in weights.values()) for n in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = collections.Counter(), collections.Counter()
        for gram, w in weights.items():
            total[gram[:-1]] += w
            kinds[gram[:-1]] += 1
        tables[order] = dict(weights), total, kinds, discount
        weights = collections.Counter(gram[1:] for gram in weights)

    def chance(gram):
        p = 1 / language.ALPHABET
        for order in range(1, 5):
            own, (w, total, kinds, discount) = gram[4 - order:], tables[order]
            history = own[:-1]
            share = (w[own] - discount) / total[history] if own in w else 0.0
            p = share + (discount * kinds[history] / total[history] if history in total else 1.0) * p
        return p
    return chance


def test_entropies_equal_a_plain_model():
    """Scores of texts in two languages against plain dictionaries."""
    rng = np.random.default_rng(6)

    def text(letters, n):
        return "".join(rng.choice(list(letters), n))

    def grams(t):
        line = "   " + re.sub(r"[^a-z]+", " ", t).lstrip() + (" " if t and t[-1].isalpha() else "")
        return [tuple(line[i - 3:i + 1]) for i in range(3, len(line))]
    learned = {"x": [text("aabbc d", 60) for _ in range(30)], "y": [text("ccdde f", 60) for _ in range(30)]}
    models, plain = [], []
    for texts in learned.values():
        packed = np.concatenate([g for _, g, _ in language.grams_of(pa.array(texts))])
        models.append(language.LanguageModel(*np.unique(packed, return_counts=True)))
        plain.append(plain_kneser_ney(collections.Counter(g for t in texts for g in grams(t))))
    asked = [text("abcdef ", n) for n in (1, 5, 40)] + ["zzz", "a", "abc--def  g"]
    sizes, entropies = language.Scorer(models).entropies(pa.array(asked))
    for t, n, own in zip(asked, sizes, entropies, strict=True):
        assert n == len(grams(t))
        for p, e in zip(plain, own, strict=True):
            assert n == 0 or abs(e + sum(math.log(p(g)) for g in grams(t)) / n) < 1e-9


def test_model_keeps_all_grams_and_languages(spark):
    ship(spark)
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    weight = 1 / np.arange(1, 301)
    text = "".join(rng.choice(letters, 250_000, p=weight / weight.sum()))
    parts = [text[i:i + 5000] for i in range(0, len(text), 5000)]
    rows = [(i, t, "big") for i, t in enumerate(parts)] + [(1000 + i, "abc" * 3, f"l{i:03}") for i in range(205)]
    made = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), F.lit(False))
    assert made.languages == sorted({r[2] for r in rows})
    padded = collections.Counter()
    for t in parts:
        line = "   " + t + " "
        padded.update(line[i:i + 4] for i in range(len(line) - 3))
    assert len(padded) > 100_000
    keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in padded], np.uint64)
    want = language.LanguageModel(keys, np.array(list(padded.values())))
    got = made.models[made.languages.index("big")]
    for mine, own in zip(got.orders, want.orders, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(mine[::2], own[::2], strict=True))
        assert all(np.allclose(x, y, rtol=1e-12) for x, y in zip(mine[1::2], own[1::2], strict=True))
    once, twice = (sum(n == k for n in padded.values()) for k in (1, 2))
    assert once / (once + 2 * twice) != pytest.approx(0.5)
    total = sum(n for g, n in padded.items() if g[:3] == text[:3])
    first = np.uint64(sum(ord(c) << 16 * (3 - i) for i, c in enumerate(text[:4])))
    place = np.searchsorted(got.orders[3][0], language._hashed(np.array([first]), 4))[0]
    assert got.orders[3][1][place] == pytest.approx((padded[text[:4]] - once / (once + 2 * twice)) / total)


def test_calibration_rows_are_learned_and_spread_over_languages(spark):
    ship(spark)
    rng = np.random.default_rng(9)

    def text(letters):
        return "".join(rng.choice(list(letters + " "), 200))
    rows = [(i, text("abcdefgh"), "common", i % 2) for i in range(400)]
    rows += [(1000 + i, text("αβγδεζηθικλμνξοπρστυφχψω"), "rare", i % 2) for i in range(4)]
    rows += [(2000, text("бгджз"), "late", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part int")
    made = language.train(docs, F.col("part") == 0, F.col("part") == 1, calibration_rows=5)
    assert made.languages == ["common", "late", "rare"]
    both = language.train(docs, F.lit(True), F.lit(False))
    for mine, own in zip(made.models, both.models, strict=True):
        assert all(np.array_equal(x, y) for a, b in zip(mine.orders, own.orders, strict=True) for x, y in zip(a, b, strict=True))
    got = {r.doc_id: r for r in language.identify(docs, made).collect()}
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected for r in rows)


def test_nothing_to_learn_from(spark, docs):
    empty = spark.createDataFrame([], h.SCHEMA)
    model = language.train(empty, F.lit(True), F.lit(True))
    got = language.identify(docs, model).collect()
    assert {r.lang_pred for r in got} == {"und"} and all(r.rejected for r in got)
    assert language.identify(empty, model).collect() == []
    voters = neighbours.train(empty, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in neighbours.score(docs, voters).collect()} == {0.5}
    assert neighbours.score(empty, voters).collect() == []
    nothing = rules.learn(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing.rules == ()
    assert rules.judge(empty, nothing).collect() == []


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            again[i:i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), sum(again))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_statistics_of_odd_documents(docs):
    got = [(r.doc_id, *(r.stats[c] for c in NAMES)) for r in rules.judge(docs, rules.DecisionList(())).collect()]
    assert h.ordered(got) == h.ordered((i, *base(t)) for i, t, *_ in h.odd_documents())


def test_rules_query(spark):
    rows = queries.QUERIES["op4_quality_rules"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in rows} == {d: base(t) for d, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    plan = queries.QUERIES["op4_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    quality = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    good = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if quality.get(r.doc_id) == 0]
    assert np.mean([r.kept for r in good]) > 0.98
    assert np.mean([r.kept for r in bad]) < 0.1


def test_verdicts_equal_the_rules_in_python(spark):
    docs, labels = queries.documents(spark, SF), queries.table(spark, SF, "labels")
    learned = rules.learn(docs, labels)
    assert learned.rules

    def kept(s):
        def per(a, b):
            return round(a / b, 6) if b else 0.0
        if s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words:
            return False
        values = {"n_words": float(s.n_words), "word_length": per(s.word_chars, s.n_words),
                  "symbols_per_word": per(s.n_symbols, s.n_words), "dup_lines_per_line": per(s.n_dup_lines, s.n_lines),
                  "repeat_words_per_word": per(s.n_repeat_words, s.n_words), "distinct_per_word": per(s.n_distinct_words, s.n_words),
                  "upper_per_char": per(s.n_upper, s.word_chars), "bangs_per_word": per(s.n_bangs, s.n_words)}
        return not any(all(values[c.feature] >= c.cut if c.above else values[c.feature] < c.cut for c in rule)
                       for rule in learned.rules)
    rows = rules.judge(docs, learned).select("doc_id", "stats", "kept").collect()
    assert len(rows) == 1000 and [r.kept for r in rows] == [kept(r.stats) for r in rows]
    assert 0 < sum(r.kept for r in rows) < 1000


def test_classifier_takes_odd_documents(spark, docs):
    """Real voters; null, empty, long and repeated texts; extra columns with clashing names."""
    known, labels = queries.documents(spark, SF), queries.table(spark, SF, "labels")
    voters = neighbours.train(known, labels, F.lit(True))
    got = neighbours.score(docs, voters).collect()
    assert len(got) == len(h.odd_documents()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    assert by_id[14] == by_id[15] == by_id[16] == {round(voters.prior, 6)}
    assert len(by_id[31]) == 1 and abs(min(by_id[10]) - min(by_id[11])) < 1e-5
    assert neighbours.score(docs.limit(0), voters).collect() == []


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(2)
    table = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    quality = np.where((table["a"] > 0.8) | ((table["b"] < 0.2) & (table["c"] > 0.5)), 0, 1)
    made = rules.cover(table, quality, np.arange(600) % 3)
    caught = np.zeros(600, bool)
    for rule in made.rules:
        caught |= rules._holds(rule, table, 600)
    assert (caught == (quality == 0)).mean() > 0.95
    assert {c.feature for rule in made.rules for c in rule} >= {"a", "b"}


def test_classifier_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_quality_classifier"](spark, SF).collect()}
    quality = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    held = [d for d in quality if h.crc_fold(d, 5) == 0]
    assert all(rows[d].held_out for d in held) and len(rows) == 1000
    assert np.mean([rows[d].predicted == quality[d] for d in held]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    matrix = rng.random((40, neighbours.WORD_BUCKETS + neighbours.SHAPE_BUCKETS)).astype(np.float32)
    voters = neighbours.Voters(matrix, (np.arange(40) % 3 == 0).astype(float), 8)
    points = voters.project(matrix)
    got = voters.scores(matrix[:5], 7, 2.0)
    for i in range(5):
        cosine = sorted(((float(points[i] @ p), q) for p, q in zip(points, voters.quality, strict=True)), reverse=True)[:7]
        weight = [max(c, 0) ** 2 for c, _ in cosine]
        assert got[i] == pytest.approx(sum(w * q for w, (_, q) in zip(weight, cosine, strict=True)) / sum(weight), abs=1e-5)
