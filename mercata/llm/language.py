"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import batches_of, forget, mix, slices

ORDER = 4
CALIBRATION_ROWS = 2_000  # distinct texts of a language
HASH_SHIFT = 52  # leaves 4096 buckets of hashes
ALPHABET = 4096  # the uniform model below the unigrams
SLICE = 1 << 18  # bytes of text; the arrays over it take about 100 times as much
SLICE_LANGUAGES = 64  # with more languages the slices shrink, as each has a score for every gram
CACHED_SCORES = 1_600_000  # grams times languages
LOWERED_ROWS = 1024
SHORT = 3.0  # nats: how far the mean of one character may stray
NONE = "und"

_LETTERS = []


def _letters():
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def letter_grams(offsets, data):
    """(packed 4-grams, first gram of each text): letters, other runs as one space.

    The text is in lower case already. It is read after three spaces and before one.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in code points
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = _letters()[points]
    first = np.zeros(len(points) + 1, bool)
    first[before] = True
    kept = letter.copy()
    kept[1:] |= letter[:-1] & ~first[1:-1]
    at = np.flatnonzero(kept)
    where = np.searchsorted(at, before)
    size = np.diff(where)
    last = np.zeros(len(size), bool)
    some = size > 0
    last[some] = letter[at[where[1:][some] - 1]]  # ends with a letter: one space follows
    size = size + last
    base = np.concatenate([[0], np.cumsum(size + ORDER - 1)])
    line = np.full(base[-1], 32, np.uint64)
    doc = np.repeat(np.arange(len(where) - 1), np.diff(where))
    place = base[doc] + ORDER - 1 + np.arange(len(at)) - where[doc]
    found = points[at]
    folded = np.where(found < 0x10000, found, 0xE000 + found % 0x1900)  # beyond 16 bits: private use
    line[place] = np.where(letter[at], folded, 32)
    starts = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(starts[-1]) + np.repeat(base[:-1] + ORDER - 1 - starts[:-1], size)
    grams = np.zeros(len(pick), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint64(16)) | line[pick - back]
    return grams, starts


def grams_of(column, limit=SLICE):
    """(first row, packed 4-grams, first gram of each text) for slices of a column."""
    for row in range(0, len(column), LOWERED_ROWS):
        for at, offsets, data in slices(pc.utf8_lower(column.slice(row, LOWERED_ROWS)), limit):
            yield row + at, *letter_grams(offsets, data)


def _totals(keys, weights):
    """(distinct keys, sum of weights, number of entries)"""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, weights, len(distinct)), np.bincount(inverse, minlength=len(distinct))


def _hashed(keys, order):
    return mix(keys + np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64)))


class LanguageModel:
    """One language: for each order a sorted array of gram hashes with discounted
    probabilities and a sorted array of history hashes with interpolation weights."""

    def __init__(self, grams, counts):
        self.orders = []
        keys, weight = grams, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            history = keys >> np.uint64(16)
            own, total, kinds = _totals(history, weight)
            once, twice = (weight == 1).sum(), (weight == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            share = (weight - discount) / total[np.searchsorted(own, history)]
            self.orders.append((*self._sorted(keys, order, share),
                                *self._sorted(own, order + ORDER, discount * kinds / total)))
            # lower orders count in how many different contexts a gram continues
            shorter = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            keys, _, weight = _totals(shorter, np.ones(len(keys)))
        self.orders.reverse()

    @staticmethod
    def _sorted(keys, order, values):
        hashes = _hashed(keys, order)
        by = np.argsort(hashes)
        return hashes[by], values[by]

    @staticmethod
    def _lookup(table, values, keys, missing):
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[place] == keys, values[place], missing)

    def log_probabilities(self, grams):
        chance = np.full(len(grams), 1.0 / ALPHABET)
        for order, (table, share, histories, weight) in enumerate(self.orders, 1):
            keys = grams & np.uint64((1 << 16 * order) - 1)
            chance = (self._lookup(table, share, _hashed(keys, order), 0.0)
                      + self._lookup(histories, weight, _hashed(keys >> np.uint64(16), order + ORDER), 1.0) * chance)
        return np.log(chance)


class Scorer:
    """Cross-entropies of texts in all languages; remembers grams it has scored."""

    def __init__(self, models):
        self.models = models
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.models)))

    def _scores(self, grams):
        if not self.models:
            return np.zeros((len(grams), 0))
        known = np.zeros(len(grams), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            known = self.keys[place] == grams
        if not known.all():
            if self.logs.size > CACHED_SCORES:
                self._forget()
                known[:] = False
            fresh = grams[~known]
            made = np.stack([m.log_probabilities(fresh) for m in self.models], 1)
            keys = np.concatenate([self.keys, fresh])
            by = np.argsort(keys)
            self.keys, self.logs = keys[by], np.concatenate([self.logs, made])[by]
        return self.logs[np.searchsorted(self.keys, grams)]

    def entropies(self, column):
        """(number of characters, nats per character in each language) of each text."""
        sizes, found = [], []
        limit = SLICE * SLICE_LANGUAGES // max(len(self.models), SLICE_LANGUAGES)
        for _, grams, starts in grams_of(column, limit):
            size = np.diff(starts)
            total = np.zeros((len(size), len(self.models)))
            if len(grams):
                distinct, inverse = np.unique(grams, return_inverse=True)
                scores = self._scores(distinct)
                some = np.flatnonzero(size)
                for language in range(len(self.models)):
                    total[some, language] = np.add.reduceat(scores[inverse, language], starts[some])
            sizes.append(size)
            found.append(-total / np.maximum(size, 1)[:, None])
        if not sizes:
            return np.zeros(0, np.int64), np.zeros((0, len(self.models)))
        return np.concatenate(sizes), np.concatenate(found)


class Model:
    """Languages, their models, and the calibration of score and rejection."""

    def __init__(self, languages, models):
        self.languages, self.models = languages, models
        self.sharpness, self.limit = 20.0, None

    def calibrate(self, truth, sizes, entropies):
        """Fit the score's sharpness by likelihood and, for each language, the entropy
        above which a text is rejected: halfway between what its own texts have and
        what texts of the other languages have under its model."""
        n = len(self.languages)
        own = np.array([self.languages.index(t) if t in self.languages else -1 for t in truth])
        usable = (own >= 0) & (sizes > 0)
        own, entropies = own[usable], entropies[usable]
        if not len(own):
            return self
        grid = np.geomspace(1, 200, 40)
        self.sharpness = float(min(grid, key=lambda b: -np.log(np.maximum(
            self._posterior(entropies, b)[np.arange(len(own)), own], 1e-12)).sum()))
        clear = entropies.argmin(1) == own  # a wrong label says nothing about its language
        own, entropies = own[clear], entropies[clear]
        if not len(own):
            return self
        middle = entropies[np.arange(len(own)), own].mean()
        self.limit = np.empty(n)
        for i in range(n):
            mine, others = entropies[own == i, i], entropies[own != i, i]
            near = mine.mean() if len(mine) else middle
            far = others.mean() if len(others) else np.log(ALPHABET)
            self.limit[i] = near + max(far - near, 0.5) / 2
        return self

    @staticmethod
    def _posterior(entropies, sharpness):
        weight = np.exp(-sharpness * (entropies - entropies.min(1, keepdims=True)))
        return weight / weight.sum(1, keepdims=True)

    def verdicts(self, sizes, entropies):
        """(language index, score, entropy, rejected); index -1 without letters."""
        if not self.languages:
            return np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes)), np.ones(len(sizes), bool)
        best = entropies.argmin(1)
        least = entropies[np.arange(len(best)), best]
        score = self._posterior(entropies, self.sharpness).max(1)
        rejected = sizes == 0
        if self.limit is not None:
            # few characters say little: their mean may stray by its standard error
            rejected |= least > self.limit[best] + SHORT / np.sqrt(np.maximum(sizes, 1))
        return np.where(sizes > 0, best, -1), np.where(sizes > 0, score, 0.0), least, rejected


def _gram_counts(texts):
    """lang, gram, n, n_all of (text, lang, learn): each task adds up its own grams first.

    n is the count in the rows where `learn` holds, n_all in all rows.
    """
    def added(parts):
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, inverse = np.unique(keys, return_inverse=True)
        return [(distinct, np.bincount(inverse, n, len(distinct)).astype(np.int64))]

    def run(batches):
        held = {}
        for batch in batches:
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for row, grams, starts in grams_of(batch.column(0)):
                own = names[row:row + len(starts) - 1]
                kinds = {kind: i for i, kind in enumerate(dict.fromkeys(own))}
                of_gram = np.repeat(np.array([kinds[x] for x in own], np.int64), np.diff(starts))
                for kind, i in kinds.items():
                    mine = held.setdefault(kind, [])
                    mine.append(np.unique(grams[of_gram == i], return_counts=True))
                    if len(mine) > 8:
                        held[kind] = added(mine)
        for (language, learn), parts in held.items():
            (keys, n), = added(parts)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([language] * len(keys[part]), pa.string()),
                    "gram": pa.array(keys[part].view(np.int64)), "n": pa.array(n[part] * learn),
                    "n_all": pa.array(n[part])})
        forget()
    found = texts.mapInArrow(run, "lang string, gram long, n long, n_all long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _models(table, count):
    """(languages, models) of all gram counts in column `count`, in any order."""
    table = table.filter(pc.greater(table.column(count), 0))
    lang = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = pa.concat_arrays(lang.chunks) if lang.num_chunks else pa.array([], pa.string()).dictionary_encode()
    names = lang.dictionary.to_pylist()
    code = lang.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(names)))
    grams = table.column("gram").to_numpy().view(np.uint64)[order]
    n = table.column(count).to_numpy()[order]
    own = {}
    for name, end, size in zip(names, ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
        part = slice(end - size, end)
        by = np.argsort(grams[part])
        own[name] = LanguageModel(grams[part][by], n[part][by])
    languages = sorted(names)
    return languages, [own[x] for x in languages]


def train(docs, learn, calibrate, text_col="text", lang_col="lang",
          calibration_rows=CALIBRATION_ROWS):
    """Fit a Model on the rows where `learn` holds and calibrate it where `calibrate` does.

    The score and the limits are calibrated with models of the rows where `learn` holds
    alone, on at most `calibration_rows` distinct texts of each language, the first by
    hash; the models that are returned count the calibration rows too. All grams are
    counted, and the models of all languages keep every gram, so what the driver gathers
    and sends to the workers grows with their number. A language that only calibration
    rows have is named too; its limit is the entropy of the uniform model. One without
    calibration rows has a limit from the mean of the others. Rows with a null language
    or text are left out.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"),
                       F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.coalesce(calibrate, F.lit(False)).alias("calibrate")) \
        .where("text IS NOT NULL AND lang IS NOT NULL")
    table = _gram_counts(rows.where("learn OR calibrate").select("text", "lang", "learn")).toArrow()
    first, made = Model(*_models(table, "n")), Model(*_models(table, "n_all"))
    if first.languages and calibration_rows:
        found = _calibration(rows.where("calibrate"), first, calibration_rows).toArrow()
        sizes = found.column("size").to_numpy()
        entropies = found.column("entropies").combine_chunks()
        entropies = (entropies.flatten() if len(found) else pa.array([], pa.float64())).to_numpy()
        first.calibrate(found.column("lang").to_pylist(), sizes, entropies.reshape(len(sizes), len(first.languages)))
        made.sharpness = first.sharpness
        if first.limit is not None:
            own = dict(zip(first.languages, first.limit.tolist(), strict=True))
            made.limit = np.array([own.get(x, np.log(ALPHABET)) for x in made.languages])
    return made


def _calibration(rows, model, limit):
    """lang, size and entropies of the first `limit` distinct texts of each language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value.models)
        for batch in batches:
            sizes, entropies = scorer.entropies(batch.column(0))
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column(1), "size": pa.array(sizes, pa.int64()),
                "entropies": pa.array(list(entropies), pa.list_(pa.float64()))})
    # only numbers of hashes are added up and ordered; texts are fetched for the smallest
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("h")).withColumn("bucket", F.shiftright("h", HASH_SHIFT))
    size = hashed.select("lang", "bucket", "h").distinct().groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = size.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .where(F.col("before") < limit).groupBy("lang").agg(F.max("bucket").alias("last")).collect()
    bound = F.create_map([F.lit(x) for r in last for x in (r.lang, r["last"])]) if last else None
    some = hashed.where(F.col("bucket") <= F.element_at(bound, F.col("lang")) if last else F.lit(False)) \
        .groupBy("lang", "h").agg(F.min("text").alias("text"))
    by = Window.partitionBy("lang").orderBy("h")
    some = some.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return some.select("text", "lang").mapInArrow(run, "lang string, size long, entropies array<double>")


def identify(docs, model, id_col="doc_id", text_col="text"):
    """Language of every whole text: the model with the lowest cross-entropy per character.

    Returns doc_id, lang_pred, score (0 to 1, calibrated share of the chosen language),
    entropy (nats per character) and rejected, one row per input row, without a shuffle.
    A null text, or one without a letter, is `und` with score 0 and rejected; so is every
    row if nothing was learned. A text is also rejected, though its nearest language is
    still named, if its entropy is nearer to that of texts in other languages.
    Equal entropies: the first language by name. A null doc_id stays null; an empty
    table gives no rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        scorer = Scorer(known.models)
        names = np.array([*known.languages, NONE], object)
        for batch in batches:
            sizes, entropies = scorer.entropies(batch.column(1))
            best, score, entropy, rejected = known.verdicts(sizes, entropies)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "lang_pred": pa.array(names[best].tolist(), pa.string()),
                "score": pa.array(score, pa.float64()), "entropy": pa.array(entropy, pa.float64()),
                "rejected": pa.array(rejected, pa.bool_())})
        forget()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def in_known_language(docs, model, text_col="text"):
    """The rows of `docs`, all columns, whose text is not rejected; same rules."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        known = shared.value
        scorer = Scorer(known.models)
        for batch in batches:
            for part in batches_of(batch, 1024):
                rejected = known.verdicts(*scorer.entropies(part.column(at).cast(pa.string())))[3]
                yield part.filter(pa.array(~rejected))
        forget()
    return docs.mapInArrow(run, docs.schema)
