"""Personal data by patterns, and the words that give it away by what the corpus tells.

Everything is DataFrame expressions. The base spans are e-mail addresses, IP addresses, card
and phone numbers. Each distinct one is a protected entity. How strongly a word near an
entity reveals it is estimated from the whole corpus: the pointwise mutual information of
the two, as a share of the information of the entity itself.
"""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir

# Fixed: the patterns of the base spans. Possessive where nothing can be given back, and a
# run is only entered at its start or where the last match ended, so long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
TERM = r"[\p{L}\p{M}\p{N}_]+"

NEAR_WORDS = 8  # on each side of an entity
NEAR_CHARS = 160  # in which they are looked for
SUPPORT = 3  # different surroundings in which a word must stand near the entity
DIVERSITY = 0.5  # share of their common occurrences that these must make up: copies tell nothing new
GENERALISED, REMOVED = 0.75, 0.9  # disclosure from which a word is generalised, or removed
SUMS = 64  # numbers summed in one step of a running sum

SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _let(value, body):
    """Evaluate `value` once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers):
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _sums_before(numbers):
    """Running sums without the number itself, in two levels, so long arrays stay cheap."""
    first = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / SUMS).cast("int")),
                        lambda b: _sum(F.slice(numbers, b * SUMS + 1, SUMS)))
    bases = _let(first, lambda sums: F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b))))
    return _let(bases, lambda base: F.transform(numbers, lambda _, i: F.get(base, F.floor(i / SUMS).cast("int"))
                                                + _sum(F.slice(numbers, i - i % SUMS + 1, i % SUMS))))


def located(text, pattern, make):
    """`make(match, start, text before up to the last match, text after)` for each match.

    The pieces between the matches give their places, in code points.
    """
    def with_pieces(found):
        def with_starts(pieces):
            lengths = F.transform(found, lambda v, i: F.char_length(v) + F.char_length(F.get(pieces, i)))
            return _let(_sums_before(lengths), lambda sums: F.transform(found, lambda v, i: make(
                v, F.get(sums, i) + F.char_length(F.get(pieces, i)), F.get(pieces, i), F.get(pieces, i + 1))))
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), with_starts))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_pieces)


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    def weighed(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return _sum(F.transform(F.sequence(F.lit(1), F.char_length(digits)), weighed)) % 10 == 0


def _valid(kind, value):
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.char_length(d).between(*CARD_DIGITS), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(*PHONE_DIGITS)
    return F.lit(True)


def base_spans(text):
    """Valid matches of all kinds, by kind and place, with the text beside them."""
    def of(kind, pattern):
        def span(v, start, before, after):
            # a word that the cut has torn goes
            left = F.when(F.char_length(before) > NEAR_CHARS, F.regexp_replace(F.substring(before, -NEAR_CHARS, NEAR_CHARS), f"^{TERM}", "")).otherwise(before)
            right = F.when(F.char_length(after) > NEAR_CHARS, F.regexp_replace(F.substring(after, 1, NEAR_CHARS), f"{TERM}$", "")).otherwise(after)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(v)).alias("end"),
                            v.alias("value"), left.alias("before"), right.alias("after"))
        found = F.filter(F.coalesce(located(text, pattern, span), F.array().cast(f"array<{SPAN}>")), lambda s: _valid(kind, s["value"]))
        if kind == "email":
            found = F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast(f"array<{SPAN}>"))
        return found
    return F.concat(*[of(k, p) for k, p in PATTERNS.items()])


def _near(span):
    """The words around an entity, in lower case."""
    def words(side):
        return F.transform(F.regexp_extract_all(side, F.lit(TERM), F.lit(0)), F.lower)
    left = _let(words(span["before"]), lambda w: F.slice(w, F.greatest(F.size(w) - (NEAR_WORDS - 1), F.lit(1)), NEAR_WORDS))
    return F.concat(left, F.slice(words(span["after"]), 1, NEAR_WORDS))


def _entity(span):
    """Numbers by their digits, everything else in lower case."""
    number = span["kind"].isin("card", "phone")
    return F.concat_ws(":", span["kind"], F.when(number, _digits(span["value"])).otherwise(F.lower(span["value"])))


def occurrences(base):
    """(text_key, entity, words) for every base span."""
    return base.select("text_key", F.explode("found").alias("s")) \
        .select("text_key", _entity(F.col("s")).alias("entity"), _near(F.col("s")).alias("words"))


def term_counts(docs):
    """How often each word stands in the corpus."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("w")) \
        .groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n_term"))


def disclosing(seen, counts, n_terms, support=SUPPORT, diversity=DIVERSITY, least=GENERALISED):
    """(entity, term, disclosure) of words that reveal an entity.

    The information of an entity is -log2 of the share of places in the corpus that are
    near it. A word near it reveals log2(share of the word's places that are near the
    entity / that share); disclosure is the latter over the former, 1 for a word that
    stands nowhere else.
    """
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = seen.select("entity", F.sha2(F.array_join("words", " "), 256).alias("around"),
                        F.explode(F.array_distinct("words")).alias("term")) \
        .groupBy("entity", "term", "around").agg(F.count("*").alias("n")) \
        .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_around")) \
        .where((F.col("n_around") >= support) & (F.col("n_around") >= F.col("n_both") * diversity))
    share = F.lit(2.0 * NEAR_WORDS) * F.col("n_entity") / F.lit(float(max(n_terms, 1)))
    own = -F.log2(share)
    return pairs.join(entities, "entity").join(counts, "term").where(share < 1) \
        .select("entity", "term", (F.lit(1.0) + F.log2(F.least("n_both", "n_term") / F.col("n_term")) / own).alias("disclosure")) \
        .where(F.col("disclosure") >= least)


def _told(text, terms, found, removed):
    """Spans of the words of a text that reveal its entities, outside base spans."""
    made = located(text, TERM, lambda v, start, *_: F.struct(
        start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"),
        F.element_at(terms, F.lower(v)).alias("disclosure")))
    own = F.filter(made, lambda s: s["disclosure"].isNotNull() & ~F.exists(
        found, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.transform(own, lambda s: F.struct(
        F.when(s["disclosure"] >= removed, "removed").otherwise("generalised").alias("kind"),
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _replacement(span):
    word = F.when(span["value"].rlike(r"^\p{Lu}"), "[NAME]").when(span["value"].rlike(r"\p{N}"), "[NUMBER]").otherwise("[WORD]")
    return F.when(span["kind"] == "removed", "").when(span["kind"] == "generalised", word) \
        .otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))


def _sanitised(text, spans):
    """The text with every span replaced; overlapping spans are one, named by the first."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done, span):
        new = F.array(F.substring(text, done["at"] + 1, span["start"] - done["at"]), _replacement(span))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"),
                        F.when(span["start"] >= done["at"], F.concat(done["parts"], new)).otherwise(done["parts"]).alias("parts"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    return _let(F.aggregate(by_place, empty, step), lambda done: F.concat(
        F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.char_length(text))))


def sanitise(docs, id_col="doc_id", text_col="text", with_text=False, support=SUPPORT, diversity=DIVERSITY,
             generalised=GENERALISED, removed=REMOVED):
    """Personal data of every whole text, and the words around it that disclose it.

    Base spans are found by pattern, leftmost and without overlap inside a kind; a match
    that fails its check (parts of an address above 255, number of digits, Luhn) is
    dropped. Then each word within 8 words of an entity is judged by its disclosure over
    the whole corpus (`disclosing`): from `generalised` on it is replaced by its class,
    from `removed` on it goes, wherever it stands in that document outside base spans.
    It must stand near the entity in `support` different surroundings that make up
    `diversity` of their common occurrences, so a group of copies tells nothing. Documents
    without base spans protect nothing and are left alone.

    Returns doc_id, base (array of kind, start, end: code points, end exclusive; by kind
    in the order email, ip, card, phone, then place), spans (the base, then kinds
    generalised and removed) and, `with_text`, sanitised. One row per input row; a null
    text is empty; a null doc_id stays null; equal rows each return; an empty table gives
    no rows; other columns are left out. Base spans (with the text where there are any, or
    always `with_text`) and word counts lie in the folder of spark.checkpoint.dir, the
    caller removes them.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, f"sanitise/{uuid.uuid4().hex}")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"),
                        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    private = F.size("found") > 0
    texts.select("doc_id", "text", base_spans(F.col("text")).alias("found")) \
        .select("doc_id", "found", F.when(private | F.lit(with_text), F.col("text")).alias("text"),
                F.when(private, F.sha2(F.col("text").cast("binary"), 256)).alias("text_key")) \
        .write.parquet(f"{folder}/base")
    base = spark.read.parquet(f"{folder}/base")
    term_counts(texts).write.parquet(f"{folder}/terms")
    counts = spark.read.parquet(f"{folder}/terms")
    n_terms = counts.agg(F.sum("n_term")).first()[0] or 0

    seen = occurrences(base.where("text_key IS NOT NULL"))
    judged = disclosing(seen, counts, n_terms, support, diversity, generalised)
    told = seen.select("text_key", "entity", F.explode("words").alias("term")).distinct().join(judged, ["entity", "term"]) \
        .groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure")) \
        .groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))

    kind = "array<struct<kind:string,start:int,end:int,value:string>>"
    plain = base.where("text_key IS NULL").select("doc_id", "text", F.array().cast(kind).alias("base"), F.array().cast(kind).alias("more"))
    own = base.where("text_key IS NOT NULL").join(told, "text_key", "left").select(
        "doc_id", "text", F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).cast(kind).alias("base"),
        F.coalesce(F.when(F.col("terms").isNotNull(), _told(F.col("text"), F.col("terms"), F.col("found"), removed)),
                   F.array().cast(kind)).cast(kind).alias("more"))
    every = F.concat(F.col("base"), F.array_sort("more"))
    rows = plain.unionByName(own).select("doc_id", "text", "base", every.alias("spans"))
    cut = {c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(c)
           for c in ("base", "spans")}
    shown = rows.select("doc_id", cut["base"], cut["spans"], _sanitised(F.col("text"), F.col("spans")).alias("sanitised"))
    return shown if with_text else shown.drop("sanitised")


def span_list(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
