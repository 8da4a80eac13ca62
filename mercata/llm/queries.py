"""The registered queries: each operator over its whole table.

Ranked search has a SQL twin; the others need tokenizers, learned models, sorted suffixes
or transitive links. tests/llm compares all of them with brute force.
"""

from pyspark.sql import functions as F

from ..session import ship
from . import automata, counts, frames, hilbert, language, neighbours, ranking, rules, sanitise, sketch, suffixes, tiling, whitening

QUERIES, ORACLE = {}, {}


def query(name):
    def add(fn):
        def run(spark, sf):
            ship(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        return run
    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents")


def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def fold(column, folds):
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def language_model(docs):
    """Calibrated on fold 3 of four with models of folds 0 and 1, then learned on all three;
    fold 2 is held out."""
    part = fold(docs.doc_id, 4)
    return language.train(docs, part.isin(0, 1), part == 3)


@query("op1_language_id")
def op1(spark, sf):
    docs = documents(spark, sf)
    found = language.identify(docs, language_model(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
                        "lang_pred", "score", "rejected")


@query("op2_substring_dedup")
def op2(spark, sf):
    rows = automata.remove_repeated_words(documents(spark, sf), window=35)
    return rows.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_near_dedup")
def op3(spark, sf):
    return sketch.near_duplicates(documents(spark, sf), percent=75, size=5)


@query("op4_quality_rules")
def op4(spark, sf):
    docs = documents(spark, sf)
    judged = rules.judge(docs, rules.learn(docs, table(spark, sf, "labels")))
    return judged.select("doc_id", *[F.col("stats")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


@query("op5_decontamination")
def op5(spark, sf):
    found = tiling.contaminated(documents(spark, sf), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_tokens", "n_matched", "coverage",
                        F.size("tiles").alias("n_tiles"))


@query("op6_packing")
def op6(spark, sf):
    rows = hilbert.pack(documents(spark, sf), vocabulary(), end_id=1, sequence_tokens=2048)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                       "sequence_id", "offset")


@query("op7_suffix_array_dedup")
def op7(spark, sf):
    rows = suffixes.remove_repeated_bytes(documents(spark, sf), window=50)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_files")
def op8(spark, sf):
    folder = frames.new_folder(spark)
    frames.write_tokens(documents(spark, sf), folder, vocabulary(), end_id=2)
    return frames.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_token_counts")
def op9(spark, sf):
    return counts.token_counts(documents(spark, sf), vocabulary(), limit=2048)


@query("op10_quality_classifier")
def op10(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    voters = neighbours.train(docs, labels, fold(labels.doc_id, 5) != 0)
    scored = neighbours.score(docs, voters, cut=0.3)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op11_lexical_search")
def op11(spark, sf):
    return ranking.rank(documents(spark, sf), table(spark, sf, "benchmark"), top=50)


ORACLE["op11_lexical_search"] = r"""
WITH terms AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
postings AS (
  SELECT kind, id, term, count(*) AS tf
  FROM (SELECT kind, id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM terms) GROUP BY ALL),
lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM postings WHERE kind = 'd' GROUP BY id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, corpus WHERE kind = 'd' GROUP BY term),
scored AS (
  SELECT i.id AS item_id, p.id AS doc_id,
         sum(w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM postings i JOIN weights USING (term) JOIN postings p USING (term) JOIN lengths ON lengths.id = p.id, corpus
  WHERE i.kind = 'i' AND p.kind = 'd' GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scored WHERE score > 0) WHERE rank <= 50
"""


@query("op12_pii_sanitisation")
def op12(spark, sf):
    rows = sanitise.sanitise(documents(spark, sf))
    kinds = F.transform("base", lambda s: s["kind"])
    return rows.select("doc_id", *[(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
                                   for k in sanitise.PATTERNS],
                       F.sha2(sanitise.span_list("base").cast("binary"), 256).alias("base_sha256"),
                       sanitise.span_list("spans").alias("spans"))


@query("op13_embedding_whitening")
def op13(spark, sf):
    rows = whitening.whiten(table(spark, sf, "embeddings"), components=16)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
