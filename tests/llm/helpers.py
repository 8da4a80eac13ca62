"""Small tables and plain Python versions of the contracts."""

import collections
import random
import re
import zlib

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_documents():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    shared = passage(rng, 60)
    base = passage(rng, 120)
    near = base.split()
    near[50] = "CHANGED"
    rows = [(10, base), (11, base), (12, " ".join(near)), (13, base.upper()), (14, None), (15, ""),
            (16, "  \n\t "), (17, "one two three"), (18, "One two three"), (19, "one two three"),
            (20, passage(rng, 30) + " " + shared + " " + passage(rng, 10)),
            (21, shared), (22, passage(rng, 3) + "\n" + shared.replace(" ", "  ")),
            (23, shared + " " + shared), (24, "ab " * 400), (25, "é日本" * 60), (26, "x" + "é日本" * 60),
            (27, passage(rng, 20_000)), (28, "z" * 100_000), (None, base), (None, passage(rng, 80)),
            (30, passage(rng, 90)), (30, passage(rng, 90)), (31, base), (31, base),
            (32, "<|endoftext|> a<|startoftext|>b don't İ ① Ａ हुआ"), (33, "\x1c\x85\xa0 x\x00y"),
            (34, "line one here\nline one here\nother\n\nline one here"), (35, "#a *b $c %d &e |f <g> h!!")]
    return [(i, t, "en" if n % 2 else None, None if n % 3 else "s", None if t is None else len(t))
            for n, (i, t) in enumerate(rows)]


def with_clashes(spark, rows):
    """The same rows with extra columns named like the operators' own."""
    names = ["chunk", "rest", "text_id", "low", "node", "band", "words", "stats", "row", "key", "kept", "_id", "_label"]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        docs = docs.selectExpr("*", f"'{name}' AS `{name}`")
    return docs


def repeated_words(rows, window):
    found = collections.Counter()
    for _, text in rows:
        w = words_of(text)
        found.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if found[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), kept.decode()))
    return out


def repeated_bytes(rows, window):
    first = {}
    last = 1 << 63
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            key = b[i:i + window]
            first[key] = min(first.get(key, last), last - 1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < (last - 1 if doc_id is None else doc_id):
                gone[i:i + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def near_groups(rows, percent=75, size=5):
    """doc_id -> (set size, component) for rows with distinct ids."""
    sets = {}
    for doc_id, text in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets[doc_id] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def ordered(rows):
    return sorted(rows, key=repr)


def patterned(n=1024):
    """Two different words of n letters that a polynomial modulo 2^64 confuses for any base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))
