import collections
import hashlib
import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from mercata.llm import queries, sanitise

from . import helpers as h

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in RAW.items():
        for m in regex.finditer(pattern, text):
            digits = "".join(c for c in m.group() if "0" <= c <= "9")
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end(), m.group()))
    return out


def surroundings(text, kind, start, end):
    """The words beside a span, up to the next raw match of its kind."""
    matches = [m.span() for m in regex.finditer(RAW[kind], text)]
    left = text[max([b for _, b in matches if b <= start], default=0):start]
    right = text[end:min([a for a, _ in matches if a >= end], default=len(text))]
    if len(left) > sanitise.NEAR_CHARS:
        left = TERM.sub("", left[-160:], count=1) if TERM.match(left[-160:]) else left[-160:]
    if len(right) > sanitise.NEAR_CHARS:
        right = regex.sub(TERM.pattern + "$", "", right[:160])
    return [w.lower() for w in TERM.findall(left)][-8:] + [w.lower() for w in TERM.findall(right)][:8]


def by_brute_force(rows, support=3, diversity=0.5, generalised=0.75, removed=0.9):
    """(doc_id, base, spans) of every row."""
    texts = [t or "" for _, t in rows]
    counts = collections.Counter(w.lower() for t in texts for w in TERM.findall(t))
    total = counts.total()
    seen, both, around, held = collections.Counter(), collections.Counter(), collections.defaultdict(set), []
    for t in texts:
        near = []
        for kind, a, b, v in base_spans(t):
            entity = (kind, "".join(c for c in v if "0" <= c <= "9") if kind in ("card", "phone") else v.lower())
            words = surroundings(t, kind, a, b)
            seen[entity] += 1
            for w in set(words):
                both[entity, w] += 1
                around[entity, w].add(tuple(words))
                near.append((entity, w))
        held.append(near)
    told = {}
    for (entity, w), n in both.items():
        share = 16 * seen[entity] / total
        if len(around[entity, w]) >= max(support, n * diversity) and share < 1:
            told[entity, w] = 1 + math.log2(min(n, counts[w]) / counts[w]) / -math.log2(share)
    out = []
    for (doc_id, _), t, near in zip(rows, texts, held, strict=True):
        base = base_spans(t)
        level = collections.defaultdict(float)
        for key in near:
            if told.get(key, 0) >= generalised:
                level[key[1]] = max(level[key[1]], told[key])
        more = [("removed" if level[m.group().lower()] >= removed else "generalised", *m.span()) for m in TERM.finditer(t)
                if m.group().lower() in level and not any(a < m.end() and m.start() < b for _, a, b, _ in base)]
        base = [s[:3] for s in base]
        out.append((doc_id, base, base + sorted(more)))
    return out


def rows_of(df):
    return h.ordered((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in df.collect())


ODD = ["a@b.c+d@e.f_g@h.i", "x@y..z a.@b-.c-d. @a.b a@b a@@b.c", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.000.1.01 1.2.3",
       "4111 1111 1111 1111", "4111-1111 1111-1111 1 2", "0000000000000", "12345678901234567890123", "+1 (234) 567-8901.", "+12345678",
       "+1234567890123456 +1((((((2345678)))) +", "é日本 a@b.c 😀 +44 20 7946 0958\n127.0.0.1😀 4111111111111111", "+4111 1111 1111 1111 1.1.1.1",
       "a" * 50_000 + "@", "." * 20_000 + "1" * 30_000 + ".", "1-" * 20_000, "a@" + "b." * 20_000 + "c", "+" + "1 (" * 20_000, "", None, "no data"]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    alphabet = ["a", "b@", "@", ".", "-", "+", " ", "1", "22", "255", "300", "4111", "(", ")", "é", "😀", "_", "%", "\n"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(200)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == [s[:3] for s in base_spans(t or "")], t


def people(rng):
    """Entities whose owners are named beside them, in ever different words; copies of one text."""
    rows = []
    for p in range(6):
        for i in range(5):
            rows.append((100 * p + i, f"{h.passage(rng, 12)} Owner{p} Sur{p}né <o{p}@mail.org> {h.passage(rng, 9)} and again Sur{p}né {h.passage(rng, 30)}"))
    copied = f"{h.passage(rng, 20)} Copied call +1 202 555 0100 now {h.passage(rng, 20)}"
    rows += [(1000 + i, copied) for i in range(20)]
    rows += [(2000 + i, f"{h.passage(rng, 200)} Owner1 Sur2né") for i in range(30)]
    rows += [(3000 + i, f"{h.passage(rng, 20)} 10.0.0.{i % 2} host {h.passage(rng, 20)} host") for i in range(9)]
    return rows


def test_disclosure_equals_brute_force(spark):
    rows = people(random.Random(2)) + [(r[0], r[1]) for r in h.odd_documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("found", "base", "spans", "term", "entity", "text_key"):
        docs = docs.withColumn(name, F.lit(name))
    got = rows_of(sanitise.sanitise(docs))
    want = h.ordered(by_brute_force(rows))
    assert got == want
    kinds = collections.Counter(k for _, _, spans in want for k, *_ in spans)
    assert kinds["removed"] > 20 and kinds["generalised"] > 5
    # no entity, nothing to protect; words of copies only are not judged
    assert all(not spans for i, _, spans in want if i is not None and 2000 <= i < 2030)
    assert all(len(spans) == 1 for i, _, spans in want if i is not None and 1000 <= i < 1020)


def test_sanitised_text(spark):
    rows = people(random.Random(2)) + [(5000, None), (5001, "plain"), (5002, "see +4111 1111 1111 1111, x")]
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    for i, t in rows:
        at, parts = 0, []
        for s in sorted(got[i].spans, key=lambda s: (s.start, s.end, s.kind)):
            value = t[s.start:s.end]
            word = "[NAME]" if value[0].isupper() else "[NUMBER]" if any(c.isdigit() for c in value) else "[WORD]"
            if s.start >= at:
                parts += [t[at:s.start], {"removed": "", "generalised": word}.get(s.kind, f"[{s.kind.upper()}]")]
            at = max(at, s.end)
        assert got[i].sanitised == "".join(parts) + (t or "")[at:]
    assert "Sur3né" not in got[301].sanitised and "o3@mail.org" not in got[301].sanitised


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op12_pii_sanitisation"](spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]

    def joined(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for doc_id, base, spans in by_brute_force(rows):
        r = got.pop(doc_id)
        assert [r[f"n_{k}"] for k in RAW] == [sum(s[0] == k for s in base) for k in RAW]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and r.spans == joined(spans)
    assert not got


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op12_pii_sanitisation"](spark, h.SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_nothing_private(spark, rows):
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.base, r.spans) for r in got] == [(i, [], []) for i, _ in rows]
