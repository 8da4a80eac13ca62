"""Folding, tokens and keys over text columns."""

import json
import sys
import unicodedata

from pyspark.sql import Column, functions as F


# White space at the ends of a text, in any script.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _fold_tables():
    """From the Unicode decomposition rules, for all code points:

    canonical: letter -> base letter, where only accents come off;
    compatible: the same by compatibility, one letter each;
    longer: compatibility forms of several letters;
    accents: marks that have a combining class.
    """
    canonical, compatible, longer, accents = {}, {}, {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.combining(c):
            accents.append(cp)
        elif unicodedata.decomposition(c):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(bare) == 1 and bare != c:
                canonical[c] = bare
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            if len(bare) == 1 and bare != c:
                compatible[c] = bare
            elif bare and bare != c and len(bare) != 1 and not 0xAC00 <= cp <= 0xD7A3:
                longer[c] = bare
    return canonical, compatible, longer, accents


_CANONICAL, _COMPATIBLE, _LONGER, _ACCENTS = _fold_tables()


def _regex_class(points):
    ranges = []
    for p in sorted(points):
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_ACCENT_CLASS = _regex_class(_ACCENTS)
_LONGER_CLASS = _regex_class(map(ord, _LONGER))


def _has(c, table, points):
    """`c` has a character of a large class; most texts are ruled out by one range."""
    first = min(points)
    return c.rlike(f"[\\x{{{first:X}}}-\\x{{10FFFF}}]") & c.rlike(table)


def col(c):
    return F.col(c) if isinstance(c, str) else c


def let(value, body):
    """`body(value)` with the value computed once.

    Columns that others are built from are copied into each of them when a
    filter is pushed down; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(values):
    """A literal array<string>."""
    return F.array(*[F.lit(v) for v in values])


def strip(c) -> Column:
    """Without white space at the ends, in any script."""
    return F.trim(col(c), F.lit(SPACES))


def _without_accents(c, table):
    plain = F.translate(c, "".join(table), "".join(table.values()))
    return let(plain, lambda t: F.when(_has(t, _ACCENT_CLASS, _ACCENTS), F.regexp_replace(
        t, _ACCENT_CLASS + "+", "")).otherwise(t))


def is_ascii(c) -> Column:
    """As many bytes as characters: nothing to look up in the tables."""
    return F.octet_length(c) == F.char_length(c)


def _unless_ascii(c, folded):
    """Plain lower case where that is all there is to do."""
    c = col(c)
    return F.when(is_ascii(c), F.lower(c)).otherwise(folded(F.lower(c)))


def fold(c) -> Column:
    """Lower case without accents, canonically decomposed; loose accents go too.

    Marks without a combining class are part of their script and stay.
    """
    return _unless_ascii(c, lambda t: _without_accents(t, _CANONICAL))


def fold_compatible(c) -> Column:
    """As `fold`, with compatibility forms (ligatures, full width, circled) spelled out."""
    def spelled(t):
        # one literal in the plan instead of thousands
        pairs = F.from_json(F.lit(json.dumps(_LONGER)), "map<string,string>")
        return F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.element_at(pairs, x), x)), "")
    def full(c):
        return let(_without_accents(c, _COMPATIBLE), lambda t: F.when(
            _has(t, _LONGER_CLASS, map(ord, _LONGER)), spelled(t)).otherwise(t))
    return _unless_ascii(c, full)


def folded_constant(value):
    """What `fold_compatible` makes of a text that is known beforehand."""
    spelled = "".join(_LONGER.get(x, x) for x in value.lower().translate(str.maketrans(_COMPATIBLE)))
    return "".join(x for x in spelled if not unicodedata.combining(x))


def tokens(c) -> Column:
    """Folded ASCII tokens in order."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), 1)


def ascii_tokens(*cs) -> Column:
    """Unfolded ASCII tokens of several columns: accented words fall apart."""
    text = F.lower(F.concat_ws(" ", *[col(c) for c in cs]))
    return F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)


def unicode_words(c, at_least=1) -> Column:
    pattern = r"([\p{L}\p{N}_]{%d,})" % at_least
    return F.regexp_extract_all(col(c), F.lit(pattern), 1)


def keyword_key(c) -> Column:
    """The one casing rule of the demand side: strip and lower."""
    return F.lower(strip(col(c).cast("string")))


def slug(c) -> Column:
    ascii_only = F.regexp_replace(fold(c), r"[^\x00-\x7f]", "")
    return F.replace(ascii_only, F.lit(" "), F.lit("-"))


def has_run(longer, shorter) -> Column:
    """The second token array occurs in the first, in order and unbroken."""
    def spaced(a):
        return F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(shorter) > 0) & F.contains(spaced(longer), spaced(shorter))


def covers(whole, part) -> Column:
    """Every element of `part` is in `whole`."""
    return F.size(F.array_except(part, whole)) == 0


def pick(pairs, key) -> Column:
    """Literal lookup; null when the key is not listed."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.element_at(F.create_map(*flat), key)
