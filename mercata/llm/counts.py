"""Token counts: vocabulary strings that encode alone as one token are counted directly."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import forget
from .tokens import WORD_END, Counter


def whole_tokens(tokenizer):
    """Strings that the vocabulary proves to be one token when they stand alone.

    A vocabulary entry with a word end is a candidate. It is proven by encoding it: the
    library must give exactly that one id.
    """
    byte_of = _bytes_of_characters()
    strings, ids = [], []
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry.endswith(WORD_END):
            try:
                strings.append(bytes(byte_of[c] for c in entry[:-len(WORD_END)]).decode("utf-8"))
                ids.append(i)
            except (KeyError, UnicodeDecodeError):
                pass  # part of a character: never a pre-token of its own
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, encoded, strict=True) if s and e.ids == [i])


@lru_cache(1)
def _bytes_of_characters():
    """Byte-level vocabularies write each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


_COUNTERS = {}


def counter(path):
    """One counter per worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole_tokens)
    return _COUNTERS[path]


def token_counts(docs, tokenizer_path, limit=2048, id_col="doc_id", text_col="text"):
    """Tokens of every whole text, without begin, end or other added tokens.

    A pre-token that is proven to encode alone as one token is counted without merging;
    only the rest goes through the library's merges, each distinct one once. Special
    strings in a text count as the library counts them. Map-only: no shuffle.

    Returns doc_id, n_bytes, n_tokens and over_limit, one row per input row. A null or
    empty text has 0 bytes and 0 tokens; a null doc_id stays null; other columns are
    left out, so their names cannot clash; an empty table gives no rows.
    """
    def run(batches):
        count = counter(tokenizer_path).count_tokens
        for batch in batches:
            tokens = count(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": size, "n_tokens": pa.array(tokens.astype(np.int64)),
                "over_limit": pa.array(tokens > limit)})
        forget()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
