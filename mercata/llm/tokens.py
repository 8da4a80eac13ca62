"""Token ids through the tokenizers library, each distinct piece of text encoded once.

For vocabularies with word ends that drop white space, as word_bpe_49k: their pre-tokens
and special tokens never cross ASCII white space, a pre-token's ids do not depend on what
stands around it, and its last id, and only that, has a word end. Texts are cut with
array operations, pieces are looked up by a hash and compared byte by byte, and only new
pieces go to the library.
"""

import numpy as np

from .arrays import batches_of, range_hashes, running_bytes, same_bytes, slices, with_spare, words

KNOWN_PIECES = 500_000  # that a worker remembers (about 50 MB); beyond it starts anew
RECENT_PIECES = 50_000  # that are kept apart until they are sorted in
WORD_END = "</w>"
JOINED = 128  # pieces that go to the library in one string

# Fixed: what the split of the vocabulary file does with the bytes of a white-space
# separated word. Letters are a-z and the two bytes of Latin-1 letters; words with
# anything else (other scripts, controls, contractions, special tokens) stay whole.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def _byte_classes():
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = SIGN
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[ord("'")] = OTHER
    return kinds


_KINDS = _byte_classes()


def pieces(offsets, data):
    """(first byte, end, first piece of each text, whole word or not, lower-case bytes)

    Pieces of plain words are their pre-tokens after lower-casing; any other word is one
    piece with its bytes as they are.
    """
    kind = _KINDS[data]
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead = lead[latin]
        kind[lead] = kind[lead + 1] = LETTER
        capital = lead[data[lead + 1] <= 0x9E] + 1
        lower[capital] += 0x20
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[special] = OTHER
    spots = words(offsets, data)
    odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
    whole = odd[spots.end] > odd[spots.start]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new &= kind != SPACE
    if whole.any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[spots.start[whole]] += 1
        edge[spots.end[whole]] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        new &= ~inside
        lower = np.where(inside, data, lower)
    new[spots.start] = True
    start = np.flatnonzero(new)
    word = np.searchsorted(spots.start, start, "right") - 1
    end = spots.end[word]
    same = word[1:] == word[:-1]
    end[:-1][same] = start[1:][same]
    return start, end, np.searchsorted(start, offsets), whole[word], lower


class Pieces:
    """Pieces a worker has met, with their ids (or only their number)."""

    def __init__(self, path, whole=None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.ends[[i for s, i in self.tokenizer.get_vocab(False).items() if s.endswith(WORD_END)]] = True
        self.single = whole(self.tokenizer) if whole else None
        self._forget()

    def _forget(self):
        self.recent, self.total = {}, 0
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids, self.used = np.zeros(1 << 12, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.spot, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.apart = {}  # pieces whose hash belongs to another piece, by text

    def _room(self, name, size):
        array = getattr(self, name)
        if size > len(array):
            grown = np.zeros(max(size, 2 * len(array)), array.dtype)
            grown[:len(array)] = array
            setattr(self, name, grown)

    def _encoded(self, plain, whole):
        """(ids, number of ids of each) for plain pieces, then whole words."""
        ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            joined = ["\n".join(plain[i:i + JOINED]) for i in range(0, len(plain), JOINED)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(plain):
                raise ValueError("the vocabulary does not mark the ends of pre-tokens")
            counts = np.diff(np.concatenate([[0], stop]))
        if whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            ids = np.concatenate([ids, *[np.array(x, np.uint32) for x in found]])
            counts = np.concatenate([counts, [len(x) for x in found]])
        return ids, counts

    def _learn(self, texts, whole):
        """Remember pieces, return their slots; those proven to be one token are not encoded
        if only counted."""
        base = self.total
        order = []
        if self.single is not None:
            alone = [i for i, t in enumerate(texts) if not whole[i] and t in self.single]
            known = set(alone)
            plain = [i for i in range(len(texts)) if not whole[i] and i not in known]
            order += alone
        else:
            alone, plain = [], [i for i in range(len(texts)) if not whole[i]]
        rest = [i for i in range(len(texts)) if whole[i]]
        order += plain + rest
        ids, counts = self._encoded([texts[i] for i in plain], [texts[i] for i in rest])
        counts = np.concatenate([np.ones(len(alone), np.int64), counts])
        n = len(order)
        self._room("first", base + n)
        self._room("count", base + n)
        self.count[base:base + n] = counts
        if self.single is None:
            self._room("ids", self.used + len(ids))
            self.ids[self.used:self.used + len(ids)] = ids
            self.first[base:base + n] = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
        raw = [texts[i].encode("utf-8") for i in order]
        size = np.array([len(t) for t in raw], np.int64)
        for name, used in (("spot", base + n), ("size", base + n), ("text", self.text_used + size.sum() + 8)):
            self._room(name, used)
        self.size[base:base + n] = size
        self.spot[base:base + n] = self.text_used + np.cumsum(size) - size
        self.text[self.text_used:self.text_used + size.sum()] = np.frombuffer(b"".join(raw), np.uint8)
        self.text_used += int(size.sum())
        self.total += n
        slots = np.empty(n, np.int64)
        slots[order] = np.arange(base, base + n)
        return slots

    def _file(self, hashes, slots):
        self.recent.update(zip(hashes.tolist(), slots.tolist(), strict=True))
        if len(self.recent) > RECENT_PIECES:
            keys = np.concatenate([self.keys, np.fromiter(self.recent, np.uint64, len(self.recent))])
            places = np.concatenate([self.places, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
            by = np.argsort(keys)
            self.keys, self.places, self.recent = keys[by], places[by], {}

    def _find(self, hashes):
        """Slots of sorted hashes, -1 where a piece is new."""
        found = np.full(len(hashes), -1)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            same = self.keys[place] == hashes
            found[same] = self.places[place[same]]
        rest = np.flatnonzero(found < 0)
        get = self.recent.get
        found[rest] = [get(x, -1) for x in hashes[rest].tolist()]
        return found

    def _differ(self, slot, start, end, data):
        """Pieces that are not the text of their slot."""
        size = end - start
        right = self.size[slot] == size
        rows = np.flatnonzero(right)
        right[rows] = same_bytes(with_spare(data), start[rows], self.text, self.spot[slot[rows]], size[rows])
        return np.flatnonzero(~right)

    def _slots_apart(self, texts, whole):
        """Slots by text, for pieces that share a hash with another."""
        fresh = {t: w for t, w in zip(texts, whole, strict=True) if t not in self.apart}
        if fresh:
            self.apart.update(zip(fresh, self._learn(list(fresh), list(fresh.values())).tolist(), strict=True))
        return [self.apart[t] for t in texts]

    def slots(self, offsets, data):
        """(slot of each piece, first piece of each text)"""
        start, end, where, whole, lower = pieces(offsets, data)
        if not len(start):
            return np.zeros(0, np.int64), where
        sums, down = running_bytes(lower)
        hashes, at, inverse = np.unique(range_hashes(sums, start, end, down), return_index=True, return_inverse=True)
        if self.total > KNOWN_PIECES:
            self._forget()
        found = self._find(hashes)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = self._learn(*_texts(at[fresh], start, end, whole, lower))
            self._file(hashes[fresh], found[fresh])
        slot = found[inverse]
        other = self._differ(slot, start, end, lower)
        if len(other):
            slot[other] = self._slots_apart(*_texts(other, start, end, whole, lower))
        return slot, where


def _texts(which, start, end, whole, data):
    """(texts, whole words or not) of some pieces."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)], \
        whole[which].tolist()


class Encoder(Pieces):
    def encode(self, column):
        """Ids of each text as little-endian unsigned 32-bit numbers, in order."""
        for _, offsets, data in slices(column):
            slot, where = self.slots(offsets, data)
            count = self.count[slot]
            stop = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(stop[-1]) + np.repeat(self.first[slot] - stop[:-1], count)
            raw = self.ids[place].astype("<u4").tobytes()
            bounds = (stop[where] * 4).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield raw[a:b]


class Counter(Pieces):
    def count_tokens(self, column):
        """Number of tokens of each text."""
        found = []
        for _, offsets, data in slices(column):
            slot, where = self.slots(offsets, data)
            found.append(np.diff(np.concatenate([[0], np.cumsum(self.count[slot])])[where]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


_ENCODERS = {}


def encoder(path):
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch, column, path, rows=256):
    """(rows of a batch, the ids of each text in them), a few at a time."""
    for part in batches_of(batch, rows):
        yield part, encoder(path).encode(part.column(column))
