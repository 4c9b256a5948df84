"""Whole-text byte-level BPE with the tokenizers library, at dictionary speed.

The vocabulary's pre-tokeniser never lets a token cross certain places: before
a single space between two visible characters, around a single line feed
between such, and between a letter and the ASCII punctuation after it. A text's
ids are therefore the concatenated ids of its pieces, cut at those places. Each
distinct piece goes through the library once while it stays in a worker's
bounded table; all else is hashing and gathering in numpy. The table is found by
hash, and every hit is compared byte by byte; long pieces, and short ones that
share another's hash, are kept by their bytes. Texts that spell
out one of the vocabulary's special tokens go through the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker's table holds; it starts anew beyond that, so memory is bounded.
TABLE_PIECES = 1_200_000
#: Longer pieces, up to so many bytes together, are kept by their bytes.
SHORT, LONG_BYTES = 32, 1 << 26
_JOIN = "\x00"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_PUNCT = _VISIBLE & ~_LETTER
_PUNCT[48:58] = False
#: Lead bytes of two-byte characters among which there is no white space.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xD5] = True


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the pieces, and whether each is letters behind at most one space."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    letter, visible = _LETTER[data], _VISIBLE[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    pair = pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)]
    letter[pair] = letter[pair + 1] = True
    if n > 2:
        lead = _LEAD[data]
        before = visible | letter
        before[1:] |= lead[:-1]
        after = visible | lead
        around = before[:-2] & after[2:]
        cut[1 : n - 1] |= (data[1:-1] == 0x20) & around
        line = (data[1:-1] == 0x0A) & around
        cut[1 : n - 1] |= line
        cut[2:n] |= line
    if n > 1:
        cut[1:n] |= letter[:-1] & _PUNCT[data[1:]]
    cut[n] = False
    at = np.flatnonzero(cut)
    letters = np.concatenate([[0], np.cumsum(letter)])
    ends = np.append(at[1:], n)
    spaced = data[at] == 0x20
    plain = (letters[ends] - letters[at] == ends - at - spaced) & (ends - at > spaced)
    return at, plain


class PieceTable:
    """Open addressing over 64-bit piece hashes; values are entry numbers."""

    def __init__(self, bits: int = 22):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.values[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != h) & (self.values[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            s = slot[open_]
            hit = self.keys[s] == h[open_]
            out[open_[hit]] = self.values[s[hit]]
            open_ = open_[~hit & (self.values[s] >= 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't in the table yet."""
        slot = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.values[s] < 0
            _, first = np.unique(s[free], return_index=True)
            win = left[free][first]
            self.keys[slot[win]] = h[win]
            self.values[slot[win]] = values[win]
            done = np.zeros(len(h), bool)
            done[win] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


class Encoder:
    """ids of whole texts; ``encode`` equals the library's own on each text."""

    def __init__(self, path: str):
        common.one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel
        self.joined = {}
        for plain in (True, False):
            t = Tokenizer.from_file(path)
            t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_JOIN, "removed"), level(add_prefix_space=False, use_regex=not plain)])
            self.joined[plain] = t
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: bytes of text behind each id: one per character of the byte-level alphabet
        self.id_bytes = np.zeros(size, np.int64)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = len(word)
        self._reset()

    def _reset(self) -> None:
        self.table = PieceTable()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.blocks = np.zeros((1 << 16, SHORT // 8), np.uint64)
        self.kept: dict[bytes, int] = {}
        self.n_flat = self.n_pieces = self.kept_bytes = 0

    def _ids(self, tokenizer, texts: list[str]) -> np.ndarray:
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return np.concatenate([np.asarray(e.ids, np.uint32) for e in run(texts, add_special_tokens=False)] or [np.zeros(0, np.uint32)])

    def _learn(self, raw: bytes, start, end, plain) -> np.ndarray:
        """Runs the library over new pieces; their entry numbers."""
        entry = np.zeros(len(start), np.int64)
        for kind in (True, False):
            pick = np.flatnonzero(plain == kind)
            if not len(pick):
                continue
            words = [raw[a:b].decode() for a, b in zip(start[pick].tolist(), end[pick].tolist())]
            odd = [] if kind else [i for i, w in enumerate(words) if _JOIN in w]
            if odd:  # pieces that hold the joining character themselves
                for i in odd:
                    entry[pick[i]] = self._enter(self._ids(self.tokenizer, [words[i]]), None)[0]
                keep = np.setdiff1d(np.arange(len(words)), odd)
                words, pick = [words[i] for i in keep], pick[keep]
            if words:
                ids = self._ids(self.joined[kind], [_JOIN.join(words[i : i + 2000]) for i in range(0, len(words), 2000)])
                entry[pick] = self._enter(ids, end[pick] - start[pick])
        return entry

    def _enter(self, ids, sizes) -> np.ndarray:
        n, m = 1 if sizes is None else len(sizes), len(ids)
        while self.n_flat + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_pieces + n + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
        self.flat[self.n_flat : self.n_flat + m] = ids
        if sizes is None:
            ends = np.array([m])
        else:  # a piece ends where the bytes behind its ids add up to its own
            ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(sizes)) + 1
        self.begins[self.n_pieces] = self.n_flat
        self.begins[self.n_pieces + 1 : self.n_pieces + n + 1] = self.n_flat + ends
        self.n_flat, self.n_pieces = self.n_flat + m, self.n_pieces + n
        return np.arange(self.n_pieces - n, self.n_pieces)

    def _remember(self, words, entry, start, size) -> None:
        """Sizes and bytes of new short entries, to compare later hits with."""
        self.sizes[entry] = size
        for k in range(SHORT // 8):
            live = np.flatnonzero(size > 8 * k)
            self.blocks[entry[live], k] = words[start[live] + 8 * k] & common._HEAD[np.minimum(size[live] - 8 * k, 8)]

    def _unlike(self, words, entry, start, size) -> np.ndarray:
        """Which short pieces aren't, byte by byte, what their entry was learned from."""
        differ = self.sizes[entry] != size
        for k in range(-(-int(size.max(initial=0)) // 8)):
            live = np.flatnonzero(size > 8 * k) if k else slice(None)
            block = words[start[live] + 8 * k] & common._HEAD[np.minimum(size[live] - 8 * k, 8)]
            differ[live] |= block != self.blocks[entry[live], k]
        return np.flatnonzero(differ)

    def _by_bytes(self, raw: bytes, which, start, end, plain, entry) -> None:
        """Entries of pieces that are kept by their bytes."""
        own = [raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
        new = {w: i for i, w in zip(which.tolist(), own) if w not in self.kept}
        if new:
            at = np.fromiter(new.values(), np.int64, len(new))
            self.kept.update(zip(new, self._learn(raw, start[at], end[at], plain[at]).tolist()))
            self.kept_bytes += sum(map(len, new))
        entry[which] = [self.kept[w] for w in own]

    def _entries(self, data, raw: bytes, at, ends, plain) -> np.ndarray:
        size = ends - at
        words = common.eights(data)
        short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
        s_at, s_size = at[short], size[short]
        h = common.span_hashes(data, s_at, ends[short], words)
        found = self.table.find(h)
        missing = np.flatnonzero(found < 0)
        if self.n_pieces and (self.n_pieces + len(missing) + len(long) > TABLE_PIECES or self.kept_bytes > LONG_BYTES):
            self._reset()
            missing = np.arange(len(h))
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            while len(new) > (int(self.table.mask) + 1) // 2:  # a slice of one enormous document
                self.table = PieceTable(int(self.table.mask).bit_length() + 1)
            own = short[first]
            number = self._learn(raw, at[own], ends[own], plain[own])
            self.table.add(new, number.astype(np.int32))
            self._remember(words, number, at[own], size[own])
            found[missing] = self.table.find(h[missing])
        entry = np.zeros(len(at), np.int64)
        entry[short] = found
        if len(long):
            self._by_bytes(raw, long, at, ends, plain, entry)
        unlike = self._unlike(words, found, s_at, s_size)
        if len(unlike):
            self._by_bytes(raw, short[unlike], at, ends, plain, entry)
        return entry

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of document i are ids[offsets[i]:offsets[i + 1]]."""
        data, offsets = common.text_buffer(column)
        parts, counts = [], []
        for i, j in common.slices(offsets, 1 << 20):
            ids, n = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            counts.append(n)
        return (
            np.concatenate(parts) if parts else np.zeros(0, np.uint32),
            np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(len(offsets), np.int64),
        )

    def _slice(self, data, offsets):
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = data.tobytes()
        whole = sorted({i for s in self.special for i in _documents_with(raw, s, offsets)})
        at, plain = pieces(data, offsets)
        ends = np.append(at[1:], len(data))
        entry = self._entries(data, raw, at, ends, plain)
        begin = self.begins[entry]
        length = self.begins[entry + 1] - begin
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], length)]
        bounds = total[np.searchsorted(at, offsets)]
        if not whole:
            return ids, np.diff(bounds)
        per = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        for i in whole:
            per[i] = self._ids(self.tokenizer, [raw[offsets[i] : offsets[i + 1]].decode()])
        return np.concatenate(per), np.array([len(p) for p in per], np.int64)


def _documents_with(raw: bytes, what: bytes, offsets: np.ndarray) -> list[int]:
    found, at = [], raw.find(what) if what else -1
    while at >= 0:
        i = int(np.searchsorted(offsets, at, side="right")) - 1
        found.append(i)
        at = raw.find(what, int(offsets[i + 1]))
    return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
