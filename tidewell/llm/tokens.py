"""Token ids of whole columns with the byte-level BPE of a ``tokenizers`` file.

Byte-level BPE first parts a text by a fixed pattern, then encodes each piece by
itself. A task therefore parts whole batches with numpy, has the tokenizer encode
only pieces that it has not met, and gathers the rest from a table. Pieces are looked up by
hash and compared by their characters; a text with a piece that only shares its hash with another goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import U64, Sums, mix, pieces, text_buffer

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Fixed values of the pattern: what may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces kept by a worker; the table starts anew beyond.
MOST_KEPT = 4_000_000
_WHITE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane; ODD where Unicode versions may differ."""
    kind = {"L": LETTER, "N": NUMBER}
    found = [SPACE if c in _WHITE else ODD if (cat := unicodedata.category(chr(c))) in ("Cn", "Cs", "Co") else kind.get(cat[0], OTHER) for c in range(1 << 16)]
    return np.array(found, np.uint8)


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, (1 << 16) + 1, dtype=U64))


def _is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer parts texts by the pattern above, and by nothing else, before it merges bytes."""
    first = spec.get("pre_tokenizer") or {}
    plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    return plain and spec.get("model", {}).get("type") == "BPE" and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")


class Encoder:
    """Encodes columns; keeps the ids of every piece met so far.

    Only for byte-level BPE with its usual pattern: with any other file every text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parted = _is_byte_level(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes
        self.at = np.zeros(0, np.int64)  # where each one's ids begin
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.chars = np.zeros(0, np.uint16)  # of all known pieces
        self.spelt = np.zeros(0, np.int64)  # where each one's characters begin
        self.length = np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.known) > MOST_KEPT:
            self._clear()
        made = self._plain(texts)
        size = np.array([len(x) for x in made], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *made])
        length = np.array([len(x) for x in texts], np.int64)
        spelt = len(self.chars) + np.cumsum(length) - length
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(texts).encode("utf-16-le"), np.uint16)])  # pieces are of the basic plane
        to = np.searchsorted(self.known, hashes)  # both are sorted
        self.known = np.insert(self.known, to, hashes)
        for name, new in (("at", at), ("size", size), ("spelt", spelt), ("length", length)):
            setattr(self, name, np.insert(getattr(self, name), to, new))

    def _unlike(self, slot: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces that aren't spelt like the known one of their hash; pieces follow each other without gaps."""
        length = ends - starts
        if not len(self.known) or not len(starts):
            return np.ones(len(starts), bool)
        place = np.repeat(self.spelt[slot] - starts, length) + np.arange(starts[0], ends[-1])
        same = self.chars[np.minimum(place, len(self.chars) - 1)] == chars[starts[0] : ends[-1]]
        return (self.length[slot] != length) | ~np.logical_and.reduceat(same, starts - starts[0])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each row, uint32; a null row has none."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        out: list[np.ndarray] = []
        _, offs = text_buffer(column)
        for a, b in pieces(offs):
            some = column.slice(a, b - a)
            out += self._encode_piece(some) if self.parted else self._plain(some.to_pylist())
        return out

    def _encode_piece(self, column: pa.Array) -> list[np.ndarray]:
        direct = np.zeros(len(column), bool)
        for s in self.special:
            direct |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(lengths)])
        buf, _ = text_buffer(column)
        chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = np.where(chars < 1 << 16, _classes()[np.minimum(chars, 0xFFFF)], ODD).astype(np.uint8)
        strange = np.flatnonzero(kinds == ODD)
        direct[np.searchsorted(offs, strange, side="right") - 1] = True
        starts = _piece_starts(chars, kinds, offs)
        ends = np.append(starts[1:], len(chars))
        sums = Sums(_values()[np.minimum(chars, 0xFFFF)])
        hashes = sums.spans(starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        row = np.searchsorted(offs, starts, side="right") - 1
        usable = np.zeros(len(unique), bool)
        usable[inverse[~direct[row]]] = True
        new = np.flatnonzero(usable & ~np.isin(unique, self.known, assume_unique=True))
        if len(new):
            texts = [chars[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in first[new]]
            self._learn(unique[new], texts)
        slot = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        direct[row[self._unlike(slot[inverse], chars, starts, ends)]] = True
        size = np.where(usable, self.size[slot], 0)[inverse] if len(self.known) else np.zeros(len(inverse), np.int64)
        at = self.at[slot][inverse] if len(self.known) else size
        total = np.cumsum(size)
        # ids of all pieces, gathered: a piece's run begins at its place in the table
        flat = self.ids[np.repeat(at - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, offs)]
        rows = [flat[bounds[i] : bounds[i + 1]] for i in range(len(column))]
        if direct.any():
            odd = np.flatnonzero(direct)
            for i, ids in zip(odd, self._plain(column.take(pa.array(odd)).to_pylist()), strict=True):
                rows[i] = ids
        return rows


def _piece_starts(chars: np.ndarray, kinds: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin: runs of one class, a single space going with the run after it."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    row_start = np.zeros(n + 1, bool)
    row_start[offs] = True
    begins = row_start[:n].copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    runs = np.flatnonzero(begins)
    # a run after a space of its own row: the space's last character parts from the white run
    after = runs[(runs > 0) & ~row_start[runs] & ~space[runs]]
    after = after[space[after - 1]]
    begins[after - 1] = True
    joined = after[chars[after - 1] == 0x20]
    begins[joined] = False
    # contractions: an apostrophe that stands alone and starts a piece
    quote = np.flatnonzero((chars == 0x27) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == LETTER) & ~row_start[quote + 1]]
    for text in CONTRACTIONS:
        k = len(text)
        fits = quote[quote + k < n]
        for i, c in enumerate(text):
            fits = fits[(chars[fits + 1 + i] == ord(c)) & ~row_start[fits + 1 + i]]
        if len(text) == 2:
            fits = fits[~np.isin(chars[fits + 1], [ord(c) for c in CONTRACTIONS if len(c) == 1])]
        begins[fits + 1] = False
        rest = fits + 1 + k
        begins[rest[rest < n]] = True
    return np.flatnonzero(begins)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
