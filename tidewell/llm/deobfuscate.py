"""Noisy-channel restoration of leetspeak, spaced-out and stretched words.

Suspicious spans of a text become lattices: a digit or sign may stand for letters, a
separator for nothing or for a word's end, a repeated letter for one. Viterbi decoding
under a character trigram model of the corpus picks the reading.
"""

from __future__ import annotations

import numpy as np

from .textarrays import U64, Words

#: What a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
WILD = "*#"
SEPARATORS = " .-_,~'\t​­"
#: Symbols of the model: 0 ends a word, 1-26 are letters, 27 is any letter beyond ASCII.
SYMBOLS = 28
#: Costs of the channel, in nats.
SUBSTITUTE, GUESS, NO_LETTER, SILENT, WORD_END, STRETCH, DOUBLE = 0.5, 1.5, 8.0, 0.1, 1.0, 0.1, 6.0
#: Added to every trigram count.
SMOOTHING = 0.1

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[0xC0:] = 27
_LETTER = _SYMBOL > 0
_LETTER[0x80:0xC0] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@$!|+(*#"]] = True
#: Signs that stand beside another one in a disguised word, and those that end one: "!" and "(" more often are what they seem.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "@$|+"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in "@$+"]] = True
#: Signs in a row that may stand for a letter each; a longer run stands for one, or is ornament.
MOST_WILD = 3
#: Characters of a span whose reading is remembered.
REMEMBERED = 64
_WILD = np.zeros(256, bool)
_WILD[[ord(c) for c in WILD]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def trigram_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of all symbol trigrams of the rows; words' ends are single symbols."""
    symbols = np.insert(_SYMBOL[buf], offs, 0)
    keep = np.insert((buf < 0x80) | (buf >= 0xC0), offs, True)
    symbols = symbols[keep]
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])] if len(symbols) else symbols
    if len(symbols) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)


def log_probabilities(counts: np.ndarray) -> list:
    """Log-probability of a symbol after two others, as nested lists."""
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + SMOOTHING
    table[0, 0] = table[:, 0].sum(axis=0)  # a span begins after any word's end
    return np.log(table / table.sum(axis=2, keepdims=True)).tolist()


def suspicious_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each span to decode, in order, of lower-cased text.

    A span is a token in which a digit or sign touches letters or a letter stands three times in
    a row, or a run of three and more single characters parted by one or two others.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < 3:
        return none, none, none
    row_edge = np.zeros(len(buf) + 1, bool)
    row_edge[offs] = True
    letter, digit, sign = _LETTER[buf], _DIGIT[buf], _SIGN[buf]
    after = np.zeros(len(buf), bool)  # a letter follows in the same row
    after[:-1] = letter[1:] & ~row_edge[1:-1]
    before = np.zeros(len(buf), bool)
    before[1:] = letter[:-1] & ~row_edge[1:-1]
    strange = digit & (before | after)
    strange |= sign & after & (before | (buf == ord("@")) | (buf == ord("$")))
    # signs side by side behind a letter, and single ones at a word's end that read as letters
    mark = _MARK[buf]
    marked = np.zeros(len(buf), bool)  # such a sign follows in the same row
    marked[:-1] = mark[1:] & ~row_edge[1:-1]
    strange |= sign & before & marked
    strange |= _ENDS[buf] & before
    # a letter, a few wildcards, a letter
    wild = np.append(_WILD[buf] & ~row_edge[:-1], np.zeros(MOST_WILD + 1, bool))
    letters = np.append(letter & ~row_edge[:-1], np.zeros(MOST_WILD + 1, bool))  # not the first of a row
    run = wild[: len(buf)] & before
    for k in range(1, MOST_WILD + 1):
        strange |= run & letters[k : k + len(buf)]
        run &= wild[k : k + len(buf)]
    same = (buf[1:] == buf[:-1]) & letter[1:] & (buf[1:] < 0x80) & ~row_edge[1:-1]
    strange[2:] |= same[1:] & same[:-1]
    at = np.flatnonzero(strange)
    # tokens between blanks that hold such a byte
    stops = np.flatnonzero(_BLANK[buf])
    bounds = np.union1d(offs, np.concatenate([stops, stops + 1]))
    token = np.unique(np.searchsorted(bounds, at, side="right") - 1)
    starts, ends = bounds[token], bounds[token + 1] if len(token) else token
    # runs of single characters
    words = Words(buf, offs)
    one = (words.ends - words.starts == 1) | ((words.ends - words.starts == 2) & (buf[words.starts] >= 0xC0))
    if len(one):
        linked = np.zeros(len(one), bool)  # goes on from the word before
        linked[1:] = one[1:] & one[:-1] & (words.starts[1:] - words.ends[:-1] <= 2)
        first = words.first[:-1]
        linked[first[first < len(one)]] = False
        run = np.cumsum(~linked) - 1
        size = np.bincount(run)
        head = np.flatnonzero(~linked)
        long = np.flatnonzero(size >= 3)
        starts = np.concatenate([starts, words.starts[head[long]]])
        ends = np.concatenate([ends, words.ends[head[long] + size[long] - 1]])
    if not len(starts):
        return none, none, none
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return np.searchsorted(offs, starts, side="right") - 1, starts, ends


class Decoder:
    """Viterbi decoding of spans; remembers what it decoded."""

    MOST = 200_000

    def __init__(self, counts: np.ndarray):
        self.logp = log_probabilities(counts)
        self.known: dict[str, str] = {}

    def restore(self, span: str) -> str:
        """The best reading of a whole span; time grows with its length, and only readings of short ones are remembered."""
        if len(span) > REMEMBERED:
            return self._decode(span)
        found = self.known.get(span)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            found = self.known[span] = self._decode(span)
        return found

    @staticmethod
    def options(span: str) -> list[list[tuple[int, str, float]]]:
        """For each character: symbol (-1 for none), what it reads as, and cost."""
        out = []
        for i, c in enumerate(span):
            prev = span[i - 1] if i else ""
            run = c == prev and c.isalpha()
            if "a" <= c <= "z":
                options = [(ord(c) - 96, c, 0.0)]
                if run:
                    long = (i > 1 and span[i - 2] == c) or span[i + 1 : i + 2] == c
                    options.append((-1, "", STRETCH if long else DOUBLE))
            elif c in LEET:
                options = [(ord(x) - 96, x, SUBSTITUTE) for x in LEET[c]]
                options.append((0, " ", NO_LETTER))
            elif c in WILD:
                # a short run inside a word may stand for a letter each, of any other run one, as the rest is ornament
                a, b = i, i + 1
                while a and span[a - 1] in WILD and i - a <= MOST_WILD:
                    a -= 1
                while b < len(span) and span[b] in WILD and b - i <= MOST_WILD:
                    b += 1
                options = [(k, chr(96 + k), GUESS) for k in range(1, 27)] if a == i or (b - a <= MOST_WILD and a and b < len(span) and span[a - 1].isalpha() and span[b].isalpha()) else []
                options.append((-1, "", GUESS))
            elif c in SEPARATORS:
                options = [(-1, "", SILENT), (0, " ", WORD_END)]
            elif c.isalpha():
                options = [(27, c, 0.0)]
            else:
                options = [(0, " ", 0.0)]
            out.append(options)
        return out

    def _decode(self, span: str) -> str:
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.options(span):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                row = self.logp[a][b]
                for symbol, char, cost in options:
                    if symbol < 0 or (symbol == 0 and b == 0):
                        key, value, step = (a, b), score - cost, path
                    else:
                        key, value, step = (b, symbol), score - cost + row[symbol], (path, char)
                    if key not in new or new[key][0] < value:
                        new[key] = (value, step)
            states = new
        score, path = max(((s + self.logp[a][b][0] * (b != 0), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        chars = []
        while path is not None:
            path, char = path
            chars.append(char)
        return "".join(reversed(chars))


def prefix_features(buf: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each word, and for each length the hash of its leading bytes (0: the whole word)."""
    from .textarrays import BYTE_VALUES, Sums, mix

    words = Words(buf, offs)
    sums = Sums(BYTE_VALUES[buf])
    out = []
    for k in lengths:
        ends = np.minimum(words.ends, words.starts + k) if k else words.ends
        hashes = mix(sums.spans(words.starts, ends) + U64(k))
        if k:
            hashes[words.ends - words.starts < k] = 0
        out.append(hashes)
    return words.rows(), out
