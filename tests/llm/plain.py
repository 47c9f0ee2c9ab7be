"""Plain versions of the operators, over all pairs or all windows, to hold results against."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, short: bool = False) -> frozenset:
    words = WORD.findall((text or "").lower())
    if short and 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def removed_bytes(rows: list[tuple], length: int = 400) -> dict:
    """doc_id: bytes, removed, spans, digest."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[a : a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return Counter(out)


def removed_words(rows: list[tuple], window: int = 50) -> dict:
    """Rows without a doc_id count as larger than all."""
    inf = float("inf")
    texts = [(i, PLAIN_WORD.findall(t or "")) for i, t in rows]
    least: dict = {}
    for i, w in texts:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            least[k] = min(least.get(k, inf), inf if i is None else i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < (inf if i is None else i):
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode())))
    return Counter(out)


def contained(docs: list[tuple], items: list[tuple], threshold: float = 0.8) -> Counter:
    out = []
    wanted = [(j, shingles(t)) for j, t in items]
    for i, t in docs:
        have = shingles(t)
        for j, s in wanted:
            n = len(s & have)
            if s and n >= threshold * len(s) - 1e-9:
                out.append((i, j, len(s), n))
    return Counter(out)


def near_classes(rows: list[tuple], threshold: float = 0.8) -> dict:
    """doc_id: class_id, text_id, copies, links, linked texts. Ids are distinct."""
    by_set = defaultdict(list)
    for i, t in rows:
        s = shingles(t, short=True)
        by_set[s if s else ("alone", i)].append(i)
    sets = [s for s in by_set if not (isinstance(s, tuple))]
    near = {s: [t for t in sets if t is not s and len(s & t) >= threshold * len(s | t) - 1e-9] for s in sets}
    out = {}
    seen: dict = {}
    for s in sets:
        if s in seen:
            continue
        group, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        first = min(min(by_set[x]) for x in group)
        seen |= dict.fromkeys(group, first)
    for s, ids in by_set.items():
        alone = isinstance(s, tuple)
        linked = [] if alone else near[s]
        for i in ids:
            out[i] = (i if alone else seen[s], min(ids), len(ids), len(ids) - 1 + sum(len(by_set[t]) for t in linked), len(linked))
    return out


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Edge cases: nulls, empty, blanks, long texts, copies, near copies, shared passages, accents."""
    rng = random.Random(seed)
    passage, other = words(rng, 120), words(rng, 90)
    base = words(rng, 150)
    rows: list[tuple] = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e"), (7, "ÄÖ ß é — 漢字  x y")]
    rows += [(10 + i, words(rng, rng.randint(1, 80))) for i in range(20)]
    rows += [(40 + i, f"{words(rng, 30)} {passage} {words(rng, 10 * i)}") for i in range(4)]
    rows += [(50, passage), (51, f"{passage}\n{passage}"), (52, passage.replace(" ", "  ", 3)), (53, passage.upper())]
    rows += [(60 + i, base) for i in range(8)] + [(70, base.replace(base.split()[70], "changed", 1)), (71, base + " more words at the end"), (72, base.capitalize())]
    rows += [(80, f"é{other}ü {words(rng, 20)}"), (81, f"{words(rng, 7)} é{other}ü"), (82, "x" * 900), (83, "ab" * 300)]
    rows += [(90, words(rng, 6000)), (91, "y" * 1000 + " " + other)]
    return rows
