"""Pairs of unlike strings whose polynomial keys modulo 2**64 are equal."""

import numpy as np

from tidewell.llm.textarrays import BASE, U64, Sums


def twins(symbols: np.ndarray, values: np.ndarray, levels: int = 7, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences of 3 * 2**levels symbols with one key; ``values`` are what Sums is given for ``symbols``.

    Blocks of three symbols in the order of the Thue-Morse sequence, and in its complement: their difference is that of two
    blocks, times a product that is divisible by a high power of two.
    """
    rng = np.random.default_rng(seed)
    need = 64 - sum(2 + i for i in range(levels))
    mask = U64((1 << need) - 1)
    i, j = rng.integers(0, len(symbols), (2, 60_000))
    with np.errstate(over="ignore"):
        d = values[i] - values[j]
        first = d & mask
        order = np.argsort(first)
        for k in range(4000):
            third = (values[i[k]] - values[j[k]]) * BASE * BASE
            wanted = (U64(0) - d * BASE - third) & mask
            at = np.minimum(np.searchsorted(first[order], wanted), len(order) - 1)
            for m in np.flatnonzero(first[order[at]] == wanted).tolist():
                n = order[at[m]]
                u, w = np.array([i[n], i[m], i[k]]), np.array([j[n], j[m], j[k]])
                bits = np.array([bin(x).count("1") % 2 for x in range(1 << levels)])
                one, two = (np.concatenate([w if b ^ flip else u for b in bits]) for flip in (0, 1))
                if (one != two).any():
                    keys = [Sums(values[x]).spans(np.array([0]), np.array([len(x)]))[0] for x in (one, two)]
                    assert keys[0] == keys[1]
                    return symbols[one], symbols[two]
    raise ValueError("none found")
