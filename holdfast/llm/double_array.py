"""A double-array trie over sequences of 64-bit symbols that follows many positions at once.

The symbols that occur in a trie are numbered, and each number is read as two digits, so a node has few children and
they fit into one array: the child of state ``s`` by digit ``d`` is the cell ``base[s] + d`` if ``check`` there names ``s``.
"""

from __future__ import annotations

import numpy as np

_TRIES = 60


class DoubleArray:
    """Phrases (rows of distinct symbols, all of one length) as a trie; built by :meth:`of`, rebuilt from its arrays."""

    def __init__(self, length: int, symbols: np.ndarray, base: np.ndarray, check: np.ndarray, leaves: np.ndarray, phrase: np.ndarray):
        """``leaves``: the accepting states in order; ``phrase``: the number of each one's phrase."""
        self.length, self.symbols, self.base, self.check, self.leaves, self.phrase = length, symbols, base, check, leaves, phrase
        self.bits = digit_bits(len(symbols))

    @classmethod
    def of(cls, phrases: np.ndarray) -> DoubleArray:
        """``phrases``: a row for each, no two alike. Their numbers are their row numbers."""
        count, length = phrases.shape
        symbols, codes = np.unique(phrases, return_inverse=True)
        codes = codes.reshape(count, length)
        bits = digit_bits(len(symbols))
        digits = np.stack([codes >> bits, codes & ((1 << bits) - 1)], axis=2).reshape(count, 2 * length)
        order = np.lexsort(digits.T[::-1])
        digits = digits[order]
        # Children of all inner nodes, depth by depth; a node is known by its number within its depth.
        new = np.zeros(count, bool)
        new[0] = True
        parents, labels, first_node, node = [], [], [0], np.zeros(count, np.int64)
        for depth in range(2 * length):
            new[1:] |= digits[1:, depth] != digits[:-1, depth]
            parents.append(node[new] + first_node[-1])
            labels.append(digits[new, depth])
            first_node.append(first_node[-1] + int(node[-1]) + 1)
            node = np.cumsum(new) - 1
        parent, label = np.concatenate(parents), np.concatenate(labels)
        inner = first_node[-1]
        base, cells = _place(parent, label, inner, 1 << bits)
        # Node numbers follow the order of the children, the root being 0; the last ``count`` children are the leaves.
        cell_of = np.concatenate([[0], cells])
        size = int(base.max()) + (2 << bits)
        of_state, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        of_state[cell_of[:inner]] = base
        check[cells] = cell_of[parent]
        by_cell = np.argsort(cells[-count:])
        return cls(length, symbols, of_state, check, cells[-count:][by_cell].astype(np.int32), order[by_cell].astype(np.int32))

    def accepted(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The phrase numbers that begin at positions ``at`` of ``symbols``; positions without one fall out on the way."""
        return self.walk(symbols, at)[1]

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the positions ``at`` begin a phrase, the numbers of these phrases)."""
        which, state = np.arange(len(at)), np.zeros(len(at), np.int64)
        for step in range(self.length):
            met = symbols[at[which] + step]
            code = np.searchsorted(self.symbols, met)
            code[code == len(self.symbols)] = 0
            found = self.symbols[code] == met
            which, state, code = which[found], state[found], code[found]
            for shift in (self.bits, 0):
                cell = self.base[state] + ((code >> shift) & ((1 << self.bits) - 1))
                alive = self.check[cell] == state
                which, state, code = which[alive], cell[alive], code[alive]
        return which, self.phrase[np.searchsorted(self.leaves, state)]


def digit_bits(symbols: int) -> int:
    return max(1, (max(symbols - 1, 1).bit_length() + 1) // 2)


def _place(parent: np.ndarray, label: np.ndarray, inner: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """A base for each inner node, so that no two children share a cell. Cell 0 is the root.

    Nodes with most children choose first, by trial; a node that finds no room gets a new stretch. Nodes with one
    child, by far the most, fill the cells that are left. ``parent`` is sorted.
    """
    begin = np.searchsorted(parent, np.arange(inner + 1))
    fan = np.diff(begin)
    base = np.zeros(inner, np.int64)
    size = alphabet + 2 * len(parent)
    top = size + alphabet  # no trial reaches cells from here on
    used = np.zeros(top, bool)
    used[:alphabet] = True  # keeps bases above 0
    random = np.random.default_rng(1)
    picks: list[int] = []
    many = np.flatnonzero(fan > 1)
    many = many[np.argsort(-fan[many], kind="stable")]
    for node, lo, hi in zip(many.tolist(), begin[many].tolist(), begin[many + 1].tolist(), strict=True):
        for _ in range(_TRIES):
            if not picks:
                picks = random.integers(1, size, 1 << 16).tolist()
            start = picks.pop()
            cells = label[lo:hi] + start
            if not used[cells].any():
                break
        else:
            if top + alphabet > len(used):
                used = np.concatenate([used, np.zeros(len(used) + alphabet, bool)])
            cells, start = label[lo:hi] + top, top
            top += alphabet
        used[cells] = True
        base[node] = start
    one = np.flatnonzero(fan == 1)
    free = np.flatnonzero(~used[:top])[: len(one)]
    free = np.concatenate([free, np.arange(top, top + len(one) - len(free))])
    base[one] = free - label[begin[one]]
    return base, base[parent] + label
