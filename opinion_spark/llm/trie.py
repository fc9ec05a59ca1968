"""Double-array tries over phrases of word hashes, advanced for all positions of a text at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROOT = 0
#: Places looked at together when a node's children are placed.
_LOOK = 512


class Trie(NamedTuple):
    """``alphabet``: sorted word hashes, the code of a word is its place plus one. From state s the word of code c leads to
    ``base[s] + c`` if ``check`` there is s. ``accepted``: the phrases' states, ``keys`` their keys."""

    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepted: np.ndarray
    keys: np.ndarray

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of word hashes, 0 for words of no phrase."""
        if not len(self.alphabet):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def visits(self, words: np.ndarray, depth: int) -> np.ndarray:
        """How often each state is reached from all positions of ``words`` (0: a break that no phrase crosses)."""
        codes = np.where(words == 0, 0, self.codes(words))
        reached = [np.empty(0, np.int64)]
        at, state = np.flatnonzero(codes), np.full(np.count_nonzero(codes), ROOT, np.int64)
        for step in range(depth):
            inside = at + step < len(codes)
            at, state = at[inside], state[inside]
            code = codes[at + step]
            following = self.base[state] + code
            good = (code > 0) & (following > 0) & (following < len(self.check))
            at, state, following = at[good], state[good], following[good]
            good = self.check[following] == state
            at, state = at[good], following[good]
            if not len(at):
                break
            reached.append(state)
        return np.bincount(np.concatenate(reached), minlength=len(self.check))


def build(phrases: np.ndarray, keys: np.ndarray) -> Trie:
    """A trie of the rows of ``phrases`` (word hashes, 0 after the last word), which have these keys.

    Nodes are numbered level by level; all children of a node take slots ``base + code``. Nodes with many children look for a
    place first, those with one child take the free slots that are left.
    """
    if not len(phrases):
        none = np.empty(0, np.int64)
        return Trie(np.empty(0, np.uint64), np.zeros(1, np.int64), np.full(1, -1, np.int64), none, none)
    alphabet = np.unique(phrases[phrases != 0])
    codes = np.where(phrases == 0, 0, np.searchsorted(alphabet, phrases) + 1)
    node, parents, labels, leaf = np.zeros(len(codes), np.int64), [], [], np.zeros(len(codes), np.int64)
    count = 1
    for column in codes.T:
        live = np.flatnonzero(column)
        edge, inverse = np.unique(node[live] * (len(alphabet) + 1) + column[live], return_inverse=True)
        parents.append(edge // (len(alphabet) + 1))
        labels.append(edge % (len(alphabet) + 1))
        node[live] = count + inverse
        leaf[live] = node[live]
        count += len(edge)
    parent, label = np.concatenate(parents), np.concatenate(labels)  # edges, sorted by parent
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    size = np.diff(np.append(first, len(parent)))
    room = 2 * len(parent) + len(alphabet) + 2
    free = np.ones(room, bool)
    free[ROOT] = False
    base_of, slot_of = np.zeros(count, np.int64), np.zeros(count, np.int64)
    low = 1
    for k in np.argsort(-size, kind="stable"):
        if size[k] == 1:
            break
        own = label[first[k] : first[k] + size[k]]
        offsets = own - own[0]
        start = low
        while True:
            need = start + _LOOK + int(offsets[-1])
            if need > len(free):
                free = np.concatenate([free, np.ones(max(len(free), need - len(free)), bool)])
            fits = free[start : start + _LOOK].copy()
            for offset in offsets[1:].tolist():
                fits &= free[start + offset : start + offset + _LOOK]
            if fits.any():
                break
            start += _LOOK
        there = start + int(fits.argmax()) + offsets
        free[there] = False
        base_of[parent[first[k]]] = there[0] - own[0]
        slot_of[first[k] + 1 : first[k] + 1 + size[k]] = there
        low = start  # free slots before it are left to nodes with one child
    single = first[size == 1]
    spots = np.flatnonzero(free)
    if len(spots) < len(single):
        spots = np.concatenate([spots, len(free) + np.arange(len(single))])
    spots = spots[: len(single)]
    slot_of[single + 1] = spots
    base_of[parent[single]] = spots - label[single]
    length = int(slot_of.max()) + 1
    base, check = np.zeros(length, np.int64), np.full(length, -1, np.int64)
    base[slot_of] = base_of
    check[slot_of[1:]] = slot_of[parent]
    has_children = np.zeros(count, bool)
    has_children[parent] = True
    base[slot_of[~has_children]] = -(len(alphabet) + 1)
    return Trie(alphabet, base, check, slot_of[leaf], keys)
