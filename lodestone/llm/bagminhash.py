"""BagMinHash signatures: unbiased estimates of weighted Jaccard similarity of multisets.

Each element owns a Poisson process of points in time for each dyadic interval of its weight axis, (0,1], (1,2], (2,4],
(4,8] and so on, with the interval's length as rate for each register. A point has a register and a cell of its
interval (the halvings of the interval down to one unit of weight), both fixed by hashes of element, interval and
number. An element of weight w meets the points whose cell lies below w. A register keeps its earliest point; two
multisets share it with the probability of their weighted Jaccard similarity. Points are drawn in time order and an
element stops when its next point is later than every register of its text, so long texts need few points for each
element.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.words import Words, mix, shingles

_LEVEL, _POINT, _CELL, _REGISTER = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def multiset(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and count of each distinct k-word shingle of each text, ordered by text and shingle; a text of fewer words, but not none, is one shingle."""
    h, valid = shingles(w, k, short=True)
    at = np.flatnonzero(valid)
    text, h = w.text_of()[at], h[at]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], h[begin], np.diff(np.append(begin, len(h)))


def numbered(text: np.ndarray, element: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: text and hash of (element, number) for numbers from 0 below count."""
    total = np.cumsum(count)
    number = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)
    return np.repeat(text, count), mix(np.repeat(element, count) + _POINT * number.astype(np.uint64))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hash to a number in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """m registers for each text, each the hash of its earliest point; 0 for texts without elements. text must be sorted."""
    time = np.full(texts * m, np.inf)
    point = np.zeros(texts * m, np.uint64)
    levels = np.ones(len(weight), np.int64)
    levels[weight > 1] += np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    which = np.repeat(np.arange(len(weight)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, own = text[which], weight[which]
    seed = mix(element[which] + _LEVEL * (level + 1).astype(np.uint64))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    rate = length * float(m)
    at, drawn = np.zeros(len(which)), np.zeros(len(which), np.int64)
    size = np.bincount(doc, minlength=texts)
    block = np.ceil(6.0 * m / np.maximum(size, 1)).astype(np.int64)  # enough, with all elements, to fill the registers
    live = np.arange(len(which))
    while len(live):
        n = block[doc[live]]
        of = np.repeat(np.arange(len(live)), n)
        begin = np.cumsum(n) - n
        p = live[of]
        number = drawn[p] + np.arange(len(of)) - begin[of]
        own_hash = mix(seed[p] + _POINT * (number + 1).astype(np.uint64))
        total = np.concatenate([[0.0], np.cumsum(-np.log(_unit(own_hash)) / rate[p])])
        x = at[p] + total[1:] - total[begin][of]
        last = begin + n - 1
        at[live], drawn[live] = x[last], number[last] + 1
        slot = doc[p] * m + (mix(own_hash ^ _REGISTER) % np.uint64(m)).astype(np.int64)
        cell = low[p] + (_unit(mix(own_hash ^ _CELL)) * length[p]).astype(np.int64)
        met = np.flatnonzero((x < time[slot]) & (np.minimum(cell, low[p] + length[p] - 1) < own[p]))
        met = met[np.argsort(-x[met], kind="stable")]  # of equal slots the last assignment, the earliest point, stays
        time[slot[met]], point[slot[met]] = x[met], own_hash[met]
        latest = time.reshape(texts, m).max(axis=1)
        live = live[at[live] < latest[doc[live]]]
        block = np.maximum(1, block // 3)
    return point.reshape(texts, m)
