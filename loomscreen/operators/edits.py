"""Pairs of texts within a few edits, found in arrays from a tree of one side's halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Bits of a machine word; places of the tree, pairs, and words of sequences' letters that are looked at in one go.
WORD, PLACES, PAIRS, MASKS = 64, 1 << 17, 1 << 14, 1 << 22


def within(seqs: list[str], library: list[str], edits: int, least: float) -> pd.DataFrame:
    """For each sequence the identity of the best score, ties to the first in order, among those within ``edits`` edits and of ``least`` or more.

    Of two halves of an identity one takes at most half of the edits.  So a tree
    of first halves is walked from their first letters, and one of last halves
    from the end, with a band of the edit table for every sequence and place; a
    place is left as soon as its half would take too many.  The identities at
    the leaves are compared in full, in bits of a word: identities have up to
    WORD - edits letters.
    """
    library, seqs, rows = sorted(library), sorted(seqs), []
    lengths = np.array([len(x) for x in library])
    walk = max(1, MASKS // (len(set("".join(library))) + 1))
    for at in range(0, len(seqs), walk):
        part = [x for x in seqs[at : at + walk] if len(x) <= WORD]
        n = np.array([len(x) for x in part])
        best, score = np.full(len(part), -1), np.full(len(part), -1.0)
        for m in np.unique(lengths):
            near = np.flatnonzero(np.abs(n - m) <= edits)
            if len(near) and m:
                same = np.flatnonzero(lengths == m)
                found, d = _nearest([part[k] for k in near], [library[k] for k in same], int(m), edits)
                own = np.where(found >= 0, 100.0 * (1 - d / np.maximum(n[near], m)), -1.0)
                row = same[found]
                better = (own >= least) & ((own > score[near]) | ((own == score[near]) & (row < best[near])))
                best[near[better]], score[near[better]] = row[better], own[better]
        rows += [(part[k], library[best[k]], float(score[k])) for k in np.flatnonzero(best >= 0)]
    return pd.DataFrame(rows, columns=["seq", "identity", "score"])


def _letters(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row each text."""
    return np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)


def _nearest(seqs: list[str], library: list[str], m: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence the first of the nearest identities (all of m letters) within ``edits``, or -1, and the edits."""
    n = np.array([len(x) for x in seqs])
    a, b = _letters(seqs, int(n.max())), _letters(library, m)
    known = np.unique(b)
    # Letters as numbers from 1; 0 is a letter that no sequence has.
    codes = (np.searchsorted(known, b) + 1).astype(np.min_scalar_type(len(known) + 1))
    masks = {}
    for last in (False, True):
        masks[last] = mask = np.zeros((len(seqs), len(known) + 1), dtype=np.uint64)
        for i in range(a.shape[1]):
            k = np.flatnonzero(n > i)
            letter = a[k, n[k] - 1 - i if last else i]
            at = np.minimum(np.searchsorted(known, letter), len(known) - 1)
            hit = known[at] == letter
            mask[k[hit], at[hit] + 1] |= np.uint64(1 << i)
    best = np.full(len(seqs), np.iinfo(np.int64).max)
    own = ~np.uint64(0) >> (WORD - np.maximum(n, 1)).astype(np.uint64)
    own[n == 0] = 0
    of_first = edits // 2
    for last, size, most in ((False, m // 2, of_first), (True, m - m // 2, edits - of_first - 1)):
        if most >= 0:
            for q, row in _candidates(masks[last], codes[:, ::-1] if last else codes, size, most):
                d = _distances(masks[False], own, codes, q, row)
                k = np.flatnonzero(d <= edits)
                np.minimum.at(best, q[k], d[k] * len(library) + row[k])
    found = best < np.iinfo(np.int64).max
    return np.where(found, best % len(library), -1), np.where(found, best // len(library), 0)


def _candidates(masks: np.ndarray, codes: np.ndarray, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of all pairs (sequence, identity) where the identity's first ``size`` letters are within ``most`` edits of some beginning of the sequence."""
    order = np.lexsort(codes[:, :size].T[::-1]) if size else np.arange(len(codes))
    half = codes[order, :size]
    differ = half[1:] != half[:-1]
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1), size) if size else np.zeros(len(codes) - 1, dtype=int)
    # A place of the tree is a beginning that identities share: where its rows start.
    starts = [np.concatenate([[0], 1 + np.flatnonzero(depth < j)]) for j in range(size + 1)]
    children = [np.searchsorted(starts[j + 1], np.append(starts[j], len(order))) for j in range(size)]
    children.append(np.append(starts[size], len(order)))
    letters = [half[starts[j + 1], j] for j in range(size)]
    width = 2 * most + 1
    # Cell o of a band at depth j: the edits from the half's first j letters to the sequence's first j - most + o.
    band = np.repeat(np.array([[o - most if o >= most else most + 1] for o in range(width)], dtype=np.int8), len(masks), axis=1)
    todo = [(0, np.arange(len(masks), dtype=np.int32), np.zeros(len(masks), dtype=np.int32), band)]
    while todo:
        j, q, node, band = todo.pop()
        first = children[j][node]
        many = children[j][node + 1] - first
        ends = np.cumsum(many)
        room = PLACES if j < size else PAIRS
        if len(q) > 1 and ends[-1] > room:
            cuts = np.unique(np.clip(np.searchsorted(ends, np.arange(room, ends[-1], room)), 1, len(q) - 1))
            todo += [(j, q[x:y], node[x:y], band[:, x:y]) for x, y in zip([0, *cuts], [*cuts, len(q)], strict=True)] if len(q) > 1 else []
            continue
        parent = np.repeat(np.arange(len(q), dtype=np.int32), many)
        child = np.arange(len(parent), dtype=np.int32) + (first - ends + many).astype(np.int32)[parent]
        q = q[parent]
        if j == size:
            yield q, order[child]
            continue
        j += 1
        equal = masks[q, letters[j - 1][child]]
        equal = equal >> np.uint64(j - most - 1) if j > most else equal << np.uint64(most + 1 - j)
        equal = equal.astype(np.min_scalar_type(1 << width))
        old, new = band[:, parent], np.empty((width, len(parent)), dtype=np.int8)
        for o in range(width):
            new[o] = old[o] + 1 - ((equal >> o) & 1).astype(np.int8)
            if o + 1 < width:
                np.minimum(new[o], old[o + 1] + 1, out=new[o])
            if o:
                np.minimum(new[o], new[o - 1] + 1, out=new[o])
        kept = np.flatnonzero(new.min(axis=0) <= most)
        if len(kept):
            todo.append((j, q[kept], child[kept], new[:, kept]))


def _distances(masks: np.ndarray, own: np.ndarray, codes: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Edits between pairs: a bit for each letter of a sequence says how its column of the edit table steps up or down (Myers and Hyyro)."""
    one = np.uint64(1)
    up, down = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), dtype=np.uint64)
    for j in range(codes.shape[1]):
        same = masks[q, codes[row, j]]
        inner = (((same & up) + up) ^ up) | same
        right, left = down | ~(inner | up), up & inner
        right = (right << one) | one
        outer = same | down
        up, down = (left << one) | ~(outer | right), outer & right
    return codes.shape[1] + np.bitwise_count(up & own[q]).astype(np.int64) - np.bitwise_count(down & own[q])
