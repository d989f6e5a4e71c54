"""Quality classification by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's features are shares of
byte classes, word lengths and repetitions, its own and those of the lines
before and after it; transitions tie neighbouring labels.  Forward-backward
gives each line's probability of being good; a text's score is their mean
weighted by the lines' bytes.  Training (Adam on the chain's log-likelihood,
every line carrying its text's label) takes a bounded sample of labelled texts,
each whole, and a tenth as many texts that are two of them with different
labels, one after the other, so that transitions learn where a label changes;
scoring covers every line.

Edge cases: a null or empty text counts as one empty line; a null label isn't
learned; repeated rows are scored alike; an empty table gives an empty result;
without both labels in the sample every score is the share of label 1 (0.5
without labels); other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import arrow, stratified, texts
from .storage import columns
from .wordhash import Words, stretches

#: Labelled texts learned from, a label; bytes of them that features are worked out for at once.
SAMPLE_TEXTS = 1500
TRAIN_BYTES = 4 << 20
STEPS = 300
#: Texts in training that are put together from two, as a share of the sample.
MIXED = 0.1
#: Words back within which a word counts as repeated.
NEAR = 6


def _classes() -> np.ndarray:
    """A class for each byte: upper, lower or part of a character beyond ASCII, digit, space, bar, symbol, stop, other."""
    out = np.full(256, 7, dtype=np.uint8)
    out[128:] = 1
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r", "|", "#$%&*+<=>@^_~\\/{}[]", ".,;:!?")):
        out[[ord(c) for c in chars]] = k
    return out


_CLASS = _classes()


def line_features(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), the lines' bytes, and the first line of each text (one more entry than texts)."""
    joined = b"\n".join([t or b"" for t in found] + [b""])
    buffer = np.frombuffer(joined, dtype=np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = np.fromiter((len(t or b"") + 1 for t in found), dtype=np.int64, count=len(found))
    first = np.concatenate([[0], np.searchsorted(ends, np.cumsum(lengths) - 1) + 1]) if found else np.zeros(1, dtype=np.int64)
    size = (ends - starts).astype(np.float64)
    per = np.maximum(size, 1)
    kinds = _CLASS[buffer]
    shares = []
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        shares.append((sums[ends] - sums[starts]) / per)
    w = Words([joined])
    h = w.hashes()
    line = np.searchsorted(ends, w.starts)
    near = np.zeros(len(h), dtype=bool)
    for d in range(1, NEAR + 1):
        near[d:] |= (h[d:] == h[:-d]) & (line[d:] == line[:-d])
    n_words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    n_near = np.bincount(line, near, minlength=len(ends))
    texts_of = np.repeat(np.arange(len(found)), np.diff(first))
    line_hash = stretches(buffer, starts, ends)
    order = np.lexsort((line_hash, texts_of))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (texts_of[order][1:] == texts_of[order][:-1]) & (size[order][1:] > 0)
    again = np.zeros(len(ends))
    again[order[1:][same]] = again[order[:-1][same]] = 1
    marked = np.bincount(line, kinds[w.ends - 1] >= 4, minlength=len(ends)) / np.maximum(n_words, 1)
    own = np.stack([*shares, *(np.sqrt(shares[k]) for k in (0, 2, 4, 5, 6)), np.log1p(size) / 4, np.log1p(n_words) / 4, size / np.maximum(n_words, 1) / 8, n_near / np.maximum(n_words, 1), again, marked, (size == 0).astype(float)], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.clip(np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), -4, 4), size, first


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of all chains at once, longest first.

    emit: (lines, 2) scores; first: as of line_features.  Returns the log
    marginals of lines (lines, 2), log Z of each chain, and the log messages
    alpha and beta.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    sorted_first, sorted_len = first[:-1][order], lengths[order]
    live = np.searchsorted(-sorted_len, -np.arange(int(lengths.max(initial=0))), side="left")
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    at = sorted_first
    alpha[at] = emit[at] + begin
    for t in range(1, len(live)):
        at = sorted_first[: live[t]] + t
        prev = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(len(live) - 1, 0, -1):
        at = sorted_first[: live[t]] + t
        nxt = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    last = alpha[first[1:] - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    return alpha + beta - np.repeat(z, lengths)[:, None], z, alpha, beta


@dataclass
class Chain:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    prior: float | None = None

    def emit(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -5, 5) @ self.weights

    def scores(self, found: list[bytes | None]) -> np.ndarray:
        """A probability of label 1 for each text."""
        if self.prior is not None:
            return np.full(len(found), self.prior)
        if not found:
            return np.zeros(0)
        features, size, first = line_features(found)
        good = np.exp(marginals(self.emit(features), first, self.trans, self.begin)[0][:, 1])
        weight = np.maximum(size, 1)
        return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def _features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines and the first line of each text, as line_features gives them, some texts at a time."""
    parts, first, group, size = [], [np.zeros(1, dtype=np.int64)], [], 0
    for k, t in enumerate(found):
        group.append(t)
        size += len(t)
        if size >= TRAIN_BYTES or k == len(found) - 1:
            features, _, starts = line_features(group)
            parts.append(features)
            first.append(starts[1:] + first[-1][-1])
            group, size = [], 0
    return np.concatenate(parts), np.concatenate(first)


def _mixed(found: list[bytes], labels: np.ndarray, seed: int = 3) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Texts of two labels, one after the other, and for each its parts' labels and numbers of lines."""
    rng, of = np.random.default_rng(seed), [np.flatnonzero(labels == k) for k in (0, 1)]
    out, parts = [], []
    for i in range(math.ceil(MIXED * len(found))):
        order = np.array([i % 2, 1 - i % 2])
        chosen = [found[int(rng.choice(of[k]))] for k in order]
        out.append(b"\n".join(chosen))
        parts.append((order, np.array([t.count(b"\n") + 1 for t in chosen])))
    return out, parts


def train(samples: list[tuple[bytes | None, int]], steps: int = STEPS) -> Chain:
    """Fit the chain to labelled texts; label 1 is good."""
    labels = np.array([k for _, k in samples], dtype=np.int64)
    none = np.zeros(0)
    if len(set(labels.tolist())) < 2:
        return Chain(none, none, none, none, none, prior=float(labels.mean()) if len(labels) else 0.5)
    found = [t or b"" for t, _ in samples]
    joined, parts = _mixed(found, labels)
    features, first = _features(found + joined)
    lengths = np.diff(first)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x, y = np.clip((features - mean) / scale, -5, 5), np.concatenate([np.repeat(labels, lengths[: len(labels)]), *(np.repeat(k, n) for k, n in parts)])
    # Each text weighs alike, and so does each label.
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = np.concatenate([0.5 / share[labels], np.ones(len(joined))]) / lengths / len(lengths)
    line_weight = np.repeat(weight, lengths)
    w, trans, begin = np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)
    inner = np.ones(len(x), dtype=bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    hot = np.eye(2)[y]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, trans, begin)]
    for step in range(1, steps + 1):
        emit = x @ w
        logs, z, alpha, beta = marginals(emit, first, trans, begin)
        d = (np.exp(logs) - hot) * line_weight[:, None]
        pair = alpha[to - 1][:, :, None] + trans[None] + (emit[to] + beta[to])[:, None, :] - np.repeat(z, lengths)[to][:, None, None]
        d_trans = (np.exp(pair) * line_weight[to][:, None, None]).sum(axis=0) - np.einsum("ni,nj->ij", hot[to - 1] * line_weight[to][:, None], hot[to])
        grads = (x.T @ d + 1e-3 * w, d_trans + 1e-3 * trans, d[first[:-1]].sum(axis=0))
        for p, g, (m, v) in zip((w, trans, begin), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(mean, scale, w, trans, begin)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_TEXTS) -> Chain:
    """Train on about ``per_label`` labelled rows a label (a hash of the key chooses).

    The chosen rows are at most 1.5 * per_label a label, so they are broadcast
    to find their texts, which come to the driver whole.
    """
    rows = columns(labels, key=id_col, label=label_col).where("label is not null and key is not null")
    chosen = stratified(rows.where("label in (0, 1)"), "label", "key", per_label)
    found = columns(docs, key=id_col, text=text_col).join(F.broadcast(chosen), "key").select("text", "label")
    return train([((r.text or "").encode(), int(r.label)) for r in found.collect()])


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row, from its whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in texts(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chain.scores(found))], names=["key", "score"])

    return columns(df, key=id_col, text=text_col).transform(arrow(run, f"key {kind}, score double"))
