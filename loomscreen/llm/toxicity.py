"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits of the lower-cased text (all characters
beyond ASCII count as letters).  Features are single words, pairs of neighbours
and pairs with one or two words between them, hashed to 2**BITS coordinates; a
feature's value is its count over the square root of the text's words.  Training
walks through a sample in a fixed order: every coordinate has its own learning
rate, and L1 leaves most weights at zero, so the model is a few thousand numbers
that travel with the tasks.  Scoring reads whole texts.

The sample is bounded by rows and bytes a label (SAMPLE_TEXTS, SAMPLE_BYTES):
whole texts in the order of a hash, until the next would exceed the bytes.

Edge cases: a null, empty or wordless text scores the model's base rate; rows
with a null key or label aren't learned; repeated rows are scored alike; an empty
table gives an empty result; without both labels in the sample every score is
the share of label 1 (0 without labels); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import arrow, stratified, texts, uniform
from .storage import columns
from .wordhash import Words, mix

#: Labelled texts learned from, a label, and their bytes.
SAMPLE_TEXTS = 6000
SAMPLE_BYTES = 24 << 20
BITS = 24
#: Distances of the words of a pair: neighbours, then one and two words skipped.
PAIRS = (1, 2, 3)
#: A feature is learned if it stands in so many texts of the sample.
LEAST_TEXTS = 3
EPOCHS = 8
#: Rate, its offset, and the two penalties; L1's grows with the square root of the sample.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.5, 0.0
#: What a feature's value is multiplied by.
SCALE = 10.0
#: How much more an error on a toxic text counts.
TOXIC_WEIGHT = 2.0
#: Bytes of text whose features a worker holds at once.
PART_BYTES = 1 << 20

_U = np.uint64
_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


def _plain(text: bytes | None) -> bytes:
    return (text or b"").decode().lower().encode().translate(_WORD)


def features(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of all features of some texts, the text of each, and the number of words of each text."""
    w = Words([_plain(t) for t in found])
    h, owner = w.hashes(), w.owner()
    coordinates, texts_of = [h], [owner]
    for d in PAIRS:
        same = owner[d:] == owner[:-d]
        with np.errstate(over="ignore"):
            pair = mix(h[:-d] * _U(0x9E3779B97F4A7C15) + (h[d:] ^ _U(d)))
        coordinates.append(pair[same])
        texts_of.append(owner[d:][same])
    return (np.concatenate(coordinates) >> _U(64 - BITS)).astype(np.int64), np.concatenate(texts_of), w.counts


@dataclass
class Model:
    """Sorted coordinates with a weight, and the bias; a prior where nothing was learned."""

    at: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    prior: float | None = None

    def scores(self, found: list[bytes | None]) -> np.ndarray:
        """A probability of label 1 for each text."""
        if self.prior is not None:
            return np.full(len(found), self.prior)
        at, owner, n_words = features(found)
        total = np.zeros(len(found))
        if len(self.at):
            place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
            known = self.at[place] == at
            total = np.bincount(owner[known], self.weight[place[known]], minlength=len(found))
        return _sigmoid(self.bias + SCALE * total / np.sqrt(np.maximum(n_words, 1)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _grouped(found: list[bytes | None]) -> Iterator[list[bytes | None]]:
    group, size = [], 0
    for t in found:
        group.append(t)
        size += len(t or b"")
        if size >= PART_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _rows(found: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct coordinates and values of each text."""
    for group in _grouped(found):
        at, owner, n_words = features(group)
        order = np.argsort(owner, kind="stable")
        at, ends = at[order], np.cumsum(np.bincount(owner, minlength=len(group)))
        for k, end in enumerate(ends):
            one, counts = np.unique(at[ends[k - 1] if k else 0 : end], return_counts=True)
            yield one, counts / np.sqrt(max(n_words[k], 1))


def train(samples: list[tuple[bytes | None, int]], epochs: int = EPOCHS, least: int = LEAST_TEXTS, seed: int = 11) -> Model:
    """Fit the model to labelled texts; label 1 is toxic."""
    labels = np.array([k for _, k in samples], dtype=np.float64)
    none = np.zeros(0, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(none, none.astype(float), prior=float(labels.mean()) if len(labels) else 0.0)
    found = [t for t, _ in samples]
    seen = np.zeros(1 << BITS, dtype=np.uint16)
    for at, _ in _rows(found):
        seen[at] += seen[at] < 60_000
    known = np.flatnonzero(seen >= least)
    del seen
    rows = []
    for at, value in _rows(found):
        place = np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
        hit = known[place] == at if len(known) else np.zeros(len(at), dtype=bool)
        # The last coordinate is the bias, which no penalty touches.
        rows.append((np.append(place[hit], len(known)).astype(np.int32), np.append(SCALE * value[hit], 1.0).astype(np.float32)))
    l1 = L1 * len(rows) ** 0.5
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    weights = np.where(labels == 1, TOXIC_WEIGHT, 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            w = _weights(z[at], n[at], l1)
            w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
            g = weights[k] * (_sigmoid(w @ value) - labels[k]) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    weight = _weights(z[:-1], n[:-1], l1)
    kept = np.flatnonzero(weight)
    return Model(known[kept], weight[kept], float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)))


def _weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Whole labelled texts (key, text, label) in the order of a hash, of bounded rows and bytes a label."""
    rows = columns(labels, key=id_col, label=label_col).where("label in (0, 1) and key is not null")
    chosen = stratified(rows, "label", "key", per_label)
    # The chosen rows are bounded, so they are broadcast to find their texts' lengths, then the texts.
    order = uniform(F.col("key"), F.lit(7))
    sized = columns(docs, key=id_col, text=text_col).join(F.broadcast(chosen), "key").select("key", "label", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    running = Window.partitionBy("label").orderBy(order, "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sized.withColumn("total", F.sum("size").over(running)).where(F.col("total") <= most_bytes).select("key", "label").distinct()
    return columns(docs, key=id_col, text=text_col).join(F.broadcast(fits), "key").orderBy(order, "key", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, **options: object) -> Model:
    """Train on a bounded sample, which comes to the driver as whole texts."""
    return train([(None if r.text is None else r.text.encode(), int(r.label)) for r in sample(docs, labels, **options).select("text", "label").collect()])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row, from its whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in texts(batches, 1, PART_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(found))], names=["key", "score"])

    return columns(df, key=id_col, text=text_col).transform(arrow(run, f"key {kind}, score double"))
