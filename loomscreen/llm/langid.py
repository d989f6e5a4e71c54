"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, the last one padded.
Bytes are embedded, filters of several widths slide over them, each filter's
largest response in a window is kept (max pooling), and a softmax layer gives
the window's languages.  A text's probabilities are the means over its windows,
weighted by their bytes.  Training is plain numpy (Adam on cross-entropy) over
a bounded sample of labelled texts; inference covers every byte.

Edge cases: a null text or one without a letter is ``und`` with score 0;
languages that are null aren't learned; repeated rows are predicted alike; an
empty table gives an empty result; with no labelled text at all, every
prediction is ``und``; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import arrow, stratified, texts
from .storage import columns

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
PAD = 256
#: Labelled texts learned from, a language; each whole.
SAMPLE_TEXTS = 1500
STEPS = 700
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def _im2col(embedded: np.ndarray, width: int) -> np.ndarray:
    """(windows, length + width - 1, e) to (windows * length, width * e)."""
    n, padded, e = embedded.shape
    length = padded - width + 1
    out = np.empty((n, length, width, e), dtype=embedded.dtype)
    for i in range(width):
        out[:, :, i] = embedded[:, i : i + length]
    return out.reshape(n * length, width * e)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], rng: np.random.Generator) -> Network:
        widest, n = max(WIDTHS), FILTERS * len(WIDTHS)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(labels, f(PAD + 1, EMBED, scale=0.5), f(widest * EMBED, n, scale=0.2), np.zeros(n, np.float32), f(n, len(labels), scale=0.2), np.zeros(len(labels), np.float32))
        net.filters *= net.mask
        return net

    @property
    def mask(self) -> np.ndarray:
        """Zero where a filter is narrower than the widest."""
        reach = np.repeat(WIDTHS, FILTERS)
        return (np.repeat(np.arange(max(WIDTHS)), EMBED)[:, None] < reach[None]).astype(np.float32)

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = windows.shape
        tail = np.full((n, max(WIDTHS) - 1), PAD, dtype=windows.dtype)
        patches = _im2col(self.embedding[np.concatenate([windows, tail], axis=1)], max(WIDTHS))
        return patches, (patches @ self.filters).reshape(n, length, -1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        """Probabilities (windows, labels); memory is bounded by ``step`` windows."""
        out = [self._softmax(self._responses(windows[i : i + step])[1].max(axis=1)) for i in range(0, len(windows), step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        n, length = windows.shape
        patches, responses = self._responses(windows)
        at = responses.argmax(axis=1)
        pooled = np.take_along_axis(responses, at[:, None], axis=1)[:, 0]
        hidden = np.maximum(pooled + self.bias, 0)
        d = self._softmax(pooled)
        d[np.arange(n), target] -= 1
        d /= n
        back = (d @ self.dense.T) * (hidden > 0)
        rows = patches.reshape(n, length, -1)[np.arange(n)[:, None], at]
        d_filters = np.einsum("nfk,nf->kf", rows, back) * self.mask
        d_patch = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, max(WIDTHS), EMBED)
        tail = np.full((n, max(WIDTHS) - 1), PAD, dtype=windows.dtype)
        bytes_at = np.concatenate([windows, tail], axis=1)[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, bytes_at.reshape(-1), d_patch.reshape(-1, EMBED))
        return [d_embedding, d_filters, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 1) -> Network | None:
    """A network over (text, language) pairs; None without samples."""
    samples = sorted((t, k) for t, k in samples if t)
    labels = sorted({k for _, k in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = Network.new(labels, rng)
    by_label = [[t for t, k in samples if k == label] for label in labels]
    weights = [net.embedding, net.filters, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    length = 128
    for step in range(1, steps + 1):
        target = rng.integers(len(labels), size=96)
        windows = np.full((len(target), length), PAD, dtype=np.int64)
        for i, k in enumerate(target):
            text = by_label[k][rng.integers(len(by_label[k]))]
            n = int(rng.integers(12, length + 1)) if rng.random() < 0.5 else length
            at = int(rng.integers(max(1, len(text) - n + 1)))
            piece = np.frombuffer(text[at : at + n], dtype=np.uint8)
            windows[i, : len(piece)] = piece
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, net.gradients(windows, target), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = SAMPLE_TEXTS) -> Network | None:
    """Train on about ``per_label`` whole texts a language (a hash of the key chooses)."""
    rows = columns(df, key=id_col, text=text_col, label=label_col).where("label is not null and text is not null")
    chosen = stratified(rows, "label", "key", per_label)
    return train([(r.text.encode(), str(r.label)) for r in chosen.select("text", "label").toLocalIterator()])


def windows_of(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded windows of all texts, the text of each, and its bytes."""
    counts = [-(-len(t) // WINDOW) for t in found]
    flat = np.full(sum(counts) * WINDOW, PAD, dtype=np.uint16)
    sizes, at = [], 0
    for t, n in zip(found, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += n * WINDOW
        sizes += [WINDOW] * (n - 1) + [len(t) - WINDOW * (n - 1)] * (n > 0)
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(found)), counts), np.array(sizes, dtype=np.float64)


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, from its whole text; ``carry`` adds a struct ``carried`` of these columns."""
    rows = df.select(df[id_col].alias("key"), df[text_col].alias("text"), *([F.struct(*(df[c] for c in carry)).alias("carried")] if carry else []))
    kinds = [f"key {rows.schema['key'].dataType.simpleString()}", "lang_pred string", "score double"]
    if carry:
        kinds.append(f"carried {rows.schema['carried'].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in texts(batches, 1, 2 << 20):
            usable = [i for i, t in enumerate(found) if net and t and _LETTER.search(t.decode())]
            label, score = [UNDETERMINED] * len(found), np.zeros(len(found))
            if usable:
                windows, owner, size = windows_of([found[i] for i in usable])
                p = net.predict(windows)
                mean = np.stack([np.bincount(owner, p[:, k] * size, len(usable)) for k in range(len(net.labels))], axis=1)
                mean /= np.bincount(owner, size, len(usable))[:, None]
                for i, row in zip(usable, mean, strict=True):
                    best = int(row.argmax())
                    label[i], score[i] = net.labels[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.string()), pa.array(score), *part.columns[2:]], names=["key", "lang_pred", "score", *part.schema.names[2:]])

    return rows.transform(arrow(run, ", ".join(kinds)))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
