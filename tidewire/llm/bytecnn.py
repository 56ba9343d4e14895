"""Text quality by a small convolutional network over bytes, in numpy (operator 5).

Filters of seven bytes run over the whole text in steps of two. Their largest
responses within overlapping chunks describe each chunk; the largest, mean and
smallest of these over all chunks go through one hidden layer to one
probability. Varied text wakes most filters in every chunk, repetitive text only a few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.sampling import held_out, labelled_sample
from tidewire.llm.tasks import map_rows

SAMPLE_ROWS = 4000  # labelled rows that are learned from, at most
SAMPLE_BYTES = 32 << 20  # of their texts, which are read whole whatever their length
WIDTH, STRIDE, FILTERS, HIDDEN = 7, 2, 16, 16
HOP = 128  # a chunk is two hops long, and one starts at every hop
SLICE = 1024  # hops whose responses are held at once
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.5


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, hops of each): every text padded with zeros to whole hops, two at least.

    One more hop of zeros follows each text, so that no filter sees two texts.
    """
    parts, hops = [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        n = max(2, -(-(len(raw) + WIDTH) // HOP)) + 1
        parts += [raw, bytes(n * HOP - len(raw))]
        hops.append(n)
    return np.frombuffer(b"".join(parts) + bytes(WIDTH), np.uint8), np.array(hops)


@dataclass
class Net:
    """Filters as one table per place in the window, byte by filter, and two dense layers; ``constant`` replaces them."""

    tables: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    constant: float | None = None

    def hop_peaks(self, data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter within each hop, and with ``places`` where it was."""
        hops = (len(data) - WIDTH) // HOP
        peaks, at = np.empty((hops, FILTERS), np.float32), np.empty((hops, FILTERS), np.int64) if places else None
        for low in range(0, hops, SLICE):
            high = min(low + SLICE, hops)
            n = (high - low) * HOP // STRIDE
            start = low * HOP
            total = self.tables[0].take(data[start : start + n * STRIDE : STRIDE], axis=0)
            for k in range(1, WIDTH):
                total += self.tables[k].take(data[start + k : start + k + n * STRIDE : STRIDE], axis=0)
            total = total.reshape(high - low, HOP // STRIDE, FILTERS)
            if places:
                best = total.argmax(axis=1)
                peaks[low:high] = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0]
                at[low:high] = best * STRIDE + (np.arange(low, high) * HOP)[:, None]
            else:
                peaks[low:high] = total.max(axis=1)
        return peaks, at

    def chunks(self, peaks: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values of all chunks, first chunk of each text, first hop of each chunk)."""
        firsts = np.concatenate([[0], np.cumsum(hops)[:-1]])
        starts = np.ones(len(peaks), bool)
        starts[firsts + hops - 1] = starts[firsts + hops - 2] = False
        hop = np.flatnonzero(starts)
        return np.tanh(np.maximum(peaks[hop], peaks[hop + 1])), firsts - 2 * np.arange(len(hops)), hop

    def pooled(self, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        count = np.diff(np.append(firsts, len(values)))[:, None]
        return np.concatenate([np.maximum.reduceat(values, firsts), np.add.reduceat(values, firsts) / count, np.minimum.reduceat(values, firsts)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        data, hops = lay_out(texts)
        values, firsts, _ = self.chunks(self.hop_peaks(data)[0], hops)
        hidden = np.maximum(self.pooled(values, firsts) @ self.w1 + self.b1, 0)
        return (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))).astype(float)

    def gradients(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted logistic loss, for tables, w1, b1, w2, b2. Only peaks pass a gradient on to the filters."""
        data, hops = lay_out(texts)
        peaks, at = self.hop_peaks(data, places=True)
        values, firsts, hop = self.chunks(peaks, hops)
        count = np.diff(np.append(firsts, len(values)))
        pooled = self.pooled(values, firsts)
        hidden = np.maximum(pooled @ self.w1 + self.b1, 0)
        chance = 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))
        slope = ((chance - y) * weight / len(y)).astype(np.float32)
        d_hidden = np.outer(slope, self.w2) * (hidden > 0)
        d_max, d_mean, d_min = np.split(d_hidden @ self.w1.T, 3, axis=1)
        text = np.repeat(np.arange(len(texts)), count)
        d_values = (d_mean / count[:, None])[text]
        for part, share in ((pooled[:, :FILTERS], d_max), (pooled[:, 2 * FILTERS :], d_min)):
            hit = values == part[text]
            d_values += np.where(hit, (share / np.maximum(np.add.reduceat(hit, firsts, dtype=np.float32), 1))[text], 0)
        d_values *= 1 - values**2
        later = peaks[hop + 1] > peaks[hop]
        where = np.where(later, at[hop + 1], at[hop])
        column = np.broadcast_to(np.arange(FILTERS), where.shape)
        d_tables = np.stack([
            np.bincount((data[where + k].astype(np.int64) * FILTERS + column).ravel(), d_values.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            for k in range(WIDTH)
        ])
        return [d_tables, pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ slope, slope.sum()]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Net:
    """Adam over shuffled batches; both classes get equal weight in total."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(draw(WIDTH, 256, FILTERS, scale=0.15), draw(3 * FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=0.3), np.zeros((), np.float32))
    ones = labels.mean()
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    names = ("tables", "w1", "b1", "w2", "b2")
    mean, square = ([np.zeros_like(getattr(net, n), dtype=np.float32) for n in names] for _ in range(2))
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for i, (name, g) in enumerate(zip(names, net.gradients([texts[r] for r in rows], labels[rows], weight[rows]), strict=True)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g**2
                move = rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-7)
                setattr(net, name, (getattr(net, name) * (1 - 1e-4) - move).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> Net:
    """Learn from the whole texts of at most ``rows`` labelled rows outside the held-out part, fewer if they have ``max_bytes``.

    Without both classes the score is constant: the share of ones, or 1 without labels.
    """
    sample = labelled_sample(docs, labels, doc_id, text, label, rows, max_bytes).select("doc_id", "text", "label").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in sample], float)
    if len(set(y)) < 2:
        empty = np.zeros(0, np.float32)
        return Net(empty, empty, empty, empty, empty, float(y.mean()) if len(y) else 1.0)
    return train([r["text"] for r in sample], y, epochs)


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, each text read to its end; null texts count as empty."""

    def run(batches):
        for ids, texts in batches:
            for low in range(0, len(ids), 64):
                yield [ids[low : low + 64], net.score(texts[low : low + 64])]

    scored = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text)), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
