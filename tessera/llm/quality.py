"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, fixed stretches of its UTF-8 bytes that together cover the whole text. Each passage is
described by frequencies of byte classes, of class pairs and of repeated words, and encoded by a tanh layer; a gated
attention layer (tanh branch times sigmoid branch) learned from document labels weighs the passages; a logistic unit
scores their weighted mean. All layers are trained together by gradient steps on a bounded sample of labelled documents.

Defined results: a null or empty text is one empty passage; repeated rows are scored alike; of rows that repeat an id one
text is learnt from, and none of those with a null id; a label that repeats counts as its largest; training data of one
class, or none, gives a constant score (the share of label 1, or a half); an empty table gives an empty result; a column
named like a new one is replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import append, double, long, remainder, slices
from tessera.session import broadcast_if_small

PASSAGE = 1024
#: Classes of bytes: space, line end, lower, upper, digit, full stop or comma, other closing marks, quotes and brackets,
#: bars and slashes, symbols, beyond ASCII, control.
CLASSES = 12


def byte_classes() -> np.ndarray:
    table = np.full(256, 9, np.uint8)
    for chars, k in ((b" \t", 0), (b"\r\n\x0b\x0c", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 4), (b".,", 5), (b"!?;:", 6), (b"\"'()[]{}<>", 7), (b"|/\\", 8)):
        table[list(chars)] = k
    table[128:] = 10
    table[[*range(9), *range(14, 32), 127]] = 11
    return table


TABLE = byte_classes()
EXTRA = 4
WIDTH = CLASSES + CLASSES * CLASSES + EXTRA


def describe(text: str | None) -> np.ndarray:
    """One row of WIDTH features for each passage of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(raw) // PASSAGE)
    at, k = np.arange(len(raw)) // PASSAGE, TABLE[raw].astype(np.int64)
    sizes = np.bincount(at, minlength=n).astype(np.float64)[:, None]
    single = np.bincount(at * CLASSES + k, minlength=n * CLASSES).reshape(n, CLASSES) / sizes
    pairs = np.bincount(at[1:] * CLASSES**2 + k[:-1] * CLASSES + k[1:], minlength=n * CLASSES**2).reshape(n, -1) / sizes
    # words by a sum over their bytes: how long they are, and how many of them repeat one of their passage
    blank = k <= 1
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    extra = np.zeros((n, EXTRA))
    if len(first):
        last = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        where = at[first]
        sums = np.cumsum(np.r_[0, (raw.astype(np.int64) + 7) ** 2])
        code = (sums[last] - sums[first]) * 1_000_003 + (last - first) * 8191 + raw[first].astype(np.int64) * 257 + raw[last - 1]
        words = np.bincount(where, minlength=n).astype(np.float64)
        distinct = np.unique(np.stack([where, code]), axis=1)[0]
        kinds = np.bincount(distinct, minlength=n)
        whole = len(np.unique(code))
        extra[:, 0] = np.minimum(4.0, np.bincount(where, (last - first).astype(float), n) / np.maximum(words, 1) / 8)
        extra[:, 1] = kinds / np.maximum(words, 1)
        extra[:, 2] = whole / len(code)
        extra[:, 3] = np.log1p(len(code)) / 10
    return np.concatenate([np.sqrt(single), np.sqrt(pairs), extra], 1).astype(np.float32)


@dataclass
class AttentionModel:
    """Encoder w, attention branches v and u with weights a, and the document classifier c."""

    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of the bags whose passages start at ``starts`` in ``x``, and what the gradient needs."""
        h = np.tanh(x @ self.w[:-1] + self.w[-1])
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))
        e = (t * s) @ self.a
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(h * weight[:, None], starts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30)))
        return p, z, weight, h, t, s, bag

    def scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[float]]:
        """Score of each bag, and the largest attention weight in it."""
        if self.constant is not None:
            return np.full(len(bags), self.constant), [1.0] * len(bags)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        p, _, weight, *_ = self.forward(np.concatenate(bags), starts)
        return p, np.maximum.reduceat(weight, starts).tolist()


def gradients(m: AttentionModel, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of the bags in ``x`` by layer."""
    p, z, weight, h, t, s, bag = m.forward(x, starts)
    g = (p - y) / len(y)
    dz = g[:, None] * m.c[:-1]
    along = (h * dz[bag]).sum(1)
    de = weight * (along - np.add.reduceat(weight * along, starts)[bag])
    dt, ds = de[:, None] * m.a * s * (1 - t * t), de[:, None] * m.a * t * s * (1 - s)
    dh = (dz[bag] * weight[:, None] + dt @ m.v.T + ds @ m.u.T) * (1 - h * h)
    return {"w": np.concatenate([x.T @ dh, dh.sum(0, keepdims=True)]), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": np.r_[z.T @ g, g.sum()]}


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    rng = np.random.default_rng(seed)
    if not len(bags) or y.min() == y.max():
        return AttentionModel(*[np.zeros((1, 1))] * 5, constant=float(y.mean()) if len(bags) else 0.5)
    d = bags[0].shape[1]
    m = AttentionModel(rng.normal(0, d**-0.5, (d + 1, hidden)), rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, gate**-0.5, gate), np.zeros(hidden + 1))
    names = ("w", "v", "u", "a", "c")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, starts = np.concatenate([bags[i] for i in pick]), np.cumsum([0, *[len(bags[i]) for i in pick]])[:-1]
            grads = gradients(m, x, starts, y[pick])
            step += 1
            for n in names:  # Adam
                q = grads[n] + decay * getattr(m, n)
                first[n], second[n] = 0.9 * first[n] + 0.1 * q, 0.999 * second[n] + 0.001 * q * q
                setattr(m, n, getattr(m, n) - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_by: int = 4, held_rest: int = 2, sample_docs: int = 4_000, sample_passages: int = 64) -> AttentionModel:
    """Fit on labelled rows whose remainder differs from ``held_rest``.

    The sample is bounded: at most ``sample_docs`` documents, half of each class where there are enough, in hash order,
    and of each at most ``sample_passages`` evenly spaced passages. Scoring always reads all passages.
    """
    lab = labels.filter(f"{label_col} in (0, 1)").groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    lab = lab.filter(remainder(id_col, held_by) != held_rest)
    # only as many labels as the sample needs go on, so that the texts are met by a broadcast of bounded size
    picked = [lab.filter(F.col("__label") == k).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs // 2) for k in (0, 1)]
    chosen = broadcast_if_small(picked[0].unionByName(picked[1]), sample_docs + 1)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                x = describe(text)
                keep = np.unique(np.linspace(0, len(x) - 1, min(len(x), sample_passages)).astype(int))
                rows.append(x[keep].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["x", "label", "id"])

    found = docs.select(id_col, text_col).join(chosen, id_col).select(text_col, "__label", F.col(id_col).cast("long")).mapInArrow(run, "x binary, label int, id long")
    # one text an id, however many rows repeat it: at most sample_docs rows
    rows = found.groupBy("id").agg(F.max("x").alias("x"), F.max("label").alias("label")).collect()
    rows = sorted(rows, key=lambda r: r["id"])
    bags = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, WIDTH).astype(float) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score, the number of passages and the largest attention weight."""

    def work(texts):
        made, focus, sizes = [], [], []
        for at in range(0, len(texts), 64):
            bags = [describe(t).astype(float) for t in texts[at : at + 64]]
            p, most = model.scores(bags)
            made += p.tolist()
            focus += most
            sizes += map(len, bags)
        return [pa.array(made, pa.float64()), pa.array(sizes, pa.int64()), pa.array(focus, pa.float64())]

    return append(docs, text_col, [double("score"), long("n_passages"), double("attention")], lambda: work, keep_text)
