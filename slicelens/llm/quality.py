"""Quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
encoded, gated attention weighs the encodings, and the weighted sum is scored:

    h_k = tanh(W x_k + b)
    a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))
    score = sigmoid(c . sum_k a_k h_k + d)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm import words
from slicelens.llm.common import fold, read
from slicelens.llm.registry import query
from slicelens.llm.toxicity import sampled

#: At most about so many labelled rows are used to fit.
FITTED = 6000
PASSAGE = 100
THRESHOLD = 0.3
BINS = 32
HIDDEN, GATE = 32, 16
_MARKS = "!#$%&*|.,;:?-_/\\\"'()<>=@"
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _i
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[128:] = 4
_CLASS[[*range(9, 14)]] = 5
_KINDS = 6 + len(_MARKS)
WIDTH = _KINDS + BINS + 7


def passages(texts: list[str | None], size: int = PASSAGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and row of every passage of a batch, in bounded parts.

    A passage is ``size`` words in a row; the last of a text has the rest. A
    text without words has one passage of zeros. Parts cut by ``words.pieces``
    begin a new passage.
    """
    for owners, part in words.pieces(texts):
        data, starts = words.joined(part)
        s, e = words.spans(data, words.UNBLANK)
        text = np.searchsorted(starts, s, side="right") - 1
        per_text = np.bincount(text, minlength=len(part))
        first = np.concatenate(([0], np.cumsum(per_text)[:-1]))
        n_passages = np.maximum(1, -(-per_text // size))
        base = np.concatenate(([0], np.cumsum(n_passages)[:-1]))
        total = int(n_passages.sum())
        of_word = base[text] + (np.arange(len(s)) - first[text]) // size
        x = np.zeros((total, WIDTH), np.float32)
        row = np.repeat(owners, n_passages)
        if len(s):
            n_words = np.bincount(of_word, minlength=total)
            full = np.maximum(n_words, 1)
            # Bytes between two words belong to the later one, those after a text's last word to it.
            at = np.arange(len(data))
            own = np.searchsorted(starts, at, side="right") - 1
            word = np.minimum(np.searchsorted(e, at, side="right"), (first + per_text)[own] - 1)
            inside = (per_text[own] > 0) & (at != starts[own + 1] - 1)
            of_byte = of_word[word]
            n_bytes = np.maximum(np.bincount(of_byte[inside], minlength=total), 1)
            kinds = np.bincount((of_byte * _KINDS + _CLASS[data])[inside], minlength=total * _KINDS)
            x[:, :_KINDS] = np.sqrt(kinds.reshape(total, _KINDS) / n_bytes[:, None])
            low = words.lower_ascii(data).astype(np.int64)
            pair = ((low[:-1] * 31 + low[1:]) * 40503 >> 4) % BINS
            paired = inside[:-1] & inside[1:]
            bins = np.bincount((of_byte[:-1] * BINS + pair)[paired], minlength=total * BINS)
            x[:, _KINDS : _KINDS + BINS] = np.sqrt(bins.reshape(total, BINS) / n_bytes[:, None])
            h = words.Sums(data).hashes(s, e)
            again = np.zeros(len(s), bool)
            again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
            length = (e - s).astype(np.float64)
            mean = np.bincount(of_word, length, total) / full
            order = np.lexsort((h, of_word))
            new = np.ones(len(s), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
            distinct = np.bincount(of_word[order], new, total)
            lone = length == 1
            x[:, _KINDS + BINS :] = np.stack([
                np.bincount(of_word, again, total) / full,
                distinct / full,
                np.log1p(mean),
                np.log1p(np.sqrt(np.maximum(np.bincount(of_word, length**2, total) / full - mean**2, 0))),
                np.bincount(of_word, lone, total) / full,
                np.bincount(of_word, _CLASS[data[e - 1]] >= 6, total) / full,
                np.minimum(n_words / size, 1),
            ], axis=1)
        yield x, row


class Attention:
    """The model and its gradient; bags are runs of rows."""

    def __init__(self, width: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        deal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.centre, self.spread = np.zeros(width), np.ones(width)
        self.p = {
            "W": deal(width, HIDDEN), "b": np.zeros(HIDDEN), "V": deal(HIDDEN, GATE),
            "U": deal(HIDDEN, GATE), "w": deal(GATE), "c": deal(HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """``starts`` is the first row of each bag; every bag has one row at least."""
        p, n = self.p, len(x)
        size = np.diff(np.append(starts, n))
        x = (x - self.centre) / self.spread
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "size": size,
                "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -50, 50)))}

    def gradient(self, f: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        g = (f["s"] - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], f["size"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["size"]))
        dv = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dt = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dt, "b": dt.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()]),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 128) -> None:
        rng = np.random.default_rng(2)
        every = np.concatenate(bags)
        self.centre, self.spread = every.mean(0), every.std(0) + 0.05
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                x = np.concatenate([bags[i] for i in pick])
                starts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])[:-1]))
                step += 1
                for k, g in self.gradient(self.forward(x, starts), y[pick], starts).items():
                    g = g + 1e-4 * self.p[k]
                    m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g**2
                    self.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), 64):
            part = batch.iloc[lo : lo + 64]
            found = list(passages(part.text.tolist()))
            x, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            ends = np.searchsorted(row, np.arange(1, len(part)))
            yield pd.DataFrame({
                "label": part.label.to_numpy(),
                "bag": [b.astype(np.float16).tobytes() for b in np.split(x, ends)],
            })


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FITTED
) -> Attention | None:
    """The model, fitted on about ``most`` labelled rows outside fold 0; None without both labels."""
    known = (
        labels.filter((fold(F.col("doc_id")) != 0) & F.col(label).isin(0, 1))
        .select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    )
    n, n_1 = known.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    if not n_1 or n_1 == n:
        return None
    # The ids are bounded by `most`.
    chosen = F.broadcast(known.filter(sampled(F.col("doc_id"), "q", most, n)))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").repartition(16)
    rows = sample.mapInPandas(_bags, "label int, bag binary").collect()
    if len({r.label for r in rows}) < 2:
        return None
    model = Attention(WIDTH)
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    model.fit(bags, np.array([r.label for r in rows], np.float64))
    return model


def quality_score(text: Column, model: Attention | None) -> Column:
    """Score of every whole text, from all its passages; 1 for all where there is no model.

    The sums over passages are carried from part to part, so a text of any
    length is read in bounded memory.
    """

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.ones(len(column)))
        p, n = model.p, len(column)
        # The gate lies between -1 and 1, so the logits are bounded and need no running maximum.
        top = np.abs(p["w"]).sum()
        z, weight = np.zeros((n, HIDDEN)), np.zeros(n)
        for x, row in passages(column.tolist()):
            h = np.tanh(((x - model.centre) / model.spread) @ p["W"] + p["b"])
            gate = np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))
            e = np.exp(gate @ p["w"] - top)
            np.add.at(z, row, e[:, None] * h)
            weight += np.bincount(row, e, n)
        g = (z / np.maximum(weight, 1e-300)[:, None]) @ p["c"] + p["d"]
        return pd.Series(1 / (1 + np.exp(-np.clip(g, -50, 50))))

    return score(text)


@query("op2_quality_classifier")
def op2_quality_classifier(spark, folder):
    """Quality score of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, folder, "labels"))
    scored = docs.select("doc_id", quality_score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
