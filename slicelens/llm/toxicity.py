"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive sample; all other text is an unlabelled
mixture. The classifier minimises prior * E_P[l(g)] plus the larger of 0 and
E_U[l(-g)] - prior * E_P[l(-g)], which estimates the risk on texts that are
not toxic without needing any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm import words
from slicelens.llm.common import fold, read, release, scratch, stage
from slicelens.llm.registry import query

#: At most about so many rows are used to fit.
POSITIVES, UNLABELLED = 3000, 9000
FEATURES = 1024
#: Deviations by which a feature's share of texts must differ between the samples.
DEVIATIONS = 4.0
PREFIXES = (4, 5, 6, 7, 8)
#: A feature counts c / (c + HALF + DENSITY * words of the text).
HALF, DENSITY = 0.5, 0.003


def sampled(identity: Column, salt: str, most: int, there: int) -> Column:
    """A repeatable choice, by hash, of about ``most`` of ``there`` rows."""
    share = min(1.0, most / max(there, 1))
    drawn = F.pmod(F.xxhash64(identity, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return drawn < F.lit(share)


def text_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For bounded parts of a batch: feature hashes, their rows, and words a row (of that part)."""
    for owners, part in words.pieces(texts):
        data, starts = words.joined([p.lower() for p in part])
        s, e = words.spans(data, words.LETTERS)
        row = owners[np.searchsorted(starts, s, side="right") - 1]
        sums = words.Sums(data)
        found, rows = [sums.hashes(s, e)], [row]
        for n in PREFIXES:
            long = e - s > n
            found.append(sums.hashes(s[long], s[long] + n) + np.uint64(n))
            rows.append(row[long])
        count = np.bincount(row, minlength=len(texts))
        yield np.concatenate(found), np.concatenate(rows), count


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either sample that hold a feature, summed over the task."""
    for batch in batches:
        for positive in (True, False):
            texts = batch.text[batch.positive == positive].tolist()
            for lo in range(0, len(texts), 256):
                pairs = [np.stack((h, r.astype(np.uint64))) for h, r, _ in text_features(texts[lo : lo + 256])]
                if not pairs:
                    continue
                pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
                feature, n = np.unique(pairs[0], return_counts=True)
                yield pd.DataFrame({
                    "feature": feature.view(np.int64),
                    "p": n * int(positive), "u": n * int(not positive),
                })


def chosen_features(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """The features whose share of texts differs most between the samples, sorted.

    In units of the deviation that equal shares would show; those under
    ``DEVIATIONS`` are left out as chance.
    """
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    p, u = F.col("p") / max(n_p, 1), F.col("u") / max(n_u, 1)
    both = (F.col("p") + F.col("u")) / max(n_p + n_u, 1)
    chance = both * (1 - both) * (1 / max(n_p, 1) + 1 / max(n_u, 1)) + F.lit(1e-12)
    rows = (
        sample.mapInPandas(_occurrences, "feature long, p long, u long")
        .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .filter("p + u >= 5")
        .select("feature", ((p - u) / F.sqrt(chance)).alias("gap"))
        .filter(F.abs("gap") >= DEVIATIONS)
        .orderBy(F.abs("gap").desc(), "feature").limit(most).collect()
    )
    return np.sort(np.array([r.feature for r in rows], np.int64).view(np.uint64))


class Table:
    """Looks features up; a bitmap over 16 bits turns away nearly all others first."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.first = np.zeros(1 << 16, bool)
        self.first[features & np.uint64(0xFFFF)] = True

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature number and value of all features found."""
        width = len(self.features)
        keys, n_words = [], np.zeros(len(texts))
        for h, r, n in text_features(texts):
            n_words += n
            if not width:
                continue
            near = self.first[h & np.uint64(0xFFFF)]
            h, r = h[near], r[near]
            at = np.minimum(np.searchsorted(self.features, h), width - 1)
            hit = self.features[at] == h
            keys.append(r[hit] * width + at[hit])
        key, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, int),) * 2
        row = key // max(width, 1)
        return row, key % max(width, 1), c / (c + HALF + DENSITY * n_words[row])


def fit_nnpu(
    x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 500, penalty: float = 1e-6
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with the least non-negative risk.

    Adam on whole samples, first with the logistic loss, which is convex and
    finds the side of every feature, then with the sigmoid loss l(g) = 1 / (1 +
    exp(g)), which is bounded, so that the positives within the unlabelled
    sample cannot outweigh the rest. While the estimated risk on negatives is
    below 0, steps go up that risk instead.
    """
    w, bias = np.zeros(x_p.shape[1], np.float32), 0.0
    for loss in ("logistic", "sigmoid"):
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            g_p, g_u = np.clip(x_p @ w + bias, -50, 50), np.clip(x_u @ w + bias, -50, 50)
            s_p, s_u = 1 / (1 + np.exp(-g_p)), 1 / (1 + np.exp(-g_u))
            # Slopes of l(g) on positives, of l(-g) on positives and on unlabelled texts.
            if loss == "logistic":
                negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
                fit, back, rest = s_p - 1, s_p, s_u
            else:
                negative = s_u.mean() - prior * s_p.mean()
                back, rest = s_p * (1 - s_p), s_u * (1 - s_u)
                fit = -back
            if negative < 0:
                by_p, by_u = prior * back, -rest
            else:
                by_p, by_u = prior * (fit - back), rest
            by_p, by_u = (by_p / len(g_p)).astype(np.float32), (by_u / len(g_u)).astype(np.float32)
            grad = np.append(by_p @ x_p + by_u @ x_u + penalty * w, by_p.sum() + by_u.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            change = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w = (w - change[:-1]).astype(np.float32)
            bias -= float(change[-1])
    return w.astype(np.float64), bias


def _rows(table: Table):
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                row, at, value = table.values(part.text.tolist())
                ends = np.searchsorted(row, np.arange(1, len(part)))
                yield pd.DataFrame({
                    "positive": part.positive.to_numpy(),
                    "at": [a.astype(np.int32).tobytes() for a in np.split(at, ends)],
                    "value": [a.astype(np.float32).tobytes() for a in np.split(value, ends)],
                })

    return collect


def _dense(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
    return x


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES,
) -> tuple[Table, np.ndarray, float]:
    """Features, weights and bias, from at most about ``positives`` and ``unlabelled`` texts.

    Only ids outside fold 0 are looked at. The class prior is the positive share
    of their labelled rows. Without positives (or without any text) the model
    is a constant score of 0.
    """
    trains = fold(F.col("doc_id")) != 0
    known = labels.filter(trains & F.col(label).isNotNull()).select("doc_id", label)
    n, n_p = known.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    spark = docs.sparkSession
    if not n_p:
        return Table(np.zeros(0, np.uint64)), np.zeros(0), -50.0
    ids = (
        known.filter((F.col(label) == 1) & sampled(F.col("doc_id"), "p", positives, n_p))
        .select("doc_id").distinct()
    )
    texts = docs.filter(trains).select("doc_id", "text")
    there = docs.select("doc_id").count()
    # The ids are bounded by `positives`.
    sample = texts.join(F.broadcast(ids), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    sample = sample.unionByName(
        texts.filter(sampled(F.col("doc_id"), "u", unlabelled, there))
        .select(F.lit(False).alias("positive"), "text")
    )
    with scratch(spark):
        sample = stage(sample.repartition(16), "toxic-sample")
        table = Table(chosen_features(sample, features))
        rows = sample.mapInPandas(_rows(table), "positive boolean, at binary, value binary").collect()
    width = len(table.features)
    x_p = _dense([r for r in rows if r.positive], width)
    x_u = _dense([r for r in rows if not r.positive], width)
    if not len(x_p) or not len(x_u):
        return Table(np.zeros(0, np.uint64)), np.zeros(0), -50.0
    prior = min(max(n_p / n, 1e-3), 0.999)
    return table, *fit_nnpu(x_p, x_u, prior)


def toxicity_score(text: Column, model: tuple[Table, np.ndarray, float]) -> Column:
    """Score of every whole text; a null or empty text has the bias's score."""
    table, weights, bias = model

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        out = np.empty(len(column))
        texts = column.tolist()
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            row, at, value = table.values(part)
            g = bias + np.bincount(row, value * weights[at] if len(at) else None, len(part))
            out[lo : lo + len(part)] = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        release()
        return pd.Series(out)

    return score(text)


@query("op5_toxicity")
def op5_toxicity(spark, folder):
    """Toxicity score of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
