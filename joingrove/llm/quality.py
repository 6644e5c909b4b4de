"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Statistics are taken once per document, in its task. Class means and covariances are sums that Spark
adds up over all labelled rows. Scoring whitens each row by the class's cached Cholesky factor.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import held_out, map_batches, stage, texts

FEATURES = ("words", "word_length", "capitals", "digits", "marks", "symbols", "bars", "cries", "other_bytes",
            "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "line_length", "long_words", "line_ends")
THRESHOLD = 0.3
#: Weight of the class's own covariance is n / (n + SHRINK * features); of the rest, POOLED goes to the pooled one.
SHRINK, POOLED, FLOOR = 2.0, 0.8, 1e-3
#: Log-density differences are divided by this: the features are not normal, so differences are too large.
TEMPER = 4.0

_CLASS = np.zeros(256, np.int64)  # what each byte counts as: 0 none of these
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#$%&*~^_=+<>{}[]@\\/`",
                             b"|", b"!", bytes(range(128, 256)), b" \t\n\r\v\f"), 1):
    _CLASS[list(_bytes)] = _i


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; of an empty or null one those of no words."""
    data = (text or "").encode()
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, filled = len(words), max(len(data) - int(kinds[8]), 0)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    again = sum(a == b for a, b in pairwise(words))
    long_words = sum(len(w) * c for w, c in counts.items() if len(w) > 14)
    ends = sum(x[-1:] in b".!?" for x in lines)
    share = lambda x, of: float(np.log((x + 0.5) / (max(of - x, 0) + 0.5 + 0.002 * of)))
    return [float(np.log1p(n)), float(np.log1p(filled / max(n, 1))),
            *(share(int(kinds[i]), filled) for i in range(1, 8)),
            float(np.log1p(len(counts)) / np.log1p(max(n, 1))) if n else 1.0, share(top, n), share(again, n),
            share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(filled / max(len(lines), 1))),
            share(long_words, filled), share(ends, len(lines))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the array of statistics, for each row."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, bodies in batches:
            yield {"doc_id": ids, "x": [statistics(t) for t in bodies]}

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, x array<double>")


# ---------------------------------------------------------------- the discriminant

@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor of its covariance, log determinant, log prior."""
    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    fallback: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        log_density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        return 1.0 / (1.0 + np.exp(-np.clip((log_density[1] - log_density[0]) / TEMPER, -40, 40)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    """From the rows, sums (2, d) and sums of products (2, d, d) of the two classes.

    With a class that has no row every score is the share of class 1 (one half without any row).
    """
    d = sums.shape[1]
    if (n < 1).any():
        return Discriminant(sums, squares, n, fallback=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums / n[:, None]
    own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(n / n.sum(), own, 1)
    spread = np.maximum(np.diag(pooled), FLOOR)
    whiten, constant = [], []
    for c in (0, 1):
        a = n[c] / (n[c] + SHRINK * d)
        cov = a * own[c] + (1 - a) * (POOLED * pooled + (1 - POOLED) * np.diag(spread)) + FLOOR * np.diag(spread)
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        constant.append(TEMPER * np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(constant))


def fit(rows: DataFrame, label: str) -> Discriminant:
    """From rows with x and a 0/1 label. Only sums meet: one number per class and product of features."""
    d = len(FEATURES)

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for xs, ys in batches:
            x, y = np.array(xs, float).reshape(-1, d), np.array(ys)
            for c in (0, 1):
                own = x[y == c]
                n[c], s[c], q[c] = n[c] + len(own), s[c] + own.sum(0), q[c] + own.T @ own
        flat = np.concatenate([n[:, None], s, q.reshape(2, -1)], 1)
        yield {"c": [c for c in (0, 1) for _ in flat[c]], "i": [i for c in (0, 1) for i in range(flat.shape[1])],
               "v": flat.ravel().tolist()}

    parts = map_batches(rows.select("x", F.col(label).cast("int")), run, "c int, i int, v double")
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        total[r["c"], r["i"]] = r["v"]
    return discriminant(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))


def one_label(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label; ids with null or contradicting labels teach nothing and are left out."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
            .groupBy(F.col(id_col).cast("long").alias("doc_id"))
            .agg(F.min(label).cast("int").alias(label), F.max(label).cast("int").alias("_other"))
            .where(F.col(label) == F.col("_other")).drop("_other"))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learns from all labelled rows that are not held out."""
    x = stage(features(docs, id_col, text_col), "quality-features")
    model = fit(x.where(~held_out()).join(one_label(labels, label), "doc_id"), label)

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, held, xs in batches:
            score = model.score(np.array(xs, float).reshape(-1, len(FEATURES)))
            yield {"doc_id": ids, "held_out": held, "score": score.tolist(), "predicted": (score >= threshold).astype(int).tolist()}

    return map_batches(x.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "x"), run,
                       "doc_id long, held_out boolean, score double, predicted int")
