"""Toxicity by a convolutional text classifier, trained in numpy.

Words go through two hash functions into two embedding tables, so that a chance collision in one does
not make a harmless word look like a harmful one; a third table is for how a word begins, which
inflected forms share. Filters of several widths run over the embedded
words; the maximum of each over the whole text, and the mean of its maxima over the text's quarters, which
tells one harmful word from many, go through a ramp into one logit. The threshold of the
logit is calibrated by language, which is told from the function words of the text itself.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import held_out, map_batches, ship, stage, texts
from joingrove.llm.quality import one_label
from joingrove.sources.staging import discard

BUCKETS, DIM, TABLES = 1 << 18, 4, 3  # rows and columns of each table
BEGINNING = 5  # letters
WIDTHS, FILTERS = (1, 2, 3), 6
QUARTERS = 4
THRESHOLD = 0.5
#: The fit takes at most so many labelled rows, the first by hash, and leaves out those with more words.
TRAIN_ROWS, TRAIN_WORDS = 6000, 20_000
#: Words that the fit takes in all.
TRAIN_TOTAL = 12_000_000
EPOCHS, BATCH, BATCH_WORDS, RATE, DECAY = 8, 64, 1 << 16, 0.08, 1e-4
#: Positives of a language at which its own threshold weighs as much as the common one.
ENOUGH = 10
#: Words whose places a worker remembers, and words scored at a time.
REMEMBER, CHUNK = 200_000, 1 << 17

# Frequent function words of the languages that the calibration tells apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this from at have not",
    "de": "der die und das ist nicht mit ein den von dem im zu auf sich des eine als auch für",
    "fr": "le les et des un une que est dans pour du qui par au sur pas avec ce il sont",
    "es": "el los las y del se con por una para como su lo al más o pero sus ha son",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_WORD = re.compile(r"[^\W_]+")
_PAD = np.uint32(BUCKETS)  # a row of zeros behind each table
_BYTES = 4 * TABLES  # of a word's places


def _places(word: str) -> tuple[int, ...]:
    data = word.encode()
    return crc32(data) % BUCKETS, crc32(data, 0x9E3779B9) % BUCKETS, crc32(word[:BEGINNING].encode(), 0x85EBCA6B) % BUCKETS


def _ids(places: bytes) -> np.ndarray:
    return np.frombuffer(places, "<u4").reshape(-1, TABLES)


class _Remember(dict):
    """From a stretch without white space to the places of its words, as bytes."""

    def __missing__(self, stretch: str) -> bytes:
        got = np.array([_places(w) for w in _WORD.findall(stretch)], "<u4").tobytes()
        if len(self) < REMEMBER:
            self[stretch] = got
        return got


_remembered = _Remember()


def word_places(text: str | None) -> bytes:
    """Four bytes a word and table: its places. Words are lower-cased runs of letters and digits."""
    return b"".join(map(_remembered.__getitem__, (text or "").lower().split()))


def _languages(first: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The language of each document with the most function words; 0 without any."""
    table = np.zeros(BUCKETS + 1, np.int64)
    for i, words in enumerate(FUNCTION_WORDS.values(), 1):
        table[[_places(w)[0] for w in words.split()]] = i
    found = np.bincount(doc * len(LANGUAGES) + table[first], minlength=n * len(LANGUAGES)).reshape(n, -1)
    found[:, 0] = 0
    return found.argmax(1)


# ---------------------------------------------------------------- the network

@dataclass
class Network:
    tables: list[np.ndarray]  # each (BUCKETS + 1, DIM); the last row stays zero
    filters: list[np.ndarray]  # by width: (width, TABLES * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    by_language: np.ndarray
    seed: int

    def __getstate__(self) -> dict:
        """Of the tables only the rows that the fit moved: the others, most, come from the seed again."""
        moved = []
        for t, first in zip(self.tables, _first_tables(self.seed)):
            values, times = np.unique(t[:, 0], return_counts=True)
            common = values[times.argmax()]  # the log odds of a bucket without words
            first[:-1, 0] = common
            rows = np.flatnonzero((t != first).any(1)).astype(np.uint32)
            moved.append((common, rows, t[rows]))
        return self.__dict__ | {"tables": moved}

    def __setstate__(self, state: dict) -> None:
        tables = []
        for (common, rows, values), t in zip(state["tables"], _first_tables(state["seed"])):
            t[:-1, 0] = common
            t[rows] = values
            tables.append(t)
        self.__dict__.update(state | {"tables": tables})

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([t[ids[:, i]] for i, t in enumerate(self.tables)], 1)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """A row per place of the batch, a column per filter."""
        parts = []
        for f in self.filters:
            y = x @ f[0]
            for o in range(1, len(f)):
                y[:-o] += x[o:] @ f[o]
            parts.append(y)
        return np.concatenate(parts, 1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.offset

    def score(self, docs: list[bytes]) -> np.ndarray:
        """Calibrated probabilities; a text without words scores as two empty places."""
        logit, language = self.raw(docs)
        return 1.0 / (1.0 + np.exp(-np.clip(logit - self.by_language[language], -30, 30)))

    def raw(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not docs:
            return np.zeros(0), np.zeros(0, int)
        logits, languages = [], []
        for group in _groups(docs):
            if len(group) == 1 and len(group[0]) > 2 * _BYTES * CHUNK:  # very long: the maximum of overlapping stretches
                logits.append(self.logits(self._pooled_by_stretch(_ids(group[0]))))
                first = _ids(group[0])[:, 0]
                languages.append(_languages(first, np.zeros(len(first), np.int64), 1))
                continue
            parts = [_ids(d) for d in group]
            logits.append(self.logits(self._pooled(parts)))
            lengths = [len(p) for p in parts]
            first = np.concatenate([p[:, 0] for p in parts])
            languages.append(_languages(first, np.repeat(np.arange(len(parts)), lengths), len(parts)))
        return np.concatenate(logits), np.concatenate(languages)

    def _pooled(self, parts: list[np.ndarray]) -> np.ndarray:
        ids, starts = _padded(parts)
        maxima = np.maximum.reduceat(self.convolve(self.embed(ids)), starts.ravel(), axis=0).reshape(*starts.shape, -1)
        return _pool(maxima[:, :QUARTERS])

    def _pooled_by_stretch(self, words: np.ndarray) -> np.ndarray:
        """The same for one document, CHUNK words at a time."""
        ids, starts = _padded([words])
        maxima = []
        for start, end in zip(starts[0], starts[0][1:]):
            stretches = [(i, min(i + CHUNK, end)) for i in range(start, end, CHUNK)]
            maxima.append(np.max([self.convolve(self.embed(ids[i:j + max(WIDTHS) - 1]))[:j - i].max(0) for i, j in stretches], 0))
        return _pool(np.array(maxima)[None])


def _first_tables(seed: int, rng: np.random.Generator | None = None) -> Iterator[np.ndarray]:
    """The tables before the fit, one at a time; they are the first values of the seed's generator."""
    rng = rng or np.random.default_rng(seed)
    for _ in range(TABLES):
        t = rng.normal(0, 0.01, (BUCKETS + 1, DIM)).astype(np.float32)
        t[-1] = 0
        yield t


def _pool(maxima: np.ndarray) -> np.ndarray:
    """From the maxima of the quarters: that of the whole and the mean."""
    return np.concatenate([maxima.max(1), maxima.mean(1)], 1)


def _groups(docs: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for d in docs:
        if group and size + len(d) > _BYTES * CHUNK:
            yield group
            group, size = [], 0
        group.append(d)
        size += len(d)
    yield group


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One batch, and the places where the quarters of each document begin and the last one ends.

    A document has QUARTERS empty places, so that no quarter is without a place, and others behind them that
    belong to no quarter: windows that begin there would reach into the next document.
    """
    gap = np.full((QUARTERS + max(WIDTHS) - 1, TABLES), _PAD, np.uint32)
    ids = np.concatenate([x for p in parts for x in (p, gap)])
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], (sizes + len(gap)).cumsum()[:-1]])
    return ids, starts[:, None] + (sizes + QUARTERS)[:, None] * np.arange(QUARTERS + 1) // QUARTERS


def train(docs: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """The network for the given documents, the same each time.

    The first dimension of each table starts from the smoothed log odds of its bucket, so that few rows
    suffice; filters, ramp and embeddings are then fitted by Adagrad on the logistic loss. With one class
    only, all scores are near that class's share.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    parts = [_ids(d) for d in docs]
    tables = []
    for i, t in enumerate(_first_tables(seed, rng)):
        held = [np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)]
        for p, label in zip(parts, y):
            held[int(label)][np.unique(p[:, i])] += 1
        n0, n1 = max((y == 0).sum(), 1), max((y == 1).sum(), 1)
        prior = 2.0
        odds = np.log((held[1] + prior * n1 / (n0 + n1)) / n1) - np.log((held[0] + prior * n0 / (n0 + n1)) / n0)
        t[:, 0] = np.clip(odds, -2, 4) / TABLES
        t[-1] = 0
        tables.append(t)
    filters = [rng.normal(0, 0.1, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:  # one filter of each width sums the log odds of its words
        f[:, [DIM * i for i in range(TABLES)], 0] += 1.0 / len(f)
    k = 2 * FILTERS * len(WIDTHS)
    net = Network(tables, filters, np.full(k, -0.3, np.float32), np.full(k, 0.1, np.float32),
                  float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(len(LANGUAGES)), seed)
    if not parts or y.min() == y.max():
        net.out[:] = 0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    params = [*net.filters, net.bias, net.out]
    seen = [np.full_like(p, 0.1) for p in params]
    seen_rows, seen_offset = [np.full(t.shape, 0.1, np.float32) for t in tables], 0.1
    for _ in range(EPOCHS):
        for some in _batches(rng.permutation(len(parts)), parts):
            ids, starts = _padded([parts[i] for i in some])
            x = net.embed(ids)
            conv = net.convolve(x)
            best = np.stack([a + conv[a:b].argmax(0) for row in starts for a, b in zip(row, row[1:])])  # place of each maximum
            maxima = np.take_along_axis(conv, best, 0).reshape(len(some), QUARTERS, -1)
            pooled = _pool(maxima) + net.bias
            ramp = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(ramp @ net.out + net.offset, -30, 30)))
            g = (p - y[some]) * weight[some] / len(some)
            g_pooled = (g[:, None] * net.out * (pooled > 0)).astype(np.float32)
            whole, mean = np.split(g_pooled, 2, 1)
            winner = maxima.argmax(1)[:, None] == np.arange(QUARTERS)[None, :, None]
            g_best = (winner * whole[:, None] + mean[:, None] / QUARTERS).reshape(len(best), -1)
            grads, g_rows = [], []
            for w, f in enumerate(net.filters):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                gf = np.zeros_like(f)
                for o in range(len(f)):
                    place = np.minimum(best[:, cols] + o, len(ids) - 1)
                    gf[o] = np.einsum("bfd,bf->df", x[place], g_best[:, cols])
                    g_rows.append((place.ravel(), (g_best[:, cols, None] * f[o].T[None]).reshape(-1, TABLES * DIM)))
                grads.append(gf + DECAY * f)
            grads += [g_pooled.sum(0), ramp.T @ g + DECAY * net.out]
            for q, s, d in zip(params, seen, grads):
                s += d * d
                q -= (RATE * d / np.sqrt(s)).astype(np.float32)
            seen_offset += g.sum() ** 2
            net.offset -= RATE * g.sum() / np.sqrt(seen_offset)
            place, rows = np.concatenate([a for a, _ in g_rows]), np.concatenate([b for _, b in g_rows])
            for i, t in enumerate(tables):
                touched, back = np.unique(ids[place, i], return_inverse=True)
                d = np.zeros((len(touched), DIM), np.float32)
                np.add.at(d, back, rows[:, i * DIM:(i + 1) * DIM])
                d[touched == _PAD] = 0
                seen_rows[i][touched] += d * d
                t[touched] -= 0.3 * RATE * d / np.sqrt(seen_rows[i][touched])
    return net


def _batches(order: np.ndarray, parts: list[np.ndarray]) -> Iterator[list[int]]:
    """Documents in order, BATCH or BATCH_WORDS words at a time, which bounds the memory."""
    some, words = [], 0
    for i in order.tolist():
        if some and (len(some) == BATCH or words + len(parts[i]) > BATCH_WORDS):
            yield some
            some, words = [], 0
        some.append(i)
        words += len(parts[i])
    yield some


def train_calibrated(docs: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Two networks, each trained on one half, show what logits unseen texts get: these give each language
    its threshold. The network returned is trained on all rows."""
    y = np.asarray(labels, float)
    net = train(docs, y, seed)
    logit, language = np.zeros(len(y)), np.zeros(len(y), int)
    for half in (0, 1):
        rest, own = [i for i in range(len(y)) if i % 2 != half], [i for i in range(len(y)) if i % 2 == half]
        if not rest or y[rest].min() == y[rest].max():
            return net
        logit[own], language[own] = train([docs[i] for i in rest], y[rest], seed + 1 + half).raw([docs[i] for i in own])
    if len(y) and y.min() != y.max():
        net.by_language = _calibrate(logit, language, y)
    return net


def _calibrate(logit: np.ndarray, language: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logit that counts as one half, by language: each language's best cut, drawn to the common one."""
    def cut(z: np.ndarray, t: np.ndarray) -> float:
        """The middle of the widest gap among cuts with the fewest errors, where a false alarm counts as two misses."""
        order = np.argsort(z, kind="stable")
        z, t = z[order], t[order]
        wrong = np.concatenate([[0], np.cumsum(t)]) + 2 * ((len(t) - t.sum()) - np.concatenate([[0], np.cumsum(1 - t)]))
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        room = np.concatenate([[0], np.diff(z), [0]])
        room[wrong > wrong.min()] = -1
        return float(edges[room.argmax()])

    common = cut(logit, y)
    out = np.full(len(LANGUAGES), common)
    for i in range(len(LANGUAGES)):
        own = language == i
        positives = int(y[own].sum())
        if positives and positives < own.sum():
            weight = positives / (positives + ENOUGH)
            out[i] = weight * cut(logit[own], y[own]) + (1 - weight) * common
    return out


# ---------------------------------------------------------------- tables

def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        rows: int = TRAIN_ROWS, words: int = TRAIN_TOTAL) -> Network:
    """Learns from labelled rows that are not held out: the first `rows` ids by hash, the documented bound.

    Executors hash the words, and one task gets their places only, _BYTES a word, of `words` words at most, and trains; the driver
    gets the network, which has a fixed size. Where ids repeat or texts are very long, rows count in the order of their ids'
    hash, then their places, until either bound is reached.
    Without any row, or with one label only, the network knows no more than that. Null texts are empty ones.
    """
    chosen = (one_label(labels, label).where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, ys, bodies in batches:
            places = [word_places(t) for t in bodies]
            few = [i for i, p in enumerate(places) if len(p) <= _BYTES * TRAIN_WORDS]
            yield {"doc_id": [ids[i] for i in few], "y": [ys[i] for i in few], "places": [places[i] for i in few]}

    joined = (texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
              .select("doc_id", F.col(label).cast("int").alias("y"), "text"))
    hashed = stage(map_batches(joined, run, "doc_id long, y int, places binary"), "toxicity-words")
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("i"), F.md5("places").alias("m"))
    sizes = hashed.select(order.alias("o"), F.length("places").alias("n")).orderBy("o").limit(rows).collect()
    left, last = words * _BYTES, None
    for r in sizes:
        left -= r["n"]
        if left < 0:
            break
        last = r["o"]
    if last is None:
        discard(hashed)
        return train_calibrated([], np.zeros(0))
    until = F.struct(F.lit(last["h"]).cast("long").alias("h"), F.lit(last["i"]).cast("long").alias("i"), F.lit(last["m"]).alias("m"))
    trained = map_batches(hashed.where(order <= until).limit(len(sizes)), _learn, "network binary").collect()
    discard(hashed)
    return pickle.loads(trained[0]["network"])


def _learn(batches: Iterator[tuple]) -> Iterator[dict]:
    """The pickled network of the rows (doc_id, y, places) of one task, in an order of their own."""
    got = sorted((row for columns in batches for row in zip(*columns)), key=lambda r: (r[0], r[2]))
    yield {"network": [pickle.dumps(train_calibrated([r[2] for r in got], np.array([r[1] for r in got])))]}


def score_toxicity(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts have a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few MB, of fixed size

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, held, bodies in batches:
            score = shared.value.score([word_places(t) for t in bodies])
            yield {"doc_id": ids, "held_out": held, "score": score.tolist(),
                   "predicted": (score >= threshold).astype(int).tolist()}

    rows = texts(docs, id_col, text_col).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def toxic(text: Column, network: Network, spark, threshold: float = THRESHOLD) -> Column:
    """Whether a text is rejected, as a column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("boolean")
    def run(bodies):
        return bodies.__class__(shared.value.score([word_places(t) for t in bodies]) >= threshold)

    return run(F.coalesce(text, F.lit("")))
