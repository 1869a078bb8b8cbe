"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each model sees the words of
the text and the probabilities of the earlier categories. In training those
probabilities are out-of-fold predictions, so a later model learns from the
errors that the earlier ones make on texts they haven't seen.

The models are fitted on the driver from a bounded sample of whole labelled
documents (``sample_rows`` and ``sample_bytes``, drawn by a hash); scoring is
one scan of all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, give_back, table, utf8

#: Labelled documents that the models are fitted on at most, and bytes of their texts, the last one apart.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 24 << 20
#: Bytes of a word's beginnings that count as features of their own.
STEMS = (4, 5, 6, 7)
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 or c == 39 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Hashes of the distinct words, A-Z lower-cased, and of their beginnings: inflected forms share a stem."""
    words = set(text.lower().translate(_SPACES).split())
    words = words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


@dataclass
class Link:
    """One category: hashes of its words in order, their weights, those of the earlier probabilities, and the bias."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, texts: Sequence[np.ndarray], before: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        words = np.concatenate([*texts, np.zeros(0, np.uint64)])
        sums = np.zeros(len(texts))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            sums = np.bincount(rows[known], self.weights[at[known]], len(texts))
        z = sums + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Bag:
    """The words that occur in ``least`` of the examples at least, as (example, word) pairs."""

    def __init__(self, texts: Sequence[np.ndarray], least: int = 5):
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        words = np.concatenate([*texts, np.zeros(0, np.uint64)])
        order = np.argsort(words, kind="stable")
        rows, words = rows[order], words[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])[: len(words)])
        many = np.diff(np.append(first, len(words)))
        often = many >= least
        keep = np.repeat(often, many)
        self.names = words[first[often]]
        self.rows = rows[keep]
        self.cols = np.repeat(np.arange(len(self.names), dtype=np.int32), many[often])
        self.n = len(texts)


def _lbfgs(loss, w: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """The minimum of a smooth convex function that returns its value and slope."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-4:
            break
        d, held = -slope, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            held.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(past, reversed(held)):
            d = d + s * (a - (y @ d) / (s @ y))
        step, down = 1.0, slope @ d
        while True:
            new, (there, after) = w + step * d, loss(w + step * d)
            if there <= value + 1e-4 * step * down or step < 1e-10:
                break
            step /= 2
        if (after - slope) @ (new - w) > 1e-12:
            past = [*past, (new - w, after - slope)][-memory:]
        w, value, slope = new, there, after
    return w


def _fit(bag: _Bag, use: np.ndarray, y: np.ndarray, before: np.ndarray, strict: float = 9.0, ridge: float = 0.03, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with a ridge on the words that chance alone would hardly deal so unevenly to the classes.

    ``use``: which examples count. ``strict``: minus the logarithm of that
    chance, by Chernoff's bound. Returns weights of all words of the bag (0 for
    the others), of the earlier probabilities, and the bias.
    """
    inside = use[bag.rows]
    rows, cols = bag.rows[inside], bag.cols[inside]
    n, n1, words = int(use.sum()), float(y[use].sum()), len(bag.names)
    rate = n1 / n if n else 0.0
    chosen = np.zeros(words, bool)
    if 0 < rate < 1:
        both = np.bincount(cols, minlength=words).astype(float)
        ones = np.bincount(cols, y[rows], words)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = ones / both
            off = np.nan_to_num(ones * np.log(share / rate)) + np.nan_to_num((both - ones) * np.log((1 - share) / (1 - rate)))
        chosen = off > strict
    keep = chosen[cols]
    size = int(chosen.sum())
    rows, cols = rows[keep], (np.cumsum(chosen) - 1)[cols[keep]]
    m = before.shape[1]
    start = np.zeros(size + m + 1)
    start[-1] = np.log((n1 + 1) / (n - n1 + 2))  # without examples it stays there: one third
    target = np.where(use, y, 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, w[:size][cols], bag.n) + before @ w[size:-1] + w[-1]
        r = np.where(use, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target, 0.0)
        slope = np.concatenate([np.bincount(cols, r[rows], size), before.T @ r, [r.sum()]])
        slope[:-1] += ridge * w[:-1]
        return float((np.logaddexp(0, z) - target * z)[use].sum() + ridge / 2 * (w[:-1] @ w[:-1])), slope

    w = _lbfgs(loss, start, steps)
    x, e, bias = w[:size], w[size:-1], float(w[-1])
    weights = np.zeros(words)
    weights[chosen] = x
    return weights, e, bias


def fit_chain(texts: Sequence[np.ndarray], labels: dict[str, np.ndarray], folds: int = 5) -> list[Link]:
    """``labels``: 0 or 1 by category, in the order of the chain."""
    bag, chain = _Bag(texts), []
    fold, before = np.arange(bag.n) % folds, np.zeros((bag.n, 0))
    for category, y in labels.items():
        x, e, bias = _fit(bag, np.ones(bag.n, bool), y, before)
        used = np.flatnonzero(x)
        chain.append(Link(category, bag.names[used], x[used], e, bias))
        if len(chain) == len(labels):
            break  # nothing follows that would see held-out predictions
        held = np.zeros(bag.n)
        for k in range(folds):
            x, e, bias = _fit(bag, fold != k, y, before)
            z = np.bincount(bag.rows, x[bag.cols], bag.n) + before @ e + bias
            held[fold == k] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[fold == k]
        before = np.concatenate([before, held[:, None]], axis=1)
    return chain


def predict_chain(chain: Sequence[Link], texts: Sequence[np.ndarray]) -> np.ndarray:
    before = np.zeros((len(texts), 0))
    for link in chain:
        before = np.concatenate([before, link.predict(texts, before)[:, None]], axis=1)
    return before


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> list[Link]:
    """Fits the chain on at most ``sample_rows`` labelled documents, those of the least hash, while their texts come to ``sample_bytes``.

    A document in the sample is used whole. Rows with a null id, text or label
    are no examples; each different pair of an id's labels and texts is one,
    however often its rows are repeated. Without examples the chain has no
    words and every probability is one third, so nothing is rejected.
    """
    usable = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (id, *categories)))
    ys = [f"_y{i}" for i in range(len(categories))]
    drawn = usable.select(F.col(f"`{id}`").alias("_id"), *[F.col(f"`{c}`").cast("int").alias(y) for c, y in zip(categories, ys)]).distinct()
    drawn = drawn.orderBy(F.xxhash64("_id"), *ys).limit(sample_rows)
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{id}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_h"), F.octet_length(f"`{text}`").alias("_n"), F.col(f"`{text}`").cast("binary").alias("_text")
    )
    pairs = texts.select("_id", "_h", "_n").join(F.broadcast(drawn), "_id").distinct().orderBy(F.xxhash64("_id", "_h"), *ys).limit(sample_rows)
    chosen = pairs.toPandas()
    chosen = chosen[chosen["_n"].cumsum().shift(fill_value=0) < sample_bytes].drop(columns="_n")
    if not len(chosen):
        return fit_chain([], {c: np.zeros(0, np.int64) for c in categories})
    wanted = docs.sparkSession.createDataFrame(list(chosen.itertuples(index=False, name=None)), pairs.drop("_n").schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # rows of the sample that this task has sent, no more than the sample has
        for batch in chunks(batches, "_text"):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_id", "_h", *ys))))
            new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            batch = batch.take(pa.array(new, pa.int64()))
            found = [features(t).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_id", "_h", *ys)], pa.array(found, pa.binary())], ["_id", "_h", *ys, "words"])

    ddl = f"_id {dict(texts.dtypes)['_id']}, _h long, " + ", ".join(f"{y} int" for y in ys) + ", words binary"
    rows = texts.join(F.broadcast(wanted), ["_id", "_h"]).mapInArrow(run, ddl).groupBy("_id", "_h", *ys).agg(F.first("words").alias("words")).toPandas()
    rows = rows.sort_values(["words", *ys], ignore_index=True)
    give_back()
    chain = fit_chain([np.frombuffer(w, np.uint64) for w in rows["words"]], {c: rows[y].to_numpy(np.int64) for c, y in zip(categories, ys)})
    del rows
    give_back()
    return chain


def score(docs: DataFrame, chain: Sequence[Link], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, p_<category>...)`` for every row; a null text has no words. Only the two columns are read."""
    shipped = docs.sparkSession.sparkContext.broadcast(list(chain))
    kept = docs.select(F.col(f"`{id}`"), utf8(f"`{text}`").alias("_text"))
    names = [f"p_{link.category}" for link in chain]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            p = predict_chain(shipped.value, [features(t) for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(id), *[pa.array(c) for c in p.T]], [id, *names])

    return kept.mapInArrow(run, f"`{id}` {dict(kept.dtypes)[id]}, " + ", ".join(f"{c} double" for c in names))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


#: In the order of the chain.
CATEGORIES = ("low_quality", "toxic")


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, a probability for each category and ``rejected``: toxic at ``threshold`` or more."""
    chain = train(labelled, labels, CATEGORIES)
    return score(docs, chain).withColumn("rejected", F.col("p_toxic") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, docs, _labels(spark, sf_dir))


def keep_civil(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that aren't rejected, scored inside their own scan: no join, so any id, null or repeated, will do."""
    chain = train(labelled, labels, CATEGORIES)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    toxic = len(chain) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [features((t or "").encode()) for t in batch.column("text").to_pylist()]
            keep = predict_chain(shipped.value, texts)[:, toxic] < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
