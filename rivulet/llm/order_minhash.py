"""Document fingerprints by Order MinHash.

Word k-mers are numbered by occurrence, so repeats count. For each of the
permutations the few k-mers of least hash are selected, put back into text
order and hashed as a tuple. Two texts agree on a tuple only if they share the
k-mers and their order: the share of equal tuples follows the edit distance,
which plain MinHash doesn't see.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

#: Words in a k-mer, k-mers in a tuple, tuples in a fingerprint.
K, TUPLE, SKETCHES = 3, 2, 32
_AT_ONCE = 8_192
_rng = np.random.default_rng(2718)
_TIMES = _rng.integers(0, 1 << 64, SKETCHES, np.uint64, endpoint=False) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 64, SKETCHES, np.uint64, endpoint=False)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmers(text: bytes) -> np.ndarray:
    """Hashes of the word k-mers in text order; fewer than K words make one."""
    words = text.split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) < K:
        return np.array([digest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    out = h[: len(h) - K + 1]
    for i in range(1, K):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - K + 1 + i])
    return out


def numbered(grams: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with the number of its occurrence."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(grams + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def fingerprint(text: bytes) -> np.ndarray:
    """``SKETCHES`` tuples of ``TUPLE`` k-mers, each hashed to 32 bits."""
    grams = kmers(text)
    keys = numbered(grams)
    values, places = [], []
    for start in range(0, len(keys), _AT_ONCE):
        h = (keys[None, start : start + _AT_ONCE] ^ _FLIP[:, None]) * _TIMES[:, None]
        rows = np.arange(SKETCHES)
        for _ in range(min(TUPLE, h.shape[1])):
            i = h.argmin(axis=1)
            values.append(h[rows, i])
            places.append(i + start)
            h[rows, i] = _MOST
    values, places = np.array(values), np.array(places)
    if len(values) > TUPLE:
        best = np.argsort(values, axis=0, kind="stable")[:TUPLE]
        places = np.take_along_axis(places, best, axis=0)
    places = np.sort(places, axis=0)
    out = np.zeros(SKETCHES, np.uint64)
    for row in places:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + grams[row] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_text(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def from_text(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp), ">u4")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first ones, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint)`` for every row, in one scan. A null text is empty; equal texts have equal fingerprints."""
    kept = docs.select(F.col(f"`{id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            found = [to_text(fingerprint(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(found, pa.string())], [id, "fingerprint"])

    return kept.mapInArrow(run, f"`{id}` {dict(kept.dtypes)[id]}, fingerprint string")


def neighbour_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document, by descending id.

    After the last document comes the first. A null text is empty, null ids
    come last, texts of one id are in order of their XXH64 (seed 42, signed),
    so a frequent id or null is split like any other; a lone document is its
    own next. Texts cross the network once: rows are dealt into ranges of (id,
    hash), and the first document of a range is sent to the range before it as
    well. Of fully repeated rows a task sends the text once and how many there
    were.
    """
    spark = docs.sparkSession
    doc, body = F.col(f"`{id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = docs.select(
        doc.isNull().alias("no_id"), F.bitwise_not(F.coalesce(doc, F.lit(0)).cast("long")).alias("back"),
        F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("text"),
    )
    order = ["no_id", "back", "h", "h2"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = kept.select(*order).distinct().repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)))
    heads = sorted(tuple(r[1]) for r in ranges.collect())
    buckets = max(1, len(heads))
    columns = ["bucket", "helper", *order, "many", "text", "fp"]
    types_in = [pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string()]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types_in)], columns)

        sent: dict[tuple, int] = {}  # repeated rows that were left out, by key
        for batch in chunks(batches, "text"):
            out = []
            for *key, t in zip(*(batch.column(c).to_pylist() for c in (*order, "text"))):
                key = tuple(key)
                if key in sent:
                    sent[key] += 1
                    continue
                sent[key] = 0
                bucket, fp = max(0, bisect_right(heads, key) - 1), to_text(fingerprint(t.encode()))
                out.append((bucket, False, *key, 1, t, fp))
                if buckets > 1 and heads[bucket] == key:
                    out.append(((bucket - 1) % buckets, True, *key, 1, t, fp))
            if out:
                yield rows(out)
        more = [(max(0, bisect_right(heads, k) - 1), False, *k, n, None, None) for k, n in sent.items() if n]
        for at in range(0, len(more), 65_536):
            yield rows(more[at : at + 65_536])

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(own: tuple, after: tuple) -> tuple:
            no_id, back, body, print_ = own
            changed = edited(body, after[2]).encode()
            fp, other = from_text(print_), fingerprint(changed)
            return None if no_id else ~back, len(body), hashlib.sha256(changed).hexdigest(), print_, to_text(other), likeness(fp, other), likeness(fp, from_text(after[3]))

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        def close(last: tuple, many: int, after: tuple) -> Iterator[pa.RecordBatch]:
            """The rows of one document, each of its copies followed by the next one."""
            if many > 1:
                same = row(last, last)
                for at in range(0, many - 1, 8_192):
                    yield told([same] * min(8_192, many - 1 - at))
            out.append(row(last, after))

        first = last = key = bucket = None
        many, closed, out = 0, False, []
        for batch in chunks(batches, "text"):
            for b, helper, *now, n, body, fp in zip(*(batch.column(c).to_pylist() for c in columns)):
                if b != bucket:
                    if last is not None and not closed:
                        yield from close(last, many, first)
                    first, last, key, bucket, closed = None, None, None, b, False
                if closed:
                    continue
                if not helper and now == key:
                    many += n  # rows with a text come before those that only count
                    continue
                own = (now[0], now[1], body, fp)
                if last is not None:
                    yield from close(last, many, own)
                if helper:
                    closed = True
                    continue
                last, key, many = own, now, n
                first = own if first is None else first
            if out:
                yield told(out)
                out = []
        if last is not None and not closed:
            yield from close(last, many, first)
        if out:
            yield told(out)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    dealt = kept.mapInArrow(deal, "bucket int, helper boolean, no_id boolean, back long, h long, h2 long, many long, text string, fp string")
    dealt = dealt.repartitionById(buckets, F.col("bucket"))
    ranked = dealt.sortWithinPartitions("bucket", "helper", *order, F.col("fp").asc_nulls_last())
    return ranked.mapInArrow(report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_report(table(spark, sf_dir, "documents"))
