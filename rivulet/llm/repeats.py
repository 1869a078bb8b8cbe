"""Repeated passages by sparse suffix arrays.

A word position is kept where its ``K``-word gram is a minimiser: the first
one of least hash of some ``W`` grams in a row. Two equal passages of ``LEAST =
K + W - 1`` words or more keep the same positions, so only the suffixes there
are needed, one word in sixteen. Suffixes whose gram occurs once are dropped.
The others are sent with their words to the task of their gram, sorted as
texts, and compared with their neighbours word by word: the longest common
prefixes of neighbours give the extension to the right, those of the texts
before the positions, sorted backwards, the extension to the left. A stretch of
``LEAST`` words around the position is a copy where some suffix shares as many
words on both sides; the first place in order of document is the original.
Hashes only choose and deal positions; what is equal is found on the words.

Equal texts are one document before anything is compared. Grams of more than
``OFTEN`` suffixes, e.g. of a licence in a third of all documents, aren't dealt
by the gram: each of their stretches goes by its own words, and its first place
is found by an aggregation that combines within each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, discard, fresh, lean, materialise, release_shuffles, table, utf8

#: A repeated passage has at least LEAST words, the gram at a minimiser K, a window of grams W.
LEAST, K = 50, 20
W = LEAST - K + 1
#: Suffixes of a gram that one task compares at most; suffixes compared at once, but for the rest of a gram's; rows that leave a worker at once.
OFTEN, AT_ONCE, OUT_ROWS = 1_024, 16_384, 8_192
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What tells documents apart: the id, null or not, and the text by two hashes and its length.
KEY = ["no_id", "doc", "h1", "h2", "bytes"]
_TEXT = KEY[2:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int = K) -> np.ndarray:
    """Hash of the ``size`` words from each position on, by doubling; the last ``size - 1`` positions have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, length, power, width = words, 0, words, 1
    while True:
        if size & width:
            done, length = (power if not length else _join(done, length, power)), length + width
        if length == size:
            return _mix(done[:n])
        power, width = _join(power, width, power), 2 * width


def _join(a: np.ndarray, length: int, b: np.ndarray) -> np.ndarray:
    m = max(0, min(len(a), len(b) - length))
    return _mix(a[:m] * _ODD + b[length : length + m] + np.uint64(length))


def _first_least(values: np.ndarray, size: int) -> np.ndarray:
    """Where the first least one of each ``size`` values in a row is."""
    at, low, width = np.arange(len(values)), values, 1

    def better(n: int, by: int) -> None:
        nonlocal at, low
        right = low[by : by + n] < low[:n]
        at, low = np.where(right, at[by : by + n], at[:n]), np.where(right, low[by : by + n], low[:n])

    while 2 * width <= size:
        better(len(at) - width, width)
        width *= 2
    if size > width:
        better(len(values) - size + 1, size - width)
    return at


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts end to end, and where each text ends."""
    lists = [t.split() for t in texts]
    ends = np.cumsum([len(x) for x in lists]) if lists else np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, chain.from_iterable(lists)), np.uint64, int(ends[-1]) if len(ends) else 0), ends.astype(np.int64)


def minimisers(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, grams, low, high)`` over texts laid end to end.

    The stretches that a position stands for begin ``low`` to ``high`` words
    before it; every stretch of ``LEAST`` words within a text has one position.
    """
    none = np.zeros(0, np.int64)
    if len(words) < LEAST:
        return none, none.view(np.uint64), none, none
    grams = gram_hashes(words)
    at = _first_least(grams, W)
    starts = np.arange(len(at))
    inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= LEAST
    at, starts = at[inside], starts[inside]
    if not len(at):
        return none, none.view(np.uint64), none, none
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lasts = np.append(begins[1:], len(at)) - 1
    where = at[begins]
    return where, grams[where], where - starts[lasts], where - starts[begins]


def _suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every text its number of words and its positions, with their grams and stretches."""
    for batch in chunks(batches, "_text"):
        words, ends = word_hashes(batch.column("_text").to_pylist())
        at, grams, low, high = minimisers(words, ends)
        begin = np.concatenate([[0], ends])[: len(ends)]
        owner = np.searchsorted(ends, at, side="right")
        cuts = pa.array(np.searchsorted(owner, np.arange(len(ends) + 1)).astype(np.int32))
        lists = [grams.view(np.int64), (at - begin[owner]).astype(np.int32), low.astype(np.int8), high.astype(np.int8)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in KEY], pa.array(np.diff(np.concatenate([[0], ends]))), *[pa.ListArray.from_arrays(cuts, pa.array(x)) for x in lists]],
            [*KEY, "words", "grams", "at", "low", "high"],
        )


_CONTEXT = "kind int, gram long, row long, no_id boolean, doc long, at int, low int, high int, left binary, right binary"
_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_END = b"\n"  # no word holds it


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept suffixes with the words around them that their stretches reach.

    ``kind`` 0: a suffix; ``left`` holds the words before it backwards, ``right``
    those from it on. 1: a stretch of a frequent gram, in ``right``, the first
    one in this piece of work. 2: a copy of such a one. A document whose row is
    repeated is taken once a task.
    """
    seen: set[int] = set()
    rows: list[tuple] = []
    firsts: dict[bytes, tuple] = {}

    def flush(all_: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, firsts
        if all_ or len(firsts) >= OUT_ROWS:
            rows += [(1, 0, row, no_id, doc, at, 0, 0, None, text) for text, (no_id, doc, row, at) in firsts.items()]
            firsts = {}
        if rows and (all_ or len(rows) >= OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
            rows = []

    for batch in chunks(batches, "_text"):
        places = batch.column("places")
        ends = np.cumsum(pc.list_value_length(places).to_numpy()).tolist()
        fields = [places.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("gram", "at", "low", "high", "often")]
        for text, row, no_id, doc, many, start, stop in zip(*(batch.column(c).to_pylist() for c in ("_text", "row", "no_id", "doc", "many")), [0, *ends], ends):
            if many > 1:
                if row in seen:
                    continue
                seen.add(row)
            words = text.split()
            for gram, at, low, high, often in zip(*(x[start:stop].tolist() for x in fields)):
                if not often:
                    left = words[at - high : at][::-1]
                    right = _END.join(words[at : at + LEAST - low]) + _END
                    rows.append((0, gram, row, no_id, doc, at, low, high, _END.join(left) + _END if left else b"", right))
                else:
                    for s in range(at - high, at - low + 1):
                        stretch, own = _END.join(words[s : s + LEAST]), (no_id, doc, row, s)
                        best = firsts.get(stretch)
                        if best is None or own < best:
                            firsts[stretch], best = own, best
                        else:
                            best = own
                        if best is not None:
                            rows.append((2, 0, best[2], best[0], best[1], best[3], 0, 0, None, None))
                if len(rows) >= OUT_ROWS or len(firsts) >= OUT_ROWS:
                    yield from flush(False)
        yield from flush(True)


def _numbers(texts: list[bytes], width: int, known: dict[bytes, int]) -> np.ndarray:
    """The words of each text as numbers, padded with -1."""
    lists = [t.split(_END)[:-1] for t in texts]
    lengths = np.array([len(x) for x in lists])
    flat = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(lists)), np.int32, int(lengths.sum()))
    out = np.full((len(texts), width), -1, np.int32)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _common(a: np.ndarray) -> np.ndarray:
    """Words that each row shares with the one before, from the start on; 0 for the first."""
    same = np.logical_and.accumulate(a[1:] == a[:-1], axis=1).sum(axis=1)
    return np.concatenate([[0], same])


def copied(grams: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(suffixes, W): whether the stretch that begins so many words before the suffix is a copy of one of lower rank.

    ``right`` and ``left`` hold words as numbers; rows are sorted by gram and
    ``right`` as texts, so suffixes that share words stand together.
    """
    n = len(grams)
    after = np.where(np.concatenate([[False], grams[1:] == grams[:-1]]), _common(right), 0)
    back = np.lexsort((*left.T[::-1], grams))
    before = np.where(np.concatenate([[False], grams[back][1:] == grams[back][:-1]]), _common(left[back]), -1)
    by_rank, out = np.argsort(rank, kind="stable"), np.zeros((n, W), bool)
    mine = np.empty(n, np.int64)
    for reach in range(W):
        mine[back] = np.cumsum(before < reach)
        both = np.cumsum(after < LEAST - reach) * np.int64(n + 1) + mine
        use = by_rank[((low <= reach) & (reach <= high))[by_rank]]
        order = np.argsort(both[use], kind="stable")
        use = use[order]
        out[use[1:], reach] = both[use[1:]] == both[use[:-1]]
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (gram, right): the copied stretches of each, as spans of words."""

    def spans(block: pa.Table) -> pa.RecordBatch:
        grams, row, doc, at, low, high = (block.column(c).to_numpy() for c in ("gram", "row", "doc", "at", "low", "high"))
        no_id = block.column("no_id").to_numpy()
        order = np.lexsort((at, row))  # a repeated row may have sent a suffix twice
        twice = np.zeros(len(row), bool)
        twice[order[1:]] = (row[order][1:] == row[order][:-1]) & (at[order][1:] == at[order][:-1])
        once = np.flatnonzero(~twice)
        texts = [block.column(c).take(pa.array(once)).to_pylist() for c in ("right", "left")]
        grams, row, doc, at, low, high, no_id = (x[once] for x in (grams, row, doc, at, low, high, no_id))
        known: dict[bytes, int] = {}
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((at, row, doc, no_id))] = np.arange(len(row))
        found = copied(grams, _numbers(texts[0], LEAST, known), _numbers(texts[1], W - 1, known), low, high, rank)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        k, near = np.nonzero(edge == 1)
        _, far = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(row[k]), pa.array(at[k].astype(np.int64) - far + 1), pa.array(at[k].astype(np.int64) - near + LEAST)], ["row", "start", "stop"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            block = pa.Table.from_batches(held)
            grams = block.column("gram").to_numpy()
            done = int(np.searchsorted(grams, grams[-1]))
            if done:
                yield spans(block.slice(0, done))
                block = block.slice(done).combine_chunks()
                held, n = block.to_batches(), block.num_rows
    if n:
        yield spans(pa.Table.from_batches(held))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (row, start), joined where they touch."""
    open_: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        row, start, stop = (batch.column(c).to_numpy() for c in ("row", "start", "stop"))
        out = []
        for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist()):
            if open_ is not None and open_[0] == r and a <= open_[2]:
                open_ = (r, open_[1], max(b, open_[2]))
            else:
                out += [open_] if open_ is not None else []
                open_ = (r, a, b)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["row", "start", "stop"])
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in open_], ["row", "start", "stop"])


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> list:
    """The columns of ``KEY`` for each row of ``docs``."""
    doc, body = F.col(f"`{id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [
        doc.isNull().alias("no_id"), F.coalesce(doc, F.lit(0)).cast("long").alias("doc"), F.xxhash64(body).alias("h1"),
        F.xxhash64(F.lit(1), body).alias("h2"), F.octet_length(body).alias("bytes"),
    ]


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(no_id, doc, h1, h2, bytes, start, stop)``: spans of words that an earlier place has as well.

    Every ``LEAST``-word stretch that occurs more than once is in the spans of
    all its places but the first, by document id and place; null ids come
    last, different texts of one id in any fixed order. Words are runs of
    non-space characters. ``doc`` is the id (0 for null, told apart by
    ``no_id``); rows with one id and different texts are different documents,
    fully repeated rows are one. Texts under ``LEAST`` words have no spans; a
    text may repeat itself.
    """
    spark = docs.sparkSession
    named = docs.select(*keyed(docs, id, text), utf8(f"`{text}`").alias("_text")).where(F.col("bytes") >= 2 * LEAST - 1)
    key = "no_id boolean, doc long, h1 long, h2 long, bytes int"
    found = materialise(named.mapInArrow(lean(_suffixes), f"{key}, words long, grams array<long>, at array<int>, low array<tinyint>, high array<tinyint>"), "suffixes")
    found = found.where(f"words >= {LEAST}")
    lists = ["words", "grams", "at", "low", "high"]
    texts = found.groupBy(*_TEXT).agg(F.min(F.struct("no_id", "doc")).alias("least"), F.count("*").alias("many"), F.first(F.struct(*lists)).alias("own"))
    texts = texts.select("least.*", *_TEXT, "many", "own.*").withColumn("row", F.monotonically_increasing_id())
    texts = materialise(texts, "texts")  # one row a text; ``row`` is stored, so it stays
    again = found.select(*KEY, "words").join(texts.select(*_TEXT, F.col("no_id").alias("_no"), F.col("doc").alias("_doc")), _TEXT)
    whole = again.where("no_id <> _no OR doc <> _doc").select(*KEY, F.lit(0).cast("long").alias("start"), F.col("words").alias("stop")).distinct()
    whole = materialise(whole, "whole")  # all copies of a text but the first are repeated from end to end
    discard(found)

    each = texts.select("row", F.explode(F.arrays_zip("grams", "at", "low", "high")).alias("s")).select("row", F.col("s.grams").alias("gram"), "s.at", "s.low", "s.high")
    often = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > OFTEN).alias("often"))
    often = materialise(often, "often")  # so that the join has plain exchanges, whose large partitions Spark splits
    kept = each.join(often, "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "at", "low", "high", "often")).alias("places"))
    places = materialise(texts.select("row", *KEY, "many").join(kept, "row"), "places")
    release_shuffles(spark)
    contexts = materialise(named.join(places, KEY).select("_text", "row", "no_id", "doc", "many", "places").mapInArrow(lean(_contexts), _CONTEXT), "contexts")
    discard(places)
    discard(often)
    release_shuffles(spark)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rare = contexts.where("kind = 0").drop("kind").repartition(parts, "gram").sortWithinPartitions("gram", "right").mapInArrow(lean(_compare), "row long, start long, stop long")
    stretches = contexts.where("kind = 1").select("row", "no_id", "doc", "at", "right")
    firsts = stretches.groupBy("right").agg(F.min(F.struct("no_id", "doc", "row", "at")).alias("first")).select("first.row", "first.at")
    others = stretches.select("row", "at").join(firsts, ["row", "at"], "left_anti").unionByName(contexts.where("kind = 2").select("row", "at"))
    spans = rare.unionByName(others.select("row", F.col("at").cast("long").alias("start"), (F.col("at") + LEAST).cast("long").alias("stop")))
    spans = spans.repartition(parts, "row").sortWithinPartitions("row", "start").mapInArrow(_joined, "row long, start long, stop long")
    spans = spans.join(texts.select("row", *KEY), "row").select(*KEY, "start", "stop")
    out = materialise(spans.unionByName(whole), "spans")
    for done in (contexts, texts, whole):
        discard(done)
    release_shuffles(spark)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), F.col("start").alias("first_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("words")
    )


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {LEAST - 2})) AS i FROM w WHERE len(ws) >= {LEAST}),
s AS (SELECT doc_id, i - 1 AS place, array_to_string(list_slice(ws, i, i + {LEAST - 1}), ' ') AS stretch FROM p),
c AS (SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY doc_id, place) AS k FROM s) WHERE k > 1),
n AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + {LEAST} THEN 0 ELSE 1 END AS begins FROM c),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM n)
SELECT doc_id, min(place) AS first_word, max(place) + {LEAST} AS end_word, max(place) + {LEAST} - min(place) AS words FROM g GROUP BY doc_id, span
"""


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words; the white space before a span goes with it."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in sorted(spans):
        out.append(raw[at : places[start - 1][1] if start else 0])
        at = places[stop - 1][1]
    return (b"".join(out) + raw[at:]).decode()


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the passages that an earlier place has; ``n_chars`` follows the text, rows and columns stay.

    A null text stays null, a text that is all copies becomes empty; other columns may have any names.
    """
    inner = fresh(docs, *[f"_{c}" for c in KEY], "_spans")
    own, cuts = inner[:-1], inner[-1]
    spans = repeated_spans(docs).groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias(cuts)).withColumnsRenamed(dict(zip(KEY, own)))
    with_key = docs.select("*", *[c.alias(n) for c, n in zip(keyed(docs), own)])
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 * CHUNK_BYTES):
            texts = [
                cut_words(t, [(s["start"], s["stop"]) for s in found]) if found else t
                for t, found in zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist())
            ]
            columns = [pa.array(texts, batch.column("text").type) if f.name == "text" else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    after = with_key.join(spans, own, "left").select(*[F.col(f"`{c}`") for c in (*schema.names, cuts)]).mapInArrow(lean(run), schema)
    if "n_chars" in schema.names:
        after = after.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return after
