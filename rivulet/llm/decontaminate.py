"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk reads a word sequence with a pointer that moves on, or
not, by a random bit for each step and word; it turns a small edit distance
into a small Hamming distance. Each repetition draws a walk, embeds every
benchmark item and the item-sized windows of the documents, and compares a few
sampled places of the embeddings by hash. For each class of item lengths
repetitions are added until, of its items edited at the full rate, the share
that collides with itself reaches the target recall; the items counted are
those that collide least.
Colliding windows are verified by their exact edit distance. After thousands of
edits two walks hardly meet again, so items of more than ``LONGEST`` words, and
classes that the repetitions allowed don't bring to the target, aren't embedded:
every stretch that passes the condition below is verified.

Windows which cannot be within the edit distance of any item, because they
share too few of an item's word pairs, are left out before they are embedded:
a condition that every true match meets, checked for every window.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import chain
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunks, materialise, table, utf8

#: UTF-8 bytes of benchmark texts that one pass ships to the executors; more are done in passes.
PASS_BYTES = 16 << 20
#: Steps of embeddings that are held at once.
STEPS = 8 << 20
#: Edited items that the repetitions of a class are measured on (at least), repetitions at most, and words of an item that is embedded.
TRIALS, MOST_REPETITIONS, LONGEST = 512, 512, 1_024
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and control characters separate words."""
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACES).split()


def edit_distance_within(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where that stretch ends (Myers' bit vectors)."""
    n = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    top, mask = 1 << (n - 1), (1 << n) - 1
    up, down, score = mask, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        hp, hn = down | (~(d | up) & mask), up & d
        score += (1 if hp & top else 0) - (1 if hn & top else 0)
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        up, down = hn | (~(x | hp) & mask), hp & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Plan:
    """Everything a worker needs for one pass over the documents."""

    def __init__(self, items: list[tuple[int, list[int]]], vocabulary: dict[bytes, int], rate: float, seed: int, repetitions: dict[int, int], sampled: int):
        #: Repetitions by number of words; 0: every stretch that may hold the item is verified.
        self.repetitions = repetitions
        self.items, self.vocabulary, self.rate, self.seed, self.sampled = items, vocabulary, rate, seed, sampled
        self.lengths = np.array([len(ids) for _, ids in items], np.int64)
        self.most_edits = np.array([self.edits(n) for n in self.lengths.tolist()], np.int64)
        self.longest = int(self.lengths.max()) if items else 0
        self.walks = np.zeros((0, sampled)), np.zeros((0, 0), np.uint32)
        self.draw(max(repetitions.values(), default=0))
        width = np.int64(len(vocabulary) + 1)
        pairs = sorted({(int(a * width + b), k) for k, (_, ids) in enumerate(items) for a, b in zip(ids, ids[1:])})
        codes = np.array([c for c, _ in pairs], np.int64)
        self.pair_codes, self.pair_starts = np.unique(codes, return_index=True)
        self.pair_starts = np.append(self.pair_starts, len(codes))
        self.pair_items = np.array([k for _, k in pairs], np.int64)
        self.table = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if any(repetitions.values()):
            keys, owners = [], []
            for k, (_, ids) in enumerate(items):
                many = repetitions[len(ids)]
                for low in range(0, many, self.turns_at_once(len(ids))):
                    high = min(many, low + self.turns_at_once(len(ids)))
                    keys.append(self.keys(np.array([ids], np.int64), self.lengths[k : k + 1], low, high)[0])
                owners.append(np.full(many, k))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.table = keys[order], owners[order]

    def draw(self, repetitions: int) -> None:
        """The walks up to that number; each has random numbers of its own, however many there are and however long the items."""
        width = 1 + 2 * max([1, *(n for n, many in self.repetitions.items() if many)])
        shares, salts = self.walks if self.walks[1].shape[1] == width else (np.zeros((0, self.sampled)), np.zeros((0, width), np.uint32))
        turns = [np.random.default_rng((self.seed, turn)) for turn in range(len(shares), repetitions)]
        #: Sampled places as shares of twice the length: the embedding has three steps a word, and the walk has passed most words after two.
        shares = np.concatenate([shares, *[np.sort(rng.random(self.sampled))[None] for rng in turns]])
        self.walks = shares, np.concatenate([salts, *[rng.integers(0, 1 << 32, width, np.uint32)[None] for rng in turns]])

    @staticmethod
    def turns_at_once(words: int) -> int:
        return max(1, STEPS // (2 * words + 1))

    def edits(self, n: int) -> int:
        return floor(n * self.rate + 1e-9)

    def keys(self, windows: np.ndarray, lengths: np.ndarray, low: int, high: int) -> np.ndarray:
        """(windows, repetitions from low to high): a hash of the sampled places of each window's embedding. Rows are padded with -1."""
        m, turns, columns = len(windows), np.arange(low, high), np.arange(high - low)
        shares, salts = (x[low:high] for x in self.walks)
        padded = np.concatenate([windows, np.full((m, 1), -1, windows.dtype)], axis=1)
        places = np.minimum((shares[None] * (2 * lengths)[:, None, None]).astype(np.int64), np.maximum(2 * lengths - 1, 0)[:, None, None])
        steps = int(places.max()) + 1
        rows = np.arange(m)[:, None]
        flat, first = padded.astype(np.int32).ravel(), (rows * padded.shape[1]).astype(np.int32)
        stop = first + lengths.astype(np.int32)[:, None]
        pointer = np.repeat(first, len(turns), axis=1)
        embedded = np.empty((steps, m, len(turns)), np.int32)
        for step in range(steps):
            seen = flat.take(pointer, out=embedded[step])
            mix = (seen.view(np.uint32) ^ salts[:, step]) * np.uint32(0x9E3779B1)
            pointer = np.minimum(pointer + (mix >> np.uint32(31)).astype(np.int32), stop)
        key = lengths.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + turns.astype(np.uint64)[None, :]
        for j in range(self.sampled):
            key = (key ^ embedded[places[:, :, j], rows, columns[None, :]].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        return key


def _edited(ids: list[int], edits: int, words: int, rng: random.Random) -> list[int]:
    """The item after so many random edits, as a window of its own length."""
    n, new = len(ids), list(ids)
    for _ in range(edits):
        kind, p = rng.randrange(3), rng.randrange(max(1, len(new)))
        new[p : p + (kind != 1)] = [rng.randrange(1, words + 1)] if kind != 2 else []
    return (new + [0] * n)[:n]


def _class(n: int) -> int:
    """Lengths of one class have about the same share of edits."""
    return n if n < 25 else 25 + floor(log(n / 25) / log(1.15))


def _repetitions(items: list[list[int]], probe: Plan, recall: float, rng: random.Random) -> int:
    """How many repetitions the items of one class need to meet themselves after all edits that they allow; 0 if more than are allowed."""

    def met(pairs: list[tuple[list[int], list[int]]], low: int, high: int) -> np.ndarray:
        out = []
        many = max(1, (1 << 22) // ((2 * max(len(a) for a, _ in pairs) + 1) * (high - low)))
        for at in range(0, len(pairs), many):
            part = pairs[at : at + many]
            lengths = np.array([len(a) for a, _ in part])
            rows = [np.full((len(part), int(lengths.max())), -1, np.int64) for _ in range(2)]
            for k, pair in enumerate(part):
                for r, ids in zip(rows, pair):
                    r[k, : len(ids)] = ids
            out.append(probe.keys(rows[0], lengths, low, high) == probe.keys(rows[1], lengths, low, high))
        return np.concatenate(out)

    def trials(some: list[list[int]], many: int) -> list[tuple[list[int], list[int]]]:
        return [(ids, _edited(ids, probe.edits(len(ids)), len(probe.vocabulary), rng)) for ids in some for _ in range(ceil(many / len(some)))]

    seen = met(trials(items, 64), 0, 16).mean(axis=1).reshape(len(items), -1).mean(axis=1)
    hard = [items[k] for k in np.argsort(seen, kind="stable")[: min(ceil(len(items) / 4), TRIALS)].tolist()]
    open_, at = trials(hard, TRIALS), 0
    allowed = (1 - recall) * len(open_)
    while at < MOST_REPETITIONS:
        probe.draw(at + 16)
        hits = met(open_, at, at + 16)
        for turn in range(16):
            left = int((~hits[:, : turn + 1].any(axis=1)).sum())
            if left + left**0.5 <= allowed:
                return max(4, at + turn + 1)
        open_, at = [p for p, h in zip(open_, hits.any(axis=1)) if not h], at + 16
    return 0


def plan_for(items: list[tuple[int, list[bytes]]], rate: float, recall: float, seed: int = 7, sampled: int = 2) -> Plan:
    """Repetitions for each class of lengths; an item that allows no edit meets itself in any one."""
    vocabulary: dict[bytes, int] = {}
    numbered = [(i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]) for i, ws in items]
    classes: dict[int, list[list[int]]] = {}
    plain = Plan([], {}, rate, seed, {}, sampled)
    for _, ids in numbered:
        if plain.edits(len(ids)) and len(ids) <= LONGEST:
            classes.setdefault(_class(len(ids)), []).append(ids)
    rng, needed = random.Random(seed), {}
    for c, lists in sorted(classes.items()):
        longest = max(lists, key=len)
        probe = Plan([(0, longest)], vocabulary, rate, seed, {}, sampled)
        probe.repetitions = {len(longest): MOST_REPETITIONS}
        probe.draw(16)
        needed[c] = _repetitions(lists, probe, recall, rng)
    by_length = {n: 0 if n > LONGEST else needed[_class(n)] if plain.edits(n) else 1 for n in {len(ids) for _, ids in numbered}}
    return Plan(numbered, vocabulary, rate, seed, by_length, sampled)


def _gated(ids: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, lengths)`` of the windows that may hold an item.

    A stretch within d edits of an item of n words shares n - 1 - 2d of its
    word pairs at least, and has n + d words at most.
    """
    width = np.int64(len(plan.vocabulary) + 1)
    codes = ids[:-1] * width + ids[1:]
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    place = np.minimum(np.searchsorted(plan.pair_codes, codes[at]), max(0, len(plan.pair_codes) - 1))
    found = plan.pair_codes[place] == codes[at] if len(plan.pair_codes) else np.zeros(len(at), bool)
    at, place = at[found], place[found]
    many = plan.pair_starts[place + 1] - plan.pair_starts[place]
    spots = np.repeat(at, many)
    inner = np.arange(len(spots)) - np.repeat(np.cumsum(many) - many, many)
    item = plan.pair_items[np.repeat(plan.pair_starts[place], many) + inner]
    order = np.lexsort((spots, item))
    spots, item = spots[order], item[order]
    need = plan.lengths - 1 - 2 * plan.most_edits
    span = plan.lengths + plan.most_edits - 2
    starts, lengths = [], []
    if len(spots):
        other = np.arange(len(spots)) + np.maximum(need[item], 1) - 1
        inside = other < len(spots)
        other = np.minimum(other, len(spots) - 1)
        gap = spots[other] - spots
        near = np.flatnonzero(inside & (item[other] == item) & (gap <= span[item]) & (need[item] > 0))
        low = spots[other[near]] - span[item[near]]
        same = np.concatenate([[False], item[near][1:] == item[near][:-1]]) if len(near) else np.zeros(0, bool)
        low = np.where(same, np.maximum(low, np.concatenate([[0], spots[near][:-1] + 1])[: len(near)]), low)  # no start twice
        many = spots[near] - low + 1
        runs = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        starts.append(runs)
        lengths.append(np.repeat(plan.lengths[item[near]], many))
    for k in np.flatnonzero(need <= 0).tolist():  # one word, or more edits than the condition can tell
        n = int(plan.lengths[k])
        here = np.flatnonzero(ids == plan.items[k][1][0]) if n == 1 else np.arange(len(ids))
        starts.append(here)
        lengths.append(np.full(len(here), n))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lengths = np.concatenate(starts), np.concatenate(lengths)
    base = np.int64(plan.longest + 1)
    both = np.unique((starts * base + lengths)[(starts >= 0) & (starts < len(ids))])
    return both // base, both % base


def matches(texts: list[bytes], plan: Plan) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text number, item number, edits, first word, end word)``: the best stretch for each text and item within the edit distance.

    Windows are embedded in blocks of so many steps, so a long item costs time but no more memory.
    """
    get = plan.vocabulary.get
    lists = [[get(w, 0) for w in words_of(t)] for t in texts]
    ends = np.cumsum([len(x) for x in lists]) if lists else np.zeros(0, int)
    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]) if len(ends) else 0)
    if not len(ids) or not plan.items:
        return
    checked: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def verify(start: int, k: int) -> None:
        """The best stretch of those that begin near ``start``; what was verified before isn't again."""
        doc, n, d = int(np.searchsorted(ends, start, side="right")), int(plan.lengths[k]), int(plan.most_edits[k])
        begin, end = int(ends[doc - 1]) if doc else 0, int(ends[doc])
        slot = start // (d + 1) * (d + 1)
        last = checked.get((doc, k, slot))
        if last is None:
            left = max(begin, slot - d)
            near = ids[left : min(end, slot + n + 2 * d + 1)].tolist()
            edits, close = edit_distance_within(plan.items[k][1], near)
            length = edit_distance_within(plan.items[k][1][::-1], near[:close][::-1])[1] if edits <= d else 0
            last = checked[doc, k, slot] = (edits, left + close - length - begin, left + close - begin)
        if last[0] <= d:
            best[doc, k] = min(best.get((doc, k), last), last)

    starts, lengths = _gated(ids, plan)
    known, owners = plan.table
    turns_of = np.zeros(plan.longest + 1, np.int64)
    turns_of[list(plan.repetitions)] = list(plan.repetitions.values())
    order = np.lexsort((starts, lengths, turns_of[lengths]))
    starts, lengths = starts[order], lengths[order]
    at = int(np.searchsorted(turns_of[lengths], 1))
    for n in np.unique(lengths[:at]).tolist():
        mine = starts[:at][lengths[:at] == n]
        firsts = np.unique(mine // (plan.edits(n) + 1) * (len(ends) + 1) + np.searchsorted(ends, mine, side="right"), return_index=True)[1]
        for k in np.flatnonzero(plan.lengths == n).tolist():
            for start in mine[firsts].tolist():
                verify(start, k)
    while at < len(starts):
        turns = int(turns_of[lengths[at]])
        stop = min(at + 1_024, len(starts))
        same = turns_of[lengths[at:stop]] == turns
        stop = at + (len(same) if same.all() else int(same.argmin()))
        stop = min(stop, at + max(1, STEPS // ((2 * int(lengths[stop - 1]) + 1) * turns)))
        begins, long = starts[at:stop], lengths[at:stop]
        place = begins[:, None] + np.arange(int(long.max()))[None, :]
        inside = place < np.minimum(ends[np.searchsorted(ends, begins, side="right")], begins + long)[:, None]
        windows = np.where(inside, ids[np.minimum(place, len(ids) - 1)], -1)
        pairs: set[tuple[int, int]] = set()
        step = plan.turns_at_once(int(long.max()) * len(long))
        for first in range(0, turns, step):
            keys = plan.keys(windows, long, first, min(turns, first + step))
            low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            pairs |= {(int(begins[w]), int(k)) for w, r in np.argwhere(high > low).tolist() for k in owners[low[w, r] : high[w, r]]}
        for start, k in sorted(pairs):
            verify(start, k)
        at = stop
    for (doc, k), (edits, a, b) in sorted(best.items()):
        yield doc, k, edits, a, b


_OUT = "item_id {item}, edits int, item_words int, similarity double, first_word int, end_word int"


def _plans(probe: DataFrame, similarity: float, recall: float) -> Iterator[Broadcast]:
    """A plan for each pass over the documents, from ``(item_id, text)``."""
    passes = max(1, ceil((probe.agg(F.sum(F.length("text"))).first()[0] or 0) / PASS_BYTES))
    for turn in range(passes):
        rows = probe.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn).collect()
        items = [(r["item_id"], ws) for r in rows if (ws := words_of(bytes(r["text"])))]
        yield probe.sparkSession.sparkContext.broadcast(plan_for(items, 1 - similarity, recall))


def contaminations(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99,
    id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it, with the best stretch of words.

    An item is found where some stretch of the document is within
    ``floor((1 - similarity) * words)`` word edits of it. Items and documents
    without words match nothing; an item under five words (by default) only
    matches unchanged. Repeated documents and items give rows of their own; a
    null id is kept. Documents are only scanned, never shuffled. Benchmark
    texts are broadcast, ``PASS_BYTES`` at a time.
    """
    probe = benchmark.select(F.col(f"`{item}`").alias("item_id"), utf8(f"`{item_text}`").alias("text"))
    kept = docs.select(F.col(f"`{id}`"), utf8(f"`{text}`").alias("_text"))
    kinds = dict(kept.dtypes)
    ddl = f"`{id}` {kinds[id]}, {_OUT.format(item=dict(probe.dtypes)['item_id'])}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    out = None
    for shipped in _plans(probe, similarity, recall):

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            plan = shipped.value
            for batch in chunks(batches, "_text"):
                ids, found = batch.column(id), []
                for doc, k, edits, a, b in matches(batch.column("_text").to_pylist(), plan):
                    n = len(plan.items[k][1])
                    found.append({id: ids[doc].as_py(), "item_id": plan.items[k][0], "edits": edits, "item_words": n, "similarity": 1 - edits / n, "first_word": a, "end_word": b})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

        part = kept.mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The documents in which no benchmark item is found, judged inside their own scan: no join, so any id, null or repeated, will do.

    Where the benchmark takes several passes, what a pass keeps is written
    before the next one, so a worker holds one pass's items at a time.
    """
    probe = benchmark.select("item_id", utf8("text").alias("text"))
    kept = docs
    for turn, shipped in enumerate(_plans(probe, similarity, recall)):

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                gone = {doc for doc, *_ in matches(texts, shipped.value)}
                yield batch.filter(pa.array([k not in gone for k in range(len(texts))]))

        kept = (materialise(kept, "clean") if turn else kept).mapInArrow(run, docs.schema)
    return kept
