"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints link at ``radius`` differing bits or fewer (even). Each distinct
fingerprint stands for all variants within half the radius; two fingerprints
that share a variant are within the radius of each other, and two that are
within it share one. The variant space is dealt into cells by its low bits: a
fingerprint is sent once to each cell that holds some of its variants, and the
variants themselves are made inside the cell. So the shuffle carries 37
rows for a fingerprint where there are 200,000, up to 301 from a thousand
million on, not the 2,081 of its ball, and no row is left out.
In a cell, equal variants meet by sorting; each member of such a run is paired
with the first, pairs are deduplicated, verified by counting bits, and reduced
to a forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import numbered
from .common import chunks, discard, fresh, lean, materialise, release_shuffles, table, utf8
from .components import combined, connected_components, forests, least_members

#: Variants that a cell holds on average, and at most at once in memory.
CELL_VARIANTS, MOST_VARIANTS = 2_000_000, 4_000_000
#: Short SimHashes of ``similar`` and their bits (two sets of similarity 0.8 are within two bits by one of them with probability 0.99), and
#: fingerprints of a cell on average.
TURNS, BITS, CELL_PRINTS = 36, 32, 1 << 18
#: Up to which short SimHash each round deals them out. The first few find most links, so what they join isn't paired again by the others.
ROUNDS = (6, 21, TURNS)
#: Of 128 bits, two sets of similarity 0.8 differ in 19 on average (deviation 4), unrelated ones in 64 (deviation 6).
CLOSE = 40


def simhash(text: bytes, size: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint of a text's word shingles (A-Z lower-cased, repeats counted)."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long. A text without words has fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            fps = np.array([simhash(t.as_py(), size) for t in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(fps.view(np.int64))], [id, "fp"])

    kept = docs.select(F.col(f"`{id}`"), utf8(f"`{text}`").alias("_text"))
    return kept.mapInArrow(lean(run), f"`{id}` {dict(kept.dtypes)[id]}, fp long")


def _patterns(bits: range, most: int) -> np.ndarray:
    """All 64-bit words with at most ``most`` bits set, all within ``bits``."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def _colliding(base: np.ndarray, own: np.ndarray, budget: np.ndarray, fixed: int, most: int, out: list) -> None:
    """Pairs of owners that share a variant of ``base`` which differs only in bits from ``fixed`` on, within the budget."""
    sizes = {b: len(_patterns_cached(fixed, b)) for b in np.unique(budget).tolist()}
    total = sum(sizes[b] * int((budget == b).sum()) for b in sizes)
    if total > most and fixed < 63 and len(base) > 1:
        bit = np.uint64(1 << fixed)
        for want in (np.uint64(0), bit):
            same = (base & bit) == want
            near = ~same & (budget > 0)
            take = np.concatenate([np.flatnonzero(same), np.flatnonzero(near)])
            if len(take) > 1:
                moved = np.where(same[take], base[take], base[take] ^ bit)
                _colliding(moved, own[take], np.where(same[take], budget[take], budget[take] - 1), fixed + 1, most, out)
        return
    variants, owners = [], []
    for b in sizes:
        rows, pattern = np.flatnonzero(budget == b), _patterns_cached(fixed, b)
        variants.append((base[rows, None] ^ pattern[None, :]).ravel())
        owners.append(np.repeat(own[rows].astype(np.int32), len(pattern)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    same = np.flatnonzero(variants[1:] == variants[:-1]) + 1
    if not len(same):
        return
    begins = np.ones(len(variants), bool)
    begins[same] = False
    first = np.maximum.accumulate(np.where(begins, np.arange(len(variants)), 0))[same]
    pairs = np.unique(np.sort(np.stack([owners[first], owners[same]], axis=1), axis=1), axis=0)
    out.append(pairs)


_cache: dict[tuple[int, int], np.ndarray] = {}


def _patterns_cached(fixed: int, most: int) -> np.ndarray:
    if (fixed, most) not in _cache:
        _cache[fixed, most] = _patterns(range(fixed, 64), most)
    return _cache[fixed, most]


def cell_links(fps: np.ndarray, moved: np.ndarray, budget: np.ndarray, fixed: int, radius: int, most: int = MOST_VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell as a forest: fingerprints that aren't the root of their component here, and those roots."""
    out: list[np.ndarray] = []
    _colliding(moved, np.arange(len(fps)), budget, fixed, most, out)
    if not out:
        return fps[:0], fps[:0]
    pairs = np.unique(np.concatenate(out), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    close = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    root = least_members(a[close], b[close], len(fps))
    other = np.flatnonzero(root != np.arange(len(fps)))
    return fps[other], fps[root[other]]


def links(fps: DataFrame, radius: int = 4, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """``(a, b)``: links within ``radius`` between the distinct values of ``fp`` that join all that are linked.

    Every cell returns a forest over its fingerprints, so at most one row for
    each of them, however many of them lie close together.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius has to be even: half of it is the radius of each ball")
    half = radius // 2
    n = fps.count()
    ball = sum(comb(64, k) for k in range(half + 1))
    low = 0
    while low < 24 and n * ball > cell_variants << low:
        low += 1
    masks = _patterns(range(low), half).astype(np.int64).tolist()
    sent = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit((1 << low) - 1)).alias("cell")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[np.ndarray], cell: int):
            own = np.concatenate(parts)
            moved = (own >> np.uint64(low) << np.uint64(low)) | np.uint64(cell) if low else own
            budget = (half - np.bitwise_count(own ^ moved)).astype(np.int8)
            a, b = cell_links(own, moved, budget, low, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        parts, at = [], None
        for batch in batches:
            cells, own = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for cell, part in zip(cells[np.concatenate([[0], cuts])] if len(cells) else [], np.split(own, cuts)):
                if at is not None and cell != at:
                    yield close(parts, at)
                    parts = []
                parts.append(part)
                at = int(cell)
        if parts:
            yield close(parts, at)

    return sent.repartition(min(1 << low, 16_384), "cell").sortWithinPartitions("cell").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """``(id, fp, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the least id that links of at most ``radius`` bits
    reach. Null and wordless texts have fingerprint zero and are linked like
    any other. A null id is never the least where another id is there; a
    component of null ids only has a null component_id. Repeated rows each get
    their row. Copies meet in one fingerprint before anything is compared.
    """
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs, id, text, size), "fp")
    distinct = materialise(prints.groupBy("fp").agg(F.min(id).alias("least")), "fps")
    roots = connected_components(links(distinct.select("fp"), radius))
    release_shuffles(spark)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(
        F.col(id), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Hashes of a text's distinct word shingles, sorted; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    many = max(1, len(words) - size + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(many)], np.uint64))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_WORDS = TURNS * BITS // 64 + 2


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``TURNS`` independent SimHashes of ``BITS`` bits and one of 128, as 64-bit words."""
    salts = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] + salts[None, :]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)


#: Words of ``parity`` that hold bits.
PARITY_WORDS = 4


def parity(hashes: np.ndarray) -> np.ndarray:
    """The set's bucket counts modulo 2, as ``PARITY_WORDS`` words, and its size."""
    buckets = 64 * PARITY_WORDS
    odd = np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets) & 1
    return np.append(np.packbits(odd.astype(np.uint8)).view(np.uint64), np.uint64(len(hashes)))


def possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two unequal sets can be that similar, by their ``parity``. Exact: a pair that is left out isn't.

    Each member of only one of the sets turns one bit over, so there are as
    many such members as bits that differ, or more.
    """
    both, apart = (size_a + size_b).astype(np.int64), np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (both - apart) / np.maximum(both + apart, 1) >= similarity


def candidates(moved: np.ndarray, budget: np.ndarray, fixed: int, checks: np.ndarray, most: int = CELL_VARIANTS) -> np.ndarray:
    """Pairs (of places) that share a variant and whose 128-bit SimHashes agree in most bits.

    In a run of equal variants the first is paired with all that are close to
    it, and each of these with the one before it; those that are far from it
    make a run of their own. So a group costs its size, not its square. Beyond
    ``most`` variants they are made in two halves, by the next bit.
    """
    if len(moved) + int((budget > 0).sum()) * (BITS - fixed) > most and fixed < BITS and len(moved) > 1:
        bit, halves = np.uint64(1 << fixed), []
        for want in (np.uint64(0), bit):
            same = (moved & bit) == want
            take = np.flatnonzero(same | (budget > 0))
            same = same[take]
            pairs = candidates(np.where(same, moved[take], moved[take] ^ bit), np.where(same, budget[take], budget[take] - 1), fixed + 1, checks[take], most)
            halves.append(take[pairs])
        return np.unique(np.concatenate(halves), axis=0)
    free = np.flatnonzero(budget > 0)
    flips = np.uint64(1) << np.arange(fixed, BITS, dtype=np.uint64)
    variants = np.concatenate([moved, (moved[free, None] ^ flips[None, :]).ravel()])
    own = np.concatenate([np.arange(len(moved)), np.repeat(free, len(flips))])
    order = np.argsort(variants, kind="stable")
    variants, own = variants[order], own[order]
    out = [np.zeros((0, 2), np.int64)]
    while len(own) > 1:
        begins = np.concatenate([[True], variants[1:] != variants[:-1]])
        many = np.add.reduceat(np.ones(len(own), np.int64), np.flatnonzero(begins))
        keep = np.repeat(many > 1, many)
        variants, own, begins = variants[keep], own[keep], begins[keep]
        if not len(own):
            break
        first = own[np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0))]
        near = np.bitwise_count(checks[own] ^ checks[first]).sum(axis=1) <= CLOSE
        out.append(np.stack([first, own], axis=1)[near & (own != first)])
        v, o = variants[near], own[near]
        next_ = np.flatnonzero(v[1:] == v[:-1])
        out.append(np.stack([o[next_], o[next_ + 1]], axis=1))
        out = [np.unique(np.sort(np.concatenate(out), axis=1), axis=0)]
        variants, own = variants[~near], own[~near]
    return out[0][out[0][:, 0] != out[0][:, 1]]


def _meeting(reps: DataFrame, low: int, turns: range, similarity: float) -> DataFrame:
    """``(a, b)``: keys of candidates with unlike ``root`` by some of the short SimHashes, dealt into cells by their low bits as in ``links``.

    Pairs that can't have the similarity, by their ``parity``, are left out.
    """
    masks, carried = _patterns(range(low), 1), ["c0", "c1", *[f"p{k}" for k in range(PARITY_WORDS)]]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                words = np.array([np.frombuffer(x, np.uint64) for x in batch.column("sketch").to_pylist()])
                short = words.view(np.uint32)[:, turns.start : turns.stop].astype(np.uint64)
                m, shape = len(words), (len(words), len(turns), len(masks))
                cells = (short[:, :, None] ^ masks) & np.uint64((1 << low) - 1) | (np.array(turns, np.uint64) << np.uint64(32))[None, :, None]
                each = lambda x: pa.array(np.broadcast_to(x, shape).ravel().view(np.int64))
                key, root = (batch.column(c).to_numpy().reshape(m, 1, 1) for c in ("key", "root"))
                sized = short | words[:, -1:] << np.uint64(BITS)
                yield pa.RecordBatch.from_arrays(
                    [each(cells), each(key), each(root), each(sized[:, :, None]), *[each(words[:, k].reshape(m, 1, 1)) for k in range(-1 - len(carried), -1)]],
                    ["cell", "key", "root", "fp", *carried],
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[np.ndarray]) -> pa.RecordBatch:
            cell, key, root, sized, *rest = np.concatenate(parts, axis=1)
            sized, (checks, odd) = sized.view(np.uint64), (np.stack(x, axis=1).view(np.uint64) for x in (rest[:2], rest[2:]))
            own, sizes = sized & np.uint64((1 << BITS) - 1), sized >> np.uint64(BITS)
            moved = own >> np.uint64(low) << np.uint64(low) | np.uint64(int(cell[0]) & ((1 << low) - 1))
            pairs = candidates(moved, 1 - np.bitwise_count(own ^ moved).astype(np.int8), low, checks)
            pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
            a, b = pairs[:, 0], pairs[:, 1]
            pairs = pairs[possible(odd[a], odd[b], sizes[a], sizes[b], similarity)]
            return pa.RecordBatch.from_arrays([pa.array(key[pairs[:, 0]]), pa.array(key[pairs[:, 1]])], ["a", "b"])

        parts: list[np.ndarray] = []
        for batch in batches:
            rows = np.array([c.to_numpy() for c in batch.columns])
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if not part.shape[1]:
                    continue
                if parts and parts[0][0, 0] != part[0, 0]:
                    yield close(parts)
                    parts = []
                parts.append(part)
        if parts:
            yield close(parts)

    sent = reps.select("key", "root", "sketch").mapInArrow(lean(deal), ", ".join(f"{c} long" for c in ("cell", "key", "root", "fp", *carried)))
    return sent.repartition(min(len(turns) << low, 16_384), "cell").sortWithinPartitions("cell", "key").mapInArrow(lean(run), "a long, b long")


def _rooted(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """The representatives with the root of their component, by default themselves."""
    return reps.join(roots, reps["key"] == roots["node"], "left").select(*[reps[c] for c in reps.columns], F.coalesce("root", "key").alias("root"))


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component_id)`` for every row: the least id that links of at least that Jaccard similarity of shingle sets reach.

    Rows of equal sets meet in one. Candidates are those within two bits by one
    of ``TURNS`` short SimHashes, found by ball hashing. Those that the bits of
    ``parity`` don't prove to be less similar are verified on the shingles
    themselves, round by round: what the links of earlier rounds join, or what
    they have verified, isn't compared again. ``id`` has to tell
    the rows apart. ``docs`` is read once and once more for each round.
    """

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            sets = [shingles(t.as_py(), size) for t in batch.column("_text")]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], np.uint64).view(np.int64)
            sketches = pa.array([np.append(sketch(x), parity(x)).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(keys), sketches], [id, "key", "sketch"])

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(chunks(batches, "_a"), "_b"):
            last, known, keep = None, None, []
            for a, t, u in zip(batch.column("a").to_pylist(), batch.column("_a"), batch.column("_b")):
                if a != last:
                    last, known = a, shingles(t.as_py(), size)
                keep.append(similarity_of(known, shingles(u.as_py(), size)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = docs.sparkSession
    kept = docs.select(F.col(f"`{id}`"), utf8(f"`{text}`").alias("_text"))
    marks = materialise(kept.mapInArrow(lean(marked), f"`{id}` {dict(kept.dtypes)[id]}, key long, sketch binary"), "sketches")
    reps = materialise(marks.groupBy("key").agg(F.min(id).alias("least"), F.first("sketch").alias("sketch")), "distinct")
    low, n = 0, reps.count()
    while low < 24 and n > CELL_PRINTS << low:
        low += 1
    roots = tried = None
    for start, stop in zip((0, *ROUNDS), ROUNDS):
        dealt = reps.withColumn("root", F.col("key")) if roots is None else _rooted(reps, roots)
        met = materialise(_meeting(dealt, low, range(start, stop), similarity).distinct(), "met")
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = reps.join(nodes, "key", "left_semi").select("key", F.col("least").alias("_least"))
        texts = materialise(kept.join(wanted, F.col(id).eqNullSafe(F.col("_least"))).select("key", "_text"), "texts")
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("_text").alias("_a")), "a").join(
            texts.select(F.col("key").alias("b"), F.col("_text").alias("_b")), "b")
        linked = materialise(both.mapInArrow(lean(lambda batches: forests(verified(batches))), "a long, b long"), "links")
        known = linked if roots is None else linked.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected_components(combined(known))
        tried = pairs if tried is None else tried.unionByName(pairs)
        discard(met)
        discard(texts)
        release_shuffles(spark)
    rooted = _rooted(reps, roots)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.select("key", "root").join(least, "root").select("key", "component_id")
    return marks.select(id, "key").join(label, "key").select(F.col(id), "component_id")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but one of each group of ``similar`` ones: the least doc_id stays.

    Of repeated rows with that doc_id the first stays, in order of files or as
    the frame gives them; a row without a doc_id stays only where no other is
    in its group. Rows are known by their place: in Parquet files it is fixed,
    any other frame is written once. Other columns, whatever their names, stay
    as they are.
    """
    (row,) = fresh(docs, "_row")
    rows = numbered(docs, row)[0]
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("_row")).alias("_doc"), "text")
    found = similar(named, id="_doc", size=size, similarity=similarity)
    gone = found.where(F.col("_doc._row") != F.col("component_id._row")).select(F.col("_doc._row").alias(row))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
