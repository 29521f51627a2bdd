"""SimHash near-duplicate detection with the generalised pigeonhole principle.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of a text's word shingles.  Fingerprints link at
``radius`` or fewer differing bits, and components of links are the classes.

Candidates come from the generalised pigeonhole principle: bits are grouped into partitions, correlated bits together,
and partition i gets a threshold t_i (-1: not probed) such that the sum of t_i + 1 is radius + 1.  Two fingerprints
within ``radius`` then differ in at most t_i bits of some partition i.  A dynamic program chooses the thresholds, over
several partitionings, that minimise probes plus expected candidates; those come from the exact distance distribution
of every 8-bit block over all distinct fingerprints (by a Walsh-Hadamard autocorrelation of its histogram), convolved
over the blocks of a partition.  So a larger table gets wider keys and more probes, and the same links.

A probe key is the partition's bits with every choice of t_i bits cleared; fingerprints of one key are verified
against each other in one task, in vectorised blocks, and a key's links leave it as a spanning forest, never as all
pairs.  Keys with over ``key_rows`` fingerprints are not verified: their fingerprints agree on the key, so the
pigeonhole is applied again to the other bits, until groups are small (distinct fingerprints must part in the end).
Copies have one fingerprint and are one row from the start.

``near_duplicates`` finds near copies of whole texts: Jaccard similarity 0.8 or more of their sets of five-word
shingles.  Texts whose fingerprints are equal or link by the pigeonhole are checked first, exactly, on their shingles.
Pairs of that similarity may differ in more bits than any pigeonhole of useful width covers, so an exact prefix-filter
join then finds those among the texts that are not joined yet.  Shingles have one order for the whole table; a pair at
a similarity of t shares at least ceil(t * n) shingles of each of its sets, so it shares one of the first
n - ceil(t * n) + 1 of each.  Every text sends these to their keys; no pair of that similarity is missed, whatever the
edit.  Any order is right; that by 64-bit hash is used, but shingles that many texts hold come last, in the order of
their hashes too.  Those are told from the texts of every ``ORDER_EVERY``-th hash, which decides on the order alone: all
texts are compared.  A text's own shingles so come first, and those of its edits keep it from the keys of a large
cluster, or from its pairs there: a pair whose first common shingle is at places i and j shares at most
1 + min(n - i - 1, m - j - 1), and is left out under a key where that is too few (under its first common key it never
is).  Texts under a large key are first compared with the one that holds the key earliest, the least edited one, which
joins a cluster of copies at once; then all pairs that are not joined yet are checked, each once, on their shingles.

Nulls and edge cases: a null text is an empty one; texts without words have fingerprint zero (in near_duplicates: no shingles) and link like
any other; texts with fewer words than a shingle have one shingle; repeated rows share fingerprint and class; null ids count as
larger than any id when a class's least id is taken.  An empty table gives an empty result.  Columns of ``docs``
other than id and text do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, map_slices, most_frequent, row_columns, save, small_batches, text_slices, texts_of, whole_row
from .graph import components

BLOCK = 8
#: Fingerprints that are verified against each other at most; larger groups are parted further.
KEY_ROWS = 2000
#: Rows (of three longs) up to which a table is broadcast rather than shuffled: 24 MB.
BROADCAST_ROWS = 1_000_000
#: What a probe row costs, in verified candidates.
ROW_COST = 40.0
#: Differing bits up to which the fingerprints of near copies are candidates.
NEAR_RADIUS = 3
#: Texts of every so-manieth hash tell which shingles come last in their order: those that so many of them hold, at
#: most so many (8 MB).
ORDER_EVERY, ORDER_TEXTS, ORDER_SHINGLES = 8, 3, 1_000_000
#: Texts under a key from which on they are compared with one of them before they are paired.
STAR_ROWS = 8
#: Texts of a block: those of two blocks are checked against each other at once.
CHECK_ROWS = 250
#: Pairs that a task remembers at most, so as not to send them again under another key.
SEEN_PAIRS = 200_000


def shingles(text: bytes, k: int) -> list[bytes]:
    """All k-word shingles of a text, repeats included, A-Z lower-cased and words parted by one space."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words for each hash; the first is the hash itself."""
    out = np.empty((len(hashes), words), "<u8")
    out[:, 0] = hashes
    for i in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(items: Sequence[bytes], words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes of ``items``."""
    if not items:
        return np.zeros(words, "<u8")
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.array([digest(x, 42) for x in items], np.uint64), words)


def fingerprint_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half of ``hashes``."""
    total = np.zeros(64 * words, np.int64)
    for a in range(0, len(hashes), 4096):
        part = _spread(hashes[a : a + 4096], words)
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


# --- partitions and thresholds -------------------------------------------------------------------------------------


def bits_of(fps: np.ndarray) -> np.ndarray:
    """(n, words) of unsigned 64-bit words to (n, 64 * words) bits."""
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def group_bits(pairs: np.ndarray, ones: np.ndarray, n: int) -> list[list[int]]:
    """Blocks of ``BLOCK`` bits, each begun by the first free bit and filled with the free bits most correlated to it."""
    p = ones / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-12)
    corr = np.abs(pairs / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    free, blocks = list(range(len(ones))), []
    while free:
        block = [free.pop(0)]
        while len(block) < BLOCK and free:
            nearest = max(free, key=lambda b: corr[b, block].sum())
            free.remove(nearest)
            block.append(nearest)
        blocks.append(block)
    return blocks


def distance_distribution(histogram: np.ndarray) -> np.ndarray:
    """Probability that two random rows differ in 0, 1, ... bits, from the 2^BLOCK counts of a block."""
    x, h = histogram.astype(np.float64) / max(histogram.sum(), 1), 1
    while h < len(x):  # Walsh-Hadamard transform
        y = x.reshape(-1, 2, h)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(-1)
        h *= 2
    x, h = x * x, 1
    while h < len(x):
        y = x.reshape(-1, 2, h)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(-1)
        h *= 2
    x /= len(x)
    return np.bincount([i.bit_count() for i in range(len(x))], x, BLOCK + 1).clip(0)


def allocate(widths: Sequence[int], near: Sequence[np.ndarray], n: float, radius: int, most: int = 2) -> tuple[float, list[int]]:
    """Least cost and thresholds of the partitions.  ``near[i][d]``: probability of distance d in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, p in zip(widths, near, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        for got, (cost, chosen) in best.items():
            for t in range(-1, min(most, width) + 1):
                more = 0.0 if t < 0 else n * ROW_COST * math.comb(width, t) + n * n / 2 * sum(float(p[d]) * math.comb(width - d, t - d) for d in range(t + 1))
                sum_ = min(got + t + 1, radius + 1)
                if sum_ not in new or cost + more < new[sum_][0]:
                    new[sum_] = (cost + more, [*chosen, t])
        best = new
    return best.get(radius + 1, (math.inf, []))


def plan(blocks: Sequence[Sequence[int]], histograms: np.ndarray, radius: int, n: int, choices: Sequence[int]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for the cheapest number of partitions among ``choices``."""
    dist = [distance_distribution(h) for h in histograms]
    found: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in choices:
        cuts = np.linspace(0, len(blocks), m + 1).round().astype(int)
        parts = [list(itertools.chain(*blocks[a:b])) for a, b in itertools.pairwise(cuts)]
        near = []
        for a, b in itertools.pairwise(cuts):
            p = np.ones(1)
            for d in dist[a:b]:
                p = np.convolve(p, d)
            near.append(p)
        cost, thresholds = allocate([len(p) for p in parts], near, n, radius)
        if cost < found[0]:
            found = cost, [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]
    return found[1]


def signatures(partitions: Sequence[tuple[Sequence[int], int]]) -> list[list[int]]:
    """The sets of bits that fingerprints must share: each partition less every choice of its threshold of bits."""
    return [[b for b in bits if b not in out] for bits, t in partitions for out in map(set, itertools.combinations(bits, t))]


def mask_of(bits: Sequence[int], words: int) -> np.ndarray:
    mask = np.zeros(64 * words, np.uint8)
    mask[list(bits)] = 1
    return np.packbits(mask, bitorder="little").view("<u8")


# --- links ---------------------------------------------------------------------------------------------------------


class Link:
    """Whether fingerprints link.  Word ``words`` and up of a row: a second fingerprint that must be near as well."""

    def __init__(self, words: int, radius: int, second: int | None = None) -> None:
        self.words, self.radius, self.second = words, radius, second

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(a[:, : self.words] ^ b[:, : self.words]).sum(1, dtype=np.int64) <= self.radius
        if self.second is not None:
            some = np.flatnonzero(near)
            near[some] = np.bitwise_count(a[some, self.words :] ^ b[some, self.words :]).sum(1, dtype=np.int64) <= self.second
        return near


def forest(group: np.ndarray, fps: np.ndarray, link: Link) -> np.ndarray:
    """For rows sorted by ``group``: the first row of each row's component among the links within its group."""
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    label = np.arange(n)
    rows, step = np.arange(n), 1
    while len(rows := rows[rows + step < ends[rows]]):
        for a in range(0, len(rows), 1 << 16):
            x = rows[a : a + (1 << 16)]
            x = x[label[x] != label[x + step]]
            x = x[link(fps[x], fps[x + step])] if len(x) else x
            if len(x):
                label = _union(label, x, x + step)
        step += 1
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(label[a].tolist(), label[b].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    if not parent:
        return label
    change = np.arange(len(label))
    for x in parent:
        change[x] = root(x)
    return change[label]


def _fp_array(column: pa.Array, words: int) -> np.ndarray:
    """A column of fixed-length binaries as (n, words)."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1).view("<u8")[:, :words]


def _keys(fps: np.ndarray, sigs: Sequence[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a hash of the shared bits and the signature) and row numbers, one for each signature and row."""
    keys = []
    for i, mask in sigs:
        h = np.full(len(fps), np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for w in range(len(mask)):
            h = (h ^ (fps[:, w] & mask[w])) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        keys.append(h)
    return np.concatenate(keys).view(np.int64), np.tile(np.arange(len(fps)), len(sigs))


def _probe(df: DataFrame, sigs: Sequence[tuple[int, np.ndarray]], whole: bool = True) -> DataFrame:
    """``df`` (node, fp) to a row for each signature: key and sig, with node and fp if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096).take(pa.array(np.arange(min(4096, b.num_rows - a))))
                fps = _fp_array(part.column(1), len(sigs[0][1]))
                for c in range(0, len(sigs), 64):
                    some = sigs[c : c + 64]
                    keys, rows = _keys(fps, some)
                    sig = np.repeat(np.array([i for i, _ in some], np.int32), len(fps))
                    more = [part.column(i).take(pa.array(rows)) for i in (0, 1)] if whole else []
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sig), *more], names=["key", "sig", "node", "fp"][: 2 + len(more)])

    return df.select("node", "fp").mapInArrow(run, "key long, sig int" + ", node long, fp binary" * whole)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut so that no key is in two of them."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        b = b if rest is None else pa.concat_batches([rest, b])
        keys = b.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        rest = b.slice(cut)
        if cut:
            yield _compact(b, 0, cut)
    if rest is not None and rest.num_rows:
        yield _compact(rest, 0, rest.num_rows)


def _compact(b: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
    return b.take(pa.array(np.arange(start, stop)))


def linked(link: Link, width: int) -> Callable[[DataFrame], DataFrame]:
    """Edges (a, b) of a spanning forest of each key's links.  A task streams its keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            nodes = b.column(1).to_numpy()
            label = forest(b.column(0).to_numpy(), _fp_array(b.column(2), width), link)
            x = np.flatnonzero(label != np.arange(len(label)))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[label[x]])], names=["a", "b"])

    return lambda rows: rows.select("key", "node", "fp").mapInArrow(run, "a long, b long")


def similar(sets: Sequence[np.ndarray], similarity: float, cells: int = 1 << 24) -> np.ndarray:
    """For each set the first one of its component, where sets of at least this Jaccard similarity are joined."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float32)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    shared = seen[code] > 1
    code, row = np.unique(code[shared], return_inverse=True)[1], row[shared]
    width = max(1, cells // n)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        some = slice(*np.searchsorted(code, [a, a + width]))
        table = np.zeros((n, min(width, int(code[-1]) + 1 - a)), np.float32)
        table[row[some], code[some] - a] = 1
        common += table @ table.T
    total = sizes[:, None] + sizes[None, :] - common
    near = (common >= np.float32(similarity) * total - 1e-3) & (total > 0)
    # counts are whole numbers: settle what float32 may have rounded
    near &= common.astype(np.float64) >= similarity * total.astype(np.float64) - 1e-9
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def exact_links(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows`` (key, node, items: sorted 64-bit hashes) to edges (a, b) of a spanning forest of each key's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            keys, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for i, j in itertools.pairwise(cuts):
                label = similar(sets[i:j], similarity) if j - i > 1 else np.zeros(1, np.int64)
                out += [(nodes[i + x], nodes[i + label[x]]) for x in np.flatnonzero(label != np.arange(j - i)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "node", "items").repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles, each once."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles(text, k)], "<u8"))


def least_common(similarity: float, n: int) -> int:
    """Shingles of a set of n that a set of this similarity has as well, at least."""
    return math.ceil(similarity * n - 1e-9)


def prefix(items: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The first of the sorted ``items``, those of ``hot`` last: sets of this similarity share one of these."""
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, items), len(hot) - 1)] == items
        items = np.concatenate([items[~late], items[late]])
    return items[: len(items) - least_common(similarity, len(items)) + 1]


def late_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that come last in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0) if batch.num_rows else ():
                sets = [shingle_set(t.encode(), shingle) for t in texts_of(part.column(0)).to_pylist()]
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                for a in range(0, len(found), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["key", "m"])

    some = small_batches(docs.select(F.col(text).alias("_text")).filter(F.pmod(F.xxhash64("_text"), F.lit(ORDER_EVERY)) == 0))
    counts = some.mapInArrow(run, "key long, m long").groupBy("key").agg(F.sum("m").alias("m")).filter(F.col("m") >= ORDER_TEXTS)
    late = most_frequent(save(counts, "late"), ORDER_SHINGLES)
    return np.sort(late.select("key").toArrow()["key"].to_numpy().view("<u8"))


def shared_keys(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (node, size, prefix) to rows key, node, size, place for each shingle of a prefix that two nodes have;
    ``place``: where the shingle stands in the prefix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                sets = [np.frombuffer(x, "<i8") for x in part.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                if len(rows):
                    places = np.concatenate([np.arange(len(x), dtype=np.int32) for x in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), part.column(0).take(rows), part.column(1).take(rows), pa.array(places)], names=["key", "node", "size", "place"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            key = b.column(0).to_numpy()
            same = key[1:] == key[:-1]
            some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if some.any():
                yield b.filter(pa.array(some))

    schema = "key long, node long, size int, place int"
    tasks = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = small_batches(prefixes).select("node", "size", "prefix").mapInArrow(spread, schema)
    return save(rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(shared, schema), "keys")


def key_pairs(rows: DataFrame, similarity: float, star: bool) -> DataFrame:
    """``rows`` (key, node, size, place, root) to pairs a < b of one key, of different roots, whose sizes and places allow
    the similarity: all, or (``star``) those of one node of each key with over ``STAR_ROWS``: that with the least place,
    of these the largest.  A pair may come once for each key it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            key, node, size, place, root = (b.column(i).to_numpy() for i in range(5))
            seen: set[tuple[int, int]] = set()

            def made(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
                for i in range(0, len(x), 1 << 16):
                    p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                    least = np.ceil((size[p] + size[q]) * (similarity / (1 + similarity)) - 1e-9)
                    most = np.minimum(size[p] - place[p], size[q] - place[q])
                    fit = (root[p] != root[q]) & (np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q]) - 1e-9) & (most >= least)
                    if fit.any():
                        one, other = node[p[fit]], node[q[fit]]
                        pairs = set(zip(np.minimum(one, other).tolist(), np.maximum(one, other).tolist(), strict=True)) - seen
                        if len(seen) + len(pairs) > SEEN_PAIRS:
                            seen.clear()
                        seen.update(pairs)
                        if pairs:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            if star:
                many = np.diff([*first, len(key)]) > STAR_ROWS
                centre = np.lexsort((node, -size, place, group))[first]
                x = np.flatnonzero(many[group])
                x = x[x != centre[group[x]]]
                yield from made(centre[group[x]], x)
                continue
            # within a key the rows of its most frequent root come last: they need no pairs among themselves
            _, inverse, count = np.unique(np.column_stack([group, root]), axis=0, return_inverse=True, return_counts=True)
            often = count[inverse]
            order = np.lexsort((root, often, group))
            key, node, size, place, root, group = key[order], node[order], size[order], place[order], root[order], group[order]
            ends = np.append(first[1:], len(key))[group]
            x, step = np.flatnonzero(root != root[ends - 1]), 1
            while len(x := x[x + step < ends[x]]):
                yield from made(x, x + step)
                step += 1

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "node", "size", "place", "root").repartition(tasks, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, similarity: float, items_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges among ``pairs`` (a, b) that have the similarity.

    Pairs meet in cells: a pair's group is the least hash among its two texts and all they are paired with, a group's texts
    are dealt to blocks of about ``CHECK_ROWS``, and a cell holds the texts of two blocks.  So n texts that are all paired
    travel n / ``CHECK_ROWS`` times each, not n times.
    """
    pairs = save(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    own, other = F.xxhash64("a"), F.xxhash64("b")
    ends = pairs.select("a", F.least(own, other).alias("_h")).union(pairs.select(F.col("b").alias("a"), F.least(own, other).alias("_h")))
    least = save(ends.groupBy("a").agg(F.min("_h").alias("_h")), "groups")
    of = lambda c: least.select(F.col("a").alias(c), F.col("_h").alias(f"_{c}"))
    grouped = save(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("_a", "_b").alias("_group")), "grouped")
    texts = grouped.select("_group", "a").union(grouped.select("_group", "b")).distinct()
    large = save(texts.groupBy("_group").agg(F.ceil(F.count("*") / F.lit(CHECK_ROWS)).alias("_blocks")).filter("_blocks > 1"), "blocks")
    x, y = (F.pmod(F.xxhash64(F.lit(1), c), F.coalesce("_blocks", F.lit(1))) for c in ("a", "b"))
    dealt = grouped.join(F.broadcast(large), "_group", "left").select(F.xxhash64("_group", F.least(x, y), F.greatest(x, y)).alias("key"), "a", "b")
    active = save(dealt.select("key", F.col("a").alias("node")).union(dealt.select("key", F.col("b").alias("node"))).distinct(), "active")
    return save(exact_links(active.join(items_of(active.select("node").distinct()), "node"), similarity), "links")


def by_key(fps: DataFrame, partitions: Sequence[tuple[Sequence[int], int]], words: int, verify: Callable[[DataFrame], DataFrame], *, key_rows: int = KEY_ROWS) -> DataFrame:
    """What ``verify`` makes of the rows key, sig, node, fp of ``fps`` (node, fp; distinct), dealt by key.

    Keys with over ``key_rows`` rows are parted by further bits first.
    """
    radius = sum(t + 1 for _, t in partitions) - 1
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = dict(enumerate(signatures(partitions)))  # the bits that the rows of a signature's keys share
    masks = [(i, mask_of(bits, words)) for i, bits in sigs.items()]
    rows, keys = _probe(fps, masks), _probe(fps, masks, whole=False)
    made: list[DataFrame] = []
    while True:
        open_sigs = [i for i, bits in sigs.items() if len(bits) < 64 * words - BLOCK]
        large = keys.groupBy("key").agg(F.count("*").alias("_n"), F.min("sig").alias("sig")).filter(F.col("_n") > key_rows)
        hot = save(large.filter(F.col("sig").isin(open_sigs)).select("key", "sig"), "hot")
        found = sorted(r[0] for r in hot.select("sig").distinct().collect())  # no more than there are signatures
        cold = rows.join(hot.select("key"), "key", "left_anti") if found else rows
        made.append(save(verify(cold.repartition(tasks, "key").sortWithinPartitions("key", "node")), "verified"))
        if not found:
            return _union_all(made)
        # the rows of a hot key share its bits; the pigeonhole on the others parts them
        again = save(rows.join(hot.select("key"), "key", "left_semi").withColumnRenamed("key", "_from"), "again")
        parts = []
        for s in found:
            others = [b for b in range(64 * words) if b not in set(sigs[s])]
            for bits in np.array_split(others, min(radius + 1, len(others))):
                i = max(sigs) + 1
                sigs[i] = [*sigs[s], *bits.tolist()]
                parts.append(_probe(again.filter(F.col("sig") == s), [(i, mask_of(sigs[i], words))]))
        rows = keys = save(_union_all(parts), "parted")


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def statistics(fps: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of ones, of pairs of ones, and rows, over all of ``fps``; one partial sum per task, added in Spark."""
    bits = 64 * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits)), 0
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096).take(pa.array(np.arange(min(4096, b.num_rows - a))))
                x = bits_of(_fp_array(part.column(0), words)).astype(np.float32)
                total += x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    sums = np.zeros(bits * bits + 1, np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        sums[cell] = n
    pairs = sums[:-1].reshape(bits, bits)
    return pairs, np.diag(pairs).copy(), int(sums[-1])


def block_histograms(fps: DataFrame, blocks: Sequence[Sequence[int]], words: int) -> np.ndarray:
    """Counts of the 2^BLOCK values of each block, over all of ``fps``."""
    weights = 1 << np.arange(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 1 << BLOCK), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096).take(pa.array(np.arange(min(4096, b.num_rows - a))))
                x = bits_of(_fp_array(part.column(0), words))
                for i, block in enumerate(blocks):
                    total[i] += np.bincount(x[:, block] @ weights, minlength=1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(len(blocks) << BLOCK, np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(len(blocks), -1)


# --- operators -----------------------------------------------------------------------------------------------------


def simhash_fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed long."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingles(t.encode(), shingle))[0] for t in texts_of(part.column(1)).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, "<u8").view(np.int64))], names=["doc_id", "fp"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, radius: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) of fingerprints of ``distinct`` (fp, once each), by the pigeonhole: they join the same components as
    all links."""
    nodes = _long_nodes(distinct)
    pairs, ones, n = statistics(nodes, 1)
    blocks = group_bits(pairs, ones, n)
    partitions = plan(blocks, block_histograms(nodes, blocks, 1), radius, n, range(1, 2 * radius + 3))
    return by_key(nodes, partitions, 1, linked(Link(1, radius), 1), key_rows=key_rows)


def simhash_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (node, fp) to pairs a < b: each node with the least one of its fingerprint, and these where fingerprints
    link."""
    least = save(prints.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    links = fingerprint_links(least, radius)
    same = keyed_join(prints, least, "fp").select(F.col("least").alias("x"), F.col("node").alias("y"))
    ends = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    return same.union(ends).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id of those reachable by links."""
    rows = save(simhash_fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle), "fingerprints")
    least = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(least, radius, key_rows))
    known = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return keyed_join(rows, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _long_nodes(least: DataFrame) -> DataFrame:
    """node and fp: the fingerprint as a long and as eight bytes, least first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + 8] for i in range(0, len(raw), 8)], pa.binary())], names=["node", "fp"])

    return least.select("fp").mapInArrow(run, "node long, fp binary")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, radius: int = NEAR_RADIUS) -> DataFrame:
    """A row per document: doc_id, text_hash, and of its class of exact and near copies class_id (the least doc_id) and
    class_hash (the text_hash that goes with it)."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("_text"), F.xxhash64(body).alias("text_hash"))
    known_late = docs.sparkSession.sparkContext.broadcast(late_shingles(docs, text, shingle))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.encode(), shingle) for t in part.column(1).to_pylist()]
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        prefixes = [prefix(x, similarity, known_late.value).tobytes() for x in sets]
        prints = np.array([fingerprint_of(x)[0] for x in sets], "<u8").view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes), pa.array(prints), pa.array([len(x) for x in sets], pa.int32()), pa.array(prefixes, pa.binary())], names=["doc_id", "text_hash", "node", "fp", "size", "prefix"])

    rows = save(map_slices(keyed, run, "doc_id long, text_hash long, node long, fp long, size int, prefix binary"), "sets")
    own = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    known = save(rows.groupBy("node").agg(F.min(F.struct(own.alias("i"), F.col("text_hash").alias("h"))).alias("least")), "distinct")
    # one prefix of each node: that of its least row (of rows equal in id and text any)
    first = rows.join(known, "node").filter((own == F.col("least.i")) & (F.col("text_hash") == F.col("least.h")))
    repeated = not rows.groupBy(own, "text_hash").agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()
    prefixes, prints = first.select("node", "size", "prefix"), first.select("node", "fp").distinct()

    def items_of(nodes: DataFrame) -> DataFrame:
        texts = save(nodes.join(known, "node").select("node", F.col("least.i").alias("_i"), F.col("least.h").alias("_h")), "texts")
        return save(_items(docs, texts, text, doc_id, shingle, repeated), "items")

    keys = shared_keys(prefixes.dropDuplicates(["node"]) if repeated else prefixes)
    rooted = lambda links: keys.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = checked(simhash_pairs(prints, radius), similarity, items_of)
    for star in (True, False):
        links = links.union(checked(key_pairs(rooted(links), similarity, star), similarity, items_of))
    joined = known.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = joined.join(joined.groupBy("root").agg(F.min("least").alias("class")), "root").select("node", "class")
    return keyed_join(rows.select("doc_id", "text_hash", "node"), classes, "node").select("doc_id", "text_hash", F.col("class.i").alias("class_id"), F.col("class.h").alias("class_hash"))


def _items(docs: DataFrame, texts: DataFrame, text: str, doc_id: str, shingle: int, repeated: bool) -> DataFrame:
    """node and items, the sorted 64-bit hashes of a text's shingles, for each of ``texts`` (node, _i, _h); ``repeated``:
    rows may be equal in id and text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.encode(), shingle).tobytes() for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "items"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("_i"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    small = texts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(texts) if small else texts.hint("shuffle_hash"), ["_i", "_h"]).select("node", "_text")
    out = map_slices(found, run, "node long, items binary")
    return out.dropDuplicates(["node"]) if repeated else out


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` with one row of each class: that with the least doc_id (of rows equal in id and text one)."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options)
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    kept = save(found.filter((F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).select(F.col("class_id").alias("_i"), F.col("class_hash").alias("_h")), "kept")
    once = kept.groupBy("_i", "_h").agg(F.count("*").alias("_n"))
    repeated = not once.filter("_n > 1").isEmpty()
    rows = docs.select(whole_row(docs), own.alias("_i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    out = rows.join(once.select("_i", "_h").hint("shuffle_hash"), ["_i", "_h"], "left_semi")
    return (out.dropDuplicates(["_i", "_h"]) if repeated else out).select(*row_columns(docs.columns))
