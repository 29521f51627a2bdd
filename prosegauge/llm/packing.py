"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised, ended with a separator id and cut into pieces of at most ``capacity`` tokens (only longer
documents are cut).  Pieces of one length are interchangeable, so a packing is a multiset of bins, each a tuple of
lengths, and the whole problem is the histogram of lengths: at most ``capacity`` numbers at any corpus size.

The grouping genetic algorithm runs on that histogram.  A crossover injects whole well-filled bins of one parent,
removes the bins of the other that would hold an injected piece twice, and best-fits the displaced pieces, after
displaced pieces have changed places with smaller ones of bins that they fill better.  A mutation empties bins.
Parents are drawn by tournament from the whole population, which holds no two packings of equal bins.  Islands are
Spark tasks with populations of their own; after each epoch every island's elite migrates to its neighbour, and the
best of all to every island.  A search ends where the number of bins is the least that the sum of lengths allows, or
when its budget of generations, and of bins looked at, is spent.  Best fit works on counts of equal bins, so a
generation costs the same for a thousand documents and for a billion.

The best packing becomes intervals: of the pieces of length L, those ranked a to b fill certain bins at a certain
offset.  Pieces are ranked within their length in hash cells (a third of all pieces may share one length) and find
their interval by binary search in a table that has one row per distinct bin and length; best fit makes at most a few
bins per length and remainder, so the table is bounded by the capacity, not by the data, and is broadcast.

Nulls and ties: a null or empty text is the separator alone (one piece of length 1); repeated rows are packed each;
equal pieces may swap places, with the same multiset of rows up to sequence numbers.  An empty table gives an empty
result.  Columns besides id and text do not matter.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import random
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, ranked, save, texts_of

#: Chunks whose ids a worker remembers; beyond that it forgets all.
CACHE = 200_000
#: Set between chunks that are encoded together; a token of its own.
MARK = "\x1f"
#: Different bins that an island looks at in an epoch, and displaced lengths up to which exchanges are tried.
BUDGET, FEW = 200_000, 48
#: Packings of an island that outlive an epoch.
KEPT = 3
Pattern = tuple[int, ...]
Packing = dict[Pattern, int]

_tokenizers: dict[str, tuple[object, dict[str, bytes]]] = {}


def _tokenizer(path: str) -> tuple[object, dict[str, bytes]]:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _encode(chunks: list[str], tokenizer: object) -> Iterator[bytes]:
    """Ids of each chunk, four bytes each.  A run of a-z is one word to the tokenizer's splitter and goes straight to its
    model; other chunks are encoded a hundred at a time with a mark between them."""
    model, mark = tokenizer.model, tokenizer.encode(MARK, add_special_tokens=False).ids
    other = [c for c in chunks if not (c.isascii() and c.isalpha() and c.islower())]
    plain = iter([c for c in other if MARK not in c])
    groups = list(iter(lambda: list(itertools.islice(plain, 100)), []))
    found: dict[str, bytes] = {c: _packed(tokenizer.encode(c, add_special_tokens=False).ids) for c in other if MARK in c}
    for part in itertools.batched(groups, 100):
        for group, e in zip(part, tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in part], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == mark[0])
            if len(mark) != 1 or len(ends) != len(group) - 1:
                found.update(zip(group, [_packed(x.ids) for x in tokenizer.encode_batch(group, add_special_tokens=False)], strict=True))
            else:
                found.update(zip(group, [x[k > 0 :].tobytes() for k, x in enumerate(np.split(ids, ends))], strict=True))
    return (found[c] if c in found else _packed([t.id for t in model.tokenize(c)]) for c in chunks)


def encode_slice(texts: pa.Array, path: str, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``separator``, and the n + 1 places where texts begin.

    The tokenizer lower-cases, drops white space and never merges across it or between a letter and a full stop or
    comma, so each distinct chunk is encoded once; the ids of a text are those of its chunks.
    """
    tokenizer, cache = _tokenizer(path)
    texts = pa.array(texts, pa.large_string())
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])(\s|$)", r"\1 \2\3")
    chunks = pc.ascii_split_whitespace(texts)
    coded = chunks.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    missing = [c for c in known if c not in cache]
    if len(cache) + len(missing) > CACHE:
        cache.clear()
        missing = known
    cache.update(zip(missing, _encode(missing, tokenizer), strict=True))
    ids = [cache[c] for c in known] + [_packed([separator])]
    lengths = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    offsets = chunks.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    index = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:], len(known))
    each = lengths[index]
    upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    where = np.repeat(starts[index] - upto[:-1], each) + np.arange(upto[-1])
    return flat[where], upto[offsets + np.arange(len(offsets))]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, separator: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, places = encode_slice(texts_of(part.column(1)), tokenizer, separator)
        total = np.diff(places)
        n = -(-total // capacity)
        row = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, total[row] - start)
        begin = places[row] + start
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], bins: Packing, capacity: int) -> Packing:
    """Put ``counts`` (length: how many) into ``bins`` and new ones: longest first, each into the fullest bin it fits."""
    out = dict(bins)
    pools: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for p, m in bins.items():
        if (room := capacity - sum(p)) > 0:
            pools[room][p] = m
    rooms = sorted(pools)

    def pool(room: int, p: Pattern, m: int) -> None:
        out[p] = out.get(p, 0) + m
        if room > 0:
            if not pools[room]:
                bisect.insort(rooms, room)
            pools[room][p] = pools[room].get(p, 0) + m

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if left >= fit:
                    pool(capacity - fit * length, (length,) * fit, left // fit)
                if left % fit:
                    pool(capacity - left % fit * length, (length,) * (left % fit), 1)
                left = 0
                break
            room = rooms[at]
            p, m = next(iter(pools[room].items()))
            fit = room // length
            use, each = (min(m, left // fit), fit) if left >= fit else (1, left)
            left -= use * each
            if use == m:
                del pools[room][p], out[p]
                if not pools[room]:
                    del rooms[at]
            else:
                pools[room][p] = out[p] = m - use
            pool(room - each * length, tuple(sorted(p + (length,) * each, reverse=True)), use)
    return out


def _need(p: Pattern) -> dict[int, int]:
    need: dict[int, int] = {}
    for length in p:
        need[length] = need.get(length, 0) + 1
    return need


def exchange(bins: Packing, left: dict[int, int], capacity: int) -> None:
    """Let one or two pieces of a bin change places with one or two of ``left`` that fill it better, one bin after
    another.  Both arguments are changed; the larger pieces end up in bins, which leaves smaller ones to best fit."""
    for p in sorted((p for p in bins if sum(p) < capacity), key=lambda p: (-sum(p), p)):
        times = bins[p]
        while times > 0:
            room = capacity - sum(p)
            singles = sorted(length for length, n in left.items() if n)
            if len(singles) > FEW:
                return
            offers = sorted({(x, (x,)) for x in singles} | {(x + y, (x, y)) for i, x in enumerate(singles) for y in singles[i:] if x != y or left[x] > 1})
            sums = [x for x, _ in offers]
            best: tuple[int, Pattern, Pattern] = (0, (), ())
            for out in {(x,) for x in p} | set(itertools.combinations(p, 2)):
                at = bisect.bisect_right(sums, sum(out) + room) - 1
                if at >= 0 and sums[at] - sum(out) > best[0]:
                    best = (sums[at] - sum(out), out, offers[at][1])
            if not best[0]:
                break
            kept = list(p)
            for x in best[1]:
                kept.remove(x)
                left[x] = left.get(x, 0) + 1
            for x in best[2]:
                left[x] -= 1
            full = tuple(sorted((*kept, *best[2]), reverse=True))
            bins[full] = bins.get(full, 0) + 1
            times -= 1
            if bins[p] == 1:
                del bins[p]
            else:
                bins[p] -= 1


def crossover(a: Packing, b: Packing, histogram: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Inject well-filled bins of ``b`` into ``a``, drop the bins of ``a`` that then hold too much, best-fit the rest."""
    slack = rng.choice((0, 0, 1, 2, 4, 8, 16))
    share = rng.random()
    child: Packing = {}
    left = dict(histogram)

    def take(p: Pattern, most: int) -> None:
        need = _need(p)
        times = min(most, *(left.get(length, 0) // n for length, n in need.items()))
        if times > 0:
            child[p] = child.get(p, 0) + times
            for length, n in need.items():
                left[length] -= n * times

    for p, m in sorted(b.items()):
        if capacity - sum(p) <= slack and rng.random() < share:
            take(p, m)
    emptied = rng.choice((0.05, 0.2, 0.5))  # the mutation: bins of the other parent that are emptied, the ill-filled ones mostly
    for p, m in sorted(a.items(), key=lambda x: (-sum(x[0]), x[0])):
        if rng.random() >= emptied * (0.3 if capacity - sum(p) <= slack else 1.0):
            take(p, m)
    exchange(child, left, capacity)
    return best_fit({length: n for length, n in left.items() if n}, child, capacity)


def fitness(p: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then bins that are fuller or emptier."""
    return sum(p.values()), -sum(m * (sum(x) / capacity) ** 2 for x, m in p.items())


def evolve(histogram: dict[int, int], migrants: list[Packing], capacity: int, seed: int, population: int, generations: int, budget: int = BUDGET) -> list[Packing]:
    """The packings of one island, the best first."""
    rng = random.Random(seed)
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    people: list[tuple[tuple[int, float], Packing]] = []

    def join(p: Packing) -> None:
        value = fitness(p, capacity)
        if all(value != other or p != q for other, q in people):
            people.append((value, p))
            people.sort(key=lambda x: x[0])
            del people[population:]

    for p in (*migrants, best_fit(histogram, {}, capacity)):
        join(p)
    while len(people) < population and people[0][0][0] > least and budget > 0:
        first = rng.sample(sorted(histogram), max(1, len(histogram) // rng.choice((2, 3, 4, 8))))
        some = best_fit({k: rng.randint(1, histogram[k]) for k in first}, {}, capacity)
        used: dict[int, int] = {}
        for p, m in some.items():
            for k, n in _need(p).items():
                used[k] = used.get(k, 0) + n * m
        made = best_fit({k: n - used.get(k, 0) for k, n in histogram.items() if n > used.get(k, 0)}, some, capacity)
        before = len(people)
        join(made)
        budget -= len(made) if len(people) > before else budget
    for _ in range(generations):
        if people[0][0][0] <= least or budget <= 0:
            break
        a, b = (min(rng.choices(people, k=2), key=lambda x: x[0])[1] for _ in range(2))
        child = crossover(a, b, histogram, capacity, rng)
        budget -= len(child) + len(a)
        join(child)
    return [p for _, p in people]


def pack_histogram(df: DataFrame, histogram: dict[int, int], capacity: int, *, islands: int, epochs: int, population: int, generations: int, seed: int) -> Packing:
    """Islands evolve as tasks; between epochs each gets its neighbour's elite and the best of all.

    The best ``KEPT`` packings of each island, which the capacity bounds, are with the driver between epochs.
    """
    spark = df.sparkSession
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    known: list[list[Packing]] = [[] for _ in range(islands)]
    start = best_fit(histogram, {}, capacity)
    if sum(start.values()) <= least:  # nothing to search for
        return start
    for epoch in range(epochs):
        best = min((p for x in known for p in x[:1]), key=lambda p: fitness(p, capacity), default=start)
        sent = [[*known[i], *known[i - 1][:1], best] for i in range(islands)]

        def island(batches: Iterator[pa.RecordBatch], epoch: int = epoch, sent: list = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    found = evolve(histogram, sent[i], capacity, seed + 1000 * epoch + i, population, generations)[:KEPT]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array([pickle.dumps(p) for p in found])], names=["island", "place", "packing"])

        found = spark.range(0, islands, 1, islands).mapInArrow(island, "island long, place long, packing binary").collect()
        known = [[] for _ in range(islands)]
        for r in sorted(found, key=lambda r: (r["island"], r["place"])):
            known[r["island"]].append(pickle.loads(r["packing"]))
        if min(fitness(x[0], capacity)[0] for x in known) <= least:
            break
    return min((x[0] for x in known), key=lambda p: fitness(p, capacity))


def intervals(packing: Packing) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first bin, offset in the bin), sorted by length and rank."""
    at: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for p, m in sorted(packing.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length, n in _need(p).items():
            rows.append((length, at[length], n, first, offset))
            at[length] += n * m
            offset += n * length
        first += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, separator: int = 0, text: str = "text", doc_id: str = "doc_id", islands: int = 4, epochs: int = 4, population: int = 24, generations: int = 400, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = save(pieces(docs, tokenizer, capacity=capacity, separator=separator, text=text, doc_id=doc_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not histogram:
        return docs.sparkSession.createDataFrame([], schema)
    best = pack_histogram(docs, histogram, capacity, islands=islands, epochs=epochs, population=population, generations=generations, seed=seed)
    table = intervals(best)
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            row = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            within = rank - row[:, 1]
            f["sequence_id"] = row[:, 3] + within // row[:, 2]
            f["offset"] = row[:, 4] + within % row[:, 2] * length
            yield f.drop(columns="_rank")

    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))
    return ranked(cut, ["length"], order, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank").select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(place, schema)
