"""Lempel-Ziv phrase fingerprints.

Each text is parsed into the phrases of an LZ78 dictionary: the shortest prefix of the rest that is not yet a phrase.
Phrases are hashed by a polynomial over code points (from prefix sums, so all phrases of a text at once), the hashes
are dealt to ``LANES`` lanes by their top bits, and a lane keeps its least 16-bit value (one-permutation minimum
hashing; 0 is an empty lane).  Likeness is the share of equal lanes among those that are not empty in both, an
estimate of the Jaccard similarity of the phrase sets, and so of how well one text's dictionary compresses the other.

The query's edited text needs each document's successor.  Documents are dealt to ranges of ids by distributed
quantiles, each range is sorted and streamed by one task, and the first row of each range is also sent to the range
before it: one shuffle of the texts, and a task holds two texts at a time.

Nulls and ties: a null text is an empty one (no phrases; its likeness to another empty text is 1, to any other 0);
documents with one id follow each other by text; null ids come after all others.  A single document is its own
successor.  An empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_of

LANES = 128
#: Documents of a range of ids, about, and ranges at most (sizes of tasks, not of what is compared).
RANGE_ROWS, RANGES = 1500, 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 1 << 20:
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parse(text: str, known: set[str] | None = None, ends: list[int] | None = None, at: int = 0, open_phrase: str = "") -> tuple[set[str], list[int], str]:
    """Continue an LZ78 parse: the phrases, where they end, and the phrase that is still open at the end of ``text``."""
    known = set() if known is None else known
    ends = [] if ends is None else ends
    phrase, add, end = open_phrase, known.add, ends.append
    for i, c in enumerate(text, at + 1):
        phrase += c
        if phrase not in known:
            add(phrase)
            end(i)
            phrase = ""
    return known, ends, phrase


def phrase_hashes(text: str, ends: list[int], left: str = "") -> np.ndarray:
    """64-bit hashes of the phrases of ``text``; an open phrase at the end is a phrase already there."""
    if not ends:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(points + np.uint64(1)) * _power(_BASE, len(points)), dtype=np.uint64)])
    stop = np.array(ends, np.int64)
    start = np.concatenate([[0], stop[:-1]])
    return _mix((sums[stop] - sums[start]) * _power(_INVERSE, int(start[-1]) + 1)[start])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value (1 to 65535) of each lane; 0 if it has none."""
    out = np.full(LANES, 65536, np.int64)
    np.minimum.at(out, (hashes >> np.uint64(57)).astype(np.int64), ((hashes >> np.uint64(20)) % np.uint64(65535)).astype(np.int64) + 1)
    return np.where(out == 65536, 0, out).astype(np.uint16)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def fingerprint(text: str) -> np.ndarray:
    _, ends, _ = parse(text)
    return signature(phrase_hashes(text, ends))


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint (hexadecimal, four digits a lane) of every whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [as_text(fingerprint(t)) for t in texts_of(part.column(1)).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), run, "doc_id long, fingerprint string")


def edited_pair(text: str, after: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text and the fingerprints of text and edited text; their common first half is parsed once."""
    half = len(text) - len(text) // 2
    edited = text[:half] + after[: len(text) // 2]
    known, ends, phrase = parse(text[:half])
    more = parse(text[half:], set(known), list(ends), half, phrase)
    other = parse(edited[half:], known, ends, half, phrase)
    return edited, signature(phrase_hashes(text, more[1])), signature(phrase_hashes(edited, other[1]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)


def compare_with_next(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text (see the module), and their likeness."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col(doc_id).cast("long").isNull().alias("_none"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = rows.count()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    cuts = rows.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] if ranges > 1 else []
    cuts = sorted(set(cuts))
    dealt = rows.withColumn("_range", _range_of(cuts))
    heads = dict(map(tuple, dealt.groupBy("_range").agg(F.max("_id")).collect()))  # one id per range
    order = sorted(heads)
    before = [(heads[r], order[i - 1], i == 0) for i, r in enumerate(order)]
    borrowed = docs.sparkSession.createDataFrame(before, "_id long, _to int, _wrap boolean")
    firsts = dealt.join(F.broadcast(borrowed), "_id").select(F.col("_to").alias("_range"), "_id", "_none", "_text", F.when(F.col("_wrap"), 2).otherwise(1).alias("_lent"))
    # of equal ids the first in the order goes along
    firsts = firsts.groupBy("_range", "_id", "_none", "_lent").agg(F.min("_text").alias("_text")).select("_range", "_id", "_none", "_text", "_lent")
    both = dealt.select("_range", "_id", "_none", "_text", F.lit(0).alias("_lent")).unionByName(firsts)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 4)
    streams = both.repartition(parts, "_range").sortWithinPartitions("_range", "_lent", F.desc("_id"), "_text").select(F.col("_range").cast("long"), F.when(~F.col("_none"), F.col("_id")), "_text", "_lent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        last: tuple[int, int, str] | None = None  # a row whose successor is to come
        waiting: tuple[tuple, np.ndarray] | None = None  # its predecessor's result, but for the likeness to it
        for place, i, body, lent in _rows(batches):
            if last is not None and last[0] == place:
                edited, own, other = edited_pair(last[2], body)
                if waiting:
                    out.append((*waiting[0], likeness(waiting[1], own)))
                waiting = ((last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other)), own)
                if lent:
                    out.append((*waiting[0], likeness(own, fingerprint(body))))
                    waiting = None
            last = None if lent else (place, i, body)
            if len(out) >= 500:
                yield flush()
                out = []
        if out:
            yield flush()

    return streams.mapInArrow(run, schema)


def _range_of(cuts: list[int]) -> Column:
    """The number of cuts that are not below the id: range 0 has the largest ids."""
    if not cuts:
        return F.lit(0)
    sorted_cuts = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series((len(sorted_cuts) - np.searchsorted(sorted_cuts, ids.to_numpy(np.int64), "left")).astype(np.int32))

    return find(F.col("_id"))
