"""Sharding by a k-d tree over metadata.

Space is split recursively: a node that stands for k shards picks its widest metadata dimension (range within the
node over the range of all rows) and cuts it at the weighted median, or the weighted quantile that gives ceil(k/2)
shards' bytes to one side, until every leaf is one shard and so holds the target bytes.  The dimensions are length,
bytes a character, and the metadata columns; of a metadata column each distinct value counts as its rank among all of
them, so values that differ only far behind their beginning are apart as well.

Equal texts form one atom.  Atoms above ``FINE`` of a shard, at most shards / FINE of them, are placed on the driver:
by where they lie to the cut; a few near it change sides if this one would get too many bytes.  All smaller atoms are
cut by distributed quantiles so that they make up the rest of each side, which keeps sizes near equal although large
atoms stay whole.  Only groups of equal texts above ``whole`` of a shard are split into single rows; if the large
atoms cannot be dealt to the shards with that bound, it is halved until they can.

Quantiles are distributed: a level costs one aggregate for ranges and two histograms of 1024 sums per node, first over
the value's place in the node, then, within the place of the cut, over a hash that parts equal values.  Only those sums
reach the driver, and each level's shards are written to the shared folder.

Nulls and ties: a null text has no bytes (size is the fixed overhead) and forms a group with other nulls; null
metadata ranks before all values; equal rows have equal coordinates and stay together.  An empty table gives an empty
result; shards without rows do not appear.  Input columns other than the named ones do not matter and may have any
name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_index, null_key, ranked, save

BITS = 10
#: Large atoms on either side of a cut that may change sides.
NEAR = 256
#: Share of a shard above which an atom is placed by itself, and above which a group of equal texts is split.
FINE, WHOLE = 0.01, 0.5
#: Bytes of distinct metadata values up to which their ranks are broadcast.
BROADCAST_BYTES = 16 << 20
#: Copies of the ranks when they are joined by a shuffle: a value of a third of all rows is spread over as many tasks.
SALTS = 64


def with_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank of the value of ``column`` among its distinct values, null first."""
    values = global_index(rows.select(null_key(F.col(column)).alias("_v")).distinct(), [F.col("_v")], "_rank")
    values = save(values.select("_v", F.col("_rank").cast("double").alias(name)), "ranks")
    keyed = rows.withColumn("_v", null_key(F.col(column)))
    if values.agg(F.coalesce(F.sum(F.octet_length("_v") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(values), "_v").drop("_v")
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("_salt", F.pmod(F.xxhash64("_r"), F.lit(SALTS)).cast("int")).join(salted, ["_v", "_salt"]).drop("_v", "_salt")


NODE = "shard int, _dim int, _lo double, _hi double, _left int, _at int, _tie_at int"
CELLS = 1 << BITS


def _placed(rows: DataFrame, nodes: list[tuple], dims: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``nodes`` (as NODE has them; null for atoms of closed nodes) and with where an atom
    lies along its node's dimension: the value's place and, for equal values, a hash (0 to 2^BITS - 1)."""
    known = F.broadcast(rows.sparkSession.createDataFrame(nodes, NODE))  # a row for each open node
    value = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("_dim") + 1)
    span = F.col("_hi") - F.col("_lo")
    place = F.when(span > 0, F.least(F.floor((value - F.col("_lo")) / span * CELLS), F.lit(CELLS - 1))).when(span <= 0, 0)
    tie = F.pmod(F.xxhash64("_a", "_b", "_dim", "shard"), F.lit(CELLS))
    return rows.join(known, "shard", "left").withColumns({"_place": place.cast("int"), "_tie": tie.cast("int")})


def _cut(weights: dict[int, int], goal: float) -> tuple[int, float]:
    """The cell in which the running sum passes ``goal``, and the sum before it; -1 if nothing is to go left."""
    before = 0.0
    for cell in sorted(weights):
        if before + weights[cell] > goal:
            return cell, before
        before += weights[cell]
    return CELLS, before


@dataclass(eq=False)
class Atom:
    """An atom that is placed on the driver; ``tie`` orders atoms of one value."""

    a: int
    b: int
    size: int
    values: list[float]
    tie: int
    shard: int = 0


@dataclass
class Node:
    first: int
    shards: int
    dim: int = 0
    low: float = 0.0
    high: float = 0.0
    goal: float = 0.0
    small: int = 0

    @property
    def left(self) -> int:
        return (self.shards + 1) // 2

    def place(self, value: float) -> int:
        span = self.high - self.low
        return min(int((value - self.low) / span * CELLS), CELLS - 1) if span > 0 else 0


def divided(atoms: list[Atom], node: Node, weights: dict[int, int], total: float) -> int:
    """Move the large atoms of the right side to its first shard; return their bytes on the left.

    They go by their place, as the combined weights have the cut.  Small atoms can then make up the left side's bytes
    if the large ones there are neither too many nor too few; else the move or the exchange of two among the ``NEAR``
    on either side of the cut that comes nearest to that is made, again and again.
    """
    ordered = sorted(atoms, key=lambda x: (node.place(x.values[node.dim]), x.values[node.dim], x.tie))
    places = [node.place(x.values[node.dim]) for x in ordered]
    both = dict(weights)
    for x, at in zip(ordered, places, strict=True):
        both[at] = both.get(at, 0) + x.size
    cell, before = _cut(both, node.goal)
    before += weights.get(cell, 0) / 2
    left: list[Atom] = []
    right: list[Atom] = []
    for x, at in zip(ordered, places, strict=True):
        stays = at < cell or (at == cell and before + x.size / 2 <= node.goal)
        before += x.size * (stays and at == cell)
        (left if stays else right).append(x)
    have = sum(x.size for x in left)
    least, most = node.goal - (total - sum(x.size for x in atoms)), node.goal
    off = lambda n: np.maximum(np.maximum(n - most, least - n), 0.0)
    while off(have) > 0:
        a, b = left[-NEAR:], right[:NEAR]
        change = np.array([0.0, *(x.size for x in b)])[None, :] - np.array([0.0, *(x.size for x in a)])[:, None]
        i, j = np.unravel_index(np.argmin(off(have + change)), change.shape)
        if off(have + change[i, j]) >= off(have):
            break
        have += int(change[i, j])
        if i:
            left.remove(a[i - 1])
            right.insert(0, a[i - 1])
        if j:
            right.remove(b[j - 1])
            left.append(b[j - 1])
    for x in right:
        x.shard = node.first + node.left
    return have


def split_tree(atoms: DataFrame, large: list[Atom], dims: Sequence[str], shards: int) -> DataFrame:
    """``atoms`` (_a, _b, _bytes and ``dims``), all that are not ``large``, with ``shard``; sets the shard of each of
    ``large`` as well."""
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    rows = save(atoms.withColumn("shard", F.lit(0)), "level")  # a literal would make the joins by shard cross joins
    open_nodes = [Node(0, shards)]
    spans: list[float] = []
    while any(node.shards > 1 for node in open_nodes):
        found = {r["shard"]: r for r in rows.groupBy("shard").agg(F.sum("_bytes").alias("bytes"), *ends).collect()}  # a row a node
        nodes: dict[int, Node] = {}
        for node in open_nodes:
            mine = [x for x in large if x.shard == node.first]
            r = found.get(node.first)
            if node.shards == 1 or not (r or mine):
                continue
            low = [min([*([r[f"min_{d}"]] if r else []), *(x.values[i] for x in mine)]) for i, d in enumerate(dims)]
            high = [max([*([r[f"max_{d}"]] if r else []), *(x.values[i] for x in mine)]) for i, d in enumerate(dims)]
            spans = spans or [b - a for a, b in zip(low, high, strict=True)]
            node.dim = max(range(len(dims)), key=lambda i: (high[i] - low[i]) / spans[i] if spans[i] else 0.0)
            node.low, node.high, node.small = float(low[node.dim]), float(high[node.dim]), r["bytes"] if r else 0
            node.goal = (node.small + sum(x.size for x in mine)) * node.left / node.shards
            nodes[node.first] = node

        def sums(cell: str, where: str, at: dict[int, int], rows: DataFrame = rows, nodes: dict[int, Node] = nodes) -> dict[int, dict[int, int]]:
            """Bytes by cell of each node: 2^BITS sums of a node at most."""
            out: dict[int, dict[int, int]] = {n: {} for n in nodes}
            placed = _placed(rows, [(n, v.dim, v.low, v.high, v.left, at.get(n), None) for n, v in nodes.items()], dims)
            for n, c, w in placed.filter(where).groupBy("shard", cell).agg(F.sum("_bytes")).collect():
                out[n][c] = w
            return out

        if nodes:
            coarse = sums("_place", "_place is not null", {})
            goal = {}
            for n, v in nodes.items():
                mine = [x for x in large if x.shard == n]
                goal[n] = v.goal - divided(mine, v, coarse[n], v.small + sum(x.size for x in mine))
            cut = {n: _cut(coarse[n], goal[n]) for n in nodes}
            fine = sums("_tie", "_place = _at", {n: cell for n, (cell, _) in cut.items()})
            full = []
            for n, v in nodes.items():
                here, before = cut[n]
                cell, upto = _cut(fine[n], goal[n] - before)
                over, under = before + upto + fine[n].get(cell, 0) - goal[n], goal[n] - before - upto
                full.append((n, v.dim, v.low, v.high, v.left, here, cell if over <= under else cell - 1))
            right = (F.col("_place") > F.col("_at")) | ((F.col("_place") == F.col("_at")) & (F.col("_tie") > F.col("_tie_at")))
            rows = save(_placed(rows, full, dims).select(*atoms.columns, F.when(right, F.col("shard") + F.col("_left")).otherwise(F.col("shard")).alias("shard")), "level")
        open_nodes = [x for v in open_nodes for x in ([v] if v.shards == 1 else [Node(v.first, v.left), Node(v.first + v.left, v.shards // 2)])]
    return rows


def fits(sizes: Sequence[int], shards: int, most: float) -> bool:
    """Whether the sizes go into so many shards of ``most`` bytes, the largest first, each into the emptiest; those above
    ``most`` take one to themselves."""
    import heapq

    loads = [0.0] * shards
    for size in sorted(sizes, reverse=True):
        if loads[0] and loads[0] + size > most:
            return False
        heapq.heapreplace(loads, loads[0] + size)
    return True


def shard(docs: DataFrame, *, shards: int = 40, text: str = "text", doc_id: str = "doc_id", metadata: Sequence[str] = ("lang", "source"), overhead: int = 16, whole: float = WHOLE) -> DataFrame:
    """One row per document: ``doc_id``, size, text_crc32, shard and slot (its place within the shard)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"_m{i}" for i in range(len(metadata))]
    dims = ["_chars", "_bytes_a_char", *names]
    size = F.octet_length(body).cast("long")
    rows = save(
        docs.select(
            F.col(doc_id).alias("doc_id"), (size + overhead).alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.xxhash64(body).alias("_a"), F.xxhash64(F.lit(1), body).alias("_t"), F.xxhash64(F.col(doc_id), body).alias("_r"),
            F.log2(F.length(body) + F.lit(1)).alias("_chars"), F.coalesce(F.try_divide(size, F.length(body)), F.lit(1.0)).alias("_bytes_a_char"), *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(metadata)],
        ),
        "rows",
    )
    coded = rows
    for i, name in enumerate(names):
        coded = with_rank(coded, f"_c{i}", name)
    coded = save(coded.drop(*[f"_c{i}" for i in range(len(metadata))]), "coded")
    groups = save(coded.groupBy("_a", "_t").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"), F.max("size").alias("_each"), *[F.min(d).alias(d) for d in dims]), "groups")
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    # at most shards / FINE groups are larger, so they may come to the driver; so may their single rows
    found = groups.filter(F.col("_bytes") > FINE * total / shards).collect()
    while True:
        kept = [r["_bytes"] for r in found if r["_n"] == 1 or r["_bytes"] <= whole * total / shards]
        if fits(kept, shards, total / shards) or not any(r["_n"] > 1 and r["_bytes"] <= whole * total / shards for r in found):
            break
        whole /= 2
    hot = [r for r in found if r["_n"] > 1 and r["_bytes"] > whole * total / shards]
    split = spark.createDataFrame([(r["_a"], r["_t"], True) for r in hot], "_a long, _t long, _hot boolean")
    single = coded.join(F.broadcast(split), ["_a", "_t"]).groupBy("_a", F.col("_r").alias("_b")).agg(F.sum("size").alias("_bytes"), *[F.min(d).alias(d) for d in dims])
    atoms = groups.join(F.broadcast(split), ["_a", "_t"], "left_anti").select("_a", F.col("_t").alias("_b"), "_bytes", *dims).unionByName(single)
    atoms = save(atoms.withColumn("_large", F.col("_bytes") > FINE * total / shards), "atoms")
    large = [Atom(r["_a"], r["_b"], r["_bytes"], [float(r[d]) for d in dims], r["_tie"]) for r in atoms.filter("_large").withColumn("_tie", F.xxhash64("_a", "_b")).collect()]
    leaves = split_tree(atoms.filter("not _large").drop("_large"), large, dims, shards).select("_a", "_b", "shard")
    placed_large = spark.createDataFrame([(x.a, x.b, x.shard) for x in large], "_a long, _b long, shard int")
    leaves = save(leaves.unionByName(placed_large), "leaves")
    keyed = rows.join(F.broadcast(split), ["_a", "_t"], "left").withColumn("_b", F.when(F.col("_hot"), F.col("_r")).otherwise(F.col("_t")))
    placed = keyed.join(leaves, ["_a", "_b"]).select("doc_id", "size", "text_crc32", "shard", "_r")
    return ranked(save(placed, "placed"), ["shard"], F.col("_r"), [F.col("doc_id"), F.col("text_crc32")], "slot").drop("_r")
