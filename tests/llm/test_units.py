"""Parts of the operators by themselves."""

import collections
import functools
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm import ctw, gam, isomedia, kdshard, licences, lzprint, mixing, simhash, toxicity


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 4)), max_size=6), st.integers(0, 120))
@settings(max_examples=60, deadline=None)
def test_knapsack_is_optimal(items, budget):
    sizes, counts = [s for s, _ in items], [c for _, c in items]
    taken, total = mixing.knapsack(sizes, counts, budget)
    reach = {0}
    for s, c in items:
        reach = {x + k * s for x in reach for k in range(c + 1)}
    assert total == min(reach, key=lambda x: (abs(x - budget), x)) == sum(s * t for s, t in zip(sizes, taken, strict=True))
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))


@given(st.dictionaries(st.integers(1, 300), st.integers(1, 8), min_size=1, max_size=14), st.floats(0, 1), st.sampled_from([16, 1 << 12]))
@settings(max_examples=60, deadline=None)
def test_budget_is_met(histogram, share, capacity):
    """Against all sums there are: with the rest within the program's capacity none of what is left comes nearer; over it
    the sum is off by no more than a document."""
    sizes, counts = list(histogram), list(histogram.values())
    total = sum(s * c for s, c in histogram.items())
    budget = int(share * total)
    taken = mixing.fit_budget(sizes, counts, budget, capacity)
    used = sum(s * t for s, t in zip(sizes, taken, strict=True))
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert abs(budget - used) <= max(sizes)
    if capacity > total:
        floor = [c * budget // total for c in counts]
        sums = {0}
        for s, c, t in zip(sizes, counts, floor, strict=True):
            sums = {x + k * s for x in sums for k in range(c - t + 1)}
        have = sum(s * t for s, t in zip(sizes, floor, strict=True))
        assert abs(budget - used) == min(abs(budget - have - x) for x in sums)


@given(st.binary(max_size=20_000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(raw):
    body = isomedia.padded(raw)
    media = isomedia.write(body)
    found = isomedia.probe(media)
    assert found.error is None and isomedia.payload(media, found.tracks[0]) == body
    track = found.tracks[0]
    assert track.codec == "raw " and track.samples == len(body) // 64 and sum(b - a for _, a, b in track.keyframes) == len(body)
    for cut in (0, 7, 40, len(media) // 2, len(media) - 1):
        assert isomedia.probe(media[:cut]).error or not isomedia.probe(media[:cut]).tracks


def test_media_with_other_tables():
    """Compact sizes, 64-bit offsets and a large box size are read as well."""
    body = bytes(range(64)) * 3
    entry = isomedia.box(b"avc1", b"\0" * 78)
    full = isomedia.full_box

    def moov(at):
        stbl = isomedia.box(
            b"stbl",
            full(b"stsd", 0, 0, (1).to_bytes(4), entry),
            full(b"stts", 0, 0, (1).to_bytes(4), (3).to_bytes(4), (512).to_bytes(4)),
            full(b"stsc", 0, 0, (2).to_bytes(4), b"".join(x.to_bytes(4) for x in (1, 2, 1, 2, 1, 1))),
            full(b"stz2", 0, 0, bytes([0, 0, 0, 8]), (3).to_bytes(4), bytes([64, 64, 64])),
            full(b"co64", 0, 0, (2).to_bytes(4), at.to_bytes(8), (at + 128).to_bytes(8)),
        )
        mdhd = full(b"mdhd", 0, 0, b"\0" * 8, (1000).to_bytes(4), (1536).to_bytes(4), b"\0" * 4)
        hdlr = full(b"hdlr", 0, 0, b"\0" * 4, b"vide", b"\0" * 13)
        return isomedia.box(b"moov", isomedia.box(b"trak", isomedia.box(b"mdia", mdhd, hdlr, isomedia.box(b"minf", stbl))))

    head = isomedia.box(b"ftyp", b"mp42", b"\0" * 4)
    mdat = (1).to_bytes(4) + b"mdat" + (16 + len(body)).to_bytes(8) + body
    media = head + moov(len(head) + len(moov(0)) + 16) + mdat
    found = isomedia.probe(media)
    assert found.error is None and found.brand == "mp42"
    t = found.tracks[0]
    assert (t.codec, t.handler, t.timescale, t.duration, t.samples, len(t.keyframes)) == ("avc1", "vide", 1000, 1536, 3, 3)
    assert isomedia.payload(media, t) == body


def kt_sequence(bits):
    zeros = ones = 0
    p = 0.0
    for b in bits:
        p += math.log(((ones if b else zeros) + 0.5) / (zeros + ones + 1))
        ones, zeros = ones + b, zeros + 1 - b
    return p


def test_kt_block_equals_the_sequential_estimate():
    for bits in ([0], [1, 1, 0], [0] * 30 + [1] * 11):
        assert ctw.kt_block(np.array([bits.count(0) * 1.0]), np.array([bits.count(1) * 1.0]))[0] == pytest.approx(kt_sequence(bits))


def recursion(train, depth):
    """log10 probability of a gram (nearest byte first, symbol) by the definition of the mixture, over all ``train``."""
    counts = collections.defaultdict(lambda: [0, 0])
    followed = collections.defaultdict(set)
    for context, x in train:
        for d in range(depth + 1):
            if d:
                followed[context[: d - 1]].add(context[d - 1])
            for k in range(8):
                counts[context[:d], (256 | x) >> (8 - k)][x >> (7 - k) & 1] += 1

    def block(context, node):
        z, o = counts.get((context, node), (0, 0))
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @functools.cache
    def weighted(context, node):
        if len(context) == depth:
            return block(context, node)
        below = sum(weighted((*context, b), node) for b in followed.get(context, ()))
        return float(np.logaddexp(block(context, node), below)) - math.log(2)

    def one(context, node):
        settled, left, end = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            c = context[:d]
            z, o = counts.get((c, node), (0, 0))
            if z + o == 0:
                break
            kt = (o + 0.5) / (z + o + 1)
            end = settled + left * kt
            if d < depth:
                stop = 0.5 * math.exp(block(c, node) - weighted(c, node))
                settled, left = settled + left * stop * kt, left * (1 - stop)
        return end

    @functools.cache
    def log10(context, x):
        out = 0.0
        for k in range(8):
            p = one(context, (256 | x) >> (8 - k))
            out += math.log10(p if x >> (7 - k) & 1 else 1 - p)
        return out

    return log10


def coded(text, depth):
    """(preceding bytes, nearest first; byte) of each byte of a text's words and of its end."""
    data = [255] * depth + list(b"".join(w + b" " for w in text.encode().lower().split())) + [255]
    return [(tuple(data[i - depth : i][::-1]), data[i]) for i in range(depth, len(data))]


CORPUS = ["abracadabra abracadabra", "the cat sat on the mat and the dog sat on the cat", "", "\u00e9t\u00e9 123 abra", "the the the", "a cat", "zz\x00 top abra cat", "sat on a mat", None, "the dog ate the mat"]


@pytest.mark.parametrize(("depth", "split"), [(1, 1), (2, 2), (3, 1), (4, 2), (6, 2), (6, 3)])
def test_tree_probabilities_are_those_of_the_recursion(spark, depth, split, monkeypatch):
    """Each gram of trained and of other texts, from the definition; subtrees are cut after every few grams."""
    known = [x for t in CORPUS[:5] for x in coded(t or "", depth)]
    others = [x for t in CORPUS for x in coded(t or "", depth)]
    log10, n, m = recursion(known, depth), collections.Counter(known), collections.Counter(others)

    def number(gram):
        return int.from_bytes(bytes(gram[0]), "big") << 8 | gram[1]

    monkeypatch.setattr(ctw, "STEP", 7)
    rows = spark.createDataFrame([(number(g), n[g], m[g]) for g in m], "gram long, n long, m long")
    found = {r["gram"]: (r["m"], r["log10"]) for r in ctw.probabilities(rows, depth, split).collect()}
    assert len(found) == len(m)
    for g in m:
        assert found[number(g)] == (m[g], pytest.approx(log10(*g), abs=1e-9))


@pytest.mark.parametrize("frequent", [1 << 16, 5])
def test_scores_are_those_of_the_whole_tree(spark, frequent):
    """All contexts count, whether a gram is among the broadcast ones or joined."""
    texts = [(i, CORPUS[i % len(CORPUS)]) for i in range(40)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    log10 = recursion([x for i, t in texts if not held(i) for x in coded(t or "", 6)], 6)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r for r in ctw.score(docs, frequent_words=frequent, frequent_grams=frequent).collect()}
    for i, t in texts:
        grams = coded(t or "", 6)
        assert found[i]["score"] == pytest.approx(sum(log10(*g) for g in grams), rel=1e-5)
        assert found[i]["bits_per_byte"] == pytest.approx(-found[i]["score"] * math.log2(10) / len(grams))


def test_no_context_is_left_out(spark):
    """Over 32,768 contexts of a depth, each seen twice: the longest context decides, so none has been merged."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(9000)]
    docs = spark.createDataFrame([(i, " ".join(words[a : a + 100])) for i, a in enumerate([*range(0, 9000, 100)] * 2)], "doc_id long, text string")
    trained = sorted({int(g) for i, a in enumerate([*range(0, 9000, 100)] * 2) if zlib.crc32(str(i).encode()) % 7 != 2 for g in ctw.grams_of(pa.array([" ".join(words[a : a + 100])], pa.large_string()), 6)[0]})
    assert len({g >> 8 for g in trained}) > 32_768
    grams = ctw.count_grams(docs.select(ctw.held_out_column(docs.doc_id).alias("held_out"), docs.text.alias("_text")), 6)
    assert sorted(r["gram"] for r in grams.filter("n > 0").collect()) == trained
    assert ctw.probabilities(grams, 6).count() == grams.count()


def test_grams_are_merged_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    parts = []
    for n in (400_000, 30_000, 1, 30_000):
        found, m = np.unique(np.concatenate([rng.integers(0, 1 << 56, n), parts[0][0][: n // 2] if parts else []]).astype(np.int64), return_counts=True)
        parts.append((found, m.astype(np.int32), (2 * m).astype(np.int32)))
    whole = ctw._summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    out = [np.concatenate(x) for x in zip(*ctw.merged_parts(parts), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, out, strict=True))
    assert [len(x) for x in ctw.merged_parts(parts[2:3])] == [3] and not list(ctw.merged_parts([])) and not list(ctw.merged_parts([tuple(x[:0] for x in parts[0])]))
    tracemalloc.start()
    for _ in ctw.merged_parts(parts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in whole)  # merging all at once takes several times that


def test_coded_bytes():
    data, ends = ctw.coded_bytes(pa.array(["  Ab\tC\n", "", " ", "x"], pa.large_string()))
    assert bytes(data) == b"ab c x " and ends.tolist() == [0, 5, 5, 5, 7]


@given(st.text(max_size=200), st.text(max_size=200))
@settings(max_examples=60, deadline=None)
def test_phrases(a, b):
    known, ends, rest = lzprint.parse(a)
    cut = [a[x:y] for x, y in itertools.pairwise([0, *ends])]
    assert "".join(cut) + rest == a and len(set(cut)) == len(cut) and set(cut) == known
    hashes = lzprint.phrase_hashes(a, ends)
    assert len(set(hashes.tolist())) == len(cut)
    edited, x, y = lzprint.edited_pair(a, b)
    assert (x == lzprint.fingerprint(a)).all() and (y == lzprint.fingerprint(edited)).all()
    assert lzprint.likeness(x, x) == 1 and 0 <= lzprint.likeness(x, y) <= 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_set_of_near_words():
    terms, rng = ["idiot", "trash", "moron", "scum"], random.Random(1)
    machine = toxicity.intersect(terms, 5, ["foul"])
    words = ["".join(rng.choice("idiotrashmncu") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    words += [t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for j in (i, i + 1) for c in ("", "x", "o")] + ["foul", "foulest", "fou", "foulnessfoulness"]
    found, edits = machine.read(words)
    for w, t, e in zip(words, found.tolist(), edits.tolist(), strict=True):
        if w.startswith("foul"):
            assert (t, e) == (4, 0)
            continue
        best = min((edit_distance(w, x), i) for i, x in enumerate(terms) if edit_distance(w, x) <= (len(x) >= 5)) if any(edit_distance(w, x) <= (len(x) >= 5) for x in terms) else None
        assert (t, e) == ((best[1], best[0]) if best else (-1, 0)), w


def test_quotation_counts_less():
    words = 'he said "you idiot" to them'.split()
    assert toxicity.quoted(words, 3) and not toxicity.quoted("you are an idiot and a fool".split(), 3)
    assert toxicity.folded("1d!0t") == "idiot" and toxicity.folded("123") == "123" and toxicity.bare('"Idiot!,') == "idiot"


@pytest.mark.parametrize(
    ("expression", "names", "needed", "free"),
    [
        ("MIT", {"mit"}, {"mit"}, True),
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, set(), True),
        ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, {"mit", "gpl-3.0-only"}, False),
        ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0 with classpath-exception-2.0"}, {"gpl-2.0 with classpath-exception-2.0"}, False),
        ("MIT OR Apache-2.0 AND GPL-2.0", {"mit", "apache-2.0", "gpl-2.0"}, set(), True),
        ("(MIT OR Apache-2.0) AND GPL-2.0", {"mit", "apache-2.0", "gpl-2.0"}, {"gpl-2.0"}, False),
    ],
)
def test_expressions(expression, names, needed, free):
    assert licences.evaluate(expression) == (names, needed, free)


@pytest.mark.parametrize("bad", ["", "AND", "MIT AND", "MIT Apache", "(MIT", "MIT)", "()", "MIT (ISC)", "MIT, ISC"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        licences.postfix(bad)


def test_tags_and_phrases():
    s = licences.scan("x SPDX-License-Identifier: (MIT or ISC) and BSD-2-Clause\nThen CC-BY 4.0; not ACC BY.")
    assert (s.n_base, s.first_word, s.last_word, s.base_labels) == (1, 12, 12, {"cc-by"}) and s.labels == {"mit", "isc", "bsd-2-clause", "cc-by", "cc-by-4.0"}
    assert s.required == {"bsd-2-clause", "cc-by", "cc-by-4.0"} and s.permissive and s.n_words == 19 and set(s.places) == {(12, "cc-by"), (12, "cc-by-4.0")}
    assert licences.scan("")[:4] == (0, 0, None, None) and licences.scan("").permissive is None
    assert licences.scan("Released under GPL v3.").labels == {"gpl", "gpl-3.0", "notice"} and licences.scan("under the MIT License").labels == {"mit"}


def test_operators_change_the_row():
    rows = {x: licences.scan(f"License-Expression: {x}") for x in ("MIT", "GPL-3.0", "MIT OR GPL-3.0", "MIT AND GPL-3.0", "GPL-3.0 WITH Classpath", "MIT OR", "MIT MIT")}
    seen = {x: (",".join(sorted(s.labels)), ",".join(sorted(s.required)), s.permissive, s.score) for x, s in rows.items()}
    assert seen == {
        "MIT": ("mit", "mit", True, 0.5),
        "GPL-3.0": ("gpl-3.0", "gpl-3.0", False, 0.5),
        "MIT OR GPL-3.0": ("gpl-3.0,mit", "", True, 0.5),
        "MIT AND GPL-3.0": ("gpl-3.0,mit", "gpl-3.0,mit", False, 0.75),
        "GPL-3.0 WITH Classpath": ("gpl-3.0 with classpath", "gpl-3.0 with classpath", False, 0.5),
        "MIT OR": ("mit", "mit", True, 0.5),  # the expression ends where it stops making sense
        "MIT MIT": ("mit", "mit", True, 0.5),
    }
    bad = licences.scan("License-Expression: (MIT OR ISC")
    assert bad.labels == {"unparsed", "mit", "isc"} and bad.required == {"unparsed"} and bad.permissive is None
    both = licences.scan("license-expression: MIT\nlicense-expression: GPL-2.0 or ISC\n")
    assert both.required == {"mit"} and both.permissive and both.expressions == 2


@given(st.recursive(st.sampled_from(["mit", "gpl-2.0", "isc", "apache-2.0", "agpl-3.0"]), lambda x: st.tuples(st.sampled_from(["and", "or"]), x, x), max_leaves=7))
@settings(max_examples=80, deadline=None)
def test_evaluation_is_that_of_all_choices(tree):
    """Against the list of all ways to comply: each is the set of licences accepted."""

    def choices(x):
        if isinstance(x, str):
            return [frozenset([x])]
        a, b = choices(x[1]), choices(x[2])
        return [p | q for p in a for q in b] if x[0] == "and" else a + b

    def said(x):
        return x if isinstance(x, str) else f"({said(x[1])} {x[0].upper()} {said(x[2])})"

    ways = choices(tree)
    assert licences.evaluate(said(tree)) == (set().union(*ways), set.intersection(*map(set, ways)), any(all(n.startswith(licences.PERMISSIVE) for n in w) for w in ways))


def test_allocation_meets_the_pigeonhole():
    near = [np.array([1e-4] + [1e-3] * 16)] * 4
    for radius in range(6):
        _, chosen = simhash.allocate([16] * 4, near, 1e6, radius)
        assert sum(t + 1 for t in chosen) >= radius + 1


def test_distance_distribution():
    values = np.random.default_rng(0).integers(0, 256, 300)
    got = simhash.distance_distribution(np.bincount(values, minlength=256))
    want = np.bincount([int(a ^ b).bit_count() for a in values.tolist() for b in values.tolist()], minlength=9) / len(values) ** 2
    assert np.allclose(got, want)


def test_similar_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 30, 100)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 30, k)])).astype("<u4") for k in (0, 2, 5, 20, 60)] + [np.zeros(0, "<u4")]
    exact = [(a, b) for a in range(len(sets)) for b in range(a) if len(set(sets[a]) | set(sets[b])) and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    label = simhash.similar(sets, 0.8, 64)
    for a in range(len(sets)):
        for b in range(a):
            assert ((a, b) not in exact) or label[a] == label[b]
    assert label[5] == 5 and label[4] == 4


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=4000) < 0.02)).astype(float)
    model = gam.boost(x[:3000], y[:3000])
    assert (0, 1) in model.grids
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85


def test_features_of_slices_are_those_of_single_texts():
    texts = ["", "Abc def!! 12%%% x", "é è", "A" * 300, "a | b\nc"]
    whole = gam.features(pa.array(texts))
    assert np.allclose(whole, np.vstack([gam.features(pa.array([t])) for t in texts]))


def sharded(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = kdshard.shard(docs, **options).toPandas().sort_values("doc_id").reset_index(drop=True)
    found["text"], found["source"] = [r[1] for r in rows], [r[3] for r in rows]
    return found


def test_shards_are_balanced_and_copies_stay_together(spark):
    """Copies up to 0.4 of a shard, one group of a third of all rows, and long texts beside short ones."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    texts = [" ".join(word() for _ in range(int(rng.expovariate(1 / 60)) + 1)) for _ in range(2600)] + [" ".join(word() for _ in range(500)) for _ in range(20)]
    for copies in (2, 3, 5, 9, 17, 30):
        texts += [t for _ in range(6) for t in [" ".join(word() for _ in range(40))] for _ in range(copies)]
    texts += ["one text that a third of all rows hold " * 3] * (len(texts) // 2)
    found = sharded(spark, [(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts)], shards=20)
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 20 and sizes.max() / sizes.mean() < 1.01 and sizes.min() / sizes.mean() > 0.99
    for text, g in found.groupby("text"):
        if g["size"].sum() <= 0.5 * sizes.mean():
            assert g["shard"].nunique() == 1, len(g)
    assert found[found.text == texts[-1]]["shard"].nunique() >= 3  # it holds over two shards
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


@pytest.mark.parametrize("limit", [kdshard.BROADCAST_BYTES, 0])
def test_shards_tell_values_apart_behind_their_beginning(spark, monkeypatch, limit):
    """Two sources that differ after byte 5 only, with nothing else to cut by, whether ranks are broadcast or joined."""
    monkeypatch.setattr(kdshard, "BROADCAST_BYTES", limit)
    rows = [(i, f"{i:04d}", None, "https://one.example" if i % 2 else "https://two.example") for i in range(400)]
    found = sharded(spark, rows, shards=2)
    assert found.groupby("source")["shard"].nunique().tolist() == [1, 1] and found["shard"].nunique() == 2


@given(st.lists(st.integers(1, 400), max_size=40), st.integers(0, 3000), st.integers(2, 9))
@settings(max_examples=60, deadline=None)
def test_large_atoms_of_a_node_leave_room_for_small_ones(sizes, small, shards):
    atoms = [kdshard.Atom(i, i, n, [float(i)], i) for i, n in enumerate(sizes)]
    total = sum(sizes) + small
    node = kdshard.Node(0, shards, 0, 0.0, max(len(sizes) - 1.0, 0.0))
    node.goal, node.small = total * node.left / shards, small
    left = kdshard.divided(atoms, node, {0: small} if small else {}, total)
    assert left == sum(x.size for x in atoms if x.shard == 0) and {x.shard for x in atoms} <= {0, node.left}
    if small >= 2 * max(sizes, default=0):
        assert node.goal - small - 1e-9 <= left <= node.goal + 1e-9


def test_damaged_and_unusual_containers():
    nested = b""
    for _ in range(2000):
        nested = isomedia.box(b"moov", nested)
    assert "nested" in isomedia.probe(nested).error
    media = bytearray(isomedia.write(bytes(64)))
    at = media.index(b"stsz")
    media[at + 8 : at + 16] = (64).to_bytes(4) + (2**32 - 16).to_bytes(4)
    assert "more than the file" in isomedia.probe(bytes(media)).error
    assert "fragmented" in isomedia.probe(isomedia.write(bytes(64)) + isomedia.box(b"moof")).error
    rng = random.Random(9)
    whole = isomedia.write(bytes(range(256)) * 4)
    for _ in range(400):  # never an exception
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad) - 1024)] = rng.randrange(256)
        found = isomedia.probe(bytes(bad))
        assert found.error or found.tracks is not None
        isomedia.feature(found)


def test_chains_need_few_rounds(spark):
    from prosegauge.llm.graph import components

    edges = [(i, i + 1) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(0, 20, 2)] + [(5000, 5000 + k) for k in range(1, 50)] + [(7, 7)]
    rounds = []
    found = collections.defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long"), rounds).collect():
        found[r["root"]].add(r["node"])
    assert rounds[0] < 20
    assert sorted(map(sorted, found.values())) == sorted([list(range(401)), *[[1000 + i, 1001 + i] for i in range(0, 20, 2)], list(range(5000, 5050))])


def test_a_hot_key_is_broadcast(spark):
    from prosegauge.llm.common import keyed_join

    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(6000)], "i long, k long")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(6000)], "k long, f string")
    found = keyed_join(rows, facts, "k").collect()
    assert sorted((r["i"], r["f"]) for r in found) == [(i, "f1" if i % 2 else f"f{i}") for i in range(6000)]
