"""The pipeline on odd rows and as a whole, and forms that a second, plain reader understands."""

import glob
import hashlib
import json
import struct
import zlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from prosegauge import storage
from prosegauge.llm import isomedia, lzprint
from prosegauge.llm.queries import tokenizer_path

LABELS = [(1, 1, 0), (2, 1, 0), (6, 1, 1), (7, 0, 0), (8, 1, 0), (None, 1, 1), (11, None, None)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_stages_write_small_row_groups(spark, folder):
    """A task of the next stage holds whole row groups, so a stage's output has none that grows with the input."""
    rows = [(i, hashlib.shake_256(b"%d" % i).hexdigest(20_000), "en", "s", 40_000) for i in range(600)]
    sf_dir = folder(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = f"{sf_dir}/out"
    corpus_pipeline.toxicity_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), sf_dir).write.parquet(out)
    groups = [meta.row_group(i) for meta in map(pq.read_metadata, glob.glob(f"{out}/*.parquet")) for i in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 600
    assert max(g.total_byte_size for g in groups) <= 2 * storage.GROUP_BYTES


def test_run_on_odd_rows(spark, folder, odd):
    """Nulls, empty and long texts, copies and repeated rows, through all stages; labels of both classes."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], 1) for r in odd.collect()]
    sf_dir = folder(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == COLUMNS, name
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(pieces[0].asDict()) and all(p["length"] <= 2048 for p in pieces)
    # copies 1 and 2: one of them; the repeated row 9: once
    ids = {p["doc_id"] for p in pieces}
    assert not {1, 2} <= ids


def test_run_on_an_empty_table(spark, folder):
    sf_dir = folder([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_stages_keep_other_columns(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, node long, key string, _text string, score double, copies int"
    rows = [(i, f"some quiet words about the river number {i} " * 5, "en", "a", 9, 5, 6, "k", "x", 0.5, 7) for i in range(20)]
    sf_dir = folder(rows, schema)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        assert all(tuple(r)[4:] == rows[0][4:] for r in docs.collect()), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() > 0 and tokenizer_path()


TEXTS = ["", "abc", "x" * 64, "Ünïcode ✓ " * 500, "line\n" * 3000]


def boxes(data):
    """Kind and body of each box, one after another."""
    at = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + size], at + 8
        at += size


def test_stored_media_by_a_second_reader(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    media = isomedia.media_column(docs)
    digests = {r["doc_id"]: r for r in isomedia.media_digest(media).collect()}
    for r in media.collect():
        data, raw, d = bytes(r["media"]), TEXTS[r["doc_id"]].encode(), digests[r["doc_id"]]
        body = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        top = {kind: (inner, at) for kind, inner, at in boxes(data)}
        assert list(top) == [b"ftyp", b"moov", b"mdat"] and top[b"mdat"][0] == body
        inner = top[b"moov"][0]
        for kind in (b"trak", b"mdia", b"minf", b"stbl"):
            inner = next(x for k, x, _ in boxes(inner) if k == kind)
        tables = {k: x for k, x, _ in boxes(inner)}
        assert struct.unpack(">II", tables[b"stsz"][4:12]) == (64, len(body) // 64) and tables[b"stsd"][12:16] == b"raw "
        chunks = struct.unpack(">I", tables[b"stco"][4:8])[0]
        offsets = struct.unpack(f">{chunks}I", tables[b"stco"][8:])
        assert offsets[0] == top[b"mdat"][1] and data[offsets[-1] : offsets[-1] + 64] == body[(chunks - 1) * 4096 : (chunks - 1) * 4096 + 64]
        assert (d["media_bytes"], d["media_sha256"], d["payload_sha256"], d["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        told = json.loads(d["feature"])
        assert (told["codec"], told["duration"], told["samples"]) == ("raw ", len(body), len(body) // 64)
        assert told["keyframes"] == [[a, min(a + 4096, top[b"mdat"][1] + len(body))] for a in offsets]


def plain_fingerprint(text):
    """LZ78 phrases, hashed one by one with whole numbers."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    phrases, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in phrases:
            end += 1
        if end <= len(text):
            phrases.add(text[at:end])
        at = end
    lanes = [0] * 128
    for p in phrases:
        h = mix(sum(mix(ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(p)) & m)
        value = (h >> 20) % 65535 + 1
        lanes[h >> 57] = min(lanes[h >> 57] or value, value)
    return "".join(f"{x:04x}" for x in lanes), {h for h in phrases}


def test_fingerprints_by_a_second_parser(spark):
    texts = [*TEXTS, "abababababab", "the cat sat on the mat " * 30, "😀😀😀"]
    found = {r["doc_id"]: r["fingerprint"] for r in lzprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == plain_fingerprint(t)[0], i


def test_likeness_is_an_estimate_of_shared_phrases():
    a = " ".join(f"word{i % 57} and{i % 31}" for i in range(3000))
    b = a[: len(a) * 3 // 4] + " ".join(f"other{i % 41}" for i in range(900))
    x, y = plain_fingerprint(a)[1], plain_fingerprint(b)[1]
    got = lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b))
    assert abs(got - len(x & y) / len(x | y)) < 0.15
