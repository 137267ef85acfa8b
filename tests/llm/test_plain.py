"""Operators against plain versions, exhaustive searches and damaged input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam, html_layout, minhash, pii, superkmer, tiff, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * 2 if i % 2 else int(c)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) < 4000 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_op1_base_spans_equal_the_patterns():
    r = random.Random(3)
    parts = ["1", "22", "255", "256", ".", ".", "@", "a", "b-c", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "x.y@", "0", "00", "_", "%", "é", "٣", "\n"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_op1_columns_equal_a_plain_version(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = pii.op1_skip_chain_crf(spark, data).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 10
    for r in rows:
        base = sorted(plain_spans(texts[r.doc_id]))
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        found = [s.split(":") for s in r.spans.split(",") if s]
        assert set(listed) <= {":".join(s) for s in found} and found == sorted(found, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


@pytest.mark.parametrize("text", ["1" * 5000 + ".1.1.1", "0" * 6000 + "1.2.3.4", "1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" + "-" * 100_000, "1." * 100_000])
def test_op1_reads_long_runs(spark, text):
    began = time.perf_counter()
    got = pii.base_spans(text)
    assert time.perf_counter() - began < 5
    assert [s for s in got if s[0] == 1] == ([(1, 0, 6007)] if text.startswith("00") else [(1, a, a + 7) for a in range(0, 199_993, 8)] if text.startswith("1.1.") else [])
    field = pii.fit(spark.createDataFrame([(1, "a 1")], "doc_id bigint, text string"))
    assert pii.find_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), field).count() == 1


def test_op1_messages_give_exact_marginals_on_trees():
    rng = np.random.default_rng(4)
    pairs = [[[float(x) for x in row] for row in rng.normal(size=(5, 5))] for _ in range(2)]
    field = pii.Field({}, [float(x) for x in rng.normal(size=5)], [[[(p[i][j] + p[j][i]) / 2 for j in range(5)] for i in range(5)] for p in pairs])
    edges, labels = np.array([[0, 1, 0], [1, 2, 0], [1, 3, 1], [3, 4, 1]]), np.array([2, 0, 0, 0, 0])
    got = pii.marginals(field, ["x"] * 5, labels, edges)
    want = np.zeros((5, 5))
    for states in itertools.product(range(5), repeat=5):
        if states[0] == 2:
            p = np.exp(sum(field.unseen[s] for s in states[1:]) + sum(field.pairs[k][states[i]][states[j]] for i, j, k in edges))
            for i, s in enumerate(states):
                want[i, s] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_op2_decoder_finds_the_cheapest_path():
    rng = np.random.default_rng(5)
    decoder = toxicity.Decoder(np.log(rng.dirichlet(np.ones(64), (64, 64))).astype(np.float32))
    edge = toxicity._BOUNDARY
    for surface in ("1d10t", "a$$", "b*d", "f--o", "loool", "4ll", "h3l!0"):
        best = None
        for path in itertools.product(*(decoder.readings(surface, i) for i in range(len(surface)))):
            price, p, q = 0.0, edge, edge
            for letter, cost in path:
                price += cost
                if letter >= 0:
                    price += float(decoder.model[p, q, letter])
                    p, q = q, letter
            price += float(decoder.model[p, q, edge])
            word = "".join(toxicity._LETTERS[x] for x, _ in path if x >= 0)
            best = max(best or (price, word), (price, word))
        assert decoder.decode(surface) == best[1], surface


def test_op2_partial_counts_add_up(spark, monkeypatch):
    rows = [(i, f"word{i} shared {'bad' if i % 2 else 'good'}") for i in range(200)]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string").repartition(2)  # repeated rows are learned from once
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert {"=bad", "=good"} <= set(scorer.index)
    got = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in got)


def a_tiff(order, width, height, samples, raw, predictor=1):
    """One raw page of 8-bit samples in either byte order."""
    entries = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8] * samples), (259, 3, [1]), (277, 3, [samples]), (278, 3, [height]), (317, 3, [predictor])]
    entries += [(273, 4, [8]), (279, 4, [len(raw)])]
    extra, at = b"", 8 + len(raw)
    body = struct.pack(f"{order}H", len(entries))
    for tag, kind, values in sorted(entries):
        packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            packed, extra = struct.pack(f"{order}I", at + len(extra)), extra + packed
        body += struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at + len(extra))
    return head + raw + extra + body + bytes(4)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("samples", [1, 3])
def test_op4_reads_both_byte_orders_and_several_samples(order, samples):
    pixels = np.random.default_rng(6).integers(0, 256, (5, 7, samples)).astype(np.uint8)
    steps = np.diff(pixels, axis=1, prepend=np.zeros((5, 1, samples), np.uint8))
    for raw, predictor in ((pixels, 1), (steps, 2)):
        (page,) = tiff.read_tiff(a_tiff(order, 7, 5, samples, raw.tobytes(), predictor))
        assert (page.width, page.height, page.samples, page.pixels) == (7, 5, samples, pixels.tobytes())


def test_op4_uneven_tiles():
    rows = np.random.default_rng(7).integers(0, 4, (100, 96)).astype(np.uint8)
    for salt in range(60):  # the payload's hash picks the layout
        payload = rows.tobytes() + bytes([salt]) * 96
        pages = list(tiff.read_tiff(tiff.write_tiff(payload)))
        assert b"".join(p.pixels for p in pages) == payload
        if pages[0].tiled:
            return
    raise AssertionError("no tiled page")


def test_op4_damage_gives_rows_and_no_crash():
    rng = np.random.default_rng(8)
    sound = tiff.write_tiff(tiff.payload_of(rng.bytes(300) * 300), page_rows=64)
    for _ in range(1500):
        file = bytearray(sound)
        for at in rng.integers(0, len(file), rng.integers(1, 6)):
            file[at] = rng.integers(0, 256)
        file = bytes(file[: rng.integers(0, len(file) + 1)]) if rng.random() < 0.3 else bytes(file)
        rows = list(tiff._page_rows(1, file))
        assert rows and [r[1] for r in rows] == list(range(len(rows))) and all((r[8] is None) == (r[9] is not None) for r in rows)
    at = struct.unpack_from("<I", sound, 4)[0]
    for count in (0, 1 << 31):  # entries that claim no values, or more than there are
        file = bytearray(sound)
        for k in range(11):
            struct.pack_into("<I", file, at + 2 + 12 * k + 4, count)
        assert list(tiff._page_rows(1, bytes(file)))[0][9]


def test_op4_codecs_stop_where_a_page_is_full():
    data = bytes(100_000)
    assert len(tiff.unlzw(tiff.lzw(data), 10)) < 5000 and len(tiff.unpackbits(tiff.packbits(data), 10)) < 200
    assert len(tiff._unpack(zlib.compress(data), tiff.DEFLATE, 10)) == 10


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<blockquote>" * 5000 + "x", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<i><div>" + "</i>" * 100_000 + "x", "<ul><li>" * 20_000 + "x", "<table><tr><td>" * 5000 + "x"])
def test_op6_time_grows_with_the_page(page):
    began = time.perf_counter()
    assert html_layout.render(page).split()[-1] == "x"
    assert time.perf_counter() - began < 5


def test_op6_visible_words_of_random_pages():
    r = random.Random(9)

    def piece(depth):
        """Markup and the words of it that are seen."""
        kind = r.choice(["text", "div", "b", "p", "ul", "gone", "note", "table", "br"] if depth else ["text"])
        if kind == "text":
            words = [f"w{r.randint(0, 999)}" for _ in range(r.randint(1, 4))]
            return " " + " ".join(words) + " ", words
        if kind == "br":
            return "<br>", []
        inner = [piece(depth - 1) for _ in range(r.randint(1, 3))]
        markup, words = "".join(m for m, _ in inner), [w for _, ws in inner for w in ws]
        if kind == "gone":
            return r.choice([f"<div hidden>{markup}</div>", f"<section style='display:none'>{markup}</section>"]), []
        if kind == "note":
            return f"<!-- {r.randint(0, 9)} --><script>no</script>" + markup, words
        if kind == "ul":
            return f"<ul><li>{markup}</ul>", ["-", *words] if words else []  # an empty item has no line
        if kind == "table":
            return f"<table><tr><td>{markup}</table>", words
        return (f"<{kind}>{markup}" if kind == "p" and r.random() < 0.5 else f"<{kind}>{markup}</{kind}>"), words

    for _ in range(300):
        markup, words = piece(5)
        assert html_layout.render(markup).split() == words, markup


def test_op6_cells_keep_their_text_and_place():
    long = " ".join(f"word{i}" for i in range(40))
    got = html_layout.render(f"<table><tr><td>a<td>{long}<td>end<tr><td>b<td>short<td>tail</table>", widest=30).split("\n")
    assert all(len(line) <= 3 + 30 + 2 + 4 for line in got) and " ".join(line[3:33].strip() for line in got[:-1]) == long
    assert got[0].endswith("end") and got[-1].index("tail") == got[0].index("end")


def test_op8_passes_over_a_large_bucket_change_nothing(monkeypatch):
    r = random.Random(10)
    shared = [f"s{i}" for i in range(60)]
    rows = [" ".join([*(f"x{r.randint(0, 99)}" for _ in range(20)), *shared[k % 9 :], *(f"y{r.randint(0, 99)}" for _ in range(20))]) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(range(100, 130), pa.int64()), pa.array(rows)], ["id", "text_hash", "text"])
    group = pa.Table.from_batches([b for k in range(0, 30, 3) for b in superkmer._packer(np.zeros(0, np.uint64), 1)(iter([batch.slice(k, 3)]))])

    def gone():
        out = collections.defaultdict(set)
        for x in superkmer._count(group).to_pylist():
            out[x["id"], x["text_hash"]].update(range(x["start"], x["stop"]))
        return out

    want = gone()
    monkeypatch.setattr(superkmer, "PASS_BYTES", 500)
    assert len(want) == 30 and gone() == want


def test_op8_work_of_a_slice_does_not_grow_with_the_buckets():
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([" ".join(f"w{i}" for i in range(100))])], ["id", "text_hash", "text"])
    assert len(list(superkmer._packer(np.zeros(0, np.uint64), 2_000_000_000)(iter([batch])))) == 1


def test_op10_both_ways_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words))] * 3 + [(2, "short one"), (None, " ".join(words[:9])), (3, None), (4, " ".join(["a", *words] * 600))], "doc_id bigint, text string")
    docs = docs.withColumn("at", F.lit("x")).withColumn("ws", F.lit(1)).withColumn("items", F.lit(2.5)).withColumn("key", F.lit(None).cast("string"))
    bench = spark.createDataFrame([(1, " ".join(words[5:20])), (2, " ".join(words[5:20])), (3, "short"), (4, " ".join(words[30:38]))], "item_id bigint, text string")
    rows = [sorted(map(str, decontam.find_hits(docs, bench, limit).drop("text_hash").collect())) for limit in (decontam.BROADCAST_BYTES, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 7
    assert rows[0].count("Row(doc_id=1, n_words=40, n_hit=23, item_ids=['1', '2', '4'])") == 3


def test_op5_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(11)
    for share in (0.3, 0.6, 0.8):
        n = 4000
        both = int(2 * n * share / (1 + share))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both).astype(np.uint64) * np.uint64(2)])
        x, y = minhash.packed(minhash.minima(np.concatenate([a, b]), np.array([0, n, 2 * n])))
        apart = sum(bin(int((v | v >> 1) & minhash._LOW)).count("1") for v in (int(p) ^ int(q) for p, q in zip(x, y, strict=True)))
        assert abs(minhash.estimate(minhash.ROWS - apart, minhash.ROWS) - both / (2 * n - both)) < 0.07


def test_stages_pass_clashing_columns_on(spark):
    names = ["_id", "_hash", "spans", "toxicity", "found", "gone_id", "leaked_id", "leaked_hash", "a.b", "kept", "text_hash", "Toxicity_"]
    base = spark.createDataFrame([(i, t, "en", "s", None) for i, t in [(1, "plain words a@b.example.com"), (2, None), (2, None), (None, "no id"), (3, "")]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = base.select("*", *[F.lit(k).cast("bigint").alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == [*base.columns, *names], name
        assert {tuple(r[5:]) for r in docs.collect()} == {tuple(range(len(names)))} and docs.count() == 5
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {1, 2, 3, None}


def test_whole_long_texts(spark):
    """Texts of 300,000 words go through every operator whole."""
    words = [f"w{i % 7919}" for i in range(300_000)]
    text = " ".join([*words, "mail", "me@long.example.com"])
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short text")], "doc_id bigint, text string")
    field = pii.fit(docs)
    assert [[(s.kind, s.end - s.start) for s in r.spans] for r in pii.find_spans(docs, field).orderBy("doc_id").collect()] == [[(0, 19)], [(0, 19)], []]
    bench = spark.createDataFrame([(1, " ".join(words[-9:]))], "item_id bigint, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit > 0) for r in decontam.find_hits(docs, bench).collect()}
    assert hits == {1: (300_005, True), 2: (300_006, True), 3: (2, False)}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in superkmer.without_repeats(docs).collect()}
    assert removed == {1: (300_002, 300_002), 2: (300_003, 300_002), 3: (2, 0)}
