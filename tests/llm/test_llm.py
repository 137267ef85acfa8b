"""The operators on small tables with nulls, empties, ties and repeats, each against a plain version of its contract."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import decontam, html_layout, maxent, minhash, orc_tokens, packing, pii, superkmer, tiff, tokens, toxicity, words
from quillon.llm.common import work_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("w30", "other").upper()),
    (4, None),
    (5, ""),
    (6, "two words"),
    (7, "Two\tWORDS"),
    (8, " \n "),
    (9, "x" + " y" * 300),
    (10, BASE + " " + " ".join(f"z{i}" for i in range(50))),
    (11, "Ünïcode ÉÈ w1 w2 ß　z " * 12),
    (12, "call +1 (171) 555-2028 or a.b@c-d.example.com, 1.2.3.4.5 and 4111 1111 1111 1111; again 4111111111111111 'tis " * 3),
    (6, "two words"),
    (None, "no id at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), i, i) for i, t in TEXTS]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, shared bigint, bands bigint"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower_words(text):
    return SPACED.findall((text or "").translate(LOWER))


def test_tokens_equal_the_library():
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    coder = tokens.Encoder()
    for _, text in [*TEXTS, (0, "a<|endoftext|>b"), (0, "日本 x\x1c y z  \n\n q"), (0, "don't  we'll\t\tstop 12ab³¼")]:
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_op3_packs_every_id_once(spark, docs, none):
    rows = packing.pack_documents(docs, capacity=64, max_open=3).collect()
    coder = tokens.Encoder()
    want = collections.Counter((i, coder.encode(t) + (1).to_bytes(4, "little")) for i, t in TEXTS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        total = sum(r.length for r in own)
        assert total == 64 or total & (total - 1) == 0
    pieces = collections.defaultdict(bytes)
    twice = {i for i, n in collections.Counter(i for i, _ in TEXTS).items() if n > 1}
    for r in sorted(rows, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id] += bytes(r.ids)
    for (i, ids), n in want.items():
        assert i in twice or (n == 1 and pieces[i] == ids)
    assert packing.pack_documents(none).count() == 0


def test_op3_sum_of_squares_choice():
    packer = packing.SumOfSquares(10)
    list(packer.add(1, b"\0" * 12))
    list(packer.add(2, b"\0" * 12))
    assert packer.count[6] == 1  # moving the window at 3 leaves one square, a second window would leave two at one level
    assert packer.level_for(3) == 6 and packer.level_for(4) == 6 and packer.level_for(5) == 0
    assert [sum(len(p[2]) for p in w) // 4 for w in packer.close()] == [4, 2]


def test_op3_goes_on_with_the_rule_when_windows_are_closed():
    r = np.random.default_rng(0)
    packer, out = packing.SumOfSquares(64, max_open=8), []
    sizes = r.integers(1, 64, 500).tolist()
    for i, n in enumerate(sizes):
        out += packer.add(i, bytes(4 * n))
        assert packer.n_open == sum(map(len, packer.at)) == packer.count.sum() <= 8
    out += packer.close()
    assert packer.n_open == 0 and sum(len(p[2]) // 4 for w in out for p in w) == sum(sizes)
    totals = [sum(len(p[2]) // 4 for p in w) for w in out]
    assert all(t == 64 or t & (t - 1) == 0 for t in totals)


def test_op9_round_trip(spark, docs, none):
    path = work_path(spark, "test-orc")
    orc_tokens.write_tokens(docs, path)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32): r.start for r in orc_tokens.token_digest(spark, path).collect()}
    coder, before, want = tokens.Encoder(), 0, {}
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = coder.encode(t) + bytes(4)
        want.setdefault((i, len(ids) // 4, zlib.crc32(ids)), before)
        before += len(ids) // 4
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want if k[0] != 6)
    plan = orc_tokens.read_tokens(spark, path).where("doc_id = 9")
    assert plan.count() == 1 and "EqualTo(doc_id,9)" in plan._jdf.queryExecution().toString()
    # Row groups that can't hold a document are not read: first by their bounds, then, between them, by the Bloom filter.
    many = work_path(spark, "test-orc")
    orc_tokens.write_tokens(spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1), many)
    for wanted, found in ((20_000, 1), (20_001, 0)):
        search = orc_tokens.read_tokens(spark, many).where(f"doc_id = {wanted}")
        plan = search._jdf.queryExecution()
        assert plan.executedPlan().executeCollect().__len__() == found
        scan = plan.executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() <= orc_tokens.INDEX_ROWS * found
    empty = work_path(spark, "test-orc")
    orc_tokens.write_tokens(none, empty)
    assert orc_tokens.token_digest(spark, empty).count() == 0


def test_op5_components(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    sets = {}
    for i, t in TEXTS:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}
    for a in sorted(ids):
        for b in sorted(ids):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root = min(parent[a], parent[b])
                old = {parent[a], parent[b]}
                parent = {k: root if v in old else v for k, v in parent.items()}
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), parent[i], parent[i] == i) for i in ids}
    assert got[None] == (1, None, True)
    assert minhash.near_duplicates(none).count() == 0


def test_op5_band_blocks_find_links_that_the_leader_misses(spark):
    # Each text is near the next one only, so no leader links them all.
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[20 * i : 20 * i + 200])) for i in range(8)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got.values()) == {0}


def test_op8_windows(spark, docs, none):
    own = [(i, t) for i, t in TEXTS] + [(20, "start " + BASE), (21, "q " * 40)]
    table = spark.createDataFrame(own, "doc_id bigint, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in superkmer.without_repeats(table).collect())
    split = [SPACED.findall(t or "") for _, t in own]
    count = collections.Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    want = collections.Counter()
    for (i, _), w in zip(own, split, strict=True):
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    assert got == want
    assert superkmer.without_repeats(none).count() == 0


def test_op10_hits(spark, docs, none):
    items = [(1, " ".join(f"W{i}" for i in range(20, 40))), (2, "Two-words"), (3, "nowhere to be found"), (4, None), (5, "..."), (6, "z1 z2 z3 z4 z5 z6 z7 z8 z9"), (None, "two words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(t):
        return word.findall((t or "").translate(LOWER))

    want = set()
    for i, t in TEXTS:
        w, hit, ids = cut(t), set(), set()
        for item, it in items:
            v = cut(it)
            n = min(8, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v and item is not None else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        want.add((i, len(w), len(hit), tuple(sorted(ids))))
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontam.find_hits(docs, bench).collect()}
    assert got == want
    assert decontam.find_hits(none, bench).count() == 0
    assert {r.n_hit for r in decontam.find_hits(docs, bench.limit(0)).collect()} == {0}


def test_op1_base_and_added_spans(spark, docs, none):
    field = pii.fit(docs)
    found = pii.find_spans(docs, field).withColumn("clean", pii.redact(F.col("text"), F.col("spans")))
    got = {r.doc_id: r for r in found.collect()}
    assert got[4].spans == [] and got[4].clean is None and got[5].clean == ""
    text = dict(TEXTS)[12]
    kinds = [(pii.KINDS[s.kind], text[s.start : s.end]) for s in got[12].spans if not s.added]
    assert kinds == [("email", "a.b@c-d.example.com")] * 3 + [("ip", "1.2.3.4")] * 3 + [("card", "4111 1111 1111 1111"), ("card", "4111111111111111")] * 3 + [("phone", "+1 (171) 555-2028")] * 3
    assert "555" not in got[12].clean and got[12].clean.count("[CARD]") == 6
    assert pii.find_spans(none, field).count() == 0


def test_op1_skip_factors_carry_a_label():
    like, unlike = math.log(4), math.log(0.3)
    pairs = [[like if i == j else unlike for j in range(5)] for i in range(5)]
    field = pii.Field({"9": [math.log(x) for x in (0.6, 0.1, 0.1, 0.1, 0.1)]}, [math.log(0.2)] * 5, [pairs, pairs])
    p = pii.marginals(field, ["9", "9", "9"], np.array([4, 0, 0]), np.array([[0, 1, 1]]))
    assert p[0, 4] > 0.99 and p[1, 4] > p[2, 4]


def test_op2_decodes_and_scores(spark, docs, none):
    kinds = ["a rest", "an idiot", "the others", "a", "the rest", "a moron", "an other", "others"]
    train = spark.createDataFrame([(i, kinds[i % 8]) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    scorer = toxicity.fit(train, labels)
    tests = spark.createDataFrame([(1, "an 1d10t"), (2, "an i d i o t"), (3, "an iiiidiot"), (4, "a rest"), (5, None), (6, ""), (7, "m0r0n!")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(tests, scorer).collect()}
    assert all(got[i] > 0.5 for i in (1, 2, 3, 7)) and all(got[i] < 0.5 for i in (4, 5, 6))
    assert toxicity.score(none, scorer).count() == 0
    silent = toxicity.fit(train, labels.limit(0))
    assert {r.score for r in toxicity.score(tests, silent).collect()} == {0.0}


def test_op2_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    scored = toxicity.op2_noisy_channel_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 3000, bytes(range(256)) * 40, b"\0" * 5000, np.random.default_rng(1).bytes(20_000)])
def test_op4_codecs(data):
    assert tiff.unlzw(tiff.lzw(data)) == data and tiff.unpackbits(tiff.packbits(data)) == data


def test_op4_files(spark, docs, none):
    for r in tiff.media_digest(tiff.write_media(docs)).collect():
        if r.doc_id not in (6, None):
            payload = tiff.payload_of((dict(TEXTS)[r.doc_id] or "").encode())
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    long = tiff.write_tiff(tiff.payload_of(np.random.default_rng(2).bytes(100_000)))
    media = spark.createDataFrame([(1, long), (2, long[:-30]), (3, b"II*\0\x08\0\0\0\0\0\x08\0\0\0"), (4, None), (5, b"x")], "doc_id bigint, media binary")
    rows = tiff.read_pages(media).collect()
    assert [r.page for r in rows if r.doc_id == 1] == [0, 1, 2] and not any(r.error for r in rows if r.doc_id == 1)
    assert all([r.error for r in rows if r.doc_id == i][-1] for i in (2, 3, 5)) and not [r for r in rows if r.doc_id == 4]
    assert tiff.read_pages(media.limit(0)).count() == 0 and tiff.media_digest(tiff.write_media(none)).count() == 0


def test_op6_layout(spark):
    page = """<title>t</title><style>.ad{display:none}</style><p>one<p>two <b>x</b><ul><li>a<li>b<ol><li>c<li value=5>d</ol></ul>
    <div class=ad>no</div><div hidden>no</div><span style='visibility:hidden'>no<i style="visibility:visible">yes</i></span>
    <table><tr><th>Name<th>N<tr><td>apple<td>1</table><pre>  k
 l</pre>a < b &amp; c"""
    want = "one\n\ntwo x\n\n- a\n- b\n  1. c\n  5. d\n\nyes\n\nName   N\napple  1\n\n  k\n l\n\na < b & c"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p"), (4, "<p")], "page_id bigint, html string")
    assert [(r.page_id, r.text) for r in html_layout.visible_text(df).orderBy("page_id").collect()] == [(1, want), (2, ""), (3, ""), (4, ""), (4, "")]
    assert html_layout.visible_text(df.limit(0)).count() == 0
    assert html_layout.render("<div>" * 20_000 + "x").strip() == "x"


def test_op7_base_and_model(spark, docs, none):
    count = collections.Counter()
    for i, t in TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*lower_words(t), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in TEXTS:
        w = [*lower_words(t), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(x in count for x in w), n, round(base, 6)] += 1
    rows = maxent.scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert maxent.scores(none).count() == 0


def test_hashes_see_words_and_not_their_neighbours():
    import pyarrow as pa

    a = words.Words(*words.utf8(pa.array(["b c", None, " a  b", "cb"])), lower=True)
    h = a.hashes().tolist()
    assert len(h) == 5 and h[0] == h[3] and len(set(h)) == 4 and np.diff(a.first).tolist() == [2, 0, 2, 1]
