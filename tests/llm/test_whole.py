"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import collections
import struct

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import html_layout, maxent, superkmer, tiff


def test_op8_copies_that_differ_inside_a_repeated_line(spark):
    rows = []
    for k in range(8):
        line = [f"k{k}w{i}" for i in range(20)]
        block = [f"head{k}", *line * 7, f"tail{k}"]
        rows += [(2 * k, " ".join(block)), (2 * k + 1, " ".join([*block[:70], f"other{k}", *block[71:]]))]
    block = [f"k0w{i}" for i in range(20)] * 3  # repeats the middle of row 0 in another batch
    rows.append((100, " ".join(["apart", *block, "end"])))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.kept) for r in superkmer.without_repeats(table).collect()}
    split = {i: t.split() for i, t in rows}
    count = collections.Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    for i, w in split.items():
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert got[i] == (len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))


def one_slice(texts, ids=None):
    """A slice's row with its counts, as training reads it, when there is no other."""
    ids = list(range(len(texts))) if ids is None else ids
    row = maxent._slice_row(0, pa.array(ids, pa.int64()), pa.array(texts, pa.string()), 7, 2).to_pylist()[0]
    block = next(maxent._blocks(1)(iter([pa.RecordBatch.from_pylist([row])])))
    rows = maxent._counts(pa.Table.from_batches([block])).to_pylist()
    return row | {"counts": [r["counts"] for r in rows if r["slice"] is not None]}, rows[-1]


def model_of(row, totals, hashed=None):
    cell_n, cell_v = np.array(totals["cell_n"]), np.array(totals["cell_v"])
    n, v = int(cell_n.sum()) + row["train_docs"], int(cell_v.sum()) + 1
    for t in totals["top"]:
        cell_n[t["cell"]] -= t["c"]
        cell_v[t["cell"]] -= 1
    return maxent.Model(n, v, row["train_docs"], [t["hash"] for t in totals["top"]], cell_n, cell_v, hashed)


def test_op7_tells_thousands_of_contexts_apart():
    rng = np.random.default_rng(0)
    text = " ".join(f"w{i}" for i in rng.permutation(40_000))
    row, totals = one_slice([text])
    model = model_of(row, totals)
    own = maxent.Slice(row, model)
    context = own.context(slice(0, 40_001))
    features = own.features(context)
    assert all(len(np.unique(f)) > 4000 for f in features) and features.max() < len(model.weights) - 1
    kind = own.kind[own.token]
    shared = kind > maxent.FREQUENT
    inner = own.inner_features(tuple(c[shared] for c in context), kind[shared])
    assert all(len(np.unique(f)) > 4000 for f in inner[:3]) and inner.max() < len(model.inner)


def test_op7_features_grow_with_the_words():
    sizes = [maxent.hashed_features(n) for n in (0, 10**6, 10**7, 10**9)]
    assert sizes == [4096, 4096, 32_768, 65_536]


def test_op7_scores_are_probabilities():
    """The chances of all words, an unknown one in every cell and the end add up to one in any context."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 200, 30)) for _ in range(9)]
    row, totals = one_slice(texts)
    model = model_of(row, totals, hashed=64)
    model.weights[:] = rng.normal(size=model.weights.shape)
    model.inner[:] = rng.normal(size=model.inner.shape)
    own = maxent.Slice(row, model)
    at = 17
    context = own.context(slice(at, at + 1))
    outer = maxent._softmax(model.weights, own.features(context), model.weights[-1])[0].astype(float)
    total = outer[maxent.FREQUENT]  # the end
    spare = np.ones((maxent.SUFFIXES, maxent.GROUPS))
    for word in np.unique(own.token[own.token < len(own.kind) - 1]):
        if own.count[word]:
            kind, group = own.kind[word], own.group[word]
            total += outer[kind] if kind < maxent.FREQUENT else 0.0
            if kind > maxent.FREQUENT:
                spare[kind - maxent.FREQUENT - 1, group] -= 10 ** own.share[word]
                inside = maxent._softmax(model.inner, own.inner_features(context, np.array([kind])))[0]
                total += outer[kind] * inside[group] * 10 ** own.share[word]
    for kind in range(maxent.FREQUENT + 1, maxent.CLASSES):
        inside = maxent._softmax(model.inner, own.inner_features(context, np.array([kind])))[0]
        total += outer[kind] * float(inside @ spare[kind - maxent.FREQUENT - 1])
    total += outer[len(totals["top"]) : maxent.FREQUENT].sum()
    assert abs(total - 1) < 1e-5 and (spare >= -1e-12).all()


def test_op7_steps_follow_the_gradient():
    """A step on weights at zero moves them as plain sums over the batch say."""
    rng = np.random.default_rng(2)
    features, wanted = rng.integers(0, 6, (2, 50)), rng.integers(0, 4, 50)
    trainer = maxent.Trainer(np.zeros((7, 4), np.float32))
    trainer.step(features, wanted, biased=True)
    want = np.zeros((7, 4))
    for rows in (*features, np.full(50, 6)):
        g = np.zeros((7, 4))
        for r, y in zip(rows, wanted, strict=True):
            g[r] += 0.25 - (np.arange(4) == y)
        want -= [maxent.STEP * x / np.sqrt(1e-2 + (x * x).mean()) if x.any() else x for x in g]
    same = np.setdiff1d(np.arange(7), np.intersect1d(*features))  # rows of both kinds take two steps
    assert np.allclose(trainer.weights[same], want[same], atol=1e-5)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<style>@media print{.nav{display:none}} @media (max-width:600px){aside{display:none}}</style><p class=nav>home<aside>more</aside>", "home\n\nmore"),
        ("<style>@media screen and (min-width:600px){.a{display:none}} .b{display:none} @font-face{src:x} #c{display:none}</style>x<i class=a>a</i><i class=b>b</i><i id=c>c</i>", "x"),
        ("<style>@import 'x'; @supports (display:grid){.a{display:none}} @media not print{@media print{.a{display:none}} .b{display:none}}</style><i class=a>a</i><i class=b>b</i>", "a"),
        ("<style>.m{display:none} @media (min-width:600px){.m{display:block}}</style><i class=m>menu</i>", "menu"),
        ("<p>for <math><mi>x</mi><mo>=</mo><semantics><mn>1</mn><annotation>tex</annotation></semantics></math> only", "for x=1 only"),
        ("<svg><title>no</title><defs><text>no</text></defs><rect/>no<g><text x=1>one <tspan>two</tspan></text><text>three</text></g></svg>after", "one two\nthree\nafter"),
        ("<svg><foreignObject><p>in</p></foreignObject><desc>no</desc></svg><svg/>b<svg><path><p>out", "in\n\nb\n\nout"),
        ("size <select><option>S<option selected>M<option>L</select> left", "size M left"),
        ("size <select><option disabled>pick<option>S<option>L</select> left", "size S left"),
        ("<select multiple><optgroup label=all><option>S<option label=large>L</select>left", "all\nS\nlarge\nleft"),
        ("<pre>" + "<b>" * 12 + "a   b\n  c" + "</b>" * 12 + "</pre>d   e", "a   b\n  c\n\nd e"),
    ],
)
def test_op6_shows_all_visible_text(page, want):
    assert html_layout.render(page) == want


def test_op4_reads_pages_after_one_that_cannot_be_decoded():
    pages = [(1, 1, b"\xa5\x80\x5a\x00"), (16, 1, bytes(36)), (4, 1, bytes(range(10))), (8, 7, b"?"), (2, 1, bytes(range(6))), (8, 1, bytes(range(18)))]
    data, link = b"II*\0" + struct.pack("<I", 0), 4
    for bits, compression, raw in pages:
        at, where = len(data), struct.pack("<I", len(data) + len(raw))
        tags = [(256, 9), (257, 2), (258, bits), (259, compression), (273, at), (277, 1), (278, 2), (279, len(raw))]
        data = data[:link] + where + data[link + 4 :] + raw + struct.pack("<H", len(tags))
        data += b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in tags)
        link = len(data)
        data += struct.pack("<I", 0)
    got = [(r[1], r[2], r[8], r[9] is not None) for r in tiff._page_rows(1, data)]

    def samples(bits, raw):
        half = [raw[: len(raw) // 2], raw[len(raw) // 2 :]]
        lines = ["".join(f"{x:08b}" for x in part) for part in half]
        return bytes(int(line[k * bits : (k + 1) * bits], 2) for line in lines for k in range(9))

    want = [(i, None, None, True) if i in (1, 3) else (i, 9, samples(bits, raw), False) for i, (bits, _, raw) in enumerate(pages)]
    assert got == want
