"""The ids that each stage of the pipeline keeps, against plain versions, on documents planted for each stage."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import pytest

BAD = ["idiot", "moron"]


def planted():
    """Documents as (doc_id, text, toxic), labels and benchmark items."""
    r = random.Random(5)
    known = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(600)]

    def prose(n):
        return [r.choice(known) for _ in range(n)]

    docs, labels = [], []
    for i in range(160):  # labelled ones, every second toxic
        w = prose(50)
        if i % 2:
            for at in (7, 23, 41):
                w[at] = BAD[i // 2 % 2]
        docs.append((i, " ".join(w), i % 2))
        labels.append((i, 1, i % 2))
    for i, word in enumerate(["1d10t", "idiot", "m0r0n", "moron"]):  # toxic ones without a label
        w = prose(50)
        w[5], w[20], w[35], w[45] = [word] * 4
        docs.append((200 + i, " ".join(w), 1))
    for i in range(10):  # near copies: a text, an equal one, one with an edited end, one edited at six places, which is apart
        w = prose(60)
        far = [x if k % 10 else "edit" for k, x in enumerate(w)]
        docs += [(300 + 10 * i + k, " ".join(x), 0) for k, x in enumerate((w, w, [*w[:-2], "new", "end"], far))]
    items = [prose(12) for _ in range(4)]
    for i, (one, two) in enumerate(itertools.combinations(range(4), 2)):  # passages of two items, of one, of one broken off after 7 words
        docs.append((500 + 10 * i, " ".join([*prose(20), *items[one][:8], *prose(20), *items[two][4:], *prose(9)]), 0))
        docs.append((501 + 10 * i, " ".join([*prose(20), *items[one], *prose(20), *items[one][:9]]), 0))
        docs.append((502 + 10 * i, " ".join([*prose(20), *items[one][:8], *prose(20), *items[two][:7], *prose(9)]), 0))
    return docs, labels, [(i + 1, " ".join(w)) for i, w in enumerate(items)]


def grams(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def one_of_each(docs):
    lead = {i: i for i in docs}

    def root(i):
        return i if lead[i] == i else root(lead[i])

    sets = {i: grams(t, 5) for i, t in docs.items()}
    for a, b in itertools.combinations(sorted(docs), 2):
        if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            lead[y] = x
    return {i: t for i, t in docs.items() if root(i) == i}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("planted")
    docs, labels, items = planted()
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in docs]
    for name, own, schema in (
        ("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", labels, "doc_id bigint, quality int, toxic int"),
        ("benchmark", items, "item_id bigint, text string"),
    ):
        spark.createDataFrame(own, schema).coalesce(2).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_each_stage_keeps_exactly_the_right_documents(spark, data):
    docs, _, items = planted()
    left = {i: t for i, t, _ in docs}
    clean = {i: t for i, t, toxic in docs if not toxic}
    single = one_of_each(clean)
    found = {i: sum(bool(grams(t, 8) & grams(item, 8)) for _, item in items) for i, t in single.items()}
    final = {i: t for i, t in single.items() if found[i] < 2}
    assert len(left) > len(clean) > len(single) > len(final) and 1 in found.values()
    assert len(clean) - len(single) == 20 and len(single) - len(final) == 6
    df = spark.read.parquet(f"{data}/documents.parquet")
    for want, (name, stage) in zip((clean, single, final, final), corpus_pipeline.STAGES, strict=False):
        df = stage(spark, df, data).cache()
        assert sorted((r.doc_id, r.text) for r in df.collect()) == sorted(want.items()), name
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == set(final)
