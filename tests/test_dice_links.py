"""Cases in which the library's own operators once did less than the whole job."""

from __future__ import annotations

from quillon.operators import identity


def test_dice_links_across_blocks(spark, tmp_path, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = " ".join(letters[i:] + letters[:i] for i in range(0, 26, 3))
    rows = [
        (1, body + " longestwordofalltexts", "en"), (2, body + " longestwordofallthetexts", "en"),  # the longest word is edited
        (3, "qzqxqjqkqvqwqyqpqm", "en"), (4, "qzqxqjqkqvqwqyqpqm a", "en"), (5, "QZQXQJQKQVQWQYQPQM a.", "de"),  # equal texts of two languages
        (6, "nopqrstuvwxyz mmm", "en"), (7, "nopqrstuvwxyz mmmm", "fr"),  # two languages
        (8, "aeaiaoauaeeieoeu ab", "en"), (9, "short", "en"), (10, None, "en"),
        (11, "bdbfbgbhbjbkblbmbnbp", "en"), (12, "bdbfbgbhbjbkblbmbnbp bdbfbgbhbjbkblbmbnbp", "en"),  # one longer than 32, one shorter
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    first = {}
    for i, text, _ in rows:
        norm = "".join(x for x in (text or "").lower() if x.isalnum() or x == " ").strip()
        flat = norm.replace(" ", "")
        if len(flat) >= 12:
            first.setdefault(norm, (i, {flat[k : k + 2] for k in range(len(flat) - 1)}))
    kept = sorted(first.values(), key=lambda x: x[0])
    dice = {(i, j): round(2 * len(a & b) / (len(a) + len(b)), 6) for i, a in kept for j, b in kept if i < j}
    want = {k: v for k, v in dice.items() if v >= 0.85}
    assert {(1, 2), (6, 7), (11, 12)} <= set(want)
    for texts, grams in ((identity.BLOCK_TEXTS, identity.BLOCK_GRAMS), (1, 50)):
        monkeypatch.setattr(identity, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(identity, "BLOCK_GRAMS", grams)
        got = {r.doc_id: (r.n_links, r.class_id) for r in identity.dice_links(spark, str(tmp_path)).collect()}
        assert got == classes(want, [i for i, _ in kept])


def classes(links, ids):
    """Number of links and smallest document of the class, by document."""
    least = {i: i for i in ids}
    for _ in ids:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return {i: (sum(i in pair for pair in links), least[i]) for i in ids}


def test_components_of_odd_tables(spark):
    from quillon.operators.components import components

    edges = [(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (8, 9), (9, 7), (7, 6)] + [(100 + i, 101 + i) for i in range(60)]
    table = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "a bigint, b bigint, p string, node int")
    got = {r.node: r.root for r in components(table).collect()}
    assert got == {2: 1, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(101, 161)}
    assert components(table.limit(0)).count() == 0
