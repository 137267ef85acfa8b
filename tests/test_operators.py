"""Order-dependent operators and rules on invented cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import folds, text, urls
from quillon.operators import layout

BOX = "page_id bigint, pos int, x1 double, y1 double, x2 double, y2 double, conf double"


def page(spark, *boxes):
    return spark.createDataFrame([(1, i + 1, *map(float, b[:4]), b[4] if len(b) > 4 else 0.9) for i, b in enumerate(boxes)], BOX)


def test_suppression_keeps_the_surest_and_ties_to_the_first(spark):
    kept = layout.suppressed(page(spark, (0, 0, 100, 100, 0.5), (5, 5, 100, 100, 0.9), (300, 0, 400, 100, 0.1), (5, 5, 100, 100, 0.9)))
    assert [r.pos for r in kept.collect()] == [2, 3]
    assert layout.suppressed(page(spark, (0, 0, 1, 1)).limit(0)).count() == 0


def test_pairs_are_settled_in_order(spark):
    pairs = [[(1, 2, 1), (1, 3, 3), (2, 3, 3)], [(1, 2, 2), (2, 3, 3)], []]
    df = spark.createDataFrame([(i, [dict(zip(("pos_a", "pos_b", "loser"), c, strict=True)) for c in own]) for i, own in enumerate(pairs)], "i int, c array<struct<pos_a:int,pos_b:int,loser:int>>")
    assert [r.g for r in df.orderBy("i").select(folds.left_over(F.col("c")).alias("g")).collect()] == [[1, 3], [2], []]


def test_reading_order_both_ways(spark):
    grid = page(spark, (0, 0, 40, 40), (60, 0, 100, 40), (0, 60, 40, 100), (60, 60, 100, 100))
    for right_to_left, want in ((True, [2, 1, 4, 3]), (False, [1, 2, 3, 4])):
        assert [r.pos for r in layout.ranked(grid, right_to_left).orderBy("rank").collect()] == want
    # A box joins the column of the first head that it overlaps; of two at one height the one nearer the reading side is first.
    band = page(spark, (50, 0, 100, 30), (0, 0, 60, 30), (70, 0, 90, 30), (0, 0, 20, 30))
    assert [r.pos for r in layout.ranked(band).orderBy("rank").collect()] == [3, 1, 2, 4]


def test_clusters_are_transitive(spark):
    rows = layout.clustered(page(spark, (0, 0, 10, 10), (30, 0, 40, 10), (60, 0, 70, 10), (500, 500, 510, 510))).orderBy("pos").collect()
    assert [r.cluster for r in rows] == [1, 1, 1, 4]


def test_urls(spark):
    cases = [
        ("http://h/es/12?utm_source=feed", "http://h/es/12?utm_source=feed", None),
        ("http://h/de/83?page=2&ref=x", "http://h/de/83?ref=x", None),
        ("http://h/en/98/", "http://h/en/98", None),
        ("http://h/a/b/chapter/9/3", "http://h/a/b/chapter/9", 3),
        ("http://h/x/12/4", "http://h/x/12", 4),
        ("http://h/x/4", "http://h/x/4", None),
        ("http://h/x7/y#7", "http://h/x7/y", 7),
        ("http://h/x/y#7", "http://h/x/y#7", None),
        ("http://h", "http://h/", None),
    ]
    df = spark.createDataFrame([(u,) for u, _, _ in cases], "url string")
    of = [urls.part(F.col("url"), p) for p in (urls.ORIGIN, urls.PATH, urls.SEARCH, urls.HASH)]
    df = df.withColumn("key", urls.chapter_key(*of)).withColumn("n", urls.page_number(*of, F.col("key")))
    assert [(r.url, r.key, r.n) for r in df.collect()] == cases


def test_next_addresses(spark):
    from quillon.functions import rules

    cases = [
        ("http://h/read/7?page=3&v=1", "http://h/read/7?page=4&v=1"),
        ("http://h/series/12/4/", "http://h/series/12/5/"),
        ("http://h/title/4", None),  # its number is the title's
        ("http://h/a/chapter/9/3", "http://h/a/chapter/9/4"),
        ("http://h/a/chapter/9", None),
        ("http://h/x7/y#7-", "http://h/x7/y#8"),
        ("http://h/x/y#7", None),
        ("http://h/x/y", None),
    ]
    df = spark.createDataFrame([(u,) for u, _ in cases], "url string")
    key = urls.chapter_key(*(urls.part(F.col("url"), p) for p in (urls.ORIGIN, urls.PATH, urls.SEARCH, urls.HASH)))
    assert [r.n for r in df.withColumn("key", key).select(rules.next_address(F.col("url"), F.col("key")).alias("n")).collect()] == [w for _, w in cases]


def test_text_rules(spark):
    df = spark.createDataFrame([("?!",), ("B",), ("Narrator",), ("Ada",), ("",), ("No readable text here",)], "t string")
    got = df.select(text.usable(F.col("t")).alias("u"), text.meta_no_text(F.col("t")).alias("m")).collect()
    assert [r.u for r in got] == [False, False, False, True, False, True]
    assert [r.m for r in got] == [False] * 5 + [True]


def test_markup_rules(spark):
    from quillon.operators import markup

    cases = [
        ('<r n="1" spk="c1">hello</r><r n="2" keep="true"/>', [(1, "c1", "hello"), (2, None, "keep")]),
        ('<r n="1">left open\n<r n="2"/>beside', [(1, None, "left open"), (2, None, "beside")]),
        ('<r n="9">out</r><r n="x">no</r><R N="2">-></R>', [(2, None, "keep")]),
        ('<r n="1">keep it</r><r n="1">no readable text</r>', [(1, None, "keep"), (1, None, "keep")]),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, t, 2) for i, (t, _) in enumerate(cases)], "id int, reply string, expected int")
    rows = markup.parsed(df, "reply", "expected").orderBy("id", "pos").collect()
    for i, (_, want) in enumerate(cases):
        assert [(r.n, r.spk, r.translation) for r in rows if r.id == i] == want


def test_hash_of_bytes(spark):
    from quillon.functions import hashes

    df = spark.createDataFrame([([],), ([0],), ([300, 7],)], "codes array<int>")
    mask = (1 << 32) - 1

    def plain(data):
        h = list(hashes.START)
        for b in data:
            h = [((x ^ (b & 255)) * m) & mask for x, m in zip(h, hashes.STEP, strict=True)]

        def last(a, b):
            return ((a ^ a >> 16) * hashes.LAST[0] & mask) ^ ((b ^ b >> 13) * hashes.LAST[1] & mask)

        f1 = last(*h)
        f2 = last(h[1], f1)
        return f"{((f2 & 2097151) << 32) + f1:x}"

    got = [r.h for r in hashes.with_hash(df, "codes", "h").collect()]
    assert got == [plain([]), plain([0]), plain([300, 7])]


def test_fetch_policy(spark):
    from quillon.functions import policy

    cases = [
        ("https://example.org/a", "https://r.example/", None),
        ("data:image/png", "https://r.example/", "scheme"),
        ("no address", "https://r.example/", "invalid url"),
        (None, "https://r.example/", "invalid url"),
        ("http://127.0.0.1:80/x", "https://r.example/", "local network"),
        ("http://127.0.0.1/x", "http://localhost:3000/", None),
        ("http://[::1]/", "http://127.0.0.1/", None),
        ("http://[::ffff:10.0.0.1]/", None, "local network"),
        ("http://[::ffff:7f00:1]/", "https://r.example/", "local network"),
        ("http://[fe80::1]/", "https://r.example/", "local network"),
        ("http://172.32.0.1/", "https://r.example/", None),
        ("http://a.localhost./", "https://r.example/", "local network"),
    ]
    df = spark.createDataFrame([(u, s) for u, s, _ in cases], "u string, s string")
    assert [r.verdict for r in policy.with_verdict(df, "u", "s").collect()] == [w for _, _, w in cases]


def test_sources_and_texts_by_place(spark):
    from quillon.functions import cached

    df = spark.createDataFrame([(["a", "b", "c"], ["x", None]), (["a"], []), ([], ["x"])], "s array<string>, t array<string>")
    assert [r.o for r in df.select(cached.with_sources(F.col("s"), F.col("t")).alias("o")).collect()] == [["x", "b", "c"], ["a"], []]
    assert [r.o for r in df.select(cached.filled(F.col("t"), F.col("s"), F.size("s")).alias("o")).collect()] == [["x", "b", "c"], ["a"], []]


def test_bits_and_masks(spark):
    from quillon.functions import cached

    masks = [[0, 255, 255, 0, 0, 0, 0, 255, 255], [0, 7], [255]]
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    df = df.withColumn("b", cached.packed_bits(F.col("m")))
    rows = df.select("b", F.when(F.col("b").isNotNull(), cached.unpacked_bits(F.col("b"), F.size("m"))).alias("back")).collect()
    assert [r.b for r in rows] == [[0b10000110, 1], None, [1]] and [r.back for r in rows] == [masks[0], None, masks[2]]


def test_page_images_of_lazy_and_rotating_sources(spark):
    from quillon.functions import manifests as M

    html = """<img src='a.jpg' data-src="https://c1.example.com/p/1.jpg"><source srcset="https://c2.example.com/p/1.jpg 1x, b 2x"><img src="//x.example.com/2.PNG?v=1"><img src="data:image/png;base64,xx"><img src="i.svg"><img src="../3.jpg"><img alt=none>"""
    df = spark.createDataFrame([(html, "https://h.example.com/r/7?x=1")], "html string, url string")
    urls_of = F.transform(M.image_sources(F.col("html")), lambda s: M.resolved(s, F.col("url")))
    got = df.select(M.one_a_file(F.filter(urls_of, M.plausible)).alias("u")).first().u
    assert got == ["https://c1.example.com/p/1.jpg", "https://x.example.com/2.PNG?v=1", "https://h.example.com/3.jpg"]


def test_links_against_their_page(spark):
    from quillon.functions import manifests as M

    base = "https://h.example.com/a/b/c?x=1#y"
    cases = [("d", "/a/b/d"), ("./d/../e?q=../z", "/a/b/e?q=../z"), ("/x/./y/..", "/x/"), ("../../../../up", "/up"), ("?p=2", "/a/b/c?p=2"), ("#z", "/a/b/c?x=1#z"), ("", "/a/b/c?x=1"), ("/", "/")]
    df = spark.createDataFrame([(c, base) for c, _ in cases], "link string, base string")
    assert [r.u for r in df.select(M.resolved(F.col("link"), F.col("base")).alias("u")).collect()] == ["https://h.example.com" + w for _, w in cases]
    bare = spark.createDataFrame([("x", "http://h")], "link string, base string")
    assert bare.select(M.resolved(F.col("link"), F.col("base")).alias("u")).first().u == "http://h/x"


def test_manifests_that_are_broken_or_odd(spark):
    from quillon.functions import manifests as M

    cases = ["", "{", "[1", '{"pages":"x"}', '{"a":{"b":1}}', '["a","a","/b","https://h/c",""]', '{"files":[{"file":"f"},{"src":"s"},{"x":1}]}', None]
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = [r.f for r in df.select(M.file_list(F.col("j")).alias("f")).collect()]
    assert got == [[], [], [], [], [], ["a", "b", "c"], ["f", "s"], []]
    scripts = ['x={"files":[{"hash":"' + "ab" * 8 + '","hasavif":1}]}', 'x={"files":[{"hash":"no"}]}', "none"]
    df = spark.createDataFrame([(c,) for c in scripts], "j string")
    assert [len(r.f) for r in df.select(M.hash_files(F.col("j")).alias("f")).collect()] == [1, 0, 0]
    assert df.select(M.routing(F.col("j")).alias("r")).where("r IS NOT NULL").count() == 0
