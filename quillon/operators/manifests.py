"""Page lists of readers: flexible payloads, galleries, episodes, hashed files, images of documents, and the choice among them.

The inputs are made from orders: the lines of an order are the pages of a chapter, and its number picks how the list is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import manifests as M
from quillon.functions import urls as U
from quillon.sources.tables import table

AHEAD = 2


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o: an order's number, names: its pages' files in line order (some twice, some with a folder)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    name = lambda x: F.concat(F.when(x["l_suppkey"] % 5 == 0, "x/").otherwise(""), F.lit("p"), (x["l_partkey"] % 7).cast("string"), F.lit(".jpg"))
    return g.select("o", F.transform("lines", name).alias("names"))


CHAPTERS = """chapters AS (
    SELECT o, list_transform(lines, lambda x: CASE WHEN x.s % 5 = 0 THEN 'x/' ELSE '' END || 'p' || (x.p % 7) || '.jpg') AS names
    FROM (SELECT l_orderkey AS o, list_sort(list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey})) AS lines FROM lineitem GROUP BY 1))"""


def _written(names: Column, item: str) -> Column:
    """A JSON list of names, each put into item."""
    before, behind = item.split("#")
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit(before), n, F.lit(behind))), ","), F.lit("]"))


def _sql_written(names: str, item: str) -> str:
    before, behind = item.split("#")
    return f"'[' || array_to_string(list_transform({names}, lambda n: '{before}' || n || '{behind}'), ',') || ']'"


_FORMS = [(0, "", "", '"#"'), (1, '{"pages":', "}", '"#"'), (2, '{"meta":1,"images":', "}", '{"name":"https://cdn.example.com/#"}'), (3, '{"ok":true,"result":{"files":', "}}", '{"path":"/#"}'), (4, '{"items":', "}", '{"src":"../#"}')]


def _payload(names: Column, o: Column) -> Column:
    out = F.lit('{"ok":true}')
    for k, head, tail, item in _FORMS:
        out = F.when(o % 6 == k, F.concat(F.lit(head), _written(names, item), F.lit(tail))).otherwise(out)
    return out


_SQL_PAYLOAD = "CASE o % 6 " + " ".join(f"WHEN {k} THEN '{head}' || {_sql_written('names', item)} || '{tail}'" for k, head, tail, item in _FORMS) + """ ELSE '{"ok":true}' END"""


def reader_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each chapter's payload, which is written in one of six ways."""
    c = _chapters(spark, sf_dir)
    files = M.file_list(_payload(F.col("names"), F.col("o")))
    return c.select("o", F.size(files).cast("bigint").alias("n_files"), F.array_join(files, ",").alias("files"))


READER_FILES = f"""WITH {CHAPTERS}, p AS (SELECT o, CAST({_SQL_PAYLOAD} AS JSON) AS j FROM chapters),
l AS (SELECT o, CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE coalesce({', '.join(f"CASE WHEN json_type(j, '$.{k}') = 'ARRAY' THEN json_extract(j, '$.{k}') END" for k in M.LIST_KEYS)}, json_extract(j, '$.result.files')) END AS l FROM p),
i AS (SELECT o, from_json(l, '["JSON"]') AS items FROM l),
n AS (SELECT o, list_transform(items, lambda e: regexp_replace(regexp_replace(CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$' ELSE coalesce({', '.join(f"e ->> '$.{k}'" for k in M.FILE_KEYS)}, '') END, '^https?://[^/]+/', ''), '^/+', '')) AS ns FROM i),
k AS (SELECT o, coalesce(list_filter(ns, lambda x: x <> '' AND NOT contains(x, '..')), []) AS ns FROM n),
d AS (SELECT o, list_filter(ns, lambda x, k: list_position(ns, x) = k) AS ns FROM k)
SELECT o, len(ns) AS n_files, array_to_string(ns, ',') AS files FROM d"""


def paged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each chapter's files on a server of its own."""
    c = _chapters(spark, sf_dir)
    urls = M.paged_urls(F.concat(F.lit("https://n"), (F.col("o") % 3).cast("string"), F.lit(".example.com//")), F.col("o").cast("string"), F.col("names"), "data-saver")
    return c.select("o", F.size(urls).cast("bigint").alias("n_urls"), F.array_join(urls, " ").alias("urls"))


PAGED_URLS = f"""WITH {CHAPTERS}, u AS (SELECT o, list_transform(list_filter(names, lambda f: NOT contains(f, '/')), lambda f: 'https://n' || (o % 3) || '.example.com/data-saver/' || o || '/' || f) AS u FROM chapters)
SELECT o, len(u) AS n_urls, array_to_string(u, ' ') AS urls FROM u"""


def gallery_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last page stands in each chapter's doubly written gallery, and the addresses behind its first page."""
    c = _chapters(spark, sf_dir)
    inner = F.concat(F.lit('{"pages":'), _written(F.col("names"), '{"path":"#"}'), F.lit("}"))
    manifest = F.when(F.col("o") % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"body":"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"}')))
    c = c.select("o", "names", M.gallery_paths(manifest).alias("paths"))
    ahead = F.transform(M.after(F.col("paths"), F.col("names")[0], AHEAD), lambda p: F.concat(F.lit("https://img.example.com/"), p))
    return c.select("o", F.size("paths").cast("bigint").alias("n_pages"), M.place(F.col("paths"), F.element_at("names", -1)).alias("last_at"), F.array_join(ahead, " ").alias("ahead"))


GALLERY_URLS = f"""WITH {CHAPTERS}, p AS (SELECT o, names, CASE WHEN o % 7 = 0 THEN [] ELSE names END AS paths FROM chapters)
SELECT o, len(paths) AS n_pages, CAST(coalesce(list_position(paths, names[-1]), 0) - 1 AS BIGINT) AS last_at,
    array_to_string(list_transform(CASE WHEN list_contains(paths, names[1]) THEN paths[list_position(paths, names[1]) + 1 : list_position(paths, names[1]) + {AHEAD}] ELSE [] END, lambda p: 'https://img.example.com/' || p), ' ') AS ahead FROM p"""


def episode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and sources of each chapter's episode, and the next main pages behind its first; other pages keep their place."""
    c = _chapters(spark, sf_dir)
    page = lambda n: F.concat(F.lit('{"type":"'), F.when(n.startswith("x/"), "link").otherwise("main"), F.lit('","src":"'), n, F.lit('"}'))
    pages = F.concat(F.lit("["), F.array_join(F.transform("names", page), ","), F.lit("]"))
    way = F.when(F.col("o") % 3 == 0, "rtl").when(F.col("o") % 3 == 1, "ltr").otherwise("up")
    manifest = F.concat(F.lit('{"readableProduct":{"pageStructure":{"readingDirection":"'), way, F.lit('","pages":'), pages, F.lit("}}}"))
    c = c.select("o", "names", M.episode_direction(manifest).alias("direction"), M.episode_sources(manifest).alias("sources"))
    behind = F.slice(F.filter(F.slice("sources", 2, 1000), lambda s: s.isNotNull()), 1, AHEAD)
    return c.select("o", "direction", F.size("sources").cast("bigint").alias("n_places"), F.array_join("sources", ",", "-").alias("sources"), F.when(F.col("sources")[0].isNotNull(), F.array_join(behind, ",")).otherwise("").alias("ahead"))


EPISODE_PAGES = f"""WITH {CHAPTERS}, s AS (SELECT o, CASE o % 3 WHEN 0 THEN 'rtl' WHEN 1 THEN 'ltr' END AS direction, list_transform(names, lambda n: CASE WHEN starts_with(n, 'x/') THEN NULL ELSE n END) AS s FROM chapters)
SELECT o, direction, len(s) AS n_places, array_to_string(list_transform(s, lambda x: coalesce(x, '-')), ',') AS sources,
    CASE WHEN s[1] IS NOT NULL THEN array_to_string(list_filter(s[2:], lambda x: x IS NOT NULL)[1:{AHEAD}], ',') ELSE '' END AS ahead FROM s"""


def hash_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, routing and addresses of each chapter's hashed files; a list with a broken row is empty, a script that isn't known no route."""
    c = _chapters(spark, sf_dir).select("o", F.transform("names", lambda n: F.md5(n)).alias("hashes"))
    row = lambda h, i: F.concat(F.lit('{"hash":"'), F.when((F.col("o") % 11 == 0) & (i == 1), "short").otherwise(h), F.lit('","hasavif":'), (i % 2).cast("string"), F.lit("}"))
    script = F.concat(F.lit('var info = {"files":['), F.array_join(F.transform("hashes", row), ","), F.lit("]};"))
    first = F.col("hashes")[0]
    cases = F.concat(F.lit("case "), M.slot(first).cast("string"), F.lit(": case "), (F.col("o") % 5000).cast("string"), F.lit(":"))
    gg = F.concat(F.lit("'use strict';\ngg = { m: function(g) { var o = 0; switch (g) { "), cases, F.lit(" o = 1; break; } return o; }, s: function(h) { var m = /(..)(.)$/.exec(h); return parseInt(m[2]+m[1], 16).toString(10); }, b: '17/' };"))
    sample = F.concat(F.lit("https://w"), (F.col("o") % 2 + 1).cast("string"), F.lit(".img.example.com/17/9/"), first, F.lit(".webp"))
    c = c.select("o", M.hash_files(script).alias("files"), M.routing(gg).alias("route"), sample.alias("sample"))
    c = c.withColumn("urls", M.hash_urls(F.col("files"), F.col("sample"), F.col("route")))
    return c.select("o", F.size("files").cast("bigint").alias("n_files"), F.col("route.build").alias("build"), F.size("route.slots").cast("bigint").alias("n_slots"), F.array_join(F.transform("urls", lambda u: F.concat_ws(" ", u["url"], u["alt"])), "\n").alias("urls"))


HASH_READER = f"""WITH {CHAPTERS}, h AS (SELECT o, list_transform(names, lambda n: md5(n)) AS hs FROM chapters),
f AS (SELECT o, hs, CASE WHEN o % 11 = 0 AND len(hs) > 1 THEN [] ELSE hs END AS files, CAST(('0x' || hs[1][-1:] || hs[1][-3:-2]) AS INT) AS slot, o % 5000 AS extra FROM h),
r AS (SELECT *, extra < 4096 AND extra <> slot AS known FROM f),
n AS (SELECT *, known AND (o % 2 + 1) = 2 AS trusted FROM r),
u AS (SELECT *, list_transform(list_transform(files, lambda x, i: {{'h': x, 'i': i - 1, 's': CAST(('0x' || x[-1:] || x[-3:-2]) AS INT)}}),
    lambda y: {{'y': y, 'n': CASE WHEN trusted THEN CASE WHEN y.s IN (slot, extra) THEN 2 ELSE 1 END ELSE o % 2 + 1 END}}) AS us FROM n),
t AS (SELECT *, list_transform(us, lambda z: {{'pre': CASE WHEN z.y.i % 2 = 1 THEN 'https://a' ELSE 'https://w' END, 'n': z.n, 'tail': '.img.example.com/17/' || z.y.s || '/' || z.y.h || CASE WHEN z.y.i % 2 = 1 THEN '.avif' ELSE '.webp' END}}) AS ts FROM u)
SELECT o, len(files) AS n_files, CASE WHEN known THEN '17' END AS build, CASE WHEN known THEN CAST(2 AS BIGINT) END AS n_slots,
    array_to_string(list_transform(ts, lambda x: x.pre || x.n || x.tail || ' ' || x.pre || (CASE WHEN x.n = 1 THEN 2 ELSE 1 END) || x.tail), chr(10)) AS urls FROM t"""


def puzzle_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen tiles of a picture of each part's size."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("w"), (F.col("p_partkey") % 900).alias("h"))
    return p.select("p_partkey", F.posexplode(M.puzzle_tiles(F.col("w"), F.col("h"))).alias("tile", "t")).select("p_partkey", "tile", "t.*")


PUZZLE_TILES = """WITH p AS (SELECT p_partkey, 8 * (p_size * 37 // 32) AS tw, 8 * (p_partkey % 900 // 32) AS th FROM part)
SELECT p_partkey, CAST(b AS INT) AS tile, CAST((b // 4) * tw AS BIGINT) AS sx, CAST((b % 4) * th AS BIGINT) AS sy, CAST((b % 4) * tw AS BIGINT) AS dx, CAST((b // 4) * th AS BIGINT) AS dy FROM p, range(0, 16) AS r(b)"""


def _with_images(html: Column, page: Column) -> Column:
    """A document whose links stand for images, written in five ways."""
    forms = ['<img src="i.gif" data-src="#">', "<img src='#'>", '<source srcset="# 1x, big.jpg 2x">', '<img data-url="#.svg">', '<img src="//b.example.com#">']
    links = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))

    def tag(link: Column, i: Column) -> Column:
        out = F.lit("")
        for k, form in enumerate(forms):
            head, tail = form.split("#")
            out = F.when((page + i) % len(forms) == k, F.concat(F.lit(head), link, F.lit(tail))).otherwise(out)
        return out

    return F.array_join(F.transform(links, tag), "\n")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each page, resolved, without icons and vector art, each file once whatever its host."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", _with_images(F.col("html"), F.col("page_id")).alias("html"))
    urls = F.transform(M.image_sources(F.col("html")), lambda s: M.resolved(s, F.col("url")))
    p = p.select("page_id", urls.alias("all")).select("page_id", F.size("all").cast("bigint").alias("n_sources"), M.one_a_file(F.filter("all", M.plausible)).alias("urls"))
    return p.select("page_id", "n_sources", F.size("urls").cast("bigint").alias("n_images"), F.array_join("urls", " ").alias("images"))


PAGE_IMAGES = rf"""WITH RECURSIVE {U.SQL_PARTS}, l AS (SELECT page_id, origin, regexp_extract(url, '^(https?:)', 1) AS scheme, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1), []) AS links FROM parts),
s AS (SELECT page_id, origin, list_transform(links, lambda x, i: CASE (page_id + i - 1) % 5 WHEN 3 THEN CASE WHEN x = '' THEN NULL ELSE x || '.svg' END WHEN 4 THEN '//b.example.com' || x WHEN 2 THEN split_part(trim(split_part(x, ',', 1)), ' ', 1) ELSE x END) AS src, scheme FROM l),
a AS (SELECT page_id, list_transform(list_filter(src, lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '//') THEN scheme || x ELSE origin || x END) AS urls FROM s),
f AS (SELECT page_id, len(urls) AS n_sources, list_filter(urls, lambda u: NOT regexp_matches(u, '(?i)\.(svg|ico|gif)$')) AS us FROM a),
k AS (SELECT page_id, n_sources, us, 0 AS i, CAST([] AS VARCHAR[]) AS kept FROM f
    UNION ALL SELECT page_id, n_sources, us, i + 1, CASE WHEN len(list_filter(kept, lambda x: x = us[i + 1] OR (starts_with(x, 'https:') AND starts_with(us[i + 1], 'https:')
        AND regexp_extract(x, '^https://[^/?#]+([^?#]*)', 1) = regexp_extract(us[i + 1], '^https://[^/?#]+([^?#]*)', 1) AND regexp_extract(x, '^https://[^/?#]+([^?#]*)', 1) NOT IN ('', '/')
        AND regexp_extract(x, '^https://([^/:?#]+)', 1) <> regexp_extract(us[i + 1], '^https://([^/:?#]+)', 1)))) > 0 THEN kept ELSE list_append(kept, us[i + 1]) END FROM k WHERE i < len(us))
SELECT page_id, n_sources, len(kept) AS n_images, array_to_string(kept, ' ') AS images FROM k WHERE i = len(us)"""


def enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's pages from the source most trusted among those that list any: manifest, service, gallery, document."""
    c = _chapters(spark, sf_dir)
    none, n, o = F.array().cast("array<string>"), F.col("names"), F.col("o")
    listed = [F.filter(n, lambda x: x.contains("0")), F.filter(n, lambda x: x.contains("1"))]
    sources = [F.when(o % 2 == k, f).otherwise(none) for k, f in enumerate(listed)] + [F.when(o % 3 == 0, F.slice(n, 1, 2)).otherwise(none), n]
    c = c.select("o", "names", M.first_of(sources).alias("f"))
    return c.select("o", F.col("f.source").alias("source"), F.size("f.urls").cast("bigint").alias("n_pages"), M.place(F.col("f.urls"), F.element_at("names", -1)).alias("anchor"))


ENUMERATED = f"""WITH {CHAPTERS}, s AS (SELECT o, names, CASE WHEN o % 2 = 0 THEN list_filter(names, lambda x: contains(x, '0')) ELSE [] END AS a, CASE WHEN o % 2 = 1 THEN list_filter(names, lambda x: contains(x, '1')) ELSE [] END AS b,
    CASE WHEN o % 3 = 0 THEN names[1:2] ELSE [] END AS c FROM chapters),
f AS (SELECT o, names, CASE WHEN len(a) > 0 THEN 0 WHEN len(b) > 0 THEN 1 WHEN len(c) > 0 THEN 2 ELSE 3 END AS source, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c ELSE names END AS u FROM s)
SELECT o, CAST(source AS INT) AS source, len(u) AS n_pages, CAST(coalesce(list_position(u, names[-1]), 0) - 1 AS BIGINT) AS anchor FROM f"""

QUERIES = {f.__name__: f for f in (reader_files, paged_urls, gallery_urls, episode_pages, hash_reader, puzzle_tiles, page_images, enumerated)}
ORACLES = {
    "reader_files": READER_FILES, "paged_urls": PAGED_URLS, "gallery_urls": GALLERY_URLS, "episode_pages": EPISODE_PAGES,
    "hash_reader": HASH_READER, "puzzle_tiles": PUZZLE_TILES, "page_images": PAGE_IMAGES, "enumerated": ENUMERATED,
}
