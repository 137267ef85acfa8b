"""Canonical keys and page ordinals of reader URLs, as column expressions with the same rules in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN, PATH, SEARCH, HASH = r"^(https?://[^/?#]+)", r"^https?://[^/?#]+([^?#]*)", r"(\?[^#]*)", r"(#.*)$"


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def chapter_key(origin: Column, path: Column, search: Column, hash_: Column) -> Column:
    """Up to the segment after /chapter/; else without page-turning tail, parameters and numeric hash."""
    container = F.regexp_extract(path, "^(.*/chapter/[^/]+)", 1)
    kept_hash = F.when(path.rlike("[0-9]") & hash_.rlike("^#[0-9]+(-[0-9]*)?$"), "").otherwise(hash_)
    segs = segments(path)
    turn = (F.size(segs) >= 3) & F.element_at(segs, -1).rlike("^[0-9]+$")
    stem = F.when(turn, F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/"))).otherwise(F.regexp_replace(path, "/$", ""))
    stem = F.when(stem == "", "/").otherwise(stem)
    params = F.filter(F.split(F.substring(search, 2, 1_000_000), "&"), lambda s: (s != "") & ~F.regexp_extract(s, "^([^=]*)", 1).isin("page", "p", "pg"))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(container != "", F.concat(origin, container)).otherwise(F.concat(origin, stem, query, kept_hash))


def page_number(origin: Column, path: Column, search: Column, hash_: Column, chapter: Column) -> Column:
    """The ordinal an URL names in its chapter, or null where its own key doesn't fold it away."""
    explicit = F.regexp_extract(path, "/(?:chapter|read)/[^/]+/([0-9]+)(?:/|$)", 1)
    in_hash = F.regexp_extract(hash_, "^#([0-9]+)(?:-[0-9]*)?$", 1)
    segs = segments(path)
    stem = F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/")
    tail = F.element_at(segs, -1)

    def positive(s: Column) -> Column:
        n = s.try_cast("bigint")
        return F.when(n > 0, n)

    by_hash = F.when((in_hash != "") & path.rlike("[0-9]"), positive(in_hash))
    tail_fits = (F.size(segs) >= 3) & tail.rlike("^[0-9]+$") & stem.rlike("[0-9]")
    by_tail = F.when(tail_fits, F.when(chapter_key(origin, F.concat(F.lit("/"), stem), search, hash_) == chapter, positive(tail)))
    return F.when(explicit != "", positive(explicit)).otherwise(F.coalesce(by_hash, by_tail))


def sql_key(origin: str, path: str, search: str, hash_: str) -> str:
    segs = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    params = f"list_filter(string_split(substr({search}, 2), '&'), lambda s: s <> '' AND regexp_extract(s, '^([^=]*)', 1) NOT IN ('page', 'p', 'pg'))"
    stem = f"CASE WHEN len({segs}) >= 3 AND regexp_matches({segs}[-1], '^[0-9]+$') THEN '/' || array_to_string({segs}[:-2], '/') ELSE regexp_replace({path}, '/$', '') END"
    return f"""CASE WHEN regexp_extract({path}, '^(.*/chapter/[^/]+)', 1) <> '' THEN {origin} || regexp_extract({path}, '^(.*/chapter/[^/]+)', 1)
        ELSE {origin} || (CASE WHEN ({stem}) = '' THEN '/' ELSE {stem} END)
            || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END
            || CASE WHEN regexp_matches({path}, '[0-9]') AND regexp_matches({hash_}, '^#[0-9]+(-[0-9]*)?$') THEN '' ELSE {hash_} END END"""


SQL_PARTS = rf"""parts AS (
    SELECT page_id, url, html, regexp_extract(url, '{ORIGIN}', 1) AS origin, regexp_extract(url, '{PATH}', 1) AS path,
        regexp_extract(url, '{SEARCH}', 1) AS search, regexp_extract(url, '{HASH}', 1) AS hash FROM pages)"""
