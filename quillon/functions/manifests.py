"""Page lists out of the JSON and script texts that readers publish, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which a page list may stand, and keys that name a page's file, in order of preference.
LIST_KEYS = ("pages", "images", "files", "data", "items")
FILE_KEYS = ("name", "file", "path", "src")
# The routing script's grammar without white space; its groups are the default, the cases, the other value and the build.
ROUTING = (
    r"^(?:(?:'usestrict'|\"usestrict\");)?(?:var|let|const)?[A-Za-z_$][A-Za-z0-9_$]*=\{m:function\(g\)\{varo=([01]);switch\(g\)\{((?:case[0-9]{1,4}:)+)o=([01]);break;\}returno;\},"
    r"s:function\(h\)\{varm=/\(\.\.\)\(\.\)\$/\.exec\(h\);returnparseInt\(m\[2\]\+m\[1\],16\)\.toString\(10\);\},b:['\"]([0-9]{1,20})/['\"]\};?$"
)
SAMPLE = r"^https://([aw])([1-9])\.([^/:?#]+\.[^/:?#]+)(:[0-9]+)?/([A-Za-z0-9][A-Za-z0-9._~-]*)/([^/?#]+)/([0-9a-fA-F]{16,})\.(avif|webp)$"
SLOTS = 4096


def _list_under_key(json: Column) -> Column:
    found = [F.get_json_object(json, f"$.{key}") for key in LIST_KEYS]
    return F.coalesce(*[F.when(x.startswith("["), x) for x in found])


def items(json_list: Column) -> Column:
    """The elements of a JSON array as texts; objects and arrays keep their JSON."""
    return F.from_json(json_list, "array<string>")


def file_list(payload: Column) -> Column:
    """File names of a payload: a bare list, one under a known key, or one inside a single envelope; distinct, in order, without hosts."""
    inside = F.transform(F.map_values(F.from_json(payload, "map<string,string>")), lambda v: F.when(v.startswith("{"), _list_under_key(v)))
    enveloped = F.try_element_at(F.filter(inside, lambda x: x.isNotNull() & (x != "[]")), F.lit(1))
    found = F.coalesce(F.when(F.ltrim(payload).startswith("["), payload), _list_under_key(payload), enveloped)

    def name(item: Column) -> Column:
        keyed = F.coalesce(*[F.get_json_object(item, f"$.{key}") for key in FILE_KEYS], F.lit(""))
        bare = F.regexp_replace(F.when(item.startswith("{"), keyed).otherwise(item), "^https?://[^/]+/", "")
        return F.regexp_replace(bare, "^/+", "")

    names = F.transform(items(found), name)
    return F.coalesce(F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.contains(".."))), F.array().cast("array<string>"))


def paged_urls(base: Column, key: Column, files: Column, kind: str = "data") -> Column:
    """One address a file; names with slashes are left out."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit(f"/{kind}/"), key, F.lit("/"))
    return F.transform(F.filter(files, lambda f: (f != "") & ~f.rlike(r"[/\\]")), lambda f: F.concat(root, f))


def gallery_paths(manifest: Column) -> Column:
    """Paths of a manifest whose body is JSON inside JSON; empty where it isn't one."""
    pages = F.filter(items(F.get_json_object(F.get_json_object(manifest, "$.body"), "$.pages")), lambda p: p.rlike(r'"path"\s*:\s*"'))
    return F.coalesce(F.transform(pages, lambda p: F.get_json_object(p, "$.path")), F.array().cast("array<string>"))


def place(values: Column, value: Column) -> Column:
    """Where a value first stands, from 0; -1 if nowhere."""
    return F.coalesce(F.array_position(values, value), F.lit(0)) - 1


def after(values: Column, value: Column, most: int) -> Column:
    """At most so many values behind the first place of value; none if it isn't there."""
    at = place(values, value)
    return F.when(at >= 0, F.slice(values, (at + 2).cast("int"), most)).otherwise(F.array().cast("array<string>"))


def episode_sources(manifest: Column) -> Column:
    """Sources of an episode's pages; entries that are no main page are null but keep their place. Null without a page list."""
    pages = F.get_json_object(manifest, "$.readableProduct.pageStructure.pages")
    source = lambda p: F.when((F.get_json_object(p, "$.type") == "main") & p.rlike(r'"src"\s*:\s*"'), F.get_json_object(p, "$.src"))
    return F.when(pages.startswith("["), F.transform(items(pages), source))


def episode_direction(manifest: Column) -> Column:
    stated = F.get_json_object(manifest, "$.readableProduct.pageStructure.readingDirection")
    return F.when(stated.isin("rtl", "ltr"), stated)


def hash_files(script: Column) -> Column:
    """(hash, avif) of every file of a script's object; one unusable row makes the whole list empty, so that places never shift."""
    rows = items(F.get_json_object(F.regexp_extract(script, r"(?s)(\{.*\})", 1), "$.files"))
    own = F.transform(rows, lambda r: F.struct(F.get_json_object(r, "$.hash").alias("hash"), F.coalesce(~F.get_json_object(r, "$.hasavif").isin("0", "false", ""), F.lit(False)).alias("avif")))
    sound = F.forall(own, lambda f: F.coalesce(f["hash"].rlike("^[0-9a-fA-F]{16,}$"), F.lit(False)))
    return F.when(sound, own).otherwise(F.array().cast("array<struct<hash:string,avif:boolean>>"))


def routing(script: Column) -> Column:
    """build, usual, other and slots of a routing script; null unless it is written exactly so and its cases are distinct."""
    compact = F.regexp_replace(script, r"\s+", "")
    written = F.when(compact.rlike(ROUTING), F.array(*[F.regexp_extract(compact, ROUTING, k) for k in (1, 2, 3, 4)]))

    def read(p: Column) -> Column:
        def known(slots: Column) -> Column:
            sound = p.isNotNull() & (p[0] != p[2]) & F.forall(slots, lambda s: s < SLOTS) & (F.size(F.array_distinct(slots)) == F.size(slots))
            shard = lambda k: p[k].try_cast("int") + 1
            return F.when(sound, F.struct(p[3].alias("build"), shard(0).alias("usual"), shard(2).alias("other"), slots.alias("slots")))

        return _once(F.transform(F.regexp_extract_all(p[1], F.lit("case([0-9]+):"), F.lit(1)), lambda s: s.cast("int")), known)

    return _once(written, read)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def slot(file_hash: Column) -> Column:
    """A file's slot: the last hexadecimal digit before the two ahead of it."""
    return F.conv(F.concat(F.substring(file_hash, -1, 1), F.substring(file_hash, -3, 2)), 16, 10).cast("int")


def hash_urls(files: Column, sample: Column, route: Column) -> Column:
    """(url, alt) of every file, after the address of a displayed page; the route counts only if it agrees with that page."""
    shard = lambda r, s: F.when(F.array_contains(r["slots"], s), r["other"]).otherwise(r["usual"])

    def listed(page: Column) -> Column:
        def one(f: Column) -> Column:
            s, kind = slot(f["hash"]), F.when(f["avif"], "avif").otherwise("webp")
            number = F.when(page["trusted"], shard(page["route"], s)).otherwise(page["shard"])

            def urls(n: Column) -> Column:
                before, behind = F.concat(F.lit("https://"), F.when(f["avif"], "a").otherwise("w")), F.concat(page["host"], s.cast("string"), F.lit("/"), f["hash"], F.lit("."), kind)
                return F.struct(F.concat(before, n.cast("string"), behind).alias("url"), F.concat(before, F.when(n == 1, 2).otherwise(1).cast("string"), behind).alias("alt"))

            return _once(number, urls)

        return F.when(page["fits"], F.transform(page["files"], one))

    def placed(p: Column) -> Column:
        part = lambda k: p["parts"][k - 1]
        trusted = F.coalesce((p["route"]["build"] == part(5)) & (shard(p["route"], slot(part(7))).cast("string") == part(2)), F.lit(False))
        fits = p["like"] & ((part(1) == "a") == (part(8) == "avif"))
        host = F.concat(F.lit("."), part(3), part(4), F.lit("/"), part(5), F.lit("/"))
        return F.struct(p["files"].alias("files"), p["route"].alias("route"), trusted.alias("trusted"), fits.alias("fits"), part(2).try_cast("int").alias("shard"), host.alias("host"))

    parts = F.array(*[F.regexp_extract(sample, SAMPLE, k) for k in range(1, 9)])
    known = F.struct(parts.alias("parts"), sample.rlike(SAMPLE).alias("like"), route.alias("route"), files.alias("files"))
    return _once(_once(known, placed), listed)


def puzzle_tiles(width: Column, height: Column) -> Column:
    """Sixteen (sx, sy, dx, dy) tiles of a picture that was cut and transposed; the same tiles undo it."""
    tw, th = 8 * F.floor(width / 32), 8 * F.floor(height / 32)
    row, column = (lambda b: F.floor(b / 4)), (lambda b: b % 4)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.struct((row(b) * tw).alias("sx"), (column(b) * th).alias("sy"), (column(b) * tw).alias("dx"), (row(b) * th).alias("dy")))


def image_sources(html: Column) -> Column:
    """Addresses of a page's images in order: of an img the first of its lazy attributes, else src; of a source its first candidate."""

    def attribute(tag: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))

    def source(tag: Column) -> Column:
        lazy = [attribute(tag, n) for n in ("data-src", "data-original", "data-lazy-src", "data-url", "src")]
        first = F.split(F.trim(F.split(F.coalesce(attribute(tag, "srcset"), attribute(tag, "data-srcset"), F.lit("")), ",")[0]), r"\s+")[0]
        return F.when(tag.rlike("(?i)^<source"), F.nullif(first, F.lit(""))).otherwise(F.coalesce(*lazy))

    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:img|source)\s[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, source), lambda s: s.isNotNull())


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(link: Column, base: Column) -> Column:
    """A link against its page's address: absolute, scheme-relative, rooted, or beside the page; dot segments are followed."""
    scheme, origin = F.regexp_extract(base, "^(https?:)", 1), F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), "^https?://[^/]+(.*/)", 1)
    path, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    path = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(path)).otherwise(path)
    same = F.concat(F.regexp_replace(base, F.when(link.startswith("?"), F.lit("[?#].*$")).otherwise(F.lit("#.*$")), F.lit("")), link)
    return F.when((link == "") | link.rlike("^[?#]"), same).when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(origin, path, rest))


def plausible(url: Column) -> Column:
    """Whether an address can be that of page art."""
    return url.rlike("(?i)^https?://") & ~F.regexp_replace(url, r"[?#].*$", "").rlike(r"(?i)\.(svg|ico|gif)$")


def one_a_file(urls: Column) -> Column:
    """Distinct addresses in order; of https ones that differ in their host alone the first."""
    path = lambda u: F.regexp_extract(u, "^https://[^/?#]+([^?#]*)", 1)
    twin = lambda a, b: (a == b) | (a.startswith("https:") & b.startswith("https:") & (path(a) == path(b)) & ~path(a).isin("", "/") & (F.regexp_extract(a, "^https://([^/:?#]+)", 1) != F.regexp_extract(b, "^https://([^/:?#]+)", 1)))
    return F.aggregate(urls, F.array().cast("array<string>"), lambda kept, u: F.when(F.exists(kept, lambda k: twin(k, u)), kept).otherwise(F.concat(kept, F.array(u))))


def first_of(sources: list[Column]) -> Column:
    """The first source that lists any page, in order of trust, with its number."""
    tries = [F.when(F.size(s) > 0, F.struct(F.lit(i).alias("source"), s.alias("urls"))) for i, s in enumerate(sources)]
    return reduce(lambda a, b: F.coalesce(a, b), tries)
