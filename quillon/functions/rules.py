"""Small rules of pages, replies and scheduling, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import urls as U

# Words that tell why a provider refused a request.
IMAGE_WORDS = r"(?i)image|base64|data uri|input_image|multimodal|media_type|content\["
NOT_A_CAP = r"(?i)not support|unsupported|invalid|base64|data uri|media_type|can't read|cannot read"
CAP_WORDS = r"(?i)too many|maximum|max(imum)? of|only one|single image|one image per|limit"
THINKING_WORDS = r"(?i)thinking|budget|effort|adaptive|reasoning"
# Forms of address that are no part of a name, and vowels that are written long or short.
HONORIFIC = r"(?i)[-・\s]?(?:คุง|คุน|จัง|จัน|ซัง|ซามะ|เซ็นเซย์|senpai|sensei|kun|chan|san|sama)$"
LONG_VOWELS, SHORT_VOWELS = "ูีื", "ุิึ"
NOTE_CHARS = 140


def error_kind(status: Column, message: Column) -> Column:
    """What a failed request is: auth, ratelimit, server or parse."""
    known = F.when(status.isin(401, 402, 403, 404), "auth").when(status == 429, "ratelimit").when((status == 400) & message.rlike(IMAGE_WORDS), "parse")
    return known.when(status >= 500, "server").otherwise("parse")


def image_cap(kind: Column, message: Column) -> Column:
    """Whether a request was refused for the number of its images, not for having any."""
    return (kind == "parse") & message.rlike("(?i)image") & ~message.rlike(NOT_A_CAP) & message.rlike(CAP_WORDS)


def thinking_refused(status: Column, message: Column) -> Column:
    return status.isin(400, 422) & message.rlike(THINKING_WORDS)


def walk_ended(status: Column) -> Column:
    """Whether a walk over pages is past the last one."""
    return status.isin(404, 410)


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def sweep_reason(total: Column, anchor: Column) -> Column:
    """Why there is nothing, or something, to do from a page on."""
    return F.when(total == 0, "no-pages").when(anchor < 0, "no-anchor").when(anchor >= total, "last-page").otherwise("known")


def sweep_count(total: Column, anchor: Column) -> Column:
    return F.when((total == 0) | (anchor < 0), 0).otherwise(F.greatest(F.lit(0), total - anchor))


def span_overlap(top: Column, bottom: Column, height: float) -> Column:
    """Signed overlap of a span with a window that begins at 0."""
    return F.least(bottom, F.lit(height)) - F.greatest(top, F.lit(0.0))


def device_crop(x: Column, y: Column, w: Column, h: Column, ratio: float, across: int, down: int) -> list[Column]:
    """sx, sy, sw, sh: a rectangle in whole device pixels, inside the picture."""
    pixels = lambda c: F.floor(c * ratio)
    sx, sy = F.greatest(F.lit(0), pixels(x)), F.greatest(F.lit(0), pixels(y))
    return [sx.alias("sx"), sy.alias("sy"), F.least(across - sx, pixels(w)).alias("sw"), F.least(down - sy, pixels(h)).alias("sh")]


def page_shape(url: Column) -> Column:
    """Origin, path without slashes at its end, and query."""
    return F.concat(U.part(url, U.ORIGIN), F.regexp_replace(U.part(url, U.PATH), "/+$", ""), U.part(url, U.SEARCH))


def host_pattern(url: Column) -> Column:
    """The pattern of all addresses of a host, without port; null where none can be granted."""
    return F.when(url.rlike("(?i)^https?://[^/?#]+"), F.concat(F.lower(F.regexp_extract(url, "(?i)^(https?://)", 1)), F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^@/?#]*@)?([^/:?#]+)", 1)), F.lit("/*")))


def chapter_uuid(host: Column, path: Column) -> Column:
    """The id of a chapter in the path of a reader whose host is known to have such."""
    found = F.regexp_extract(path, "(?i)^/chapter/([0-9a-f-]{10,})(?:/|$)", 1)
    return F.when(host.rlike(r"(^|\.)mangadex\.") & (found != ""), found)


def reader_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^/reader/([0-9]+)\.html$", 1), F.lit(""))


def next_address(url: Column, key: Column, step: int = 1) -> Column:
    """The address of the next page by the shape of this one, if it keeps the chapter's key: page parameter, last segment, numeric hash.

    Whether the key is kept follows from this page's own key and from which part changes: page parameters are never part of it, a last
    segment is only where a container or less than three segments make it so, and a numeric hash only where the path has no digit.
    """
    origin, path, search, hash_ = (U.part(url, p) for p in (U.ORIGIN, U.PATH, U.SEARCH, U.HASH))
    page = F.regexp_extract(search, r"[?&]page=([0-9]+)(?:&|$)", 1)
    ahead = lambda n: (n.try_cast("bigint") + step).cast("string")
    search_on = F.concat(F.regexp_extract(search, r"^(.*[?&]page=)[0-9]+(?:&|$)", 1), ahead(page), F.regexp_extract(search, r"[?&]page=[0-9]+(&.*)?$", 1))
    stem, tail, slash = (F.regexp_extract(path, "^(.*[^/])/+([0-9]+)(/?)$", k) for k in (1, 2, 3))
    container = "^(.*/chapter/[^/]+)"
    inside = F.when(path.rlike("/chapter/[^/]"), F.regexp_extract(stem, container, 1) != "").otherwise(stem.rlike("[^/]/+[^/]"))
    own = U.chapter_key(origin, path, search, hash_) == key
    by_page = F.when((page != "") & own, F.concat(origin, path, search_on, hash_))
    by_tail = F.when((tail != "") & stem.rlike("[0-9]") & inside & own, F.concat(origin, stem, F.lit("/"), ahead(tail), slash, search, hash_))
    in_hash, rest = F.regexp_extract(hash_, "^#([0-9]+)(?:-[0-9]*)?$", 1), F.regexp_extract(hash_, "^#[0-9]+(-[0-9]+)?-?$", 1)
    by_hash = F.when((in_hash != "") & path.rlike("[0-9]") & own, F.concat(origin, path, search, F.lit("#"), ahead(in_hash), rest))
    return F.coalesce(by_page, by_tail, by_hash)


def without_honorific(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, HONORIFIC, ""))
    return F.when(bare == "", name).otherwise(bare)


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(without_honorific(name)), LONG_VOWELS, SHORT_VOWELS), r"[^\p{L}\p{N}\p{M}]", "")


def same_person(a: Column, b: Column) -> Column:
    """Equal without forms of address, equal but for spelling, or one's words all among the other's."""
    a, b = (without_honorific(F.trim(F.lower(x))) for x in (a, b))
    ta, tb = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    short, long = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    alike = (a == b) | ((F.length(name_key(a)) >= 3) & (name_key(a) == name_key(b))) | (F.size(F.array_except(short, long)) == 0)
    return F.coalesce((a != "") & (b != "") & alike, F.lit(False))


def joined_notes(notes: Sequence[Column]) -> Column:
    """Notes in order, without those that an earlier one holds; null if there is none."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(n, F.lit(""))) for n in notes]), lambda n: n != "")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, n: F.when(F.exists(acc, lambda k: k.contains(n)), acc).otherwise(F.array_append(acc, n)))
    return F.when(F.size(kept) > 0, F.substring(F.array_join(kept, " · "), 1, NOTE_CHARS))


def window_from(n: Column, anchor: Column, count: int) -> Column:
    """Places from anchor on, so many and inside the list; an unknown anchor stands for the first."""
    start = F.when((anchor >= 0) & (anchor < n), anchor).otherwise(0)
    return F.when((n > 0) & (F.lit(count) > 0), F.sequence(start, F.least(n - 1, start + (count - 1)))).otherwise(F.array().cast("array<int>"))


def luminance_is_light(colour: Column) -> Column:
    """Whether #rgb or #rrggbb is a light colour."""
    long = F.when(F.length(colour) == 4, F.concat(*[x for k in (2, 3, 4) for x in (F.substring(colour, k, 1), F.substring(colour, k, 1))])).otherwise(F.substring(colour, 2, 6))
    r, g, b = (F.conv(F.substring(long, k, 2), 16, 10).cast("double") for k in (1, 3, 5))
    return 0.299 * r + 0.587 * g + 0.114 * b > 128
