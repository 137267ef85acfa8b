"""Requests as text: region lists, rosters, recent lines and their parts; replies of five kinds of service as one record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

# The tag that ends a roster, and how many characters of a note a roster shows.
ROSTER_END, NOTE_SHOWN = "</known_characters>", 120


def region_list(regions: Column, images: int, vision: bool, alone: bool) -> Column:
    """One line a region: its number, where its pictures stand, and its source text. Regions are (n, page, marker, source).

    images: full pictures before the crops. alone: there are no full pictures, so no page and marker are named.
    """

    def line(r: Column, i: Column) -> Column:
        text = lambda c: c.cast("string")
        where = F.lit("")
        if vision:
            where = F.concat(F.lit(" crop="), text(i + 1), F.lit(" image="), text(i + 1 + (0 if alone else images)))
            if not alone:
                where = F.concat(where, F.lit(" page="), text(F.coalesce(r["page"], F.lit(1))), F.lit(" marker="), text(F.coalesce(r["marker"], r["n"])))
        source = F.when(F.coalesce(r["source"], F.lit("")) != "", F.concat(F.lit(" "), r["source"])).otherwise("" if vision else " (read from image)")
        return F.concat(text(r["n"]), where, source, F.lit("\n"))

    return F.concat(F.lit("<regions>\n"), F.array_join(F.transform(regions, line), ""), F.lit("</regions>\n"))


def roster_line(c: Column) -> Column:
    """A person as a roster shows them: name, full name, look, and note. c has name, full_name, desc, note and source."""
    usable = lambda t: F.when(T.usable(F.coalesce(t, F.lit(""))), F.trim(t)).otherwise("")
    own = c["source"] == "user"
    full = c["full_name"].isNotNull() & ~c["full_name"].eqNullSafe(c["name"])
    label = F.when(full & c["name"].isNotNull(), F.concat(c["name"], F.lit(" ("), c["full_name"], F.lit(")"))).when(full, c["full_name"]).otherwise(c["name"])
    desc = F.when(own, F.trim(F.coalesce(c["desc"], F.lit("")))).otherwise(usable(c["desc"]))
    line = F.when(label.isNotNull() & (desc != "") & (desc != label), F.concat(label, F.lit(" — "), desc)).when(label.isNotNull(), label).when(desc != "", F.concat(F.lit("(unnamed) "), desc)).otherwise("(unnamed)")
    note = F.substring(F.trim(F.when(own, F.coalesce(c["note"], F.lit(""))).otherwise(usable(c["note"]))), 1, NOTE_SHOWN)
    return F.when(note != "", F.concat(line, F.lit(" · "), note)).otherwise(line)


def roster(people: Column) -> Column:
    """The roster's block; empty without people. people have an id and a gender besides what roster_line reads."""
    line = lambda c: F.concat(F.lit('<c id="'), c["id"], F.lit('" g="'), c["gender"], F.when(c["source"] == "user", '" u="1">').otherwise('">'), roster_line(c), F.lit("</c>\n"))
    return F.when(F.size(people) > 0, F.concat(F.lit("<known_characters>\n"), F.array_join(F.transform(people, line), ""), F.lit(f"{ROSTER_END}\n"))).otherwise("")


def recent_lines(pairs: Column, ids: Column, most: int) -> Column:
    """The last lines as source and translation, with a speaker who is in the roster; pairs are (source, translation, spk)."""
    last = F.when(F.size(pairs) > most, F.slice(pairs, -most, most)).otherwise(pairs)
    tag = lambda p: F.when(F.coalesce(F.array_contains(ids, p["spk"]), F.lit(False)), F.concat(F.lit("["), p["spk"], F.lit("] "))).otherwise("")
    line = lambda p: F.concat(F.lit("- "), tag(p), F.when(F.coalesce(p["source"], F.lit("")) != "", F.concat(p["source"], F.lit(" => "))).otherwise("(previous page) "), p["translation"], F.lit("\n"))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("<recent_translations>\n"), F.array_join(F.transform(last, line), ""), F.lit("</recent_translations>\n"))).otherwise("")


def split_request(user: Column) -> Column:
    """head, up to the roster's end, and tail of a request; null without a roster."""
    at = F.instr(user, ROSTER_END)
    end = at + (len(ROSTER_END) - 1)
    head = F.substr(user, F.lit(1), end)
    return F.when(at > 0, F.struct(head.alias("head"), F.regexp_replace(F.substr(user, end + 1), "^\n", "").alias("tail")))


def wanted_images(images: Column, numbers: Column, wanted: Column, pages: int) -> Column:
    """The full pictures and the crops of wanted regions, in that order; null if a full picture or a crop is missing."""
    crops = F.transform(wanted, lambda w: F.get(images, (F.array_position(numbers, w) - 1 + pages).cast("int")))
    known = F.forall(wanted, lambda w: F.array_contains(numbers, w)) & F.forall(crops, lambda c: c.isNotNull())
    return F.when((F.size(images) >= pages) & known, F.concat(F.slice(images, 1, pages), crops))


def _number(json: Column, path: str) -> Column:
    value = F.get_json_object(json, path).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 1e300), value)


def _text_parts(json_list: Column, keep: Callable[[Column], Column], path: str) -> Column:
    return F.transform(F.filter(F.from_json(json_list, "array<string>"), keep), lambda p: F.get_json_object(p, path))


#: For each kind of service: finish, tokens in, out, read from a cache, and spent on reasoning.
_PATHS = {
    "chat": ("$.choices[0].finish_reason", "$.usage.prompt_tokens", "$.usage.completion_tokens", "$.usage.prompt_tokens_details.cached_tokens", "$.usage.completion_tokens_details.reasoning_tokens"),
    "responses": ("$.status", "$.usage.input_tokens", "$.usage.output_tokens", "$.usage.input_tokens_details.cached_tokens", "$.usage.output_tokens_details.reasoning_tokens"),
    "blocks": ("$.stop_reason", "$.usage.input_tokens", "$.usage.output_tokens", "$.usage.cache_read_input_tokens", None),
    "candidates": ("$.candidates[0].finishReason", "$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", "$.usageMetadata.cachedContentTokenCount", "$.usageMetadata.thoughtsTokenCount"),
    "run": ("$.result.choices[0].finish_reason", "$.result.usage.prompt_tokens", "$.result.usage.completion_tokens", "$.result.usage.prompt_tokens_details.cached_tokens", "$.result.usage.completion_tokens_details.reasoning_tokens"),
}


def reply(kind: str, body: Column) -> Column:
    """text, finish, in_tok, out_tok, cached_tok and reason_tok of a service's answer; counters that are no numbers are null."""
    field = lambda path: F.get_json_object(body, path)
    if kind == "chat":
        text = field("$.choices[0].message.content")
    elif kind == "responses":
        messages = F.filter(F.from_json(field("$.output"), "array<string>"), lambda m: F.get_json_object(m, "$.type") == "message")
        parts = F.flatten(F.transform(messages, lambda m: _text_parts(F.get_json_object(m, "$.content"), lambda c: F.get_json_object(c, "$.type") == "output_text", "$.text")))
        text = F.array_join(parts, "\n")
    elif kind == "blocks":
        text = F.array_join(_text_parts(field("$.content"), lambda c: F.get_json_object(c, "$.type") == "text", "$.text"), "\n")
    elif kind == "candidates":
        text = F.array_join(_text_parts(field("$.candidates[0].content.parts"), lambda c: F.get_json_object(c, "$.text").isNotNull(), "$.text"), "")
    else:
        text = F.coalesce(field("$.result.response"), field("$.result.choices[0].message.content"))
    finish, *counters = _PATHS[kind]
    names = ("in_tok", "out_tok", "cached_tok", "reason_tok")
    numbers = [(_number(body, p) if p else F.lit(None).cast("double")).alias(n) for n, p in zip(names, counters, strict=True)]
    stop = field(finish)
    if kind == "responses":
        stop = F.when(stop == "incomplete", F.concat(F.lit("incomplete:"), F.coalesce(field("$.incomplete_details.reason"), F.lit("unknown")))).otherwise(stop)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), stop.alias("finish"), *numbers)


def run_error(body: Column) -> Column:
    """message and code of errors that a service lists in its answer; null without any."""
    errors = F.from_json(F.get_json_object(body, "$.errors"), "array<string>")
    said = F.array_join(F.filter(F.transform(errors, lambda e: F.get_json_object(e, "$.message")), lambda m: m.isNotNull() & (m != "")), "; ")
    return F.when(F.size(errors) > 0, F.struct(F.when(said == "", "unnamed error").otherwise(said).alias("message"), F.get_json_object(F.get(errors, 0), "$.code").try_cast("bigint").alias("code")))
