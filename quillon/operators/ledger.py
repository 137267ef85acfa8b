"""Context ledgers: the roster and recent lines as of every page of a chapter, and what its orders changed.

A conversation's turns are the pages of a chapter. A turn's first words name the speaker, later ones are mentions and orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import people as H
from quillon.operators.grouped import map_groups
from quillon.sources.tables import table

PEOPLE, PAIRS = 5, 4
_NAME = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][^\W\d_]{3,}\b")


def page_of(turn: dict) -> tuple[list[H.Line], list[H.Mention]]:
    """Lines and mentions of a turn: every sentence is a line; names beyond the first are mentions, every fifth turn gives an order."""
    text = turn["text"] or ""
    names = list(dict.fromkeys(_NAME.findall(text)))
    speaker = H.Person(desc=f"{turn['role']} who speaks", name=names[0] if names and turn["turn"] % 2 == 0 else None, gender="F" if turn["turn"] % 3 == 0 else "?") if turn["role"] != "system" else None
    lines = [H.Line(s.strip()[:20], s.strip() or "keep", speaker if i == 0 else None) for i, s in enumerate(text.split(".")[:4])]
    mentions = [H.Mention(name=n, gender="M" if len(n) % 2 else "?", desc="a friend" if len(n) == 5 else "") for n in names[1:4]]
    if turn["turn"] % 5 == 3 and len(names) > 1:
        mentions.append(H.Mention(id="c1", same_as="c2"))
        mentions.append(H.Mention(name=names[0], correct="gender", now="female", why="she"))
    return lines, mentions


def _shown(p: H.Person) -> str:
    return f"{p.id}:{p.label}:{p.gender}"


def fold(turns: list[dict], people: int = PEOPLE, pairs: int = PAIRS) -> list[tuple]:
    """For each turn the roster before it, the lines kept, and what its orders changed."""
    context, out = H.Context(), []
    for t in turns:
        before = context
        context, ops = H.after_page(context, *page_of(t), most_pairs=pairs, most_people=people)
        out.append((t["conv_id"], t["turn"], ",".join(map(_shown, before.people)), len(context.pairs), ";".join("|".join(map(str, op)) for op in ops), len(H.edited(before.people, context.people))))
    return out


def context_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context as of every turn; each conversation is folded in order, and one conversation is in memory at a time."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    return map_groups(c, "conv_id", ["turn", "role", "text"], fold, "conv_id bigint, turn int, roster string, n_pairs int, ops string, n_changed int")


def context_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's context as of its middle turn, replayed from its pages in any order, each page's last version, then edited."""

    def run(turns: list[dict]) -> list[tuple]:
        middle = len(turns) // 2
        pages = [(t["turn"], str(t["turn"]), *page_of(t)) for t in (*reversed(turns), *turns)]
        as_of = H.replayed(H.Context(), pages, before=turns[middle]["turn"], most_pairs=PAIRS, most_people=PEOPLE)
        edits = {as_of.people[0].key: None} if as_of.people else {}
        after = H.replayed(H.Context(), pages, turns[middle]["turn"], edits, most_pairs=PAIRS, most_people=PEOPLE)
        split = H.split_row(as_of.people, "c1")
        return [(turns[0]["conv_id"], turns[middle]["turn"], ",".join(map(_shown, as_of.people)), len(as_of.people) - len(after.people), len(split) - len(as_of.people))]

    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    return map_groups(c, "conv_id", ["turn", "role", "text"], run, "conv_id bigint, turn int, roster string, n_removed int, n_restored int")


QUERIES = {"context_ledger": context_ledger, "context_replay": context_replay}
ORACLES: dict[str, str] = {}
