"""Rosters of people that pages mention: matching, merging, corrections, limits and the fold over pages.

Everything here is plain data in, plain data out, so that a grouped map can run it on one chapter's pages in order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from quillon.functions import rules as L
from quillon.functions import text as T

#: People and recent lines that a context keeps, by default.
MOST_PEOPLE, MOST_PAIRS = 10, 15
#: Rows that a merged row remembers.
REMEMBERED = 12
# How much each source of a row is worth, and what a name adds.
WORTH = {"user": 3, "vlm": 2, "speech": 1, "mention": 1}
NAMED = 10
# Words for each gender; those for M are looked for first, as the order in which they are read decides.
GENDER_WORDS = (("M", re.compile("male|ชาย|ผู้ชาย", re.IGNORECASE)), ("F", re.compile("female|หญิง|ผู้หญิง", re.IGNORECASE)))

_HONORIFIC = re.compile(L.HONORIFIC)
_JUNK, _LABEL = re.compile(T.JUNK), re.compile(f"(?:{T.NON_PERSON})", re.IGNORECASE)
_SPELLING = str.maketrans(L.LONG_VOWELS, L.SHORT_VOWELS)


def gender(word: str | None) -> str:
    word = word or ""
    if word.upper() in ("M", "F"):
        return word.upper()
    return next((g for g, pattern in GENDER_WORDS if pattern.search(word)), "?")


def is_label(text: str | None) -> bool:
    return bool(text) and _LABEL.fullmatch(text.strip()) is not None


def usable(text: str | None) -> str:
    """Trimmed text; empty if it is punctuation, a single letter or digit, or the label of a box."""
    text = (text or "").strip()
    single = len(text) == 1 and text.isascii() and text.isalnum()
    return "" if not text or single or _JUNK.fullmatch(text) or is_label(text) else text


def plain(text: str) -> str:
    """Lower case with single spaces for all but letters, numbers and marks."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in text.lower()).split())


def bigrams(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)} if len(text) > 1 else set(text)


def similar(a: str, b: str) -> bool:
    """Whether two descriptions are of one person; see `quillon.functions.text.similar`."""
    a, b = plain(a), plain(b)
    if not a or not b:
        return False
    words = [{w for w in t.split() if len(w) > 2} for t in (a, b)]
    if a == b or (all(words) and 2 * len(words[0] & words[1]) >= min(map(len, words))):
        return True
    short, long = (t.replace(" ", "") for t in sorted((a, b), key=len))
    if len(short) >= 10 and short in long:
        return True
    x, y = bigrams(short), bigrams(long)
    return len(short) >= 12 and 2 * len(x & y) >= 0.85 * (len(x) + len(y))


def bare(name: str) -> str:
    return _HONORIFIC.sub("", name).strip() or name


def same_person(a: str | None, b: str | None) -> bool:
    """Whether two names are one person's; see `quillon.functions.rules.same_person`."""
    if not a or not b:
        return False
    a, b = bare(a.lower().strip()), bare(b.lower().strip())
    if not a or not b:
        return False
    keys = ["".join(c for c in bare(x).lower().translate(_SPELLING) if unicodedata.category(c)[0] in "LNM") for x in (a, b)]
    few, many = sorted((set(a.split()), set(b.split())), key=len)
    return a == b or (len(keys[0]) >= 3 and keys[0] == keys[1]) or few <= many


def noted(*notes: str | None) -> str | None:
    """Notes in order, without those that an earlier one holds."""
    kept: list[str] = []
    for note in notes:
        note = (note or "").strip()
        if note and not any(note in k for k in kept):
            kept.append(note)
    return " · ".join(kept)[: L.NOTE_CHARS] or None


@dataclass(frozen=True)
class Person:
    desc: str = ""
    gender: str = "?"
    source: str = "vlm"
    id: str | None = None
    name: str | None = None
    full: str | None = None
    note: str | None = None
    absorbed: tuple = ()

    @property
    def key(self) -> str:
        return self.id or self.desc

    @property
    def rank(self) -> int:
        return (NAMED if self.name or self.full else 0) + WORTH[self.source]

    @property
    def label(self) -> str:
        return self.name or self.full or self.desc

    def snapshot(self) -> tuple:
        return self.desc, self.name, self.full, self.gender


def absorb(keep: Person, drop: Person) -> tuple:
    """What keep remembers once drop is part of it; rows of the same words leave no trace."""
    if (drop.desc, drop.name) == (keep.desc, keep.name):
        return keep.absorbed
    return (*keep.absorbed, drop.snapshot(), *drop.absorbed)[-REMEMBERED:]


def merged(a: Person, b: Person) -> Person:
    """One row of two: the user's own words stay, otherwise the longer look; gaps are filled from the other row."""
    keep, drop = (b, a) if b.source == "user" and a.source != "user" else (a, b)
    longer = drop.desc if len(drop.desc) > len(keep.desc) else keep.desc
    return Person(
        desc=(keep.desc or drop.desc) if keep.source == "user" else longer,
        gender=keep.gender if keep.gender != "?" else drop.gender,
        source=max((keep.source, drop.source), key=WORTH.__getitem__),
        id=keep.id or drop.id,
        name=keep.name or drop.name,
        full=keep.full or drop.full,
        note=noted(keep.note, drop.note),
        absorbed=absorb(keep, drop),
    )


def may_be_one(a: Person, b: Person) -> bool:
    """Whether two rows of a roster are to be folded without anyone asking for it."""
    users = (a.source == "user") + (b.source == "user")
    if users == 2 or (a.gender != b.gender and "?" not in (a.gender, b.gender)):
        return False
    names = a.name or a.full, b.name or b.full
    if all(names):
        return same_person(*names)
    if any(names):
        return same_person(names[0] or names[1], b.desc if names[0] else a.desc)
    return not users and similar(a.desc, b.desc)


def numbered(book: Iterable[Person]) -> list[Person]:
    """Rows without an id get the next ones after the largest, in order."""
    book = list(book)
    last = max((int(p.id[1:]) for p in book if p.id and re.fullmatch(r"c\d+", p.id)), default=0)
    out = []
    for p in book:
        last += not p.id
        out.append(p if p.id else replace(p, id=f"c{last}"))
    return out


def folded(book: Iterable[Person]) -> list[Person]:
    """Each row in turn joins the first earlier one that may be the same person."""
    rows: list[Person] = []
    for p in book:
        at = next((i for i, r in enumerate(rows) if may_be_one(r, p)), None)
        if at is None:
            rows.append(p)
        else:
            rows[at] = merged(rows[at], p)
    return rows


def tidied(book: Iterable[Person]) -> list[Person]:
    """Rows that say who someone is, folded and numbered; the user's rows stay whatever they say."""
    return numbered(folded(p for p in book if p.source == "user" or p.name or p.full or usable(p.desc)))


def limited(book: list[Person], most: int) -> list[Person]:
    """At most so many rows, without the lowest ranks, the earliest of these first; the user's rows always stay."""
    spare = sorted((i for i, p in enumerate(book) if p.source != "user"), key=lambda i: (book[i].rank, i))
    gone = set(spare[: max(0, len(book) - most)])
    return [p for i, p in enumerate(book) if i not in gone]


def place_of(book: list[Person], seen: Person) -> int | None:
    """The row that an observation is of: that of its id, else the first that is alike in look or name."""
    if seen.id and (own := next((i for i, p in enumerate(book) if p.id == seen.id), None)) is not None:
        return own
    theirs = (seen.name, seen.full)

    def alike(p: Person) -> bool:
        names = any(same_person(x, y) for x in (p.name, p.full) for y in theirs)
        return similar(p.desc, seen.desc) or names or same_person(p.name, seen.desc) or same_person(seen.name, p.desc)

    return next((i for i, p in enumerate(book) if alike(p)), None)


def observed(book: list[Person], seen: Person, most: int = MOST_PEOPLE) -> list[Person]:
    """The roster after an observation; a row's gender changes only where it was unknown or the new source is worth more."""
    book = numbered(book)
    at = place_of(book, seen)
    if at is None:
        return limited(numbered([*book, replace(seen, id=None)]), most)
    old = book[at]
    better = seen.gender != "?" and old.source != "user" and (old.gender == "?" or WORTH[seen.source] > WORTH[old.source])
    book[at] = replace(
        old,
        desc=old.desc if len(old.desc) >= len(seen.desc) else seen.desc,
        name=old.name or seen.name,
        full=old.full or seen.full,
        note=noted(old.note, seen.note),
        gender=seen.gender if better else old.gender,
        source=seen.source if better and WORTH[seen.source] >= WORTH[old.source] else old.source,
    )
    return book


def find(book: list[Person], ref: str | None, but: int | None = None) -> int | None:
    """The row that a reference means: an id, else equal words or a person alike."""
    ref = (ref or "").strip()
    rows = [(i, p) for i, p in enumerate(book) if i != but]
    if not ref:
        return None
    if re.fullmatch(r"c\d+", ref, re.IGNORECASE):
        own = next((i for i, p in rows if p.id and p.id.lower() == ref.lower()), None)
        if own is not None:
            return own
    return next((i for i, p in rows if ref in (p.name, p.full, p.desc) or same_person(p.name, ref) or same_person(p.full, ref) or similar(p.desc, ref)), None)


@dataclass(frozen=True)
class Mention:
    """Someone named on a page, or an order to change the roster: same_as, correct (with now) or note, the last two with a quote."""

    name: str | None = None
    id: str | None = None
    full: str | None = None
    gender: str = "?"
    desc: str = ""
    same_as: str | None = None
    correct: str | None = None
    now: str | None = None
    note: str | None = None
    why: str | None = None


# What an order may call the fields that it corrects.
FIELDS = {"g": "gender", "gender": "gender", "name": "name", "desc": "desc", "description": "desc", "full": "full", "fullname": "full"}


@dataclass
class Changes:
    """A roster under orders: what they did, and which of them."""

    book: list[Person]
    ops: list[tuple] = field(default_factory=list)
    done: set[int] = field(default_factory=set)

    def order(self, number: int, m: Mention) -> None:
        if not (m.name or m.id) or is_label(m.name):
            return
        op = self._join(m) if m.same_as else self._correct(m) if m.correct else self._note(m) if m.note else None
        if op:
            self.ops.append(op)
            self.done.add(number)

    def _row(self, m: Mention, but: int | None = None) -> int | None:
        at = find(self.book, m.id or m.name, but)
        return None if at is None or self.book[at].source == "user" else at

    def _join(self, m: Mention) -> tuple | None:
        source = find(self.book, m.same_as)
        if source is None or self.book[source].source == "user":
            return None
        target = self._row(m, source)
        if target is None:
            return None
        t, s = self.book[target], self.book[source]
        if t.gender != s.gender and "?" not in (t.gender, s.gender):
            return None
        known = next((g for g in (t.gender, s.gender, m.gender) if g != "?"), "?")
        one = replace(
            t, desc=t.desc if len(t.desc) >= len(s.desc) else s.desc, gender=known, source=max((t.source, s.source), key=WORTH.__getitem__), name=t.name or s.name, full=t.full or s.full,
            id=t.id or s.id, note=noted(noted(t.note, s.note), usable(m.desc)), absorbed=absorb(t, s),
        )
        self.book[target] = one
        del self.book[source]
        return "merge", s.label, t.label

    def _correct(self, m: Mention) -> tuple | None:
        what, now = FIELDS.get(m.correct.lower()), (m.now or "").strip()
        if not what or not now or not (m.why or "").strip():
            return None
        now = gender(now) if what == "gender" else now
        at = self._row(m)
        if at is None or (what == "gender" and now == "?") or (getattr(self.book[at], what) or "") == now:
            return None
        was = self.book[at]
        self.book[at] = replace(was, **{what: now})
        return "correct", was.label, what, getattr(was, what), now

    def _note(self, m: Mention) -> tuple | None:
        note, at = usable(m.note), self._row(m) if usable(m.note) and (m.why or "").strip() else None
        if at is None:
            return None
        was = self.book[at]
        self.book[at] = replace(was, note=noted(was.note, note))
        return "correct", was.label, "note", was.note, note


@dataclass(frozen=True)
class Line:
    """One region of a page: its source, its translation ("keep": none), and who says it."""

    source: str
    translation: str
    speaker: Person | None = None


@dataclass
class Context:
    people: list[Person] = field(default_factory=list)
    pairs: list[tuple[str, str, str | None]] = field(default_factory=list)


def speaker_of(book: list[Person], said: Person | None) -> str | None:
    """The id of the row that a line's speaker is."""
    if said is None:
        return None
    if said.id and any(p.id == said.id for p in book):
        return said.id
    name = usable(said.name) or None
    desc = usable(said.desc) or name
    at = place_of(book, Person(desc=desc, name=name)) if desc else None
    return None if at is None else book[at].id


def after_page(context: Context, lines: Iterable[Line], mentions: Iterable[Mention] = (), learn: bool = True, most_pairs: int = MOST_PAIRS, most_people: int = MOST_PEOPLE) -> tuple[Context, list[tuple]]:
    """The context after a page, and what its orders changed. Speakers are learned first, then orders, then names; lines are tagged last."""
    lines, mentions, book, ops = list(lines), list(mentions), list(context.people), []
    if learn:
        book = tidied(book)
        for said in (x.speaker for x in lines if x.speaker and x.translation != "keep"):
            desc, name = usable(said.desc), usable(said.name)
            known = said.id is not None and any(p.id == said.id for p in book)
            if desc or name or known:
                own = Person(desc=desc or name, gender=said.gender, source="speech" if "guess" in said.desc else "vlm", id=said.id if known else None, name=name or None)
                book = observed(book, own, most_people)
        changes = Changes(book)
        for i, m in enumerate(mentions):
            changes.order(i, m)
        book, ops = changes.book, changes.ops
        for i, m in enumerate(mentions):
            name = usable(m.name)
            if name and i not in changes.done and not is_label(m.desc):
                own = Person(gender=m.gender, source="mention", id=m.id, name=name, full=usable(m.full) or None, note=noted(usable(m.note), usable(m.desc)))
                book = observed(book, own, most_people)
    fresh = [(x.source, x.translation, speaker_of(book, x.speaker)) for x in lines if x.translation and x.translation != "keep"]
    pairs = [*context.pairs, *fresh]
    return Context(book, pairs[max(0, len(pairs) - most_pairs) :] if most_pairs else []), ops


def join_rows(book: list[Person], keep: str, drop: str) -> list[Person]:
    """A merge that the user asks for, by the rows' keys."""
    at = {p.key: i for i, p in reversed(list(enumerate(book)))}
    if keep == drop or keep not in at or drop not in at:
        return book
    out = list(book)
    out[at[keep]] = merged(out[at[keep]], out[at[drop]])
    del out[at[drop]]
    return out


def split_row(book: list[Person], key: str) -> list[Person]:
    """The rows that a merged row remembers, put back behind it as the user's own."""
    at = next((i for i, p in enumerate(book) if p.key == key), None)
    if at is None or not book[at].absorbed:
        return book
    row = book[at]
    back = [Person(desc=d, name=n, full=f, gender=g if g != "?" else row.gender, source="user") for d, n, f, g in row.absorbed]
    return [*book[:at], replace(row, absorbed=()), *back, *book[at + 1 :]]


def replayed(base: Context, pages: Iterable[tuple[int, str, list[Line], list[Mention]]], before: float = float("inf"), edits: dict[str, Person | None] | None = None, learn: bool = True, most_pairs: int = MOST_PAIRS, most_people: int = MOST_PEOPLE) -> Context:
    """The context as of a page: the base, then pages (order, id, lines, mentions) of lower order in turn, the last of each id, then edits by key."""
    last = {page[1]: page for page in pages}
    context = Context(list(base.people), list(base.pairs))
    for order, _, lines, mentions in sorted(last.values(), key=lambda p: (p[0], p[1])):
        if order < before:
            context, _ = after_page(context, lines, mentions, learn, most_pairs, most_people)
    for key, person in (edits or {}).items():
        at = next((i for i, p in enumerate(context.people) if p.key == key), None)
        if at is not None and person is None:
            del context.people[at]
        elif at is not None:
            context.people[at] = person
        elif person is not None:
            context.people.append(person)
    return context


def edited(before: list[Person], after: list[Person]) -> dict[str, Person | None]:
    """What changed between two rosters, by key; None where a row is gone."""
    old, new = ({p.key: p for p in rows} for rows in (before, after))
    return {k: new.get(k) for k in (*new, *(k for k in old if k not in new)) if old.get(k) != new.get(k)}
