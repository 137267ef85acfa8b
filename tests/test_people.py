"""Rosters and context folds on invented cases."""

from __future__ import annotations

from quillon.functions import people as H
from quillon.operators import ledger

P, M, L = H.Person, H.Mention, H.Line


def test_words_of_gender_keep_their_order():
    assert [H.gender(w) for w in ("m", "F", "male", "female", "หญิง", "ชาย", None, "x")] == ["M", "F", "M", "M", "F", "M", "?", "?"]


def test_usable_text():
    assert [H.usable(t) for t in (" ? ", "B", "caption", "ป้าย", "a cat ", None)] == ["", "", "", "", "a cat", ""]


def test_similar_and_same_person():
    assert H.similar("girl with red ribbon", "red ribbon") and not H.similar("alpha1", "alpha2") and not H.similar("", "x")
    assert H.same_person("Ada-san", "ada") and H.same_person("Ada Byron", "Byron") and H.same_person("ยูซุรุ", "ยุซุรุ") and not H.same_person("Ada", None)


def test_folding_is_into_the_first_row_that_fits_and_blocked_by_gender():
    book = [P("tall man", name="Ada", gender="F"), P("Ada"), P("other", name="Ada", gender="M"), P("tall man hat"), P("??"), P("", source="user")]
    got = H.tidied(book)
    assert [(p.id, p.label, p.gender) for p in got] == [("c1", "Ada", "F"), ("c2", "Ada", "M"), ("c3", "tall man hat", "?"), ("c4", "", "?")]
    assert got[0].absorbed == (("Ada", None, None, "?"),)


def test_merge_keeps_user_rows_and_split_undoes_it():
    book = [P("long look of hers", id="c1", name="Ada"), P("x", id="c2", source="user", gender="F")]
    one = H.join_rows(book, "c1", "c2")
    assert [(p.id, p.desc, p.source, p.gender, p.name) for p in one] == [("c2", "x", "user", "F", "Ada")]
    back = H.split_row(one, "c2")
    assert [(p.desc, p.name, p.source) for p in back] == [("x", "Ada", "user"), ("long look of hers", "Ada", "user")]
    assert H.split_row(book, "c1") == book and H.join_rows(book, "c1", "c9") == book


def test_limit_evicts_the_lowest_rank_first_and_never_the_users():
    book = [P("a", source="user"), P("b", name="B"), P("c"), P("d", source="speech")]
    assert [p.desc for p in H.limited(book, 2)] == ["a", "b"]
    assert len(H.limited([P(source="user")] * 4, 2)) == 4


def test_observation_fills_and_upgrades():
    book = H.observed([], P("boy with hat", source="speech"))
    book = H.observed(book, P("boy with hat and scarf", name="Bo", gender="M"))
    assert [(p.id, p.desc, p.name, p.gender, p.source) for p in book] == [("c1", "boy with hat and scarf", "Bo", "M", "vlm")]
    book = H.observed(book, P("", name="Bo-kun", gender="F", source="mention", note="brother"))
    assert (book[0].gender, book[0].note) == ("M", "brother")


def test_orders_need_quotes_and_leave_user_rows_alone():
    book = [P("a", id="c1", name="Ada"), P("b", id="c2", name="Bea", gender="F"), P("u", id="c3", name="Uma", source="user")]
    changes = H.Changes(list(book))
    for i, m in enumerate([M(id="c1", same_as="c2"), M(name="Ada", correct="name", now="Ann"), M(name="Ada", correct="desc", now="tall", why="he is tall"), M(id="c3", note="queen", why="x"), M(name="Ada", note="doctor", why="says so"), M(name="caption", same_as="c1")]):
        changes.order(i, m)
    assert changes.done == {0, 2, 4} and [op[0] for op in changes.ops] == ["merge", "correct", "correct"]
    assert [(p.id, p.desc, p.gender, p.note) for p in changes.book] == [("c1", "tall", "F", "doctor"), ("c3", "u", "?", None)]


def test_pages_fold_in_order_and_tag_lines_after_learning():
    said = P("girl with red ribbon", gender="F")
    context, ops = H.after_page(H.Context(), [L("s", "hello", said), L("s2", "keep", P("boy")), L("", "sign")], [M(name="Ada", desc="teacher"), M(name="narration")])
    assert [(p.id, p.label) for p in context.people] == [("c1", "girl with red ribbon"), ("c2", "Ada")] and context.people[1].note == "teacher"
    assert context.pairs == [("s", "hello", "c1"), ("", "sign", None)] and not ops
    quiet, _ = H.after_page(context, [L("x", "y", P("stranger in black"))], learn=False, most_pairs=2)
    assert quiet.people == context.people and quiet.pairs == [("", "sign", None), ("x", "y", None)]


def test_replay_is_as_of_and_by_the_last_version():
    pages = [(2, "b", [L("2", "two")], []), (1, "a", [L("0", "old")], []), (1, "a", [L("1", "one")], [M(name="Ada")]), (3, "c", [L("3", "three")], [])]
    assert [p[1] for p in H.replayed(H.Context(), pages, before=3).pairs] == ["one", "two"]
    edits = H.edited(H.replayed(H.Context(), pages).people, [])
    assert edits == {"c1": None} and H.replayed(H.Context(), pages, edits=edits).people == []


def test_ledger_rows():
    turns = [{"conv_id": 1, "turn": i, "role": "user", "text": t} for i, t in enumerate(["Alda meets Boris. Yes", None, "Alda again"])]
    rows = ledger.fold(turns)
    assert [r[2] for r in rows] == ["", "c1:Alda:F,c2:Boris:M", rows[2][2]] and rows[0][3] == 2
