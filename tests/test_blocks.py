"""Whole pages on invented cases."""

from __future__ import annotations

import itertools
import random

from quillon.functions import blocks as B


def test_components_follow_links():
    assert B.components(5, lambda i, j: (i, j) in {(0, 3), (3, 4), (1, 2)}) == [[0, 3, 4], [1, 2]]


def test_far_blocks_split_and_near_lines_stay():
    lines = [(0, 0, 100, 20), (0, 25, 90, 45)]
    assert B.split((0, 0, 110, 300), lines, 10) == [(0, 0, 110, 300)]
    below = [(0, 200, 100, 220), (0, 225, 80, 245)]
    parts = B.split((0, 0, 110, 300), lines + below, 10)
    assert len(parts) == 2 and parts[0][3] <= parts[1][1] and parts[0][:3] == (0, 0, 100)


def test_twin_columns_need_an_avenue_and_rows_on_both_sides():
    left = [(0, y, 60, y + 10) for y in (0, 14, 28)]
    right = [(66, y, 120, y + 10) for y in (0, 14, 28)]
    assert B.split((0, 0, 120, 40), left + right, 30) == [(0, 0, 63, 38), (63, 0, 120, 38)]
    assert len(B.split((0, 0, 120, 40), [*left, *right, (10, 44, 110, 54)], 30)) == 1


def test_specks_far_above_are_their_own_part():
    text, dust = [(0, 100, 90, 112), (0, 116, 90, 128)], [(40, 2, 44, 6), (50, 2, 54, 6)]
    assert B.specks((0, 0, 100, 140), text, dust) == [(40, 2, 54, 53), (0, 53, 100, 140)]
    assert B.specks((0, 0, 100, 140), text, dust[:1]) == [(0, 0, 100, 140)]


def test_strokes_beside_a_line():
    line = [(k * 20, 50, k * 20 + 15, 65 + k) for k in range(4)]
    assert B.line_and_strokes([*line, (100, 0, 110, 120)]) == (line, [(100, 0, 110, 120)])
    assert B.line_and_strokes([*line, (100, 40, 180, 70)]) is None


def test_tiles_merge_until_nothing_touches():
    a, b, c = (0, (0, 0, 100, 50), 0.5), (1, (0, 54, 100, 90), 0.9), (0, (0, 95, 100, 120), 0.4)
    assert B.merged_tiles([a, b, c]) == [((0, 0, 100, 90), 0.9), ((0, 95, 100, 120), 0.4)]
    assert B.merged_tiles([a, b, (1, (0, 95, 100, 120), 0.4)]) == [((0, 0, 100, 120), 0.9)]


def test_order_without_panels():
    grid = [(0, 0, 40, 40), (60, 0, 100, 40), (0, 60, 40, 100), (60, 60, 100, 100)]
    assert B.ordered(grid) == [1, 0, 3, 2] and B.ordered(grid, right_to_left=False) == [0, 1, 2, 3]
    assert B.ordered([]) == [] and B.ordered([(0, 0, 1, 1)]) == [0]
    spread = [(x, y, x + 60, y + 30) for x in (0, 70, 500, 570) for y in (0, 50)]
    assert B.ordered(spread) == [6, 4, 7, 5, 2, 0, 3, 1]  # the right half is read to its end first
    family = [(0, 0, 50, 50), (60, 0, 110, 50), (0, 60, 50, 110), (60, 60, 110, 110)]
    assert B.ordered(family, siblings=[None, 7, None, 7]) == [1, 3, 0, 2]


def test_panels_are_read_one_after_the_other():
    page = (200.0, 300.0)
    panels = [(0, 0, 95, 140), (105, 0, 200, 140), (0, 150, 200, 300)]
    boxes = [(10, 10, 40, 30), (110, 100, 150, 120), (120, 10, 160, 30), (20, 160, 60, 180)]
    assert B.page_order(boxes, panels, page) == [2, 1, 0, 3]
    nested = [*panels, (110, 50, 190, 90)]
    assert B.page_order([*boxes, (120, 60, 160, 80)], nested, page) == [2, 4, 1, 0, 3]
    assert B.page_order(boxes, [], page) == B.ordered(boxes, True, page)


def test_gaps_between_panels_are_filled_where_texts_span_them():
    page, panels = (200.0, 300.0), [(0, 0, 200, 100)]
    assert B.filled_gaps([(10, 120, 60, 140), (120, 250, 190, 290)], panels, page) == [*panels, (0.0, 100, 200.0, 300.0)]
    assert B.filled_gaps([(10, 120, 60, 140)], panels, page) == panels


def test_strays_attach_to_the_nearest_block():
    block = [(0, 0, 50, 10), (0, 12, 50, 22)]
    assert B.attached([block, [(0, 30, 10, 40)], [(200, 200, 210, 210)], [(60, 0, 100, 30)]], 10) == [[*block, (0, 30, 10, 40)], [(200, 200, 210, 210)], [(60, 0, 100, 30)]]


def test_the_sure_core_of_a_group():
    near = lambda a, b: max(B.apart(a, b)) <= 5
    stands = lambda c: len(c) > 1
    text, tail = [(0, 0, 10, 10), (12, 0, 22, 10)], [(100, 0, 110, 10)]
    assert B.corroborated([*text, *tail], [True, True, False], near, stands) == [(0, 0, 22, 10)]
    assert B.corroborated([*text, *tail], [True, False, True], near, stands) is None
    assert B.corroborated(text, [True, True], near, stands) is None


def test_every_box_is_read_once():
    r = random.Random(3)
    for _ in range(200):
        boxes = [(x, y, x + r.randint(5, 120), y + r.randint(5, 90)) for x, y in ((r.randint(0, 600), r.randint(0, 500)) for _ in range(r.randint(0, 9)))]
        panels = [(x, y, x + r.randint(100, 500), y + r.randint(100, 400)) for x, y in ((r.randint(0, 400), r.randint(0, 300)) for _ in range(r.randint(0, 4)))]
        assert sorted(B.page_order(boxes, panels, (800.0, 700.0))) == list(range(len(boxes)))
        merged = B.merged_tiles([(i % 2, b, 0.5) for i, b in enumerate(boxes)])
        assert all(any(B.both(b, m) == B.area(b) for m, _ in merged) for b in boxes)
        for a, b in itertools.pairwise(B.split((0, 0, 800, 700), boxes, 10)) if boxes else ():
            assert B.both(a, b) == 0
