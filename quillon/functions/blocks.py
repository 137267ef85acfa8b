"""Rectangles of one page as plain data: splitting, merging and ordering whose steps depend on each other.

A page has at most some hundred boxes, so every function takes lists and a grouped map runs it page by page. Boxes are (x1, y1, x2, y2).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

Box = tuple[float, float, float, float]

# Gaps and shares that decide whether boxes are one block of text.
TWO_BLOCKS, OF_MEDIAN, DEEP = 2.0, 0.8, 3.0
AVENUE, SIDE, SPAN, GLYPHS = 4.0, 2, 16.0, 1.5
SPECK_GAP, SPECK_HEIGHTS = 40.0, 2.0
LINE_RATIO, OUTLIER, WIDE = 1.5, 1.6, 1.2
SEAM, SEAM_SHARE = 8.0, 0.5
PANEL_SHARE, INSIDE, UNCOVERED, HELD = 0.1, 0.7, 0.5, 0.9
FAMILY_GAP, SMALL, CLUSTER = 96.0, 0.005, 0.05
ROWS, COLUMNS, BANNER = 0.25, 0.5, 0.9


def hull(boxes: Iterable[Box]) -> Box:
    xs1, ys1, xs2, ys2 = zip(*boxes, strict=True)
    return min(xs1), min(ys1), max(xs2), max(ys2)


def area(b: Box) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def shared(a: Box, b: Box, axis: int) -> float:
    """Signed overlap on one axis."""
    return min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])


def both(a: Box, b: Box) -> float:
    return max(0.0, shared(a, b, 0)) * max(0.0, shared(a, b, 1))


def apart(a: Box, b: Box) -> tuple[float, float]:
    return max(0.0, -shared(a, b, 0)), max(0.0, -shared(a, b, 1))


def upper_median(values: Iterable[float]) -> float:
    ranked = sorted(values)
    return ranked[len(ranked) // 2]


def minor(b: Box) -> float:
    return min(b[2] - b[0], b[3] - b[1])


def components(n: int, linked: Callable[[int, int], bool]) -> list[list[int]]:
    """Groups of 0 to n - 1 that links join, each in order, by their first member."""
    label = list(range(n))
    for j in range(n):
        joined = {label[i] for i in range(j) if linked(i, j)}
        if joined:
            least = min(joined)
            label = [least if x in joined or i == j else x for i, x in enumerate(label)]
    return [[i for i in range(n) if label[i] == k] for k in sorted(set(label))]


def runs(boxes: Sequence[Box], axis: int, gap: float) -> list[list[Box]]:
    """Boxes along an axis in runs, which end where the next box begins at least so far behind all before it."""
    out: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: b[axis]):
        if out and b[axis] - max(x[axis + 2] for x in out[-1]) < gap:
            out[-1].append(b)
        else:
            out.append([b])
    return out


def wide_gaps(boxes: Sequence[Box], same_block: float) -> tuple[int, list[Box]] | None:
    """Axis and parts of a box whose texts are far apart: down first, then across. Neighbours that share the other axis stay together unless
    the gap is deep."""
    for axis in (1, 0):
        least = max(TWO_BLOCKS * same_block, OF_MEDIAN * upper_median(b[axis + 2] - b[axis] for b in boxes))
        parts = [hull(r) for r in runs(boxes, axis, least)]
        whole: list[Box] = []
        for part in parts:  # a part joins the one before it as long as that one, as it has grown, faces it closely
            if whole and shared(whole[-1], part, 1 - axis) > 0 and part[axis] - whole[-1][axis + 2] < DEEP * least:
                whole[-1] = hull((whole[-1], part))
            else:
                whole.append(part)
        if len(whole) > 1:
            return axis, whole
    return None


def twin_columns(outer: Box, boxes: Sequence[Box]) -> tuple[float, list[Box]] | None:
    """The avenue down a box that no text crosses and that has lines of several rows on both sides, with the two sides."""
    inside = [(max(b[0], outer[0]), b[1], min(b[2], outer[2]), b[3]) for b in boxes]
    unit = upper_median(map(minor, boxes))
    lines = lambda side: [b for b in side if b[2] - b[0] > b[3] - b[1] and b[2] - b[0] >= GLYPHS * unit]
    solid = [b for b in inside if b[2] > b[0]]
    edge = [outer[0], *(max(b[2] for b in run) for run in runs(solid, 0, 1e-9))]
    begin = [*(run[0][0] for run in runs(solid, 0, 1e-9)), outer[2]]
    for a, b in zip(edge, begin, strict=True):
        middle = (a + b) / 2
        left, right = [x for x in inside if x[2] <= middle], [x for x in inside if x[0] >= middle]
        texts = lines(left), lines(right)
        if b - a < AVENUE or min(map(len, texts)) < SIDE:
            continue
        rows = max(SPAN, 2 * upper_median(x[3] - x[1] for side in texts for x in side))
        if all(h[3] - h[1] >= rows for h in map(hull, texts)):
            return middle, [hull(left), hull(right)]
    return None


def cut(outer: Box, parts: Sequence[Box], axis: int, cap: float = 40.0) -> list[Box]:
    """A box as its parts: each reaches half the gap towards its neighbours, at most cap, and never over the middle of a gap."""
    middles = [(a[axis + 2] + b[axis]) / 2 for a, b in zip(parts, parts[1:], strict=False)]
    out = []
    for i, part in enumerate(parts):
        own = [max(outer[0], part[0]), max(outer[1], part[1]), min(outer[2], part[2]), min(outer[3], part[3])]
        if i:
            half = min(cap, (part[axis] - parts[i - 1][axis + 2]) // 2)
            own[axis] = max(own[axis] - half, math.floor(middles[i - 1] + 0.5))
        if i < len(middles):
            half = min(cap, (parts[i + 1][axis] - part[axis + 2]) // 2)
            own[axis + 2] = min(own[axis + 2] + half, math.floor(middles[i] + 0.5))
        out.append(tuple(own))
    return out


def split(outer: Box, boxes: Sequence[Box], same_block: float) -> list[Box]:
    """The blocks of text in a box: far apart ones, else two columns with an avenue between them, else the box itself."""
    if len(boxes) < 2:
        return [outer]
    if found := wide_gaps(boxes, same_block):
        return cut(outer, found[1], found[0])
    if found := twin_columns(outer, boxes):
        return cut(outer, found[1], 0)
    return [outer]


def specks(outer: Box, texts: Sequence[Box], dust: Sequence[Box]) -> list[Box]:
    """A box in two where a cluster of specks is far above its text; else the box."""
    own = [b for b in texts if centred(outer, b)]
    if not own:
        return [outer]
    top = min(b[1] for b in own)
    gate = max(SPECK_GAP, SPECK_HEIGHTS * upper_median(b[3] - b[1] for b in own))
    above = [b for b in dust if centred(outer, b) and b[3] <= top - gate]
    if len(above) < 2:
        return [outer]
    at = math.floor((max(b[3] for b in above) + top) / 2 + 0.5)
    if not outer[1] + 4 < at < outer[3] - 4:
        return [outer]
    h = hull(above)
    return [(max(outer[0], h[0]), max(outer[1], h[1]), min(outer[2], h[2]), at), (outer[0], at, outer[2], outer[3])]


def centred(outer: Box, b: Box) -> bool:
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return outer[0] <= x <= outer[2] and outer[1] <= y <= outer[3]


def line_and_strokes(boxes: Sequence[Box]) -> tuple[list[Box], list[Box]] | None:
    """A line of text of like heights and the much taller strokes beside it; None where there is no such line or no such stroke."""
    high = lambda b: b[3] - b[1] + 1
    ranked = sorted(boxes, key=high)
    windows = [[b for b in ranked[i:] if high(b) <= LINE_RATIO * high(a)] for i, a in enumerate(ranked)]
    line = max(windows, key=len, default=[])
    if len(boxes) < 4 or len(line) < 3 or len(runs(line, 1, 1e-9)) > 1:
        return None
    tallest = max(map(high, line))
    rest = [b for b in boxes if b not in line]
    strokes = [b for b in rest if b[2] - b[0] < WIDE * (b[3] - b[1])]
    if not any(high(b) >= OUTLIER * tallest for b in strokes):
        return None
    return [*line, *(b for b in rest if b not in strokes)], strokes


def merged_tiles(tiles: Sequence[tuple[int, Box, float]]) -> list[tuple[Box, float]]:
    """Boxes (tile, box, sureness) of overlapping tiles as one each: two of different tiles that touch along half of a side are one, again
    and again, since the union may touch others."""
    todo = list(tiles)

    def touch(a: tuple, b: tuple) -> bool:
        gaps, least = apart(a[1], b[1]), min(minor(a[1]), minor(b[1]))
        along = max(shared(a[1], b[1], 0), shared(a[1], b[1], 1), 0.0)
        return a[0] != b[0] and max(gaps) <= SEAM and along >= SEAM_SHARE * least

    i = 0
    while i < len(todo):
        j = next((j for j in range(i + 1, len(todo)) if touch(todo[i], todo[j])), None)
        if j is None:
            i += 1
        else:
            a, b = todo[i], todo.pop(j)
            todo[i] = (a[0], hull((a[1], b[1])), max(a[2], b[2]))
            i = 0  # a grown box may touch one that was passed over
    return [(b, sure) for _, b, sure in todo]


def deferred(boxes: Sequence[Box], page: tuple[float, float]) -> set[int]:
    """Small boxes with another small one near by."""
    small = [i for i, b in enumerate(boxes) if area(b) < SMALL * page[0] * page[1]]
    reach = CLUSTER * math.hypot(*page)
    return {i for i in small for j in small if i != j and math.hypot(*apart(boxes[i], boxes[j])) < reach}


def corridor(boxes: Sequence[Box]) -> float | None:
    """Where the widest empty corridor down the middle runs that parts a spread into two groups which face each other."""
    x1, y1, x2, y2 = hull(boxes)
    w, h, usual = x2 - x1, y2 - y1, upper_median(b[2] - b[0] for b in boxes)
    tall = all(b[3] - b[1] >= 1.2 * (b[2] - b[0]) for b in boxes)
    if w <= 0 or h <= 0 or not ((w >= 1.8 * h and w >= 3 * usual) or (tall and w >= 2.5 * usual)):
        return None
    edges = sorted({x for b in boxes for x in (b[0], b[2])})
    best: tuple[float, float] | None = None
    for a, b in zip(edges, edges[1:], strict=False):
        x = (a + b) / 2
        left, right = [c for c in boxes if c[2] <= x], [c for c in boxes if c[0] >= x]
        if not x1 + 0.3 * w <= x <= x1 + 0.7 * w or min(len(left), len(right)) < 2 or len(left) + len(right) < len(boxes):
            continue
        gap = min(x - max(c[2] for c in left), min(c[0] for c in right) - x)
        facing = all(any(shared(c, d, 1) > 0 for d in other) for side, other in ((left, right), (right, left)) for c in side)
        if facing and gap >= max(0.5 * usual, 0.02 * w) and (best is None or gap > best[0]):
            best = gap, x
    return best and best[1]


def ordered(boxes: Sequence[Box], right_to_left: bool = True, page: tuple[float, float] | None = None, siblings: Sequence[int | None] | None = None) -> list[int]:
    """Places of boxes in reading order: a spread's halves by themselves, bands downwards, labels at a band's end, columns from the reading
    side; near siblings follow the first of them."""
    order = _ordered(list(range(len(boxes))), boxes, right_to_left, page)
    for family in sorted({s for s in siblings or [] if s is not None}):
        own = [i for i in order if siblings[i] == family]
        gaps = [apart(boxes[a], boxes[b]) for a, b in zip(own, own[1:], strict=False)]
        if all((min(g) if min(g) > 0 else max(g)) <= FAMILY_GAP for g in gaps):
            at = order.index(own[0])
            order = [i for i in order[:at] if i not in own] + own + [i for i in order[at:] if i not in own]
    return order


def _ordered(own: list[int], boxes: Sequence[Box], right_to_left: bool, page: tuple[float, float] | None) -> list[int]:
    if len(own) < 2:
        return own
    if (x := corridor([boxes[i] for i in own])) is not None:
        halves = [[i for i in own if boxes[i][0] >= x], [i for i in own if boxes[i][2] <= x]]
        return [i for half in (halves if right_to_left else halves[::-1]) for i in _ordered(half, boxes, right_to_left, page)]
    centre = lambda i: (boxes[i][1] + boxes[i][3]) / 2
    step = max(1.0, 0.5 * upper_median(boxes[i][3] - boxes[i][1] for i in own))
    bands: list[list[int]] = []
    for i in sorted(own, key=centre):
        if bands and centre(i) - centre(bands[-1][-1]) <= step:
            bands[-1].append(i)
        else:
            bands.append([i])
    out = []
    for band in bands:
        late = deferred([boxes[i] for i in band], page) if page else set()
        for part in ([i for k, i in enumerate(band) if k not in late], [i for k, i in enumerate(band) if k in late]):
            out += _columns(part, boxes, right_to_left)
    return out


def _columns(band: list[int], boxes: Sequence[Box], right_to_left: bool) -> list[int]:
    heads: list[int] = []
    for i in sorted(band, key=lambda i: -boxes[i][2] if right_to_left else boxes[i][0]):
        if not any(shared(boxes[i], boxes[h], 0) > 0 for h in heads):
            heads.append(i)
    column = {i: next(k for k, h in enumerate(heads) if h == i or shared(boxes[i], boxes[h], 0) > 0) for i in band}
    return sorted(band, key=lambda i: (column[i], boxes[i][1], -boxes[i][0] if right_to_left else boxes[i][0]))


def panel_order(panels: Sequence[Box], right_to_left: bool = True, page: tuple[float, float] | None = None) -> list[int]:
    """Panels in reading order: rows that overlap in height, columns in them that overlap in width; a banner joins a row only at its level."""

    def row(i: int, j: int) -> bool:
        a, b = panels[i], panels[j]
        least = min(a[3] - a[1], b[3] - b[1])
        banner = page is not None and max(a[2] - a[0], b[2] - b[0]) >= BANNER * page[0]
        return max(0.0, shared(a, b, 1)) >= ROWS * least and not (banner and abs(a[1] - b[1]) > ROWS * least)

    out = []
    for own in sorted(components(len(panels), row), key=lambda r: min(panels[i][1] for i in r)):
        column = lambda i, j, own=own: max(0.0, shared(panels[own[i]], panels[own[j]], 0)) >= COLUMNS * min(panels[own[i]][2] - panels[own[i]][0], panels[own[j]][2] - panels[own[j]][0])
        columns = [[own[k] for k in c] for c in components(len(own), column)]
        columns.sort(key=lambda c: -max(panels[i][2] for i in c) if right_to_left else min(panels[i][0] for i in c))
        out += [i for c in columns for i in sorted(c, key=lambda i: panels[i][1])]
    return out


def panels_usable(panels: Sequence[Box], page: tuple[float, float]) -> bool:
    return 0 < len(panels) <= 25 and max(map(area, panels)) >= PANEL_SHARE * page[0] * page[1]


def filled_gaps(boxes: Sequence[Box], panels: Sequence[Box], page: tuple[float, float]) -> list[Box]:
    """Panels with empty rectangles of a panel's size added where several uncovered texts span them, those that hold most first."""
    least = PANEL_SHARE * page[0] * page[1]
    bare = [b for b in boxes if not any(centred(p, b) or both(p, b) >= UNCOVERED * area(b) for p in panels)]
    edges = sorted({0.0, page[0], *(x for p in panels for x in (p[0], p[2]))})
    room: list[Box] = []
    for k, a in enumerate(edges):
        for b in edges[k + 1 :]:
            y = 0.0
            for p in [*sorted((p for p in panels if p[0] < b and p[2] > a), key=lambda p: p[1]), (0, page[1], 0, page[1])]:
                if (b - a) * (p[1] - y) >= least:
                    room.append((a, y, b, p[1]))
                y = max(y, p[3])
    added: list[Box] = []
    while len(bare) >= 2:
        best = None
        for gap in room:
            held = [b for b in bare if both(gap, b) >= HELD * area(b)]
            if len(held) >= 2 and area(hull(held)) >= least and all(both(gap, other) == 0 for other in added):
                rank = (len(held), -area(gap))
                best = (rank, gap, held) if best is None or rank > best[0] else best
        if best is None:
            break
        added.append(best[1])
        bare = [b for b in bare if b not in best[2]]
    return [*panels, *added]


def page_order(boxes: Sequence[Box], panels: Sequence[Box], page: tuple[float, float], right_to_left: bool = True) -> list[int]:
    """Places of boxes in reading order by panels: each in its smallest panel, panels in each other read where they stand, gaps filled; by
    bands alone where the panels are of no use."""
    if not panels_usable(panels, page):
        return ordered(boxes, right_to_left, page)
    panels = filled_gaps(boxes, panels, page)
    parent: dict[int, int | None] = {}
    for c, own in enumerate(panels):
        holders = [(area(p), i) for i, p in enumerate(panels) if i != c and both(own, p) >= INSIDE * area(own) and (area(p), -i) > (area(own), -c)]
        parent[c] = min(holders)[1] if holders else None
    home = [_home(b, panels) for b in boxes]

    def inside(k: int) -> list[int]:
        own = [i for i, h in enumerate(home) if h == k]
        nested = [c for c, p in parent.items() if p == k]
        late = deferred([boxes[i] for i in own], page) if not nested else set()
        sizes = [[area(boxes[i]) for n, i in enumerate(own) if (n in late) == small] for small in (True, False)]
        sink = late and sizes[1] and max(sizes[0]) < min(sizes[1])
        groups = [[n for n in range(len(own)) if n not in late], sorted(late)] if sink else [list(range(len(own) + len(nested)))]
        rects = [boxes[i] for i in own] + [panels[c] for c in nested]
        out: list[int] = []
        for group in groups:
            for n in ordered([rects[g] for g in group], right_to_left, page if sink else None):
                g = group[n]
                out += [own[g]] if g < len(own) else inside(nested[g - len(own)])
        return out

    roots = [k for k, p in parent.items() if p is None]
    return [i for n in panel_order([panels[k] for k in roots], right_to_left, page) for i in inside(roots[n])]


def _home(b: Box, panels: Sequence[Box]) -> int:
    holding = [(area(p), i) for i, p in enumerate(panels) if centred(p, b)]
    if holding:
        return min(holding)[1]
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return min(range(len(panels)), key=lambda i: (max(panels[i][0] - x, 0, x - panels[i][2]) ** 2 + max(panels[i][1] - y, 0, y - panels[i][3]) ** 2, i))


def attached(clusters: Sequence[Sequence[Box]], usual: float) -> list[list[Box]]:
    """Clusters of text with stray ones attached to the nearest block: within 1.2 usual heights, dust within three; lettering stays alone."""

    def extent(c: Sequence[Box]) -> float:
        main = [b for b in c if b[3] - b[1] > 0.7 * usual] or list(c)
        return max(b[3] for b in main) - min(b[1] for b in main)

    lettering = lambda b: b[3] - b[1] >= 2.5 * usual and b[2] - b[0] >= 1.8 * usual
    blocks = [list(c) for c in clusters if len(c) > 1 and extent(c) >= 1.8 * usual]
    for c in clusters:
        if len(c) > 1 and extent(c) >= 1.8 * usual:
            continue
        reach = (3.0 if any(b[3] - b[1] <= 0.5 * usual for b in c) else 1.2) * usual
        distance = [min(math.hypot(*apart(a, b)) for a in c for b in block) for block in blocks]
        near = min(range(len(blocks)), key=distance.__getitem__, default=None)
        if near is None or distance[near] > reach or (len(c) == 1 and lettering(c[0])):
            blocks.append(list(c))
        else:
            blocks[near] += c
    return blocks


def corroborated(boxes: Sequence[Box], sure: Sequence[bool], linked: Callable[[Box, Box], bool], stands: Callable[[list[Box]], bool]) -> list[Box] | None:
    """Of a group the clusters that a model also found, if no other cluster could stand alone and the sure ones are more than one box."""
    parts = [[b for b, s in zip(boxes, sure, strict=True) if s == known] for known in (True, False)]
    if not all(parts):
        return None
    sure_ones, others = ([[part[i] for i in c] for c in components(len(part), lambda i, j, part=part: linked(part[i], part[j]))] for part in parts)
    core = [hull(c) for c in sure_ones if stands(c)]
    return core if core and len(parts[0]) > 1 and not any(map(stands, others)) else None
