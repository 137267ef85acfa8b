"""Pages whose boxes are split, merged and ordered as a whole, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions import blocks as B
from quillon.operators.grouped import map_groups
from quillon.sources.tables import boxes

PAGE = (800.0, 700.0)


def _rects(page: list[dict]) -> list[B.Box]:
    return [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in page]


def page_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box's rank in its page's whole reading order: panels are every third box, made larger; the others are text."""

    def run(page: list[dict]) -> list[tuple]:
        rects = _rects(page)
        panels = [(x1, y1, x1 + 3 * (x2 - x1), y1 + 4 * (y2 - y1)) for k, (x1, y1, x2, y2) in enumerate(rects) if k % 3 == 0]
        return [(page[0]["page_id"], page[i]["pos"], rank) for rank, i in enumerate(B.page_order(rects, panels, PAGE))]

    return map_groups(boxes(spark, sf_dir), "page_id", ["pos"], run, "page_id bigint, pos int, rank int", dealt=True)


def block_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each page's boxes are, taken as the texts of one box; specks above, and strokes beside a line, are told apart."""

    def run(page: list[dict]) -> list[tuple]:
        rects = _rects(page)
        outer = B.hull(rects)
        dust = [b for b in rects if B.area(b) < 1500]
        strokes = B.line_and_strokes(rects)
        parts = [s for part in B.split(outer, rects, 14.0) for s in B.specks(part, [b for b in rects if b not in dust], dust)]
        return [(page[0]["page_id"], k, *map(float, part), len(strokes[1]) if strokes else 0) for k, part in enumerate(parts)]

    return map_groups(boxes(spark, sf_dir), "page_id", ["pos"], run, "page_id bigint, part int, x1 double, y1 double, x2 double, y2 double, n_strokes int", dealt=True)


def tile_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each page found in two overlapping tiles, as one box each."""

    def run(page: list[dict]) -> list[tuple]:
        tiled = [(b["pos"] % 2, r, b["conf"]) for b, r in zip(page, _rects(page), strict=True)]
        return [(page[0]["page_id"], k, *map(float, r), sure) for k, (r, sure) in enumerate(B.merged_tiles(tiled))]

    return map_groups(boxes(spark, sf_dir), "page_id", ["pos"], run, "page_id bigint, n int, x1 double, y1 double, x2 double, y2 double, conf double", dealt=True)


QUERIES = {"page_reading": page_reading, "block_splits": block_splits, "tile_merges": tile_merges}
ORACLES: dict[str, str] = {}
