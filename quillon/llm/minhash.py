"""Near-duplicate documents by b-bit MinHash.

One pass over the texts makes, of each document's set of word shingles, the minima of `ROWS` hash functions. Two bits of each
are kept and packed into 32 64-bit integers; groups of five whole minima give `BANDS` band keys. Equal texts are one
from here on. Documents that share a band key are candidates. The agreement of two packed signatures, counted in bits and
corrected for the 1 in 4 that agree by chance, estimates their similarity; candidates whose estimate is four standard
deviations too low are let go, all others are confirmed on the full sets of both texts.

Candidates are never all pairs of a band. First every document of a band is compared with the one of them that meets most others
over all bands. Where a band still holds documents of several components, those outside its largest component are compared with
all others of it, so no link between components is lost; links inside one component change nothing. They are compared in blocks
of bounded size, first by an eighth of the signature's places, then, where these agree enough, by all; only pairs that agree in
all leave a block, and their texts are compared. With
48 bands of 5 rows a pair of similarity 0.75 shares no band with probability 2e-6, and more similar ones less often; unrelated
texts, of which a large corpus has most, share one far less often than with shorter bands.

Joins have hot keys where many documents are near one: a band or a leader may be that of a third of all rows. These joins are
plain, with the hot side first, so that the adaptive skew join splits its partitions; what is copied to each part is one row a key.

Defined cases: null, empty and blank texts have no shingles and link with nothing; equal texts always link; rows that share a
doc_id count as one document; a null doc_id is kept and has no component; very long texts are read whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.components import components

from .common import discard, lean, materialise, table
from .words import Words, mix, parts, shingle_sets, utf8

BANDS, BAND_ROWS, ROWS, BITS = 48, 5, 1024, 2
#: Integers of a signature that a first look takes, an eighth of its places.
_FIRST_LANES = 4
SHARE = (75, 100)
SHINGLE = 5
_LANES = ROWS * BITS // 64
_LOW = 0x5555555555555555
_SEEDS = (mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima (rows x ROWS) of nonempty sets laid end to end, of 32 bits each."""
    values = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, ROWS), np.uint32)
    at = 0
    while at < len(offsets) - 1:  # pieces that stay in the processor's cache
        upto = max(int(np.searchsorted(offsets, offsets[at] + 32768, "right")) - 1, at + 1)
        own = values[offsets[at] : offsets[upto]]
        cut = offsets[at:upto] - offsets[at]
        product = np.empty_like(own)
        for j in range(ROWS):
            np.multiply(own, _SEEDS[j], out=product)
            out[at:upto, j] = np.minimum.reduceat(product, cut)
        at = upto
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of mixed minima, 16 to a 64-bit integer."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(len(least), _LANES, 64 // BITS) << shifts).sum(axis=2, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = least[:, : BANDS * BAND_ROWS].reshape(len(least), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(BAND_ROWS):
        key = mix(key ^ grouped[:, :, j]) * np.uint64(0x165667B19E3779F9)
    return key


_DIGEST = "doc_id bigint, content binary, n_shingles bigint, signature array<bigint>, bands array<bigint>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in parts(batch.column(1)):
            words = Words(*utf8(texts), lower=True)
            values, offsets, hashes = shingle_sets(words, SHINGLE)
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            first = words.first
            content = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            least = minima(values, offsets[np.append(some, len(size))] if len(some) else offsets[:1])
            lists = []
            for rows, width in ((packed(least), _LANES), (band_keys(least), BANDS)):
                ends = np.cumsum(np.where(size > 0, width, 0))
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rows.reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(content, pa.binary()), pa.array(size, pa.int64()), *lists], ["doc_id", "content", "n_shingles", "signature", "bands"])
            at += len(texts)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a 16-byte key of the word sequence, the set's size, the packed signature and the band keys."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(_digests), _DIGEST)


def agreement(left: str, right: str, lanes: int) -> Column:
    """In how many places the first integers of two packed signatures agree, by counting bits."""

    def apart(i: int) -> Column:
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))

    return F.lit(lanes * 64 // BITS) - reduce(lambda a, b: a + b, (apart(i) for i in range(lanes)))


def estimate(agreed: float | np.ndarray | Column, places: int) -> float | np.ndarray | Column:
    """The similarity that an agreement speaks for, corrected for places that agree by chance."""
    chance = 1 / (1 << BITS)
    return (agreed / places - chance) / (1 - chance)


def least_estimate(places: int) -> float:
    """What the estimate of a pair that is just similar enough exceeds but for four standard deviations."""
    agree = SHARE[0] / SHARE[1] + (1 - SHARE[0] / SHARE[1]) / (1 << BITS)
    return estimate(places * agree - 4 * (places * agree * (1 - agree)) ** 0.5, places)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        at = 0
        for left in parts(batch.column(2)):
            upto = at + len(left)
            a, ao = shingle_sets(Words(*utf8(left), lower=True), SHINGLE)[:2]
            ids, one, which = np.unique(batch.column(1).slice(at, upto - at).to_numpy(), return_index=True, return_inverse=True)
            sets: list = [None] * len(ids)  # one text, such as a leader's, stands in many pairs
            base = 0
            for texts in parts(batch.column(3).slice(at, upto - at).take(pa.array(one))):
                b, bo = shingle_sets(Words(*utf8(texts), lower=True), SHINGLE)[:2]
                sets[base : base + len(texts)] = [b[bo[k] : bo[k + 1]] for k in range(len(texts))]
                base += len(texts)
            for i in range(len(left)):
                x, y = a[ao[i] : ao[i + 1]], sets[which[i]]
                if min(len(x), len(y)) * SHARE[1] < SHARE[0] * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[at + i] = SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both) and both > 0
            at = upto
        keep = pa.array(linked)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of doc_ids those whose full sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    texts = materialise(own.join(wanted, "id", "left_semi"), "texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirmed), "a bigint, b bigint").distinct()


def similar(pairs: DataFrame, signed: DataFrame, lanes: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures, in so many integers, estimate a similarity that isn't too low."""
    own = F.slice("signature", 1, lanes) if lanes < _LANES else F.col("signature")
    left, right = (signed.select(F.col("node").alias(x), own.alias("s" + x)) for x in ("a", "b"))
    places = lanes * 64 // BITS
    return pairs.join(left, "a").join(right, "b").where(estimate(agreement("sa", "sb", lanes), places) >= least_estimate(places)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept, the component's smallest document."""
    rows = materialise(signatures(docs), "signatures")
    some = rows.where("content IS NOT NULL AND doc_id IS NOT NULL")
    texts = materialise(some.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "contents")
    signed = texts.select("node", "signature")

    members = texts.select("node", F.explode("bands").alias("band"))
    sizes = materialise(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    met = materialise(members.join(sizes, "band"), "met")
    # The document that meets most others is the one that the others are likest to, such as the text that all were made from.
    central = materialise(met.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    leaders = met.join(central, "node").groupBy("band").agg(F.max(F.struct("score", -F.col("node")))["col2"].alias("leader"))
    leaders = materialise(leaders.select("band", (-F.col("leader")).alias("leader")), "leaders")
    shared = materialise(met.select("band", "node").join(leaders, "band"), "shared")
    discard(sizes, met, central, leaders)
    pairs = shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    first = materialise(similar(pairs, signed, 2 * _FIRST_LANES), "pairs")
    links = materialise(confirm(first, docs), "links")
    root = materialise(components(links), "components")
    discard(first, links)

    # Bands that still hold several components: their smaller parts against all the rest.
    placed = materialise(shared.join(root, "node", "left").select("band", "leader", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band")
    mixed = materialise(placed.join(materialise(mixed, "mixed"), "band", "left_semi"), "mixed-members")
    discard(shared, placed)
    second = materialise(_across(mixed, texts.select("node", "signature", "bands")), "more-pairs")
    more = materialise(confirm(second, docs), "more-links")
    top = materialise(_joined(root, more), "components")
    discard(mixed, second, more, root)

    ids = texts.select("content", "node").join(top, "node", "left").select("content", F.coalesce("root", "node").alias("component_id"))
    ids = materialise(ids, "ids")
    discard(texts, top)
    out = rows.select("doc_id", "content", "n_shingles").join(ids, "content", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


#: Documents of one band that are compared at once: so many outside its largest component, with so many of all.
_BLOCK_OUT, _BLOCK_ALL = 1024, 2048


def _across(mixed: DataFrame, signed: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of a band's different components; mixed: band, leader, node and root of every document.

    Blocks of bounded size are compared by counting bits; only pairs whose whole signatures agree enough leave them, each in the first
    band that it shares.
    """
    counted = mixed.groupBy("band", "root").count()
    largest = counted.groupBy("band").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    largest = largest.select("band", "main", F.ceil((F.col("all") - F.col("most")) / _BLOCK_OUT).alias("outs"), F.ceil(F.col("all") / _BLOCK_ALL).alias("alls"))
    largest = materialise(largest, "largest")
    placed = materialise(mixed.join(largest, "band").join(signed, "node"), "mixed-nodes")

    def slot(n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(n)), F.col(n))

    every = F.sequence(F.lit(0).cast("bigint"), F.col("alls") - 1)
    outer = placed.where("root <> main").select("*", F.lit(True).alias("outer"), slot("outs").alias("o"), F.explode(every).alias("i"))
    inner = placed.select("*", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outs") - 1)).alias("o"), slot("alls").alias("i"))
    both = outer.unionByName(inner).select("band", "o", "i", "outer", "node", "root", "main", "leader", "signature", "bands")
    return both.groupBy("band", "o", "i").applyInArrow(_compared, "a bigint, b bigint").distinct()


def _most_apart(places: int) -> int:
    """In how many places two signatures may differ for their estimate not to be too low."""
    chance = 1 / (1 << BITS)
    return int(np.floor(places * (1 - chance - least_estimate(places) * (1 - chance))))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x ^ y
    return np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(_LOW))


def _compared(group: pa.Table) -> pa.Table:
    """Pairs of one block whose signatures agree enough."""
    outer = group.column("outer").to_numpy()
    signature = group.column("signature").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _LANES)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    node, root, band = group.column("node").to_numpy(), group.column("root").to_numpy(), group.column("band")[0].as_py()
    left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
    found = [np.zeros((0, 2), np.int64)]
    if len(left) and len(right):
        main, leader = group.column("main")[0].as_py(), group.column("leader")[0].as_py()
        right = right[node[right] != leader]  # every document was compared with it before
        left = left[node[left] != leader]
        first, every = (_most_apart(lanes * 64 // BITS) for lanes in (_FIRST_LANES, _LANES))
        b, rb, sb = node[right], root[right], np.ascontiguousarray(signature[right, :_FIRST_LANES].T)
        for at in range(0, len(left), 64):
            own = left[at : at + 64]
            a, ra = node[own], root[own]
            apart = np.zeros((len(own), len(b)), np.uint16)
            for lane in range(_FIRST_LANES):
                apart += _apart(signature[own, lane, None], sb[lane][None])
            i, j = np.nonzero((apart <= first) & (ra[:, None] != rb[None]) & ((rb[None] == main) | (a[:, None] > b[None])))
            for part in range(0, len(i), 1 << 14):
                x, y = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
                agree = _apart(signature[own[x]], signature[right[y]]).sum(axis=1, dtype=np.int64) <= every
                x, y = x[agree], y[agree]
                shared = np.argmax(bands[own[x]] == bands[right[y]], axis=1)
                here = bands[own[x], shared] == band
                found.append(np.stack([a[x[here]], b[y[here]]], axis=1))
    pairs = np.concatenate(found)
    return pa.table({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


def _joined(root: DataFrame, more: DataFrame) -> DataFrame:
    """Components with further links between them."""
    a, b = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(between)
    up = top.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = root.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return moved.unionByName(top)


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents over the whole table."""
    return near_duplicates(table(spark, sf_dir, "documents"))
