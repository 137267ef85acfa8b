"""Exact removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest of the hashes of its GRAM-word grams, where grams that are
very common count as larger than all others. Consecutive windows of a text with one minimiser travel together, as one packed
string of their words, to the minimiser's bucket. All windows with equal words have the same minimiser and so meet in one
bucket, where sorting their 128-bit hashes counts them; which ones are repeated goes back to their documents as word ranges.

Strings of which all words occur twice in one batch of a task are known to be repeated there: they are sent once, so a group of copies sends
about one string a task however large it is. Buckets are as many as the input needs. Common grams, which would fill one bucket,
are counted first, and at most `COMMON` of them kept: that choice moves work between buckets but changes no result.

A bucket that still grows large, such as that of a gram just short of common, is counted in several passes of bounded memory.

Defined cases: null texts have no words; texts below WINDOW words lose none; very long texts are cut into strings like others; rows alike in doc_id and text are each returned and
count as repeating one another; null doc_ids are kept; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, table
from .words import Words, chained, mix, parts, utf8

WINDOW, GRAM = 35, 8
#: Common grams that are passed over as minimisers, at most; a gram is common from this many occurrences in one batch on.
COMMON, COMMON_COUNT = 65_536, 16
#: Words that a bucket holds, about, and windows of one packed string at most.
BUCKET_WORDS, LONGEST = 1_000_000, 512
#: Bytes of text that a task looks at together, and bytes of strings whose windows are counted in one pass over a bucket.
SLICE_BYTES, PASS_BYTES = 1 << 23, 1 << 25
_TOP = np.uint64(1 << 63)
_P1, _P2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def rolled(values: np.ndarray, k: int, p: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of k values, with the odd base p."""
    out = np.empty(max(len(values) - k + 1, 0), np.uint64)
    inverse = pow(p, -1, 1 << 64)
    block = 1 << 16
    powers = np.cumprod(np.full(block + k, np.uint64(p), np.uint64))
    backs = np.cumprod(np.full(block + k, np.uint64(inverse), np.uint64))
    for at in range(0, len(out), block):
        upto = min(at + block, len(out))
        own = values[at : upto + k - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * powers[: len(own)], out=sums[1:])
        out[at:upto] = mix((sums[k:] - sums[:-k]) * backs[: upto - at])
    return out


def _windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every window of k words that lies in one row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def common_grams(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the commonest grams, sorted, and the number of words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for texts in parts(batch.column(0), SLICE_BYTES):
                words = Words(*utf8(texts), lower=False)
                total += len(words.starts)
                _, at = _windows(words.first, GRAM)
                grams, n = np.unique(chained(words.hashes(), GRAM)[at], return_counts=True)
                often = n >= COMMON_COUNT
                yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often], pa.int64())], ["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["gram", "n"])

    counted = materialise(docs.select("text").mapInArrow(lean(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.where("gram IS NULL").collect()
    top = counted.where("gram IS NOT NULL").orderBy(F.desc("n"), "gram").limit(COMMON).select("gram").collect()
    return np.sort(np.array([r.gram for r in top], np.int64).view(np.uint64)), int(total[0].n or 0) if total else 0


_PACKED = "bucket int, ids binary, hashes binary, starts binary, sent binary, lengths binary, data binary, ranges binary"
_NAMES = ["bucket", "ids", "hashes", "starts", "sent", "lengths", "data", "ranges"]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of rows, with those that touch or overlap made one; sorted by row and begin, ends not decreasing in a row."""
    if not len(row):
        return row, begin, end
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    at = np.flatnonzero(fresh)
    return row[at], begin[at], np.maximum.reduceat(end, at)


def _packer(common: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            at = 0
            for texts in parts(batch.column(2), SLICE_BYTES):
                ids = np.nan_to_num(batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)).astype(np.int64)
                hashes = batch.column(1).slice(at, len(texts)).to_numpy(zero_copy_only=False)
                at += len(texts)
                words = Words(*utf8(texts), lower=False)
                value = words.hashes()
                row, first = _windows(words.first, WINDOW)
                if not len(row):
                    continue
                grams = chained(value, GRAM)
                grams = (grams >> np.uint64(1)) | np.where(_in_sorted(grams, common), _TOP, np.uint64(0))
                least = _sliding_least(grams, WINDOW - GRAM + 1)[first]
                cut = np.ones(len(row), bool)
                cut[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                begin = np.flatnonzero(cut)
                run_of = np.cumsum(cut) - 1
                begin = np.flatnonzero(cut | ((np.arange(len(row)) - begin[run_of]) % LONGEST == 0))
                size = np.diff(begin, append=len(row))
                # Two polynomial hashes over the hashes of all windows of a string, so that strings alike here have equal words.
                power = np.arange(len(row)) - np.repeat(begin, size)
                key = np.empty((len(begin), 3), np.uint64)
                for j, p in enumerate((_P1, _P2)):
                    powers = np.cumprod(np.full(LONGEST, np.uint64(p), np.uint64))
                    key[:, j] = np.add.reduceat(rolled(value, WINDOW, p)[first] * powers[power], begin)
                key[:, 2] = least[begin] ^ mix(size.astype(np.uint64))
                _, one, which, n = np.unique(key, axis=0, return_index=True, return_inverse=True, return_counts=True)
                which = which.reshape(-1)
                again = n[which] > 1
                # Known here to be repeated: word ranges of the rows.
                hit = np.flatnonzero(again)
                place = first[begin[hit]] - words.first[row[begin[hit]]]
                r, b, e = _merged(row[begin[hit]], place, place + size[hit] + WINDOW - 1)
                ranges = np.stack([ids[r], hashes[r], b, e], axis=1).astype(np.int64)
                # To be counted elsewhere: each string once, `sent` twice if it stands for several.
                start, stop = words.starts[first[begin[one]]], words.ends[first[begin[one] + size[one] - 1] + WINDOW - 1]
                bucket = (mix(least[begin[one]]) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                used, edges = np.unique(bucket[order], return_index=True)  # of this slice's strings, however many buckets there are
                data = words.data.tobytes()
                rows = []
                for b, own in zip(used.tolist(), np.split(order, edges[1:]), strict=True):
                    packed = b"".join([data[s:t] for s, t in zip(start[own].tolist(), stop[own].tolist(), strict=True)])
                    lead = row[begin[one[own]]]
                    rows.append((int(b), ids[lead].tobytes(), hashes[lead].tobytes(), (first[begin[one[own]]] - words.first[lead]).astype(np.int64).tobytes(), np.minimum(n[own], 2).astype(np.int8).tobytes(), (stop[own] - start[own]).astype(np.int64).tobytes(), squeeze.compress(packed), b""))
                    if len(rows) >= 64:
                        yield _batch(rows)
                        rows = []
                if len(ranges):
                    rows.append((int(ids[0] % buckets), b"", b"", b"", b"", b"", b"", ranges.tobytes()))
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], _NAMES)


_RANGES = "id bigint, text_hash bigint, start bigint, stop bigint"


def _count(group: pa.Table) -> pa.Table:
    """Ranges of repeated windows in one bucket.

    The strings stay compressed; windows are hashed a row at a time and, where the bucket is large, in passes over shares of the
    hashes, so that a bucket which many texts fall into takes more time but not more memory.
    """
    expand = zstandard.ZstdDecompressor()
    columns = {n: group.column(n).to_pylist() for n in _NAMES[1:]}
    found = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in columns["ranges"]]
    rows = [i for i, x in enumerate(columns["data"]) if x]
    lengths = [np.frombuffer(columns["lengths"][i], np.int64) for i in rows]
    base = np.cumsum([0, *(len(x) for x in lengths)])

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join([columns[name][i] for i in rows]), kind)

    ids, hashes, starts, sent = joined("ids", np.int64), joined("hashes", np.int64), joined("starts", np.int64), joined("sent", np.int8)
    passes = 1 + sum(int(x.sum()) for x in lengths) // PASS_BYTES
    for k in range(passes if rows else 0):
        h1, h2, string, place = zip(*(_window_hashes(expand.decompress(columns["data"][i]), n, at, k, passes) for i, n, at in zip(rows, lengths, base, strict=False)), strict=True)
        h1, h2, string, place = (np.concatenate(x) for x in (h1, h2, string, place))
        if not len(h1):
            continue
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        times = np.add.reduceat(sent[string[order]].astype(np.int64), np.flatnonzero(new))
        repeated = np.empty(len(order), bool)
        repeated[order] = times[np.cumsum(new) - 1] > 1
        hit = np.flatnonzero(repeated & (sent[string] == 1))
        place = starts[string[hit]] + place[hit]
        s, b, e = _merged(string[hit], place, place + WINDOW)
        found.append(np.stack([ids[s], hashes[s], b, e], axis=1))
    found = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return pa.table([pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)], ["id", "text_hash", "start", "stop"])


def _window_hashes(data: bytes, lengths: np.ndarray, base: int, k: int, passes: int) -> tuple[np.ndarray, ...]:
    """Two hashes of every window of packed strings, the string's number from base on and the window's place in it; of the k-th share."""
    words = Words(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)]), lower=False)
    value = words.hashes()
    string, first = _windows(words.first, WINDOW)
    h1, h2, place = rolled(value, WINDOW, _P1)[first], rolled(value, WINDOW, _P2)[first], first - words.first[string]
    string = string + base
    if passes > 1:
        own = h1 % np.uint64(passes) == np.uint64(k)
        h1, h2, string, place = h1[own], h2[own], string[own], place[own]
    return h1, h2, string, place


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id (0 for null), text_hash and word ranges [start, stop) of repeated windows; ranges may overlap."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    common, total = common_grams(docs)
    buckets = max(1, math.ceil(3 * total / BUCKET_WORDS))
    packed = own.select(F.coalesce("id", F.lit(0)).alias("id"), "text_hash", "text").mapInArrow(lean(_packer(common, buckets)), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_count, _RANGES)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    ranges = repeated_ranges(docs).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    ranges = ranges.withColumnRenamed("text_hash", "h")
    both = own.join(ranges, (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("text_hash") == F.col("h")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().split() if text.is_valid else []
                n = len(words)
                if ranges:
                    gone = np.zeros(n, bool)
                    for r in ranges:
                        gone[r["start"] : r["stop"]] = True
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "ranges").mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op8_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur elsewhere too."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
