"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class in the context, times that of its group in the class and the context, times its share
of the group. Each of the `FREQUENT` commonest tokens and the end is a class of its own; all others fall into classes by their last
two bytes, and inside a class into `GROUPS` groups by their hash. Both softmaxes are maximum-entropy models over hashed features of
the context: the word before, the pair of words before, and the word before that one (a skip); inside a class each feature is one of
that class. Inside a group the only features are the tokens themselves, whose maximum-entropy solution is their smoothed frequency.
The hashed features are as many as the distinct training words ask for, up to what a worker can hold (`hashed_features`).

Texts are read once. Each slice of a scan becomes one row: its documents as local word numbers, compressed, and its distinct words'
sorted hashes. For counting, a slice's words are cut into blocks by hash range, and all blocks of one range meet in one task, which
adds them up and gives every slice its words' counts, in the same order. What is shuffled is 64-bit hashes, not rows of words, and
nothing that grows with the corpus is broadcast or collected. Weights are trained by rounds of distributed gradient updates: every
task takes AdaGrad steps over its own slices, sends by how much its weights moved, rows that it never touched as zeros that compress
away, and these moves are averaged block by block in proportion to the tasks' tokens.

Defined cases: null and empty texts are their end token alone; repeated rows are each counted and scored; a null doc_id is learned
from; without training rows every class and group is equally likely and the base counts are zero; very long texts are one slice;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, materialise, table
from .words import Words, mix, parts, utf8

FREQUENT, SUFFIXES, GROUPS = 23, 32, 16
#: The end's class comes after the frequent tokens' and before the suffixes'.
CLASSES = FREQUENT + 1 + SUFFIXES
#: Hashed features of each of the three kinds: one for so many distinct training words, and at least and at most so many in all.
WORDS_A_FEATURE, LEAST_HASHED, MOST_HASHED = 512, 4096, 65_536
ROUNDS, STEP, BATCH = 2, 0.2, 16_384
SLICE_BYTES = 1 << 23
#: Words of slices that one counting task adds up, about.
COUNTED_TOGETHER = 500_000
#: Weights that travel and are averaged together.
_CHUNK = 1 << 16
_END = np.uint64(0x5BD1E9955BD1E995)

_PACKED = "slice bigint, doc_ids array<bigint>, n_words binary, words binary, hashes binary, suffixes binary, trained binary, distinct bigint, train_docs bigint"
_PACKED_TYPES = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _pack(folds: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for texts in parts(batch.column(1), SLICE_BYTES):
                yield _slice_row(number, batch.column(0).slice(at, len(texts)), texts, folds, fold)
                at += len(texts)
                number += 1

    return run


def _slice_row(number: int, ids: pa.Array, texts: pa.Array, folds: int, fold: int) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    words = Words(*utf8(texts), lower=True)
    n_words = np.diff(words.first).astype(np.int32)
    hashes, one, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    which = which.astype(np.int32)
    ends = words.ends[one]
    last = words.data[ends - 1].astype(np.uint64)
    before = np.where(ends - words.starts[one] > 1, words.data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    suffix = (mix(last << np.uint64(8) | before) % np.uint64(SUFFIXES)).astype(np.uint8)
    train = ~_held(ids, folds, fold)
    trained = np.bincount(which[np.repeat(train, n_words)], minlength=len(hashes)).astype(np.int32)
    row = [number, ids.to_pylist(), n_words.tobytes(), squeeze(which.tobytes()), squeeze(np.diff(hashes, prepend=np.uint64(0)).tobytes()), squeeze(suffix.tobytes()), squeeze(trained.tobytes()), len(hashes), int(train.sum())]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _PACKED_TYPES, strict=True)], _names(_PACKED))


def _held(ids: pa.Array, folds: int, fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids.to_pylist()], bool)


def _expanded(data: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", kind)


def _hashes_of(data: bytes) -> np.ndarray:
    return np.cumsum(_expanded(data, np.uint64), dtype=np.uint64)


def groups_of(hashes: np.ndarray) -> np.ndarray:
    """The group inside its class that a word falls into."""
    return (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(GROUPS)).astype(np.int64)


_BLOCKS = "slice bigint, range int, hashes binary, n binary, suffixes binary"


def _blocks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        edges = (np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)) if ranges > 1 else np.zeros(0, np.uint64)
        for row in _rows(batches):
            hashes, n, suffix = _hashes_of(row["hashes"]), _expanded(row["trained"], np.int32), _expanded(row["suffixes"], np.uint8)
            of = np.searchsorted(edges, hashes, "right")  # ranges of a slice's own words only, however many there are in all
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            cut = [slice(a, b) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(of)], strict=True)]
            for at in range(0, len(cut), 1024):
                own = cut[at : at + 1024]
                columns = [[row["slice"]] * len(own), of[begin[at : at + 1024]], [hashes[c].tobytes() for c in own], [squeeze(n[c].tobytes()) for c in own], [suffix[c].tobytes() for c in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], _names(_BLOCKS))

    return run


_COUNTED = "slice bigint, range int, counts binary, cell_n array<bigint>, cell_v array<bigint>, top array<struct<hash:bigint,c:bigint,cell:int>>"
_COUNTED_ARROW = pa.schema([("slice", pa.int64()), ("range", pa.int32()), ("counts", pa.binary()), ("cell_n", pa.list_(pa.int64())), ("cell_v", pa.list_(pa.int64())), ("top", pa.list_(pa.struct([("hash", pa.int64()), ("c", pa.int64()), ("cell", pa.int32())])))])


def _counts(group: pa.Table) -> pa.Table:
    """Of one range of hashes: its counts by slice, and one row of totals by cell (class and group) and of the commonest words."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    own = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
    n = np.concatenate([_expanded(x, np.int32) for x in group.column("n").to_pylist()])
    suffix = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("suffixes").to_pylist()])
    hashes, one, which = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
    total = np.bincount(which, n, len(hashes)).astype(np.int64)
    cell = suffix[one].astype(np.int64) * GROUPS + groups_of(hashes)
    size = SUFFIXES * GROUPS
    first = np.lexsort((hashes.view(np.int64), -total))[:FREQUENT]
    top = [{"hash": int(hashes.view(np.int64)[i]), "c": int(total[i]), "cell": int(cell[i])} for i in first if total[i]]
    by_slice = np.split(total[which], np.cumsum([len(x) for x in own])[:-1])
    k, at = len(own), group.column("range")[0].as_py()
    columns = [
        [*group.column("slice").to_pylist(), None],
        [at] * (k + 1),
        [*(squeeze(c.tobytes()) for c in by_slice), None],
        [*[None] * k, np.bincount(cell, total, size).astype(np.int64)],
        [*[None] * k, np.bincount(cell, total > 0, size).astype(np.int64)],
        [*[None] * k, top],
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _COUNTED_ARROW, strict=True)], schema=_COUNTED_ARROW)


def hashed_features(distinct: int) -> int:
    """Hashed features of each kind for so many distinct training words: a power of two that grows with them.

    `MOST_HASHED` bounds what every worker holds and sends, 57 MB; beyond it contexts share weights, and none is left out.
    """
    size = LEAST_HASHED
    while size < min(distinct / WORDS_A_FEATURE, MOST_HASHED):
        size *= 2
    return size


class Model:
    """What scoring needs besides a slice's counts: bounded tables and the weights."""

    def __init__(self, total: int, distinct: int, ends: int, frequent: list[int], cell_n: np.ndarray, cell_v: np.ndarray, hashed: int | None = None):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.hashed = hashed or hashed_features(distinct)
        place = sorted(range(len(frequent)), key=lambda i: frequent[i] % (1 << 64))
        self.top = np.array([frequent[i] % (1 << 64) for i in place], np.uint64)
        self.top_class = np.array(place, np.int64)
        self.cell_n, self.cell_v = cell_n.astype(float), cell_v.astype(float)
        #: Rows of hashed features, and the bias.
        self.weights = np.zeros((3 * self.hashed + 1, CLASSES), np.float32)
        #: Rows of hashed features of a class, and each class's bias.
        self.inner = np.zeros((3 * self.hashed + SUFFIXES, GROUPS), np.float32)

    def of_words(self, hashes: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, group (0 in classes of one word) and log10 share of the group, of distinct words."""
        kind, group = suffix.astype(np.int64), groups_of(hashes)
        cell = kind * GROUPS + group
        share = np.log10((counts + 1) / (self.cell_n[cell] + self.cell_v[cell] + 1))
        kind = kind + FREQUENT + 1
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            own = self.top[at] == hashes
            kind = np.where(own, self.top_class[at], kind)
            share, group = np.where(own, 0.0, share), np.where(own, 0, group)
        return kind, group, share


class Slice:
    """One slice's tokens, an end after each document, with the context features of every token."""

    def __init__(self, row: dict, model: Model):
        self.hashed = model.hashed
        n_words = np.frombuffer(row["n_words"], np.int32).astype(np.int64)
        words, hashes = _expanded(row["words"], np.int32), _hashes_of(row["hashes"])
        counts = np.concatenate([np.zeros(0, np.int64), *(_expanded(c, np.int64) for c in row["counts"] or [])])
        kind, group, share = model.of_words(hashes, _expanded(row["suffixes"], np.uint8), counts)
        self.n = n_words + 1
        self.document = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        ends = np.cumsum(self.n) - 1
        token = np.full(len(self.document), len(hashes), np.int32)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = words
        self.token = token
        self.count = np.append(counts, model.ends)
        self.kind, self.group, self.share = np.append(kind, FREQUENT), np.append(group, 0), np.append(share, 0.0)
        self.spread = np.append(mix(hashes), _END)
        self.begins = np.append(0, ends[:-1] + 1)

    def context(self, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the word before, of the pair before, and of the word before that one, for tokens at."""
        begin, end = at.start, min(at.stop, len(self.token))
        place = np.arange(begin, end) - self.begins[self.document[begin:end]]
        i = np.arange(begin, end)
        one = np.where(place >= 1, self.spread[self.token[np.maximum(i - 1, 0)]], np.uint64(1))
        two = np.where(place >= 2, self.spread[self.token[np.maximum(i - 2, 0)]], np.uint64(2))
        return one, mix(one * np.uint64(3) ^ two), two

    def features(self, context: tuple[np.ndarray, ...]) -> np.ndarray:
        """Rows of the class weights."""
        size = np.uint64(self.hashed)
        return np.stack([c % size + np.uint64(j) * size for j, c in enumerate(context)]).astype(np.int64)

    def inner_features(self, context: tuple[np.ndarray, ...], kind: np.ndarray) -> np.ndarray:
        """Rows of the group weights, in classes of several words."""
        size, salt = np.uint64(self.hashed), kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        rows = [(mix(c + salt) % size + np.uint64(j) * size).astype(np.int64) for j, c in enumerate(context)]
        return np.stack([*rows, 3 * self.hashed + kind - FREQUENT - 1])


#: Sums of weights beyond which a row's largest is taken off first, so that no power overflows.
_LARGE = 60.0


def _powers(weights: np.ndarray, features: np.ndarray, bias: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised chances and their sums."""
    z = weights.take(features[0], axis=0)
    more = np.empty_like(z)
    for rows in features[1:]:
        np.take(weights, rows, axis=0, out=more, mode="clip")
        z += more
    z += bias
    if len(z) and z.max() > _LARGE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def _softmax(weights: np.ndarray, features: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
    z, total = _powers(weights, features, bias)
    z *= (1 / total)[:, None]
    return z


def _chance(weights: np.ndarray, features: np.ndarray, wanted: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
    """What the softmax gives the wanted places."""
    z, total = _powers(weights, features, bias)
    return z[np.arange(len(z)), wanted].astype(float) / total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by groups, which begin at places `first` of the row numbers `order`.

    Most groups are small: their members are added one by one for all groups at once, and only the few large ones by themselves.
    """
    size = np.diff(first, append=len(order))
    out = values.take(order[first], axis=0)
    taken, more = 1, np.flatnonzero(size > 1)
    while len(more) > 64:
        out[more] += values.take(order[first[more] + taken], axis=0)
        taken += 1
        more = more[size[more] > taken]
    for i in more.tolist():
        out[i] += values.take(order[first[i] + taken : first[i] + size[i]], axis=0).sum(axis=0)
    return out


class Trainer:
    """AdaGrad steps on one softmax; each row of weights has one step size."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.squares = weights.copy(), np.full((len(weights), 1), 1e-2, np.float32)

    def step(self, features: np.ndarray, wanted: np.ndarray, biased: bool) -> None:
        slope = _softmax(self.weights, features, self.weights[-1] if biased else 0.0)
        slope[np.arange(len(slope)), wanted] -= 1
        small = len(self.weights) <= 1 << 16  # 16-bit keys sort faster
        for rows in features:
            order = np.argsort(rows.astype(np.uint16) if small else rows, kind="stable")
            ranked = rows[order]
            first = np.flatnonzero(np.diff(ranked, prepend=-1))
            self._move(ranked[first], _sums(slope, order, first))
        if biased:
            self._move(np.array([len(self.weights) - 1]), slope.sum(axis=0, keepdims=True))

    def _move(self, rows: np.ndarray, g: np.ndarray) -> None:
        squares = self.squares[rows] + np.einsum("ij,ij->i", g, g)[:, None] / g.shape[1]
        self.squares[rows] = squares
        g *= STEP / np.sqrt(squares)
        self.weights[rows] = self.weights.take(rows, axis=0) - g


_MOVES = "block int, seen bigint, moves binary"
_MEAN = pa.schema([("block", pa.int32()), ("moves", pa.binary())])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average of one block's moves, one task's at a time."""
    total, seen, block = None, 0, None
    for row in _rows(batches):
        own = _expanded(row["moves"], np.float16).astype(float) * row["seen"]
        total, seen, block = own if total is None else total + own, seen + row["seen"], row["block"]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], schema=_MEAN)


def train(prepared: DataFrame, model: Model, folds: int, fold: int, rounds: int = ROUNDS) -> None:
    """Fill the model's weights by rounds of task-local AdaGrad steps and averaging."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, inner, seen = Trainer(model.weights), Trainer(model.inner), 0
        for row in _rows(batches):
            own = Slice(row, model)
            learn = np.repeat(~_held(pa.array(row["doc_ids"], pa.int64()), folds, fold), own.n)
            for at in range(0, len(own.token), BATCH):
                part = slice(at, at + BATCH)
                use = learn[part]
                if not use.any():
                    continue
                token, context = own.token[part][use], tuple(c[use] for c in own.context(part))
                kind = own.kind[token]
                outer.step(own.features(context), kind, biased=True)
                seen += len(token)
                shared = kind > FREQUENT
                if shared.any():
                    inner.step(own.inner_features(tuple(c[shared] for c in context), kind[shared]), own.group[token[shared]], biased=False)
        if seen:
            squeeze = zstandard.ZstdCompressor(level=3).compress
            moves = np.concatenate([(outer.weights - model.weights).reshape(-1), (inner.weights - model.inner).reshape(-1)]).astype(np.float16)
            for block, at in enumerate(range(0, len(moves), _CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen], pa.int64()), pa.array([squeeze(moves[at : at + _CHUNK].tobytes())], pa.binary())], _names(_MOVES))

    for _ in range(rounds):
        local = prepared.mapInArrow(lean(run), _MOVES)
        fresh = local.groupBy("block").applyInArrow(_mean, "block int, moves binary").collect()  # the weights, 57 MB at most
        if not fresh:
            return
        moves = np.concatenate([np.frombuffer(bytes(r.moves), np.float32) for r in sorted(fresh, key=lambda r: r.block)])
        model.weights += moves[: model.weights.size].reshape(model.weights.shape)
        model.inner += moves[model.weights.size :].reshape(model.inner.shape)


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _counted(packed: DataFrame) -> DataFrame:
    """Counts of training tokens by slice and range of hashes, and each range's totals in a row without a slice."""
    pairs = packed.agg(F.sum("distinct")).first()[0] or 0
    ranges = max(1, -(-pairs // COUNTED_TOGETHER))
    blocks = packed.where("distinct > 0").select("slice", "hashes", "suffixes", "trained").mapInArrow(lean(_blocks(ranges)), _BLOCKS)
    return materialise(blocks.groupBy("range").applyInArrow(_counts, _COUNTED), "word-counts")


def _untrained(packed: DataFrame, counted: DataFrame) -> Model:
    """The model before its first step, from sums over all ranges."""
    totals = counted.where("slice IS NULL")

    def cells(column: str) -> np.ndarray:
        out = np.zeros(SUFFIXES * GROUPS, np.int64)
        for r in totals.select(F.posexplode(column).alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
            out[r.cell] = r.n
        return out

    cell_n, cell_v = cells("cell_n"), cells("cell_v")
    frequent = totals.select(F.inline("top")).orderBy(F.desc("c"), "hash").limit(FREQUENT).collect()
    ends = packed.agg(F.sum("train_docs")).first()[0] or 0
    total, distinct = int(cell_n.sum()) + ends, int(cell_v.sum()) + (ends > 0)
    for r in frequent:
        cell_n[r.cell] -= r.c
        cell_v[r.cell] -= 1
    return Model(total, distinct, ends, [r.hash for r in frequent], cell_n, cell_v)


def scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per row of docs the base and model log10 probabilities; rows outside the held-out fold are learned from."""
    packed = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(_pack(folds, fold)), _PACKED), "slices")
    counted = _counted(packed)
    model = _untrained(packed, counted)
    own = counted.where("slice IS NOT NULL").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("range", "counts")))["counts"].alias("counts"))
    prepared = materialise(packed.join(own, "slice", "left").select("doc_ids", "n_words", "words", "hashes", "suffixes", "counts"), "prepared")
    discard(packed, counted)
    train(prepared, model, folds, fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.log10(float(model.total + model.distinct + 1))
        for row in _rows(batches):
            own = Slice(row, model)
            size = len(own.n)
            single, sums = np.log10(own.count + 1.0) - below, np.zeros((3, size))
            for at in range(0, len(own.token), BATCH):  # sums by document, so that only a batch is in memory
                part = slice(at, at + BATCH)
                token, document, context = own.token[part], own.document[part], own.context(part)
                kind = own.kind[token]
                chance = _chance(model.weights, own.features(context), kind, model.weights[-1])
                shared = kind > FREQUENT
                chance[shared] *= _chance(model.inner, own.inner_features(tuple(c[shared] for c in context), kind[shared]), own.group[token[shared]])
                score = own.share[token] + np.log10(np.maximum(chance, 1e-300))
                first = document[0]
                for k, value in enumerate((own.count[token] > 0, single[token], score)):
                    found = np.bincount(document - first, value)
                    sums[k, first : first + len(found)] += found
            ids = pa.array(row["doc_ids"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(_held(ids, folds, fold)), pa.array(own.n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(size, model.total, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                _names(_SCORES),
            )

    return prepared.mapInArrow(lean(run), _SCORES)


def op7_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside the held-out fold."""
    return scores(table(spark, sf_dir, "documents"))
