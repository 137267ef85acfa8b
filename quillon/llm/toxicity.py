"""Toxicity behind a noisy channel: disguised words are restored by Viterbi decoding before they are scored.

A character trigram model is counted over all texts. A word that isn't plain letters is a lattice: each character stands for
itself, for the letters it is used in place of, or for nothing (separators, drawn-out repetitions, decoration), each at a
price. The cheapest path under channel and language model is the restored word. Single letters set apart by spaces or
separators are joined to one such word first. Words of plain letters have a single path and stand for themselves.

The scorer is a logistic regression on how often a text's restored words begin with, or are, one of the character sequences
that tell the labels of the training rows apart most. Sequences are counted and weights fitted over all labelled documents but
held-out ones, trigrams over all texts. The weights are the least point of a convex function; its value and slope at each step are
sums that tasks make over all rows, so that no rows come to the driver.

Defined cases: null and empty texts get the score of a text without any such word; without usable labels every score is 0;
several labels of a document count as their largest; null labels are ignored; repeated rows are each scored, but of rows that
share a doc_id only the one with the smallest text is learned from; null doc_ids are scored and not held out; other columns are
ignored, and one named like the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import discard, lean, materialise, table, with_column

#: Character sequences that the scorer weighs, at most, and the least number of labelled documents that have one.
FEATURES, SUPPORT = 1024, 8
PREFIXES = range(3, 9)
#: Surfaces whose features one worker remembers; beyond it the memory starts anew.
MEMORY = 100_000
#: Distinct sequences, and surfaces, whose counts a worker holds before it sends them on; the shuffle adds up what is sent.
HELD = 100_000
#: Bits that say which documents may have a label: 4 MB, whatever the input. More labels let more others pass, which the join drops.
MAYBE = 1 << 25
#: The largest slope at which the weights are taken as found, and the most steps to there.
LEVEL, STEPS = 1e-6, 100

# Letters that characters are commonly used in place of.
_STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
_ENDS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "@$|+(<") + "«»„“”’‘…"
_DECORATION = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\W_])")
_DRAWN_OUT = re.compile(r"(.)\1\1")

# The character model's alphabet: a to z, the letters of Latin-1, and a boundary for all else.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
_BOUNDARY, _SIZE = len(_LETTERS), 64
_CODE = {c: i for i, c in enumerate(_LETTERS)}
_CODES = np.full(0x250, _BOUNDARY, np.int64)
_CODES[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        held, size = [], 0
        for text in [*batch.column(0), None]:
            if text is not None and text.is_valid:
                held.append(text.as_py().lower())
                size += len(held[-1])
            if held and (text is None or size > 1_000_000):
                points = np.frombuffer("  ".join(["", *held, ""]).encode("utf-32-le"), np.uint32)
                code = _CODES[np.minimum(points, 0x24F)]
                code = np.where(points < 0x250, code, _BOUNDARY)
                total += np.bincount((code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:], minlength=_SIZE**3)
                held, size = [], 0
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two letters before) over all texts, interpolated with shorter contexts; 64 x 64 x 64."""
    counted = docs.select("text").mapInArrow(lean(_trigram_counts), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE**3)
    for gram, n in counted.collect():  # 64**3 rows at most, whatever the input
        counts[gram] = n
    tri = counts.reshape(_SIZE, _SIZE, _SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + _SIZE)
    p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
    p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


class Decoder:
    """The noisy channel's cheapest reading of a surface."""

    ITSELF, STANDS, DROPPED, DROPPED_SIGN, DROPPED_DIGIT, DRAWN, ANY = -0.05, -1.0, -1.5, -6.0, -9.0, -0.7, -2.0

    def __init__(self, model: np.ndarray):
        self.model = model

    def readings(self, surface: str, i: int) -> list[tuple[int, float]]:
        """Letters (-1: nothing) that the i-th character can stand for, with their price."""
        c = surface[i]
        out = []
        if c in _CODE:
            out.append((_CODE[c], self.ITSELF))
            if i and surface[i - 1] == c:
                drawn = (i > 1 and surface[i - 2] == c) or surface[i + 1 : i + 2] == c
                out.append((-1, self.DRAWN if drawn else self.DROPPED_DIGIT))
        else:
            out += [(_CODE[x], self.STANDS) for x in _STANDS_FOR.get(c, "")]
            out.append((-1, self.DROPPED_DIGIT if c.isalnum() else self.DROPPED_SIGN if c in _STANDS_FOR or c == "*" else self.DROPPED))
            if c == "*":
                out += [(_CODE[x], self.ANY) for x in "aeiou"]
        return out

    def decode(self, surface: str) -> str:
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple]] = {(_BOUNDARY, _BOUNDARY): (0.0, ())}
        for i in range(len(surface)):
            fresh: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (price, path) in states.items():
                for letter, cost in self.readings(surface, i):
                    key = (p, q) if letter < 0 else (q, letter)
                    now = price + cost + (0.0 if letter < 0 else float(model[p, q, letter]))
                    if key not in fresh or now > fresh[key][0]:
                        fresh[key] = (now, path if letter < 0 else (path, letter))
            states = fresh
        _, path = max((price + float(model[p, q, _BOUNDARY]), path) for (p, q), (price, path) in states.items())
        out = []
        while path:
            path, letter = path
            out.append(_LETTERS[letter])
        return "".join(reversed(out))

    def restore(self, surface: str) -> str:
        """The word behind one lower-case surface; empty where it holds no letter."""
        word = surface.strip(_ENDS)
        word = _DECORATION.sub("", word).strip(_ENDS)
        if word.isalpha():
            return self.decode(word) if _DRAWN_OUT.search(word) else word
        if not any(c in _CODE for c in word):
            return word if word.isalpha() else ""
        return self.decode(word)


def sequences(word: str) -> list[str]:
    """What the scorer sees of a restored word: its beginnings, and the word itself behind a mark."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + ["=" + word]


def spelled_out(text: str) -> list[str]:
    """Words of a lower-case text whose letters are set apart."""
    return [re.sub(r"[ .\-_*]", "", spaced) for spaced in _SPACED.findall(text)]


def surfaces(text: str) -> set[str]:
    """Lower-case surfaces of a text; spelled-out words are one surface each."""
    text = text.lower()
    return {*text.split(), *spelled_out(text)}


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Scorer:
    model: np.ndarray
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    constant: float | None = None


class _Features(dict):
    """Indices of the chosen sequences by surface, remembered."""

    def __init__(self, model: np.ndarray, index: dict[str, int]):
        super().__init__()
        self.decoder, self.index = Decoder(model), index
        self.begins = {s[: PREFIXES[0]] for s in index if not s.startswith("=")}

    def __missing__(self, surface: str) -> tuple[int, ...]:
        word = surface if surface.isalpha() else surface.strip(_ENDS)
        if not word.isalpha() or _DRAWN_OUT.search(word):  # else it stands for itself
            word = self.decoder.restore(surface)
        if word[: PREFIXES[0]] in self.begins:
            own = tuple(self.index[s] for s in sequences(word) if s in self.index)
        else:  # no longer beginning can be among them either
            own = (self.index["=" + word],) if "=" + word in self.index else ()
        self[surface] = own
        return own

    def of(self, text: str | None) -> Counter:
        """How often each sequence stands in a text; counted without a loop over its words."""
        if len(self) > MEMORY:
            self.clear()
        text = (text or "").lower()
        return Counter(chain.from_iterable(map(self.__getitem__, [*text.split(), *spelled_out(text)])))


class _Numbered(dict):
    """Numbers of the sequences of a surface's word, remembered; names has every sequence's number."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.decoder, self.names = Decoder(model), {}

    def __missing__(self, surface: str) -> tuple[int, ...]:
        word = surface if surface.isalpha() else surface.strip(_ENDS)
        if not word.isalpha() or _DRAWN_OUT.search(word):  # else it stands for itself
            word = self.decoder.restore(surface)
        own = self[surface] = tuple([self.names.setdefault(s, len(self.names)) for s in sequences(word)])
        return own


def _chosen(sample: DataFrame, model: np.ndarray) -> list[str]:
    """The sequences whose presence depends most on the label (log-likelihood ratio)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, held = _Numbered(model), [0, 0], ([], [])

        def sums() -> pa.RecordBatch:
            names = list(seen.names)
            by = [np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=len(names)) for own in held]
            out = [pa.array(names, pa.string()), *(pa.array(n, pa.int64()) for n in by)]
            seen.clear()
            seen.names.clear()
            for own in held:
                own.clear()
            return pa.RecordBatch.from_arrays(out, ["s", "n0", "n1"])

        size = 0
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = np.fromiter(chain.from_iterable(map(seen.__getitem__, surfaces(text.as_py() or ""))), np.int64)
                held[toxic].append(np.unique(own))
                rows[toxic] += 1
                size += len(held[toxic][-1])
                if max(len(seen), len(seen.names), size // 16) > HELD:
                    yield sums()
                    size = 0
        yield sums()
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([rows[0]], pa.int64()), pa.array([rows[1]], pa.int64())], ["s", "n0", "n1"])

    counted = sample.select("text", "toxic").mapInArrow(lean(count), "s string, n0 bigint, n1 bigint").groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = materialise(counted.where((F.col("s") == "") | (F.col("n0") + F.col("n1") >= SUPPORT)), "sequences")
    total = rows.where("s = ''").first()  # how many documents of either label there are
    t0, t1 = F.lit(int(total.n0)) if total else F.lit(0), F.lit(int(total.n1)) if total else F.lit(0)

    def term(n: Column, of: Column, p: Column) -> Column:
        return F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0) + F.when(of - n > 0, (of - n) * F.log((of - n) / (of * (1 - p)))).otherwise(0.0)

    p = (F.col("n0") + F.col("n1")) / (t0 + t1)
    ranked = rows.where("s <> ''").where(p < 1).withColumn("g", term(F.col("n0"), t0, p) + term(F.col("n1"), t1, p))
    names = [r.s for r in ranked.orderBy(F.desc("g"), "s").limit(FEATURES).collect()]
    discard(rows)
    return names


def _maybe_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and a few others: a first look at MAYBE bits, so that few texts are shuffled."""

    def place(name: str) -> list[Column]:
        at = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(MAYBE))
        return [F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(32767))]  # a bitmap has 32768 bits

    bucket, bit = place("doc_id")
    maps = ids.select(bucket, bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(maps), (bucket == F.col("bucket")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Scorer:
    """A scorer learned from all labelled rows outside the held-out fold."""
    model = character_model(docs)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", folds, fold))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = _maybe_among(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), usable)
    # Of rows that share a doc_id one is learned from.
    sample = materialise(own.join(usable, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "labelled")
    names = _chosen(sample, model)
    index = {s: i for i, s in enumerate(names)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Features(model, index)
        for batch in batches:
            own = [seen.of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(o) for o in own], pa.list_(pa.int32())), pa.array([list(o.values()) for o in own], pa.list_(pa.int32()))], ["toxic", "f", "n"])

    rows = materialise(sample.select("text", "toxic").mapInArrow(lean(features), "toxic int, f array<int>, n array<int>"), "features")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    scorer = Scorer(model, {}, np.zeros(0), 0.0, float(ones > 0)) if ones in (0, n) else Scorer(model, index, *_logistic(rows, n, ones, len(names)))
    discard(sample, rows)
    return scorer


def _loss(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """Summed loss of a batch (toxic, f, n) at weights with the bias behind them, and behind the sum its slope."""
    y = batch.column(0).to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), pa.compute.list_value_length(batch.column(1)).to_numpy())
    column, value = batch.column(1).flatten().to_numpy(), np.log1p(batch.column(2).flatten().to_numpy())
    z = np.bincount(row, value * at[column], len(y)) + at[-1]
    error = np.exp(-np.logaddexp(0, -z)) - y
    return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], np.bincount(column, value * error[row], len(at) - 1), [error.sum()]])


def _logistic(rows: DataFrame, n: int, ones: int, width: int, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over all rows (toxic, f, n)."""
    weigh = np.append(np.full(width, ridge), 0.0)

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((_loss(batch, at) for batch in batches), np.zeros(width + 2))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = rows.mapInArrow(run, "sums binary").collect()  # 8 KB a task
        sums = sum(np.frombuffer(r.sums) for r in parts) / n
        return sums[0] + (weigh * at * at).sum() / 2, sums[1:] + weigh * at

    found = _least(loss, np.append(np.zeros(width), math.log(ones / (n - ones))))
    return found[:-1], float(found[-1])


def _least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, level: float = LEVEL, steps: int = STEPS) -> np.ndarray:
    """The least point of a convex function, which gives its value and slope, by L-BFGS with halved steps."""
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # of the last steps, with the changes of the slope
    for _ in range(steps):
        if np.abs(slope).max() <= level:
            break
        way, shares = slope, []
        for move, change in reversed(moves):
            shares.append(move @ way / (move @ change))
            way = way - shares[-1] * change
        if moves:
            way = way * (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        for (move, change), share in zip(moves, reversed(shares), strict=True):
            way = way + move * (share - change @ way / (move @ change))
        step = 1.0
        there = loss(at - way)
        while there[0] > value - 1e-4 * step * (slope @ way) and step > 1e-6:
            step /= 2
            there = loss(at - step * way)
        if there[0] > value:  # no better within doubles
            break
        moves = [*moves[-19:], (-step * way, there[1] - slope)]
        if moves[-1][0] @ moves[-1][1] <= 0:
            moves.pop()
        at, (value, slope) = at - step * way, there
    return at


def score(docs: DataFrame, scorer: Scorer, into: str = "score") -> DataFrame:
    """The rows of docs with the column `into`, which replaces one of that name."""
    docs = docs.drop(into)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Features(scorer.model, scorer.index)
        for batch in batches:
            out = []
            for text in batch.column(column):
                if scorer.constant is not None:
                    out.append(scorer.constant)
                    continue
                z = scorer.bias + sum(float(scorer.weights[f]) * math.log1p(n) for f, n in sorted(seen.of(text.as_py()).items()))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, into])

    return with_column(docs, run, StructField(into, DoubleType()))


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
