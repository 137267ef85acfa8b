"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to other mentions.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. The field's variables are the
tokens of a document that hold a digit or an @. Neighbouring tokens are joined by chain factors, distant tokens that repeat a
token's characters, or the last seven digits of a number, by skip factors, so that mentions of one thing share their evidence.
Tokens inside pattern matches are observed. Loopy sum-product message passing, a fixed number of rounds over all edges at
once, gives the others' labels; those likelier than `SURE`
that edges join to an observed token are added as spans.

The factors are trained piecewise: each is the smoothed log count ratio of its own configurations, among the tokens of all
documents, labelled by the patterns. The `SHAPES` commonest token shapes have factors of their own.

Defined cases: null and empty texts have no spans; digits of any number are read; repeated rows are each searched; ties between
kinds go to the one listed first; an empty table gives no rows; a null doc_id is kept; other columns are passed on by find_spans,
where one named like the result is replaced, and ignored by op1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, _parse_datatype_string

from .common import discard, lean, materialise, table, with_column

KINDS = ("email", "ip", "card", "phone")
#: Shapes that have factors of their own, and configurations whose counts a worker holds before it sends them on.
SHAPES, HELD = 10_000, 50_000
ROUNDS, SURE = 30, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
_ENDS = ".,;:!?\"'*#%&$[]{}<>|`~=/\\_-"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: an address's local part is all of the run before its @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every pattern match that holds, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _MARK.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@dataclass
class Tokens:
    """A document's variables: spans, shape, observed label (0: other, or kind + 1), and edges as (left, right, skip)."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    labels: list[int]
    edges: list[tuple[int, int, int]]


def _shape(token: str) -> str:
    out = re.sub(r"[^\W\d_]+", "a", token)
    out = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}_", out)
    return out if len(out) <= 48 else "long"


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    spans, end = [], 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        token = text[start:end]
        left = len(token) - len(token.lstrip(_ENDS))
        right = len(token.rstrip(_ENDS))
        if right > left:
            spans.append((start + left, start + right))
    labels = [0] * len(spans)
    for kind, a, b in sorted(base, key=lambda s: s[1]):
        i = _first_ending_after(spans, a)
        while i < len(spans) and spans[i][0] < b:
            labels[i] = labels[i] or kind + 1
            i += 1
    edges, last = [], {}
    for i, (a, b) in enumerate(spans):
        if i and a - spans[i - 1][1] <= 2 and text[spans[i - 1][1] : a].isspace():
            edges.append((i - 1, i, 0))
        token = text[a:b].lower()
        digits = re.sub(r"\D", "", token)
        plain = not re.search(r"[^\W\d_]", token)
        keys = [token] if len(token) >= 4 else []
        if plain and len(digits) >= 7:
            keys += ["=" + digits, "~" + digits[-7:]]
        for j in {last[k] for k in keys if k in last}:
            edges.append((j, i, 1))
        last.update(dict.fromkeys(keys, i))
    return Tokens(spans, [_shape(text[a:b]) for a, b in spans], labels, edges)


def _first_ending_after(spans: list[tuple[int, int]], at: int) -> int:
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][1] <= at else (low, mid)
    return low


_STATES = len(KINDS) + 1


@dataclass
class Field:
    unary: dict[str, list[float]]
    unseen: list[float]
    pairs: list  # of chain and skip edges, log factors of two labels


def fit(docs: DataFrame) -> Field:
    """Count the factors' configurations where the patterns say what is personal."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sums() -> pa.RecordBatch:
            columns = list(zip(*seen, strict=True)) if seen else [[], [], [], []]
            out = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, ["what", "shape", "l", "r", "n"])

        for batch in batches:
            for text in batch.column(0):
                own = text.as_py() or ""
                if _MARK.search(own):
                    t = tokens_of(own, base_spans(own))
                    seen.update(("u", shape, label, 0) for shape, label in zip(t.shapes, t.labels, strict=True))
                    seen.update(("cs"[skip], "", t.labels[i], t.labels[j]) for i, j, skip in t.edges)
                    if len(seen) > HELD:
                        yield sums()
        yield sums()

    counted = materialise(docs.select("text").mapInArrow(lean(count), "what string, shape string, l int, r int, n bigint").groupBy("what", "shape", "l", "r").agg(F.sum("n").alias("n")), "field")
    by_label = [F.sum(F.when(F.col("l") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(_STATES)]
    unary = counted.where("what = 'u'")
    ranked = unary.groupBy("shape").agg(F.sum("n").alias("n"), *by_label).orderBy(F.desc("n"), "shape").limit(SHAPES)
    shapes = {r.shape: np.array([r[f"n{k}"] for k in range(_STATES)], float) for r in ranked.collect()}
    total, pairs = np.array([n or 0 for n in unary.agg(*by_label).first()], float), np.zeros((2, _STATES, _STATES))
    for r in counted.where("what <> 'u'").collect():  # a row for two labels and a kind of edge
        pairs["cs".index(r.what), r.l, r.r] += r.n
    discard(counted)
    prior = (total + 1) / (total.sum() + _STATES)
    unseen = prior * np.array([1.0] + [0.1] * len(KINDS))
    factors = []
    for seen in pairs:
        seen = seen + 0.5
        joint = (seen + seen.T) / (2 * seen.sum())
        factors.append(np.clip(np.log(joint / np.outer(joint.sum(0), joint.sum(1))), -6, 6).tolist())
    own = {s: np.log((n + 2 * unseen / unseen.sum()) / (n.sum() + 2)).tolist() for s, n in shapes.items()}
    return Field(own, np.log(unseen / unseen.sum()).tolist(), factors)


def marginals(field: Field, shapes: list[str], labels: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Label probabilities after ROUNDS of message passing over the edges (left, right, skip)."""
    unary = np.array([field.unary.get(s, field.unseen) for s in shapes]).reshape(len(shapes), _STATES)
    observed = labels > 0
    unary[observed] = -30.0
    unary[observed, labels[observed]] = 0.0
    belief = unary
    if len(edges):
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factor = np.array(field.pairs)[edges[:, 2]]
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        message = np.zeros((len(source), _STATES))
        for _ in range(ROUNDS):
            without = belief[source] - message[back]
            fresh = np.logaddexp.reduce(without[:, :, None] + factor, axis=1)
            fresh -= fresh.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * fresh
            gathered = np.stack([np.bincount(target, message[:, s], len(unary)) for s in range(_STATES)], axis=1)
            belief = unary + gathered
    belief = belief - belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def _added(t: Tokens, p: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Sure tokens that no pattern covers but edges join to one that a pattern does; neighbours of one kind are one span.

    Without that condition unobserved mentions could talk each other into a label.
    """
    group = list(range(len(t.spans)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, j, _ in t.edges:
        group[root(j)] = root(i)
    witnessed = {(root(i), label) for i, label in enumerate(t.labels) if label}
    out: list[list[int]] = []
    for i, (a, b) in enumerate(t.spans):
        kind = int(np.argmax(p[i]))
        if t.labels[i] or not kind or p[i, kind] < SURE or (root(i), kind) not in witnessed:
            continue
        if out and out[-1][0] == kind - 1 and out[-1][3] == i - 1 and a - out[-1][2] <= 2 and text[out[-1][2] : a].isspace():
            out[-1][2:] = [b, i]
        else:
            out.append([kind - 1, a, b, i])
    return [(k, a, b) for k, a, b, _ in out]


_SPANS = "array<struct<kind:int,start:bigint,end:bigint,added:boolean>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])
#: Variables whose fields are solved at once, about; a longer text's field is solved by itself.
_TOGETHER = 20_000


def find_spans(docs: DataFrame, field: Field, into: str = "spans") -> DataFrame:
    """The rows of docs with a column `into`: (kind, start, end, added), by kind and start; offsets count code points, end exclusive.

    A column of that name is replaced.
    """

    def solved(graphs: list[tuple[int, Tokens, str]]) -> Iterator[tuple[int, list]]:
        first = np.cumsum([0, *(len(g.spans) for _, g, _ in graphs)])
        edges = np.array([(a + f, b + f, s) for f, (_, g, _) in zip(first, graphs, strict=False) for a, b, s in g.edges], np.int64).reshape(-1, 3)
        p = marginals(field, [s for _, g, _ in graphs for s in g.shapes], np.array([x for _, g, _ in graphs for x in g.labels], np.int64), edges)
        for f, (i, g, text) in zip(first, graphs, strict=False):
            yield i, _added(g, p[f : f + len(g.spans)], text)

    def found(texts: pa.Array) -> list[list[tuple]]:
        base, graphs, size, added = [], [], 0, {}
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            base.append(base_spans(text))
            if _MARK.search(text):
                g = tokens_of(text, base[i])
                if not all(g.labels):
                    graphs.append((i, g, text))
                    size += len(g.spans)
            if size > _TOGETHER:
                added.update(solved(graphs))
                graphs, size = [], 0
        if graphs:
            added.update(solved(graphs))
        return [sorted([*((*s, False) for s in own), *((*s, True) for s in added.get(i, []))]) for i, own in enumerate(base)]

    docs = docs.drop(into)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in own] for own in found(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names, into])

    return with_column(docs, run, StructField(into, _parse_datatype_string(_SPANS)))


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first stands for all of them."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), names[s["kind"]])
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _is_base(kind: int) -> Callable[[Column], Column]:
    """Whether a span is a pattern match of a kind; a function of one argument, since a second would be the span's index."""
    return lambda s: ~s["added"] & (s["kind"] == kind)


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [F.size(F.filter("spans", _is_base(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
