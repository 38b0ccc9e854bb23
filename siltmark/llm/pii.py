"""Personal data by patterns and a skip-chain conditional random field.

Base patterns (email, ip, card, phone) are found in every whole text. The nodes of a text's
field are its base spans and its further candidates: digit groups of 7 to 19 digits, and words
equal to the local part of an email of the same text. Skip edges join each candidate to the
previous one with the same digits (*equal*) or the same last seven digits (*similar*), and each
local part to the previous use of it: a chain per key, so edges stay linear in the nodes. Loopy
sum-product sweeps along these edges, forward and backward until they settle, give marginals; a candidate that takes an entity label
through a base span it is connected to becomes an added span. Base spans stay.

Weights are fitted by penalised pseudo-likelihood on a sample of at most ``TRAIN_TEXTS`` texts
(those with the smallest hash among texts with a digit, of at most ``TRAIN_CHARS`` characters).
The labels are the base spans; the shape features leave out what the patterns themselves decide
by, so that they speak for candidates too. Everything else runs over all rows, inside tasks.

Defined cases: NULL and empty texts have no spans; repeated rows are scanned each; an empty
table gives no rows (and default weights); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.workers import task

#: Fixed order: it decides ties between spans that start together. Label 0 is "none".
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)

TRAIN_TEXTS, TRAIN_CHARS = 1000, 20_000
#: Prior means of the edge weights (equal, similar) and penalties of edge and shape weights.
SKIP_PRIOR, SKIP_PENALTY, SHAPE_PENALTY = (6.0, 4.0), 20.0, 5.0
#: Evidence of a base pattern for its own label, and the marginal a candidate needs.
EVIDENCE, ACCEPT = 12.0, 0.5
#: Sweeps cross whole chains, so their bound does not depend on lengths; the later half is damped.
SWEEPS, DAMPING, CLOSE = 200, 0.3, 1e-4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"(?<![\w@])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9])+(?![\w@])", re.ASCII)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, index in KINDS, end


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs: the local part is the run before one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, 0, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    spans = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


@dataclass
class Field:
    """Nodes (spans with their shape features) and skip edges of one text."""

    spans: list[tuple[int, int]]
    labels: np.ndarray
    shapes: np.ndarray
    edges: np.ndarray  # rows of (earlier, later, 0 equal or 1 similar)


FEATURES = 8


def _shape(s: str, digits: str) -> list[float]:
    n = len(digits)
    return [1.0, n < 10, 10 <= n <= 13, 14 <= n <= 16, n > 16, n >= 14 and luhn(digits), s.count(".") == 3, any(c.isalpha() for c in s)]


def field(text: str, base: list[Span]) -> Field | None:
    """The field of a text; None if no two nodes could be joined."""
    nodes = [(a, b, k + 1) for a, k, b in base]
    reach, covered = 0, []
    for a, _, b in base:
        if b > reach:
            covered.append((max(a, reach), b))
            reach = b
    starts = np.array([a for a, _ in covered], dtype=np.int64)

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b))
        return i == 0 or covered[i - 1][1] <= a

    for m in _GROUP.finditer(text):
        if 7 <= len(_digits(m.group())) <= 19 and free(m.start(), m.end()):
            nodes.append((m.start(), m.end(), 0))
    locals_ = {text[a : text.index("@", a)].lower() for a, k, _ in base if k == 0}
    words = set()
    if locals_:
        for m in _LOCAL.finditer(text):
            if m.group().lower() in locals_ and free(m.start(), m.end()):
                words.add((m.start(), m.end()))
        nodes += {(a, b, 0) for a, b in words} - set(nodes)
    if len(nodes) < 2:
        return None
    nodes.sort()
    last: dict[tuple[str, str], int] = {}
    edges = set()
    shapes = []
    for i, (a, b, label) in enumerate(nodes):
        s = text[a:b]
        digits = _digits(s)
        shapes.append(_shape(s, digits))
        keys = []
        if label == 1:
            keys.append(("local", s.partition("@")[0].lower(), 0))
        elif label == 0 and (a, b) in words:
            keys.append(("local", s.lower(), 0))
        if label != 1 and not shapes[-1][-1] and len(digits) >= 7:
            keys += [("equal", digits, 0), ("similar", digits[-7:], 1)]
        for name, key, kind in keys:
            before = last.get((name, key))
            if before is not None and (before, i, 0) not in edges:
                edges.add((before, i, kind))
            last[(name, key)] = i
    return Field(
        [(a, b) for a, b, _ in nodes], np.array([x for _, _, x in nodes]), np.array(shapes, dtype=float),
        np.array(sorted(edges), dtype=np.int64).reshape(-1, 3),
    )


@dataclass(frozen=True)
class Weights:
    shape: tuple[tuple[float, ...], ...]
    skip: tuple[float, float]


DEFAULT = Weights(tuple((0.0,) * FEATURES for _ in range(LABELS)), SKIP_PRIOR)


def fit(fields: list[Field], steps: int = 300, rate: float = 0.5) -> Weights:
    """Maximum penalised pseudo-likelihood: each node given the labels at its edges."""
    if not fields:
        return DEFAULT
    shapes, labels = np.concatenate([f.shapes for f in fields]), np.concatenate([f.labels for f in fields])
    agree = np.zeros((2, len(labels), LABELS))
    at = 0
    for f in fields:
        for a, b, kind in f.edges:
            agree[kind, at + a, f.labels[b]] += 1
            agree[kind, at + b, f.labels[a]] += 1
        at += len(f.labels)
    w, skip = np.zeros((LABELS, FEATURES)), np.array(SKIP_PRIOR)
    truth = np.eye(LABELS)[labels]
    for _ in range(steps):
        logits = shapes @ w.T + np.tensordot(skip, agree, 1)
        p = np.exp(logits - logits.max(1, keepdims=True))
        rest = truth - p / p.sum(1, keepdims=True)
        w += rate * (rest.T @ shapes - SHAPE_PENALTY * w) / (len(labels) + SHAPE_PENALTY)
        skip += rate * (np.tensordot(agree, rest, 2) - SKIP_PENALTY * (skip - SKIP_PRIOR)) / (len(labels) + SKIP_PENALTY)
    return Weights(tuple(map(tuple, w.tolist())), (max(0.0, float(skip[0])), max(0.0, float(skip[1]))))


def marginals(f: Field, w: Weights) -> np.ndarray:
    """Loopy sum-product in logarithms; base spans carry their evidence."""
    own = f.shapes @ np.array(w.shape).T
    known = np.flatnonzero(f.labels)
    own[known, f.labels[known]] += EVIDENCE
    # Forward by the later node, backward by the earlier one: a chain is exact after one sweep.
    gain = [float(np.expm1(x)) for x in w.skip]
    there = [(int(a), int(b), int(n), 0, gain[k]) for n, (a, b, k) in sorted(enumerate(f.edges), key=lambda e: (e[1][1], e[1][0]))]
    back = [(int(b), int(a), int(n), 1, gain[k]) for n, (a, b, k) in sorted(enumerate(f.edges), key=lambda e: (-e[1][0], -e[1][1]))]
    sent = np.zeros((2, len(f.edges), LABELS))
    total = own.copy()
    for sweep in range(SWEEPS):
        moved = 0.0
        for a, b, n, way, g in there + back:
            cavity = total[a] - sent[1 - way, n]
            e = np.exp(cavity - cavity.max())
            new = np.log(e.sum() + g * e)
            new -= new.max()
            if 2 * sweep >= SWEEPS:
                new = DAMPING * sent[way, n] + (1 - DAMPING) * new
            change = new - sent[way, n]
            moved = max(moved, -change.min(), change.max())
            total[b] += change
            sent[way, n] = new
        if moved < CLOSE:
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(f: Field, w: Weights) -> list[Span]:
    """Candidates that take a label which a base span in their part of the field has."""
    if not len(f.edges):
        return []
    p = marginals(f, w)
    root = list(range(len(f.labels)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in f.edges:
        root[find(int(a))] = find(int(b))
    backed = {(find(i), int(x)) for i, x in enumerate(f.labels) if x}
    out = []
    for i in np.flatnonzero(f.labels == 0):
        k = int(p[i].argmax())
        if k and p[i, k] >= ACCEPT and (find(int(i)), k) in backed:
            out.append((f.spans[i][0], k - 1, f.spans[i][1]))
    return out


def spans_of(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each sorted by start, then kind."""
    base = base_spans(text)
    f = field(text, base) if base else None
    return base, sorted(base + added_spans(f, w)) if f else base


def train(df: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS) -> Weights:
    """Weights from a bounded sample; the one thing that passes the driver."""
    able = df.select(F.col(text).alias("t")).where(F.length(text) <= TRAIN_CHARS).where(F.col("t").rlike("[0-9]")).withColumn("h", F.xxhash64("t"))
    # Hashes alone are ordered; only the texts up to the last of them are read and moved.
    cut = able.select("h").orderBy("h").limit(texts).agg(F.max("h").alias("h")).first()["h"]
    if cut is None:
        return DEFAULT
    some = able.where(F.col("h") <= cut).groupBy("h").agg(F.min("t").alias("t")).orderBy("h")
    rows = some.limit(texts).toArrow().column("t").to_pylist()
    return fit([f for t in rows if (f := field(t, base_spans(t)))])


def _scan(shape: tuple, skip: tuple, text: str):
    w = Weights(shape, skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        for batch in batches:
            found = [spans_of(v.as_py() or "", w) for v in batch.column(batch.schema.get_field_index(text))]
            keep = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != text}
            for n, name in enumerate(("base", "spans")):
                keep[name] = pa.array([[{"start": a, "kind": k, "stop": b} for a, k, b in x[n]] for x in found], kind)
            yield pa.RecordBatch.from_pydict(keep)

    return run


def scan(df: DataFrame, w: Weights | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, stop) of every row. No shuffle."""
    w = w or train(df, text)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    span = "array<struct<start:bigint,kind:int,stop:bigint>>"
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task(_scan, w.shape, w.skip, "_text"), f"doc_id {id_type}, base {span}, spans {span}")
