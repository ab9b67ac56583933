"""Secret scans with probabilistic automata inferred from labelled credentials.

Base spans come from three fixed patterns. Their values are labelled credentials of three
kinds; for each kind a prefix tree of character classes is built from a bounded sample and
its statistically compatible states are merged (Hoeffding test on the shares of endings
and continuations) into a probabilistic automaton. Then every candidate, a run of 16 or
more credential characters anywhere in a text, is scored by its likelihood under each
automaton. A candidate is added as an ``inferred`` span when its code is no longer, by
character, than that of nearly all labelled credentials of the kind and clearly shorter
than under a model of ordinary runs.

Training looks at every text. Only the shapes of the values leave the tasks (each letter or digit
as its class) with a hash of the value, so no credential is written anywhere. It keeps at most
``max_labels`` distinct values a kind and ``max_words`` ordinary runs (chosen by hash, so the
choice spreads over all rows), of at most ``max_chars`` characters together, and sends
automata of bounded size to the executors. Of a value longer than ``LONGEST`` that many
characters are learned from, and it counts as going on there, not as ending. Scans take whole values.

Defined cases: null text counts as empty; spans are in code points, ends exclusive; a kind
without labelled values gets no automaton; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = (*LEAST, "inferred")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
PLAIN = re.compile(r"[A-Za-z][a-z]+(?:[-/_][A-Za-z][a-z]*)*")
CLASS = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
CLASS_BITS = {k: math.log2(n) for k, n in Counter(CLASS.values()).items()}

#: Characters of one value that are learned from.
LONGEST = 4096
_SHAPES = str.maketrans(CLASS)

Span = tuple[str, int, int]
Sample = tuple[str, bool]


def shape(value: str) -> str:
    """The classes of a value's characters; signs stand for themselves."""
    return value.translate(_SHAPES)


def sampled(value: str) -> Sample:
    """What is learned of a value: its shape, and whether that is all of it."""
    return shape(value[:LONGEST]), len(value) <= LONGEST


def base_spans(text: str) -> list[Span]:
    """The matches of the three patterns, each kind leftmost and non-overlapping."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):  # longer matches of the other patterns lie inside such a run
        a, s = run.start(), run[0]
        if "AKIA" in s:
            out += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= LEAST["access"]]
        if len(s) >= LEAST["hex"]:
            out += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= LEAST["hex"]]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters that are no plain words and touch no base span; ``spans``: by their beginnings, as runs are."""
    out, k, far = [], 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] < b:
            far = max(far, spans[k][2])
            k += 1
        if far <= a and not PLAIN.fullmatch(m[0]):
            out.append((a, b))
    return out


def value_of(text: str, span: Span) -> str:
    found = text[span[1] : span[2]]
    return ASSIGN.fullmatch(found)[2] if span[0] == "assign" else found


@dataclass
class State:
    arrived: int = 0
    ended: int = 0
    next: dict[str, "Edge"] = field(default_factory=dict)


@dataclass
class Edge:
    count: int
    to: int


class Automaton:
    """A probabilistic automaton over character classes, inferred by merging prefix-tree states."""

    def __init__(self, samples: list[Sample], *, alpha: float = 0.05) -> None:
        self.states = [State()]
        for kinds, whole in samples:
            at = 0
            for c in kinds:
                self.states[at].arrived += 1
                edge = self.states[at].next.get(c)
                if edge is None:
                    edge = self.states[at].next[c] = Edge(0, len(self.states))
                    self.states.append(State())
                edge.count += 1
                at = edge.to
            self.states[at].arrived += 1
            self.states[at].ended += whole
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.bits_limit = 0.0
        each = sorted(self.bits(kinds) / len(kinds) for kinds, whole in samples if whole)
        if each:
            self.bits_limit = each[min(len(each) - 1, int(0.99 * len(each)))]

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > (1 / math.sqrt(n) + 1 / math.sqrt(m)) * self.slack

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = (self.states[x] for x in todo.pop())
            if self._differ(p.ended, p.arrived, q.ended, q.arrived):
                return False
            for c in p.next.keys() | q.next.keys():
                e, f = p.next.get(c), q.next.get(c)
                if self._differ(e.count if e else 0, p.arrived, f.count if f else 0, q.arrived):
                    return False
                if e and f:
                    todo.append((e.to, f.to))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = self.states[x], self.states[y]
            p.arrived += q.arrived
            p.ended += q.ended
            for c, f in q.next.items():
                e = p.next.get(c)
                if e is None:
                    p.next[c] = Edge(f.count, f.to)
                else:
                    e.count += f.count
                    todo.append((e.to, f.to))

    def _merge(self) -> None:
        kept = [0]
        while True:
            core = set(kept)
            fringe = [(s, c) for s in kept for c, e in sorted(self.states[s].next.items()) if e.to not in core]
            if not fringe:
                break
            s, c = max(fringe, key=lambda x: (self.states[self.states[x[0]].next[x[1]].to].arrived, -x[0], x[1]))
            edge = self.states[s].next[c]
            for old in kept:
                if self._compatible(old, edge.to):
                    new, edge.to = edge.to, old
                    self._fold(old, new)
                    break
            else:
                kept.append(edge.to)
        number = {s: i for i, s in enumerate(kept)}
        self.states = [self.states[s] for s in kept]
        for state in self.states:
            for e in state.next.values():
                e.to = number[e.to]

    def bits(self, kinds: str, unseen: float = 24.0) -> float:
        """Code length of a value of this shape; a step that no sample took costs ``unseen`` bits."""
        at, bits = 0, 0.0
        for kind in kinds:
            bits += CLASS_BITS.get(kind, 0.0)
            edge = self.states[at].next.get(kind)
            if edge is None:
                bits += unseen
                continue
            bits -= math.log2(edge.count / self.states[at].arrived)
            at = edge.to
        state = self.states[at]
        return bits + (-math.log2(state.ended / state.arrived) if state.ended else unseen)


class Ordinary:
    """How ordinary runs of credential characters look: pairs of classes, with add-one counts."""

    def __init__(self, samples: list[Sample]) -> None:
        self.pairs = Counter(pair for k, _ in samples for pair in zip(" " + k, k, strict=False))
        self.first = Counter()
        for (p, _), n in self.pairs.items():
            self.first[p] += n

    def bits(self, kinds: str) -> float:
        before, bits = " ", 0.0
        for kind in kinds:
            bits += CLASS_BITS.get(kind, 0.0) - math.log2((self.pairs[before, kind] + 1) / (self.first[before] + 10))
            before = kind
        return bits


@dataclass
class Formats:
    automata: dict[str, Automaton]
    ordinary: Ordinary
    margin: float

    def score(self, value: str) -> float:
        """Bits by which the best automaton's code is shorter than the ordinary one; negative infinity if none fits."""
        best, value = -math.inf, shape(value)
        for automaton in self.automata.values():
            if (bits := automaton.bits(value)) <= (automaton.bits_limit + 0.05) * len(value):
                best = max(best, self.ordinary.bits(value) - bits)
        return best

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans with the inferred ones."""
        base = base_spans(text)
        more = [("inferred", a, b) for a, b in candidates(text, base) if self.score(text[a:b]) >= self.margin]
        return base, ordered(base + more)


def learn_formats(docs: DataFrame, *, text_col: str = "text", max_labels: int = 400, max_words: int = 2000, max_chars: int = 100_000, margin: float = 8.0) -> Formats:
    """Fit the automata on the labelled credentials of all texts; ``max_chars`` bounds what a kind learns from."""

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for text in batch["text"]:
                if text:
                    base = base_spans(text)
                    found.update((kind, value_of(text, (kind, a, b))) for kind, a, b in base)
                    found.update(("word", text[a:b]) for a, b in candidates(text, base))
            rows = [(kind, int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True), *sampled(v)) for kind, v in sorted(found)]
            yield pd.DataFrame(rows, columns=["kind", "at", "shape", "whole"])

    rows = bounded_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInPandas(labels, "kind string, at long, shape string, whole boolean")
    rows = staged(rows, "shapes")
    picked: dict[str, list[Sample]] = {}
    for kind in (*LEAST, "word"):
        n = max_words if kind == "word" else max_labels
        near = rows.where(F.col("kind") == kind).select("at", "shape", "whole").distinct().orderBy("at", "shape").limit(n).collect()
        room = accumulate(len(r["shape"]) for r in near)
        picked[kind] = [(r["shape"], r["whole"]) for i, (r, used) in enumerate(zip(near, room, strict=True)) if i == 0 or used <= max_chars]
    automata = {k: Automaton(v) for k, v in picked.items() if k != "word" and v}
    return Formats(automata, Ordinary(picked["word"]), margin)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, *, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id, n_assign, n_access, n_hex, n_inferred, base_sha256, spans)`` for every row."""
    formats = formats or learn_formats(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = sent.value.spans(text or "")
                n = Counter(k for k, _, _ in spans)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_inferred", "base_sha256", "spans"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_inferred long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span], mark: str) -> str:
    """The text with every stretch that spans cover, together or alone, replaced by the mark."""
    out, at, upto = [], 0, -1
    for _, a, b in spans:
        if a > upto:
            out += [text[at:a], mark]
        at = upto = max(upto, b)
    return "".join([*out, text[max(at, 0) :]])


def redact_secrets(docs: DataFrame, *, formats: Formats | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with the secrets in the text replaced; null text stays null."""
    formats = formats or learn_formats(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    named = [f"c{i}" for i in range(len(docs.columns))]
    at = named[docs.columns.index(text_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[at] = [x if x is None else redact(x, sent.value.spans(x)[1], mark) for x in batch[at]]
            yield batch

    rows = bounded_batches(docs).toDF(*named)
    return rows.mapInPandas(run, rows.schema).toDF(*docs.columns)
