"""Secrets in texts: all rules in one pass of one automaton over the bytes.

The rules' regular expressions become one nondeterministic automaton that may begin a match at every
byte; subset construction makes it deterministic and partition refinement minimises it. What is left is
an array of next states and, for each state, which rules are inside a possible match and which have just
completed one. A block of many documents is cut into lanes that step through that array together, one
byte each at a time; a lane that began in the wrong state is corrected from its left neighbour until both
agree, which is exact and hardly ever takes more than a few bytes.

A stretch of bytes that is inside a possible match of a rule contains every match that touches it, so
the rule's own expression is applied to just those stretches in which the automaton saw a match, to get
leftmost, non-overlapping matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches, type_of

BLOCK_BYTES = 4 << 20  # documents are joined to blocks of about so many bytes
LANE_BYTES = 512  # a lane's bytes, in large blocks
MAX_LANES = 8192
SEPARATOR = 0xFF  # never occurs in UTF-8; no rule can cross it
MAX_STATES = 20_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; of those, ``least`` characters in group ``group`` make a finding."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# The expressions and lengths of the base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]+", 16, 0, True),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]+=*", 27),
)
RULES = BASE_RULES + MORE_RULES


# --- rules to automaton ------------------------------------------------------------------------


@dataclass
class _Nfa:
    """States with edges on sets of bytes (as 256-bit numbers) and edges without a byte."""

    edges: list[list[tuple[int, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, parsed, at: int, any_case: bool) -> int:
        """Appends a parsed expression behind state ``at``; returns the state where it ends."""
        for op, arg in parsed:
            if op is sre.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, bool(any_case and not off & re.I or on & re.I))
            elif op is sre.BRANCH:
                ends = [self.add(one, self._behind(at), any_case) for one in arg[1]]
                at = self.state()
                for e in ends:
                    self.free[e].append(at)
            elif op is sre.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, any_case)
                if most is sre.MAXREPEAT:
                    loop = self._behind(at)
                    self.free[self.add(inner, loop, any_case)].append(loop)
                    at = self._behind(loop)
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.free[at].append(out)
                        at = self.add(inner, at, any_case)
                    self.free[at].append(out)
                    at = out
            else:
                end = self.state()
                self.edges[at].append((_bytes(op, arg, any_case), end))
                at = end
        return at

    def _behind(self, at: int) -> int:
        s = self.state()
        self.free[at].append(s)
        return s

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(op, arg, any_case: bool) -> int:
    """The bytes that one parsed item takes."""
    if op is sre.LITERAL:
        found = [arg]
    elif op is sre.IN:
        found, negated = [], False
        for kind, x in arg:
            if kind is sre.NEGATE:
                negated = True
            elif kind is sre.LITERAL:
                found.append(x)
            elif kind is sre.RANGE:
                found += range(x[0], x[1] + 1)
            else:
                raise ValueError(f"rules may not use {kind}")
        if negated:
            found = set(range(128)) - set(found)
    else:
        raise ValueError(f"rules may not use {op}")
    if any(b > 127 for b in found):
        raise ValueError("rules are about ASCII bytes")
    if any_case:
        found = {x for b in found for x in (ord(chr(b).lower()), ord(chr(b).upper()))}
    return sum(1 << b for b in set(found))


@dataclass(frozen=True)
class Automaton:
    """``step[state + byte_class[byte]]`` is the next state; states are multiples of the number of classes."""

    byte_class: np.ndarray
    step: np.ndarray
    flags: np.ndarray  # by state: bit r if rule r is inside a match, bit 8 + r if it has one that ends here
    n_states: int

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state behind each byte."""
        cls = self.byte_class[data]
        n = len(data)
        lanes = max(1, min(MAX_LANES, n // LANE_BYTES))
        size = -(-n // lanes)
        padded = np.zeros(lanes * size, dtype=np.int32)
        padded[:n] = cls
        columns = np.ascontiguousarray(padded.reshape(lanes, size).T)
        out = np.empty_like(columns)
        state = np.zeros(lanes, dtype=np.int32)
        for i in range(size):
            state = self.step.take(columns[i] + state)
            out[i] = state
        flat = np.ascontiguousarray(out.T).reshape(-1)[:n]
        step = self.step
        for first in range(size, n, size):
            now, i = int(flat[first - 1]), first
            if now == 0:
                continue
            while i < n:
                now = int(step[now + int(cls[i])])
                if now == flat[i]:
                    break
                flat[i] = now
                i += 1
        return flat


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    if len(rules) > 8:
        raise ValueError("flags hold eight rules")
    nfa = _Nfa()
    start = nfa.state()
    owner: dict[int, int] = {}
    accepts: dict[int, int] = {}
    for r, rule in enumerate(rules):
        known = len(nfa.edges)
        first = nfa._behind(start)
        accepts[nfa.add(_parser.parse(rule.pattern), first, False)] = r
        owner.update(dict.fromkeys(range(known, len(nfa.edges)), r))
    begin = nfa.closure([start])

    # Bytes that no edge tells apart are one class.
    sets = sorted({mask for edges in nfa.edges for mask, _ in edges})
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(m >> b & 1 for m in sets), len(kinds)) for b in range(256)], dtype=np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(kinds))]

    # Subset construction; a match may begin at every byte, so the start is always included.
    subsets, todo, table = {begin: 0}, [begin], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            reached = nfa.closure([to for s in now for mask, to in nfa.edges[s] if mask >> b & 1]) | begin
            if reached not in subsets:
                subsets[reached] = len(subsets)
                todo.append(reached)
                if len(subsets) > MAX_STATES:
                    raise ValueError("the rules need too many states")
            row.append(subsets[reached])
        table.append(row)
    step = np.array(table)
    flags = np.zeros(len(subsets), dtype=np.uint16)
    for states, i in subsets.items():
        for s in states:
            if s not in begin:
                flags[i] |= 1 << owner[s]
            if s in accepts:
                flags[i] |= 256 << accepts[s]

    # Minimisation: split classes of states until members of one class have the same next classes.
    group = np.unique(flags, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    for g in group:  # the start state gets number 0
        if order[g] < 0:
            order[g] = order.max() + 1
    group = order[group]
    member = np.zeros(group.max() + 1, dtype=int)
    member[group] = np.arange(len(group))
    classes = len(sample)
    small = group[step[member]] * classes
    spread = np.zeros(len(member) * classes, dtype=np.uint16)
    spread[::classes] = flags[member]
    return Automaton(byte_class, small.reshape(-1).astype(np.int32), spread, len(member))


# --- scanning ----------------------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], automaton: Automaton):
        self.rules, self.automaton = rules, automaton
        self.regex = [re.compile(r.pattern.encode()) for r in rules]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its findings (start, rule, end) in code points, in order."""
        found: list[list] = [[] for _ in texts]
        joined = bytes([SEPARATOR]).join(texts)
        if not joined:
            return found
        data = np.frombuffer(joined, dtype=np.uint8)
        flags = self.automaton.flags[self.automaton.states(data)]
        spans = []
        for r, rule in enumerate(self.rules):
            hits = np.flatnonzero(flags & (256 << r))
            if not len(hits):
                continue
            edge = np.diff(((flags >> r) & 1).astype(np.int8), prepend=0, append=0)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            use = (np.searchsorted(hits, last) > np.searchsorted(hits, first)) & (last - first >= rule.least)
            for a, b in zip(first[use].tolist(), last[use].tolist(), strict=True):
                for m in self.regex[r].finditer(joined, a, b):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans.append((m.start(), r, m.end()))
        if not spans:
            return found
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        at = np.array(spans)
        doc = np.searchsorted(starts, at[:, 0], side="right") - 1
        base = points[starts[doc]]
        rows = zip(doc.tolist(), (points[at[:, 0]] - base).tolist(), at[:, 1].tolist(), (points[at[:, 2]] - base).tolist(), strict=True)
        for d, start, r, end in rows:
            found[d].append((start, r, end))
        for f in found:
            f.sort()
        return found


def _blocks(texts: list[bytes]):
    """Index ranges of about BLOCK_BYTES."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BLOCK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _spelled(rules: tuple[Rule, ...], found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[r].kind}:{start}:{end}" for start, r, end in found)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, found (array of kind, start, end), a count ``n_<kind>`` for each base rule, base_sha256, spans.

    Starts and ends count code points, ends are exclusive; findings are in order of start, then of
    rule. Null texts count as empty: no findings, the digest of the empty string, empty ``spans``.
    A null or repeated doc_id is passed on; other columns are not read. Texts are scanned whole,
    whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rules, compile_rules(rules)))
    base = [r for r, rule in enumerate(rules) if rule.base]

    def start() -> Callable:
        scanner = Scanner(*shared.value)

        def each(batch):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            found = [f for a, b in _blocks(texts) for f in scanner.scan(texts[a:b])]
            made = {
                "doc_id": batch.column(0),
                "found": [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in f] for f in found],
                "spans": [_spelled(rules, f) for f in found],
                "base_sha256": [
                    hashlib.sha256(_spelled(rules, [x for x in f if x[1] in base]).encode()).hexdigest() for f in found
                ],
            }
            yield made | {f"n_{rules[r].kind}": [sum(x[1] == r for x in f) for f in found] for r in base}

        return each

    counts = "".join(f", n_{rules[r].kind} long" for r in base)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = f"doc_id {type_of(picked, 'doc_id')}, found array<struct<kind:string,start:long,end:long>>{counts}, base_sha256 string, spans string"
    return map_batches(picked, schema, start)
