"""Secret scan: all rules in one byte pass of a combined minimal automaton; spans by automata as well.

The texts of a block lie behind one another with a newline between them; ``automaton.scan`` steps the combined automaton
over the bytes once. Where a rule ends, the segment around it is taken: from the last byte after which the automaton had
nothing begun to the next such byte; no match crosses its border. In these few segments the rule's mirrored automaton, run
backwards, marks every byte at which a match begins, and the rule's own automaton gives the longest match from there. So
the spans are the leftmost, longest, non-overlapping matches of the whole text; those that fail their length are dropped
afterwards, as they consume text all the same.

Null text is empty and has no spans; any text of any length is scanned whole; equal rows have equal results, rows that
share an id are scanned each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .automaton import Automaton, Rule, compile_rules, compile_trees, longest, mirrored, scan, tree
from .common import arrow_map, blocks, text_bytes

#: The base kinds come first, in the order of the report.
BASE = ("assign", "access", "hex")
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6, "[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
)


def scanned(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """What the combined automaton looks for: a bare run ``[..]+`` of a least length is that many repeats, so that short runs never count.

    Behind a literal head the length is left to the check of the segment: counting there would need a state for each set
    of places at which the head can have begun.
    """
    return tuple(Rule(r.kind, f"{r.pattern[:-1]}{{{r.least}}}") if r.least and not r.tail and re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else r for r in rules)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    all: Automaton
    back: tuple[Automaton, ...]  # of each rule read backwards, begun anew at every byte
    whole: tuple[Automaton, ...]  # of each rule from one start
    head: tuple[Automaton | None, ...]  # of the part before the tail
    tail: tuple[np.ndarray | None, ...]  # bytes of the tail


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [tree(r.whole) for r in rules]
    tails = []
    for r in rules:
        mask = None
        if r.tail:
            mask = np.zeros(256, bool)
            mask[sorted(tree(("(?i)" if r.pattern.startswith("(?i)") else "") + r.tail)[1][0][1])] = True
        tails.append(mask)
    return Scanner(
        rules,
        compile_rules(scanned(rules)),
        tuple(compile_trees([mirrored(t)]) for t in trees),
        tuple(compile_trees([t], restart=False) for t in trees),
        tuple(compile_trees([tree(r.pattern)], restart=False) if r.tail else None for r in rules),
        tuple(tails),
    )


def find(texts: tuple[np.ndarray, np.ndarray], s: Scanner) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, [(start, end, rule)...]) of each text that has a span; places in code points, ordered by start, then rule."""
    raw, offs = texts
    n = len(offs) - 1
    # a newline between the texts: no rule matches across it
    spaced = np.full(len(raw) + n, 10, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    spaced[np.arange(len(raw)) + row] = raw
    begin = offs[:-1] + np.arange(n)
    state, ends = scan(s.all, spaced)
    if not len(ends):
        return
    idle = np.flatnonzero(state == 0)
    bits = s.all.accepts[state[ends] // s.all.n_classes]
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for r, rule in enumerate(s.rules):
        own = ends[(bits >> r) & 1 == 1]
        if not len(own):
            continue
        k = np.searchsorted(idle, own)
        left = np.where(k > 0, idle[np.maximum(k - 1, 0)] + 1, 0) if len(idle) else np.zeros(len(own), np.int64)
        right = np.where(k < len(idle), idle[np.minimum(k, len(idle) - 1)], len(spaced)) if len(idle) else np.full(len(own), len(spaced))
        segments = np.unique(np.column_stack([left, right]), axis=0)
        for a, b in _matches(spaced, segments[:, 0], segments[:, 1], s, r, rule.least):
            doc = int(np.searchsorted(begin, a, side="right")) - 1
            spans.setdefault(doc, []).append((a, b, r))
    for doc, found in spans.items():
        text = spaced[begin[doc] : begin[doc] + offs[doc + 1] - offs[doc]]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        yield doc, sorted((int(points[a - begin[doc]]), int(points[b - begin[doc]]), r) for a, b, r in found)


def _matches(raw: np.ndarray, left: np.ndarray, right: np.ndarray, s: Scanner, r: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the matches of rule ``r`` in the segments, those of enough length."""
    size = right - left + 1  # and a newline before each segment, read last
    at = np.repeat(right - 1, size) - (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    read = np.where(at >= np.repeat(left, size), raw[np.maximum(at, 0)], 10).astype(np.uint8)
    starts = np.sort(at[scan(s.back[r], read)[1]])
    cursor, live = left.copy(), np.arange(len(left))
    while len(live):
        k = np.searchsorted(starts, cursor[live])
        ok = (k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] < right[live]) if len(starts) else np.zeros(len(live), bool)
        live, k = live[ok], k[ok]
        if not len(live):
            return
        a = starts[k]
        b = longest(s.whole[r], raw, a, right[live])
        counted = longest(s.head[r], raw, a, right[live], s.tail[r]) if s.head[r] is not None else a
        cursor[live] = b
        enough = b - counted >= least
        yield from zip(a[enough].tolist(), b[enough].tolist(), strict=True)


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, e, r in sorted(spans, key=lambda x: (x[0], x[2])))


def secret_spans(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256 and spans (of all rules)."""
    own = scanner(rules)
    base = [k for k, r in enumerate(rules) if r.kind in BASE]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for rows in blocks(np.diff(offs)):
                part = offs[rows.start : rows.stop + 1]
                found = dict(find((raw[part[0] : part[-1]], part - part[0]), own))
                n = rows.stop - rows.start
                counts = np.zeros((3, n), np.int64)
                digest, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
                for i, x in found.items():
                    kept = [s for s in x if s[2] in base]
                    for s in kept:
                        counts[BASE.index(rules[s[2]].kind), i] += 1
                    digest[i], spans[i] = hashlib.sha256(joined(kept, rules).encode()).hexdigest(), joined(x, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
