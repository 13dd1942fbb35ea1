"""Regular expressions to one combined, minimised deterministic automaton over bytes.

Supported syntax: literals, ``.``-free classes ``[...]``, escapes ``\\xHH`` and of punctuation, groups, ``|``, ``? * +`` and
``{n}``, ``{n,}``. Each rule becomes a Thompson automaton; the union, restarted at every byte, is made deterministic by
subset construction and minimised by partition refinement. The result is a pair of arrays: the next state for (state,
byte class) and the set of rules that end in a state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def link(self, a: int, b: int) -> None:
        self.eps[a].append(b)


class _Parser:
    """Recursive descent; every method returns a syntax tree of tuples."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def more(self, chars: str = "") -> bool:
        return self.i < len(self.p) and (not chars or self.p[self.i] in chars)

    def alternatives(self):
        parts = [self.sequence()]
        while self.more("|"):
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self.more("?*+{"):
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                self.i = end + 1
                least = int(low)
                tail = [("star", node)] if comma and not high else [("opt", node)] * (int(high) - least if high else 0)
                node = ("seq", [node] * least + tail)
            else:
                self.i += 1
                node = {"?": ("opt", node), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        return node

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def atom(self):
        if self.more("("):
            self.i += 1
            node = self.alternatives()
            if not self.more(")"):
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return node
        if self.more("["):
            self.i += 1
            negate = self.more("^")
            self.i += negate
            found: set[int] = set()
            while not self.more("]"):
                a = self.byte()
                if self.more("-") and self.p[self.i + 1] != "]":
                    self.i += 1
                    found |= set(range(a, self.byte() + 1))
                else:
                    found.add(a)
            self.i += 1
            return ("set", self.folded(set(range(256)) - found if negate else found))
        return ("set", self.folded({self.byte()}))

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(found)


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add ``node`` behind ``start``; the state in which it ends."""
    kind, arg = node
    if kind == "set":
        end = nfa.state()
        nfa.move[start] = (arg, end)
        return end
    if kind == "seq":
        for x in arg:
            between = nfa.state()
            nfa.link(start, between)
            start = _build(nfa, x, between)
        return start
    end = nfa.state()
    for x in arg if kind == "or" else [arg]:
        first = nfa.state()
        nfa.link(start, first)
        last = _build(nfa, x, first)
        nfa.link(last, end)
        if kind == "star":
            nfa.link(last, start)
    if kind != "or":
        nfa.link(start, end)
    return end


@dataclass(frozen=True)
class Automaton:
    classes: np.ndarray  # byte -> class
    step: np.ndarray  # state * n_classes + class -> state; state 0 is "nothing begun"
    accepts: np.ndarray  # state -> bit set of rules that end here
    n_classes: int

    @property
    def n_states(self) -> int:
        return len(self.accepts)


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax above, ``(?i)`` in front for letters of either case; ``least`` is the fewest bytes of a match that counts.

    ``tail``: a class ``[...]`` whose run of one or more ends the match, behind what ``pattern`` matches; then ``least`` is about that run.
    """

    kind: str
    pattern: str
    least: int = 0
    tail: str = ""

    @property
    def whole(self) -> str:
        return self.pattern + (f"{self.tail}+" if self.tail else "")


def tree(pattern: str):
    """The syntax tree of a pattern."""
    pattern, fold = (pattern[4:], True) if pattern.startswith("(?i)") else (pattern, False)
    p = _Parser(pattern, fold)
    found = p.alternatives()
    if p.i < len(pattern):
        raise ValueError(f"unbalanced {pattern!r}")
    return found


def mirrored(node):
    """The tree of the words of ``node`` read backwards."""
    kind, arg = node
    if kind == "set":
        return node
    if kind == "seq":
        return ("seq", [mirrored(x) for x in reversed(arg)])
    return (kind, [mirrored(x) for x in arg] if kind == "or" else mirrored(arg))


def compile_rules(rules: tuple[Rule, ...], max_states: int = 60_000) -> Automaton:
    """One automaton for all rules, begun anew at every byte."""
    return compile_trees([tree(r.whole) for r in rules], max_states)


def compile_trees(trees: list, max_states: int = 60_000, restart: bool = True) -> Automaton:
    """The minimal automaton of the trees; ``restart``: a match may begin at any byte, else only at the first one."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for k, node in enumerate(trees):
        first = nfa.state()
        nfa.link(root, first)
        final[_build(nfa, node, first)] = 1 << k

    # bytes that no rule tells apart form a class
    sets = list({m[0] for m in nfa.move if m})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    order = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([order[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in order]

    def closure(states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.move[x] or x in final)

    one = [closure([m[1]]) if m else frozenset() for m in nfa.move]
    begin = closure([root])
    again = begin if restart else frozenset()
    number, todo, table = {begin: 0}, [begin], []
    while todo:
        nexts = []
        for now in todo:
            row = []
            moves = [(nfa.move[x][0], one[x]) for x in now if nfa.move[x]]
            for b in sample:
                then = frozenset().union(again, *(c for s, c in moves if b in s))
                if then not in number:
                    number[then] = len(number)
                    nexts.append(then)
                    if len(number) > max_states:
                        raise ValueError("the rules need too many states")
                row.append(number[then])
            table.append(row)
        todo = nexts
    step = np.array(table, np.int64)
    accepts = np.array([sum(v for f, v in final.items() if f in s) for s in number], np.int64)

    # partition refinement: states stay together while their rules and their successors' parts agree
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    _, head = np.unique(part, return_index=True)
    rank = np.argsort(np.argsort(head))  # parts numbered by their first state, so that the start is 0
    part, head = rank[part], np.sort(head)
    small = np.uint16 if len(head) * len(sample) < 65536 else np.int32
    return Automaton(classes, (part[step[head]] * len(sample)).astype(small).reshape(-1), accepts[head], len(sample))


def longest(auto: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Of an automaton without restart: how far the longest match reaches from each start (-1: none), looking no further than ``ends``.

    ``before``: bytes (a mask of 256) of which one must stand right behind the match. All starts step together.
    """
    by_class = auto.step.reshape(-1, auto.n_classes)
    dead = ((by_class == (np.arange(auto.n_states) * auto.n_classes)[:, None]).all(1)) & (auto.accepts == 0)
    kinds, n = auto.classes[raw], len(raw)
    found = np.full(len(starts), -1, np.int64)
    state, at, live = np.zeros(len(starts), np.int64), starts.astype(np.int64).copy(), np.flatnonzero(starts < ends)
    follows = (lambda x: np.ones(len(x), bool)) if before is None else (lambda x: (x < n) & before[raw[np.minimum(x, n - 1)]])
    while len(live) > 1 or len(live) == 1 and ends[live[0]] - at[live[0]] < 64:
        s = auto.step[state[live] + kinds[at[live]]]
        state[live] = s
        at[live] += 1
        s = s // auto.n_classes
        hit = (auto.accepts[s] != 0) & follows(at[live])
        found[live[hit]] = at[live[hit]]
        live = live[~dead[s] & (at[live] < ends[live])]
    for i in live.tolist():  # one long match is left
        s, step, nc, ok = int(state[i]), auto.step.tolist(), auto.n_classes, (auto.accepts != 0).tolist()
        for p in range(int(at[i]), int(ends[i])):
            s = step[s + int(kinds[p])]
            if dead[s // nc]:
                break
            if ok[s // nc] and follows(np.array([p + 1]))[0]:
                found[i] = p + 1
    return found


def scan(auto: Automaton, raw: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """One pass over ``raw``: for each byte the state behind it (int32), and the positions (ends) at which a rule ended.

    The bytes are cut into lanes just behind bytes that lead every state to the start state; all lanes step together.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    by_class = auto.step.reshape(-1, auto.n_classes)
    resets = np.flatnonzero((by_class == 0).all(axis=0)[auto.classes[raw]]) + 1
    want = np.arange(1, lanes) * n // lanes
    cuts = resets[np.minimum(np.searchsorted(resets, want), len(resets) - 1)] if len(resets) else np.zeros(0, np.int64)
    cuts = np.unique(cuts[cuts >= want[0]] if len(cuts) else cuts)
    starts = np.concatenate([[0], cuts[cuts < n]]).astype(np.int64)
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    kinds = auto.classes[raw]
    out = np.empty(n, auto.step.dtype)
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than t
    state = np.zeros(len(starts), auto.step.dtype)
    for t in range(int(length[0])):
        m = live[t]
        if m == 1:
            break
        at = starts[:m] + t
        state = auto.step[state[:m] + kinds[at]]
        out[at] = state
    else:
        t = int(length[0])
    if t < length[0]:  # one long lane is left
        s, step, at = int(state[0]), auto.step.tolist(), int(starts[0]) + t
        rest = []
        for c in kinds[at : int(starts[0] + length[0])].tolist():
            s = step[s + c]
            rest.append(s)
        out[at : at + len(rest)] = rest
    hit = (auto.accepts != 0)[out // auto.n_classes] if auto.accepts.any() else np.zeros(n, bool)
    return out, np.flatnonzero(hit)
