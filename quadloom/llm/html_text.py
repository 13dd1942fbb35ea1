"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and text block is a variable with three states: all below is main text, all below is other matter, or
both (elements only). Node potentials come from the words of an element's class, id and role, or from a block's length,
share of links, ending and heading; parent-child potentials say how a child's state follows its parent's, given both
elements' names and whether the child is unmarked. Both are estimated by counting over labelled pages (``pagegen``: many layouts, fixed seed, ``TRAINING_PAGES`` of them). Sum-
product message passing, upward from the leaves and downward from the root, gives every block its exact marginal; blocks
whose main-text marginal is at least a half are the text. A batch of pages is passed level by level with numpy.

Null or empty html gives an empty text; a page of plain text is one block; nothing is dropped or cut but by the marginals.
Every row is a page of its own, whatever its id (null, shared or repeated); an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, blocks
from .dom import Tree, parse, tokens
from .pagegen import labelled_pages

TRAINING_PAGES = 2500
MAIN, OTHER, BOTH = 0, 1, 2
#: Powers of the potentials that repeat: blocks of a page resemble one another, and names also choose the edge's table.
LEAF_WEIGHT, NAME_WEIGHT = 0.3, 0.5
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_LABEL = re.compile(r'data-y="([01])"')
_LINES = np.array([2, 4, 8, 16, 32, 64])


def leaf_bucket(text: str, linked: float, tag: str) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = int(np.searchsorted(_LINES, words))
    share = 0 if linked == 0 else 1 if linked < 0.35 else 2 if linked < 0.8 else 3
    return (f"size{size}link{share}", f"end{text[-1] in '.?!:;…”\"'}{min(size, 2)}", f"mark{text[0] in '©®|»•'}", f"head{tag in HEADINGS}{min(size, 3)}")


@dataclass(frozen=True)
class PageModel:
    words: dict[str, np.ndarray]  # class word -> log odds by state
    leaves: dict[str, np.ndarray]  # block feature -> log P(feature | state)
    follow: dict[tuple[str, ...], np.ndarray]  # kind of edge, from the most to the least special -> parent state x child state: log-probabilities
    names: dict[tuple[str, str], np.ndarray]  # (parent's name, name) -> log P(name | parent's name, state)
    root: np.ndarray

    def node(self, above: str, tag: str, attrs: str) -> np.ndarray:
        name = self.names.get((above, tag), self.names.get(("", tag), np.zeros(3)))
        return sum((self.words[w] for w in sorted(tokens(attrs)) if w in self.words), NAME_WEIGHT * name)

    def edge(self, kinds: tuple[tuple[str, ...], ...]) -> np.ndarray:
        return next(self.follow[k] for k in kinds if k in self.follow)

    def leaf(self, features: tuple[str, ...]) -> np.ndarray:
        return LEAF_WEIGHT * sum((self.leaves[f] for f in features if f in self.leaves), np.zeros(3)) + np.array([0, 0, -np.inf])

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """P(main text) of every node of every tree, by one upward and one downward pass over all trees at once."""
        sizes = [len(t.parent) for t in trees]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        total = int(start[-1])
        parent = np.empty(total, np.int64)
        depth = np.empty(total, np.int64)
        own = np.zeros((total, 3))
        edge = np.zeros(total, np.int64)
        seen: dict[tuple, np.ndarray] = {}
        tables: dict[tuple, int] = {}
        matrices = [np.zeros((3, 3))]
        for t, a in zip(trees, start.tolist(), strict=False):
            n = len(t.parent)
            parent[a : a + n] = np.array(t.parent) + a
            depth[a : a + n] = t.depth
            alike: dict[tuple, list[int]] = {}
            for k in range(n):
                text, up_k = t.text[k], t.parent[k]
                if text is None:
                    key = (t.tag[up_k] if k else "", t.tag[k], t.attrs[k])
                    group = (up_k, key)
                else:
                    key = leaf_bucket(text, t.linked[k], t.tag[k])
                    group = (t.parent[up_k], key)
                v = seen.get(key)
                if v is None:
                    v = seen[key] = self.node(*key) if text is None else self.leaf(key)
                own[a + k] = v
                alike.setdefault(group, []).append(a + k)
                if k:
                    kind = (t.tag[t.parent[k]], t.tag[k] if text is None else "#text", not t.attrs[k])
                    e = tables.get(kind)
                    if e is None:
                        e = tables[kind] = len(matrices)
                        matrices.append(self.edge(edge_kinds(*kind)))
                    edge[a + k] = e
            for same in alike.values():
                if len(same) > 1:  # siblings that look the same are one observation and a little more
                    own[same] *= (1 + np.log(len(same))) / len(same)
        follow = np.array(matrices)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)] if total and depth.max() < 200 else _levels(depth)
        up = own.copy()
        message = np.zeros((total, 3))
        for level in reversed(levels[1:]):
            message[level] = _lse(follow[edge[level]] + up[level][:, None, :], 2)
            np.add.at(up, parent[level], message[level])
        belief = up.copy()
        if total:
            belief[levels[0]] += self.root
        for level in levels[1:]:
            above = belief[parent[level]] - message[level]
            above = above - above.max(1, keepdims=True)
            belief[level] = up[level] + _lse(follow[edge[level]] + above[:, :, None], 1)
        p = np.exp(belief - belief.max(1, keepdims=True, initial=-1e300))
        main = p[:, MAIN] / p.sum(1)
        return [main[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def edge_kinds(above: str, tag: str, bare: bool) -> tuple[tuple[str, ...], ...]:
    """The tables that fit an edge, the most special first."""
    mark = "bare" if bare else "marked"
    return ((above, tag), (tag,)) if tag == "#text" else ((above, tag, mark), (tag, mark), (mark,))


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis)
    with np.errstate(divide="ignore"):
        return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))


def train(pages: list[str], smooth: float = 0.5) -> PageModel:
    words: dict[str, np.ndarray] = {}
    leaves: dict[str, np.ndarray] = {}
    edges: dict[tuple[str, ...], np.ndarray] = {}
    names: dict[tuple[str, str], np.ndarray] = {}
    states, root = np.zeros(3), np.full(3, 1.0)

    def bump(table: dict, key, state) -> None:
        if key not in table:
            table[key] = np.zeros((3, 3) if isinstance(state, tuple) else 3)
        table[key][state] += 1

    for html in pages:
        t = parse(html)
        n = len(t.parent)
        label = [0] * n  # inherited: other matter unless an element says main text
        for k in range(1, n):
            m = _LABEL.search(t.attrs[k])
            label[k] = int(m[1]) if m else label[t.parent[k]]
        below = np.zeros((n, 2), int)
        for k in range(n - 1, -1, -1):
            if t.text[k] is not None:
                below[k, 0 if label[k] else 1] += 1
            if k:
                below[t.parent[k]] += below[k]
        state = [BOTH if a and b else MAIN if a else OTHER for a, b in below]
        root[state[0]] += 1
        for k in range(1, n):
            s = state[k]
            if not below[k].sum():
                continue
            attrs = _LABEL.sub("", t.attrs[k]).strip()
            for kind in edge_kinds(t.tag[t.parent[k]], "#text" if t.text[k] is not None else t.tag[k], not attrs):
                bump(edges, kind, (state[t.parent[k]], s))
            if t.text[k] is None:
                states[s] += 1
                for above in (t.tag[t.parent[k]], ""):
                    bump(names, (above, t.tag[k]), s)
                for w in tokens(attrs):
                    bump(words, w, s)
            else:
                for f in leaf_bucket(t.text[k], t.linked[k], t.tag[k]):
                    bump(leaves, f, s)
    # each table is smoothed towards the next general one; only what a state can be followed by stays possible
    follow: dict[tuple[str, ...], np.ndarray] = {}
    for kind in sorted(edges, key=len):
        prior = follow[kind[1:]] if len(kind) > 1 else np.full((3, 3), 1 / 3)
        follow[kind] = (edges[kind] + 2 * prior) / (edges[kind].sum(1, keepdims=True) + 2)
    # P(name | parent's name, state), smoothed towards P(name | state)
    within: dict[str, np.ndarray] = {}
    for (above, _), v in names.items():
        within[above] = within.get(above, np.zeros(3)) + v
    plain = {k[1]: (v + smooth) / (within[""] + smooth * len(names)) for k, v in names.items() if k[0] == ""}
    named = {k: np.log((v + 3 * plain[k[1]]) / (within[k[0]] + 3)) if k[0] else np.log(plain[k[1]]) for k, v in names.items()}
    odds = {}
    for w, v in words.items():
        if v.sum() >= 3:
            rate = (v + smooth) / (states + 2 * smooth)
            odds[w] = np.log(rate / ((v.sum() + smooth) / (states.sum() + 2 * smooth)))
    whole = np.zeros(3)
    for k, v in leaves.items():
        if k.startswith("mark"):
            whole += v
    logs = {k: np.log((v + smooth) / (whole + smooth * 8)) for k, v in leaves.items()}
    for v in logs.values():
        v[BOTH] = 0
    return PageModel(odds, logs, {k: np.log(v) for k, v in follow.items()}, named, np.log(root / root.sum()))


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> PageModel:
    return train(labelled_pages(pages))


def extract(pages: list[str | None], model: PageModel) -> list[str]:
    trees = [parse(h or "") for h in pages]
    out = []
    for t, p in zip(trees, model.marginals(trees), strict=True):
        out.append("\n\n".join(x for x, m in zip(t.text, p.tolist(), strict=True) if x is not None and m >= 0.5))
    return out


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: PageModel | None = None) -> DataFrame:
    """id, url, text and n_chars of every page."""
    model = model or trained()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for rows in blocks(sizes):
                n = rows.stop - rows.start
                texts = extract(batch.column(2).slice(rows.start, n).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), batch.column(1).slice(rows.start, n), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names)

    names = [id_col, url_col, "text", "n_chars"]
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return arrow_map(pages.select(id_col, url_col, html_col), run, f"{id_col} {kinds[0]}, {url_col} {kinds[1]}, text string, n_chars long")
