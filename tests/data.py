"""Observatories, telescopes and nights, drawn by a seeded generator, and a small model of what the engine makes of them.

The generator keeps plain Python records; statements are written from them, and expectations are computed from the records
and never from the engine's own output.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

SKY = "https://sky.test/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"
RESOURCE = "http://www.w3.org/2000/01/rdf-schema#Resource"


@dataclass
class Sky:
    """types: subject -> types; values: (subject, predicate, datatype, language) -> texts; links: (subject, predicate, object)."""

    types: dict[str, set[str]] = field(default_factory=dict)
    values: dict[tuple[str, str, str | None, str | None], set[str]] = field(default_factory=dict)
    links: set[tuple[str, str, str]] = field(default_factory=set)
    edges: set[tuple[str, str]] = field(default_factory=set)  # superclass, subclass

    def say(self, s: str, p: str, value, datatype: str | None = None, lang: str | None = None) -> None:
        self.values.setdefault((s, p, datatype, lang), set()).add(str(value))

    def lines(self) -> list[str]:
        iri = lambda x: f"<{x}>"
        out = [f"{iri(s)} {iri(TYPE)} {iri(t)} {iri(SKY + 'log')} ." for s, ts in sorted(self.types.items()) for t in sorted(ts)]
        for (s, p, d, lang), texts in sorted(self.values.items(), key=str):
            tail = f"^^{iri(XSD + d)}" if d else f"@{lang}" if lang else ""
            out += [f'{iri(s)} {iri(p)} "{t}"{tail} {iri(SKY + "log")} .' for t in sorted(texts)]
        out += [f"{iri(s)} {iri(p)} {iri(o)} ." for s, p, o in sorted(self.links)]
        return out + [f"{iri(b)} {iri(SUBCLASS)} {iri(a)} ." for a, b in sorted(self.edges)]

    # what the engine should find

    def closed(self, t: str) -> set[str]:
        return {t}.union(*(self.closed(a) for a, b in self.edges if b == t))

    def instances(self) -> dict[str, list[str]]:
        """Types of every resource that is mentioned, supertypes added; the untyped ones are resources."""
        seen = set(self.types) | {k[0] for k in self.values} | {x for s, _, o in self.links for x in (s, o)} | {x for e in self.edges for x in e}
        return {s: sorted(set().union(*(self.closed(t) for t in self.types.get(s, ())))) or [RESOURCE] for s in seen}

    def ids(self) -> dict[str, int]:
        return {u: i + 1 for i, u in enumerate(sorted(self.instances()))}

    def members(self, t: str) -> list[str]:
        return sorted(s for s, ts in self.instances().items() if t in ts)

    def least(self, s: str, p: str, datatype: str | None, lang: str | None = None):
        found = self.values.get((s, p, datatype, lang))
        if not found:
            return None
        return min(map({"int": int, "double": float}.get(datatype, str), found))

    def roots(self, s: str) -> list[str]:
        ts = self.instances()[s]
        return ts if len(ts) == 1 else [t for t in ts if not any(b == t for _, b in self.edges)]

    def related(self) -> set[tuple[str, str, str, str, str]]:
        """(predicate, from type, from, to type, to) under root types."""
        all_links = self.links | {(b, SUBCLASS, a) for a, b in self.edges}
        return {(p, a, s, b, o) for s, p, o in all_links for a in self.roots(s) for b in self.roots(o)}


def sky(seed: int = 3, telescopes: int = 9, nights: int = 14) -> Sky:
    """Three sites, telescopes of two kinds (one of both) at them, and nights of one telescope each."""
    r, m = random.Random(seed), Sky()
    term = lambda x: f"{SKY}term/{x}"
    m.edges = {(term("Instrument"), term("Refractor")), (term("Instrument"), term("Reflector"))}
    sites = [f"{SKY}site/{x}" for x in ("dome", "plateau", "ridge")]
    for k, s in enumerate(sites):
        m.types[s] = {term("Site")}
        m.say(s, term("elevation"), 900 + 700 * k, "int")
        m.say(s, term("title"), f"Site {k}", None, "en")
        m.say(s, term("title"), f"Ort {k}", None, "de")
    scopes = [f"{SKY}scope/{k:02d}" for k in range(telescopes)]
    for k, t in enumerate(scopes):
        m.types[t] = {term("Refractor"), term("Reflector")} if k == 4 else {term("Refractor" if k % 2 else "Reflector")}
        m.say(t, term("aperture"), r.randint(4, 80) / 4, "double")
        m.links.add((t, term("standsAt"), r.choice(sites)))
    for k in range(nights):
        n = f"{SKY}night/{k:03d}"
        m.types[n] = {term("Night")}
        for _ in range(r.randint(1, 3)):
            m.say(n, term("seeing"), r.randint(5, 30), "int")
        if k % 7 == 0:
            m.say(n, term("remark"), f"clouds {k}")
        m.links.add((n, term("usedScope"), r.choice(scopes)))
        if k:
            m.links.add((n, term("follows"), f"{SKY}night/{k - 1:03d}"))
        m.links.add((n, term("ledBy"), f"{SKY}people/{r.randint(0, 2)}"))
    return m


def quads(spark, lines):
    from quadloom.sources import parse_lines
    from quadloom.sources.nquads import QUAD_COLUMNS

    return parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).filter("ok").select(*QUAD_COLUMNS)
