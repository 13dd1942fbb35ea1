"""Source-specific hooks: defaults, a rewrite of the quads and names of their own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RDFS_LABEL, ConvertConfig, RelationStrategy, StatsConfig
from ..functions.naming import clean_uri_suffix
from ..sources.nquads import QUAD_COLUMNS


class Flavor(Protocol):
    def set_defaults(self, config: ConvertConfig | StatsConfig) -> None: ...

    def modify_quads(self, quads: DataFrame) -> DataFrame: ...

    def format_name(self, uri: str, label: str | None, max_length: int) -> str | None: ...


class DefaultFlavor:
    def set_defaults(self, config) -> None:
        pass

    def modify_quads(self, quads: DataFrame) -> DataFrame:
        return quads

    def format_name(self, uri: str, label: str | None, max_length: int) -> str | None:
        return None


#: Wikidata's namespaces and properties.
WIKIDATA = "http://www.wikidata.org/"
WIKIDATA_PROPERTY = WIKIDATA + "entity/P"
WIKIDATA_COPIES = (WIKIDATA + "prop/direct/P", WIKIDATA + "prop/statement/P", WIKIDATA + "prop/qualifier/P")
WIKIDATA_INSTANCE_OF, WIKIDATA_SUBCLASS_OF = WIKIDATA + "prop/direct/P31", WIKIDATA + "prop/direct/P279"


class WikidataFlavor(DefaultFlavor):
    def set_defaults(self, config) -> None:
        if isinstance(config, ConvertConfig):
            config.rdf.subclass_predicates = (WIKIDATA_SUBCLASS_OF,)
            config.rdf.type_predicates = (WIKIDATA_INSTANCE_OF, WIKIDATA_SUBCLASS_OF)
            config.naming.use_labels = True
            config.naming.max_table_length = 50
            config.relations.strategy = RelationStrategy.PREDICATES

    def modify_quads(self, quads: DataFrame) -> DataFrame:
        """A property's label also labels its direct, statement and qualifier forms: one generator, no second scan."""
        property_label = (F.col("p") == RDFS_LABEL) & (F.col("s_kind") == "uri") & F.col("s").startswith(WIKIDATA_PROPERTY)
        copies = F.array(F.col("s"), *[F.concat(F.lit(c), F.substring("s", len(WIKIDATA_PROPERTY) + 1, 1 << 30)) for c in WIKIDATA_COPIES])
        rest = [c for c in QUAD_COLUMNS if c != "s"]
        return quads.select(F.explode(F.when(property_label, copies).otherwise(F.array("s"))).alias("s"), *rest)


class Bio2RdfFlavor(DefaultFlavor):
    def format_name(self, uri: str, label: str | None, max_length: int) -> str | None:
        """``X_vocabulary:Resource`` is called ``X_resource``."""
        tail = "_vocabulary:Resource"
        return clean_uri_suffix(uri.removesuffix(tail) + "_resource", "/", max_length) if uri.endswith(tail) else None


FLAVORS = {"Wikidata": WikidataFlavor, "Bio2RDF": Bio2RdfFlavor, "Default": DefaultFlavor}


def flavor(name: str | None) -> Flavor:
    if name is None:
        return DefaultFlavor()
    if name not in FLAVORS:
        raise ValueError(f"unknown flavor {name!r}; there are {', '.join(sorted(FLAVORS))}")
    return FLAVORS[name]()
