"""Settings of the two jobs. Every group validates itself; the command line (``quadloom.cli``) has the same names."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
RDFS_RESOURCE = "http://www.w3.org/2000/01/rdf-schema#Resource"
ERROR_TYPE = "#quadloom:error"
ERROR_URI = "#quadloom:error:"
ERROR_SUBJECT, ERROR_QUAD, ERROR_MESSAGE = "#quadloom:error#subject", "#quadloom:error#quad", "#quadloom:error#message"
ERROR_PREDICATES = (ERROR_SUBJECT, ERROR_QUAD, ERROR_MESSAGE)


class ErrorHandling(str, Enum):
    IGNORE, THROW, STORE = "Ignore", "Throw", "Store"


class RelationStrategy(str, Enum):
    SINGLE_TABLE, TYPES, PREDICATES, TYPE_PREDICATES, NONE = "SingleTable", "Types", "Predicates", "TypePredicates", "None"


class SaveMode(str, Enum):
    APPEND, OVERWRITE, ERROR, IGNORE = "Append", "Overwrite", "ErrorIfExists", "Ignore"


@dataclass
class ParserConfig:
    line_based: bool | None = None  # None: by the path's suffix
    syntax: str | None = None  # of files that aren't line-based: turtle, rdfxml or jsonld; None: by each file's suffix
    repartition: int | None = None
    error_handling: ErrorHandling = ErrorHandling.IGNORE
    accepted_languages: tuple[str, ...] = ()
    #: Lines per split in tools that count lines; Spark splits by bytes, so this sets nothing but is accepted.
    batch_size: int = 500_000


@dataclass
class QuadFilterConfig:
    resources: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    related_depth: int = 0
    directed: bool = True

    def validate(self) -> None:
        if self.related_depth < 0:
            raise ValueError("related_depth can't be negative")
        if self.related_depth > 0 and not self.resources:
            raise ValueError("related_depth needs resources to start from")


@dataclass
class InstanceFilterConfig:
    types: tuple[str, ...] = ()
    ignore_other_types: bool = True


@dataclass
class RdfConfig:
    type_predicates: tuple[str, ...] = ()
    subclass_predicates: tuple[str, ...] = ()
    collect_subclass_graph: bool = True
    collect_labels: bool = True
    cache_file: str | None = None

    @property
    def all_type_predicates(self) -> tuple[str, ...]:
        return (RDF_TYPE, *self.type_predicates)

    @property
    def all_subclass_predicates(self) -> tuple[str, ...]:
        return (RDFS_SUBCLASS, *self.subclass_predicates)


@dataclass
class InstanceConfig:
    default_language: str | None = None
    add_super_types: bool = True
    repartition_by_type: bool = False


@dataclass
class EntityConfig:
    max_columns: int | None = None
    min_non_null_fraction: float = 0.0
    redundant_eav: bool = False
    redundant_subclass_columns: bool = False
    min_rows: int = 1
    sort_columns: bool = False
    force_type_suffix: bool = False


@dataclass
class RelationConfig:
    strategy: RelationStrategy = RelationStrategy.TYPES
    root_types_only: bool = True
    store_predicate: bool = True


@dataclass
class NamingConfig:
    max_table_length: int = 25
    max_column_length: int = 50
    uri_suffix_pattern: str = "[/:#=]"
    use_labels: bool = False
    entity_prefix: str = ""
    relation_prefix: str = ""


@dataclass
class OutputConfig:
    target: str = "Map"  # Map, CSV, JSON, Preview, DB, ES
    save_mode: SaveMode = SaveMode.ERROR
    folder: str | None = None
    db_url: str | None = None
    db_user: str | None = None
    db_password: str | None = None
    db_schema: str | None = None
    db_batch_size: int = 5000
    db_bulk_load: bool = True
    db_strict: bool = False  # a key or index that can't be made is an error
    es_index: str | None = None
    es_create_index: bool = True

    def validate(self) -> None:
        need = {"CSV": ("folder",), "JSON": ("folder",), "DB": ("db_url", "db_user"), "ES": ("es_index",), "Map": (), "Preview": ()}
        if self.target not in need:
            raise ValueError(f"unknown output target {self.target!r}")
        missing = [x for x in need[self.target] if not getattr(self, x)]
        if missing:
            raise ValueError(f"output {self.target} needs {', '.join(missing)}")


@dataclass
class ConvertConfig:
    input_file: str | None = None
    flavor: str | None = None
    filter_cache_level: str = "NONE"
    cache_level: str = "DISK_ONLY"
    instance_partitions: int | None = None
    parser: ParserConfig = field(default_factory=ParserConfig)
    quads: QuadFilterConfig = field(default_factory=QuadFilterConfig)
    instances_filter: InstanceFilterConfig = field(default_factory=InstanceFilterConfig)
    rdf: RdfConfig = field(default_factory=RdfConfig)
    instances: InstanceConfig = field(default_factory=InstanceConfig)
    entities: EntityConfig = field(default_factory=EntityConfig)
    relations: RelationConfig = field(default_factory=RelationConfig)
    naming: NamingConfig = field(default_factory=NamingConfig)
    output: OutputConfig = field(default_factory=OutputConfig)

    def validate(self) -> None:
        self.quads.validate()
        self.output.validate()


@dataclass
class StatsConfig:
    input_file: str | None = None
    stats: tuple[str, ...] = ("SUBJECT_URI_COUNT", "PREDICATE_URI_COUNT", "OBJECT_URI_COUNT")
    parser: ParserConfig = field(default_factory=ParserConfig)
