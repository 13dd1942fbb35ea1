"""Command line: ``python -m quadloom.cli convert|stats --input.file ...``.

Every option of the configuration has a name here. Parsing is done twice: the flavor is found first and sets its
defaults, then the given options are applied over them.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from dataclasses import fields
from enum import Enum

from .config import ConvertConfig, ErrorHandling, RelationStrategy, SaveMode, StatsConfig
from .operators.flavors import flavor
from .operators.stats import STATS


def _bool(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"true or false, not {text!r}")
    return text.lower() == "true"


#: option -> (path in the configuration, type); list types may be given repeatedly.
PARSER_OPTIONS = {
    "input.file": ("input_file", str),
    "input.lineBasedFormat": ("parser.line_based", _bool),
    "input.repartition": ("parser.repartition", int),
    "input.batchSize": ("parser.batch_size", int),
    "input.errorHandling": ("parser.error_handling", ErrorHandling),
    "input.acceptedLanguage": ("parser.accepted_languages", [str]),
}
CONVERT_OPTIONS = PARSER_OPTIONS | {
    "flavor": ("flavor", str),
    "filter.cacheLevel": ("filter_cache_level", str),
    "cacheLevel": ("cache_level", str),
    "instancePartitions": ("instance_partitions", int),
    "filter.resource": ("quads.resources", [str]),
    "filter.resourceBlacklist": ("quads.blacklist", [str]),
    "filter.relatedDepth": ("quads.related_depth", int),
    "filter.directed": ("quads.directed", _bool),
    "filter.type": ("instances_filter.types", [str]),
    "filter.ignoreOtherTypes": ("instances_filter.ignore_other_types", _bool),
    "rdf.typePredicate": ("rdf.type_predicates", [str]),
    "rdf.subclassPredicate": ("rdf.subclass_predicates", [str]),
    "rdf.collectSubclassGraph": ("rdf.collect_subclass_graph", _bool),
    "rdf.collectLabels": ("rdf.collect_labels", _bool),
    "rdf.cacheFile": ("rdf.cache_file", str),
    "instances.defaultLanguage": ("instances.default_language", str),
    "instances.addSuperTypes": ("instances.add_super_types", _bool),
    "instances.repartitionByType": ("instances.repartition_by_type", _bool),
    "formatting.entityTablePrefix": ("naming.entity_prefix", str),
    "formatting.relationTablePrefix": ("naming.relation_prefix", str),
    "formatting.maxTableNameLength": ("naming.max_table_length", int),
    "formatting.maxColumnNameLength": ("naming.max_column_length", int),
    "formatting.uriSuffixPattern": ("naming.uri_suffix_pattern", str),
    "formatting.useLabels": ("naming.use_labels", _bool),
    "entities.maxNumColumns": ("entities.max_columns", int),
    "entities.minColumnNonNullFraction": ("entities.min_non_null_fraction", float),
    "entities.redundantEAV": ("entities.redundant_eav", _bool),
    "entities.redundantSubclassColumns": ("entities.redundant_subclass_columns", _bool),
    "entities.minNumRows": ("entities.min_rows", int),
    "entities.sortColumnsAlphabetically": ("entities.sort_columns", _bool),
    "entities.forceTypeSuffix": ("entities.force_type_suffix", _bool),
    "relations.schema": ("relations.strategy", RelationStrategy),
    "relations.rootTypesOnly": ("relations.root_types_only", _bool),
    "relations.storePredicate": ("relations.store_predicate", _bool),
    "output.target": ("output.target", str),
    "output.saveMode": ("output.save_mode", SaveMode),
    "output.folder": ("output.folder", str),
    "db.url": ("output.db_url", str),
    "db.user": ("output.db_user", str),
    "db.password": ("output.db_password", str),
    "db.schema": ("output.db_schema", str),
    "db.batchSize": ("output.db_batch_size", int),
    "db.bulkLoad": ("output.db_bulk_load", _bool),
    "es.index": ("output.es_index", str),
    "es.createIndex": ("output.es_create_index", _bool),
}
STATS_OPTIONS = PARSER_OPTIONS | {"stat": ("stats", [str])}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadloom", description="RDF quads to relational tables")
    commands = top.add_subparsers(dest="command")
    for name, options in (("convert", CONVERT_OPTIONS), ("stats", STATS_OPTIONS)):
        sub = commands.add_parser(name)
        for option, (path, kind) in options.items():
            many = isinstance(kind, list)
            base = kind[0] if many else kind
            extra = {"choices": [e.value for e in base]} if isinstance(base, type) and issubclass(base, Enum) else {"type": base}
            if option == "stat":
                extra["choices"] = list(STATS)
            sub.add_argument(f"--{option}", dest=path, action="append" if many else "store", default=None, required=option == "input.file", **extra)
    return top


def _apply(config, given: dict, options: dict) -> None:
    enums = {path: (kind[0] if isinstance(kind, list) else kind) for path, kind in options.values()}
    for path, value in given.items():
        if value is None:
            continue
        *groups, name = path.split(".")
        target = config
        for g in groups:
            target = getattr(target, g)
        kind = enums[path]
        if isinstance(kind, type) and issubclass(kind, Enum):
            value = kind(value)
        setattr(target, name, tuple(value) if isinstance(value, list) else value)


def parse(argv: list[str]) -> ConvertConfig | StatsConfig | None:
    """The job's configuration, or None if there is nothing to do (help, or no command)."""
    if not argv or "--help" in argv or "-h" in argv:
        _parser().print_help()
        return None
    try:
        given = vars(_parser().parse_args(argv))
    except SystemExit:
        return None
    command = given.pop("command")
    if command is None:
        return None
    config: ConvertConfig | StatsConfig = ConvertConfig() if command == "convert" else StatsConfig()
    if isinstance(config, ConvertConfig):
        flavor(given.get("flavor")).set_defaults(config)
    _apply(config, given, CONVERT_OPTIONS if command == "convert" else STATS_OPTIONS)
    if isinstance(config, ConvertConfig):
        config.validate()
    assert {f.name for f in fields(config)} >= {"input_file", "parser"}
    return config


def main(argv: list[str] | None = None) -> int:
    config = parse(sys.argv[1:] if argv is None else argv)
    if config is None:
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    if isinstance(config, StatsConfig):
        from .plans.stats import run_stats, summary

        print(summary(run_stats(spark, config.input_file, config)))
    else:
        from .plans.convert import convert

        done = convert(spark, config.input_file, config)
        if done.bad_records is not None:
            path = store_bad_records(spark, done.bad_records, config.output.folder)
            print(f"bad records: {path}")
    return 0


def store_bad_records(spark, bad, folder: str | None) -> str:
    """Write what was no statement, a line each, beside the output or to the shared folder; where it went."""
    from .session import shared_dir

    path = f"{(folder or shared_dir(spark)).rstrip('/')}/_bad_records-{uuid.uuid4().hex}"
    bad.write.option("compression", "gzip").json(path)
    return path


if __name__ == "__main__":
    sys.exit(main())
