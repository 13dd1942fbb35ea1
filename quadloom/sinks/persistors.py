"""Sinks: a map of frames, CSV, JSON, a preview, JDBC databases and a search index.

Keys and indexes are declared through the same interface; databases execute them, other sinks keep them as a manifest.
"""

from __future__ import annotations

import io
import json
import logging
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import OutputConfig, SaveMode

log = logging.getLogger(__name__)
_MODES = {SaveMode.APPEND: "append", SaveMode.OVERWRITE: "overwrite", SaveMode.ERROR: "errorifexists", SaveMode.IGNORE: "ignore"}

#: PostgreSQL's reserved key words.
POSTGRES_RESERVED = frozenset(
    """all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column
    concurrently constraint create cross current_catalog current_date current_role current_schema current_time
    current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign freeze from
    full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime
    localtimestamp natural not notnull null offset on only or order outer overlaps placing primary references returning right
    select session_user similar some symmetric table tablesample then to trailing true union unique user using variadic
    verbose when where window with""".split()
)


@dataclass
class Manifest:
    """The constraints of an output."""

    indexes: list[tuple[str, str]] = field(default_factory=list)
    primary_keys: list[tuple[str, str]] = field(default_factory=list)
    foreign_keys: list[tuple[str, str, str, str]] = field(default_factory=list)

    def ddl(self, quote=lambda name: f'"{name}"', qualify=lambda name: f'"{name}"') -> list[str]:
        return [
            *(f"ALTER TABLE {qualify(t)} ADD PRIMARY KEY ({quote(c)})" for t, c in self.primary_keys),
            *(f"CREATE INDEX {quote(index_name(t, c))} ON {qualify(t)} ({quote(c)})" for t, c in self.indexes),
            *(f"ALTER TABLE {qualify(t)} ADD FOREIGN KEY ({quote(c)}) REFERENCES {qualify(t2)} ({quote(c2)})" for t, c, t2, c2 in self.foreign_keys),
        ]


def index_name(table: str, column: str) -> str:
    """The same short name for the same column everywhere."""
    return f"ix_{zlib.crc32(f'{table}.{column}'.encode()):08x}"


class Persistor:
    def __init__(self, mode: SaveMode = SaveMode.ERROR) -> None:
        self.mode = _MODES[SaveMode(mode)]
        self.manifest = Manifest()

    def write_frame(self, name: str, frame: DataFrame) -> None:
        raise NotImplementedError

    def create_indexes(self, indexes: Iterable[tuple[str, str]]) -> None:
        self.manifest.indexes += list(indexes)

    def create_primary_keys(self, keys: Iterable[tuple[str, str]]) -> None:
        self.manifest.primary_keys += list(keys)

    def create_foreign_keys(self, keys: Iterable[tuple[str, str, str, str]]) -> None:
        self.manifest.foreign_keys += list(keys)

    def reserved_names(self) -> frozenset[str]:
        return frozenset()


class MapPersistor(Persistor):
    """Keeps the lazy frames by name."""

    def __init__(self, mode: SaveMode = SaveMode.OVERWRITE) -> None:
        super().__init__(mode)
        self.result: dict[str, DataFrame] = {}

    def write_frame(self, name: str, frame: DataFrame) -> None:
        self.result[name] = frame


class CsvPersistor(Persistor):
    """folder/name as CSV with a header. Quotes are doubled; null is an empty field, the empty string a quoted one; white space stays."""

    def __init__(self, folder: str, mode: SaveMode = SaveMode.ERROR) -> None:
        super().__init__(mode)
        self.folder = folder.rstrip("/")

    def write_frame(self, name: str, frame: DataFrame) -> None:
        frame.write.mode(self.mode).csv(f"{self.folder}/{name}", header=True, escape='"', quoteAll=False, nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    def read_frame(self, spark, name: str, schema) -> DataFrame:
        """Read a written table back, value for value. A table of one column is without its nulls: they are blank lines, which Spark skips.

        No text stands for null (``nullValue``), so only a bare empty field is null. The escape of the escape is the quote
        again, as Spark's default beside a doubled quote is NUL, which is then lost from quoted texts. The line end is given,
        as Spark would take a carriage return in the header for it.
        """
        return spark.read.schema(schema).option("nullValue", None).csv(f"{self.folder}/{name}", header=True, escape='"', charToEscapeQuoteEscaping='"', lineSep="\n", multiLine=True)


class JsonPersistor(Persistor):
    def __init__(self, folder: str, mode: SaveMode = SaveMode.ERROR) -> None:
        super().__init__(mode)
        self.folder = folder.rstrip("/")

    def write_frame(self, name: str, frame: DataFrame) -> None:
        frame.write.mode(self.mode).json(f"{self.folder}/{name}")


class PreviewPersistor(Persistor):
    """Shows the first rows."""

    ROWS = 10

    def write_frame(self, name: str, frame: DataFrame) -> None:
        print(name)
        frame.show(self.ROWS, truncate=True)


class ElasticSearchPersistor(Persistor):
    """index/table, always appended to; needs the connector on Spark's class path."""

    FORMAT = "org.elasticsearch.spark.sql"

    def __init__(self, index: str, create_index: bool = True) -> None:
        super().__init__(SaveMode.APPEND)
        self.index, self.create_index = index, create_index

    def options(self, name: str) -> dict[str, str]:
        return {"es.resource": f"{self.index}/{name}", "es.index.auto.create": str(self.create_index).lower()}

    def write_frame(self, name: str, frame: DataFrame) -> None:
        frame.write.format(self.FORMAT).mode(self.mode).options(**self.options(name)).save()


#: Columns that keys and indexes use; some databases can't index text of any length.
KEY_COLUMNS = frozenset(("URI", "datatype", "language", "name", "entity_name", "from_name", "to_name"))


class JdbcPersistor(Persistor):
    """Any database with a JDBC driver on the class path.

    Keys and indexes are run one statement at a time; those that fail are logged and kept in ``failures``, and ``db_strict``
    makes them an error once all have been tried.
    """

    #: Type of text columns that keys use, where the database's own text type can't be indexed.
    KEY_TYPE: str | None = None
    #: Nulls must be sent with the column's own type, so a nullable text column keeps the database's text type and no key.
    NULLS_NEED_OWN_TYPE = False

    def __init__(self, config: OutputConfig, driver: str | None = None) -> None:
        super().__init__(config.save_mode)
        self.config, self.driver = config, driver or driver_class(config.db_url)
        self.failures: list[tuple[str, str]] = []
        self.unkeyed: set[tuple[str, str]] = set()  # (table, column) of the text that this database can't index

    def properties(self) -> dict[str, str]:
        c = self.config
        found = {"user": c.db_user, "password": c.db_password, "driver": self.driver, "batchsize": str(c.db_batch_size), "tcpKeepAlive": "true", "searchpath": c.db_schema}
        return {k: v for k, v in found.items() if v is not None}

    def qualified(self, name: str) -> str:
        return f'"{self.config.db_schema}"."{name}"' if self.config.db_schema else f'"{name}"'

    def write_frame(self, name: str, frame: DataFrame) -> None:
        text = [f for f in frame.schema if f.name in KEY_COLUMNS and isinstance(f.dataType, T.StringType)] if self.KEY_TYPE else []
        keys = [f.name for f in text if not (f.nullable and self.NULLS_NEED_OWN_TYPE)]
        self.unkeyed |= {(name, f.name) for f in text if f.name not in keys}
        own = {"createTableColumnTypes": ", ".join(f"`{k}` {self.KEY_TYPE}" for k in keys)} if keys else {}
        frame.write.mode(self.mode).jdbc(self.config.db_url, self.qualified(name), properties=self.properties() | own)

    def create_indexes(self, indexes) -> None:
        indexes = list(indexes)
        super().create_indexes(indexes)
        self.execute(Manifest(indexes=[x for x in indexes if x not in self.unkeyed]).ddl(qualify=self.qualified))

    def create_primary_keys(self, keys) -> None:
        keys = list(keys)
        super().create_primary_keys(keys)
        self.execute(Manifest(primary_keys=keys).ddl(qualify=self.qualified))

    def create_foreign_keys(self, keys) -> None:
        keys = list(keys)
        super().create_foreign_keys(keys)
        self.execute(Manifest(foreign_keys=[x for x in keys if x[:2] not in self.unkeyed]).ddl(qualify=self.qualified))

    def execute(self, statements: list[str]) -> list[tuple[str, str]]:
        """Run statements in one connection through the driver's JVM; (statement, message) of those that failed."""
        from py4j.protocol import Py4JJavaError
        from pyspark.sql import SparkSession

        if not statements:
            return []
        jvm = SparkSession.active()._jvm
        jvm.java.lang.Class.forName(self.driver)
        p = jvm.java.util.Properties()
        for k, v in self.properties().items():
            p.setProperty(k, v)
        failed = []
        connection = jvm.java.sql.DriverManager.getConnection(self.config.db_url, p)
        try:
            for s in statements:
                statement = connection.createStatement()
                try:
                    statement.execute(s)
                except Py4JJavaError as e:
                    failed.append((s, str(e.java_exception.getMessage())))
                    log.warning("failed: %s: %s", *failed[-1])
                finally:
                    statement.close()
        finally:
            connection.close()
        self.failures += failed
        if failed and self.config.db_strict:
            raise RuntimeError(f"{len(failed)} of {len(statements)} statements failed, the first: {failed[0]}")
        return failed


class DerbyPersistor(JdbcPersistor):
    KEY_TYPE = "VARCHAR(2000)"
    NULLS_NEED_OWN_TYPE = True


class PostgresPersistor(JdbcPersistor):
    """Bulk load through COPY where a Python driver is installed on the executors, JDBC else."""

    def reserved_names(self) -> frozenset[str]:
        return POSTGRES_RESERVED

    def write_frame(self, name: str, frame: DataFrame) -> None:
        if not self.config.db_bulk_load:
            super().write_frame(name, frame)
            return
        try:
            import psycopg2  # noqa: F401
        except ImportError:
            log.warning("no COPY driver; %s goes through JDBC", name)
            super().write_frame(name, frame)
            return
        super().write_frame(name, frame.limit(0))
        config, target = self.config, self.qualified(name)

        def load(rows: Iterator[Row]) -> None:
            import psycopg2

            dsn = config.db_url.removeprefix("jdbc:")
            with psycopg2.connect(dsn, user=config.db_user, password=config.db_password) as connection, connection.cursor() as cursor:
                for chunk in copy_chunks(rows, config.db_batch_size):
                    cursor.copy_expert(f"COPY {target} FROM STDIN WITH (FORMAT csv, DELIMITER '|', NULL 'NULL')", io.StringIO(chunk))

        frame.foreachPartition(load)


class SqlServerPersistor(JdbcPersistor):
    """Booleans become integers, in place."""

    KEY_TYPE = "VARCHAR(800)"

    def write_frame(self, name: str, frame: DataFrame) -> None:
        super().write_frame(name, booleans_to_int(frame))


def booleans_to_int(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{f.name}`").cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`") for f in frame.schema])


def copy_value(value) -> str:
    """A value for COPY's CSV form: NULL bare, everything else quoted with quotes doubled."""
    if value is None:
        return "NULL"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return '"' + text.replace('"', '""') + '"'


def copy_line(row: Iterable) -> str:
    return "|".join(map(copy_value, row)) + "\n"


def copy_chunks(rows: Iterable, size: int) -> Iterator[str]:
    """COPY input of ``size`` rows each."""
    lines: list[str] = []
    for r in rows:
        lines.append(copy_line(r))
        if len(lines) >= size:
            yield "".join(lines)
            lines = []
    if lines:
        yield "".join(lines)


def copy_column(frame: DataFrame):
    """The same line as a column, for checks without a database."""
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "NULL").otherwise(F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat_ws("|", *[cell(c) for c in frame.columns])


def driver_class(url: str | None) -> str:
    for prefix, name in {"jdbc:postgresql:": "org.postgresql.Driver", "jdbc:sqlserver:": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:derby:": "org.apache.derby.jdbc.EmbeddedDriver"}.items():
        if (url or "").startswith(prefix):
            return name
    raise ValueError(f"no JDBC driver known for {url!r}")


def persistor(config: OutputConfig) -> Persistor:
    """The sink that a configuration asks for."""
    config.validate()
    if config.target == "DB":
        kind = {"org.postgresql.Driver": PostgresPersistor, "com.microsoft.sqlserver.jdbc.SQLServerDriver": SqlServerPersistor, "org.apache.derby.jdbc.EmbeddedDriver": DerbyPersistor}.get(driver_class(config.db_url), JdbcPersistor)
        return kind(config)
    if config.target == "ES":
        return ElasticSearchPersistor(config.es_index, config.es_create_index)
    if config.target in ("CSV", "JSON"):
        return (CsvPersistor if config.target == "CSV" else JsonPersistor)(config.folder, config.save_mode)
    return PreviewPersistor() if config.target == "Preview" else MapPersistor()


def manifest_json(manifest: Manifest) -> str:
    return json.dumps({"indexes": manifest.indexes, "primary_keys": manifest.primary_keys, "foreign_keys": manifest.foreign_keys}, indent=1)
