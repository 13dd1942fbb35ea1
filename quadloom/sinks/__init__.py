"""Where tables go."""

from .persistors import CsvPersistor, ElasticSearchPersistor, JdbcPersistor, JsonPersistor, MapPersistor, Persistor, PostgresPersistor, PreviewPersistor, SqlServerPersistor, persistor

__all__ = ["CsvPersistor", "ElasticSearchPersistor", "JdbcPersistor", "JsonPersistor", "MapPersistor", "Persistor", "PostgresPersistor", "PreviewPersistor", "SqlServerPersistor", "persistor"]
