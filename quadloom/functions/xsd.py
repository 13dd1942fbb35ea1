"""Literal typing as column expressions: datatype and lexical form to a type name, a canonical value or an error.

A plain, language-tagged or ``xsd:string`` literal is STRING. Integers take the narrowest of INTEGER and LONG that holds
them, wider ones stay text. Dates keep their text under the tag DATETIME. Unknown datatypes and decimals are text. A
literal whose form isn't valid for its datatype is an error; forms are checked by XSD's own grammar, not by casts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Codes of the literal types.
CODES = {"UNKNOWN": 0, "STRING": 1, "FLOAT": 2, "DOUBLE": 3, "INTEGER": 4, "LONG": 5, "BOOLEAN": 6, "DATETIME": 7}
SPARK_TYPES = {"STRING": T.StringType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "INTEGER": T.IntegerType(), "LONG": T.LongType(), "BOOLEAN": T.BooleanType(), "DATETIME": T.StringType(), "UNKNOWN": T.StringType()}
INT32 = ("int", "short", "byte", "unsignedShort", "unsignedByte")
INTEGERS = (*INT32, "integer", "long", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")
DATES = ("dateTime", "date", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay", "dateTimeStamp")
#: Inclusive ranges of the bounded integer types.
RANGES = {"int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "negativeInteger": (None, -1), "nonPositiveInteger": (None, 0), "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1), "long": (-(2**63), 2**63 - 1)}
_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
_DAY, _TIME = r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
DATE_FORMS = {"dateTime": f"{_DAY}T{_TIME}{_ZONE}", "dateTimeStamp": f"{_DAY}T{_TIME}(Z|[+-][0-9]{{2}}:[0-9]{{2}})", "date": f"{_DAY}{_ZONE}", "time": f"{_TIME}{_ZONE}", "gYear": f"-?[0-9]{{4,}}{_ZONE}", "gYearMonth": f"-?[0-9]{{4,}}-[0-9]{{2}}{_ZONE}", "gMonth": f"--[0-9]{{2}}{_ZONE}", "gMonthDay": f"--[0-9]{{2}}-[0-9]{{2}}{_ZONE}", "gDay": f"---[0-9]{{2}}{_ZONE}"}


def _whole(text: Column, form: str) -> Column:
    return text.rlike(f"^(?:{form})$")


def _is(datatype: Column, *names: str) -> Column:
    return datatype.isin(*[XSD + n for n in names])


def literal_type(lexical: Column, datatype: Column) -> Column:
    """The type's name, or null for an ill-typed literal."""
    text = F.trim(lexical)  # XSD collapses white space of all but strings
    number = text.try_cast("decimal(38,0)")
    integer = _whole(text, r"[+-]?[0-9]+")
    allowed = F.lit(True)
    for name, (low, high) in RANGES.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (number < F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            bad = bad | (number > F.lit(str(high)).cast("decimal(38,0)"))
        allowed = F.when(_is(datatype, name), ~bad).otherwise(allowed)
    width = F.when(number.between(-(2**31), 2**31 - 1), "INTEGER").when(number.between(-(2**63), 2**63 - 1), "LONG").otherwise("STRING")
    real = _whole(text, r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN")
    date = F.lit(False)
    for name, form in DATE_FORMS.items():
        date = F.when(_is(datatype, name), _whole(text, form)).otherwise(date)
    return (
        F.when(datatype.isNull() | _is(datatype, "string") | datatype.endswith("rdf-syntax-ns#langString"), "STRING")
        .when(_is(datatype, *INTEGERS), F.when(integer & allowed, F.coalesce(width, F.lit("STRING"))))
        .when(_is(datatype, "float"), F.when(real, F.lit("FLOAT")))
        .when(_is(datatype, "double"), F.when(real, F.lit("DOUBLE")))
        .when(_is(datatype, "boolean"), F.when(_whole(text, "true|false|1|0"), F.lit("BOOLEAN")))
        .when(_is(datatype, *DATES), F.when(date, F.lit("DATETIME")))
        .when(_is(datatype, "decimal"), F.when(_whole(text, r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"), F.lit("STRING")))
        .otherwise("STRING")
    )


def literal_value(lexical: Column, ltype: Column) -> Column:
    """The value's canonical text: numbers and booleans as their type prints them, strings without NUL."""
    text = F.trim(lexical)
    real = F.when(text.rlike("INF$"), F.when(text.startswith("-"), "-Infinity").otherwise("Infinity")).otherwise(text)
    return (
        F.when(ltype.isin("INTEGER", "LONG"), text.try_cast("long").cast("string"))
        .when(ltype == "FLOAT", real.try_cast("float").cast("string"))
        .when(ltype == "DOUBLE", real.try_cast("double").cast("string"))
        .when(ltype == "BOOLEAN", F.when(text.isin("true", "1"), "true").otherwise("false"))
        .when(ltype == "DATETIME", text)
        .otherwise(F.translate(lexical, "\0", ""))
    )


def typed(value: Column, ltype: str) -> Column:
    """A canonical value's text as the type's Spark value."""
    return value.try_cast(SPARK_TYPES[ltype])
