"""N-Quads and N-Triples as column expressions: one pass of one pattern per line, no Python on the executors.

The pattern rewrites a statement into its parts with separators between them, so the regular expression runs once per line
whatever the number of parts. Escapes are undone only in values that hold a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ErrorHandling, ParserConfig

QUAD_SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string"
QUAD_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "g"]
#: Non-characters that no text holds: between parts, for an escaped backslash and for an escaped quote.
_SEP, _BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1", "\ufdd2"
_IRI, _BLANK = r'<[^<>"\s]*>', r"_:[^\s<>\"]+"
#: Escaped quotes are marked beforehand, so a literal is a plain run: matching it needs no stack, however long it is.
_STATEMENT = rf"""^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|"[^"]*")(?:\^\^({_IRI})|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"""


def _decoded(text: Column, escape: str, digits: int, charset: str) -> Column:
    """``text`` with every \\uXXXX or \\UXXXXXXXX replaced by its character."""
    parts = F.split(text, rf"\\{escape}", -1)
    one = lambda x: F.when(F.substring(x, 1, digits).rlike(f"^(?!0*[dD][89a-fA-F])[0-9A-Fa-f]{{{digits}}}$" if digits == 4 else r"^000[0-9A-Fa-f]{5}$|^0010[0-9A-Fa-f]{4}$"), F.concat(F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.substring(x, digits + 1, 1 << 30))).otherwise(F.concat(F.lit(f"\\{escape}"), x))
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def _marked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _unmarked(text: Column) -> Column:
    """``text``, whose escaped backslashes and quotes are marked, without escapes."""
    x = _decoded(_decoded(text, "u", 4, "UTF-16BE"), "U", 8, "UTF-32")
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.replace(F.replace(x, F.lit(_QUOTE), F.lit('"')), F.lit(_BACKSLASH), F.lit("\\"))


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), _unmarked(_marked(text))).otherwise(text)


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of statement lines, plus ``line`` and ``ok`` (whether the line is a statement). Blank and comment lines go."""
    line = F.translate(F.col(column), _SEP + _BACKSLASH + _QUOTE, "")
    text = lines.select(line.alias("line")).filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    raw = F.split(F.regexp_replace(_marked(F.col("line")), _STATEMENT, _SEP + _SEP.join(f"${i}" for i in range(1, 7)) + _SEP), _SEP, -1)
    found = text.withColumn("_r", raw).withColumn("_x", F.when(F.col("line").contains("\\"), F.transform("_r", _unmarked)).otherwise(F.col("_r"))).drop("_r")
    part = lambda i: F.get(F.col("_x"), i)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    term = lambda c: F.when(c.startswith("_:"), c).when(c != "", inner(c))
    # a tag or datatype belongs to a literal
    ok = (F.size("_x") == 8) & (part(0) == "") & ((part(3).startswith('"')) | ((part(4) == "") & (part(5) == "")))
    kind = lambda c: F.when(c.startswith('"'), "literal").when(c.startswith("_:"), "blank").otherwise("uri")
    return found.select(
        F.when(ok, term(part(1))).alias("s"),
        F.when(ok, kind(part(1))).alias("s_kind"),
        F.when(ok, term(part(2))).alias("p"),
        F.when(ok, term(part(3))).alias("o"),
        F.when(ok, kind(part(3))).alias("o_kind"),
        F.when(ok & (part(4) != ""), inner(part(4))).alias("o_datatype"),
        F.when(ok & (part(5) != ""), part(5)).alias("o_lang"),
        F.when(ok, term(part(6))).alias("g"),
        "line",
        ok.alias("ok"),
    )


def statement_text(graph: bool = True) -> Column:
    """A quad as an N-Quads statement."""
    node = lambda c, k: F.when(F.col(k) == "blank", F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull() & (F.col("o_lang") != ""), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), tail)).otherwise(node("o", "o_kind"))
    g = F.when(F.col("g").startswith("_:"), F.col("g")).when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit(">")))
    return F.concat_ws(" ", node("s", "s_kind"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), obj, *([g] if graph else []), F.lit("."))


def to_lines(quads: DataFrame) -> DataFrame:
    """Statement lines of quads (column ``value``)."""
    return quads.select(statement_text().alias("value"))


def is_line_based(path: str, override: bool | None = None) -> bool:
    """N-Quads and N-Triples by suffix (gzipped or not); anything else, folders included, is read file by file."""
    if override is not None:
        return override
    return path.lower().removesuffix(".gz").endswith((".nq", ".nt"))


def accepted_language(quads: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Keep non-literals, literals without a tag and literals whose tag is listed (as written); an empty list keeps all."""
    if not languages:
        return quads
    return quads.filter((F.col("o_kind") != "literal") | (F.coalesce("o_lang", F.lit("")) == "") | F.col("o_lang").isin(*languages))


def handle_errors(parsed: DataFrame, how: ErrorHandling) -> tuple[DataFrame, DataFrame | None]:
    """(quads, bad lines or None): Ignore drops what isn't a statement, Throw ends the job at it, Store keeps it aside."""
    if how == ErrorHandling.THROW:
        checked = F.when(F.col("ok"), F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("line"))))
        return parsed.withColumn("s", checked).filter(F.col("s").isNotNull()).select(*QUAD_COLUMNS), None
    bad = parsed.filter(~F.col("ok")).select("line") if how == ErrorHandling.STORE else None
    return parsed.filter("ok").select(*QUAD_COLUMNS), bad


def read_quads(spark: SparkSession, path: str, config: ParserConfig | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(quads, bad records or None) of a file or folder, gzipped or not."""
    from .files import parse_files

    config = config or ParserConfig()
    how = ErrorHandling(config.error_handling)
    if is_line_based(path, config.line_based):
        quads, bad = handle_errors(parse_lines(spark.read.text(path)), how)
    else:
        quads, bad = handle_errors(parse_files(spark, path, config.syntax), how)
    if config.repartition:
        quads = quads.repartition(config.repartition)
    return accepted_language(quads, tuple(config.accepted_languages)), bad
