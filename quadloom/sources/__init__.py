"""Readers of quads: line-based files, whole-file Turtle, RDF/XML and JSON-LD, and relational tables."""

from .nquads import QUAD_SCHEMA, is_line_based, parse_lines, read_quads, to_lines
from .tables import triplify

__all__ = ["QUAD_SCHEMA", "is_line_based", "parse_lines", "read_quads", "to_lines", "triplify"]
