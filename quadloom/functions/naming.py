"""Table and column names from URIs. Names are few, so they are made on the driver; the cleaning steps exist as columns too.

Rules that go beyond the plain ones: a generated name is never one that exists already, a name that cleans to nothing is
``undefined``, and uniqueness ignores case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from urllib.parse import unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED = "undefined"


def remove_special_chars(text: str) -> str:
    """Runs of other characters than letters, digits and _ become _; outer _ go; lower case; a leading digit gets an N."""
    name = re.sub(r"[^A-Za-z0-9_]+", "_", text).strip("_").lower()
    return f"N{name}" if name[:1].isdigit() else name


def clean_name(text: str, max_length: int) -> str:
    return remove_special_chars(text)[:max_length]


def add_language_suffix(name: str, lang: str | None) -> str:
    return f"{name}_{lang}" if lang else name


def add_type_suffix(name: str, ltype: str) -> str:
    return f"{name}_{ltype.lower()}"


def add_retry_suffix(name: str, max_length: int, i: int) -> str:
    """``_i`` from the second try on; the stem is cut so that the whole fits."""
    if i <= 1:
        return name
    tail = f"_{i}"
    return name[: max(0, max_length - len(tail))] + tail


def clean_uri_suffix(uri: str, pattern: str, max_length: int) -> str:
    """The part behind the last separator, decoded and cleaned."""
    text = unquote_plus(uri) if re.fullmatch(r"(?:[^%]|%[0-9A-Fa-f]{2})*", uri) else uri
    text = re.sub(rf"(?:{pattern}|[^A-Za-z0-9_])+$", "", text)
    if not text:
        return UNDEFINED
    return clean_name(re.split(pattern, text)[-1], max_length) or UNDEFINED


def unique_names(groups: Iterable[tuple[str, str]], max_length: int, reserved: Iterable[str] = ()) -> dict[str, str]:
    """URI -> unique name, of (uri, name) pairs: equal names are numbered in URI order, a reserved one starts at _2."""
    by_name: dict[str, list[str]] = {}
    for uri, name in sorted(groups):
        by_name.setdefault(name, []).append(uri)
    kept = {r.lower() for r in reserved}
    taken = kept | {n.lower() for n in by_name}
    out: dict[str, str] = {}
    used: set[str] = set()
    for name in sorted(by_name):
        i = 2 if name.lower() in kept else 1
        for uri in by_name[name]:
            candidate = add_retry_suffix(name, max_length, i)
            while candidate.lower() in used or (i > 1 and candidate.lower() in taken):
                i += 1
                candidate = add_retry_suffix(name, max_length, i)
            used.add(candidate.lower())
            out[uri] = candidate
            i += 1
    return out


def format_names(
    uris: Iterable[str], max_length: int, *, pattern: str = "[/:#=]", labels: dict[str, str] | None = None, reserved: Iterable[str] = (), custom: Callable[[str, str | None, int], str | None] | None = None
) -> dict[str, str]:
    """URI -> unique name. First the flavor's own name, then the label's (if ``labels`` are given), then the URI's suffix."""
    pairs = []
    for uri in set(uris):
        label = (labels or {}).get(uri)
        name = custom(uri, label, max_length) if custom else None
        if not name and label:
            name = clean_name(label, max_length)
        pairs.append((uri, name or clean_uri_suffix(uri, pattern, max_length)))
    return unique_names(pairs, max_length, reserved)


def relation_name(*parts: str) -> str:
    """from_to or from_predicate_to; no length limit."""
    return "_".join(parts)


# --- the same cleaning as columns


def clean_name_column(text: Column, max_length: int) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", ""))
    return F.substring(F.when(name.rlike("^[0-9]"), F.concat(F.lit("N"), name)).otherwise(name), 1, max_length)


def clean_uri_suffix_column(uri: Column, pattern: str, max_length: int) -> Column:
    text = F.regexp_replace(F.coalesce(F.try_url_decode(uri), uri), rf"(?:{pattern}|[^A-Za-z0-9_])+$", "")
    name = clean_name_column(F.element_at(F.split(text, pattern), -1), max_length)
    return F.when(name == "", UNDEFINED).otherwise(name)


def unique_name_column(uri: Column, name: Column, max_length: int) -> Column:
    """The numbering of equal names in URI order, for frames of names."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy(name).orderBy(uri))
    tail = F.concat(F.lit("_"), i.cast("string"))
    return F.when(i == 1, name).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(max_length) - F.length(tail)), tail))
