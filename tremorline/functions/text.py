"""Text columns: token sets, similarity, wire families, domains, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tremorline.functions import constants as C


def strings(values: Sequence[str]) -> Column:
    """A constant array of strings.  Written as the split of one literal, so plans stay small; Spark folds it."""
    return F.split(F.lit("\x1f".join(values)), "\x1f") if values else F.array().cast("array<string>")


def any_of(values: Sequence[str]) -> str:
    """A regex that finds any of the literal strings."""
    return "|".join(re.escape(v) for v in values) if values else "(?!)"


def empty_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def token_set(text: Column, stop_words: Sequence[str] = C.STOP_WORDS) -> Column:
    """Distinct ``[a-z]`` runs of three letters or more in lower case, without stop words, sorted.

    Sorting makes equal sets equal arrays, so a token set can be a grouping key.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(words, strings(stop_words)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap over union of two token sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def outlet_family(name: Column, families: dict[str, list[str]] = C.WIRE_FAMILIES) -> Column:
    """Wire family of an outlet: the first family with a substring in the lower-case name, else null."""
    lowered = F.lower(name)
    family = F.lit(None).cast("string")
    for key, parts in reversed(families.items()):
        hit = lowered.contains(parts[0])
        for part in parts[1:]:
            hit = hit | lowered.contains(part)
        family = F.when(hit, F.lit(key)).otherwise(family)
    return family


def url_domain(url: Column) -> Column:
    """Lower-case authority of an URL without one leading ``www.``; user info and port stay."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.when(F.length(url) > 0, F.regexp_replace(F.lower(authority), r"^www\.", ""))


def clip(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters (None: all), trimmed, or null when nothing is left."""
    return empty_to_null(F.trim(text if chars is None else F.substring(text, 1, chars)))


def coded_title(root_code: Column, city: Column, full_name: Column) -> Column:
    """Display title of a coded event: label of the root code, dash, place."""
    label = F.lit("Unrest")
    for code, (_, text) in C.ROOT_CODES.items():
        label = F.when(root_code == code, F.lit(text)).otherwise(label)
    nameless = F.when(F.length(full_name) > 0, F.lit("")).otherwise(F.lit("unknown location"))
    return F.concat(label, F.lit(" — "), F.coalesce(city, nameless))


def slug(*parts: Column) -> Column:
    """Lower case, blanks to hyphens, joined by hyphens."""
    return F.concat_ws("-", *[F.replace(F.lower(p), F.lit(" "), F.lit("-")) for p in parts])


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))
