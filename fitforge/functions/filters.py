"""Filters and projections of listings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_remote(flag: Column, wanted: bool | None) -> Column:
    """No filter for None, else only rows whose flag is this; an unknown flag matches neither."""
    return F.lit(True) if wanted is None else flag.eqNullSafe(F.lit(wanted))


def contains_text(value: Column, wanted: str | None) -> Column:
    """Whether a value has this text in it, in any case; its % and _ stand for themselves.  No text, no filter."""
    return F.contains(F.lower(value), F.lower(F.lit(wanted))) if wanted else F.lit(True)


def equals(value: Column, wanted: str | None) -> Column:
    """No filter without a wanted value; a null value never matches one."""
    return F.coalesce(value == F.lit(wanted), F.lit(False)) if wanted else F.lit(True)


def embedding_text(title: Column, body: Column, most: int = 8000) -> Column:
    """Title, an empty line and body, of which the first ``most`` characters."""
    return F.substring(F.concat(title, F.lit("\n\n"), body), 1, most)


def with_roles(roles: Column, text: Column) -> Column:
    """The text behind its target roles, if there are any."""
    return F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, F.concat(F.lit("Target roles: "), F.array_join(roles, ", "), F.lit("\n\n"), text)).otherwise(text)


def file_name(path: Column, most: int = 200, default: str = "resume.pdf") -> Column:
    """The last part of a path with either slash: printable characters, no blanks around, ``most`` at most."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    bare = F.substring(F.trim(F.regexp_replace(last, r"[\p{C}]", "")), 1, most)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def only_generic(term: Column, generic: list[str]) -> Column:
    """Whether all words of a term are generic ones; hyphens part words."""
    return F.size(F.array_except(F.split(F.replace(term, F.lit("-"), F.lit(" ")), r"\s+"), F.array(*map(F.lit, generic)))) == 0


def unrelated(technical: Column, own_technical: Column, skills: Column, own_skills: Column, words: Column, own_words: Column) -> Column:
    """Whether a posting has nothing to do with a person: of the other kind, with neither skills nor words of roles in common."""
    return (technical != own_technical) & ~F.arrays_overlap(skills, own_skills) & ~F.arrays_overlap(words, own_words)
