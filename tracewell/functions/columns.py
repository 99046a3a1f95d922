"""Column expressions for texts, paths and identifiers; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_ext(path: Column, exts: tuple[str, ...], any_case: bool = False) -> Column:
    """Whether the path ends in one of the extensions; in any case only where files are chosen for splitting."""
    p = F.lower(path) if any_case else path
    out = F.lit(False)
    for e in exts:
        out = out | p.endswith(e)
    return out


def lstrip(text: Column) -> Column:
    """White space of any kind removed in front (`ltrim` would take blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def starts_any(text: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | text.startswith(s)
    return out


def extension(path: Column) -> Column:
    """The last dot and what follows in the last component; empty if none, or if the name begins with it."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalised_path(path: Column) -> Column:
    """`.`, empty and `name/..` components folded; leading `..` of a relative path stay; empty becomes `.`."""
    rooted = path.startswith("/")

    def fold(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = (part == "..") & last.isNotNull() & (last != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def joined_path(folder: Column, path: Column) -> Column:
    return normalised_path(F.when(path.startswith("/"), path).when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path)))


def walk_key(path: Column) -> Column:
    """Sort key of a folder walk that lists a folder's files before its subfolders, names by code point."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, 0).otherwise(1).alias("folder"), p.alias("name")))


def code_tokens(text: Column) -> Column:
    """Maximal runs of code identifier characters: what stands on identifier boundaries."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def style_tokens(text: Column) -> Column:
    """Maximal runs of style identifier characters, which include the hyphen."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_-]+"), F.lit(0))


def id_list(text: Column) -> Column:
    """`1,2;3` as sorted distinct longs; null if any piece is no number."""
    pieces = F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    good = F.forall(pieces, lambda p: p.rlike("^[0-9]+$"))
    return F.when(good, F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p.cast("long")))))


def squeezed_blanks(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends: squeezing for texts without quotes."""
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))
