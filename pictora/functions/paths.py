"""Parts of image paths and of the delimited lines that describe images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def folder(path: Column | str) -> Column:
    """The name of the folder a file is in; null if the path names none."""
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-2))


def stem(path: Column | str) -> Column:
    """The file name before its first dot."""
    return F.substring_index(name(path), ".", 1)


def image_key(path: Column | str) -> Column:
    return F.concat_ws("/", folder(path), name(path))


def caption_key(category: Column | str, path: Column | str) -> Column:
    return F.concat_ws("/", _col(category), stem(path))


def relevance(path: Column | str, category: Column | str) -> Column:
    """1 if the file lies in the category's folder, else 0."""
    return F.coalesce((folder(path) == _col(category)).cast("int"), F.lit(0))


def first_segment(line: Column | str, separator: str = "---") -> Column:
    """The first segment after the file name that holds anything; null if none does."""
    segments = F.transform(F.split(_col(line), separator), lambda x: F.trim(x))
    said = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda x: x != "")
    return F.try_element_at(said, F.lit(1))


def words(text: Column | str) -> Column:
    """Lower-cased words between white space: blank, tab, line feed, form feed and carriage return, which are what ``\\s`` is in the SQL's engine."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[ \t\n\f\r]+"), lambda x: x != "")
