"""Text, version and JSON expressions."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def str2list(text: Column, separator: str = ",", kind: str = "array<double>") -> Column:
    """The list inside the first bracket or else parenthesis of a text, parsed as JSON; null where there is none."""
    spaced = F.replace(text, F.lit(separator), F.lit(","))
    square, round_ = F.regexp_extract(spaced, r"(\[.*\])", 1), F.regexp_extract(spaced, r"(\(.*\))", 1)
    body = F.when(square != "", square).when(round_ != "", round_)
    return F.from_json(F.translate(body, "()", "[]"), kind)


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits count as numbers."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1), lambda part: F.when(part.rlike(r"^\d+$"), F.lpad(part, 20, "0")).otherwise(part))


def stem(path: Column) -> Column:
    """The last part of a path without its extension, if it has one."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def is_url(text: Column) -> Column:
    """Whether both a scheme and a host are there."""
    return F.coalesce(F.try_parse_url(text, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(text, F.lit("HOST")).isNotNull(), F.lit(False))


def version_key(version: Column) -> Column:
    """The first three whole numbers of a version."""
    return F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"(\d+)"), 1), 1, 3), lambda n: n.cast("int"))


_COMPARE = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def check_version(version: Column, required: str) -> Column:
    """Whether a version meets all of the comma-separated requirements; a bare one means at least."""
    verdict = F.lit(True)
    for part in required.strip(", ").split(","):
        found = re.match(r"(==|!=|>=|<=|>|<)?\s*(\S+)", part.strip())
        wanted = F.array(*(F.lit(int(n)) for n in re.findall(r"\d+", found[2])[:3]))
        verdict = verdict & _COMPARE[found[1] or ">="](version_key(version), wanted)
    return verdict


def props_value(json: Column, key: str, kind: str) -> Column:
    return F.from_json(json, f"`{key}` {kind}")[key]


def date_stamp() -> Column:
    """Today as year/month/day."""
    return F.date_format(F.current_date(), "yyyy/MM/dd")
