"""Identifiers and messages."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["debug", "info", "warn", "error"]


def workspace_id(uri: Column) -> Column:
    """Lower case, without slashes at the end."""
    return F.regexp_replace(F.lower(uri), "/+$", "")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def level_of(least: str) -> int:
    """Python's logging level for one of ``LEVELS``."""
    return [10, 20, 30, 40][LEVELS.index(least)]


def set_level(least: str) -> None:
    """Drops this package's messages below a level."""
    logging.getLogger("tidemark").setLevel(level_of(least))


def logged(level: Column, least: str) -> Column:
    """Whether a message of this level passes the threshold."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) >= LEVELS.index(least) + 1


def locale(language: Column) -> Column:
    return F.when(language.startswith("zh"), "zh-CN").otherwise("en")


def fill(template: str, *values: object) -> str:
    """Replaces {0}, {1}, ... ; a number without a value stays."""
    return re.sub(r"\{(\d+)\}", lambda m: str(values[int(m[1])]) if int(m[1]) < len(values) else m[0], template)


def filled(template: Column, values: Column) -> Column:
    """``fill`` as a column: values is an array of strings."""
    parts = F.split(template, r"\{\d+\}", -1)
    found = F.regexp_extract_all(template, F.lit(r"\{(\d+)\}"), F.lit(1))
    texts = F.transform(found, lambda n: F.coalesce(F.get(values, F.coalesce(n.try_cast("int"), F.lit(-1))), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(texts, i), F.lit("")))), "")
