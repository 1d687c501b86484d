"""Regular expressions as users write them, checked and turned into what Spark's engine takes."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def linear_pattern(pattern: str) -> str:
    """A pattern of the linear-time dialect (named groups ``(?P<x>``, no look-around or references)."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if re.search(r"(?<!\\)(?:\\\\)*\((?:\?=|\?!|\?<=|\?<!|\?>|\?P=)", pattern):
        raise ValueError("look-around, atomic groups and references are not supported")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", pattern):
        raise ValueError("references to groups are not supported")
    return re.sub(r"\(\?P<", "(?<", pattern)


def basic_pattern(pattern: str) -> str:
    """A POSIX basic pattern, in which only the backslashed ( ) { } | + ? are special."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if in_class:
            out.append("\\\\" if c == "\\" else c)
            in_class = c != "]" or pattern[i - 1] in "[^"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(pattern[i] if pattern[i] in "(){}|+?" else f"\\{pattern[i]}")
        elif c in "(){}|+?":
            out.append(f"\\{c}")
        elif c == "*" and (not out or out[-1] in ("(", "|", "^")):
            out.append("\\*")
        else:
            in_class = c == "["
            out.append(c)
        i += 1
    return "".join(out)


def checked(spark: SparkSession, pattern: str) -> str:
    """The pattern, after the JVM has compiled it once on the driver; ValueError where it can't."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"not a valid pattern: {pattern!r}") from e
    return pattern
