"""Column expressions over CSV text lines. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One field where '"' toggles quoting and is dropped. Possessive, so that a line of megabytes needs
# neither backtracking nor stack.
TOGGLE_FIELD = r'(?:[^,"]++|"[^"]*+(?:"|\z))*+'
# One field by RFC 4180: doubled quotes stand for one, text may follow the closing quote.
RFC_FIELD = r'"(?:[^"]++|"")*+(?:"[^,]*+|\z)|[^,]*+'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def csv_fields(line: Column | str, dialect: str = "toggle") -> Column:
    """The fields of a line as an array; an empty line has one empty field."""
    # the comma put before the line keeps an empty first field from being skipped
    pattern = {"toggle": TOGGLE_FIELD, "rfc4180": RFC_FIELD}[dialect]
    raw = F.regexp_extract_all(F.concat(F.lit(","), _col(line)), F.lit(f",({pattern})"), F.lit(1))
    if dialect == "toggle":
        return F.transform(raw, lambda f: F.replace(f, F.lit('"'), F.lit("")))

    def unquoted(f: Column) -> Column:
        quoted = F.regexp_extract(f, r'^"((?:[^"]++|"")*+)', 1)
        after = F.regexp_extract(f, r'^"(?:[^"]++|"")*+"([^,]*+)$', 1)
        return F.when(f.startswith('"'), F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), after)).otherwise(f)

    return F.transform(raw, unquoted)


def field(line: Column | str, n: int, base: int = 1, dialect: str = "toggle") -> Column:
    """The n-th field, counted from ``base``; '' where the line has fewer."""
    if n < base:
        raise ValueError(f"fields count from {base}")
    return F.coalesce(F.get(csv_fields(line, dialect), F.lit(n - base)), F.lit(""))


def first_fields(line: Column | str, n: int = 3, dialect: str = "toggle") -> Column:
    """The first n fields joined by commas, or the whole line where it has fewer.

    ``toggle`` keeps quotes as they stand; ``rfc4180`` joins the unquoted values.
    """
    line = _col(line)
    if dialect == "toggle":
        return F.regexp_extract(line, rf"\A({TOGGLE_FIELD}(?:,{TOGGLE_FIELD}){{0,{n - 1}}})", 1)
    fields = csv_fields(line, dialect)
    return F.when(F.size(fields) >= n, F.array_join(F.slice(fields, 1, n), ",")).otherwise(line)


def format_count(key: Column | str, n: Column | str) -> Column:
    """'KEY,COUNT'."""
    return F.concat_ws(",", _col(key), _col(n).cast("string"))


def parse_count(line: Column | str) -> tuple[Column, Column]:
    """(key, count) of 'KEY,COUNT', split at the last comma; count is null where it isn't a number."""
    line = _col(line)
    pattern = r"(?s)^(.*),([^,]*)$"
    return F.regexp_extract(line, pattern, 1), F.try_to_number(F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")), F.lit("9" * 18)).cast("long")
