"""Text expressions with Python string semantics, kept inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip()/str.split() treat as space.
SPACE = r"(?U)[\s\x1C-\x1F]"
# Line breaks of an event stream.
LINE_BREAK = r"\r\n|\r|\n"


def col_of(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def py_strip(value) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(col_of(value), f"{SPACE}+$|^{SPACE}+", "")


def collapse_space(value) -> Column:
    """``" ".join(s.split())``."""
    return py_strip(F.regexp_replace(col_of(value), f"{SPACE}+", " "))


def has_text(value) -> Column:
    """True when something other than white space is present."""
    return col_of(value).rlike(r"(?U)[^\s\x1C-\x1F]")


def words(value) -> Column:
    """``str.split()``: white-space tokens, case kept, empties dropped."""
    return F.array_remove(F.split(col_of(value), f"{SPACE}+"), "")


def head(value, chars: int) -> Column:
    return F.substring(col_of(value), 1, chars)


def flatten_newlines(value) -> Column:
    return F.replace(col_of(value), F.lit("\n"), F.lit(" "))


def blank_to_null(value) -> Column:
    return F.nullif(col_of(value), F.lit(""))


def first_segment(path) -> Column:
    """Top-level path part, ``?`` when empty."""
    return F.coalesce(blank_to_null(F.split_part(col_of(path), F.lit("/"), F.lit(1))), F.lit("?"))


def file_name(path) -> Column:
    return F.element_at(F.split(col_of(path), "/"), -1)


def file_stem(path) -> Column:
    """Base name without its last extension."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_suffix(path) -> Column:
    """Lower-cased last extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^[^.].*?(\.[^.]+)$|^\..*?[^.].*?(\.[^.]+)$", 1))


def newline_count(value) -> Column:
    v = col_of(value)
    return F.length(v) - F.length(F.replace(v, F.lit("\n"), F.lit("")))


def find_from(text, probe, cursor) -> Column:
    """0-based find from ``cursor``, then from the start, else the cursor itself."""
    t, p, c = col_of(text), col_of(probe), col_of(cursor)
    later = F.locate_from(p, t, c + 1) if hasattr(F, "locate_from") else F.call_function("locate", p, t, c + 1)
    early = F.call_function("locate", p, t)
    return F.when(later > 0, later - 1).when(early > 0, early - 1).otherwise(c)


def glob_regex(pattern: str) -> str:
    """Shell glob to a full-match regex; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close]
            body = "^" + body[1:] if body.startswith("!") else body
            out.append("[" + body.replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append("\\" + ch if not ch.isalnum() and ch not in "_/ " else ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path, patterns) -> Column:
    """True when a pattern fits the whole path or a tail of it."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | col_of(path).rlike(glob_regex(pattern)) | col_of(path).rlike(glob_regex("*/" + pattern))
    return hit


def percent(score) -> Column:
    """Half-up whole percent."""
    return F.floor(col_of(score) * 100 + F.lit(0.5)).cast("bigint")


def failure_reason(message) -> Column:
    """Exception text to a retry class."""
    m = F.lower(col_of(message))
    return F.when(m.rlike("429|rate limit|ratelimit|too many requests"), F.lit("rate_limit")).otherwise(
        F.lit("parse_error")
    )


def iso_seconds(ts) -> Column:
    """UTC ISO-8601 text with second precision and ``+00:00``."""
    return F.date_format(col_of(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def published_after(as_of, months: int) -> Column:
    """``months`` x 30 days before ``as_of`` as text with a ``Z`` suffix."""
    return F.date_format(col_of(as_of) - F.expr(f"INTERVAL {30 * months} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cache_key(query) -> Column:
    return F.substring(F.sha2(col_of(query), 256), 1, 16)
