"""Text helpers: requests, packed lists, paths, commands, percentages, token rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.hexes import trimmed

#: White space as text splitting sees it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: One directory component made of harmless characters only (fixed values).
SAFE_COMPONENT = r"\A[A-Za-z0-9][A-Za-z0-9._+-]*\z"
CASE_LABEL = r"\A[A-Za-z0-9_-]+\z"
CONTROL = r"[\x00-\x1f\x7f]"
FORMULA_MARKERS = "=+-@"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return trimmed(c)


def normalise_request(c: Column | str) -> Column:
    """Lower case, outer white space gone, inner runs of it one blank."""
    return strip(F.regexp_replace(F.lower(_col(c)), f"{SPACE}+", " "))


def identifier(name: Column | str, version: Column | str) -> Column:
    return F.concat(_col(name), F.lit("-"), _col(version))


def cell_id(*parts: Column | str) -> Column:
    return F.concat_ws("-", *[_col(p) for p in parts])


def probe_id(path: Column | str, digest: Column | str) -> Column:
    """Stem of a file and the first twelve digits of its digest."""
    return F.concat(stem(path), F.lit("-"), F.left(_col(digest), F.lit(12)))


def project_name(group: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(_col(group), F.lit("-"), F.lit("_")))


def pack(values: Column | str, sep: str = ";") -> Column:
    return F.array_join(_col(values), sep)


def unpack(c: Column | str, sep: str = ";") -> Column:
    """Parts of a packed text, empty ones dropped; null gives an empty list."""
    parts = F.split(_col(c), "\\" + sep if sep in ".|*+?()[]{}^$" else sep)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def one_line(c: Column | str) -> Column:
    """Lines joined by `` | ``."""
    return F.replace(_col(c), F.lit("\n"), F.lit(" | "))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)/*\z", 1)


def suffix(path: Column | str) -> Column:
    """Last extension with its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(basename(path), r"\A\.*[^.].*?(\.[^.]+)\z", 1)


def stem(path: Column | str) -> Column:
    name, end = basename(path), suffix(path)
    return F.when(end == "", name).otherwise(F.left(name, F.length(name) - F.length(end)))


def zero_padded(n: Column | str, width: int) -> Column:
    """At least ``width`` digits; longer numbers keep all of theirs."""
    text = _col(n).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def first_part(c: Column | str, sep: str = "=") -> Column:
    """Before the first separator, trimmed; the whole text where there is none."""
    return strip(F.split(_col(c), sep, 2)[0])


def second_part(c: Column | str, sep: str = "=") -> Column:
    """After the first separator, trimmed; null where there is none."""
    return strip(F.get(F.split(_col(c), sep, 2), F.lit(1)))


def missing_markers(markers: Column, text: Column | str) -> Column:
    """Markers that the text does not contain, in their order."""
    return F.filter(F.coalesce(markers, F.array().cast("array<string>")), lambda m: ~F.coalesce(F.contains(_col(text), m), F.lit(False)))


def dotted_major(version: Column | str) -> Column:
    """First component of a dotted version; the second where the first is 1."""
    parts = F.split(F.regexp_extract(_col(version), r"(\d+(?:\.\d+)*)", 1), r"\.")
    return F.when(parts[0] == "1", F.get(parts, F.lit(1))).otherwise(parts[0]).try_cast("int")


def token_violation(c: Column | str) -> Column:
    """First broken rule of a queue token, else null: ``outer_whitespace_or_empty``, ``formula_marker``, ``control_character``."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == "") | (c != strip(c)), "outer_whitespace_or_empty")
        .when(F.left(c, F.lit(1)).isin(*FORMULA_MARKERS), "formula_marker")
        .when(c.rlike(CONTROL), "control_character")
    )


def safe_component(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(SAFE_COMPONENT), F.lit(False))


def safe_member_path(c: Column | str) -> Column:
    """Relative, and no part of it leads upwards."""
    c = _col(c)
    return F.coalesce(~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..") & (c != ""), F.lit(False))


def utc_text(ts: Column | str) -> Column:
    """A timestamp (session zone UTC) to the second, as ISO text with offset."""
    return F.date_format(F.date_trunc("SECOND", _col(ts)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


@F.arrow_udf(T.StringType())
def _percent(part: pa.Array, whole: pa.Array) -> pa.Array:
    return pa.array([None if p is None or w is None else "0.000000" if w == 0 else f"{100.0 * p / w:.6f}" for p, w in zip(part.to_pylist(), whole.to_pylist())], pa.string())


def percent_text(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole`` with six decimals, rounded from the exact binary value; ``0.000000`` for an empty whole.

    For final rows only: the JVM's formatting rounds ties of the decimal text,
    so these few values pass through Python, a batch at a time.
    """
    return _percent(_col(part), _col(whole))
