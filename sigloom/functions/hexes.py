"""Hashes and addresses written as hexadecimal text.

Case, ``0x`` prefixes, surrounding blanks, underscores between digits and
missing leading zeros do not change the number a text denotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a hash text must hold once blanks, prefix and underscores are gone.
_DIGITS = r"\A[0-9a-f]{1,16}\z"
_CANONICAL = r"\A[0-9a-f]{16}\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"(?U)\A\s+|\s+\z|(?<=[0-9a-fA-F])_+(?=[0-9a-fA-F])", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"\A0x", ""), r"\A0+(?=[0-9a-f])", "")


def hash_text(c: Column | str) -> Column:
    """16 lower-case hex digits of the unsigned 64-bit number; null if the text denotes none.

    Texts already in that form skip the rewriting.
    """
    c = _col(c)
    digits = _digits(c)
    return F.when(c.rlike(_CANONICAL), c).when(digits.rlike(_DIGITS), F.lpad(digits, 16, "0"))


def address_text(c: Column | str) -> Column:
    """8 lower-case hex digits of the address; longer addresses keep their digits.

    A text that denotes no address comes back trimmed, so that distinct odd
    keys stay distinct; null stays null.
    """
    c = _col(c)
    digits = _digits(c)
    return (
        F.when(c.rlike(r"\A[0-9a-f]{8}\z"), c)
        .when(digits.rlike(_DIGITS), F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0")))
        .otherwise(trimmed(c))
    )


def hash_long(text: Column) -> Column:
    """The 64 bits of a canonical hash text as a signed bigint (a bijection)."""
    return F.conv(text, 16, -10).cast("bigint")


def unsigned_hex(c: Column | str) -> Column:
    """A bigint as 16 lower-case digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(_col(c)), 16, "0"))


#: White space of any script.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(_col(c), F.lit(BLANKS))
