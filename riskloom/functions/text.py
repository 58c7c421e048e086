"""Text normalisation and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode's White_Space characters (tabs, NBSP, ...), those that the regular expression (?U)\s matches.
_WS = "\t\n\u000b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Without leading and trailing whitespace, like Python's strip(); no regular expression, it runs on every party row."""
    return F.btrim(c, F.lit(_WS))


def norm_name(c: Column) -> Column:
    """Strip all Unicode edge whitespace, then lower-case (name matching key)."""
    return F.lower(strip_ws(c))


def norm_id(c: Column) -> Column:
    """Key normalisation for ids: trim spaces, lower-case; ids stay strings."""
    return F.lower(F.trim(c.cast("string")))


def python_title(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest.

    Matches Python's ``str.title`` for the status/role vocabularies, where a
    word boundary is any non-letter (``voluntary-arrangement`` becomes
    ``Voluntary-Arrangement``); ``initcap`` alone only splits on spaces. A
    space (U+0001-marked) is put after every non-letter so ``initcap`` sees
    each letter run as a word, then removed again — all code-generated string
    functions, no per-element lambda.
    """
    marked = F.regexp_replace(F.lower(c), r"([^\p{L}])", "$1\u0001 ")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def join_nonempty(sep: str, *cols: Column) -> Column:
    """Join parts with ``sep`` skipping NULL and empty strings."""
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cols])


def yes_no(flag: Column, yes: str = "YES", no: str = "No") -> Column:
    """Boolean to label; NULL counts as no (a missing flag is falsy)."""
    return F.when(F.coalesce(flag, F.lit(False)), yes).otherwise(no)


def money_label(c: Column, symbol: str = "$") -> Column:
    """``$1,234.56`` — thousands separators, two decimals."""
    return F.concat(F.lit(symbol), F.format_number(c, 2))
