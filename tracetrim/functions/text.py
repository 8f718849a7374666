"""Text helpers with Python ``str`` semantics, written as Spark built-in expressions.

Spark's ``trim`` removes spaces only, and Java's ``\\s`` is ASCII unless ``(?U)`` is
set; Python's ``str.strip``/``str.split`` treat every Unicode whitespace character
plus the separators U+001C..U+001F as blank.  The class below reproduces that set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace = Unicode White_Space plus U+001C..U+001F.
WS_CLASS = "[\\s\\x1c-\\x1f]"
_STRIP_RE = "(?U)^" + WS_CLASS + "+|" + WS_CLASS + "+\\z"
_WORD_SPLIT_RE = "(?U)" + WS_CLASS + "+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WS_ONE = "(?U)" + WS_CLASS


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Inside higher-order functions Spark evaluates children without common
    sub-expression elimination, so an expression referenced twice runs twice; a
    one-element ``transform`` binds it once.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)


def strip_ref(x: Column) -> Column:
    """``str.strip()`` for a value that is cheap to reference twice (a column or lambda
    variable).  The regex only runs when the first or last character is blank; most
    pieces need no change and cost two one-character tests."""
    edge = F.substring(x, 1, 1).rlike(_WS_ONE) | F.substring(x, -1, 1).rlike(_WS_ONE)
    return F.when(edge, F.regexp_replace(x, _STRIP_RE, "")).otherwise(x)


def py_strip(c) -> Column:
    """``str.strip()`` for any string expression (null stays null); the expression is
    evaluated once."""
    if isinstance(c, str):
        return strip_ref(F.col(c))
    return let(c, strip_ref)


def word_count(c) -> Column:
    """``len(s.split())``: number of whitespace-separated words (0 for null)."""
    words = F.split(py_strip(F.coalesce(col_(c), F.lit(""))), _WORD_SPLIT_RE, -1)
    return F.size(F.filter(words, lambda w: w != F.lit(""))).cast("int")


def clip_with_ellipsis(c, n: int) -> Column:
    """``s[:n] + ("..." if len(s) > n else "")``."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def normalise_step(c) -> Column:
    """Lower-case, every non letter/digit run to one space, stripped.  Used for repeat tests."""
    lowered = F.lower(col_(c))
    # every whitespace character is a non letter/digit, so after the replacement only
    # plain spaces can remain at the ends and ``trim`` equals str.strip here
    return F.trim(F.regexp_replace(lowered, "[^\\p{L}\\p{N}]+", " "))
