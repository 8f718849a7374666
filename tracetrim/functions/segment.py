"""Step segmentation (string -> ARRAY<STRING>) as built-in Spark expressions.

Modes: ``sentences``, ``lines``, ``paragraphs``, ``numbered`` and ``auto``.  In every
mode the whole text is stripped first, each piece is stripped and empty pieces are
dropped, so blank or null text gives an empty array.  All work is row-local
(``split`` + ``transform`` + ``filter``): no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracetrim.functions.text import WS_CLASS, col_, strip_ref

# The step boundary patterns.
#   sentence end: . ! or ? then whitespace then an ASCII capital, digit, quote,
#                 apostrophe, ( or [ ; or . ! ? then one or more newlines
#   numbered marker at a line start: "Step N:" / "Step N." / "N." / "N)" then whitespace
#   paragraph: a blank line ("\n\n"); line: any str.splitlines() boundary
# str.splitlines() boundaries: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LINE SEP, PARAGRAPH SEP
LINE_BOUNDARY = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Every mode strips its pieces and drops empty ones.  The split patterns below also
# take in the whitespace around each boundary, so the pieces come out stripped: the
# whole text is stripped first, a boundary is never adjacent to another one once the
# blanks around it are consumed, and whitespace never carries the punctuation a
# later sentence boundary looks behind for.  That leaves ``array_remove(split(..),
# "")`` -- no lambdas, so the projection stays in whole-stage code generation.
_WS = WS_CLASS
_SENT_SPLIT = "(?U)(?<=[.!?])" + _WS + "+(?=[A-Z0-9\"'(\\[])|(?<=[.!?])\\n+" + _WS + "*"
_NUM_SPLIT = "(?mdU)" + _WS + "*(?:^|\\n)(?=(?:Step" + _WS + "*\\d+[:.]|\\d+[.)])" + _WS + "+)"
_PARA_SPLIT = "(?U)" + _WS + "*\\n\\n" + _WS + "*"
_LINE_SPLIT = "(?U)" + _WS + "*(?:" + LINE_BOUNDARY + ")" + _WS + "*"

MODES = ("auto", "sentences", "lines", "paragraphs", "numbered")


def _cleaned(text) -> Column:
    return strip_ref(F.coalesce(col_(text), F.lit("")))


def _pieces(cleaned: Column, pattern: str) -> Column:
    return F.array_remove(F.split(cleaned, pattern, -1), "")


def sentences(text) -> Column:
    return _pieces(_cleaned(text), _SENT_SPLIT)


def lines(text) -> Column:
    return _pieces(_cleaned(text), _LINE_SPLIT)


def paragraphs(text) -> Column:
    return _pieces(_cleaned(text), _PARA_SPLIT)


def numbered(text) -> Column:
    return _pieces(_cleaned(text), _NUM_SPLIT)


def auto(text) -> Column:
    """Numbered markers if they give more than one piece, else blank-line paragraphs
    if they give more than one, else sentences.  Plain expressions: whole-stage code
    generation shares the common parts (the cleaned text, the first split)."""
    cleaned = _cleaned(text)
    num = _pieces(cleaned, _NUM_SPLIT)
    para = _pieces(cleaned, _PARA_SPLIT)
    return (F.when(F.size(num) > 1, num)
            .when(F.size(para) > 1, para)
            .otherwise(_pieces(cleaned, _SENT_SPLIT)))


def segment(text, mode: str = "auto") -> Column:
    """``segment_steps(text, mode)`` as a Column expression."""
    fns = {"auto": auto, "sentences": sentences, "lines": lines, "paragraphs": paragraphs, "numbered": numbered}
    if mode not in fns:
        raise ValueError(f"Unknown segmentation mode: {mode}. Choose from {', '.join(MODES)}.")
    return fns[mode](text)
