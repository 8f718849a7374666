"""Line-first cleaning: bad lines go, then documents that lost too much text.

Each line that has a word is judged by itself, but for sentence marks and phrases, which are
looked for in its passage: the line with those that it carries on or that carry it on, where
prose was wrapped (no sentence mark at the upper line's end, and the lower one begins with a
small letter, or all of the paragraph's lines are as full as its width allows).

* punctuation: no sentence mark in its passage, or doubled marks (``!!``) after
  a large share of its words, or more symbol characters ``#*$%&|<>`` than ``max_symbols`` a word;
* navigation: at least two menu separators, one for every eight words or more;
* boilerplate: a phrase of licence, copyright or site furniture, in a passage of at most 20 words or
  one that has such a phrase for every twelve words or more; or a line seen before in the text.

Failing lines are removed.  A document is kept if it passes the base rules and its
remaining lines hold at least ``min_left`` of its word characters.  Text is handled row by
row: no shuffle, nothing but the longest text is held.

Defined results: null and empty texts have no words and are not kept; a null id is an id
like any other; repeated rows are judged each; other columns are carried along untouched.
"""

from __future__ import annotations

import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.llm.common import Carried
from tracetrim.session import ship_package

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SEPARATORS = re.compile(r"\||»|›|•|·|::| > | / ")
#: Fixed phrases of licences and site furniture, each pattern behind the plain texts one of which it always holds.
PHRASES = (
    (("all rights reserved",), r"all rights reserved"),
    (("licensed under", "licenced under"), r"\blicen[sc]ed under\b"),
    (("released under the",), r"\breleased under the\b"),
    (("copyright",), r"\bcopyright\b"),
    (("©",), r"©"),
    (("cookies", "cookie policy"), r"\bcookie(?:s| policy)\b"),
    (("privacy policy",), r"\bprivacy policy\b"),
    (("terms of use", "terms of service"), r"\bterms of (?:use|service)\b"),
    (("click here",), r"\bclick here\b"),
    (("sign in", "sign up"), r"\bsign (?:in|up)\b"),
    (("log in", "login"), r"\blog ?in\b"),
    (("subscribe",), r"\bsubscribe\b"),
    (("newsletter",), r"\bnewsletter\b"),
    (("enable javascript",), r"\benable javascript\b"),
    (("lorem ipsum",), r"\blorem ipsum\b"),
    (("read more",), r"\bread more\b"),
    (("share this", "share on"), r"\bshare (?:this|on)\b"),
    (("powered by",), r"\bpowered by\b"),
    (("skip to content",), r"\bskip to content\b"),
)
BOILERPLATE = re.compile("|".join(pattern for _, pattern in PHRASES), re.I)
HELD = [plain for plains, _ in PHRASES for plain in plains]
#: Letters beyond a-z that a pattern without regard to case takes for s, i or k, and that lower-case otherwise.
OTHER_CASES = re.compile("[\u017f\u0130\u0131\u212a]")
MARKS = ".!?…。！？:;：；．｡؟؛۔।॥։።፧፨။។៕།܀"
SENTENCE_MARK = re.compile(f"[{MARKS}]")
#: A sentence's or a heading's end: its mark, and quotes or brackets behind it.
ENDED = re.compile(rf"[{MARKS}][\"'”’»」』)\]]*$")
FIRST_WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOUBLED = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)")

DECISION = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, n_lines long, n_bad_lines long, left_chars long, kept boolean")


def count_chars(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


def repeated_words(words: list, n: int = 8) -> int:
    """Words that lie in a window of ``n`` words which the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            total += n - max(0, covered - i)
            covered = i + n
    return total


def line_fails(line: str, words: list, max_symbols: float = 0.3) -> bool:
    """By what the line itself shows."""
    n = len(words)
    if count_chars(line, SYMBOLS) > max_symbols * n:
        return True
    if ("!!" in line or "??" in line) and 2 * len(DOUBLED.findall(line)) >= n:
        return True
    found = len(SEPARATORS.findall(line))
    return found >= 2 and 8 * found >= n


def may_hold_phrase(text: str) -> bool:
    """False only where ``BOILERPLATE`` matches nowhere: plain texts are found many times faster."""
    low = text.lower()
    return any(plain in low for plain in HELD) or not text.isascii() and bool(OTHER_CASES.search(text))


def made_of_phrases(passage: str, short: int = 20, words_a_phrase: int = 12) -> bool:
    """Whether a passage that holds phrases is furniture; ten characters are a word where no blanks stand between words."""
    n = max(len(passage.encode("utf-8", "surrogatepass").split()), len(passage) // 10)
    return n <= short or words_a_phrase * len(BOILERPLATE.findall(passage)) >= n


def _full(line: str, after: str, width: int) -> bool:
    """The first word of ``after`` had no room behind ``line``."""
    return len(line) + 1 + len(FIRST_WORD.match(after)[0]) > width


def passages(lines: list[str], widest: int = 200) -> list[int]:
    """For each line the number of its passage.  A paragraph (lines without an empty one between) counts as
    wrapped if it has three lines or more, none above ``widest`` characters, and each but the last is full or ends a sentence."""
    bare, at, lo = [line.strip(BLANKS) for line in lines], list(range(len(lines))), 0
    for hi in range(len(lines) + 1):
        if hi < len(lines) and bare[hi]:
            continue
        open_ = [i for i in range(lo, hi - 1) if not ENDED.search(bare[i])]
        if open_:
            width = max(map(len, bare[lo:hi]))
            wrapped = hi - lo > 2 and width <= widest and all(_full(bare[i], bare[i + 1], width) for i in open_)
            for i in open_:
                if wrapped or bare[i + 1][0].islower():
                    at[i + 1] = at[i]
        lo = hi + 1
    return at


def judge(text: str, min_words: int = 20, max_repeat: float = 0.3, min_left: float = 0.5):
    """(counts and verdict, the lines that stay)."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - count_chars(text, BLANKS)
    n_repeat = repeated_words(words)
    failed = n_words < min_words or 100 * n_repeat > round(100 * max_repeat) * n_words
    seen, left, left_chars, lines, dup, bad = set(), [], 0, 0, 0, 0
    all_lines, phrases = text.split("\n"), may_hold_phrase(text)
    of = passages(all_lines)
    joined = [" ".join(map(itemgetter(1), group)) for _, group in groupby(zip(of, all_lines), itemgetter(0))]
    passage = dict(zip(dict.fromkeys(of), joined))
    for at, line in zip(of, all_lines):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            left.append(line)
            continue
        lines += 1
        again = line in seen
        dup += again
        seen.add(line)
        if (again or line_fails(line, own) or not (SENTENCE_MARK.search(line) or SENTENCE_MARK.search(passage[at]))
                or phrases and BOILERPLATE.search(line) and made_of_phrases(passage[at])):
            bad += 1
        else:
            left.append(line)
            left_chars += len(line) - count_chars(line, BLANKS)
    kept = not failed and left_chars >= min_left * word_chars
    return (n_words, word_chars, count_chars(text, SYMBOLS), dup, n_repeat, failed, lines, bad, left_chars, kept), left


def clean_lines(docs: DataFrame, min_words: int = 20, max_repeat: float = 0.3, min_left: float = 0.5) -> DataFrame:
    """The input's rows with ``_text`` (bad lines removed) and ``_quality`` (counts and verdict).

    The rows travel as one struct column, so that no column of the input can clash.
    """
    return _judged(Carried(docs, "text").frame, ["_row"], True, min_words, max_repeat, min_left)


def _judged(frame: DataFrame, keep: list[str], with_text: bool, min_words: int, max_repeat: float, min_left: float) -> DataFrame:
    ship_package(frame.sparkSession)
    types = [f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*types, *["_text string"] * with_text, f"_quality struct<{DECISION.replace(' long', ':long').replace(' boolean', ':boolean')}>"])
    names = [f.split()[0] for f in DECISION.split(", ")]

    def run(batches):
        for batch in batches:
            found, texts = [], []
            for v in batch.column(len(keep)):
                got, left = judge(v.as_py() or "", min_words, max_repeat, min_left)
                found.append(got)
                if with_text:
                    texts.append("\n".join(left))
            cols = list(zip(*found)) or [[] for _ in names]
            quality = pa.StructArray.from_arrays(
                [pa.array(c, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, c in zip(names, cols)], names=names)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], *[pa.array(texts, pa.string())] * with_text, quality],
                names=[*keep, *["_text"] * with_text, "_quality"])

    return frame.select(*keep, "text").mapInArrow(run, schema)


def line_quality(docs: DataFrame, min_words: int = 20, max_repeat: float = 0.3, min_left: float = 0.5) -> DataFrame:
    """doc_id with counts and verdict of each document, without its text."""
    frame = Carried(docs, "doc_id", "text").frame.select("doc_id", "text")
    return _judged(frame, ["doc_id"], False, min_words, max_repeat, min_left).select("doc_id", "_quality.*")


def quality_stage(docs: DataFrame) -> DataFrame:
    """Kept documents with their bad lines removed, in the input's columns; n_chars counts anew."""
    carried = Carried(docs, "text")
    judged = _judged(carried.frame, ["_row"], True, 20, 0.3, 0.5).where(F.col("_quality.kept"))
    return carried.restore(judged, text=F.col("_text"), n_chars=F.length("_text").cast("long"))
