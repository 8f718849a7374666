"""Final-answer extraction (H1) as built-in expressions.

First rule that matches anywhere wins:
1. ``#### <number-ish>``      -> stripped, commas removed
2. ``\\boxed{...}``            -> stripped
3. ``the answer is`` / ``equals`` / ``final answer[:]`` (any case) + number-ish -> commas removed
4. the last number in the text
5. null
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracetrim.functions.text import col_, py_strip

# The answer patterns.
GSM_RE = "(?U)####\\s*([-\\d.,]+)"
BOXED_RE = "\\\\boxed\\{([^}]+)\\}"
PHRASE_RE = "(?iU)(?:the answer is|equals|final answer:?)\\s*([-\\d.,]+)"
NUMBER_RE = "(?U)[-+]?\\d*\\.?\\d+"


def extract_answer(text) -> Column:
    t = F.coalesce(col_(text), F.lit(""))
    last_num = F.try_element_at(F.regexp_extract_all(t, F.lit(NUMBER_RE), 0), F.lit(-1))
    return (
        F.when(t.rlike(GSM_RE), F.replace(py_strip(F.regexp_extract(t, GSM_RE, 1)), F.lit(","), F.lit("")))
        .when(t.rlike(BOXED_RE), py_strip(F.regexp_extract(t, BOXED_RE, 1)))
        .when(t.rlike(PHRASE_RE), F.replace(py_strip(F.regexp_extract(t, PHRASE_RE, 1)), F.lit(","), F.lit("")))
        .otherwise(last_num)
    )
