"""DuckDB expression builders used by the oracle SQL.

RE2 has no look-around, so sentence / numbered boundaries are first rewritten to a
U+0001 sentinel and then split on it.
"""

from __future__ import annotations

# Python whitespace in RE2 syntax: \t-\r, FS..US, NEL and the Unicode separators.
D_WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{D_WS}+|{D_WS}+$', '', 'g')"


def cleaned(x: str) -> str:
    return strip(f"coalesce({x}, '')")


def pieces(split_expr: str) -> str:
    return f"list_filter(list_transform({split_expr}, lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    c = cleaned(x)
    s1 = f"""regexp_replace({c}, '([.!?]){D_WS}+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g')"""
    s2 = f"regexp_replace({s1}, '([.!?])\\n+', '\\1' || chr(1), 'g')"
    return pieces(f"string_split({s2}, chr(1))")


def numbered(x: str) -> str:
    c = cleaned(x)
    s1 = f"regexp_replace({c}, '(?m)^((?:Step{D_WS}*[0-9]+[:.]|[0-9]+[.)]){D_WS})', chr(1) || '\\1', 'g')"
    return pieces(f"string_split({s1}, chr(1))")


def paragraphs(x: str) -> str:
    return pieces(f"string_split({cleaned(x)}, chr(10) || chr(10))")


def lines(x: str) -> str:
    return pieces(f"regexp_split_to_array({cleaned(x)}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')")


def auto(x: str) -> str:
    num, para, sent = numbered(x), paragraphs(x), sentences(x)
    return f"(CASE WHEN len({num}) > 1 THEN {num} WHEN len({para}) > 1 THEN {para} ELSE {sent} END)"


def segment(x: str, mode: str = "auto") -> str:
    return {"auto": auto, "sentences": sentences, "lines": lines, "paragraphs": paragraphs, "numbered": numbered}[mode](x)


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({cleaned(x)}, '{D_WS}+'), lambda w: w <> ''))"


def norm_step(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
