"""DuckDB spellings of the text functions, for the oracle statements.

Same character classes as ``functions.text`` with RE2's ``\\x{..}`` escapes;
``regexp_replace`` needs the ``'g'`` flag to replace every match.
"""

from __future__ import annotations

from textmill.functions.fixed import CONTRACTIONS, NUMBER_MASKS
from textmill.functions.text import CONTRACTION_PATTERN, VOCAB_FILTER_CLASS
from textmill.plans.registry import sql_lit

WS_BODY = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WS = "[" + WS_BODY + "]"
WS_RUN = WS + "+"
NOT_WORD_OR_WS = r"[^\p{L}\p{N}_" + WS_BODY + "]"
PUNCT_DIGITS = r"[\x{21}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}\t\n\r]"

CONTRACTION_MAP = "MAP {" + ", ".join(f"{sql_lit(k)}: {sql_lit(v)}" for k, v in CONTRACTIONS.items()) + "}"


def rr(e: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({e}, {sql_lit(pattern)}, {sql_lit(repl)}, 'g')"


def mask_numbers(e: str) -> str:
    for pattern, mask in NUMBER_MASKS:
        e = rr(e, pattern, mask)
    return e


def expand_contractions(e: str) -> str:
    pat = sql_lit(CONTRACTION_PATTERN)
    gaps = f"string_split_regex({e}, {pat})"
    hits = f"list_transform(regexp_extract_all({e}, {pat}, 1), lambda h: {CONTRACTION_MAP}[h])"
    return (f"array_to_string(list_transform(range(len({gaps})), "
            f"lambda i: {gaps}[i + 1] || coalesce(list_concat({hits}, [''])[i + 1], '')), '')")


def remove_punctuation(e: str) -> str:
    return rr(e, NOT_WORD_OR_WS, "")


def clean_cte(src: str, text: str = "text", keep: str = "doc_id", punctuation: bool = True,
              out: str = "clean") -> str:
    """Two-step T6/T7 chain as nested SELECTs over ``src``."""
    pre = mask_numbers(f"lower({text})")
    exp = expand_contractions("__pre")
    if punctuation:
        exp = remove_punctuation(exp)
    return (f"(SELECT {keep}, {exp} AS {out} FROM "
            f"(SELECT {keep}, {pre} AS __pre FROM {src}))")


def split_ws(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {sql_lit(WS_RUN)}), lambda x: x <> '')"


def n_words(e: str) -> str:
    return f"len({split_ws(e)})"


def collapse_ws(e: str) -> str:
    return f"trim({rr(e, WS_RUN, ' ')}, ' ')"


def strip_ws(e: str) -> str:
    return rr(e, "^" + WS_RUN + "|" + WS_RUN + "$", "")


def tokenize(e: str) -> str:
    t = rr(e, r"[^\x{00}-\x{7f}]+", " ")
    t = rr(f"lower({t})", PUNCT_DIGITS, " ")
    return split_ws(t)


def letters_only(e: str) -> str:
    t = rr(e, "[^a-zA-Z]", " ")
    t = rr(t, r"\s+[a-zA-Z]\s+", " ")
    return rr(t, r"\s+", " ")


def vocab_words(e: str) -> str:
    t = rr(f"lower({e})", VOCAB_FILTER_CLASS, " ")
    return f"list_filter(string_split({t}, ' '), lambda x: x <> '')"


def capitalize(e: str) -> str:
    head = f"CASE WHEN substr({e}, 1, 1) = chr(223) THEN 'Ss' ELSE upper(substr({e}, 1, 1)) END"
    return f"({head} || lower(substr({e}, 2)))"


def seeded_hash(seed, *exprs: str) -> str:
    from textmill.functions.hashing import sql_hash
    return sql_hash(seed, *exprs)


def round6_sql(e: str, digits: int = 6) -> str:
    """``round`` with the sign of zero dropped (Spark's decimal rounding never
    yields -0.0; DuckDB's keeps it)."""
    return f"(CASE WHEN round({e}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({e}, {digits}) END)"
