"""Text scalar functions (T1-T17) as built-in Column expressions.

No Python UDF anywhere: every function returns a JVM-side expression that
stays inside whole-stage codegen.  Character classes are spelled out in full
so that Spark (Java regex) and the DuckDB oracle (RE2) agree with Python's
Unicode ``\\w`` / ``\\s``; a bare ``\\w`` or ``\\s`` would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.fixed import (
    ENGLISH_STOP_WORDS,
    ASCII_PUNCTUATION,
    CONTRACTIONS,
    EXTRA_SYMBOLS,
    NORMALIZER_PATTERN,
    NUMBER_MASKS,
    VOCAB_FILTER_CHARS,
)

# Python's str.isspace() set, as a Java regex class body.
WS_BODY = r"\t-\r\x1c-\x20\x85\p{Z}"
WS = "[" + WS_BODY + "]"
WS_RUN = WS + "+"
# Everything that is neither a Python Unicode word character nor whitespace.
NOT_WORD_OR_WS = r"[^\p{L}\p{N}_" + WS_BODY + "]"
# ASCII punctuation, digits, CR, TAB, LF (the min-count tokenizer's class).


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_class(chars: str) -> str:
    """A regex character class matching exactly ``chars`` (Java and RE2)."""
    body = "".join(ch if ch.isalnum() or ch in "\t\n" else "\\" + ch for ch in chars)
    return "[" + body + "]"


CONTRACTION_PATTERN = "(" + "|".join(CONTRACTIONS) + ")"
# Same matches, faster: every key is letters, then an apostrophe, then more,
# so a key can only start where letters-then-apostrophe follow.  The
# lookahead rejects every other position after a short scan instead of
# trying all 120 alternatives there; it never changes which key wins.
CONTRACTION_PATTERN_FAST = "(?=[A-Za-z]*')" + CONTRACTION_PATTERN
VOCAB_FILTER_CLASS = regex_class(VOCAB_FILTER_CHARS)


# T1
def lower(c) -> Column:
    return F.lower(_col(c))


# The reference computes a stripped string and returns its input.
def clean_text(c, strict: bool = False) -> Column:
    c = _col(c)
    if not strict:
        return c
    return F.regexp_replace(c, "[^a-zA-z0-9" + WS_BODY + "]", "")


# T3
def mask_numbers(c) -> Column:
    """Digit runs: 5+ -> '#####', 4 -> '####', 3 -> '###', 2 -> '##'.

    Same result as the four sequential replacements in two passes: after 5+
    runs are masked every remaining run has 2-4 digits, and each of those
    maps to as many '#', i.e. every digit with a digit neighbour becomes
    '#'.  Texts without any ASCII digit skip both passes (the reference's
    own guard)."""
    c = _col(c)
    out = F.regexp_replace(c, NUMBER_MASKS[0][0], NUMBER_MASKS[0][1])
    out = F.regexp_replace(out, "(?<=[0-9])[0-9]|[0-9](?=[0-9])", "#")
    return F.when(c.rlike("[0-9]"), out).otherwise(c)


# T4
def expand_contractions(c) -> Column:
    """One left-to-right pass; at a position the first key in dictionary order
    wins; replacements are not rescanned.  Gaps come from ``split`` and hits
    from ``regexp_extract_all`` (both walk the same matcher), then they are
    zipped back together.  ``c`` is read twice: pass a column, not a costly
    expression (see ``operators.clean.clean``)."""
    c = _col(c)
    mapping = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])
    gaps = F.split(c, CONTRACTION_PATTERN_FAST, -1)
    hits = F.regexp_extract_all(c, F.lit(CONTRACTION_PATTERN_FAST), 1)
    repl = F.transform(hits, lambda h: F.try_element_at(mapping, h))
    pieces = F.zip_with(gaps, F.concat(repl, F.array(F.lit(""))), lambda g, r: F.concat(g, r))
    # every key holds an apostrophe: texts without one skip both regex passes
    return F.when(F.instr(c, "'") > 0, F.array_join(pieces, "")).otherwise(c)


# T5
def remove_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), NOT_WORD_OR_WS, "")


# T8
def letters_only(c) -> Column:
    out = F.regexp_replace(_col(c), "[^a-zA-Z]", " ")
    out = F.regexp_replace(out, r"\s+[a-zA-Z]\s+", " ")
    return F.regexp_replace(out, r"\s+", " ")


# T9
def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends."""
    return F.regexp_replace(_col(c), "^" + WS_RUN + "|" + WS_RUN + "$", "")


def split_ws(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty pieces."""
    return F.filter(F.split(_col(c), WS_RUN, -1), lambda x: x != "")


# T10
def n_words(c) -> Column:
    return F.size(split_ws(c))


# T11
def n_chars(c) -> Column:
    return F.length(_col(c))


# T12
def normalize(c) -> Column:
    out = F.replace(F.replace(strip_ws(c), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.lower(out)


def default_stop_words(language: str = "english") -> list[str]:
    """Spark ML's English stop-word list, as plain data: oracle SQL and the
    registry are built without a JVM."""
    if language != "english":
        raise ValueError(f"no stop-word list for {language!r}; pass your own words")
    return list(ENGLISH_STOP_WORDS)


def symbols() -> list[str]:
    return list(ASCII_PUNCTUATION) + EXTRA_SYMBOLS


def drop_tokens(arr, words: list[str], case_sensitive: bool = True) -> Column:
    """Remove every token found in ``words``, keeping duplicates and order
    (``array_except`` would also de-duplicate)."""
    listed = sorted({w if case_sensitive else w.lower() for w in words})
    # a long literal IN becomes a hash set, so a token costs one look-up
    return F.filter(_col(arr), lambda t: ~(t if case_sensitive else F.lower(t)).isin(listed))


# T14
# After the reference's steps (non-ASCII runs -> space, lower, ASCII
# punctuation / digits / CR / TAB / LF -> space, split on whitespace) a
# token is exactly a maximal run of these characters, lower-cased:
TOKEN_RUN = r"[A-Za-z\x00-\x08\x0e-\x1b\x7f]+"


def tokenize(c) -> Column:
    """One regex pass: extract the token runs, then lower-case them (ASCII
    only by construction, so no non-ASCII letter can lower into a token)."""
    runs = F.regexp_extract_all(_col(c), F.lit(TOKEN_RUN), 0)
    return F.transform(runs, lambda t: F.lower(t))


# T15
def normalized_tokens(c, pattern: str = NORMALIZER_PATTERN, lowercase: bool = False) -> Column:
    """Whitespace tokens, each cleaned by ``pattern``; empty results dropped."""
    toks = split_ws(c)
    toks = F.transform(toks, lambda t: F.regexp_replace(F.lower(t) if lowercase else t, pattern, ""))
    return F.filter(toks, lambda t: t != "")


# T16
def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character to title case, rest lower.
    The sharp s title-cases to 'Ss' (Java's upper gives 'SS'); other
    multi-character title mappings (ligatures such as U+FB01) are not covered."""
    c = _col(c)
    first = F.substring(c, 1, 1)
    head = F.when(first == F.lit("\u00df"), F.lit("Ss")).otherwise(F.upper(first))
    return F.concat(head, F.lower(F.substring(c, 2, 2147483647)))


def explode_tokens(df, arr, out: str = "token", keep: list[str] | None = None, with_pos: bool = False):
    """Rows of (``keep``..., [pos,] token), no rows for empty arrays.

    Uses the ``_outer`` generators and drops the null row they emit for an
    empty array: with a plain ``explode`` Catalyst infers
    ``size(arr) > 0`` below the generator and pushes it through the
    projection, evaluating the whole token expression twice per row."""
    keep = keep or []
    if with_pos:
        gen = F.posexplode_outer(_col(arr)).alias("pos", out)
        return df.select(*keep, gen).where(F.col("pos").isNotNull())
    return df.select(*keep, F.explode_outer(_col(arr)).alias(out)).where(F.col(out).isNotNull())


# T17
def join_tokens(arr, sep: str = " ") -> Column:
    return F.array_join(_col(arr), sep)


def vocab_words(c) -> Column:
    """Tokens of the frequency vocabulary (V1): lower, filter characters to
    spaces, split on single spaces, drop empties -- in one pass, as the
    maximal runs of characters that are neither filters nor spaces."""
    keep = "[^" + VOCAB_FILTER_CLASS[1:-1] + " ]+"
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(keep), 0)


# V8
def ngrams(arr, n: int = 2) -> Column:
    """Word n-grams joined by spaces.  Built from ``n`` shifted slices zipped
    together, so ``arr`` is only referenced outside lambdas (where Catalyst
    de-duplicates it); inside a ``transform`` lambda it would be recomputed
    for every element."""
    arr = _col(arr)
    m = F.greatest(F.size(arr) - F.lit(n - 1), F.lit(0))
    out = F.slice(arr, 1, m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(arr, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return out
