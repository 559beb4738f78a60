"""Personal data: patterns propose spans, checksums confirm them, context
words adjust their score.  Only DataFrame functions; one narrow stage.

A *kind* has a base pattern, whose matches are kept when its check holds, and
narrower patterns that find what a base match swallowed or misses: a number
inside a longer run of digits, an account number, a number that only the words
before it make personal.  Each proposal starts at its pattern's score; a
checksum that holds and a context word within ``NEAR`` characters before it
add to it, and proposals that reach ``THRESHOLD`` and do not touch a base span
of their kind are added.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
THRESHOLD = 0.6
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
#: Step of the running sum that gives matches their places.
_STEP = 128


@dataclass(frozen=True)
class Proposal:
    kind: str
    pattern: str
    score: float
    check: str = ""          # of the value ``v``, in SQL
    confirms: float = 0.0    # added when the check holds; without it a failed check drops the match
    context: str = ""        # words before the match
    near: float = 0.0        # added when one of them is there
    needs: str = "digit"     # what a text must hold to be searched: digit, at, plus, capital


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})"
_PHONE = f"length({_DIGITS}) BETWEEN 9 AND 15"
# Letters count 10 to 35; the country code and check digits move to the end.
_IBAN = """length(regexp_replace(v, ' ', '')) BETWEEN 15 AND 34 AND aggregate(
  split(concat(substr(regexp_replace(v, ' ', ''), 5), substr(v, 1, 4)), ''), 0,
  (a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + cast(c AS int)) % 97
                 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""

# The possessive quantifiers and look-behinds keep every search linear in the
# text; they match exactly what the plain patterns in the comments match.
BASE = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Proposal("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
             needs="at"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), each part at most 255
    Proposal("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, f"v rlike '^{_PART}([.]{_PART}){{3}}$'",
             context="ip|host|server|address|adresse", near=0.3),
    # [0-9]([\x20-]?[0-9])+ with 13 to 19 digits and a Luhn sum
    Proposal("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, _CARD, context="card|visa|credit|karte|carte|tarjeta", near=0.2),
    # \+[0-9][\x20().0-9-]+[0-9] with 9 to 15 digits
    Proposal("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, _PHONE, needs="plus",
             context="phone|tel|call|mobile|fax|telefon|teléfono|téléphone", near=0.2),
]
MORE = [
    Proposal("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", 0.2, _CARD, 0.5, "card|visa|credit|karte|carte|tarjeta", 0.2),
    Proposal("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", 0.2, _CARD, 0.5),
    Proposal("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
             0.7, _PHONE, needs="plus"),
    Proposal("phone", r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.3,
             context="phone|tel|call|mobile|fax|telefon|teléfono|téléphone", near=0.4),
    Proposal("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
             0.4, _IBAN, 0.4, "iban|account|konto|compte|cuenta", 0.2, needs="capital"),
    Proposal("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", 0.3,
             context="ssn|social security", near=0.4),
]


def _before(sizes: Column) -> Column:
    """For each number of an array, the sum of those before it, in time near
    linear: sums gather in a short array that is appended when full."""
    def step(a, x):
        full = F.size(a["part"]) >= _STEP
        return F.struct(F.when(full, F.concat(a["done"], a["part"])).otherwise(a["done"]).alias("done"),
                        F.when(full, F.array(a["sum"])).otherwise(F.concat(a["part"], F.array(a["sum"]))).alias("part"),
                        (a["sum"] + x).alias("sum"))

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("done"), none.alias("part"), F.lit(0).alias("sum"))
    return F.aggregate(sizes, start, step, lambda a: F.concat(a["done"], a["part"]))


def _matches(df: DataFrame, text: str, names: list[str], proposals: list[Proposal]) -> DataFrame:
    """Adds, under each name, the pattern's matches as (start, end, v), leftmost
    first: the pieces between the matches and the matches give the places."""
    needs = {"at": F.contains(text, F.lit("@")), "plus": F.contains(text, F.lit("+")),
             "digit": F.col(text).rlike("[0-9]"), "capital": F.col(text).rlike("[A-Z]{2}[0-9]{2}")}
    text_ = F.col(text)
    flags = {k: f"__has_{k}" for k in sorted({p.needs for p in proposals})}
    df = df.select("*", *[needs[k].alias(v) for k, v in flags.items()])
    none = F.array().cast("array<string>")
    found = [F.when(F.col(flags[p.needs]), F.regexp_extract_all(text_, F.lit(p.pattern), 0)).otherwise(none).alias(f"__m{n}")
             for n, p in zip(names, proposals)]
    df = df.select("*", *found).drop(*flags.values())
    sized = []
    for n, p in zip(names, proposals):
        m = F.col(f"__m{n}")
        pieces = F.split(text_, p.pattern, -1)
        both = F.zip_with(pieces, m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
        # the end of match i is the sum of the pieces and matches up to it
        ends = F.slice(_before(F.concat(both, F.array(F.lit(0)))), 2, F.size(m))
        sized.append(F.when(F.size(m) > 0, F.zip_with(ends, m, lambda e, v: F.struct(
            (e - F.length(v)).alias("start"), e.alias("end"), v.alias("v"))))
            .otherwise(F.array().cast("array<struct<start:int,end:int,v:string>>")).alias(n))
    return df.select("*", *sized).drop(*[f"__m{n}" for n in names])



def _scored(name: str, p: Proposal, text: str, base: bool) -> Column:
    """Spans (kind, start, end, score) of proposal ``p`` that stay."""
    check = p.check or "true"
    near = "0D" if not p.context else (
        f"if(lower(substring({text}, greatest(s.start - {NEAR}, 0) + 1, s.start - greatest(s.start - {NEAR}, 0))) "
        f"rlike '(?<![a-z])({p.context})', {p.near}D, 0D)")
    rows = (f"transform({name}, s -> named_struct('kind', '{p.kind}', 'start', s.start, 'end', s.end, "
            f"'ok', transform(array(s.v), v -> {check})[0], 'near', {near}))")
    keep = "r.ok" if not p.confirms else "true"
    score = f"{p.score}D + r.near + if(r.ok, {p.confirms}D, 0D)"
    limit = "" if base else f" AND {score} >= {THRESHOLD}D"
    return F.expr(f"transform(filter({rows}, r -> {keep}{limit}), r -> named_struct('kind', r.kind, 'start', r.start, "
                  f"'end', r.end, 'score', least(1D, {score})))")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with two array columns of (kind, start, end, score): ``base``
    (matches of the base patterns whose check holds) and ``spans`` (those and
    what the narrower patterns add), both by kind as in ``KINDS``, then start.
    A null or empty text has no spans.  Columns of ``docs`` with these two
    names are replaced, all others are left as they are."""
    # the row travels as one column, so that no name of it meets one of ours
    t, kept = "__text", [c for c in docs.columns if c not in ("base", "spans")]
    df = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in kept]).alias("__row"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(t))
    both = BASE + MORE
    names = [f"__p{i}" for i in range(len(both))]
    df = _matches(df, t, names, both)
    scored = [_scored(n, p, t, i < len(BASE)).alias(f"__s{i}") for i, (n, p) in enumerate(zip(names, both))]
    df = df.select("*", *scored).drop(*names)
    df = df.withColumn("base", F.concat(*[f"__s{i}" for i in range(len(BASE))]))
    by_kind: dict[str, list[str]] = {k: [] for k in KINDS}
    for i, p in enumerate(both):
        by_kind[p.kind].append(f"__s{i}")
    parts = []
    for kind, cols in by_kind.items():
        # earlier patterns of a kind win over later ones that touch them
        got = cols[0]
        for c in cols[1:]:
            free = f"filter({c}, x -> NOT exists({got}, y -> x.start < y.end AND y.start < x.end))"
            got = f"concat({got}, {free})"
        parts.append(F.expr(f"array_sort({got}, (a, b) -> a.start - b.start)"))
    df = df.withColumn("spans", F.concat(*parts))
    return df.select(*[F.col("__row").getField(c).alias(c) for c in kept], "base", "spans")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` in ``text_col`` replaced by its
    kind in angle brackets (spans that touch are one, named by the first).
    Null texts stay null; columns are those of ``docs``."""
    found = find_pii(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                                 F.col(text_col).cast("string").alias("__body")), "__body")
    merged = F.expr("""
      aggregate(array_sort(spans, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END),
        cast(array() AS array<struct<kind:string,start:int,end:int>>),
        (acc, s) -> CASE
          WHEN size(acc) = 0 OR element_at(acc, -1).end <= s.start
            THEN concat(acc, array(named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))
          ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('kind', element_at(acc, -1).kind,
            'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) END)""")
    found = found.withColumn("__cut", merged)
    found = found.withColumn("__from", F.expr("concat(array(0), transform(__cut, x -> x.end))"))
    text = F.col("__body")
    pieces = F.zip_with(F.col("__from"), F.col("__cut"), lambda a, s: F.when(
        s.isNotNull(), F.concat(F.substring(text, a + 1, s["start"] - a), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        .otherwise(F.substring(text, a + 1, F.length(text))))
    masked = F.when(F.size("__cut") > 0, F.array_join(pieces, "")).otherwise(text)
    return found.select(*[masked.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns])
