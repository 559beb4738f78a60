"""Quality rules by distribution divergence, as DataFrame functions only.

A document's histogram of character classes and its histogram of the common
words of each language are compared with the language's references by
Jensen-Shannon distance; a document passes if some language is near in both.
References are the median histograms of the whole corpus by language (a few
numbers a language, gathered in one aggregate).  A language without a list
here gets its common words from the corpus, by counts over all its texts, and
its reference judges the texts of that language only.  Short texts have no stable
histogram: below the guards a distance counts as 0.  Plain counts (symbols,
repeated lines, repeated windows of words) come from the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common function words, as any grammar lists them.
COMMON_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be at or from".split(),
    "fr": "le la les de des du et en un une est que qui dans par pour sur au avec ce".split(),
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch".split(),
    "es": "el la los las de del que y en un una por con no para es al lo como su".split(),
}
#: Texts with fewer words, and with fewer characters in words, are not judged
#: by their words and by their characters.
MIN_WORDS, MIN_CHARS = 40, 120
#: Distances beyond which a text is unlike a language: a limit for long texts
#: and what the square root of the number of words divides, for the noise of
#: short ones.
CHARS_LIMIT, WORDS_LIMIT = (0.10, 1.35), (0.22, 1.0)
#: Words that the corpus gives for a language without a list above.  Any language,
#: listed or not, has a reference if the corpus has so many long texts of it.
CORPUS_WORDS, MIN_TEXTS = 20, 20
#: Steps in which shares are counted for the references.
STEPS = 2000


def _listed(*spans: tuple[int, int]) -> str:
    """Inner part of a bracket expression, each character by itself: Java looks
    single ones below 256 up in a table and tries ranges in turn."""
    return "".join(f"\\x{c:02X}" for first, last in spans for c in range(first, last + 1))


SPACE = f"[{_listed((0x20, 0x20), (0x09, 0x0D))}]+"
#: Inner parts of bracket expressions.
_CLASSES = {"upper": r"\p{Lu}", "digit": "0-9", "stop": r".,;:'\"()?\-", "symbol": "#*$%&|<>",
            "mark": r"!@_=+~\^\\/{}\[\]"}
#: Plain small letters and white space: in none of the classes.
_PLAIN = f"[{_listed((0x61, 0x7A), (0x20, 0x20), (0x09, 0x0D), (0xDF, 0xFF))}]+"
#: One sign for each common word, to count them in a string.
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_.,:;!?@=(){}[]<>~^*"
#: Short lists, by first character, in which the sign of a word is looked up.
_LISTS = 64


def _signs(more: dict[str, list[str]] | None = None) -> dict[str, str]:
    words = list(dict.fromkeys(w for ws in [*COMMON_WORDS.values(), *(more or {}).values()] for w in ws))
    return {w: _SIGNS[i] if i < len(_SIGNS) else chr(0x20000 + i) for i, w in enumerate(words)}


def corpus_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The most frequent words of each language of ``docs`` that has no list
    above and ``MIN_TEXTS`` texts of ``MIN_WORDS`` words or more."""
    lang = F.col(lang_col).cast("string")
    words = F.filter(F.split(F.col(text_col).cast("string"), SPACE, -1), lambda w: w != "")
    others = docs.where(~lang.isin(*COMMON_WORDS)).select(lang.alias("lang"), words.alias("w"))
    long_enough = others.where(F.size("w") >= MIN_WORDS).groupBy("lang").count().where(F.col("count") >= MIN_TEXTS)
    names = [r["lang"] for r in long_enough.collect()]
    if not names:
        return {}
    counts = others.where(F.col("lang").isin(*names)).select("lang", F.explode("w").alias("w")) \
        .select("lang", F.lower("w").alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")) \
        .groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    out: dict[str, list[str]] = {name: [] for name in sorted(names)}
    for r in counts.withColumn("place", place).where(F.col("place") <= CORPUS_WORDS).orderBy("lang", "place").collect():
        out[r["lang"]].append(r["word"])
    return out


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words: words that lie in a window of five that occurs twice or
    more.  Windows are hashed; only texts with equal windows sort theirs."""
    shifted = [F.slice("__h", i, F.greatest(F.size("__h") - 4, F.lit(0))) for i in range(1, 6)]
    df = df.withColumn("__win", F.transform(F.arrays_zip(*shifted), lambda five: F.xxhash64(five)))
    df = df.withColumn("__twice", F.size(F.array_distinct("__win")) < F.size("__win"))
    placed = F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("__at", F.when(F.col("__twice"), placed).otherwise(none))
    n = F.size("__at")
    gap = F.lit(None).cast("struct<h:bigint,p:int>")
    after = F.concat(F.slice("__at", 2, F.greatest(n - 1, F.lit(0))), F.array(gap))
    before = F.concat(F.array(gap), F.slice("__at", 1, F.greatest(n - 1, F.lit(0))))
    flagged = F.zip_with(F.zip_with("__at", before, lambda x, y: F.struct(x.alias("x"), (x["h"] == y["h"]).alias("b"))),
                         after, lambda s, y: F.when(F.coalesce(s["b"], F.lit(False)) | F.coalesce(
                             s["x"]["h"] == y["h"], F.lit(False)), s["x"]["p"]))
    df = df.withColumn("__pos", F.when(n > 0, F.sort_array(F.filter(flagged, lambda p: p.isNotNull())))
                       .otherwise(F.array().cast("array<int>")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    covered = F.aggregate("__pos", start, lambda a, p: F.struct(
        (a["sum"] + p + 5 - F.greatest(a["end"], p)).alias("sum"), (p + 5).alias("end")), lambda a: a["sum"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("__win", "__twice", "__at", "__pos")


def text_histograms(docs: DataFrame, text_col: str = "text", more: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols (long), ``chars`` (counts
    of the character classes, the rest last) and ``common`` (counts of the
    common words, then of ``more`` words by language); the words stay as
    ``__w``, the text as ``__t``.  A null text counts as empty."""
    df = docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # one pass over the text takes out what is no special character anyway
    few = F.regexp_replace("__t", _PLAIN, "")
    df = df.select("*", F.filter(F.split(F.col("__t"), SPACE, -1), lambda w: w != "").alias("__w"), few.alias("__few"))
    counts = [F.length(F.regexp_replace("__few", f"[^{p}]+", "")).cast("long").alias(f"__{k}")
              for k, p in _CLASSES.items()]
    signs = _signs(more)
    forms = {**signs, **{w.capitalize(): s for w, s in signs.items()}}
    lists: list[list[str]] = [[] for _ in range(_LISTS)]
    for w in forms:
        lists[ord(w[0]) % _LISTS].append(w)
    known = F.array(*[F.array(*map(F.lit, ws)).cast("array<string>") for ws in lists])
    order = F.array(*[F.lit("".join(forms[w] for w in ws)) for ws in lists])

    def sign(w):
        place = F.pmod(F.ascii(w), F.lit(_LISTS))
        return F.substring(F.get(order, place), F.array_position(F.get(known, place), w).cast("int"), F.lit(1))

    marks = F.transform(F.filter("__w", lambda w: w.isin(*forms)), sign)
    df = df.select("*", *counts, F.array_join(marks, "").alias("__marks")) \
        .withColumn("n_words", F.size("__w").cast("long")) \
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long")) \
        .withColumn("n_symbols", F.col("__symbol"))
    listed = len(_signs())
    each = F.array(*[F.length("__marks") - F.length(F.replace(F.col("__marks"), F.lit(s), F.lit("")))
                     for s in list(signs.values())[:listed]])
    if len(signs) > listed:
        each = F.concat(each, F.transform(F.array(*map(F.lit, list(signs.values())[listed:])), lambda s: F.length(
            "__marks") - F.length(F.replace(F.col("__marks"), s, F.lit("")))))
    seen = [F.col(f"__{k}") for k in _CLASSES]
    rest = F.greatest(F.col("word_chars") - sum(seen[1:], seen[0]), F.lit(0))
    return df.withColumn("chars", F.array(*seen, rest).cast("array<double>")) \
        .withColumn("common", each.cast("array<double>")) \
        .drop("__few", "__marks", *[f"__{k}" for k in _CLASSES])


def text_counts(docs: DataFrame, text_col: str = "text", more: dict[str, list[str]] | None = None) -> DataFrame:
    """``text_histograms`` with n_dup_lines and n_repeat_words (long).
    Columns of ``docs`` with these names are replaced."""
    df = text_histograms(docs, text_col, more)
    lines = F.transform(F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    df = df.select("*", lines.alias("__lines"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h")) \
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return _repeated(df).drop("__t", "__w", "__h", "__lines")


def _places(lang: str, more: dict[str, list[str]] | None = None) -> list[int]:
    order = {w: i for i, w in enumerate(_signs(more))}
    return [order[w] for w in COMMON_WORDS.get(lang) or more[lang]]


def language_references(counts: DataFrame, lang_col: str = "lang", more: dict[str, list[str]] | None = None) -> dict[str, tuple]:
    """Median histograms by language, over all texts of the corpus long enough
    to have one: (character classes, common words and the rest).  Medians,
    since a corpus holds junk too; exact ones of shares in steps of 1/``STEPS``,
    from counts by step that the tasks add up.  Languages with fewer than
    ``MIN_TEXTS`` such texts, or without a word list here or in ``more`` (the one
    that ``counts`` were made with), have none; those of ``more`` have their
    words as third item."""
    lang, lists = F.col(lang_col).cast("string"), {**(more or {}), **COMMON_WORDS}
    long_enough = counts.where((F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS)
                               & lang.isin(*lists))
    n_chars = len(_CLASSES) + 1
    shares = F.array(*[F.col("chars")[i] / F.col("word_chars") for i in range(n_chars)])
    own = None
    for name in lists:
        mine = F.array(*[F.col("common")[i] / F.col("n_words") for i in _places(name, more)])
        own = F.when(lang == name, mine) if own is None else own.when(lang == name, mine)
    steps = long_enough.select(lang.alias("lang"), F.posexplode(F.concat(shares, own)).alias("bin", "share")) \
        .groupBy("lang", "bin", F.round(F.col("share") * STEPS).cast("int").alias("step")).count()
    by_bin: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in steps.collect():  # languages x bins x steps at most, whatever the corpus
        by_bin.setdefault((r["lang"], r["bin"]), []).append((r["step"], r["count"]))

    def median(lang_name, i):
        rows = sorted(by_bin[lang_name, i])
        half, seen = sum(n for _, n in rows) / 2, 0
        for step, n in rows:
            seen += n
            if seen >= half:
                return step / STEPS

    out = {}
    for name in sorted({k for k, _ in by_bin}):
        if sum(n for _, n in by_bin[name, 0]) < MIN_TEXTS:
            continue
        bins = [median(name, i) for i in range(n_chars + len(lists[name]))]
        chars, words = bins[:n_chars], bins[n_chars:]
        out[name] = ([c / sum(chars) for c in chars], [*words, max(0.0, 1 - sum(words))],
                     *([] if name in COMMON_WORDS else [lists[name]]))
    return out


def js_distance(p: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram that sums to 1."""
    q = F.array(*[F.lit(float(x)) for x in reference])

    def term(a, b):
        half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        return half(a, b) + half(b, a)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def divergence_rules(docs: DataFrame, references: dict | None = None, text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """``docs`` with the counts of ``text_counts``, js_chars and js_words (of
    the language that is nearest; null without references), base_failed
    (n_words < 10, or 100 * n_repeat_words > 20 * n_words) and kept.

    ``references`` default to those of ``docs`` itself; one of a language that
    ``COMMON_WORDS`` lacks is (characters, words, list of its words) and holds
    for texts of that ``lang_col`` only.  Null and empty texts fail; texts under
    the guards, and texts whose language is given and has no reference (fewer
    than ``MIN_TEXTS`` long texts), are judged by base_failed alone.  Repeated
    rows are judged alike.  Columns of ``docs`` named as the result's are
    replaced, all others stay.
    """
    # the row travels as one column, so that no name of it meets one of ours
    kept = [c for c in docs.columns if c not in RESULTS]
    given = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    inner = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in kept]).alias("__row"),
                        F.col(f"`{text_col}`").cast("string").alias("text"), given.alias("lang"))
    return _judged(inner, references, "text", "lang").select(
        *[F.col("__row").getField(c).alias(c) for c in kept], *RESULTS)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", "kept"]


def _judged(docs: DataFrame, references: dict | None, text_col: str, lang_col: str) -> DataFrame:
    if references is None:
        plain = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        more = corpus_words(plain)
        references = language_references(text_histograms(plain, more=more), more=more)
    more = {lang: r[2] for lang, r in sorted(references.items()) if lang not in COMMON_WORDS}
    given = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    counts = text_counts(docs.withColumn("__lang", given), text_col, more)
    share_c = F.transform("chars", lambda x: x / F.greatest(F.col("word_chars"), F.lit(1)))
    share_w = F.transform("common", lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))
    df = counts.withColumn("__pc", share_c).withColumn("__pw", share_w)
    pairs = []
    for lang, (chars, words, *_) in sorted(references.items()):
        at = [F.col("__pw")[i] for i in _places(lang, more)]
        hist = F.array(*at, F.greatest(1 - sum(at[1:], at[0]), F.lit(0.0)))
        c = F.when(F.col("word_chars") < MIN_CHARS, 0.0).otherwise(js_distance(F.col("__pc"), chars))
        w = F.when(F.col("n_words") < MIN_WORDS, 0.0).otherwise(js_distance(hist, words))
        noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
        pair = F.struct((c / (CHARS_LIMIT[0] + CHARS_LIMIT[1] * noise)).alias("rc"),
                        (w / (WORDS_LIMIT[0] + WORDS_LIMIT[1] * noise)).alias("rw"), c.alias("c"), w.alias("w"))
        pairs.append(F.when(F.col("__lang") == lang, pair) if lang in more else pair)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if not pairs:
        return df.drop("__pc", "__pw", "__lang").withColumn("js_chars", F.lit(None).cast("double")) \
            .withColumn("js_words", F.lit(None).cast("double")).withColumn("base_failed", base) \
            .withColumn("kept", ~F.col("base_failed")).drop("chars", "common")
    df = df.withColumn("__all", F.array(*pairs))
    near = F.array_min(F.transform(F.filter("__all", lambda s: s.isNotNull()), lambda s: F.struct(
        F.greatest(s["rc"], s["rw"]).alias("far"), s["c"].alias("c"), s["w"].alias("w"))))
    df = df.withColumn("__near", near)
    unlike = F.coalesce(F.col("__near")["far"] > 1, F.lit(False)) & F.coalesce(F.col("__lang").isin(*references), F.lit(True))
    return df.withColumn("js_chars", F.col("__near")["c"]).withColumn("js_words", F.col("__near")["w"]) \
        .withColumn("base_failed", base) \
        .withColumn("kept", ~F.col("base_failed") & ~unlike) \
        .drop("__pc", "__pw", "__all", "__near", "__lang", "chars", "common")
