"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share of all words by weight,
but at most ``cap`` times its own; what a capped source leaves is shared out
again.  Inside a source a document is wanted ``pi`` times, a number that falls
gently with its length and whose words add up to the target.  Its whole part
is taken for certain; the fractions are inclusion probabilities p of a
Pareto order sample: documents are ranked by their random odds over their
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order up to
the size, in words, that is still missing.

The ranking is never sorted as a whole: counts of words in 65,536 buckets of
the rank tell the bucket where the target falls, and only its rows are put in
order.  What comes out are a few numbers a source, so that a document is
decided on its own row, whichever task holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.rank import global_rank
from textmill.session import barrier

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 97
#: Exponent by which a document's wanted copies fall with its length.
TILT = 0.25
#: Bits of the rank, and how many of them make its buckets.
BITS, LEVEL = 48, 16
#: Sources that every task may hold; more are joined by a shuffle.
SMALL_SOURCES = 50_000
_LOW = -(1 << 63)


def word_count(text: Column) -> Column:
    """Number of runs without the six ASCII white spaces (null: 0)."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size): sources in code
    point order, null last, weigh ``weights`` in turn."""
    totals = barrier(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = global_rank(totals, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    t = barrier(order.select("source", "source_size", weight.alias("w")))
    rate, capped = 0.0, -1
    while True:  # the capped sources only grow in number
        over = F.col("source_size") * cap < F.col("w") * F.lit(rate)
        r = t.agg(F.sum("source_size"), F.sum(F.when(over, F.col("source_size") * cap).otherwise(0.0)),
                  F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.sum(over.cast("long"))).first()
        if r[0] is None or r[3] == capped or not r[2]:
            break
        capped, rate = r[3], (r[0] - r[1]) / r[2]
    return t.select("source", "source_size", F.least(F.col("source_size") * cap, F.col("w") * F.lit(rate)).alias("target"))


def _with(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """``df`` with the columns of ``by_source`` (materialised, a row a source)."""
    right = by_source.withColumnRenamed("source", "__source")
    if by_source.count() <= SMALL_SOURCES:
        right = F.broadcast(right)
    return df.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _wanted(scale: Column, size: Column, cap: float) -> Column:
    return F.when(size > 0, F.least(F.lit(cap), scale * F.pow(size, F.lit(-TILT)))).otherwise(0.0)


def _scales(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Adds ``scale`` - wanted copies are least(cap, scale * size ** -TILT) -
    and ``need``, the words that certain copies leave missing.  Short documents
    reach the cap first: for each size of a source, the scale if all shorter
    ones are capped; the first size that it leaves uncapped is the answer.  A
    source's window holds its distinct sizes, not its documents."""
    x = F.pow("size", F.lit(-TILT))
    table = _with(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), targets)
    words = F.col("n") * F.col("size")
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy("size").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum(words * cap).over(up), F.lit(0.0))
    table = table.withColumn("c", F.greatest(F.col("target") - full, F.lit(0.0)) / F.sum(x * words).over(rest))
    fits = (F.col("c") * x < cap) & (F.col("target") < F.col("source_size") * cap)
    scale = table.groupBy("source").agg(F.min(F.when(fits, F.struct("size", "c"))).getField("c").alias("found"))
    scaled = barrier(_with(targets, barrier(scale)).select(*targets.columns, F.coalesce("found", F.lit(1e12)).alias("scale")))
    whole = F.floor(_wanted(F.col("scale"), F.col("size"), cap))
    certain = _with(table.select("source", "size", "n"), scaled).groupBy("source") \
        .agg(F.sum(whole * words).alias("certain"))
    return barrier(_with(scaled, barrier(certain)).select(
        *scaled.columns, F.greatest(F.col("target") - F.coalesce("certain", F.lit(0)), F.lit(0.0)).alias("need")))


def _rank_key(u: Column, p: Column) -> Column:
    """The odds ratio q as an integer that orders alike: q / (1 + q) in bits."""
    v = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    return F.least(F.floor(v * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1)).cast("long")


def _decided(df: DataFrame, id_col: str, cap: float, seed: int) -> DataFrame:
    """Adds __whole (certain copies), __p, __key and __id from scale and size."""
    pi = _wanted(F.col("scale"), F.col("size"), cap)
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    df = df.withColumn("__pi", pi).withColumn("__whole", F.floor("__pi")).withColumn("__p", F.col("__pi") - F.col("__whole"))
    return df.withColumn("__key", F.when(F.col("__p") > 0, _rank_key(u, F.col("__p")))) \
        .withColumn("__id", F.coalesce(F.col(id_col), F.lit(_LOW)))


def mix_plan(sizes: DataFrame, id_col: str = "doc_id", weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """What the mix decides, a row a source, from rows (id, source, size):
    source_size, target, scale, the place in the rank up to which a further
    copy is taken (cut_key, cut_id, cut_size; words up to there do not exceed
    the target), and one place beyond it (more_key, more_id, more_size) whose
    words fill the gap best, if any does."""
    plan = _scales(sizes, barrier(source_targets(sizes, weights, cap)), cap)
    # rows that share id and size share their place, and are taken together
    rows = _decided(_with(sizes.where("size > 0"), plan), id_col, cap, seed).where("__p > 0") \
        .groupBy("source", "__key", "__id", "size").agg(F.sum("size").alias("words"))
    rows = barrier(rows.withColumn("__b", F.shiftright("__key", BITS - LEVEL)))
    sums = rows.groupBy("source", "__b").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("__b"))  # 2 ** LEVEL rows a source at most
    over = _with(sums.withColumn("upto", upto), plan.select("source", "need")).where("upto > need")
    first = barrier(over.groupBy("source").agg(F.min(F.struct("__b", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
                    .select("source", F.col("at.__b").alias("bucket"), F.col("at.before").alias("before")))
    inside = _with(_with(rows, first).where("__b = bucket"), plan.select("source", "need"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("__key", "__id", "size"))
    last = barrier(inside.withColumn("upto", upto).where("upto <= need").groupBy("source")
                   .agg(F.max(F.struct("upto", "__key", "__id", "size")).alias("c")))
    everything = F.when(F.col("bucket").isNull(), F.lit(1 << BITS))
    state = _with(_with(plan, first), last).select(
        "source", "source_size", "target", "scale",
        F.coalesce(everything, "c.__key", F.shiftleft("bucket", BITS - LEVEL)).alias("cut_key"),
        F.coalesce("c.__id", F.lit(_LOW)).alias("cut_id"), F.coalesce("c.size", F.lit(-1).cast("long")).alias("cut_size"),
        (F.col("need") - F.coalesce("c.upto", "before")).alias("gap"))
    state = barrier(state)
    off = F.abs(F.col("words") - F.col("gap"))
    beyond = _with(rows, state).where(~_before() & (off < F.col("gap")))
    best = barrier(beyond.groupBy("source").agg(F.min(F.struct(off.alias("off"), "__key", "__id", "size")).alias("m")))
    return barrier(_with(state, best).select(
        *[c for c in state.columns if c != "gap"], F.col("m.__key").alias("more_key"), F.col("m.__id").alias("more_id"),
        F.col("m.size").alias("more_size")))


def _before() -> Column:
    """Whether a row's place in the rank is not beyond its source's cut."""
    at = F.struct(F.col("__key").alias("k"), F.col("__id").alias("i"), F.col("size").alias("s"))
    return at <= F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("i"), F.col("cut_size").alias("s"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        cap: float = CAP, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (its id by default), size,
    source_size, target and copies (how often the mix takes it, ``cap`` times
    at most).  ``weights`` are dealt to the sources in code point order, null
    last; a null source is a source.

    Texts without words (null or empty) have size 0 and no copies.  The draw
    depends on the id and the seed alone, so reruns agree; rows with the same
    id and size share it, and rows with a null id are drawn together.  A
    source's words miss its target by less than one document, or by such
    repeated rows.  An empty table gives no rows.
    """
    keep = keep or [id_col]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(id_col).cast("long").alias("__doc"),
                        F.col(source_col).cast("string").alias("source"),
                        word_count(F.col(text_col).cast("string")).alias("size"))
    if keep == [id_col]:  # small rows: the texts are read once
        named = barrier(named)
        sizes = named.select("__doc", "source", "size")
    else:
        sizes = barrier(named.select("__doc", "source", "size"))
    plan = mix_plan(sizes, "__doc", weights, cap, seed)
    rows = _decided(_with(named, plan), "__doc", cap, seed)
    filler = (F.col("__key") == F.col("more_key")) & (F.col("__id") == F.col("more_id")) & (F.col("size") == F.col("more_size"))
    more = F.col("__key").isNotNull() & (_before() | filler)
    copies = (F.col("__whole") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in keep], "size", "source_size", "target",
                       copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the
    columns of ``docs``."""
    cols = docs.columns
    # columns may be named as those that mix() adds
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__all"),
                         *[F.col(options.get(k, d)).alias(f"__{d}") for k, d in
                           (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))])
    rest = {k: v for k, v in options.items() if k not in ("id_col", "text_col", "source_col")}
    got = mix(packed, "__doc_id", "__text", "__source", keep=["__all"], **rest)
    got = got.where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select(*[F.col("__all").getField(c).alias(c) for c in cols])
