"""URL filters with redirect equivalence, as DataFrame functions only.

Rules (host, path, verdict) fit their host and its subdomains where the path
begins with the rule's; the longest that fits a url decides it.  A url without
a rule may be an alias: canonical links and refresh redirects declared by the
pages are edges between urls, connected components over them are found by
joins, and an alias of a blocked url is blocked.  A url that a rule allows
stays allowed, whatever its aliases are.  What stands in comments, scripts and
other raw text declares nothing.

Rules are met by equality joins - each suffix of a host against the hosts of
the rules, then each prefix of the path whose length such a rule has - so a
block list may be as long as it likes.  A short list is broadcast; of a long
one the hosts that very many urls have are (``join_split``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.components import connected_components
from textmill.operators.headtail import join_split
from textmill.session import barrier, small_enough

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not tell pages apart.
TRACKING = "utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid"
#: Elements whose inside is no mark-up of the page, and comments; the last may be left open.
RAW = "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{tag}[\s/>].*?(?:</{tag}\s*>|\z)" for tag in (
    "script", "style", "textarea", "title", "template", "iframe", "xmp", "noembed", "noframes"))])
_TAG = r"(?i)<{}[\s/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: Rules up to this number are broadcast, if their bytes allow it.
MAX_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty where there is no ``://`` or the url is null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def alias_key(url: Column) -> Column:
    """A url without scheme, fragment and tracking parameters, its host in
    lower case: urls with one key are one page."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~p.rlike(f"^(?:{TRACKING})(?:=|$)") & (p != "")), "&")
    whole = F.concat(F.lit("//"), host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole).otherwise(url)


def _attribute(tag: Column, name: str) -> Column:
    value = rf"(?i)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])


def _decoded(t: Column) -> Column:
    """Numeric character references, and the named ones of mark-up."""
    refs = F.array_distinct(F.regexp_extract_all(t, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?"), F.lit(0)))
    digits = lambda r: F.regexp_extract(r, "([0-9a-fA-F]+);?$", 1)
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.upper(digits(r))).otherwise(F.conv(digits(r), 10, 16))
    char = lambda r: F.decode(F.unhex(F.lpad(code(r), 8, "0")), "UTF-32")
    t = F.aggregate(refs, t, lambda s, r: F.replace(s, r, char(r)))
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def _no_dots(target: Column) -> Column:
    """An absolute url without the segments ``.`` and ``..`` of its path."""
    path = path_of(target)
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    ends = path.rlike(r"/\.\.?$")
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))
    head = F.regexp_extract(target, "^([^:]*://[^/?#]*)", 1)
    rest = F.substring(target, F.length(head) + F.length(path) + 1, F.length(target))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(head, clean, rest)).otherwise(target)


def declared_targets(html: Column, url: Column) -> Column:
    """Array of absolute urls that a page names as its canonical address or
    refreshes to: link elements whose rel holds the word canonical, meta
    elements whose http-equiv is refresh, both outside comments and raw text.
    Character references are decoded, relative addresses resolved against the
    page's url (a base element is not looked at), dot segments removed."""
    any_ = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    plain = F.regexp_replace(html, f"(?is){RAW}", " ")
    tags = lambda name: F.regexp_extract_all(plain, F.lit(_TAG.format(name)), F.lit(0))
    links = F.transform(F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(F.btrim(_attribute(t, "rel"))), r"\s+"),
                                                                        "canonical")), lambda t: _attribute(t, "href"))
    metas = F.transform(F.filter(tags("meta"), lambda t: F.lower(F.btrim(_attribute(t, "http-equiv"))) == "refresh"),
                        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)(?:^|[;,\s])\s*url\s*=\s*['\"]?([^\"'>\s]+)", 1))
    found = F.when(any_, F.concat(links, metas)).otherwise(F.array().cast("array<string>"))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), "^[^/?#]*", 0))
    folder = F.concat(root, F.regexp_replace(F.concat(path_of(url), F.lit("")), "[^/]*$", ""))

    def absolute(t: Column) -> Column:
        t = F.btrim(_decoded(t))
        return F.when((t == "") | t.startswith("#"), F.lit(None)).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t) \
            .when(F.instr(url, "://") <= 0, F.lit(None)) \
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)) \
            .when(t.startswith("/"), F.concat(root, t)) \
            .when(t.startswith("?"), F.concat(root, path_of(url), t)) \
            .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), t))

    there = F.filter(F.transform(found, absolute), lambda t: t.isNotNull())
    return F.transform(there, _no_dots)


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, ruled) for the distinct ``url`` that some rule fits: the
    longest rule as text (host and path) and its verdict.  Of equally long
    ones an allow goes first, then the smaller text."""
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
                     F.lower("verdict").alias("ruled")).where("r_host <> ''")
    lengths = r.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    u = urls.select("url").where("url IS NOT NULL").distinct() \
        .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).where("host <> ''")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(F.split(F.col("host"), r"\.", -1), i, F.lit(1 << 30)), "."))
    few = small_enough(r, MAX_RULES)
    near = u.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("r_host"))
    near = near.join(F.broadcast(lengths), "r_host") if few else join_split(barrier(near), barrier(lengths), "r_host")
    near = near.select("url", "path", "r_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n")) \
        .withColumn("r_path", F.expr("substring(path, 1, n)"))
    rule = F.concat("r_host", "r_path")
    if few:
        fits = near.join(F.broadcast(r), ["r_host", "r_path"])
    else:  # a rule may stand in the list twice
        key = F.struct("r_host", "r_path").alias("key")
        lists = barrier(r.groupBy(key).agg(F.collect_set("ruled").alias("verdicts")))
        fits = join_split(barrier(near.select("url", key)), lists, "key").select(
            "url", "key.r_host", "key.r_path", F.explode("verdicts").alias("ruled"))
    best = fits.groupBy("url").agg(F.min(F.struct(
        (-F.length(rule)).alias("n"), F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("o"), rule.alias("rule"),
        "ruled")).alias("best"))
    return best.select("url", "best.rule", "best.ruled")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html",
               keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``pages``: ``keep`` (all its columns by default),
    host, path, rule (the longest that fits, else null) and verdict: that of
    the rule, else block if the url shares a component of canonical links and
    redirects with a url that a rule blocks, else allow.

    Null urls and urls without ``://`` have an empty host and path and no
    rule; a null page declares nothing.  Repeated urls are judged alike.
    Columns of ``pages`` named as the result's are replaced.
    """
    keep = [c for c in (keep or pages.columns) if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col).cast("string")
    plain = pages.select(url.alias("url"), F.col(html_col).cast("string").alias("html")).where("url IS NOT NULL")
    declared = plain.withColumn("targets", declared_targets(F.col("html"), F.col("url"))) \
        .select("url", F.explode("targets").alias("target"))
    declared = barrier(declared.select(
        "url", "target", alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b")).distinct())
    urls = pages.select(url.alias("url")).unionByName(declared.select(F.col("target").alias("url"))).distinct()
    ruled = barrier(longest_rules(urls, rules))
    # what a block spreads to: its alias key, and the keys of the key's component
    parts = connected_components(declared, "a", "b")
    blocked = ruled.where("ruled = 'block'").select(alias_key(F.col("url")).alias("node")).distinct()
    bad = blocked.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
    spread = bad.join(parts, "component", "left").select(F.coalesce("node", "component").alias("alias")) \
        .distinct().withColumn("spread", F.lit(True))
    left = pages.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in keep]).alias("row"), url.alias("u"),
                        alias_key(url).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    out = left.join(ruled, F.col("u") == F.col("url"), "left").join(spread, F.col("key") == F.col("alias"), "left")
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("spread"), F.lit("block")), F.lit("allow"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "host", "path", "rule", verdict.alias("verdict"))
