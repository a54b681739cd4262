"""Operator 4: URL filters.

A short rule table decides the urls it fits. Gradient-boosted trees on lexical features decide the rest; they are trained
on the urls that the rules decide, at most `sample_urls` of them (the first by a hash of key and url; rows that are
alike count once). Features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of the host's last one,
two and three labels over all urls: how many urls have them, and the share of blocked ones among those that rules decide.
A share leans on that of the shorter suffix where there are few, and a labelled url's own share leaves out all urls of
its fold of hosts, so that the trees see suffixes as they will meet them: without the label of the url or of its host.

Common suffixes are few and are joined by broadcasting their statistics (`meet`); all others are joined by a shuffle.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule and is judged by
the trees on zero features; if the labelled urls all have one verdict, or there are none, that verdict
(allow if none) holds for the rest; repeated rows and null keys are judged one by one; very long urls are read whole; of
rules that fit, the longest decides, of equally long ones the one that the table has last; extra columns of any name take no
part; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, mark_of, meet, sample_cutoff

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def rest_of(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "\\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "\\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (name, verdict); null if none does."""
    out = F.lit(None).cast("struct<name string, verdict string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, one: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the letters, digits and (as one class) other characters of a text."""
    low = F.translate(text, UPPER, LOWER)
    n = F.greatest(F.length(low), F.lit(1)).cast("double")
    counts = [_count(low, c) for c in LOWER + "0123456789"]
    others = F.length(F.regexp_replace(low, "[a-z0-9]+", "")).cast("double")
    terms = F.lit(0.0)
    for c in [*counts, others]:
        terms = terms - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
    return terms


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    return {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "labels": _count(host, "."),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]+", "")) / n,
        "hyphens": _count(host, "-"),
        "parameters": F.when(F.instr(u, "?") > 0, _count(u, "&") + 1).otherwise(0.0),
        "has_fragment": (F.instr(u, "#") > 0).cast("double"),
        "secure": u.startswith("https://").cast("double"),
        "entropy": entropy(u),
        "host_entropy": entropy(host),
    }


#: Folds of hosts, and how many urls the shorter suffix's share counts for.
FOLDS, STRENGTH = 5, 20.0
SUFFIXES = (1, 2, 3)


def host_statistics(base: DataFrame, total: int, share: float) -> DataFrame:
    """host, urls and, for each suffix length k: common{k}, share{k} and known_share{k}, the share for a labelled url of the host.

    base: host, fold and label. All is worked out over distinct hosts, so a host that very many urls have is one row.
    share: the share of blocked urls in the whole table, on which that of the shortest suffix leans.
    """
    hosts = cut(base.groupBy("host", "fold").agg(F.count("*").alias("urls"), F.count("label").cast("double").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")))
    n, kept = hosts.count(), ["host", "fold", "urls", "known", "blocked"]
    before = {"share": F.lit(share), "known_share": F.lit(share)}
    for labels in SUFFIXES:
        here = F.substring_index("host", ".", -labels)
        in_fold = lambda what: F.array(*[F.sum(F.when(F.col("fold") == k, F.col(what)).otherwise(0.0)) for k in range(FOLDS)])
        found = hosts.groupBy(here.alias("suffix")).agg(F.sum("urls").alias("all_urls"), F.count("*").alias("hosts"), in_fold("known").alias("known_in"), in_fold("blocked").alias("blocked_in"))
        met = meet(hosts.withColumn("suffix", here), found, "suffix", F.col("hosts") * HOT_KEYS > n)
        whole = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        others = lambda xs: whole(xs) - F.get(xs, F.col("fold"))
        leaning = lambda part, prior: (part(F.col("blocked_in")) + prior * STRENGTH) / (part(F.col("known_in")) + STRENGTH)
        made = {f"share{labels}": leaning(whole, before["share"]), f"known_share{labels}": leaning(others, before["known_share"]), f"common{labels}": F.log1p(F.col("all_urls") / total)}
        hosts = cut(met.select(*kept, *[c.alias(k) for k, c in made.items()]))
        kept += made
        before = {k: F.col(f"{k}{labels}") for k in before}
    return hosts.drop("fold", "known", "blocked")


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, sample_urls: int = 20_000, trees: int = 12, depth: int = 4, only: tuple[str, ...] | None = None) -> DataFrame:
    """key, host, path, rule, verdict and blocked_score (null where a rule decides), a row per row of pages.

    only: the features that the trees may use, to measure what others add; all if null.
    """
    u = F.col(f"`{url}`").cast("string")
    base = pages.select(F.col(f"`{key}`").alias("id"), u.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    base = base.select("id", mark_of(F.col("id"), F.col("url")).alias("mark"), "host", "path", F.col("hit.name").alias("rule"), F.col("hit.verdict").alias("known"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"), *[c.alias(k) for k, c in features.items()])
    base = cut(base.withColumn("label", F.when(F.col("known").isNotNull(), (F.col("known") == "block").cast("double"))))
    total, n, blocked = base.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    if not n or blocked in (0, n):
        rest = F.lit("block" if n and blocked == n else "allow")
        return base.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("known", rest).alias("verdict"), F.lit(None).cast("double").alias("blocked_score"))
    hosts = host_statistics(base, total, blocked / n)
    base = meet(base, hosts, "host", F.col("urls") * HOT_KEYS > total)
    base = base.withColumns({f"share{k}": F.when(F.col("label").isNotNull(), F.col(f"known_share{k}")).otherwise(F.col(f"share{k}")) for k in SUFFIXES})
    inputs = [*features, *(f"{what}{labels}" for labels in SUFFIXES for what in ("share", "common"))]
    inputs = [i for i in inputs if only is None or i in only]
    base = cut(VectorAssembler(inputCols=inputs, outputCol="features").transform(base).select("id", "mark", "host", "path", "rule", "known", "label", "features"))
    labelled = base.filter("label is not null")
    last = sample_cutoff(labelled.select("mark"), sample_urls)
    sample = labelled.filter(F.col("mark") <= F.lit(last)).groupBy("mark").agg(F.first("features").alias("features"), F.first("label").alias("label"))
    # The trees draw by row order, so that order is fixed; at most sample_urls rows.
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=3, cacheNodeIds=False).fit(cut(sample.orderBy("mark")))
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(base).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return judged.select(
        F.col("id").alias(key), "host", "path", "rule",
        F.coalesce("known", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("known").isNull(), F.col("p")).alias("blocked_score"),
    )
