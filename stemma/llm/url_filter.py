"""URL filter: rules by host and path, then gradient-boosted trees on lexical features. DataFrame operations only.

The trees learn from urls that a rule judges. Suffix statistics are of all judged rows; training reads a bounded sample
(SAMPLE distinct urls of least hash, so that a common url counts once), cut into bins, a url's own rows left out of its
suffix's statistic; each level of a tree is one grouped sum of gradients by (node, feature, bin), of which a bounded table comes to
the driver. The model is a sum of CASE expressions, so scoring is part of the scan: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_join, only, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("f_length", "f_host", "f_labels", "f_depth", "f_path", "f_digits", "f_entropy", "f_parameters", "f_hyphens", "f_suffix")
SAMPLE, BINS = 20_000, 16
#: Suffixes, of some 50 bytes each, that are broadcast; more are joined by shuffle.
BROADCAST_SUFFIXES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """pages(url) with host, path and query; all empty where the url is null or has no ://."""
    at = F.instr("url", "://")
    after = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_after", F.coalesce(after, F.lit("")))
    out = out.withColumn("_host", F.regexp_extract("_after", "^[^/?#]*", 0))
    out = out.withColumn("_rest", F.expr("substr(_after, length(_host) + 1)"))
    out = out.withColumns({"host": F.translate("_host", _UPPER, _LOWER), "path": F.regexp_extract("_rest", "^[^?#]*", 0), "query": F.regexp_extract("_rest", "\\?([^#]*)", 1)})
    return out.drop("_after", "_host", "_rest")


def fits(host: str, path: str) -> Column:
    """Whether a rule fits: its host or a subdomain of it, and a path that starts with the rule's."""
    return ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(host, path) with rule and ruling: those of the longest rule that fits, or null."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        rule, ruling = F.when(fits(host, path), host + path).otherwise(rule), F.when(fits(host, path), verdict).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def _count(text: str, what: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(what), F.lit("")))


def features(pages: DataFrame) -> DataFrame:
    """pages(url, host, path, query) with the lexical features but for the suffix's, and the suffix itself."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    seen = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    return pages.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_labels": _count("host", ".").cast("double"),
        "f_depth": _count("path", "/").cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]+", "")) / size,
        "f_entropy": F.aggregate(seen, F.lit(0.0), lambda a, p: a - p * F.ln(p)),
        "f_parameters": F.when(F.col("query") == "", 0.0).otherwise(_count("query", "&") + 1.0),
        "f_hyphens": _count("host", "-").cast("double"),
        "suffix": F.substring_index(F.substring_index(F.regexp_replace("host", ":[0-9]*$", ""), ".", -1), ":", -1),
    })


@dataclass
class Forest:
    """prior: log odds of block; suffixes: log odds by suffix; trees: nested (feature, limit, left, right) or leaf value."""

    prior: float
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        """The log odds of block as an expression over FEATURES."""
        total = F.lit(self.prior)
        for t in self.trees:
            total = total + _value(t)
        return total


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, limit, left, right = tree
    return F.when(F.col(name) <= limit, _value(left)).otherwise(_value(right))


def _node(tree, at: int = 1) -> Column:
    """The number of the leaf a row falls in: the root is 1, children of n are 2 n and 2 n + 1."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    name, limit, left, right = tree
    return F.when(F.col(name) <= limit, _node(left, 2 * at)).otherwise(_node(right, 2 * at + 1))


def _grown(tree, splits: dict[int, tuple[str, float]], at: int = 1):
    if isinstance(tree, tuple):
        return (*tree[:2], _grown(tree[2], splits, 2 * at), _grown(tree[3], splits, 2 * at + 1))
    return (*splits[at], 0.0, 0.0) if at in splits else tree


def _leaves(tree, values: dict[int, float], at: int = 1):
    if isinstance(tree, tuple):
        return (*tree[:2], _leaves(tree[2], values, 2 * at), _leaves(tree[3], values, 2 * at + 1))
    return values.get(at, 0.0)


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the feature's value."""
    return F.size(F.filter(F.lit(list(cuts)), lambda c: c < F.col(name)))


def boosted(rows: DataFrame, n_trees: int = 12, depth: int = 2, rate: float = 0.4, smooth: float = 1.0) -> Forest:
    """Fit to rows(FEATURES, y 0.0 or 1.0), a bounded sample in one partition. Without both classes, the prior alone."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).first()
    forest = Forest(math.log((n.y + 1) / (n.n - n.y + 1)))
    if n.y in (0, n.n):
        return forest
    cuts = rows.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000))).alias(f) for f in FEATURES]).first()
    each = F.array(*[F.struct(F.lit(f).alias("feature"), _bin(f, cuts[f]).alias("bin")) for f in FEATURES])
    rows = written(rows.withColumns({"bins": each, "margin": F.lit(forest.prior)}), "sample").coalesce(1)
    for _ in range(n_trees):
        tree = 0.0
        p = 1 / (1 + F.exp(-F.col("margin")))
        now = rows.withColumns({"g": F.col("y") - p, "h": p * (1 - p)})
        for _ in range(depth):
            sums = now.withColumn("node", _node(tree)).select("node", F.explode("bins").alias("b"), "g", "h").groupBy("node", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            tree = _grown(tree, _best_splits(sums, cuts, smooth))
        leaf = now.groupBy(_node(tree).alias("node")).agg((rate * F.sum("g") / (F.sum("h") + smooth)).alias("v")).collect()
        forest.trees.append(_leaves(tree, {r.node: r.v for r in leaf}))
        rows = rows.withColumn("margin", F.col("margin") + _value(forest.trees[-1]))
    return forest


def _best_splits(sums, cuts, smooth: float) -> dict[int, tuple[str, float]]:
    """For each node the split of largest gain, ties to the first feature and limit; none without gain."""
    out: dict[int, tuple[float, str, float]] = {}
    by: dict[tuple[int, str], dict[int, tuple[float, float]]] = {}
    for r in sums:
        by.setdefault((r.node, r.feature), {})[r.bin] = (r.g, r.h)
    for (node, name), bins in sorted(by.items()):
        g, h = (math.fsum(x[i] for x in bins.values()) for i in (0, 1))
        gl = hl = 0.0
        for b in range(len(cuts[name])):
            gl, hl = gl + bins.get(b, (0, 0))[0], hl + bins.get(b, (0, 0))[1]
            gain = gl**2 / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g**2 / (h + smooth)
            if gain > 1e-6 and gain > out.get(node, (0.0,))[0] + 1e-12:
                out[node] = (gain, name, cuts[name][b])
    return {node: best[1:] for node, best in out.items()}


def _log_odds(k: Column, n: Column, share: float, smooth: float) -> Column:
    """Smoothed log odds of k out of n."""
    return F.ln((k + smooth * share) / (n - k + smooth * (1 - share)))


def filtered(pages: DataFrame, rules=RULES, sample: int = SAMPLE, smooth: float = 5.0) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict and score (log odds of block): one row per row.

    verdict is the rule's where one fits, else the model's. A null url, and one without ://, has an empty host and
    path, fits no rule and goes to the model. Without a judged url of each kind the model is the smoothed share of
    blocked ones; with none at all every other url is allowed. Repeated rows are each judged; an empty table gives an
    empty table; other columns are ignored. The fit reads at most `sample` distinct judged urls, those of least hash,
    and suffix statistics of all judged rows; a suffix without one has the share of all.
    """
    pages = only(pages, "page_id", "url")
    known = features(ruled(parts(pages), rules))
    y = F.when(F.col("ruling") == "block", 1.0).otherwise(0.0)
    told = ruled(parts(pages), rules).where(F.col("ruling").isNotNull())
    suffixes = written(features(told).withColumn("y", y).groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.sum("y").alias("suffix_k")), "suffixes")
    every = suffixes.agg(F.count("*").alias("suffixes"), F.coalesce(F.sum("suffix_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("suffix_k"), F.lit(0.0)).alias("k")).first()
    share = (every.k + 1) / (every.n + 2) if every.n else 0.5 - 1e-9
    prior = math.log(share / (1 - share))

    def with_suffix(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(suffixes), "suffix", "left") if every.suffixes <= BROADCAST_SUFFIXES else heavy_join(rows, suffixes, "suffix", "url", how="left")

    urls = told.groupBy("url").agg(F.count("*").alias("w")).orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = with_suffix(features(ruled(parts(urls), rules)).withColumn("y", y))
    rows = rows.withColumn("f_suffix", _log_odds(F.col("suffix_k") - F.col("w") * F.col("y"), F.col("suffix_n") - F.col("w"), share, smooth))
    model = boosted(written(rows.select(*FEATURES, "y"), "judged").coalesce(1))
    odds = F.coalesce(_log_odds(F.col("suffix_k"), F.col("suffix_n"), share, smooth), F.lit(prior))
    out = with_suffix(known).withColumn("f_suffix", odds).withColumn("score", model.margin())
    verdict = F.coalesce("ruling", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
