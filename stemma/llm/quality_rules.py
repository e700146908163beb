"""Quality rules: base limits, and robust multivariate outliers by language and source. DataFrame operations only.

Each text gives a vector of transformed statistics (columns X below). For each (language, source), each language and
all rows, the location and scatter of the clean core are estimated by minimum covariance determinant: from several
starts (median and spread of each part; mean and covariance of all rows; the same of rows drawn in to the middle), keep
the share CORE of rows that lie nearest by Mahalanobis distance, estimate from them, and repeat until the determinant
no longer falls; the start that ends with the least determinant gives the estimate. A row is rejected when its
distance, scaled so that the median row of its group is as far as a normal one, passes the chi-square limit. Groups of
under `least` rows use their language's estimate, languages of under `least` rows that of all rows.

Distances are compared on a fixed grid of their logarithm, so a step is one grouped sum by (group, start, cell) that
combines before the shuffle: no row is dealt out by its group, however many rows one source has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_join, only, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The vector's parts, each with the least standard deviation that an estimate may have: most clean texts have no
#: symbol and no repeated line at all, and a scatter of 0 would reject the first that has.
#: The limit is 7.1 times that, so each part can reject by itself: x_lines from a share of 0.73 repeated lines,
#: x_repeats of 0.46 repeated words, the base limit being 0.5. A short text with one line twice has some of both and stays.
X = {"x_words": 0.5, "x_length": 0.25, "x_symbols": 0.3, "x_lines": 0.12, "x_repeats": 0.095}
CORE = 0.75
#: Cells of the grid per unit of ln(squared distance), and per unit of a part of X for the first start.
GRID, PART_GRID = 16, 64
#: A start has ended when the logarithm of its determinant falls by less.
SETTLED = 1e-6
#: Estimates, of some 300 bytes each, that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def _without(text: Column, chars: str) -> Column:
    """Length in code points of the text without these characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.char_length(text)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that occurs twice or more. words has three or more elements.

    Windows are sorted as (hash above, place below) in one long; neighbours in that order with the same hash are
    compared word by word. All of it is one pass and two sorts of primitive values within the row.
    """
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1
    return _let(F.struct(words.alias("w"), low.alias("low")), _repeat_words_of)


def _repeat_words_of(v: Column) -> Column:
    w, low = v["w"], v["low"]
    at = lambda k: F.get(w, k.cast("int"))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

    def marked(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(low), y.bitwiseAND(low)
            alike = (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
            return F.coalesce((x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0) & alike, F.lit(False))

        hits = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        starts = F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(low)))
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3).cast("long")), F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b))

    return _let(F.sort_array(windows), marked)


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_repeat_words(w)).alias("n_repeat_words")))
    per_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({
        "_c": counts, "_l": per_line,
        "word_chars": _without(text, SPACE).cast("long"),
        "n_symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
    })
    out = out.withColumns({"n_words": F.col("_c.n_words"), "n_repeat_words": F.col("_c.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")}).drop("_c", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(rows: DataFrame) -> DataFrame:
    """rows with the columns of X."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return rows.withColumns({
        "x_words": F.log1p("n_words"),
        "x_length": F.log(1 + F.col("word_chars") / words) * 5,
        "x_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "x_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
    })


def chi_square_limit(tail: float, dims: int) -> float:
    """The value that a chi-square variable of so many dimensions passes with probability tail, by bisection."""

    def above(x: float) -> float:
        # closed form of the upper tail for whole dimensions, by recurrence from 1 or 2
        q, k = (math.erfc(math.sqrt(x / 2)), 1) if dims % 2 else (math.exp(-x / 2), 2)
        while k < dims:
            q += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
            k += 2
        return q

    lo, hi = 1e-9, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > tail else (lo, mid)
    return (lo + hi) / 2


def _named(rows: DataFrame) -> DataFrame:
    """rows with their three groups: g0 (language, source), g1 language, g2 all. Group names are never null."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("lang", "source"))
    return rows.withColumns({"g0": F.to_json(F.array(lang, source)), "g1": F.to_json(F.array(lang)), "g2": F.lit("[]")})


def _with_group(rows: DataFrame, groups: DataFrame, n: int, key: str, how: str) -> DataFrame:
    """rows joined with one of n groups by key: broadcast where there are few, hot groups dealt out where not."""
    return rows.join(F.broadcast(groups), key, how) if n <= BROADCAST_GROUPS else heavy_join(rows, groups, key, "doc_id", how=how)


def _lower() -> list[tuple[str, str]]:
    names = list(X)
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _sums() -> list[Column]:
    """Count, sums and sums of products of X."""
    return [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in X], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in _lower()]]


def _estimates(sums: DataFrame) -> DataFrame:
    """sums(group, start, n, s_*, p_*) -> group, start, m_* (means), l_* (the lower triangle of the covariance's Cholesky
    factor, the floors of X on its diagonal) and log_det."""
    out = sums.withColumns({f"m_{a}": F.col(f"s_{a}") / F.col("n") for a in X})
    cov = {(a, b): F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}") for a, b in _lower()}
    names = list(X)
    for a, b in _lower():
        s = F.greatest(cov[a, a], F.lit(X[a] ** 2)) if a == b else cov[a, b]
        for c in names[: names.index(b)]:
            s = s - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
        # floors can leave the matrix just short of positive: keep a part of the floor on the diagonal
        s = F.sqrt(F.greatest(s, F.lit((X[a] / 4) ** 2))) if a == b else s / F.col(f"l_{b}_{b}")
        out = out.withColumn(f"l_{a}_{b}", s)
    return _state(out.withColumn("log_det", sum((F.log(f"l_{a}_{a}") for a in names), F.lit(0.0)) * 2))


def _state(rows: DataFrame) -> DataFrame:
    return rows.select("group", "start", *[f"m_{a}" for a in X], *[f"l_{a}_{b}" for a, b in _lower()], "log_det")


def _distance() -> Column:
    """Squared Mahalanobis distance of X from m_* under l_*, by forward substitution."""
    names, ys = list(X), []
    for i, a in enumerate(names):
        y = F.col(a) - F.col(f"m_{a}")
        for j in range(i):
            y = y - F.col(f"l_{a}_{names[j]}") * ys[j]
        ys.append(y / F.col(f"l_{a}_{a}"))
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def _cell(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-9) * GRID).cast("int")


def _upto(cells: DataFrame, *by: str) -> DataFrame:
    """cells(by, cell, n) with upto, the rows in cells up to this one, and total."""
    whole = Window.partitionBy(*by)
    return cells.withColumns({"upto": F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(whole)})


def _middles(each: DataFrame) -> DataFrame:
    """group -> q_*, the median of each part, and h_*, half the width of its middle half over a normal one's, no less than
    its floor. each(group, X)."""
    parts = F.array(*[F.struct(F.lit(a).alias("part"), F.floor(F.col(a) * PART_GRID).cast("int").alias("cell")) for a in X])
    cells = each.select("group", F.explode(parts).alias("c")).groupBy("group", "c.part", "c.cell").agg(F.count("*").alias("n"))
    upto = _upto(cells, "group", "part")
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell")))
    got = upto.groupBy("group").pivot("part", list(X)).agg(first(0.25).alias("q1"), first(0.5).alias("q2"), first(0.75).alias("q3"))
    middle = [((F.col(f"{a}_q2") + 0.5) / PART_GRID).alias(f"q_{a}") for a in X]
    return got.select("group", *middle, *[F.greatest((F.col(f"{a}_q3") - F.col(f"{a}_q1")) / PART_GRID / 1.349, F.lit(X[a])).alias(f"h_{a}") for a in X])


def _starts(each: DataFrame, n: int) -> DataFrame:
    """The first estimates of each group: by middle and spread, of all rows, and of rows drawn in to twice the spread."""
    middles = written(_middles(each), "middles")
    plain = middles.select("group", F.lit("middle").alias("start"), *[F.col(f"q_{a}").alias(f"m_{a}") for a in X], *[(F.col(f"h_{a}") if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in _lower()], F.lit(0.0).alias("log_det"))
    drawn = _with_group(each, middles, n, "group", "inner").select("group", *[F.least(F.greatest(a, F.col(f"q_{a}") - 2 * F.col(f"h_{a}")), F.col(f"q_{a}") + 2 * F.col(f"h_{a}")).alias(a) for a in X])
    both = [_estimates(rows.groupBy("group").agg(*_sums()).withColumn("start", F.lit(name))) for name, rows in (("moments", each), ("drawn", drawn))]
    return plain.unionByName(both[0]).unionByName(both[1]).withColumns({"log_det": F.lit(float("inf")), "open": F.lit(True)})


def core_estimates(each: DataFrame, n: int) -> DataFrame:
    """each(doc_id, group, X), of n groups -> per group m_*, l_* of its clean core and scale, the median distance over a
    normal one's, written."""
    now = written(_starts(each, n), "estimates")
    while now.where("open").limit(1).count():
        cells = _with_group(each, now.where("open"), n, "group", "inner").withColumn("cell", _cell(_distance())).groupBy("group", "start", "cell").agg(*_sums())
        core = _upto(cells, "group", "start").where(F.col("upto") - F.col("n") < CORE * F.col("total"))
        sums = core.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s_{a}" for a in X], *[f"p_{a}_{b}" for a, b in _lower()])])
        new = _estimates(sums)
        both = now.alias("o").join(new.alias("e"), ["group", "start"], "left")
        falls = F.col("e.log_det") < F.col("o.log_det") - SETTLED
        take = [F.when(falls, F.col(f"e.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in new.columns[2:]]
        now = written(both.select("group", "start", *take, F.coalesce(falls, F.lit(False)).alias("open")), "estimates")
    fields = [c for c in now.columns if c not in ("group", "open")]
    best = now.groupBy("group").agg(F.min_by(F.struct(*fields), F.struct("log_det", "start")).alias("e")).select("group", "e.*")
    best = written(best, "estimates")
    far = _with_group(each, best, n, "group", "inner").withColumn("cell", _cell(_distance())).groupBy("group", "cell").agg(F.count("*").alias("n"))
    middle = _upto(far, "group").where(F.col("upto") >= 0.5 * F.col("total")).groupBy("group").agg(F.min("cell").alias("middle"))
    scale = F.greatest(F.exp((F.col("middle") + 0.5) / GRID) / chi_square_limit(0.5, len(X)), F.lit(1.0))
    return written(best.join(middle.select("group", scale.alias("scale")), "group"), "estimates")


def judged(docs: DataFrame, tail: float = 1e-9, least: int = 200) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, lang, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (null where base_failed) and kept: one row per row.

    Null, empty and blank texts have no words and fail the base limits. Rows that fail them take no part in the
    estimates. A null language or source is a value of its own. Repeated rows count as often as they occur. An
    empty table gives an empty table; other columns are ignored.
    """
    rows = vector(measured(only(docs, "doc_id", "text", "lang", "source"))).withColumn("text_hash", F.xxhash64("text")).drop("text")
    rows = written(_named(rows), "measured")
    each = rows.where(~F.col("base_failed")).select("doc_id", F.explode(F.array("g0", "g1", "g2")).alias("group"), *X)
    enough = written(each.groupBy("group").agg(F.count("*").alias("k")).where((F.col("k") >= least) | (F.col("group") == "[]")).select("group"), "groups")
    n = enough.count()
    found = core_estimates(written(_with_group(each, enough, n, "group", "inner"), "each"), n)
    names = [c for c in found.columns if c not in ("group", "start", "log_det")]
    for level in ("g0", "g1", "g2"):
        here = found.select(F.col("group").alias(level), F.struct(*names).alias(f"e{level}"))
        rows = _with_group(rows, here, n, level, "left")
    placed = rows.withColumn("e", F.coalesce("eg0", "eg1", "eg2")).select("*", "e.*")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    out = placed.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_limit(tail, len(X)), F.lit(True))
    return out.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict on every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "source", "text_hash")
