"""Where a node stands among the blocks of its document: the best range of blocks for a statement, and an index by tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of a statement that a range must cover and may exceed it by; least lengths of what is compared; what
# opens a block that states something; what a block of another environment is set back by.
COVERAGE, EXCESS = 0.82, 0.35
LEAST_STATEMENT, LEAST_BLOCK, LEAST_SOURCE, LEAST_TITLE, LEAST_TERM, LEAST_PHRASE = 8, 8, 16, 5, 4, 18
INTRO = "(?i)^\\s*(definition|theorem|lemma|proposition|corollary|example|remark|notation|proof|定义|定理|引理|推论|命题|性质|例子|注)"
INTRO_CHARS = 90
OTHER_ENVIRONMENT = 5000
HEADINGS = ("h1", "h2", "h3", "h4")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def match_form(text: Column) -> Column:
    """A text as it is compared: no white space, no $ \\ { } *, lower case."""
    return F.lower(F.regexp_replace(_filled(text), "[\\s$\\\\{}*]+", ""))


def block_ranges(statements: DataFrame, blocks: DataFrame) -> DataFrame:
    """statements(doc_id, node, statement), blocks(doc_id, block, type, text) -> (doc_id, node, start, end): the range of
    blocks that says a statement best.

    A range begins anywhere but at an hr, and ends before the next heading or hr. It grows, past blocks without text,
    while its joined text is part of the statement, until it contains the statement. The best one shares most characters
    with the statement and then differs least in length; a tie gives none, as do a best range that covers less than
    COVERAGE of the statement or differs by over EXCESS of it, and statements under LEAST_STATEMENT characters.

    Starts are paired with statements of their document only where their first text lies in the statement or around it; how
    far one goes is a fold over the texts of its section.
    """
    w = Window.partitionBy("doc_id").orderBy("block")
    bounded = F.coalesce(F.col("type").isin(*HEADINGS, "hr"), F.lit(False))
    b = blocks.select("doc_id", "block", "type", match_form(F.col("text")).alias("form")).withColumn("section", F.sum(bounded.cast("int")).over(w))
    b = b.where(~F.coalesce(F.col("type") == "hr", F.lit(False)))
    ahead = Window.partitionBy("doc_id", "section").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    starts = b.withColumn("first", F.first(F.when(F.col("form") != "", F.col("form")), ignorenulls=True).over(ahead)).where("first is not null").select("doc_id", "section", F.col("block").alias("start"), "first")
    sections = b.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("block", "form"))).alias("blocks"))
    s = statements.select("doc_id", "node", match_form(F.col("statement")).alias("said")).where(F.length("said") >= LEAST_STATEMENT)
    pairs = s.join(starts, "doc_id").where(F.contains("said", "first") | F.contains("first", "said")).select("doc_id", "section", "node", "said", "start").join(sections, ["doc_id", "section"])

    def grown(acc: Column, x: Column) -> Column:
        joined = F.concat(acc["joined"], x["form"])
        fits = F.contains(F.col("said"), joined) | F.contains(joined, F.col("said"))
        longer = F.struct(joined.alias("joined"), x["block"].cast("long").alias("end"), F.contains(joined, F.col("said")).alias("over"))
        stopped = F.struct(acc["joined"].alias("joined"), acc["end"].alias("end"), F.lit(True).alias("over"))
        return F.when(acc["over"] | (x["form"] == ""), acc).when(fits, longer).otherwise(stopped)

    none = F.struct(F.lit("").alias("joined"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("over"))
    ranges = pairs.select("doc_id", "node", "said", "start", F.aggregate(F.filter("blocks", lambda x: x["block"] >= F.col("start")), none, grown).alias("r"))
    size, m = F.length("r.joined"), F.length("said")
    each = ranges.select("doc_id", "node", "start", "r.end", m.alias("m"), F.least(size, m).alias("matched"), (-F.abs(size - m)).alias("near"))
    alike = each.groupBy("doc_id", "node", "m", "matched", "near").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min("end").alias("end"))
    best = alike.groupBy("doc_id", "node", "m").agg(F.max(F.struct("matched", "near", "n", "start", "end")).alias("b"))
    good = (F.col("b.n") == 1) & (F.col("b.matched") / F.col("m") >= COVERAGE) & (-F.col("b.near") / F.col("m") <= EXCESS)
    return best.where(good).select("doc_id", "node", "b.start", "b.end")


def _environment(text: Column) -> Column:
    """The environment that a block's first line begins, without its star."""
    return F.lower(F.regexp_extract(F.substring_index(_filled(text), "\n", 1), "\\\\begin\\s*\\{\\s*([A-Za-z*]+?)\\*?\\s*\\}", 1))


def _math_form(text: Column) -> Column:
    return F.lower(F.regexp_replace(_filled(text), "[\\s{}$\\\\]+", ""))


def anchor_index(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes(doc_id, node, type, label, tex_label, statement, source, title, terms array), blocks(doc_id, block, type, text) ->
    (doc_id, node, block, tier, is_first): the blocks of each node.

    Tiers: 1 statement, every block of its best range; 2 tex, the first block with the label in braces, of no other
    environment. A node with a statement that neither finds has no block. For the others: 3 source, the block that
    contains the source text or lies in it, of least difference in length, its own environment preferred; 4 number, the
    first block that opens as a statement and has the label's number near; 5 title, the first block with the title as
    inline math; 6 terms, the block with most of the terms, if two or one long phrase. Tiers 1 to 3 and 6 join only nodes
    that the tiers before left over; 4 and 5 add a further block to those found. is_first marks the block that the node's
    finding began with. A node and block that two tiers find have the first of them.
    """
    kind = F.lower(F.regexp_replace(F.regexp_replace(_filled(F.col("type")), "\\s+", ""), "\\*$", ""))
    n = nodes.select("doc_id", "node", kind.alias("kind"), F.trim(F.coalesce(F.when(F.col("tex_label") != "", F.col("tex_label")), F.col("label"), F.lit(""))).alias("tex"), F.regexp_extract(_filled(F.col("label")), "(\\d[\\d.]*)", 1).alias("number"),
                     F.trim(_filled(F.col("statement"))).alias("statement"), match_form(F.col("source")).alias("source"), _math_form(F.col("title")).alias("title"),
                     F.filter(F.array_distinct(F.transform(F.coalesce("terms", F.array().cast("array<string>")), match_form)), lambda t: F.length(t) >= LEAST_TERM).alias("terms"))
    b = blocks.where(~F.coalesce(F.col("type") == "hr", F.lit(False))).select("doc_id", "block", _filled(F.col("text")).alias("text"), match_form(F.col("text")).alias("form"), _environment(F.col("text")).alias("environment"))
    key = ["doc_id", "node"]

    def hits(found: DataFrame, tier: int, first: Column) -> DataFrame:
        return found.select("doc_id", "node", F.col("block").cast("long").alias("block"), F.lit(tier).alias("tier"), first.alias("is_first"))

    ranges = block_ranges(n, blocks)
    one = hits(ranges.join(blocks.select("doc_id", "block"), "doc_id").where("block between start and end"), 1, F.col("block") == F.col("start"))
    left = n.join(ranges.select(*key), key, "left_anti")
    braced = F.lower(F.regexp_replace(F.regexp_replace("text", "\\{\\s+", "{"), "\\s+\\}", "}"))
    fits = (F.col("kind") == "") | (F.col("environment") == "") | (F.col("kind") == F.col("environment"))
    labelled = left.where("tex <> ''").join(b, "doc_id").where(F.contains(braced, F.concat(F.lit("{"), F.lower("tex"), F.lit("}"))) & fits)
    two = hits(labelled.groupBy(*key).agg(F.min("block").alias("block")), 2, F.lit(True))
    free = left.where("statement = ''").join(two.select(*key), key, "left_anti")

    other = (F.col("environment") != "") & (F.col("kind") != "")
    score = F.abs(F.length("form") - F.length("source")) + F.when(other, F.when(F.col("kind") == F.col("environment"), -OTHER_ENVIRONMENT).otherwise(OTHER_ENVIRONMENT)).otherwise(0)
    near = free.where(F.length("source") >= LEAST_SOURCE).join(b.where(F.length("form") >= LEAST_BLOCK), "doc_id")
    near = near.where((F.contains("form", "source") | F.contains("source", "form")) & ((F.col("environment") != "introduction") | (F.col("kind") == "introduction")))
    three = hits(near.groupBy(*key).agg(F.min(F.struct(score.alias("score"), "block")).alias("b")).select(*key, "b.block"), 3, F.lit(True))

    found = one.unionByName(two).unionByName(three).select(*key, F.lit(True).alias("found")).distinct()
    going = free.select(*key).unionByName(one.select(*key).distinct()).unionByName(two.select(*key))
    rest = n.join(going, key, "left_semi").join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    named = rest.where("number <> ''").join(b.where(F.col("text").rlike(INTRO)), "doc_id")
    near = F.expr(f"substr(text, 1, {INTRO_CHARS}) rlike concat('\\\\b', replace(number, '.', '\\\\.'), '\\\\b')")
    four = hits(named.where(near).groupBy(*key, "found").agg(F.min("block").alias("block")), 4, ~F.col("found"))
    rest = rest.join(four.select(*key, F.lit(True).alias("_four")), key, "left").withColumn("found", F.col("found") | F.col("_four").isNotNull())
    maths = b.select("doc_id", "block", F.explode(F.regexp_extract_all("text", F.lit("\\$([^$\\n]+?)\\$"), F.lit(1))).alias("math")).select("doc_id", "block", _math_form(F.col("math")).alias("title"))
    five = hits(rest.where(F.length("title") >= LEAST_TITLE).join(maths, ["doc_id", "title"]).groupBy(*key, "found").agg(F.min("block").alias("block")), 5, ~F.col("found"))

    last = rest.where("not found").join(five.select(*key), key, "left_anti").where(F.size("terms") > 0)
    some = F.filter("terms", lambda t: F.contains(F.col("form"), t))
    told = last.join(b.where(F.length("form") >= LEAST_BLOCK), "doc_id").select(*key, "block", F.size(some).alias("n"), F.coalesce(F.array_max(F.transform(some, F.length)), F.lit(0)).alias("phrase")).where("n > 0")
    best = told.groupBy(*key).agg(F.max(F.struct("n", "phrase", (-F.col("block")).alias("at"))).alias("b")).where((F.col("b.n") >= 2) | (F.col("b.phrase") >= LEAST_PHRASE))
    six = hits(best.select(*key, (-F.col("b.at")).alias("block")), 6, F.lit(True))
    every = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).unionByName(six)
    return every.groupBy(*key, "block").agg(F.min(F.struct("tier", "is_first")).alias("t")).select(*key, "block", "t.tier", "t.is_first")
