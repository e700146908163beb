"""What a document's structure says must be stated, what of it no statement covers, and its recovery, once each.

Offsets are characters from 0; an end is the first character after. Documents are rows (doc_id, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import nfkc
from stemma.operators.graph import leaders
from stemma.plans.state import placed, written

# The type words of a logical heading, its pattern, those of any heading and of a number, names of types, folded
# punctuation, the role of a block that counts, and where unlocated statements stand.
TYPE_WORDS = ("Theorem", "Lemma", "Proposition", "Corollary", "Definition", "Claim", "Axiom", "Property", "Example", "Exercise", "Remark", "Conjecture", "Problem", "Observation", "Fact",
              "定理", "引理", "命题", "推论", "定义", "断言", "公理", "性质", "例", "练习", "注", "猜想", "问题")
LOGICAL_HEADING = f"(?i)^\\s*#{{1,6}}\\s+({'|'.join(TYPE_WORDS)})\\s*([A-Z]?\\d+(?:[.\\-][A-Za-z0-9]+)*|[IVXLCDM]+|[A-Z])?"
ANY_HEADING = "^[ \\t]*#{1,6}[ \\t]+"
NUMBER = "\\d+(?:[.\\-][A-Za-z0-9]+)*"
ENGLISH = {
    "定理": "theorem", "引理": "lemma", "命题": "proposition", "推论": "corollary", "定义": "definition", "断言": "claim", "公理": "axiom", "性质": "property", "例": "example", "例子": "example", "练习": "exercise",
    "注": "remark", "注记": "remark", "猜想": "conjecture", "问题": "problem",
}
FOLDED = ("，。；：！？（）【】“”‘’", ",.;:!?()[]\"\"''")
TOP_LEVEL = "top_level_logical_unit_start"
NOWHERE = 10**15


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value found once, however often body names it. No function in Python may stand in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _normal(c: Column) -> Column:
    """NFKC of a text; only what isn't ASCII goes to Python."""
    return F.coalesce(nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def heading_fact(text: Column) -> Column:
    """struct(label, type) of a text that begins with a heading which names a type, else null."""
    t = _said(text)
    found = F.struct(F.regexp_extract(t, LOGICAL_HEADING, 1).alias("kind"), F.regexp_extract(t, LOGICAL_HEADING, 2).alias("number"))
    label = lambda f: F.trim(F.concat_ws(" ", f["kind"], F.nullif(f["number"], F.lit(""))))
    return F.when(t.rlike("^\\s*#"), _let(found, lambda f: F.when(f["kind"] != "", F.struct(label(f).alias("label"), f["kind"].alias("type")))))


def _canonical(normal: Column) -> Column:
    """canonical_type of a text in NFKC."""
    known = sorted({w.lower() for w in TYPE_WORDS if w.isascii()})
    english = F.create_map(*[F.lit(x) for pair in (*((w, w) for w in known), *ENGLISH.items()) for x in pair])
    return F.coalesce(F.element_at(english, F.lower(F.trim(normal))), F.lit(""))


def canonical_type(kind: Column) -> Column:
    """The English name of a type word, empty for any other."""
    return _canonical(_normal(_said(kind)))


def label_identity(label: Column, kind: Column) -> Column:
    """type:number of a numbered label, its dashes as dots, the type read off the label where none is given; type:unnumbered;
    or label: and the label without heading marks and closing punctuation, where the type is unknown."""
    plain = F.regexp_replace(F.lower(F.trim(_normal(_said(label)))), "^\\s*#{1,6}\\s*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "\\s+", " "), "[ .:;,：；，。]+$", "")

    def told(g: Column) -> Column:
        before = F.trim(F.call_function("substring_index", g["plain"], F.when(g["number"] == "", "\0").otherwise(g["number"]), F.lit(1)))
        # what stands before the number is in NFKC, as all of plain
        return _let(F.when((g["named"] == "") & (g["number"] != ""), _canonical(before)).otherwise(g["named"]), lambda named: F.when(named == "", F.concat(F.lit("label:"), g["plain"])).when(g["number"] != "", F.concat(named, F.lit(":"), F.replace(g["number"], F.lit("-"), F.lit(".")))).otherwise(F.concat(named, F.lit(":unnumbered"))))

    numbered = lambda g: F.struct(g["plain"].alias("plain"), g["named"].alias("named"), F.regexp_extract(g["plain"], NUMBER, 0).alias("number"))
    return _let(F.struct(plain.alias("plain"), canonical_type(kind).alias("named")), lambda g: _let(numbered(g), told))


def surface_fingerprint(text: Column, strip_heading: bool = True) -> Column:
    """What makes two passages the same on the surface: NFKC, folded punctuation, no first heading line, no white space."""
    t = F.replace(_normal(_said(text)), F.lit("\\n\\n"), F.lit("\n\n"))
    t = F.translate(F.regexp_replace(t, "\\\\t(?=\\s|[$\\\\]|$)", ""), *FOLDED)
    if strip_heading:
        t = F.regexp_replace(t, "(?s)\\A((?:(?![ \\t]*#{1,6}[ \\t])[^\\n]*\\n)*)[ \\t]*#{1,6}[ \\t]+[^\\r\\n]*(?:\\r?\\n|\\z)", "$1")
    return F.regexp_replace(t, "\\s+", "")


def _find(needle: Column, text: Column, start: Column) -> Column:
    """The place of needle in text, from start on if it is there, else anywhere; -1 if nowhere or empty."""
    ahead = F.call_function("locate", needle, text, (F.greatest(start, F.lit(0)) + 1).cast("int"))
    anywhere = lambda a: F.when(a > 0, a).when(start > 0, F.call_function("locate", needle, text, F.lit(1))).otherwise(a) - 1
    return F.when(needle == "", -1).otherwise(_let(ahead, anywhere)).cast("long")


def source_span(needle: Column, text: Column, start: Column) -> Column:
    """struct(start, end) of a source text, without the white space at its ends if only that is found; -1 where it isn't."""
    needle, text = _said(needle), _said(text)
    span = lambda at, end: F.struct(at.cast("long").alias("start"), end.cast("long").alias("end"))
    bare = lambda b: _let(_find(b, text, start), lambda at: span(at, F.when(at >= 0, at + F.char_length(b)).otherwise(-1)))
    return _let(_find(needle, text, start), lambda at: F.when(at >= 0, span(at, at + F.char_length(needle))).otherwise(_let(_stripped(needle), bare)))


def located(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """blocks(doc_id, block, pos, text, ...) with source_start and source_end in their document: each is looked for from the end of
    the last one found, and before that only if it isn't there. A fold over a document's blocks in the order of pos."""
    listed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block", _said(F.col("text")).alias("text")))).alias("blocks"))
    kind = f"array<struct<pos:{blocks.schema['pos'].dataType.simpleString()},block:{blocks.schema['block'].dataType.simpleString()},span:struct<start:bigint,end:bigint>>>"

    def step(acc: Column, b: Column) -> Column:
        on = lambda span: F.struct(F.when(span["start"] >= 0, span["end"]).otherwise(acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(F.struct(b["pos"].alias("pos"), b["block"].alias("block"), span.alias("span")))).alias("out"))
        return _let(source_span(b["text"], F.col("whole"), acc["cursor"]), on)

    first = F.struct(F.lit(0).cast("long").alias("cursor"), F.array().cast(kind).alias("out"))
    found = listed.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").select("doc_id", F.explode(F.aggregate("blocks", first, step)["out"]).alias("b"))
    spans = found.select("doc_id", F.col("b.pos").alias("pos"), F.col("b.block").alias("block"), F.col("b.span.start").alias("source_start"), F.col("b.span.end").alias("source_end"))
    return blocks.join(spans, ["doc_id", "pos", "block"])


def headings(docs: DataFrame, by: list[str]) -> DataFrame:
    """docs(*by, text) -> (*by, start, end, line, fact) of every Markdown heading, end being the next heading's start or the text's end."""
    lines = docs.select(*by, F.char_length("text").alias("_size"), F.posexplode(F.split("text", "\n")).alias("_i", "line"))
    w = Window.partitionBy(*by).orderBy("_i")
    at = F.coalesce(F.sum(F.char_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = lines.withColumn("start", at.cast("long")).where(F.col("line").rlike(ANY_HEADING))
    ends = F.coalesce(F.lead("start").over(w), F.col("_size")).cast("long")
    return heads.select(*by, "start", ends.alias("end"), F.regexp_replace("line", "\\r+$", "").alias("line"), heading_fact(F.col("line")).alias("fact"))


CANDIDATE = ["doc_id", "candidate_id", "origin", "block", "source_text", "source_start", "source_end", "heading_start", "label", "type"]


def structural_candidates(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """docs(doc_id, text), blocks(doc_id, block, pos, role, hint, label, text) -> what the documents must state, as CANDIDATE.

    Blocks that start a logical unit of a known type, where the document has them; and headings that name a type, with what
    follows up to the next heading, unless a block of the same type and label covers the heading (or, if that block isn't
    found in the document, begins with it). A block's own heading gives its label and type.
    """
    trusted = heading_fact(F.concat(F.lit("# "), F.trim(_said(F.col("hint")))))
    own = blocks.where((F.col("role") == TOP_LEVEL) & trusted.isNotNull() & (_said(F.col("text")) != "") & F.col("block").isNotNull())
    fact = heading_fact(F.col("text"))
    found = located(own.select("doc_id", "block", "pos", "label", "text", trusted["type"].alias("hinted")), docs)
    segment = found.select("doc_id", F.concat(F.lit("block:"), F.col("block").cast("string")).alias("candidate_id"), F.lit("segment_block").alias("origin"), F.col("block").cast("string").alias("block"), F.col("text").alias("source_text"), "source_start", "source_end",
                           F.when(fact.isNotNull(), F.col("source_start")).alias("heading_start"), F.coalesce(fact["label"], F.trim(_said(F.col("label")))).alias("label"), F.coalesce(fact["type"], F.col("hinted")).alias("type"))
    segment = written(segment, "segment")
    heads = headings(docs, ["doc_id"]).where("fact is not null")
    heads = heads.join(docs, "doc_id").select("doc_id", F.concat(F.lit("heading:"), F.col("start").cast("string")).alias("candidate_id"), F.lit("markdown_heading").alias("origin"), F.lit(None).cast("string").alias("block"),
                                              F.expr("substr(text, cast(start + 1 as int), cast(end - start as int))").alias("source_text"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.col("start").alias("heading_start"), "fact.label", "fact.type", "line")
    keyed = lambda d: d.withColumns({"_type": canonical_type(F.col("type")), "_identity": label_identity(F.col("label"), F.col("type"))})
    a = keyed(heads).withColumn("_line", surface_fingerprint(F.col("line"), strip_heading=False)).alias("h")
    b = keyed(segment).select("doc_id", "_type", "_identity", F.col("source_start").alias("_start"), F.col("source_end").alias("_end"), surface_fingerprint(F.col("source_text"), strip_heading=False).alias("_text")).alias("s")
    same = [F.col(f"h.{c}") == F.col(f"s.{c}") for c in ("doc_id", "_type", "_identity")]
    covers = F.when(F.col("s._start") >= 0, (F.col("s._start") <= F.col("h.source_start")) & (F.col("h.source_start") < F.col("s._end"))).otherwise(F.startswith("s._text", "h._line"))
    return segment.unionByName(a.join(b, same[0] & same[1] & same[2] & covers, "left_anti").select(*CANDIDATE))


def _heading_keys(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, heading_start, identity): the headings in a statement's source that bear its label, by their place in the document."""
    rows = statements.where(_said(F.col("source_text")) != "").join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    rows = rows.select("doc_id", "key", label_identity(F.col("label"), F.col("type")).alias("identity"), F.col("source_text").alias("text"), source_span(F.col("source_text"), F.col("whole"), F.lit(0))["start"].alias("at")).where("at >= 0")
    inside = headings(rows.select("doc_id", "key", "text"), ["doc_id", "key"]).where("fact is not null")
    inside = inside.select("doc_id", "key", "start", label_identity(F.col("fact.label"), F.col("fact.type")).alias("identity"))
    return inside.join(rows.select("doc_id", "key", "at", "identity"), ["doc_id", "key", "identity"]).select("doc_id", "key", (F.col("at") + F.col("start")).alias("heading_start"), "identity").distinct()


def missing_candidates(candidates: DataFrame, statements: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of candidates that statements(doc_id, key, block, label, type, source_text) don't cover: blocks by block, headings by
    place and identity."""
    named = candidates.withColumn("identity", label_identity(F.col("label"), F.col("type")))
    blocks = statements.where("block is not null").select("doc_id", F.col("block").cast("string").alias("block")).distinct()
    places = _heading_keys(statements, docs).select("doc_id", "heading_start", "identity").distinct()
    segment = named.where("origin = 'segment_block'").join(blocks, ["doc_id", "block"], "left_anti")
    heading = named.where("origin <> 'segment_block'").join(places, ["doc_id", "heading_start", "identity"], "left_anti")
    return segment.select(*CANDIDATE).unionByName(heading.select(*CANDIDATE))


def source_only(candidates: DataFrame) -> DataFrame:
    """(doc_id, candidate_id, content, degraded) for candidates that no answer came for: their own source. Without a trusted span
    that is an error."""
    wrong = F.raise_error(F.concat(F.lit("no trusted source span: "), F.col("candidate_id")))
    trusted = (F.col("source_start") >= 0) & (F.col("source_end") > F.col("source_start"))
    return candidates.select("doc_id", "candidate_id", F.when(F.coalesce(trusted, F.lit(False)), F.col("source_text")).otherwise(wrong.cast("string")).alias("content"), F.lit(True).alias("degraded"))


def merged_recovery(statements: DataFrame, recovered: DataFrame, candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """statements(doc_id, key long, block, label, type, source_text, content), recovered(doc_id, candidate_id, content) -> (doc_id,
    new_key, key, candidate_id, label, type, content, status): statements and what is recovered, in the order of their
    sources; status is kept, recovered, or duplicate (with no new_key).

    A recovery is a duplicate of a statement, or of an earlier recovery that stays, if it is of the same block, or its heading
    is one that the other has under the same identity, or both say the same on the surface and their sources overlap.
    Statements that aren't found come last, in their order; where nothing was recovered the order of keys stays.
    """
    docs = docs.select("doc_id", "text")
    whole = docs.select("doc_id", F.col("text").alias("whole"))
    r = recovered.groupBy("doc_id", "candidate_id").agg(F.min("content").alias("content")).join(candidates, ["doc_id", "candidate_id"])
    r = r.withColumns({"identity": label_identity(F.col("label"), F.col("type")), "print": surface_fingerprint(F.col("content")), "order": F.when(F.col("source_start") >= 0, F.col("source_start")).otherwise(F.lit(NOWHERE))})
    r = written(placed(r, "id", "doc_id", "order", "candidate_id"), "recovered")
    old = statements.join(whole, "doc_id").select("doc_id", "key", "block", "label", "type", "source_text", "content", source_span(F.col("source_text"), F.col("whole"), F.lit(0)).alias("span"), surface_fingerprint(F.col("content")).alias("print"))
    old = written(old.select("doc_id", "key", F.col("block").cast("string").alias("block"), "label", "type", "source_text", "content", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "print"), "statements")

    def alike(known: DataFrame, keys: DataFrame) -> DataFrame:
        """(id, by): recoveries and what they repeat: known(doc_id, by, block, print, start, end) with its heading keys(doc_id, by, heading_start, identity)."""
        by_block = r.where("origin = 'segment_block'").join(known.where("block is not null").select("doc_id", "block", "by"), ["doc_id", "block"]).select("id", "by")
        by_head = r.where("heading_start >= 0").join(keys, ["doc_id", "heading_start", "identity"]).select("id", "by")
        overlap = (F.col("start") >= 0) & (F.col("source_start") >= 0) & (F.col("start") < F.col("source_end")) & (F.col("source_start") < F.col("end"))
        by_print = r.where("print <> ''").join(known.select("doc_id", "print", "by", "start", "end"), ["doc_id", "print"]).where(overlap).select("id", "by")
        return by_block.unionByName(by_head).unionByName(by_print)

    again = written(alike(old.withColumnRenamed("key", "by"), written(_heading_keys(old, docs), "keys").withColumnRenamed("key", "by")).select("id").distinct(), "again")
    new = written(r.join(again, "id", "left_anti").select("id", "doc_id", "label", "type", "source_text", "print", F.col("source_start").alias("start"), (F.col("source_start") + F.char_length("source_text")).alias("end")), "new")
    among = alike(new.select("doc_id", F.col("id").alias("by"), F.lit(None).cast("string").alias("block"), "print", "start", "end"), written(_heading_keys(new.withColumnRenamed("id", "key"), docs), "keys").withColumnRenamed("key", "by"))
    stay = leaders(new.select("id"), among.where("by < id").select(F.col("by").alias("x"), F.col("id").alias("y"))).where("id = leader").select("id", F.lit(True).alias("stays"))

    marked = r.join(stay, "id", "left")
    rows = old.select("doc_id", "key", F.lit(None).cast("string").alias("candidate_id"), "label", "type", "content", F.lit("kept").alias("status"), "start", F.struct(F.lit(0).alias("of"), F.col("key").cast("long").alias("at")).alias("place"))
    more = marked.select("doc_id", F.lit(None).cast(old.schema["key"].dataType).alias("key"), "candidate_id", "label", "type", "content", F.when(F.col("stays"), "recovered").otherwise("duplicate").alias("status"), F.col("source_start").alias("start"), F.struct(F.lit(1).alias("of"), F.col("id").alias("at")).alias("place"))
    every = rows.unionByName(more)
    touched = F.max(F.col("status") == "recovered").over(Window.partitionBy("doc_id"))
    source = F.when(F.col("touched") & (F.col("start") >= 0), F.col("start")).otherwise(F.lit(NOWHERE))
    counted = F.when(F.col("status") != "duplicate", F.row_number().over(Window.partitionBy("doc_id", F.col("status") == "duplicate").orderBy(source, "place")) - 1)
    return every.withColumn("touched", touched).withColumn("new_key", counted.cast("long")).select("doc_id", "new_key", "key", "candidate_id", "label", "type", "content", "status")
