"""Evidence and answers: anchoring, negated reasons, tolerant parsing of model output, reference flags, derivation context."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases by which a reason says that there is no dependency, and triggers that point at nothing by themselves.
NEGATIONS = ("不依赖", "无依赖", "不支持", "does not depend", "do not depend", "not depend", "no dependency", "does not support", "not support")
WEAK_TRIGGERS = ("由", "因此", "于是", "推出", "可知", "得到")
_BRIDGE = "因此|所以|于是|由此|从而|故|therefore|hence|thus|it follows|consequently|we conclude"


def negates(reason: Column) -> Column:
    """Whether a reason denies the dependency."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), "(?U)\\s+", " ")))
    return F.exists(F.array(*[F.lit(n) for n in NEGATIONS]), lambda n: F.contains(t, n))


def _fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", ""))


def anchored(snippet: Column, source: Column) -> Column:
    """Whether a snippet that isn't blank occurs in the source, white space and case aside."""
    return (_fold(snippet) != "") & F.contains(_fold(source), _fold(snippet))


def anchored_evidence(items: Column, support: Column, dependent: Column) -> Column:
    """Those of an array of (a, b) whose a occurs in the support and b in the dependent."""
    return F.filter(items, lambda e: anchored(e["a"], support) & anchored(e["b"], dependent))


def answer_from(raw: str | None, kind: type = dict) -> object | None:
    """The first object (or list) in a model's answer: full-width marks folded, fences and prose around it ignored, lone
    backslashes and Python literals allowed, a list's missing end added. None where there is none."""
    opening, closing = ("{", "}") if kind is dict else ("[", "]")
    text = (raw or "").translate(str.maketrans("“”‘’，：｛｝［］", "\"\"'',:{}[]"))
    at = text.find(opening)
    if at < 0:
        return None
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c == '"':
            quote = c
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                break
        i += 1
    body = text[at : i + 1] if not depth else text[at:].rstrip().rstrip(",") + closing * depth if kind is list else ""
    for candidate in (body, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", body)):
        for load in (json.loads, ast.literal_eval):
            try:
                got = load(candidate)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(got, kind):
                return got
    return None


@F.pandas_udf(StringType())
def answer_json(raw: pd.Series) -> pd.Series:
    """The object in each answer as JSON, for from_json; null where there is none."""
    return raw.map(lambda t: None if (got := answer_from(t)) is None else json.dumps(got, ensure_ascii=False))


def fenced_code(text: Column) -> Column:
    """The content of the first fenced block with a language; null without one."""
    return F.nullif(F.btrim(F.regexp_extract(text, "(?s)```[\\w\\s]+?\\n(.*?)```", 1), F.lit(" \t\r\n")), F.lit(""))


def repair_flags(explicit: Column, relative: Column, formula: Column, named: Column, triggers: Column) -> Column:
    """Flags of a node from its hits: explicit and relative are arrays of (target), the others arrays."""
    open_ = lambda hits: F.exists(hits, lambda h: h["target"].isNull())
    aimed = lambda hits: F.exists(hits, lambda h: h["target"].isNotNull())
    target = aimed(explicit) | aimed(relative) | (F.size(named) > 0) | (F.size(formula) > 0)
    return F.array_compact(F.array(
        F.when(open_(explicit), "unresolved_explicit_reference"), F.when(open_(relative), "relative_reference_no_anchor"), F.when(F.size(named) > 0, "named_reference_recorded"),
        F.when(F.size(formula) > 0, "formula_reference_recorded"), F.when((F.size(triggers) > 0) & ~target, "trigger_without_target"),
    ))


def weak_triggers_only(triggers: Column) -> Column:
    """Whether a node has triggers and all of them are such that need no target."""
    return (F.size(triggers) > 0) & (F.size(F.array_except(triggers, F.array(*[F.lit(t) for t in WEAK_TRIGGERS]))) == 0)


def derivation_context(nodes: DataFrame, sources: DataFrame, most: int = 2000) -> DataFrame:
    """nodes(doc_id, pos, start, end), sources(doc_id, text) -> nodes with `context`: the last paragraph with a bridge phrase
    between the latest earlier end (an interval as-of: the largest end at or before the start) and the node's start."""
    ends = nodes.select("doc_id", F.col("end").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("int").alias("pos"), "end", F.lit(None).cast("int").alias("start"))
    starts = nodes.select("doc_id", F.col("start").alias("_at"), F.lit(1).alias("_side"), "pos", F.lit(None).cast("int").alias("end"), "start")
    w = Window.partitionBy("doc_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ends.unionByName(starts).withColumn("from", F.max("end").over(w)).where("_side = 1").select("doc_id", "pos", "start", F.coalesce("from", F.greatest(F.lit(0), F.col("start") - 2 * most)).alias("from"))
    text = F.substring(F.col("text"), F.col("from") + 1, F.col("start") - F.col("from"))
    bridge = F.filter(F.split(text, "\\n[ \\t]*\\n"), lambda p: p.rlike(f"(?i){_BRIDGE}"))
    found = placed.join(sources.select("doc_id", "text"), "doc_id").select("doc_id", "pos", F.substring(F.trim(F.get(bridge, F.size(bridge) - 1)), 1, most).alias("context"))
    return nodes.join(found, ["doc_id", "pos"], "left")


def active_session(users: DataFrame, sessions: DataFrame, token_hash: str, now: Column) -> DataFrame:
    """users(user_id, active), sessions(user_id, token_hash, revoked_at, expires_at): the session of a token that is neither
    revoked nor expired, of an active user; one row at most."""
    live = sessions.where((F.col("token_hash") == token_hash) & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return live.join(users.where("active"), "user_id").limit(1)


def title_fallback(unresolved: DataFrame, titles: DataFrame) -> DataFrame:
    """unresolved(doc_id, pos, hit, surface), titles(doc_id, pos, title): titles that occur once, of an earlier node, one within
    the other; the first by place. Joined within a document only."""
    once = titles.groupBy("doc_id", "title").agg(F.count("*").alias("n"), F.min("pos").alias("at")).where("n = 1")
    met = unresolved.join(once, "doc_id").where((F.col("at") < F.col("pos")) & (F.contains("surface", F.col("title")) | F.contains(F.col("title"), F.col("surface"))))
    return met.groupBy("doc_id", "pos", "hit").agg(F.min("at").alias("target"))
