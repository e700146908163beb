"""Language of web pages by Bayesian fusion of evidence.

- text: hashed byte trigrams of the visible text under a multinomial model per language, trained on all labelled
  documents; the log likelihood is tempered, since neighbouring trigrams aren't independent
- declared markup language: a table of P(declared | language), estimated from all pages by their text posteriors
- address: the prior of a page's host, smoothed towards that of its registered domain, that towards its suffix's, and
  that towards that of all pages; each is a grouped sum of text posteriors, the page's own left out

The grouped sums combine before the shuffle, and are joined to the pages with hot keys dealt out, so a host with a third of
all pages is no burden.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import slices, texts_of
from .common import heavy_join, hot_keys, only, text_batches, written
from .files import table

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: A model has this many languages at most: SLOTS counts of each go to every worker.
MOST_LANGUAGES = 256
_HIDDEN = re.compile(rb"<(script|style)\b", re.IGNORECASE)
_ENTITY = re.compile(rb"&[#\w]{1,40};")
_HTML = re.compile(rb"<html\b", re.IGNORECASE)
_LANG = re.compile(rb"[\s\"'/]lang\s*=\s*[\"']?([A-Za-z]{1,8})", re.IGNORECASE)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[[91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127]] = 32


def visible(html: bytes) -> bytes:
    """The page's text: tags, comments, scripts, styles and entities make way for a blank. One pass, whatever the markup:
    what isn't closed is searched for once. An unclosed comment, script or style is a plain tag, an unclosed tag text."""
    low, out, at, gone = html.lower(), [], 0, set()

    def end_of(mark: bytes, start: int) -> int:
        """The place behind the next mark, or -1."""
        if mark in gone:
            return -1
        found = low.find(mark, start)
        if found < 0:
            gone.add(mark)
        return found + len(mark) if found >= 0 else -1

    while (lt := html.find(b"<", at)) >= 0:
        out.append(html[at:lt])
        end = -1
        if html.startswith(b"<!--", lt):
            end = end_of(b"-->", lt + 4)
        elif m := _HIDDEN.match(html, lt):
            end = end_of(b"</" + m[1].lower(), lt)
            end = end_of(b">", end) if end >= 0 else -1
        end = end if end >= 0 else end_of(b">", lt)
        at = max(end, lt)
        if end < 0:
            break
        out.append(b" ")
    out.append(html[at:])
    return _ENTITY.sub(b" ", b"".join(out))


def declared(html: bytes) -> str | None:
    """The language that the first html tag declares, in lower case, without its region."""
    m = _HTML.search(html)
    end = html.find(b">", m.end()) if m else -1
    found = _LANG.search(html, m.end(), end) if end >= 0 else None
    return found[1].decode().lower() if found else None


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of each byte trigram within a text, letters in lower case and all else blank."""
    if len(buf) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = _FOLD[buf].astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
    ok = np.ones(len(slot), bool)
    for e in off[1:-1]:
        ok[max(0, e - 2) : e] = False
    ok &= (x[:-2] != 32) | (x[1:-1] != 32)
    at = np.flatnonzero(ok)
    return slot[at], np.searchsorted(off, at, "right") - 1


def _count(batches):
    """Arrow function (lang, text) -> (lang, slot, n) of the partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, 1):
            langs = part.column(0).to_pylist()
            slot, doc = trigrams(*texts_of(part.column(1)))
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            counts = np.bincount((number[doc] << SLOT_BITS) | slot, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
            for i, name in enumerate(names):
                total[name] = total.get(name, 0) + counts[i]
    for name, counts in sorted(total.items()):
        used = np.flatnonzero(counts)
        yield table({"lang": pa.array([name] * len(used), pa.string()), "slot": pa.array(used.astype(np.int32)), "n": pa.array(counts[used].astype(np.int64))})


def trained(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each slot, from all docs(lang, text) with a language and a text."""
    rows = only(docs, "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.full((len(names), SLOTS), smooth)
    number = {n: i for i, n in enumerate(names)}
    if counts.num_rows:
        np.add.at(out, ([number[x] for x in counts["lang"].to_pylist()], counts["slot"].to_numpy()), counts["n"].to_numpy())
    return names, np.log(out / out.sum(axis=1, keepdims=True)).astype(np.float32) if names else out


def _score(model, temper: float):
    """Arrow function (page_id, url, html) -> page_id, url, declared, text: tempered posterior under a flat prior."""

    def run(batches):
        _, logs = model.value
        flipped = np.ascontiguousarray(logs.T)
        for batch in batches:
            for part in slices(batch, 2):
                html = [(x or "").encode() for x in part.column(2).to_pylist()]
                told = [declared(h) for h in html]
                seen = [visible(h) for h in html]
                off = np.r_[0, np.cumsum([len(s) for s in seen])]
                slot, page = trigrams(np.frombuffer(b"".join(seen), np.uint8), off)
                total = np.zeros((part.num_rows, logs.shape[0]))
                if len(slot):
                    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
                    total[page[starts]] = np.add.reduceat(flipped[slot], starts, axis=0, dtype=float)
                p = np.exp(temper * (total - total.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                yield table({
                    "page_id": part.column(0), "url": part.column(1), "declared": pa.array(told, pa.string()),
                    "text": pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * logs.shape[0]), pa.array(p.reshape(-1))),
                })

    return run


def _sums(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by -> the sum of the text posteriors as an array, and rows: partial sums of n numbers per group."""
    out = rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.sum(F.get("text", F.lit(i))).alias(f"s{i}") for i in range(n)])
    return out.select(by, F.col("rows").alias(f"n_{by}"), F.array(*[f"s{i}" for i in range(n)]).alias(f"s_{by}"))


def _smoothed(own: Column, total: Column, n: Column, above: Column, strength: float) -> Column:
    """The group's mean posterior without the page itself, drawn towards the level above."""
    return F.transform(total, lambda s, i: (F.greatest(s - F.get(own, i), F.lit(0.0)) + strength * F.get(above, i)) / (n - 1 + strength))


def identified(pages: DataFrame, docs: DataFrame, temper: float = 0.05, strength: float = 5.0) -> DataFrame:
    """pages(page_id, url, html), docs(lang, text) -> page_id, lang, probability, text_lang, declared: one row per row.

    A null or empty html has flat text evidence; a missing declaration, and a url without a host, give none. lang is
    null only where docs has no labelled text at all. Ties go to the language first in order. Repeated rows are each
    judged and each count; an empty table gives an empty table; other columns are ignored. More than MOST_LANGUAGES
    distinct languages in docs raise ValueError: there is no result then.
    """
    spark = pages.sparkSession
    text_batches(spark)
    names, logs = trained(docs)
    rows = only(pages, "page_id", "url", "html")
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"))
    n, model = len(names), spark.sparkContext.broadcast((names, logs))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scored = rows.mapInArrow(_score(model, temper), f"page_id {kinds['page_id']}, url string, declared string, text array<double>")
    host = F.lower(F.regexp_extract("url", "^[^:/?#]*://([^/?#:]*)", 1))
    parts = F.split("host", "\\.")
    scored = scored.withColumn("host", F.coalesce(host, F.lit(""))).withColumns({"suffix": F.element_at(parts, -1), "domain": F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.least(F.size(parts), F.lit(2))), ".")})
    scored = written(scored.withColumn("declared", F.coalesce("declared", F.lit(""))), "scored")
    flat = F.array(*[F.lit(1.0 / n)] * n)
    every = scored.agg(F.count("*").alias("n"), *[F.sum(F.get("text", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    base = F.array(*[F.lit(((every[f"s{i}"] or 0.0) + 1) / (every.n + n)) for i in range(n)])
    told = _sums(scored, "declared", n)
    kinds_told = told.count()
    out = heavy_join(scored, told, "declared", "page_id")
    for level in ("suffix", "domain", "host"):
        out = heavy_join(out, _sums(scored, level, n), level, "page_id", hot_keys(scored.groupBy(level).agg(F.count("*").alias("n")), level))
    out = out.withColumn("p_suffix", _smoothed(F.col("text"), F.col("s_suffix"), F.col("n_suffix"), base, strength))
    out = out.withColumn("p_domain", _smoothed(F.col("text"), F.col("s_domain"), F.col("n_domain"), F.col("p_suffix"), strength))
    out = out.withColumn("p_host", _smoothed(F.col("text"), F.col("s_host"), F.col("n_host"), F.col("p_domain"), strength))
    totals = F.array(*[F.lit(every[f"s{i}"] or 0.0) for i in range(n)])
    markup = F.transform("s_declared", lambda s, i: (F.greatest(s - F.get("text", i), F.lit(0.0)) + 0.5) / (F.get(totals, i) + 0.5 * kinds_told))
    markup = F.when(F.col("declared") == "", flat).otherwise(markup)
    joint = F.transform("text", lambda p, i: F.ln(p + 1e-300) + F.ln(F.get("p_host", i)) + F.ln(F.get("markup", i)))
    out = out.withColumn("markup", markup).withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    label = F.array(*[F.lit(x) for x in names])
    best = F.get(label, (F.array_position("joint", F.col("top")) - 1).cast("int"))
    total = F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    text_lang = F.get(label, (F.array_position("text", F.array_max("text")) - 1).cast("int"))
    return out.select("page_id", best.alias("lang"), (1 / total).alias("probability"), text_lang.alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    return identified(pages, docs)
