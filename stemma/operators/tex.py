"""TeX sources: comments masked, theorem environments and their numbers, proofs attached, the text between them.

The scanner is one pass per document (Arrow); attaching proofs and finding what lies between is done with windows.
Offsets count code points and hold in the source as in the masked text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import gaps, merged_spans

# Usual environment names and short forms by type, and the sectioning commands from the outside in.
ENVIRONMENTS = {
    "theorem": ("theorem", "thm"), "lemma": ("lemma", "lem"), "proposition": ("proposition", "prop"), "corollary": ("corollary", "cor"), "definition": ("definition", "defn", "def"),
    "remark": ("remark", "rem"), "example": ("example", "ex"), "conjecture": ("conjecture", "conj"), "claim": ("claim",), "axiom": ("axiom",), "problem": ("problem",),
}
SECTIONS = ("part", "chapter", "section", "subsection", "subsubsection")
_TYPE_OF = {name: kind for kind, names in ENVIRONMENTS.items() for name in names}
ROW = "kind string, env string, type string, number string, label string, title string, start int, end int, text string"


def comment_spans(source: str) -> list[tuple[int, int]]:
    """Each comment, from an unescaped % to the end of its line."""
    return [(m.start(2), m.end(2)) for m in re.finditer(r"((?:\\.|[^\\%\n])*)(%[^\n]*)?(?:\n|\Z)", source) if m[2]]


def masked(source: str) -> str:
    """The source with comments blanked, of the same length."""
    out, at = [], 0
    for s, e in comment_spans(source):
        out += [source[at:s], " " * (e - s)]
        at = e
    return "".join([*out, source[at:]])


def braced(source: str, at: int) -> tuple[str, int] | None:
    """The content of the braces that open at or behind white space after `at`, and where they end."""
    m = re.compile(r"\s*\{").match(source, at)
    if not m:
        return None
    depth, i = 1, m.end()
    while i < len(source) and depth:
        if source[i] == "\\":
            i += 1
        else:
            depth += {"{": 1, "}": -1}.get(source[i], 0)
        i += 1
    return (source[m.end() : i - 1], i) if not depth else None


def canonical_type(env: str, title: str = "") -> str | None:
    """The type of an environment: by its name, its title, the name's beginning or end, or a word of the title."""
    name, shown = env.lower().rstrip("*"), title.lower().strip()
    if name in ("proof", "figure", "table", "equation", "align", "document"):
        return None
    for word in (name, shown):
        if word in _TYPE_OF:
            return _TYPE_OF[word]
    for kind in ENVIRONMENTS:
        if name.startswith(kind) or name.endswith(kind) or kind in shown.split():
            return kind
    return None


@dataclass
class Declared:
    """A theorem environment: its type, the counter it steps, the counter that resets it, whether it has numbers."""

    type: str | None
    counter: str
    within: str | None = None
    numbered: bool = True


def declarations(source: str) -> tuple[dict[str, Declared], list[tuple[int, int]]]:
    """Environments by name, usual ones overlaid by \\newtheorem declarations, and the declarations' spans."""
    known = {n: Declared(k, n) for n, k in _TYPE_OF.items()}
    spans = []
    for m in re.finditer(r"\\newtheorem(\*?)\s*\{([^{}]+)\}\s*(?:\[([^\]]+)\])?", source):
        title = braced(source, m.end())
        if not title:
            continue
        within = re.compile(r"\s*\[([^\]]+)\]").match(source, title[1])
        shared = m[3] if m[3] and not m[1] else None
        known[m[2]] = Declared(canonical_type(m[2], title[0]), shared or m[2], None if shared else within and within[1], not m[1])
        spans.append((m.start(), within.end() if within else title[1]))
    return known, spans


@dataclass
class Counters:
    """Counters with their resets, replayed in document order."""

    within: dict[str, str | None]
    value: dict[str, int] = field(default_factory=dict)

    def step(self, name: str) -> None:
        self.value[name] = self.value.get(name, 0) + 1
        below = [name]
        while below:
            up = below.pop()
            for c, w in self.within.items():
                if w == up and c != name and self.value.get(c):
                    self.value[c] = 0
                    below.append(c)

    def shown(self, name: str) -> str:
        chain, at = [], name
        while at and at not in chain:
            chain.append(at)
            at = self.within.get(at)
        return ".".join(str(self.value.get(c, 0)) for c in reversed(chain))


def scan(source: str | None) -> list[dict]:
    """Rows of kind record (numbered statements), proof, other (labelled environments), section and declaration, by place.
    An environment ends at the first \\end of its name, so of nested ones of one name the outer closes early."""
    raw = source or ""
    text = masked(raw)
    known, declared = declarations(text)
    within: dict[str, str | None] = {d.counter: d.within for d in known.values() if d.within}
    within |= {"section": None, "subsection": "section", "subsubsection": "subsection"}
    if "\\chapter" in text:
        within |= {"chapter": None, "section": "chapter"}
    counters, rows, closed = Counters(within), [], -1
    for m in re.finditer(rf"\\begin\{{([A-Za-z]+\*?)\}}|\\({'|'.join(SECTIONS)})(\*?)\s*(?:\[[^\]]*\]\s*)?(?=\{{)", text):
        if any(s <= m.start() < e for s, e in declared):
            continue
        if m[2]:
            title = braced(text, m.end())
            if not m[3]:
                counters.step(m[2])
            rows.append({"kind": "section", "env": m[2], "type": None, "number": None if m[3] else counters.shown(m[2]), "label": None, "title": title and title[0], "start": m.start(), "end": title[1] if title else m.end()})
            continue
        env = m[1]
        stop = text.find(f"\\end{{{env}}}", m.end())
        if stop < 0 or env == "document" or m.start() < closed:
            continue
        end = stop + len(f"\\end{{{env}}}")
        body = text[m.end() : stop]
        label = re.search(r"\\label\s*\{([^{}]+)\}", body)
        option = re.match(r"\s*\[([^\]]*)\]", body)
        d = known.get(env) or known.get(env.rstrip("*"))
        kind = "proof" if env.rstrip("*") == "proof" else "record" if d and d.type else "other" if label else None
        if not kind:
            continue
        number = None
        if kind == "record" and d.numbered and not env.endswith("*"):
            counters.step(d.counter)
            number = counters.shown(d.counter)
        rows.append({"kind": kind, "env": env, "type": d.type if kind == "record" else None, "number": number, "label": label and label[1], "title": option and option[1], "start": m.start(), "end": end})
        closed = end if kind in ("record", "proof") else closed
    rows += [{"kind": "declaration", "env": None, "type": None, "number": None, "label": None, "title": None, "start": s, "end": e} for s, e in declared]
    return [r | {"text": raw[r["start"] : r["end"]]} for r in sorted(rows, key=lambda r: (r["start"], r["end"]))]


def source_model(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kind, env, type, number, label, title, start, end, text): `scan` of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.strip().split()[0] for c in ROW.split(",")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                rows = scan(b.column(1)[i].as_py())
                if rows:
                    cols = [pa.array([r[n] for r in rows], pa.int32() if n in ("start", "end") else pa.string()) for n in names]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows))), *cols], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ROW}")


def attached_proofs(model: DataFrame) -> DataFrame:
    """Records with `proof`: the first proof whose latest record ended at or before it is that record."""
    rows = model.where("kind in ('record', 'proof')")
    at = F.when(F.col("kind") == "record", F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy("doc_id").orderBy("_at", F.col("kind") == "proof").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = rows.withColumn("_at", at).withColumn("owner", F.last(F.when(F.col("kind") == "record", F.col("start")), ignorenulls=True).over(w))
    first = owned.where("kind = 'proof' and owner is not null").groupBy("doc_id", F.col("owner").alias("start")).agg(F.min_by("text", "start").alias("proof"))
    return rows.where("kind = 'record'").join(first, ["doc_id", "start"], "left")


def residual(model: DataFrame, docs: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, start, end, text) of what no row of the model covers, pieces of under `least` letters and digits left out."""
    sizes = docs.select("doc_id", F.char_length("text").alias("_n"), F.col("text").alias("_source"))
    ends = sizes.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end")).unionByName(sizes.select("doc_id", F.col("_n").alias("start"), F.col("_n").alias("end")))
    spans = model.select("doc_id", "start", "end").unionByName(ends)
    between = gaps(spans, "doc_id", F.lit(0), F.lit(0)).join(sizes, "doc_id")
    text = F.substring(F.col("_source"), F.col("start") + 1, F.col("end") - F.col("start"))
    return between.select("doc_id", "start", "end", text.alias("text")).where(F.length(F.regexp_replace("text", "(?U)[^\\w]|_", "")) >= least)


def protected_spans(model: DataFrame) -> DataFrame:
    """(doc_id, start, end, n): the model's spans, touching and overlapping ones joined."""
    return merged_spans(model.select("doc_id", "start", "end"), "doc_id")


def macros(source: str) -> dict[str, str]:
    """Plain \\newcommand and \\def macros; definitions with file, write or input commands are left out. Later ones win."""
    out, text = {}, masked(source)
    for m in re.finditer(r"\\(?:re)?newcommand\*?\s*(?:\{\s*(\\[A-Za-z]+)\s*\}|(\\[A-Za-z]+))\s*(?:\[\d\])?|\\def\s*(\\[A-Za-z]+)(?:#\d)*", text):
        body = braced(text, m.end())
        name = m[1] or m[2] or m[3]
        if body and not re.search(r"\\(?:input|include|write|openin|openout|read|immediate|catcode|csname)\b", body[0]):
            out[name] = body[0]
    return out
