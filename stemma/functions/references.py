"""Reference signals in statement texts: explicit, TeX, formula, relative and named references, triggers, labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Type names in both languages, and the verbs that announce a reference or a deduction.
TYPES = {"definition": "定义", "theorem": "定理", "proposition": "命题", "lemma": "引理", "corollary": "推论", "property": "性质", "axiom": "公理"}
REFERENCE_VERBS = ("根据", "由", "利用", "结合", "依照", "按照", "应用", "依据")
DEDUCTION_VERBS = ("可知", "可得", "得到", "推出", "得出", "于是", "因此", "同理可得", "故", "推知")

# The patterns of references; "type" and "number" are the groups they are read from.
PATTERNS = {
    "explicit_zh": r"(?P<type>定义|定理|命题|引理|推论|性质|公理)\s*§?\s*(?P<number>[0-9]+(?:[.\-][0-9]+)*(?:\([a-zA-Z0-9]+\))?)",
    "explicit_en": r"(?i)(?P<type>Definition|Theorem|Proposition|Lemma|Corollary|Property|Axiom)s?\s*(?P<number>[0-9]+(?:[.\-][0-9]+)*)",
    "tex": r"\\(?P<type>ref|eqref|autoref|cref|Cref|nameref)\s*\{(?P<number>[^{}]+)\}",
    "tex_link": r"\\(?P<type>hyperref)\s*\[(?P<number>[^\[\]]+)\]",
    "formula": r"(?i)(?:式|公式|equation|eq\.?)\s*[\(（]\s*(?P<number>[0-9]+(?:[.\-][0-9]+)*|[*∗★]+|[IVX]+)\s*[\)）]",
    "relative_formula": r"上式|下式|上面式子|前式|前一式",
    "relative": r"(?:上述|前述)(?P<type>定义|定理|命题|引理|推论|性质|公理)",
    "named": r"(?:由|根据|利用|应用|依据|按照)\s*(?P<number>[A-Z][A-Za-z\-]+(?:\s*[-–]\s*[A-Z][A-Za-z\-]+)?)\s*(?P<type>不等式|定理|引理|公式|法则|原理|恒等式)",
}
_NUMBER = r"[0-9]+(?:[.\-][0-9]+)*"


def _any(*words: str) -> str:
    """One of the words, longer ones first."""
    return f"(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})"


_ZH, _EN = _any(*TYPES.values()), _any(*TYPES)
HIT = ArrayType(StructType([*[StructField(n, StringType()) for n in ("kind", "type", "number", "surface")], StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(HIT)
def reference_hits(text: pd.Series) -> pd.Series:
    """All reference hits of a text, with code-point offsets, kind by kind and left to right. English types come as their
    Chinese names; each label of a TeX list is a hit of its own; a null text has none. An Arrow function, as the built-in
    functions give no offsets of all matches."""
    rules = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS.items()]
    found = []
    for t in text.fillna(""):
        rows = []
        for kind, rule in rules:
            for m in rule.finditer(t):
                parts = m.groupdict()
                name, number = parts.get("type"), parts.get("number")
                numbers = [x for x in map(str.strip, number.split(",")) if x] if kind in ("tex", "tex_link") else [number]
                label = kind if kind == "relative_formula" else kind.split("_")[0]
                name = TYPES.get(name.lower(), name) if kind == "explicit_en" else name
                rows += [(label, name, n, m[0], m.start(), m.end()) for n in numbers]
        found.append(rows)
    return pd.Series(found, index=text.index, dtype=object)


def triggers(text: Column) -> Column:
    """The reference and deduction verbs that occur in the text, each once, in list order."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.lit(v) for v in dict.fromkeys(REFERENCE_VERBS + DEDUCTION_VERBS)]), lambda v: F.contains(t, v))


def normal_label(label: Column) -> Column:
    """Full-width brackets and stops folded, white space removed."""
    return F.regexp_replace(F.translate(F.coalesce(label, F.lit("")), "（）．", "()."), "(?U)\\s+", "")


def free_text(text: Column) -> Column:
    """Digits, letters and Chinese characters, all else one blank."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "（）．", "()."), "[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+", " "))


def parsed_label(label: Column) -> Column:
    """struct(type, number) of a label such as "Theorem 2.1" or 定理2.1(a); null fields where it is no such label."""
    s, pattern = normal_label(label), f"(?i)^({_ZH}|{_EN})s?({_NUMBER}(?:\\([a-zA-Z0-9]+\\))?)$"
    name, number = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    zh = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.struct(F.when(name != "", F.coalesce(F.element_at(zh, F.lower(name)), name)).alias("type"), F.nullif(number, F.lit("")).alias("number"))


# The types that a heading or a unit's first word can name; the words that open a chapter or a proof, and the
# cues that announce a reference.
LOGICAL_TYPES = ("theorem", "lemma", "proposition", "corollary", "definition", "claim", "axiom", "property", "example", "exercise", "remark", "conjecture", "problem", "observation", "fact")
LOGICAL_TYPES_ZH = ("定理", "引理", "命题", "推论", "定义", "断言", "公理", "性质", "例", "练习", "注", "猜想", "问题")
DIVISIONS, DIVISIONS_ZH, PROOF_WORDS_ZH = ("chapter", "section", "appendix"), ("章", "节"), ("证明", "证")
REFERENCE_CUES = ("by", "see", "from", "using", "according to", "apply", "follows from", "theorem", "lemma", "proposition", "corollary", "definition", "reference", "参见", "由", "根据")

_TYPE, _TYPE_ZH = _any(*LOGICAL_TYPES), _any(*LOGICAL_TYPES_ZH)
#: A statement's number: digits with dotted or dashed parts, a letter before; Roman; or one capital.
_LABEL_NUMBER = "(?:" + "|".join(["[A-Za-z]?\\d+(?:[.\\-][A-Za-z0-9]+)*", "[IVXLCDM]+", "[A-Z]"]) + ")"


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty without one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.coalesce(F.get(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != ""), F.lit(0)), F.lit(""))


def heading(text: Column) -> Column:
    """struct(kind, type, number, title) of a unit that starts with a Markdown heading: logical (it names a type), else
    section; kind is null where the first line is no heading."""
    line = first_line(text)
    is_heading = line.rlike("^#{1,6}\\s+\\S")
    body = F.regexp_replace(line, "^#{1,6}\\s+", "")
    # type, then number, then a title in brackets or behind a dash or colon: each part read off what the one before leaves
    kind = F.regexp_extract(body, f"(?i)^{_TYPE}(?![A-Za-z])", 0)
    after = F.ltrim(F.substr(body, F.length(kind) + 1))
    number = F.regexp_extract(after, f"^{_LABEL_NUMBER}(?=[\\s.:：(–-]|$)", 0)
    rest = F.regexp_replace(F.ltrim(F.substr(after, F.length(number) + 1)), "^\\.\\s*", "")
    titled = (rest == "") | rest.rlike("^\\([^)]*\\)$") | rest.rlike("^[-–:：]")
    logical = is_heading & (kind != "") & titled
    plain = F.regexp_replace(body, "^\\d+(?:\\.\\d+)*\\.?\\s+", "")
    return F.struct(
        F.when(logical, "logical").when(is_heading, "section").alias("kind"),
        F.when(logical, F.lower(kind)).alias("type"),
        F.when(logical, F.nullif(number, F.lit(""))).alias("number"),
        F.when(logical, F.regexp_replace(rest, "^[\\s\\-–:：]+|[\\s\\-–:：]+$", "")).when(is_heading, plain).alias("title"),
    )


def unit_label(text: Column) -> Column:
    """struct(label, family) at a unit's start. A heading decides alone; else a custom tag goes before a numeric label, that
    before a named one."""
    t, h = F.trim(F.coalesce(text, F.lit(""))), heading(text)
    at_start = lambda pattern: F.regexp_extract(t, f"^({pattern})", 1)
    dotted = "[A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)"
    found = {
        "custom": F.coalesce(F.nullif(at_start("\\\\(?:tag|label)\\{[^{}]+\\}"), F.lit("")), at_start("[A-Z]\\d+")),
        "numeric": F.regexp_extract(t, f"^(\\({dotted}*\\)|{dotted}+[.:]?)\\s", 1),
        "named": F.rtrim(F.regexp_extract(t, f"(?i)^({_any(*LOGICAL_TYPES, *LOGICAL_TYPES_ZH)}(?:\\s*{_LABEL_NUMBER})?)(?=\\s*[.:：]|\\s|$)", 1)),
    }
    rows = [F.when(h["kind"] == "logical", F.struct(F.trim(F.concat_ws(" ", h["type"], h["number"])).alias("label"), F.lit("heading").alias("family")))]
    rows += [F.when(h["kind"].isNull() & (label != ""), F.struct(label.alias("label"), F.lit(family).alias("family"))) for family, label in found.items()]
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("family"))
    return F.coalesce(*rows, none)


def unit_flags(text: Column, is_first: Column) -> Column:
    """Boundary evidence of a unit: document_initial, heading_like, proof_like, subpart_like, embedded_reference (a cue
    somewhere before the first type with a number), paragraph_boundary."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^\\s+|\\s+$", "")
    item = "[a-zivxlcdm0-9]"
    cues = _any(*(c.replace(" ", "\\s+") for c in REFERENCE_CUES))
    before = F.regexp_extract(t, f"(?is)^(.*?)\\b{_TYPE}\\s+{_LABEL_NUMBER}\\b", 1)
    tests = {
        "heading_like": t.rlike(f"(?i)^(#{{1,6}}\\s|{_any(*DIVISIONS)}\\b|第.+[{''.join(DIVISIONS_ZH)}])"),
        "proof_like": t.rlike(f"(?iU)^(proof|{_any(*PROOF_WORDS_ZH)})\\b"),
        "subpart_like": t.rlike(f"(?i)^([(（]{item}+[)）]|[a-zivxlcdm][)])\\s"),
        "embedded_reference": before.rlike(f"(?iU)\\b{cues}\\b"),
        "paragraph_boundary": F.contains(F.coalesce(text, F.lit("")), F.lit("\n\n")),
    }
    return F.array_compact(F.array(F.when(is_first, "document_initial"), *[F.when(hit, name) for name, hit in tests.items()]))


def aliases(label: Column, title: Column, terms: Column) -> Column:
    """The ways a statement can be named, sorted: its label as it stands and normal, type and number in both languages with
    and without a blank, each with an anchor term before or behind, and a title of four characters or more."""
    en = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (v, k.capitalize())])
    p = parsed_label(label)

    def forms(name: Column) -> Column:
        plain, tight = F.concat_ws(" ", name, p["number"]), F.concat(name, p["number"])
        with_terms = F.flatten(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.array(F.concat_ws(" ", t, plain), F.concat(t, tight), F.concat_ws(" ", plain, t), F.concat(tight, t))))
        return F.when(p["number"].isNotNull() & name.isNotNull(), F.concat(F.array(plain, tight), with_terms)).otherwise(F.array().cast("array<string>"))

    known = F.filter(F.array(F.trim(label), normal_label(label), F.when(F.length(F.trim(title)) >= 4, F.trim(title))), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.concat(known, forms(p["type"]), forms(F.element_at(en, p["type"])))))
