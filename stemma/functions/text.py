"""Text functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form: the one step that no built-in function does."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """NFC form."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def folded(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def content_id(text: Column) -> Column:
    """MD5 of the NFC text with folded white space."""
    return F.md5(folded(nfc(text)).cast("binary"))


# Tokens that say nothing of a statement.
GENERIC_TOKENS = ()
_TOKEN = "\\\\[a-z]+|[a-z][a-z0-9_]*|\\d+(?:\\.\\d+)*|[\\x{4e00}-\\x{9fff}]+"


def math_tokens(text: Column, generic: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    """LaTeX commands, identifiers, numbers, and the 2- and 3-grams of Chinese runs of lower-cased text, as a bag.

    Single letters and generic tokens go; digits stay. Give NFKC text where full-width forms may occur.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))

    def grams(t: Column) -> Column:
        def of(size: int) -> Column:
            n = F.length(t) - size + 1
            return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

        return F.when(t.rlike("^[\\x{4e00}-\\x{9fff}]"), F.concat(of(2), of(3))).otherwise(F.array(t))

    kept = F.filter(F.flatten(F.transform(found, grams)), lambda t: ~t.rlike("^[a-z]$"))
    return F.filter(kept, lambda t: ~t.isin(*generic)) if generic else kept


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is null, empty, of another length or of norm 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot / (norm(a) * norm(b))).otherwise(0.0)


def raw_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length, not a number where either is of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(float("nan")))


# URL parameters that carry a signature or a secret, and words that introduce one in text.
SECRET_PARAMETERS = ("signature", "token", "access_token", "expires", "ossaccesskeyid", "x-oss-signature", "x-amz-signature", "x-amz-credential", "x-amz-security-token", "utm_source", "ref")


def redact_url(url: Column, names: tuple[str, ...] = SECRET_PARAMETERS) -> Column:
    """The url without the named query parameters."""
    gone = F.regexp_replace(url, f"(?i)([?&])(?:{'|'.join(names)})=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(gone, "&{2,}", "&"), "\\?&+", "?"), "[?&]+(?=#|$)", "")


def redact_text(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """The text with given secrets, bearer tokens and key=value secrets masked."""
    for s in sorted(secrets, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    text = F.regexp_replace(text, "(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.regexp_replace(text, "(?i)\\b(api[_-]?key|password|secret|token)(\\s*[=:]\\s*)[^\\s&,;]+", "$1$2[redacted]")


def first_filled(*names: str) -> Column:
    """The first of the columns that has more than white space; empty without one."""
    return F.coalesce(*[F.when(F.trim(n) != "", F.col(n)) for n in names], F.lit(""))


def json_hash(json: Column) -> Column:
    """SHA-256 of a flat JSON object with its keys in order and no blanks; null for text that is no object."""
    keys = F.array_sort(F.json_object_keys(json))
    raw = F.from_json(json, "map<string,string>")
    quoted = F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.element_at(raw, k)))
    return F.sha2(F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")), 256)


def substituted(text: Column, rules: list[tuple[str, str]], most: int = 5) -> Column:
    """struct(text, rounds, settled): each rule (pattern, replacement) applied in turn, all of them again until a round changes
    nothing, in at most so many rounds. rounds counts those that changed something; a text that still changed in the last
    one isn't settled. Rules that undo each other within a round change nothing. A null text stays null, settled."""

    def once(t: Column) -> Column:
        for pattern, replacement in rules:
            t = F.regexp_replace(t, pattern, replacement)
        return t

    state = lambda t, n, done: F.struct(t.alias("text"), n.cast("int").alias("rounds"), done.alias("settled"))

    def step(acc: Column, _: Column) -> Column:
        now = once(acc["text"])
        return F.when(acc["settled"] | now.eqNullSafe(acc["text"]), state(acc["text"], acc["rounds"], F.lit(True))).otherwise(state(now, acc["rounds"] + 1, F.lit(False)))

    # one round more than counts, which only tells whether the last one settled the text
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), state(text, F.lit(0), F.lit(False)), step)
    return F.struct(end["text"].alias("text"), end["rounds"].alias("rounds"), (end["settled"] | once(end["text"]).eqNullSafe(end["text"])).alias("settled"))
