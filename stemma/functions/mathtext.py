"""Rewriting of math text to function form: Sqrt(n,x), Power(b,e), Div(a,b), Integral(f,x,a,b), Limit(f,x,a).

A small reader takes the text apart into commands, groups, scripts and atoms and writes it back; nested forms come out
in one pass, since a group's content is rewritten when it's read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|\s+|.", re.DOTALL)
# Superscript digits, and the names of each operator's command.
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ", "0123456789n")
FRACTIONS = ("\\frac", "\\dfrac", "\\tfrac")
INTEGRALS = ("\\int", "\\iint", "\\iiint", "\\oint", "∫", "∬", "∭", "∮")
ARROWS = ("\\to", "\\rightarrow", "\\Rightarrow", "->", "→")


class _Reader:
    def __init__(self, text: str):
        self.t = _TOKEN.findall(text)
        self.i = 0

    def peek(self, skip: bool = True) -> str:
        j = self.i
        while skip and j < len(self.t) and self.t[j].isspace():
            j += 1
        return self.t[j] if j < len(self.t) else ""

    def take(self) -> str:
        while self.i < len(self.t) and self.t[self.i].isspace():
            self.i += 1
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def group(self, close: str) -> str:
        """The rewritten content up to the closing mark; the opening one is taken already."""
        out: list[str] = []
        while self.i < len(self.t) and self.peek(False) != close:
            self.item(out)
        self.i += 1
        return "".join(out).strip()

    def argument(self) -> str:
        """A braced group or one atom."""
        tok = self.take()
        if tok == "{":
            return self.group("}")
        if tok in "+-" and tok and self.peek(False):
            return tok + self.take()
        return tok

    def item(self, out: list[str]) -> None:
        """Read one construct and append its rewriting."""
        tok = self.t[self.i]
        self.i += 1
        if tok == "\\sqrt" or tok == "√":
            order = "2"
            if tok == "\\sqrt" and self.peek() == "[":
                self.take()
                order = self.group("]")
            if out and tok == "√" and (m := re.fullmatch("[⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ]+", out[-1])):
                order = m[0].translate(SUPERSCRIPTS)
                out.pop()
            out.append(f"Sqrt({order},{self.argument()})")
        elif tok in FRACTIONS and self.peek() == "{":
            a = self.argument()
            out.append(f"Div({a},{self.argument()})")
        elif tok in INTEGRALS and self._integral(out):
            pass
        elif tok in ("\\lim", "lim") and self._limit(out):
            pass
        elif tok == "^" and out and (base := self._base(out)):
            out.append(f"Power({base},{self.argument()})")
        elif tok in "({[" and tok:
            close = {"(": ")", "{": "}", "[": "]"}[tok]
            inner = self.group(close)
            call = out and tok == "(" and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", out[-1])
            out.append((out.pop() if call else "") + f"{tok}{inner}{close}")
        else:
            out.append(tok)

    @staticmethod
    def _base(out: list[str]) -> str:
        while out and out[-1].isspace():
            out.pop()
        base = out.pop() if out else ""
        return base[1:-1] if base[:1] == "{" and base[-1:] == "}" else base

    def _integral(self, out: list[str]) -> bool:
        at, low, high = self.i, "", ""
        if self.peek() == "\\limits":
            self.take()
        for _ in range(2):
            if self.peek() in ("_", "^"):
                if self.take() == "_":
                    low = self.argument()
                else:
                    high = self.argument()
        body: list[str] = []
        while low and high and self.i < len(self.t):
            d = re.fullmatch(r"d([A-Za-z]+)", self.peek(False))
            if d and "".join(body).strip():
                self.i += 1
                text = re.sub(r"\\,\s*\Z", "", "".join(body).strip()).strip()
                out.append(f"Integral({text},{d[1]},{low},{high})")
                return True
            self.item(body)
        self.i = at
        return False

    def _limit(self, out: list[str]) -> bool:
        at = self.i
        if self.peek() == "_":
            self.take()
            script = self.argument()
            parts = re.split("|".join(map(re.escape, ARROWS)), script, maxsplit=1)
            body: list[str] = []
            while len(parts) == 2 and self.i < len(self.t) and not re.match(r"[,;.=+]|\Z", self.peek()):
                self.item(body)
            text = "".join(body).strip()
            if len(parts) == 2 and text:
                out.append(f"Limit({text},{parts[0].strip()},{parts[1].strip()})")
                return True
        self.i = at
        return False


def rewritten(text: str | None) -> str | None:
    """The text with roots, powers, fractions, integrals and limits in function form."""
    if text is None:
        return None
    reader, out = _Reader(text), []
    while reader.i < len(reader.t):
        reader.item(out)
    return "".join(out)


@F.pandas_udf(StringType())
def function_form(text: pd.Series) -> pd.Series:
    """`rewritten` over a column."""
    return text.map(rewritten)


def with_variables(text: str, names: dict[str, str]) -> str:
    """The text with each variable replaced by its typed name, longest first, whole identifiers only, none twice."""
    if not names:
        return text
    parts = "|".join(rf"(?<![A-Za-z0-9_\\]){re.escape(n)}(?![A-Za-z0-9_])" for n in sorted(names, key=len, reverse=True))
    return re.sub(parts, lambda m: names[m[0]], text)


def bars_and_symbols(text: str, symbols: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """Ambiguous places, none overlapping: ||…||, then |…|, then symbols, longest first. (symbol, start, end) by start."""
    taken, out = [False] * len(text), []
    for name, pattern in [("||", r"\|\|[^|]+\|\|"), ("|", r"(?<!\|)\|[^|\n]+\|(?!\|)"), *[(s, re.escape(s)) for s in sorted(symbols, key=len, reverse=True)]]:
        for m in re.finditer(pattern, text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                out.append((name, m.start(), m.end()))
    return sorted(out, key=lambda x: x[1])
