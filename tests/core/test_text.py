import re
import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import mathtext as M
from stemma.functions import references as X
from stemma.functions import text as T
from stemma.operators import resolve
from stemma.operators import segment as S


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("\\sqrt{x}", "Sqrt(2,x)"), ("\\sqrt[3]{x+1}", "Sqrt(3,x+1)"), ("³√y", "Sqrt(3,y)"), ("x^2", "Power(x,2)"), ("f(x)^{n+1}", "Power(f(x),n+1)"),
        ("\\frac{a}{b}", "Div(a,b)"), ("\\frac{\\sqrt{a}}{b^2}", "Div(Sqrt(2,a),Power(b,2))"), ("\\int_{0}^{1} f(x) dx", "Integral(f(x),x,0,1)"),
        ("\\lim_{x \\to 0} f(x)", "Limit(f(x),x,0)"), ("a group G", "a group G"), ("\\int f dx", "\\int f dx"), ("", ""),
    ],
)
def test_function_form(given, wanted):
    assert M.rewritten(given) == wanted


def test_function_form_column(spark):
    df = spark.createDataFrame([("x^2",), (None,)], "t string").select(M.function_form("t").alias("t"))
    assert [r.t for r in df.collect()] == ["Power(x,2)", None]
    assert M.with_variables("x in xy, \\x", {"x": "SET_1", "xy": "SET_2"}) == "SET_1 in SET_2, \\x"
    assert [s for s, _, _ in M.bars_and_symbols("||v|| + |a| \\sim b", {"\\sim": []})] == ["||", "|", "\\sim"]


def test_units_rebuild_the_text():
    rng = random.Random(1)
    parts = ["# Head\n", "Text one. More text; and $a. b$ end.", "\n\n", "$$x\n\ny$$", " (1.2) Let x.", " Proof. Ok.", "\n \n", "\\[z\\]", "word "]
    for _ in range(200):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        got = S.units(text, 30)
        assert "".join(got) == text.lstrip() or "".join(got) == text[len(text) - len("".join(got)) :]
        assert all(u.strip() for u in got)
    assert S.units("# A\nbody\n\nnext") == ["# A\n", "body\n\n", "next"]
    assert S.cut_long("aa. bb. cc", 5) == ["aa.", " bb.", " cc"]


def test_batches_and_chunks():
    assert S.batches([3, 3, 9, 1], 6) == [0, 0, 1, 2]
    texts = [f"Sentence {i}. " for i in range(50)]
    got = S.chunks(texts, 200, 30, 2)
    assert got[0][1] == 0 and got[-1][2] == 50 and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and all(s <= c < e for s, c, e in got)
    assert S.balanced("\\begin{a}$x$\\end{a}") and not S.balanced("\\begin{a}") and not S.balanced("$x")


def test_unique_span():
    assert S.unique_span("abc def", "def") == (4, 7) and S.unique_span("aaa", "aa") is None and S.unique_span("x, y; Z!", "y z") == (3, 7)
    assert S.unique_span("abc", "zz") is None and S.unique_span("abc", " ") is None


def test_document_units(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.document_units(df).collect()) == [(1, 0, 0, "a\n\n"), (1, 1, 0, "b")]
    rows = spark.createDataFrame([(1, 0, "![i](u)"), (1, 1, "x ![i](u) y")], "doc_id long, pos int, text string")
    assert [(r.pos, r.text) for r in S.cleaned_units(rows).collect()] == [(0, "x  y")]


NODES = [(0, "definition", "定义 1", "由定义"), (1, "theorem", "定理 2", "x"), (2, "corollary", "推论 3", "由定理 2 和 Definition 1 及上述定理, 根据 Cauchy-Schwarz 不等式"), (3, "theorem", "定理 4", "见式(2.1), theorem 9, \\cref{a, b}")]


def test_reference_hits_and_resolution(spark):
    df = spark.createDataFrame([(1, *n) for n in NODES], "doc_id long, pos int, type string, label string, text string")
    hits = df.select("doc_id", "pos", F.posexplode(X.reference_hits("text")).alias("hit", "h")).select("doc_id", "pos", "hit", "h.*")
    got = {(r.pos, r.kind, r.type, r.number) for r in hits.collect()}
    assert got == {(2, "explicit", "定理", "2"), (2, "explicit", "定义", "1"), (2, "relative", "定理", None), (2, "named", "不等式", "Cauchy-Schwarz"), (3, "formula", None, "2.1"), (3, "explicit", "定理", "9"), (3, "tex", "cref", "a"), (3, "tex", "cref", "b")}
    for r in hits.collect():
        assert NODES[r.pos][3][r.start : r.end] == r.surface
    parsed = df.withColumn("p", X.parsed_label(F.col("label")))
    nodes = parsed.select("doc_id", "pos", "p.type", "p.number", F.array("label").alias("aliases"), F.when(F.col("pos") == 1, "a").alias("tex_label"), F.lit(None).cast("string").alias("title"))
    index = resolve.label_index(nodes)
    links = resolve.resolved(hits.where("kind in ('explicit', 'tex')"), index)
    assert {(r.pos, r.number, r.target, r.reason) for r in links.collect()} == {(2, "2", 1, None), (2, "1", 0, None), (3, "9", None, "no_candidate"), (3, "a", 1, None), (3, "b", None, "no_candidate")}
    edges = {(r.dependent, r.support, r.relation) for r in resolve.explicit_edges(links, nodes).collect()}
    assert edges == {(2, 1, "logic"), (2, 0, "definition"), (3, 1, "logic")}


def test_forward_repair(spark):
    hits = spark.createDataFrame([(1, 0, 0, "explicit", "定理", "5", "定理 5")], "doc_id long, pos int, hit int, kind string, type string, number string, surface string")
    nodes = spark.createDataFrame([(1, 3, "定理", "5", ["定理5"], None, None)], "doc_id long, pos int, type string, number string, aliases array<string>, tex_label string, title string")
    index = resolve.label_index(nodes)
    links = resolve.resolved(hits, index)
    assert links.first().reason == "only_forward_candidate"
    assert resolve.forward_repairs(links, index).first().target == 3


def test_labels_headings_flags(spark):
    rows = ["# Theorem 2.1 (Main)\nx", "## 3. Results", "Lemma A. text", "(2.3) Let x", "\\tag{5} y", "plain", None, "Proof. By Theorem 2\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", X.heading(F.col("t")).alias("h"), X.unit_label(F.col("t")).alias("u"), X.unit_flags(F.col("t"), F.col("i") == 0).alias("f"), X.triggers(F.lit("由此可知")).alias("g")).orderBy("i").collect()
    assert (got[0].h.kind, got[0].h.type, got[0].h.number, got[0].h.title) == ("logical", "theorem", "2.1", "(Main)")
    assert (got[1].h.kind, got[1].h.title) == ("section", "Results")
    assert [r.u.label for r in got] == ["theorem 2.1", None, "Lemma A", "(2.3)", "\\tag{5}", None, None, None]
    assert got[0].f[0] == "document_initial" and {"proof_like", "embedded_reference", "paragraph_boundary"} == set(got[7].f)
    assert got[0].g == ["由", "可知"]


def test_tokens_and_similarity(spark):
    row = spark.createDataFrame([("Let \\alpha x y12 群论的 3.5",)], "t string").select(T.math_tokens(F.col("t")).alias("a"), T.jaccard(F.array(F.lit(1)), F.array().cast("array<int>")).alias("j"), T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert sorted(row.a) == sorted(["let", "\\alpha", "y12", "群论", "论的", "群论的", "3.5"]) and row.j == 0 and row.c == 0
    red = spark.range(1).select(T.redact_url(F.lit("https://h/p?a=1&Signature=x&token=y#f")).alias("u"), T.redact_text(F.lit("api_key=abc Bearer zz.yy s3cr"), ("s3cr",)).alias("t")).first()
    assert red.u == "https://h/p?a=1#f" and not re.search("abc|zz|s3cr", red.t)


def test_substitution_to_a_fix_point(spark):
    import re

    from stemma.functions.text import substituted

    rules = [("c", "d"), ("b", "c"), ("a", "b"), ("xy", "yx"), ("(z+)!", "$1z!"), ("1", "2"), ("2", "1")]

    def brute(t):
        rounds = 0
        once = lambda t: [t := re.sub(p, r.replace("$1", r"\1"), t) for p, r in rules][-1]
        for _ in range(5):
            if (now := once(t)) == t:
                break
            t, rounds = now, rounds + 1
        return t, rounds, once(t) == t

    texts = ["a", "b", "abc", "xxyy", "xxxxxxxxy", "z!", "1", "12", "", "plain", "a1xy"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(substituted(F.col("t"), rules).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [*map(brute, texts), (None, 0, True)]
    assert not brute("z!")[2] and brute("a") == ("d", 3, True)
