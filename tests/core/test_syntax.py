import json
import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import syntax as S


def atom(v):
    t = str(v)
    return t if t and not any(c.isspace() or c in '()"\\' for c in t) else json.dumps(t, ensure_ascii=False)


def set_lines(parts, broken):
    if broken or any("\n" in p for p in parts):
        return "\n".join([parts[0], *("\n".join("  " + x for x in p.split("\n")) for p in parts[1:])])
    return " ".join(parts)


def brute(t):
    """The text of a tree without faults, by its own recursion over the few kinds that the generator makes."""
    if isinstance(t, list):
        inner = [brute(x) for x in t]
        return "(\n" + "\n".join("\n".join("  " + y for y in x.split("\n")) for x in inner) + "\n)" if any("\n" in x for x in inner) else f"({' '.join(inner)})"
    if not isinstance(t, dict):
        return atom(t)
    k = t["kind"]
    if k == "sym_ref":
        return atom(t["sym_id"])
    if k == "forall":
        names = " ".join(f"({atom(v['sym_id'])} {atom(v['sort'])})" for v in t["vars"])
        return "(" + set_lines([f"Forall ({names})", brute(t["body"])], True) + ")"
    if k == "not":
        return "(" + set_lines(["Not", brute(t["arg"])], brute(t["arg"]).startswith("(")) + ")"
    parts = {"pred": lambda: [atom(t["pred_id"]), *map(brute, t["args"])], "app": lambda: ["App", brute(t["fn"]), *map(brute, t["args"])]}.get(k, lambda: [{"and": "And", "eq": "Eq", "mod_p": "ModP"}[k], *(brute(t[s]) for s in ("left", "right", "why") if s in t)])()
    return "(" + set_lines(parts, k == "and") + ")"


def tree(r, depth):
    if depth == 0 or r.random() < 0.15:
        return r.choice([{"kind": "sym_ref", "sym_id": r.choice(["x", "a b", 'q"\\', "", "\t", "定"])}, 7, True, None, 1.5, "s(t"])
    sub = lambda: tree(r, depth - 1)
    return r.choice([
        lambda: {"kind": "and", "right": sub(), "left": sub()}, lambda: {"kind": "eq", "left": sub(), "right": sub()}, lambda: {"kind": "not", "arg": sub()}, lambda: {"kind": "pred", "pred_id": "P", "args": [sub() for _ in range(r.randrange(4))]},
        lambda: {"kind": "app", "fn": sub(), "args": [sub()]}, lambda: {"kind": "forall", "vars": [{"sym_id": "x", "sort": "R R"}] * r.randrange(3), "body": {"kind": "not", "arg": sub()}},
        lambda: {"kind": "mod_p", "left": sub(), "why": [sub() for _ in range(r.randrange(3))], "right": sub()},
    ])()


def render(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "tree long, text string")
    return {r.tree: r.text for r in S.rendered(S.flat_nodes(rows)).collect()}


def test_rendered_equals_brute_force(spark):
    r = random.Random(5)
    trees = [{"kind": "not", "arg": tree(r, n % 6)} for n in range(150)]
    assert render(spark, [json.dumps(t) for t in trees]) == {i: brute(t) for i, t in enumerate(trees)}


@pytest.mark.parametrize("rows", [[]])
def test_no_trees(spark, rows):
    nodes = S.flat_nodes(spark.createDataFrame(rows, "tree long, text string"))
    assert S.rendered(nodes).count() == 0


def test_kinds_and_faults(spark):
    x, error = {"kind": "sym_ref", "sym_id": "x"}, lambda m: f'(RenderError "ValueError" {json.dumps(m)})'
    lacks = lambda kind, f: error(f"logic_ast node kind={kind!r} missing required field {f!r}")
    bad = {"kind": "le", "left": x}
    cases = [
        ({"kind": "sum", "term": x}, "(Sum x)"), ({"kind": "sum", "term": x, "over": "S"}, "(SumOver S x)"), ({"kind": "sum", "to": 9, "from": 1, "index": "i", "term": x}, "(Sum i 1 9 x)"), ({"kind": "sum", "to": 9, "index": "i", "term": x}, "(Sum i x)"),
        ({"kind": "mul", "left": x, "right": 2}, "(Mul x 2)"), ({"kind": "mul", "args": [1, 2, 3]}, "(Mul 1 2 3)"), ({"kind": "inner_product", "left": x, "right": x, "group": "G"}, "(InnerProduct x x G)"), ({"kind": "conjugates", "group": "G", "element": x}, "(Conjugates x G)"),
        ({"kind": "restriction", "fn": x, "domain": "D"}, "(Restriction x D)"), ({"kind": "restriction", "function": None, "fn": x, "domain": "D"}, "(Restriction None D)"), ({"kind": "restriction", "fn": None, "domain": "D"}, lacks("restriction", "function")),
        ({"kind": "app", "fn": {"kind": "pred", "pred_id": "f"}, "args": []}, "(App f)"), ({"kind": "app", "fn": x}, lacks("app", "args")), ({"kind": "app", "fn": x, "args": 3}, error("logic_ast node kind='app' field 'args' must be a list")),
        ({"kind": "ABC_d", "z": 1}, "(ABCD 1)"), ({"kind": "ABC", "z": [], "arg": 4, "fn": {"kind": "pred", "pred_id": "g"}, "args": [x]}, "(ABC g x 4 ())"), ({"kind": "two words", "arg": 1}, '("Two words" 1)'),
        ({"kind": "lam", "vars": [{"sym_id": "x", "sort": "R"}], "body": x, "e": [1, x]}, "(Lam ((x R))\n  x\n  (1 x))"), ({"kind": "lam", "body": x}, error("logic_ast node kind='lam' requires both 'vars' and 'body'")), ({"kind": "pair", "left": x}, error("logic_ast node kind='pair' requires both 'left' and 'right'")),
        ({"kind": "f", "fn": x}, error("logic_ast node kind='f' requires 'args' when 'fn' is present")), ({"kind": "forall", "vars": [3], "body": x}, error("logic_ast binder variable must be a dict")), ({"kind": "forall", "vars": [{"sym_id": "x"}], "body": x}, lacks("<missing-kind>", "sort")),
        ({"kind": "forall", "vars": [3], "body": bad}, lacks("le", "right")), ({"kind": "exists", "vars": [], "body": [x]}, error("logic_ast node must be a dict")), ({"kind": "eq", "right": {"kind": "abs"}, "left": bad}, lacks("le", "right")), ({"kind": ""}, error("logic_ast node missing required field 'kind'")),
        ({"kind": "not", "arg": {"a": 1}}, lacks("<missing-kind>", "kind")), ({"kind": 3}, error("logic_ast node missing required field 'kind'")), ([x], error("logic_ast node must be a dict")), ({"kind": "pred", "pred_id": "P", "args": [{"kind": "pred", "pred_id": "Q"}]}, lacks("pred", "args")),
    ]
    texts = [json.dumps(t) for t, _ in cases] + [None, "{", "[" * 5000]
    want = {i: w for i, (_, w) in enumerate(cases)} | {len(cases) + i: error("logic_ast node must be a dict") for i in range(3)}
    assert render(spark, texts) == want


def test_rewritten(spark):
    x, p = {"kind": "sym_ref", "sym_id": "x"}, lambda name, *args: {"kind": "pred", "pred_id": name, "args": list(args)}
    cases = [
        (p("P", p("P")), "(Q (Q))"), (p("IRR", p("P", x), p("P"), 9), "(In (P x) (App Irr (P)))"), (p("SUB", p("SUB", 1, 2), p("P", p("IRR", 1, 2)), 3), "(Subset (SUB 1 2) (P (IRR 1 2)))"), (p("POW", x, [x, 2]), "(Power x (x 2))"),
        (p("DIV", 1, p("P")), "(Div 1 (P))"), (p("ORD", x, 2), "(Order x)"), (p("MUL", 1, 2, p("P")), "(Mul 1 2 (P))"), (p("ONE"), "(Int 1)"), (p("TWO"), "(Int 2)"), (p("ONE", p("P")), "(ONE (P))"), (p("IND", 1, 2, 3), "(IND 1 2 3)"),
        ({"kind": "eq", "left": p("IND", 1, p("P"), 3), "right": p("RES", 1, 2)}, "(Eq (App IndPower 1 (P) 3) (RES 1 2))"), ({"kind": "app", "fn": {"kind": "pred", "pred_id": "P"}, "args": [p("RES", 1, 2, 3, 4)]}, "(App Q (App ResPower 1 2 3 4))"),
        (p("ODD", p("P")), "(ODD (P))"), ({"kind": "and", "left": p("SUB", 1), "right": p("P")}, "(And\n  (SUB 1)\n  (Q))"), ({"kind": "app", "fn": {"kind": "pred", "pred_id": "SUB"}, "args": [p("P")]}, "(App SUB (Q))"),
        ({"kind": "and", "left": p("IRR", 1, 2), "right": {"kind": "and", "left": p("TWO"), "right": p("IRR", p("TWO"), [p("P")])}}, "(And\n  (In 1 (App Irr 2))\n  (And\n    (Int 2)\n    (In (TWO) (App Irr ((P))))))"),
    ]
    nodes = S.flat_nodes(spark.createDataFrame([(i, json.dumps(t)) for i, (t, _) in enumerate(cases)], "tree long, text string"))
    keys = {"IRR": "IRR_MEMBERSHIP", "SUB": "SUBSET_RELATION", "POW": "POWER_OPERATOR", "DIV": "DIV_OPERATOR", "ORD": "ORDER_OPERATOR", "MUL": "MUL_OPERATOR", "ONE": "ONE_CONSTANT", "TWO": "TWO_CONSTANT", "IND": "IND_POWER_OPERATOR", "RES": "RES_POWER_OPERATOR", "ODD": "OTHER"}
    every = range(len(cases))
    fixed = spark.createDataFrame([(i, k, v) for i in every for k, v in keys.items()], "tree long, pred_id string, semantic_key string")
    renamed = spark.createDataFrame([(i, "P", "Q") for i in every] + [(0, "SUB", "never")], "tree long, pred_id string, canonical string")
    trees, misuses = S.rewritten(nodes, renamed, fixed)
    assert {r.tree: r.text for r in S.rendered(trees).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    assert {(m.tree, m.pred_id, m.args_count) for m in misuses.collect()} == {(9, "ONE", 1), (10, "IND", 3), (11, "RES", 2), (14, "SUB", 1), (15, "SUB", 0)}


def _any_tree(rng, depth):
    kinds = [*S.FORMS, "sym_ref", "mul", "sum", "restriction", "pred", "pred", "pred", "odd_kind", "ODD", "q t", "", None, 3]
    fields = ["left", "right", "arg", "args", "fn", "function", "domain", "element", "set", "base", "exponent", "index", "from", "to", "term", "over", "value", "vars", "body", "sym_id", "sort", "pred_id", "modulus", "group", "count", "other"]
    roll = rng.random()
    if depth <= 0 or roll < 0.12:
        return rng.choice(["x", "A b", "", "a\"b", "line\nbreak", None, 1, 2.5, True, "é", "\u00a0", "\x1c", {"kind": "sym_ref", "sym_id": "s"}])
    if roll < 0.2:
        return [_any_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    kind, v = rng.choice(kinds), {}
    if rng.random() < 0.95:
        v["kind"] = kind
    below = lambda: _any_tree(rng, depth - 1)
    if isinstance(kind, str) and kind in S.FORMS and rng.random() < 0.8:
        wanted = [w.rstrip("*") for w in S.FORMS[kind][1]] + ([S.OPTIONAL[kind]] if kind in S.OPTIONAL and rng.random() < 0.5 else [])
    else:
        wanted = rng.sample(fields, rng.randrange(5))
    rng.shuffle(wanted)
    for w in wanted:
        if rng.random() < 0.96:
            v[w] = rng.choice(["F", "G", "P1", "P2", "U", "", 7]) if w == "pred_id" else [below() for _ in range(rng.randrange(4))] if w == "args" and rng.random() < 0.95 else [{"sym_id": "x", "sort": rng.choice(["Real", "a b", None])} if rng.random() < 0.9 else below() for _ in range(rng.randrange(3))] if w == "vars" and rng.random() < 0.95 else below()
    return v


def test_a_tree_at_a_time_is_the_same(spark, monkeypatch):
    rng = random.Random(11)
    texts = [json.dumps(_any_tree(rng, 4)) for _ in range(3000)] + [None, "{", "3", "[]", "null", "{}"]
    trees = spark.createDataFrame(list(enumerate(texts)), "tree long, text string")
    renamed = trees.where("tree % 2 = 0").select("tree", F.lit("P1").alias("pred_id"), F.lit("New one").alias("canonical"))
    keys = [*S.FIXED, "UNKNOWN"]
    fixed = spark.createDataFrame([(i, n, keys[(i + 5 * k) % len(keys)]) for i in range(len(texts)) for k, n in enumerate(("F", "G", "U")) if i % 7], "tree long, pred_id string, semantic_key string")
    flat, wrong = S.rewritten(S.flat_nodes(trees), renamed, fixed)
    want, got = ({r.tree: r.text for r in d.collect()} for d in (S.rendered(flat), S.statements(trees, renamed, fixed)))
    odd = [(texts[i], want[i], got[i]) for i in want if want[i] != got[i]]
    assert not odd[:3] and len(got) == len(texts) and sum("RenderError" not in t for t in got.values()) > 100
    assert sorted(map(tuple, wrong.drop("id").collect())) == sorted(map(tuple, S.misuses(trees, fixed).collect()))


def test_queries_take_a_tree_at_a_time(spark, tmp_path, monkeypatch):
    """A row for each node, and a round of jobs for each level of a tree."""
    from stemma.queries import QUERIES

    monkeypatch.setattr(S, "written", None)
    deep = {"kind": "sym_ref", "sym_id": "x"}
    for _ in range(2000):
        deep = {"kind": "not", "arg": deep}
    text = S.statements(spark.createDataFrame([(1, json.dumps(deep))], "tree long, text string"), *(spark.createDataFrame([], f"tree long, pred_id string, {c} string") for c in ("canonical", "semantic_key"))).first().text
    assert text.count("(Not") == 2000 and text.endswith("x" + ")" * 2000)
    assert QUERIES["statement_forms"](spark, "/root/testdata/sf0.001").count() > 1000 and QUERIES["operator_misuses"](spark, "/root/testdata/sf0.001").count() > 100
