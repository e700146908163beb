"""Formal statements as flat tables of tree nodes: read from JSON, predicates rewritten, rendered bottom-up."""

from __future__ import annotations

import functools
import json
import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.state import shared_dir, written

# Names of kinds with the fields each needs in order (`args*`: the list's items; `fn*`: a predicate without
# arguments stands for its name), the optional ones behind them, and the kinds always set on several lines.
FORMS = {
    "imp": ("Imp", ["left", "right"]), "iff": ("Iff", ["left", "right"]), "and": ("And", ["left", "right"]), "or": ("Or", ["left", "right"]),
    "eq": ("Eq", ["left", "right"]), "le": ("LE", ["left", "right"]), "sub": ("Sub", ["left", "right"]), "set_diff": ("SetDiff", ["left", "right"]), "div": ("Div", ["left", "right"]),
    "not": ("Not", ["arg"]), "abs": ("Abs", ["arg"]), "conjugate": ("Conjugate", ["arg"]), "order": ("Order", ["arg"]), "int": ("Int", ["value"]),
    "in": ("In", ["element", "set"]), "power": ("Power", ["base", "exponent"]), "index": ("Index", ["group", "subgroup"]), "set_comprehension": ("SetComprehension", ["element", "index"]),
    "congruent_mod": ("CongruentMod", ["left", "right", "modulus"]), "congruence_class": ("CongruenceClass", ["value", "modulus"]),
    "inner_product": ("InnerProduct", ["left", "right"]), "conjugates": ("Conjugates", ["element", "group"]),
    "app": ("App", ["fn*", "args*"]), "pred": (None, ["pred_id", "args*"]), "forall": ("Forall", ["vars", "body"]), "exists": ("Exists", ["vars", "body"]),
}
OPTIONAL = {"inner_product": "group", "conjugates": "count"}
MULTILINE = ("imp", "iff", "and", "or")
# What a fixed operator's predicate becomes: kind, the fields its arguments go to, how many it needs.
FIXED = {
    "IRR_MEMBERSHIP": ("in", ["element"], 2), "SUBSET_RELATION": ("subset", ["left", "right"], 2), "POWER_OPERATOR": ("power", ["base", "exponent"], 2),
    "DIV_OPERATOR": ("div", ["left", "right"], 2), "ORDER_OPERATOR": ("order", ["arg"], 1), "MUL_OPERATOR": ("mul", [], 2),
    "ONE_CONSTANT": ("int", [], 0), "TWO_CONSTANT": ("int", [], 0), "IND_POWER_OPERATOR": ("app", [], 3), "RES_POWER_OPERATOR": ("app", [], 3),
}
CONSTANTS = {"ONE_CONSTANT": "1", "TWO_CONSTANT": "2"}
FUNCTIONS = {"IRR_MEMBERSHIP": "Irr", "IND_POWER_OPERATOR": "IndPower", "RES_POWER_OPERATOR": "ResPower"}
TERM_PARENTS = ("eq", "app", "power", "mul", "sum", "in")
REASONS = {
    "IRR_MEMBERSHIP": "Irr membership rewrite requires character and group arguments", "SUBSET_RELATION": "Subset rewrite requires two arguments",
    "POWER_OPERATOR": "Power rewrite requires base and exponent arguments", "DIV_OPERATOR": "Div rewrite requires two arguments", "ORDER_OPERATOR": "Order rewrite requires one argument",
    "MUL_OPERATOR": "Mul rewrite requires at least two arguments", "ONE_CONSTANT": "One constant rewrite expects zero arguments", "TWO_CONSTANT": "Two constant rewrite expects zero arguments",
    "IND_POWER_OPERATOR": "IndPower is a term operator; predicate position or missing args is unsafe to rewrite", "RES_POWER_OPERATOR": "ResPower is a term operator; predicate position or missing args is unsafe to rewrite",
}
NO_LIST = "fixed predicate node is missing list field 'args'"

#: Ids go up by this step in reading order, so that a rewrite has room for nodes of its own.
STEP = 4
#: Fields whose value is a name even where it isn't text.
_NAMES = ("sym_id", "sort", "pred_id")
_FIELDS = "id long, last long, parent long, depth int, place int, slot string, shape string, kind string, shown string, value string, name string, within string, size int"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (f.split() for f in _FIELDS.split(", "))])


def _walk(text: str | None) -> list[dict]:
    """A tree's nodes in reading order. Null, malformed or too deeply nested text is one atom."""
    try:
        top = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        top = None
    out: list[dict] = []
    stack = [(top, None, 0, 0, None, "", None)]
    while stack:
        v, parent, depth, place, slot, within, name = stack.pop()
        node = {"id": len(out) * STEP, "parent": parent, "depth": depth, "place": place, "slot": slot, "within": within, "name": name, "size": 0}
        out.append(node)
        if isinstance(v, dict) and slot not in _NAMES:
            kind = v.get("kind")
            fields = [(k, x) for k, x in v.items() if k != "kind"]
            own = str(v["pred_id"]) if kind == "pred" and v.get("pred_id") else None
            node |= {"shape": "object", "kind": kind if isinstance(kind, str) else None, "shown": repr(v.get("kind", "<missing-kind>")), "value": None if "kind" in v else "unnamed", "name": own, "size": len(fields)}
            inner = kind if isinstance(kind, str) else ""
            stack += [(x, node["id"], depth + 1, i, k, inner, own if k == "pred_id" else None) for i, (k, x) in reversed(list(enumerate(fields)))]
        elif isinstance(v, list) and slot not in _NAMES:
            node |= {"shape": "list", "size": len(v)}
            stack += [(x, node["id"], depth + 1, i, None, within, None) for i, x in reversed(list(enumerate(v)))]
        else:
            node |= {"shape": "null" if v is None else "atom", "value": str(v)}
    at = {n["id"]: n for n in out}
    for n in reversed(out):
        n["last"] = max(n.get("last", 0), n["id"])
        if n["parent"] is not None:
            up = at[n["parent"]]
            up["last"] = max(up.get("last", 0), n["last"])
    return out


def flat_nodes(trees: DataFrame) -> DataFrame:
    """(tree, text: JSON) -> a row for each object, list and plain value: id (in reading order), last (the subtree's greatest
    id), parent, depth, place and slot (field; null in lists), shape, kind, value, within (the kind of the object around).
    tree must be unique; a null, malformed or too deep text is a single atom. Fields beside tree and text go."""
    kind = trees.schema["tree"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                rows = _walk(text.as_py())
                nodes = pa.Table.from_pylist(rows, schema=_ARROW).to_batches(max_chunksize=20_000)
                for n in nodes:
                    keys = pa.array([key.as_py()] * n.num_rows, type=b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *n.columns], names=["tree", *_ARROW.names])

    return trees.select("tree", "text").mapInArrow(run, f"tree {kind}, {_FIELDS}")


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def rewritten(nodes: DataFrame, renamed: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees with their predicates rewritten, and the misuses (tree, pred_id, semantic_key, args_count, reason).

    renamed: (tree, pred_id, canonical); fixed: (tree, pred_id, semantic_key); both unique by tree and predicate. A fixed
    operator goes before a new name and takes its arguments along as they are: nothing below it is rewritten, whether or not
    it can be converted. Too few arguments, or a term operator where no term may stand, are misuses and stay. A semantic key
    not in FIXED leaves the node as it is, without a misuse. No rounds: subtrees are intervals of ids, so one sorted pass
    over each tree tells every row which operator covers it, and in which argument. The rows that come back are trees by
    parent and depth; where arguments moved, ids are intervals no longer."""
    rename = renamed.select("tree", F.col("pred_id").alias("name"), "canonical")
    rule = fixed.select("tree", F.col("pred_id").alias("name"), F.col("semantic_key").alias("_rule"), F.lit(True).alias("_fixed"))
    n = nodes.join(rename, ["tree", "name"], "left").join(rule, ["tree", "name"], "left")
    before = Window.partitionBy("tree").orderBy("id")
    so_far, earlier = before.rowsBetween(Window.unboundedPreceding, 0), before.rowsBetween(Window.unboundedPreceding, -1)
    is_fixed = (F.col("shape") == "object") & F.coalesce("_fixed", F.lit(False))
    n = n.withColumn("_frozen", F.coalesce(F.max(F.when(is_fixed, F.col("last"))).over(earlier) >= F.col("id"), F.lit(False)))
    top = F.when(is_fixed & ~F.col("_frozen"), F.struct("id", "last", "depth", "within", F.col("name").alias("pred_id"), F.col("_rule").alias("rule")))
    n = n.withColumn("_top", F.last(top, ignorenulls=True).over(so_far))
    n = n.withColumn("_top", F.when(F.col("_top.last") >= F.col("id"), F.col("_top")))
    below = F.col("depth") - F.col("_top.depth")
    is_args = (below == 1) & (F.col("slot") == "args") & (F.col("shape") == "list")
    n = n.withColumn("_list", F.last(F.when(is_args, F.struct("id", "last", "size")), ignorenulls=True).over(so_far))
    in_list = (F.col("_list.id") >= F.col("_top.id")) & F.col("id").between(F.col("_list.id") + 1, F.col("_list.last"))
    n = n.withColumn("_arg", F.when(in_list, F.last(F.when((below == 2) & F.col("slot").isNull(), F.col("place")), ignorenulls=True).over(so_far)))
    n = n.withColumn("_n", F.max(F.when(is_args, F.col("size"))).over(Window.partitionBy("tree", "_top.id")))

    key, need = F.col("_top.rule"), F.element_at(_table({k: v[2] for k, v in FIXED.items()}), F.col("_top.rule"))
    enough = F.when(key.isin(*CONSTANTS), F.col("_n") == 0).otherwise(F.col("_n") >= need)
    term = ~key.isin("IND_POWER_OPERATOR", "RES_POWER_OPERATOR") | F.coalesce(F.col("_top.within"), F.lit("")).isin(*TERM_PARENTS)
    n = n.withColumn("_go", F.coalesce(F.col("_top").isNotNull() & enough & term, F.lit(False)))
    at_top = F.col("_top.id") == F.col("id")
    reason = F.when(F.col("_n").isNull(), NO_LIST).otherwise(F.element_at(_table(REASONS), key))
    kept = written(n, "syntax")
    misuses = kept.where(at_top & ~F.col("_go") & (F.col("_n").isNull() | need.isNotNull())).select(
        "tree", "id", F.col("_top.pred_id").alias("pred_id"), key.alias("semantic_key"), F.coalesce("_n", F.lit(0)).alias("args_count"), reason.alias("reason")
    )

    go, arg, apply = F.col("_go"), F.col("_arg"), F.element_at(_table(FUNCTIONS), key)
    slots = F.element_at(_table({k: F.array(*map(F.lit, v[1])) if v[1] else F.array().cast("array<string>") for k, v in FIXED.items()}), key)
    own = F.get(slots, arg)
    whole = F.size(slots) == 0  # the list stays a list
    irr = key == "IRR_MEMBERSHIP"
    is_list, is_item = F.col("id") == F.col("_list.id"), (below == 2) & arg.isNotNull()
    constant = F.element_at(_table(CONSTANTS), key)
    stays = ~go | at_top | (is_list & (whole | irr)) | own.isNotNull() | (arg.isNotNull() & whole) | (irr & (arg == 1))
    moved = {
        "kind": F.when(go & at_top, F.element_at(_table({k: v[0] for k, v in FIXED.items()}), key)).otherwise(F.col("kind")),
        "parent": F.when(go & is_item & own.isNotNull(), F.col("_top.id")).when(go & is_list & irr, F.col("_top.id") + 1).otherwise(F.col("parent")),
        "slot": F.when(go & is_item & own.isNotNull(), own).when(go & is_list & constant.isNotNull(), "value").otherwise(F.col("slot")),
        "shape": F.when(go & is_list & constant.isNotNull(), "atom").otherwise(F.col("shape")),
        "value": F.when(go & is_list & constant.isNotNull(), constant).when(~F.col("_frozen") & F.col("canonical").isNotNull() & F.col("_top").isNull() & (F.col("shape") == "atom"), F.col("canonical")).otherwise(F.col("value")),
        "depth": F.when(go & own.isNotNull(), F.col("depth") - 1).when(go & irr & (is_list | (arg == 1)), F.col("depth") + 1).otherwise(F.col("depth")),
        "name": F.when(F.col("_top").isNull(), F.coalesce("canonical", "name")).when(~go, F.col("name")),
    }
    moved["size"] = F.when(go & at_top, F.when(apply.isNotNull(), 2).when(whole, 1).otherwise(F.size(slots))).when(go & is_list & irr, 1).otherwise(F.col("size"))
    moved["shown"] = F.when(go & at_top, F.concat(F.lit("'"), moved["kind"], F.lit("'"))).otherwise(F.col("shown"))
    columns = nodes.columns
    rows = kept.where(F.coalesce(stays, F.lit(False))).select(*[moved[c].alias(c) if c in moved else F.col(c) for c in columns])

    def new(at: int, **given) -> Column:
        values = {c: F.lit(None) for c in columns} | {"tree": F.col("tree"), "id": F.col("_top.id") + at, "last": F.col("_top.id") + at, "place": F.lit(0), "size": F.lit(0)} | given
        return F.struct(*[values[c].cast(nodes.schema[c].dataType).alias(c) for c in columns])

    d, top_id, lit = F.col("_top.depth") + F.when(irr, 1).otherwise(0), F.col("_top.id"), F.lit
    around = new(1, parent=top_id, depth=d, slot=lit("set"), shape=lit("object"), kind=lit("app"), shown=lit("'app'"))
    function = new(2, parent=F.when(irr, top_id + 1).otherwise(top_id), depth=d + 1, slot=lit("fn"), shape=lit("object"), kind=lit("sym_ref"), shown=lit("'sym_ref'"))
    symbol = new(3, parent=top_id + 2, depth=d + 2, slot=lit("sym_id"), shape=lit("atom"), value=apply)
    added = kept.where(at_top & go & apply.isNotNull()).select(F.explode(F.array_compact(F.array(F.when(irr, around), function, symbol))).alias("r")).select("r.*")
    return rows.unionByName(added), misuses


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for i in range(32):
        escaped = F.replace(escaped, F.lit(chr(i)), F.lit(json.dumps(chr(i))[1:-1]))
    return F.concat(F.lit('"'), F.when(out.rlike("[\\x00-\\x1f]"), escaped).otherwise(out), F.lit('"'))


def _atom(text: Column) -> Column:
    """A name as it stands, or quoted where it is empty or has white space, brackets, quotes or backslashes."""
    return F.when(text.rlike('(?U)^[^\\s\\x1c-\\x1f()"\\\\]+\\z'), text).otherwise(_quoted(text))


#: What a node hands to its parent: text or error; bare, the name of a predicate without arguments; items of a list; the text
#: as a bound variable, and a list's as a list of those.
_KID = "struct<place:int,slot:string,shape:string,text:string,error:string,bare:string,items:array<string>,bound:string,unbound:string>"


def _steps(indent: int) -> list[tuple[str, Column]]:
    """The columns that make a node's kid from its children's (kids), one behind the other. Built once for all rounds."""
    steps = []
    steps.append(("kids", F.array_sort(F.coalesce("kids", F.array().cast(f"array<{_KID}>")))))
    steps.append(("has", F.when(F.col("shape") == "object", F.map_from_arrays(F.transform("kids", lambda k: k["slot"]), F.col("kids")))))
    has = lambda *slots: F.expr(" AND ".join(f"map_contains_key(has, '{s}')" for s in slots))
    kind, words = F.col("kind"), lambda *w: F.array(*map(F.lit, w))
    known = kind.isin(*FORMS, "sym_ref", "mul", "sum", "restriction")
    arguments = F.when(has("fn"), words("fn*", "args*")).when(has("args"), words("args*")).otherwise(F.array().cast("array<string>"))
    sides = F.when(has("left") | has("right"), words("left", "right")).otherwise(F.array().cast("array<string>"))
    others = F.filter(F.map_keys("has"), lambda s: ~s.isin("fn", "args", "left", "right", "arg"))
    one = F.when(has("arg"), words("arg")).otherwise(F.array().cast("array<string>"))
    binder = ~known & (has("vars") | has("body"))
    wanted = F.element_at(_table({k: F.array(*map(F.lit, v[1])) for k, v in FORMS.items()}), kind)
    for k, s in OPTIONAL.items():
        wanted = F.when((kind == k) & has(s), words(*FORMS[k][1], s)).otherwise(wanted)
    wanted = (
        F.when(kind == "sym_ref", words("sym_id"))
        .when(kind == "mul", F.when(has("args"), words("args*")).otherwise(words("left", "right")))
        .when(kind == "sum", F.when(has("index", "from", "to"), words("index", "from", "to", "term")).when(has("from", "to"), words("from", "to", "term")).when(has("index"), words("index", "term")).when(has("over"), words("over", "term")).otherwise(words("term")))
        .when(kind == "restriction", F.when(~has("function") & (F.col("has")["fn"]["shape"] != "null"), words("fn", "domain")).otherwise(words("function", "domain")))
        .when(binder, F.concat(words("vars", "body"), F.filter(F.map_keys("has"), lambda s: ~s.isin("vars", "body"))))
        .when(known, wanted)
        .otherwise(F.concat(arguments, sides, one, others))
    )
    steps += [("wanted", F.when(F.col("shape") == "object", wanted)), ("binds", (F.col("shape") == "object") & (kind.isin("forall", "exists") | binder))]
    plain = lambda s: F.when(s == "fn*", "fn").when(s == "args*", "args").otherwise(s)
    field = lambda s: F.col("has")[plain(s)]
    # what is wrong with the node itself, in the order of checks; then with its parts, in the order of rendering
    which = lambda s: F.concat(F.lit("'"), plain(s), F.lit("'"))
    at = F.concat(F.lit("logic_ast node kind="), "shown")
    paired = F.when(has("left") != has("right"), F.concat(at, F.lit(" requires both 'left' and 'right'"))).when(has("vars") != has("body"), F.concat(at, F.lit(" requires both 'vars' and 'body'"))).when(has("fn") & ~has("args"), F.concat(at, F.lit(" requires 'args' when 'fn' is present")))
    needs = F.transform("wanted", lambda s: F.when(field(s).isNull(), F.concat(at, F.lit(" missing required field "), which(s))).when(s.isin("args*", "vars") & (field(s)["shape"] != "list") & ((s == "args*") | F.col("binds")), F.concat(at, F.lit(" field "), which(s), F.lit(" must be a list"))))
    unnamed = F.when(F.col("value") == "unnamed", F.concat(at, F.lit(" missing required field 'kind'"))).when(kind.isNull() | (kind == ""), F.lit("logic_ast node missing required field 'kind'"))
    body = F.col("has")["body"]
    order = F.when(F.col("binds"), F.concat(words("body"), F.filter("wanted", lambda s: ~s.isin("body", "vars")), words("vars"))).otherwise(F.col("wanted"))
    wrong = F.transform(order, lambda s: F.when(F.col("binds") & (s == "body") & (body["shape"] != "object"), "logic_ast node must be a dict").when(F.col("binds") & (s == "vars"), field(s)["unbound"]).when((s == "fn*") & field(s)["bare"].isNotNull(), None).when((kind == "sym_ref") | ((kind == "pred") & (s == "pred_id")), None).otherwise(field(s)["error"]))
    first = lambda a: F.get(F.array_compact(a), F.lit(0))
    steps.append(("error", F.when(F.col("shape") == "object", F.coalesce(unnamed, F.when(~known, paired), first(needs), first(wrong))).when(F.col("shape") == "list", first(F.transform("kids", lambda k: k["error"])))))
    texts = lambda ws: F.flatten(F.transform(ws, lambda s: F.when(s == "args*", field(s)["items"]).when(s == "fn*", F.array(F.coalesce(field(s)["bare"], field(s)["text"]))).otherwise(F.array(field(s)["text"]))))
    shifted = lambda x: F.concat(F.lit(" " * indent), F.replace(x, F.lit("\n"), F.lit("\n" + " " * indent)))
    camel = F.when(kind == F.upper(kind), kind).otherwise(F.array_join(F.transform(F.split(kind, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""))
    fixed_names = {k: v[0] for k, v in FORMS.items() if v[0]} | {"mul": "Mul", "restriction": "Restriction"}
    operator = F.when(kind == "sum", F.when(F.array_contains("wanted", "over"), "SumOver").otherwise("Sum")).when(kind == "pred", F.col("has")["pred_id"]["text"]).otherwise(F.coalesce(F.element_at(_table(fixed_names), kind), _atom(camel)))
    steps.append(("parts", F.when(F.col("shape") == "list", F.transform("kids", lambda k: k["text"])).otherwise(texts(F.when(F.col("binds"), F.filter("wanted", lambda s: s != "vars")).when(kind == "pred", words("args*")).otherwise(F.col("wanted"))))))
    split = F.exists("parts", lambda x: F.contains(x, F.lit("\n")))
    split = F.coalesce(F.col("binds") | kind.isin(*MULTILINE) | ((kind == "not") & F.get("parts", F.lit(0)).startswith("(")), F.lit(False)) | split
    open_ = F.concat(F.lit("("), operator, F.when(F.col("binds"), F.concat(F.lit(" "), F.col("has")["vars"]["bound"])).otherwise(""))
    lines = F.array_join(F.transform("parts", shifted), "\n")
    call = F.when(F.size("parts") == 0, F.concat(open_, F.lit(")"))).when(split, F.concat(open_, F.lit("\n"), lines, F.lit(")"))).otherwise(F.concat(open_, F.lit(" "), F.array_join("parts", " "), F.lit(")")))
    listed = F.when(F.exists("parts", lambda x: F.contains(x, F.lit("\n"))), F.concat(F.lit("(\n"), lines, F.lit("\n)"))).otherwise(F.concat(F.lit("("), F.array_join("parts", " "), F.lit(")")))
    text = F.when(F.col("shape").isin("atom", "null"), _atom(F.col("value"))).when(F.col("shape") == "list", listed).when(kind == "sym_ref", F.get("parts", F.lit(0))).otherwise(call)
    variable = F.coalesce(*[F.when(F.col("has")[s].isNull(), F.concat(at, F.lit(f" missing required field '{s}'"))) for s in ("sym_id", "sort")])
    bound = F.when(F.col("shape") == "object", F.concat(F.lit("("), F.col("has")["sym_id"]["text"], F.lit(" "), F.col("has")["sort"]["text"], F.lit(")")))
    bound = F.when(F.col("shape") == "list", F.concat(F.lit("("), F.array_join(F.transform("kids", lambda k: k["bound"]), " "), F.lit(")"))).otherwise(bound)
    unbound = F.when(F.col("shape") == "object", variable).when(F.col("shape") == "list", first(F.transform("kids", lambda k: F.when(k["shape"] != "object", "logic_ast binder variable must be a dict").otherwise(k["unbound"]))))
    bare = F.when((kind == "pred") & has("pred_id") & ~has("args"), F.col("has")["pred_id"]["text"])
    kid = F.struct("place", "slot", "shape", F.when(F.col("error").isNull(), text).alias("text"), "error", bare.alias("bare"), F.when(F.col("shape") == "list", F.col("parts")).alias("items"), bound.alias("bound"), unbound.alias("unbound"))
    return [*steps, ("kid", kid.cast(_KID))]


def _level(nodes: DataFrame, kids: DataFrame | None, steps: list[tuple[str, Column]]) -> DataFrame:
    """(tree, id, parent, kid) of nodes whose children are all in kids (tree, id: the parent's, kids)."""
    n = nodes.join(kids, ["tree", "id"], "left") if kids is not None else nodes.withColumn("kids", F.lit(None).cast(f"array<{_KID}>"))
    for name, column in steps:
        n = n.withColumn(name, column)
    return n.select("tree", "id", "parent", "kid")


def rendered(nodes: DataFrame, indent: int = 2) -> DataFrame:
    """(tree, text): each tree as an operator expression, deepest nodes first, a round for each level of depth. A tree that
    lacks a field, or whose root is no object, is a RenderError with the first fault in the order of rendering. Line
    separators other than \\n inside names don't start a line. Levels are files of their own; a round reads its level alone
    and joins what the level below hands up, which is written: plans stay those of one round, however deep the trees."""
    if indent < 0:
        raise ValueError("indent must not be negative")
    spark, path = nodes.sparkSession, shared_dir(nodes.sparkSession, "levels")
    nodes.write.partitionBy("depth").parquet(path)
    levels = spark.read.schema(nodes.schema).parquet(path)
    deepest = levels.agg(F.max("depth")).first()[0]
    if deepest is None:
        return levels.select("tree", F.col("value").alias("text"))
    kids, steps = None, _steps(indent)
    for depth in range(deepest, 0, -1):
        up = _level(levels.where(F.col("depth") == depth), kids, steps)
        kids = written(up.groupBy("tree", F.col("parent").alias("id")).agg(F.collect_list("kid").alias("kids")), "rendered")
    top = _level(levels.where(F.col("depth") == 0), kids, steps)
    error = F.coalesce(F.when(F.col("kid.shape") != "object", "logic_ast node must be a dict"), F.col("kid.error"))
    failed = F.concat(F.lit('(RenderError "ValueError" '), _quoted(error), F.lit(")"))
    return top.select("tree", F.coalesce(failed, "kid.text").alias("text"))


# The same, a whole tree at a time: a tree is one row's text anyway, and as a row for each node it takes some ten times the work.

_PLAIN_NAME = re.compile(r'[^\s\x1c-\x1f()"\\]+')
_FIXED_NAMES = {k: v[0] for k, v in FORMS.items() if v[0]} | {"mul": "Mul", "restriction": "Restriction"}
_NO_DICT = "logic_ast node must be a dict"


def _json_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


@functools.lru_cache(100_000)
def _atom_text(text: str) -> str:
    return text if _PLAIN_NAME.fullmatch(text) else _json_text(text)


def _rewrite(top, renamed: dict, fixed: dict) -> list[tuple]:
    """Rewrites a parsed tree in place, as `rewritten` does; the misuses come back."""
    out, stack = [], [(top, "")]
    while stack:
        v, within = stack.pop()
        if type(v) is list:
            stack += [(x, within) for x in v if type(x) in (dict, list)]
            continue
        kind = v.get("kind")
        name = str(v["pred_id"]) if kind == "pred" and v.get("pred_id") else None
        if name is not None and name in fixed:
            rule, args = fixed[name], v.get("args")
            n = len(args) if type(args) is list else None
            need = FIXED[rule][2] if rule in FIXED else None
            enough = n is not None and need is not None and (n == 0 if rule in CONSTANTS else n >= need)
            if enough and (rule not in ("IND_POWER_OPERATOR", "RES_POWER_OPERATOR") or within in TERM_PARENTS):
                called = {"fn": {"kind": "sym_ref", "sym_id": FUNCTIONS[rule]}} if rule in FUNCTIONS else {}
                v.clear()
                v["kind"] = FIXED[rule][0]
                v |= dict(zip(FIXED[rule][1], args))
                if rule == "IRR_MEMBERSHIP":
                    v["set"] = {"kind": "app"} | called | {"args": [args[1]]}
                elif rule in CONSTANTS:
                    v["value"] = CONSTANTS[rule]
                elif not FIXED[rule][1]:
                    v |= called | {"args": args}
            elif n is None or need is not None:
                out.append((name, rule, n or 0, NO_LIST if n is None else REASONS[rule]))
            continue
        if name is not None and name in renamed:
            v["pred_id"] = renamed[name]
        inner = kind if isinstance(kind, str) else ""
        stack += [(x, inner) for k, x in v.items() if type(x) in (dict, list) and k != "kind" and k not in _NAMES]
    return out


@functools.lru_cache(10_000)
def _plan(kind: str, fields: tuple, fn_null: bool) -> tuple:
    """(wanted, the order of checks, whether it binds, the kind's name) of an object, from the names of its fields."""
    has = fields.__contains__
    known = kind in FORMS or kind in ("sym_ref", "mul", "sum", "restriction")
    binder = not known and (has("vars") or has("body"))
    if kind == "sym_ref":
        wanted = ["sym_id"]
    elif kind == "mul":
        wanted = ["args*"] if has("args") else ["left", "right"]
    elif kind == "sum":
        ends = ["from", "to"] if has("from") and has("to") else []
        wanted = [*(["index"] if has("index") else []), *ends, "term"] if has("index") or ends else ["over", "term"] if has("over") else ["term"]
    elif kind == "restriction":
        wanted = ["fn" if not has("function") and has("fn") and not fn_null else "function", "domain"]
    elif binder:
        wanted = ["vars", "body", *(f for f in fields if f not in ("vars", "body"))]
    elif known:
        wanted = FORMS[kind][1] + ([OPTIONAL[kind]] if kind in OPTIONAL and has(OPTIONAL[kind]) else [])
    else:
        arguments = ["fn*", "args*"] if has("fn") else ["args*"] if has("args") else []
        sides = ["left", "right"] if has("left") or has("right") else []
        wanted = [*arguments, *sides, *(["arg"] if has("arg") else []), *(f for f in fields if f not in ("fn", "args", "left", "right", "arg"))]
    binds = kind in ("forall", "exists") or binder
    wrong = None
    if not known:
        wrong = " requires both 'left' and 'right'" if has("left") != has("right") else " requires both 'vars' and 'body'" if has("vars") != has("body") else " requires 'args' when 'fn' is present" if has("fn") and not has("args") else None
    if wrong is None:
        wrong = next((f" missing required field '{w.rstrip('*')}'" for w in wanted if not has(w.rstrip("*"))), None)
    order = ["body", *(w for w in wanted if w not in ("body", "vars")), "vars"] if binds else wanted
    camel = kind if kind == kind.upper() else "".join(p[:1].upper() + p[1:] for p in kind.split("_"))
    name = ("SumOver" if "over" in wanted else "Sum") if kind == "sum" else _FIXED_NAMES.get(kind) or _atom_text(camel)
    return wanted, order, binds, name, wrong


def _node_error(v: dict, what: str) -> str:
    return f"logic_ast node kind={v.get('kind', '<missing-kind>')!r}{what}"


def _unbound(variables: list) -> str | None:
    for x in variables:
        if type(x) is not dict:
            return "logic_ast binder variable must be a dict"
        for f in ("sym_id", "sort"):
            if f not in x:
                return _node_error(x, f" missing required field '{f}'")
    return None


def _render(v, gap: str) -> tuple[str | None, str | None]:
    """(text, error) of a parsed tree; calls itself, but only in Python, where depth has no limit of its own."""
    if type(v) is list:
        parts = []
        for x in v:
            text, error = _render(x, gap)
            if error is not None:
                return None, error
            parts.append(text)
        if any("\n" in p for p in parts):
            return "(\n" + "\n".join([gap[1:] + p.replace("\n", gap) for p in parts]) + "\n)", None
        return "(" + " ".join(parts) + ")", None
    if type(v) is not dict:
        return _atom_text(str(v)), None
    kind = v.get("kind")
    if not isinstance(kind, str) or not kind:
        return None, "logic_ast node missing required field 'kind'" if "kind" in v else _node_error(v, " missing required field 'kind'")
    if kind == "sym_ref" and "sym_id" in v:
        return _atom_text(str(v["sym_id"])), None
    wanted, order, binds, name, wrong = _plan(kind, tuple([f for f in v if f != "kind"]), v.get("fn", 0) is None)
    # what is missing and what is no list, in the order of fields; a field that comes first goes first
    for w in wanted:
        if (w == "args*" or w == "vars" and binds) and type(v.get(w.rstrip("*"), [])) is not list:
            at = w.rstrip("*")
            before = [x.rstrip("*") for x in wanted[: wanted.index(w)]]
            if wrong is None or " missing " in wrong and all(b in v for b in before):
                return None, _node_error(v, f" field '{at}' must be a list")
    if wrong is not None:
        return None, _node_error(v, wrong)
    texts = {}
    for w in order:
        if binds and w == "body" and type(v["body"]) is not dict:
            return None, _NO_DICT
        if w == "vars" and binds:
            error = _unbound(v["vars"])
        elif w in _NAMES:
            texts[w], error = [_atom_text(str(v[w]))], None
        elif w == "args*":
            parts, error = [], None
            for x in v["args"]:
                text, error = _render(x, gap)
                if error is not None:
                    break
                parts.append(text)
            texts[w] = parts
        else:
            x = v[w.rstrip("*")]
            if w == "fn*" and type(x) is dict and x.get("kind") == "pred" and "pred_id" in x and "args" not in x:
                texts[w], error = [_atom_text(str(x["pred_id"]))], None
            else:
                text, error = _render(x, gap)
                texts[w] = [text]
        if error is not None:
            return None, error
    if kind == "pred":
        name, parts = texts["pred_id"][0], texts["args*"]
    else:
        parts = [p for w in wanted if not (binds and w == "vars") for p in texts[w]]
    if binds:
        name += " (" + " ".join([f"({_atom_text(str(x['sym_id']))} {_atom_text(str(x['sort']))})" for x in v["vars"]]) + ")"
    if not parts:
        return f"({name})", None
    if binds or kind in MULTILINE or kind == "not" and parts[0].startswith("(") or any("\n" in p for p in parts):
        return "(" + name + "\n" + "\n".join([gap[1:] + p.replace("\n", gap) for p in parts]) + ")", None
    return f"({name} {' '.join(parts)})", None


@functools.lru_cache(10_000)
def _rules(said: str | None) -> dict:
    return json.loads(said) if said else {}


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _ruled(rules: DataFrame, value: str, name: str) -> DataFrame:
    """(tree, name): the rules of each tree as a JSON object."""
    return rules.groupBy("tree").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("pred_id", value))))).alias(name))


def statements(trees: DataFrame, renamed: DataFrame, fixed: DataFrame, indent: int = 2) -> DataFrame:
    """(tree, text): rendered(rewritten(flat_nodes(trees), renamed, fixed)[0], indent), a tree at a time and so without rounds."""
    if indent < 0:
        raise ValueError("indent must not be negative")
    kind, gap = trees.schema["tree"].dataType.simpleString(), "\n" + " " * indent

    def run(batches):
        limit = sys.getrecursionlimit()
        for b in batches:
            out = []
            sys.setrecursionlimit(10**6)
            for text, new, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                v = _parsed(text)
                if type(v) is dict:
                    _rewrite(v, _rules(new), _rules(own))
                    said, error = _render(v, gap)
                else:
                    if type(v) is list:
                        _rewrite(v, _rules(new), _rules(own))
                    said, error = None, _NO_DICT
                out.append(said if error is None else f'(RenderError "ValueError" {_json_text(error)})')
            sys.setrecursionlimit(limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["tree", "text"])

    rows = trees.select("tree", "text").join(_ruled(renamed, "canonical", "_new"), "tree", "left").join(_ruled(fixed, "semantic_key", "_own"), "tree", "left")
    return rows.select("tree", "text", "_new", "_own").mapInArrow(run, f"tree {kind}, text string")


def misuses(trees: DataFrame, fixed: DataFrame) -> DataFrame:
    """(tree, pred_id, semantic_key, args_count, reason): the misuses of rewritten(flat_nodes(trees), ..., fixed), a tree at a time."""
    kind = trees.schema["tree"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, found = [], []
            for i, (text, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                v = _parsed(text)
                if type(v) in (dict, list):
                    new = _rewrite(v, {}, _rules(own))
                    found += new
                    at += [i] * len(new)
            columns = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["tree", "pred_id", "semantic_key", "args_count", "reason"])

    rows = trees.select("tree", "text").join(_ruled(fixed, "semantic_key", "_own"), "tree")
    return rows.select("tree", "text", "_own").mapInArrow(run, f"tree {kind}, pred_id string, semantic_key string, args_count int, reason string")
