"""Queries over formal statements: every order is a tree, its items joined one by one; and over searches down a tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.operators import search as A
from stemma.operators import syntax as S
from stemma.registry import query, table

# Item i of an order states something by its part: a predicate, a subset, an equation of applications, a negation, membership
# in Irr(G) or a term out of place. Orders join theirs by and, imp or or; two in three bind x; each eleventh lacks a side.
_ITEMS = """it AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS i, l_partkey AS p, l_suppkey AS s FROM lineitem)"""

_TEXTS = f"""{_ITEMS}, nm AS (SELECT *, CASE WHEN t % 2 = 0 AND s % 4 < 2 THEN 'Same_' ELSE 'P' END || (s % 4) AS name FROM it),
    tx AS (SELECT *, CASE p % 6 WHEN 0 THEN '(' || name || ' x (Int ' || p || '))' WHEN 1 THEN CASE WHEN s % 3 > 0 THEN '(Subset "A b" C' || s || ')' ELSE '(SUBSET "A b")' END
        WHEN 2 THEN '(Eq (App f x) (App IndPower x y (Int ' || s || ')))' WHEN 3 THEN '(Not' || chr(10) || '  (' || name || ' x))' WHEN 4 THEN '(In (P' || (s % 4) || ' x) (App Irr G))' ELSE '(IND x y z)' END AS text FROM nm)"""


@query(f"""WITH RECURSIVE {_TEXTS}, ch AS (SELECT t, i, text FROM tx WHERE i = 1 UNION ALL SELECT ch.t, tx.i, '(' || CASE ch.t % 5 WHEN 0 THEN 'And' WHEN 1 THEN 'Imp' ELSE 'Or' END || chr(10) || '  ' || replace(ch.text, chr(10), chr(10) || '  ') || chr(10) || '  ' || replace(tx.text, chr(10), chr(10) || '  ') || ')'
        FROM ch JOIN tx ON tx.t = ch.t AND tx.i = ch.i + 1),
    wh AS (SELECT t, text FROM ch QUALIFY row_number() OVER (PARTITION BY t ORDER BY i DESC) = 1)
    SELECT t AS tree, CASE WHEN t % 11 = 0 THEN '(RenderError "ValueError" "logic_ast node kind=''eq'' missing required field ''right''")'
        WHEN t % 3 > 0 THEN '(Forall ((x Real))' || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  ') || ')' ELSE text END AS text FROM wh""")
def statement_forms(spark, sf_dir):
    """The statement of every order, rewritten and rendered."""
    return S.statements(*_statements(spark, sf_dir))


@query(f"""WITH {_ITEMS} SELECT t AS tree, CASE p % 6 WHEN 1 THEN 'SUBSET' ELSE 'IND' END AS pred_id, CASE p % 6 WHEN 1 THEN 'SUBSET_RELATION' ELSE 'IND_POWER_OPERATOR' END AS semantic_key, CASE p % 6 WHEN 1 THEN 1 ELSE 3 END AS args_count,
    CASE p % 6 WHEN 1 THEN '{S.REASONS["SUBSET_RELATION"]}' ELSE '{S.REASONS["IND_POWER_OPERATOR"]}' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM it)
    WHERE p % 6 = 1 AND s % 3 = 0 OR p % 6 = 5 AND NOT (t % 33 = 0 AND n = 1)""")
def operator_misuses(spark, sf_dir):
    """Fixed operators in the statements of orders that lack arguments or stand where no term may. A lone item of an order
    that lacks a side and binds nothing is a side of an equation: a term may stand there."""
    trees, _, fixed = _statements(spark, sf_dir)
    return S.misuses(trees, fixed)


def _statements(spark, sf_dir):
    """(tree, text) of every order, its new names and its fixed operators."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    it = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), F.row_number().over(order).alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    name = F.concat(F.lit("P"), (F.col("s") % 4).cast("string"))
    sym = lambda x: f'{{"kind":"sym_ref","sym_id":"{x}"}}'
    put = lambda text, *values: F.format_string(text, *values)
    number = '{"kind":"int","value":%d}'
    k = F.col("p") % 6
    form = (
        F.when(k == 0, put(f'{{"kind":"pred","pred_id":"%s","args":[{sym("x")},{number}]}}', name, F.col("p")))
        .when((k == 1) & (F.col("s") % 3 > 0), put(f'{{"kind":"pred","pred_id":"SUBSET","args":[{sym("A b")},{sym("C%d")}]}}', F.col("s")))
        .when(k == 1, F.lit(f'{{"kind":"pred","pred_id":"SUBSET","args":[{sym("A b")}]}}'))
        .when(k == 2, put(f'{{"kind":"eq","right":{{"kind":"pred","pred_id":"IND","args":[{sym("x")},{sym("y")},{number}]}},"left":{{"kind":"app","fn":{{"kind":"pred","pred_id":"f"}},"args":[{sym("x")}]}}}}', F.col("s")))
        .when(k == 3, put(f'{{"kind":"not","arg":{{"kind":"pred","pred_id":"%s","args":[{sym("x")}]}}}}', name))
        .when(k == 4, put(f'{{"kind":"pred","pred_id":"IRR","args":[{{"kind":"pred","pred_id":"%s","args":[{sym("x")}]}},{sym("G")}]}}', name))
        .otherwise(F.lit(f'{{"kind":"pred","pred_id":"IND","args":[{sym("x")},{sym("y")},{sym("z")}]}}'))
    )
    it = it.withColumns({"name": name, "form": form})
    forms = it.groupBy("tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "form"))), lambda x: x["form"]).alias("forms"))
    joint = F.when(F.col("tree") % 5 == 0, "and").when(F.col("tree") % 5 == 1, "imp").otherwise("or")
    fold = F.aggregate(F.slice("forms", 2, F.greatest(F.size("forms") - 1, F.lit(0))), F.get("forms", F.lit(0)), lambda a, x: F.concat(F.lit('{"kind":"'), joint, F.lit('","left":'), a, F.lit(',"right":'), x, F.lit("}")))
    whole = F.when(F.col("tree") % 3 > 0, F.concat(F.lit('{"kind":"forall","vars":[{"sym_id":"x","sort":"Real"}],"body":'), fold, F.lit("}"))).otherwise(fold)
    whole = F.when(F.col("tree") % 11 == 0, F.concat(F.lit('{"kind":"eq","left":'), whole, F.lit("}"))).otherwise(whole)
    renamed = it.where((F.col("tree") % 2 == 0) & (F.col("s") % 4 < 2)).select("tree", F.col("name").alias("pred_id"), F.concat(F.lit("Same_"), (F.col("s") % 4).cast("string")).alias("canonical")).distinct()
    rules = F.create_map(*[F.lit(x) for kv in {"SUBSET": "SUBSET_RELATION", "IND": "IND_POWER_OPERATOR", "IRR": "IRR_MEMBERSHIP"}.items() for x in kv])
    fixed = forms.select("tree", F.explode(rules).alias("pred_id", "semantic_key"))
    return forms.select("tree", whole.alias("text")), renamed, fixed


# The library: brands, their types and the names below; a type or a name is found where it stands first. Every order asks for
# its items' brands, types and names; some answers are missing and some name what isn't there.
_LIBRARY = """pa AS (SELECT p_partkey AS p, p_brand AS b, p_brand || '/' || p_type AS bt, p_type AS ty, p_brand || '/' || p_type || '/' || p_name AS bn, p_name AS nm FROM part),
    no AS (SELECT '' AS id, NULL AS parent, 'library' AS name, 0 AS level UNION ALL SELECT DISTINCT b, '', b, 1 FROM pa UNION ALL SELECT DISTINCT bt, b, ty, 2 FROM pa UNION ALL SELECT DISTINCT bn, bt, nm, 3 FROM pa),
    tr AS (SELECT *, CASE WHEN length(id) % 3 > 0 THEN 'lean' ELSE 'folder' END AS type FROM no),
    tg AS (SELECT name, level, min(id) AS child FROM tr GROUP BY ALL),
    ia AS (SELECT l_orderkey AS st, l_suppkey AS s, pa.* FROM lineitem JOIN pa ON l_partkey = p),
    an AS (SELECT DISTINCT st, '' AS node, b AS name FROM ia WHERE s % 5 > 0 UNION SELECT st, b, CASE WHEN s % 7 = 0 THEN 'nothing' ELSE ty END FROM ia WHERE s % 3 > 0 UNION SELECT st, tg.child, nm FROM ia JOIN tg ON tg.name = ty AND tg.level = 2 WHERE s % 4 > 0)"""


@query(f"""WITH RECURSIVE {_LIBRARY}, se AS (SELECT DISTINCT l_orderkey AS st, '' AS node, 0 AS level, '' AS path FROM lineitem UNION ALL
        SELECT se.st, tg.child, se.level + 1, CASE WHEN se.path = '' THEN an.name ELSE se.path || '/' || an.name END FROM se JOIN an ON an.st = se.st AND an.node = se.node JOIN tg ON tg.name = an.name AND tg.level = se.level + 1),
    sa AS (SELECT an.st, an.node, bool_or(tg.child IS NOT NULL) AS led FROM an JOIN tr ON tr.id = an.node LEFT JOIN tg ON tg.name = an.name AND tg.level = tr.level + 1 GROUP BY ALL)
    SELECT se.st AS statement, se.node, se.level, se.path, CASE WHEN led IS NOT NULL THEN NULL WHEN type = 'lean' THEN 'active' ELSE 'dead' END AS state
    FROM se JOIN tr ON tr.id = se.node LEFT JOIN sa ON sa.st = se.st AND sa.node = se.node WHERE led IS NULL OR NOT led""")
def library_search(spark, sf_dir):
    """Where the search of every order ends in the library of parts."""
    join = lambda *c: F.concat_ws("/", *c)
    pa = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("b"), F.col("p_type").alias("ty"), F.col("p_name").alias("nm"), join("p_brand", "p_type").alias("bt"), join("p_brand", "p_type", "p_name").alias("bn"))
    row = lambda i, parent, name, level: F.struct(i.alias("id"), parent.alias("parent"), name.alias("name"), F.lit(level).alias("level"))
    none, top, c = F.lit(None).cast("string"), F.lit(""), F.col
    below = pa.select(F.explode(F.array(row(c("b"), top, c("b"), 1), row(c("bt"), c("b"), c("ty"), 2), row(c("bn"), c("bt"), c("nm"), 3))).alias("r")).select("r.*").distinct()
    tree = below.unionByName(spark.range(1).select(row(top, none, F.lit("library"), 0).alias("r")).select("r.*"))
    tree = tree.withColumn("type", F.when(F.length("id") % 3 > 0, A.LEAF).otherwise("folder"))
    items = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("statement"), c("l_partkey").alias("p"), c("l_suppkey").alias("s")).join(pa, "p").join(pa.groupBy("ty").agg(F.min("bt").alias("first")), "ty")
    answer = lambda when, node, name: F.when(when, F.struct(node.alias("node"), name.alias("name")))
    said = F.array_compact(F.array(answer(c("s") % 5 > 0, top, c("b")), answer(c("s") % 3 > 0, c("b"), F.when(c("s") % 7 == 0, "nothing").otherwise(c("ty"))), answer(c("s") % 4 > 0, c("first"), c("nm"))))
    answers = items.select("statement", F.explode(said).alias("a")).select("statement", "a.*").distinct()
    return A.tree_search(tree, table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("statement")).distinct(), answers)
