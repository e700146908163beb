import random

from stemma.operators import locate as L


def form(t):
    return "".join(c for c in (t or "").lower() if not c.isspace() and c not in "$\\{}*")


def best_range(blocks, statement):
    """Every range tried, one after the other."""
    said = form(statement)
    if len(said) < 8:
        return None
    best, ties = None, 0
    for i in range(len(blocks)):
        joined = ""
        for j in range(i, len(blocks)):
            kind, text = blocks[j]
            if kind == "hr" or (j > i and kind in L.HEADINGS):
                break
            if not form(text):
                continue
            joined += form(text)
            if joined not in said and said not in joined:
                break
            now = (min(len(joined), len(said)), -abs(len(joined) - len(said)))
            if best is None or now > best[0]:
                best, ties = (now, i, j), 1
            elif now == best[0]:
                ties += 1
            if said in joined:
                break
    if best is None or ties > 1 or best[0][0] / len(said) < 0.82 or -best[0][1] / len(said) > 0.35:
        return None
    return best[1], best[2]


def test_ranges_against_all_ranges(spark):
    r = random.Random(4)
    docs, statements, want = [], [], {}
    for d in range(60):
        words = ["alpha", "beta", "x+y", "Gamma ray", "$z$", "", " ", "a"]
        blocks = [(r.choice(["paragraph"] * 6 + ["h2", "hr"]), " ".join(r.choices(words, k=r.randrange(0, 4)))) for _ in range(8)]
        docs += [(d, i, k, t) for i, (k, t) in enumerate(blocks)]
        for n in range(6):
            i, j = sorted(r.choices(range(8), k=2))
            said = " ".join(t for _, t in blocks[i : j + 1])
            said = said[r.choice([0, 0, 1, 3]) : len(said) - r.choice([0, 0, 2, 5])] + r.choice(["", "", " more"])
            statements.append((d, n, said))
            if (found := best_range(blocks, said)) is not None:
                want[d, n] = found
    got = L.block_ranges(spark.createDataFrame([*statements, (0, 99, None)], "doc_id long, node long, statement string"), spark.createDataFrame(docs, "doc_id long, block long, type string, text string"))
    assert {(x.doc_id, x.node): (x.start, x.end) for x in got.collect()} == want and len(want) > 30


BLOCKS = [
    (1, 0, "h1", "Intro"), (1, 1, "paragraph", "\\begin{introduction}\nThis text speaks of compact operators at length."), (1, 2, "paragraph", "Theorem 3.1 (Main). Every set is well ordered."),
    (1, 3, "hr", None), (1, 4, "paragraph", "\\begin{lemma}{ Lem-1 }\nA small lemma."), (1, 5, "paragraph", "Here $a_{1} + b$ is fixed, and Stokes theorem holds on manifolds."), (1, 6, "paragraph", "This text speaks of compact operators"),
]


def test_tiers(spark):
    schema = "doc_id long, node long, type string, label string, tex_label string, statement string, source string, title string, terms array<string>"
    none = [None] * 6
    nodes = [
        (1, 1, "theorem", "Theorem 3.1", None, "Theorem 3.1 (Main). Every set is well ordered.", None, None, None),  # its statement, and the number finds the same block
        (1, 2, "Lemma", None, "lem-1", "nothing like it in the text", None, None, None),  # its label, although the statement is nowhere
        (1, 3, "theorem", None, "lem-1", "nothing like it in the text", None, None, None),  # another environment: no block
        (1, 4, "theorem", "Theorem 3.1", None, None, "This text speaks of compact operators at length", None, None),  # its source, not in the introduction; then the number
        (1, 5, "theorem", None, None, None, None, "A_1+B", None),  # its title as inline math
        (1, 6, "theorem", None, None, None, None, None, ["Stokes", "manifolds", "absent"]),  # two of its terms
        (1, 7, "theorem", None, None, None, None, None, ["Stokes"]),  # one short term is too little
        (1, 8, "theorem", None, None, None, None, None, ["is fixed, and Stokes theorem"]),  # one long phrase
        (2, 9, *none, None),
    ]
    got = L.anchor_index(spark.createDataFrame(nodes, schema), spark.createDataFrame(BLOCKS, "doc_id long, block long, type string, text string"))
    assert sorted((r.node, r.block, r.tier, r.is_first) for r in got.collect()) == [(1, 2, 1, True), (2, 4, 2, True), (4, 2, 4, False), (4, 6, 3, True), (5, 5, 5, True), (6, 5, 6, True), (8, 5, 6, True)]
