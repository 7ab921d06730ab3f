"""Features of single sources."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nbquarry.operators import code as G
from nbquarry.functions.marks import is_test_module

# source -> modules, local imports, function, class, control flow
CASES = {
    "%matplotlib inline\nimport sys": ([], False, False, False, False),
    "import a.b, c as d": (["a", "c"], False, False, False, False),
    "from . import x": ([], True, False, False, False),
    "from .m import x": (["m"], True, False, False, False),
    "from a.b import c, d": (["a"], False, False, False, False),
    "def f():\n    import z": (["z"], False, True, False, False),
    "async def f(): pass": ([], False, False, False, False),
    "f = lambda: 1": ([], False, False, False, False),
    "class A: pass": ([], False, False, True, False),
    "for i in x: pass": ([], False, False, False, True),
    "while x: pass": ([], False, False, False, True),
    "if x: pass": ([], False, False, False, True),
    "try: pass\nexcept E: pass": ([], False, False, False, True),
    "try: pass\nexcept* E: pass": ([], False, False, False, False),
    "with x: pass": ([], False, False, False, True),
    "[i for i in x if i]": ([], False, False, False, False),
    "match x:\n    case 1: pass": ([], False, False, False, False),
    "async def f():\n    async with x: pass\n    async for i in y: pass": ([], False, False, False, False),
    "import a\x00": ([], False, False, False, False),
    "x = (((" : ([], False, False, False, False),
    "if a:\n    import inner\nimport outer": (["outer", "inner"], False, False, False, True),
    "": ([], False, False, False, False),
}


def test_sources(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i int, s string")
    rows = df.select("i", G.code_features(F.array("s")).alias("f")).select("i", "f.*").drop("module_counts").orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == list(CASES.values())


def test_skipped_sources_hold_nothing(spark):
    """What the keyword test leaves out of the trip has no feature."""
    df = spark.createDataFrame([(s,) for s in CASES], "s string")
    skipped = [r.s for r in df.where(~G.worth_parsing(F.col("s"))).collect()]
    assert skipped
    assert all(CASES[s] == ([], False, False, False, False) for s in skipped)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abdefhilmnoprstwxy =:()\n.*_#'\"é𝐟", max_size=40))
def test_features_need_a_keyword(source):
    import ast
    import re
    import warnings

    if re.search(G.KEYWORDS, source):
        return
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(source)
        except Exception:
            return
    wanted = (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.ClassDef, ast.For, ast.While, ast.If, ast.Try, ast.With)
    assert not [n for n in ast.walk(tree) if isinstance(n, wanted)]


@pytest.mark.parametrize("module,expected", [
    ("pytest", True), ("my_test", True), ("contest", False), ("tests", True), ("mock", True), ("mocks-x", True),
    ("unittest", True), ("latest", False), ("Test", True), ("twisted", False), ("testing", False),
])
def test_test_modules(spark, module, expected):
    assert spark.range(1).select(is_test_module(F.lit(module)).alias("t")).first().t is expected


def test_top_imports_break_ties_by_first_use(spark):
    modules = [f"m{i:02}" for i in range(14)]
    rows = [(1, 0, p, m) for p, m in enumerate(reversed(modules))] + [(1, 1, 0, "m05"), (1, 1, 1, "m07"), (1, 2, 0, "m05"), (2, 0, 0, "z")]
    imports = spark.createDataFrame(rows, "nb_id int, cell_idx int, pos int, module string").repartition(3)
    lists = {r.nb_id: [tuple(p) for p in r.top_imports] for r in G.top_imports(imports).collect()}
    assert lists[1] == [("m05", 3), ("m07", 2)] + [(m, 1) for m in reversed(modules) if m not in ("m05", "m07")][:8]
    assert lists[2] == [("z", 1)]


def test_counting_many_modules_takes_linear_time(spark):
    source = "\n".join(f"import m{i}, m{i % 7}" for i in range(16_000))
    found = spark.createDataFrame([([source],)], "s array<string>").select(G.code_features(F.col("s")).alias("f")).select("f.module_counts").first()[0]
    assert len(found) == 16_000 and [(r.module, r.n) for r in found[:8]] == [("m0", 2287), *[(f"m{i}", 2287 if i < 5 else 2286) for i in range(1, 7)], ("m7", 1)]
