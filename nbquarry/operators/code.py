"""Code features from syntax trees: the one step that leaves the JVM.

Sources reach the standard library's parser in Arrow batches and come back as light columns. A source without any of the
keywords that can produce a feature never makes the trip.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from nbquarry.constants import TOP_IMPORTS
from nbquarry.functions.marks import is_test_module

FEATURES = T.StructType([
    T.StructField("modules", T.ArrayType(T.StringType())),
    T.StructField("has_local_imports", T.BooleanType()),
    T.StructField("defines_function", T.BooleanType()),
    T.StructField("defines_class", T.BooleanType()),
    T.StructField("has_control_flow", T.BooleanType()),
    T.StructField("module_counts", T.ArrayType(T.StructType([
        T.StructField("module", T.StringType()), T.StructField("n", T.LongType()),
    ]))),
])
FLAGS = FEATURES.fieldNames()[1:5]

# A superset of the sources that can yield a feature; it need not be exact.
KEYWORDS = "import|def|class|for|while|if|try|with"


def _features_function():
    names = FEATURES.fieldNames()
    arrow_type = to_arrow_type(FEATURES)

    # Everything is defined in here so that it travels to the workers by value; they need no copy of this package.
    def tree_features(trees) -> tuple:
        import ast

        nodes = [node for tree in trees for node in ast.walk(tree)]
        kinds = {type(node) for node in nodes}
        modules, local = [], False
        for node in nodes:
            if type(node) is ast.Import:
                modules += [alias.name.partition(".")[0] for alias in node.names]
            elif type(node) is ast.ImportFrom:
                local = local or node.level > 0
                if node.module:
                    modules.append(node.module.partition(".")[0])
        counts: dict = {}
        for module in modules:
            counts[module] = counts.get(module, 0) + 1
        # Sorting is stable: equal counts stay in the order of first use.
        counted = [{"module": m, "n": n} for m, n in sorted(counts.items(), key=lambda item: -item[1])]
        branching = {ast.For, ast.While, ast.If, ast.Try, ast.With}
        return modules, local, ast.FunctionDef in kinds, ast.ClassDef in kinds, bool(kinds & branching), counted

    def parse(source):
        import ast
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                return ast.parse(source)
            except Exception:
                return None

    @F.arrow_udf(FEATURES)
    def features(sources: pa.Array) -> pa.Array:
        rows = []
        for cell_sources in sources.to_pylist():
            trees = [parse(s) for s in cell_sources or []]
            rows.append(dict(zip(names, tree_features([t for t in trees if t is not None]))))
        return pa.array(rows, arrow_type)

    return features


def worth_parsing(source: Column) -> Column:
    return source.rlike(KEYWORDS)


def code_features(sources: Column) -> Column:
    """Features of a list of code cell sources, read in order. Sources that do not parse contribute nothing."""
    return _features_function()(sources)


def cell_code_features(cells: DataFrame) -> DataFrame:
    """``(nb_id, cell_idx, modules, flags…)`` for code cells that may hold a feature."""
    code = cells.where((F.col("cell_type") == "code") & worth_parsing(F.col("source")))
    return code.select("nb_id", "cell_idx", code_features(F.array("source")).alias("f")).select(
        "nb_id", "cell_idx", "f.modules", *[f"f.{flag}" for flag in FLAGS]
    )


def extract_imports(features: DataFrame) -> DataFrame:
    """One row per imported top-level module occurrence: ``(nb_id, cell_idx, pos, module)``."""
    return features.select("nb_id", "cell_idx", F.posexplode("modules").alias("pos", "module"))


def feature_flag(features: DataFrame, flag: str) -> DataFrame:
    """``flag`` per notebook, for notebooks that have a row in ``features``."""
    return features.groupBy("nb_id").agg(F.bool_or(flag).alias(flag))


def local_imports(features: DataFrame) -> DataFrame:
    return feature_flag(features, "has_local_imports")


def defines_function(features: DataFrame) -> DataFrame:
    return feature_flag(features, "defines_function")


def defines_class(features: DataFrame) -> DataFrame:
    return feature_flag(features, "defines_class")


def control_flow(features: DataFrame) -> DataFrame:
    return feature_flag(features, "has_control_flow")


def testing_modules(imports: DataFrame) -> DataFrame:
    return imports.groupBy("nb_id").agg(F.bool_or(is_test_module(F.col("module"))).alias("uses_testing_module"))


def import_totals(imports: DataFrame) -> DataFrame:
    return imports.groupBy("nb_id").agg(F.count(F.lit(1)).alias("imports_total"))


def ranked_imports(imports: DataFrame, top: int = TOP_IMPORTS) -> DataFrame:
    """The ``top`` modules of each notebook, ``(nb_id, rank, module, n)``; ties go to the module seen first."""
    counts = imports.groupBy("nb_id", "module").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("cell_idx", "pos")).alias("first_seen")
    )
    order = Window.partitionBy("nb_id").orderBy(F.desc("n"), "first_seen")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "nb_id", "rank", "module", "n"
    )


def top_imports(imports: DataFrame, top: int = TOP_IMPORTS) -> DataFrame:
    """``(nb_id, top_imports)``, an array of at most ``top`` ``(module, n)`` pairs."""
    ranked = ranked_imports(imports, top).groupBy("nb_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "module", "n"))).alias("pairs")
    )
    return ranked.select(
        "nb_id", F.transform("pairs", lambda p: F.struct(p.module.alias("module"), p.n.alias("n"))).alias("top_imports")
    )


def imports_json(pairs: Column) -> Column:
    """File form of an array of ``(module, n)``: ``[["numpy", 3], ["pandas", 2]]``."""
    quoted = lambda m: F.to_json(m.cast("variant"))
    items = F.transform(pairs, lambda p: F.concat(F.lit("["), quoted(p.module), F.lit(", "), p.n.cast("string"), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
