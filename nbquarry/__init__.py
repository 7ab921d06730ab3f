"""Analytics over corpora of notebooks and of their runs, as Spark jobs."""

from nbquarry.plans.collect import build_collection, notebook_metrics
from nbquarry.plans.report import corpus_report
from nbquarry.plans.run_table import run_table
from nbquarry.session import configure

__all__ = ["build_collection", "configure", "corpus_report", "notebook_metrics", "run_table"]
