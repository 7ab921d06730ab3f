"""Operators on whole documents: decoding, shredding, in-row metrics, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.functions import documents as D
from nbquarry.operators import code as G, filters, outputs as O, shred
from nbquarry.plans.collect import build_collection, collect_and_archive, collect_windows, collected_originals, keep_unparsed, notebook_metrics
from nbquarry.schema import COLLECTION_FIELDS, DEPENDENCY_FIELDS, IDENTITY_FIELDS
from nbquarry.session import configure
from nbquarry.sources import archive
from registry import fixtures as X
from registry.book import checked
from registry.sampling_queries import WINDOWS
from registry.scratch import scratch_path

_DOC = f"with {X.DUCK_DOC_CELLS}"
_IS_PYTHON = f"contains(lower({X.LANGUAGE.format(nb='nb_id')}), 'python')"
_ALL_IDS = "(select doc_id as nb_id from documents)"
_UNDECODED = X.UNDECODED.format(nb="nb_id")


def _notebooks(spark, sf):
    return archive.decode_contents(X.contents(configure(spark), sf))


@checked("decode_contents", f"""{_DOC}
select a.nb_id, m.nb_id is not null as decoded, m.n_cells_total as n_cells from {_ALL_IDS} a left join doc_metrics m using (nb_id)""")
def decode_contents(spark, sf):
    return _notebooks(spark, sf).select(
        "nb_id", F.col("doc").isNotNull().alias("decoded"),
        F.array_size(D.list_items(F.col("doc"), "$.cells")).cast("bigint").alias("n_cells"),
    )


@checked("keep_unparsed", f"select nb_id, not {_UNDECODED} as nb_ok_parse from {_ALL_IDS} where {_UNDECODED} or {_IS_PYTHON}")
def keep(spark, sf):
    return keep_unparsed(_notebooks(spark, sf)).select("nb_id", F.col("doc").isNotNull().alias("nb_ok_parse"))


@checked("filter_python", f"select nb_id from {_ALL_IDS} where not {_UNDECODED} and {_IS_PYTHON}")
def filter_python(spark, sf):
    return filters.filter_python(_notebooks(spark, sf)).select("nb_id")


@checked("filter_executed_state", f"""{_DOC}
select nb_id, n_cells_with_output, max_execution_count from doc_all
where n_cells_with_output > 0 and not (percent_code_executed <= 0 and max_execution_count <= 0)""")
def filter_executed_state(spark, sf):
    kept = filters.filter_executed_state(notebook_metrics(_notebooks(spark, sf)))
    return kept.select("nb_id", "n_cells_with_output", "max_execution_count")


@checked("kernel_metadata", f"""{_DOC} select nb_id, kernel_name, language, python_version_declared from doc_all""")
def kernel_metadata(spark, sf):
    doc = F.col("doc")
    return _notebooks(spark, sf).where(doc.isNotNull()).select(
        "nb_id", D.kernel_name(doc).alias("kernel_name"), D.language(doc).alias("language"),
        D.language_version(doc).alias("python_version_declared"),
    )


@checked("explode_cells", f"""{_DOC}
select nb_id, cell_idx, cell_type, execution_count, execution_count_set,
  case out_kind when 7 then 0 else 1 end as n_outputs,
  case out_kind when 0 then 'text/plain' when 1 then 'image/png,text/plain' when 2 then 'text/html'
    when 3 then 'application/vnd.plotly.v1+json' when 4 then 'text/latex' else '' end as mimes
from doc_cells""")
def explode_cells(spark, sf):
    cells = shred.explode_cells(_notebooks(spark, sf))
    return cells.select(
        "nb_id", "cell_idx", "cell_type", "execution_count", "execution_count_set", "n_outputs",
        F.array_join(F.array_sort("mime_types"), ",").alias("mimes"),
    )


@checked("as_text", f"{_DOC} select nb_id, cell_idx, source from doc_cells")
def as_text(spark, sf):
    return shred.explode_cells(_notebooks(spark, sf)).select("nb_id", "cell_idx", "source")


def _outputs(spark, sf):
    return shred.explode_outputs(_notebooks(spark, sf))


@checked("explode_outputs", f"""{_DOC}
select nb_id, cell_idx, 0 as output_idx, case when out_kind = 2 then 'execute_result' when out_kind = 5 then 'error'
  when out_kind = 6 then 'stream' else 'display_data' end as output_type from doc_cells where out_kind < 7""")
def explode_outputs(spark, sf):
    return _outputs(spark, sf).select(
        "nb_id", "cell_idx", "output_idx", F.try_variant_get("output", "$.output_type", "string").alias("output_type")
    )


@checked("explode_mime", f"{_DOC} select nb_id, cell_idx, 0 as output_idx, mime from doc_cells join mimes using (out_kind)")
def explode_mime(spark, sf):
    return shred.explode_mime(_outputs(spark, sf))


# What is measured of a document: all columns of the collection but facts about the file and its repository.
_METRICS = [f for f in COLLECTION_FIELDS if f not in IDENTITY_FIELDS + DEPENDENCY_FIELDS]


@checked("notebook_metrics", f"{_DOC} select nb_id, {', '.join(_METRICS)} from doc_all")
def metrics(spark, sf):
    notebooks = _notebooks(spark, sf).where(F.col("doc").isNotNull())
    return notebook_metrics(notebooks).select("nb_id", *_METRICS)


_REPOS = """
repos as (
  select 'org' || cast(k % 20 as varchar) || '/repo' || cast(k as varchar) as repo_full_name, k as repo_id,
    case when k % 3 = 0 then 'main' else 'dev' end as repo_default_branch,
    timestamp '2025-01-01 00:00:00' + to_days(cast(k as integer)) as repo_created_at, k % 7 as repo_stars
  from (select distinct p_partkey % 190 as k from part) p),
deps as (
  select repo_full_name, bool_or(lower(path) like '%requirements.txt') as deps_requirements_txt,
    bool_or(lower(path) like '%setup.py') as deps_setup_py, bool_or(lower(path) like '%pipfile') as deps_pipfile
  from fx_tree group by repo_full_name)
"""


def _large(spark, sf):
    """The same notebooks with most of them counted as large: those are read as a stream of chunks."""
    return archive.decode_contents(X.contents(configure(spark), sf), large_bytes=1 << 10)


@checked("notebook_metrics_large", f"{_DOC} select nb_id, {', '.join(_METRICS)} from doc_all")
def metrics_large(spark, sf):
    notebooks = _large(spark, sf)
    return notebook_metrics(notebooks.where(D.is_decoded(notebooks))).select("nb_id", *_METRICS)


@checked("outputs_hash_large", f"{_DOC} select nb_id, outputs_hash, n_outputs from fingerprints")
def outputs_hash_large(spark, sf):
    notebooks = _large(spark, sf)
    return O.outputs_hash(notebooks.where(D.is_decoded(notebooks)))


@checked("explode_mime_large", f"{_DOC} select nb_id, cell_idx, 0 as output_idx, mime from doc_cells join mimes using (out_kind)")
def explode_mime_large(spark, sf):
    return shred.explode_mime(shred.explode_outputs(_large(spark, sf)))


@checked("build_collection", f"""{_DOC}, {X.duck_views('fx_tree')}, {_REPOS},
ids as (
  select nb_id, {X.REPO.format(nb='nb_id')} as repo_full_name, {_UNDECODED} as undecoded
  from {_ALL_IDS} where {_UNDECODED} or {_IS_PYTHON}),
known as (select * from repos r left join deps d using (repo_full_name))
select i.repo_full_name, repo_id, repo_default_branch, repo_created_at, repo_stars,
  'nb/' || cast(i.nb_id as varchar) || '.ipynb' as file_path, sha1(cast(i.nb_id as varchar)) as file_sha,
  i.nb_id * 10 as file_size, 'https://example.org/' || cast(i.nb_id as varchar) as html_url,
  not undecoded as nb_ok_parse, {', '.join('m.' + m for m in _METRICS)},
  case when not undecoded then coalesce(deps_requirements_txt, false) end as deps_requirements_txt,
  case when not undecoded then coalesce(deps_setup_py, false) end as deps_setup_py,
  case when not undecoded then coalesce(deps_pipfile, false) end as deps_pipfile,
  case when not undecoded then coalesce(deps_requirements_txt or deps_setup_py or deps_pipfile, false) end as deps_any
from ids i left join doc_all m using (nb_id) left join known using (repo_full_name)
where undecoded or (n_cells_with_output > 0 and not (percent_code_executed <= 0 and max_execution_count <= 0))""")
def collection(spark, sf):
    """The whole first stage: decode, filter, measure, join with repositories."""
    configure(spark)
    return build_collection(
        X.contents(spark, sf), X.repos(spark, sf), X.view(spark, sf, "fx_tree"), require_outputs=True
    )


_WINDOW_ROWS = f"""{_DOC}, {X.duck_views('fx_tree')}, {_REPOS}, {WINDOWS},
ids as (
  select nb_id, {X.REPO.format(nb='nb_id')} as repo_full_name, 'nb/' || cast(nb_id as varchar) || '.ipynb' as file_path, {_UNDECODED} as undecoded
  from {_ALL_IDS} where {_UNDECODED} or {_IS_PYTHON}),
found as (
  select i.*, r.repo_created_at, r.repo_id from ids i left join doc_all m using (nb_id) join repos r using (repo_full_name)
  where undecoded or (n_cells_with_output > 0 and not (percent_code_executed <= 0 and max_execution_count <= 0))),
ranked as (
  select *, row_number() over (partition by window_id order by repo_created_at desc, repo_id, repo_full_name, file_path) as quota_rank
  from found join windows on cast(repo_created_at as date) between a and b),
window_rows as (select * from ranked where quota_rank <= quota)"""


def _windows(spark, sf):
    configure(spark)
    return collect_windows(X.contents(spark, sf), X.repos(spark, sf), X.view(spark, sf, "fx_tree"), require_outputs=True)


@checked("collect_windows", f"{_WINDOW_ROWS} select window_id, quota_rank, repo_full_name, file_path, not undecoded as nb_ok_parse from window_rows")
def windows(spark, sf):
    return _windows(spark, sf).select("window_id", "quota_rank", "repo_full_name", "file_path", "nb_ok_parse")


@checked("collected_originals", f"{_WINDOW_ROWS} select nb_id from window_rows where not undecoded")
def originals(spark, sf):
    """What of the windows' collection goes to the archive."""
    path = scratch_path(spark, "windows")
    _windows(spark, sf).write.parquet(path)
    return collected_originals(X.contents(spark, sf), spark.read.parquet(path)).where("doc is not null").select("nb_id")


@checked("collect_and_archive", f"""{_WINDOW_ROWS}
select 'org' || cast(w.nb_id % 20 as varchar) as owner, 'repo' || cast(w.nb_id % 200 as varchar) as repo,
  left(sha1(cast(w.nb_id as varchar)), 8) || '_' || cast(w.nb_id as varchar) || '.ipynb' as archive_name, n_cells_total as n_cells
from window_rows w join doc_metrics using (nb_id) where not undecoded""")
def collect_archive(spark, sf):
    """The archive of the windows' collection, from one decoding."""
    configure(spark)
    _, rows = collect_and_archive(
        X.contents(spark, sf), X.repos(spark, sf), X.view(spark, sf, "fx_tree"), scratch_path(spark, "measured"), require_outputs=True
    )
    found = archive.with_document(rows.withColumnRenamed("raw", "_text"))
    return found.select("owner", "repo", "archive_name", F.array_size(D.cells_of(found)).cast("bigint").alias("n_cells"))


def _code_feature(name: str, flag: str, kinds: str) -> None:
    @checked(name, f"""{_DOC}
select nb_id, bool_or(code_kind in ({kinds})) as {flag} from doc_cells where cell_type = 'code' group by nb_id""")
    def query(spark, sf):
        # Every code cell is kept here, so that notebooks without the feature show up as well.
        cells = shred.explode_cells(_notebooks(spark, sf)).where("cell_type = 'code'")
        features = cells.select("nb_id", G.code_features(F.array("source")).alias("f")).select("nb_id", "f.*")
        return G.feature_flag(features, flag)


_code_feature("local_imports", "has_local_imports", "4")
_code_feature("defines_function", "defines_function", "7")
_code_feature("defines_class", "defines_class", "8")
_code_feature("control_flow", "has_control_flow", "9")


@checked("canonical_outputs", f"""{_DOC}
select nb_id, row_number() over (partition by nb_id order by cell_idx) - 1 as output_idx, canon
from doc_cells where canon is not null""")
def canonical_outputs(spark, sf):
    canon = O.canonical_outputs(_notebooks(spark, sf))
    fields = [c for c in canon.columns if c not in ("nb_id", "output_idx")]
    return canon.select("nb_id", "output_idx", F.to_json(F.struct(*fields)).alias("canon"))


@checked("outputs_hash", f"{_DOC} select nb_id, outputs_hash, n_outputs from fingerprints")
def outputs_hash(spark, sf):
    return O.outputs_hash(_notebooks(spark, sf).where(F.col("doc").isNotNull()))


@checked("write_notebook_archive", f"""{_DOC}
select 'org' || cast(nb_id % 20 as varchar) as owner, 'repo' || cast(nb_id % 200 as varchar) as repo,
  left(sha1(cast(nb_id as varchar)), 8) || '_' || cast(nb_id as varchar) || '.ipynb' as archive_name,
  n_cells_total as n_cells from doc_metrics""")
def write_archive(spark, sf):
    path = scratch_path(spark, "archive")
    notebooks = _notebooks(spark, sf).withColumnRenamed("sha", "file_sha")
    archive.write_notebook_archive(notebooks, path)
    return archive.read_archive_table(spark, path).select(
        "owner", "repo", "archive_name",
        F.array_size(D.list_items(F.col("doc"), "$.cells")).cast("bigint").alias("n_cells"),
    )


def _archive_folder(spark, sf) -> str:
    """The decoded notebooks as named files."""
    base = scratch_path(spark, "archive")
    archive.write_archive_files(_notebooks(spark, sf).withColumnRenamed("sha", "file_sha"), base)
    return base


@checked("read_notebook_archive", f"""{_DOC}
select 'org' || cast(nb_id % 20 as varchar) as owner, 'repo' || cast(nb_id % 200 as varchar) as repo,
  left(sha1(cast(nb_id as varchar)), 8) || '_' || cast(nb_id as varchar) || '.ipynb' as archive_name, n_cells_total as n_cells,
  outputs_hash, n_outputs
from doc_metrics join fingerprints using (nb_id)""")
def read_archive(spark, sf):
    """Written as named files and read back."""
    keep = ["owner", "repo", "archive_name", "n_cells"]
    found = archive.read_notebook_archive(spark, _archive_folder(spark, sf))
    return O.outputs_hash(found.withColumn("n_cells", F.array_size(D.cells_of(found)).cast("bigint")), keep)


@checked("read_notebook_archive_of_owner", f"""{_DOC}
select 'repo' || cast(nb_id % 200 as varchar) as repo, count(*) as n, sum(n_cells_total)::bigint as n_cells from doc_metrics
where nb_id % 20 in (3, 7) and nb_id % 200 in (3, 7, 23, 50) group by 1""")
def read_archive_of_owner(spark, sf):
    """Only the folders of two owners are listed."""
    found = archive.read_notebook_archive(spark, _archive_folder(spark, sf)).where("owner in ('org3', 'org7') and repo in ('repo3', 'repo7', 'repo23', 'repo50')")
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_size(D.cells_of(found))).alias("n_cells"))
