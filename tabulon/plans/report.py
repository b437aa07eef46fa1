"""Batch report: a list of analyses over one table, which is read once per round for all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tabulon.errors import AnalysisError
from tabulon.functions.frames import small_frame
from tabulon.functions.rounds import solve_all
from tabulon.operators.select import sample_of_equals, sample_rows, select_columns
from tabulon.plans.analyses import ANALYSES, steps_of
from tabulon.sources.writers import write_json_document, write_tables

# Fixed value: the jobs of a report that asks for nothing.
DEFAULT_JOBS = ({"analysis": "overview", "params": {}}, {"analysis": "descriptive", "params": {}})


def usable_jobs(jobs: Sequence[Any]) -> list[dict[str, Any]]:
    """Every job as name and parameters, in order, without unknown names; the default jobs if none is left."""
    def read(job: Any) -> dict[str, Any]:
        known = job if isinstance(job, Mapping) else {"analysis": job}
        params = known.get("params")
        return {"analysis": str(known.get("analysis") or "").strip(), "params": dict(params) if isinstance(params, Mapping) else {}}

    known = [job for job in map(read, jobs or ()) if job["analysis"] in ANALYSES]
    return known or [read(job) for job in DEFAULT_JOBS]


def report_input(df: DataFrame, columns: Sequence[str] = (), n: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """The asked columns and, if a size is given, a repeatable sample of the rows."""
    table = df if not n else sample_rows(df, n, list(key)) if key else sample_of_equals(df, n)
    return select_columns(table, columns)


def run_report(df: DataFrame, jobs: Sequence[Any], folder: str | None = None) -> DataFrame:
    """``job, analysis, status, table, n_rows``: one line per result table, or per failed job.

    What the jobs ask for is read in rounds, all jobs in one reading of the table per round. A job whose input is unusable is noted
    and the others go on; any other error, such as a lost cluster, ends the report. With a folder, every table is written below it
    along with a manifest; its rows are counted while it is written.
    """
    lines, manifest = [], []
    usable = usable_jobs(jobs)
    results = solve_all(df, [steps_of(df, job["analysis"], job["params"]) for job in usable])
    for i, (job, result) in enumerate(zip(usable, results), start=1):
        key = f"job{i}_{job['analysis']}"
        try:
            if isinstance(result, AnalysisError):
                raise result
            paths, sizes = write_tables(result.tables, folder, key) if folder else ({}, {
                name: table.count() for name, table in result.tables.items()})
        except AnalysisError as problem:
            lines.append((key, job["analysis"], f"failed: {problem.code}", None, None))
            manifest.append({"job": key, **job, "status": "failed", "reason": str(problem)[:500]})
            continue
        lines += [(key, job["analysis"], "done", name, size) for name, size in sizes.items()]
        manifest.append({"job": key, **job, "status": "done", "tables": [
            {"name": name, "rows": size, "path": paths.get(name)} for name, size in sizes.items()]})
    spark = df.sparkSession
    if folder:
        write_json_document(spark, {"jobs": manifest}, f"{folder.rstrip('/')}/manifest")
    return small_frame(spark, lines, "job string, analysis string, status string, table string, n_rows long")
