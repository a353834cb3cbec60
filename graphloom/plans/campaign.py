"""Campaigns: ordered steps with a state that survives a restart."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST_LINES = 100_000
PENDING, RUNNING, DONE, FAILED = "pending", "running", "done", "failed"


def run_campaign(steps: Sequence[tuple[str, Callable[[], object]]], state_file: str, resume: bool = True, stop_on_failure: bool = True) -> dict[str, str]:
    """Runs the steps in order; the state is written after each change, and a resumed run skips what is done."""
    path = Path(state_file)
    state = json.loads(path.read_text()) if resume and path.exists() else {}
    state = {name: DONE if state.get(name) == DONE else PENDING for name, _ in steps}

    def put(name: str, value: str) -> None:
        state[name] = value
        part = path.with_suffix(".part")
        part.write_text(json.dumps(state))
        part.replace(path)

    for name, step in steps:
        if state[name] == DONE:
            continue
        put(name, RUNNING)
        try:
            step()
        except Exception:  # noqa: BLE001  any failure of a step is the campaign's to record
            put(name, FAILED)
            if stop_on_failure:
                break
        else:
            put(name, DONE)
    return state


def by_repository(jobs: Sequence[tuple[str, Callable[[], object]]], workers: int = 4) -> dict[str, list[object]]:
    """Jobs of one repository run one after the other, repositories side by side; Spark's scheduler shares the cores."""
    groups: dict[str, list[Callable[[], object]]] = {}
    for repo, job in jobs:
        groups.setdefault(repo, []).append(job)
    with ThreadPoolExecutor(max(1, workers)) as pool:
        found = {repo: pool.submit(lambda js=js: [j() for j in js]) for repo, js in groups.items()}
    return {repo: f.result() for repo, f in found.items()}


def manifest_digest(lines: DataFrame, column: str, most: int = MANIFEST_LINES) -> DataFrame:
    """N8 of a manifest that a column lists: one row `n_lines, manifest_sha256` of its distinct values, in order, a line each.

    A digest needs the text in one place, so a manifest has a bound; a longer one is an error and never cut.
    """
    few = lines.select(F.col(column).cast("string").alias("_line")).where("_line IS NOT NULL").distinct().limit(most + 1)
    told = few.agg(F.count("*").alias("n_lines"), F.sha2(F.array_join(F.sort_array(F.collect_list("_line")), "\n"), 256).alias("manifest_sha256"))
    too_long = F.raise_error(F.lit(f"a manifest of more than {most} lines")).cast("string")
    return told.select("n_lines", F.when(F.col("n_lines") > most, too_long).otherwise(F.col("manifest_sha256")).alias("manifest_sha256"))


def provenance(manifest: str, versions: dict[str, str] | None = None) -> dict[str, str]:
    """Digest of a manifest's text, versions of what ran it, and the commit of the code where it lies in a repository."""
    import subprocess

    import pyspark

    found = subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return {"git_sha": found.stdout.strip() or "unknown", "manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest(), "python": platform.python_version(), "pyspark": pyspark.__version__} | (versions or {})
