"""From a job's private staging table to the authority's: checked at both ends, then one new version.

The staging table is read as of one version, which later writes to it don't change. The authority's version that the checks
have seen is the one that is replaced: if another promotion comes between, all checks run again on what it has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustmill.operators import lifecycle as life
from trustmill.sources import versions


def schema_faults(staged: DataFrame, expected: DataFrame) -> list[str]:
    """Columns that are missing, unknown or of another type; both sides must be the same."""
    a, b = dict(staged.dtypes), dict(expected.dtypes)
    return [f"{c}: {a.get(c)} for {b.get(c)}" for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]


def read_staging(spark: SparkSession, root: str, expected: DataFrame, number: int | None = None) -> tuple[DataFrame, int]:
    """A staging table as of its last version, or the numbered one, and the number; another schema than expected is refused."""
    found = versions.current(spark, root, number)
    if found is None:
        raise FileNotFoundError(f"{root} has no valid version")
    staged = versions.read(spark, root, found["number"])
    if faults := schema_faults(staged, expected):
        raise ValueError(f"staging schema differs: {faults}")
    return staged, found["number"]


def staging_faults(staged: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """What staged facts must not be: reviewed, without a known source, there twice."""
    return {
        "staged_without_review": staged.filter("validation_status <> 'NEEDS_REVIEW'"),
        "unknown_source": staged.join(sources.select("source_key"), "source_key", "left_anti"),
        "staged_twice": staged.groupBy("fact_key").count().filter("count > 1"),
    }


def promote(spark: SparkSession, root: str, staged: DataFrame | str, sources: DataFrame | str, partition_by: tuple[str, ...] = ()) -> int | None:
    """Upserts staged facts into the versioned table at root. staged, sources: tables, or roots of versioned ones.

    Sources by root are read anew for each attempt, so a source that is superseded meanwhile is seen.
    """
    pinned: list[DataFrame] = [] if isinstance(staged, str) else [staged]

    def build(old: DataFrame | None) -> tuple[DataFrame, versions.Violations]:
        if old is None:
            raise FileNotFoundError(f"{root} has no valid version")
        if not pinned:
            pinned.append(read_staging(spark, staged, old)[0])
        if faults := schema_faults(pinned[0], old):
            raise ValueError(f"staging schema differs: {faults}")
        known = versions.read(spark, sources) if isinstance(sources, str) else sources
        # the merged table is checked as it is written, not merged again
        checks = lambda merged: staging_faults(pinned[0], known) | {"two_trusted_facts": life.violations(merged, known)["two_trusted_facts"]}
        return life.upsert_facts(old, pinned[0]), checks

    return versions.update(spark, root, build, partition_by)
