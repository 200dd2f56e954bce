"""Compaction: which runs become one is decided on the manifest; the data step is a union and latest-wins.

Tombstones stay. The state of the log is the same before and after.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Config
from .runs import RUN_COLUMNS, manifest, newest_in


@dataclass(frozen=True)
class Run:
    run_id: int
    level: int
    min_key: str
    max_key: str
    rows: int
    bytes: int


def listed(manifest_rows: DataFrame) -> list[Run]:
    """The manifest on the driver: a row per run, not per record."""
    return sorted((Run(*r) for r in manifest_rows.select("run_id", "level", "min_key", "max_key", "rows", "bytes").collect()), key=lambda r: (r.level, r.run_id))


def size_tiered_step(runs: list[Run], config: Config) -> tuple[list[Run], int] | None:
    """The oldest runs of the first level that has enough of them, and the level they go to."""
    for level in sorted({r.level for r in runs}):
        own = sorted((r for r in runs if r.level == level), key=lambda r: r.run_id)
        if len(own) >= config.tables_to_compress and level < config.max_lsm_levels:
            return own[: config.tables_to_compress], level + 1
    return None


def leveled_step(runs: list[Run], config: Config) -> tuple[list[Run], int] | None:
    """The oldest run of the first level that is too large, with the runs of the next level that it overlaps."""
    for level in sorted({r.level for r in runs}):
        if level >= config.max_lsm_levels:
            return None
        own = sorted((r for r in runs if r.level == level), key=lambda r: r.run_id)
        if sum(r.bytes for r in own) > config.first_leveled_size * config.leveled_inc ** (level - 1):
            one = own[0]
            return [one, *(r for r in runs if r.level == level + 1 and one.min_key <= r.max_key and one.max_key >= r.min_key)], level + 1
    return None


def step(runs: list[Run], config: Config) -> tuple[list[Run], int] | None:
    return (size_tiered_step if config.compression_type == "size-tiered" else leveled_step)(runs, config)


def merged(runs: DataFrame, targets: dict[int, tuple[int, int]]) -> DataFrame:
    """``runs`` with those in ``targets`` (run_id -> new run_id, level) merged, others as they are.

    Only rows of merged runs are shuffled.
    """
    if not targets:
        return runs
    table = runs.sparkSession.createDataFrame([(k, *v) for k, v in targets.items()], "run_id long, to long, to_level int")
    moved = runs.join(F.broadcast(table), "run_id")  # a row per merged run
    new = newest_in(moved.drop("run_id", "level").withColumnsRenamed({"to": "run_id", "to_level": "level"}), "run_id", "level")
    return runs.where(~F.col("run_id").isin(*targets)).select(*RUN_COLUMNS).unionByName(new.select(*RUN_COLUMNS))


def plan_size_tiered(runs: list[Run], config: Config) -> dict[int, tuple[int, int]]:
    """Where each run ends when all steps are done. Counts alone decide, so the whole plan is known before any data moves."""
    where = {r.run_id: [r.run_id] for r in runs}
    now, next_id = list(runs), max((r.run_id for r in runs), default=-1) + 1
    while found := size_tiered_step(now, config):
        group, level = found
        now = [r for r in now if r not in group] + [replace(group[0], run_id=next_id, level=level)]
        where[next_id] = [x for r in group for x in where[r.run_id]]
        next_id += 1
    return {x: (r.run_id, r.level) for r in now for x in where[r.run_id] if x != r.run_id}


def compact(runs: DataFrame, config: Config, max_steps: int = 1000) -> DataFrame:
    """Runs after compaction until nothing is left to do.

    Size-tiered: one data step, whatever the number of merges. Leveled: sizes after a merge depend on the data, so each
    step is a job over the runs that it merges, with the result written to the shared folder.
    """
    from ..sources.scratch import materialize

    if config.compression_type == "size-tiered":
        return merged(runs, plan_size_tiered(listed(manifest(runs)), config))
    now = listed(manifest(runs))
    next_id = max((r.run_id for r in now), default=-1) + 1
    parts: dict[int, DataFrame] = {r.run_id: runs.where(F.col("run_id") == r.run_id) for r in now}
    for _ in range(max_steps):
        if not (found := leveled_step(now, config)):
            break
        group, level = found
        if len(group) == 1:
            one = parts.pop(group[0].run_id)
            made = [replace(group[0], run_id=next_id, level=level)]
            parts[next_id] = one.withColumns({"run_id": F.lit(next_id).cast("long"), "level": F.lit(level)})
        else:
            rows = parts.pop(group[0].run_id)
            for r in group[1:]:
                rows = rows.unionByName(parts.pop(r.run_id))
            new = newest_in(rows.drop("run_id", "level")).withColumns({"run_id": F.lit(next_id).cast("long"), "level": F.lit(level)}).select(*RUN_COLUMNS)
            parts[next_id] = materialize(new)
            made = listed(manifest(parts[next_id]))
        now = [r for r in now if r not in group] + made
        next_id += 1
    else:
        raise RuntimeError(f"compaction did not settle in {max_steps} steps")
    out = runs.where(F.lit(False)).select(*RUN_COLUMNS)
    for part in parts.values():
        out = out.unionByName(part.select(*RUN_COLUMNS))
    return out
