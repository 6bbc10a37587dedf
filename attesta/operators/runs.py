"""Runs that write several tables and publish them together, by one small file written last."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.operators.store import _names, drop_folder, get_text, put_text


def _published(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_runs") if n.endswith(".json")]


def current(spark: SparkSession, path: str) -> dict:
    """What the last published run left: runs (their ids, in order), places (folders of each table) and schemas; empty before any."""
    found = _published(spark, path)
    return json.loads(get_text(spark, f"{path}/_runs/{found[-1]:010d}.json")) if found else {"runs": [], "places": {}, "schemas": {}}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last published run left it."""
    from pyspark.sql.types import StructType

    state = current(spark, path)
    return spark.read.schema(StructType.fromJson(state["schemas"][name])).parquet(*state["places"][name])


def publish(spark: SparkSession, path: str, run_id: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], appended: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Write the tables of a run and publish all at once; gives them as written.

    A table may be a function of those written before it. `appended` tables are added to what earlier runs wrote, others take its place. Each
    table is a folder of the run's own. A run that was killed goes on where it was: folders that were finished (their _SUCCESS is there)
    are kept, the one that wasn't is written again, and readers see nothing of it until the one file that names them all is
    there. A run that has been published already changes nothing. Run ids are single use; one writer at a time.
    """
    state = current(spark, path)
    folder = lambda name: f"{path}/data/{name}/run={run_id}"
    done: dict[str, DataFrame] = {}
    over = run_id in state["runs"]
    for name, made in tables.items():
        if "_SUCCESS" not in _names(spark, folder(name)):
            if over:
                continue  # a later run has taken its place
            df = made(done) if callable(made) else made
            df.write.mode("overwrite").parquet(folder(name))
        done[name] = spark.read.parquet(folder(name))
        state["schemas"][name] = done[name].schema.jsonValue()
    if over:
        return done
    places = state["places"] | {name: [*(state["places"].get(name, []) if name in appended else []), folder(name)] for name in tables}
    number = len(state["runs"])
    put_text(spark, f"{path}/_runs/{number:010d}.json", json.dumps({"runs": [*state["runs"], run_id], "places": places, "schemas": state["schemas"]}))
    if number > 1:  # readers may still be at the run before; what only the one before that names can go
        older = json.loads(get_text(spark, f"{path}/_runs/{number - 2:010d}.json"))["places"]
        kept = {f for named in (places, state["places"]) for folders in named.values() for f in folders}
        for f in {f for folders in older.values() for f in folders} - kept:
            drop_folder(spark, f)
    return done
