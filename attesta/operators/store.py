"""Tables by key in hash buckets: a merge rewrites only the buckets that it touches, and a small pointer file, written last, says which
files count."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
#: Versions that stay readable after a merge, the new one included.
KEPT = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Without one, a temporary folder serves a single
    machine, and a cluster is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read back, and its folder: cuts the lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, place = _at(spark, path)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there whole or not at all: written under another name and renamed."""
    fs, place = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place) or not fs.rename(part, place):
        fs.delete(part, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    source = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_versions") if n.endswith(".json")]


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of: its keys, columns, the version that wrote each bucket, and the last batch of each writer."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    return json.loads(get_text(spark, f"{path}/_versions/{found[-1] if version is None else version:010d}.json"))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def applied(spark: SparkSession, path: str, writer: str) -> int:
    """The last batch of a writer that the table has, or -1."""
    return _state(spark, path)["applied"].get(writer, -1)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, folder: str, tasks: int) -> None:
    df.repartition(max(1, tasks), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)


def write_table(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A new table of rows unique in `keys`. buckets: so many that one is a good task's work at the size that the table will have."""
    spark = df.sparkSession
    if BUCKET in df.columns:
        raise ValueError(f"a column may not be named {BUCKET}")
    if exists(spark, path):
        raise FileExistsError(path)
    _write(bucketed(df, keys, buckets), f"{path}/data/version=0", buckets)
    state = {"version": 0, "keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "places": {}, "applied": {}}
    _publish(spark, path, state, 0, range(buckets))


def _publish(spark: SparkSession, path: str, state: dict, version: int, touched) -> None:
    """Point to the new version: the buckets that it wrote, and the others as they were."""
    there = {int(n.split("=")[1]) for n in _names(spark, f"{path}/data/version={version}") if n.startswith(BUCKET)}
    places = {b: v for b, v in state["places"].items() if int(b) not in set(touched)}
    state |= {"version": version, "places": places | {str(b): version for b in there}}
    put_text(spark, f"{path}/_versions/{version:010d}.json", json.dumps(state))


def read_table(spark: SparkSession, path: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The table as its last (or another kept) version has it; of some buckets alone if given."""
    state = _state(spark, path, version)
    schema = StructType.fromJson(state["schema"])
    chosen = [(b, v) for b, v in state["places"].items() if buckets is None or int(b) in set(buckets)]
    folders = [f"{path}/data/version={v}/{BUCKET}={b}" for b, v in chosen]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets_of(keys: DataFrame, path: str) -> tuple[DataFrame, list[int]]:
    """The buckets that hold the given keys, and their numbers; no other data is read. keys must have the table's key columns."""
    state = _state(keys.sparkSession, path)
    rows = bucketed(keys.select(*state["keys"]), state["keys"], state["buckets"]).select(BUCKET).distinct().collect()  # at most `buckets` rows
    touched = sorted(r[0] for r in rows)
    return read_table(keys.sparkSession, path, touched), touched


def replacing(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge that takes the incoming row where a key is in both."""
    return lambda old, new: old.join(new.select(*keys).hint("merge"), keys, "left_anti").unionByName(new)


def merge_table(incoming: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, writer: str = "", batch: int | None = None) -> dict:
    """Merge rows into the table at path, rewriting only the buckets of their keys.

    merge: from (old rows, incoming rows) of those buckets to their new rows; by default incoming rows (unique by key) replace old ones of
    their key. writer, batch: a batch that this writer has already merged changes nothing, so that it may be sent again.
    The pointer is written last: a run that is killed before leaves the version that was, and its files are overwritten by the
    next. Versions before the last KEPT are dropped. One writer at a time. Returns version, buckets (touched) and bytes (written).
    """
    spark = incoming.sparkSession
    state = _state(spark, path)
    if batch is not None and state["applied"].get(writer, -1) >= batch:
        return {"version": state["version"], "buckets": [], "bytes": 0}
    keys, version = state["keys"], state["version"] + 1
    staged, stage = written(bucketed(incoming, keys, state["buckets"]), "incoming")
    touched = sorted(r[0] for r in staged.select(BUCKET).distinct().collect())  # at most `buckets` rows
    folder = f"{path}/data/version={version}"
    drop_folder(spark, folder)  # what a killed run may have left
    if touched:
        columns = StructType.fromJson(state["schema"]).names
        rows = (merge or replacing(keys))(read_table(spark, path, touched), staged.drop(BUCKET)).select(*columns)
        _write(bucketed(rows, keys, state["buckets"]), folder, len(touched))
    if batch is not None:
        state["applied"][writer] = batch
    size = folder_bytes(spark, folder)
    _publish(spark, path, state, version, touched)
    drop_folder(spark, stage)
    drop_old_versions(spark, path)
    return {"version": version, "buckets": touched, "bytes": size}


def drop_old_versions(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Forget all versions but the last `kept`, and delete the files that only those named."""
    versions = _versions(spark, path)
    used = {(int(v), int(b)) for x in versions[-kept:] for b, v in _state(spark, path, x)["places"].items()}
    for x in versions[:-kept]:
        drop_folder(spark, f"{path}/_versions/{x:010d}.json")
    for folder in _names(spark, f"{path}/data"):
        v = int(folder.split("=")[1])
        there = [int(n.split("=")[1]) for n in _names(spark, f"{path}/data/{folder}") if n.startswith(BUCKET)]
        if v > versions[-1]:
            continue  # being written
        if not any((v, b) in used for b in there):
            drop_folder(spark, f"{path}/data/{folder}")
        else:
            for b in there:
                if (v, b) not in used:
                    drop_folder(spark, f"{path}/data/{folder}/{BUCKET}={b}")
