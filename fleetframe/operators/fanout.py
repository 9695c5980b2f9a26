"""Running a function once per parameter row, with a ledger of attempts.

Spark may run a task twice. With `claims`, a folder that all executors mount, an attempt belongs to
the task that first makes its claim there, by a file that can be made only once; the outcome is put
beside it. A second task finds the claim and takes the outcome over instead of calling again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.functions import settings
from fleetframe.session import shuffle_partitions

RETRY_PAUSE = 60.0
PATIENCE = 3600.0  # seconds that a task waits for the outcome of an attempt that another one claimed
LOOK_EVERY = 0.2
RESUBMITTED_PROC_ID = "RESUBMITTED_PROC_ID"


class Claims:
    """Claims of attempts below a folder, spread over sub-folders; a name may be made once."""

    def __init__(self, folder: str, patience: float = PATIENCE):
        if "://" in folder.removeprefix("file://"):
            raise ValueError("claims need a folder that every executor mounts")
        self.folder, self.patience = folder.removeprefix("file://"), patience

    def once(self, name: str, call: Callable[[], tuple]) -> tuple:
        """The outcome of the call, made here or by the task that claimed it first."""
        digest = hashlib.sha256(name.encode()).hexdigest()
        place = os.path.join(self.folder, digest[:2])
        claim, told = os.path.join(place, f"{digest}.claim"), os.path.join(place, f"{digest}.json")
        os.makedirs(place, exist_ok=True)
        try:
            os.close(os.open(claim, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return self._heard(told)
        outcome = call()
        with open(f"{told}.new", "w") as file:
            json.dump(outcome, file)
        os.replace(f"{told}.new", told)  # seen whole or not at all
        return outcome

    def _heard(self, told: str) -> tuple:
        until = time.monotonic() + self.patience
        while not os.path.exists(told):
            if time.monotonic() >= until:
                return 1, None, "the task that claimed this attempt left no outcome"
            time.sleep(LOOK_EVERY)
        with open(told) as file:
            return tuple(json.load(file))


def _call(fn: Callable, scope: dict) -> tuple:
    """One call: (exitcode, out, err)."""
    try:
        result = fn(scope)
        return 0, None if result is None else str(result), None
    except SystemExit as stop:
        code = stop.code if isinstance(stop.code, int) else int(stop.code is not None)
        code = max(-(2**31), min(code, 2**31 - 1))
        return code, None, f"exit {stop.code}" if code else None
    except Exception as error:
        return 1, None, f"{type(error).__name__}: {error}"


def _attempt(
    fn: Callable, scope: dict, allowed: int, pause: float, claims: Claims | None = None, name: str = ""
) -> tuple:
    """Call `fn` until it succeeds or the attempts are used up: (attempts, exitcode, out, err)."""
    outcome = (0, 1, None, "no attempt allowed")
    for attempt in range(1, allowed + 1):
        told = {**scope, "attempt": attempt}
        if claims:
            result = claims.once(f"{name} {attempt}", lambda told=told: _call(fn, told))
        else:
            result = _call(fn, told)
        outcome = (attempt, *result)
        if result[0] == 0:
            break
        if attempt < allowed and pause:
            time.sleep(pause)
    return outcome


def fan_out(
    params: DataFrame,
    fn: Callable[[dict], object],
    keys: list[str],
    attempts: int | str = 1,
    pause: float = RETRY_PAUSE,
    round_no: int = 0,
    partitions: int | None = None,
    claims: str | None = None,
    patience: float = PATIENCE,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Ledger of one call of `fn` per row, with the row and the `attempt` as its scope.

    A failing row is recorded and does not stop the others. `attempts` is a number or a column
    with the number of tries of the row; a row without a number has one. Exit codes beyond 32
    bits become the nearest code within. Spark may run a task twice: without `claims`, `fn` has to be
    repeatable; with them each attempt of a row and round calls it once, and a claim whose task was
    lost counts as a failed attempt after `patience` seconds. Rows are told apart by their keys. The
    ledger is read through `latest_attempt` either way. `profile` asks for executors and task shares
    of its own for this stage, so that a function with much memory does not set the size of all.
    """
    allowed = F.col(attempts) if isinstance(attempts, str) else F.lit(attempts)
    spec = params.withColumn("_allowed", F.coalesce(allowed, F.lit(1)))
    schema = T.StructType(
        [params.schema[key] for key in keys]
        + [
            T.StructField("round", T.IntegerType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("exitcode", T.IntegerType()),
            T.StructField("out", T.StringType()),
            T.StructField("err", T.StringType()),
        ]
    )
    names = [field.name for field in schema]

    held = Claims(claims, patience) if claims else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for scope in batch.to_pylist():
                name = json.dumps([round_no, *(scope[key] for key in keys)], default=str)
                records.append(_attempt(fn, scope, scope.pop("_allowed"), pause, held, name))
            tried, codes, outs, errs = zip(*records) if records else ((), (), (), ())
            columns = [batch.column(key) for key in keys] + [
                pa.array([round_no] * len(records), pa.int32()),
                pa.array(tried, pa.int32()),
                pa.array(codes, pa.int32()),
                pa.array(outs, pa.string()),
                pa.array(errs, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = spec.repartition(partitions or shuffle_partitions(params.sparkSession), *keys)
    return spread.mapInArrow(run, schema, profile=profile)


def first_job(params: DataFrame, order: str) -> DataFrame:
    """The job a trial run would execute."""
    return params.orderBy(order).limit(1)


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append the records of a round, one folder per round."""
    ledger.write.mode("append").partitionBy("round").parquet(path)


def latest_attempt(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Last record per job; records that a repeated task wrote twice count once."""
    record = F.struct("round", "attempts", "exitcode", "out", "err")
    last = ledger.groupBy(*keys).agg(F.max_by(record, F.struct("round", "attempts")).alias("_r"))
    return last.select(*keys, "_r.*")


def failed_params(params: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Parameter rows whose last attempt failed."""
    failed = latest_attempt(ledger, keys).filter(F.col("exitcode") != 0).select(*keys)
    return params.join(failed, keys, "left_semi")


def rerun_failed(
    params: DataFrame, path: str, fn: Callable[[dict], object], keys: list[str], **options
) -> DataFrame:
    """Run the failed rows of a written ledger again, append the records, return the ledger."""
    spark = params.sparkSession
    ledger = spark.read.parquet(path)
    next_round = ledger.agg(F.max("round")).first()[0] + 1
    again = fan_out(
        failed_params(params, ledger, keys), fn, keys, round_no=next_round, **options
    )
    append_ledger(again, path)
    return spark.read.parquet(path)


def resubmission_plan(
    jobs: DataFrame, environment: str = "environment", proc_key: str = RESUBMITTED_PROC_ID
) -> DataFrame:
    """One single-job row per failed job, its old proc id in an environment of its own."""
    old = F.create_map(F.lit(proc_key), F.col("proc_id").cast("string"))
    return jobs.filter(F.col("failed")).withColumns(
        {environment: settings.merge_maps(F.col(environment), old), "njobs": F.lit(1)}
    )


def resubmitted_proc_id(environment: Column, proc_key: str = RESUBMITTED_PROC_ID) -> Column:
    return F.try_element_at(environment, F.lit(proc_key)).try_cast("int")
