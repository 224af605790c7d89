"""Extraction by an outside service: bounded calls, errors as rows, and runs that go on where others ended.

    run(prompts, call, path)          # prompts: name, prompt
    results(spark, path)              # name, response, body
    failures(spark, path)             # name, attempts, error

A run asks for what the stored runs haven't answered, by an anti join of name
and prompt (a changed prompt is a new one), unless it has failed as often as the
budget allows. Its rows become visible at its end, all together. A call that
raises is a row with the error; the job goes on. A task that is lost calls again
for its own prompts, so a call may be paid for twice then, but is stored once.

A task has up to `at_once` calls under way, and prompts are dealt to `tasks`
tasks, so at most tasks * at_once calls run at a time. Null prompts are asked as
empty ones; a null answer is an error. Of repeated rows one is asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fenced
from .written import exists

_ROW = "name string, digest string, response string, error string"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    rows = f"{_ROW}, run string"
    return spark.read.schema(rows).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows)


def pending(prompts: DataFrame, path: str, attempts: int = 3) -> DataFrame:
    """name, digest, prompt that no run has answered and that may be tried again."""
    asked = prompts.select("name", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("digest", F.sha2("prompt", 256)).dropDuplicates(["name", "digest"])
    past = _stored(prompts.sparkSession, path).groupBy(F.col("name").alias("n"), F.col("digest").alias("d")).agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count(F.lit(1)).alias("tried"))
    over = past.filter((F.col("ok") > 0) | (F.col("tried") >= attempts))
    return asked.join(over, F.col("name").eqNullSafe(F.col("n")) & (F.col("digest") == F.col("d")), "left_anti")


def run(prompts: DataFrame, call: Callable[[str], str], path: str, attempts: int = 3, at_once: int = 4, tasks: int = 8) -> DataFrame:
    """Calls for what is pending and stores it; name, digest, response, error of this run."""

    def ask(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                answer = call(prompt)
                return (answer, None) if isinstance(answer, str) else (None, f"no text: {answer!r}"[:2000])
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:2000]

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                for i in range(0, len(pdf), 4 * at_once):
                    part = pdf.iloc[i : i + 4 * at_once]
                    answers = list(pool.map(one, part["prompt"]))
                    yield pd.DataFrame({"name": part["name"].values, "digest": part["digest"].values, "response": [a for a, _ in answers], "error": [e for _, e in answers]}, dtype="object")

    spark, own = prompts.sparkSession, f"{path.rstrip('/')}/run={uuid.uuid4().hex}"
    pending(prompts, path, attempts).repartition(tasks).select("name", "digest", "prompt").mapInPandas(ask, _ROW).write.parquet(own)
    return spark.read.schema(_ROW).parquet(own)


def results(spark: SparkSession, path: str, language: str = "yaml") -> DataFrame:
    """name, digest, response, and the fenced block in it (body; null if it has none) of all answered prompts."""
    return _stored(spark, path).filter("error IS NULL").groupBy("name", "digest").agg(F.min("response").alias("response")).withColumn("body", fenced("response", language))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """name, digest, attempts, error (of one of them) of prompts without an answer."""
    rows = _stored(spark, path).groupBy("name", "digest").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count(F.lit(1)).alias("attempts"), F.max("error").alias("error"))
    return rows.filter("ok = 0").drop("ok")
