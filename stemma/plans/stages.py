"""Stage plans: ordered DataFrame steps with contracts, written outputs, resume, and recovery of failed tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import written

State = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named step state -> state with the tables it needs and makes; `filled` ones must have a row afterwards."""

    name: str
    run: Callable[[State], State]
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()


class ContractError(ValueError):
    """A stage lacks a table it needs, or hasn't made what it promised."""


@dataclass
class Plan:
    """Stages in order. Each one's tables are written below `folder`, and a manifest row marks it complete, so that a
    second run goes on behind the last complete stage as long as the plan up to there, the tables that it was given and
    the tables that it wrote are the same."""

    stages: list[Stage]
    folder: str
    done: list[str] = field(default_factory=list)
    _marks: dict[str, list] = field(default_factory=dict)

    def key(self, upto: int, given: State) -> str:
        """The digest of the stages' names and contracts up to one, and of the given tables that they need."""
        told = [(s.name, s.requires, s.produces, s.filled) for s in self.stages[: upto + 1]]
        made = {t for s in self.stages[:upto] for t in s.produces}
        needed = sorted({t for s in self.stages[: upto + 1] for t in s.requires if t in given and t not in made})
        marks = {t: self._marks.setdefault(t, mark(given[t])) for t in needed}
        return hashlib.sha256(json.dumps([told, marks]).encode()).hexdigest()

    def _complete(self, spark: SparkSession, i: int, given: State) -> bool:
        where = f"{self.folder}/{i:02d}-{self.stages[i].name}"
        try:
            rows = spark.read.schema("plan string, tables string").parquet(f"{where}/manifest").collect()
            same = [(r.plan, json.loads(r.tables)) for r in rows] == [(self.key(i, given), {t: mark(spark.read.parquet(f"{where}/{t}")) for t in self.stages[i].produces})]
        except Exception as e:  # noqa: BLE001  any reader's way to say that the path isn't there
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
        return same

    def execute(self, spark: SparkSession, state: State, resume: bool = True) -> State:
        """Run the stages that aren't complete yet; `done` tells which ones ran."""
        given, state, fresh, self.done, self._marks = dict(state), dict(state), not resume, [], {}
        for i, stage in enumerate(self.stages):
            if missing := [t for t in stage.requires if t not in state]:
                raise ContractError(f"{stage.name} needs {missing}")
            where = f"{self.folder}/{i:02d}-{stage.name}"
            if fresh or not self._complete(spark, i, given):
                fresh = True
                made = stage.run(state)
                if missing := [t for t in stage.produces if t not in made]:
                    raise ContractError(f"{stage.name} didn't make {missing}")
                for t in stage.produces:
                    made[t].write.mode("overwrite").parquet(f"{where}/{t}")
                for t in stage.filled:
                    if not spark.read.parquet(f"{where}/{t}").limit(1).count():
                        raise ContractError(f"{stage.name} made no row of {t}")
                tables = {t: mark(spark.read.parquet(f"{where}/{t}")) for t in stage.produces}
                spark.createDataFrame([(self.key(i, given), json.dumps(tables))], "plan string, tables string").write.mode("overwrite").parquet(f"{where}/manifest")
                self.done.append(stage.name)
            state |= {t: spark.read.parquet(f"{where}/{t}") for t in stage.produces}
        return state


def mark(df: DataFrame) -> list:
    """Columns, number of rows and an order-free sum of row hashes of a table."""
    n, total = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return [df.columns, n, str(total)]


class Runner(Protocol):
    """What answers tasks: a model, a command, a table. Returns None where it has no valid answer."""

    def __call__(self, task: str) -> str | None: ...


def run_tasks(tasks: DataFrame, runner: Runner, validator: Callable[[str], bool] = bool, attempts: int = 3) -> DataFrame:
    """tasks(key, task) -> key, answer, ok, attempts: each task tried until an answer is valid, inside its partition."""
    kind = tasks.schema["key"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for key, task in zip(part["key"], part["task"], strict=True):
                answer, tried = None, 0
                while tried < attempts:
                    tried += 1
                    try:
                        answer = runner(task)
                    except Exception:  # noqa: BLE001  a runner's failure is a failed attempt
                        answer = None
                    if answer is not None and validator(answer):
                        break
                    answer = None
                rows.append((key, answer, answer is not None, tried))
            yield pd.DataFrame(rows, columns=["key", "answer", "ok", "attempts"])

    return tasks.select("key", "task").mapInPandas(run, f"key {kind}, answer string, ok boolean, attempts int")


def from_table(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """The table-backed runner: tasks(key, task), answers(task, answer) -> key, answer, ok, attempts, by a join."""
    found = answers.groupBy("task").agg(F.max("answer").alias("answer"))
    return tasks.join(found, "task", "left").select("key", "answer", F.col("answer").isNotNull().alias("ok"), F.lit(1).alias("attempts"))


def recovered(tasks: DataFrame, run: Callable[[DataFrame], DataFrame], rounds: int = 2, most: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Run tasks(key, task); run those that failed again, up to `rounds` times. The answers, and the tasks still without
    one; more than the share `most` of those is an error."""
    answers = written(run(tasks), "answers")
    for _ in range(rounds):
        left = tasks.join(answers.where("ok").select("key"), "key", "left_anti")
        if not left.limit(1).count():
            break
        again = run(left).where("ok")
        answers = written(answers.join(again.select("key"), "key", "left_anti").unionByName(again), "answers")
    left = tasks.join(answers.where("ok").select("key"), "key", "left_anti")
    n, failed = tasks.count(), left.count()
    if n and failed / n > most:
        raise RuntimeError(f"{failed} of {n} tasks failed")
    return answers, left


def validated_answers(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """tasks(key, ids array), answers(key, ids array, scores array<int>) -> key, ok: the answer's ids are a permutation of
    the task's and every score lies within 0 and 3."""
    a = answers.select("key", F.col("ids").alias("_ids"), "scores")
    joined = tasks.join(a, "key", "left")
    ok = (F.sort_array("ids") == F.sort_array("_ids")) & (F.size("scores") == F.size("ids")) & F.forall("scores", lambda s: (s >= 0) & (s <= 3))
    return joined.select("key", F.coalesce(ok, F.lit(False)).alias("ok"))


def changed_tables(before: State, after: State) -> list[str]:
    """Names of tables whose rows differ, by count and an order-free sum of row hashes."""
    return sorted(n for n in after if n not in before or mark(before[n]) != mark(after[n]))
