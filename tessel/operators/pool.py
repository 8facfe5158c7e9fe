"""A model behind several lanes, of which some may fail: batches try other lanes, bad lanes are set aside, bad inputs fail alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.tables import saved, shared_dir

#: What every row says of its batch: only its first row holds the tries, so that sums over rows count each try once.
TRIES = "array<struct<lane: string, inputs: long, ok: boolean, seconds: double>>"


class _Lanes:
    """The lanes as one task sees them."""

    def __init__(self, names: Sequence[str], call: Callable, patience: int, first: int) -> None:
        self.names, self.call, self.patience, self.turn = list(names), call, patience, first
        self.missed = dict.fromkeys(names, 0)

    def order(self) -> list[str]:
        """Lanes that are up, from the one whose turn it is; those that are down come last, so a batch is never without one."""
        self.turn += 1
        k = self.turn % len(self.names)
        return sorted(self.names[k:] + self.names[:k], key=lambda n: self.missed[n] >= self.patience)

    def ask(self, inputs: list, tries: list) -> list:
        """(answer, lane) of each input. A lane that fails where another one answers has missed; where all fail the inputs
        are halved, until what cannot be answered stands alone."""
        failed = []
        for lane in self.order():
            began, answers = time.monotonic(), None
            try:
                answers = list(self.call(lane, inputs))
            except Exception:  # whatever a model does is a failure of this try, which is counted
                pass
            ok = answers is not None and len(answers) == len(inputs)
            tries.append({"lane": lane, "inputs": len(inputs), "ok": ok, "seconds": time.monotonic() - began})
            if ok:
                self.missed[lane] = 0
                for name in failed:
                    self.missed[name] += 1
                return [(a, lane) for a in answers]
            failed.append(lane)
        if len(inputs) == 1:
            return [(None, None)]
        half = len(inputs) // 2
        return self.ask(inputs[:half], tries) + self.ask(inputs[half:], tries)


def asked(inputs: DataFrame, column: str, call: Callable[[str, list], Sequence], lanes: Sequence[str], answer: str = "array<float>", batch: int = 64, patience: int = 3) -> DataFrame:
    """inputs with answer, lane and ok from call(lane, list of inputs) -> answers, and tries, what was tried for the batch.

    A batch of `batch` rows goes to one lane, and to the next one if that fails; a lane that misses `patience` batches in a row
    which others answer is down for the rest of the task and only asked when all others fail. An input that no lane answers
    has a null answer and ok = false. Nulls are inputs like others; an empty table gives an empty one; columns of inputs stay,
    but for those named answer, lane, ok or tries.

    The result is written before it is returned: each input is asked once by those tasks whose output counts, and the sums of
    `throughput` come from these rows, so tasks that are run again are not counted twice."""
    if not lanes:
        raise ValueError("no lane")
    names = tuple(lanes)
    rows = inputs.drop("answer", "lane", "ok", "tries")
    made = T.StructType.fromDDL(f"answer {answer}, lane string, ok boolean, tries {TRIES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = _Lanes(names, call, patience, TaskContext.get().partitionId())
        for df in batches:
            for k in range(0, len(df), batch):
                part, tries = df.iloc[k : k + batch], []
                found = pool.ask([None if x is None else x for x in part[column].tolist()], tries)
                yield part.assign(answer=[a for a, _ in found], lane=[n for _, n in found], ok=[n is not None for _, n in found], tries=[tries, *[[]] * (len(part) - 1)])

    return saved(rows.mapInPandas(run, T.StructType(rows.schema.fields + made.fields)), shared_dir(inputs.sparkSession), "asked")


def throughput(answered: DataFrame) -> DataFrame:
    """(lane, inputs, tries, failures, seconds, rate) of each lane that was tried: inputs that it answered, and by second."""
    each = answered.select(F.explode("tries").alias("t")).select("t.*")
    sums = each.groupBy("lane").agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("inputs"))), F.lit(0)).alias("inputs"), F.count("*").alias("tries"), F.count_if(~F.col("ok")).alias("failures"), F.sum("seconds").alias("seconds"))
    return sums.withColumn("rate", F.when(F.col("seconds") > 0, F.col("inputs") / F.col("seconds")))
