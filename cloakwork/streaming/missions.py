"""The agent's loop as state by mission: at most so many steps, and an end at the first outcome that ends it.

``folded`` is the loop over a table, by windows; ``looped`` the same over a stream, whose state for a mission is its
number of steps and its end. Outcomes come in the order of their positions; a stream's rows of one
mission must too, and a position that is not beyond the last one taken is a repeated row and counts once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The outcomes of a step. Of these all but the last two end a mission; a blocked, unsafe or unconfirmed step is not executed.
BLOCKED, UNSAFE, CONFIRM, FINISH, FAILED, DONE, FILLED = "blocked", "unsafe", "confirm", "finish", "failed", "done", "filled"
ENDS, UNEXECUTED = (BLOCKED, UNSAFE, CONFIRM, FINISH, FAILED), (BLOCKED, UNSAFE, CONFIRM, FILLED)
MOST = 5
RESULT = "mission string, steps int, logged int, status string"


def folded(outcomes: DataFrame, most: int = MOST) -> DataFrame:
    """(mission, steps, logged, status) of outcomes (mission, pos, outcome): how many steps were begun, how many stand in the log, and
    how the mission ended: by the outcome that ended it, 'capped', or 'running'."""
    once = outcomes.where("mission is not null and pos is not null").groupBy("mission", "pos").agg(F.min("outcome").alias("outcome"))
    rows = once.withColumn("step", F.row_number().over(Window.partitionBy("mission").orderBy("pos"))).where(F.col("step") <= most)
    ended = F.min(F.when(F.col("outcome").isin(*ENDS), F.col("step"))).over(Window.partitionBy("mission"))
    rows = rows.withColumn("end", ended).where("end is null or step <= end")
    last = F.max_by("outcome", "step")
    status = F.when(last.isin(*ENDS), last).when(F.max("step") >= most, "capped").otherwise("running")
    return rows.groupBy("mission").agg(F.max("step").cast("int").alias("steps"), F.count_if(~F.col("outcome").isin(*UNEXECUTED)).cast("int").alias("logged"), status.alias("status"))


def looped(outcomes: DataFrame, most: int = MOST) -> DataFrame:
    """The same over a stream, in update mode: a row for each mission whenever it changes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, logged, last, status = state.get if state.exists else (0, 0, None, "running")
        rows = pd.concat(list(batches)).sort_values(["pos", "outcome"])
        before = steps
        for pos, outcome in zip(rows["pos"], rows["outcome"], strict=True):
            if status != "running":
                break
            if last is not None and pos <= last:
                continue
            steps, last = steps + 1, int(pos)
            logged += outcome not in UNEXECUTED
            status = outcome if outcome in ENDS else "capped" if steps >= most else "running"
        state.update((steps, logged, last, status))
        if steps > before:
            yield pd.DataFrame([(key[0], steps, logged, status)], columns=["mission", "steps", "logged", "status"])

    rows = outcomes.where("mission is not null and pos is not null").groupBy("mission")
    return rows.applyInPandasWithState(run, RESULT, "steps int, logged int, last long, status string", "update", GroupStateTimeout.NoTimeout)


# Tasks get this small module with the function, so no package has to be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
