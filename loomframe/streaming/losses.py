"""Loss logs as a stream: best checkpoint and early stop of each run, kept as state.

A log has rows of two shapes, training (loss) and evaluation (eval_loss). Rows may come late, up to a delay, and a step may come
again; its row of the latest time counts. The steps of a run are kept in blocks of 2 ** BLOCK, each with a state of its own, so that a run of
any length is spread over the cluster and no task holds more than a block of rows at a time. A step is settled when the delay has passed for its
latest row; what comes for it later is not counted. Steps may come in any order, so a state holds, besides the rows of the other steps, the
evaluations of settled ones, and a bit for each. The results of a run's blocks are put together by `results`, in the order of the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Steps of a block, as a power of two; blocks that are put together at once, likewise.
BLOCK, JOINED = 16, 16

_SUMS = "n_train long, n_eval long, best_step long, best_loss double"
RESULT = f"run string, {_SUMS}, stop_step long"
#: A result over the steps of a block, and what joins it to the blocks before: evaluations since the best, and the first ones (`patience` of them).
PART = f"{RESULT}, block long, since long, first_steps array<long>, first_losses array<double>"
#: Of settled steps: training rows, evaluations, and a bit each (compressed); then the rows that may still be joined or replaced by others.
STATE = "n_train long, eval_steps array<long>, eval_losses array<double>, settled binary, times array<long>, steps array<long>, losses array<double>, evals array<double>"
NOTHING = (0, 0, None, None, 0, None, (), ())


def fold(seen: tuple, rows: list[tuple], patience: int) -> tuple:
    """seen after rows (time, step, loss, eval_loss), in the order of their steps; of a step's rows the one of the latest time."""
    n_train, n_eval, best_step, best_loss, since, stop, *first = seen
    steps, losses = map(list, first)
    last = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        last[row[1]] = row
    for _, step, loss, value in last.values():
        n_train += loss is not None
        if value is None:
            continue
        n_eval += 1
        if len(steps) < max(patience, 1):
            steps.append(step)
            losses.append(value)
        if best_loss is None or value < best_loss:
            best_step, best_loss, since = step, value, 0
        else:
            since += 1
            if since >= patience and stop is None:
                stop = step
    return n_train, n_eval, best_step, best_loss, since, stop, tuple(steps), tuple(losses)


def _number(x: object) -> float | None:
    return None if x is None or x != x else float(x)


def _place(row: tuple) -> tuple:
    """The order of a step's rows: by time; of one time an evaluation is the last, and the largest, in whatever order they come."""
    return (row[0], *((x is not None, x or 0.0) for x in (row[3], row[2])))


def keep_latest(held: dict[int, tuple], rows: Iterable[tuple]) -> None:
    """Add rows (time, step, loss, eval_loss) to held, one for each step: that of the latest time."""
    for row in rows:
        old = held.get(row[1])
        if old is None or row[0] > old[0] or row[0] == old[0] and _place(row) > _place(old):
            held[row[1]] = row


def follow(log: DataFrame, delay: str, patience: int = 2) -> DataFrame:
    """log(run, at timestamp, step, loss, eval_loss), a stream, to the results so far (PART) of blocks of runs, again whenever rows of a block come.

    A run of steps from 0 to under 2 ** BLOCK is one block, whose results are the run's; `results` puts several together. Rows that are older than
    the latest time less delay are not counted if their step is settled; rows without run, time or step never are.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_settled, steps, values, bits, *had = state.get if state.exists else (0, [], [], None, [], [], [], [])
        first, steps, values, held = int(key[1]) << BLOCK, list(steps), list(values), {}
        settled = np.zeros(1 << BLOCK, bool) if bits is None else np.unpackbits(np.frombuffer(zlib.decompress(bytes(bits)), np.uint8)).astype(bool)
        keep_latest(held, ((t, s, _number(a), _number(b)) for t, s, a, b in zip(*had, strict=True)))
        for x in frames:
            x = x[~settled[x["step"].to_numpy() - first]]
            keep_latest(held, ((t, s, _number(a), _number(b)) for t, s, a, b in zip(*(x[c].tolist() for c in ("time", "step", "loss", "eval_loss")), strict=True)))
        mark = state.getCurrentWatermarkMs() * 1000
        for row in [r for r in held.values() if r[0] < mark]:
            _, s, loss, value = held.pop(row[1])
            settled[s - first] = True
            n_settled += loss is not None
            if value is not None:
                steps.append(s)
                values.append(value)
        rows = list(held.values())
        state.update((n_settled, steps, values, zlib.compress(np.packbits(settled).tobytes(), 1), *([r[k] for r in rows] for k in range(4))))
        seen = fold(NOTHING, [(0, s, None, v) for s, v in zip(steps, values, strict=True)] + rows, patience)
        n_train, n_eval, best_step, best_loss, since, stop, *begin = seen
        out = pd.DataFrame([(key[0], n_train + n_settled, n_eval, best_step, best_loss, stop, key[1], since, *map(list, begin))], columns=[c.split()[0] for c in PART.split(", ")])
        yield out.astype({"best_step": "Int64", "stop_step": "Int64", "best_loss": "float64"})

    rows = log.where("run IS NOT NULL AND at IS NOT NULL AND step IS NOT NULL").select("run", F.shiftright("step", BLOCK).alias("block"), "at", F.unix_micros("at").alias("time"), "step", "loss", "eval_loss")
    return rows.withWatermark("at", delay).groupBy("run", "block").applyInPandasWithState(step, PART, STATE, "update", GroupStateTimeout.NoTimeout)


def _joined(a: Column, b: Column, patience: int) -> Column:
    """The results of the steps of a and then b, both structs of PART's columns."""
    left = F.lit(patience) - a["since"]  # evaluations without a better one that are left until the stop
    better = lambda x: a["best_loss"].isNull() | (x < a["best_loss"])
    # from its first loss below a's best on, if it comes in time, b goes as it goes alone
    in_time = F.exists(F.slice(b["first_losses"], F.lit(1), F.greatest(left, F.lit(0)).cast("int")), better)
    stop = F.coalesce(a["stop_step"], F.when(in_time, b["stop_step"]).otherwise(F.get(b["first_steps"], (left - 1).cast("int"))))
    lower = b["best_loss"].isNotNull() & better(b["best_loss"])
    out = {k: a[k] + b[k] for k in ("n_train", "n_eval")} | {k: F.when(lower, b[k]).otherwise(a[k]) for k in ("best_step", "best_loss")}
    out |= {"since": F.when(lower, b["since"]).otherwise(a["since"] + b["n_eval"]), "stop_step": stop}
    out |= {k: F.slice(F.concat(a[k], b[k]), 1, patience) for k in ("first_steps", "first_losses")}
    return F.struct(*[x.alias(k) for k, x in out.items()])


def results(parts: DataFrame, patience: int = 2) -> DataFrame:
    """parts(PART, batch) as follow() gave them, to the runs' results (RESULT): the latest of each block, joined in the order of the blocks.

    Up to 2 ** JOINED blocks, or joined blocks, meet at a time. patience is that of follow().
    """
    names = ["n_train", "n_eval", "best_step", "best_loss", "since", "stop_step", "first_steps", "first_losses"]
    x = parts.groupBy("run", "block").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    join = lambda a, b: _joined(a, b["r"], max(patience, 1))
    for _ in range(-(-(64 - BLOCK) // JOINED)):
        own = F.sort_array(F.collect_list(F.struct("block", "r")))
        x = x.groupBy("run", F.shiftright("block", JOINED).alias("_above")).agg(own.alias("p"))
        x = x.select("run", F.col("_above").alias("block"), F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.col("p")[0]["r"], join).alias("r"))
    # two blocks are left, of steps below 0 and from 0 on
    x = x.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("block", "r"))).alias("p"))
    x = x.select("run", F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.col("p")[0]["r"], join).alias("r"))
    return x.select("run", *[f"r.{c.split()[0]}" for c in RESULT.split(", ")[1:]])
