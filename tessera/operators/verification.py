"""Verification of relation candidates as a state machine over their events.

An event moves a candidate from one state to the next or is refused, and a refused
event changes nothing. Since there are six states, what a run of events does is a
map of six entries, and such maps compose: each block of a candidate's events is
made a map on its own, the few maps of a candidate are composed for the state in
which each block begins, and the blocks are replayed from there. So a candidate
with a third of all events is spread over many tasks. A stream applies the same
moves with the state kept a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The states, errors that filter a candidate, the error that ends at once, and the number of attempts.
STATES = ("queued", "running", "confirmed", "filtered", "failed", "closed")
FILTER_ERRORS = (
    "relation_verification_direction_mismatch", "relation_verification_evidence_not_in_source",
    "relation_verification_incomplete_positive", "relation_verification_relation_not_allowed",
)
KEY_ERROR, MOST_ATTEMPTS = "relation_verification_requires_api_key", 3
#: Events of a block; ``seq`` is a running number, so a block of them is cut by division.
BLOCK = 1024

#: What each kind of event does: state before to state after; it is refused elsewhere.
MOVES = {
    "start": {"queued": "running", "running": "running"},
    "confirm": {"running": "confirmed"},
    "filter": {"running": "filtered"},
    "error_filter": {"running": "filtered"},
    "error_fail": {"running": "failed"},
    "error_again": {"running": "queued"},
    "retry": {s: "queued" for s in STATES[:-1]},
    "reconcile": {"queued": "queued", "running": "queued"},
    "close": {s: "closed" for s in STATES[:-1]},
}
_AT = {s: i for i, s in enumerate(STATES)}
#: By kind: the state after each state, and -1 where the event is refused.
_TABLE = {kind: [_AT[moves[s]] if s in moves else -1 for s in STATES] for kind, moves in MOVES.items()}
_REFUSED = [-1] * len(STATES)


def event_kind(event: Column, message: Column, attempt: Column) -> Column:
    """The kind of an event (start, confirm, filter, error, retry, reconcile, close); errors go by their message and attempt.

    A missing attempt is the first one. Anything else is unknown and refused.
    """
    last = message.isin(KEY_ERROR) | (F.coalesce(attempt, F.lit(1)) >= MOST_ATTEMPTS)
    failed = F.when(message.isin(*FILTER_ERRORS), "error_filter").when(last, "error_fail").otherwise("error_again")
    return F.when(event == "error", failed).when(event.isin(*MOVES), event).otherwise("unknown")


def _ordered(events: DataFrame) -> DataFrame:
    """Events with their kind and block; a block lies in one task, in order. Equal numbers go by event and message."""
    kind = event_kind(F.col("event"), F.col("message"), F.col("attempt"))
    held = events.select("candidate_id", F.col("seq").cast("long").alias("seq"), "event", "message", "attempt", kind.alias("kind"))
    return held.withColumn("block", F.floor(F.col("seq") / BLOCK))


_ORDER = ("candidate_id", "block", "seq", "event", "message", "attempt")


def transitions(events: DataFrame) -> DataFrame:
    """Every event (candidate_id, seq, event, message, attempt) with the states before and after it and whether it was refused.

    Candidates start queued. A refused event leaves the state; null ids are one candidate.
    """
    ordered = _ordered(events)
    kind_of_id = ordered.schema["candidate_id"].dataType.simpleString()
    id_type = to_arrow_type(ordered.schema["candidate_id"].dataType)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, moved, out = None, [], []
        for batch in batches:
            for candidate, block, kind in zip(*(batch.column(c).to_pylist() for c in ("candidate_id", "block", "kind")), strict=True):
                if (candidate, block) != key:
                    if key is not None:
                        out.append((*key, moved))
                    key, moved = (candidate, block), list(range(len(STATES)))
                step = _TABLE.get(kind, _REFUSED)
                moved = [step[s] if step[s] >= 0 else s for s in moved]
        if key is not None:
            out.append((*key, moved))
        kinds = (id_type, pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["candidate_id", "block", "moved"])

    dealt = ordered.repartition("candidate_id", "block").sortWithinPartitions(*_ORDER)
    maps = dealt.select("candidate_id", "block", "kind").mapInArrow(compose, f"candidate_id {kind_of_id}, block long, moved array<int>")
    # One row a block: a candidate's rows here are its events over BLOCK.
    listed = maps.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("block", "moved"))).alias("maps"))
    begin = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<block:bigint,state:int>>").alias("starts"))
    walked = F.aggregate(
        "maps", begin,
        lambda acc, m: F.struct(F.get(m["moved"], acc["state"]).alias("state"), F.array_append(acc["starts"], F.struct(m["block"].alias("block"), acc["state"].alias("state"))).alias("starts")),
    )
    starts = listed.select(F.col("candidate_id").alias("_id"), F.explode(walked["starts"]).alias("_s")).select("_id", F.col("_s.block").alias("_block"), F.col("_s.state").alias("start"))
    joined = ordered.join(starts, F.col("candidate_id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block"))).drop("_id", "_block")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, 0
        for batch in batches:
            before, after, refused = [], [], []
            for candidate, block, kind, start in zip(*(batch.column(c).to_pylist() for c in ("candidate_id", "block", "kind", "start")), strict=True):
                if (candidate, block) != key:
                    key, state = (candidate, block), start
                step = _TABLE.get(kind, _REFUSED)[state]
                before.append(STATES[state])
                refused.append(step < 0)
                state = step if step >= 0 else state
                after.append(STATES[state])
            held = [batch.column(c) for c in ("candidate_id", "seq", "event", "message")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(refused, pa.bool_())], names=["candidate_id", "seq", "event", "message", "before", "after", "refused"])

    again = joined.repartition("candidate_id", "block").sortWithinPartitions(*_ORDER)
    kinds = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in ("candidate_id", "seq", "event", "message"))
    return again.mapInArrow(replay, f"{kinds}, before string, after string, refused boolean")


def final_states(moved: DataFrame) -> DataFrame:
    """One row a candidate of ``transitions``: state, the error that its last accepted event left, attempts that ended, refused events."""
    order = F.struct("seq", "event", "message")
    accepted = ~F.col("refused")
    ended = accepted & F.col("event").isin("confirm", "filter", "error")
    error = F.struct(F.when(F.col("event") == "error", F.col("message")).alias("error"))
    return moved.groupBy("candidate_id").agg(
        F.max_by("after", order).alias("state"), F.max_by(F.when(accepted, error), F.when(accepted, order))["error"].alias("error"),
        F.count_if(ended).alias("n_attempts"), F.count_if(F.col("refused")).alias("n_refused"),
    )


def run_counts(states: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts of each discovery run's open candidates (candidate_id, run_id) by state, and whether the run is over."""
    held = candidates.filter("run_id is not null").join(states.select("candidate_id", "state"), "candidate_id", "left")
    state = F.coalesce("state", F.lit("queued"))
    counts = held.groupBy("run_id").agg(*(F.count_if(state == s).alias(s) for s in STATES[:-1]))
    return counts.withColumn("status", F.when(F.col("queued") + F.col("running") == 0, "completed").otherwise("running"))


def stream_transitions(events: DataFrame) -> DataFrame:
    """``transitions`` of a stream whose candidates' events arrive in order; an event that comes late is refused."""
    kind = event_kind(F.col("event"), F.col("message"), F.col("attempt"))
    held = events.select(F.col("candidate_id").cast("long").alias("candidate_id"), F.col("seq").cast("long").alias("seq"), "event", "message", kind.alias("kind"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        at, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["seq", "event", "message"], na_position="first")
        out = []
        for r in rows.itertuples():
            late = last is not None and r.seq < last
            move = -1 if late else _TABLE.get(r.kind, _REFUSED)[at]
            out.append((key[0], r.seq, r.event, r.message, STATES[at], STATES[move if move >= 0 else at], move < 0))
            at, last = move if move >= 0 else at, r.seq if last is None else max(last, r.seq)
        state.update((at, last))
        yield pd.DataFrame(out, columns=["candidate_id", "seq", "event", "message", "before", "after", "refused"])

    schema = "candidate_id long, seq long, event string, message string, before string, after string, refused boolean"
    return held.groupBy("candidate_id").applyInPandasWithState(step, schema, "state int, last long", "append", "NoTimeout")
