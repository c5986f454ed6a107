"""Live scoring of running cases with Structured Streaming (STR-1).

``transformWithState`` keeps a small state for each case, the one that
``prefixes.running_case_state`` computes in batch: how often each activity came,
the first activities in order, the last events, and the last or first
value of each attribute.  It lives across micro-batches and is as long as the
alphabet, never as the case.  Every batch emits the cases it touched; a sink
folder for each epoch makes a batch that is run again replace what it wrote.

Events may come in any order, inside a batch and across batches: each part of
the state is ordered by (timestamp, event index), not by arrival.  Without a
watermark nothing is dropped and no case is closed; with one, Spark drops events behind it,
and a case without events for ``idle_timeout_ms`` of event time is emitted as
closed and forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from caseflow.functions.scalar import calendar_features, log1p_nonneg, seconds_between

_OUTPUT = ("case_id string, prefix_len int, prefix_activities array<string>, names array<string>, times array<bigint>, "
           "last_activity string, start_us bigint, last_us bigint, prev_us bigint, attributes array<string>, "
           "attribute_values array<string>, closed boolean")
_EVENTS = "{0}_ts array<bigint>, {0}_idx array<bigint>, {0}_text array<string>"
_STATE = ", ".join(["n bigint, start_us bigint", _EVENTS.format("end"), "names array<string>, times array<bigint>",
                    _EVENTS.format("first"), "attributes array<string>", _EVENTS.format("attribute")])
#: The state store that keeps several states and timers for each key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunningCase(StatefulProcessor):
    """State of one case; ``attributes`` maps a column to whether its first (else last) non-null value counts."""

    def __init__(self, positions: int, attributes: dict[str, bool], idle_timeout_ms: int | None):
        self.positions, self.attributes, self.idle_timeout_ms = positions, attributes, idle_timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value: reading and writing it are two calls for a case and batch, however many parts it has
        self.case = handle.getValueState("case", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda e: (e.ts_us, e.event_index is None, e.event_index or 0))
        events = [(e.ts_us, e.event_index, e.activity) for e in batch]
        n, start, ends, counts, first, values = self.known()
        n, start = n + len(events), min(start, events[0][0]) if n else events[0][0]
        for _, _, activity in events:
            counts[activity] = counts.get(activity, 0) + 1
        first = sorted([*first, *events[:self.positions]], key=_place)[:self.positions]
        # of the event before the last only its time and index count
        ends = sorted([*ends[-1:], *[(*e[:2], None) for e in ends[:-1]], *events[-2:]], key=_place)[-2:]
        for k, (name, is_first) in enumerate(self.attributes.items()):
            there = [(e.ts_us, e.event_index, e[f"a{k}"]) for e in batch if e[f"a{k}"] is not None]
            if there:
                new, old = there[0 if is_first else -1], values.get(name)
                if old is None or (_place(new) < _place(old) if is_first else _place(new) > _place(old)):
                    values[name] = new
        state = (n, start, ends, counts, first, values)
        self.case.update((n, start, *_columns(ends), list(counts), list(counts.values()), *_columns(first),
                          list(values), *_columns(values.values())))
        if self.idle_timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(ends[-1][0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_timeout_ms)
        yield self.row(key[0], state, False)

    def known(self) -> tuple:
        """The state: events, start, the last two events, counts, the first events and the attributes' events."""
        held = self.case.get()
        if held is None:
            return 0, None, [], {}, [], {}
        n, start, *lists = held
        ends, (names, times), first, (of, *at) = lists[:3], lists[3:5], lists[5:8], lists[8:]
        return n, start, [*zip(*ends)], dict(zip(names, times)), [*zip(*first)], dict(zip(of, zip(*at)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self.row(key[0], self.known(), True)
        self.case.clear()

    def row(self, case_id: str, state: tuple, closed: bool) -> Row:
        n, start, ends, counts, first, values = state
        counts, values = sorted(counts.items()), sorted((name, v[2]) for name, v in values.items())
        return Row(case_id=case_id, prefix_len=n, prefix_activities=[a for _, _, a in first],
                   names=[a for a, _ in counts], times=[k for _, k in counts], last_activity=ends[-1][2], start_us=start,
                   last_us=ends[-1][0], prev_us=ends[-2][0] if len(ends) > 1 else None,
                   attributes=[a for a, _ in values], attribute_values=[v for _, v in values], closed=closed)


def _place(event: tuple) -> tuple:
    """Events are ordered by time, then index, a missing one last."""
    return event[0], event[1] is None, event[1] or 0


def _columns(events) -> list[list]:
    """Times, indexes and texts of (time, index, text) rows."""
    return [list(x) for x in zip(*events)] or [[], [], []]


def running_case_stream(events: DataFrame, positions: int = 30, first_values: list[str] = (), last_values: list[str] = (),
                        watermark: str | None = None, idle_timeout_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Streaming frame of running cases from a canonical event stream; the columns of ``running_case_state``.

    ``first_values`` / ``last_values`` name attribute columns of which the first or
    last non-null value is kept, as text, in the map ``attributes``.  The session's
    state store must be ``STATE_STORE``.
    """
    attributes = {c: True for c in first_values} | {c: False for c in last_values}
    # the worker sees names that are identifiers only
    events = events.select("case_id", F.coalesce("activity", F.lit("UNKNOWN")).alias("activity"), "timestamp",
                           F.unix_micros("timestamp").alias("ts_us"), F.col("_event_index").cast("bigint").alias("event_index"),
                           *[F.col(f"`{c}`").cast("string").alias(f"a{k}") for k, c in enumerate(attributes)]) \
        .where(F.col("timestamp").isNotNull())
    if watermark:
        events = events.withWatermark("timestamp", watermark)
    rows = events.groupBy("case_id").transformWithState(
        RunningCase(positions, attributes, idle_timeout_ms if watermark else None), _OUTPUT, "Update",
        "eventTime" if watermark else "none")
    at = lambda c: F.timestamp_micros(c)
    return rows.select("case_id", "prefix_len", "prefix_activities", F.map_from_arrays("names", "times").alias("activity_counts"),
                       "last_activity", at("start_us").alias("prefix_start_time"), at("last_us").alias("prefix_end_time"),
                       at("prev_us").alias("prev_time"), F.map_from_arrays("attributes", "attribute_values").alias("attributes"),
                       "closed")


def prefix_features(cases: DataFrame) -> DataFrame:
    """Time and calendar features of streamed cases (same columns as the batch builder)."""
    el = F.greatest(F.coalesce(seconds_between("prefix_start_time", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    si = F.greatest(F.coalesce(seconds_between("prev_time", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    return cases.select("*", el.alias("feat_elapsed_time_sec"), si.alias("feat_time_since_last_event_sec"),
                        log1p_nonneg(el).alias("feat_elapsed_time_log1p"), log1p_nonneg(si).alias("feat_time_since_last_log1p"),
                        *calendar_features("prefix_end_time"))


def write_epoch(path: str, score: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the features of a batch's cases, scored, in the epoch's own folder.

    A batch that is run again writes the same folder anew, so no row is doubled.
    """
    def write(df: DataFrame, epoch: int) -> None:
        out = prefix_features(df)
        (score(out) if score else out).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def score_stream(cases: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None,
                 available_now: bool = True):
    """Start the query that writes every batch of a :func:`running_case_stream` under ``path``.

    ``available_now``: read all input there is, in as many batches as the source
    makes of it, and end; else go on until stopped.
    """
    writer = (cases.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(write_epoch(path, score)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each case that a :func:`score_stream` query has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "case_id"]), "epoch").alias("_r")) \
        .select("case_id", "_r.*")
