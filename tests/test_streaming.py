import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from caseflow.operators.prefixes import running_case_prefixes, running_case_state
from caseflow.streaming.running_cases import STATE_STORE, latest_state, running_case_stream, score_stream, write_epoch

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "case_id string, activity string, timestamp timestamp, _event_index long, `case:kind` string, cost double"


def events(n=120):
    rng = random.Random(4)
    return [(f"c{rng.randrange(5)}", rng.choice(["A", "B", "C", "D", None]), T0 + dt.timedelta(minutes=rng.randrange(60)), i,
             rng.choice([None, "x", "y"]), rng.choice([None, float(i)])) for i in range(n)]


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])


def run(spark, batches, **options):
    """Write the batches as files, stream them one by one, return (sink folder, checkpoint, number of batches)."""
    src, out, ckpt = (tempfile.mkdtemp(prefix="caseflow-stream-") for _ in range(3))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/b{k}")
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src))
    q = score_stream(running_case_stream(stream, 7, ["case:kind"], ["cost"], **options), f"{out}/rows", ckpt)
    q.awaitTermination(300)
    assert q.exception() is None
    return f"{out}/rows", len(q.recentProgress)


def test_state_lives_across_batches_and_ignores_arrival_order(spark, state_store):
    rows = events()
    shuffled = random.Random(1).sample(rows, len(rows))
    path, n_batches = run(spark, [shuffled[k::4] for k in range(4)])
    got = latest_state(spark, path)
    assert n_batches >= 4 and got.select("epoch").distinct().count() >= 1
    assert spark.read.parquet(path).select("epoch").distinct().count() == 4
    log = spark.createDataFrame(rows, SCHEMA)
    same = ["case_id", "prefix_len", "prefix_activities", F.map_entries("activity_counts").alias("c"), "last_activity",
            "prefix_end_time", "feat_elapsed_time_sec", "feat_time_since_last_event_sec", "feat_prefix_end_hour"]
    want = running_case_state(log, 7)
    key = lambda r: r[0]
    assert sorted(got.select(*same).collect(), key=key) == sorted(want.select(*same).collect(), key=key)
    attributes = {r.case_id: r.attributes for r in got.collect()}
    for r in want.collect():
        assert attributes[r.case_id] == {"case:kind": r.case__kind, "cost": str(r.event_last__cost)}


def test_an_epoch_that_is_run_again_doubles_nothing(spark, state_store):
    path, _ = run(spark, [events(40)])
    before = spark.read.parquet(path).count()
    batch = spark.read.parquet(f"{path}/epoch=0").select("case_id", "prefix_len", "prefix_activities", "activity_counts", "last_activity",
                                                        "prefix_start_time", "prefix_end_time", "prev_time", "attributes", "closed")
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    write_epoch(path)(batch, 0)
    assert spark.read.parquet(path).count() == before
    write_epoch(path)(batch, 1)
    assert spark.read.parquet(path).count() == 2 * before and latest_state(spark, path).count() == before


def test_idle_cases_are_closed_behind_the_watermark(spark, state_store):
    day = dt.timedelta(days=1)
    batches = [[("old", "A", T0, 1, None, None), ("new", "A", T0, 2, None, None)],
               [("new", "B", T0 + 30 * day, 3, None, None)], [("new", "C", T0 + 31 * day, 4, None, None)]]
    path, _ = run(spark, batches, watermark="1 day", idle_timeout_ms=7 * 86_400_000)
    closed = [(r.case_id, r.prefix_len) for r in spark.read.parquet(path).where("closed").collect()]
    assert ("old", 1) in closed
    again = spark.read.parquet(path).where("case_id = 'new' and not closed").orderBy(F.desc("prefix_end_time")).first()
    assert again.last_activity == "C"


def test_batch_state_equals_the_list_of_the_case(spark):
    log = spark.createDataFrame(events(), SCHEMA)
    lists = {r.case_id: r for r in running_case_prefixes(log).collect()}
    for r in running_case_state(log, 7).collect():
        whole = lists[r.case_id]
        assert r.prefix_activities == whole.prefix_activities[:7] and r.last_activity == whole.prefix_activities[-1]
        assert r.activity_counts == {a: whole.prefix_activities.count(a) for a in set(whole.prefix_activities)}
        shared = [c for c in whole.asDict() if c != "prefix_activities"]
        assert [r[c] for c in shared] == [whole[c] for c in shared]


def test_a_hot_case_is_cut_off_inside_the_tasks(spark):
    log = spark.range(200_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as case_id", "concat('a', id % 5) as activity",
                                          "timestamp_seconds(id) as timestamp", "id as _event_index")
    state = running_case_state(log, 10)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("collect_list") > 0
    hot = state.where("case_id = 'hot'").first()
    assert hot.prefix_len == sum(hot.activity_counts.values()) == 66_667 and len(hot.prefix_activities) == 10


def test_a_case_reads_and_writes_its_state_once_for_each_batch():
    from pyspark.sql import Row

    from caseflow.streaming.running_cases import RunningCase

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, new):
            self.calls, self.held = self.calls + 1, new

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

    case = RunningCase(2, {"kind": True, "cost": False}, None)
    case.init(Handle())
    event = lambda t, i, a, kind, cost: Row(ts_us=t, event_index=i, activity=a, a0=kind, a1=cost)
    for batch in [[event(5, 2, "B", "x", None), event(5, None, "C", "z", "3.0")], [event(1, 0, "A", None, "9.0"), event(4, 1, "B", "y", "1.0")]]:
        out, = case.handleInputRows(("c",), iter(batch), None)
    assert Handle.value.calls == 4
    assert (out.prefix_len, out.prefix_activities, out.names, out.times) == (4, ["A", "B"], ["A", "B", "C"], [1, 2, 1])
    assert (out.last_activity, out.start_us, out.last_us, out.prev_us) == ("C", 1, 5, 5)
    assert dict(zip(out.attributes, out.attribute_values)) == {"kind": "y", "cost": "3.0"}
