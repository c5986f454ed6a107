"""DuckDB twins of the catalogue queries (same column names, same rounding)."""

from __future__ import annotations

from caseflow.sources.testlogs import CUSTOMER_LOG_SQL, LINE_LOG_SQL, USER_DAY_LOG_SQL, USER_LOG_SQL

RHU = "floor(({x}) * {m} + 0.5) / {m}"


def rhu(x: str, digits: int) -> str:
    return RHU.format(x=x, m=f"{10 ** digits}.0")


SEC = "((epoch_us({b}) - epoch_us({a})) / 1e6)"


def sec(a: str, b: str) -> str:
    return SEC.format(a=a, b=b)


CLEAN_LINE_LOG = f"""
line_log AS ({LINE_LOG_SQL}),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, activity, "timestamp" ORDER BY _event_index) AS rn
    FROM line_log) WHERE rn = 1),
clean AS (
  SELECT * FROM dedup WHERE case_id IN (SELECT case_id FROM dedup GROUP BY case_id HAVING count(*) >= 2))
"""

PREFIX_ROWS = """
pos AS (
  SELECT *,
    row_number() OVER w AS k,
    count(*) OVER (PARTITION BY case_id) AS n,
    lead(activity) OVER w AS label_next_activity,
    lag("timestamp") OVER w AS prev_ts,
    min("timestamp") OVER (PARTITION BY case_id) AS start_ts,
    max("timestamp") OVER (PARTITION BY case_id) AS end_ts,
    array_to_string(list(activity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '>') AS prefix_path
  FROM {src}
  WINDOW w AS (PARTITION BY case_id ORDER BY "timestamp", _event_index)),
pfx AS (SELECT * FROM pos WHERE k <= least({max_len}, n - 1))
"""

ORACLE = {
    "prefix_summary": f"""
WITH {CLEAN_LINE_LOG}, {PREFIX_ROWS.format(src='clean', max_len=30)}
SELECT CAST(k AS INTEGER) AS prefix_len, activity AS last_activity, label_next_activity,
       count(*) AS n_prefixes, {rhu('avg(' + sec('"timestamp"', 'end_ts') + ')', 2)} AS avg_remaining_sec
FROM pfx GROUP BY ALL
""",
    "prefixes": f"""
WITH {CLEAN_LINE_LOG}, {PREFIX_ROWS.format(src='clean', max_len=30)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, prefix_path, "timestamp" AS prefix_end_time,
       label_next_activity,
       {rhu(sec('"timestamp"', 'end_ts'), 3)} AS label_remaining_time_sec,
       {rhu('ln(1 + greatest(0, ' + sec('"timestamp"', 'end_ts') + '))', 6)} AS label_remaining_time_log1p
FROM pfx
""",
    "case_labels": f"""
WITH log AS ({CUSTOMER_LOG_SQL}),
last_outcome AS (
  SELECT case_id, arg_max(o_orderpriority, ("timestamp", _event_index)) FILTER (WHERE o_orderpriority IS NOT NULL) AS o
  FROM log GROUP BY case_id)
SELECT l.case_id, min("timestamp") AS case_start_time, max("timestamp") AS case_end_time,
       CASE WHEN any_value(o) IN ('1-URGENT', '2-HIGH') THEN any_value(o) ELSE 'Other' END AS label_outcome
FROM log l JOIN last_outcome USING (case_id) GROUP BY l.case_id
""",
    "dedup_events": f"""
WITH {CLEAN_LINE_LOG}
SELECT case_id, activity, "timestamp", _event_index, l_suppkey, l_quantity FROM dedup
""",
    "filter_short_cases": f"""
WITH log AS ({USER_DAY_LOG_SQL})
SELECT case_id, activity, "timestamp", _event_index FROM log
WHERE case_id IN (SELECT case_id FROM log GROUP BY case_id HAVING count(*) >= 2)
""",
}

__all__ = ["ORACLE", "rhu", "sec", "USER_LOG_SQL", "LINE_LOG_SQL", "CUSTOMER_LOG_SQL", "USER_DAY_LOG_SQL"]


NOISY_USER_LOG = f"""
ul AS ({USER_LOG_SQL}),
noisy AS (
  SELECT case_id,
    CASE WHEN _event_index % 13 = 0 THEN NULL WHEN _event_index % 11 = 0 THEN 'nan'
         WHEN _event_index % 7 = 0 THEN '' WHEN _event_index % 5 = 0 THEN ' ' || activity || ' '
         ELSE activity END AS activity,
    CASE WHEN _event_index % 17 = 0 THEN NULL ELSE "timestamp" END AS "timestamp",
    _event_index, value, prop_k
  FROM ul)
"""

SHUFFLED_TIME_LOG = f"""
ul AS ({USER_LOG_SQL}),
sh AS (SELECT case_id, activity, _event_index,
         CASE WHEN _event_index % 4 = 0 THEN "timestamp" - INTERVAL 2 HOUR ELSE "timestamp" END AS "timestamp"
       FROM ul)
"""

HOLEY_CUSTOMER_LOG = f"""
cl AS ({CUSTOMER_LOG_SQL}),
holey AS (SELECT case_id, activity, "timestamp", _event_index,
    CASE WHEN _event_index % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN _event_index % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice
  FROM cl)
"""

FINE_ACTIVITY_LOG = f"""
udl AS ({USER_DAY_LOG_SQL}),
fine AS (SELECT case_id, activity || ':' || CAST(prop_k % 20 AS VARCHAR) AS activity, "timestamp", _event_index FROM udl)
"""

LIFECYCLE_LOG = f"""
ul AS ({USER_LOG_SQL}),
lc AS (SELECT *, CASE WHEN activity IN ('view', 'click') THEN ' Start'
                      WHEN _event_index % 9 = 0 THEN NULL ELSE 'complete ' END AS "lifecycle:transition"
       FROM ul)
"""

VARIANTS = """
variants AS (
  SELECT case_id, string_agg(activity, '>' ORDER BY "timestamp", _event_index) AS variant, count(*) AS n_events
  FROM {src} GROUP BY case_id)
"""

ORACLE.update({
    "canonical_schema": """
SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS CaseID, CAST(user_id AS VARCHAR) AS case_id,
       event_type AS activity, event_type || '_x' AS task, ts AS "timestamp", event_id
FROM events
""",
    "clean_events": f"""
WITH {NOISY_USER_LOG}
SELECT case_id, coalesce(activity, 'UNKNOWN') AS activity, "timestamp", _event_index FROM noisy
WHERE "timestamp" IS NOT NULL
""",
    "normalize_activities": f"""
WITH {NOISY_USER_LOG}
SELECT case_id, CASE WHEN trim(activity) IS NULL OR trim(activity) IN ('', 'nan', 'None') THEN 'UNKNOWN'
                     ELSE trim(activity) END AS activity, _event_index FROM noisy
""",
    "repair_ts_ffill": f"""
WITH {SHUFFLED_TIME_LOG}
SELECT case_id, _event_index,
       max("timestamp") OVER (PARTITION BY case_id ORDER BY _event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "timestamp"
FROM sh
""",
    "repair_ts_drop": f"""
WITH {SHUFFLED_TIME_LOG},
lagged AS (SELECT *, lag("timestamp") OVER (PARTITION BY case_id ORDER BY _event_index) AS prev FROM sh)
SELECT case_id, _event_index, "timestamp" FROM lagged WHERE prev IS NULL OR "timestamp" >= prev
""",
    "impute_attrs": f"""
WITH {HOLEY_CUSTOMER_LOG},
med AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM holey),
md AS (SELECT o_orderpriority AS m FROM holey WHERE o_orderpriority IS NOT NULL
       GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority ASC LIMIT 1)
SELECT case_id, _event_index, coalesce(o_orderpriority, (SELECT m FROM md)) AS o_orderpriority,
       {rhu('coalesce(o_totalprice, (SELECT m FROM med))', 4)} AS o_totalprice
FROM holey
""",
    "drop_columns": f"""
WITH cl AS ({CUSTOMER_LOG_SQL})
SELECT case_id, activity, "timestamp", _event_index, o_orderpriority FROM cl
""",
    "dedup_stats": f"""
WITH ll AS ({LINE_LOG_SQL}),
g AS (SELECT count(*) AS n FROM ll GROUP BY case_id, activity, "timestamp")
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_dropped,
       CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_dup_groups, CAST(max(n) AS BIGINT) AS max_group_size,
       {rhu('sum(n - 1) / sum(n)', 6)} AS dup_rate
FROM g
""",
    "dedup_keep_last": f"""
WITH cl AS ({CUSTOMER_LOG_SQL})
SELECT case_id, activity, "timestamp", _event_index FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, activity, "timestamp" ORDER BY _event_index DESC) AS rn FROM cl)
WHERE rn = 1
""",
    "dedup_keep_none": f"""
WITH cl AS ({CUSTOMER_LOG_SQL})
SELECT case_id, activity, "timestamp", _event_index FROM (
  SELECT *, count(*) OVER (PARTITION BY case_id, activity, "timestamp") AS c FROM cl)
WHERE c = 1
""",
    "filter_case_length": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}),
sizes AS (SELECT case_id, count(*) AS n FROM cl GROUP BY case_id),
thr AS (SELECT CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) AS t FROM sizes)
SELECT case_id, n AS n_events FROM sizes WHERE n <= (SELECT t FROM thr)
""",
    "filter_zero_duration": f"""
WITH ll AS ({LINE_LOG_SQL})
SELECT case_id, count(*) AS n_events FROM ll GROUP BY case_id HAVING max("timestamp") > min("timestamp")
""",
    "filter_infrequent_activities": f"""
WITH {FINE_ACTIVITY_LOG},
thr AS (SELECT greatest(1, CAST(floor(count(DISTINCT case_id) * 0.005) AS BIGINT)) AS t FROM fine),
rare AS (SELECT activity FROM fine GROUP BY activity HAVING count(DISTINCT case_id) < (SELECT t FROM thr))
SELECT activity, count(*) AS n_events FROM fine WHERE activity NOT IN (SELECT activity FROM rare) GROUP BY activity
""",
    "filter_consecutive_dups": f"""
WITH ul AS ({USER_LOG_SQL}),
l AS (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY "timestamp", _event_index) AS prev FROM ul)
SELECT case_id, activity, _event_index FROM l WHERE prev IS NULL OR prev <> activity
""",
    "filter_rare_variants": f"""
WITH udl AS ({USER_DAY_LOG_SQL}), {VARIANTS.format(src='udl')},
vc AS (SELECT variant, count(*) AS c FROM variants GROUP BY variant)
SELECT case_id, activity, _event_index FROM udl
WHERE case_id NOT IN (SELECT case_id FROM variants JOIN vc USING (variant) WHERE c < 5)
""",
    "since_date": f"""
WITH udl AS ({USER_DAY_LOG_SQL})
SELECT case_id, _event_index FROM udl
WHERE case_id IN (SELECT case_id FROM udl GROUP BY case_id HAVING min("timestamp") >= TIMESTAMP '2024-01-15')
""",
    "recent_pct": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}),
starts AS (SELECT case_id, min("timestamp") AS s, count(*) AS n FROM cl GROUP BY case_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY s, case_id) AS r FROM starts)
SELECT case_id, n AS n_events FROM ranked
WHERE r > (SELECT CAST(floor(count(*) * (CAST(1.0 AS DOUBLE) - CAST(80.0 AS DOUBLE) / 100.0)) AS BIGINT) FROM starts)
""",
    "lifecycle_keep": f"""
WITH {LIFECYCLE_LOG}
SELECT case_id, _event_index FROM lc WHERE lower(trim("lifecycle:transition")) IN ('complete')
""",
    "lifecycle_drop": f"""
WITH {LIFECYCLE_LOG}
SELECT case_id, _event_index FROM lc WHERE "lifecycle:transition" IS NULL OR "lifecycle:transition" NOT IN (' Start')
""",
    "lifecycle_collapse_occurrence": f"""
WITH {LIFECYCLE_LOG},
fl AS (SELECT *, CASE WHEN lag(activity) OVER w IS NULL OR activity <> lag(activity) OVER w
                        OR coalesce(lower(trim("lifecycle:transition")) = 'start', false) THEN 1 ELSE 0 END AS f
       FROM lc WINDOW w AS (PARTITION BY case_id ORDER BY "timestamp", _event_index)),
oc AS (SELECT *, CAST(sum(f) OVER (PARTITION BY case_id ORDER BY "timestamp", _event_index
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS _occurrence FROM fl),
pick AS (SELECT *, row_number() OVER (PARTITION BY case_id, activity, _occurrence ORDER BY
           CAST(coalesce(lower(trim("lifecycle:transition")) = 'complete', false) AS INTEGER) DESC,
           "timestamp" DESC, _event_index DESC) AS rn FROM oc)
SELECT case_id, activity, _occurrence, _event_index, "timestamp" FROM pick WHERE rn = 1
""",
    "lifecycle_collapse_id": f"""
WITH {LIFECYCLE_LOG},
ev AS (SELECT *, CAST(prop_k AS VARCHAR) AS EventID FROM lc),
pick AS (SELECT *, row_number() OVER (PARTITION BY case_id, EventID ORDER BY
           CAST(coalesce(lower(trim("lifecycle:transition")) = 'complete', false) AS INTEGER) DESC,
           "timestamp" DESC, _event_index DESC) AS rn FROM ev WHERE EventID IS NOT NULL)
SELECT case_id, EventID, activity, _event_index, "timestamp" FROM pick WHERE rn = 1
""",
})


def prefix_cte(src: str, out: str, max_len: int = 30, extra: str = "", complete: bool = False) -> str:
    """Prefix rows of log ``src`` as CTEs ``{out}_pos`` (all events) and ``{out}`` (prefix rows)."""
    upper = "n" if complete else "n - 1"
    return f"""
{out}_pos AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY case_id) AS n,
    lead(activity) OVER w AS label_next_activity,
    lag("timestamp") OVER w AS prev_ts,
    min("timestamp") OVER (PARTITION BY case_id) AS start_ts,
    max("timestamp") OVER (PARTITION BY case_id) AS end_ts,
    list(activity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acts,
    array_to_string(list(activity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '>') AS prefix_path
    {extra}
  FROM {src} WINDOW w AS (PARTITION BY case_id ORDER BY "timestamp", _event_index)),
{out} AS (SELECT * FROM {out}_pos WHERE k <= least({max_len}, {upper}))
"""


def split_cte(src: str, out: str = "splits", temporal: bool = False) -> str:
    key = "min(\"timestamp\")" if temporal else "any_value(('0x' || substr(md5('42:' || case_id), 1, 8))::BIGINT)"
    return f"""
{out}_r AS (SELECT case_id, row_number() OVER (ORDER BY {key}, case_id) AS r, count(*) OVER () AS n
            FROM {src} GROUP BY case_id),
{out} AS (SELECT case_id, CASE WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                              WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
                              ELSE 'test' END AS split FROM {out}_r)
"""


CCL = """
ccl AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS case_id, o_orderstatus AS activity, o_orderdate AS "timestamp",
         CAST(o_orderkey AS BIGINT) AS _event_index,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         c_mktsegment AS "case:segment", c_acctbal AS "case:acctbal"
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
"""

CCL_EXTRA = """,
    lead(o_orderpriority) OVER w AS next_prio,
    last_value(o_orderpriority IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lnn_prio,
    last_value(o_totalprice IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lnn_price,
    first_value("case:segment" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS seg,
    first_value("case:acctbal" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS acctbal"""

ELAPSED = f"greatest(0, coalesce({sec('start_ts', '\"timestamp\"')}, 0))"
SINCE = f"greatest(0, coalesce({sec('prev_ts', '\"timestamp\"')}, 0))"
REMAIN = sec('"timestamp"', 'end_ts')

# model frame: customer-case prefixes with snapshot columns and a random split
MODEL_FRAME = f"""
{CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}, {split_cte('ccl')},
mf AS (
  SELECT p.case_id, CAST(k AS INTEGER) AS prefix_len, acts, activity AS last_act, label_next_activity, split,
    {REMAIN} AS label_remaining_time_sec,
    {ELAPSED} AS feat_elapsed_time_sec, {SINCE} AS feat_time_since_last_event_sec,
    ln(1 + {ELAPSED}) AS feat_elapsed_time_log1p, ln(1 + {SINCE}) AS feat_time_since_last_log1p,
    hour("timestamp") AS feat_prefix_end_hour, isodow("timestamp") - 1 AS feat_prefix_end_weekday,
    CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS feat_prefix_end_is_weekend, month("timestamp") AS feat_prefix_end_month,
    seg AS case__segment, acctbal AS case__acctbal, lnn_prio AS event_last__o_orderpriority,
    lnn_price AS event_last__o_totalprice
  FROM cpfx p JOIN splits s USING (case_id))
"""

FINE_FRAME = f"""
{FINE_ACTIVITY_LOG}, {prefix_cte('fine', 'fpfx')}, {split_cte('fine', 'fsplits')},
ff AS (SELECT p.case_id, CAST(k AS INTEGER) AS prefix_len, acts, activity AS last_act, split
       FROM fpfx p JOIN fsplits USING (case_id))
"""


def _unpivot_cats(src: str) -> str:
    return f"""
SELECT case_id, prefix_len, split, 'case__segment' AS "column", case__segment AS value FROM {src}
UNION ALL
SELECT case_id, prefix_len, split, 'event_last__o_orderpriority', event_last__o_orderpriority FROM {src}
"""


def _vocab(min_freq: int, top: int) -> str:
    return f"""
cats AS ({_unpivot_cats('mf')}),
vocab AS (SELECT * FROM (
  SELECT "column", value, count(*) AS n,
         CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value ASC) AS INTEGER) AS slot
  FROM cats WHERE split = 'train' AND value IS NOT NULL GROUP BY "column", value HAVING count(*) >= {min_freq})
  WHERE slot <= {top})
"""


NUM_FEATURES = ["case__acctbal", "event_last__o_totalprice", "feat_elapsed_time_sec", "feat_time_since_last_event_sec",
                "feat_elapsed_time_log1p", "feat_time_since_last_log1p", "feat_prefix_end_hour",
                "feat_prefix_end_weekday", "feat_prefix_end_is_weekend", "feat_prefix_end_month"]

LAST_STATE_LONG = f"""
WITH {MODEL_FRAME}, {_vocab(50, 20)},
feats AS (
  SELECT case_id, prefix_len, 'prefix_len' AS feature, CAST(prefix_len AS DOUBLE) AS value FROM mf
  {''.join(f"UNION ALL SELECT case_id, prefix_len, 'num__{c}', coalesce(TRY_CAST({c} AS DOUBLE), 0) FROM mf " for c in NUM_FEATURES)}
  UNION ALL
  SELECT c.case_id, c.prefix_len,
         'cat__' || c."column" || '__' || CASE WHEN v.slot IS NULL THEN '__UNK__' ELSE c.value END, 1.0
  FROM cats c LEFT JOIN vocab v ON c."column" = v."column" AND c.value = v.value)
SELECT case_id, prefix_len, feature, {rhu('value', 4)} AS value FROM feats
"""

ORACLE.update({
    "end_override": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}),
e AS (SELECT *, CASE WHEN _event_index % 4 = 0 THEN NULL
                     WHEN _event_index % 4 = 1 THEN "timestamp" + INTERVAL 400 DAY
                     ELSE "timestamp" - INTERVAL 1 DAY END AS end_attr FROM cl),
g AS (SELECT case_id, max("timestamp") AS obs_end,
             arg_min(end_attr, ("timestamp", _event_index)) FILTER (WHERE end_attr IS NOT NULL) AS first_end
      FROM e GROUP BY case_id)
SELECT case_id, CASE WHEN first_end IS NOT NULL AND first_end >= obs_end THEN first_end ELSE obs_end END AS case_end_time,
       'unknown' AS label_outcome
FROM g
""",
    "next_attribute_labels": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, label_next_activity,
       coalesce(next_prio, 'unknown') AS label_next_o_orderpriority, 'unknown' AS label_next_absent_col
FROM cpfx
""",
    "prefix_time_features": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, {rhu(ELAPSED, 3)} AS feat_elapsed_time_sec,
       {rhu(SINCE, 3)} AS feat_time_since_last_event_sec, {rhu('ln(1 + ' + ELAPSED + ')', 6)} AS feat_elapsed_time_log1p,
       {rhu('ln(1 + ' + SINCE + ')', 6)} AS feat_time_since_last_log1p, {rhu(REMAIN, 3)} AS label_remaining_time_sec
FROM cpfx
""",
    "prefix_calendar": f"""
WITH ul AS ({USER_LOG_SQL}), {prefix_cte('ul', 'upfx')}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, hour("timestamp") AS feat_prefix_end_hour,
       isodow("timestamp") - 1 AS feat_prefix_end_weekday, CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS feat_prefix_end_is_weekend,
       month("timestamp") AS feat_prefix_end_month
FROM upfx
""",
    "prefix_case_attrs": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, seg AS case__segment, {rhu('acctbal', 4)} AS case__acctbal FROM cpfx
""",
    "prefix_event_attrs": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, lnn_prio AS event_last__o_orderpriority,
       {rhu('lnn_price', 4)} AS event_last__o_totalprice FROM cpfx
""",
    "prefix_event_attrs_last": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, o_orderpriority AS event_last__o_orderpriority,
       {rhu('o_totalprice', 4)} AS event_last__o_totalprice FROM cpfx
""",
    "running_case_prefix": f"""
WITH udl AS ({USER_DAY_LOG_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "timestamp" DESC, _event_index DESC) AS rd,
             count(*) OVER (PARTITION BY case_id) AS n, min("timestamp") OVER (PARTITION BY case_id) AS start_ts FROM udl),
s AS (SELECT case_id, any_value(n) AS n, any_value(start_ts) AS start_ts,
             max(CASE WHEN rd = 1 THEN "timestamp" END) AS last_ts, max(CASE WHEN rd = 2 THEN "timestamp" END) AS prev_ts,
             string_agg(activity, '>' ORDER BY "timestamp", _event_index) AS prefix_path
      FROM r GROUP BY case_id)
SELECT case_id, CAST(n AS INTEGER) AS prefix_len, prefix_path,
       {rhu('greatest(0, coalesce(' + sec('start_ts', 'last_ts') + ', 0))', 3)} AS feat_elapsed_time_sec,
       {rhu('greatest(0, coalesce(' + sec('prev_ts', 'last_ts') + ', 0))', 3)} AS feat_time_since_last_event_sec
FROM s
""",
    "split_random": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {split_cte('cl')}
SELECT case_id, split FROM splits
""",
    "split_temporal": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {split_cte('cl', temporal=True)}
SELECT case_id, split FROM splits
""",
    "bucket_none": f"""
WITH {MODEL_FRAME}
SELECT case_id, prefix_len, split, 0 AS bucket_id FROM mf
""",
    "bucket_bins": f"""
WITH {MODEL_FRAME}, mx AS (SELECT max(prefix_len) AS m FROM mf WHERE split = 'train')
SELECT case_id, prefix_len, split, CAST((least(greatest(prefix_len, 1), (SELECT m FROM mx)) - 1) // 5 + 1 AS INTEGER) AS bucket_id
FROM mf
""",
    "bucket_adaptive": f"""
WITH {MODEL_FRAME},
st AS (SELECT greatest(1, CAST(floor(quantile_cont(prefix_len, 0.5)) AS INTEGER)) AS med, max(prefix_len) AS mx0
       FROM mf WHERE split = 'train'),
st2 AS (SELECT med, greatest(med, mx0) AS mx FROM st),
e1 AS (SELECT mx, list_sort(list_distinct([
         {', '.join(f"greatest(1, CAST(ceil(CAST({f} AS DOUBLE) * med) AS INTEGER))" for f in (0.2, 0.6, 1.0, 1.5, 2.0))},
         greatest(1, mx)])) AS s FROM st2),
e2 AS (SELECT CASE WHEN s[-1] <> mx THEN list_append(s, s[-1] + 1) ELSE s END AS edges FROM e1)
SELECT case_id, prefix_len, split,
       CAST(1 + len(list_filter(edges, lambda e: e < least(greatest(prefix_len, 1), edges[-1]))) AS INTEGER) AS bucket_id
FROM mf, e2
""",
    "bucket_last_activity": f"""
WITH {FINE_FRAME},
v AS (SELECT last_act, row_number() OVER (ORDER BY last_act) AS b FROM (SELECT DISTINCT last_act FROM ff WHERE split = 'train')),
nv AS (SELECT count(*) + 1 AS u FROM v)
SELECT case_id, prefix_len, split, CAST(coalesce(b, (SELECT u FROM nv)) AS INTEGER) AS bucket_id
FROM ff LEFT JOIN v USING (last_act)
""",
    "category_vocab": f"""
WITH {MODEL_FRAME}, {_vocab(50, 20)}
SELECT "column", value, n, slot FROM vocab
""",
    "category_vocab_small": f"""
WITH {MODEL_FRAME}, {_vocab(1, 3)}
SELECT "column", value, n, slot FROM vocab
""",
    "onehot_long": f"""
WITH {MODEL_FRAME}, {_vocab(1, 3)}
SELECT c.case_id, c.prefix_len, c."column", c.value, coalesce(v.slot, 0) AS slot
FROM cats c LEFT JOIN vocab v ON c."column" = v."column" AND c.value = v.value
""",
    "last_state_long": LAST_STATE_LONG,
    "activity_counts": f"""
WITH {FINE_FRAME},
ev AS (SELECT case_id, k AS pos, activity FROM fpfx_pos),
v AS (SELECT activity, row_number() OVER (ORDER BY activity) AS slot FROM (
        SELECT DISTINCT e.activity FROM ff JOIN ev e ON ff.case_id = e.case_id AND e.pos <= ff.prefix_len
        WHERE ff.split = 'train'))
SELECT ff.case_id, ff.prefix_len, CAST(coalesce(v.slot, 0) AS INTEGER) AS slot, count(*) AS count
FROM ff JOIN ev e ON ff.case_id = e.case_id AND e.pos <= ff.prefix_len LEFT JOIN v ON e.activity = v.activity
GROUP BY ALL
""",
    "positional_activity": f"""
WITH {MODEL_FRAME},
ev AS (SELECT case_id, k AS pos, activity FROM cpfx_pos),
v AS (SELECT activity, row_number() OVER (ORDER BY activity) AS slot FROM (
        SELECT DISTINCT e.activity FROM mf JOIN ev e ON mf.case_id = e.case_id AND e.pos <= mf.prefix_len
        WHERE mf.split = 'train')),
grid AS (SELECT mf.case_id, mf.prefix_len, CAST(p.range AS INTEGER) AS position
         FROM mf, range(1, (SELECT max(prefix_len) + 1 FROM mf WHERE split = 'train')) p)
SELECT g.case_id, g.prefix_len, g.position, e.activity, CAST(coalesce(v.slot, 0) AS INTEGER) AS slot
FROM grid g LEFT JOIN ev e ON g.case_id = e.case_id AND e.pos = g.position AND g.position <= g.prefix_len
LEFT JOIN v ON e.activity = v.activity
""",
    "target_encoding": f"""
WITH {MODEL_FRAME},
t AS (SELECT event_last__o_orderpriority AS category, label_remaining_time_sec AS y FROM mf
      WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL),
g AS (SELECT avg(y) AS gm FROM t)
SELECT category, count(*) AS n, {rhu('(count(*) * avg(y) + 1.0 * (SELECT gm FROM g)) / (count(*) + 1.0)', 3)} AS encoding
FROM t GROUP BY category
""",
    "activity_target_encoding": f"""
WITH {MODEL_FRAME},
ev AS (SELECT case_id, k AS pos, activity FROM cpfx_pos),
t AS (SELECT e.activity AS category, mf.label_remaining_time_sec AS y FROM mf
      JOIN ev e ON mf.case_id = e.case_id AND e.pos <= mf.prefix_len
      WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL),
g AS (SELECT avg(y) AS gm FROM t)
SELECT category, count(*) AS n, {rhu('(count(*) * avg(y) + 1.0 * (SELECT gm FROM g)) / (count(*) + 1.0)', 3)} AS encoding
FROM t GROUP BY category
""",
    "embedding_mean_last": f"""
WITH {MODEL_FRAME},
ev AS (SELECT case_id, k AS pos, activity FROM cpfx_pos),
v AS (SELECT activity, row_number() OVER (ORDER BY activity) AS slot FROM (
        SELECT DISTINCT e.activity FROM mf JOIN ev e ON mf.case_id = e.case_id AND e.pos <= mf.prefix_len
        WHERE mf.split = 'train')),
vec AS (SELECT v.activity, CAST(d.i - 1 AS INTEGER) AS dim, CAST(em.embedding[d.i] AS DOUBLE) AS x
        FROM v JOIN embeddings em ON em.vec_id = v.slot - 1, range(1, 65) d(i)),
mv AS (SELECT dim, avg(x) AS mx FROM vec GROUP BY dim),
dims AS (SELECT DISTINCT dim FROM mv),
px AS (SELECT mf.case_id, mf.prefix_len, e.pos, d.dim, coalesce(vec.x, mv.mx) AS x
       FROM mf JOIN ev e ON mf.case_id = e.case_id AND e.pos <= mf.prefix_len
       CROSS JOIN dims d LEFT JOIN vec ON vec.activity = e.activity AND vec.dim = d.dim
       LEFT JOIN mv ON mv.dim = d.dim)
SELECT case_id, prefix_len, dim, {rhu('avg(x)', 5)} AS mean_value,
       {rhu('max(CASE WHEN pos = prefix_len THEN x END)', 5)} AS last_value
FROM px GROUP BY case_id, prefix_len, dim
""",
    "aggregated_to_events": """
WITH w AS (
  SELECT o_custkey AS id, min(o_orderdate) AS started, max(o_orderpriority) AS top_priority,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 100.0 END) AS wf_O,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100.0 END) AS wf_F,
         sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 100.0 END) AS wf_P,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS wfe_O,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS wfe_F,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS wfe_P
  FROM orders GROUP BY o_custkey),
st AS (
  SELECT id, started, top_priority, s.ord, s.state, s.dur,
         CASE WHEN s.cnt IS NULL OR s.cnt = 0 THEN 1 WHEN s.cnt < 0 THEN 0 ELSE greatest(1, CAST(floor(s.cnt) AS INTEGER)) END AS n
  FROM w, (VALUES (1, 'O'), (2, 'F'), (3, 'P')) AS t(ord, st0),
  LATERAL (SELECT t.ord AS ord, t.st0 AS state,
                  CASE t.st0 WHEN 'O' THEN wf_O WHEN 'F' THEN wf_F ELSE wf_P END AS dur,
                  CASE t.st0 WHEN 'O' THEN wfe_O WHEN 'F' THEN wfe_F ELSE wfe_P END AS cnt) s),
off AS (
  SELECT *, coalesce(sum(coalesce(dur, 0)) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         coalesce(sum(CASE WHEN dur IS NOT NULL AND dur <> 0 THEN n ELSE 0 END)
                  OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq0
  FROM st)
SELECT CAST(id AS VARCHAR) AS case_id, state AS activity,
       make_timestamp(epoch_us(started) + CAST(round((off + i * dur / n) * 1e6) AS BIGINT)) AS "timestamp",
       CAST(seq0 + i AS BIGINT) AS _event_index, top_priority AS "case:top_priority"
FROM off, range(0, 1000000) r(i)
WHERE dur IS NOT NULL AND dur <> 0 AND n > 0 AND i < n AND started IS NOT NULL
""",
    "load_qc": f"""
WITH ul AS ({USER_LOG_SQL})
SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT case_id) AS n_cases, 0 AS n_ts_parse_failures,
       min("timestamp") AS min_time, max("timestamp") AS max_time FROM ul
""",
    "parse_activities": """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN event_type || '>x' WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN event_type || '>y>z'
  WHEN 4 THEN '"' || event_type || '\\",z"' WHEN 5 THEN 'True>None>7>' || event_type || chr(10) || ',;'
  ELSE event_type || '>>w' END AS activities
FROM events
""",
})


def wb(v: str, lo: str, hi: str, n: str) -> str:
    """Spark's width_bucket for lo <= v <= hi, top edge folded into bin n; equal bounds -> 1."""
    return (f"CASE WHEN {hi} = {lo} THEN 1 ELSE least({n}, CASE WHEN {v} >= {hi} THEN {n} + 1 "
            f"ELSE CAST(trunc(CAST({n} AS DOUBLE) * ({v} - {lo}) / ({hi} - {lo})) AS BIGINT) + 1 END) END")


CASE_STATS = 'cs AS (SELECT case_id, count(*) AS n, min("timestamp") AS t0, max("timestamp") AS t1 FROM {src} GROUP BY case_id)'
DUR = f"({sec('t0', 't1')} / 86400.0)"

BK_ADAPTIVE = f"""
{MODEL_FRAME},
st AS (SELECT greatest(1, CAST(floor(quantile_cont(prefix_len, 0.5)) AS INTEGER)) AS med, max(prefix_len) AS mx0
       FROM mf WHERE split = 'train'),
st2 AS (SELECT med, greatest(med, mx0) AS mx FROM st),
e1 AS (SELECT mx, list_sort(list_distinct([
         {', '.join(f"greatest(1, CAST(ceil(CAST({f} AS DOUBLE) * med) AS INTEGER))" for f in (0.2, 0.6, 1.0, 1.5, 2.0))},
         greatest(1, mx)])) AS s FROM st2),
e2 AS (SELECT CASE WHEN s[-1] <> mx THEN list_append(s, s[-1] + 1) ELSE s END AS edges FROM e1),
bk AS (SELECT mf.*, CAST(1 + len(list_filter(edges, lambda e: e < least(greatest(prefix_len, 1), edges[-1]))) AS INTEGER) AS bucket_id
       FROM mf, e2)
"""

REG_PRED = f"""
{BK_ADAPTIVE},
te AS (SELECT last_act, count(*) AS n, avg(label_remaining_time_sec) AS m FROM bk
       WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL GROUP BY last_act),
tg AS (SELECT avg(label_remaining_time_sec) AS gm FROM bk WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL),
pred AS (SELECT bk.case_id, bk.prefix_len, bk.split, bk.bucket_id, label_remaining_time_sec AS y_true,
                coalesce((te.n * te.m + 1.0 * tg.gm) / (te.n + 1.0), tg.gm) AS y_pred
         FROM bk LEFT JOIN te USING (last_act) CROSS JOIN tg WHERE split <> 'train')
"""

CLS_PRED = f"""
{BK_ADAPTIVE},
cc AS (SELECT last_act, label_next_activity AS lab, count(*) AS c FROM bk WHERE split = 'train' GROUP BY ALL),
best AS (SELECT last_act, lab FROM (SELECT *, row_number() OVER (PARTITION BY last_act ORDER BY c DESC, lab ASC) AS r FROM cc) WHERE r = 1),
gbest AS (SELECT lab FROM cc GROUP BY lab ORDER BY sum(c) DESC, lab ASC LIMIT 1),
pred AS (SELECT bk.case_id, bk.prefix_len, bk.split, bk.bucket_id, label_next_activity AS y_true,
                coalesce(best.lab, (SELECT lab FROM gbest)) AS y_pred
         FROM bk LEFT JOIN best USING (last_act) WHERE split <> 'train')
"""

PER_CLASS = """
conf AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL),
lbl AS (SELECT y_true AS label FROM conf UNION SELECT y_pred FROM conf),
pc AS (SELECT label,
         coalesce((SELECT sum(n) FROM conf WHERE y_true = label AND y_pred = label), 0) AS tp,
         coalesce((SELECT sum(n) FROM conf WHERE y_true = label), 0) AS support,
         coalesce((SELECT sum(n) FROM conf WHERE y_pred = label), 0) AS predicted
       FROM lbl),
pcs AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1,
               CAST(support AS BIGINT) AS support, tp, predicted FROM pc)
"""

REG_ERR = f"""
avg(abs(y_pred - y_true)) AS a, quantile_cont(abs(y_pred - y_true), 0.5) AS m, count(*) AS n
"""


def reg_err_select(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}{rhu('avg(abs(y_pred - y_true))', 2)} AS mae_sec, {rhu('quantile_cont(abs(y_pred - y_true), 0.5)', 2)} AS medae_sec,
       count(*) AS n, {rhu('avg(abs(y_pred - y_true)) / 86400.0', 6)} AS mae_days,
       {rhu('quantile_cont(abs(y_pred - y_true), 0.5) / 86400.0', 6)} AS medae_days
FROM pred {'GROUP BY ' + group if group else ''}
"""


ORACLE.update({
    "trace_length_stats": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {CASE_STATS.format(src='cl')}
SELECT CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_cases, min(t0) AS min_time, max(t1) AS max_time,
       CAST(min(n) AS BIGINT) AS len_min, {rhu('quantile_cont(n, 0.5)', 4)} AS len_median, {rhu('avg(n)', 4)} AS len_mean,
       {rhu('quantile_cont(n, 0.95)', 4)} AS len_p95, CAST(max(n) AS BIGINT) AS len_max FROM cs
""",
    "case_duration_stats": f"""
WITH ll AS ({LINE_LOG_SQL}), {CASE_STATS.format(src='ll')}, d AS (SELECT {DUR} AS d FROM cs)
SELECT {rhu('min(d)', 4)} AS dur_min_days, {rhu('quantile_cont(d, 0.5)', 4)} AS dur_median_days,
       {rhu('avg(d)', 4)} AS dur_mean_days, {rhu('quantile_cont(d, 0.95)', 4)} AS dur_p95_days,
       {rhu('max(d)', 4)} AS dur_max_days, count(*) FILTER (WHERE d = 0) AS n_zero_duration FROM d
""",
    "activity_frequency": f"""
WITH {FINE_ACTIVITY_LOG}, c AS (SELECT activity, count(*) AS n FROM fine GROUP BY activity)
SELECT activity, n, row_number() OVER (ORDER BY n DESC, activity ASC) AS rank_desc,
       row_number() OVER (ORDER BY n ASC, activity ASC) AS rank_asc, count(*) OVER () AS n_distinct FROM c
""",
    "consecutive_dup_count": f"""
WITH ul AS ({USER_LOG_SQL})
SELECT count(*) FILTER (WHERE prev = activity) AS n_consecutive_duplicates FROM (
  SELECT activity, lag(activity) OVER (PARTITION BY case_id ORDER BY "timestamp", _event_index) AS prev FROM ul)
""",
    "missing_values": f"""
WITH {HOLEY_CUSTOMER_LOG}
SELECT * FROM (
  SELECT 'o_orderpriority' AS "column", CAST(count(*) FILTER (WHERE o_orderpriority IS NULL) AS BIGINT) AS n_missing,
         {rhu('count(*) FILTER (WHERE o_orderpriority IS NULL) * 100.0 / count(*)', 4)} AS pct_missing FROM holey
  UNION ALL
  SELECT 'o_totalprice', CAST(count(*) FILTER (WHERE o_totalprice IS NULL) AS BIGINT),
         {rhu('count(*) FILTER (WHERE o_totalprice IS NULL) * 100.0 / count(*)', 4)} FROM holey)
WHERE n_missing > 0
""",
    "variant_stats": f"""
WITH udl AS ({USER_DAY_LOG_SQL}), {VARIANTS.format(src='udl')},
vc AS (SELECT variant, count(*) AS c FROM variants GROUP BY variant)
SELECT count(*) AS n_variants, count(*) FILTER (WHERE c = 1) AS n_singletons, CAST(sum(c) AS BIGINT) AS n_cases FROM vc
""",
    "top_variants": f"""
WITH udl AS ({USER_DAY_LOG_SQL}), {VARIANTS.format(src='udl')},
vc AS (SELECT variant, count(*) AS n_cases, any_value(n_events) AS n_steps FROM variants GROUP BY variant),
t AS (SELECT *, string_split(variant, '>') AS parts, sum(n_cases) OVER () AS tot FROM vc)
SELECT variant, n_cases, n_steps, {rhu('n_cases * 100.0 / tot', 4)} AS pct,
       CASE WHEN len(parts) > 4 THEN parts[1] || ' → ' || parts[2] || ' → … → ' || parts[-1]
            ELSE array_to_string(parts, ' → ') END AS label
FROM t ORDER BY n_cases DESC, variant ASC LIMIT 10
""",
    "column_profile": f"""
WITH {HOLEY_CUSTOMER_LOG},
lastv AS (
  SELECT case_id,
    arg_max(activity, ("timestamp", _event_index)) FILTER (WHERE activity IS NOT NULL) AS activity,
    arg_max(o_orderpriority, ("timestamp", _event_index)) FILTER (WHERE o_orderpriority IS NOT NULL) AS o_orderpriority,
    arg_max(o_totalprice, ("timestamp", _event_index)) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice
  FROM holey GROUP BY case_id),
base AS (SELECT count(*) AS n,
    count(*) FILTER (WHERE activity IS NULL) AS nu_a, count(*) FILTER (WHERE o_orderpriority IS NULL) AS nu_p,
    count(*) FILTER (WHERE o_totalprice IS NULL) AS nu_t,
    count(*) FILTER (WHERE trim(activity) = '') AS bl_a, count(*) FILTER (WHERE trim(o_orderpriority) = '') AS bl_p,
    count(*) FILTER (WHERE trim(CAST(o_totalprice AS VARCHAR)) = '') AS bl_t FROM holey),
card AS (SELECT count(DISTINCT activity) AS cd_a, count(DISTINCT o_orderpriority) AS cd_p, count(DISTINCT o_totalprice) AS cd_t,
    list_sort(list(DISTINCT activity) FILTER (WHERE activity IS NOT NULL))[1:30] AS sv_a,
    list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL))[1:30] AS sv_p,
    list_sort(list(DISTINCT CAST(o_totalprice AS VARCHAR)) FILTER (WHERE o_totalprice IS NOT NULL))[1:30] AS sv_t FROM lastv),
r AS (
  SELECT 'activity' AS "column", nu_a AS n_null, bl_a AS n_blank, cd_a AS n_distinct_last, sv_a AS sv, n FROM base, card
  UNION ALL SELECT 'o_orderpriority', nu_p, bl_p, cd_p, sv_p, n FROM base, card
  UNION ALL SELECT 'o_totalprice', nu_t, bl_t, cd_t, sv_t, n FROM base, card)
SELECT "column", n_null, {rhu('n_null * 100.0 / n', 4)} AS pct_null, n_blank, {rhu('n_blank * 100.0 / n', 4)} AS pct_blank,
       n_distinct_last,
       CASE WHEN n_distinct_last BETWEEN 1 AND 500 THEN array_to_string(sv, '|') ELSE '' END AS sample_values
FROM r
""",
    "outcome_candidates": f"""
WITH {HOLEY_CUSTOMER_LOG},
lastv AS (
  SELECT case_id,
    arg_max(activity, ("timestamp", _event_index)) FILTER (WHERE activity IS NOT NULL) AS activity,
    arg_max(o_orderpriority, ("timestamp", _event_index)) FILTER (WHERE o_orderpriority IS NOT NULL) AS o_orderpriority,
    arg_max(o_totalprice, ("timestamp", _event_index)) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice
  FROM holey GROUP BY case_id),
r AS (SELECT 'activity' AS "column", count(DISTINCT activity) AS n_distinct_last FROM lastv
      UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM lastv
      UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM lastv)
SELECT * FROM r WHERE "column" = 'activity' OR n_distinct_last BETWEEN 2 AND 100
""",
    "event_attribute_candidates": f"""
WITH {HOLEY_CUSTOMER_LOG},
r AS (SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS n_distinct FROM holey
      UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM holey)
SELECT * FROM r WHERE n_distinct BETWEEN 1 AND 50
""",
    "activity_counts_pct": f"""
WITH {FINE_ACTIVITY_LOG}, c AS (SELECT activity, count(*) AS n FROM fine GROUP BY activity)
SELECT activity, n, {rhu('n * 100.0 / sum(n) OVER ()', 4)} AS pct FROM c ORDER BY n DESC, activity ASC LIMIT 30
""",
    "duration_stats": f"""
WITH ll AS ({LINE_LOG_SQL}), {CASE_STATS.format(src='ll')}, d AS (SELECT {DUR} AS d FROM cs)
SELECT {rhu('quantile_cont(d, 0.25)', 4)} AS p25_days, {rhu('quantile_cont(d, 0.75)', 4)} AS p75_days,
       {rhu('quantile_cont(d, 0.9)', 4)} AS p90_days FROM d
""",
    "duration_histogram": f"""
WITH ll AS ({LINE_LOG_SQL}), {CASE_STATS.format(src='ll')}, d AS (SELECT {DUR} AS d FROM cs),
c AS (SELECT d FROM d WHERE d <= (SELECT quantile_cont(d, 0.95) FROM d)),
rg AS (SELECT min(d) AS lo, max(d) AS hi FROM c)
SELECT CAST({wb('d', 'lo', 'hi', '8')} AS INTEGER) AS bin, count(*) AS n FROM c, rg GROUP BY 1
""",
    "case_length_histogram": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {CASE_STATS.format(src='cl')},
nb AS (SELECT greatest(1, least(8, CAST(floor(quantile_cont(n, 0.95)) AS INTEGER))) AS b, min(n) AS lo, max(n) AS hi FROM cs)
SELECT CAST({wb('CAST(n AS DOUBLE)', 'CAST(lo AS DOUBLE)', 'CAST(hi AS DOUBLE)', 'b')} AS INTEGER) AS bin, count(*) AS n
FROM cs, nb GROUP BY 1
""",
    "auto_max_prefix_len": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {CASE_STATS.format(src='cl')}
SELECT greatest(2, least(30, CAST(floor(quantile_cont(n, 0.95)) AS INTEGER))) AS auto_max_prefix_len FROM cs
""",
    "missing_cell_rate": f"""
WITH {HOLEY_CUSTOMER_LOG},
m AS (SELECT CAST(sum(CAST(o_orderpriority IS NULL AS BIGINT) + CAST(o_totalprice IS NULL AS BIGINT)) AS BIGINT) AS n_missing_cells,
             CAST(count(*) * 6 AS BIGINT) AS n_cells FROM holey)
SELECT n_missing_cells, n_cells, {rhu('n_missing_cells / n_cells', 6)} AS missing_rate FROM m
""",
    "events_per_month": f"""
WITH cl AS ({CUSTOMER_LOG_SQL})
SELECT strftime("timestamp", '%Y-%m') AS month, count(*) AS n_events FROM cl GROUP BY 1
""",
    "lifecycle_values": f"""
WITH {LIFECYCLE_LOG}
SELECT "lifecycle:transition" AS value, count(*) AS n FROM lc GROUP BY 1
""",
    "avg_case_duration": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}), {CASE_STATS.format(src='cl')}
SELECT {rhu('avg(' + DUR + ')', 4)} AS avg_case_duration_days FROM cs
""",
    "label_qc_numeric": f"""
WITH {MODEL_FRAME}
SELECT count(*) FILTER (WHERE label_remaining_time_sec IS NULL) AS n_na,
       {rhu('min(label_remaining_time_sec)', 3)} AS min, {rhu('max(label_remaining_time_sec)', 3)} AS max,
       {', '.join(rhu(f'quantile_cont(label_remaining_time_sec, {q})', 3) + f' AS q{str(q)[2:]}' for q in (0.5, 0.9, 0.95, 0.99, 0.999))},
       count(*) FILTER (WHERE label_remaining_time_sec < 0) AS n_negative
FROM mf
""",
    "label_qc_classes": f"""
WITH {MODEL_FRAME}, c AS (SELECT label_next_activity AS label, count(*) AS n FROM mf GROUP BY 1)
SELECT label, n, row_number() OVER (ORDER BY n DESC, label ASC) AS rank FROM c
""",
    "outcome_distribution": f"""
WITH cl AS ({CUSTOMER_LOG_SQL}),
o AS (SELECT case_id, coalesce(arg_max(o_orderpriority, ("timestamp", _event_index)) FILTER (WHERE o_orderpriority IS NOT NULL),
                              'unknown') AS label_outcome FROM cl GROUP BY case_id)
SELECT label_outcome, count(*) AS n_cases FROM o GROUP BY 1 ORDER BY n_cases DESC, label_outcome ASC LIMIT 20
""",
    "bucket_size_stats": f"""
WITH {BK_ADAPTIVE}, s AS (SELECT bucket_id, count(*) AS n FROM bk GROUP BY 1)
SELECT count(*) AS n_buckets, min(n) AS min_size, quantile_cont(n, 0.5) AS median_size, max(n) AS max_size FROM s
""",
    "iqr_outliers": f"""
WITH {MODEL_FRAME},
q AS (SELECT quantile_cont(label_remaining_time_sec, 0.25) AS q1, quantile_cont(label_remaining_time_sec, 0.75) AS q3
      FROM mf WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT case_id, prefix_len, split FROM mf, b
WHERE split <> 'train' OR label_remaining_time_sec IS NULL OR lo IS NULL
   OR (label_remaining_time_sec >= lo AND label_remaining_time_sec <= hi)
""",
    "rare_classes": f"""
WITH {CCL}, {prefix_cte('ccl', 'cpfx', extra=CCL_EXTRA)}, {split_cte('ccl')},
p AS (SELECT case_id, CAST(k AS INTEGER) AS prefix_len, split, coalesce(next_prio, 'unknown') AS label_next_o_orderpriority
      FROM cpfx JOIN splits USING (case_id)),
c AS (SELECT label_next_o_orderpriority AS lab, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1),
flag AS (SELECT coalesce(max(CASE WHEN n < 700 THEN 1 ELSE 0 END), 0) AS has_rare FROM c)
SELECT case_id, prefix_len, split, label_next_o_orderpriority FROM p, flag
WHERE has_rare = 0 OR label_next_o_orderpriority IN (SELECT lab FROM c WHERE n >= 700)
""",
    "small_buckets": f"""
WITH {MODEL_FRAME}, mx AS (SELECT max(prefix_len) AS m FROM mf WHERE split = 'train'),
b AS (SELECT case_id, prefix_len, CAST((least(greatest(prefix_len, 1), (SELECT m FROM mx)) - 1) // 2 + 1 AS INTEGER) AS bucket_id FROM mf)
SELECT * FROM b WHERE bucket_id IN (SELECT bucket_id FROM b GROUP BY 1 HAVING count(*) >= 400)
""",
    "bucket_eligibility": f"""
WITH {BK_ADAPTIVE}
SELECT bucket_id, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
       count(DISTINCT CASE WHEN split = 'train' THEN label_next_activity END) AS n_train_classes,
       count(*) FILTER (WHERE split = 'train') >= 300 AND count(*) FILTER (WHERE split = 'val') >= 300
         AND count(DISTINCT CASE WHEN split = 'train' THEN label_next_activity END) >= 2 AS eligible
FROM bk GROUP BY bucket_id
""",
    "f1_macro_micro": f"""
WITH {CLS_PRED}, {PER_CLASS}
SELECT {rhu('avg(f1)', 6)} AS f1_macro, {rhu('2.0 * sum(tp) / (sum(support) + sum(predicted))', 6)} AS f1_micro,
       {rhu('sum(tp) / sum(support)', 6)} AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM pcs
""",
    "confusion": f"""
WITH {CLS_PRED}
SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL
""",
    "per_class_f1": f"""
WITH {CLS_PRED}, {PER_CLASS}
SELECT label, {rhu('precision', 6)} AS precision, {rhu('recall', 6)} AS recall, {rhu('f1', 6)} AS f1, support FROM pcs
""",
    "binary_f1": f"""
WITH {CLS_PRED}, {PER_CLASS}
SELECT {rhu('f1', 6)} AS f1_binary FROM pcs WHERE label = 'F'
""",
    "mae_medae": f"WITH {REG_PRED} {reg_err_select()}",
    "per_bucket_metrics": f"WITH {REG_PRED} {reg_err_select('bucket_id, split')}",
    "per_bucket_classification": f"""
WITH {CLS_PRED},
c AS (SELECT bucket_id, y_true AS t, y_pred AS q, count(*) AS n FROM pred GROUP BY ALL),
lb AS (SELECT bucket_id, t AS label FROM c UNION SELECT bucket_id, q FROM c),
pc AS (SELECT lb.bucket_id, lb.label,
         coalesce((SELECT sum(n) FROM c WHERE c.bucket_id = lb.bucket_id AND t = lb.label AND q = lb.label), 0) AS tp,
         coalesce((SELECT sum(n) FROM c WHERE c.bucket_id = lb.bucket_id AND t = lb.label), 0) AS sup,
         coalesce((SELECT sum(n) FROM c WHERE c.bucket_id = lb.bucket_id AND q = lb.label), 0) AS prd FROM lb)
SELECT bucket_id, {rhu('avg(CASE WHEN sup + prd = 0 THEN 0.0 ELSE 2.0 * tp / (sup + prd) END)', 6)} AS f1_macro,
       {rhu('sum(tp) / sum(sup)', 6)} AS accuracy, CAST(sum(sup) AS BIGINT) AS n
FROM pc GROUP BY bucket_id
""",
    "weighted_score": f"""
WITH {REG_PRED}, pb AS (SELECT bucket_id, avg(abs(y_pred - y_true)) AS m, count(*) AS n FROM pred GROUP BY 1)
SELECT {rhu('sum(m * n) / sum(n)', 2)} AS weighted_score FROM pb
""",
    "error_by_prefix_len": f"""
WITH {REG_PRED}
SELECT prefix_len, {rhu('avg(abs(y_pred - y_true))', 2)} AS mean_abs_error, {rhu('stddev_samp(abs(y_pred - y_true))', 2)} AS std_abs_error,
       count(*) AS n FROM pred GROUP BY prefix_len HAVING count(*) >= 5
""",
    "accuracy_by_prefix_len": f"""
WITH {CLS_PRED}
SELECT prefix_len, {rhu('avg(CAST(y_true = y_pred AS DOUBLE))', 6)} AS accuracy, count(*) AS n
FROM pred GROUP BY prefix_len HAVING count(*) >= 5
""",
    "error_histogram": f"""
WITH {REG_PRED}, r AS (SELECT y_pred - y_true AS residual FROM pred),
rg AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r)
SELECT CAST({wb('residual', 'lo', 'hi', '50')} AS INTEGER) AS bin, count(*) AS n,
       {rhu('min(residual)', 2)} AS bin_min, {rhu('max(residual)', 2)} AS bin_max FROM r, rg GROUP BY 1
""",
    "class_weights": f"""
WITH {MODEL_FRAME}, c AS (SELECT label_next_activity, count(*) AS n_class FROM mf WHERE split = 'train' GROUP BY 1)
SELECT label_next_activity, n_class, {rhu('CAST(sum(n_class) OVER () AS DOUBLE) / (count(*) OVER () * n_class)', 6)} AS weight FROM c
""",
    "worst_predictions": f"""
WITH {REG_PRED}
SELECT case_id, prefix_len, {rhu('y_true', 2)} AS y_true, {rhu('y_pred', 2)} AS y_pred, {rhu('abs(y_true - y_pred)', 2)} AS abs_error
FROM pred ORDER BY abs(y_true - y_pred) DESC, case_id ASC, prefix_len ASC LIMIT 10
""",
    "quantile_exemplars": f"""
WITH {MODEL_FRAME}, v AS (SELECT * FROM mf WHERE split = 'val' AND label_remaining_time_sec IS NOT NULL),
qs AS (SELECT quantile_cont(label_remaining_time_sec, [0.5, 0.9, 0.99]) AS vals FROM v),
q AS (SELECT CAST([0.5, 0.9, 0.99][i] AS DOUBLE) AS quantile, vals[i] AS q_value FROM qs, range(1, 4) t(i)),
pick AS (SELECT q.quantile, q.q_value, v.case_id, v.prefix_len, v.label_remaining_time_sec,
                row_number() OVER (PARTITION BY q.quantile ORDER BY abs(v.label_remaining_time_sec - q.q_value), v.case_id, v.prefix_len) AS r
         FROM q, v)
SELECT quantile, {rhu('q_value', 2)} AS q_value, case_id, prefix_len, {rhu('label_remaining_time_sec', 2)} AS label_remaining_time_sec
FROM pick WHERE r = 1
""",
    "nearest_bucket_model": f"""
WITH {MODEL_FRAME}, mx AS (SELECT max(prefix_len) AS m FROM mf WHERE split = 'train'),
b AS (SELECT split, CAST((least(greatest(prefix_len, 1), (SELECT m FROM mx)) - 1) // 2 + 1 AS INTEGER) AS bucket_id FROM mf),
el AS (SELECT bucket_id AS model_bucket FROM b GROUP BY bucket_id
       HAVING count(*) FILTER (WHERE split = 'train') >= 300 AND count(*) FILTER (WHERE split = 'val') >= 300),
bs AS (SELECT DISTINCT bucket_id FROM b)
SELECT bucket_id, arg_min(model_bucket, (abs(bucket_id - model_bucket), model_bucket)) AS model_bucket FROM bs, el GROUP BY bucket_id
""",
})


def _ablation_sql() -> str:
    # stage name -> the log after it; stages that change no row repeat the one before
    logs = [("load", "s1"), ("dedup", "s2"), ("clean", "s3"), ("stable_sort", "s3"), ("time_features", "s3"),
            ("repair_timestamps", "s4"), ("short_cases", "s5"), ("normalize_activities", "s6"),
            ("infrequent_activities", "s7"), ("zero_duration", "s8"), ("case_length", "s9"),
            ("consecutive_duplicates", "s10"), ("impute", "s10"), ("drift_window", "s11"), ("rare_variants", "s12")]
    counted = " UNION ALL ".join(
        f"""SELECT {i} AS stage, '{n}' AS stage_name, coalesce(sum(n), 0)::BIGINT AS n_events, count(*) AS n_cases,
           coalesce(sum(greatest(0, least(30, n - 1))), 0)::BIGINT AS n_prefix_rows
    FROM (SELECT count(*) AS n FROM {t} GROUP BY case_id)""" for i, (n, t) in enumerate(logs, start=1))
    return f"""
WITH s1 AS MATERIALIZED ({LINE_LOG_SQL}),
s2 AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity, "timestamp" ORDER BY _event_index) AS rn FROM s1) WHERE rn = 1),
s3 AS (SELECT * REPLACE (coalesce(activity, 'UNKNOWN') AS activity) FROM s2 WHERE "timestamp" IS NOT NULL AND case_id IS NOT NULL),
s4 AS MATERIALIZED (SELECT * REPLACE (max("timestamp") OVER (PARTITION BY case_id ORDER BY _event_index ROWS UNBOUNDED PRECEDING) AS "timestamp") FROM s3),
s5 AS (SELECT * FROM s4 WHERE case_id IN (SELECT case_id FROM s4 GROUP BY case_id HAVING count(*) >= 2)),
s6 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN trim(activity) IN ('', 'nan', 'None') THEN 'UNKNOWN' ELSE trim(activity) END AS activity) FROM s5),
s7 AS MATERIALIZED (SELECT * FROM s6 WHERE activity NOT IN (
         SELECT activity FROM s6 GROUP BY activity HAVING count(DISTINCT case_id) <
           (SELECT greatest(1, CAST(floor(count(DISTINCT case_id) * 0.005) AS BIGINT)) FROM s6))),
s8 AS MATERIALIZED (SELECT * FROM s7 WHERE case_id NOT IN (SELECT case_id FROM s7 GROUP BY case_id HAVING max("timestamp") <= min("timestamp"))),
s9 AS MATERIALIZED (SELECT * FROM s8 WHERE case_id NOT IN (
         SELECT case_id FROM s8 GROUP BY case_id HAVING count(*) >
           (SELECT CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) FROM (SELECT count(*) AS n FROM s8 GROUP BY case_id)))),
s10 AS MATERIALIZED (SELECT * EXCLUDE (prev) FROM (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY "timestamp", _event_index) AS prev FROM s9)
       WHERE prev IS NULL OR prev <> activity),
s11 AS MATERIALIZED (SELECT * FROM s10 WHERE case_id IN (SELECT case_id FROM s10 GROUP BY case_id HAVING min("timestamp") >= TIMESTAMP '1995-01-01')),
variants AS (SELECT case_id, string_agg(activity, '>' ORDER BY "timestamp", _event_index) AS variant FROM s11 GROUP BY case_id),
s12 AS MATERIALIZED (SELECT * FROM s11 WHERE case_id NOT IN (
         SELECT case_id FROM variants WHERE variant IN (SELECT variant FROM variants GROUP BY variant HAVING count(*) < 5))),
{prefix_cte('s12', 'apfx')}, {split_cte('s12', 'asplits')},
f0 AS MATERIALIZED (SELECT p.case_id, split, label_next_activity, {REMAIN} AS y FROM apfx p JOIN asplits USING (case_id)),
q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM f0 WHERE split = 'train'),
f1 AS MATERIALIZED (SELECT f0.* FROM f0, q WHERE split <> 'train' OR q1 IS NULL OR y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
classes AS (SELECT label_next_activity AS lab, count(*) AS n FROM f1 WHERE split = 'train' GROUP BY 1),
f2 AS (SELECT * FROM f1 WHERE NOT EXISTS (SELECT 1 FROM classes WHERE n < 10)
       OR label_next_activity IN (SELECT lab FROM classes WHERE n >= 10)),
counted AS ({counted}),
whole AS (SELECT n_events, n_cases FROM counted WHERE stage = {len(logs)})
SELECT * FROM counted
UNION ALL SELECT {len(logs) + 1}, 'outliers', n_events, n_cases, (SELECT count(*) FROM f1) FROM whole
UNION ALL SELECT {len(logs) + 2}, 'rare_classes', n_events, n_cases, (SELECT count(*) FROM f2) FROM whole
"""


ORACLE.update({
    "running_case_prefix_long": ORACLE["running_case_prefix"].replace(f"udl AS ({USER_DAY_LOG_SQL})", f"udl AS ({USER_LOG_SQL})"),
    "ablation_row_counts": _ablation_sql(),
    "csv_source": """
SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderstatus AS activity, o_orderdate AS "timestamp", o_orderkey, o_orderpriority
FROM orders
""",
    "xes_source": f"""
WITH ul AS ({USER_LOG_SQL})
SELECT case_id, activity, "timestamp", _event_index AS event_id, {rhu('value', 4)} AS value,
       _event_index::DOUBLE + CASE WHEN _event_index % 2 = 0 THEN 0.0 ELSE 0.5 END AS cost FROM ul
""",
})


ORACLE.update({
    "column_autodetect": """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts AS "timestamp", event_id FROM events
""",
    "test_quantile_exemplars": f"""
WITH {REG_PRED}, t AS (SELECT * FROM pred WHERE split = 'test' AND y_true IS NOT NULL),
qs AS (SELECT quantile_cont(y_true, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS vals FROM t),
q AS (SELECT vals[i] AS qv, i FROM qs, range(1, 8) r(i)),
pick AS (SELECT t.*, row_number() OVER (PARTITION BY q.i ORDER BY abs(t.y_true - q.qv), t.case_id, t.prefix_len) AS r FROM q, t)
SELECT DISTINCT case_id, prefix_len, {rhu('y_true', 2)} AS y_true, {rhu('y_pred', 2)} AS y_pred FROM pick WHERE r = 1
""",
    "bucket_exemplars": f"""
WITH {REG_PRED},
md AS (SELECT bucket_id, quantile_cont(abs(y_true - y_pred), 0.5) AS m FROM pred GROUP BY bucket_id),
pick AS (SELECT p.*, row_number() OVER (PARTITION BY p.bucket_id ORDER BY abs(abs(p.y_true - p.y_pred) - md.m), p.case_id, p.prefix_len) AS r
         FROM pred p JOIN md USING (bucket_id))
SELECT bucket_id, case_id, prefix_len, {rhu('y_true', 2)} AS y_true, {rhu('y_pred', 2)} AS y_pred FROM pick WHERE r = 1
""",
    "qc_report_json": ORACLE["trace_length_stats"],
    "prefix_preview": f"""
WITH {CLEAN_LINE_LOG}, {prefix_cte('clean', 'lpfx')}
SELECT case_id, CAST(k AS INTEGER) AS prefix_len, to_json(acts)::VARCHAR AS prefix_activities, "timestamp" AS prefix_end_time,
       label_next_activity
FROM lpfx ORDER BY case_id, prefix_len LIMIT 100
""",
    "scalar_functions": f"""
SELECT event_id,
  {rhu('ln(1 + greatest(0, value - 50.0))', 6)} AS log1p_clip,
  {rhu('greatest(exp(value / 100.0 - 0.5) - 1, 0)', 6)} AS expm1_clamp,
  {rhu('value * 1000.0 / 86400.0', 6)} AS days,
  {rhu('CASE WHEN event_id % 2 = 0 THEN (value - 50.0) ELSE (50.0 - value) END * 100 / 50.0', 6)} AS gain_pct,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS json_value
FROM events
""",
})


ORACLE.update({
    "resumable_results": f"""
WITH {REG_PRED}
SELECT 'customer_log' AS log, 'remaining_time' AS task, {rhu('avg(abs(y_pred - y_true)) / 86400.0', 6)} AS mae_days, count(*) AS n
FROM pred
""",
})


ORACLE.update({
    "parquet_source": """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts AS "timestamp", event_id, value FROM events
""",
    "schema_qc": """
SELECT 'case_id' AS case_source, 'Activity' AS activity_source, 'time' AS timestamp_source, 'EventID' AS semantic_columns,
       count(*) AS n_rows, count(*) FILTER (WHERE event_id % 10 = 0) AS n_ts_unparsed FROM events
""",
    "aggregated_qc": f"""
WITH ev AS ({ORACLE["aggregated_to_events"]})
SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, {rhu('count(*) / count(DISTINCT case_id)', 6)} AS avg_events_per_case
FROM ev
""",
})


ORACLE.update({
    "case_quantile_exemplars": f"""
WITH {MODEL_FRAME},
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY prefix_len DESC) AS rr
                        FROM mf WHERE split = 'val') WHERE rr = 1 AND label_remaining_time_sec IS NOT NULL),
qs AS (SELECT quantile_cont(label_remaining_time_sec, [0.5, 0.9, 0.99]) AS v FROM reps),
p1 AS (SELECT 1 AS pick, case_id, prefix_len, label_remaining_time_sec FROM reps, qs
       ORDER BY abs(label_remaining_time_sec - v[1]), case_id LIMIT 1),
p2 AS (SELECT 2 AS pick, case_id, prefix_len, label_remaining_time_sec FROM reps, qs
       WHERE case_id NOT IN (SELECT case_id FROM p1)
       ORDER BY abs(label_remaining_time_sec - v[2]), case_id LIMIT 1),
p3 AS (SELECT 3 AS pick, case_id, prefix_len, label_remaining_time_sec FROM reps, qs
       WHERE case_id NOT IN (SELECT case_id FROM p1 UNION ALL SELECT case_id FROM p2)
       ORDER BY abs(label_remaining_time_sec - v[3]), case_id LIMIT 1)
SELECT pick, case_id, prefix_len, {rhu('label_remaining_time_sec', 2)} AS label_remaining_time_sec
FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
""",
})


ORACLE.update({
    "strategy_lookup": f"""
WITH {BK_ADAPTIVE}, longest AS (SELECT max(prefix_len) AS m FROM mf WHERE split = 'train'),
every AS (
  SELECT 'no_bucket' AS bucketing, split, last_act, label_remaining_time_sec AS y, 0 AS b FROM mf
  UNION ALL
  SELECT 'prefix_len_bins', split, last_act, label_remaining_time_sec,
         (least(greatest(prefix_len, 1), (SELECT m FROM longest)) - 1) // 5 + 1 FROM mf
  UNION ALL
  SELECT 'prefix_len_adaptive', split, last_act, label_remaining_time_sec, bucket_id FROM bk),
f AS (SELECT * FROM every WHERE y IS NOT NULL),
ok AS (SELECT bucketing, b FROM f GROUP BY bucketing, b
       HAVING bucketing = 'no_bucket' OR (count(*) FILTER (split = 'train') >= 300 AND count(*) FILTER (split = 'val') >= 300)),
gm AS (SELECT bucketing, b, avg(y) AS gm FROM f WHERE split = 'train' GROUP BY bucketing, b),
la AS (SELECT bucketing, b, last_act, sum(y) AS s, count(*) AS c FROM f WHERE split = 'train' GROUP BY bucketing, b, last_act),
scored AS (
  SELECT f.bucketing, f.b, abs(coalesce((la.s + gm.gm) / (la.c + 1), gm.gm) - f.y) AS e
  FROM f JOIN ok USING (bucketing, b) JOIN gm USING (bucketing, b) LEFT JOIN la USING (bucketing, b, last_act)
  WHERE f.split = 'val'),
per AS (SELECT bucketing, b, avg(e) AS score, count(*) AS n FROM scored GROUP BY bucketing, b)
SELECT bucketing, CASE WHEN bucketing = 'no_bucket' THEN 'global' ELSE 'per_bucket' END AS mode,
       count(*) AS n_models, sum(n)::BIGINT AS n_val, {rhu('sum(score * n) / sum(n) / 86400.0', 6)} AS primary_score
FROM per GROUP BY bucketing
""",
    "sample_prefixes": f"""
WITH {MODEL_FRAME}
SELECT case_id, prefix_len, split FROM mf
WHERE ('0x' || substr(md5('42:' || case_id || ':' || prefix_len), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.1
""",
    "classification_exemplars": f"""
WITH {CLS_PRED},
r AS (SELECT *, row_number() OVER (PARTITION BY y_true <> y_pred ORDER BY md5('42:' || case_id || ':' || prefix_len),
                                   case_id, prefix_len) AS rn FROM pred),
w AS (SELECT least(10, count(*) FILTER (y_true <> y_pred AND rn <= 20)) AS nw FROM r)
SELECT case_id, prefix_len, y_true, y_pred FROM r, w
WHERE (y_true <> y_pred AND rn <= nw) OR (y_true = y_pred AND rn <= 20 - nw)
""",
    "roc_auc": f"""
WITH {REG_PRED}, med AS (SELECT quantile_cont(y_true, 0.5) AS m FROM pred),
l AS (SELECT (y_true > m)::INT AS label, {rhu('y_pred', 3)} AS score FROM pred, med WHERE y_true IS NOT NULL),
c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM l GROUP BY score),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT {rhu('sum(pos * (2 * before + neg))::DOUBLE / (2.0::DOUBLE * sum(pos) * sum(neg))', 9)} AS roc_auc FROM b
""",
})


ORACLE["test_report"] = ORACLE["test_quantile_exemplars"]


#: A running case's state at its latest event (CTE ``state``), from the plain log ``ul``.
RUNNING_STATE = f"""
ul AS ({USER_LOG_SQL}),
rn AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "timestamp", _event_index) AS k,
              row_number() OVER (PARTITION BY case_id ORDER BY "timestamp" DESC, _event_index DESC) AS d FROM ul),
cnt AS (SELECT case_id, string_agg(activity || '=' || n, '>' ORDER BY encode(activity)) AS activity_counts
        FROM (SELECT case_id, activity, count(*) AS n FROM ul GROUP BY ALL) GROUP BY case_id),
st AS (SELECT case_id, CAST(count(*) AS INTEGER) AS prefix_len, max(activity) FILTER (d = 1) AS last_activity,
              string_agg(activity, '>' ORDER BY k) FILTER (k <= 12) AS first_activities, min("timestamp") AS start_ts,
              max("timestamp") FILTER (d = 1) AS prefix_end_time, max("timestamp") FILTER (d = 2) AS prev_ts,
              arg_max(prop_k, k) AS prop_k
       FROM rn GROUP BY case_id),
state AS (SELECT case_id, prefix_len, last_activity, activity_counts, first_activities, prefix_end_time,
                 {rhu('greatest(0, coalesce(' + sec('start_ts', 'prefix_end_time') + ', 0))', 3)} AS feat_elapsed_time_sec,
                 {rhu('greatest(0, coalesce(' + sec('prev_ts', 'prefix_end_time') + ', 0))', 3)} AS feat_time_since_last_event_sec,
                 prop_k FROM st JOIN cnt USING (case_id))
"""

ORACLE.update({
    "running_case_state": f"WITH {RUNNING_STATE} SELECT * FROM state",
    "stream_scoring": f"""
WITH {RUNNING_STATE}, {prefix_cte('ul', 'upfx')},
tr AS (SELECT activity AS la, {REMAIN} AS y FROM upfx),
g AS (SELECT avg(y) AS gm FROM tr),
te AS (SELECT la, (count(*) * avg(y) + any_value(gm)) / (count(*) + 1) AS enc FROM tr, g GROUP BY la)
SELECT state.*, {rhu('coalesce(enc, gm)', 3)} AS predicted_remaining_sec
FROM state LEFT JOIN te ON la = last_activity CROSS JOIN g
""",
    # normal equations of two features, solved by determinants of their (co)variances
    "bucket_regression": f"""
WITH {BK_ADAPTIVE},
t AS (SELECT bucket_id, feat_elapsed_time_sec AS x1, CAST(prefix_len AS DOUBLE) AS x2, label_remaining_time_sec AS y
      FROM bk WHERE split = 'train' AND label_remaining_time_sec IS NOT NULL),
s AS (SELECT bucket_id, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22,
             covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM t GROUP BY bucket_id),
w AS (SELECT *, CASE WHEN s22 > 1e-12 THEN s11 * s22 - s12 * s12 END AS det FROM s),
m AS (SELECT *, CASE WHEN det IS NULL THEN CASE WHEN s11 > 1e-12 THEN s1y / s11 ELSE 0 END ELSE (s1y * s22 - s2y * s12) / det END AS w1,
             CASE WHEN det IS NULL THEN 0 ELSE (s2y * s11 - s1y * s12) / det END AS w2 FROM w),
near AS (SELECT bk.case_id, bk.prefix_len, arg_min(m.bucket_id, abs(m.bucket_id - bk.bucket_id) * 1000 + m.bucket_id) AS model_bucket
         FROM bk, m WHERE split = 'val' GROUP BY ALL)
SELECT case_id, prefix_len, bk.bucket_id, CAST(model_bucket AS INTEGER) AS model_bucket,
       {rhu('label_remaining_time_sec', 2)} AS y_true,
       {rhu('greatest(0, my + w1 * (feat_elapsed_time_sec - m1) + w2 * (prefix_len - m2))', 0)} AS y_pred
FROM bk JOIN near USING (case_id, prefix_len) JOIN m ON m.bucket_id = model_bucket
""",
    "case_exemplars_fill": f"""
{ORACLE['case_quantile_exemplars'].split('SELECT pick, case_id')[0]},
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
f AS (SELECT 4 AS pick, case_id, prefix_len, label_remaining_time_sec FROM reps WHERE case_id NOT IN (SELECT case_id FROM p)
      ORDER BY md5('42:' || case_id), case_id LIMIT 5)
SELECT pick, case_id, prefix_len FROM (SELECT * FROM p UNION ALL SELECT * FROM f)
""",
})

ORACLE["test_exemplars_fill"] = f"""
{ORACLE['test_quantile_exemplars'].split('SELECT DISTINCT case_id')[0]},
near AS (SELECT DISTINCT case_id, prefix_len, y_true, y_pred FROM pick WHERE r = 1),
rest AS (SELECT t.case_id, t.prefix_len, t.y_true, t.y_pred,
                row_number() OVER (ORDER BY md5('42:' || t.case_id || ':' || t.prefix_len), t.case_id, t.prefix_len) AS rn
         FROM t ANTI JOIN near USING (case_id, prefix_len)),
whole AS (SELECT *, 'quantile' AS pick FROM near
          UNION ALL SELECT * EXCLUDE (rn), 'fill' FROM rest WHERE rn <= 20 - (SELECT count(*) FROM near))
SELECT case_id, prefix_len, {rhu('y_true', 2)} AS y_true, {rhu('y_pred', 2)} AS y_pred, pick FROM whole
"""

# ---------------------------------------------------------------- encoder vectors as (feature, value) rows

# order of the numeric snapshot columns in the frame, which is that of the features
VECTOR_NUMS = NUM_FEATURES[2:] + NUM_FEATURES[:2]
VECTOR_CATS = ["case__segment", "event_last__o_orderpriority"]


def _vector_rows() -> str:
    """Features of the last-state vectors with their index: single numbers, then the slots of each category, unknown last."""
    nums = "".join(f"UNION ALL SELECT case_id, prefix_len, 'f_num__{i}', {i + 1}, coalesce(TRY_CAST({c} AS DOUBLE), 0) FROM mf "
                   for i, c in enumerate(VECTOR_NUMS))
    return f"""
cat_sizes AS (SELECT n."column", n.no, coalesce(max(v.slot), 0) AS k
              FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(VECTOR_CATS))}) n("column", no)
              LEFT JOIN vocab v ON v."column" = n."column" GROUP BY ALL),
cat_starts AS (SELECT *, {len(VECTOR_NUMS) + 1} + coalesce(sum(k + 1) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_i
               FROM cat_sizes),
base_feats AS (
  SELECT case_id, prefix_len, 'f_prefix_len' AS feature, 0 AS i, CAST(prefix_len AS DOUBLE) AS value FROM mf {nums}
  UNION ALL
  SELECT c.case_id, c.prefix_len, 'f_cat__' || s.no || '__' || coalesce(CAST(v.slot AS VARCHAR), 'unk'),
         CAST(s.first_i + coalesce(v.slot, s.k + 1) - 1 AS INTEGER), 1.0
  FROM cats c JOIN cat_starts s ON c."column" = s."column"
  LEFT JOIN vocab v ON c."column" = v."column" AND c.value = v.value)"""


ORACLE.update({
    "encoder_vectors": f"""
WITH {MODEL_FRAME}, {_vocab(50, 20)}, {_vector_rows()},
ev AS (SELECT case_id, k AS pos, activity FROM cpfx_pos),
held AS (SELECT mf.case_id, mf.prefix_len, mf.split, e.pos, e.activity
         FROM mf JOIN ev e ON mf.case_id = e.case_id AND e.pos <= mf.prefix_len),
slots AS (SELECT activity, row_number() OVER (ORDER BY activity) AS slot
          FROM (SELECT DISTINCT activity FROM held WHERE split = 'train')),
grid AS (SELECT mf.case_id, mf.prefix_len, CAST(p.range AS INTEGER) AS pos
         FROM mf, range(1, (SELECT max(prefix_len) + 1 FROM mf WHERE split = 'train')) p),
feats AS (
  SELECT e.encoding, prefix_len, feature, value FROM base_feats,
    (VALUES ('last_state'), ('aggregation'), ('index_latest_payload')) e(encoding)
  UNION ALL
  SELECT 'aggregation', prefix_len, 'f_act__' || coalesce(CAST(slot AS VARCHAR), 'unk'), CAST(count(*) AS DOUBLE)
  FROM held LEFT JOIN slots USING (activity) GROUP BY case_id, prefix_len, slot
  UNION ALL
  SELECT 'index_latest_payload', g.prefix_len, 'f_pos__' || g.pos || '__' || coalesce(slot, 0), 1.0
  FROM grid g LEFT JOIN held h ON g.case_id = h.case_id AND g.prefix_len = h.prefix_len AND g.pos = h.pos
  LEFT JOIN slots ON h.activity = slots.activity)
SELECT encoding, feature, prefix_len, count(*) AS n_entries, {rhu('sum(value)', 2)} AS total
FROM feats WHERE value <> 0 GROUP BY ALL
""",
    "encoded_preview": f"""
WITH {MODEL_FRAME}, {_vocab(50, 20)}, {_vector_rows()},
first_rows AS (SELECT case_id, prefix_len FROM mf ORDER BY case_id, prefix_len LIMIT 20),
ranked AS (SELECT f.*, count_if(value <> 0) OVER (PARTITION BY case_id, prefix_len) AS nonzero,
                  row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY abs(value) DESC, i) AS r
           FROM base_feats f JOIN first_rows USING (case_id, prefix_len))
SELECT case_id, prefix_len, (SELECT CAST(max(first_i + k + 1) AS INTEGER) FROM cat_starts) AS feature_dim,
       CAST(nonzero AS INTEGER) AS nonzero, CAST(i AS INTEGER) AS i, {rhu('value', 4)} AS value, feature
FROM ranked WHERE r <= 5 AND value <> 0
""",
})

TEXT_VALUES = """
texts AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d.%m.%Y') AS day_first,
         'Customer#' || o_custkey AS customer, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority,
         o_orderstatus AS status FROM orders),
vals AS (
  SELECT DISTINCT * FROM (
    SELECT 'event_last__day' AS "column", day AS value FROM texts
    UNION ALL SELECT 'event_last__day_first', day_first FROM texts UNION ALL SELECT 'case__customer', customer FROM texts
    UNION ALL SELECT 'event_last__priority', priority FROM texts UNION ALL SELECT 'event_last__status', status FROM texts)
  WHERE value IS NOT NULL)"""

ORACLE.update({
    "date_like": f"""
WITH {TEXT_VALUES},
sampled AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5(value)) AS r,
                   count(*) OVER (PARTITION BY "column") AS n_values FROM vals),
facts AS (
  SELECT "column", any_value(n_values) AS n_values, count(*) AS n_sampled,
         count_if(try_strptime(value, '%Y-%m-%d') IS NOT NULL OR try_strptime(value, '%d.%m.%Y') IS NOT NULL) AS n_dates
  FROM sampled WHERE r <= 20 GROUP BY "column")
SELECT "column", n_values, n_sampled, CAST(n_dates AS BIGINT) AS n_dates,
       CASE WHEN n_dates >= 0.8 * n_sampled THEN 'date_like' WHEN n_values > 500 THEN 'many_values' END AS skipped
FROM facts
""",
    "embedding_values": f"""
WITH {TEXT_VALUES},
grams AS (
  SELECT "column", value, md5(substr('^' || value || '$', CAST(i AS INTEGER), 3)) AS h
  FROM (SELECT "column", value, unnest(range(1, greatest(length(value), 1) + 1)) AS i FROM vals)),
slots AS (
  SELECT "column", value, CAST(('0x' || substr(h, 1, 8))::BIGINT % 16 AS INTEGER) AS dim,
         CAST(sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS s
  FROM grams GROUP BY ALL HAVING s <> 0),
weighed AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY "column", value)) AS w FROM slots)
SELECT "column", value, dim, {rhu('w', 6)} AS weight FROM weighed
""",
})


def _staged_gains_sql() -> str:
    scores = lambda least: ORACLE["strategy_lookup"].replace(">= 300", f">= {least}")
    pct = lambda to, of: rhu(f"coalesce(({of} - {to}) * 100.0 / nullif(abs({of}), 0), 0)", 4)
    return f"""
WITH r AS ({scores(300)}), t AS ({scores(50)}),
g AS (SELECT (SELECT primary_score FROM r WHERE bucketing = 'no_bucket') AS baseline_score,
             (SELECT min(primary_score) FROM r) AS best_score, (SELECT min(primary_score) FROM t) AS search_score)
SELECT 'remaining_time' AS task, baseline_score, best_score, search_score,
       {pct('best_score', 'baseline_score')} AS gain_strategy_pct, {pct('search_score', 'best_score')} AS gain_search_pct FROM g
"""


ORACLE["staged_gains"] = _staged_gains_sql()
