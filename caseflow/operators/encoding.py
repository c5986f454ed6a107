"""Prefix encoders (ENC-1..13).

Two layers:

* a long-format core (one row per (prefix, feature)) that is plain DataFrame
  work and SQL-checkable: vocabularies, one-hot slots, activity counts,
  positional activities, target encodings, embedding means;
* ``fit_encoder`` which turns a fitted vocabulary into column expressions,
  sparse blocks and a ``VectorAssembler``, so Spark ML gets a ``features`` vector.

Vocabularies are capped by configuration (≤ ``max_categories_per_col`` values
for ≤ ``max_categorical_cols`` columns) or by the activity alphabet, so they are
the only things that reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators.schema import CASE
from caseflow.functions.scalar import attach_scalars, small_side
from caseflow.operators.sparse import block_sum, count_block, onehot_blocks, position_blocks

UNK = "__UNK__"
KEY = [CASE, "prefix_len"]
# The snapshot column groups that feed the encoders.
SNAPSHOT_PREFIXES = ("case__", "event_last__", "feat_")
# Columns that are never features (labels, keys, helpers).
NEVER_FEATURES = {"case_id", "prefix_row_id", "prefix_end_time", "prefix_activities", "bucket_id", "split",
                  "prefix_len", "label_outcome", "label_next_activity", "label_remaining_time_sec",
                  "label_remaining_time_log1p", "_event_index", "EventID"}


def infer_feature_columns(df: DataFrame, ignore: list[str] | None = None, max_categorical_cols: int = 30,
                          prefixes=SNAPSHOT_PREFIXES) -> tuple[list[str], list[str]]:
    """ENC-1: (numeric, categorical) snapshot columns from the schema alone; bools are categorical."""
    skip = NEVER_FEATURES | set(ignore or [])
    num, cat = [], []
    for f in df.schema.fields:
        n = f.name
        if n in skip or n.startswith("label_") or n.startswith("_") or not n.startswith(tuple(prefixes)):
            continue
        if isinstance(f.dataType, T.BooleanType):
            cat.append(n)
        elif isinstance(f.dataType, T.NumericType):
            num.append(n)
        elif isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType)):
            cat.append(n)
    return num, cat[:max_categorical_cols]


def _as_text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def unpivot_categories(df: DataFrame, cat_cols: list[str]) -> DataFrame:
    """(key..., column, value) rows for every categorical column."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), _as_text(c).alias("value")) for c in cat_cols])
    return df.select(*KEY, F.explode(arr).alias("_kv")).select(*KEY, "_kv.column", "_kv.value")


def category_vocab(train: DataFrame, cat_cols: list[str], min_freq: int = 50, max_categories: int = 20) -> DataFrame:
    """ENC-2: per column, values with ≥ ``min_freq`` train rows, top ``max_categories``
    by count (ties by value); slot 1..k, slot 0 is UNK.  One aggregate over all columns."""
    if not cat_cols:
        return train.sparkSession.createDataFrame([], "column string, value string, n bigint, slot int")
    counts = (unpivot_categories(train, cat_cols).where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_freq))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (counts.withColumn("slot", F.row_number().over(w).cast("int"))
            .where(F.col("slot") <= max_categories))


def onehot_long(df: DataFrame, vocab: DataFrame, cat_cols: list[str]) -> DataFrame:
    """ENC-3: the one-hot slot of every (prefix, column); unknown and null -> 0 (UNK)."""
    long = unpivot_categories(df, cat_cols)
    j = long.join(small_side(vocab.select("column", "value", "slot")), ["column", "value"], "left")
    return j.select(*KEY, "column", "value", F.coalesce(F.col("slot"), F.lit(0)).alias("slot"))


def last_state_long(df: DataFrame, vocab: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """ENC-5 long: (prefix, feature, value) for prefix length, numerics (null -> 0, ENC-4)
    and one-hot indicators (only the hot slot is emitted)."""
    nums = df.select(*KEY, F.explode(F.array(
        F.struct(F.lit("prefix_len").alias("feature"), F.col("prefix_len").cast("double").alias("value")),
        *[F.struct(F.lit(f"num__{c}").alias("feature"),
                   F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias("value")) for c in num_cols]
    )).alias("_f")).select(*KEY, "_f.feature", "_f.value")
    if not cat_cols:
        return nums
    oh = onehot_long(df, vocab, cat_cols).select(
        *KEY, F.concat(F.lit("cat__"), F.col("column"), F.lit("__"),
                       F.when(F.col("slot") == 0, F.lit(UNK)).otherwise(F.col("value"))).alias("feature"),
        F.lit(1.0).alias("value"))
    return nums.unionByName(oh)


def activity_vocab(train: DataFrame, prefix_col: str = "prefix_activities") -> DataFrame:
    """SET-5: distinct activities over train prefixes, slot 1..n by name (0 = UNK)."""
    acts = train.select(F.explode(prefix_col).alias("activity")).distinct()
    return acts.withColumn("slot", F.row_number().over(Window.orderBy("activity")).cast("int"))


def activity_counts_long(df: DataFrame, vocab: DataFrame, prefix_col: str = "prefix_activities") -> DataFrame:
    """ENC-6 long: per prefix, count of each activity slot (unseen activities pooled in UNK)."""
    ex = df.select(*KEY, F.explode(prefix_col).alias("activity"))
    j = ex.join(small_side(vocab), "activity", "left")
    return (j.groupBy(*KEY, F.coalesce(F.col("slot"), F.lit(0)).alias("slot"))
            .agg(F.count(F.lit(1)).alias("count")))


def positional_activity_long(df: DataFrame, vocab: DataFrame, max_len: int,
                             prefix_col: str = "prefix_activities") -> DataFrame:
    """ENC-7 (activity part): activity slot at each position 1..max_len; padding -> UNK (0)."""
    pos = F.sequence(F.lit(1), F.lit(max_len))
    ex = df.select(*KEY, F.explode(F.arrays_zip(pos.alias("position"),
                                                F.transform(pos, lambda i: F.get(F.col(prefix_col), i - 1)).alias("activity")))
                   .alias("_p")).select(*KEY, "_p.position", "_p.activity")
    j = ex.join(small_side(vocab), "activity", "left")
    return j.select(*KEY, "position", "activity", F.coalesce(F.col("slot"), F.lit(0)).alias("slot"))


def target_encoding(train: DataFrame, cat_col: str, label_col: str, smoothing: float = 1.0) -> DataFrame:
    """ENC-8 fit: m-estimate ``(n*mean + s*global) / (n + s)`` per category, plus the global mean."""
    y = F.col(label_col).try_cast("double")
    t = train.where(y.isNotNull()).select(_as_text(cat_col).alias("category"), y.alias("_y"))
    g = t.agg(F.avg("_y").alias("global_mean"))
    per = t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"))
    return attach_scalars(per, g).withColumn(
        "encoding", (F.col("n") * F.col("mean") + F.lit(smoothing) * F.col("global_mean"))
        / (F.col("n") + F.lit(smoothing)))


def apply_target_encoding(df: DataFrame, enc: DataFrame, cat_col: str, out_col: str) -> DataFrame:
    """ENC-8 apply (JON-7): lookup join, unseen / null -> global mean.

    The category table is as large as the column's cardinality (no cap applies
    to target encoding): it is counted, and broadcast if small, so that a column of
    few values does not send all its rows to as many tasks.
    """
    g = enc.agg(F.first("global_mean").alias("_gm"))
    e = small_side(enc.select(F.col("category").alias("_cat"), F.col("encoding").alias("_enc")))
    j = attach_scalars(df.join(e, _as_text(cat_col) == F.col("_cat"), "left"), g)
    return j.withColumn(out_col, F.coalesce(F.col("_enc"), F.col("_gm"))).drop("_cat", "_enc", "_gm")


def activity_target_encoding(train: DataFrame, label_col: str, smoothing: float = 1.0,
                             prefix_col: str = "prefix_activities") -> DataFrame:
    """ENC-9: every activity occurrence in a train prefix carries that prefix's label."""
    ex = train.select(F.explode(prefix_col).alias("activity"), F.col(label_col))
    return target_encoding(ex, "activity", label_col, smoothing)


def activity_vectors(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A fixed activity -> vector lookup: the activity with slot s takes ``vec_id = s - 1``."""
    return vocab.join(embeddings.select(F.col("vec_id"), F.col("embedding")),
                      (F.col("slot") - 1) == F.col("vec_id")).select("activity", "embedding")


def embedding_mean_last_long(df: DataFrame, vectors: DataFrame, prefix_col: str = "prefix_activities") -> DataFrame:
    """ENC-10 long: per prefix and dimension, mean of the activity vectors and the last
    activity's vector; activities without a vector use the mean vector of the lookup."""
    if len(table := _mean_last_table(vectors)) > 1:
        return _mean_last_looked_up(df, table, prefix_col)
    return _mean_last_joined(df, vectors, prefix_col)


#: Activities up to which the vectors go to every task as a table.
VECTOR_TABLE_ROWS = 20_000


def _mean_last_table(vectors: DataFrame) -> dict:
    """Activity -> (sum of its vectors, their number, one of them); under None the mean vector, for what has none.

    Empty if there are no vectors, or too many for one task.
    """
    if vectors.limit(VECTOR_TABLE_ROWS + 1).count() > VECTOR_TABLE_ROWS:
        return {}
    of: dict = {}
    for r in vectors.select("activity", F.transform("embedding", lambda v: v.cast("double")).alias("v")).collect():  # activity alphabet
        of.setdefault(r["activity"], []).append(r["v"])
    known = [v for vs in of.values() for v in vs if v is not None]
    if not known:
        return {}
    mean = np.array(known).mean(axis=0)
    filled = {a: [mean if v is None else np.array(v) for v in vs] for a, vs in of.items() if a is not None}
    return {a: (sum(vs), len(vs), vs[0]) for a, vs in filled.items()} | {None: (mean, 1, mean)}


def _mean_last_looked_up(df: DataFrame, table: dict, prefix_col: str) -> DataFrame:
    """One row of activities for each prefix is all that moves: vectors are added up in the task that has the prefix."""
    shared, dim = df.sparkSession.sparkContext.broadcast(table), len(table[None][0])
    acts = F.col(prefix_col)
    of = (df.where(F.size(acts) > 0).groupBy(*KEY)
          .agg(F.flatten(F.collect_list(acts)).alias("_acts"), F.max_by(F.element_at(acts, -1), F.size(acts)).alias("_end")))
    both = of.select(*KEY, F.arrow_udf(_mean_last_rows(shared), "array<double>")("_acts", "_end").alias("_e"))
    # taken apart by a list that the function gave: it runs for each prefix, not for each dimension
    return (both.select(*KEY, "_e", F.posexplode(F.slice("_e", 1, dim)).alias("dim", "mean_value"))
            .select(*KEY, "dim", "mean_value", F.get("_e", F.col("dim") + dim).alias("last_value")))


def _mean_last_rows(shared):
    def rows(names: pa.Array, last: pa.Array) -> pa.Array:
        slot = {a: i for i, a in enumerate(shared.value)}
        total, count, one = (np.array(c, float) for c in zip(*shared.value.values()))

        def slots(of: pa.Array) -> np.ndarray:
            coded = of.dictionary_encode()
            known = np.array([slot.get(a, slot[None]) for a in coded.dictionary.to_pylist()] + [slot[None]])
            return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]

        ends = np.append(0, np.cumsum(names.value_lengths().to_numpy(zero_copy_only=False)))
        at, out = slots(names.flatten()), np.empty((len(names), 2 * total.shape[1]))
        for i in range(0, len(names), 1000):  # so many that their vectors fit in memory side by side
            k = min(i + 1000, len(names))
            own, starts = at[ends[i]:ends[k]], ends[i:k] - ends[i]
            out[i:k, :total.shape[1]] = np.add.reduceat(total[own], starts) / np.add.reduceat(count[own], starts)[:, None]
        out[:, total.shape[1]:] = one[slots(last)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
    return rows


def _mean_last_joined(df: DataFrame, vectors: DataFrame, prefix_col: str) -> DataFrame:
    """The same for more vectors than a task should hold: activities join their vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    dims = vectors.select(F.posexplode("embedding").alias("dim", "x"), "activity")
    mean_vec = dims.groupBy("dim").agg(F.avg("x").alias("mx")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mx"))), lambda e: e["mx"]).alias("_mean"))
    ex = df.select(*KEY, F.posexplode(prefix_col).alias("pos", "activity"))
    ex = attach_scalars(ex.join(small_side(vectors), "activity", "left"), mean_vec)
    # activities without a vector use the mean vector of the lookup
    vec = F.coalesce(F.transform("embedding", lambda v: v.cast("double")), F.col("_mean"))
    # vectors are summed up per prefix before they are taken apart, so rows are prefixes x dimensions
    state = ex.groupBy(*KEY).agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("_sum"),
                                 F.max_by(vec, "pos").alias("_last"))
    return (state.select(*KEY, "_last", F.posexplode("_sum").alias("dim", "mean_value"))
            .select(*KEY, "dim", "mean_value", F.get("_last", F.col("dim")).alias("last_value")))


# Shapes of texts that are dates or times, with or without the other.
DATE_SHAPES = (
    r"^[0-9]{4}[-/]?(0[1-9]|1[0-2])[-/]?(0[1-9]|[12][0-9]|3[01])([T ].*)?$",
    r"^(0?[1-9]|[12][0-9]|3[01])[./-](0?[1-9]|[12][0-9]|3[01])[./-]([0-9]{4}|[0-9]{2})([T ].*)?$",
    r"^T?([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
)


def column_facts(df: DataFrame, cat_cols: list[str], sample: int = 20, share: float = 0.8, most: int = 500) -> DataFrame:
    """SCL-11: (column, n_values, n_sampled, n_dates, skipped) for columns that an embedding could read.

    ``skipped`` is ``date_like`` if at least ``share`` of up to ``sample`` different
    values (those of least MD5, so reruns agree) have a date's shape, else
    ``many_values`` above ``most`` different values, else null.  A column of nulls
    has no row.  One aggregate over all columns.
    """
    values = unpivot_categories(df, cat_cols).where("value is not null").select("column", "value").distinct()
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    w = Window.partitionBy("column").orderBy(F.md5(F.col("value").cast("binary")))  # cut off inside each task
    sampled = values.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    is_date = F.lit(False)
    for shape in DATE_SHAPES:
        is_date = is_date | F.col("value").rlike(shape)
    tested = sampled.groupBy("column").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(is_date).alias("n_dates"))
    return tested.join(sizes, "column").withColumn(
        "skipped", F.when(F.col("n_dates") >= F.lit(share) * F.col("n_sampled"), "date_like")
        .when(F.col("n_values") > most, "many_values"))


def value_vectors(values: DataFrame, dim: int = 16) -> DataFrame:
    """ENC-10 for categorical values, long: (column, value, dim, weight) of hashed character 3-grams.

    Each 3-gram of ``^value$`` adds +1 or -1 (a digit of its MD5) at a slot (its
    first 32 bits), and the vector has length 1, so values spelled alike lie
    close.  Slots that hold 0 have no row.
    """
    padded = F.concat(F.lit("^"), F.col("value"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3)))
    h = F.md5(F.col("gram").cast("binary"))
    slots = (values.select("column", "value", F.explode(grams).alias("gram"))
             .select("column", "value", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("dim"),
                     F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1).alias("sign"))
             .groupBy("column", "value", "dim").agg(F.sum("sign").cast("double").alias("s")).where("s <> 0"))
    of_value = Window.partitionBy("column", "value")  # dim rows at most
    return slots.select("column", "value", "dim", (F.col("s") / F.sqrt(F.sum(F.col("s") * F.col("s")).over(of_value))).alias("weight"))


def _value_vectors(train: DataFrame, cat_cols: list[str], dim: int) -> dict[str, dict[str, list[float]]]:
    """Vectors of the values of all columns that are not skipped (at most 500 for each column)."""
    used = [r["column"] for r in column_facts(train, cat_cols).where("skipped is null").collect()] if cat_cols else []
    out: dict = {}
    if used:
        values = unpivot_categories(train, used).where("value is not null").select("column", "value").distinct()
        for r in value_vectors(values, dim).collect():
            out.setdefault(r["column"], {}).setdefault(r["value"], [0.0] * dim)[r["dim"]] = r["weight"]
    return {c: out[c] for c in cat_cols if c in out}


# ---------------------------------------------------------------- ML wrap (ENC-5/6/7/10/11/13)

@dataclass
class FittedEncoder:
    """Column expressions, sparse blocks and assembler; ``transform`` adds ``features`` (and ``label``)."""
    name: str
    feature_cols: list
    exprs: dict
    lookups: list = field(default_factory=list)  # broadcast-lookup steps (DataFrame -> DataFrame)
    label_expr: Column | None = None
    label_col: str = ""
    state: dict = field(default_factory=dict)  # all that was learned, as JSON values
    tables: dict = field(default_factory=dict)  # and as tables: column -> target encoding (unbounded cardinality)
    scalars: list = field(default_factory=list)  # columns of ``exprs`` and ``lookups``, the first features
    blocks: list = field(default_factory=list)  # (frame, is it running-case state) -> (frame, vector columns added)

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        out, of_state = df, "activity_counts" in df.columns
        for fn in self.lookups:
            out = fn(out)
        out = out.withColumns(self.exprs)
        inputs = list(self.scalars)
        for block in self.blocks:
            out, added = block(out, of_state)
            inputs += added
        if self.label_expr is not None and self.label_col in df.columns:
            out = out.withColumn("label", self.label_expr)
        va = VectorAssembler(inputCols=inputs, outputCol=features_col, handleInvalid="keep")
        return va.transform(out).drop(*inputs)

    def centre(self, train: DataFrame) -> list[float]:
        """A point near the features, for sums around it: the means of single numbers, the label's mean for target
        encodings, and 0 for what a vocabulary counts.  The rows are not encoded for it."""
        numbers = {c: F.avg(self.exprs[c]).alias(f"m{i}") for i, c in enumerate(self.scalars) if c in self.exprs}
        label = F.avg(F.col(self.label_col).try_cast("double")) if self.state.get("label_is_numeric") else F.lit(0.0)
        means = train.agg(*numbers.values(), label.alias("label")).first()
        near = {c: float(means[f"m{i}"] or 0.0) for i, c in enumerate(self.scalars) if c in numbers}
        encoded = "f_te__" if self.state["activity"] != "target" else ("f_te__", "f_pos__")
        return [near.get(c, float(means["label"] or 0.0) if c.startswith(encoded) else 0.0) for c in self.feature_cols]

    @property
    def feature_dim(self) -> int:
        return len(self.feature_cols)


def _vocab_dict(vocab: DataFrame) -> dict[str, list[str]]:
    d: dict[str, list[str]] = {}
    for r in vocab.orderBy("column", "slot").collect():  # bounded: ≤ cols × max_categories
        d.setdefault(r["column"], []).append(r["value"])
    return d


def fit_encoder(name: str, train: DataFrame, label_col: str = "label_remaining_time_sec",
                label_is_numeric: bool = True, max_prefix_len: int | None = None, min_freq: int = 50,
                max_categories: int = 20, max_categorical_cols: int = 30, ignore: list[str] | None = None,
                vectors: DataFrame | None = None, label_vocab: list[str] | None = None,
                compress_dim: int = 64, categorical_encoding: str = "target",
                activity_encoding: str = "target", value_dim: int = 0) -> FittedEncoder:
    """Fit one of ``last_state``, ``aggregation``, ``index_latest_payload``, ``embedding`` on train rows.

    ``index_latest_payload`` options (ENC-7): ``categorical_encoding`` target /
    onehot / label (ordinal vocabulary slot, 0 = UNK); ``activity_encoding``
    target / onehot_per_position / counts.  Classification forces one-hot for
    both (a target mean of a class label is meaningless).  With ``value_dim``, ``embedding`` gives categorical
    values vectors of that length in place of one-hot slots, without date-like columns and those of over 500 values.
    """
    if name == "index_latest_payload" and not label_is_numeric:
        categorical_encoding, activity_encoding = "onehot", "onehot_per_position"
    if name != "index_latest_payload":
        categorical_encoding = "onehot"
        activity_encoding = {"aggregation": "counts", "embedding": "vectors"}.get(name, "none")
    num_cols, cat_cols = infer_feature_columns(train, ignore, max_categorical_cols)
    state = {"name": name, "num_cols": num_cols, "cat_cols": cat_cols, "categorical": categorical_encoding,
             "activity": activity_encoding, "label_col": label_col, "label_is_numeric": label_is_numeric,
             "label_vocab": label_vocab}
    tables = {}
    if categorical_encoding == "target":
        tables = {c: target_encoding(train, c, label_col) for c in cat_cols}
    else:
        state["vocab"] = _vocab_dict(category_vocab(train, cat_cols, min_freq, max_categories))
    if activity_encoding in ("target", "onehot_per_position"):  # positions up to the longest train prefix
        state["max_len"] = max_prefix_len or train.agg(F.max("prefix_len")).first()[0] or 1
    if activity_encoding in ("counts", "onehot_per_position"):
        state["activities"] = [r["activity"] for r in activity_vocab(train).orderBy("slot").collect()]  # activity alphabet
    elif activity_encoding == "target":
        rows = activity_target_encoding(train, label_col).select("category", "encoding", "global_mean").collect()
        state["activity_target"] = {r["category"]: float(r["encoding"]) for r in rows}  # activity alphabet
        state["activity_mean"] = float((rows[0]["global_mean"] if rows else 0.0) or 0.0)
    elif activity_encoding == "vectors":
        if vectors is None:
            from pyspark.ml.feature import Word2Vec
            w2v = Word2Vec(vectorSize=16, minCount=1, seed=42, inputCol="prefix_activities", outputCol="_w2v")
            vectors = _w2v_vectors(w2v.fit(train))
        rows = compress_vectors(vectors, compress_dim).collect()  # activity alphabet x dim
        state["vectors"] = {r["activity"]: [float(x) for x in r["embedding"]] for r in rows}
        if value_dim:
            state["categorical"], state["value_vectors"] = "vectors", _value_vectors(train, cat_cols, value_dim)
    return build_encoder(state, tables)


def build_encoder(state: dict, tables: dict[str, DataFrame] | None = None) -> FittedEncoder:
    """The encoder of what :func:`fit_encoder` learned; the same from memory as from a saved bundle.

    Single numbers are column expressions; everything that a vocabulary indexes
    is a block (``sparse.py``, or the batch lookup of vectors), so the plan does
    not grow with the activities or values.  Features: the single numbers, then
    the blocks' slots, in the order of ``feature_cols``.
    """
    tables, cat_cols = tables or {}, state["cat_cols"]
    exprs: dict = {"f_prefix_len": F.col("prefix_len").cast("double")}
    lookups, blocks = [], []
    for i, c in enumerate(state["num_cols"]):
        exprs[f"f_num__{i}"] = F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    for i, c in enumerate(cat_cols if state["categorical"] == "label" else ()):  # at most max_categories values
        slots = _literal_map({v: float(j + 1) for j, v in enumerate(state["vocab"].get(c, []))})
        exprs[f"f_lab__{i}"] = F.coalesce(F.try_element_at(slots, _as_text(c)), F.lit(0.0))
    scalars = list(exprs)
    for i, c in enumerate(cat_cols if state["categorical"] == "target" else ()):
        lookups.append(lambda df, c=c, out=f"f_te__{i}": apply_target_encoding(df, tables[c], c, out))
        scalars.append(f"f_te__{i}")
    names = list(scalars)
    if state["categorical"] == "onehot" and cat_cols:
        values = {c: state["vocab"].get(c, []) for c in cat_cols}
        blocks.append(_onehot_block(values))
        names += [n for i, c in enumerate(cat_cols)
                  for n in [*[f"f_cat__{i}__{j + 1}" for j in range(len(values[c]))], f"f_cat__{i}__unk"]]
    acts, kind, longest = state.get("activities", []), state["activity"], state.get("max_len", 0)
    if kind == "counts":
        blocks.append(_count_block(acts))
        names += ["f_act__unk"] + [f"f_act__{j + 1}" for j in range(len(acts))]
    elif kind == "onehot_per_position":
        blocks.append(_position_block(acts, longest))
        names += [f"f_pos__{p}__{j + 1}" for p in range(1, longest + 1) for j in range(len(acts))]
        names += [f"f_pos__{p}__0" for p in range(1, longest + 1)]
    elif kind == "target":
        blocks.append(_position_target_block(state["activity_target"], state["activity_mean"], longest))
        names += [f"f_pos__{p}" for p in range(1, longest + 1)]
    elif kind == "vectors":
        vectors, of_values = state["vectors"], state.get("value_vectors", {})
        dim = len(next(iter(vectors.values()), []))
        blocks.append(_vector_block(vectors, of_values))
        names += [f"f_emb_mean__{d}" for d in range(dim)] + [f"f_emb_last__{d}" for d in range(dim)]
        names += [f"f_val__{i}__{d}" for i, c in enumerate(of_values) for d in range(len(next(iter(of_values[c].values()))))]
    label = None
    if state["label_is_numeric"]:
        label = F.coalesce(F.col(state["label_col"]).try_cast("double"), F.lit(0.0))
    elif state["label_vocab"] is not None:
        ids = _literal_map({v: float(i + 1) for i, v in enumerate(state["label_vocab"])})
        label = F.coalesce(F.try_element_at(ids, F.col(state["label_col"]).cast("string")), F.lit(0.0))
    return FittedEncoder(state["name"], names, exprs, lookups, label, state["label_col"], state, tables, scalars, blocks)


def _onehot_block(values: dict[str, list[str]]):
    outs = [f"f_cat__{i}" for i in range(len(values))]
    return lambda df, of_state: (onehot_blocks(df, values, outs), outs)


def _count_block(acts: list[str]):
    """Counts of unseen activities, then of each known one.

    A running case's state has counts instead of the list: they are looked up in
    a batch (a case is one row there), since its list may be as long as the log.
    """
    def add(df: DataFrame, of_state: bool):
        if of_state:
            slots = {a: j + 1 for j, a in enumerate(acts)}
            counts = _looked_up(lambda: _count_rows(df.sparkSession.sparkContext.broadcast(slots), len(slots) + 1),
                                F.map_keys("activity_counts"), F.map_values("activity_counts").cast("array<double>"))
            return _sized(df.withColumn("f_act", counts), "f_act", len(slots) + 1)
        if not acts:
            return df.withColumn("f_act__unk", F.size("prefix_activities").cast("double")), ["f_act__unk"]
        df = count_block(df, F.col("prefix_activities"), acts, "f_act")
        return df.withColumn("f_act__unk", F.size("prefix_activities") - block_sum("f_act")), ["f_act__unk", "f_act"]
    return add


def _position_block(acts: list[str], longest: int):
    def add(df: DataFrame, of_state: bool):
        df = position_blocks(df, F.col("prefix_activities"), acts, longest, "f_pos", "f_pos__0")
        return df, (["f_pos"] if acts else []) + ["f_pos__0"]
    return add


def _position_target_block(encodings: dict[str, float], mean: float, longest: int):
    def add(df: DataFrame, of_state: bool):
        shared = df.sparkSession.sparkContext.broadcast(encodings)
        first = F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), lambda i: F.get("prefix_activities", i))
        return _sized(df.withColumn("f_pos", _looked_up(lambda: _target_rows(shared, mean), first)), "f_pos", longest)
    return add


def _vector_block(vectors: dict[str, list[float]], of_values: dict[str, dict[str, list[float]]]):
    """Mean vector of the activities, vector of the last one, and the vector of each categorical value.

    What has no vector takes the mean of its table.
    """
    width = 2 * len(next(iter(vectors.values()), [])) + sum(len(next(iter(t.values()))) for t in of_values.values())

    def add(df: DataFrame, of_state: bool):
        shared = df.sparkSession.sparkContext.broadcast((vectors, list(of_values.values())))
        if of_state:
            names, times, last = F.map_keys("activity_counts"), F.map_values("activity_counts").cast("array<double>"), F.col("last_activity")
        else:
            names, last = F.col("prefix_activities"), F.element_at("prefix_activities", -1)
            times = F.transform(names, lambda _: F.lit(1.0))
        texts = F.array(*[_as_text(c) for c in of_values]) if of_values else F.array().cast("array<string>")
        looked_up = df.withColumn("f_emb", _looked_up(lambda: _vector_rows(shared), names, times, last, texts))
        return _sized(looked_up, "f_emb", width)
    return add


def _looked_up(make, *cols: Column) -> Column:
    """A vector column from a batch lookup: ``make()`` gives the function from Arrow arrays to lists of numbers."""
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.arrow_udf(make(), "array<double>")(*cols))


def _sized(df: DataFrame, block: str, size: int) -> tuple[DataFrame, list[str]]:
    """The frame with the block's length in its metadata, which the assembler asks for."""
    from pyspark.ml.feature import VectorSizeHint
    return VectorSizeHint(inputCol=block, size=size, handleInvalid="optimistic").transform(df), [block]


def _found(values: pa.Array, of: dict, other):
    """``of[value]`` or ``other`` for each of the values, looked up once for each different value."""
    coded = values.dictionary_encode()
    known = np.array([of.get(v, other) for v in [*coded.dictionary.to_pylist(), None]])
    return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]


def _list_rows(lists: pa.Array) -> np.ndarray:
    """The row of each element of the lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as one list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _count_rows(slots, width: int):
    def rows(names: pa.Array, times: pa.Array) -> pa.Array:
        out = np.zeros((len(names), width))
        np.add.at(out, (_list_rows(names), _found(names.flatten(), slots.value, 0)), times.flatten().to_numpy(zero_copy_only=False))
        return _lists(out)
    return rows


def _target_rows(encodings, mean: float):
    def rows(names: pa.Array) -> pa.Array:  # lists of one length
        found = _found(names.flatten(), encodings.value, mean).astype(float)
        return _lists(found.reshape(len(names), -1) if len(names) else np.zeros((0, 0)))
    return rows


def _vector_rows(shared):
    def rows(names: pa.Array, times: pa.Array, last: pa.Array, texts: pa.Array) -> pa.Array:
        vectors, of_values = shared.value
        (of, matrix), tables = _indexed(vectors), [_indexed(t) for t in of_values]
        row, n = _list_rows(names), times.flatten().to_numpy(zero_copy_only=False)
        total = np.bincount(row, n, len(names))
        mean = np.full((len(names), matrix.shape[1]), np.nan)
        if len(row):
            of_row, starts = np.unique(row, return_index=True)
            with np.errstate(divide="ignore", invalid="ignore"):  # without a count there is no mean
                sums = np.add.reduceat((n / total[row])[:, None] * matrix[_found(names.flatten(), of, -1)], starts)
            mean[of_row] = np.where(total[of_row, None] != 0, sums, np.nan)
        value = texts.flatten()
        return _lists(np.hstack([mean, matrix[_found(last, of, -1)],
                                 *[m[_found(value.take(pa.array(np.arange(len(names)) * len(tables) + k)), at, -1)]
                                   for k, (at, m) in enumerate(tables)]]))
    return rows


def _indexed(vectors: dict[str, list[float]]) -> tuple[dict[str, int], np.ndarray]:
    """Row of each name, and the rows; the last row is their mean."""
    rows = np.array(list(vectors.values()), float)
    return {a: i for i, a in enumerate(vectors)}, np.vstack([rows, rows.mean(axis=0)])


def _literal_map(values: dict[str, float]) -> Column:
    if not values:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def compress_vectors(vectors: DataFrame, k: int = 64) -> DataFrame:
    """ENC-11: PCA to ``k`` dims, fitted on the vocabulary vectors (one row per activity)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    first = vectors.select(F.size("embedding")).first()
    dim = first[0] if first else 0
    if not dim or dim <= k:
        return vectors
    n = vectors.count()  # vocabulary size
    kk = min(k, n)
    v = vectors.select("activity", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=kk, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).select("activity", vector_to_array("_p").alias("embedding"))


def _w2v_vectors(model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.getVectors().select(F.col("word").alias("activity"), vector_to_array("vector").alias("embedding"))


def label_vocabulary(train: DataFrame, label_col: str) -> list[str]:
    """ENC-12: sorted train labels; id 0 is UNK, labels 1..n (bounded by the class count)."""
    return [r[0] for r in train.select(F.col(label_col).cast("string")).where(F.col(label_col).isNotNull())
            .distinct().orderBy(1).collect()]


ENCODERS = ["last_state", "aggregation", "index_latest_payload", "embedding"]
