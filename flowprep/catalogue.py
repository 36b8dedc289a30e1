"""All registered queries of the engine's own operators, and the SQL that says the same.

Roles on the driver's tables: events are flows (file: user_id % 6, label: event_type, time: ts, row: event_id), lineitem
is a numeric feature table, documents hold duplicates and, with labels, scores, embeddings are a wide matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import schema as S
from .ml import explain, net, trees
from .operators import dedup, figures, labels, metrics, monitor, prep, profile, ranking, sampling, splits
from .plans import prepare
from .sources import datasets, footers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The roles, in both languages.

BENIGN, ATTACK, DROPPED = ["purchase"], ["view", "click"], ["signup"]  # error has no decision


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    wide = F.when(F.col("event_id") % 7 == 1, F.concat(F.lit("\u00a0"), "event_type", F.lit("\u3000"))).otherwise(F.col("event_type"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type", F.lit("\t"))).otherwise(wide)
    time = F.when(F.col("event_id") % 29 != 0, F.col("ts"))
    return e.select("event_id", (F.col("user_id") % 6).cast("string").alias("file"), raw.alias("label"), time.alias("ts"), "user_id", "value")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.decide(flows(spark, sf_dir), "label", labels.decision_table(spark, BENIGN, ATTACK, DROPPED))


ENDS = f"^[{C.WHITE}]+|[{C.WHITE}]+$"
FLOWS = """flows AS (
    SELECT event_id, CAST(user_id % 6 AS VARCHAR) AS file, CASE WHEN event_id % 3 = 0 THEN ' ' || event_type || chr(9) WHEN event_id % 7 = 1 THEN chr(160) || event_type || chr(12288) ELSE event_type END AS label,
        CASE WHEN event_id % 29 <> 0 THEN ts END AS ts, user_id, value
    FROM events
), decided AS (
    SELECT *, regexp_replace(label, '@ENDS', '', 'g') AS raw_label,
        CASE regexp_replace(label, '@ENDS', '', 'g') WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 255 END AS y
    FROM flows
)""".replace("@ENDS", ENDS)

SPLIT = (
    "WITH "
    + FLOWS
    + """, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY file, raw_label ORDER BY ts ASC NULLS FIRST, event_id) AS r, count(*) OVER (PARTITION BY file, raw_label) AS n
    FROM decided WHERE y <> 255
), sized AS (
    SELECT *, CASE WHEN n >= 3 THEN least(greatest(CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT), 1), n - 2) ELSE n END AS nt FROM ranked
), cuts AS (
    SELECT *, CASE WHEN n >= 3 THEN least(greatest(CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT), 1), n - nt - 1) ELSE 0 END AS nv FROM sized
), split AS (
    SELECT *, CASE WHEN r <= nt THEN 0 WHEN r <= nt + nv THEN 1 ELSE 2 END AS split FROM cuts
)"""
)


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_stratified(labels.in_scope(decided(spark, sf_dir)), "file", "raw_label", "ts", "event_id")


SUMMARY = "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE y = 0) AS n_benign, count(*) FILTER (WHERE y = 1) AS n_attack, round(count(*) FILTER (WHERE y = 0) / count(*), 8) AS benign_ratio, round(count(*) FILTER (WHERE y = 1) / nullif(count(*) FILTER (WHERE y = 0), 0), 2) AS attack_per_benign FROM {} GROUP BY split"


# Scans and schema.


@query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def scan_projected(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01'").select("l_orderkey", "l_quantity", "l_shipdate")


@query("SELECT count(*) AS n_rows, count(*) - count(l_orderkey) AS nulls, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def footer_bounds(spark, sf_dir):
    """Rows and bounds of a column from footers alone."""
    return footers.bounds(footers.footer_table(spark, datasets.discover(spark, f"{sf_dir}/lineitem.parquet")), "l_orderkey", "long")


@query("SELECT count(*) AS n_rows FROM lineitem")
def scan_rowcount(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"))


@query("SELECT unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_quantity', 'l_tax']) AS feature")
def schema_numeric_features(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    features, _, _ = S.feature_columns(li.schema, ["l_returnflag", "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey"])
    return spark.createDataFrame([(f,) for f in sorted(features)], "feature string")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS as_float, TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS user_float, 1 / (1 + exp(-(value - 50) / 25)) > 0.5 AS positive FROM events")
def scalar_coercions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", C.as_number("event_type").alias("as_float"), C.as_number(F.col("user_id").cast("string")).alias("user_float"), (C.sigmoid((F.col("value") - 50) / 25) > 0.5).alias("positive"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) END AS time FROM events")
def mixed_times(spark, sf_dir):
    """Times that come as texts of several formats, or of none."""
    k = F.col("event_id") % 5
    text = F.lit("no time")
    for i, form in enumerate(("yyyy-MM-dd HH:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd", "d/M/yyyy h:mm:ss a")):
        text = F.when(k == i, F.date_format("ts", form)).otherwise(text)
    return read(spark, sf_dir, "events").select("event_id", C.parsed_time(text).cast("timestamp_ntz").alias("time"))


@query("SELECT o_orderstatus AS file, count(*) AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent, sha256(max(o_orderpriority)) AS digest FROM orders WHERE lower(o_orderstatus) LIKE '%f' OR split_part('a/b/' || o_orderstatus, '/', 3) = 'O' GROUP BY 1")
def scalar_strings(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    kept = o.where(F.lower("o_orderstatus").endswith("f") | (C.path_part(F.concat(F.lit("a/b/"), "o_orderstatus"), 1) == "O"))
    return kept.groupBy(F.col("o_orderstatus").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"), F.sha2(F.max("o_orderpriority"), 256).alias("digest"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) AS norm2, len(embedding) AS dim, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def array_functions(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    norm = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(norm, 4).alias("norm2"), F.size("embedding").cast("long").alias("dim"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


# Labels.


@query("WITH " + FLOWS + " SELECT event_id, raw_label, CAST(y AS INTEGER) AS y FROM decided")
def label_strip_decide(spark, sf_dir):
    return decided(spark, sf_dir).select("event_id", "raw_label", "y")


@query("WITH " + FLOWS + " SELECT event_id, CAST(y AS INTEGER) AS y FROM decided WHERE y <> 255")
def scope_filter(spark, sf_dir):
    return labels.in_scope(decided(spark, sf_dir)).select("event_id", "y")


@query("WITH " + FLOWS + " SELECT file, raw_label, count(*) AS n FROM decided GROUP BY GROUPING SETS ((file, raw_label), (raw_label))")
def label_counts_rollup(spark, sf_dir):
    return labels.label_counts(flows(spark, sf_dir), "file", "label")


@query("WITH " + FLOWS + " SELECT file, count(*) FILTER (WHERE raw_label = 'purchase') AS purchase, count(*) FILTER (WHERE raw_label = 'view') AS \"view\", count(*) FILTER (WHERE raw_label = 'click') AS click, count(*) AS n_rows FROM decided GROUP BY file")
def label_counts_by_file(spark, sf_dir):
    return labels.label_crosstab(flows(spark, sf_dir), "file", "label", {"purchase": "purchase", "view": "view", "click": "click"})


@query("WITH " + FLOWS + " SELECT count(*) FILTER (WHERE y = 0) AS n_benign, count(*) FILTER (WHERE y = 1) AS n_attack, count(*) FILTER (WHERE y = 255) AS n_dropped FROM decided")
def binary_counts(spark, sf_dir):
    return labels.binary_counts(decided(spark, sf_dir))


@query("WITH " + FLOWS + " SELECT DISTINCT raw_label FROM decided WHERE raw_label NOT IN ('purchase', 'view', 'click', 'signup')")
def unknown_labels(spark, sf_dir):
    return labels.unknown_labels(flows(spark, sf_dir), "label", labels.decision_table(spark, BENIGN, ATTACK, DROPPED))


# Profiles. events have no gaps, so both languages put in null, NaN and infinity.


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    v = F.when(i % 17 == 0, None).when(i % 19 == 0, float("nan")).when(i % 23 == 0, float("inf")).when(i % 31 == 0, float("-inf")).otherwise(F.col("value"))
    return e.select("event_id", v.alias("value"), F.when(i % 5 != 0, F.col("user_id")).alias("user_id"), F.when(i % 7 != 0, F.col("event_type")).alias("event_type"))


GAPPY = """gappy AS (
    SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 23 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 31 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS value,
        CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type
    FROM events
)"""
_PROFILE = """profile AS (
    SELECT 'event_id' AS "column", 'bigint' AS dtype, count(*) AS n_rows, count(*) - count(event_id) AS n_null, 0 AS n_nan, 0 AS n_inf, NULL::DOUBLE AS "min", NULL::DOUBLE AS "max" FROM gappy
    UNION ALL SELECT 'value', 'double', count(*), count(*) - count(value), count(*) FILTER (WHERE isnan(value)), count(*) FILTER (WHERE isinf(value)), min(value) FILTER (WHERE isfinite(value)), max(value) FILTER (WHERE isfinite(value)) FROM gappy
    UNION ALL SELECT 'user_id', 'bigint', count(*), count(*) - count(user_id), 0, 0, NULL, NULL FROM gappy
    UNION ALL SELECT 'event_type', 'string', count(*), count(*) - count(event_type), 0, 0, NULL, NULL FROM gappy
), full_profile AS (
    SELECT "column", dtype, n_rows, n_null, CAST(n_nan AS BIGINT) AS n_nan, CAST(n_inf AS BIGINT) AS n_inf, CAST(n_null + n_nan + n_inf AS BIGINT) AS n_missing,
        round((n_null + n_nan + n_inf) / greatest(n_rows, 1), 6) AS missing_ratio, round(n_inf / greatest(n_rows, 1), 6) AS inf_ratio, "min", "max"
    FROM profile
)"""
_COLUMNS = ["event_id", "value", "user_id", "event_type"]


@query(f"WITH {GAPPY}, {_PROFILE} SELECT * FROM full_profile")
def profile_columns(spark, sf_dir):
    return profile.column_profile(gappy(spark, sf_dir), _COLUMNS)


@query(f'WITH {GAPPY}, {_PROFILE} SELECT * FROM full_profile ORDER BY missing_ratio DESC, "column" LIMIT 2')
def profile_worst(spark, sf_dir):
    return profile.worst_columns(profile.column_profile(gappy(spark, sf_dir), _COLUMNS), 2)


@query(f"WITH {GAPPY}, {_PROFILE} SELECT * FROM full_profile WHERE missing_ratio > 0 OR dtype = 'string'")
def profile_shown(spark, sf_dir):
    return profile.shown_columns(profile.column_profile(gappy(spark, sf_dir), _COLUMNS))


@query("SELECT 'user_id' AS \"column\", least(count(DISTINCT user_id), 100) AS n_distinct, CASE WHEN count(DISTINCT user_id) > 100 THEN 'capped_at_100' ELSE CAST(count(DISTINCT user_id) AS VARCHAR) END AS shown FROM events UNION ALL SELECT 'event_type', least(count(DISTINCT event_type), 100), CAST(count(DISTINCT event_type) AS VARCHAR) FROM events")
def distinct_capped(spark, sf_dir):
    return profile.distinct_capped(read(spark, sf_dir, "events"), ["user_id", "event_type"], 100).withColumn("n_distinct", F.col("n_distinct").cast("long"))


@query("SELECT min(strftime(ts, '%d/%m/%Y %H:%M')) AS first_text, max(strftime(ts, '%d/%m/%Y %H:%M')) AS last_text, min(ts) AS first_time, max(ts) AS last_time FROM events")
def ts_range_lexical_and_parsed(spark, sf_dir):
    return profile.time_range(read(spark, sf_dir, "events"), F.date_format("ts", "dd/MM/yyyy HH:mm"), F.col("ts"))


@query("SELECT count(*) AS n_rows, CAST(count(*) * 5 * 4 AS BIGINT) AS matrix_bytes FROM lineitem")
def size_estimate(spark, sf_dir):
    return profile.size_estimate(read(spark, sf_dir, "lineitem"), 5)


@query(
    """WITH head AS (SELECT event_id, user_id, value, event_type FROM events WHERE xor(event_id, 5) < 20000),
    steps AS (SELECT event_id - lag(event_id) OVER (ORDER BY event_id) AS d1, user_id - lag(user_id) OVER (ORDER BY user_id) AS d2 FROM head),
    sums AS (
        SELECT 'event_id' AS "column", count(event_id) AS n, count(DISTINCT event_id) AS n_distinct, (SELECT CASE WHEN count(DISTINCT d1) = 1 THEN max(d1) END FROM steps) AS step, 'i' AS kind FROM head
        UNION ALL SELECT 'user_id', count(user_id), count(DISTINCT user_id), (SELECT CASE WHEN count(DISTINCT d2) = 1 THEN max(d2) END FROM steps), 'i' FROM head
        UNION ALL SELECT 'value', count(value), count(DISTINCT value), NULL, 'f' FROM head
        UNION ALL SELECT 'event_type', count(event_type), count(DISTINCT event_type), NULL, 's' FROM head)
    SELECT "column", n, n_distinct, CASE WHEN n = n_distinct THEN step END AS step, CASE WHEN n < 1000 OR n <> n_distinct THEN 'ok' WHEN kind = 's' OR step IS NOT NULL THEN 'error' WHEN kind = 'f' THEN 'note' ELSE 'ok' END AS verdict FROM sums"""
)
def identifier_detection(spark, sf_dir):
    """Rows stand in another order than their ids, which are a run all the same."""
    return profile.identifier_columns(read(spark, sf_dir, "events"), ["event_id", "user_id", "value", "event_type"], F.col("event_id").bitwiseXOR(F.lit(5)))


@query("WITH " + FLOWS + """, marked AS (SELECT file, strftime(date_trunc('day', e.ts), '%Y-%m-%d') AS day, upper(regexp_replace(CASE WHEN raw_label = 'purchase' THEN ' benign ' ELSE raw_label END, '@ENDS', '', 'g')) IN ('BENIGN', 'NORMAL') AS benign FROM decided d JOIN events e USING (event_id))
    SELECT 'file' AS level, file AS name, count(*) FILTER (WHERE benign) AS n_benign, count(*) FILTER (WHERE NOT benign) AS n_attack, count(*) FILTER (WHERE benign) = 0 AS no_benign FROM marked GROUP BY file
    UNION ALL SELECT 'day', day, count(*) FILTER (WHERE benign), count(*) FILTER (WHERE NOT benign), count(*) FILTER (WHERE benign) = 0 FROM marked GROUP BY day""".replace("@ENDS", ENDS))
def benign_map(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "purchase", " benign ").otherwise(F.col("event_type"))
    return profile.benign_map(e, (F.col("user_id") % 6).cast("string"), F.date_format("ts", "yyyy-MM-dd"), label)


_MINUTES = """minutes AS (SELECT CAST(user_id % 6 AS VARCHAR) AS file, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2),
    shares AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY file) AS share FROM minutes),
    slices AS (SELECT file, minute, n, CASE WHEN share < 0.7::DOUBLE THEN 'train' WHEN share < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS slice FROM shares)"""


@query(f"WITH {_MINUTES} SELECT file, minute, n, slice FROM slices")
def minute_histogram_slices(spark, sf_dir):
    return profile.minute_slices(read(spark, sf_dir, "events"), (F.col("user_id") % 6).cast("string"), "ts")


@query(f"WITH {_MINUTES} SELECT slice, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_minutes, count(DISTINCT file) AS n_files FROM slices GROUP BY slice")
def minute_slice_totals(spark, sf_dir):
    return profile.slice_totals(minute_histogram_slices(spark, sf_dir))


@query("SELECT file, count(*) AS n, bool_and(ok) AS monotonic FROM (SELECT CAST(user_id % 6 AS VARCHAR) AS file, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id % 6 ORDER BY event_id), true) AS ok FROM events) GROUP BY file")
def monotonic_in_row_order(spark, sf_dir):
    return profile.monotonic(read(spark, sf_dir, "events"), (F.col("user_id") % 6).cast("string"), "event_id", "ts")


@query("SELECT file, n, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS \"end\", CAST(sum(n) OVER (ORDER BY file) - n AS BIGINT) AS begin FROM (SELECT CAST(user_id % 6 AS VARCHAR) AS file, count(*) AS n FROM events GROUP BY 1)")
def file_offsets(spark, sf_dir):
    return profile.file_offsets(flows(spark, sf_dir), "file")


# Duplicates and leakage.


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents")
def dedup_first_occurrence(spark, sf_dir):
    return dedup.first_occurrences(read(spark, sf_dir, "documents"), ["text"], ["doc_id"], ["doc_id"])


@query("SELECT text, count(*) AS n, 1::BIGINT AS n_first FROM documents GROUP BY text")
def dedup_ties(spark, sf_dir):
    """Without an order that tells rows apart, one of each group of twins is first all the same."""
    first = dedup.first_occurrences(read(spark, sf_dir, "documents").withColumn("same", F.lit(1)), ["text"], ["same"], ["text"])
    return first.groupBy("text").agg(F.count("*").alias("n"), F.count_if("is_first").alias("n_first"))


@query("SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates, max(c) AS largest_group FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)")
def dedup_counts(spark, sf_dir):
    return dedup.duplicate_counts(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


_TWINS = ["l_quantity", "l_discount", "l_linestatus"]
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate"]


@query(
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_returnflag, l_shipdate) AS r FROM lineitem)
    SELECT l_returnflag, count(*) AS n_kept FROM ranked WHERE r = 1 AND l_returnflag <> 'N' GROUP BY 1"""
)
def dedup_then_scope(spark, sf_dir):
    """Duplicates go before scope is looked at: an out-of-scope row can be the first of its twins."""
    first = dedup.first_occurrences(read(spark, sf_dir, "lineitem"), _TWINS, _ORDER, ["l_returnflag"]).where("is_first")
    return first.where("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.count("*").alias("n_kept"))


@query(
    """WITH g AS (SELECT text, count(*) AS c, min(doc_id % 3) AS lo, max(doc_id % 3) AS hi FROM documents GROUP BY text)
    SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(coalesce(sum(c) FILTER (WHERE lo <> hi), 0) AS BIGINT) AS cross_rows, count(*) FILTER (WHERE lo <> hi) AS cross_groups, round(sum(c)::DOUBLE * sum(c) / pow(2, 65), 12) AS expected_hash_collisions FROM g"""
)
def leakage_cross_split(spark, sf_dir):
    return dedup.leakage(read(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 3), ["text"])


def _draw(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _pick(u: str) -> str:
    return f"CASE WHEN {u} < 0.7::DOUBLE THEN 0 WHEN {u} < 0.7::DOUBLE + 0.15::DOUBLE THEN 1 ELSE 2 END"


_UPSAMPLED = (
    "WITH "
    + FLOWS
    + f""", scoped AS (SELECT event_id, y FROM decided WHERE y <> 255),
    copies AS (SELECT greatest(CAST(round_even(count(*) FILTER (WHERE y = 1) / nullif(count(*) FILTER (WHERE y = 0), 0), 0) AS BIGINT), 1) AS k FROM scoped),
    own AS (SELECT event_id, y, {_pick(_draw("'5|' || event_id"))} AS split FROM scoped),
    extra AS (SELECT event_id, bit_or(1 << ({_pick(_draw("'5|' || event_id || '|' || i"))})) AS bits FROM (SELECT event_id, unnest(range(1, k)) AS i FROM scoped, copies WHERE y = 0) GROUP BY event_id),
    up AS (SELECT event_id, split, coalesce(bits, 0) & ~(1 << split) AS also_in FROM own LEFT JOIN extra USING (event_id)),
    members AS (SELECT *, split = 0 OR (also_in & 1) > 0 AS a, split = 1 OR (also_in & 2) > 0 AS b, split = 2 OR (also_in & 4) > 0 AS c FROM up)"""
)


def _upsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.upsampled(labels.in_scope(decided(spark, sf_dir)), "y", "event_id", 5)


@query(_UPSAMPLED + " SELECT event_id, split, CAST(also_in AS INTEGER) AS also_in FROM up")
def upsample_before_split(spark, sf_dir):
    return _upsampled(spark, sf_dir).select("event_id", "split", "also_in")


@query(_UPSAMPLED + " SELECT count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS val_test, count(*) FILTER (WHERE (a AND b) OR (a AND c) OR (b AND c)) AS any_two FROM members")
def leakage_paperlike(spark, sf_dir):
    return splits.bitmask_leakage(_upsampled(spark, sf_dir))


# Splits and samples.


@query(SPLIT + " " + SUMMARY.format("split"))
def split_temporal_stratified(spark, sf_dir):
    return splits.summary(stratified(spark, sf_dir))


@query(SPLIT + " SELECT event_id, split FROM split")
def split_assignment(spark, sf_dir):
    return stratified(spark, sf_dir).select("event_id", "split")


@query(
    "WITH " + FLOWS + """, r AS (SELECT event_id, row_number() OVER (PARTITION BY file ORDER BY ts ASC NULLS FIRST, event_id) AS r, count(*) OVER (PARTITION BY file) AS n FROM flows)
    SELECT event_id, CASE WHEN r <= round_even(n * 0.7::DOUBLE, 0) THEN 0 WHEN r <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 1 ELSE 2 END AS split FROM r"""
)
def split_temporal_within_file(spark, sf_dir):
    return splits.temporal_within_file(flows(spark, sf_dir), "file", "ts", "event_id").select("event_id", "split")


@query(
    """WITH days AS (SELECT *, l_linestatus = 'O' AS test FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, test ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS r, count(*) OVER (PARTITION BY l_returnflag, test) AS n FROM days),
    s AS (SELECT *, CASE WHEN test THEN 2 WHEN r <= round_even(n * (0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)), 0) THEN 0 ELSE 1 END AS split FROM r)
    SELECT split, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM s GROUP BY ALL"""
)
def split_by_capture_day(spark, sf_dir):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    out = splits.by_capture_day(read(spark, sf_dir, "lineitem"), "l_linestatus", "O", ["l_returnflag"], order)
    return out.groupBy("split", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """WITH RECURSIVE sizes AS (SELECT *, row_number() OVER (ORDER BY n DESC, file DESC) AS k, sum(n) OVER () AS total FROM (SELECT CAST(user_id % 6 AS VARCHAR) AS file, count(*) AS n FROM events GROUP BY 1)),
    needs AS (SELECT *, total * 0.7::DOUBLE AS w0, total * 0.15::DOUBLE AS w1, total * (1 - 0.7::DOUBLE - 0.15::DOUBLE) AS w2 FROM sizes),
    walk AS (
        SELECT 0::BIGINT AS k, ''::VARCHAR AS file, 0 AS split, 0::DOUBLE AS g0, 0::DOUBLE AS g1, 0::DOUBLE AS g2
        UNION ALL
        SELECT k, file, s, g0 + CASE WHEN s = 0 THEN n ELSE 0 END, g1 + CASE WHEN s = 1 THEN n ELSE 0 END, g2 + CASE WHEN s = 2 THEN n ELSE 0 END
        FROM (SELECT d.k, d.file, d.n, w.g0, w.g1, w.g2, CASE WHEN w0 - g0 >= w1 - g1 AND w0 - g0 >= w2 - g2 THEN 0 WHEN w1 - g1 >= w2 - g2 THEN 1 ELSE 2 END AS s FROM walk w JOIN needs d ON d.k = w.k + 1)
    )
    SELECT file, split FROM walk WHERE k > 0"""
)
def split_group_by_file(spark, sf_dir):
    return splits.group_by_file(flows(spark, sf_dir), "file").select("file", "split").distinct()


@query(
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('11|' || event_id), event_id) AS r, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN r <= round_even(n * 0.7::DOUBLE, 0) THEN 0 WHEN r <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 1 ELSE 2 END AS split FROM r"""
)
def split_random_md5(spark, sf_dir):
    return splits.random_cut(read(spark, sf_dir, "events").select("event_id"), "event_id", 11).select("event_id", "split")


_THINNED = (
    SPLIT
    + """, sums AS (SELECT split, count(*) FILTER (WHERE y = 0) AS b, count(*) FILTER (WHERE y = 1) AS a FROM split GROUP BY split),
    rates AS (SELECT split, CASE WHEN split IN (0, 1) AND a > b * 1.5::DOUBLE THEN b * 1.5::DOUBLE / a END AS rate FROM sums),
    rr AS (SELECT s.*, rate, row_number() OVER (PARTITION BY s.split, y, file, raw_label ORDER BY md5('3|' || event_id), event_id) AS k, count(*) OVER (PARTITION BY s.split, y, file, raw_label) AS m FROM split s JOIN rates USING (split)),
    thinned AS (SELECT * REPLACE (CASE WHEN rate IS NOT NULL AND y = 1 AND k > least(m, greatest(1, round_even(m * rate, 0))) THEN -2 ELSE split END AS split) FROM rr)"""
)


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.thin_attacks(stratified(spark, sf_dir), ["file", "raw_label"], "event_id", 3, 1.5)


@query(_THINNED + " SELECT event_id, split FROM thinned")
def subsample_keep_benign(spark, sf_dir):
    return _thinned(spark, sf_dir).select("event_id", "split")


PREPARED = (
    _THINNED.replace(", ranked AS (", ", firsts AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY value ORDER BY file, event_id) = 1), ranked AS (", 1)
    .replace("FROM decided WHERE", "FROM firsts WHERE")
    .replace("md5('3|' || event_id), event_id", "md5('0|' || file || '|' || event_id), file || '|' || event_id")
)
ROLES = prepare.Roles("label", "file", "event_id", "ts", ["user_id", "ts"], BENIGN, ATTACK, DROPPED)


@query(PREPARED + " SELECT file, event_id, raw_label, y, split FROM thinned")
def prepared_split(spark, sf_dir):
    """The split as the preparation writes it: of the rows in scope that no earlier one repeats, thinned."""
    return prepare.indexed(flows(spark, sf_dir), ROLES, 1.5).cut("raw_label", "y", "split").select("file", "event_id", "raw_label", "y", "split")


@query(_THINNED + " " + SUMMARY.format("thinned"))
def split_summary(spark, sf_dir):
    return splits.summary(_thinned(spark, sf_dir))


@query(
    _THINNED
    + """ SELECT raw_label AS label, count(*) FILTER (WHERE split = 0) AS train, count(*) FILTER (WHERE split = 1) AS val, count(*) FILTER (WHERE split = 2) AS test, count(*) FILTER (WHERE split < 0) AS dropped, count(*) AS total,
    count(*) FILTER (WHERE split = 0) = 0 AND count(*) FILTER (WHERE split IN (1, 2)) > 0 AS untrained FROM thinned GROUP BY 1"""
)
def family_coverage(spark, sf_dir):
    return splits.family_coverage(_thinned(spark, sf_dir), "raw_label")


@query(
    _THINNED
    + """, sm AS (SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE y = 0) AS n_benign FROM thinned GROUP BY split)
    SELECT name, coalesce(n_rows, 0) AS n_rows, coalesce(n_benign, 0) AS n_benign, CASE WHEN coalesce(n_rows, 0) = 0 THEN 'empty' WHEN n_benign = 0 THEN 'no benign' WHEN n_benign < 400 THEN 'few benign' ELSE 'ok' END AS problem
    FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) v(split, name) LEFT JOIN sm USING (split)"""
)
def split_health(spark, sf_dir):
    return splits.health(splits.summary(_thinned(spark, sf_dir)), 400)


@query(
    """WITH j AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('9|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n, count(*) OVER () AS total FROM j)
    SELECT doc_id, quality FROM r WHERE total <= 100 OR r <= least(n, greatest(1, round_even(100 * n / total, 0)))"""
)
def stratified_sample(spark, sf_dir):
    j = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id")
    return sampling.stratified_sample(j, "quality", "doc_id", 9, 100).select("doc_id", "quality")


@query("SELECT vec_id FROM embeddings ORDER BY md5('4|' || vec_id), vec_id LIMIT 200")
def plain_sample(spark, sf_dir):
    return sampling.plain_sample(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 4, 200)


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY md5('1|2|' || event_id), event_id) - 1) / 512) AS BIGINT) AS batch FROM events")
def minibatch_order(spark, sf_dir):
    return sampling.batches(read(spark, sf_dir, "events").select("event_id"), "event_id", 1, 2, 512).select("event_id", "batch")


# Fitting and transforming.

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _gappy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", F.when(k % 13 == 0, float("nan")).when(k % 17 == 0, float("inf")).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", F.when(k % 3 != 0, None).otherwise(F.col("l_discount")).alias("l_discount"), F.lit(1.5).alias("l_tax"))


_ITEMS = """items AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 OR (l_orderkey + l_linenumber) % 17 = 0 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_discount END AS d, 1.5::DOUBLE AS t FROM lineitem),
    filled AS (SELECT *, coalesce(q, (SELECT median(q) FROM items)) AS fq, coalesce(p, (SELECT median(p) FROM items)) AS fp, coalesce(d, (SELECT median(d) FROM items)) AS fd FROM items)"""


def _fit_row(name: str, raw: str, full: str, verdict: str) -> str:
    return f"SELECT '{name}' AS \"column\", round(1 - count({raw}) / count(*), 6) AS missing_ratio, round(median({raw}), 6) AS median, round(avg({full}), 6) AS mean, round(CASE WHEN min({full}) = max({full}) THEN 1.0 ELSE stddev_pop({full}) END, 6) AS std, '{verdict}' AS verdict FROM filled"


@query(f"WITH {_ITEMS} {_fit_row('l_quantity', 'q', 'fq', 'kept')} UNION ALL {_fit_row('l_extendedprice', 'p', 'fp', 'kept')} UNION ALL {_fit_row('l_discount', 'd', 'fd', 'high_missing')} UNION ALL {_fit_row('l_tax', 't', 't', 'zero_variance')}")
def fit_missing_median_var(spark, sf_dir):
    fitted = prep.fit(_gappy_items(spark, sf_dir), _FEATURES)
    return fitted.select("column", *[F.round(c, 6).alias(c) for c in ("missing_ratio", "median", "mean", "std")], "verdict")


@query(f"WITH {_ITEMS} SELECT l_orderkey, l_linenumber, round((fq - (SELECT avg(fq) FROM filled)) / (SELECT stddev_pop(fq) FROM filled), 5) AS l_quantity, round((fp - (SELECT avg(fp) FROM filled)) / (SELECT stddev_pop(fp) FROM filled), 5) AS l_extendedprice FROM filled")
def transform_standardised(spark, sf_dir):
    items = _gappy_items(spark, sf_dir)
    out = prep.standardised(items, _FEATURES, prep.fit(items, _FEATURES).collect())  # a row a feature
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_extendedprice", 5).alias("l_extendedprice"))


@query("SELECT label, round(avg(embedding[1]), 6) AS mean, round(stddev_pop(embedding[1]), 6) AS std FROM embeddings GROUP BY label")
def fit_scaler(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding")[0].cast("double"))
    return e.groupBy("label").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("SELECT c AS \"column\", CAST(i AS INTEGER) AS step, i / 20 AS q, round(v, 6) AS value FROM (SELECT 'l_quantity' AS c, unnest(quantile_cont(l_quantity, [" + ", ".join(f"{i / 20}" for i in range(21)) + "])) AS v, unnest(range(21)) AS i FROM lineitem UNION ALL SELECT 'l_extendedprice', unnest(quantile_cont(l_extendedprice, [" + ", ".join(f"{i / 20}" for i in range(21)) + "])), unnest(range(21)) FROM lineitem)")
def quantile_grid(spark, sf_dir):
    return prep.quantiles(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 20).select("column", "step", "q", F.round("value", 6).alias("value"))


@query()
def quantile_normal_scores(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    grid = [r["value"] for r in prep.quantiles(li, ["l_extendedprice"], 100).orderBy("step").collect()]  # 101 rows
    return li.select("l_orderkey", "l_linenumber", F.round(prep.quantile_normal(F.col("l_extendedprice"), grid), 6).alias("z"))


# Scores: quality labels against a function of the documents' lengths.


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 2)
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score")).join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_SCORED = "scored AS (SELECT doc_id, round(n_chars / (n_chars + 1500.0::DOUBLE), 2) AS score, quality AS y FROM documents JOIN labels USING (doc_id))"
_COUNTS = _SCORED + ", counts AS (SELECT count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM scored)"
_METRICS = _COUNTS + """, m AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1_, 2 * tn / (2 * tn + fn + fp) AS f0_ FROM counts), metrics AS (SELECT tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(tp / (tp + fp), 9) AS precision,
    round(tp / (tp + fn), 9) AS recall, round(f1_, 9) AS f1, round((f1_ + f0_) / 2, 9) AS macro_f1, round(((tp + fn) * f1_ + (tn + fp) * f0_) / (tn + fp + fn + tp), 9) AS weighted_f1, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc,
    round(tn / (tn + fp), 9) AS specificity, round(fp / (tn + fp), 9) AS fpr, round(fn / (tp + fn), 9) AS fnr, round((tp + fn) / (tn + fp + fn + tp), 9) AS always_attack_accuracy, round((tp + fn) / (tn + fp), 9) AS attack_per_benign FROM m)"""
_STEPS = _SCORED + ", s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY score), steps AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM s)"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), "y", "score")


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def metrics_full(spark, sf_dir):
    return metrics.metrics(_confusion(spark, sf_dir))


@query(f"WITH {_METRICS} UNPIVOT (SELECT accuracy, precision, recall, f1, mcc FROM metrics) ON COLUMNS(*) INTO NAME metric VALUE value")
def metric_rows(spark, sf_dir):
    return metrics.metric_rows(metrics.metrics(_confusion(spark, sf_dir)), ["accuracy", "precision", "recall", "f1", "mcc"])


@query(f"WITH {_COUNTS} SELECT 'benign' AS class, round(tn / (tn + fn), 9) AS precision, round(tn / (tn + fp), 9) AS recall, round(2 * tn / (2 * tn + fn + fp), 9) AS f1, tn + fp AS support FROM counts UNION ALL SELECT 'attack', round(tp / (tp + fp), 9), round(tp / (tp + fn), 9), round(2 * tp / (2 * tp + fp + fn), 9), tp + fn FROM counts")
def per_class(spark, sf_dir):
    return metrics.per_class(_confusion(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT 'benign' AS truth, round(tn / greatest(tn + fp, 1), 9) AS said_benign, round(fp / greatest(tn + fp, 1), 9) AS said_attack FROM counts UNION ALL SELECT 'attack', round(fn / greatest(fn + tp, 1), 9), round(tp / greatest(fn + tp, 1), 9) FROM counts")
def confusion_norm(spark, sf_dir):
    return metrics.normalised_confusion(_confusion(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_steps(_scored(spark, sf_dir), "y", "score")


@query(
    f"WITH {_STEPS}, n AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn FROM steps) SELECT 'Infinity'::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL SELECT score, round(fp / an, 9), round(tp / ap, 9) FROM n WHERE np IS NULL OR np <> pos OR nn <> neg"
)
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(_steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT round(sum(neg * (tp - pos / 2)) / max(ap * an), 9) AS roc_auc FROM steps")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT score AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / ap, 9) AS recall FROM steps UNION ALL SELECT NULL, 1, 0")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(_steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT round(sum(pos * tp / (tp + fp)) / max(ap), 9) AS average_precision FROM steps")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_steps(spark, sf_dir))


@query(f"WITH {_SCORED} SELECT round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(score, 1e-7), 1 - 1e-7) ELSE 1 - least(greatest(score, 1e-7), 1 - 1e-7) END)), 9) AS log_loss FROM scored")
def log_loss(spark, sf_dir):
    return metrics.log_loss(_scored(spark, sf_dir), "y", "score")


@query(f"WITH {_SCORED}, l AS (SELECT y, 4 * score - 2 AS z FROM scored), x AS (SELECT greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) AS loss FROM l) SELECT round(avg(loss), 9) AS mean_loss, round(sum(loss), 6) AS sum_loss FROM x")
def logit_loss(spark, sf_dir):
    return metrics.logit_loss(_scored(spark, sf_dir).withColumn("z", 4 * F.col("score") - 2), "y", "z")


_PUBLISHED = {"accuracy": (0.9995, 0.95), "precision": (0.9, None), "recall": (None, 0.8), "absent": (0.5, 0.5)}


@query(f"""WITH {_METRICS}, r AS (UNPIVOT (SELECT accuracy, precision, recall FROM metrics) ON COLUMNS(*) INTO NAME metric VALUE value)
    SELECT metric, round(value, 6) AS value, headline, body, round(value - headline, 6) AS d_headline, round(value - body, 6) AS d_body
    FROM (VALUES ('accuracy', 0.9995::DOUBLE, 0.95::DOUBLE), ('precision', 0.9, NULL), ('recall', NULL, 0.8), ('absent', 0.5, 0.5)) p(metric, headline, body) LEFT JOIN r USING (metric)""")
def metric_deltas(spark, sf_dir):
    return metrics.metric_deltas(metric_rows(spark, sf_dir), _PUBLISHED)


# The data of figures.


@query(SQL["metric_deltas"].replace("    SELECT metric, round(value, 6)", "    , d AS (SELECT metric, round(value, 6)") + """)
    SELECT metric, value AS ours, headline AS paper_headline, body AS paper_body, least(value, headline, body) AS low, greatest(value, headline, body) AS high FROM d WHERE value IS NOT NULL AND coalesce(headline, body) IS NOT NULL""")
def figure_comparison(spark, sf_dir):
    return figures.comparison(metric_deltas(spark, sf_dir))


@query(PREPARED + " SELECT name AS split, count(y) FILTER (WHERE y = 0) AS benign, count(y) FILTER (WHERE y = 1) AS attack FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) v(code, name) LEFT JOIN thinned ON split = code GROUP BY name")
def figure_class_distribution(spark, sf_dir):
    return figures.class_distribution(prepare.indexed(flows(spark, sf_dir), ROLES, 1.5).index)


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(4096 / (quantile_cont(value, 0.5) / 1000), 3) AS rows_per_s FROM events")
def latency_percentiles(spark, sf_dir):
    return metrics.latency(read(spark, sf_dir, "events"), "value", 4096)


# Rankings over the embeddings' 64 components.

_RANKED = """v AS (SELECT 'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, embedding[i]::DOUBLE AS value FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings)),
    imp AS (SELECT feature, round(avg(abs(value)), 9) AS mean_abs, round(avg(value), 9) AS mean FROM v GROUP BY feature),
    ranked AS (SELECT *, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank, round(mean_abs / sum(mean_abs) OVER (), 9) AS share, round(sum(mean_abs) OVER (ORDER BY mean_abs DESC, feature ROWS UNBOUNDED PRECEDING) / sum(mean_abs) OVER (), 9) AS cumulative FROM imp)"""


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ranking.importance(ranking.long_form(read(spark, sf_dir, "embeddings"), "embedding")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SHOWN = "SELECT feature, round(mean_abs, 6) AS mean_abs, round(mean, 6) AS mean, rank, round(share, 6) AS share, round(cumulative, 6) AS cumulative FROM ranked"


@query(f"WITH {_RANKED} {_SHOWN}")
def rank_cumulative(spark, sf_dir):
    return _rounded(_ranking(spark, sf_dir))


@query(f"WITH {_RANKED} {_SHOWN} ORDER BY rank LIMIT 20")
def top_k(spark, sf_dir):
    return _rounded(ranking.selected(_ranking(spark, sf_dir), "top20", 5))


@query(f"WITH {_RANKED} {_SHOWN} WHERE cumulative <= 0.5 OR rank = 1")
def cumulative_ratio(spark, sf_dir):
    return _rounded(ranking.selected(_ranking(spark, sf_dir), "cumulative", threshold=0.5))


_FOLD = """w AS (SELECT feature, mean AS value, row_number() OVER (ORDER BY abs(mean) DESC, feature) AS place, count(*) OVER () AS n FROM ranked),
    fall AS (SELECT least(place, 10) AS place, CASE WHEN place >= 10 THEN CAST(n - 9 AS VARCHAR) || ' other features' ELSE feature END AS feature, round(sum(value), 6) AS value FROM w GROUP BY ALL)"""


@query(f"WITH {_RANKED}, {_FOLD} SELECT * FROM fall")
def waterfall_fold(spark, sf_dir):
    means = _ranking(spark, sf_dir).select("feature", F.col("mean").alias("value"))
    return ranking.waterfall(means, 10).select("place", "feature", F.round("value", 6).alias("value"))


@query("SELECT key, round(value, 6) AS value, round(median, 6) AS median FROM (SELECT vec_id AS key, embedding[1]::DOUBLE AS value, (SELECT median(embedding[1]::DOUBLE) FROM embeddings) AS median FROM embeddings) ORDER BY abs(value - median), key LIMIT 1")
def representative_instance(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding")[0].cast("double"))
    return _rounded(ranking.representative(e, "x", "vec_id"))


@query(f"WITH {_RANKED}, {_FOLD} SELECT p.feature, published_rank, r.rank AS our_rank, r.rank IS NOT NULL AS ranked, EXISTS (SELECT 1 FROM fall f WHERE f.feature = p.feature) AS in_waterfall FROM (VALUES ('f03', 1::BIGINT), ('f10', 2), ('absent', 3), ('f63', 4)) p(feature, published_rank) LEFT JOIN ranked r USING (feature)")
def compare_reference_left(spark, sf_dir):
    published = spark.createDataFrame([("f03", 1), ("f10", 2), ("absent", 3), ("f63", 4)], "feature string, published_rank long")
    r = _ranking(spark, sf_dir)
    return ranking.compared_with_list(published, r, ranking.waterfall(r.select("feature", F.col("mean").alias("value")), 10))


@query(
    f"""WITH {_RANKED}, by_mean AS (SELECT feature, row_number() OVER (ORDER BY abs(mean) DESC, feature) AS rank FROM imp), few AS (SELECT feature, rank FROM by_mean WHERE rank <= 10)
    SELECT feature, b.rank AS rank_base, m.rank AS rank_mean, f.rank AS rank_few, greatest(b.rank, m.rank, f.rank) - least(b.rank, m.rank, f.rank) AS spread FROM ranked b LEFT JOIN by_mean m USING (feature) LEFT JOIN few f USING (feature)"""
)
def compare_rankings(spark, sf_dir):
    r = _ranking(spark, sf_dir)
    by_mean = ranking.ranked(r.select("feature", F.abs("mean").alias("size")), "size")
    return ranking.compared_rankings(r, {"mean": by_mean, "few": by_mean.where("rank <= 10")})


# Monitors: days of events stand for epochs.

_HISTORY = """h AS (SELECT CAST(date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) AS BIGINT) AS epoch, count(*) AS n, count(*) % 3 AS session_id FROM events GROUP BY 1)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    first = e.agg(F.to_date(F.min("ts")).alias("__first"))
    day = F.datediff(F.to_date("ts"), F.col("__first")).cast("long")
    return e.join(F.broadcast(first)).groupBy(day.alias("epoch")).agg(F.count("*").alias("n"), (F.count("*") % 3).alias("session_id"))


@query(f"WITH {_HISTORY}, l AS (SELECT epoch, session_id, lag(session_id) OVER (ORDER BY epoch) AS previous_session FROM h) SELECT * FROM l WHERE previous_session <> session_id")
def session_boundaries(spark, sf_dir):
    return monitor.session_boundaries(_history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT epoch, n AS value, max(n) OVER (ORDER BY epoch) AS best_so_far, coalesce(session_id <> lag(session_id) OVER (ORDER BY epoch), false) AS resumed FROM h")
def figure_training_curve(spark, sf_dir):
    return figures.training_curve(_history(spark, sf_dir), "n")


@query(f"WITH {_HISTORY} SELECT epoch, n, session_id, max(n) OVER (ORDER BY epoch) AS best_so_far, coalesce(n > max(n) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM h")
def running_best(spark, sf_dir):
    return monitor.running_best(_history(spark, sf_dir), "n", "epoch")


@query(f"WITH {_HISTORY} SELECT epoch, n FROM h ORDER BY n DESC, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    return monitor.best_record(_history(spark, sf_dir), "n", "epoch")


@query(
    """WITH p AS (SELECT event_id AS position, user_id % 40 AS epoch FROM events), seen AS (SELECT epoch, count(*) AS n FROM p GROUP BY epoch)
    SELECT 'duplicate' AS problem, epoch FROM seen WHERE n > 1 UNION ALL SELECT 'missing', i FROM range(1, 51) r(i) WHERE i NOT IN (SELECT epoch FROM seen)
    UNION ALL SELECT 'out_of_range', epoch FROM seen WHERE epoch < 1 OR epoch > 50 UNION ALL SELECT 'out_of_order', epoch FROM (SELECT epoch, lag(epoch) OVER (ORDER BY position) AS b FROM p) WHERE epoch < b"""
)
def history_validation(spark, sf_dir):
    p = read(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("user_id") % 40).alias("epoch"))
    return monitor.history_problems(p, 50)


@query(
    """WITH log AS (SELECT event_id AS recorded, CASE WHEN event_type IN ('view', 'click') THEN 'train' ELSE event_type END AS phase, value::BIGINT AS end_epoch FROM events),
    m AS (SELECT *, lag(end_epoch) OVER (ORDER BY recorded) AS b FROM log WHERE phase IN ('train', 'error')), f AS (SELECT *, b IS NULL OR end_epoch > b AS adv FROM m ORDER BY recorded DESC LIMIT 2)
    SELECT count(*) AS n, count(*) = 2 AND NOT coalesce(bool_or(adv), false) AS stalled FROM f"""
)
def stall_detection(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("recorded"), F.when(F.col("event_type").isin("view", "click"), "train").otherwise(F.col("event_type")).alias("phase"), F.bround("value", 0).cast("long").alias("end_epoch"))
    return monitor.stall(log, ["train", "error"])


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_complete, arg_max(o_orderkey, struct_pack(v := o_totalprice, k := -o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS best_number, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS best_value FROM orders")
def trial_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("pruned").alias("state"))
    return monitor.trial_summary(o)


@query(
    """WITH t AS (SELECT o_orderstatus, o_orderpriority, o_orderkey, o_totalprice * o_totalprice AS area, o_totalprice AS v FROM orders),
    q AS (SELECT list_distinct(quantile_cont(o_orderkey::DOUBLE, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS keys, list_distinct(quantile_cont(area, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS areas FROM t),
    cells AS (
        SELECT 'o_orderstatus' AS parameter, o_orderstatus AS cell, v FROM t
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, v FROM t
        UNION ALL SELECT 'o_orderkey', len(list_filter(keys, lambda e: o_orderkey > e))::VARCHAR, v FROM t, q
        UNION ALL SELECT 'area', len(list_filter(areas, lambda e: area > e))::VARCHAR, v FROM t, q),
    g AS (SELECT parameter, cell, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM cells GROUP BY 1, 2),
    m AS (SELECT parameter, sum(n * m) / sum(n) AS mean FROM g GROUP BY 1),
    s AS (SELECT parameter, sum(n)::DOUBLE AS n, count(*) AS k, sum(n * (m - mean) * (m - mean)) AS b, sum(n * s) AS w FROM g JOIN m USING (parameter) GROUP BY 1)
    SELECT parameter, round(greatest((b - (k - 1) * w / (n - k)) / (b + w), 0), 5) AS importance FROM s"""
)
def parameter_importance(spark, sf_dir):
    """Two parameters of few values, one of a value for each trial that tells nothing, one whose square the value is."""
    o = read(spark, sf_dir, "orders").withColumn("area", F.col("o_totalprice") * F.col("o_totalprice"))
    return monitor.parameter_importance(o, ["o_orderstatus", "o_orderpriority", "o_orderkey", "area"], "o_totalprice").withColumn("importance", F.round("importance", 5))


@query(
    """WITH m AS (SELECT o_orderstatus AS stage, count(*)::DOUBLE AS seconds, CASE o_orderstatus WHEN 'F' THEN 'rows' WHEN 'O' THEN 'benign' ELSE 'fixed' END AS driver, count(DISTINCT o_custkey) AS n_rows, count(DISTINCT o_orderpriority) AS n_benign FROM orders GROUP BY 1),
    x AS (SELECT stage, seconds * CASE driver WHEN 'rows' THEN 70400000.0::DOUBLE / n_rows WHEN 'benign' THEN 113828.0::DOUBLE / n_benign ELSE 1 END AS s FROM m)
    SELECT stage, round(s, 6) AS seconds, CAST(ceil(s / 18000) AS BIGINT) AS sessions FROM x"""
)
def extrapolate_cost(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").cast("double").alias("seconds"), F.count_distinct("o_custkey").alias("n_rows"), F.count_distinct("o_orderpriority").alias("n_benign"))
    kind = F.when(F.col("stage") == "F", "rows").when(F.col("stage") == "O", "benign").otherwise("fixed")
    return monitor.extrapolated(m.withColumn("driver", kind), 70_400_000, 113_828, 18_000)


@query("SELECT count(*) FILTER (WHERE s = 'PASS') AS n_pass, count(*) FILTER (WHERE s = 'SKIP') AS n_skip, count(*) FILTER (WHERE s = 'FAIL') AS n_fail, CASE WHEN count(*) FILTER (WHERE s = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'SKIP' ELSE 'FAIL' END AS s FROM orders)")
def acceptance(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return monitor.accepted(o.select(F.col("o_orderkey").alias("check"), F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "SKIP").otherwise("FAIL").alias("status")))


@query("SELECT r_name AS region, n_name AS nation, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def dimension_joins(spark, sf_dir):
    r, n, c, o = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


# Models over the embeddings: label 0 against the others. Trees and networks have no SQL.


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") < 5).cast("int").alias("y"))


def _net(spark: SparkSession, sf_dir: str):
    """A small network fitted on a bounded sample (at most 4096 rows)."""
    rows = sampling.plain_sample(_binary(spark, sf_dir), "vec_id", 1, 4096).toPandas()
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    n = net.Net(net.Shape(64, cnn_filters_1=4, cnn_filters_2=4, cnn_dense=16, mlp_units_1=32, mlp_units_2=16, fusion_dim=16, dropout=0.0), 3)
    for _ in net.epochs(n, net.Adam(0.003), x, y, 1, 15, 128):
        pass
    return n, x


@query()
def gbt_tree_shap(spark, sf_dir):
    """Mean attributions of a boosted surrogate, ranked."""
    df = _binary(spark, sf_dir)
    ensemble = trees.Ensemble.of(trees.fit_surrogate(df.withColumnRenamed("x", "features"), label="y", trees=8, depth=3), spark)
    values = explain.with_attributions(df, "vec_id", "x", 64, ensemble.attributions)
    named = values.select(F.concat(F.lit("f"), F.lpad(F.col("feature").cast("string"), 2, "0")).alias("feature"), "value")
    return ranking.ranked(ranking.importance(named))


@query()
def net_forward(spark, sf_dir):
    """The network's scores."""
    n, _ = _net(spark, sf_dir)
    return explain.with_scores(_binary(spark, sf_dir), "vec_id", "x", 64, lambda m: 1 / (1 + np.exp(-n.forward(m)[0]))).withColumn("score", F.round("score", 6))


@query()
def permutation_importance(spark, sf_dir):
    """The drop of macro F1 by feature."""
    n, _ = _net(spark, sf_dir)
    return explain.permutation_importance(_binary(spark, sf_dir), "vec_id", "x", "y", 64, lambda m: 1 / (1 + np.exp(-n.forward(m)[0])), list(range(64)), 5)


@query()
def expected_gradients(spark, sf_dir):
    """Mean attributions of the network, ranked."""
    n, x = _net(spark, sf_dir)
    values = explain.with_attributions(_binary(spark, sf_dir), "vec_id", "x", 64, lambda m: net.expected_gradients(n, m, x[:200], 8))
    named = values.select(F.concat(F.lit("f"), F.lpad(F.col("feature").cast("string"), 2, "0")).alias("feature"), "value")
    return ranking.ranked(ranking.importance(named))
