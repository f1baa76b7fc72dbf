"""The core queries, bound to the event and text tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.functions import kernels as K
from sphygmo.operators import beats, blocks, files, kernels, peaks, quality, rates, samples
from sphygmo.plans import batch
from sphygmo.operators.samples import rounded
from sphygmo.sources import recordings, tables
from sphygmo.sources.datasource import write_keyed
from sphygmo.sources.shared import scratch, staged
from sphygmo.sources.signals import packed, sig_type, sig_user, table

#: Nominal samples a second of the two signal views.
USER_FS, TYPE_FS = 10.0, 30.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SIG = """sig AS (SELECT {key} AS recording_id, CAST(row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value AS v FROM events)"""
_USER, _TYPE = _SIG.format(key="user_id"), _SIG.format(key="event_type")
_R = "round({0}, 6) + 0.0".format


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _v(df: DataFrame, *cols: str) -> DataFrame:
    """Signal rows with values rounded."""
    return df.select("recording_id", "idx", *[rounded(F.col(c)).alias(c) for c in cols or ("v",)])


# --- sample-wise -----------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY recording_id ORDER BY idx)"
_P = "OVER (PARTITION BY recording_id)"


@query("trim", f"""WITH {_USER}, n AS (SELECT *, count(*) {_P} AS n FROM sig), b AS (SELECT *, greatest(0, least(15, n - 1)) AS a FROM n)
SELECT recording_id, idx, v FROM b WHERE idx >= a AND idx < greatest(a + 1, least(n - 5, n))""")
def trim(s, d):
    return samples.trim(sig_user(s, d), USER_FS, 1.5, 0.5)


@query("reverse", f"WITH {_USER} SELECT recording_id, idx, {_R('-v')} AS v FROM sig")
def reverse(s, d):
    return _v(samples.reverse(sig_user(s, d)))


@query("center_mean", f"WITH {_USER} SELECT recording_id, idx, round(v - avg(v) {_P}, 9) + 0.0 AS v FROM sig")
def center_mean(s, d):
    x = samples.center(sig_user(s, d), "mean")
    return x.select("recording_id", "idx", rounded(F.col("v"), 9).alias("v"))


@query("center_median", f"WITH {_USER} SELECT recording_id, idx, {_R(f'v - median(v) {_P}')} AS v FROM sig")
def center_median(s, d):
    return _v(samples.center(sig_user(s, d), "median"))


_DETREND = f"fit AS (SELECT *, coalesce(regr_slope(v, idx) {_P}, 0) AS slope, avg(idx) {_P} AS mid, avg(v) {_P} AS mean FROM sig), flat AS (SELECT recording_id, idx, v AS raw, v - mean - slope * (idx - mid) AS v FROM fit)"


@query("detrend", f"WITH {_USER}, {_DETREND} SELECT recording_id, idx, {_R('v')} AS v FROM flat")
def detrend(s, d):
    return _v(samples.detrend(sig_user(s, d)))


@query("chunk_stats", f"""WITH {_USER}, n AS (SELECT *, count(*) {_P} AS n, idx // 30 AS raw FROM sig),
c AS (SELECT recording_id, v, CASE WHEN n < 30 THEN 0 WHEN n % 30 > 0 AND n % 30 < 10 AND raw = n // 30 AND raw > 0 THEN raw - 1 ELSE raw END AS chunk FROM n)
SELECT recording_id, chunk, count(*) AS samples, {_R('avg(v)')} AS mean FROM c GROUP BY ALL""")
def chunk_stats(s, d):
    c = samples.chunks(sig_user(s, d), USER_FS, 3.0)
    return c.groupBy("recording_id", "chunk").agg(F.count("*").alias("samples"), rounded(F.avg("v")).alias("mean"))


@query("overrides", f"""WITH {_USER}, r AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1)
SELECT recording_id, CAST(CASE WHEN recording_id % 5 = 0 THEN 25.0 ELSE 10.0 END AS DOUBLE) AS fs, {_R('n / CASE WHEN recording_id % 5 = 0 THEN 25.0 ELSE 10.0 END')} AS seconds,
CASE WHEN recording_id % 5 = 0 THEN 'Overridden' ELSE 'PASS' END AS fs_status FROM r""")
def overrides(s, d):
    r = sig_user(s, d).groupBy("recording_id").agg(F.count("*").alias("n"))
    wish = F.when(F.col("recording_id") % 5 == 0, 25.0)
    fs = F.when(wish > 0, wish).otherwise(USER_FS)
    return r.select("recording_id", fs.alias("fs"), rounded(F.col("n") / fs).alias("seconds"), F.when(wish > 0, "Overridden").otherwise("PASS").alias("fs_status"))


@query("interpolate_gaps", f"""WITH {_USER}, g AS (SELECT recording_id, idx, CASE WHEN idx % 7 = 0 THEN NULL ELSE v END AS v FROM sig),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER q AS b, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS i, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER q AS j FROM g
WINDOW p AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT recording_id, idx, {_R('coalesce(v, a + (b - a) * ((idx - i) / nullif(j - i, 0)), a, b, 0.0)')} AS v FROM f""")
def interpolate_gaps(s, d):
    gaps = sig_user(s, d).withColumn("v", F.when(F.col("idx") % 7 != 0, F.col("v")))
    return _v(samples.fill_gaps(gaps))


def _filled(x: str) -> str:
    return f"coalesce({x}, last_value({x} IGNORE NULLS) OVER p + (first_value({x} IGNORE NULLS) OVER q - last_value({x} IGNORE NULLS) OVER p) * ((idx - last_value(CASE WHEN {x} IS NOT NULL THEN idx END IGNORE NULLS) OVER p) / nullif(first_value(CASE WHEN {x} IS NOT NULL THEN idx END IGNORE NULLS) OVER q - last_value(CASE WHEN {x} IS NOT NULL THEN idx END IGNORE NULLS) OVER p, 0)), last_value({x} IGNORE NULLS) OVER p, first_value({x} IGNORE NULLS) OVER q, 0.0)"


@query("sanitized_frames", f"""WITH {_USER}, g AS (SELECT recording_id, idx, CASE WHEN idx % 7 IN (0, 1) THEN NULL ELSE v END AS a, CASE WHEN idx < 3 OR idx % 11 = 4 THEN NULL ELSE idx * 0.5 END AS b, CAST(NULL AS DOUBLE) AS hollow FROM sig)
SELECT recording_id, idx, {_R(_filled('a'))} AS a, {_R(_filled('b'))} AS b, {_R(_filled('hollow'))} AS hollow FROM g
WINDOW p AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def sanitized_frames(s, d):
    """Frames of three columns with gaps: nulls, no numbers and infinite values, at ends and inside, and a hollow column."""
    i = F.col("idx")
    a = F.when(i % 7 == 0, float("nan")).when(i % 7 == 1, float("inf")).otherwise(F.col("v"))
    b = F.when((i >= 3) & (i % 11 != 4), i * 0.5)
    frame = sig_user(s, d).withColumns({"a": a, "b": b, "hollow": F.lit(None).cast("double")})
    return _v(samples.fill_columns(frame, ["a", "b", "hollow"]), "a", "b", "hollow")


_CLIP = f"q AS (SELECT recording_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM sig GROUP BY 1), clipped AS (SELECT recording_id, idx, CASE WHEN b - a > 1e-9 THEN least(greatest(v, m - 3.5 * (b - a)), m + 3.5 * (b - a)) ELSE v END AS v FROM sig JOIN q USING (recording_id))"


@query("iqr_clip", f"WITH {_USER}, {_CLIP} SELECT recording_id, idx, {_R('v')} AS v FROM clipped")
def iqr_clip(s, d):
    return _v(samples.iqr_clip(sig_user(s, d)))


def _grad(x: str, w: str = _W, fs: str = "10") -> str:
    return f"CASE WHEN lag({x}) {w} IS NULL THEN (lead({x}) {w} - {x}) * {fs} WHEN lead({x}) {w} IS NULL THEN ({x} - lag({x}) {w}) * {fs} ELSE (lead({x}) {w} - lag({x}) {w}) * {fs} / 2 END"


_DERIV = f"g1 AS (SELECT *, {_grad('v')} AS vpg FROM sig), g2 AS (SELECT *, {_grad('vpg')} AS apg FROM g1)"


@query("derivatives", f"WITH {_USER}, {_DERIV} SELECT recording_id, idx, {_R('idx / 10.0')} AS time_sec, {_R('v')} AS preprocessed_signal, {_R('vpg')} AS vpg_1st_derivative, {_R('apg')} AS apg_2nd_derivative FROM g2")
def derivatives(s, d):
    x = samples.derivatives(sig_user(s, d), USER_FS)
    return x.select("recording_id", "idx", rounded(F.col("idx") / USER_FS).alias("time_sec"), rounded(F.col("v")).alias("preprocessed_signal"), rounded(F.col("vpg")).alias("vpg_1st_derivative"), rounded(F.col("apg")).alias("apg_2nd_derivative"))


@query("first_diff", f"WITH {_USER}, x AS (SELECT recording_id, idx, v - lag(v) {_W} AS d FROM sig) SELECT recording_id, idx, {_R('d')} AS d FROM x WHERE d IS NOT NULL")
def first_diff(s, d):
    return _v(samples.differences(sig_user(s, d)), "d")


@query("normalize_overlay", f"WITH {_USER} SELECT recording_id, idx, {_R(f'(v - min(v) {_P}) / (max(v) {_P} - min(v) {_P} + 1e-9)')} AS v FROM sig")
def normalize_overlay(s, d):
    return _v(samples.normalized(sig_user(s, d)))


@query("validate_signal", f"WITH {_USER} SELECT recording_id, count(*) AS samples, count(*) FILTER (v IS NOT NULL) > 0 AS usable, 10.0 > 0 AND 10.0 <= 10000 AS rate_ok FROM sig GROUP BY 1")
def validate_signal(s, d):
    fine = F.count(F.when(F.col("v").isNotNull() & ~F.isnan("v"), 1)) > 0
    return sig_user(s, d).groupBy("recording_id").agg(F.count("*").alias("samples"), fine.alias("usable")).withColumn("rate_ok", F.lit(USER_FS).between(1e-300, 10000))


@query("preview", f"WITH {_TYPE} SELECT recording_id, idx, v FROM sig WHERE idx < 300")
def preview(s, d):
    return sig_type(s, d).filter(F.col("idx") < int(10 * TYPE_FS))


# --- aggregates ------------------------------------------------------------------------------------------------

_SKEW = "CASE WHEN var_pop(v) = 0 THEN NULL ELSE (avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)*avg(v)*avg(v)) / power(var_pop(v), 1.5) END"


@query("signal_stats", f"WITH {_TYPE} SELECT recording_id, count(*) AS n, {_R('avg(v)')} AS mean, {_R('stddev_pop(v)')} AS std, min(v) AS low, max(v) AS high, {_R('median(v)')} AS median, round({_SKEW}, 5) + 0.0 AS skewness, round(kurtosis_pop(v), 5) + 0.0 AS kurtosis FROM sig GROUP BY 1")
def signal_stats(s, d):
    x = quality.stats(sig_type(s, d))
    return x.select("recording_id", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "low", "high", rounded(F.col("median")).alias("median"), rounded(F.col("skewness"), 5).alias("skewness"), rounded(F.col("kurtosis"), 5).alias("kurtosis"))


_ENTROPY = f"r AS (SELECT *, min(v) {_P} AS lo, max(v) {_P} AS hi FROM sig), h AS (SELECT recording_id, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(floor((v - lo) * 50 / (hi - lo)), 49) END AS bin, count(*) AS c FROM r GROUP BY ALL), pr AS (SELECT recording_id, c / sum(c) OVER (PARTITION BY recording_id) AS p FROM h), ent AS (SELECT recording_id, -sum(p * log2(p)) + 0.0 AS entropy FROM pr GROUP BY 1)"


@query("entropy50", f"WITH {_USER}, {_ENTROPY} SELECT recording_id, {_R('entropy')} AS entropy FROM ent")
def entropy50(s, d):
    return quality.entropy(sig_user(s, d)).select("recording_id", rounded(F.col("entropy")).alias("entropy"))


@query("energy", f"WITH {_USER}, {_DETREND} SELECT recording_id, round(sum(v * v) / count(*), 4) + 0.0 AS energy FROM flat GROUP BY 1")
def energy(s, d):
    return quality.energy(sig_user(s, d)).select("recording_id", rounded(F.col("energy"), 4).alias("energy"))


@query("derivative_ranges", f"WITH {_USER}, {_DERIV} SELECT recording_id, round(max(vpg) - min(vpg), 5) + 0.0 AS vpg_range, round(max(apg) - min(apg), 4) + 0.0 AS apg_range FROM g2 GROUP BY 1")
def derivative_ranges(s, d):
    x = samples.derivatives(sig_user(s, d), USER_FS)
    return x.groupBy("recording_id").agg(rounded(F.max("vpg") - F.min("vpg"), 5).alias("vpg_range"), rounded(F.max("apg") - F.min("apg"), 4).alias("apg_range"))


_MOTION = f"dd AS (SELECT *, v - lag(v) {_W} AS d FROM sig), ds AS (SELECT *, stddev_pop(d) {_P} AS s FROM dd), motion AS (SELECT recording_id, avg(CASE WHEN v IS NULL THEN 100.0 ELSE 0.0 END) AS missing_pct, coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1e-7 THEN 100.0 ELSE 0.0 END), 0) AS flat_pct, coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN s > 1e-9 AND abs(d) > 5 * s THEN 100.0 ELSE 0.0 END), 0) AS motion_pct FROM ds GROUP BY 1)"


@query("missing_flat_motion", f"WITH {_USER}, {_MOTION} SELECT recording_id, {_R('missing_pct')} AS missing_pct, {_R('flat_pct')} AS flat_pct, {_R('motion_pct')} AS motion_pct FROM motion")
def missing_flat_motion(s, d):
    x = quality.gaps_flats_motion(sig_user(s, d))
    return x.select("recording_id", *[rounded(F.col(c)).alias(c) for c in ("missing_pct", "flat_pct", "motion_pct")])


_MEDIAN = f"med AS (SELECT recording_id, idx, v AS raw, list_sort(list_concat([coalesce(lag(v) {_W}, 0.0), v], [coalesce(lead(v) {_W}, 0.0)]))[2] AS v FROM sig)"


@query("median_filter", f"WITH {_TYPE}, {_MEDIAN} SELECT recording_id, idx, {_R('v')} AS v FROM med")
def median_filter(s, d):
    return _v(samples.median_filter(sig_type(s, d), TYPE_FS))


@query("morph_corr", f"WITH {_TYPE}, {_MEDIAN} SELECT recording_id, round(CASE WHEN stddev_pop(raw) < 1e-9 OR stddev_pop(v) < 1e-9 THEN 0 ELSE greatest(0, covar_pop(raw, v) / (stddev_pop(raw) * stddev_pop(v))) * 100 END, 5) + 0.0 AS morphology FROM med GROUP BY 1")
def morph_corr(s, d):
    raw = sig_type(s, d).withColumn("raw", F.col("v"))
    return quality.correlation_score(samples.median_filter(raw, TYPE_FS), "raw", "v").select("recording_id", rounded(F.col("morphology"), 5).alias("morphology"))


@query("artifact_heatmap", f"""WITH {_TYPE}, z AS (SELECT *, count(*) {_P} // 10 AS size FROM sig), c AS (SELECT *, idx // size AS chunk FROM z WHERE size >= 10 AND idx < size * 10),
x AS (SELECT *, v - lag(v) OVER (PARTITION BY recording_id, chunk ORDER BY idx) AS d, v - coalesce(regr_slope(v, idx) OVER (PARTITION BY recording_id, chunk), 0) * idx AS r FROM c),
y AS (SELECT *, stddev_pop(d) OVER (PARTITION BY recording_id, chunk) AS s FROM x)
SELECT recording_id, chunk, {_R('avg(CASE WHEN d IS NULL THEN NULL WHEN s > 1e-9 AND abs(d) > 4 * s THEN 100.0 ELSE 0.0 END)')} AS motion, round(greatest(0.0, (stddev_pop(v) - stddev_pop(r)) / (stddev_pop(v) + 1e-9) * 100), 5) + 0.0 AS drift, {_R('avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1e-7 THEN 100.0 ELSE 0.0 END)')} AS flat FROM y GROUP BY ALL""")
def artifact_heatmap(s, d):
    x = quality.heatmap(sig_type(s, d))
    return x.select("recording_id", "chunk", rounded(F.col("motion")).alias("motion"), rounded(F.col("drift"), 5).alias("drift"), rounded(F.col("flat")).alias("flat"))


@query("total_duration", "SELECT count(DISTINCT user_id) AS files, round(count(*) / 10.0, 6) AS seconds FROM events")
def total_duration(s, d):
    return table(s, d, "events").agg(F.countDistinct("user_id").alias("files"), F.round(F.count("*") / USER_FS, 6).alias("seconds"))


# --- quality and decisions -------------------------------------------------------------------------------------

@query("duration_source", f"""WITH {_USER}, met AS (SELECT recording_id, count(*) AS n, max(v) - min(v) AS span FROM sig GROUP BY 1), named AS (SELECT *, CASE recording_id % 5 WHEN 0 THEN 'phone_' WHEN 1 THEN 'clg_' WHEN 2 THEN 'trial_' ELSE 'rec_' END || recording_id AS file_name, CASE recording_id % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 125.0 ELSE 250.0 END AS fs FROM met)
SELECT recording_id, CASE WHEN n / fs < 20 THEN '<20s Short' WHEN n / fs <= 120 THEN '20-120s Standard' WHEN n / fs <= 300 THEN '120-300s Long' ELSE '>300s Extended' END AS bucket,
CASE WHEN regexp_matches(file_name, 'mobile|phone|camera|app|sensor|smartwatch') THEN 'Mobile' WHEN regexp_matches(file_name, 'clg|aiims|clinical|patient|hosp|subject') THEN CASE WHEN span > 10 THEN 'Mobile' ELSE 'Clinical' END
WHEN regexp_matches(file_name, 'sub|research|lab|trial') THEN 'Research' WHEN fs <= 60 THEN 'Mobile' WHEN fs >= 200 AND span < 5 THEN 'Clinical' WHEN fs >= 100 AND span > 10 THEN 'Research' ELSE 'Unknown' END AS source FROM named""")
def duration_source(s, d):
    r = F.col("recording_id")
    name = F.concat(F.when(r % 5 == 0, "phone_").when(r % 5 == 1, "clg_").when(r % 5 == 2, "trial_").otherwise("rec_"), r.cast("string"))
    fs = F.when(r % 3 == 0, 30.0).when(r % 3 == 1, 125.0).otherwise(250.0)
    spans = sig_user(s, d).groupBy("recording_id").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("span"))
    return spans.select("recording_id", quality.duration_bucket(F.col("n") / fs).alias("bucket"), quality.source_kind(name, F.lit(""), fs, F.col("span")).alias("source"))


# --- text ------------------------------------------------------------------------------------------------------

#: SQL for a line without the white space at its ends.
_CUT = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))".format


@query("delimiter_detect", rf"""WITH h AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10))[1:20], lambda x: {_CUT('x')} <> ''), chr(10)) AS h FROM documents),
c AS (SELECT doc_id, length(h) - length(replace(h, ',', '')) AS a, length(h) - length(replace(h, ';', '')) AS b, length(h) - length(replace(h, chr(9), '')) AS t, length(h) - length(replace(h, ' ', '')) AS p FROM h)
SELECT doc_id, CASE WHEN t > 0 THEN chr(9) WHEN greatest(a, b, t, p) = 0 OR greatest(a, b, t, p) = a THEN ',' WHEN greatest(a, b, t, p) = b THEN ';' ELSE ' ' END AS delimiter FROM c""")
def delimiter_detect(s, d):
    return table(s, d, "documents").select("doc_id", files.delimiter(F.col("text")).alias("delimiter"))


_NUMBER_SQL = r"regexp_full_match(x, '\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*|\s*[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*')"


@query("float_tokens", f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\s,;|]+'), lambda x: {_NUMBER_SQL})) AS INTEGER) AS numbers FROM documents")
def float_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[\s,;|]+"), files.is_number)).alias("numbers"))


@query("modal_columns", rf"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
t AS (SELECT file, no, string_split({_CUT('line')}, ',') AS k FROM l WHERE {_CUT('line')} <> ''), n AS (SELECT file, no, CASE WHEN len(k) > 1 AND k[len(k)] = '' THEN len(k) - 1 ELSE len(k) END AS columns FROM t),
g AS (SELECT file, columns, count(*) AS c, min(no) AS f FROM n GROUP BY ALL)
SELECT file, CAST(columns AS INTEGER) AS columns FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY c DESC, f) = 1""")
def modal_columns(s, d):
    return files.modal_columns(files.lines_of(table(s, d, "documents").select(F.col("doc_id").alias("file"), "text")))


@query("data_start", rf"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
t AS (SELECT file, no, string_split({_CUT('line')}, ',') AS k FROM l WHERE {_CUT('line')} <> ''), n AS (SELECT file, no, CASE WHEN len(k) > 1 AND k[len(k)] = '' THEN k[1:len(k) - 1] ELSE k END AS k FROM t),
g AS (SELECT file, len(k) AS columns, count(*) AS c, min(no) AS f FROM n GROUP BY 1, 2), m AS (SELECT file, columns FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY c DESC, f) = 1),
ok AS (SELECT file, no, len(k) = columns AND len(list_filter(k, lambda x: {_NUMBER_SQL})) >= columns - 1 AS ok FROM n JOIN m USING (file)),
run AS (SELECT file, no, bool_and(ok) OVER (PARTITION BY file ORDER BY no RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM ok)
SELECT file, CAST(coalesce(min(no) FILTER (run), 0) AS INTEGER) AS start FROM run GROUP BY file""")
def data_start(s, d):
    return files.data_start(files.lines_of(table(s, d, "documents").select(F.col("doc_id").alias("file"), "text")))


@query("file_class", rf"""WITH h AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10))[1:20], lambda x: {_CUT('x')} <> ''), chr(10)) AS h FROM documents),
c AS (SELECT *, length(h) - length(replace(h, ',', '')) AS a, length(h) - length(replace(h, ';', '')) AS b, length(h) - length(replace(h, chr(9), '')) AS t, length(h) - length(replace(h, ' ', '')) AS p FROM h),
d AS (SELECT doc_id, text, CASE WHEN t > 0 THEN chr(9) WHEN greatest(a, b, t, p) = 0 OR greatest(a, b, t, p) = a THEN ',' WHEN greatest(a, b, t, p) = b THEN ';' ELSE ' ' END AS sep FROM c),
k AS (SELECT *, flatten(list_transform(list_filter(string_split(substr(text, 1, 2048), chr(10)), lambda x: {_CUT('x')} <> '')[1:10], lambda x: CASE WHEN sep = ' ' THEN regexp_split_to_array({_CUT('x')}, '\s+') ELSE string_split({_CUT('x')}, sep) END)) AS k FROM d),
s AS (SELECT *, CASE WHEN len(k) > 0 THEN len(list_filter(list_transform(k, lambda x: translate(x, chr(34) || chr(39), '')), lambda x: {_NUMBER_SQL})) / len(k) ELSE 1 END AS share FROM k)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR contains(substr(text, 1, 2048), chr(0)) THEN 'Unsafe' WHEN share < 0.1 THEN 'Research Only' WHEN doc_id % 3 = 0 AND sep = ',' THEN 'Ready' WHEN doc_id % 3 = 1 AND sep <> ';' THEN 'Ready' ELSE 'Partially Ready' END AS status FROM s""")
def file_class(s, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".csv").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".tsv")
    docs = files.classified(table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), ext).alias("file_path"), F.octet_length("text").cast("long").alias("size"), "text", "doc_id"))
    return docs.select("doc_id", "status")


@query("metadata_kv", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def metadata_kv(s, d):
    kv = F.from_json("props", "map<string,string>")
    return table(s, d, "events").select("event_id", F.explode(kv).alias("key", "value"))


# --- peaks -----------------------------------------------------------------------------------------------------

_MAX = """runs AS (SELECT recording_id, idx, v, sum(fresh) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY recording_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM sig)),
plat AS (SELECT recording_id, run, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM runs GROUP BY recording_id, run),
maxima AS (SELECT recording_id, (a + b) // 2 AS idx, v FROM (SELECT *, lag(v) OVER (PARTITION BY recording_id ORDER BY a) AS l, lead(v) OVER (PARTITION BY recording_id ORDER BY a) AS r FROM plat) WHERE v > l AND v > r)"""
_FAR = """tops AS (SELECT recording_id, list({'v': v, 'idx': idx} ORDER BY v DESC, idx DESC) AS t FROM maxima GROUP BY 1),
pk AS (SELECT recording_id, unnest(list_reduce(list_transform(t, lambda x: [x.idx]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < 12)) > 0 THEN acc ELSE list_concat(acc, x) END, CAST([] AS BIGINT[]))) AS idx FROM tops)"""


@query("local_maxima", f"WITH {_TYPE}, {_MAX} SELECT recording_id, idx, v FROM maxima")
def local_maxima(s, d):
    return peaks.local_maxima(sig_type(s, d))


def _typed(s: SparkSession, d: str) -> DataFrame:
    return sig_type(s, d).withColumn("fs", F.lit(TYPE_FS))


def _kept(s: SparkSession, d: str) -> DataFrame:
    """:func:`_typed` for many steps: samples are put in order and numbered once, not for each of them."""
    return staged(scratch(s))(_typed(s, d), "signal")


def _named(s: SparkSession, d: str) -> DataFrame:
    return sig_user(s, d).withColumn("fs", F.lit(USER_FS))


def _far(sig: DataFrame) -> DataFrame:
    return kernels.found_peaks(sig, 0.4, 0.0).filter("side = 'peak'")


def _peaks(s: SparkSession, d: str) -> DataFrame:
    return _far(_typed(s, d))


@query("peaks_distance", f"WITH {_TYPE}, {_MAX}, {_FAR} SELECT recording_id, idx FROM pk")
def peaks_distance(s, d):
    return _peaks(s, d).select("recording_id", "idx")


@query("rr_trend", f"WITH {_TYPE}, {_MAX}, {_FAR}, x AS (SELECT recording_id, idx, (idx - lag(idx) {_W}) / 30.0 AS rr FROM pk) SELECT recording_id, {_R('idx / 30.0')} AS time, {_R('rr')} AS rr, {_R('60.0 / rr')} AS hr FROM x WHERE rr IS NOT NULL")
def rr_trend(s, d):
    return peaks.intervals(_peaks(s, d), TYPE_FS).select("recording_id", *[rounded(F.col(c)).alias(c) for c in ("time", "rr", "hr")])


@query("poincare", f"""WITH {_TYPE}, {_MAX}, {_FAR}, x AS (SELECT recording_id, idx, (idx - lag(idx) {_W}) / 30.0 AS rr FROM pk), y AS (SELECT *, lead(rr) {_W} AS nx FROM x), z AS (SELECT recording_id, coalesce(sqrt(0.5 * var_pop(rr - nx)), 0) AS sd1, coalesce(sqrt(0.5 * var_pop(CASE WHEN nx IS NOT NULL THEN rr + nx END)), 0) AS sd2 FROM y GROUP BY 1)
SELECT recording_id, {_R('sd1')} AS sd1, {_R('sd2')} AS sd2, {_R('CASE WHEN sd2 > 1e-9 THEN sd1 / sd2 ELSE 1.0 END')} AS ratio FROM z""")
def poincare(s, d):
    return peaks.poincare(_peaks(s, d), TYPE_FS).select("recording_id", *[rounded(F.col(c)).alias(c) for c in ("sd1", "sd2", "ratio")])


@query("peak_prominence", f"""WITH {_TYPE}, {_MAX}, {_FAR}, h AS (SELECT pk.recording_id, pk.idx, sig.v FROM pk JOIN sig USING (recording_id, idx)),
e AS (SELECT h.recording_id, h.idx, h.v, max(s.idx) FILTER (s.idx < h.idx AND s.v > h.v) AS l, min(s.idx) FILTER (s.idx > h.idx AND s.v > h.v) AS r FROM h JOIN sig s USING (recording_id) GROUP BY ALL)
SELECT e.recording_id, e.idx, round(e.v - greatest(min(s.v) FILTER (s.idx <= e.idx AND s.idx > coalesce(l, -1)), min(s.v) FILTER (s.idx >= e.idx AND s.idx < coalesce(r, 1000000000))), 6) + 0.0 AS prominence FROM e JOIN sig s USING (recording_id) GROUP BY e.recording_id, e.idx, e.v""")
def peak_prominence(s, d):
    return _peaks(s, d).select("recording_id", "idx", rounded(F.col("prominence")).alias("prominence"))


def _prominent(of: str) -> str:
    """SQL for (recording_id, idx, v, prominence) of the peaks pk of a table of samples."""
    return f"""h AS (SELECT pk.recording_id, pk.idx, {of}.v FROM pk JOIN {of} USING (recording_id, idx)),
e AS (SELECT h.recording_id, h.idx, h.v, max(s.idx) FILTER (s.idx < h.idx AND s.v > h.v) AS l, min(s.idx) FILTER (s.idx > h.idx AND s.v > h.v) AS r FROM h JOIN {of} s USING (recording_id) GROUP BY ALL),
prom AS (SELECT e.recording_id, e.idx, e.v, e.v - greatest(min(s.v) FILTER (s.idx <= e.idx AND s.idx > coalesce(l, -1)), min(s.v) FILTER (s.idx >= e.idx AND s.idx < coalesce(r, 1000000000))) AS prominence FROM e JOIN {of} s USING (recording_id) GROUP BY e.recording_id, e.idx, e.v)"""


@query("peak_stability", f"WITH {_TYPE}, {_MAX}, {_FAR}, {_prominent('sig')} SELECT recording_id, {_R('CASE WHEN count(*) > 1 AND avg(prominence) > 1e-9 THEN stddev_pop(prominence) / avg(prominence) ELSE 0 END')} AS peak_stability FROM prom GROUP BY 1")
def peak_stability(s, d):
    return peaks.stability(_peaks(s, d)).select("recording_id", rounded(F.col("peak_stability")).alias("peak_stability"))


@query("peaks_standard", f"""WITH {_TYPE}, {_DETREND}, {_MAX.replace('FROM sig', 'FROM flat')}, {_FAR}, {_prominent('flat')}, sd AS (SELECT recording_id, stddev_pop(v) AS s FROM flat GROUP BY 1)
SELECT recording_id, idx, round(prominence, 5) + 0.0 AS prominence FROM prom JOIN sd USING (recording_id) WHERE prominence >= 0.1 * CASE WHEN s > 1e-9 THEN s ELSE 1 END""")
def peaks_standard(s, d):
    """Peaks of the detrended signal, 0.4 seconds apart and a tenth of its deviation high, of recordings cut into blocks."""
    return blocks.found_peaks(beats.flat(_typed(s, d))).filter("side = 'peak'").select("recording_id", "idx", rounded(F.col("prominence"), 5).alias("prominence"))


_BEATS = f"""bt AS (SELECT recording_id, idx AS start, lead(idx) {_W} AS stop FROM pk),
beats AS (SELECT bt.recording_id, start, list(v ORDER BY s.idx) AS l, count(*) AS n FROM bt JOIN sig s ON s.recording_id = bt.recording_id AND s.idx >= start AND s.idx < stop GROUP BY 1, 2 HAVING count(*) > 5),
pts AS (SELECT recording_id, start, l, n, k, k * (n - 1) // 99 AS low, k * (n - 1) % 99 / 99.0 AS f FROM beats, (SELECT unnest(range(100)) AS k)),
y AS (SELECT recording_id, start, k, l[low + 1] + (l[least(low + 2, n)] - l[low + 1]) * f AS y FROM pts),
z AS (SELECT recording_id, start, CAST(k AS INTEGER) AS k, (y - avg(y) OVER b) / stddev_pop(y) OVER b AS z FROM y WINDOW b AS (PARTITION BY recording_id, start) QUALIFY stddev_pop(y) OVER b > 1e-9)"""


@query("beat_resample", f"WITH {_TYPE}, {_MAX}, {_FAR}, {_BEATS} SELECT recording_id, start, k, {_R('z')} AS z FROM z")
def beat_resample(s, d):
    sig = _kept(s, d)
    return peaks.resampled(peaks.beats(sig, _far(sig))).select("recording_id", "start", "k", rounded(F.col("z")).alias("z"))


@query("beat_consistency", f"""WITH {_TYPE}, {_MAX}, {_FAR}, {_BEATS}, pairs AS (SELECT a.recording_id, a.start AS i, b.start AS j, sum(a.z * b.z) / 100 AS r FROM z a JOIN z b ON a.recording_id = b.recording_id AND a.k = b.k AND a.start < b.start GROUP BY 1, 2, 3),
c AS (SELECT recording_id, CASE WHEN count(*) >= 3 THEN avg(r) END AS c FROM pairs GROUP BY 1)
SELECT recording_id, {_R('coalesce(c, 0.5)')} AS beat_consistency FROM (SELECT DISTINCT recording_id FROM sig) LEFT JOIN c USING (recording_id)""")
def beat_consistency(s, d):
    sig = _kept(s, d)
    return peaks.consistency(sig, _far(sig)).select("recording_id", rounded(F.col("beat_consistency")).alias("beat_consistency"))


_LOWS = f"""tops AS (SELECT recording_id, idx, true AS top FROM pk), neg AS (SELECT recording_id, idx, -v AS v FROM sig), {_MAX.replace('FROM sig', 'FROM neg').replace('runs AS', 'runs2 AS').replace('FROM runs ', 'FROM runs2 ').replace('plat AS', 'plat2 AS').replace('FROM plat)', 'FROM plat2)').replace('maxima AS', 'maxima2 AS')},
{_FAR.replace('tops AS', 'tops2 AS').replace('FROM maxima', 'FROM maxima2').replace('pk AS', 'low AS').replace('FROM tops)', 'FROM tops2)')}"""


@query("trough_asof", f"""WITH {_TYPE}, {_MAX}, {_FAR.replace('tops AS', 'tops0 AS').replace('FROM tops)', 'FROM tops0)')}, {_LOWS}, b AS (SELECT tops.*, low.idx AS before FROM tops ASOF LEFT JOIN low ON tops.recording_id = low.recording_id AND tops.idx > low.idx)
SELECT b.recording_id, b.idx, before, low.idx AS after FROM b ASOF LEFT JOIN low ON b.recording_id = low.recording_id AND b.idx < low.idx""")
def trough_asof(s, d):
    found = kernels.found_peaks(_typed(s, d), 0.4, 0.0)
    return peaks.troughs_around(found.filter("side = 'peak'"), found.filter("side = 'trough'"))


# --- filters, spectra, kernels ---------------------------------------------------------------------------------

_GAUSS = """wide AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM sig), bell AS (SELECT k, exp(-0.5 * (k / 1.5) * (k / 1.5)) AS w FROM (SELECT unnest(range(-6, 7)) AS k)),
read AS (SELECT recording_id, idx AS i, CASE WHEN idx + k < 0 THEN -1 - idx - k WHEN idx + k >= n THEN 2 * n - 1 - idx - k ELSE idx + k END AS idx, w / (SELECT sum(w) FROM bell) AS w FROM wide, bell),
gauss AS (SELECT recording_id, i AS idx, sum(w * v) AS v FROM read JOIN sig USING (recording_id, idx) GROUP BY 1, 2)"""


@query("gauss_filter", f"WITH {_TYPE}, {_GAUSS} SELECT recording_id, idx, {_R('v')} AS v FROM gauss")
def gauss_filter(s, d):
    return _v(samples.gaussian(sig_type(s, d), TYPE_FS))


@query("autocorr", f"""WITH {_USER}, m AS (SELECT recording_id, idx, v - avg(v) {_P} AS v, count(*) {_P} AS n FROM sig), z AS (SELECT recording_id, sum(v * v) AS z FROM m GROUP BY 1),
l AS (SELECT a.recording_id, b.idx - a.idx AS lag, sum(a.v * b.v) AS s FROM m a JOIN m b ON a.recording_id = b.recording_id AND b.idx >= a.idx AND b.idx - a.idx < greatest(1, least(a.n // 2, 2000)) GROUP BY ALL)
SELECT recording_id, lag, {_R('CASE WHEN z > 0 THEN s / z ELSE s END')} AS r FROM l JOIN z USING (recording_id)""")
def autocorr(s, d):
    """All lags up to half of each recording, 2,000 at most, block by block."""
    return blocks.correlated(sig_user(s, d)).select("recording_id", "lag", rounded(F.col("r")).alias("r"))


_BOARD = f"""{_GAUSS}, {_MEDIAN}, each AS (SELECT recording_id, 'None' AS filter, 0 AS ord, v AS raw, v FROM sig UNION ALL SELECT recording_id, 'Gaussian', 1, sig.v, gauss.v FROM sig JOIN gauss USING (recording_id, idx) UNION ALL SELECT recording_id, 'Median', 2, raw, v FROM med),
board AS (SELECT recording_id, filter, ord, round(CASE WHEN stddev_pop(raw) < 1e-9 OR stddev_pop(v) < 1e-9 THEN 0 ELSE greatest(0, covar_pop(raw, v) / (stddev_pop(raw) * stddev_pop(v))) * 100 END, 5) + 0.0 AS morphology FROM each GROUP BY ALL)"""


@query("filter_scoreboard", f"WITH {_TYPE}, {_BOARD} SELECT * FROM board")
def filter_scoreboard(s, d):
    """None, Median and Gaussian by correlation with the raw signal; not the full ranking, which needs the kernels."""
    raw = sig_type(s, d)
    rows = None
    for k, (name, df) in enumerate((("None", raw), ("Gaussian", samples.gaussian(raw, TYPE_FS)), ("Median", samples.median_filter(raw, TYPE_FS)))):
        both = raw.withColumnRenamed("v", "raw").join(df.select("recording_id", "idx", "v"), ["recording_id", "idx"])
        part = quality.correlation_score(both, "raw", "v").select("recording_id", F.lit(name).alias("filter"), F.lit(k).alias("ord"), rounded(F.col("morphology"), 5).alias("morphology"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("top3_filters", f"WITH {_TYPE}, {_BOARD} SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY morphology DESC, ord) AS INTEGER) AS place FROM board QUALIFY place <= 3")
def top3_filters(s, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("recording_id").orderBy(F.desc("morphology"), "ord")
    return filter_scoreboard(s, d).withColumn("place", F.row_number().over(w)).filter("place <= 3")


def _recursive(of: str, name: str, fs: float, out: str = "low", level: int = 0) -> str:
    """SQL for ``out`` (recording_id, idx, v): a table of samples after a recursive filter, one sample after another, forward
    and backward, with the extension of its ends and the steady start. Needs WITH RECURSIVE."""
    sections = K.recursion(name, fs, level)
    pad, start, m = K.padding(sections), K.steady(sections), len(sections)
    states = ", ".join(f"s{k}" for k in range(2 * m))

    def way(x: str, y: str) -> str:
        chain, after = [], []
        value = "e.v"
        for k, (b, a) in enumerate((b.tolist(), a.tolist()) for b, a in sections):
            chain.append(f"CAST({b[0]!r} AS DOUBLE) * {value} + f.s{2 * k} AS o{k}")
            after += [f"f.s{2 * k + 1} + {b[1]!r} * {value} - {a[1]!r} * o{k} AS t{2 * k}", f"{b[2]!r} * {value} - {a[2]!r} * o{k} AS t{2 * k + 1}"]
            value = f"o{k}"
        columns = f"e.recording_id, e.i, {', '.join(chain)}, {', '.join(after)}"
        picked = f"recording_id, i, o{m - 1}, {', '.join(f't{k}' for k in range(2 * m))}"
        first = ", ".join(f"{v!r} * v AS s{k}" for k, v in enumerate(start.tolist()))
        return f"""{y}0 AS MATERIALIZED (SELECT recording_id, CAST(0 AS BIGINT) AS i, {first} FROM {x} WHERE i = 0),
{y}(recording_id, i, y, {states}) AS (SELECT {picked} FROM (SELECT {columns} FROM {y}0 f JOIN {x} e ON e.recording_id = f.recording_id AND e.i = 0)
UNION ALL SELECT {picked} FROM (SELECT {columns} FROM {y} f JOIN {x} e ON e.recording_id = f.recording_id AND e.i = f.i + 1))"""

    return f"""{out}_n AS (SELECT recording_id, count(*) AS n, arg_min(v, idx) AS x0, arg_max(v, idx) AS x1 FROM {of} GROUP BY 1), {out}_s AS (SELECT s.recording_id, s.idx, s.v, n, x0, x1 FROM {of} s JOIN {out}_n USING (recording_id)),
{out}_w AS MATERIALIZED (SELECT recording_id, idx + {pad} AS i, v FROM {out}_s UNION ALL SELECT recording_id, {pad} - idx, 2 * x0 - v FROM {out}_s WHERE idx BETWEEN 1 AND {pad} UNION ALL SELECT recording_id, 2 * (n - 1) - idx + {pad}, 2 * x1 - v FROM {out}_s WHERE idx BETWEEN n - 1 - {pad} AND n - 2),
{way(out + '_w', out + '_f')}, {out}_t AS MATERIALIZED (SELECT recording_id, n + {2 * pad - 1} - i AS i, y AS v FROM {out}_f JOIN {out}_n USING (recording_id)),
{way(out + '_t', out + '_b')}, {out} AS MATERIALIZED (SELECT recording_id, n + {pad - 1} - i AS idx, y AS v FROM {out}_b JOIN {out}_n USING (recording_id) WHERE i BETWEEN {pad} AND n + {pad - 1})"""


def _kernel(name: str, sql: str | None = None):
    @query(name, sql)
    def run(s, d):
        return _v4(blocks.filtered(_typed(s, d), name))


def _v4(df: DataFrame) -> DataFrame:
    return df.select("recording_id", "idx", rounded(F.col("v"), 4).alias("v"))


for _name in ("butterworth", "chebyshev"):
    _kernel(_name, f"WITH RECURSIVE {_TYPE}, {_recursive('sig', _name, TYPE_FS)} SELECT recording_id, idx, round(v, 4) + 0.0 AS v FROM low")


def _wavelet_sql(of: str, out: str) -> str:
    """SQL for ``out``: four levels of the wavelet's two filters, soft shrinkage by the finest band, and back. For recordings of
    112 samples or more."""
    low, taps = K.DB4.tolist(), range(8)
    high = [low[7 - j] * (1 if j % 2 else -1) for j in taps]
    table = lambda a, b: ", ".join(f"({j}, CAST({x!r} AS DOUBLE), CAST({y!r} AS DOUBLE))" for j, x, y in zip(taps, a, b))
    parts = [f"{out}_d(j, a, b) AS (VALUES {table(low, high)}), {out}_u(j, a, b) AS (VALUES {table(low[::-1], [x * (-1 if j % 2 else 1) for j, x in enumerate(low)])}), {out}_l0 AS MATERIALIZED (SELECT recording_id, idx, v FROM {of})"]
    for k in range(4):
        x = f"{out}_l{k}"
        parts.append(f"""{out}_n{k} AS (SELECT recording_id, count(*) AS n FROM {x} GROUP BY 1), {out}_k{k} AS (SELECT recording_id, n, unnest(range(0, (n + 7) // 2)) AS k FROM {out}_n{k}),
{out}_p{k} AS (SELECT recording_id, k, a, b, CASE WHEN 2 * k + 1 - j < 0 THEN j - 2 * k - 2 WHEN 2 * k + 1 - j >= n THEN 2 * n - 2 - 2 * k + j ELSE 2 * k + 1 - j END AS idx FROM {out}_k{k}, {out}_d),
{out}_c{k} AS MATERIALIZED (SELECT p.recording_id, k AS idx, sum(a * v) AS v, sum(b * v) AS h FROM {out}_p{k} p JOIN {x} x USING (recording_id, idx) GROUP BY 1, 2), {out}_l{k + 1} AS (SELECT recording_id, idx, v FROM {out}_c{k})""")
    parts.append(f"{out}_t AS (SELECT c.recording_id, median(abs(h)) / 0.6745 * sqrt(2 * ln(any_value(n))) AS t FROM {out}_c0 c JOIN {out}_n0 USING (recording_id) GROUP BY 1), {out}_r4 AS (SELECT * FROM {out}_l4)")
    for k in (3, 2, 1, 0):
        parts.append(f"""{out}_b{k} AS (SELECT c.recording_id, c.idx, r.v, sign(h) * greatest(abs(h) - t, 0) AS h FROM {out}_c{k} c JOIN {out}_r{k + 1} r USING (recording_id, idx) JOIN {out}_t USING (recording_id)),
{out}_r{k} AS MATERIALIZED (SELECT recording_id, 2 * idx + j - 6 AS idx, sum(v * a + h * b) AS v FROM {out}_b{k} JOIN {out}_n{k} USING (recording_id), {out}_u WHERE 2 * idx + j - 6 BETWEEN 0 AND 2 * ((n + 7) // 2) - 7 GROUP BY 1, 2)""")
    parts.append(f"{out} AS MATERIALIZED (SELECT r.recording_id, r.idx, r.v FROM {out}_r0 r JOIN {out}_n0 USING (recording_id) WHERE idx < n)")
    return ", ".join(parts)


@query("wavelet", f"WITH {_TYPE}, {_wavelet_sql('sig', 'wave')} SELECT recording_id, idx, {_R('v')} AS v FROM wave")
def wavelet(s, d):
    return _v(kernels.filtered(_typed(s, d), "wavelet"))


def _parabolas(w: int = 13) -> str:
    """SQL for the fit of each window's parabola, as constant weights: one row for each place in it."""
    t = np.vander(np.arange(w) - w // 2, 3, increasing=True)
    return str((t @ np.linalg.pinv(t)).tolist())


_SAVGOL = f"""fit AS (SELECT unnest({_parabolas()}) AS c, generate_subscripts({_parabolas()}, 1) - 1 AS k), sized AS (SELECT *, count(*) {_P} AS n FROM sig),
placed AS (SELECT recording_id, idx, CASE WHEN idx >= n - 6 THEN n - 13 WHEN idx < 6 THEN 0 ELSE idx - 6 END AS a FROM sized WHERE n > 13),
smooth AS (SELECT p.recording_id, p.idx, sum(s.v * c[s.idx - a + 1]) AS v FROM placed p JOIN fit ON fit.k = p.idx - a JOIN sig s ON s.recording_id = p.recording_id AND s.idx BETWEEN a AND a + 12 GROUP BY ALL)"""


@query("savitzky_golay", f"WITH {_TYPE}, {_SAVGOL} SELECT recording_id, idx, {_R('v')} AS v FROM smooth")
def savitzky_golay(s, d):
    return _v(samples.savitzky_golay(sig_type(s, d), TYPE_FS))


# --- spectra, rates ---------------------------------------------------------------------------------------------

_DFT = f"""{_USER}, m AS (SELECT recording_id, idx, v - avg(v) {_P} AS v, count(*) {_P} AS n FROM sig), bins AS (SELECT recording_id, n, unnest(range(0, n // 2 + 1)) AS bin FROM (SELECT DISTINCT recording_id, n FROM m) WHERE n > 1),
parts AS (SELECT b.recording_id, b.bin, b.n, sum(v * cos(2 * pi() * b.bin * idx / b.n)) AS re, sum(v * sin(2 * pi() * b.bin * idx / b.n)) AS im FROM bins b JOIN m ON b.recording_id = m.recording_id GROUP BY 1, 2, 3),
dft AS (SELECT recording_id, bin, bin * 10.0 / n AS hertz, (re * re + im * im) / (10.0 * n) * CASE WHEN bin = 0 OR 2 * bin = n THEN 1 ELSE 2 END AS power FROM parts)"""


@query("dft_power", f"WITH {_DFT} SELECT recording_id, bin, {_R('hertz')} AS hertz, round(power, 4) + 0.0 AS power FROM dft")
def dft_power(s, d):
    return kernels.spectrum(_named(s, d)).select("recording_id", "bin", rounded(F.col("hertz")).alias("hertz"), rounded(F.col("power"), 4).alias("power"))


@query("strongest_bin", f"WITH {_DFT} SELECT recording_id, arg_max(bin, power) AS bin FROM dft WHERE bin > 0 GROUP BY 1")
def strongest_bin(s, d):
    """The bin with most power, the first of equals."""
    x = kernels.spectrum(_named(s, d)).filter("bin > 0")
    return x.groupBy("recording_id").agg(F.max_by("bin", F.struct("power", -F.col("bin"))).alias("bin"))


@query("band_snr", f"WITH {_DFT}, x AS (SELECT recording_id, coalesce(sum(power) FILTER (hertz BETWEEN 0.5 AND 4.0), 0) AS s, coalesce(sum(power) FILTER (hertz > 4.0), 0) AS n FROM dft GROUP BY 1) SELECT recording_id, round(CASE WHEN n <= 0 THEN 30.0 ELSE 10 * log10(s / n) END, 5) + 0.0 AS snr_db FROM x")
def band_snr(s, d):
    return beats.band_snr(_named(s, d)).select("recording_id", rounded(F.col("snr_db"), 5).alias("snr_db"))


@query("baseline_drift", f"WITH RECURSIVE {_TYPE}, {_recursive('sig', 'baseline', TYPE_FS)}, d AS (SELECT recording_id, stddev_pop(low.v) AS s, stddev_pop(sig.v) AS t FROM low JOIN sig USING (recording_id, idx) GROUP BY 1) SELECT recording_id, {_R('s')} AS drift_std, {_R('CASE WHEN t > 1e-9 THEN s / t ELSE 0 END')} AS drift_ratio FROM d")
def baseline_drift(s, d):
    return beats.drift(_typed(s, d), blocks.BLOCK).select("recording_id", rounded(F.col("drift_std")).alias("drift_std"), rounded(F.col("drift_ratio")).alias("drift_ratio"))


_VOTE = """c AS (SELECT period, rate, CASE WHEN 60 * rate / period BETWEEN 40 AND 180 THEN exp(-0.5 * power((60 * rate / period - 72) / 25, 2)) ELSE 0.0 END AS likelihood FROM (SELECT DISTINCT p_size AS period FROM part), (SELECT unnest([30.0, 60.0, 100.0, 125.0, 250.0, 500.0, 1000.0]) AS rate))"""


@query("rate_scores", f"WITH {_VOTE} SELECT period, CAST(rate AS DOUBLE) AS rate, {_R('likelihood')} AS likelihood, row_number() OVER (PARTITION BY period ORDER BY likelihood DESC, rate) = 1 AS chosen FROM c")
def rate_scores(s, d):
    """How usual each rate is for periods of 1 to 50 samples, and the vote for each."""
    every = table(s, d, "part").select(F.col("p_size").alias("period")).distinct()
    tried = every.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates.RATES]))).withColumn("likelihood", rates.likelihood(F.col("rate"), F.col("period")))
    vote = rates.votes(every.select(F.lit("x").alias("recording_id"), F.col("period").cast("string").alias("method"), F.col("period").cast("double").alias("period"))).select(F.col("method").cast("int").alias("period"), F.col("rate").alias("voted"))
    return tried.join(vote, "period").select("period", "rate", rounded(F.col("likelihood")).alias("likelihood"), (F.col("rate") == F.col("voted")).alias("chosen"))


@query("rate_entries", r"SELECT doc_id, CAST(coalesce(1000.0 / nullif(try_cast(nullif(regexp_extract(e, '(\d+(?:\.\d+)?)\s*m?sec/sample', 1), '') AS DOUBLE), 0), nullif(try_cast(nullif(regexp_extract(e, '(?:sample\s*rate|sampling\s*rate|sampling\s*freq|fs|frequency)\b.*?(\d+(?:\.\d+)?)\s*(?:hz|samples/sec)?', 1), '') AS DOUBLE), 0)) AS DOUBLE) AS fs FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN doc_id % 9 || ' msec/sample' WHEN 1 THEN 'Sample rate: ' || doc_id % 7 * 50 || ' Hz' WHEN 2 THEN 'fs = 12.5' ELSE text END) AS e FROM documents)")
def rate_entries(s, d):
    i = F.col("doc_id")
    entry = F.when(i % 4 == 0, F.concat((i % 9).cast("string"), F.lit(" msec/sample"))).when(i % 4 == 1, F.concat(F.lit("Sample rate: "), (i % 7 * 50).cast("string"), F.lit(" Hz"))).when(i % 4 == 2, "fs = 12.5").otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", rates.from_entry(entry).alias("fs"))


# --- beats and decisions on what was measured --------------------------------------------------------------------

@query("view_data")
def view_data(s, d):
    """What a view of a recording shows, nested: samples before and after filtering, derivatives, peaks, trends, heat map and
    radars."""
    sig = _kept(s, d)
    keep = staged(scratch(s))
    both = keep(kernels.filtered(sig, "Butterworth", raw=True).drop("error"), "filtered")
    after = both.drop("raw")
    shown = kernels.viewed(both)
    tops = keep(kernels.found_peaks(after, level=True).filter("side = 'peak'"), "tops")
    listed = tops.groupBy("recording_id").agg(F.sort_array(F.collect_list("idx")).alias("peaks"))
    trends = peaks.intervals(tops, TYPE_FS).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("time", "rr", "hr"))).alias("trends"))
    heat = quality.heatmap(sig).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "motion", "drift", "flat"))).alias("heatmap"))
    radar = lambda rows, name: rows.select("recording_id", F.struct(*rows.columns[1:]).alias(name))
    parts = (listed, trends, heat, radar(quality.quality_radar(_measured(s, d, sig)), "quality_radar"), radar(quality.morphology_radar(beats.features(after)), "morphology_radar"))
    about = sig.select("recording_id").distinct()
    for part in parts:
        about = about.join(part, "recording_id", "left")
    return shown.join(keep(about, "about"), "recording_id", "left")  # rows of whole recordings are moved once


@query("view_samples", f"""WITH RECURSIVE {_TYPE}, {_recursive('sig', 'butterworth', TYPE_FS)}, g1 AS (SELECT *, {_grad('v', fs='30')} AS vpg FROM low), g2 AS (SELECT *, {_grad('vpg', fs='30')} AS apg FROM g1)
SELECT recording_id, idx, {_R('idx / 30.0')} AS time, {_R('sig.v')} AS raw, round(g2.v, 4) + 0.0 AS preprocessed, round(vpg, 3) + 0.0 AS vpg, round(apg, 2) + 0.0 AS apg FROM g2 JOIN sig USING (recording_id, idx)""")
def view_samples(s, d):
    """The samples of a view, flat: before and after filtering, with derivatives of the latter."""
    sig = _typed(s, d)
    after = blocks.filtered(sig, "Butterworth").select("recording_id", "idx", "v", "fs")
    bent = samples.derivatives(after, F.col("fs")).join(sig.select("recording_id", "idx", F.col("v").alias("raw")), ["recording_id", "idx"])
    return bent.select("recording_id", "idx", rounded(F.col("idx") / F.col("fs")).alias("time"), rounded(F.col("raw")).alias("raw"), rounded(F.col("v"), 4).alias("preprocessed"), rounded(F.col("vpg"), 3).alias("vpg"), rounded(F.col("apg"), 2).alias("apg"))


# --- what is measured of a recording, in SQL -----------------------------------------------------------------------

_BAND = "CASE WHEN {0} >= 95 THEN 'Excellent' WHEN {0} >= 85 THEN 'Very Good' WHEN {0} >= 70 THEN 'Good' WHEN {0} >= 50 THEN 'Acceptable' ELSE 'Poor' END".format


def _flat_sql(of: str, out: str) -> str:
    return f"{out} AS (SELECT recording_id, idx, v - avg(v) {_P} - coalesce(regr_slope(v, idx) {_P}, 0) * (idx - avg(idx) {_P}) AS v FROM {of})"


def _clip_sql(of: str, out: str) -> str:
    return f"{out}_q AS (SELECT recording_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM {of} GROUP BY 1), {out} AS (SELECT recording_id, idx, CASE WHEN b - a > 1e-9 THEN least(greatest(v, m - 3.5 * (b - a)), m + 3.5 * (b - a)) ELSE v END AS v FROM {of} JOIN {out}_q USING (recording_id))"


def _peaks_sql(of: str, out: str, distance: int, share: float, sign: str = "", absolute: bool = False) -> str:
    """SQL for ``out`` (recording_id, idx, v, prominence, width) of the peaks of a table of samples, with ``sign`` '-' of its
    troughs: maxima, the higher first at a distance, prominence by the nearest higher sample on either side, and the
    crossings of half of it."""
    return f"""{out}_x AS MATERIALIZED (SELECT recording_id, idx, {sign}v AS v FROM {of}),
{out}_f AS (SELECT *, CASE WHEN v = lag(v) {_W} THEN 0 ELSE 1 END AS fresh FROM {out}_x), {out}_n AS (SELECT *, sum(fresh) {_W} AS run FROM {out}_f),
{out}_p AS (SELECT recording_id, run, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM {out}_n GROUP BY recording_id, run),
{out}_m AS (SELECT recording_id, (a + b) // 2 AS idx, v FROM {out}_p QUALIFY v > lag(v) OVER (PARTITION BY recording_id ORDER BY a) AND v > lead(v) OVER (PARTITION BY recording_id ORDER BY a)),
{out}_t AS (SELECT recording_id, list({{'v': v, 'idx': idx}} ORDER BY v DESC, idx DESC) AS t FROM {out}_m GROUP BY 1),
{out}_k AS MATERIALIZED (SELECT recording_id, unnest(list_reduce(list_transform(t, lambda x: [x.idx]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < {distance})) > 0 THEN acc ELSE list_concat(acc, x) END, CAST([] AS BIGINT[]))) AS idx FROM {out}_t),
{out}_h AS (SELECT recording_id, idx, v FROM {out}_k JOIN {out}_x USING (recording_id, idx)),
{out}_e AS (SELECT h.recording_id, h.idx, h.v, max(s.idx) FILTER (s.idx < h.idx AND s.v > h.v) AS l, min(s.idx) FILTER (s.idx > h.idx AND s.v > h.v) AS r FROM {out}_h h JOIN {out}_x s USING (recording_id) GROUP BY ALL),
{out}_o AS (SELECT e.recording_id, e.idx, e.v, e.v - greatest(min(s.v) FILTER (s.idx <= e.idx AND s.idx > coalesce(l, -1)), min(s.v) FILTER (s.idx >= e.idx AND s.idx < coalesce(r, 1000000000))) AS prominence FROM {out}_e e JOIN {out}_x s USING (recording_id) GROUP BY e.recording_id, e.idx, e.v),
{out}_s AS (SELECT recording_id, stddev_pop(v) AS s, max(idx) AS last FROM {out}_x GROUP BY 1),
{out}_g AS MATERIALIZED (SELECT o.*, last, o.v - prominence / 2 AS level FROM {out}_o o JOIN {out}_s USING (recording_id) WHERE prominence >= {share} * CASE WHEN s > 1e-9 AND NOT {absolute} THEN s ELSE 1 END),
{out}_c AS (SELECT g.recording_id, g.idx, max(s.idx) FILTER (s.idx < g.idx AND s.v <= level) AS l, min(s.idx) FILTER (s.idx > g.idx AND s.v <= level) AS r FROM {out}_g g JOIN {out}_x s USING (recording_id) GROUP BY ALL),
{out} AS MATERIALIZED (SELECT g.recording_id, g.idx, {sign}g.v AS v, g.prominence, coalesce(r - (level - b.v) / (b2.v - b.v), g.last) - coalesce(l + (level - a.v) / (a2.v - a.v), 0) AS width FROM {out}_g g JOIN {out}_c c USING (recording_id, idx)
LEFT JOIN {out}_x a ON a.recording_id = g.recording_id AND a.idx = c.l LEFT JOIN {out}_x a2 ON a2.recording_id = g.recording_id AND a2.idx = c.l + 1 LEFT JOIN {out}_x b ON b.recording_id = g.recording_id AND b.idx = c.r LEFT JOIN {out}_x b2 ON b2.recording_id = g.recording_id AND b2.idx = c.r - 1)"""


def _power_sql(of: str, out: str, fs: float) -> str:
    return f"""{out}_m AS (SELECT recording_id, idx, v - avg(v) {_P} AS v, count(*) {_P} AS n FROM {of}), {out}_b AS (SELECT recording_id, n, unnest(range(0, n // 2 + 1)) AS bin FROM (SELECT DISTINCT recording_id, n FROM {out}_m) WHERE n > 1),
{out}_s AS (SELECT b.recording_id, b.bin, b.n, sum(v * cos(2 * pi() * (b.bin * idx % b.n) / b.n)) AS re, sum(v * sin(2 * pi() * (b.bin * idx % b.n) / b.n)) AS im FROM {out}_b b JOIN {out}_m m ON b.recording_id = m.recording_id GROUP BY 1, 2, 3),
{out} AS (SELECT recording_id, bin, bin * {fs} / n AS hertz, (re * re + im * im) / ({fs} * n) * CASE WHEN bin = 0 OR 2 * bin = n THEN 1 ELSE 2 END AS power FROM {out}_s)"""


def _snr_sql(of: str, out: str, fs: float) -> str:
    return f"{_power_sql(of, out + '_w', fs)}, {out} AS (SELECT recording_id, CASE WHEN n <= 0 THEN 30.0 WHEN s <= 0 THEN CAST('-inf' AS DOUBLE) ELSE 10 * log10(s / n) END AS snr_db FROM (SELECT recording_id, coalesce(sum(power) FILTER (hertz BETWEEN 0.5 AND 4.0), 0) AS s, coalesce(sum(power) FILTER (hertz > 4.0), 0) AS n FROM {out}_w GROUP BY 1))"


def _entropy_sql(of: str, out: str) -> str:
    return f"{out}_r AS (SELECT *, min(v) {_P} AS lo, max(v) {_P} AS hi FROM {of}), {out}_h AS (SELECT recording_id, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(floor((v - lo) * 50 / (hi - lo)), 49) END AS bin, count(*) AS c FROM {out}_r GROUP BY ALL), {out}_p AS (SELECT recording_id, c / sum(c) OVER (PARTITION BY recording_id) AS p FROM {out}_h), {out} AS (SELECT recording_id, -sum(p * log2(p)) + 0.0 AS entropy FROM {out}_p GROUP BY 1)"


def _consistency_sql(of: str, tops: str, out: str) -> str:
    """SQL for ``out`` (recording_id, c): the mean correlation of all pairs of beats, made pair by pair."""
    return f"""{out}_t AS (SELECT recording_id, idx AS start, lead(idx) {_W} AS stop FROM {tops}), {out}_l AS (SELECT b.recording_id, start, list(v ORDER BY s.idx) AS l, count(*) AS n FROM {out}_t b JOIN {of} s ON s.recording_id = b.recording_id AND s.idx >= start AND s.idx < stop GROUP BY 1, 2 HAVING count(*) > 5),
{out}_k AS (SELECT recording_id, start, l, n, k, k * (n - 1) // 99 AS low, k * (n - 1) % 99 / 99.0 AS f FROM {out}_l, (SELECT unnest(range(100)) AS k)), {out}_y AS (SELECT recording_id, start, k, l[low + 1] + (l[least(low + 2, n)] - l[low + 1]) * f AS y FROM {out}_k),
{out}_z AS MATERIALIZED (SELECT recording_id, start, k, (y - avg(y) OVER b) / stddev_pop(y) OVER b AS z FROM {out}_y WINDOW b AS (PARTITION BY recording_id, start) QUALIFY stddev_pop(y) OVER b > 1e-9),
{out}_q AS (SELECT a.recording_id, a.start AS i, b.start AS j, sum(a.z * b.z) / 100 AS r FROM {out}_z a JOIN {out}_z b ON a.recording_id = b.recording_id AND a.k = b.k AND a.start < b.start GROUP BY 1, 2, 3), {out} AS (SELECT recording_id, CASE WHEN count(*) >= 3 THEN avg(r) END AS c FROM {out}_q GROUP BY 1)"""


def _skew_sql(v: str) -> str:
    return f"CASE WHEN var_pop({v}) = 0 THEN NULL ELSE (avg({v}*{v}*{v}) - 3*avg({v})*avg({v}*{v}) + 2*avg({v})*avg({v})*avg({v})) / power(var_pop({v}), 1.5) END"


#: The thirteen quality metrics of the clipped signal, and the score: table ``met``.
_MEASURED = f"""{_TYPE}, {_clip_sql('sig', 'cut')}, {_flat_sql('cut', 'level')}, {_peaks_sql('level', 'crests', 12, 0.1)}, {_snr_sql('cut', 'snr', TYPE_FS)}, {_entropy_sql('cut', 'mess')}, {_consistency_sql('level', 'crests', 'cons')},
{_recursive('cut', 'baseline', TYPE_FS)}, wander AS (SELECT recording_id, stddev_pop(low.v) AS s, stddev_pop(cut.v) AS t FROM low JOIN cut USING (recording_id, idx) GROUP BY 1),
jumps AS (SELECT *, v - lag(v) {_W} AS d FROM cut), jump AS (SELECT *, stddev_pop(d) {_P} AS s FROM jumps), moves AS (SELECT recording_id, avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1e-7 THEN 100.0 ELSE 0.0 END) AS flat, avg(CASE WHEN d IS NULL THEN NULL WHEN s > 1e-9 AND abs(d) > 5 * s THEN 100.0 ELSE 0.0 END) AS motion FROM jump GROUP BY 1),
st AS (SELECT recording_id, var_pop(v) AS variance, kurtosis_pop(v) AS kurtosis, {_skew_sql('v')} AS skewness FROM cut GROUP BY 1), pk AS (SELECT recording_id, count(*) AS peak_count, CASE WHEN count(*) > 1 AND avg(prominence) > 1e-9 THEN stddev_pop(prominence) / avg(prominence) ELSE 0 END AS stability FROM crests GROUP BY 1),
met0 AS (SELECT recording_id, snr_db, w.s AS baseline_wander_std, CASE WHEN w.t > 1e-9 THEN w.s / w.t ELSE 0 END AS drift_ratio, motion AS motion_artifact_pct, entropy, variance, kurtosis, skewness, flat AS flat_region_pct, CAST(0 AS DOUBLE) AS missing_data_pct,
CASE WHEN coalesce(peak_count, 0) <= 1 THEN 0.0 ELSE stability END AS peak_stability, CASE WHEN coalesce(peak_count, 0) <= 1 THEN 0.85 ELSE coalesce(c, 0.5) END AS beat_consistency, coalesce(peak_count, 0) AS peak_count
FROM st JOIN snr USING (recording_id) JOIN wander w USING (recording_id) JOIN moves USING (recording_id) JOIN mess USING (recording_id) LEFT JOIN pk USING (recording_id) LEFT JOIN cons USING (recording_id)),
met AS (SELECT *, greatest(0.0, least(100.0, 100 - 3 * missing_data_pct - CASE WHEN flat_region_pct > 1 THEN 2 * (flat_region_pct - 1) ELSE 0 END - CASE WHEN snr_db < 15 THEN 2 * (15 - snr_db) ELSE 0 END - CASE WHEN snr_db < 0 THEN 10 ELSE 0 END - CASE WHEN drift_ratio > 0.1 THEN 40 * (drift_ratio - 0.1) ELSE 0 END
- 15 * motion_artifact_pct - 25 * peak_stability - CASE WHEN beat_consistency < 0.85 THEN 60 * (0.85 - beat_consistency) ELSE 0 END)) AS quality_score FROM met0)"""
_METRIC_NAMES = ("snr_db", "baseline_wander_std", "drift_ratio", "motion_artifact_pct", "entropy", "variance", "kurtosis", "skewness", "flat_region_pct", "missing_data_pct", "peak_stability", "beat_consistency")


def _r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


def _c4(*names: str) -> list[Column]:
    return [rounded(F.col(n), 4).alias(n) for n in names]


def _measured(s: SparkSession, d: str, sig: DataFrame | None = None) -> DataFrame:
    sig = _kept(s, d) if sig is None else sig
    return beats.scored(beats.metrics(sig, sig))


_MET = f"WITH RECURSIVE {_MEASURED} SELECT recording_id"


@query("signal_quality", f"{_MET}, {_r4('snr_db', 'drift_ratio', 'motion_artifact_pct', 'entropy', 'quality_score')}, peak_count, {_BAND('quality_score')} AS quality_band FROM met")
def signal_quality(s, d):
    """Score and band of each recording, and the marks that tell most."""
    return _measured(s, d).select("recording_id", *_c4("snr_db", "drift_ratio", "motion_artifact_pct", "entropy", "quality_score"), "peak_count", "quality_band")


@query("quality_metrics", f"{_MET}, {_r4(*_METRIC_NAMES, 'quality_score')}, peak_count, {_BAND('quality_score')} AS quality_band FROM met")
def quality_metrics(s, d):
    """All thirteen quality metrics of each recording, outliers clipped, with score and band."""
    return _measured(s, d).select("recording_id", *_c4(*_METRIC_NAMES, "quality_score"), "peak_count", "quality_band")


@query("quality_radar", f"""{_MET}, round(greatest(0.0, least(100.0, snr_db / 30 * 100)), 4) + 0.0 AS snr_power, round(greatest(0.0, least(100.0, (1 - drift_ratio) * 100)), 4) + 0.0 AS baseline_stability, round(beat_consistency * 100, 4) + 0.0 AS beat_consistency,
round(greatest(0.0, least(100.0, 100 - flat_region_pct)), 4) + 0.0 AS sensor_connection, round(greatest(0.0, least(100.0, (1 - peak_stability) * 100)), 4) + 0.0 AS amplitude_stability FROM met""")
def quality_radar(s, d):
    x = quality.quality_radar(_measured(s, d))
    return x.select("recording_id", *_c4(*x.columns[1:]))


@query("submetric_status", f"""WITH RECURSIVE {_MEASURED} SELECT recording_id, u.metric AS metric, round(u.value, 4) + 0.0 AS value, CASE WHEN u.ok THEN 'PASS' ELSE 'FAIL' END AS status FROM met, LATERAL (VALUES ('snr_db', snr_db, snr_db >= 15), ('drift_ratio', drift_ratio, drift_ratio < 0.1), ('motion_artifact_pct', motion_artifact_pct, motion_artifact_pct < 1), ('entropy', entropy, entropy > 2 AND entropy < 7),
('flat_region_pct', flat_region_pct, flat_region_pct < 0.1), ('missing_data_pct', missing_data_pct, missing_data_pct = 0), ('peak_stability', peak_stability, peak_stability < 0.2), ('beat_consistency', beat_consistency, beat_consistency >= 0.8)) AS u(metric, value, ok)""")
def submetric_status(s, d):
    return quality.submetric_status(_measured(s, d)).select("recording_id", "metric", *_c4("value"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


@query("penalties", f"{_MET}, round(3 * missing_data_pct, 4) + 0.0 AS missing, round(CASE WHEN drift_ratio > 0.1 THEN (drift_ratio - 0.1) * 40 ELSE 0.0 END, 4) + 0.0 AS drift, round(CASE WHEN beat_consistency < 0.85 THEN (0.85 - beat_consistency) * 60 ELSE 0.0 END, 4) + 0.0 AS consistency FROM met")
def penalties(s, d):
    return quality.penalties(_measured(s, d)).select("recording_id", *_c4("missing", "drift", "consistency"))


@query("quality_table", f"{_MET}, printf('%.2f dB', snr_db) AS snr, printf('%.4f', drift_ratio) AS drift, printf('%.2f%%', motion_artifact_pct) AS motion, printf('%.4f', entropy) AS entropy, printf('%.2f%%', flat_region_pct) AS flat, printf('%.2f%%', missing_data_pct) AS missing, printf('%.4f', peak_stability) AS stability, printf('%.4f', beat_consistency) AS consistency FROM met")
def quality_table(s, d):
    """The quality metrics as they are shown."""
    shown = {"snr": ("%.2f dB", "snr_db"), "drift": ("%.4f", "drift_ratio"), "motion": ("%.2f%%", "motion_artifact_pct"), "entropy": ("%.4f", "entropy"), "flat": ("%.2f%%", "flat_region_pct"), "missing": ("%.2f%%", "missing_data_pct"), "stability": ("%.4f", "peak_stability"), "consistency": ("%.4f", "beat_consistency")}
    return _measured(s, d).select("recording_id", *[F.format_string(f, c).alias(n) for n, (f, c) in shown.items()])


# --- beats, in SQL -------------------------------------------------------------------------------------------------

@query("peak_widths", f"WITH {_TYPE}, {_flat_sql('sig', 'level')}, {_peaks_sql('level', 'tops', 12, 0.1)} SELECT recording_id, idx, round(width, 4) + 0.0 AS width FROM tops")
def peak_widths(s, d):
    return blocks.found_peaks(beats.flat(_typed(s, d))).filter("side = 'peak'").select("recording_id", "idx", *_c4("width"))


@query("beat_overlay", f"""WITH {_TYPE}, {_flat_sql('sig', 'level')}, {_peaks_sql('level', 'tops', 12, 0.1)}, b AS (SELECT recording_id, idx AS start, lead(idx) {_W} AS stop FROM tops)
SELECT b.recording_id, start, {_R('(s.idx - start) * 100 / (stop - start - 1)')} AS x, {_R('s.v')} AS v FROM b JOIN sig s ON s.recording_id = b.recording_id AND s.idx >= start AND s.idx < stop WHERE stop - start > 5""")
def beat_overlay(s, d):
    """Each beat on a scale of 0 to 100."""
    of = peaks.beats(sig_type(s, d), kernels.found_peaks(_typed(s, d), level=True).filter("side = 'peak'"))
    return of.select("recording_id", "start", F.posexplode("beat").alias("k", "v"), F.size("beat").alias("n")).select("recording_id", "start", rounded(F.col("k") * 100 / (F.col("n") - 1)).alias("x"), rounded(F.col("v")).alias("v"))


_ORIENTED = f"""{_TYPE}, {_clip_sql('sig', 'cut')}, {_flat_sql('cut', 'level')}, {_peaks_sql('level', 'tops', 10, 0.1)}, {_peaks_sql('level', 'lows', 10, 0.1, '-')},
st AS (SELECT recording_id, stddev_pop(v) AS std, coalesce({_skew_sql('v')}, 0) AS skew FROM level GROUP BY 1), t AS (SELECT recording_id, avg(prominence) AS p FROM tops GROUP BY 1), l AS (SELECT recording_id, avg(prominence) AS q FROM lows GROUP BY 1),
r AS (SELECT recording_id, std, skew, CASE WHEN p > 0 AND q > 0 THEN p / q WHEN p > 0 THEN 5.0 WHEN q > 0 THEN 0.2 ELSE 1.0 END AS ratio FROM st LEFT JOIN t USING (recording_id) LEFT JOIN l USING (recording_id)),
u AS (SELECT *, CASE WHEN skew > 0.15 THEN least(1.0, 2 * skew) ELSE 0 END + CASE WHEN ratio > 1.2 THEN least(1.0, 1.5 * (ratio - 1)) ELSE 0 END AS up, CASE WHEN skew < -0.15 THEN least(1.0, -2 * skew) ELSE 0 END + CASE WHEN ratio < 0.8 THEN least(1.0, 1.5 * (1 / (ratio + 1e-5) - 1)) ELSE 0 END AS down FROM r),
facing AS (SELECT *, least(1.0, abs(up - down) / 2) AS sure, std < 1e-9 OR up + down = 0 AS unsure FROM u)"""


@query("orientation", f"WITH {_ORIENTED} SELECT recording_id, CASE WHEN unsure OR sure < 0.35 THEN 'uncertain' WHEN up > down THEN 'normal' ELSE 'inverted' END AS orientation, CASE WHEN unsure THEN false WHEN sure < 0.35 THEN skew < 0 ELSE up <= down END AS reverse, round(CASE WHEN unsure THEN 0.0 ELSE sure END, 4) + 0.0 AS confidence FROM facing")
def orientation(s, d):
    return beats.orientation(_kept(s, d)).select("recording_id", "orientation", "reverse", *_c4("confidence"))


def _morphology_sql(of: str, out: str) -> str:
    """SQL for ``out``: the morphology of a table of samples, by its part below 5 Hz; ``out``_level is the table without its line."""
    o = out
    return f"""{_recursive(of, 'low-pass', TYPE_FS, o + '_low')}, {_flat_sql(o + '_low', o + '_slow')}, {_peaks_sql(o + '_slow', o + '_up', 12, 0.05)}, {_peaks_sql(o + '_slow', o + '_down', 12, 0.05, '-')}, {_flat_sql(of, o + '_level')},
{o}_base AS (SELECT recording_id, stddev_pop(v) AS std, sum(abs(v)) / {TYPE_FS} AS total FROM {o}_level GROUP BY 1), {o}_mean AS (SELECT recording_id, avg(v) AS mean FROM {of} GROUP BY 1),
{o}_beat AS (SELECT recording_id, count(*) AS n, (max(idx) - min(idx)) / {TYPE_FS} AS span, avg(width / {TYPE_FS}) AS width, avg(prominence) AS prom FROM {o}_up GROUP BY 1),
{o}_near AS (SELECT u.recording_id, u.idx, max(d.idx) FILTER (d.idx < u.idx) AS before, min(d.idx) FILTER (d.idx > u.idx) AS after FROM {o}_up u LEFT JOIN {o}_down d ON d.recording_id = u.recording_id GROUP BY ALL), {o}_around AS (SELECT recording_id, avg(idx - before) / {TYPE_FS} AS rise, avg(after - idx) / {TYPE_FS} AS decay FROM {o}_near GROUP BY 1),
{o}_high AS (SELECT recording_id, avg(s.v) AS top FROM {o}_up u JOIN {of} s USING (recording_id, idx) GROUP BY 1), {o}_deep AS (SELECT recording_id, avg(s.v) AS bottom FROM {o}_down d JOIN {of} s USING (recording_id, idx) GROUP BY 1),
{o}_all AS (SELECT *, coalesce(n, 0) >= 2 AS many, span / nullif(n - 1, 0) AS r, coalesce(top, mean) - coalesce(bottom, mean) AS swing FROM {o}_base JOIN {o}_mean USING (recording_id) LEFT JOIN {o}_beat USING (recording_id) LEFT JOIN {o}_around USING (recording_id) LEFT JOIN {o}_high USING (recording_id) LEFT JOIN {o}_deep USING (recording_id)),
{o} AS (SELECT recording_id, CAST(coalesce(n, 0) AS DOUBLE) AS peak_count, CASE WHEN many THEN 60 / r ELSE 72.0 END AS hr, CASE WHEN many THEN r ELSE 0.833 END AS rr, CASE WHEN many THEN width ELSE 0.3 END AS pulse_width, CASE WHEN many THEN coalesce(rise, r * 0.3) ELSE 0.25 END AS rise_time, CASE WHEN many THEN coalesce(decay, r * 0.7) ELSE 0.58 END AS decay_time,
CASE WHEN many THEN CASE WHEN swing > 0 THEN swing ELSE 2 * std END WHEN std > 0 THEN 2 * std ELSE 1.0 END AS amplitude, CASE WHEN many THEN total / n WHEN std > 0 THEN std ELSE 0.5 END AS area, CASE WHEN many THEN prom WHEN std > 0 THEN std ELSE 0.5 END AS prominence FROM {o}_all)"""


_MORPHOLOGY_NAMES = ("peak_count", "hr", "rr", "pulse_width", "rise_time", "decay_time", "amplitude", "area", "prominence")


@query("morphology", f"WITH RECURSIVE {_TYPE}, {_morphology_sql('sig', 'mor')} SELECT recording_id, {_r4(*_MORPHOLOGY_NAMES)} FROM mor")
def morphology(s, d):
    return beats.morphology(_kept(s, d)).select("recording_id", *_c4(*_MORPHOLOGY_NAMES))


#: The fourteen features: table ``feat``; and what they are worth: table ``ready``.
_FEATURES = f"""{_TYPE}, {_morphology_sql('sig', 'mor')}, {_peaks_sql('mor_level', 'tops', 12, 0.1)}, {_entropy_sql('sig', 'ent')}, bent1 AS (SELECT *, {_grad('v', fs='30')} AS vpg FROM sig), bent AS (SELECT *, {_grad('vpg', fs='30')} AS apg FROM bent1), power AS (SELECT recording_id, sum(v * v) / count(*) AS energy FROM mor_level GROUP BY 1), slope AS (SELECT recording_id, max(vpg) - min(vpg) AS vpg_range, max(apg) - min(apg) AS apg_range FROM bent GROUP BY 1),
gap AS (SELECT recording_id, idx, (idx - lag(idx) {_W}) / {TYPE_FS} AS rr FROM tops), pair AS (SELECT *, lead(rr) {_W} AS nx FROM gap), sd AS (SELECT recording_id, coalesce(sqrt(0.5 * var_pop(rr - nx)), 0) AS sd1, coalesce(sqrt(0.5 * var_pop(CASE WHEN nx IS NOT NULL THEN rr + nx END)), 0) AS sd2 FROM pair GROUP BY 1),
feat AS (SELECT recording_id, hr AS heart_rate_bpm, rr AS rr_mean_sec, pulse_width AS pulse_width_sec, rise_time AS rise_time_sec, decay_time AS decay_time_sec, amplitude, entropy, energy, area, coalesce(sd1, 0) AS sd1_sec, coalesce(sd2, 0) AS sd2_sec, CASE WHEN sd2 > 1e-9 THEN sd1 / sd2 ELSE 1.0 END AS sd_ratio, vpg_range, apg_range
FROM mor JOIN ent USING (recording_id) JOIN power USING (recording_id) JOIN slope USING (recording_id) LEFT JOIN sd USING (recording_id)),
points AS (SELECT *, CASE WHEN length(recording_id) % 2 = 0 THEN 'FS_UNRESOLVED' ELSE 'PASS' END AS fs_status, 10 * (CAST(heart_rate_bpm BETWEEN 40 AND 160 AS INT) + CAST(rr_mean_sec BETWEEN 0.375 AND 1.5 AS INT) + CAST(pulse_width_sec BETWEEN 0.1 AND 0.6 AS INT) + CAST(rise_time_sec BETWEEN 0.05 AND 0.45 AS INT) + CAST(decay_time_sec BETWEEN 0.1 AND 1.2 AS INT)
+ CAST(entropy BETWEEN 1.5 AND 7.5 AS INT) + CAST(sd1_sec BETWEEN 0.001 AND 0.2 AS INT) + CAST(sd2_sec BETWEEN 0.005 AND 0.4 AS INT) + CAST(amplitude > 1e-6 AS INT) + CAST(vpg_range > 1e-6 AND apg_range > 1e-6 AS INT)) AS raw FROM feat),
ready AS (SELECT recording_id, fs_status, CAST(CASE WHEN fs_status = 'FS_UNRESOLVED' THEN least(raw, 85) ELSE raw END AS INTEGER) AS readiness_score, CASE WHEN raw >= 90 THEN CASE WHEN fs_status = 'FS_UNRESOLVED' THEN 'B' ELSE 'A' END WHEN raw >= 75 THEN 'B' WHEN raw >= 50 THEN 'C' ELSE 'D' END AS readiness_category FROM points)"""


@query("features", f"WITH RECURSIVE {_FEATURES} SELECT recording_id, {_r4(*batch.FEATURES)} FROM feat")
def features(s, d):
    return beats.features(_kept(s, d)).select("recording_id", *_c4(*batch.FEATURES))


def _ready(s: SparkSession, d: str) -> DataFrame:
    """Readiness by measured features; whether a rate is resolved is told by the length of the name."""
    status = F.when(F.length("recording_id") % 2 == 0, "FS_UNRESOLVED").otherwise("PASS")
    return quality.readiness(beats.features(_kept(s, d)).withColumn("fs_status", status))


@query("readiness", f"WITH RECURSIVE {_FEATURES} SELECT * FROM ready")
def readiness(s, d):
    return _ready(s, d).select("recording_id", "fs_status", "readiness_score", "readiness_category")


@query("morphology_radar", f"WITH RECURSIVE {_FEATURES} SELECT recording_id, " + ", ".join(f"round(greatest(0.0, least(100.0, 100 - abs({c} - {m}) / {m} * 100)), 4) + 0.0 AS {c.rsplit('_', 1)[0]}" for c, m in (("heart_rate_bpm", 72.0), ("pulse_width_sec", 0.3), ("rise_time_sec", 0.2), ("decay_time_sec", 0.5))) + " FROM feat")
def morphology_radar(s, d):
    x = quality.morphology_radar(beats.features(_kept(s, d)))
    return x.select("recording_id", *_c4(*x.columns[1:]))


@query("verdict", f"""WITH RECURSIVE {_FEATURES}, g AS (SELECT *, recording_id <> 'view' AS loader_ok, recording_id <> 'click' AS preprocess_ok, CASE WHEN recording_id = 'purchase' THEN 'DEGRADED_FALLBACK' ELSE 'PASSED' END AS guard_status FROM ready),
m AS (SELECT recording_id, list_filter([CASE WHEN NOT loader_ok THEN 'File Loader: Failed to decode, parse, or load signal data.' END, CASE WHEN fs_status = 'FS_UNRESOLVED' THEN 'FS Detector: Sampling frequency is unresolved (cannot compute frequency features).' END, CASE WHEN NOT preprocess_ok THEN 'Preprocessor: Preprocessing failed (NaNs or empty array returned).' END, CASE WHEN guard_status = 'DEGRADED_FALLBACK' THEN 'Morphology Guard: Filtering severely distorted physiological waves, fell back to raw.' END,
CASE WHEN readiness_category = 'D' OR readiness_score < 50 THEN 'Feature Validator: Signal features failed physiological plausibility (readiness: ' || printf('%.1f', CAST(readiness_score AS DOUBLE)) || '%).' END], lambda x: x IS NOT NULL) AS r FROM g)
SELECT recording_id, CASE WHEN len(r) > 0 THEN 'Verification FAIL' ELSE 'Verification PASS' END AS overall_verdict, CASE WHEN len(r) > 0 THEN 'Not ready for biomedical research' ELSE 'Ready for biomedical research' END AS wording, CASE WHEN len(r) > 0 THEN array_to_string(r, '; ') ELSE 'None' END AS failure_reasons FROM m""")
def verdict(s, d):
    """The five rules on measured features; the states of loader, preprocessing and guard by the recording's name."""
    r = F.col("recording_id")
    rows = _ready(s, d).withColumn("loader_ok", r != "view").withColumn("preprocess_ok", r != "click").withColumn("guard_status", F.when(r == "purchase", "DEGRADED_FALLBACK").otherwise("PASSED"))
    v = quality.verdict(rows)
    return v.select("recording_id", "overall_verdict", "wording", F.when(F.size("failure_reasons") > 0, F.array_join("failure_reasons", "; ")).otherwise("None").alias("failure_reasons"))


#: Lags up to which two of the queries ask the autocorrelation, as their SQL says.
_LAGS = 2000


def _votes_sql(most: str) -> str:
    """SQL for ``voted``: votes for a rate by the autocorrelation up to ``most`` lags and the spectrum of whole recordings."""
    return f"""{_TYPE}, mid AS (SELECT recording_id, idx, v - avg(v) {_P} AS v, count(*) {_P} AS n FROM sig), own AS (SELECT recording_id, sum(v * v) AS z, any_value(n) AS n FROM mid GROUP BY 1),
lagged AS (SELECT a.recording_id, b.idx - a.idx AS idx, sum(a.v * b.v) AS s FROM mid a JOIN mid b ON a.recording_id = b.recording_id AND b.idx >= a.idx AND b.idx - a.idx < {most} GROUP BY ALL), acf AS (SELECT recording_id, idx, CASE WHEN z > 0 THEN s / z ELSE s END AS v FROM lagged JOIN own USING (recording_id)),
{_peaks_sql('acf', 'again', 8, 0.05, absolute=True)}, {_power_sql('sig', 'pw', TYPE_FS)}, mag AS (SELECT recording_id, bin AS idx, sqrt(re * re + im * im) AS v FROM pw_s),
hump AS (SELECT *, v > lag(v) {_W} AND v > lead(v) {_W} AS top FROM mag), best AS (SELECT recording_id, arg_min(idx, struct_pack(v := -v, i := idx)) AS bin FROM hump WHERE top GROUP BY 1),
per AS (SELECT recording_id, 'acf' AS method, CAST(min(idx) AS DOUBLE) AS period FROM again GROUP BY 1 UNION ALL SELECT recording_id, m, n / CAST(bin AS DOUBLE) FROM best JOIN own USING (recording_id), (SELECT unnest(['fft', 'psd']) AS m)),
tried AS (SELECT *, CASE WHEN 60 * rate / period BETWEEN 40 AND 180 THEN exp(-0.5 * power((60 * rate / period - 72) / 25, 2)) ELSE 0.0 END AS likelihood FROM per, (SELECT unnest([30.0, 60.0, 100.0, 125.0, 250.0, 500.0, 1000.0]) AS rate)),
voted AS (SELECT recording_id, method, CAST(rate AS DOUBLE) AS rate FROM tried QUALIFY row_number() OVER (PARTITION BY recording_id, method ORDER BY likelihood DESC, rate) = 1)"""


_VOTES = _votes_sql(f"least(a.n // 2, {_LAGS})")


@query("rate_votes", f"WITH {_VOTES} SELECT * FROM voted")
def rate_votes(s, d):
    return rates.votes(kernels.periods(_typed(s, d), _LAGS))


@query("rate_detected", f"""WITH {_VOTES}, many AS (SELECT recording_id, rate, count(*) AS n, min(method) AS first FROM voted GROUP BY 1, 2), est AS (SELECT recording_id, arg_max(rate, struct_pack(n := n, o := -ascii(first), r := rate)) AS rate, max(n) / sum(n) AS agreement FROM many GROUP BY 1),
known AS (SELECT recording_id, coalesce(rate, 100.0) AS est, coalesce(agreement, 0) AS agreement, CASE WHEN length(recording_id) % 2 = 0 THEN 30.0 END AS told FROM (SELECT DISTINCT recording_id FROM sig) LEFT JOIN est USING (recording_id)),
sure AS (SELECT *, CASE WHEN told IS NULL THEN agreement WHEN abs(told - est) / told < 0.1 THEN 1.0 ELSE greatest(0.5, 1 - abs(told - est) / told) END AS c FROM known)
SELECT recording_id, CAST(coalesce(told, est) AS DOUBLE) AS fs, CASE WHEN told IS NULL THEN 'Estimation' ELSE 'Filename Hint' END AS fs_source, {_R('CAST(c AS DOUBLE)')} AS fs_confidence, CASE WHEN c > 0.9 THEN 'PASS' WHEN c >= 0.7 THEN 'WARNING' ELSE 'FS_UNRESOLVED' END AS fs_status FROM sure""")
def rate_detected(s, d):
    """The rate of each recording from its estimate and, for some, a rate that its name gives."""
    known = rates.estimated(_typed(s, d), _LAGS).withColumn("name_fs", rates.from_name(F.concat("recording_id", F.when(F.length("recording_id") % 2 == 0, "_30hz.csv").otherwise(".csv"))))
    none = F.lit(None).cast("double")
    return rates.detected(known.withColumn("user_fs", none).withColumn("meta_fs", none).withColumn("time_fs", none)).select("recording_id", "fs", "fs_source", rounded(F.col("fs_confidence")).alias("fs_confidence"), "fs_status")


_MOST = {c: most for c, (most, _) in beats.GUARD.items()}
_SHIFTS = ", ".join(f"abs(a.{c} - r.{c}) / greatest({least}, r.{c}) AS {c}_deviation" for c, (_, least) in beats.GUARD.items())
#: The first strength of the filter that moves nothing too far: table ``guarded``.
_GUARDED = f"""{', '.join(_recursive('sig', 'butterworth', TYPE_FS, f'g{k}', k) for k in range(3))}, g3 AS (SELECT * FROM sig), {', '.join(_morphology_sql(f'g{k}', f'm{k}') for k in range(4))},
attempts AS ({' UNION ALL '.join(f'SELECT {k} AS attempt, * FROM m{k}' for k in range(4))}), shifts AS (SELECT a.recording_id, a.attempt, {_SHIFTS} FROM attempts a JOIN m3 r USING (recording_id)),
judged AS (SELECT *, {' AND '.join(f'{c}_deviation < {m}' for c, m in _MOST.items())} AS fine FROM shifts),
guarded AS (SELECT *, NOT bool_or(fine) OVER (PARTITION BY recording_id) AS lost FROM judged QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY fine DESC, CASE WHEN fine THEN attempt ELSE -attempt END) = 1)"""
_DEVIATIONS = tuple(f"{c}_deviation" for c in beats.GUARD)


@query("morphology_guard", f"WITH RECURSIVE {_TYPE}, {_GUARDED} SELECT recording_id, attempt, CASE WHEN lost THEN 'DEGRADED_FALLBACK' ELSE 'PASSED' END AS status, lost OR attempt > 0 AS degraded, {_r4(*_DEVIATIONS)} FROM guarded")
def morphology_guard(s, d):
    return beats.guarded(_kept(s, d), "Butterworth").select("recording_id", "attempt", "status", "degraded", *_c4(*_DEVIATIONS))


def _bumps_sql(of: str, out: str) -> str:
    """SQL for ``out`` (recording_id, b): the mean number of peaks of the second derivative in a beat, each beat by itself."""
    o = out
    return f"""{_flat_sql(of, o + '_l')}, {_peaks_sql(o + '_l', o + '_t', 12, 0.1)}, {o}_g AS (SELECT *, {_grad('v', fs='30')} AS vpg FROM {of}), {o}_a AS (SELECT *, {_grad('vpg', fs='30')} AS apg FROM {o}_g), {o}_i AS (SELECT recording_id, idx AS start, lead(idx) {_W} AS stop, count(*) {_P} AS n FROM {o}_t),
{o}_x AS (SELECT a.recording_id || ':' || start AS recording_id, a.idx, apg AS v FROM {o}_i i JOIN {o}_a a ON a.recording_id = i.recording_id AND a.idx >= start AND a.idx < stop WHERE stop - start > 5 AND n >= 3), {_peaks_sql(o + '_x', o + '_p', 1, 0.01)},
{o}_c AS (SELECT recording_id, count(*) AS c FROM {o}_p GROUP BY 1), {o}_b AS (SELECT i.recording_id, avg(coalesce(c, 0)) AS b FROM {o}_i i LEFT JOIN {o}_c c ON c.recording_id = i.recording_id || ':' || start WHERE stop - start > 5 AND n >= 3 GROUP BY 1),
{o} AS (SELECT recording_id, coalesce(b, 1.0) AS b FROM (SELECT DISTINCT recording_id FROM {of}) LEFT JOIN {o}_b USING (recording_id))"""


@query("notch_preserved", f"WITH RECURSIVE {_TYPE}, {_recursive('sig', 'butterworth', TYPE_FS)}, {_bumps_sql('sig', 'own')}, {_bumps_sql('low', 'far')} SELECT recording_id, round(own.b, 4) AS raw, round(far.b, 4) AS filtered, NOT (own.b >= 1.5 AND far.b < 1.2) AS notch_preserved FROM own JOIN far USING (recording_id)")
def notch_preserved(s, d):
    return beats.notch(_kept(s, d), "Butterworth").select("recording_id", *_c4("raw", "filtered"), "notch_preserved")


@query("measured_verdict", f"""WITH RECURSIVE {_FEATURES}, {_GUARDED}, {_votes_sql('a.n // 2').removeprefix(_TYPE + ', ')}, many AS (SELECT recording_id, rate, count(*) AS n, min(method) AS first FROM voted GROUP BY 1, 2), est AS (SELECT recording_id, arg_max(rate, struct_pack(n := n, o := -ascii(first), r := rate)) AS rate FROM many GROUP BY 1),
sure AS (SELECT recording_id, CASE WHEN abs(30 - coalesce(rate, 100)) / 30 < 0.1 THEN 1.0 ELSE greatest(0.5, 1 - abs(30 - coalesce(rate, 100)) / 30) END AS c FROM feat LEFT JOIN est USING (recording_id)),
whole AS (SELECT recording_id, CASE WHEN c > 0.9 THEN 'PASS' WHEN c >= 0.7 THEN 'WARNING' ELSE 'FS_UNRESOLVED' END AS fs_status, CASE WHEN lost THEN 'DEGRADED_FALLBACK' ELSE 'PASSED' END AS guard_status, raw FROM points JOIN sure USING (recording_id) JOIN guarded USING (recording_id)),
graded AS (SELECT recording_id, fs_status, guard_status, CAST(CASE WHEN fs_status = 'FS_UNRESOLVED' THEN least(raw, 85) ELSE raw END AS INTEGER) AS readiness_score, CASE WHEN raw >= 90 THEN CASE WHEN fs_status = 'FS_UNRESOLVED' THEN 'B' ELSE 'A' END WHEN raw >= 75 THEN 'B' WHEN raw >= 50 THEN 'C' ELSE 'D' END AS readiness_category FROM whole),
why AS (SELECT *, list_filter([CASE WHEN fs_status = 'FS_UNRESOLVED' THEN 'FS Detector: Sampling frequency is unresolved (cannot compute frequency features).' END, CASE WHEN guard_status = 'DEGRADED_FALLBACK' THEN 'Morphology Guard: Filtering severely distorted physiological waves, fell back to raw.' END, CASE WHEN readiness_category = 'D' OR readiness_score < 50 THEN 'Feature Validator: Signal features failed physiological plausibility (readiness: ' || printf('%.1f', CAST(readiness_score AS DOUBLE)) || '%).' END], lambda x: x IS NOT NULL) AS r FROM graded)
SELECT recording_id, fs_status, guard_status, readiness_score, readiness_category, CASE WHEN len(r) > 0 THEN 'Verification FAIL' ELSE 'Verification PASS' END AS overall_verdict, CASE WHEN len(r) > 0 THEN 'Not ready for biomedical research' ELSE 'Ready for biomedical research' END AS wording, array_to_string(r, '; ') AS failure_reasons FROM why""")
def measured_verdict(s, d):
    """Readiness and verdict of each recording from its measured features, its estimated rate and the guard."""
    sig = _kept(s, d)
    none = F.lit(None).cast("double")
    rate = rates.detected(rates.estimated(sig).withColumn("user_fs", F.lit(TYPE_FS)).withColumn("meta_fs", none).withColumn("time_fs", none).withColumn("name_fs", none))
    rows = beats.features(sig).join(rate.select("recording_id", "fs_status"), "recording_id").join(beats.guarded(sig, "Butterworth").select("recording_id", F.col("status").alias("guard_status")), "recording_id")
    x = quality.verdict(quality.readiness(rows).withColumn("loader_ok", F.lit(True)).withColumn("preprocess_ok", F.lit(True)))
    return x.select("recording_id", "fs_status", "guard_status", "readiness_score", "readiness_category", "overall_verdict", "wording", F.array_join("failure_reasons", "; ").alias("failure_reasons"))


#: The marks of the seven filters: table ``marks``. A filter of a recording is a series of its own.
_MARKS = f"""{_recursive('sig', 'butterworth', TYPE_FS, 'f1')}, {_recursive('sig', 'chebyshev', TYPE_FS, 'f2')}, {_SAVGOL}, {_GAUSS}, {_MEDIAN}, {_wavelet_sql('sig', 'wave')},
series AS MATERIALIZED ({' UNION ALL '.join(f"SELECT recording_id || ':{k + 1}' AS recording_id, idx, v FROM {t}" for k, t in enumerate(('sig', 'f1', 'f2', 'smooth', 'gauss', '(SELECT recording_id, idx, v FROM med)', 'wave')))}),
{_flat_sql('series', 'even')}, {_peaks_sql('even', 'crest', 12, 0.1)}, {_snr_sql('series', 'pure', TYPE_FS)}, {_consistency_sql('even', 'crest', 'alike')},
shape AS (SELECT s.recording_id, CASE WHEN stddev_pop(s.v) < 1e-9 OR stddev_pop(r.v) < 1e-9 THEN 0 ELSE greatest(0, covar_pop(s.v, r.v) / (stddev_pop(s.v) * stddev_pop(r.v))) * 100 END AS morphology FROM series s JOIN sig r ON r.recording_id = split_part(s.recording_id, ':', 1) AND r.idx = s.idx GROUP BY 1),
num AS (SELECT recording_id, count(*) AS n FROM crest GROUP BY 1), seen AS (SELECT split_part(recording_id, ':', 1) AS recording_id, CAST(split_part(recording_id, ':', 2) AS INTEGER) AS ord, morphology, coalesce(n, 0) AS n, coalesce(c, 0.5) AS c, snr_db FROM shape JOIN pure USING (recording_id) LEFT JOIN num USING (recording_id) LEFT JOIN alike USING (recording_id)),
parts AS (SELECT a.recording_id, [{', '.join(f"'{f}'" for f in beats.FILTERS)}][a.ord] AS filter, a.ord, a.morphology, greatest(0.0, 100 - abs(a.n - r.n) / greatest(1, r.n) * 100) AS peak_retention, a.c * 100 AS beat_similarity, least(100.0, greatest(0.0, 50 + 10 * (a.snr_db - r.snr_db))) AS snr_score, a.snr_db FROM seen a JOIN seen r ON r.recording_id = a.recording_id AND r.ord = 1),
marks AS (SELECT *, 0.4 * morphology + 0.3 * peak_retention + 0.2 * beat_similarity + 0.1 * snr_score AS total_score FROM parts),
chosen AS (SELECT recording_id, max(filter) FILTER (place = 1) AS best, max(total_score) FILTER (place = 1) - max(total_score) FILTER (place = 2) <= 3 AS needs_comparison FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY total_score DESC, ord) AS place FROM marks) GROUP BY 1)"""


@query("full_scoreboard", f"WITH RECURSIVE {_TYPE}, {_MARKS} SELECT recording_id, filter, ord, {_r4('morphology', 'peak_retention', 'beat_similarity', 'snr_score', 'total_score', 'snr_db')}, CAST(NULL AS VARCHAR) AS error FROM marks")
def full_scoreboard(s, d):
    x = beats.scoreboard(_kept(s, d))
    return x.select("recording_id", "filter", "ord", *_c4("morphology", "peak_retention", "beat_similarity", "snr_score", "total_score", "snr_db"), "error")


@query("best_filter", f"WITH RECURSIVE {_TYPE}, {_MARKS} SELECT * FROM chosen")
def best_filter(s, d):
    return beats.best_filter(beats.scoreboard(_kept(s, d)))


_CHECKS = "('File Loader', true), ('FS Detector', true), ('Conditioning Filtering', true), ('Morphology Guard', morphology >= 80), ('Quality Score', quality_score >= 50), ('Feature Category', raw >= 75)"


@query("checklist", f"WITH RECURSIVE {_MEASURED}, {_FEATURES.removeprefix(_TYPE + ', ')}, {_MARKS} SELECT recording_id, u.rule AS rule, CASE WHEN u.ok THEN 'PASS' ELSE 'FAIL' END AS status FROM met JOIN points USING (recording_id) JOIN chosen USING (recording_id) JOIN marks ON marks.recording_id = met.recording_id AND marks.filter = best, LATERAL (VALUES {_CHECKS}) AS u(rule, ok)")
def checklist(s, d):
    """The display's six rules, with limits of their own: retained morphology 80, quality 50, category A or B."""
    sig, keep = _kept(s, d), staged(scratch(s))  # its three parts one after another, so that no task joins what all of them measured
    board = keep(beats.scoreboard(sig), "board")
    best = board.join(beats.best_filter(board).withColumnRenamed("best", "filter"), ["recording_id", "filter"]).select("recording_id", "morphology")
    ready = keep(quality.readiness(beats.features(sig).withColumn("fs_status", F.lit("PASS"))).select("recording_id", "readiness_category"), "ready")
    rows = best.join(keep(_measured(s, d, sig).select("recording_id", "quality_score"), "measured"), "recording_id").join(ready, "recording_id")
    ok = F.expr("stack(6, 'File Loader', true, 'FS Detector', true, 'Conditioning Filtering', true, 'Morphology Guard', morphology >= 80, 'Quality Score', quality_score >= 50, 'Feature Category', readiness_category IN ('A', 'B')) AS (rule, ok)")
    return rows.select("recording_id", ok).select("recording_id", "rule", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


# --- tables that are shown -----------------------------------------------------------------------------------------

@query("feature_table", f"WITH RECURSIVE {_FEATURES} SELECT recording_id, u.metric AS metric, printf('%.4f', u.value) AS value FROM feat, LATERAL (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {n})' for n in batch.FEATURES)}) AS u(metric, value)")
def feature_table(s, d):
    """The features of each recording as they are shown, one row each."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.format_string("%.4f", n).alias("value")) for n in batch.FEATURES])).alias("m")
    return beats.features(_kept(s, d)).select("recording_id", each).select("recording_id", "m.*")


@query("scoreboard_table", f"WITH RECURSIVE {_TYPE}, {_MARKS} SELECT recording_id, filter, printf('%.1f%%', morphology) AS morphology, printf('%.1f%%', peak_retention) AS peak_retention, printf('%.1f%%', beat_similarity) AS beat_similarity, printf('%.1f%%', snr_score) AS snr_score, printf('%.2f%%', total_score) AS total_score, printf('%.2f dB', snr_db) AS snr_db FROM marks")
def scoreboard_table(s, d):
    """The marks of the seven filters as they are shown."""
    percent = {"morphology": "%.1f%%", "peak_retention": "%.1f%%", "beat_similarity": "%.1f%%", "snr_score": "%.1f%%", "total_score": "%.2f%%", "snr_db": "%.2f dB"}
    return beats.scoreboard(_kept(s, d)).select("recording_id", "filter", *[F.format_string(f, c).alias(c) for c, f in percent.items()])


@query("registry_table", "SELECT 'user_' || user_id || '.csv' AS file_name, 'set/user_' || user_id || '.csv' AS path, CASE WHEN user_id % 9 = 0 THEN 'Unsafe' ELSE 'Ready' END AS status, CASE WHEN user_id % 9 = 0 THEN 'File is empty (0 bytes).' ELSE 'Standard CSV with comma delimiter.' END AS note FROM (SELECT DISTINCT user_id FROM events)")
def registry_table(s, d):
    """The scanned files as they are listed."""
    return _as_files(s, d).select(batch.name_of("file_path").alias("file_name"), F.col("file_path").alias("path"), "status", F.col("reason").alias("note"))


# --- files -------------------------------------------------------------------------------------------------------

def _as_files(s: SparkSession, d: str) -> DataFrame:
    """The users' recordings as delimited files, as a scan gives them; every ninth file is damaged."""
    sig = sig_user(s, d)
    line = F.concat((F.col("idx") / USER_FS).cast("string"), F.lit(","), F.col("v").cast("string"))
    text = F.concat(F.lit("device: pulse\ntime,ppg\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n"))
    made = sig.groupBy("recording_id").agg(text.alias("text")).withColumn("text", F.when(F.col("recording_id") % 9 == 0, "").otherwise(F.col("text")))
    path = F.concat(F.lit("set/user_"), F.col("recording_id"), F.lit(".csv"))
    size = F.octet_length("text").cast("long")
    made = files.classified(made.withColumn("file_path", path).withColumn("size", size))
    return made.select("file_path", "status", "reason", F.col("size").alias("file_size_bytes"), files.extension(F.col("file_path")).alias("file_extension"), F.lit("utf-8").alias("encoding"), "text")


@query("file_columns", f"""WITH {_USER}, n AS (SELECT recording_id, count(*) AS n FROM sig WHERE recording_id % 9 <> 0 GROUP BY 1)
SELECT 'set/user_' || recording_id || '.csv' AS file, ['time', 'ppg'] AS columns, CAST(NULL AS VARCHAR) AS id_col, 'time' AS timestamp_col, 'ppg' AS signal_col, CASE WHEN n > 1 THEN round(10 / 60.0, 6) END AS time_fs, true AS loader_ok, n FROM n""")
def file_columns(s, d):
    """Roles of the columns of each file, its rate by its time column, and how many samples it has, by table functions."""
    texts = staged(scratch(s))(_as_files(s, d).filter("status <> 'Unsafe'"), "scan")
    info = recordings.described(tables.layouts_of(texts))
    n = recordings.signals(tables.samples_of(texts), info).groupBy("recording_id").agg(F.count("*").alias("n"))
    return info.drop("n").join(n, "recording_id", "left").select(F.col("recording_id").alias("file"), "columns", "id_col", "timestamp_col", "signal_col", rounded(F.col("time_fs")).alias("time_fs"), "loader_ok", "n")


@query("batch_summary")
def batch_summary(s, d):
    """The whole run over the users' recordings as files."""
    return _analysed_files(s, d).drop("file_path")


def _analysed_files(s: SparkSession, d: str) -> DataFrame:
    keep = staged(scratch(s))
    scan = keep(_as_files(s, d), "scan")
    texts = scan.filter("status <> 'Unsafe'")
    info = keep(recordings.described(tables.layouts_of(texts)), "info")
    signal = keep(recordings.signals(tables.samples_of(texts), info), "samples")
    rows, _, errors = batch.analysed(info, signal, None, keep)
    return batch.summary(scan, keep(rows, "rows"), errors)


@query("batch_shown")
def batch_shown(s, d):
    """The columns of the summary that are shown."""
    return _analysed_files(s, d).select(*batch.SHOWN)


@query("file_round_trip", f"""WITH {_USER} SELECT 'user_' || recording_id || '.csv' AS file, recording_id AS user_id, idx, {_R('idx / 10.0')} AS time, {_R('v')} AS ppg, CAST(CASE WHEN idx % 5 = 0 THEN NULL ELSE 0.0 END AS DOUBLE) IS NULL AS gap FROM sig""")
def file_round_trip(s, d):
    """The users' recordings written as a file each and read back from there, gaps in one column filled."""
    sig = sig_user(s, d)
    name = F.concat(F.lit("user_"), F.col("recording_id").cast("string"), F.lit(".csv"))
    gap = F.when(F.col("idx") % 5 == 0, F.lit("")).otherwise(F.col("idx").cast("string"))
    cells = F.concat_ws(",", (F.col("idx") / USER_FS).cast("string"), gap, F.col("v").cast("string"))
    folder = f"{scratch(s)}/files"
    write_keyed(batch.table_lines(sig, name, F.col("idx"), F.lit("time,step,ppg"), cells), folder)
    back = recordings.frames(s, folder)
    return back.select(batch.name_of("file_path").alias("file"), F.regexp_extract("file_path", r"user_(\d+)\.csv$", 1).cast("long").alias("user_id"), "idx", rounded(F.col("v")[0]).alias("time"), rounded(F.col("v")[2]).alias("ppg"), (F.col("idx") % 5 == 0).alias("gap"))


@query("packed_signals", f"WITH {_TYPE} SELECT recording_id, CAST(count(*) AS INTEGER) AS n FROM sig GROUP BY 1")
def packed_signals(s, d):
    return packed(sig_type(s, d)).select("recording_id", F.size("v").alias("n"))
