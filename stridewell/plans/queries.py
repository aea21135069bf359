"""Queries over the test tables, and DuckDB SQL for the same rows.

Two tables stand in for recordings: events (a series for each user, ratio 2, windows of 8 by 4) and
lineitem (a series for each supplier and return flag, with the default parameters).  Doubles are
rounded where the order of a sum may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TASKS
from ..functions import layers
from ..operators import asof, batchnorm, epochs, features, metrics, moments, signal, splits, stats
from ..shared import new_folder, written
from ..sources import recordings, results
from ..streaming import event_windows
from . import experiment, units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- stand-ins

E_KEYS = ("user_id",)
L_KEYS = ("l_suppkey", "l_returnflag")
L_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
L_CHANNELS = {"acc_x": "l_quantity", "acc_y": "l_extendedprice", "acc_z": "l_discount", "gyro_x": "l_tax", "gyro_y": None, "gyro_z": None}


def e_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.resampled_rows(table(spark, sf_dir, "events"), E_KEYS, ("ts", "event_id"), {"value": "value"}, 2.0)


def e_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.windows_of_rows(e_resampled(spark, sf_dir), E_KEYS, 8, 4)


def l_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.resampled_rows(table(spark, sf_dir, "lineitem"), L_KEYS, L_ORDER, L_CHANNELS, 4.0)


def l_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.windows_of_rows(l_resampled(spark, sf_dir), L_KEYS)


def _sql_resample(source: str, keys: str, order: str, columns: tuple[str, ...], ratio: float) -> str:
    """CTEs s (keys, n, m, v0..) and g (keys, m, j, y0..)."""
    lists = ", ".join(f"list({c}::double order by {order}) v{i}" for i, c in enumerate(columns))
    at = "((j * n) // m + 1)::int"
    y = ", ".join(f"(case when (j * n) % m = 0 then v{i}[{at}] else v{i}[{at}] + (v{i}[(least((j * n) // m + 1, n - 1) + 1)::int] - v{i}[{at}]) * ((j * n) % m) / m end)::float y{i}" for i in range(len(columns)))
    return f"""
    a as (select {keys}, count(*) n, {lists} from {source} group by {keys}),
    s as (select *, greatest(1, round_even(n / {ratio}, 0)::bigint) m from a),
    u as (select *, unnest(range(0, m)) j from s),
    g as (select {keys}, n, m, j, {y} from u)"""


_E = _sql_resample("events", "user_id", "ts, event_id", ("value",), 2.0)
_L = _sql_resample("lineitem", "l_suppkey, l_returnflag", "l_shipdate, l_orderkey, l_linenumber, l_partkey", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 4.0)
_E_WIN = _E + ", w as (select user_id, k widx, j - 4 * k t, y0 from (select *, unnest(range(greatest(0, (j - 4) // 4), j // 4 + 1)) k from g) where k * 4 <= j and j < k * 4 + 8 and k * 4 + 8 <= m)"
_L_WIN = _L + ", w as (select l_suppkey, l_returnflag, k widx, j - 25 * k t, y0, y1, y2, y3 from (select *, unnest(range(greatest(0, (j - 25) // 25), j // 25 + 1)) k from g) where k * 25 <= j and j < k * 25 + 50 and k * 25 + 50 <= m)"


# ---- scans, names, labels


@query("select event_type, count(*) n from events where event_type in ('click', 'view') group by 1")
def a_scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.prune(table(spark, sf_dir, "events").select("event_type"), "event_type", ("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with n as (select case when event_id % 7 = 0 then event_type || '_x_annotated.csv' when event_id % 5 = 0 then event_type || '_' || user_id || '_' || event_id || '.csv'
 else event_type || '_' || user_id || '_' || event_id || '_annotated.csv' end f from events),
p as (select string_split(replace(f, '_annotated.csv', ''), '_') p from n where f like '%\\_annotated.csv' escape '\\')
select p[1] code, p[2]::bigint subj, count(*) n from p where len(p) >= 3 group by 1, 2""")
def a_parse_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    good = F.concat_ws("_", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    name = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("_x_annotated.csv"))).when(F.col("event_id") % 5 == 0, F.concat(good, F.lit(".csv"))).otherwise(F.concat(good, F.lit("_annotated.csv")))
    return recordings.parse_names(e.select(name.alias("f")), "f").groupBy("code", "subj").agg(F.count("*").alias("n"))


@query("select user_id, count(*) n, round(sum(value), 4) total from events where event_type = 'click' group by 1")
def b_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("code", F.lit("click"))
    return recordings.label_filter(e, "event_type").groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


_CODE = "case event_type when 'error' then 'FOL' when 'purchase' then 'BSC' when 'click' then 'WAL' when 'view' then 'STD' else 'JOG' end"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("code", F.expr(_CODE))


@query(f"select case when {_CODE} in ('BSC', 'FKL', 'FOL', 'SDL') then 'FALL' else 'ADL' end y, count(*) n from events group by 1")
def b_task_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).groupBy(signal.task_label("binary", F.col("code")).alias("y")).agg(F.count("*").alias("n"))


@query(f"select {_CODE} y, count(*) n from events where {_CODE} in ('STD', 'WAL', 'JOG', 'JUM', 'STU', 'STN', 'SCH', 'SIT', 'CHU', 'CSI', 'CSO') group by 1")
def b_task_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.prune(_coded(spark, sf_dir), "code", TASKS["adl_only"]).groupBy(signal.task_label("adl_only", F.col("code")).alias("y")).agg(F.count("*").alias("n"))


@query("with d as (select event_type, dense_rank() over (order by event_type) - 1 idx from events) select event_type, idx::int idx, event_type decoded, count(*) n from d group by 1, 2")
def b_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type")
    names = stats.label_index(e, "event_type").select("idx", F.col("event_type").alias("decoded"))
    return stats.encode(e, "event_type").join(names, "idx").groupBy("event_type", "idx", "decoded").agg(F.count("*").alias("n"))


@query("""with c as (select user_id, ts, event_id, event_type, row_number() over o - 1 i, coalesce(lag(event_type) over o <> event_type, false)::int b from events window o as (partition by user_id order by ts, event_id)),
g as (select *, sum(b) over (partition by user_id order by i) run from c) select user_id, run::bigint run, any_value(event_type) event_type, min(i) "first", count(*) size from g group by 1, 2""")
def b_label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of equal labels in each user's events."""
    return epochs.label_runs(table(spark, sf_dir, "events"), E_KEYS, ("ts", "event_id"), "event_type")


# ---- signals


@query(f"with {_E} select user_id, n, m from s")
def c_resample_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.withColumn("m", signal.target_length(F.col("n"), 2.0))


@query(f"with {_E} select user_id, j, round(y0::double, 4) v from g")
def c_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_resampled(spark, sf_dir).select("user_id", "j", r(F.col("v")[0].cast("double"), 4).alias("v"))


@query(f"with {_L_WIN} select l_suppkey, l_returnflag, widx, round(avg(y0::double), 3) c0, round(avg(y1::double), 2) c1, round(avg(y2::double), 4) c2, round(avg(y3::double), 4) c3, 0.0::double c4, 0.0::double c5 from w group by 1, 2, 3")
def c_multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.aggregate(F.col("x")[c], F.lit(0.0), lambda s, v: s + v.cast("double")) / 50 for c in range(6)]
    return l_windows(spark, sf_dir).select(*L_KEYS, F.col("widx").cast("bigint").alias("widx"), *[r(m, d).alias(f"c{i}") for i, (m, d) in enumerate(zip(means, (3, 2, 4, 4, 4, 4), strict=True))])


@query(f"with {_E_WIN} select user_id, widx, count(*) n, round(sum(y0::double), 3) total from w group by 1, 2")
def c_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_windows(spark, sf_dir).select("user_id", F.col("widx").cast("bigint").alias("widx"), F.size(F.col("x")[0]).cast("bigint").alias("n"), r(F.aggregate(F.col("x")[0], F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total"))


@query(f"with {_L} select l_suppkey, l_returnflag, m, 0::bigint n_windows from s where m between 45 and 49")
def c_min_len_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = l_resampled(spark, sf_dir)
    series = rows.filter("j = 0").select(*L_KEYS, "m")
    n = signal.windows_of_rows(rows, L_KEYS).groupBy(*L_KEYS).agg(F.count("*").alias("n_windows"))
    return series.filter(F.col("m").between(45, 49)).join(n, list(L_KEYS), "left").select(*L_KEYS, "m", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


@query(f"with {_L_WIN}, d as (select distinct l_suppkey, l_returnflag, widx from w) select count(*) n, count(distinct l_suppkey) subjects, count(distinct l_returnflag) classes from d")
def c_dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l_windows(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("subjects"), F.countDistinct("l_returnflag").alias("classes"))


@query(f"with {_L_WIN} select l_suppkey, l_returnflag, count(*) // 50 n_windows, round(avg(y0::double), 3) mean_quantity, round(avg(y1::double), 2) mean_price from w group by 1, 2")
def windows_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: windows and channel means of each series."""
    sums = [F.sum(F.aggregate(F.col("x")[c], F.lit(0.0), lambda s, v: s + v.cast("double"))) / (50 * F.count("*")) for c in (0, 1)]
    return l_windows(spark, sf_dir).groupBy(*L_KEYS).agg(F.count("*").alias("n_windows"), r(sums[0], 3).alias("mean_quantity"), r(sums[1], 2).alias("mean_price"))


@query("""with b as (select user_id, min(ts) t0, max(ts) t1 from events group by 1), g as (select user_id, j, t0 + j * interval 12 hour t from b, unnest(range(0, 1 + (epoch_us(t1) - epoch_us(t0)) // 43200000000)) u(j)),
lo as (select user_id, ts, arg_max(value, (event_id, value)) v from events group by 1, 2), hi as (select user_id, ts, arg_min(value, (event_id, value)) v from events group by 1, 2),
p as (select g.*, lo.ts a, lo.v av from g asof join lo on g.user_id = lo.user_id and g.t >= lo.ts), n as (select p.*, hi.ts z, hi.v zv from p asof left join hi on p.user_id = hi.user_id and p.t < hi.ts)
select user_id, j, epoch_us(t) us, round(case when t = a then av else av + (zv - av) * ((epoch_us(t) - epoch_us(a)) / (epoch_us(z) - epoch_us(a))) end, 4) v from n""")
def c_resample_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values twice a day, between their neighbours in time."""
    out = asof.resample_times(table(spark, sf_dir, "events"), E_KEYS, "ts", {"v": "value"}, 12 * 3600 * 10**6, ("event_id",))
    return out.select("user_id", "j", F.unix_micros("ts").alias("us"), r("v", 4).alias("v"))


@query("""with v as (select user_id, ts, arg_max(event_id, event_id) event_id from events where event_type = 'view' group by 1, 2), p as (select * from events where event_type = 'purchase')
select p.event_id, v.event_id seen, (epoch_us(p.ts) - epoch_us(v.ts)) // 1000000 as seconds from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def c_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's last view before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = asof.asof_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), E_KEYS, "ts", ties=("event_id",))
    return out.select("event_id", F.col("match.event_id").alias("seen"), F.expr("(unix_micros(ts) - unix_micros(match.ts)) div 1000000").alias("seconds"))


@query("""with t as (select (max(epoch_us(ts)) // 1000 - 86400000) * 1000 until from events), e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 i from events, t where epoch_us(ts) <= until),
w as (select user_id, k, value from (select *, max(i) over (partition by user_id) top, unnest(range(greatest(0, (i - 4) // 4), i // 4 + 1)) k from e) where 4 * k <= i and i < 4 * k + 8 and 4 * k + 8 <= top + 1)
select user_id, k widx, round(sum(value), 3) total from w group by 1, 2""")
def c_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each user's events, read as a stream, up to a day before the last of them."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    stream = e.select(F.col("user_id").cast("string").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"), "value")
    out = event_windows.windows_so_far(stream, new_folder(spark, "event-windows"), 8, 4, "1 day")
    return out.select(F.col("rec").cast("bigint").alias("user_id"), "widx", r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


# ---- features

_F = """
, x as (select l_suppkey, l_returnflag, widx, t, y0::double a, y1::double b, y2::double c, y3::double d from w),
mg as (select *, sqrt(a * a + b * b + c * c) acc, abs(d) gyr from x),
jk as (select *, abs(acc - lag(acc) over (partition by l_suppkey, l_returnflag, widx order by t)) * 50.0 jerk, case when acc = 0 then 0 else acos(greatest(-1, least(1, c / acc))) end tilt from mg)"""


@query(f"""with {_L_WIN} {_F} select l_suppkey, l_returnflag, widx, round(avg(a), 3) mean_x, round(stddev_pop(a), 3) std_x, round(min(a), 3) min_x, round(max(a), 3) max_x, round(sqrt(avg(a * a)), 3) rms_x,
round(avg(acc), 1) acc_mean, round(max(acc), 1) acc_max, round(max(gyr), 4) gyro_max, round(avg(jerk), 0) jerk_mean, round(max(jerk), 0) jerk_max, round(avg(tilt), 4) tilt_mean, round(max(tilt) - min(tilt), 4) tilt_range from jk group by 1, 2, 3""")
def d_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = features.feature_names()
    got = lambda n, d: r(F.col("feat")[names.index(n)], d)
    pick = {"mean_x": ("acc_x_mean", 3), "std_x": ("acc_x_std", 3), "min_x": ("acc_x_min", 3), "max_x": ("acc_x_max", 3), "rms_x": ("acc_x_rms", 3), "acc_mean": ("acc_mag_mean", 1), "acc_max": ("acc_mag_max", 1), "gyro_max": ("gyro_mag_max", 4), "jerk_mean": ("jerk_mean_abs", 0), "jerk_max": ("jerk_max_abs", 0), "tilt_mean": ("tilt_mean", 4), "tilt_range": ("tilt_range", 4)}
    return features.extract(l_windows(spark, sf_dir)).select(*L_KEYS, F.col("widx").cast("bigint").alias("widx"), *[got(*v).alias(k) for k, v in pick.items()])


@query(f"""with {_L_WIN}, k as (select l_suppkey, l_returnflag, widx, kk, sum(y0::double * cos(2 * pi() * kk * t / 50)) re, sum(y0::double * sin(2 * pi() * kk * t / 50)) im from w, (select unnest(range(1, 26)) kk) group by 1, 2, 3, 4)
select l_suppkey, l_returnflag, widx, round(sum(re * re + im * im), 1) energy from k group by 1, 2, 3""")
def d_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = features.feature_names().index("spectral_energy")
    return features.extract(l_windows(spark, sf_dir)).select(*L_KEYS, F.col("widx").cast("bigint").alias("widx"), r(F.col("feat")[at], 1).alias("energy"))


_CHANNEL = lambda z: f"avg({z}), sqrt(greatest(avg({z} * {z}) - avg({z}) * avg({z}), 0)), min({z}), max({z}), max({z}) - min({z}), sqrt(avg({z} * {z}))"
_KW = "l_suppkey, l_returnflag, widx"
#: All features of each window: feat, a list in the order of feature_names().
_FM = f"""{_L_WIN} {_F},
kp as (select {_KW}, kk, pow(sum(a * cos(2 * pi() * kk * t / 50)), 2) + pow(sum(a * sin(2 * pi() * kk * t / 50)), 2) p, 50 * sum(a * a) whole from x, (select unnest(range(1, 26)) kk) group by {_KW}, kk),
sp as (select {_KW}, sum(p) energy, arg_max(kk, (p, -kk)) bin from (select * replace (case when p > 1e-20 * whole then p else 0 end as p) from kp) group by {_KW}),
fm as (select {_KW}, [{_CHANNEL("a")}, {_CHANNEL("b")}, {_CHANNEL("c")}, {_CHANNEL("d")}, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
avg(acc), sqrt(greatest(avg(acc * acc) - avg(acc) * avg(acc), 0)), max(acc), avg(gyr), sqrt(greatest(avg(gyr * gyr) - avg(gyr) * avg(gyr), 0)), max(gyr), avg(jerk), max(jerk), avg(tilt), max(tilt) - min(tilt), any_value(energy), any_value(bin)]::double[] feat from jk join sp using ({_KW}) group by {_KW})"""
_DIGITS = [*[3] * 6, *[1] * 6, *[4] * 24, *[1] * 3, *[4] * 3, *[0] * 2, *[5] * 2, 1, 0]


@query(f"with {_FM} select {_KW}, unnest(range(0, 48))::int pos, unnest(list_transform(list_zip(feat, {_DIGITS}), lambda z: round(z[1], z[2]::int))) v from fm")
def d_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every window."""
    digits = F.array(*[F.lit(10.0**d) for d in _DIGITS])
    got = features.extract(l_windows(spark, sf_dir)).select(*L_KEYS, F.col("widx").cast("bigint").alias("widx"), F.posexplode("feat").alias("pos", "v"))
    return got.withColumn("v", F.round(F.col("v") * digits[F.col("pos")]) / digits[F.col("pos")])


@query(f"""with {_L_WIN}, ch as (select {_KW}, t, unnest([0, 1, 2, 3]) ch, unnest([y0, y1, y2, y3])::double v from w),
kp as (select {_KW}, ch, kk, pow(sum(v * cos(2 * pi() * kk * t / 50)), 2) + pow(sum(v * sin(2 * pi() * kk * t / 50)), 2) p, 50 * sum(v * v) whole from ch, (select unnest(range(1, 26)) kk) group by {_KW}, ch, kk),
pp as (select {_KW}, ch, kk, case when p > 1e-20 * whole then p else 0 end p, sum(case when p > 1e-20 * whole then p else 0 end) over (partition by {_KW}, ch) e from kp)
select {_KW}, ch::int ch, round(any_value(e) / pow(10, floor(log10(any_value(e)))), 5) energy, arg_max(kk, (p, -kk))::int dominant, round(-sum(case when p > 0 then p / e * ln(p / e) else 0 end) / ln(25), 5) entropy,
round(coalesce(sum(p / e) filter (kk <= 5), 0), 5) low, round(coalesce(sum(p / e) filter (kk > 5 and kk <= 12), 0), 5) mid, round(coalesce(sum(p / e) filter (kk > 12), 0), 5) high from pp group by {_KW}, ch
union all select distinct {_KW}, c::int, 0, 0, 0, 0, 0, 0 from w, (select unnest([4, 5]) c)""")
def d_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy (its mantissa), dominant bin, entropy and bands of every channel."""
    each = features.spectra(l_windows(spark, sf_dir)).select(*L_KEYS, F.col("widx").cast("bigint").alias("widx"), F.posexplode("spectra").alias("ch", "s"))
    mantissa = F.when(F.col("s.energy") > 0, F.col("s.energy") / F.pow(F.lit(10.0), F.floor(F.log10("s.energy")))).otherwise(0.0)
    return each.select(*L_KEYS, "widx", "ch", r(mantissa, 5).alias("energy"), "s.dominant", r("s.entropy", 5).alias("entropy"), *[r(F.col("s.bands")[i], 5).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query(f"""with {_FM}, v as (select {_KW}, unnest(range(0, 48)) pos, unnest(feat) v from fm), f as (select distinct l_suppkey fold from fm),
al as (select fold, pos from f join v on l_suppkey <> fold group by 1, 2 having var_pop(v) > 1e-6),
co as (select fold, a.pos a, b.pos b, corr(x.v, y.v) r from al a join al b using (fold) join v x on x.pos = a.pos and x.l_suppkey <> fold join v y on y.pos = b.pos and x.l_suppkey = y.l_suppkey and x.l_returnflag = y.l_returnflag and x.widx = y.widx where a.pos < b.pos group by 1, 2, 3),
nb as (select al.fold, pos, list_prepend(pos, coalesce(list(a) filter (abs(r) > 0.95), [])) e from al left join co on co.fold = al.fold and b = pos group by 1, 2),
gr as (select fold, list_reduce(list(e order by pos), lambda k, e: case when len(list_intersect(k, e[2:])) = 0 then list_append(k, e[1]) else k end, []::bigint[]) kept from nb group by 1),
st as (select fold, pos, count(*) n_train, avg(v) mu, stddev_pop(v) sd from f join v on l_suppkey <> fold group by 1, 2)
select gr.fold l_suppkey, st.pos::int pos, n_train, case when abs(mu) < 1 then round(mu, 6) else round(mu / pow(10, floor(log10(abs(mu)))), 6) end mu, round(sd / pow(10, floor(log10(sd))), 6) sd from gr, st where st.fold = gr.fold and list_contains(kept, st.pos)""")
def d_select_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that each left-out subject's training windows select, with their means and deviations."""
    folds = moments.select_for_each_fold(features.extract(l_windows(spark, sf_dir)), "l_suppkey", "feat")
    each = folds.select("l_suppkey", "n_train", F.explode(F.arrays_zip("kept", "mu", "sd")).alias("s")).select("l_suppkey", "n_train", "s.*")
    scale = lambda c: F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col(c)))))
    return each.select("l_suppkey", F.col("kept").alias("pos"), "n_train", F.when(F.abs("mu") < 1, r("mu")).otherwise(r(F.col("mu") / scale("mu"))).alias("mu"), r(F.col("sd") / scale("sd")).alias("sd"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a constant and a scaled copy of the first position."""
    e = table(spark, sf_dir, "embeddings")
    x = F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0), F.col("embedding")[0].cast("double") * 2 + F.col("embedding")[1].cast("double") * 0.001))
    return e.select("vec_id", F.col("label").alias("y"), x.alias("feat"))


_V = "v as (select vec_id, label y, list_concat(list_transform(embedding, lambda z: z::double), [1.0::double, embedding[1]::double * 2 + embedding[2]::double * 0.001::double]) feat from embeddings), p as (select vec_id, y, unnest(range(0, 66)) pos, unnest(feat) v from v)"
_C = f"{_V}, k as (select pos from p group by 1 having var_pop(v) > 1e-6), c as (select a.pos::int a, b.pos::int b, corr(a.v, b.v) r from p a, p b where a.vec_id = b.vec_id and a.pos < b.pos and a.pos in (select pos from k) and b.pos in (select pos from k) group by 1, 2)"


@query(f"with {_V} select pos::int pos, round(var_pop(v), 6) var from p group by 1 having var_pop(v) > 1e-6")
def d_variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.variances(_vectors(spark, sf_dir)).filter(F.col("var") > 1e-6).select("pos", r("var").alias("var"))


@query(f"with {_C} select a, b, round(r, 4) r from c where abs(r) > 0.95")
def d_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.correlated_pairs(_vectors(spark, sf_dir), [*range(64), 65]).select("a", "b", r("r", 4).alias("r"))


@query(f"with {_C} select pos::int pos from k where pos not in (select b from c where abs(r) > 0.95)")
def d_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = features.select_positions(_vectors(spark, sf_dir))
    return spark.createDataFrame([(p,) for p in kept], "pos int")


# ---- statistics


@query("select distinct event_type from events")
def e_distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


@query("""with l as (select unnest(range(0, 11))::int as label), c as (select l.label, count(e.label) cnt from l left join embeddings e on e.label = l.label group by 1)
select label, cnt, round(sum(greatest(cnt, 1)) over () / (11.0 * greatest(cnt, 1)), 6) weight from c""")
def e_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.range(11).select(F.col("id").cast("int").alias("label"))
    out = stats.class_weights(table(spark, sf_dir, "embeddings").select("label"), "label", labels)
    return out.select("label", "cnt", r("weight").alias("weight"))


_P = "p as (select vec_id, vec_id % 5 fold, unnest(range(0, 64)) pos, unnest(embedding)::double v from embeddings)"


@query(f"with {_P} select pos::int pos, round(avg(v), 6) mu, round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 6) sd from p group by 1")
def e_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.positions(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("v", F.col("v").cast("double"))
    return stats.standard_stats(long).select("pos", r("mu").alias("mu"), r("sd").alias("sd"))


@query(f"with {_P}, s as (select pos, avg(v) mu, stddev_pop(v) sd from p where fold <> 2 group by 1) select vec_id, p.pos::int pos, round(((v - mu) / sd)::float::double, 3) z from p, s where p.pos = s.pos")
def e_standardize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("fold"), F.col("embedding").cast("array<double>").alias("x"))
    return stats.standardize(e, "x", "fold", 2).select("vec_id", F.posexplode("x").alias("pos", "z")).select("vec_id", "pos", r(F.col("z").cast("double"), 3).alias("z"))


# ---- metrics: the truth is the return flag, the prediction a rule on quantity

_PRED = "case when l_quantity < 15 then 'A' when l_quantity < 40 then 'N' else 'R' end"
_Q = f"q as (select l_returnflag y, {_PRED} p from lineitem)"
_LAB = "l as (select unnest(['A', 'N', 'R', 'X']) as label)"
_CLS = f"{_Q}, {_LAB}, m as (select label, (select count(*) from q where y = label and p = label) tp, (select count(*) from q where y = label) sup, (select count(*) from q where p = label) pr from l), pc as (select *, case when pr = 0 then 0 else tp / pr end pre, case when sup = 0 then 0 else tp / sup end rec, case when sup + pr = 0 then 0 else 2 * tp / (sup + pr) end f1 from m)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.expr(_PRED).alias("p"))


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A",), ("N",), ("R",), ("X",)], "label string")


@query(f"with {_Q} select round(avg((y = p)::int), 6) accuracy from q")
def e_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).agg(r(metrics.accuracy(F.col("y"), F.col("p"))).alias("accuracy"))


@query(f"with {_CLS} select round(avg(rec), 6) balanced_accuracy from pc where sup > 0")
def e_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_predictions(spark, sf_dir), _labels(spark)).select(r("balanced_accuracy").alias("balanced_accuracy"))


@query(f"with {_CLS} select round(avg(f1), 6) macro_f1 from pc")
def e_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_predictions(spark, sf_dir), _labels(spark)).select(r("macro_f1").alias("macro_f1"))


@query(f"with {_Q}, {_LAB} select a.label y, b.label p, count(q.y) n from l a cross join l b left join q on q.y = a.label and q.p = b.label group by 1, 2")
def e_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), _labels(spark))


@query(f"""with {_CLS} select label, round(pre, 6) "precision", round(rec, 6) recall, round(f1, 6) f1, sup support from pc
union all select 'macro avg', round(avg(pre), 6), round(avg(rec), 6), round(avg(f1), 6), sum(sup)::bigint from pc
union all select 'weighted avg', round(sum(pre * sup) / sum(sup), 6), round(sum(rec * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6), sum(sup)::bigint from pc""")
def e_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(_predictions(spark, sf_dir), _labels(spark)).select("label", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for three seeds: a rule that a seed's hash of the row sometimes turns."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("y"), F.explode(F.array(*[F.lit(s) for s in (0, 1, 2)])).alias("seed"))
    bit = F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("event_id").cast("string"))), 1, 1)
    return e.select("seed", "user_id", "event_id", "y", F.when(bit < "8", F.col("y")).when(bit < "c", "view").otherwise("click").alias("p"))


_S = """z as (select event_id, user_id, event_type y, unnest([0, 1, 2])::int seed from events),
b as (select *, substr(md5(seed || ':' || event_id), 1, 1) h from z), q as (select seed, user_id, y, case when h < '8' then y when h < 'c' then 'view' else 'click' end p from b),
l as (select distinct y as label from q)"""
_SC = f"""{_S}, sp as (select seed, y as label, sum((y = p)::int) tp, count(*) sup from q group by 1, 2), pp as (select seed, p as label, count(*) pr from q group by 1, 2),
pc as (select sp.seed, sp.label, tp, sup, coalesce(pr, 0) pr from sp left join pp using (seed, label)), bs as (select seed, sum(tp) / sum(sup) accuracy, avg(tp / sup) balanced_accuracy, avg(2 * tp / (sup + pr)) macro_f1 from pc group by 1)"""


@query(f"""with {_SC} select round(avg(accuracy), 6) accuracy_mean, round(stddev_pop(accuracy), 6) accuracy_sd, round(avg(balanced_accuracy), 6) balanced_accuracy_mean, round(stddev_pop(balanced_accuracy), 6) balanced_accuracy_sd,
round(avg(macro_f1), 6) macro_f1_mean, round(stddev_pop(macro_f1), 6) macro_f1_sd from bs""")
def e_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _seeded(spark, sf_dir)
    out = metrics.over_seeds(metrics.summary(pred, pred.select(F.col("y").alias("label")).distinct(), ["seed"]))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(f"with {_S}, f as (select seed, user_id, avg((y = p)::int) a from q group by 1, 2), o as (select seed, avg((y = p)::int) pooled from q group by 1) select f.seed, round(any_value(pooled), 6) pooled, round(avg(a), 6) by_fold from f join o using (seed) group by 1")
def e_pooled_vs_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _seeded(spark, sf_dir).groupBy("seed", "user_id").agg(F.count("*").alias("n"), F.sum((F.col("y") == F.col("p")).cast("bigint")).alias("hits"))
    return counts.groupBy("seed").agg(r(F.sum("hits") / F.sum("n")).alias("pooled"), r(F.avg(F.col("hits") / F.col("n"))).alias("by_fold"))


# ---- splits


@query("with f as (select label, (row_number() over (partition by label order by md5('0:' || vec_id), vec_id) - 1) % 5 fold from embeddings) select label, fold::int fold, count(*) n from f group by 1, 2")
def f_stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_kfold(table(spark, sf_dir, "embeddings"), "label", "vec_id").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query(f"with {_L_WIN}, d as (select distinct l_suppkey, l_returnflag, widx from w) select l_suppkey, count(*) n_test, (select count(*) from d) - count(*) n_train from d group by 1")
def f_loso_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.loso_sizes(l_windows(spark, sf_dir).select("l_suppkey"), "l_suppkey")


@query("""with t as (select l_suppkey, count(*) n, sum(l_quantity) s, sum(l_quantity * l_quantity) q from lineitem group by 1), a as (select sum(n) n, sum(s) s, sum(q) q from t)
select l_suppkey, (a.n - t.n)::bigint n_train, round((a.s - t.s) / (a.n - t.n), 6) mean, round(sqrt((a.q - t.q) / (a.n - t.n) - pow((a.s - t.s) / (a.n - t.n), 2)), 6) sd from t, a""")
def f_loso_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.loso_stats(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), "l_quantity", "l_suppkey")
    return out.select("l_suppkey", "n_train", r("mean").alias("mean"), r("sd").alias("sd"))


@query(f"""with {_E_WIN}, d as (select distinct user_id, widx from w), f as (select *, (row_number() over (partition by user_id % 3 order by md5('0:' || user_id || '/' || widx), user_id || '/' || widx) - 1) % 5 fold from d),
n as (select *, lag(fold) over o lf, lead(fold) over o rf from f window o as (partition by user_id order by widx)) select count(*) n, sum((coalesce(lf <> fold, false) or coalesce(rf <> fold, false))::int)::bigint n_leaking from n""")
def f_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = e_windows(spark, sf_dir).select("user_id", F.col("widx").cast("bigint").alias("widx"), (F.col("user_id") % 3).alias("y"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("widx").cast("string")).alias("row"))
    return splits.leakage(splits.stratified_kfold(w, "y", "row"), ["user_id"], "widx")


@query("with c as (select l_suppkey, count(*) n from lineitem group by 1) select l_suppkey, n, least(n, 512)::bigint batch, (n // least(n, 512))::bigint full_batches, (n % least(n, 512))::bigint dropped from c")
def f_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    size, full, rest = splits.batch_plan(F.col("n"))
    return c.select("l_suppkey", "n", size.cast("bigint").alias("batch"), full.cast("bigint").alias("full_batches"), rest.cast("bigint").alias("dropped"))


@query(f"with {_E_WIN}, d as (select distinct user_id, widx from w) select user_id, (dense_rank() over (order by user_id) - 1)::int fold, count(*) n from d group by 1")
def f_loso_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.loso(e_windows(spark, sf_dir), "user_id").groupBy("user_id", "fold").agg(F.count("*").alias("n"))

_MIX = lambda x, k: f"((xor(({x} % 1073741824 * 2654435761 + {k}) % 4294967296, (({x} % 1073741824 * 2654435761 + {k}) % 4294967296) >> 15) * 40503) // 256)"
_KEY = lambda k: f"((7 * 1000003 + epoch::bigint * 7919 + {k + 1} * 104729 + 12345) * 69069 % 2147483648)"
_ROUND = lambda src, dst: f"""{dst}1 as (select *, (i // b + {_MIX("(i % b)", _KEY(0))}) % a l1 from {src}), {dst}2 as (select *, (i % b + {_MIX("l1", _KEY(1))}) % b r1 from {dst}1),
{dst}3 as (select *, (l1 + {_MIX("r1", _KEY(2))}) % a l2 from {dst}2), {dst} as (select epoch, n, a, b, q, l2 * b + (r1 + {_MIX("l2", _KEY(3))}) % b i from {dst}3)"""  # noqa: E731


@query(f"""with recursive s as (select count(*) n, ceil(sqrt(count(*)))::bigint a from lineitem), t as (select n, a, (n + a - 1) // a b from s),
z as (select l_quantity q, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 i, n, a, b from lineitem, t), e as (select z.*, epoch from z, (select unnest([0, 1]) epoch)),
{_ROUND("e", "p")}, w(epoch, n, a, b, q, i) as (select * from p union all select epoch, n, a, b, q, l2 * b + (r1 + {_MIX("l2", _KEY(3))}) % b from (select *, (l1 + {_MIX("r1", _KEY(2))}) % a l2 from (select *, (i % b + {_MIX("l1", _KEY(1))}) % b r1
from (select *, (i // b + {_MIX("(i % b)", _KEY(0))}) % a l1 from w where i >= n)))) select epoch, i // least(n, 512) batch, count(*) n_rows, round(sum(q), 2) quantity from w where i < n and i // least(n, 512) < n // least(n, 512) group by 1, 2""")
def f_epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and quantity of each batch of two epochs."""
    own = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # written, as every epoch reads it
    rows = written(epochs.numbered(own, own.columns).select("row", "n", "l_quantity"), "epoch-rows")
    return epochs.epoch_batches(rows, 2, seed=7).groupBy("epoch", "batch").agg(F.count("*").alias("n_rows"), r(F.sum("l_quantity"), 2).alias("quantity"))


# ---- layers and losses

_EV = "e as (select vec_id, label, list_transform(embedding, lambda z: z::double) x from embeddings)"


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query(f"with {_EV}, c as (select vec_id, unnest(range(1, 65)) t, x from e) select vec_id, (t - 1)::int t, round(greatest(0.5 * coalesce(case when t > 1 then x[t - 1] end, 0) + x[t] - 0.25 * coalesce(x[t + 1], 0) + 0.1, 0), 6) v from c")
def g_conv1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = layers.relu(layers.conv1d(F.col("x"), (0.5, 1.0, -0.25), 0.1))
    return _doubles(spark, sf_dir).select("vec_id", F.posexplode(y).alias("t", "v")).select("vec_id", "t", r("v").alias("v"))


@query(f"with {_EV}, c as (select vec_id, unnest(range(0, 21)) t, x from e) select vec_id, t::int t, round(greatest(x[3 * t + 1], x[3 * t + 2], x[3 * t + 3]), 6) v from c")
def g_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(spark, sf_dir).select("vec_id", F.posexplode(layers.maxpool(F.col("x"), 3)).alias("t", "v")).select("vec_id", "t", r("v").alias("v"))


@query(f"with {_EV}, u as (select vec_id, unnest(x[1:32]) s, unnest(x[33:64]) v from e), m as (select *, max(s) over (partition by vec_id) top from u) select vec_id, round(sum(exp(s - top) * v) / sum(exp(s - top)), 6) pooled from m group by 1")
def g_softmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _doubles(spark, sf_dir).select("vec_id", r(layers.softmax_pool(F.slice(x, 1, 32), F.slice(x, 33, 32))).alias("pooled"))


@query(f"""with {_EV}, k as (select vec_id, unnest(range(1, 8)) i, x from e), s as (select vec_id, i, x, list_dot_product(x[1:8], x[8 * i + 1:8 * i + 8]) / 2.8284271247461903 s from k),
w as (select *, exp(s - max(s) over (partition by vec_id)) w from s), d as (select vec_id, w, unnest(range(0, 8)) d, unnest(x[8 * i + 1:8 * i + 8]) v from w) select vec_id, d::int d, round(sum(w * v) / sum(w), 6) v from d group by 1, 2""")
def g_cross_attn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.slice(F.col("x"), i * 8 + 1, F.lit(8)))
    e = _doubles(spark, sf_dir).withColumn("k", rows)
    got = layers.attend(F.slice("x", 1, 8), F.col("k"), F.col("k"), 8**0.5)
    return e.select("vec_id", F.posexplode(got).alias("d", "v")).select("vec_id", "d", r("v").alias("v"))


@query(f"with {_EV} select round(1 - avg(list_dot_product(x[1:32], x[33:64]) / (sqrt(list_dot_product(x[1:32], x[1:32])) * sqrt(list_dot_product(x[33:64], x[33:64])))), 6) loss from e")
def g_cosine_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(spark, sf_dir).agg(r(layers.consistency_loss(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("loss"))


_CE = f"{_EV}, cw as (select label, (select count(*) from e) / (10.0 * count(*)) cw from e group by 1), lo as (select e.label, cw, x, list_max(x[1:10]) top from e join cw on e.label = cw.label), ce as (select cw, x, ln(list_sum(list_transform(x[1:10], lambda v: exp(v - top)))) + top - x[label + 1] ce from lo)"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _doubles(spark, sf_dir)
    return e.join(stats.class_weights(e, "label", e.select("label").distinct()).select("label", "weight"), "label")


@query(f"with {_CE} select round(sum(cw * ce) / sum(cw), 6) loss from ce")
def g_weighted_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    ce = layers.cross_entropy(F.slice("x", 1, 10), F.col("label"))
    return _weighted(spark, sf_dir).agg(r(layers.weighted_mean(ce, F.col("weight"))).alias("loss"))


@query(f"with {_CE} select round(sum(cw * ce) / sum(cw) + 0.3 * (1 - avg(list_dot_product(x[1:32], x[33:64]) / (sqrt(list_dot_product(x[1:32], x[1:32])) * sqrt(list_dot_product(x[33:64], x[33:64]))))), 6) loss from ce")
def g_combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    ce = layers.weighted_mean(layers.cross_entropy(F.slice("x", 1, 10), F.col("label")), F.col("weight"))
    return _weighted(spark, sf_dir).agg(r(layers.combined_loss(ce, layers.consistency_loss(F.slice("x", 1, 32), F.slice("x", 33, 32)))).alias("loss"))


@query(f"with {_EV}, p as (select vec_id, unnest(range(0, 32)) i, unnest(x[1:32]) w, unnest(x[33:64]) g, sqrt(list_dot_product(x[33:64], x[33:64])) n from e) select vec_id, i::int i, round(w + g * 0.05 / (n + 1e-12), 6) w from p")
def g_sam_perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = layers.sam_perturbed(F.slice("x", 1, 32), F.slice("x", 33, 32))
    return _doubles(spark, sf_dir).select("vec_id", F.posexplode(moved).alias("i", "w")).select("vec_id", "i", r("w").alias("w"))


@query(f"with {_EV} select vec_id, list_position(x, list_max(x))::bigint - 1 p from e")
def g_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(spark, sf_dir).select("vec_id", layers.argmax(F.col("x")).cast("bigint").alias("p"))


@query(f"""with {_EV}, f as (select *, (vec_id % 5)::int fold from e), u as (select vec_id, label, fold, unnest(range(0, 64)) pos, unnest(x) v from f),
s as (select label, fold, pos, sum(v) s, count(*) n from u group by 1, 2, 3), t as (select label, pos, sum(s) s, sum(n) n from s group by 1, 2),
c as (select t.label, s.fold, t.pos, (t.s - s.s) / (t.n - s.n) m from t join s on t.label = s.label and t.pos = s.pos), d as (select u.vec_id, u.label y, c.label p, sum((u.v - c.m) * (u.v - c.m)) d from u join c on u.fold = c.fold and u.pos = c.pos group by 1, 2, 3)
select y, p, count(*) n from (select vec_id, y, arg_min(p, (round(d, 8), p)) p from d group by 1, 2) group by 1, 2""")
def g_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier in plain operators: the nearest class mean of the other folds, by totals less the fold's own part."""
    e = _doubles(spark, sf_dir).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    means = nearest_centroids(e, "label", "fold", "x")
    square = layers.total(F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)))
    best = e.join(means, "fold").groupBy("vec_id", F.col("label").alias("y")).agg(F.min(F.struct(F.round(square, 8).alias("d"), F.col("class").alias("p"))).alias("best"))
    return best.groupBy("y", F.col("best.p").alias("p")).agg(F.count("*").alias("n"))


def nearest_centroids(df: DataFrame, y: str, fold: str, x: str) -> DataFrame:
    """fold, class and center: means of each class over the rows outside each fold."""
    own = df.select(F.col(y).alias("class"), fold, F.posexplode(x).alias("pos", "v")).groupBy("class", fold, "pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("class", "pos")
    rest = own.select("class", fold, "pos", F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")).alias("m"))
    return rest.groupBy(fold, "class").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c")).select(fold, "class", F.col("c.m").alias("center"))


@query(None)
def g_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks trained on all windows outside each fold: predictions of every window."""
    from ..models import train

    w = train.stand_in_windows(l_windows(spark, sf_dir).withColumnsRenamed({"l_suppkey": "subj", "l_returnflag": "y"}))
    folded = splits.stratified_kfold(w, "y", "window_id", 3)
    return train.fit_predict(folded, mode="fic", seeds=(0,), epochs=2)


def _linear(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from dataclasses import replace

    from ..config import DEFAULTS
    from ..models import linear

    row = F.concat_ws("/", F.col("l_suppkey").cast("string"), "l_returnflag", F.col("widx").cast("string"))
    w = features.extract(l_windows(spark, sf_dir)).select(row.alias("window_id"), F.col("l_returnflag").alias("y"), "feat")
    return linear.fit_predict_linear(splits.stratified_kfold(w, "y", "window_id"), mode, settings=replace(DEFAULTS, lr=0.05))


@query(None)
def g_linear_erm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every window by softmax regression on the other folds, trained where the windows are."""
    return _linear(spark, sf_dir, "erm")


@query(None)
def g_linear_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by sharpness-aware minimisation, two passes a step."""
    return _linear(spark, sf_dir, "sam")


_BN = """u as (select vec_id, vec_id // 64 batch, unnest(range(0, 64)) // 8 ch, unnest(range(0, 64)) % 8 t, unnest(embedding)::double v from embeddings),
bs as (select batch, ch, count(*) n, avg(v) mean, var_pop(v) var from u group by 1, 2), bl as (select *, 0.1 * pow(0.9, max(batch) over () - batch) w, max(batch) over () last from bs),
rs as (select ch, sum(w * mean) mean, pow(0.9, any_value(last) + 1) + sum(w * var * n / (n - 1)) var from bl group by 1)"""


@query(f"""with {_BN}, f as (select 'train' form, vec_id, u.ch, t, (v - mean) / sqrt(var + 1e-5) z from u join bs using (batch, ch) union all select 'infer', vec_id, u.ch, t, (v - mean) / sqrt(var + 1e-5) from u join rs using (ch))
select form, vec_id, ch::int ch, round(sum(z), 5) total, round(sum(z * z), 5) squares, round(max(z), 5) most from f group by 1, 2, 3""")
def g_batchnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 channels of 8, in batches of 64 ids: sums of the normalised values in both forms."""
    e = _doubles(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 64))
    running = batchnorm.running_statistics(batchnorm.batch_statistics(e, "batch", "x", 8))
    both = batchnorm.normalize_batches(e, "batch", "x", 8).withColumn("form", F.lit("train")).unionByName(batchnorm.normalize_running(e, running, "x", 8).withColumn("form", F.lit("infer")))
    part = both.select("form", "vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("x", c * 8 + 1, F.lit(8)))).alias("ch", "z"))
    return part.select("form", "vec_id", "ch", r(layers.total(F.col("z")), 5).alias("total"), r(layers.dot(F.col("z"), F.col("z")), 5).alias("squares"), r(F.array_max("z"), 5).alias("most"))


# ---- experiments


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of cross-validation, and one for each nation with items: the subjects of leave-one-out."""
    suppliers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    subjects = suppliers.join(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_nationkey").alias("subj")).distinct()
    loso = splits.loso(subjects, "subj").select(F.lit("loso").alias("protocol"), "fold")
    return spark.range(5).select(F.lit("cv").alias("protocol"), F.col("id").cast("int").alias("fold")).unionByName(loso)


_PLAN = """f as (select 'cv' protocol, unnest(range(0, 5))::int fold union all select 'loso', (dense_rank() over (order by s_nationkey) - 1)::int from (select distinct s_nationkey from lineitem join supplier on l_suppkey = s_suppkey)),
plan as (select task, mode, s.protocol, seed::int seed, fold, mode in ('fic', 'sam_fic') uses_features from (select unnest(['binary', 'adl_only', 'fall_only', 'flat15']) task), (select unnest(['erm', 'sam', 'fic', 'sam_fic']) mode),
(select * from (values ('cv', 0), ('cv', 1), ('cv', 2), ('loso', 0)) v(protocol, seed)) s join f on s.protocol = f.protocol)"""


@query(f"with {_PLAN} select * from plan")
def h_work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.work_plan(spark, _folds(spark, sf_dir)).drop("settings")


@query(f"with {_PLAN} select task, mode, protocol, seed, fold from plan where not (task = 'binary' and protocol = 'cv' and seed < 2)")
def h_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = experiment.work_plan(spark, _folds(spark, sf_dir))
    return experiment.remaining(plan, plan.filter("task = 'binary' and protocol = 'cv' and seed < 2")).select(*experiment.UNIT)


@query(f"with {_PLAN} select task, mode, protocol, seed, fold from plan where not (task = 'binary' and mode in ('erm', 'sam') and (protocol = 'loso' or seed < 2))")
def h_resume_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a plan after a run that committed some of its parts to a folder."""
    plan = experiment.work_plan(spark, _folds(spark, sf_dir))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("y")).distinct()
    own = rows.select((F.col("l_suppkey") % 5).cast("int").alias("at"), "l_suppkey", "y")

    def predict(todo: DataFrame) -> DataFrame:
        each = todo.join(own, F.col("fold") % 5 == F.col("at"))
        return each.select(*experiment.UNIT, "settings", F.col("l_suppkey").alias("window_id"), "y", F.lit("N").alias("p"))

    folder = new_folder(spark, "units")
    units.run_units(plan.filter("task = 'binary' and mode in ('erm', 'sam') and (protocol = 'loso' or seed < 2)"), folder, predict)
    return units.remaining_units(plan, folder).select(*experiment.UNIT)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the seeded stand-in: seeds 0 and 1 as cv, 2 as loso, by every mode."""
    pred = _seeded(spark, sf_dir).withColumn("task", F.lit("flat")).withColumn("protocol", F.when(F.col("seed") == 2, "loso").otherwise("cv")).withColumn("mode", F.explode(F.array(F.lit("erm"), F.lit("fic")))).withColumn("fold", (F.col("user_id") % 5).cast("int"))
    return experiment.results(pred, pred.select(F.col("y").alias("label")).distinct())


_RES = f"""{_SC}, rs as (select case when seed = 2 then 'loso' else 'cv' end protocol, avg(accuracy) am, stddev_pop(accuracy) asd, avg(balanced_accuracy) bm, stddev_pop(balanced_accuracy) bsd, avg(macro_f1) fm, stddev_pop(macro_f1) fsd, count(*) n_seeds from bs group by 1),
md as (select unnest(['erm', 'fic']) mode)"""


@query(f"""with {_RES}, lq as (select case when seed = 2 then 'loso' else 'cv' end protocol, y, p, count(*) n from q where seed in (1, 2) group by 1, 2, 3)
select 'flat' task, mode, rs.protocol, round(am, 6) accuracy_mean, round(asd, 6) accuracy_sd, n_seeds::int n_seeds, (select sum(n)::bigint from lq where lq.protocol = rs.protocol and y = p) hits_last_seed, case when mode = 'fic' then 'Adam' else 'none' end optimizer from rs, md""")
def h_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON files and read again."""
    res, folder = _results(spark, sf_dir), new_folder(spark, "results")
    results.write_results(res, folder)
    back = results.read_results(spark, folder, res.schema)
    hits = F.aggregate(F.col("confusion_last_seed"), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c["y"] == c["p"], c["n"]).otherwise(0))
    return back.select("task", "mode", "protocol", r("accuracy_mean").alias("accuracy_mean"), r("accuracy_sd").alias("accuracy_sd"), F.size("per_seed").alias("n_seeds"), hits.alias("hits_last_seed"), F.coalesce("feature_settings.optimizer", F.lit("none")).alias("optimizer"))


@query(f"with {_RES} select 'flat' task, mode, protocol, printf('%.4f +/- %.4f', am, asd) accuracy, printf('%.4f +/- %.4f', bm, bsd) balanced_accuracy, printf('%.4f +/- %.4f', fm, fsd) macro_f1 from rs, md")
def h_summary_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as a CSV file and read again."""
    folder = new_folder(spark, "summary")
    results.write_summary(experiment.summary_rows(_results(spark, sf_dir)), folder)
    return results.read_summary(spark, folder)


@query(f"with {_RES} select 'flat' task, mode, round(max(case when protocol = 'cv' then am end) - max(case when protocol = 'loso' then am end), 6) accuracy_gap, round(max(case when protocol = 'cv' then bm end) - max(case when protocol = 'loso' then bm end), 6) balanced_accuracy_gap, round(max(case when protocol = 'cv' then fm end) - max(case when protocol = 'loso' then fm end), 6) macro_f1_gap from rs, md group by mode")
def h_generalization_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiment.generalization_gap(_results(spark, sf_dir))
    return out.select("task", "mode", *[r(c).alias(c) for c in out.columns[2:]])


@query("select event_type, user_id % 2 part, count(*) n from events group by 1, 2")
def i_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("part"))
    pooled = e.filter("part = 0").unionByName(e.filter("part = 1"))
    return pooled.groupBy("event_type", "part").agg(F.count("*").alias("n"))
