"""Registered queries: the operators over stand-in domains made from the driver's tables, with SQL that was derived apart from them.

Doubles are rounded, as sums differ in their last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import changepoint as P
from ..operators import classifier as K
from ..operators import histogram as H
from ..operators import joins as J
from ..operators import reporter as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema))


# ---------------------------------------------------------------- stand-ins

#: Events of a user in order are the frames of a cell.
E_SQL = "e AS (SELECT user_id, event_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(w) - 1).alias("t"))


P_SQL = E_SQL + ", p AS (SELECT (user_id % 7)::INT AS pos, 'S' || (user_id % 5) AS sample, user_id AS crop, t, event_type <> 'error' AS label FROM e)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("user_id") % 7).cast("int").alias("pos"), F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("sample"), F.col("user_id").alias("crop"), "t", (F.col("event_type") != "error").alias("label"))


S_SQL = E_SQL + ", s AS (SELECT (user_id % 3)::INT AS sample_idx, (user_id % 7)::INT AS pos, user_id AS roi, t, value + CASE WHEN t >= user_id % 40 AND user_id % 3 = 0 THEN 400.0 ELSE 0.0 END AS v FROM e)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when((F.col("t") >= F.col("user_id") % 40) & (F.col("user_id") % 3 == 0), F.lit(400.0)).otherwise(F.lit(0.0))
    return events(spark, sf_dir).select((F.col("user_id") % 3).cast("int").alias("sample_idx"), (F.col("user_id") % 7).cast("int").alias("pos"), F.col("user_id").alias("roi"), "t", (F.col("value") + step).alias("v"))


M_SQL = "m AS (SELECT n_nationkey::INT AS sample_idx, r_name AS name, [n_nationkey::INT, n_nationkey::INT + 25] AS positions, [1, 2] AS signal FROM nation JOIN region ON n_regionkey = r_regionkey)"


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("int")
    return rows.select(key.alias("sample_idx"), F.col("r_name").alias("name"), F.array(key, key + 25).alias("positions"), F.array(F.lit(1), F.lit(2)).alias("signal"), F.lit(0).alias("segmentation"))


V_SQL = "vv AS (SELECT vec_id, embedding::DOUBLE[] AS vector, label, vec_id % 5 = 0 AS is_query FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))
    references = rows.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("ref_idx"), F.col("vec_id").cast("string").alias("id"), "label", "vector")
    return references, rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), "label", "vector")


# ---------------------------------------------------- classifier calls, 2.5


@query(f"WITH {P_SQL} SELECT pos, sample, crop, t, bool_and(label) OVER (PARTITION BY pos, sample, crop ORDER BY t ROWS UNBOUNDED PRECEDING) AS label FROM p")
def d1_monotone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_monotone(predictions(spark, sf_dir))


D3_SQL = (
    P_SQL
    + """, f AS (SELECT *, avg(label::INT) OVER (PARTITION BY crop ORDER BY t RANGE UNBOUNDED PRECEDING) AS share FROM p),
    g AS (SELECT pos, sample, crop, min(t) AS t0, coalesce(max(t) FILTER (WHERE label AND share >= 0.8), min(t) FILTER (WHERE label)) AS final FROM f GROUP BY pos, sample, crop),
    dt AS (SELECT pos, sample, crop, CASE WHEN final IS NULL OR final = t0 THEN 0 ELSE final END AS death_time FROM g)"""
)


@query(f"WITH {D3_SQL} SELECT * FROM dt")
def d3_death_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.death_times(predictions(spark, sf_dir))


@query(f"""WITH {D3_SQL}, x AS (SELECT sample, max(death_time) AS hi FROM dt WHERE death_time > 0 GROUP BY sample)
    SELECT x.sample, i.t::INT AS t, (SELECT count(*) FROM dt WHERE dt.sample = x.sample AND death_time > 0 AND death_time >= i.t) AS n_alive
    FROM x, (SELECT unnest(range(0, 1000)) AS t) i WHERE i.t <= x.hi""")
def a9_classifier_kill_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kill_curve(K.death_times(predictions(spark, sf_dir)))


# ------------------------------------------------------ reporter calls, 2.5

R_SQL = (
    S_SQL
    + """, n AS (SELECT *, row_number() OVER w AS rn, abs(v - lag(v) OVER w) AS d FROM s WINDOW w AS (PARTITION BY sample_idx, pos, roi ORDER BY t)),
    st AS (SELECT sample_idx, pos, roi, quantile_cont(v, 0.5) FILTER (WHERE rn <= 3) AS early, coalesce(quantile_cont(d, 0.5), 0) / 0.9539 AS sigma, max(v) AS peak, count(*) AS len, quantile_cont(v, 0.5) AS med, min(t) AS t0 FROM n GROUP BY ALL),
    c0 AS (SELECT quantile_cont(early, 0.25) AS base, quantile_cont(sigma, 0.5) FILTER (WHERE sigma > 1e-9) AS sg, count(*) AS k FROM st),
    c AS (SELECT base, k, coalesce(sg, greatest(abs(base) * 0.05, 1)) AS noise FROM c0),
    cal AS (SELECT *, greatest(6 * noise, abs(base) * 0.5, 10) AS min_step FROM c),
    sp AS (SELECT n.*, sigma, noise, min_step, quantile_cont(v, 0.5) OVER bw AS pre, quantile_cont(v, 0.5) OVER fw AS post, quantile_cont(v, 0.5) OVER hw AS held,
        coalesce(var_pop(v) OVER bw * count(*) OVER bw, 0) + coalesce(var_pop(v) OVER fw * count(*) OVER fw, 0) AS sse, coalesce(quantile_cont(d, 0.5) OVER bw, 0) / 0.9539 AS ps
        FROM n JOIN st USING (sample_idx, pos, roi), cal
        WINDOW bw AS (PARTITION BY sample_idx, pos, roi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        fw AS (PARTITION BY sample_idx, pos, roi ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        hw AS (PARTITION BY sample_idx, pos, roi ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    ok AS (SELECT *, post - pre AS step, greatest(min_step, 6 * sigma, abs(pre) * 0.5) AS th FROM sp WHERE rn > 1),
    bs AS (SELECT * FROM ok WHERE step >= th AND held - pre >= 0.8 * th QUALIFY row_number() OVER (PARTITION BY sample_idx, pos, roi ORDER BY sse, rn) = 1),
    calls AS (SELECT st.sample_idx, st.pos, st.roi, bs.t IS NOT NULL OR z AS dead, CASE WHEN bs.t IS NOT NULL THEN bs.t WHEN z THEN t0 END AS death_frame,
        CASE WHEN bs.t IS NOT NULL THEN bs.pre WHEN z THEN base ELSE early END AS baseline, peak,
        CASE WHEN bs.t IS NOT NULL THEN greatest(bs.step / greatest(bs.ps, cal.noise, 1), 0) WHEN z THEN greatest((med - base) / greatest(st.sigma, cal.noise, 1), 0)
            WHEN len < 2 THEN 0 ELSE greatest((peak - early) / greatest(st.sigma, cal.noise, 1), 0) END AS snr
        FROM (SELECT st.*, k >= 4 AND len >= 3 AND early >= base + 2 * min_step AND med - base >= 2 * min_step AS z FROM st, cal) st LEFT JOIN bs USING (sample_idx, pos, roi), cal)"""
)


@query(f"WITH {R_SQL} SELECT sample_idx, pos, roi, round(early, 6) AS early, round(sigma, 6) AS sigma, round(peak, 6) AS peak, len AS n, round(med, 6) AS median, t0 FROM st")
def d5_roi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.roi_stats(series(spark, sf_dir)))


@query(f"WITH {R_SQL} SELECT round(base, 6) AS base, round(noise, 6) AS noise, k AS series, round(min_step, 6) AS min_step FROM cal")
def d7_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.calibration(R.roi_stats(series(spark, sf_dir))))


@query(f"WITH {R_SQL} SELECT sample_idx, pos, roi, dead, death_frame, round(baseline, 4) AS baseline, round(peak, 4) AS peak, round(snr, 4) AS snr FROM calls")
def d8_viability_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.viability_calls(series(spark, sf_dir)), 4)


@query(f"""WITH {R_SQL}, ts AS (SELECT DISTINCT sample_idx, t FROM s), nt AS (SELECT sample_idx, count(*) AS n_total FROM calls GROUP BY 1),
    q AS (SELECT ts.sample_idx, ts.t, n_total, (SELECT count(*) FROM calls c WHERE c.sample_idx = ts.sample_idx AND c.dead AND c.death_frame <= ts.t) AS n_dead FROM ts JOIN nt USING (sample_idx))
    SELECT sample_idx, t, round((t * 5.0)::DOUBLE, 6) AS minutes, n_total, n_total - n_dead AS n_alive, n_dead, round((n_total - n_dead) * 100.0 / n_total, 6) AS pct_viable, round(100 - (n_total - n_dead) * 100.0 / n_total, 6) AS pct_dead FROM q""")
def a8_survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    return rounded(R.survival_curve(rows, R.viability_calls(rows), 5.0))


@query("""WITH x AS (SELECT (l_suppkey % 3)::INT AS sample_idx, (l_suppkey % 7)::INT AS pos, l_suppkey AS roi, (l_partkey % 50)::INT AS t, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS v, l_orderkey * 10 + l_linenumber AS o FROM lineitem)
    SELECT sample_idx, pos, roi, t, v FROM x WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY roi, t ORDER BY o) = 1""")
def d4_series_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 7, F.lit("bad")).otherwise(F.col("l_quantity").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("sample_idx"), (F.col("l_suppkey") % 7).cast("int").alias("pos"), F.col("l_suppkey").alias("roi"), (F.col("l_partkey") % 50).cast("string").alias("t"), value.alias("corrected"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_order"))
    return R.load_series(rows)


# ------------------------------------------------------- change points, 2.5

U_SQL = E_SQL + ", u AS (SELECT user_id, t, value AS v FROM e)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "t", F.col("value").alias("v"))


RES_SQL = U_SQL + ", r AS (SELECT user_id, user_id % 7 AS pos, t, v, v - quantile_cont(v, 0.5) OVER (PARTITION BY user_id % 7, t) AS residual FROM u)"


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.residual(users(spark, sf_dir).withColumn("pos", F.col("user_id") % 7), ["pos"])


@query(f"WITH {RES_SQL} SELECT user_id, t, round(residual, 6) AS residual FROM r")
def j8_position_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residuals(spark, sf_dir).select("user_id", "t", "residual"))


@query(f"""WITH {U_SQL}, b AS (SELECT *, quantile_cont(v, 0.5) FILTER (WHERE t < 10) OVER w AS base, max(v) OVER w AS top FROM u WINDOW w AS (PARTITION BY user_id))
    SELECT user_id, t, round(1 - least(greatest((v - base) / greatest(top - base, 1), 0), 1), 6) AS alive FROM b""")
def d11_alive_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.alive_signal(users(spark, sf_dir), ["user_id"]).select("user_id", "t", "alive"))


@query(f"""WITH {U_SQL}, h AS (SELECT user_id, t, bool_and(v >= 60) OVER w AND count(*) OVER w = 3 AS held FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT user_id, min(t) FILTER (WHERE held) AS start FROM h GROUP BY user_id""")
def d12_first_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_sustained(users(spark, sf_dir), ["user_id"], 60.0, 3)


@query(f"""WITH {U_SQL} SELECT user_id, max(v) - min(v) >= 300 AND (min(v) <= 10 OR max(v) / greatest(min(v), 1) >= 1.25) AS jump FROM u GROUP BY user_id""")
def d13_dynamic_range_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).groupBy("user_id").agg(P.jump_gate(F.min("v"), F.max("v")).alias("jump"))


def _best_sql(pre: str, post: str, where: str) -> str:
    return f"""WITH {U_SQL}, d AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id) AS n, avg(v) OVER ({post}) - avg(v) OVER ({pre}) AS delta FROM u),
    k AS (SELECT user_id, t, delta FROM d WHERE {where} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, t) = 1)
    SELECT user_id, t AS best_t, round(coalesce(delta, 0), 6) AS best_delta FROM (SELECT DISTINCT user_id FROM u) LEFT JOIN k USING (user_id)"""


_ROWS = "PARTITION BY user_id ORDER BY t ROWS BETWEEN"


@query(_best_sql(f"{_ROWS} 3 PRECEDING AND 1 PRECEDING", f"{_ROWS} CURRENT ROW AND 2 FOLLOWING", "n >= 7 AND t >= 3 AND t < n - 3"))
def d14_best_local_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.best_local_step(users(spark, sf_dir), ["user_id"]))


DT_SQL = RES_SQL + ", dt AS (SELECT user_id, t, v, residual - (regr_intercept(residual, t) OVER w + regr_slope(residual, t) OVER w * t) AS x FROM r WINDOW w AS (PARTITION BY user_id))"


@query(f"WITH {DT_SQL} SELECT user_id, t, round(x, 3) AS detrended FROM dt")
def d15_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.detrend(residuals(spark, sf_dir), ["user_id"], "residual").select("user_id", "t", "detrended"), 3)


@query(_best_sql(f"{_ROWS} 3 PRECEDING AND 1 PRECEDING", f"{_ROWS} CURRENT ROW AND 7 FOLLOWING", "n >= 17 AND t >= 8 AND t < n - 8"))
def d16_best_sustained_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.best_sustained_step(users(spark, sf_dir), ["user_id"]))


@query(_best_sql(f"{_ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING", f"{_ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING", "n >= 6 AND t >= 3 AND t < n - 3"))
def d17_best_mean_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.best_mean_step(users(spark, sf_dir), ["user_id"]))


@query(f"""WITH {DT_SQL}, f AS (SELECT *, count(*) OVER p AS n, min(x) OVER p AS lo, max(x) OVER p AS hi,
        avg(x) OVER ({_ROWS} CURRENT ROW AND 2 FOLLOWING) - avg(x) OVER ({_ROWS} 3 PRECEDING AND 1 PRECEDING) AS rise,
        avg(v) OVER ({_ROWS} CURRENT ROW AND 3 FOLLOWING) - avg(v) OVER ({_ROWS} 3 PRECEDING AND 1 PRECEDING) AS raw FROM dt WINDOW p AS (PARTITION BY user_id)),
    g AS (SELECT user_id, max(n)::INT AS frame_count, min(t) FILTER (WHERE hi - lo >= 150 AND (lo <= 10 OR hi / greatest(lo, 1) >= 1.1) AND t >= 10 AND t < n - 3 AND rise >= 40 AND raw >= 50) AS hit FROM f GROUP BY user_id)
    SELECT user_id, frame_count, CASE WHEN hit IS NULL OR hit >= frame_count - 3 THEN frame_count ELSE hit END AS death_time FROM g""")
def d18_death_from_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.death_from_intensity(residuals(spark, sf_dir), ["user_id"], min_contrast=40.0, min_raw=50.0)


@query(f"""WITH {U_SQL}, q AS (SELECT user_id, t, least(v / 200, 1) AS p FROM u),
    d AS (SELECT user_id, t, count(*) OVER w AS n, min(p) OVER w AS lo, max(p) OVER w AS hi, avg(p) OVER ({_ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING) - avg(p) OVER ({_ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM q WINDOW w AS (PARTITION BY user_id)),
    k AS (SELECT * FROM d WHERE n >= 6 AND t >= 3 AND t < n - 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, t) = 1),
    z AS (SELECT DISTINCT user_id, n, lo, hi FROM d)
    SELECT z.user_id, z.n::INT AS frame_count, CASE WHEN z.hi - z.lo >= 0.25 AND z.hi >= 0.35 AND k.delta >= 0.25 AND k.t < z.n - 2 THEN k.t ELSE z.n END::INT AS death_time FROM z LEFT JOIN k USING (user_id)""")
def d19_death_from_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users(spark, sf_dir).select("user_id", "t", F.least(F.col("v") / 200, F.lit(1.0)).alias("p"))
    return P.death_from_probability(rows, ["user_id"])


@query(f"""WITH {U_SQL}, q AS (SELECT user_id, t, t AS i, least(v / 100, 1.0) AS s FROM u),
    z AS (SELECT * FROM q UNION ALL SELECT user_id, NULL, max(t) + 1, NULL FROM q GROUP BY user_id),
    l AS (SELECT user_id, t, i, max(i) OVER (PARTITION BY user_id) AS final, coalesce(sum((1 - s) * (1 - s)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + coalesce(sum(s * s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS loss FROM z),
    b AS (SELECT *, min(loss) OVER (PARTITION BY user_id) AS least_loss FROM l)
    SELECT user_id, i::INT AS switch, t AS first_dead_frame, CASE WHEN i = 0 THEN 'always_dead' WHEN i = final THEN 'always_viable' ELSE 'transition' END AS state
    FROM b WHERE abs(loss - least_loss) <= 1e-10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) = 1""")
def d20_step_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.step_fit(users(spark, sf_dir).select("user_id", "t", F.least(F.col("v") / 100, F.lit(1.0)).alias("s")), ["user_id"])


@query(f"WITH {U_SQL} SELECT user_id, t, round(avg(least(v / 100, 1)) OVER ({_ROWS} 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM u")
def d21_causal_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users(spark, sf_dir).select("user_id", "t", F.least(F.col("v") / 100, F.lit(1.0)).alias("s"))
    return rounded(P.smooth(rows, ["user_id"], 5).select("user_id", "t", "smoothed"))


@query(f"""WITH {U_SQL}, k AS (SELECT user_id, count(*)::INT AS n, (12 + user_id % 20)::INT AS d FROM u GROUP BY user_id HAVING d < n),
    x AS (SELECT u.*, n, d, CASE WHEN greatest(10, d - 15) >= d THEN greatest(0, d - 5) ELSE greatest(10, d - 15) END AS a FROM u JOIN k USING (user_id)),
    y AS (SELECT *, t >= a AND t < d AS bf, t >= d AND t < d + 12 AS af FROM x),
    z AS (SELECT *, quantile_cont(v, 0.5) FILTER (WHERE bf) OVER w AS base, max(v) FILTER (WHERE af) OVER w AS peak FROM y WINDOW w AS (PARTITION BY user_id)),
    g AS (SELECT user_id, d, n, max(t + 1) FILTER (WHERE bf AND v < base + 0.15 * (peak - base)) AS f0, min(t) FILTER (WHERE af AND v >= base + 0.85 * (peak - base)) AS f1 FROM z WHERE peak > base + 1 GROUP BY user_id, d, n)
    SELECT user_id, coalesce(f0, d)::INT AS start, greatest(coalesce(f1, least(d + 4, n - 1)), coalesce(f0, d))::INT AS "end" FROM g""")
def d25_rise_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users(spark, sf_dir)
    deaths = rows.groupBy("user_id").agg(F.count("*").cast("int").alias("frame_count")).withColumn("death_time", (12 + F.col("user_id") % 20).cast("int"))
    return P.rise_interval(rows, deaths, ["user_id"])


# ----------------------------------------------------------- aggregates, 2.4


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50 FROM lineitem GROUP BY l_suppkey")
def a1_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(C.quantile("l_extendedprice", 0.1).alias("q10"), C.quantile("l_extendedprice", 0.5).alias("q50")), 4)


@query("SELECT l_suppkey, count(*)::INT AS area, round(quantile_cont(l_quantity, 0.1), 4) AS background, round(sum(l_quantity), 4) AS sum, round(sum(l_quantity) - count(*) * quantile_cont(l_quantity, 0.1), 4) AS corrected FROM lineitem GROUP BY l_suppkey")
def a2_frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.frame_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"), 4)


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plane per supplier and line number: channel is the line number modulo 3."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sort_array(F.collect_list("l_quantity")).alias("pixels"))
    return rows.select((F.col("l_suppkey") % 7).cast("int").alias("pos"), F.col("l_suppkey").cast("int").alias("roi"), F.col("l_linenumber").alias("t"), (F.col("l_linenumber") % 3).cast("int").alias("channel"), F.lit(0).alias("z"), "pixels")


@query("""SELECT (l_suppkey % 7)::INT AS pos, (l_linenumber % 3)::INT AS channel, l_suppkey::INT AS roi, l_linenumber AS t, count(*)::INT AS area, round(quantile_cont(l_quantity, 0.1), 4) AS background,
    round(sum(l_quantity), 4) AS sum, round(sum(l_quantity) - count(*) * quantile_cont(l_quantity, 0.1), 4) AS corrected FROM lineitem WHERE l_linenumber % 3 IN (1, 2) GROUP BY l_suppkey, l_linenumber""")
def a3_fluorescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.fluorescence(planes(spark, sf_dir), J.position_channels(mapping(spark, sf_dir))), 4)


PIX_SQL = "px AS (SELECT l_linenumber AS pos, l_extendedprice AS v, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem), hist AS (SELECT pos, round(v)::BIGINT AS bin, count(*) AS n FROM px WHERE idx % 4 = 0 AND v >= 0 AND round(v) < 65536 GROUP BY pos, round(v)::BIGINT)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("v"), (F.row_number().over(w) - 1).alias("idx"))


@query(f"WITH {PIX_SQL} SELECT * FROM hist")
def a4_sampled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sampled_histogram(pixels(spark, sf_dir), ["pos"])


@query(f"WITH {PIX_SQL}, c AS (SELECT *, sum(n) OVER (PARTITION BY pos ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY pos) AS total FROM hist) SELECT pos, min(bin) AS value, max(total)::BIGINT AS total FROM c WHERE upto > round((total - 1) * 0.9) GROUP BY pos")
def a5_histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.histogram_percentile(H.sampled_histogram(pixels(spark, sf_dir), ["pos"]), ["pos"], 0.9)


@query(f"""WITH {PIX_SQL}, c AS (SELECT *, sum(n) OVER (PARTITION BY pos ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY pos) AS total FROM hist),
    lo AS (SELECT pos, min(bin) AS low FROM c WHERE upto > round((total - 1) * 0.5) GROUP BY pos),
    dv AS (SELECT pos, abs(bin - low) AS apart, sum(n) AS n FROM hist JOIN lo USING (pos) GROUP BY ALL),
    cd AS (SELECT *, sum(n) OVER (PARTITION BY pos ORDER BY apart) AS upto, sum(n) OVER (PARTITION BY pos) AS total FROM dv),
    md AS (SELECT pos, min(apart) AS mad FROM cd WHERE upto > round((total - 1) * 0.5) GROUP BY pos)
    SELECT pos, low::DOUBLE AS low, round((low + 8 * 1.4826 * mad)::DOUBLE, 6) AS threshold FROM lo JOIN md USING (pos)""")
def a6_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.robust_scale(H.sampled_histogram(pixels(spark, sf_dir), ["pos"]), ["pos"]))


@query(f"WITH {E_SQL} SELECT (user_id % 7)::INT AS pos, user_id AS roi, count(*) AS frames, round(avg(value), 6) AS engagements_mean, round(avg(t), 6) AS tumor_cells_mean, round(avg(event_id % 9), 6) AS t_cells_mean FROM e GROUP BY user_id")
def a7_engagement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 7).cast("int").alias("pos"), F.col("user_id").alias("roi"), F.col("value").alias("engagements"), F.col("t").alias("tumor_cells"), (F.col("event_id") % 9).alias("t_cells"))
    return rounded(A.engagement_summary(rows))


@query(f"""WITH {E_SQL} SELECT 'S' || (user_id % 5) AS sample, round(t * 2.5 * 1e6)::BIGINT AS minute_key, round((t * 2.5)::DOUBLE, 6) AS minutes, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, count(*) AS n_traces FROM e GROUP BY 1, t""")
def a10_summary_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("sample"), "t", F.col("value").alias("corrected"))
    return rounded(A.summary_curve(rows, 2.5))


@query("SELECT round(min(value), 6) AS low, round(max(value) / 0.9, 6) AS high FROM events")
def a11_axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.axis_range(table(spark, sf_dir, "events"), "value"))


@query("""WITH x AS (SELECT quality AS truth, 1 - toxic AS p FROM labels), c AS (SELECT count(*) FILTER (WHERE p = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE p = 0 AND truth = 0) AS tn, count(*) FILTER (WHERE p = 1 AND truth = 0) AS fp, count(*) FILTER (WHERE p = 0 AND truth = 1) AS fn FROM x)
    SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def a12_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.binary_metrics(table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("prediction"))))


LAB_SQL = "lab AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'uncertain' WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS label, lang AS truth, CASE WHEN n_chars % 4 = 0 THEN 'en' ELSE lang END AS prediction, source AS \"group\" FROM documents)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 11 == 0, "uncertain").when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), F.when(F.col("n_chars") % 4 == 0, "en").otherwise(F.col("lang")).alias("prediction"), F.col("source").alias("group"))


@query(f"WITH {LAB_SQL}, g AS (SELECT * FROM lab WHERE label NOT IN ('', 'uncertain')), k AS (SELECT DISTINCT label AS l FROM g) SELECT a.l AS truth, b.l AS prediction, (SELECT count(*) FROM g WHERE g.label = a.l AND g.prediction = b.l) AS n FROM k a, k b")
def a13_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return A.confusion(rows, rows)


@query(f"WITH {LAB_SQL}, g AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE prediction = label) AS h FROM lab WHERE label NOT IN ('', 'uncertain') GROUP BY label) SELECT sum(n)::BIGINT AS scored, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS macro_recall FROM g")
def a13_macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.macro_metrics(labelled(spark, sf_dir)))


@query(f'WITH {LAB_SQL} SELECT label, count(*) AS images, count(DISTINCT "group") AS groups FROM lab WHERE label NOT IN (\'\', \'uncertain\') GROUP BY label')
def a14_class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_support(labelled(spark, sf_dir))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, sum(quality)::BIGINT AS viable, (count(*) - sum(quality))::BIGINT AS dead FROM labels GROUP BY 1")
def a15_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.manifest_counts(table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("quality").alias("label")))


@query("SELECT round(count(*) / (2 * sum(quality)), 6) AS weight_viable, round(count(*) / (2 * (count(*) - sum(quality))), 6) AS weight_dead FROM labels")
def a15_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))))


@query("SELECT l_suppkey, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <> 0) AS components FROM lineitem GROUP BY l_suppkey")
def a16_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("labels"))
    return rows.select("l_suppkey", A.component_count("labels").cast("long").alias("components"))


@query(f"""WITH {LAB_SQL} SELECT "group", count(*) AS images, count(*) FILTER (WHERE prediction <> truth) AS errors, count(*) FILTER (WHERE prediction <> truth AND prediction = 'en') AS false_positives,
    count(*) FILTER (WHERE prediction <> truth AND truth = 'en') AS false_negatives FROM lab GROUP BY 1""")
def a18_error_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = docs.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 4 == 0, "en").otherwise(F.col("lang")).alias("prediction"))
    return A.error_audit(J.label_errors(predicted, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.col("lang").alias("label")), "en"))


@query("SELECT (o_orderkey % 4)::INT AS budget, o_orderpriority AS method, count(*) AS trials, round(avg(o_totalprice), 4) AS accuracy, round(avg(o_custkey), 4) AS macro_recall FROM orders GROUP BY 1, 2")
def a19_trial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("budget"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("accuracy"), F.col("o_custkey").alias("macro_recall"))
    return rounded(A.trial_means(rows), 4)


@query("""WITH g AS (SELECT l_linenumber, count(*) AS n, avg(l_quantity) AS mean_x, avg(l_extendedprice) AS mean_y, stddev_samp(l_quantity) AS scale_x, stddev_samp(l_extendedprice) AS scale_y, greatest(least(corr(l_quantity, l_extendedprice), 0.999), -0.999) AS r FROM lineitem GROUP BY 1)
    SELECT l_linenumber, n, round(mean_x, 4) AS mean_x, round(mean_y, 4) AS mean_y, round(scale_x, 4) AS scale_x, round(scale_y, 4) AS scale_y, round(r, 4) AS r, round(sqrt(1 + r), 4) AS radius_x, round(sqrt(1 - r), 4) AS radius_y FROM g""")
def a20_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.ellipse(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ("l_linenumber",)), 4)


@query(f"""WITH {D3_SQL}, x AS (SELECT sample, death_time::DOUBLE AS v, min(death_time) OVER (PARTITION BY sample)::DOUBLE AS lo, max(death_time) OVER (PARTITION BY sample)::DOUBLE AS hi FROM dt WHERE death_time > 0)
    SELECT sample, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 20)), 19) ELSE 0 END::INT AS bin, count(*) AS n FROM x GROUP BY 1, 2""")
def a21_death_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.death_histogram(K.death_times(predictions(spark, sf_dir)).where(C.plotted_death(None, "death_time")))


@query("""WITH c AS (SELECT o_orderstatus AS sample, (o_custkey % 40)::INT AS t, count(*) AS n_alive FROM orders GROUP BY 1, 2)
    SELECT sample, (t * 5.0)::DOUBLE AS minutes, round(least(greatest(n_alive * 100.0 / max(n_alive) OVER (PARTITION BY sample), 0), 100), 6) AS pct FROM c""")
def d26_normalised_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") % 40).cast("int").alias("t")).agg(F.count("*").alias("n_alive"))
    return rounded(A.normalised_survival(rows.withColumn("n_total", F.lit(None).cast("long")).withColumn("pct_viable", F.lit(None).cast("double")), 5.0))


# ----------------------------------------------------- projections, keys, 2.2


@query("""SELECT l_orderkey, l_linenumber, round(exp(l_discount * 20) / (exp(l_discount * 20) + exp(l_tax * 20)), 6) AS p_dead, l_discount < l_tax AS alive FROM lineitem""")
def k1_k2_softmax_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p_dead", C.dead_probability(F.col("l_discount") * 20, F.col("l_tax") * 20))
    return rounded(rows.select("l_orderkey", "l_linenumber", "p_dead", C.is_alive("p_dead").alias("alive")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 300 >= 241 THEN true ELSE o_orderkey % 241 < o_custkey % 300 END AS alive FROM orders")
def k3_frame_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.frame_label(F.col("o_orderkey") % 241, F.col("o_custkey") % 300, F.lit(241)).alias("alive"))


@query(f"WITH {LAB_SQL} SELECT doc_id, label FROM lab WHERE label NOT IN ('', 'uncertain') AND label IS NOT NULL")
def k4_usable_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(C.usable_label("label")).select("doc_id", "label")


@query(f"WITH {E_SQL} SELECT user_id, t FROM e WHERE t % 10 = 0")
def k5_frame_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(C.on_stride("t", 10)).select("user_id", "t")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'viable' ELSE 'uncertain' END AS label FROM orders")
def k6_label_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.recode("o_orderstatus", {"F": "dead", "O": "viable", "P": "uncertain"}).alias("label"))


@query("SELECT s_suppkey, 'Pos' || s_nationkey || '/Roi' || s_suppkey AS roi, 'Pos' || s_nationkey || '-Roi' || s_suppkey || '-t3-c1-z0' AS image FROM supplier")
def k7_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.concat(F.lit("Pos"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.roi_key(position, "s_suppkey").alias("roi"), C.image_id("s_nationkey", "s_suppkey", F.lit(3), F.lit(1), F.lit(0)).alias("image"))


@query(f"WITH {E_SQL} SELECT user_id, t, round((t * 2.75)::DOUBLE, 6) AS raw, round((t * 2.75)::DOUBLE, 4) AS four FROM e")
def k8_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(spark, sf_dir).select("user_id", "t", C.minutes("t", 2.75).alias("raw"), C.minutes("t", 2.75, 4).alias("four")))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(' ' || p_name || ': ' || p_type || '/_.', '[<>:"/\\\\|?*\\s]+', '_', 'g'), '_+', '_', 'g'), '^[_. ]+|[_. ]+$', '', 'g'), ''), 'sample') AS folder FROM part""")
def k10_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.safe_name(F.concat(F.lit(" "), F.col("p_name"), F.lit(": "), F.col("p_type"), F.lit("/_."))).alias("folder"))


@query(f"WITH {M_SQL}, b AS (SELECT sample_idx, name, replace(name, ' ', '_') AS base FROM m) SELECT sample_idx, name, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN sample_idx || '_' || base ELSE base END AS folder FROM b")
def k11_sample_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.sample_folders(mapping(spark, sf_dir))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS kind, o_orderstatus = 'F' AND o_custkey % 9 - 1 >= 0 AS flagged, o_custkey % 9 - 1 > 0 AS plain, o_custkey % 400 <= 200 AND o_orderkey % 400 <= 200 AS early FROM orders")
def k12_k14_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "label-free").otherwise("other")
    frame = F.col("o_custkey") % 9 - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", C.is_assay_kind(kind).alias("kind"), C.plotted_death(F.col("o_orderstatus") == "F", frame).alias("flagged"), C.plotted_death(None, frame).alias("plain"), C.both_before(F.col("o_custkey") % 400, F.col("o_orderkey") % 400).alias("early"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'EGFP ' WHEN 1 THEN 'mCherry ' WHEN 2 THEN 'YFP ' WHEN 3 THEN 'TagBFP ' ELSE 'DIC ' END || p_name AS c FROM part)
    SELECT p_partkey, CASE WHEN lower(c) LIKE '%gfp%' THEN 'green' WHEN lower(c) LIKE '%mcherry%' THEN 'red' WHEN lower(c) LIKE '%yfp%' THEN 'yellow' WHEN lower(c) LIKE '%bfp%' THEN 'blue' ELSE 'gray' END AS color FROM n""")
def k15_trace_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("EGFP ", "mCherry ", "YFP ", "TagBFP ", "DIC ")))
    return table(spark, sf_dir, "part").select("p_partkey", C.trace_color(F.concat(F.get(names, (F.col("p_partkey") % 5).cast("int")), F.col("p_name"))).alias("color"))


@query("""SELECT n_nationkey, p::INT AS position FROM (SELECT n_nationkey, unnest(list_distinct([n_nationkey] || range(n_nationkey, n_nationkey + 4) || range(n_nationkey, n_nationkey + 11, 3))) AS p FROM nation)""")
def s20_parse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    text = F.concat(n, F.lit(", "), n, F.lit(":"), (F.col("n_nationkey") + 3).cast("string"), F.lit(","), n, F.lit(":"), (F.col("n_nationkey") + 10).cast("string"), F.lit(":3"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(C.parse_positions(text)).alias("position"))


@query("SELECT n_nationkey, round((n_nationkey + 1) * CASE n_nationkey % 4 WHEN 0 THEN 1.0 / 60 WHEN 1 THEN 1 WHEN 2 THEN 60 ELSE 1 END, 6) AS minutes FROM nation")
def s21_interval_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(F.lit("second"), F.lit("minute"), F.lit("hour"), F.lit(None).cast("string")), F.col("n_nationkey") % 4)
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", C.interval_minutes(F.col("n_nationkey") + 1, unit).alias("minutes")))


@query(f"WITH {E_SQL} SELECT t, user_id::INT AS crop, round(value / 500, 6) AS p_dead, event_type IN ('click', 'error') AS label, CASE WHEN user_id % 2 = 0 THEN (user_id % 7)::INT ELSE 0 END AS pos, event_type AS sample FROM e")
def s23_parse_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import parse_predictions

    label = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "error", "TRUE").otherwise("no")
    raw = events(spark, sf_dir).select(F.concat(F.col("t").cast("string"), F.lit(".0")).alias("t"), F.col("user_id").cast("string").alias("crop"), (F.col("value") / 500).cast("string").alias("p_dead"), label.alias("label"), F.when(F.col("user_id") % 2 == 0, (F.col("user_id") % 7).cast("string")).otherwise("x").alias("pos"), F.col("event_type").alias("sample"))
    return rounded(parse_predictions(raw))


@query("""WITH old AS (SELECT 'Pos' || s_nationkey AS position, s_suppkey AS roi_id, (s_suppkey % 50)::INT AS death, 0 AS n FROM supplier),
    new AS (SELECT position, roi_id, 7 AS death, 1 AS n FROM old WHERE roi_id % 3 = 0 UNION ALL SELECT position, roi_id, 5, 1 FROM old WHERE roi_id % 9 = 0 UNION ALL SELECT position, roi_id + 100000, 1, 1 FROM old WHERE roi_id % 5 = 0)
    SELECT position, roi_id, death AS death_frame FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY position, roi_id ORDER BY n DESC, death DESC) = 1""")
def s22_label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import upsert_labels

    rows, changes = label_rows(spark, sf_dir)
    return upsert_labels(rows.withColumn("labeled_at", F.lit("2020-01-01T00:00:00+00:00")), changes, 60).select("position", "roi_id", "death_frame")


def label_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of all suppliers, and changes of some, some twice, with some new ones."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Pos"), F.col("s_nationkey").cast("string")).alias("position"), F.col("s_suppkey").cast("long").alias("roi_id"), (F.col("s_suppkey") % 50).cast("int").alias("death_frame"))
    parts = [rows.where("roi_id % 3 = 0").withColumn("death_frame", F.lit(7)), rows.where("roi_id % 9 = 0").withColumn("death_frame", F.lit(5)), rows.where("roi_id % 5 = 0").withColumn("roi_id", F.col("roi_id") + 100000).withColumn("death_frame", F.lit(1))]
    return rows, parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- joins, 2.3


def trace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").cast("int").alias("pos"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("channel"))


@query(f"WITH {M_SQL}, o AS (SELECT sample_idx, name, unnest(positions) AS pos, signal FROM m), c AS (SELECT sample_idx, name, pos, unnest(signal) AS channel FROM o) SELECT s_suppkey AS roi, pos, channel, sample_idx, name FROM supplier JOIN c ON pos = s_nationkey AND channel = s_suppkey % 2 + 1")
def j1_trace_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.trace_owners(trace_keys(spark, sf_dir), mapping(spark, sf_dir))


@query(f"WITH {M_SQL}, o AS (SELECT sample_idx, name, unnest(positions) AS pos FROM m) SELECT s_suppkey AS roi, pos, (s_suppkey % 2 + 1)::INT AS channel, sample_idx, name FROM supplier JOIN o ON pos = s_nationkey")
def j2_position_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.position_owner(trace_keys(spark, sf_dir), mapping(spark, sf_dir))


def shared_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping in which neighbouring samples share a position."""
    key = F.col("n_nationkey").cast("int")
    return table(spark, sf_dir, "nation").select(key.alias("sample_idx"), F.col("n_name").alias("name"), F.array(key + 1, key).alias("positions"), F.array(F.lit(2), (key % 3)).alias("signal"))


SH_SQL = "sh AS (SELECT n_nationkey::INT AS sample_idx, n_name AS name, [n_nationkey::INT + 1, n_nationkey::INT] AS positions, [2, (n_nationkey % 3)::INT] AS signal FROM nation)"


@query(f"WITH {SH_SQL}, o AS (SELECT sample_idx, name, unnest(positions) AS pos FROM sh), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pos ORDER BY sample_idx) = 1) SELECT s_suppkey AS roi, pos, (s_suppkey % 2 + 1)::INT AS channel, sample_idx, name FROM supplier JOIN f ON pos = s_nationkey")
def j3_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_owner(trace_keys(spark, sf_dir), shared_mapping(spark, sf_dir))


@query(f"WITH {SH_SQL}, o AS (SELECT unnest(positions) AS pos, signal FROM sh) SELECT DISTINCT pos, unnest(signal)::INT AS channel FROM o")
def j4_position_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.position_channels(shared_mapping(spark, sf_dir)).select("pos", F.col("channel").cast("int").alias("channel"))


@query(f"WITH {SH_SQL}, o AS (SELECT sample_idx, unnest(positions) AS pos, unnest(range(2)) AS nth FROM sh), f AS (SELECT pos, min(sample_idx * 10 + nth) AS o FROM o GROUP BY pos) SELECT pos, row_number() OVER (ORDER BY o)::INT AS place FROM f")
def j5_ordered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.ordered_positions(shared_mapping(spark, sf_dir))


@query(f"WITH {M_SQL}, f AS (SELECT name, min(sample_idx) AS sample_idx FROM m GROUP BY name) SELECT r_regionkey AS t, name AS sample, sample_idx FROM region JOIN f ON name = r_name WHERE r_name <> 'ASIA'")
def j6_by_sample_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("t"), F.when(F.col("r_name") == "ASIA", "unknown").otherwise(F.col("r_name")).alias("sample"))
    return J.by_sample_name(rows, mapping(spark, sf_dir))


@query("""WITH d AS (SELECT source || '-' || coalesce(lang, '') || '-' || n_chars // 500 AS "group", doc_id % 3 = 0 AS ev FROM documents)
    SELECT "group" FROM d WHERE ev INTERSECT SELECT "group" FROM d WHERE NOT ev""")
def j10_overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat_ws("-", "source", F.coalesce("lang", F.lit("")), F.floor(F.col("n_chars") / 500).cast("string"))
    return J.overlapping_groups(table(spark, sf_dir, "documents").select(group.alias("group"), F.when(F.col("doc_id") % 3 == 0, "evaluation").otherwise("reference").alias("split")))


@query("""WITH rois AS (SELECT 'Pos' || s_nationkey AS position, s_suppkey AS roi_id FROM supplier),
    labels AS (SELECT position, roi_id, (roi_id % 50)::INT AS death_frame FROM rois WHERE roi_id % 3 = 0 UNION ALL SELECT 'Pos99', roi_id, 1 FROM rois WHERE roi_id % 3 = 1)
    SELECT position, roi_id, death_frame FROM rois LEFT JOIN labels USING (position, roi_id)""")
def j13_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rois = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Pos"), F.col("s_nationkey").cast("string")).alias("position"), F.col("s_suppkey").alias("roi_id"))
    labels = rois.where("roi_id % 3 = 0").withColumn("death_frame", (F.col("roi_id") % 50).cast("int"))
    elsewhere = rois.where("roi_id % 3 = 1").withColumn("position", F.lit("Pos99")).withColumn("death_frame", F.lit(1))
    return J.with_labels(rois, labels.unionByName(elsewhere))


@query("""WITH p AS (SELECT doc_id AS id, CASE WHEN n_chars % 4 = 0 THEN 'en' WHEN n_chars % 4 = 1 THEN 'de' ELSE lang END AS prediction FROM documents), t AS (SELECT doc_id AS id, source AS "group", lang AS label FROM documents)
    SELECT id, "group", label, prediction, prediction <> label AND prediction = 'en' AS false_positive, prediction <> label AND label = 'en' AS false_negative FROM p JOIN t USING (id)""")
def j14_label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = F.when(F.col("n_chars") % 4 == 0, "en").when(F.col("n_chars") % 4 == 1, "de").otherwise(F.col("lang"))
    return J.label_errors(docs.select(F.col("doc_id").alias("id"), told.alias("prediction")), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.col("lang").alias("label")), "en")


# --------------------------------------------------- thresholds and masks, 2.7


def _otsu_sql(place: str, keep: str) -> str:
    return f"""WITH x AS (SELECT l_suppkey, l_quantity AS v, min(l_quantity) OVER w AS low, max(l_quantity) OVER w AS high FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
    h AS (SELECT l_suppkey, low, high, {place} AS level, count(*) AS n FROM x WHERE high > low GROUP BY ALL),
    c AS (SELECT *, {keep} AS px FROM h), d AS (SELECT *, sum(n) OVER o AS w1, sum(n * px) OVER o AS s1, sum(n) OVER p AS wt, sum(n * px) OVER p AS st FROM c WINDOW o AS (PARTITION BY l_suppkey ORDER BY level), p AS (PARTITION BY l_suppkey)),
    b AS (SELECT *, round(w1 * (wt - w1) * power(s1 / w1 - (st - s1) / (wt - w1), 2) / (wt * wt), 9) AS score FROM d WHERE w1 < wt),
    k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, level) = 1)"""


@query(_otsu_sql("greatest(least(round((v - low) * (255.0 / (high - low))), 255), 0)::INT", "level::DOUBLE") + " SELECT l_suppkey, low, high, level, round(low + level / 255.0 * (high - low), 6) AS threshold FROM k")
def i1_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.otsu_levels(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"))


@query(_otsu_sql("least(floor((v - low) / ((high - low) / 256)), 255)::INT", "low + (level + 0.5) * (high - low) / 256") + " SELECT l_suppkey, round(px, 6) AS threshold FROM k")
def i3_otsu_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.otsu_centres(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"))


@query(_otsu_sql("greatest(least(round((v - low) * (255.0 / (high - low))), 255), 0)::INT", "level::DOUBLE") + """, t AS (SELECT l_suppkey, low + level / 255.0 * (high - low) AS th FROM k),
    g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > th) AS above, count(*) AS n FROM lineitem JOIN t USING (l_suppkey) GROUP BY 1)
    SELECT l_suppkey, above, n, CASE WHEN above IN (0, n) THEN 'none' WHEN above <= n - above THEN 'above' ELSE 'below' END AS "on", CASE WHEN above IN (0, n) THEN 0 ELSE least(above, n - above) END AS kept FROM g""")
def i4_minority_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return H.minority_counts(rows, H.otsu_levels(rows, ["l_suppkey"], "l_quantity"), ["l_suppkey"], "l_quantity")


@query("""WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 40) AS bright FROM lineitem GROUP BY 1) SELECT * FROM g""")
def i5_scale_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.array("l_quantity").alias("pixels"))
    return rows.groupBy("l_suppkey").agg(F.sum(F.size(F.filter(H.scale_mask("pixels", F.lit(40.0)), lambda x: x))).alias("bright"))


@query("""WITH g AS (SELECT l_suppkey, avg(l_quantity) + 1.5 * stddev_pop(l_quantity) AS th FROM lineitem GROUP BY 1) SELECT l_suppkey, round(th, 6) AS threshold, count(*) FILTER (WHERE l_quantity > th) AS "on" FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1, th""")
def i6_sigma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.sigma_threshold(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 1.5))


#: An image of 20 pixels a row per brand, in order of the keys; what is missing of its last row has size 0.
GRID_SQL = """n0 AS (SELECT p_brand AS img, p_size, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS i FROM part),
    n1 AS (SELECT * FROM n0 UNION ALL SELECT img, 0, unnest(range(max(i) + 1, (max(i) // 20 + 1) * 20))::INT FROM n0 GROUP BY img),
    gr AS (SELECT img, (i % 20)::INT AS x, (i // 20)::INT AS y, i, p_size > 35 AS lit, p_size FROM n1)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("img"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"), F.col("p_size").cast("int").alias("size"))
    ends = rows.groupBy("img").agg(F.max("i").alias("last")).withColumn("height", (F.floor(F.col("last") / 20) + 1).cast("int"))
    blank = ends.where("last + 1 < height * 20").select("img", F.explode(F.sequence(F.col("last") + 1, F.col("height") * 20 - 1)).alias("i"), F.lit(0).alias("size"))
    rows = rows.unionByName(blank).join(ends.select("img", "height"), "img")
    return rows.select("img", "height", F.lit(20).alias("width"), F.floor(F.col("i") / 20).cast("int").alias("y"), (F.col("i") % 20).cast("int").alias("x"), (F.col("size") > 35).alias("on"), F.col("size").cast("double").alias("v"))


def grid_tiles(spark: SparkSession, sf_dir: str, on: Column) -> DataFrame:
    """The images of the grid in tiles of 8 x 8 pixels."""
    from ..operators.pixels import planes_of
    from ..operators.tiles import cut

    return cut(planes_of(grid(spark, sf_dir).withColumn("lit", on), ["img"], "lit", "lit"), ["img"], 8, "lit")


#: Components of pixels in `px` by the smallest place that `near` pairs reach.
REACH_SQL = """reach AS (SELECT img, i AS root, i FROM px UNION SELECT reach.img, reach.root, near.b FROM reach JOIN near ON near.img = reach.img AND near.a = reach.i),
    lab AS (SELECT img, i, min(root) AS root FROM reach GROUP BY img, i)"""


@query(f"""WITH RECURSIVE {GRID_SQL}, px AS (SELECT * FROM gr WHERE lit),
    near AS (SELECT a.img, a.i AS a, b.i AS b FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), {REACH_SQL}
    SELECT img, root::INT AS first_pixel, count(*) AS pixels FROM lab GROUP BY img, root HAVING count(*) >= 4""")
def i7_component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import components

    rows = components(grid(spark, sf_dir), ["img"]).where("label > 0")
    return rows.groupBy("img", "label").agg(F.min(F.col("y") * 20 + F.col("x")).alias("first_pixel"), F.count("*").alias("pixels")).drop("label")


@query(f"""WITH RECURSIVE {GRID_SQL}, px AS (SELECT * FROM gr WHERE lit),
    near AS (SELECT a.img, a.i AS a, b.i AS b FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), {REACH_SQL},
    ranked AS (SELECT img, root, count(*) AS pixels, row_number() OVER (PARTITION BY img ORDER BY root)::INT AS label FROM lab GROUP BY img, root)
    SELECT img, label, pixels FROM ranked WHERE pixels >= 4""")
def i7_tiled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tiles import component_tiles

    rows = component_tiles(grid_tiles(spark, sf_dir, F.col("on")), ["img"])
    return rows.select("img", F.explode("label").alias("label")).where("label > 0").groupBy("img", "label").agg(F.count("*").alias("pixels"))


@query(f"""WITH {GRID_SQL} SELECT a.img, a.i, max(b.p_size)::DOUBLE AS most FROM gr a JOIN gr b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def i8_neighbour_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import neighbour_max

    return neighbour_max(grid(spark, sf_dir), ["img"], "v", "most").select("img", (F.col("y") * 20 + F.col("x")).alias("i"), "most")


@query(f"""WITH {GRID_SQL}, off AS (SELECT img, x, y FROM gr WHERE NOT lit) SELECT gr.img, gr.i, round(sqrt(min((gr.x - off.x) * (gr.x - off.x) + (gr.y - off.y) * (gr.y - off.y))), 6) AS distance FROM gr JOIN off ON gr.img = off.img WHERE lit GROUP BY ALL""")
def i9_distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import distance

    return rounded(distance(grid(spark, sf_dir), ["img"]).where("distance > 0").select("img", (F.col("y") * 20 + F.col("x")).alias("i"), "distance"))


@query(f"""WITH RECURSIVE {GRID_SQL}, px AS (SELECT * FROM gr WHERE lit),
    near AS (SELECT a.img, a.i AS a, b.i AS b FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), {REACH_SQL},
    sz AS (SELECT img, root, count(*) AS n FROM lab GROUP BY img, root) SELECT img, sum(n) FILTER (WHERE n >= 4)::BIGINT AS large, sum(n) FILTER (WHERE 2 * sqrt(n / pi()) BETWEEN 1.4 AND 2.6)::BIGINT AS round FROM sz GROUP BY img""")
def i12_i13_label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels as X

    rows = X.lasting(X.components(grid(spark, sf_dir), ["img"], least=1))
    kept = [r.where("label > 0").groupBy("img").agg(F.count("*").alias(n)) for r, n in ((X.drop_small(rows, ["img"]), "large"), (X.keep_diameter(rows, ["img"], 2.0), "round"))]
    return rows.select("img").distinct().join(kept[0], "img", "left").join(kept[1], "img", "left")


@query(f"""WITH {GRID_SQL}, cl AS (SELECT a.img, a.i, b.p_size AS v FROM gr a, (SELECT unnest(range(-1, 2)) AS dx) p, (SELECT unnest(range(-1, 2)) AS dy) q, (SELECT img AS im, max(y) AS top FROM gr GROUP BY img) t, gr b
    WHERE t.im = a.img AND b.img = a.img AND b.x = least(greatest(a.x + dx, 0), 19) AND b.y = least(greatest(a.y + dy, 0), top)) SELECT img, i, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS spread FROM cl GROUP BY ALL""")
def i17_i18_box_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import box_mean, local_deviation

    rows = local_deviation(box_mean(grid(spark, sf_dir), ["img"], 1), ["img"], 1)
    place = (F.col("y") * 20 + F.col("x")).alias("i")
    return rows.select("img", place, F.round("mean", 6).alias("mean"), F.round(F.col("deviation") * F.col("deviation"), 4).alias("spread"))


@query(f"""WITH {GRID_SQL}, w AS (SELECT d, exp(-d * d / 2.0) / sum(exp(-d * d / 2.0)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS d)), t AS (SELECT img AS im, max(y) AS top FROM gr GROUP BY img),
    a AS (SELECT g.img, g.x, g.y, g.i, sum(w.w * b.p_size) AS s FROM gr g, w, gr b WHERE b.img = g.img AND b.y = g.y AND b.x = least(greatest(g.x + d, 0), 19) GROUP BY ALL)
    SELECT g.img, g.i, round(sum(w.w * b.s), 6) AS smooth FROM a g, w, t, a b WHERE t.im = g.img AND b.img = g.img AND b.x = g.x AND b.y = least(greatest(g.y + d, 0), top) GROUP BY ALL""")
def i19_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import gaussian

    return rounded(gaussian(grid(spark, sf_dir), ["img"], 1.0).select("img", (F.col("y") * 20 + F.col("x")).alias("i"), "smooth"))


@query(f"""WITH RECURSIVE {GRID_SQL}, gm AS (SELECT *, p_size > 20 AS wall FROM gr), px AS (SELECT * FROM gm WHERE NOT wall), t AS (SELECT img, max(y) AS top FROM gr GROUP BY img),
    near AS (SELECT a.img, a.i AS a, b.i AS b FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
    outer_ AS (SELECT px.img, px.i FROM px JOIN t USING (img) WHERE px.x IN (0, 19) OR px.y IN (0, top) UNION SELECT outer_.img, near.b FROM outer_ JOIN near ON near.img = outer_.img AND near.a = outer_.i)
    SELECT gm.img, count(*) - count(outer_.i) AS filled FROM gm LEFT JOIN outer_ USING (img, i) GROUP BY gm.img""")
def i20_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import fill_holes

    rows = fill_holes(grid(spark, sf_dir).withColumn("on", F.col("v") > 20), ["img"])
    return rows.groupBy("img").agg(F.sum(F.col("on").cast("long")).alias("filled"))


@query(f"""WITH RECURSIVE {GRID_SQL}, gm AS (SELECT *, p_size > 20 AS wall FROM gr), px AS (SELECT * FROM gm WHERE NOT wall), t AS (SELECT img, max(y) AS top FROM gr GROUP BY img),
    near AS (SELECT a.img, a.i AS a, b.i AS b FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
    outer_ AS (SELECT px.img, px.i FROM px JOIN t USING (img) WHERE px.x IN (0, 19) OR px.y IN (0, top) UNION SELECT outer_.img, near.b FROM outer_ JOIN near ON near.img = outer_.img AND near.a = outer_.i)
    SELECT gm.img, count(*) - count(outer_.i) AS filled FROM gm LEFT JOIN outer_ USING (img, i) GROUP BY gm.img""")
def i20_tiled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tiles import fill_tiles

    rows = fill_tiles(grid_tiles(spark, sf_dir, F.col("v") > 20), ["img"])
    return rows.select("img", F.explode("on").alias("on")).groupBy("img").agg(F.sum(F.col("on").cast("long")).alias("filled"))


@query(f"""WITH {GRID_SQL}, q AS (SELECT img, quantile_cont(p_size, 0.01) AS lo, quantile_cont(p_size, 0.99) AS hi FROM gr GROUP BY img) SELECT img, sum(floor(CASE WHEN hi > lo THEN least(greatest((p_size - lo) / (hi - lo), 0), 1) * 255 ELSE 0 END))::BIGINT AS sheet,
    sum(floor(least(greatest((p_size - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0), 1) * 255))::BIGINT AS png, sum(floor(least(greatest((p_size - 5) / 30.0, 0), 1) * 255))::BIGINT AS movie FROM gr JOIN q USING (img) GROUP BY img""")
def i23_i25_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import contrast

    rows = grid(spark, sf_dir)
    limits = rows.select("img").distinct().select("img", F.lit(5.0).alias("low"), F.lit(35.0).alias("high"))
    forms = {"sheet": contrast(rows, ["img"]), "png": contrast(rows, ["img"], "png"), "movie": contrast(rows, ["img"], "movie", limits=limits)}
    sheet, png, movie = (r.groupBy("img").agg(F.sum("gray").alias(name)) for name, r in forms.items())
    return sheet.join(png, "img").join(movie, "img")


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of 64 x 64 per nation, as pixel rows: an engager and a tumour disk per supplier."""
    s = F.col("s_suppkey").cast("int")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("frame"), (s * 17 % 64).alias("ex"), (s * 31 % 64).alias("ey"), ((s * 23 + 9) % 64).alias("tx"), ((s * 13 + 5) % 64).alias("ty"))

    def drawn(x: str, y: str, radius: int, name: str) -> DataFrame:
        around = F.sequence(F.lit(-radius - 1), F.lit(radius))
        one = rows.select("frame", x, y, F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
        one = one.where((F.col("dx") + 0.5) * (F.col("dx") + 0.5) + (F.col("dy") + 0.5) * (F.col("dy") + 0.5) <= radius * radius)
        one = one.select("frame", (F.col(y) + F.col("dy")).alias("y"), (F.col(x) + F.col("dx")).alias("x"))
        return one.where("x between 0 and 63 and y between 0 and 63").distinct().withColumn(name, F.lit(True))

    every = rows.select("frame").distinct().select("frame", F.lit(64).alias("height"), F.lit(64).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    every = every.join(drawn("ex", "ey", 5, "engager"), ["frame", "y", "x"], "left").join(drawn("tx", "ty", 7, "tumor"), ["frame", "y", "x"], "left")
    return every.na.fill(False, ["engager", "tumor"])


#: Pixels of the frames of disks, in SQL.
DISK_SQL = """s AS (SELECT s_suppkey::INT AS s, s_nationkey AS frame FROM supplier), fr AS (SELECT DISTINCT frame FROM s), ax AS (SELECT unnest(range(64))::INT AS k),
    dp AS (SELECT fr.frame, a.k AS y, b.k AS x, EXISTS (SELECT 1 FROM s WHERE s.frame = fr.frame AND power(b.k + 0.5 - s * 17 % 64, 2) + power(a.k + 0.5 - s * 31 % 64, 2) <= 25) AS engager,
        EXISTS (SELECT 1 FROM s WHERE s.frame = fr.frame AND power(b.k + 0.5 - (s * 23 + 9) % 64, 2) + power(a.k + 0.5 - (s * 13 + 5) % 64, 2) <= 49) AS tumor FROM fr, ax a, ax b)"""


@query(f"""WITH RECURSIVE {DISK_SQL}, g AS (SELECT frame, y, x, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS piece FROM dp WHERE tumor),
    runs AS (SELECT frame, y, min(x) AS a, max(x) AS b, y * 64 + min(x) AS id FROM g GROUP BY frame, y, piece),
    near AS (SELECT p.frame, p.id AS a, q.id AS b FROM runs p JOIN runs q ON p.frame = q.frame AND abs(p.y - q.y) = 1 AND p.a <= q.b + 1 AND q.a <= p.b + 1),
    reach AS (SELECT frame, id AS root, id FROM runs UNION SELECT reach.frame, reach.root, near.b FROM reach JOIN near ON near.frame = reach.frame AND near.a = reach.id),
    lab AS (SELECT frame, id, min(root) AS root FROM reach GROUP BY frame, id), size AS (SELECT frame, root, sum(b - a + 1) AS n FROM lab JOIN runs USING (frame, id) GROUP BY frame, root)
    SELECT frame, count(*)::INT AS tumor_cells FROM size WHERE n >= 4 GROUP BY frame""")
def a16_tumor_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import components, count_labels

    return count_labels(components(disks(spark, sf_dir), ["frame"], "tumor"), ["frame"], "tumor_cells")


@query(f"""WITH {DISK_SQL}, off AS (SELECT * FROM dp WHERE NOT engager), d AS (SELECT a.frame, a.y, a.x, min((a.y - o.y) * (a.y - o.y) + (a.x - o.x) * (a.x - o.x)) AS q FROM dp a JOIN off o ON a.frame = o.frame AND o.y BETWEEN a.y - 20 AND a.y + 20 AND o.x BETWEEN a.x - 20 AND a.x + 20 WHERE a.engager GROUP BY ALL),
    top AS (SELECT a.* FROM d a WHERE a.q >= 6.25 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.q > a.q))
    SELECT frame, count(*) AS maxima FROM top GROUP BY frame""")
def i10_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels as X

    rows = X.distance(disks(spark, sf_dir).withColumnRenamed("engager", "on"), ["frame"]).withColumn("d", F.when(F.col("on"), F.col("distance")))
    rows = X.neighbour_max(rows, ["frame"], "d", "m").where("on and distance >= 2.5 and d >= m")
    return rows.groupBy("frame").agg(F.count("*").alias("maxima"))


@query(f"""WITH RECURSIVE {DISK_SQL}, off AS (SELECT * FROM dp WHERE NOT engager), d AS (SELECT a.frame, a.y, a.x, min((a.y - o.y) * (a.y - o.y) + (a.x - o.x) * (a.x - o.x)) AS q FROM dp a JOIN off o ON a.frame = o.frame AND o.y BETWEEN a.y - 20 AND a.y + 20 AND o.x BETWEEN a.x - 20 AND a.x + 20 WHERE a.engager GROUP BY ALL),
    top AS (SELECT a.* FROM d a WHERE a.q >= 6.25 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.q > a.q)),
    ranked AS (SELECT frame, y, x, row_number() OVER (PARTITION BY frame ORDER BY q DESC, y, x) AS k FROM top),
    g(frame, k, kept) AS (SELECT frame, 1::BIGINT, [{{'y': y, 'x': x}}] FROM ranked WHERE k = 1
        UNION ALL SELECT g.frame, r.k, CASE WHEN len(list_filter(kept, lambda p: (p.y - r.y) * (p.y - r.y) + (p.x - r.x) * (p.x - r.x) < 30.25)) = 0 THEN list_append(kept, {{'y': r.y, 'x': r.x}}) ELSE kept END FROM g JOIN ranked r ON r.frame = g.frame AND r.k = g.k + 1),
    last AS (SELECT frame, arg_max(kept, k) AS kept FROM g GROUP BY frame)
    SELECT frame, kept[seed].y AS y, kept[seed].x AS x, seed::INT AS seed FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS seed FROM last)""")
def o3_i10_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels as X

    rows = X.distance(disks(spark, sf_dir).withColumnRenamed("engager", "on"), ["frame"])
    return X.seeds(rows, ["frame"])


@query()
def i14_split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import split_cells

    rows = split_cells(disks(spark, sf_dir), ["frame"], "engager").where("label > 0")
    return rows.groupBy("frame", "label").agg(F.count("*").alias("pixels"))


@query()
def i15_engagement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import engagement, lasting

    return engagement(lasting(disks(spark, sf_dir)), ["frame"])


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels per frame made from the disks: brightfield texture and stain."""
    from ..operators.pixels import planes_of

    i = F.col("y") * 64 + F.col("x")
    rows = disks(spark, sf_dir)
    made = []
    for channel, light in ((0, F.when(F.col("tumor"), 100.0 + i % 7 * 20).otherwise(100.0 + i % 2)), (1, F.when(F.col("engager"), 4500.0).otherwise(190.0 + (i * 17 + 3) % 31))):
        made.append(planes_of(rows.withColumn("v", light), ["frame"], "v", "pixels").withColumn("channel", F.lit(channel)))
    both = made[0].unionByName(made[1])
    return both.select((F.col("frame") % 3).cast("int").alias("pos"), F.col("frame").cast("int").alias("roi"), F.lit(0).alias("t"), "channel", F.lit(0).alias("z"), "height", "width", "pixels")


@query()
def i16_position_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import position_engagement

    return position_engagement(_planes(spark, sf_dir), 1, 0, 2.75)


@query()
def i22_masked_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import stain_traces

    return rounded(stain_traces(_planes(spark, sf_dir)), 4)


@query(f"""WITH {DISK_SQL}, v AS (SELECT frame, y, x, CASE WHEN engager THEN 4500.0 ELSE 190 + ((y * 64 + x) * 17 + 3) % 31 END AS p FROM dp),
    im AS (SELECT frame, list(p::DOUBLE ORDER BY y, x) AS p, quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM v GROUP BY frame),
    wt AS (SELECT k, least(floor(pl), 63)::INT AS a, least(floor(pl) + 1, 63)::INT AS b, pl - least(floor(pl), 63) AS f FROM (SELECT k, greatest((k + 0.5) * 64 / 8 - 0.5, 0) AS pl FROM (SELECT unnest(range(8)) AS k))),
    sc AS (SELECT frame, list_transform(p, lambda z: CASE WHEN hi > lo THEN least(greatest((z - lo) / (hi - lo), 0), 1) ELSE 0 END) AS p FROM im)
    SELECT frame::INT AS roi, round(sum((((1 - wy.f) * p[wy.a * 64 + wx.a + 1] + wy.f * p[wy.b * 64 + wx.a + 1]) * (1 - wx.f) + ((1 - wy.f) * p[wy.a * 64 + wx.b + 1] + wy.f * p[wy.b * 64 + wx.b + 1]) * wx.f) * (wy.k * 8 + wx.k + 1)), 2) AS digest
    FROM sc, wt wy, wt wx GROUP BY frame""")
def i26_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import model_input

    rows = model_input(_planes(spark, sf_dir).where("channel = 1"), 8)
    return rows.select("roi", F.round(F.aggregate(F.transform("input", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v), 2).alias("digest"))


@query()
def i27_network_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import network_input

    rows = network_input(_planes(spark, sf_dir).where("channel = 1"), 16)
    return rows.select("roi", F.round(F.aggregate("input", F.lit(0.0), lambda s, v: s + v), 2).alias("digest"))


@query("""WITH s AS (SELECT s_suppkey AS s, s_nationkey AS frame FROM supplier), px AS (SELECT f.frame, i, EXISTS (SELECT 1 FROM s WHERE s.frame = f.frame AND power(i % 64 + 0.5 - s * 17 % 64, 2) + power(i // 64 + 0.5 - s * 31 % 64, 2) <= 25) AS lit FROM (SELECT DISTINCT frame FROM s) f, (SELECT unnest(range(4096)) AS i)),
    v AS (SELECT (frame % 3)::INT AS pos, CASE WHEN lit THEN 4500 ELSE 190 + (i * 17 + 3) % 31 END AS v FROM px WHERE i % 4 = 0), hist AS (SELECT pos, v AS bin, count(*) AS n FROM v GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY pos ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY pos) AS total FROM hist), lo AS (SELECT pos, min(bin) AS low FROM c WHERE upto > round((total - 1) * 0.5) GROUP BY pos),
    dv AS (SELECT pos, abs(bin - low) AS apart, sum(n) AS n FROM hist JOIN lo USING (pos) GROUP BY ALL), cd AS (SELECT *, sum(n) OVER (PARTITION BY pos ORDER BY apart) AS upto, sum(n) OVER (PARTITION BY pos) AS total FROM dv),
    md AS (SELECT pos, min(apart) AS mad FROM cd WHERE upto > round((total - 1) * 0.5) GROUP BY pos) SELECT pos, low::DOUBLE AS low, round((low + 8 * 1.4826 * mad)::DOUBLE, 6) AS threshold FROM lo JOIN md USING (pos)""")
def i16_shared_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planes(spark, sf_dir).where("channel = 1")
    return rounded(H.robust_scale(H.plane_histogram(rows, ["pos"]), ["pos"], rows))


# ------------------------------------------------- vectors and samples, 2.8

NN_SQL = (
    V_SQL
    + """, un AS (SELECT *, sqrt(list_inner_product(vector, vector)) AS len FROM vv),
    sim AS (SELECT q.vec_id AS id, r.vec_id AS ref_idx, r.label, list_inner_product(q.vector, r.vector) / q.len / r.len AS s FROM un q, un r WHERE q.is_query AND NOT r.is_query),
    nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, ref_idx) AS rank FROM sim QUALIFY rank <= 3),
    vt AS (SELECT id, 'c' || label AS label, sum(1 / greatest(1 - s, 1e-6)) AS votes FROM nn GROUP BY 1, 2),
    kn AS (SELECT id, label AS prediction, votes / sum(votes) OVER (PARTITION BY id) AS support FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1)"""
)


@query(f"WITH {V_SQL} SELECT vec_id, round(list_sum(list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector)))), 6) AS total FROM vv")
def v1_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", C.unit_vector("embedding").alias("u"))
    return rounded(rows.select("vec_id", F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("total")))


@query(f"WITH {NN_SQL} SELECT id, ref_idx, round(s, 6) AS similarity, rank::INT AS rank FROM nn")
def o2_top_k_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import nearest

    references, queries_ = vectors(spark, sf_dir)
    return rounded(nearest(queries_, references, 3))


@query(f"WITH {NN_SQL} SELECT id, prediction, round(support, 6) AS support FROM kn")
def v2_knn_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import knn

    references, queries_ = vectors(spark, sf_dir)
    return rounded(knn(queries_, references, 3))


@query(f"""WITH {V_SQL}, un AS (SELECT *, sqrt(list_inner_product(vector, vector)) AS len FROM vv),
    sim AS (SELECT q.vec_id AS id, r.vec_id AS ref_idx, r.label, list_inner_product(q.vector, r.vector) / r.len AS s FROM un q, un r WHERE q.is_query AND NOT r.is_query),
    nn AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, ref_idx) <= 3),
    g AS (SELECT id, sum(CASE WHEN label < 5 THEN 1 / greatest(1 - s, 1e-6) ELSE 0 END) / sum(1 / greatest(1 - s, 1e-6)) AS v FROM nn GROUP BY id)
    SELECT id, round(v, 6) AS viable_support, CASE WHEN v > 0.5 THEN 'viable' ELSE 'dead' END AS prediction FROM g""")
def v3_viable_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import viable_support

    references, queries_ = vectors(spark, sf_dir)
    return rounded(viable_support(queries_, references.withColumn("label", F.when(F.substring("label", 2, 5).cast("int") < 5, "viable").otherwise("dead"))))


@query()
def v4_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import svm

    references, queries_ = vectors(spark, sf_dir)
    return svm(queries_, references).select("id", "prediction")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ten vectors in order are the frames of a cell; every fifth group is for evaluation."""
    group = F.floor(F.col("vec_id") / 10)
    label = F.when(F.col("vec_id") % 7 == 0, "uncertain").otherwise(F.concat(F.lit("c"), F.col("label").cast("string")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), group.cast("string").alias("group"), F.when(group % 5 == 0, "evaluation").otherwise("reference").alias("split"), label.alias("label"), (F.col("vec_id") % 10).cast("int").alias("frame"), F.lit(0).alias("channel"), F.lit(0).alias("z"), F.col("embedding").cast("array<double>").alias("vector"))


@query(f"""WITH {V_SQL}, mf AS (SELECT vec_id::VARCHAR AS id, (vec_id // 10) % 5 = 0 AS ev, CASE WHEN vec_id % 7 = 0 THEN 'uncertain' ELSE 'c' || label END AS label, vector, sqrt(list_inner_product(vector, vector)) AS len FROM vv),
    sim AS (SELECT q.id, r.id AS rid, q.label AS truth, r.label, list_inner_product(q.vector, r.vector) / q.len / r.len AS s FROM mf q, mf r WHERE q.ev AND NOT r.ev AND r.label <> 'uncertain'),
    nn AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, rid) <= 3), vt AS (SELECT id, truth, label, sum(1 / greatest(1 - s, 1e-6)) AS w FROM nn GROUP BY ALL),
    kn AS (SELECT id, truth, label AS p FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1), g AS (SELECT truth, count(*) AS n, count(*) FILTER (WHERE p = truth) AS h FROM kn WHERE truth <> 'uncertain' GROUP BY truth)
    SELECT sum(n)::BIGINT AS scored, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS macro_recall FROM g""")
def v5_evaluate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import evaluate

    return rounded(evaluate(manifest(spark, sf_dir), methods=("knn",))["knn_metrics"])


UN_SQL = "un AS (SELECT vec_id, vec_id // 10 AS g, vec_id % 10 AS f, unnest(range(1, 65)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings), uv AS (SELECT vec_id, g, f, k, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM un)"


@query(f"WITH {UN_SQL}, tm AS (SELECT vec_id, k, avg(u) OVER (PARTITION BY g, k ORDER BY f ROWS 2 PRECEDING) AS a FROM uv) SELECT vec_id::VARCHAR AS id, round(sum(a * k) / sqrt(sum(a * a)), 5) AS digest FROM tm GROUP BY vec_id")
def d22_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import trailing_mean

    rows = trailing_mean(manifest(spark, sf_dir), 3)
    return rounded(rows.select("id", F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).alias("digest")), 5)


@query(f"WITH {UN_SQL}, bd AS (SELECT vec_id, k, u AS a, u - first_value(u) OVER (PARTITION BY g, k ORDER BY f) AS b FROM uv) SELECT vec_id::VARCHAR AS id, round(sum(a * k + b * (k + 64)) / sqrt(sum(a * a + b * b)), 5) AS digest FROM bd GROUP BY vec_id")
def d23_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import baseline_delta

    rows = baseline_delta(manifest(spark, sf_dir))
    return rounded(rows.select("id", F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).alias("digest")), 5)


@query("""WITH r AS (SELECT vec_id // 10 AS g, vec_id % 10 AS f FROM embeddings),
    m AS (SELECT g::VARCHAR AS "group", CASE WHEN g % 4 = 0 AND f = 0 THEN 'other' WHEN g % 5 = 0 THEN 'evaluation' ELSE 'reference' END AS split, CASE WHEN g % 4 = 1 AND f = 9 THEN 8 ELSE f END AS frame, (g % 4 = 2 AND f = 3)::INT AS channel FROM r)
    SELECT "group", CASE WHEN count(DISTINCT split) > 1 THEN 'mixed split' WHEN count(DISTINCT channel) > 1 THEN 'mixed channel or plane' ELSE 'duplicate frame' END AS problem
    FROM m GROUP BY "group" HAVING count(DISTINCT split) > 1 OR count(DISTINCT channel) > 1 OR count(DISTINCT frame) < count(*)""")
def d24_temporal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import temporal_problems

    g = F.col("group").cast("int")
    rows = manifest(spark, sf_dir).withColumn("split", F.when((g % 4 == 0) & (F.col("frame") == 0), "other").otherwise(F.col("split"))).withColumn("channel", ((g % 4 == 2) & (F.col("frame") == 3)).cast("int"))
    return temporal_problems(rows.withColumn("frame", F.when((g % 4 == 1) & (F.col("frame") == 9), 8).otherwise(F.col("frame"))))


@query(f"""WITH {V_SQL}, r AS (SELECT vec_id::VARCHAR AS id, 'c' || label AS label FROM vv WHERE NOT is_query)
    SELECT id, label FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(sha256('42:' || id), 1, 15))::BIGINT, id) <= 64 // (SELECT count(DISTINCT label) FROM r)""")
def v8_balanced_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import balanced_subset

    return balanced_subset(vectors(spark, sf_dir)[0], 64).select("id", "label")


@query("""WITH r AS (SELECT vec_id::VARCHAR AS id, (vec_id // 10)::VARCHAR AS "group", (vec_id % 10)::INT AS frame FROM embeddings),
    c AS (SELECT "group", row_number() OVER (ORDER BY ('0x' || substr(sha256('42:' || "group"), 1, 15))::BIGINT, "group") AS place FROM (SELECT DISTINCT "group" FROM r) QUALIFY place <= 20), n AS (SELECT count(*) AS n FROM c)
    SELECT id, "group", CASE WHEN place <= greatest(1, least(n - 1, round(n * 0.7))) THEN 'reference' ELSE 'evaluation' END AS split, frame
    FROM r JOIN c USING ("group"), n QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY ('0x' || substr(sha256('42:' || "group" || ':' || frame), 1, 15))::BIGINT, frame) <= 5""")
def v9_roi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import roi_split

    return roi_split(manifest(spark, sf_dir).drop("split"), 20, 5).select("id", "group", "split", "frame")


@query("""SELECT vec_id::VARCHAR AS id, CASE WHEN (vec_id // 10) % 5 = 0 THEN 'evaluation' ELSE 'reference' END AS split, CASE WHEN vec_id % 2 = 0 THEN 'dead' ELSE 'viable' END AS label FROM embeddings WHERE vec_id % 10 % 2 = 0""")
def v10_import_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import import_labelled

    rows = manifest(spark, sf_dir).withColumn("split", F.when(F.col("split") == "evaluation", "val").otherwise("train")).withColumn("label", F.col("id").cast("int") % 2)
    return import_labelled(rows, 2).select("id", "split", "label")


@query("""WITH l AS (SELECT 'Pos' || s_nationkey AS position, s_suppkey AS roi_id, s_suppkey % 25 AS death, 15 + s_suppkey % 9 AS frames, 'Pos' || s_nationkey || '/Roi' || s_suppkey AS cell FROM supplier),
    c AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(sha256('42:' || cell), 1, 15))::BIGINT, cell) AS place, count(*) OVER () AS n FROM l), f AS (SELECT *, unnest(range(frames))::INT AS frame FROM c)
    SELECT position, roi_id, frame, CASE WHEN death >= frames OR frame < death THEN 1 ELSE 0 END AS label, CASE WHEN place <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM f""")
def v11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import dataset_manifest

    labels = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Pos"), F.col("s_nationkey").cast("string")).alias("position"), F.col("s_suppkey").alias("roi_id"), (F.col("s_suppkey") % 25).cast("int").alias("death_frame"))
    return dataset_manifest(labels, labels.select("position", "roi_id", (15 + F.col("roi_id") % 9).cast("int").alias("frame_count")))


@query("""WITH r AS (SELECT s_suppkey AS roi, s_suppkey % 90 + 10 AS n FROM supplier), k AS (SELECT unnest(range(6)) AS i)
    SELECT roi, frame::BIGINT AS frame FROM (SELECT roi, 3 AS frame FROM r UNION SELECT roi, 7 FROM r UNION SELECT roi, floor(i * (n - 1) / 5) FROM r, k)""")
def v12_overview_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import overview_frames

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), (F.col("s_suppkey") % 90 + 10).cast("int").alias("frame_count"), F.array(F.lit(3), F.lit(7)).alias("sampled"))
    return overview_frames(rows).select("roi", F.explode(F.col("review").cast("array<long>")).alias("frame"))


@query(f"WITH {LAB_SQL} SELECT \"group\", label, min(doc_id)::VARCHAR AS id FROM lab GROUP BY 1, 2")
def o6_first_per_group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sampling import first_per_group_label

    return first_per_group_label(labelled(spark, sf_dir).withColumn("frame", F.col("doc_id")).withColumn("id", F.col("doc_id").cast("string"))).select("group", "label", "id")


@query()
def v14_score_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import model_input
    from ..operators.scoring import score_planes

    rows = score_planes(_planes(spark, sf_dir).where("channel = 1"), mean_scorer, model_input)
    return rounded(rows.select("pos", "roi", "t", "p_dead", "label"))


def mean_scorer(images):  # noqa: ANN001, ANN201
    """A fixed stand-in for a model: logits from the mean of the middle and of the whole image."""
    import numpy as np

    images = images.reshape(len(images), 128, 128)
    whole, middle = images.mean((1, 2)), images[:, 32:96, 32:96].mean((1, 2))
    return np.stack([whole, middle], 1) * 4
