"""Drift: stability index, KS, false alarms, kernel tests on the proxy tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import PPF_A, PPF_B, PPF_C, PPF_D, hash_below, hash_uniform, psi_null_bias
from ..operators import ecdf as E
from ..operators import mmd as M
from ..operators import psi as P
from ..operators.sampling import stratum_sample
from ..operators.studies import AA_REPEATS, AA_SIZES, false_alarms_of_split
from ..sources.cache import cached
from ..sources.tables import CUT, LINE_FEATURES, LINE_SQL, line_features, read_table
from .helpers import rounded, rsql, shared_dir, written

GAINS = {"l_quantity": 0.30, "l_extendedprice": 0.25, "l_discount": 0.20, "l_tax": 0.15, "returned_value": 0.10}
FEATURES = sorted(LINE_FEATURES)
#: The columns that the features are made of.
FEATURE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _sides(spark, d, *keys):
    long = line_features(spark, d, *keys)
    return long.where("reference").drop("reference"), long.where("NOT reference").drop("reference")


def _gains(spark):
    return spark.createDataFrame(sorted(GAINS.items()), "feature string, gain_share double")


def psi_edges(spark, d):
    edges = P.fit_edges(_sides(spark, d)[0])
    return rounded(edges.select("feature", F.posexplode("interior").alias("i", "edge")))


def psi_effective_bins(spark, d):
    return P.effective_bins(P.fit_edges(_sides(spark, d)[0]))


def psi_shares(spark, d):
    ref, cur = _sides(spark, d)
    return rounded(P.shares(cur, P.fit_edges(ref)))


def psi_by_feature(spark, d):
    return rounded(P.psi(*_sides(spark, d)))


def psi_verdict(spark, d):
    ref, cur = _sides(spark, d)
    psis = P.psi(ref, cur)
    rows = cur.where("feature = 'l_tax'").agg(F.count(F.lit(1)).alias("rows"))
    top = psis.agg(F.max("psi").alias("max_psi")).crossJoin(rows)  # one row each
    return rounded(top.select("max_psi", "rows", P.psi_verdict(F.col("max_psi"), F.col("rows")).alias("word"), P.traffic_light(F.col("max_psi")).alias("light"), P.batch_verdict(F.col("max_psi"), F.col("rows")).alias("code")))


def _monthly(spark, d):
    ref, _ = _sides(spark, d)
    _, cur = _sides(spark, d, "date_format(l_shipdate, 'yyyy-MM') AS month")
    return P.psi(ref, cur, "month")


def psi_month_matrix(spark, d):
    return rounded(P.matrix(_monthly(spark, d), "month", FEATURES))


def psi_impact_topk(spark, d):
    return rounded(P.impact_ranking(P.psi(*_sides(spark, d)), _gains(spark), 4))


def psi_targets(spark, d):
    """Checks of a calibrated month x feature table: each feature's largest and last index, and whether it stays under the alert line."""
    m = _monthly(spark, d)
    return rounded(m.groupBy("feature").agg(F.max("psi").alias("largest"), F.max_by("psi", "month").alias("last"), F.bool_and(F.col("psi") < P.ALERT).alias("under_alert"), F.count_if(F.col("psi") >= P.WARN).cast("int").alias("months_warned")))


def psi_native_crosscheck(spark, d):
    ref, cur = _sides(spark, d)
    return rounded(P.native_psi(ref, cur).join(P.psi(ref, cur), "feature").withColumn("same_verdict", P.psi_verdict(F.col("psi_native")) == P.psi_verdict(F.col("psi"))))


def psi_bias(spark, d):
    ref, cur = _sides(spark, d)
    n = lambda x: x.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    sizes = n(ref).withColumnRenamed("k", "n").join(n(cur).withColumnRenamed("k", "m"), "feature").join(P.effective_bins(P.fit_edges(ref)), "feature")
    return rounded(sizes.select("feature", "bins", psi_null_bias(F.col("n"), F.col("m"), F.col("bins")).alias("bias")), 9)


def ks_statistic(spark, d):
    return rounded(E.ks_two_sample(*_sides(spark, d)))


def ks_daily_events(spark, d):
    """Each event type of the second half of the month against the first half of all types."""
    e = read_table(spark, d, "events").select("event_type", F.lit("value").alias("feature"), "value", (F.dayofmonth("ts") <= 15).alias("first"))
    return rounded(E.ks_two_sample(e.where("first").select("feature", "value"), e.where("NOT first"), "event_type"))


def midrank_ecdf(spark, d):
    ref, cur = _sides(spark, d, "l_orderkey", "l_linenumber", "l_partkey")
    return rounded(E.midrank_against(cur, ref, "l_orderkey", "l_linenumber", "l_partkey"))


def normal_score(spark, d):
    """The score is one of the value, so that it is found once for all rows of a value."""
    ref, cur = _sides(spark, d)
    return rounded(E.normal_score(E.midranks_of_values(cur, ref)).select("feature", "value", "u", "z", "rows"))


def _aa(spark, d):
    """The whole calibration: 7 sizes x 200 draws x all features."""
    return false_alarms_of_split(_aa_rows(spark, d), FEATURES, keep=lambda df: written(df, "aa"))


def _aa_rows(spark, d):
    """A hash split of all rows into reference and holdout."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k")
    wide = read_table(spark, d, "lineitem").select(key, *[F.expr(e).alias(f) for f, e in LINE_FEATURES.items()])
    return wide.withColumn("reference", hash_below(0.7, "aa-split", "k"))


def aa_sweep(spark, d):
    return rounded(_aa(spark, d))


def _aa_kept(spark, d):
    """The sweep as it was computed for these rows and this grid, or computed now."""
    inputs = {"lineitem": read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURE_COLUMNS)}
    return cached(f"{shared_dir(spark)}/pvalues", inputs, {"sizes": AA_SIZES, "repeats": AA_REPEATS, "split": 0.7, "form": 1}, lambda: _aa(spark, d))


def aa_feature_rates(spark, d):
    return rounded(aa_rates(spark, d))


def aa_rates(spark, d):
    """Computed from the rows each time, so that its cost does not hang on what ran before."""
    return E.per_feature_rates(_aa(spark, d))


def aa_family_wise(spark, d):
    return rounded(E.family_wise_rates(_aa_kept(spark, d)))


def bh_any_rejection(spark, d):
    """On given p-values: a hash per event, grouped by user."""
    e = read_table(spark, d, "events").select("user_id", hash_uniform("p", "event_id").alias("ks_pvalue"))
    return E.benjamini_hochberg(e, "user_id")


def mmd_statistic(spark, d):
    """Odd ids against even ones with bandwidth 1, the whole table in blocks."""
    return rounded(M.mmd2_blocks(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") % 2 == 1).alias("current"), F.col("embedding").cast("array<double>").alias("x")), 1.0))


def mmd_permutation(spark, d, n=200):
    """One test per label: its vectors against those of the other labels, at most 2 x 200 rows a test,
    drawn by hash from the whole table."""
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    row = (F.col("vec_id").alias("key"), "x")
    labels = e.where("label IS NOT NULL")
    own = stratum_sample(labels, "label", n, "mmd", "vec_id").select("label", F.lit(True).alias("current"), *row)
    lowest = e.orderBy(hash_uniform("mmd-rest", "vec_id"), "vec_id").limit(2 * n).withColumnRenamed("label", "of")
    rest = labels.select("label").distinct().crossJoin(F.broadcast(lowest)).where(~F.col("label").eqNullSafe(F.col("of")))
    by = Window.partitionBy("label").orderBy(hash_uniform("mmd-rest", "vec_id"), "vec_id")
    rest = rest.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).select("label", F.lit(False).alias("current"), *row)
    both = own.unionByName(rest).withColumn("test", F.concat(F.lit("label-"), F.col("label").cast("string")))
    return M.mmd_tests(both.select("test", "current", "key", "x"), 200)


def mmd_localise(spark, d):
    line = read_table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("current"), F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    line = line.toDF("row_id", "current", "quantity", "discount", "tax").withColumn("u", hash_uniform("loc", "row_id")).orderBy("u").limit(600)
    return M.localise(line, ["quantity", "discount", "tax"], 100)


def mmd_self_aa(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return M.self_aa(e, 60, 10, 50, "self", "vec_id", "x").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.col("detected").cast("double")).alias("false_alarms"))


_REF, _CUR = (f"(SELECT * FROM {LINE_SQL} WHERE {'' if r else 'NOT '}reference)" for r in (True, False))
_EDGES = f"""e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q, count(DISTINCT value) AS ndv, CASE WHEN count(DISTINCT value) <= 30 THEN list_sort(list(DISTINCT value)) END AS vals FROM {_REF} GROUP BY feature),
edges AS (SELECT feature, CASE WHEN len(q) < 11 AND ndv <= 30 THEN list_transform(range(1, len(vals)), lambda i: (vals[i] + vals[i + 1]) / 2.0::DOUBLE) WHEN len(q) > 2 THEN q[2:-2] ELSE q END AS interior FROM e0)"""


def _shares_sql(name: str, source: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"AND a.{by} = c.{by}" if by else ""
    return f"""{name}_c AS (SELECT {b}s.feature, len(list_filter(interior, lambda x: x <= value)) AS bin, count(*) AS n FROM {source} s JOIN edges USING (feature) GROUP BY ALL),
{name}_t AS (SELECT {b}feature, sum(n) AS total FROM {name}_c GROUP BY ALL),
{name} AS (SELECT {b.replace(by, 'a.' + by) if by else ''}a.feature, a.bin, greatest(coalesce(c.n, 0)::DOUBLE / total, 1e-6::DOUBLE) AS share FROM (SELECT {b}feature, total, unnest(range(0, len(interior) + 1)) AS bin FROM {name}_t JOIN edges USING (feature)) a LEFT JOIN {name}_c c ON a.feature = c.feature AND a.bin = c.bin {on})"""


_PSI = f"WITH {_EDGES}, {_shares_sql('r', _REF)}, {_shares_sql('p', _CUR)}, psis AS (SELECT feature, sum((p.share - r.share) * ln(p.share / r.share)) AS psi FROM p JOIN r USING (feature, bin) GROUP BY feature)"
_CUR_M = f"(SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM {LINE_SQL} WHERE NOT reference)"
_PSI_M = f"WITH {_EDGES}, {_shares_sql('r', _REF)}, {_shares_sql('p', _CUR_M, 'month')}, psis AS (SELECT month, feature, sum((p.share - r.share) * ln(p.share / r.share)) AS psi FROM p JOIN r USING (feature, bin) GROUP BY month, feature)"
_GAINS = "(VALUES " + ", ".join(f"('{f}', {g}::DOUBLE)" for f, g in GAINS.items()) + ") AS g(feature, gain_share)"


def _ks_sql(ref: str, cur: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {b}feature"
    refs = f"SELECT {b}feature, value, 0 AS c, 1 AS r FROM {ref}" + (f", (SELECT DISTINCT {by} FROM {cur})" if by else "")
    return f"""SELECT {b}feature, sum(r) AS n_ref, sum(c) AS n_cur, max(abs(fc / nc - fr / nr)) AS ks FROM (
  SELECT *, sum(c) OVER ({part} ORDER BY value)::DOUBLE AS fc, sum(r) OVER ({part} ORDER BY value)::DOUBLE AS fr, sum(c) OVER ({part})::DOUBLE AS nc, sum(r) OVER ({part})::DOUBLE AS nr FROM (
    SELECT {b}feature, value, sum(c) AS c, sum(r) AS r FROM (SELECT {b}feature, value, 1 AS c, 0 AS r FROM {cur} UNION ALL BY NAME {refs}) GROUP BY ALL)) GROUP BY ALL"""


_LAM = "(sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur))) * ks"


def _p_sql(inner: str, names: str) -> str:
    return f"SELECT {names}, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, ks, CASE WHEN {_LAM} < 0.2 THEN 1.0::DOUBLE ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * ({_LAM}) * ({_LAM})))))) END AS pvalue FROM ({inner})"


_VALUES = ", ".join(f"({e})::DOUBLE" for e in LINE_FEATURES.values())
_EV = "(SELECT event_type, 'value' AS feature, value, day(ts) <= 15 AS first FROM events)"
_MID = f"""WITH rf AS (SELECT * FROM {_REF}), n AS (SELECT feature, count(*) AS n FROM rf GROUP BY feature),
v AS (SELECT feature, value, count(*) FILTER (side = 'r') AS k FROM (SELECT feature, value, 'r' AS side FROM rf UNION ALL SELECT feature, value, 'c' FROM {_CUR}) GROUP BY ALL),
w AS (SELECT feature, value, k, sum(k) OVER (PARTITION BY feature ORDER BY value) AS upto FROM v),
u AS (SELECT feature, value, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, (2 * upto - k)::DOUBLE / (2.0::DOUBLE * n))) AS u FROM w JOIN n USING (feature)),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([{', '.join(repr(f) for f in LINE_FEATURES)}]) AS feature, unnest([{_VALUES}]) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


def _horner(x: str, cs: tuple) -> str:
    out = f"({cs[0]!r})::DOUBLE"
    for v in cs[1:]:
        out = f"({out} * {x} + ({v!r})::DOUBLE)"
    return out


def ppf_sql(u: str) -> str:
    tail = lambda q: f"{_horner(q, PPF_C)} / ({_horner(q, PPF_D)} * {q} + 1)"
    low, high, q = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))", f"({u} - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    return f"CASE WHEN {u} < 0.02425::DOUBLE THEN {tail(low)} WHEN {u} > 1 - 0.02425::DOUBLE THEN -({tail(high)}) ELSE {_horner(r, PPF_A)} * {q} / ({_horner(r, PPF_B)} * {r} + 1) END"


def draws_sql(source: str, key: str, seed: str, sizes, repeats: int) -> str:
    """CTEs ``ranked`` (rows of ``source`` with their place) and ``drawn`` (n, repeat, place): a draw takes first + step * i modulo the next prime."""
    u = f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    word = lambda i: f"('0x' || substr(md5('{seed}:' || n || ':' || repeat), {1 + 8 * i}, 8))::BIGINT"
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {u}, {key}) - 1 AS place FROM {source}), nn AS (SELECT count(*) AS total FROM ranked),
pr AS MATERIALIZED (SELECT total, min(p) AS prime FROM (SELECT total, unnest(range(greatest(total, 2), total + 500)) AS p FROM nn) x WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) AS t(d) WHERE d * d <= p AND p % d = 0) GROUP BY total),
di AS (SELECT n, repeat, {word(0)} % prime AS first, {word(1)} % greatest(1, prime - 1) + 1 AS step, total, prime FROM pr, (SELECT unnest({list(sizes)}) AS n), (SELECT unnest(range(0, {repeats})) AS repeat)),
drawn AS (SELECT n, repeat, place FROM (SELECT n, repeat, place, row_number() OVER (PARTITION BY n, repeat ORDER BY i) AS rk FROM (SELECT n, repeat, i, total, (first + step * i) % prime AS place FROM (SELECT *, unnest(range(1, least(n, total) + prime - total + 1)) AS i FROM di)) WHERE place < total) WHERE rk <= n)"""


_AA_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_AA_LONG = f"unnest([{', '.join(repr(f) for f in LINE_FEATURES)}]) AS feature, unnest([{', '.join(f'{f}_' for f in LINE_FEATURES)}]) AS value"
_AA = f"""WITH w AS (SELECT k, ((('0x' || substr(md5('aa-split:' || k), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) < 0.7 AS ref, {', '.join(f'{f}_' for f in LINE_FEATURES)} FROM (SELECT {_AA_KEY} AS k, {', '.join(f'({e})::DOUBLE AS {f}_' for f, e in LINE_FEATURES.items())} FROM lineitem)),
rf AS MATERIALIZED (SELECT {_AA_LONG} FROM w WHERE ref), {_EDGES.replace(_REF, 'rf')}, {draws_sql("(SELECT * FROM w WHERE NOT ref)", "k", "aa", AA_SIZES, AA_REPEATS)},
hl AS (SELECT place, {_AA_LONG} FROM ranked),
vv AS (SELECT feature, value, sum(r) AS r FROM (SELECT feature, value, 1 AS r FROM rf UNION ALL SELECT feature, value, 0 FROM hl) GROUP BY ALL),
vp AS (SELECT feature, value, upto - r AS below, upto, total, len(list_filter(interior, lambda x: x <= value)) AS bin FROM (SELECT *, sum(r) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(r) OVER (PARTITION BY feature) AS total FROM vv) JOIN edges USING (feature)),
hp AS MATERIALIZED (SELECT place, feature, below, upto, total, bin FROM hl JOIN vp USING (feature, value)),
cd AS MATERIALIZED (SELECT n, repeat, feature, below, upto, total, bin, count(*) AS c FROM drawn JOIN hp USING (place) GROUP BY ALL),
ks0 AS (SELECT n, repeat, feature, max(total)::BIGINT AS n_ref, sum(c)::BIGINT AS n_cur, max(greatest(abs(done / size - upto / total::DOUBLE), abs((done - c) / size - below / total::DOUBLE))) AS ks FROM (
  SELECT *, (sum(c) OVER (PARTITION BY n, repeat, feature ORDER BY upto, below))::DOUBLE AS done, (sum(c) OVER (PARTITION BY n, repeat, feature))::DOUBLE AS size FROM cd) GROUP BY ALL),
ks1 AS ({_p_sql('SELECT * FROM ks0', 'n, repeat, feature')}), {_shares_sql('r', 'rf')},
pb AS (SELECT n, repeat, feature, bin, sum(c) AS c FROM cd GROUP BY ALL),
psis AS (SELECT t.n, t.repeat, t.feature, sum((t.share - r.share) * ln(t.share / r.share)) AS psi FROM (SELECT a.n, a.repeat, a.feature, a.bin, greatest(coalesce(pb.c, 0)::DOUBLE / size, 1e-6::DOUBLE) AS share FROM
  (SELECT n, repeat, feature, n_cur AS size, unnest(range(0, len(interior) + 1)) AS bin FROM ks0 JOIN edges USING (feature)) a LEFT JOIN pb ON pb.n = a.n AND pb.repeat = a.repeat AND pb.feature = a.feature AND pb.bin = a.bin) t JOIN r ON r.feature = t.feature AND r.bin = t.bin GROUP BY ALL),
tidy AS MATERIALIZED (SELECT n, repeat::INT AS repeat, feature, ks AS ks_statistic, pvalue AS ks_pvalue, psi FROM ks1 JOIN psis USING (n, repeat, feature)),
bh AS (SELECT n, repeat, bool_or(ks_pvalue <= 0.05::DOUBLE * i / m) AS bh_any FROM (SELECT *, row_number() OVER (PARTITION BY n, repeat ORDER BY ks_pvalue) AS i, count(*) OVER (PARTITION BY n, repeat) AS m FROM tidy) GROUP BY ALL),
fam AS (SELECT n, repeat, min(ks_pvalue) AS p, max(psi) AS psi, count(*) AS m FROM tidy GROUP BY ALL)"""
_R = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END)"
_D2 = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"

_CROSS = f"""SELECT feature, psi_native, psi, (CASE WHEN psi_native < 0.1 THEN 0 WHEN psi_native < 0.25 THEN 1 ELSE 2 END) = (CASE WHEN psi < 0.1 THEN 0 WHEN psi < 0.25 THEN 1 ELSE 2 END) AS same_verdict FROM psis JOIN (
      SELECT feature, sum((p - q) * ln(p / q)) AS psi_native FROM (
        SELECT feature, greatest(coalesce(c, 0)::DOUBLE / ct, 1e-4::DOUBLE) AS p, greatest(coalesce(r, 0)::DOUBLE / rt, 1e-4::DOUBLE) AS q FROM (
          SELECT *, sum(r) OVER (PARTITION BY feature) AS rt, sum(c) OVER (PARTITION BY feature) AS ct FROM (
            SELECT feature, CASE WHEN ndv <= 20 THEN value ELSE least(floor((value - lo) / ((hi - lo) / ceil(log2("all") + 1))), ceil(log2("all") + 1) - 1) END AS slot, count(*) FILTER (reference) AS r, count(*) FILTER (NOT reference) AS c
            FROM {LINE_SQL} JOIN (SELECT feature, count(DISTINCT value) AS ndv, min(value) AS lo, max(value) AS hi, count(*) AS "all" FROM {LINE_SQL} GROUP BY feature) USING (feature) GROUP BY ALL))) GROUP BY feature) USING (feature)"""

QUERIES = {
    f.__name__: f
    for f in (
        psi_edges, psi_effective_bins, psi_shares, psi_by_feature, psi_verdict, psi_month_matrix, psi_impact_topk, psi_targets, psi_native_crosscheck, psi_bias, ks_statistic, ks_daily_events, midrank_ecdf, normal_score,
        aa_sweep, aa_feature_rates, aa_family_wise, bh_any_rejection, mmd_statistic, mmd_permutation, mmd_localise, mmd_self_aa,
    )
}
SQL = {
    "psi_edges": rsql("SELECT feature, CAST(i - 1 AS INTEGER) AS i, interior[i] AS edge FROM (SELECT feature, interior, unnest(range(1, len(interior) + 1)) AS i FROM edges)", "feature, i", "edge", head=f"WITH {_EDGES}"),
    "psi_effective_bins": f"WITH {_EDGES} SELECT feature, CAST(len(interior) + 1 AS INTEGER) AS bins FROM edges",
    "psi_shares": rsql("SELECT feature, CAST(bin AS INTEGER) AS bin, share FROM p", "feature, bin", "share", head=f"WITH {_EDGES}, {_shares_sql('p', _CUR)}"),
    "psi_by_feature": rsql("SELECT * FROM psis", "feature", "psi", head=_PSI),
    "psi_verdict": rsql("""SELECT m AS max_psi, n AS rows, CASE WHEN n < 1000 THEN 'insufficient' WHEN m < 0.1 THEN 'stable' WHEN m < 0.25 THEN 'moderate' ELSE 'significant' END AS word, CASE WHEN m < 0.1 THEN 'green' WHEN m < 0.25 THEN 'amber' ELSE 'red' END AS light,
      CASE WHEN n < 1000 THEN -1 WHEN m IS NULL THEN 0 WHEN m >= 0.25 THEN 2 WHEN m >= 0.1 THEN 1 ELSE 0 END AS code FROM (SELECT max(psi) AS m FROM psis), (SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')""", "rows, word, light, code", "max_psi", head=_PSI),
    "psi_month_matrix": rsql("SELECT month, " + ", ".join(f"max(psi) FILTER (feature = '{f}') AS {f}" for f in FEATURES) + " FROM psis GROUP BY month", "month", ", ".join(FEATURES), head=_PSI_M),
    "psi_impact_topk": rsql(f"SELECT feature, psi, coalesce(gain_share, 0::DOUBLE) AS gain_share, psi * coalesce(gain_share, 0::DOUBLE) AS impact FROM psis LEFT JOIN {_GAINS} USING (feature) ORDER BY impact DESC, feature LIMIT 4", "feature", "psi, gain_share, impact", head=_PSI),
    "psi_targets": rsql("SELECT feature, max(psi) AS largest, arg_max(psi, month) AS last, bool_and(psi < 0.25) AS under_alert, CAST(count(*) FILTER (psi >= 0.1) AS INTEGER) AS months_warned FROM psis GROUP BY feature", "feature, under_alert, months_warned", "largest, last", head=_PSI_M),
    "psi_native_crosscheck": rsql(_CROSS, "feature, same_verdict", "psi_native, psi", head=_PSI),
    "psi_bias": rsql(f"SELECT feature, CAST(len(interior) + 1 AS INTEGER) AS bins, len(interior) * (1.0::DOUBLE / n + 1.0::DOUBLE / m) AS bias FROM edges JOIN (SELECT feature, count(*) FILTER (reference) AS n, count(*) FILTER (NOT reference) AS m FROM {LINE_SQL} GROUP BY feature) USING (feature)", "feature, bins", "bias", 9, head=f"WITH {_EDGES}"),
    "ks_statistic": rsql(_p_sql(_ks_sql(_REF, _CUR), "feature"), "feature, n_ref, n_cur", "ks, pvalue"),
    "ks_daily_events": rsql(_p_sql(_ks_sql(f"(SELECT feature, value FROM {_EV} WHERE first)", f"(SELECT event_type, feature, value FROM {_EV} WHERE NOT first)", "event_type"), "event_type, feature"), "event_type, feature, n_ref, n_cur", "ks, pvalue"),
    "midrank_ecdf": rsql("SELECT l_orderkey, l_linenumber, l_partkey, c.feature, c.value, u FROM c JOIN u ON c.feature = u.feature AND c.value = u.value", "l_orderkey, l_linenumber, l_partkey, feature", "value, u", head=_MID),
    "normal_score": rsql(f"SELECT c.feature, c.value, u, {ppf_sql('u')} AS z, count(*) AS rows FROM c JOIN u ON c.feature = u.feature AND c.value = u.value GROUP BY c.feature, c.value, u", "feature, rows", "value, u, z", head=_MID),
    "aa_sweep": rsql("SELECT * FROM tidy", "n, repeat, feature", "ks_statistic, ks_pvalue, psi", head=_AA),
    "aa_feature_rates": rsql(f"SELECT n, feature, {_R.format('ks_pvalue < 0.05')} AS ks_rate, {_R.format('psi > 0.1')} AS psi_warn_rate, {_R.format('psi > 0.25')} AS psi_alert_rate, avg(psi) AS psi_mean FROM tidy GROUP BY n, feature", "n, feature", "ks_rate, psi_warn_rate, psi_alert_rate, psi_mean", head=_AA),
    "aa_family_wise": rsql(f"SELECT n, {_R.format('p < 0.05')} AS ks_raw, {_R.format('p < 0.05::DOUBLE / m')} AS ks_bonferroni, {_R.format('bh_any')} AS ks_bh, {_R.format('psi > 0.1')} AS psi_warn, {_R.format('psi > 0.25')} AS psi_alert FROM fam JOIN bh USING (n, repeat) GROUP BY n", "n", "ks_raw, ks_bonferroni, ks_bh, psi_warn, psi_alert", head=_AA),
    "bh_any_rejection": "SELECT user_id, bool_or(p <= 0.05::DOUBLE * i / m) AS bh_any FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM (SELECT user_id, (('0x' || substr(md5('p:' || event_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS p FROM events)) GROUP BY user_id",
    "mmd_statistic": rsql("""SELECT avg(CASE WHEN n >= 2 AND m >= 2 THEN (xx - n) / (n * (n - 1)) + (yy - m) / (m * (m - 1)) - 2 * xy / (n * m) END) AS mmd2, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS m, count(*) FILTER (n >= 2 AND m >= 2) AS blocks FROM c JOIN sums USING (block)""", "n, m, blocks", "mmd2", head=f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL)) = 0),
      s AS (SELECT floor((('0x' || substr(md5('mmd-block:' || vec_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE * greatest(1, ceil((SELECT count(*) FROM v) / {M.BLOCK_ROWS}.0::DOUBLE))) AS block, vec_id % 2 AS side, x FROM v),
      k AS (SELECT a.block, a.side AS p, b.side AS q, exp(-({_D2}) / 2.0::DOUBLE) AS k FROM s a JOIN s b ON a.block = b.block),
      c AS (SELECT block, count(*) FILTER (side = 0)::DOUBLE AS n, count(*) FILTER (side = 1)::DOUBLE AS m FROM s GROUP BY block),
      sums AS (SELECT block, sum(k) FILTER (p = 0 AND q = 0) AS xx, sum(k) FILTER (p = 1 AND q = 1) AS yy, sum(k) FILTER (p = 0 AND q = 1) AS xy FROM k GROUP BY block)"""),
}
