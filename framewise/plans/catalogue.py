"""The query catalogue: names, Spark queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, clamp, micro, midtone, srgb_decode, srgb_encode, tangent_plane
from ..operators import catalog, rank, raster, selection, sequence, spatial
from ..sources.tables import frames, samples, seq, stars, table, tiles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Shared beginnings of the SQL: the same tables as in sources.tables.
SEQ = "seq AS (SELECT event_id, event_type AS grp, ts, user_id, floor(value * 100 + 0.5)::BIGINT AS cents, props FROM events)"
NUM = SEQ + ", num AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) AS n FROM seq)"
CURVE = NUM + """, curve AS (
  SELECT event_id, grp, n, sum(cents) OVER w AS s, sum(CASE WHEN n % 2 = 1 THEN cents ELSE -cents END) OVER w AS d
  FROM num WINDOW w AS (PARTITION BY grp ORDER BY n ROWS UNBOUNDED PRECEDING))"""
FRAMES = "frames AS (SELECT o_orderkey AS frame_id, o_orderpriority AS grp, o_orderdate AS ts, o_orderstatus AS camera, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice * 100 + 0.5)::BIGINT END AS known FROM orders)"
SAMPLES = "samples AS (SELECT l_orderkey AS frame_id, (l_partkey % 64)::INTEGER AS x, (l_suppkey % 64)::INTEGER AS y, l_returnflag AS ch, l_linestatus AS part, l_quantity::BIGINT AS q, (100 - floor(l_discount * 100 + 0.5))::BIGINT AS w FROM lineitem)"
TILES = "sites AS (SELECT vec_id, label, pos - 1 AS pos, (pos - 1) % 8 AS x, (pos - 1) // 8 AS y, embedding[pos]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"
STARS = "stars AS (SELECT vec_id AS id, label AS frame, floor(embedding[1]::DOUBLE * 1000000 + 0.5) / 10000 AS x, floor(embedding[2]::DOUBLE * 1000000 + 0.5) / 10000 AS y, abs(floor(embedding[3]::DOUBLE * 1000000 + 0.5)) / 1000000 AS flux FROM embeddings)"
RADIUS = 4.0


def M(x: str) -> str:  # noqa: N802
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- ordered values -------------------------------------------------------------------------------------------------


@query(f"WITH {SEQ}, m AS (SELECT grp, median(cents) AS med FROM seq GROUP BY grp) SELECT event_id, {M('cents / med')} AS rel FROM seq JOIN m USING (grp)")
def relative_to_group(spark, d):
    return sequence.relative_to_median(seq(spark, d), ["grp"], "cents").select("event_id", micro(F.col("rel")).alias("rel"))


@query(f"WITH {SEQ}, m AS (SELECT grp, median(cents) AS med FROM seq GROUP BY grp), a AS (SELECT grp, any_value(med) AS med, median(abs(cents - med)) AS mad FROM seq JOIN m USING (grp) GROUP BY grp) SELECT grp, {M('med / 100')} AS med, {M(f'mad / 100 * {MAD_SCALE}')} AS mad FROM a")
def group_median_mad(spark, d):
    m = rank.median_mad(seq(spark, d), ["grp"], "cents")
    return m.select("grp", micro(F.col("med") / 100).alias("med"), micro(F.col("mad") / 100 * MAD_SCALE).alias("mad"))


@query(f"WITH {SEQ}, s AS (SELECT grp, list_sort(list(cents)) AS v, count(*) AS n, quantile_cont(cents, 0.9) AS qi FROM seq GROUP BY grp) SELECT grp, v[n // 2 + 1] / 100 AS q_upper, v[floor((n - 1) * 0.9)::INT + 1] / 100 AS q_floor, v[floor((n - 1) * 0.9 + 0.5)::INT + 1] / 100 AS q_round, v[ceil((n - 1) * 0.9)::INT + 1] / 100 AS q_ceil, floor(qi + 0.000001) AS q_interp FROM s")
def quantile_rules(spark, d):
    s = seq(spark, d)
    picked = rank.rank_select(s, ["grp"], "cents", {"q_upper": rank.upper_median(), "q_floor": rank.floor_rank(0.9), "q_round": rank.round_rank(0.9), "q_ceil": rank.ceil_rank(0.9)})
    at = rank.rank_select(s, ["grp"], "cents", {"lo": rank.floor_rank(0.9), "hi": rank.ceil_rank(0.9)}).join(s.groupBy("grp").agg(F.count("cents").alias("n")), "grp")
    part = (F.col("n") - 1) * 0.9 - F.floor((F.col("n") - 1) * 0.9)
    interp = at.select("grp", F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * part + 0.000001).cast("double").alias("q_interp"))
    return picked.select("grp", *[(F.col(c) / 100).alias(c) for c in picked.columns[1:]]).join(interp, "grp")


@query(f"WITH {SEQ}, r AS (SELECT grp, cents, row_number() OVER (PARTITION BY grp ORDER BY cents) AS i, count(*) OVER (PARTITION BY grp) AS n FROM seq) SELECT grp, {M('sum(cents) / count(*) / 100')} AS noise FROM r WHERE i <= greatest(1, n // 10) GROUP BY grp")
def lower_decile_mean(spark, d):
    return rank.lowest_share_mean(seq(spark, d), ["grp"], "cents").select("grp", micro(F.col("total") / F.col("k") / 100).alias("noise"))


def _curve(spark, d):
    return sequence.split_curve(seq(spark, d), ["grp"], "day", ["ts", "event_id"], "cents")


@query(f"WITH {CURVE} SELECT event_id, grp, n, {M('s / n / 100')} AS run_mean, CASE WHEN n % 2 = 0 THEN {M('d / n / 100')} END AS split_diff FROM curve")
def cumulative_split_curve(spark, d):
    c = _curve(spark, d)
    return c.select("event_id", "grp", "n", micro(F.col("run_sum") / F.col("n") / 100).alias("run_mean"), F.when(F.col("n") % 2 == 0, micro(F.col("split_sum") / F.col("n") / 100)).alias("split_diff"))


@query(f"WITH {NUM} SELECT grp, max(n) AS n, {M('abs(sum(CASE WHEN n % 2 = 1 THEN cents ELSE -cents END)) / 200')} AS pair FROM num GROUP BY grp, (n - 1) // 2 HAVING count(*) = 2")
def pair_difference(spark, d):
    n = sequence.numbered(seq(spark, d), ["grp"], "day", ["ts", "event_id"])
    g = n.groupBy("grp", F.floor((F.col("n") - 1) / 2)).agg(F.max("n").alias("n"), F.abs(F.sum(F.when(F.col("n") % 2 == 1, F.col("cents")).otherwise(-F.col("cents")))).alias("d"), F.count(F.lit(1)).alias("c"))
    return g.where("c = 2").select("grp", "n", micro(F.col("d") / 200).alias("pair"))


_POINTS = ", ".join(map(str, sequence.checkpoints()))


def _noise(spark, d):
    return _curve(spark, d).where(F.col("n").isin(sequence.checkpoints())).select("grp", "n", "run_sum", (F.abs("split_sum") / F.col("n") / 100).alias("noise"))


@query(f"WITH {CURVE} SELECT grp, n, {M('s / n / 100')} AS run_mean, {M('abs(d) / n / 100')} AS noise FROM curve WHERE n IN ({_POINTS})")
def noise_checkpoints(spark, d):
    return _noise(spark, d).select("grp", "n", micro(F.col("run_sum") / F.col("n") / 100).alias("run_mean"), micro(F.col("noise")).alias("noise"))


_FIT = CURVE + f", p AS (SELECT grp, n, ln(n) AS x, ln(abs(d) / n / 100) AS y FROM curve WHERE n IN ({_POINTS}) AND d <> 0), fit AS (SELECT grp, regr_slope(y, x) AS b, exp(regr_intercept(y, x)) AS a, regr_r2(y, x) AS r2, max(n) AS last_n FROM p GROUP BY grp HAVING count(*) >= 5 AND min(n) >= 4 AND max(n) >= 2 * min(n))"
_round5 = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"


@query(f"WITH {_FIT} SELECT grp, {_round5('b')} AS exponent, {_round5('a')} AS amplitude, {_round5('r2')} AS r2 FROM fit")
def loglog_fit(spark, d):
    f = sequence.power_law(_noise(spark, d), ["grp"], "n", "noise")
    five = lambda c: (F.floor(F.col(c) * 100000 + 0.5) / 100000).alias(c)
    return f.select("grp", five("exponent"), five("amplitude"), five("r2"))


# The noise of the running mean: its standard error.
_ERROR = NUM + f""", e AS (SELECT grp, n, sum(cents) OVER w AS s, sum(cents * cents) OVER w AS ss FROM num WINDOW w AS (PARTITION BY grp ORDER BY n ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT grp, n, ln(n) AS x, ln(sqrt((ss - s / n * s) / n / n) / 100) AS y FROM e WHERE n IN ({_POINTS}) AND ss - s / n * s > 0),
  fit AS (SELECT grp, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, max(n) AS last_n FROM p GROUP BY grp HAVING count(*) >= 5 AND min(n) >= 4 AND max(n) >= 2 * min(n))"""


@query(f"WITH {_ERROR} SELECT grp, f AS fraction, ceil(last_n * (power(1 - f, 1 / b) - 1))::BIGINT AS extra FROM fit, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2]) AS f) WHERE b < -0.05 AND r2 >= 0.8")
def improvement_projection(spark, d):
    n = sequence.numbered(seq(spark, d), ["grp"], "day", ["ts", "event_id"])
    e = sequence.running(n, ["grp"], "day", ["ts", "event_id"], {"s": F.col("cents"), "ss": F.col("cents") * F.col("cents")}).where(F.col("n").isin(sequence.checkpoints()))
    far = F.col("ss") - F.col("s") / F.col("n") * F.col("s")
    noise = e.where(far > 0).select("grp", "n", (F.sqrt(far / F.col("n") / F.col("n")) / 100).alias("noise"))
    return sequence.projections(sequence.power_law(noise, ["grp"], "n", "noise"), ["grp"])


@query(f"WITH {NUM}, t AS (SELECT grp, count(*) AS total FROM seq GROUP BY grp) SELECT grp, n FROM num JOIN t USING (grp) WHERE n & (n - 1) = 0 OR n = total OR n = total - total % 2")
def snapshot_points(spark, d):
    n = sequence.numbered(seq(spark, d), ["grp"], "day", ["ts", "event_id"])
    t = n.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    return n.join(t, "grp").where("(n & (n - 1)) = 0 OR n = total OR n = total - total % 2").select("grp", "n")


@query(f"WITH {SEQ}, s AS (SELECT grp, sum(cents) AS s, count(*) AS c FROM seq GROUP BY grp) SELECT event_id, CASE WHEN c > 1 THEN {M('(s - cents) / (c - 1) / 100')} END AS loo FROM seq JOIN s USING (grp)")
def leave_one_out(spark, d):
    return raster.leave_one_out(seq(spark, d), ["grp"], "cents").select("event_id", micro(F.col("loo") / 100).alias("loo"))


@query(f"WITH {SEQ}, b AS (SELECT grp, ts, user_id, cents, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM seq), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def night_sessions(spark, d):
    return sequence.sessions(seq(spark, d), ["user_id"], "ts", 8 * 3600)


@query(f"WITH {SEQ} SELECT a.event_id, (SELECT max_by(b.cents, b.ts) FROM seq b WHERE b.grp = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) / 100 AS prev FROM seq a WHERE a.grp = 'click'")
def asof_prev(spark, d):
    s = seq(spark, d)
    left, right = s.where("grp = 'click'").select("event_id", "user_id", "ts", "day"), s.where("grp = 'purchase'").select("user_id", "ts", "day", "cents")
    return spatial.as_of(left, right, ["user_id"], "ts", "cents", "day").select("event_id", (F.col("prev") / 100).alias("prev"))


@query(f"""WITH {SEQ}, h AS (SELECT *, hour(ts) AS site FROM seq),
  m1 AS (SELECT site, sum(cents) / count(*) AS m FROM h GROUP BY site),
  w1 AS (SELECT h.site, cents, floor(1000 / (1 + power((cents - m) / 2000, 2)))::BIGINT AS w FROM h JOIN m1 USING (site)), m2 AS (SELECT site, sum(w * cents) / sum(w) AS m FROM w1 GROUP BY site),
  w2 AS (SELECT h.site, cents, floor(1000 / (1 + power((cents - m) / 2000, 2)))::BIGINT AS w FROM h JOIN m2 USING (site)), m3 AS (SELECT site, sum(w * cents) / sum(w) AS m FROM w2 GROUP BY site)
  SELECT site, {M('m / 100')} AS mean3 FROM m3""")
def consensus_sweeps(spark, d):
    h = seq(spark, d).select(F.hour("ts").alias("site"), "cents")
    m = h.groupBy("site").agg((F.sum("cents") / F.count(F.lit(1))).alias("m"))
    for _ in range(2):  # far values weigh less; weights are integers of thousandths
        w = h.join(m, "site").withColumn("w", F.floor(1000 / (1 + F.pow((F.col("cents") - F.col("m")) / 2000, F.lit(2)))))
        m = w.groupBy("site").agg((F.sum(F.col("w") * F.col("cents")) / F.sum("w")).alias("m"))
    return m.select("site", micro(F.col("m") / 100).alias("mean3"))


@query(f"WITH {SEQ}, m AS (SELECT grp, median(cents) AS med FROM seq GROUP BY grp), r AS (SELECT hour(ts) AS site, count(*) AS n, count(*) FILTER (WHERE cents > 2 * med) AS rejected FROM seq JOIN m USING (grp) GROUP BY 1) SELECT site, n, rejected, n >= 5 AND rejected >= n // 2 + 1 AS restored FROM r")
def majority_restore(spark, d):
    r = sequence.relative_to_median(seq(spark, d), ["grp"], "cents").groupBy(F.hour("ts").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rel") > 2).alias("rejected"))
    return r.select("site", "n", "rejected", ((F.col("n") >= 5) & (F.col("rejected") >= F.floor(F.col("n") / 2) + 1)).alias("restored"))


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def header_lookup(spark, d):
    return seq(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- frames ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT grp, coalesce(sum(known), 0)::BIGINT / 100 AS known_s, count(*) FILTER (WHERE known IS NULL) AS unknown_n FROM frames GROUP BY grp")
def exposure_accounting(spark, d):
    return frames(spark, d).groupBy("grp").agg((F.coalesce(F.sum("known"), F.lit(0)) / 100).alias("known_s"), F.count_if(F.col("known").isNull()).alias("unknown_n"))


@query("""WITH l AS (SELECT 'camera' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'grp', o_orderpriority FROM orders), c AS (SELECT field, value, count(*) AS n FROM l GROUP BY field, value)
  SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS rk FROM c""")
def burst_tally(spark, d):
    return selection.tally(frames(spark, d), ["camera", "grp"])


@query(f"WITH {FRAMES}, m AS (SELECT grp, median(cents) AS med FROM frames GROUP BY grp) SELECT frame_id, {M('med / greatest(cents, 1)')} AS scale FROM frames JOIN m USING (grp)")
def exposure_scale(spark, d):
    f = frames(spark, d)
    m = rank.median(f, ["grp"], "cents")
    return f.join(m, "grp").select("frame_id", micro(F.col("med") / F.greatest("cents", F.lit(1))).alias("scale"))


@query(f"WITH {FRAMES} SELECT frame_id, row_number() OVER (ORDER BY ts, frame_id) - 1 AS pos FROM frames QUALIFY pos < 8")
def choose_first(spark, d):
    top = frames(spark, d).orderBy("ts", "frame_id").limit(8)
    return top.select("frame_id", (F.row_number().over(Window.orderBy("ts", "frame_id")) - 1).cast("long").alias("pos"))


@query(f"WITH {FRAMES}, r AS (SELECT frame_id, row_number() OVER (ORDER BY ts, frame_id) - 1 AS pos, count(*) OVER () AS n FROM frames) SELECT frame_id, pos FROM r WHERE pos IN (SELECT i * (n - 1) // 7 FROM (SELECT unnest(range(0, 8)) AS i), (SELECT count(*) AS n FROM orders))")
def choose_spread(spark, d):
    return selection.spread_rows(frames(spark, d), "day", ["ts", "frame_id"], 8).select("frame_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {FRAMES}, t AS (SELECT * FROM frames ORDER BY cents DESC, frame_id LIMIT 8) SELECT frame_id, row_number() OVER (ORDER BY ts, frame_id) - 1 AS pos FROM t")
def choose_best(spark, d):
    top = frames(spark, d).orderBy(F.desc("cents"), "frame_id").limit(8)
    return top.select("frame_id", (F.row_number().over(Window.orderBy("ts", "frame_id")) - 1).cast("long").alias("pos"))


@query(f"WITH {FRAMES} SELECT grp, count(*) AS members, max_by(frame_id, (cents, frame_id)) AS reference FROM (SELECT coalesce(grp, '') AS grp, cents, frame_id FROM frames) GROUP BY grp")
def group_reference(spark, d):
    return selection.references(frames(spark, d), "grp", "cents", "frame_id")


@query(f"""WITH {FRAMES}, m AS (SELECT grp, median(cents) AS med FROM frames GROUP BY grp), s AS (SELECT grp, frame_id, {M('least(cents / med, med / greatest(cents, 1))')} AS score FROM frames JOIN m USING (grp))
  SELECT grp, max_by(frame_id, (score, frame_id)) AS frame_id, max(score) AS score FROM s GROUP BY grp""")
def select_reference(spark, d):
    r = sequence.relative_to_median(frames(spark, d), ["grp"], "cents")
    r = r.withColumn("score", micro(F.least("rel", 1 / F.greatest("rel", F.lit(1e-12)))))
    return r.groupBy("grp").agg(F.max_by("frame_id", F.struct("score", "frame_id")).alias("frame_id"), F.max("score").alias("score"))


@query(f"WITH {SAMPLES}, a AS (SELECT frame_id, sum(q) AS q, sum(w) AS w, count(*) AS n FROM samples GROUP BY frame_id), g AS (SELECT sum(q) / sum(n) AS mean FROM a) SELECT frame_id, {M('least(greatest(w / n / 100, 0), 1) * least(greatest(q / n / mean, 0.5), 2)')} AS weight FROM a, g")
def frame_weights(spark, d):
    a = samples(spark, d).groupBy("frame_id").agg(F.sum("q").alias("q"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    mean = a.agg((F.sum("q") / F.sum("n")).alias("mean"))
    joined = a.join(F.broadcast(mean))  # one row
    return joined.select("frame_id", micro(clamp(F.col("w") / F.col("n") / 100, 0.0, 1.0) * clamp(F.col("q") / F.col("n") / F.col("mean"), 0.5, 2.0)).alias("weight"))


@query(f"WITH {FRAMES} SELECT frame_id, NOT (known IS NULL OR cents > 40000000 OR cents < 100000) AS keep FROM frames")
def photometric_gate(spark, d):
    return frames(spark, d).select("frame_id", (~(F.col("known").isNull() | (F.col("cents") > 40000000) | (F.col("cents") < 100000))).alias("keep"))


@query("""SELECT o_orderpriority AS grp, o_orderstatus AS camera, count(*) AS n, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def rollup_totals(spark, d):
    return frames(spark, d).rollup("grp", "camera").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("""WITH j AS (SELECT o_orderstatus AS camera, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents, c_name FROM orders JOIN customer ON o_custkey = c_custkey),
  f AS (SELECT 'camera' AS section, camera AS name, count(*) AS n, sum(cents)::BIGINT AS cents FROM j GROUP BY camera),
  t AS (SELECT 'object' AS section, c_name AS name, count(*) AS n, sum(cents)::BIGINT AS cents FROM j GROUP BY c_name ORDER BY n DESC, name LIMIT 5)
  SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT 'total', 'all', count(*), sum(cents)::BIGINT FROM j""")
def catalog_summary(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = o.select(F.col("o_orderstatus").alias("camera"), F.floor(F.col("o_totalprice") * 100 + 0.5).alias("cents"), "c_name")
    part = lambda section, by: j.groupBy(by.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select(F.lit(section).alias("section"), "name", "n", "cents")
    return part("camera", F.col("camera")).unionByName(part("object", F.col("c_name")).orderBy(F.desc("n"), "name").limit(5)).unionByName(part("total", F.lit("all")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def set_without(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.without(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("""WITH s AS (SELECT l_orderkey, min(l_shipdate)::DATE - DATE '1970-01-01' AS lo, max(l_shipdate)::DATE - DATE '1970-01-01' AS hi FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, o_orderdate::DATE - DATE '1970-01-01' AS d FROM orders WHERE o_orderstatus = 'P')
  SELECT o_orderkey, count(*) AS n FROM o JOIN s ON d <= hi AND lo <= d + 3 GROUP BY o_orderkey""")
def box_overlap_join(spark, d):
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(day(F.min("l_shipdate")).alias("lo"), day(F.max("l_shipdate")).alias("hi"))
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 3).alias("hi"))
    return spatial.overlap_counts(o, s).where("n > 0").select(F.col("id").alias("o_orderkey"), "n")


# --- documents, pages, conversations as catalogue rows ----------------------------------------------------------------


@query("WITH f AS (SELECT md5(text) AS g, min(doc_id) AS m FROM documents WHERE text IS NOT NULL GROUP BY g) SELECT doc_id, CASE WHEN m < doc_id THEN m END AS same_as FROM documents LEFT JOIN f ON md5(text) = g")
def dedupe_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return selection.first_of_equal(docs, "digest", "doc_id").select("doc_id", "same_as")


# Of the length (8 bytes, little-endian), the first 64 KiB and, beyond 128 KiB, the last 64 KiB; texts here are ASCII or hashed as hex of their bytes.
@query("""WITH h AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS x FROM documents)
  SELECT doc_id, sha256(unhex(string_agg(lpad(hex((n >> (8 * i)) & 255), 2, '0'), '' ORDER BY i) || x[1:131072] || CASE WHEN n > 131072 THEN x[-131072:] ELSE '' END))[1:16] AS digest
  FROM h, (SELECT unnest(range(0, 8)) AS i) GROUP BY doc_id, n, x""")
def bounded_digest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return docs.select("doc_id", catalog.bounded_digest(F.col("b")).alias("digest"))



def _verdicts(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def screened_rows(spark, d):
    return _verdicts(spark, d).select("doc_id", catalog.screened_by([("toxic", F.col("toxic") == 1), ("quality", F.col("quality") == 0)]).alias("reason"))


@query("SELECT s AS screen, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id), (SELECT unnest(['toxic', 'quality']) AS s) WHERE CASE s WHEN 'toxic' THEN toxic ELSE quality END IS NULL GROUP BY s")
def unjudged_counts(spark, d):
    return catalog.unjudged(_verdicts(spark, d), [("toxic", F.col("toxic")), ("quality", F.col("quality"))])


@query("""SELECT page_id, CASE WHEN starts_with(lower(url), 'https://blog.') THEN 'blog/' || url[14:] WHEN starts_with(lower(url), 'http://www.') THEN 'www/' || url[12:] WHEN starts_with(lower(url), 'http://') THEN 'plain/' || url[8:] END AS new_url FROM pages""")
def path_rewrite(spark, d):
    return table(spark, d, "pages").select("page_id", catalog.rewrite(F.col("url"), [("HTTPS://blog.", "blog/"), ("http:\\\\www.", "www/"), ("http://", "plain/")]).alias("new_url"))


@query("""WITH c AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS a, replace(url, 'http://', 'https://') AS b, url AS u FROM pages), e AS (SELECT DISTINCT url FROM pages)
  SELECT page_id, CASE WHEN a IN (SELECT url FROM e) THEN a WHEN b IN (SELECT url FROM e) THEN b ELSE u END AS path FROM c""")
def locate_first(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return catalog.locate_first(p, "page_id", [F.regexp_replace("url", "[?#].*$", ""), F.replace("url", F.lit("http://"), F.lit("https://")), F.col("url")], p, "url")


@query("SELECT p_partkey, trim(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')[1:40], '-') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", catalog.slug(F.col("p_name")).alias("slug"))


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations e WHERE e.conv_id = c.conv_id)")
def project_latest(spark, d):
    return catalog.latest(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn")


@query("""WITH a AS (SELECT doc_id, md5(text) AS g FROM documents WHERE doc_id % 2 = 1), m AS (SELECT DISTINCT md5(text) AS g FROM documents WHERE doc_id % 2 = 0),
  s AS (SELECT CASE WHEN g IN (SELECT g FROM m WHERE g IS NOT NULL) OR row_number() OVER (PARTITION BY g ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM a) SELECT status, count(*) AS n FROM s GROUP BY status""")
def project_ingest(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return catalog.ingest(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"), "digest").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'kept' END AS reason FROM documents), v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' END AS r FROM labels)
  SELECT doc_id, CASE WHEN v.doc_id IS NOT NULL THEN r ELSE reason END AS reason, v.doc_id IS NOT NULL AND r IS DISTINCT FROM reason AS changed FROM m LEFT JOIN v USING (doc_id)""")
def review_apply(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "kept").alias("reason"))
    return catalog.review(m, table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("reason")), "doc_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/moved/' || page_id ELSE url END AS path FROM pages")
def relink_update(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return catalog.upsert(p, p.where("page_id % 3 = 0").withColumn("path", F.concat(F.lit("/moved/"), "page_id")), ["page_id"])


# --- samples on a grid ------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES} SELECT x, y, bool_and(q > 0 AND q < 50) AS valid FROM samples GROUP BY x, y")
def common_footprint(spark, d):
    return samples(spark, d).groupBy("x", "y").agg(F.bool_and((F.col("q") > 0) & (F.col("q") < 50)).alias("valid"))


@query(f"WITH {SAMPLES} SELECT x // 16 AS cx, y // 16 AS cy, {M('sum(q) / count(*) / 50')} AS m FROM samples GROUP BY ALL")
def cell_means(spark, d):
    cell = lambda c: F.floor(F.col(c) / 16).cast("int").alias("c" + c)
    return samples(spark, d).groupBy(cell("x"), cell("y")).agg(micro(F.sum("q") / F.count(F.lit(1)) / 50).alias("m"))


@query(f"WITH {SAMPLES}, v AS (SELECT DISTINCT ch, q FROM samples), s AS (SELECT ch, q - lag(q) OVER (PARTITION BY ch ORDER BY q) AS d FROM v) SELECT ch, min(d) AS step FROM s GROUP BY ch")
def quantisation_step(spark, d):
    v = samples(spark, d).select("ch", "q").distinct()
    return v.withColumn("d", F.col("q") - F.lag("q").over(Window.partitionBy("ch").orderBy("q"))).groupBy("ch").agg(F.min("d").alias("step"))


@query(f"WITH {SAMPLES} SELECT ch, x // 8 AS bx, y // 8 AS by, {M('median(q) / 50')} AS med, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) >= 32")
def block_medians(spark, d):
    b = lambda c: F.floor(F.col(c) / 8).cast("int").alias("b" + c)
    m = rank.median(samples(spark, d).select("ch", b("x"), b("y"), "q"), ["ch", "bx", "by"], "q")
    return m.where("n >= 32").select("ch", "bx", "by", micro(F.col("med") / 50).alias("med"), "n")


@query(f"""WITH {SAMPLES}, f AS (SELECT x // 16 AS cx, y // 16 AS cy, frame_id, {M('sum(q) / count(*)')} AS s FROM samples GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY s DESC, frame_id)::INTEGER AS rk FROM f) SELECT cx, cy, frame_id, rk FROM r WHERE rk <= 10""")
def rank_per_region(spark, d):
    cell = lambda c: F.floor(F.col(c) / 16).cast("int").alias("c" + c)
    f = samples(spark, d).groupBy(cell("x"), cell("y"), "frame_id").agg(micro(F.sum("q") / F.count(F.lit(1))).alias("s"))
    return selection.top_of_region(f, ["cx", "cy"], "s", "frame_id", 10).select("cx", "cy", "frame_id", "rk")


@query(f"""WITH {SAMPLES}, s AS (SELECT x // 16 AS cx, y // 16 AS cy, list_sort(list(q)) AS v, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) >= 4), r AS (SELECT v[floor((n - 1) * 0.9)::INT + 1] / v[floor((n - 1) * 0.5)::INT + 1] AS r FROM s) SELECT {M('median(r)')} AS ratio, count(*) AS cells FROM r""")
def seeing_variability(spark, d):
    s = samples(spark, d).select(F.floor(F.col("x") / 16).alias("cx"), F.floor(F.col("y") / 16).alias("cy"), "q")
    r = rank.rank_select(s, ["cx", "cy"], "q", {"hi": rank.floor_rank(0.9), "lo": rank.floor_rank(0.5), "many": F.when(F.col("n") >= 4, F.lit(0))}).where("many IS NOT NULL")
    return r.agg(micro(F.median(F.col("hi") / F.col("lo"))).alias("ratio"), F.count(F.lit(1)).alias("cells"))


_DEP = "dep AS (SELECT x, y, ch, sum(w) AS sum_w, sum(w * q) AS sum_wv, sum(w * w) AS sum_ww, count(*) AS n FROM samples WHERE w > 0 GROUP BY ALL)"


@query(f"WITH {SAMPLES}, {_DEP} SELECT x, y, ch, sum_w::BIGINT AS sum_w, {M('sum_wv / sum_w / 50')} AS mean, {M('sum_w * sum_w / sum_ww')} AS neff FROM dep")
def weighted_deposit(spark, d):
    p = raster.deposit(samples(spark, d), ["x", "y", "ch"], "q", "w")
    return p.select("x", "y", "ch", "sum_w", micro(F.col("sum_wv") / F.col("sum_w") / 50).alias("mean"), micro(F.col("sum_w") * F.col("sum_w") / F.col("sum_ww")).alias("neff"))


@query(f"WITH {SAMPLES}, {_DEP} SELECT x, y, ch, {M('sum_wv / sum_w / 50')} AS value, n FROM dep")
def accumulator_combine(spark, d):
    s = samples(spark, d)
    parts = [raster.deposit(s.where(F.col("part") == p), ["x", "y", "ch"], "q", "w") for p in ("F", "O")]
    return raster.combine(parts, ["x", "y", "ch"]).select("x", "y", "ch", micro(F.col("sum_wv") / F.col("sum_w") / 50).alias("value"), "n")


# Values are whole millionths, so sums of neighbours don't depend on their order.
@query(f"""WITH {SAMPLES}, c AS (SELECT ch, x, y, floor(sum(q) * 1000000 / (count(*) * 50) + 0.5)::BIGINT AS v FROM samples GROUP BY ch, x, y),
  s AS (SELECT ch, x + dx AS x, y + dy AS y, greatest(abs(dx), abs(dy)) AS ring, sum(v) AS v, count(*) AS n FROM c, (SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-5, 6)) AS dy) GROUP BY ALL),
  m AS (SELECT *, row_number() OVER (PARTITION BY ch, x, y ORDER BY ring) AS i FROM s WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63)
  SELECT ch, x::INTEGER AS x, y::INTEGER AS y, floor(v / n + 0.5) / 1000000 AS v, ring::INTEGER AS ring FROM m WHERE i = 1""")
def hole_fill(spark, d):
    c = samples(spark, d).groupBy("ch", "x", "y").agg(F.floor(F.sum("q") * 1000000 / (F.count(F.lit(1)) * 50) + 0.5).alias("v"))
    filled = raster.fill_holes(c, ["ch"], "v", 64, 64, reach=5)
    return filled.select("ch", "x", "y", (F.floor(F.col("v") / F.col("n") + 0.5) / 1000000).alias("v"), "ring")


@query(f"WITH {SAMPLES} SELECT count(*) FILTER (WHERE ch = 'R' AND q >= 50) AS clipped_r, count(*) FILTER (WHERE ch = 'A' AND q >= 50) AS clipped_a, count(*) FILTER (WHERE ch = 'N' AND q >= 50) AS clipped_n FROM samples")
def clip_counts(spark, d):
    return samples(spark, d).agg(*[F.count_if((F.col("ch") == c.upper()) & (F.col("q") >= 50)).alias(f"clipped_{c}") for c in "ran"])


@query(f"WITH {SAMPLES}, c AS (SELECT x, y, max(q) AS v FROM samples GROUP BY x, y), s AS (SELECT list_sort(list(v)) AS v, count(*) AS n FROM c) SELECT {M('0.9 * 50 / v[floor((n - 1) * 0.99)::INT + 1]')} AS gain FROM s")
def exposure_gain(spark, d):
    c = samples(spark, d).groupBy("x", "y").agg(F.max("q").alias("v")).withColumn("g", F.lit(0))
    return rank.rank_select(c, ["g"], "v", {"hi": rank.floor_rank(0.99)}).select(micro(0.9 * 50 / F.col("hi")).alias("gain"))


@query(f"WITH {SAMPLES} SELECT x % 8 AS bx, y % 8 AS by, count(*) AS n FROM samples GROUP BY ALL")
def phase_histogram(spark, d):
    return samples(spark, d).groupBy((F.col("x") % 8).alias("bx"), (F.col("y") % 8).alias("by")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES}, h AS (SELECT ch, x % 8 AS bx, count(*) AS n FROM samples GROUP BY ALL), t AS (SELECT ch, sum(n) AS t FROM h GROUP BY ch) SELECT ch, {_round5('exp(-sum(n / t * ln(n / t)))')} AS perp FROM h JOIN t USING (ch) GROUP BY ch")
def perplexity(spark, d):
    h = samples(spark, d).groupBy("ch", (F.col("x") % 8).alias("bx")).agg(F.count(F.lit(1)).alias("n"))
    t = h.groupBy("ch").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return h.join(t, "ch").groupBy("ch").agg((F.floor(F.exp(-F.sum(p * F.ln(p))) * 100000 + 0.5) / 100000).alias("perp"))


@query(f"WITH {SAMPLES}, h AS (SELECT ch, x % 8 AS b, count(*) AS n FROM samples GROUP BY ALL), s AS (SELECT ch, sum(n * sin(2 * pi() * b / 8)) AS s, sum(n * cos(2 * pi() * b / 8)) AS c, sum(n) AS n FROM h GROUP BY ch) SELECT ch, {_round5('sqrt(s * s + c * c) / n')} AS conc FROM s")
def circular_phase(spark, d):
    h = samples(spark, d).groupBy("ch", (F.col("x") % 8).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    a = 2 * F.pi() * F.col("b") / 8
    s = h.groupBy("ch").agg(F.sum(F.col("n") * F.sin(a)).alias("s"), F.sum(F.col("n") * F.cos(a)).alias("c"), F.sum("n").alias("n"))
    return s.select("ch", (F.floor(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n") * 100000 + 0.5) / 100000).alias("conc"))


# --- tiles --------------------------------------------------------------------------------------------------------------


def _planes(spark, d):
    return tiles(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _sites(spark, d):
    return raster.tile_sites(tiles(spark, d), ["vec_id", "label"], "embedding", 8)


@query(f"WITH {TILES}, u AS (SELECT vec_id, x - 3.5 AS u, y - 3.5 AS w, v FROM sites), m AS (SELECT vec_id, sum(v) AS sv, sum(u * v) AS su, sum(w * v) AS sw, sum(v * v) AS svv FROM u GROUP BY vec_id) SELECT vec_id, {M('sqrt(greatest(svv - sv * sv / 64 - (su * su + sw * sw) / 336, 0) / 61)')} AS sigma FROM m")
def detrended_sigma(spark, d):
    return _planes(spark, d).select("vec_id", micro(F.sqrt(plane.detrended(F.col("e"), 8)["var"])).alias("sigma"))


_GRAD = TILES + ", n AS (SELECT vec_id, label, x, y, (lead(v) OVER r - lag(v) OVER r) / 2 AS gx, (lead(v) OVER c - lag(v) OVER c) / 2 AS gy FROM sites WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)), t AS (SELECT vec_id, avg(gx * gx) AS a, avg(gx * gy) AS b, avg(gy * gy) AS c FROM n WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY vec_id)"


@query(f"WITH {_GRAD} SELECT vec_id, {M('a + c')} AS energy FROM t")
def tenengrad_tile(spark, d):
    return _planes(spark, d).select("vec_id", micro(plane.tenengrad(F.col("e"), 8) / 4).alias("energy"))


@query(f"WITH {_GRAD} SELECT vec_id, {M('sqrt((a - c) * (a - c) + 4 * b * b) / (a + c)')} AS aniso FROM t")
def gradient_anisotropy(spark, d):
    return _planes(spark, d).select("vec_id", micro(plane.anisotropy(F.col("e"), 8)).alias("aniso"))


@query(f"""WITH {TILES}, h AS (SELECT vec_id, pos, x, y, (coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v)) / 4 AS v FROM sites WINDOW r AS (PARTITION BY vec_id, y ORDER BY x))
  SELECT vec_id, pos::INTEGER AS pos, {M('(coalesce(lag(v) OVER c, v) + 2 * v + coalesce(lead(v) OVER c, v)) / 4')} AS v FROM h WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)""")
def blur3(spark, d):
    b = _planes(spark, d).select("vec_id", F.posexplode(plane.blur3(F.col("e"), 8)).alias("pos", "v"))
    return b.select("vec_id", "pos", micro(F.col("v")).alias("v"))


@query(f"WITH {TILES} SELECT vec_id, (x // 2)::INTEGER AS x, (y // 2)::INTEGER AS y, {M('avg(v)')} AS v FROM sites GROUP BY vec_id, x // 2, y // 2")
def downsample2(spark, d):
    b = _planes(spark, d).select("vec_id", F.posexplode(plane.downsample2(F.col("e"), 8)).alias("pos", "v"))
    return b.select("vec_id", (F.col("pos") % 4).alias("x"), F.floor(F.col("pos") / 4).cast("int").alias("y"), micro(F.col("v")).alias("v"))


@query(f"""WITH {TILES}, f AS (SELECT vec_id, pos, v, lag(v, 2) OVER r AS a, lead(v, 2) OVER r AS b, lag(v, 2) OVER c AS c, lead(v, 2) OVER c AS e FROM sites WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
  SELECT vec_id, pos::INTEGER AS pos, {M('v - (a + b + c + e - least(a, b, c, e) - greatest(a, b, c, e)) / 2')} AS excess FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL""")
def neighbour_excess(spark, d):
    b = _planes(spark, d).select("vec_id", F.posexplode(plane.excess(F.col("e"), 8)).alias("pos", "v"))
    return b.where("v IS NOT NULL").select("vec_id", "pos", micro(F.col("v")).alias("excess"))


@query(f"WITH {TILES}, m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM sites GROUP BY vec_id) SELECT vec_id, string_agg(lpad(lower(to_hex(floor((v - lo) / (hi - lo) * 65535 + 0.5)::BIGINT)), 4, '0'), '' ORDER BY pos) AS pixels FROM sites JOIN m USING (vec_id) WHERE hi > lo GROUP BY vec_id")
def hex_preview(spark, d):
    t = tiles(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    t = t.select("vec_id", "e", F.array_min("e").alias("lo"), F.array_max("e").alias("hi")).where("hi > lo")
    pixel = lambda x: F.lpad(F.lower(F.hex(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 65535 + 0.5).cast("long"))), 4, "0")
    return t.select("vec_id", F.concat_ws("", F.transform("e", pixel)).alias("pixels"))


@query(f"WITH {TILES} SELECT label, pos::INTEGER AS pos, {M('median(v)')} AS med, count(*) AS n FROM sites GROUP BY label, pos")
def fixed_pattern_sites(spark, d):
    m = rank.median(_sites(spark, d).select("label", "pos", "v"), ["label", "pos"], "v")
    return m.select("label", "pos", micro(F.col("med")).alias("med"), "n")


@query(f"""WITH {TILES}, c AS (SELECT vec_id, pos, least(greatest(v + 0.5, 0), 1) AS u FROM sites), e AS (SELECT *, CASE WHEN u <= 0.0031308 THEN u * 12.92 ELSE 1.055 * power(u, 1 / 2.4) - 0.055 END AS s FROM c)
  SELECT vec_id, pos::INTEGER AS pos, {_round5('s')} AS encoded, {_round5('CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE power((s + 0.055) / 1.055, 2.4) END')} AS decoded, {_round5('CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE (0.25 - 1) * u / ((2 * 0.25 - 1) * u - 0.25) END')} AS mid FROM e""")
def tone_curves(spark, d):
    u = clamp(F.col("v") + 0.5, 0.0, 1.0)
    s = _sites(spark, d).select("vec_id", "pos", u.alias("u")).withColumn("s", srgb_encode(F.col("u")))
    five = lambda c: F.floor(c * 100000 + 0.5) / 100000
    return s.select("vec_id", "pos", five(F.col("s")).alias("encoded"), five(srgb_decode(F.col("s"))).alias("decoded"), five(midtone(F.col("u"), F.lit(0.25))).alias("mid"))


_PAIR = TILES + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS x, b.v AS y FROM sites a JOIN sites b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos)"


def _pairs(spark, d):
    """(a, b, s) of each tile and the next: plane.pair_sums of their values, from one join of arrays."""
    t = _planes(spark, d)
    other = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("e").alias("o"))
    return t.join(other, "vec_id").select(F.col("vec_id").alias("a"), "b", plane.pair_sums(F.col("e"), F.col("o")).alias("s"))


@query(f"WITH {_PAIR} SELECT a, b, {_round5('10 * log10(1 / avg((x - y) * (x - y)))')} AS psnr FROM p GROUP BY a, b")
def psnr_pairs(spark, d):
    m = _pairs(spark, d).select("a", "b", (F.col("s.dd") / 64).alias("mse"))
    return m.select("a", "b", (F.floor(F.when(F.col("mse") > 1e-20, 10 * F.log10(1 / F.col("mse"))).otherwise(99.0) * 100000 + 0.5) / 100000).alias("psnr"))


@query(f"WITH {_PAIR} SELECT a, b, {_round5('regr_slope(y, x)')} AS gain, {_round5('regr_intercept(y, x)')} AS shift FROM p GROUP BY a, b")
def gain_offset_fit(spark, d):
    five = lambda c: F.floor(c * 100000 + 0.5) / 100000
    gain = (F.col("s.xy") - F.col("s.x") * F.col("s.y") / 64) / (F.col("s.xx") - F.col("s.x") * F.col("s.x") / 64)
    g = _pairs(spark, d).withColumn("gain", gain)
    return g.select("a", "b", five(F.col("gain")).alias("gain"), five((F.col("s.y") - F.col("gain") * F.col("s.x")) / 64).alias("shift"))


@query(f"WITH {_PAIR}, m AS (SELECT a, b, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM p GROUP BY a, b) SELECT a, b, {_round5('(2 * mx * my + 0.0001) * (2 * (xy - mx * my) + 0.0009) / ((mx * mx + my * my + 0.0001) * (xx - mx * mx + yy - my * my + 0.0009))')} AS ssim FROM m")
def ssim_pairs(spark, d):
    m = _pairs(spark, d).select("a", "b", *[(F.col(f"s.{k}") / 64).alias(n) for k, n in (("x", "mx"), ("y", "my"), ("xx", "xx"), ("yy", "yy"), ("xy", "xy"))])
    ssim = F.expr("(2 * mx * my + 0.0001D) * (2 * (xy - mx * my) + 0.0009D) / ((mx * mx + my * my + 0.0001D) * (xx - mx * mx + yy - my * my + 0.0009D))")
    return m.select("a", "b", (F.floor(ssim * 100000 + 0.5) / 100000).alias("ssim"))


# --- stars ----------------------------------------------------------------------------------------------------------------

# Every frame's stars against those of frame 0.
_NEAR = STARS + f", near AS (SELECT a.frame AS frame, a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM stars a JOIN stars b ON a.frame <> 0 AND b.frame = 0 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS * RADIUS})"
_RANKED = _NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY d2, b) AS k, row_number() OVER (PARTITION BY frame, b ORDER BY d2, a) AS l, lead(d2) OVER (PARTITION BY frame, a ORDER BY d2, b) AS nx FROM near)"


def _near(spark, d):
    s = stars(spark, d)
    return spatial.within(s.where("frame <> 0"), s.where("frame = 0"), RADIUS, ["frame"])


@query(f"WITH {_RANKED} SELECT frame, a, b, {M('d2')} AS d2 FROM r WHERE k = 1")
def nearest_join(spark, d):
    return spatial.nearest(_near(spark, d), by=["frame"]).select("frame", "a", "b", micro(F.col("d2")).alias("d2"))


@query(f"WITH {_RANKED} SELECT frame, a, b, {M('d2')} AS d2 FROM r WHERE k = 1 AND l = 1")
def mutual_nearest(spark, d):
    return spatial.mutual(_near(spark, d), ["frame"]).select("frame", "a", "b", micro(F.col("d2")).alias("d2"))


@query(f"WITH {_RANKED} SELECT frame, min(a) AS a, b FROM r WHERE k = 1 GROUP BY frame, b")
def one_to_one_pairs(spark, d):
    return spatial.one_to_one(_near(spark, d), ["frame"]).select("frame", "a", "b")


@query(f"WITH {_RANKED} SELECT frame, a, b, {M('d2')} AS d2, {M('nx')} AS d2_next FROM r WHERE k = 1")
def two_nearest(spark, d):
    return spatial.nearest_two(_near(spark, d), ["frame"]).select("frame", "a", "b", micro(F.col("d2")).alias("d2"), micro(F.col("d2_next")).alias("d2_next"))


@query(f"WITH {STARS}, r AS (SELECT floor(x / 10)::BIGINT AS rx, floor(y / 10)::BIGINT AS ry, id, row_number() OVER (PARTITION BY floor(x / 10), floor(y / 10) ORDER BY flux DESC, id)::INTEGER AS rk FROM stars) SELECT rx, ry, id, rk FROM r WHERE rk <= 3")
def region_topk(spark, d):
    s = stars(spark, d).select(F.floor(F.col("x") / 10).alias("rx"), F.floor(F.col("y") / 10).alias("ry"), "id", "flux")
    return selection.top_of_region(s, ["rx", "ry"], "flux", "id", 3).select("rx", "ry", "id", "rk")


@query(f"WITH {STARS}, m AS (SELECT frame, median(flux) AS med, count(*) AS n FROM stars GROUP BY frame), z AS (SELECT med FROM m WHERE frame = 0) SELECT frame, n, CASE WHEN n >= 30 THEN {M('m.med / z.med')} END AS gain FROM m, z")
def stellar_gain(spark, d):
    m = rank.median(stars(spark, d), ["frame"], "flux")
    z = m.where("frame = 0").select(F.col("med").alias("z"))  # one row
    return m.join(F.broadcast(z)).select("frame", "n", F.when(F.col("n") >= 30, micro(F.col("med") / F.col("z"))).alias("gain"))


@query(f"""WITH p AS (SELECT c_custkey, radians(c_custkey % 360 - 180) AS a, radians(c_nationkey * 3 - 36) AS e FROM customer), q AS (SELECT *, sin(radians(10)) * sin(e) + cos(radians(10)) * cos(e) * cos(a) AS w FROM p)
  SELECT c_custkey, CASE WHEN w > 1e-2 THEN {_round5('degrees(cos(e) * sin(a) / w)')} END AS x, CASE WHEN w > 1e-2 THEN {_round5('degrees((cos(radians(10)) * sin(e) - sin(radians(10)) * cos(e) * cos(a)) / w)')} END AS y, w > 1e-2 AS near FROM q""")
def sky_projection(spark, d):
    c = table(spark, d, "customer")
    ra, dec = (F.col("c_custkey") % 360).cast("double"), (F.col("c_nationkey") * 3 - 36).cast("double")
    x, y = tangent_plane(ra, dec, 180.0, 10.0)
    a, e = F.radians(ra - 180.0), F.radians(dec)
    near = F.sin(F.radians(F.lit(10.0))) * F.sin(e) + F.cos(F.radians(F.lit(10.0))) * F.cos(e) * F.cos(a) > 1e-2
    five = lambda c: F.when(near, F.floor(c * 100000 + 0.5) / 100000)
    return c.select("c_custkey", five(x).alias("x"), five(y).alias("y"), near.alias("near"))


def queries() -> dict:
    from . import fields, geometry, judgement, kernels, measures, models, panels, starfield  # noqa: F401  their queries register here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
