"""Queries of levels, validation, apertures, residuals and membership listings; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, micro
from ..operators import rank, spatial
from ..sources.tables import frames, samples, stars, table
from .catalogue import _NEAR, FRAMES, SAMPLES, STARS, TILES, M, _near, _planes, _sites, query

# Black and white levels of the four cells of a 2 by 2 pattern.
BLACK, WHITE = (0, 1, 2, 3), (50, 49, 50, 48)


@query(f"WITH {SAMPLES}, l AS (SELECT frame_id, x, y, q, ((y % 2) * 2 + x % 2) AS cell FROM samples) SELECT cell, count(*) AS n, sum(q)::BIGINT AS q, {M(f'sum((q - [{BLACK[0]}, {BLACK[1]}, {BLACK[2]}, {BLACK[3]}][cell + 1]) / greatest([{WHITE[0]}, {WHITE[1]}, {WHITE[2]}, {WHITE[3]}][cell + 1] - [{BLACK[0]}, {BLACK[1]}, {BLACK[2]}, {BLACK[3]}][cell + 1], 1)) / count(*)')} AS level FROM l GROUP BY cell")
def normalised_levels(spark, d):
    cell = F.pmod(F.col("y"), F.lit(2)) * 2 + F.pmod(F.col("x"), F.lit(2))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    v = samples(spark, d).select("q", cell.alias("cell")).withColumn("v", (F.col("q") - at(BLACK)) / F.greatest(at(WHITE) - at(BLACK), F.lit(1)))
    return v.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), micro(F.sum("v") / F.count(F.lit(1))).alias("level"))


@query(f"WITH {SAMPLES} SELECT frame_id, {M('sum(CASE WHEN q >= 50 THEN 1 ELSE 0 END) / count(*)')} AS saturated, {M('sum(CASE WHEN q > 0 AND q < 50 THEN 1 ELSE 0 END) / count(*)')} AS usable FROM samples GROUP BY frame_id")
def usable_share(spark, d):
    share = lambda c: micro(F.count_if(c) / F.count(F.lit(1)))
    return samples(spark, d).groupBy("frame_id").agg(share(F.col("q") >= 50).alias("saturated"), share((F.col("q") > 0) & (F.col("q") < 50)).alias("usable"))


@query(f"WITH {SAMPLES} SELECT ch, count(*) FILTER (WHERE q & 3 = 0) AS usable, count(*) AS n FROM samples GROUP BY ch")
def mask_bits(spark, d):
    return samples(spark, d).groupBy("ch").agg(F.count_if(F.col("q").bitwiseAND(3) == 0).alias("usable"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES} SELECT x - 8 AS x, y - 8 AS y, sum(q)::BIGINT AS q, count(*) AS n FROM samples WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23 GROUP BY ALL")
def crop_rebase(spark, d):
    c = samples(spark, d).where("x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23")
    return c.groupBy((F.col("x") - 8).alias("x"), (F.col("y") - 8).alias("y")).agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES} SELECT ch, {M('sum(q) / count(*)')} AS mean, {M('sum(q * q) / count(*) - (sum(q) / count(*)) * (sum(q) / count(*))')} AS var, min(q) AS low, max(q) AS high, count(*) AS n FROM samples WHERE q < 50 GROUP BY ch")
def channel_statistics(spark, d):
    q, n = F.col("q"), F.count(F.lit(1))
    return samples(spark, d).where("q < 50").groupBy("ch").agg(micro(F.sum(q) / n).alias("mean"), micro(F.sum(q * q) / n - (F.sum(q) / n) * (F.sum(q) / n)).alias("var"), F.min(q).alias("low"), F.max(q).alias("high"), n.alias("n"))


@query("""WITH v AS (SELECT 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS distinct_values, count(*) - count(o_orderstatus) AS missing FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) - count(o_orderpriority) FROM orders
  UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), count(*) - count(l_linestatus) FROM lineitem)
  SELECT *, CASE WHEN missing > 0 THEN 'fatal' WHEN distinct_values > 4 THEN 'warning' WHEN distinct_values > 1 THEN 'note' ELSE 'ok' END AS severity FROM v""")
def burst_validation(spark, d):
    parts = []
    for name, field in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_linestatus")):
        parts.append(table(spark, d, name).agg(F.lit(field).alias("field"), F.countDistinct(field).alias("distinct_values"), F.count_if(F.col(field).isNull()).alias("missing")))
    v = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return v.withColumn("severity", F.when(F.col("missing") > 0, "fatal").when(F.col("distinct_values") > 4, "warning").when(F.col("distinct_values") > 1, "note").otherwise("ok"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encoded(spark, d):
    return table(spark, d, "pages").select("page_id", F.replace(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")).alias("encoded"))


@query("""WITH r AS (SELECT s_suppkey, (s_suppkey % 64) || ',' || (s_nationkey * 2) || ',' || 8 || ',' || CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '4' END AS roi FROM supplier)
  SELECT s_suppkey, try_cast(string_split(roi, ',')[1] AS INTEGER) AS x, try_cast(string_split(roi, ',')[3] AS INTEGER) * try_cast(string_split(roi, ',')[4] AS INTEGER) AS area FROM r""")
def roi_parse(spark, d):
    s = table(spark, d, "supplier")
    height = F.when(F.col("s_suppkey") % 7 == 0, "x").otherwise("4")
    roi = s.select("s_suppkey", F.split(F.concat_ws(",", (F.col("s_suppkey") % 64).cast("string"), (F.col("s_nationkey") * 2).cast("string"), F.lit("8"), height), ",").alias("r"))
    number = lambda i: F.try_element_at("r", F.lit(i)).try_cast("int")
    return roi.select("s_suppkey", number(1).alias("x"), (number(3) * number(4)).alias("area"))


@query("SELECT event_id, replace(replace(props, '<', '\\u003c'), '\"k\"', '\"key\"') AS embedded FROM events")
def embedded_json(spark, d):
    return table(spark, d, "events").select("event_id", F.replace(F.replace("props", F.lit("<"), F.lit("\\u003c")), F.lit('"k"'), F.lit('"key"')).alias("embedded"))


_APERTURE = SAMPLES + """, img AS (SELECT x, y, sum(q) / count(*) AS v FROM samples GROUP BY x, y), c AS (SELECT s_suppkey, s_suppkey % 64 AS cx, (s_nationkey * 2) % 64 AS cy FROM supplier),
  j AS (SELECT s_suppkey, v, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS r2 FROM c JOIN img ON x BETWEEN cx - 6 AND cx + 6 AND y BETWEEN cy - 6 AND cy + 6),
  sky AS (SELECT s_suppkey, median(v) AS sky FROM j WHERE r2 > 16 AND r2 <= 36 GROUP BY s_suppkey)"""


@query(f"WITH {_APERTURE} SELECT s_suppkey, {M('sum(v) - count(*) * any_value(sky)')} AS flux, count(*) AS n FROM j JOIN sky USING (s_suppkey) WHERE r2 <= 4 GROUP BY s_suppkey")
def aperture_flux(spark, d):
    img = samples(spark, d).groupBy("x", "y").agg((F.sum("q") / F.count(F.lit(1))).alias("v"))
    c = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 64).alias("cx"), (F.col("s_nationkey") * 2 % 64).alias("cy"))
    reach = F.explode(F.sequence(F.lit(-6), F.lit(6)))
    c = c.withColumn("dx", reach).withColumn("dy", reach).withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where("r2 <= 36")
    j = c.select("s_suppkey", "r2", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y")).join(img, ["x", "y"])
    sky = j.where("r2 > 16").groupBy("s_suppkey").agg(F.median("v").alias("sky"))
    disc = j.where("r2 <= 4").groupBy("s_suppkey").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return disc.join(sky, "s_suppkey").select("s_suppkey", micro(F.col("s") - F.col("n") * F.col("sky")).alias("flux"), "n")


@query(f"WITH {TILES}, g AS (SELECT vec_id, abs(lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - v) AS d FROM sites) SELECT vec_id, {M(f'{MAD_SCALE} * median(d) / sqrt(2)')} AS sigma FROM g WHERE d IS NOT NULL GROUP BY vec_id")
def guide_noise(spark, d):
    e = F.col("e")
    d_ = F.filter(F.transform(e, lambda v, i: F.when(i % 8 < 7, F.abs(F.element_at(e, (i + 2).cast("int")) - v))), lambda v: v.isNotNull())
    g = _planes(spark, d).select("vec_id", d_.alias("d"))
    return g.select("vec_id", micro(MAD_SCALE * plane.median(F.col("d")) / F.sqrt(F.lit(2.0))).alias("sigma"))


@query(f"WITH {TILES}, m AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, list_sort(list(v + 1))[9] AS m FROM sites GROUP BY ALL) SELECT vec_id, {M('max(m) / min(m) - 1')} AS span FROM m GROUP BY vec_id")
def sky_span(spark, d):
    s = _sites(spark, d).select("vec_id", F.floor(F.col("x") / 4).alias("tx"), F.floor(F.col("y") / 4).alias("ty"), (F.col("v") + 1).alias("v"))
    m = rank.rank_select(s, ["vec_id", "tx", "ty"], "v", {"m": rank.upper_median()})
    return m.groupBy("vec_id").agg(micro(F.max("m") / F.min("m") - 1).alias("span"))


@query("""WITH r AS (SELECT conv_id, role, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS i FROM conversations)
  SELECT conv_id, role, turn, before IS NOT NULL AND before IS DISTINCT FROM text AS cleared FROM r WHERE i = 1""")
def bookmark_upsert(spark, d):
    w = Window.partitionBy("conv_id", "role")
    r = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w.orderBy("turn"))).withColumn("i", F.row_number().over(w.orderBy(F.desc("turn")))).where("i = 1")
    return r.select("conv_id", "role", "turn", (F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("text"))).alias("cleared"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS revision, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations")
def project_revisions(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("revision"), (F.col("turn") - F.lag("turn").over(w)).alias("gap"))


@query("SELECT doc_id, length(text) AS found, n_chars FROM documents WHERE length(text) IS DISTINCT FROM n_chars UNION ALL SELECT -1, count(*), sum(n_chars)::BIGINT FROM documents")
def verify_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("found"), "n_chars")
    total = docs.agg(F.lit(-1).cast("long").alias("doc_id"), F.count(F.lit(1)).alias("found"), F.sum("n_chars").alias("n_chars"))
    return docs.where(~F.col("found").eqNullSafe(F.col("n_chars"))).unionByName(total)


@query(f"WITH {FRAMES}, r AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY ts, frame_id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM frames) SELECT grp, count(*) FILTER (WHERE i <= least(1000, 2 * n // 3)) AS train, count(*) FILTER (WHERE i > least(1000, 2 * n // 3)) AS withheld FROM r GROUP BY grp")
def training_split(spark, d):
    f = frames(spark, d)
    from ..operators import sequence

    n = f.groupBy("grp").agg(F.least(F.lit(1000), F.floor(2 * F.count(F.lit(1)) / 3)).alias("k"))
    r = sequence.numbered(f, ["grp"], "day", ["ts", "frame_id"], "i").join(n, "grp")
    return r.groupBy("grp").agg(F.count_if(F.col("i") <= F.col("k")).alias("train"), F.count_if(F.col("i") > F.col("k")).alias("withheld"))


@query(f"WITH {SAMPLES}, s AS (SELECT ch, list_sort(list(q)) AS v, count(*) AS n FROM samples GROUP BY ch) SELECT ch, v[least(floor(n * 0.98)::BIGINT, n - 1) + 1] AS ceiling, v[n * 9 // 10 + 1] AS p90 FROM s")
def channel_ceiling(spark, d):
    n = F.col("n")
    return rank.rank_select(samples(spark, d), ["ch"], "q", {"ceiling": F.least(F.floor(n * 0.98), n - 1), "p90": F.floor(n * 9 / 10)})


_MUTUAL = _NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY d2, b) AS k, row_number() OVER (PARTITION BY frame, b ORDER BY d2, a) AS l FROM near), mu AS (SELECT frame, a, b, d2 FROM r WHERE k = 1 AND l = 1)"


@query(f"WITH {_MUTUAL}, g AS (SELECT mu.frame, a % 5 = 0 AS withheld, {M('s.flux / greatest(t.flux, 0.000001)')} AS ratio FROM mu JOIN stars s ON s.id = a JOIN stars t ON t.id = b) SELECT frame, withheld, count(*) AS n, {M('median(ratio)')} AS gain FROM g GROUP BY frame, withheld")
def gain_rows(spark, d):
    s = stars(spark, d)
    side = lambda c: s.select(F.col("id").alias(c), F.col("flux").alias(f"flux_{c}"))
    g = spatial.mutual(_near(spark, d), ["frame"]).join(side("a"), "a").join(side("b"), "b")
    g = g.select("frame", (F.col("a") % 5 == 0).alias("withheld"), micro(F.col("flux_a") / F.greatest("flux_b", F.lit(0.000001))).alias("ratio"))
    return rank.median(g, ["frame", "withheld"], "ratio").select("frame", "withheld", "n", micro(F.col("med")).alias("gain"))


@query(f"WITH {_MUTUAL}, c AS (SELECT mu.frame, floor(x / 10)::BIGINT AS cx, {M('sqrt(d2)')} AS r FROM mu JOIN stars ON id = a) SELECT frame, cx, count(*) AS n, {M('median(r)')} AS p50, max(r) AS worst FROM c GROUP BY frame, cx")
def applied_alignment(spark, d):
    s = stars(spark, d).select(F.col("id").alias("a"), F.floor(F.col("x") / 10).alias("cx"))
    c = spatial.mutual(_near(spark, d), ["frame"]).join(s, "a").withColumn("r", micro(F.sqrt("d2")))
    m = rank.median(c, ["frame", "cx"], "r", "p50").join(c.groupBy("frame", "cx").agg(F.max("r").alias("worst")), ["frame", "cx"])
    return m.select("frame", "cx", "n", micro(F.col("p50")).alias("p50"), "worst")


@query(f"WITH {STARS}, k AS (SELECT frame, id, flux, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, id) AS i FROM stars) SELECT frame, id, {M('flux')} AS flux FROM k WHERE i <= 20")
def brightest_stars(spark, d):
    from ..operators import selection

    return selection.top_of_region(stars(spark, d), ["frame"], "flux", "id", 20).select("frame", "id", micro(F.col("flux")).alias("flux"))
