"""The registered queries of the ground-motion operators, each with its SQL where SQL can express it.

Every query runs over whole tables.  Floats are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog, displacement, failure, field, matching, pairs, raster, velocity

from ..sources import files
from ..sources import tables as T

FLAGSHIP = "median_velocity_field"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ROI, SEASON = (4.0, 3.0, 12.0, 9.0), ("-05-01", "-10-01")
SIZE, SHAPE, BLOCK, OVERLAP = 8, (40, 50), 8, 0.5

#: The views of sources.tables, in SQL.
VIEWS = {
    "scenes": "SELECT o_orderkey image_id, o_orderdate ts, o_totalprice - 100*floor(o_totalprice/100) cloud, o_custkey % 5 tile, (o_custkey % 10)::DOUBLE xmin, (o_orderkey % 7)::DOUBLE ymin, (o_custkey % 10 + 12)::DOUBLE xmax, (o_orderkey % 7 + 9)::DOUBLE ymax FROM orders",
    "pixels": "SELECT l_orderkey image_id, l_quantity b3, l_discount*100 b11, l_tax*500 b8, CASE WHEN l_returnflag='R' THEN 1024 ELSE 0 END qa60 FROM lineitem",
    "disp0": "SELECT (l_orderkey % 40)::INT pair_id, (l_partkey % 50)::INT x, (l_suppkey % 40)::INT y, (l_discount-0.05::DOUBLE)*100 u, (l_tax-0.04::DOUBLE)*100 v, 1+nullif(l_quantity,7)/50 pkr, nullif(l_quantity,9)/5 snr FROM lineitem",
    "disp": "SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY x,y,u,v,pkr NULLS FIRST,snr NULLS FIRST)-1 pt_idx FROM disp0",
    "years": "SELECT range::INT pair_id, 1 + (range % 8)/2 AS years FROM range(40)",
    "terrain": "SELECT floor(p_partkey/50)::INT y, (p_partkey % 50)::INT x, p_retailprice dem, p_size::DOUBLE slope, (p_size*7 % 360)::DOUBLE aspect FROM part",
    "intervals": "SELECT * FROM (SELECT user_id point, event_id pair_id, ts::DATE d1, (lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DATE d2, value v, 1+(event_id % 7)/10 pkr, (1+event_id % 11)::DOUBLE snr FROM events) WHERE d2 IS NOT NULL",
    "long_intervals": "SELECT l_suppkey point, o_orderdate::DATE d1, l_shipdate::DATE d2, (l_tax-0.04::DOUBLE)*100 u, (l_discount-0.05::DOUBLE)*100 v, 1+l_quantity/50 pkr, l_quantity/5 snr FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "monthly": "SELECT l_suppkey pid, l_shipdate::DATE date, (l_discount-0.05::DOUBLE)*10 velocity FROM lineitem",
    "field": "SELECT x, y, median(u)*10 u, median(v)*10 v, min(pair_id::BIGINT*100000000 + pt_idx) ord FROM disp GROUP BY x, y",
    "rated": "SELECT *, sqrt(u*u+v*v) mag, atan2(v,u) ang FROM field",
}
NEEDS = {"disp": ["disp0"], "field": ["disp0", "disp"], "rated": ["disp0", "disp", "field"]}


def sql(text: str, *views: str) -> str:
    names: list[str] = []
    for v in views:
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {head} {text}" if not text.startswith(",") else f"WITH {head}{text}"


def query(oracle: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = sql(oracle, *views) if views else oracle
        return f

    return register


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


R = lambda *names: ", ".join(f"round({n},6) {n}" for n in names)

# --- catalog ---------------------------------------------------------------------------------------


@query(f"SELECT image_id, {R('cloud')} FROM scenes WHERE cloud < 50 AND xmin <= 4 AND xmax >= 12 AND ymin <= 3 AND ymax >= 9 AND xmin <= 13 AND xmax >= 3", "scenes")
def scene_scan_filter(spark, d):
    return catalog.covering(catalog.scan(T.scenes(spark, d), ROI, 50), ROI).select("image_id", *r6("cloud"))


@query("SELECT image_id, round(100.0*sum(CASE WHEN qa60>0 THEN 1 ELSE 0 END)/count(*),6) cloud_pct FROM pixels GROUP BY 1 HAVING cloud_pct <= 40", "pixels")
def scene_roi_cloud_pct(spark, d):
    s = catalog.cloud_share(T.pixels(spark, d))
    return catalog.at_most(s.select("image_id"), s, "cloud_pct", 40).select("image_id", *r6("cloud_pct"))


@query("SELECT image_id, round(100.0*coalesce(sum(CASE WHEN (b3-b11)/nullif(b3+b11,0) > 0.4 THEN 1 ELSE 0 END),0)/coalesce(nullif(count(nullif(b3+b11,0)),0),1),6) snow_pct FROM pixels GROUP BY 1", "pixels")
def scene_roi_snow_pct(spark, d):
    return catalog.snow_share(T.pixels(spark, d)).select("image_id", *r6("snow_pct"))


@query("SELECT image_id, round(b8,6) b8n, (CASE WHEN (b3-b8)/nullif(b3+b8,0) > 0 THEN NULL ELSE round(b8,6) END) b8 FROM pixels", "pixels")
def water_mask(spark, d):
    p = T.pixels(spark, d).withColumn("b8n", F.round("b8", 6))
    return catalog.masked_water(p, "b8").select("image_id", "b8n", *r6("b8"))


@query(", s AS (SELECT *, year(ts) y, row_number() OVER (PARTITION BY year(ts) ORDER BY ts, image_id)-1 i, count(*) OVER (PARTITION BY year(ts)) n FROM scenes WHERE month(ts) BETWEEN 5 AND 9 AND year(ts) BETWEEN 1996 AND 2000) SELECT image_id, y::INT AS year FROM s WHERE n <= 5 OR (i % (n//5) = 0 AND i/(n//5) < 5)", "scenes")
def scene_season_sample(spark, d):
    return catalog.season_sample(T.scenes(spark, d), 1996, 2000, 5, SEASON).select("image_id", F.col("year").cast("int").alias("year"))


@query(", s AS (SELECT image_id, strftime(ts,'%Y-%m-%d')||'_'||tile date_tile, row_number() OVER (PARTITION BY ts::DATE, tile ORDER BY ts, image_id) n FROM scenes) SELECT image_id, date_tile FROM s WHERE n=1", "scenes")
def scene_dedupe_tile(spark, d):
    return catalog.one_per_tile_and_day(T.scenes(spark, d)).select("image_id", "date_tile")


@query("SELECT year(ts)::INT AS year, count(*) n, CAST(min(ts)::DATE AS VARCHAR) first FROM scenes WHERE ts >= '1996-01-01' AND ts < '2000-01-01' GROUP BY 1", "scenes")
def scene_counts(spark, d):
    return catalog.between(T.scenes(spark, d), "1996-01-01", "2000-01-01").groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.to_date(F.min("ts")).cast("string").alias("first"))


SELECTED = """, a AS (SELECT * FROM scenes WHERE cloud < 50 AND xmin <= 4 AND xmax >= 12 AND ymin <= 3 AND ymax >= 9),
k AS (SELECT image_id FROM pixels GROUP BY 1 HAVING 100.0*sum(CASE WHEN qa60>0 THEN 1 ELSE 0 END)/count(*) <= 60),
b AS (SELECT *, row_number() OVER (PARTITION BY year(ts) ORDER BY ts, image_id)-1 i, count(*) OVER (PARTITION BY year(ts)) n FROM a JOIN k USING (image_id) WHERE ts >= '1993-01-01' AND ts < '1998-07-01' AND month(ts) BETWEEN 5 AND 9),
c AS (SELECT *, strftime(ts,'%Y-%m-%d')||'_'||tile date_tile FROM b WHERE n <= 4 OR (i % (n//4) = 0 AND i/(n//4) < 4))
SELECT image_id, date_tile FROM c QUALIFY row_number() OVER (PARTITION BY date_tile ORDER BY ts, image_id) = 1"""


@query(SELECTED, "scenes", "pixels")
def scene_selection(spark, d):
    return catalog.select_scenes(T.scenes(spark, d), T.pixels(spark, d), ROI, (1992, 1998), SEASON, cloud_max=50, per_year=4, cloud_threshold=60, start="1993-01-01", final="1998-07-01").select("image_id", "date_tile")


# --- pairs -----------------------------------------------------------------------------------------


def _months(spark, d):
    """The first day of each month with scenes: one date for each."""
    return T.scenes(spark, d).select(F.to_date(F.date_trunc("month", "ts")).alias("date")).distinct()


MONTHS = ", m AS (SELECT DISTINCT date_trunc('month', ts)::DATE date FROM scenes), p AS (SELECT a.date dat1, b.date dat2, date_diff('day', a.date, b.date)/365.25::DOUBLE sep FROM m a JOIN m b ON b.date > a.date)"


@query(MONTHS + " SELECT dat1::VARCHAR dat1, dat2::VARCHAR dat2, round(sep,6) sep FROM p WHERE sep > 1 AND sep < 5", "scenes")
def date_pairs(spark, d):
    return pairs.date_pairs(_months(spark, d)).select(F.col("dat1").cast("string"), F.col("dat2").cast("string"), *r6("sep"))


@query(MONTHS + " SELECT dat1::VARCHAR dat1, dat2::VARCHAR dat2, round(sep,6) sep FROM p WHERE sep > 1 AND sep < 5 AND dat1 < '1998-06-15' AND dat2 > '1998-06-15'", "scenes")
def date_pairs_reference(spark, d):
    return pairs.date_pairs(_months(spark, d), reference="1998-06-15").select(F.col("dat1").cast("string"), F.col("dat2").cast("string"), *r6("sep"))


@query(MONTHS + ", i AS (SELECT date_trunc('month', ts)::DATE date, max(image_id) idx FROM scenes GROUP BY 1) SELECT dat1::VARCHAR dat1, dat2::VARCHAR dat2, a.idx idx1, b.idx idx2 FROM p JOIN i a ON a.date=dat1 JOIN i b ON b.date=dat2 WHERE sep > 1 AND sep < 5", "scenes")
def date_index_lookup(spark, d):
    s = T.scenes(spark, d).select(F.to_date(F.date_trunc("month", "ts")).alias("date"), F.col("image_id").alias("idx"))
    return pairs.with_indexes(pairs.date_pairs(_months(spark, d)), s).select(F.col("dat1").cast("string"), F.col("dat2").cast("string"), "idx1", "idx2")


# --- filters over pairs ----------------------------------------------------------------------------

MAG = "sqrt(u*u+v*v)"
KEPT = "pair_id, pt_idx, x, y"


def _kept(d):
    return displacement.end(d).select("pair_id", "pt_idx", "x", "y", *r6("u", "v"))


@query(f"SELECT {KEPT}, {R('u', 'v')} FROM disp WHERE {MAG} > 1 AND {MAG} < 4.5", "disp")
def pair_magnitude(spark, d):
    return _kept(displacement.by_magnitude(displacement.begin(T.displacements(spark, d)), 1, 4.5))


@query(f", m AS (SELECT y, x, slope < 10 AS invalid FROM terrain) SELECT {', '.join('d.' + c for c in KEPT.split(', '))}, {R('u', 'v')} FROM disp d LEFT JOIN m ON m.y = least(greatest(d.y,0),39) AND m.x = least(greatest(d.x,0),49) WHERE NOT coalesce(invalid, false)", "disp", "terrain")
def pair_zero_mask(spark, d):
    mask = T.terrain(spark, d).select("y", "x", (F.col("slope") < 10).alias("invalid"))
    return _kept(displacement.by_mask(displacement.begin(T.displacements(spark, d)), mask, *SHAPE))


@query(f", s AS (SELECT *, avg(u) OVER w mu, stddev_pop(u) OVER w su, avg(v) OVER w mv, stddev_pop(v) OVER w sv FROM disp WINDOW w AS (PARTITION BY pair_id)) SELECT {KEPT}, {R('u', 'v')} FROM s WHERE abs(u-mu) < 1.3*su AND abs(v-mv) < 1.3*sv", "disp")
def pair_deviation(spark, d):
    return _kept(displacement.by_deviation(displacement.begin(T.displacements(spark, d)), 1.3))


@query(f", s AS (SELECT *, median(u) OVER (PARTITION BY pair_id) mu, median(v) OVER (PARTITION BY pair_id) mv FROM disp) SELECT {KEPT}, round(u-mu,6) u, round(v-mv,6) v FROM s", "disp")
def pair_remove_median(spark, d):
    return _kept(displacement.without_median(displacement.begin(T.displacements(spark, d))))


@query(f", s AS (SELECT *, count(pkr) OVER (PARTITION BY pair_id) np, count(snr) OVER (PARTITION BY pair_id) ns FROM disp) SELECT {KEPT}, {R('u', 'v')} FROM s WHERE (np=0 OR pkr>=1.3) AND (ns=0 OR snr>=3)", "disp")
def pair_pkr_snr(spark, d):
    return _kept(displacement.by_quality(displacement.by_quality(displacement.begin(T.displacements(spark, d)), "pkr", 1.3), "snr", 3))


DEFAULT = f", s AS (SELECT *, {MAG} > 0 AS ok FROM disp), t AS (SELECT *, median(CASE WHEN ok THEN u END) OVER (PARTITION BY pair_id) mu, median(CASE WHEN ok THEN v END) OVER (PARTITION BY pair_id) mv FROM s)"


@query(DEFAULT + f" SELECT {KEPT}, round(u-mu,6) u, round(v-mv,6) v FROM t WHERE ok AND pkr>=1.3 AND snr>=3", "disp")
def pair_filter_default(spark, d):
    return displacement.filter_pairs(T.displacements(spark, d)).select("pair_id", "pt_idx", "x", "y", *r6("u", "v"))


def _gauss(sigma: float = 1.0) -> str:
    from ..functions.arrays import gaussian_weights

    w = gaussian_weights(sigma)
    return ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w))


ANGLE = f""", n AS (SELECT *, count(*) OVER (PARTITION BY pair_id) n, coalesce(u/nullif(sqrt(u*u+v*v),0),0) c, coalesce(v/nullif(sqrt(u*u+v*v),0),0) s FROM disp),
g(k, w) AS (VALUES {_gauss()}),
e AS (SELECT pair_id, pt_idx, w, CASE WHEN m < n THEN m ELSE 2*n-1-m END j FROM (SELECT pair_id, pt_idx, n, w, ((pt_idx+k) % (2*n) + 2*n) % (2*n) m FROM n, g)),
a AS (SELECT e.pair_id, e.pt_idx, sum(w*c) c, sum(w*s) s FROM e JOIN n ON n.pair_id=e.pair_id AND n.pt_idx=e.j GROUP BY 1, 2)
SELECT n.pair_id, n.pt_idx, n.x, n.y, {R('u', 'v')} FROM n JOIN a USING (pair_id, pt_idx)
WHERE degrees(abs(atan2(sin(atan2(v,u)-atan2(a.s,a.c)), cos(atan2(v,u)-atan2(a.s,a.c))))) <= 41.7"""


@query(ANGLE, "disp")
def pair_angular_coherence(spark, d):
    return _kept(displacement.by_angle(displacement.begin(T.displacements(spark, d)), 41.7))


RUNNING = ", n AS (SELECT *, count(*) OVER (PARTITION BY pair_id) n FROM disp), e AS (SELECT pair_id, pt_idx, least(greatest(pt_idx+k,0),n-1) j FROM n, (SELECT range-2 k FROM range(5))), m AS (SELECT e.pair_id, e.pt_idx, median(u) mu, median(v) mv FROM e JOIN n ON n.pair_id=e.pair_id AND n.pt_idx=e.j GROUP BY 1,2)"


@query(RUNNING + f" SELECT n.pair_id, n.pt_idx, n.x, n.y, {R('u', 'v')} FROM n JOIN m USING (pair_id, pt_idx) WHERE abs(sqrt(u*u+v*v)-sqrt(mu*mu+mv*mv)) < 2.03", "disp")
def pair_erratic(spark, d):
    return _kept(displacement.by_neighbours(displacement.begin(T.displacements(spark, d)), 2.03))


@query(RUNNING + " SELECT n.pair_id, n.pt_idx, n.x, n.y, round(mu,6) u, round(mv,6) v FROM n JOIN m USING (pair_id, pt_idx)", "disp")
def pair_median_smooth(spark, d):
    return _kept(displacement.median_smoothed(displacement.begin(T.displacements(spark, d))))


# --- the field -------------------------------------------------------------------------------------


@query(DEFAULT + f", f AS (SELECT x, y, median((u-mu)/years)*10 u, median((v-mv)/years)*10 v FROM t JOIN years USING (pair_id) WHERE ok AND pkr>=1.3 AND snr>=3 GROUP BY 1, 2) SELECT x, y, {R('u', 'v')}, round({MAG},6) mag FROM f", "disp", "years")
def median_velocity_field(spark, d):
    return displacement.median_field(displacement.filter_pairs(T.displacements(spark, d)), T.pair_years(spark, d)).select("x", "y", *r6("u", "v", "mag"))


@query(f"SELECT x, y, {R('u', 'v', 'mag', 'ang')} FROM rated", "rated")
def median_displacement_field(spark, d):
    return _field(spark, d).select("x", "y", *r6("u", "v", "mag", "ang"))


def _field(spark, d):
    return displacement.median_field(T.displacements(spark, d), None)


@query(", k AS (SELECT y, x, greatest(cos(radians(slope)),1e-3::DOUBLE) k FROM terrain) SELECT f.x, f.y, round(u/k,6) u, round(v/k,6) v FROM field f JOIN k USING (x, y)", "field", "terrain")
def slope_corrected_field(spark, d):
    return displacement.median_field(T.displacements(spark, d), None, slope=T.terrain(spark, d)).select("x", "y", *r6("u", "v"))


@query(f"SELECT x, y, {R('mag')} FROM rated WHERE mag > (SELECT quantile_cont(mag, 0.95) FROM rated)", "rated")
def field_p95_threshold(spark, d):
    return field.above(_field(spark, d)).select("x", "y", *r6("mag"))


COHERENT = f""", o AS (SELECT *, row_number() OVER (ORDER BY ord)-1 i, count(*) OVER () n FROM rated), g(k, w) AS (VALUES {_gauss()}),
e AS (SELECT i, w, CASE WHEN m < n THEN m ELSE 2*n-1-m END j FROM (SELECT i, n, w, ((i+k) % (2*n) + 2*n) % (2*n) m FROM o, g)),
a AS (SELECT e.i, sum(w*cos(ang)) c, sum(w*sin(ang)) s FROM e JOIN o ON o.i = e.j GROUP BY 1)
SELECT x, y, {R('mag')} FROM o JOIN a USING (i) WHERE degrees(abs(atan2(sin(ang-atan2(s,c)), cos(ang-atan2(s,c))))) <= 41.7"""


@query(COHERENT, "rated")
def field_angular_coherence(spark, d):
    return field.coherent(_field(spark, d), 41.7).select("x", "y", *r6("mag"))


@query(f"SELECT f.x, f.y, {R('mag')} FROM rated f JOIN terrain t USING (x, y) WHERE slope >= 20", "rated", "terrain")
def field_slope(spark, d):
    return field.steep(_field(spark, d), T.terrain(spark, d), 20).select("x", "y", *r6("mag"))


ASPECT = ", t AS (SELECT f.x, f.y, mag, ((-aspect-270) % 360 + 360) % 360 a, (degrees(atan2(-v,u)) % 360 + 360) % 360 b FROM rated f JOIN terrain USING (x, y))"


@query(ASPECT + f" SELECT x, y, {R('mag')} FROM t WHERE least(((a-b) % 360 + 360) % 360, 360-((a-b) % 360 + 360) % 360) <= 44.7", "rated", "terrain")
def field_aspect(spark, d):
    return field.downhill(_field(spark, d), T.terrain(spark, d), 44.7).select("x", "y", *r6("mag"))


DENSE = ", p AS (SELECT x, y, mag FROM rated WHERE mag > 12.5), core AS (SELECT a.x, a.y FROM p a JOIN p b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 9 GROUP BY 1, 2 HAVING count(*) >= 5)"


@query(DENSE + f" SELECT x, y, {R('mag')} FROM p WHERE EXISTS (SELECT 1 FROM core c WHERE (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) <= 9)", "rated")
def field_density_cluster(spark, d):
    return field.dense(field.above(_field(spark, d), 12.5), 3, 5).select("x", "y", *r6("mag"))


FINAL = f""", a1 AS (SELECT * FROM rated WHERE mag > 5), o AS (SELECT *, row_number() OVER (ORDER BY ord)-1 i, count(*) OVER () n FROM a1), g(k, w) AS (VALUES {_gauss()}),
e AS (SELECT i, w, CASE WHEN m < n THEN m ELSE 2*n-1-m END j FROM (SELECT i, n, w, ((i+k) % (2*n) + 2*n) % (2*n) m FROM o, g)),
a AS (SELECT e.i, sum(w*cos(ang)) c, sum(w*sin(ang)) s FROM e JOIN o ON o.i = e.j GROUP BY 1),
a2 AS (SELECT x, y, u, v, mag FROM o JOIN a USING (i) WHERE degrees(abs(atan2(sin(ang-atan2(s,c)), cos(ang-atan2(s,c))))) <= 30),
a3 AS (SELECT a2.*, ((-aspect-270) % 360 + 360) % 360 f, (degrees(atan2(-v,u)) % 360 + 360) % 360 m FROM a2 JOIN terrain USING (x, y) WHERE slope >= 5),
a4 AS (SELECT x, y, u, v, mag FROM a3 WHERE least(((f-m) % 360 + 360) % 360, 360-((f-m) % 360 + 360) % 360) <= 90),
core AS (SELECT p.x, p.y FROM a4 p JOIN a4 q ON (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y) <= 400 GROUP BY 1, 2 HAVING count(*) >= 9)
SELECT x, y, {R('u', 'v', 'mag')} FROM a4 p WHERE EXISTS (SELECT 1 FROM core c WHERE (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) <= 400)"""


@query(FINAL, "rated", "terrain")
def field_final_map(spark, d):
    return field.final_map(_field(spark, d), T.terrain(spark, d), threshold=5, tolerance=90, eps=20, least=9).select("x", "y", *r6("u", "v", "mag"))


# --- rasters ---------------------------------------------------------------------------------------

STEP, GH, GW = raster.stride(BLOCK, OVERLAP), (SHAPE[0] - BLOCK) // 4 + 1, (SHAPE[1] - BLOCK) // 4 + 1
CELLS = f", c AS (SELECT a.range::INT gy, b.range::INT gx FROM range({GH}) a, range({GW}) b), p AS (SELECT *, floor((y-4.0)/4)::INT gy, floor((x-4.0)/4)::INT gx FROM rated)"


@query(CELLS + " SELECT c.gy, c.gx, round(coalesce(sum(mag),0),6) mag FROM c LEFT JOIN p USING (gy, gx) GROUP BY 1, 2", "rated")
def magnitude_map_sum(spark, d):
    return raster.magnitude_sum(_field(spark, d), SHAPE, BLOCK, OVERLAP).select("gy", "gx", *r6("mag"))


@query(CELLS + ", l AS (SELECT gy, gx, arg_max(u, ord) u, arg_max(v, ord) v FROM p GROUP BY 1, 2) SELECT c.gy, c.gx, round(coalesce(u,0),6) u, round(coalesce(v,0),6) v, round(coalesce(sqrt(u*u+v*v),0),6) mag, round(coalesce((degrees(atan2(v,u)) % 360 + 360) % 360, 0),6) ang_deg FROM c LEFT JOIN l USING (gy, gx)", "rated")
def raster_maps(spark, d):
    return raster.velocity_grids(_field(spark, d), SHAPE, BLOCK, OVERLAP).select("gy", "gx", *r6("u", "v", "mag", "ang_deg"))


@query(", g AS (SELECT *, lag(dem) OVER a pa, lead(dem) OVER a na, lag(dem) OVER b pb, lead(dem) OVER b nb FROM terrain WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)), h AS (SELECT y, x, coalesce((na-pa)/20, (na-dem)/10, (dem-pa)/10, 0) gx, coalesce((nb-pb)/20, (nb-dem)/10, (dem-pb)/10, 0) gy FROM g) SELECT y, x, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) slope_deg FROM h", "terrain")
def terrain_slope(spark, d):
    return raster.slope(T.terrain(spark, d)).select("y", "x", *r6("slope_deg"))


def _bilinear_sql(columns: str) -> str:
    """Onto one and a half times the raster's rows and columns."""
    return f", z AS (SELECT max(y)+1 h, max(x)+1 w FROM terrain), o AS (SELECT a.y::INT y, b.x::INT x, h, w, a.y*((h-1)/(h*3//2-1.0::DOUBLE)) fy, b.x*((w-1)/(w*3//2-1.0::DOUBLE)) fx FROM z, (SELECT unnest(range(h*3//2)) y FROM z) a, (SELECT unnest(range(w*3//2)) x FROM z) b), f AS (SELECT y, x, least(floor(fy)::INT+i.range,h-1)::INT sy, least(floor(fx)::INT+j.range,w-1)::INT sx, (1-abs(fy-floor(fy)-i.range))*(1-abs(fx-floor(fx)-j.range)) w FROM o, range(2) i, range(2) j) SELECT f.y, f.x, {columns} FROM f JOIN terrain t ON t.y=sy AND t.x=sx GROUP BY 1, 2"


def _larger(spark, d):
    h, w = shape = raster.shape_of(T.terrain(spark, d))
    return shape, (h * 3 // 2, w * 3 // 2)


@query(_bilinear_sql("round(sum(w*dem),6) dem"), "terrain")
def terrain_bilinear(spark, d):
    return raster.bilinear(T.terrain(spark, d), "dem", *_larger(spark, d)).select("y", "x", *r6("dem"))


@query(_bilinear_sql("round(sum(w*dem),6) dem, round(sum(w*slope),6) slope, round(sum(w*aspect),6) aspect"), "terrain")
def terrain_resampled(spark, d):
    return raster.resampled_terrain(T.terrain(spark, d), *_larger(spark, d)).select("y", "x", *r6("dem", "slope", "aspect"))


@query(", g AS (SELECT *, lag(dem) OVER a pa, lead(dem) OVER a na, lag(dem) OVER b pb, lead(dem) OVER b nb FROM terrain WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)), h AS (SELECT y, x, coalesce((na-pa)/20, (na-dem)/10, (dem-pa)/10, 0) gx, coalesce((nb-pb)/20, (nb-dem)/10, (dem-pb)/10, 0) gy FROM g) SELECT y, x, round((degrees(atan2(-gx, gy)) + 360) % 360,6) aspect_deg FROM h", "terrain")
def terrain_aspect(spark, d):
    return raster.aspect(T.terrain(spark, d)).select("y", "x", *r6("aspect_deg"))


def _mask(spark, d):
    return T.terrain(spark, d).select(F.col("y").alias("gy"), F.col("x").alias("gx"), (F.col("slope") > 22).alias("on"))


MASK = ", m AS (SELECT y gy, x gx, slope > 22 AS \"on\" FROM terrain)"
NEAR = "SELECT a.gy, a.gx, sum(b.\"on\"::INT) ons, count(*) cells FROM {0} a JOIN {0} b ON abs(a.gy-b.gy) <= 1 AND abs(a.gx-b.gx) <= 1 GROUP BY 1, 2"


@query(MASK + f", n AS ({NEAR.format('m')}) SELECT gy, gx, ons > 0 AS \"on\" FROM n", "terrain")
def mask_dilate(spark, d):
    return raster.dilated(_mask(spark, d))


@query(MASK + f", n AS ({NEAR.format('m')}), k AS (SELECT gy, gx, ons > 0 AS \"on\" FROM n), e AS ({NEAR.format('k')}) SELECT gy, gx, ons = cells AS \"on\" FROM e", "terrain")
def mask_close(spark, d):
    return raster.closed(_mask(spark, d))


@query(MASK + f", n AS ({NEAR.format('m')}) SELECT gy, gx, ons >= 5 AS \"on\" FROM n", "terrain")
def mask_majority(spark, d):
    return raster.majority(_mask(spark, d))


def _filled_sql(name: str, out: str) -> str:
    """Holes of a mask: cells that are off and not to be reached from outside, side by side."""
    sides = "(VALUES (-1,0),(1,0),(0,-1),(0,1)) d(i, j)"
    return f", {out}_z AS (SELECT min(gy)-1 y0, max(gy)+1 y1, min(gx)-1 x0, max(gx)+1 x1 FROM {name}), {out}_o AS (SELECT y gy, x gx FROM (SELECT unnest(range(y0, y1+1)) y FROM {out}_z), (SELECT unnest(range(x0, x1+1)) x FROM {out}_z) WHERE (y, x) NOT IN (SELECT (gy, gx) FROM {name})  OR (y, x) IN (SELECT (gy, gx) FROM {name} WHERE NOT \"on\")), {out}_f(gy, gx) AS (SELECT y0, x0 FROM {out}_z UNION SELECT o.gy, o.gx FROM {out}_f f, {sides} JOIN {out}_o o ON o.gy = f.gy + d.i AND o.gx = f.gx + d.j), {out} AS (SELECT m.gy, m.gx, f.gy IS NULL AS \"on\" FROM {name} m LEFT JOIN {out}_f f ON f.gy = m.gy AND f.gx = m.gx)"


@query(MASK.replace(", m AS", "WITH RECURSIVE terrain AS (" + VIEWS["terrain"] + "), m AS") + _filled_sql("m", "k") + " SELECT gy, gx, \"on\" FROM k")
def mask_fill(spark, d):
    return raster.without_holes(_mask(spark, d))


def _thin_sql(name: str, out: str) -> str:
    def half(name: str, out: str, second: bool) -> str:
        around = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
        xs = ", ".join(f"coalesce(bool_or(b.\"on\" AND b.gy-a.gy={i} AND b.gx-a.gx={j}), false) x{k}" for k, (i, j) in enumerate(around))
        runs = "+".join(f"(NOT x{2 * k} AND (x{2 * k + 1} OR x{(2 * k + 2) % 8}))::INT" for k in range(4))
        before, after = ("+".join(f"(x{2 * k + p} OR x{(2 * k + q) % 8})::INT" for k in range(4)) for p, q in ((0, 1), (1, 2)))
        free = "NOT ((x5 OR x6 OR NOT x3) AND x4)" if second else "NOT ((x1 OR x2 OR NOT x7) AND x0)"
        return f", {out}_n AS (SELECT a.gy, a.gx, any_value(a.\"on\") \"on\", {xs} FROM {name} a JOIN {name} b ON abs(a.gy-b.gy) <= 1 AND abs(a.gx-b.gx) <= 1 GROUP BY 1, 2), {out} AS (SELECT gy, gx, \"on\" AND NOT ({runs} = 1 AND least({before}, {after}) BETWEEN 2 AND 3 AND {free}) AS \"on\" FROM {out}_n)"

    return half(name, f"{out}1", False) + half(f"{out}1", out, True)


@query(MASK + _thin_sql("m", "k") + " SELECT gy, gx, \"on\" FROM k", "terrain")
def mask_thin(spark, d):
    return raster.thinned(_mask(spark, d))


def _processed_sql() -> str:
    out, name = "", "m"
    for k in (1, 2):
        out += f", p{k}a AS ({NEAR.format(name)}), p{k}b AS (SELECT gy, gx, ons > 0 AS \"on\" FROM p{k}a), p{k}c AS ({NEAR.format(f'p{k}b')}), p{k}d AS (SELECT gy, gx, ons = cells AS \"on\" FROM p{k}c)"
        out += f", p{k} AS (SELECT a.gy, a.gx, bool_or(b.\"on\") AS \"on\" FROM p{k}d a JOIN p{k}d b ON abs(a.gy-b.gy)+abs(a.gx-b.gx) <= 1 GROUP BY 1, 2)"
        name = f"p{k}"
    out += f", p3a AS ({NEAR.format(name)}), p3 AS (SELECT gy, gx, ons >= 5 AS \"on\" FROM p3a)"
    return out + _filled_sql("p3", "p4") + _thin_sql("p4", "p5") + " SELECT gy, gx, \"on\" FROM p5"


@query(MASK.replace(", m AS", "WITH RECURSIVE terrain AS (" + VIEWS["terrain"] + "), m AS") + _processed_sql())
def mask_process(spark, d):
    return raster.processed_mask(_mask(spark, d))


@query(", z AS (SELECT max(y)+1 h, max(x)+1 w FROM terrain), o AS (SELECT a.y::INT y, b.x::INT x, least(floor((a.y+0.5)*h/(2*h)),h-1)::INT gy, least(floor((b.x+0.5)*w/(2*w)),w-1)::INT gx FROM z, (SELECT unnest(range(2*h)) y FROM z) a, (SELECT unnest(range(2*w)) x FROM z) b) SELECT o.y, o.x, slope FROM o JOIN terrain t ON t.y=gy AND t.x=gx", "terrain")
def mask_nearest_upsample(spark, d):
    h, w = shape = raster.shape_of(T.terrain(spark, d))
    return raster.upsampled(T.terrain(spark, d).select(F.col("y").alias("gy"), F.col("x").alias("gx"), "slope"), "slope", shape, (2 * h, 2 * w))


MAGS = ", a AS (SELECT y, x, dem, slope > 22 AS \"on\" FROM terrain)"


@query(MAGS + " SELECT y gy, x gx, CASE WHEN \"on\" THEN dem END dem FROM a", "terrain")
def mask_crop(spark, d):
    t = T.terrain(spark, d).select(F.col("y").alias("gy"), F.col("x").alias("gx"), "dem")
    return raster.cropped(t, _mask(spark, d), "dem")


def _stack(spark, d):
    return T.table(spark, d, "embeddings").select(F.col("vec_id").alias("scene"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v")).select("scene", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), "v")


STACK = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1)-1 p FROM embeddings), s AS (SELECT vec_id scene, (p//8)::INT y, (p % 8)::INT x, v FROM e), w AS (SELECT *, min(v) OVER q lo, max(v) OVER q hi FROM s WINDOW q AS (PARTITION BY scene))"


@query(STACK + " SELECT scene, y, x, floor((v-lo)/(hi-lo)*255)::BIGINT v FROM w")
def scale_to_8bit(spark, d):
    return raster.scaled_8bit(_stack(spark, d))


@query(STACK + " SELECT y, x, bool_or(floor((v-lo)/(hi-lo)*255) = 0) invalid FROM w GROUP BY 1, 2")
def zero_mask(spark, d):
    return raster.zero_mask(raster.scaled_8bit(_stack(spark, d)))


@query(STACK + ", z AS (SELECT scene, y, x, (v-lo)/(hi-lo) v FROM w) SELECT scene, y, x, round((v - avg(v) OVER q)/stddev_pop(v) OVER q, 6) v FROM z WINDOW q AS (PARTITION BY scene)")
def zscore(spark, d):
    return raster.standardised(_stack(spark, d)).select("scene", "y", "x", *r6("v"))


EIGHT = STACK + ", b AS (SELECT scene, y, x, floor((v-lo)/(hi-lo)*255) v FROM w)"


def _orientation_sql(name: str) -> str:
    """Ridges along four directions, mirrored at the edges, kept within 8 bits."""
    at = lambda c, k: f"(CASE WHEN {c}+{k} < 0 THEN -({c}+{k}) WHEN {c}+{k} > 7 THEN 14-({c}+{k}) ELSE {c}+{k} END)"
    v = lambda dy, dx: f"e[{at('y', dy)}*8+{at('x', dx)}+1]"
    ridge = lambda dy, dx: f"least(greatest(2*{v(0, 0)}-{v(-dy, -dx)}-{v(dy, dx)},0),255)"
    return f", l AS (SELECT scene, list(v ORDER BY y*8+x) e FROM {name} GROUP BY 1), n AS (SELECT scene, (k.range//8)::INT y, (k.range%8)::INT x, e FROM l, range(64) k), o AS (SELECT scene, y, x, atan2({ridge(0, 1)},{ridge(1, 0)}) f, atan2({ridge(1, 1)},{ridge(1, -1)}) g FROM n), r AS (SELECT scene, y, x, cos(f)+sin(f)+cos(g)+sin(g) v FROM o)"


@query(EIGHT + _orientation_sql("b") + " SELECT scene, y, x, round(v,6) v FROM r")
def naof(spark, d):
    return raster.orientation(raster.scaled_8bit(_stack(spark, d)), SIZE, SIZE, whole=True).select("scene", "y", "x", *r6("v"))


@query(EIGHT + ", t AS (SELECT *, max(v) OVER (PARTITION BY scene) hi FROM b) SELECT scene, y, x, round(least(255, round(abs(v*255/nullif(hi,0)))),6) v FROM t")
def preprocess_flow(spark, d):
    return raster.preprocessed(raster.scaled_8bit(_stack(spark, d)), "optical_flow", SIZE, SIZE).select("scene", "y", "x", *r6("v"))


@query(EIGHT + ", k AS (SELECT scene, avg(v) m FROM b GROUP BY 1) SELECT scene, y, x, round(v-m,6) v FROM b JOIN k USING (scene)")
def preprocess_custom(spark, d):
    return raster.preprocessed(raster.scaled_8bit(_stack(spark, d)), None, SIZE, SIZE, lambda image: image - image.mean()).select("scene", "y", "x", *r6("v"))


@query(EIGHT + ", z AS (SELECT y, x FROM b GROUP BY 1, 2 HAVING bool_or(v < 4)) SELECT scene, y, x, CASE WHEN z.y IS NULL THEN v END v FROM b LEFT JOIN z USING (y, x)")
def masked_stack(spark, d):
    s = raster.scaled_8bit(_stack(spark, d)).withColumn("v", F.col("v").cast("double"))
    low = s.groupBy("y", "x").agg(F.bool_or(F.col("v") < 4).alias("invalid"))
    return raster.masked(s, low)


# --- series ----------------------------------------------------------------------------------------


@query(", p AS (SELECT DISTINCT x, y FROM disp WHERE pkr >= 1.9) SELECT pair_id, pt_idx, x, y, round(-u*10,6) u_values, round(-v*10,6) v_values, round(u*10/years,6) u_velocity, round(v*10/years,6) v_velocity FROM disp JOIN years USING (pair_id) WHERE (x, y) IN (SELECT (x, y) FROM p) AND years > 0", "disp", "years")
def interval_velocity(spark, d):
    disp = T.displacements(spark, d)
    points = disp.where("pkr >= 1.9").select("x", "y").distinct()
    return velocity.interval_table(disp, T.pair_years(spark, d), points).select("pair_id", "pt_idx", "x", "y", *r6("u_values", "v_values", "u_velocity", "v_velocity"))


@query(", p AS (SELECT DISTINCT x, y FROM disp WHERE pkr >= 1.9), f AS (SELECT pair_id, x, y, arg_max(u, pt_idx) u, arg_max(v, pt_idx) v FROM disp GROUP BY 1, 2, 3) SELECT k.pair_id, p.x, p.y, round(-u*10,6) u_values, round(-v*10,6) v_values, round(u*10/k.years,6) u_velocity, round(v*10/k.years,6) v_velocity, CASE WHEN u IS NOT NULL OR v IS NOT NULL THEN k.years END AS years FROM p CROSS JOIN years k LEFT JOIN f ON f.pair_id=k.pair_id AND f.x=p.x AND f.y=p.y", "disp", "years")
def interval_placeholders(spark, d):
    disp = T.displacements(spark, d)
    points = disp.where("pkr >= 1.9").select("x", "y").distinct()
    return velocity.interval_grid(disp, T.pair_years(spark, d), points).select("pair_id", "x", "y", *r6("u_values", "v_values", "u_velocity", "v_velocity"), "years")


MID = ", m AS (SELECT point, make_timestamp(((epoch(d1)+epoch(d2))/2*1000000)::BIGINT) \"at\", v FROM long_intervals WHERE snr >= 3 AND pkr >= 1.3)"


def _bins(name: str, months: int) -> str:
    return f", b0 AS (SELECT point, year(\"at\")*12+month(\"at\")-1 m, v FROM {name}), b1 AS (SELECT *, min(m) OVER (PARTITION BY point) m0 FROM b0), b2 AS (SELECT point, m0, ceil((m-m0)/{months})::INT k, median(v) velocity FROM b1 GROUP BY 1, 2, 3), b3 AS (SELECT point, m0, unnest(range(max(k)+1))::INT k FROM b2 GROUP BY 1, 2), bins AS (SELECT point, last_day(make_date(((m0+k*{months})//12)::INT, ((m0+k*{months})%12+1)::INT, 1)) date, velocity FROM b3 LEFT JOIN b2 USING (point, m0, k))"


@query(MID + " SELECT point, strftime(\"at\",'%Y-%m-%d %H') \"at\", round(v,6) v FROM m", "long_intervals")
def midpoint_series(spark, d):
    return velocity.midpoints(T.long_intervals(spark, d), 3, 1.3).select("point", F.date_format("at", "yyyy-MM-dd HH").alias("at"), *r6("v"))


@query(MID + _bins("m", 6) + " SELECT point, date::VARCHAR date, round(velocity,6) velocity FROM bins", "long_intervals")
def midpoint_bins(spark, d):
    return velocity.binned(velocity.midpoints(T.long_intervals(spark, d), 3, 1.3), "at", 6).select("point", F.col("date").cast("string"), *r6("velocity"))


DAILY = ", x AS (SELECT point, unnest(generate_series(d1, d2, INTERVAL 1 DAY))::DATE \"at\", v FROM intervals WHERE d2 > d1 AND snr >= 3 AND pkr >= 1.3 AND v IS NOT NULL), daily AS (SELECT point, \"at\", median(v) v FROM x GROUP BY 1, 2)"


@query(DAILY + " SELECT point, \"at\"::VARCHAR \"at\", round(v,6) v FROM daily", "intervals")
def daily_series(spark, d):
    return velocity.daily(T.intervals(spark, d), 3, 1.3).select("point", F.col("at").cast("string"), *r6("v"))


@query(DAILY + _bins("daily", 4) + " SELECT point, date::VARCHAR date, round(velocity,6) velocity FROM bins", "intervals")
def weighted_bins(spark, d):
    return velocity.binned(velocity.daily(T.intervals(spark, d), 3, 1.3), "at", 4).select("point", F.col("date").cast("string"), *r6("velocity"))


@query(None)
def lsqr_series(spark, d):
    return velocity.binned(velocity.least_squares(T.intervals(spark, d), weight="snr"), "at", 6).select("point", F.col("date").cast("string"), *r6("velocity"))


def _merged(spark, d):
    return velocity.velocity_series(T.long_intervals(spark, d), "midpoint", 6)


def _both(select: str) -> str:
    u, v = (f"(SELECT point, make_timestamp(((epoch(d1)+epoch(d2))/2*1000000)::BIGINT) \"at\", {c} v FROM long_intervals WHERE snr >= 3 AND pkr >= 1.3)" for c in "uv")
    rename = lambda s, p: s.replace("b0", f"{p}0").replace("b1", f"{p}1").replace("b2", f"{p}2").replace("b3", f"{p}3").replace("bins", f"{p}bins")
    return rename(_bins(u, 6), "u") + rename(_bins(v, 6), "v") + ", both_ AS (SELECT point, date, a.velocity u_velocity, b.velocity v_velocity, 'D'||strftime(date,'%Y%m%d') formatted_date FROM ubins a FULL JOIN vbins b USING (point, date))" + select


@query(_both(f" SELECT point, date::VARCHAR date, {R('u_velocity', 'v_velocity')}, formatted_date FROM both_"), "long_intervals")
def merge_components(spark, d):
    return _merged(spark, d).select("point", F.col("date").cast("string"), *r6("u_velocity", "v_velocity"), "formatted_date")


#: Every month end of the tables' years: a column for each.
MONTH_ENDS = [f"{y}{m:02d}{calendar.monthrange(y, m)[1]}" for y in range(1992, 1999) for m in range(1, 13)]
#: Where the points lie: a grid 50 wide, by an affine onto UTM zone 32.
AFFINE, ZONE = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), 32


def _cubic_sql(name: str, value: str) -> str:
    """rmse of each point's cubic: each power made orthogonal to the lower ones, and taken from the values."""
    w = "(PARTITION BY point)"
    part = lambda a, b: f"coalesce(sum({a}*{b}) OVER {w}/nullif(sum({b}*{b}) OVER {w},0),0)*{b}"
    out = f", c0 AS (SELECT point, date, {value} e, row_number() OVER (PARTITION BY point ORDER BY date) i FROM {name}), c1 AS (SELECT point, e - avg(e) OVER {w} e, count(*) OVER {w} n, (i - min(i) OVER {w})/nullif(max(i) OVER {w} - min(i) OVER {w}, 0)::DOUBLE t, 1.0::DOUBLE p0 FROM c0 WHERE e IS NOT NULL)"
    last = "c1"
    for k in (1, 2, 3):
        out += f", d{k}s AS (SELECT *, t**{k} p{k} FROM {last})"
        last = f"d{k}s"
        for j in range(k):
            out += f", d{k}{j} AS (SELECT * REPLACE (p{k} - {part(f'p{k}', f'p{j}')} AS p{k}) FROM {last})"
            last = f"d{k}{j}"
        out += f", d{k}e AS (SELECT * REPLACE (e - {part('e', f'p{k}')} AS e) FROM {last})"
        last = f"d{k}e"
    return out + f", cubic AS (SELECT point, CASE WHEN max(n) > 4 THEN sqrt(avg(e*e)) WHEN max(n) > 1 THEN 0.0 END rmse FROM {last} GROUP BY 1)"


def _place_sql() -> str:
    """lon and lat of the points: the series of functions.geo, with its constants worked out."""
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius = geo.SCALE * geo.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    d = lambda v: f"{v!r}::DOUBLE"
    xs = "".join(f" - {d(b)}*sin({2 * k}*xi)*cosh({2 * k}*eta)" for k, b in enumerate(beta, 1))
    ys = "".join(f" - {d(b)}*cos({2 * k}*xi)*sinh({2 * k}*eta)" for k, b in enumerate(beta, 1))
    lat = "".join(f" + {d(b)}*sin({2 * k}*chi)" for k, b in enumerate(delta, 1))
    return f", g0 AS (SELECT DISTINCT point, (point % 50)::INT x, (point // 50)::INT y FROM both_), g1 AS (SELECT *, (4600000 - 10*(y+0.5::DOUBLE))/{d(radius)} xi, 10*(x+0.5::DOUBLE)/{d(radius)} eta FROM g0), g2 AS (SELECT *, xi{xs} gx, eta{ys} gy FROM g1), g3 AS (SELECT *, asin(sin(gx)/cosh(gy)) chi FROM g2), place AS (SELECT point, x, y, round(degrees(atan2(sinh(gy), cos(gx))) + {6 * ZONE - 183}, 6) longitude, round(degrees(chi{lat}), 6) latitude FROM g3)"


def _places(series):
    p = series.select("point").distinct().select("point", (F.col("point") % 50).cast("int").alias("x"), F.floor(F.col("point") / 50).cast("int").alias("y"))
    lon, lat = geo.utm_lon_lat(*files.to_ground(F.col("x"), F.col("y"), AFFINE), ZONE)
    return p.withColumns({"longitude": lon, "latitude": lat})


def _wide(name: str, component: str, native):
    cols = ", ".join(f"round_even(round(max(CASE WHEN formatted_date='D{x}' THEN {component} END),9),1) D{x}" for x in MONTH_ENDS)

    def f(spark, d):
        s = _merged(spark, d)
        return velocity.wide(s, native(), MONTH_ENDS, _places(s)).select("point", "pid", "x", "y", "longitude", "latitude", *r6("median_velocity", "rmse", *[f"D{x}" for x in MONTH_ENDS]))

    f.__name__ = name
    query(_both(_cubic_sql("both_", component) + _place_sql() + f", wide AS (SELECT point, round_even(round(median({component}),9),1) median_velocity, {cols} FROM both_ GROUP BY 1) SELECT point, 'OT'||upper(substr(sha256(point::VARCHAR),1,8)) pid, x, y, longitude, latitude, median_velocity, round_even(round(rmse,9),2) rmse, wide.* EXCLUDE (point, median_velocity) FROM wide JOIN place USING (point) LEFT JOIN cubic USING (point)"), "long_intervals")(f)


_wide("export_wide_we", "u_velocity", lambda: F.col("u_velocity"))
_wide("export_wide_ns", "v_velocity", lambda: F.col("v_velocity"))
_wide("export_wide_mag", "sqrt(u_velocity*u_velocity+v_velocity*v_velocity)", velocity.magnitude)


@query(_both(" SELECT 'OT'||upper(substr(sha256(point::VARCHAR),1,8)) pid, round(avg(sqrt(u_velocity*u_velocity+v_velocity*v_velocity)),6) speed FROM both_ GROUP BY 1"), "long_intervals")
def mean_speed(spark, d):
    s = _merged(spark, d).withColumn("pid", velocity.point_id(F.col("point")))
    one = lambda c: s.select("pid", "date", F.col(c).alias("velocity"))
    return velocity.mean_speed(one("u_velocity"), one("v_velocity")).select("pid", *r6("speed"))


@query(_both(_cubic_sql("both_", "u_velocity") + " SELECT point, round(rmse,6) rmse FROM (SELECT DISTINCT point FROM both_) LEFT JOIN cubic USING (point)"), "long_intervals")
def rmse_poly3(spark, d):
    return velocity.cubic_rmse(_merged(spark, d), "u_velocity").select("point", *r6("rmse"))


@query(_both(" SELECT point, round(median(u_velocity),6) median_velocity FROM both_ GROUP BY 1 ORDER BY median_velocity DESC, point LIMIT 10"), "long_intervals")
def top_fastest(spark, d):
    return velocity.fastest(_merged(spark, d).groupBy("point").agg(F.round(F.median("u_velocity"), 6).alias("median_velocity")))


@query(_both(f", p AS (SELECT DISTINCT point, (point//40)::INT gy, (point%40)::INT gx FROM both_), dd AS (SELECT date, row_number() OVER (ORDER BY date)::INT band FROM (SELECT DISTINCT date FROM both_)), c AS (SELECT DISTINCT gy, gx FROM p), m AS (SELECT date, gy, gx, max(sqrt(u_velocity*u_velocity+v_velocity*v_velocity)) mag FROM both_ JOIN p USING (point) GROUP BY 1,2,3) SELECT band, date::VARCHAR date, gy, gx, round(coalesce(mag,-9999),6) mag FROM c CROSS JOIN dd LEFT JOIN m USING (date, gy, gx)").replace(") , p AS", "), p AS"), "long_intervals")
def multiband_magnitude(spark, d):
    s = _merged(spark, d)
    p = s.select("point").distinct().select("point", F.floor(F.col("point") / 40).cast("int").alias("gy"), (F.col("point") % 40).cast("int").alias("gx"))
    return velocity.multiband(s, p).select(F.col("band").cast("int"), F.col("date").cast("string"), "gy", "gx", *r6("mag"))


@query(_both(", dd AS (SELECT date, row_number() OVER (ORDER BY date) band FROM (SELECT DISTINCT date FROM both_)) SELECT round(max(sqrt(u_velocity*u_velocity+v_velocity*v_velocity)),6) mag FROM both_ JOIN dd USING (date) WHERE band >= 2 AND sqrt(u_velocity*u_velocity+v_velocity*v_velocity) <> 0"), "long_intervals")
def multiband_largest(spark, d):
    s = _merged(spark, d)
    p = s.select("point").distinct().select("point", F.floor(F.col("point") / 40).cast("int").alias("gy"), (F.col("point") % 40).cast("int").alias("gx"))
    return velocity.largest(velocity.multiband(s, p)).select(*r6("mag"))


@query(", a AS (SELECT x, y FROM rated WHERE mag > 5), b AS (SELECT x, y FROM terrain WHERE slope > 22) SELECT x, y FROM a INTERSECT SELECT x, y FROM b", "rated", "terrain")
def points_intersection(spark, d):
    return field.within(field.above(_field(spark, d), 5), T.terrain(spark, d).where("slope > 22"))


# --- failure ---------------------------------------------------------------------------------------

INVERSE = ", i AS (SELECT pid, date_trunc('month', date)::DATE AS month, median(1/nullif(velocity,0)) inverse FROM monthly GROUP BY 1, 2)"
FAIL = INVERSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY month DESC) r, count(*) OVER (PARTITION BY pid) AS months FROM i), n AS (SELECT pid, month, inverse, n FROM r, (SELECT unnest([3,4,5,6,7])::INT n) WHERE months >= n AND r <= n AND inverse IS NOT NULL), t AS (SELECT *, min(month) OVER (PARTITION BY pid, n) t0 FROM n), f AS (SELECT pid, n, t0, count(*) c, regr_slope(inverse, date_diff('day', t0, month)) m, regr_intercept(inverse, date_diff('day', t0, month)) b FROM t GROUP BY 1,2,3), z AS (SELECT pid, n, to_timestamp(epoch(t0) + floor(-b/m*86400)) failure_date FROM f WHERE c >= 2 AND m < 0 AND -b/m > 0 AND -b/m <= date_diff('day', t0, DATE '2100-01-01'))"


@query(INVERSE + " SELECT pid, month::VARCHAR AS month, round(inverse,6) inverse FROM i", "monthly")
def inverse_velocity_monthly(spark, d):
    return failure.monthly_inverse(T.monthly(spark, d)).select("pid", F.col("month").cast("string"), *r6("inverse"))


def _failures(spark, d):
    return failure.failures(failure.monthly_inverse(T.monthly(spark, d)), [3, 4, 5, 6, 7])


@query(FAIL + " SELECT pid, n, strftime(failure_date AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM z", "monthly")
def failure_dates(spark, d):
    return _failures(spark, d).select("pid", "n", F.date_format("failure_date", "yyyy-MM-dd").alias("day"))


@query(FAIL + " SELECT n, strftime(failure_date AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) cnt FROM z GROUP BY 1, 2", "monthly")
def failure_month_counts(spark, d):
    return failure.failure_months(_failures(spark, d))


@query(FAIL + ", h AS (SELECT n, strftime(failure_date AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) cnt FROM z GROUP BY 1, 2) SELECT n, month, cnt FROM h QUALIFY row_number() OVER (PARTITION BY n ORDER BY cnt DESC, month) = 1", "monthly")
def failure_month_mode(spark, d):
    return failure.likeliest(failure.failure_months(_failures(spark, d)))


# --- matching --------------------------------------------------------------------------------------

CENTRED = "list_transform(e, lambda x: x - list_avg(e))"
NCC = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), z AS (SELECT vec_id, {CENTRED} e FROM v),
k AS (SELECT a.vec_id block_id, a.e a, b.e b, sqrt(list_inner_product(a.e,a.e))*sqrt(list_inner_product(b.e,b.e))*64 k FROM z a JOIN z b ON b.vec_id = a.vec_id + 1),
c AS (SELECT block_id, s.range s, list_sum(list_transform(range(64), lambda p: a[1 + ((p//8 + s.range//8 + 4) % 8)*8 + (p % 8 + s.range % 8 + 4) % 8] * b[1 + p]))/k c FROM k, range(64) s),
t AS (SELECT block_id, arg_max(s, (round(c, 12), -s)) s, max(c) top, avg(abs(c)) mean FROM c GROUP BY 1),
q AS (SELECT block_id, max(c.c) AS other FROM c JOIN t USING (block_id) WHERE abs(c.s//8 - t.s//8) > 1 OR abs(c.s % 8 - t.s % 8) > 1 GROUP BY 1)"""


def _matches(spark, d):
    return matching.peaks(matching.ncc_surface(T.blocks(spark, d), SIZE), SIZE)


@query(NCC + " SELECT block_id, (4 - s % 8)::INT u, (4 - s//8)::INT v FROM t")
def ncc_peak(spark, d):
    return _matches(spark, d).select("block_id", "u", "v")


@query(NCC + " SELECT block_id, round(top/(mean+1e-10::DOUBLE),6) snr, round(top/(other+1e-10::DOUBLE),6) pkr FROM t JOIN q USING (block_id)")
def ncc_pkr_snr(spark, d):
    return _matches(spark, d).select("block_id", *r6("snr", "pkr"))


PEAK = ", l AS (SELECT block_id, list(c ORDER BY s) c FROM c GROUP BY 1), k0 AS (SELECT l.block_id, c, (s//8)::INT i, (s % 8)::INT j FROM l JOIN t USING (block_id))"


def _subpixel_sql(method: str) -> tuple[str, str]:
    """The offsets along y and x of the peak in c, as SQL."""
    at = lambda dy, dx: f"(CASE WHEN i+({dy}) BETWEEN 0 AND 7 AND j+({dx}) BETWEEN 0 AND 7 THEN c[(i+({dy}))*8+j+({dx})+1] END)"
    mid = lambda dy, dx: f"c[{(4 + dy) * 8 + 4 + dx + 1}]"
    if method == "parabolic":
        return tuple(f"coalesce(({at(-y, -x)}-{at(y, x)})/(2*nullif({at(-y, -x)}-2*{at(0, 0)}+{at(y, x)},0)),0)" for y, x in ((1, 0), (0, 1)))
    if method == "center_of_mass":
        nine = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
        total = "+".join(at(y, x) for y, x in nine)
        return tuple("coalesce((" + "+".join(f"({p[k]})*{at(*p)}" for p in nine) + f")/nullif({total},0),0)" for k in (0, 1))
    if method == "gaussian":
        ln = lambda c: f"ln(greatest({c},1e-10::DOUBLE))"
        out = []
        for y, x in ((1, 0), (0, 1)):
            p, q, r = at(-y, -x), at(0, 0), at(y, x)
            value = f"({ln(p)}-{ln(r)})/(2*nullif({ln(p)}-2*{ln(q)}+{ln(r)},0))"
            out.append(f"coalesce(CASE WHEN {p} IS NOT NULL AND {r} IS NOT NULL AND {value} IS NOT NULL THEN least(greatest({value},-1),1) END,0)")
        return tuple(out)
    if method == "ipg":
        gy, gx = f"(({mid(1, 0)}-{mid(-1, 0)})/2)", f"(({mid(0, 1)}-{mid(0, -1)})/2)"
        yy, xx = f"({mid(1, 0)}-2*{mid(0, 0)}+{mid(-1, 0)})", f"({mid(0, 1)}-2*{mid(0, 0)}+{mid(0, -1)})"
        xy = f"(({mid(1, 1)}-{mid(1, -1)}-{mid(-1, 1)}+{mid(-1, -1)})/4)"
        det, mean, root = f"nullif({xx}*{yy}-{xy}*{xy},0)", f"(({xx}+{yy})/2)", f"sqrt((({xx}-{yy})/2)**2+{xy}*{xy})"
        dx, dy = f"(-({yy}*{gx}-{xy}*{gy})/{det})", f"(-({xx}*{gy}-{xy}*{gx})/{det})"
        ok = f"greatest(abs({mean}+{root}),abs({mean}-{root})) <= 1e3*least(abs({mean}+{root}),abs({mean}-{root})) AND sqrt({dx}*{dx}+{dy}*{dy}) <= 2"
        return f"(CASE WHEN {ok} THEN {dy} ELSE 0 END)", f"(CASE WHEN {ok} THEN {dx} ELSE 0 END)"
    if method == "ensemble":
        return tuple(f"(({a}+{b})/2)" for a, b in zip(_subpixel_sql("os3"), _subpixel_sql("parabolic"), strict=True))
    half = int(method[2:]) // 2
    cells = [(y, x) for y in range(-half, half + 1) for x in range(-half, half + 1)]
    mean = "((" + "+".join(mid(*p) for p in cells if p != (0, 0)) + f")/{len(cells) - 1})"
    weight = lambda p: f"greatest({mid(*p)}-m,0)"
    total = "nullif(" + "+".join(weight(p) for p in cells) + ",0)"
    out = ["coalesce((" + "+".join(f"({p[k]})*{weight(p)}" for p in cells) + f")/{total},0)" for k in (0, 1)]
    return tuple(f"list_aggregate(list_transform([{mean}], lambda m: {x}), 'max')" for x in out)


def _subpixel(method: str):
    def f(spark, d):
        return matching.match_ncc(T.blocks(spark, d), SIZE, method).select("block_id", *r6("u", "v"))

    f.__name__ = f"subpixel_{method}"
    oy, ox = _subpixel_sql(method)
    whole = method in ("parabolic", "center_of_mass")
    query(NCC + PEAK + f" SELECT block_id, round(-({'(j-4)+' if whole else ''}{ox}),6) u, round(-({'(i-4)+' if whole else ''}{oy}),6) v FROM k0")(f)


for _m in matching.SUBPIXEL[1:]:
    _subpixel(_m)

#: Spectra of all images, by sums over their pixels, and the pairs' cross spectra xr + i xi.
SPECTRA = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
w AS (SELECT k.range k, list(cos(2*pi()*(((k.range//8)*(p.range//8)+(k.range%8)*(p.range%8))%8)/8) ORDER BY p.range) cl, list(sin(2*pi()*(((k.range//8)*(p.range//8)+(k.range%8)*(p.range%8))%8)/8) ORDER BY p.range) sl FROM range(64) k, range(64) p GROUP BY 1),
f AS (SELECT vec_id, k, list_inner_product(e, cl) re, -list_inner_product(e, sl) im FROM v, w),
x0 AS (SELECT a.vec_id block_id, a.k, a.re*b.re+a.im*b.im xr, a.im*b.re-a.re*b.im xi FROM f a JOIN f b ON b.vec_id = a.vec_id+1 AND b.k = a.k)"""
PCC = SPECTRA + """, x AS (SELECT block_id, list(xr/(sqrt(xr*xr+xi*xi)+1e-10::DOUBLE) ORDER BY k) xr, list(xi/(sqrt(xr*xr+xi*xi)+1e-10::DOUBLE) ORDER BY k) xi FROM x0 GROUP BY 1),
c AS (SELECT block_id, ((k//8+4)%8)*8+(k%8+4)%8 s, (list_inner_product(xr, cl)-list_inner_product(xi, sl))/64 c FROM x, w),
t AS (SELECT block_id, arg_max(s, (round(c, 12), -s)) s, max(c) top, avg(abs(c)) mean FROM c GROUP BY 1),
q AS (SELECT block_id, max(c.c) AS other FROM c JOIN t USING (block_id) WHERE abs(c.s//8 - t.s//8) > 1 OR abs(c.s % 8 - t.s % 8) > 1 GROUP BY 1)"""


@query(PCC + " SELECT block_id, (4 - s % 8)::INT u, (4 - s//8)::INT v, round(top/(mean+1e-10::DOUBLE),6) snr, round(top/(other+1e-10::DOUBLE),6) pkr FROM t JOIN q USING (block_id)")
def pcc_peak(spark, d):
    return matching.match_pcc(T.blocks(spark, d), SIZE, "none").select("block_id", "u", "v", *r6("snr", "pkr"))


UPSAMPLED = SPECTRA + """, n AS (SELECT block_id, k, xr/greatest(sqrt(xr*xr+xi*xi),100*2.220446049250313e-16::DOUBLE) xr, xi/greatest(sqrt(xr*xr+xi*xi),100*2.220446049250313e-16::DOUBLE) xi FROM x0),
x AS (SELECT block_id, list(xr ORDER BY k) xr, list(xi ORDER BY k) xi FROM n GROUP BY 1),
c AS (SELECT block_id, k p, sqrt((list_inner_product(xr, cl)-list_inner_product(xi, sl))**2+(list_inner_product(xr, sl)+list_inner_product(xi, cl))**2) c FROM x, w),
t AS (SELECT block_id, arg_max(p, (round(c, 9), -p)) p FROM c GROUP BY 1),
b AS (SELECT block_id, CASE WHEN p//8 > 4 THEN p//8-8 ELSE p//8 END py, CASE WHEN p%8 > 4 THEN p%8-8 ELSE p%8 END px FROM t),
m AS (SELECT range g, range/10.0::DOUBLE-1.5 f FROM range(31)),
y AS (SELECT n.block_id, g, px, py+m.f ay, k%8 kx, (CASE WHEN k//8 > 3 THEN k//8-8 ELSE k//8 END)*(py+m.f)*2*pi()/8 z, xr, xi FROM n JOIN b USING (block_id), m),
r AS (SELECT block_id, g gy, px, any_value(ay) ay, kx, sum(xr*cos(z)-xi*sin(z)) xr, sum(xr*sin(z)+xi*cos(z)) xi FROM y GROUP BY block_id, g, px, kx),
h AS (SELECT block_id, gy, ay, g gx, px+m.f ax, (CASE WHEN kx > 3 THEN kx-8 ELSE kx END)*(px+m.f)*2*pi()/8 z, xr, xi FROM r, m),
o AS (SELECT block_id, gy, gx, any_value(ay) ay, any_value(ax) ax, sum(xr*cos(z)-xi*sin(z))**2+sum(xr*sin(z)+xi*cos(z))**2 p FROM h GROUP BY 1, 2, 3)
SELECT block_id, round(-arg_max(ax, (round(p,9), -(gy*31+gx))),6) u, round(-arg_max(ay, (round(p,9), -(gy*31+gx))),6) v FROM o GROUP BY 1"""


@query(UPSAMPLED)
def pcc_upsampled(spark, d):
    return matching.match_upsampled(T.blocks(spark, d), SIZE).select("block_id", *r6("u", "v"))


def _mean_shift(a, b):
    return float(b.mean() - a.mean()), 0.0, None, None


@query("WITH v AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) m FROM embeddings) SELECT a.vec_id block_id, round(a.m - b.m, 6) u FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def custom_match_udf(spark, d):
    return matching.match_by(T.blocks(spark, d), SIZE, _mean_shift).select("block_id", *r6("u"))


# --- all of it -------------------------------------------------------------------------------------

#: Blocks of 4 pixels, a step of 2, over images of 8 by 8: nine of them, matched with the next image's.
TRACKED = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
d AS (SELECT vec_id, ry.range gy, rx.range gx, list_transform(range(16), lambda p: e[1+(ry.range*2+p//4)*8+rx.range*2+p%4]) e FROM v, range(3) ry, range(3) rx),
z AS (SELECT vec_id, gy, gx, {CENTRED} e FROM d),
k AS (SELECT a.vec_id pair_id, a.gy, a.gx, a.e a, b.e b, sqrt(list_inner_product(a.e,a.e))*sqrt(list_inner_product(b.e,b.e))*16 k FROM z a JOIN z b ON b.vec_id = a.vec_id+1 AND a.gy = b.gy AND a.gx = b.gx),
c AS (SELECT pair_id, gy, gx, s.range s, list_sum(list_transform(range(16), lambda p: a[1+((p//4+s.range//4+2)%4)*4+(p%4+s.range%4+2)%4]*b[1+p]))/k c FROM k, range(16) s),
hit AS (SELECT pair_id, gy, gx, arg_max(s, (round(c,12), -s)) s, max(c) top, avg(abs(c)) mean, list(c ORDER BY s) c FROM c GROUP BY 1, 2, 3),
q AS (SELECT pair_id, gy, gx, max(c.c) AS other FROM c JOIN hit USING (pair_id, gy, gx) WHERE abs(c.s//4-hit.s//4) > 1 OR abs(c.s%4-hit.s%4) > 1 GROUP BY 1, 2, 3),
p AS (SELECT pair_id, gy*3+gx pt_idx, gx*2+2 x, gy*2+2 y, top/(mean+1e-10::DOUBLE) snr, top/(other+1e-10::DOUBLE) pkr, (s//4)::INT i, (s%4)::INT j, c FROM hit JOIN q USING (pair_id, gy, gx)),
disp AS (SELECT pair_id, pt_idx, x, y, snr, pkr, -((j-2)+coalesce((CASE WHEN j BETWEEN 1 AND 2 THEN (c[i*4+j]-c[i*4+j+2])/(2*nullif(c[i*4+j]-2*c[i*4+j+1]+c[i*4+j+2],0)) END),0)) u, -((i-2)+coalesce((CASE WHEN i BETWEEN 1 AND 2 THEN (c[i*4+j-3]-c[i*4+j+5])/(2*nullif(c[i*4+j-3]-2*c[i*4+j+1]+c[i*4+j+5],0)) END),0)) v FROM p)"""


def _tracked(spark, d, **options):
    ids = T.table(spark, d, "embeddings").select("vec_id")
    pairs_of = ids.join(ids.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id").select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("idx1"), (F.col("vec_id") + 1).alias("idx2"))
    return matching.track(_stack(spark, d), pairs_of, (SIZE, SIZE), block=4, overlap=0.5, **options)


@query(TRACKED + f" SELECT pair_id, pt_idx, x, y, {R('u', 'v', 'pkr', 'snr')} FROM disp")
def track_pairs(spark, d):
    return _tracked(spark, d).select("pair_id", "pt_idx", "x", "y", *r6("u", "v", "pkr", "snr"))


QUALITY = {"pkr": 1.05, "snr": 2.0}


@query(TRACKED + DEFAULT + f", f AS (SELECT x, y, median(u-mu)*10 u, median(v-mv)*10 v FROM t WHERE ok AND pkr >= 1.05 AND snr >= 2 GROUP BY 1, 2) SELECT x, y, {R('u', 'v')}, round({MAG},6) mag FROM f")
def track_field(spark, d):
    return displacement.median_field(_tracked(spark, d, filters=QUALITY), None).select("x", "y", *r6("u", "v", "mag"))


@query(TRACKED + f" SELECT x, y, count(*) n FROM disp WHERE {MAG} < 1 GROUP BY 1, 2")
def track_custom_filter(spark, d):
    return _tracked(spark, d, filters=lambda rows: rows.where(F.hypot("u", "v") < 1)).groupBy("x", "y").agg(F.count("*").alias("n"))


@query(None)
def flow_blocks(spark, d):
    return matching.matched(T.blocks(spark, d), SIZE, "flow").select("block_id", *r6("u", "v"))


@query(None)
def flow_dense(spark, d):
    ids = T.table(spark, d, "embeddings").select("vec_id")
    pairs_of = ids.join(ids.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id").select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("idx1"), (F.col("vec_id") + 1).alias("idx2"))
    rows = matching.track(_stack(spark, d), pairs_of, (SIZE, SIZE), method="optical_flow")
    return rows.groupBy("x", "y").agg(F.median("u").alias("u"), F.median("v").alias("v")).select("x", "y", *r6("u", "v"))
