"""Small cases with answers worked out by hand, and properties."""

import datetime as dt

import numpy as np
import pytest

from tellurion.operators import catalog, displacement, failure, field, matching, pairs, raster, velocity

D = dt.date


def test_stride():
    assert [raster.stride(*x) for x in ((16, 0.8), (16, 0.6), (32, 0.8))] == [3, 6, 6]
    with pytest.raises(ValueError):
        raster.stride(10, 0.9)


def test_even_sample(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2020, 6, 1 + i)) for i in range(11)], "image_id long, ts timestamp")
    got = catalog.season_sample(rows, 2020, 2020, 4, ("-05-01", "-10-01"))
    assert sorted(r.image_id for r in got.collect()) == [0, 2, 4, 6]


def test_clean_id(spark):
    df = spark.createDataFrame([("1_2_20200101T101010_X",), ("none",)], "i string")
    assert [r[0] for r in df.select(catalog.clean_id(df.i)).collect()] == ["20200101T101010_X", "none"]


def test_pair_range(spark):
    first = D(2000, 1, 1)
    days = [0, 365, 366, 1827]
    dates = spark.createDataFrame([(first + dt.timedelta(x),) for x in days], "date date")
    got = {(r.dat1, r.dat2) for r in pairs.date_pairs(dates).collect() if r.dat1 == first}
    assert got == {(first, first + dt.timedelta(366))}


def test_quality_gate(spark):
    shape = "pair_id int, pt_idx int, u double, v double, pkr double"
    some = spark.createDataFrame([(0, 0, 1.0, 1.0, None), (0, 1, 1.0, 1.0, 2.0), (1, 0, 1.0, 1.0, None)], shape)
    got = displacement.end(displacement.by_quality(displacement.begin(some), "pkr", 1.3)).collect()
    assert {(r.pair_id, r.pt_idx) for r in got} == {(0, 1), (1, 0)}


def test_month_bins(spark):
    rows = [(1, D(2020 + m // 12, m % 12 + 1, 15), 1.0) for m in range(1, 13)]
    got = velocity.binned(spark.createDataFrame(rows, "point long, at date, v double"), "at", 6)
    assert sorted(r.date for r in got.collect()) == [D(2020, 2, 29), D(2020, 8, 31), D(2021, 2, 28)]


def test_empty_bins_are_null(spark):
    rows = [(1, D(2020, 1, 5), 1.0), (1, D(2020, 7, 5), 3.0)]
    got = {r.date: r.velocity for r in velocity.binned(spark.createDataFrame(rows, "point long, at date, v double"), "at", 2).collect()}
    assert got == {D(2020, 1, 31): 1.0, D(2020, 3, 31): None, D(2020, 5, 31): None, D(2020, 7, 31): 3.0}


def test_inverse_velocity(spark):
    rows = [("a", D(2020, 1, 1) + dt.timedelta(30 * i), x) for i, x in enumerate((10.0, 8.0, 6.0, 4.0))]
    got = failure.failures(spark.createDataFrame(rows, "pid string, month date, inverse double"), [4]).collect()
    assert [r.failure_date.date() for r in got] == [D(2020, 1, 1) + dt.timedelta(150)]


def test_mode_takes_the_earliest(spark):
    m = spark.createDataFrame([(5, "2021-02", 3), (5, "2021-01", 3)], "n int, month string, cnt long")
    assert [r.month for r in failure.likeliest(m).collect()] == ["2021-01"]


def test_density(spark):
    pts = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5), (9.0, 9.0)]
    got = field.dense(spark.createDataFrame(pts, "x double, y double"), 2.0, 5)
    assert {(r.x, r.y) for r in got.collect()} == set(pts[:5])


def test_density_is_brute_force(spark):
    pts = np.random.default_rng(0).random((150, 2)) * 20
    got = {(r.x, r.y) for r in field.dense(spark.createDataFrame(pts.tolist(), "x double, y double"), 2.0, 4).collect()}
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= 4
    core = near.sum(1) >= 4
    assert got == {tuple(p) for p, k in zip(pts.tolist(), (near & core[None]).any(1), strict=True) if k}


@pytest.mark.parametrize("match", [matching.match_ncc, matching.match_pcc])
def test_known_shift(spark, match):
    a = np.random.default_rng(1).random((8, 8))
    b = np.roll(a, (1, 2), (0, 1))
    df = spark.createDataFrame([(0, a.ravel().tolist(), b.ravel().tolist())], "block_id long, a array<double>, b array<double>")
    r = match(df, 8, "none").first()
    assert (r.u, r.v) == (2, 1) and abs(r.pkr) > 1


def test_upsampled_shift(spark):
    a = np.random.default_rng(2).random((8, 8))
    df = spark.createDataFrame([(0, a.ravel().tolist(), np.roll(a, (1, 2), (0, 1)).ravel().tolist())], "block_id long, a array<double>, b array<double>")
    r = matching.match_upsampled(df, 8).first()
    assert (round(r.u, 6), round(r.v, 6), r.pkr) == (2, 1, None)


def test_methods_by_name(spark):
    df = spark.createDataFrame([], "block_id long, a array<double>, b array<double>")
    with pytest.raises(ValueError):
        matching.match_ncc(df, 8, "quadratic")
    with pytest.raises(ValueError):
        velocity.velocity_series(spark.createDataFrame([], "point long, u double, v double"), "mean")


def test_blocks_cover(spark):
    px = spark.createDataFrame([(0, y, x, float(10 * y + x)) for y in range(6) for x in range(6)], "scene int, y int, x int, v double")
    got = {(r.by, r.bx): r.data for r in matching.cut_blocks(px, 4, 2, 6, 6).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)} and got[1, 1][:2] == [22.0, 23.0] and len(got[1, 1]) == 16


def test_least_squares(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 1, 3), 3.0, 1.0), (1, D(2020, 1, 2), D(2020, 1, 4), 5.0, 4.0)]
    got = velocity.least_squares(spark.createDataFrame(rows, "point long, d1 date, d2 date, v double, snr double"), weight="snr")
    x = np.array([r.v for r in got.orderBy("at").collect()])
    a = np.array([[1, 1, 1, 0], [0, 1, 1, 1]]) * np.sqrt([[1], [4]])
    want = np.linalg.lstsq(a, np.array([3, 5]) * 3 / 365.25 * np.sqrt([1, 4]), rcond=None)[0]
    assert np.allclose(x, want)


def test_cubic_rmse(spark):
    rows = [(1, D(2020, 1, 1 + i), float(i**3)) for i in range(8)] + [(2, D(2020, 1, 1), 1.0)] + [(3, D(2020, 1, 1 + i), 1.0 * i) for i in range(3)]
    got = {r.point: r.rmse for r in velocity.cubic_rmse(spark.createDataFrame(rows, "point long, date date, velocity double")).collect()}
    assert got[1] < 1e-6 and got[2] is None and got[3] == 0.0


def test_holes(spark):
    cells = [(y, x, (y in (1, 3) and 1 <= x <= 3) or (x in (1, 3) and 1 <= y <= 3)) for y in range(5) for x in range(5)]
    got = raster.without_holes(spark.createDataFrame(cells, "gy int, gx int, on boolean")).where("on").collect()
    assert {(r.gy, r.gx) for r in got} == {(y, x) for y in (1, 2, 3) for x in (1, 2, 3)}


def test_files(spark, tmp_path):
    from tellurion.sources import files

    s = spark.createDataFrame([(0, "A", "2020-01-02", 1.5, 3, "T"), (1, "B", "2020-01-03", 2.5, 4, "U")], "idx int, Image_ID string, Date string, Cloud_Cover double, Orbit_Number int, Tile_ID string")
    files.write_metadata(s, f"{tmp_path}/m", [1])
    assert [(r.Image_ID, r.date) for r in files.read_metadata(spark, f"{tmp_path}/m").collect()] == [("B", D(2020, 1, 3))]
    w = spark.createDataFrame([("p", 1.0, None)], "pid string, D20200131 double, D20200229 double")
    files.write_wide(w, f"{tmp_path}/w")
    assert [(r.date, r.velocity) for r in failure.melted(files.read_wide(spark, f"{tmp_path}/w")).orderBy("date").collect()] == [(D(2020, 1, 31), 1.0), (D(2020, 2, 29), None)]
    calls = []
    for _ in range(2):
        got = files.predictions(spark, str(tmp_path), "block", "ncc", lambda: calls.append(1) or w)
    assert got.count() == 1 and calls == [1]


def test_corrupt_predictions_are_not_computed_anew(spark, tmp_path):
    from tellurion.sources import files

    (tmp_path / "block_ncc.parquet").mkdir()
    (tmp_path / "block_ncc.parquet" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|infer|schema"):
        files.predictions(spark, str(tmp_path), "block", "ncc", lambda: spark.range(1)).count()


@pytest.mark.parametrize("kind, nodata", [("uint8", 0), ("int16", -1), ("float32", None), ("float64", -9999.0)])
def test_geotiff_round_trip(kind, nodata):
    from tellurion.sources import geotiff

    bands = (np.random.default_rng(1).random((3, 70, 41)) * 100).astype(kind)
    for affine in ((10.0, 0.0, 5e5, 0.0, -10.0, 4.6e6), (1.0, 0.5, 2.0, 0.25, -1.0, 3.0)):
        got = geotiff.decode(geotiff.encode(geotiff.Raster(bands, affine, 32632, nodata), rows=16))
        assert (got.bands == bands).all() and got.bands.dtype == bands.dtype
        assert (got.affine, got.epsg, got.nodata) == (affine, 32632, nodata)


def test_geotiff_files(spark, tmp_path):
    from tellurion.sources import geotiff

    px = [(b, y, x, float(100 * b + 10 * y + x)) for b in (1, 2) for y in range(4) for x in range(5) if (b, y, x) != (2, 3, 4)]
    path, affine = f"{tmp_path}/r.tif", (10.0, 0.0, 5e5, 0.0, -10.0, 4.6e6)
    geotiff.write_geotiff(spark.createDataFrame(px, "band int, y int, x int, v double"), path, (4, 5), affine, 32632, -9999.0)
    assert geotiff.read_affine(spark, path) == (affine, 32632, (4, 5))
    got = {(r.scene + 1, r.y, r.x): r.v for r in geotiff.read_stack(spark, path).collect()}
    assert got.pop((2, 3, 4)) is None and got == {p[:3]: p[3] for p in px}
    with pytest.raises(ValueError):
        geotiff.write_geotiff(spark.createDataFrame(px, "band int, y int, x int, v double"), path, (10**5, 10**5))


def _smooth(rng, n):
    k = np.fft.fftfreq(n)
    return np.real(np.fft.ifft2(np.fft.fft2(rng.random((n, n))) * np.exp(-(k[:, None] ** 2 + k[None] ** 2) * 80))) * 255


def _moved(image, dy, dx):
    k = np.fft.fftfreq(len(image))
    return np.real(np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (k[:, None] * dy + k[None] * dx))))


def test_flow_finds_a_known_shift():
    from tellurion.operators import flow

    a = _smooth(np.random.default_rng(3), 64)
    for dy, dx in ((0.0, 0.0), (0.4, -0.7), (2.0, 3.0)):
        d = flow.flow_between(a, _moved(a, dy, dx))[:, 12:-12, 12:-12]
        assert abs(np.median(d[0]) - dx) < 0.1 and abs(np.median(d[1]) - dy) < 0.1


@pytest.mark.parametrize("method, near", [("parabolic", 0.2), ("center_of_mass", 0.5), ("upsampled", 0.11)])
def test_sub_pixel_methods_near_a_known_shift(spark, method, near):
    a = _smooth(np.random.default_rng(4), 16)
    b = _moved(a, 1.3, -0.4)
    df = spark.createDataFrame([(0, a.ravel().tolist(), b.ravel().tolist())], "block_id long, a array<double>, b array<double>")
    r = (matching.matched(df, 16, "upsampled") if method == "upsampled" else matching.matched(df, 16, "ncc", method)).first()
    assert abs(r.u + 0.4) < near and abs(r.v - 1.3) < near


def test_correlation_by_transform_is_that_by_expression(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(16).tolist(), rng.random(16).tolist()) for i in range(5)] + [(9, [1.0] * 16, [1.0] * 16)]
    df = spark.createDataFrame(rows, "block_id long, a array<double>, b array<double>")
    one, two = ({r.block_id: r.c for r in f(df, 4).collect()} for f in (matching.ncc_by_expression, matching.ncc_by_transform))
    assert all(np.allclose(one[i], two[i]) for i in range(5)) and two[9] is None and set(one[9]) == {None}


def test_track_dispatches(spark):
    a = _smooth(np.random.default_rng(6), 24)
    images = [a, _moved(a, 1.0, 2.0)]
    stack = spark.createDataFrame([(s, y, x, float(images[s][y, x])) for s in (0, 1) for y in range(24) for x in range(24)], "scene long, y int, x int, v double")
    pairs_of = spark.createDataFrame([(5, 0, 1), (6, 0, 9)], "pair_id long, idx1 long, idx2 long")
    got = matching.track(stack, pairs_of, (24, 24), block=12, overlap=0.5, by="pcc", subpixel="none").collect()
    assert len(got) == 9 and {r.pair_id for r in got} == {5} and sorted(r.pt_idx for r in got) == list(range(9))
    custom = matching.track(stack, pairs_of, (24, 24), block=12, overlap=0.5, by=lambda p, q: (1.0, 2.0, None, 3.0), filters=lambda d: d.where("x = 6")).collect()
    assert {(r.x, r.u, r.v, r.pkr, r.snr) for r in custom} == {(6, -1.0, -2.0, None, 3.0)} and len(custom) == 3
    flow = matching.track(stack, pairs_of, (24, 24), method="optical_flow").collect()
    assert len(flow) == 576 and {r.pair_id for r in flow} == {5}
    for wrong in ({"method": "guess"}, {"by": "guess"}):
        with pytest.raises(ValueError):
            matching.track(stack, pairs_of, (24, 24), **wrong)


def test_windows_over_ranges_are_those_over_pairs(spark, monkeypatch):
    from tellurion.functions import arrays

    rng = np.random.default_rng(7)
    rows = [(p, i, *rng.normal(size=2).tolist()) for p in (0, 1) for i in range(97)]
    d = displacement.begin(spark.createDataFrame(rows, "pair_id int, pt_idx int, u double, v double"))
    f = spark.createDataFrame([(i, 0, (0, i), *rng.normal(size=3).tolist()) for i in range(97)], "x int, y int, ord struct<pair_id:int,pt_idx:int>, ang double, u double, mag double")
    runs = [lambda: displacement.median_smoothed(d), lambda: displacement.by_neighbours(d, 1.0), lambda: displacement.by_angle(d, 60.0), lambda: field.coherent(f, 60.0).drop("ord")]
    rows_of = lambda: [sorted(map(tuple, run().collect())) for run in runs]
    whole = rows_of()
    for module in (arrays, field):
        monkeypatch.setattr(module, "RANGE", 10)
    assert rows_of() == whole


def test_least_squares_is_that_of_days(spark):
    rng = np.random.default_rng(8)
    first = D(2020, 1, 1)
    rows = [(1, first + dt.timedelta(int(a)), first + dt.timedelta(int(a + n)), float(v)) for a, n, v in zip(rng.integers(0, 60, 9), rng.integers(5, 40, 9), rng.normal(size=9), strict=True)]
    got = [r.v for r in velocity.least_squares(spark.createDataFrame(rows, "point long, d1 date, d2 date, v double")).orderBy("at").collect()]
    low, high = min(r[1] for r in rows), max(r[2] for r in rows)
    days = [low + dt.timedelta(k) for k in range((high - low).days + 1)]
    cover = np.array([[r[1] <= x <= r[2] for x in days] for r in rows], dtype=float)
    want = np.linalg.lstsq(cover, np.array([r[3] * ((r[2] - r[1]).days + 1) / 365.25 for r in rows]), rcond=None)[0]
    assert np.allclose(got, want)


def test_thinning_keeps_lines_and_wears_blobs(spark):
    cells = [(y, x, y == 4 or (5 <= y <= 8 and 2 <= x <= 6)) for y in range(10) for x in range(9)]
    got = {(r.gy, r.gx) for r in raster.thinned(spark.createDataFrame(cells, "gy int, gx int, on boolean")).where("on").collect()}
    assert {(4, 0), (4, 8)} <= got and (8, 2) not in got and (6, 4) in got


def test_map_filters_may_stop_early(spark):
    f = spark.createDataFrame([(1, 1, (0, 0), 1.0, 0.0, 9.0, 0.0), (2, 2, (0, 1), 1.0, 0.0, 1.0, 0.0)], "x int, y int, ord struct<pair_id:int,pt_idx:int>, u double, v double, mag double, ang double")
    none = spark.createDataFrame([], "y int, x int, slope double, aspect double")
    assert field.final_map(f, none, threshold=5, stop_early=True).count() == 1
    assert field.final_map(f, none, threshold=5).count() == 0


def test_composites_bands_and_grid_places(spark, tmp_path):
    from tellurion.sources import files

    stack = spark.createDataFrame([(s, y, 0, float(s + 2 * y)) for s in (0, 1, 2) for y in (0, 1)], "scene long, y int, x int, v double")
    files.write_composite(stack, f"{tmp_path}/c", [0, 2])
    assert sorted((r.scene, r.y, r.v) for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [(0, 0, 0), (0, 1, 255), (2, 0, 0), (2, 1, 255)]
    grid = spark.createDataFrame([("2020-01-31", 0, 0, 1.5)], "date string, gy int, gx int, mag double")
    files.write_bands(grid, f"{tmp_path}/b")
    assert [r.mag for r in spark.read.parquet(f"{tmp_path}/b").collect()] == [1.5]
    stretched, shifted = files.grid_affines((10.0, 0.0, 100.0, 0.0, -10.0, 500.0), (40, 60), (8, 12), 16, 4)
    assert stretched == (50.0, 0.0, 100.0, 0.0, -50.0, 500.0) and shifted == (40.0, 0.0, 180.0, 0.0, -40.0, 420.0)
    assert files.to_ground(0, 0, (10.0, 0.0, 100.0, 0.0, -10.0, 500.0)) == (105.0, 495.0)


def test_pairs_are_numbered_by_date(spark):
    rows = spark.createDataFrame([(D(2001, 1, 1), D(2003, 1, 1)), (D(2000, 1, 1), D(2004, 1, 1)), (D(2000, 1, 1), D(2002, 1, 1))], "dat1 date, dat2 date")
    got = {(r.dat1, r.dat2): r.pair_id for r in pairs.numbered(rows).collect()}
    assert [got[k] for k in sorted(got)] == [0, 1, 2]


def test_positions_by_code(spark):
    from pyspark.sql import functions as F
    from tellurion.functions import geo

    d = spark.createDataFrame([(0, 0)], "x int, y int")
    at = lambda *a: tuple(d.select(*geo.lon_lat(F.col("x"), F.col("y"), *a)).first())
    assert at((0.5, 0.0, 10.0, 0.0, -0.5, 46.0), 4326) == (10.25, 45.75)
    assert at((10.0, 0.0, 499995.0, 0.0, -10.0, 5.0), 32632) == (9.0, 0.0) == at((10.0, 0.0, 499995.0, 0.0, -10.0, 1e7 + 5), 32732)
    with pytest.raises(ValueError):
        at((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3035)


def test_bilinear_sends_no_pixels_to_the_driver(spark):
    tall = spark.createDataFrame([(0, 0, 1.0), (23999, 49, 2.0)], "y int, x int, dem double")
    plan = raster.bilinear(tall, "dem", (24000, 50), (36000, 75))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    square = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 6.0)], "y int, x int, dem double")
    got = {(r.y, r.x): r.dem for r in raster.bilinear(square, "dem", (2, 2), (3, 3)).collect()}
    assert got == {(y, x): 2.0 * y + x for y in range(3) for x in range(3)}


def test_terrain_is_resampled_in_one_pass(spark):
    kinds = "y int, x int, dem double, slope double, aspect double"
    tall = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (23999, 49, 2.0, 3.0, 4.0)], kinds)
    plan = raster.resampled_terrain(tall, (24000, 50), (36000, 75))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan
    square = spark.createDataFrame([(0, 0, 0.0, 1.0, None), (0, 1, 2.0, 1.0, None), (1, 0, 4.0, 1.0, None), (1, 1, 6.0, 1.0, None)], kinds)
    got = {(r.y, r.x): (r.dem, r.slope, r.aspect) for r in raster.resampled_terrain(square, (2, 2), (3, 3)).collect()}
    assert got == {(y, x): (2.0 * y + x, 1.0, None) for y in range(3) for x in range(3)}


#: Series of three months by discount in hundredths, and the midnight at which their line meets 0.
MIDNIGHTS = [(D(1995, 3, 1), (7, 8, 7), D(2036, 1, 1)), (D(1995, 7, 1), (7, 1, 1), D(1995, 8, 1)), (D(1995, 7, 1), (8, 2, 10), D(1995, 9, 1))]


def _at_midnight(spark, which):
    rows = []
    for pid, k in enumerate(which):
        first, discounts, _ = MIDNIGHTS[k]
        rows += [(str(pid), D(first.year, first.month + i, 1), 1 / ((c / 100 - 0.05) * 10)) for i, c in enumerate(discounts)]
    return failure.failures(spark.createDataFrame(rows, "pid string, month date, inverse double"), [3])


def test_failure_at_midnight_is_of_the_day_that_begins(spark):
    got = {r.pid: r.failure_date for r in _at_midnight(spark, (0, 1, 2)).collect()}
    assert got == {str(k): dt.datetime(day.year, day.month, day.day) for k, (_, _, day) in enumerate(MIDNIGHTS)}


def test_failures_at_midnight_count_for_the_month_that_begins(spark):
    got = failure.failure_months(_at_midnight(spark, (0, 1, 1, 2))).collect()
    assert sorted(map(tuple, got)) == [(3, "1995-08", 2), (3, "1995-09", 1), (3, "2036-01", 1)]


def test_mode_counts_failures_at_midnight(spark):
    got = failure.likeliest(failure.failure_months(_at_midnight(spark, (0, 1, 1, 2)))).collect()
    assert [(r.n, r.month, r.cnt) for r in got] == [(3, "1995-08", 2)]
