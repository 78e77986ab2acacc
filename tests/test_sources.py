"""Sources and sinks that executors read and write."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.operators.raster import Grid
from hydroframe.sources import geotiff, wkb

GRID = geotiff.Grid(1000.0, 5000.0, 0.5)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_a_tiff_by_its_tags():
    bands = np.arange(24, dtype=float).reshape(2, 3, 4)
    data = geotiff.encode(bands, 10.0, 20.0, 0.5, epsg=28992)
    assert (geotiff.decode(data) == bands).all() and data[:4] == b"II*\0"
    n = struct.unpack_from("<H", data, 8)[0]
    tags = {struct.unpack_from("<H", data, 10 + 12 * i)[0]: struct.unpack_from("<HII", data, 12 + 12 * i) for i in range(n)}
    assert list(tags) == sorted(tags) and tags[256][2] == 4 and tags[257][2] == 3 and tags[259][2] & 0xFFFF == 8
    assert struct.unpack_from("<6d", data, tags[33922][2]) == (0, 0, 0, 10.0, 20.0, 0)
    strip = struct.unpack_from("<2I", data, tags[273][2])
    size = struct.unpack_from("<2I", data, tags[279][2])
    assert np.frombuffer(zlib.decompress(data[strip[1] : strip[1] + size[1]]), "<f8").tolist() == bands[1].ravel().tolist()
    assert 28992 in struct.unpack_from("<16H", data, tags[34735][2])
    with pytest.raises(ValueError):
        geotiff.decode(b"MM\0*" + data[4:])


def test_rasters_go_round(spark, tmp_path):
    path = str(tmp_path / "raster")
    r = np.random.default_rng(1)
    cells = {(int(a), int(b)) for a, b in r.integers(-20, 60, (700, 2))}
    rows = [(a, b, float(a * 100 + b), None if (a + b) % 5 == 0 else float(b)) for a, b in cells]
    df = spark.createDataFrame(rows, "row int, col int, z double, depth double").repartition(5)
    geotiff.write_raster(df.unionByName(df.limit(50)), GRID, ["z", "depth"], path, size=16)
    back = geotiff.read_raster(spark, path)
    assert back.dtypes == [("row", "int"), ("col", "int"), ("z", "double"), ("depth", "double")]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    part = back.where("row between 3 and 9 and col < 0")
    assert sorted(map(tuple, part.collect()), key=str) == sorted((x for x in rows if 3 <= x[0] <= 9 and x[1] < 0), key=str)
    reader = geotiff.TileReader({"path": path})
    list(reader.pushFilters([geotiff.GreaterThanOrEqual(("row",), 3), geotiff.LessThanOrEqual(("row",), 9), geotiff.LessThan(("col",), 0)]))
    asked = [t for p in reader.partitions() for t in p.files]
    assert {t[:2] for t in asked} == {(0, -1), (0, -2)} and len(reader.mosaic.tiles) == len([f for f in files(path) if f.endswith(".tif")])
    # appended tiles replace those of their place
    geotiff.write_raster(df.where("row >= 48").withColumn("z", F.lit(7.0)), GRID, ["z", "depth"], path, size=16, mode="append")
    got = {(x["row"], x["col"]): x["z"] for x in geotiff.read_raster(spark, path).collect()}
    assert got == {(a, b): 7.0 if a >= 48 else z for a, b, z, _ in rows}
    geotiff.write_raster(df.where("row = 0"), GRID, ["z"], path, size=16)
    assert geotiff.read_raster(spark, path).count() == sum(a == 0 for a, *_ in rows) and len({f.split("/")[0] for f in files(path)}) == 2
    with pytest.raises(Exception, match="another grid"):
        geotiff.write_raster(df, Grid(0.0, 0.0, 9.0), ["z"], path, size=16, mode="append")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "raster")
    df = spark.range(40).select((F.col("id") % 8).cast("int").alias("row"), F.col("id").cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    geotiff.write_raster(df, GRID, ["z"], path, size=4)
    before = files(path)
    bad = geotiff.tiles(df.repartition(4), GRID, ["z"], 4).withColumn("data", F.when(F.col("tile_col") == 7, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("hydro_geotiff").options(size=4, bands="z", x=1000.0, y=5000.0, pixel=0.5, nodata=-9999.0).mode("overwrite").save(path)
    assert files(path) == before and geotiff.read_raster(spark, path).count() == 40


def test_a_raster_without_pixels(spark, tmp_path):
    path = str(tmp_path / "raster")
    geotiff.write_raster(spark.createDataFrame([], "row int, col int, z double"), GRID, ["z"], path)
    assert geotiff.read_raster(spark, path).count() == 0


def test_geometries_by_their_bytes():
    point = struct.pack("<BIdd", 1, 1, 2.0, 3.0)
    assert wkb.parts_of(point)[0] == "point" and wkb.parts_of(point)[2][0][0][0, :2].tolist() == [2.0, 3.0]
    big = struct.pack(">BIIdddd", 0, 2, 2, 1.0, 2.0, 3.0, 4.0)
    assert wkb.parts_of(big)[2][0][0][:, :2].tolist() == [[1, 2], [3, 4]]
    srid = struct.pack("<BIIddd", 1, 1 | 0xA0000000, 28992, 1.0, 2.0, 9.0)
    kind, code, parts = wkb.parts_of(srid)
    assert (kind, code, parts[0][0].tolist()) == ("point", 28992, [[1, 2, 9]])
    measured = struct.pack("<BIdddd", 1, 3001, 1.0, 2.0, 9.0, 77.0)
    assert wkb.parts_of(measured)[2][0][0].tolist() == [[1, 2, 9]]
    packed = b"GP\0\x03" + struct.pack("<i", 4326) + b"\0" * 32 + point
    assert wkb.parts_of(packed)[:2] == ("point", 4326)
    empty = struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
    assert wkb.parts_of(empty) == ("point", None, [])
    for bad in (b"", b"\1", point[:-3], struct.pack("<BII", 1, 2, 2**31), struct.pack("<BII", 1, 7, 0), struct.pack("<BII", 1, 4, 1) + big):
        with pytest.raises((ValueError, KeyError, struct.error, IndexError)):
            wkb.parts_of(bad)


def test_geometries_go_round(spark):
    r = np.random.default_rng(3)
    ring = lambda n, z: [(float(a), float(b), float(c) if z else None) for a, b, c in r.integers(0, 9, (n, 3))]
    rows = []
    for i in range(60):
        kind, z = list(wkb.CODES)[i % 6], bool(i % 4 < 2)
        rings = {"point": [1], "line": [5]}.get(kind.removeprefix("multi"), [4, 3, 3])
        parts = [[ring(n, z) for n in rings[: 1 + int(r.integers(len(rings)))]] for _ in range(3 if kind.startswith("multi") else 1)]
        rows.append((i, kind, parts))
    rows += [(100, "multipolygon", []), (101, "line", []), (102, "point", []), (103, "circle", []), (104, "point", None)]
    df = spark.createDataFrame(rows, f"id int, kind string, parts {wkb.PARTS}").repartition(3)
    back = wkb.features(df.select("id", wkb.encode(F.col("kind"), F.col("parts")).alias("geom"))).collect()
    want = {i: (k, p) for i, k, p in rows}
    for x in back:
        kind, parts = want[x["id"]]
        got = None if x["parts"] is None else [[[tuple(p) for p in ring] for ring in part] for part in x["parts"]]
        assert (x["kind"], got) == ((None, None) if x["id"] > 102 else (kind, parts))
    junk = spark.createDataFrame([(1, b"no geometry"), (2, None)], "id int, geom binary")
    assert all(x["kind"] is None and x["parts"] is None for x in wkb.features(junk).collect())
    square = [[(0.0, 0.0, None), (4.0, 0.0, None), (4.0, 4.0, None), (0.0, 4.0, None), (0.0, 0.0, None)], [(1.0, 1.0, None), (1.0, 2.0, None), (2.0, 2.0, None), (2.0, 1.0, None)]]
    one = spark.createDataFrame([([square, square],)], f"parts {wkb.PARTS}")
    assert one.select(wkb.area(F.col("parts"))).first()[0] == 30.0 and len(one.select(wkb.exterior(F.col("parts"))).first()[0]) == 10


def test_means_do_not_depend_on_the_order_of_rows(spark):
    import itertools

    from hydroframe.sources.derived import exact_mean

    values = (4.66, 2.54, 52.8)  # added up in another order their mean is 19.999999999999996, that of the others 20.000000000000004
    orders = list(itertools.permutations(values)) + list(itertools.permutations((6.24, 45.71, 8.05)))
    rows = [(k, v) for k, one in enumerate(orders) for v in one]
    got = spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(exact_mean("v").alias("m"))
    assert {r["m"] for r in got.collect()} == {20.0}
    odd = spark.createDataFrame([(1, None), (2, 1.5), (2, float("inf")), (3, 1e30), (3, 3e30), (4, 2.0), (4, None), (5, 0.1)], "k int, v double")
    assert {r["k"]: r["m"] for r in odd.groupBy("k").agg(exact_mean("v").alias("m")).collect()} == {1: None, 2: float("inf"), 3: 2e30, 4: 2.0, 5: 0.1}


#: Three values of one entity and step, in the order of time.  Added up so, their means are 19.999999999999996, 20.000000000000004 and 25.000000000000004.
BUCKETS = {1: (39.4, 20.45, 0.15), 2: (40.49, 5.91, 13.6), 3: (49.78, 21.71, 3.51)}


@pytest.fixture(scope="module")
def ordered_events(tmp_path_factory):
    """Two folders with the same events: one file in the order of time, and three files out of it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    start = 1704067200
    rows = [(start + 43200 + 600 * k + user, user, values[k]) for k in range(3) for user, values in BUCKETS.items()]
    rows += [(start + t + user, user, 10.0 + user) for t in (64800, 86400) for user in range(6)]
    table = pa.table({"event_id": range(len(rows)), "ts": pa.array([r[0] * 1_000_000 for r in rows], pa.timestamp("us")), "user_id": [r[1] for r in rows], "value": [r[2] for r in rows]})
    whole, parts = tmp_path_factory.mktemp("whole"), tmp_path_factory.mktemp("parts")
    pq.write_table(table, whole / "events.parquet")
    (parts / "events.parquet").mkdir()
    for k in range(3):
        pq.write_table(table.take([i for i in reversed(range(len(rows))) if i * 7 % 3 == k]), parts / "events.parquet" / f"part-{k}.parquet")
    return str(whole), str(parts)


@pytest.mark.parametrize("name", ["s02_time_slice", "j02_series_of_line_ends", "a11_s1_above_thres_20_0", "a12_s1_below_thres_20_0", "a14_time_aggregate", "x02_time_aggregate"])
def test_sums_of_steps_go_in_the_order_of_time(spark, ordered_events, name):
    """To the last bit, as the SQL's on a file in that order, wherever the rows lie."""
    import duckdb

    from hydroframe.plans import QUERIES, SQL

    whole, parts = ordered_events
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{whole}/events.parquet'")
    want = c.sql(SQL[name])
    rows = sorted(map(repr, want.fetchall()))
    for folder in (whole, parts):
        assert sorted(repr(tuple(r[x] for x in want.columns)) for r in QUERIES[name](spark, folder).collect()) == rows


def test_a_sum_in_order_is_the_same_for_all_rows_wherever_they_lie(spark):
    import itertools

    from hydroframe.sources.derived import in_order

    values = (39.4, 20.45, None, 0.15)
    rows = [(k, i, values[i]) for k, order in enumerate(itertools.permutations(range(4))) for i in order]
    rows += [(100, 0, None), (101, 0, float("inf")), (101, 1, 1.0), (None, 0, 2.5)]
    for n in (1, 5):
        got = {r["k"]: (r["s1"], r["vol"]) for r in in_order(spark.createDataFrame(rows, "k int, i int, v double").repartition(n), ["k"], ["i"], "v").collect()}
        assert {got.pop(k) for k in range(24)} == {((39.4 + 20.45 + 0.15) / 3, 39.4 + 20.45 + 0.15)}
        assert got == {100: (None, None), 101: (float("inf"), float("inf")), None: (2.5, 2.5)}
