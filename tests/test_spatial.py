import sqlite3
import struct

from herdbook.sources import spatial

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]


def shp(polygons):
    out = b"\0" * 100
    for i, rings in enumerate(polygons):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 4, 4, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if rings else struct.pack("<i", 0)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return out


def dbf(names):
    head = struct.pack("<4xIHH20x", len(names), 65, 11) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    return head + b"".join(b" " + n.encode().ljust(10) for n in names)


def plain(rings):
    return [[(q["x"], q["y"]) for q in r] for r in rings]


def test_shapefiles_with_attributes(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([[SQUARE, HOLE], [], [HOLE]]))
    (tmp_path / "a.dbf").write_bytes(dbf(["Bern", "", "Uri"]))
    (tmp_path / "b.shp").write_bytes(shp([[SQUARE]]))
    rows = sorted(spatial.shapefile(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.feature_no))
    assert [(r.path[-1], r.feature_no, dict(r.attributes), plain(r.rings)) for r in rows] == [
        ("a", 0, {"NAME": "Bern"}, [SQUARE, HOLE]), ("a", 1, {}, []), ("a", 2, {"NAME": "Uri"}, [HOLE]), ("b", 0, {}, [SQUARE])]


def test_geopackage_layers(spark, tmp_path):
    poly = lambda *rings: struct.pack("<b2I", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    multi = struct.pack("<b2I", 1, 6, 2) + poly(SQUARE) + poly(HOLE)
    header = b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 4, 0, 4)
    con = sqlite3.connect(tmp_path / "g.gpkg")
    con.execute("CREATE TABLE grid (fid INTEGER, geom BLOB, name TEXT)")
    con.executemany("INSERT INTO grid VALUES (?, ?, ?)", [(1, header + poly(SQUARE, HOLE), "x"), (2, header + multi, None), (3, None, "y")])
    con.commit()
    con.close()
    rows = sorted(spatial.geopackage(spark, str(tmp_path), "grid").collect(), key=lambda r: r.feature_no)
    assert [(dict(r.attributes), plain(r.rings)) for r in rows] == [({"fid": "1", "name": "x"}, [SQUARE, HOLE]), ({"fid": "2"}, [SQUARE, HOLE]), ({"fid": "3", "name": "y"}, [])]


def test_ascii_grids_and_rasters(spark, tmp_path):
    (tmp_path / "pop.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 50\ncellsize 0.5\nNODATA_value -1\n1 2 -1\n4.5 -1 6\n")
    got = {(r.row, r.col): (r.x, r.y, r.value) for r in spatial.ascii_grid(spark, str(tmp_path / "pop.asc")).collect()}
    assert got == {(0, 0): (10.25, 50.75, 1.0), (0, 1): (10.75, 50.75, 2.0), (1, 0): (10.25, 50.25, 4.5), (1, 2): (11.25, 50.25, 6.0)}
    spatial.ascii_grid(spark, str(tmp_path / "pop.asc")).write.parquet(str(tmp_path / "long"))
    assert spatial.raster(spark, str(tmp_path / "long"), nodata=2.0).count() == 3


def test_cells_in_two_systems(spark, tmp_path):
    c = spark.createDataFrame([("CHE_1", 4_321_000.0, 3_210_000.0)], "cell_id string, x0 double, y0 double")
    spatial.write_cells(c, str(tmp_path / "grid"))
    assert spatial.cells(spark, str(tmp_path / "grid")).count() == 1
    ring = spatial.cells(spark, str(tmp_path / "grid"), "degrees").first().rings[0]
    assert abs(ring[0].x - 10) < 1e-6 and abs(ring[0].y - 52) < 1e-6 and len(ring) == 4 and ring[2].x > 10.1 and ring[2].y > 52.08
