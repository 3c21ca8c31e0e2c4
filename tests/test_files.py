import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from loomwork.operators import media
from loomwork.sources import delimited, files
from loomwork.streaming import streams
from tests.conftest import rows


def test_admission_order(spark):
    limits = spark.createDataFrame([("img", 2, 100, ["image/png"], ["png"])], files.LIMITS)
    table = [("a", "ok.png", "image/png", 5), ("b", "x.png", None, 5), ("c", "x.png", "application/octet-stream", 5), ("d", "x.txt", "image/png", 500), ("e", "x.png", "text/html", 500), ("f", "x.PNG", "image/png", 101), ("g", "1.png", "", 1), ("g", "2.png", "", 1), ("g", "3.png", "", 1), ("h", "png", "", 1)]
    df = spark.createDataFrame([(b, "img", n, m, s) for b, n, m, s in table], "batch_id string, kind string, name string, mime string, size long")
    batches = spark.createDataFrame([(b, "img") for b in "abz"], "batch_id string, kind string")
    got = {(r.batch_id, r.name): r.reason for r in files.admit(df, limits, batches).collect()}
    assert got == {("a", "ok.png"): None, ("b", "x.png"): None, ("c", "x.png"): None, ("d", "x.txt"): "extension", ("e", "x.png"): "type", ("f", "x.PNG"): "size", ("g", "1.png"): "too_many", ("g", "2.png"): "too_many", ("g", "3.png"): "too_many", ("h", "png"): None, ("z", None): "no_files"}


def test_admission_of_odd_rows(spark):
    limits = spark.createDataFrame([("img", 2, 100, ["image/png"], ["png"]), ("any", None, None, None, None)], files.LIMITS)
    table = [(None, "img", "a.png", "", 5), (None, "img", "b.png", "", 5), (None, "img", "c.png", "", 5), ("x", "exe", "a.exe", "", 1 << 40), ("y", None, "a.png", "", 5), ("z", "img", None, "", 5), ("w", "img", "n.png", "", None),
             ("v", "any", "f.zzz", "a/b", 25 << 20), ("u", "any", "f.zzz", "a/b", (25 << 20) + 1), ("t", "any", "1", "", 1), ("t", "any", "2", "", 1)]
    df = spark.createDataFrame(table, "batch_id string, kind string, name string, mime string, size long")
    got = sorted(((r.batch_id, r.name, r.reason) for r in files.admit(df, limits).collect()), key=repr)
    want = [(None, "a.png", None), (None, "b.png", None), (None, "c.png", None), ("x", "a.exe", "kind"), ("y", "a.png", "kind"), ("z", None, "extension"), ("w", "n.png", "size"), ("v", "f.zzz", None), ("u", "f.zzz", "size"), ("t", "1", "too_many"), ("t", "2", "too_many")]
    assert got == sorted(want, key=repr)
    assert files.admit(df.where("false"), limits).count() == 0


def test_inventory_of_a_folder(spark, tmp_path):
    for name in ("a.TXT", "sub/b.tar.gz", "sub/plain"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = files.file_inventory(spark, str(tmp_path))
    assert found.columns == ["path", "name", "ext", "length", "mtime"]
    assert [(r.name, r.ext, r.length) for r in found.orderBy("name").collect()] == [("a.TXT", "txt", 5), ("b.tar.gz", "gz", 12), ("plain", "plain", 9)]
    assert {bytes(r.content) for r in files.file_inventory(spark, str(tmp_path), with_content=True).collect()} == {b"a.TXT", b"sub/b.tar.gz", b"sub/plain"}


def test_outputs_by_kind(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    table = [("json", 'n"1\\', '{ "b" : 1 , "a" : "x y\\n" }'), ("json", "bad", "{"), ("csv", "n,2", 'a,"b"\r\nc\n'), ("text", None, "two\nlines\r"), ("text", "", None), ("exe", "x", "y"), (None, "x", "y"), ("json", "none", None)]
    df = spark.createDataFrame(table, "kind string, name string, body string")
    first = {r.kind: (r.mime, r.files, r.bytes, r.rejected) for r in files.write_outputs(df, path).collect()}
    assert first == {"json": ("application/json", 1, 19, 2), "csv": ("text/csv", 1, 9, 0), "text": ("text/plain", 2, 10, 0), None: (None, 0, 0, 2)}
    want = sorted([("json", 'n"1\\', '{"b":1,"a":"x y\\n"}'), ("csv", "n,2", 'a,"b"\r\nc\n'), ("text", "", "two\nlines\r"), ("text", "", "")])
    assert rows(files.read_outputs(spark, path)) == want
    # a run that has not written its manifest is not seen, and one that is repeated leaves one result
    (tmp_path / "out/runs/broken/kind=text").mkdir(parents=True)
    (tmp_path / "out/runs/broken/kind=text/part-0").write_text("half,an out")
    assert rows(files.read_outputs(spark, path)) == want
    files.write_outputs(df, path)
    assert rows(files.read_outputs(spark, path)) == want
    files.write_outputs(df.where("kind = 'csv'"), path)
    assert files.read_outputs(spark, path).count() == 1
    files.write_outputs(df.where("false"), path)
    assert files.read_outputs(spark, path).count() == 0


def plainly_read(text):
    """Rows of cells by what stands between quotes: every second part is quoted text, and an empty part between two of those is
    what is left of a doubled quote."""
    parts = text.split('"')
    table = [[""]]
    for i, part in enumerate(parts):
        if i % 2:
            table[-1][-1] += part
        elif part == "" and 0 < i < len(parts) - 1:
            table[-1][-1] += '"'
        else:
            for n, line in enumerate(re.split("\r\n|\r|\n", part)):
                if n:
                    table.append([""])
                first, *more = line.split(",")
                table[-1][-1] += first
                table[-1] += more
    return table


@pytest.mark.parametrize("split", ["24", "128m"])
def test_large_files_are_read_in_splits(spark, tmp_path, split):
    """Quoted line ends at any place of a split, with splits of a few bytes."""
    rng, before = random.Random(7), {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    parts = ["a", "bb", "é", '"', '""', ",", ",", "\n", "\n", "\r\n", '"x,y"', '"l\n2"', '"q""q"', " ", 'x"y,z"w', "\r"]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for n in (8, 90, 700):
            text = "h1,H1,h`3\n" + "".join(rng.choice(parts) for _ in range(n)) + "z"
            (tmp_path / f"{n}.csv").write_bytes(text.encode())
            df = delimited.read_delimited(spark, str(tmp_path / f"{n}.csv"))
            assert df.columns == ["h1", "H1", "h`3"]
            want = sorted(tuple((r + [""] * 3)[:3]) for r in plainly_read(text)[1:] if any(r[:3]))
            assert sorted(tuple(r) for r in df.collect()) == want
        if split == "24":
            assert spark.read.text(str(tmp_path / "700.csv")).rdd.getNumPartitions() > 20
        # a header of several lines that runs over splits, and several files with their own headers
        for name in ("one", "two"):
            (tmp_path / "many").mkdir(exist_ok=True)
            (tmp_path / "many" / name).write_text(f'"a long header\n\nof lines that go on",b,B\n{name},"1\n",2\n')
        df = delimited.read_delimited(spark, str(tmp_path / "many"), raw_names=False)
        assert df.columns == ["a long header\n\nof lines that go on", "b", "B_2"] and rows(df) == [("one", "1\n", "2"), ("two", "1\n", "2")]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_safe_names(spark):
    names = ["../up/My file?.pdf", "noext", "x" * 100 + ".txt", "???", None, ".hidden"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.safe_name(F.col("n"))).collect()] == ["My-file", "noext", "x" * 80, "file", "file", "file"]


def test_headers():
    assert delimited.header_names(["a", "a_2", "a", "", None, " b "]) == ["a", "a_2", "a_3", "column_4", "column_5", "b"]


def test_delimited_round_trip(spark, tmp_path):
    text = 'a,a_2,a,,\n"x,1","say ""hi""","two\nlines",,\nshort\n,,,,\n1,2,3,4,5,6\n'
    (tmp_path / "t.csv").write_text(text)
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "a_2", "a_3", "column_4", "column_5"]
    assert rows(df) == [("1", "2", "3", "4", "5"), ("short", "", "", "", ""), ("x,1", 'say "hi"', "two\nlines", "", "")]
    header = delimited.write_delimited(df, str(tmp_path / "out"), df.columns)
    assert header == "a,a_2,a_3,column_4,column_5"
    again = delimited.read_delimited(spark, str(tmp_path / "out/rows"), header_path=str(tmp_path / "out/header"))
    assert rows(again) == rows(df)
    (tmp_path / "repeats.csv").write_text("a,b,c\na,b,c\nshort\n1,2,3\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "repeats.csv"))) == [("1", "2", "3"), ("a", "b", "c"), ("short", "", "")]
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "body.csv").write_text("short\n1,2,3,9\n4,5,6\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "body.csv"), header_path=str(tmp_path / "head.csv"))) == [("1", "2", "3"), ("4", "5", "6"), ("short", "", "")]
    (tmp_path / "one.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "one.csv"))


def exif() -> bytes:
    """A little-endian TIFF block with a make, a model and a position of 12 34 N, 56 7 E."""
    make, model = b"Acme\0", b"Cam 1\0"
    gps_at, data_at = 8 + 2 + 12 * 3 + 4, 8 + 2 + 12 * 3 + 4 + 2 + 12 * 4 + 4
    lat, lon = data_at + 12, data_at + 36
    ifd = struct.pack("<H", 3) + struct.pack("<HHII", 0x010F, 2, 5, data_at) + struct.pack("<HHII", 0x0110, 2, 6, data_at + 5) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + b"\0" * 4
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, lat) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, lon) + b"\0" * 4
    pairs = struct.pack("<6I", 12, 1, 34, 1, 0, 0) + struct.pack("<6I", 56, 1, 7, 1, 30, 2)
    return b"II*\0" + struct.pack("<I", 8) + ifd + gps + (make + model).ljust(12, b"\0") + pairs


def jpeg() -> bytes:
    body = b"Exif\0\0" + exif()
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_media(spark):
    chunk = b"Comment\0hi"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(chunk)) + b"tEXt" + chunk + b"\0" * 4 + struct.pack(">I", 0) + b"IEND" + b"\0" * 4
    xmp = b"<x:xmp/>"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + len(xmp)) + b"WEBPXMP " + struct.pack("<I", len(xmp)) + xmp
    table = [("a.jpg", jpeg()), ("b.png", png), ("c.webp", webp), ("d.jpg", jpeg()[:60]), ("e.txt", b"hello"), ("f", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in table], "path string, content binary")
    items = media.image_metadata_items(df).cache()
    assert {(r.label, r.value) for r in items.where("path = 'a.jpg' and label in ('Camera make', 'Camera model')").collect()} == {("Camera make", "Acme"), ("Camera model", "Cam 1")}
    flags = {r.path: r for r in media.privacy_flags(df, items).collect()}
    assert flags["a.jpg"].has_gps and flags["a.jpg"].has_camera and flags["b.png"].has_png_text and flags["c.webp"].has_xmp and flags["c.webp"].has_webp
    assert flags["e.txt"].metadata_count == 0 and flags["f"].warnings == 2 and len(flags) == 6 and flags["d.jpg"].has_exif
    assert flags["a.jpg"].metadata_count == items.where("path = 'a.jpg' and grp <> 'warning'").count() + 1
    more = media.with_coordinates(items)
    assert [(r.path, r.value) for r in more.where("label = 'Decimal coordinates'").collect()] == [("a.jpg", "-12.566667, 56.120833")]
    assert {r.path: r.metadata_count for r in media.privacy_flags(df, more).collect()} == {p: r.metadata_count for p, r in flags.items()}
    # the seconds of the latitude have denominator 0 and count as 0
    assert [tuple(r) for r in media.gps_points(items).collect()] == [("a.jpg", -12.566667, 56.120833)]
    sniffed = files.sniff_format(df.select(F.col("path").alias("name"), F.lit("image/png").alias("mime"), "content"))
    assert {r.name: (r.format, r.mismatch) for r in sniffed.collect()} == {"a.jpg": ("JPEG", False), "b.png": ("PNG", False), "c.webp": ("WebP", False), "d.jpg": ("JPEG", False), "e.txt": ("PNG", True), "f": ("PNG", True)}


def test_grid_at_poles_and_date_line(spark):
    made = [(0.0, 0.0), (0.5, 0.5), (-0.1, -0.1), (90.0, 77.0), (90.0, -3.0), (89.5, -180.0), (-90.0, 12.0), (10.0, 180.0), (10.0, -180.0), (10.0, 190.0), (10.0, 539.0), (None, 1.0), (1.0, None), (91.0, 0.0), (1.0, float("nan")), (1.0, float("inf"))]
    points = spark.createDataFrame([(str(i), *p) for i, p in enumerate(made)], "path string, lat double, lon double")
    got = {(r.side, r.south, r.west): r.files for r in media.gps_grid(points, (10, 1)).collect()}
    small = {k[1:]: n for k, n in got.items() if k[0] == 1}
    assert small == {(0, 0): 2, (-1, -1): 1, (89, -180): 3, (-90, -180): 1, (10, -180): 2, (10, -170): 1, (10, 179): 1}
    large = {k[1:]: n for k, n in got.items() if k[0] == 10}
    assert large == {(0, 0): 2, (-10, -10): 1, (80, -180): 3, (-90, -180): 1, (10, -180): 2, (10, -170): 1, (10, 170): 1}
    assert got[0, None, None] == 5 and media.gps_grid(points.where("false")).count() == 0


def test_exif_display(spark):
    made = [("Exposure time", 1, 250, "1/250 sec"), ("Exposure time", 2, 1, "2 (2/1)"), ("F number", 14142, 10000, "f/1.41"), ("Max aperture", 3, 1, "f/3"), ("Focal length", 50, 1, "50 mm"), ("Altitude", 5, 2, "2.5 (5/2)"), ("Altitude", 5, 0, "0 (5/0)"), ("Exposure bias", -1, 3, "-0.33 (-1/3)")]
    df = spark.createDataFrame([(str(i), lab, f"{n}/{d}", [n], [d]) for i, (lab, n, d, _) in enumerate(made)], "path string, label string, value string, num array<long>, den array<long>")
    assert [r.display for r in media.format_exif(df).orderBy("path").collect()] == [m[3] for m in made]


def test_media_of_damaged_and_odd_files():
    items = lambda data, name="x.jpg": [r[1:4] for r in media.walk(data, name)]
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0)
    block = b"Exif\0\0" + tiff
    oriented = b"\xff\xd8\xff\xff\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"
    assert items(oriented) == [("container", "EXIF", "JPEG APP1 EXIF block"), ("EXIF image", "Orientation", "6")]
    broken = oriented[:-2].replace(b"MM\0*", b"MM\0!") + b"\xff\xe2\0\4ic\xff\xd9"
    assert [r[1] for r in items(broken)] == ["EXIF", "ICC profile"]
    chunk = struct.pack(">I", 4) + b"tEXtk\0ab" + b"\0" * 4
    assert len([r for r in items(b"\x89PNG\r\n\x1a\n" + chunk * 100, "p") if r[0] == "PNG tEXt"]) == 100
    assert [r[2] for r in items(b"nothing", "x.bin")] == [media.UNSUPPORTED, media.NOTHING_FOUND] and [r[2] for r in items(None)] == [media.NOTHING_FOUND]
    itxt = b"Title\0\0\0en\0Titel\0caf\xc3\xa9"
    assert items(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(itxt)) + b"iTXt" + itxt + b"\0" * 4, "p")[1] == ("PNG iTXt", "Title", "caf\u00e9")


def test_stream_admit_splits_all_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("a.txt", 3), ("b.bin", 3), ("c.txt", 50)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    limits = spark.createDataFrame([("up", 10, 20, [], ["txt"])], files.LIMITS)
    streams.stream_admit(spark, str(tmp_path / "in"), limits, "up", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    read = lambda side: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / side))
    assert [r.name for r in read("ok").collect()] == ["a.txt"]
    assert {(r.name, r.reason) for r in read("rejected").collect()} == {("b.bin", "extension"), ("c.txt", "size")}


def unsorted_before_the_shuffle(df):
    """Whether the rows that come in are neither sorted nor aggregated before they are dealt out by file."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning(path") :]
    return "Sort" not in first and "Aggregate" not in first


def test_devices_of_items_in_many_parts(spark):
    """Items of a file lie apart; a task does not sort all it is given."""
    image, gps = "EXIF image", "EXIF GPS location"
    made = [(f"{i}.jpg", image, "Camera make", f"make {i % 2}") for i in range(40)] + [(f"{i}.jpg", image, "Software", "Loo") for i in range(0, 40, 4)] + [(f"{i}.jpg", gps, None, None) for i in range(0, 40, 2)]
    made += [("0.jpg", image, "Camera make", "a smaller text"), ("only.jpg", gps, "Latitude", "1/1"), ("soft.jpg", image, "Software", "Loo"), ("none.jpg", None, "Camera make", "x"), ("cam.jpg", "EXIF camera", "Camera model", "x")]
    got = media.device_summary(spark.createDataFrame(made, "path string, grp string, label string, value string").repartition(7))
    assert rows(got, "make", "software") == [("make 0", None, None, 10, 10), ("make 0", None, "Loo", 10, 10), ("make 1", None, None, 20, 0)]
    assert unsorted_before_the_shuffle(got)


def test_positions_of_items_in_many_parts(spark):
    gps = "EXIF GPS location"
    made = [(f"{i}.jpg", gps, label, value, num, [1, 1, 1] if num else None) for i in range(30) for label, value, num in (("Latitude", "n/d", [i, 30, 0]), ("Longitude", "n/d", [i, 0, 36]), ("Latitude ref", "sS"[i % 2], None), ("Altitude", "n/d", [1, 1, 1]))]
    made += [("3.jpg", gps, "Latitude", "n/d", [2, 59, 0], [1, 1, 1]), ("3.jpg", gps, "Longitude ref", "W", None, None), ("half.jpg", gps, "Latitude", "n/d", [2, 59, 0], [1, 1, 1]), ("4.jpg", "EXIF image", "Latitude", "n/d", [90, 0, 0], [1, 1, 1])]
    got = media.gps_points(spark.createDataFrame(made, "path string, grp string, label string, value string, num array<long>, den array<long>").repartition(7))
    assert rows(got) == sorted((f"{i}.jpg", -(i + 0.5), (i + 0.01) * (-1 if i == 3 else 1)) for i in range(30))
    assert unsorted_before_the_shuffle(got)
