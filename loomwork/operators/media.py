"""Metadata embedded in image files: one leaf that walks bytes, and reports over its rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js_compat as js
from ..functions import json_text

ITEMS = "path string, container string, grp string, label string, value string, num array<long>, den array<long>, sensitive boolean"
#: Rows of these groups are no items: what a file holds, and what is to be said of it.
CONTAINER, WARNING = "container", "warning"
# fixed values: limits of a report, sizes of value types, and the names of tags
MOST_VALUES, MOST_ITEMS = 1024, 80
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
IMAGE_TAGS = {
    0x010E: "Image description", 0x010F: "Camera make", 0x0110: "Camera model", 0x0112: "Orientation", 0x011A: "X resolution", 0x011B: "Y resolution",
    0x0128: "Resolution unit", 0x0131: "Software", 0x0132: "Modified date", 0x013B: "Artist", 0x8298: "Copyright",
}
CAMERA_TAGS = {
    0x829A: "Exposure time", 0x829D: "F number", 0x8822: "Exposure program", 0x8827: "ISO speed", 0x9000: "EXIF version", 0x9003: "Original date", 0x9004: "Digitized date",
    0x9201: "Shutter speed", 0x9202: "Aperture", 0x9203: "Brightness", 0x9204: "Exposure bias", 0x9205: "Max aperture", 0x9207: "Metering mode", 0x9209: "Flash",
    0x920A: "Focal length", 0xA001: "Color space", 0xA002: "Pixel width", 0xA003: "Pixel height", 0xA405: "Focal length in 35mm", 0xA430: "Camera owner",
    0xA431: "Camera serial number", 0xA432: "Lens specification", 0xA433: "Lens make", 0xA434: "Lens model", 0xA435: "Lens serial number",
}
GPS_TAGS = {
    0: "GPS version", 1: "Latitude ref", 2: "Latitude", 3: "Longitude ref", 4: "Longitude", 5: "Altitude ref", 6: "Altitude", 7: "GPS timestamp", 13: "Speed ref", 14: "Speed",
    16: "Image direction ref", 17: "Image direction", 29: "GPS date",
}
CAMERA_AT, GPS_AT = 0x8769, 0x8825
GPS_FOUND = "GPS/location metadata detected. Review before sharing this image."
NOTHING_FOUND = "No embedded metadata was detected by the local parser for this format."
UNSUPPORTED = "Unsupported image container for metadata inspection."
# fixed values: labels and names of the properties that are looked for in an XMP packet: plain ones, and lists
XMP_PLAIN = {
    "Creator tool": "xmp:CreatorTool", "Create date": "xmp:CreateDate", "Modify date": "xmp:ModifyDate", "Metadata date": "xmp:MetadataDate", "Camera make": "tiff:Make", "Camera model": "tiff:Model",
}
XMP_LISTS = {"Author": "dc:creator", "Description": "dc:description"}
#: A plain property is an attribute, with its value in quotes of either kind; of a list the first entry counts.
XMP_FIELDS = [(label, rf"""{name}\s*=\s*["']([^"']+)""") for label, name in XMP_PLAIN.items()] + [(label, rf"<{name}\b[^>]*>.*?<rdf:li\b[^>]*>([^<]+)") for label, name in XMP_LISTS.items()]
SPACES = "\t\n\v\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
CONTROL = re.compile("[\x00-\x1f\x7f]")

#: (container, group, label, value, numerators, denominators, sensitive)
Row = tuple


def _clean(raw: bytes) -> str:
    return CONTROL.sub(" ", raw.decode("utf-8-sig", "replace").rstrip("\0")).strip(SPACES)


def _row(grp: str, label: str, value: str, container: str | None = None, num: list | None = None, den: list | None = None) -> Row:
    return container, grp, label, value, num, den, grp == "EXIF GPS location"


class Tiff:
    """Directories of a TIFF block. What is cut off or unknown is left out; it never fails."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "little", b"MM": "big"}.get(data[:2])
        if len(data) < 8 or self.order and self.number(2, 2) != 42:
            self.order = None

    def number(self, at: int, size: int, signed: bool = False) -> int:
        return int.from_bytes(self.data[at : at + size], self.order, signed=signed) if at + size <= len(self.data) else 0

    def value(self, at: int, kind: int, count: int) -> tuple[str, list | None, list | None]:
        size = TYPE_SIZE.get(kind, 0) * count
        where = at if size <= 4 else self.number(at, 4)
        if not size or count > MOST_VALUES or where + size > len(self.data):
            return "", None, None
        raw = self.data[where : where + size]
        if kind == 2 or kind == 7 and count <= 16 and _clean(raw):
            return _clean(raw), None, None
        if kind == 7 and count <= 16:
            return ".".join(map(str, raw)), None, None
        width = TYPE_SIZE[kind] if kind not in (5, 10) else 4
        parts = [self.number(where + i, width, kind in (9, 10)) for i in range(0, size, width)]
        num, den = (parts[::2], parts[1::2]) if kind in (5, 10) else (parts, [1] * count)
        return ", ".join(f"{n}/{d}" for n, d in zip(num, den)) if kind in (5, 10) else ", ".join(map(str, num)), num, den

    def directory(self, at: int, names: dict[int, str], grp: str) -> tuple[list[Row], dict[int, tuple]]:
        """Items of the directory at ``at`` and every tag's value."""
        rows, found = [], {}
        for entry in range(at + 2, at + 2 + 12 * self.number(at, 2), 12) if 0 < at <= len(self.data) - 2 else ():
            if entry + 12 > len(self.data):
                break
            tag = self.number(entry, 2)
            text, num, den = self.value(entry + 8, self.number(entry + 2, 2), self.number(entry + 4, 4))
            found[tag] = text, num, den
            if text and not (names is IMAGE_TAGS and tag in (CAMERA_AT, GPS_AT)):
                rows.append(_row(grp, names.get(tag, f"Tag 0x{tag:04x}"), text, num=num, den=den))
        return rows[:MOST_ITEMS], found

    def rows(self) -> Iterator[Row]:
        if self.order is None:
            return
        rows, found = self.directory(self.number(4, 4), IMAGE_TAGS, "EXIF image")
        yield from rows
        below = lambda tag: found[tag][1][0] if found.get(tag, ("", None))[1] else 0
        yield from self.directory(below(CAMERA_AT), CAMERA_TAGS, "EXIF camera")[0]
        rows, _ = self.directory(below(GPS_AT), GPS_TAGS, "EXIF GPS location")
        yield from rows
        if rows:
            yield _row(WARNING, WARNING, GPS_FOUND)


def _exif(kind: str, block: bytes) -> Iterator[Row]:
    yield _row(CONTAINER, "EXIF", kind, "EXIF")
    yield from Tiff(block).rows()


def _xmp(kind: str, packet: bytes) -> Iterator[Row]:
    yield _row(CONTAINER, "XMP", kind, "XMP")
    yield _row("XMP", "XMP packet", packet.decode("utf-8-sig", "replace").replace("\0", "").strip(SPACES))


def _jpeg(data: bytes) -> Iterator[Row]:
    at = 2
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0:
            return
        while at < len(data) and data[at] == 0xFF:  # any number of fill bytes
            at += 1
        marker = data[at] if at < len(data) else 0xD9
        at += 1
        if marker in (0xD9, 0xDA):
            return
        if 0xD0 <= marker <= 0xD7:
            continue
        end = min(at + int.from_bytes(data[at : at + 2], "big"), len(data))
        body = data[at + 2 : end]
        if not body:
            return
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            yield from _exif("JPEG APP1 EXIF block", body[6:])
        elif marker == 0xE1 and body[:28] == b"http://ns.adobe.com/xap/1.0/":
            yield from _xmp("JPEG APP1 XMP block", body[29:])
        elif marker == 0xE2:
            yield _row(CONTAINER, "ICC profile", "JPEG APP2 color profile", "ICC profile")
        elif marker == 0xED:
            yield _row(CONTAINER, "Photoshop/IPTC", "JPEG APP13 metadata block", "Photoshop/IPTC")
        elif 0xE0 <= marker <= 0xEF:
            yield _row(CONTAINER, f"APP{marker - 0xE0}", f"JPEG application segment 0x{marker:x}", f"APP{marker - 0xE0}")
        at = end


def _png_text(kind: str, body: bytes) -> Iterator[Row]:
    name, _, rest = body.partition(b"\0")
    if not (label := _clean(name)):
        return
    if kind == "iTXt" and rest[:1] not in (b"", b"\0"):
        value = "Compressed international text present."
    else:  # of international text, two flags, a language and a translated name come first
        value = _clean(rest[2:].split(b"\0", 2)[-1] if kind == "iTXt" and rest[2:].count(b"\0") >= 2 else b"" if kind == "iTXt" else rest)
    yield _row(f"PNG {kind}", label, value or "Present")


PNG_TEXT = {"tEXt": "PNG text", "iTXt": "PNG international text", "zTXt": "PNG compressed text"}


def _png(data: bytes) -> Iterator[Row]:
    at = 8
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            return
        if kind in PNG_TEXT:
            yield _row(CONTAINER, PNG_TEXT[kind], f"{kind} chunk", PNG_TEXT[kind])
            if kind == "zTXt":
                yield _row("PNG zTXt", "Compressed text chunk", "Present. Browser preview does not decompress this field yet.")
            else:
                yield from _png_text(kind, body)
        elif kind == "eXIf":
            yield from _exif("PNG eXIf chunk", body)
        elif kind == "iCCP":
            yield _row(CONTAINER, "ICC profile", "PNG iCCP chunk", "ICC profile")
            yield _row("Color profile", "ICC profile", _clean(body.partition(b"\0")[0]) or "Present")
        elif kind == "pHYs":
            yield _row(CONTAINER, "Pixel density", "PNG pHYs chunk", "Pixel density")
            if len(body) >= 9:
                for label, n in (("Pixels per unit X", body[:4]), ("Pixels per unit Y", body[4:8])):
                    yield _row("PNG density", label, str(int.from_bytes(n, "big")))
                yield _row("PNG density", "Unit", "Meter" if body[8] == 1 else "Unknown")
        elif kind == "tIME":
            yield _row(CONTAINER, "Timestamp", "PNG tIME chunk", "Timestamp")
        at += 12 + size


def _webp(data: bytes) -> Iterator[Row]:
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"EXIF":
            yield from _exif("WebP EXIF chunk", body)
        elif kind == b"XMP ":
            yield from _xmp("WebP XMP chunk", body)
        elif kind == b"ICCP":
            yield _row(CONTAINER, "ICC profile", "WebP ICCP chunk", "ICC profile")
        elif kind == b"VP8X" and len(body) >= 10:
            for label, bit in (("ICC profile flag", 0x20), ("EXIF flag", 0x08), ("XMP flag", 0x04)):
                yield _row("WebP container", label, "Present" if body[0] & bit else "Not set")
        at += 8 + len(body) + size % 2


def _walker(data: bytes, name: str, mime: str) -> Callable | None:
    """How to walk the file: by its first bytes, else its MIME type or name."""
    if data[:2] == b"\xff\xd8":
        return _jpeg
    if data[:4] == b"\x89PNG":
        return _png
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp
    for walker, kind, ends in ((_jpeg, "jpeg", (".jpg", ".jpeg")), (_png, "png", (".png",)), (_webp, "webp", (".webp",))):
        if kind in mime.lower() or name.lower().endswith(ends):
            return walker
    return None


def walk(content: bytes | None, name: str = "", mime: str = "") -> list[Row]:
    """All rows of one file, with a warning where there is no metadata. Of XMP the whole packet."""
    data = bytes(content or b"")
    walker = _walker(data, name or "", mime or "")
    rows = list(walker(data)) if walker else [_row(WARNING, WARNING, UNSUPPORTED)]
    return rows if any(r[1] != WARNING for r in rows) else [*rows, _row(WARNING, WARNING, NOTHING_FOUND)]


def image_metadata_items(files: DataFrame) -> DataFrame:
    """A row for each metadata item, container and warning of (path, content and, if there, mime).

    Containers have the group ``container`` and their detail as value. Damaged files give what was read, files without metadata
    or of another format warnings; null content counts as empty. Rationals have their numerators and denominators.
    """
    mime = F.col("mime") if "mime" in files.columns else F.lit("")

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), *[pa.string()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
        names = [part.split()[0] for part in ITEMS.split(", ")]
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            rows = []
            for at in range(batch.num_rows):  # one file's bytes at a time
                path, content, kind = (batch.column(c)[at].as_py() for c in ("path", "content", "mime"))
                rows += [(path, *r) for r in walk(content, path, kind)]
                if len(rows) >= 4096:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    read = files.select("path", "content", mime.alias("mime")).mapInArrow(leaf, ITEMS)
    packet = F.struct(F.lit("XMP packet").alias("label"), F.lit("Present").alias("value"))
    fields = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), js.trim(F.regexp_extract("value", f"(?is){pattern}", 1)).alias("value")) for label, pattern in XMP_FIELDS)), lambda f: f["value"] != "")
    known = F.when(F.col("grp") != "XMP", F.array(F.struct("label", "value"))).when(F.size(fields) > 0, fields).otherwise(F.array(packet))
    return read.withColumn("item", F.explode(known)).select("path", "container", "grp", "item.label", "item.value", "num", "den", "sensitive")


def privacy_flags(files: DataFrame, items: DataFrame) -> DataFrame:
    """path, flags, metadata_count (items, containers, and the decimal coordinates of a position) and warnings for every file, with or
    without items."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    group, label, holds = F.col("grp"), F.col("label"), F.when(F.col("grp") == CONTAINER, F.col("container"))
    placed = has((label == "Latitude") & (F.size("num") >= 3)) & has((label == "Longitude") & (F.size("num") >= 3)) & ~has(label == "Decimal coordinates")
    flags = items.groupBy("path").agg(
        has(holds == "EXIF").alias("has_exif"), has(group == "EXIF GPS location").alias("has_gps"),
        has((group == "EXIF camera") | (group == "EXIF image") & label.isin("Camera make", "Camera model")).alias("has_camera"), has((group == "EXIF image") & (label == "Software")).alias("has_software"),
        has(holds == "XMP").alias("has_xmp"), has(holds == "ICC profile").alias("has_icc"), has(holds.isin(*PNG_TEXT.values())).alias("has_png_text"),
        has((group == CONTAINER) & F.col("value").startswith("WebP")).alias("has_webp"), F.count_if(group != WARNING).alias("metadata_count"), F.count_if(group == WARNING).alias("warnings"), placed.alias("placed"),
    )
    flags = flags.withColumn("metadata_count", F.col("metadata_count") + F.col("placed").cast("long")).drop("placed")
    joined = files.select("path").join(flags, "path", "left")
    return joined.select("path", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in flags.dtypes if c != "path"))


def _by_file(held: DataFrame) -> DataFrame:
    """The rows dealt out by file. Texts and arrays are aggregated by sorting: without this all rows of an input task would be
    sorted before the shuffle, and a small file of items holds many."""
    return held.repartition("path")


def gps_points(items: DataFrame) -> DataFrame:
    """path, lat and lon in degrees to six places; a denominator of 0 counts as 0."""
    label, axes = F.col("label"), ("Latitude", "Longitude")
    refs = [f"{a} ref" for a in axes]
    held = items.where((F.col("grp") == "EXIF GPS location") & label.isin(*axes, *refs))
    ref = label.isin(*refs)
    held = _by_file(held.select("path", "label", F.when(ref, F.col("value")).alias("value"), *(F.when(~ref, F.col(c)).alias(c) for c in ("num", "den"))))
    value = lambda name, c: F.max(F.when(label == name, F.col(c)))
    gathered = held.groupBy("path").agg(*(value(a, c).alias(f"{a}_{c}") for a in axes for c in ("num", "den")), *(value(f"{a} ref", "value").alias(f"{a}_ref") for a in axes))

    def degrees(axis: str) -> Column:
        part = lambda i: F.coalesce(F.try_divide(F.get(f"{axis}_num", F.lit(i)), F.get(f"{axis}_den", F.lit(i))), F.lit(0.0))
        sign = F.when(F.upper(js.trim(F.col(f"{axis}_ref"))).isin("S", "W"), -1).otherwise(1)
        return F.round(sign * (part(0) + part(1) / 60 + part(2) / 3600), 6)

    whole = gathered.where("size(Latitude_num) >= 3 and size(Longitude_num) >= 3")
    return whole.select("path", degrees("Latitude").alias("lat"), degrees("Longitude").alias("lon"))


def with_coordinates(items: DataFrame) -> DataFrame:
    """The items, and for each file with a position an item of its coordinates in decimal degrees, which counts as one more."""
    plain = lambda c: json_text.js_number(F.col(c).cast("string"))
    texts = {"grp": F.lit("EXIF GPS location"), "label": F.lit("Decimal coordinates"), "value": F.concat_ws(", ", plain("lat"), plain("lon")), "sensitive": F.lit(True)}
    points = gps_points(items).select("path", *(v.alias(k) for k, v in texts.items() if k in items.columns))
    return items.unionByName(points, allowMissingColumns=True)


#: Sides of grid cells in degrees, each a multiple of the next.
GRID = (30, 10, 1)


def gps_grid(points: DataFrame, sides: Sequence[int] = GRID) -> DataFrame:
    """side, south, west and files of the cells that hold points (path, lat, lon), for each of ``sides``, from one aggregation.

    A cell takes in its southern and western edges, and at the North Pole its northern one. Longitudes run on over the date line,
    so 180 is -180; all of a pole is the point at -180. Points without a latitude from -90 to 90 or without a longitude are in a
    cell of their own, side 0 without edges.
    """
    known = F.col("lat").between(-90, 90) & F.col("lon").isNotNull() & ~F.isnan("lon") & (F.abs("lon") != float("inf"))
    turned = F.when(F.abs("lat") == 90, -180.0).otherwise(F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180)
    small = sides[-1]
    south = F.least(F.floor(F.col("lat") / small) * small, F.lit(90 - small))
    cells = points.select(F.when(known, south).cast("int").alias("s"), F.when(known, F.floor(turned / small) * small).cast("int").alias("w"))
    counts = cells.groupBy("s", "w").agg(F.count("*").alias("n"))
    edge = lambda c, side: (F.floor(F.col(c) / side) * side).cast("int")
    levels = F.array(*(F.struct(F.lit(x).alias("side"), edge("s", x).alias("south"), edge("w", x).alias("west")) for x in sides))
    nowhere = F.array(F.struct(F.lit(0).alias("side"), F.lit(None).cast("int").alias("south"), F.lit(None).cast("int").alias("west")))
    spread = counts.select("n", F.explode(F.when(F.col("s").isNull(), nowhere).otherwise(levels)).alias("c"))
    return spread.groupBy("c.side", "c.south", "c.west").agg(F.sum("n").alias("files"))


def _short(x: Column) -> Column:
    """A number to two places without closing zeros."""
    fixed = F.regexp_replace(F.regexp_replace(F.format_number(x, 2), ",", ""), r"\.?0+$", "")
    return F.when(fixed == "-0", "0").otherwise(fixed)


def format_exif(items: DataFrame) -> DataFrame:
    """path, label and display: exposures under a second as ``1/n sec``, apertures as ``f/n``, focal lengths in mm, other rationals
    with their fraction, several of them as numbers; all else as it is."""
    rational, label = F.col("value").contains("/") & F.col("num").isNotNull(), F.col("label")
    parts = F.transform(F.arrays_zip("num", "den"), lambda p: F.coalesce(F.try_divide(p["num"], p["den"]), F.lit(0.0)))
    x, whole = F.get(parts, F.lit(0)), F.get("num", F.lit(0))
    display = (
        F.when(~F.coalesce(rational, F.lit(False)), F.col("value")).when(F.size("num") > 1, F.array_join(F.transform(parts, _short), ", "))
        .when((label == "Exposure time") & (x > 0) & (x < 1), F.concat(F.lit("1/"), F.round(1 / x).cast("long").cast("string"), F.lit(" sec")))
        .when(label.isin("F number", "Aperture", "Max aperture"), F.concat(F.lit("f/"), _short(x))).when(label.startswith("Focal length"), F.concat(_short(x), F.lit(" mm")))
        .otherwise(F.concat(_short(x), F.lit(" ("), whole.cast("string"), F.lit("/"), F.get("den", F.lit(0)).cast("string"), F.lit(")")))
    )
    return items.select("path", "label", display.alias("display"))


def device_summary(items: DataFrame) -> DataFrame:
    """make, model, software, files and with_gps."""
    label, image, gps = F.col("label"), F.col("grp") == "EXIF image", F.col("grp") == "EXIF GPS location"
    named = image & label.isin("Camera make", "Camera model", "Software")
    held = _by_file(items.where(named | gps).select("path", *(F.when(named, F.col(c)).alias(c) for c in ("label", "value"))))
    value = lambda name, c: F.max(F.when(label == name, F.col("value"))).alias(c)
    per = held.groupBy("path").agg(value("Camera make", "make"), value("Camera model", "model"), value("Software", "software"), F.bool_or(label.isNull()).alias("gps"))
    return per.where("make is not null or model is not null").groupBy("make", "model", "software").agg(F.count("*").alias("files"), F.count_if("gps").alias("with_gps"))
