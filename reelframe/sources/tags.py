"""Tags and thumbnails of JPEG files: the directories of Exif segments, their names by three dictionaries, and JFIF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.sources.containers import parsed, walk_jpeg

# Sizes and codes of TIFF types, and which tags point to which directories.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
TYPE_NAMES = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE"}
POINTERS = {0x8769: "Exif", 0x8825: "GPS", 0xA005: "Interop"}
THUMBNAIL, THUMBNAIL_LENGTH = 0x0201, 0x0202

# What tags are called in TIFF directories.
TIFF_TAGS = {
    0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterp", 0x0107: "Threshholding",
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Manufacturer", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts",
    0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfig", 0x011D: "PageName", 0x011E: "XPosition", 0x011F: "YPosition", 0x0122: "GrayResponseUnit", 0x0123: "GrayResponseCurve", 0x0124: "Group3Options",
    0x0125: "Group4Options", 0x0128: "ResolutionUnit", 0x0129: "PageNumber", 0x012C: "ColorResponseCurves", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013D: "Predictor",
    0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0140: "ColorMap", 0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright",
}
# What tags are called in Exif directories, behind "Exif".
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "IFD", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8825: "GPSIFD", 0x8827: "ISOSpeedRatings", 0x8828: "OECF",
    0x9000: "Version", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote",
    0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension",
    0xA004: "RelatedSoundFile", 0xA005: "Interoperability", 0xA20B: "FlashEnergy", 0xA20C: "SpatialFrequencyResponse", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40B: "DeviceSettingDescription",
    0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
# What the tags from 0 on are called in GPS directories, behind "gps.".
GPS_TAGS = (
    "VersionID", "LatitudeRef", "Latitude", "LongitudeRef", "Longitude", "AltitudeRef", "Altitude", "TimeStamp", "Satellites", "Status", "MeasureMode", "DOP", "SpeedRef", "Speed", "TrackRef", "Track", "ImgDirectionRef", "ImgDirection",
    "MapDatum", "DestLatitudeRef", "DestLatitude", "DestLongitudeRef", "DestLongitude", "DestBearingRef", "DestBearing", "DestDistanceRef", "DestDistance", "ProcessingMethod", "AreaInformation", "DateStamp", "Differential", "HPositioningError",
)
#: (which dictionary, tag, name); a directory looks in its own one, and Exif and TIFF directories then in the others of DICTIONARIES.
NAMES = [*(("TIFF", k, v) for k, v in TIFF_TAGS.items()), *(("Exif", k, "Exif" + v) for k, v in EXIF_TAGS.items()), *(("GPS", k, "gps." + v) for k, v in enumerate(GPS_TAGS))]
DICTIONARIES = {"IFD0": ("Exif", "TIFF"), "IFD1": ("Exif", "TIFF"), "Exif": ("Exif", "TIFF"), "GPS": ("GPS", None), "Interop": (None, None)}


def _value(order: str, kind: int, n: int, raw: bytes) -> str:
    if kind == 2:
        return raw.split(b"\0")[0].decode("latin-1")
    numbers = struct.unpack(f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}", raw)
    if kind in (5, 10):
        return " ".join(f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2]))
    return " ".join(map(str, numbers))


def directories(tiff: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(directory, tag, type, count, value) of a TIFF body: its first directory, those it points to, and the one after it.

    Values out of line are read. What lies beyond the body, has no type or points nowhere is left out; no place is read twice.
    """
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return
    todo, seen = [("IFD0", struct.unpack_from(order + "I", tiff, 4)[0])], set()
    while todo:
        name, at = todo.pop(0)
        if at in seen or not 0 <= at <= len(tiff) - 2:
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", tiff, at)[0]
        for k in range(count):
            place = at + 2 + 12 * k
            if place + 12 > len(tiff):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, place)
            size = struct.calcsize("<" + TYPES[kind]) * n if kind in TYPES else 0
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
            raw = tiff[start : start + size]
            if not size or len(raw) < size:
                continue
            value = _value(order, kind, n, raw)
            if tag in POINTERS and kind in (3, 4, 9) and n == 1:  # others point nowhere
                todo.append((POINTERS[tag], int(value)))
            yield name, tag, kind, n, value
        after = at + 2 + 12 * count
        if name == "IFD0" and after + 4 <= len(tiff) and (found := struct.unpack_from(order + "I", tiff, after)[0]):
            todo.append(("IFD1", found))


def _segments(content: bytes, name: str, mark: bytes) -> Iterator[bytes]:
    """Bodies of the segments of a name that begin with a mark, without it; only what stands before the picture is read."""
    for _, _, found, at, size in walk_jpeg(content, coded=False):
        if found == name and content[at : at + len(mark)] == mark:
            yield content[at + len(mark) : at + size]


def _tags(content: bytes) -> Iterator[tuple]:
    for k, tiff in enumerate(_segments(content, "APP1", b"Exif\0\0")):
        for directory, tag, kind, n, value in directories(tiff):
            yield k, directory, tag, TYPE_NAMES[kind], n, value


def names(spark: SparkSession) -> DataFrame:
    """The three dictionaries as a table (dictionary, tag, name)."""
    return spark.createDataFrame(NAMES, "dictionary string, tag long, name string")


def tags(files: DataFrame) -> DataFrame:
    """path, segment, directory (IFD0, Exif, GPS, Interop, IFD1), tag, type, count, value and name of JPEG files (path, content).

    A name comes from the directory's own dictionary, else from the next one of its chain, else it is the tag in hex. Names
    of the GPS directory spell Longitude as its standard does. Null, empty and foreign content has no rows.
    """
    found = parsed(files, _tags, "segment long, directory string, tag long, type string, count long, value string")
    known = names(files.sparkSession)
    chain = lambda k: F.create_map(*(F.lit(x) for d, c in DICTIONARIES.items() for x in (d, c[k] or "none")))[F.col("directory")]
    for k in (0, 1):
        one = known.select(F.col("dictionary").alias(f"_d{k}"), "tag", F.col("name").alias(f"_n{k}"))
        found = found.withColumn(f"_d{k}", chain(k)).join(F.broadcast(one), [f"_d{k}", "tag"], "left")
    name = F.coalesce("_n0", "_n1", F.concat(F.lit("0x"), F.lpad(F.hex("tag"), 4, "0")))
    return found.select("path", "segment", "directory", "tag", "type", "count", "value", name.alias("name"))


def _jfif(content: bytes) -> Iterator[tuple]:
    for head in _segments(content, "APP0", b"JFIF\0"):
        if len(head) >= 7:
            version, units, x, y = struct.unpack_from(">HBHH", head)
            yield version, units, x, y, *(head[7:9] if len(head) >= 9 else (0, 0))


def jfif(files: DataFrame) -> DataFrame:
    """path, version, units, x, y (densities), width and height of the thumbnail of the JFIF heads of JPEG files."""
    return parsed(files, _jfif, "version int, units int, x int, y int, width int, height int")


def _thumbnails(content: bytes) -> Iterator[tuple]:
    for head in _segments(content, "APP0", b"JFIF\0"):
        if len(head) >= 9 and (n := 3 * head[7] * head[8]) and len(head) >= 9 + n:
            yield "JFIF", "rgb", head[7], head[8], head[9 : 9 + n]
    for more in _segments(content, "APP0", b"JFXX\0"):
        kind, body = more[:1], more[1:]
        if kind == b"\x10" and body:
            yield "JFXX", "jpeg", None, None, body
        elif kind in (b"\x11", b"\x13") and len(body) >= 2 and (n := body[0] * body[1]):
            if kind == b"\x13" and len(body) >= 2 + 3 * n:
                yield "JFXX", "rgb", body[0], body[1], body[2 : 2 + 3 * n]
            elif kind == b"\x11" and len(body) >= 770 + n:
                yield "JFXX", "palette", body[0], body[1], b"".join(body[2 + 3 * p : 5 + 3 * p] for p in body[770 : 770 + n])
    for tiff in _segments(content, "APP1", b"Exif\0\0"):
        found = {tag: int(value) for directory, tag, kind, n, value in directories(tiff) if directory == "IFD1" and tag in (THUMBNAIL, THUMBNAIL_LENGTH) and kind in (3, 4) and n == 1}
        at, size = found.get(THUMBNAIL, 0), found.get(THUMBNAIL_LENGTH, 0)
        if at and size and at + size <= len(tiff):
            yield "Exif", "jpeg", None, None, tiff[at : at + size]


def thumbnails(files: DataFrame) -> DataFrame:
    """path, source (JFIF, JFXX, Exif), kind (rgb, palette, jpeg), width, height and data of JPEG files' thumbnails: three bytes a
    pixel, those of a palette put in, or a JPEG file, of which width and height are null. Ones that are cut off are left out."""
    return parsed(files, _thumbnails, "source string, kind string, width int, height int, data binary")
