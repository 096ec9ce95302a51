"""Readers and writers of the file formats that tilesets come in.

Rasters: ESRI ASCII grids and plain TIFF. Point clouds: uncompressed LAS 1.0 to
1.4. Vectors: GeoPackage. Attributes: GeoPackage and DBF. Each file is read by one task from a path that all executors see;
many files are read in parallel. Everything else is Spark's own: Parquet, CSV,
JSON.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.skew import broadcast_if_small

#: Rows that a file's reader hands on at a time.
CHUNK = 200_000


def write_tiles(df: DataFrame, path: str) -> None:
    """Replace the partitions of the tiles in ``df`` and no others; partitions are written in parallel."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_name").parquet(path)


def read_tiles(spark: SparkSession, path: str, names: Sequence[str] | None = None, bands: Sequence[str] | None = None) -> DataFrame:
    """A raster tileset; only the partitions and columns asked for are read."""
    df = spark.read.parquet(path)
    if names is not None:
        df = df.where(F.col("tile_name").isin(list(names)))
    return df.select("tile_name", "px", "py", *bands) if bands is not None else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON metadata, one document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_metadata(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


class Metadata:
    """Computed attributes of a tileset, kept as JSON beside it under the version they were computed for, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, compute: dict) -> None:
        self.spark, self.path, self.compute = spark, path, compute

    def _file(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, attribute: str, version: str):
        """The kept value if it is of this version, else computed and kept."""
        if attribute not in self.compute:
            raise KeyError(f"Unknown metadata attribute '{attribute}'")
        at, files = self._file()
        kept = json.loads("\n".join(r.value for r in self.spark.read.text(self.path).collect())) if files.exists(at) else {}
        if kept.get(attribute, {}).get("version") != version:
            kept[attribute] = {"version": version, "value": self.compute[attribute]()}
            out = files.create(at, True)
            out.write(bytearray(json.dumps(kept).encode()))
            out.close()
        return kept[attribute]["value"]


def companions(path: str) -> list[str]:
    """Files that belong to a raster: same place and stem, any extension, or the raster's name and more behind a dot."""
    folder, name = os.path.split(path)
    stem = os.path.splitext(name)[0]
    return sorted(os.path.join(folder, f) for f in os.listdir(folder or ".") if os.path.splitext(f)[0] == stem or f.startswith(name + "."))


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")


def read_ascii_grids(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """filename, px, py, value of the cells that hold data; px and py count cells from the origin, y grows north."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with open(path, encoding="ascii") as f:
                    head, rest = {}, ""
                    for line in f:
                        part = line.split()
                        if part and part[0][0].isalpha():
                            head[part[0].lower()] = float(part[1])
                        else:
                            rest = line
                            break
                    w = head["cellsize"]
                    x = head.get("xllcorner", head.get("xllcenter", 0) - w / 2)
                    y = head.get("yllcorner", head.get("yllcenter", 0) - w / 2)
                    rows = int(head["nrows"])
                    left = round(x / w)
                    for k in range(rows):
                        v = np.array((rest if k == 0 else f.readline()).split(), float)
                        ok = np.flatnonzero(v != head.get("nodata_value", -9999))
                        yield pd.DataFrame({"filename": path, "px": (left + ok).astype(np.int32), "py": np.int32(round(y / w) + rows - 1 - k), "value": v[ok]})

    return _files(spark, paths).mapInPandas(read, "filename string, px int, py int, value double")


#: Numbers of the tags that a plain TIFF's reader needs.
_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "offsets": 273, "samples": 277, "rows": 278, "planar": 284, "tiled": 322, "kind": 339, "scale": 33550, "tie": 33922, "nodata": 42113}
#: Code and size of a tag's field types.
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}


def _tiff_tags(f, e: str) -> dict[int, tuple]:
    (at,) = struct.unpack(e + "I", f.read(4))
    f.seek(at)
    (n,) = struct.unpack(e + "H", f.read(2))
    raw, out = f.read(12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", raw, 12 * k)
        if kind not in _FIELDS:
            continue
        form = f"{e}{count}{_FIELDS[kind]}"
        size = struct.calcsize(form)
        if size <= 4:
            out[tag] = struct.unpack_from(form, raw, 12 * k + 8)
        else:
            f.seek(struct.unpack_from(e + "I", raw, 12 * k + 8)[0])
            out[tag] = struct.unpack(form, f.read(size))
    return out


def read_tiffs(spark: SparkSession, paths: Sequence[str], bands: int = 1) -> DataFrame:
    """filename, px, py, band1 .. of the cells of plain TIFF files, null where a band has no data; px and py count cells from the origin, y grows north.

    Plain is: uncompressed, in strips, square cells and a georeference by a cell
    size and a corner, 8 to 64 bits a value. A strip is read at a time. Other
    files are an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield from _tiff_cells(path, bands)

    return _files(spark, paths).mapInPandas(read, "filename string, px int, py int, " + ", ".join(f"band{k + 1} double" for k in range(bands)))


def _tiff_cells(path: str, bands: int) -> Iterator[pd.DataFrame]:
    with open(path, "rb") as f:
        head = f.read(4)
        if head not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF file")
        e = "<" if head[:1] == b"I" else ">"
        t = _tiff_tags(f, e)
        tag = lambda name, default=None: t.get(_TAGS[name], default)
        if tag("compression", (1,))[0] != 1 or tag("tiled"):
            raise ValueError("a TIFF file that is compressed or tiled")
        width, height, samples = tag("width")[0], tag("height")[0], tag("samples", (1,))[0]
        if bands > samples:
            raise ValueError(f"the file has {samples} bands")
        size, kind = tag("bits", (1,))[0] // 8, {1: "u", 2: "i", 3: "f"}[tag("kind", (1,))[0]]
        form = np.dtype(f"{e}{kind}{size}")
        scale, tie = tag("scale"), tag("tie")
        if not scale or not tie:
            raise ValueError("a TIFF file without a georeference")
        left, top = round((tie[3] - tie[0] * scale[0]) / scale[0]), round((tie[4] + tie[1] * scale[1]) / scale[1])
        nodata = float(tag("nodata")[0].split(b"\0")[0]) if tag("nodata") else None
        planar, rows, offsets = tag("planar", (1,))[0] == 2, min(tag("rows", (height,))[0], height), tag("offsets")
        strips = -(-height // rows)
        for k in range(strips):
            n = min(rows, height - k * rows)
            one = []
            for band in range(bands):
                if planar or not band:
                    f.seek(offsets[k + band * strips] if planar else offsets[k])
                    raw = np.frombuffer(f.read(n * width * (1 if planar else samples) * size), form).reshape(n, width, -1)
                v = raw[:, :, 0 if planar else band].astype(float).ravel()
                one.append(np.where(v == nodata, np.nan, v) if nodata is not None else v)
            at = np.arange(n * width)
            out = pd.DataFrame({"filename": path, "px": (left + at % width).astype(np.int32), "py": (top - 1 - k * rows - at // width).astype(np.int32)})
            yield out.assign(**{f"band{j + 1}": pd.array(v, dtype="Float64") if not np.isnan(v).any() else pd.Series(v).astype("Float64") for j, v in enumerate(one)})


def tiff_bytes(bands: Sequence[np.ndarray], left: float, top: float, width: float, nodata: float | None = None, e: str = "<") -> bytes:
    """A small plain TIFF file of bands of one kind, rows from the top."""
    first = np.asarray(bands[0])
    data = np.stack([np.asarray(b) for b in bands], -1).astype(first.dtype.newbyteorder(e)).tobytes()
    kind = {"u": 1, "i": 2, "f": 3}[first.dtype.kind]
    tags = [(256, "I", (first.shape[1],)), (257, "I", (first.shape[0],)), (258, "H", (first.dtype.itemsize * 8,) * len(bands)), (259, "H", (1,)), (273, "I", (8,)), (277, "H", (len(bands),)), (278, "I", first.shape[:1]), (279, "I", (len(data),)), (339, "H", (kind,) * len(bands)), (33550, "d", (width, width, 0)), (33922, "d", (0, 0, 0, left, top, 0))]
    if nodata is not None:
        text = str(nodata).encode() + b"\0"
        tags.append((42113, "s", (text,)))
    code = {v: k for k, v in _FIELDS.items()}
    at = 8 + len(data)
    entries, extra = b"", b""
    for tag, form, v in tags:
        n = len(v[0]) if form == "s" else len(v)
        raw = struct.pack(f"{e}{n}{form}", *v)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(e + "I", at + 2 + 12 * len(tags) + 4 + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(e + "HHI", tag, code[form], n) + where
    return (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", at) + data + struct.pack(e + "H", len(tags)) + entries + struct.pack(e + "I", 0) + extra


def read_attributes(spark: SparkSession, paths: Sequence[str], layer: str | None = None) -> DataFrame:
    """filename and the attributes, without geometry, of the first (or the named) layer of GeoPackages, or of DBF files."""
    if paths[0].lower().endswith(".dbf"):
        return read_dbf(spark, paths)
    if layer is None:
        with sqlite3.connect(f"file:{paths[0]}?mode=ro", uri=True) as con:
            layer = con.execute("SELECT table_name FROM gpkg_contents ORDER BY rowid LIMIT 1").fetchone()[0]
    df = read_gpkg(spark, paths, layer)
    return df.select(*(f.name for f in df.schema.fields if f.dataType.simpleString() != "binary"))


def _dbf_fields(path: str) -> list[tuple[str, str, int, int]]:
    """Name, type, width and decimals of the fields."""
    with open(path, "rb") as f:
        head = f.read(32)
        (size,) = struct.unpack_from("<H", head, 8)
        raw = f.read(size - 33)
    return [(raw[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(raw[k + 11]), raw[k + 16], raw[k + 17]) for k in range(0, len(raw) - 31, 32) if raw[k] != 0x0D]


def read_dbf(spark: SparkSession, paths: Sequence[str], encoding: str = "latin-1") -> DataFrame:
    """filename and the columns of DBF files; the first file's columns hold for all. Deleted rows are left out, blank values are null, dates are text."""
    fields = _dbf_fields(paths[0])
    kinds = {n: ("boolean" if t == "L" else ("double" if d or w > 18 else "bigint") if t in "NF" else "string") for n, t, w, d in fields}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with open(path, "rb") as f:
                    head = f.read(32)
                    n, start, width = struct.unpack_from("<IHH", head, 4)
                    f.seek(start)
                    while n > 0:
                        k = min(n, CHUNK)
                        raw = np.frombuffer(f.read(k * width), np.uint8)
                        raw = raw[: len(raw) // width * width].reshape(-1, width)
                        if not len(raw):
                            break
                        raw = raw[raw[:, 0] != 0x2A]
                        out, at = {"filename": [path] * len(raw)}, 1
                        for name, _, w, _ in fields:
                            text = [bytes(v).decode(encoding).strip(" \0") or None for v in raw[:, at : at + w]]
                            if kinds[name] == "boolean":
                                out[name] = pd.array([None if v in (None, "?") else v in "YyTt" for v in text], "boolean")
                            elif kinds[name] == "string":
                                out[name] = pd.Series(text, dtype=object)
                            else:
                                v = pd.to_numeric(pd.Series(text, dtype=object), errors="coerce")
                                out[name] = v.astype("Float64" if kinds[name] == "double" else "Int64")
                            at += w
                        yield pd.DataFrame(out)
                        n -= k

    return _files(spark, paths).mapInPandas(read, "filename string, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


#: Offset of intensity, classification, returns and colour in each LAS point format, and whether the classification has five bits.
_LAS = {0: (12, 15, 14, None, True), 1: (12, 15, 14, None, True), 2: (12, 15, 14, 20, True), 3: (12, 15, 14, 28, True), 6: (12, 16, 14, None, False), 7: (12, 16, 14, 30, False), 8: (12, 16, 14, 30, False)}


def read_las(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """filename, x, y, z, intensity, return_no, classification, r, g, b of uncompressed LAS files; colours are null where a file has none.

    A file is read in chunks of points. A file that isn't LAS, is compressed or
    is cut short is an error; :func:`las_status` lists such files instead.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield from _las_points(path)

    return _files(spark, paths).mapInPandas(read, "filename string, x double, y double, z double, intensity int, return_no int, classification int, r int, g int, b int")


def las_status(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """filename, size, status: Valid, or the error that reading the whole file meets."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                try:
                    size = os.path.getsize(path)
                    for _ in _las_points(path):
                        pass
                    status = "Valid"
                except Exception as e:  # noqa: BLE001
                    size, status = 0 if isinstance(e, OSError) else os.path.getsize(path), str(e)
                yield pd.DataFrame({"filename": [path], "size": [size], "status": [status]})

    return _files(spark, paths).mapInPandas(read, "filename string, size bigint, status string")


def _las_points(path: str) -> Iterator[pd.DataFrame]:
    with open(path, "rb") as f:
        h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError("not a LAS file")
        (start,) = struct.unpack_from("<I", h, 96)
        kind, size, n = struct.unpack_from("<BHI", h, 104)
        if h[25] >= 4 and n == 0:
            (n,) = struct.unpack_from("<Q", h, 247)
        if kind not in _LAS:
            raise ValueError(f"point format {kind} is compressed or unknown")
        scale, off = np.array(struct.unpack_from("<3d", h, 131)), np.array(struct.unpack_from("<3d", h, 155))
        inten, cls, ret, rgb, five = _LAS[kind]
        f.seek(start)
        while n > 0:
            k = min(n, CHUNK)
            raw = np.frombuffer(f.read(k * size), np.uint8)
            if len(raw) < k * size:
                raise ValueError("file is cut short")
            raw = raw.reshape(k, size)
            at = lambda o, t, w=1: np.ascontiguousarray(raw[:, o : o + np.dtype(t).itemsize * w]).view(t)  # noqa: E731, B023
            xyz = at(0, "<i4", 3) * scale + off
            c = at(rgb, "<u2", 3).astype(np.int32) if rgb else None
            out = {"filename": path, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": at(inten, "<u2")[:, 0].astype(np.int32), "return_no": (raw[:, ret] & (7 if five else 15)).astype(np.int32), "classification": (raw[:, cls] & (31 if five else 255)).astype(np.int32)}
            yield pd.DataFrame(out | {b: c[:, i] if c is not None else pd.array([None] * k, dtype="Int32") for i, b in enumerate("rgb")})
            n -= k


def las_bytes(xyz: np.ndarray, classification: np.ndarray, rgb: np.ndarray | None = None, scale: float = 0.01) -> bytes:
    """A small LAS 1.2 file of points, format 2 with colours, else 0."""
    kind, size = (2, 26) if rgb is not None else (0, 20)
    off = np.floor(xyz.min(0)) if len(xyz) else np.zeros(3)
    h = bytearray(227)
    h[:4], h[24], h[25] = b"LASF", 1, 2
    struct.pack_into("<HII", h, 94, 227, 227, 0)
    struct.pack_into("<BHI", h, 104, kind, size, len(xyz))
    struct.pack_into("<6d", h, 131, *(scale,) * 3, *off)
    raw = np.zeros((len(xyz), size), np.uint8)
    raw[:, :12] = np.round((xyz - off) / scale).astype("<i4").view(np.uint8).reshape(len(xyz), 12)
    raw[:, 14], raw[:, 15] = 0b001001, classification
    if rgb is not None:
        raw[:, 20:26] = rgb.astype("<u2").view(np.uint8).reshape(len(xyz), 6)
    return bytes(h) + raw.tobytes()


def _gpkg_kinds(path: str, layer: str) -> dict[str, str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        out = {}
        for _, name, kind, *_ in con.execute(f'PRAGMA table_info("{layer}")'):
            k = kind.upper()
            out[name] = "bigint" if "INT" in k else "double" if any(x in k for x in ("REAL", "DOUBLE", "FLOAT")) else "boolean" if "BOOL" in k else "string" if any(x in k for x in ("TEXT", "CHAR", "DATE")) else "binary"
        return out


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB behind a GeoPackage geometry's header; null if it is flagged empty or is no such blob."""
    if blob is None or blob[:2] != b"GP" or len(blob) < 8 or blob[3] & 0x10:
        return None
    return blob[8 + (0, 32, 48, 48, 64)[min(blob[3] >> 1 & 7, 4)] :]


def read_gpkg(spark: SparkSession, paths: Sequence[str], layer: str) -> DataFrame:
    """filename and the columns of a layer; geometries as WKB. The first file's columns hold for all."""
    kinds = _gpkg_kinds(paths[0], layer)
    geoms = [c for c, k in kinds.items() if k == "binary"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ", ".join(f'"{c}"' for c in kinds)
        for b in batches:
            for path in b["path"]:
                con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                cur = con.execute(f'SELECT {cols} FROM "{layer}"')
                while rows := cur.fetchmany(CHUNK // 10):
                    pdf = pd.DataFrame(rows, columns=list(kinds), dtype=object)
                    for c, k in kinds.items():
                        if k in ("bigint", "double", "boolean"):
                            pdf[c] = pdf[c].astype({"bigint": "Int64", "double": "Float64", "boolean": "boolean"}[k])
                    for g in geoms:
                        pdf[g] = pdf[g].map(gpkg_wkb)
                    pdf.insert(0, "filename", path)
                    yield pdf
                con.close()

    return _files(spark, paths).mapInPandas(read, "filename string, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def write_archives(df: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Zip archives of CSV files, one a tile, by a plan (tile_name, archive): archive, tiles, bytes.

    Each archive, a fixed number of tiles, is written by one task into a folder
    that all executors share, a tile at a time as its rows come in order. An
    archive appears under its name only when whole.
    """
    cols = [c for c in df.columns if c != "tile_name"]
    d = df.join(broadcast_if_small(plan.select("tile_name", "archive")), "tile_name").select("archive", "tile_name", *cols)
    d = d.repartition("archive").sortWithinPartitions("archive", "tile_name", *cols)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = tile = z = entry = part = None
        tiles = 0

        def close() -> pd.DataFrame | None:
            if z is None:
                return None
            entry.close()
            z.close()
            size = os.path.getsize(part)
            os.replace(part, os.path.join(folder, name))
            return pd.DataFrame({"archive": [name], "tiles": [tiles], "bytes": [size]})

        for b in batches:
            for (a, t), rows in b.groupby(["archive", "tile_name"], sort=False):
                if a != name:
                    if z is not None:
                        yield close()
                    name, tile, tiles = a, None, 0
                    part = os.path.join(folder, f".{a}.{os.getpid()}")
                    z = zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED)
                if t != tile:
                    if tile is not None:
                        entry.close()
                    info = zipfile.ZipInfo(f"{t}.csv")
                    info.compress_type = zipfile.ZIP_DEFLATED
                    entry, tile, tiles = z.open(info, "w", force_zip64=True), t, tiles + 1
                    entry.write((",".join(cols) + "\n").encode())
                entry.write(rows[cols].to_csv(index=False, header=False).encode())
        if z is not None:
            yield close()

    return d.mapInPandas(write, "archive string, tiles bigint, bytes bigint")
