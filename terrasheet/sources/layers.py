"""Vector layers: well-known binary, Parquet with bounding boxes, and shapefiles as a Python data source.

A shape is a `kind` (point, line, polygon; null for none) and its `parts`, arrays of
(x, y): one place, the lines, or the rings with holes among them.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

PARTS = "array<array<struct<x:double,y:double>>>"
SHAPE = f"kind string, parts {PARTS}"
BOX = ("x1", "y1", "x2", "y2")
# Shape types of shapefiles, geometry types of well-known binary.
SHP = {"point": 1, "line": 3, "polygon": 5}
WKB = {"point": 1, "line": 2, "polygon": 3}
#: Shape types with heights or measures, which are passed over.
PLAIN = {1: "point", 11: "point", 21: "point", 3: "line", 13: "line", 23: "line", 5: "polygon", 15: "polygon", 25: "polygon"}
RECORDS = 50_000
MANIFEST = "_layer.json"


def _xy(part) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in part], "<f8").reshape(-1, 2)


def encode_wkb(kind: str, parts) -> bytes:
    """Little-endian well-known binary. Several lines are a MultiLineString; a polygon's rings are one Polygon, the first of them its shell."""
    ring = lambda p: struct.pack("<I", len(p)) + _xy(p).tobytes()
    if kind == "point":
        return struct.pack("<BI", 1, 1) + _xy(parts[0])[:1].tobytes()
    if kind == "line":
        lines = [struct.pack("<BI", 1, 2) + ring(p) for p in parts]
        return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(map(ring, parts))


def decode_wkb(data: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """Kind and parts of points, lines and polygons in either byte order; of Multi* all members' parts. Heights and measures are passed over."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def shape() -> tuple[str, list]:
        nonlocal at
        order = "<" if take("B")[0] else ">"
        code = take(order + "I")[0]
        if code & 0x20000000:
            take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[min((code & 0xFFFF) // 1000, 3)]
        code = (code & 0xFFFF) % 1000

        def places(n: int) -> list:
            nonlocal at
            v = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)
            at += n * dims * 8
            return [(float(x), float(y)) for x, y in v[:, :2]]

        if code == 1:
            return "point", [places(1)]
        if code == 2:
            return "line", [places(take(order + "I")[0])]
        if code == 3:
            return "polygon", [places(take(order + "I")[0]) for _ in range(take(order + "I")[0])]
        if code in (4, 5, 6):
            members = [shape() for _ in range(take(order + "I")[0])]
            return {4: "point", 5: "line", 6: "polygon"}[code], [p for _, parts in members for p in parts]
        raise ValueError(f"geometry type {code} isn't known")

    return shape()


def with_wkb(df: DataFrame) -> DataFrame:
    """`df` with its kind and parts as well-known binary in `geom`; null for a shape without a place."""
    kind, parts, kept = df.columns.index("kind"), df.columns.index("parts"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def encode(batches):
        for batch in batches:
            both = zip(batch.column(kind).to_pylist(), batch.column(parts).to_pylist(), strict=True)
            yield batch.append_column("geom", pa.array([encode_wkb(k, p) if k and p and p[0] else None for k, p in both], pa.binary()))

    return df.mapInArrow(encode, f"{kept}, geom binary")


def from_wkb(df: DataFrame, col: str = "geom") -> DataFrame:
    """`df` with kind and parts of the binary column; null for null."""
    place, kept = df.columns.index(col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def decode(batches):
        for batch in batches:
            found = [(None, None) if b is None else decode_wkb(b) for b in batch.column(place).to_pylist()]
            parts = [None if p is None else [[{"x": x, "y": y} for x, y in r] for r in p] for _, p in found]
            yield batch.append_column("kind", pa.array([k for k, _ in found], pa.string())).append_column("parts", pa.array(parts, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))

    return df.mapInArrow(decode, f"{kept}, {SHAPE}")


def boxed(df: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2 of the parts."""
    flat = lambda c: F.flatten(F.transform("parts", lambda r: F.transform(r, lambda p: p[c])))
    return df.withColumns({"x1": F.array_min(flat("x")), "y1": F.array_min(flat("y")), "x2": F.array_max(flat("x")), "y2": F.array_max(flat("y"))})


def write_layer(df: DataFrame, path: str, size: float) -> None:
    """Parquet of shapes (kind, parts and any other columns): well-known binary and bounding boxes, near shapes together in cells of `size`.

    Rows are range-partitioned by cell, so that a box asked for reads the files and
    row groups that reach into it alone.
    """
    b = boxed(df)
    cell = [F.floor(F.col("x1") / size).alias("_cx"), F.floor(F.col("y1") / size).alias("_cy")]
    out = with_wkb(b).select("*", *cell).drop("kind", "parts")
    out.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy", "x1").drop("_cx", "_cy").write.parquet(path)


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Shapes whose bounding box meets `box` (x1, y1, x2, y2), in comparisons that a scan can take."""
    return (F.col("x1") <= box[2]) & (F.col("x2") >= box[0]) & (F.col("y1") <= box[3]) & (F.col("y2") >= box[1])


def read_layer(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    """The layer's rows with kind and parts; with `box` those whose bounding box meets it."""
    rows = spark.read.parquet(path)
    return from_wkb(rows.where(in_box(box)) if box else rows)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    n: int


@dataclass
class Written(WriterCommitMessage):
    stem: str | None
    n: int


def _dbf_fields(raw: bytes) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """Header length, record length, and (name, type, length, decimals) of each field."""
    head, size = struct.unpack_from("<HH", raw, 8)
    fields = []
    for at in range(32, head - 1, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return head, size, fields


def _dbf_type(kind: str, decimals: int):
    return {"N": DoubleType() if decimals else LongType(), "F": DoubleType(), "L": BooleanType(), "D": DateType()}.get(kind, StringType())


def _dbf_value(raw: bytes, kind: str, decimals: int):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    try:
        if kind == "N" and not decimals:
            return int(text)
        if kind in "NF":
            return float(text)
        if kind == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    except ValueError:
        return None
    return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if kind == "L" else text


class ShapefileReader(DataSourceReader):
    """Partitions are ranges of records, whose offsets the index file gives; a shape outside the box asked for is not decoded beyond its own box."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.box = options, schema, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (LessThanOrEqual, LessThan, GreaterThanOrEqual, GreaterThan)) and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.box.setdefault((f.attribute[0], isinstance(f, (LessThanOrEqual, LessThan))), []).append(float(f.value))
            yield f  # the exact comparison stays with Spark

    def partitions(self):
        n, out = int(self.options.get("records", RECORDS)), []
        for path in shapefiles(self.options["path"]):
            where, at = _place(path)
            total = (where.get_file_info(at[:-4] + ".shx").size - 100) // 8
            out += [Range(path, k, min(n, total - k)) for k in range(0, total, n)]
        return out or [Range("", 0, 0)]

    def read(self, part):
        if not part.n:
            return
        where, at = _place(part.path)
        with where.open_input_file(at[:-4] + ".shx") as f:
            f.seek(100 + 8 * part.first)
            index = np.frombuffer(f.read(8 * part.n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with where.open_input_file(at[:-4] + ".dbf") as f:
            head, size, fields = _dbf_fields(f.read(32) + f.read(65_535))
            f.seek(head + size * part.first)
            table = f.read(size * part.n)
        names = [f.name for f in self.schema]
        kept = [(name, kind, at0, length, dec) for (name, kind, length, dec), at0 in zip(fields, np.cumsum([1] + [x[2] for x in fields]), strict=False) if name in names]
        with where.open_input_file(at) as f:
            for k, (offset, length) in enumerate(index.tolist()):
                f.seek(offset + 8)
                start = f.read(min(length, 44))
                kind = PLAIN.get(struct.unpack_from("<i", start)[0])
                box = None
                if kind == "point":
                    x, y = struct.unpack_from("<2d", start, 4)
                    box = (x, y, x, y)
                elif kind:
                    box = struct.unpack_from("<4d", start, 4)
                if self.box and (box is None or any((v > m if less else v < m) for (c, less), most in self.box.items() for v, m in ((box[BOX.index(c)], m) for m in most))):
                    continue
                row = dict(zip(BOX, box or (None,) * 4, strict=True)) | {"record": part.first + k, "file": part.path.rsplit("/", 1)[-1], "kind": kind, "parts": None}
                if kind and "parts" in names:
                    row["parts"] = [[box[:2]]] if kind == "point" else self._parts(start + f.read(length - len(start)))
                own = table[k * size : (k + 1) * size]
                row |= {name: _dbf_value(own[a : a + n], t, dec) for name, t, a, n, dec in kept}
                yield tuple(row.get(c) for c in names)

    @staticmethod
    def _parts(raw: bytes) -> list:
        n, places = struct.unpack_from("<2i", raw, 36)
        firsts = [*struct.unpack_from(f"<{n}i", raw, 44), places]
        xy = np.frombuffer(raw, "<f8", 2 * places, 44 + 4 * n).reshape(-1, 2).tolist()
        return [[tuple(p) for p in xy[a:b]] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def shapefiles(path: str) -> list[str]:
    """The shapefiles of a path: itself, those that a manifest in the folder lists, or all of the folder."""
    where, at = _place(path)
    if path.lower().endswith(".shp"):
        return [path]
    if where.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
        with where.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [f"{path}/{s}.shp" for s in json.loads(f.read())["files"]]
    return sorted(f"{path}/{i.base_name}" for i in where.get_file_info(fs.FileSelector(at)) if i.base_name.lower().endswith(".shp"))


class ShapefileWriter(DataSourceWriter):
    """One shapefile a task under a name of its own; the manifest, written last, lists those of the tasks that count."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.schema = options["path"], options.get("kind", "polygon"), schema

    def write(self, rows):
        fields = [f for f in self.schema if f.name not in (*BOX, "kind", "parts", "record", "file")]
        shapes, values = [], []
        for r in rows:
            shapes.append(self._content(r["parts"]))
            values.append([self._text(r[f.name], f.dataType) for f in fields])
        if not shapes:
            return Written(None, 0)
        stem = f"part-{uuid.uuid4().hex}"
        where, at = _place(self.path)
        where.create_dir(at)
        boxes = np.array([b for _, b in shapes if b is not None])
        whole = (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)) if len(boxes) else (0.0,) * 4
        head = lambda size: struct.pack(">i20x", 9994) + struct.pack(">i", size // 2) + struct.pack("<2i4d", 1000, SHP[self.kind], *whole) + b"\0" * 32
        offset, index, body = 100, [], []
        for k, (content, _) in enumerate(shapes, 1):
            index.append(struct.pack(">2i", offset // 2, len(content) // 2))
            body.append(struct.pack(">2i", k, len(content) // 2) + content)
            offset += 8 + len(content)
        widths = [max(1, *(len(v[i]) for v in values)) for i in range(len(fields))]
        if any(w > 254 for w in widths) or any(len(f.name.encode()) > 10 for f in fields):
            raise ValueError("a shapefile takes texts of 254 bytes and names of 10 bytes")
        kinds = [{"long": "N", "bigint": "N", "int": "N", "double": "F", "boolean": "L", "date": "D"}.get(f.dataType.simpleString(), "C") for f in fields]
        table = [struct.pack("<4BIHH20x", 3, 126, 1, 1, len(values), 33 + 32 * len(fields), 1 + sum(widths))]
        table += [f.name.encode().ljust(11, b"\0") + struct.pack("<c4xBB14x", k.encode(), w, 0 if k != "F" else min(15, w - 1)) for f, k, w in zip(fields, kinds, widths, strict=True)]
        table += [b"\r", *[b" " + b"".join(t.rjust(w) if k in "NF" else t.ljust(w) for t, k, w in zip(v, kinds, widths, strict=True)) for v in values], b"\x1a"]
        for end, parts in ((".shp", [head(offset), *body]), (".shx", [head(100 + 8 * len(index)), *index]), (".dbf", table)):
            with where.open_output_stream(f"{at}/{stem}{end}") as f:
                f.write(b"".join(parts))
        return Written(stem, len(shapes))

    def _content(self, parts) -> tuple[bytes, tuple | None]:
        """Record content and box. Shells run clockwise, holes (rings after the first) the other way, and rings are closed."""
        arrays = [a for a in (_xy(p) for p in parts or []) if len(a)]
        if not arrays:
            return struct.pack("<i", 0), None
        if self.kind == "point":
            x, y = arrays[0][0]
            return struct.pack("<i2d", 1, x, y), (x, y, x, y)
        if self.kind == "polygon":
            for k, a in enumerate(arrays):
                a = a if (a[0] == a[-1]).all() else np.vstack([a, a[:1]])
                left = np.sum(a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]) > 0
                arrays[k] = a[::-1] if left == (k == 0) else a
        every = np.concatenate(arrays)
        box = (*every.min(axis=0), *every.max(axis=0))
        firsts = np.cumsum([0] + [len(a) for a in arrays[:-1]]).astype("<i4")
        return struct.pack("<i4d2i", SHP[self.kind], *box, len(arrays), len(every)) + firsts.tobytes() + every.astype("<f8").tobytes(), box

    @staticmethod
    def _text(v, kind) -> bytes:
        if v is None:
            return b""
        if isinstance(v, bool):
            return b"T" if v else b"F"
        if isinstance(v, datetime.date):
            return v.strftime("%Y%m%d").encode()
        return (repr(float(v)) if isinstance(kind, DoubleType) else str(v)).encode()

    def commit(self, messages):
        where, at = _place(self.path)
        where.create_dir(at)
        with where.open_output_stream(f"{at}/{MANIFEST}") as f:
            kinds = {f.name: f.dataType.simpleString() for f in self.schema if f.name not in (*BOX, "kind", "parts", "record", "file")}
            f.write(json.dumps({"files": sorted(m.stem for m in messages if m and m.stem), "fields": kinds}).encode())

    def abort(self, messages):
        where, at = _place(self.path)
        for m in messages:
            for end in (".shp", ".shx", ".dbf") if m and m.stem else ():
                where.delete_file(f"{at}/{m.stem}{end}")


class Shapefile(DataSource):
    """Format "shapefile": `path` of a file or folder, `records` a partition; for writing `kind`, one for a layer."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        found = shapefiles(self.options["path"])
        fields = []
        if found:
            where, at = _place(found[0])
            with where.open_input_file(at[:-4] + ".dbf") as f:
                fields = [StructField(n, _dbf_type(t, d)) for n, t, _, d in _dbf_fields(f.read(32) + f.read(65_535))[2]]
        elif not self.options["path"].lower().endswith(".shp"):
            # a layer without rows has its fields in the manifest alone
            where, at = _place(self.options["path"])
            if where.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
                with where.open_input_stream(f"{at}/{MANIFEST}") as f:
                    kinds = json.loads(f.read())["fields"]
                types = {"bigint": LongType(), "int": LongType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType()}
                fields = [StructField(n, types.get(k, StringType())) for n, k in kinds.items()]
        place = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
        own = [("file", StringType()), ("record", LongType()), ("kind", StringType()), ("parts", ArrayType(ArrayType(place))), *[(c, DoubleType()) for c in BOX]]
        return StructType([*[StructField(c, t) for c, t in own], *fields])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(dict(self.options), schema)


def read_shapefile(spark: SparkSession, path: str, box: tuple | None = None, records: int = RECORDS) -> DataFrame:
    """(file, record, kind, parts, x1, y1, x2, y2, attributes) of every record, or of those whose box meets `box`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)
    rows = spark.read.format("shapefile").option("records", records).load(path)
    return rows.where(in_box(box)) if box else rows


def write_shapefile(df: DataFrame, path: str, kind: str) -> None:
    """A folder of shapefiles of one kind from `parts` and the other columns; a task's rows are one file, held whole by its task, so that a shapefile's limit of 2 GB bounds them too."""
    df.sparkSession.dataSource.register(Shapefile)
    df.drop("kind").write.format("shapefile").option("kind", kind).mode("append").save(path)
