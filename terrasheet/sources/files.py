"""Readers and writers of the workflow's files: CSV, world files, YOLO labels, COCO JSON, image lists, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count as images.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def list_images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, length, modificationTime) of all images below a folder; with `content` their bytes too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGES))
    return found if content else found.drop("content")


def parse_world_file(content: Column) -> list[Column]:
    """line1 to line6 of a world file's text: blank lines go, a line that is no number is null."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x) != "")
    return [F.trim(F.get(lines, F.lit(i))).try_cast("double").alias(f"line{i + 1}") for i in range(6)]


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, line1..line6) of all .tfw, .pgw, .jgw and .jpw files below a folder, in any case."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("filename"), "value")
    return found.where(F.lower("filename").rlike(r"\.(tfw|pgw|jgw|jpw)$")).select("filename", *parse_world_file(F.col("value")))


def world_file_text(t: Column) -> Column:
    """The six lines A, D, B, E, C, F of an affine struct."""
    return F.concat_ws("\n", *[t[k].cast("string") for k in "adbecf"])


def write_world_files(sheets: DataFrame, path: str) -> None:
    """One world file for each row of sheets (name, t: an affine struct), named by `name`, in the folder; a file of this name is written anew. Names must be unique."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    sheets.select("name", world_file_text(F.col("t")).alias("text")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def parse_yolo(line: Column) -> list[Column]:
    """class, xc, yc, w, h of a label line."""
    p = F.split(F.trim(line), r"\s+")
    return [F.get(p, F.lit(0)).try_cast("int").alias("cls"), *[F.get(p, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))]]


def yolo_line(cls: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    parts = [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]
    return F.concat_ws(" ", cls.cast("string"), *[F.round(p, 6).cast("string") for p in parts])


COCO_IMAGE = "struct<id:long,annotations:array<struct<id:long,image_id:long,category:string,bbox:array<double>,area:double,iscrowd:int>>>"


def coco_json(boxes: DataFrame, image: str = "image") -> DataFrame:
    """One JSON text for each image with its annotations, boxes as (x, y, w, h); ids count from 1 within the image, boxes without area go."""
    b = boxes.where("x2 > x1 AND y2 > y1")
    each = b.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("seq", "label", "x1", "y1", "x2", "y2"))).alias("_b"))
    note = F.transform("_b", lambda v, i: F.struct((i + 1).cast("long").alias("id"), F.col(image).alias("image_id"), v["label"].alias("category"), F.array(v["x1"], v["y1"], v["x2"] - v["x1"], v["y2"] - v["y1"]).alias("bbox"), ((v["x2"] - v["x1"]) * (v["y2"] - v["y1"])).alias("area"), F.lit(0).alias("iscrowd")))
    return each.select(image, F.to_json(F.struct(F.col(image).alias("id"), note.alias("annotations"))).alias("json"))


def parse_coco(df: DataFrame, col: str = "json") -> DataFrame:
    d = df.select(F.from_json(col, COCO_IMAGE).alias("_d")).select(F.explode("_d.annotations").alias("a")).select("a.*")
    return d.select("image_id", "id", "category", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], "area")


def geojson_points(df: DataFrame) -> DataFrame:
    """A GeoJSON feature for each point (id, x, y)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return df.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id").alias("properties"))).alias("feature"))
