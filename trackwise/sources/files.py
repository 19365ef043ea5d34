"""Sources: image folders, indexes, lists, dictionaries and feature files, all through Spark's readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.functions import captures as C

IMAGE_GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and modification time of files; contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime")


def image_folder(spark: SparkSession, root: str, extensions: list[str] | None = None, is_valid=None) -> DataFrame:
    """path, class, class_index of root/<class>/...; exactly one of extensions and is_valid (a column to a column)."""
    if (extensions is None) == (is_valid is None):
        raise ValueError("give either extensions or is_valid")
    df = list_files(spark, root).withColumn("rel", F.regexp_extract("path", r"[^/]+/[^/]+$", 0))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    df = df.withColumn("class", F.regexp_extract("path", rf"/{base}/([^/]+)/", 1))
    ok = is_valid(F.col("path")) if is_valid else F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    return class_index(df.where(ok & (F.col("class") != "")).select("path", "class"))


def class_index(df: DataFrame, name: str = "class") -> DataFrame:
    """class_index: the place of the class among the sorted distinct classes."""
    from pyspark.sql import Window

    index = df.select(name).distinct().withColumn("class_index", F.row_number().over(Window.orderBy(name)) - 1)  # one row a class
    return df.join(F.broadcast(index) if index.limit(100_001).count() <= 100_000 else index, name)


def jsonl_index(spark: SparkSession, path: str) -> DataFrame:
    """path, class, class_index from lines {class, files}. A repeated class is one class with the files of all its lines."""
    df = spark.read.schema("class string, files array<string>").json(path)
    return class_index(df.select("class", F.explode("files").alias("path")))


def capture_files(spark: SparkSession, root: str, dialect: str = "segmentation") -> tuple[DataFrame, DataFrame]:
    """Parsed images of one folder, and the ones whose names can't be parsed."""
    df = list_files(spark, root, IMAGE_GLOB, False).withColumn("m", C.parse_capture(F.col("path"), dialect))
    return df.where("m is not null").select("path", "m.*"), df.where("m is null").select("path")


def paired_images(df: DataFrame) -> DataFrame:
    """ori_path and the bbox.jpg of its folder, or null."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    ori = df.where(C.file_name(F.col("path")).rlike(r"^ori.*\.jpg$")).select(F.col("path").alias("ori_path"), folder.alias("f"))
    box = df.where(C.file_name(F.col("path")) == "bbox.jpg").select(F.col("path").alias("bbox_path"), folder.alias("f"))
    return ori.join(box, "f", "left").drop("f")


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """ori_path, bbox_path of a JSON array; an empty list is an error."""
    df = spark.read.schema("ori_path string, bbox_path string").option("multiLine", True).json(path)
    if not df.limit(1).count():
        raise ValueError(f"no images in {path}")
    return df


def dictionary(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of a JSON object; empty if the file is missing or not an object."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], f"key string, value {value}")
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def component_map(spark: SparkSession, path: str) -> DataFrame:
    """Keys with a comma are dropped, parentheses in values too."""
    return dictionary(spark, path).where(~F.col("key").contains(",")).select(F.col("key").alias("code"), F.trim(F.regexp_replace("value", "[()]", "")).alias("component_name"))


FAULTS = "ALERTID string, SETNO string, TIME string, TYPECODE string, ALARMCODE string, TYPE string"


def fault_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fault records, all text; a repeated alert is an error."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(FAULTS).csv(path)
    if df.groupBy("ALERTID").count().where("count > 1").limit(1).count():
        raise ValueError("ALERTID is not unique")
    return df


def target_images(df: DataFrame) -> DataFrame:
    """*_image.png files whose *_mask.png is there too."""
    masks = df.where(F.col("path").endswith("_mask.png")).select(F.regexp_replace("path", r"_mask\.png$", "_image.png").alias("path"))
    return df.where(F.col("path").endswith("_image.png")).join(masks, "path", "left_semi")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """image, class_name, xmin, ymin, xmax, ymax and the label's place from a JSON object of boxes."""
    boxes = "map<string,struct<bboxes:array<struct<bbox:array<double>,class_name:string>>>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", boxes)).alias("image", "v")).select("image", F.explode("v.bboxes").alias("b"))
    at = lambda i: F.get("b.bbox", F.lit(i))
    return df.select("image", "b.class_name", at(0).alias("xmin"), at(1).alias("ymin"), at(2).alias("xmax"), at(3).alias("ymax"), ((at(0) + at(2)) / 2).alias("center_x"))


def json_rows(spark: SparkSession, path: str, value: str, name: str) -> DataFrame:
    """idx and name from a JSON array in a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<{value}>")).alias("idx", name))


def npy_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """idx and name from a two-dimensional NumPy file, which one task reads."""
    import pyarrow as pa

    def run(batches):
        import io

        import numpy as np

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float32()))], ["idx", name])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"idx int, {name} array<float>")


def zipped(left: DataFrame, right: DataFrame, index: str = "idx") -> DataFrame:
    """Rows of equal index, to the shorter side: files that are tied by position carry it as a column."""
    return left.join(right, index)


def feature_files(spark: SparkSession, images: str, texts: str, paths: str, prompts: str) -> DataFrame:
    """idx, img, txt, path, prompt from two NumPy files and two JSON arrays, to the shortest."""
    out = zipped(npy_rows(spark, images, "img"), npy_rows(spark, texts, "txt"))
    return zipped(zipped(out, json_rows(spark, paths, "string", "path")), json_rows(spark, prompts, "string", "prompt"))


def prompt_images(df: DataFrame) -> DataFrame:
    """Background and manual images: three suffixes, in lower case only."""
    return df.where(F.col("path").rlike(r"\.(jpg|jpeg|png)$"))


def fault_images(df: DataFrame) -> DataFrame:
    """path and the parsed parts of fault images at any depth; names that can't be parsed go."""
    df = df.where(C.file_name(F.col("path")).rlike(r"_ori.*_.*\.jpg$")).withColumn("m", C.parse_fault(C.file_name(F.col("path"))))
    return df.where("m is not null").select("path", "m.*")


def by_ids(df: DataFrame, ids: DataFrame | None, key: str, basename: bool = False) -> DataFrame:
    """Paths of the named rows, or of all."""
    out = df if ids is None else df.join(ids, key, "left_semi")
    return out.withColumn("path", C.file_name(F.col("path"))) if basename else out


_REGISTRY: dict[str, Callable[..., DataFrame]] = {"image_folder": image_folder, "jsonl": jsonl_index, "image_list": image_list}


def register(name: str, source: Callable[..., DataFrame]) -> None:
    _REGISTRY[name] = source


def build(spark: SparkSession, kind: str, path: str, n_classes: int | None = None, **options) -> DataFrame:
    """A registered source; the number of classes is checked when given."""
    if kind not in _REGISTRY:
        raise NotImplementedError(kind)
    df = _REGISTRY[kind](spark, path, **options)
    if n_classes is not None and (n := df.select("class").distinct().count()) != n_classes:
        raise ValueError(f"{n} classes, not {n_classes}")
    return df


def sharded(df: DataFrame, key: str, shards: int, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """shard and place within it; each row once, no padding."""
    h = F.xxhash64(F.lit(epoch if shuffle else 0), key)
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).withColumn("place", h if shuffle else F.col(key))


def quarantine(df: DataFrame, bad) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows; bad ones aren't replaced by others."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag)
