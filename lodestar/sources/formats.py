"""Text formats of features, models, lists and distances, read into DataFrames and written from them.

Readers take a path (files may be gzip-compressed) and return DataFrames with the schemas that their names tell. Whole files
are parsed where a record spans lines; line formats are split by Column functions.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTOGRAM = "dim int, counter long, steps array<int>, low array<double>, high array<double>, bins array<long>"
SPARSE = "dim int, counter long, steps array<int>, low array<double>, high array<double>, bins map<string,long>"
LOCAL = "filename string, sx int, sy int, lf array<struct<x:int,y:int,s:int,v:array<double>>>"
SIGNATURE = "lf array<struct<count:long,mean:array<double>,sigma:array<double>>>"
POSITIONS = "positions array<struct<x:int,y:int,ids:array<int>>>"
FACES = "faces array<struct<x:int,y:int,w:int,h:int,v:array<double>>>"
ANNOTATION = "x int, y int, c int, objects array<struct<label:string,xmin:int,ymin:int,xmax:int,ymax:int>>"
PAIR = "complete array<long>, counters array<long>, parts array<array<long>>"


def _words(text: str) -> Iterator[list[str]]:
    for line in text.splitlines():
        w = line.split()
        if w and not w[0].startswith("#"):
            yield w


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def parse_vector(text: str) -> dict:
    fields = {w[0]: w[1:] for w in _words(text)}
    values = [float(x) for x in fields.get("data", [])]
    _need(int(fields["dim"][0]) == len(values), "vector: dim and data differ")
    return {"v": values}


def _histogram_head(fields: dict) -> dict:
    counter = int(fields["counter"][0])
    _need(counter > 0, "histogram: counter is 0")
    return {"dim": int(fields["dim"][0]), "counter": counter, "steps": [int(x) for x in fields["steps"]], "low": [float(x) for x in fields["min"]], "high": [float(x) for x in fields["max"]]}


def parse_histogram(text: str) -> dict:
    fields = {w[0]: w[1:] for w in _words(text)}
    return {**_histogram_head(fields), "bins": [int(x) for x in fields["data"]]}


def parse_sparse(text: str) -> dict:
    rows = list(_words(text))
    bins = {w[1]: int(w[2]) for w in rows if w[0] == "data"}
    head = {w[0]: w[1:] for w in rows if w[0] != "data"}
    return {**_histogram_head(head), "counter": sum(bins.values()), "bins": bins}


def parse_local(text: str) -> dict:
    rows = list(_words(text))
    head = {w[0]: w[1:] for w in rows if w[0] != "feature"}
    size = head.get("imagesize", ["0", "0"])
    features = [{"x": int(w[1]), "y": int(w[2]), "s": int(w[3]), "v": [float(x) for x in w[4:]]} for w in rows if w[0] == "feature"]
    return {"filename": " ".join(head.get("filename", [])), "sx": int(size[0]), "sy": int(size[1]), "lf": features}


def parse_signature(text: str) -> dict:
    rows = list(_words(text))
    counts = next([int(x) for x in w[1:]] for w in rows if w[0] == "signature")
    fields: dict[int, dict] = {}
    for w in rows:
        if w[0] == "density":
            fields.setdefault(int(w[1]), {})[w[2]] = [float(x) for x in w[3:]]
    return {"lf": [{"count": n, "mean": fields[i]["mean"], "sigma": fields[i]["variance"]} for i, n in enumerate(counts)]}


def parse_positions(text: str) -> dict:
    return {"positions": [{"x": int(w[0]), "y": int(w[1]), "ids": [int(i) for i in w[2:]]} for w in _words(text)]}


def parse_faces(text: str) -> dict:
    return {"faces": [{"x": int(w[2]), "y": int(w[3]), "w": int(w[4]), "h": int(w[5]), "v": [float(x) for x in w[6:]]} for w in _words(text) if w[0] == "face"]}


def parse_annotation(text: str) -> dict:
    rows = list(_words(text))
    size = next([int(x) for x in w[1:4]] for w in rows if w[0] == "size")
    objects = [dict(zip(("label", "xmin", "ymin", "xmax", "ymax"), (w[1], *map(int, w[2:6])), strict=True)) for w in rows if w[0] == "PASObject"]
    return {"x": size[0], "y": size[1], "c": size[2], "objects": objects}


def parse_pair(text: str) -> dict:
    rows = list(_words(text))
    complete = next([int(x) for x in w[1:]] for w in rows if w[0] == "data")
    parts = [w for w in rows if w[0] == "histo"]
    return {"complete": complete, "counters": [int(w[3]) for w in parts], "parts": [[int(x) for x in w[4:]] for w in parts]}


def parse_meta(text: str) -> dict:
    pairs = [line.split(":", 1) for line in text.splitlines() if ":" in line]
    return {"meta": {k.strip(): v.strip() for k, v in pairs}}


def parse_binary(text: str) -> dict:
    word = text.strip().lower()
    _need(word in ("color", "false", "0", "gray", "true", "1"), f"binary: {word!r}")
    return {"flag": word in ("gray", "true", "1")}


def parse_text(text: str) -> dict:
    return {"document": text.strip()}


#: Parser and columns by file suffix (fixed names).
READERS: dict[str, tuple[Callable[[str], dict], str]] = {
    "vec": (parse_vector, "v array<double>"), "oldvec": (parse_vector, "v array<double>"),
    "histo": (parse_histogram, HISTOGRAM), "sparsehisto": (parse_sparse, SPARSE),
    "lf": (parse_local, LOCAL), "sift": (parse_local, LOCAL), "lfsig": (parse_signature, SIGNATURE), "featcls": (parse_positions, POSITIONS),
    "facefeat": (parse_faces, FACES), "faces": (parse_faces, FACES), "pas": (parse_annotation, ANNOTATION), "histopair": (parse_pair, PAIR),
    "meta": (parse_meta, "meta map<string,string>"), "txt": (parse_meta, "meta map<string,string>"), "bin": (parse_binary, "flag boolean"), "textID": (parse_text, "document string"),
}


def read_features(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    """(path, columns of the suffix): one row for each file, parsed where it is read."""
    parse, schema = READERS[suffix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = bytes(content)
                rows.append({"path": path, **parse((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode())})
            yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, f"path string, {schema}")


@dataclass
class FileList:
    """A database description: names with classes and descriptions, and the suffixes of its features."""

    path: str = ""
    suffixes: list[str] = field(default_factory=list)
    classes: bool = False
    descriptions: bool = False
    feature_directories: bool = False
    large_files: str = ""
    files: list[tuple[str, int | None, list[str]]] = field(default_factory=list)

    def feature_path(self, name: str, suffix: str) -> str:
        return f"{self.path}/{suffix}/{name}.{suffix}" if self.feature_directories else f"{self.path}/{name}.{suffix}"

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, name, class, description) in the order of the list."""
        rows = [(i, n, c, d) for i, (n, c, d) in enumerate(self.files)]
        return spark.createDataFrame(rows, "idx long, name string, class int, description array<string>")


def parse_filelist(text: str) -> FileList:
    out = FileList()
    for w in _words(text):
        key, rest = w[0], w[1:]
        if key == "path":
            out.path = rest[0]
        elif key == "suffix":
            out.suffixes.append(rest[0])
        elif key == "classes":
            out.classes = rest[:1] == ["yes"]
        elif key == "descriptions":
            out.descriptions = rest[:1] == ["yes"]
        elif key == "featuredirectories":
            out.feature_directories = rest[:1] == ["yes"]
        elif key in ("largefeaturefiles", "largebinaryfeaturefiles"):
            out.large_files = key if rest[:1] == ["yes"] else out.large_files
        elif key == "file":
            at = 1 + out.classes
            out.files.append((rest[0], int(rest[1]) if out.classes else None, rest[at:] if out.descriptions else []))
    return out


def read_filelist(spark: SparkSession, path: str) -> FileList:
    """A file list is small: one line for each object's name, read as one text."""
    return parse_filelist("\n".join(r["value"] for r in spark.read.text(path).collect()))


def read_jf(spark: SparkSession, path: str) -> DataFrame:
    """(class, v) of a labelled vector set: a header, rows, and the terminator -1."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    # The header has two fields and a row of a one-dimensional set as well: the header's first field is the largest class.
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    first = rows.agg(F.min("n")).head()[0]
    rows = rows.where((F.col("n") != first) & (F.col("w")[0] != "-1"))
    return rows.select(F.col("w")[0].cast("int").alias("class"), F.transform(F.slice("w", F.lit(2), F.size("w") - 1), lambda x: x.cast("double")).alias("v"))


def write_jf(df: DataFrame, path: str) -> None:
    """(class, v) as text: header, rows, -1."""
    head = df.agg(F.max("class"), F.max(F.size("v"))).head()
    lines = df.select(F.concat_ws(" ", F.col("class").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), " ")).alias("value"), F.lit(1).alias("o"))
    spark = df.sparkSession
    edges = spark.createDataFrame([(f"{head[0] or 0} {head[1] or 0}", 0), ("-1", 2)], "value string, o int")
    lines.unionByName(edges).orderBy("o").coalesce(1).select("value").write.text(path)


def write_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """(class, v) as a header and comma-separated rows; classes must start at 0."""
    head = df.agg(F.min("class"), F.max("class"), F.max(F.size("v"))).head()
    _need(head[0] == 0, "labels must start at 0")
    lines = [f"@relation {relation}", *[f"@attribute v{i} numeric" for i in range(head[2])], "@attribute class {" + ",".join(map(str, range(head[1] + 1))) + "}", "@data"]
    top = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, o int")
    rows = df.select(F.concat_ws(",", F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.col("class").cast("string")).alias("value"), F.lit(len(lines)).alias("o"))
    top.unionByName(rows).orderBy("o").coalesce(1).select("value").write.text(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(idx, d) of a distance file: comments, ``nofdistances N M``, rows ``i d1 ... dM``."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where(F.col("w")[0].rlike("^[0-9]+$"))
    return rows.select(F.col("w")[0].cast("long").alias("idx"), F.transform(F.slice("w", F.lit(2), F.size("w") - 1), lambda x: x.cast("double")).alias("d"))


def parse_weights(text: str) -> list[float]:
    return [float(x) for w in _words(text) if w[0] == "weights" for x in w[1:]]


def parse_lambdas(text: str) -> dict:
    """Two-class maximum-entropy parameters: classes, factor, offset, three counts, then the lambdas by class."""
    w = text.split()
    _need(int(w[0]) == 2, "two classes are needed")
    values = [float(x) for x in w[6:]]
    half = len(values) // 2
    return {"factor": float(w[1]), "offset": float(w[2]), "lambdas": [values[:half], values[half:]]}


def parse_querylist(text: str) -> list[dict]:
    """``query rel ...`` or ``+a -b # rel ...`` by line."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        if "#" in line or line.lstrip()[0] in "+-":
            asked, _, rel = line.partition("#")
            names = asked.split()
            out.append({"pos": [n.lstrip("+") for n in names if n[0] != "-"], "neg": [n[1:] for n in names if n[0] == "-"], "relevant": rel.split()})
        else:
            q, *rel = line.split()
            out.append({"pos": [q], "neg": [], "relevant": rel})
    return out


def write_ranks(results: DataFrame, path: str, command: str = "") -> None:
    """``rank name score`` lines after a comment with the command, in order of rank."""
    rows = results.select(F.col("rank").cast("long").alias("o"), F.concat_ws(" ", "rank", "name", F.col("score").cast("string")).alias("value"))
    top = results.sparkSession.createDataFrame([(-1, f"# {command}")], "o long, value string")
    top.unionByName(rows).orderBy("o").coalesce(1).select("value").write.text(path)


def write_cluster_model(n, mean, sigma) -> str:
    lines = ["# EM/LBG clustering model file", f"gaussians {len(n)}"]
    for i, count in enumerate(n):
        lines += [f"density {i} elements {int(count)}", f"density {i} dim {len(mean[i])}", f"density {i} mean " + " ".join(map(repr, map(float, mean[i]))), f"density {i} variance " + " ".join(map(repr, map(float, sigma[i])))]
    return "\n".join(lines) + "\n"


def parse_cluster_model(text: str) -> tuple[list[int], list[list[float]], list[list[float]]]:
    fields: dict[int, dict] = {}
    for w in _words(text):
        if w[0] == "density":
            fields.setdefault(int(w[1]), {})[w[2]] = w[3:]
    order = sorted(fields)
    return [int(fields[i]["elements"][0]) for i in order], [[float(x) for x in fields[i]["mean"]] for i in order], [[float(x) for x in fields[i]["variance"]] for i in order]


def write_features(df: DataFrame, path: str) -> None:
    """Column files of all features: Parquet, sorted by idx so that reads of few rows skip row groups."""
    df.sortWithinPartitions("idx").write.mode("errorifexists").parquet(path)


def read_rows(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of a feature table whose idx is in ``wanted``."""
    return spark.read.parquet(path).join(wanted.select("idx"), "idx", "left_semi")
