"""Discovery: which files of a listing are indexed, and reading them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.config import AUDIO, CODE, DOCUMENTS, IMAGES, OLD, SHEETS, SLIDES, VIDEOS, WEB
from heliograph.functions.text import extension, filename

# Fixed values.
TEXT_CAP, DOCUMENT_CAP = 5 << 20, 50 << 20
LONGEST_PATH = 260
PRUNED = (
    "node_modules", "__pycache__", "venv", "env", "site-packages", "dist", "build", "target", "vendor", "models", "_internal",
    "appdata", "programdata", "program files", "program files (x86)", "windowsapps", "wpsystem", "$recycle.bin", "system volume information",
    "anaconda3", "miniconda3", "anaconda", "miniconda", "rustup", "conda-meta",
)
MARKER_FILES = ("pyvenv.cfg", "unins000.exe", ".cargo-ok", "cargo.toml.orig")
MARKER_PATHS = ("lib/rustlib", "bin/internal/engine.version", "resources/app/product.json")
LEFT_OUT_NAMES = (
    "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
    "cargo.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "tsconfig.tsbuildinfo", "english_words.txt",
)
LEFT_OUT_ENDS = (".min.js", ".min.css", ".map", ".bundle.js", ".chunk.js")

SUPPORTED = sorted({*DOCUMENTS, *SHEETS, *SLIDES, *CODE, *WEB, *OLD, *AUDIO})


def size_cap(ext: Column) -> Column:
    """Largest size that is indexed; null for none."""
    return F.when(ext.isin("txt", "md", *CODE, *SHEETS, *WEB), TEXT_CAP).when(ext.isin("pdf", "docx", "pptx", *OLD), DOCUMENT_CAP)


def chunk_cap(ext: Column) -> Column:
    """Most chunks of a file that are indexed; null for none."""
    code = [e for e in CODE if e != "rtf"]
    return F.when(ext.isin(*code, "csv", "tsv"), 8).when(ext.isin("txt", "md", *WEB), 40).when(ext.isin(*AUDIO), F.lit(None)).otherwise(150)


def under_pruned(path: Column, root: str) -> Column:
    """A folder between the root and the file is one that a walk doesn't enter: by name, or hidden."""
    below = F.split(F.substr(path, F.lit(len(root.rstrip("/")) + 2)), "/")
    return F.exists(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), lambda p: F.lower(p).isin(*PRUNED) | p.startswith("."))


def installs(listing: DataFrame) -> DataFrame:
    """folder: folders of installed software, by a marker file in them or a marker path below them."""
    by_file = listing.where(F.lower(filename("path")).isin(*MARKER_FILES)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    below = F.regexp_extract("path", "(?i)^(.*?)/(?:" + "|".join(p.replace(".", r"\.") for p in MARKER_PATHS) + ")(?:/.*)?$", 1)
    return by_file.union(listing.select(below.alias("folder")).where("folder <> ''")).distinct()


def admitted(listing: DataFrame, root: str) -> DataFrame:
    """listing (path, size) with skip, null for files that are indexed, else why not. Folders of installed software are
    skipped as a whole by a join with the parents of their files."""
    ext, name = extension("path"), F.lower(filename("path"))
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = listing.withColumn("folder", F.explode(parents)).join(installs(listing), "folder", "left_semi").select("path").distinct().withColumn("installed", F.lit(True))
    skip = (
        F.when(F.col("installed"), "installed software")
        .when(under_pruned(F.col("path"), root), "folder")
        .when(name.startswith(".") | name.startswith("~$"), "hidden")
        .when(name.isin(*LEFT_OUT_NAMES) | reduce(or_, [name.endswith(e) for e in LEFT_OUT_ENDS]), "name")
        .when(~ext.isin(*SUPPORTED), "type")
        .when(F.length("path") >= LONGEST_PATH, "long path")
        .when(F.col("size") > size_cap(ext), "size")
    )
    return listing.join(inside, "path", "left").withColumn("skip", skip).drop("installed")


def scan_order(ext: Column) -> Column:
    """Documents before code and data, pictures, sound, video."""
    first = F.when(ext.isin(*VIDEOS), 4).when(ext.isin(*AUDIO), 3).when(ext.isin(*IMAGES), 2)
    return first.when(ext.isin(*[c for c in CODE if c != "rtf"], "csv", "tsv"), 1).otherwise(0)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified and content of all files under a root, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^[a-z]+:", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
