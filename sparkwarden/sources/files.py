"""File discovery over Spark's binaryFile source.

Names, patterns and ignore rules prune the listing; the source reads contents last. Text
is told from binary by the first 8 KiB of those whose extension says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.text import basename, extension
from sparkwarden.sources.patterns import matched

# --- fixed values: folders that are never entered, extensions that are never text, those that always are, and those that are scanned ---
SKIPPED_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox", ".eggs", "eggs", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache",
    ".vscode", ".idea", ".vs", "dist", "build", "*.egg-info",
]
BINARY_EXTENSIONS = [
    ".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".bin", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".svg", ".webp", ".woff", ".woff2", ".ttf",
    ".eot", ".otf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov",
    ".wav", ".flac", ".lock", ".sum", ".sig", ".br", ".wasm", ".o", ".obj", ".a", ".lib", ".class", ".jar", ".war",
]
SCANNED_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".php", ".rb", ".pl", ".pm", ".sh", ".bash", ".zsh", ".ksh", ".java", ".go", ".rs", ".kt", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".swift", ".scala", ".clj", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".json", ".xml", ".html", ".htm", ".env", ".sql", ".tf", ".tfvars",
    ".gradle", ".sbt", ".txt", ".md", ".rst", ".properties",
]
TEXT_EXTENSIONS = [*SCANNED_EXTENSIONS, ".cljs", ".r", ".m", ".mm", ".ex", ".dockerfile"]
SNIFFED = 8192


def _plain(spark: SparkSession, root: str) -> DataFrame:
    """(file_path relative to root, length, content) of what Spark's source lists; content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.url_decode(F.replace(F.substr("path", F.locate(base, F.col("path")) + F.lit(len(base) + 1)), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("file_path"), "length", "content")


def _passed_over(spark: SparkSession, root: str, enter_all: bool) -> DataFrame:
    """(file_path, length) of what Spark's file sources pass over: empty files and names that start with '.' or '_' (an
    __init__.py, a .env). They are listed on the driver, names only. enter_all: the skipped folders too."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, found = [(top, "", False)], []
    while todo:
        folder, at, hidden = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            odd = hidden or name.startswith((".", "_"))
            if status.isDirectory():
                if enter_all or name not in SKIPPED_DIRS:
                    todo.append((status.getPath(), f"{at}{name}/", odd))
            elif odd or status.getLen() == 0:
                found.append((f"{at}{name}", status.getLen()))
    return spark.createDataFrame(found, "file_path string, length long")


def _content(spark: SparkSession, root: str, path: str) -> bytes:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, root: str, enter_all: bool = True) -> DataFrame:
    """(file_path, length, ext) of every file under root; no content is read."""
    every = _plain(spark, root).select("file_path", "length").unionByName(_passed_over(spark, root, enter_all))
    return every.withColumn("ext", extension(F.col("file_path")))


def count_files(spark: SparkSession, root: str, **options) -> int:
    """How many files names and patterns leave (see discover()); contents are not read, so those without a known extension count."""
    return _named(names(spark, root, options.get("scan_all", False)), spark, root, **options).count()


def binary(content: Column) -> Column:
    """A NUL in the first 8 KiB, or nothing at all."""
    return (F.octet_length(content) == 0) | F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root's .gitignore: one file, read on the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return _content(spark, root, ".gitignore").decode("utf-8", "replace").splitlines()


def _named(files: DataFrame, spark: SparkSession, root: str, scan_all: bool = False, include_ignored: bool = True, exclude: list[str] = (), include: list[str] = ()) -> DataFrame:
    """What discover() keeps by name alone."""
    path = F.col("file_path")
    if exclude:
        files = files.where(~matched(path, list(exclude)))
    if include:
        files = files.where(matched(path, list(include)))
    if scan_all:
        return files
    parts = F.split(path, "/")
    files = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRS))) & ~F.col("ext").isin(*BINARY_EXTENSIONS))
    return files if include_ignored else files.where(~matched(path, ignore_lines(spark, root)))


def discover(spark: SparkSession, root: str, scan_all: bool = False, include_ignored: bool = True, exclude: list[str] = (), include: list[str] = ()) -> DataFrame:
    """Files to look at: (file_path, ext, length, content).

    exclude is tested before include; scan_all switches off all filters but these two. Files without an extension that
    is known as text pass only if they are not empty and their start holds no NUL. Of the files that Spark's sources
    pass over only those that are left by name are read, on the driver, which suits source trees: few, small files.
    """
    kept = lambda rows: _named(rows.withColumn("ext", extension(F.col("file_path"))), spark, root, scan_all, include_ignored, exclude, include)
    odd = [(r.file_path, r.length, _content(spark, root, r.file_path), r.ext) for r in kept(_passed_over(spark, root, scan_all)).toLocalIterator()]
    files = kept(_plain(spark, root)).unionByName(spark.createDataFrame(odd, "file_path string, length long, content binary, ext string"))
    return files if scan_all else files.where(F.col("ext").isin(*TEXT_EXTENSIONS) | ~binary(F.col("content")))


def scannable(files: DataFrame, scan_all: bool = False, dotenv: bool = False) -> DataFrame:
    """The files that the detectors read. dotenv: '.env' too, whose leading dot makes it a name and not an extension."""
    if scan_all:
        return files
    keep = F.col("ext").isin(*SCANNED_EXTENSIONS)
    return files.where(keep | (basename(F.col("file_path")) == ".env") if dotenv else keep)


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.when(F.col("ext") == "", "(no ext)").otherwise(F.col("ext")).alias("ext")).agg(F.count("*").alias("n"))


def text_of(files: DataFrame) -> DataFrame:
    """(file_path, content as UTF-8, bytes that are none replaced)."""
    return files.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
