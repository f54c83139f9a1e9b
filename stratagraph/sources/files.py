"""Source trees read as rows of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources, files that only pin versions, and the size over which a file is only reported.
IGNORED = (
    ".git", ".idea", ".ipynb_checkpoints", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".turbo", ".vercel", ".venv", "__pycache__", "build", "coverage",
    "dist", "node_modules",
)
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
MAX_BYTES = 2_000_000
BUILT = ("bin", "obj", "out", "target")  # folders whose files of unsupported languages aren't counted
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "cs": "dotnet", "bash": "shell", "c": "c-cpp", "cc": "c-cpp", "clj": "clojure",
    "cljs": "clojure", "cpp": "c-cpp", "cxx": "c-cpp", "dart": "dart", "erl": "erlang", "ex": "elixir", "exs": "elixir", "h": "c-cpp", "hpp": "c-cpp", "go": "go", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "lua": "lua", "m": "objective-c", "mm": "objective-c", "php": "php", "rb": "ruby", "rs": "rust", "scala": "scala", "sh": "shell", "swift": "swift",
    "zsh": "shell",
}


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, suffix, length, content): the files under ``root``, without ignored folders; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*", "/")
    path = F.ltrim(F.replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), base, F.lit("")), F.lit("/"))
    rows = files.select(path.alias("path"), F.substring_index("path", "/", -1).alias("name"), "length", "content")
    inside = F.exists(F.split("path", "/"), lambda part: part.isin(*IGNORED))
    return rows.where(~inside).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))


def read_dotenv(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the ``.env`` files under ``root``: Spark's readers pass over names that begin with a dot.

    They are read on the driver; no file over MAX_BYTES is.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = len(fs.makeQualified(top).toUri().getPath()) + 1
    rows, found = [], fs.listFiles(top, True)
    while found.hasNext():
        at = found.next()
        path = at.getPath().toUri().getPath()[start:]
        if path.rsplit("/", 1)[-1].startswith(".env") and not set(path.split("/")) & set(IGNORED) and at.getLen() <= MAX_BYTES:
            stream = fs.open(at.getPath())
            rows.append((path, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
            stream.close()
    return spark.createDataFrame(rows, "path string, text string")


def with_language(files: DataFrame) -> DataFrame:
    """``files`` with the language of the suffix, null for unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return files.withColumn("language", names[F.col("suffix")])


def unsupported(files: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(language, file_count, sample_paths): files of known languages that nothing reads."""
    built = F.exists(F.split("path", "/"), lambda part: part.isin(*BUILT))
    rows = with_language(files).where(F.col("language").isNotNull() & ~F.col("language").isin(*supported) & ~built)
    return rows.groupBy("language").agg(F.count("*").alias("file_count"), F.slice(F.array_sort(F.collect_set("path")), 1, 5).alias("sample_paths"))


def language_coverage(files: DataFrame, handled: dict[str, str]) -> DataFrame:
    """(language, adapter, state, files): languages that are there, by the adapter that reads each; uninstrumented without one."""
    names = F.create_map(*[F.lit(x) for pair in handled.items() for x in pair]) if handled else F.create_map().cast("map<string,string>")
    rows = with_language(files).where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("files"))
    adapter = names[F.col("language")]
    return rows.select("language", adapter.alias("adapter"), F.when(adapter.isNull(), "uninstrumented").otherwise("instrumented").alias("state"), "files")


def config_files(files: DataFrame, suffixes: tuple[str, ...], names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the configuration files, and (path, reason) of those over the size limit."""
    chosen = files.where((F.col("suffix").isin(*suffixes) | F.col("name").isin(*names)) & ~F.col("name").isin(*LOCKFILES))
    small = chosen.where(F.col("length") <= MAX_BYTES).select("path", F.decode("content", "UTF-8").alias("text"))
    return small, chosen.where(F.col("length") > MAX_BYTES).select("path", F.lit("file_too_large").alias("reason"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): the files' lines, numbered from 1."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))
