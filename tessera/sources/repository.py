"""Repositories on disk as rows of files."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.graph import language_of

MAX_BYTES = 1_000_000
# Folders and files that are never read.
IGNORED = (
    ".git/", ".hg/", ".svn/", "node_modules/", "__pycache__/", ".venv/", "venv/", "env/", "dist/", "build/", "vendor/", ".next/", ".gradle/", ".idea/",
    ".vscode/", "coverage/", ".cache/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", "target/", "*.min.js", "*.min.css", "*.lock", "package-lock.json",
    "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock",
)
SECRET_FILES = (".env", ".env.local", ".env.production", "credentials.json", "secrets.json")
IGNORE_FILES = (".gitignore", ".tesseraignore")


def ignore_condition(path: Column | str, patterns: tuple[str, ...] | list[str] = IGNORED) -> Column:
    """Whether a relative path is ignored: a segment equals a pattern, or the path or its last part matches its glob."""
    c = F.col(path) if isinstance(path, str) else path
    plain = [p.strip("/") for p in patterns if p.strip() and not p.startswith(("#", "!")) and not re.search(r"[*?\[]", p)]
    globs = [p for p in patterns if re.search(r"[*?\[]", p) and not p.startswith(("#", "!"))]
    hit = F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, plain))) if plain else F.lit(False)
    for g in globs:
        regex = fnmatch.translate(g).replace("\\z", "$").replace("\\Z", "$").removeprefix("(?s:").removesuffix(")$")
        hit = hit | F.element_at(F.split(c, "/"), -1).rlike(f"^(?s:{regex})$") | c.rlike(f"^(?s:{regex})$")
    for p in plain:
        if "/" in p:
            hit = hit | c.startswith(p + "/") | (c == p)
    return hit


def looks_binary(content: Column | str) -> Column:
    """A zero byte, or more than 30 percent of bytes that no text has, in the first 4096."""
    head = F.hex(F.substring(content, 1, 4096))
    pairs = F.regexp_extract_all(head, F.lit("([0-9A-F]{2})"), F.lit(1))
    odd = F.size(F.filter(pairs, lambda b: ((b < "20") & ~b.isin("07", "08", "09", "0A", "0C", "0D", "1B")) | (b == "7F")))
    return F.array_contains(pairs, "00") | (odd > 0.3 * F.size(pairs))


def scan_repository(spark: SparkSession, root: str, ignore: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """``path, language, content, hash, size_bytes`` of the source files below ``root``.

    Too large, secret, binary and ignored files and those of unknown language are left out before contents are decoded;
    bytes that are no UTF-8 become the replacement character. The repository's own ignore files count like ``ignore``.
    """
    base = "/" + PurePosixPath(root).as_posix().strip("/") + "/"
    ignore = [*(ignore or []), *own_patterns(spark, root)]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_BYTES)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), "")
    rows = raw.select(path.alias("path"), "content", F.col("length").alias("size_bytes")).withColumn("language", language_of("path"))
    rows = rows.where(F.col("language").isNotNull() & ~F.element_at(F.split("path", "/"), -1).isin(*SECRET_FILES) & ~ignore_condition("path", [*IGNORED, *(ignore or [])]))
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    rows = rows.where(~looks_binary("content"))
    return rows.select("path", "language", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"), "size_bytes")


def own_patterns(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the ignore files at the top of a repository."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found: list[str] = []
    for name in IGNORE_FILES:
        # readers of tables take names with a leading dot for hidden files, so the file system is asked
        path = jvm.org.apache.hadoop.fs.Path(root, name)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            stream = fs.open(path)
            try:
                found += gitignore_patterns(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return found


def file_at(files: DataFrame, path: str) -> DataFrame:
    """The row of one path."""
    return files.where(F.col("path") == path)


def hash_at(files: DataFrame, path: str) -> str | None:
    row = file_at(files, path).select("hash").first()
    return row["hash"] if row else None


def gitignore_patterns(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "!"))]


def within_limits(files: DataFrame, max_files: int = 10_000, max_bytes: int = 2_000_000) -> DataFrame:
    """One row: number of files, the largest, and whether both are allowed."""
    return files.agg(F.count("*").alias("n_files"), F.max("size_bytes").alias("largest")).withColumn(
        "allowed", (F.col("n_files") <= max_files) & (F.coalesce("largest", F.lit(0)) <= max_bytes)
    )


def unsafe_entries(archive: str, max_bytes: int = 200_000_000) -> list[str]:
    """Names in a ZIP archive that are absolute, climb out, are links or make it too large; nothing is extracted."""
    bad, total = [], 0
    with zipfile.ZipFile(archive) as z:
        for entry in z.infolist():
            total += entry.file_size
            path = PurePosixPath(entry.filename)
            if path.is_absolute() or ".." in path.parts or entry.external_attr >> 28 == 0xA or total > max_bytes:
                bad.append(entry.filename)
    return bad


def extract_archive(archive: str, folder: str, max_bytes: int = 200_000_000) -> list[str]:
    """Unpack a ZIP archive below ``folder`` and name the files; an archive with any unsafe entry is refused whole."""
    bad = unsafe_entries(archive, max_bytes)
    if bad:
        raise ValueError(f"unsafe entries: {', '.join(bad[:5])}")
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
        return sorted(e.filename for e in z.infolist() if not e.is_dir())


def clone_repository(url: str, folder: str, timeout: int = 300) -> str:
    """A shallow clone of a public repository; other addresses are refused before anything is run."""
    if not re.fullmatch(PUBLIC_URL, url):
        raise ValueError(f"not the address of a public repository: {url}")
    subprocess.run(["git", "clone", "--depth", "1", "--no-tags", "--single-branch", url, folder], check=True, capture_output=True, timeout=timeout, env={"GIT_TERMINAL_PROMPT": "0", "PATH": os.environ.get("PATH", "")})
    return folder


PUBLIC_URL = r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?(\.git)?/?"


def valid_repository_url(url: Column | str) -> Column:
    """An https address of a public repository host with owner and name and nothing else."""
    return (F.col(url) if isinstance(url, str) else url).rlike(f"^{PUBLIC_URL}$")


def package_scripts(files: DataFrame) -> DataFrame:
    """``path, script, command`` of the package manifests."""
    manifests = files.where(F.col("path").rlike(r"(^|/)package\.json$"))
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    return manifests.select("path", F.explode(scripts).alias("script", "command"))


def manifest_facts(files: DataFrame) -> DataFrame:
    """``path, fact, name``: what the manifests of a repository tell: scripts of packages, tools of a Python project, targets
    of a make file, and that there are modules of Go, Rust, Maven, Gradle or .NET."""
    last = F.element_at(F.split("path", "/"), -1)
    scripts = package_scripts(files).select("path", F.lit("script").alias("fact"), F.col("script").alias("name"))
    python = files.where(last == "pyproject.toml").select("path", F.lit("tool").alias("fact"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^\[tool\.([A-Za-z0-9_-]+)"), F.lit(1)))).alias("name"))
    make = files.where(last == "Makefile").select("path", F.lit("target").alias("fact"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^([A-Za-z][A-Za-z0-9_-]*):(?!=)"), F.lit(1)))).alias("name"))
    module = F.when(last == "go.mod", "go").when(last == "Cargo.toml", "cargo").when(last == "pom.xml", "maven").when(last.rlike(r"^build\.gradle(\.kts)?$"), "gradle").when(last.rlike(r"\.(csproj|sln)$"), "dotnet")
    modules = files.select("path", F.lit("module").alias("fact"), module.alias("name")).where("name is not null")
    return scripts.unionByName(python).unionByName(make).unionByName(modules)
