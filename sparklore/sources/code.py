"""Source trees: scan, classify and parse files, cut chunks, and merge changed files into tables."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by file extension, and folders that are never read.
LANGUAGES = {"rs": "rust", "py": "python", "php": "php", "phtml": "php", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "html": "html", "htm": "html"}
EXCLUDED = (
    "target", "dist", "build", ".git", ".svn", "node_modules", "vendor", ".venv", "venv", "site-packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".idea",
    ".cache", ".local", ".cargo", ".rustup", ".npm", ".nvm", ".yarn", ".pnpm-store", ".bun", ".deno", ".gradle", ".m2", ".conda", ".pyenv", ".rbenv", ".gem",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".terraform", ".direnv",
)
MAX_BYTES = 1_500_000
CHUNK_BYTES, OVERLAP_BYTES = 24_000, 200
SYMBOLS = "kind string, name string, qualified_name string, line_start int, line_end int, receiver string, caller string, docstring string"


def language_for(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.get(F.filter(F.array(*[F.when(extension == k, v) for k, v in LANGUAGES.items()]), lambda x: x.isNotNull()), F.lit(0))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, language, content_hash, size and source of every supported file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("rel", F.regexp_replace("path", r"^[a-z]+:/+", "/"))
    inside = F.split(F.regexp_replace("rel", "^" + root.rstrip("/") + "/", ""), "/")
    kept = files.filter(~F.arrays_overlap(inside, F.array(*map(F.lit, EXCLUDED))) & language_for(F.col("rel")).isNotNull() & (F.col("length") <= MAX_BYTES))
    return kept.select(F.array_join(inside, "/").alias("path"), language_for(F.col("rel")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.col("content").cast("string").alias("source"))


def parse_python(source: str) -> list[tuple]:
    """Functions, classes, imports and calls of a module; a file with errors has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    rows: list[tuple] = []

    def visit(node: ast.AST, owner: str, function: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                rows.append(("function", child.name, name, child.lineno, child.end_lineno, None, None, ast.get_docstring(child)))
                visit(child, owner, name)
            elif isinstance(child, ast.ClassDef):
                rows.append(("class", child.name, child.name, child.lineno, child.end_lineno, ",".join(ast.unparse(b) for b in child.bases) or None, None, ast.get_docstring(child)))
                visit(child, child.name, function)
            else:
                if isinstance(child, ast.Import):
                    rows.extend(("import", a.name, a.name, child.lineno, child.end_lineno, a.asname, None, None) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    module = "." * child.level + (child.module or "")
                    rows.extend(("import", a.name, f"{module}.{a.name}", child.lineno, child.end_lineno, a.asname, None, None) for a in child.names)
                elif isinstance(child, ast.Call) and function:
                    target = child.func
                    if isinstance(target, ast.Attribute):
                        rows.append(("call", target.attr, target.attr, child.lineno, child.end_lineno, ast.unparse(target.value), function, None))
                    elif isinstance(target, ast.Name):
                        rows.append(("call", target.id, target.id, child.lineno, child.end_lineno, None, function, None))
                visit(child, owner, function)

    visit(tree, "", "")
    return rows


def parse(files: DataFrame) -> DataFrame:
    """path and SYMBOLS of every Python file; other languages carry metadata only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[x.split()[0] for x in SYMBOLS.split(", ")]]
        for frame in frames:
            yield pd.DataFrame([(p, *row) for p, s in zip(frame["path"], frame["source"], strict=True) for row in parse_python(s)], columns=names)

    return files.filter("language = 'python'").select("path", "source").mapInPandas(run, "path string, " + SYMBOLS)


def split_body(text: str, budget: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Pieces within the byte budget, cut at line ends (an overlong line is cut itself), each opening with the end of the one before."""
    if len(text.encode()) <= budget:
        return [text]
    room, lines = budget - overlap, []
    for line in text.splitlines(keepends=True):
        while len(line.encode()) > room:
            head = line.encode()[:room].decode(errors="ignore")
            lines.append(head)
            line = line[len(head) :]
        lines.append(line)
    parts, now = [], ""
    for line in lines:
        if now and len((now + line).encode()) > room:
            parts.append(now)
            now = ""
        now += line
    parts.append(now)
    tails = ["", *(p.encode()[-overlap:].decode(errors="ignore") for p in parts)]
    return [tail + p for tail, p in zip(tails, parts, strict=False)]


def chunks(symbols: DataFrame, header: str, body: str, key: str) -> DataFrame:
    """(key, part, parts, chunk_text, content_hash) of every symbol."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, h, b in zip(frame["k"], frame["h"], frame["b"], strict=True):
                pieces = split_body(b or "")
                for i, piece in enumerate(pieces, 1):
                    whole = f"{h}{f' part {i}/{len(pieces)}' if len(pieces) > 1 else ''}\n{piece}"
                    rows.append((k, i, len(pieces), whole, hashlib.sha256(whole.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[key, "part", "parts", "chunk_text", "content_hash"])

    return symbols.select(F.col(key).cast("string").alias("k"), F.col(header).alias("h"), F.col(body).alias("b")).mapInPandas(run, f"{key} string, part int, parts int, chunk_text string, content_hash string")


def classify(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action): new and changed files are indexed again, equal ones kept, missing ones deleted."""
    both = disk.select("path", F.col("content_hash").alias("h")).join(known.select("path", F.col("content_hash").alias("k")), "path", "full_outer")
    return both.select("path", F.when(F.col("h").isNull(), "delete").when(F.col("k").isNull(), "new").when(F.col("h") != F.col("k"), "reindex").otherwise("unchanged").alias("action"))


def merge_paths(existing: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace all rows of the changed paths."""
    return existing.join(changed.select("path").distinct(), "path", "left_anti").unionByName(fresh)
