"""Source files that are not valid in their language, by packrat grammars."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexing import CONFLICT, LexError

# Language names by file extension, and spellings of the language column.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "java": "java",
    "go": "go", "cs": "csharp", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "json": "json",
}
SPELLINGS = {"python3": "python", "golang": "go", "c#": "csharp", "node": "javascript"}


@functools.cache
def _parser(language: str):
    from tessera.llm.grammars import compiled as c
    from tessera.llm.grammars import scripts as s

    return {
        "python": (s.python_lexer, s.PYTHON), "javascript": (s.JS_LEXER, s.JAVASCRIPT), "typescript": (s.JS_LEXER, s.TYPESCRIPT),
        "json": (s.JSON_LEXER, s.JSON), "java": (c.JAVA_LEXER, c.JAVA), "go": (c.go_lexer, c.GO), "csharp": (c.CSHARP_LEXER, c.CSHARP),
        "rust": (c.RUST_LEXER, c.RUST), "kotlin": (c.KOTLIN_LEXER, c.KOTLIN),
    }[language]


def language_of(path: str | None, language: str | None) -> str | None:
    """The language that the extension stands for; without one, what the language column says."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    if "." in name:
        return LANGUAGES.get(name.rsplit(".", 1)[-1])
    said = (language or "").strip().lower()
    said = SPELLINGS.get(said, LANGUAGES.get(said, said))
    return said if said in LANGUAGES.values() else None


def is_valid(text: str, language: str) -> bool:
    """Whether the grammar consumes the whole text, without asking where and why it doesn't."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    lexer, grammar = _parser(language)
    try:
        tokens = lexer(text.removeprefix("\ufeff"))
    except LexError:
        return False
    return all(k in ("EOF", "NEWLINE") for k in tokens.kinds) or grammar.parse(tokens.kinds, tokens.values, tokens.breaks)


def failure(text: str, language: str) -> tuple[int, str] | None:
    """Nothing if the whole text is valid, else the furthest offset that was reached and what went wrong."""
    text = text.removeprefix("﻿")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    lexer, grammar = _parser(language)
    try:
        tokens = lexer(text)
    except LexError as e:
        return e.at, _cause(text, e.at, e.cause)
    if all(k in ("EOF", "NEWLINE") for k in tokens.kinds):
        return None
    if grammar.parse(tokens.kinds, tokens.values, tokens.breaks):
        return None
    furthest = min(grammar.furthest(tokens.kinds, tokens.values, tokens.breaks), len(tokens.kinds) - 1)
    at = tokens.offsets[furthest]
    return at, _cause(text, at, "unexpected end" if tokens.kinds[furthest] == "EOF" else "unexpected token")


def _cause(text: str, at: int, cause: str) -> str:
    """A merge conflict if a conflict mark stands at the failure or is the last one before it, else ``cause``."""
    line = text.rfind("\n", 0, at) + 1
    if CONFLICT.match(text, line) or CONFLICT.match(text, at):
        return "merge conflict"
    if at >= len(text.rstrip()) and cause != "unterminated literal or comment":
        return "unexpected end"
    return cause


def diagnose(text: str, language: str) -> tuple[int, int, str] | None:
    """Line and column (from 1) of the furthest failure with its cause; another language's file is named as such."""
    found = failure(text, language)
    if not found:
        return None
    at, cause = found
    if cause in ("unexpected token", "unexpected character"):
        for other in ("python", "typescript", "java", "go", "csharp", "rust", "kotlin"):
            if other != language and is_valid(text, other):
                cause = f"written in {other}"
                break
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), cause


def check_files(files: DataFrame, causes: bool = True) -> DataFrame:
    """``file_id, repo, language, valid, line_no, column_no, cause`` for each file of a language that is judged.

    The language is that of the extension (the language column counts only where there is none); other files are left
    out. Null and empty contents, files of comments only and a leading byte order mark are valid. Repeated files count
    each; a null path without a language is left out. Texts are read whole. Without ``causes`` place and cause stay null,
    and no file is parsed a second time for them.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, path, said, text in zip(batch["id"], batch["path"], batch["language"], batch["content"]):
                language = language_of(path, said)
                if language and not causes:
                    blank = not text or not text.strip("﻿ \t\r\n")
                    rows.append((i, (path or "").split("/", 1)[0], language, blank or is_valid(text, language), None, None, None))
                elif language:
                    found = diagnose(text, language) if text and text.strip("﻿ \t\r\n") else None
                    rows.append((i, (path or "").split("/", 1)[0], language, found is None, *(found or (None, None, None))))
            frame = pd.DataFrame(rows, columns=["file_id", "repo", "language", "valid", "line_no", "column_no", "cause"])
            yield frame.astype({"line_no": "Int32", "column_no": "Int32"})

    schema = "file_id long, repo string, language string, valid boolean, line_no int, column_no int, cause string"
    return files.select("id", "path", "language", "content").mapInPandas(check, schema)


def rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language, with the share and the most frequent cause."""
    per_cause = checked.groupBy("repo", "language", "cause").agg(F.count("*").alias("n"))
    broken: Column = F.when(F.col("cause").isNotNull(), F.col("n")).otherwise(0)
    return per_cause.groupBy("repo", "language").agg(
        F.sum("n").alias("n_files"),
        F.sum(broken).alias("n_invalid"),
        F.round(F.sum(broken) / F.sum("n"), 6).alias("share"),
        F.max_by("cause", F.when(F.col("cause").isNotNull(), F.struct("n", "cause"))).alias("main_cause"),
    )
