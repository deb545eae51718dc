"""Generated, minified, vendored and data files among source files, so that only hand-written source remains."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import salted_join
from tessera.session import cut_lineage

# Extensions of configuration and data files, which are never cases.
NOT_SOURCE = ("json", "yaml", "yml", "ini", "env", "toml", "xml", "md", "txt", "cfg", "properties", "gitattributes")

# The default attribute rules, which hold unless attribute files make an exception.
KNOWN_FOLDERS = ("node_modules", "bower_components", "vendor", "third_party", "thirdparty", "site-packages", "external", "deps", "__generated__")
KNOWN_NAMES = r"(?i)(\.min\.(js|ts|css)|\.bundle\.js|_pb2(_grpc)?\.py|\.pb\.(go|cc|h)|\.g\.(cs|dart)|\.designer\.cs|\.generated\.\w+|_generated\.\w+|\.gen\.(go|ts))$"

HEAD_LINES = 14
"""Lines whose comments are read even if code stands between them; the run of comments that begins a file is read whole."""

# what a tool writes at the head of a file that it made; each alternative must begin a comment line
GENERATED = re.compile(
    r"""(?ix)^(?:warning[!:]?\s+|note:\s+|this\s+(?:file|code|module)\s+(?:was|is|has\s+been)\s+)?
    (?:<auto-?generated\b|@generated\s+(?:by|from|\W*$)|@generated$
    |auto-?matically\s+generated\b|auto-?generated\s+(?:by|from|file|code|\W)(?!doc|method)|code\s+generated\s+by\s
    |generated\s+(?:automatically|code\b|file\b|from\s+\S+\s+by\s|by\s+(?:the\s+)?\S+(?:\s+v?\d|\s+from|\s*[;.,(]|$))
    |machine[\s-](?:written|generated|made)\b|all\s+changes\s+made\s+in\s+this\s+file\s+will\s+be\s+lost
    |output\s+of\s+\S+?\.?\s+edit\s|written\s+by\s+\S+\s+from\s
    |diese\s+datei\s+wurde\s+(?:automatisch|maschinell)|automatisch\s+(?:erzeugt|generiert)|nicht\s+(?:von\s+hand\s+)?bearbeiten
    |(?:ce\s+)?fichier\s+(?:a\s+[ée]t[ée]\s+)?g[ée]n[ée]r[ée]|(?:este\s+)?(?:archivo|fichero)\s+(?:fue\s+)?generado|generado\s+autom|g[ée]n[ée]r[ée]\s+autom
    |do\s+not\s+(?:edit|modify)(?:\s+(?:this\s+file|by\s+hand|manually)|\s*[.!;:]|\s*$))"""
)
#: what a file of another project says of itself
VENDORED = re.compile(
    r"""(?ix)^(?:vendored\s+(?:copy|from|version)|(?:imported|copied|taken|synced|mirrored)\s+(?:verbatim\s+)?from\s+(?:upstream|https?://|the\s+upstream)
    |third[\s-]party\s+(?:code|file|source|copy)|this\s+is\s+a\s+(?:vendored|third[\s-]party)
    |(?:!\s*)?[\w.\-@/]+\s+(?:-\s+)?(?:version\s+|v)\d+\.\d+[\w.\-]*(?:\s*\|.*|\s*)$|(?:!\s*)?[\w.\-@/]+\s+v?\d+\.\d+\.\d+\s*(?:\||,|\(|-).*licen[sc]e)"""
)
COMMENT_START = re.compile(r"^\s*(?://[/!]?|#+!?|/\*+!?|\*+|--|;+|<!--|'''|\"\"\")\s?")
PACKAGE = re.compile(r"^\s*package\s+[\w.]+\s*;?\s*$")
#: openings of comments of several lines, which leave the rest to the closing
BLOCK = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
SOURCE_MAP = re.compile(r"(?m)^//[#@] sourceMappingURL=")
WORDS = re.compile(r"[A-Za-z_$][\w$]*")
LITERAL = re.compile(r"""b?"(?:[^"\\\n]|\\.)*"|b?'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?<![\w.])[-+]?(?:0[xX][0-9A-Fa-f_]+|\d[\d_.eE]*)""")


def _template(line: str) -> str:
    indent = len(line) - len(line.lstrip())
    return f"{indent}:{WORDS.sub('w', LITERAL.sub('0', line.strip()))}"


def head_comments(lines: list[str]) -> Iterator[str]:
    """What the comment lines at the head of a file say: those of the leading run of comment, blank, shebang and package
    lines, however long, and those of the first ``HEAD_LINES`` lines. Inside a docstring only marked lines count."""
    closing, leading = "", True
    for i, line in enumerate(lines):
        if not leading and i >= HEAD_LINES:
            return
        m = COMMENT_START.match(line)
        inside = bool(closing)
        rest = line.strip()
        if inside:
            if closing in rest:
                closing = ""
        elif opened := next((o for o in BLOCK if rest.startswith(o)), None):
            closing = "" if BLOCK[opened] in rest[len(opened) :] else BLOCK[opened]
        elif rest and not m and not PACKAGE.match(line):
            leading = False
        if m or (inside and leading and closing not in ('"""', "'''")):
            yield line[m.end() if m else 0 :].strip(" \t*/-#!")


def judge(content: str) -> str | None:
    """What the content says: ``generated``, ``vendored``, ``minified``, ``data`` or nothing."""
    text = content.lstrip("﻿").replace("\r\n", "\n")
    lines = text.split("\n")
    for said in head_comments(lines):
        if not said:
            continue
        if GENERATED.search(said):
            return "generated"
        if VENDORED.search(said) or VENDORED.search("!" + said):
            return "vendored"
    full = [x for x in lines if x.strip()]
    size = len(text)
    if size < 120 or not full:
        return None
    blanks = sum(map(text.count, " \t\n")) / size
    words = WORDS.findall(LITERAL.sub("", text))
    short = sum(len(w) <= 2 for w in words) / max(1, len(words))
    if size / len(full) > 100 and blanks < 0.12 and short > 0.3 and len(words) > 20:
        return "minified"
    if SOURCE_MAP.search(text) and size / len(full) > 80:
        return "minified"
    literal = sum(len(x) for x in LITERAL.findall(text))
    packing = sum(map(text.count, " \t\n,[](){};"))
    if literal / size > 0.45 and (literal + packing) / size > 0.8 and size > 250 and len(set(words)) <= 25:
        return "data"
    if len(full) >= 10:
        templates = Counter(map(_template, full))
        ranked = [n for _, n in templates.most_common(8)]
        # long hand-written files repeat some lines too, but never nearly all of eight makes
        if sum(ranked[:3]) > 0.8 * len(full) or (len(full) >= 24 and sum(ranked) > 0.9 * len(full)):
            return "generated"
    return None


def _judge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "path": batch["path"], "said": [judge(c) if c else None for c in batch["content"]]})


def _extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def glob_to_regex(glob: Column) -> Column:
    """An attribute glob as a regular expression on the path below the attribute file's directory."""
    anchored = glob.contains("/")
    body = F.regexp_replace(glob, r"^/", "")
    body = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[!", "[^")
    body = F.regexp_replace(body, r"\*\*/", "\u0001")
    body = F.regexp_replace(body, r"\*\*", "\u0002")
    body = F.regexp_replace(body, r"\*", "[^/]*")
    body = F.regexp_replace(body, r"\?", "[^/]")
    body = F.regexp_replace(F.regexp_replace(body, "\u0001", "(?:.*/)?"), "\u0002", ".*")
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit("$"))


ATTRIBUTE = r"^([-!]?)(?:linguist-)?(generated|vendored)(?:=(\w+))?$"


def attribute_rules(files: DataFrame) -> DataFrame:
    """Rules of the repositories' attribute files: ``repo, directory, line, pattern, attribute, marked``.

    Generated and vendored are attributes of their own: a line gives one rule for each that it sets (true), unsets or
    negates (``-mark``, ``mark=false``: false) or takes back (``!mark``: null). Comments, blank lines and other
    attributes are left out. Of an attribute file that was indexed twice the row with the highest id counts.
    """
    latest = files.where(F.col("path").rlike(r"(^|/)\.gitattributes$")).groupBy("path").agg(F.max_by("content", "id").alias("content"))
    rows = latest.select(
        F.substring_index("path", "/", 1).alias("repo"),
        F.regexp_replace("path", r"[^/]*$", "").alias("directory"),
        F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r", ""), "\n")).alias("line", "text"),
    )
    quoted = F.regexp_extract("text", r'^\s*"((?:[^"\\]|\\.)*)"\s', 1)
    glob = F.when(quoted != "", quoted).otherwise(F.regexp_extract("text", r'^\s*([^\s#"!]\S*)\s', 1))
    told = rows.select("repo", "directory", "line", glob.alias("glob"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "word")).where("glob != ''")
    told = told.where(F.col("word").rlike(ATTRIBUTE))
    sign, value = F.regexp_extract("word", ATTRIBUTE, 1), F.regexp_extract("word", ATTRIBUTE, 3)
    marked = F.when(sign != "!", (sign == "") & ~value.isin("false", "unset"))
    rules = told.select("repo", "directory", "line", glob_to_regex(F.col("glob")).alias("pattern"), F.regexp_extract("word", ATTRIBUTE, 2).alias("attribute"), marked.alias("marked"), "place")
    # the last word of a line on an attribute counts
    return rules.groupBy("repo", "directory", "line", "pattern", "attribute").agg(F.max_by(F.struct("marked"), "place")["marked"].alias("marked"))


def directories_above(path: Column | str) -> Column:
    """The directories that hold a path, each with its last slash; ``''`` is the topmost."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("", F.transform(F.slice(parts, 1, i), lambda p: F.concat(p, F.lit("/")))))


def apply_attributes(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, marked`` of the files that a rule matches. For each attribute the deepest directory's rule wins, then the
    latest line; a file is marked if either attribute is set, and unmarked if one is unset and none set.

    Files meet the rules of the directories above them, one row per attribute file, so a repository with very many
    files or rules is no group; directories that hold very many files are salted.
    """
    per_directory = rules.groupBy("directory").agg(F.collect_list(F.struct("line", "pattern", "attribute", "marked")).alias("rules"))
    above = files.select("id", "path", F.explode(directories_above("path")).alias("directory"))
    weights = above.join(per_directory.select("directory"), "directory", "left_semi").groupBy("directory").agg(F.count("*").alias("n"))
    keyed = cut_lineage(per_directory.join(weights, "directory"))
    met = salted_join(above, keyed, "directory", weight="n", salt="id").select(
        "id", F.expr("filter(rules, r -> rlike(substring(path, length(directory) + 1), r.pattern))").alias("rules"), F.length("directory").alias("depth")
    )
    hits = met.select("id", "depth", F.inline("rules"))
    # an unspecified attribute has to outrank shallower rules too, so the deciding rule is taken as a struct
    decided = hits.groupBy("id", "attribute").agg(F.max_by(F.struct("marked"), F.struct("depth", "line"))["marked"].alias("marked"))
    return decided.groupBy("id").agg(F.max("marked").alias("marked")).where("marked is not null")


def mine_folders(folders: DataFrame, least: int = 6, share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Folder names whose files are mostly not hand-written, and pairs of folders that are exceptions to them.

    ``folders`` has ``folder`` (the path without the file), ``n`` and ``n_said`` (files whose content or attribute file
    says so) and may have ``n_unset`` (files of which an attribute file says that they are hand-written). The known names
    are always kept, others, counted outside the known ones, with at least ``least`` files of which more than ``share`` say so. An exception is a kept name
    with a child folder of at least ``least`` files of which nearly none says so; as third-party copies need not name
    themselves, below a known name only attribute files make one, by unsetting most of the child's files.
    """
    if "n_unset" not in folders.columns:
        folders = folders.withColumn("n_unset", F.lit(0))
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    listed = folders.select(inner.alias("parts"), "n", "n_said", "n_unset")
    known = F.col("name").isin(*KNOWN_FOLDERS)
    # what lies below a known folder tells nothing of other names there
    outer = F.filter("parts", lambda x, i: ~F.arrays_overlap(F.slice("parts", F.lit(1), i), F.array(*map(F.lit, KNOWN_FOLDERS))))
    singles = listed.select(F.explode(F.array_distinct(outer)).alias("name"), "n", "n_said").groupBy("name").agg(
        F.sum("n").alias("n"), F.sum("n_said").alias("n_said")
    )
    kept = singles.where(known | ((F.col("n") >= least) & (F.col("n_said") > share * F.col("n")))).select("name")
    pairs = listed.where(F.size("parts") > 1).select(
        F.explode(F.arrays_zip(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("a"), F.slice("parts", F.lit(2), F.size("parts") - 1).alias("b"))).alias("p"), "n", "n_said", "n_unset"
    )
    silent = (F.col("n") >= least) & (F.col("n_said") < 0.05 * F.col("n"))
    exceptions = (
        pairs.groupBy(F.col("p.a").alias("name"), F.col("p.b").alias("child"))
        .agg(F.sum("n").alias("n"), F.sum("n_said").alias("n_said"), F.sum("n_unset").alias("n_unset"))
        .where(F.when(known, 2 * F.col("n_unset") > F.col("n")).otherwise(silent))
        .join(kept, "name", "left_semi")
        .where(~F.col("child").isin(*KNOWN_FOLDERS))
        .select("name", "child")
    )
    return kept, exceptions


def name_tail(path: Column | str) -> Column:
    """The end of a file name that a glob like ``*_pb2.py`` stands for: its last part before the extension, with what
    parts it off, and the extension; empty where the name has one part only."""
    return F.lower(F.regexp_extract(path, r"[^/]([._\-][A-Za-z0-9]+\.[A-Za-z0-9]+)$", 1))


def mine_names(seen: DataFrame, says: Column, least: int = 6, share: float = 0.5) -> DataFrame:
    """Ends of file names (``tail``, ``n``) that mostly files have which say so: globs equivalent to attribute rules."""
    tails = seen.select(name_tail("path").alias("tail"), says.alias("says")).where("tail != ''").groupBy("tail").agg(F.count("*").alias("n"), F.sum("says").alias("n_said"))
    return tails.where((F.col("n") >= least) & (F.col("n_said") > share * F.col("n"))).select("tail", "n")


def find_not_handwritten(files: DataFrame) -> DataFrame:
    """``file_id, reason`` of the source files that a tool made, that are minified, third-party or data.

    ``reason`` is ``declared`` where the attribute files of the repository mark the file. Repositories without such
    files get the equivalent patterns that are mined over all repositories: folders and ends of names whose files mostly
    declare themselves or are marked elsewhere, and the well-known ones (``place``). Else the content decides by what it
    says of itself: a tool's or another project's head comment, minified text, tables of data, lines all of one make.
    A file that attributes unmark is no case. Configuration files are never cases; null or empty contents are judged by
    place alone; rows with a null path are left out; repeated files count each; the recorded size plays no part, since
    it is unreliable.
    """
    chosen = files.select("id", "path", "content").where("path is not null")
    rules = attribute_rules(chosen)
    source = chosen.where(~_extension("path").isin(*NOT_SOURCE))
    judged = cut_lineage(source.mapInPandas(_judge_batches, "id long, path string, said string").withColumn("folder", F.regexp_replace("path", r"[^/]*$", "")))
    marked = cut_lineage(apply_attributes(judged.select("id", "path"), rules))
    seen = judged.join(marked, "id", "left")
    says = F.coalesce("marked", F.col("said").isNotNull()).cast("long")
    unset = F.coalesce(~F.col("marked"), F.lit(False)).cast("long")
    folders = seen.groupBy("folder").agg(F.count("*").alias("n"), F.sum(says).alias("n_said"), F.sum(unset).alias("n_unset"))
    kept, exceptions = mine_folders(folders)
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    steps = folders.select("folder", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("depth", "name"))
    nexts = steps.withColumn("child", F.lead("name").over(Window.partitionBy("folder").orderBy("depth")))
    matched = nexts.join(kept, "name").join(exceptions.withColumn("except", F.lit(True)), ["name", "child"], "left")
    placed = matched.groupBy("folder").agg(F.max_by(F.col("except").isNull(), "depth").alias("by_place"))
    # repositories that declare their own rules take no mined ones
    declared = rules.select("repo").distinct().withColumn("declared", F.lit(True))
    judging = folders.join(placed, "folder", "left").withColumn("repo", F.substring_index("folder", "/", 1)).join(declared, "repo", "left")
    judging = cut_lineage(judging.where("by_place or declared").select("folder", "n", "by_place", "declared"))
    in_place = salted_join(judged.select("id", "folder"), judging, "folder", weight="n", salt="id").select("id", "by_place", "declared").dropDuplicates(["id"])
    tailed = judged.select("id", name_tail("path").alias("tail")).where("tail != ''")
    by_name = salted_join(tailed, cut_lineage(mine_names(seen, says)), "tail", weight="n", salt="id").select("id", F.lit(True).alias("by_name")).dropDuplicates(["id"])
    verdict = seen.join(in_place, "id", "left").join(by_name, "id", "left")
    mined = F.coalesce("by_place", F.lit(False)) | F.coalesce("by_name", F.lit(False)) | F.col("path").rlike(KNOWN_NAMES)
    reason = (
        F.when(~F.col("marked"), None)
        .when(F.col("marked"), "declared")
        .when(F.col("declared").isNull() & mined, "place")
        .otherwise(F.col("said"))
    )
    return verdict.select(F.col("id").alias("file_id"), reason.alias("reason")).where("reason is not null")
