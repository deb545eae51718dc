"""Credentials in source and configuration: found with one automaton, redacted in place."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automaton import Automaton

SLICE_BYTES = 4 << 20
"""Text scanned at once in a Python worker; a longer single text forms a slice of its own."""

# Words that name a credential, as the last part of an identifier.
SECRET_WORDS = "password|passwd|passphrase|passwort|contrasena|pwd|pass|pw|secret|token|api_?key|apikey|access_?key|secret_?key|private_?key|auth_?key|encryption_?key|signing_?key|credential|credentials|creds"

# Whole values that stand for a credential without being one.
PLACEHOLDERS = frozenset(
    "changeme change-me change_me changeit redacted dummy example sample placeholder not-a-secret notasecret none null nil true false todo tbd fixme "
    "password passwort passwd secret token bearer basic test testing default undefined empty unset hidden masked removed replaceme replace-me "
    "your-token your_token your-password yourpassword mysecret my-secret insert-here foo bar foobar string xxx".split()
)

# Formats of tokens. The first two characters of the variable part already tell where a token may begin.
TOKENS = [
    ("cloud", r"(AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}"),
    ("forge", r"(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{20,})"),
    ("chat", r"xox[abeprs]-[0-9A-Za-z\-]{16,}"),
    ("live", r"[a-z]{2,8}_live_[0-9A-Za-z]{14,}"),
    ("search", r"AIza[0-9A-Za-z_\-]{30,}"),
    ("mail", r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}"),
    ("package", r"(npm_[0-9A-Za-z]{30,}|pypi-[0-9A-Za-z_\-]{40,}|hvs\.[0-9A-Za-z_\-]{20,})"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
]
#: the whole of a key in armor: five hyphens in a row only stand at its head and its end
ARMOR = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----([^\-]|-[^\-]|--[^\-]|---[^\-]|----[^\-])*-----END [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"
#: from the end of the scheme to the end of the password; a password may hold further at signs
CONNECTION = r"""://[^\s\n\r/@:"'`<>]*:[^\s\n\r"'`/@]+(@[^\s\n\r"'`/@]+)*@"""
# the first patterns end where a credential ends and give its span; the others end where one may be read from
PATTERNS = [
    *((name, pattern, False) for name, pattern in TOKENS),
    ("armor", ARMOR, False),
    ("url", CONNECTION, False),
    ("joined", r"(AKIA|ASIA|AROA|AIDA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[a-z]_live_|AIza|SG\.|npm_|pypi-|hvs\.|eyJ)[0-9A-Za-z_\-]*[\"'`][ \t]*(\+|\.\.|\.)?[ \t]*\\?\n?[ \t]*[\"'`]", False),
    ("named", rf"({SECRET_WORDS})[\w.\-]*[\"'\]\s]*[:=]", True),
    ("query", r"[?&;]\w*(token|key|secret|password|pwd|sig|signature)=", True),
    ("header", r"(basic|bearer|token)\s\w", True),
    ("login", r"\s-(-user|u)[\s=][\"']?[\w.\-]+:", False),
    ("option", rf"--[\w\-]*({SECRET_WORDS})[\s=]", True),
    ("remark", rf"({SECRET_WORDS}|login)", True),
]
BIT = {p[0]: i for i, p in enumerate(PATTERNS)}
SPANS = len(TOKENS) + 3
"""The first patterns, whose matches are spans."""


@functools.cache
def _automaton() -> Automaton:
    return Automaton(PATTERNS)


#: the same formats on a line whose joined literals are put together
TOKEN = re.compile("|".join(pattern for _, pattern in TOKENS))
#: what a token consists of, and what stands between the literals of one that is written in pieces
PIECE = re.compile(r"[0-9A-Za-z_\-.]+")
JOINT = re.compile(r"""(["'`])[ \t]*(?:\+|\.\.|\.)?[ \t]*\\?\n?[ \t]*(["'`])""")
#: what stands between a literal and one that is added to it
ADDED = re.compile(r"""[ \t]*(?:[+.][ \t]*(?:\r?\n[ \t]*)?|\\?\r?\n[ \t]*[+.][ \t]*)(["'`])""")
#: the same in the arguments of a macro that concatenates them
CONCAT, LISTED = re.compile(r"""\s*concat!\s*\(\s*(["])"""), re.compile(r"""\s*,\s*(["])""")
HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
NAMED = re.compile(
    rf"""(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)["'\]]*\s*(?::\s*[A-Za-z&'?\[\]<>]+(?:[ \t]+[A-Za-z]+)?\s*(?==))?(?P<sep>:=|=>|=(?!=)|:(?!:))[ \t]*
    (?P<open>(?:[rbuf]|@|r\#+)?(?P<q>\"\"\"|'''|["'`]))?""",
    re.X,
)
NAME_OK = re.compile(
    rf"""(?:^|[_\-.]|(?<=[a-z0-9])(?=[A-Z]))(?i:{SECRET_WORDS})(?:[_\-](?:[a-z]|old|new|prod|dev|staging|live|test|value|hash_key|\d+))?\d*$""", re.X
)
QUERY = re.compile(r"""[?&;]\w*(?i:token|key|secret|password|pwd|sig|signature)=(?P<v>[^\s"'`&;<>]+)""")
HEADER = re.compile(r"""(?:["'\s])(?i:basic|bearer|token)\s+(?P<v>[A-Za-z0-9+/_=.\-]{12,})""")
REMARK = re.compile(rf"""(?i:\b(?:{SECRET_WORDS}|logins?)\b)[^\n]{{0,60}}?(?:\s(?:was|is|are|now)\s+|->\s*|\s/\s|=\s*|:\s+)(?P<v>[^\s"'`,;)]+)[ \t\r*/#\->]*$""")
#: what a command is given after the name of a login or after an option that asks for a secret
GIVEN = re.compile(r"""["']?(?P<v>[^\s"'`]+)""")
BARE, BARE_CODE = re.compile(r"[^\s\"'`,]+"), re.compile(r"[^\s\"'`,;)\]}&]+")
COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|''')|(?:\s//|\s#)\s")
# Extensions of languages in which a value must be a literal.
CODE = frozenset("py js ts tsx jsx java go cs rs kt c cc cpp h rb php swift scala".split())
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


def _usable(value: str, weak: bool = False) -> bool:
    """Whether a value can be a credential. ``weak``: the place says little, so the value itself must look the part."""
    v = value.strip()
    low = v.lower()
    if len(v) < 6 or re.search(r"\s", v) or low in PLACEHOLDERS or len(set(low)) < 4:
        return False
    if re.search(r"\$\{|\$\(|\{\{|%\(|\$[A-Z_]|<[^>]*>|^\[.*\]$|^\*+|\.\.\.|…", v) or re.match(r"(?i)(vault|env|secret|ssm|arn|file|ref|kms|op|sha\d+|md5|data)[:\-/]", v):
        return False
    if re.search(r"(?i)your[_\-]|[_\-]here$|x{4,}|placeholder|redacted|change_?me|not[_\-]a[_\-]|dummy|example[_\-]|fake", v):
        return False
    if UUID.fullmatch(v) or re.match(r"(?:[a-z][a-z0-9+.\-]*:)?//|/|\./|~/", v) or re.fullmatch(r"[a-z]+(?:/[a-z_\-]+)+", v):
        return False
    if v.startswith("-----BEGIN") or re.search(r"^[\w.]+\(|\bos\.|process\.|getenv|environ", v):
        return False
    digit, upper, lower = re.search(r"\d", v), re.search(r"[A-Z]", v), re.search(r"[a-z]", v)
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z]{2,}[a-z]", v))
    mark = re.search(r"[^A-Za-z0-9_\-.]", v)
    if weak:
        return bool(digit and (upper or lower) and len(v) >= 8 and not re.fullmatch(r"[a-z]+\d{0,3}", v))
    if digit and (upper or lower):
        return True
    return bool((mark and (lower or upper) and len(v) >= 7) or (upper and lower and turns >= 2 and len(v) >= 8 and not v.isalpha()) or (v.isalpha() and turns >= 3 and len(v) >= 10))


def _joined(text: str, begin: int, quote: str, sign: str = "+.") -> tuple[str, list[tuple[int, int]]] | None:
    """The value of a string literal from ``begin`` (after its quote), with further literals that are added to it by ``sign``."""
    parts, value, at = [], "", begin
    while True:
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        end = text.find(quote, at, stop)
        while end > 0 and len(quote) == 1 and text[end - 1] == "\\":
            end = text.find(quote, end + 1, stop)
        if end < 0:
            return (value, parts) if parts else None
        value += text[at:end]
        parts.append((at, end))
        more = (LISTED if sign == "," else ADDED).match(text, end + len(quote))
        if not more:
            return value, parts
        quote, at = more.group(1), more.end()


def _exact(text: str, begin: int, end: int, kind: str) -> tuple[tuple[int, int], str] | None:
    """The credential inside a match of the automaton, and its kind, if it is a usable one."""
    if kind == "armor":
        head = HEAD.match(text, begin)
        stop = text.rfind("-----END ", begin, end)
        body = text[head.end() : stop]
        if text[stop + 9 : end - 5] == head.group(1) and len(re.findall(r"[A-Za-z0-9+/=]", body.replace("\\n", ""))) >= 48 and len(set(body)) > 12:
            return (head.end(), stop), "private key"
    elif kind == "url":
        v = text.index(":", begin + 3) + 1
        value = text[v : end - 1]
        if begin and text[begin - 1].isalnum() and len(value) >= 4 and not re.search(r"\s|\$|\{|<|%\w*\(|^\*+$|^x+$", value) and value.lower() not in PLACEHOLDERS and len(set(value)) > 2:
            return (v, end - 1), "connection"
    else:
        value = text[begin:end]
        if kind == "cloud" and text[end : end + 1].isalnum() or kind == "live" and begin and re.match(r"\w", text[begin - 1]):
            return None
        if _usable(value) or value.count(".") == 2:
            return (begin, end), "token"
    return None


class _Line:
    """One line of a text with what is asked of it again and again, each found once."""

    def __init__(self, text: str, start: int, end: int):
        self.start, self.end, self.line = start, end, text[start:end]
        self.done: set[str] = set()

    @functools.cached_property
    def comment(self) -> bool:
        return bool(COMMENT.search(self.line))

    @functools.cached_property
    def quotes(self) -> list[list[int]]:
        return [[i for i, c in enumerate(self.line) if c == q] for q in "\"'`"]

    def in_string(self, at: int) -> bool:
        return any(bisect.bisect_left(places, at - self.start) % 2 for places in self.quotes)


def _named_at(text: str, end: int, line: _Line, extension: str) -> list[tuple[int, int]] | None:
    """The value that is given to the name whose separator ends at ``end``."""
    at = end - 1
    while at > line.start and text[at - 1] in " \t\"']":
        at -= 1
    begin = at
    while begin > line.start and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in "_.-"):
        begin -= 1
    while begin < at and not (text[begin].isalpha() or text[begin] == "_"):
        begin += 1
    m = NAMED.match(text, begin)
    if not m or not NAME_OK.search(m.group("name")):
        return None
    listed = CONCAT.match(text, m.end())
    if m.group("q") or listed:
        got = _joined(text, listed.end(), listed.group(1), ",") if listed else _joined(text, m.end(), m.group("q"))
        return got[1] if got and _usable(got[0]) else None
    v = (BARE_CODE if extension in CODE else BARE).match(text, m.end(), max(line.end, m.end()))
    if v and (extension not in CODE or line.comment or line.in_string(begin)) and not re.match(r"[\w.]+\(|[\[{(]", v.group(0)) and _usable(v.group(0).rstrip(".")):
        return [(v.start(), v.end())]
    return None


def _read_from(text: str, line: _Line, kinds: set[str]) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Credentials of a line that has hits of ``kinds``, each kind being read once per line."""
    kinds = kinds - line.done
    line.done |= kinds
    if "query" in kinds:
        for m in QUERY.finditer(line.line):
            if _usable(m.group("v"), weak=True):
                yield [(line.start + m.start("v"), line.start + m.end("v"))], "query"
    if "header" in kinds:
        for m in HEADER.finditer(line.line):
            if _usable(m.group("v"), weak=True) and not re.search(r"(?i)[\"'\s](?:token)\s+[a-z]+[_\-]", m.group(0)):
                yield [(line.start + m.start("v"), line.start + m.end("v"))], "header"
    if "remark" in kinds and line.comment:
        m = REMARK.search(line.line)
        if m and _usable(m.group("v"), weak=True):
            yield [(line.start + m.start("v"), line.start + m.end("v"))], "remark"


def _joined_token(text: str, begin: int) -> list[tuple[int, int]] | None:
    """The parts of a token that begins at ``begin`` and is written as literals that are joined."""
    parts, at = [], begin
    while piece := PIECE.match(text, at):
        parts.append(piece.span())
        joint = JOINT.match(text, piece.end())
        if not joint:
            break
        at = joint.end()
    whole = TOKEN.match("".join(text[a:b] for a, b in parts))
    if not whole or len(parts) < 2:
        return None
    left, held = whole.end(), []
    for a, b in parts:
        if left > 0:
            held.append((a, min(b, a + left)))
            left -= b - a
    return held if len(held) > 1 else None


def find_in(text: str, spans: list[tuple[int, int, str]], hits: list[tuple[int, int]], extension: str, breaks: np.ndarray) -> list[tuple[int, list[tuple[int, int]], str]]:
    """Credentials of one text from the automaton's spans (start, end, kind) and its other hits (end offset, bit set), in
    characters: line, parts and kind. ``breaks`` are the offsets of its line feeds.

    Spans are absolute, so what two overlapping chunks or two patterns saw is kept once; of overlapping spans the one
    that starts first, then the longest, stays.
    """
    found: dict[tuple, str] = {}
    for begin, end, kind in spans:
        if kind == "joined":
            if parts := _joined_token(text, begin):
                found.setdefault(tuple(parts), "token")
            continue
        got = _exact(text, begin, end, kind)
        if got:
            found.setdefault((got[0],), got[1])
    line: _Line | None = None
    for end, mask in hits:
        if line is None or not line.start < end <= line.end:
            n = int(np.searchsorted(breaks, end - 1))
            line = _Line(text, int(breaks[n - 1]) + 1 if n else 0, int(breaks[n]) if n < len(breaks) else len(text))
        kinds = {name for name, bit in BIT.items() if mask >> bit & 1}
        for parts, kind in _read_from(text, line, kinds & {"query", "header", "remark"} | ({"remark"} if "named" in kinds else set())):
            found.setdefault(tuple(parts), kind)
        if kinds & {"login", "option"} and (given := GIVEN.match(text, end, max(line.end, end))) and _usable(given.group("v"), weak=True):
            found.setdefault((given.span("v"),), "login")
        if "named" in kinds and (parts := _named_at(text, end, line, extension)):
            found.setdefault(tuple(parts), "value")
    result, busy = [], -1
    for parts, kind in sorted(found.items(), key=lambda x: (x[0][0][0], -x[0][-1][1])):
        if parts[0][0] >= busy:
            result.append((int(np.searchsorted(breaks, parts[0][0])) + 1, list(parts), kind))
            busy = parts[-1][1]
    return result


def redact(text: str, spans: list[tuple[int, list[tuple[int, int]], str]]) -> str:
    """``text`` with each part replaced by a placeholder without quotes, blanks or line ends."""
    out, last = [], 0
    for _, parts, kind in spans:
        for begin, end in parts:
            out += [text[last:begin], f"REDACTED_{kind.upper().replace(' ', '_')}"]
            last = end
    return "".join([*out, text[last:]])


def scan(texts: list[str], extensions: list[str]) -> list[list[tuple[int, list[tuple[int, int]], str]]]:
    """``find_in`` for many texts with one run of the automaton per slice of them.

    Offsets in characters and line feeds come from two cumulative looks at the slice's bytes, so the work is linear in
    the length of the texts whatever they hold.
    """
    auto = _automaton()
    results: list[list] = [[] for _ in texts]
    encoded = [t.encode("utf-8", "surrogatepass").replace(b"\0", b" ") for t in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(encoded[j]) < SLICE_BYTES):
            size += len(encoded[j]) + 1
            j += 1
        buffer = np.frombuffer(b"\0".join(encoded[i:j]), np.uint8)
        ends, masks = auto.find(buffer)
        starts = np.cumsum([0, *(len(x) + 1 for x in encoded[i:j])])
        cuts = np.searchsorted(ends, starts, side="right")
        held = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(held):
            spans = _spans(auto, auto.classes[buffer], ends, masks)
            characters = np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)]
            feeds = np.flatnonzero(buffer == 10)
            owners = np.searchsorted(starts, [s[0] for s in spans], side="right") - 1
            span_cuts = np.searchsorted(owners, np.arange(j - i + 1))
            for k in held.tolist():
                zero = int(characters[starts[k]])
                own = slice(cuts[k], cuts[k + 1])
                hits = [(int(characters[e]) - zero, int(m)) for e, m in zip(ends[own].tolist(), masks[own].tolist()) if m >> SPANS]
                mine = [(int(characters[a]) - zero, int(characters[b]) - zero, kind) for a, b, kind in spans[span_cuts[k] : span_cuts[k + 1]]]
                lines = feeds[np.searchsorted(feeds, starts[k]) : np.searchsorted(feeds, starts[k + 1])]
                results[i + k] = find_in(texts[i + k], mine, hits, extensions[i + k], characters[lines] - zero)
        i = j
    return results


def _spans(auto: Automaton, kinds: np.ndarray, ends: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, str]]:
    """Start, end and name of the longest matches of the span patterns, in bytes, sorted."""
    spans: dict[tuple[int, str], int] = {}
    for bit in range(SPANS):
        at = ends[(masks >> bit & 1).astype(bool)]
        # of a run of ends one after another the last one ends the match
        for end in at[np.r_[at[1:] != at[:-1] + 1, True]].tolist() if len(at) else ():
            start = auto.start_of(kinds, end, bit)
            if start is not None:
                key = (start, PATTERNS[bit][0])
                spans[key] = max(end, spans.get(key, 0))
    return sorted((start, end, name) for (start, name), end in spans.items())


def _extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _scan_batches(batches: Iterator[pd.DataFrame], full: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["content"].tolist()
        found = scan(texts, [_extension(p) for p in batch["path"]])
        if full:
            yield pd.DataFrame({"file_id": batch["id"], "n_credentials": [len(f) for f in found], "content": [redact(t, f) if f else t for t, f in zip(texts, found)]})
        else:
            rows = [(i, line, kind) for i, f in zip(batch["id"], found) for line, _, kind in f]
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "kind"])


def find_credentials(files: DataFrame) -> DataFrame:
    """``file_id, line_no, kind`` of every credential in ``files`` (``id, path, content``).

    ``line_no`` counts from 1 by line feeds. Null or empty contents have none, a null path counts as no extension,
    repeated files count each, other columns are not read. Texts are scanned whole.
    """
    chosen = files.select("id", "path", "content").where("content is not null and content != ''")
    return chosen.mapInPandas(lambda b: _scan_batches(b, False), "file_id long, line_no int, kind string")


def redact_credentials(files: DataFrame) -> DataFrame:
    """``file_id, n_credentials, content`` with placeholders in place of the credentials, for every file with content."""
    chosen = files.select("id", "path", "content").where("content is not null")
    return chosen.mapInPandas(lambda b: _scan_batches(b, True), "file_id long, n_credentials int, content string")
