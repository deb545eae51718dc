"""Functions paired with the comment that documents them; empty and trivial documentation dropped."""

from __future__ import annotations

import functools
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped
from tessera.operators.skew import salted_join
from tessera.session import cut_lineage

KINDS = ("function", "method")

# Words that say nothing about what a function does.
FILLER = frozenset(
    "a an the this that these those it its is are be was of for to in on at by with and or from as into per via if then "
    "function functions method methods func procedure routine subroutine helper class module object instance constructor implementation impl "
    "use used uses using given specified provided certain passed current self cls me my your our "
    "param params parameter parameters arg args argument arguments input inputs output outputs return returns returned returning result results value values "
    "type types string strings number numbers int integer float bool boolean dict list array map any object void none null undefined unknown optional default "
    "throw throws exception exceptions error raise name named call called calls calling do does doing perform performs make makes "
    "work what which here there see above below documentation document documented docs doc docstring description describe summary comment comments "
    "thing things stuff some will can may should e g i etc eg ie new get gets set sets handle handles handler run runs execute executes process processes".split()
)
# Word endings and what stands in their place.
_STEMS = (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))

# whole documents or sentences that are placeholders, marks for tools or text of a template
EMPTY = re.compile(
    r"""(?ix)^(?:
    (?:todo|fixme|xxx|hack|tbd|wip|n/?a|none|null|nil|empty|undocumented|tba|placeholder|lorem\ ipsum|foo|bar|test|docs?)\W*
    |\(?\s*no\s+(?:documentation|description|docs?|comment|docstring)\b.*
    |(?:missing|add|write|insert|needs?|fill\s+in|put|enter|lacks?|without)\s+(?:the\s+|your\s+|a\s+|some\s+|proper\s+|more\s+)*(?:documentation|description|docs?|docstring|comment|summary|text)\b.*
    |(?:function|method|class|short|brief|your|some|the)?\s*(?:description|documentation|docstring|summary|comment)(?:\s+(?:goes|comes|here|of|for|missing|pending|needed|required).*)?\W*
    |.*\b(?:description|documentation|docs?|docstring|comment)\s+(?:goes|comes|belongs)\s+here\b.*
    |(?:please\s+)?document\s+(?:this|me|it)\b.*
    |.*\bneeds?\s+(?:a\s+)?(?:proper\s+|better\s+|real\s+)?(?:description|documentation|docs?|docstring)\b.*
    |auto-?\s?generated\s*(?:(?:by|from)\b.*|method.*|constructor.*|doc\w*|comment|stub|code|file|catch\s+block|javadoc)?\W*|(?:this\s+\w+\s+(?:was|is)\s+)?(?:automatically\s+)?(?:created|generated)\s+(?:from|by|with|automatically)\b.*
    |replace\s+this\s+(?:text|comment|line|sentence)\b.*|(?:insert|your)\s+\w+\s+here\b.*
    |see\s+(?:above|below|there|also|base|super|parent|interface|implementation|the\s+(?:interface|base|parent|super)\w*)\b.*
    |same\s+as\s+(?:above|before|super|parent|base)\b.*|\{?@?inherit-?doc\}?.*|inherited\s+from\b.*|override[sn]?\W*
    |(?:noqa|nosec|nolint|pylint|flake8|mypy|type|pragma|eslint|tslint|jshint|jslint|prettier|istanbul|c8|ts|rustfmt|clippy|checkstyle|spotless|ktlint|detekt|suppress\w*|go|pyright|ruff|isort|fmt|yapf|black|coverage|sonar\w*|resharper)\s*:(?!\s).*
    |(?:noqa|nosec|nolint|nosonar|@ts-(?:ignore|nocheck|expect-error)|eslint-\w+|prettier-ignore|istanbul\s+ignore|pylint|pragma)\b.*
    |@(?:type|name|memberof|function|method|class|static|private|public|protected|internal|override|deprecated|todo|since|author|version|see|link|api|module|export|constructor|async|generator|abstract|access|ignore|hidden|inheritdoc)\b.*
    |\W*
    )$"""
)
#: a condition, or an effect that is more than a value given back
STATES = re.compile(r"(?i)\b(?:if|when|whenever|unless|until|throws?|raises?|returns?\s+(?:null|none|nil|true|false|undefined|empty|zero))\b")
NOTE = re.compile(r"(?i)^(?:todo|fixme|xxx|hack)\b[^:.!?]*[:.!?]?")
TAG = re.compile(
    r"""(?ix)^(?:[@\\:](?P<tag>param|arg|argument|parameter|return|returns|raises?|throws?|exception|rtype|type|yields?|keyword)\b(?:\s*\{[^}]*\})?(?:\[[^\]]*\])?
    (?:\s+(?P<name>[\w.\[\]*]+))?\s*(?::|-|–)?\s*(?P<rest>.*))$"""
)
HEADING = re.compile(r"(?i)^(?:args|arguments|parameters|params|returns?|raises|throws|yields|example|examples|notes?|see also|attributes)\s*:?\s*$")
ENTRY = re.compile(r"^(?P<name>[A-Za-z_]\w*)\s*(?:\([^)]*\)|:\s*[A-Za-z_\[\], ]+\s*$)?\s*(?::|-|–)\s*(?P<rest>.*)$")
MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\w)|//[/!]?|#+!?(?=\s|$)|<!--|-->|\"\"\"|'''|--\s|;+\s)\s?")
XML = re.compile(r"</?[A-Za-z][^<>]*/?>")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
WORD = re.compile(r"\w+")
CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    for end, put in _STEMS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: len(word) - len(end)] + put
            break
    return word[:-1] if word.endswith("e") and len(word) > 3 else word


def name_words(*texts: str | None) -> frozenset[str]:
    return frozenset(stem(p.lower()) for t in texts if t for p in CAMEL.findall(t))


@functools.lru_cache(1024)
def plain_lines(comment: str) -> list[str]:
    """Lines of a comment without comment marks and markup tags."""
    out = []
    for line in comment.replace("\r", "").split("\n"):
        before = None
        while before != line:
            before, line = line, MARKS.sub("", line, count=1)
        line = re.sub(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$", "", line)
        out.append(XML.sub(" ", line).strip())
    return out


@functools.lru_cache(1024)
def statements(comment: str) -> list[tuple[str | None, str]]:
    """``(parameter or None, text)``: sentences and tag descriptions that are no placeholder, mark or template text."""
    out: list[tuple[str | None, str]] = []
    for line in plain_lines(comment):
        if not line or HEADING.match(line) or re.fullmatch(r"[-=*_~#.\s]+", line):
            continue
        tag = TAG.match(line)
        if tag:
            if tag.group("tag").lower() in ("type", "rtype"):
                continue
            rest, name = tag.group("rest"), tag.group("name")
            if tag.group("tag").lower() not in ("param", "arg", "argument", "parameter", "keyword") and name:
                rest, name = f"{name} {rest}", None
            line, of = rest, name
        else:
            entry = ENTRY.match(line)
            of = entry.group("name") if entry and " " not in entry.group("name") else None
        for sentence in re.split(r"(?<=[.!?;])\s+", line):
            sentence = sentence.strip()
            body = NOTE.sub("", sentence).strip()
            if NOTE.match(sentence) or EMPTY.match(sentence) or not body:
                continue
            out.append((of, sentence))
    return out


def said(comment: str | None, name: str | None, signature: str | None) -> set[str]:
    """Words of a comment that neither the signature nor fillers account for; a complexity counts as two words."""
    if not comment:
        return set()
    known = name_words(name, signature)
    words: set[str] = set()
    for of, text in statements(comment):
        if re.search(r"\bO\([^)]+\)", text):
            words |= {"order", "growth"}
        own = known | name_words(of)
        for w in LETTERS.findall(text):
            parts = CAMEL.findall(w) or [w]
            low = w.lower()
            if low in FILLER or stem(low) in own or all(stem(p.lower()) in own or p.lower() in FILLER for p in parts):
                continue
            if not low.isascii() and min(low) > "\u02ff" and len(low) > 3:
                words |= {low[:2], low[2:]}  # scripts without blanks between words
            elif len(low) > 1 or not low.isascii():
                words.add(stem(low))
    return words


def informative(comment: str | None, name: str | None, signature: str | None) -> bool:
    """Two words of its own make a comment informative; one does in a sentence that states a condition or an effect."""
    words = said(comment, name, signature)
    if len(words) != 1:
        return len(words) >= 2
    thrown = (m for m in map(TAG.match, plain_lines(comment)) if m and m.group("tag").lower().startswith(("raise", "throw", "exception")))
    if any(said(m.group("rest"), name, signature) for m in thrown):
        return True
    return any(STATES.search(text) and said(text, " ".join(filter(None, (name, of))), signature) for of, text in statements(comment))


OWN, NEAR, TAGS, NAMED = 1.0, 0.3, 0.6, 0.4
"""Weights of a link: the comment is stored with the function; it stands in the same file, less by the distance; its
parameter tags name the function's parameters; it names the function. A link below ``OWN`` that no tag and no name
supports is implausible."""
LINES = 512
"""Lines over which a distance takes away a weight of one."""
REACH = math.ceil((NEAR + TAGS + NAMED) * LINES)
"""Lines from which on no comment has a link to a function that it is not stored with."""
SCALE = 1 << 40
"""Weights are compared as whole numbers of this part of one, so prices of an assignment stay exact."""


def tag_names(comment: str) -> frozenset[str]:
    names = set()
    for line in plain_lines(comment):
        m = TAG.match(line)
        if m and m.group("name") and m.group("tag").lower() in ("param", "arg", "argument", "parameter", "keyword"):
            names.add(m.group("name").strip("[]*").split(".")[0])
    return frozenset(names)


def has_word(text: str, word: str) -> bool:
    """Whether ``word`` stands in the text with no letter, digit or underscore beside it."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        before, after = text[at - 1 : at], text[end : end + 1]
        if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
            return True
        at = text.find(word, at + 1)
    return False


def link_weight(comment: str, tags: frozenset[str], name: str | None, signature: str, own: bool, distance: int) -> float:
    """How well a comment fits a function; 0 for an implausible link."""
    agree = 0.0
    if tags:
        agree = sum(has_word(signature, t) for t in tags) / len(tags)
    named = bool(name) and has_word(comment, name)
    if own:
        return OWN + TAGS * agree + NAMED * named
    if not (agree or named):
        return 0.0
    return max(0.0, NEAR + TAGS * agree * (1 if agree == 1 else 0.5) + NAMED * named - distance / LINES)


class Assignment:
    """Links of greatest total weight, each side used once, that grow by one comment at a time.

    ``links(comment, least)`` gives ``(function, weight)``, in whole numbers, of every link heavier than ``least``. Each
    comment has a worth and each function a price whose sum no link between them exceeds and links in use reach; free
    functions cost nothing. A comment is added along the path of least loss (Dijkstra), so only what it can displace at
    less than the loss of a way already known is looked at.
    """

    def __init__(self, links: Callable[[int, int], Iterable[tuple[int, int]]]):
        self.links = links
        self.function: dict[int, int] = {}
        self.comment: dict[int, int] = {}
        self.worth: dict[int, int] = {}
        self.price: dict[int, int] = {}

    def keep(self, c: int, f: int, weight: int) -> None:
        """Use the link of ``c`` that is heaviest, to a function that is free."""
        self.function[c], self.comment[f], self.worth[c] = f, c, weight

    def add(self, c: int, most: int, known: tuple[int, int] | None = None) -> None:
        """Add ``c``, whose links weigh ``most`` at most; ``known`` is one of them, looked at first."""
        self.worth[c] = most
        loss, end, left_out = most, -1, c  # of the best way: to a free function, or to a comment that is left out
        near: dict[int, int] = {}
        back: dict[int, int] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        at, now = 0, c
        while True:
            base = at + self.worth[now]
            for some in ([known] if known and now == c else [], None):
                for f, weight in self.links(now, base - loss) if some is None else some:
                    way = base + self.price.get(f, 0) - weight
                    if f in done or way >= loss or way >= near.get(f, loss):
                        continue
                    near[f], back[f] = way, now
                    if f in self.comment:
                        heapq.heappush(heap, (way, f))
                    else:
                        loss, end = way, f
            while heap and (heap[0][1] in done or heap[0][0] > near[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= loss:
                break
            at, f = heapq.heappop(heap)
            done[f], now = at, self.comment[f]
            if at + self.worth[now] < loss:
                loss, end, left_out = at + self.worth[now], -1, now
        self.worth[c] -= loss
        for f, at in done.items():
            self.price[f] = self.price.get(f, 0) + loss - at
            self.worth[self.comment[f]] -= loss - at
        if end < 0:
            if left_out == c:
                return
            end = self.function.pop(left_out)
        while True:
            now = back[end]
            before = self.function.get(now, -1)
            self.function[now], self.comment[end] = end, now
            if now == c:
                return
            end = before


def assign(weights: dict[tuple[int, int], float], n_functions: int, n_comments: int) -> dict[int, int]:
    """Links ``function -> comment`` of greatest total weight, each side used once."""
    links: dict[int, list[tuple[int, int]]] = {}
    for (f, c), w in sorted(weights.items()):
        if w > 0:
            links.setdefault(c, []).append((f, round(w * SCALE)))
    best = Assignment(lambda c, least: (x for x in links[c] if x[1] > least))
    for c in sorted(links):
        best.add(c, max(w for _, w in links[c]))
    return best.comment


class Links:
    """The links of functions with stored comments by indexes of names and of words of signatures.

    ``rows`` are ``(start_line, qualified_name, key, n_rows, name, signature, docstring)`` in order of lines, those without
    a line last: an unknown line is no distance.
    """

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.lines = [r[0] for r in rows if r[0] is not None]
        tags = self.tags = {i: tag_names(r[6]) for i, r in enumerate(rows) if r[6] and r[6].strip()}
        self.named = self._index((i, r[4]) for i, r in enumerate(rows) if r[4])
        self.beside = functools.lru_cache(1 << 16)(lambda c, name, signature: link_weight(rows[c][6], tags[c], name, signature, False, 0))

    @staticmethod
    def _index(texts: Iterable[tuple[int, str]]) -> dict[str, list[int]]:
        """Rows by the longest word of their text, by '' if it has none: a text that holds it has that word too."""
        index: dict[str, list[int]] = {}
        for i, text in texts:
            index.setdefault(max(WORD.findall(text), key=len, default=""), []).append(i)
        return index

    @functools.cached_property
    def signed(self) -> dict[str, list[int]]:
        """Rows by each word of their signature."""
        index: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            for word in set(WORD.findall(r[5])):
                index.setdefault(word, []).append(i)
        return index

    def weight(self, f: int, c: int) -> float:
        at, to = self.rows[c][0], self.rows[f][0]
        if f == c:
            return link_weight(self.rows[c][6], self.tags[c], self.rows[f][4], self.rows[f][5], True, 0)
        far = 0 if at is None or to is None else abs(to - at)
        return max(0.0, self.beside(c, self.rows[f][4], self.rows[f][5]) - far / LINES)

    def own(self, c: int) -> tuple[int, int]:
        return c, round(self.weight(c, c) * SCALE)

    def others(self, c: int, least: int) -> Iterator[tuple[int, int]]:
        """``(function, weight)`` of the links of ``c`` heavier than ``least`` to functions that it is not stored with."""
        reach = (NEAR + TAGS + NAMED - least / SCALE) * LINES
        if reach < 0:
            return
        low, high, unplaced = 0, len(self.rows), len(self.lines)
        if c < unplaced:
            low, high = bisect_left(self.lines, self.lines[c] - reach - 1), bisect_right(self.lines, self.lines[c] + reach + 1)

        def within(found: Sequence[int]) -> list[int]:
            return [*found[bisect_left(found, low) : bisect_left(found, high)], *found[bisect_left(found, max(high, unplaced)) :]]

        lists = [within(self.named[word]) for word in {"", *WORD.findall(self.rows[c][6])} if word in self.named]
        if self.tags[c] and least < round((NEAR + TAGS) * SCALE):  # a link that no name supports may be heavy enough
            words = [max(WORD.findall(t), key=len, default="") for t in self.tags[c]]
            tagged = [within(self.signed.get(word, []) if word else range(len(self.rows))) for word in words]
            if least >= round((NEAR + TAGS / 2) * SCALE):  # only if the signature holds every tag
                tagged = [min(tagged, key=len)]
            lists += tagged
        for f in sorted(set().union(*lists)):
            if f != c:
                weight = round(self.weight(f, c) * SCALE)
                if weight > max(least, 0):
                    yield f, weight

    def all(self, c: int, least: int) -> Iterator[tuple[int, int]]:
        own = self.own(c)
        if own[1] > least:
            yield own
        yield from self.others(c, least)


def pair_group(rows: list[tuple]) -> Iterator[tuple]:
    """The accepted pairs ``(key, n_rows, description, weight)`` of one group of functions with their stored comments.

    ``rows`` are those of ``Links``. Comments without a heavier link than their own keep it, which no other assignment of
    them exceeds; the others are added to these.
    """
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2]))
    links = Links(rows)
    best = Assignment(links.all)
    drawn = []
    for c in links.tags:
        _, own = links.own(c)
        if next(links.others(c, own), None):
            drawn.append((c, own))
        else:
            best.keep(c, c, own)
    for c, own in drawn:
        best.add(c, round((OWN + TAGS + NAMED) * SCALE), (c, own))
    for f, c in sorted(best.comment.items()):
        _, _, key, n_rows, name, signature, _ = rows[f]
        if informative(rows[c][6], name, signature):
            yield key, n_rows, " ".join(s for _, s in statements(rows[c][6])), links.weight(f, c)


GROUPED = ["place", "start_line", "qualified_name", "key", "n_rows", "name", "signature", "docstring"]


def groups(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows, sorted by place and line (unknown ones first), of one place each; a place without unknown lines is also cut
    where ``REACH`` lines hold no row, over which there is no link."""
    held: list[tuple] = []
    for r in rows:
        if held and (r[0] != held[-1][0] or (held[0][1] is not None and r[1] - held[-1][1] >= REACH)):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _pair_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair group after group of rows that come sorted by group; only one group is held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            yield from zip(*(batch[c].tolist() for c in GROUPED))

    out: list[tuple] = []
    for group in groups(rows()):
        out += pair_group([(None if r[1] is None else int(r[1]), r[2], r[3], int(r[4]), *r[5:]) for r in group])
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=["key", "n_rows", "description", "weight"])
            out = []
    yield pd.DataFrame(out, columns=["key", "n_rows", "description", "weight"])


def pair_documentation(symbols: DataFrame) -> DataFrame:
    """``symbol_id, signature, description, weight`` for each function or method with documentation that says something.

    Kinds compare without case and blanks; blank signatures have no pair; repeated rows each get theirs. Comments are
    matched to the functions of the same file by best total weight of stored place, parameter tags, names and distance;
    every link that has a weight counts. A description says something if at least two of its words are neither fillers
    nor said by the signature (one in a condition or an effect). An unknown line is no distance; rows without a file are
    grouped by what their name lies in, and stand alone if they have no name either; null docstrings give nothing;
    constructors are another kind. Equal rows are matched once, so a row repeated very often is no group.
    """
    kind = F.lower(stripped("kind"))
    chosen = symbols.select("id", "file_id", "name", "qualified_name", "start_line", "signature", "docstring", kind.alias("kind")).where(
        F.col("kind").isin(*KINDS) & (stripped("signature") != "") & F.col("signature").isNotNull()
    )
    keys = ["file_id", "qualified_name", "start_line", "name", "signature", "docstring"]
    keyed = chosen.withColumn("key", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))
    named = F.when(stripped("qualified_name") != "", F.col("qualified_name"))
    inside = F.concat(F.lit("in "), F.regexp_replace(named, r"\.[^.]*$", ""))
    place = F.coalesce(F.concat(F.lit("file "), F.col("file_id").cast("string")), inside, F.concat(F.lit("key "), "key"))
    distinct = keyed.groupBy("key", *keys).agg(F.count("*").alias("n_rows")).withColumn("place", place)
    pairs = distinct.select(*GROUPED).repartition("place").sortWithinPartitions("place", "start_line")
    found = pairs.mapInPandas(_pair_sorted, "key string, n_rows long, description string, weight double")
    return salted_join(keyed.select("id", "signature", "key"), cut_lineage(found), "key", weight="n_rows", salt="id").select(
        F.col("id").alias("symbol_id"), "signature", "description", "weight"
    )
