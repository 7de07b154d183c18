"""Functions paired with their documentation comments.

A string- and comment-aware lexer, run as an associative scan over a whole Arrow batch (``scan.py``),
tells code from comments, strings, character literals and text blocks. Braces in code, matched by depth,
delimit each method from the line its record names; a line that leads to neither braces nor a semicolon is no
method. Its documentation is the last ``/** */`` comment before it with nothing
but white space, annotations and ordinary comments in between. Pairs whose documentation says nothing
the name does not say are dropped.

Defined results: files without content, records without methods, and methods without a line inside the
file have no pair; paths are compared after removing ``./`` and turning ``\\`` into ``/``; repeated rows
count once; an unclosed comment, string or body runs to the end of its file; a method without a body (abstract)
has its declaration as code; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcquarry.llm.scan import code_points, states_before
from srcquarry.llm.tokens import BATCH_POINTS

# Character classes and lexer states.
X_OTHER, X_SLASH, X_STAR, X_DOUBLE, X_SINGLE, X_ESCAPE, X_LINE, X_BREAK = range(8)
(CODE, SLASH, LINE, BLOCK, BLOCK_STAR, STRING, STRING_ESC, CHAR, CHAR_ESC, QUOTE1, QUOTE2, TEXT, TEXT_ESC, TEXT1, TEXT2) = range(15)


def _table() -> np.ndarray:
    t = np.zeros((8, 15), np.uint8)
    t[:, CODE] = CODE
    t[X_SLASH, CODE], t[X_DOUBLE, CODE], t[X_SINGLE, CODE] = SLASH, QUOTE1, CHAR
    t[:, SLASH] = t[:, CODE]
    t[X_SLASH, SLASH], t[X_STAR, SLASH] = LINE, BLOCK
    t[:, LINE] = LINE
    t[X_LINE, LINE] = CODE
    t[:, BLOCK] = BLOCK
    t[X_STAR, BLOCK] = BLOCK_STAR
    t[:, BLOCK_STAR] = BLOCK
    t[X_STAR, BLOCK_STAR], t[X_SLASH, BLOCK_STAR] = BLOCK_STAR, CODE
    t[:, STRING] = STRING
    t[X_DOUBLE, STRING], t[X_ESCAPE, STRING], t[X_LINE, STRING] = CODE, STRING_ESC, CODE
    t[:, STRING_ESC] = STRING
    t[:, CHAR] = CHAR
    t[X_SINGLE, CHAR], t[X_ESCAPE, CHAR], t[X_LINE, CHAR] = CODE, CHAR_ESC, CODE
    t[:, CHAR_ESC] = CHAR
    t[:, QUOTE1] = t[:, STRING]
    t[X_DOUBLE, QUOTE1] = QUOTE2
    t[:, QUOTE2] = t[:, CODE]
    t[X_DOUBLE, QUOTE2] = TEXT  # three quotes open a text block
    t[:, TEXT] = TEXT
    t[X_DOUBLE, TEXT], t[X_ESCAPE, TEXT] = TEXT1, TEXT_ESC
    t[:, TEXT_ESC] = TEXT
    t[:, TEXT1] = t[:, TEXT]
    t[X_DOUBLE, TEXT1] = TEXT2
    t[:, TEXT2] = t[:, TEXT]
    t[X_DOUBLE, TEXT2] = CODE
    t[X_BREAK, :] = CODE
    return t


LEXER = _table()


class Lexed:
    """Spans of comments and code of a batch of sources, joined into one array."""

    def __init__(self, texts: list[str]):
        self.whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.bases = self.ends - sizes
        cp = code_points(self.whole)
        n = len(cp)
        cls = np.zeros(n, np.int32)
        for c, k in ((47, X_SLASH), (42, X_STAR), (34, X_DOUBLE), (39, X_SINGLE), (92, X_ESCAPE), (10, X_LINE), (13, X_LINE)):
            cls[cp == c] = k
        at = self.bases[sizes > 0]
        before = np.delete(states_before(np.insert(cls, at, X_BREAK), LEXER), at + np.arange(len(at)))
        after = LEXER[cls, before]
        last = self.ends[sizes > 0] - 1
        in_block = np.isin(before, [BLOCK, BLOCK_STAR])
        in_line = before == LINE
        opens_block = (after == BLOCK) & (before == SLASH)
        opens_line = (after == LINE) & (before == SLASH)
        closes_block = in_block & (after == CODE)
        closes_line = in_line & (after == CODE)
        at_end = np.zeros(n, bool)
        at_end[last] = True
        start = np.flatnonzero(opens_block | opens_line) - 1
        stop = closes_block | closes_line | (at_end & (in_block | in_line | opens_block | opens_line))
        self.start = start
        self.stop = np.where(closes_line[np.flatnonzero(stop)], np.flatnonzero(stop), np.flatnonzero(stop) + 1)
        self.is_doc = np.array([self.whole.startswith("/**", a) and b - a >= 5 and self.whole[a + 3 : a + 4] != "/" or self.whole[a:b] == "/***/" for a, b in zip(start.tolist(), self.stop.tolist())], bool)
        comment = np.zeros(n + 1, np.int32)
        np.add.at(comment, self.start, 1)
        np.add.at(comment, self.stop, -1)
        self.in_comment = np.cumsum(comment[:n]) > 0
        self.code = ~self.in_comment & ~np.isin(before, [STRING, STRING_ESC, CHAR, CHAR_ESC, TEXT, TEXT_ESC, TEXT1, TEXT2, QUOTE1])
        step = ((cp == 123) & self.code).astype(np.int32) - ((cp == 125) & self.code).astype(np.int32)
        self.open = np.flatnonzero(step > 0)
        self.match = self._matches(step)
        # Depth of parentheses before each character: braces inside of them are values of annotations.
        paren = ((cp == 40) & self.code).astype(np.int32) - ((cp == 41) & self.code).astype(np.int32)
        self.paren = np.cumsum(paren) - paren
        self.semicolon = np.flatnonzero((cp == 59) & self.code)
        self.lines = np.unique(np.concatenate([np.flatnonzero(cp == 10) + 1, self.bases]))
        self.solid = ~np.isin(cp, [32, 9, 10, 13, 12, 0xA0, 0xFEFF]) & ~self.in_comment

    def _matches(self, step: np.ndarray) -> np.ndarray:
        """Position of the brace that closes each opening brace, or the end of its text.

        Braces of one text and depth, in order, take turns in opening and closing.
        """
        at = np.flatnonzero(step)
        doc = np.searchsorted(self.ends, at, side="right")
        depth = np.cumsum(step[at])
        level = np.where(step[at] > 0, depth, depth + 1)
        order = np.lexsort((at, level, doc))
        pos, opens, group = at[order], step[at][order] > 0, np.stack([doc[order], level[order]])
        end = self.ends[group[0]] if len(pos) else pos
        closed = np.zeros(len(pos), bool)
        closed[:-1] = opens[:-1] & ~opens[1:] & (group[:, :-1] == group[:, 1:]).all(0)
        end = np.where(closed, np.append(pos[1:], 0) + 1, end)
        out = end[opens]
        return out[np.argsort(pos[opens])]

    def line_start(self, doc: int, line: int) -> int:
        """Position of a 1-based line of a text, or -1."""
        k = int(np.searchsorted(self.lines, self.bases[doc])) + line - 1
        if line < 1 or k >= len(self.lines) or self.lines[k] >= self.ends[doc]:
            return -1
        return int(self.lines[k])

    def declaration(self, doc: int, line: int) -> int:
        """First character of the line that is neither white space nor comment, or -1."""
        a = self.line_start(doc, line)
        if a < 0:
            return -1
        b = self.whole.find("\n", a, int(self.ends[doc]))
        hits = np.flatnonzero(self.solid[a : b if b >= 0 else int(self.ends[doc])])
        return a + int(hits[0]) if len(hits) else -1

    def documentation(self, doc: int, at: int) -> str | None:
        """Text of the last documentation comment before ``at``."""
        k = int(np.searchsorted(self.stop, at, side="right")) - 1
        end = at
        while k >= 0 and self.start[k] >= self.bases[doc]:
            between = self.whole[self.stop[k] : end].strip()
            if between and not ANNOTATIONS.fullmatch(between):
                return None
            if self.is_doc[k]:
                return self.whole[self.start[k] : self.stop[k]]
            end = int(self.start[k])
            k -= 1
        return None

    def body_end(self, doc: int, at: int) -> int:
        """End of the method that begins at ``at``: its matching brace, or the semicolon of its declaration; -1 if it has neither."""
        limit = int(self.ends[doc])

        def first(places: np.ndarray) -> int:
            k = int(np.searchsorted(places, at))
            while k < len(places) and places[k] < limit and self.paren[places[k]] > self.paren[at]:
                k += 1
            return k if k < len(places) and places[k] < limit else -1

        o, s = first(self.open), first(self.semicolon)
        if s >= 0 and (o < 0 or self.semicolon[s] < self.open[o]):
            return int(self.semicolon[s]) + 1
        return int(self.match[o]) if o >= 0 else -1


#: A run of annotations, with one level of nested parentheses in their arguments.
ANNOTATIONS = re.compile(r"(?:@[\w.]+\s*(?:\((?:[^()\"]|\"(?:\\.|[^\"\\])*\"|\([^()]*\))*\))?\s*)+")
#: Words that name no content of their own.
EMPTY_WORDS = {
    "the", "a", "an", "of", "for", "to", "this", "that", "in", "on", "and", "or", "is", "it", "its", "by", "with", "given", "specified",
    "method", "function", "constructor", "creates", "new", "instance", "returns", "return", "gets", "sets", "get", "set", "class", "value", "do", "does",
}
#: Texts that stand in for documentation or say that it is missing.
PLACEHOLDER = re.compile(
    r"(?:(?:todo|fixme|xxx|tbd|tba|n/?a|none|null|nothing|empty|placeholder|comment|description|summary|java ?doc|doc|documentation|no ?doc|undocumented|wip|hack|foo|bar|test|lorem ipsum)\b[\s.:!?-]*)+"
    r"|(?:(?://|#|\*|-|>)\s*)*\(?(?:todo|fixme|xxx|tbd|tba)\b.*"
    r"|auto-?\s?generated\b.*|generated (?:method|constructor|by|code|stub)\b.*"
    r"|.*\b(?:documentation|description|javadoc|comment|doc)s?\b.{0,20}\b(?:is |are )?(?:missing|absent|pending|to be (?:added|written|done)|goes here|here)\b.*"
    r"|.*\b(?:missing|add|insert|write|no|without|needs?|lacks?)\b.{0,12}\b(?:documentation|description|javadoc|docs?|comment)\b.{0,30}"
    r"|.*\b(?:not|un)[ -]?(?:yet )?documented\b.*|see (?:above|below|super|parent|interface|base class|code)\.?|(?:same|as) (?:as )?above\.?",
    re.I | re.S,
)
INHERITS = re.compile(r"\{@inheritDoc\}|@inheritDoc", re.I)
INLINE = re.compile(r"\{@\w+\s*([^{}]*)\}")
WORDS = re.compile(r"[^\W\d_]+|\d+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def summary(comment: str) -> str:
    """The text of a documentation comment before its first block tag, on one line, without markup."""
    body = comment[3:-2] if comment.endswith("*/") else comment[3:]
    lines = []
    for line in re.split(r"\r\n|\r|\n", body):
        line = re.sub(r"^\s*\*+(?!/)\s?", "", line).strip() if lines else line.strip(" \t*")
        if re.match(r"@\w", line) and not re.match(r"@inheritDoc\b", line, re.I):
            break
        lines.append(line)
    text = INLINE.sub(lambda m: " " + m[1] + " ", INHERITS.sub(" ", " ".join(lines)))
    text = re.sub(r"<[/!a-zA-Z][^<>]*>", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ies", "ing", "es", "ed", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            return w[: -len(end)]
    return w


def says_something(text: str, name: str) -> bool:
    """Does a summary say anything about a method that its name does not say already?"""
    bare = text.strip(" .:;!?-–—_*/\\|=~#<>()[]{}'\"`")
    if not bare or not WORDS.search(bare) or PLACEHOLDER.fullmatch(bare):
        return False
    known = {_stem(p) for p in PARTS.findall(name)} | {_stem(name)}
    said = {w for x in WORDS.findall(bare) for w in ([x] if x.lower() == name.lower() else PARTS.findall(x) or [x]) if w.lower() not in EMPTY_WORDS}
    left = {w for w in said if _stem(w) not in known and not any(len(k) > 2 and (_stem(w).startswith(k) or k.startswith(_stem(w))) and abs(len(_stem(w)) - len(k)) <= 2 for k in known)}
    return bool(left)


def normal_path(c: F.Column) -> F.Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def method_docs(records: DataFrame, sources: DataFrame, with_text: bool = True) -> DataFrame:
    """(file, start_line[, name, documentation, code]) of the methods with documentation that says something.

    ``file`` is spelled as in ``sources``. One shuffle joins the methods of a file, as one row, with its
    content; a file with very many methods is still bounded by its own text.
    """
    methods = (
        records.select(normal_path(F.col("file_path")).alias("path"), F.explode("methods").alias("m"))
        .filter("path is not null and m.start_line is not null")
        .select("path", F.struct(F.col("m.start_line").alias("line"), F.coalesce(F.col("m.fq_name"), F.lit("")).alias("name")).alias("m"))
    )
    per_file = methods.groupBy("path").agg(F.collect_set("m").alias("ms"))
    texts = sources.filter("content is not null").select("file", normal_path(F.col("file")).alias("path"), "content")
    joined = texts.join(per_file, "path").select("file", "content", "ms")
    schema = "file string, start_line int" + (", name string, documentation string, code string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, texts, lists = (batch.column(k).to_pylist() for k in range(3))
            a = 0
            while a < len(files):
                b, size = a, 0
                while b < len(files) and (b == a or size + len(texts[b]) <= BATCH_POINTS):
                    size += len(texts[b])
                    b += 1
                lexed = Lexed(texts[a:b])
                rows = []
                for d in range(b - a):
                    for m in lists[a + d]:
                        at = lexed.declaration(d, m["line"])
                        end = lexed.body_end(d, at) if at >= 0 else -1
                        comment = lexed.documentation(d, at) if end >= 0 else None
                        if comment is None:
                            continue
                        name = re.split(r"[#.]", re.sub(r"\(.*", "", m["name"], flags=re.S))[-1]
                        text = summary(comment)
                        if says_something(text, name):
                            row = (files[a + d], m["line"])
                            rows.append(row + ((name, text, lexed.whole[at:end]) if with_text else ()))
                cols = list(zip(*rows)) if rows else [()] * (5 if with_text else 2)
                types = [pa.string(), pa.int32()] + [pa.string()] * 3 * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "start_line", "name", "documentation", "code"][: len(types)])
                a = b

    return joined.mapInArrow(run, schema).distinct()
