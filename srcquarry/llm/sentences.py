"""Sentence units of documents in any language, script and layout.

Boundary rules are compiled into finite transducers over character (and line) classes and run as
associative scans (``scan.py``): a whole Arrow batch of documents is one array, a very long document is
many chunks of it whose transition functions are composed, so no document is a sequential bottleneck.

Transducers run one after the other: lines to blocks (fences, headings, list items, paragraphs),
quotation marks to matched pairs, words before periods to what they say about the sentence (a trie of all abbreviations and
ordinal words, run for all periods in lockstep), characters of paragraphs to sentence ends. What follows a mark is
read from scans in the other direction (the next solid, alphanumeric, white character of every position), so a mark
looks as far as it has to and no rule is a loop over marks.

Defined results: null, empty and blank texts have no rows; a blank line always ends a sentence; headings,
list items with their marker and fenced code blocks are one sentence each; an unclosed fence runs to the
end of its document; unbalanced quotes or brackets of a paragraph count as ordinary characters; in
paragraphs mostly in Thai, white space ends a sentence. Offsets are code points. Repeated rows give
repeated sentences unless the caller asks for distinct rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from srcquarry.llm.scan import code_points, states_before
from srcquarry.llm.tokens import batched
from srcquarry.runtime import spread

# Kinds of characters.
OTHER, WHITE, UPPER, LOWER, UNICASE, DIGIT, OPENER, CLOSER, STOP, WEAK, DOTS, MARKS, CONT = range(13)

#: Abbreviations after whose period a sentence goes on, whatever follows.
GOES_ON = {
    # English
    "mr", "mrs", "ms", "dr", "prof", "st", "e.g", "i.e", "cf", "vs", "fig", "figs", "sec", "ch", "eq", "no", "nos", "vol", "pp", "ed",
    "approx", "resp", "v", "viz", "incl", "max", "min", "dept", "gen", "sen", "rep", "rev", "hon", "jan", "feb", "mar", "apr", "jun", "jul",
    "aug", "sep", "sept", "oct", "nov", "dec",
    # German
    "z.b", "d.h", "u.a", "ca", "bzw", "nr", "abb", "abschn", "kap", "bd", "vgl", "evtl", "ggf", "inkl", "sog", "tel", "str", "tab", "s", "hr", "fr",
    "o.ä", "i.d.r", "z.t",
    # French
    "p.ex", "c.-à-d", "art", "p", "n", "chap", "mme", "mlle", "env", "éd", "réf", "av",
    # Spanish
    "p.ej", "pág", "págs", "núm", "núms", "sr", "sra", "srta", "dra", "ud", "uds", "aprox", "cap", "ej", "ed",
    # Russian
    "т.е", "т.к", "рис", "разд", "см", "напр", "табл", "гл", "стр", "им", "ул", "проф", "т", "п", "ст",
    # Hindi
    "डॉ", "श्री", "प्रो", "सं",
}
#: Abbreviations that end a sentence if what follows looks like the start of one.
MAY_END = {"etc", "usw", "u.s", "u.k", "u.n", "e.u", "a.m", "p.m", "inc", "ltd", "corp", "co", "jr", "al", "т.д", "т.п", "др", "ee.uu", "u.s.a", "ph.d", "bspw", "ff"}
#: Words before a number with a period that make it an ordinal.
ORDINAL_BEFORE = {
    "der", "die", "das", "den", "dem", "des", "am", "im", "zum", "zur", "vom", "beim", "ab", "bis", "seit", "jede", "jeder", "jedes", "jeden",
    "ein", "eine", "einer", "einem", "einen", "ihr", "ihre", "sein", "seine", "unser", "unsere", "dieser", "diese", "dieses", "nach", "mit",
}
#: How the text goes on after a quotation that is part of a longer sentence (Japanese, Chinese).
QUOTED_ON = ("と", "って", "など", "の", "は", "が", "を", "に", "も", "で", "，", "、", "；", "：", "地说", "地问", "他说", "她说", "然后")

PAIRS = {0x28: 0x29, 0x5B: 0x5D, 0xAB: 0xBB, 0x2039: 0x203A, 0x300C: 0x300D, 0x300E: 0x300F, 0xFF08: 0xFF09, 0x3010: 0x3011, 0x300A: 0x300B, 0x3008: 0x3009, 0xFF3B: 0xFF3D}
LOW9, LEFT, RIGHT, DOUBLE, SINGLE = 0x201E, 0x201C, 0x201D, 0x22, 0x27

_kinds: np.ndarray | None = None
#: Properties of characters, as bits: letter or digit; upper or title case or digit; lower case; letter; digit.
ALNUM, HIGH, LOW, ALPHA, NUMBER, MARK = 1, 2, 4, 8, 16, 32
_props: np.ndarray | None = None
_low: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    global _kinds, _props, _low
    if _kinds is None:
        table = np.full(0x110000, OTHER, np.uint8)
        props, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        group = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": UNICASE, "Lm": UNICASE, "Nd": DIGIT, "Mn": MARKS, "Mc": MARKS, "Me": MARKS, "Cf": MARKS}
        for c in range(0x110000):
            x = chr(c)
            g = unicodedata.category(x)
            if x.isspace():
                table[c] = WHITE
            elif g in group:
                table[c] = group[g]
            if g[0] == "M":
                props[c] = MARK
            elif g[0] in "LN":
                digit, lower = x.isdigit(), x.lower()
                high = digit or x.isupper() or x.istitle()
                props[c] = ALNUM * x.isalnum() | HIGH * high | LOW * x.islower() | ALPHA * x.isalpha() | NUMBER * digit
                if len(lower) == 1:
                    low[c] = ord(lower)
        for a, b in PAIRS.items():
            table[a], table[b] = OPENER, CLOSER
        for x in "“„¿¡‘":
            table[ord(x)] = OPENER
        for x in "”’}":
            table[ord(x)] = CLOSER
        for x in "。！？｡।॥؟۔":
            table[ord(x)] = STOP
        for x in "!?‼⁇⁈⁉‽":
            table[ord(x)] = WEAK
        for x in ".…．":
            table[ord(x)] = DOTS
        for x in ",;:，、；：؛،":
            table[ord(x)] = CONT
        _kinds, _props, _low = table, props, low
    return _kinds


def _next_index(mask: np.ndarray) -> np.ndarray:
    """For each position the first one at or after it where ``mask`` holds, else the length."""
    n = len(mask)
    at = np.where(mask, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1] if n else at


def _last_index(mask: np.ndarray) -> np.ndarray:
    """For each position the last one at or before it where ``mask`` holds, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.empty(0, np.int64)


# ---------------------------------------------------------------- lines to blocks
L_PLAIN, L_BLANK, L_TICKS, L_TICKS_INFO, L_TILDES, L_TILDES_INFO, L_HEAD, L_ITEM, L_NUMBER, L_RULE, L_BREAK = range(11)
B_NONE, B_PARA, B_ITEM, B_TICKS, B_TILDES = range(5)


def _line_table() -> np.ndarray:
    t = np.zeros((11, 5), np.uint8)
    for s in (B_NONE, B_PARA, B_ITEM):
        t[L_PLAIN, s] = B_PARA if s == B_NONE else s
        t[L_BLANK, s] = t[L_HEAD, s] = t[L_RULE, s] = B_NONE
        t[L_TICKS, s] = t[L_TICKS_INFO, s] = B_TICKS
        t[L_TILDES, s] = t[L_TILDES_INFO, s] = B_TILDES
        t[L_ITEM, s] = B_ITEM
        t[L_NUMBER, s] = B_PARA if s == B_PARA else B_ITEM
    for fence, closing in ((B_TICKS, L_TICKS), (B_TILDES, L_TILDES)):
        t[:, fence] = fence
        t[closing, fence] = B_NONE
    t[L_BREAK, :] = B_NONE
    return t


LINES = _line_table()
BULLETS = {ord(x) for x in "-*+•‣◦▪●·"}


def _line_class(head: str) -> int:
    """Class of a line by its text, leading white space removed."""
    if not head:
        return L_BLANK
    c = head[0]
    if c in "`~" and head[:3] == c * 3:
        info = head.strip(c + " \t\r\n")
        return (L_TICKS if c == "`" else L_TILDES) + bool(info)
    if c == "#":
        n = len(head) - len(head.lstrip("#"))
        return L_HEAD if n <= 6 and (len(head) == n or head[n].isspace()) else L_PLAIN
    if c in "-*_=" and len(head.strip()) >= 3 and not head.strip().strip(c):
        return L_RULE
    if ord(c) in BULLETS:
        return L_ITEM if head[1:2].isspace() else L_PLAIN
    if c.isdigit():
        k = 1
        while k < len(head) and k < 10 and head[k].isdigit():
            k += 1
        if head[k : k + 1] in (".", ")") and head[k + 1 : k + 2].isspace():
            return L_ITEM if head[:k] == "1" else L_NUMBER
    return L_PLAIN


def _blocks(whole: str, cp: np.ndarray, kind: np.ndarray, doc_starts: np.ndarray):
    """(start of each block, is it a paragraph); blocks cover everything up to the next start."""
    n = len(cp)
    newline = (cp == 10) | ((cp == 13) & (np.append(cp[1:], 0) != 10))
    starts = np.unique(np.concatenate([np.flatnonzero(newline) + 1, doc_starts]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    first = np.minimum(np.append(_next_index(kind != WHITE), n)[starts], ends)
    lead = np.where(first < ends, cp[np.minimum(first, n - 1)], 10)
    cls = np.full(len(starts), L_PLAIN, np.int32)
    cls[first >= ends] = L_BLANK
    special = np.isin(lead, [*map(ord, "`~#_="), *BULLETS]) | (kind[np.minimum(first, n - 1)] == DIGIT)
    for k in np.flatnonzero(special & (first < ends)):
        cls[k] = _line_class(whole[first[k] : ends[k]])
    new_doc = np.isin(starts, doc_starts)
    at = np.flatnonzero(new_doc)
    state = np.delete(states_before(np.insert(cls, at, L_BREAK), LINES), at + np.arange(len(at)))
    fenced = (state == B_TICKS) | (state == B_TILDES)
    opens = np.isin(cls, [L_TICKS, L_TICKS_INFO, L_TILDES, L_TILDES_INFO])
    begins = new_doc | ((~fenced) & (opens | np.isin(cls, [L_BLANK, L_HEAD, L_RULE, L_ITEM])))
    begins |= (~fenced) & (cls == L_NUMBER) & (state != B_PARA)
    begins |= (~fenced) & (state == B_NONE)
    begins[1:] |= fenced[:-1] & ~fenced[1:]  # the line after a closing fence
    single = fenced | opens | np.isin(cls, [L_HEAD, L_RULE, L_ITEM]) | ((cls == L_NUMBER) & (state != B_PARA))
    k = np.flatnonzero(begins)
    return starts[k], ~single[k]


# ---------------------------------------------------------------- quotes and brackets
Q_OUT, Q_LOW, Q_LEFT = range(3)
QUOTES = np.array([[Q_LOW, Q_LOW, Q_LOW], [Q_LEFT, Q_OUT, Q_LEFT], [Q_OUT, Q_OUT, Q_OUT], [Q_OUT, Q_OUT, Q_OUT]], np.uint8)  # „ “ ” break


def _depth_steps(cp: np.ndarray, kind: np.ndarray, block: np.ndarray) -> np.ndarray:
    """+1 at each opening and -1 at each closing mark of a pair; types unbalanced in their block are left out."""
    n = len(cp)
    steps = np.zeros(n, np.int8)

    def add(pos: np.ndarray, sign: np.ndarray) -> None:
        if not len(pos):
            return
        b = block[pos]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        run = np.cumsum(sign)
        base = np.repeat(run[first] - sign[first], np.diff(np.append(first, len(pos))))
        level = run - base
        low = np.minimum.reduceat(level, first)
        last = level[np.append(first[1:], len(pos)) - 1]
        ok = np.repeat((low >= 0) & (last == 0), np.diff(np.append(first, len(pos))))
        steps[pos[ok]] = sign[ok]

    for a, b in PAIRS.items():
        pos = np.flatnonzero((cp == a) | (cp == b))
        add(pos, np.where(cp[pos] == a, 1, -1))
    pos = np.flatnonzero((cp == LOW9) | (cp == LEFT) | (cp == RIGHT))
    if len(pos):
        cls = np.where(cp[pos] == LOW9, 0, np.where(cp[pos] == LEFT, 1, 2))
        at = np.flatnonzero(np.append(True, block[pos][1:] != block[pos][:-1]))
        state = np.delete(states_before(np.insert(cls, at, 3), QUOTES), at + np.arange(len(at)))
        add(pos, np.where((cls == 0) | ((cls == 1) & (state != Q_LOW)), 1, -1))
    pos = np.flatnonzero(cp == DOUBLE)
    if len(pos):
        b = block[pos]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        nth = np.arange(len(pos)) - np.repeat(first, np.diff(np.append(first, len(pos))))
        add(pos, np.where(nth % 2 == 0, 1, -1))
    pos = np.flatnonzero(cp == SINGLE)
    if len(pos):
        before = np.where(pos > 0, kind[pos - 1], WHITE)
        after = np.where(pos + 1 < n, kind[np.minimum(pos + 1, n - 1)], WHITE)
        opening = np.isin(before, [WHITE, OPENER]) & np.isin(after, [UPPER, LOWER, UNICASE, DIGIT])
        closing = np.isin(before, [DOTS, WEAK, STOP, CONT, UPPER, LOWER, UNICASE, DIGIT]) & ~np.isin(after, [UPPER, LOWER, UNICASE, DIGIT, MARKS])
        keep = opening | closing
        pos, sign = pos[keep], np.where(opening[keep], 1, -1)
        if len(pos):  # an apostrophe closes only what the mark before it opened
            same = np.append(False, (block[pos][1:] == block[pos][:-1]) & (sign[:-1] == 1) & (sign[1:] == -1))
            pair = same | np.append(same[1:], False)
            add(pos[pair], sign[pair])
    return steps


# ---------------------------------------------------------------- characters to sentence ends
C_PLAIN, C_OPEN, C_INNER, C_CLOSE, C_CLOSE_FIRST, C_CLOSE_ANY, C_END, C_BREAK = range(8)
S_START, S_MID, S_IN_FIRST, S_IN_MID = range(4)


def _char_table() -> tuple[np.ndarray, np.ndarray]:
    nxt, end = np.zeros((8, 4), np.uint8), np.zeros((8, 4), bool)
    nxt[C_PLAIN] = [S_MID, S_MID, S_IN_FIRST, S_IN_MID]
    nxt[C_OPEN] = [S_IN_FIRST, S_IN_MID, S_IN_FIRST, S_IN_MID]
    nxt[C_INNER] = [S_MID, S_MID, S_IN_FIRST, S_IN_MID]
    nxt[C_CLOSE] = S_MID
    nxt[C_CLOSE_FIRST] = [S_MID, S_MID, S_START, S_MID]
    nxt[C_CLOSE_ANY] = nxt[C_END] = nxt[C_BREAK] = S_START
    end[C_CLOSE_FIRST, S_IN_FIRST] = True
    end[C_CLOSE_ANY] = end[C_END] = True
    return nxt, end


CHARS, ENDS = _char_table()


class Words:
    """The word lists as one automaton: ``table[class, state]``, ``says[state]``; state 0 is dead, 1 the start."""

    def __init__(self, lists: dict[int, set[str]]):
        letters = sorted({c for words in lists.values() for w in words for c in w})
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        number = {c: k + 1 for k, c in enumerate(letters)}
        edges: list[dict[int, int]] = [{}, {}]
        says = [0, 0]
        for bit, words in lists.items():
            for w in words:
                at = 1
                for c in w:
                    if number[c] not in edges[at]:
                        edges[at][number[c]] = len(edges)
                        edges.append({})
                        says.append(0)
                    at = edges[at][number[c]]
                says[at] |= bit
        self.table = np.zeros((len(letters) + 1, len(edges)), np.int32)
        for state, out in enumerate(edges):
            for c, to in out.items():
                self.table[c, state] = to
        self.says = np.array(says, np.uint8)
        self.longest = max(len(w) for words in lists.values() for w in words)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[k] == codes, k + 1, 0)

    def run(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        """State after the characters start..end of each word, all words in lockstep; a word longer than any listed is dead."""
        state = np.ones(len(start), np.int64) if state is None else state.copy()
        state[(end - start > self.longest) | (end <= start)] = 0
        for k in range(self.longest):
            live = np.flatnonzero((state > 0) & (start + k < end))
            if not len(live):
                break
            state[live] = self.table[self.classes(low[start[live] + k]), state[live]]
        return state


#: What a listed word says: the sentence goes on, it may end, a number after it is an ordinal.
ON, MAY, ORDINAL = 1, 2, 4
WORDS = Words({ON: GOES_ON, MAY: MAY_END, ORDINAL: ORDINAL_BEFORE})


class Around:
    """What stands around each position of a text: the scans that the rules on marks look up."""

    def __init__(self, cp: np.ndarray, kind: np.ndarray):
        at = np.minimum(cp, 0x10FFFF)
        self.n, self.cp, self.kind, self.props, self.low = len(cp), cp, kind, _props[at], _low[at]
        white = kind == WHITE
        self.inverted = np.isin(cp, [0xBF, 0xA1])
        alnum = (self.props & ALNUM) > 0
        self.next_word = self._padded(_next_index(alnum | self.inverted))
        self.next_white = self._padded(_next_index(white))
        self.next_solid = self._padded(_next_index(~white))
        # Signs of an identifier or a path: a capital, a digit, a slash, an underscore, a call; or a period inside.
        self.next_sign = self._padded(_next_index(((self.props & HIGH) > 0) | np.isin(cp, [0x2F, 0x5F, 0x28])))
        self.next_inner = self._padded(_next_index((cp == 46) & np.append(alnum[1:], False)))
        wordlike = alnum | (self.props & MARK > 0) | np.isin(cp, [46, 45, 0xB0])
        self.last_gap = _last_index(~wordlike)
        self.last_solid = _last_index(~white)
        self.last_other = _last_index((self.props & ALPHA) == 0)
        self.last_hyphen = _last_index(cp == 45)
        self.last_not_digit = _last_index((self.props & NUMBER) == 0)

    def _padded(self, index: np.ndarray) -> np.ndarray:
        return np.append(index, [self.n] * 4)

    def starts_like(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How the text at each position begins: 2 like a sentence, 1 like a sentence without case, 0 like its continuation."""
        k = np.minimum(self.next_word[at], stop)
        inside = np.minimum(k, self.n - 1)
        p = self.props[inside]
        limit = np.minimum(self.next_white[k], stop)
        identifier = (self.next_sign[np.minimum(k + 1, self.n)] < limit) | (self.next_inner[np.minimum(k + 3, self.n)] < limit - 1)
        out = np.where(p & LOW, np.where(identifier, 2, 0), 1)
        out[(k >= stop) | self.inverted[inside] | ((p & HIGH) > 0)] = 2
        out[self.kind[np.minimum(at, self.n - 1)] == CONT] = 0
        return out

    def goes_on(self, dot: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Does the word before each period say that the sentence goes on?"""
        prior = np.maximum(dot - 1, 0)
        start = np.maximum(self.last_gap[prior] + 1, lowest)
        empty = start >= dot
        before = np.maximum(start - 1, 0)
        solid = np.where(start > lowest, np.maximum(self.last_solid[before], lowest - 1), lowest - 1)  # the last character before the white space
        spaced = (solid >= lowest) & (solid < start - 1)
        there = np.maximum(solid, 0)

        # A number after a word like "am" or "der", before a capital.
        digits = ~empty & (self.last_not_digit[prior] < start)
        following = self.next_solid[dot + 1]
        capital = (following < self.n) & (self.kind[np.minimum(following, self.n - 1)] == UPPER) & (following > dot)
        word = np.maximum(self.last_other[there] + 1, lowest)
        named = WORDS.says[WORDS.run(self.low, word, np.where(spaced, there + 1, word))] & ORDINAL > 0
        ordinal = digits & (dot - start <= 4) & spaced & named & capital

        # The word itself, after its last hyphen, or after a letter with a period ("т. д.", "p. ex.").
        own = WORDS.says[WORDS.run(self.low, start, dot)]
        tail = np.maximum(self.last_hyphen[prior] + 1, start)
        last = WORDS.says[WORDS.run(self.low, tail, dot)]
        letter = np.maximum(there - 1, 0)
        pair = spaced & (there - 1 >= lowest) & (self.cp[there] == 46) & ((self.props[letter] & ALPHA) > 0)
        pair &= (letter - 1 < lowest) | ((self.props[np.maximum(letter - 1, 0)] & ALNUM) == 0)
        first = WORDS.table[WORDS.classes(np.full(len(dot), 46, np.uint32)), WORDS.table[WORDS.classes(self.low[letter]), 1]]
        both = np.where(pair, WORDS.says[WORDS.run(self.low, start, dot, first)], 0)
        # The first of the three that is listed decides; a word that may end a sentence beats its other reading.
        said = np.select([both & MAY > 0, both & ON > 0, own & MAY > 0, own & ON > 0, last & MAY > 0, last & ON > 0], [MAY, ON, MAY, ON, MAY, ON], 0)
        initial = (dot - start == 1) & ((self.props[prior] & ALPHA) > 0) & ~(spaced & ((self.props[there] & NUMBER) > 0))
        return np.where(digits, ordinal, ~empty & ((said == ON) | ((said == 0) & initial)))


def sentence_spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of each sentence, in order."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    whole = "".join(t or "" for t in texts)
    n = len(whole)
    if not n:
        return (np.empty(0, np.int64),) * 3
    bases = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    cp = code_points(whole)
    kind = _kind_table()[np.minimum(cp, 0x10FFFF)]
    block_start, para = _blocks(whole, cp, kind, np.unique(bases[sizes > 0]))
    block_end = np.append(block_start[1:], n)
    block = np.zeros(n, np.int64)
    block[block_start[1:]] = 1
    block = np.cumsum(block)
    solid = kind != WHITE

    # Paragraphs mostly in Thai.
    letters = np.add.reduceat(np.isin(kind, [UPPER, LOWER, UNICASE]).astype(np.int64), block_start)
    thai = np.add.reduceat(((cp >= 0xE00) & (cp < 0xE80) & (kind == UNICASE)).astype(np.int64), block_start)
    is_thai = para & (thai * 2 > letters)
    cased = para & ~is_thai

    steps = _depth_steps(cp, kind, block)
    after = np.cumsum(steps, dtype=np.int32)
    before = after - steps
    cls = np.full(n, C_PLAIN, np.uint8)
    cls[(before > 0) & (after > 0)] = C_INNER
    cls[(before == 0) & (after > 0)] = C_OPEN
    outer = (before > 0) & (after == 0)
    cls[outer] = C_CLOSE

    in_cased = cased[block]
    around = Around(cp, kind)
    terminator = np.isin(kind, [STOP, WEAK, DOTS])
    # Outermost closing marks after a terminator.
    p = np.flatnonzero(outer & in_cased)
    if len(p):
        stop, e = block_end[block[p]], p + 1
        q = np.maximum(_last_index(~(np.isin(kind, [CLOSER, WHITE, MARKS]) | (steps < 0)))[np.maximum(p - 1, 0)], 0)
        x = np.minimum(around.next_solid[e], n)
        at_x = np.minimum(x, n - 1)
        last, gap, kx = x >= stop, x > e, kind[at_x]
        like = around.starts_like(x, stop)
        pad = np.append(cp, 0)
        held = np.isin(kx, [STOP, WEAK, DOTS, CLOSER, CONT])
        for on in QUOTED_ON:
            held |= (pad[at_x] == ord(on[0])) & ((len(on) == 1) | (pad[at_x + 1] == ord(on[-1])))
        wide = (cp[p] >= 0x3000) | (kind[q] == STOP)
        sure = (like == 2) & (gap | np.isin(kx, [OPENER, UPPER, DIGIT]))
        what = np.select([last, held, sure & (gap | ~wide), sure, (like == 1) | ((like == 2) & ~gap)], [C_CLOSE_ANY, C_CLOSE, C_CLOSE_ANY, C_CLOSE_FIRST, C_CLOSE_FIRST], C_CLOSE)
        cls[p] = np.where(terminator[q], what, C_CLOSE)
    # Runs of terminators outside of pairs.
    pos = np.flatnonzero(terminator & (before == 0) & (after == 0) & in_cased)
    if len(pos):
        apart = (np.diff(pos) > 1) | (block[pos][1:] != block[pos][:-1])
        a, b = pos[np.append(True, apart)], pos[np.append(apart, True)]
        stop = block_end[block[b]]
        # Closing marks whose partner is missing belong to the run.
        e = np.minimum(np.append(_next_index(~((kind == CLOSER) & (steps == 0))), n)[b + 1], stop)
        x = np.minimum(around.next_solid[e], n)
        kx, last, gap = kind[np.minimum(x, n - 1)], x >= stop, x > e
        total = lambda k: np.append(0, np.cumsum(kind == k))
        stops, weaks = total(STOP), total(WEAK)
        hard, weak = stops[b + 1] > stops[a], weaks[b + 1] > weaks[a]
        like = around.starts_like(x, stop)
        dots = (b > a) | (cp[b] != 46)
        on = np.zeros(len(a), bool)
        asked = np.flatnonzero(~last & ~hard & gap & (like > 0) & ~dots & ~weak)
        on[asked] = around.goes_on(a[asked], block_start[block[a[asked]]])
        ends_here = np.select(
            [last, hard, ~gap, like == 0, dots & ~weak, ~weak], [True, ~np.isin(kx, [CONT, CLOSER]), weak & np.isin(kx, [UNICASE, OPENER]), False, like == 2, ~on], True
        )
        cls[e[ends_here] - 1] = C_END
    # The transducer over the solid characters of the paragraphs, set back at each block.
    use = np.flatnonzero(solid)
    c, b = cls[use], block[use]
    c = np.where(in_cased[use], c, C_PLAIN).astype(np.int32)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(use) else np.empty(0, np.int64)
    state = np.delete(states_before(np.insert(c, at, C_BREAK), CHARS), at + np.arange(len(at)))
    ends = ENDS[c, state]
    if len(use):
        ends[np.append(b[1:] != b[:-1], True)] = True  # the end of a block
        gap_after = np.append(np.diff(use) > 1, True)
        ends |= is_thai[b] & gap_after
    end_at = use[ends] + 1
    begin = np.append(True, ends[:-1]) if len(use) else ends
    start_at = use[begin]
    doc = np.searchsorted(bases + sizes, start_at, side="right")
    return doc, start_at - bases[doc], end_at - bases[doc]


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, start_pos, end_pos[, sentence]) of every sentence of ``text``."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    if with_text:
        schema = schema.add("sentence", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batched(texts):
                doc, start, end = sentence_spans(texts[a:b])
                cols = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                if with_text:
                    cols.append(pa.array([texts[a + d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist())]))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return spread(df.select(key, text)).mapInArrow(run, schema)
