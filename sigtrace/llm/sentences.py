"""Sentence units of texts in any language and script, as offsets.

A text is cut into blocks at blank lines and into lines where lines count
(headings, list items, log lines). A pushdown automaton walks over the lines of a
block with the open list levels on its stack, by the indentation and kind of
their marks: an item line opens a level, goes on in one that is open or closes
those below it, and any other line belongs to the item on top. Within a piece it
walks over the marks alone: the stack holds the open quotations and brackets
(only pairs that close count), and at each end mark outside of them it decides by
the word before, looked up in tries of abbreviations, the mark itself and what
follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that never end a sentence, whatever follows.
NEVER = "mr mrs dr prof st herr sr sra mme mlle cf vs approx max incl excl e.g i.e ca bzw evtl ggf inkl vgl sog ex env ej máx mín aprox z.b d.h u.a p.ex p.ej viz"
# Abbreviations that count as such only before a number.
BEFORE_NUMBER = "no nos nr nº n fig figs eq tab sec secs ch vol pp p ref refs art abschn kap secc pág núm"
# Abbreviations that end a sentence if a new one follows.
MAYBE = "etc usw ff a.m p.m inc ltd co corp llc gmbh jr u.s u.k e.u"
# Units of measure written as abbreviations.
UNITS = "min mins hrs hr sek std"
# Names of months written short.
MONTHS = "jan feb mar apr jun jul aug sep sept oct okt nov dec dez"
# Words with which a sentence goes on after an abbreviation or unit.
ON = "and or nor but to of in on at for from with by after before until till during per than then when while which that as und oder bis nach vor von zu mit et ou de à y o en a con before because so since if"
# Words before a German ordinal.
ORDINAL = "der die das dem den am vom zum beim im ab bis"
# Pairs of quotation marks and brackets.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "„": "“”", "“": "”", "‹": "›"}
QUOTES = "\"„“”«»‹›「」『』"
CLOSERS = frozenset("".join(PAIRS.values()) + "\"")
CERTAIN = frozenset("。！？।॥؟۔．︒｡‼⁇⁈⁉")  # end marks that are nothing else
OPENS = frozenset("\"„“«‹「『([{（【《¿¡")

MARK = re.compile(r"[.!?…。！？।॥؟۔．︒｡‼⁇⁈⁉]+|[()\[\]{}（）［］【】〔〕《》〈〉「」『』«»„“”‹›\"]")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
ITEM = re.compile(r"(?:[-*•‣◦–—·]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|[①-⑳])\s+(?=\S)")
LOG = re.compile(r"\[?(?:[0-9]{4}-[0-9]{2}-[0-9]{2}[T ])?[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\]?\s+\S")
HEADING = re.compile(r"#{1,6}\s+\S")
PREFIX = re.compile(r"(?:[A-Z][A-Za-z]{0,2}:|>)\s+")
BLANKS = re.compile(r"\s+")
WORD = re.compile(r"\S+\Z")
CJK = re.compile(r"[⺀-鿿豈-﫿＀-￯]")
THAI = re.compile(r"[฀-๿]")


def _trie(words: str) -> dict:
    root: dict = {}
    for w in words.split():
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = True
    return root


TRIES = {name: _trie(words) for name, words in (("never", NEVER), ("number", BEFORE_NUMBER), ("maybe", MAYBE), ("unit", UNITS), ("month", MONTHS), ("on", ON), ("ordinal", ORDINAL))}


def known(name: str, word: str) -> bool:
    at = TRIES[name]
    for c in word:
        at = at.get(c)
        if at is None:
            return False
    return "" in at


OPENERS: dict[str, str] = {}
for _o, _cs in PAIRS.items():
    for _c in _cs:
        OPENERS[_c] = OPENERS.get(_c, "") + _o


class _Open:
    """A stack of opening marks that knows the topmost place of each kind, so unclosed marks cost nothing."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, mark: str, at: int) -> None:
        self.places.setdefault(mark, []).append(len(self.stack))
        self.stack.append((mark, at))

    def top(self, kinds: str) -> int | None:
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=None)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()


def pairs(text: str, marks: list[re.Match]) -> dict[int, int]:
    """The stack of the automaton: of the pairs that close, the place of the closing for each opening mark."""
    found: dict[int, int] = {}
    open_ = _Open()
    for m in marks:
        c, i = m.group(), m.start()
        if len(c) > 1 or c not in CLOSERS and c not in PAIRS:
            continue
        if c == '"':
            opens = (i == 0 or not text[i - 1].isalnum() and text[i - 1] not in ".!?,%…") and i + 1 < len(text) and not text[i + 1].isspace()
            closes = i > 0 and not text[i - 1].isspace()
            at = open_.top('"')
            if at is not None and (closes or not opens):
                found[open_.stack[at][1]] = i
                open_.cut(at)
            elif opens:
                if at is not None:
                    open_.cut(at)
                open_.push(c, i)
            continue
        at = open_.top(OPENERS.get(c, ""))
        if at is not None:
            found[open_.stack[at][1]] = i
            open_.cut(at)
        elif c in PAIRS:
            open_.push(c, i)
    return found


def _next_word(text: str, at: int) -> str:
    m = re.compile(r"[^\W\d_]+").match(text, at)
    return m.group() if m else ""


def _starts(text: str, at: int) -> bool:
    """Whether a new sentence may begin here by its looks: upper case or an opening mark before one."""
    c = text[at]
    if c in OPENS:
        return at + 1 < len(text) and (text[at + 1] in OPENS or not text[at + 1].islower())
    return c.isupper()


def word_start(text: str, begin: int, start: int) -> int:
    """Where the word before ``start`` begins: after the last white space, however far that is."""
    at = start
    while at > begin:
        lo = max(begin, at - 64)
        m = WORD.search(text, lo, at)
        if m is None:
            return at
        if m.start() > lo:
            return m.start()
        at = lo
    return begin


def ends_sentence(text: str, begin: int, start: int, end: int, after: int, nxt: int) -> bool:
    """Whether the end marks at ``start:end`` end a sentence that began at ``begin``.

    ``after`` follows their closing quotes and brackets, ``nxt`` is the place of
    the next character that is no blank.
    """
    mark, blank, n = text[start:end], nxt > after, text[nxt]
    if any(c in CERTAIN for c in mark):
        return True
    if not blank and after == end and not ("…" in mark or mark.startswith("...") or "!" in mark or "?" in mark) and (n.isdigit() or n.islower() or n in "_/\\-=,;:"):
        return False
    word = text[word_start(text, begin, start) : start].lstrip("(\"„“«[¿¡‹>")
    if "…" in mark or mark.startswith("..."):  # hesitation
        return bool(start and CJK.match(text, start - 1)) or _starts(text, nxt)
    if "!" in mark or "?" in mark:
        return blank or ("/" not in word and (n in OPENS or n.isalpha()))
    low = re.sub(r"^[cdjlmnst]['’]|^qu['’]", "", word.lower())  # French elision
    if mark == ".." and (known("month", low) or known("maybe", low) or known("unit", low)):
        return True  # an abbreviation's dot, and the end
    if not blank:
        if "/" in word or "@" in word or (len(word) == 1 and word.isupper() or re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", word)):
            return False
        return _starts(text, nxt) or bool(CJK.match(n)) or n.isalpha() and not n.islower()
    if known("never", low) or word == "Ms":
        return False
    if known("number", low) and (low not in ("n", "p") or n.isdigit()):
        return not (n.isdigit() or n.isupper() and text[nxt + 1 : nxt + 2].isdigit())
    if len(word) == 1 and word.isalpha() or low == "min":
        before = WORD.search(text, begin, max(begin, start - len(word) - 1)) if start - len(word) - 1 > begin else None
        before = before or WORD.search(text[begin : start - len(word)].rstrip())
        measured = bool(before and re.fullmatch(r"[+-]?[0-9][0-9.,]*", before.group()))
        if low != "min":
            return measured
        if not measured:
            return False
    if known("unit", low):
        return not known("on", _next_word(text, nxt))
    if known("month", low):
        return _starts(text, nxt) and len(text[begin:start].split()) > 3
    if known("maybe", low):
        if n.islower():
            return low in ("a.m", "p.m") and not known("on", _next_word(text, nxt))
        return True
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):  # initials such as U.S.E.
        return _starts(text, nxt)
    if word.isdigit() and len(word) <= 2:
        before = text[begin : start - len(word)].split()
        if not before or known("ordinal", before[-1].lower()):
            return False
    return True


def cut(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The units of one block of running text, between ``lo`` and ``hi``."""
    t = text[lo:hi]
    size = len(t.rstrip())
    thai = THAI.search(t) is not None
    marks = [m for m in MARK.finditer(t, 0, size)]
    if not marks and not thai:
        yield lo, lo + size
        return
    closing = pairs(t, marks)
    begin = 0
    body = begin_of(t, begin)
    skip = -1
    stops = sorted([(m.start(), m.end(), False) for m in marks] + ([(m.start(), m.end(), True) for m in BLANKS.finditer(t, 0, size)] if thai else []))
    for start, end, is_blank in stops:
        if start < skip or start < body:
            continue
        if is_blank:
            a, b = t[start - 1], t[end]
            touches = (a.isalnum() and (a.isascii() or a.isdigit())) or (b.isalnum() and (b.isascii() or b.isdigit()))
            if not touches and (THAI.match(a) or THAI.match(b)) and start > begin:
                yield lo + begin, lo + start
                begin = end
                body = begin_of(t, begin)
            continue
        c = t[start]
        bracket_end = False
        if start in closing:  # a pair: what is inside ends nothing
            close = closing[start]
            after = close + 1
            inner = t[start + 1 : close].rstrip()
            stopped = bool(inner) and (inner[-1] in ".!?…" or inner[-1] in CERTAIN or inner[-1] in CLOSERS and len(inner) > 1 and (inner[-2] in ".!?…" or inner[-2] in CERTAIN))
            skip = after
            if not stopped:
                continue
            while after < size and t[after] in CLOSERS and after not in closing:
                after += 1
            nxt = after
            while nxt < size and t[nxt].isspace():
                nxt += 1
            if nxt >= size:
                continue
            if c in QUOTES:
                over = nxt > after and _starts(t, nxt)
            else:
                over = start == body
            if not over:
                continue
            bracket_end = True
        elif c in CLOSERS or c in PAIRS:
            continue
        else:
            after = end
            while after < size and t[after] in CLOSERS and after not in closing:
                after += 1
            nxt = after
            while nxt < size and t[nxt].isspace():
                nxt += 1
            if nxt >= size:
                continue
        if bracket_end or ends_sentence(t, body, start, end, after, nxt):
            yield lo + begin, lo + after
            begin = nxt
            body = begin_of(t, begin)
            skip = max(skip, after)
    if begin < size:
        yield lo + begin, lo + size


def begin_of(t: str, at: int) -> int:
    """Where a unit's sentence begins, after list marks and prefixes such as ``Q:``."""
    while True:
        m = PREFIX.match(t, at) or (ITEM.match(t, at) if at == 0 else None)
        if not m:
            return at
        at = m.end()


def _mark_kind(mark: str) -> str:
    """bullet, number, letter or the like: what a list's marks have in common."""
    m = mark.strip()
    if m[0] not in "(" and not m[0].isalnum():
        return "circled" if "①" <= m[0] <= "⑳" else m[0]
    inner = m.strip("().")
    return ("number" if inner.isdigit() else "letter") + m.replace(inner, "")


def _first_of_list(mark: str, kind: str) -> bool:
    """Whether a mark can begin a list: any bullet, or the first number or letter."""
    return not kind.startswith(("number", "letter")) or mark.strip().strip("().").lower() in ("0", "1", "a", "i")


def _introduces(line: str) -> bool:
    """Whether a line of running text can stand before a list without a blank line between: it ends with a colon."""
    return line.endswith((":", "："))


def units(text: str | None) -> list[tuple[int, int]]:
    """The sentence units of a text as code point offsets, end exclusive, in order.

    Null, empty and blank texts have none. Every character that is no white
    space is in exactly one unit.
    """
    if not text:
        return []
    lines: list[tuple[int, int]] = []
    at = 0
    for m in BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    out: list[tuple[int, int]] = []
    block: list[tuple[int, int, int]] = []  # from, to, indentation

    def close() -> None:
        """Cut the block into pieces of one or more lines that belong together."""
        if not block:
            return
        logged = LOG.match(text[block[0][0] : block[0][1]]) is not None
        pieces: list[list] = []  # [from, to, whole]
        levels: list[tuple[int, str]] = []  # the stack: indentation and kind of mark of each open list
        for k, (a, b, indent) in enumerate(block):
            line = text[a:b]
            if HEADING.match(line):
                pieces.append([a, b, True])
                levels.clear()
                continue
            if logged and LOG.match(line):
                pieces.append([a, b, True])
                continue
            item = ITEM.match(line)
            starts = not pieces or pieces[-1][2]
            if item:
                kind = _mark_kind(item.group())
                while levels and levels[-1][0] > indent and any(level[0] <= indent for level in levels[:-1]):
                    levels.pop()  # back to a list further out
                if levels and (levels[-1][1] == kind or any(level[1] == kind for level in levels) or indent > levels[-1][0]):
                    starts = True
                    if indent > levels[-1][0]:
                        levels.append((indent, kind))
                elif levels:
                    starts = True  # another kind of mark within a list
                elif starts or _introduces(text[block[k - 1][0] : block[k - 1][1]]) and _first_of_list(item.group(), kind):
                    starts = True
                    levels.append((indent, kind))
            if starts:
                pieces.append([a, b, False])
            else:
                pieces[-1][1] = b
        for a, b, whole in pieces:
            if whole:
                out.append((a, b))
            else:
                out.extend(cut(text, a, b))
        block.clear()

    for a, b in lines:
        begin = a
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            close()
        else:
            block.append((a, b, a - begin + 3 * text.count("\t", begin, a)))
    close()
    return out


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per unit: the id, ``unit_no`` from 0, ``start_pos``, ``end_pos`` and, if asked for, ``unit``.

    Rows are independent and stay in their partition. Repeated rows and ids give
    their units each.
    """
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    fields = [source.schema[0], T.StructField("unit_no", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("unit", T.StringType())] if with_text else []))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, start, end, unit = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(units(text)):
                    row.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(b)
                    if with_text:
                        unit.append(text[a:b])
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.record_batch(cols + ([pa.array(unit, pa.string())] if with_text else []), names=names)

    return source.mapInArrow(run, schema)
