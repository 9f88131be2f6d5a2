"""Evaluation passages in training text, whole, in part or slightly changed.

The texts and answers of all test items become one Aho-Corasick automaton of
short word sequences. A passage of n words with at most one word in seven wrong
holds SEED_WORDS right words in a row (n - n/7 words in n/7 + 1 stretches), so one
scan of a document's normalised text finds every item of which it can hold a
passage. Around the places found an alignment then decides exactly. An item
shorter than the least passage leaks if it stands whole, with as many words wrong
as a passage of its length may have. Answers, often a word or two that stand in
most texts, count where they follow a passage of their item; one as long as a
passage is searched as a text of its own.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sigtrace.sources.shared import RunFolder

WORDS, CHARS = 14, 24  # the least passage by default, in words, or in characters of scripts without blanks
EACH = 7  # one error for so many words
SEED_WORDS, SEED_CHARS = 4, 5  # right words in a row to look for, if every passage has as many
MOST_KNOWN = 1 << 18  # forms of words that a task keeps
BLOCK_BYTES = 2 << 20  # of the test items' texts in one block: a task holds about 200 bytes for each of it

_CJK = "㐀-鿿豈-﫿぀-ヿ\U00020000-\U0003FFFF"
_JOIN = "['’‘ʼ`´\\-‐‑‒­​]"
_UNIT = regex.compile(rf"(?V1)[{_CJK}]|[\w--[_{_CJK}]]+(?:{_JOIN}+[\w--[_{_CJK}]]+)*")
_ASCII = re.compile(r"[A-Za-z0-9]+(?:['`\-]+[A-Za-z0-9]+)*")
_JOINS = re.compile(f"{_JOIN}+")
_WIDE = re.compile(rf"[{_CJK}]\Z")


def words(text: str, known: dict[str, str] | None = None) -> list[str]:
    """The normalised words of a text.

    Case, punctuation, quote marks, blanks and line breaks do not count; a
    hyphen or apostrophe inside a word is left out; of scripts without blanks
    each character is a word. Letters are compared in compatibility form.
    ``known`` keeps the forms of words that were met before.
    """
    if text.isascii():
        found = _ASCII.findall(text.lower())
        if "-" in text or "'" in text or "`" in text:
            return [w if w.isalnum() else _JOINS.sub("", w) for w in found]
        return found
    known = {} if known is None else known
    found = _UNIT.findall(text)
    try:
        return [known[w] for w in found]
    except KeyError:
        if len(known) > MOST_KNOWN:
            known.clear()
        for w in set(found):
            n = w.casefold()
            if not n.isascii():
                n = unicodedata.normalize("NFKC", n).casefold()
            known[w] = n if n.isalnum() else _JOINS.sub("", n)
        return [known[w] for w in found]


def places(text: str) -> list[tuple[int, int]]:
    """Where each of the ``words`` lies in the text, in code points."""
    return [m.span() for m in (_ASCII if text.isascii() else _UNIT).finditer(text)]


def is_wide(item: list[str]) -> bool:
    return sum(1 for w in item if _WIDE.match(w)) * 2 > len(item)


def holds(item: np.ndarray, doc: np.ndarray, least: int, each: int = EACH) -> tuple[int, int] | None:
    """Whether ``doc`` holds a passage of at least ``least`` words of ``item`` with at most one word in ``each`` wrong.

    Gives the first and last position in ``doc`` of one such passage, else None.
    An alignment over (item word, document word, length up to ``least``): a right
    word counts 1, a changed or missing one 1 - each, an added one -each; a
    passage is good if its sum is not negative.
    """
    width = len(doc)
    low = np.int32(-(10**6))
    steps = np.arange(width + 1, dtype=np.int32)
    rows = np.full((least + 1, width + 1), low, np.int32)  # best sum by length and end in doc
    rows[0] = 0
    at = np.broadcast_to(steps, rows.shape).copy()  # where that best began
    for w in item:
        new = np.full_like(rows, low)
        start = np.broadcast_to(steps, rows.shape).copy()
        diag = rows[:, :-1] + np.where(doc == w, 1, 1 - each).astype(np.int32)
        missing = rows + np.int32(1 - each)
        new[1:, 1:] = diag[:-1]
        start[1:, 1:] = at[:-1, :-1]
        better = diag[-1] > new[-1, 1:]
        new[-1, 1:][better] = diag[-1][better]
        start[-1, 1:][better] = at[-1, :-1][better]
        for to, frm, frm_at in ((new[1:], missing[:-1], at[:-1]), (new[-1:], missing[-1:], at[-1:])):
            better = frm > to
            to[better] = frm[better]
            (start[1:] if to.shape[0] > 1 else start[-1:])[better] = frm_at[better]
        spread = new + each * steps
        top = np.maximum.accumulate(spread, axis=1)
        where = np.where(spread == top, steps, 0)
        source = np.maximum.accumulate(where, axis=1)
        new = top - each * steps
        start = np.take_along_axis(start, source, axis=1)
        new[0], start[0] = 0, steps
        good = np.flatnonzero(new[-1] >= 0)
        if len(good):
            end = int(good[0])
            return int(start[-1, end]), end - 1
        rows, at = new, start
    return None


def seed_length(least: int, wide: bool) -> int:
    """How many right words in a row every passage of ``least`` words or more has, at most SEED_WORDS or SEED_CHARS.

    A passage of n words has n // EACH errors at most, so a right stretch of
    (n - n // EACH) / (n // EACH + 1) words; the quotient is least at a multiple of EACH.
    """
    longest = SEED_CHARS if wide else SEED_WORDS
    tried = range(least, max(least, longest * EACH) + EACH + 1)
    return max(min(longest, *(-(-(n - n // EACH) // (n // EACH + 1)) for n in tried)), 1)


class Leaks:
    """The automaton over the items, made anew in each worker from (item, text, answer) triples."""

    def __init__(self, items: list[tuple], least_words: int = WORDS, least_chars: int = CHARS):
        self.ids: list = []
        self.least: list[int] = []
        self.texts: list[np.ndarray] = []
        self.words: list[list[str]] = []
        self.answers: list[str] = []
        self.known: dict[str, str] = {}
        codes: dict[str, int] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        def full_of(item: list[str]) -> tuple[bool, int]:
            return (True, least_chars) if is_wide(item) else (False, least_words)

        searched = []
        for ident, text, answer in items:
            said = words(answer or "")
            searched.append((ident, words(text or ""), said))
            if len(said) >= full_of(said)[1]:
                searched.append((ident, said, []))
        for ident, item, said in searched:
            if not item:
                continue
            wide, full = full_of(item)
            least = min(full, len(item))
            # An item shorter than the least passage must stand whole; others are found by the seeds of longer passages too.
            errors = least // EACH
            seed = seed_length(least, wide) if len(item) >= full else min(SEED_CHARS if wide else SEED_WORDS, -(-(least - errors) // (errors + 1)))
            k = len(self.ids)
            self.ids.append(ident)
            self.least.append(least)
            self.words.append(item)
            self.answers.append(" ".join(said))
            self.texts.append(np.array([codes.setdefault(w, len(codes)) for w in item], np.int32))
            for i in range(len(item) - seed + 1):
                seeds.setdefault(" " + " ".join(item[i : i + seed]) + " ", []).append((k, i))
        self.codes = codes
        self.automaton = ahocorasick.Automaton()
        answers = {f" {a} " for a in self.answers if a}
        for s in {*seeds, *answers}:
            self.automaton.add_word(s, (s.count(" ") - 1, seeds.get(s, ()), s if s in answers else None))
        if seeds:
            self.automaton.make_automaton()
        self.any = bool(seeds)

    def search(self, text: str) -> list[tuple]:
        """(item, first, end, answer first, answer end) of the items a text gives away, in code points; the answer's place
        is that of its first standing after the passage, None if there is none."""
        if not self.any:
            return []
        doc = words(text, self.known)
        if not doc:
            return []
        line = " " + " ".join(doc) + " "
        hits: dict[int, list[tuple[int, int]]] = {}
        said: dict[str, list[int]] = {}
        ends = None
        for end, (size, where, answer) in self.automaton.iter(line):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in doc])
            last = int(np.searchsorted(ends, end))
            for k, i in where:
                hits.setdefault(k, []).append((last - size + 1, i))
            if answer is not None:
                said.setdefault(answer, []).append(last - size + 1)
        out = []
        spans: list[tuple[int, int]] = []
        for k, found in hits.items():
            passage = self.verify(k, found, doc)
            if passage:
                spans = spans or places(text)
                stop = min(passage[1], len(spans) - 1)
                answer = self.answers[k]
                starts = said.get(f" {answer} ", []) if answer else []
                at = bisect_right(starts, stop)
                there = (spans[starts[at]][0], spans[starts[at] + answer.count(" ")][1]) if at < len(starts) else (None, None)
                out.append((self.ids[k], spans[passage[0]][0], spans[stop][1], *there))
        return out

    def verify(self, k: int, found: list[tuple[int, int]], doc: list[str]) -> tuple[int, int] | None:
        """Align around the places found.

        A passage of 2 * least words or more can be halved so that one half is a
        passage as well; so there is one of less than 2 * least words if there is
        any, with at most ``most`` errors, and it lies around one of the places.
        """
        item, least = self.texts[k], self.least[k]
        reach = 2 * least - 1 if least < len(item) else least
        most = reach // EACH
        groups: list[list[int]] = []  # item from, to, document from, to
        for d, i in sorted(found):
            new = [i - reach, i + reach, d - reach - most, d + reach + most]
            if groups and d - reach - most <= groups[-1][3] and d + reach + most - groups[-1][2] < 8 * reach:
                g = groups[-1]
                g[0], g[1], g[3] = min(g[0], new[0]), max(g[1], new[1]), max(g[3], new[3])
            else:
                groups.append(new)
        for i0, i1, d0, d1 in groups:
            i0, d0 = max(i0, 0), max(d0, 0)
            near = set(doc[d0:d1])
            there = [w in near for w in self.words[k][i0:i1]]
            count = best = sum(there[:least])
            for out, new in zip(there, there[least:]):
                count += new - out
                if count > best:
                    best = count
            if best < least - most or len(there) < least:
                continue
            part, around = item[i0:i1], np.array([self.codes.get(w, -1) for w in doc[d0:d1]], np.int32)
            if not enough(part, around, least, most):
                continue
            passage = holds(part, around, least)
            if passage:
                return d0 + passage[0], d0 + passage[1]
        return None


def enough(item: np.ndarray, doc: np.ndarray, least: int, most: int) -> bool:
    """A necessary condition: of some ``least`` item words in a row all but ``most`` stand in ``doc``, near one diagonal.

    Errors move a passage by at most ``most`` words, so for each diagonal the
    words within that distance of it are counted.
    """
    n, m = len(item), len(doc)
    if n < least:
        return False
    same = np.zeros((n, m + n + 2 * most), bool)  # by item word and diagonal
    i, j = np.nonzero(item[:, None] == doc[None, :])
    if not len(i):
        return False
    same[i, j - i + n + most] = True
    wide = np.cumsum(np.pad(same, ((0, 0), (most + 1, most))), axis=1)
    near = (wide[:, 2 * most + 1 :] - wide[:, : -2 * most - 1]) > 0
    total = np.cumsum(np.pad(near, ((1, 0), (0, 0))), axis=0)
    return bool((total[least:] - total[:-least]).max() >= least - most)


def item_blocks(items: DataFrame, item_id: str, item_texts: tuple[str, ...], answer: str | None, block_bytes: int) -> tuple[DataFrame, int]:
    """``i, t, a, block``: the items' distinct texts in blocks of about ``block_bytes``, and the number of blocks.

    All texts of one item are in one block.
    """
    said = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    texts = items.select(F.col(item_id).alias("i"), F.explode(F.array(*[F.col(c).cast("string") for c in item_texts])).alias("t"), said.alias("a")).filter("t is not null or a is not null").distinct()
    size = texts.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    blocks = 1 if size <= block_bytes else -(-size * 2 // block_bytes)  # hashing fills them unevenly
    return texts.withColumn("block", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(blocks))), blocks


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("text",),
    answer: str | None = None,
    least_words: int = WORDS,
    least_chars: int = CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col, item_id, start_pos, end_pos, answer_start, answer_end``: one row per document row and item of which it holds a passage.

    A passage has ``least_words`` words (``least_chars`` characters of scripts
    without blanks) in a row or is a shorter item's whole text; one word in EACH
    may be wrong. The answer's place is given where the item's ``answer`` stands
    after the passage. The items go to every task in blocks of ``block_bytes``;
    if there are several the documents are scanned once for each. Null and empty
    texts hold nothing and cannot leak; repeated documents count each, an item
    with several texts (or repeated rows) once.
    """
    texts, blocks = item_blocks(items, item_id, item_texts, answer, block_bytes)
    if blocks > 1:  # read again for each block
        texts = RunFolder(documents.sparkSession, "items").write(texts.repartitionByRange("block"), "blocks")
    spark = documents.sparkSession
    source = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    ident = items.schema[item_id].dataType
    places_of = ["start_pos", "end_pos", "answer_start", "answer_end"]
    schema = T.StructType([source.schema[0], T.StructField("item_id", ident), *[T.StructField(c, T.LongType()) for c in places_of]])
    item_type = to_arrow_type(ident)

    def scan(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(known.value, least_words, least_chars)
            for batch in batches:
                row, item, spots = [], [], [[], [], [], []]
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if text:
                        best: dict = {}
                        for ident, *found in leaks.search(text):
                            if ident not in best or best[ident][2] is None and found[2] is not None:
                                best[ident] = found
                        for ident, found in best.items():
                            row.append(i)
                            item.append(ident)
                            for c, x in zip(spots, found):
                                c.append(x)
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), *[pa.array(c, pa.int64()) for c in spots]], names=schema.names)

        return source.mapInArrow(run, schema)

    found = None
    for k in range(blocks):  # a block is bounded, see BLOCK_BYTES
        known = spark.sparkContext.broadcast([tuple(r) for r in texts.filter(F.col("block") == k).select("i", "t", "a").collect()])
        found = scan(known) if found is None else found.unionAll(scan(known))
    return found
