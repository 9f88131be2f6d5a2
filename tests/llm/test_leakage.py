import random

import numpy as np
import pytest

from sigtrace.llm import leakage as L

WORDS = [f"w{i}x" for i in range(400)]


def errors(item, doc):
    """Least number of changed, missing or added words between two lists, by plain dynamic programming."""
    row = list(range(len(doc) + 1))
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(item, doc, least):
    for i in range(len(item)):
        for j in range(i + least, len(item) + 1):
            allowed = (j - i) // L.EACH
            for a in range(len(doc)):
                for b in range(max(a, a + j - i - allowed), min(len(doc), a + j - i + allowed) + 1):
                    if errors(item[i:j], doc[a:b]) * L.EACH <= j - i:
                        return True
    return False


def test_alignment_against_brute_force():
    rnd = random.Random(4)
    seen = set()
    for _ in range(60):
        item = [rnd.randint(0, 50) for _ in range(16)]
        doc = item[rnd.randint(0, 2) : rnd.randint(12, 16)]
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(doc))
            doc[k : k + rnd.randint(0, 1)] = [99] * rnd.randint(0, 1)
        doc = [77] * rnd.randint(0, 2) + doc + [78] * rnd.randint(0, 2)
        want = brute(item, doc, L.WORDS)
        seen.add(want)
        assert (L.holds(np.array(item), np.array(doc), L.WORDS) is not None) == want
    assert seen == {True, False}


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_what_the_alignment_finds(seed):
    rnd = random.Random(seed)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(60))) for k in range(12)]
    leaks = L.Leaks([(k, t, None) for k, t in items])
    hits = 0
    for _ in range(60):
        doc = [rnd.choice(WORDS) for _ in range(40)]
        k = rnd.randrange(12)
        n, a = rnd.randint(8, 34), rnd.randint(0, 20)
        part = items[k][1].split()[a : a + n]
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(part))
            part[at : at + rnd.randint(0, 1)] = [rnd.choice(WORDS)] * rnd.randint(0, 1)
        doc[10:10] = part
        codes = np.array([leaks.codes.get(w, -1) for w in doc])
        want = {i for i, t in items if L.holds(np.array([leaks.codes[w] for w in t.split()]), codes, L.WORDS)}
        got = {i for i, *_ in leaks.search(", ".join(doc).upper())}
        assert got == want
        hits += len(want)
    assert 10 < hits < 60


def test_normalisation_and_offsets():
    text = "“Half-open   TICKETS”,\r\n> don't stop！租约之前"
    places = L.places(text)
    assert L.words(text) == ["halfopen", "tickets", "dont", "stop", "租", "约", "之", "前"]
    assert [text[a:b] for a, b in places[:4]] == ["Half-open", "TICKETS", "don't", "stop"]


def test_table(spark):
    passage = "the anchor gateway rarely fragments sixty stacked leases behind the dormant bearer until each partly renumbers seven reports"
    zh = "由于备用调度器在切片以外强行继承四十份反射的租约漫游转发器便反复继承五份探针"
    items = spark.createDataFrame([(1, passage, None), (2, zh, "x"), (3, None, None), (4, "too short", None), (1, passage, None)], "item_id long, text string, answer string")
    rows = [(1, "So: " + passage.upper().replace(" ", " \n> ") + "!"), (2, None), (3, ""), (4, "题：“" + " ".join(zh) + "”"), (5, " ".join(passage.split()[:11])), (5, passage), (6, zh[:20]), (7, "x " * 100_000 + passage)]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, item_id int")
    got = L.leaked_items(docs, items)
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, 1), (4, 2), (5, 1), (7, 1)]
    r = [x for x in got.collect() if x[0] == 7][0]
    assert ("x " * 100_000 + passage)[r.start_pos : r.end_pos].split()[0] in passage.split()
    assert L.leaked_items(docs, items.limit(0)).count() == 0 and L.leaked_items(docs.limit(0), items).count() == 0
    # In blocks, each with an automaton of its own, the result is the same.
    blocks = L.leaked_items(docs, items, block_bytes=40)
    assert L.item_blocks(items, "item_id", ("text",), None, 40)[1] > 3
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got.collect()))


def test_short_items_and_answers(spark):
    """Items below the least passage leak if they stand whole; short answers count behind a passage of their item."""
    passage = "the anchor gateway rarely fragments sixty stacked leases behind the dormant bearer until each partly renumbers seven reports"
    items = spark.createDataFrame([(1, "purple timer drift", None), (2, passage, "no"), (3, "one two three four five six seven eight nine ten", None), (4, "", "yes")], "item_id long, text string, answer string")
    rows = [
        (1, "A Purple timer-drift? no: purple, TIMER drift."), (2, "purple timer"), (3, f"no. {passage}. Answer: No!"), (4, f"no {passage}"),
        (5, "zero one two three four WRONG six seven eight nine ten"), (6, "one two three WRONG five six WRONG eight nine ten"), (7, "yes"), (8, "purple red timer drift"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in L.leaked_items(docs, items, answer="answer").collect()}
    assert sorted(got) == [(1, 1), (3, 2), (4, 2), (5, 3)]
    r = got[3, 2]
    assert rows[2][1][r.answer_start : r.answer_end] == "No" and got[4, 2].answer_start is None
    assert (5, 1) not in got and rows[0][1][got[1, 1].start_pos : got[1, 1].end_pos] == "purple, TIMER drift"


@pytest.mark.parametrize("least", [5, 7, 9, 14])
def test_least_passage_is_a_parameter(least):
    rnd = random.Random(least)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(30)), None) for k in range(8)]
    leaks = L.Leaks(items, least_words=least)
    hits = 0
    for _ in range(60):
        k, n, a = rnd.randrange(8), rnd.randint(least - 2, least + 9), rnd.randint(0, 10)
        part = items[k][1].split()[a : a + n]
        for _ in range(rnd.randint(0, 2)):
            part[rnd.randrange(len(part))] = "wrong"
        doc = [rnd.choice(WORDS) for _ in range(12)] + part + [rnd.choice(WORDS) for _ in range(12)]
        codes = np.array([leaks.codes.get(w, -1) for w in doc])
        want = {i for i, t, _ in items if L.holds(np.array([leaks.codes[w] for w in t.split()]), codes, least)}
        assert {i for i, *_ in leaks.search(" ".join(doc))} == want
        hits += len(want)
    assert hits > 15


def test_answers_are_searched(spark, tmp_path):
    from sigtrace.llm.queries import p6_passages

    answer = "the session was released because the user plane function lost its association with the control plane twice"
    spark.createDataFrame([(1, f"It is known that {answer} today."), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, "Why?", answer), (6, "What?", None)], "item_id long, text string, answer string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert [(r.doc_id, r.item_id) for r in p6_passages(spark, str(tmp_path)).collect()] == [(1, 5)]
