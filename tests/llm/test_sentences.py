import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtrace.llm.sentences import sentence_units, units

CASES = [
    ["Mr. Sample and Mrs. Probe confirmed it at 4:36 a.m. on 10 Sept..", "Is this expected?", "No!", "gnb08 must not."],
    ['The reply was short: "No. Use v10.1.8."', "We did so.", 'The log says "Session lost. Trying again." and nothing more.'],
    ["Only 539 nodes stayed on v10.1.4.", "301 had moved on.", "It took 391 min. to find it.", "It moved within 19 min.", "second line left.", "They called Sample Ltd.", "Its desk answered after 25 h.", "amf-3 was slow."],
    ["Die 2. Anfrage dauerte 64,7 s, die 3. nur 62,79 s.", "Am 3. Mai fiel amf-3 z. B. aus, d. h. es stieg von 797 auf 30.", "Die Gegenstelle.", "„Ist der Pfad da?“, fragte er.", "Im Protokoll steht „Sitzung verloren. Neuer Versuch.“ und sonst nichts."],
    ["Pourquoi le garde-t-il ?", "« Le lien est-il actif ? » a demandé l'équipe.", "M. Exemple a lu la p. 174 selon l'art. 6.2.5.", "On ne sait pas...", "Nous, p. ex. sur x, etc. et fermé.", "On a vu etc.", "Tout va."],
    ["¿Por qué?", "«¿Está activo?», preguntó.", "El Sr. Ejemplo vio 967 (máx. 770), p. ej. en x."],
    ["Wait, why is x set to 0x1?!", "Hmm... smf32 again.", "He tried 5 times... then moved.", "(The trace starts too late to tell.)", "second line left.", "See https://w.example/a.log?v=8 for x."],
    ["لماذا يحتفظ؟", "يقول السجل «انقطعت الجلسة. محاولة جديدة.» ولا شيء.", 'लॉग में "सत्र टूट गया। फिर प्रयास।" लिखा था।', "कुछ नहीं।"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences(want):
    for blank in (" ", "  ", "\n", "\r\n"):
        text = blank.join(want)
        assert [text[a:b] for a, b in units(text)] == want


def test_without_blanks():
    want = ["他问：“链路正常吗？”，却没有人回答。", "“先别重启！”值班员说。", "问题出在哪里……", "夜班人员重启了。", "（抓包开始得太晚，无法判断。）", "まず再試行した。", "「経路は生きているか？」と尋ねた。", "分からない…。"]
    text = "".join(want)
    assert [text[a:b] for a, b in units(text)] == want
    text = "It ended.The next began with v1.2.3 and http.status.Laut Plan."
    assert [text[a:b] for a, b in units(text)] == ["It ended.", "The next began with v1.2.3 and http.status.", "Laut Plan."]


def test_thai():
    text = "ฟิลด์ http.status ว่างเปล่า  หลังอัปเกรดเป็น v2.10.3 แล้วหายไป โหนด ausf19 ไม่ตอบสนอง"
    assert [text[a:b] for a, b in units(text)] == ["ฟิลด์ http.status ว่างเปล่า", "หลังอัปเกรดเป็น v2.10.3 แล้วหายไป", "โหนด ausf19 ไม่ตอบสนอง"]


def test_layout():
    want = ["# Open points", "Q: Is it?", "A", "- one", "* two.", "three", "2. four", "b) five", "15:16:02 smf32 path=/nsmf. stream=3", "15:16:02 x", "Last line", "Summary"]
    text = "\n\n  # Open points\r\n\r\nQ: Is it? A\n \n- one\n* two. three\n2. four\nb) five\n\n15:16:02 smf32 path=/nsmf. stream=3\n15:16:02 x\n\nLast line\n\nSummary\n"
    assert [text[a:b] for a, b in units(text)] == want
    wrapped = "It was seen on 23\nDec. and again at\n15:17:38 the UPF dropped No.\n3. That is all"
    assert [wrapped[a:b] for a, b in units(wrapped)] == [wrapped[: wrapped.index("3. ") + 2], "That is all"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA1 .!?…\n\r-\"“”„«»()（）。：，「」สก中5é ", max_size=60))
def test_covers_everything_once(text):
    covered = [0] * len(text)
    last = 0
    for a, b in units(text):
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b
        for i in range(a, b):
            covered[i] += 1
    assert all(c == 1 or ch.isspace() for c, ch in zip(covered, text))


def test_table(spark):
    rows = [(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, "Long text. " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = sentence_units(df, with_text=True)
    assert {(r[0], r["count"]) for r in got.groupBy("doc_id").count().collect()} == {(1, 4), (5, 50_000)}
    assert sorted(r.unit for r in got.filter("doc_id = 1").collect()) == ["One.", "One.", "Two.", "Two."]
    assert sentence_units(df.limit(0)).count() == 0


def test_list_levels():
    """Lists after a heading or an intro line without a blank line, nested ones, and lines that go on."""
    text = "Steps to take:\n1. Stop it. Wait.\n   a) first\n   b) second one\n      goes on here\n2. Start it\n- other\n\n# Next\n- one\n  - inner\n- two\nsee more\n\nIt ended on\n- 5 dB. Then it rose."
    want = ["Steps to take:", "1. Stop it.", "Wait.", "a) first", "b) second one\n      goes on here", "2. Start it", "- other", "# Next", "- one", "- inner", "- two\nsee more", "It ended on\n- 5 dB.", "Then it rose."]
    assert [text[a:b] for a, b in units(text)] == want


def test_unclosed_marks_and_long_words_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("(«" * 200_000 + "a. B", "a.b/" * 200_000 + "x. Then", "x" * 400_000 + ". Then", '("' * 100_000 + "end." + ")" * 50_000):
        assert units(text)
    assert time.perf_counter() - began < 30
    long = "https://h.example/" + "a" * 200 + ".b"
    assert [(f"See {long}. Next"[a:b]) for a, b in units(f"See {long}. Next")] == [f"See {long}.", "Next"]
