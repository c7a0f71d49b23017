import pytest

from loresift.llm.sentences import sentences, spans

CASES = [
    ["Dr. Vale left at 5 p.m. because of No. 7, i.e. the dam.", "It weighs 3.5 kg!", '"Is it safe?" asked Mo, pointing up.', "He nodded at 9 p.m.", '"We trade nothing," Bo said, "and Al knows it."', "Patch 3.1.52 came."],
    ["„Ist der Turm sicher?“, fragte Jo am Tor.", "Am 8. Juli fand Vo rund 29 Kisten, z. B. aus Blei.", "Dr. Ru hat Nr. 5 gesehen."],
    ["« Le puits est vide », répète Jo.", "M. Garde vit ici !", "Pourquoi donc ?"],
    ["¿Quién vive?", "La Sra. Luz pesa 2,8 kg, p. ej. menos.", "«Está», dijo Vo."],
    ["В 49 г. Архив рядом закрыт, т. е. пуст.", "«Этот Пост давно пуст», — сказал Ян у ворот.", "Почему Маяк?"],
    ["क्या वह यहाँ है?", "टावर का वजन 3.4 किलो है।", "वह गया।"],
    ["يزن النفق نحو 3.4 كغ، وهو أخف.", "لماذا بقي المنجم؟", "قال إن المولد خطر!"],
]
UNSPACED = [
    ["「灯台は占領されたのか？」とJoはVenで尋ねた。", "前哨は2.8キロで軽い。", "なぜ？"],
    ["据Vo测量，塔重5.4公斤。", "Jo在Ven说：「哨站已经修复。」", "为什么不来？"],
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_spaced(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in spans(text)] == case
    doubled = text + " \n\n" + text
    assert [doubled[a:b] for a, b in spans(doubled)] == case * 2


@pytest.mark.parametrize("case", UNSPACED, ids=range(len(UNSPACED)))
def test_unspaced(case):
    text = "".join(case)
    assert [text[a:b] for a, b in spans(text)] == case


def test_lines_bullets_and_thai():
    text = "A title\n\n– first item\n1. Second item\nMo: Why not?\nบังเกอร์เก่า ทำไมในปี743 หอคอยใหญ่"
    assert [text[a:b] for a, b in spans(text)] == ["A title", "– first item", "1. Second item", "Mo: Why not?", "บังเกอร์เก่า", "ทำไมในปี743", "หอคอยใหญ่"]


def test_spans_tile_the_text():
    text = "One. Two? \"Three.\" (four.) ... Five! a.m. Six " * 200
    got = spans(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert "".join(text[a:b] for a, b in got).replace(" ", "") == text.replace(" ", "")


def test_frame(spark):
    rows = [(1, "One. Two.", "c"), (2, None, "c"), (3, "", "c"), (4, "  \n ", "c"), (5, "x" * 100_000, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, end_pos string")
    got = sorted((r.doc_id, r.sentence_no, r.end_pos) for r in sentences(frame).collect())
    assert got == [(1, 0, 4), (1, 1, 9), (5, 0, 100_000)]
    assert sentences(frame.limit(0)).count() == 0


def test_long_reach():
    """One sentence with more initials than any fixed reach."""
    line = "The list names " + "J. K. L. " * 20 + "Dunhar and nobody else. Then the next one begins."
    first = line.index(" Then")
    assert spans(line) == [(0, first), (first + 1, len(line))]


QUOTED = [
    ['He said "We go now. They ran. All hid." and left.', "Then rain fell."],
    ['"We go now. They ran. All hid," said Mo.', '"It is late."', "Rain fell."],
    ["Er rief: „Wir gehen jetzt. Sie liefen. Alle flohen.“ und ging.", "Dann kam Regen."],
    ["Il cria « Nous partons. Ils courent ! Tous fuient. » avant de partir.", "Puis vint la pluie."],
    ["Он сказал: «Мы идём. Они бежали. Все скрылись.», и ушёл.", "Потом пошёл дождь."],
    ["Dijo «Nos vamos. Corrieron. Todos huyeron.» y se fue.", "Luego llovió."],
    ["The gate (See the map. It is old. Nobody knows.) is shut.", "Go on."],
    ['"We go now.', "They ran.", 'All hid."', "Then rain fell."],
    ['The open mark " means nothing.', "Then rain fell.", "All hid."],
]


@pytest.mark.parametrize("case", QUOTED, ids=range(len(QUOTED)))
def test_quotations(case):
    """Quotations of several sentences inside a sentence, quotations of their own, a lone mark."""
    text = " ".join(case)
    assert [text[a:b] for a, b in spans(text)] == case


def test_unspaced_quotations():
    for case in (["彼は「行こう。走れ。隠れろ。」と言った。", "雨が降った。"], ["他说：「走吧。快跑。藏好」，然后离开了。", "下雨了。"]):
        text = "".join(case)
        assert [text[a:b] for a, b in spans(text)] == case
