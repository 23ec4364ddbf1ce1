import pytest

from quillstack.llm import sentences as sen

CASES = {
    "points": ["Prof. Dr. Meyer leitet den Kurs seit dem 3. Mai 2011.", "Am 3. und 84. Tag tagt die Stelle.", "Kontakt: Zi. 7, Tel. 054.", "Gemäß § 5 Abs. 2 gilt z. B. der Plan usw. auch hier."],
    "degrees": ["Der Abschluss M.Sc. setzt den Plan voraus, vgl. im Fach Ethik.", "The U.S. partner, i.e. the office, will post it at 9 a.m. on May 4, 2016.", "It is done."],
    "numbers": ["Die Note 18,6 wird auf 11.44 gerundet.", "2011 wurde das Modul verlängert.", "§ 9 findet keine Anwendung.", "Die Frist endet um 12.30 Uhr."],
    "quotes": ["Im Bescheid steht: „Der Plan wurde geprüft. Der Kurs entfällt!“, und damit endet das Modul.", "„Das Modul ist anerkannt.“", "Herr Meyer jun. prüft es.", "(Ausgenommen ist der Kurs.)", "Wirklich?!", "Ja."],
    "english": ["“When is it due? Who can read it?” are common questions.", "“It was revised,” said Ms. Miller from the board.", "Do not go twice!", "iCal files are sent on request.", "See Fig. 3 and Sec. 4.5 for more."],
    "omission": ["Das Modul … wird geprüft.", "Compare it vs. the other one…", "Do it now."],
    "french": ["« Le contrat est validé. Le relevé suivra », indique le bureau.", "Attention au module !", "M. Durand présente le contrat, p. ex. en séance.", "Selon l'art. 23, al. 2, le barème suffit."],
    "spanish": ["¿Cuándo vence el módulo?", "El plan se entrega antes de la semana 133.", "La Dra. Ruiz revisa el informe, p. ej. en el aula 4.", "«El módulo fue aprobado. Falta el trabajo», dice la oficina."],
    "polish": ["Zgodnie z art. 10 ust. 3 plan zastępuje moduł.", "„Esej jest gotowy. Brakuje tylko planu”, pisze dziekanat.", "Plan obowiązuje od 2018 r. i obejmuje 81 punktów.", "Projekt należy złożyć do 9. tygodnia."],
    "turkish": ["“Tez onaylandı. Şimdi plan gerekiyor.” dedi danışman.", "Her tez 59. haftaya kadar teslim edilir.", "Md. 5 uyarınca plan yerine geçer."],
    "vietnamese": ["“Hồ sơ đã có. Còn thiếu đơn.” là câu trả lời.", "Sinh viên nộp bài trước tuần thứ 66.", "TS. Nam chấm bài với điểm 1,5."],
    "russian": ["В 2027 г. отчёт стал общим.", "Без отметки и т. д. график не считается общим.", "«Экзамен готов. Осталось проверить план», — сообщает деканат."],
    "greek": ["Ο κ. Νίκος βαθμολογεί το έντυπο με 3,47.", "Πότε ολοκληρώνεται το μάθημα;", "Σύμφωνα με το άρθ. 5 παρ. 2, π.χ. εδώ, ισχύει."],
    "arabic": ["قال د. Meyer: «تم اعتماد الكشف. بقي الامتحان»، ثم غادر.", "متى يصبح الجدول كتابيا؟", "بلغ المتوسط نحو 10.53 درجة."],
    "hindi": ["“आवेदन स्वीकृत है। अब अनुबंध चाहिए।” कार्यालय ने लिखा।", "डॉ. Meyer ने जाँच की।", "सत्र न भूलें!"],
    "korean": ["\"계약이 승인되었다. 시험도 곧 온다.\"라고 사무실이 알렸다.", "평균은 37.60점이었다.", "학생은 66주차까지 제출해야 한다."],
}
UNSPACED = {
    "chinese": ["“合同已经批准！证书随后寄出。”办公室这样通知大家。", "没有证书的人不能参加考试……", "答辩的要求是11.61个学分。", "请不要忘记申请表！"],
    "japanese": ["報告書はいつ公開されますか？", "「報告書は承認された。成績表も届いた。」と事務局は述べた。", "学生は第81週までに提出します。"],
}


def texts(text):
    return [" ".join(text[a:b].split()) for a, b in sen.units(text)]


@pytest.mark.parametrize("name", CASES)
def test_spaced_scripts(name):
    assert texts(" ".join(CASES[name])) == CASES[name]
    broken = "\n".join(" ".join(CASES[name]).split(" "))
    assert texts(broken) == CASES[name]


@pytest.mark.parametrize("name", UNSPACED)
def test_scripts_without_blanks(name):
    assert texts("".join(UNSPACED[name])) == UNSPACED[name]


def test_thai():
    parts = ["คณะกรรมการตรวจข้อสอบทุกปี", "โครงงานมีค่าเฉลี่ย0.34คะแนน", "เมื่อใดจึงจะประกาศรายงาน?", "นักศึกษาต้องส่งสัญญาก่อนสัปดาห์ที่17"]
    assert texts(" ".join(parts)) == parts
    assert texts("13 รายงาน\n\n" + " ".join(parts)) == ["13 รายงาน", *parts]


@pytest.mark.parametrize("heading", ["# 46 Akte im Fach Ethik", "48. Oral defence and catalogue", "§ 9 Übung und Frist", "3.2 Zeugnis", "Kapitel 51: Plan", "13 πτυχίο", "Anlage 45 – Prüfung"])
def test_headings(heading):
    assert texts(heading + "\n\nDas ist ein Satz. Und noch einer.") == [heading, "Das ist ein Satz.", "Und noch einer."]


def test_lattice_prefers_known_words():
    assert [w for w, k in sen.word_lattice("หากไม่มีสัญญา") if k] == ["หาก", "ไม่มี", "สัญญา"]
    assert sen.word_lattice("") == []


def test_blank_lines_and_places():
    text = " \n\n  Eins ohne Ende\n \nZwei. Drei　\n\n\n"
    got = sen.units(text)
    assert [text[a:b] for a, b in got] == ["Eins ohne Ende", "Zwei.", "Drei"] and got[0][0] == 5
    assert sen.units(None) == sen.units("") == sen.units(" \n\n ") == []


def test_units_cover_all_visible_characters():
    text = " ".join(s for c in CASES.values() for s in c) + "\n\n" + "".join(UNSPACED["chinese"])
    at = 0
    for a, b in sen.units(text):
        assert not text[at:a].strip() and a < b
        at = b
    assert not text[at:].strip()


def test_very_long_text():
    assert len(sen.units("Das ist ein Satz. " * 20_000)) == 20_000
    assert len(sen.units("x" * 500_000)) == 1


def test_table(spark):
    df = spark.createDataFrame([(1, "Eins. Zwei.", 5), (1, "Eins. Zwei.", 6), (2, None, 1), (3, " ", 1), (None, "Vier.", 1)], "page_id bigint, content string, start_pos int")
    got = sorted(tuple(r) for r in sen.sentence_units(df, "page_id", "content").collect())
    assert got == [(1, 0, 0, 5, "Eins."), (1, 1, 6, 11, "Zwei.")]
    assert sen.sentence_units(df.where("false"), "page_id", "content", with_text=False).columns == ["page_id", "unit_no", "start_pos", "end_pos"]
    assert sen.sentence_units(df.where("false"), "page_id", "content").count() == 0


def test_units_that_pass_many_possible_ends():
    references = "Literatur: " + ", ".join(f"vgl. Abs. {i} Nr. {i} S. {i} f. d. BGB" for i in range(60)) + " gelten."
    assert texts(references + " Danach kommt ein Satz.") == [references, "Danach kommt ein Satz."]
    quoted = "เขากล่าวว่า “" + " ".join(["นักศึกษาต้องลงทะเบียนเรียน"] * 150) + "” และจบ"
    assert texts(quoted) == [quoted]
