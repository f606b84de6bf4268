import os

import time

import pytest

from sedgemill.llm import sentences as S

D = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.exists(D):
        pytest.skip("no test tables")
    return S.train(spark.read.parquet(D))


def split(model, text):
    return [text[a:b] for a, b in S.units(text, model)]


CASES = [
    ["Dr. Kelmquist (Dept. of Jarfer) signed it on Jan. 7.", "The job starts at 7 a.m.", "It needs v2.5.", "Wait... the file came back."],
    ["“We should go,” he said.", '"The roster is open. Leave it," wrote Vin in the log.', "(See the notes.)", 'The reply was "parcel?" and then "never mind."', "Is it done?"],
    ["Der Bericht umfasst Listen, Notizen usw.", "Am Mo. den 3. Mai wird es geschlossen.", "Das gilt u. a. für alle 519.783 Zeilen, vgl. Abb. 5.", "Nein, es war leer."],
    ["« Le lot est perdu. On recommence », écrit Vel.", "Est-ce que le jeton est gelé ?", "M. Ebmarin relit le lot."],
    ["¿Por qué está abierto el lote?", "«El lote está roto. Vuelve a cargarlo», dijo la Dra. Callmarin.", "¡No borres el diario!"],
    ["सूची अब तक क्यों बंद है?", "डॉ. Tamlo ने कल अभिलेख देखे।", "यह ठीक है।"],
    ["كتب د. Halban ملاحظة قصيرة في السجل.", 'سأل أ. Dunn: "أين السجل؟" ثم أغلق الجلسة.', "هل تم التحديث؟"],
]


@pytest.mark.parametrize("want", CASES)
def test_units(model, want):
    assert split(model, " ".join(want)) == want
    assert split(model, "\r\n\r\n".join(want)) == want


def test_scripts_without_blanks(model):
    assert split(model, "真的吗？！请先关闭队列。他问：“清单在哪里？”然后继续整理。有7.6%的行损坏……先不要删除。") == ["真的吗？！", "请先关闭队列。", "他问：“清单在哪里？”然后继续整理。", "有7.6%的行损坏……先不要删除。"]
    assert split(model, "「まだ触らないで。確認します。」とVinさんが書きました。 Vのキャッシュは3月に作り直しました（2件を確認。問題なし）。すごい！") == ["「まだ触らないで。確認します。」とVinさんが書きました。", "Vのキャッシュは3月に作り直しました（2件を確認。問題なし）。", "すごい！"]
    assert split(model, "รุ่น 5.3 ใช้คิวแบบเดิม ใครเป็นคนเปิดแฟ้มนี้ ผู้ใช้เปิดเอกสารได้ แต่แก้ไขไม่ได้") == ["รุ่น 5.3 ใช้คิวแบบเดิม", "ใครเป็นคนเปิดแฟ้มนี้", "ผู้ใช้เปิดเอกสารได้ แต่แก้ไขไม่ได้"]


def test_structure(model):
    text = "# Title v4.8\n\nUSER: one line\nthat goes on\nASSISTANT: two\n- item a\n1. item b\n> quoted\n```\nx = 1. # ok?\n\ny\n```\nafter it"
    assert split(model, text) == ["# Title v4.8", "USER: one line\nthat goes on", "ASSISTANT: two", "- item a", "1. item b", "> quoted", "```\nx = 1. # ok?\n\ny\n```", "after it"]
    assert split(model, "~~~\nopen block. Not closed") == ["~~~\nopen block. Not closed"]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "\r\n\r\n"])
def test_nothing(model, text):
    assert S.units(text, model) == []


@pytest.mark.parametrize("gap", [" " * 60, "\n" + " " * 60, "\t" * 41])
def test_wide_gaps(model, gap):
    assert split(model, f"The job is done.{gap}The next one waits.") == ["The job is done.", "The next one waits."]
    assert len(split(model, f"It is 5 cm.{gap}and more of it.")) == len(split(model, "It is 5 cm. and more of it."))


def test_whole_next_token():
    ahead = lambda s: S.Ahead(s).at(0)
    assert ahead(" " * 39 + "(Separately so") == ("(", "Separately") and ahead("  ") == ("", "")
    for token in ("x" * 200, "1" * 90 + "ab" + "c" * 70, "清单" * 60 + "到1234567", "清" * 80 + "9" * 70, "Ab-" * 40):
        assert S.plain(ahead(token)[1])[:12] == S.plain(token)[:12] and S.shape(ahead(token)[1]) == S.shape(token)


def test_units_hold_all_text(spark, model):
    for r in spark.read.parquet(D).select("text").filter("text is not null").limit(300).collect():
        text, end = r["text"], 0
        for a, b in S.units(text, model):
            assert not text[end:a].strip() and a >= end and not text[a].isspace() and not text[b - 1].isspace()
            end = b
        assert not text[end:].strip()


def test_held_out_boundaries(spark):
    """Reliable boundaries of documents that the classifier has not seen."""
    docs = spark.read.parquet(D)
    model = S.train(docs.filter("doc_id % 3 <> 0"))
    right = n = 0
    for r in docs.filter("doc_id % 3 = 0 and text is not null").select("text").collect():
        for _, _, found in S.scan(r["text"]):
            for c in found:
                sure = False if model.is_silent(c.kind) and not c.last else c.sure
                if sure is not None:
                    n += 1
                    right += model.accepts(c) == sure
    assert n > 2000 and right / n > 0.98


def test_table(spark, model):
    docs = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (None, "x", 0)], "doc_id long, text string, end_char int")
    assert S.sentence_units(docs, model).count() == 2
    assert S.sentence_units(docs.limit(0)).count() == 0


def test_silent_types_do_not_depend_on_the_size(spark):
    rows = [("vgl", 25, 0), ("end", 3_000_000, 3_000_000), ("rare", 24, 0), ("", 50, 0)]
    found = spark.createDataFrame([(k, n, e, None) for k, n, e in rows], "kind string, n long, ends long, names array<int>")
    silent = S.silent_types(found)
    assert [r["kind"] for r in silent.collect()] == ["vgl"]
    model = S.Model([], S.silent_filter(silent))
    assert model.is_silent("vgl") and not model.is_silent("end") and not model.is_silent("") and not S.Model([]).is_silent("vgl")
    words = spark.createDataFrame([("abb",), ("с",), ("ص",), ("ing 9",)], "kind string")
    assert all(S.Model([], S.silent_filter(words)).is_silent(r["kind"]) for r in words.collect())


@pytest.mark.parametrize("text", ["(" * 100_000, "(]" * 50_000, "(“„«" * 30_000, '" ' * 50_000, "(a. " * 30_000 + ")" * 30_000, "“a.” " * 20_000, "ก ข " * 30_000, "((ก ข. " * 20_000])
def test_marks_take_linear_time(model, text):
    began = time.time()
    S.units(text, model)
    assert time.time() - began < 10


def test_thai_blanks_are_classified(model):
    gaps = [c for _, _, found in S.scan("ใครเป็นคนเปิดแฟ้มนี้ ผู้ใช้เปิดเอกสารได้ แต่แก้ไขไม่ได้") for c in found]
    assert [(c.sure, model.accepts(c)) for c in gaps] == [(True, True), (False, False)]
