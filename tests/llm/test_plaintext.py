import unicodedata as u

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmatch.llm.plaintext import from_flat, not_plain_fields, plain_array, plain_fields, plain_flat, to_flat


def plain(*texts):
    return plain_array(pa.array(texts, pa.string())).to_pylist()


def test_variants_become_ordinary():
    assert plain("Ｙｏｔｏ", "𝐓𝐡𝐨", "ⒶⓇ", "ﬁn Ⅱ", "Cʀɪᴍsᴏɴ Aғғᴀɪʀ", "🅰🅱", "ｶﾞﾎﾟ") == ["Yoto", "Tho", "AR", "fin II", "Crimson Affair", "AB", "ガポ"]


def test_marks_spaces_and_invisibles():
    assert plain("Pǎté", "ẹ́", "q́", "a b c　", "Fe​b­⁠͏", "x‍", "한") == ["Pǎté", "ẹ́", "q́", "a b c ", "Feb", "x", "한"]


def test_lookalikes_only_inside_latin_words():
    assert plain("Skeiуorzu Ноһarlin", "Рищугри Тутуфи", "Φιγελο", "Κouta", "Aж", "ｓо") == ["Skeiyorzu Hoharlin", "Рищугри Тутуфи", "Φιγελο", "Kouta", "Aж", "so"]


def test_every_foreign_letter_in_a_latin_word_is_folded():
    assert plain("Sakuгa", "Naruцo", "Reiя", "Ꭺsuka", "Ⲁsuka", "ꓮsuka") == ["Sakuga", "Naruto", "Reiy", "Asuka", "Asuka", "Asuka"]
    kept = ["Москва", "Tシャツ", "Aさん", "ʼn", "서울 city", "東京Tower"]
    assert plain(*kept) == kept


def test_every_character_reaches_its_form_at_once():
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for texts in (every, ["x" + c + "y" for c in every]):
        once = plain_array(pa.array(texts))
        assert once.equals(plain_array(once))


def test_line_breaks_stay_in_running_text():
    texts = ["a\nb", "a\n\u200bb\tｃ", "с\nd"]
    assert from_flat(plain_flat(to_flat(pa.array(texts)), lines=True)).to_pylist() == ["a\nb", "a\nb\tc", "с\nd"]


def test_plain_text_is_left_alone():
    kept = ["", "é ß ñ", "❄️ 👩‍🚀 🎃", "a  b ", "ロスザビ・スモス", "Straße™", "word " * 20000]
    assert plain(*kept) == kept
    assert plain(None) == [None]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text("aẹ́́​ ｘⒷоɪﬁ ̧ж‍❄", max_size=12)), max_size=8))
def test_batches_rows_and_repetition(texts):
    out = plain(*texts)
    assert out == [plain(t)[0] for t in texts]
    assert plain(*out) == out


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(categories=["Lu", "Ll", "Mn"], max_codepoint=0x17F), max_size=10), st.text("áéôçņ̣̃́̂ae", max_size=10))
def test_composition_is_the_canonical_one(a, b):
    for text in (a, b):
        if not any(0x250 <= ord(c) < 0x300 or c in "ŉſĿŀĲĳ̀́̓͏" or u.decomposition(c).startswith("<") for c in text):
            assert plain(text) == [u.normalize("NFC", text)]


def test_fields(spark, rows):
    df = spark.createDataFrame([("1", "Ｙo", "x"), ("1", "Ｙo", "x"), ("2", None, "a b"), ("3", "é", "")], "id string, name string, anime_name string")
    assert rows(not_plain_fields(df, "id", ["name", "anime_name"])) == [("1", "name"), ("2", "anime_name")]
    assert rows(not_plain_fields(df.limit(0), "id", ["name"])) == []
    assert rows(plain_fields(df.withColumn("name_plain", df.id), ["name"]), "id", "name_plain") == [("1", "Yo"), ("1", "Yo"), ("2", None), ("3", "é")]
