from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import encoding_repair as E

ROWS = "id string, text string, title string, token string, n long, value string"
CLEAN = "Både kommunens handläggare och jag tycker att värmemätaren borde göras om från början för Åsa"


def table(spark, extra):
    rows = [(f"c{k}", CLEAN, "Köksplaner", None, None, None) for k in range(8)]
    return spark.createDataFrame([*rows, *[(i, t, h, "x", 1, "y") for i, t, h in extra]], ROWS)


def test_found_and_restored(spark):
    bad = CLEAN.encode().decode("latin-1")
    twice = CLEAN.encode().decode("cp1252", "replace")
    extra = [
        ("a", bad, None), ("a", bad, None), ("b", CLEAN.encode("cp850").decode("latin-1"), "K÷ksplaner"), ("c", CLEAN.encode("utf-7").decode(), ""), ("d", CLEAN.translate(E._SEVEN[0]), None),
        ("e", CLEAN.encode("latin-1").decode("utf-8", "replace"), None), ("f", twice, None), ("g", "RESOLUÇÃO NÃO ENCONTRADA ½ × 4 µm © ® ™ …", "naïve café"), ("h", "%C3%A5r \\u00e5r &auml; func({x}, [y]) a|b", None), (None, bad, bad), ("i", None, None), ("j", "", ""),
    ]
    t = table(spark, extra)
    found = {tuple(r) for r in E.find_garbled(t).collect()}
    assert found == {("a", "text"), ("b", "text"), ("b", "title"), ("c", "text"), ("d", "text"), ("e", "text"), ("f", "text")}
    restored = {(r["id"], r["col_name"]): r["restored"] for r in E.restore(t).collect()}
    for i in "abcd":
        assert restored[i, "text"] == CLEAN, i
    assert restored["b", "title"] == "Köksplaner"
    assert E.find_garbled(t.where("false")).count() == 0


@settings(max_examples=60)
@given(st.text(alphabet="abcåäöéüßøæñdefg", min_size=2, max_size=12))
def test_every_form_differs_from_its_word(word):
    assert all(form != word for form, _ in E.garbled_forms(word))
    if not word.isascii():
        assert E.reversed_utf8(word.encode().decode("latin-1")) == word


def test_every_second_reading_is_a_form():
    for word in ("värme", "ключи"):
        forms = {form for form, _ in E.garbled_forms(word)} | E.rare_forms(word)
        for inner in E.SINGLE:
            for outer in E.SINGLE:
                assert E._read(E._read(word.encode(), outer).encode(), inner) in forms
                for source in E.SINGLE:
                    raw = E._bytes(word, source)
                    if raw is not None and (form := E._read(raw, outer)) != word:
                        assert E._read(form.encode(), inner) in forms


def test_twice_read_russian_is_restored(spark):
    word = "ключи"
    extra = [(name, E._read(E._read(word.encode(), name).encode(), name), None) for name in ("cp1251", "koi8_r", "cp866")]
    t = table(spark, [*extra, ("clean", word, None)])
    assert {tuple(r) for r in E.find_garbled(t).collect()} == {(name, "text") for name, *_ in extra}
    assert {r["id"]: r["restored"] for r in E.restore(t).collect() if r["id"] in ("cp1251", "koi8_r", "cp866")} == {name: word for name, *_ in extra}


def test_only_whole_tokens_are_replaced(spark):
    clean = ["ett äpple ligger på bordet åt alla"] * 6
    bad = "{pple ligger p} bordet, se {help} och p}"
    t = table(spark, [*[(f"k{k}", c, None) for k, c in enumerate(clean)], ("bad", bad, None)])
    restored = {r["id"]: r["restored"] for r in E.restore(t).collect()}
    assert restored.get("bad", bad) in ("äpple ligger på bordet, se {help} och på", bad) and "{help" in restored.get("bad", bad)
