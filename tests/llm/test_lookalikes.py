import random
import unicodedata
from collections import Counter

from quillrake.llm import lookalikes as L

TEXT = "The mayor praised volunteers for their work near Kanezard. Профессор открывает новую линию трамвая в центре города. Café über señor"


def reader():
    return L.Reader(L.pair_counts(Counter(L.plain(TEXT).split(" ") * 5)))


def test_same_look_same_form():
    r = reader()
    same = ["Nоvelist Sеfes", "Novelist Sefes", "Ｎｏｖｅｌｉｓｔ　Ｓｅｆｅｓ", "No​velist Sefes", "Νovelist Se­fes", "﻿Novelist Sefes "]
    assert {r.text(x) for x in same} == {"Novelist Sefes"}
    assert r.text("Café …") == r.text("Café ...") == "Café ..."
    assert r.text("ﬁrst non‑stop") == "first non-stop"
    assert r.text("в центре города") == "в центре города"
    assert r.text("в цeнтpe гoрoда") == "в центре города"


def test_other_look_other_form():
    r = reader()
    for a, b in (("Cafe", "Café"), ("Mayor", "mayor"), ("x2", "x²"), ("a-b", "a—b"), ("it's", "it’s"), ("O0", "OO"), ("Il", "II"), ("a, b", "a b")):
        assert r.text(a) != r.text(b)


def test_letters_that_unicode_calls_confusable():
    r = reader()
    for a, b in (("νolume", "volume"), ("Үork", "York"), ("ӏamp", "lamp"), ("ɡame", "game"), ("Ϳune", "June"), ("Ϲat", "Cat"), ("ϲup", "cup"), ("Ӏnn", "Inn"), ("ѕеа", "sea")):
        assert r.text(a) == r.text(b) == b
    for a, b in (("ſea", "sea"), ("№ 5", "No 5"), ("ϑ", "θ"), ("αll", "all"), ("Σat", "Cat"), ("il", "ll")):
        assert r.text(a) != r.text(b)


def test_form_depends_on_the_look_only():
    rng, r = random.Random(3), reader()
    for _ in range(300):
        word = "".join(rng.choice([c for g in L.LOOKALIKES for c in g] + list("bdfgknйыж")) for _ in range(rng.randint(1, 9)))
        twin = "".join(rng.choice(L._CLASS.get(c, c)) for c in word)
        assert r.text(word) == r.text(twin) == r.text(r.text(word))
        assert unicodedata.is_normalized("NFC", r.text(word))


def test_long_words_are_searched():
    word = "городacxo" * 30
    assert reader().text(word) == "городасхо" * 30


def test_a_change_of_script_at_a_words_edge_is_searched():
    texts = Counter(["оооооо"] * 500 + ["bed"] * 5)
    r = L.Reader(L.pair_counts(texts))
    best, search = L.Reader(L.pair_counts(texts)), {}
    for w in ("оооооооооb", "boooooooooo"):
        forms = [w.translate({ord("о"): "o"}), w.replace("o", "о")]
        search[w] = max(forms, key=lambda f: score(best, f, "CYRILLIC"))
        assert r._read(w, "CYRILLIC") == search[w]
    assert any("о" in f for f in search.values())  # Cyrillic beside the Latin letter


def score(r, word, lean):
    begin = {s: r.prior[s] + (L.LEAN if s == lean else 0.0) for s in L.SCRIPTS}
    s = L.script_of(word[0])
    out = begin[s] + r.pair(s, L._START, word[0])
    for a, b in zip(word, word[1:], strict=False):
        s, t = L.script_of(a), L.script_of(b)
        out += r.pair(t, a, b) if s == t else begin[t] - L.SWITCH + r.pair(t, L._START, b)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, field string, value string, form string")


def test_pairs_against_brute_force(spark):
    base = ["Mayor Kepans", "Mаyor Kepans", "Mayor Kepans", "Mayor Kepan", "mayor Kepans", "", " ", "​", None]
    rng = random.Random(5)
    rows = [(i, rng.choice(["title", "description"]), rng.choice(base), "clash") for i in range(120)]
    got = {tuple(r) for r in L.pairs(frame(spark, rows), slice_rows=10).collect()}
    r = reader()
    want = {(f, i, j) for i, f, a, _ in rows for j, g, b, _ in rows if i < j and f == g and a and b and a.strip() and b.strip() and a != b and r.text(a) == r.text(b) != ""}
    assert got == want and len(want) > 100


def test_a_class_of_many_copies_is_joined_in_proportion_to_its_pairs(spark):
    rows = spark.range(20_000).selectExpr("id AS row_id", "'t' AS field", "CASE WHEN id = 7 THEN 'Mаyor' ELSE 'Mayor' END AS value")
    got = L.pairs(rows, slice_rows=500)
    assert got.count() == 19_999 and got.filter("row_id_1 = 7 OR row_id_2 = 7").count() == 19_999


def test_long_empty_and_null(spark):
    out = {r.row_id: r.form for r in L.canonical(frame(spark, [(1, "t", "а" * 50_000 + " b", None), (2, "t", None, None), (3, "t", "​ ", None)])).collect()}
    assert len(out[1]) == 50_002 and out[2] is None and out[3] == ""
    assert L.pairs(frame(spark, [])).count() == 0
