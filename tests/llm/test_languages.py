import itertools
import random

import numpy as np
import pytest

from quillrake.llm import languages as L

SENTENCES = {
    "en": ["The mayor opens the new bridge in", "The council will vote on the school budget near", "Nobody was hurt in the storm at"],
    "de": ["Der Bürgermeister eröffnet die neue Brücke in", "Der Rat stimmt über den Haushalt der Schule ab bei", "Niemand wurde im Sturm verletzt bei"],
    "fr": ["Le maire ouvre le nouveau pont à", "Le conseil vote le budget des écoles près de", "Personne n'a été blessé dans la tempête à"],
    "es": ["El alcalde abre el nuevo puente en", "El consejo vota el presupuesto de la escuela cerca de", "Nadie resultó herido en la tormenta de"],
    "pt": ["O prefeito abre a nova ponte em", "O conselho vota o orçamento da escola perto de", "Ninguém ficou ferido na tempestade em"],
    "nl": ["De burgemeester opent de nieuwe brug in", "De raad stemt over de begroting van de school bij", "Niemand raakte gewond door de storm in"],
    "ru": ["Мэр открывает новый мост в городе", "Совет голосует за бюджет школы возле города", "Никто не пострадал от бури в городе"],
    "hi": ["महापौर ने नए पुल का उद्घाटन किया", "परिषद ने स्कूल के बजट पर मतदान किया", "तूफ़ान में किसी को चोट नहीं आई"],
}


def sentence(rng, lang):
    place = "".join(rng.choice(["ka", "ne", "zo", "ri", "mu"]) for _ in range(3))
    return f"{rng.choice(SENTENCES[lang])} {place.title()}".strip()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(lang, sentence(rng, lang) + ". " + sentence(rng, lang)) for lang in L.LANGS for _ in range(40)]
    parts = [[[m[0] for m in L._WORD.finditer(t[a:b])] for a, b in L.stretches(t)] for _, t in rows]
    noisy = [np.full(len(p), L.LANGS.index(c if rng.random() > 0.15 else rng.choice(L.LANGS))) for (c, _), p in zip(rows, parts, strict=True)]
    for _ in range(3):
        noisy = L._vote(parts, noisy)
    right = np.mean([(y == L.LANGS.index(c)).mean() for (c, _), y in zip(rows, noisy, strict=True)])
    assert right > 0.98  # the vote mends wrong labels
    return L.train([([w for ws in p for w in ws], np.repeat(y, [len(ws) for ws in p])) for p, y in zip(parts, noisy, strict=True)])


def test_held_out_accuracy(model):
    rng = random.Random(2)
    good = n = 0
    for a in L.LANGS:
        for b in L.LANGS:
            for sep in (". ", " | ", "\n", ": ", " / "):
                got = [x[2] for x in L.read(model, [sentence(rng, a) + sep + sentence(rng, b)])[0] if x[2]]
                good += got == [a, b]
                n += 1
    assert good / n > 0.97


def test_languages_change_without_a_stop(model):
    rng = random.Random(7)
    good = n = 0
    for a in L.LANGS:
        for b in L.LANGS:
            if a != b:
                x, y = rng.choice(SENTENCES[a]), rng.choice(SENTENCES[b])
                for sep in (" ", ", "):
                    got = [r[2] for r in L.read(model, [x + sep + y])[0] if r[2]]
                    good += got == [a, b]
                    n += 1
    assert good / n > 0.9
    assert [[(r[0], r[1]) for r in rows] for rows in L.read(model, ["The mayor opens the new bridge, Мэр открывает новый мост"])] == [[(0, 31), (32, 56)]]


def test_turns_against_enumeration():
    rng = np.random.default_rng(3)
    turned = 0
    for _ in range(60):
        n = int(rng.integers(4, 10))
        p = rng.dirichlet([0.3, 0.3, 0.3], size=n)
        p = np.concatenate([np.where(np.arange(n)[:, None] < n // 2, p * [30, 1, 1], p * [1, 30, 1]), np.zeros((n, len(L.LANGS) - 3))], axis=1)
        p /= p.sum(axis=1, keepdims=True)
        heavy = np.flatnonzero(p.sum(axis=0) >= 2.0)
        logs = np.log(np.maximum(p, L.DOUBT))
        score = lambda way: sum(logs[k, x] for k, x in enumerate(way)) - L.TURN * sum(x != y for x, y in itertools.pairwise(way))
        best = max(map(score, itertools.product(heavy.tolist(), repeat=n)), default=None)
        got = L._turns(p)
        turned += bool(got)
        if best is None:
            assert got == []
            continue
        ends = [0, *got, n]
        found = max(score([x for (a, b), x in zip(itertools.pairwise(ends), way, strict=True) for _ in range(b - a)]) for way in itertools.product(heavy.tolist(), repeat=len(ends) - 1))
        assert abs(found - best) < 1e-9
    assert turned > 5


def test_features_of_the_whole_word():
    assert L.features("a" * 45 + "bcd" + "e" * 10) != L.features("a" * 45 + "xyz" + "e" * 10)
    assert set(L.features("a" * 45 + "bcd" + "e" * 10)) >= {L._hash("n", "bcd")}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    k = len(L.LANGS)
    f = L.Field(np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    es = [rng.normal(size=(t, k)) * 2 for t in (1, 2, 3)]
    for e, got in zip(es, f.posteriors(es), strict=True):
        score = f.start + e[0]
        for row in e[1:]:
            score = score[..., None] + f.trans + row
        p = np.exp(score - score.max())
        p /= p.sum()
        for j in range(len(e)):
            assert np.allclose(got[j], p.sum(axis=tuple(i for i in range(len(e)) if i != j)))


def test_training_takes_all_its_passes(monkeypatch):
    passes, whole = [], L.Field.posteriors
    monkeypatch.setattr(L.Field, "posteriors", lambda f, e, *more: passes.append(len(e)) or whole(f, e, *more))
    L.train([(["the", "mayor"], np.array([0, 0]))] * 10)
    assert sum(passes) == 6 * 10


def test_expected_transitions_against_enumeration():
    rng = np.random.default_rng(6)
    k = len(L.LANGS)
    f = L.Field(np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    es, want, got = [rng.normal(size=(t, k)) for t in (1, 2, 3, 3)], np.zeros((k, k)), np.zeros((k, k))
    for e in es[1:]:
        score = f.start + e[0]
        for row in e[1:]:
            score = score[..., None] + f.trans + row
        p = np.exp(score - score.max())
        p /= p.sum()
        for j in range(len(e) - 1):
            want += p.sum(axis=tuple(i for i in range(len(e)) if i not in (j, j + 1)))
    f.posteriors(es, got)
    assert np.allclose(got, want)


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    at, rows, want = rng.integers(0, 5, 40), rng.normal(size=(40, 8)), np.zeros((7, 8))
    np.add.at(want, at, rows)
    assert np.allclose(L._sums(at, rows, 7), want) and not L._sums(at[:0], rows[:0], 7).any()


def test_labels():
    assert [L.code_of(x) for x in ("EN", " en-GB ", "pt_PT", "Hindi", "ger", "xx", "", None, "und")] == ["en", "en", "pt", "hi", "de", None, None, None, None]


def test_disguised_text(model):
    assert [x[2] for x in L.read(model, ["Τhe mаyоr оpens the nеw bridge in Ｋａｎｅ"])[0]] == ["en"]


def test_segments_of_odd_values(spark, model):
    rows = [(1, "x", "3:2"), (2, "x", ""), (3, "x", None), (4, "x", "The mayor opens the new bridge. " * 2000), (5, "x", "Der Rat stimmt ab. 9:1. The council will vote")]
    df = spark.createDataFrame(rows, "row_id long, lang string, text string")
    got = [(r.row_id, r.lang, r.part) for r in L.segments(df, ["row_id"], "text", model).orderBy("row_id", "part").collect()]
    assert got == [(4, "en", 0), (5, "de", 0), (5, "en", 1)]
    assert L.segments(df.limit(0), ["row_id"], "text", model).count() == 0
    assert all(0 < r.confidence <= 1.0001 for r in L.segments(df, ["row_id"], "text", model).collect())
