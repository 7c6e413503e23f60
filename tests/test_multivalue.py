import math
import random
from itertools import combinations, product

from quillrake.operators import multivalue as V


def stretches(text):
    at = V.lattice(text)
    return [at.value(i, i) for i in range(len(at.begins))]


def test_quoted_spans_are_one_stretch():
    assert stretches('a,"b, c";d') == ["a", "b, c", "d"]
    assert stretches('"x; y"\n z\t"q, ""the Fox"""') == ["x; y", "z", 'q, "the Fox"']
    assert stretches('5" disk, 3" disk') == ['5" disk', '3" disk']
    assert stretches(' ,, ;"open, end') == ["", '"open', "end"]
    assert stretches("") == [""] and stretches(" , ") == ["", ""]


def test_unquoted():
    assert [V.unquoted(x) for x in ('"a"', ' "q, ""the Fox""" ', "“b”", '"', "rock'n'roll", '""')] == ["a", 'q, "the Fox"', "b", '"', "rock'n'roll", ""]


def readings(model, lat, known):
    """Every reading of a lattice by brute force: (cuts, known or spelled for each value) and its probability."""
    n, whole, out = len(lat.begins), math.log(model.total), {}
    for r in range(n):
        for mid in combinations(range(n - 1), r):
            ends = [*mid, n - 1]
            spans = list(zip([0, *(m + 1 for m in mid)], ends, strict=True))
            base = sum(math.log(model.separates[f]) if k in mid else math.log1p(-model.separates[f]) for k, f in enumerate(lat.forms))
            for kinds in product((0, 1), repeat=len(spans)):
                s = base
                for (i, j), spelled in zip(spans, kinds, strict=True):
                    v = lat.value(i, j)
                    if spelled:
                        s += math.log(model.novel) - whole - model.letter * (lat.ends[j] - lat.begins[i])
                    else:
                        s += known.scores[v] if v in known.scores else (0.0 if not v else -math.inf)
                if s > -math.inf:
                    out[tuple(spans), kinds] = s
    return out


def test_lattice_against_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "cd", "/", ",", " - ", "& "]) for _ in range(rng.randint(1, 11)))
        lat = V.lattice(text)
        n = len(lat.begins)
        spans = [lat.value(i, j) for i in range(n) for j in range(i, n)]
        known = V.Known.of({v: rng.uniform(0.1, 5) for v in spans if v and rng.random() < 0.4}, 20.0)
        model = V.Model({f: rng.uniform(0.05, 0.95) for f in lat.forms}, 20.0, 3.0, 0.4)
        table = readings(model, lat, known)
        z = sum(map(math.exp, table.values()))
        cut, want = [0.0] * (n - 1), {}
        for (way, _), s in table.items():
            for i, j in way:
                want[lat.key(i, j)] = want.get(lat.key(i, j), 0.0) + math.exp(s) / z
                if j < n - 1:
                    cut[j] += math.exp(s) / z
        values, cuts = model.expect(lat, known, 1e-12)
        assert all(abs(x - y) < 1e-6 for x, y in zip(cuts, cut, strict=True))
        assert {v for v in want if v and want[v] > 1e-9} <= {v for v, _ in values} and all(abs(p - want[v]) < 1e-6 for v, p in values)
        (whole, together, _), = model.expect_all([lat], known, 1e-12)
        assert all(abs(x - y) < 1e-9 for x, y in zip(together, cuts, strict=True))
        assert lat.forms == [] or all(abs(sum(p for v, p in whole if v == k) - w) < 1e-9 for k, w in values)
        best = max(table.values())
        found = [[v for v in (lat.value(*x) for x in way) if v] for (way, _), s in table.items() if s > best - 1e-9]
        assert model.best(lat, known) in found


def split(spark, texts, learn=None, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    sp = V.Splitter(df if learn is None else spark.createDataFrame([(t,) for t in learn], "text string"), **kw)
    return [r.vals for r in sp.split(df, "text").orderBy("i").collect()]


CORPUS = ["24/7 service, schools", "schools, I/O outage", "R&D, self-help", "self-help; schools", "24/7 service", "I/O outage, R&D", "budget, schools", "harbour, budget", "24/7 service, harbour"] * 8


def test_soft_delimiters_follow_the_column(spark):
    texts = ["schools / budget / harbour", "24/7 service / schools", "I/O outage / R&D / self-help", "budget /  / schools", "harbour / 24/7 service"]
    assert split(spark, texts, CORPUS + texts * 2) == [["schools", "budget", "harbour"], ["24/7 service", "schools"], ["I/O outage", "R&D", "self-help"], ["budget", "schools"], ["harbour", "24/7 service"]]


def test_known_values_that_are_joined_give_the_same(spark):
    texts = ["schools / budget / harbour", "24/7 service / schools", "I/O outage / R&D / self-help", 'harbour, "x, y"', None, " ", "harbour, x, y / z"]
    learn = CORPUS + [t for t in texts if t] * 2
    assert split(spark, texts, learn) == split(spark, texts, learn, known_bytes=-1)


def test_quotes_are_no_evidence_for_the_same_letters_unquoted(spark):
    learn = [f'"Ann, Bob", {w}' for w in ("schools", "budget", "tram", "harbour")] + ["schools, Ann", "Bob, tram"]
    assert split(spark, ["schools, Ann, Bob", 'tram, "Ann, Bob"'], learn) == [["schools", "Ann", "Bob"], ["tram", "Ann, Bob"]]


def test_values_of_any_number_of_stretches(spark):
    slug = "a-b-c-d-e-f-g-h-i-j-k-l"
    learn = [f"{slug}, {w}" for w in ("schools", "budget", "tram")] + [f"well-known-{w}, budget" for w in ("man", "town", "case")]
    assert split(spark, [f"budget, {slug}", "one-two-three-four-five-six-seven-eight-nine-ten, tram"], learn) == [["budget", slug], ["one-two-three-four-five-six-seven-eight-nine-ten", "tram"]]


def test_forms_and_odd_rows(spark):
    texts = ['["schools", "a, b"]', "#tram #self-help", "a；b、c，d", 'x • "y; z" / "q/r"', None, "", " , ;", "one", "one", 'a,"b', "Émile | b"]
    want = [["schools", "a, b"], ["tram", "self-help"], ["a", "b", "c", "d"], ["x", "y; z", "q/r"], [], [], [], ["one"], ["one"], ["a", '"b'], ["Émile", "b"]]
    assert split(spark, texts, CORPUS + [t for t in texts if t]) == want


def test_long_texts(spark):
    long = [", ".join(f"v{i}" for i in range(20_000)), ",".join('"a, ""b"""' for _ in range(5000)), "/".join("ab" for _ in range(400)), '"' * 20_001]
    got = split(spark, long)
    assert len(got[0]) == 20_000 and got[1] == ['a, "b"'] * 5000
    assert "/".join(got[2]).count("ab") == 400 and all(got[3])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("a/b, c", "old", "s")], "text string, vals string, seg string")
    out = V.Splitter(df.limit(0)).split(df, "text")
    assert out.columns == ["text", "seg", "vals"] and out.first().seg == "s"
    assert V.Splitter(df).split(df.limit(0), "text").count() == 0
