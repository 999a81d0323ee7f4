"""Language prediction: features and votes against a slow version, held-out accuracy, corner cases."""
import zlib
from itertools import combinations

import numpy as np
import pytest

from tidegauge.llm.language_id import BUCKETS, FAMILY, discriminate, fit_machine, gram_counts, machines, predict_languages

SCHEMA = "doc_id long, text string, lang string, score double, held_out int, any string"


def slow_counts(text):
    letters = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text)
    out = np.zeros(BUCKETS)
    for word in letters.split(b" "):
        padded = b" " + word + b" "
        for n in range(1, 5):
            for i in range(len(padded) - n + 1):
                gram = padded[i:i + n]
                if word and gram.strip(b" "):
                    code = 0
                    for c in gram:
                        code = code * 257 + c
                    out[((code + (n << 40)) * 0x9E3779B97F4A7C15 % 2 ** 64) >> 52] += 1
    return out


def test_gram_counts():
    texts = ["the end.", "", "  ", "a", "été là-bas", "x" * 5 + " 12 z", "ab  cd\n\tef", "é", "no. no! no?"]
    want = np.array([slow_counts(t.encode()) for t in texts])
    assert np.array_equal(gram_counts([t.encode() for t in texts]), want)
    assert all(np.array_equal(gram_counts([t.encode()])[0], w) for t, w in zip(texts, want))


def test_machines():
    names = [m[0] for m in machines(["en", "de", "nl", "fr", "es", "tlh"])]
    assert names == [("family", "germanic"), ("family", "romance"), ("family", "tlh"), ("pair", "de", "en"), ("pair", "de", "nl"), ("pair", "en", "nl"), ("pair", "es", "fr")]
    assert [m[0] for m in machines(["en", "de"])] == [("pair", "de", "en")] and machines(["en"]) == [] == machines([])


def test_votes_against_slow():
    rng = np.random.default_rng(2)
    languages = sorted(["en", "de", "nl", "sv", "fr", "es", "xx"])
    weights = {m[0]: rng.normal(size=9) for m in machines(languages)}
    x = rng.normal(size=(200, 8))
    got, score = discriminate(x, languages, weights)
    for row, number in zip(x, got):
        z = lambda name: row @ weights[name][:8] + weights[name][8]       # noqa: E731
        families = sorted({FAMILY.get(v, v) for v in languages})
        best = max(families, key=lambda f: z(("family", f)))
        own = [v for v in languages if FAMILY.get(v, v) == best]
        votes, sums = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for a, b in combinations(own, 2):
            m = z(("pair", a, b))
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        assert languages[number] == max(own, key=lambda v: (votes[v], sums[v]))
    assert ((score >= 0) & (score <= 1)).all()


def test_machine_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    side = np.where(x @ [1, -2, 0.5, 0, 1] > 0.3, 1.0, -1.0)
    w = fit_machine(x, side, epochs=200, cost=100.0)
    assert ((x @ w[:-1] + w[-1] > 0) == (side > 0)).mean() > 0.98


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in predict_languages(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    unseen = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in unseen) and sum(r.held_out for r in got.values()) == len(unseen)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in unseen]) > 0.97
    hidden = predict_languages(docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz', lang) as lang"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in hidden.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


@pytest.fixture
def rows():
    out, i = [], 0
    while len(out) < 80:
        i += 1
        lang, text = [("en", "the cat and the dog were there"), ("de", "der hund und die katze waren über"), ("fr", "le chat et la chienne étaient")][i % 3]
        out.append((i, text + " " + "xyz"[i % 3] * (i % 4), lang, 0.5, 1, "c"))
    return out


def test_corner_cases(spark, rows):
    more = [(1000, None, "en", None, None, None), (1001, "", "de", None, None, None), (1002, "12 + 34 — !", "fr", None, None, None), (1003, "THE CAT AND THE DOG", None, None, None, None),
            (None, "der hund und die katze", "en", None, None, None), (1004, "le chat et la chienne étaient " * 20000, None, None, None, None), rows[0], rows[0]]
    got = predict_languages(spark.createDataFrame(rows + more, SCHEMA)).collect()
    assert len(got) == len(rows) + len(more)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert (by_id[1003].lang_pred, by_id[None].lang_pred, by_id[1004].lang_pred) == ("en", "de", "fr")
    assert by_id[None].held_out is False
    same = [r for r in got if r.doc_id == rows[0][0]]
    assert len(same) == 3 and len(set(same)) == 1
    assert all(by_id[i].lang_pred == lang for i, _, lang, *_ in rows)


def test_little_to_learn(spark, rows):
    one = predict_languages(spark.createDataFrame([r[:2] + ("en",) + r[3:] for r in rows] + [(5000, "?", None, None, None, None)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0), ("und", 0.0)}
    none = predict_languages(spark.createDataFrame([r[:2] + (None,) + r[3:] for r in rows], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert predict_languages(spark.createDataFrame([], SCHEMA)).collect() == []

