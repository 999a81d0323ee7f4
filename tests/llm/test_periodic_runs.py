"""Periodic runs against brute force."""
import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm.periodic_runs import collapse, digests, find_runs, lyndon_lengths, word_runs

SCHEMA = "doc_id long, text string, lang string, runs string, n_words int"


def slow_lyndon(s):
    def longest(i):
        return max(n for n in range(1, len(s) - i + 1) if all(s[i:i + n] < s[i + k:i + n] for k in range(1, n)))
    return [longest(i) for i in range(len(s))]


def slow_runs(w, least, repeats):
    out = set()
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i:j + q]
            if j > i and len(stretch) >= max(least, repeats * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.add((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    for _ in range(600):
        kinds, p = rng.randint(1, 4), rng.randint(1, 5)
        tail = [rng.randrange(kinds) for _ in range(rng.randint(0, 25))]
        yield tail + ([rng.randrange(kinds) for _ in range(p)] * 9)[:rng.randint(0, 36)] + tail[:rng.randint(0, 25)]


def test_lyndon_lengths():
    for s in texts():
        assert lyndon_lengths(s) == slow_lyndon(s), s


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 2), (5, 3)])
def test_runs(least, repeats):
    for s in texts():
        assert [tuple(r) for r in word_runs(np.array(s, np.int64), least, repeats).tolist()] == slow_runs(s, least, repeats), s


def test_long_text_of_few_words():
    rng = random.Random(6)
    s = [rng.randrange(3) for _ in range(30000)]
    runs = word_runs(np.array(s + s[:7000] * 5, np.int64)).tolist()
    assert [r for r in runs if r[2] == 7000][0][1] >= 35000
    assert [r for r in runs if r[0] + r[1] < 29900] == [list(r) for r in slow_short(s, 12) if r[0] + r[1] < 29900]


def slow_short(s, longest):
    """Runs of periods up to ``longest``."""
    out = {}
    for q in range(1, longest + 1):
        same = np.concatenate([[False], np.array(s[q:]) == np.array(s[:-q]), [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
    return sorted(((*k, q) for k, q in out.items()), key=lambda r: (r[0], r[2]))


def test_corner_cases(spark):
    rows = [(1, "a b " * 6, "en", "x", 1), (1, "a b " * 6, "en", "x", 1), (None, "go go go go go go", None, None, None), (2, None, None, None, None),
            (3, "", "", "", 0), (4, " \t\n", None, None, None), (5, "A a A a A a A a stop", None, None, None), (6, "é é é é é é é é é é é é", None, None, None),
            (7, "one two three", None, None, None), (8, ("x y z " * 5 + "q ") * 4, None, None, None)]
    found = find_runs(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed, r.n_words))
    assert got[1] == [([(0, 12, 2)], "a b", 12)] * 2
    assert got[None] == [([(0, 6, 1)], "go", 6)]
    assert got[2] == got[3] == got[4] == [([], "", 0)]
    assert got[5] == [([(0, 8, 2)], "A a stop", 9)]
    assert got[6] == [([(0, 6, 1)], "é é", 6)]
    assert got[7] == [([], "one two three", 3)]
    words = rows[-1][1].split()
    number = {"x": 0, "y": 1, "z": 2, "q": 3}
    runs = slow_runs([number[w] for w in words], 6, 4)
    assert got[8][0][0] == runs and got[8][0][1] == " ".join(collapse(words, np.array(runs)))
    out = {r.doc_id: r for r in digests(found).collect()}
    assert (out[8].n_runs, out[8].start, out[8].length, out[8].period, out[8].exponent_milli) == (5, 0, 15, 3, 5000)
    said = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    assert out[8].runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[7].start is None and out[7].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[6].collapsed_sha256 == hashlib.sha256("é é".encode()).hexdigest()


def test_empty_table(spark):
    assert digests(find_runs(spark.createDataFrame([], SCHEMA))).collect() == []
