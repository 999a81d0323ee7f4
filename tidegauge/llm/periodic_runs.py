"""Periodic runs of words, by Baier's grouping.

A run is a stretch whose words repeat at a distance, its period, and that no neighbour extends.
The first phase of Baier's suffix sorter groups the positions of a text by their longest Lyndon
words, so it yields the Lyndon array without sorting suffixes. Done under an order of the words
and under its reverse, it names a Lyndon root of every run: at some position of the run the
longest Lyndon word of one of the orders is as long as the period. Longest common extensions of
that position and the one a root later give the run.

Words that occur too seldom to be in a run of the wanted exponent cut a text into stretches
first, again within each stretch until nothing falls out; this loses no run.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm.words import as_bytes

LEAST = 6                        # words of a run
REPEATS = 4                      # periods of a run
SLICE_BYTES = 1 << 23            # of texts handed on at a time


def lyndon_lengths(symbols):
    """Length of the longest Lyndon word at every position of a list of comparable symbols.

    Groups are gone through from the highest. Every position of a group looks for the nearest
    position to its left that is in a lower group; such a position, found by c members, takes
    their words to its own: its group splits, more finds being higher, and the parts go right
    above what is left of the group.
    """
    values = sorted(set(symbols))
    rank = {v: k for k, v in enumerate(values)}
    group = [rank[v] for v in symbols]
    members = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(values)
    below = list(range(-1, len(values) - 1))
    above = [*range(1, len(values)), -1]
    left = list(range(-1, len(group) - 1))                     # where the search goes on from a position already seen
    seen = [False] * len(group)
    out = [1] * len(group)
    now = len(values) - 1
    while now >= 0:
        here = [i for i in members[now] if group[i] == now]     # those that moved on are still listed
        size = length[now]
        for i in here:
            seen[i] = True
            out[i] = size
        finds = {}
        for i in here:
            p = left[i]
            while p >= 0 and seen[p]:
                q = left[p]
                if q >= 0 and seen[q]:
                    left[p] = left[q]
                p = q
            left[i] = p
            if p >= 0:
                finds[p] = finds.get(p, 0) + 1
        parts = {}
        for p, c in finds.items():
            parts.setdefault((-c, group[p]), []).append(p)
        for (c, old), moved in sorted(parts.items()):
            new = len(members)
            for p in moved:
                group[p] = new
            members.append(moved)
            length.append(length[old] - c * size)
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = new
            if top >= 0:
                below[top] = new
        now = below[now]
    return out


def stretches(words, least=LEAST, repeats=REPEATS):
    """Numbers of the words that may be in a run, ascending, and the stretch that each is in."""
    at, of = np.arange(len(words)), np.zeros(len(words), np.int64)
    while len(at):
        _, which, times = np.unique(of * (len(words) + 1) + words[at], return_inverse=True, return_counts=True)
        stays = (times[which] >= repeats) & (np.bincount(of)[of] >= least)
        if stays.all():
            break
        at = at[stays]
        of = np.concatenate([[0], np.cumsum(np.diff(at) != 1)]) if len(at) else at
    return at, of


def stretch_names(text, longest):
    """Numbers that are equal for equal stretches of 1, 2, 4, ... symbols, up to ``longest``."""
    names = [text]
    while 2 << (len(names) - 1) <= longest:
        half, last = 1 << (len(names) - 1), names[-1]
        pair = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(np.unique(pair, return_inverse=True)[1])
    return names


def extend(names, a, b, back=False):
    """How far the texts from ``a`` and from ``b`` > ``a`` on agree, or with ``back`` those before them."""
    a, b, agreed = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, name = 1 << k, names[k]
        inside = a >= step if back else b + step <= len(names[0])
        shift = -step if back else 0
        same = inside & (name[np.where(inside, a + shift, 0)] == name[np.where(inside, b + shift, 0)])
        move = np.where(same, step, 0)
        agreed += move
        a += -move if back else move
        b += -move if back else move
    return agreed


def word_runs(words, least=LEAST, repeats=REPEATS):
    """Runs of an array of word numbers: rows of start, length and smallest period, by start, then period."""
    if repeats < 2:
        raise ValueError("a run has two periods at least")
    at, of = stretches(words, least, repeats)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(at)]])
    spot = np.arange(len(at)) + of                             # one place between stretches, equal to nothing
    text = int(words.max()) + 1 + np.arange(spot[-1] + 1)
    text[spot] = words[at]
    names = stretch_names(text, int(np.diff(firsts).max()))
    roots = []
    for order in (1, -1):
        for first, last in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            size = np.array(lyndon_lengths((order * words[at[first:last]]).tolist()))
            fits = np.flatnonzero(size * repeats <= last - first)
            roots.append(np.stack([spot[first] + fits, size[fits]]))
    start, period = np.unique(np.concatenate(roots, axis=1), axis=1)
    fits = start + period < len(text)
    start, period = start[fits], period[fits]
    before = extend(names, start, start + period, back=True)
    length = before + period + extend(names, start, start + period)
    fits = length >= np.maximum(least, repeats * period)
    place = np.zeros(len(text), np.int64)
    place[spot] = at
    return np.unique(np.stack([place[(start - before)[fits]], period[fits], length[fits]], axis=1), axis=0)[:, [0, 2, 1]]


def collapse(words, runs):
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, drop in zip(words, np.cumsum(edge[:-1]).tolist()) if not drop]


def strongest(runs):
    """The run of the greatest length by period, of equal ones the first, then the shortest period; None without runs."""
    return max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(least, repeats, rewrite):
    def one(doc_id, text):
        words = text.split()                                   # of bytes: at blanks, \t, \n, \v, \f and \r only
        if rewrite is not None:
            words = rewrite(doc_id, words)
        number = {}
        runs = word_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least, repeats)
        kept = collapse(words, runs) if len(runs) else words
        as_run = lambda r: dict(zip(("start", "length", "period"), r))       # noqa: E731
        best = strongest(runs)
        return len(words), [as_run(r) for r in runs.tolist()], best and as_run(best), b" ".join(kept)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            first = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= SLICE_BYTES or i + 1 == len(texts):
                    n, runs, best, kept = zip(*(one(d, t) for d, t in zip(ids[first:i + 1], texts[first:i + 1])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[first:i + 1], pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.binary())],
                        ["doc_id", "n_words", "runs", "strongest", "collapsed"])
                    first, size = i + 1, 0
    return run


def find_runs(docs, least=LEAST, repeats=REPEATS, rewrite=None):
    """Runs of every text: doc_id, n_words, runs, strongest, collapsed.

    ``docs``: ``doc_id`` and ``text``; other columns are ignored. Words lie between blanks, tabs
    and line ends and count as they are written. ``runs`` (start and length in words, period)
    have ``least`` words and ``repeats`` periods at least, by start, then period; ``strongest``
    is the one with the most periods; ``collapsed`` has the words that no run contains after its
    first period, joined by blanks. ``rewrite`` (doc_id, list of words as bytes) gives the words
    to look at instead. Null and empty texts have no words and no runs. Every row is handled by
    itself, repeated ones and those with a null doc_id too; the time is linear in a text but for
    the naming of equal stretches, which sorts its repetitive parts once a power of two.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _finder(least, repeats, rewrite),
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found):
    """The figures of ``find_runs`` a document, its lists and texts as digests."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))       # noqa: E731
    lines = F.concat(F.concat_ws("\n", F.transform("runs", line)), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
