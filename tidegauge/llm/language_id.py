"""Language of texts by hierarchical discrimination.

A first set of linear support vector machines, one a language family against the rest, names the
family of a text; within it one machine for each pair of languages votes. Texts are counts of
hashed byte n-grams of their letters. The machines are fitted to a bounded sample of labelled
texts, each in a task of its own.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm.words import as_bytes
from tidegauge.session import persist_plan

FIT_ROWS = 2048                  # labelled texts that machines are fitted to, about; twice as many at most
LANGUAGES = 200                  # learned, the most frequent
BUCKETS = 1 << 12
GRAMS = 4                        # bytes of an n-gram at most, blanks at its ends included
EPOCHS = 30
COST = 4.0
UNDETERMINED = "und"
#: Codes of languages by family. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "jv", "ms", "su"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
PIECE_BYTES, PIECE_TEXTS = 1 << 18, 128


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def family(language):
    return FAMILY.get(language, language)


def gram_counts(texts):
    """Counts of n-grams of letters by bucket, one row a text. Texts are lower-cased bytes.

    Whatever is no letter counts as a blank, several as one; an n-gram has blanks at its ends only.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                     # the first blank after a letter
    keep[0] = True
    at = np.flatnonzero(keep)
    data, letter = np.where(letter[at], data[at], 32), letter[at]
    text = text[np.maximum(at - 1, 0)]
    counts = np.zeros(len(texts) * BUCKETS)
    code = np.zeros(len(data), np.uint64)
    whole = np.ones(len(data), bool)
    for n in range(1, min(GRAMS, len(data)) + 1):
        code = code[:len(data) - n + 1] * np.uint64(257) + data[n - 1:].astype(np.uint64)
        first = letter[:len(data) - n + 1]
        if n == 1:
            fits = letter
        elif n == 2:
            fits = first | letter[1:]
        else:
            whole = whole[:len(data) - n + 1] & letter[n - 2:-1]
            fits = whole
        owner = np.where(first, text[:len(data) - n + 1], text[min(1, n - 1):][:len(data) - n + 1])
        h = (((code[fits] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(owner[fits] * BUCKETS + h, minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def vectors(texts):
    """Roots of the n-gram counts, scaled to length 1."""
    out = np.sqrt(gram_counts(texts))
    return (out / np.maximum(np.sqrt((out ** 2).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)


def parts(texts):
    """Ranges of texts of bounded size and number; a longer text is a range of its own end."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES or i + 1 - first == PIECE_TEXTS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _vectors(batches):
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        rows = [v.astype(np.float16).tobytes() for a, b in parts(texts) for v in vectors(texts[a:b])]
        yield pa.RecordBatch.from_arrays([batch.column("sign"), batch.column("lang"), pa.array(rows, pa.binary())], ["sign", "lang", "vector"])


def fit_machine(x, side, epochs=EPOCHS, cost=COST):
    """Weights and bias of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    ``side`` is 1 or -1; both sides weigh the same. The bias is the weight of a constant feature.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    limit = np.where(side > 0, 0.5 / max((side > 0).mean(), 1e-9), 0.5 / max((side < 0).mean(), 1e-9)) * cost
    ridge = 0.5 / limit
    square = (x ** 2).sum(axis=1) + ridge
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)).tolist():
            slope = side[i] * (x[i] @ w) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - slope / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * side[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _fit(key, table):
    table = table.sort_by("sign")
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float16).reshape(table.num_rows, BUCKETS)
    w = fit_machine(x, table.column("side").to_numpy().astype(float))
    return pa.table({"machine": [key[0].as_py()], "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def machines(languages):
    """Machines to fit: (name, languages on its one side, languages on the other)."""
    families = sorted({family(x) for x in languages})
    out = []
    if len(families) > 1:
        out += [(("family", f), [x for x in languages if family(x) == f], [x for x in languages if family(x) != f]) for f in families]
    for f in families:
        out += [(("pair", a, b), [a], [b]) for a, b in combinations(sorted(x for x in languages if family(x) == f), 2)]
    return out


def fit_languages(docs):
    """Learned languages, and the weights of the machines by name.

    At most LANGUAGES languages are learned; each gives an equal part of about FIT_ROWS texts,
    chosen by a hash of the row, so that repeated rows count once.
    """
    spark = docs.sparkSession
    learn = docs.where("lang is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in learn.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    plan = [(str(k), x, side) for k, (_, one, other) in enumerate(machines(languages)) for side, xs in ((1, one), (-1, other)) for x in xs]
    if not plan:
        return languages, {}
    quota = max(1, FIT_ROWS // len(languages))
    share = F.create_map(*(v for x in languages for v in (F.lit(x), F.lit(min(1.0, quota / counts[x])))))
    draw = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 40)) / float(1 << 40)
    rows = learn.withColumn("share", F.element_at(share, F.col("lang"))).withColumn("draw", draw).where("draw < share")
    rows = rows.groupBy(F.xxhash64("text", "doc_id").alias("sign")).agg(F.min(F.struct("lang", F.lower("text").alias("text"))).alias("row"))
    rows = rows.select("sign", "row.*").orderBy("sign").limit(2 * FIT_ROWS)
    rows = persist_plan(rows.mapInArrow(_vectors, "sign long, lang string, vector binary"))
    sides = spark.createDataFrame(plan, "machine string, lang string, side int")
    fitted = rows.join(sides, "lang").groupBy("machine").applyInArrow(_fit, "machine string, weights binary").collect()
    names = [m[0] for m in machines(languages)]
    return languages, {names[int(r.machine)]: np.frombuffer(bytes(r.weights), np.float32) for r in fitted}


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(2 * z, -50, 50)))


def discriminate(x, languages, weights):
    """Number of the language of every row of vectors, and a score of 0 to 1."""
    families = sorted({family(v) for v in languages})
    margin = lambda name: x @ weights[name][:-1] + weights[name][-1] if name in weights else np.zeros(len(x))      # noqa: E731
    out, score = np.zeros(len(x), np.int64), np.ones(len(x))
    chosen = np.zeros(len(x), np.int64)
    if len(families) > 1:
        p = _logistic(np.stack([margin(("family", f)) for f in families], axis=1))
        chosen = p.argmax(axis=1)
        score = p.max(axis=1) / p.sum(axis=1)
    for k, f in enumerate(families):
        own = [v for v in languages if family(v) == f]
        rows = np.flatnonzero(chosen == k)
        votes, sums, sure = (np.zeros((len(rows), len(own))) for _ in range(3))
        for (i, a), (j, b) in combinations(enumerate(own), 2):
            z = margin(("pair", a, b))[rows]
            p = _logistic(z)
            votes[:, i] += z >= 0
            votes[:, j] += z < 0
            sums[:, i] += z
            sums[:, j] -= z
            sure[:, i] += p
            sure[:, j] += 1 - p
        best = (votes * 1e6 + np.tanh(sums / (len(own) * 100.0))).argmax(axis=1) if len(own) else np.zeros(len(rows), np.int64)
        out[rows] = np.array([languages.index(v) for v in own])[best]
        if len(own) > 1:
            score[rows] *= sure[np.arange(len(rows)), best] / (len(own) - 1)
    return out, score


def _predictor(languages, weights):
    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            found = [discriminate(vectors(texts[a:b]), languages, weights) for a, b in parts(texts)]
            which = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            score = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([languages[k] for k in which], pa.string()), pa.array(score, pa.float64()), batch.column("any")],
                                             ["doc_id", "lang_pred", "score", "any"])
    return run


def predict_languages(docs):
    """Language of every text: doc_id, held_out, lang_pred, score.

    ``docs``: ``doc_id``, ``text``, ``lang``; other columns are ignored, and ``lang`` is only
    learned from, where it is not null and the document not held out (crc32 of its id, modulo 5,
    is 0). A text that is null or has no letter is ``und`` with score 0, and so is every text
    when nothing can be learned; with one learned language all texts with a letter are in it,
    with score 1. Repeated rows are predicted each. Rows with a null doc_id are predicted but
    not learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    languages, weights = fit_languages(docs)
    if not languages:
        return docs.select("doc_id", held, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("any"))
    found = rows.mapInArrow(_predictor(languages, weights), "doc_id long, lang_pred string, score double, any boolean")
    return found.select("doc_id", held, F.when(F.col("any"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
                        F.when(F.col("any"), F.col("score")).otherwise(0.0).alias("score"))
