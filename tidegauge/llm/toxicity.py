"""Toxicity by weak supervision.

Words and word beginnings that set apart labelled toxic texts become lexicon voters; counts and
densities of their hits are pattern voters. A generative label model estimates how often each
voter fires on toxic and clean texts, by expectation maximisation over all texts, and how voters
correlate within a class, which discounts voters that repeat each other. A linear classifier
trained on its posterior labels scores the texts.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm.words import LOWER, U, as_bytes, joined, pieces, span_hashes
from tidegauge.session import persist_plan

FIT_ROWS = 20000                 # labelled texts, and hit texts for the classifier, at most (in hashed order)
BEGINNINGS = (4, 5, 6)           # bytes of word beginnings
TERMS = 512                      # of the lexicon
LEAST_TEXTS = 3                  # labelled toxic texts that a term needs
VOTERS = 64                      # terms that vote on their own
ROUNDS = 6
THRESHOLD = 0.7
PATTERNS = ((1, 0.0), (2, 0.0), (3, 0.0), (1, 0.005), (1, 0.02))    # least hits, least hits a word
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def terms_of(texts):
    """Hash and text number of every word and word beginning, and words per text."""
    data, offsets = joined(texts)
    data = LOWER[data]
    letter = LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    text = np.searchsorted(offsets, starts, "right") - 1
    long = [np.flatnonzero(ends - starts > k) for k in BEGINNINGS]
    first = np.concatenate([starts, *(starts[i] for i in long)])
    last = np.concatenate([ends, *(starts[i] + k for i, k in zip(long, BEGINNINGS))])
    return span_hashes(data, first, last), np.concatenate([text, *(text[i] for i in long)]), np.bincount(text, minlength=len(texts))


def _counter(batches):
    """Texts of each class that have each term, for labelled texts."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        texts = as_bytes(batch.column("text"))
        seen, classes = [np.zeros(0, U)], [np.zeros(0, bool)]
        for a, b in pieces(texts):
            term, text, _ = terms_of(texts[a:b])
            order = np.lexsort((text, term))
            term, text = term[order], text[order]
            new = np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])]) if len(term) else np.zeros(0, bool)
            seen.append(term[new])
            classes.append(toxic[a:b][text[new]])
        term, number = np.unique(np.concatenate(seen), return_inverse=True)
        bad = np.bincount(number, np.concatenate(classes), len(term))
        every = np.bincount(number, minlength=len(term))
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(bad.astype(np.int64)),
                                          pa.array((every - bad).astype(np.int64))], ["term", "bad", "good"])


def find_terms(docs, labels):
    """Lexicon from labelled texts outside the held-out part: (hashes, rates on toxic, on clean, share)."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = persist_plan(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")        # FIT_ROWS rows of 12 bytes at most
    bad, good = rows.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    bad, good = bad or 0, good or 0
    counts = texts.select((F.col("toxic") > 0).alias("toxic"), "text").mapInArrow(_counter, "term long, bad long, good long")
    counts = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    gain = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = counts.where(F.col("bad") >= LEAST_TEXTS).withColumn("gain", gain).where(F.col("gain") > 2.0) \
        .orderBy((F.col("bad") * F.col("gain")).desc(), "term").limit(TERMS).collect()
    hashes = np.array([r.term for r in best], np.int64).view(U)
    on_bad = np.array([(r.bad + 0.5) / (bad + 1.0) for r in best])
    on_good = np.array([(r.good + 0.5) / (good + 1.0) for r in best])
    return hashes, on_bad, on_good, (bad + 0.5) / (bad + good + 1.0)


def _hits(hashes, carry=()):
    """Lexicon terms in each text: distinct ones by number, all of them, and words."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    table = np.zeros(1 << 16, bool)
    table[(ranked & U(0xFFFF)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            lists, totals, words = [], [], []
            for a, b in pieces(texts):
                term, text, n = terms_of(texts[a:b])
                maybe = np.flatnonzero(table[(term & U(0xFFFF)).astype(np.int64)])
                i = np.minimum(np.searchsorted(ranked, term[maybe]), max(len(ranked) - 1, 0))
                ok = ranked[i] == term[maybe] if len(ranked) else np.zeros(0, bool)
                of, which = text[maybe[ok]], order[i[ok]]
                totals.append(np.bincount(of, minlength=b - a))
                words.append(n)
                both = np.unique(of * TERMS + which)
                cut = np.searchsorted(both, np.arange(b - a + 1) * TERMS)
                lists += [(both[x:y] % TERMS).tolist() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32())),
                 pa.array(np.concatenate(totals) if totals else [], pa.int64()), pa.array(np.concatenate(words) if words else [], pa.int64()),
                 *[batch.column(c) for c in carry]],
                ["doc_id", "hits", "total", "words", *carry])
    return run


def matrix(batch, terms):
    """Hits of a batch as a 0/1 matrix, and hits in all and per word."""
    lists = batch.column("hits").to_pylist()
    out = np.zeros((len(lists), terms))
    for i, x in enumerate(lists):
        if x:
            out[i, x] = 1
    total = batch.column("total").to_numpy().astype(float)
    return out, total, total / np.maximum(batch.column("words").to_numpy(), 1)


def votes(batch, terms):
    """What each voter says: its term or pattern is there (1) or not."""
    hit, total, rate = matrix(batch, terms)
    patterns = [(total >= least) & (rate >= dense) for least, dense in PATTERNS]
    return np.concatenate([hit[:, :VOTERS], np.array(patterns, float).T.reshape(len(hit), len(PATTERNS))], axis=1)


def posterior(vote, model):
    """Log odds of toxic under the label model."""
    share, bad, good, weight = model
    odds = vote * (np.log(bad) - np.log(good)) + (1 - vote) * (np.log1p(-bad) - np.log1p(-good))
    return np.log(share) - np.log1p(-share) + odds @ weight


def _sums(model, terms):
    """Expected firings by class, and of pairs of voters."""
    def run(batches):
        total = None
        for batch in batches:
            vote = votes(batch, terms)
            p = 1 / (1 + np.exp(-np.clip(posterior(vote, model), -50, 50)))
            now = np.concatenate([[p.sum(), len(p)], p @ vote, vote.sum(axis=0), ((vote * p[:, None]).T @ vote).ravel(), (vote.T @ vote).ravel()])
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
    return run


def label_model(hits, on_bad, on_good, share):
    """Rates of every voter on both classes and its weight, estimated over all texts.

    The rates on labelled texts start the estimate and stay in it as a prior worth 100 texts of
    each class. A voter's weight falls with its correlations with the others within the classes.
    """
    terms = len(on_bad)
    guess = lambda rates, least: np.concatenate([rates[:VOTERS], np.full(len(PATTERNS), least)])      # noqa: E731
    bad, good = guess(on_bad, 0.9), guess(on_good, 0.02)
    start = (bad, good)
    weight = np.ones(len(bad))
    m = len(bad)
    for _ in range(ROUNDS):
        model = (share, bad, good, weight)
        blobs = [np.frombuffer(r.sums) for r in hits.mapInArrow(_sums(model, terms), "sums binary").toLocalIterator()]
        if not blobs:
            break
        total = np.sum(blobs, axis=0)
        toxic, n = total[:2]
        fired, every = total[2:2 + m], total[2 + m:2 + 2 * m]
        both = total[2 + 2 * m:2 + 2 * m + m * m].reshape(m, m)
        pairs = total[2 + 2 * m + m * m:].reshape(m, m)
        bad = np.clip((fired + 100 * start[0]) / (toxic + 100), 1e-4, 1 - 1e-4)
        good = np.clip((every - fired + 100 * start[1]) / (n - toxic + 100), 1e-4, 1 - 1e-4)
        share = float(np.clip((toxic + 1) / (n + 2), 1e-3, 0.5))
        weight = 1 / (1 + _correlation(both / max(toxic, 1e-9), fired / max(toxic, 1e-9))
                      + _correlation((pairs - both) / max(n - toxic, 1e-9), (every - fired) / max(n - toxic, 1e-9)))
    return share, bad, good, weight


def _correlation(pairs, rates):
    """Sum of each voter's squared correlations with the others in a class."""
    spread = np.sqrt(np.maximum(rates * (1 - rates), 1e-12))
    out = np.clip((pairs - np.outer(rates, rates)) / np.outer(spread, spread), -1, 1)
    out[:, rates * (1 - rates) < 1e-6] = 0
    out[rates * (1 - rates) < 1e-6] = 0
    np.fill_diagonal(out, 0)
    return (out ** 2).sum(axis=1)


def features(batch, terms):
    hit, total, rate = matrix(batch, terms)
    return np.concatenate([hit, np.log1p(total)[:, None], np.log1p(hit.sum(axis=1))[:, None], (total > 0)[:, None], np.minimum(50 * rate, 1)[:, None],
                           np.ones((len(hit), 1))], axis=1)


def train(x, y, rounds=400, ridge=1e-4):
    """Weights of a logistic regression on soft labels, classes weighing the same."""
    w = np.zeros(x.shape[1])
    importance = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    pace, mean = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (importance * (p - y)) + ridge * w
        mean, pace = 0.9 * mean + 0.1 * g, 0.99 * pace + 0.01 * g * g
        w -= 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(pace / (1 - 0.99 ** t)) + 1e-8)
    return w


def _scorer(w, terms, carry=()):
    def run(batches):
        for batch in batches:
            z = features(batch, terms) @ w
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))), *[batch.column(c) for c in carry]], ["doc_id", "score", *carry])
    return run


def toxicity_scores(docs, labels, carry=()):
    """Toxicity of every text: doc_id, held_out, score, predicted (score of at least 0.7).

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``; other columns
    are ignored. Only labels of documents outside the held-out part are read, from FIT_ROWS of
    them at most; null labels count as none, a document labelled twice as toxic if once. Null
    and empty texts are scored as texts without hits. Repeated rows are scored each; rows with
    a null doc_id score too, outside the held-out part. Without any term found, as for an empty
    table of labels, every score is 0. ``carry`` names string columns that are returned as well.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    more = "".join(f", {c} string" for c in carry)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    hashes, on_bad, on_good, share = find_terms(docs, labels)
    if not len(hashes):
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *carry)
    terms = len(hashes)
    hits = persist_plan(docs.mapInArrow(_hits(hashes, carry), "doc_id long, hits array<int>, total long, words long" + more))
    model = label_model(hits, on_bad, on_good, share)
    chosen = hits.where(~held_out(F.col("doc_id")))
    some = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).toArrow().to_batches()       # noqa: E731
    batches = some(chosen.where("total > 0"), FIT_ROWS // 2) + some(chosen.where("total = 0"), FIT_ROWS // 10)
    x = np.concatenate([features(b, terms) for b in batches])
    y = np.concatenate([1 / (1 + np.exp(-np.clip(posterior(votes(b, terms), model), -50, 50))) for b in batches])
    scored = hits.mapInArrow(_scorer(train(x, y), terms, carry), "doc_id long, score double" + more)
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *carry)
