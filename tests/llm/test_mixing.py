"""Mixing on hot ids: queues are spread over parts, and the order is the global one."""
import hashlib

from pyspark.sql import functions as F

from tidegauge.llm import mixing


def slow(rows):
    """rows: (doc_id, size, source) -> words taken by row, in order of the queue."""
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, t in rows if t == s) for s in names}
    total, open_, target = sum(size.values()), list(names), {}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    rest = total
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * size[s]]
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else weight[s] * level
        rest -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    out = []
    for s in names:
        own = sorted(((hashlib.md5(f"{'null' if d is None else d}mix-1".encode()).hexdigest(), d is not None, d or 0, n) for d, n, t in rows if t == s))
        upto = 0
        for _, known, d, n in own:
            upto += n
            out += [((s, d if known else None, n), n, (k * size[s] + upto) / target[s]) for k in range(3) if n and target[s]]
    budget, taken, used = total, {}, 0
    for time in sorted({f for *_, f in out}):
        words = sum(n for _, n, f in out if f == time)
        if used + words > budget:
            break
        used += words
        for key, n, f in out:
            if f == time:
                taken[key] = taken.get(key, 0) + n
    return taken


def test_hot_ids_against_a_slow_queue(spark):
    rows = [(None, 1 + i % 3, "a") for i in range(120)] + [(7, 2, "a")] * 60 + [(i, i % 5, ["b", "c", None][i % 3]) for i in range(90)]
    docs = spark.createDataFrame([(d, " ".join("x" * n), s, 1, 2) for d, n, s in rows], "doc_id long, text string, source string, size int, turn int")
    got = {}
    for r in mixing.mix_sources(docs).collect():
        if r.taken:
            key = (r.source_size, r.doc_id, r["size"])
            got[key] = got.get(key, 0) + r.taken
    size = {s: sum(n for _, n, t in rows if t == s) for s in ("a", "b", "c", None)}
    want = {}
    for (s, d, n), words in slow(rows).items():
        key = (size[s], d, n)
        want[key] = want.get(key, 0) + words
    assert got == want


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    seen = []
    written = mixing.persist_plan

    def watch(df):
        out = written(df)
        if "_nth" in out.columns:
            seen.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out
    monkeypatch.setattr(mixing, "persist_plan", watch)
    docs = spark.range(8000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'s' as source")
    assert mixing.mix_sources(docs).agg(F.sum("taken")).first()[0] == 24000
    assert max(seen[0]) < 3000
