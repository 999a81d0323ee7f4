"""The training-data operators against brute force and on corner cases."""
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest

from tidegauge.llm import attention_lm, chat_trees, jaccard_join, metric_tree, mixing, near_vectors, pieces, queries, suffix_dedup, toxicity, url_reputation

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sign string, component string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and repeated texts, a long one, a shared passage, and columns with names used inside."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))      # noqa: E731
    passage, base = text(60), text(200)
    texts = [None, "", "   ", "one", "two words", base, base, base + " tail", text(4000), text(30) + passage, passage + text(40), "Ab AB ab", "é" * 90, "é" * 95]
    near = base.split()
    near[3], near[150] = "changed", "again"
    texts += [" ".join(near)] + [text(rng.randint(1, 120)) for _ in range(40)] + [passage] * 3
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b", "ä"][i % 4], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).persist()


def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets, linked):
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and linked(sets[i], sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_repeats(docs):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    first = {}
    for i, t in sorted(by_id(docs).items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first.setdefault(b[s:s + 50], i) < i:
                gone[s:s + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert got[i].kept_text == kept.decode("utf-8", "ignore")


def test_common_anchors_are_split_exactly(docs, monkeypatch):
    want = {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(docs, with_text=False).collect()}
    monkeypatch.setattr(suffix_dedup, "BUSY", 1)
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(docs, with_text=False).collect()} == want


def test_shingle_classes(docs):
    sets = {i: shingles(t) for i, t in by_id(docs).items()}
    want = classes(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b))
    got = jaccard_join.shingle_classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets} and len(got) == len(sets)


def test_common_parts_and_large_groups(spark, monkeypatch):
    """Most parts common, the group too large for one task at first: the same classes."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(50):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes({i: shingles(t) for i, t in rows}, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    monkeypatch.setattr(jaccard_join, "LOCAL", 40)
    assert {r.doc_id: r.component_id for r in jaccard_join.shingle_classes(data).collect()} == want


def test_steps_of_large_groups_do_not_grow_with_their_unlike_texts(spark, monkeypatch):
    """A candidate group of texts near the limit, many blocks: the same classes in as many steps as ever."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([1, 3, 4, 5])):
            w[k] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes({i: shingles(t) for i, t in rows}, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    steps, persist = [], jaccard_join.persist_plan

    def counted(df):
        steps.append(df.columns)
        assert len(steps) < 16                                  # one text a round took five steps a text
        return persist(df)
    monkeypatch.setattr(jaccard_join, "persist_plan", counted)
    monkeypatch.setattr(jaccard_join, "LOCAL", 16)
    assert {r.doc_id: r.component_id for r in jaccard_join.shingle_classes(data).collect()} == want
    assert ["rep", "known"] in steps


def test_chat_escapes_and_ranks(spark):
    for text in ("", "<|im_end|>", "a\\|<|b", "\\", "<", "<|<|\\n\n", "x<"):
        formatted, mask = chat_trees.render(["user", "assistant"], [text, text])
        assert chat_trees.parse(formatted) == [("user", text), ("assistant", text)]
        assert [chat_trees.unescape(formatted[a:b]) for a, b in mask] == [text]
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 5.0, "assistant", None), (1, 4, 3, None, None, "more"), (2, 1, 9, 0.0, "user", "lost parent")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = {(r.tree, r["rank"]): chat_trees.parse(r.formatted) for r in chat_trees.format_trees(nodes, top=None).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", ""), ("", "more")], (1, 2): [("user", "q"), ("assistant", "bad")], (2, 1): [("user", "lost parent")]}
    assert chat_trees.format_trees(nodes.limit(0)).count() == 0


def test_chat_without_a_name_and_long_chains(spark):
    rows = [(None, 2, "assistant", "yes", 0, "n"), (None, 1, "user", "go", 0, "n"), (5, 1, None, None, 0, "n"), (5, 1, None, None, 0, "n")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}", 0, "n") for i in range(300)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int, tree string")
    got = {r.conv_id: r for r in chat_trees.digests(chat_trees.format_trees(chat_trees.as_chains(talk))).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {None: 2, 5: 2, 9: 300}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\ngo\nassistant\nyes\n").hexdigest() and got[None].loss_chars == 3
    assert got[9].loss_sha256 == hashlib.sha256("".join(f"turn {i}" for i in range(1, 300, 2)).encode()).hexdigest()
    loop = spark.createDataFrame([(1, 1, 2, 0.0, "a", "b"), (1, 2, 1, 0.0, "a", "b"), (1, 3, 3, 1.0, "a", "c")], "tree long, node long, parent long, score double, role string, text string")
    assert [chat_trees.parse(r.formatted) for r in chat_trees.format_trees(loop).collect()] == [[("a", "c")]]


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = {r.conv_id: r for r in queries.QUERIES["op2_chat_formatting"](spark, sf).collect()}
    for key, x in rows.groupby("conv_id"):
        learned = "".join(t or "" for r, t in zip(x.role, x.text) if r == "assistant")
        turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(x.role, x.text))
        assert (got[key].n_turns, got[key].turns_sha256, got[key].loss_chars) == (len(x), hashlib.sha256(turns.encode()).hexdigest(), len(learned))
        assert got[key].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert got[-1].n_turns == 2 and len(got) == rows.conv_id.nunique() + 1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), "x") for i in range(160)]
    rows += [(200 + i, (np.array(rows[0][1]) + rng.standard_normal(8) * 0.05).tolist(), "x") for i in range(30)] + [(300 + i, rows[0][1], "x") for i in range(10)]
    rows += [(400, None, "x"), (401, [0.0] * 8, "x"), (402, [None] + [1.0] * 7, "x"), (403, [float("nan")] * 8, "x"), (404, [float("inf")] * 8, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").persist()


def whole(vectors):
    return {r.vec_id: np.array(r.embedding) for r in vectors.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}


def test_top_k(vectors):
    known = {i: np.floor(256 * x).astype(np.int64) for i, x in whole(vectors).items()}
    want = set()
    for q in [i for i in known if i % 50 == 0]:
        best = sorted(((-int(known[q] @ x), i) for i, x in known.items() if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in metric_tree.top_inner_products(vectors).collect()} == want
    assert metric_tree.top_inner_products(vectors.limit(0)).count() == 0
    assert metric_tree.top_inner_products(vectors.where("vec_id in (0, 50)")).count() == 2


def test_top_k_of_great_numbers(spark):
    rows = [(1e7, 1.0), (1e7, 0.0), (1.0, 2.0), (1.0, 0.5), (-3e7, 1e7), (3e12, 2.0), (0.0, 0.0)]
    vectors = spark.createDataFrame([(i, list(v), "x", 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, rank string, score int")
    known = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for v in rows]
    want = set()
    for q in range(len(rows)):
        scores = {i: min(max(sum(a * b for a, b in zip(known[q], w)), -2 ** 63), 2 ** 63 - 1) for i, w in enumerate(known) if i != q}
        want |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {tuple(r) for r in metric_tree.top_inner_products(vectors, every=1).collect()} == want
    assert (0, 2, 1, 6553600000000000000) in want or (0, 1, 1, 6553600000000000000) in want


def test_near_vectors(vectors, monkeypatch):
    known = {i: x / np.linalg.norm(x) for i, x in whole(vectors).items() if np.any(x)}
    want = classes(known, lambda a, b: a @ b >= 0.9)
    links = {i: sum(bool(x @ y >= 0.9) for j, y in known.items() if j != i) for i, x in known.items()}
    for tile in (512, 16):
        monkeypatch.setattr(near_vectors, "TILE", tile)
        got = {r.vec_id: r for r in near_vectors.near_vectors(vectors).collect()}
        assert len(got) == vectors.count()
        for i, r in got.items():
            assert (r.n_links, r.component_id, r.kept) == (links.get(i, 0), want.get(i, i), want.get(i, i) == i)
    assert near_vectors.near_vectors(vectors.limit(0)).count() == 0


def test_base_scores_and_held_out(docs):
    texts = {i: [m.lower() if m.isascii() else m for m in WORD.findall(t)] + [None] for i, t in by_id(docs).items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not out[i] for w in t)
    total, kinds = sum(count.values()), len(count)
    got = {r.doc_id: r for r in attention_lm.score_texts(docs).collect()}
    for i, t in texts.items():
        base = sum(np.log10((count[w] + 1) / (total + kinds + 1)) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(w in count for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert len(got) == len(texts) and attention_lm.score_texts(docs.limit(0)).count() == 0


def test_attention_gradients_and_windows():
    model = attention_lm.Model(np.arange(60.0)[::-1])
    counts, end = np.array([0, 5, 40]), 59
    ids = np.random.default_rng(0).integers(0, 59, 45)
    x, y, fresh, text = attention_lm.windows(attention_lm.layout(counts, ids, end), end)
    assert fresh.sum() == (counts + 1).sum()                   # each subword and end once
    assert np.array_equal(np.concatenate([y[text == t][fresh[text == t]] for t in range(3)]), np.insert(ids, [0, 5, 45], end))
    _, g, _, _ = model.gradients(x, y, fresh)
    for name, at in (("q", (1, 2)), ("o", (0, 3)), ("h", (4, 5)), ("s", (2, 1)), ("m", (3, 1))):
        old, loss = model.p[name][at], []
        for step in (1e-2, -1e-2):
            model.p[name][at] = old + step
            loss.append(model.gradients(x, y, fresh)[0])
        model.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 2e-3
    logs = model.log_classes(model.forward(x)[-1])
    inner = model.log_within(model.forward(x)[-1].reshape(-1, attention_lm.HIDDEN), y.ravel()).reshape(y.shape)
    slow = np.zeros(3)
    for i in range(len(x)):
        slow[text[i]] += sum(logs[i, k, model.of[y[i, k]]] + inner[i, k] for k in range(x.shape[1]) if fresh[i, k])
    assert np.allclose(model.score(counts, ids, end) * np.log(10), slow, atol=1e-2)


def test_all_windows_are_learnt_from(spark, monkeypatch):
    """Long texts alone teach the model the order of their words, in every batch of every file."""
    words = [f"w{chr(97 + i)}{chr(107 + i % 13)}" for i in range(20)]
    text = " ".join(words * 130)
    assert len(text) > attention_lm.FIT_BYTES
    found = []
    learn = attention_lm.learn
    monkeypatch.setattr(attention_lm, "learn", lambda *a: found.append(learn(*a)) or found[-1])
    monkeypatch.setattr(attention_lm, "FILES", 2)
    rows = spark.createDataFrame([(i, text) for i in range(150)], "doc_id long, text string").repartition(3)
    got = attention_lm.score_texts(rows).where("held_out").collect()
    assert min(r.score / r.n_tokens for r in got) > -0.8       # a word's share of all is about -1.3
    encoder, end = attention_lm.encoding()
    n, ids = attention_lm.subwords(encoder, [text.encode()])
    each = len(attention_lm.layout(n, ids, end)[3])
    assert found[0][1] == each * (150 - len(got))


def test_sender_holds_few_arrays_of_a_batch():
    """A batch of texts takes less than 14 times its bytes (9.7 measured, 23 when words were sorted whole and rows kept)."""
    rng = np.random.default_rng(1)
    words = np.array([f"{chr(97 + i % 26)}{i:x}" for i in range(3000)])
    texts = [" ".join(words[rng.integers(0, 3000, 1500)]) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([i % 7 == 2 for i in range(600)]), pa.array(texts)], ["doc_id", "held_out", "text"])
    list(attention_lm._sender(5)(iter([batch.slice(0, 5)])))    # tables that stay
    tracemalloc.start()
    sent = [(r.column("bucket")[0].as_py(), len(r)) for r in attention_lm._sender(5)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == [(k, 1) for k in range(5)]
    assert peak < 14 * sum(map(len, texts))


def test_segments_are_forgotten(monkeypatch):
    encoder, end = attention_lm.encoding()
    texts = [" ".join(f"word{(i * 7 + k) % 90}\n" for k in range(40)).encode() for i in range(12)]
    whole = attention_lm.subwords(encoder, texts)
    assert bytes(encoder.decode_bytes(whole[1].tolist())) == b"".join(texts)
    for limit in (1, 20, 1000):
        monkeypatch.setattr(attention_lm, "SEGMENTS", limit)
        known = attention_lm.Segments(encoder)
        parts = [attention_lm.subwords(encoder, texts[a:a + 2], known) for a in range(0, 12, 2)]
        for k in (0, 1):
            assert np.array_equal(np.concatenate([x[k] for x in parts]), whole[k])


def test_gradients_of_small_classes_taken_together(monkeypatch):
    """Blocks of classes, classes alone and logits too large for exp give the same slopes as the plain sums."""
    rng = np.random.default_rng(5)
    counts, end, large = np.array([3, 60, 0, 200]), 399, 20
    ids = rng.integers(0, 399, counts.sum())
    x, y, fresh, _ = attention_lm.windows(attention_lm.layout(counts, ids, end), end)
    found = []
    for together in (0, 24, 10 ** 6):
        monkeypatch.setattr(attention_lm, "TOGETHER", together)
        model = attention_lm.Model(np.arange(400.0)[::-1] ** 2)
        assert (len(model.blocks) < len(model.alone)) == bool(together)
        model.p["m"][:] = np.random.default_rng(6).standard_normal(model.p["m"].shape) * 0.1
        found.append(model.gradients(x, y, fresh))
        t = model.forward(x)[-1].reshape(-1, attention_lm.HIDDEN)[np.flatnonzero(fresh)]
        goal = y.ravel()[np.flatnonzero(fresh)]
        plain = model.log_classes(t)[np.arange(len(goal)), model.of[goal]] + model.log_within(t, goal)
        assert abs(found[-1][0] + plain.mean()) < 1e-4
    for loss, g, rows, de in found[1:]:
        assert abs(loss - found[0][0]) < 1e-5 and np.array_equal(rows, found[0][2]) and np.allclose(de, found[0][3], atol=1e-6)
        assert all(np.allclose(g[k], found[0][1][k], atol=1e-5) for k in g)
    for name in "qkwm":
        model.p[name] *= np.float32(large)                      # some logits are beyond 80
    loss, g, _, de = model.gradients(x, y, fresh)
    t = model.forward(x)[-1].reshape(-1, attention_lm.HIDDEN)[np.flatnonzero(fresh)]
    plain = model.log_classes(t)[np.arange(len(goal)), model.of[goal]] + model.log_within(t, goal)
    assert np.isfinite(loss) and abs(loss + plain.mean()) < 1e-3 * abs(plain.mean()) and np.isfinite(de).all()
    assert all(np.isfinite(v).all() for v in g.values())


@pytest.mark.parametrize("name", ["op7_url_filters", "op10_mixing_sources"])
def test_sql_twins(name, spark, duck, sf):
    text, ok, _ = oracle.compare(spark, duck, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert ok, text


def test_urls(spark):
    rows = [(1, None), (2, "no host"), (3, "http://EXAMPLE.org/es/1"), (4, "x://example.org/en/12?q"), (5, "a://b.example.org"), (6, "a://notexample.com/de/"), (7, "a://com/fr/x#y"), (8, "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_pages(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == got[2][:3] == got[8][:3] == ("", "", None)
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][1:3] == ("", None) and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert url_reputation.judge_pages(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mixing_limits(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0) for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_pieces_round_trip(docs, spark):
    odd = spark.createDataFrame([(1, " \u2581a  b\n\n\t\U0001F600<s><0x41>é"), (None, "x y"), (1, " \u2581a  b\n\n\t\U0001F600<s><0x41>é")], "doc_id long, text string")
    for data in (docs, odd):
        rows = pieces.encode_texts(data).collect()
        assert sorted(r.text_sha256 for r in rows) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in data.collect())
        assert all(r.n_pieces == len(r.pieces) for r in rows)
    back = pieces.decode_pieces(pieces.encode_texts(docs)).collect()
    assert {r.doc_id: r.text for r in back} == by_id(docs)
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    vocabulary = pieces.Vocabulary(pieces.model_path())
    text = " the quick brown fox jumps over lazy dogs"
    assert pieces.encode_batch(vocabulary, np.array([1]), [text.encode()], 0.0)[1].tolist() == library.encode(text.strip())


def test_toxicity(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id)
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3 and (held[held.predicted == 1].toxic == 1).mean() > 0.8
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.0}
