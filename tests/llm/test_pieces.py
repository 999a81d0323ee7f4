"""Merges with dropout against a slow merge of every occurrence."""
import random
import time

import numpy as np
import pytest

from tidegauge.llm import pieces
from tidegauge.llm.words import U, mix


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.model_path())


def slow_merge(vocabulary, segment, key, dropout):
    data = np.frombuffer(segment, np.uint8)
    _, piece, end = vocabulary.symbols(data, np.array([0]), np.array([len(data)]))
    piece, end = piece.tolist(), end.tolist()
    begin = [0, *end[:-1]]
    while True:
        found = [(vocabulary.pairs[pair][0], i, vocabulary.pairs[pair][1]) for i in range(len(piece) - 1)
                 for pair in [(piece[i] << 20) | piece[i + 1]]
                 if pair in vocabulary.pairs and not pieces.skipped_one(key, begin[i], end[i + 1], dropout)]
        if not found:
            return piece
        _, i, new = min(found)
        piece[i:i + 2], end[i:i + 2], begin[i:i + 2] = [new], [end[i + 1]], [begin[i]]


def segments(text):
    out, at = [], 0
    for i in range(1, len(text)):
        if (text[i] == 32 and text[i - 1] != 32) or text[i] == 10 or text[i - 1] == 10:
            out.append((at, text[at:i]))
            at = i
    return out + [(at, text[at:])] if text else []


def slow_encode(vocabulary, doc_id, text, dropout, seed=pieces.SEED):
    base = mix(np.array([doc_id], np.int64).view(U) + U(seed))
    return [p for at, s in segments(text) for p in slow_merge(vocabulary, s, int(mix(base + np.array([at], U))[0]), dropout)]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9])
def test_every_occurrence_has_its_own_coins(vocabulary, dropout):
    rng = random.Random(4)
    words = ["the", "quickly", "internationalisation", "été", "Ünder", "a", "wordswithoutblanks" * 8, "0x3fA9", "▁", "日本語テキスト", "running"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))).encode() for _ in range(12)] + [b"", b"\n\n", b"  x ", ("ab" * 200).encode(), b"the the the the the the"]
    ids = np.array([*range(len(texts) - 1), 1 << 62], np.int64)
    counts, flat = pieces.encode_batch(vocabulary, ids, texts, dropout)
    ends = np.cumsum(counts)
    for i, t in enumerate(texts):
        assert flat[ends[i] - counts[i]:ends[i]].tolist() == slow_encode(vocabulary, int(ids[i]), t, dropout), t
    assert vocabulary.decode(flat).tobytes() == b"".join(texts)


def test_agenda_and_steps_agree(vocabulary, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 300))).encode() for _ in range(30)]
    ids = np.arange(30)
    want = pieces.encode_batch(vocabulary, ids, texts, 0.2)[1].tolist()
    for long in (1, 10 ** 6):
        monkeypatch.setattr(pieces, "LONG", long)
        assert pieces.encode_batch(vocabulary, ids, texts, 0.2)[1].tolist() == want


def test_one_segment_has_many_forms(vocabulary):
    text = b" internationalisation" * 400
    counts, flat = pieces.encode_batch(vocabulary, np.array([3]), [text], 0.1)
    text_pieces, at, forms = flat.tolist(), 0, set()
    for _ in range(400):
        size, form = 0, []
        while size < 21:
            form.append(text_pieces[at])
            size += int(vocabulary.raw_size[text_pieces[at]])
            at += 1
        forms.add(tuple(form))
    assert len(forms) > 8


def test_a_megabyte_without_blanks(vocabulary):
    rng = random.Random(6)
    text = "".join(rng.choice("ABCDEFGHIJabcdefghij0123456789+/") for _ in range(1 << 20)).encode()
    start = time.perf_counter()
    _, flat = pieces.encode_batch(vocabulary, np.array([1]), [text])
    assert time.perf_counter() - start < 60
    assert vocabulary.decode(flat).tobytes() == text
