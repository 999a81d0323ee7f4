"""Pieces of a merge-type sentence-piece vocabulary with seeded merge dropout.

Texts are cut where no piece can cross (before blanks, around line ends). A segment merges the
best-scored candidate of its agenda again and again; a keyed hash of the document, the segment's
place in it and the candidate's span skips candidates for good. Every different segment of a
batch is merged once without skips. An occurrence whose hash skips none of the merges made there
has those pieces; every other one is merged by itself. Characters outside the vocabulary, and
the vocabulary's own mark for a blank, become byte pieces, so every text decodes to itself.

Short segments advance together, one merge each in a step. A long one, as of a line without
blanks, has a heap of candidates and links between neighbours.
"""
from __future__ import annotations

import hashlib
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from tidegauge.llm.words import U, as_bytes, mix, pieces as ranges, span_hashes

MODEL = "piece_bpe_32k.model"    # among the public tokenizers of the machine
DROPOUT = 0.1                    # share of candidate merges that are skipped
LONG = 96                        # symbols from which a segment has an agenda of its own
SEED = 20
CHUNK_BYTES = 1 << 20            # of texts encoded at once
MARK = "▁"                  # a blank in pieces
NEVER = np.int64(1) << 40
SLOT_BITS = 20                   # of the table of pairs
NONE = np.int64(1) << 22         # beyond every rank


def begins(at, owner, end):
    """Where some symbols begin in their spans."""
    return np.where((at > 0) & (owner[at - 1] == owner[at]), end[at - 1], 0)


def skipped(keys, begin, ends, dropout):
    """Whether the coin of each candidate skips it."""
    return mix(keys + (begin.astype(U) << U(32)) + ends.astype(U)) >> U(32) < U(int(dropout * (1 << 32)))


def skipped_one(key, begin, end, dropout):
    """The same for one candidate, in plain integers."""
    whole = (1 << 64) - 1
    h = (key + (begin << 32) + end) & whole
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & whole
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & whole
    h ^= h >> 31
    return h >> 32 < int(dropout * (1 << 32))


def model_path(name=MODEL):
    import public_tokenizers
    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces as bytes, characters with a piece, and the pairs of pieces that merge."""

    def __init__(self, path):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        self.byte_id = np.zeros(256, np.int64)
        raw = [b""] * size
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:-1], 16)
                self.byte_id[value], raw[i] = i, bytes([value])
            elif plain[i]:
                raw[i] = name.replace(MARK, " ").encode()
        ids = {names[i]: i for i in range(size) if plain[i]}
        chars = sorted((int.from_bytes(c.replace(MARK, " ").encode(), "big"), i) for c, i in ids.items() if len(c) == 1)
        self.char_key, self.char_id = (np.array(x, np.int64) for x in zip(*chars))
        self.ascii_id = np.full(128, -1)
        self.ascii_id[self.char_key[self.char_key < 128]] = self.char_id[self.char_key < 128]
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        merges = sorted(((ids[name[:k]] << 20) | ids[name[k:]], i) for name, i in ids.items()
                        for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids)
        self.pair_key = np.array([m[0] for m in merges], np.int64)
        self.pair_id = np.array([m[1] for m in merges], np.int64)
        self.pair_rank = np.array([rank[m[1]] for m in merges], np.int64)
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)         # one pair of each slot; the rest is searched for
        at = self.slots(self.pair_key)
        self.slot[at] = np.arange(len(at))
        rest = self.slot[at] != np.arange(len(at))
        self.rest = np.flatnonzero(rest)
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[at[rest]] = True
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def slots(self, key):
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - SLOT_BITS)).view(np.int64)

    def found(self, key):
        """Which of some pairs merge, and their numbers."""
        at = self.slots(key)
        i = self.slot[at]
        fits = self.pair_key[i] == key
        more = np.flatnonzero(~fits & self.crowded[at])
        if len(more):
            keys = self.pair_key[self.rest]
            k = np.minimum(np.searchsorted(keys, key[more]), len(keys) - 1)
            hit = keys[k] == key[more]
            i[more[hit]], fits[more[hit]] = self.rest[k[hit]], True
        fits = np.flatnonzero(fits)
        return fits, i[fits]

    def symbols(self, data, starts, ends):
        """First pieces of each span: segment, piece and end of each within its segment."""
        n = ends - starts
        head = np.cumsum(n) - n
        at = np.repeat(starts - head, n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(starts)), n)
        body = data[at]
        lead = np.flatnonzero((body & 0xC0) != 0x80)
        width = np.diff(np.concatenate([lead, [len(body)]]))
        key = np.zeros(len(lead), np.int64)
        for k in range(4):
            more = k < width
            key[more] = (key[more] << 8) | body[lead[more] + k]
        char = self.ascii_id[np.where(width == 1, key & 127, 0)]
        more = np.flatnonzero((width > 1) & (key != int.from_bytes(MARK.encode(), "big")))
        i = np.minimum(np.searchsorted(self.char_key, key[more]), len(self.char_key) - 1)
        char[width > 1] = -1
        char[more] = np.where(self.char_key[i] == key[more], self.char_id[i], -1)
        char[(width == 1) & (key > 127)] = -1
        known = char >= 0
        taken = np.repeat(known, width)
        piece = self.byte_id[body]
        piece[lead[known]] = char[known]
        first = np.zeros(len(body), bool)
        first[lead] = True
        keep = first | ~taken
        spot = np.flatnonzero(keep)
        end = np.concatenate([spot[1:], [len(body)]]) - head[owner[spot]]
        return owner[spot], piece[spot], end

    def segment(self, data, starts, ends, keys=None, dropout=0.0):
        """Pieces of each span and merges made in it: numbers, and all of them in order; merges as begins and ends.

        ``keys`` give the coins of each span's candidates; without them none is skipped.
        """
        owner, piece, end = self.symbols(data, starts, ends)
        size = np.bincount(owner, minlength=len(starts))
        long = np.flatnonzero(size >= LONG)
        own = [(owner, piece, end)]
        merged = []
        if len(long):
            apart = np.isin(owner, long)
            own[0] = (owner[~apart], piece[~apart], end[~apart])
            first = np.cumsum(size) - size
            for k in long.tolist():
                part = slice(first[k], first[k] + size[k])
                kept, made = self.agenda(piece[part].tolist(), end[part].tolist(), None if keys is None else int(keys[k]), dropout)
                own.append((np.full(len(kept), k), np.array(kept), None))
                merged.append((np.full(len(made[0]), k), *(np.array(x, np.int64) for x in made)))
        owner, piece = self._together(len(starts), *own[0], keys, dropout, merged)
        owner, piece = np.concatenate([owner, *(x[0] for x in own[1:])]), np.concatenate([piece, *(x[1] for x in own[1:])])
        order = np.argsort(owner, kind="stable")
        of, begin, until = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*merged)) or [[], [], []]))
        by_span = np.argsort(of, kind="stable")
        return (np.bincount(owner, minlength=len(starts)), piece[order]), (np.bincount(of, minlength=len(starts)), begin[by_span], until[by_span])

    def candidates(self, at, owner, piece, end, keys, dropout):
        """Rank and piece of the pairs that begin at some symbols; NONE where none merges or its coin skips it."""
        rank, new = np.full(len(at), NONE), np.zeros(len(at), np.int64)
        follows = np.flatnonzero(at + 1 < len(piece))
        follows = follows[owner[at[follows]] == owner[at[follows] + 1]]
        left = at[follows]
        key = (piece[left] << 20) | piece[left + 1]
        fits, i = self.found(key)
        left, follows = left[fits], follows[fits]
        if keys is not None:
            stays = ~skipped(keys[owner[left]], begins(left, owner, end), end[left + 1], dropout)
            i, follows = i[stays], follows[stays]
        rank[follows], new[follows] = self.pair_rank[i], self.pair_id[i]
        return rank, new

    def _together(self, n, owner, piece, end, keys, dropout, merged):
        """One merge of each span in a step, the best of its candidates, ties to the left."""
        done_owner, done_piece = [], []
        rank, new = self.candidates(np.arange(len(piece)), owner, piece, end, keys, dropout)
        while len(piece):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank * NEVER + np.arange(len(piece)), first)
            some = best < NONE * NEVER
            best = best[some] % NEVER
            keep = np.repeat(some, np.diff(np.concatenate([first, [len(piece)]])))
            if not some.all():
                done_owner.append(owner[~keep])
                done_piece.append(piece[~keep])
            merged.append((owner[best], begins(best, owner, end), end[best + 1]))
            piece[best], end[best] = new[best], end[best + 1]
            keep[best + 1] = False
            place = np.cumsum(keep)[best] - 1
            owner, piece, end, rank, new = owner[keep], piece[keep], end[keep], rank[keep], new[keep]
            before = place[place > 0] - 1                       # the pairs on both sides of a merge are other ones now
            both = np.concatenate([place, before[owner[before] == owner[before + 1]]])
            rank[both], new[both] = self.candidates(both, owner, piece, end, keys, dropout)
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_owner, done_piece))

    @cached_property
    def pairs(self):
        """Rank and piece of every pair that merges."""
        return dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_id.tolist())))

    def agenda(self, piece, end, key, dropout):
        """Pieces of one span, and the merges made, from a heap of candidates."""
        pairs, n = self.pairs, len(piece)
        begin, after, before = [0, *end[:-1]], list(range(1, n + 1)), list(range(-1, n - 1))
        made = ([], [])

        def found(lefts):
            """Candidates that begin at these symbols and are not skipped: rank, symbol, its piece and the next."""
            out = []
            for i in lefts:
                j = after[i]
                pair = pairs.get((piece[i] << 20) | piece[j]) if j < n else None
                if pair and (key is None or not skipped_one(key, begin[i], end[j], dropout)):
                    out.append((pair[0], i, piece[i], piece[j], pair[1]))
            return out
        heap = found(range(n))
        heapify(heap)
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if piece[i] != left or j >= n or piece[j] != right:
                continue                                        # one of the two has merged since
            made[0].append(begin[i])
            made[1].append(end[j])
            piece[i], piece[j], end[i] = new, -1, end[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for c in found([i] if before[i] < 0 else [before[i], i]):
                heappush(heap, c)
        return [p for p in piece if p >= 0], made

    def decode(self, ids):
        """Bytes of a sequence of pieces."""
        n = self.raw_size[ids]
        head = np.cumsum(n) - n
        return self.raw[np.repeat(self.raw_at[ids] - head, n) + np.arange(n.sum())]


def encode_batch(vocabulary, ids, texts, dropout=DROPOUT, seed=SEED):
    """Pieces of every text: their numbers, and all of them in order."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not len(data):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    blank, line = data == 0x20, data == 0x0A
    cut = np.ones(len(data), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    cut[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate([starts[1:], [len(data)]])
    text = np.searchsorted(offsets, starts, "right") - 1
    _, index, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    (counts, flat), (merges, since, until) = vocabulary.segment(data, starts[index], ends[index])
    begin, n = (np.cumsum(counts) - counts)[number], counts[number]
    if dropout:
        keys = mix(mix(ids.view(U) + U(seed))[text] + (starts - offsets[text]).astype(U))
        made = merges[number]
        head = np.cumsum(made) - made
        spot = np.repeat((np.cumsum(merges) - merges)[number] - head, made) + np.arange(made.sum())
        of = np.repeat(np.arange(len(starts)), made)
        own = np.unique(of[skipped(keys[of], since[spot], until[spot], dropout)])
        (more, tail), _ = vocabulary.segment(data, starts[own], ends[own], keys[own], dropout)
        begin[own], n[own] = len(flat) + np.cumsum(more) - more, more
        flat = np.concatenate([flat, tail])
    head = np.cumsum(n) - n
    pieces = flat[np.repeat(begin - head, n) + np.arange(n.sum())]
    return np.bincount(text, n, len(texts)).astype(np.int64), pieces


def _encoder(model, dropout, seed):
    def run(batches):
        vocabulary = Vocabulary(model_path(model))
        for batch in batches:
            ids = np.array([x or 0 for x in batch.column(0).to_pylist()], np.int64)
            texts = as_bytes(batch.column(1))
            for a, b in ranges(texts, CHUNK_BYTES):
                counts, pieces = encode_batch(vocabulary, ids[a:b], texts[a:b], dropout, seed)
                raw = vocabulary.decode(pieces).tobytes()
                ends = np.concatenate([[0], np.cumsum(counts)])
                total = np.concatenate([[0], np.cumsum(vocabulary.raw_size[pieces])])[ends]
                digest = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(total[:-1].tolist(), total[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts), lists, pa.array(digest)],
                                                 ["doc_id", "n_pieces", "pieces", "text_sha256"])
    return run


def encode_texts(docs, model=MODEL, dropout=DROPOUT, seed=SEED):
    """Pieces of every text: doc_id, n_pieces, pieces, text_sha256 (of what they decode to).

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null texts count as empty
    and have no pieces. A null doc_id keys the dropout as 0. Rows with one doc_id and text get
    the same pieces, so reruns agree; every occurrence of a segment has coins of its own. An
    empty table gives an empty result. The time of a segment without blanks is n log n.
    """
    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoder(model, dropout, seed), "doc_id long, n_pieces long, pieces array<int>, text_sha256 string")


def decode_pieces(encoded, model=MODEL):
    """Texts of ``encode_texts``' rows: doc_id, text."""
    def run(batches):
        vocabulary = Vocabulary(model_path(model))
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([vocabulary.decode(np.array(r or [], np.int64)).tobytes().decode() for r in rows], pa.string())],
                ["doc_id", "text"])
    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
