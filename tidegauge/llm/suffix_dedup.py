"""Passages repeated across documents, found with run-length compressed indexes.

Every 50-byte string has an anchor, the leftmost 16-byte string of least hash in it, so equal
strings have equal anchors. Anchors that only one document has are dropped; stretches around
the others go to the bucket of their anchor. There a Burrows-Wheeler transform of the distinct
stretches, ordered by contexts of 50 bytes with earlier documents first, is kept as runs, with
samples at the heads of repeated contexts. The stretches are streamed through it from right to
left; where 50 bytes match, the sample names the first document that has them.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm.words import U, as_bytes, mix, pack, pieces, span_hashes, unpack

LENGTH = 50                      # bytes of a repeated string
ANCHOR = 16                      # bytes of an anchor
STARTS = LENGTH - ANCHOR + 1     # places of an anchor in a string
BUSY = 24                        # blocks from which an anchor counts as common and is split by context
CONTEXT = 8                      # bytes of that context
BLOCK_BYTES = 16 << 20
INDEX_BYTES = 1 << 19            # of one index; only a single anchor's stretches may exceed it


def squeeze(*arrays):
    raw = pack(*arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob, *dtypes):
    return unpack(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), *dtypes)


def anchor_order(data):
    """32-bit hash of the 16 bytes from every place."""
    h = (data.astype(np.uint32) + np.uint32(7)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    n = 1
    while n < ANCHOR:
        h = h[:-n] * np.uint32(0x85EBCA6B) + h[n:]
        h ^= h >> np.uint32(14)
        n *= 2
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def byte_hash(data, at, size):
    """64-bit hash of ``size`` (a multiple of 8) bytes from each place."""
    out = np.full(len(at), size, U)
    for a in range(0, size, 8):
        word = np.zeros(len(at), U)
        for k in range(8):
            word |= data[at + (a + k)].astype(U) << U(8 * k)
        out = mix(out * U(0x9FB21C651E98DF25) + word)
    return out


def stretches(texts):
    """Runs of starts that share an anchor, for one piece of texts.

    Returns the joined bytes, each text's offset, and per run: text, first and last start, anchor.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, offsets, none, none, none, none
    low = (anchor_order(data).astype(U) << U(32)) | np.arange(len(data) - ANCHOR + 1, dtype=U)
    n = 1
    while 2 * n <= STARTS:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < STARTS:
        low = np.minimum(low[:-(STARTS - n)], low[STARTS - n:])
    place = (low & U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int8)
    long = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    head = np.flatnonzero(new)
    first, last = head, np.concatenate([head[1:], [len(place)]]) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    text = np.searchsorted(offsets, first, "right") - 1
    return data, offsets, text, first, last, place[first]


def split_hashes(hashes, buckets):
    """Order of the distinct hashes by bucket, where each bucket ends, and each hash's number in sorted order."""
    order = np.argsort(hashes)
    value = hashes[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    number = np.empty(len(value), np.int64)
    number[order] = np.cumsum(new) - 1
    bucket = ((value[new] >> U(40)) % U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1)), number


def sorted_block(table):
    """Ids and texts of a block, in an order that does not depend on arrival."""
    ids = table.column("doc_id").to_numpy()
    texts = as_bytes(table.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def block_anchors(key, table, buckets):
    """The distinct anchors of a block, by bucket, and whether two of its documents have them."""
    ids, texts = sorted_block(table)
    seen, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in pieces(texts):
        data, _, text, _, _, place = stretches(texts[a:b])
        seen.append(byte_hash(data, place, ANCHOR))
        owner.append(ids[a:b][text])
    seen, owner = np.concatenate(seen), np.concatenate(owner)
    order = np.argsort(seen)
    seen, owner = seen[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(seen) else np.zeros(0, np.int64)
    two = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head) if len(head) else np.zeros(0, bool)
    hashes, two_of = seen[head], two
    bucket = ((hashes >> U(40)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    hashes, two_of, ends = hashes[order], two_of[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(k, pack(hashes[a:b].astype(np.uint32), ((hashes[a:b] >> U(32)) & U(255)).astype(np.uint8), np.packbits(two_of[a:b])))
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blk": pa.array([key] * len(rows), pa.int32()),
                     "blob": pa.array([r[1] for r in rows], pa.binary())})


def shared_anchors(table):
    """For every block of a bucket, which of its anchors two documents have and which are common."""
    blocks, lows, highs, twos = table.column("blk").to_numpy(), [], [], []
    for blob in table.column("blob").to_pylist():
        low, high, two = unpack(blob, np.uint32, np.uint8, np.uint8)
        lows.append(low.astype(U) | (high.astype(U) << U(32)))
        twos.append(np.unpackbits(two)[:len(low)])
    sizes = [len(x) for x in lows]
    keys, two = np.concatenate(lows), np.concatenate(twos)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    holders = np.bincount(group)
    within = np.bincount(group, two) > 0
    shared, busy = ((holders > 1) | within)[group], (holders >= BUSY)[group]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blobs = [pack(np.packbits(shared[a:b]), np.packbits(busy[a:b])) for a, b in zip(ends[:-1], ends[1:])]
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"blk": pa.array(blocks, pa.int32()), "kind": pa.array([0] * len(blobs), pa.int32()),
                     "bucket": pa.array([bucket] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def block_stretches(texts, marks, buckets):
    """The stretches of a block around shared anchors, common ones split by what lies beside them.

    ``marks``: blob of shared_anchors by bucket. Yields per piece the range of texts, their bytes
    and offsets, and per stretch: text, first start, last start, key.
    """
    kept = []
    for a, b in pieces(texts):
        data, offsets, text, first, last, place = stretches(texts[a:b])
        kept.append((a, b, data, offsets, text, first, last, place, byte_hash(data, place, ANCHOR)))
    everything = np.concatenate([k[-1] for k in kept]) if kept else np.zeros(0, U)
    by, ends, number = split_hashes(everything, buckets)
    flags = np.zeros(len(by), np.int8)
    for k, blob in marks.items():
        shared, busy = unpack(blob, np.uint8, np.uint8)
        m = ends[k + 1] - ends[k]
        flags[by[ends[k]:ends[k + 1]]] = np.unpackbits(shared)[:m] + np.unpackbits(busy)[:m]
    flags = flags[number]
    at = 0
    for a, b, data, offsets, text, first, last, place, own in kept:
        flag = flags[at:at + len(own)]
        at += len(own)
        plain, busy = flag == 1, flag == 2
        t, f, z, p = text[busy], first[busy], last[busy], place[busy]
        edge = p - (LENGTH - ANCHOR - CONTEXT)                   # starts from here on hold the bytes after the anchor
        left, right = f < edge, z >= edge
        parts = [(text[plain], first[plain], last[plain], own[plain]),
                 (t[left], f[left], np.minimum(z, edge - 1)[left], byte_hash(data, p[left] - CONTEXT, ANCHOR + CONTEXT) ^ U(1)),
                 (t[right], np.maximum(f, edge)[right], z[right], byte_hash(data, p[right], ANCHOR + CONTEXT))]
        yield a, b, data, offsets, *(np.concatenate(c) for c in zip(*parts))


def distinct_stretches(texts, marks, anchor_buckets, buckets, with_bytes):
    """Pieces as above, and the block's distinct stretches by bucket, with their bytes if asked for.

    Every stretch gets its number among the distinct ones, whose first holder is the earliest
    text. Returns (pieces with numbers, sizes, keys, holders, bytes, bucket ends).
    """
    got, code, size, key, holder, where = [], [], [], [], [], []
    for a, b, data, offsets, text, first, last, own in block_stretches(texts, marks, anchor_buckets):
        got.append([a, b, data, offsets, text, first, last])
        code.append(span_hashes(data, first, last + LENGTH) ^ mix(own))
        size.append(last + LENGTH - first)
        key.append(own)
        holder.append(text + a)
        where.append(first)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)      # noqa: E731
    code, sizes, keys, holders = cat(code, U), cat(size, np.int64), cat(key, U), cat(holder, np.int64)
    _, index, number = np.unique(code, return_index=True, return_inverse=True)
    bucket = (mix(keys[index]) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    number, index = turn[number], index[order]
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    at = 0
    pulled = np.empty(len(index) if with_bytes else 0, object)
    for piece, s, w in zip(got, size, where):
        n = len(s)
        piece.append(number[at:at + n])
        at += n
        if not with_bytes:
            continue
        mine = np.flatnonzero((index >= at - n) & (index < at))
        raw = piece[2].tobytes()
        for i, f, m in zip(mine.tolist(), w[index[mine] - at + n].tolist(), s[index[mine] - at + n].tolist()):
            pulled[i] = raw[f:f + m]
    return got, sizes[index], keys[index], holders[index], pulled, ends


def rank_pairs(first, second, bits):
    """Dense ranks of pairs of ranks, and the order of the pairs, ties by place."""
    n = len(first)
    width = max(int(second.max()) + 1, 1).bit_length()
    top = max(int(first.max()) + 1, 1).bit_length()
    if top + width + bits <= 64:
        packed = np.sort((((first.astype(U) << U(width)) | second.astype(U)) << U(bits)) | np.arange(n, dtype=U))
        order, value = (packed & U((1 << bits) - 1)).astype(np.int64), packed >> U(bits)
        new = np.concatenate([[False], value[1:] != value[:-1]])
    else:
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


class RunIndex:
    """Run-length compressed transform of strings given in the order of their documents."""

    def __init__(self, strings, sizes, docs):
        data = np.frombuffer(b"".join(strings), np.uint8)
        letters, dense = np.unique(data, return_inverse=True)
        n = len(data) + len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        symbols = np.zeros(n, np.uint16)                        # 0 ends a string
        body = np.ones(n, bool)
        body[starts + sizes] = False
        symbols[body] = dense + 1
        self.symbols, self.starts, self.sizes, self.docs, self.n = symbols, starts, sizes, docs, n
        self.width = len(letters) + 1
        order = self._sorted()
        self.doc_of = np.repeat(docs, sizes + 1)
        before = symbols[order - 1]
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        run, length = before[head].astype(np.int64), np.diff(np.concatenate([head, [n]]))
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=self.width))])
        # an empty run at row 0 for every symbol, so that each step finds a run of its symbol
        run, head, length = (np.concatenate(x) for x in ((np.arange(self.width), run), (np.zeros(self.width, np.int64), head),
                                                         (np.zeros(self.width, np.int64), length)))
        by = np.argsort(run.astype(np.uint16), kind="stable")
        run, head, length = run[by], head[by], length[by]
        # runs are ordered by symbol, so the rows before a run, of smaller symbols included, are its target
        target = np.cumsum(length) - length
        self.kind = np.int32 if self.width * (n + 1) < 1 << 31 else np.int64
        self.run_key = (run * (n + 1) + head).astype(self.kind)
        self.run_shift, self.run_end = (target - head).astype(self.kind), (target + length).astype(self.kind)

    def _sorted(self):
        """Rows ordered by 50 symbols, ties by place; keeps heads of contexts of 49 and samples of 50."""
        n, bits = self.n, int(self.n).bit_length()
        rank, depth = self.symbols.astype(np.int64), 1
        order = None
        size = self.width.bit_length()
        while (depth + 1) * size + bits <= 63 and depth < 8:
            depth += 1
        packed = np.zeros(n, np.int64)
        for k in range(depth):
            packed <<= size
            packed[:n - k] |= self.symbols[k:]
        _, rank = np.unique(packed, return_inverse=True) if depth * size + bits > 63 else (None, self._dense(packed, bits))
        while depth < LENGTH:
            step = min(depth, LENGTH - depth)
            behind = np.zeros(n, np.int64)
            behind[:n - step] = rank[step:]
            short = LENGTH - 1 - depth                          # the same ranks, one symbol short of a string
            last = rank
            rank, order = rank_pairs(rank, behind, bits)
            depth += step
        tail = np.zeros(n, np.int64)
        tail[:n - short] = last[short:]
        a, b = last[order], tail[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        kind = np.int32 if n < 1 << 30 else np.int64
        self.group = np.cumsum(new, dtype=kind) - kind(1)
        self.group_head = np.concatenate([np.flatnonzero(new), [n]]).astype(kind)
        full = rank[order]
        head = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
        repeated = np.diff(np.concatenate([head, [n]])) > 1
        self.sampled, self.sample = head[repeated].astype(kind), order[head[repeated]]
        return order

    @staticmethod
    def _dense(packed, bits):
        values = np.sort((packed.astype(U) << U(bits)) | np.arange(len(packed), dtype=U))
        order, value = (values & U((1 << bits) - 1)).astype(np.int64), values >> U(bits)
        rank = np.empty(len(packed), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
        return rank

    def target(self, key, row):
        """Row that stepping back leads to: smaller rows, and the symbol's occurrences before ``row``.

        ``key``: symbol * (n + 1) + row.
        """
        i = np.searchsorted(self.run_key, key, "right") - 1
        return np.minimum(self.run_shift[i] + row, self.run_end[i])

    def first_documents(self):
        """For each place of the indexed strings, the first document with the 50 bytes from there.

        All strings stream from right to left at once, in the order of their rows, which a stable
        sort by the next symbol keeps: contexts are equally long, so their rows are the same or
        apart. A match of 50 is cut to 49 by widening its rows before it grows again. The strings
        are indexed themselves, so a lone row stays one. -1 where no other place has the bytes or
        none start.
        """
        out = np.full(self.n, -1, np.int64)
        at = self.starts + self.sizes - 1
        last = self.starts
        low, high = np.zeros(len(at), self.kind), np.full(len(at), self.n, self.kind)
        group, group_head = self.group, self.group_head
        t = 0
        while len(at):
            if t >= LENGTH:
                g = group[low]
                low, high = group_head[g], group_head[g + 1]
            symbol = self.symbols[at]
            turn = np.argsort(symbol, kind="stable")
            at, last, low, high = at[turn], last[turn], low[turn], high[turn]
            base = symbol[turn].astype(self.kind) * self.kind(self.n + 1)
            wide = np.flatnonzero(high - low > 1)
            top = high[wide]
            low = self.target(base + low, low)
            high = low + self.kind(1)
            high[wide] = self.target(base[wide] + top, top)
            if t >= LENGTH - 1:
                many = wide[high[wide] - low[wide] > 1]
                i = np.searchsorted(self.sampled, low[many])
                out[at[many]] = self.doc_of[self.sample[i]]
                live = at > last
                if not live.all():
                    at, last, low, high = at[live], last[live], low[live], high[live]
            at = at - 1
            t += 1
        return out


def index_bucket(table):
    """Flags of every block's stretches: the starts whose string an earlier document has."""
    blocks = table.column("blk").to_numpy()
    sizes, keys, docs, raws, codes, counts = [], [], [], [], [], []
    for blob in table.column("blob"):                           # one blob at a time: hashing takes many times its bytes
        s, k, d, raw = expand(blob.as_py(), np.uint8, U, np.int64, np.uint8)
        ends = np.cumsum(s, dtype=np.int64)
        sizes.append(s.astype(np.int64))
        keys.append(k)
        docs.append(d)
        raws.append(raw)
        codes.append(span_hashes(raw, ends - sizes[-1], ends) ^ mix(k))
        counts.append(len(s))
    sizes, keys, docs, code = (np.concatenate(x) for x in (sizes, keys, docs, codes))
    data = memoryview(np.concatenate(raws))
    del raws, codes
    at = np.concatenate([[0], np.cumsum(sizes)])
    order = np.lexsort((docs, code))
    new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    own = order[new]                                            # first holder of each distinct stretch
    by = np.lexsort((docs[own], keys[own]))
    place = np.empty(len(own), np.int64)
    place[by] = np.arange(len(own))
    number, own = place[number], own[by]
    key, size = keys[own], sizes[own]
    by_number = np.argsort(number, kind="stable")
    upto = np.searchsorted(number[by_number], np.arange(len(own) + 1))
    bits = np.zeros(len(number), U)
    ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1
    total = np.cumsum(size)
    a = 0
    while a < len(own):                                         # one index after the other, with all holders of its stretches
        goal = (total[a - 1] if a else 0) + INDEX_BYTES
        b = int(ends[max(np.searchsorted(ends, a, "right"), min(np.searchsorted(total[ends - 1], goal), len(ends) - 1))])
        part = a + np.argsort(docs[own[a:b]], kind="stable")
        strings = [data[x:y] for x, y in zip(at[own[part]].tolist(), at[own[part] + 1].tolist())]
        index = RunIndex(strings, size[part], docs[own[part]])
        starts = np.empty(b - a, np.int64)
        starts[part - a] = index.starts
        rows = by_number[upto[a]:upto[b]]
        which = number[rows]
        n = size[which] - LENGTH + 1
        head = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(head, n)
        first = index.first_documents()[np.repeat(starts[which - a], n) + inner]
        first = np.where(first < 0, np.repeat(docs[own[which]], n), first)     # no other place: the stretch's first holder
        flag = first < np.repeat(docs[rows], n)
        bits[rows] = np.bitwise_or.reduceat(flag.astype(U) << inner.astype(U), head)
        a = b
    cut = np.concatenate([[0], np.cumsum(counts)])
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"blk": pa.array(blocks, pa.int32()), "kind": pa.array([1] * len(blocks), pa.int32()),
                     "bucket": pa.array([bucket] * len(blocks), pa.int32()),
                     "blob": pa.array([squeeze(bits[x:y]) for x, y in zip(cut[:-1], cut[1:])], pa.binary())})


def _marks(table, kind):
    kinds, buckets, blobs = (table.column(c).to_pylist() for c in ("kind", "bucket", "blob"))
    return {b: x for k, b, x in zip(kinds, buckets, blobs) if k == kind}


def send_stretches(docs, marks, buckets):
    """The distinct stretches of a block as one blob for each of the index buckets, twice those of anchors."""
    ids, texts = sorted_block(docs)
    rows = []
    if marks.num_rows:
        _, sizes, keys, holders, strings, ends = distinct_stretches(texts, _marks(marks, 0), buckets // 2, buckets, True)
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if b > a:
                rows.append((k, squeeze(sizes[a:b].astype(np.uint8), keys[a:b], ids[holders[a:b]],
                                        np.frombuffer(b"".join(strings[a:b]), np.uint8))))
    key = docs.column("blk")[0].as_py() if docs.num_rows else 0
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blk": pa.array([key] * len(rows), pa.int32()),
                     "blob": pa.array([r[1] for r in rows], pa.binary())})


def cut_block(docs, marks, buckets, with_text):
    """Every document of a block without the bytes that earlier documents have."""
    ids, texts = sorted_block(docs)
    out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text_sha256")}
    got = []
    bits = np.zeros(0, U)
    holders = np.zeros(0, np.int64)
    if marks.num_rows:
        got, _, _, holders, _, ends = distinct_stretches(texts, _marks(marks, 0), buckets // 2, buckets, False)
        bits = np.zeros(len(holders), U)
        for k, blob in _marks(marks, 1).items():
            bits[ends[k]:ends[k + 1]] = expand(blob, U)[0]
    done = 0
    for a, b, data, offsets, text, first, last, number in got:
        n = last - first + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        later = ids[a:b][text] > ids[holders[number]]           # an earlier document of the block has it all
        flag = np.repeat(later, n) | (((np.repeat(bits[number], n) >> inner.astype(U)) & U(1)) > 0)
        starts = (np.repeat(first, n) + inner)[flag]
        depth = np.zeros(len(data) + 1, np.int32)
        depth[starts] += 1                                      # a start lies in one stretch only
        depth[starts + LENGTH] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        for i in range(a, b):
            s, e = offsets[i - a], offsets[i - a + 1]
            mask = gone[s:e]
            removed = int(mask.sum())
            kept = texts[i] if not removed else data[s:e][~mask].tobytes()
            spans = int(mask[:1].sum() + np.count_nonzero(mask[1:] & ~mask[:-1])) if removed else 0
            _append(out, ids[i], texts[i], removed, spans, kept, with_text)
        done = b
    for i in range(done, len(texts)):
        _append(out, ids[i], texts[i], 0, 0, texts[i], with_text)
    if not with_text:
        del out["kept_text"], out["text_sha256"]
    kinds = {"kept_sha256": pa.string(), "kept_text": pa.string(), "text_sha256": pa.string()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def _append(out, doc, text, removed, spans, kept, with_text):
    for k, v in (("doc_id", int(doc)), ("n_bytes", len(text)), ("n_removed", removed), ("n_spans", spans),
                 ("kept_sha256", hashlib.sha256(kept).hexdigest())):
        out[k].append(v)
    if with_text:
        out["kept_text"].append(kept.decode("utf-8", "ignore"))
        out["text_sha256"].append(hashlib.sha256(text).hexdigest())


def remove_repeats(docs, with_text=True, buckets=None):
    """Documents without each byte covered by a 50-byte string that a smaller doc_id also has.

    ``docs`` (``doc_id``, ``text``; other columns are ignored) as UTF-8 bytes, null as empty.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text, where
    characters cut in two are left out, and text_sha256 of the whole text. Rows with a null doc_id take no part; rows with the same
    doc_id do not cut each other. Texts under 50 bytes, and empty tables, lose nothing.

    Documents are shuffled once into blocks, an exchange that the three passes over them reuse.
    """
    spark = docs.sparkSession
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parts, -(-total // BLOCK_BYTES))
    docs = docs.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    blocks = docs.groupBy("blk")
    anchors = blocks.applyInArrow(lambda key, t: block_anchors(key[0].as_py(), t, parts), "bucket int, blk int, blob binary")
    row = "blk int, kind int, bucket int, blob binary"
    marks = anchors.groupBy("bucket").applyInArrow(shared_anchors, row)
    sent = blocks.cogroup(marks.groupBy("blk")).applyInArrow(
        lambda d, m: send_stretches(d, m, 2 * parts), "bucket int, blk int, blob binary")
    flags = sent.groupBy("bucket").applyInArrow(index_bucket, row)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, text_sha256 string" if with_text else "")
    return blocks.cogroup(marks.unionByName(flags).groupBy("blk")).applyInArrow(
        lambda d, m: cut_block(d, m, 2 * parts, with_text), schema)
