"""Texts scored by a causal self-attention model over subword ids, trained here in numpy.

The model predicts the class of the next subword from a window, and the subword within it.
Classes are ranges of frequency over all training texts; in those of many rare subwords the
subword follows its count alone. A first fit to some texts gives the values that fits of all tasks
to every window of all training texts start from; these are averaged round by round. Windows overlap so that every subword but the first few
has some context, and each is scored in one window only. Beside it, words are counted over all
training texts for an add-one baseline: words go to buckets with their places, and only sums by
document come back.
"""
from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidegauge.llm.words import LOWER, U, as_bytes, joined, mix, pack, pieces, span_hashes, unpack, word_hashes
from tidegauge.session import persist_plan, scratch

RANKS = "byte_bpe_multi_50k.tiktoken"
FIT_TEXTS = 1200                 # training texts of the first fit, in hashed order; all are learnt from after it
FIT_BYTES = 10000                # longer texts are not among them
WINDOW, STEP = 16, 12
WIDTH, HIDDEN, CLASSES = 16, 32, 64
TOGETHER = 24                    # members of small classes that a product takes together
MEMBERS = 512                    # subwords of a class that the model tells apart; larger classes by counts
STEPS, BATCH, PACE = 1500, 128, 0.03
FILES, PARTS = 16, 4             # files of a group of rounds, and its rounds, each with a part of every file's batches
LARGER, SLOWER = 512, 0.01       # as BATCH and PACE, in the rounds
SLAB = 1 << 15                   # windows shuffled together
BLOCK = 1 << 13                  # rows of parameters averaged together
SEED = 7
SCORED = 256                     # windows of a batch
TOLD = 4096                      # windows whose subwords are told apart together
ROWS = 2048                      # of them, of one class, in memory at once
CHUNK_BYTES = 1 << 18
SEGMENTS = 1 << 17               # different segments a task keeps the subwords of
PART_BYTES = 8 << 20             # texts sent together
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
ONES = np.ones(max(WINDOW, CLASSES), np.float32)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def encoding(name=RANKS):
    """The subword encoder; the number of subwords is also the id of the end."""
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


class Segments:
    """Subwords of segments, each encoded once, found by hash; forgotten when there are more than SEGMENTS."""

    def __init__(self, encoder):
        self.encoder = encoder
        self.clear()

    def clear(self):
        self.hashes, self.begin, self.counts, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, hashes, text):
        """Where the segments of sorted ``hashes`` stand in ``begin`` and ``counts``; ``text(i)`` is read of new ones."""
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new) and len(self.hashes) and len(self.hashes) + len(new) > SEGMENTS:
            self.clear()
            return self.places(hashes, text)
        if len(new):
            lists = [self.encoder.encode_ordinary(text(i)) for i in new.tolist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            spot = at[new]
            self.begin = np.insert(self.begin, spot, len(self.flat) + np.cumsum(counts) - counts)
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int64, counts.sum())])
            self.hashes, self.counts = np.insert(self.hashes, spot, hashes[new]), np.insert(self.counts, spot, counts)
            at = np.searchsorted(self.hashes, hashes)
        return at


def subwords(encoder, texts, known=None):
    """Subwords of every lower-cased text: their numbers, and all of them in order.

    Texts are cut before blanks and around line ends, and each different segment that ``known`` lacks is encoded once.
    """
    known = known or Segments(encoder)
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
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
    hashes, index, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    first, last = starts[index], ends[index]
    at = known.places(hashes, lambda i: raw[first[i]:last[i]].decode())[number]
    n = known.counts[at]
    head = np.cumsum(n) - n
    ids = known.flat[np.repeat(known.begin[at] - head, n) + np.arange(n.sum())]
    return np.bincount(text, n, len(texts)).astype(np.int64), ids


def layout(counts, ids, end):
    """Where windows lie: all subwords with an end before each text, and text and first target of each window.

    A text of n subwords has n + 1 targets. Window w covers targets w * STEP up to WINDOW more,
    and scores those that the window before did not.
    """
    targets = counts + 1
    number = 1 + np.maximum(-(-(targets - WINDOW) // STEP), 0)
    text = np.repeat(np.arange(len(counts)), number)
    first = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * STEP
    flat = np.full(len(ids) + len(counts) + 1, end, np.int32)       # every text after its own start mark
    flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts) + 1] = ids
    return flat, np.cumsum(targets) - targets, counts, text, first


def windows(laid, end, low=0, high=None):
    """Windows ``low`` to ``high`` of a layout: inputs, targets, what is scored, and the text of each."""
    flat, base, counts, text, first = laid
    text, first = text[low:high], first[low:high]
    at = first[:, None] + np.arange(WINDOW)
    size = counts[text][:, None]
    spot = np.minimum(base[text][:, None] + at, len(flat) - 2)
    real = at <= size
    x = np.where(real, flat[spot], end)
    y = np.where(at < size, flat[spot + 1], end)
    fresh = real & ((np.arange(WINDOW) >= WINDOW - STEP) | (first == 0)[:, None])
    return x, y, fresh, text


def most(weights, bias):
    """Bound of the logits, as hidden values lie between -1 and 1."""
    return float((np.abs(weights).sum(axis=0) + np.abs(bias)).max(initial=0))


def bounded(u):
    """Logits clipped in place to what ``exp`` can take."""
    np.maximum(u, -80, out=u)
    np.minimum(u, 80, out=u)


class Adam:
    """Steps down gradients; embeddings move only where they occur."""

    def __init__(self, params):
        self.p, self.t = params, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, found, pace):
        g, rows, de = found
        self.t += 1
        pace, low, high = pace / (1 - 0.9 ** self.t), 0.9, 0.99
        for k in self.p:
            d = de if k == "e" else g[k]
            first, second = (x[k][rows] if k == "e" else x[k] for x in (self.first, self.second))
            first *= low
            first += (1 - low) * d
            second *= high
            d = d * d
            d *= 1 - high
            second += d
            np.multiply(second, 1 / (1 - 0.99 ** self.t), out=d)
            np.sqrt(d, out=d)
            d += 1e-7
            np.divide(first, d, out=d)
            d *= pace
            if k == "e":
                self.first[k][rows], self.second[k][rows] = first, second
                self.p[k][rows] -= d
            else:
                self.p[k] -= d


class Model:
    """Parameters of the attention model and the distribution of subwords within classes."""

    def __init__(self, counts, seed=SEED):
        rng = np.random.default_rng(seed)
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order] + 1.0)
        self.of = np.empty(size, np.int64)
        self.of[order] = np.minimum((mass - (counts[order] + 1.0) / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        total = np.bincount(self.of, counts + 1.0, CLASSES)
        self.within = np.log((counts + 1.0) / total[self.of]).astype(np.float32)
        share = np.log((total + 1e-9) / total.sum())
        self.rank = np.empty(size, np.int64)
        self.rank[order] = np.arange(size)
        self.edge = np.searchsorted(self.of[order], np.arange(CLASSES + 1))
        self.known = self.within[order]
        large = np.flatnonzero(np.diff(self.edge) > MEMBERS)
        self.told = int(large[0]) if len(large) else CLASSES        # classes before it are told apart
        several = np.flatnonzero(np.diff(self.edge[:self.told + 1]) > 1)
        self.turn = np.full(CLASSES, len(several), np.uint8)        # of the classes with several members, others last
        self.turn[several] = np.arange(len(several))
        self.alone = [(i, i + 1, self.edge[k], self.edge[k + 1], None) for i, k in enumerate(several)]
        self.blocks = []                                            # turns, members and which member is of which turn
        for i, k in enumerate(several):
            a, low = self.blocks[-1][0::2][:2] if self.blocks else (0, 0)
            if self.blocks and self.edge[k + 1] - low <= TOGETHER:
                self.blocks.pop()
            else:
                a, low = i, self.edge[k]
            own = (several[a:i + 1, None] == self.of[order[low:self.edge[k + 1]]]).astype(np.float32) if i > a else None
            self.blocks.append((a, i + 1, low, self.edge[k + 1], own))
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)      # noqa: E731
        self.p = {"e": (rng.standard_normal((size, WIDTH)) * 0.5).astype(np.float32), "s": (rng.standard_normal((WINDOW, WIDTH)) * 0.5).astype(np.float32),
                  "q": scale(WIDTH, WIDTH), "k": scale(WIDTH, WIDTH), "v": scale(WIDTH, WIDTH), "o": scale(WIDTH, WIDTH),
                  "h": scale(2 * WIDTH, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "w": scale(HIDDEN, CLASSES), "b": share.astype(np.float32),
                  "m": np.zeros((HIDDEN, self.edge[self.told]), np.float32)}
        self.mask = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)

    def forward(self, x):
        p = self.p
        z = p["e"].take(x.ravel(), axis=0).reshape(*x.shape, WIDTH)
        z += p["s"]
        flat = z.reshape(-1, WIDTH)
        q, k, v = ((flat @ p[name]).reshape(z.shape) for name in "qkv")
        a = q @ k.transpose(0, 2, 1) * np.float32(WIDTH ** -0.5) + self.mask
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        m = a @ v
        r = np.concatenate([flat, m.reshape(-1, WIDTH) @ p["o"]], axis=1)
        t = r @ p["h"]
        t += p["c"]
        np.tanh(t, out=t)
        return z, q, k, v, a, m, r, t.reshape(*x.shape, HIDDEN)

    def log_classes(self, t):
        """Log probability of every class."""
        u = t @ self.p["w"] + self.p["b"]
        u -= u.max(axis=-1, keepdims=True)
        return u - np.log(np.exp(u).sum(axis=-1, keepdims=True))

    def groups(self, target):
        """Rows of each class that is told apart, with the range of its subwords by frequency."""
        kind = self.of[target]
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.told + 1))
        for k in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.edge[:self.told + 1]) > 1)):
            for at in range(ends[k], ends[k + 1], ROWS):
                yield order[at:min(at + ROWS, ends[k + 1])], self.edge[k], self.edge[k + 1]

    def log_members(self, t, rows, low, high):
        """Log probability of the subwords ``low`` to ``high`` of a class, for some rows."""
        u = t[rows] @ self.p["m"][:, low:high]
        u += self.known[low:high]
        u -= u.max(axis=1, keepdims=True)
        return u - np.log(np.exp(u).sum(axis=1, keepdims=True))

    def log_within(self, t, target):
        """Log probability of each target within its class."""
        out = self.within[target]
        for rows, low, high in self.groups(target):
            out[rows] = self.log_members(t, rows, low, high)[np.arange(len(rows)), self.rank[target[rows]] - low]
        return out

    def log_chosen(self, t, target):
        """As ``log_within``, with clipped logits."""
        free = most(self.p["m"], self.known[:self.edge[self.told]]) < 80
        turn = self.turn[self.of[target]]
        order = np.argsort(turn, kind="stable")
        ends, chosen = np.searchsorted(turn[order], np.arange(len(self.alone) + 1)), target[order]
        t, rank, logs = t.take(order, axis=0), self.rank[chosen], self.within[chosen]
        for i, _, low, high, _ in self.alone:
            for a in range(ends[i], ends[i + 1], ROWS):
                b = min(a + ROWS, ends[i + 1])
                u = t[a:b] @ self.p["m"][:, low:high]
                u += self.known[low:high]
                if not free:
                    bounded(u)
                mine = u[np.arange(b - a), rank[a:b] - low]
                np.exp(u, out=u)
                logs[a:b] = mine - np.log(u @ np.ones(high - low, np.float32))
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def joined(self):
        """Joined parameters: of queries, keys and values, and of hidden values after those and the output."""
        p = self.p
        return (np.concatenate([p["q"] * np.float32(WIDTH ** -0.5), p["k"], p["v"]], axis=1),
                np.concatenate([p["h"][:WIDTH], p["o"] @ p["h"][WIDTH:]]))

    def attend(self, x, into):
        """Inputs beside what each place attends to, joined products and weights, for whole windows.

        As in ``forward``, but the maximum is taken out only where ``exp`` could not take a logit.
        """
        n = len(x)
        both = np.empty((n, WINDOW, 2 * WIDTH), np.float32)
        z = self.p["e"].take(x.ravel(), axis=0)
        z.reshape(n, -1)[...] += self.p["s"].ravel()
        made = (z @ into).reshape(n, WINDOW, -1)
        w = made[..., :WIDTH] @ made[..., WIDTH:2 * WIDTH].transpose(0, 2, 1)
        if max(w.max(initial=0), -w.min(initial=0)) > 80:
            w += self.mask
            w -= w.max(axis=2, keepdims=True)
        np.exp(w, out=w)
        w *= SEEN
        w /= (w.reshape(-1, WINDOW) @ ONES[:WINDOW]).reshape(n, WINDOW, 1)
        both[..., :WIDTH] = z.reshape(n, WINDOW, WIDTH)
        np.matmul(w, made[..., 2 * WIDTH:], out=both[..., WIDTH:])
        return z, both, made, w

    def gradients(self, x, y, fresh):
        """Mean loss of the scored subwords and its gradients. Scored places are taken by class."""
        p = self.p
        into, hidden = self.joined()
        z, both, made, a = self.attend(x, into)
        keep = np.flatnonzero(fresh)
        chosen = y.ravel()[keep]
        turn = self.turn[self.of[chosen]]
        order = np.argsort(turn, kind="stable")
        keep, chosen, turn = keep[order], chosen[order], turn[order]
        target, rank, at, n = self.of[chosen], self.rank[chosen], np.arange(len(keep)), max(len(keep), 1)
        seen = both.reshape(-1, 2 * WIDTH).take(keep, axis=0)
        t = seen @ hidden
        t += p["c"]
        np.tanh(t, out=t)

        def slopes(u, spot, free, own=None):
            """Log probability of the targets; logits become slopes of the mean loss. ``own``: which of them count."""
            if not free:
                u -= u.max(axis=1, keepdims=True)
            mine = at[:len(u)]
            logs = u[mine, spot]
            np.exp(u, out=u)
            if own is not None:
                u *= own
            total = u @ np.ones(u.shape[1], np.float32)
            u *= (np.float32(1 / n) / total)[:, None]
            u[mine, spot] -= np.float32(1 / n)
            return logs - np.log(total)

        du = t @ p["w"]
        du += p["b"]
        loss = -slopes(du, target, most(p["w"], p["b"]) < 80).sum() / n
        g = {"w": t.T @ du, "b": np.ones(len(du), np.float32) @ du, "m": np.zeros_like(p["m"])}
        more = du @ p["w"].T
        inner, free = self.within[chosen], most(p["m"], self.known[:self.edge[self.told]]) < 80
        ends = np.searchsorted(turn, np.arange(len(self.alone) + 1))
        for i, j, low, high, own in self.blocks if free else self.alone:
            members, known = p["m"][:, low:high], self.known[low:high]
            for b in range(ends[i], ends[j], ROWS):
                e = min(b + ROWS, ends[j])
                d = t[b:e] @ members
                d += known
                inner[b:e] = slopes(d, rank[b:e] - low, free, None if own is None else own.take(turn[b:e] - i, axis=0))
                g["m"][:, low:high] += t[b:e].T @ d
                more[b:e] += d @ members.T
        loss -= inner.sum() / n
        t *= t
        np.subtract(1, t, out=t)
        more *= t
        dh = seen.T @ more
        g["c"], g["o"] = np.ones(len(more), np.float32) @ more, dh[WIDTH:] @ p["h"][WIDTH:].T
        g["h"] = np.concatenate([dh[:WIDTH], p["o"].T @ dh[WIDTH:]])
        back = np.zeros(both.shape, np.float32)
        back.reshape(-1, 2 * WIDTH)[keep] = more @ hidden.T
        dm, dmade = back[..., WIDTH:], np.empty(made.shape, np.float32)
        np.matmul(a.transpose(0, 2, 1), dm, out=dmade[..., 2 * WIDTH:])
        da = dm @ made[..., 2 * WIDTH:].transpose(0, 2, 1)
        da *= a
        a *= (da.reshape(-1, WINDOW) @ ONES[:WINDOW]).reshape(len(x), WINDOW, 1)
        da -= a
        np.matmul(da, made[..., WIDTH:2 * WIDTH], out=dmade[..., :WIDTH])
        np.matmul(da.transpose(0, 2, 1), made[..., :WIDTH], out=dmade[..., WIDTH:2 * WIDTH])
        dmade = dmade.reshape(len(z), -1)
        dinto, dz = z.T @ dmade, dmade @ into.T
        dz.reshape(back[..., :WIDTH].shape)[...] += back[..., :WIDTH]
        g["q"], g["k"], g["v"] = dinto[:, :WIDTH] * np.float32(WIDTH ** -0.5), dinto[:, WIDTH:2 * WIDTH], dinto[:, 2 * WIDTH:]
        g["s"] = (np.ones(len(x), np.float32) @ dz.reshape(len(x), -1)).reshape(WINDOW, WIDTH)
        used = x.ravel()
        order = np.argsort(used.astype(np.uint16) if len(p["e"]) <= 1 << 16 else used, kind="stable")
        used = used[order]
        head = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
        return loss, g, used[head], np.add.reduceat(dz.T.take(order, axis=1), head, axis=1).T

    def fit(self, x, y, fresh, steps=STEPS, seed=SEED):
        """Adam on random batches of windows."""
        rng, adam = np.random.default_rng(seed), Adam(self.p)
        for t in range(1, steps + 1 if len(x) else 0):
            i = rng.integers(0, len(x), BATCH)
            adam.step(self.gradients(x[i], y[i], fresh[i])[1:], PACE * min(1, t / 50) * (1 - 0.9 * t / steps))
        return self

    def rows(self):
        """All parameters as rows of WIDTH values, embeddings last."""
        rest = np.concatenate([v.ravel() for k, v in self.p.items() if k != "e"])
        return np.concatenate([np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH), self.p["e"]])

    def take_rows(self, rows):
        """The parameters from what ``rows`` gave."""
        flat, at = rows.ravel(), 0
        for k in self.p:
            if k != "e":
                self.p[k] = flat[at:at + self.p[k].size].reshape(self.p[k].shape).copy()
                at += self.p[k].size
        self.p["e"] = rows[len(rows) - len(self.p["e"]):].copy()

    def score(self, counts, ids, end):
        """log10 probability of each text.

        As ``forward``, with joined products; logits are clipped, so no maximum is taken out.
        """
        p = self.p
        laid = layout(counts, ids, end)
        into, last = self.joined()
        free = most(p["w"], p["b"]) < 80                        # nothing to clip
        room = np.empty((SCORED * WINDOW, CLASSES), np.float32)    # one buffer for all batches
        out = np.zeros(len(counts))
        batches = (windows(laid, end, a, a + TOLD) for a in range(0, len(laid[3]), TOLD))
        for x, y, fresh, text in batches:
            hidden, targets, texts = [], [], []
            for a in range(0, len(x), SCORED):
                keep = np.flatnonzero(fresh[a:a + SCORED])
                t = self.attend(x[a:a + SCORED], into)[1].reshape(-1, 2 * WIDTH).take(keep, axis=0) @ last
                t += p["c"]
                np.tanh(t, out=t)
                u = np.matmul(t, p["w"], out=room[:len(t)])
                u += p["b"]
                if not free:
                    bounded(u)
                target = y[a:a + SCORED].ravel()[keep]
                logs = u[np.arange(len(target)), self.of[target]]
                np.exp(u, out=u)
                logs -= np.log(u @ ONES[:CLASSES])
                of = text[a:a + SCORED][keep // WINDOW]
                out += np.bincount(of, logs, len(counts))
                hidden.append(t)
                targets.append(target)
                texts.append(of)
            of = np.concatenate(texts)
            out += np.bincount(of, self.log_chosen(np.concatenate(hidden), np.concatenate(targets)), len(counts))
        return out / np.log(10)


def _counter(batches):
    """How often each subword occurs in training texts, ends as well."""
    total = None
    for batch in batches:
        for blob in batch.column("docs").to_pylist():
            _, _, held, _, counts, ids, end = open_docs(blob)
            total = np.zeros(end + 1, np.int64) if total is None else total
            total += np.bincount(ids[np.repeat(~held, counts)], minlength=end + 1)
            total[end] += np.count_nonzero(~held)
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["subword", "n"])


def _trainer(model, pace):
    """Per task: a fit to all training windows of its texts, as changes of the parameters by block.

    A row of parameters weighs as much as windows moved it, an embedding as often as its subword occurred.
    """
    def run(batches):
        adam, start, named, moved = None, model.rows(), None, 0
        for batch in batches:
            for key, blob in zip(batch.column("batch").to_pylist(), batch.column("docs").to_pylist()):
                _, _, held, _, counts, ids, end = open_docs(blob)
                ids, counts = ids[np.repeat(~held, counts)], counts[~held]
                laid = layout(counts, ids, end)
                if adam is None:
                    adam, named, seen = Adam(model.p), key, np.zeros(end + 1)
                rng = np.random.default_rng([SEED, key])
                for low in range(0, len(laid[3]), SLAB):
                    x, y, fresh, _ = windows(laid, end, low, low + SLAB)
                    order = rng.permutation(len(x))
                    for a in range(0, len(x), LARGER):
                        i = order[a:a + LARGER]
                        adam.step(model.gradients(x[i], y[i], fresh[i])[1:], pace * min(1, (adam.t + 1) / 50) * len(i) / LARGER)
                    seen += np.bincount(x.ravel(), minlength=end + 1)
                    moved += len(x)
        if moved:
            change = model.rows() - start
            weight = np.concatenate([np.full(len(change) - len(seen), moved, np.float64), seen])
            for at in range(0, len(change), BLOCK):
                w = weight[at:at + BLOCK]
                blob = pack((change[at:at + BLOCK] * w[:, None]).ravel(), w)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([named], pa.int64()), pa.array([moved], pa.int64()), pa.array([blob], pa.binary())],
                                                 ["block", "task", "windows", "blob"])
    return run


def _average(table):
    """Mean change of a block of parameters over the tasks that moved it."""
    table = table.sort_by("task")                                   # sums do not depend on arrival
    change, weight = 0, 0
    for blob in table.column("blob").to_pylist():
        d, w = unpack(blob, np.float64, np.float64)
        change, weight = change + d.reshape(-1, WIDTH), weight + w
    mean = (change / np.maximum(weight, 1)[:, None]).astype(np.float32)
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([pc.sum(table.column("windows")).as_py()], pa.int64()), pa.array([pack(mean.ravel())], pa.binary())],
                    names=["block", "windows", "blob"])


def learn(model, encoded):
    """The model after a pass over every window of all training texts; the number of windows.

    Files are taken in groups of a fixed size, so rounds grow with the data. In a round every task
    moves its own copy of the model through its batches, and the copies are averaged.
    """
    spark, files = encoded.sparkSession, sorted(encoded.inputFiles())
    turn = F.col("batch") % F.lit(1 << 24)
    last = encoded.agg(F.max(turn)).first()[0]
    if last is None:
        return model, 0
    parts = min(PARTS, last + 1)
    rounds = [(files[at:at + FILES], part) for at in range(0, len(files), FILES) for part in range(parts)]
    total = 0
    for number, (names, part) in enumerate(rounds):
        some = spark.read.schema(encoded.schema).parquet(*names).where("docs is not null").where(turn % parts == part)
        pace = SLOWER * (1 - 0.9 * number / len(rounds))
        moved = some.mapInArrow(_trainer(model, pace), "block long, task long, windows long, blob binary")
        found = moved.groupBy("block").applyInArrow(_average, "block long, windows long, blob binary").collect()    # one model
        rows = model.rows()
        for r in found:
            change, = unpack(r.blob, np.float32)
            rows[r.block:r.block + BLOCK] += change.reshape(-1, WIDTH)
        model.take_rows(rows)
        total += found[0].windows if found else 0
    return model, total


def fit_model(docs, encoded):
    """The model, from counts over all training texts, a first fit to some and a pass over all their windows."""
    encoder, end = encoding()
    rows = encoded.mapInArrow(_counter, "subword long, n long").groupBy("subword").agg(F.sum("n").alias("n"))
    counts = np.zeros(end + 1)
    for r in rows.collect():                                    # at most the vocabulary
        counts[r.subword] = r.n
    chosen = docs.where("not held_out").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    ids = chosen.select(F.xxhash64("doc_id").alias("turn"), "doc_id").orderBy("turn", "doc_id").limit(FIT_TEXTS).select("doc_id").distinct()
    texts = chosen.join(F.broadcast(ids), "doc_id").select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])   # FIT_TEXTS ids
    model = Model(counts)
    if texts.num_rows:
        n, ids = subwords(encoder, as_bytes(texts.column("text")))
        x, y, fresh, _ = windows(layout(n, ids, end), end)
        model.fit(x, y, fresh)
    return learn(model, encoded)[0]


def close_docs(number, null, held, words, counts, ids, end):
    """Documents of a batch as one blob, subwords in 16 bits and compressed."""
    raw = ids.astype(np.uint16).tobytes()
    return pack(number, null, held, words, counts, np.array([len(raw), end]), np.frombuffer(pa.compress(raw, codec="zstd", asbytes=True), np.uint8))


def open_docs(blob):
    number, null, held, words, counts, (size, end), packed = unpack(blob, np.int64, bool, bool, np.int64, np.int64, np.int64, np.uint8)
    ids = np.frombuffer(pa.decompress(packed.tobytes(), int(size), codec="zstd", asbytes=True), np.uint16)
    return number, null, held, words, counts, ids.astype(np.int64), int(end)


def _scorer(model):
    def run(batches):
        for batch in batches:
            for key, blob in zip(batch.column("batch").to_pylist(), batch.column("docs").to_pylist()):
                number, null, held, words, counts, ids, end = open_docs(blob)
                cut = np.concatenate([[0], np.cumsum(counts)])
                scores = [model.score(counts[a:b], ids[cut[a]:cut[b]], end) for a, b in pieces([range(n) for n in counts.tolist()])]
                out = pack(number, null, held, words, np.concatenate(scores) if scores else np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([key], pa.int64()), pa.array([out], pa.binary())], ["kind", "batch", "blob"])
    return run


def word_pairs(texts, first):
    """Different pairs of word and text, in order, with how often each occurs; and the words of each text."""
    hashes, n, _ = word_hashes(texts)
    order = np.argsort(hashes, kind="stable")                      # texts of a word stay in order
    words, of = hashes[order].astype(U), np.repeat(np.arange(first, first + len(n), dtype=np.int32), n)[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    return words[head], of[head], np.diff(np.concatenate([head, [len(words)]])).astype(np.int32), n


def _sender(buckets):
    """Per batch: its words with the places they occur at, by bucket, and its documents' subwords."""
    def run(batches):
        encoder, end = encoding()
        kept = Segments(encoder)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        parts = (batch[x:y] for batch in batches for x, y in pieces([range(n or 0) for n in pc.binary_length(batch.column(2)).to_pylist()], PART_BYTES))
        for turn, batch in enumerate(parts):
            key = (task << 24) + turn
            ids, held, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), as_bytes(batch.column(2))
            known = np.array(ids.is_null().to_numpy(zero_copy_only=False), bool)
            number = np.where(known, 0, ids.fill_null(0).to_numpy()).astype(np.int64)
            found, counts, subs = [], [], []
            for a, b in pieces(texts, CHUNK_BYTES):
                n, ids_of = subwords(encoder, texts[a:b], kept)
                counts.append(n)
                subs.append(ids_of.astype(np.uint16))               # as they are sent
                found += [word_pairs(texts[a + c:a + d], a + c) for c, d in pieces(texts[a:b])]
            del texts
            counts, subs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, subs))
            words, of, times, per_text = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (U, np.int32, np.int32, np.int64))
            del found
            docs = close_docs(number, known, held, per_text.astype(np.int64), counts, subs, end)
            del subs
            order = np.argsort(words, kind="stable")                # pieces, and so texts, stay in order
            words, of, times = words[order], of[order], times[order]
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            head = np.flatnonzero(new)
            texts_with = np.diff(np.concatenate([head, [len(words)]]))
            distinct = words[head]
            learned = np.add.reduceat(np.where(held[of], 0, times).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
            bucket = (mix(distinct) % U(buckets)).astype(np.int64)
            del words, new
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):                                # a row at a time, so that a batch's rows are not held together
                mine = order[ends[k]:ends[k + 1]]
                n = texts_with[mine]
                at = np.repeat(head[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = docs if k == key % buckets else None
                if len(mine) or own:
                    row = (k, key, pack(distinct[mine], learned[mine], n.astype(np.int32), of[at], times[at]), own)
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     ["bucket", "batch", "words", "docs"])
    return run


def _count_bucket(table):
    """Counts of a bucket's words, as sums of log10(count + 1) and of known words by document.

    Kind 0: sums for the documents of a batch (kind 1: the documents). Kind 2: training tokens and
    distinct ones of the bucket.
    """
    batches, blobs = table.column("batch").to_pylist(), [unpack(b, U, np.int64, np.int32, np.int32, np.int32) for b in table.column("words").to_pylist()]
    words = np.concatenate([b[0] for b in blobs])
    distinct, number = np.unique(words, return_inverse=True)
    count = np.bincount(number, np.concatenate([b[1] for b in blobs]), len(distinct))
    rows, at = [], 0
    for batch, (w, _, n, of, times) in zip(batches, blobs):
        c = np.repeat(count[number[at:at + len(w)]], n)
        at += len(w)
        size = int(of.max()) + 1 if len(of) else 0
        rows.append((0, batch, pack(np.bincount(of, times * np.log10(c + 1), size), np.bincount(of, times * (c > 0), size).astype(np.int64)), 0, 0))
    rows.append((2, None, None, int(count.sum()), int((count > 0).sum())))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "batch", "blob", "tokens", "distinct"])


def _add_up(table):
    """Documents of a batch with the sums of all buckets."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    docs = [b for k, b in zip(kinds, blobs) if k == 1][0]
    ids, null, held, words, score = unpack(docs, np.int64, bool, bool, np.int64, np.float64)
    logs, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    parts = sorted((b for k, b in zip(kinds, blobs) if k == 0))    # sums do not depend on arrival
    for blob in parts:
        s, n = unpack(blob, np.float64, np.int64)
        logs[:len(s)] += s
        known[:len(n)] += n
    return pa.table({"doc_id": pa.array(ids, mask=null), "held_out": held, "n_words": words, "known_words": known, "logs": logs, "score": score})


def written(rows):
    """Rows of large blobs as Parquet in the shared folder, so that files and columns can be read alone."""
    path = scratch(rows.sparkSession, "sent")
    small = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    rows.write.options(**small).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def score_texts(docs, buckets=None):
    """Scores of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Texts are learnt from unless
    crc32 of the id as text leaves 2 modulo 7; null texts count as empty and have their end only;
    null ids are learnt from. Tokens are lower-cased (A-Z) words and one end. ``base_score`` is the
    add-one log10 probability of the tokens, ``score`` the model's of the text. Repeated rows count
    each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    sent = written(docs.mapInArrow(_sender(buckets), "bucket int, batch long, words binary, docs binary"))
    encoded = sent.where("docs is not null").select("batch", "docs")
    model = fit_model(docs, encoded)
    scored = encoded.mapInArrow(_scorer(model), "kind int, batch long, blob binary")
    counted = sent.select("bucket", "batch", "words").groupBy("bucket").applyInArrow(_count_bucket, "kind int, batch long, blob binary, tokens long, distinct long")
    counted = persist_plan(counted)
    tokens, distinct = counted.where("kind = 2").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = docs.where("not held_out").count()
    train, kinds = tokens + ends, distinct + (ends > 0)
    rows = counted.where("kind = 0").select("kind", "batch", "blob").unionByName(scored).groupBy("batch").applyInArrow(
        _add_up, "doc_id long, held_out boolean, n_words long, known_words long, logs double, score double")
    n_tokens = F.col("n_words") + 1
    return rows.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known_words") + (1 if ends else 0)).alias("n_known"),
                       F.lit(train).cast("long").alias("train_tokens"),
                       (F.col("logs") + F.lit(float(np.log10(ends + 1))) - n_tokens * F.lit(float(np.log10(train + kinds + 1)))).alias("base_score"), "score")
