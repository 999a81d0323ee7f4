"""Similarity join on word shingles with parity sketches.

Every shingle flips one bit of a long bit sketch, so the Hamming distance of two sketches
never exceeds the symmetric difference of the two sets. Sets with Jaccard of at least 3/4
differ in at most (|A| + |B|) / 7 shingles, so of more parts than that at least one is equal
bit for bit (pigeonhole). Sketches are made per band of set sizes, each text joining the band
below as well if a partner may lie there. Texts that share a part become candidates, counted
and filtered by the bound, and are verified on their whole sets.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidegauge.llm.graphs import components
from tidegauge.llm.words import U, as_bytes, mix, pack, shingle_sets, unpack
from tidegauge.session import persist_plan

WIDTH = 5                        # words in a shingle
LEAST = (75, 100)                # similarity a link needs, as a fraction
SMALLEST = 32                    # sets below it use one part a shingle
LOADS = (1.0, 1.5, 2.0, 2.4)     # shingles a part at the top of each band; the last holds on
SLOT_BITS = 20                   # width of a part of the sketch
BUSY = 16                        # texts from which a part counts as common
LOCAL = 4096                     # texts of a group resolved in one task
KEY_MASK = U((1 << 40) - 1)
ROWS = "kind int, a long, b long, x int, y int, n int"


def band_of(sizes):
    return np.where(sizes < SMALLEST, -1, np.floor(np.log2(np.maximum(sizes, 1) / SMALLEST)).astype(np.int64))


def parts_of(band):
    """Parts of a sketch; a load well under 7/2 leaves more filled parts than differences."""
    load = np.asarray(LOADS)[np.clip(band, 0, len(LOADS) - 1)]
    return np.ceil((2.0 * SMALLEST * 4 / 3) * np.exp2(np.maximum(band, 0)) / load).astype(np.int64)


def sketch_keys(sets, sizes, band):
    """Digest of every filled part: keys, and the set each belongs to. ``band``: one a set."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if sets else np.zeros(0, U)
    small = band[owner] < 0
    parts = parts_of(band)
    base = np.concatenate([[0], np.cumsum(parts)])
    big_owner, big = owner[~small], values[~small]
    part = (big % parts[big_owner].astype(U)).astype(np.int64)
    bit = (part.astype(U) << U(SLOT_BITS)) | (big >> U(64 - SLOT_BITS))
    digest = np.zeros(base[-1], U)
    np.bitwise_xor.at(digest, base[big_owner] + part, mix(bit + U(1)))
    filled = np.flatnonzero(digest)
    of = np.searchsorted(base, filled, "right") - 1
    salt = mix(((filled - base[of]).astype(U) << U(8)) | (band[of] + 1).astype(U))
    keys = np.concatenate([mix(digest[filled] ^ salt), mix(values[small] + U(0x5851F42D4C957F2D))])
    return keys, np.concatenate([of, owner[small]])


def sketch_batch(ids, texts, buckets):
    """Blobs by bucket for one batch of texts."""
    sets = shingle_sets(texts, WIDTH)
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    signs = np.fromiter((int(np.sum(mix(s ^ U(0x2545F4914F6CDD1D)), dtype=U)) for s in sets), U, len(sets)) + sizes.astype(U)
    home = (mix(signs ^ ids.view(U)) % U(buckets)).astype(np.int64)     # spreads copies
    _, first = np.unique(signs, return_index=True)              # equal sets of a batch go once
    first = first[sizes[first] > 0]
    own, least = band_of(sizes), band_of((3 * sizes + 3) // 4)
    entry = np.concatenate([first, first[least[first] < own[first]]])
    band = np.concatenate([own[first], least[first][least[first] < own[first]]])
    keys, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a in range(0, len(entry), 256):
        k, o = sketch_keys([sets[i] for i in entry[a:a + 256]], sizes[entry[a:a + 256]], band[a:a + 256])
        keys.append(k)
        of.append(o + a)
    keys, of = np.concatenate(keys), np.concatenate(of)
    filled = np.bincount(of, minlength=len(entry))
    bucket = ((keys >> U(40)) % U(buckets)).astype(np.int64)
    order = np.lexsort((of, bucket))
    keys, of, bucket = keys[order] & KEY_MASK, of[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    by_home = np.argsort(home, kind="stable")
    home_ends = np.searchsorted(home[by_home], np.arange(buckets + 1))
    entry_home = (mix(signs[entry]) % U(buckets)).astype(np.int64)
    for k in range(buckets):
        a, b = ends[k], ends[k + 1]
        docs = by_home[home_ends[k]:home_ends[k + 1]]
        info = np.flatnonzero(entry_home == k)
        if a == b and not len(docs) and not len(info):
            continue
        used, counts = np.unique(of[a:b], return_counts=True)
        yield k, pack(signs[entry[used]], sizes[entry[used]].astype(np.int32), band[used].astype(np.int8),
                      counts.astype(np.int32), keys[a:b].astype(np.uint32), (keys[a:b] >> U(32)).astype(np.uint8),
                      ids[docs], signs[docs], sizes[docs].astype(np.int32),
                      signs[entry[info]], sizes[entry[info]].astype(np.int32), band[info].astype(np.int8),
                      filled[info].astype(np.int32))


KINDS = (U, np.int32, np.int8, np.int32, np.uint32, np.uint8, np.int64, U, np.int32, U, np.int32, np.int8, np.int32)


def match_bucket(blobs):
    """Rows of one bucket of parts.

    Kind 0: text ``a``, signature ``b`` and size ``x``. Kind 1: signatures ``a`` and ``b`` share
    ``n`` uncommon parts in band ``x``. Kind 2: ``a`` has ``n`` common parts in band ``x`` that
    the signature ``b`` has too. Kind 3: signature ``a`` of size ``y`` fills ``n`` parts in band ``x``.
    """
    got = [np.concatenate(c) for c in zip(*(unpack(b, *KINDS) for b in blobs))]
    sign, size, band, count, low, high, ids, doc_sign, doc_size, info_sign, info_size, info_band, filled = got
    entry = np.repeat(np.arange(len(sign)), count)
    order = np.lexsort((band, sign))
    new = np.ones(len(order), bool)
    new[1:] = (sign[order][1:] != sign[order][:-1]) | (band[order][1:] != band[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    sign, size, band = sign[order][new], size[order][new].astype(np.int64), band[order][new].astype(np.int64)
    key = low.astype(U) | (high.astype(U) << U(32))
    of = number[entry]
    if len(sign) < 1 << 24:
        both = np.unique((key << U(24)) | of.astype(U))
        key, of = both >> U(24), (both & U((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, of = key[keep], of[keep]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    group = np.diff(np.concatenate([starts, [len(key)]]))
    busy = np.repeat(group > BUSY, group)
    head = np.repeat(starts, group)
    size_of = np.repeat(group, group)
    quiet = np.flatnonzero(~busy & (size_of > 1))
    key_q, of_q = key[quiet], of[quiet]
    codes = [np.zeros(0, np.int64)]
    n = len(sign)
    for d in range(1, BUSY):
        same = np.flatnonzero(key_q[:-d] == key_q[d:])
        if not len(same):
            break
        a, b = of_q[same], of_q[same + d]
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (LEAST[1] * small >= LEAST[0] * large) & (band_of(small) == band[a])
        codes.append(a[ok] * n + b[ok])
    code, times = np.unique(np.concatenate(codes), return_counts=True)
    a, b = code // max(n, 1), code % max(n, 1)
    hot = np.flatnonzero(busy)
    star, parts = np.unique(of[hot] * n + of[head[hot]], return_counts=True)
    c, d = star // max(n, 1), star % max(n, 1)
    zero = lambda m: np.zeros(m, np.int64)                      # noqa: E731
    out = [(0, ids, doc_sign.view(np.int64), doc_size, zero(len(ids)), zero(len(ids))),
           (1, sign[a].view(np.int64), sign[b].view(np.int64), band[a], zero(len(a)), times),
           (2, sign[c].view(np.int64), sign[d].view(np.int64), band[c], zero(len(c)), parts),
           (3, info_sign.view(np.int64), zero(len(info_sign)), info_band, info_size, filled)]
    kinds = np.concatenate([np.full(len(o[1]), o[0]) for o in out])
    columns = [np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in range(1, 6)]
    return pa.table({"kind": pa.array(kinds, pa.int32()), "a": columns[0], "b": columns[1],
                     **{k: pa.array(v, pa.int32()) for k, v in zip("xyn", columns[2:])}})


def similar(a, b):
    """Whether two sorted sets of hashes reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def folded(sets):
    """Sketches folded to 4096 bits, which keeps the lower bound."""
    out = np.zeros((len(sets), 64), U)
    for i, s in enumerate(sets):
        slot = s >> U(52)
        np.bitwise_xor.at(out[i], (slot >> U(6)).astype(np.int64), U(1) << (slot & U(63)))
    return out


def resolve(ids, sets, known=None, cut=None):
    """Smallest id linked, directly or not, to each set of a group.

    ``known``: such ids of links found before. ``cut``: only sets before it are compared with
    those from it on.
    """
    n = len(ids)
    label = np.array(ids if known is None else known)
    sizes = np.fromiter((len(s) for s in sets), np.int64, n)
    bits = folded(sets) if n > 2 else None
    for i in range(n - 1 if cut is None else cut):
        rest = np.arange(i + 1 if cut is None else cut, n)
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[(label[rest] != label[i]) & (LEAST[1] * small >= LEAST[0] * large)]
        if n > 2 and len(rest):
            far = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1)
            rest = rest[7 * far.astype(np.int64) <= sizes[i] + sizes[rest]]
        for j in rest.tolist():
            if label[j] != label[i] and similar(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def _sketcher(buckets):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = list(sketch_batch(ids, as_bytes(batch.column(1)), buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])
    return run


def _match(table):
    return match_bucket(table.column("blob").to_pylist())


def _resolve_bin(table):
    """Links inside every group of a bin: each text and the smallest one it reaches."""
    table = table.sort_by([("component", "ascending"), ("rep", "ascending")])
    group, ids = table.column("component").to_numpy(), table.column("rep").to_numpy()
    texts = as_bytes(table.column("text"))
    ends = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    a, b = [], []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        a.append(ids[s:e])
        b.append(resolve(ids[s:e], shingle_sets(texts[s:e], WIDTH)))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _resolve_block(table):
    """Links inside one block of a large group."""
    return pa.table({"rep": table.column("rep"),
                     "known": resolve(table.column("rep").to_numpy(), shingle_sets(as_bytes(table.column("text")), WIDTH))})


def _resolve_pair(table):
    """Links between two blocks of a large group, as pairs of the classes they join."""
    table = table.sort_by([("block", "ascending"), ("rep", "ascending")])
    block, known = table.column("block").to_numpy(), table.column("known").to_numpy()
    cut = int(np.count_nonzero(block == block[0])) if len(block) else 0
    now = resolve(known, shingle_sets(as_bytes(table.column("text")), WIDTH), known, cut)
    both = np.unique(np.stack([known, now], axis=1)[known != now], axis=0)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _large_groups(texts, large):
    """Exact links of groups too large for one task.

    A group is dealt into blocks of about half as many texts as a task takes. Blocks are
    resolved one by one, then every two blocks of a group against each other, where only texts
    that no link joins yet are compared.
    """
    sizes = large.groupBy("component").agg(F.ceil(F.count("*") * 2 / LOCAL).cast("int").alias("blocks"))
    dealt = large.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = persist_plan(dealt.join(texts, "rep").select("component", "blocks", "block", "rep", "text"))
    inside = persist_plan(rows.groupBy("component", "block").applyInArrow(_resolve_block, "rep long, known long"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = (rows.join(inside, "rep").select("component", "block", "rep", "known", "text", other).where("other <> block")
             .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}))
    across = pairs.groupBy("component", "low", "high").applyInArrow(_resolve_pair, "a long, b long")
    return persist_plan(inside.select(F.col("rep").alias("a"), F.col("known").alias("b")).where("a <> b").unionByName(across))


def _common_links(rows, info):
    """Candidate links over common parts, each text linked with the first owner of the part.

    A pair has at most ``most`` differing parts, so a text with more uncommon parts than that
    needs no common ones: one of the uncommon is shared too. Any other pair shares at least
    ``filled - most`` parts, all of them common; if each side leaves out the owners of fewer
    than half as many, one owner stays in both.
    """
    small = F.col("size_a") < SMALLEST * F.pow(F.lit(2.0), F.col("x") + 1)
    most = F.when(small, F.floor(F.col("size_a") / 3)).otherwise(F.floor(2 * F.col("size_a") / 7))
    owners = rows.where("kind = 2").groupBy("a", "x", "b").agg(F.sum("n").alias("n"))
    per_text = Window.partitionBy("a", "x")
    upto = per_text.orderBy("n", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owners = owners.withColumn("upto", F.sum("n").over(upto)).withColumn("common", F.sum("n").over(per_text))
    return (owners.join(info, ["a", "x"]).withColumn("most", most).where("free_a <= most")
            .where("2 * upto >= free_a + common - most").where("a <> b").select("a", "b"))


def shingle_classes(docs, buckets=None):
    """Near-duplicate classes of ``docs`` (``doc_id``, ``text``): doc_id, n_shingles, component_id.

    Words are runs of non-blank characters, A-Z lower-cased; sets are distinct 5-word shingles,
    or the whole sequence of a shorter text. Null and blank texts have no set and link with
    nothing. Equal sets share one signature and so one class. Rows that repeat a doc_id are one document,
    the greatest text counting; rows with a null doc_id take no part. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    blobs = docs.mapInArrow(_sketcher(buckets), "bucket int, blob binary")
    rows = persist_plan(blobs.groupBy("bucket").applyInArrow(_match, ROWS))
    texts_of = rows.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sign"), F.col("x").alias("n_shingles"))
    reps = persist_plan(texts_of.where("n_shingles > 0").groupBy("sign").agg(F.min("doc_id").alias("rep")))
    common = rows.where("kind = 2").groupBy("a", "x").agg(F.sum("n").alias("hot"))
    info = rows.where("kind = 3").groupBy("a", "x").agg(F.max("y").alias("size"), F.max("n").alias("filled"))
    info = persist_plan(info.join(common, ["a", "x"], "left").select(
        F.col("a").alias("sign"), F.col("x").alias("band"), "size", (F.col("filled") - F.coalesce("hot", F.lit(0))).alias("free")))
    pairs = rows.where("kind = 1").groupBy("a", "b", "x").agg(F.sum("n").alias("n"))
    one = info.select(F.col("sign").alias("a"), F.col("band").alias("x"), F.col("size").alias("size_a"), F.col("free").alias("free_a"))
    two = info.select(F.col("sign").alias("b"), F.col("band").alias("x"), F.col("size").alias("size_b"), F.col("free").alias("free_b"))
    pairs = pairs.join(one, ["a", "x"]).join(two, ["b", "x"]).where(
        "n >= greatest(free_a, free_b) - floor((size_a + size_b) / 7)").select("a", "b")
    stars = _common_links(rows, one)
    groups = components(pairs.unionByName(stars))
    members = persist_plan(groups.join(reps, groups.id == reps.sign).select("component", "rep"))
    sizes = persist_plan(members.groupBy("component").agg(F.count("*").alias("n")))
    large = persist_plan(members.join(sizes.where(F.col("n") > LOCAL), "component", "left_semi"))
    small = members.join(sizes.where(F.col("n") <= LOCAL), "component", "left_semi")
    texts = docs.withColumnRenamed("doc_id", "rep")
    links = _large_groups(texts, large) if large.limit(1).count() else None
    bins = 4 * buckets
    binned = small.join(texts, "rep").select("component", "rep", "text",
                                             F.pmod(F.hash("component"), F.lit(bins)).alias("bin"))
    found = binned.groupBy("bin").applyInArrow(_resolve_bin, "a long, b long").where("a <> b")
    if links is not None:
        found = components(found.unionByName(links)).select(F.col("id").alias("a"), F.col("component").alias("b"))
    classes = persist_plan(reps.join(found, reps.rep == found.a, "left").select("sign", F.coalesce("b", "rep").alias("class")))
    return texts_of.join(classes, "sign", "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("component_id"))

