"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik, VLDB 2006).

A document is the set of its distinct word shingles. Sets with a Jaccard similarity of at least
``similarity`` and sizes a <= b differ in at most ``(1 - s) / (1 + s) * (a + b)`` elements. For each
band of sizes the shingle domain is cut into partitions by hash. Two similar sets differ in at most
that many partitions, so among their non-empty partitions enough are equal: the content of one
partition is a signature, and a set issues as many as can differ, plus one. Signatures with most
elements come first (a fixed order that both sides share), which makes them selective. A set with too
few non-empty partitions for this argument also issues single shingles as signatures.

Documents that share signatures are compared in bounded blocks, first with parity sketches, whose
differing bits never exceed the differing shingles. A block hands on a spanning forest of the pairs that may be links, so
its output is linear in its rows. Trees of the forest are families; only their members' sets are
fetched, and inside a family, again in blocks, every pair that is not yet connected is decided on the full sets. No link between
components is lost, and pairs inside a component are never expanded.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import WordHashes, chunked, mix, odd, runs, texts_of, windows
from replyloom.operators.components import connected_components
from replyloom.runtime import materialize

#: Signatures a task holds before it hands them on.
FLUSH = 3_000_000
#: Signatures that one receiving task is meant to hold.
PER_TASK = 2_000_000
#: Members of a group compared in one task.
BLOCK = 1000
#: Groups up to this size are compared without arrays.
SMALL = 12
#: Shingles of full sets compared in one task.
BLOCK_SHINGLES = 1_000_000
#: Sketch bits for each shingle.
SKETCH_BITS = 4
#: Bits of the filter on documents whose sets are fetched (1 MB).
FILTER_BITS = 1 << 23


def _sets(words: list[list[bytes]], cache: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (document, hash), and the set size of each document."""
    hashes, lengths = cache.of(words)
    doc, _, value = windows(hashes, lengths, width)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        first = np.cumsum(lengths) - lengths
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            on = lengths[short] > j
            whole[on] += hashes[(first[short] + j)[on]] * odd(j)
        whole += lengths[short].astype(np.uint64) * odd(width)
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix(whole)))
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    ends = np.cumsum(np.bincount(doc, minlength=len(words)))
    for low, high in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        value[low:high].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(words)).astype(np.int64)


def _keys(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set; 0 for the empty set."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(value ^ odd(11)), starts) + sizes[full].astype(np.uint64))
    return out


def _band(n: np.ndarray) -> np.ndarray:
    """Size band: floor of the binary logarithm."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _sketch(value: np.ndarray, band: int) -> bytes:
    """Parities of the shingles hashed into SKETCH_BITS * 2^band bits."""
    bits = max(64, SKETCH_BITS << int(band))
    flips = np.bincount((value & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches cut to ``width`` bytes: a bit's parity is that of the two bits it stands for."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Rule:
    """Integer form of the similarity and what follows from it."""

    def __init__(self, similarity: float, width: int):
        ratio = Fraction(similarity).limit_denominator(1000)
        self.num, self.den, self.width = ratio.numerator, ratio.denominator, width

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def most_apart(self, total):
        """Largest number of differing elements of a linked pair with a + b = total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest_partner(self, n):
        return n * self.den // self.num


def _signatures(value: np.ndarray, sizes: np.ndarray, rule: _Rule) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of the given sets."""
    docs_out, sigs_out = [], []

    def issue(pick: np.ndarray, band: np.ndarray, parts: np.ndarray | None, apart: np.ndarray, tag: int) -> np.ndarray:
        """Issue apart + 1 signatures per picked set; returns which sets had too few partitions."""
        take = np.repeat(pick, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)[take]
        v = value[take]
        if not len(v):
            return np.zeros(0, np.int64)
        if parts is None:
            count = np.ones(len(v), np.int64)
            sig, owner = v, doc
        else:
            # The part is part of the content: equal content lies in the same part.
            part = (mix(v ^ odd(5)) & (parts[doc] - 1).astype(np.uint64)).astype(np.int64)
            key = (doc << 40) | part
            order = np.argsort(key)
            key = key[order]
            at = runs(key)
            sig = np.add.reduceat(v[order] * odd(9) ^ (v[order] >> np.uint64(29)), at)
            count = np.diff(np.append(at, len(key)))
            owner = key[at] >> 40
        sig = mix(sig + (band[owner].astype(np.uint64) * np.uint64(4) + np.uint64(tag)) * odd(3))
        # Most elements first, then the signature itself: an order common to all sets.
        rank = ((255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(36)) | (sig >> np.uint64(28))
        order = np.argsort(owner.astype(np.uint64) << np.uint64(44) | rank)
        owner, sig = owner[order], sig[order]
        at = runs(owner)
        have = np.diff(np.append(at, len(owner)))
        place = np.arange(len(owner)) - np.repeat(at, have)
        keep = place <= apart[owner]
        docs_out.append(owner[keep])
        sigs_out.append(sig[keep])
        which = owner[at]
        return which[have <= apart[which]]

    band = _band(np.maximum(sizes, 1))
    partner = rule.largest_partner(sizes)
    top = (np.int64(2) << band) - 1
    for tag, pick, b, apart in (
        (0, sizes > 0, band, rule.most_apart(sizes + np.minimum(partner, top))),
        (1, (sizes > 0) & (partner > top), band + 1, rule.most_apart(sizes + partner)),
    ):
        # ``tag`` only tells own band from next band in this loop; both name the band itself.
        few = issue(pick, b, np.int64(1) << b, apart, 0)
        if len(few):
            some = np.zeros(len(sizes), bool)
            some[few] = True
            issue(some, b, None, apart, 1)
    return np.concatenate(docs_out or [np.zeros(0, np.int64)]), np.concatenate(sigs_out or [np.zeros(0, np.uint64)])


def _walk(batches, width: int):
    """(batch, rows of the chunk, set values, set sizes, set keys) for bounded chunks of documents."""
    cache = WordHashes()
    for batch in batches:
        split = (t.lower().split() for t in texts_of(batch.column("_text")))
        for first, words in chunked(split):
            value, sizes = _sets(words, cache, width)
            yield batch, slice(first, first + len(words)), value, sizes, _keys(value, sizes)


def set_table(docs: DataFrame, rule: _Rule) -> DataFrame:
    """(doc_id, n, node, sketch) of every document; a task gives the sketch of equal sets once."""

    def work(batches):
        seen: set[int] = set()
        for batch, rows, value, sizes, keys in _walk(batches, rule.width):
            bands, ends = _band(np.maximum(sizes, 1)), np.cumsum(sizes)
            sketches = []
            for n, key, band, end in zip(sizes.tolist(), keys.tolist(), bands.tolist(), ends.tolist()):
                if n and key not in seen:
                    seen.add(key)
                    sketches.append(_sketch(value[end - n : end], band))
                else:
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], pa.array(sizes), pa.array(keys.view(np.int64)), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "node", "sketch"],
            )

    return docs.mapInArrow(work, "doc_id long, n long, node long, sketch binary")


def _postings(docs: DataFrame, rule: _Rule, buckets: int) -> DataFrame:
    """Signatures by bucket, packed: 48 further bits of each signature and runs of nodes."""

    def packed(sigs, owners, nodes):
        bucket = (sigs >> np.uint64(48)).astype(np.int64) * buckets >> 16
        order = np.argsort(bucket << 40 | owners)
        sigs, owners, bucket = sigs[order], owners[order], bucket[order]
        at = np.append(runs(bucket), len(bucket))
        out = ([], [], [], [], [])
        for s, e in zip(at[:-1], at[1:]):
            who = runs(owners[s:e])
            out[0].append(int(bucket[s]))
            out[1].append((sigs[s:e] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            out[2].append((sigs[s:e] >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            out[3].append(nodes[owners[s:e][who]].astype("<u8").tobytes())
            out[4].append(np.diff(np.append(who, e - s)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
            ["bucket", "low", "high", "nodes", "counts"],
        )

    def work(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        size = base = 0
        for _, _, value, sizes, keys in _walk(batches, rule.width):
            fresh = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if sizes[i] and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            value, some, own = value[np.repeat(fresh, sizes)], sizes[fresh], keys[fresh]
            if not len(some):
                continue
            doc, sig = _signatures(value, some, rule)
            held.append((sig, doc + base, own))
            base += len(own)
            size += len(sig)
            if size >= FLUSH:
                yield packed(*(np.concatenate(x) for x in zip(*held)))
                held, size, base = [], 0, 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held)))

    return docs.mapInArrow(work, "bucket int, low binary, high binary, nodes binary, counts binary")


def _groups(postings: DataFrame, tasks: int) -> DataFrame:
    """(members, node) for signatures of two sets or more. ``members`` names a group by a hash of
    its nodes, so signatures with the same nodes are one group.
    """

    def work(batches):
        sigs, nodes = [], []
        for batch in batches:
            for bucket, low, high, who, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                s = np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)
                sigs.append(s | np.uint64(bucket) << np.uint64(48))
                nodes.append(np.repeat(np.frombuffer(who, "<u8"), np.frombuffer(counts, "<u4")))
        if not sigs:
            return
        sig, node = np.concatenate(sigs), np.concatenate(nodes).view(np.int64)
        del sigs, nodes
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        at = runs(sig)
        count = np.diff(np.append(at, len(sig)))
        keep = np.repeat(count > 1, count)
        sig, node = sig[keep], node[keep]
        if not len(sig):
            return
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)  # tasks do not know of each other's copies
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        at = runs(sig)
        count = np.diff(np.append(at, len(sig)))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), at) + count.astype(np.uint64)).view(np.int64)
        good = count > 1
        # The same members often share many signatures: keep one of the task.
        _, once = np.unique(name, return_index=True)
        one = np.zeros(len(name), bool)
        one[once] = True
        good &= one
        rows = np.repeat(good, count)
        name, node = np.repeat(name, count)[rows], node[rows]
        for s in range(0, len(node), 100_000):
            e = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(name[e]), pa.array(node[e])], ["members", "node"])

    return postings.repartition(tasks, "bucket").mapInArrow(work, "members long, node long").distinct()


def _large(rows: DataFrame, shingles: Column) -> DataFrame:
    """(family, _blocks) of the families that need several blocks."""
    load = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum(shingles) / F.lit(BLOCK_SHINGLES))
    return rows.groupBy("family").agg(F.ceil(load).cast("int").alias("_blocks")).where(F.col("_blocks") > 1)


def _compared(rows: DataFrame, content: DataFrame, large: DataFrame, rule: _Rule, exact: bool) -> DataFrame:
    """Spanning forests (u, v) of the linked pairs inside each ``family`` of rows (family, node), in blocks of bounded size.

    ``content`` has what is compared of each node; it joins last, so it is sent to the blocks once. ``large`` has the number of blocks of families with more than one. Without ``exact`` a pair counts as linked unless sizes or sketches rule it out; with it the full sets decide.
    """
    keys = ["family", "_low", "_high"]
    cut = (
        rows.select("family", "node")
        .join(large, "family", "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("family", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "node")
    )
    names = ["node", "n", "sketch", *(["shingles"] if exact else [])]
    met = cut.join(content, "node").select(*keys, "_block", *names)

    def forest(part: pa.Table) -> pa.RecordBatch:
        block, node, n = (part.column(x).to_numpy() for x in ("_block", "node", "n"))
        low, high = part.column("_low")[0].as_py(), part.column("_high")[0].as_py()
        sketches = part.column("sketch").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()] if exact else []
        size = np.fromiter(map(len, sketches), np.int64, len(sketches))
        root = np.arange(len(node))
        us, vs = [], []
        for width in np.unique(size).tolist():
            # Each set against those whose sketch is as long or the next length: others differ too much in size.
            near = np.flatnonzero((size == width) | (size == 2 * width))
            bits = np.stack([_folded(np.frombuffer(sketches[i], np.uint8), width) for i in near]).view(np.uint64)
            for k in np.flatnonzero(size[near] == width).tolist():
                i = near[k]
                ok = (root[near] != root[i]) & ((size[near] > width) | (node[near] > node[i]))
                if low != high:
                    ok &= block[near] != block[i]
                a, b = n[near], n[i]
                ok &= rule.num * np.maximum(a, b) <= rule.den * np.minimum(a, b)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                at = at[np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1) <= rule.most_apart(n[near[at]] + n[i])]
                for j in near[at].tolist():
                    if root[j] == root[i]:
                        continue
                    if exact:
                        both = np.concatenate((sets[i], sets[j]))
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        if not rule.linked(common, len(sets[i]), len(sets[j])):
                            continue
                    root[root == root[j]] = root[i]
                    us.append(node[i])
                    vs.append(node[j])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    def small(sketches: list[bytes], node: list[int], n: list[int], us: list[int], vs: list[int]) -> None:
        """The same for a few rows of one block, without arrays."""
        bits = [int.from_bytes(x, "little") for x in sketches]
        width = [8 * len(x) for x in sketches]
        root = list(range(len(node)))
        for i in range(len(node)):
            for j in range(i):
                if root[i] == root[j] or rule.num * max(n[i], n[j]) > rule.den * min(n[i], n[j]):
                    continue
                x, y, w, v = bits[i], bits[j], width[i], width[j]
                while w > v:
                    w //= 2
                    x = x >> w ^ x & (1 << w) - 1
                while v > w:
                    v //= 2
                    y = y >> v ^ y & (1 << v) - 1
                if (x ^ y).bit_count() <= rule.most_apart(n[i] + n[j]):
                    old = root[j]
                    root = [root[i] if r == old else r for r in root]
                    us.append(node[i])
                    vs.append(node[j])

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            columns = [batch.column(x).to_pylist() for x in ("sketch", "node", "n")] if not exact else []
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            at = np.append(np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))), batch.num_rows)
            inner = (at[1:-1] if len(at) > 2 else at[:0]).tolist()  # these groups neither began before nor go on
            whole = {s for s, e in zip(inner[:-1], inner[1:]) if e - s <= SMALL and key[1, s] == key[2, s]} if not exact else set()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                if s in whole:
                    small(*(c[s:e] for c in columns), us, vs)
                    continue
                part = batch.slice(s, e - s)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                    yield forest(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(part)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], ["u", "v"])
        if held:
            yield forest(pa.Table.from_batches(held).combine_chunks())

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "u long, v long").distinct()


def _wanted(nodes: DataFrame) -> bytes:
    """Bit filter (fixed size) of ``nodes``: false hits cost time, never results."""
    words = nodes.select(F.pmod("node", F.lit(FILTER_BITS)).alias("_at")).groupBy(
        F.expr("shiftright(_at, 6)").alias("word")
    ).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        table[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return table.tobytes()


def _sets_of(docs: DataFrame, nodes: DataFrame, rule: _Rule) -> DataFrame:
    """(node, shingles) of the given nodes; perhaps some more, perhaps more than once."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))

    def fetch(batches):
        table = np.frombuffer(wanted.value, np.int64)
        seen: set[int] = set()
        for _, _, value, sizes, keys in _walk(batches, rule.width):
            node, ends = keys.view(np.int64), np.cumsum(sizes)
            at = node % FILTER_BITS
            hit = np.flatnonzero((sizes > 0) & ((table[at >> 6] >> (at & 63)) & 1 == 1)).tolist()
            once = {int(keys[i]): i for i in hit if int(keys[i]) not in seen}
            seen.update(once)
            hit = list(once.values())
            if hit:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[hit]), pa.array([value[ends[i] - sizes[i] : ends[i]].tobytes() for i in hit], pa.binary())],
                    ["node", "shingles"],
                )

    return docs.mapInArrow(fetch, "node long, shingles binary")


def similar_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.75
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of other than ASCII white space, with A-Z lower-cased. ``n_shingles`` is the number of
    distinct ``width``-word shingles (a shorter text is one shingle). Rows link when their sets have a
    Jaccard similarity of at least ``similarity``; ``component_id`` is the least id among the rows
    reachable by links. Null and empty texts are linked with nothing. Repeated ids keep one row each; a
    null id never names a component (a component of null ids only has null). Other columns of
    ``docs`` are ignored.
    """
    rule = _Rule(similarity, width)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    table = materialize(set_table(slim, rule), "shingle-sets")
    total = table.where(F.col("sketch").isNotNull()).agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * PER_TASK) + 1)
    nodes = table.where(F.col("sketch").isNotNull()).select("node", "n", "sketch").dropDuplicates(["node"])
    groups = materialize(_groups(_postings(slim, rule, min(4 * tasks, 1 << 16)), tasks), "groups")
    shared = groups.withColumnRenamed("members", "family")
    maybe = materialize(_compared(shared, nodes, _large(shared, F.lit(0)), rule, exact=False), "pairs")
    families = materialize(connected_components(maybe), "families")
    near = families.withColumnRenamed("component", "family")
    # Tasks may each have fetched a set: one row of each node goes on.
    sets = _sets_of(slim, families, rule).dropDuplicates(["node"])
    sizes = near.join(nodes.select("node", "n"), "node")
    links = materialize(_compared(near, nodes.join(sets, "node"), _large(sizes, F.col("n")), rule, exact=True), "links")
    found = materialize(connected_components(links), "components")

    own = table.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("node", "component").join(least, "component").select("node", "component_id")
    return table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose id names their component: one document of each group stays.

    Rows with a null id stay. Of rows that repeat an id of a group all have that id and stay or go
    together with it, except that exact repeats of id and text become one row.
    """
    named = materialize(similar_groups(docs, **options), "near-duplicates")
    gone = named.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if named.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(
        kept.where(F.col("doc_id").isNull())
    )
