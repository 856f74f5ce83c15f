"""SimHash near-duplicates: 64-bit fingerprints, linked by forests of BK-trees.

Two fingerprints that differ in at most 4 bits agree on one of 5 blocks of bits; a shard is one value of one block.  Every
shard has BK-trees of at most NODES nodes: the children of a node are keyed by their Hamming distance to it, and a search
with radius r that is at distance d from a node follows the edges d-r..d+r only.  Shards with more fingerprints are split
by the same argument on the bits that are left, and what is still larger gets several trees, each probed by the whole
shard.  The trees travel to the tasks of their shard and not by a broadcast variable, as fingerprints grow with the corpus.

A shard reports a star per group of linked fingerprints and never its pairs; the stars are joined into components.

``similar_texts`` links texts by the Jaccard similarity of their shingle sets.  At 0.8 fingerprints differ in about 10 of 64
bits and in up to WIDE; blocks of bits are no shards for so wide a radius, so shards are the buckets of MinHash bands: BANDS
bands of ROWS minima, which a pair at 0.8 misses with a chance of (1 - 0.8^ROWS)^BANDS = 1.3e-7.  In a shard the fingerprints
within the radius are candidates, and the sets themselves decide.  First every member is tried with one of its shard, then,
where members are still in different components, with another one (every band has a shard of its own, so a text is tried
with many, by a sketch of 1024 more minima before the sets); for what is left BK-trees over the shard find all pairs across components, of which the sketch rules out most that the sets would.
So each pair that meets is compared
or already linked, and a group of copies that are alike in part costs no more than some stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles
from .common import saved, table
from .components import components, contracted

RADIUS = 4
NODES = 2048
#: Queries that walk the trees at once, and fingerprints of one shard that look into a tree in one task.
SLICE, QUERIES = 4096, 65536
#: Queries of which all pairs within the radius are held.
PAIRED = 256
#: Bits in which the fingerprints of texts of a similarity of 0.8 may differ: five standard deviations above their mean.
WIDE = 26


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of the word shingles of a text, as an unsigned number."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8")
    for at in range(0, len(h), 1 << 16):  # bounded memory for a text of any length
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


class Forest:
    """BK-trees over all shards that meet in one task: arrays, built and searched level by level."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """``shard``: the number of the tree that each value belongs to, from 0 without gaps."""
        self.values = values
        self.roots = np.full(int(shard.max(initial=-1)) + 1, -1, np.int64)
        keys, nodes = [], []
        left, group = np.arange(len(values)), shard.astype(np.int64)
        above = None  # (parent, distance) of each group, as one key
        while len(left):
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            head = left[first]
            if above is None:
                self.roots[group[first]] = head
            else:
                keys.append(above[order][first])
                nodes.append(head)
            parent = np.repeat(head, np.diff(np.append(np.flatnonzero(first), len(left))))
            left, parent = left[~first], parent[~first]
            above = parent * 65 + np.bitwise_count(values[left] ^ values[parent]).astype(np.int64)
            _, group = np.unique(above, return_inverse=True)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.nodes = self.keys[order], (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a query, node) at most ``radius`` apart."""
        who, node = np.arange(len(queries)), roots
        who, node = who[node >= 0], node[node >= 0]
        found_q, found_n = [], []
        while len(who):
            d = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found_q.append(who[near])
            found_n.append(node[near])
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            who, node = np.repeat(who, n), self.nodes[at]
        return np.concatenate(found_q) if found_q else np.zeros(0, np.int64), np.concatenate(found_n) if found_n else np.zeros(0, np.int64)


def _stars(values: np.ndarray, shard: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints of whole shards: those linked to others, each with one of its group in this shard.

    ``node``: whether a value is in the shard's tree or only looks its neighbours up there.
    """
    inside = np.flatnonzero(node)
    forest = Forest(values[inside], shard[inside])
    parent = list(range(len(values)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = np.arange(len(values))
    for at in range(0, len(values), SLICE):
        s = slice(at, at + SLICE)
        roots = np.where(shard[s] < len(forest.roots), forest.roots[np.minimum(shard[s], len(forest.roots) - 1)], -1) if len(forest.roots) else np.full(len(shard[s]), -1)
        q, n = forest.search(values[s], roots, radius)
        a, b = label[q + at], label[inside[n]]
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if apart.any():
            label = np.array([top(x) for x in label.tolist()])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _linked(radius: int):
    def link(rows: pa.Table) -> pa.RecordBatch:
        """Stars of the linked fingerprints of whole shards."""
        _, shard = np.unique(rows["shard"].to_numpy(), return_inverse=True)
        values = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = _stars(values, shard, rows["member"].to_numpy().astype(bool), radius)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    return link


def _across(radius: int):
    def link(rows: pa.Table) -> pa.RecordBatch:
        """Pairs of nodes (u > v) of one shard and of different roots whose fingerprints, and sketches, are near enough."""
        _, shard = np.unique(rows["shard"].to_numpy(), return_inverse=True)
        values = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        node, root = (rows[c].to_numpy().astype(np.int64) for c in ("node", "root"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(values), -1)
        inside = np.flatnonzero(rows["member"].to_numpy().astype(bool))
        forest = Forest(values[inside], shard[inside])
        own, lists = rows["own_bucket"].to_numpy(), rows["buckets"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        in_buckets = np.full((len(own), int(sizes.max(initial=1))), -(2**31), np.int32)  # no bucket's number
        in_buckets[np.repeat(np.arange(len(own)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(values), PAIRED):
            here = np.arange(at, min(at + PAIRED, len(values)))
            known = shard[here] < len(forest.roots)
            q, n = forest.search(values[here[known]], forest.roots[shard[here[known]]], radius) if len(forest.roots) else (np.zeros(0, np.int64),) * 2
            q, n = here[known][q], inside[n]
            apart = root[q] != root[n]
            q, n = q[apart], n[apart]
            near = np.bitwise_count(sketch[q] ^ sketch[n]).sum(1, dtype=np.int64) <= shingles.APART
            q, n = q[near], n[near]
            # a pair of several buckets is told by the least of them
            first = np.zeros(len(q), bool)
            for i in range(0, len(q), SLICE):
                a, b = in_buckets[q[i : i + SLICE]], in_buckets[n[i : i + SLICE]]
                shared = ((a[:, :, None] == b[:, None, :]) & (a != -(2**31))[:, :, None]).any(2)
                first[i : i + SLICE] = np.where(shared, a, 2**31 - 1).min(1) == own[q[i : i + SLICE]]
            u, v = node[q[first]], node[n[first]]
            found.append(np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return link


def _probe(link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, fp, ...) come by shard; whole shards are linked together, some at a time."""
        kept: list[pa.RecordBatch] = []

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if cut or (kept and len(shard) and shard[0] != kept[-1].column(0)[0].as_py()):
                # a shard may end on the border of two batches, where cut is 0
                yield link(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            if len(shard):
                kept.append(batch.slice(cut))
        if kept:
            yield link(pa.Table.from_batches(kept))

    return run


def _blocks(fp, bits: list[tuple[int, int]]):
    """The values of the given (start, width) ranges of bits, each with its number."""
    return F.array(*[F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1) + F.lit(i << 52) for i, (at, width) in enumerate(bits)])


def _ranges(start: int, bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [start + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _spread(rows: DataFrame, shard: list[str], own: str, nodes: int) -> DataFrame:
    """``rows`` with (shard, member): a shard of more than ``nodes`` rows gets several trees, and slices of questions.

    ``own`` names a row.  A row is a member of one tree, and each slice of a shard's rows looks into each of its trees.
    """
    counted = rows.groupBy(*shard).count().where(F.col("count") > nodes)
    sizes = saved(counted.select(*shard, F.ceil(F.col("count") / nodes).cast("int").alias("trees"), F.ceil(F.col("count") / QUERIES).cast("int").alias("slices")))
    others = [c for c in rows.columns if c not in shard]
    if sizes.isEmpty():  # one tree each
        return rows.select(F.xxhash64(*shard).alias("shard"), *others, F.lit(True).alias("member"))
    rows_ = rows.join(sizes, shard, "left").na.fill(1, ["trees", "slices"])
    rows_ = rows_.withColumn("home", F.pmod(F.xxhash64(own), "trees")).withColumn("own", F.pmod(F.xxhash64(own, "trees"), "slices"))
    asked = rows_.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).withColumn("slice", F.col("own")).withColumn("member", F.col("tree") == F.col("home"))
    sent = rows_.where("slices > 1").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("slice != own").withColumn("tree", F.col("home")).withColumn("member", F.lit(True))
    return asked.unionByName(sent).select(F.xxhash64(*shard, "tree", "slice").alias("shard"), *others, "member")


def shards(fps: DataFrame, radius: int, nodes: int) -> DataFrame:
    """(shard, fp, member): each pair within the radius meets in a shard in whose tree one of the two is."""
    parts = radius + 1
    keyed = fps.select("fp", F.explode(_blocks(F.col("fp"), _ranges(0, 64, parts))).alias("key"))
    large = saved(keyed.groupBy("key").count().where(F.col("count") > nodes).select("key"))
    plain = lambda df: df.select(F.xxhash64("key").alias("shard"), "fp", F.lit(True).alias("member"))
    if large.isEmpty():
        return plain(keyed)
    # a large shard: what agrees on this block within the radius agrees on a block of the remaining bits as well
    small, big = keyed.join(large, "key", "left_anti"), keyed.join(large, "key")
    rotated, ranges = F.col("fp"), _ranges(0, 64, parts)
    rest = F.lit(None).cast("array<long>")
    for i, (at, width) in enumerate(ranges):
        turn = (at + width) % 64  # the block itself becomes the topmost bits
        turned = F.shiftleft(rotated, 64 - turn).bitwiseOR(F.shiftrightunsigned(rotated, turn)) if turn else rotated
        rest = F.when(F.shiftright("key", 52) == i, _blocks(turned, _ranges(0, 64 - width, parts))).otherwise(rest)
    finer = big.select("fp", "key", F.explode(rest).alias("finer"))
    return plain(small).unionByName(_spread(finer, ["key", "finer"], "fp", nodes))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, fp, root) come by bucket: each of a bucket but the first, with the first."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, *own = (batch.column(i).to_numpy() for i in range(4))
        first = np.concatenate([[before is None or bucket[0] != before[0]], bucket[1:] != bucket[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        heads = [x[np.maximum(at, 0)] for x in own]
        if at[0] < 0:
            heads = [np.where(at < 0, old, x) for old, x in zip(before[1:], heads, strict=True)]
        before = [bucket[-1], *(x[-1] for x in heads)]
        yield pa.RecordBatch.from_arrays([pa.array(x[~first]) for x in (bucket, *heads, *own)], names=MET.replace(" long", "").split(", "))


MET = "bucket long, head long, head_fp long, head_root long, node long, fp long, root long"
#: Turns of stars before all pairs are looked for, and rounds by which links are contracted between turns.
TURNS, ROUNDS = 2, 2


def _stars_of(members: DataFrame, turn: int) -> DataFrame:
    """Members (bucket, node, fp, root) beside the first one of their bucket in an order that depends on the turn."""
    order = F.col("node") if turn == 0 else F.xxhash64("bucket", "node", F.lit(turn))
    dealt = members.repartition("bucket").sortWithinPartitions("bucket", order, "node")
    return dealt.select("bucket", "node", "fp", "root").mapInArrow(_met, MET)


def similar_texts(docs: DataFrame, radius: int = WIDE, nodes: int = NODES, text: str = "text") -> DataFrame:
    """(u, v): each node (the name of a shingle set, see ``shingles``) that isn't the least of its component, and that least one.

    Two nodes are linked if they have at least ``shingles.SIMILARITY`` of their shingles in common.  Nulls and texts without
    words are one node; an empty table gives no rows.
    """
    rows = shingles.signed(docs, text)
    members = rows.select(F.explode("bands").alias("bucket"), "node", "fp", F.col("node").alias("root"))
    met = saved(_stars_of(members, 0))
    members = met.select("bucket", "node", "fp").unionByName(met.select("bucket", F.col("head").alias("node"), F.col("head_fp").alias("fp")).distinct())
    texts = shingles.texts(docs, members.select("node").distinct(), text)
    sketches = saved(shingles.sketches(texts))
    tried, edges = None, None
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))) <= radius
    pair = [F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")]
    for turn in range(TURNS + 1):
        if turn:
            # a root is a node of one's component, and not always the least: unlike roots may be linked, like ones are
            roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("r"))
            members = members.drop("root").join(roots, "node", "left").select("bucket", "node", "fp", F.coalesce("r", "node").alias("root"))
            open_ = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
            members = saved(members.join(open_, "bucket", "left_semi"))
            if members.isEmpty():
                break
        if turn < TURNS:
            found = (_stars_of(members, turn) if turn else met).where(near & (F.lit(turn == 0) | (F.col("root") != F.col("head_root")))).select(*pair)
        else:
            # a bucket's number, from 0, is half of its name: two that share it are told twice or by either
            number = F.shiftrightunsigned("bucket", 33).cast("int")
            own = members.groupBy("node").agg(F.collect_set(number).alias("buckets"))
            members = members.join(sketches.join(own, "node"), "node").withColumn("own_bucket", number)
            walked = _spread(members, ["bucket"], "node", nodes).repartition("shard").sortWithinPartitions("shard")
            found = walked.mapInArrow(_probe(_across(radius)), "u long, v long")
        found = found.distinct()
        found = saved(found if tried is None else found.join(tried, ["u", "v"], "left_anti"))
        tried = found if tried is None else tried.unionByName(found)
        linked = shingles.similar(shingles.near(found, sketches) if turn < TURNS else found, texts)
        edges = linked if edges is None else edges.unionByName(linked)
        if turn < TURNS:
            edges = contracted(edges, ROUNDS)
    return components(edges)


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the smallest id, then text hash.

    Documents are rows: an id that is repeated or null (the last) links nothing.  Rows that are alike in all columns are
    copies of one text, and one of them stays.  Other columns are carried along whatever their names.
    """
    names = docs.columns
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text])
    row = docs.select(F.col(text).alias("body"), F.col(doc_id).alias("number"), others.alias("row"))
    roots = similar_texts(docs, text=text).toDF("node", "root")
    rows = shingles.named(row, "body").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = [F.col("number").asc_nulls_last(), F.xxhash64("body"), F.length("body"), F.xxhash64("row")]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("place = 1")
    return first.select(*[(F.col("body") if c == text else F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(names)])


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, nodes: int = NODES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Words are runs of bytes outside ASCII white space, after A-Z are lower-cased; a text of fewer words than a shingle is
    one shingle, and a text of none (or null) has fingerprint zero and is linked like any other.  Repeated rows are rows
    of one component; a null id is never the smallest.  An empty table gives an empty result.  Two shards whose 64-bit
    names collide are searched as one, which can only test more pairs.
    """
    marked = saved(fingerprints(docs, words, doc_id, text))
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    dealt = shards(fps.select("fp"), radius, nodes).repartition("shard").sortWithinPartitions("shard")
    stars = components(dealt.mapInArrow(_probe(_linked(radius)), "u long, v long"))
    rooted = fps.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted)
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = saved(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
