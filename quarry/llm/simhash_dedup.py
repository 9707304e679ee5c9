"""SimHash near-dedup with pivot distance tables.

Every text has a 64-bit fingerprint. Distinct fingerprints that agree on a set of
bit blocks, of which any link within the distance leaves at least one untouched,
meet in a bucket: no link is lost. There a table holds each fingerprint's Hamming
distances to reference fingerprints (pivots). As |d(x, p) - d(y, p)| is at most
d(x, y), rows sorted by the first pivot's distance need only look a short way
ahead, pairs with a larger difference at any other pivot are discarded, and the
survivors are verified on the fingerprints themselves.

A pivot table alone would leave every pair of fingerprints to be compared, as
distances of unrelated values differ little; hence the buckets. Two kinds of
buckets are offered: near_duplicates() has those above, without loss, for a small
distance on 64 bits; similar_documents() has bands of random bits of a wider
fingerprint, for a Jaccard similarity, whose recall is a parameter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected
from quarry.llm.shared import materialize, per_text, release

#: Reference fingerprints, rows of a bucket that one group holds, pairs at a time.
PIVOTS, GROUP_ROWS, PAIRS = 12, 1024, 2_000_000
#: Shingles of a bucket's texts that one group holds, rows of them in a partition.
GROUP_SHINGLES, PARTITION_ROWS = 1_000_000, 20_000
#: Seconds that a row's shuffle and a compared pair are taken to cost.
ROW_COST, PAIR_COST = 1.5e-6, 1e-8
#: Shingles whose hashes are unpacked into bits at a time.
SHINGLES = 65_536


def pivots(lanes: int = 1, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, (n, lanes)."""
    return np.array([[xxhash.xxh64_intdigest(b"pivot %d %d" % (k, i), seed=42) for i in range(lanes)] for k in range(n)], dtype=np.uint64)


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's word shingles, A-Z lower-cased, in parts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        s, e = starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist()
        yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(s, e, strict=True)), dtype=np.uint64, count=len(s))


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of shingles: their hash, or the hash mixed with k."""
    if not k:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str, size: int, lanes: int = 1) -> np.ndarray:
    """64 * lanes bits that are set in over half of the shingles; 0 without words."""
    return voted(shingle_hashes(text, size), lanes)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, size), np.empty(0, np.uint64)]))


def voted(hashes: Iterable[np.ndarray], lanes: int) -> np.ndarray:
    """64 * lanes bits that are set in over half of the hashes, given in parts."""
    total, votes = 0, np.zeros((lanes, 64), dtype=np.int64)
    for h in hashes:
        for k in range(lanes):
            votes[k] += np.unpackbits(lane(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return np.packbits(2 * votes > total, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, *, shingle: int, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and fp, the fingerprint's bits as a long, of every whole text."""

    def make():
        return lambda texts: {"fp": np.array([simhash(t, shingle)[0] for t in texts], dtype=np.uint64).view(np.int64)}

    return per_text(docs, list(keep), text, make, "fp long")


def block_masks(distance: int, n: int) -> list[int]:
    """Bit masks of which any two fingerprints within distance agree on one.

    64 bits in b blocks: distance differing bits touch that many blocks at most,
    so some choice of b - distance blocks is untouched. More blocks make more,
    but wider masks; b is what costs least for n fingerprints."""

    def cost(b: int) -> float:
        width = 64 * (b - distance) / b
        return comb(b, distance) * (n * ROW_COST + n * n / 2 ** (width + 1) * PAIR_COST)

    b = min(range(distance + 1, min(distance + 6, 65)), key=cost)
    cuts = [64 * k // b for k in range(b + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, b - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest place that each of n places reaches by links left - right."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def close(bits: np.ndarray, group: np.ndarray, part: np.ndarray, lone: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row, row) within distance of rows with fingerprints bits (rows,
    lanes) that share a group, about PAIRS looked at at a time.

    Rows of a group that mixes two parts (lone false) meet across parts only."""
    lanes = bits.shape[1]
    table = np.stack([np.bitwise_count(bits ^ p).sum(axis=1, dtype=np.int16) for p in pivots(lanes)])
    order = np.lexsort((table[0], group))
    bits, group, part, lone, table = bits[order], group[order], part[order], lone[order], table[:, order]
    key = group * (128 * lanes) + table[0]
    ahead = np.searchsorted(key, np.minimum(key + distance, (group + 1) * (128 * lanes) - 1), side="right") - np.arange(len(key)) - 1
    begin, upto = 0, np.cumsum(ahead)
    while begin < len(key):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        n = ahead[begin:end]
        left = np.repeat(np.arange(begin, end), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        begin = end
        ok = lone[left] | (part[left] != part[right])
        left, right = left[ok], right[ok]
        for row in table[1:]:
            ok = np.abs(row[left] - row[right]) <= distance
            if not ok.all():
                left, right = left[ok], right[ok]
        apart = np.zeros(len(left), dtype=np.int16)
        for k in range(lanes):
            apart += np.bitwise_count(bits[left, k] ^ bits[right, k])
        ok = apart <= distance
        yield order[left[ok]], order[right[ok]]


def similar(ids: np.ndarray, size: np.ndarray, part: np.ndarray, lone: bool, similarity: float) -> list[tuple[int, int]]:
    """Links (row, row) that connect what all pairs of a group's rows with the Jaccard
    similarity or more connect: a pair is left out only if links join it already.

    ids: the rows' sets one after the other, size of them each. lone as in close()."""
    start, label, out = np.cumsum(size) - size, np.arange(len(size)), []
    ids = np.unique(ids, return_inverse=True)[1]
    held = np.zeros(len(ids), dtype=bool)
    for k in range(len(size) - 1):
        n = size[k + 1 :]
        ok = (label[k + 1 :] != label[k]) & (np.minimum(n, size[k]) >= similarity * np.maximum(n, size[k]))
        if not lone:
            ok &= part[k + 1 :] != part[k]
        other = k + 1 + np.flatnonzero(ok)
        if not len(other):
            continue
        own, n = ids[start[k] : start[k] + size[k]], size[other]
        first = np.cumsum(n) - n
        held[own] = True
        common = np.add.reduceat(held[ids[np.repeat(start[other] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        held[own] = False
        joined = other[common >= similarity * (size[k] + n - common)]
        if len(joined):
            out += [(k, j) for j in joined.tolist()]
            label[np.isin(label, label[joined])] = label[k]
    return out


def dealt(rows: DataFrame, groups: Column, parts: int) -> DataFrame:
    """rows (band, key, node and more) with part, i and j, in so many partitions sorted
    by band, key, i, j. A bucket over 1 of groups (an aggregate of rows) is dealt to as
    many parts, and each pair of parts is a group of its own."""
    columns = rows.columns
    sizes = rows.groupBy("band", "key").agg(F.ceil(groups).cast("int").alias("parts")).filter("parts > 1")
    large = materialize(sizes, "large-buckets")
    if large.isEmpty():
        rows = rows.select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"))
    else:
        rows = rows.join(large, ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
        rows = rows.select(*columns, "part", other).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")}).drop("o")
    return rows.repartition(parts, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")


GROUP = ("band", "key", "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in which no group is cut, with the number of each row's group."""

    def numbers(t: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=np.int64)
        for c in GROUP:
            x = t.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch if held is None else pa.concat_batches([held, batch])
        number = numbers(t)
        cut = int(np.searchsorted(number, number[-1]))  # the last group may go on in the next batch
        if cut:
            yield t.slice(0, cut), number[:cut]
        held = t.slice(cut)
    if held is not None:
        yield held, numbers(held)


def bucketed(rows: DataFrame, n: int, bands: int) -> DataFrame:
    """rows (band, key, node, bits) of n nodes in so many bands, dealt by their number."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * bands // 2_000_000)
    return dealt(rows, F.count("*") / GROUP_ROWS, parts).select(*GROUP, "part", "node", "bits")


def near_pairs(t: pa.RecordBatch, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """close() of a batch of bucketed()."""
    bits = t.column("bits")
    if pa.types.is_binary(bits.type):
        bits = np.frombuffer(b"".join(bits.to_pylist()), dtype="<u8").reshape(t.num_rows, -1)
    else:
        bits = bits.to_numpy().view(np.uint64).reshape(-1, 1)
    return close(bits, group, t.column("part").to_numpy(), t.column("i").to_numpy() == t.column("j").to_numpy(), distance)


def links(rows: DataFrame, n: int, bands: int, distance: int) -> DataFrame:
    """(a, b): links within distance between nodes that share a bucket, as many as are
    needed to connect what all of them connect.

    rows: band, key, node (long) and bits (long, or binary of several lanes);
    n nodes in so many bands."""

    def run(batches):
        for t, group in whole_groups(batches):
            node = t.column("node").to_numpy()
            for left, right in near_pairs(t, group, distance):
                label = forest(left, right, t.num_rows)
                a = np.flatnonzero(label != np.arange(t.num_rows))
                a, b = node[a], node[label[a]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return bucketed(rows, n, bands).mapInArrow(run, "a long, b long").distinct()


def meetings(rows: DataFrame, n: int, bands: int, distance: int) -> DataFrame:
    """(band, key, node): nodes with another one within distance in that bucket, of
    rows as in links()."""

    def run(batches):
        for t, group in whole_groups(batches):
            met = np.zeros(t.num_rows, dtype=bool)
            for left, right in near_pairs(t, group, distance):
                met[left] = met[right] = True
            yield t.select(["band", "key", "node"]).filter(pa.array(met))

    return bucketed(rows, n, bands).mapInArrow(run, "band int, key long, node long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component_id) of nodes (node, first): the smallest node reachable,
    by which components are told apart, and the smallest first reachable."""
    edges = materialize(edges, "links")
    if edges.isEmpty():
        return materialize(nodes.select("node", F.col("node").alias("root"), F.col("first").alias("component_id")), "components")
    member = materialize(connected(edges), "members").withColumnRenamed("node", "own")
    release(edges)
    of = materialize(nodes.join(member, F.col("node") == F.col("own"), "left").select("node", "first", "root"), "rooted")
    # only nodes with a link need to look at others
    linked = of.filter("root IS NOT NULL")
    # written, so that the join with it may split a large component's rows
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    alone = of.filter("root IS NULL").select("node", F.col("node").alias("root"), F.col("first").alias("component_id"))
    out = materialize(linked.join(least, "root").select("node", "root", "component_id").unionByName(alone), "components")
    release(of, member, least)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 4, distance: int = 4, keep: list[str] = (), text: str = "text") -> DataFrame:
    """doc_id, keep columns, fp and component_id of every row of docs.

    component_id is the smallest doc_id that links within distance reach. Equal
    fingerprints are one node of the graph. A text without words (null, empty)
    has fingerprint zero, linked like any other. A null doc_id counts only where
    a component has no other; repeated rows each give a row; an empty table gives
    none; other columns are left out.
    """
    prints = materialize(fingerprints(docs, shingle=shingle, keep=["doc_id", *keep], text=text), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first")), "nodes")
    n = nodes.count()
    masks = block_masks(distance, n)
    blocks = F.array(*(F.col("node").bitwiseAND(F.lit(signed(m))) for m in masks))
    rows = nodes.select("node", F.col("node").alias("bits"), F.posexplode(blocks).alias("band", "key"))
    own = components(nodes, links(rows, n, len(masks), distance).select("a", "b"))
    return prints.join(own, F.col("fp") == F.col("node")).select("doc_id", *keep, "fp", "component_id")


def bands_for(n: int, agree: float, recall: float) -> tuple[int, int]:
    """(bits in a band, bands) such that two fingerprints whose bits agree with
    probability agree share a band with probability recall, and a band's buckets
    hold some tens of n unrelated fingerprints."""
    bits = max(12, math.ceil(math.log2(max(n, 1))) - 6)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def tail(n: int, p: float, most: int) -> float:
    """Chance that more than most of n bits differ, each with probability p."""
    return 1 - math.fsum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1))


def bound_for(bits: int, p: float, recall: float) -> tuple[int, float]:
    """(most differing bits, recall that is left to the bands) such that both together
    give recall: three deviations or more, and at most a fifth of the loss."""
    most = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    while tail(bits, p, most) > (1 - recall) / 5:
        most += 1
    return most, recall / (1 - tail(bits, p, most))


def similar_documents(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, lanes: int = 8, recall: float = 0.99, text: str = "text") -> DataFrame:
    """doc_id, hash, root and component_id of every row of docs that has words: groups
    of texts whose shingle sets have a Jaccard similarity of about similarity or more.
    hash is the XXH64 of the text, root tells groups apart.

    A text is its set of shingles: each votes once for the SimHash bits, however often
    it occurs, and only texts with one set are one node of the graph.
    Sets of similarity s have cosine 2s / (1 + s), and a SimHash bit of theirs
    differs with probability angle / pi: over 64 * lanes bits that gives a mean
    distance and its deviation. Texts up to three deviations or more above it that
    share a band are compared by their shingles, all of them but those already joined. What
    the bound loses at the similarity the bands make up for: recall is of both.
    Texts shorter than a shingle have one shingle, the whole text; rows without
    words are left out, as nothing can be said of them. component_id is as in
    near_duplicates().
    """
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bound, banded = bound_for(64 * lanes, angle, recall)

    def make():
        def run(texts):
            out = {"bits": [], "fp": [], "empty": []}
            for t in texts:
                own = shingle_set(t, shingle)
                out["bits"].append(voted((own[k : k + SHINGLES] for k in range(0, len(own), SHINGLES)), lanes).tobytes())
                out["fp"].append(node_of(own))
                out["empty"].append(not len(own))
            return out

        return run

    source = docs.select("doc_id", F.xxhash64(F.col(text).cast("string")).alias("hash"), text)
    prints = per_text(source, ["doc_id", "hash"], text, make, "bits binary, fp long, empty boolean").filter("NOT empty")
    prints = materialize(prints.select("doc_id", "hash", "bits", "fp"), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits")), "nodes")
    n = nodes.count()
    width, bands = bands_for(n, 1 - angle, banded)
    chosen = np.random.default_rng(42).permuted(np.tile(np.arange(64 * lanes), (bands, 1)), axis=1)[:, :width]
    weight = 1 << np.arange(width, dtype=np.int64)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                each = np.unpackbits(raw, axis=1, bitorder="little")
                for k, places in enumerate(chosen):
                    key = each[:, places].astype(np.int64) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k, np.int32)), pa.array(key), part.column(0), part.column(1)], ["band", "key", "node", "bits"])

    rows = nodes.select("node", "bits").mapInArrow(run, "band int, key long, node long, bits binary")
    met = materialize(meetings(rows, n, bands, bound), "meetings")
    own = components(nodes, confirmed(docs, nodes, met, shingle, similarity, text))
    return prints.join(own, F.col("fp") == F.col("node")).select("doc_id", "hash", "root", "component_id")


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), seed=42))


def confirmed(docs: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int, similarity: float, text: str) -> DataFrame:
    """Links (a, b) that connect what all pairs of nodes connect that share a bucket of
    met and whose shingle sets have the similarity or more.

    Only texts of nodes in met are read for it: one per node, as 32-bit hashes."""

    def make():
        def run(texts):
            own = [shingle_set(t, shingle) for t in texts]
            return {"own": [node_of(x) for x in own], "s": [np.unique(x.astype(np.uint32)).view(np.int32) for x in own]}

        return run

    wanted = materialize(met.select("node").distinct().join(nodes.select("node", "first"), "node"), "wanted")
    ids = wanted.select(F.col("first").alias("wanted_id")).distinct()
    chosen = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = per_text(chosen, [], text, make, "own long, s array<int>")
    sets = sets.join(wanted, F.col("own") == F.col("node"), "left_semi").groupBy(F.col("own").alias("node")).agg(F.first("s").alias("s"))
    rows = met.join(materialize(sets, "shingle-sets"), "node").select("band", "key", "node", "s")

    def run(batches):
        for t, group in whole_groups(batches):
            node, part, lone = t.column("node").to_numpy(), t.column("part").to_numpy(), t.column("i").to_numpy() == t.column("j").to_numpy()
            size = t.column("s").value_lengths().to_numpy().astype(np.int64)
            ids, upto = t.column("s").flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [t.num_rows]]).tolist()
            out = []
            for x, y in itertools.pairwise(cuts):
                out += [(x + a, x + b) for a, b in similar(ids[upto[x] : upto[y]], size[x:y], part[x:y], lone[x], similarity)]
            if out:
                a, b = node[np.array(out)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // PARTITION_ROWS)
    load = F.greatest(F.count("*") / GROUP_ROWS, F.sum(F.size("s")) / GROUP_SHINGLES)
    return dealt(rows, load, parts).select(*GROUP, "part", "node", "s").mapInArrow(run, "a long, b long").distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
