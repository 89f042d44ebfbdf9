"""N-gram Jaccard self-join by chosen paths.

Texts are sets of word shingles; a set is represented by ``COORDS`` minwise tokens.  In each of ``RUNS`` runs the
sets are split on sampled tokens: sets that agree on a sampled coordinate go down the same path.  A bucket
of at most ``LIMIT`` sets is compared by brute force on the sketches; a larger one is split again on tokens
sampled for it, until none is left.  About 1/threshold tokens are sampled at each node, so a pair at the threshold is
expected to survive a split; the runs are repeated until a pair at the threshold is found with more than the target recall.

A large bucket of real near duplicates would not fall apart.  So each large bucket compares its sets with one of them, its
centre: sets whose sketch agrees with the centre's in ``threshold`` or more are settled, they become links to the centre and
are split no further.  Agreement is a metric: a set that agrees with a settled one in the candidates' floor or more
agrees with the centre in threshold + floor - 1 at least, so all sets of the bucket from there on are linked to the
centre too (those that are not settled are split on) and no candidate pair is lost.  Each split settles a centre at least.

Sets whose sketches nearly agree form candidate groups (connected components).  Within a group every pair is
verified by its exact Jaccard similarity in tiles of at most ``TILE`` sets, each pair in one tile; tiles give
one row per set (its links counted, and one link towards the tile's smallest set of its class), never one
per pair.  Equal texts are collapsed first and counted.

What may be missed: a pair at the threshold agrees in under threshold - ``SLACK`` of its tokens with probability 1.3e-4, the
same sketch for all runs; a pair that does agree is in no common small bucket of any run with probability 2e-4 or less.

Nulls and short texts: a text of fewer words than a shingle is one shingle; a NULL or empty text and a NULL key have
no links.  Rows with equal keys count as one document whose links are united.  Empty tables give empty tables.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seasonlens.llm.components import connected_components
from seasonlens.llm.substrings import _text_hashes
from seasonlens.llm.words import WHITE, mix, signed, split_words, text_chunks, windows
from seasonlens.llm.store import map_texts, stored

SHINGLE = 5
THRESHOLD = 0.8
COORDS = 64
RUNS = 12
LIMIT = 192
TILE = 512
#: Sets of one large bucket that are measured in one place.
SALT_SETS = 20_000
#: Sketch agreement from which sets are candidates: four standard errors under the threshold.
SLACK = 0.2
PAIRS = 100_000
_MUL = np.random.default_rng(7).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(8).integers(1, 2**63, COORDS, dtype=np.uint64)


def _shingles(data, off, size: int):
    """(words, flat shingle hashes, offsets of the texts into them)."""
    w = split_words(data, off, WHITE)
    h, n = w.hashes(), w.counts
    g = np.concatenate([windows(h, size), np.zeros(min(size - 1, w.n), np.uint64)])
    ok = w.remaining() >= size
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        t1, _ = _text_hashes(h, w.first)
        g[w.first[few]] = t1[few]
        ok[w.first[few]] = True
    seen = np.concatenate([[0], np.cumsum(ok)])
    return w, h, g[ok], seen[w.first]


def _sketches(size: int) -> Callable:
    def scan(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                w, h, g, at = _shingles(data, off, size)
                t1, t2 = _text_hashes(h, w.first)
                sk = np.zeros((hi - lo, COORDS), np.int32)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for i in range(COORDS):
                        least = np.minimum.reduceat((g ^ _XOR[i]) * _MUL[i], at[full])
                        sk[full, i] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), signed(t1), signed(t2), w.counts,
                    pa.FixedSizeListArray.from_arrays(pa.array(sk.ravel()), COORDS).cast(pa.list_(pa.int32()))],
                    names=["key", "t1", "t2", "n_words", "sketch"])
    return scan


def _groups(batches):
    """Batches cut so that a group (first column, sorted) is never split; groups are bounded by their tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1], "left")) if ids[0] != ids[-1] else 0
        if cut == 0 and held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != ids[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return root


def _pairs(group: np.ndarray):
    """Index pairs (a < b) inside each sorted group, in slices."""
    end = np.searchsorted(group, group, "right")
    n = end - np.arange(len(group)) - 1
    upto = np.cumsum(n)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        flat = np.arange(lo, min(lo + PAIRS, int(upto[-1])))
        a = np.searchsorted(upto, flat, "right")
        yield a, a + 1 + flat - (upto[a] - n[a])


def _candidates(floor: float) -> Callable:
    """Rows (path, rep, bits): links between sets whose sketches agree, one per set towards its root."""
    def scan(batches):
        for t in _groups(batches):
            path, rep = (t.column(i).to_numpy() for i in range(2))
            bits = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, COORDS)
            xs, ys = [], []
            for a, b in _pairs(path):
                near = (bits[a] == bits[b]).sum(axis=1) >= floor * COORDS
                xs.append(a[near])
                ys.append(b[near])
            if not xs:
                continue
            root = _roots(len(rep), np.concatenate(xs), np.concatenate(ys))
            own = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], names=["u", "v"])
    return scan


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    values, inv, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[inv]
    out = np.zeros((m, m))
    keep = place >= 0
    row, place = row[keep], place[keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    block = 8192
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, block):
        a, b = np.searchsorted(place, [lo, lo + block])
        x = np.zeros((m, block), np.float32)
        x[row[a:b], place[a:b] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _verified(size: int, threshold: float) -> Callable:
    """Rows (tile, side, rep, copies, t1, text): links of each set in its tile."""
    def scan(batches):
        for t in _groups(batches):
            tile, side, rep, copies, want = (t.column(i).to_numpy() for i in range(5))
            text = t.column(5)
            edges = np.flatnonzero(np.diff(tile)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(tile)]):
                if hi - lo < 2:
                    continue
                sets, seen = {}, []
                for x, _, data, off in text_chunks(text.slice(lo, hi - lo)):
                    w, h, g, at = _shingles(data, off, size)
                    t1 = signed(_text_hashes(h, w.first)[0])
                    for r in range(len(off) - 1):  # of rows that share a key, the text meant, once
                        i = lo + x + r
                        if t1[r] == want[i] and (rep[i], want[i]) not in sets:
                            sets[rep[i], want[i]] = np.unique(g[at[r]:at[r + 1]])
                            seen.append(i)
                sets, m, seen = list(sets.values()), len(seen), np.array(seen, np.int64)
                if m < 2:
                    continue
                mine = rep[seen]
                both, n = _overlaps(sets), np.array([len(s) for s in sets])
                union = n[:, None] + n[None, :] - both
                # exact comparison of both/union with the threshold, as a ratio of whole numbers
                link = (both * 1_000_000 >= union * round(threshold * 1_000_000)) & ~np.eye(m, dtype=bool)
                s = side[seen]
                link &= (s[:, None] < 0) | (s[:, None] != s[None, :])
                a, b = np.nonzero(link)
                order = np.argsort(mine, kind="stable")
                rank = np.empty(m, np.int64)
                rank[order] = np.arange(m)
                root = mine[order][_roots(m, rank[a], rank[b])[rank]]
                got = link @ copies[seen]
                own = np.flatnonzero(got > 0)
                yield pa.RecordBatch.from_arrays([pa.array(mine[own]), pa.array(got[own].astype(np.int64)), pa.array(root[own])],
                                                 names=["rep", "links", "root"])
    return scan


def _tiled(rows: DataFrame, group: str, rest: list[str], limit: int) -> DataFrame:
    """tile, side and rest: groups up to limit as they are (side -1), larger ones as all pairs of chunks of half
    of limit; rows has the group's size as ``n``."""
    chunks = F.ceil(F.col("n") / (limit // 2)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("tile"), "rep"), chunks.cast("long")).cast("int")
    small = rows.filter(F.col("n") <= limit).select(F.xxhash64(group).alias("tile"), F.lit(-1).alias("side"), *rest)
    big = rows.filter(F.col("n") > limit).select(group, mine.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"), *rest)
    lo, hi = F.least("c", "o"), F.greatest("c", "o")
    big = big.select(F.xxhash64(group, lo, hi).alias("tile"), F.when(F.col("c") == F.col("o"), -1).otherwise((F.col("c") > F.col("o")).cast("int")).alias("side"), *rest)
    return small.unionByName(big)


def _paths(classes: DataFrame, runs: int, limit: int, floor: float, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(path, rep) of the buckets of 2 to limit sets at which splitting ends, and the links (u, v) to centres of larger ones."""
    def buckets(rows: DataFrame) -> DataFrame:
        rows = stored(rows, "paths")
        return rows.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "path")

    def down(rows: DataFrame) -> DataFrame:
        """One sampled token of the node, and a second one at every fourth: 1.25 on average."""
        pick = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "path"), F.lit(COORDS)).cast("int")
        two = F.pmod(F.xxhash64(F.lit(seed + 9), "path"), F.lit(4)) == 0
        picks = F.when(two, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))
        return rows.withColumn("_i", F.explode(picks)).select(
            F.xxhash64("path", "_i", F.get("sketch", F.col("_i"))).alias("path"), "rep")

    def measured(wide: DataFrame) -> DataFrame:
        """path, rep, sketch, centre and how many tokens each set has in common with it; a hot bucket is dealt over salts."""
        sets = wide.join(classes.select("rep", "sketch"), "rep").withColumn(
            "salt", F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(1) + F.floor(F.col("n") / SALT_SETS)).cast("int"))
        centre = sets.groupBy("path").agg(F.min(F.struct("rep", "sketch")).alias("c"), F.max("n").alias("n")) \
            .select("path", "c", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SALT_SETS).cast("int"))).alias("salt"))
        same = F.aggregate(F.zip_with("sketch", "c.sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return stored(sets.join(centre, ["path", "salt"]).select("path", "rep", "sketch", F.col("c.rep").alias("centre"), same.alias("same")), "measured")

    roots = F.explode(F.array(*[F.lit(seed * 1000 + r).cast("long") for r in range(runs)]))
    level = buckets(down(classes.select("rep", "sketch", roots.alias("path"))))
    leaves, links = level.filter(F.col("n") <= limit).select("path", "rep"), []
    while not (wide := stored(level.filter(F.col("n") > limit), "wide")).isEmpty():
        seen = measured(wide)
        links.append(seen.filter((F.col("same") >= COORDS * (threshold + floor - 1)) & (F.col("rep") != F.col("centre")))
                     .select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct())
        level = buckets(down(seen.filter(F.col("same") < COORDS * threshold)))
        leaves = leaves.unionByName(level.filter(F.col("n") <= limit).select("path", "rep"))
    none = classes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)
    return leaves, functools.reduce(DataFrame.unionByName, links, none)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
                    runs: int = RUNS, limit: int = LIMIT, seed: int = 3) -> DataFrame:
    """key, class_id (smallest key of the connected class), n_links (other documents at the threshold or over):
    one row per input row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = stored(map_texts(rows, _sketches(size), "key long, t1 long, t2 long, n_words long, sketch array<int>"), "sketches")
    classes = stored(known.filter(F.col("key").isNotNull() & (F.col("n_words") > 0)).groupBy("t1", "t2").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")), "classes")

    floor = threshold - SLACK
    leaves, central = _paths(classes, runs, limit, floor, threshold, seed)
    bits = classes.select("rep", F.unhex(F.array_join(F.transform("sketch", lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), "")).alias("bits"))
    near = leaves.join(bits, "rep").select("path", "rep", "bits").repartition("path").sortWithinPartitions("path").mapInArrow(
        _candidates(floor), "u long, v long")
    member = connected_components(near.unionByName(central))
    member = stored(member.unionByName(member.select(F.col("root").alias("node"), "root").distinct()), "groups")
    sized = member.join(member.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").withColumnRenamed("node", "rep")

    # tiles are laid out on narrow rows; a text is shuffled to its key once and once more to each of its tiles
    firsts = known.filter("n_words > 0").join(classes.select("t1", "t2", F.col("rep").alias("key"), "copies"), ["t1", "t2", "key"]) \
        .select(F.col("key").alias("rep"), "t1", "copies").distinct()
    tiles = _tiled(sized.join(firsts, "rep"), "root", ["rep", "copies", "t1"], TILE)
    tiles = rows.withColumnRenamed("key", "rep").join(tiles, "rep")
    found = stored(map_texts(
        tiles.select("tile", "side", "rep", "copies", "t1", "text").repartition("tile").sortWithinPartitions("tile"), _verified(size, threshold), "rep long, links long, root long"), "verified")
    # a class inside one tile is settled there; classes over several tiles meet through their links
    meet = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(meet.withColumnRenamed("node", "rep"), "rep", "left")

    per = known.select("key", "t1", "t2").join(classes.select("t1", "t2", "rep", "copies"), ["t1", "t2"], "left").join(linked, "rep", "left")
    alone = F.col("key").isNull() | F.col("rep").isNull()
    return per.select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.coalesce("root", "rep")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose key is the smallest of their class; rows with equal keys and a NULL key stay."""
    found = near_duplicates(docs, key, text, **options).filter(F.col(key) != F.col("class_id")).select(key).distinct()
    return docs.join(found, key, "left_anti").select(docs.columns)
