"""Benchmark decontamination by winnowed fingerprints that are extended to maximal matches.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.  A fingerprint is the
smallest k-gram hash of each run of ``span - k + 1`` k-grams, so any ``span`` words shared by a document and
an item share a fingerprint; each shared fingerprint is extended both ways while the words agree, and
the match counts when it reaches ``span`` words.  An item of fewer words counts as a whole: its words are
looked up at every position of the document.

The benchmark is the stated query set: it is hashed into blocks of about ``block_words`` words (a block is
at most that or one item), each block is sent to the tasks, and every document passes through them, ``AT_ONCE`` in one task.
Documents are never shuffled or joined; each block adds to the hit spans and items that a row has so far.

Nulls: a NULL text has no words and no hits.  An item without words hits nothing; a NULL item_id hits, but
is not listed.  Every row has its own result, whatever its key and the number of blocks; equal rows get equal
results.  Empty tables give empty results or no hits.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seasonlens.llm.store import map_texts, set_aside, stored
from seasonlens.llm.words import LOWER, NOT_ALNUM, signed, split_words, text_chunks, windows, winnowed

SPAN = 13
K = 8
BLOCK_WORDS = 2_000_000
#: Blocks that a task holds at a time; between them the rows are stored.
AT_ONCE = 4
#: Fingerprint pairs extended at a time.
PAIRS = 200_000


@dataclass
class Index:
    """Fingerprints of one benchmark block: sorted hash -> places in the concatenated item words."""
    ids: list  # item ids, in order of the items
    words: np.ndarray
    item: np.ndarray  # item of each word
    hash: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted hashes, items


def _words(data, offsets):
    return split_words(LOWER[data], offsets, NOT_ALNUM)


def build_index(items: list[tuple], span: int = SPAN, k: int = K) -> Index:
    k = min(k, span)
    words, owner, places, hashes, short = [], [], [], [], {}
    base = 0
    for j, (_, text) in enumerate(items):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = _words(raw, np.array([0, len(raw)])).hashes()
        n = len(h)
        if n >= span:
            g = windows(h, k)
            pos = winnowed(g, np.ones(len(g), bool), span - k + 1)
            places.append(base + pos)
            hashes.append(g[pos])
        elif n:
            short.setdefault(n, []).append((windows(h, n)[0], j))
        words.append(np.append(h, np.uint64(0)))  # 0 keeps items apart
        owner.append(np.full(n + 1, j))
        base += n + 1
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    hs, ps = cat(hashes, np.uint64), cat(places, np.int64)
    order = np.argsort(hs, kind="stable")
    by_len = {}
    for n, pairs in short.items():
        a = np.array([p[0] for p in pairs], np.uint64)
        o = np.argsort(a, kind="stable")
        by_len[n] = a[o], np.array([p[1] for p in pairs])[o]
    return Index([i for i, _ in items], cat(words, np.uint64), cat(owner, np.int64), hs[order], ps[order], by_len)


def _lookup(keys: np.ndarray, table: np.ndarray):
    """For each key its range in the sorted table: (index of the key, place in the table) pairs, in slices."""
    if not len(table) or not len(keys):
        return
    lo = np.searchsorted(table, keys, "left")
    found = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == keys)
    if not len(found):
        return
    lo = lo[found]
    n = np.searchsorted(table, keys[found], "right") - lo
    upto = np.cumsum(n)
    for a in range(0, int(upto[-1]), PAIRS):
        flat = np.arange(a, min(a + PAIRS, int(upto[-1])))
        which = np.searchsorted(upto, flat, "right")
        yield found[which], lo[which] + flat - (upto[which] - n[which])


def _extend(dw: np.ndarray, iw: np.ndarray, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from (p, q) on, going by ``step``; both arrays end with unequal guards."""
    n = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        live = live[dw[p[live]] == iw[q[live]]]
        n[live] += 1
        p, q = p.copy(), q.copy()
        p[live] += step
        q[live] += step
    return n


def find_hits(data, offsets, index: Index, span: int = SPAN, k: int = K):
    """(words, starts, ends, items): word spans of the chunk that occur in an item."""
    k = min(k, span)
    w = _words(data, offsets)
    h, left = w.hashes(), w.remaining()
    starts, ends, items = [], [], []
    if w.n >= span and len(index.hash):
        g = windows(h, k)
        fp = winnowed(g, left[:len(g)] >= span, span - k + 1)
        # words of the chunk with a guard between texts and at both ends; guard 1 never equals guard 0
        owner = w.owner()
        dw = np.ones(w.n + len(w.first) + 1, np.uint64)
        at = np.arange(w.n) + owner + 1
        dw[at] = h
        back = np.full(len(dw), -1)
        back[at] = np.arange(w.n)
        iw = np.concatenate([np.zeros(1, np.uint64), index.words])
        for a, b in _lookup(g[fp], index.hash):
            p, q = at[fp[a]], index.place[b] + 1
            r, l = _extend(dw, iw, p, q, 1), _extend(dw, iw, p, q, -1)
            ok = r + l - 1 >= span
            s = back[p[ok]] - l[ok] + 1
            starts.append(s)
            ends.append(s + (r + l - 1)[ok])
            items.append(index.item[index.place[b][ok]])
    for n, (hs, js) in index.short.items():
        g = windows(h, n)
        pos = np.flatnonzero(left[:len(g)] >= n)
        for a, b in _lookup(g[pos], hs):
            starts.append(pos[a])
            ends.append(pos[a] + n)
            items.append(js[b])
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return w, cat(starts), cat(ends), cat(items)


def _scan(index, span: int, k: int, columns: list[str], text: str, schema: pa.Schema, again: bool):
    """again: the rows have the results of other blocks, which are added to."""
    def scan(batches):
        ix = index.value
        for batch in batches:
            col = batch.column(columns.index(text))
            for lo, hi, data, off in text_chunks(col):
                w, s, e, it = find_hits(data, off, ix, span, k)
                owner = np.searchsorted(w.first, s, "right") - 1
                order = np.argsort(owner, kind="stable")
                s, e, it, owner = s[order], e[order], it[order], owner[order]
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                spans, ids = [], []
                part = batch.slice(lo, hi - lo)
                had = [part.column(len(columns) + i) for i in (1, 2)] if again else None
                for r in range(hi - lo):
                    a, b = cut[r], cut[r + 1]
                    if a == b:
                        spans.append(had[0][r].as_py() if again else [])
                        ids.append(had[1][r].as_py() if again else [])
                        continue
                    pairs = set(zip((s[a:b] - w.first[r]).tolist(), (e[a:b] - w.first[r]).tolist()))
                    named = {ix.ids[j] for j in it[a:b].tolist()} - {None}
                    if again:
                        pairs |= {(x["start"], x["end"]) for x in had[0][r].as_py()}
                        named |= set(had[1][r].as_py())
                    spans.append(merged(sorted(pairs)))
                    ids.append(sorted(named))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(columns))]
                    + [pa.array(w.counts, pa.int64()), pa.array(spans, schema.field("hit_spans").type), pa.array(ids, schema.field("items").type)],
                    schema=pa.schema([*[pa.field(c, part.schema.field(i).type) for i, c in enumerate(columns)],
                                      *[schema.field(x) for x in ("n_words", "hit_spans", "items")]]))
    return scan


def _in_turn(scans: list):
    def scan(batches):
        for s in scans:
            batches = s(batches)
        return batches
    return scan


def merged(pairs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


ADDED = ("n_words", "hit_spans", "items")
#: Names that the operator uses itself.
NAMES = {*ADDED, "_block", "n_hit", "n_items", "items_sha256", "contaminated"}


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                       span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with ``n_words``, ``hit_spans`` (merged word spans, end exclusive) and ``items`` (ids of
    the items that occur, by value)."""
    docs = set_aside(docs, NAMES)
    spark = docs.sparkSession
    bench = benchmark.select(item, F.col("text").alias("text"))
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (2 * block_words)))  # a word and its gap take two characters at least
    id_type = bench.schema[item].dataType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans),
                        T.StructField("items", T.ArrayType(id_type))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    found, scans = docs, []
    for b in range(n_blocks):
        block = bench if n_blocks == 1 else bench.filter(F.pmod(F.xxhash64(item, "text"), F.lit(n_blocks)) == b)
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in block.collect()], span, k))
        scans.append(_scan(index, span, k, docs.columns, text, arrow, b > 0))
        if len(scans) == AT_ONCE or b == n_blocks - 1:
            found = map_texts(found, _in_turn(scans), out)
            found, scans = found if b == n_blocks - 1 else stored(found, "scanned"), []
    return found


def with_verdict(found: DataFrame, share: float = 0.05) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the spans."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(ids.cast("binary"), 256)}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))
