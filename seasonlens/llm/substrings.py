"""Repeated-substring removal by level-wise doubling of word windows.

A word is removed when a window of ``min_words`` words that covers it also starts in a document with a
smaller key.  Windows of a quarter of that length come first, thinned to the smallest hash of each run of
places so that every full window still holds one that all its copies hold too.  Those found in two
documents are extended to half the length, to the left and to the right (one of the two lies inside any
full window around them); those again repeated are extended to every full window around them.  A level
without repeated windows ends the search.  Texts that equal one of a smaller key as a whole are settled
by their text hash and take no part in the last level.

Windows are compared by hash: 64 bits where a collision only costs a further look, 128 bits (two
polynomials) in the last level.  Work and shuffles follow the repeated part of the corpus; counts are
combined map-side and joined back.  Hashes that stand on more than a ``HOT_PARTS``-th of a level's rows, fewer than
``HOT_PARTS`` of them by that very rule, are sent to their rows; only the rest is shuffled by hash.

Nulls: a NULL text has no words; a row with a NULL key is returned unchanged.  Rows with equal keys are
never removed in favour of each other.  Texts of fewer than ``min_words`` words stay.  Empty tables give
empty tables.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seasonlens.llm.words import BASE1, BASE2, WHITE, mix, signed, split_words, text_chunks, windows, winnowed
from seasonlens.llm.store import map_texts, stored

MIN_WORDS = 50
#: A hash on more than one in so many rows of its level is a hot one.
HOT_PARTS = 1000
_TEXT = "key long, t1 long, t2 long, n_words long, sha string"
_ANCHOR = "key long, t1 long, at int, base long, right_half long, left_half long"
_FULL = "w1 long, w2 long, key long, t1 long, at int"


def _lengths(min_words: int) -> tuple[int, int, int]:
    return -(-min_words // 4), -(-min_words // 2), min_words


def _chunks(batches, column: int = 1):
    """(rows of the batch, words, word hashes) of each chunk of texts."""
    for batch in batches:
        for lo, hi, data, off in text_chunks(batch.column(column)):
            w = split_words(data, off, WHITE)
            yield batch.slice(lo, hi - lo), w, w.hashes()


def _text_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    out = []
    for step in (1, 2):
        total = np.zeros(len(first) - 1, np.uint64)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            inside = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            total[full] = np.add.reduceat(mix(h * np.uint64(2 * step + 1) + mix(inside.astype(np.uint64) + np.uint64(step << 40))), first[full])
        out.append(mix(total + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _describe(batches):
    for batch in batches:
        for lo, hi, data, off in text_chunks(batch.column(1)):
            w = split_words(data, off, WHITE)
            t1, t2 = _text_hashes(w.hashes(), w.first)
            sha = [_sha(data[off[r]:off[r + 1]].tobytes().split()) for r in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), signed(t1), signed(t2), w.counts, pa.array(sha, pa.string())],
                                             names=["key", "t1", "t2", "n_words", "sha"])


def _anchors(min_words: int) -> Callable:
    base, half, full = _lengths(min_words)

    def scan(batches):
        for rows, w, h in _chunks(batches):
            if w.n < full:
                continue
            left = w.remaining()
            g = windows(h, base)
            at = winnowed(g, left[:len(g)] >= full, full - base + 1)
            if not len(at):
                continue
            owner = np.searchsorted(w.first, at, "right") - 1
            inside = at - w.first[owner]
            g2 = np.append(windows(h, half), np.zeros(half, np.uint64))
            back = np.maximum(at + base - half, 0)
            t1, _ = _text_hashes(h, w.first)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(owner)), signed(t1)[owner], pa.array(inside, pa.int32()), signed(g[at]),
                pa.array(signed(g2[at]), mask=left[at] < half), pa.array(signed(g2[back]), mask=(inside + base - half < 0) | (left[back] < half))],
                names=["key", "t1", "at", "base", "right_half", "left_half"])
    return scan


def _full_windows(min_words: int) -> Callable:
    """Rows (key, text, t1, lo, hi): every full window that starts in one of the ranges lo..hi."""
    def scan(batches):
        for batch in batches:
            ranges = batch.column(3).to_pylist()
            keys, t1s = batch.column(0), batch.column(2)
            row = 0
            for lo, hi, data, off in text_chunks(batch.column(1)):
                w = split_words(data, off, WHITE)
                h = w.hashes()
                if w.n < min_words:
                    continue
                g1, g2 = windows(h, min_words, BASE1), windows(mix(h ^ np.uint64(0x5DEECE66D)), min_words, BASE2)
                mine, _ = _text_hashes(h, w.first)
                cover = np.zeros(w.n + 1, np.int32)
                want = t1s.slice(lo, hi - lo).to_numpy()
                for r in range(hi - lo):
                    if want[r] == signed(mine[r:r + 1])[0]:
                        a = np.array([(x["lo"], x["hi"]) for x in ranges[lo + r]])
                        a = np.clip(a, 0, max(0, w.counts[r] - min_words)) + w.first[r]
                        if w.counts[r] >= min_words:
                            np.add.at(cover, a[:, 0], 1)
                            np.add.at(cover, a[:, 1] + 1, -1)
                at = np.flatnonzero(np.cumsum(cover)[:len(g1)] > 0)
                owner = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    signed(g1[at]), signed(g2[at]), keys.take(pa.array(lo + owner)), t1s.take(pa.array(lo + owner)),
                    pa.array(at - w.first[owner], pa.int32())], names=["w1", "w2", "key", "t1", "at"])
    return scan


def _cut(min_words: int) -> Callable:
    """Rows (key, text, t1, starts): the words left when the windows at starts are removed."""
    def scan(batches):
        for batch in batches:
            keys, texts, t1s, starts = (batch.column(i) for i in range(4))
            spans, removed, sha = [], [], []
            for r in range(batch.num_rows):
                words = (texts[r].as_py() or "").encode().split()
                at = np.unique(starts[r].values.to_numpy())
                edge = np.flatnonzero(np.diff(at) > min_words)
                a, b = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])] + min_words
                keep, last = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    keep += words[last:x]
                    last = y
                keep += words[last:]
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                removed.append(int((b - a).sum()))
                sha.append(_sha(keep))
            yield pa.RecordBatch.from_arrays([keys, t1s, pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                             names=["key", "t1", "n_removed", "kept_sha", "spans"])
    return scan


_SPANS = "array<struct<start:long,end:long>>"


def _repeated(rows: DataFrame, by: str) -> DataFrame:
    """The rows of a stored table whose ``by`` stands under two keys or more.  Values with over one row in ``HOT_PARTS`` are
    fewer than ``HOT_PARTS`` at any size: these are broadcast, and their rows are not shuffled."""
    known = rows.groupBy(by).agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.count("*").alias("_n")).filter("_lo < _hi")
    known = stored(known.select(by, "_n"), "repeated")
    many = F.col("_n") > rows.count() // HOT_PARTS
    hot = F.broadcast(known.filter(many).select(by))
    rest = rows.join(hot, by, "left_anti")
    return rows.join(hot, by, "left_semi").unionByName(rest.join(known.filter(~many).select(by), by, "left_semi"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, n_words, n_removed, spans (word spans to remove, end exclusive), kept_sha256: one row per input row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    base, half, full = _lengths(min_words)

    texts = stored(map_texts(rows, _describe, _TEXT), "texts")
    known = texts.filter(F.col("key").isNotNull() & (F.col("n_words") >= min_words))
    first = known.groupBy("t1", "t2").agg(F.min("key").alias("first_key"))

    live = rows.filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    anchors = stored(map_texts(live, _anchors(min_words), _ANCHOR), "anchors")
    again = stored(_repeated(anchors, "base")
                 .select("key", "t1", "at", F.explode(F.array(
                     F.struct((F.col("at") + half - full).alias("lo"), F.col("at").alias("hi"), F.col("right_half").alias("h")),
                     F.struct((F.col("at") + base - full).alias("lo"), (F.col("at") + base - half).alias("hi"), F.col("left_half").alias("h")))).alias("x"))
                 .select("key", "t1", "x.*").filter("h IS NOT NULL"), "halves")
    halves = _repeated(again, "h")
    ranges = halves.groupBy("key", "t1").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    # whole copies of a text with a smaller key need no windows; the first copy stands for them
    one = known.join(first, ["t1", "t2"]).filter("key = first_key").select("key", "t1").distinct()
    todo = stored(live.join(ranges.join(one, ["key", "t1"]), "key").select("key", "text", "t1", "ranges"), "candidates")
    dense = map_texts(todo, _full_windows(min_words), _FULL)
    earliest = dense.groupBy("w1", "w2").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi")).filter("_lo < _hi").drop("_hi")
    hits = dense.join(earliest, ["w1", "w2"]).filter("key > _lo").groupBy("key", "t1").agg(F.collect_list("at").alias("starts"))
    cut = map_texts(
        todo.select("key", "text", "t1").join(hits, ["key", "t1"]).select("key", "text", "t1", "starts"), _cut(min_words), f"key long, t1 long, n_removed long, kept_sha string, spans {_SPANS}").dropDuplicates(["key", "t1"])

    whole = F.col("key") > F.col("first_key")
    return texts.join(first, ["t1", "t2"], "left").join(cut, ["key", "t1"], "left").select(
        F.col("key").alias(key), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
        .otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the repeated words cut from their texts (remaining words joined by a space);
    untouched texts stay as they are.  Keys must tell rows apart."""
    found = repeated_spans(docs, key, text, min_words).filter("n_removed > 0").select(key, F.col("spans").alias("_spans"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    left = F.filter(words, lambda w, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    return docs.join(found, key, "left").select(*[
        F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(left, " ")).alias(text) if c == text else F.col(c) for c in docs.columns])
