"""Language identification by unigram piece models whose segmentations are summed out.

The pieces are the byte strings of a fixed public vocabulary (every single byte among them).  For each
language, expectation-maximisation learns a probability for each piece; a word's likelihood is the sum
over all its segmentations into pieces (forward algorithm), a text's the product over its words, and the
prediction is the language of the largest posterior under equal priors.  A word is a white-space-free run
with one space in front; pieces do not cross words.  All pieces of the vocabulary take part, and words of any length:
long ones (a text without spaces is one word) are learned and scored one by one, their sums kept in logarithms or rescaled.

Learning takes at most about ``FIT_DOCS`` labelled documents a language (whole texts, chosen by a hash of
the id): that is the bound of the sample.  The model has (pieces x languages) numbers whatever the input.
Predictions use the text alone.

Nulls: a NULL text or one without a letter is ``und`` with score 0; rows with a NULL id or label are not
learned from, a NULL id is not held out.  Without any labelled row everything is ``und``.  Equal texts get
equal results.  An empty table gives an empty table.
"""
from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seasonlens.llm.store import map_texts, set_aside
from seasonlens.llm.words import BASE1, WHITE, _BYTE, mix, powers, split_words, text_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FIT_DOCS = 4000
ROUNDS = 2
#: Words of up to so many bytes (the space included) are learned and scored side by side, longer ones one by one.
#: Changes the order of the work only.
SIDE_BY_SIDE = 32
#: Bytes of a long word whose pieces are looked up at once.
BLOCK = 1 << 14
UNKNOWN = "und"
ADDED = ("lang_pred", "score")
NAMES = ADDED
_TILT = 3.0  # added to the log probability of a piece per byte, and taken off again: keeps sums in range
_FLOOR = 0.02  # added to each expected count
_INVERSE = np.uint64(pow(int(BASE1), -1, 1 << 64))


class Pieces:
    """The vocabulary with a vectorised look-up of byte substrings by rolling hash."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        raw = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.len = np.array([len(p) for p in self.pieces])
        self.longest = int(self.len.max())
        at = np.cumsum(self.len) - self.len
        inside = np.arange(len(raw)) - np.repeat(at, self.len)
        h = mix(np.add.reduceat(_BYTE[raw] * powers(BASE1, self.longest)[inside], at) + self.len.astype(np.uint64))
        order = np.argsort(h)
        self.hash, self.id = h[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions that are pieces, their ids)."""
        c = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hash, h[c])
        at[at == len(self.hash)] = 0
        ok = self.hash[at] == h[c]
        return c[ok], self.id[at[ok]]


def read_vocabulary(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces([base64.b64decode(line.split()[0]) for line in f if line.strip()])


def _lattice(block: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Arcs (from, to, words, piece ids) of all words of one length, ordered by ``to``."""
    m, n = block.shape
    s = np.zeros((n + 1, m), np.uint64)
    np.cumsum(_BYTE[block.T] * powers(BASE1, n)[:, None], axis=0, out=s[1:])
    back = powers(_INVERSE, n + 1)
    arcs = []
    for j in range(1, n + 1):
        for i in range(max(0, j - pieces.longest), j):
            rows, ids = pieces.find(mix((s[j] - s[i]) * back[i] + np.uint64(j - i)))
            if len(rows):
                arcs.append((i, j, rows, ids))
    return arcs


def _forward(block: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log likelihood [words, languages] of words of one length; prob is tilted, [pieces, languages]."""
    m, n = block.shape
    a = np.zeros((n + 1, m, prob.shape[1]))
    a[0] = 1
    for i, j, rows, ids in _lattice(block, pieces):
        if len(rows) == m:
            a[j] += a[i] * prob[ids]
        else:
            a[j, rows] += a[i, rows] * prob[ids]
    return np.log(a[n]) - _TILT * n


def _ending(word: np.ndarray, lo: int, hi: int, pieces: Pieces) -> np.ndarray:
    """[bytes lo..hi, sizes]: the piece of each size that ends with each byte, or -1."""
    near = max(0, lo - pieces.longest + 1)
    part = word[near:hi]
    s = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * powers(BASE1, len(part)), out=s[1:])
    back = powers(_INVERSE, len(part) + 1)
    ids = np.full((hi - lo, pieces.longest), -1, np.int32)
    for size in range(1, min(pieces.longest, len(part)) + 1):
        at, found = pieces.find(mix((s[size:] - s[:-size]) * back[:len(part) - size + 1] + np.uint64(size)))
        end = at + near + size - 1 - lo
        ok = end >= 0
        ids[end[ok], size - 1] = found[ok]
    return ids


def _forward_long(word: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """The same for one long word; the running sums are rescaled at every byte."""
    n = len(word)
    total = np.zeros(prob.shape[1])
    last = np.zeros((pieces.longest, prob.shape[1]))  # the sums at the last bytes, newest first
    last[0] = 1
    for lo in range(0, n, BLOCK):
        ids = _ending(word, lo, min(n, lo + BLOCK), pieces)
        for j in range(len(ids)):
            k = np.flatnonzero(ids[j] >= 0)
            new = (last[k] * prob[ids[j, k]]).sum(axis=0)
            last = np.roll(last, 1, axis=0)
            last[0] = new
            top = last.max(axis=0)
            if (top < 1e-100).any() or (top > 1e100).any():
                total += np.log(top)
                last /= top
    return total + np.log(last[0]) - _TILT * n


def _expected_long(word: np.ndarray, weight: float, lang: int, pieces: Pieces, logs: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece counts of one long word; its sums are logarithms, 16 bytes per byte of the word."""
    n = len(word)
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    for lo in range(0, n, BLOCK):
        for j, row in enumerate(_ending(word, lo, min(n, lo + BLOCK), pieces), lo + 1):
            k = np.flatnonzero(row >= 0)
            a[j] = np.logaddexp.reduce(a[j - 1 - k] + logs[row[k], lang])
    for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        ids = _ending(word, lo, min(n, lo + BLOCK), pieces)
        for j in range(lo + len(ids), lo, -1):
            row = ids[j - lo - 1]
            k = np.flatnonzero(row >= 0)
            rest = logs[row[k], lang] + b[j]
            b[j - 1 - k] = np.logaddexp(b[j - 1 - k], rest)
            out[row[k], lang] += weight * np.exp(a[j - 1 - k] + rest - a[n])


def _expected(block: np.ndarray, weight: np.ndarray, lang: np.ndarray, pieces: Pieces, prob: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece counts of the words (forward-backward) to out [pieces, languages]."""
    m, n = block.shape
    arcs = _lattice(block, pieces)
    a = np.zeros((n + 1, m))
    b = np.zeros((n + 1, m))
    a[0] = b[n] = 1
    for i, j, rows, ids in arcs:
        a[j, rows] += a[i, rows] * prob[ids, lang[rows]]
    for i, j, rows, ids in sorted(arcs, key=lambda x: -x[0]):
        p = prob[ids, lang[rows]] * b[j, rows]
        b[i, rows] += p
        np.add.at(out, (ids, lang[rows]), weight[rows] * a[i, rows] * p / a[n, rows])


def _blocks(lens: np.ndarray):
    """Indexes of words by length, in blocks of bounded size."""
    order = np.argsort(lens, kind="stable")
    edges = np.flatnonzero(np.diff(lens[order])) + 1
    for part in np.split(order, edges):
        for lo in range(0, len(part), 8192):
            if len(part):
                yield part[lo:lo + 8192]


def _matrix(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    out = np.full((len(start), n + 1), 0x20, np.uint8)
    out[:, 1:] = data[start[:, None] + np.arange(n)]
    return out


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # tilted probabilities [pieces, languages]


class Scorer:
    """Scores words, with a direct-mapped cache of the last seen ones."""

    def __init__(self, model: Model):
        self.m = model
        self.bits = max(10, min(19, int(np.log2((1 << 22) / max(1, len(model.langs))))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.zeros((1 << self.bits, len(model.langs)), np.float64)

    def fresh(self, w, which: np.ndarray) -> np.ndarray:
        out = np.empty((len(which), len(self.m.langs)))
        lens = (w.end - w.start)[which]
        short = np.flatnonzero(lens < SIDE_BY_SIDE)
        for part in _blocks(lens[short]):
            at = short[part]
            out[at] = _forward(_matrix(w.data, w.start[which[at]], int(lens[at[0]])), self.m.pieces, self.m.prob)
        for at in np.flatnonzero(lens >= SIDE_BY_SIDE):
            word = np.concatenate([[0x20], w.data[w.start[which[at]]:w.end[which[at]]]]).astype(np.uint8)
            out[at] = _forward_long(word, self.m.pieces, self.m.prob)
        return out

    def texts(self, data, offsets) -> np.ndarray:
        """log likelihood [texts, languages]."""
        w = split_words(data, offsets, WHITE)
        total = np.zeros((len(offsets) - 1, len(self.m.langs)))
        if not w.n:
            return total
        h = w.hashes()
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        vals = self.vals[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            got = self.fresh(w, miss[first])
            vals[miss] = got[inv]
            s = slot[miss[first]]
            self.keys[s] = new
            self.vals[s] = got
        # one row per text with words; which of two words keeps a shared slot does not matter
        full = np.flatnonzero(w.counts)
        total[full] = np.add.reduceat(vals, w.first[full], axis=0)
        return total


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(batches):
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, hi, data, off in text_chunks(batch.column(0)):
            w = split_words(data, off, WHITE)
            if not w.n:
                continue
            code = {x: i for i, x in enumerate(sorted(set(lang[lo:hi])))}
            of = np.array([code[x] for x in lang[lo:hi]])[w.owner()]
            _, first, n = np.unique(mix(w.hashes() + of.astype(np.uint64)), return_index=True, return_counts=True)
            names = list(code)
            yield pa.RecordBatch.from_pydict({"lang": [names[i] for i in of[first].tolist()],
                                              "word": [w.bytes_of(i) for i in first.tolist()], "n": n})


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY,
        fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from labelled rows that are not held out."""
    spark = docs.sparkSession
    pieces = read_vocabulary(vocabulary)
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    size = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces.pieces), 0)))
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, float(min(1.0, fit_docs / size[x])))])
    chosen = F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20)
    counts = map_texts(labelled.filter(chosen).select(text, lang), _word_counts, "lang string, word binary, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.cache()  # read once a round; recomputed where an executor is lost
    code = {x: i for i, x in enumerate(langs)}
    prob = np.full((len(pieces.pieces), len(langs)), 1.0 / len(pieces.pieces))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, prob * np.exp(_TILT * pieces.len)[:, None]))

        def e_step(batches, model=model):
            p, tilted = model.value
            out, logs = np.zeros(tilted.shape), np.log(tilted)
            for batch in batches:
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                of = np.array([code[x] for x in batch.column(0).to_pylist()])
                raw = np.frombuffer(b"".join(words), np.uint8)
                lens = np.array([len(x) for x in words])
                start = np.cumsum(lens) - lens
                short = np.flatnonzero(lens < SIDE_BY_SIDE)
                for i in np.flatnonzero(lens >= SIDE_BY_SIDE):
                    word = np.concatenate([[0x20], raw[start[i]:start[i] + lens[i]]]).astype(np.uint8)
                    _expected_long(word, n[i], of[i], p, logs, out)
                for part in (short[x] for x in _blocks(lens[short])):
                    _expected(_matrix(raw, start[part], int(lens[part[0]])), n[part], of[part], p, tilted, out)
            at, col = np.nonzero(out)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "lang": pa.array(col, pa.int32()), "n": out[at, col]})

        got = counts.mapInArrow(e_step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        prob = np.full(prob.shape, _FLOOR)
        prob[got["piece"], got["lang"]] += got["n"]
        prob /= prob.sum(axis=0)
    counts.unpersist()
    return Model(langs, pieces, prob * np.exp(_TILT * pieces.len)[:, None])


def _letters(data, offsets) -> np.ndarray:
    low = data | 0x20
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((low >= 0x61) & (low <= 0x7A), out=seen[1:])
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~has):  # rare: no ASCII letter at all
        has[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode())
    return has


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, the posterior of the prediction."""
    docs = set_aside(docs, NAMES)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def predict(batches):
        scorer = Scorer(shared.value)
        names = np.array([*scorer.m.langs, UNKNOWN], object)
        for batch in batches:
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            for lo, hi, data, off in text_chunks(batch.column(at)) if scorer.m.langs else ():
                ll = scorer.texts(data, off)
                top = ll.argmax(axis=1)
                has = _letters(data, off)
                best[lo:hi] = np.where(has, top, len(names) - 1)
                score[lo:hi] = np.where(has, 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, *ADDED])

    return map_texts(docs, predict, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
