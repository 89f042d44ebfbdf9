"""Personal data by patterns, and by a semi-Markov conditional random field over the places that patterns do not settle.

Base kinds are patterns with a check: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15
digits after a plus).  Around every anchor (an at sign or at word, a run of 7 digits or of four numbers) the text is cut
into atoms: digit runs, letter runs, single other characters.  A candidate segment is a run of atoms; its features are
those of the whole span (digits, groups and their separators, check sum, brackets, domain ending, what stands on either
side, cue words before it).  The field scores a segmentation into typed segments and plain atoms; dynamic programming over
segments of bounded length sums or maximises over all of them, so boundaries and types are chosen together.  Base spans
are fixed in it: no segment may overlap one.  A segment of the best segmentation is reported where its
marginal probability is ``MIN_POSTERIOR`` or more.

Weights are trained here, from the documents themselves: base spans of a bounded sample are the labelled segments, as they
stand and rewritten (national numbers, other separators, words for signs), with spans that fail their check, dates and
regrouped numbers as plain text.  The sample is at most about ``FIT_DOCS`` documents, and of these ``FIT_PLACES`` places, by
a hash.  Without any base span the field adds nothing.

Spans count code points, end exclusive.  Nulls: a NULL text is empty.  Every row is scanned on its own and whole; equal
texts get equal spans.  An empty table gives an empty table.  A column named ``personal`` is set aside.
"""
from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seasonlens.llm.store import map_texts, set_aside

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
FIT_DOCS = 20_000
FIT_PLACES = 2_000
STEPS = 400
MIN_POSTERIOR = 0.9
#: Bounds of a segment: atoms of an address before and after its at sign, digits of a number.
LOCAL_ATOMS, DOMAIN_ATOMS, DIGITS = 16, 24, 19
#: Text on either side of an anchor that may belong to its segments.
REACH = 64
ADDED = ("personal",)
NAMES = ADDED

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words people write for signs, endings of frequent domains, words that announce personal data.
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu us ch at nl be se ru cn jp br in".split())
CUES = {EMAIL: ("mail", "email", "courriel", "correo"), IP: ("ip", "host", "server"), CARD: ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
        PHONE: ("phone", "tel", "call", "mobile", "fax", "telefon", "appel")}

_ADDRESS = re.compile(rf"([A-Za-z0-9._%+-]+)({_AT})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)")
_WORDED = r"\s[A-Za-z0-9-]{1,63}\s?[\[({<]?\s?(?:dot|DOT)\b"
_ATS = re.compile(rf"@|[\[({{<]\s?(?:at|AT)\s?[\])}}>]|(?<=\s)(?:at|AT)(?={_WORDED})")
#: A text without any of these holds no address written in words.
_HINTS = ("@", "dot", "DOT", *(w + c for w in ("at", "AT", "at ", "AT ", "at\n", "AT\n") for c in "])}>"))
_NUMBERS = re.compile(r"[0-9](?:[0-9 ().\[\]:/_-]*[0-9])")
_SEPARATORS = frozenset(" ().[]:/_-")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_LABELS = re.compile(_DOT)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str):
    at, free = t.find("@"), 0
    while at >= 0:  # a match starts where the run before its sign does, or where the last match ended
        start = at
        while start > free and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = t.find("@", max(at + 1, free))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns that hold, by kind, then start."""
    out = [(EMAIL, a, b) for a, b in _emails(t)]
    out += [(IP, m.start(), m.end()) for m in _IP.finditer(t) if all(len(p) < 4 and int(p) < 256 or int(p[-4:]) < 256 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in t:
        out += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- places, atoms and candidate segments ---------------------------------------------------------
NUMBER = ("bias luhn short d9_12 d13_15 d16 d17_19 quad quad_over one two three four more fours tail34 plus zeros area unbalanced "
          "same dot dash space other_sep long_sep joined_left joined_right goes_on cue_phone cue_card cue_ip marked_dot date major").split()
ADDRESS = ("address sign marked_at word_at dots marked_dots word_dots ending unknown_ending spaced_sign busy_local cue_mail not_whole_left not_whole_right "
           "mixed one_letter breaks").split()
FEATURES = NUMBER + ADDRESS
_N = {f: i for i, f in enumerate(FEATURES)}


def places(t: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which a segment can lie, apart from each other; all anchors of the whole text."""
    spans = []
    for m in _NUMBERS.finditer(t):
        if m.end() - m.start() >= 7 and (len(_digits(m[0])) >= 7 or m[0].count(".") >= 3):
            spans.append((max(0, m.start() - 2), m.end()))
    if any(h in t for h in _HINTS):
        spans += [(max(0, m.start() - REACH), min(len(t), m.end() + REACH)) for m in _ATS.finditer(t)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cues(before: str) -> list[int]:
    words = re.findall(r"[a-z]+", before.lower())[-3:]
    return [k for k, known in CUES.items() if any(w in known for w in words)]


def _number_features(u: str, left: str, right: str, cues: list[int]) -> list[str]:
    groups = re.findall(r"[0-9]+", u)
    seps = re.split(r"[0-9]+", u)[1:-1]
    n, on = sum(map(len, groups)), ["bias"]
    digits = "".join(groups)
    if 13 <= n <= 19 and luhn(digits):
        on.append("luhn")
    on.append("short" if n < 9 else "d9_12" if n < 13 else "d13_15" if n < 16 else "d16" if n == 16 else "d17_19")
    if len(groups) == 4 and len(set(seps)) == 1 and all(len(g) < 4 for g in groups):
        on.append("quad" if all(int(g) < 256 and (g == "0" or g[0] != "0") for g in groups) and "." in seps[0] else "quad_over")
    on.append(("one", "two", "three", "four", "more")[min(len(groups), 5) - 1])
    sizes = [len(g) for g in groups]
    if len(groups) > 1 and all(s == 4 for s in sizes):
        on.append("fours")
    if len(groups) > 1 and sizes[-2:] == [3, 4]:
        on.append("tail34")
    if u[0] == "+":
        on.append("plus")
    elif u.startswith("00"):
        on.append("zeros")
    if re.match(r"(?:\+?[0-9]{1,3} ?)?\([0-9]{2,4}\)", u):
        on.append("area")
    if u.count("(") != u.count(")") or u.count("[") != u.count("]"):
        on.append("unbalanced")
    if seps and len(set(seps)) == 1:
        on.append("same")
    if "." in seps:
        on.append("dot")
    if "-" in seps:
        on.append("dash")
    if " " in seps:
        on.append("space")
    marked = [s for s in seps if s in ("[.]", "(.)", " . ")]
    if marked:
        on.append("marked_dot")
    if any(c in s for s in seps for c in ":/_[") and not marked:
        on.append("other_sep")
    if any(len(s) > 1 and s not in (") ", " (", ")-") for s in seps) and not marked:
        on.append("long_sep")
    if left[-1:].isalnum():
        on.append("joined_left")
    if right[:1].isalnum():
        on.append("joined_right")
    if re.search(r"[0-9][ ().\[\]:/_,-]{1,2}$", left) or re.match(r"[ ().\[\]:/_,-]{1,2}[0-9]", right) or left[-1:] in "+(":
        on.append("goes_on")
    on += [name for k, name in ((PHONE, "cue_phone"), (CARD, "cue_card"), (IP, "cue_ip")) if k in cues]
    if re.match(r"(?:1[89]|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ]|(?:[0-2]?[0-9]|3[01])[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:1[89]|20)[0-9]{2}", u):
        on.append("date")
    if digits[0] in "3456":
        on.append("major")
    return on


def _address_features(m: re.Match, left: str, right: str, cues: list[int]) -> list[str]:
    local, at, domain = m[1], m[2], m[3]
    dots = _LABELS.findall(domain)
    last = _LABELS.split(domain)[-1]
    on = ["address", "sign" if "@" in at else "marked_at" if re.search(r"[\[({<]", at) else "word_at"]
    styles = {"dots" if d == "." else "marked_dots" if re.search(r"[\[({<]", d) else "word_dots" for d in dots}
    on += sorted(styles)
    on.append("ending" if last.lower() in ENDINGS else "unknown_ending")
    if "@" in at and len(at) > 1:
        on.append("spaced_sign")
    if re.search(r"[0-9._]", local):
        on.append("busy_local")
    if EMAIL in cues:
        on.append("cue_mail")
    if left[-1:] in _LOCAL and left:
        on.append("not_whole_left")
    if re.match(r"[A-Za-z0-9]|[.-][A-Za-z0-9]", right):
        on.append("not_whole_right")
    if len(styles) > 1 or ("sign" in on) != (styles == {"dots"}):
        on.append("mixed")
    if len(local) == 1:
        on.append("one_letter")
    if "\n" in m[0]:
        on.append("breaks")
    return on


def candidates(t: str, lo: int, hi: int, taken=()) -> tuple[list[int], list[tuple[int, int, tuple[int, ...], list[int]]]]:
    """(atom borders of a place, segments): a segment is (first border, last border, its possible kinds, its features)."""
    borders = [lo, *[m.end() for m in _ATOM.finditer(t, lo, hi)]]
    at_border = {b: i for i, b in enumerate(borders)}
    free = lambda a, b: not any(a < y and x < b for x, y in taken)
    out = []
    around = lambda a, b: (t[max(0, a - 3):a], t[b:b + 3], _cues(t[max(0, a - 24):a]))
    for i in range(len(borders) - 1):
        first = t[borders[i]]
        if not ("0" <= first <= "9" or first in "+(" and t[borders[i] + 1:borders[i] + 2].isdecimal()):
            continue
        n = 0
        for j in range(i, len(borders) - 1):
            atom = t[borders[j]:borders[j + 1]]
            if "0" <= atom[0] <= "9":
                n += len(atom)
                a, b = borders[i], borders[j + 1]
                if n > DIGITS:
                    break
                if (n >= 7 or n >= 4 and t.count(".", a, b) >= 3) and free(a, b):
                    out.append((i, j + 1, (IP, CARD, PHONE), [_N[f] for f in _number_features(t[a:b], *around(a, b))]))
            elif not (atom in _SEPARATORS or atom == "+" and j == i):
                break
    for m in _ATS.finditer(t, lo, hi):
        i, k = max(x for x, b in enumerate(borders) if b <= m.start()), 0
        while i and t[borders[i] - 1].isspace() and k < 1:
            i, k = i - 1, k + 1
        starts = []
        while i > 0 and len(starts) < LOCAL_ATOMS and t[borders[i - 1]] in _LOCAL:
            i -= 1
            starts.append(i)
        for s in starts:
            whole = _ADDRESS.match(t, borders[s], min(hi, m.end() + 2 * REACH))
            if not whole or whole.start(2) > m.start() or whole.end(2) < m.end():
                continue
            ends = [whole.start(3) + x.start() for x in _LABELS.finditer(whole[3])][1:] + [whole.end()]
            for b in ends:
                e = at_border.get(b)
                part = _ADDRESS.fullmatch(t, borders[s], b) if e is not None and e - s <= LOCAL_ATOMS + DOMAIN_ATOMS and free(borders[s], b) else None
                if part:
                    out.append((s, e, (EMAIL,), [_N[f] for f in _address_features(part, *around(borders[s], b))]))
    return borders, out


# ---- the field ---------------------------------------------------------------------------------
def _scores(segments, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first border, last border, kind, score), by last border."""
    out = []
    for i, j, kinds, on in segments:
        total = weights[on].sum(axis=0)
        out += [(i, j, k, float(total[k])) for k in kinds]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def decode(n: int, scored) -> list[tuple[int, int, int, float]]:
    """(first border, last border, kind, marginal probability) of the best segmentation of n atoms; plain atoms score 0."""
    best, back, up = [0.0] * (n + 1), [None] * (n + 1), [0.0] * (n + 1)
    at = 0
    for j in range(1, n + 1):
        best[j], sums = best[j - 1], [up[j - 1]]
        while at < len(scored) and scored[at][1] == j:
            i, _, _, s = scored[at]
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, at
            sums.append(up[i] + s)
            at += 1
        up[j] = float(np.logaddexp.reduce(sums))
    down = [0.0] * (n + 1)
    at = len(scored) - 1
    by_start: dict[int, list] = {}
    for x in scored:
        by_start.setdefault(x[0], []).append(x)
    for i in range(n - 1, -1, -1):
        down[i] = float(np.logaddexp.reduce([down[i + 1], *[s + down[j] for _, j, _, s in by_start.get(i, ())]]))
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, _, k, s = scored[back[j]]
            out.append((i, j, k, float(np.exp(up[i] + s + down[j] - up[n]))))
            j = i
    return out[::-1]


@dataclass
class Lattices:
    """Segments of many places side by side, for training."""
    size: np.ndarray      # atoms of each place
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kind: np.ndarray
    on: np.ndarray        # [segments, features]
    gold: np.ndarray      # whether a segment is labelled


def _gradient(x: Lattices, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the labelled segmentations and its gradient, by forward and backward sums of all places at once."""
    score = np.einsum("sf,fs->s", x.on, weights[:, x.kind])
    n, top = len(x.size), int(x.size.max())
    up, down = np.zeros((top + 1, n)), np.full((top + 1, n), -np.inf)
    by_last, by_first = np.argsort(x.last, kind="stable"), np.argsort(x.first, kind="stable")
    last_at, first_at = np.searchsorted(x.last[by_last], np.arange(top + 2)), np.searchsorted(x.first[by_first], np.arange(top + 2))
    for j in range(1, top + 1):
        up[j] = up[j - 1]
        s = by_last[last_at[j]:last_at[j + 1]]
        np.logaddexp.at(up[j], x.place[s], up[x.first[s], x.place[s]] + score[s])
    for i in range(top, -1, -1):
        down[i] = np.where(x.size == i, 0.0, down[i + 1] if i < top else -np.inf)
        s = by_first[first_at[i]:first_at[i + 1]]
        np.logaddexp.at(down[i], x.place[s], score[s] + down[x.last[s], x.place[s]])
    z = down[0]
    p = np.exp(up[x.first, x.place] + score + down[x.last, x.place] - z[x.place])
    grad = np.zeros(weights.shape)
    for k in range(len(KINDS)):
        s = x.kind == k
        grad[:, k] = (x.gold[s] - p[s]) @ x.on[s]
    return float(score[x.gold > 0].sum() - z.sum()), grad


def lattices(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> Lattices | None:
    """From (text, labelled spans); examples with a label that is no candidate are left out."""
    size, rows, on = [], [], []
    for t, labels in examples:
        want = {(a, b, k) for k, a, b in labels}
        made, n_gold, whole = [], 0, 0
        for lo, hi in places(t):
            borders, segments = candidates(t, lo, hi)
            for i, j, kinds, f in segments:
                for k in kinds:
                    gold = (borders[i], borders[j], k) in want
                    n_gold += gold
                    made.append((whole + i, whole + j, k, gold, f))
            whole += len(borders) - 1
        if n_gold != len(want) or not made:
            continue
        for i, j, k, gold, f in made:
            rows.append((len(size), i, j, k, gold))
            on.append(f)
        size.append(whole)
    if not rows:
        return None
    full = np.zeros((len(rows), len(FEATURES)), np.float32)
    for r, f in enumerate(on):
        full[r, f] = 1
    place, first, last, kind, gold = np.array(rows).T
    return Lattices(np.array(size), place, first, last, kind, full, gold.astype(np.float64))


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS, penalty: float = 1e-4) -> np.ndarray:
    """Weights [features, kinds] by gradient ascent on the mean log likelihood with a quadratic penalty."""
    w = np.zeros((len(FEATURES), len(KINDS)))
    w[_N["bias"]] = w[_N["address"]] = -2.0
    x = lattices(examples)
    if x is None or not x.gold.any():
        w[_N["bias"]] = w[_N["address"]] = -50.0
        return w
    m, v = np.zeros(w.shape), np.zeros(w.shape)
    for step in range(1, steps + 1):
        g = _gradient(x, w)[1] / len(x.size) - penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        w = w + 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.98 ** step)) + 1e-8)
    return w


# ---- labelled examples out of base spans --------------------------------------------------------
def _rewritten(kind: int, u: str, rng: random.Random) -> str | None:
    """The same data as people also write it."""
    d = _digits(u)
    if kind == PHONE:
        if len(d) < 10:
            return None
        c, a, x, y = d[:-10] or "1", d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice((f"({a}) {x}-{y}", f"{a}-{x}-{y}", f"{a}.{x}.{y}", f"00{c} {a} {x} {y}", f"{c}-{a}-{x}-{y}", f"({a}){x}-{y}"))
    if kind == CARD:
        return rng.choice((".", " - ", "/", "_", ":")).join(d[i:i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else None
    if kind == IP:
        return rng.choice(("[.]", "(.)", " . ")).join(u.split("."))
    local, domain = u.split("@")
    if len(domain.split(".")) > 4:
        return None
    at, dot = rng.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] ")))
    return local + at + dot.join(domain.split("."))


def _spoilt(kind: int, u: str, rng: random.Random) -> str | None:
    """Something alike that is no personal data."""
    d = _digits(u)
    if kind == EMAIL:
        return rng.choice((u.split("@")[0] + " at " + u.split("@")[1].split(".")[0], u.split("@")[0] + "@" + u.split("@")[1].split(".")[0]))
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == IP:
        return rng.choice((".".join(str(rng.randint(256, 999)) if i == 1 else p for i, p in enumerate(u.split("."))), f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{digit(4)}"))
    if kind == CARD:
        bad = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice((bad, bad, rng.choice((" ", ".", "-", "/")).join(bad[i:i + 4] for i in range(0, len(bad), 4)), digit(rng.choice((8, 10, 11, 12, 14)))))
    day = f"{rng.randint(1980, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    sep, sizes = rng.choice((" ", ", ", ".", "/", " - ")), [rng.randint(1, 5) for _ in range(6)]
    cut = [d[sum(sizes[:i]):sum(sizes[:i + 1])] for i in range(6)]
    return rng.choice((f"{day} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}", day.replace("-", "/"), sep.join(c for c in cut if c), digit(rng.choice((7, 8, 9, 10, 12)))))


def examples_of(t: str, spans: list[tuple[int, int, int]], seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A place with its labels as it stands, and with one of its spans rewritten, and spoilt."""
    apart: list[tuple[int, int, int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[0])):  # overlapping labels: the longest
        if not any(a < y and x < b for _, x, y in apart):
            apart.append((k, a, b))
    out = [(t, apart)]
    rng = random.Random(f"{seed}:{t}")
    for k, a, b in sorted(apart, key=lambda s: s[1]):
        for change, label in ((_rewritten, True), (_rewritten, True), (_spoilt, False), (_spoilt, False)):
            new = change(k, t[a:b], rng)
            if new is None:
                continue
            cue = rng.choice(CUES[k]) + rng.choice((" ", ": ")) if rng.random() < 0.3 else ""
            text = t[:a] + cue + new + t[b:]
            shift, at = len(cue) + len(new) - (b - a), a + len(cue)
            rest = [(k2, x + shift * (x >= b), y + shift * (x >= b)) for k2, x, y in apart if (k2, x, y) != (k, a, b)]
            out.append((text, rest + ([(k, at, at + len(new))] if label else [])))
    return out


def _sampled(batches):
    for batch in batches:
        found = []
        for t in batch.column(0):
            t = t.as_py() or ""
            spans = base_spans(t) if (near := places(t)) else []
            for lo, hi in near:
                if hi - lo > 8 * REACH:
                    continue  # a table of numbers is no example
                a, b = max(0, lo - 24), min(len(t), hi + 8)
                inside = [s for s in spans if a < s[2] and s[1] < b]
                if all(a <= x and y <= b for _, x, y in inside):
                    found.append({"place": t[a:b], "spans": [[k, x - a, y - a] for k, x, y in inside]})
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("place", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]))


def fit(docs: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS, fit_places: int = FIT_PLACES) -> np.ndarray:
    """Weights from the base spans of a bounded sample of the documents, chosen by hashes of their texts."""
    total = docs.count()
    share = min(1.0, fit_docs / max(1, total))
    some = docs.filter(F.pmod(F.xxhash64(F.lit("fit"), text), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else docs
    seen = map_texts(some.select(text), _sampled, "place string, spans array<array<int>>").distinct()
    mark = F.xxhash64(F.lit("place"), "place")
    with_spans, without = seen.filter(F.size("spans") > 0), seen.filter(F.size("spans") == 0)
    rows = with_spans.orderBy(mark, "place").limit(fit_places).unionByName(without.orderBy(mark, "place").limit(fit_places // 4)).collect()
    rows.sort(key=lambda r: r.place)
    return train([e for r in rows for e in examples_of(r.place, [tuple(s) for s in r.spans])])


# ---- scan --------------------------------------------------------------------------------------
def added_spans(t: str, base: list[tuple[int, int, int]], weights: np.ndarray, least: float = MIN_POSTERIOR) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's segments, apart from the base spans."""
    out = []
    for lo, hi in places(t):
        taken = [(a, b) for _, a, b in base if a < hi and lo < b]
        borders, segments = candidates(t, lo, hi, taken)
        if segments:
            out += [(k, borders[i], borders[j]) for i, j, k, p in decode(len(borders) - 1, _scores(segments, weights)) if p >= least]
    return out


def scan_text(t: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether base) of one text, by kind, then start."""
    base = base_spans(t)
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(t, base, weights)])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                  T.StructField("base", T.BooleanType())]))


def find_personal(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The documents with ``personal``: kind, start, end and whether it is a base span, by kind, then start."""
    docs = set_aside(docs, NAMES)
    at = docs.columns.index(text)

    def scan(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in scan_text(t.as_py() or "", weights)] for t in batch.column(at)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "personal"])

    return map_texts(docs, scan, T.StructType([*docs.schema.fields, T.StructField("personal", _SPAN)]))


def masked(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The documents with each span of ``text`` replaced by its kind in angle brackets (overlapping spans as one)."""
    shape = docs.schema
    at = docs.columns.index(text)

    def scan(batches):
        for batch in batches:
            new = []
            for t in batch.column(at):
                t = t.as_py()
                out, done = [], 0
                for k, a, b, _ in sorted(scan_text(t, weights), key=lambda s: (s[1], -s[2])) if t else ():
                    if a >= done:
                        out += [t[done:a], f"<{KINDS[k]}>"]
                    done = max(done, b)
                new.append("".join(out) + t[done:] if t else t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_texts(docs, scan, shape)
