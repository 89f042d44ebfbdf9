"""Main text of web pages: a suffix array per host finds what its pages repeat, markup settles the rest.

A page is cut into blocks.  Elements that are no text by what they are (scripts, menus, footers, sidebars, forms, hidden ones)
or by a class, id or role made of template words alone go.  An element of which such a word is only a part of the name
(``related-work``, ``alert-level``) or that has several meanings (``discussion``) is in doubt: it goes if most of its words are links, else
the suffix array decides.  The token streams of the host's pages are
concatenated, suffixes are ranked by prefix doubling up to ``RUN`` tokens, runs of that length found on
``MIN_PAGES`` distinct pages are boilerplate, and the tokens that no such run covers are kept (as are a few
words at a block's end that a run only reaches into).  Every page goes through it with all its blocks, template and containers included.

What follows is a check by markup.  An ``article``, else ``main``, else a container named for content is the page's text if it holds half of the words that are
left; elsewhere it is one teaser or label among others, and the unique runs of the whole page are the text.  Where it does not hold half
before repeats are taken out, the share is taken again of the unique words.

Repetition alone cannot do it: passages that articles share must stay, adverts that occur once must go.  So repeats inside
a container that holds the text stay, but for elements in doubt.

A host's pages are dealt into groups of about ``GROUP_BYTES`` of html by a hash of the page, so a task is
bounded whatever one host holds.  The groups of a large host emit each of their runs once, as a 64-bit hash with its number
of pages, packed in as many parts of the hashes as there are groups; the sums over the host, not over the group, decide, and each group is
told its repeated runs.  Blocks are shuffled compressed, page by page; pages are parsed again for the count rather than stored.  Pages with equal streams count as one page, in one group of the host.

Nulls: NULL html has the text ''; a NULL or unreadable url belongs to the host ''.  Equal rows get equal texts.
An empty table gives an empty table.
"""
from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seasonlens.llm.store import map_texts, stored
from seasonlens.llm.words import signed, windows

RUN = 8
MIN_PAGES = 2
GROUP_BYTES = 8 << 20

# Elements of HTML by their part in the layout.
BLOCKS = frozenset("""address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th
thead tr ul""".split())
HELD = frozenset("""article aside blockquote body details dialog div dl fieldset figure footer form header li main nav ol p section
span table td tr ul""".split())
UNREAD = frozenset("script style noscript template iframe svg math canvas object select textarea button title audio video".split())
TEMPLATE = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words in class, id and role by what they say of an element.
NOT_TEXT = frozenset("""ad ads adsense advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments complementary
consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation
newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond responses search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
#: Template words that text has in its own headings: alone they leave a doubt.
TWO_MEANINGS = frozenset("discussion promotion recommended related respond responses search share social subscription".split())
#: Words that add nothing to a template word: comment-list, ad-slot.
PARTS = frozenset("""area bar block bottom box button buttons card center col column container content count form group header heading icon
image img inner item items left link links list main navigation outer page pages panel post posts primary right row secondary section site slot
story stories text title top unit wrap wrapper""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
TEXT = frozenset("article articlebody body content entry main post story text".split())
HEAD = frozenset("header".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

OUT, OTHER, NAMED, MAIN, ARTICLE = range(5)


def _template_word(token: str) -> bool | None:
    """Whether a name says template: True by all its words, None by some of them or in one of its meanings, False by none."""
    parts, joined = {w.lower() for w in _WORD.findall(token)}, re.sub(r"[^a-z]", "", token.lower())
    if joined in NOT_TEXT:
        return None if joined in TWO_MEANINGS else True
    if not parts & NOT_TEXT:
        return False
    return True if parts <= NOT_TEXT | PARTS else None


def _standing(tag: str, attrs: str, inside: int) -> tuple[int, bool]:
    """What an element is, given what it is inside of, and whether it is in doubt."""
    if inside == OUT or tag in TEMPLATE:
        return OUT, False
    words: set[str] = set()
    doubt = False
    root = tag in ("body", "html")
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return OUT, False
            if name == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return OUT, False
                continue
            for token in value.split():
                words.update(w.lower() for w in _WORD.findall(token))
                words.add(re.sub(r"[^a-z]", "", token.lower()))
                if not root and name != "itemprop":
                    is_template = token.lower() in ROLES if name == "role" else _template_word(token)
                    if is_template:
                        return OUT, False
                    doubt |= is_template is None
    if (tag == "header" or words & HEAD) and inside < NAMED:
        return OUT, False
    if tag == "article":
        return ARTICLE, doubt
    if inside == ARTICLE or root:
        return inside, doubt
    if tag == "main" or "main" in words:
        return max(inside, MAIN), doubt
    if words & TEXT:
        return max(inside, NAMED), doubt
    return inside, doubt


@dataclass
class Block:
    standing: int
    text: str
    doubt: int  # the element in doubt that it lies in, 0 if none
    linked: int  # its words inside links


def blocks(page: str) -> list[Block]:
    """The blocks in page order; an element in doubt with more words inside links than outside is template."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", OTHER, 0)]
    parts: list[str] = []
    at, n, doubts, linked, in_link = 0, len(page), 0, 0, False

    def close():
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1], text, stack[-1][2], linked))
            parts.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece.split())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, end, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            in_link = not end
        if tag in UNREAD and not end:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if end:
            held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if tag in HELD or tag in TEMPLATE else 0
            if tag in BLOCKS or held and stack[held][1:] != stack[held - 1][1:]:
                close()
            if held:
                del stack[held:]
            continue
        if tag in BLOCKS:
            close()
            while tag not in ("span",) and stack[-1][0] in ("p", "span") and len(stack) > 1:  # a block ends a paragraph
                stack.pop()
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in HELD or tag in TEMPLATE:
            here, doubt = _standing(tag, attrs, stack[-1][1])
            doubts += doubt
            mine = stack[-1][2] or (doubts if doubt else 0)
            if (here, mine) != stack[-1][1:]:
                close()
            stack.append((tag, here, mine))
    close()
    words, links = Counter(), Counter()
    for b in out:
        if b.doubt and b.standing != OUT:
            words[b.doubt] += len(b.text.split())
            links[b.doubt] += b.linked
    for b in out:
        if b.doubt and 2 * links[b.doubt] > words[b.doubt]:
            b.standing, b.doubt = OUT, 0
    return out


def holder(words: dict[int, int]) -> int:
    """From words by standing: the least standing of the container that holds the text, OTHER if none does."""
    upto, total = 0, sum(words.values())
    for s in (ARTICLE, MAIN, NAMED):
        upto += words.get(s, 0)
        if upto and 2 * upto >= total:
            return s
    return OTHER


def in_order(found: list[Block]) -> list[Block]:
    """A page's blocks as its token stream has them: those of the container that holds half of the words (of all elements that are
    no template, if none does), then the others."""
    words = Counter()
    for b in found:
        if b.standing != OUT:
            words[b.standing] += len(b.text.split())
    level = max(holder(words), OTHER)
    return sorted(found, key=lambda b: b.standing < level)


def repeated(streams: list[np.ndarray], run: int = RUN, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``run`` tokens that ``min_pages`` different streams hold."""
    page, lens, rank, order = suffixes(streams, run)
    hit = np.zeros(len(rank), bool)
    if len(order):
        group, pages = holders(page, rank, order)
        hit[order[pages[group] >= min_pages]] = True
    return _covered(hit, lens, run)


def suffixes(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Page of each token (equal streams are one page), lengths, ranks by the first ``run`` tokens, and the suffix array of
    whole runs, pages in order within equal prefixes."""
    distinct: dict[bytes, int] = {}
    page = np.array([distinct.setdefault(s.tobytes(), len(distinct)) for s in streams], np.int64)
    lens = np.array([len(s) for s in streams], np.int64)
    if not lens.sum():
        return np.zeros(0, np.int64), lens, np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate(streams)
    ends = np.repeat(np.cumsum(lens), lens)
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < run:  # ranks of suffixes by their first 2 * span tokens; shorter suffixes rank by what they have
        step = min(span, run - span)
        nxt = np.full(len(rank), -1)
        ok = np.arange(len(rank)) + step < ends
        nxt[ok] = rank[np.flatnonzero(ok) + step]
        rank = np.unique(rank * (len(rank) + 2) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        span += step
    whole = np.arange(len(rank)) + run <= ends
    page = np.repeat(page, lens)
    order = np.lexsort((page, rank))
    return page, lens, rank, order[whole[order]]


def holders(page: np.ndarray, rank: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry of the suffix array its run, and of each run its number of different pages."""
    r, p = rank[order], page[order]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = first | np.concatenate([[True], p[1:] != p[:-1]])
    group = np.cumsum(first) - 1
    return group, np.bincount(group, new_page)


def _covered(hit: np.ndarray, lens: np.ndarray, run: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run that starts at a hit."""
    cover = np.zeros(len(hit) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run, -1)
    return np.split(np.cumsum(cover[:-1]) > 0, np.cumsum(lens)[:-1]) if len(lens) else []


def _run_hashes(streams: list[np.ndarray], run: int) -> np.ndarray:
    """Of the ``run`` tokens from each place of the concatenated streams on; 0 near the end."""
    flat = np.concatenate(streams).astype(np.uint64)
    return np.concatenate([signed(windows(flat, run)), np.zeros(min(run - 1, len(flat)), np.int64)])


def _pages_of(rows: pa.Table) -> tuple[list[list[str]], list[np.ndarray]]:
    """Blocks and token streams of pages; each different token is hashed once."""
    texts = [pa.decompress(p, n, "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else []
             for p, n in zip(rows["blocks"].to_pylist(), rows["bytes"].to_pylist())]
    tokens = [[t for b in page for t in b.split()] for page in texts]
    codes = {t: xxhash.xxh64_intdigest(t) >> 1 for t in set().union(*tokens)}
    return texts, [np.fromiter(map(codes.__getitem__, page), np.int64, len(page)) for page in tokens]


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, their bytes by place."""
    steps = np.diff(values.view(np.uint64) ^ np.uint64(1 << 63), prepend=np.uint64(0))
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    places = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return (np.cumsum(np.ascontiguousarray(places.T).view(np.uint64).ravel(), dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _runs_of_group(run: int, min_pages: int):
    """Cogroup of a group's pages and the streams that it counts: each run once, in one row per part of the hashes and number of
    counted pages (``min_pages`` stands for more, too).  A host has as many parts as groups."""
    def runs(rows: pa.Table, counted: pa.Table) -> pa.Table:
        out = {"host": [], "deal": [], "part": [], "pages": [], "runs": []}
        mine = set(counted["sh"].to_pylist())
        _, streams = _pages_of(rows)
        lens = np.array([len(s) for s in streams], np.int64)
        if lens.sum():
            host, deal, parts = (rows[c][0].as_py() for c in ("host", "deal", "n"))
            page, _, rank, order = suffixes(streams, run)
            of = np.repeat(np.array([x in mine for x in rows["sh"].to_pylist()], bool), lens)
            every = _run_hashes(streams, run)
            hashes = np.unique(every[order])
            pages = np.zeros(len(hashes), np.int64)
            order = order[of[order]]
            if len(order):
                group, n = holders(page, rank, order)
                first = order[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])]
                np.add.at(pages, np.searchsorted(hashes, every[first]), n.astype(np.int64))
            part, pages = np.mod(hashes, parts), np.minimum(pages, min_pages)  # of a hash, part and quotient are kept
            by = np.lexsort((hashes, pages, part))
            ends = np.flatnonzero(np.diff(part[by] * (min_pages + 1) + pages[by])) + 1
            for at in np.split(by, ends) if len(by) else []:
                for c, v in (("host", host), ("deal", deal), ("part", int(part[at[0]])), ("pages", int(pages[at[0]])), ("runs", packed(hashes[at] // parts))):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("host", pa.string()), ("deal", pa.int64()), ("part", pa.int64()), ("pages", pa.int64()), ("runs", pa.binary())]))
    return runs


def _hot_runs(min_pages: int):
    """Of one part of a host's runs, for each group, those on ``min_pages`` pages of the host."""
    def hot(rows: pa.Table) -> pa.Table:
        runs = [unpacked(r) for r in rows["runs"].to_pylist()]
        flat = np.concatenate(runs)
        distinct, at = np.unique(flat, return_inverse=True)
        pages = np.bincount(at, np.repeat(rows["pages"].to_numpy(), [len(r) for r in runs]))
        repeats = [r[h] for r, h in zip(runs, np.split(pages[at] >= min_pages, np.cumsum([len(r) for r in runs])[:-1]))]
        some = [i for i, r in enumerate(repeats) if len(r)]
        kept = rows.select(["host", "deal", "part"]).take(pa.array(some, pa.int64()))
        return pa.table({"host": kept["host"], "deal": kept["deal"], "part": kept["part"], "runs": pa.array([packed(repeats[i]) for i in some], pa.binary())})
    return hot


def _parse(batches):
    """Pages with their blocks, one to a line (a block has no line ends), compressed."""
    for batch in batches:
        packs, sizes, marks, streams = [], [], [], []
        for page in batch.column("html"):
            found = in_order(blocks(page.as_py() or ""))
            text = "\n".join(b.text for b in found).encode("utf-8", "surrogatepass")
            packs.append(pa.compress(text, "zstd", asbytes=True))
            sizes.append(len(text))
            marks.append(bytes(2 * b.standing + bool(b.doubt) for b in found))
            streams.append(xxhash.xxh64_intdigest(b" ".join(text.split(b"\n"))) - (1 << 63))
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("page_id", "url", "host", "deal", "n")), pa.array(packs, pa.binary()), pa.array(sizes, pa.int64()),
            pa.array(marks, pa.binary()), pa.array(streams, pa.int64())],
            names=["page_id", "url", "host", "deal", "n", "blocks", "bytes", "marks", "sh"])


def own_runs(covered: np.ndarray, run: int) -> np.ndarray:
    """Of a block's covered tokens those to remove: all, or stretches of a run's length.  Runs may cross blocks (menus
    are many short ones), and their ends must not take a few words off a block that is not repeated."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= run or b - a == len(covered)
    return out


def _told(streams: list[np.ndarray], run: int, hot: np.ndarray) -> list[np.ndarray]:
    """For each stream, which tokens lie in one of the runs with the given hashes."""
    lens = np.array([len(s) for s in streams], np.int64)
    if not lens.sum():
        return [np.zeros(0, bool) for _ in streams]
    whole = np.arange(lens.sum()) + run <= np.repeat(np.cumsum(lens), lens)
    return _covered(whole & np.isin(_run_hashes(streams, run), hot), lens, run)


def _kept(texts: list[str], marks: bytes, covered: np.ndarray, run: int) -> str:
    """The text of a page from its blocks and what of their tokens is repeated."""
    found, words, unique, k = [], Counter(), Counter(), 0
    for text, mark in zip(texts, marks):
        every = text.split()
        own = [w for w, c in zip(every, own_runs(covered[k:k + len(every)], run).tolist()) if not c]
        k += len(every)
        if mark // 2 != OUT:
            words[mark // 2] += len(every)
            unique[mark // 2] += len(own)
            found.append((mark // 2, every, own, mark % 2))
    level = holder(words)
    level = level if level > OTHER else holder(unique)
    return " ".join(w for s, every, own, doubt in found if s >= level for w in (own if doubt or level == OTHER else every))


def _unique_runs(run: int, min_pages: int):
    def group(rows: pa.Table, hot: pa.Table | None = None) -> pa.Table:
        texts, streams = _pages_of(rows)
        told = lambda: np.concatenate([np.zeros(0, np.int64), *(unpacked(r) * rows["n"][0].as_py() + p for r, p in zip(hot["runs"].to_pylist(), hot["part"].to_pylist()))])
        covered = repeated(streams, run, min_pages) if hot is None else _told(streams, run, told())
        kept = [_kept(*page, run) for page in zip(texts, rows["marks"].to_pylist(), covered)]
        return pa.table({"page_id": rows["page_id"], "url": rows["url"], "text": pa.array(kept, pa.string())})
    return group


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN, min_pages: int = MIN_PAGES,
            group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, url, text: one row per page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))).alias("host"))
    shape = "page_id long, url string, host string, deal long, n long, blocks binary, bytes long, marks binary, sh long"
    unique, emit, settle = _unique_runs(run, min_pages), _runs_of_group(run, min_pages), _hot_runs(min_pages)
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / group_bytes).cast("long").alias("n"))
    large = stored(sizes.filter("n > 1"), "hosts")  # a row per host of more than group_bytes
    parsed = lambda dealt: map_texts(dealt, _parse, shape)
    result = "page_id long, url string, text string"
    whole = lambda pages: pages.groupBy("host", "deal")
    one = F.lit(1).cast("long")
    narrow = rows.join(large, ["host"], "left_anti").select("*", F.lit(0).cast("long").alias("deal"), one.alias("n"))
    found = whole(parsed(narrow)).applyInArrow(lambda rows: unique(rows), result)
    if not large.isEmpty():
        wide = parsed(rows.join(large, ["host"]).withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.col("n"))))
        counted = stored(wide.groupBy("host", "sh").agg(F.min("deal").alias("deal")), "counted")
        runs = whole(wide).cogroup(whole(counted)).applyInArrow(
            lambda rows, few: emit(rows, few), "host string, deal long, part long, pages long, runs binary")
        hot = runs.groupBy("host", "part").applyInArrow(lambda rows: settle(rows), "host string, deal long, part long, runs binary")
        found = found.unionByName(whole(wide).cogroup(whole(hot)).applyInArrow(lambda rows, some: unique(rows, some), result))
    return found
