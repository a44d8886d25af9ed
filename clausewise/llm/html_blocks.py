"""Main text of pages: a numpy bidirectional LSTM labels every text block.

A page is cut into its leaf blocks in page order: runs of text between
block-level tags, with the path of open elements. A block's vector sums random
vectors of its whole path (tag, and tag with each class, id or role; elements more
than ``NEAR`` levels up and names in lists of more than ``FEW`` weigh less), the mean of the random vectors of its hashed words, and a few numbers (length,
share of link text, punctuation). The LSTM reads a page's blocks in both
directions, so a block is judged with the whole document as context; its
probability decides, no rule follows.

Training (``fit``) happens here, on at most ``SAMPLE`` different pages of up to
``SAMPLE_CHARS`` characters, those of smallest hash: pages whose mark-up names an article give weak labels, and each is also re-wrapped at random
(other containers, no container, menus, side bars, notices, forms, reader
comments made of other pages' sentences, dropped end tags), so that the labeller
does not depend on one site's tags. All pages are labelled in full.

Defined cases: null html is empty and has an empty text; pages without a main
block have an empty text; unclosed, misplaced and cut-off tags are closed by
their parents; repeated rows stay; extra columns pass through unless named like
an output; an empty table, or one without a usable training page, trains on the
built-in skeletons alone.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_slices

SAMPLE = 300
SAMPLE_CHARS = 100_000  # longer pages do not train
VARIANTS = 4
HIDDEN, EPOCHS, SEED = 24, 14, 5
PATH_DIM, WORD_DIM, BUCKETS = 32, 16, 4096
NEAR, FEW = 6, 4
SLICE_CHARS = 3_000_000
BATCH_CELLS = 60_000  # padded blocks in one pass
STEPS_AT_ONCE = 1024  # blocks of a page whose input products are held

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|textarea)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements that do not break a block, and those without content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SAME_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
                "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                      "pre section table ul".split())

Block = tuple[tuple[str, ...], str, int]  # path, text, characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with decoded, single-spaced text."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[tuple[str, bool]] = []
    links = 0

    def end_block() -> None:
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                path = tuple(m for t, m in stack if t not in INLINE)
                out.append((path, text, sum(len(t) for t, linked in held if linked)))
            held.clear()

    for m in _TOKEN.finditer(page):
        raw, tag = m.group(0), m.group(3)
        if raw[0] != "<" or raw == "<":
            held.append((html.unescape(raw), links > 0))  # a reference ends where its run of text does
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            end_block()
        elif tag == "br":
            held.append((" ", links > 0))
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(t not in INLINE for t, _ in stack[i + 1:]) and tag in INLINE:
                        break
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
            continue
        closes = _SAME_CLOSES.get(tag, {"p"} if tag in _CLOSES_P else None)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag not in VOID:  # "/>" closes nothing else, as in a browser
            names = [tag]
            for _, a, b, c in _MARK.findall(m.group(4)):
                names += [f"{tag}.{x.lower()}" for x in (a or b or c).split()]
            stack.append((tag, " ".join(names)))
            links += tag == "a"
    end_block()
    return out


# --- features -------------------------------------------------------------------

_RNG = np.random.default_rng(SEED)
_PATHS = _RNG.normal(0, 1, (BUCKETS, PATH_DIM)).astype(np.float32)
_WORDS = _RNG.normal(0, 1, (BUCKETS, WORD_DIM)).astype(np.float32)
_HINTS = re.compile(r"[a-z]+")
NUMBERS = 5
WIDTH = PATH_DIM + WORD_DIM + NUMBERS


class Features:
    """Block vectors; path vectors and word buckets are cached (bounded)."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if len(self.paths) > 50_000:
            self.paths.clear()
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH_DIM, np.float32)
            for up, names in enumerate(reversed(path)):
                tags, weight = names.split(), min(1.0, NEAR / (up + 1))
                for name in tags:
                    tag, _, mark = name.partition(".")
                    keys = {name, *(f".{h}" for h in _HINTS.findall(mark))}
                    share = np.float32(weight * min(1.0, FEW / (len(tags) - 1)) if mark else weight)
                    for key in keys:
                        v += share * _PATHS[zlib.crc32(key.encode()) % BUCKETS]
                    if up == 0:
                        v += _PATHS[zlib.crc32(f"leaf {tag}".encode()) % BUCKETS]
            self.paths[path] = v
        return v

    def _buckets(self, words: list[str]) -> list[int]:
        known = self.words
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            known.update((w, zlib.crc32(w.lower().encode()) % BUCKETS) for w in set(words) if w not in known)
            return [known[w] for w in words]

    def __call__(self, found: list[Block]) -> np.ndarray:
        x = np.zeros((len(found), WIDTH), np.float32)
        split = [text.split() for _, text, _ in found]
        count = np.array([len(w) for w in split])
        flat = self._buckets([w for ws in split for w in ws])
        x[:, PATH_DIM:PATH_DIM + WORD_DIM] = \
            np.add.reduceat(_WORDS[flat], np.cumsum(np.r_[0, count[:-1]])) / count[:, None]
        for i, (path, _, _) in enumerate(found):
            x[i, :PATH_DIM] = self._path(path)
        x[:, PATH_DIM + WORD_DIM:] = [
            (0, linked / len(text), text.count(".") / n, text[-1] in ".!?:", text[0].isupper())
            for (_, text, linked), n in zip(found, count, strict=True)]
        x[:, PATH_DIM + WORD_DIM] = np.log1p(count) / 3
        return x


# --- the network ------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(WIDTH + HIDDEN), (WIDTH + HIDDEN, 4 * HIDDEN))
        p[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    p["v"], p["o"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p: dict, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
    """One direction over (batch, time, width); ``live`` (batch, time) masks padding."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, memo = np.zeros((n, steps, HIDDEN), np.float32), []
    u = p[f"w{d}"][WIDTH:]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        at = t // STEPS_AT_ONCE * STEPS_AT_ONCE
        if t == (at if d == "f" else min(at + STEPS_AT_ONCE, steps) - 1):  # input products of some steps: long pages stay small
            pre = x[:, at:at + STEPS_AT_ONCE] @ p[f"w{d}"][:WIDTH] + p[f"c{d}"]
        z = pre[:, t - at] + h @ u
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
        c2 = f * c + i * a
        tc, m = np.tanh(c2), live[:, t, None]
        if keep:
            memo.append((t, h, c, i, f, o, a, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        hs[:, t] = h
    return hs, memo


def _backward(p: dict, d: str, x: np.ndarray, memo: list, dhs: np.ndarray) -> dict[str, np.ndarray]:
    w = p[f"w{d}"]
    gw, gc = np.zeros_like(w), np.zeros_like(p[f"c{d}"])
    dh = np.zeros_like(memo[0][1])
    dc = np.zeros_like(dh)
    for t, h0, c0, i, f, o, a, tc, m in reversed(memo):
        dh = dh + dhs[:, t]
        dho, dco = np.where(m, dh, 0), np.where(m, dc, 0)
        dct = dho * o * (1 - tc ** 2) + dco
        dz = np.concatenate([dct * a * i * (1 - i), dct * c0 * f * (1 - f), dho * tc * o * (1 - o),
                             dct * i * (1 - a ** 2)], 1)
        gw[:WIDTH] += x[:, t].T @ dz
        gw[WIDTH:] += h0.T @ dz
        gc += dz.sum(0)
        dh = dz @ w[WIDTH:].T + np.where(m, 0, dh)
        dc = np.where(m, dct * f, dc)
    return {f"w{d}": gw, f"c{d}": gc}


def probabilities(p: dict, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    both = np.concatenate([_forward(p, d, x, live, False)[0] for d in "fb"], 2)
    return _sigmoid(both @ p["v"] + p["o"])


def _pad(seqs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in seqs)
    x, live = np.zeros((len(seqs), steps, width), np.float32), np.zeros((len(seqs), steps), bool)
    for i, s in enumerate(seqs):
        x[i, :len(s)], live[i, :len(s)] = s.reshape(len(s), -1), True
    return x, live


def train(seqs: list[np.ndarray], marks: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Adam on the mean cross entropy of blocks, pages in batches of 32 by length."""
    rng = np.random.default_rng(SEED)
    p = init(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    groups = [order[i:i + 32] for i in range(0, len(order), 32)]
    step = 0
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            x, live = _pad([seqs[i] for i in groups[g]], WIDTH)
            y = _pad([marks[i].astype(np.float32)[:, None] for i in groups[g]], 1)[0][:, :, 0]
            (hf, memo_f), (hb, memo_b) = (_forward(p, d, x, live, True) for d in "fb")
            both = np.concatenate([hf, hb], 2)
            err = np.where(live, _sigmoid(both @ p["v"] + p["o"]) - y, 0) / live.sum()
            grad = {"v": np.einsum("bt,bth->h", err, both), "o": err.sum(keepdims=True)[0]}
            back = err[:, :, None] * p["v"]
            grad |= _backward(p, "f", x, memo_f, back[:, :, :HIDDEN])
            grad |= _backward(p, "b", x, memo_b, back[:, :, HIDDEN:])
            step += 1
            size = np.sqrt(sum(float((v ** 2).sum()) for v in grad.values()))
            for k, v in grad.items():
                v = v * min(1.0, 1.0 / max(size, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v ** 2
                p[k] = (p[k] - 0.01 * (m1[k] / (1 - 0.9 ** step))
                        / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


# --- weak labels ---------------------------------------------------------------------

_MAIN = re.compile(r"(^|\s)(article|main)(\s|$)|\.(content|article|post|entry|story|article-body|post-content)(\s|$)")
_REST = re.compile(r"(^|\s)(nav|header|footer|aside|form|menu|title|button|select|label|dialog)(\s|$)"
                   r"|\.\S*(\bad\b|ads|advert|menu|sidebar|comment|cookie|banner|notice|promo|share|related|newsletter)")


def weak_labels(found: list[Block]) -> np.ndarray | None:
    """1 for blocks inside a named article and outside named extras; None if the page names none."""
    main = [any(_MAIN.search(e) for e in path) for path, _, _ in found]
    if not any(main):
        return None
    # Classes of the page itself (body.has-sidebar) do not tell its blocks apart.
    rest = [any(_REST.search(e) for e in path if e.split()[0] not in ("html", "body")) for path, _, _ in found]
    return np.array([a and not b for a, b in zip(main, rest, strict=True)], np.int64)


_CONTAINERS = (("article",), ("main", "article"), ("main",), ("div div.content",), ("div div.post-content",), ("section",),
               ("div div.entry",), ("div div.wrapper", "div"), ("table", "tr", "td"), (), ("div div.article-body",),
               ("div div.container", "main main.main", "section"))
_EXTRAS = (  # path below body, words, share of link text, number of blocks
    (("nav", "ul", "li"), 2, 1, 6), (("header",), 4, 0, 1), (("header", "h1"), 3, 0, 1), (("div div.menu", "a"), 2, 1, 5),
    (("aside", "p"), 12, 0, 2), (("aside", "h3"), 3, 0, 1), (("div div.sidebar", "ul", "li"), 5, 1, 4),
    (("div div.ad",), 7, 0, 1), (("div div.advertisement", "p"), 9, 0, 1), (("div div.cookie-notice",), 14, 0, 1),
    (("div div.banner div.notice", "p"), 10, 0, 1), (("form", "label"), 2, 0, 3), (("form", "button"), 1, 0, 1),
    (("footer",), 12, 0, 1), (("footer", "p"), 10, 0, 1), (("div div.related", "ul", "li"), 7, 1, 4),
    (("section section.comments", "div div.comment", "p"), 25, 0, 3), (("div div#comments div.comments", "p"), 20, 0, 3),
    (("ul ul.comment-list", "li"), 22, 0, 3), (("div div.newsletter", "form", "p"), 9, 0, 1),
    (("div div.share", "a"), 1, 1, 3), (("div div.breadcrumbs", "a"), 1, 1, 3))


def variant(rng: np.random.Generator, body: list[Block], words: list[str]) -> tuple[list[Block], np.ndarray]:
    """The article blocks ``body`` in another skeleton, with extras around and inside."""
    where = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    top = ("html", "body")

    def extra() -> list[Block]:
        path, n, link, count = _EXTRAS[rng.integers(len(_EXTRAS))]
        got = []
        for _ in range(int(rng.integers(1, count + 1))):
            at, size = int(rng.integers(len(words))), max(1, int(n * rng.uniform(0.5, 2)))
            text = " ".join(words[at:at + size]) or words[0]
            inside = where if rng.random() < 0.3 else ()
            got.append((top + inside + path, text, len(text) if link else 0))
        return got

    main = [(top + where + (p[-1:] if p and p[-1].split()[0] not in ("article", "body", "html") else ()), t, n)
            for p, t, n in body]
    before = [b for _ in range(int(rng.integers(1, 5))) for b in extra()]
    after = [b for _ in range(int(rng.integers(1, 5))) for b in extra()]
    found, marks = before + main + after, [0] * len(before) + [1] * len(main) + [0] * len(after)
    if rng.random() < 0.3 and len(main) > 2:
        at, inside = len(before) + int(rng.integers(1, len(main))), extra()
        found[at:at], marks[at:at] = inside, [0] * len(inside)
    return found, np.array(marks)


_SKELETON = ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul></nav><article>"
             "<h1>A title of an article</h1><p>The first paragraph has some sentences. They are long enough to read.</p>"
             "<p>Another paragraph goes on, with more words, and ends here.</p></article><footer>Imprint and contact</footer>"
             "</body></html>")


def fit(pages: list[str]) -> dict[str, np.ndarray]:
    """A labeller from raw pages (weakly labelled) and their variants."""
    rng, features = np.random.default_rng(SEED), Features()
    parsed = [blocks(h) for h in pages + [_SKELETON] * 8]
    labelled = [(f, y) for f in parsed if f and (y := weak_labels(f)) is not None]
    words = " ".join(t for f, _ in labelled for _, t, _ in f).split()
    seqs, marks = [], []
    for f, y in labelled:
        body = [b for b, m in zip(f, y, strict=True) if m]
        for g, z in [(f, y), *(variant(rng, body, words) for _ in range(VARIANTS if body else 0))]:
            seqs.append(features(g))
            marks.append(z)
    return train(seqs, marks)


# --- Spark -----------------------------------------------------------------------------

def main_texts(p: dict, features: Features, pages: list[str]) -> list[str]:
    found = [blocks(h) for h in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    while order:
        longest = len(found[order[-1]])
        n = max(1, BATCH_CELLS // longest)
        part, order = order[-n:], order[:-n]
        x, live = _pad([features(found[i]) for i in part], WIDTH)
        keep = probabilities(p, x, live) > 0.5
        for row, i in enumerate(part):
            out[i] = "\n".join(t for (_, t, _), k in zip(found[i], keep[row], strict=False) if k)
    return out


def extract(pages: DataFrame, page: str = "html", ident: str = "page_id") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the html column."""
    keep = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    raw = F.coalesce(F.col(f"`{page}`"), F.lit(""))
    # Only hashes are ordered; then the few pages below the cut come to the driver.
    small = pages.where(F.length(raw).between(1, SAMPLE_CHARS)).select(raw.alias("html"), F.xxhash64(raw).alias("hash"))
    least = [r["hash"] for r in small.select("hash").distinct().orderBy("hash").limit(SAMPLE).collect()]
    sample = small.where(F.col("hash") <= F.lit(least[-1])).dropDuplicates(["hash"]).orderBy("hash").collect() if least else []
    model = fit([r["html"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in row_slices(batch, batch.column(0), SLICE_CHARS):
                texts = main_texts(model, features, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"])

    kept = [F.col(f"`{c}`") for c in keep]
    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(raw.alias(fresh(keep, "_html")[0]), *kept).mapInArrow(run, schema)
