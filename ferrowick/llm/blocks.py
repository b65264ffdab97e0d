"""Main text of HTML pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags). Each block becomes a
vector: hashed words of its tag path (tags, classes, ids, roles), hashed words of its text, and a
few counts. A bidirectional LSTM in numpy reads the blocks of the whole page and labels each one
article or not, so a paragraph of a reader comment and one of the article differ by what
surrounds them. It is trained on a bounded sample of the table's own pages, labelled where their
semantic tags say so, and on made-up pages that wrap the same words in many layouts.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, MADE_UP = 300, 800
BUCKETS, EMBED, HIDDEN, COUNTS = 1 << 13, 12, 20, 8

# fixed values: HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()) | frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics annotation svg g text tspan textpath".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot select menu".split())

ARTICLE = frozenset(["article", "main"])
# fixed values: tag and class words that stand for page furniture
FURNITURE = frozenset("nav aside footer form .nav .navbar .menu .ad .ads .advert .banner .promo .sponsored .sidebar .comment .comments .cookie .notice .consent .share .social .related .newsletter .subscribe .breadcrumb .breadcrumbs .footer .hidden".split())
ROLES = ARTICLE | FURNITURE
WINDOW = 32  # of a block's path: its last so many tags and names; of those before, only what ROLES lists

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "link")

    def __init__(self, path: tuple[str, ...], text: str, link: int):
        self.path, self.text, self.link = path, text, link


def _hints(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                out += ["." + w for w in _NAME.findall(value)]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out.append(".hidden")
    return tuple(out)


def shortened(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path's last WINDOW entries and, before them, the ROLES among the others, each once: so a page of
    deeply nested tags takes memory in proportion to its length."""
    if len(path) <= WINDOW:
        return path
    return (*dict.fromkeys(p for p in path[:-WINDOW] if p in ROLES), *path[-WINDOW:])


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; scripts, styles, comments and titles have none.

    White space within a block is one space and character references are decoded. Unclosed and
    crossed tags are closed as their nesting demands; nothing raises.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []  # open tags, each with the path of what it holds
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    link = 0  # characters within links

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else (), text, link))
            parts.clear()
        link = 0

    def close_to(i: int) -> None:
        if any(t not in INLINE for t, _ in stack[i:]):
            flush()
        for t, _ in stack[i:]:
            opened[t] -= 1
        del stack[i:]

    def say(text: str) -> None:
        nonlocal link
        parts.append(text)
        if opened["a"] > 0:
            link += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close_to(i)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P and opened["p"] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close_to(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif tag in SAME and any(opened[t] > 0 for t in SAME[tag]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SAME[tag]:
                        close_to(i)
                        break
                    if stack[i][0] in STOPS:
                        break
        if attrs.endswith("/") and tag in INLINE:
            continue
        path = stack[-1][1] if stack else ()
        stack.append((tag, path if tag in INLINE else shortened(path + _hints(tag, attrs))))
        opened[tag] += 1
    flush()
    return out


# ---------------------------------------------------------------- features


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


class Featurizer:
    """Blocks to (hashed features, their weights, counts); caches words and path parts, bounded."""

    def __init__(self, most: int = 300_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def _ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen = {}
        seen = self.seen
        for t in tokens:
            if t not in seen:
                seen[t] = _bucket(t)
        return np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))

    def page(self, blocks: list[Block], drop: np.random.Generator | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        feats, counts = [], np.zeros((len(blocks), COUNTS), np.float32)
        total = sum(len(b.text) for b in blocks) or 1
        for i, b in enumerate(blocks):
            path = [f"<{p}" for p in b.path] + [f"^{p}" for p in b.path[-3:]]
            words = b.text.lower().split()
            # in training, every other block hides its words, so that a menu's words alone do not make a menu
            f, w = self._ids(path), self._ids(words if drop is None or drop.random() < 0.5 else [])
            # a short text says little by its words
            weight = np.concatenate([np.full(len(f), 1 / max(1, len(f))), np.full(len(w), 0.5 / (len(w) + 6))])
            feats.append((np.concatenate([f, w]), weight))
            n = len(b.text)
            stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
            counts[i] = (np.log1p(n) / 5, min(1, b.link / n), min(1, 10 * stops / n), np.log1p(len(words)) / 4, i / len(blocks), n / total, len(b.path) / 8, 1.0)
        return feats, counts


class BlockLabeller:
    """Bidirectional LSTM over blocks, one logit each."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = EMBED + COUNTS, HIDDEN
        mat = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"E": mat(BUCKETS, EMBED) * 10, "Wf": mat(d, 4 * h), "Uf": mat(h, 4 * h), "bf": np.zeros(4 * h, np.float32), "Wb": mat(d, 4 * h), "Ub": mat(h, 4 * h), "bb": np.zeros(4 * h, np.float32), "o": mat(2 * h, 1), "c": np.zeros(1, np.float32)}
        self.p["bf"][h : 2 * h] = self.p["bb"][h : 2 * h] = 1  # forget gates start open

    @staticmethod
    def _sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """Padded (pages, blocks, dim) inputs and the mask."""
        n, t = len(pages), max(len(c) for _, c in pages)
        x, mask = np.zeros((n, t, EMBED + COUNTS), np.float32), np.zeros((n, t), np.float32)
        for i, (feats, counts) in enumerate(pages):
            if not feats:
                continue
            ids, w = np.concatenate([f for f, _ in feats]), np.concatenate([v for _, v in feats])
            starts = np.cumsum([0, *(len(f) for f, _ in feats)])[:-1]
            x[i, : len(feats), :EMBED] = np.add.reduceat(self.p["E"][ids] * w[:, None].astype(np.float32), starts, axis=0)
            x[i, : len(feats), EMBED:] = counts
            mask[i, : len(feats)] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        w, u, b, h = self.p["W" + way], self.p["U" + way], self.p["b" + way], HIDDEN
        n, t, _ = x.shape
        z_in = x @ w + b
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((n, t, h), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = z_in[:, k] + hs @ u
            i, f, o, g = self._sig(z[:, :h]), self._sig(z[:, h : 2 * h]), self._sig(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[:, k, None]
            c2 = f * cs + i * g
            h2 = o * np.tanh(c2)
            if keep:
                tape.append((k, i, f, o, g, cs, c2, hs))
            cs, hs = m * c2 + (1 - m) * cs, m * h2 + (1 - m) * hs
            out[:, k] = hs
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return (both @ self.p["o"])[..., 0] + self.p["c"][0], both, tf, tb

    def _back(self, dout: np.ndarray, x: np.ndarray, mask: np.ndarray, way: str, tape: list, grads: dict) -> np.ndarray:
        h, u, w = HIDDEN, self.p["U" + way], self.p["W" + way]
        dh, dc = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][1])
        dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
        for k, i, f, o, g, c0, c2, h0 in reversed(tape):
            m = mask[:, k, None]
            dh = dh + dout[:, k]
            tc = np.tanh(c2)
            dcm = dc * m + dh * m * o * (1 - tc**2)
            dz = np.concatenate([dcm * g * i * (1 - i), dcm * c0 * f * (1 - f), dh * m * tc * o * (1 - o), dcm * i * (1 - g**2)], 1)
            dz_all[:, k] = dz
            grads["U" + way] += h0.T @ dz
            dh = dh * (1 - m) + dz @ u.T
            dc = dc * (1 - m) + dcm * f
        grads["W" + way] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grads["b" + way] += dz_all.sum((0, 1))
        return dz_all @ w.T

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = 9, rate: float = 0.01, batch: int = 16, seed: int = 3) -> BlockLabeller:
        rng, t = np.random.default_rng(seed), 0
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = [i for i in range(len(pages)) if len(labels[i])]
        for _ in range(epochs):
            rng.shuffle(order)
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                x, mask = self.inputs([pages[i] for i in rows])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(rows):
                    y[r, : len(labels[i])] = labels[i]
                z, both, tf, tb = self.logits(x, mask, keep=True)
                dz = (self._sig(z) - y) * mask / max(1, mask.sum())
                g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "E"}
                g["o"] += np.tensordot(both, dz, ((0, 1), (0, 1)))[:, None]
                g["c"] += dz.sum()
                dboth = dz[..., None] * self.p["o"][:, 0]
                dx = self._back(dboth[..., :HIDDEN], x, mask, "f", tf, g) + self._back(dboth[..., HIDDEN:], x, mask, "b", tb, g)
                ids = np.concatenate([f for i in rows for f, _ in pages[i][0]])
                w = np.concatenate([v for i in rows for _, v in pages[i][0]])
                to = np.repeat(np.flatnonzero(mask.reshape(-1)), [len(f) for i in rows for f, _ in pages[i][0]])
                de = dx.reshape(-1, dx.shape[2])[to, :EMBED] * w[:, None]
                names, back = np.unique(ids, return_inverse=True)
                ge = np.zeros((len(names), EMBED), np.float32)
                np.add.at(ge, back, de.astype(np.float32))
                t += 1
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                scale = min(1, 1 / max(norm, 1e-9))
                fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
                for k, v in g.items():
                    v = v * scale
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v**2 - m2[k])
                    self.p[k] -= rate * (m1[k] / fix1) / (np.sqrt(m2[k] / fix2) + 1e-8)
                m1["E"][names] += 0.1 * (ge - m1["E"][names])
                m2["E"][names] += 0.001 * (ge**2 - m2["E"][names])
                self.p["E"][names] -= rate * (m1["E"][names] / fix1) / (np.sqrt(m2["E"][names] / fix2) + 1e-8)
        return self

    def label(self, pages: list, batch: int = 64) -> list[np.ndarray]:
        """For each page its blocks' logits; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i][0]), key=lambda i: len(pages[i][0]))
        while order:
            most = len(pages[order[-1]][0])
            take = max(1, min(batch, 40_000 // most))  # bounds the padded blocks in memory
            rows, order = order[-take:], order[:-take]
            x, mask = self.inputs([pages[i] for i in rows])
            z = self.logits(x, mask)[0]
            for r, i in enumerate(rows):
                out[i] = z[r, : len(pages[i][0])]
        return out


# ---------------------------------------------------------------- training pages



def tagged_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks in article or main and in no furniture; None if the page has no such tags."""
    if not any(p in ARTICLE for b in blocks for p in b.path):
        return None
    return np.array([float(any(p in ARTICLE for p in b.path) and not any(p in FURNITURE for p in b.path)) for b in blocks], np.float32)


def made_up_page(rng: np.random.Generator, words: list[str]) -> tuple[str, list[str]]:
    """A page of random layout over the given words, and the texts of its article blocks in order."""
    pick = lambda *a: a[rng.integers(len(a))]
    some = lambda p: rng.random() < p

    def prose(low: int, high: int) -> str:
        n = int(rng.integers(low, high))
        out, start = [], True
        for k in rng.integers(0, len(words), n):
            w = words[k]
            w, start = (w.capitalize() if start else w), False
            if some(0.1):
                w, start = w + ".", True
            elif some(0.07):
                w += ","
            out.append(w)
        return html_lib.escape(" ".join(out) + ".", quote=False)

    named = some(0.85)

    def box(tags: tuple[str, ...], names: tuple[str, ...], inner: str) -> str:
        tag = pick(*tags)
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">{inner}</{tag}>' if named or tag in ("div", "section") and some(0.6) else f"<{tag}>{inner}</{tag}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{prose(1, 4)}</a></li>' for k in range(n)) + "</ul>"
    paras = lambda n, low=8, high=50: "".join(f"<p>{prose(low, high)}</p>" for _ in range(n))
    furniture = {
        "nav": lambda: box(("nav", "div", "ul"), ("nav", "menu", "navbar", "main-menu"), links(int(rng.integers(3, 9)))),
        "head": lambda: box(("header", "div"), ("header", "site-header", "top", "masthead"), pick("", "<h1>" + prose(1, 4) + "</h1>", "<p>" + prose(3, 9) + "</p>") + pick("", links(4))),
        "crumb": lambda: box(("div", "ol"), ("breadcrumb", "breadcrumbs"), links(3)),
        "ad": lambda: box(("div", "aside", "section"), ("ad", "ads", "advert", "banner", "promo", "sponsored", "advertisement"), pick(prose(4, 25), paras(1))),
        "notice": lambda: box(("div", "section", "aside"), ("cookie-notice", "notice", "consent", "cookie-banner", "alert"), paras(1, 6, 30) + pick("", "<button>Accept</button>")),
        "form": lambda: f'<form action="/{pick("search", "login", "subscribe")}"><label>{prose(1, 4)}</label><input name="q">{pick("", paras(1, 4, 15))}<button>{prose(1, 2)}</button></form>',
        "side": lambda: box(("aside", "div"), ("sidebar", "side", "widget", "widgets"), pick(links(5), paras(2), "<h3>" + prose(1, 3) + "</h3>" + links(4))),
        "related": lambda: box(("div", "section", "aside"), ("related", "related-posts", "more", "recommended"), "<h3>" + prose(1, 3) + "</h3>" + links(4)),
        "share": lambda: box(("div", "ul"), ("share", "social", "sharing"), links(3)),
        "comments": lambda: box(("section", "div", "ol"), ("comments", "comment-list", "discussion", "responses"), pick("", "<h2>" + prose(1, 3) + "</h2>") + "".join(f'<{c} class="comment">{pick("", "<b>" + prose(1, 2) + "</b>")}<p>{prose(4, 45)}</p></{c}>' for c in [pick("div", "article", "li")] * int(rng.integers(1, 6)))),
        "foot": lambda: box(("footer", "footer", "div"), ("footer", "site-footer", "bottom"), pick(prose(4, 20), paras(1, 4, 20), "&copy; " + prose(2, 12) + links(3))),
    }
    mark = "\0"
    body = [f"<h1>{mark}{prose(2, 10)}{mark}</h1>"] if some(0.8) else []
    if some(0.2):
        body[:1] = ["<header>" + "".join(body[:1]) + "</header>"] if body else []
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.75:
            body.append(f"<p>{mark}{pick('', '<b>', '<em>')}{prose(1, 90)}{mark}{pick('</p>', '</p>', '')}")
        elif kind < 0.85:
            body.append(f"<{(t := pick('h2', 'h3', 'blockquote'))}>{mark}{prose(1, 12)}{mark}</{t}>")
        elif kind < 0.93:
            body.append("<ul>" + "".join(f"<li>{mark}{prose(2, 14)}{mark}</li>" for _ in range(3)) + "</ul>")
        else:
            body.append(furniture[pick("ad", "related", "share", "form", "side", "notice")]())
    inner = "".join(body)
    holder = pick("article", "article", "main", "div", "div", "section")
    if holder in ("div", "section"):
        inner = f'<{holder} {pick("class", "id")}="{pick("content", "post", "entry-content", "story", "article-body", "main-content", "text")}">{inner}</{holder}>'
    else:
        inner = f"<{holder}>{inner}{furniture['comments']() if some(0.15) else ''}</{holder}>"
    before = [furniture[k]() for k in ("head", "nav", "crumb", "ad", "notice", "form", "side") if some(0.45)]
    after = [furniture[k]() for k in ("share", "related", "comments", "side", "ad", "form", "notice", "foot") if some(0.45)]
    page = "".join(before) + inner + "".join(after)
    if some(0.3):
        page = f'<div class="{pick("page", "wrapper", "container")}">{page}</div>'
    page = f"<html><head><title>{prose(2, 6)}</title></head><body>{page}</body></html>"
    return page, mark


def training_set(pages: list[str | None], made_up: int = MADE_UP, seed: int = 11, most_blocks: int = 400, head: tuple[int, int] = (40, 60), vocabulary: int = 20_000) -> tuple[list, list[np.ndarray]]:
    """Featurised pages and block labels: tagged pages as they are, and made-up pages over their words.

    What bounds the training alone: pages of more than ``most_blocks`` blocks are not learned from, and the
    made-up pages' words are ``vocabulary`` of those in the first ``head`` blocks and words of a block.
    """
    rng, feat, xs, ys, words = np.random.default_rng(seed), Featurizer(), [], [], set()
    for page in pages:
        blocks = leaf_blocks(page or "")
        y = tagged_labels(blocks)
        if y is not None and len(blocks) <= most_blocks:
            xs.append(feat.page(blocks, rng))
            ys.append(y)
        for b in blocks[: head[0]]:
            words.update(w.strip(".,!?") for w in b.text.lower().split()[: head[1]])
    words = sorted(w for w in words if w.isalpha())[:vocabulary] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    for _ in range(made_up):
        page, mark = made_up_page(rng, words)
        blocks = leaf_blocks(page)
        ys.append(np.array([float(mark in b.text) for b in blocks], np.float32))
        for b in blocks:
            b.text = " ".join(b.text.replace(mark, " ").split())
        xs.append(feat.page(blocks, rng))
    return xs, ys


# ---------------------------------------------------------------- operators


def train_labeller(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = TRAIN_PAGES) -> BlockLabeller:
    """Fits on at most ``rows`` pages (the least hashes of the key, so the same at every run) and MADE_UP others."""
    ids = pages.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(3), F.col(key)), F.col(key)).limit(rows).distinct()
    got = pages.select(F.col(key), F.col(html).cast("string").alias("_html")).join(F.broadcast(ids), key)
    got = got.orderBy(F.xxhash64(F.lit(3), F.col(key)), F.col(key), F.col("_html")).limit(rows)
    return BlockLabeller().fit(*training_set([r["_html"] for r in got.select("_html").toLocalIterator()]))


def extract_blocks(pages: DataFrame, model: BlockLabeller, key: str = "page_id", url: str = "url", html: str = "html", cut: float = 0.0) -> DataFrame:
    """One row per page: key, url, text (its article blocks joined by one space; empty if none),
    n_chars (code points), n_blocks and kept_blocks.

    Null html counts as empty; rows are independent, so null keys and urls, repeats and empty
    tables pass as they are; other columns are ignored. Memory is bounded by a few pages.
    """
    kinds = dict(pages.dtypes)
    cast = pages.sparkSession.sparkContext.broadcast(model.p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BlockLabeller()
        net.p = cast.value
        feat = Featurizer()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                blocks = [leaf_blocks(h or "") for h in part.column(2).to_pylist()]
                marks = net.label([feat.page(x) for x in blocks])
                texts = [" ".join(x.text for x, z in zip(page, m, strict=True) if z > cut) for page, m in zip(blocks, marks, strict=True)]
                cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in blocks], pa.int32()), pa.array([int((m > cut).sum()) for m in marks], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], [key, url, "text", "n_chars", "n_blocks", "kept_blocks"])

    picked = pages.select(F.col(key), F.col(url), F.col(html).cast("string").alias("_html"))
    return picked.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long, n_blocks int, kept_blocks int")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    return extract_blocks(pages, train_labeller(pages, key, html), key, url, html)
