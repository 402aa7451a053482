"""Main text of web pages: a recurrent labeller of leaf blocks, trained and run in numpy.

A page is its sequence of leaf blocks. Each is read as a tag-path vector (hashed embeddings of the tags,
class and id words around it), a hashed-word vector and a few counts; a bidirectional LSTM over the whole
page labels every block as article or not, and the article's blocks are the text.

Nobody labelled the pages, so labels are drawn from what pages say themselves: a bounded sample of pages
with <article> or <main> is labelled by it, and the same texts are dressed anew as pages of other layouts
(other containers, side bars, notices, forms, comments, adverts), with labels known from the dressing.

Edge cases: null and empty html, and pages without text, give an empty text of 0 characters; repeated
rows are rows of their own; unfinished tags and unclosed elements are passed over; an empty table, or one
without any labelled page, is labelled by the dressed pages alone, which then use a few plain words. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.html_blocks import PATH_BUCKETS, Leaf, leaf_blocks
from raglens.llm.shared import schema_of
from raglens.llm.words import slices, text_of, tidy, words_of

WORD_BUCKETS, WORD_DIMS, PATH_DIMS, HIDDEN, COUNTS = 1 << 13, 12, 20, 20, 8
#: Labelled pages at most, the most characters of one, and pages dressed anew.
LABELLED, LABELLED_CHARS, DRESSED = 300, 1 << 16, 900
EPOCHS, BATCH, RATE = 9, 32, 0.01
#: Blocks times pages of a batch of the labeller.
PADDED = 1 << 15

#: Names around blocks that aren't the article, for labels of sampled pages.
ASIDE_TAGS = set("nav aside footer form button menu select dialog".split())
ASIDE_WORDS = set("ad ads advert advertisement banner breadcrumb comment comments consent cookie disqus footer form menu nav navbar newsletter notice popup promo related share sidebar social sponsor sponsored subscribe toolbar widget".split())


@dataclass
class Labeller:
    """Parameters of the network, by name."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng, dims = np.random.default_rng(seed), PATH_DIMS * 2 + WORD_DIMS + COUNTS
        p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIMS)), "inner": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIMS)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIMS)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in ("f", "b"):
            p |= {f"w{side}": rng.normal(0, dims**-0.5, (dims, 4 * HIDDEN)), f"u{side}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{side}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, blocks: Blocks) -> np.ndarray:
        """A vector for each block."""
        path = _bags(self.p["path"], blocks.path, blocks.path_at, 0.5)
        word = _bags(self.p["word"], blocks.word, blocks.word_at, 1.0)
        return np.concatenate((path, self.p["inner"][blocks.inner], word, blocks.counts), axis=1)

    def scores(self, blocks: Blocks) -> np.ndarray:
        """The probability of each block to be article."""
        x, out = self.inputs(blocks), np.zeros(len(blocks.inner), np.float32)
        for pages in _batches(blocks.sizes):
            at, mask = _layout(blocks, pages)
            logit = self._states(x, at, mask, None) + self.p["bias"][0]
            out[at[mask]] = 1 / (1 + np.exp(-logit[mask]))
        return out

    def _states(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, cache: dict | None) -> np.ndarray:
        """Logits (without bias), places x pages; padding comes after a page's last block in both directions."""
        logit = np.zeros(at.shape, np.float32)
        for side in ("f", "b"):
            turn = _reversed(mask) if side == "b" else np.broadcast_to(np.arange(len(at))[:, None], at.shape)
            order = np.take_along_axis(at, turn, 0)
            xs = x[order]
            pre = xs @ self.p["w" + side] + self.p["c" + side]
            h = c = np.zeros((at.shape[1], HIDDEN), np.float32)
            hs, own = np.zeros((*at.shape, HIDDEN), np.float32), []
            for t in range(len(at)):
                gates = pre[t] + h @ self.p["u" + side]
                sig = 1 / (1 + np.exp(-gates[:, : 3 * HIDDEN]))
                i, f, o, g = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :], np.tanh(gates[:, 3 * HIDDEN :])
                before_h, before_c = h, c
                c = f * c + i * g
                tc = np.tanh(c)
                h = o * tc
                hs[t] = h
                if cache is not None:
                    own.append((i, f, o, g, before_h, before_c, tc))
            part = hs @ self.p["out"][:HIDDEN] if side == "f" else hs @ self.p["out"][HIDDEN:]
            np.put_along_axis(back := np.zeros_like(part), turn, part, 0)
            logit += back
            if cache is not None:
                cache[side] = (turn, order, xs, hs, own)
        return logit

    def gradients(self, blocks: Blocks, labels: np.ndarray, pages: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross entropy over the blocks of some pages."""
        x, cache = self.inputs(blocks), {}
        at, mask = _layout(blocks, pages)
        logit = self._states(x, at, mask, cache) + self.p["bias"][0]
        prob, y = 1 / (1 + np.exp(-logit)), labels[at]
        n = max(mask.sum(), 1)
        loss = -np.log(np.where(y == 1, prob, 1 - prob)[mask] + 1e-7).sum() / n
        dlogit = np.where(mask, prob - y, 0).astype(np.float32) / n
        grads, dx = {k: np.zeros_like(v) for k, v in self.p.items()}, np.zeros_like(x)
        grads["bias"][0] = dlogit.sum()
        for side in ("f", "b"):
            turn, order, xs, hs, own = cache[side]
            half = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            d = np.take_along_axis(dlogit, turn, 0)
            grads["out"][half] = np.tensordot(d, hs, ((0, 1), (0, 1)))
            u, dh, dc = self.p["u" + side], 0.0, 0.0
            dgates = np.zeros((*at.shape, 4 * HIDDEN), np.float32)
            for t in reversed(range(len(at))):
                i, f, o, g, before_h, before_c, tc = own[t]
                step = dh + d[t][:, None] * self.p["out"][half]
                dc = dc + step * o * (1 - tc * tc)
                dgates[t] = np.concatenate((dc * g * i * (1 - i), dc * before_c * f * (1 - f), step * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                grads["u" + side] += before_h.T @ dgates[t]
                dh, dc = dgates[t] @ u.T, dc * f
            grads["w" + side] = np.tensordot(xs, dgates, ((0, 1), (0, 1)))
            grads["c" + side] = dgates.sum((0, 1))
            np.add.at(dx, order, np.where(np.take_along_axis(mask, turn, 0)[..., None], dgates @ self.p["w" + side].T, 0))
        _spread(grads["path"], dx[:, :PATH_DIMS], blocks.path, blocks.path_at, 0.5)
        np.add.at(grads["inner"], blocks.inner, dx[:, PATH_DIMS : 2 * PATH_DIMS])
        _spread(grads["word"], dx[:, 2 * PATH_DIMS : 2 * PATH_DIMS + WORD_DIMS], blocks.word, blocks.word_at, 1.0)
        return grads, float(loss)


@dataclass
class Blocks:
    """Leaf blocks of some pages as arrays; bags of path tokens and words lie end to end."""

    sizes: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    inner: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Leaf]]) -> Blocks:
        leaves = [x for page in pages for x in page]
        sizes = np.array([len(p) for p in pages], np.int64)
        text = text_of(pa.array([x.text for x in leaves], pa.large_string()))
        words = words_of(text, lower=True)
        tokens = np.array([len(x.path) for x in leaves], np.int64)
        path = np.fromiter((t for x in leaves for t in x.path), np.int64, int(tokens.sum()))
        n, chars = words.counts.astype(np.float32), np.maximum(np.diff(text.offsets), 1).astype(np.float32)
        marks = np.concatenate(([0], np.cumsum(_MARKS[text.data])))
        digits = np.concatenate(([0], np.cumsum((text.data >= 0x30) & (text.data <= 0x39))))
        place = np.arange(len(leaves)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of_page = np.repeat(sizes, sizes).astype(np.float32)
        ends = np.array([x.text[-1] in ".!?…:;\"”" for x in leaves], np.float32)
        counts = np.stack((np.log1p(n) / 3, np.array([x.linked for x in leaves], np.float32), (marks[text.offsets[1:]] - marks[text.offsets[:-1]]) / chars * 10, (digits[text.offsets[1:]] - digits[text.offsets[:-1]]) / chars, ends, place / np.maximum(of_page, 1), np.log1p(of_page) / 4, chars / np.maximum(n, 1) / 10), axis=1) if leaves else np.zeros((0, COUNTS))
        inner = np.array([x.inner for x in leaves], np.int64)
        return cls(sizes, path, np.concatenate(([0], np.cumsum(tokens))), inner, (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), words.first, counts.astype(np.float32))


_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True


def _bags(table: np.ndarray, ids: np.ndarray, at: np.ndarray, power: float) -> np.ndarray:
    """The sum of each bag's rows, over its size to a power."""
    out, sizes = np.zeros((len(at) - 1, table.shape[1]), np.float32), np.diff(at)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(table[ids], at[:-1][some], axis=0) / sizes[some, None].astype(np.float32) ** power
    return out


def _spread(grads: np.ndarray, d: np.ndarray, ids: np.ndarray, at: np.ndarray, power: float) -> None:
    sizes = np.diff(at)
    scaled = d / np.maximum(sizes, 1)[:, None].astype(np.float32) ** power
    np.add.at(grads, ids, np.repeat(scaled, sizes, axis=0))


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pages of like length together: a batch pads to its longest."""
    order = np.argsort(sizes, kind="stable")
    order, first = order[sizes[order] > 0], 0
    while first < len(order):
        last = first + 1
        while last < len(order) and last - first < 256 and sizes[order[last]] * (last - first + 1) <= PADDED and sizes[order[last]] <= 2 * sizes[order[first]] + 8:
            last += 1
        yield order[first:last]
        first = last


def _layout(blocks: Blocks, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of blocks, places x pages, and which of them aren't padding."""
    starts, sizes = (np.cumsum(blocks.sizes) - blocks.sizes)[pages], blocks.sizes[pages]
    place = np.arange(sizes.max())[:, None]
    mask = place < sizes
    return np.where(mask, starts + place, 0), mask


def _reversed(mask: np.ndarray) -> np.ndarray:
    """Each page's places from last to first, then the padding."""
    sizes, place = mask.sum(0), np.arange(len(mask))[:, None]
    return np.where(mask, sizes - 1 - place, place)


# --- training -------------------------------------------------------------------


def own_label(leaf: Leaf) -> int:
    """Article, by the names around a block."""
    names = set(leaf.tags)
    aside = names & ASIDE_TAGS or any(n[1:] in ASIDE_WORDS for n in names if n[0] == ".")
    return int(bool(names & {"article", "main"}) and not aside)


def train(pages: DataFrame, labelled: int = LABELLED, dressed: int = DRESSED, seed: int = 7) -> Labeller:
    """Fitted on at most `labelled` pages of at most LABELLED_CHARS characters, and `dressed` ones from their texts.

    The sample is the pages of smallest hash; a bound on the hash, from their count, keeps all others in their tasks.
    """
    short = pages.where((F.length("html") <= LABELLED_CHARS) & F.lower("html").rlike("<(article|main)\\b")).select("html", F.xxhash64("page_id", "url", "html").alias("key"))
    n = short.count()
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * labelled // max(n, 1))
    sample = [r["html"] for r in short.where(F.col("key") <= bound).orderBy("key", "html").limit(labelled).collect()]
    own = [leaf_blocks(h, tags=True) for h in sample]
    labels = [[own_label(x) for x in p] for p in own]
    article = [x.text for p, y in zip(own, labels, strict=True) for x, k in zip(p, y, strict=True) if k] or ["The text of a page.", "It goes on here, with more words than before."]
    other = [x.text for p, y in zip(own, labels, strict=True) for x, k in zip(p, y, strict=True) if not k] or ["Home", "News", "About us"]
    made = [leaf_blocks(h, tags=True) for h in dressed_pages(article, other, dressed, seed)]
    every = [p for p in own + made if p]
    y = np.array([k for p, ks in [*zip(own, labels, strict=True), *((p, [x.label or 0 for x in p]) for p in made)] if p for k in ks], np.float32)
    return fit(every, y, seed)


def fit(pages: list[list[Leaf]], labels: np.ndarray, seed: int) -> Labeller:
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    starts, step = np.concatenate(([0], np.cumsum([len(p) for p in pages]))), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(pages))
        order = np.concatenate([o[np.argsort([len(pages[i]) for i in o], kind="stable")] for o in np.array_split(order, max(1, len(order) // (8 * BATCH)))])
        for first in range(0, len(order), BATCH):
            chosen = order[first : first + BATCH]
            # path tokens are left out by chance, so that context counts too
            own = [[Leaf(x.text, tuple(t for t in x.path if rng.random() > 0.1), x.inner if rng.random() > 0.1 else 0, x.linked) for x in pages[i]] for i in chosen]
            y = np.concatenate([labels[starts[i] : starts[i + 1]] for i in chosen])
            grads, _ = model.gradients(Blocks.of(own), y, np.arange(len(chosen)))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


#: How other sites name what a page holds besides its article, and the article itself.
_ARTICLE = ['article', 'main', 'article class="post"', 'div class="content"', 'div id="content"', 'div class="post-content"', 'div class="entry-content"', 'div class="article-body"', 'div class="story"', 'div id="main"', 'main role="main"', 'section class="article"', 'div itemprop="articleBody"', "div", "section", 'div class="text"']
_MENU = ["nav", 'div class="menu"', 'div id="nav"', 'ul class="navigation"', 'div class="navbar"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="topbar links"']
_HEADER = ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="top-bar"', 'div role="banner"']
_FOOTER = ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'aside class="related"', 'div class="related-posts"', 'div class="trending"', 'section class="recommended"', 'div role="complementary"']
_ADVERT = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div id="ad-1"', 'div class="promo"', 'div class="banner-ad"', 'p class="ad"', 'section class="sponsor"']
_NOTICE = ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="notice"', 'div role="alert"', 'div class="gdpr"', 'div class="popup"', 'div class="alert"', 'p class="notice"', 'div class="newsletter"', 'div class="subscribe"', 'dialog']
_COMMENTS = ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="disqus"', 'div class="responses"', 'section id="discussion"', 'div class="reader-comments"']
_FORM = ["form", 'form class="search"', 'form id="login"', 'div class="form"', 'form action="/s"']
_COMMENT = ["article", 'div class="comment"', "li", 'div class="comment-body"', "p", 'article class="comment"', "blockquote"]


def dressed_pages(article: list[str], other: list[str], n: int, seed: int) -> Iterator[str]:
    """Pages of many layouts with the given texts; data-y says which blocks are article."""
    draw = random.Random(seed)
    some = lambda of, low, high: [_plain(draw.choice(of)) for _ in range(draw.randint(low, high))]
    close = lambda tag: f"</{tag.split()[0]}>"
    inside = lambda tag, body, y=0: f'<{tag} data-y="{y}">{body}{close(tag)}'
    mixed = lambda: draw.choice((article, other))
    links = lambda: "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(some(other, 1, 9)))

    def menu():
        return inside(draw.choice(_MENU), draw.choice((f"<ul>{links()}</ul>", links().replace("<li>", "").replace("</li>", " "))))

    def header():
        return inside(draw.choice(_HEADER), draw.choice((f"<h1>{draw.choice(some(other, 1, 1))}</h1>", f"<p>{draw.choice(some(other, 1, 1))}</p>", f"<a href='/'>{draw.choice(some(other, 1, 1))}</a>", menu())))

    def footer():
        return inside(draw.choice(_FOOTER), draw.choice((f"&copy; {draw.choice(some(other, 1, 1))}", "".join(f"<p>{t}</p>" for t in some(mixed(), 1, 3)), f"<ul>{links()}</ul>")))

    def side():
        return inside(draw.choice(_SIDE), draw.choice(("", f"<h3>{draw.choice(some(other, 1, 1))}</h3>")) + draw.choice((f"<ul>{links()}</ul>", "".join(f"<p>{t}</p>" for t in some(article, 1, 3)))))

    def advert():
        return inside(draw.choice(_ADVERT), draw.choice((lambda: "".join(some(mixed(), 1, 1)), lambda: f"<p>{draw.choice(some(article, 1, 1))}</p>", lambda: f"<a href='#'>{draw.choice(some(article, 1, 1))}</a>"))())

    def notice():
        return inside(draw.choice(_NOTICE), draw.choice((f"<p>{draw.choice(some(article, 1, 1))}</p>", draw.choice(some(article, 1, 1)))) + draw.choice(("", "<button>OK</button>")))

    def form():
        return inside(draw.choice(_FORM), f"<label>{draw.choice(some(other, 1, 1))}</label><input>" + draw.choice(("<button>Send</button>", f"<p>{draw.choice(some(article, 1, 1))}</p>", "<select><option>a<option>b</select>")))

    def comments():
        tag = draw.choice(_COMMENT)
        rows = "".join(f"<{tag}>{draw.choice(('', '<b>' + t[:12] + '</b> '))}{draw.choice((f'<p>{t}</p>', t))}{close(tag)}" for t in some(article, 1, 6))
        return inside(draw.choice(_COMMENTS), draw.choice(("", "<h2>Comments</h2>", "<h3>3 responses</h3>")) + rows)

    def body():
        parts = [f"<h1>{draw.choice(some(article, 1, 1))}</h1>"] if draw.random() < 0.7 else []
        for t in some(article, 1, 14):
            kind = draw.random()
            if kind < 0.72:
                parts.append(f"<p>{t}</p>")
            elif kind < 0.8:
                parts.append(f"<p><b>{t}<br>")  # unclosed, as some pages are
            elif kind < 0.85:
                parts.append(f"<h{draw.choice('234')}>{t}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in some(article, 1, 4)) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{t}</blockquote>")
            elif kind < 0.96:
                parts.append(f"<table><tr><td>{t}</td><td>{draw.choice(some(article, 1, 1))}</td></tr></table>")
            else:
                parts.append(f"<pre>{t}</pre>")
            if draw.random() < 0.06:
                parts.append(draw.choice((advert, side, form, notice, menu))())
        tag = draw.choice(_ARTICLE)
        whole = inside(tag, "".join(parts), 1)
        return f"<{draw.choice(_ARTICLE)}>{whole}</div>" if draw.random() < 0.3 else whole

    for _ in range(n):
        before = [f() for f in (notice, header, menu, advert, form, side) if draw.random() < 0.45]
        after = [f() for f in (advert, side, comments, form, notice, footer, menu) if draw.random() < 0.45]
        page = f"<html><head><title>x</title></head><body>{''.join(before)}{body()}{''.join(after)}"
        yield page + draw.choice(("</body></html>", "", "</html>"))


def _plain(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


# --- extraction -----------------------------------------------------------------


def _extract(sent, names: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _ in slices(batch, "html", most):
                texts = main_texts(sent.value, rows.column("html").to_pylist())
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *made], [*names, "text", "n_chars"])

    return tidy(run)


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """The article's blocks of each page, a line each."""
    leaves = [leaf_blocks(h or "") for h in pages]
    chosen, at, out = model.scores(Blocks.of(leaves)) >= 0.5, 0, []
    for page in leaves:
        out.append("\n".join(x.text for x, y in zip(page, chosen[at : at + len(page)], strict=True) if y))
        at += len(page)
    return out


def main_text(pages: DataFrame, model: Labeller, most: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page; the model has a fixed size, so it goes to every task."""
    names = ["page_id", "url"]
    own = pages.select(*names, "html")
    sent = pages.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_extract(sent, names, most), schema_of(own, names, "text string, n_chars long"))
