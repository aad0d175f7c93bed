"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant reader turns a page into leaf blocks: runs of text between block tags, with the tags and the words of class,
id, role and label of their ancestors. Features are these, the shares of linked and upper-case text, sizes, signs and the place on
the page. The field has two labels (main, other), weights per label and feature and for neighbouring labels;
it is trained by maximum likelihood and decoded by Viterbi.

Labelled pages: at most ``train_pages`` pages of the table (smallest hashes of the id) whose markup says
what their blocks are, and for each ``variants`` pages made of their own texts in layouts that name
parts by tags or by class words, with menus, notices, adverts, forms, sidebars and comments inside and outside of the
article. Leaving tags out of some layouts makes the field weigh words and text as well.

Edge cases: null and empty pages give an empty text; unclosed and stray tags, unended comments and scripts are read on as
browsers do, roughly; a page without main blocks gives an empty text; repeated rows and null ids are kept; extra columns are ignored; without
any page to learn from the layouts are filled with a fixed sentence.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import chunks

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(.*?)(/?)>\Z", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul""".split())
#: With the blocks, the tags that cannot stand in a drawing and so end one left open.
SVG_ENDS = frozenset("b big br center code em embed hr i img meta nobr ruby s small span strike strong sub sup tt u var".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|noscript|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    rf"|<svg\b[^>]*+(?<!/)>.*?(?:</svg\s*>|(?=</?(?:{'|'.join(sorted(BLOCK | SVG_ENDS))})\b)|\Z)"  # a self-closing one is a tag like others
    r"""|<[a-zA-Z/!?](?:"[^"]*"|'[^']*'|[^'">])*+>|<[a-zA-Z/!?][^>]*>|[^<]+|<""", re.S | re.I)
#: Opening one of these ends an open one of the named, unless one of the last group lies between.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",)),
        "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "option": ("option", ("select",))}
MAIN_WORDS = "article content post entry story main text body-text".split()
OTHER_WORDS = """ad ads advert advertisement sponsored promo banner cookie consent notice alert sidebar menu nav navbar navigation breadcrumb header masthead
footer comments comment replies discussion related recommended share social subscribe newsletter pagination widget popup login search form copyright toolbar""".split()
OTHER_TAGS = "nav footer aside form header".split()


@dataclass(frozen=True)
class ExtractOptions:
    train_pages: int = 150
    variants: int = 2
    steps: int = 150
    rate: float = 0.15
    ridge: float = 0.05
    seed: int = 5


@dataclass
class Block:
    text: str
    tag: str
    path: tuple
    linked: int


def words_of(attributes: str) -> tuple[str, ...]:
    out = []
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "hidden" or (name.lower() == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("hidden")
        elif name.lower() != "style":
            out += [w for w in re.split(r"[^a-z]+", value.lower()) if w]
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str | None) -> list[Block]:
    blocks, stack, parts, linked = [], [], [], 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            tag = next((t for t, _ in reversed(stack) if t in BLOCK), "")
            blocks.append(Block(text, tag, tuple(stack), linked))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(page or ""):
        s = m.group()
        if s[0] != "<" or len(s) == 1:
            parts.append(s)
            if any(t == "a" for t, _ in stack):
                linked += len(s)
            continue
        tag = None if m.group(1) else TAG.match(s)
        if tag is None:
            if m.group(1) or s.startswith("<!--") or s[1] in "!?":
                continue
            parts.append(s if not s[1:2].isalpha() and s[1:2] != "/" else " ")
            continue
        closing, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k][0] in BLOCK or name == "p" and stack[k][0] in BLOCK:
                    break
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            ends, stops = ENDS.get(name, ("", ()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ends.split():
                    del stack[k:]
                    break
        elif name == "a":
            stack = [t for t in stack if t[0] != "a"]
        if name not in VOID:
            stack.append((name, words_of(attributes) if attributes.strip() else ()))
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        f = ["bias", f"tag={b.tag}", f"size={min(size.bit_length(), 10)}", f"linked={min(4 * b.linked // max(size, 1), 4)}",
             f"commas={min(b.text.count(','), 3)}", f"end={b.text[-1] if not b.text[-1].isalnum() else 'w'}", f"words={min(b.text.count(' ') // 3, 4)}"]
        if "©" in b.text or "|" in b.text:
            f.append("sign")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        seen = set()
        for tag, words in b.path:
            if tag in BLOCK:
                seen.add(f"in={tag}")
            seen.update(f"word={w}" for w in words)
        out.append(f + sorted(seen))
    return out


def marked_main(b: Block) -> bool:
    """What the markup of a labelled page says of a block."""
    inside = False
    for tag, words in b.path:
        if tag in OTHER_TAGS or "hidden" in words or any(w in OTHER_WORDS for w in words):
            return False
        inside = inside or tag in ("article", "main") or any(w in MAIN_WORDS for w in words)
    return inside and b.tag not in ("button", "label", "option", "select", "textarea", "legend")


@dataclass
class Layouts:
    """Pages with known labels in random layouts, filled with the texts of given pages."""

    rng: random.Random
    pool: list[str] = field(default_factory=lambda: ["The quick reader saw a page, and then another one."])

    def line(self, most: int) -> str:
        words = self.rng.choice(self.pool).split()
        at = self.rng.randrange(len(words))
        return html.escape(" ".join(words[at : at + self.rng.randint(1, most)]))

    def wrap(self, inner: str, tags: list[str], words: list[str], plain: float) -> str:
        if self.rng.random() < plain:
            tag = self.rng.choice(tags)
            return f"<{tag}>{inner}</{tag}>"
        tag = self.rng.choice(["div", "div", "section", *tags])
        name = self.rng.choice(["class", "class", "id"])
        return f'<{tag} {name}="{self.rng.choice(words)}">{inner}</{tag}>'

    def links(self) -> str:
        items = [f'<a href="/x">{self.line(4)}</a>' for _ in range(self.rng.randint(2, 7))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if self.rng.random() < 0.7 else " ".join(items)

    def other(self) -> str:
        kind = self.rng.randrange(7)
        if kind == 0:
            return self.wrap(self.links(), ["nav"], ["menu", "nav", "navbar", "navigation", "breadcrumb", "toolbar"], 0.5)
        if kind == 1:
            return self.wrap(f"<p>{self.line(25)}</p>" * self.rng.randint(1, 3), ["aside"], ["sidebar", "related", "recommended", "widget"], 0.4)
        if kind == 2:
            return self.wrap(self.line(20), ["div"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"], 0)
        if kind == 3:
            return self.wrap(f"<p>{self.line(20)}</p>", ["div"], ["cookie", "consent", "notice", "alert", "popup"], 0)
        if kind == 4:
            return f"<form><label>{self.line(4)}</label><input><button>{self.line(2)}</button></form>" if self.rng.random() < 0.6 else self.wrap(
                f"<p>{self.line(12)}</p><button>{self.line(2)}</button>", ["form"], ["subscribe", "newsletter", "login", "search", "form"], 0.3)
        if kind == 5:
            inner = "".join(f"<div class=\"{self.rng.choice(['comment', 'replies'])}\"><p>{self.line(40)}</p></div>" for _ in range(self.rng.randint(1, 4)))
            return self.wrap(f"<h3>{self.line(3)}</h3>" + inner, ["section"], ["comments", "discussion", "replies"], 0)
        return self.wrap(self.line(6), ["div"], ["share", "social", "pagination"], 0)

    def page(self, main: list[str]) -> tuple[str, list[str]]:
        """A page and its main blocks."""
        rng = self.rng
        inner = []
        for k, text in enumerate(main):
            tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote"])
            inner.append(f"<{tag}>{html.escape(text)}</{tag}>")
            if rng.random() < 0.08:
                inner.append(self.other())
        body = self.wrap("".join(inner), ["article", "main"], MAIN_WORDS, 0.5)
        if rng.random() < 0.1:
            body = "<div>" + "".join(inner) + "</div>"
        before = [self.other() for _ in range(rng.randint(0, 3))] + [self.wrap(self.line(6), ["header"], ["header", "masthead"], 0.6)] * rng.randint(0, 1)
        after = [self.other() for _ in range(rng.randint(0, 3))] + [self.wrap("&copy; " + self.line(12), ["footer"], ["footer", "copyright"], 0.6)] * rng.randint(0, 1)
        return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>", main


class Field:
    """The trained model: feature numbers, weights (features by two labels), neighbour weights."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]], o: ExtractOptions):
        seen: dict[str, int] = {}
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    seen[x] = seen.get(x, 0) + 1
        self.number = {x: i + 1 for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}  # 0: unknown
        self.weights, self.pair = np.zeros((len(self.number) + 1, 2)), np.zeros((2, 2))
        self.train(pages, o)

    def numbers(self, f: list[str]) -> list[int]:
        return [self.number[x] for x in f if x in self.number]

    def train(self, pages, o: ExtractOptions) -> None:
        pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
        if not pages:
            return
        length, width = len(pages[0][0]), max(len(f) for fs, _ in pages for f in fs)
        x = np.zeros((length, len(pages), width), np.int32)
        y, mask = np.zeros((length, len(pages)), np.int64), np.zeros((length, len(pages)), bool)
        for k, (fs, labels) in enumerate(pages):
            y[: len(fs), k], mask[: len(fs), k] = labels, True
            for t, f in enumerate(fs):
                numbers = self.numbers(f)
                x[t, k, : len(numbers)] = numbers
        flat, at = x[mask], np.nonzero(mask)
        gold = np.eye(2)[y] * mask[..., None]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.pair)]
        for step in range(1, o.steps + 1):
            score = np.zeros((length, len(pages), 2))
            score[at] = self.weights[flat].sum(axis=1)
            node, edge = marginals(score, self.pair, mask)
            error = (node - gold)[at]
            g = np.zeros_like(self.weights)
            for label in range(2):
                g[:, label] = np.bincount(flat.ravel(), np.repeat(error[:, label], width), minlength=len(g))
            g[0] = 0
            h = edge - np.einsum("tka,tkb->ab", gold[:-1], gold[1:])
            for p, d, m in ((self.weights, g + o.ridge * self.weights, moments[0]), (self.pair, h + o.ridge * self.pair, moments[1])):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                p -= o.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Viterbi; ties go to the label 0 (other)."""
        back, (a, b) = [], (0.0, 0.0)
        (aa, ab), (ba, bb) = self.pair.tolist()
        for t, f in enumerate(fs):
            w = self.weights[self.numbers(f)].sum(axis=0)
            if t:
                back.append((int(b + ba > a + aa), int(b + bb > a + ab)))
                a, b = max(a + aa, b + ba), max(a + ab, b + bb)
            a, b = a + w[0], b + w[1]
        out = [int(b > a)] if fs else []
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def marginals(score: np.ndarray, pair: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every block and the sum of those of neighbours (forward and backward)."""
    n = len(score)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[0] = score[0]
    for t in range(1, n):
        forward[t] = score[t] + np.logaddexp(forward[t - 1][:, :1] + pair[0], forward[t - 1][:, 1:] + pair[1])
    for t in range(n - 2, -1, -1):
        ahead = score[t + 1] + backward[t + 1]
        step = np.logaddexp(ahead[:, :1] + pair[:, 0], ahead[:, 1:] + pair[:, 1])
        backward[t] = np.where(mask[t + 1][:, None], step, 0.0)
    both = forward + backward
    total = np.logaddexp(both[..., 0], both[..., 1])
    node = np.exp(both - total[..., None]) * mask[..., None]
    edge = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            p = forward[:-1, :, a] + pair[a, b] + score[1:, :, b] + backward[1:, :, b] - total[1:]
            edge[a, b] = np.exp(np.minimum(p, 0))[mask[1:]].sum()
    return node, edge


def train(pages: list[str], o: ExtractOptions) -> Field:
    labelled, layouts = [], Layouts(random.Random(o.seed))
    mains = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [int(marked_main(b)) for b in blocks]
        if any(labels):
            labelled += [(features(blocks), labels)] * 2  # as many as the layouts made of it
            mains.append([b.text for b, y in zip(blocks, labels) if y])
    layouts.pool += [t for main in mains for t in main]
    for main in mains or [layouts.pool * 3]:
        for _ in range(o.variants if mains else 200):
            page, texts = layouts.page(layouts.rng.sample(main, min(len(main), layouts.rng.randint(1, 12))))
            blocks, left = leaf_blocks(page), [" ".join(t.split()) for t in texts]
            labels = []
            for b in blocks:  # main blocks come in order
                labels.append(int(bool(left) and b.text == left[0]))
                left = left[1:] if labels[-1] else left
            labelled.append((features(blocks), labels))
    return Field(labelled, o)


def extract_text(pages: DataFrame, options: ExtractOptions | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks (blocks read)."""
    o = options or ExtractOptions()
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = pages.filter("html is not null and page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(o.train_pages)
    chosen = pages.join(F.broadcast(sample.distinct()), "page_id").orderBy("page_id").limit(o.train_pages).select("html").collect()
    field = train([r[0] for r in chosen], o)

    def run(frames):
        for frame in chunks(frames, 200):
            texts, counts = [], []
            for page in frame["html"]:
                blocks = leaf_blocks(page if isinstance(page, str) else None)
                texts.append("\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks))) if y))
                counts.append(len(blocks))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": counts})

    # Ids go as text: pandas would make floats of numbers with nulls among them.
    out = pages.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, "page_id string, url string, text string, n_chars long, n_blocks long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
