"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between tags that break lines. Each block is described by its
tag path (hashed tags, class and id words, and parent-child pairs), by hashed words, and by a few measures (length,
share of link text, place). A bidirectional LSTM, written in numpy, reads the whole sequence, so each block is labelled in
the context of the document; the blocks labelled as main text are joined.

It is trained here, on a bounded sample of the pages themselves: blocks inside article or main and inside nothing that
is navigation, header, footer, aside, advert, form, notice or comment are the positives. To learn these as well where the sample has none,
such blocks with texts of other pages are put into copies of the sample, and tag paths are hidden at random so
that words and neighbours count.

Null and empty html give an empty text. Script, style, head, comments and hidden form content are never text. Blocks of any
number and length are read. Equal html gives equal text. Without a trainable page the rule that labels the sample decides.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import slices

PATHS, TERMS, MEASURES = 96, 48, 6
HIDDEN = 16
#: pages that training reads (an expected number, drawn by a hash of the id)
SAMPLE = 300
EPOCHS = 8
#: blocks of a training copy that are read at once
LONGEST = 400
#: fixed lists of the markup language
SKIPPED = {"script", "style", "head", "title", "noscript", "template", "textarea", "select", "option", "svg", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "footer", "header", "aside", "table", "form", "pre", "blockquote", "figure", "main", "hr", "dl", "address", "details", "fieldset"}
#: what may stand in a head; any other tag ends a head whose end tag is left out
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "share", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "widget",
}
_WORDS = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """Collects (path, text, characters in links) of each leaf block; a path entry is (tag, class and id words)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[tuple[tuple, str, int]] = []
        self.parts: list[str] = []
        self.path: tuple = ()
        self.linked = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.path, text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag not in IN_HEAD and "head" in (t for t, _ in self.stack) and self.stack[-1][0] not in IN_HEAD:
            self.close_to("head")
        if tag in CLOSES_P and any(t == "p" for t, _ in self.stack):
            self.close_to("p")
        if tag == "li" and any(t == "li" for t, _ in self.stack):
            last = next(t for t, _ in reversed(self.stack) if t in ("li", "ul", "ol"))
            if last == "li":
                self.close_to("li")
        if tag in VOID:
            return
        words = tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORDS.findall(v.lower()))
        self.stack.append((tag, words))
        self.hidden += tag in SKIPPED

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def close_to(self, tag: str) -> None:
        while self.stack:
            t, _ = self.stack.pop()
            self.hidden -= t in SKIPPED
            if t == tag:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if any(t == tag for t, _ in self.stack):
            self.close_to(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.parts or not self.path_open():
            self.path = tuple(x for x in self.stack if x[0] not in INLINE)
        self.parts.append(data)
        if any(t == "a" for t, _ in self.stack):
            self.linked += len(data.strip())

    def path_open(self) -> bool:
        return any(p.strip() for p in self.parts)


def blocks_of(html: str) -> list[tuple[tuple, str, int]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def by_rule(path: tuple) -> bool:
    """The label of a training block."""
    inside = any(t in ("article", "main") or set(w) & {"article", "main", "content"} for t, w in path)
    return inside and not any(t in ASIDE_TAGS or set(w) & ASIDE_WORDS for t, w in path)


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def described(blocks: list, hide: np.ndarray | None = None) -> np.ndarray:
    """One row of features per block."""
    n = len(blocks)
    x = np.zeros((n, PATHS + TERMS + MEASURES), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        if hide is None or not hide[i]:
            above = ""
            for tag, words in path:
                x[i, bucket(tag, PATHS)] = 1
                x[i, bucket(above + ">" + tag, PATHS)] = 1
                for w in words:
                    x[i, bucket("." + w, PATHS)] = 1
                above = tag
        words = text.lower().split()
        for w in words:
            x[i, PATHS + bucket(w, TERMS)] += 1
        m = PATHS + TERMS
        x[i, PATHS:m] = np.sqrt(x[i, PATHS:m] / len(words))
        x[i, m:] = (np.log1p(len(text)) / 8, linked / len(text), np.log1p(len(words)) / 6, i / n, (n - i) / n, sum(c in ".,;:!?" for c in text) / len(text) * 10)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fresh(rng: np.random.Generator) -> dict:
    width = PATHS + TERMS + MEASURES
    model = {"out": rng.normal(0, 0.1, 2 * HIDDEN), "bias": np.zeros(1)}
    for side in "fb":
        model["x" + side] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
        model["h" + side] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        model["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # the forget gate starts open
    return {k: v.astype(np.float32) for k, v in model.items()}


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, c0: np.ndarray) -> tuple[np.ndarray, list]:
    """Outputs (batch, time, hidden) from left to right, and what the backward pass needs. Masked steps keep the state."""
    b, t, _ = x.shape
    z = x @ w + c0
    h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    out, tape = np.zeros((b, t, HIDDEN), np.float32), []
    for k in range(t):
        g = z[:, k] + h @ u
        i, f, o = (sigmoid(g[:, s * HIDDEN : (s + 1) * HIDDEN]) for s in range(3))
        a = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[:, k : k + 1]
        c1 = m * (f * c + i * a) + (1 - m) * c
        tc = np.tanh(c1)
        h1 = m * (o * tc) + (1 - m) * h
        tape.append((h, c, i, f, o, a, tc, m))
        h, c = h1, c1
        out[:, k] = h
    return out, tape


def lstm_back(x: np.ndarray, tape: list, u: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, t, _ = x.shape
    dz = np.zeros((b, t, 4 * HIDDEN), np.float32)
    du, dh, dc = np.zeros_like(u), np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    for k in reversed(range(t)):
        h, c, i, f, o, a, tc, m = tape[k]
        dh = dh + d_out[:, k]
        own = dh * m
        dc1 = dc + own * o * (1 - tc * tc)
        live = dc1 * m
        g = np.concatenate([live * a * i * (1 - i), live * c * f * (1 - f), own * tc * o * (1 - o), live * i * (1 - a * a)], 1)
        dz[:, k] = g
        du += h.T @ g
        dh = dh * (1 - m) + g @ u.T
        dc = live * f + dc1 * (1 - m)
    return x.reshape(b * t, -1).T @ dz.reshape(b * t, -1), du, dz.sum((0, 1))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


def forward(model: dict, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    hf, tf = lstm(x, mask, model["xf"], model["hf"], model["cf"])
    hb, tb = lstm(x[:, ::-1], mask[:, ::-1], model["xb"], model["hb"], model["cb"])
    h = np.concatenate([hf, hb[:, ::-1]], 2)
    return sigmoid(h @ model["out"] + model["bias"]), (h, tf, tb)


def step(model: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss."""
    p, (h, tf, tb) = forward(model, x, mask)
    d = ((p - y) * mask / mask.sum()).astype(np.float32)
    grads = {"out": np.einsum("bt,bth->h", d, h), "bias": np.array([d.sum()])}
    dh = d[..., None] * model["out"]
    for side, tape, seq, part in (("f", tf, x, dh[..., :HIDDEN]), ("b", tb, x[:, ::-1], dh[:, ::-1, HIDDEN:])):
        grads["x" + side], grads["h" + side], grads["c" + side] = lstm_back(seq, tape, model["h" + side], part)
    return grads


#: containers put into training copies: (path entry, how the blocks inside are wrapped)
PLANTED = [
    [("aside", ("sidebar",))], [("div", ("sidebar",)), ("ul", ()), ("li", ())], [("section", ("comments",)), ("div", ("comment",)), ("p", ())],
    [("div", ("comments",)), ("article", ("comment",)), ("p", ())], [("div", ("cookie", "notice"))], [("div", ("cookie", "banner")), ("p", ())], [("form", ())],
    [("form", ("newsletter",)), ("p", ())], [("header", ())], [("header", ("site", "header")), ("h1", ())], [("div", ("ad", "banner"))], [("div", ("advert",))],
    [("div", ("related", "links")), ("a", ())], [("div", ("share", "social"))], [("div", ("promo",)), ("p", ())], [("div", ("subscribe", "widget"))], [("div", ("notice",))],
    [("ol", ("comment", "list")), ("li", ("comment",)), ("div", ())],
]


def planted(blocks: list, others: list, rng: np.random.Generator) -> list:
    """The page with containers of boilerplate put in, outside and inside its article."""
    out = list(blocks)
    if rng.random() < 0.3:  # the article in a main element
        out = [(tuple(y for x in path for y in ([("main", ()), x] if x[0] == "article" else [x])), text, n) for path, text, n in out]
    for _ in range(int(rng.integers(1, 6))):
        at = int(rng.integers(0, len(out) + 1))
        around = out[min(at, len(out) - 1)][0] if out and rng.random() < 0.6 else (("html", ()), ("body", ()))
        around = tuple(x for x in around if x[0] != "p")
        path = around + tuple(PLANTED[int(rng.integers(len(PLANTED)))])
        for _ in range(int(rng.integers(1, 4))):
            text = others[int(rng.integers(len(others)))]
            out.insert(at, (path, text, len(text) if rng.random() < 0.2 else 0))
    return out


def window(blocks: list, rng: np.random.Generator) -> list:
    """A training copy's blocks; of one with more than LONGEST, a run that starts anywhere in it."""
    if len(blocks) <= LONGEST:
        return blocks
    at = int(rng.integers(0, len(blocks) - LONGEST + 1))
    return blocks[at : at + LONGEST]


def fit(pages: list[str], epochs: int = EPOCHS) -> dict | None:
    read = [b for b in map(blocks_of, pages) if b]
    others = [text for b in read for _, text, _ in b]
    if not read:
        return None
    rng = np.random.default_rng(11)
    model = fresh(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    n = 0
    for _ in range(epochs):
        made = [planted(b, others, rng) if rng.random() < 0.7 else b for b in read]
        made = [window(b, rng) for b in made]
        order = rng.permutation(len(made))
        for at in range(0, len(order), 16):
            some = [made[i] for i in order[at : at + 16]]
            hide = [rng.random(len(b)) < (0.15 if rng.random() < 0.5 else 0.0) for b in some]
            x, mask = padded([described(b, h) for b, h in zip(some, hide)])
            y = np.zeros(mask.shape, np.float32)
            for i, b in enumerate(some):
                y[i, : len(b)] = [by_rule(path) for path, _, _ in b]
            n += 1
            for k, g in step(model, x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model[k] = (model[k] - 0.02 * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return model


def main_texts(model: dict | None, pages: list[str]) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    read = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    for at in range(0, len(order), 64):
        some = order[at : at + 64]
        if model is None:
            p = [[float(by_rule(path)) for path, _, _ in read[i]] for i in some]
        else:
            p, _ = forward(model, *padded([described(read[i]) for i in some]))
        for i, row in zip(some, p):
            out[i] = "\n".join(text for (_, text, _), v in zip(read[i], row) if v >= 0.5)
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> dict | None:
    n = pages.where("html IS NOT NULL").count()
    if not n:
        return None
    limit = max(1, int(min(1.0, sample / n) * (1 << 20)))
    drawn = pages.where("html IS NOT NULL").where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < limit).select("page_id", "html").toPandas()
    return fit(drawn.sort_values("page_id", kind="stable")["html"].tolist())


def extracted(pages: DataFrame, model: dict | None) -> DataFrame:
    """(page_id, url, text) of every page."""

    def rows(batches):
        for batch in slices(batches, 250):
            texts = main_texts(model, [h or "" for h in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(rows, "page_id long, url string, text string")
