"""Main text of web pages: a recurrent network labels every block of a page.

A page is cut into blocks, the runs of text between block-level tags. Each block becomes a vector:
its tag path (tags, classes, ids and roles of the elements around it) and its words, both hashed, and a few ratios.
A bidirectional LSTM, written in numpy, reads the page's blocks in
order from both ends and labels each one with the whole page in view. Kept blocks are
joined by a line break.

The network is trained from at most ``TRAINING_PAGES`` pages, chosen by a hash of their
numbers, whose blocks the semantic tags label (inside ``article`` or ``main`` and not in a
navigation, footer, form ...). So that it learns more than these tags, each page is also
shown with its containers renamed, with foreign blocks mixed in, and with its classes taken away.

Null, empty and text-free pages give an empty text. Scripts, styles, comments and the
head are never text. Pages of any length are read whole; equal pages give equal texts.
With no page to learn from, the containers alone train the network.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import beside, hashed_sample, query, shared_value, table

TRAINING_PAGES = 240
LESSONS = 8  # changed copies of each page
TRAINING_BLOCKS = 40  # blocks of a page shown in training
EPOCHS, BATCH, RATE, SEED = 14, 48, 0.01, 7
PATH_SIZE, WORD_SIZE, HIDDEN = 160, 24, 20
RATIOS = 8

# Names of HTML elements by how they are read.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style head title noscript template svg math iframe object canvas audio video".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
              "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
BOILERPLATE_TAGS = set("nav header footer aside form button select textarea dialog menu fieldset".split())
# Containers the network is shown, as tag.class paths.
CONTENT = (
    "article; main; div.content; div.post; div.entry; div.article-body; section.story; div#content; div.main; "
    "div.text; div.body; section.article; div.post-content; div.page-content; div#main; main div.container; "
    "div.wrapper article; div#wrapper div.content; section; div.entry-content; div.story-text"
).split("; ")
BOILERPLATE = (
    "nav; nav ul li; header; header div; footer; footer div; footer p; aside; aside div; form; form label; form button; "
    "div.nav; div.menu; ul.menu li; div.navbar; div.navigation; div.breadcrumb; ul.breadcrumbs li; div.header; "
    "div#header; div.masthead; div.banner; div.topbar; div.footer; div#footer; div.copyright; div.legal; div.sidebar; "
    "div#sidebar; div.side; div.widget; div.related; div.recommended; div.popular; div.trending; div.notice; "
    "div.cookie; div.cookie-banner; div.consent; div.alert; div.gdpr; div.warning; div.message; div.ad; div.ads; "
    "div.advert; div.advertisement; div.sponsored; div.sponsor; div.promo; div.banner-ad; ins.adsbygoogle; "
    "div.comments; div.comment; section.comments; section#comments; ol.comment-list li; div#comments; div.replies; "
    "div.reply; ul.comments li; div.discussion; section.comments article.comment; div#comments article; article.comment; "
    "ol.comment-list article.comment-body; div.related article; aside article; section.related article.teaser; "
    "div.user-comments; div.reader-comments; section.reader-comments div.comment-text; div.share; div.social; div.newsletter; div.subscribe; div.signup; "
    "div.login; div.search; form.search; div.pagination; div.pager; div.tags; div.modal; div.popup; dialog; menu; "
    "div.toolbar; div.skip; div.disclaimer; button; select option; fieldset; div.hidden; div.feedback; div.rating"
).split("; ")

BOILERPLATE_MARKS = {
    "." + word for path in BOILERPLATE for name in re.findall(r"[.#]([\w-]+)", path) for word in name.split("-")
}

TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def marks_of(name: str, rest: str) -> tuple[str, ...]:
    """An element as path tokens: its tag, and the words of its class, id and role."""
    out = [name]
    if "=" in rest or "hidden" in rest:
        for key, value in ATTRIBUTE.findall(rest):
            key = key.lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.append(".hidden")
            elif key != "style":
                out += ["." + w.lower() for w in NAME_PART.findall(value)]
    return tuple(out)


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of text in page order, with the elements around them."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(tuple(m for _, marks in stack for m in marks), text, linked))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text)

    def leave(name: str, limits: tuple[str, ...] = ()) -> None:
        """Close the innermost open ``name``, unless one of ``limits`` lies inside it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                flush()
                del stack[i:]
                return
            if stack[i][0] in limits:
                return

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        found = TAG.match(page, begin)
        if found is None:  # a sign of its own, or a tag that never ends
            add(page[at : begin + 1])
            at = begin + 1
            continue
        add(page[at:begin])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if not found["close"] and name in UNREAD:
            if found["rest"].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if name == "head":  # may be left open: the body ends it, too
                body = re.compile(r"<body\b", re.I).search(page, at)
                if body and (end is None or body.start() < end.start()):
                    at = body.start()
                elif end:
                    at = end.end()
                continue
            at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if found["close"] else 1))
            continue
        if found["close"]:
            flush()
            leave(name)
            links = 0
            continue
        flush()
        if name in CLOSES_P:
            leave("p", ("td", "th", "li", "div", "article", "section", "body"))
        if name in SAME_LEVEL:
            leave(name, SAME_LEVEL[name])
        if name not in VOID:
            stack.append((name, marks_of(name, found["rest"])))
    flush()
    return out


def slot(kind: str, token: str, size: int) -> tuple[int, float]:
    code = zlib.crc32(f"{kind}{token}".encode("utf-8", "surrogatepass"))
    return code % size, 1.0 if code & 0x10000 else -1.0


def vectors(blocks: list[Block], known: dict[str, tuple[int, float]]) -> np.ndarray:
    """One row per block: hashed path, hashed words, ratios."""
    out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + RATIOS), np.float32)
    total = len(blocks)
    for i, block in enumerate(blocks):
        row = out[i]
        for token in set(block.path):
            key = "p" + token
            if key not in known:
                known[key] = slot("p", token, PATH_SIZE)
            at, sign = known[key]
            row[at] += sign
        words = block.text.split()
        # A word counts by its first letters, so that unseen words have something in common with seen ones.
        part = [0.0] * WORD_SIZE
        for word in words:
            key = "w" + word[:3]
            found = known.get(key)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[key] = slot("w", word[:3], WORD_SIZE)
            part[found[0]] += found[1]
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = part
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] /= max(1, len(words))
        size = len(block.text)
        row[-RATIOS:] = (
            np.log1p(len(words)) / 4,
            min(1.0, block.linked / size),
            sum(map(block.text.count, ".!?")) / max(1, len(words)),
            i / total,
            (total - i) / total,
            "©" in block.text or "|" in block.text,
            len(words) < 4,
            1.0,
        )
    return out


class Lstm:
    """Bidirectional LSTM with a logistic output on each block."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {}
        for side in "fb":
            scale = 1 / np.sqrt(size + hidden)
            self.weights[f"w{side}"] = random.normal(0, scale, (size, 4 * hidden)).astype(np.float32)
            self.weights[f"u{side}"] = random.normal(0, scale, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # keep, at first
            self.weights[f"c{side}"] = bias
        self.weights["out"] = random.normal(0, 0.3, 2 * hidden + size).astype(np.float32)
        self.weights["last"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states of x (steps, pages, size); masked steps pass the state on."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        c = np.zeros_like(h)
        inputs, u = x @ self.weights[f"w{side}"] + self.weights[f"c{side}"], self.weights[f"u{side}"]
        states = np.zeros((x.shape[0], x.shape[1], self.hidden), np.float32)
        steps = []
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            gates = inputs[t] + h @ u
            k = self.hidden
            gate = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * k], -30, 30)))
            new = np.tanh(gates[:, 3 * k :])
            m = mask[t][:, None]
            before = (h, c)
            c2 = gate[:, k : 2 * k] * c + gate[:, :k] * new
            tanh = np.tanh(c2)
            h = m * (gate[:, 2 * k :] * tanh) + (1 - m) * h
            c = m * c2 + (1 - m) * c
            states[t] = h
            if keep:
                steps.append((t, before, gate, new, tanh, m))
        return states, steps

    def chances(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, steps_f = self._run(x, mask, "f", keep)
        backward, steps_b = self._run(x, mask, "b", keep)
        both = np.concatenate([forward, backward, x], axis=2)
        logits = both @ self.weights["out"] + self.weights["last"][0]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30))), both, steps_f, steps_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over the blocks."""
        p, both, steps_f, steps_b = self.chances(x, mask, keep=True)
        error = ((p - y) * mask / max(1.0, float(mask.sum()))).astype(np.float32)
        grads = {"out": np.einsum("tp,tpk->k", error, both), "last": error.sum()[None]}
        k = self.hidden
        for side, steps, offset in (("f", steps_f, 0), ("b", steps_b, k)):
            u = self.weights[f"u{side}"]
            ahead = error[:, :, None] * self.weights["out"][offset : offset + k]
            dh, dc = np.zeros_like(steps[0][1][0]), np.zeros_like(steps[0][1][0])
            du = np.zeros_like(u)
            dgates = np.zeros((x.shape[0], x.shape[1], 4 * k), np.float32)
            for t, (h0, c0), gate, new, tanh, m in reversed(steps):
                dh = dh + ahead[t]
                own_h, own_c = dh * m, dc * m
                own_c = own_c + own_h * gate[:, 2 * k :] * (1 - tanh**2)
                d = np.concatenate(
                    [own_c * new, own_c * c0, own_h * tanh], axis=1
                ) * gate * (1 - gate)
                d = np.concatenate([d, own_c * gate[:, :k] * (1 - new**2)], axis=1)
                dgates[t] = d
                du += h0.T @ d
                dh = dh * (1 - m) + d @ u.T
                dc = dc * (1 - m) + own_c * gate[:, k : 2 * k]
            flat = dgates.reshape(-1, 4 * k)
            grads[f"u{side}"] = du
            grads[f"w{side}"] = x.reshape(-1, x.shape[2]).T @ flat
            grads[f"c{side}"] = flat.sum(0)
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> None:
        """Adam on batches of pages of similar length."""
        random = np.random.default_rng(SEED)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for b in random.permutation(len(batches)):
                x, mask, y = padded([pages[i] for i in batches[b]], [labels[i] for i in batches[b]])
                step += 1
                for key, g in self.gradients(x, mask, y).items():
                    first[key] += 0.1 * (g - first[key])
                    second[key] += 0.001 * (g * g - second[key])
                    down = first[key] / (1 - 0.9**step)
                    self.weights[key] -= (rate * down / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)).astype(
                        np.float32
                    )

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of similar length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            batch, size = [], 0
            while at < len(order) and (not batch or (len(batch) < 256 and len(pages[order[at]]) * (len(batch) + 1) <= 40_000)):
                batch.append(order[at])
                at += 1
            x, mask, _ = padded([pages[i] for i in batch])
            chance = self.chances(x, mask)[0]
            for j, i in enumerate(batch):
                out[i] = chance[: len(pages[i]), j] >= 0.5
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    """(steps, pages, size) with a mask of real steps and the labels."""
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    y = np.zeros((steps, len(pages)), np.float32)
    for i, page in enumerate(pages):
        x[: len(page), i] = page
        mask[: len(page), i] = 1
        if labels is not None:
            y[: len(page), i] = labels[i]
    return x, mask, y


def taught(block: Block) -> bool:
    """What the semantic tags say about a block."""
    path = set(block.path)
    return bool(path & {"article", "main"}) and not path & BOILERPLATE_TAGS and not path & BOILERPLATE_MARKS


def container(path: str) -> tuple[str, ...]:
    out: list[str] = []
    for element in path.split():
        parts = re.split(r"[.#]", element)
        out.append(parts[0])
        out += ["." + w for p in parts[1:] for w in p.split("-")]
    return tuple(out)


def lessons(pages: list[list[Block]], random: np.random.Generator) -> Iterator[tuple[list[Block], list[bool]]]:
    """Pages with their labels: as they are, with renamed containers and foreign blocks, with few names left."""
    words = [w for page in pages for b in page for w in b.text.split()[:20]] or ["text"]

    def some(least: int, most: int) -> str:
        picked = random.integers(0, len(words), int(random.integers(least, most)))
        return " ".join(words[i] for i in picked)

    def named(paths: tuple[str, ...]) -> tuple[str, ...]:
        return container(paths[random.integers(len(paths))])

    def chance(p: float) -> bool:
        return random.random() < p

    def foreign(path: tuple[str, ...]) -> list[Block]:
        out = []
        for _ in range(int(random.integers(1, 5))):
            linked = chance(0.3)
            text = some(1, 6) if linked else some(1, 45)
            kind = ("p", "div", "li", "h3", "span")[random.integers(5)]
            out.append(Block(path + ((kind,) if chance(0.6) else ()), text, len(text) if linked else 0))
        return out

    for number, page in enumerate(pages):
        page = page[:TRAINING_BLOCKS]
        told = [taught(b) for b in page]
        yield page, told
        for turn in range(LESSONS):
            bare = turn == 0 and number % 2 == 0
            root = (("html", "body"), ("body",), (), ("html", "body", "div", ".page"), ("html", "body", "div"))[random.integers(5)]
            holder = root + (named(CONTENT) if not bare else ("div",))
            stray = ("." + words[random.integers(len(words))].lower(),) if chance(0.3) else ()
            new: list[Block] = []
            labels: list[bool] = []
            rename: dict[tuple[str, ...], tuple[str, ...]] = {}
            least = int(random.integers(0, 4)) if chance(0.4) else 0
            brief = chance(0.4)
            for block, content in zip(page, told):
                if content:
                    if least and sum(labels) >= least:
                        continue
                    kind = next((p for p in reversed(block.path) if p[0] != "."), "p")
                    if kind not in ("p", "h1", "h2", "h3", "li", "blockquote") or chance(0.1):
                        kind = ("p", "h2", "li", "blockquote", "td", "pre")[random.integers(6)]
                    path = holder + stray + (kind,)
                else:
                    if block.path not in rename:
                        rename[block.path] = named(BOILERPLATE)
                    path = root + rename[block.path]
                    if bare:
                        path = root + (("div", "ul", "li") if block.linked else ("div",))
                text = " ".join(block.text.split()[: int(random.integers(1, 20))]) if brief and content else block.text
                new.append(Block(path, text, min(block.linked, len(text))))
                labels.append(content)
            if not bare:
                for _ in range(int(random.integers(2, 7))):
                    inside = holder if chance(0.35) else root
                    at = int(random.integers(0, len(new) + 1))
                    group = foreign(inside + named(BOILERPLATE))
                    new[at:at] = group
                    labels[at:at] = [False] * len(group)
            yield new, labels


def blurred(x: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A page in training: half of the time without its words, sometimes without its ratios."""
    if random.random() < 0.5:
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = 0
    if random.random() < 0.2:
        x[:, -RATIOS:-1] = 0
    return x


def train(pages: DataFrame, most: int = TRAINING_PAGES) -> Lstm:
    """Network from ``pages`` (page_id, html)."""
    shown = pages.where(F.col("html").isNotNull()).select("page_id", "html")
    # A bounded number of pages; about as many as asked for, whatever the hash does at most twice.
    sample = hashed_sample(shown, most, "page_id").limit(2 * most).collect()
    read = [blocks_of(r["html"]) for r in sorted(sample, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["html"]))]
    read = [b for b in read if b]
    if not read:
        texts = [f"Some words of a text, number {i}." for i in range(12)]
        read = [[Block(("html", "body", "article", "p"), t, 0) for t in texts]] * 8
    random = np.random.default_rng(SEED)
    known: dict[str, tuple[int, float]] = {}
    x, y = [], []
    for blocks, labels in lessons(read, random):
        x.append(blurred(vectors(blocks, known), random))
        y.append(np.array(labels, np.float32))
    net = Lstm(PATH_SIZE + WORD_SIZE + RATIOS)
    net.fit(x, y)
    return net


def extract(pages: DataFrame, net: Lstm) -> DataFrame:
    """Add ``text``, the main text, to ``pages``; only ``html`` is read."""
    shared = shared_value(pages.sparkSession, net)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, float]] = {}
        for column in columns:
            texts: list[str] = []
            values = column.tolist()
            for i in range(0, len(values), 500):
                read = [blocks_of(v) for v in values[i : i + 500]]
                labels = shared().label([vectors(b, known) for b in read])
                texts += ["\n".join(b.text for b, kept in zip(bs, ls) if kept) for bs, ls in zip(read, labels)]
            yield pd.Series(texts, dtype=object)

    text = F.pandas_udf(run, "string")(pages["html"])
    return beside(pages, F.struct(text.alias("text")), ["text"])


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extract(pages, train(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
