"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of blocks. A bidirectional LSTM, in numpy, reads for each block a
vector of its tag path (hashed tags, names and their letter trigrams) and of its words (hashed),
and says for each whether it belongs to the article, with the whole page as context. It is
trained here on pages that a seeded generator makes in many layouts, with known labels; the
words of articles are invented, so that it learns from layout rather than language.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollbook.llm.html_blocks import PATH_CELLS, Block, Path, blocks, path_cell
from rollbook.llm.words import text_bytes, word_hashes, word_spans

WORD_CELLS, PLAIN = 256, 4
INPUTS = PATH_CELLS + WORD_CELLS + PLAIN
HIDDEN = 24
TRAINING_PAGES = 1200
EPOCHS = 12
#: Share of a weight that a step of training takes off.
DECAY = 3e-4
#: Blocks whose vectors are in memory together.
BATCH_BLOCKS = 4096

EXTRACTED = "page_id long, url string, text string, n_chars long"


@lru_cache(50_000)
def path_vector(path: Path) -> np.ndarray:
    """Hashed tags, names and name trigrams of a path; the two innermost tags count apart."""
    cells = path.cells
    for depth, tag in enumerate((path.tag, path.outer_tag)):
        if tag is not None:
            cells |= 1 << path_cell(f"<{tag}>{depth}")
    bits = np.frombuffer(cells.to_bytes(PATH_CELLS // 8, "little"), np.uint8)
    return np.unpackbits(bits, bitorder="little").astype(np.float32)


def vectors(sequence: list[Block]) -> np.ndarray:
    """One row for each block: path, words (roots of counts in ten or more), length, links, marks, digits."""
    data, offsets = text_bytes(pa.array([b.text for b in sequence], pa.string()))
    starts, ends, first = word_spans(data, offsets)
    cells = (word_hashes(data, starts, ends) >> np.uint64(56)).astype(np.int64)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(sequence)), counts)
    words = np.bincount(rows * WORD_CELLS + cells, minlength=len(sequence) * WORD_CELLS)
    words = np.sqrt(words.reshape(-1, WORD_CELLS) / np.maximum(10, counts)[:, None])
    marks = np.concatenate(([0], np.cumsum((data == 46) | (data == 44))))
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    size = np.maximum(1, np.diff(offsets))
    plain = np.stack(
        [
            np.log1p(counts) / 4,
            [b.linked for b in sequence],
            np.diff(marks[offsets]) / np.maximum(1, counts),
            np.diff(digits[offsets]) / size,
        ],
        axis=1,
    )
    paths = np.stack([path_vector(b.path) for b in sequence])
    return np.hstack([paths, words, plain]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Direction:
    """One LSTM; the gates are input, forget, output and candidate."""

    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray

    @classmethod
    def drawn(cls, draw: np.random.Generator) -> Direction:
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        return cls(
            draw.normal(0, 0.1, (INPUTS, 4 * HIDDEN)).astype(np.float32),
            draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32),
            bias,
        )

    def run(
        self, x: np.ndarray, mask: np.ndarray, keep: bool = False, start: tuple | None = None
    ) -> tuple:
        """States for steps x pages x inputs; ``mask`` holds the state where a page has no block.

        What the gates saw is returned beside them if it is to be kept, and the last state, from
        which another run may start.
        """
        steps, pages, _ = x.shape
        z = (x.reshape(-1, INPUTS) @ self.inputs + self.bias).reshape(steps, pages, -1)
        h, c = start or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            gates = z[t] + h @ self.recurrent
            i, f, o = np.split(_sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(gates[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new_c = f * c + i * g
            tanh = np.tanh(new_c)
            if keep:
                kept.append((h, c, i, f, o, g, tanh, on))
            c = np.where(on, new_c, c)
            h = np.where(on, o * tanh, h)
            out[t] = h
        return out, kept, (h, c)

    def slopes(self, x: np.ndarray, kept: list, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of the three parameters, given that of each state."""
        steps, pages, _ = x.shape
        d_z = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        d_r = np.zeros_like(self.recurrent)
        d_h = d_c = np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh, on = kept[t]
            d_h = d_h + slope[t]
            d_new = np.where(on, d_c + d_h * o * (1 - tanh**2), 0)
            d_o = np.where(on, d_h * tanh, 0)
            gates = (d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_o * o * (1 - o))
            d_z[t] = np.hstack([*gates, d_new * i * (1 - g**2)])
            d_r += h.T @ d_z[t]
            d_h = np.where(on, 0, d_h) + d_z[t] @ self.recurrent.T
            d_c = np.where(on, d_new * f, d_c)
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, INPUTS).T @ flat, d_r, flat.sum(0)]


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, its padding left behind."""
    out = x.copy()
    for page, size in enumerate(sizes):
        out[:size, page] = x[:size, page][::-1]
    return out


@dataclass
class Labeller:
    forward: Direction
    backward: Direction
    weights: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        both = (self.forward, self.backward)
        return [p for d in both for p in (d.inputs, d.recurrent, d.bias)] + [self.weights, self.bias]

    def states(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple:
        mask = np.arange(len(x))[:, None] < sizes
        turned = _turned(x, sizes)
        ahead, kept, _ = self.forward.run(x, mask, keep)
        back, kept_back, _ = self.backward.run(turned, mask, keep)
        return np.dstack([ahead, _turned(back, sizes)]), (turned, kept, kept_back, mask)

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the chance of each block to be of the article."""
        sizes = np.array([len(p) for p in pages])
        x = _padded(pages)
        states, _ = self.states(x, sizes)
        out = _sigmoid(states @ self.weights + self.bias)
        return [out[:size, page] for page, size in enumerate(sizes)]

    def long_chances(self, sequence: list[Block]) -> np.ndarray:
        """``chances`` of one page, made in steps of ``BATCH_BLOCKS`` blocks."""
        begins = range(0, len(sequence), BATCH_BLOCKS)
        back = np.empty((len(sequence), HIDDEN), np.float32)
        out = np.empty(len(sequence), np.float32)
        state = None
        for begin in reversed(begins):
            part = slice(begin, begin + BATCH_BLOCKS)
            x = vectors(sequence[part])[::-1, None]
            states, _, state = self.backward.run(x, np.ones((len(x), 1), bool), start=state)
            back[part] = states[::-1, 0]
        state = None
        for begin in begins:
            part = slice(begin, begin + BATCH_BLOCKS)
            x = vectors(sequence[part])[:, None]
            states, _, state = self.forward.run(x, np.ones((len(x), 1), bool), start=state)
            both = np.hstack([states[:, 0], back[part]])
            out[part] = _sigmoid(both @ self.weights + self.bias)
        return out

    def slopes(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pages])
        x = _padded(pages)
        states, (turned, kept, kept_back, mask) = self.states(x, sizes, keep=True)
        wanted = _padded([y[:, None] for y in labels])[:, :, 0]
        error = np.where(mask, _sigmoid(states @ self.weights + self.bias) - wanted, 0)
        error = (error / sizes.sum()).astype(np.float32)
        down = error[:, :, None] * self.weights
        ahead = self.forward.slopes(x, kept, down[:, :, :HIDDEN])
        back = self.backward.slopes(turned, kept_back, _turned(down[:, :, HIDDEN:], sizes))
        last = (states * error[:, :, None]).sum((0, 1))
        return [*ahead, *back, last, np.array([error.sum()], np.float32)]


def _padded(pages: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    for k, page in enumerate(pages):
        out[: len(page), k] = page
    return out


#: Words of menus, notices and the like, and names of elements, for the generated pages.
_CHROME = (
    "home about contact login sign up subscribe newsletter privacy policy terms cookies accept "
    "advertisement sponsored share follow us search menu copyright rights reserved related more "
    "read next previous reply comment posted by buy now offer email password submit tags archive "
    "help careers press language settings close agree"
).split()
_NAMES_OF = {
    "menu": "nav menu navbar topbar navigation breadcrumb breadcrumbs pagination pager toc links",
    "header": "header masthead banner top logo branding site",
    "footer": "footer bottom copyright colophon legal site",
    "side": "sidebar side aside widget related recommended popular trending archive tags rail",
    "notice": "cookie consent notice gdpr alert popup modal banner overlay warning message",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense teaser",
    "form": "form search login subscribe newsletter signup register contact poll",
    "comments": "comment comments reply replies discussion respond reader feedback thread user",
    "share": "share social follow buttons tools author meta",
}
_CONTENT_NAMES = "content article post entry story body text main page single blog news".split()


class PageMaker:
    """Makes pages and the texts of their articles' blocks, from a seed."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def word(self) -> str:
        letters = "etaoinshrdlcumwfgypbvkäöüéèñíó"
        word = "".join(self.draw.choice(letters) for _ in range(self.draw.randint(1, 9)))
        return word + self.draw.choice(["", "", "", "", ",", ".", "###", "!!", "%%%"])

    def words(self, low: int, high: int, chrome: float = 0.0) -> str:
        size = self.draw.randint(low, high)
        pick = (self.draw.choice(_CHROME) if self.draw.random() < chrome else self.word() for _ in range(size))
        return " ".join(pick).capitalize()

    def named(self, kind: str) -> str:
        names = _NAMES_OF[kind].split()
        name = "-".join(self.draw.sample(names, self.draw.choice([1, 1, 1, 2])))
        if self.draw.random() < 0.3:
            name = self.draw.choice(["site", "main", "top", "left", "box", "page", "c", "js"]) + "-" + name
        return f'{self.draw.choice(["class", "class", "id"])}="{name}"'

    def links(self) -> str:
        make = lambda: f'<a href="/x">{self.words(1, 3, self.draw.choice([0, 0.5, 1]))}</a>'
        items = [make() for _ in range(self.draw.randint(2, 8))]
        if self.draw.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def chrome(self, kind: str) -> str:
        draw, prose = self.draw, self.draw.choice([0.0, 0.2, 0.7])
        inner = {
            "menu": self.links,
            "share": self.links,
            "form": lambda: f"<label>{self.words(1, 4, 0.6)}</label><input name=q><button>{self.words(1, 2, 0.9)}</button>"
            + draw.choice(["", f"<p>{self.words(3, 12, prose)}</p>"]),
        }
        paragraphs = lambda: "".join(
            draw.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<p>{}</p>", "<h3>{}</h3><p>" + self.words(3, 25, prose) + "</p>"]).format(
                self.words(2, 40, prose)
            )
            for _ in range(draw.randint(1, 4))
        )
        body = inner.get(kind, lambda: paragraphs() + draw.choice(["", "", self.links()]))()
        if kind == "header":
            body = draw.choice(["<h1>{}</h1>", "<p>{}</p>", "{}"]).format(self.words(1, 6, 0.3)) + draw.choice(["", body])
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and draw.random() < 0.6:
            return f"<{tag}{draw.choice(['', '', ' ' + self.named(kind)])}>{body}</{tag}>"
        box = draw.choice(["div", "div", "section", "aside" if kind in ("advert", "side") else "div", "p" if kind == "advert" and "<" not in body else "div"])
        return f"<{box} {self.named(kind)}>{body}</{box}>"

    def article(self) -> str:
        """Markup whose shown blocks are all article text, marked by a leading sign."""
        draw, out = self.draw, []
        mark = lambda low, high: "␂" + self.words(low, high, draw.choice([0, 0, 0.1, 0.3]))
        if draw.random() < 0.9:
            title = f"<h1>{mark(1, 12)}</h1>"
            out.append(f"<header>{title}</header>" if draw.random() < 0.15 else title)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            kind = draw.random()
            if kind < 0.62:
                bold = draw.choice(["{}", "{}", "{}", "<b>{}", "<b>{}<br>", "<i>{}</i>", "<a href=x>{}</a>"])
                size = draw.choice([(1, 2), (1, 6), (1, 70), (10, 70)])
                out.append("<p>" + bold.format(mark(*size)) + draw.choice(["</p>", "</p>", ""]))
            elif kind < 0.7:
                out.append(f"<h2>{mark(1, 8)}</h2>")
            elif kind < 0.8:
                items = "".join(f"<li>{mark(1, 20)}</li>" for _ in range(draw.randint(1, 5)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{mark(4, 40)}</p></blockquote>")
            elif kind < 0.9:
                cells = "".join(f"<td>{mark(1, 4)}</td>" for _ in range(draw.randint(1, 4)))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x><figcaption>{mark(2, 12)}</figcaption></figure>")
            else:
                out.append(f"<pre>{mark(3, 30)}</pre>")
            if draw.random() < 0.08:
                out.append(self.chrome(draw.choice(["advert", "side", "share", "form", "notice"])))
        if draw.random() < 0.12:
            out.append(self.chrome(draw.choice(["comments", "share", "side", "footer"])))
        body = "".join(out) or f"<p>{mark(1, 30)}</p>"
        if draw.random() < 0.3:
            body = f'<div class="{draw.choice(_CONTENT_NAMES)}-{draw.choice(_CONTENT_NAMES)}">{body}</div>'
        kind = draw.random()
        if kind < 0.55:
            return f"<article>{body}</article>"
        if kind < 0.7:
            return f"<main>{body}</main>"
        if kind < 0.92:
            return f'<div {draw.choice(["class", "id"])}="{draw.choice(_CONTENT_NAMES)}">{body}</div>'
        return f"<section>{body}</section>" if kind < 0.96 else f"<div>{body}</div>"

    def page(self) -> str:
        draw, kinds = self.draw, ["menu", "header", "notice", "advert", "share", "form"]
        before = [self.chrome(draw.choice(kinds)) for _ in range(draw.randint(0, 4))]
        kinds = ["footer", "side", "comments", "advert", "form", "menu", "share", "notice"]
        after = [self.chrome(draw.choice(kinds)) for _ in range(draw.randint(0, 4))]
        article = self.article()
        if draw.random() < 0.15:
            article = f'<div class="{draw.choice(["wrapper", "container", "row", "layout"])}">{article}{self.chrome("side")}</div>'
        return "<body>" + "".join([*before, article, *after]) + "</body>"


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 3) -> Labeller:
    """The labeller, trained on generated pages (Adam, 32 pages at a time); once for each process."""
    maker, draw = PageMaker(seed), np.random.default_rng(seed)
    examples = []
    for _ in range(pages):
        sequence = blocks(maker.page())
        labels = np.array([b.text.startswith("␂") for b in sequence], np.float32)
        sequence = [Block(b.text.lstrip("␂"), b.path, b.linked) for b in sequence]
        if sequence:
            examples.append((vectors(sequence), labels))
    examples.sort(key=lambda e: len(e[1]))
    batches = [examples[k : k + 32] for k in range(0, len(examples), 32)]
    one, two = Direction.drawn(draw), Direction.drawn(draw)
    weights = draw.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
    out = Labeller(one, two, weights, np.zeros(1, np.float32))
    first = [np.zeros_like(p) for p in out.parameters()]
    second = [np.zeros_like(p) for p in out.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in draw.permutation(len(batches)):
            step += 1
            slopes = out.slopes(*map(list, zip(*batches[k], strict=True)))
            for p, s, a, b in zip(out.parameters(), slopes, first, second, strict=True):
                a += 0.1 * (s - a)
                b += 0.01 * (s * s - b)
                scale = np.sqrt(b / (1 - 0.99**step)) + 1e-8
                move = rate * a / (1 - 0.9**step) / scale
                p -= (move + DECAY * p * (p.ndim > 1)).astype(np.float32)
    return out


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page, its blocks joined by two line feeds; empty if there is none."""
    parsed: dict[int, list[Block]] = {}
    out = [""] * len(pages)

    def choose(k: int, sequence: list[Block], chance: np.ndarray) -> None:
        out[k] = "\n\n".join(b.text for b, c in zip(sequence, chance, strict=True) if c >= 0.5)

    for k, page in enumerate(pages):
        sequence = blocks(page or "")
        if len(sequence) > BATCH_BLOCKS:
            choose(k, sequence, model.long_chances(sequence))
        elif sequence:
            parsed[k] = sequence
    order = sorted(parsed, key=lambda k: len(parsed[k]))
    while order:
        longest = len(parsed[order[-1]])
        part = order[-(BATCH_BLOCKS // longest) :]
        del order[-len(part) :]
        chances = model.chances([vectors(parsed[k]) for k in part])
        for k, chance in zip(part, chances, strict=True):
            choose(k, parsed[k], chance)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are not read. A null or empty
    page, or one without an article, has an empty text. Repeated rows are extracted each; an
    empty table gives no rows. The driver trains the labeller and sends it to the tasks.
    """
    model = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(read, EXTRACTED)
