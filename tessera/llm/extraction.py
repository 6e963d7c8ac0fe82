"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf text blocks. Every block becomes a vector: learned embeddings of its tag path (tags, classes,
ids, roles, hashed) and of its words (hashed), and a few figures. A bidirectional LSTM in numpy reads the whole sequence
of blocks, so that each block is judged in the context of its page, and marks it as main text or not.

The network is trained on the driver on pages made by rule (templates of many kinds around made-up words, at most
PAGES of them), which takes seconds; it is a few hundred kilobytes and travels with the tasks. Scoring needs no shuffle; pages
of similar length go through the network together.
"""

from __future__ import annotations

import functools
import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048
PATH, WORD, FIGURES, HIDDEN = 24, 12, 10, 24
PAGES = 1300
EPOCHS = 9
#: steps whose inputs are multiplied at once
SPAN = 4096
#: words on fewer than this share of the training pages have no vector
COMMON = 0.03
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: where a tag may end, or a quoted value begins
_STOP = re.compile(r">|=\s*([\"'])")
#: a number that Python would not read, or read slowly
_DIGITS = re.compile(r"&#([0-9]{8,})")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z]+")
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark object q s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: their content is no text of the page
_RAW = frozenset("script style noscript template svg iframe canvas textarea title annotation annotation-xml".split())
#: those that stand inside a line of text
_NOTES = frozenset("annotation annotation-xml".split())
#: without an end these run to the end of the page, as in a browser; of the others only the tag is skipped then
_TO_THE_END = frozenset("script style textarea title".split())
#: an opening tag ends an open one of these
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Scanner:
    """The tags of a page, in one pass whose time is proportional to its length.

    A tag ends at the first ``>`` outside of the quoted values of its attributes. Where quotes are not paired (a tag would
    never end) quotes mean nothing from there on, and where no ``>`` follows the rest of the page is text."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, -1 if there is none."""
        j = at
        while self.quotes:
            found = _STOP.search(self.page, j)
            if found is None:
                self.quotes = False
            elif found[1] is None:
                return found.start()
            else:
                j = self.page.find(found[1], found.end()) + 1
                if not j:
                    self.quotes = False
        return self.page.find(">", at)

    def pieces(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes) of everything that is markup; comments and the like have no name. The
        end may be moved on by sending a place."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0:
                return
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
                name, closing, rest = "", False, ""
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start) + 1
                if not end:
                    return
                name, closing, rest = "", False, ""
            else:
                found = _NAME.match(page, start)
                if not found:
                    at = start + 1
                    continue
                close = self.end(found.end())
                if close < 0:
                    return
                end, name, closing, rest = close + 1, found[1].lower(), page[start + 1] == "/", page[found.end() : close]
            moved = yield start, end, name, closing, rest
            at = end if moved is None else moved


class _Path:
    """The open block tags of a page and the names on them. Of names that share a row of the labeller one is kept, so a
    path has at most ROWS names however deep it is."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.rows: dict[int, list] = {}
        self.made: tuple[str, ...] | None = None

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        self.stack.append((tag, own))
        for name in set(own):
            held = self.rows.setdefault(_row(name), [name, 0])
            held[1] += 1
        self.made = None

    def pop(self) -> str:
        tag, own = self.stack.pop()
        for name in set(own):
            held = self.rows[_row(name)]
            held[1] -= 1
            if not held[1]:
                del self.rows[_row(name)]
        self.made = None
        return tag

    def names(self) -> tuple[str, ...]:
        if self.made is None:
            last = {f"{depth}:{n}" for depth, (_, own) in enumerate(reversed(self.stack[-3:])) for n in own}
            self.made = tuple(sorted({held[0] for held in self.rows.values()} | last))
        return self.made


def _decoded(text: str) -> str:
    """Character references resolved; white space becomes one space."""
    if "&" in text:
        text = html.unescape(_DIGITS.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'}", text))
    return " ".join(text.split())


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, names of the tag path, characters inside links) of every leaf block in page order."""
    return list(scan(page))


def scan(page: str | None) -> Iterator[tuple[str, tuple[str, ...], int]]:
    """What ``blocks`` returns, one by one. References are decoded, white space becomes one space; blocks without text are
    left out. Time is proportional to the page's length."""
    if not page:
        return
    path, inline = _Path(), []
    open_tags: Counter = Counter()
    text: list[str] = []
    linked = 0
    endless: set[str] = set()

    def flush() -> list[tuple[str, tuple[str, ...], int]]:
        """The block that ends here, if it has text."""
        nonlocal linked
        whole = _decoded("".join(text))
        found = [(whole, path.names(), min(linked, len(whole)))] if whole else []
        text.clear()
        linked = 0
        return found

    def pop(tag: str) -> None:
        """Ends an open block, and what is open inside of it."""
        leave()
        while path.stack:
            name = path.pop()
            open_tags[name] -= 1
            if name == tag:
                return

    def leave() -> None:
        """Ends the open inline tags: none goes beyond its block."""
        while inline:
            open_tags[inline.pop()] -= 1

    def add(start: int, stop: int) -> None:
        nonlocal linked
        if start < stop:
            text.append(page[start:stop])
            if open_tags["a"]:
                linked += len(page[start:stop].strip())

    at, moved = 0, None
    pieces = _Scanner(page).pieces()
    while True:
        try:
            start, end, tag, closing, attributes = pieces.send(moved)
        except StopIteration:
            break
        add(at, start)
        at, moved = end, None
        if not tag:
            continue
        if closing:
            if tag in _INLINE:
                if open_tags[tag]:
                    while (name := inline.pop()) != tag:
                        open_tags[name] -= 1
                    open_tags[tag] -= 1
                continue
            yield from flush()
            if open_tags[tag]:
                pop(tag)
            continue
        if tag in _RAW and not attributes.rstrip().endswith("/"):
            if tag not in _NOTES:
                yield from flush()
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", close.end()) if close else -1
            if stop >= 0:
                at = moved = stop + 1
            elif tag in _TO_THE_END:
                at = len(page)
                break
            else:
                endless.add(tag)
            continue
        if tag == "head":
            # no part of any path: its own content is raw or void, and what else follows belongs to the body
            yield from flush()
            continue
        if tag == "br":
            text.append(" ")
        if tag in _VOID:
            if tag == "hr":
                yield from flush()
            continue
        if tag in _INLINE:
            inline.append(tag)
            open_tags[tag] += 1
            continue
        yield from flush()
        if open_tags["p"] and tag not in ("body", "html"):
            pop("p")
        for other in _ENDS.get(tag, ()):
            if open_tags[other] and any(x[0] == other for x in path.stack[-4:]):
                pop(other)
        # what an inline tag left open ends here
        leave()
        own = [tag]
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name in ("class", "id", "role"):
                own += [x for x in _PART.findall(value)] + [f"{name}={value}"]
            elif name == "hidden" or "true" in value or "none" in value:
                own.append("@hidden")
        path.push(tag, tuple(own))
        open_tags[tag] += 1
    add(at, len(page))
    yield from flush()


class _Rows(dict):
    """name or word -> its row; those that are not long are kept while there are not too many."""

    def __missing__(self, name: str) -> int:
        row = zlib.crc32(name.encode("utf-8", "surrogatepass")) % ROWS
        if len(name) <= 40:
            if len(self) >= 1 << 16:
                self.clear()
            self[name] = row
        return row


_row = _Rows().__getitem__


def _path_rows(names: tuple[str, ...]) -> tuple[int, ...]:
    return _short_path_rows(names) if len(names) <= 64 else tuple(_row(n) for n in names)


@functools.lru_cache(1 << 14)
def _short_path_rows(names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(_row(n) for n in names)


def _own_figures(text: str, tokens: list[str], linked: int) -> tuple:
    marks = sum(map(text.count, ".,;:!?"))
    return (1.0, math.log1p(len(text)) / 6, math.log1p(len(tokens)) / 5, linked / len(text), marks / max(1, len(tokens)), text[-1] in ".!?:\"»”")


def _placed(own: list[tuple], digits: list[float]) -> np.ndarray:
    """The figures of a page's blocks, with those that tell their place."""
    n = len(own)
    at = np.arange(n)
    rest = np.stack([at / max(1, n), (n - at) / max(1, n), np.full(n, np.log1p(n) / 5), digits], 1)
    return np.concatenate([np.array(own, np.float32).reshape(-1, FIGURES - 4), rest], 1).astype(np.float32)


def _digit_share(text: str) -> float:
    return sum(map(text.count, "0123456789")) / len(text) if text.isascii() else sum(map(str.isdigit, text)) / len(text)


def encode(found: list[tuple[str, tuple[str, ...], int]]) -> tuple[list[tuple[int, ...]], list[np.ndarray], np.ndarray]:
    """Rows of the path names, rows of the words and the figures of a page's blocks."""
    paths, words, own = [], [], []
    for text, names, linked in found:
        tokens = text.lower().split()
        paths.append(_path_rows(names))
        words.append(np.array(list(map(_row, tokens)), np.int64))
        own.append(_own_figures(text, tokens, linked))
    return paths, words, _placed(own, [_digit_share(text) for text, _, _ in found])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic output, with their gradients."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH + WORD + FIGURES
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": (rng.standard_normal((ROWS, PATH)) * 0.3).astype(np.float32), "word": (rng.standard_normal((ROWS, WORD)) * 0.1).astype(np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": draw(size, 4 * HIDDEN), f"{d}h": draw(HIDDEN, 4 * HIDDEN), f"{d}c": np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)].astype(np.float32)}
        self.known = np.ones(ROWS, bool)
        self.p |= {"out": draw(2 * HIDDEN + size, 1), "bias": np.zeros(1, np.float32)}

    def _path(self, rows: tuple[int, ...]) -> np.ndarray:
        return self.p["path"][list(rows)].sum(0) / len(rows) if rows else np.zeros(PATH, np.float32)

    def _words(self, rows: np.ndarray) -> np.ndarray:
        return self.p["word"][rows[self.known[rows]]].sum(0) / max(1, len(rows))

    def inputs(self, page) -> np.ndarray:
        paths, words, figures = page
        return np.concatenate([np.stack([self._path(r) for r in paths]), np.stack([self._words(w) for w in words]), figures], 1)

    def read(self, page: str | None, paths: dict | None = None) -> tuple[list[str], np.ndarray]:
        """The texts of a page's blocks and their inputs, without keeping names and words of more than one block. ``paths``
        keeps the vectors of paths that are not long from page to page."""
        texts, above, inside, own = [], [], [], []
        paths = {} if paths is None else paths
        for text, names, linked in scan(page):
            held = paths.get(names)
            if held is None:
                held = self._path(_path_rows(names))
                if len(paths) >= 4096:
                    paths.clear()
                if len(names) <= 64:
                    paths[names] = held
            tokens = text.lower().split()
            above.append(held)
            inside.append(self._words(np.array(list(map(_row, tokens)), np.int64)))
            own.append(_own_figures(text, tokens, linked))
            texts.append(text)
        if not texts:
            return [], np.zeros((0, PATH + WORD + FIGURES), np.float32)
        return texts, np.concatenate([np.stack(above), np.stack(inside), _placed(own, list(map(_digit_share, texts)))], 1)

    def _scan(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """x: time x pages x inputs. Hidden states of one direction; padding leaves the state as it is."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out = h.copy(), np.zeros((*x.shape[:2], HIDDEN), np.float32)
        low = high = 0
        for t in steps:
            if not low <= t < high:
                # what the inputs drive, some steps at a time
                low = t if d == "f" else max(0, t - SPAN + 1)
                high = min(len(x), low + SPAN)
                driven = x[low:high] @ self.p[f"{d}x"] + self.p[f"{d}c"]
            z = driven[t - low] + h @ self.p[f"{d}h"]
            f, i, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            new_h = o * np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, f, i, o, g, new_c))
            c, h = np.where(m, new_c, c), np.where(m, new_h, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        if keep is None:
            w = self.p["out"]
            total = x @ w[2 * HIDDEN :] + self.p["bias"]
            for n, d in enumerate("fb"):
                total += self._scan(d, x, mask, None) @ w[n * HIDDEN : (n + 1) * HIDDEN]
            return _sigmoid(total)[..., 0]
        kept = {d: [] for d in "fb"}
        both = np.concatenate([self._scan("f", x, mask, kept["f"]), self._scan("b", x, mask, kept["b"]), x], 2)
        keep |= kept | {"both": both}
        return _sigmoid(both @ self.p["out"] + self.p["bias"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        keep: dict = {}
        p = self.forward(x, mask, keep)
        delta = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        grads = {"out": np.einsum("tbi,tbo->io", keep["both"], delta), "bias": delta.sum((0, 1))}
        back = delta @ self.p["out"].T
        dx = back[..., 2 * HIDDEN :].copy()
        for n, d in enumerate("fb"):
            gx, gh = np.zeros_like(self.p[f"{d}x"]), np.zeros_like(self.p[f"{d}h"])
            gc = np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, f, i, o, g, new_c in reversed(keep[d]):
                m = mask[t][:, None]
                dh = dh + back[t][:, n * HIDDEN : (n + 1) * HIDDEN]
                tc = np.tanh(new_c)
                dnew = np.where(m, dh * o * (1 - tc**2) + dc, 0)
                dz = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), np.where(m, dh * tc, 0) * o * (1 - o), dnew * i * (1 - g**2)], 1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(0)
                dx[t] += dz @ self.p[f"{d}x"].T
                dh = np.where(m, 0, dh) + dz @ self.p[f"{d}h"].T
                dc = np.where(m, dnew * f, dc)
            grads |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": gc}
        return grads, dx

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for every block of every page, given the inputs of its blocks."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages of like length together, a bounded number of blocks at a time
            some = order[at : at + 128]
            while len(some) > 1 and len(pages[some[-1]]) > 2 * len(pages[some[0]]) + 8:
                some = some[: len(some) // 2]
            at += len(some)
            x, mask, _ = _padded([(pages[i], None) for i in some])
            p = self.forward(x, mask)
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def _padded(pages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = max(len(x) for x, _ in pages)
    x = np.zeros((length, len(pages), pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((length, len(pages)), bool), np.zeros((length, len(pages)), np.float32)
    for k, (rows, labels) in enumerate(pages):
        x[: len(rows), k], mask[: len(rows), k] = rows, True
        if labels is not None:
            y[: len(rows), k] = labels
    return x, mask, y


def train(pages: list[tuple[str, list[str]]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Labeller:
    """pages: (html, the main blocks in order). Adam on the mean cross-entropy of blocks."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    data, on_pages = [], Counter()
    for page, main in pages:
        found = blocks(page)
        wanted, labels = list(main), []
        for text, _, _ in found:
            labels.append(float(bool(wanted) and text == wanted[0]))
            if labels[-1]:
                wanted.pop(0)
        if found:
            on_pages.update({w for text, _, _ in found for w in text.lower().split()})
            data.append((encode(found), np.array(labels, np.float32)))
    model.known[:] = False
    model.known[[_row(w) for w, n in on_pages.items() if n >= COMMON * len(data)]] = True
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 8)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            some = [data[i] for i in batches[b]]
            x, mask, y = _padded([(model.inputs(e), labels) for e, labels in some])
            grads, dx = model.gradients(x, mask, y)
            grads |= {"path": np.zeros_like(model.p["path"]), "word": np.zeros_like(model.p["word"])}
            for k, ((paths, words, _), labels) in enumerate(some):
                for i in range(len(labels)):
                    if paths[i]:
                        np.add.at(grads["path"], list(paths[i]), dx[i, k, :PATH] / len(paths[i]))
                    w = words[i][model.known[words[i]]]
                    if len(w):
                        np.add.at(grads["word"], w, dx[i, k, PATH : PATH + WORD] / len(words[i]))
            t += 1
            step = rate * (0.3 if epoch >= epochs - 2 else 1.0)
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                model.p[name] -= (step * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


# Pages made by rule --------------------------------------------------------------------------------------------------

_SYLLABLES = "ka ri to men la sol ver ein cho tra ple ost und ea ing er qué ción ße ñor été wi za gro ta".split()
_ROLES = {
    "nav": ("menu nav navigation navbar topnav breadcrumb breadcrumbs links pagination", "home about contact news products services archive next previous login search more"),
    "header": ("header masthead top site-header branding logo banner", "welcome official site daily online weekly"),
    "side": ("sidebar side related widget rail recommended popular trending more-stories aside", "related popular recent posts stories also read categories archives tags"),
    "notice": ("cookie cookies notice alert consent gdpr popup modal overlay warning subscribe newsletter paywall", "we use cookies accept privacy policy consent agree subscribe newsletter notice please enable"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo promotion adbox banner-ad", "advertisement sponsored buy now offer sale discount free shipping deal"),
    "footer": ("footer bottom legal copyright site-footer credits", "copyright all rights reserved terms privacy imprint contact powered"),
    "comments": ("comments comment comment-list responses replies discussion reply thread user-comments", "reply says commented ago likes report share thanks posted by"),
    "share": ("share social sharing buttons follow author-box meta toolbar", "share tweet email print follow facebook"),
}
_ARIA = {"nav": "navigation", "header": "banner", "side": "complementary", "notice": "alert", "footer": "contentinfo"}
_MAIN = "content main article post entry story article-body post-content entry-content text body page main-content prose".split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, extra: list[str] = (), share: float = 0.0) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join(self.pick(extra) if extra and self.chance(share) else "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 22, extra: list[str] = (), share: float = 0.0) -> str:
        s = self.words(low, high, extra, share)
        return s[:1].upper() + s[1:] + self.pick([".", ".", ".", "!", "?", "", " &amp; more."])

    def paragraph(self, extra: list[str] = (), share: float = 0.0) -> str:
        return " ".join(self.sentence(extra=extra, share=share) for _ in range(int(self.rng.integers(1, 7))))

    def marked(self, text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and self.chance(0.3):
            i = int(self.rng.integers(len(parts) - 1))
            parts[i] = self.pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(parts[i])
        return " ".join(parts)

    def boilerplate(self, role: str) -> str:
        names, extra = (x.split() for x in _ROLES[role])
        tag = {"nav": "nav", "header": "header", "side": "aside", "footer": "footer"}.get(role)
        if tag and self.chance(0.55):
            head = tag + (f' class="{self.pick(names)}"' if self.chance(0.4) else "")
        else:
            tag = self.pick(["div", "div", "section", "ul" if role == "nav" else "div"])
            head = f'{tag} {self.pick(["class", "id", "class"])}="{self.pick(names)}{self.pick(["", " box", "-wrap", " w1", "-1"])}"'
        if role in _ARIA and self.chance(0.15):
            tag = "div"
            head = f'div role="{_ARIA[role]}"'
        if role in ("nav", "share") or role == "side" and self.chance(0.5):
            links = "".join(f'<li><a href="/{i}">{self.words(1, 4, extra, 0.3)}</a></li>' for i in range(int(self.rng.integers(2, 9))))
            inner = links if tag == "ul" else f"<ul>{links}</ul>"
        elif role == "comments":
            one = lambda: f'<{(t := self.pick(["li", "div", "article"]))} class="{self.pick(["comment", "reply", "comment-body", "item"])}"><span>{self.words(1, 2)}</span><p>{self.paragraph(extra, 0.08)}</p></{t}>'
            inner = f"<h3>{self.words(1, 3, extra, 0.6)}</h3>" * self.chance(0.6) + "".join(one() for _ in range(int(self.rng.integers(1, 6))))
        elif role == "header" and self.chance(0.4):
            inner = f"<h1><a href='/'>{self.words(1, 3)}</a></h1>" + f"<p>{self.sentence(2, 6, extra, 0.3)}</p>" * self.chance(0.5)
        elif self.chance(0.5):
            inner = f"{self.pick(['&copy; ', ''])}{self.sentence(2, 12, extra, 0.3)}"
        else:
            inner = f"<p>{self.paragraph(extra, self.pick([0.0, 0.2]))}</p>" + f"<p>{self.sentence(2, 8, extra, 0.3)}</p>" * self.chance(0.3)
        return f"<{head}>{inner}</{tag}>"

    def links(self) -> str:
        return self.pick([" | ", " ", "<br>", " &middot; "]).join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(int(self.rng.integers(2, 8))))

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><select><option>{self.words(1, 2)}</option></select><button>{self.pick(["Search", "Send", "Subscribe", "OK"])}</button></form>'

    def page(self) -> tuple[str, list[str]]:
        main: list[str] = []

        def block(tag: str, text: str, shape: str = "<{0}>{1}</{0}>") -> str:
            main.append(" ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split()))
            return shape.format(tag, text)

        body = []
        if self.chance(0.8):
            title = block("h1", self.words(2, 9))
            # a heading of its own belongs to the article, unlike the site's
            body.append(f"<header>{title}</header>" if self.chance(0.2) else title)
        inside = ["ad", "share", "notice", "side"]
        for _ in range(int(self.rng.integers(1, 13))):
            kind = self.rng.random()
            if kind < 0.07:
                body.append(block("p", self.sentence(1, 3)))
            elif kind < 0.68:
                body.append(block("p", self.marked(self.paragraph()), self.pick(["<{0}>{1}</{0}>", "<{0}>{1}</{0}>", "<{0}>{1}", "<{0}><b>{1}<br>", '<{0} class="t">{1}</{0}>', "<div>{1}</div>"])))
            elif kind < 0.76:
                body.append(block(self.pick(["h2", "h3"]), self.words(1, 7)))
            elif kind < 0.83:
                body.append("<ul>" + "".join(block("li", self.sentence(2, 14)) for _ in range(int(self.rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.88:
                body.append(block("blockquote", self.sentence(5, 20)))
            elif kind < 0.91:
                body.append("<table><tr>" + "".join(block("td", self.words(1, 3)) for _ in range(4)) + "</tr></table>")
            elif kind < 0.94:
                body.append("<figure><img src='a.png'>" + block("figcaption", self.sentence(3, 9)) + "</figure>")
            else:
                body.append(self.boilerplate(self.pick(inside)))
        article = "".join(body)
        shell = self.rng.random()
        if shell < 0.45:
            article = f"<article{' class=' + chr(34) + self.pick(_MAIN) + chr(34) if self.chance(0.3) else ''}>{article}{self.boilerplate('comments') if self.chance(0.1) else ''}</article>"
        elif shell < 0.6:
            article = f"<main>{article}</main>"
        elif shell < 0.9:
            article = f'<div {self.pick(["class", "id"])}="{self.pick(_MAIN)}">{article}</div>'
        before = [self.boilerplate(r) for r in ("notice", "header", "nav", "ad", "side") if self.chance(0.45)]
        after = [self.boilerplate(r) for r in ("share", "ad", "side", "comments", "notice", "nav", "footer") if self.chance(0.45)]
        if self.chance(0.3):
            (before if self.chance(0.5) else after).append(self.form())
        if self.chance(0.2):
            (before if self.chance(0.5) else after).append(f"<div>{self.links()}</div>")
        if self.chance(0.08):
            before, after = [], []
        script = '<script>var t="</p>";x(1);</script>' * self.chance(0.5)
        head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>" if self.chance(0.9) else ""
        inner = "".join(before) + "<!-- note -->" + article + script + "".join(after)
        if self.chance(0.06):
            inner = f'<table><tr><td class="{self.pick(_ROLES["nav"][0].split())}">{self.links()}</td><td>{article}</td></tr></table>' + "".join(after)
        if self.chance(0.25):
            inner = f'<div {self.pick(["class", "id"])}="{self.pick(["wrapper", "container", "page", "site", "layout", "row"])}">{inner}</div>'
        return f"{head}<body>{inner}</body></html>" if head else inner, main


def made_pages(n: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """n pages made by rule, with their main blocks."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


@functools.lru_cache(4)
def default_labeller(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    return train(made_pages(pages), epochs)


def main_text(pages: list[str | None], model: Labeller, least: float = 0.5) -> list[str]:
    paths: dict = {}
    found = [model.read(p, paths) for p in pages]
    marked = model.label([x for _, x in found])
    return ["\n\n".join(text for text, p in zip(texts, m, strict=True) if p >= least) for (texts, _), m in zip(found, marked, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) of every row.

    Null and empty pages have an empty text; broken markup is read as far as it goes; repeated rows give equal results;
    an empty table gives no rows; other columns are not read.
    """
    model = model or default_labeller()
    slim = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_text(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("k", key)
