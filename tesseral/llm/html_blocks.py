"""HTML extraction by a recurrent block labeller.

A page is cut into its leaf blocks: the text between two borders of block elements, in page order, with the path of the
elements around it. A block is the mean of two kinds of learned vectors: one for each hashed tag-path token (tag names,
class and id words, how much of it is link text, how long it is), one for each hashed word. A bidirectional LSTM in numpy reads
a page's blocks one after another and labels each as main text or not, so the whole document is the context.

The model is trained here, on generated pages whose regions are known: articles of several layouts among menus, headers,
sidebars, notices, adverts, forms, reader comments and footers. Scripts, styles, head and comments of the markup have no
blocks at all.
"""

from __future__ import annotations

import html as html_entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesseral.llm.words import SPACED, U, word_spans

#: Buckets and sizes of the vectors of path tokens and words, and of the recurrent layer's state.
PATH_BUCKETS, PATH_SIZE, WORD_BUCKETS, WORD_SIZE, STATE = 4096, 16, 8192, 8, 20
#: Innermost elements whose names a block's path holds.
DEPTH = 24
#: Generated pages that the model is fitted on, passes over them, and pages that are labelled at once.
TRAINING_PAGES, PASSES, TOGETHER = 900, 5, 64

# Elements by their role in HTML.
UNSEEN = frozenset("script style head noscript template title svg math iframe object canvas audio video select datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td textarea tfoot th thead tr ul".split()
)
#: What an opening tag of this name closes without being told, if it is the innermost block.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: list[int]  # hashed tokens


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BUCKETS


def _element_tokens(name: str, attributes: str, kept: dict) -> tuple[int, ...]:
    key = (name, attributes)
    if key not in kept:
        if len(kept) > 50_000:
            kept.clear()
        tokens = {name}
        for _, value in _NAMED.findall(attributes):
            tokens.update(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        kept[key] = tuple(sorted({_bucket(t) for t in tokens}))
    return kept[key]


def blocks(page: str, kept: dict | None = None) -> list[Block]:
    """The leaf blocks of a page, broken markup included, with white space turned into single blanks; blocks without text are left out."""
    kept = {} if kept is None else kept
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    places: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    borders: list[int] = []  # where block elements do
    unseen = 0
    text: list[str] = []
    linked = plain = 0
    inner: set[int] = set()  # inline elements around some of the block's text

    def push(name: str, tokens: tuple[int, ...]) -> None:
        nonlocal unseen
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            borders.append(len(stack))
        unseen += name in UNSEEN
        stack.append((name, tokens))

    def cut(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCK:
                borders.pop()
            unseen -= name in UNSEEN

    def border() -> None:
        nonlocal linked, plain
        if text:
            clean = _SPACE.sub(" ", "".join(text)).strip()
            if clean:
                path = {b for _, tokens in stack[-DEPTH:] for b in tokens} | inner
                path.add(_bucket(f"links:{4 * linked // max(1, linked + plain)}"))
                path.add(_bucket(f"length:{len(clean).bit_length()}"))
                out.append(Block(clean, sorted(path)))
        text.clear()
        inner.clear()
        linked = plain = 0

    def add(piece: str) -> None:
        nonlocal linked, plain
        if unseen:
            return
        piece = html_entities.unescape(piece) if "&" in piece else piece
        text.append(piece)
        size = len(piece.strip())
        if size:
            if places.get("a"):
                linked += size
            else:
                plain += size
            for _, tokens in stack[max(borders[-1] + 1 if borders else 0, len(stack) - DEPTH) :]:
                inner.update(tokens)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        tag = _TAG.match(page, lt)
        if tag is None:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # an unclosed quote or a cut tag
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            add("<")
            at = lt + 1
            continue
        at = tag.end()
        closing, name, attributes = tag.group(1) == "/", tag.group(2).lower(), tag.group(3)
        if name in BLOCK:
            border()
        elif name == "br":
            text.append(" ")
        if closing:
            depth = places[name][-1] if places.get(name) else None
            # an inline element doesn't reach over the block element around it
            if depth is not None and (name in BLOCK or name in UNSEEN or not borders or borders[-1] < depth):
                cut(depth)
            continue
        if name in BLOCK and borders and stack[borders[-1]][0] in CLOSES.get(name, {"p"}):
            cut(borders[-1])
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name == "body" and unseen:  # an unclosed head ends here
            seen = [s for s in stack if s[0] not in UNSEEN]
            cut(0)
            for s in seen:
                push(*s)
        push(name, _element_tokens(name, attributes, kept))
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if name == "textarea" and (close is None or close.start() > at):
                add(page[at : close.start() if close else end])
            cut(len(stack) - 1)
            border() if name == "textarea" else None
            at = end if close is None else close.end()
    border()
    return out


# --- the recurrent layer ------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Vectors of tokens and words, a bidirectional LSTM over blocks, and a logistic output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "path": draw(PATH_BUCKETS, PATH_SIZE, scale=0.3),
            "word": np.zeros((WORD_BUCKETS, WORD_SIZE), np.float32),
            "out": draw(2 * STATE + size, scale=0.1),
            "bias": np.zeros(1, np.float32),
        }
        for way in ("forth", "back"):
            self.weights[f"{way}_x"] = draw(size, 4 * STATE, scale=size**-0.5)
            self.weights[f"{way}_h"] = draw(STATE, 4 * STATE, scale=STATE**-0.5)
            self.weights[f"{way}_b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), STATE)

    def vectors(self, page_blocks: list[Block]) -> tuple[np.ndarray, tuple]:
        """One vector per block, and what the gradient needs."""
        path = np.concatenate([np.array(b.path) for b in page_blocks])
        path_at = np.concatenate(([0], np.cumsum([len(b.path) for b in page_blocks])))
        encoded = [b.text.lower().encode() for b in page_blocks]
        offsets = np.concatenate(([0], np.cumsum([len(e) for e in encoded])))
        starts, _, hashes = word_spans(np.frombuffer(b"".join(encoded), np.uint8), offsets, SPACED)
        word_at = np.searchsorted(starts, offsets)
        words = (hashes % U(WORD_BUCKETS)).astype(np.int64)
        parts = []
        for name, ids, at in (("path", path, path_at), ("word", words, word_at)):
            total = np.zeros((len(ids) + 1, self.weights[name].shape[1]), np.float32)
            np.cumsum(self.weights[name][ids], axis=0, out=total[1:])
            count = np.maximum(np.diff(at), 1)[:, None]
            scale = np.sqrt(count) if name == "path" else count
            parts.append((total[at[1:]] - total[at[:-1]]) / scale)
        return np.concatenate(parts, axis=1), (path, path_at, words, word_at)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """States of one direction for x [time, page, size], and with ``keep`` what the gradient needs; padded steps keep the state."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, STATE), np.float32)
        w, u, b = (self.weights[f"{way}_{k}"] for k in "xhb")
        out, kept = np.zeros((steps, pages, STATE), np.float32), [None] * steps
        into = x @ w + b
        for t in range(steps) if way == "forth" else range(steps - 1, -1, -1):
            z = into[t] + h @ u
            gates = _sigmoid(z[:, : 3 * STATE])
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            g = np.tanh(z[:, 3 * STATE :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh_c = np.tanh(new_c)
            new_h = np.where(m, o * tanh_c, h)
            if keep:
                kept[t] = (i, f, o, g, c, tanh_c, h, m)
            h, c = new_h, new_c
            out[t] = h
        return out, kept

    def _gradient(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        steps, pages, _ = x.shape
        w, u = self.weights[f"{way}_x"], self.weights[f"{way}_h"]
        dh = dc = np.zeros((pages, STATE), np.float32)
        dz_all = np.zeros((steps, pages, 4 * STATE), np.float32)
        gu = np.zeros_like(u)
        for t in range(steps - 1, -1, -1) if way == "forth" else range(steps):
            i, f, o, g, c, tanh_c, h, m = kept[t]
            d = dh + d_out[t]
            live_h, d = np.where(m, 0, d), np.where(m, d, 0)
            d_c = dc + d * o * (1 - tanh_c**2)
            live_c, d_c = np.where(m, 0, d_c), np.where(m, d_c, 0)
            dz = np.concatenate((d_c * g * i * (1 - i), d_c * c * f * (1 - f), d * tanh_c * o * (1 - o), d_c * i * (1 - g**2)), axis=1)
            dz_all[t] = dz
            gu += h.T @ dz
            dh, dc = dz @ u.T + live_h, d_c * f + live_c
        grads[f"{way}_h"], grads[f"{way}_b"] = gu, dz_all.sum(axis=(0, 1))
        grads[f"{way}_x"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * STATE)
        return dz_all @ w.T

    def _padded(self, pages: list[list[Block]], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        mask = np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            mask[: len(p), k] = True
        x = np.zeros((steps, len(pages), flat.shape[1]), np.float32)
        x.transpose(1, 0, 2)[mask.T] = flat
        return x, mask

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for at in range(0, len(order), TOGETHER):
            chosen = order[at : at + TOGETHER]
            some = [pages[k] for k in chosen]
            flat = np.concatenate([self.vectors(p)[0] for p in some])
            x, mask = self._padded(some, flat)
            states = [self._run(x, mask, way, keep=False)[0] for way in ("forth", "back")]
            p = _sigmoid(np.concatenate((*states, x), axis=2) @ self.weights["out"] + self.weights["bias"])
            for j, k in enumerate(chosen):
                out[k] = p[: len(pages[k]), j]
        return out

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], passes: int = PASSES, rate: float = 0.01, batch: int = 24, seed: int = 1) -> None:
        """Adam on the logistic loss; deterministic."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        step = 0
        for turn in range(passes):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[k] for k in order[at : at + batch]]
                parts = [self.vectors(p) for p in some]
                x, mask = self._padded(some, np.concatenate([p[0] for p in parts]))
                runs = {way: self._run(x, mask, way) for way in ("forth", "back")}
                full = np.concatenate((runs["forth"][0], runs["back"][0], x), axis=2)
                y, _ = self._padded(some, np.concatenate([labels[k] for k in order[at : at + batch]])[:, None])
                d = np.where(mask, _sigmoid(full @ self.weights["out"] + self.weights["bias"]) - y[:, :, 0], 0).astype(np.float32) / mask.sum()
                grads = {"out": np.einsum("tpk,tp->k", full, d), "bias": np.array([d.sum()], np.float32)}
                d_full = d[:, :, None] * self.weights["out"]
                dx = d_full[:, :, 2 * STATE :].copy()
                for k, way in enumerate(("forth", "back")):
                    dx += self._gradient(x, way, runs[way][1], d_full[:, :, k * STATE : (k + 1) * STATE], grads)
                flat = dx.transpose(1, 0, 2)[mask.T]
                for name, columns, place in (("path", slice(0, PATH_SIZE), 0), ("word", slice(PATH_SIZE, None), 2)):
                    ids = np.concatenate([p[1][place] for p in parts])
                    count = np.concatenate([np.diff(p[1][place + 1]) for p in parts])
                    scale = np.sqrt(np.maximum(count, 1)) if name == "path" else np.maximum(count, 1)
                    each = np.repeat(flat[:, columns] / scale[:, None], count, axis=0)
                    sums = [np.bincount(ids, each[:, k], len(self.weights[name])) for k in range(each.shape[1])]
                    grads[name] = np.stack(sums, axis=1).astype(np.float32)
                step += 1
                pace = rate * (1 - turn / passes)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.weights[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)
                self.weights["word"] *= 0.999


# --- generated pages with known labels ------------------------------------------------------------------------------

_MARK = "\ue000"  # before each piece of main text of a generated page

# Usual names and words of page regions.
_CONTENT_NAMES = "content entry-content post-body article-body story main-text post article text body page-content entry".split()
_NEUTRAL_NAMES = "container wrapper row col page site layout inner grid box block wrap outer".split()
_REGIONS = {
    "menu": (["nav", "div", "ul", "menu"], "nav menu navbar main-menu navigation breadcrumb breadcrumbs toc pagination tabs topbar".split()),
    "header": (["header", "div"], "header site-header masthead banner top page-header branding logo".split()),
    "footer": (["footer", "div"], "footer site-footer bottom page-footer copyright legal colophon".split()),
    "side": (["aside", "div", "section"], "sidebar side aside widget related related-posts popular recommended trending more-stories tags rail".split()),
    "notice": (["div", "section", "aside", "dialog", "p"], "cookie cookie-notice consent gdpr notice alert privacy-banner popup modal overlay newsletter subscribe paywall warning message".split()),
    "advert": (["div", "aside", "section", "ins", "figure", "p"], "ad ads advert advertisement sponsored promo banner-ad sponsor adsense ad-slot promotion".split()),
    "form": (["form"], "search login signup contact newsletter-form subscribe-form comment-form form".split()),
    "comments": (["section", "div", "ol", "ul"], "comments comment-list reader-comments discussion replies responses comment disqus user-comments thread".split()),
    "share": (["div", "ul"], "share social sharing follow byline-tools toolbar actions buttons".split()),
}
_PLAIN_WORDS = {
    "menu": "home about contact news products services blog login more".split(),
    "header": "welcome home search menu sign in".split(),
    "footer": "© copyright all rights reserved privacy terms imprint · contact 2024".split(),
    "side": "related read more popular latest archive categories tags recent posts".split(),
    "notice": "we use cookies accept agree privacy policy subscribe newsletter consent settings".split(),
    "advert": "advertisement sponsored buy now sale offer discount click here".split(),
    "form": "name email password submit send search subscribe your address".split(),
    "comments": "reply said says comment like thanks great posted ago user report".split(),
    "share": "share tweet facebook like print email follow us".split(),
}


class _Pages:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = "a e i o u an en er on re th st ti la de qu ch le in es".split()
        self.lexicon = ["".join(self.rng.choice(letters, self.rng.integers(1, 5))) for _ in range(3000)]
        self.stock = sorted({w for words in _PLAIN_WORDS.values() for w in words})

    def some(self, names) -> str:
        return str(names[self.rng.integers(len(names))])

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high))
        lexicon = self.stock if self.chance(0.06) else self.lexicon  # any text may use any words
        chosen = self.rng.integers(0, len(lexicon), 1 if self.chance(0.08) else n)  # at times one word again and again
        out = " ".join(lexicon[i] for i in np.resize(chosen, n)).capitalize() + self.some([".", ".", "!", "", "?"])
        if self.chance(0.1):
            out = out.upper()
        if self.chance(0.2):
            out = out.replace(" ", self.some(["*** ", "### ", "&amp; ", "%%% ", "1 ", "!! ", "$$$ "]))
        return out

    def named(self, tag: str, names, chance: float = 1.0) -> str:
        if not self.chance(chance):
            return f"<{tag}>"
        value = self.some(names) + (f" {self.some(_NEUTRAL_NAMES)}" if self.chance(0.2) else "") + (str(self.rng.integers(9)) if self.chance(0.1) else "")
        return f'<{tag} {self.some(["class", "class", "class", "id"])}="{value}">'

    def region(self, kind: str) -> str:
        tags, names = _REGIONS[kind]
        tag = self.some(tags)
        neutral = tag in ("div", "p", "ul", "ol", "section", "ins", "figure")
        usual = lambda: self.words(1, 25) if self.chance(0.6) else " ".join(self.some(_PLAIN_WORDS[kind]) for _ in range(self.rng.integers(1, 8)))
        n = int(self.rng.integers(1, 7))
        open_tag = self.named(tag, names, 1.0 if neutral else 0.5)
        if kind in ("menu", "share") or kind in ("side", "footer") and self.chance(0.4):
            items = "".join(f'<li><a href="/x{i}">{usual() if self.chance(0.3) else self.words(1, 3)}</a></li>' for i in range(n + 1))
            inner = items if tag in ("ul", "menu", "ol") else f"<ul>{items}</ul>" if self.chance(0.7) else re.sub("</?li>", " ", items)
        elif kind == "form":
            inner = "".join(f'<label>{usual()}</label><input type="text">' for _ in range(n)) + f"<button>{usual()}</button><p>{usual()}</p>"
        elif kind == "comments":
            item = self.some(["li", "div", "article", "div"])
            inner = self.some(["<h2>Comments</h2>", f"<h3>{usual()}</h3>", ""]) + "".join(
                self.named(item, ["comment", "reply", "comment-body"], 0.8) + f"<b>{self.words(1, 3)}</b><p>{self.words(3, 90)}</p></{item}>" for _ in range(n)
            )
        elif tag == "p":
            inner = usual()
        else:
            wrap = self.some(["p", "div", "", "span", "h3"])
            inner = "".join((f"<{wrap}>{usual()}</{wrap}>" if wrap else usual()) for _ in range(1 if not wrap else min(n, 4)))
        return f"{open_tag}{inner}</{tag}>"

    def main_block(self) -> str:
        m = _MARK
        kind = self.rng.integers(12)
        if kind == 0:
            return f"<{(h := self.some(['h2', 'h3', 'h4']))}>{m}{self.words(2, 9)}</{h}>"
        if kind == 1:
            tag = self.some(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{m}{self.words(2, 30)}" + self.some(["</li>", ""]) for _ in range(self.rng.integers(2, 6))) + f"</{tag}>"
        if kind == 2:
            return f"<blockquote><p>{m}{self.words(5, 60)}</p></blockquote>"
        if kind == 3 and self.chance(0.5):
            return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 5)}</td><td>{m}{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == 4:
            return f"<p><b>{m}{self.words(2, 20)}<br>"
        if kind == 5 and self.chance(0.5):
            return f"<figure><img src='x'><figcaption>{m}{self.words(3, 15)}</figcaption></figure>"
        if kind == 6:
            return f"<pre>{m}{self.words(5, 40)}</pre>"
        if kind == 7:
            return f'<p>{m}{self.words(5, 40)} <a href="/y">{self.words(1, 5)}</a> {self.words(3, 40)}</p>'
        return f"<p>{m}{self.words(1, 160)}" + self.some(["</p>", "</p>", "</p>", ""])

    def page(self) -> str:
        out = [f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><script>var t='</p>';</script></head><body>"]
        extra = lambda p, kinds: "".join(self.region(k) for k in kinds if self.chance(p))
        wraps = [self.named("div", _NEUTRAL_NAMES, 0.7) for _ in range(self.rng.integers(0, 3))]
        out += wraps
        out.append(extra(0.45, ["notice", "header", "menu", "advert", "side", "form"]))
        style = int(self.rng.integers(7))
        tag = "article" if style < 3 else "main" if style == 3 else "div" if style < 6 else "section"
        outer = self.some(["<main>", '<div id="main">', ""]) if style < 3 else ""
        out.append(outer + self.named(tag, _CONTENT_NAMES, 0.3 if tag in ("article", "main") else 1.0))
        if self.chance(0.85):
            title = f"<h1>{_MARK}{self.words(2, 12)}</h1>"
            out.append(title)
        if self.chance(0.2):
            out.append(self.region("share"))
        for _ in range(self.rng.integers(0, 9) if self.chance(0.9) else self.rng.integers(9, 40)):
            out.append(self.main_block())
            if self.chance(0.06):
                out.append(self.region(self.some(["advert", "side", "notice", "form", "menu"])))
        out.append(extra(0.1, ["share", "side", "comments", "form"]))
        out.append(f"</{tag}>" + {"<main>": "</main>", "": ""}.get(outer, "</div>"))
        out.append(extra(0.35, ["comments", "side", "advert", "share", "form", "notice"]))
        out.append(extra(0.7, ["footer"]))
        out += ["</div>"] * len(wraps) + ["</body></html>"] * self.chance(0.9)
        return "".join(out)


def generated_pages(n: int, seed: int = 7) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks of n generated pages and whether each is main text."""
    maker, pages, labels = _Pages(seed), [], []
    while len(pages) < n:
        marked = blocks(maker.page())
        if not marked:
            continue
        labels.append(np.array([_MARK in b.text for b in marked], np.float32))
        for b in marked:
            b.text = b.text.replace(_MARK, "")
        pages.append(marked)
    return pages, labels


def train(pages: int = TRAINING_PAGES, seed: int = 7) -> Labeller:
    """A labeller fitted on generated pages."""
    model = Labeller(seed)
    model.fit(*generated_pages(pages, seed))
    return model


def main_text(page: str, model: Labeller) -> str:
    """The main text of one page, blocks joined by line breaks."""
    found = blocks(page)
    return "\n".join(b.text for b, p in zip(found, model.scores([found])[0], strict=True) if p >= 0.5)


def extract(pages: DataFrame, model: Labeller, *, html: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points); the two names replace columns of the same name.

    Null, empty and textless pages give the empty string. Every row is labelled by itself, so copies agree; very long
    pages are labelled whole. An empty table gives an empty table.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size, some 0.5 MB

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = shared.value, {}
        for batch in batches:
            column = batch.column(batch.num_columns - 1).to_pylist()
            texts: list[str] = []
            for at in range(0, len(column), 512):
                found = [blocks(h or "", kept) for h in column[at : at + 512]]
                texts += ["\n".join(b.text for b, p in zip(f, s, strict=True) if p >= 0.5) for f, s in zip(found, known.scores(found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, pages[html].alias("_html")).mapInArrow(label, schema)
