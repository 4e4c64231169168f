"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks: text between block-level tags, with the path of open elements above it.
A bidirectional LSTM in numpy reads, for every block, the hashed elements of its path, hashed-word vectors of its text and
a few measures, and decides for every block, in the context of the whole page, whether it is article text. Training pages
are generated (``training_pages``): layouts of many kinds around an article, so that the label of each block is known.

The model is trained once on the driver, from a fixed seed, and broadcast (some tens of kB). Pages are independent rows,
so extraction is a map without a shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hash_words, prepare, word_spans

# ---------------------------------------------------------------- pages to blocks

# Fixed values of the HTML standard: elements without an end tag, elements whose content isn't text, inline elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea select datalist".split())
_EMBEDDED = "noscript iframe object audio video canvas math mi mn mo ms mspace mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom semantics annotation svg g path circle ellipse line polygon polyline rect defs use symbol lineargradient radialgradient stop clippath mask pattern marker text tspan textpath desc"
_INLINE = frozenset(f"a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img {_EMBEDDED}".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

# Quotes hold a value only right after "="; one that nothing closes is a character like any other. Nothing is tried twice.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(/?)([a-zA-Z][^\ \t\n\f\r/>]*+)((?:[\ \t\n\f\r/]++|(?:=[^\ \t\n\f\r/>=]*+|[^\ \t\n\f\r/>=]++)(?:[\ \t\n\f\r]*+=[\ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^\ \t\n\f\r>]*+))?+)*+)>
    |<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.X,
)
_UNQUOTED_END = re.compile(r"""=[ \t\n\f\r]*[^"' \t\n\f\r>][^ \t\n\f\r>]*/\Z""")
_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Block:
    element: tuple | None  # its innermost element that isn't inline, after that one's own
    key: bytes  # sums over the elements of its path
    text: str
    linked: float  # share of its characters in links

    @property
    def path(self) -> str:
        names, element = [], self.element
        while element:
            element, name = element
            names.append(name)
        return "/".join(reversed(names))


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role, which end where capitals begin too."""
    words = [w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in re.findall(r"[A-Z]*[a-z]+|[A-Z]+", m[2] or m[3] or m[4] or "")]
    return ".".join([tag, *sorted(set(words))])


_PATH = 128


_NO_PATH = np.zeros(_PATH, np.int32)
_NO_PATH[zlib.crc32(b"<") % _PATH] += 1 if zlib.crc32(b"<") >> 20 & 1 else -1
_NO_PATH[zlib.crc32(b"last<") % _PATH] += 1 if zlib.crc32(b"last<") >> 20 & 1 else -1


@lru_cache(1 << 14)
def _element_vector(element: str, last: bool) -> np.ndarray:
    """What an element adds to its path's sums; last: beside that, as the innermost one."""
    tag, *words = element.split(".")
    out = np.zeros(_PATH, np.int32)
    for word in {f"last<{tag}"} - {*words, f"<{tag}"} if last else {f"<{tag}", *words}:
        h = zlib.crc32(word.encode())
        out[h % _PATH] += 1 if h >> 20 & 1 else -1
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; those without text are left out. A path has all open elements but inline ones, as sums that
    change by one element at a time, so its depth costs nothing."""
    stack: list[str] = []
    inner: list[tuple] = []  # of the elements of the stack that aren't inline, each after the one around it
    sums = np.zeros(_PATH, np.int32)
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0

    def end() -> None:
        nonlocal linked
        if parts:
            joined = "".join(parts)
            text = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if text:
                element = inner[-1] if inner else None
                whole = sums + _element_vector(element[1], True) if element else _NO_PATH
                out.append(Block(element, whole.tobytes(), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal sums
        tag = stack.pop()
        opened[tag] -= 1
        if tag not in _INLINE:
            sums -= _element_vector(inner.pop()[1], False)
        return tag

    while m := _TOKEN.match(page, at):
        piece, at = m[0], m.end()
        if piece[0] != "<" or piece == "<":
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)
            continue
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag in _RAW:  # no text, and none ends there
            if not closing:  # what is inside isn't markup: on to its end tag as it is written, "/" or not
                stop = _END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag not in _INLINE:
            end()
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in _VOID or m[3].endswith("/") and not _UNQUOTED_END.search(m[3]):
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag in _BLOCKS_END_P else None)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in closes:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k] not in _INLINE:
                    break
        stack.append(tag)
        opened[tag] += 1
        if tag not in _INLINE:
            inner.append((inner[-1] if inner else None, _element(tag, m[3])))
            sums += _element_vector(inner[-1][1], False)
    end()
    return out


# ---------------------------------------------------------------- blocks to numbers

_WORD, _WORDS_AT_ONCE = 16, 1 << 17
_VECTORS = np.random.default_rng(20).standard_normal((4096, _WORD)).astype(np.float32)
_INPUT = _PATH + _WORD + 6


def _path_vector(key: bytes) -> np.ndarray:
    return np.frombuffer(key, np.int32).astype(np.float32)


def _features(found: list[Block], sizes: list[int]) -> tuple[list[bytes], np.ndarray]:
    """Paths' sums, and the other inputs of each block: word vectors and measures."""
    n = len(found)
    out = np.zeros((n, _WORD + 6), np.float32)
    data = [b.text.lower().encode() for b in found]
    lengths = np.fromiter(map(len, data), np.int64, n)
    raw = np.frombuffer(b"".join(data), np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)])
    starts, ends, words = word_spans(raw, at)
    own = (hash_words(raw, starts, ends)[0] >> np.uint64(52)).astype(np.int64)
    count = np.diff(words)
    some = np.flatnonzero(count)
    first = 0
    while first < len(some):  # whole blocks, so that vectors are made for so many words, or one block's, at once
        last = max(first + 1, int(np.searchsorted(words[some], words[some[first]] + _WORDS_AT_ONCE)))
        these, base = some[first:last], words[some[first]]
        out[these, :_WORD] = np.add.reduceat(_VECTORS[own[base : words[these[-1] + 1]]], words[these] - base, axis=0) / np.sqrt(count[these])[:, None] * 0.3
        first = last
    stops = np.cumsum(np.concatenate([[0], np.isin(raw, np.frombuffer(b".!?,;:", np.uint8))]))
    digits = np.cumsum(np.concatenate([[0], (raw >= 48) & (raw <= 57)]))
    out[:, _WORD] = np.log1p(lengths) / 4
    out[:, _WORD + 1] = np.array([b.linked for b in found], np.float32)
    out[:, _WORD + 2] = (stops[at[1:]] - stops[at[:-1]]) / np.maximum(count, 1)
    out[:, _WORD + 3] = (digits[at[1:]] - digits[at[:-1]]) / np.maximum(lengths, 1)
    out[:, _WORD + 4] = np.minimum(count, 60) / 30
    first = np.cumsum(sizes) - sizes
    out[first, _WORD + 5] = 1
    return [b.key for b in found], out


# ---------------------------------------------------------------- the network

_HIDDEN = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    inputs: list[np.ndarray]  # per direction: (_INPUT, 4 _HIDDEN)
    loops: list[np.ndarray]  # (_HIDDEN, 4 _HIDDEN)
    shifts: list[np.ndarray]
    top: np.ndarray  # (2 _HIDDEN,)
    bias: np.ndarray  # (1,)
    _known: dict[bytes, np.ndarray] = field(default_factory=dict)

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.loops, *self.shifts, self.top, self.bias]

    def _project(self, paths: list[bytes], rest: np.ndarray) -> np.ndarray:
        """Input terms of both directions; those of a path are computed once."""
        number: dict[bytes, int] = {}
        ids = [number.setdefault(p, len(number)) for p in paths]
        for p in number:
            if p not in self._known:
                if len(self._known) > 20_000:
                    self._known.clear()
                v = _path_vector(p)
                self._known[p] = np.concatenate([v @ w[:_PATH] + b for w, b in zip(self.inputs, self.shifts, strict=True)])
        table = np.stack([self._known[p] for p in number])
        return table[ids] + np.concatenate([rest @ w[_PATH:] for w in self.inputs], axis=1)

    def chances(self, paths: list[bytes], rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of every block, that it is article text. sizes: blocks of each page, none of them 0."""
        x = self._project(paths, rest)
        total = np.full(len(x), self.bias[0], np.float32)
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        for group in np.array_split(order, -(-len(order) // 512)):
            n, a = sizes[group], first[group]
            for d in range(2):
                h = np.zeros((len(group), _HIDDEN), np.float32)
                c = np.zeros_like(h)
                loop, top = self.loops[d], self.top[d * _HIDDEN : (d + 1) * _HIDDEN]
                for t in range(int(n[0])):
                    live = int(np.searchsorted(-n, -t, "left"))  # pages with more than t blocks come first
                    at = a[:live] + (t if d == 0 else n[:live] - 1 - t)
                    z = x[at, d * 4 * _HIDDEN : (d + 1) * 4 * _HIDDEN] + h[:live] @ loop
                    s = _sigmoid(z[:, : 3 * _HIDDEN])
                    c[:live] = s[:, _HIDDEN : 2 * _HIDDEN] * c[:live] + s[:, :_HIDDEN] * np.tanh(z[:, 3 * _HIDDEN :])
                    h[:live] = s[:, 2 * _HIDDEN :] * np.tanh(c[:live])
                    total[at] += h[:live] @ top
        return _sigmoid(total)


def _start(seed: int) -> Labeller:
    rng = np.random.default_rng(seed)
    shift = np.zeros(4 * _HIDDEN, np.float32)
    shift[_HIDDEN : 2 * _HIDDEN] = 1  # remember at first
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return Labeller([draw(_INPUT, 4 * _HIDDEN) for _ in range(2)], [draw(_HIDDEN, 4 * _HIDDEN) for _ in range(2)], [shift.copy(), shift.copy()], draw(2 * _HIDDEN), np.zeros(1, np.float32))


def _gradients(model: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Back-propagation through time for padded pages: x (pages, blocks, inputs), mask and y (pages, blocks)."""
    pages, steps, _ = x.shape
    k = _HIDDEN
    kept, logits = [], np.full((pages, steps), model.bias[0], np.float32)
    for d in range(2):
        z_in = x @ model.inputs[d] + model.shifts[d]
        h, c, trail = np.zeros((pages, k), np.float32), np.zeros((pages, k), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = z_in[:, t] + h @ model.loops[d]
            s, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            new_c = (s[:, k : 2 * k] * c + s[:, :k] * g) * m + c * (1 - m)
            th = np.tanh(new_c)
            new_h = (s[:, 2 * k :] * th) * m + h * (1 - m)
            trail.append((t, h, c, s, g, th, m))
            h, c = new_h, new_c
            logits[:, t] += h @ model.top[d * k : (d + 1) * k]
        kept.append(trail)
    p = _sigmoid(logits)
    weight = mask / mask.sum()
    loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
    delta = (p - y) * weight
    grads: dict[str, list[np.ndarray]] = {"inputs": [], "loops": [], "shifts": []}
    top = np.zeros_like(model.top)
    for d in range(2):
        out = model.top[d * k : (d + 1) * k]
        dz_all = np.zeros((pages, steps, 4 * k), np.float32)
        d_loop = np.zeros_like(model.loops[d])
        dh, dc = np.zeros((pages, k), np.float32), np.zeros((pages, k), np.float32)
        for t, h, c, s, g, th, m in reversed(kept[d]):
            now = s[:, 2 * k :] * th * m + h * (1 - m)
            top[d * k : (d + 1) * k] += now.T @ delta[:, t]
            dh = dh + delta[:, t, None] * out
            dhm = dh * m
            dcm = (dc + dhm / np.where(m > 0, 1, 1) * s[:, 2 * k :] * (1 - th * th)) * m
            dz = np.concatenate([dcm * g * s[:, :k] * (1 - s[:, :k]), dcm * c * s[:, k : 2 * k] * (1 - s[:, k : 2 * k]), dhm * th * s[:, 2 * k :] * (1 - s[:, 2 * k :]), dcm * s[:, :k] * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            d_loop += h.T @ dz
            dh = dz @ model.loops[d].T + dh * (1 - m)
            dc = dcm * s[:, k : 2 * k] + dc * (1 - m)
        grads["inputs"].append(np.einsum("pti,ptj->ij", x, dz_all, optimize=True))
        grads["loops"].append(d_loop)
        grads["shifts"].append(dz_all.sum((0, 1)))
    return [*grads["inputs"], *grads["loops"], *grads["shifts"], top, np.array([delta.sum()], np.float32)], loss


def train(pages: int = 1500, epochs: int = 12, batch: int = 50, rate: float = 0.01, seed: int = 4) -> Labeller:
    """The same model for the same arguments."""
    model = _start(seed)
    sets = []
    for page, inside in training_pages(pages, seed):
        found = blocks(page)
        if found:
            paths, rest = _features(found, [len(found)])
            sets.append((np.concatenate([np.stack([_path_vector(p) for p in paths]), rest], axis=1), inside))
    sets.sort(key=lambda s: len(s[1]))
    groups = [sets[a : a + batch] for a in range(0, len(sets), batch)]
    padded = []
    for group in groups:
        steps = max(len(y) for _, y in group)
        x, mask, y = np.zeros((len(group), steps, _INPUT), np.float32), np.zeros((len(group), steps), np.float32), np.zeros((len(group), steps), np.float32)
        for k, (a, b) in enumerate(group):
            x[k, : len(b)], mask[k, : len(b)], y[k, : len(b)] = a, 1, b
        padded.append((x, mask, y))
    rng, t = np.random.default_rng(seed), 0
    first, second = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()]
    for epoch in range(epochs):
        for k in rng.permutation(len(padded)):
            grads, _ = _gradients(model, *padded[k])
            t += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (1 if epoch < epochs * 0.7 else 0.2) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


# ---------------------------------------------------------------- training pages

_AROUND = "nav menu navbar navigation topbar header masthead footer bottom sidebar aside widget ad ads advert advertisement banner sponsor promo cookie consent notice alert newsletter subscribe signup social share sharing related recommended comments comment discussion reply replies disqus breadcrumb breadcrumbs pagination pager search login form toolbar skip popup modal overlay legal copyright tags".split()
_MAIN = "article content main post entry story text body page section copy prose".split()
_NEUTRAL = "container wrapper row col inner box block left right wide grid item group outer".split()
_SHORT = "home news about contact login register subscribe share more next previous search privacy terms cookies accept copyright rights reserved menu reply posted sponsored related comments".split()
_MARK = "﷐"  # a character that isn't in any text, on what belongs to an article


def training_pages(count: int, seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """(page, for each of its blocks whether it is article text). Articles are marked as they are made; the marks are taken out again."""
    rng = random.Random(seed)
    syllables = [a + b for a in ["", *"bcdfghjklmnpqrstvwz", "th", "sch", "qu"] for b in ["a", "e", "i", "o", "u", "an", "er", "in", "on", "é", "ö", "ción", "ing"]]

    def words(n: int) -> str:
        out = []
        for _ in range(n):
            w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
            out.append(w + rng.choice(["", "", "", "", ",", ".", "", "###" if rng.random() < 0.1 else ""]))
        return " ".join(out).capitalize()

    def sentence(low: int = 4, high: int = 40) -> str:
        if rng.random() < 0.05:
            return " ".join([words(1)] * rng.randint(3, 200))
        return words(rng.randint(low, high)) + rng.choice([".", ".", ".", "", "!"])

    def short() -> str:
        return " ".join(rng.choice(_SHORT) if rng.random() < 0.5 else words(1) for _ in range(rng.randint(1, 4)))

    def wrap(tag: str, inner: str, kinds: list[str] | None = None) -> str:
        name = "" if not kinds else f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "site-", "page_"])}{rng.choice(kinds)}{rng.choice(["", "", " " + rng.choice(_NEUTRAL)])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def around(plain: bool = False) -> str:
        """What stands beside an article; plain: in elements that say nothing."""
        kind = rng.random()
        if kind < 0.3:
            inner = "<ul>" + "".join(f"<li>{link(short())}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        elif kind < 0.6:
            inner = sentence(2, 25)
        elif kind < 0.75:
            inner = "".join(f"<p>{sentence(2, 30)}</p>" for _ in range(rng.randint(1, 4)))
        elif kind < 0.85:
            inner = f"<h3>{short()}</h3>" + "".join(wrap("div", f"<b>{words(1)}</b> {sentence(3, 25)}", rng.choice([None, _NEUTRAL, ["comment"]])) for _ in range(rng.randint(1, 4)))
        else:
            inner = f"{short()} {link(short())}<br>&copy; {short()} &middot; {sentence(2, 12)}"
        if plain and kind < 0.3 and rng.random() < 0.7:
            return wrap("div", inner, rng.choice([None, _NEUTRAL, _AROUND]))
        if rng.random() < 0.4:
            return wrap(rng.choice(["nav", "footer", "aside", "header", "form", "footer", "nav"]), inner, rng.choice([None, None, _AROUND, _NEUTRAL]))
        return wrap(rng.choice(["div", "div", "div", "section", "ul" if inner.startswith("<li") else "div"]), inner, _AROUND)

    def paragraph() -> str:
        text = _MARK + sentence(1, 70)
        kind = rng.random()
        if kind < 0.08:
            text = f"{text} {link(words(2))} {words(4)}"
        if kind < 0.2:
            return f"<p><b>{text}<br>"
        if kind < 0.25:
            return wrap("blockquote", text)
        if kind < 0.3:
            return "<ul>" + "".join(f"<li>{_MARK}{sentence(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.36:
            return wrap(rng.choice(["h2", "h3"]), _MARK + words(rng.randint(1, 8)))
        if kind < 0.4:
            return f"<table><tr><td>{_MARK}{words(2)}</td><td>{_MARK}{words(3)}</td></tr></table>"
        return f"<p>{text}</p>" if kind < 0.97 else f"<div>{text}</div>"

    for number in range(count):
        size = rng.choice([1, 1, 2, 3, 5, 8, 12, 20]) if number % 30 else rng.randint(40, 200)
        inner = [f"<h1>{_MARK}{words(rng.randint(2, 9))}</h1>"] if rng.random() < 0.8 else []
        same = paragraph() if rng.random() < 0.1 else None
        for _ in range(size):
            inner.append(same if same and rng.random() < 0.8 else paragraph())
            if rng.random() < 0.03:
                inner.append(wrap(rng.choice(["div", "aside"]), sentence(2, 15), ["ad", "ads", "advert", "promo", "related", "share", "newsletter"]))
        if rng.random() < 0.15:
            inner.append(wrap("div", "".join(wrap("div", sentence(), ["comment", "reply"]) for _ in range(rng.randint(1, 4))), ["comments", "discussion"]))
        holder = rng.random()
        main = "".join(inner)
        bare = holder >= 0.85
        if holder < 0.5:
            main = wrap("article", main, rng.choice([None, None, _MAIN]))
        elif holder < 0.6:
            main = wrap("main", main)
        elif holder < 0.85:
            main = wrap(rng.choice(["div", "section"]), main, _MAIN)
        elif holder < 0.95:  # elements that say nothing, or a cell of a layout table
            main = wrap("div", main, rng.choice([None, _NEUTRAL]))
        if rng.random() < 0.3:
            main = wrap(rng.choice(["div", "main"]), main, rng.choice([_NEUTRAL, _MAIN]))
        before, after = [around(bare) for _ in range(rng.randint(0, 3))], [around(bare) for _ in range(rng.randint(0, 3))]
        if bare and rng.random() < 0.4:
            cells = [f"<td>{x}</td>" for x in (*before, main, *after)]
            parts = ["<table><tr>" + rng.choice(["", "</tr><tr>"]).join(cells) + "</tr></table>"]
        else:
            parts = [*before, main, *after]
        if rng.random() < 0.3:
            parts = [wrap("div", "".join(parts), _NEUTRAL)]
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(parts)}{"</body></html>" if rng.random() < 0.9 else ""}'
        labels = np.array([_MARK in b.text for b in blocks(page)], np.float32)
        yield page.replace(_MARK, ""), labels


# ---------------------------------------------------------------- extraction


def extract_pages(pages: list[str | None], model: Labeller) -> list[str]:
    """The article text of each page: its blocks joined by line ends."""
    found = [blocks(p or "") for p in pages]
    sizes = np.array([len(f) for f in found])
    some = np.flatnonzero(sizes)
    if not len(some):
        return [""] * len(pages)
    every = [b for f in found for b in f]
    paths, rest = _features(every, sizes[some].tolist())
    inside = (model.chances(paths, rest, sizes[some]) >= 0.5).tolist()
    out, at = [], 0
    for f in found:
        out.append("\n".join(b.text for b, i in zip(f, inside[at : at + len(f)], strict=True) if i))
        at += len(f)
    return out


def _slices(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows (first, after the last) of some SLICE_BYTES together; one long page stays whole."""
    sizes = np.cumsum(pa.compute.binary_length(pages).fill_null(0).to_numpy())
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE_BYTES, "right")))
        yield first, last
        first = last


def main_text(pages: DataFrame, model: Labeller | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages; without html or article text, text is empty."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _slices(batch.column(2)):
                part = batch.slice(first, last - first)
                texts = extract_pages(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
