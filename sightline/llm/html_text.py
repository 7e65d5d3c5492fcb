"""Main text of html pages by a recurrent block labeller.

A tolerant scanner turns a page into its sequence of leaf blocks: the text between block-level tags, with the
sum of all open tags above it. Each block gets a vector of tag-path features (hashed tag names and class, id and
role words of every open tag, which the scanner adds up as tags open and close; the two nearest tags once more) and
hashed-word features (all its words as a unit vector, their number, its share of link text, its punctuation). A bidirectional LSTM in numpy reads the whole sequence, so that a block is judged by what
stands before and after it, and gives each block the probability of being main text.

Training is self-supervised: a seeded grammar writes pages of many layouts, with known main blocks, out of
random words, the commonest words of four languages and what page furniture says in them; the network is trained
on them in the driver (TRAIN_PAGES pages, EPOCHS epochs; one to two minutes) and its weights, some 120,000 numbers,
go to the tasks. With a `weights` folder they are trained once for all sessions that share it.

What is never text in a page (scripts, styles, comments, markup, form controls) the scanner drops itself.

Defined cases: null html is empty and gives an empty text; a page without blocks gives an empty text; unclosed
and misnested tags close with their nearest open ancestor; a head also closes at the first tag or text that can't
stand in it, and a control that has no end tag at the first block; an unclosed comment, script, style or tag ends
the page; a very long or deep page is read in a time that is linear in it, and a task holds one such page's blocks;
repeated rows, and rows that tie in id or url, give a row each; a null id or url is passed on; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .textblocks import U64, word_bounds, word_hashes

# tags whose text is never shown or is a control's
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head select textarea button option datalist audio video map".split())
#: Tags that leave a head open.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split()
)
#: Tags that an opening tag closes when they are open in the same container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("p",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
#: Containers through which CLOSES does not reach.
WALLS = frozenset("table ul ol dl div article section main aside nav header footer body form blockquote figure".split())

#: What a "<" may begin: a comment, a tag's name, or a declaration; anything else is text.
_MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|</?([A-Za-z][^\s/>]*)|<(?:[!?]|/[^\sA-Za-z])[^>]*(?:>|\Z)", re.DOTALL)
_IN_TAG = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"'])")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{7,});?")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+")
#: Skipped tags that hold markup, and what may stand in one that is never closed; of NESTING, one can hold another.
_CONTROLS = ("select", "button", "option", "object", "canvas", "datalist", "audio", "video", "map")
_IN_CONTROL = frozenset({*_CONTROLS, "optgroup", "script", "style", "noscript", "template", "svg", "math", "iframe", "textarea"})
_NESTING = frozenset(("object", "canvas", "audio", "video", "map"))
_CONTROL = re.compile(rf"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script|\Z)|<style\b.*?(?:</style|\Z)|<(/?)({'|'.join(_CONTROLS)})(?=[\s/>])", re.DOTALL | re.IGNORECASE)
_ENDINGS = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "title")}


class Block:
    """path: the two nearest (tag, class and id words); above: the hashed sum of all open tags, of PATH_BUCKETS numbers;
    text: decoded, white space as one space; linked: characters in links."""

    __slots__ = ("path", "above", "text", "linked")

    def __init__(self, path, above, text, linked):
        self.path, self.above, self.text, self.linked = path, above, text, linked


#: Sums of open tags beyond this many are told apart no more; the table holds sign(x) * log2(1 + |x|).
_MOST_OPEN = 1 << 14
_DAMPED = np.sign(np.arange(-_MOST_OPEN, _MOST_OPEN + 1)) * np.log2(1 + np.abs(np.arange(-_MOST_OPEN, _MOST_OPEN + 1)))
_DAMPED = _DAMPED.astype(np.float16)


def _closed_controls(page: str) -> set[int]:
    """Where the controls begin that have an end tag of their own."""
    closed: set[int] = set()
    waiting: dict[str, list[int]] = {t: [] for t in _CONTROLS}
    for m in _CONTROL.finditer(page):
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if waiting[tag]:
                closed.add(waiting[tag].pop())
        else:
            if tag not in _NESTING:
                waiting[tag].clear()
            waiting[tag].append(m.start())
    return closed


def _reference(m: re.Match) -> str:
    """A long numeric reference without its leading zeros; past Unicode's end it stands for an unknown character."""
    body = m[0][2:].rstrip(";")
    digits = body[1:].lstrip("0") if body[0] in "xX" else body.lstrip("0")
    if len(digits) > 7:
        return "\ufffd"
    return f"&#{'x' if body[0] in 'xX' else ''}{digits or '0'};"


def decoded(raw: str) -> str:
    """raw with its character references as the characters."""
    if "&" not in raw:
        return raw
    return html.unescape(_LONG_REFERENCE.sub(_reference, raw) if "&#" in raw else raw)


class _Quotes:
    """Where a quote is closed in a page; a search that fails is not made again."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, {'"': len(page) + 1, "'": len(page) + 1}

    def close(self, quote: str, at: int) -> int:
        if at >= self.gone[quote]:
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.gone[quote] = at
        return found


def _tag_end(page: str, at: int, quotes: _Quotes) -> int:
    """The place after the ">" that ends the tag whose name ends at `at`, or -1. Quotes count after "=" only, and only if closed."""
    if page.startswith(">", at):
        return at + 1
    while (m := _IN_TAG.search(page, at)) is not None:
        at = m.end()
        if m[0] == ">":
            return at
        if (v := _VALUE.match(page, at)) is not None and (close := quotes.close(v[1], v.end())) >= 0:
            at = close + 1
    return -1


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, in a time that is linear in the page.

    Every tag is read once to its end, and the open tags' places are kept by name, so that no end tag searches the stack.
    As in HTML, "/" at a tag's end means nothing but within svg and math, and a tag that is never ended ends the page.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    outer: list[tuple[str, tuple]] = []  # the stack without inline tags
    outer_at: list[int] = []  # their places in the stack
    walls: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open tags, by name
    running = np.zeros(PATH_BUCKETS, np.int32)  # of all tags in outer
    sums: dict[bytes, bytes] = {}  # blocks in like places share one
    parts: list[str] = []
    own = {"linked": 0, "links": 0, "skip": 0}
    closed: set[int] | None = None
    loose: list[int] = []  # places in the stack of open controls without an end tag
    quotes = _Quotes(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                above = _DAMPED[np.clip(running, -_MOST_OPEN, _MOST_OPEN) + _MOST_OPEN].tobytes()
                blocks.append(Block(tuple(outer[-2:]), sums.setdefault(above, above), text, own["linked"]))
            parts.clear()
            own["linked"] = 0

    def take(raw: str) -> None:
        if stack and stack[-1][0] == "head" and raw.strip():
            pop_to(len(stack) - 1)
        if raw and not own["skip"]:
            text = decoded(raw)
            parts.append(text)
            if own["links"]:
                own["linked"] += len(text)

    def count(tag: str, words: tuple, by: int) -> None:
        for key in (f"t:{tag}", *(f"w:{w}" for w in words)):
            k, sign = _bucket(key, PATH_BUCKETS)
            running[k] += by if sign > 0 else -by

    def pop_to(k: int) -> None:
        for tag, words in reversed(stack[k:]):
            own["skip"] -= tag in SKIPPED
            own["links"] -= tag == "a"
            places[tag].pop()
            if tag not in INLINE:
                outer.pop()
                outer_at.pop()
                count(tag, words, -1)
        del stack[k:]
        for marks in (loose, walls):
            while marks and marks[-1] >= k:
                marks.pop()

    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less < 0:
            take(page[at:])
            break
        m = _MARK.match(page, less)
        if m is None:  # a "<" of the text
            after = page.find("<", less + 1)
            take(page[at : after if after >= 0 else end])
            at = after if after >= 0 else end
            continue
        take(page[at:less])
        at = m.end()
        if m[1] is None:
            continue
        tag, begins = m[1].lower(), at
        at = _tag_end(page, at, quotes)
        if at < 0:
            break
        attributes = page[begins : at - 1]
        if page[less + 1] == "/":
            if tag not in INLINE:
                flush()
            # an inline end tag does not close the blocks inside it
            if places[tag] and (tag not in INLINE or not outer_at or places[tag][-1] > outer_at[-1]):
                pop_to(places[tag][-1])
            continue
        if places["head"] and tag not in IN_HEAD:
            pop_to(places["head"][0])
        if loose and tag not in INLINE and tag not in VOID and tag not in _IN_CONTROL:
            pop_to(loose[0])
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _ENDINGS:  # raw text: up to its end tag, whatever it holds
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            e = _ENDINGS[tag].search(page, at)
            at = e.end() if e else end
            continue
        if tag not in INLINE:
            flush()
            if tag not in ("p",) and tag not in CLOSES and stack and stack[-1][0] == "p" and tag not in VOID:
                pop_to(len(stack) - 1)
            wall = walls[-1] if walls else -1
            reach = [p[k] for t in (*CLOSES.get(tag, ()), "p") if (p := places[t]) and (k := bisect.bisect_right(p, wall)) < len(p)]
            if reach:
                pop_to(min(reach))
        if tag in VOID:
            continue
        words = ()
        if attributes:
            words = tuple(w.lower() for x in _NAMES.finditer(attributes) for w in _SPLIT.split(x[2] or x[3] or x[4] or "") if len(w) > 1)
        if tag in _CONTROLS:
            closed = _closed_controls(page) if closed is None else closed
            if less not in closed:
                loose.append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        places[tag].append(len(stack))
        if tag not in INLINE:
            outer_at.append(len(stack))
            outer.append((tag, words))
            count(tag, words, 1)
        stack.append((tag, words))
        own["skip"] += tag in SKIPPED
        own["links"] += tag == "a"
    flush()
    return blocks


# --- features -----------------------------------------------------------------------------------------------

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 256, 256, 10
WIDTH = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 24


@functools.lru_cache(maxsize=1 << 16)
def _bucket(word: str, buckets: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % buckets, 1.0 if h >> 31 else -1.0


def _path_features(b: Block) -> np.ndarray:
    out = np.frombuffer(b.above, np.float16).astype(np.float32)
    for near, (tag, _) in enumerate(reversed(b.path)):
        k, sign = _bucket(f"n{near}:{tag}", PATH_BUCKETS)
        out[k] += sign
    return out


_POINTS = np.zeros(256, bool)
_POINTS[list(b".,:;!?")] = True


def _word_features(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of each block's hashed words (A-Z as a-z, points at their end taken off), and how many words it has."""
    raw = [b.text.encode("utf-8", "replace") for b in blocks]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    offsets = np.append(0, np.cumsum([len(x) + 1 for x in raw]))
    starts, ends, rows = word_bounds(data, np.minimum(offsets, len(data)))
    n = np.bincount(rows, minlength=len(blocks))
    ends = ends.copy()
    for _ in range(3):
        ends -= _POINTS[data[ends - 1]] & (ends - starts > 1)
    hashes = word_hashes(data, starts, ends, fold=True)
    signs = np.where(hashes >> U64(63), 1.0, -1.0)
    sums = np.bincount(rows * WORD_BUCKETS + (hashes % U64(WORD_BUCKETS)).astype(np.int64), signs, len(blocks) * WORD_BUCKETS)
    sums = sums.reshape(len(blocks), WORD_BUCKETS)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1), n


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    # all words of every block; of length one, so that a block's length says nothing here
    out[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS], counts = _word_features(blocks)
    for i, b in enumerate(blocks):
        n = int(counts[i])
        out[i, :PATH_BUCKETS] = _path_features(b)
        size = len(b.text)
        out[i, PATH_BUCKETS + WORD_BUCKETS :] = (
            np.log1p(n) / 4,
            n <= 3,
            n <= 12,
            n > 30,
            b.linked / size,
            b.linked * 2 > size,
            min(1.0, sum(map(b.text.count, ".,;")) / (n + 1)),
            b.text[-1] in ".!?:…\"'”",
            any(c in b.text for c in "©|»›·"),
            i / len(blocks),
        )
    return out


# --- network ------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM over block vectors, then a logistic unit per block."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, seed: int, width: int = WIDTH, hidden: int = HIDDEN) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[f"x{side}"] = (rng.normal(size=(width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            w[f"h{side}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            w[f"b{side}"] = bias
        w["out"] = (rng.normal(size=2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        w["skip"] = np.zeros(width, np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return cls(w)

    def _run(self, x: np.ndarray, live: np.ndarray, side: str, steps: range):
        """x: time x batch x width. States stay where a row has ended."""
        w, hidden = self.w, self.w["hf"].shape[0]
        batch = x.shape[1]
        h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        drive = x @ w[f"x{side}"] + w[f"b{side}"]
        tape = {}
        out = np.zeros((*x.shape[:2], hidden), np.float32)
        for t in steps:
            z = drive[t] + h @ w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
            g = np.tanh(z[:, 3 * hidden :])
            now = f * c + i * g
            squashed = np.tanh(now)
            on = live[t][:, None]
            tape[t] = (i, f, o, g, c, squashed, h, on)
            c = np.where(on, now, c)
            h = np.where(on, o * squashed, h)
            out[t] = h
        return out, tape

    def _logits(self, x, live):
        n = len(x)
        forward, tape_f = self._run(x, live, "f", range(n))
        backward, tape_b = self._run(x, live, "b", range(n - 1, -1, -1))
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.w["out"] + x @ self.w["skip"] + self.w["bias"], both, tape_f, tape_b

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's block vectors, each block's chance of being main text."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1  # pages of like length together, within a bound on the padded size
            while b < len(order) and b - a < 256 and len(pages[order[b]]) * (b - a + 1) <= max(16384, len(pages[order[a]])):
                b += 1
            own = [pages[k] for k in order[a:b]]
            x, live = _padded(own)
            p = _sigmoid(self._logits(x, live)[0])
            for j, k in enumerate(order[a:b]):
                out[k] = p[: len(pages[k]), j]
            a = b
        return out

    def gradients(self, x, live, wanted):
        logits, both, tape_f, tape_b = self._logits(x, live)
        p = _sigmoid(logits)
        total = max(1, int(live.sum()))
        d = np.where(live, p - wanted, 0).astype(np.float32) / total
        loss = float(-np.where(live, wanted * np.log(p + 1e-7) + (1 - wanted) * np.log(1 - p + 1e-7), 0).sum() / total)
        grads = {"out": np.einsum("tbh,tb->h", both, d), "skip": np.einsum("tbw,tb->w", x, d), "bias": d.sum(keepdims=True).reshape(1)}
        d_both = d[:, :, None] * self.w["out"]
        hidden = self.w["hf"].shape[0]
        for side, tape, part, steps in (("f", tape_f, d_both[:, :, :hidden], range(len(x) - 1, -1, -1)), ("b", tape_b, d_both[:, :, hidden:], range(len(x)))):
            dh = dc = np.zeros((x.shape[1], hidden), np.float32)
            dz_all = np.zeros((len(x), x.shape[1], 4 * hidden), np.float32)
            d_hh = np.zeros_like(self.w[f"h{side}"])
            for t in steps:
                i, f, o, g, c, squashed, h_before, on = tape[t]
                dh = dh + part[t]
                live_dh = np.where(on, dh, 0)
                live_dc = np.where(on, dc, 0) + live_dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    [live_dc * g * i * (1 - i), live_dc * c * f * (1 - f), live_dh * squashed * o * (1 - o), live_dc * i * (1 - g**2)], axis=1
                )
                dz_all[t] = dz
                d_hh += h_before.T @ dz
                dh = np.where(on, dz @ self.w[f"h{side}"].T, dh)
                dc = np.where(on, live_dc * f, dc)
            grads[f"h{side}"] = d_hh
            grads[f"x{side}"] = np.einsum("tbw,tbz->wz", x, dz_all, optimize=True)
            grads[f"b{side}"] = dz_all.sum(axis=(0, 1))
        return loss, grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    live = np.zeros((longest, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        live[: len(page), k] = True
    return x, live


# --- training pages -----------------------------------------------------------------------------------------

TRAIN_PAGES, EPOCHS, SEED = 7000, 9, 11

_NAV = "home about contact products services blog news archive login register search help faq sitemap privacy terms shop cart".split()
_LABELS = {
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "toc"),
    "header": ("header", "masthead", "banner", "site-header", "top", "logo"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "colophon"),
    "aside": ("sidebar", "side", "widget", "related", "recommended", "popular", "tags", "share", "social", "newsletter"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "gdpr", "subscribe", "banner"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "ad-slot"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "reader-comments", "responses"),
    "form": ("search-form", "signup", "login", "contact-form", "subscribe-form"),
    "main": ("content", "main", "post", "entry", "article-body", "story", "text", "entry-content", "post-content", "page"),
}


#: What page furniture says, in the languages that are written most on the web.
_WORDING = {
    "notice": (
        "we use cookies to give you the best experience on our website", "by continuing to use this site you accept our cookie policy", "accept all cookies",
        "manage your privacy settings", "sign up for our newsletter and never miss a story", "you have reached your limit of free articles, subscribe to continue reading",
        "wir verwenden cookies, um ihnen das beste erlebnis zu bieten", "mit der nutzung dieser seite stimmen sie der verwendung von cookies zu", "alle akzeptieren",
        "nous utilisons des cookies pour améliorer votre expérience", "en poursuivant votre navigation, vous acceptez l'utilisation de cookies", "tout accepter",
        "utilizamos cookies para mejorar su experiencia", "si continúa navegando, acepta el uso de cookies", "aceptar todas",
    ),
    "ad": (
        "advertisement", "sponsored content", "buy now and save with free shipping", "limited time offer, order today", "anzeige", "jetzt kaufen und sparen",
        "publicité", "achetez maintenant, livraison gratuite", "publicidad", "compre ahora con envío gratis",
    ),
    "comments": (
        "posted by a reader", "reply", "i agree with this article", "thanks for sharing, great post", "says", "antworten", "danke für den beitrag", "répondre",
        "merci pour cet article", "responder", "gracias por el artículo", "log in to leave a comment", "likes",
    ),
    "aside": ("related articles", "most read", "share this on", "follow us", "read more", "mehr zum thema", "meistgelesen", "à lire aussi", "les plus lus", "lo más leído", "te puede interesar"),
    "footer": ("all rights reserved", "terms of use", "privacy policy", "contact us", "alle rechte vorbehalten", "impressum", "tous droits réservés", "mentions légales", "todos los derechos reservados", "aviso legal"),
    "form": ("search", "your email", "password", "send", "suche", "rechercher", "buscar", "subscribe", "log in"),
}
#: The commonest words of four languages, which texts and furniture share.
_COMMON = (
    "the of and to in is that for it was on with as by at from this".split(),
    "der die und in den von zu das mit sich des auf für ist im dem nicht".split(),
    "de la le et les des en un du une que est pour qui dans par sur".split(),
    "de la que el en y a los del se las por un para con no una".split(),
)
#: Class words that say how a tag looks.
_LOOKS = """flex grid row col px py mt mb my mx pt pb text bg rounded shadow wide center md lg sm xl hover border items justify between gap font semibold
container wrapper inner outer block relative absolute full max min auto overflow hidden transition duration white gray dark""".split()
class _Writer:
    """Writes one page; main blocks are remembered by their text."""

    def __init__(self, rnd: random.Random) -> None:
        self.rnd, self.main, self.cells = rnd, [], False
        # some pages stand deep in wrappers, some name looks beside meanings
        self.depth, self.looks = rnd.choice([0, 0, 2, 6, 24]), rnd.choice([0, 0, 3, 9])
        letters = rnd.choice(["etaoinshrdlu", "enisratdhulgäöü", "eaosrnidltcñó", "esaitnrulodéè"])
        own = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(120)]
        # the words of one page differ in how often they are said, as those of a language do
        often = rnd.choice([0.0, 0.7, 1.0])
        common = rnd.choice(_COMMON) if rnd.random() < 0.7 else []
        self.lexicon = [w for k, w in enumerate(common + own) for _ in range(1 + int(often * 40 / (k + 1)))]
        # what a text looks like says nothing about whether it is main text
        self.style = rnd.choice(["plain"] * 8 + ["bars", "symbols", "shout", "repeat", "stuck"])

    def words(self, low: int, high: int) -> str:
        rnd = self.rnd
        each = [rnd.choice(self.lexicon) + ("," if rnd.random() < 0.07 else "") for _ in range(rnd.randint(low, high))]
        if self.style == "bars":
            return " | ".join(each) + " |" * (rnd.random() < 0.5)
        if self.style == "symbols":
            return " ".join(w + rnd.choice(["***", "%%%", "###", "$$$"]) for w in each)
        if self.style == "shout":
            return " ".join(w.upper() + "!!" for w in each)
        if self.style == "repeat":
            return " ".join(w for w in each for _ in range(4))
        if self.style == "stuck" and rnd.random() < 0.5:
            return " ".join(each[:1] * len(each) * rnd.choice([1, 4, 16]))
        return " ".join(each)

    def sentence(self, low: int = 4, high: int = 22) -> str:
        return self.words(low, high).strip(",").capitalize() + self.rnd.choice(".....!?") * (self.rnd.random() < 0.93)

    def prose(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def named(self, word: str) -> str:
        """A class attribute's words: looks before and after the meaning."""
        rnd = self.rnd
        looks = [rnd.choice(_LOOKS) for _ in range(rnd.randint(0, self.looks))]
        k = rnd.randint(0, len(looks))
        return " ".join([*looks[:k], word, *looks[k:]]).strip()

    def deep(self, body: str) -> str:
        """Within wrappers that say nothing."""
        rnd = self.rnd
        n = rnd.randint(0, self.depth)
        return "".join(f'<div class="{self.named("")}">' if self.looks or rnd.random() < 0.2 else "<div>" for _ in range(n)) + body + "</div>" * n

    def name(self, kind: str) -> str:
        rnd = self.rnd
        if rnd.random() < 0.15:
            return ""
        word = rnd.choice(_LABELS[kind])
        return f' {rnd.choice(["class", "class", "id"])}="{self.named(word)}"'

    def junk(self, kind: str) -> str:
        """What such furniture says, or text that could be anyone's, which only its place gives away."""
        rnd = self.rnd
        if kind in _WORDING and rnd.random() < 0.5:
            return self.wording(kind)
        return rnd.choice([self.words(1, 4), self.sentence(3, 12), self.prose(rnd.randint(1, 3)), f"{self.words(1, 3)} · {self.words(1, 3)}"])

    def wording(self, kind: str) -> str:
        """Set phrases of a kind among other words, from a few to more than a paragraph's."""
        rnd = self.rnd
        said = [rnd.choice(_WORDING[kind]) for _ in range(rnd.choice([1, 1, 2, 3]))]
        if rnd.random() < 0.5:
            said.insert(rnd.randrange(len(said) + 1), self.words(1, 12))
        return ". ".join(x.capitalize() if rnd.random() < 0.8 else x for x in said) + rnd.choice(["", ".", "!"])

    def unnamed(self) -> str:
        """Furniture that nothing but its words tells from text."""
        rnd = self.rnd
        kind = rnd.choice(["notice", "notice", "ad", "comments", "footer"])
        tag = rnd.choice(["div", "section", "div"])
        return self.deep(f"<{tag}>{self.wording(kind)}</{tag}>") + rnd.choice(["", "\n"])

    def links(self) -> str:
        rnd = self.rnd
        each = [f'<a href="/{k}">{rnd.choice([rnd.choice(_NAV), self.words(1, 3)])}</a>' for k in range(rnd.randint(2, 9))]
        form = rnd.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (rnd.random() < 0.9) for x in each) + "</ul>"
        return rnd.choice([" | ", " ", "\n"]).join(each) if form < 0.9 else "".join(f"<div>{x}</div>" for x in each)

    def say(self, tag: str, text: str, close: float = 0.9) -> str:
        """A main block."""
        self.main.append(" ".join(text.split()))
        inner, rnd = text, self.rnd
        if rnd.random() < 0.2 and " " in text:
            k = text.index(" ")
            mark = rnd.choice(["b", "em", "i", "strong", "a href=/x", "span class=x"])
            inner = f"<{mark}>{text[:k]}" + (f"</{mark.split()[0]}>" if rnd.random() < 0.8 else "") + text[k:]
        return f"<{tag}>{inner}" + (f"</{tag}>" if rnd.random() < close else "") + rnd.choice(["", "\n"])

    def furniture(self, kind: str) -> str:
        rnd = self.rnd
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and rnd.random() < 0.6 else rnd.choice(["div", "section", "div"])
        tag = "td" if self.cells and rnd.random() < 0.8 else tag
        attrs = self.name(kind) if tag == semantic or rnd.random() < 0.3 else f' class="{self.named(rnd.choice(_LABELS[kind]))}"'
        if kind == "nav":
            body = self.links()
        elif kind == "header":
            body = rnd.choice([f"<h1>{self.words(1, 5)}</h1>", f"<a href=/>{self.words(1, 3)}</a>", f"<p>{self.junk(kind)}</p>"]) + (self.links() if rnd.random() < 0.4 else "")
        elif kind == "footer":
            body = rnd.choice([f"&copy; {self.words(1, 3)} &middot; {self.junk(kind)}", f"<p>{self.junk(kind)}</p>", self.links(), self.junk(kind)])
        elif kind == "aside":
            body = f"<h3>{self.words(1, 4)}</h3>" * (rnd.random() < 0.6) + rnd.choice([self.links(), f"<p>{self.junk(kind)}</p>" * rnd.randint(1, 3), self.junk(kind)])
        elif kind == "comments":
            body = f"<h3>{rnd.choice(['Comments', 'Replies', self.words(1, 3)])}</h3>" * (rnd.random() < 0.6)
            inner = rnd.choice(["div", "li", "p"])
            body += "".join(f"<{inner}>" + f"<b>{self.words(1, 2)}</b> " * (rnd.random() < 0.4) + f"{self.prose(rnd.randint(1, 4))}</{inner}>" for _ in range(rnd.randint(1, 6)))
        elif kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.junk(kind)}</p><button>{self.words(1, 2)}</button>"
        else:
            body = rnd.choice([self.junk(kind), f"<p>{self.junk(kind)}</p>", f"<p>{self.junk(kind)}</p><a href=#>{self.words(1, 2)}</a>"])
        return self.deep(f"<{tag}{attrs}>{self.deep(body)}</{tag}>") + rnd.choice(["", "\n"])

    def page(self) -> str:
        rnd = self.rnd
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if rnd.random() < 0.45]
        after = [k for k in ("aside", "comments", "ad", "nav", "footer", "notice", "form") if rnd.random() < 0.45]
        rnd.shuffle(before)
        # some pages have a table for columns, some put the text straight into the body, some write divs for paragraphs
        self.cells, para = rnd.random() < 0.08, rnd.choice(["p"] * 7 + ["div"])
        out = ["<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style></head><body>" if rnd.random() < 0.8 else ""]
        out += [self.furniture(k) if rnd.random() < 0.85 else self.unnamed() for k in before]
        tag = "td" if self.cells else rnd.choice(["article", "article", "article", "main", "div", "div", "section", "body"])
        attrs = f' class="{self.named(rnd.choice(_LABELS["main"]))}"' if tag in ("div", "section", "td") or rnd.random() < 0.3 else ""
        body = []
        if rnd.random() < 0.85:
            body.append(self.say(rnd.choice(["h1", "h1", "h2"]), self.words(2, 9).capitalize(), 1.0))
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            kind = rnd.random()
            if kind < 0.68:
                body.append(self.say(para, self.prose(rnd.choice([1, 1, 2, 4, 8])) if rnd.random() < 0.85 else self.sentence(1, 3)))
            elif kind < 0.76:
                body.append(self.say(rnd.choice(["h2", "h3"]), self.words(1, 6).capitalize(), 1.0))
            elif kind < 0.84:
                body.append("<ul>" + "".join(self.say("li", self.sentence(2, 12)) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                body.append("<blockquote>" + self.say("p", self.prose(2), 1.0) + "</blockquote>")
            elif kind < 0.94:
                body.append("<table><tr>" + "".join(self.say("td", self.words(1, 4), 1.0) for _ in range(3)) + "</tr></table>")
            else:
                body.append(self.furniture(rnd.choice(["ad", "aside", "notice", "ad", "form"])))
        if rnd.random() < 0.25:
            body.append(self.furniture("comments"))
        inner = self.deep("".join(body))
        wrapped = inner if tag == "body" else self.deep(f"<{tag}{attrs}>{inner}</{tag}>") if tag != "td" else f"<{tag}{attrs}>{inner}</{tag}>"
        if rnd.random() < 0.4 and tag not in ("td", "body"):
            wrapped = f"<{rnd.choice(['div', 'main', 'div'])}{attrs if rnd.random() < 0.5 else ''}>{wrapped}</div>"
        if self.cells:
            out, wrapped = [out[0], "<table><tr>", *out[1:]], wrapped + rnd.choice(["</tr></table>", "</tr><tr>"])
        out += [wrapped, *(self.furniture(k) if rnd.random() < 0.85 else self.unnamed() for k in after), "</body></html>"]
        return "".join(out)


def training_page(rnd: random.Random) -> tuple[list[Block], np.ndarray]:
    """A page's blocks and whether each is main text. Blocks that mix both don't arise: each has its own tag."""
    writer = _Writer(rnd)
    blocks = leaf_blocks(writer.page())
    wanted, k = np.zeros(len(blocks), np.float32), 0
    for i, b in enumerate(blocks):
        if k < len(writer.main) and b.text == writer.main[k]:
            wanted[i], k = 1, k + 1
    return blocks, wanted


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The network after training on `pages` written pages; Adam, the same weights for the same arguments."""
    rnd = random.Random(seed)
    samples = [training_page(rnd) for _ in range(pages)]
    samples = sorted(((features(b), y) for b, y in samples if len(b)), key=lambda s: len(s[0]))
    batches = [samples[k : k + 30] for k in range(0, len(samples), 30)]
    net = Labeller.fresh(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rnd.shuffle(batches)
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for batch in batches:
            x, live = _padded([s[0] for s in batch])
            wanted = np.zeros(live.shape, np.float32)
            for k, (_, y) in enumerate(batch):
                wanted[: len(y), k] = y
            _, grads = net.gradients(x, live, wanted)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def kept(spark: SparkSession, folder: str) -> Labeller:
    """The trained network, read from `folder` if one with these settings and this code was written there, else trained and written."""
    with open(__file__, "rb") as f:
        code = zlib.crc32(f.read())
    path = f"{folder.rstrip('/')}/blocks-{TRAIN_PAGES}-{EPOCHS}-{SEED}-{code:08x}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        found = spark.read.parquet(path).collect()
        return Labeller({r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in found})
    net = trained()
    rows = [(k, list(v.shape), bytearray(np.ascontiguousarray(v, np.float32).tobytes())) for k, v in net.w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


# --- the operator -------------------------------------------------------------------------------------------

_SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_main int"
#: Characters of html whose blocks are held at a time; a block counts as BLOCK_CHARS at least.
STEP_CHARS, BLOCK_CHARS = 1 << 21, 128


def _extract(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(shared.value)
        for batch in batches:
            texts, counts, mains = [], [], []
            held: list[list[Block]] = []
            size = 0

            def settle() -> None:
                for blocks, p in zip(held, net.chances([features(b) for b in held])):
                    main = [b.text for b, x in zip(blocks, p) if x >= 0.5]
                    texts.append("\n".join(main))
                    counts.append(len(blocks))
                    mains.append(len(main))
                held.clear()

            for page in batch.column("html"):
                raw = page.as_py() or ""
                held.append(leaf_blocks(raw))
                size += max(len(raw), BLOCK_CHARS * len(held[-1]))
                if size > STEP_CHARS:
                    settle()
                    size = 0
            settle()
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32()), pa.array(mains, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
            )

    return extract


def extract_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: str | None = None
) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main. weights: a folder in which the trained network is kept for other runs."""
    slim = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    net = trained() if weights is None else kept(df.sparkSession, weights)
    return slim.mapInArrow(_extract(df.sparkSession.sparkContext.broadcast(net.w)), _SCHEMA)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), weights=f"{shared_dir(spark)}/sightline-models")
