"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: text between block-level tags,
with the path of ancestors it stands under. Features are those ancestors' tags,
kinds of words in their class, id and role, and the block's own text (length,
link share, punctuation, telling words). The field is trained on labelled pages
written by ``labelled_page`` and decoded by Viterbi; blocks labelled 1 are the text.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

#: Labelled pages of the training set, and its passes.
PAGES, EPOCHS, SEED = 400, 8, 3

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Block tags whose start ends an open paragraph.
_ENDS_P = _BLOCK - {"button", "label", "option", "select"}
#: Elements whose content isn't shown: to their end tag, or to the page's end without one.
_RAW = frozenset("script style title textarea".split())
#: The same, but without an end tag they are ordinary elements and hide nothing.
_HIDDEN = frozenset("noscript template svg iframe".split())
#: Elements open at a time; deeper ones aren't opened, their content stays.
_DEPTH = 512
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Kinds of words in names of ancestors.
_KINDS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner|dfp",
    "menu": r"nav|menu|breadcrumb|tabs|pagination|pager|toc",
    "side": r"sidebar|\bside\b|widget|related|recommend|popular|trending|\brail\b|teaser|more-",
    "talk": r"comment|repl(y|ies)|discuss|disqus|feedback|reader|thread|responses",
    "foot": r"foot|copyright|legal|colophon|imprint",
    "head": r"masthead|site-?header|page-?header|topbar|logo|brand",
    "note": r"cookie|consent|notice|alert|gdpr|popup|modal|overlay|banner|warning|paywall|toast",
    "act": r"share|social|subscribe|newsletter|sign-?up|login|search|form|contact|poll|rating|tags?\b",
    "main": r"article|content|post\b|entry|story|body|main|text|prose|page-?text",
}
_KIND_RE = {k: re.compile(v, re.I) for k, v in _KINDS.items()}
#: Kinds of words in a block's text.
_SAYS = {
    "rights": r"©|\(c\) ?\d|copyright|all rights reserved",
    "cookie": r"\bcookies?\b|consent|privacy",
    "act": r"\b(subscribe|sign up|sign in|log ?in|newsletter|share this|follow us|read more|click here|search|submit|reply|e-?mail)\b",
    "ad": r"\b(advertisement|sponsored|promoted|buy now|% off)\b",
    "talk": r"\b(comments?|posted by|says:|wrote:|replied)\b",
}
_SAYS_RE = {k: re.compile(v, re.I) for k, v in _SAYS.items()}


@lru_cache(50_000)
def _kinds(attributes: str) -> tuple[str, ...]:
    names = " ".join(m.strip("\"'") for m in _NAMES.findall(attributes))
    return tuple(k for k, r in _KIND_RE.items() if r.search(names)) if names else ()


class _Scan:
    """Markup of a page in one forward pass: what was once sought in vain up to the end isn't sought again."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True
        self.gone: set[str] = set()

    def tags(self):
        """(start, stop, end tag or not, name, attributes) of each piece of markup; name is None where nothing but its absence counts."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            follows = page[at : at + 1]
            if page.startswith("<!--", start):
                stop = page.find("-->", at + 3)
                at = len(page) if stop < 0 else stop + 3
                yield start, at, False, None, ""
                continue
            if start > self.last:
                if (m := _NAME.match(page, start)) and m[1].lower() in _RAW and follows != "/":
                    yield start, len(page), False, None, ""
                return
            if follows in ("!", "?"):
                at = page.find(">", at) + 1
                yield start, at, False, None, ""
                continue
            if not (m := _NAME.match(page, start)):
                continue
            name, close = m[1].lower(), follows == "/"
            stop = self._end(m.end())
            attributes = page[m.end() : stop]
            at = stop + 1
            if not close and name in _RAW | _HIDDEN and not (name == "svg" and attributes.rstrip().endswith("/")):
                over = self._after(name, at)
                if over or name in _RAW:
                    at = over or len(page)
                    yield start, at, False, None, ""
                    continue
            yield start, at, close, name, attributes

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag. Quotes hide it, as long as the page's quotes leave any."""
        first = at
        while self.quoted:
            m = _STOP.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1 if m else 0
            self.quoted = at > 0
        return self.page.find(">", first)

    def _after(self, name: str, at: int) -> int:
        """Place after the end tag of an element whose content begins at ``at``, with those of its kind inside it; 0 without one."""
        if name in self.gone:
            return 0
        deep, nested, first = 1, name in _HIDDEN and f"{name}+" not in self.gone, 0
        for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(self.page, at):
            stop = self.page.find(">", m.end())
            if stop < 0:
                break
            if m[1]:
                first = first or stop + 1
                deep -= 1
            elif nested and self.page[stop - 1] != "/":
                deep += 1
            if deep == 0 or (first and not nested):
                return stop + 1
        self.gone.add(f"{name}+" if first else name)
        return first


def leaf_blocks(page: str | None) -> list[tuple[str, tuple, float]]:
    """(text, path, share of linked characters) of each leaf block; a path is (tag, kinds) from the root down.

    Time grows with the page, whatever its markup: broken tags are text, and quotes without end quote nothing.
    """
    out, stack, parts = [], [], []
    path, linked, at = None, 0, 0

    def flush():
        nonlocal path, linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((text, path or tuple(stack), min(1.0, linked / len(text))))
            parts.clear()
        path, linked = None, 0

    def add(raw):
        nonlocal path, linked
        parts.append(raw)
        if path is None and not raw.isspace():
            path = tuple(stack)
        if any(t == "a" for t, _ in stack):
            linked += len(raw.strip())

    page = page or ""
    for start, stop, close, name, attributes in _Scan(page).tags():
        if start > at:
            add(page[at:start])
        at = stop
        if name is None:
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCK
        if block:
            flush()
        if name in _VOID:
            continue
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if not block and stack[k][0] in _BLOCK:
                    break  # an inline end tag doesn't reach out of its block
            continue
        closes = _CLOSES.get(name, ())
        if closes or name in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t in closes or (t == "p" and name in _ENDS_P):
                    del stack[k:]
                    break
                if t in _BLOCK and t != "p":
                    break
        if not attributes.rstrip().endswith("/") and len(stack) < _DEPTH:
            stack.append((name, _kinds(attributes)))
    if at < len(page):
        add(page[at:])
    flush()
    return out


@lru_cache(50_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    found = {f"in:{t}" for t, _ in path if t not in ("html", "body")}
    found |= {f"kind:{k}" for _, kinds in path for k in kinds}
    blocks = [t for t, _ in path if t in _BLOCK]
    own = blocks[-1] if blocks else "none"
    found.add(f"own:{own}")
    found.add(f"under:{blocks[-2] if len(blocks) > 1 else 'none'}>{own}")
    return tuple(found)


def features(blocks: list[tuple[str, tuple, float]]) -> list[list[str]]:
    """Names of each block's features; all are 0 or 1."""
    out = []
    for i, (text, path, linked) in enumerate(blocks):
        f = [*_path_features(path), "bias"]
        words = text.count(" ") + 1
        f.append("words:" + str(min(6, words.bit_length())))
        f.append("links:" + ("all" if linked > 0.8 else "some" if linked > 0.3 else "few"))
        f.append("ends:" + ("stop" if text[-1] in ".!?\"'”»…:" else "open"))
        f.append("at:" + ("first" if i == 0 else "last" if i == len(blocks) - 1 else "mid"))
        f += [f"says:{k}" for k, r in _SAYS_RE.items() if r.search(text)]
        out.append(f)
    return out


class Field:
    """A two-label chain: ``weights`` of label 1 by feature, ``moves[a][b]`` between neighbours, ``start`` of label 1."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.start = 0.0

    def emissions(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        e = self.emissions(rows)
        if not e:
            return []
        (s00, s01), (s10, s11) = self.moves.tolist()
        zero, one = 0.0, self.start + e[0]
        back = []
        for x in e[1:]:
            z, o = (zero + s00, 0) if zero + s00 >= one + s10 else (one + s10, 1), (zero + s01, 0) if zero + s01 > one + s11 else (one + s11, 1)
            back.append((z[1], o[1]))
            zero, one = z[0], o[0] + x
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Stochastic gradient ascent on the conditional log-likelihood, steps scaled by each weight's past gradients."""
        rng = random.Random(SEED)
        past: dict = {}

        def step(key, g):
            past[key] = past.get(key, 1e-8) + g * g
            return rate * g / past[key] ** 0.5

        for _ in range(epochs):
            for i in rng.sample(range(len(pages)), len(pages)):
                rows, gold = pages[i]
                if not rows:
                    continue
                e = np.array(self.emissions(rows))
                n = len(e)
                ahead = np.zeros((n, 2))
                ahead[0, 1] = self.start + e[0]
                for t in range(1, n):
                    ahead[t] = np.logaddexp(ahead[t - 1, 0] + self.moves[0], ahead[t - 1, 1] + self.moves[1])
                    ahead[t, 1] += e[t]
                after = np.zeros((n, 2))
                for t in range(n - 2, -1, -1):
                    nxt = after[t + 1] + np.array([0, e[t + 1]])
                    after[t] = np.logaddexp(self.moves[:, 0] + nxt[0], self.moves[:, 1] + nxt[1])
                whole = np.logaddexp(*ahead[-1])
                p = np.exp(ahead[:, 1] + after[:, 1] - whole)
                y = np.array(gold)
                for row, g in zip(rows, y - p, strict=True):
                    if abs(g) > 1e-4:
                        for f in row:
                            w = self.weights.get(f, 0.0)
                            self.weights[f] = w + step(f, g - decay * w)
                self.start += step("start", y[0] - p[0])
                want = np.zeros((2, 2))
                for t in range(1, n):
                    want[gold[t - 1], gold[t]] += 1
                    both = ahead[t - 1][:, None] + self.moves + np.array([0, e[t]]) + after[t] - whole
                    want -= np.exp(both)
                for a in (0, 1):
                    for b in (0, 1):
                        self.moves[a, b] += step((a, b), want[a, b] - decay * self.moves[a, b])


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks.

    Layouts vary in what wraps the article, in how its furniture is named and in
    whether furniture stands beside the article or inside it.
    """
    made = iter(range(10**6))

    def prose(low, high):
        words = ["".join(rng.choice("aeioubcdlmnprstvz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        return f"{' '.join(words).capitalize()} x{next(made)}{rng.choice(['.', '.', '.', '', '?'])}"

    main: set[str] = set()

    def text(low=1, high=60):
        t = prose(low, high)
        main.add(t)
        return t

    def links(n):
        return [f'<a href="/{k}">{prose(1, 3)}</a>' for k in range(n)]

    def named(tag, names, body):
        attr = rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} x{rng.randint(1, 9)}"']) if names else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def menu():
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in links(rng.randint(3, 8))) + "</ul>"
        return rng.choice([f"<nav>{body}</nav>", named("div", ["menu", "navbar", "main-nav", "breadcrumb"], body)])

    def header():
        inner = rng.choice([f"<h1>{prose(1, 3)}</h1>", f"<p>{prose(2, 6)}</p>", f"<a href='/'>{prose(1, 2)}</a>"])
        return rng.choice([f"<header>{inner}{rng.choice(['', menu()])}</header>", named("div", ["masthead", "site-header", "topbar"], inner)])

    def advert():
        return named(rng.choice(["div", "aside", "section", "p"]), ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"], rng.choice([prose(3, 25), f"<p>{prose(3, 25)}</p>"]))

    def sidebar():
        body = f"<h3>{prose(1, 4)}</h3>" + rng.choice([f"<p>{prose(5, 40)}</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in links(4)) + "</ul>"])
        return rng.choice([f"<aside>{body}</aside>", named("div", ["sidebar", "related", "widget", "recommended"], body)])

    def notice():
        return named(rng.choice(["div", "section", "p"]), ["cookie-banner", "notice", "consent", "alert", "gdpr-popup"], rng.choice(["", "We use cookies. "]) + prose(4, 25) + rng.choice(["", f"<button>{prose(1, 2)}</button>"]))

    def form():
        return rng.choice(["<form>", '<form class="newsletter">', '<form id="search">']) + f"<label>{prose(1, 4)}</label><input type='text'>" + rng.choice([f"<p>{prose(3, 15)}</p>", ""]) + f"<button>{prose(1, 2)}</button></form>"

    def comments():
        body = f"<h3>{rng.choice(['Comments', prose(1, 3)])}</h3>" + "".join(named(rng.choice(["div", "li", "article"]), ["comment", "reply", "comment-body"], f"<p>{prose(3, 50)}</p>") for _ in range(rng.randint(1, 5)))
        return named(rng.choice(["section", "div", "ol"]), ["comments", "reader-comments", "discussion", "responses"], body)

    def footer():
        body = rng.choice(["&copy; ", "Copyright ", ""]) + prose(2, 15)
        return rng.choice([f"<footer>{body}</footer>", f"<footer><p>{body}</p></footer>", named("div", ["footer", "site-footer", "legal"], body)])

    furniture = [menu, header, advert, sidebar, notice, form]

    def article():
        out = [f"<h1>{text(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 14)):
            out.append(
                rng.choice(
                    [lambda: f"<p>{text()}</p>"] * 9
                    + [
                        lambda: f"<h2>{text(1, 6)}</h2>",
                        lambda: f"<p><b>{text(1, 10)}<br>",
                        lambda: "<ul>" + "".join(f"<li>{text(1, 15)}</li>" for _ in range(3)) + "</ul>",
                        lambda: f"<blockquote><p>{text(3, 30)}</p></blockquote>",
                        lambda: f"<div>{text(5, 60)}</div>",
                        lambda: f"<pre>{text(2, 20)}</pre>",
                        lambda: f"<table><tr><td>{text(1, 4)}</td><td>{text(1, 4)}</td></tr></table>",
                    ]
                )()
            )
            if rng.random() < 0.06:
                out.append(rng.choice([advert, form, sidebar, notice])())
        if rng.random() < 0.15:
            out.append(comments())
        return "".join(out)

    wrap = rng.choice(["<article>%s</article>"] * 4 + ["<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<div id="story">%s</div>', '<div class="post-body">%s</div>', '<section class="entry">%s</section>', '<div role="main">%s</div>', "<div>%s</div>"])
    before = "".join(f() for f in rng.sample(furniture, rng.randint(1, 4)))
    after = "".join(f() for f in rng.sample([sidebar, advert, form, notice, comments, menu], rng.randint(0, 3))) + (footer() if rng.random() < 0.9 else "")
    page = f"<!DOCTYPE html><html><head><title>{prose(1, 8)}</title></head><body>{before}{wrap % article()}{after}"
    return page + rng.choice(["</body></html>", ""]), main


def train(pages: int = PAGES, seed: int = SEED) -> Field:
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        page, main = labelled_page(rng)
        blocks = leaf_blocks(page)
        rows.append((features(blocks), [int(b[0] in main) for b in blocks]))
    field = Field()
    field.train(rows)
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(blocks, field.viterbi(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: page_id, the carried columns, text, n_chars (code points).

    Null and empty pages, and pages without main blocks, have empty text. Rows that repeat an id are pages of their own; a null id stays null.
    Pages are read whole, in time that grows with their length. A table without rows gives none. Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), *[F.col(f"`{c}`") for c in carry], F.col(html_col).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    at = len(carry) + 1

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 200):
                piece = batch.slice(a, 200)
                text = [main_text(h, field) for h in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:at], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*piece.schema.names[:at], "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), train())
