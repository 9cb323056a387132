"""Labelled pages that the extraction model is trained on: invented words in many page layouts."""

from __future__ import annotations

import random

#: Layout vocabulary: the names that page authors give to what is, and is not, the article.
MAIN = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "page-content", "text", "body-text", "entry"]
SHELL = ["wrapper", "container", "page", "row", "col-8", "inner", "layout", "site", "box", ""]
SIDE = {
    "menu": ["nav", "menu", "main-menu", "navbar", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "navigation", "site-nav", "pagination", "skip"],
    "head": ["header", "masthead", "topbar", "site-header", "branding", "logo"],
    "foot": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "side": ["sidebar", "aside", "related", "widget", "recommended", "popular", "tags", "share", "social", "toc", "archive", "author-box"],
    "notice": ["cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "banner", "cookie-banner"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adbox", "banner-ad"],
    "comment": ["comments", "comment", "comment-list", "replies", "discussion", "respond", "reader-comments", "comment-section"],
    "form": ["login", "search-form", "signup", "contact-form", "search"],
}


class _Writer:
    """Collects markup and, block by block, whether it belongs to the article."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.lexicon = ["".join(rng.choice(["en", "ra", "to", "li", "sch", "é", "ba", "ño", "um", "ist", "re", "ng"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.lexicon, k=self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.rng.choice([".", ".", ".", "!", "?"]) for _ in range(self.rng.randint(low, high)))

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        end = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        self.html.append(f"<{tag}{attributes}>{text}{end}")
        self.labels.append(label)

    def links(self, low: int, high: int, tag: str = "li") -> None:
        for _ in range(self.rng.randint(low, high)):
            self.block(tag, f'<a href="/x">{self.words(1, 4)}</a>', 0)

    def open(self, tag: str, names: list[str] | None = None, chance: float = 1.0) -> str:
        name = self.rng.choice(names) if names and self.rng.random() < chance else ""
        self.html.append(f'<{tag} {self.rng.choice(["class", "id"])}="{name}">' if name else f"<{tag}>")
        return f"</{tag}>"


def _aside(w: _Writer, kind: str) -> None:
    """One part of the page outside the article."""
    rng = w.rng
    tags = {"menu": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"],
            "notice": ["div", "section", "p"], "ad": ["div", "aside", "section"], "comment": ["section", "div", "ol", "ul"], "form": ["form", "form", "div"]}[kind]
    tag = rng.choice(tags)
    telling = tag in ("nav", "header", "footer", "aside", "form")
    end = w.open(tag, SIDE[kind], 0.4 if telling else 1.0)
    if kind == "menu":
        if tag == "ul":
            w.links(2, 8)
        elif rng.random() < 0.7:
            w.html.append("<ul>")
            w.links(2, 8)
            w.html.append("</ul>")
        else:
            w.block("div", " | ".join(f'<a href="/">{w.words(1, 2)}</a>' for _ in range(rng.randint(2, 6))), 0)
    elif kind == "head":
        w.block(rng.choice(["div", "p", "h1", "h2"]), rng.choice([w.words(1, 5), f'<a href="/">{w.words(1, 3)}</a>', w.sentences(1, 1)]), 0)
    elif kind == "foot":
        for _ in range(rng.randint(1, 3)):
            w.block(rng.choice(["div", "p"]), rng.choice([f"&copy; 2024 {w.words(1, 4)}", w.sentences(1, 2), f'<a href="/">{w.words(1, 3)}</a>', f"{w.words(1, 2)}.example.com &middot; {w.words(2, 8)}"]), 0)
    elif kind == "comment":
        if rng.random() < 0.5:
            w.block("li" if tag in ("ol", "ul") else rng.choice(["h2", "h3"]), rng.choice([f"{rng.randint(2, 40)} {w.words(1, 1)}", w.words(1, 2)]), 0)
        for _ in range(rng.randint(1, 6)):
            inner = w.open("li" if tag in ("ol", "ul") else rng.choice(["div", "article", "div"]), ["comment", "reply", "comment-body"], 0.6)
            if rng.random() < 0.5:
                w.block("div", rng.choice([w.words(1, 2), f'<a href="/u">{w.words(1, 2)}</a>']), 0)
            for _ in range(rng.randint(1, 3)):
                w.block("p", w.sentences(1, 5), 0)
            w.html.append(inner)
    elif kind == "form":
        for _ in range(rng.randint(1, 3)):
            w.block(rng.choice(["p", "div"]), rng.choice([w.words(1, 4), w.sentences(1, 1)]) + '<input name="q">', 0)
    elif kind in ("ad", "notice") and tag == "p":
        w.html.pop()
        w.block("p", w.sentences(1, 2), 0, f' class="{rng.choice(SIDE[kind])}"')
        return
    else:
        if rng.random() < 0.4:
            w.block(rng.choice(["h2", "h3", "h4"]), w.words(1, 4), 0)
        if kind == "side" and rng.random() < 0.6:
            w.html.append("<ul>")
            w.links(2, 6)
            w.html.append("</ul>")
        else:
            for _ in range(rng.randint(1, 3)):
                w.block(rng.choice(["p", "p", "div"]), rng.choice([w.sentences(1, 4), w.words(2, 8), w.sentences(1, 1)]), 0)
    w.html.append(end)


def _article(w: _Writer) -> None:
    rng = w.rng
    ends = []
    if rng.random() < 0.3:
        ends.append(w.open("main", MAIN, 0.3))
    if rng.random() < 0.65:
        ends.append(w.open("article", MAIN, 0.3))
    elif not ends or rng.random() < 0.5:
        ends.append(w.open(rng.choice(["div", "section", "div"]), MAIN, 0.95))
    if rng.random() < 0.3:
        ends.append(w.open("div", MAIN + SHELL, 0.8))
    if rng.random() < 0.85:
        heading = rng.choice(["h1", "h1", "h2"])
        if rng.random() < 0.15:
            w.html.append("<header>")
            w.block(heading, w.words(2, 12), 1)
            w.html.append("</header>")
        else:
            w.block(heading, w.words(2, 12).capitalize(), 1)
    for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
        kind = rng.random()
        if kind < 0.72:
            text = rng.choice([w.sentences(1, 7), w.sentences(1, 2), w.words(1, 6).capitalize() + ".", w.sentences(2, 3) + f' <a href="/y">{w.words(1, 3)}</a> ' + w.sentences(1, 2)])
            w.block("p", rng.choice(["{}", "{}", "<b>{}</b>", "<b>{}<br>", "{} <em>" + w.words(1, 2) + "</em>"]).format(text), 1)
        elif kind < 0.8:
            w.block(rng.choice(["h2", "h3"]), w.words(1, 8), 1)
        elif kind < 0.87:
            w.html.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                w.block("li", rng.choice([w.words(2, 8), w.sentences(1, 2)]), 1)
            w.html.append("</ul>")
        elif kind < 0.91:
            w.html.append("<blockquote>")
            w.block("p", w.sentences(1, 3), 1)
            w.html.append("</blockquote>")
        elif kind < 0.94:
            w.html.append("<table><tr>")
            for _ in range(rng.randint(2, 4)):
                w.block("td", w.words(1, 4), 1)
            w.html.append("</tr></table>")
        elif kind < 0.96:
            w.block("pre", w.words(3, 20), 1)
        else:
            _aside(w, rng.choice(["ad", "side", "notice", "menu", "form", "ad"]))
    if rng.random() < 0.12:
        _aside(w, rng.choice(["comment", "side", "foot", "menu"]))
    w.html += reversed(ends)


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """``n`` pages and, for every block in order, 1 if it belongs to the article, else 0."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        w = _Writer(rng)
        w.html.append(f"<!DOCTYPE html><html><head><title>{w.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        ends = [w.open("div", SHELL) for _ in range(rng.choice([0, 0, 1, 2]))]
        for kind, chance in (("notice", 0.25), ("head", 0.5), ("menu", 0.75), ("form", 0.2), ("ad", 0.4), ("side", 0.2)):
            if rng.random() < chance:
                _aside(w, kind)
        _article(w)
        for kind, chance in (("ad", 0.25), ("comment", 0.45), ("side", 0.4), ("form", 0.2), ("notice", 0.2), ("menu", 0.1), ("foot", 0.8)):
            if rng.random() < chance:
                _aside(w, kind)
        pages.append(("".join(w.html + ends[::-1]) + "</body></html>", w.labels))
    return pages


def embedding_pages(n: int, seed: int = 6) -> list[tuple[str, list[int]]]:
    """As ``labelled_pages``, with formulas, drawings and fallback text in the article, buttons and lists of choices around it."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        w = _Writer(rng)
        w.html.append("<!DOCTYPE html><html><body>")
        for kind in ("head", "menu"):
            if rng.random() < 0.6:
                _aside(w, kind)
        end = w.open(*rng.choice([("article",), ("div", MAIN), ("main",)]))
        w.block("h1", w.words(2, 8).capitalize(), 1)
        for _ in range(rng.randint(2, 7)):
            tag, kind = rng.choice(["math", "svg", "object", "canvas", "audio", "video", "noscript", "map"]), rng.random()
            if kind < 0.5:
                w.block("p", f"{w.sentences(1, 3)} <{tag}>{w.words(1, 4)}</{tag}> {w.sentences(1, 2)}", 1)
            elif kind < 0.7:
                w.block(rng.choice(["p", "div", "figure"]), f"<{tag}>{w.sentences(1, 2)}</{tag}>", 1)
            elif kind < 0.85:
                w.block("p", w.sentences(1, 4), 1)
            else:
                w.block("div", f"<button>{w.words(1, 3)}</button>" * rng.randint(1, 3), 0)
        w.html.append(end + "<form>")
        w.block("p", f"{w.words(1, 2)}<select><option>{w.words(1, 2)}<option>{w.words(1, 2)}</select>", 0)
        w.block("div", f"<button>{w.words(1, 2)}</button>", 0)
        w.html.append("</form>")
        if rng.random() < 0.7:
            _aside(w, "foot")
        pages.append(("".join(w.html) + "</body></html>", w.labels))
    return pages
