"""Seeded labelled pages, from which the extraction model is trained.

Pages are put together from layouts as publishers use them: semantic elements, div soup with telling class names, tables,
bare markup, prose that lies in the body itself, and pages that are nothing but a text. Every element carries data-y="1" where it belongs to the article and data-y="0" where it doesn't.
"""

from __future__ import annotations

import random

# Class and id names of page parts.
ARTICLE = ["article", "post", "entry", "story", "content", "main", "main-content", "post-content", "entry-content", "article-body", "story-body", "body-text", "text", "article__content", "page-content", "blog-post", "single", "hentry", "articleBody", "post-body"]
PARTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "nav-links", "site-nav", "tabs", "pagination", "pager", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "top", "branding", "logo", "banner", "page-header"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "credits", "colophon", "disclaimer"],
    "aside": ["sidebar", "widget", "related", "side", "aside", "rail", "recommended", "more-stories", "popular", "trending", "tags", "author-box", "secondary"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "adsense", "sponsor", "ad-container", "banner-ad", "commercial"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "subscription", "overlay", "paywall", "message"],
    "form": ["form", "login", "search", "search-form", "signup", "contact-form", "comment-form", "respond"],
    "comments": ["comments", "comment", "comment-list", "reader-comments", "comment-body", "replies", "reply", "disqus", "discussion", "responses", "user-comment"],
    "share": ["share", "social", "share-buttons", "social-links", "follow", "sharing", "meta", "byline-tools"],
}
NEUTRAL = ["wrapper", "container", "row", "col", "inner", "block", "section", "box", "grid", "clearfix", "main-wrap", "outer", "page"]
SYLLABLES = ["an", "be", "co", "den", "er", "fa", "ge", "hi", "in", "ka", "lo", "men", "no", "or", "pa", "re", "sta", "ti", "un", "ve", "wa", "zu", "é", "ö"]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r, self.unknown = random.Random(seed), False

    def words(self, low: int, high: int, stop: bool = True) -> str:
        words = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        out = []
        for i, w in enumerate(words):
            last = i == len(words) - 1
            out.append(w + (("." if stop else "") if last else self.r.choice(["", "", "", "", "", "", ",", ". "])))
        text = " ".join(out).strip().capitalize()
        if not stop or self.r.random() > 0.12:
            return text
        return self.r.choice([text.upper(), text.replace(".", "").replace(",", ""), " ".join(w + self.r.choice(["###", "!!", "$$$", "***"]) for w in text.split())])

    def el(self, tag: str, y: int, inner: str, names: list[str] | None = None, more: str = "") -> str:
        attrs = ""
        if names and self.unknown:  # a page whose names tell nothing
            names = ["".join(self.r.choices("bcdfghjkqrvwxz", k=self.r.randint(2, 4)))]
        if names and self.r.random() < 0.85:
            attrs = f' {self.r.choice(["class", "class", "id"])}="{" ".join(self.r.sample(names, min(len(names), self.r.choice([1, 1, 2]))))}"'
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        return f'<{tag}{attrs}{more} data-y="{y}">{inner}{close}'

    def link(self) -> str:
        return f'<a href="/x">{self.words(1, 4, False)}</a>'

    def part(self, kind: str, tags: list[str]) -> str:
        r, names = self.r, PARTS[kind]
        tag = r.choice(tags)
        links = self.el("ul", 0, "".join(self.el("li", 0, self.link()) for _ in range(r.randint(2, 9))))
        prose = lambda a, b: self.el("p", 0, self.words(a, b))
        if kind == "nav":
            inner = links if r.random() < 0.7 else " | ".join(self.link() for _ in range(r.randint(2, 8)))
        elif kind == "header":
            inner = self.el("h1" if r.random() < 0.4 else "div", 0, self.words(1, 5, False)) + (links if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice([f"&copy; site.example &middot; {self.words(3, 12)}", prose(4, 25) + links, links, prose(4, 20)])
        elif kind == "aside":
            inner = self.el("h3", 0, self.words(1, 3, False)) + r.choice([links, prose(8, 40), "".join(self.el("div", 0, self.link() + " " + self.words(3, 12)) for _ in range(3))])
        elif kind in ("ad", "notice"):
            inner = r.choice([self.words(3, 30), prose(4, 35), prose(4, 20) + self.link(), self.el("span", 0, self.words(3, 15)) + self.el("button", 0, self.words(1, 2, False))])
        elif kind == "form":
            return self.el("form", 0, self.el("label", 0, self.words(1, 4, False)) + '<input name="q">' + r.choice(["", prose(3, 20), f"<textarea>{self.words(1, 5)}</textarea>"]) + self.el("button", 0, self.words(1, 2, False)), names)
        elif kind == "comments":
            one = lambda: self.el(r.choice(["div", "li"]), 0, self.el("span", 0, self.words(1, 2, False)) + prose(4, 60), PARTS["comments"])
            inner = self.el("h3", 0, self.words(1, 3, False)) + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inner = " ".join(self.link() for _ in range(r.randint(2, 5)))
        return self.el(tag, 0, inner, names)

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.72:
            text = self.words(*r.choice([(1, 8), (10, 60), (10, 60), (40, 120)]))
            if r.random() < 0.25:
                text = f"<b>{text}<br>" if r.random() < 0.3 else f"{text} {self.link()} {self.words(3, 25)}"
            return self.el("p", 1, text)
        if x < 0.80:
            return self.el(r.choice(["h2", "h3"]), 1, self.words(1, 8, False))
        if x < 0.86:
            return self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.words(2, 30)) for _ in range(r.randint(2, 6))))
        if x < 0.90:
            return self.el("blockquote", 1, self.el("p", 1, self.words(5, 50)))
        if x < 0.93:
            return self.el("table", 1, "".join(self.el("tr", 1, self.el("td", 1, self.words(1, 5, False)) * 2) for _ in range(3)))
        if x < 0.96:
            return self.el("div", 1, self.words(8, 80))
        return self.el("pre", 1, self.words(5, 30))

    def article(self, bare: bool) -> str:
        r = self.r
        blocks = [self.el("h1", 1, self.words(2, 10, False))] if r.random() < 0.85 else []
        terse = r.random() < 0.15
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            blocks.append(self.el("p", 1, self.words(1, 4)) if terse else self.block())
            if r.random() < 0.08:
                blocks.append(self.part(r.choice(["ad", "share", "notice", "aside", "form"]), ["div", "aside"]))
            if r.random() < 0.05:  # parts that only their element tells
                blocks.append(self.el("aside", 0, r.choice([f"{self.words(1, 3, False)}: {self.link()}", self.el("p", 0, self.words(4, 30)), self.words(2, 20)])))
            if r.random() < 0.03:
                blocks.append(self.el("form", 0, self.el("p", 0, self.words(2, 14)) + r.choice(["", '<input name="q">'])))
        if r.random() < 0.2:
            blocks.append(self.part("comments", ["section", "div"]))
        if r.random() < 0.15:
            blocks.append(self.el("footer", 0, r.choice([f"{self.words(1, 1, False)}: {self.words(1, 4, False)}", self.link(), self.el("p", 0, self.words(3, 20))])))
        if r.random() < 0.3:
            blocks = [self.el(r.choice(["div", "section"]), 1, "".join(blocks), ARTICLE)]
        if r.random() < 0.12:
            return "".join(blocks)
        tag = r.choice(["article", "main", "div", "div", "section"]) if not bare else r.choice(["article", "article", "main"])
        names = None if bare else ARTICLE
        return self.el(tag, 1, "".join(blocks), names, ' role="main"' if r.random() < 0.1 else "")

    def loose(self) -> tuple[str, int]:
        """An article that no element of its own holds: paragraphs, bare divs, or prose right in the body (then y is 1)."""
        r = self.r
        kind = r.choice(["p", "p", "body", "body", "body", "div", "table"])
        texts = [self.words(*r.choice([(2, 12), (20, 90), (20, 90), (60, 200)])) for _ in range(r.choice([1, 1, 1, 2, 4, 8]))]
        if kind == "body":
            return r.choice(["<br><br>", "\n", "<br>"]).join(texts), 1
        if kind == "table":
            return self.el("table", 1, "".join(self.el("tr", 1, self.el("td", 1, x)) for x in texts)), 0
        head = self.el("h1", 1, self.words(2, 10, False)) if r.random() < 0.4 else ""
        inner = head + "".join(self.el(kind, 1, x) for x in texts)
        for _ in range(r.choice([0, 1, 2, 4]) if kind == "div" else 0):
            inner = self.el("div", 1, inner)
        return inner, 0

    def page(self) -> str:
        x = self.r.random()
        if x < 0.22:
            return self.plain_page()
        if x < 0.34:
            return self.nameless_page()
        return self.full_page()

    def nameless_page(self) -> str:
        """One or a few paragraphs in divs, beside lists of links, with names that tell nothing; at times laid out in a table."""
        r = self.r
        self.unknown, holder, names = True, r.choice(["div", "div", "div", "section"]), NEUTRAL
        text = "".join(self.el("p", 1, self.words(*r.choice([(4, 14), (10, 40), (30, 90)]))) for _ in range(r.choice([1, 1, 1, 2, 4])))
        links = lambda: self.el("div", 0, r.choice([" ", " | ", ""]).join(self.link() for _ in range(r.randint(2, 8))), names)
        if r.random() < 0.25:
            cells = [self.el("td", 1, text)] + [self.el("td", 0, "<br>".join(self.link() for _ in range(r.randint(2, 6)))) for _ in range(r.randint(1, 2))]
            r.shuffle(cells)
            body = self.el("table", 1, self.el("tr", 1, "".join(cells)))
        else:
            body = links() * (r.random() < 0.5) + self.el(holder, 1, text, names) + links() * (r.random() < 0.6)
        self.unknown = r.random() < 0.7
        if r.random() < 0.6:
            body = f'<div id="{r.choice(NEUTRAL)}" data-y="{r.choice([0, 1])}">{body}</div>'
        self.unknown = False
        return f'<html><head><title>{self.words(2, 8)}</title></head><body data-y="0">{body}</body></html>'

    def plain_page(self) -> str:
        """A loose article alone, or between bare parts; at times without html or body tags."""
        r = self.r
        body, y = self.loose()
        if r.random() < 0.45:
            body = self.part("nav", ["nav", "div"]) * (r.random() < 0.8) + body + self.part("footer", ["footer", "div"]) * (r.random() < 0.8)
        elif r.random() < 0.2:
            body = self.el("ul", 0, "".join(self.el("li", 0, self.link()) for _ in range(r.randint(2, 9)))) + body
        if y == 0 and r.random() < 0.1:
            body += self.words(1, 4, False)  # a stray word beside the blocks
        return f'<html><head><title>{self.words(2, 8)}</title></head><body data-y="{y}">{body}</body></html>'

    def full_page(self) -> str:
        r, bare = self.r, self.r.random() < 0.35
        plain = ["div"]
        before = [k for k, p in (("header", 0.6), ("nav", 0.75), ("notice", 0.35), ("ad", 0.5), ("form", 0.2), ("aside", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.3), ("comments", 0.4), ("aside", 0.45), ("ad", 0.3), ("notice", 0.25), ("form", 0.2), ("footer", 0.85)) if r.random() < p]
        if r.random() < 0.1:
            before, after = [], []
        tags = {"nav": ["nav", "nav", *plain], "header": ["header", *plain], "footer": ["footer", "footer", *plain], "aside": ["aside", *plain], "comments": ["section", *plain]}
        r.shuffle(before)
        body = "".join(self.part(k, tags.get(k, plain)) for k in before) + self.article(bare) + "".join(self.part(k, tags.get(k, plain)) for k in after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.el("div", 0, body, NEUTRAL)
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body data-y="0">{body}</body></html>'


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
