"""Annotated page layouts: the labelled examples from which the extractor learns.

No table holds labelled pages, so examples are written here: a small grammar draws layouts (what surrounds an article,
how its parts are tagged and named, how deep they are wrapped) around meaningless words, and marks every element with
whether it belongs to the article. ``LAYOUTS`` pages are drawn from a fixed seed.
"""

from __future__ import annotations

import random

LAYOUTS = 700
MARK = "data-mark"

# Names that pages give to their parts.
NAMES = {
    "content": "article content post entry story main body text post-content entry-content article-body story-body page-text",
    "nav": "nav menu navbar navigation main-menu top-nav breadcrumb breadcrumbs pagination pager tabs links toc",
    "header": "header masthead top topbar site-header branding logo banner-top page-header hero",
    "footer": "footer site-footer bottom foot copyright colophon legal credits",
    "sidebar": "sidebar aside widget rail right-col left-col related popular trending recommended more-stories side",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense ad-slot dfp commercial",
    "notice": "notice cookie cookies cookie-banner consent gdpr alert message warning disclaimer paywall popup modal overlay",
    "form": "form newsletter subscribe signup login search search-form contact-form subscription",
    "comment": "comment comments comment-list reader-comments responses discussion disqus replies reply thread feedback",
    "share": "share social social-share sharing follow buttons tools print",
}
_PLAIN = "wrap container row col inner box block section x1 c-8 grid unit outer group".split()
_SYLLABLES = "an er in on re th ti es or en at ed nd to it is ou ea hi ha de la que mo ver sch ung ción mente eau aux".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))

    def attributes(self, kind: str | None, chance: float = 0.85) -> str:
        names = []
        if kind and self.r.random() < chance:
            names.append(self.r.choice(NAMES[kind].split()))
        if self.r.random() < 0.3:
            names.insert(self.r.randint(0, len(names)), self.r.choice(_PLAIN))
        if not names:
            return ""
        return f' {self.r.choice(["class", "class", "class", "id"])}="{" ".join(names)}"'

    def tag(self, name: str, inside: str, main: bool, attributes: str = "") -> str:
        return f'<{name}{attributes} {MARK}="{int(main)}">{inside}</{name}>'

    def links(self, tag: str = "li", low: int = 2, high: int = 9) -> str:
        items = [self.tag(tag, f'<a href="/x">{self.words(1, 3)}</a>', False) for _ in range(self.r.randint(low, high))]
        return "".join(items)

    def wrapped(self, inside: str, main: bool) -> str:
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            inside = self.tag("div", inside, main, self.attributes(None))
        return inside

    # what surrounds an article

    def nav(self) -> str:
        shape, r = self.r.randint(0, 2), self.r
        inside = self.tag("ul", self.links(), False) if shape else "".join(f'<a href="/">{self.words(1, 2)}</a> ' for _ in range(r.randint(3, 9)))
        return self.tag(*r.choice([("nav", inside, False), ("div", inside, False, self.attributes("nav", 1)),
                                   ("ul", self.links(), False, self.attributes("nav", 1))]))

    def header(self) -> str:
        inside = self.tag(self.r.choice(["h1", "div", "p", "span"]), self.words(1, 5), False) + (self.nav() if self.r.random() < 0.5 else "")
        if self.r.random() < 0.3:
            inside += self.tag("p", self.sentences(1, 1), False)
        return self.tag(*self.r.choice([("header", inside, False, self.attributes("header")), ("div", inside, False, self.attributes("header", 1))]))

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.tag("p", self.sentences(1, 3), False),
                                self.tag("ul", self.links(), False) + self.tag("p", "&copy; " + self.words(2, 6), False)])
        return self.tag(*self.r.choice([("footer", inside, False, self.attributes("footer", 0.3)), ("div", inside, False, self.attributes("footer", 1))]))

    def sidebar(self) -> str:
        inside = self.tag(self.r.choice(["h2", "h3", "h4"]), self.words(1, 4), False) + self.r.choice(
            [self.tag("ul", self.links(), False), self.tag("p", self.sentences(1, 4), False),
             "".join(self.tag("p", self.sentences(1, 3), False) for _ in range(self.r.randint(1, 3)))])
        return self.tag(*self.r.choice([("aside", inside, False, self.attributes("sidebar", 0.5)), ("div", inside, False, self.attributes("sidebar", 1)),
                                        ("section", inside, False, self.attributes("sidebar", 1))]))

    def short(self, kind: str) -> str:
        text = self.sentences(1, 3)
        inside = self.r.choice([text, text, self.tag("p", text, False), self.tag("p", text, False) + f'<a href="/x">{self.words(1, 3)}</a>'])
        role = ' role="alert"' if kind == "notice" and self.r.random() < 0.2 else ""
        return self.tag(self.r.choice(["div", "div", "section", "aside", "p" if inside == text else "div"]), inside, False, self.attributes(kind, 1) + role)

    def form(self) -> str:
        inside = self.tag(self.r.choice(["p", "label", "h3", "div"]), self.words(2, 9), False) + '<input type="text">' + f"<button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.4:
            inside += self.tag("p", self.sentences(1, 2), False)
        body = self.tag("form", inside, False, self.attributes("form", 0.5))
        return body if self.r.random() < 0.6 else self.tag("div", body, False, self.attributes("form", 1))

    def comments(self) -> str:
        item, items = self.r.choice([("li", "ol"), ("li", "ul"), ("div", "div"), ("article", "div"), ("p", "div")]), []
        for _ in range(self.r.randint(1, 7)):
            text = self.sentences(1, 5)
            inside = text if item[0] == "p" else (self.tag("span", self.words(1, 2), False) if self.r.random() < 0.5 else "") + (
                self.tag("p", text, False) if self.r.random() < 0.7 else text)
            items.append(self.tag(item[0], inside, False, self.attributes("comment", 0.6)))
        inside = "".join(items) if self.r.random() < 0.5 else self.tag(item[1], "".join(items), False, self.attributes("comment", 0.5))
        if self.r.random() < 0.6:
            inside = self.tag(self.r.choice(["h2", "h3"]), self.words(1, 3), False) + inside
        return self.tag(self.r.choice(["section", "div", "div", "aside"]), inside, False, self.attributes("comment", 1))

    def around(self, kinds: str) -> str:
        return {"nav": self.nav, "header": self.header, "footer": self.footer, "sidebar": self.sidebar, "form": self.form,
                "comment": self.comments}.get(kinds, lambda: self.short(kinds))()

    # the article

    def part(self) -> str:
        shape = self.r.random()
        if shape < 0.68:
            text = self.sentences(1, 7) if self.r.random() < 0.85 else self.words(1, 8)
            if self.r.random() < 0.25:
                text += f' <a href="/x">{self.words(1, 4)}</a> ' + self.sentences(1, 1)
            return self.tag(self.r.choice(["p"] * 8 + ["div"]), self.r.choice(["", "", "<b>", ""]) + text, True)
        if shape < 0.8:
            return self.tag(self.r.choice(["h2", "h3"]), self.words(1, 7), True)
        if shape < 0.9:
            items = "".join(self.tag("li", self.sentences(1, 1) if self.r.random() < 0.7 else self.words(1, 4), True) for _ in range(self.r.randint(2, 6)))
            return self.tag(self.r.choice(["ul", "ol"]), items, True)
        if shape < 0.94:
            return self.tag("blockquote", self.tag("p", self.sentences(1, 3), True), True)
        if shape < 0.97:
            rows = "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 3), True) for _ in range(3)), True) for _ in range(self.r.randint(2, 5)))
            return self.tag("table", rows, True)
        return self.tag("pre", self.words(5, 30), True)

    def article(self) -> str:
        heading = self.tag("h1", self.words(2, 9), True) if self.r.random() < 0.85 else ""
        if heading and self.r.random() < 0.2:
            heading = self.tag("header", heading, True)
        parts = [self.part() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 13, 20]))]
        for kind in ("ad", "share", "notice", "sidebar", "form", "comment", "nav"):
            if self.r.random() < 0.12:
                at = len(parts) if kind in ("comment", "share", "form") and self.r.random() < 0.8 else self.r.randint(0, len(parts))
                parts.insert(at, self.around(kind))
        body = "".join(parts)
        if self.r.random() < 0.35:
            body = self.tag("div", body, True, self.attributes("content"))
        tag = self.r.choice(["article", "article", "main", "div", "div", "section"])
        return self.tag(tag, heading + body, True, self.attributes("content", 0.4 if tag in ("article", "main") else 0.9))

    def page(self) -> str:
        before = [k for k in ("header", "nav", "notice", "ad", "form", "sidebar") if self.r.random() < 0.4]
        after = [k for k in ("share", "comment", "sidebar", "ad", "form", "notice", "nav", "footer") if self.r.random() < 0.4]
        self.r.shuffle(before)
        main = self.wrapped(self.article(), True)
        body = "".join(map(self.around, before)) + main + "".join(map(self.around, after))
        if self.r.random() < 0.05:  # a page without an article
            body = "".join(map(self.around, before + after))
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def pages(count: int = LAYOUTS) -> list[str]:
    """Marked pages, the same ones each time."""
    return [_Writer(seed).page() for seed in range(count)]
