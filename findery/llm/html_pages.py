"""Labelled pages for the extractor: random layouts of random words, every block marked main text or not.

Words are drawn at random for main text and for everything around it, so a model
can only learn from structure. ``data-mark`` carries the label; the parser
reads it into ``Node.mark`` and no feature uses it.
"""

from __future__ import annotations

import html
import random

#: Names that sites give to the parts of a page.
MAIN = ["content", "post-content", "entry-content", "article-body", "story", "main", "post", "page-content", "text", "markdown-body"]
MENU = ["nav", "menu", "navbar", "main-menu", "top-nav", "navigation", "site-nav", "tabs"]
CRUMBS = ["breadcrumb", "breadcrumbs", "crumbs-nav"]
SIDE = ["sidebar", "side", "right-rail", "widget", "widgets", "secondary", "rightcol"]
FOOT = ["footer", "foot", "colophon", "site-footer", "copyright", "legal"]
HEAD = ["header", "masthead", "site-header", "top", "branding", "logo"]
AD = ["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot"]
NOTICE = ["cookie-notice", "notice", "alert", "gdpr-consent", "popup", "announcement", "cookie-banner"]
COMMENTS = ["comments", "comment-list", "commentlist", "disqus-thread", "discussion", "reader-comments", "responses comments"]
SHARE = ["share", "social", "sharing", "share-buttons"]
RELATED = ["related", "related-posts", "recommended", "more-links"]
NEUTRAL = ["wrap", "container", "row", "col", "outer", "inner", "x1", "box", "grid", "layout", "c-12", "wrapper"]
SYLLABLES = "ta re mi on the an er ing ou ei schö é ña tion ble wor ki lu za pe".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.08:
            out = [w + self.r.choice(["%%%", "$$$", "&", "***"]) for w in out]
        return html.escape(" ".join(out))

    def sentences(self, low: int, high: int) -> str:
        made = []
        for _ in range(self.r.randint(low, high)):
            made.append(self.words(1, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"]))
        return " ".join(made)

    def open(self, tag: str, names: list[str] | None = None, mark: int | None = None) -> str:
        out = "<" + tag
        if names and self.r.random() < 0.9:
            out += f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        return out + (f' data-mark="{mark}"' if mark is not None else "") + ">"

    def links(self, low: int, high: int, tag: str = "ul") -> str:
        names = [self.words(1, self.r.choice([1, 1, 3])) for _ in range(self.r.randint(low, high))]
        names = [n.capitalize() if self.r.random() < 0.4 else n for n in names]
        ends = self.r.choice([[""], ["", "", ".", ","], [".", ","]])
        items = [f'<a href="/{self.word()}">{n}{self.r.choice(ends)}</a>' for n in names]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; ", " / "]).join(items)

    def paragraph(self) -> str:
        kind = self.r.random()
        text = self.words(1, 2) + "." if kind < 0.12 else self.sentences(1, 2) if kind < 0.4 else self.sentences(2, 9)
        if self.r.random() < 0.25:
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}.'
        if self.r.random() < 0.2:
            text = f"<b>{text}"
            return f"<p>{text}<br>"
        if self.r.random() < 0.15:
            text = text.replace(" ", " <em>", 1).replace(" ", "</em> ", 2) if " " in text else text
        return f"<p>{text}" + ("</p>" if self.r.random() < 0.85 else "")

    def ad(self) -> str:
        r = self.r.random()
        tag = self.r.choice(["div", "div", "aside", "section"])
        body = self.sentences(1, 3) if r < 0.6 else f"<p>{self.sentences(1, 2)}</p>" if r < 0.8 else self.links(1, 3, "")
        return f"{self.open(tag, AD, 0)}{body}</{tag}>"

    def menu(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        if tag == "ul":
            return self.links(3, 9).replace("<ul>", self.open("ul", MENU, 0), 1)
        return f"{self.open(tag, MENU, 0)}{self.links(3, 10, self.r.choice(['ul', 'ul', '']))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        inner = [f"<{self.r.choice(['h1', 'div', 'p', 'h2'])}>{self.words(1, 4)}"]
        if self.r.random() < 0.5:
            inner.append(f"<p>{self.words(2, 8)}</p>")
        if self.r.random() < 0.5:
            inner.append(self.menu())
        return f"{self.open(tag, HEAD, 0)}{''.join(inner)}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = [f"&copy; {self.word()}.example.com &middot; {self.sentences(1, 2)}"]
        if self.r.random() < 0.4:
            inner.append(self.links(2, 6))
        if self.r.random() < 0.4:
            inner.append(f"<p>{self.sentences(1, 3)}</p>")
        return f"{self.open(tag, FOOT, 0)}{''.join(inner)}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(["aside", "aside", "div"])
        inner = "".join(
            f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.links(2, 6), f"<p>{self.sentences(1, 5)}</p>"])
            for _ in range(self.r.randint(1, 3))
        )
        return f"{self.open(tag, SIDE, 0)}{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(["div", "div", "section", "aside"])
        text = self.sentences(1, 4)
        body = text if self.r.random() < 0.4 else f"<p>{text}</p>"
        return f"{self.open(tag, NOTICE, 0)}{body}<button>{self.word()}</button></{tag}>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(self.r.randint(1, 4)))
        note = f"<p>{self.sentences(1, 2)}</p>" if self.r.random() < 0.5 else ""
        return f'{self.open("form", ["search", "login", "contact", "newsletter", "signup"], 0)}{note}{fields}</form>'

    def comments(self) -> str:
        one = []
        for _ in range(self.r.randint(1, 6)):
            tag = self.r.choice(["li", "div", "article"])
            who = f"<p>{self.words(1, 2)}</p>" if self.r.random() < 0.5 else f"<b>{self.word()}</b> {self.words(1, 2)}"
            one.append(f'{self.open(tag, ["comment", "comment-body", "reply"])}{who}<p>{self.sentences(1, 6)}</p></{tag}>')
        tag = self.r.choice(["section", "div", "ol"])
        head = f"<h3>{self.words(1, 3)}</h3>" if tag != "ol" and self.r.random() < 0.7 else ""
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(COMMENTS)}" data-mark="0">{head}{"".join(one)}</{tag}>'

    def share(self) -> str:
        return f"{self.open('div', SHARE, 0)}{self.links(2, 5, self.r.choice(['ul', '']))}</div>"

    def related(self) -> str:
        tag = self.r.choice(["div", "section", "aside"])
        return f"{self.open(tag, RELATED, 0)}<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}</{tag}>"

    def main(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.8:
            title = f"<h1>{self.words(2, 14)}</h1>"
            body.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        count = r.choice([1, 1, 2, 3, 5, 8, 14, 30])
        for _ in range(count):
            kind = r.random()
            if kind < 0.78:
                body.append(self.paragraph())
            elif kind < 0.84:
                body.append(f"<h{r.randint(2, 4)}>{self.words(1, 7)}</h2>" if r.random() < 0.1 else f"<h2>{self.words(1, 7)}</h2>")
            elif kind < 0.89:
                tag = r.choice(["ul", "ol"])
                body.append(f"<{tag}>" + "".join(f"<li>{self.words(2, 12)}" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.92:
                body.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.94:
                body.append(f"<pre>{self.words(3, 20)}\n  {self.words(2, 9)}</pre>")
            elif kind < 0.96:
                cells = "".join(f"<tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}" for _ in range(r.randint(2, 5)))
                body.append(f"<table>{cells}</table>")
            elif kind < 0.98:
                body.append(f"<figure><img src=a.png><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                body.append(f"<div>{self.sentences(1, 5)}</div>")
            if r.random() < 0.04:
                body.append(r.choice([self.ad, self.share, self.related, self.notice])())
        if r.random() < 0.2:
            body.append(r.choice([self.share, self.related, self.form, self.comments])())
        kind = r.random()
        tag, names = ("article", MAIN if r.random() < 0.4 else None) if kind < 0.45 else ("main", None) if kind < 0.6 else ("section", MAIN) if kind < 0.65 else ("div", MAIN) if kind < 0.9 else ("div", NEUTRAL)
        out = f"{self.open(tag, names, 1)}{''.join(body)}</{tag}>"
        if kind < 0.2:
            out = f"<main>{out}</main>"
        return out

    def bare(self) -> str:
        """A page without anything around its text."""
        count = self.r.choice([1, 1, 2, 3, 6])
        text = "".join(self.paragraph() for _ in range(count)) if self.r.random() < 0.7 else self.sentences(1, 6)
        if self.r.random() < 0.3:
            text = f"<h1>{self.words(1, 9)}</h1>{text}"
        if self.r.random() < 0.3:
            return f'<div data-mark="1">{text}</div>'
        return f'<html data-mark="1"><body>{text}</body></html>'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.08:
            return self.bare()
        before = [f for f, p in ((self.notice, 0.15), (self.header, 0.5), (self.menu, 0.7), (self.form, 0.1), (self.ad, 0.45)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(before)
        after = [f for f, p in ((self.share, 0.1), (self.related, 0.2), (self.comments, 0.3), (self.ad, 0.15), (self.form, 0.1)) if r.random() < p]
        sides = [self.sidebar] if r.random() < 0.35 else []
        parts = [f() for f in before]
        if r.random() < 0.3:
            parts += [f() for f in sides]
            sides = []
        if r.random() < 0.97:
            parts.append(self.main())
        parts += [f() for f in after] + [f() for f in sides]
        if r.random() < 0.85:
            parts.append(self.footer())
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 0, 1, 2, 3])):
            body = f"{self.open('div', NEUTRAL)}{body}</div>"
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if r.random() < 0.8 else "")


def labelled_pages(count: int, seed: int) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]
