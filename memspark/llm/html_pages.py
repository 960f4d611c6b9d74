"""Labelled web pages to learn from: page layouts put together by a rule, content marked.

Elements carry ``data-content="1"`` or ``"0"``; it holds for everything below until marked otherwise. The attribute is
only for labels: the model does not see it.
"""

from __future__ import annotations

import random

# Names that sites give to their parts.
MAIN = ["content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "story-body", "text", "page-text", ""]
MENU = ["menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs", "main-menu", ""]
HEADER = ["header", "site-header", "masthead", "topbar", "logo", "page-header", ""]
FOOTER = ["footer", "site-footer", "copyright", "colophon", "legal", "bottom", ""]
SIDE = ["sidebar", "aside", "widget", "related", "recommended", "popular", "more-stories", "rail", "tags", "share", "social", "author-box"]
NOTICE = ["cookie", "cookie-banner", "consent", "notice", "alert", "banner", "popup", "modal", "newsletter", "subscribe", "paywall"]
ADVERT = ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "banner-ad"]
COMMENTS = ["comments", "comment", "comment-list", "reader-comments", "responses", "discussion", "replies", "disqus"]


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("aeioubcdfghlmnprst") for _ in range(self.r.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(4, 18).capitalize() + self.r.choice([".", ".", ".", "?", "!"])

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def named(self, tags: list[str], names: list[str], label: int, inner: str) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        mark = f" {self.r.choice(['class', 'class', 'id'])}='{name}'" if name else ""
        return f"<{tag}{mark} data-content='{label}'>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = "".join(f"<li><a href='/{self.word()}'>{self.words(1, 3)}</a></li>" for _ in range(self.r.randint(low, high)))
        return f"<ul>{items}</ul>"

    def blocks(self) -> list[str]:
        out = []
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.3:
                out.append(self.short_block())
            elif kind < 0.8:
                body = self.prose(1, 6)
                if self.r.random() < 0.2:
                    body += f" <a href='/{self.word()}'>{self.words(1, 3)}</a> {self.sentence()}"
                out.append(f"<p>{'<b>' if self.r.random() < 0.1 else ''}{body}" + self.r.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.86:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.96:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            else:
                out.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr></table>")
        return out

    def linked(self, text: str) -> str:
        return f"<a href='/{self.word()}'>{text}</a>"

    def short_block(self) -> str:
        """What articles hold beside paragraphs: short or linked lines, lists of both, definitions, tables, pictures with a line."""
        r = self.r
        item = lambda: self.linked(self.words(1, 6)) if r.random() < 0.5 else self.words(1, 4)
        kinds = [
            lambda: f"<p>{self.words(1, 3).capitalize()}.</p>",
            lambda: f"<p>{self.linked(self.prose(1, 2))}</p>",
            lambda: f"<p>{self.words(1, 4)}</p>",
            lambda: "<ul>" + "".join(f"<li>{self.words(1, 3)}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(1, 6))) + "</ol>",
            lambda: "<ul>" + "".join(f"<li>{self.linked(self.words(1, 8))}</li>" for _ in range(r.randint(2, 7))) + "</ul>",
            lambda: "<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.prose(1, 2)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>",
            lambda: "<table><tr><th>" + "</th><th>".join(self.word() for _ in range(3)) + "</th></tr>"
            + "".join("<tr><td>" + "</td><td>".join(self.words(1, 2) for _ in range(3)) + "</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
            lambda: f"<figure><img src='/{self.word()}.png'><figcaption>{self.words(2, 12)}</figcaption></figure>",
            lambda: f"<pre>{self.words(2, 20)}</pre>",
            lambda: f"<h3>{self.words(1, 4)}</h3>",
        ]
        return r.choice(kinds)()

    def boilerplate(self) -> str:
        r = self.r
        short = lambda: r.choice([self.sentence(), f"<p>{self.prose(1, 2)}</p>", self.words(2, 12)])
        return r.choice(
            [
                lambda: self.named(["nav", "nav", "div"], MENU if r.random() < 0.9 else MENU[:-1], 0, self.links(3, 9)),
                lambda: self.named(["div", "div", "section"], ADVERT, 0, short()),
                lambda: self.named(["aside", "div"], SIDE, 0, f"<h3>{self.words(1, 4)}</h3>{self.links(2, 6)}"),
                lambda: self.named(["aside", "div"], SIDE, 0, short()),
                lambda: self.named(["div", "div", "section"], NOTICE, 0, short()),
                lambda: self.named(["form"], ["search", "login", "signup", "subscribe", ""], 0, f"<p>{self.words(1, 6)}</p><input><button>{self.word()}</button>"),
            ]
        )()

    def comments(self) -> str:
        items = "".join(f"<li><p>{self.words(1, 2)}</p><p>{self.prose(1, 4)}</p></li>" for _ in range(self.r.randint(1, 6)))
        return self.named(["section", "div", "div"], COMMENTS, 0, f"<h3>{self.words(1, 2)}</h3><ol>{items}</ol>")

    def page(self) -> str:
        r = self.r
        title = self.words(1, 9).capitalize()
        body = [f"<h1>{title}</h1>", *self.blocks()]
        if r.random() < 0.2:  # a short article, with a title or without
            body = body[: r.choice([0, 1])] + [self.short_block() for _ in range(r.randint(1, 4))]
        for _ in range(r.choice([0, 0, 1, 2])):
            body.insert(r.randint(min(1, len(body)), len(body)), self.boilerplate())
        if r.random() < 0.2:
            body.append(self.comments())
        inner = "".join(body)
        if r.random() < 0.6:
            main = f"<article data-content='1'>{inner}</article>"
        else:
            main = self.named(["div", "div", "main", "section"], MAIN[:-1], 1, inner)
        around = [main]
        if r.random() < 0.3:
            around = [self.named(["div", "main"], ["wrapper", "container", "page", "layout", ""], 0, main + (self.boilerplate() if r.random() < 0.5 else ""))]
        for _ in range(r.randint(0, 3)):
            around.insert(r.randint(0, len(around)), self.boilerplate())
        if r.random() < 0.7:
            around.insert(0, self.named(["header", "header", "div"], HEADER[:-1], 0, f"<p>{self.words(1, 4)}</p>" + (self.links(2, 6) if r.random() < 0.5 else "")))
        if r.random() < 0.4:
            around.append(self.comments())
        if r.random() < 0.8:
            around.append(self.named(["footer", "footer", "div"], FOOTER[:-1], 0, r.choice([self.links(2, 5), f"&copy; {self.words(1, 4)} &middot; {self.sentence()}", f"<p>{self.prose(1, 2)}</p>"])))
        return f"<html><head><title>{title}</title></head><body data-content='0'>{''.join(around)}</body></html>"


def labelled_pages(pages: int = 400, seed: int = 1) -> list[str]:
    """Pages with labels in their markup; the same for the same seed."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(pages)]
