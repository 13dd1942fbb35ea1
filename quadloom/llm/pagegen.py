"""Labelled pages to train on: pages put together from labelled parts, in the layouts that sites have had over the years.

``data-y`` on an element says whether it is main text; it is read by the trainer only and is no feature. The layouts are
bare documents (text right in the body), tables, sections between header and footer, generic boxes, and named or semantic
containers. A fixed seed makes the same pages everywhere. Pages written by hand, in other words and for other sites, are in
the tests and are never trained on.
"""

from __future__ import annotations

import random
import re

#: Words that sites use in class names, by what they mark.
MENU = "nav navbar navigation menu topnav breadcrumb breadcrumbs tabs toc pager pagination mainmenu submenu dropdown".split()
HEAD = "header masthead banner topbar site logo branding head tagline siteheader hero".split()
FOOT = "footer foot colophon copyright legal bottom sitemap credits imprint".split()
SIDE = "sidebar side aside rail widget related recommended popular trending archive tags sidebars promo teaser".split()
ADS = "ad ads advert advertisement sponsored sponsor adsense banner adslot adunit promo commercial dfp affiliate".split()
NOTICE = "cookie consent notice gdpr alert popup modal overlay newsletter subscribe paywall privacy toast message warning".split()
FORM = "form search login signup contact subscription searchform signin register input".split()
COMMENT = "comment comments discussion respond disqus replies reply thread reader commentlist feedback".split()
SHARE = "share social sharing follow like tweet meta byline author tools print".split()
MAIN = "content main article post entry body story text maincontent articlebody page single prose copy".split()
NEUTRAL = "container wrapper wrap row col inner outer box block grid layout section clearfix left center region view".split()
SYLLABLES = "an be co da en fi go he in ja ke lo ma no on pe qu re si tu un ve wa xi yo za ter tion ing ment ous".split()


class Pages:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, least: int = 1, most: int = 18) -> str:
        s = " ".join(self.word() for _ in range(self.r.randint(least, most)))
        return s.capitalize() + self.r.choice((".", ".", ".", ".", "?", "!", ""))

    def prose(self, most: int) -> str:
        if self.r.random() < 0.12:  # a list of words, a repeated word, a cut-off text
            n = self.r.choice((3, 12, 40, 120))
            return " ".join([self.word()] * n if self.r.random() < 0.5 else [self.word() for _ in range(n)])
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def mark(self, pool: list[str], chance: float = 0.8) -> str:
        r = self.r
        if r.random() > chance:
            return f' class="{r.choice(NEUTRAL)}"' if r.random() < 0.3 else ""
        name = r.choice(pool)
        if r.random() < 0.4:
            name += r.choice("-_ ") + r.choice((*NEUTRAL, "top", "item", "list", "area", "1", "2", "primary", "secondary"))
        return f' {r.choice(("class", "class", "class", "id"))}="{name}"'

    def box(self, tags: tuple[str, ...], pool: list[str], inner: str, y: int | None, chance: float = 0.8) -> str:
        tag = self.r.choice(tags)
        if tag != "div" and self.r.random() < 0.5:
            chance = 0.2
        label = "" if y is None else f' data-y="{y}"'
        return f"<{tag}{self.mark(pool, chance)}{label}>{inner}</{tag}>"

    def links(self) -> str:
        r = self.r
        items = [self.link(self.sentence(1, r.choice((1, 2, 3, 8))).rstrip(".?!")) for _ in range(r.randint(2, 9))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice((" | ", " ", " &middot; ")).join(items)

    def menu(self) -> str:
        return self.box(("nav", "nav", "div", "ul"), MENU, self.links(), 0)

    def header(self) -> str:
        inner = self.r.choice((f"<h1>{self.sentence(1, 4)}</h1>", self.link(self.word()), f"<p>{self.sentence(2, 8)}</p>", f"<div>{self.link(self.word())}</div><p>{self.sentence(3, 9)}</p>"))
        return self.box(("header", "header", "div"), HEAD, inner + (self.menu() if self.r.random() < 0.4 else ""), 0)

    def footer(self) -> str:
        r = self.r
        inner = r.choice((f"&copy; {self.word()} &middot; {self.sentence()}", f"<p>&copy; 20{r.randint(10, 25)} {self.sentence()}</p>", self.links(), f"<p>{self.prose(2)}</p>{self.links()}"))
        return self.box(("footer", "footer", "div"), FOOT, inner, 0, 0.9)

    def side(self) -> str:
        inner = self.r.choice((f"<h3>{self.sentence(1, 4)}</h3>{self.links()}", f"<h4>{self.sentence(1, 3)}</h4><p>{self.prose(2)}</p>", self.links(), f"<p>{self.prose(3)}</p>"))
        return self.box(("aside", "aside", "div", "section"), SIDE, inner, 0, 0.95)

    def advert(self) -> str:
        inner = self.r.choice((self.sentence(2, 14), self.link(self.sentence(2, 10)), f"<p>{self.prose(2)}</p>", f"<h4>{self.sentence(2, 5)}</h4><p>{self.prose(2)}</p>"))
        return self.box(("div", "div", "div", "aside", "section", "ins"), ADS, inner, 0, 1.0)

    def notice(self) -> str:
        inner = self.r.choice((self.prose(2), f"<p>{self.prose(3)}</p><button>{self.sentence(1, 2)}</button>", f"<p>{self.prose(2)} {self.link(self.sentence(1, 3))}</p>"))
        html = self.box(("div", "div", "section", "dialog"), NOTICE, inner, 0, 1.0)
        if self.r.random() < 0.15:  # not shown to readers
            hide = self.r.choice((" hidden", ' style="display:none"', ' aria-hidden="true"'))
            html = re.sub(r"^<([a-z]+)[^>]*>", rf'<\1{hide} data-y="0">', html)
        return html

    def form(self) -> str:
        inner = self.r.choice(("<input name=q><button>{0}</button>", "<label>{0}</label><input><button>{1}</button>", "<p>{1}</p><input type=email><button>{0}</button>", "<fieldset><legend>{0}</legend><label>{1}</label></fieldset>"))
        return self.box(("form", "form", "form", "div"), FORM, inner.format(self.sentence(1, 3), self.sentence(2, 10)), 0, 0.9)

    def comments(self) -> str:
        one = lambda: self.box(("div", "li", "article", "p"), COMMENT, self.r.choice((f"<b>{self.word()}</b> <p>{self.prose(4)}</p>", self.prose(4), f"<p>{self.prose(3)}</p><p>{self.prose(2)}</p>")), None)
        return self.box(("section", "div", "div", "ol"), COMMENT, (f"<h3>{self.sentence(1, 3)}</h3>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 5))), 0, 1.0)

    def share(self) -> str:
        return self.box(("div", "div", "ul"), SHARE, self.r.choice((self.links(), self.sentence(1, 4), f"<span>{self.sentence(1, 3)}</span>")), 0, 1.0)

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.68:
            text = self.prose(r.choice((1, 1, 3, 6)))
            if r.random() < 0.2:
                t = r.choice(("b", "i", "em", "strong", "span", "code", "q"))
                text = f"<{t}>{text}</{t}>" if r.random() < 0.7 else f"<{t}>{text}"
            if r.random() < 0.1:
                text += f"<br>{self.sentence()}<br>{self.sentence()}"
            if r.random() < 0.25:
                text += " " + self.link(self.sentence(1, 4)) + " " + self.sentence()
            return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")
        if x < 0.78:
            return f"<h{r.randint(2, 4)}>{self.sentence(1, 7)}</h2>" if r.random() < 0.1 else f"<h2>{self.sentence(1, 7)}</h2>"
        if x < 0.86:
            return "<ul>" + "".join(f"<li>{self.prose(2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if x < 0.90:
            return f"<blockquote>{r.choice(('<p>{}</p>', '{}')).format(self.prose(3))}</blockquote>"
        if x < 0.93:
            return f"<pre>{self.prose(3)}</pre>"
        if x < 0.96:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        if x < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.sentence(1, 3)}</td><td>{self.sentence(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<div>{self.prose(3)}</div>"

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.sentence(2, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        blocks = [self.block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14)))]
        if r.random() < 0.25:
            for _ in range(r.randint(1, 2)):
                blocks.insert(r.randint(0, len(blocks)), r.choice((self.advert, self.advert, self.share, self.side, self.form, self.notice))())
        inner = title + "".join(blocks)
        if r.random() < 0.12:
            inner += self.comments()
        x = r.random()
        if x < 0.6:
            return self.box(("article", "article", "main"), MAIN, inner, 1, 0.4)
        if x < 0.75:
            return "<main>" + self.box(("article", "div"), MAIN, inner, 1) + "</main>"
        if x < 0.95:
            return self.box(("div", "div", "section", "td"), MAIN, inner, 1, 0.85)
        return f'<div data-y="1">{inner}</div>'

    def marked(self, html: str, y: int = 1) -> str:
        """A block with the label on its own element."""
        return re.sub(r"^<([a-z0-9]+)", rf'<\1 data-y="{y}"', html)

    def text_blocks(self) -> list[str]:
        r = self.r
        head = [f"<h1>{self.sentence(2, 12)}</h1>"] if r.random() < 0.75 else []
        return head + [f"<p>{self.prose(r.choice((1, 3, 6)))}</p>" if r.random() < 0.8 else self.block() for _ in range(r.choice((1, 2, 3, 5, 8, 14)))]

    def bare_page(self) -> str:
        """Text right in the body, with or without something around it."""
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        blocks = [self.marked(x) for x in self.text_blocks()]
        if r.random() < 0.25:
            blocks.insert(r.randint(0, len(blocks)), r.choice((self.advert, self.form, self.share, self.notice))())
        return some(self.header, 0.3) + some(self.menu, 0.35) + "".join(blocks) + some(self.comments, 0.15) + some(self.share, 0.1) + some(self.footer, 0.45)

    def sections_page(self) -> str:
        """A header, sections without names, a footer."""
        r = self.r
        tag = r.choice(("section", "section", "div"))
        blocks = self.text_blocks()
        k = r.randint(1, len(blocks)) if r.random() < 0.4 else len(blocks)
        body = "".join(f'<{tag} data-y="1">{"".join(x)}</{tag}>' for x in (blocks[:k], blocks[k:]) if x)
        if r.random() < 0.3:
            body = f"<{r.choice(('div', 'main'))}>{body}</div>"
        menu = self.menu() if r.random() < 0.4 else ""
        return self.header() + menu + body + (self.side() if r.random() < 0.3 else "") + (self.comments() if r.random() < 0.15 else "") + self.footer()

    def table_page(self) -> str:
        """A layout table: links at one side or above, the text in a cell."""
        r = self.r
        cell = f'<td{self.mark(MAIN, 0.4)} data-y="1">{"".join(self.text_blocks())}</td>'
        side = f'<td{self.mark(MENU + SIDE, 0.5)} data-y="0">{r.choice((self.links(), self.link(self.sentence(1, 2)), f"<p>{self.links()}</p>"))}</td>'
        row = r.choice((side + cell, cell + side, side + cell + side))
        top = f'<tr><td colspan=2 data-y="0">{r.choice((self.link(self.word()), self.links(), f"<h1>{self.sentence(1, 3)}</h1>"))}</td></tr>' if r.random() < 0.5 else ""
        low = f'<tr><td colspan=2 data-y="0">{r.choice((self.links(), f"&copy; 20{r.randint(10, 25)} {self.sentence(1, 5)}"))}</td></tr>' if r.random() < 0.6 else ""
        return f"<table>{top}<tr>{row}</tr>{low}</table>" + (self.footer() if r.random() < 0.2 else "")

    def page(self) -> str:
        r = self.r
        x = r.random()
        body = self.bare_page() if x < 0.1 else self.sections_page() if x < 0.2 else self.table_page() if x < 0.27 else self.usual_page()
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>{body}</body></html>"

    def usual_page(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        top = [some(self.notice, 0.2), some(self.header, 0.6), some(self.menu, 0.7), some(self.form, 0.25), some(self.advert, 0.5)]
        low = [some(self.side, 0.4), some(self.share, 0.2), some(self.comments, 0.35), some(self.advert, 0.3), some(self.form, 0.2), some(self.notice, 0.2)]
        r.shuffle(low)
        middle = self.article()
        if r.random() < 0.4:
            k = r.randint(0, len(low))
            middle = f"<div{self.mark(NEUTRAL, 0.9)}>{middle}{''.join(low[:k])}</div>"
            low = low[k:]
        return "".join(top) + middle + "".join(low) + some(self.footer, 0.85)


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
