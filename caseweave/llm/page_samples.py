"""Labelled pages to train the main-text model on.

No table marks the main text of a page, so labelled pages are composed here:
the parts that pages are made of (menus, headers, notices, adverts, sidebars,
forms, reader comments, footers, and articles in many kinds of markup) are put
together in changing orders, with invented words. Every block of main text
begins with ``MARK``, which the trainer takes out again. What a part is called
(tags, classes, ids) varies as on real sites, and some pages name nothing, so
that tags, names and the look of the text all have to be learned.
"""

from __future__ import annotations

from random import Random

#: In front of each block of main text; a private character that no page uses.
MARK = ""

MENU = "menu nav navigation navbar topnav mainmenu submenu breadcrumb breadcrumbs pagination pager toc links".split()
HEADER = "header masthead topbar site-header branding logo top page-header banner".split()
FOOTER = "footer site-footer bottom copyright legal colophon imprint foot".split()
SIDE = "sidebar side aside widget related recommended popular trending rail secondary tags archive".split()
NOTICE = "notice cookie cookies consent alert warning message popup modal gdpr disclaimer announcement".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox teaser".split()
SOCIAL = "share social sharing follow buttons toolbar actions meta byline tools".split()
COMMENTS = "comments comment comment-list replies reply discussion respond disqus feedback reviews".split()
FORM = "newsletter subscribe subscription signup login search contact register".split()
STORY = (
    "content article post entry story text body article-body post-body entry-content main-content "
    "post-content page-content body-text prose markdown blog-post article-text maincontent story-body"
).split()
NEUTRAL = "wrapper container inner outer row col page site box wrap block layout grid clearfix section".split()
SOUNDS = [
    "an ba che do en fi ga her in jo ka le mo ne or pu re sta ti um ver wo ze",
    "é au eux ion ment ça où tre que la per vou",
    "ß ich ung keit ver ü ö ä sch der lich",
    "ó ñ ción ar es la do que ía",
    "да но ре ка ство при ло",
    "文 章 中 国 日 本 新 聞",
]


class Maker:
    """Makes one page."""

    def __init__(self, seed: int):
        self.r = Random(seed)
        self.sounds = self.r.choice(SOUNDS[:1] * 2 + SOUNDS).split()
        # some pages are full of signs between or behind the words
        self.behind = self.r.choice([[""]] * 7 + [["&amp;&amp;", "***", "%%", "$$", "#"]])
        self.between = self.r.choice([" "] * 7 + [" | ", " - ", " © ", " · ", ", ", " 12 "])

    def word(self) -> str:
        w = "".join(self.r.choice(self.sounds) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(self.behind)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def run(self, low: int, high: int) -> str:
        return self.between.join(self.words(1, 3) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(1, 18) if self.between == " " else self.run(1, 9)
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s[:1].upper() + s[1:] + self.r.choice(["."] * 6 + ["?", "!", "...", ""])

    def prose(self, low: int = 1, high: int = 8) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s, turn = self.sentence(), self.r.random()
            if turn < 0.06:
                s = f'<a href="/{self.word()}">{s}</a>'
            elif turn < 0.12:
                s = f"<{(tag := self.r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{s}</{tag}>"
            elif turn < 0.15:
                s += "<br>"
            out.append(s)
        return " ".join(out)

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def named(self, names: list[str], tags: list[str], inside: str) -> str:
        """*inside* in an element that one of *names*, one of *tags*, or both tell apart."""
        tag, name = self.r.choice(["div", "div", "section", "ul" if "<li" in inside else "div"]), ""
        if tags and self.r.random() < 0.5:
            tag = self.r.choice(tags)
        if tag not in tags or self.r.random() < 0.4:
            word = self.r.choice(names)
            if self.r.random() < 0.3:
                word += self.r.choice(["-", "_", " "]) + self.r.choice(NEUTRAL + ["top", "left", "right", "main"])
            name = f' {self.r.choice(["class", "class", "id"])}="{word}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    def wrapped(self, inside: str) -> str:
        for _ in range(self.r.randint(0, 2)):
            name = f' class="{self.r.choice(NEUTRAL)}"' if self.r.random() < 0.7 else ""
            inside = f"<div{name}>{inside}</div>"
        return inside

    # -- what is not main text

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}" + self.r.choice(["</li>", ""]) for _ in range(self.r.randint(2, 8)))
        flat = " | ".join(self.link() for _ in range(self.r.randint(2, 6)))
        return self.named(MENU, ["nav"], self.r.choice([f"<ul>{items}</ul>", flat, f"<p>{flat}</p>"]))

    def header(self) -> str:
        inside = self.r.choice([
            f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.link()}</div><p>{self.sentence()}</p>", self.words(1, 4),
        ])
        return self.named(HEADER, ["header"], inside + (self.menu() if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        inside = self.r.choice([
            f"&copy; 20{self.r.randint(10, 30)} {self.words(1, 4)}", f"&copy; {self.word()} &middot; {self.sentence()}",
            f"<p>{self.prose(1, 3)}</p>", f"<p>{' '.join(self.link() for _ in range(4))}</p><p>{self.words(2, 6)}</p>",
        ])
        return self.named(FOOTER, ["footer"], inside)

    def side(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 6)))
        inside = f"<h3>{self.words(1, 3)}</h3>" * self.r.randint(0, 1)
        inside += self.r.choice([f"<ul>{items}</ul>", f"<p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 2)}</p><ul>{items}</ul>"])
        return self.named(SIDE, ["aside"], inside)

    def notice(self) -> str:
        button = f"<button>{self.word()}</button>" if self.r.random() < 0.5 else ""
        text = self.prose(1, 4)
        return self.named(NOTICE, [], self.r.choice([f"<p>{text}</p>", text]) + button)

    def advert(self) -> str:
        text = self.prose(1, 5)
        return self.named(ADVERT, [], self.r.choice([text, f"<p>{text}</p>", self.link(), f"<h4>{self.words(1, 4)}</h4><p>{text}</p>"]))

    def social(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(3))
        return self.named(SOCIAL, [], self.r.choice([f"<ul>{items}</ul>", self.words(1, 4), f"<span>{self.word()}</span> {self.link()}"]))

    def comments(self) -> str:
        out = f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 3)}</h{n}>" * self.r.randint(0, 1)
        item = self.r.choice(["div", "li", "article"])
        for _ in range(self.r.randint(1, 5)):
            name = self.r.choice(["", ' class="comment"', ' class="comment-body"', ' class="reply"'])
            out += f"<{item}{name}><p>{self.prose(1, 6)}</p></{item}>"
        if self.r.random() < 0.3:
            out += self.form()
        return self.named(COMMENTS, [], out)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(self.r.randint(1, 3)))
        inside = f"<p>{self.prose(1, 3)}</p>" * self.r.randint(0, 1) + fields
        inside += self.r.choice([f"<button>{self.word()}</button>", f"<select><option>{self.word()}<option>{self.word()}</select>", ""])
        name = f' class="{self.r.choice(FORM)}"' if self.r.random() < 0.6 else ""
        form = f"<form{name}>{inside}</form>"
        return form if self.r.random() < 0.6 else self.named(FORM, [], form)

    def other(self) -> str:
        return self.r.choice([
            self.menu, self.side, self.notice, self.advert, self.social, self.form, self.advert, self.side,
        ])()

    # -- main text

    def part(self) -> str:
        r, m = self.r, MARK
        turn = r.random()
        if turn < 0.68:
            text = self.prose() if r.random() < 0.9 else r.choice([self.words(1, 12), str(r.randint(1, 99)), self.link()])
            return f"<p>{m}{text}" + r.choice(["</p>"] * 4 + ["", "<br>"])
        if turn < 0.76:
            return f"<h{(n := r.randint(2, 4))}>{m}{self.words(1, 8)}</h{n}>"
        if turn < 0.84:
            items = "".join(f"<li>{m}{self.prose(1, 2)}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 5)))
            return f"<{(tag := r.choice(['ul', 'ol']))}>{items}</{tag}>"
        if turn < 0.88:
            return f"<blockquote>{m}{self.prose()}</blockquote>"
        if turn < 0.91:
            return f"<pre>{m}{self.words(2, 20)}</pre>"
        if turn < 0.94:
            return f"<figure><img src=x><figcaption>{m}{self.sentence()}</figcaption></figure>"
        if turn < 0.97:
            rows = "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{r.randint(1, 999)}</td></tr>" for _ in range(3))
            return f"<table>{rows}</table>"
        return f"<div>{m}{self.prose()}</div>"

    def story(self, named: bool) -> str:
        r = self.r
        out = ""
        if r.random() < 0.85:
            out = f"<h1>{MARK}{r.choice([self.words(1, 10), self.sentence()])}</h1>"
            if named and r.random() < 0.15:
                out = f"<header>{out}</header>"
        if named and r.random() < 0.2:
            out += self.social()
        short = r.random() < 0.2
        for _ in range(r.randint(1, 14)):
            out += f"<p>{MARK}{self.words(1, 2)}.</p>" if short and r.random() < 0.5 else self.part()
            if named and r.random() < 0.06:
                out += self.other()
        if named:
            for more in (self.social, self.comments, self.form, self.side):
                if r.random() < 0.1:
                    out += more()
        if not named:
            return out
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        name = f' {r.choice(["class", "id", "itemprop"])}="{r.choice(STORY)}"'
        if tag in ("article", "main") and r.random() < 0.6:
            name = ""
        out = f"<{tag}{name}>{self.wrapped(out) if r.random() < 0.3 else out}</{tag}>"
        if tag == "td":
            out = f"<table><tr><td>{self.menu()}</td>{out}</tr></table>"
        elif r.random() < 0.25:
            outer = r.choice(["main", f'div class="{r.choice(STORY)}"', "section"])
            out = f"<{outer}>{self.other() if r.random() < 0.3 else ''}{out}</{outer.split()[0]}>"
        return out

    def page(self) -> str:
        r = self.r
        if r.random() < 0.06:  # nothing but text
            return r.choice([f"{MARK}{self.prose()}", self.story(False), f"<body>{self.wrapped(self.story(False))}"])
        before = [f() for f, p in (
            (self.notice, 0.25), (self.header, 0.5), (self.menu, 0.75), (self.advert, 0.4), (self.side, 0.15), (self.form, 0.15),
        ) if r.random() < p]
        after = [f() for f, p in (
            (self.side, 0.35), (self.advert, 0.25), (self.comments, 0.4), (self.form, 0.2), (self.menu, 0.2),
            (self.footer, 0.8), (self.notice, 0.1),
        ) if r.random() < p]
        r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        story = self.story(r.random() < 0.85) if r.random() < 0.97 else ""
        body = "".join(before) + self.wrapped(story) + "".join(after)
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{self.wrapped(body)}"
        return page + ("</body></html>" if r.random() < 0.85 else "")


def labelled_pages(count: int, seed: int) -> list[str]:
    """*count* pages whose main blocks begin with ``MARK``; the same for the same seed."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
