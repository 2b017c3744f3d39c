"""Labelled pages to train text extraction on.

Pages are put together at random from the parts that sites are made of: menus,
notices, forms, adverts, article containers of many kinds, share bars, related
links, comments, sidebars, footers. Words are invented, so that a model learns
from markup and shape, and from the stock phrases of boilerplate. The attribute
``data-main`` says for an element and what is in it whether it is main text
(1) or not (0); the nearest element that has it counts.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go he in ka lo mi no or pa qui re su ta ul ve wo xi yo ze ñe ür ço ße".split()

# Stock phrases of boilerplate, by kind.
PHRASES = {
    "cookie": ["We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our cookie policy.",
               "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies para mejorar su experiencia."],
    "share": ["Share this", "Share on social media", "Tweet", "Email", "Print", "Teilen", "Partager", "Compartir"],
    "related": ["Related articles", "Read more", "You may also like", "Most popular", "Recommended", "Mehr zum Thema", "Lire aussi"],
    "comments": ["Comments", "Leave a comment", "Reply", "2 comments", "Log in to comment", "Kommentare", "Commentaires"],
    "newsletter": ["Subscribe to our newsletter", "Sign up", "Enter your email address", "Newsletter abonnieren"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Limited offer, order today."],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Contact", "About us", "Impressum", "Mentions légales"],
    "menu": ["Home", "News", "Sports", "About", "Contact", "Archive", "Login", "Search", "Startseite", "Accueil"],
}


class Layout:
    """Parts of pages, drawn from one random generator."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 5) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(1, 24).capitalize()
            out.append((s.replace(" ", ", ", 1) if self.r.random() < .3 else s) + self.r.choice(".....!?"))
        return " ".join(out)

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind])

    def name(self, *names: str) -> str:
        """A class or id attribute made of one of the names."""
        name = self.r.choice(names)
        name = self.r.choice((name, name, f"site-{name}", f"{name}-box", f"{name} {self.word()}", f"{self.word()}_{name}"))
        return f'{self.r.choice(("class", "class", "id"))}="{name}"'

    def maybe(self, p: float, part) -> str:
        return part() if self.r.random() < p else ""

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def links(self, kind: str, low: int = 2, high: int = 9) -> str:
        texts = [self.phrase(kind) if self.r.random() < .3 else self.words(1, 3) for _ in range(self.r.randint(low, high))]
        if self.r.random() < .75:
            return "<ul>" + "".join(f"<li>{self.link(t)}</li>" for t in texts) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(map(self.link, texts))

    # Parts that are not main text.

    def menu(self) -> str:
        body = self.links("menu")
        return self.r.choice((f"<nav>{body}</nav>", f"<nav>{body}</nav>", f"<nav {self.name('menu', 'nav')}>{body}</nav>",
                              f"<div {self.name('menu', 'nav', 'navbar', 'navigation', 'topnav')}>{body}</div>", f'<div role="navigation">{body}</div>'))

    def header(self) -> str:
        inner = f"<div {self.name('logo', 'brand', 'title')}>{self.words(1, 4)}</div>" + self.maybe(.4, lambda: f"<p>{self.words(3, 9)}</p>") + self.maybe(.4, self.menu)
        return self.r.choice((f"<header>{inner}</header>", f"<div {self.name('header', 'masthead', 'topbar')}>{inner}</div>"))

    def crumbs(self) -> str:
        return f"<div {self.name('breadcrumb', 'breadcrumbs')}>{self.links('menu', 2, 4)}</div>"

    def notice(self) -> str:
        text = self.phrase("cookie") if self.r.random() < .6 else self.prose(1, 3)
        text = self.r.choice((text, f"<p>{text}</p>", f"{text} <button>OK</button>"))
        return f"<div {self.name('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'banner')}>{text}</div>"

    def ad(self) -> str:
        text = self.r.choice((self.prose(1, 5), self.phrase("ad"), f"<p>{self.prose(1, 2)}</p>", self.link(self.words(2, 8))))
        tag = self.r.choice(("div", "div", "div", "aside", "section"))
        return self.maybe(.3, lambda: f"<!-- ad {self.r.randint(0, 99)} -->") + \
            f"<{tag} {self.name('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo')}>{text}</{tag}>"

    def form(self) -> str:
        text = self.phrase("newsletter") if self.r.random() < .6 else self.words(2, 8)
        return f"<form action='/{self.word()}'>{self.r.choice((text, f'<p>{text}</p>', f'<label>{text}</label>'))}<input name=q><button>{self.words(1, 2)}</button></form>"

    def share(self) -> str:
        return f"<div {self.name('share', 'social', 'sharing')}>{self.phrase('share')} {self.maybe(.6, lambda: self.links('share', 2, 4))}</div>"

    def related(self) -> str:
        return f"<div {self.name('related', 'recommended', 'more', 'popular')}><h3>{self.phrase('related')}</h3>{self.links('related')}</div>"

    def comments(self) -> str:
        n = self.r.randint(1, 5)
        one = lambda: f"<{tag} {self.name('comment', 'reply', 'comment-body')}><p>{self.maybe(.6, lambda: f'<b>{self.word()}</b> ')}{self.prose(1, 4)}</p></{tag}>"
        tag = self.r.choice(("div", "li", "article"))
        body = "".join(one() if self.r.random() < .7 else f"<p>{self.prose(1, 3)}</p>" for _ in range(n))
        outer = self.r.choice(("div", "section", "ol" if tag == "li" else "div"))
        return f"<{outer} {self.name('comments', 'comments', 'comment-list', 'discussion', 'replies')}>{self.maybe(.7, lambda: '<h2>' + self.phrase('comments') + '</h2>')}{body}{self.maybe(.3, self.form)}</{outer}>"

    def sidebar(self) -> str:
        body = "".join(self.r.choice((lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<h3>{self.words(1, 3)}</h3>{self.links('related')}", self.ad,
                                      lambda: f"<div {self.name('widget', 'box')}>{self.prose(1, 2)}</div>"))() for _ in range(self.r.randint(1, 4)))
        return self.r.choice((f"<aside>{body}</aside>", f"<aside {self.name('sidebar')}>{body}</aside>", f"<div {self.name('sidebar', 'widget-area', 'rail')}>{body}</div>"))

    def footer(self) -> str:
        parts = [f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 3)}", f"<p>&copy; {self.r.randint(1999, 2030)} {self.words(1, 3)}. {self.phrase('footer')}</p>",
                 self.links("footer"), f"<p>{self.prose(1, 2)}</p>"]
        body = "".join(self.r.sample(parts, self.r.randint(1, 3)))
        return self.r.choice((f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div {self.name('footer', 'copyright', 'legal', 'bottom')}>{body}</div>"))

    # Main text.

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            i = self.r.randrange(len(words))
            words[i] = self.r.choice((self.link(words[i]), f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f"{words[i]}<br>"))
        return " ".join(words)

    def paragraph(self) -> str:
        text = self.prose(1, 7) if self.r.random() < .8 else self.words(1, 4) + "."
        kind = self.r.random()
        if kind < .55:
            return f"<p>{self.inline(text)}</p>"
        if kind < .7:  # unclosed, as often in the wild
            return f"<p>{self.r.choice(('', '<b>'))}{text}<br>"
        return self.r.choice((f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<h2>{self.words(1, 6)}</h2>", f"<h3>{self.words(1, 6)}</h3>",
                              "<ul>" + "".join(f"<li>{self.inline(self.prose(1, 2))}</li>" for _ in range(self.r.randint(2, 7))) + "</ul>",
                              "<ul>" + "".join(f"<li>{self.prose(1, 1)}</li>" for _ in range(self.r.randint(2, 7))) + "</ul>",
                              "<ol>" + "".join(f"<li>{self.words(1, 12)}</li>" for _ in range(self.r.randint(2, 5))) + "</ol>",
                              "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.r.randint(0, 999)}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>",
                              f"<pre>{self.words(3, 12)}</pre>", f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>", f"<div>{text}</div>"))

    def article(self) -> str:
        inside = [self.paragraph() for _ in range(self.r.choice((0, 1, 2, 3, 4, 6, 9, 14)))]
        if self.r.random() < .35:
            noise = self.r.choice((self.ad, self.share, self.related, self.form, self.notice, self.sidebar))()
            inside.insert(self.r.randint(0, len(inside)), f"<div data-main=0>{noise}</div>" if self.r.random() < .3 else noise.replace(" ", " data-main=0 ", 1) if noise.startswith("<div ") else f"<div data-main=0>{noise}</div>")
        title = self.maybe(.85, lambda: f"<h1>{self.words(2, 12)}</h1>")
        body = title + "".join(inside)
        end = self.maybe(.3, lambda: f"<div data-main=0>{self.r.choice((self.comments, self.share, self.related))()}</div>")
        kind = self.r.random()
        if kind < .4:
            return f"<article data-main=1>{body}{end}</article>"
        if kind < .5:
            return f"<main data-main=1>{body}{end}</main>"
        if kind < .6:
            return f"<main><article data-main=1>{body}{end}</article></main>"
        if kind < .9:
            return f"<div data-main=1 {self.name('article', 'post', 'content', 'entry', 'story', 'text', 'main', 'article-body', 'entry-content')}>{body}{end}</div>"
        return f"<div data-main=1>{body}{end}</div>"

    def page(self) -> str:
        top = [self.maybe(p, part) for p, part in ((.25, self.notice), (.45, self.header), (.75, self.menu), (.2, self.crumbs), (.45, self.ad), (.15, self.form))]
        bottom = [self.maybe(p, part) for p, part in ((.2, self.share), (.25, self.related), (.35, self.comments), (.35, self.sidebar), (.2, self.ad), (.85, self.footer))]
        if self.r.random() < .3:
            self.r.shuffle(bottom)
        left = self.maybe(.15, self.sidebar)
        body = "".join(top) + left + self.article() + "".join(bottom)
        if self.r.random() < .2:
            body = f"<div {self.name('wrapper', 'container', 'page')}>{body}</div>"
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t = '</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}{self.maybe(.8, lambda: '</body></html>')}"


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    return [Layout(seed * 1_000_003 + i).page() for i in range(n)]
