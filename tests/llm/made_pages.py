"""Pages of known main text: articles of several kinds inside site layouts of several kinds, with the furniture
that sites put around and into them. made(seed) gives the html and the main text's blocks in order."""

from __future__ import annotations

import random

SYLLABLES = "ka ro mi ten sul var do pe lin go ra be tis no mer fa lu son de vi".split()


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.content: list[str] = []

    # ------------------------------------------------------------ words
    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 3))) for _ in range(self.rng.randint(low, high)))

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(5, 16).capitalize() + self.rng.choice([".", ".", ".", "?", "!"]) for _ in range(sentences))

    def maybe(self, share: float, make, *args) -> str:
        return make(*args) if self.rng.random() < share else ""

    def say(self, text: str) -> str:
        """A block of the main text."""
        self.content.append(text)
        return text

    def attribute(self, *names: str) -> str:
        name = self.rng.choice(names)
        kind = self.rng.choice(["class", "id"])
        extra = self.rng.choice(["", "", ' data-role="navigation"', ' title="a hidden gem"', " data-n=don't", ' data-hidden="x"', ' data-x="class=nav sidebar"', ' style="color:red"'])
        return f'{extra} {kind}="{name}"'

    # ------------------------------------------------------------ furniture
    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 4).capitalize()}</a></li>' for i in range(self.rng.randint(low, high))) + "</ul>"

    def navigation(self) -> str:
        inside = self.links(3, 9)
        return self.rng.choice([f"<nav>{inside}</nav>", f'<div role="navigation">{inside}</div>', f"<div{self.attribute('navbar', 'main-menu', 'topbar', 'site-nav')}>{inside}</div>"])

    def masthead(self) -> str:
        inside = f'<a href="/">{self.words(1, 3)}</a><p>{self.maybe(0.6, self.prose, 1)}</p>' + self.maybe(0.5, self.navigation)
        return self.rng.choice([f"<header>{inside}</header>", f"<div{self.attribute('site-header', 'masthead', 'page-header')}>{inside}</div>"])

    def notice(self) -> str:
        return f"<div{self.attribute('cookie-notice', 'cookieConsent', 'gdpr-banner', 'privacy-popup', 'alert')}><p>{self.prose(self.rng.randint(1, 3))}</p><button>{self.words(1, 2)}</button></div>"

    def advert(self) -> str:
        return f"<div{self.attribute('ad', 'advert', 'ad-slot', 'sponsored', 'promo-box')}>{self.prose(self.rng.randint(1, 3))}</div>"

    def teasers(self) -> str:
        items = "".join(f'<div class="card"><h4><a href="/t{i}">{self.words(3, 8)}</a></h4><p>{self.prose(1)}</p></div>' for i in range(self.rng.randint(2, 5)))
        return self.rng.choice([f"<aside>{items}</aside>", f"<div{self.attribute('sidebar', 'related-posts', 'recommended', 'widget-area')}>{items}</div>"])

    def bare_links(self) -> str:
        """A list of links that nothing names: only its links speak."""
        return f"<div{self.attribute('x1', 'row', 'block', 'c-2')}>{self.links(3, 8)}</div>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=f{i}>" for i in range(self.rng.randint(1, 4)))
        return f'<form action="/s"><p>{self.prose(1)}</p>{fields}<button>{self.words(1, 1)}</button></form>'

    def comments(self) -> str:
        items = "".join(f"<div class=\"c\"><b>{self.words(1, 2)}</b><p>{self.prose(self.rng.randint(1, 4))}</p></div>" for _ in range(self.rng.randint(1, 8)))
        return f"<div{self.attribute('comments', 'disqus', 'comment-list')}><h3>{self.words(1, 2)}</h3>{items}</div>"

    def footer(self) -> str:
        inside = f"<p>&copy; {self.prose(1)}</p>" + self.maybe(0.6, self.links, 3, 8)
        return self.rng.choice([f"<footer>{inside}</footer>", f"<div{self.attribute('footer', 'site-footer', 'legal', 'footer-links')}>{inside}</div>", f'<div role="contentinfo">{inside}</div>'])

    # ------------------------------------------------------------ the article
    def part(self) -> str:
        kind = self.rng.random()
        if kind < 0.45:
            return f"<p>{self.say(self.prose(self.rng.randint(2, 6)))}</p>"
        if kind < 0.6:
            return f"<p>{self.say(self.prose(1))}</p>"
        if kind < 0.68:
            return f"<h2>{self.say(self.words(2, 7).capitalize())}</h2><p>{self.say(self.prose(3))}</p>"
        if kind < 0.76:
            return "<ul>" + "".join(f"<li>{self.say(self.words(2, 9))}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>"
        if kind < 0.84:
            return "<ol>" + "".join(f'<li><a href="http://s{i}.example">{self.say(self.words(2, 6).capitalize())}</a></li>' for i in range(self.rng.randint(1, 3))) + "</ol>"
        if kind < 0.9:
            return f"<blockquote><p>{self.say(self.prose(2))}</p></blockquote>"
        if kind < 0.95:
            rows = "".join(f"<tr><td>{self.say(self.words(1, 2))}</td><td>{self.say(self.words(1, 3))}</td></tr>" for _ in range(self.rng.randint(2, 4)))
            return f"<table>{rows}</table>"
        return f"<figure><img src=a><figcaption>{self.say(self.words(3, 8))}</figcaption></figure>"

    def article(self) -> str:
        out = f"<h1>{self.say(self.words(3, 9).capitalize())}</h1>"
        for _ in range(self.rng.randint(2, 9)):
            out += self.part() + self.maybe(0.08, self.advert) + self.maybe(0.03, self.form)
        return out

    def body(self) -> str:
        inside = self.article()
        return self.rng.choice(
            [
                f"<article>{inside}</article>", f"<main><article>{inside}</article></main>", f"<main>{inside}</main>", f"<div{self.attribute('content', 'article-body', 'entry-content', 'post')}>{inside}</div>",
                f"<div{self.attribute('x7', 'col-8', 'wrap')}>{inside}</div>", f'<div role="main">{inside}</div>', f'<article{self.attribute("post", "related-work")}><header></header>{inside}</article>',
            ]
        )

    def page(self) -> str:
        top = self.maybe(0.8, self.masthead) + self.maybe(0.6, self.navigation) + self.maybe(0.4, self.notice) + self.maybe(0.3, self.advert)
        middle = self.maybe(0.2, self.teasers) + self.body() + self.maybe(0.4, self.teasers) + self.maybe(0.3, self.bare_links) + self.maybe(0.2, self.form)
        bottom = self.maybe(0.4, self.comments) + self.maybe(0.85, self.footer)
        whole = top + middle + bottom
        if self.rng.random() < 0.12:
            whole = f'<form method="post" action="./p.aspx" id="aspnetForm"><input type="hidden" name="__STATE" value="x>y">{whole}<input type=text name=q></form>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{self.maybe(0.3, lambda: '<div>')}{whole}</body></html>"


def made(seed: int) -> tuple[str, list[str]]:
    maker = Maker(seed)
    page = maker.page()
    return page, maker.content
