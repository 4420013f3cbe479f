"""Labelled pages for training: varied page layouts with the label of every block known.

The texts are invented words; what varies is what tells main text from the rest: elements, names of
classes, lengths, links, and the order of the parts.
"""

from __future__ import annotations

import random

# Names that sites give to the parts of their pages.
NAMES = {
    "nav": "nav navbar menu main-menu topnav navigation site-nav breadcrumb breadcrumbs nav-links tabs pagination pager".split(),
    "header": "header site-header masthead topbar banner branding hero-bar page-top logo".split(),
    "footer": "footer site-footer copyright legal bottom colophon page-bottom imprint".split(),
    "aside": "sidebar side aside widget widget-area related related-posts recommended rail popular trending most-read tags tag-list".split(),
    "notice": "cookie cookie-banner consent notice gdpr alert popup modal overlay privacy-notice message toast paywall subscribe newsletter promo-box".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adslot ad-box banner-ad partner commercial".split(),
    "form": "form login search search-form signup contact-form newsletter-form comment-form".split(),
    "byline": "byline author meta entry-meta post-meta date posted-on dateline published timestamp".split(),
    "comments": "comments comment comments-area comments-title comment-list responses replies discussion user-comments comment-body reader-comments disqus thread".split(),
    "share": "share social sharing share-buttons follow social-links toolbar byline-tools".split(),
    "main": "content article post entry story main text body article-body post-content entry-content page-content main-content story-body prose".split(),
}
_SYLLABLES = "the of and to in re er on an th ti en de la le ou ver ein sch ung ción ado que é ä ü ß ñ or is at ing ion ed".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []

    def pick(self, values):
        return values[int(self.rng.random() * len(values))]

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def words(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(self.rng.randint(1, 3))) for _ in range(n))

    def sentences(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        return " ".join(self.words(4, 18).capitalize() + self.pick([".", ".", ".", "!", "?"]) for _ in range(n))

    def tag(self, text: str) -> None:
        self.parts.append(text)

    def block(self, element: str, text: str, label: int, link: bool = False) -> None:
        icon = self.pick(['<svg class="icon"><title>x</title><path d="M0"/></svg>', '<svg class="i"/>', "<noscript><img></noscript>"]) if self.chance(0.04) else ""
        inner = icon + (f'<a href="/{len(self.labels)}">{text}</a>' if link else text)
        self.parts.append(f"<{element}>{inner}</{element}>")
        self.labels.append(label)

    def named(self, element: str, kind: str, share: float = 0.85) -> None:
        attribute = self.pick(["class", "class", "id", "role"])
        self.parts.append(f'<{element} {attribute}="{self.pick(NAMES[kind])}">' if self.chance(share) else f"<{element}>")

    def links(self, element: str, kind: str, least: int, most: int) -> None:
        self.named(element, kind)
        listed = self.chance(0.7)
        self.tag("<ul>" if listed else "<div>")
        for _ in range(self.rng.randint(least, most)):
            self.block("li" if listed else "div", self.words(1, 4), 0, link=True)
        self.tag(("</ul>" if listed else "</div>") + f"</{element}>")

    def short(self, element: str, kind: str, share: float = 0.95) -> None:
        """A box of one or two blocks that says something short."""
        self.named(element, kind, share)
        for _ in range(self.rng.randint(1, 2)):
            text = self.pick([self.sentences(1, 2), self.words(2, 8), self.sentences(1, 3)])
            if kind == "footer" and self.chance(0.7):
                text = self.pick(["©", "&copy;", "Copyright"]) + " " + text
            if self.chance(0.5):
                self.block("p", text, 0, link=self.chance(0.2))
            else:
                self.tag(text)
                self.labels.append(0)
                self.tag("<hr>")
        self.tag(f"</{element}>")

    def comments(self) -> None:
        element, listed = self.pick(["section", "div"]), self.chance(0.4)
        self.named(element, "comments", 1.0)
        if self.chance(0.7):
            self.block(self.pick(["h2", "h3"]), self.words(1, 4), 0)
        if listed:
            self.named("ol", "comments", 0.8)
        for _ in range(self.rng.randint(1, 5)):
            self.named("li" if listed else self.pick(["div", "article"]) if self.chance(0.3) else "div", "comments", 0.8)
            if self.chance(0.3):
                self.block(self.pick(["div", "cite", "footer"]) if not listed else "div", self.words(1, 4), 0)
                self.tag("<hr>")
            self.block("span" if self.chance(0.01) else "p", self.sentences(1, 4), 0)
            self.tag("</li>" if listed else "</article></div>")
        self.tag(("</ol>" if listed else "") + f"</{element}>")

    def byline(self) -> None:
        """Author and date of a text, which are not of it."""
        self.named(self.pick(["div", "p", "div"]), "byline", 1.0)
        self.tag(self.pick(["<span>", "<time>", ""]) + self.pick([self.words(2, 5), f"By {self.words(2, 2)}", f"{self.words(1, 2)} 1{self.rng.randint(0, 9)}, 20{self.rng.randint(10, 29)}"]))
        self.labels.append(0)
        self.tag("</span></time></div></p>")

    def terms(self) -> None:
        """A list of terms, as documentation has it."""
        self.tag(self.pick(["<dl>", '<dl class="function">', '<dl class="terms">']))
        for _ in range(self.rng.randint(1, 3)):
            self.block("dt", self.words(1, 4), 1)
            self.tag("<dd>" if (wrapped := self.chance(0.4)) else "")
            self.block("p" if wrapped else "dd", self.sentences(1, 2), 1)
            self.tag("</dd>" if wrapped else "")
        self.tag("</dl>")

    def figure(self) -> None:
        self.tag('<figure><img src="x.png">')
        self.block("figcaption", self.sentences(1, 1), 1)
        self.tag("</figure>")

    def code(self) -> None:
        self.tag(self.pick(["", '<div class="highlight">']))
        self.block("pre", f"<code>{self.words(3, 20)}</code>", 1)
        self.tag("</div>")

    def form(self, share: float = 0.85) -> None:
        """A form with what stands in it: labels, sentences, buttons."""
        self.named("form", "form", share)
        for _ in range(self.rng.randint(1, 3)):
            text = self.pick([self.words(1, 3), self.sentences(1, 2), self.words(1, 2) + " / " + self.sentences(1, 1)])
            if self.chance(0.5):
                self.block(self.pick(["p", "div", "h3"]), text, 0)
            else:
                self.tag(text + "<input>")
                self.labels.append(0)
                self.tag("<hr>")
        if self.chance(0.6):
            self.block("button", self.words(1, 3), 0)
        self.tag("</form>")

    def linked(self) -> str:
        """A sentence that is made of links for the most part."""
        links = [f'<a href="/{k}">{self.words(1, 5)}</a>' for k in range(self.rng.randint(1, 4))]
        return self.words(0, 2).capitalize() + " " + self.pick([", ", " and ", " or "]).join(links) + self.pick([".", ".", "", f" {self.words(1, 3)}."])

    def layout_table(self) -> None:
        """A page laid out by a table: a column of links, and a column of text."""
        def menu() -> None:
            self.tag(self.pick(["<td>", '<td class="menu">', '<td class="nav">', '<td valign="top">']))
            if self.chance(0.5):
                self.tag(" | ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(1, 6))))
                self.labels.append(0)
            else:
                for _ in range(self.rng.randint(2, 6)):
                    self.block("p" if self.chance(0.5) else "div", self.words(1, 2), 0, link=True)
            self.tag("</td>")

        self.tag("<table><tr>")
        left, row = self.chance(0.7), self.chance(0.3)
        if left:
            menu()
        if row:
            self.tag("</tr><tr>")
        self.tag(self.pick(["<td>", '<td class="content">', '<td class="text">', '<td valign="top">']))
        if self.chance(0.8):
            self.block(self.pick(["h1", "h2"]), self.words(2, 9).capitalize(), 1)
        for _ in range(self.rng.randint(2, 7)):
            self.block("p", self.pick([self.sentences(1, 3), self.sentences(3, 8), self.words(8, 30)]), 1)
        self.tag("</td>")
        if not left:
            menu()
        self.tag("</tr></table>")

    def bare(self) -> None:
        """Paragraphs without an element around them that says what they are."""
        if self.chance(0.5):
            self.block("h1", self.words(2, 9).capitalize(), 1)
        for _ in range(self.rng.randint(1, 6)):
            self.block("p", self.sentences(1, 5), 1)

    def body(self) -> None:
        """The main text: heading, paragraphs, lists, quotes and inner boxes that are not of it."""
        element = self.pick(["article", "article", "article", "main", "div", "section"])
        outer = self.chance(0.4)
        if outer:
            self.named(self.pick(["main", "div"]), "main")
        self.named(element, "main", 1.0 if element in ("div", "section") else 0.3)
        if self.chance(0.8):
            inside = self.chance(0.3)
            self.tag(self.pick(["<header>", '<header class="entry-header">', '<header class="post-header">']) if inside else "")
            self.block("h1", self.words(2, 14).capitalize() + self.pick(["", "."]), 1)
            if self.chance(0.4):
                self.byline()
            self.tag("</header>" if inside else "")
            if self.chance(0.1):
                self.byline()
        inner = self.chance(0.2)
        self.tag(self.pick(['<div class="entry-content">', '<div class="post-body">', '<div class="body">', "<div>"]) if inner else "")
        for _ in range(self.rng.randint(1, 13)):
            kind = self.rng.random()
            if kind < 0.69:
                text = self.pick([self.sentences(1, 1), self.sentences(1, 3), self.sentences(3, 8), self.words(1, 3).capitalize() + ".", self.words(6, 30)])
                if self.chance(0.15):
                    text = f"<b>{text[:20]}</b>{text[20:]}"
                if self.chance(0.15):
                    text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 6)}.'
                if self.chance(0.07):
                    text = self.linked()
                self.block("p" if self.chance(0.95) else "div", text, 1)
            elif kind < 0.76:
                self.block(self.pick(["h2", "h3"]), self.words(1, 6).capitalize(), 1)
            elif kind < 0.80:
                self.pick([self.terms, self.terms, self.figure, self.code])()
            elif kind < 0.83:
                self.tag("<ul>")
                for _ in range(self.rng.randint(1, 4)):
                    self.block("li", self.words(2, 12), 1)
                self.tag("</ul>")
            elif kind < 0.86:
                self.tag("<blockquote>")
                self.block("p", self.sentences(1, 3), 1)
                self.tag("</blockquote>")
            elif kind < 0.88:
                self.tag("<table>")
                for _ in range(self.rng.randint(1, 2)):
                    self.tag("<tr>")
                    for _ in range(2):
                        self.block("td", self.words(1, 4), 1)
                    self.tag("</tr>")
                self.tag("</table>")
            elif kind < 0.89:
                self.form()
            elif kind < 0.975:
                self.short(self.pick(["div", "aside"]), self.pick(["ad", "ad", "notice", "aside"]), 1.0)
            else:
                self.links("div", self.pick(["share", "aside"]), 2, 5)
        self.tag("</div>" if inner else "")
        if self.chance(0.15):
            self.short("footer", self.pick(["share", "aside", "byline"]))
        nested = self.chance(0.1)
        if nested and element != "article":
            self.comments()
        self.tag(f"</{element}>")
        if nested and element == "article":
            self.comments()
        if outer and self.chance(0.2):
            self.pick([lambda: self.short(self.pick(["aside", "div"]), "aside", 1.0), lambda: self.links("div", "aside", 2, 6)])()
        if outer:
            self.tag("</main></div>")


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """n pages with the labels of their blocks in page order: 1 for main text, 0 for all else."""
    pages = []
    for i in range(n):
        w = _Writer(random.Random(f"{seed}/{i}"))
        if w.chance(0.03):  # a text without elements, or with none but a body and line breaks
            w.tag(w.pick(["", "<body>", "<html><body>"]) + w.pick([" ", "\n", "<br>"]).join(w.sentences(1, 3) for _ in range(w.rng.randint(1, 6))))
            pages.append(("".join(w.parts), [1]))
            continue
        wrapped, deep = w.chance(0.04), w.rng.randint(5, 150) if w.chance(0.08) else 0
        w.tag("<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style></head><body>" + ("<form action=/page><div>" if wrapped else ""))
        if w.chance(0.3):
            w.short("div", "notice")
        if w.chance(0.5):
            w.short(w.pick(["header", "header", "div"]), "header", 0.9)
        if w.chance(0.8):
            w.links(w.pick(["nav", "nav", "div"]), "nav", 2, 9)
        if w.chance(0.5):
            w.short("div", "ad", 1.0)
        if w.chance(0.2):
            w.links(w.pick(["aside", "div"]), "aside", 2, 8)
        w.tag("<div>" * deep)
        if w.chance(0.97):
            (w.layout_table if w.chance(0.06) else w.bare if w.chance(0.04) else w.body)()
        w.tag("</div>" * deep)
        if w.chance(0.3):
            w.links("div", "share", 2, 5)
        if w.chance(0.35):
            w.comments()
        if w.chance(0.4):
            w.short(w.pick(["aside", "aside", "div"]), "aside", 1.0)
        if w.chance(0.3):
            w.form()
        if w.chance(0.3):
            w.short("div", w.pick(["ad", "notice"]), 1.0)
        if w.chance(0.85):
            w.short(w.pick(["footer", "footer", "footer", "div"]), "footer", 0.9)
        w.tag("</body></html>")
        pages.append(("".join(w.parts), w.labels))
    return pages
