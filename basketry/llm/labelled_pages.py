"""Labelled pages to train extraction on: composed from parts, so that the main text of each is known.

A page is an article among menus, headers, footers, sidebars, notices, adverts, forms and comments, all of which hold sentences like the article's, so that
what tells them apart is how they are marked and where they stand.
"""

from __future__ import annotations

import html
import random

#: Names that sites give to parts; a part takes one of them, or an element of its own.
NAMES = {
    "content": "content article post entry story main body text article-body post-content entry-content story-body main-content page-content articleBody article__content post-body single-post blog-post news-text field-body prose markdown richtext copy column-main content-area hentry wrapper-article".split(),
    "nav": "nav menu navbar navigation main-nav topnav site-menu menu-main nav-links breadcrumb breadcrumbs crumbs subnav mega-menu nav-primary skip-links toc tabs pagination pager page-numbers mobile-menu dropdown-menu sitemap language-switcher".split(),
    "header": "header site-header masthead top-bar topbar page-header banner-top branding logo-area site-title tagline head-bar globalheader".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal footer-links footer-widgets foot site-info imprint credits bottom-bar disclaimer".split(),
    "sidebar": "sidebar side aside widget widget-area right-col left-column secondary rail related related-posts recommended recent-posts popular trending more-stories see-also side-panel teaser-list promo-box archive-list tag-cloud author-box".split(),
    "notice": "notice cookie cookie-banner cookie-consent consent gdpr-bar alert alert-warning popup modal overlay privacy-notice message-bar site-notice announcement toast paywall subscribe-notice info-bar dialog warning".split(),
    "ad": "ad ads advert advertisement ad-slot adsbox ad-banner banner sponsor sponsored promo promotion partner-content google-ad ad-container advertising dfp-ad native-ad leaderboard commercial adunit".split(),
    "form": "form search search-form searchbox newsletter newsletter-signup signup login login-box subscribe contact-form comment-form respond poll survey register feedback optin".split(),
    "comments": "comments comment-list comment comments-area discussion replies reply user-comments responses disqus thread commentlist reader-comments feedback-list reviews comment-thread".split(),
    "share": "share social share-buttons social-links sharing follow-us addthis tags post-tags post-nav share-bar toolbar actions".split(),
}
PHRASES = {
    "nav": ["Home", "About us", "Contact", "News", "Sport", "Products", "Blog", "Archive", "Login", "Next", "Previous", "Accueil", "Startseite", "Inicio", "Kontakt"],
    "footer": ["© {y} {w}. All rights reserved.", "Copyright {y} {w}", "&copy; {w} &middot; {s}", "Privacy Policy", "Terms of use", "Impressum", "Powered by {w}", "{s}"],
    "notice": ["We use cookies. {s}", "This site uses cookies. {s}", "{s} Accept", "You have read all your free articles. {s}", "{s}", "{s} {s}"],
    "ad": ["Advertisement", "Sponsored: {s}", "{s}", "{s} {s}", "Buy {w} now! {s}", "Anzeige", "Publicité {s}"],
    "form": ["Search", "Your e-mail", "Subscribe to our newsletter. {s}", "Name", "Password", "{s}", "Leave a comment"],
    "comments": ["{s}", "{s} {s}", "{s} {s} {s}", "{w} says:", "Reply", "{w}, {y}"],
    "share": ["Share", "Tweet", "Print", "Follow us", "Tags: {w}, {w}", "{w}"],
    "header": ["{w}", "{w} {w}", "{s}", "The {w} Times"],
    "sidebar": ["Related", "Most read", "{s}", "{s} {s}", "{w} {w} {w}", "Read more", "{s}"],
}
#: Elements that say what a part is, beside div and section.
OWN = {"nav": ["nav", "nav", "menu"], "header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "notice": ["dialog", "aside"], "ad": ["aside", "ins"], "form": ["form", "form", "fieldset"], "comments": ["section"], "share": ["ul"], "content": ["article", "article", "main", "section"]}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "dialog", "form": "search", "content": "main"}


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: list[str] = []
        letters = self.r.choice(["aeiouthnrsl", "aeiouäöüßchrnst", "éèàouaeintrs", "аеиостнрвл", "aáoñeilrsdn"])
        self.syllables = ["".join(self.r.choice(letters) for _ in range(self.r.randint(2, 3))) for _ in range(40)]
        self.tail = self.r.choice(["", "", "", "", "***", "%%%", "!", " |"])
        #: Sentences of a paragraph and words of a sentence, at most.
        self.longest, self.widest = self.r.choice([1, 1, 2, 4, 8]), self.r.choice([10, 16, 24])
        #: Whether this site names its parts; one that doesn't uses elements that say it.
        self.named = self.r.random() < 0.8

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 3))) + (self.tail if self.r.random() < 0.4 else "")

    def sentence(self, most: int = 0) -> str:
        body = " ".join(self.word() for _ in range(self.r.randint(1, most or self.widest)))
        return body[:1].upper() + body[1:] + self.r.choice([".", ".", ".", "?", ",", ""])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, min(most, self.longest))))

    def phrase(self, kind: str) -> str:
        out = self.r.choice(PHRASES[kind]) if self.r.random() < 0.7 else "{s}" if self.r.random() < 0.6 else "{w}"
        while "{" in out:
            out = out.replace("{w}", self.word(), 1).replace("{s}", self.sentence(), 1).replace("{y}", str(self.r.randint(1999, 2030)), 1)
        return out

    def opened(self, kind: str) -> tuple[str, str]:
        """Start and end tag of a part."""
        own = not self.named or self.r.random() < 0.5
        tag = self.r.choice(OWN[kind]) if own else self.r.choice(["div", "div", "div", "section", "td" if kind == "none" else "div"])
        marks = ""
        if self.named and (not own or self.r.random() < 0.4) or not own:
            name = self.r.choice(NAMES[kind])
            name = self.r.choice(["{}", "{}", "{}", "{}", "site-{}", "c-{}", "{}-wrapper", "{}__inner", "{} clearfix", "js-{}", "{} mt-4 px-2", "block {}", "{}2"]).format(name)
            marks = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        elif self.r.random() < 0.3:
            marks = f' class="css-{self.r.randrange(16**5):x}"'
        if kind in ROLES and self.r.random() < 0.12:
            marks += f' role="{ROLES[kind]}"'
        return f"<{tag}{marks}>", f"</{tag}>"

    def links(self, n: int, kind: str) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(kind) if self.r.random() < 0.5 else self.word()}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" | ", " ", "<br>"]).join(items)

    def part(self, kind: str) -> str:
        start, end = self.opened(kind)
        r = self.r
        if kind == "nav":
            body = self.links(r.randint(1, 9), kind)
        elif kind == "form":
            if "form" not in start and "fieldset" not in start:
                start, end = start + "<form>", "</form>" + end
            body = f"<label>{self.phrase(kind)}</label><input name=q><button>Go</button>" + (f"<p>{self.phrase(kind)}</p>" if r.random() < 0.5 else "") + (f"<select><option>{self.word()}</select><textarea>{self.word()}</textarea>" if r.random() < 0.3 else "")
        elif kind == "comments":
            one = lambda: r.choice(["<li><b>{w}</b><p>{t}</p></li>", "<div class=comment><p>{t}</p></div>", "<p>{w}: {t}</p>", "<div><h4>{w}</h4><p>{t}</p></div>"] * 4 + ["<article><h4>{w}</h4><p>{t}</p></article>"]).format(w=self.word(), t=self.prose(3))
            body = (f"<h3>{self.phrase('comments')}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.choice([1, 1, 2, 3, 5])))
        elif kind == "share":
            body = self.links(r.randint(1, 5), kind)
            if start.startswith("<ul"):
                body = "".join(f"<li>{self.phrase(kind)}</li>" for _ in range(r.randint(1, 4)))
        elif kind == "sidebar":
            body = "".join(r.choice(["<h3>{p}</h3>", "<p>{t}</p>", "{l}", "<div><h4><a href=x>{p}</a></h4><p>{t}</p></div>"]).format(p=self.phrase(kind), t=self.prose(3), l=self.links(r.randint(2, 6), kind)) for _ in range(r.randint(1, 4)))
        elif kind == "header":
            body = r.choice(["<h1>{p}</h1>", "<a href=/>{p}</a>", "<p>{p}</p>", "{p}", "<div>{p}</div><p>{p}</p>"]).format(p=self.phrase(kind)) + (self.part("nav") if r.random() < 0.3 else "")
        else:
            body = r.choice(["{p}", "<p>{p}</p>", "<p>{p}</p><p>{q}</p>", "<a href=x>{p}</a>", "<div>{p}</div>", "<p>{p}</p><button>OK</button>"]).format(p=self.phrase(kind), q=self.phrase(kind))
            if kind == "footer" and r.random() < 0.4:
                body += self.links(r.randint(1, 5), "nav")
        return start + body + end

    def kept(self, text: str) -> str:
        """Markup of a text that belongs to the article, which is noted."""
        self.main.append(text)
        text = html.escape(text, quote=self.r.random() < 0.5)
        words = text.split(" ")
        for at in self.r.sample(range(len(words)), k=min(len(words), self.r.choice([0, 0, 0, 1, 2]))):
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"', 'span class="hl"', "code"])
            words[at] = f"<{tag}>{words[at]}</{tag.split()[0]}>"
        return " ".join(words)

    def piece(self) -> str:
        r = self.r
        which = r.random()
        if which < 0.62:
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", '<p class="lead">{}</p>', "\n{}\n<br><hr>"]).format(self.kept(self.prose() if r.random() < 0.8 else self.sentence(3)))
        if which < 0.74:
            tag = r.choice(["h2", "h2", "h3", "h4"])
            return f"<{tag}>{self.kept(self.sentence(8))}</{tag}>"
        if which < 0.82:
            tag = r.choice(["ul", "ol"])
            item = "<li>{}</li>" if r.random() < 0.7 else '<li><a href="/y">{}</a></li>'
            return f"<{tag}>" + "".join(item.format(self.kept(self.sentence(12))) for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if which < 0.87:
            return f"<blockquote><p>{self.kept(self.prose(3))}</p></blockquote>"
        if which < 0.9:
            return f"<pre>{self.kept(self.prose(2))}</pre>"
        if which < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.kept(self.sentence(4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if which < 0.97:
            return f'<figure><img src="a.jpg"><figcaption>{self.kept(self.sentence(10))}</figcaption></figure>'
        return f"<dl><dt>{self.kept(self.word())}</dt><dd>{self.kept(self.sentence())}</dd></dl>"

    def article(self) -> str:
        r = self.r
        start, end = self.opened("content")
        head = f"<h1>{self.kept(self.sentence(12))}</h1>" if r.random() < 0.85 else ""
        if head and start.startswith("<article") and r.random() < 0.15:
            head = f"<header>{head}</header>"
        pieces = [self.piece() for _ in range(r.choice([1, 2, 4, 6, 8, 12, 18]))]
        for kind in ("ad", "share", "sidebar", "form", "notice"):
            if r.random() < 0.18:
                pieces.insert(r.randint(0, len(pieces)), self.part(kind))
        if r.random() < 0.1:
            pieces.append(self.part("comments"))
        body = head + "".join(pieces)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = self.opened("content") if r.random() < 0.5 else ("<div>", "</div>")
            body = inner[0] + body + inner[1]
        if r.random() < 0.08:
            start, end = "", ""
        return start + body + end

    def whole(self) -> str:
        r = self.r
        before = [self.part(k) for k, p in (("notice", 0.35), ("header", 0.6), ("nav", 0.8), ("form", 0.25), ("ad", 0.4), ("nav", 0.2), ("sidebar", 0.2)) if r.random() < p]
        article = self.article()
        after = [self.part(k) for k, p in (("share", 0.25), ("ad", 0.3), ("comments", 0.35), ("sidebar", 0.45), ("form", 0.25), ("nav", 0.2), ("footer", 0.85), ("notice", 0.25)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.2:
            r.shuffle(after)
        middle = article
        if r.random() < 0.4:
            frame = r.choice([("<div>", "</div>"), ('<div class="container">', "</div>"), ('<div id="page">', "</div>"), ('<div class="row"><div class="col-8">', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<main>", "</main>")])
            cut = r.choice([0, 0, 1, len(before)])
            keep = r.choice([0, 0, 1, len(after)])
            middle = "".join(before[cut:]) + article + "".join(after[:keep])
            before, after, middle = before[:cut], after[keep:], frame[0] + middle + frame[1]
        script = "<script>var x = '<p>" + self.word() + "</p>';</script>"
        body = "".join(before) + (script if r.random() < 0.3 else "") + middle + "".join(after) + (f"<!-- {self.sentence()} -->" if r.random() < 0.3 else "")
        return f"<!DOCTYPE html><html><head><title>{self.sentence(8)}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """n pages: html, and its main text with blocks joined by one space."""
    out = []
    for i in range(n):
        page = _Page(seed * 1_000_003 + i)
        source = page.whole()
        out.append((source, " ".join(" ".join(t.split()) for t in page.main)))
    return out
