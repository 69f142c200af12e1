"""Labelled pages to train the extractor on: page layouts drawn at random, each block known to be article
text or not. Words are invented syllables, so that nothing but tags, names and shapes can be learned."""

from __future__ import annotations

import random

ARTICLE = ("article", "main", "div id=content", "div class=post-content", "section class=entry-content", "div class=article-body",
           "td class=content", "div role=main", "div class='story text'", "div id=main-content", "article class=post", "div itemprop=articleBody")
#: Containers that say nothing of what they hold; "" is none at all, "?" becomes a name that no other page has.
SILENT = ("", "", "div", "div", "td", "section", "div class=?", "div id=?", "section class=?", "center", "font", "span")
MENUS = ("nav", "div class=menu", "div id=navigation", "ul class=nav-links", "div class=breadcrumbs", "nav class=main-nav", "div class=navbar",
         "div role=navigation", "div class=pagination", "div class=tags", "div class=toc")
HEADERS = ("header", "div class=header", "div id=masthead", "header class=site-header", "div class=top-bar", "div role=banner")
FOOTERS = ("footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class=copyright", "div role=contentinfo", "div class=legal")
SIDES = ("aside", "div class=sidebar", "div id=sidebar", "aside class=widget", "div class=related", "section class='related posts'",
         "div class=recommended", "div class=popular", "div class=right-column", "div class=author-bio", "div role=complementary", "ul class=related")
NOTICES = ("div class=cookie-notice", "div class=notice", "div class=alert", "div id=cookie-banner", "div role=alert", "div class=gdpr",
           "section class=notification", "div class=popup", "div class=modal", "div class=consent", "div class=banner", "div class=subscribe",
           "div class=newsletter", "div class=disclaimer", "p class=notice", "div class=warning", "div hidden", "div style=display:none")
ADVERTS = ("div class=ad", "div class=advert", "div class=advertisement", "aside class=ad", "div id=ad-1", "div class=sponsored", "ins class=ads",
           "div class=promo", "section class=promotion", "div class=sponsor", "div class=banner-ad", "p class=ad")
COMMENTS = ("section class=comments", "div id=comments", "ol class=comment-list", "div class=comment", "div class='comment reply'",
            "section id=discussion", "div class=responses", "div class=replies", "ul class=comments", "div id=disqus_thread", "article class=comment")
SHARES = ("div class=share", "div class=social", "ul class=social-share", "div class=buttons", "div class=share-buttons")
SYLLABLES = "ka lo mi ren tu sha po vel dri ans é ö ñ qua zin bor ul tem is ga fe nor wy pla".split()


def words(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append((w.capitalize() if k == 0 or rng.random() < 0.04 else w) + (rng.choice(",.") if rng.random() < 0.1 else ""))
    return " ".join(out)


def sentences(rng: random.Random, n: int) -> str:
    style = rng.random()
    text = " ".join(words(rng, rng.choice((1, 2, rng.randint(2, 18)))) + rng.choice("...?!") for _ in range(n))
    if style < 0.12:  # poor text is text all the same
        mark = rng.choice(("***", "$$$", "&amp;&amp;", "!!", " |", "%%%", ""))
        return text.upper().replace(" ", mark + " ") + mark if rng.random() < 0.5 else text.replace(" ", mark + " ") + mark
    return text if rng.random() < 0.9 else text.rstrip(".!?")


def page(rng: random.Random) -> list[tuple[str, bool | None]]:
    """Pieces of a page: (markup or text, None for markup, else whether the text belongs to the article)."""
    out: list[tuple[str, bool | None]] = []

    def open_(spec: str) -> str:
        out.append((f"<{spec}>", None))
        return f"</{spec.split()[0]}>"

    def put(tag: str, text: str, label: bool, end: bool = True) -> None:
        out.append((f"<{tag}>", None))
        out.append((text, label))
        if end:
            out.append((f"</{tag.split()[0]}>", None))

    def links(n: int) -> None:
        kind = rng.choice(("li", "li", "p", "span", "div", "bare"))
        for _ in range(n):
            text = words(rng, rng.choice((1, 1, 2, 3, 6)))
            if kind == "bare":
                out.append(("<a href=x>", None))
                out.append((text, False))
                out.append(("</a> ", None))
            else:
                out.append((f"<{kind}><a href=x>", None))
                out.append((text, False))
                out.append((f"</a></{kind}>", None))

    def prose(n: int, label: bool, tag: str = "p") -> None:
        for _ in range(n):
            put(rng.choice((tag, tag, tag, "div")), sentences(rng, rng.choice((1, 1, 2, 4, 8))), label, rng.random() < 0.85)

    def bit(specs: tuple[str, ...]) -> None:
        end = open_(rng.choice(specs))
        inner = rng.random()
        if specs in (MENUS, SHARES) or inner < 0.3:
            listed = rng.random() < 0.6
            if listed:
                out.append(("<ul>", None))
            links(rng.randint(1, 7))
            if listed:
                out.append(("</ul>", None))
        elif inner < 0.6:
            out.append((sentences(rng, rng.randint(1, 4)), False))
        else:
            if rng.random() < 0.4:
                put(rng.choice(("h2", "h3", "h4", "strong")), words(rng, rng.randint(1, 5)), False)
            prose(rng.randint(1, 3), False)
        out.append((end, None))

    def form() -> None:
        end = open_(rng.choice(("form", "form class=search", "form id=login", "form class=signup")))
        for _ in range(rng.randint(1, 4)):
            put(rng.choice(("label", "button", "p", "option", "legend", "div")), words(rng, rng.randint(1, 8)), False)
        out.append((end, None))

    def footer() -> None:
        end = open_(rng.choice(FOOTERS))
        out.append((rng.choice(("© ", "")) + rng.choice((words(rng, 3), "www.site.example.com · " + sentences(rng, rng.randint(1, 3)))), False))
        if rng.random() < 0.5:
            links(rng.randint(1, 4))
        out.append((end, None))

    def comments() -> None:
        end = open_(rng.choice(COMMENTS))
        if rng.random() < 0.5:
            put(rng.choice(("h2", "h3")), words(rng, 2), False)
        for _ in range(rng.randint(1, 5)):
            inner = open_(rng.choice(("li", "div class=comment", "div class=comment-body", "article class=comment", "div class=reply", "blockquote")))
            if rng.random() < 0.4:
                put(rng.choice(("span class=author", "cite", "b", "div class=meta")), words(rng, 2), False)
            prose(rng.randint(1, 2), False)
            out.append((inner, None))
        out.append((end, None))

    silent = rng.random() < 0.4
    bare = silent and rng.random() < 0.4  # hardly anything around the article
    extras = (lambda: bit(ADVERTS), lambda: bit(NOTICES), lambda: bit(MENUS), lambda: bit(SIDES), form)
    whole = not silent or rng.random() < 0.8
    if whole:
        out.append(("<html><body>", None))
    if rng.random() < (0.1 if bare else 0.5):
        end = open_(rng.choice(HEADERS))
        put(rng.choice(("div class=logo", "h1", "p", "h2", "span")), words(rng, rng.randint(1, 5)), False)
        if rng.random() < 0.5:
            bit(MENUS)
        out.append((end, None))
    if rng.random() < (0.1 if bare else 0.8):
        bit(MENUS)
    for f in extras:
        if rng.random() < (0.05 if bare else 0.35):
            f()
    wrap = [open_(rng.choice(("div id=page", "div class=wrapper", "div class=container", "div", "main", "table", "tr"))) for _ in range(0 if silent and rng.random() < 0.7 else rng.randint(0, 2))]
    spec = rng.choice(SILENT).replace("?", words(rng, 1).strip(".,").lower()) if silent else rng.choice(ARTICLE[:2] * 5 + ARTICLE)
    end = open_(spec) if spec else ""
    if rng.random() < 0.85:
        put(rng.choice(("h1", "h1", "h1", "h2")), words(rng, rng.randint(1, 12)), True)
    if silent and rng.random() < 0.15:  # text without any tag of its own
        out.append((sentences(rng, rng.choice((1, 3, 8))), True))
    body = rng.choice((0, 1, 2, 3, 5, 8, 14))
    for k in range(max(1, body)):
        shape = rng.random()
        if shape < 0.8:
            tag = rng.choice(("p", "p", "p", "p", "div", "p class=text"))
            close = rng.random() < 0.8
            if rng.random() < 0.25:
                out.append((f"<{tag}><b>", None))
                out.append((sentences(rng, rng.choice((1, 2, 5))), True))
                out.append(("<br>", None))
            else:
                put(tag, sentences(rng, rng.choice((1, 1, 2, 4, 9))), True, close or tag[0] != "p")
        elif shape < 0.88:
            put(rng.choice(("h2", "h3", "blockquote", "pre", "figcaption")), words(rng, rng.randint(1, 9)), True)
        else:
            inner = open_(rng.choice(("ul", "ol", "table")))
            for _ in range(rng.randint(1, 5)):
                put("td" if "table" in inner else "li", sentences(rng, 1), True)
            out.append((inner, None))
        if rng.random() < 0.05:
            rng.choice((*extras, lambda: bit(SHARES)))()
    if rng.random() < 0.2:
        bit(SHARES)
    if rng.random() < 0.12:
        comments()
    if rng.random() < 0.08:
        footer()
    out.append((end, None))
    if rng.random() < (0.1 if bare else 0.35):
        comments()
    for f in extras:
        if rng.random() < (0.05 if bare else 0.25):
            f()
    out += [(w, None) for w in reversed(wrap)]
    if rng.random() < (0.2 if bare else 0.85):
        footer()
    if whole and rng.random() < 0.8:
        out.append(("</body></html>", None))
    return out


def labelled(n: int, seed: int = 11) -> list[list[tuple[str, bool | None]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
