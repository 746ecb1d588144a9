"""Labelled pages for training the block labeller: made from page plans by a fixed seed.

Each page is a tree of regions with invented words.  Regions of the article are marked with
a private attribute, which the reader of blocks turns into labels; the marks are removed
from the features, so the model never sees them.
"""

from __future__ import annotations

import random

MARK = "data-pl-main"
# Names of classes and ids in use on the web, by what they hold.
MAIN_NAMES = "content main post entry article body story text page-content post-body article-text entry-content".split()
OTHER_NAMES = {
    "nav": "nav menu navbar breadcrumb breadcrumbs navigation topnav tabs pagination".split(),
    "header": "header masthead site-header top banner branding logo".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related widget rail recommended trending most-read".split(),
    "ad": "ad ads advert advertisement sponsored promo adsense ad-slot".split(),
    "notice": "notice cookie cookies consent gdpr alert banner-notice subscribe newsletter popup modal".split(),
    "comments": "comments comment reply replies discussion disqus respond thread".split(),
    "share": "share social sharing tags meta byline author-box".split(),
}
SYLLABLES = "an be co da el fi go ha in jo ka lo mi no or pa re si ta un ve wa yo ze".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    return " ".join(words)


def _sentences(r: random.Random, low: int, high: int) -> str:
    text, n = [], r.randint(low, high)
    while n > 0:
        k = min(n, r.randint(1, 14))
        text.append(_words(r, k, k).capitalize() + ".")
        n -= k
    return " ".join(text)


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{_word(r)}">{_words(r, 1, 3)}</a></li>' for _ in range(n)) + "</ul>"


def _form(r: random.Random) -> str:
    return f"<form><label>{_words(r, 1, 3)}</label><input><select><option>{_word(r)}</option></select><button>{_word(r)}</button></form>"


def _other(r: random.Random, kind: str) -> str:
    """A region that is no part of the article."""
    tag = kind if kind in ("nav", "header", "footer", "aside") and r.random() < 0.6 else r.choice(["div", "div", "section"])
    name = "" if tag == kind and r.random() < 0.5 else f' {r.choice(["class", "class", "id"])}="{r.choice(OTHER_NAMES[kind])}"'
    inside = {
        "nav": lambda: _links(r, r.randint(2, 8)),
        "header": lambda: r.choice(["", f"<h1>{_words(r, 1, 4)}</h1>"]) + r.choice([_links(r, 3), f"<p>{_words(r, 2, 8)}</p>"]),
        "footer": lambda: r.choice([f"&copy; {_word(r)} &middot; {_sentences(r, 3, 12)}", f"<p>{_sentences(r, 3, 30)}</p>", _links(r, 4)]),
        "aside": lambda: f"<h3>{_words(r, 1, 4)}</h3>" + r.choice([_links(r, 4), f"<p>{_sentences(r, 4, 40)}</p>"]),
        "ad": lambda: r.choice([_sentences(r, 3, 15), f'<a href="/x">{_words(r, 2, 8)}</a>', f"<p>{_sentences(r, 4, 20)}</p>"]),
        "notice": lambda: f"<p>{_sentences(r, 5, 30)}</p>" + r.choice(["", f"<button>{_word(r)}</button>", _form(r)]),
        "comments": lambda: f"<h3>{_words(r, 1, 3)}</h3>" + "".join(f"<div><p>{_sentences(r, 2, 60)}</p></div>" for _ in range(r.randint(1, 5))) + r.choice(["", _form(r)]),
        "share": lambda: _links(r, 3) if r.random() < 0.6 else f"<span>{_words(r, 1, 4)}</span>",
    }[kind]()
    return f"<{tag}{name}>{inside}</{tag}>"


def _article(r: random.Random, titled: float = 0.8, most: int = 14) -> str:
    """The article's blocks, each marked; sometimes with foreign regions inside."""
    out = [f"<h1 {MARK}>{_words(r, 2, 12)}</h1>"] if r.random() < titled else []
    for _ in range(r.randint(1, most)):
        text = _sentences(r, *r.choice([(1, 4), (5, 30), (20, 80), (80, 250)]))
        if r.random() < 0.2:
            text = f"{_words(r, 1, 5)} <a href='/{_word(r)}'>{_words(r, 1, 4)}</a> {text}"
        kind = r.random()
        if kind < 0.7:
            bold = r.choice(["", "", "<b>"])
            out.append(f"<p {MARK}>{bold}{text}" + r.choice(["</p>", "</p>", "<br>", ""]))
        elif kind < 0.78:
            out.append(f"<h2 {MARK}>{_words(r, 1, 8)}</h2>")
        elif kind < 0.84:
            out.append(f"<blockquote {MARK}>{text}</blockquote>")
        elif kind < 0.9:
            out.append("<ul>" + "".join(f"<li {MARK}>{_sentences(r, 2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.94:
            out.append("<table>" + "".join(f"<tr><td {MARK}>{_words(r, 1, 4)}</td><td {MARK}>{_words(r, 1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.97:
            out.append(f"<pre {MARK}>{_words(r, 3, 20)}</pre>")
        else:
            out.append(f"<figure><figcaption {MARK}>{_words(r, 2, 12)}</figcaption></figure>")
        if r.random() < 0.08:
            out.append(_other(r, r.choice(["ad", "share", "notice", "aside"])))
    if r.random() < 0.15:
        out.append(_other(r, "comments"))
    return "".join(out)


def page(r: random.Random) -> str:
    before = [_other(r, k) for k in ("header", "nav", "notice", "ad", "nav") if r.random() < 0.6]
    after = [_other(r, k) for k in ("share", "comments", "aside", "ad", "notice", "footer") if r.random() < 0.5]
    r.shuffle(before)
    if r.random() < 0.25:
        # A page of nothing but its article, under no telling name.
        body = _article(r, titled=0.4, most=r.choice([1, 2, 4, 14]))
        if r.random() < 0.6:
            body = f"<div>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{body}</body></html>"
    body = _article(r)
    shape = r.random()
    if shape < 0.55:
        body = f"<article>{body}</article>"
    elif shape < 0.7:
        body = f"<main>{body}</main>"
    elif shape < 0.95:
        body = f'<div {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">{body}</div>'
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["wrapper", "container", "row", "layout"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def pages(count: int = 600, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(count)]
