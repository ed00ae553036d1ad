"""Pages of known main text within wrappers whose names speak of boilerplate."""

import random

from hustings.llm import html_extract

WORDS = "river stone market window garden letter winter bridge music paper engine forest silver candle harbor".split()


def sentence(rng, n=None):
    words = [rng.choice(WORDS) for _ in range(n or rng.randint(8, 25))]
    words[len(words) // 2] += ","
    return " ".join(words).capitalize() + "."


def page(rng, wrapper):
    """(html, blocks of the article, texts that are not of it)."""
    article = [sentence(rng, 5)] + [sentence(rng) for _ in range(rng.randint(2, 6))]
    inner = f"<h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" for p in article[1:])
    apart = [("market-share", "div"), ("related-work", "section"), ("notice-of-change", "div"), ("the social question", "section")]
    name, tag = rng.choice(apart)
    extra = sentence(rng)
    if rng.random() < 0.5:
        inner += f'<{tag} {rng.choice(["class", "id"])}="{name.replace(" ", "-")}"><p>{extra}</p></{tag}>'
        article.append(extra)
    other = {kind: f"{kind.capitalize()} {sentence(rng)}" for kind in ("menu", "cookie", "comment", "footer", "sidebar")}
    for kind in other:
        other[kind] = other[kind].replace("river", "XQ")  # nothing of the article
    sides = [
        f'<nav><a href="/x">{other["menu"]}</a></nav>',
        f'<div class="{rng.choice(["cookie-notice", "cookieBanner", "cookie_consent box"])}"><p>{other["cookie"]}</p></div>',
        f'<div id="{rng.choice(["comments", "readerComments", "comment-list"])}"><p>{other["comment"]}</p></div>',
        f'<div class="{rng.choice(["siteFooter", "page-footer", "footer"])}"><p>{other["footer"]}</p></div>',
        f'<div class="{rng.choice(["sidebar", "right-sidebar", "sidebarWidget"])}"><p>{other["sidebar"]}</p></div>',
    ]
    before, after = sides[:2], sides[2:]
    body = f'{"".join(before)}{wrapper[0]}{inner}{wrapper[1]}{"".join(after)}'
    return f"<html><body>{body}</body></html>", article, list(other.values())


WRAPPERS = [('<div class="layout has-sidebar">', "</div>"), ('<div class="content no-sidebar">', "</div>"), ('<form id="aspnetForm"><input name="v" value="x">', "</form>"), ("<form><fieldset>", "</fieldset></form>"), ('<div class="page-header"><div class="inner">', "</div></div>"), ('<div id="with-footer">', "</div>")] + [
    (f'<div class="{name}">', "</div>") for name in ("widget", "menu-page", "social", "promoted post", "newsletter", "teaser", "shareable", "notice", "loginPage", "banner", "toolbar")
]


def test_article_blocks_survive_their_wrappers():
    rng = random.Random(17)
    for k in range(600):
        html, article, other = page(rng, WRAPPERS[k % len(WRAPPERS)])
        got = html_extract.extract(html)
        assert got == " ".join(article), (WRAPPERS[k % len(WRAPPERS)], got)
        assert not any(o in got for o in other)


def test_pages_that_are_one_form_or_one_wrapper():
    text = "A paragraph of the page, long enough to count. " * 3
    for html in (f"<form><p>{text}</p></form>", f'<div class="sidebar"><p>{text}</p></div>', f'<form class="menu"><div class="banner"><p>{text}</p></div></form>'):
        assert html_extract.extract(html) == text.strip()
    assert html_extract.extract("<form><label>Name</label><input><button>Send</button></form>") == ""
    article = "Short article, of one sentence that counts."
    comments = f'<div id="comments">{"<p>A reader says, at length, what readers say there.</p>" * 40}</div>'
    assert html_extract.extract(f"<body><article><p>{article}</p></article>{comments}</body>") == article
    assert html_extract.extract(f'<body><h1>Head</h1><p>{article}</p><div class="ad">{"<p>Buy this, and this, and that one too, now.</p>" * 5}</div></body>') == f"Head {article}"
