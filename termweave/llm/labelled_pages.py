"""Labelled pages on which the content model of operator 10 is trained.

A block is main text when it or an ancestor carries ``data-main``; ``data-off``
inside takes a part out again.  The pages are written for this purpose and
show, between them, the furniture that pages put around and into an article.
"""

_TEXT = ("The council met on Tuesday to discuss the new bridge, which has been planned for ten years and "
         "will cost more than the town expected. Work starts in spring, and most members agreed.")
_SHORT = "A second, shorter paragraph follows here and ends with a stop."
_MENU = ("<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li>"
         "<li><a href=/c>Contact</a></li></ul></nav>")
_FOOT = "<footer>&copy; example.org &middot; All rights reserved. Imprint and privacy.</footer>"
_COMMENTS = ('<section class="comments"><h2>Comments</h2><div class="comment"><p>Great piece, thank you for '
             'writing it, I learned a lot about this.</p></div><div class="comment"><p>I do not agree at all '
             'with the second part of this text.</p></div></section>')
_COOKIE = '<div class="cookie-notice">We use cookies to improve our service. <button>Accept</button></div>'
_ASIDE = ('<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Older story one</a></li><li>'
          '<a href=/2>Older story two</a></li></ul></aside>')
_AD = '<div class="ad">Buy the new phone today and save a lot of money on every contract.</div>'
_FORM = '<form class="newsletter"><label>Your mail</label><input name=m><p>Sign up for our letter.</p></form>'
_HEAD = "<head><title>The new bridge</title><style>p{}</style><script>var a=1;</script></head>"
_SHARE = '<div class="share"><a href=#>Tweet</a> <a href=#>Mail</a></div>'


def _page(body: str) -> str:
    return f"<!DOCTYPE html><html>{_HEAD}<body>{body}</body></html>"


def labelled_pages() -> list[str]:
    """Every page with paragraphs of several lengths, so that length alone does
    not tell an article from a remark."""
    a, b, c = f"<p>{_TEXT}</p>", f"<p>{_SHORT}</p>", "<p>Three words only</p>"
    return [page for p, s in ((a, b), (b, c), (a + a, a), (c, "")) for page in _pages(p, s)]


def _pages(p: str, s: str) -> list[str]:
    h = "<h1>The new bridge</h1>"
    items = "<ul><li>The first point is the price of steel.</li><li>The second point is time.</li></ul>"
    return [
        _page(f"{_MENU}{_AD}<article data-main>{h}{p}{s}{p}</article>{_FOOT}"),
        _page(f"<header><div class=logo>Daily</div>{_MENU}</header><main><article data-main>{h}{p}<h2>Costs</h2>"
              f"{p}{items}</article></main>{_ASIDE}{_FOOT}"),
        _page(f"{_COOKIE}{_MENU}<div class=content data-main>{h}{p}{s}<blockquote>{_SHORT}</blockquote>{p}</div>"
              f"{_COMMENTS}{_FOOT}"),
        _page(f"{_MENU}<article data-main>{h}{p}<div class=ad data-off>Big sale, buy now.</div>{p}"
              f'<section class="comments" data-off><p>Nice text, thanks.</p><p>{_SHORT}</p></section></article>{_FOOT}'),
        _page(f"<div id=header>The Daily</div><div id=menu><a href=/>Home</a> <a href=/b>Blog</a></div>"
              f"<div id=main><div class=post data-main>{h}{p}{s}</div><div class=comments><p>{_TEXT}</p></div></div>"
              f"<div id=sidebar><p>About the author of this page.</p></div><div id=footer>Imprint</div>"),
        _page(f"{_MENU}<main data-main>{h}{s}{s}{s}</main>{_FORM}{_FOOT}"),
        _page(f"{_MENU}<article data-main><h1>Short</h1><p>Three words only.</p></article>{_ASIDE}{_FOOT}"),
        _page(f"<header>{_MENU}<p>The paper of the town since 1900.</p></header><article data-main>{h}{p}"
              f"<div class=share data-off><a href=#>Share</a></div>{p}<pre>x = 1</pre>"
              f"<table><tr><th>Year</th><td>Cost of the work</td></tr></table></article>{_AD}{_FOOT}"),
        _page(f"{_COOKIE}<div class=wrapper><div class=entry data-main>{h}{p}{p}</div>{_ASIDE}</div>{_FORM}{_FOOT}"),
        _page(f"{_MENU}<section data-main>{h}{p}{s}{items}</section>{_COMMENTS}{_SHARE}{_FOOT}"),
        _page(f"{_MENU}<article data-main><header>{h}</header>{p}{p}<footer data-off>Posted by A. B.</footer>"
              f"<form data-off><p>Tell a friend about this.</p></form></article>{_FOOT}"),
        _page(f"{_MENU}<article data-main>{h}{p}<aside data-off><p>{_SHORT}</p></aside><h3>Later</h3>{p}"
              f"<nav data-off><a href=/p>Previous</a> <a href=/q>Next</a></nav></article>{_AD}{_FOOT}"),
        _page(f"<div class=banner>Subscribe now for one coin.</div><div class=story data-main><p>{_TEXT}<p>{_SHORT}"
              f"<p>{_TEXT}</div><div class=notice><p>This page is archived and no longer updated.</p></div>{_FOOT}"),
        _page(f"{_MENU}<article data-main>{p}</article>{_FOOT}"),
        _page(f"{_MENU}<main data-main>{p}{s}</main>{_FOOT}"),
        _page(f"{_MENU}{_AD}<div data-main>{h}{p}</div>{_FOOT}"),
        _page(f"{_AD}<div class=wrapper><main><article data-main>{h}{s}{p}</article></main></div>{_FOOT}"),
        # an article's own remarks on rights stay
        _page(f"{_MENU}<article data-main>{h}{p}<p>Copyright protects the drawings of the bridge.</p>{s}"
              f"<p>Photo &copy; A. B.</p></article>{_FOOT}"),
        # layout tables, and menus and footers without a name
        _page(f"<table><tr><td><a href=/a>Start</a></td><td><a href=/b>Shop</a></td></tr></table>"
              f"<table><tr><td data-main>{h}{p}{s}</td></tr></table><p>&copy; 2009 Example</p>"),
        _page(f"<table><tr><td><a href=/a>Start</a><br><a href=/b>Archive</a></td><td data-main>{h}{s}{p}</td></tr></table>"
              f"<table><tr><td>Copyright 2011 by the Town Post</td></tr></table>"),
        _page(f"<div><a href=/a>Start</a> <a href=/b>Shop</a></div><div data-main>{h}{p}{s}"
              f"<p>See also <a href=/c>the plan</a> of the town.</p></div><div>Copyright 2011 by the Town Post</div>"),
        _page(f"<ul><li><a href=/a>Start</a></li><li><a href=/b>Team</a></li></ul><div data-main>{h}{p}{items}{s}"
              f"<p><a href=/c>The whole plan of the council, with its annexes.</a></p></div><div>&copy; Town Post. All rights reserved.</div>"),
    ]
