"""Labelled pages from which the extraction model is trained.

The attribute ``y`` labels an element and what is in it: c main content, b boilerplate,
n a container that is neither. ``{s}`` is a short phrase, ``{m}`` a sentence, ``{l}`` a
long paragraph; the words carry no meaning.
"""

S = "Orvin telda"
M = "The marn of velt was ord and then, in the tolm, a sarn of kelts came by."
L = " ".join([M] * 5)

_NAV = '<nav y="b"><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li><li><a href="/c">{s}</a></li></ul></nav>'
_FOOT = '<footer y="b">&copy; {s} &middot; {m}</footer>'

PAGES = [
    '<html y="n"><body>' + _NAV + '<div class="ad" y="b">{m}</div><article y="c"><h1>{s}</h1><p>{l}</p><p>{m}</p><p>{l}</p></article>' + _FOOT + "</body></html>",
    '<html y="n"><body>' + _NAV + '<div class="ad" y="b">{l}</div><article y="c"><h1>{s} {s}</h1><p>{s}.</p><p>{m}</p></article>' + _FOOT + "</body></html>",
    '<html y="n"><body>' + _NAV + '<article y="c"><h1>{s}</h1><p><b>{l}<br><p>{l}</p><p>{s}</p></article><aside y="b"><h3>{s}</h3><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></aside>' + _FOOT + "</body></html>",
    '<html y="n"><body><header class="site-header" y="b"><h2>{s}</h2><p>{m}</p></header>' + _NAV + '<main y="c"><h1>{s}</h1><p>{l}</p><h2>{s}</h2><p>{m}</p><ul><li>{m}</li><li>{s}</li></ul><blockquote><p>{m}</p></blockquote><pre>{m}</pre></main>' + _FOOT + "</body></html>",
    '<html y="n"><body><div id="header" y="b"><a>{s}</a></div><div id="menu" y="b"><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></div><div id="wrapper"><div id="content" class="post" y="c"><h1>{s}</h1><p>{l}</p><p>{m}</p></div><div id="sidebar" y="b"><h3>{s}</h3><p>{m}</p><a>{s}</a></div></div><div id="footer" y="b"><p>{m}</p></div></body></html>',
    '<html y="n"><body>' + _NAV + '<article y="c"><header><h1>{s}</h1></header><p>{l}</p><div class="advert" y="b"><p>{m}</p></div><p>{l}</p><form class="newsletter" y="b"><label>{m}</label><button>{s}</button></form><p>{m}</p></article><section id="comments" class="comments" y="b"><h2>{s}</h2><article class="comment"><p>{m}</p></article><div class="comment"><p>{l}</p></div></section>' + _FOOT + "</body></html>",
    '<html y="n"><body><div class="cookie-notice" y="b"><p>{m}</p><button>{s}</button></div>' + _NAV + '<div class="container"><div class="entry-content" y="c"><p>{l}</p><p>{l}</p><table><tr><td>{s}</td><td>{m}</td></tr></table></div></div><div class="related" y="b"><h3>{s}</h3><ul><li><a>{s}</a></li><li><a>{m}</a></li></ul></div>' + _FOOT + "</body></html>",
    '<html y="n"><body><table><tr><td class="nav" y="b"><a>{s}</a><br><a>{s}</a></td><td class="story" y="c"><h1>{s}</h1><p>{l}</p><p>{m}</p></td><td class="right" y="b"><a>{m}</a></td></tr></table><div class="copyright" y="b">{m}</div></body></html>',
    '<html y="n"><body><section class="hero banner" y="b"><h2>{s}</h2><a>{s}</a></section><section class="article-body" y="c"><h1>{s}</h1><p>{m}</p><figure><figcaption>{m}</figcaption></figure><p>{l}</p><ol><li>{m}</li><li>{m}</li></ol></section><div class="share social" y="b"><a>{s}</a><a>{s}</a></div><div class="sponsor promo" y="b"><p>{l}</p></div>' + _FOOT + "</body></html>",
    '<html y="n"><body><div class="breadcrumb" y="b"><a>{s}</a> / <a>{s}</a></div><p y="c">{l}</p><p y="c">{l}</p><p y="c">{m}</p><form action="/q" y="b"><label>{s}</label><select><option>{s}</option></select></form><div class="notice alert" y="b">{m}</div></body></html>',
    '<html y="n"><body><header y="b">' + _NAV + '<form class="search"><label>{s}</label></form></header><main><article y="c"><h1>{s}</h1><div class="byline"><p>{s}</p></div><div class="text"><p>{l}</p><p>{m}</p><dl><dt>{s}</dt><dd>{m}</dd></dl></div><aside y="b"><p>{m}</p></aside><div class="tags" y="b"><a>{s}</a><a>{s}</a></div></article></main><aside class="widget" y="b"><p>{l}</p></aside><div id="disqus_thread" class="replies" y="b"><ul><li><p>{m}</p></li><li><p>{l}</p></li></ul></div>' + _FOOT + "</body></html>",
    '<html y="n"><body>' + _NAV + '<div class="page"><div class="main"><div class="article" y="c"><h2>{s}</h2><p>{m}</p><p>{l}</p><p>{s}.</p></div><div class="pagination" y="b"><a>{s}</a></div></div><div class="side-bar" y="b"><div class="box"><p>{l}</p></div></div></div><div class="foot legal" y="b"><p>{l}</p></div></body></html>',
    '<html y="n"><body><div role="navigation" y="b"><a>{s}</a><a>{s}</a></div><div role="main" y="c"><h1>{s}</h1>{m}<p>{l}</p>{l}</div><div role="complementary" y="b"><p>{m}</p></div><div role="contentinfo" y="b">{m}</div></body></html>',
]


# Boilerplate around and inside the content, and ways to hold the content.
AROUND = [
    _NAV,
    '<header y="b"><h1>{s}</h1><p>{m}</p></header>',
    '<div class="ad" y="b">{m}</div>',
    '<aside y="b"><p>{l}</p></aside>',
    '<div id="comments" y="b"><p>{l}</p><p>{m}</p></div>',
    '<form y="b"><label>{s}</label><input><button>{s}</button></form>',
    '<div class="cookie-banner" y="b"><p>{l}</p><button>{s}</button></div>',
    '<div class="sidebar" y="b"><h3>{s}</h3><p>{l}</p></div>',
    '<ul class="menu" y="b"><li><a>{s}</a></li><li><a>{s}</a></li></ul>',
    '<section class="comments" y="b"><h3>{s}</h3><ol><li><p>{m}</p></li><li><p>{l}</p></li></ol></section>',
    '<div role="alert" class="notice" y="b"><p>{m}</p></div>',
    '<div class="advertisement" y="b"><h3>{s}</h3><p>{l}</p><a>{s}</a></div>',
    '<aside y="b"><h2>{s}</h2><ul><li><a>{m}</a></li><li><a>{s}</a></li></ul></aside>',
    '<div class="related-posts" y="b"><h3>{s}</h3><p><a>{m}</a></p><p><a>{m}</a></p></div>',
    '<form class="search" y="b"><input><button>{s}</button></form>',
    '<div id="footer" y="b"><p>{m}</p><p><a>{s}</a></p></div>',
    '<section id="respond" y="b"><h3>{s}</h3><form><label>{s}</label><textarea></textarea><button>{m}</button></form></section>',
]
HOLD = [
    '<article y="c">{x}</article>',
    '<main y="c">{x}</main>',
    '<main><article y="c">{x}</article></main>',
    '<div id="content" y="c">{x}</div>',
    '<div class="wrapper"><div class="post-body" y="c">{x}</div></div>',
    '<div><section class="entry" y="c">{x}</section></div>',
    '<div y="c">{x}</div>',
]
BODY = [
    "<h1>{s}</h1><p>{l}</p><p>{m}</p>{i}<p>{l}</p>",
    "<h2>{s}</h2><p>{m}<p>{l}<ul><li>{m}<li>{s}.</ul>{i}",
    "<h1>{s} {s}</h1>{i}<p>{l}</p><blockquote>{m}</blockquote><h3>{s}</h3><ol><li>{m}</li></ol><p>{s}</p>",
    "<h1>{m}</h1><p>{s}.</p>",
    "<h1>{s}</h1><p><b>{m}<br><p>{s}</p>{i}",
    "<h1>{s} {s}</h1><p><b>{m}<br></p><p>{m}</p>{i}<p>{s}</p>",
    "<h1>{s}</h1><p>{m}</p>",
    "<p>{m}</p><p>{m}</p><table><tr><th>{s}</th><td>{m}</td></tr></table><pre>{m}</pre>{i}<p>{s}.</p>",
]


def composed(n: int = 119) -> list[str]:
    """Every holder with every body, and each piece of boilerplate before, after and inside it."""
    out = []
    for k in range(n):
        part = lambda j: AROUND[(k + j) % len(AROUND)]  # noqa: E731,B023
        body = BODY[k % len(BODY)].replace("{i}", part(5) if k % 2 else "")
        hold = HOLD[k % len(HOLD)].replace("{x}", body)
        out.append('<html y="n"><body>' + part(0) + part(7) + hold + part(3) + part(11) + (_FOOT if k % 3 else "") + "</body></html>")
    return out


def pages() -> list[str]:
    return [p.replace("{s}", S).replace("{m}", M).replace("{l}", L) for p in [*PAGES, *composed()]]
