"""Pages marked by hand, not by the rules that teach the labeller.

A line is (whether it belongs to the article, text), or (None, markup)."""

S = "The river rose by two metres during the night, and the town council met early to decide what should be done."
T = "Volunteers filled sandbags until noon; the school stayed shut, and trains were held at the last dry station."
U = "By evening the water had fallen again, though engineers warned that the next storm was only two days away."

PAGES = [
    # a news page: masthead, navigation with many classes around plain containers, sidebar, comments behind the article
    [
        (None, "<html><head><title>"), (False, "Flood news"), (None, "</title><script src=a.js /></script></head><body>"),
        (None, "<header class='masthead'><h2>"), (False, "The Daily Brook"), (None, "</h2></header><nav class='a b c d e f g h nav-main'><div><div><div><div><div><ul><li><a href=1>"), (False, "Home"),
        (None, "</a><li><a href=2>"), (False, "Sport and weather"), (None, "</a></ul></div></div></div></div></div></nav><main><article><h1>"), (True, "Night of the flood"),
        (None, "</h1><p>"), (True, S), (None, "<p>"), (True, T), (None, "</p><div class='advert'><p>"), (False, "Buy two boats, get one free."), (None, "</p></div><p>"), (True, U),
        (None, "</p><section class='comments'><p>"), (False, "I saw it from my window, it was terrible and loud."), (None, "</p></section></article></main><aside class='sidebar'><ul><li>"), (False, "Most read today"),
        (None, "</ul></aside><footer><p>"), (False, "All rights reserved."), (None, "</p></footer></body></html>"),
    ],
    # a blog in plain containers with an article by name only, notice and form
    [
        (None, "<body><div id='wrapper'><div class='cookie-notice'><p>"), (False, "We use cookies to remember you."), (None, "</p></div><div class='content'><h2>"), (True, "On mending nets"),
        (None, "</h2><p>"), (True, T), (None, "</p><ul><li>"), (True, "Needle and twine"), (None, "<li>"), (True, "A quiet afternoon"), (None, "</ul><p>"), (True, S),
        (None, "</p></div><div class='newsletter'><form><label>"), (False, "Your address"), (None, "</label></form></div><div class='related'><ul><li><a>"), (False, "On boats"), (None, "</a></ul></div><div class='footer'>"), (False, "Imprint"), (None, "</div></div>"),
    ],
    # everything lies many containers deep
    [
        (None, "<body>" + "<div class='x1 y2'>" * 20 + "<nav><ul>" + "<div>" * 15), (False, "Start page"), (None, "</div>" * 15 + "</ul></nav>" + "<article>" + "<div>" * 15 + "<p>"), (True, S), (None, "</p><blockquote>"), (True, U),
        (None, "</blockquote><p>"), (True, T), (None, "</p>" + "</div>" * 15 + "</article><aside>" + "<div>" * 15), (False, "More stories"), (None, "</div>" * 15 + "</aside>" + "</div>" * 20),
    ],
    # a page with a table and a definition list within main, breadcrumbs and share links around
    [
        (None, "<body><div class='breadcrumbs'><a>"), (False, "Home / Tools"), (None, "</a></div><main><h1>"), (True, "Heights of the river"), (None, "</h1><table><tr><td>"), (True, "Monday"), (None, "<td>"), (True, "2.1 m"),
        (None, "</table><dl><dt>"), (True, "Crest"), (None, "<dd>"), (True, S), (None, "</dl><div class='share'>"), (False, "Share this page"), (None, "</div><p>"), (True, U), (None, "</p></main><div class='banner'>"), (False, "Sale ends soon"), (None, "</div>"),
    ],
    # an advert in its own box and a listing of code within the article
    [
        (None, "<body><article><h1>"), (True, "Boots for the river"), (None, "</h1><p>"), (True, S), (None, "</p><div class='ad'><p>"), (False, "Buy cheap boots today and save."), (None, "</p></div><p>"), (True, T),
        (None, "</p><pre>"), (True, "x = 1 y = 2"), (None, "</pre><p>"), (True, U), (None, "</p></article></body>"),
    ],
    # code and a table in main, nothing else
    [(None, "<body><main><h1>"), (True, "How to count"), (None, "</h1><p>"), (True, S), (None, "</p><pre>"), (True, "x = 1"), (None, "</pre><table><tr><th>"), (True, "Step"), (None, "</th><td>"), (True, "One"), (None, "</td></tr></table></main></body>")],
    # three columns whose names say nothing
    [
        (None, "<body><div class='col1'><ul><li><a href=a>"), (False, "Home"), (None, "</a></li><li><a href=b>"), (False, "News"), (None, "</a></li><li><a href=c>"), (False, "Contact"), (None, "</a></li></ul></div><div class='col2'><h1>"), (True, "The flood of the year"),
        (None, "</h1><p>"), (True, S), (None, "</p><p>"), (True, T), (None, "</p><p>"), (True, U), (None, "</p></div><div class='col3'><p>"), (False, "All rights reserved 2024."), (None, "</p></div></body>"),
    ],
    # other names for adverts, comments and boxes
    [
        (None, "<body><div id='page'><div class='site-header'><p>"), (False, "The Brook"), (None, "</p></div><ul id='menu'><li><a>"), (False, "Start"), (None, "</a></li><li><a>"), (False, "Archive"), (None, "</a></li></ul><div class='post-body'><h2>"), (True, "After the water"),
        (None, "</h2><p>"), (True, T), (None, "</p><div class='sponsored-links'><a>"), (False, "Boats at half price"), (None, "</a></div><p>"), (True, S), (None, "</p><div id='disqus_thread'><p>"), (False, "Great read, thanks for that."), (None, "</p></div></div><div id='site-footer'><p>"), (False, "Terms of use"), (None, "</p></div></div></body>"),
    ],
    # reader comments within the article element, a login form behind
    [
        (None, "<body><nav><a>"), (False, "Top"), (None, "</a></nav><article><h2>"), (True, "A quiet day"), (None, "</h2><p>"), (True, U), (None, "</p><ol><li>"), (True, "Boil the water"), (None, "</li><li>"), (True, "Dry the hall"), (None, "</li></ol><div class='comment-list'><div class='comment'><p>"),
        (False, "We were there too and it was awful to see."), (None, "</p></div><div class='comment'><p>"), (False, "Thanks to all who helped."), (None, "</p></div></div></article><form class='login'><label>"), (False, "Name"), (None, "</label></form></body>"),
    ],
    # a reference page: definitions, captions, quotation
    [
        (None, "<body><header><h2>"), (False, "Handbook"), (None, "</h2></header><main><section><h2>"), (True, "Terms"), (None, "</h2><dl><dt>"), (True, "Weir"), (None, "</dt><dd>"), (True, S), (None, "</dd></dl><figure><figcaption>"), (True, "A weir in spring"), (None, "</figcaption></figure><blockquote>"), (True, T),
        (None, "</blockquote></section></main><aside><p>"), (False, "See also"), (None, "</p></aside><footer>"), (False, "Printed in the valley"), (None, "</footer></body>"),
    ],
]


def page(lines) -> str:
    return "".join(x for _, x in lines)
