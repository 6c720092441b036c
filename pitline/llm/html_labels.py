"""The labelled table of the block classifier: small pages, and for each block 1 if it is article.

Labels are given in block order. The pages are written by hand to show each kind of surrounding with
and without marks in the markup, so that the tree learns both.
"""

_LONG = "A paragraph of running text that goes on for quite a while and holds many words in a row. "
_MORE = "Another sentence follows it, with commas, with clauses, and with nothing to click on at all."
_MENU = "<a href='/1'>Start</a> <a href='/2'>All the news</a> <a href='/3'>Everything about us</a> "
_SAME = "<a href='/4'>Ten things that you should also read</a> <a href='/5'>What others have read</a> "

PAGES = (
    # Marked article between menu, advert and footer.
    (
        "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
        "<div class='ad'>Buy one of these now and get a second one for half of the price.</div>"
        f"<article><h1>A title</h1><p>{_LONG}</p><p>Short one.</p><p>{_MORE}</p></article>"
        "<footer>All rights reserved, of this and of other pages, by the owner.</footer>",
        "000" + "1111" + "0",
    ),
    # Short articles, long surroundings.
    (
        f"<header><div>The Daily Page</div></header><aside>{_LONG}{_MORE}</aside>"
        "<article><h1>Word</h1><p>Yes.</p></article>"
        f"<div class='cookie-notice'>{_LONG}</div><footer>{_MORE}</footer>",
        "00" + "11" + "00",
    ),
    # Main element with its own header; links inside the text.
    (
        "<header><h1>Site</h1><p>Our motto is here.</p></header>"
        f"<main><header><h1>Title of it</h1></header><p>{_LONG}<a href='/x'>a link</a></p>"
        f"<ul><li><a href='/1'>A linked item</a></li><li>Plain item</li></ul><p>{_MORE}</p>"
        "<div class='share'><a href='/s'>Share</a></div></main>"
        f"<div id='comments'><p>{_MORE}</p><p>Me too.</p></div>",
        "00" + "1" + "1" + "11" + "1" + "0" + "00",
    ),
    # Things inside an article that aren't part of it.
    (
        f"<article><h2>Head</h2><p>{_LONG}</p><aside>Read this too, {_MORE}</aside><p>On it goes.</p>"
        f"<form>Your name <input><p>{_LONG}</p></form><nav><a href='/2'>Next page</a></nav>"
        f"<div class='related'><p>{_LONG}</p></div><section class='comments'><p>{_MORE}</p>"
        f"</section><footer>Filed under things</footer></article>",
        "11" + "0" + "1" + "00" + "0" + "0" + "0" + "0",
    ),
    # Quotes, tables, code and single words in an article.
    (
        f"<article><blockquote>{_MORE}</blockquote><table><tr><td>One</td><td>2</td></tr></table>"
        f"<pre>x = 1</pre><p><a href='/only'>Only a link here in the text</a></p><p>{_LONG}</p>"
        "<p>End</p></article>",
        "1" + "11" + "11" + "1" + "1",
    ),
    # No marks at all: the figures of a block and its neighbours decide.
    (
        "<div><a href='/a'>Start</a></div><div><a href='/b'>Products we sell</a></div>"
        f"<div><a href='/c'>Contact</a></div><div>{_LONG}</div><div>{_LONG}{_MORE}</div>"
        f"<div>{_MORE}</div><div><a href='/d'>Imprint</a></div><div><a href='/e'>Privacy</a></div>",
        "000" + "111" + "00",
    ),
    (
        "<div><a href='/a'>One</a> | <a href='/b'>Two</a></div>"
        f"<p>{_LONG}</p><p>Then a short line.</p><p>{_MORE}{_LONG}</p>"
        "<div><a href='/d'>More from us, all of it linked</a></div><div>Copyright</div>",
        "0" + "111" + "00",
    ),
    # A whole page that is nothing but one text, marked and unmarked.
    (f"<p>{_LONG}{_MORE}</p>", "1"),
    ("<article>Tiny</article>", "1"),
    (f"<div class='content'><p>{_MORE}</p><p>Ok.</p></div><div class='sidebar'>{_LONG}</div>", "110"),
    ("<div class='newsletter'>Sign up</div><article><p>Go</p></article><div>Tail</div>", "010"),
    # Telling names around the article, a form around the page, names that only mention something.
    (f"<div class='layout has-sidebar'><article><p>{_LONG}</p><p>Go.</p></article></div>", "11"),
    (f"<div class='sidebar'><div>{_MENU}</div><main><p>{_LONG}</p><p>Go.</p></main></div>", "011"),
    (f"<form><div class='menu'>Log in</div><article><p>{_MORE}</p><p>Go.</p></article></form>", "011"),
    (f"<div class='widget-content'><p>{_LONG}</p><p>Go.</p></div><div>Tail</div>", "110"),
    (
        "<div class='site-header'><p>The Daily Page</p></div><article><div class='post-header'><h1>Title"
        f"</h1></div><p>{_MORE}</p></article><section id='comments'><article><p>{_LONG}</p></article></section>",
        "0" + "11" + "0",
    ),
    # Without marks: menus before and after, also long ones; lists of links within the text.
    (f"<div>{_LONG}</div><div><a href='/m'>Menu</a></div>", "10"),
    (
        f"<div>{_MENU}{_SAME}</div><h1>A headline</h1><div>{_LONG}{_MORE}</div><div>{_SAME}{_MENU}{_SAME}"
        f"</div><div>{_MORE}</div><div>Yes, it is.</div><div>{_LONG}</div><div>{_SAME}</div>",
        "0" + "11" + "0" + "111" + "0",
    ),
    (
        f"<div>Sections</div><div>{_MENU}</div><div>More of them</div><div>{_MENU}{_SAME}</div>"
        f"<div>{_LONG}{_LONG}</div><div>{_MORE}</div><div>Read on</div><div>{_SAME}</div><div>The end</div>",
        "0000" + "11" + "000",
    ),
    (
        f"<div>{_SAME}</div><div>Seen today, and also this: {_SAME}</div><div>{_MENU}</div>"
        f"<p>{_MORE}</p><p>It was <a href='/x'>said</a> so.</p><p>{_LONG}<a href='/y'>as told here</a></p>"
        f"<div>Follow: <a href='/f'>by mail</a> <a href='/g'>by post</a></div><div>{_MENU}{_MENU}</div>",
        "000" + "111" + "00",
    ),
    # Plain lines are article or not by the links of their neighbours, at equal lengths.
    (
        f"<div>{_MENU}</div><div>Sections of this site today</div><div>{_SAME}{_MENU}</div><div>{_LONG}</div>"
        f"<div>That is how it was.</div><div>{_MORE}</div><div>So they said of it.</div><div>{_SAME}{_MENU}"
        f"</div><div>All rights reserved by the owner</div><div>{_MENU}{_MENU}{_SAME}</div>"
        f"<div>Write to us about this page</div><div>{_SAME}{_MENU}</div>",
        "000" + "1111" + "00000",
    ),
    (
        f"<div>{_MENU}{_SAME}</div><h2>What came of it all</h2><div>{_LONG}</div><div>It was to be so.</div>"
        f"<div>{_MORE}{_LONG}</div><div>That was all of it.</div>",
        "0" + "11111",
    ),
    (
        f"<div>{_LONG}{_MORE}</div><div>Nobody knew it then.</div><div>{_SAME}{_MENU}{_MENU}</div>"
        f"<div>Made with care in town</div><div>{_MENU}{_SAME}{_SAME}</div>",
        "11" + "000",
    ),
    # The same lines inside an article all belong to it, whatever their links.
    (
        f"<article><p>{_MENU}</p><p>Sections of this site today</p><p>{_SAME}{_MENU}</p><p>Two</p>"
        "<p><a href='/n'>Next</a></p><p>End of it</p><p><a href='/o'>One by one</a></p></article>",
        "1111111",
    ),
    (
        f"<main><div>{_SAME}</div><div>Made with care in town</div><div>{_MENU}</div><div>No</div>"
        f"<div>{_LONG}</div><div><a href='/p'>Go</a></div><div>Write to us about this page</div></main>",
        "1111111",
    ),
    # A header of the site may hold running text too.
    (f"<header><p>{_LONG}</p><p>{_MORE}</p></header><div>{_LONG}</div><div>{_MORE}</div>", "0011"),
    (f"<div id='header'>{_MORE}</div><p>{_LONG}</p><div class='footer'>{_LONG}</div>", "010"),
    # Short headlines after short menus.
    (f"<div>{_MENU}</div><h1>Word play</h1><div>{_LONG}</div><div>{_MENU}</div>", "0110"),
    (f"<p><a href='/'>Home</a></p><h2>Rain</h2><p>{_MORE}</p><h2>Sun</h2><p>{_LONG}</p>", "01111"),
    (
        f"<div>{_MENU}</div><div>Sections of the site</div><div>{_MENU}</div><div>Pages of our own</div>"
        f"<div>{_MENU}</div><div>{_LONG}</div><div>That is how it was.</div><div>{_MENU}</div>"
        f"<div>Sent out every day</div><div>{_MENU}</div>",
        "00000" + "11" + "000",
    ),
    # Talk in short lines between paragraphs.
    (
        f"<div>{_MENU}</div><p>{_MORE}</p><p>It was raining again on that day.</p><p>Was it so?</p>"
        f"<p>No one came to the door that night.</p><p>So they left it all behind.</p><p>{_LONG}</p>"
        f"<p>And there it ends for all of us.</p><div>{_MENU}{_SAME}</div>",
        "0" + "1111111" + "0",
    ),
    # Articles of nothing but short lines and links.
    ("<article><p>One two three four</p><p>End</p></article>", "11"),
    ("<main><p>It is so</p><p>No</p><p><a href='/q'>Linked</a></p><p>Go</p></main>", "1111"),
    ("<article><p>Plain</p><p>No</p><p><a href='/r'>More of it</a></p><p>The end</p></article>", "1111"),
    (f"<article><p><a href='/s'>See</a></p><p>{_MENU}</p><p>So</p><p><a href='/t'>This</a></p></article>", "1111"),
)
