"""Pages written by hand in layouts unlike those of the training generator, with their main texts."""

BLOG = (
    """<!doctype html><html><head><title>Baking rye bread at home</title><link rel=stylesheet href=s.css></head><body class="single">
<div id="page" class="hfeed site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">The Crumb</a></h1><p class="site-description">Notes from a small kitchen</p>
<nav id="site-navigation" class="main-navigation"><ul class="menu"><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-7" class="post-7 post type-post hentry">
<header class="entry-header"><h1 class="entry-title">Baking rye bread at home</h1><div class="entry-meta"><span class="posted-on"><time>March 3, 2021</time></span> <span class="byline">by <a href="/a">Ann</a></span></div></header>
<div class="entry-content"><p>Rye flour takes up more water than wheat, so the dough stays sticky &mdash; that is normal.</p>
<h2>The starter</h2><p>Feed the starter <em>twice</em> on the day before. It should double within four hours.</p>
<ul><li>500 g rye flour</li><li>400 ml of water</li></ul><p>Bake for fifty minutes.</p></div>
<footer class="entry-footer"><span class="cat-links">Posted in <a href="/c">Bread</a></span></footer></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment even"><div class="comment-body"><p>Mine came out flat. What did I do wrong?</p></div></li>
<li class="comment odd"><div class="comment-body"><p>Wonderful, thank you for writing this down.</p></div></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/1">Oat cakes</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly baked by nobody</div></footer></div></body></html>""",
    "Baking rye bread at home\nRye flour takes up more water than wheat, so the dough stays sticky — that is normal.\nThe starter\nFeed the starter twice on the day before. It should double within four hours.\n500 g rye flour\n400 ml of water\nBake for fifty minutes.",
)

DOCUMENTATION = (
    """<html><body><div class="topbar"><ul class="nav"><li><a href="i">index</a></li><li><a href="m">modules</a> |</li></ul></div>
<div class="document"><div class="body" role="main"><section id="queue"><h1>Queues</h1><p>This module implements queues for several threads.</p>
<dl class="function"><dt>get(block)</dt><dd><p>Remove an item and return it. Waits while the queue is empty.</p></dd><dt>put(item)</dt><dd>Put an item into the queue.</dd></dl>
<div class="highlight"><pre>q = Queue()
q.put(1)</pre></div><p>See the source for more.</p></section></div></div>
<div class="sidebar"><h3>Table of contents</h3><ul><li><a href="#queue">Queues</a></li></ul></div><div class="footer">&copy; Copyright 2020, the authors.</div></body></html>""",
    "Queues\nThis module implements queues for several threads.\nget(block)\nRemove an item and return it. Waits while the queue is empty.\nput(item)\nPut an item into the queue.\nq = Queue() q.put(1)\nSee the source for more.",
)

TABLES = (
    """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD class=menu><A HREF=/>Home</A><BR><A HREF=/n>News</A><BR><A HREF=/l>Links</A></TD>
<TD class=content><H1>Our garden in spring</H1><P>The tulips came early this year and stood until the first week of May.<P>After them the irises opened, blue and yellow, along the whole fence.</TD></TR></TABLE></BODY></HTML>""",
    "Our garden in spring\nThe tulips came early this year and stood until the first week of May.\nAfter them the irises opened, blue and yellow, along the whole fence.",
)

NEWS = (
    """<html><body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><nav><a href="/"><svg class="icon"/> Start</a><a href="/w"><svg viewBox="0 0 1 1"><title>world</title><path d="M0 0"/></svg>World</a></nav>
<main><article><h1>Harbour reopens after the storm</h1><p class="byline">By Jo Field</p><figure><img src=a.jpg><figcaption>Ships wait outside the harbour on Monday.</figcaption></figure>
<p>The harbour was opened again on Tuesday morning.</p><div class="ad"><p>Buy our lamps today!</p></div><p>Forty ships had waited for two days.</p>
<blockquote><p>We have not seen waves like these before.</p></blockquote><noscript><p>The ferry runs again from Friday.</p></noscript></article></main>
<aside class="related"><h2>Related</h2><a href="/x">Storm takes a pier</a></aside><section class="comments"><p>Good that nobody was hurt.</p></section><footer><p>&copy; The Daily Quay</p></footer></body></html>""",
    "Harbour reopens after the storm\nShips wait outside the harbour on Monday.\nThe harbour was opened again on Tuesday morning.\nForty ships had waited for two days.\nWe have not seen waves like these before.\nThe ferry runs again from Friday.",
)

BROKEN = (
    """<html><head><title/></head><body><nav><ul><li><svg/><a href=/>Home</a><li><a href=/b>More</a></ul></nav><article><h1>On clocks</h1><p>A clock shows <math><mi>t</mi></math> in hours.</p><svg class='i'/>
<object data=x.swf/><p>Its pendulum swings once a second.</p><select><option>one<option>two<p>Longer pendulums swing more slowly than short ones.</p><math><mi>x</mi><p>That is all there is to say here.</p></article><footer>Imprint</footer>""",
    "On clocks\nA clock shows t in hours.\nIts pendulum swings once a second.\nLonger pendulums swing more slowly than short ones.\nx\nThat is all there is to say here.",
)

FORUM = (
    """<html><body><header class="site-header"><a class="logo" href="/">Town archive</a><form class="search" action="/s"><label>Search</label><input name=q><button>Go</button></form></header>
<div class="breadcrumbs"><a href="/">Archive</a> &gt; <a href="/h">History</a></div><div id="main-content" class="story"><h2>The old mill</h2><p>The mill was built in 1702 on the northern bank of the river and burnt down twice.</p>
<p>Its wheel can still be seen. The stones lie in the <a href="/m">museum</a> of the town.</p><table><tr><th>Year</th><th>Owner</th></tr><tr><td>1702</td><td>Abbey</td></tr></table></div>
<div class="share-buttons"><a href="#">Share</a><a href="#">Print</a></div><div id="comments" class="responses"><h3>Comments</h3><div class="comment"><p>My grandfather worked there.</p></div></div><div class="site-footer">All rights reserved.</div></body></html>""",
    "The old mill\nThe mill was built in 1702 on the northern bank of the river and burnt down twice.\nIts wheel can still be seen. The stones lie in the museum of the town.\nYear\nOwner\n1702\nAbbey",
)

LAYOUTS = {"blog": BLOG, "documentation": DOCUMENTATION, "tables": TABLES, "news": NEWS, "broken": BROKEN, "forum": FORUM}


_RIVER = "The river rose again during the night, and the lower meadows were under water until the next morning came."
_MILL = "Nobody in the village could remember a flood of this height, and the old marks on the mill wall prove it."
#: Pages that the contract decides: forms, links, depth, text without elements.
DECIDED = {
    "text behind a form": (f"<div class=post><p>{_RIVER}</p><form><p>Your name</p><button>Send</button></form><p>{_MILL}</p><p>{_RIVER}</p></div>", f"{_RIVER}\n{_MILL}\n{_RIVER}"),
    "a form in an article": (f"<article><p>{_RIVER}</p><form>Email / Subscribe to our newsletter today.</form><p>{_MILL}</p></article>", f"{_RIVER}\n{_MILL}"),
    "a paragraph of links": (f"<article><p>See <a href=/a>The dam</a> and <a href=/b>The mill</a>.</p><p>{_RIVER}</p></article>", f"See The dam and The mill.\n{_RIVER}"),
    "a deep page": ("<div>" * 300 + f"<p>{_RIVER}</p>" + "</div>" * 300, _RIVER),
    "text alone": (_RIVER, _RIVER),
    "a page in a form": (f"<body><form id=aspnetForm><div class=header><a href=/>Home</a></div><div class=content><h1>Floods</h1><p>{_RIVER}</p><p>{_MILL}</p></div><div class=footer>&copy; 2020</div></form></body>", f"Floods\n{_RIVER}\n{_MILL}"),
}

#: More pages by hand, each as (html, texts of its blocks with 1 where they are of the article).
MORE = [
    ("""<body><div id=top><a href=/>Herald</a></div><div id=story><h1>Bridge closes for repairs</h1><span class=author>Kim Lee</span><p>The bridge over the Wend closes on Monday for eleven weeks.</p><p>Buses go by the old road, which takes ten minutes more.</p><div class=promo><p>Get the paper at home</p></div><p>The town pays two thirds of the costs.</p></div><div id=foot>Contact | Terms</div></body>""",
     [("Herald", 0), ("Bridge closes for repairs", 1), ("Kim Lee", 0), ("The bridge over the Wend closes on Monday for eleven weeks.", 1), ("Buses go by the old road, which takes ten minutes more.", 1), ("Get the paper at home", 0), ("The town pays two thirds of the costs.", 1), ("Contact | Terms", 0)]),
    ("""<main><h1>Lentil soup</h1><p>A soup for cold days that needs no stock.</p><h2>Ingredients</h2><ul><li>300 g red lentils</li><li>1 onion</li><li>Salt</li></ul><h2>Method</h2><ol><li>Cut the onion and fry it slowly.</li><li>Add the lentils and a litre of water.</li></ol><form class=rating><label>Rate this recipe</label><button>Send</button></form><p>It keeps for three days.</p></main><aside><h3>More soups</h3><a href=/1>Leek soup</a></aside>""",
     [("Lentil soup", 1), ("A soup for cold days that needs no stock.", 1), ("Ingredients", 1), ("300 g red lentils", 1), ("1 onion", 1), ("Salt", 1), ("Method", 1), ("Cut the onion and fry it slowly.", 1), ("Add the lentils and a litre of water.", 1), ("Rate this recipe", 0), ("Send", 0), ("It keeps for three days.", 1), ("More soups", 0), ("Leek soup", 0)]),
    ("""<nav class=breadcrumb><a href=/>Docs</a></nav><article><h1>Installing the tool</h1><p>Unpack the archive into a folder of your own.</p><pre>tar xf tool.tar</pre><p>Then read <a href=/c>the configuration</a>, <a href=/p>the plugins</a> and <a href=/f>the list of faults</a>.</p><table><tr><td>port</td><td>8080</td></tr></table></article><div class=pager><a href=/n>Next</a></div>""",
     [("Docs", 0), ("Installing the tool", 1), ("Unpack the archive into a folder of your own.", 1), ("tar xf tool.tar", 1), ("Then read the configuration, the plugins and the list of faults.", 1), ("port", 1), ("8080", 1), ("Next", 0)]),
    ("""<header class=site-header><p>Notes on birds</p></header><div class=entry><h2>Swifts are back</h2><p>The first swifts came on the third of May, four days later than last year.</p><p>They nest below the roof of the town hall.</p><div class=newsletter><h4>Never miss a note</h4><form><input><button>Join</button></form></div></div><section class=comments><h3>3 comments</h3><article class=comment><p>I saw two of them on Sunday as well.</p></article></section>""",
     [("Notes on birds", 0), ("Swifts are back", 1), ("The first swifts came on the third of May, four days later than last year.", 1), ("They nest below the roof of the town hall.", 1), ("Never miss a note", 0), ("Join", 0), ("3 comments", 0), ("I saw two of them on Sunday as well.", 0)]),
    ("""<div class=wrap><div class=cookie-notice>This site stores cookies.</div><div class=post-content><p>Glass is made of sand, soda and lime. The sand melts at a lower heat with soda.</p><p>Lime keeps the glass from dissolving in water.</p><blockquote><p>No craft asks for more patience.</p></blockquote></div><div class=related-posts><p>Read next: how mirrors are made</p></div></div>""",
     [("This site stores cookies.", 0), ("Glass is made of sand, soda and lime. The sand melts at a lower heat with soda.", 1), ("Lime keeps the glass from dissolving in water.", 1), ("No craft asks for more patience.", 1), ("Read next: how mirrors are made", 0)]),
    ("""<table width=760><tr><td class=nav><a href=a>News</a> | <a href=b>Team</a></td></tr><tr><td><h1>Season opens</h1><p>The season opens on the ninth with a match against the neighbours.</p><p>Seats are free for children.</p></td></tr></table>""",
     [("News | Team", 0), ("Season opens", 1), ("The season opens on the ninth with a match against the neighbours.", 1), ("Seats are free for children.", 1)]),
    ("""<ul class=menu><li><a href=/>Home</a></li><li><a href=/q>Questions</a></li></ul><div class=content><h1>Why is the sky blue?</h1><div class=text><p>I asked this as a child and never got an answer that I could follow.</p></div></div><div class=sidebar><h4>Popular</h4><ul><li><a href=/1>Why is snow white?</a></li></ul></div><div class=footer><p>All rights reserved.</p></div>""",
     [("Home", 0), ("Questions", 0), ("Why is the sky blue?", 1), ("I asked this as a child and never got an answer that I could follow.", 1), ("Popular", 0), ("Why is snow white?", 0), ("All rights reserved.", 0)]),
    ("""<section class=hero><article><h1>Ein neuer Park am Fluss</h1><p>Die Stadt legt am Nordufer einen Park mit zweihundert Bäumen an.</p><figure><img><figcaption>Der Plan des Parks.</figcaption></figure><p>Er soll im Herbst fertig sein.</p></article></section><div class=share><a href=#>Teilen</a></div><footer><p>Impressum</p></footer>""",
     [("Ein neuer Park am Fluss", 1), ("Die Stadt legt am Nordufer einen Park mit zweihundert Bäumen an.", 1), ("Der Plan des Parks.", 1), ("Er soll im Herbst fertig sein.", 1), ("Teilen", 0), ("Impressum", 0)]),
    ("""<h1>Minutes of the meeting</h1><p>Present were nine members of the club.</p><p>The treasurer gave her report, which was approved.</p><p>The next meeting is in March.</p>""",
     [("Minutes of the meeting", 1), ("Present were nine members of the club.", 1), ("The treasurer gave her report, which was approved.", 1), ("The next meeting is in March.", 1)]),
    ("""<div class=banner-ad><p>Cheap flights to the sun!</p></div><article><h1>The long winter</h1><p>Snow lay until the end of April in the upper valley.</p><aside class=ad><p>Warm coats, half price.</p></aside><p>Farmers sowed three weeks late.</p><form class=search-form><label>Search the archive</label></form><p>The harvest was small.</p><footer class=tags><a href=/w>Weather</a></footer></article>""",
     [("Cheap flights to the sun!", 0), ("The long winter", 1), ("Snow lay until the end of April in the upper valley.", 1), ("Warm coats, half price.", 0), ("Farmers sowed three weeks late.", 1), ("Search the archive", 0), ("The harvest was small.", 1), ("Weather", 0)]),
]
