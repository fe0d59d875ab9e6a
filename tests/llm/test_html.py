from metricloom.llm import html_extract as X

LONG = "This is a sentence of the article that goes on for a while and says something. "


def test_article_with_everything_around():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{x}}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
    <div class="ad">Buy<div>now</div></div><div id="cookie-notice"><p>We use cookies {LONG}</p></div>
    <article class="post"><h2>Head&shy;line</h2><p>{LONG}<br>A  &lt;b&gt; &amp;amp; <b>bold</b>ed
    line.<p>Short.<!-- <p>no --><aside>{LONG}</aside><ul><li>one<li>two</ul><form><p>{LONG}</form>
    <table><tr><td>cell</td><td>&#x41;&#66;&eacute</td></tr></table><p>End.</p><div class="comments"><p>{LONG}</p></div></article>
    <div class="sidebar"><p>{LONG * 5}</p></div><section id="comments"><article><p>{LONG}</article></section><footer>&copy; me</footer></body></html>"""
    assert X.main_text(page).split("\n") == [
        "Head\u00adline", LONG.strip() + " A <b> &amp; bolded line.", "Short.", "one", "two", "cell", "ABé", "End.",
    ]


def test_no_main_element_takes_the_longest_stretch():
    page = f"<body><div>Home</div><div class=menu>x</div><div>{LONG}</div><p>tail</p><nav>n</nav><p>other</body>"
    assert X.main_text(page) == f"{LONG.strip()}\ntail"


def test_parts_between_paragraphs_do_not_end_the_text():
    a, b, d = (f"{k}: {LONG.strip()}" for k in "abd")
    assert X.main_text(f"<body><div><p>{a}</p><div class=ad>x</div><p>{b}</p></div></body>") == f"{a}\n{b}"
    between = ["<aside>n</aside>", "<figure><img src=x></figure>", "<button>Buy</button>", "<svg><text>t</text></svg>", "<form>f</form>",
               "<video>v</video>", "<select><option>o</select>", "<div class='share social'>s</div>", "<p class=advert>x</p>" * 9]
    for x in between:
        assert X.main_text(f"<body><nav>n</nav><p>{a}</p>{x}<p>{b}</p>{x}<p>No.</p>{x}<p>{d}</p><footer>f</footer></body>") == f"{a}\n{b}\nNo.\n{d}"
    assert X.main_text(f"<body><p>{a} <button>Buy</button> {b}</p>") == f"{a} {b}"


def test_link_lists_without_marks_are_no_text():
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Another page of this site {i}</a></li>" for i in range(9)) + "</ul>"
    text = f"<p>{LONG} <a href=x>link</a></p><ul><li>one<li>two<li>three<li>four</ul><p><a href=y>{LONG}</a></p><p>{LONG}</p>"
    want = [f"{LONG.strip()} link", "one", "two", "three", "four", LONG.strip(), LONG.strip()]
    assert X.main_text(f"<body><div>{links}</div>{text}{links}</body>").split("\n") == want
    assert X.main_text(f"<body>{text}{links}{text}</body>").split("\n") == want * 2
    assert X.main_text(f"<body><p><a href=x>{LONG}<p>{LONG}</body>").split("\n") == [LONG.strip()] * 2


def test_every_outermost_article_counts():
    page = f"<article><p>{LONG}</article><article><p>Short.</article><article><a href=x>More of it</a></article><article><p>{LONG * 2}</article>"
    assert X.main_text(f"<body>{page}</body>").split("\n") == [LONG.strip(), "Short.", (LONG * 2).strip()]


def test_broken_and_empty_pages():
    assert X.main_text(None) == X.main_text("") == X.main_text("<p></p>") == X.main_text("<script>x") == ""
    assert X.main_text("just < text & more") == "just < text & more"
    assert X.main_text("<article><p>cut &am") == "cut &am"
    assert X.main_text("<article>a<nav>menu</article><footer>f") == "a"
    assert X.main_text("<article><p title='a > b'>x</p><div class=\"ad\"") == "x"


def test_table(spark):
    rows = [(1, "u", "<article>" + "<p>w</p>" * 20000 + "</article>"), (2, None, None), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'old' AS text")
    got = X.extract_text(df).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 39999]
    assert X.extract_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))) for b in re.split(r"</?(?:p|h1)>", body)]
        assert X.main_text(r["html"]) == "\n".join(" ".join(b.split()) for b in blocks if b.split())
