import html
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import html_page_difference as module
from skylattice.llm.html_page_difference import common_lines, extract_main_text, lines_of, main_text


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    got = [a[i] for i in sorted(common_lines(a, b))]
    assert len(got) == brute_lcs(a, b) and is_subsequence(got, b)


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad > 1 --><div class="ad">buy</div><header>top</header><article><h1>Head &amp;
 line</h1><p><b>One&nbsp;<i>t</i>wo<br><p>three &lt;b&gt; &#x41;&am</p><form>field</form><div id="comments"><p>nice</p></div><p title='a>b'>last<aside>side</aside></article>
<footer>&copy; foot</footer></body></html>"""


def test_markup():
    assert main_text(lines_of(PAGE), None) == "Head & line\nOne two\nthree <b> A&am\nlast"
    assert lines_of(None) == lines_of("") == lines_of("<p>  </p>") == []
    assert main_text(lines_of("plain text < b"), None) == "plain text < b"
    assert main_text(lines_of("<p>a<p>b<script>x"), None) == "a\nb"
    assert [x.text for x in lines_of("<ul><li>a<li>b</ul>c")] == ["a", "b", "c"]


def test_differencing_removes_shared_lines_outside_containers(spark):
    def page(body):
        return f"<body><div>Site name</div><p>Latest news</p>{body}<p>All rights</p></body>"

    rows = [(i, f"http://h.com/a/{i:03d}", page(f"<p>Story {i}</p><p>Its end {i}</p>")) for i in range(60)]
    rows += [(100, "http://other.com/a/1", page("<p>alone</p>")), (101, None, None), (102, "http://h.com/zz", "<article><p>kept</p></article><p>All rights</p>"), (104, "http://h.com/zy", page("<article><p>own</p></article>")), (103, "http://h.com/zz/1", "<article><p>kept</p></article>")]
    rows += [(5, "http://h.com/a/005", rows[5][2])]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "1 AS bucket")
    results = []
    for size in (2048, 7):
        got = sorted(map(tuple, extract_main_text(pages, pages_per_task=size).collect()), key=str)
        assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
        results.append(got)
    assert results[0] == results[1]
    by = {i: t for i, _, t, _ in results[0]}
    assert all(by[i] == f"Story {i}\nIts end {i}" for i in range(60))
    assert by[100] == "Site name\nLatest news\nalone\nAll rights" and by[101] == "" and by[102] == by[103] == "kept" and by[104] == "own"
    assert extract_main_text(pages.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_halving_gives_as_long_a_subsequence(a, b):
    module.TABLE_BITS, before = 8, module.TABLE_BITS
    try:
        got = [a[i] for i in sorted(common_lines(a, b))]
    finally:
        module.TABLE_BITS = before
    assert len(got) == brute_lcs(a, b) and is_subsequence(got, b)


def test_names_in_a_container_are_whole_names():
    page = '<article><div class="entry-header"><h1>Title</h1></div><p>Body</p><p class="share price">x</p><div class="share">y</div><div class="comment-list">z</div></article>'
    assert main_text(lines_of(page), None) == "Title\nBody\nx"
    assert main_text(lines_of("<main><p>intro</p></main><div><p>the whole story</p></div>"), None) == "intro\nthe whole story"
    assert main_text(lines_of('<aside><article>teaser</article></aside><div>story</div>'), None) == "story"


def brute_text(page, partner):
    """Lines are deleted by the plain table of the longest common subsequence."""
    lines = [x for x in page if not x.frame]
    if partner is None:
        return "\n".join(x.text for x in lines)
    b = [x.text for x in partner]
    n, m = len(lines), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if lines[i].text == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0], sum(not x.main for x in lines)


def test_differencing_decides_on_a_framed_host(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        story = "".join(f"<p>Story {i} part {k} {rng.random()}</p>" for k in range(rng.randint(1, 6)))
        story = f"<article>{story}</article>" if i % 3 == 0 else f"<div>{story}</div>"
        rows.append((i, f"http://framed.org/{i // 10}/{i:03d}", f"<body><div>Site</div><p>Top news</p>{story}<p>Read on</p><div>Imprint</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages, pages_per_task=30).collect()}
    changed = 0
    for i, _, page in rows:
        lines = lines_of(page)
        alone = main_text(lines, None)
        changed += alone != got[i]
        for other in (i - 1, i + 1):
            if 0 <= other < 120 and other // 10 == i // 10:
                longest, _ = brute_text(lines, lines_of(rows[other][2]))
                assert longest == 4
        assert got[i] == "\n".join(x.text for x in lines if x.text.startswith("Story"))
    assert changed == 120


def test_very_long_pages_are_aligned_in_linear_memory():
    lines = [module.Line(f"line {i % 9000} {i}", False, False) for i in range(30_000)]
    other = [module.Line(f"line {i % 9000} {i}" if i % 10 else f"own {i}", False, False) for i in range(30_000)]
    assert main_text(lines, other).count("\n") == 2999


def test_long_page():
    body = "".join(f"<p>{html.escape(f'line {i} & <x>')}</p>" for i in range(8000))
    lines = lines_of(f"<article>{body}</article>")
    assert len(lines) == 8000 and main_text(lines, lines).count("\n") == 7999


def kept(page):
    return main_text(lines_of(page), None)


def test_comments_adverts_sidebars_and_notices_are_out():
    for names in ("reader-comments", "comment-thread", "ad-slot-top", "google-ads", "post-sidebar", "cookie-notice", "newsletter-signup", "sponsored"):
        for container in ("article", "main", "div"):
            assert kept(f'<{container}><p>Own words of the page.</p><div class="{names}"><p>other</p></div></{container}>') == "Own words of the page."
            assert kept(f'<{container}><p>Own words of the page.</p><section id="x" class="box {names}">other</section></{container}>') == "Own words of the page."
    assert kept('<article><p>Own words.</p><div id="user-comments">much longer talk than the article is, by far, and more of it</div></article>') == "Own words."


def test_inline_frame_elements_leave_their_block_whole():
    assert kept("<p>Hello <button>Subscribe now</button> world</p>") == "Hello world"
    for part in ("<noscript>on</noscript>", "<iframe>x</iframe>", "<audio>a</audio>", "<video controls>v</video>", '<span class="ad">buy</span>', "<span hidden>s</span>", "<select><option>1<option>2</select>", '<a class="share">s</a>', "<svg><text>t</text></svg>"):
        assert kept(f"<article><p>Hello {part} world</p><p>end</p></article>").replace("\n", " ") == "Hello world end", part
    assert kept("<article><p>Hello <button>lost</p><p>next</p></article>") == "Hello\nnext"
    assert kept('<p>a <span class="note">b</span> c</p>') == "a b c"


def test_weak_and_holding_names_need_evidence():
    assert kept('<div class="social science"><p>Study of society</p></div>') == "Study of society"
    assert kept('<article><section class="banner"><h2>Headline</h2><p>Story</p></section></article>') == "Headline\nStory"
    assert kept('<div class="notice"><p>The article itself</p></div>') == "The article itself"
    assert kept('<div class="notice">Closed today</div><div><p>The article itself is longer</p></div>') == "The article itself is longer"
    for names in ("content-with-sidebar", "has-sidebar", "page-sidebar-layout", "no-comments"):
        assert kept(f'<div class="{names}"><p>The article</p></div>') == "The article"


def test_near_copies_keep_their_article(spark):
    def page(version, more=""):
        return f"<body><p>{'One long paragraph of an article. ' * 8}</p><p>{'Another long one. ' * 12}</p><p>{'The third. ' * 20}</p><p>v{version}</p>{more}</body>"

    rows = [(k, f"http://two.com/{k}", page(k)) for k in (1, 2)] + [(10 + k, f"http://three.com/{k}", page(k)) for k in (1, 2, 3)]
    rows += [(20 + k, f"http://short.com/{k}", f"<body><div>A very long site name</div><p>Latest news of the day</p><p>Story {k}</p></body>") for k in range(5)]
    rows += [(40 + k, f"http://pair.com/{k}", f"<body><div>A very long site name</div><p>Latest news of the day</p><p>Story {k}</p></body>") for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2048, 2):
        got = {r.page_id: r.text for r in extract_main_text(pages, pages_per_task=size).collect()}
        assert all(got[i].count("\n") == 3 for i in (1, 2, 11, 12, 13))
        assert all(got[20 + k] == f"Story {k}" for k in range(5))
        # two pages alone do not tell a frame from a copied article
        assert all(got[40 + k].endswith(f"Story {k}") for k in range(2))


def brute_page(pages, i):
    """The rules as they read, for pages without containers and names: ``pages`` are lists of lines in order of place."""
    def shared(a, b):
        n, m = len(a), len(b)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for x in range(n - 1, -1, -1):
            for y in range(m - 1, -1, -1):
                table[x][y] = table[x + 1][y + 1] + 1 if a[x] == b[y] else max(table[x + 1][y], table[x][y + 1])
        return table[0][0]

    own = pages[i]
    near = [pages[k] for k in (i - 1, i + 1, i - 2, i + 2) if 0 <= k < len(pages) and pages[k] != own]
    return own, near, shared(own, near[0]) if near else 0


def test_generated_host_against_brute_force(spark):
    rng = random.Random(8)
    frame = ["Home page", "World", "All rights reserved"]
    texts, rows = [], []
    for i in range(90):
        story = [f"Story {i} {k} " + "".join(rng.choice("abcdefgh ") for _ in range(60)) for k in range(rng.randint(2, 6))]
        texts.append([*frame[:2], *story, frame[2]])
        rows.append((i, f"http://gen.org/{i:03d}", "".join(f"<p>{x}</p>" for x in texts[-1])))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_task=20).collect()}
    for i in range(90):
        own, near, longest = brute_page(texts, i)
        left = [x for x in own if x not in near[0]]
        assert longest == len(own) - len(left) and got[i] == "\n".join(" ".join(x.split()) for x in left)
