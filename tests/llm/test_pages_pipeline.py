import random

from pyspark.sql import functions as F

import corpus_pipeline
from tablens.llm import decontam, mixing, neardup, pagetext, quality, secrets

from .test_links import components, sets_of

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>part</b>.<p>Second<br>line &lt;x&gt;</article>"


def test_marked_articles():
    chrome = ('<nav><ul><li>Home</ul></nav><header>Site</header><div class="cookie-notice">We</div>', "<aside>Side</aside><footer>End</footer>")
    want = "Title & more\n\nFirst part.\n\nSecond line <x>"
    assert pagetext.main_text(chrome[0] + ARTICLE + chrome[1], []) == want
    assert pagetext.main_text("<nav><ul><li>never closed" + ARTICLE, []) == want
    inner = ARTICLE.replace("</article>", '<form>f</form><section class="user-comments"><article>c</article></section><script>x</script><!-- c --></article>')
    assert pagetext.main_text(inner, []) == want
    assert pagetext.main_text(None, []) == pagetext.main_text("", []) == pagetext.main_text("<p>", []) == ""
    assert pagetext.main_text('<article><p title="a>b">cut', []) == "cut"


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(15))]
        b = [rng.randrange(5) for _ in range(rng.randrange(15))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        at = pagetext.common_lines(a, b)
        rest = iter(b)
        assert len(at) == row[-1] and at == sorted(set(at)) and all(a[i] in rest for i in at)


def test_unmarked_pages_lose_lines_shared_with_the_nearest_page(spark):
    menu = "<div>Home</div><div>About</div>"
    rows = [(1, "http://h.org/news/1", f"{menu}<p>Story one</p><div>Contact</div>"), (2, "http://h.org/news/2", f"{menu}<p>Story two</p><div>Contact</div>"),
            (3, "http://h.org/zoo", f"{menu}<p>Zoo</p><p>Contact us</p>"), (4, "http://other.org/news/1", f"{menu}<p>Alone</p>"),
            (5, None, "<p>No url</p>"), (6, "http://h.org/a", ARTICLE), (7, "http://h.org/b", ARTICLE), (8, "http://h.org/n", None),
            (1, "http://h.org/news/1", f"{menu}<p>Story one</p><div>Contact</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted((r["page_id"], r["text"]) for r in pagetext.extract(pages, ["page_id", "url"]).collect())
    full = "Title & more\n\nFirst part.\n\nSecond line <x>"
    assert got == [(1, "Story one"), (1, "Story one"), (2, "Story two"), (3, "Zoo\n\nContact us"), (4, "Home\n\nAbout\n\nAlone"),
                   (5, "No url"), (6, full), (7, full), (8, "")]
    assert pagetext.extract(pages.limit(0), ["page_id"]).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("x")).withColumn("key", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before, after)
        if k < 4:
            assert after.columns == docs.columns
        before = after

    a, b = kept["quality_classifier"]
    known = quality._Words()
    model = quality.train(a, "text")
    good = set()
    for r in a.collect():
        x = quality.describe(r["text"], known)[1]
        if (float(model["prior"][1]) if x is None else 1 / (1 + 2.718281828459045 ** -float(x @ model["weights"]))) >= .5:
            good.add(r["doc_id"])
    assert {r["doc_id"] for r in b.collect()} == good

    a, b = kept["minhash_near_dedup"]
    sets = {r["doc_id"]: sets_of(r["text"], 5) for r in a.collect()}
    ids = list(sets)
    pairs = [(x, y) for i, x in enumerate(ids) for y in ids[:i] if sets[x] and sets[y]
             and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    assert {r["doc_id"] for r in b.collect()} == set(components(ids, pairs).values())

    a, b = kept["benchmark_decontamination"]
    words = lambda t: [w.decode("utf-8", "replace") for w in decontam.words_in(t)]
    items = [" " + " ".join(words(r["text"])) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in b.collect()}
    for r in a.collect():
        text = " " + " ".join(words(r["text"])) + " "
        if any(i in text for i in items):
            assert r["doc_id"] not in left
    assert len(left) >= .9 * a.count()

    a, b = kept["secret_scans"]
    from .test_spans import brute_secrets
    old = {r["doc_id"]: r["text"] for r in a.collect()}
    assert {r["doc_id"] for r in b.collect()} == set(old)
    for r in b.collect():
        assert not brute_secrets(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_secrets(old[r["doc_id"]]):
            assert r["text"] == old[r["doc_id"]]

    a, b = kept["source_mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(a).collect() if r["copies"]}
    copies = {}
    for r in b.collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert {d: len(c) for d, c in copies.items()} == plan and all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())


def test_stages_on_rows_without_ids_and_empty_tables(spark):
    text = "The keeper locked the gate at dusk and walked home along the river. Nobody saw the boat leave. token = abcdefgh12345"
    docs = spark.createDataFrame([(None, text, "en", None, 1), (None, text, "en", None, 1), (3, text + " Late.", "en", "s", 1), (3, text + " Late.", "en", "s", 1),
                                  (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    stage = dict(corpus_pipeline.STAGES)
    # the copies without an id are near copies of document 3
    assert sorted(str(r["doc_id"]) for r in stage["minhash_near_dedup"](spark, docs, sf).collect()) == ["3", "4"]
    assert stage["benchmark_decontamination"](spark, docs, sf).count() == 5
    assert all("abcdefgh12345" not in (r["text"] or "") for r in stage["secret_scans"](spark, docs, sf).collect())
    for f in stage.values():
        assert f(spark, docs.limit(0), sf).count() == 0
    assert secrets.RULES and neardup.ROWS


def test_near_dedup_goes_by_texts_not_ids(spark):
    rng = __import__("random").Random(4)
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(rng.choice(words) for _ in range(150)) for _ in range(3))
    near = a.replace(a.split()[70], "other", 1)
    rows = [(1, a), (None, near), (None, a), (5, b), (5, c), (None, "alone here"), (None, "alone here"), (8, ""), (9, ""), (8, ""), (None, None), (7, b.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()), key=str)
    # two unrelated texts under id 5 both stay; the near and exact copies of document 1 go, as does 7 (b in other letters)
    assert got == sorted([("1", a), ("5", b), ("5", c), ("None", "alone here"), ("8", ""), ("9", ""), ("None", None)], key=str)


def test_only_chrome_goes_from_an_article():
    page = ('<nav>Home</nav><div id="social">S</div><article><h1>T</h1><section id="social-effects"><h2 id="related-work">R</h2><p>One</section>'
            '<div class="widget-content">Two</div><p id="subscription-model">Three</p><p class="notice-period text">Four</p>'
            '<div class="ad">x</div><div class="big share-buttons">x</div><div class="related-posts">x</div><ul role="menu">x</ul></article>')
    assert pagetext.main_text(page, []) == "T\n\nR\n\nOne\n\nTwo\n\nThree\n\nFour"


def test_a_form_around_the_page_is_not_chrome():
    for form, end in (("<form action='/x.aspx' id=aspnetForm>", "</form>"), ("<form>", "")):
        assert pagetext.main_text(f"{form}<nav>Home</nav><div>Story</div><p>Goes on<label>Mail</label><button>Go</button>{end}", []) == "Story\n\nGoes on"
        assert pagetext.main_text(f"<p>Skip to the text</p>{form}<main><p>Story</p></main><footer>x</footer>{end}", []) == "Story"
        assert pagetext.main_text(form + "<div>Top</div>" + ARTICLE + end, []) == "Title & more\n\nFirst part.\n\nSecond line <x>"
    assert pagetext.main_text("<p>A story</p><form><p>Search</p></form><p>Goes on</p>", []) == "A story\n\nGoes on"


def test_main_keeps_its_lines_beside_articles():
    page = "<div>Top</div><main><h1>Story</h1><p>One</p><article>Teaser</article><p>Two</p><aside>x</aside></main><div>End</div>"
    assert pagetext.main_text(page, []) == "Story\n\nOne\n\nTeaser\n\nTwo"


def test_differencing_of_the_given_pages_without_their_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace("html", r"(?i)</?(article|main)\b[^>]*>", ""))
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(any(z for _, z in pagetext.page_lines(h)) for h in html.values())      # none is decided by differencing
    kept = total = found = 0
    for r in pagetext.extract(bare, ["page_id"]).collect():
        want, got = set(pagetext.main_text(html[r["page_id"]], []).split("\n\n")), set(r["text"].split("\n\n")) - {""}
        kept, total, found = kept + len(want & got), total + len(want), found + len(got)
    print(f"differencing: {kept} of {total} lines of the articles kept, {kept} of {found} lines returned are the articles'")
    assert kept >= .9 * total and kept >= .9 * found


def test_every_page_takes_part_in_the_differencing(spark):
    side, art = "<p>Menu <b>line</b></p><p>Notice line</p>", "<article><p>Own text {}</p></article>"
    rows = [(1, "http://a.com/x/1", side + art.format(1)), (2, "http://a.com/x/1b", side + "<p>Body of two</p>"),
            (3, "http://b.com/y/1", "<p>Menu line</p>" + art.format(3)), (4, "http://b.com/y/2", "<article><p>Menu line</p><p>Own text 3</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagetext.extract(pages, ["page_id", "url"]).collect()}
    # 2 marks nothing: its pair's unmarked lines go; in 4 a line goes that 3 shows outside its article, and the copied article stays
    assert got == {1: "Own text 1", 2: "Body of two", 3: "Own text 3", 4: "Own text 3"}
