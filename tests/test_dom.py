from corpusloom.operators.dom import extract

U = "http://h.example/dir/page"


def test_content_places():
    for inner in ("<main>M</main><article>A</article>", '<div role="main">M</div><div class="content">C</div>', '<div class="content x">M</div><div id="content">I</div>', '<p id="content">M</p>', "M"):
        assert extract(f"<html><body>{inner}</body></html>", U)["content"] == "M"


def test_unwanted_elements_and_headings():
    x = extract("<title> T\n x </title><header><h1>gone</h1></header><h2> kept <b>x</b></h2><h3> </h3><div class='ads'>ad<div>in</div></div><p>text</p><script>var a='<p>'</script>", U)
    assert x["title"] == "T x" and x["headings"] == ["kept x"] and x["content"] == "kept x text"


def test_links_of_the_whole_page():
    x = extract('<nav><a href="/a">1</a></nav><a href="b">2</a><a href="/a">3</a><a href="mailto:x@y">4</a><a>5</a><a href="http://o.example/ü">6</a>', U)
    assert x["links"] == ["http://h.example/a", "http://h.example/dir/b", "http://o.example/%C3%BC"]


def test_malformed():
    for text in ("", "<", "<p><b>open", "</p></p>", "<!-- x", "<a href=>", "&amp;&nope;", "<div" * 50, "<p>a<p>b"):
        extract(text, U)
    assert extract("<p>a</p><p>b", U)["content"] == "ab"
    assert extract("a&nbsp;&nbsp;b &copy;", U)["content"] == "a b ©"


def test_deep_nesting():
    assert extract("<div>" * 5000 + "x", U)["content"] == "x"


def test_implied_ends():
    html = lambda t: extract(t, U)["cleaned_html"]
    assert html("<article><dl><dt>a<dd>b<dt>c</dl></article>") == "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"
    assert html("<article><table><tr><td>1<td>2<tr><th>3</table>x</article>") == "<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>x"
    assert html("<article><table><thead><tr><td>1<tbody><tr><td>2<table><tr><td>3</table><td>4</table></article>") == "<table><thead><tr><td>1</td></tr></thead><tbody><tr><td>2<table><tr><td>3</td></tr></table></td><td>4</td></tr></tbody></table>"
    assert html("<article><select><option>a<option>b</select><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>x<li>y</article>") == "<select><option>a</option><option>b</option></select><ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul><p>x</p><li>y</li>"


def test_a_page_that_raises(spark, monkeypatch):
    """X11: the row carries the error, and what the source knew of the page."""
    import pandas as pd

    from corpusloom.operators import dom, extract

    real = dom.parse
    monkeypatch.setattr(dom, "parse", lambda t: 1 / 0 if "boom" in t else real(t))
    rows = dom.extract_rows(pd.Series(["<p>fine", "boom", None]))
    assert rows["error"].tolist() == [None, "division by zero", "navigation failed"] and rows["content"].tolist() == ["fine", "", ""]
    assert rows["at"].str.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z").all() and (rows["ms"] >= 0).all()
    monkeypatch.setattr(extract, "extract_udf", lambda *_: __import__("pyspark.sql.functions", fromlist=["F"]).expr("named_struct('title', '', 'headings', array(), 'content', '', 'references', array(), 'cleaned_html', '', 'error', 'boom', 'at', 'T', 'ms', 3L)"))
    pages = spark.createDataFrame([("http://a.b/", "x", 203, "text/html; charset=x", 4)], "url string, html string, status_code int, content_type string, depth int")
    r = extract.scrape(pages, timed=True).first()
    assert (r.status, r.error_message, r.status_code, r.content_type, r.depth, r.word_count, r.language, r.scraped_at, r.scrape_ms) == ("FAILED", "boom", 203, "text/html", 4, 0, "unknown", "T", 3)


def test_references_without_semicolon():
    """Read as browsers do, or, unless bare, left as they stand; in attributes and beside any character too."""
    from corpusloom.operators import dom

    page = '<title>a &amp; b &amp</title><p>&copy &copy; &#65 &#65; &x; &lt&ampx;</p><a href="/?a&amp=1&amp;b">x</a>﷐<xmp>&amp;&amp</xmp>'
    got, strict = dom.parts(page), dom.parts(page, bare=False)
    assert (got["title"], strict["title"]) == ("a & b &", "a & b &amp")
    assert got["content"].startswith("© © A A &x; <&x;x﷐") and strict["content"].startswith("&copy © &#65 A &x; &lt&ampx;x﷐")
    assert strict["references"] == ["/?a&amp=1&b"]
    whole = '<title>t</title><h1>&quot;h&quot;</h1><p>no & but &copy;</p>'
    assert dom.parts(whole) == dom.parts(whole, bare=False)


def test_cut_references_as_in_sql(spark, tmp_path):
    """Titles that are cut inside a reference: dom_extract gives the rows of its SQL, as page_extract does."""
    import duckdb

    from corpusloom.plans import registry

    html = "<title>a &amp;&amp</title><article><h1>a &amp;&amp</h1><p>of the &copy;</p><a href=\"/x\">x</a></article>"
    spark.createDataFrame([(1, "http://s.example/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["dom_extract"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == duckdb.sql(registry.SQL["dom_extract"]).fetchall()
