"""Pages as they come, and a log that is indexed file by file."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from venuescope.sources import files, html, log_index


class Tags(HTMLParser):
    """Opening tags with their attributes, as the standard library reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.found.append((tag, own))

    handle_startendtag = handle_starttag


def test_tags_against_the_standard_parser():
    draw = random.Random(1)
    names = ["div", "P", "a", "span", "br", "img", "li", "b"]
    attributes = ['class="x y"', "class='z'", "id=k", 'href="/a?b=1&amp;c"', "data-x", 'title="a > b"', "CLASS=q", 'class="second"']
    for _ in range(400):
        parts = []
        for _ in range(draw.randrange(12)):
            tag = draw.choice(names)
            parts.append(draw.choice([f"<{tag} {' '.join(draw.sample(attributes, draw.randrange(4)))}>", f"</{tag}>", "text &amp; more", "<!-- <b>no</b> -->", f"<{tag}/>", "a < b "]))
        page = "".join(parts)
        own = Tags()
        own.feed(page)
        own.close()
        assert [(e.tag, e.attributes) for e in html.elements(page)] == own.found, page


def test_only_given_entities_in_page_selectors(spark, tmp_path):
    """A title that was cut within an entity, or holds others than the four, stands as it is written, as in the query's SQL."""
    import duckdb

    from venuescope.plans import tables

    titles = ["a&amp;b &amp", "x &lt;i&gt; &amp;lt; &copy; &#39;", " no\u00a0break \n twice ", "&amp", "token = &quot;b"]
    rows = [(n, "", f'<nav><a href="/q?a&amp;b&amp">l</a></nav><div class="ad">{t}</div><article><h1>{t}</h1></article>') for n, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = tables.page_selectors(spark, str(tmp_path)).orderBy("page_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(tables.ORACLE_SQL["page_selectors"] + " ORDER BY page_id").fetchall()


def test_a_page_is_held_once():
    """Tags that are never closed lie within each other: their texts together are not kept for each of them."""
    found = html.elements("<b>word " * 2000)
    assert len(found) == 2000 and len(found[0].pieces) == 2000 and all(e.pieces is found[0].pieces for e in found)
    assert found[0].text() == " ".join(["word"] * 2000) and found[-1].text() == "word"


def test_few_pages_are_given_back_at_a_time(spark):
    df = spark.range(3 * html.PAGES).coalesce(1).select(F.lit("<p>x</p>").alias("html"), "id")
    sizes = html.fields(df, {"p": ["p"]}).mapInArrow(lambda bs: bs, "html string, id long, p string")
    assert sizes.where("p = 'x'").count() == 3 * html.PAGES


PAGE = """<!DOCTYPE html><HTML lang='en'><head><title>A &amp; B</title><script>if (a<b) { "<p>no</p>" }</script></head>
<body><div class="card first" data-id=7><h2> Name <b>bold</b> </h2><p>one<p>two <span class=note>n1</span></div>
<div class='card'><span aria-label="Rated 4 of 5" role=img></span><ul><li>x<li>y</ul><a href="/place/9">go</a></div><p>tail</body>"""


@pytest.mark.parametrize(
    ("options", "want"),
    [
        (["title"], "A & B"),
        (["h1", "h2"], "Name bold"),
        ([".card .note"], "n1"),
        (["div.card.first p"], "one"),
        (['span[aria-label^="Rated"]@aria-label'], "Rated 4 of 5"),
        (['a[href*="/place/"]@href'], "/place/9"),
        (["html@lang"], "en"),
        (["[data-id]@data-id"], "7"),
        (["ul li"], "x"),
        (["p p", "nav", "#none"], None),
        (["script"], None),
        (["body > p"], ValueError),
    ],
)
def test_selectors(options, want):
    if want is ValueError:
        with pytest.raises(ValueError):
            [html.parsed(o.partition("@")[0]) for o in options]
        return
    found = html.elements(PAGE)
    for o in options:
        s, _, attribute = o.partition("@")
        texts = [e.attributes.get(attribute, "") if attribute else e.text() for e in found if html.selected(e, html.parsed(s))]
        if any(texts):
            assert next(t for t in texts if t) == want
            return
    assert want is None


def test_fields_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tags"), (5, "<h1>" * 3000 + "deep")], "page_id long, html string")
    rows = {r.page_id: r for r in html.fields(pages, {"name": ["h1", "h2"]}, counts={"cards": ".card", "in_card": ".card p"}).collect()}
    assert rows[1].name == "Name bold" and (rows[1].cards, rows[1].in_card) == (2, 2)
    assert [rows[i].name for i in (2, 3, 4, 5)] == [None, None, None, "deep"] and rows[2].cards == 0
    with pytest.raises(ValueError):
        html.fields(pages, {"html": ["p"]})


def lines_to_keys(lines):
    return files.done_reviews(lines)


def answers(*keys):
    return "".join(f'{{"reviews": [{{"review_index": "{k}"}}]}}\n' for k in keys)


def test_index_reads_new_files_only(spark, tmp_path):
    log, index = tmp_path / "log", str(tmp_path / "index")
    log.mkdir()
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "none")], "review_index long, t string")
    left = lambda: sorted(r.review_index if r.review_index is not None else -1 for r in log_index.left_to_do(todo, index, "review_index").collect())
    assert log_index.update(spark, str(log), index, lines_to_keys) == 0 and left() == [-1, *range(40)]
    (log / "a.jsonl").write_text(answers(*range(10)) + "{broken\n\n")
    (log / "b.jsonl").write_text(answers(5, 11, 12))
    assert log_index.update(spark, str(log), index, lines_to_keys) == 2
    assert left() == [-1, 10, *range(13, 40)]
    read = []
    (log / "c.jsonl").write_text(answers(39, 12))
    assert log_index.update(spark, str(log), index, lambda lines: read.append(lines.count()) or lines_to_keys(lines)) == 1 and read == [2]
    assert left() == [-1, 10, *range(13, 39)] and log_index.update(spark, str(log), index, lines_to_keys) == 0
    # The same as the whole log and a plain anti-join.
    done = files.done_reviews(files.read_lines(spark, str(log)))
    assert left() == sorted(r.review_index if r.review_index is not None else -1 for r in todo.join(done, "review_index", "left_anti").collect())
    # A run that was lost before its manifest adds its keys again.
    (log / "d.jsonl").write_text(answers(20))
    spark.createDataFrame([(20, 1, 1)], "key long, hash long, bucket int").where(F.col("key") < 0).write.mode("append").parquet(f"{index}/keys/run=lost")
    assert log_index.update(spark, str(log), index, lines_to_keys) == 1 and left() == [-1, 10, *range(13, 20), *range(21, 39)]
