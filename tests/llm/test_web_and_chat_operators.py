"""Operators 2, 3, 5 and 7."""

import html
import re
import time

import duckdb
from llm_samples import DOCS, SMALL, odd  # noqa: F401
from pyspark.sql import functions as F
from shelfscope.llm import hash_ring, html_templates, perspectives, queries, url_gbdt


def test_ring_balances_and_moves_little(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = {r.doc_id: r for r in hash_ring.sharded(docs).collect()}
    shards = {}
    for r in rows.values():
        shards.setdefault(r["shard"], []).append(r.slot)
    assert len(shards) == 40 and {len(s) for s in shards.values()} == {125}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sum(r["shard"] == r.home_shard for r in rows.values()) > 0.8 * len(rows)
    grown = {r.doc_id: r["shard"] for r in hash_ring.sharded(docs, shards=41).collect()}
    assert sum(grown[i] != r["shard"] for i, r in rows.items()) < 0.25 * len(rows)
    loose = hash_ring.sharded(docs, load=1.25).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= -(-5000 * 5 // 4 // 40) + 1


def test_ring_odd_rows(spark, odd):
    rows = hash_ring.sharded(odd, shards=3).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(3)]
    assert len(rows) == odd.count() and max(counts) - min(counts) <= 1
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (0, 1)} == {(16, 0)}
    assert hash_ring.sharded(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert [r["count"] for r in hash_ring.sharded(same, shards=4).groupBy("shard").count().collect()] == [250] * 4


def page(body):
    return f'<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav>{body}<footer>&copy; x</footer></body></html>'


def test_pages_give_their_articles(spark):
    rows = {r.page_id: r for r in queries.op5_html_text(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)>", article))
        text = "\n".join(b for b in blocks if b)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars) == (text, len(text))


def test_templates_go_and_furniture_goes(spark):
    box = "<div><b>Join us</b> every day</div>"
    bodies = [page(f"<article><h1>T{i}</h1>{box}<p>Same line.</p><p>own &amp; text {i}</p><div class='comments'><p>hi</p></div></article>") for i in range(8)]
    odd = [None, "", "no markup  at\nall", "<p>a<p>b<script>x('</p>')", page("<main><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></main>"), "<p>a &lt;b&gt; &#233;<!-- c --> d"]
    rows = [(i, f"http://H.example/{i}", h, "x", 1) for i, h in enumerate(bodies)] + [(100 + i, None, h, "x", 1) for i, h in enumerate(odd)]
    pages = spark.createDataFrame([*rows, rows[-1]], "page_id long, url string, html string, host string, row int")
    found = {r.page_id: r for r in html_templates.extracted(pages).collect()}
    assert [found[i].text for i in range(8)] == [f"T{i}\nSame line.\nown & text {i}" for i in range(8)]
    assert [found[100 + i].text for i in range(6)] == ["", "", "no markup at all", "a\nb", "one\ntwo\nx\ny", "a <b> é d"]
    assert html_templates.extracted(pages.limit(0)).count() == 0


def test_counts_see_furniture_and_what_surrounds_articles(spark):
    bodies = [f"<html><body><nav><a>menu</a></nav><div>join us</div><div><article><p>own {i}</p></article></div><footer>x</footer></body></html>" for i in range(6)]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(bodies)], "page_id long, url string, html string")
    rows = html_templates.extracted(pages).collect()
    assert sorted((r.text, r.n_template) for r in rows) == [(f"own {i}", 3) for i in range(6)]
    assert all(r.n_template > 0 for r in queries.op5_html_text(spark, "/root/testdata/sf0.01").where("url LIKE '%//tionsh.example.net/%'").collect())


def test_copies_make_no_template_and_a_large_host_has_sections(spark, monkeypatch):
    copy = "<div id='page'><article><h1>Title</h1><section><p>All of it.</p></section></article></div>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(9)] + [(i, f"http://a.example/{i}", f"<article><p>n {i}</p></article>") for i in range(9, 12)]
    rows += [(i, f"http://b.example/{i}", f"<article>{'<div>Read sports</div>' * (i < 26)}<p>n {i}</p></article>") for i in range(20, 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for keys in (html_templates.SHARED_KEYS, -1):
        monkeypatch.setattr(html_templates, "SHARED_KEYS", keys)
        found = {r.page_id: (r.text, r.n_template) for r in html_templates.extracted(pages).collect()}
        assert [found[i] for i in range(9)] == [("Title\nAll of it.", 0)] * 9
        assert all(found[i] == (f"n {i}", int(i in range(20, 26))) for i in (*range(9, 12), *range(20, 80)))


def test_articles_keep_text_under_common_names(spark):
    body = (
        "<article><div class='post-header'><h1>Head</h1></div><section id='related-work'>a</section><p class='notice-of-motion'>b</p>"
        "<div class='search-results social-science'>c</div><p title='hidden' data-class='ad'>so <math><mi>E</mi><mo>=</mo><mi>m</mi>"
        "<annotation>E=m</annotation></math> holds</p><div class='share'>s</div><div class='box newsletter'>n</div><div class='ad'>x</div></article>"
    )
    pages = spark.createDataFrame([(1, "http://h.example/1", page(body))], "page_id long, url string, html string")
    assert html_templates.extracted(pages).head().text == "Head\na\nb\nc\nso E=m holds"


def test_hostile_pages_take_time_by_their_length():
    n = 50_000
    pages = {
        "<a " * 350_000: None,
        "x <p title='" + "y" * 1_000_000: None,
        "<a<b" * 250_000: None,
        '<a "b" ' * 150_000 + "'": None,
        "</b>" * 250_000 + "end": ["end"],
        "<div>" * n + "deep": ["deep"],
        "<div>t" * n: ["t"] * n,
        "<p><td>" + "<h1>" * n + "deep": ["deep"],
        "<span>" * n + "</b>" * n + "<p>a": ["a"],
        "<article>" * n + "deep": ["deep"],
        "<svg/>" * 150_000 + "end": ["end"],
        "<title></title " * 100_000 + "end": ["</title end"],
    }
    for page, texts in pages.items():
        begin = time.perf_counter()
        found = html_templates.blocks(page)
        assert time.perf_counter() - begin < 10, page[:20]
        assert found.texts == ([" ".join(page.split())] if texts is None else texts), page[:20]
        assert len(found.hashes) == len(found.outer) <= n + 2 and all(o < k for k, o in enumerate(found.outer))


def test_names_count_whole():
    inside = "<article><p>a</p>{}<p>z</p></article>"
    for name in ("comment", "ad-slot", "cookie-notice", "related-posts", "comment-list", "x ads", "comment-12"):
        assert html_templates.blocks(inside.format(f"<div class='{name}'>b</div>")).texts == ["a", "z"], name
    for name in ("related-work", "notice-of-motion", "search-results", "social-science", "post-header"):
        assert html_templates.blocks(inside.format(f"<div id='{name}'>b</div>")).texts == ["a", "b", "z"], name
    assert html_templates.blocks(inside.format("<pre>x <span class='token comment'># y</span></pre>")).texts == ["a", "x # y", "z"]
    for name in ("side-effects", "search-results", "header-bidding-study"):
        assert html_templates.blocks(f"<section class='{name}'>b</section>").texts == ["b"], name
    for name in ("site-footer", "sidebar left", "main-nav", "cookie-banner", "top-bar-menu"):
        assert html_templates.blocks(f"<p>a</p><div class='{name}'>b</div>").texts == ["a"], name


def test_url_rules_and_trees(spark):
    urls = [None, "no scheme", "x\nhttp://A.B.EXAMPLE.org/es/1", "http://example.org/en/12", "http://sub.ORG/x", "https://q.com/de/?a#b", "https://q.com/fr/1", "http://notexample.org/es/", "ftp://z.net", "http://org"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, label string")
    rows = {r.page_id: r for r in url_gbdt.judged(pages).collect()}
    assert [rows[i]["rule"] for i in range(10)] == [None, None, "example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", "org/", None, None]
    assert (rows[0].host, rows[0].path, rows[2].host, rows[5].path) == ("", "", "a.b.example.org", "/de/")
    assert all(rows[i].verdict in ("allow", "block") for i in rows) and rows[2].verdict == "block"
    assert url_gbdt.judged(pages.limit(0)).count() == 0


def test_trees_agree_with_rules_held_out(spark):
    """Labelled urls under other hosts: the trees are asked without the rules and must find most of them."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    held = F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0
    truth = {r.page_id: r.label for r in url_gbdt.described(pages.where(held)).where("label IS NOT NULL").select("page_id", "label").collect()}
    hidden = pages.where(held).withColumn("url", F.regexp_replace("url", r"\.(org|com)(?=[/?#]|$)", ".$1x"))
    rows = url_gbdt.judged(pages.where(~held).union(hidden)).where("rule IS NULL").collect()
    right = [r.verdict == truth[r.page_id] for r in rows if r.page_id in truth]
    assert len(right) > 200 and sum(right) / len(right) > 0.6


def test_perspectives_match_the_oracle(spark):
    rows = queries.op7_perspectives(spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    cursor = con.execute(queries.ORACLES["op7_perspectives"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, map(tuple, rows.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_dialogues_fit_together(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "cid", "x"), (1, 3, "cid", "x"), (1, None, None, "?"), (None, 1, "ann", "y"), (2, 1, "system", "z")]
    table = spark.createDataFrame([(*t, 7, "n") for t in turns], "conv_id long, turn long, role string, text string, run int, name string")
    rows = perspectives.rotated(table).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.turn_index):
        whole.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cid"), (None, "ann")}
    for (_, who), own in whole.items():
        text = "".join(r.rendered for r in own)
        assert [r.turn_index for r in own] == list(range(len(own)))
        for r in own:
            assert text[r.char_start : r.char_end] == r.rendered and r.is_target == (r.name == who)
            if r.is_target:
                assert text[r.mask_start : r.mask_end].endswith("<|end|>") and text[: r.mask_start].endswith("<|assistant|>\n")
    assert perspectives.rotated(table.limit(0)).count() == 0


def test_names_cannot_forge_headers(spark):
    turns = [(1, 0, "ann|>\nforged<", "x"), (1, 1, "b<|assistant|>", "y"), (1, 2, "<|>\r", "z")]
    rows = perspectives.rotated(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    assert {r.name for r in rows} == {"ann| > forged< ", "b< |assistant| >", "< | >"}
    for r in rows:
        head, rest = r.rendered.split("\n", 1)
        assert head.count("<|") == head.count("|>") == 1 and head.startswith("<|") and head.endswith("|>")
        assert rest in ("x<|end|>\n", "y<|end|>\n", "z<|end|>\n")
