import gzip
import hashlib
import io
import random
import time
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallylog.llm import html_extract, warc


def pages(spark, rows, more=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as text", "1 as digest", "'h' as host") if more else df


SHAPES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>Head</h1>"
     "<p>One &amp; two<br>three <b>bo</b>ld</p></article><footer>foot</footer>", "Head One & two three bold"),
    ("<main><p>a<p>b<ul><li>c<li>d</ul><aside>side</aside></main>tail", "a b c d"),
    ('<div class="page with-sidebar"><div role="main">x <div class="ad-box">buy</div>y</div></div>', "x y"),
    ('<article>text<section id="comments"><article class="comment">nice</article></section></article>', "text"),
    ('<article>a<script>var t="</article>";</script>b<!-- no <p> --><form><p>f</form>c</article>', "a b c"),
    ('<article><p title="a>b">x&nbsp;y &#233;&lt;i&gt; &am</p><header>by me</header></article>', "x y é<i> &am"),
    ('<ARTICLE><P>Up</P><div style="overflow:hidden">shown</div><p hidden>gone</p></ARTICLE', "Up shown"),
    ("<p>open page", "open page"),
    ("", ""),
    (None, ""),
    ("plain text < 5 & more", "plain text < 5 & more"),
]


@pytest.mark.parametrize("html, text", SHAPES)
def test_blocks(html, text):
    assert " ".join(html_extract.page_blocks(html or "")[0]) == text


def test_extract_text(spark):
    rows = [(i, f"http://h{i}.example/", h) for i, (h, _) in enumerate(SHAPES)] + [(None, None, "<article>n</article>")]
    found = html_extract.extract_text(pages(spark, rows, more=True)).collect()
    assert {r.page_id: r.text for r in found} == {i: t for i, (_, t) in enumerate(SHAPES)} | {None: "n"}
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract_text(pages(spark, rows).where("page_id < 0")).collect() == []


def test_repeated_runs_of_a_host_go(spark):
    notice, other = "we use small files to serve you better", "words that only this page has"
    long = " ".join(f"standing{i}" for i in range(30))
    page = lambda body: f"<div>{notice}</div><p>{body}</p><div>Home about us contact legal imprint</div>"
    rows = [
        (1, "http://a.example/1", page(other)),
        (2, "https://A.example:80/2", page("something else entirely")),
        (3, "http://b.example/", page("alone on its host")),
        (4, "http://a.example/1", f"<article>{notice} {long}</article>"),
        (5, "http://a.example/5", f"<p>unique {notice} once</p><p>first {long} last</p>"),
        (6, "http://a.example/6", f"<p>other {long} end</p>"),
    ]
    found = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert found[1] == other and found[2] == "something else entirely"
    assert found[3] == f"{notice} alone on its host Home about us contact legal imprint"
    assert found[4] == f"{notice} {long}"  # a marked main part
    assert found[5] == f"unique {notice} once first last" and found[6] == "other end"


def test_marked_pages_of_a_host_are_compared_with(spark):
    """What a page without a marked main part shares with pages that mark one, left out there or not."""
    legal = " ".join(f"legal{i}" for i in range(30))
    rows = [
        (1, "http://a.example/1", f"<div>Home News</div><p>only here</p><div>foot {legal}</div>"),
        (2, "http://a.example/2", f"<nav>Home News</nav><main>first {legal}</main>"),
        (3, "http://a.example/3", "<article>second</article><div>Home News</div>"),
        (4, "http://a.example/4", f"<article><p>third<p>{legal}</article>"),
        (5, "http://b.example/5", f"<div>Home News</div><p>{legal}</p>"),
        (6, "http://a.example/6", "<div>twice</div><p>own</p><nav>twice</nav>"),  # on one page only
    ]
    found = {r.page_id: (r.text, r.n_repeated) for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert found == {
        1: ("only here foot", 32),
        2: (f"first {legal}", 30),
        3: ("second", 0),
        4: (f"third {legal}", 30),
        5: (f"Home News {legal}", 0),
        6: ("twice own", 0),
    }


def test_prose_of_a_large_host_stays(spark):
    """Thousands of unmarked pages of ordinary prose from few words, with planted menus and a long
    passage on some; against a plain count of blocks and runs."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    menu, passage = "Home News Contact", " ".join(f"legal{i}" for i in range(40))
    rows, blocks = [], {}
    for i in range(2500):
        own = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(30, 60))) for _ in range(2)]
        if i % 50 == 0:
            own[1] += f" {passage} {i}"
        blocks[i] = [menu, *own, "Imprint"]
        rows.append((i, "http://big.example/", "<ul><li>{}</ul><p>{}<p>{}<div>{}</div>".format(*blocks[i])))
    seen = defaultdict(set)
    run = html_extract.RUN_TOKENS
    tokens = {i: " ".join(b).split() for i, b in blocks.items()}
    for i, b in blocks.items():
        for block in b:
            seen[block].add(i)
        for k in range(len(tokens[i]) - run + 1):
            seen[tuple(tokens[i][k : k + run])].add(i)
    expected = {}
    for i, b in blocks.items():
        gone, at = set(), 0
        for block in b:
            n = len(block.split())
            gone |= set(range(at, at + n)) if len(seen[block]) > 1 else set()
            at += n
        for k in range(len(tokens[i]) - run + 1):
            if len(seen[tuple(tokens[i][k : k + run])]) > 1:
                gone |= set(range(k, k + run))
        expected[i] = " ".join(t for k, t in enumerate(tokens[i]) if k not in gone)
    found = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert found == expected
    assert all("Home" not in t and "legal7" not in t and len(t.split()) >= 60 for t in found.values())


def test_suffixes_are_sorted_and_intervals_go_over_edges(spark):
    """The order of the suffix array, and runs and blocks on so many pages that no task has them whole."""
    rnd = random.Random(8)
    passage = " ".join(f"legal{i}" for i in range(30))
    rows, unique = [], {}
    for i in range(400):
        unique[i] = " ".join(f"u{rnd.random()}" for _ in range(rnd.randint(1, 30)))
        more = f"<p>{unique[i]} {passage if i % 3 == 0 else ''}<p>{passage if i % 3 == 1 else ''}"
        rows.append((i, f"http://{'a' if i % 8 else 'b'}.example/", f"<p>Home News{more}"))
        rows.append((1000, "http://b.example/", "<p>the same row on one page"))  # equal rows are one page
    kept = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = pages(spark, rows)
        found = {r.page_id: r.text for r in html_extract.extract_text(frame).collect()}
        host = html_extract.host_of(F.col("url")).alias("host")
        given = frame.select(host, F.col("page_id").alias("page"), F.split("html", "<p>").alias("blocks"))
        array = html_extract.suffix_array(given)
        parts = array.rdd.glom().collect()
        runs = html_extract.repeated_runs(array).distinct().collect()
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert found == unique | {1000: "the same row on one page"}
    order = [tuple(r) for part in parts for r in part]
    assert order == sorted(order) and sum(map(bool, parts)) > 30
    pages_of, ends = defaultdict(set), defaultdict(set)
    for k, part in enumerate(parts):
        for r in part:
            pages_of[tuple(r)[:5]].add(r.page)
            ends[tuple(r)[:5]].add(k)
    assert any(len(k) > 2 and len(pages_of[key]) > 1 for key, k in ends.items())
    assert {tuple(r) for r in runs} == {(r[5], r[6], r[1]) for r in order if len(pages_of[r[:5]]) > 1}


def test_names_inside_a_marked_part():
    html = (
        '<article><h1>T</h1><h2 id="related-work">Related</h2><section id="search-algorithms"><p>binary</section>'
        '<p class="has-header">kept</p><div class="cookie-recipe">dough</div><p class="notice">gone</p>'
        '<div class="ad-slot">buy</div><div role="navigation">menu</div><p>last</p></article>'
    )
    assert html_extract.page_blocks(html) == (["T", "Related", "binary", "kept", "dough", "last"], True)
    assert html_extract.page_blocks('<div id=main>x</div>y') == (["x"], True)
    assert html_extract.page_blocks('<article class=comment>x</article>y') == (["y"], False)


def test_long_and_nested_pages_are_parsed_in_time():
    began = time.perf_counter()
    cases = [
        "<p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000,
        "<i><p>" + "<b>" * 20_000 + "</i>" * 20_000 + "x",
        "<b>" * 20_000 + "<hr>" * 20_000 + "x",
        "<article>" + "<p>some words of a page</p>" * 80_000,
        "<div>" * 20_000 + "x" + "</div>" * 20_000,
    ]
    for html in cases:
        assert html_extract.page_blocks(html)[0]
    assert max(map(len, cases)) > 2_000_000 and time.perf_counter() - began < 10


def payload(i):
    return f"<p>{i}</p>" * 300


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", payload(1)), (9, "http://b/é\n", payload(1)), (4, "http://c/", payload(1)), (2, "u", "short"), (3, "u", "short"), (5, None, None), (6, "u", "é" * 600), (None, "n", payload(1)), (7, "u", "x\r\n\r\nWARC/1.1" * 200)]
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(warc.plan_records(pages(spark, rows, more=True)), folder, archive_bytes=600)
    assert archives.count() > 1
    found = {r.page_id: r for r in warc.read_archives(archives, folder).collect()}
    assert set(found) == {r[0] for r in rows}
    for page_id, url, html in rows:
        data, r = (html or "").encode(), found[page_id]
        again = html == payload(1) and page_id != 9
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if again else ("response", None))
        assert r.digests_ok and r.payload == (None if again else bytearray(data))
        assert r.url == (url or "").replace("\n", "%0A")
    empty = warc.archive_pages(pages(spark, rows).where("page_id < 0"))
    assert empty.collect() == []


def test_a_damaged_archive_fails(spark, tmp_path):
    rows = [(i, "u", payload(i)) for i in range(5)]
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(warc.plan_records(pages(spark, rows)), folder)
    place = next((tmp_path / "w" / "archives").glob("*.gz"))
    found = [zlib.decompress(d, 31) for d in split_members(place.read_bytes())]
    found[0] = found[0].replace(b"<p>", b"<q>", 1)
    place.write_bytes(b"".join(gzip.compress(d) for d in found))
    with pytest.raises(Exception, match="digests of the record at 0"):
        warc.read_archives(archives, folder).collect()
    loose = warc.read_archives(archives, folder, strict=False).collect()
    bad = [r for r in loose if not r.digests_ok]
    assert len(bad) == 1 and bad[0].payload_digest == hashlib.sha1(bad[0].payload).hexdigest()


def split_members(data):
    out = []
    while data:
        inflate = zlib.decompressobj(31)
        inflate.decompress(data)
        out.append(data[: len(data) - len(inflate.unused_data)])
        data = inflate.unused_data
    return out


def test_reading_is_incremental_and_strict():
    data = [warc.encode_record(i, "u", b"p" * 5000 * i, hashlib.sha1(b"p" * 5000 * i).hexdigest(), 5000 * i, "response", None) for i in range(4)]
    whole = b"".join(data)
    for block in (7, 64, 100_000):
        found = list(warc.members(io.BytesIO(whole), block))
        assert [o for o, _ in found] == [sum(map(len, data[:i])) for i in range(4)]
        assert all(warc.parse_record(d)["digests_ok"] for _, d in found)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-3]), 64))
    record = zlib.decompress(data[1], 31)
    assert not warc.parse_record(record.replace(b"ppp", b"ppq", 1))["digests_ok"]
    with pytest.raises(ValueError):
        warc.parse_record(record[:-4])
    assert isinstance(pa.schema([]), pa.Schema)
