"""HTML main text, WARC packages and toxicity."""

import gzip
import hashlib
import io
import time
import zipfile
import zlib
from string import ascii_lowercase as LETTERS

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import html_text, toxicity, warc
from memloom.llm.common import Scratch

# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div id=wrap><article class="post-17"><h1>Title &amp; more</h1><p>First&nbsp;para <b>bold<br>line.<p>Second &lt;one&gt;
 wraps.<ul><li>item<li>other <a href=x>link</a></ul><div class="ad">Buy!</div><form><input>Name</form>
<aside>Side</aside><section class="comments"><p>Nice post, thanks a lot for it all</p></section></article></div>
<footer>&copy; site</footer></body></html>"""
TEXT = "Title & more\nFirst para bold line.\nSecond <one> wraps.\nitem\nother link"


def test_extraction_of_one_page():
    assert html_text.extract(PAGE) == TEXT
    assert html_text.votes(PAGE)[0][0] == "/html/body/div/article.post-N"


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("just  text &eacute;", "just text é"),
        ("<p>a<p>b", "a\nb"),
        ("a < b and <b>c</b>", "a < b and c"),
        ("<div><p>open <i>tags", "open tags"),
        ("<script>x</script>", ""),
        ("<p>one<!-- never closed", "one"),
        ("<table><tr><td>x<td>y</table>", "x\ny"),
        ("<p title='a>b'>q</p>", "q"),
        ("</p></div>x", "x"),
        ("<" * 50, "<" * 50),
        ("<div class='with-sidebar'><form><article><header class=entry-header><h1>T</h1></header><p>x</p></article></form><div class=sidebar>y</div></div>", "T\nx"),
        ("<main><p>x</p></main><aside><article>teaser</article></aside>", "x"),
    ],
)
def test_broken_pages(source, text):
    assert html_text.extract(source) == text


def test_consensus_of_a_host(spark):
    """A page whose sidebar is longer than its story is read by its host's path."""
    story = lambda text: f"<body><div class=story><p>{text}</p></div><div class=extra><p>{'x ' * n}</p></div>"
    rows = []
    for i in range(9):
        n = 3
        rows.append((i, "https://Host.example/p", story("a long enough story of this page " * 5), "c"))
    n = 300
    rows += [(9, "http://host.example:80/q", story("a short story"), "c"), (10, None, "<p>no url</p>", "c"), (None, "bad url", None, "c"), (10, None, "<p>no url</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("path", F.lit(1))
    got = {(r["page_id"], r["url"]): r for r in html_text.main_text(spark, df).collect()}
    assert got[9, "http://host.example:80/q"]["text"] == "a short story"
    assert got[None, "bad url"]["text"] == "" and got[10, None]["n_chars"] == 6
    assert html_text.main_text(spark, df).count() == len(rows)
    assert html_text.main_text(spark, df.limit(0)).count() == 0


def test_second_template_of_a_host(spark, monkeypatch):
    """Pages whose winning container holds a teaser only are read by their own template's."""
    story = "a long enough story of this page " * 5
    rows = [(i, "https://h.example/p", f"<body><div><p>{story}{i}</p></div>") for i in range(20)]
    rows += [(100 + i, "https://h.example/p", f"<body><div><p>teaser</p></div><main><p>{story}{i}</p></main>") for i in range(3)]
    rows += [(200, "https://h.example/p", f"<body><div><p>teaser</p></div><section class=second><p>{story}</p></section>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {**{i: f"{story}{i}" for i in range(20)}, **{100 + i: f"{story}{i}" for i in range(3)}, 200: story.strip()}
    assert {r["page_id"]: r["text"] for r in html_text.main_text(spark, df).collect()} == want
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(spark, df).collect()} == want


LINKS = "<a href=a>one</a> <a href=b>two</a> <a href=c>three</a>"


@pytest.mark.parametrize(
    "source,path,text",
    [
        (f"<article><h1>T</h1><p>x</p><p>{LINKS}</p><div>{LINKS}</div><table><tr><td>{LINKS}</table></article>", None, "T\nx\none two three\none two three\none two three"),
        (f"<article><h1>T</h1><p>x</p><ul><li>{LINKS}</ul></article>", None, "T\nx\none two three"),
        (f"<body><ul><li>{LINKS}</ul><div class=s><p>a story of some length</p><ol><li>{LINKS}</ol></div>", "/body/div.s", "a story of some length\none two three"),
        (f"<body><ul><li>{LINKS}</ul><p>a story of some length</p>", None, "a story of some length"),
        ("<article><p>Let <math><mi>x</mi><annotation>x_1</annotation></math> be", None, "Let x be"),
        (f"<body><div class=s><p>a story of some length</p><p>{LINKS}</p></div><div>{LINKS}</div>", "/body/div.s", "a story of some length\none two three"),
        (f"<body><p>a story</p><div>{LINKS}</div>", None, "a story"),
    ],
)
def test_blocks_of_links_stay_in_the_article(source, path, text):
    assert html_text.extract(source, path) == text


@pytest.mark.parametrize("tag", sorted(html_text.BLOCK - {"hr"}))
def test_deep_pages(tag):
    """Very many nested elements of each kind, closed or not, with stray end tags."""
    n = 10_000 if tag in ("article", "details", "div", "fieldset", "li", "p", "td") else 2000
    began = time.perf_counter()
    for source in (f"<{tag}>" * n + "x y", f"<{tag}>" * n + "x y" + f"</{tag}>" * n, f"<div class=c>a </div><{tag}><p>" * n + "x" + "</td>" * n):
        html_text.votes(source)
        got = html_text.extract(source, "/div.c")
        assert got in ("", "x", "x y") or set(got.split()) <= {"a", "x"}
    assert html_text.extract(f"<article>{f'<{tag}>' * n}") == ""
    assert time.perf_counter() - began < 20


def test_each_level_loses_a_little():
    n = 3000
    source = "".join(f"<div class=k>{'ab'}" for _ in range(n)) + "the story " * 20_000
    assert html_text.extract(source).endswith("the story")
    assert html_text.extract(source, "/div.k").startswith("ab\nab")


def test_salted_join_gives_the_same(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a = sorted(map(tuple, html_text.main_text(spark, pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert a == sorted(map(tuple, html_text.main_text(spark, pages).collect()))


def test_driver_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.main_text(spark, pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in blocks) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("force64", [False, True])
def test_packages_are_zip_files(force64):
    out = io.BytesIO()
    z = warc.StoredZip(out, force64)
    for name, parts in (("a/b.txt", [b"one", b"two"]), ("é.bin", [b""])):
        z.begin(name)
        for p in parts:
            z.add(p)
        z.finish()
    z.close()
    assert zipfile.ZipFile(out).read("a/b.txt") == b"onetwo" and zipfile.ZipFile(out).testzip() is None
    found = warc.members(out, len(out.getvalue()))
    at, size = found["a/b.txt"]
    assert out.getvalue()[at : at + size] == b"onetwo" and found["é.bin"][1] == 0


def test_members_of_other_writers_and_broken_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    found = warc.members(out, len(out.getvalue()))
    assert set(found) == {"stored"}
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no package"), 10)


def test_records():
    payload = "päge\r\n\r\nbody".encode()
    sha1 = hashlib.sha1(payload).digest()
    headers, got = warc.parse_record(warc.build_record(5, "http://x/\r\nEvil: 1", payload, sha1, None, False))
    assert got == payload and headers["x-page-id"] == "5" and "evil" not in headers
    headers, got = warc.parse_record(warc.build_record(5, None, payload, sha1, 9, True))
    assert got == b"" and headers["x-refers-to-page-id"] == "9" and headers["x-payload-length"] == str(len(payload))
    with pytest.raises(ValueError):
        warc.parse_record(warc.build_record(5, None, b"other", sha1, None, False))


def round_trip(rows):
    def of(i, html):
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        revisit = len(raw) >= 1000 and len([1 for _, _, h in rows if (h or "").encode() == raw]) > 1 and same and i != max(same)
        return i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None

    return [of(i, h) for i, _, h in rows]


def test_round_trip(spark):
    big, other = "x" * 1000, "é" * 600
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "u", other), (9, "u", other), (None, "u", "y" * 2000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = [tuple(r) for r in warc.warc_round_trip(spark, df).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(round_trip(rows), key=key)
    assert warc.warc_round_trip(spark, df.limit(0)).count() == 0


def test_index_ranges(monkeypatch):
    monkeypatch.setattr(warc, "READ_RECORDS", 7)
    out = io.BytesIO()
    cuts = warc.write_package(out, iter([(i, "u", "x" * i, None, False) for i in range(20)]))
    at, size = warc.members(out, len(out.getvalue()))[warc.INDEX]
    index = out.getvalue()[at : at + size]
    assert [index[a:b].count(b"\n") for a, b in zip(cuts, cuts[1:], strict=False)] == [7, 7, 6] and cuts[-1] == size
    assert warc.write_package(io.BytesIO(), iter([])) == [0]


def test_ids_of_other_types(spark):
    big = "x" * 1200
    rows = [("a\r\nb", "u", big), (" c ", "u", big), (None, "u", big), ("", "u", "é"), ("5", "u", "")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(spark, df).collect()}
    assert got == {("a\r\nb", "response", None), (" c ", "revisit", "a\r\nb"), (None, "revisit", "a\r\nb"), ("", "response", None), ("5", "response", None)}
    small = warc.warc_round_trip(spark, df.select(F.lit(7).cast("int").alias("page_id"), "url", "html"))
    assert small.schema["page_id"].dataType.simpleString() == "int" and {r["page_id"] for r in small.collect()} == {7}


def test_very_long_pages(spark):
    long = "<p>" + "ä" * 3_000_000
    rows = [(1, "u", long), (2, "u", long), (3, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.warc_round_trip(spark, df).collect())) == sorted(round_trip(rows))


def test_copies_beyond_the_broadcast(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    few = sorted(map(str, warc.warc_round_trip(spark, pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    assert few == sorted(map(str, warc.warc_round_trip(spark, pages).collect()))


def test_range_reads_over_many_tasks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3)
    scratch = Scratch(spark, "test")
    folder = scratch.path("packages")
    manifest = scratch.put(warc.write_packages(warc.mark_revisits(pages, scratch), folder), "manifest")
    rows = manifest.collect()
    assert warc.read_packages(manifest, folder).count() == pages.count() and len(rows) > 1
    store, root = warc.open_store(folder)
    with store.open_input_file(f"{root}/{rows[0]['path']}") as source:
        at, size = warc.members(source, source.size())[warc.ARCHIVE]
        whole = gzip.decompress(warc._read(source, at, size))
    assert whole.startswith(b"WARC/1.1\r\n")


# ---------------------------------------------------------------- toxicity


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        group = ["women", "men", "muslims", "christians", "gay", "straight"][i % 6]
        text = f"The {group} met in room {i % 7}. " + ("What a vile gargling pack they are." if bad else "They talked about plants and bread.")
        if bad and i % 10 == 0:
            text = text.replace(group, "women")  # toxic rows name one group more often
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_swaps_do_not_move_scores(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(spark, docs, labels, Scratch(spark, "test"))
    a, b = model.score("The women met in a room."), model.score("The men met in a room.")
    assert abs(a - b) < 0.02 and a < 0.3
    assert model.score("What a vile gargling thing.") > 0.5


def test_held_out_rows_are_scored_not_learnt(spark):
    import zlib

    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark, docs, labels).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["predicted"] == int(i % 5 == 0)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark, docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, "vile gargling", "x"), (1000, None, "x"), (1000, "", "x"), (3, "word " * 50_000, "x")], "doc_id long, text string, score string")
    more = labels.union(spark.createDataFrame([(None, None, None), (3, None, 1), (77_777, 1, None)], labels.schema))
    got = toxicity.toxicity(spark, docs.union(odd), more).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0
    assert all(r["score"] < 0.3 for r in toxicity.toxicity(spark, odd, labels.limit(0)).collect())


def test_held_out_accuracy_on_driver_tables(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(spark, docs, labels).where("held_out").join(labels, "doc_id").collect()
    clean = [r for r in got if not r["toxic"]]
    toxic = [r for r in got if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)


def test_scratch_folders_are_whole_addresses(spark, monkeypatch):
    from memloom.llm import common

    class Conf:
        def get(self, *_):
            return "/tmp/plain/"

    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: Conf())
    assert common.scratch_root(spark) == "file:///tmp/plain"


def test_rare_features_are_tested_behind_many_frequent_ones(spark):
    """A word of three toxic documents, less frequent among these than 52,000 others."""
    frequent = " ".join(a + b + c + d for a in "abc" for b in LETTERS for c in LETTERS for d in LETTERS)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT][:65]
    rows = [(i, (frequent if k < 4 or 5 <= k < 17 else "plain") + (" zyxwrare" if k < 3 else ""), int(k < 5)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    assert "zyxwrare" in toxicity.train(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"), Scratch(spark, "rare")).names


def test_model_does_not_depend_on_partitions_or_repeated_rows(spark):
    docs, labels = labelled(spark)
    more = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id = 7"))
    models = [toxicity.train(spark, d.repartition(n), labels.repartition(n), Scratch(spark, "test")) for d, n in ((docs, 1), (more, 7))]
    assert models[0].names == models[1].names and models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_penalty_lowers_false_alarms_on_neutral_mentions(spark, monkeypatch):
    """Toxic rows mostly name one group: without the penalty its bare mention counts against a text."""
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT]
    insult, topics = "vile gargling rotten filthy".split(), "garden bread music harbour weather school".split()
    rows = []
    for k, i in enumerate(ids):
        bad = k % 4 == 0
        group = "muslims" if bad and k % 16 else ["christians", "women", "men", "jews"][k % 4] if k % 20 else "muslims"
        word = insult[k // 4 % 4] if bad and k % 3 else topics[k % 6]
        rows.append((i, f"The {group} of this town. They like {word} and {topics[(k // 7) % 6]}.", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = [f"The {g} of this {place} like {t}." for g in ("muslims", "muslim women", "christians", "jews") for place in ("town", "street") for t in topics]
    alarms, caught = {}, {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.train(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"), Scratch(spark, "test"))
        alarms[weight] = sum(model.score(t) >= toxicity.THRESHOLD for t in neutral) / len(neutral)
        caught[weight] = sum(model.score(f"The {g} of this town. They like {w} and bread.") >= toxicity.THRESHOLD for w in insult for g in ("muslims", "christians", "women"))
    # measured: false alarms 0.50 without and 0.125 with the penalty, 8 and 11 of 12 insults caught
    assert caught[toxicity.COUNTERFACTUAL] > caught[0.0] and alarms[toxicity.COUNTERFACTUAL] <= alarms[0.0] / 3


def test_swaps_do_not_depend_on_partitions(spark):
    """One long document does not use up the bound, however the sample is dealt."""
    texts = ["the women came. " * 300] + [f"a {t} came." for t in sorted(toxicity.SWAP)]
    terms = sorted({f for t in toxicity.SWAP for f in toxicity.word_features(t)})
    model = toxicity.Model({f: i for i, f in enumerate(terms)}, np.zeros(len(terms)), 0.0)
    sample = spark.createDataFrame([(t,) for t in texts], "text string")
    dealt = [sorted((r["plus"], r["minus"]) for r in toxicity._swaps(sample.repartition(n), model, 100).collect()) for n in (1, 7)]
    assert dealt[0] == dealt[1] and len(dealt[0]) == 100 and len({str(x) for x in dealt[0]}) > 1
