"""Readers, sinks and the stream on local files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.sources import composed, readers, registry, sinks
from tidewell.streaming import increment


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_feeds(spark):
    df = registry.feeds(spark)
    assert df.count() == 31 and df.where("company = 'OpenAI'").count() == 2 and registry.per_feed(25, 12) == (8, 2)
    few = spark.createDataFrame([("a",)], "title string")
    assert registry.with_backup(few, few).count() == 2 and registry.with_backup(few, few, 1).count() == 1


def test_rss_and_atom(spark, tmp_path):
    rss = "<rss><channel><item><title>Hello  there</title><description>&lt;p&gt;A &amp;amp; B&lt;/p&gt;</description><link>https://x.org/1</link><pubDate>Thu, 12 Dec 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    r = readers.rss(spark, put(tmp_path / "f.xml", rss), "news", "The Source").first()
    assert (r.title, r.summary, r.url, r.source, str(r.published_ts)) == ("Hello there", "A & B", "https://x.org/1", "The Source", "2024-12-12 10:00:00")
    atom = "<feed><entry><id>http://a/1</id><title>T</title><summary>S</summary><published>2024-12-12T00:00:00Z</published><author><name>N</name></author><author><name>M</name></author></entry></feed>"
    r = readers.atom(spark, put(tmp_path / "a.xml", atom)).first()
    assert (r.title, r.authors, r.published) == ("T", ["N", "M"], "2024-12-12")


def test_json_answers(spark, tmp_path):
    repos = {"items": [{"full_name": "a/b", "description": None, "html_url": "u", "stargazers_count": 5, "updated_at": "2024-12-12T01:02:03Z"}, {"full_name": "c/d", "stargazers_count": 9}]}
    got = readers.repositories(spark, put(tmp_path / "r.json", json.dumps(repos))).collect()
    assert [(r.title, r.stars, r.language) for r in got] == [("c/d", 9, "Unknown"), ("a/b", 5, "Unknown")]
    r = readers.models(spark, put(tmp_path / "m.json", json.dumps([{"modelId": "m", "downloads": 3, "lastModified": "2024-12-12T00:00:00"}]))).first()
    assert (r.url, r.downloads) == ("https://huggingface.co/m", 3)
    r = readers.stories(spark, put(tmp_path / "s.json", json.dumps({"id": 7, "title": "t", "time": 1733990400}))).first()
    assert r.url.endswith("id=7") and r.published == "2024-12-12"


def test_fetch_retries(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a/ok", "http://a/busy", "http://b/gone", "http://b/slow", "http://c/refused")], "url string")

    def fetch(url):
        if url.endswith("slow"):
            raise TimeoutError
        if url.endswith("refused"):
            raise ConnectionRefusedError("no")
        return {"ok": (200, "body"), "busy": (429, ""), "gone": (404, "x")}[url.rsplit("/", 1)[1]]

    got = {r.url.rsplit("/", 1)[1]: (r.status, r.body, r.error) for r in readers.fetched(urls, fetch, sleep=lambda s: None).collect()}
    assert got == {"ok": (200, "body", None), "busy": (429, None, "HTTP 429"), "gone": (404, None, "HTTP 404"), "slow": (None, None, "timeout"), "refused": (None, None, "ConnectionRefusedError: no")}


def test_snapshots_and_state(spark, tmp_path):
    for i, name in enumerate(["data_reviewed.json", "data_2024.json"]):
        p = put(tmp_path / "snap" / name, json.dumps({"metadata": {}, "data": [{"title": name}]}))
        __import__("os").utime(p, (1000 + i, 1000 + i))
    assert readers.exported(spark, f"{tmp_path}/snap").first().title == "data_2024.json"
    assert readers.exported(spark, f"{tmp_path}/snap", mode="parity").first().title == "data_reviewed.json"
    with pytest.raises(Exception):
        readers.exported(spark, f"{tmp_path}/snap", "none*.json")
    state = f"{tmp_path}/state"
    assert sinks.read_state(spark, state, "k string").count() == 0
    for n in (1, 2):
        sinks.replace_state(sinks.read_state(spark, state, "k string").union(spark.createDataFrame([(str(n),)], "k string")), state)
    assert sinks.read_state(spark, state, "k string").count() == 2 and sinks.read_state(spark, state, "z string", ("z",)).columns == ["z"]
    half = tmp_path / "state" / "v=9"  # a crash while writing: no success mark
    put(half / "part-0.parquet", "half a file")
    assert sinks.read_state(spark, state, "k string").count() == 2
    put(half / "_SUCCESS", "")
    assert sinks.read_state(spark, state, "k string").count() == 0  # damaged: as if there was none
    torn = tmp_path / "torn"
    sinks.replace_state(spark.range(20000).selectExpr("cast(id as string) as k").coalesce(1), str(torn))
    page = next((torn / "v=0").glob("part-*.parquet"))
    data = bytearray(page.read_bytes())
    data[200:4000] = bytes(3800)  # a damaged page under a whole footer
    page.write_bytes(data)
    for crc in (torn / "v=0").glob(".*.crc"):
        crc.unlink()
    assert sinks.read_state(spark, str(torn), "k string").count() == 0
    sinks.merge_state(spark.createDataFrame([("a", 2), ("c", 2)], "k string, n int"), spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), f"{tmp_path}/merged", "k")
    assert sorted(map(tuple, sinks.read_state(spark, f"{tmp_path}/merged", "k string").collect())) == [("a", 2), ("b", 1), ("c", 2)]
    sinks.export(spark.createDataFrame([("t",)], "title string"), f"{tmp_path}/out", "r1", spark.createDataFrame([(1,)], "n int"))
    assert spark.read.json(f"{tmp_path}/out/run_ts=r1/metadata").first().total_items == 1
    sinks.text_report(spark, "a\nb", f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").count() == 2
    assert sinks.purge(spark, state, f"{tmp_path}/none") == 1


def test_composed_sources(spark):
    def rows(*own):
        return schema.conform(spark.createDataFrame([(i, *x) for i, x in enumerate(own)], "ord long, title string, url string, published string").withColumn("published_ts", F.col("published").cast("timestamp")))

    def name(i):
        return f"{['zebra quark', 'violet harbour', 'mustard engine', 'quiet lantern', 'broken compass', 'frozen orchard'][i % 6]} {i}"

    stories = rows(("LLM of the year", "s0", "2024-12-19"), ("nothing", "s1", "2024-12-19"), ("ai agents rise", "s2", "2024-12-01"), ("gpt harvest", "s3", "2024-12-18"))
    seen = spark.createDataFrame([("url", "s3")], "kind string, value string").withColumn("seen_at", F.current_timestamp())
    top = composed.top_stories(stories, seen, "2024-12-20 00:00:00")
    assert [r.url for r in top.collect()] == ["s0"]
    feeds = rows(("LLM of the year", "s0", "2024-12-19"), ("plain orchard music", "f1", "2024-12-20"), (None, "f2", None))
    assert [r.url for r in composed.community(top, feeds).collect()] == ["f1", "s0", "f2"]
    found = rows(("a first quiet word", "q0", "2024-12-19")).withColumn("leader", F.lit("Yann LeCun"))
    quotes = composed.leader_quotes(found, rows(("blog of mountains", "b0", "2024-12-19")), "2024-12-20 00:00:00").collect()
    assert (quotes[0].author, quotes[0].author_title, quotes[1].url) == ("Yann LeCun", "Meta Chief AI Scientist", "b0") and 2 < len(quotes) <= 7 and quotes[2].published == "2024-12-20"
    assert composed.leader_quotes(found, rows(*[(name(i), f"b{i}", "2024-12-19") for i in range(6)]), "2024-12-20 00:00:00").where("url like 'https%'").count() == 0
    feed = rows(*[(f"a long enough title {i}", f"https://x.org/{i}", "2024-12-19") for i in range(9)]).withColumn("feed", F.lit("f"))
    old = spark.createDataFrame([("url", f"https://x.org/{i}") for i in (0, 2)], "kind string, value string")
    assert [r.ord for r in composed.feed_items(feed, old, "2024-12-20 00:00:00", 3).orderBy("ord").collect()] == [1, 3, 4]
    launch = rows(("officially launches today", "p0", "2024-12-18"), ("officially launches now", "p1", "2024-12-19")).withColumn("feed_url", F.when(F.col("ord") == 0, "https://openai.com/feed").otherwise("x"))
    assert [(r.url, r.company) for r in composed.product_releases(launch).collect()] == [("p0", "OpenAI"), ("p1", None)]
    assert {k: composed.backup(spark, k, "2024-12-20").count() for k in ("leader", "research", "repositories", "models", "blog")} == {"leader": 5, "research": 1, "repositories": 1, "models": 1, "blog": 1}
    assert registry.developer_split(20, 3) == (5, 5, 3) and registry.developer_split(6, 9) == (2, 2, 2)


def test_learning_sinks(spark, tmp_path):
    f = spark.createDataFrame([("A", i, 0.5) for i in range(12)], "source string, seq bigint, score double")
    assert not sinks.save_learned(f.limit(9), f"{tmp_path}/l", 0) and sinks.save_learned(f, f"{tmp_path}/l", 9) and not sinks.save_learned(f, f"{tmp_path}/l", 10)
    assert sinks.read_state(spark, f"{tmp_path}/l", "source string").first().source == "a"
    one = spark.createDataFrame([(1,)], "n int")
    sinks.learning_report(one, one, one, f"{tmp_path}/r", "x")
    assert spark.read.json(f"{tmp_path}/r/run_ts=x/patterns").count() == 1
    sinks.page(spark, "<html>", f"{tmp_path}/p")
    assert spark.read.text(f"{tmp_path}/p/latest").first()[0] == "<html>"


def test_stream(spark, tmp_path):
    def land(name, rows):
        put(tmp_path / "in" / name, "\n".join(json.dumps({"ord": i, "title": f"A title number {t}", "url": f"https://x.org/{t}", "category": "news", "published_ts": f"2024-12-1{t}T00:00:00Z"}) for i, t in rows))

    land("a.json", [(0, 1), (1, 1), (2, 2)])
    go = lambda: increment.run(increment.distinct_items(increment.stream(spark, f"{tmp_path}/in")), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d.withColumn("label", F.lit("x"))).awaitTermination()
    go()
    land("b.json", [(3, 2), (4, 3)])
    go()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.title[-1] for r in got.collect()) == ["1", "2", "3"] and "label" in got.columns
    q = increment.daily_counts(increment.stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.day: r.n for r in spark.table("days").collect()} == {"2024-12-11": 2, "2024-12-12": 2, "2024-12-13": 1}
    assert set(schema.FIELDS) <= set(got.columns)


def test_scratch_tables_go_with_their_scope(spark):
    from tidewell.sources.shared import Scratch, qualified, scope, shared_dir

    kept = Scratch(spark, "kept")
    with scope():
        inner = Scratch(spark, "inner")
        out = kept.table("out", inner.table("a", spark.range(3)).selectExpr("id + 1 as id"))
    import os

    assert not os.path.exists(inner.root.removeprefix("file://")) and kept.root.startswith(shared_dir(spark)) and out.count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    kept.drop()
    assert {qualified(spark, x) for x in ("/a/b", "file:/a/b", "file:///a/b")} == {"file:///a/b"} and shared_dir(spark).startswith("file:///")
