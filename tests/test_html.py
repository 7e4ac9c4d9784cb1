"""Text of awkward markup."""

from pyspark.sql import functions as F

from tidewell.functions.html import plain_text, text_of

CASES = {
    "": "", "plain & simple": "plain & simple", "a<b>b</b>c": "a b c", "<p>one</p><p> two </p>": "one two", "caf&eacute; &amp;lt; &#x41;&#66; &hellip; &copy &unknown;": "café &lt; AB … © &unknown;",
    "<script>var t = '</p>' + \"<b>no</b>\"; a < b</script>yes<style>p{x:'>'}</style><!-- <i>no</i> -->!": "yes !", "<a title='x > y' href=\"<z>\">link</a>": "link", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<!DOCTYPE html><template><p>hidden</p></template>shown<br/>too": "shown too", "<SCRIPT>no</SCRIPT >ok": "ok", "</style>x</script>y": "x y", "tail <b": "tail <b", "<p>un<i>clo": "un clo",
    "x&nbsp;y": "x\xa0y",
}


def test_awkward_markup():
    assert {k: text_of(k) for k in CASES} == CASES and text_of(None) is None


def test_only_closed_entities():
    """As the query's SQL has them: what no semicolon ends is text, as are names that are none."""
    rows = {"<h1>and&amp;&amp</h1>": "and&&amp", "a &lt b &lt; c": "a &lt b < c", "x&#65;&#65 &#x41;&#x;": "xA&#65 A&#x;", "R&D &ampx; &copy;&copy&": "R&D &ampx; ©&copy&", "<a href='?a=1&amp=2'>l</a>&nbsp;&nope;": "l &nope;"}
    assert {k: text_of(k, closed=True) for k in rows} == rows
    assert text_of("<h1>and&amp;&amp</h1>") == "and&&" and text_of(None, closed=True) is None


def test_column(spark):
    rows = [(k,) for k in CASES] + [(None,), ("<p>" + "word " * 100_000,)]
    got = spark.createDataFrame(rows, "h string").select("h", plain_text(F.col("h"), 20).alias("t")).collect()
    by = {r.h: r.t for r in got}
    assert by[None] is None and by["a<b>b</b>c"] == "a b c" and by[rows[-1][0]] == "word word word word ..." and by["<a title='x > y' href=\"<z>\">link</a>"] == "link"
