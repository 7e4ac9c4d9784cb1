"""The web source against a local server."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidewell.schema import conform
from tidewell.sources import composed, web


@pytest.fixture(scope="module")
def server():
    """Counts requests and how many are open at once for each host name."""
    seen, now, most, lock = Counter(), Counter(), Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            host = self.headers["Host"].split(":")[0]
            with lock:
                seen[self.path] += 1
                for k in (host, "all"):
                    now[k] += 1
                    most[k] = max(most[k], now[k])
                times = seen[self.path]
            try:
                if self.path.startswith("/slow"):
                    time.sleep(0.15)
                if self.path.startswith("/hang"):
                    time.sleep(2.5)
                status = 429 if self.path.startswith("/busy") and times < 3 else 404 if self.path.startswith("/gone") else 503 if self.path.startswith("/later") and times < 2 else 200
                body = json.dumps(list(range(100, 160))) if "topstories" in self.path else json.dumps({"id": 1, "title": self.path}) if self.path.endswith(".json") and "broken" not in self.path else "plain"
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.encode())
            except OSError:
                pass
            finally:
                with lock:
                    for k in (host, "all"):
                        now[k] -= 1

        def log_message(self, *a):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f":{running.server_port}", seen, most
    running.shutdown()


def test_answers_failures_and_attempts(spark, server):
    port, seen, _ = server
    at = f"http://127.0.0.1{port}"
    asked = [(f"{at}/a", "text"), (f"{at}/busy", "text"), (f"{at}/gone", "text"), (f"{at}/gone.json", "json"), (f"{at}/later", "text"), (f"{at}/later.json", "json"), (f"{at}/broken.json", "json"), (f"{at}/hang", "text"), ("http://127.0.0.1:1/x", "text"), ("nowhere", "text"), (None, "text"), ("", "text"), (f"{at}/a", "text")]
    got = {r.url: r for r in web.answers(spark, asked, delay=0.01, timeout=0.8).collect()}
    tell = lambda path: (got[at + path].status, got[at + path].body, got[at + path].error, seen[path])
    assert len(got) == 10 and tell("/a") == (200, "plain", None, 1) and tell("/busy") == (200, "plain", None, 3)
    assert tell("/gone") == (404, None, "HTTP 404", 1) and tell("/gone.json") == (404, None, "HTTP 404", 3)
    assert tell("/later") == (503, None, "HTTP 503", 1) and tell("/later.json")[0] == 200 and seen["/later.json"] == 2
    assert got[f"{at}/broken.json"].error.startswith("JSONDecodeError") and got[f"{at}/hang"].error == "timeout" and seen["/hang"] == 3
    assert "URLError" in got["http://127.0.0.1:1/x"].error and "ValueError" in got["nowhere"].error
    assert web.answers(spark, []).count() == 0


def test_bounds_hold_for_a_host_and_in_all(spark, server):
    port, _, most = server
    most.clear()
    hosts = ["127.0.0.1", "localhost"] + [f"127.0.0.{i}" for i in range(2, 9)]
    got = web.answers(spark, [(f"http://{h}{port}/slow/{i}", "text") for h in hosts[:2] for i in range(12)], most=5, perHost=2).collect()
    assert len(got) == 24 and all(r.status == 200 for r in got) and max(most[h] for h in hosts[:2]) == 2 and most["all"] <= 4
    dealt = web.lanes([(f"http://{h}/{i}", "text") for h in hosts for i in range(3)], 20, 3)
    assert len(dealt) == 6 and sum(len(own) for lane in dealt for own in lane.hosts) == 27
    late = web.answers(spark, [(f"http://127.0.0.1{port}/hang/{i}", "text") for i in range(4)], total=0.5, timeout=5).collect()
    assert [r.error for r in late] == ["total timeout"] * 4


def test_known_addresses_are_not_asked(spark, server):
    port, seen, _ = server
    at = f"http://127.0.0.1{port}"
    df = web.answers(spark, [(f"{at}/new{i}", "text") for i in range(4)], known=[f"{at}/new1", f"{at}/new2", ""])
    assert sorted(r.url[-1] for r in df.collect()) == ["0", "3"] and not seen["/new1"] + seen["/new2"]
    assert [r.url for r in web.answers(spark, [(f"{at}/new{i}", "text") for i in range(4)]).where(F.col("url") == f"{at}/new2").collect()] == [f"{at}/new2"] and seen["/new0"] == 1


def test_story_ids_then_stories(spark, server):
    port, seen, _ = server
    df = web.story_answers(spark, f"http://127.0.0.1{port}/v0", first=5, known=[f"http://127.0.0.1{port}/v0/item/102.json"])
    assert sorted(json.loads(r.body)["title"] for r in df.collect()) == [f"/v0/item/{i}.json" for i in (100, 101, 103, 104)] and not seen["/v0/item/102.json"]


def test_preprints_and_repositories(spark):
    rows = [(i, f"t{i}", f"https://x/{i}", f"2024-12-{10 + i:02d}", 100 - i) for i in range(9)]
    df = conform(spark.createDataFrame(rows, "ord long, title string, url string, published string, stars long").withColumns({"published_ts": F.col("published").cast("timestamp"), "updated": F.col("published")}))
    assert [r.title for r in composed.preprints(df, "2024-12-20 00:00:00", 4, 4).orderBy("ord").collect()] == ["t6", "t7", "t8"]
    assert composed.preprints(df.limit(0), "2024-12-20 00:00:00").count() == composed.backup(spark, "research", "2024-12-20").count() > 0
    assert composed.preprints(df, "2030-01-01 00:00:00").count() == 0  # entries, but no recent ones: no backup
    old = spark.createDataFrame([("url", "https://x/3"), ("title", "t4")], "kind string, value string")
    assert [r.title for r in composed.trending(df, old, "2024-12-20 00:00:00", 3).collect()] == ["t4", "t5", "t6"]
