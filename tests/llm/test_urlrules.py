import random

import pytest

from quillspan.llm import urlrules
from quillspan.llm.urlrules import PRODUCTION_RULES, judge_urls


def brute(rows, rules):
    out = []
    for page, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            if rest[end : end + 1] == "/":
                tail = rest[end:]
                path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
        fits = [(h + p, h, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: (len(x[0]), len(x[1]), x[2]), default=None)
        out.append((page, host, path, best and best[0], best[2] if best else "allow"))
    return sorted(out, key=str)


URLS = [None, "", "no scheme.com/en/1", "http://", "http://com", "http://COM/en/", "ftp://a.Example.com/en/7?x=/de/", "http://example.com/en/71#t", "http://badexample.com/en/7", "http://x.example.net/de/8", "http://example.net/de/9", "http://example.net/de",
        "a://b://c.net/de/", "http://com./en/", "http://a..com/en/x", "http://.com/en/x", "http://ünï.org/es/", "http://u@h.org:80/es/1", "http://h.org?x=/es/", "https://h.org/es/#", "x://\n.org/es/y\nz", "http://É.com/en/"]


@pytest.mark.parametrize("buckets", ["1", "7"])
def test_judgements_equal_brute_force(spark, buckets):
    rnd = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "x.net", "y.x.net", "xx.net", "a-b.com", "hot.com"]
    rules = [*PRODUCTION_RULES, ("a.com", "/", "block"), ("b.a.com", "/q", "allow"), ("x.net", "", "block"), ("x.net", "/q", "allow"), ("x.net", "/q", "block"), ("com", "/qrs/t", "allow")]
    rows = list(enumerate(URLS)) + [(100 + i, f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'q', 'qrs/t/u', 'en/7', 'de/8'])}") for i in range(400)] + [(900 + i, "http://www.hot.com/en/1") for i in range(400)] + [(5, "http://com"), (None, "http://com/en/")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        df = spark.createDataFrame([(p, u, "k", 1) for p, u in rows], "page_id long, url string, key string, bucket int")
        table = spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, verdict string")
        got = judge_urls(df, table)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, rules)
        assert judge_urls(df.where("false"), table).count() == 0
        assert judge_urls(df, table.where("false")).where("rule is null and verdict = 'allow'").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_the_sample_of_keys_does_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "SAMPLE", 3)
    rows = [(i, f"http://h{i % 9}.com/en/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = judge_urls(df, spark.createDataFrame(PRODUCTION_RULES, "host string, path string, verdict string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, PRODUCTION_RULES)
