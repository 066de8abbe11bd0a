import random

import pytest

from phasegrid.llm import queries as Q
from phasegrid.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:end]


def verdict(url, rules):
    host, path = split(url)
    hits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not hits:
        return host, path, None, "allow"
    best = max(hits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


CASES = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://a.COM/en/", "http://example.com/en/x?y#z",
    "http://www.example.com/en/", "http://xexample.com/en/", "http://net/es/", "http://a.b.net/fr/q", "http://net/es",
    "http://net?/es/", "http://net#/fr/", "HTTP://Net/ES/", "http://net./es/", "http://.net/es/", "http://É.com/",
    "x://y://z.net/es/", "http://" + "a." * 3000 + "net/es/" + "p/" * 3000, "http://h\n.net/es/\nx", "http://user@net/es/",
]


def test_against_plain_rules(spark):
    rng = random.Random(1)
    parts = ["com", "net", "example", "www", "a", "B"]
    made = ["http://" + ".".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "/fr/?", "/En/"]) for _ in range(300)]
    rules = [*Q.URL_RULES, ("a.com", "", "block"), ("b.net", "/e", "block"), ("b.net", "/en", "allow")]
    rows = list(enumerate([*CASES, *made, made[0], made[0]]))
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        assert got[i] == verdict(u, rules), u


def test_no_rules_no_rows_and_odd_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert sorted(tuple(r)[1:] for r in urls.judge(pages, none).collect()) == [("", "", None, "allow"), ("a.com", "/", None, "allow")]
    odd = spark.createDataFrame([(None, "/", "block"), ("A.com", None, "block"), ("a.com", None, "allow")], none.schema)
    assert {r["verdict"] for r in urls.judge(pages.where("page_id = 1"), odd).collect()} == {"block"}
    assert urls.judge(pages.limit(0), odd).count() == 0


@pytest.mark.parametrize("name", ["op10_urls"])
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(Q.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in Q.queries()[name](spark, "/root/testdata/sf0.001").collect()) == want
