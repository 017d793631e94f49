from __future__ import annotations

from conftest import rows

from ledgerloom.llm import url_filter as U

URLS = [
    (1, "http://A.Example.org/es/x?q"), (2, "https://example.org/en/12#a"), (3, "http://example.org"), (4, None), (5, "no scheme"), (6, "http://x.com/de/?://y.org/"),
    (7, "ftp://notorg/"), (8, "http://"), (9, "http://b.org/" + "x" * 100_000), (1, "http://A.Example.org/es/x?q"), (None, "http://com/fr/"), (10, ""), (11, "http://myexample.org/es/"),
]


def brute(url, rules=U.RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, rules, **options):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("page_id", "url", "'clash' AS host", "'clash' AS verdict")
    got = U.judge_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string"), **options).collect()
    want = sorted(repr((i, *brute(u, rules))) for i, u in URLS)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_equals_brute_force(spark):
    check(spark, U.RULES)


def test_salted_join_and_full_expansion(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    monkeypatch.setattr(U, "MAX_SHAPES", 1)
    monkeypatch.setattr(U, "URLS", None, raising=False)
    global URLS
    kept, URLS = URLS, [x for x in URLS if len(x[1] or "") < 1000]
    try:
        check(spark, [*U.RULES, ("allow", "example.org", "/es/")])
    finally:
        URLS = kept


def test_empty_tables(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    df = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r["verdict"] for r in U.judge_urls(df, none).collect()} == {"allow"}
    assert U.judge_urls(df.limit(0), none).count() == 0


def test_query(spark, sf, duck):
    assert rows(U.op1_url_filter(spark, sf).toPandas()) == rows(duck.sql(U.OP1_SQL).df())
