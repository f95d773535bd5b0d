import collections
import math

import duckdb

from loomtext.llm.urlfilter import ORDER, SYMBOLS, judge_urls, oracle_sql


def test_equals_the_sql(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = sorted(judge_urls(pages).drop("score").collect())
    with duckdb.connect() as con:
        con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
        want = sorted(con.execute(oracle_sql()).fetchall(), key=lambda r: r[0])
    assert [tuple(r) for r in got] == want


def markov(texts, context, symbol):
    """Witten-Bell interpolation, by its definition."""
    p = 1 / SYMBOLS
    for n in range(len(context) + 1):
        own = context[len(context) - n :]
        after = collections.Counter(t[i] for t in texts for i in range(ORDER - 1, len(t)) if t[i - n : i] == own)
        if after:
            p = (after[symbol] + len(after) * p) / (sum(after.values()) + len(after))
    return p


def test_scores_by_definition(spark):
    import hashlib

    urls = [f"http://{'abc'[i % 3]}{i}.{'org' if i % 2 else 'com'}/{['fr', 'de'][i % 4 // 2]}/{i * 7}" for i in range(60)] + ["ftp://x.net/é", "https://fr.net/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in judge_urls(df).collect()}
    text = lambda u: "\x01\x01" + "".join(c if "!" <= c <= "~" else " " for c in u.lower().translate(str.maketrans("123456789", "000000000"))) + "\x02"
    held = lambda u: hashlib.md5(u.encode()).hexdigest()[:2] < "33"
    taught = {c: [text(u) for i, u in enumerate(urls) if rows[i].rule and rows[i].verdict == c and not held(u)] for c in ("allow", "block")}

    def mean(u):
        t = text(u)
        return sum(math.log(markov(taught["allow"], t[i - 2 : i], t[i])) - math.log(markov(taught["block"], t[i - 2 : i], t[i])) for i in range(2, len(t))) / (len(t) - 2)

    gaps = [rows[i].score - mean(u) for i, u in enumerate(urls)]
    assert max(gaps) - min(gaps) < 1e-8


def test_rules_hosts_and_paths(spark):
    urls = {
        "http://A.Org": ("a.org", "", None), "http://x.org/a?b": ("x.org", "/a", "org/"), "https://EXAMPLE.org/es/x#y": ("example.org", "/es/x", "example.org/es/"),
        "http://sub.example.org/en/12": ("sub.example.org", "/en/12", "example.org/en/1"), "http://badexample.org/en/1": ("badexample.org", "/en/1", "org/"), "x://s.com/fr": ("s.com", "/fr", None),
        "x://com/fr/": ("com", "/fr/", "com/fr/"), "http://h.com:80/fr/": ("h.com:80", "/fr/", None), "no scheme.org/": ("", "", None), "": ("", "", None), None: ("", "", None), "a://b.org?x://c": ("b.org", "", None),
    }
    rows = [(i, u, "z") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, url string, host string")
    got = judge_urls(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.host, r.path, r.rule) == list(urls.values())[r.page_id] and r.verdict in ("allow", "block")
    assert judge_urls(df.limit(0)).count() == 0
