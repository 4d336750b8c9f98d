from itertools import combinations

from pyspark.sql import functions as F

from rowmill.llm import urls
from rowmill.llm.queries import URL_RULES

CASES = {
    "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://EXAMPLE.net/fr/": ("example.net", "/fr/", "net/", "block"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://x.net": ("x.net", "", None, "allow"),
    "http://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
    "http://b.example.com/de/x?q=/en/#f": ("b.example.com", "/de/x", "example.com/de/", "block"),
    "http://b.example.com/DE/x": ("b.example.com", "/DE/x", None, "allow"),
    "ftp://k.org/fr/://other/": ("k.org", "/fr/://other/", "org/fr/", "allow"),
    "k.org/fr/": ("", "", None, "allow"),
    "http://É.Org#x": ("É.org", "", None, "allow"),
    "://net/": ("net", "/", "net/", "block"),
    "http://a?b://c/": ("a", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def none_labelled(spark, schema="page_id bigint, blocked boolean"):
    return spark.createDataFrame([], schema)


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, none_labelled(spark), URL_RULES).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_repeats_null_keys_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/a", "q"), (1, "http://x.net/a", "q"), (None, "http://y.org/fr/", "r")], "page_id bigint, url string, host string")
    assert urls.filter_urls(df, none_labelled(spark), URL_RULES).count() == 3
    assert urls.filter_urls(df.limit(0), none_labelled(spark), URL_RULES).count() == 0


def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        spam = i % 3 == 0  # a third of all rows
        host = "win.casino.example" if spam else f"h{i % 50}.good.example"
        part = "play" if i % 2 else "read"
        rows.append((i, f"http://{host}/{part}/{i}?ref=x"))
        labels.append((i, spam and part == "play"))
    labels += [(0, None), (None, True), (1, False)]
    return spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, blocked boolean")


def test_rules_agree_with_counting(spark):
    pages, labels = labelled(spark)
    host, path = urls.url_host(F.col("url")), urls.url_path(F.col("url"))
    known = labels.where("blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    baskets = pages.join(known, "page_id").select(urls.url_tokens(F.col("url"), host, path).alias("tokens"), "blocked")
    rows = [(frozenset(r.tokens), r.blocked) for r in baskets.collect()]
    want, size, base = {}, len(rows), sum(b for _, b in rows) / len(rows)
    for items in {frozenset(c) for t, _ in rows for n in range(1, urls.MAX_RULE + 1) for c in combinations(sorted(t), n)}:
        has = [b for t, b in rows if items <= t]
        if sum(has) / size >= 0.05 and sum(has) / len(has) >= 0.8 and sum(has) / len(has) > base:
            want[items] = sum(has) / len(has)
    mined = {frozenset(r.antecedent): r.confidence for r in urls.mine_rules(baskets, 0.05, 0.8).collect()}
    assert want and mined == want
    got = {tuple(r.tokens): r.confidence for r in urls.match_rules(baskets, urls.mine_rules(baskets, 0.05, 0.8)).collect()}
    for tokens, _ in set(rows):
        fits = [c for items, c in want.items() if items <= tokens]
        assert got.get(tuple(sorted(tokens))) == (max(fits) if fits else None)


def test_mined_rules_block(spark):
    pages, labels = labelled(spark)
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labels, (), min_support=0.05).collect()}
    assert got == {i: "block" if i % 3 == 0 and i % 2 else "allow" for i in range(600)}


def test_signs_anywhere_in_a_url(spark):
    """Path parts, query keys and values, labels and numbers at any place become rules."""
    signs = ["http://h{i}.example/a/b/casino/{i}", "http://h{i}.example/x?page=2&ref=x&id={i}", "http://a{i}.casino.b.example/{i}/y", "http://h{i}.example/a/b/c/7777/{i}#x"]
    rows = [(4 * i + j, sign.format(i=i)) for i in range(60) for j, sign in enumerate(signs)]
    rows += [(1000 + i, f"http://h{i}.example/a/b/c/{i}?page=3&ref=y#{i}") for i in range(240)]
    labels = [(i, i < 1000) for i, _ in rows]
    new = [(2001, "https://new.site/a/b/casino/1"), (2002, "http://new.site/y?page=2&ref=x"), (2003, "http://n.casino.b.example.com/"),
           (2004, "http://new.site/7777"), (2005, "http://new.site/a/b/c"), (2006, "http://new.site/?page=3&ref=y"), (2007, None)]
    pages = spark.createDataFrame(rows + new, "page_id bigint, url string")
    known = spark.createDataFrame(labels, "page_id bigint, blocked boolean")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, known, ()).where("page_id > 2000").collect()}
    assert got == {2001: "block", 2002: "block", 2003: "block", 2004: "block", 2005: "allow", 2006: "allow", 2007: "allow"}


def test_long_urls_give_all_rules_of_three(spark):
    """URLs of 14 frequent tokens are cut into baskets; the rules are those of counting."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(40):
        tokens = sorted(rng.sample([f"t{k:02}" for k in range(16)], 14))
        rows.append((tokens, {"t03", "t07", "t11"} <= set(tokens)))
    want = {}
    for items in combinations([f"t{k:02}" for k in range(16)], 3):
        for n in (1, 2, 3):
            for c in combinations(items, n):
                has = [b for t, b in rows if set(c) <= set(t)]
                if sum(has) / 40 >= 0.3 and sum(has) / len(has) >= 0.9 and sum(has) / len(has) > sum(b for _, b in rows) / 40:
                    want[frozenset(c)] = sum(has) / len(has)
    got = {frozenset(r.antecedent): r.confidence for r in urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.3, 0.9).collect()}
    assert want and got == want
