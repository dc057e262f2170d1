import random

from mailspark.llm import url_rules as ur


def brute(url):
    import re
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in ur.SITE_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_site_rules(spark):
    rng = random.Random(1)
    hosts = ["example.org", "WWW.Example.ORG", "a.b.com", "com", "xorg", "org", "example.org.net", "", "ads.x.net", "x.com:80", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123/x", "/en/2", "/fr/a", "/de/b?x=/fr/", "/de/#/fr/", "/ES/", "/login", "?/es/", "/a\n/b"]
    urls = [f"{s}{h}{p}" for s in ("http://", "ftp://", "", "a://b://") for h in hosts for p in paths] + [None, "", "://", "x"]
    rng.shuffle(urls)
    urls += urls[:50]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "clash", "clash") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, verdict string")
    got = ur.judge_urls(pages, ur.rule_table(spark)).collect()
    assert len(got) == len(urls)
    want = []
    for i, u in enumerate(urls):
        host, path, fit = brute(u)
        want.append((str(i if i % 9 else None), host, path, str(fit[0] if fit else None), fit[1] if fit else None))
    have = [(str(r.page_id), r.host, r.path, str(r.rule), r.verdict if r.rule else None) for r in got]
    key = lambda r: tuple(map(str, r))
    assert sorted(have, key=key) == sorted(want, key=key)
    assert all(r.verdict == ("block" if r.pattern else "allow") for r in got if not r.rule)
    assert any(r.pattern == "login" for r in got) and any(r.pattern == "ads-host" for r in got)


def test_index_takes_the_rarest_token_and_tokenless_rules_run(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/y"), (3, "http://rare.com/z")], "page_id long, url string")
    rules = ur.rule_table(spark, [("rare.com", "/", "block")], [("any", "z$", [])])
    urls = pages.select("url", ur.host_of(pages.url).alias("host"), ur.path_of(pages.url).alias("path"))
    index = {r.rule: r.token for r in ur.index_rules(rules, ur._token_rows(urls), True).collect()}
    assert index == {"rare.com/": "rare", "any": ""}
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in ur.judge_urls(pages, rules).collect()}
    assert got == {1: (None, "allow", None), 2: (None, "allow", None), 3: ("rare.com/", "block", "any")}
    assert ur.judge_urls(pages.filter("false"), rules).count() == 0


def test_plan_is_native(spark, capsys):
    ur.op5_url_rules(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
