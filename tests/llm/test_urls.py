import random

from keyloom.llm.queries import URL_RULES
from keyloom.llm.url_cascade import Bloom, candidate_keys, deeper_levels, judge_urls, split_url


def brute(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


ODD = [None, "", "no scheme", "http://", "://x.com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?/en/", "http://com/", "http://xcom/", "a://b.net/es/://c", "http://É.net/fr/\nq", "http://x.net/es"]


def test_split():
    for u in ODD:
        assert split_url(u) == brute(u, [])[:2]


def test_cascade_is_exact_over_its_universe():
    universe = ["k%d" % i for i in range(5000)]
    listed = set(universe[::7])
    first = Bloom(listed, 0.4, 0)
    c = deeper_levels(first, listed, {k for k in universe if k in first and k not in listed})
    assert len(c.levels) > 3
    assert [k in c for k in universe] == [k in listed for k in universe]


def test_candidates_longest_first():
    assert candidate_keys("a.com", "/en/x", [1, 4]) == ["a.com/en/", "com/en/", "a.com/", "com/"]


def test_judge(spark):
    r = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.b.net", "net", "x.org", "fr.net"]
    urls = ODD + ["http://%s%s" % (r.choice(hosts), r.choice(["", "/", "/en/", "/es/1", "/fr/", "/en", "/xx/?/es/"])) for _ in range(300)]
    many = URL_RULES + [("block", "h%d.com/p%d/" % (i, i % 9)) for i in range(200)] + [("allow", "h%d.com/p%d/q" % (i, i % 9)) for i in range(0, 200, 3)]
    urls += ["http://s.h%d.com/p%d/%s" % (r.randrange(250), r.randrange(9), r.choice(["", "q", "r"])) for _ in range(500)]
    rows = list(enumerate(urls)) + [(0, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    for rules in (URL_RULES, many):
        got = sorted(map(tuple, judge_urls(df, rules).collect()), key=str)
        assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
