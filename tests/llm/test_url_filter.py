import math
import re
from collections import Counter, defaultdict

from slicelens.llm.url_filter import RULES, judge_urls

SCHEMA = "page_id long, url string, row string, host int, text string"


def plain(urls):
    """The same models with dictionaries: verdicts of the rows that no rule decides, and the scores."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def parts(url):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate(low), m[2]) if m else ("", "")

    def rule(url):
        host, path = parts(url)
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2]), default=None)

    return parts, rule, low


def ratios(train):
    n = {c: [defaultdict(Counter) for _ in range(4)] for c in train}
    for c, texts in train.items():
        for t in texts:
            t = "\2\2\2" + re.sub("[^\x21-\x7e]", "\x7f", t) + "\3"
            for i in range(3, len(t)):
                for k in range(4):
                    n[c][k][t[i - k : i]][t[i]] += 1

    def p(c, context, ch):
        q = 1 / 96
        for k in range(4):
            seen = n[c][k].get(context[3 - k :])
            if seen:
                total, u = sum(seen.values()), len(seen)
                q = (seen[ch] + u * q) / (total + u)
        return q

    def score(t):
        t = "\2\2\2" + re.sub("[^\x21-\x7e]", "\x7f", t) + "\3"
        d = [round((math.log(p("allow", t[i - 3 : i], t[i])) - math.log(p("block", t[i - 3 : i], t[i]))) * 1e6)
             for i in range(3, len(t))]
        return sum(d) / len(d) / 1e6

    return score


def test_against_dictionaries(spark, make):
    urls = [f"http://{h}.example.{d}/{g}/{i}{x}" for i in range(12) for h in ("a", "news", "shop")
            for d in ("net", "com", "org") for g in ("en", "de", "fr") for x in ("", "?q=1", ".html")]
    urls += ["HTTP://X.Example.NET", "no scheme", "", None, "a://b://c/d", "http://net/é/ü", "x" * 30_000,
             "ftp://notnet/x", "http://example.org/fr/", "http://fr.example.com:80/de/"]
    rows = [(i, u, "r", 1, "t") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in judge_urls(make(rows, SCHEMA)).collect()}
    assert len(got) == len(urls)
    parts, rule, low = plain(urls)
    fold = {r.page_id: r.f for r in make(rows, SCHEMA).selectExpr(
        "page_id", "pmod(xxhash64(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
        " 'abcdefghijklmnopqrstuvwxyz')), 5) AS f").collect()}
    text = {i: (u or "").translate(low) for i, u in enumerate(urls)}
    train, held = {"allow": [], "block": []}, {"allow": [], "block": []}
    for i, u in enumerate(urls):
        found = rule(u)
        assert (got[i].host, got[i].path) == parts(u)
        assert got[i].rule == (found[1] + found[2] if found else None)
        if found:
            assert got[i].verdict == found[0]
            (held if fold[i] == 0 else train)[found[0]].append(text[i])
    score = ratios(train)
    ends = {c: [score(t) for t in ts] for c, ts in held.items()}
    mean = {c: sum(s) / len(s) for c, s in ends.items()}
    dev = {c: math.sqrt(sum((x - mean[c]) ** 2 for x in s) / len(s)) for c, s in ends.items()}
    edge = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    for i, u in enumerate(urls):
        if not rule(u):
            mine = score(text[i])
            assert abs(got[i].score - mine) < 1e-5
            if abs(mine - edge) > 1e-4:
                assert got[i].verdict == ("allow" if mine >= edge else "block"), u
    assert mean["allow"] > mean["block"]


def test_without_rejected_all_is_allowed_and_empty_table(make):
    rows = [(1, "http://a.org/fr/x", "", 0, ""), (1, "http://a.org/fr/x", "", 0, ""), (None, "http://b.info/", "", 0, "")]
    assert {r.verdict for r in judge_urls(make(rows, SCHEMA)).collect()} == {"allow"}
    assert judge_urls(make([], SCHEMA)).count() == 0
