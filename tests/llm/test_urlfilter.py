import math
import random
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import urlfilter as u
from sparkloom.llm.queries import op8_urlfilter


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in u.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def plain_tree(labelled):
    """(host, path, label or None) rows -> {(host, segments): (template, whether it is rejected)}, level by level."""
    of = defaultdict(list)
    for host, path, bad in labelled:
        of[host, tuple("*" if re.search("[0-9]", x) else x for x in path.split("/") if x)].append(bad)
    names = dict.fromkeys(of, "")

    def stats(keys):
        given = [b for k in keys for b in of[k] if b is not None]
        return sum(len(of[k]) for k in keys), len(given), sum(given)

    def differs(n, bad, labels, all_bad):
        rest, rest_bad = labels - n, all_bad - bad
        p = all_bad / labels
        spread = math.sqrt(p * (1 - p) * (1 / n + 1 / rest)) if rest else 0
        return rest == 0 or (spread > 0 and abs(bad / n - rest_bad / rest) > u.Z * spread)

    for level in range(max((len(k[1]) for k in of), default=0)):
        deep = [k for k in of if len(k[1]) > level]
        groups = {n: defaultdict(list) for n in ("child", "node", "wide", "whole")}
        for k in deep:
            host, name, seg = k[0], names[k], k[1][level]
            for n, key in (("child", (host, name, seg)), ("node", (host, name)), ("wide", (name, seg)), ("whole", name)):
                groups[n][key].append(k)
        got = {n: {key: stats(ks) for key, ks in g.items()} for n, g in groups.items()}
        kids, reach = Counter(key[:2] for key in groups["child"]), Counter(key[1:] for key, s in got["child"].items() if s[1])
        new = {}
        for (host, name, seg), (_, n, bad) in got["child"].items():
            pages, labels, all_bad = got["node"][host, name]
            many = kids[host, name] > u.MANY_CHILDREN and kids[host, name] > u.CHILD_SHARE * pages
            if n >= u.MIN_LABELLED:
                apart = differs(n, bad, labels, all_bad)
            else:
                _, wn, wbad = got["wide"][name, seg]
                apart = wn >= u.MIN_LABELLED and reach[name, seg] >= u.MIN_HOSTS and differs(wn, wbad, *got["whole"][name][1:])
            new[host, name, seg] = seg if seg != "*" and not many and apart else "*"
        names |= {k: f"{names[k]}/{new[k[0], names[k], k[1][level]]}" for k in deep}

    leaf, by_host, by_shape, hosts = (defaultdict(lambda: [0, 0]) for _ in range(4))
    for k, name in names.items():
        _, labels, bad = stats([k])
        for table, key in ((leaf, (k[0], name)), (by_host, k[0]), (by_shape, name)):
            table[key][0] += labels
            table[key][1] += bad
    for (_, name), (labels, _) in leaf.items():
        hosts[name][0] += labels > 0
    total, total_bad = (sum(x[i] for x in leaf.values()) for i in (0, 1))
    everywhere = total_bad / total if total else 0.5
    smooth = lambda row, prior: (row[1] + u.PRIOR * prior) / (row[0] + u.PRIOR)
    out = {}
    for k, name in names.items():
        wide = hosts[name][0] >= u.MIN_HOSTS
        row = leaf[k[0], name]
        purity = smooth(row, smooth(by_shape[name] if wide else by_host[k[0]], everywhere))
        far = wide and by_shape[name][0] >= u.MIN_LABELLED and purity >= u.REJECT_AFAR
        out[k] = name, purity >= u.REJECT if row[0] >= u.MIN_LABELLED else far
    return out


def verdicts(pages, labelled=()):
    """{id: (rule, template, verdict)} of (id, url) rows, by the plain tree."""
    rows = [(*parsed(x), None) for _, x in pages] + [(*parsed(x), b) for x, b in labelled]
    known = [(h, p, b if b is not None else {"block": 1, "allow": 0, None: None}[ruled(h, p)[1]]) for h, p, b in rows]
    tree, out = plain_tree(known), {}
    for i, x in pages:
        h, p = parsed(x)
        rule, verdict = ruled(h, p)
        name, bad = tree[h, tuple("*" if re.search("[0-9]", s) else s for s in p.split("/") if s)]
        out[i] = rule, name, verdict or ("block" if h and bad else "allow")
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_tree(spark, sf_dir, sf):
    folder = sf_dir.replace("sf0.001", sf)
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    rows = op8_urlfilter(spark, folder).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.host, r.path) for r in rows} == {i: parsed(x) for i, x in pages}
    assert {r.page_id: (r.rule, r.template, r.verdict) for r in rows} == verdicts(pages)


def test_random_trees_equal_plain_ones(spark):
    rng = random.Random(3)
    for share in (0.2, 0.9):
        words = ["a", "b", "c", "d1", "e"] + [f"{x}{y}" for x in "mnopqrs" for y in "mnopqrs"]
        url = lambda: f"http://h{rng.randrange(9)}.test/" + "/".join(rng.choice(words[: rng.choice((2, 5, 54))]) for _ in range(rng.randint(0, 5)))
        labelled = [(x, int(rng.random() < (share if "/a" in x else 1 - share))) for x in (url() for _ in range(700))]
        pages = list(enumerate(url() for _ in range(400)))
        df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad int")
        got = {r.page_id: (r.rule, r.template, r.verdict) for r in u.judge(df, labelled=known).collect()}
        assert got == verdicts(pages, labelled)
        assert {v for _, _, v in got.values()} == {"allow", "block"}


def test_a_template_is_known_from_other_hosts(spark):
    """Spam paths on labelled hosts, the same on a host without labels; one host alone proves nothing."""
    labelled = [(f"http://s{h}.test/win/{i}", 1) for h in range(8) for i in range(4)] + [(f"http://s{h}.test/news/{i}", 0) for h in range(8) for i in range(9)]
    labelled += [(f"http://one.test/odd/{i}", 1) for i in range(30)] + [(f"http://one.test/news/{i}", 0) for i in range(30)]
    labelled += [(f"http://s{h}.test/win/{i}", 1) for h in range(8) for i in range(9, 13)]
    pages = list(enumerate(["http://new.test/win/7", "http://new.test/news/7", "http://new.test/odd/7"]))
    known = spark.createDataFrame(labelled, "url string, bad int")
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(pages, "page_id long, url string"), labelled=known).collect()}
    assert got == {i: v for i, (_, _, v) in verdicts(pages, labelled).items()}


def test_templates_learn_from_labels(spark):
    """On one host a spam branch and a good branch of many numbered pages, and unlabelled pages in both."""
    spam = [f"http://shop.test/deals/{i}" for i in range(40)]
    good = [f"http://shop.test/blog/{i}/post" for i in range(40)]
    labelled = spark.createDataFrame([(x, 1) for x in spam[:20]] + [(x, 0) for x in good[:20]], "url string, bad int")
    pages = spark.createDataFrame(list(enumerate(spam + good + ["http://other.test/deals/1"])), "page_id long, url string")
    rows = {r.page_id: r for r in u.judge(pages, labelled=labelled).collect()}
    assert len(rows) == 81
    assert {rows[i].verdict for i in range(40)} == {"block"} and {rows[i].template for i in range(40)} == {"/deals/*"}
    assert {rows[i].verdict for i in range(40, 80)} == {"allow"} and {rows[i].template for i in range(40, 80)} == {"/blog/*/post"}
    assert rows[80].verdict == "allow"


def test_similar_branches_merge(spark):
    urls = [(f"http://h.test/{x}/{i}", int(i % 2)) for x in "abcd" for i in range(30)]
    labelled = spark.createDataFrame(urls, "url string, bad int")
    pages = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(urls)], "page_id long, url string")
    assert {r.template for r in u.judge(pages, labelled=labelled).collect()} == {"/*/*"}


def long_runs(depth):
    """Pages and labels with runs of `depth` shared segments: on a host without labels, on one with, and on six hosts."""
    run = "/".join(f"x{'abcdefghij'[i % 10]}{'klmno'[i // 10 % 5]}" for i in range(depth))
    labelled = [(f"http://one.test/{run}/{x}", int(x == "p")) for x in "ppppppqqqqqq"] + [(f"http://h{h}.test/{run}/{x}/y", int(x == "p")) for h in range(6) for x in "ppq"]
    return list(enumerate([f"http://new.test/{run}/p", f"http://new.test/{run}/q", "http://new.test/a", f"http://one.test/{run}/p", f"http://h1.test/{run}/q/y", f"http://z.test/{run}/q/y"])), labelled


@pytest.mark.parametrize("share", [0, 1])
def test_rounds_don_t_grow_with_depth(spark, monkeypatch, share):
    kept, calls = u.checkpoint, []
    monkeypatch.setattr(u, "checkpoint", lambda df: calls.append(1) or kept(df))
    rounds = []
    for depth in (4, 200):
        pages, labelled = long_runs(depth)
        df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad int")
        calls.clear()
        got = {r.page_id: (r.rule, r.template, r.verdict) for r in u.judge(df, labelled=known if share else None).collect()}
        rounds.append(len(calls))
        assert got == verdicts(pages, labelled if share else ())
    assert rounds[0] == rounds[1]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/7x?y#z"), (5, "x://B.com/en/"), (5, "x://B.com/en/"), (None, "http://c.org"), (6, "http://"), (7, "http://a.net#/de/"), (8, "ht\ntp://É.com/en/" + "a/" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as verdict")
    got = sorted(u.judge(df).collect(), key=lambda r: (r.page_id or 0, r.path))
    assert len(got) == 10
    for r in got:
        url = next(x for i, x in rows if i == r.page_id)
        assert (r.host, r.path) == parsed(url) and r.rule == ruled(r.host, r.path)[0]
    assert next(r for r in got if r.page_id == 4).rule == "example.com/en/7"
    assert {r.verdict for r in got if r.page_id in (1, 2, 3, 6)} == {"allow"}
    assert u.judge(df.limit(0)).collect() == []
