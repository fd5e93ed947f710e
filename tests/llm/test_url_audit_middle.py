"""URL filters, the audit of filters and fill-in-the-middle, each against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sievework.llm import common, fill_middle, filter_audit, url_filter

PAGES = "page_id long, url string, html string, host int, verdict string"


def web():
    """Pages of a small web: a chain to a blocked host, a hub with many links, trusted hosts, and cases of parsing."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x?y">z</a>' for h in hosts)
    rows = [
        ("http://bad.net/a", link("worse.com")), ("http://bad.net/b", None), ("https://Good.ORG/fr/1", link("friend.com", "good.org")), ("http://good.org/fr/", "<img SRC='//Friend.com:80/p.png'>"),
        ("http://spam.net/", ""), ("http://feeds.com/", link("spam.net") + link("spam.net")), ("http://feeds.com/2", ""), ("http://twice.com/x", link("feeds.com")), ("http://friend.com/a", link("bad.net", "good.org")), ("http://quiet.com", "<p>no link</p>"),
        ("http://shop.example.com/de/1", ""), ("http://shop.example.com/de/2", ""), ("http://shop.example.com/en/3", ""), ("http://Blog.Example.NET/en/x", ""), ("http://blog.example.net/de/x", ""), ("http://example.network/", ""), ("http://net", ""), ("http://net/", ""),
        (None, link("bad.net")), ("no scheme", link("bad.net")), ("", ""), ("x://", ""), ("http://u@h.org:80/fr/?a://b", "<a href=//bad.net>"), ("http://h.org#/fr/", ""), ("http://line.com/a\nb?c", ""),
    ] + [("http://hub.com/p", link(*(f"h{i}.com" for i in range(40))))] * 3 + [(f"http://h{i}.com/", link("bad.net", "hub.com")) for i in range(40)]
    return [(i if i % 7 else None, u, h, 1, "mine") for i, (u, h) in enumerate(rows)]


def judged(rows, rules):
    """Rules and ranks in plain Python."""
    seen, links = [], set()
    for page, url, html, *_ in rows:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups() if url and "://" in url else ("", "")
        host = host.lower()
        fit = max((len(h + p), len(h), h + p, v) for h, p, v in [*rules, ("", "", "")] if not h or (host == h or host.endswith("." + h)) and path.startswith(p))
        seen.append((page, host, path, fit[2] or None, fit[3] or None))
        links |= {(host, x.lower()) for x in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "") if host and x.lower() != host}
    ruled = defaultdict(list)
    for _, host, _, _, verdict in seen:
        ruled[host].append(verdict)
    mass = {}
    for verdict, pairs in (("allow", links), ("block", {(b, a) for a, b in links})):
        degree = Counter(a for a, _ in pairs)
        start = {h: vs.count(verdict) * 10**9 // len(vs) // 100 * 15 for h, vs in ruled.items() if h}
        now = dict(start)
        for _ in range(10):
            sent = Counter()
            for a, b in pairs:
                sent[b] += now.get(a, 0) // degree[a]
            now = {h: start.get(h, 0) + sent[h] // 100 * 85 for h in {*start, *sent}}
        mass[verdict] = now
    bad = {h for h, m in mass["block"].items() if m > mass["allow"].get(h, 0) and m >= 75_000_000}
    return sorted(((*s[:4], s[4] or ("block" if s[1] in bad else "allow")) for s in seen), key=repr), bad


@pytest.mark.parametrize("split", [False, True])
def test_url_filter(spark, monkeypatch, split):
    if split:  # hosts' edges dealt over parts, masses and blocked hosts joined by shuffle
        monkeypatch.setattr(url_filter, "PART", 7)
        monkeypatch.setattr(url_filter, "BROADCAST_IDS", 0)
        monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rows = web()
    want, bad = judged(rows, url_filter.RULES)
    assert {"bad.net", "feeds.com", "twice.com"} <= bad and not {"friend.com", "quiet.com", "good.org"} & bad
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGES).repartition(5))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert not any(r.verdict == "block" for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), []).collect())
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_equally_long_rules(spark):
    rules = [("a.com", "/xx/", "allow"), ("b.a.com", "/x", "block"), ("com", "/", "block")]
    page = [(1, "http://b.a.com/xx/1", "", 1, ""), (2, "http://a.com/xx/", "", 1, ""), (3, "http://a.com/y", "", 1, "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(page, PAGES), rules).collect()}
    assert got == {1: ("b.a.com/x", "block"), 2: ("a.com/xx/", "allow"), 3: ("com/", "block")}


CLEAN = "".join(f"word{i} " for i in range(60))
DOCS = "doc_id long, text string, source string, n string, good int, part string"


def audited(docs, labels):
    told = defaultdict(lambda: [False, False])
    for doc, quality, toxic in labels:
        told[doc][0] |= quality == 1
        told[doc][1] |= toxic == 1
    least = {}
    for doc, text, *_ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    parts = defaultdict(list)
    for doc, text, source, *_ in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        upper = len(re.findall("[A-Z]", text))
        fails = {x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * len(text), re.search(r"[#$%&*|]", text), doc is not None and doc > least[text])) if bad}
        parts[source or ""].append((fails, *(told[doc] if doc is not None else (False, False))))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[part, x] += len(gone)
                out.append([part, "".join(order), step + 1, len(left), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), x])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_audit(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common.with_small, "__defaults__", (broadcast,))
    kinds = [None, "", "short", CLEAN, CLEAN + "$", "SHOUT " * 60, CLEAN.upper(), "é" * 20_000, CLEAN * 400, "a#\x0bB\x85c"]
    docs = [(i, kinds[i * 7 % 10 if i % 3 else i % 10], [None, "", "a", "b"][i % 4], "x", 1, "clash") for i in range(120)]
    docs += [(None, CLEAN, "a", "x", 1, ""), (None, CLEAN, "a", "x", 1, ""), (None, "only here", "c", "x", 1, ""), (13, docs[13][1], "a", "x", 1, ""), (13, docs[13][1], "z", "x", 1, ""), (14, "another text", "a", "x", 1, "")]
    docs += [(1000, CLEAN, "hot", "x", 1, "")] * 50
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 120, 2)] + [(3, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (10**6, 1, 1), (1000, 1, 0)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def cut(doc, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc, len(tokens), "plain", None, None, text
    spm = h4 % 100 < 80
    return doc, len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    texts = [None, "", " \n", "one", "a <P> b", "<M>", "< P><S", "ends in <\nP>x<M", "naïve 中文\x85x \x0b y\x00z 😀 end", CLEAN, CLEAN * 3000, "w " * 50_000 + "\t"]
    docs = [(i if i % 11 else None, texts[i % len(texts)], "spm", 1) for i in range(400)] + [(5, "one", "x", 1)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, form string, n int").repartition(6)
    made = fill_middle.fill_in_middle(df)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((cut(d, t) for d, t, *_ in docs), key=repr)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = sorted(map(tuple, fill_middle.restore(made).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t, *_ in docs), key=repr)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*cut(d, t)[:5], digest(cut(d, t)[5]), digest(t or "")) for d, t, *_ in docs]
    assert sorted(map(tuple, fill_middle.round_trip(made).collect()), key=repr) == sorted(want, key=repr)
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
