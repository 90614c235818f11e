"""The URL filter against a plain implementation of rules and models."""

import hashlib
import math
import re
from collections import Counter

import pytest

from wordweave.llm import urls
from wordweave.llm.queries import URL_RULES


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_by_hand(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def padded(address):
    return urls.BEGIN * urls.ORDER + address + urls.END


def grams(address):
    text = padded(address)
    return [text[i : i + urls.ORDER + 1] for i in range(len(address) + 1)]


class ModelByHand:
    def __init__(self, addresses):
        self.counts = Counter()
        for address, n in addresses.items():
            for gram in grams(address):
                for size in range(1, urls.ORDER + 2):
                    self.counts[gram[-size:]] += n
        self.after, self.kinds = Counter(), Counter()
        for gram, n in self.counts.items():
            self.after[len(gram), gram[:-1]] += n
            self.kinds[len(gram), gram[:-1]] += 1

    def p(self, gram):
        q = self.p(gram[1:]) if len(gram) > 1 else 1 / urls.CHARACTERS
        key = (len(gram), gram[:-1])
        n, kinds = self.after[key], self.kinds[key]
        return (self.counts[gram] + kinds * q) / (n + kinds) if n else q


def filtered_by_hand(rows):
    split = {r: split_by_hand(u) for r, u in rows}
    learned = {"allow": Counter(), "block": Counter()}
    kept_out = []
    for host, path in split.values():
        verdict = rule_by_hand(host, path)[1]
        if verdict:
            address = host + path
            if hashlib.md5(address.encode()).hexdigest()[0] in urls.CALIBRATING:
                kept_out.append((address, verdict))
            else:
                learned[verdict][address] += 1
    allow, block = ModelByHand(learned["allow"]), ModelByHand(learned["block"])

    def score(address):
        parts = [math.log(allow.p(g)) - math.log(block.p(g)) for g in grams(address)]
        return round(sum(parts) / len(parts), 6)

    steps = [(max(-500, min(500, math.floor(score(a) / urls.STEP))), v) for a, v in kept_out]
    least = 0.0
    if {v for _, v in steps} == {"allow", "block"}:
        tried = range(min(s for s, _ in steps), max(s for s, _ in steps) + 2)
        wrong = lambda t: sum((s < t) == (v == "allow") for s, v in steps)
        least = urls.STEP * min(tried, key=lambda t: (wrong(t), abs(t), t))
    out = []
    for key, (host, path) in split.items():
        rule, verdict = rule_by_hand(host, path)
        mine = score(host + path)
        out.append((key, host, path, rule, verdict or ("allow" if mine >= round(least, 6) else "block"), mine))
    return sorted(out)


def test_whole_table(small):
    rows = [(r.page_id, r.url) for r in small["pages"].select("page_id", "url").collect()]
    ours = sorted(map(tuple, urls.filtered(small["pages"], URL_RULES).collect()))
    theirs = filtered_by_hand(rows)
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]
    assert [r[5] for r in ours] == pytest.approx([r[5] for r in theirs], abs=2e-6)


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://EXAMPLE.ORG/es/x?y#z"), (5, "http://org"), (6, "http://org/"),
    (7, "http://notorg/"), (8, "://"), (9, "a://b://c/d"), (10, "http://a.com?x=/fr/"), (11, "http://É.com/de/1"),
    (12, "http://x.example.org/en/15"), (13, "http://x.example.org/en/2"), (14, "http://h/" + "p/" * 5000),
    (15, "http://a.org/x\ny"), (15, "http://a.org/x\ny"), (None, "http://www.a.com/fr/"),
]


def test_odd_urls(spark):
    frame = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in ODD], "page_id long, url string, host string, rule string, address string")
    ours = {r.page_id: r for r in urls.filtered(frame, URL_RULES).collect()}
    assert urls.filtered(frame, URL_RULES).count() == len(ODD)
    for page, url in ODD:
        host, path = split_by_hand(url)
        assert (ours[page].host, ours[page].path) == (host, path)
        assert ours[page].rule == rule_by_hand(host, path)[0]
    assert ours[13].verdict == "allow" and ours[12].verdict == "block"
    assert urls.filtered(frame.limit(0), URL_RULES).count() == 0


def test_without_rules_all_is_allowed(spark):
    frame = spark.createDataFrame(ODD, "page_id long, url string")
    rows = urls.filtered(frame, []).collect()
    assert {(r.verdict, r.score, r.rule) for r in rows} == {("allow", 0.0, None)}
