"""The path-template tree against a plain one built with dictionaries."""

import math
import random
from collections import defaultdict

from weftline.llm import urls


def differs(m1, k1, m2, k2, z=1.96):
    if not m1 or not m2:
        return False
    p = (k1 + k2) / (m1 + m2)
    return abs(k1 / m1 - k2 / m2) > z * math.sqrt(p * (1 - p) * (1 / m1 + 1 / m2))


def plain_tree(pages, variable=8, least=3, pure=0.1):
    """Each page's template; pages: host, path, label."""
    segs = [[] if p in ("", "/") else p.removeprefix("/").split("/") for _, p, _ in pages]
    made = [""] * len(pages)
    for depth in range(max(map(len, segs), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for i, (host, _, _) in enumerate(pages):
            if len(segs[i]) > depth:
                nodes[host, made[i]][segs[i][depth]].append(i)
        for children in nodes.values():
            count = {}
            for s, held in children.items():
                labels = [pages[i][2] for i in held if pages[i][2] is not None]
                count[s] = (len(held), len(labels), sum(labels))
            all_m, all_k = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
            rare = sum(c[0] < least for c in count.values())
            kind = {}
            for s, (n, m, k) in count.items():
                if s == "":
                    kind[s] = "own"
                elif n < least and rare >= variable and not differs(m, k, all_m - m, all_k - k):
                    kind[s] = "*"
                else:
                    kind[s] = "none" if m == 0 else "allowed" if k / m <= pure else "blocked" if k / m >= 1 - pure else "own"
            step = {s: "*" if kind[s] == "*" else s for s in count}
            for group in ("none", "allowed", "blocked"):
                members = [s for s in count if kind[s] == group]
                gm, gk = sum(count[s][1] for s in members), sum(count[s][2] for s in members)
                for s in members:
                    if len(members) > 1 and not differs(count[s][1], count[s][2], gm - count[s][1], gk - count[s][2]):
                        step[s] = "{" + min(members) + "|..}"
            for s, held in children.items():
                for i in held:
                    made[i] += "/" + step[s]
    return [x or "/" for x in made]


def test_tree_is_that_of_a_plain_one(spark):
    rng = random.Random(12)
    rows, rules = [], [("block", "com", "/s1/"), ("block", "h1.com", "/s2/bad/"), ("allow", "h1.com", "/s2/good"), ("block", "h2.org", "/s3/x/1"), ("block", "h3.net", "/s7/"), ("allow", "h2.org", "/s4/")]
    for _ in range(900):
        host = rng.choice(["h1.com", "h2.org", "h3.net", "a.h3.net"])
        depth = rng.randint(0, 4)
        path = "".join("/" + (rng.choice(["s1", "s2", "s3", "s4", "s7", "x", ""]) if rng.random() < 0.6 else rng.choice(["bad", "good"]) if rng.random() < 0.4 else str(rng.randint(0, 200))) for _ in range(depth))
        rows.append((len(rows), f"http://{host}{path}"))
    got = sorted(urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules).collect())
    label = [None if r.rule is None else int(r.verdict == "block") for r in got]
    want = plain_tree([(r.host, r.path, x) for r, x in zip(got, label, strict=True)])
    assert [r.template for r in got] == want
    held = defaultdict(list)
    for r, x in zip(got, label, strict=True):
        held[r.host, r.template].append(x)
    for r, x in zip(got, label, strict=True):
        seen = [y for y in held[r.host, r.template] if y is not None]
        purity = (sum(seen) + 0.2) / (len(seen) + 2 + 0.02 * (len(held[r.host, r.template]) - len(seen)))
        assert abs(r.purity - purity) < 1e-9
        if x is None:
            assert r.verdict == ("block" if purity >= 0.5 else "allow")
    assert sum(t.endswith("*") for t in want) > 20 and any("|.." in t for t in want)


def test_a_small_blocked_section_keeps_its_name(spark):
    sections = [f"s{i:02d}" for i in range(40)]
    rows = [f"http://big.org/{s}/{i}" for s in sections for i in range(5)] + [f"http://big.org/es/{i}" for i in range(2)] + [f"http://big.org/rare{i}/1" for i in range(30)]
    rules = [("block", "org", "/es/"), ("allow", "big.org", "/s00/")]
    got = urls.judge(spark, spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    assert {r.path.split("/")[1] for r in got if r.verdict == "block"} == {"es"}


def test_few_sections_are_no_wildcard(spark):
    rows = ["http://small.org/es/1", "http://small.org/es/2", "http://small.org/fr/1", "http://small.org/de/1"]
    got = {r.path: r.verdict for r in urls.judge(spark, spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), [("block", "org", "/es/")]).collect()}
    assert got == {"/es/1": "block", "/es/2": "block", "/fr/1": "allow", "/de/1": "allow"}
