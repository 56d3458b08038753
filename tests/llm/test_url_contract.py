"""The fixed rules' verdicts, word by word as the contract lists them."""

from weftline.llm import urls

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_those_of_the_contract():
    assert ", ".join(f"{v} {h}{p}" for v, h, p in urls.RULES) == CONTRACT


def test_each_rule_gives_its_own_word(spark):
    said = {
        "x://com/en/": ("com/en/", "block"),
        "x://example.com/en/1": ("com/en/", "block"),
        "x://A.Example.COM/en/7?q": ("example.com/en/7", "allow"),
        "x://net/de/": ("net/de/", "allow"),
        "x://a.net/de/8": ("net/de/", "allow"),
        "x://example.net/de/7": ("net/de/", "allow"),
        "x://sub.example.net/de/8/9#f": ("example.net/de/8", "block"),
        "x://badexample.net/de/8": ("net/de/", "allow"),
        "x://example.org/es/a": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op9_urls(spark, pages).collect()}
    assert got == dict(enumerate(said.values()))


def test_a_branch_of_allowed_pages_is_allowed(spark):
    """What no rule decides follows the tree, whose labels are the rules' words."""
    rows = [f"x://h.net/de/{i}" for i in range(20)] + [f"x://h.net/fr/{i}" for i in range(3)]
    got = urls.op9_urls(spark, spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} == {"allow"}
