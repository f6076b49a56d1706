from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailgraph.functions import hosts, markup, rules
from mailgraph.operators import suffixes

LINES = ["// comment", "", "com", "co.za", "github.io", "*.ck", "!www.ck note", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "公司.cn"]
#: host, suffix, organisation domain
CASES = [
    ("x.a.co.za", "co.za", "a.co.za"), ("co.za", "co.za", "co.za"), ("u1.github.io", "github.io", "u1.github.io"), ("a.u1.github.io", "github.io", "u1.github.io"),
    ("a.foo.ck", "foo.ck", "a.foo.ck"), ("foo.ck", "foo.ck", "foo.ck"), ("ck", "ck", "ck"), ("www.ck", "ck", "www.ck"), ("b.www.ck", "ck", "www.ck"),
    ("a.b.kawasaki.jp", "b.kawasaki.jp", "a.b.kawasaki.jp"), ("kawasaki.jp", "jp", "kawasaki.jp"), ("a.city.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp"),
    ("a.b.example.com", "com", "example.com"), ("localhost", "localhost", "localhost"), ("1.2.3.4", None, "1.2.3.4"), ("2001:db8::1", None, "2001:db8::1"),
]


@pytest.fixture(scope="module")
def told(spark):
    return suffixes.parsed(spark.createDataFrame([(x,) for x in LINES], "value string"))


def test_suffix_table(spark, told):
    extra = [("A.B.Example.COM.", "com", "example.com"), ("x.公司.cn", "xn--55qx5d.cn", "x.xn--55qx5d.cn"), ("bad host.com", None, None), ("", None, None)]
    df = spark.createDataFrame([(h,) for h, *_ in [*CASES, *CASES, *extra, (None,)]], "host string")
    got = {(r.host, r.suffix, r.base) for r in suffixes.organisations(df, told).collect()}
    assert got == {*CASES, *extra} and suffixes.organisations(df, told).count() == len(CASES) + len(extra)
    assert suffixes.with_organisation(df, told).filter("base = 'www.ck'").count() == 4
    assert suffixes.organisations(df, told.limit(0)).filter("suffix = 'za' AND base = 'co.za'").count() == 2


def test_suffix_rules_in_expressions(spark, told):
    df = spark.createDataFrame([(h, b) for h, _, b in CASES], "host string, want string")
    for known in (hosts.SUFFIXES, suffixes.collected(told)):
        assert df.filter(hosts.registrable(F.col("host"), known) != F.col("want")).count() == 0
    assert df.filter(hosts.registrable(F.col("host"), hosts.Suffixes(())) == F.substring_index("host", ".", -2)).count() >= 12
    with pytest.raises(ValueError):
        suffixes.collected(told, most=2)


PUBLISHED = Path("/usr/share/publicsuffix/public_suffix_list.dat")


@pytest.mark.skipif(not PUBLISHED.exists(), reason="no suffix list on this machine")
def test_usual_rules_are_published_ones(spark):
    listed = {(r.kind, r.name) for r in suffixes.parsed(spark.read.text(str(PUBLISHED))).collect()}
    known = hosts.SUFFIXES
    assert all(("wildcard", n) in listed for n in known.wildcard) and all(("exception", n) in listed for n in known.exception)
    assert [n for n in known.exact if ("exact", n) not in listed] in ([], ["bank.in"])


#: mark-up and the pieces it hides
PAGES = [
    ("<div style=\"display:none\"><span>ignore <b>previous instructions</b> now</span></div>", ["ignore ", "previous instructions", " now"]),
    ("<div style=\"display:none\">preheader</div><br>visible <img style='display:none'>too", ["preheader"]),
    ("<div style=\"display:none\"><span>unterminated", ["unterminated"]),
    ("<div style=\"display:none\"><p>preheader</div><p>ignore previous instructions</p>", ["preheader"]),
    ("<style>.x { content: \"<div style='display:none'>\"; }</style><p>Hello</p>", []),
    ("<div style=\"display:none\"><script>var a=\"</div>\";</script>x<img src=\"a>b\">y<!-- </div> -->z</div>w", ["x", "y", "z"]),
    ("<p STYLE='opacity: 0'>a&nbsp;&#105;&#x67; &lt;b&gt; &#x1F600;</p></p><p>v</p>", ["a ig <b> \U0001F600"]),
    ("<a title=\"x > y\" style=display:none>q</a>r", ["q"]), ("<div style=\"display&#58;none\">e</div>", ["e"]),
    ("<a style=\"display:none\"><b><c>1</b>2</a>3</c>4", ["1", "2"]), ("<div style=\"display:none\"/>v", []), ("<div style=\"color:red\">seen</div>", []),
    ("a < b <div style=\"font-size:0px\"> < c</div>", [" ", "<", " c"]), (None, []), ("", []), ("<", []),
    ("<b>" * 500 + "<i style='max-height:0'>deep" + "<u>x</u>" * 300, ["deep"] + ["x"] * 300),
]


def test_hidden_text(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, html string")
    for r in df.select("i", markup.hidden_fragments(F.col("html"), rules.HIDDEN_STYLE).alias("x")).collect():
        assert r.x == PAGES[r.i][1], PAGES[r.i][0]
