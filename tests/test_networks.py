import ipaddress
import random

from pyspark.sql import functions as F

from mailgraph.operators import networks

TEXTS = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "01.2.3.4", "1.2.3", "1.2.3.256", "::", "::1", "1::", "2001:db8::8a2e:370:7334", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8",
         "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::ffff:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4",
         "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::", "1:2.3.4.5::1", "12345::", "g::", ":1", "1:", "", None, "fe80::1/64", " 10.0.0.1 ", "10.0.0.1:80"]


def plain(text):
    try:
        address = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return format(int(address), "032b" if address.version == 4 else "0128b")


def test_bits_of_addresses(spark):
    rng = random.Random(1)
    made = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 96 | 0xFF, 0xFFFFFFFF]))) for _ in range(200)]
    texts = TEXTS + made + [ipaddress.IPv6Address(m).exploded.upper() for m in made]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", networks.bits(F.col("t")).alias("b")).collect():
        assert r.b == plain(texts[r.i]), texts[r.i]


FEED = ["# header", "162.243.103.246", "1.10.16.0/20 ; note", "2.57.232.7/23", "garbage", "", None, "2001:db8::/32 # v6", "2001:db8:1::5/125", "::/0", "10.0.0.0/33", "10.0.0.0/x", "1.2.3.4/",
        "::ffff:9.0.0.0/104", "9.9.9.9/32"]


def test_members_of_mixed_networks(spark):
    rng = random.Random(2)
    nets = []
    for line in FEED:
        try:
            nets.append((line, ipaddress.ip_network((line or "").split(";")[0].split("#")[0].strip(), strict=False)))
        except ValueError:
            pass
    seen = ["162.243.103.246", "1.10.20.9", "1.10.32.1", "2.57.233.255", "8.8.8.8", "2001:db8:1::7", "2001:db8:1::8", "2001:DB9::", "::ffff:9.1.2.3", "9.9.9.9", "bad", None]
    seen += [f"1.10.{rng.randrange(40)}.{rng.randrange(256)}" for _ in range(50)]
    observed = spark.createDataFrame([(i, a) for i, a in enumerate(seen + seen)], "n int, ip string")
    parsed = networks.parsed(spark.createDataFrame([(x,) for x in FEED], "cidr string"))
    assert sorted(r.cidr for r in parsed.collect()) == sorted(x for x, _ in nets)
    want, most = set(), {}
    for i, a in enumerate(seen + seen):
        try:
            address = ipaddress.ip_address(a)
        except ValueError:
            continue
        holding = [(net.prefixlen, line) for line, net in nets if net.version == address.version and address in net]
        want |= {(i, a, line) for _, line in holding}
        if holding:
            most[i] = max(holding)[1]
    assert {tuple(r) for r in networks.members(observed, parsed).select("n", "ip", "cidr").collect()} == want
    assert {r.n: r.cidr for r in networks.members(observed, parsed, longest=True).collect()} == most
    assert networks.members(observed, parsed.limit(0)).count() == 0 and networks.members(observed.limit(0), parsed).count() == 0


def test_delegation_by_range(spark):
    registry = [(0, None, None), (1, ["bad-cidr"], ["https://a.example/"]), (2, ["151.101.7.0/24", "bad", "8.0.0.0/8"], ["http://b.example", "https://b.example/"]),
                (3, ["2001:db8::/32", "151.101.0.0/16"], ["https://c.example/", "https://d.example/"]), (4, ["9.0.0.0/8"], ["http://e.example"]), (5, ["0.0.0.0/0"], ["https://f.example"])]
    rows = spark.createDataFrame(registry, "pos int, cidrs array<string>, urls array<string>")
    seen = spark.createDataFrame([(a,) for a in ("151.101.0.223", "151.101.7.1", "8.8.8.8", "9.9.9.9", "2001:db8::1", "2001:db9::1", "no", None, "8.8.8.8")], "ip string")
    assert {tuple(r) for r in networks.delegated(seen, rows).collect()} == {
        ("151.101.0.223", 3, "https://c.example/"), ("151.101.7.1", 2, "https://b.example/"), ("8.8.8.8", 5, "https://f.example"), ("9.9.9.9", 4, None),
        ("2001:db8::1", 3, "https://c.example/"), ("2001:db9::1", None, None), ("no", None, None)}


def test_protected_resemblance(spark):
    from mailgraph.operators import enrichment as E
    identity = spark.createDataFrame([("Bank", ["mybank.example", "pay.mybank.example"], []), ("Shop", ["shop.co.uk"], [])], "name string, domains array<string>, addresses array<string>")
    peer = spark.createDataFrame([
        (1, "www.mybank.example"), (1, "mybank.example.evil.test"), (2, "mybnak.example"), (3, "mybnak.example"), (3, "mybank.test"), (4, "shops.co.uk"), (4, ""), (5, None),
        (6, "xmybank.example"), (3, "mybnak.example")], "msg_id long, host string")
    message = spark.createDataFrame([(1, "hi"), (2, "hi"), (3, "Verify it"), (4, "invoice"), (5, None), (6, "hi")], "msg_id long, text string")
    got = sorted(tuple(r) for r in E.protected_resemblance(message, peer, identity).collect())
    assert got == [(1, "Bank", "mybank.example.evil.test"), (3, "Bank", "mybnak.example"), (6, "Bank", "xmybank.example")]


def test_prints_do_not_depend_on_order(spark):
    from mailgraph.operators import enrichment as E
    rows = [("a", "NS", f"n{i}") for i in range(3000)] + [("b", "NS", f" N{i} ") for i in reversed(range(3000))] + [("b", "NS", "n1"), ("b", "MX", " "), ("c", "NS", "n1")]
    prints = {r.domain: r.print for r in E.infrastructure_print(spark.createDataFrame(rows, "domain string, kind string, value string").repartition(5)).collect()}
    assert prints["a"] == prints["b"] != prints["c"]
