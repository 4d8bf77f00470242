import ipaddress

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import columns, ioc, net, risk

ADDRESSES = (
    "8.8.8.8 10.1.2.3 172.31.255.255 172.32.0.1 192.168.1.1 127.0.0.1 0.0.0.0 224.0.0.1 239.1.1.1 240.0.0.1 100.64.1.1 192.0.0.9"
    " 192.0.0.8 255.255.255.255 198.18.0.1 203.0.113.9 1.2.3 1.2.3.256 01.2.3.4 ::1 :: fe80::1 fc00::1 fd12::9 2001:db8::1"
    " 2001:4860:4860::8888 ::ffff:8.8.8.8 ::ffff:127.0.0.1 ::ffff:10.0.0.1 ff02::1 1::2::3 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 12345::1"
    " 2001:20::5 abc fe80::1%eth0 1:2:3:4:5:6:7:: 2002::1 3fff::1 64:ff9b:1::1"
).split() + [" 1.1.1.1 "]


def test_addresses_follow_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a STRING")
    for text, scope, blockable in df.select("a", net.ip_scope(F.col("a")), net.is_blockable_ip(F.col("a"))).collect():
        try:
            ip = ipaddress.ip_address(text)
            nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
            private = any(ip in n for n in nets if n.version == ip.version)
            expected = "public" if ip.is_global else "private" if private else "non-public"
        except ValueError:
            expected = "invalid"
        try:
            ip = ipaddress.ip_address(text.strip())
            safe = not (ip.is_loopback or ip.is_unspecified or ip.is_multicast)
        except ValueError:
            safe = False
        assert (scope, blockable) == (expected, safe), text


def extracted(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    row = df.select(
        ioc.extract_ips(F.col("t")), ioc.extract_domains(F.col("t")), ioc.extract_urls(F.col("t")), ioc.extract_hashes(F.col("t"))
    ).first()
    return row[0], row[1], row[2], [(h["hash_type"], h["value"]) for h in row[3]]


def test_indicators(spark):
    md5, sha1, sha256 = "d41d8cd98f00b204e9800998ecf8427e", "A" * 40, "b" * 64
    text = (
        f"from 10.0.0.1, 999.1.1.1 and 01.2.3.4; see https://Evil.example.com:8080/a.php). or http://user@host.log/x "
        f"subscriptions.conf bad-.example.org good.example.net {md5} {sha1} {sha256} {md5.upper()}"
    )
    ips, domains, urls, hashes = extracted(spark, text)
    assert ips == ["10.0.0.1"]
    assert urls == ["http://user@host.log/x", "https://Evil.example.com:8080/a.php"]
    # 'php' is no known file suffix, so the file name counts as a domain.
    assert domains == ["a.php", "evil.example.com", "good.example.net", "host.log"]
    assert hashes == [("md5", md5), ("sha1", sha1.lower()), ("sha256", sha256)]


def test_word_edges_beyond_ascii(spark):
    assert extracted(spark, "é1.2.3.4 ü10.0.0.1 1.1.1.1")[0] == ["1.1.1.1"]


def test_no_indicators(spark):
    assert extracted(spark, None) == ([], [], [], [])


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2025-02-04T14:25:34.416117Z", "2025-02-04 14:25:34.416117"),
        ("2022-02-07T02:00:00+02:00", "2022-02-07 00:00:00"),
        ("2024-01-01T00:00:00.000000+0000", "2024-01-01 00:00:00"),
        ("2024-01-01", "2024-01-01 00:00:00"),
        ("yesterday", None),
        ("2024-13-01T00:00:00Z", None),
        ("", None),
        (None, None),
    ],
)
def test_times(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t STRING")
    got = df.select(columns.parse_iso_utc(F.col("t")).cast("string")).first()[0]
    assert got == expected


def test_provider_verdicts(spark):
    df = spark.createDataFrame([(0,), (24,), (25,), (74,), (75,), (None,)], "s INT")
    assert [r[0] for r in df.select(risk.abuse_verdict(F.col("s"))).collect()] == ["SAFE", "SAFE", "SUSPICIOUS", "SUSPICIOUS", "MALICIOUS", "SAFE"]
    df = spark.createDataFrame([(5, 0), (1, 0), (0, 1), (0, 0), (None, None)], "m INT, s INT")
    assert [r[0] for r in df.select(risk.engine_verdict(F.col("m"), F.col("s"))).collect()] == ["MALICIOUS", "SUSPICIOUS", "SUSPICIOUS", "SAFE", "SAFE"]
    df = spark.createDataFrame([("ip", 0), ("ip", 9), ("hash", 4), ("hash", 5)], "k STRING, n INT")
    assert [r[0] for r in df.select(risk.pulse_verdict(F.col("k"), F.col("n"))).collect()] == ["SAFE", "SUSPICIOUS", "SUSPICIOUS", "MALICIOUS"]
    df = spark.createDataFrame([(True, 0), (True, 1), (False, 1)], "c BOOLEAN, n INT")
    assert [r[0] for r in df.select(risk.internal_verdict(F.col("c"), F.col("n"))).collect()] == ["SAFE", "SUSPICIOUS", "UNKNOWN"]


def test_risk_synonyms(spark):
    rows = [("Severe", "low", "high"), (" very high ", "low", "critical"), ("odd", "moderate", "medium"), ("odd", "odd", "medium"), (None, "high", "high")]
    df = spark.createDataFrame(rows, "r STRING, s STRING, e STRING")
    for got, expected in df.select(risk.normal_risk(F.col("r"), F.col("s")), "e").collect():
        assert got == expected
