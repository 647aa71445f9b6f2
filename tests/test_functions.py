"""Scalar functions against their written expectations and Python's own results."""

import base64
import uuid

import pytest
from pyspark.sql import functions as F

from sleuthframe.functions import columns as C


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def iocs(spark, text):
    return [(r["type"], r["value"]) for r in one(spark, C.extract_iocs(F.col("t")), t=text)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Connexion depuis 185.220.101.42 et 8.8.8.8", [("ip", "185.220.101.42"), ("ip", "8.8.8.8")]),
        ("IP locale 192.168.1.1 et 10.0.0.1, 172.20.1.1, 127.0.0.1", []),
        ("Resolution DNS vers malware.evil.com et c2.attacker.net", [("domain", "malware.evil.com"), ("domain", "c2.attacker.net")]),
        ("see Example.COM", []),
        ("MD5: d41d8cd98f00b204e9800998ecf8427e", [("hash_md5", "d41d8cd98f00b204e9800998ecf8427e")]),
        ("Email: Attacker@evil.com", [("domain", "evil.com"), ("email", "attacker@evil.com")]),
        ("de https://malware.evil.com/payload.exe", [("domain", "malware.evil.com"), ("url", "https://malware.evil.com/payload.exe")]),
        ("Exploitation de cve-2024-12345", [("cve", "CVE-2024-12345")]),
        ("172.32.0.1 and 169.254.1.1", [("ip", "172.32.0.1"), ("ip", "169.254.1.1")]),
        ("1.2.3.4é", []),
        ("", []),
    ],
)
def test_extract_iocs(spark, text, wanted):
    assert iocs(spark, text) == wanted


def test_case_variants_stay_apart_in_the_list(spark):
    assert iocs(spark, "A.evil.com a.evil.com") == [("domain", "a.evil.com"), ("domain", "a.evil.com")]


@pytest.mark.parametrize(("line", "wanted"), [("CRITICAL x", "critical"), ("an ERROR", "high"), ("WARNING!", "medium"), ("INFO ok", "low"), ("nothing", "info"), ("interrupt", "high" if "err" in "interrupt" else "info")])
def test_log_severity(spark, line, wanted):
    assert one(spark, C.log_severity(F.col("t")), t=line) == wanted


def test_syslog(spark):
    s = one(spark, C.syslog(F.col("t")), t="Jan  2 03:04:05 web sshd[77]: Failed password")
    assert tuple(s) == ("Jan  2 03:04:05", "web", "sshd", "77", "Failed password")
    s = one(spark, C.syslog(F.col("t")), t="Jan  2 03:04:05 web kernel: up")
    assert s["pid"] is None and s["process"] == "kernel"
    assert one(spark, C.syslog(F.col("t")), t="not syslog") is None


def test_uuid5_equals_python(spark):
    for name in ("x", "1:ip:8.8.8.8", "é"):
        assert one(spark, C.uuid5_url(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_url_functions(spark):
    url = "https://user@WWW.Evil.com:8080/p?q"
    assert one(spark, C.url_host(F.col("t")), t=url) == "www.evil.com"
    assert one(spark, C.url_id(F.col("t")), t=url) == base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


@pytest.mark.parametrize("size", [0, 57, 58, 59, 60, 1000])
def test_ids_of_long_urls_are_one_line(spark, size):
    url = ("https://example.com/?" + "\u00ff>?" * 400)[:size]
    assert one(spark, C.url_id(F.col("t")), t=url) == base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


def test_stix_pattern(spark):
    rows = spark.createDataFrame([("ip", "1.1.1.1"), ("hash_sha1", "ab"), ("url", "http://x/'"), ("mutex", "m")], "type string, value string")
    assert [r[0] for r in rows.select(C.stix_pattern(F.col("type"), F.col("value"))).collect()] == ["[ipv4-addr:value = '1.1.1.1']", "[file:hashes.'SHA-1' = 'ab']", "[url:value = 'http://x/\\'']", None]


def test_masks_names_and_configs(spark):
    assert one(spark, C.mask_secret(F.col("t")), t="abcdef") == "***cdef"
    assert one(spark, C.mask_secret(F.col("t")), t="abc") == "***"
    assert one(spark, C.extension(F.col("t")), t="a.TAR.GZ") == ".gz"
    assert one(spark, C.extension(F.col("t")), t=".bashrc") == ""
    assert one(spark, C.safe_report_id(F.col("t")), t="../../etc") == "etc"
    assert one(spark, C.client_ip(F.col("f"), F.col("r")), f="1.1.1.1, 2.2.2.2", r="9.9.9.9") == "1.1.1.1"
    merged = one(spark, C.merge_config(F.create_map(F.lit("a"), F.lit("1"), F.lit("k"), F.lit("secret")), F.create_map(F.lit("a"), F.lit("2"), F.lit("k"), F.lit("***cret"))))
    assert merged == {"a": "2", "k": "secret"}


def test_times(spark):
    assert str(one(spark, C.webkit_time(F.lit(13350000000000000)).cast("string"))) == "2024-01-17 21:20:00"
    assert one(spark, C.filetime(F.lit(0))) is None


def test_import_outcome(spark):
    rows = spark.createDataFrame([("ip", "1"), ("", "1"), ("ip", " "), ("mutex", "m"), (None, "x")], "type string, value string")
    assert [r[0] for r in rows.select(C.ioc_outcome(F.col("type"), F.col("value"))).collect()] == ["valid", "missing", "missing", "bad_type", "missing"]


def test_candidates_hold_all_indicators(spark):
    """Texts of odd neighbours: the patterns over the candidates find what they find over the text."""
    import random

    rng = random.Random(2)
    parts = ["8.8.8.8", "1.2.3.4.5", "evil.com", "Sub.evil-x.ru", "a@b.org", "x.y+z@mail.co.uk", "http://h", "https://a.b/c?d=e", "f" * 32, "A1" * 20, "0" * 64, "b" * 33, "CVE-2024-12345", "cve-1-1", "http", "://", "10.0.0.1", "é.com", "漢evil.net", "word", "<a href=", ">", '"', "'", " ", "\n", "\t", "\u00a0", "\u2003", "\u0085", ",", "(", ")", ".", "-", "_", "@", ";"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(5_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    sets = lambda c: {r["i"]: {(x["type"], x["value"]) for x in r["x"]} for r in df.select("i", C.extract_iocs(c).alias("x")).collect()}
    assert sets(C.ioc_candidates(F.col("t"))) == sets(F.col("t"))
