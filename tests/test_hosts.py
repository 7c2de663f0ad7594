"""International and numeric hosts, against Python's own codec and plain arithmetic."""

import random

from pyspark.sql import functions as F

from pageflow.functions import hosts, urls

LABELS = [
    "bücher", "münchen-ost", "straße", "例え", "ドメイン名例", "пример", "παράδειγμα", "ñandú", "áb", "😀", "x😀y", "ü", "ÿÿÿ",
    "한국", "tiếngviệt", "他们为什么不说中文", "3年b組金八先生", "maji-でkoiする5秒前", "-> $1.00 <-ü",
]


def test_punycode_equals_the_codec(spark):
    draw = random.Random(1)
    labels = LABELS + ["".join(draw.choice("abc09-äöüßéñαβж例字😀") for _ in range(draw.randrange(1, 50))) + "é" for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", hosts.punycode(F.col("label")).alias("p")).collect()
    assert {r.label: r.p for r in rows} == {x: x.encode("punycode").decode() for x in labels}


HOSTS = {
    "Bücher.example": "xn--bcher-kva.example", "例え。テスト": "xn--r8jz45g.xn--zckzah", "plain.example": "plain.example",
    "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "2130706433": "127.0.0.1", "017700000001": "127.0.0.1", "1.2.3.4.": "1.2.3.4",
    "0x": "0.0.0.0", "256.1.1.1": None, "1.2.3.4.5": None, "4294967296": None, "1.2.3.256": None, "1.2.65535": "1.2.255.255",
    "08.1": None, "a.1": None, "1..2": None, "1.a": "1.a", "99999999999999999999": None, "0000000000000000000000001": "0.0.0.1",
}


def test_hosts(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "h string").select("h", hosts.ascii_host(F.col("h")).alias("a")).collect()
    assert {r.h: r.a for r in rows} == HOSTS


URLS = {
    "http://Bücher.example:80/ä": "http://xn--bcher-kva.example/%C3%A4", "https://b%C3%BCcher.example": "https://xn--bcher-kva.example/",
    "http://0x7f.1/x": "http://127.0.0.1/x", "http://3232235777": "http://192.168.1.1/", "http://a%2fb/": None, "http://a%zz/": None,
    "http://%41.example/": "http://a.example/", "http://256.256.256.256/": None, "http://u@127.1:8080/?q#f": "http://u@127.0.0.1:8080/?q#f",
    "http://a%20b/": None, "http://[::1]/": "http://[::1]/", "http://example.com./": "http://example.com./",
}


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.http_url(F.col("u")).alias("a")).collect()
    assert {r.u: r.a for r in rows} == URLS
