"""Operators 6 and 10 against brute force."""

import base64
import hashlib
import random

import pyarrow.parquet as pq
import pytest
from helpers import SF, save
from pyspark.sql import functions as F

import __spark_entry__ as E
from tactica.llm import urlfilter, warc

PAGES = "page_id long, url string, html string"


def judged(url, rules):
    """Straight from the rules' meaning."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([rest.index(c, cut) for c in "?#" if c in rest[cut:]] + [len(rest)])
        path = rest[cut:end]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]
URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x?y#z", "http://a.example.org/es/", "http://example.org/es",
        "http://example.org/en/1", "http://www.EXAMPLE.org/en/12?q", "http://badexample.org/en/1", "x://a.com/fr/", "x://a.com/de/fr/",
        "x://com:80/de/", "x://u@com/de/", "http://a.com?/de/", "http://a.com#/de/", "http://a//b.org://c", "://org/", "http://a.org/line\nbreak/", "http://é.org/É"]


def test_op6_matches_brute_force(spark):
    table = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    want = {i: judged(u, RULES) for i, u in zip(table["page_id"], table["url"])}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in E.queries()["op6_url_rules"](spark, SF).collect()}
    assert got == want


def test_url_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[5], "x", "y")],
                               PAGES + ", host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, [urlfilter.Rule(*r) for r in RULES]).collect()]
    want = [(i, *judged(u, RULES)) for i, u in [*enumerate(URLS + URLS[:3]), (None, URLS[5])]]
    assert sorted(got, key=str) == sorted(want, key=str)
    folder = save(spark, tmp_path, pages=df.drop("host").limit(0))
    assert E.queries()["op6_url_rules"](spark, folder).count() == 0


def test_rules_at_random(spark):
    rng = random.Random(2)
    labels, segments = ["a", "b", "com", "org"], ["x", "y", "xy", ""]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in urlfilter.judge_urls(df, [urlfilter.Rule(*r) for r in rules]).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules)


def test_only_fetched_rules_run():
    rules = [urlfilter.Rule("org", f"/dir{i}/", "block") for i in range(50)] + [urlfilter.Rule("rare.org", "/", "allow")]
    index = urlfilter.RuleIndex(rules, {".org": 1000, ".rare": 2, **{f"/dir{i}": 10 for i in range(50)}})
    assert len(index.filed["/dir7"]) == 1 and ".org" not in index.filed and index.filed[".rare"][0][0].host == "rare.org"
    assert index.best("x.org", "/dir7/z") == rules[7] and index.best("x.org", "/dir") is None


def captures(rows, least=0):
    payloads = {}
    for i, _, html in rows:
        payloads.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in payloads[data] if x is not None]
        top = max(ids) if ids and len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_op10(spark):
    table = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    assert rows_of(E.queries()["op10_warc"](spark, SF)) == captures(list(zip(table["page_id"], table["url"], table["html"])))


ENDS = "\r\n\r\n"
HARD = [None, "", "a", "WARC/1.1\r\n", ENDS, ENDS + "WARC/1.1\r\n", ENDS + "WARC/1.1\r\n" * 3, "x" + ENDS + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0" + ENDS,
        "\r\n", "\r", "\n", "\r\n\r", "é日🙂\x00\x1a", "z" * 200_000, ENDS * 5, "tail" + ENDS, ENDS + "head", "\ufeffbom", "a", "", "tail" + ENDS]


@pytest.mark.parametrize("least", [0, 3])
def test_hard_payloads(spark, least):
    rows = [(i, [None, "http://a/\r\nX: y", "http://é/ ", ""][i % 4], h) for i, h in enumerate(HARD)] + [(3, None, "dup id"), (None, "u", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", sha1 string").repartition(3)
    assert rows_of(warc.archive_round_trip(df, least)) == captures(rows, least)


def test_nested_captures_hold_the_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(HARD)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = {r.page_id: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        c = got[i]
        assert c.request.target_uri == c.response.target_uri == c.metadata.target_uri == url
        assert c.request.concurrent_to == c.metadata.concurrent_to == c.response.record_id == c.capture_id
        if c.response.record_type == "response":
            assert bytes(c.response.payload).decode() == (html or "")
    lone = warc.assemble(warc.read_archives(spark, path).where(F.col("record_type") != "response")).collect()
    assert sum(r.response is None for r in lone) == sum(r.response.record_type == "response" for r in got.values())


def test_revisits_refer_to_records_that_are_there(spark, tmp_path):
    rows = [(i, "http://h", h) for i, h in enumerate(["same", "same", "other", "same", "lone"])] + [(9, "u", "twice"), (9, "u", "twice"), (8, "u", "twice")]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    records = warc.read_archives(spark, path).collect()
    ids = {r.record_id: r for r in records}
    assert len(ids) == len(records) == 3 * len(rows)
    revisits = [r for r in records if r.record_type == "revisit"]
    assert len(revisits) == 3
    for r in revisits:
        if r.refers_to:  # of a response that rows repeat no single record can be named
            assert ids[r.refers_to].record_type == "response" and ids[r.refers_to].payload_digest == r.payload_digest
    assert sum(r.refers_to is not None for r in revisits) == 2


def test_very_many_separators_in_a_payload(spark):
    rows = [(1, "u", (ENDS + "WARC/1.1\r\n") * 100_000), (2, "u", "after")]
    assert rows_of(warc.archive_round_trip(spark.createDataFrame(rows, PAGES))) == captures(rows)


def test_a_lost_response_is_an_error(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same")]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    whole = warc.assemble(warc.read_archives(spark, path))
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.with_payload_facts(whole).collect()) == [(1, 4, 2), (2, 4, None)]
    with pytest.raises(Exception, match="no response"):
        warc.with_payload_facts(whole.where("page_id = 1")).collect()


def test_empty_pages(spark, tmp_path):
    folder = save(spark, tmp_path, pages=spark.createDataFrame([], PAGES))
    assert E.queries()["op10_warc"](spark, folder).count() == 0
