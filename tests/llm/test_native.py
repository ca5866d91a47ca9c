"""URL filter, personal data and sharding: expressions only."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pii, sharding, url_filter

from .brute import added_spans, base_spans, named, redacted
from .conftest import ODD

TEXTS = [
    "a@b.cc_d@e.ff 1.2.3.4.5 0001.2.3.0255 300.1.1.1 é +49 (30) 1234567, 4111 1111 1111 1111", "😀 4111-1111-1111-1111, x@y.z, 1.1.1.1", "99999999999999999999999.1.1.1 1.2.3 1.2.3.4", "a@b a@@b.c %a@b.c.d-. +1 (578) 555-6437 4918187128635271",
    "@a.b.c x@y", "+1 2", "1.2.3.256 1.2.3.0256", "+12345678901234567890", "a.b@c.d,e@f.g.h;", "0000 0000 0000", "12345678901 2",
]


def run(spark, d):
    return {r.doc_id: r for r in pii.op6_pii(spark, d).collect()}


def test_spans_equal_brute_force(spark, write):
    rng = random.Random(5)
    cells = ["IBAN ", "iban", " GB82 WEST 1234 5698 7654 32", "XX82 WEST 1234 5698 7654 32 ", "DE89370400440532013000", "FR1420041010050500013M02606 ", " ssn ", "123-45-6789", " 987-65-4321 ", "social security", " é", " 😀 ", "x" * 30, "a@b.io", " my bank ", "1.2.3.4"]
    made = ["".join(rng.choice(cells) for _ in range(rng.randrange(12))) for _ in range(300)]
    made += [m.replace("XX82", x) for m in made[:40] for x in ("XX45", "XK51")]
    noise = made + ["".join(rng.choice(" .@+-()0123456789ab\n%é") for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = [(100 + i, t) for i, t in enumerate([*TEXTS, *noise])] + ODD
    got = run(spark, write(documents=docs))
    assert len(got) == len(docs)
    for i, t in docs:
        want = named(base_spans(t or ""))
        assert got[i].spans == named(sorted(base_spans(t or "") + added_spans(t or ""))), t
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, got[i].spans, want)
        assert got[i].n_email == want.count("email") and got[i].n_phone == want.count("phone") and got[i].n_ip == want.count("ip:") and got[i].n_card == want.count("card")


def test_checksums_and_context(spark, write):
    got = run(spark, write(documents=[(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "IBAN GB82 WEST 1234 5698 7654 33."), (3, "my ssn: 123-45-6789"), (4, "part 123-45-6789")]))
    assert "iban:5:32" in got[1].spans and "iban" not in got[2].spans and "ssn:8:19" in got[3].spans and got[4].spans == ""


def test_redact(spark, write):
    df = spark.read.parquet(write(documents=[(1, "a@b.c and 1.2.3.4!"), (2, None), (3, "😀 x@y.z"), (4, "clean")]) + "/documents.parquet")
    out = pii.redact(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "[EMAIL] and [IP]!", 2: None, 3: "😀 [EMAIL]", 4: "clean"}


def test_redaction_equals_brute_force_at_any_length(spark, write):
    rng = random.Random(9)
    cells = ["a@b.io", " 1.2.3.4", "😀é ", "4111 1111 1111 1111", "+1 (578) 555-6437", " ssn 123-45-6789", "\n", "plain words ", "x" * 700]
    docs = [(i, "".join(rng.choice(cells) for _ in range(rng.randrange(60)))) for i in range(60)] + [(100, " é ".join(f"u{i}@x.org" for i in range(20_000)))]
    out = pii.redact(spark.read.parquet(write(documents=docs) + "/documents.parquet"))
    got = {r.doc_id: (r.text, r.pii) for r in out.collect()}
    for i, t in docs:
        assert got[i] == (redacted(t, sorted(base_spans(t) + added_spans(t))), "x")


def test_shards_are_even_and_gapless(spark, write):
    rng = random.Random(3)
    docs = [(i, "copy" * 50 if rng.random() < 0.4 else "".join(rng.choice("ab ") for _ in range(rng.randrange(400)))) for i in range(3000)] + [(i, t) for i, t in ODD if t is None or len(t) < 100] + [(7, "same text as another one here")]
    rows = sharding.op7_sharding(spark, write(documents=docs)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(24)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    sizes, largest = [sum(r.size for r in own) for own in by.values()], max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    # A plain version places each row by the middle of its bytes on the line of (key, doc_id).
    line = 0
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min(23, (line + r.size // 2) * 24 // sum(sizes))
        line += r.size
    assert sharding.op7_sharding(spark, write(documents=[])).count() == 0
    one = sharding.op7_sharding(spark, write(documents=[(1, "x")])).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_rows_that_repeat_whole_are_split_too(spark, write):
    docs = [(7, "one row, many times")] * 900 + [(i, f"text {i}") for i in range(100, 900)]
    frame = spark.read.parquet(write(documents=docs) + "/documents.parquet")
    rows = sharding.assign_shards(frame.select("doc_id", "text", "_size", "shard", "lang"), keep_text=True).collect()
    assert len(rows) == len(docs) and len({(r.shard, r.slot) for r in rows}) == len(rows) and {r.lang for r in rows} == {"en"}
    by = {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + len(r.text.encode()) + 8
    assert max(by.values()) - min(by.values()) <= 2 * 27 and len({r.shard for r in rows if r.doc_id == 7}) > 5


def test_urls(spark, write):
    pages = [(1, "http://a.net/x?q", '<a href="http://good.example.org/fr/1">'), (2, "https://link.com/", "<a href=\"http://a.net/y\"><A HREF='//b.net/z'>"), (3, "HTTP://X.Example.NET/en/1?q#f", '<a href="https://friend.io/">'), (4, None, None), (5, "nope", ""), (6, "http://friend.io", "<a href=https://friend2.io>"), (7, "http://h.org#x/fr/", ""), (8, "http://x.org/fr/", ""), (9, "http://ÄB.example.com:80/de/", ""), (10, "http://notexample.com/de/", ""), (11, "http://a.net", "")]
    pages = [(*p, "clash", 1) for p in pages] + [(2, pages[1][1], pages[1][2], "clash", 1)]
    got = sorted(tuple(r) for r in url_filter.op4_url_filter(spark, write(pages=pages)).collect())
    want = [(1, "a.net", "/x", "net/", "block"), (2, "link.com", "/", None, "block"), (2, "link.com", "/", None, "block"), (3, "x.example.net", "/en/1", "example.net/en/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "friend.io", "", None, "allow"), (7, "h.org", "", None, "allow"), (8, "x.org", "/fr/", "org/fr/", "allow"), (9, "Äb.example.com:80", "/de/", None, "allow"), (10, "notexample.com", "/de/", None, "allow"), (11, "a.net", "", None, "block")]
    assert [g for g in got if g[0] != 11] == [w for w in want if w[0] != 11]
    assert url_filter.op4_url_filter(spark, write(pages=[])).count() == 0


def plain_ranks(names, edges, start):
    """Personalised PageRank, a host at a time; what comes to hosts without links goes back to the seeds."""
    out = {n: sum(w for (a, _), w in edges.items() if a == n) for n in names}
    score = dict(start)
    for _ in range(300):
        stuck = sum(s for n, s in score.items() if not out[n])
        new = {n: ((1 - url_filter.DAMPING) + url_filter.DAMPING * stuck) * start[n] for n in names}
        for (a, b), w in edges.items():
            new[b] += url_filter.DAMPING * score[a] * w / out[a]
        score = new
    return score


@pytest.mark.parametrize("hub", [100_000, 2])
def test_propagation_equals_plain_iteration(spark, monkeypatch, hub):
    monkeypatch.setattr(url_filter, "HUB", hub)
    rng = random.Random(1)
    names = [f"h{i}" for i in range(12)]
    edges = {(a, b): rng.randrange(1, 4) for a in names[:9] for b in names if a != b and rng.random() < 0.3}
    seeds = {n: (float(i == 0), float(i in (3, 4, 11))) for i, n in enumerate(names)}
    hosts = spark.createDataFrame([(n, *s) for n, s in seeds.items()], "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(hosts, spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")).collect()}
    for k, graph in ((0, edges), (1, {(b, a): n for (a, b), n in edges.items()})):
        mass = sum(s[k] for s in seeds.values())
        want = plain_ranks(names, graph, {n: s[k] / mass for n, s in seeds.items()})
        assert sum(abs(got[n][k] - want[n]) for n in names) < url_filter.TOLERANCE and sum(g[k] for g in got.values()) == pytest.approx(1)


def test_propagation_settles(spark):
    rng = np.random.default_rng(3)
    n = 14
    links = {(i, i + 1): 1 for i in range(n - 1)} | {(int(a), int(b)): 2 for a, b in rng.integers(0, n, (10, 2)) if a != b}
    hosts = spark.createDataFrame([(f"h{i}", float(i == 0), float(i == n - 1)) for i in range(n)], "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(hosts, spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in links.items()], "src string, dst string, n long")).collect()}
    flow = np.zeros((n, n))
    for (a, b), w in links.items():
        flow[b, a] = w
    for k, (m, seed) in enumerate(((flow, 0), (flow.T, n - 1))):
        m = m / np.maximum(m.sum(0), 1)
        m[seed, m.sum(0) == 0] = 1  # back to the seed
        settled = np.linalg.solve(np.eye(n) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * np.eye(n)[seed])
        assert sum(abs(got[f"h{i}"][k] - settled[i]) for i in range(n)) < url_filter.TOLERANCE


def web(seed, n=90, pages=400):
    """Pages of linked hosts, some under rules; a third of the pages are of one host."""
    rng = random.Random(seed)
    kinds = ["h{}.io", "h{}.org", "w{}.net", "h{}.example.com", "h{}.example.net"]
    hosts = [rng.choice(kinds[:1] * 6 + kinds).format(i) for i in range(n)]
    url = lambda h: rng.choice(["http://", "HTTPS://"]) + h + rng.choice(["/", "/de/1", "/en/2?x", "/fr/3#y", ""])
    tag = lambda u: rng.choice(['<a href="{}">', "<A class=x HREF='{}'>", "<a href={} >", '<a name=q href = "{}"/>']).format(u)
    group = {h: rng.sample(hosts, 4) for h in hosts}
    out = []
    for i in range(pages):
        h = hosts[0] if rng.random() < 0.33 else rng.choice(hosts)
        links = [tag(rng.choice([url(rng.choice(group[h])), "//" + rng.choice(group[h]) + "/de/", "/local"])) for _ in range(rng.randrange(4))]
        out.append((i, url(h), " ".join(links) + rng.choice(["", " // "]), None, None))
    return [*out, (1000, None, None, None, None), (1001, "no", tag("http://w1.net/"), None, None), (1002, "http://", "", None, None), out[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_that_links_decide_equal_sql(spark, write, seed, monkeypatch):
    import duckdb

    from palimpsest.llm import sql

    d = write(pages=web(seed))
    if seed == 3:
        monkeypatch.setattr(url_filter, "BROADCAST", 0)
        monkeypatch.setattr(url_filter, "HUB", 3)
    got = url_filter.op4_url_filter(spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    rows = lambda found: sorted(map(str, found))
    assert rows(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == rows(con.execute(sql.OP4).fetchall())
    assert got.where("rule is null and verdict = 'block'").count() and got.where("rule is null and verdict = 'allow'").count()


def test_a_chain_is_blocked_near_its_blocked_end_only(spark, write):
    chain = ["http://bad.net/", *(f"http://c{i}.io/" for i in range(1, 13))]
    pages = [(i, u, f'<a href="{chain[i - 1]}">' if i else "", None, None) for i, u in enumerate(chain)]
    got = {r.page_id: r.verdict for r in url_filter.op4_url_filter(spark, write(pages=pages)).collect()}
    assert [i for i in range(1, 13) if got[i] == "block"] == [1, 2]


@pytest.mark.parametrize("n", [1, 2, 100])
def test_all_of_a_link_farm_are_blocked(spark, write, n):
    farm = [(i, f"http://farm{i}.io/", '<a href="http://bad.net/">', None, None) for i in range(n)]
    other = [(1000, "http://bad.net/", "", None, None), (1001, "http://news.io/", '<a href="http://bad.net/">' + "".join(f'<a href="http://fine{i}.io/">' for i in range(9)), None, None)]
    got = {r.page_id: r.verdict for r in url_filter.op4_url_filter(spark, write(pages=farm + other)).collect()}
    assert [got[i] for i in range(n)] == ["block"] * n and got[1001] == "allow"


def test_blocked_pages_of_any_host_seed_distrust(spark, write):
    to_bad, to_fine = '<a href="http://www.example.com/de/2">', '<a href="http://www.example.com/fr/2">'
    pages = [(0, "http://www.example.com/de/1", ""), (1, "http://www.example.com/fr/1", ""), (2, "http://linker.io/", to_bad), (3, "http://reader.io/", to_fine), (4, "http://mixed.example.net/en/1", ""), (5, "http://mixed.example.net/de/1", ""), (6, "http://buyer.io/", '<a href="http://mixed.example.net/de/2">')]
    got = {r.page_id: r.verdict for r in url_filter.op4_url_filter(spark, write(pages=[(*p, None, None) for p in pages])).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block"}


def test_host_parsing_equals_a_regular_expression(spark):
    urls = ["a://b/c", "://x", "a://", "x://Y?://z", "x:/y", "http://u@H:1/p#q?r", "http://a#b", "http://a/b#c?d", "h://a\n/b"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.host_of(F.col("u")).alias("h")).collect()
    for u, r in zip(urls, got, strict=True):
        rest = u.split("://", 1)[1] if "://" in u else ""
        want = re.split(r"[/?#]", rest, maxsplit=1)[0]
        assert r.h == "".join(c.lower() if "A" <= c <= "Z" else c for c in want)
