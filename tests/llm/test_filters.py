"""Quality rules, decontamination, secrets, licences, URL lists and HTML extraction."""

import base64
import hashlib
import json
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import decontam, htmlextract, licenses, quality, queries, secrets, urlfilter

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def same_as_sql(spark, name, **tables):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same_as_sql(spark, name)


# --- quality rules -------------------------------------------------------------------------


def base(text):
    w = WORD.findall(text or "")
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_columns(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (docs, odd):
        texts = df.select("doc_id", "text").collect()
        got = sorted(str(tuple(r)[:7]) for r in quality.score(df).collect())
        want = [(r["doc_id"], *(b := base(r["text"])), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in texts]
        assert got == sorted(map(str, want))
    assert quality.score(none).count() == 0
    assert quality.score(odd.drop("lang")).count() == odd.count()


def test_quality_verdict_on_labels(spark):
    folder = SMALL.replace("0.001", "0.01")
    scored = quality.score(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed")
    good = scored.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = scored.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.995 and bad <= 0.01


def test_token_features_equal_tokenising_words(spark):
    import math

    import numpy as np
    import pyarrow as pa
    import sentencepiece

    path = f"{quality.TOKENIZERS}/{quality.VOCABULARY}"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat on the mat", "漢字 ก ### |", "", None]
    f = quality.features(pa.array(texts, pa.string()), quality.Fertility(path))
    for i, t in enumerate(texts):
        ids = [x for w in WORD.findall(t or "") for x in model.encode(w)]
        n = Counter(ids)
        assert f["n_tokens"][i] == len(ids) and f["n_byte_tokens"][i] == sum(model.is_byte(x) for x in ids)
        assert np.isclose(f["token_entropy"][i], -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()))


# --- decontamination ----------------------------------------------------------------------


def shingles(words):
    return Counter(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else Counter({tuple(words): 1})


def contaminated(docs, items):
    for d, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        for item, body in items:
            v = WORD.findall((body or "").translate(FOLD))
            want = shingles(v) if v else None
            for s in range(len(w) - len(v) + 1) if v else ():
                have = shingles(w[s : s + len(v)])
                if 5 * sum((have & want).values()) >= 4 * sum((have | want).values()):
                    yield d, item
                    break


def test_decontamination(spark, odd, none):
    items = [(0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"), (1, "three short words"), (2, ""), (3, None), (4, "a b a b a b a b a b a b")]
    item = items[0][1]
    docs = [(1, "intro " + item.upper() + " outro"), (2, item.replace("kappa", "KAPPA").replace("upsilon", "other")), (3, item.replace("delta", "x").replace("omicron", "y")), (4, item[:60]), (5, "some three SHORT words here"), (6, "b a b a b a b a b a b a b a"), (7, None), (8, item + " " + item), (9, " ".join(reversed(item.split())))]
    table = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(df, table).collect()}
    assert got == set(contaminated(docs, items)) and (1, 0) in got and (3, 0) not in got
    kept = {r["doc_id"] for r in decontam.clean(df, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontam.clean(odd, table).columns == odd.columns
    assert decontam.contamination(none, table).count() == 0 and decontam.contamination(df, table.filter("false")).count() == 0


def test_decontamination_in_blocks_of_items(spark):
    table = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    blocks = list(decontam.item_blocks(table, limit=2000))
    whole = next(decontam.item_blocks(table))
    assert len(blocks) > 1 and sum(len(b[0]) for x in blocks for b in x.by_size.values()) == sum(len(b[0]) for b in whole.by_size.values())


def test_multi_index_finds_all_that_agree_on_a_block():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << decontam.WIDTH, (40, decontam.BLOCKS))
    flips = rng.random((60, decontam.BLOCKS, decontam.WIDTH)) < rng.choice([0.02, 0.08, 0.2, 0.5], (60, 1, 1))
    probes = prints[rng.integers(0, 40, 60)] ^ (flips @ (1 << np.arange(decontam.WIDTH)))
    found = set(map(tuple, decontam.MultiIndex(prints).near(probes).tolist()))
    assert found == {(i, j) for i in range(60) for j in range(40) if (probes[i] == prints[j]).any()}
    differ = np.bitwise_count(probes[:, None] ^ prints[None]).sum(2)
    assert {(i, j) for i, j in zip(*np.nonzero(differ < decontam.BLOCKS), strict=True)} <= found


@pytest.mark.parametrize("m", [9, 16, 36, 55])
def test_multi_index_selects_few_and_recalls_pairs_at_the_threshold(m):
    import numpy as np

    rng = np.random.default_rng(m)
    fingerprint = lambda h: decontam.simhash(decontam._votes(h)[None])[0]
    sets = rng.integers(0, 2**63, (400, m)).astype(np.uint64)
    index = decontam.MultiIndex(np.stack([fingerprint(s) for s in sets]))
    # The fewest shared shingles that reach 0.8.
    common = -(-8 * m // 9)
    assert 5 * common >= 4 * (2 * m - common) and 5 * (common - 1) < 4 * (2 * m - common + 1)
    near = sets.copy()
    near[:, common:] = rng.integers(0, 2**63, (400, m - common)).astype(np.uint64)
    pairs = set(map(tuple, index.near(np.stack([fingerprint(s) for s in near])).tolist()))
    assert sum((i, i) in pairs for i in range(400)) >= 0.99 * 400
    assert len([p for p in pairs if p[0] != p[1]]) < 0.05 * 400 * 399


# --- secrets ----------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def pkcs1(n):
    """An RSA private key by its layout: version, modulus, exponent and six more numbers."""
    return der(0x30, der(0x02, b"\0"), der(0x02, bytes(i % 251 for i in range(1, n))), der(0x02, b"\1\0\1"), *[der(0x02, bytes([k])) for k in range(6)])


KEY = base64.b64encode(pkcs1(65)).decode()
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), json.dumps({"sub": "someone"}).encode(), b"0123456789abcdef"))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("password=abcdef", ["assign"]),
        ("PassWord : 'abcdef'", ["assign"]),
        ("password=abcde", []),
        ("secret: token: abcdefgh", []),
        ("api_key=" + "0" * 24, ["assign", "hex"]),
        ("AKIA" + "A" * 16, ["access"]),
        ("AKIA" + "A" * 15, []),
        ("é" * 3 + "f" * 24, ["hex"]),
        ("F" * 24, []),
        (f"x {TOKEN} y", ["jwt"]),
        (f"x {TOKEN[5:]} y", []),
        (f"-----BEGIN-----\n{KEY[:64]}\n{KEY[64:]}\n", ["der"]),
        (KEY[:-6] + "AAAAAA", []),
        # A public key is no secret.
        (base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(range(32))).decode(), []),
        (base64.b64decode(KEY).hex(), ["hex", "der"]),
        ("A" * 200, []),
        (None, []),
    ],
)
def test_secret_kinds(text, kinds):
    assert [k for _, _, k in secrets.find(text)] == kinds


def test_secret_scan(spark, odd, none):
    rows = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame([(1, f"ü password=abcdefg {'a1' * 12}"), (2, None)], "doc_id long, text string")).collect()}
    listed = "assign:2:18,hex:19:43"
    assert rows[1]["spans"] == listed and rows[1]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert secrets.redacted("a password=abcdefg b") == "a [SECRET] b"


# --- licences -----------------------------------------------------------------------------------


def test_licences(spark, odd, none):
    known = licenses.digests(spark)
    mit = licenses.LICENCES["MIT"]
    variants = [mit, mit.upper(), "Copyright (c) 2021 Someone\n" + mit.replace("\n", "\n\n   "), mit.replace('"', "'").replace("sublicense", "sub-licence"), mit + " extra", "", None, "Copyright 2020 X"]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, known).collect()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None}
    assert licenses.scan(odd, known).count() == odd.count() and licenses.scan(none, known).count() == 0
    assert known.count() == len(licenses.LICENCES)


# --- URL lists -----------------------------------------------------------------------------------


def test_url_lists(spark):
    day = lambda s: None if s is None else s
    entries = spark.createDataFrame(
        [("domain", "Bad.com", "spam", True, "2024-01-10"), ("domain", "bad.com", "spam", False, "2024-02-10"), ("domain", "bad.com", "spam", True, "2024-03-10"), ("domain", "bad.com", "adult", True, "2024-01-20"), ("domain", "tie.com", "x", True, "2024-01-01"), ("domain", "tie.com", "x", False, "2024-01-01"), ("url", "ok.com/p", "phish", True, "2024-01-01"), ("domain", None, "n", True, "2024-01-01")],
        "scope string, pattern string, category string, active boolean, since string",
    ).withColumn("since", F.to_date("since"))
    captures = [("http://bad.com/", "2024-01-09"), ("http://a.b.BAD.com:8080/", "2024-01-10"), ("http://bad.com", "2024-01-20"), ("https://u@bad.com./", "2024-02-10"), ("http://bad.com", "2024-03-10"), ("http://notbad.com", "2024-03-10"), ("http://tie.com", "2024-05-01"), ("http://ok.com/p/?q#f", "2024-05-01"), ("http://ok.com/q", "2024-05-01"), (None, "2024-05-01"), ("http://bad.com", None), ("garbage", "2024-05-01")]
    df = spark.createDataFrame([(i, u, day(d), "x") for i, (u, d) in enumerate(captures)], "page_id long, url string, fetched string, host string").withColumn("fetched", F.to_date("fetched"))
    got = {r["page_id"]: r["categories"] for r in urlfilter.evaluate(df, entries).collect()}
    assert [got[i] for i in range(len(captures))] == ["", "spam", "adult,spam", "adult", "adult,spam", "", "", "phish", "", "", "", ""]
    assert urlfilter.evaluate(df.filter("false"), entries).count() == 0
    assert urlfilter.evaluate(df, entries.filter("false")).filter("blocked").count() == 0


def test_a_list_of_many_hosts_and_from_a_file(spark, tmp_path, monkeypatch):
    """The rule's list blocks for a time, not for good; a list over the broadcast bound and one from a file give the same."""
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet")
    captures, entries = urlfilter.captures_of(pages), urlfilter.listed(pages)
    want = sorted(map(str, urlfilter.evaluate(captures, entries).collect()))
    ever = entries.filter("scope = 'domain'").select("pattern").distinct()
    hit = urlfilter.evaluate(captures, entries).join(ever, F.col("host") == F.col("pattern"))
    assert 0 < hit.filter("blocked").count() < hit.count()
    entries.coalesce(1).write.csv(f"{tmp_path}/list.csv", header=True)
    assert sorted(map(str, urlfilter.evaluate(captures, urlfilter.read_entries(spark, f"{tmp_path}/list.csv")).collect())) == want
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert sorted(map(str, urlfilter.evaluate(captures, entries).collect())) == want


# --- HTML --------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">We use cookies for a great many purposes indeed</div><div id="wrap"><div class="{cls}"><h1>Title &amp; more</h1><p>First   para with <a href="x">link</a> and
 newline.<p>Second &lt;para&gt; &#8212; end.<script>var a="</p>";</script><div class="ad-box">Buy</div><ul><li>one<li>two</ul><form>Mail <input></form></div>
<div class="sidebar">Recent posts</div><section id="comments"><div class="comment"><p>{comment}</p></div></section></div><footer>&copy; 2024</footer></body>"""
TEXT = "Title & more\nFirst para with link and newline.\nSecond <para> — end.\none\ntwo"


def test_html(spark):
    pages = [(1, "http://h.com/1", PAGE.format(cls="post-content post-12", comment="I disagree " * 40)), (2, "http://h.com/2", PAGE.format(cls="post-content post-99", comment="no")), (3, None, PAGE.format(cls="entry", comment="x")), (4, "http://x.com", None), (5, "http://x.com", ""), (6, "http://y.com", "plain text &eacute; only"), (7, "http://y.com", "<p>a<p>b<br>c"), (8, "http://z.com", "<script>x"), (1, "http://h.com/1", "<article>dup</article>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = htmlextract.extract(df).collect()
    by = {(r["page_id"], r["text"]) for r in got}
    assert by == {(1, TEXT), (2, TEXT), (3, TEXT), (4, ""), (5, ""), (6, "plain text é only"), (7, "a\nb c"), (8, ""), (1, "dup")}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(pages)
    assert htmlextract.extract(df.filter("false")).count() == 0


def test_html_of_the_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmlextract.extract(pages).collect()}
    from html import unescape

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", body))).split("\n")
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def test_consensus_path_of_a_host(spark):
    good = "<body><div class='story s{i}'><p>{t}</p></div><div class='extra'><p>{u}</p></div></body>"
    long, short = "words and more words " * 20, "few words"
    rows = [(i, "http://h.com", good.format(i=i, t=long, u=short)) for i in range(5)] + [(9, "http://h.com", good.format(i=9, t=short, u=long))]
    got = {r["page_id"]: r["text"] for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == long.strip() and got[9] == short


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="has-sidebar"><header><h1>Site</h1></header><article class="post no-sidebar"><header class="entry-header"><h1>T</h1></header><div><p>Body text here long enough.</p><aside>pull</aside></div><div class="share-buttons">Share</div><footer>by X</footer></article><div class="sidebar">bla bla bla</div></body>', "T\nBody text here long enough."),
        ('<div id="page"><div id="header">Site name</div><div class="main-nav"><a href=x>a</a></div><table><tr><td class="left">menu <a>x</a></td><td class="story"><h2>T</h2><p>Some text of the story.</p><p>More.</p></td></tr></table><div id="disqus_thread">c c c</div><div class="notice">n</div></div>', "T\nSome text of the story.\nMore."),
        ("<article><p>One.</p><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table></article>", "One.\na b\nc d"),
        ("<article><p>5 < 6 &lt; 7<!-- x --></p><p hidden>no</p><div style='display: none'>no</div><blockquote>Q&nbsp;A</blockquote></article>", "5 < 6 < 7\nQ A"),
    ],
)
def test_layouts(page, text):
    found = htmlextract.votes(htmlextract.parse(page))
    assert htmlextract.text_of(htmlextract.parse(page), max(found, key=found.get)) == text
