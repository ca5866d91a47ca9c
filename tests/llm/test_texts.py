"""Decontamination, quality, extraction: a text or page at a time."""

import html
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination as dec
from palimpsest.llm import quality, wrapper

from .brute import edits
from .brute import quality as plain_quality
from .conftest import ODD


def test_leaks_equal_edit_distance():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(20)] + [(90, "tiny"), (91, ""), (92, None)]
    index = dec.Index([(i, t) for i, t in items if t])
    by = {i: dec.normal(t) for i, t in items if t}
    for _ in range(120):
        i = rng.randrange(20)
        y = list(by[i])
        for _ in range(rng.randrange(dec.edit_budget(len(y)) + 3)):
            p = rng.randrange(len(y))
            y[p : p + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        text = " ".join(word() for _ in range(rng.randrange(20))) + " " + "".join(y).upper().replace(" ", " \n") + " " + " ".join(word() for _ in range(rng.randrange(20)))
        found = {k: e for k, _, e in dec.leaks_in([text], index)[0]}
        best = edits(by[i], dec.normal(text))
        assert found.get(i) == (best if best <= dec.edit_budget(len(by[i])) else None)
    assert [x[0] for x in dec.leaks_in(["something TINY here", "", "ti ny"], index)[0]] == [90]


def test_leaks_in_spark(spark, write):
    item = "the quick brown fox jumps over the lazy dog and then goes home to sleep for a while"
    docs = [(10, f"before {item.upper()} after"), (11, "clean words only"), *ODD, (10, f"before {item.upper()} after")]
    d = write(documents=docs, benchmark=[(1, item), (2, item), (3, None), (4, "")])
    got = dec.op1_decontamination(spark, d).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(10, 1, 0), (10, 1, 0), (10, 2, 0), (10, 2, 0)] and not any(r.kept for r in got)
    assert dec.op1_decontamination(spark, write(documents=docs, benchmark=[])).count() == 0
    assert dec.op1_decontamination(spark, write(documents=[], benchmark=[(1, item)])).count() == 0
    # Several blocks of the benchmark find what one block finds.
    df, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    assert len(list(dec.benchmark_blocks(bench, 10))) == 2
    found = dec.find_leaks(df, bench)
    assert set(found.columns) == set(df.columns) and found.count() == len(docs)
    rows = lambda x: sorted((r.doc_id is None, r.doc_id, r.text or "", r.kept, [tuple(y) for y in r.leaks or []]) for r in x.collect())
    assert rows(dec.find_leaks(df, bench, block=10)) == rows(found)


def test_quality_equals_brute_force(spark, write):
    rng = random.Random(4)
    docs = [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "a b c d e f g h\n", "\u2028"]) for _ in range(rng.randrange(60)))) for i in range(120)] + ODD
    got = {r.doc_id: r for r in quality.op2_quality(spark, write(documents=docs)).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), t
        assert not (r.base_failed and r.kept)
    assert quality.op2_quality(spark, write(documents=[])).count() == 0


def test_fertility_separates_symbols_from_prose():
    import pyarrow.dataset as ds

    docs = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()
    names = [f.split()[0] for f in quality.FIELDS.split(", ")]
    cols = quality.measure_texts([d["text"].encode() for d in docs], [d["lang"] for d in docs], quality.Fertility())
    rows = [dict(zip(names, r, strict=True)) for r in zip(*[c.to_pylist() for c in cols], strict=True)]
    for d, r in zip(docs, rows, strict=True):
        if r["base_failed"]:
            continue
        symbols = r["n_symbols"] > r["n_words"]
        assert not (symbols and r["kept"])
    clean = [r["kept"] for r in rows if not r["base_failed"] and r["n_symbols"] * 20 < r["n_words"]]
    assert sum(clean) >= 0.98 * len(clean)


def test_measures_and_verdicts_equal_brute_force():
    import math
    from collections import Counter

    import pyarrow.dataset as ds
    import public_tokenizers
    import sentencepiece

    docs = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()[:120]
    docs += [{"text": "привет мир это текст о том как идут дела в большом городе и что люди делают каждый день утром и вечером", "lang": "ru"}, {"text": "\U0001f600 " * 25, "lang": None}, {"text": "", "lang": "en"}]
    names = [f.split()[0] for f in quality.FIELDS.split(", ")]
    cols = quality.measure_texts([d["text"].encode() for d in docs], [d["lang"] for d in docs], quality.Fertility())
    encode, pieces = quality.vocabulary().encode_ordinary, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, r in zip(docs, (dict(zip(names, x, strict=True)) for x in zip(*[c.to_pylist() for c in cols], strict=True)), strict=True):
        words = d["text"].split()
        tokens = [i for w in words for i in encode(" " + w)]
        bare = [pieces.is_byte(i) for w in words for i in pieces.encode(w)]
        if not words:
            assert r["chars_per_token"] is None and not r["kept"]
            continue
        k = max(1, round(len(tokens) / quality.SPAN))
        windows = [[t for j, t in enumerate(tokens) if j * k // len(tokens) == w] for w in range(k)]
        shares = [(len(w), -sum(c / len(w) * math.log(c / len(w)) for c in Counter(w).values()) / math.log(len(w))) for w in windows if len(w) > 1]
        entropy = sum(n * x for n, x in shares) / len(tokens) if len(tokens) > 1 else 1.0
        assert r["chars_per_token"] == pytest.approx(sum(map(len, words)) / len(tokens)) and r["fallback_share"] == pytest.approx(sum(bare) / len(bare)) and r["token_entropy"] == pytest.approx(entropy)
        low, high, most, least = quality.band_of(d["lang"], d["text"].encode())
        assert r["kept"] == (not r["base_failed"] and low <= r["chars_per_token"] <= high and r["fallback_share"] <= most and entropy >= least)


def test_labelled_clean_documents_are_kept():
    import pyarrow.dataset as ds

    at = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in ds.dataset(f"{at}/labels.parquet").to_table().to_pylist() if r["quality"] == 1}
    docs = [r for r in ds.dataset(f"{at}/documents.parquet").to_table().to_pylist() if r["doc_id"] in good]
    made = dict(zip([f.split()[0] for f in quality.FIELDS.split(", ")], (c.to_pylist() for c in quality.measure_texts([d["text"].encode() for d in docs], [d["lang"] for d in docs], quality.Fertility())), strict=True))
    assert len(docs) > 100 and all(k or f for k, f in zip(made["kept"], made["base_failed"], strict=True))


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_length_alone_rejects_no_clean_text(n):
    import pyarrow.dataset as ds

    rng = random.Random(8)
    docs = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()
    names = [f.split()[0] for f in quality.FIELDS.split(", ")]
    fertility = quality.Fertility()
    for lang in ("en", "de", "fr", "es"):
        own = [d["text"] for d in docs if d["lang"] == lang]
        cols = quality.measure_texts([t.encode() for t in own], [lang] * len(own), fertility)
        words = [w for t, k in zip(own, cols[-1].to_pylist(), strict=True) if k for w in t.split()]
        dull = rng.sample(sorted(set(words)), 12)
        texts = [" ".join(rng.choice(source) for _ in range(n)).encode() for source in (words, dull)]
        made = dict(zip(names, (c.to_pylist() for c in quality.measure_texts(texts, [lang] * 2, fertility)), strict=True))
        assert made["base_failed"] == [False, False] and made["kept"] == [True, False], (lang, made)


def test_repeats_survive_a_hash_that_fails(monkeypatch):
    rng = np.random.default_rng(2)
    ids, starts = np.concatenate([[0, 1, 2, 3, 4, 5, 6, 7] * 3 + [9] * 7, rng.integers(0, 2, 300)]), np.array([0, 31, 331])
    want = quality.repeated(ids, starts)
    assert want[:31].sum() == 24
    # All windows get one hash: the words decide.
    monkeypatch.setattr(quality, "MIXERS", (0, 0))
    assert (quality.repeated(ids, starts) == want).all()


PAGE = '<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li><li><a href="/{t}">{t}</a></li></ul></nav><div class="ad">Buy {t}</div><article><h1>{t}</h1>{body}<section id="comments"><p>nice</p></section></article><aside>more</aside><form><p>mail</p></form><footer>&copy; {t}</footer></body></html>'


def test_extraction(spark, write):
    rng = random.Random(6)
    texts = {}
    pages = []
    for i in range(40):
        blocks = ["".join(rng.choice("abc &<é") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        body = "".join(f"<p>{html.escape(b)}" + rng.choice(["</p>", "", "\n</p>"]) for b in blocks)
        texts[i] = "\n".join(x for x in (" ".join(y.split()) for y in [f"t{i}", *blocks]) if x)
        pages.append((i, f"http://h{i % 3}.org/{i}", PAGE.format(t=f"t{i}", body=body), "clash", 5))
    odd = [(100, None, None), (101, "http://h0.org", ""), (102, "http://h0.org", "<p>open <b>and cut <a hre"), (103, "x", "<div>" * 3000 + "deep" + "</div>" * 3000), (104, "http://z.org", "plain &amp text &#x41; &unknown;"), (105, "http://z.org/2", "<p>" + "long " * 40_000), (105, "http://z.org/2", "<p>" + "long " * 40_000)]
    pages += [(*p, None, None) for p in odd]
    got = wrapper.op9_wrapper(spark, write(pages=pages)).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i, t in texts.items():
        assert by[i] == t
    assert (by[100], by[101], by[103], by[104]) == ("", "", "deep", "plain & text A &unknown;") and by[105] == ("long " * 40_000).strip() and by[102].startswith("open and cut")
    assert wrapper.op9_wrapper(spark, write(pages=[])).count() == 0


def induced(pages):
    whole = wrapper.page_tree(pages[0])
    for p in pages[1:]:
        whole = wrapper.merge(whole, wrapper.page_tree(p))
    return whole


def taken(page, whole):
    return wrapper.text_of(wrapper.parse(page), whole and wrapper.marks_of(wrapper.plan_of(whole)))


def test_constant_slots_are_template():
    page = lambda i: f"<body><div class=top>Welcome to the site</div><div class=x><p>text {i}</p></div></body>"
    whole = induced([page(i) for i in range(10)])
    assert whole[1] == 10 and taken(page(3), whole) == "text 3"


@pytest.mark.parametrize("n", [4, 8, 40])
def test_constant_text_is_on_nearly_all_pages_of_its_node(n):
    notice = "All rights are reserved by the owner of this site. " * 6
    page = lambda i, stray="": f"<body><div class=post>{stray}<p>text {i}</p></div><div class=legal>{notice}</div></body>"
    whole = induced([page(i, "A stray sentence." * (not i)) for i in range(n)])
    assert taken(page(0, "A stray sentence."), whole) == "A stray sentence.\ntext 0"
    assert taken(page(3), whole) == "text 3"


def test_copies_of_a_page_prove_nothing():
    page = "<body><div><p>the same text</p></div></body>"
    assert taken(page, induced([page] * 50)) == "the same text"


def test_the_wrapper_decides_where_no_tag_or_name_tells(spark, write):
    """A plain version knows what each page was made of; without the wrapper menus and notices stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    links = lambda: "".join(f'<li><a href="/{i}">{word()} {word()}</a></li>' for i in range(rng.randrange(3, 6)))
    pages, want = [], {}
    for i in range(60):
        host, paragraphs = f"h{i % 2}.org", [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 6))]
        share = f"<p class=q>Pass this on to a friend of {host}</p>"
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        holder = f"<article>{body}{share}</article>" if i % 2 else f"<div class=z><div>{body}</div>{share}</div>"
        pages.append((i, f"http://{host}/{i}", f"<html><body><div class=u><ul>{links()}</ul></div>{holder}<div class=v>Written at {host}. {'Long words. ' * 40}</div></body></html>", None, None))
        want[i] = "\n".join(paragraphs)
    got = {r.page_id: r.text for r in wrapper.op9_wrapper(spark, write(pages=pages)).collect()}
    assert got == want
    assert all(wrapper.text_of(wrapper.parse(p[2]), None) != want[p[0]] for p in pages)


def test_wrappers_do_not_depend_on_how_trees_are_merged(spark, write, monkeypatch):
    pages = [(i, "http://a.org/", f"<body><div class=c>Same</div><p>{i}</p>{'<table><tr><td>' + str(i) + '</table>' if i % 3 else ''}</body>", None, None) for i in range(40)]
    d = write(pages=pages)
    frame = spark.read.parquet(f"{d}/pages.parquet").repartition(20).select(F.lit("a.org").alias("_host"), "html")
    whole = wrapper.induce(frame).first()["wrapper"]
    monkeypatch.setattr(wrapper, "FAN", 3)
    parts = wrapper.induce(frame).collect()
    assert len(parts) == 1 and wrapper.plan_of(json.loads(parts[0]["wrapper"])) == wrapper.plan_of(json.loads(whole))
    assert wrapper.shape(json.loads(whole)) == wrapper.shape(json.loads(parts[0]["wrapper"]))


def test_tree_matching_counts_common_nodes():
    a, b = (wrapper.small_tree(wrapper.parse(x)) for x in ("<div><h1>x</h1><p>a</p><ul><li>1</li></ul></div>", "<div><p>b</p><table></table><ul><li>2</li></ul></div>"))
    assert wrapper.match(a, b) == 5  # root, div, p, ul, li
    both = wrapper.merge(a, b)
    assert [k[0] for k in both[3][0][3]] == ["h1", "p", "table", "ul"]


@pytest.mark.parametrize("lang,kept", [("en", False), ("xx", True), (None, True)])
def test_bands_go_by_language_then_script(lang, kept):
    text = ("ab|cd| " * 5 + " ".join(f"w{i}x" for i in range(30))).encode()
    band = quality.band_of(lang, text)
    assert (band == quality.BANDS["en"]) == (lang == "en") and (band == quality.LATIN) == kept
