"""Tokens, packing, pieces, languages and pages."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelog.llm import _words, html_text, language_id, packing, piece_codec
from tidelog.llm._base import read

ODD_TEXTS = ["it's THE ΣΣ İstanbul é don't...x'S 12 <|endoftext|> a\x1cb 日本 ñÑ z ''s", "", " ", "ǅ İ ß ẞ ﬁ K Å", "a  b\n c \t d  ", "  x", "a▁b ▁▁", "x" * 3000, "\x00 \x01", "<s> </s> <0x41>", "\ufeffabc é", "😀👍🏽 \u200d", "e\u0301 \u00a0 ."]


def texts(spark):
    return [r["text"] for r in read(spark, SF, "documents").collect()] + ODD_TEXTS


def test_word_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = packing.word_bpe_path()
    own, lib = _words.WordEncoder(path), Tokenizer.from_file(path)
    for t in texts(spark):
        assert own.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_cache_forgets_and_stays_right():
    c = _words._Cache(lambda k: k.encode())
    old, _words.GENERATION = _words.GENERATION, 3
    try:
        assert [c[k] for k in "abcabcdefgabc"] == [k.encode() for k in "abcabcdefgabc"] and len(c) <= 3
    finally:
        _words.GENERATION = old


@pytest.mark.parametrize(("n", "capacity"), [(n, c) for n in (1, 15, 16, 17, 31, 2047, 2048, 2049, 5000) for c in (2048, 1000, 7)])
def test_cuts(n, capacity):
    c = packing.cuts(n, capacity)
    assert sum(c) == n and all(0 < x <= capacity for x in c)
    assert len(c) <= n // capacity + 4  # whole sequences and a few pieces of what remains


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = read(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "word " * 9000), (None, "a b")], "doc_id long, text string"))
    got = packing.pack_documents(rows).toPandas()
    lib = Tokenizer.from_file(packing.word_bpe_path())
    want = {(-1 if r["doc_id"] is None else r["doc_id"]): [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    for doc, pieces in got.fillna({"doc_id": -1}).sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(pieces.ids), "<u4").tolist() == want[doc] and set(pieces.doc_tokens) == {len(want[doc])}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    pad = packing.padding(packing.pack_documents(rows)).first()
    assert pad["tokens"] == sum(map(len, want.values())) and pad["padding"] < 0.02 * pad["tokens"] + 2048
    assert len(got) < 4 * len(want)
    odd = packing.pack_documents(rows, capacity=1000).toPandas()
    for _, s in odd.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1000
    assert packing.pack_documents(rows.limit(0)).isEmpty()


def test_piece_ids_are_the_librarys_and_come_back(spark):
    import sentencepiece

    path = piece_codec.piece_path()
    own, lib = piece_codec.PieceCodec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    some = texts(spark)
    for t, ids in zip(some, own.encode(some), strict=True):
        assert ids == np.array(lib.encode(t), dtype="<u4").tobytes()
        assert own.decode(ids).decode() == t.replace("▁", " ")


def test_words_are_cut_where_no_piece_spans():
    """Any mixture of letters, digits, signs, line ends and runs of spaces has the library's ids; the words are the whole text."""
    import random

    import sentencepiece

    path = piece_codec.piece_path()
    own, lib = piece_codec.PieceCodec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = ["the", "ing", "É", "ñ", "ß", "a", "\n", "\t", "  ", " ", "7", "2024", "...", "!", "'s", "(", "*)", "日", "é.", "|", "%%"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for t, ids in zip(some, own.encode(some), strict=True):
        assert "".join(own.cut(t)) == t and ids == np.array(lib.encode(t), dtype="<u4").tobytes()
    assert piece_codec.marked_words(["▁ab", "bc", "x", "!?", "▁▁"]).findall("  abcx!?\n1a ") == ["  abc", "x", "!?", "\n", "1", "a", " "]


def test_both_ways_of_merging_and_forgetting(monkeypatch):
    """Short and long words merge alike, and what was forgotten is learnt again."""
    import random

    rng = random.Random(5)
    c = piece_codec.PieceCodec.load(piece_codec.piece_path())
    words = ["▁" + "".join(rng.choice("theinrsaou") for _ in range(rng.randint(1, 39))) for _ in range(300)]
    assert all(c.merged(w) == c._merged_long(w) for w in words)
    want = c.encode(words)
    monkeypatch.setattr(piece_codec, "MAX_UNITS", 5)
    monkeypatch.setattr(piece_codec, "MAX_FITS", 5)
    few = piece_codec.PieceCodec.load(piece_codec.piece_path())
    assert [x for k in (0, 100, 50, 200) for x in few.encode(words[k : k + 100])] == [x for k in (0, 100, 50, 200) for x in want[k : k + 100]]


def test_unigram_states_are_viterbi():
    import random

    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(14)} | {"a", "b", "▁"})
    scores = [-rng.random() * 5 - 0.1 for _ in pieces]
    ids = list(range(len(pieces), len(pieces) + 256))
    c = piece_codec.PieceCodec([*pieces, *[f"<{i}>" for i in range(256)]], [*scores, *[0.0] * 256], ids, "unigram", frozenset(ids))
    score = dict(zip(pieces, scores, strict=True))

    def best(word):
        states = [(0.0, [])]
        for i in range(1, len(word) + 1):
            states.append(max((states[j][0] + score[word[j:i]], [*states[j][1], word[j:i]]) for j in range(i) if word[j:i] in score))
        return states[-1][0]

    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(60)})
    for word, found in c._walk(words):
        assert "".join(found) == word and abs(sum(score[p] for p in found) - best(word)) < 1e-9


def test_codec_tables(spark):
    rows = spark.createDataFrame([(1, "Some text,  here\n"), (2, None), (3, ""), (None, "é😀"), (1, "again")], "doc_id long, text string")
    back = piece_codec.decode_documents(piece_codec.encode_documents(rows))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in rows.collect())
    d = {r["doc_id"]: r for r in piece_codec.round_trip(rows.filter("doc_id > 1 OR doc_id IS NULL")).collect()}
    assert d[2]["n_pieces"] == 0 and d[None]["decoded_sha256"] == hashlib.sha256("é😀".encode()).hexdigest() and d[2]["ids_crc32"] == zlib.crc32(b"")
    assert piece_codec.round_trip(rows.limit(0)).isEmpty()


def test_held_out_accuracy(spark):
    from tests.conftest import SF_LARGER

    rows = language_id.op9_language_id(spark, SF_LARGER).join(read(spark, SF_LARGER, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out")
    n = held.count()
    assert n > 100 and held.filter("lang = lang_pred").count() >= 0.98 * n
    assert rows.filter("held_out <> (crc32(CAST(doc_id AS STRING)) % 4 = 2)").isEmpty()
    assert rows.filter("score < 0 OR score > 1").isEmpty()


def test_language_edge_cases(spark):
    base = read(spark, SF, "documents")
    m = language_id.fit(base)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "x"), (None, "²½"), (5, "The of and the " * 9000), (5, "の")], "doc_id long, text string")
    got = {(r["doc_id"], r["lang_pred"] == "und", r["rejected"]) for r in language_id.predict(odd, m).select("doc_id", "lang_pred", "rejected").collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (None, True, True)} <= got and (5, False, False) in got and not any(u for d, u, _ in got if d in (4, 5))
    nothing = language_id.fit(base.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    kept = language_id.accepted(base, m)
    assert kept.columns == base.columns and kept.count() == base.filter("length(text) > 0").count()  # clean documents all stay
    assert language_id.predict(odd.limit(0), m).isEmpty()


def test_long_noise_is_rejected_and_short_text_stays(spark):
    import base64
    import random

    from tests.conftest import SF_LARGER

    base = read(spark, SF_LARGER, "documents").filter("length(text) > 0")
    m = language_id.fit(language_id.training(base))
    rng = random.Random(5)
    scripts = ["abcdefghijklmnopqrstuvwxyz     ", "".join(map(chr, range(0x430, 0x450))) + "    ", "".join(map(chr, range(0x4E00, 0x9FFF)))]
    noise = [("".join(rng.choices(x, k=n))) for x in scripts for n in (1000, 5000, 20000)] + [base64.b64encode(rng.randbytes(n)).decode() for n in (1000, 5000, 20000)]
    rows = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    assert [r["doc_id"] for r in language_id.predict(rows, m).filter("NOT rejected").collect()] == []
    assert language_id.accepted(base, m).count() == base.count()
    short = base.limit(50).select("doc_id", F.substring("text", 1, 60).alias("text"))
    assert language_id.accepted(short, m).count() == short.count()


def test_prediction_is_that_of_the_nearest_centroid(spark):
    """Against plain sums over grams: weights, cosines and the choice of the best."""
    from math import log, log1p, sqrt

    base = read(spark, SF, "documents")
    m = language_id.fit(language_id.training(base))
    rows = [r["text"] for r in base.select("text").limit(12).collect()] + ["Ein kurzer Satz."]
    langs, scores, _ = m.predict([t.encode() for t in rows])
    for t, lang, score in zip(rows, langs, scores, strict=True):
        counts = language_id.ngram_counts([t.encode()])[0].tolist()
        v = [log1p(c) * float(i) for c, i in zip(counts, m.idf, strict=True)]
        norm = sqrt(sum(x * x for x in v)) or 1.0
        near = [(sum(x / norm * float(y) for x, y in zip(v, c, strict=True) if x), name) for name, c in zip(m.languages, m.centroids, strict=True)]
        assert abs(max(near)[0] - score) < 1e-4 and lang in {name for x, name in near if x > max(near)[0] - 1e-4} or lang == "und"
    train = [r["text"].encode() for r in language_id.training(base).filter("lang IS NOT NULL AND text IS NOT NULL").collect()]  # fewer than the sample may have of a language
    having = sum((language_id.ngram_counts([t])[0] > 0).astype(int) for t in train)
    assert np.allclose(m.idf, [log((1 + len(train)) / (1 + h)) + 1 for h in having], atol=1e-5)


def test_many_languages_and_a_fit_that_depends_on_rows_alone(spark):
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(7, f"{n}{chr(0x4E00 + i)} word{chr(0x4E00 + 7 * i)} end", n) for i, n in enumerate(names) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(df, per_language=2)
    assert sorted(set(m.languages)) == names
    again = language_id.fit(df.repartition(5), per_language=2)
    assert np.array_equal(m.centroids, again.centroids) and np.array_equal(m.idf, again.idf) and m.languages == again.languages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies, ok, fine, yes, accept all of them.</p></div>
<header><h2>Site</h2></header><div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class=content><h1>T &amp; x</h1>
<p>Some text, with a <a href=q>link</a> here, and more.<p>Second<br>para &nbsp; x<blockquote>quoted, well</blockquote><ul><li>item a<li>item b</ul>
<form><p>Sign, up, now, please, dear</p></form></div><div class="sidebar"><p>Other, things, here, are, many, commas</p></div>
<section id="comments"><p>Nice, one, mate, really, good, read</p></section><script>var a="</div>"</script><footer>x</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "T & x\n\nSome text, with a link here, and more.\n\nSecond para x\n\nquoted, well\n\nitem a\n\nitem b"


P = "Some real words, in a sentence, that go on and on for a while. " * 4
REFERENCES = "<ul>" + "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(6)) + "</ul>"


def test_last_pieces_share_sequences():
    import pyarrow as pa

    some = [700, 700, 5, 1300, 648, 648, 100, 2048, 3]
    t = packing._fit(2048)(pa.table({"length": some, "doc_id": [None, *range(8)], "start": [0] * 9})).to_pylist()
    assert [r["length"] for r in t] == some and {r["at"] for r in t} == set(range(4))
    for k in range(4):
        own = sorted((r["offset"], r["length"]) for r in t if r["at"] == k)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


@pytest.mark.parametrize("wrap", ['<div class="layout sidebar-right">', '<div class="entry has-comments">', '<div class="main-menu">'])
def test_containers_of_the_best_one_stay(wrap):
    body = f'<div class=lead><p>A short lead.</p></div><div class=text><p>{P}</p><p>{P}</p><div class="share-of-market"><p>A third, of it.</p></div></div><div><p>The end.</p></div>'
    got = html_text.main_text(f'<body>{wrap}<div>{body}</div><div class="related-posts"><p>Other, things, to, read, now.</p></div></div><div class="site-footer"><p>Us, and, you.</p></div></body>')
    assert got.split("\n\n") == ["A short lead.", P.strip(), P.strip(), "A third, of it.", "The end."]


def test_tables_of_links_in_the_text_stay():
    got = html_text.main_text("<main><div><p>a b c</p><table><tr><td><a>Link cell</a></td><td><a>Another</a></td></tr></table></div></main>")
    assert got == "a b c\n\nLink cell\n\nAnother"


def test_pages_without_article_tags(spark):
    """Whatever element holds the article of a page, its text is the same."""
    rows = read(spark, SF, "pages").select("html").collect()
    for r in rows[:60]:
        for tag in ("div class=content", "section", 'div class="with-sidebar story"'):
            assert html_text.main_text(r["html"].replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")) == html_text.main_text(r["html"])


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "<p>x, y", "<i>" * 40_000 + "</b>" * 40_000 + "x, y", "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000 + "x, y", "<div>" + "<b>" * 40_000 + "<div></div>" * 40_000 + "x, y", "<li>" * 40_000 + "x, y"])
def test_deep_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    assert html_text.main_text(page) == "x, y"
    assert time.process_time() - began < 20


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">', '<div class="no-comments">', '<div id="search-results-article">', '<div class="social">'])
def test_wrappers_of_the_text_stay(wrap):
    comments = f'<div class="comments"><p>{"Nice one, mate. " * 90}</p></div>'
    for body in (f"<article><p>{P}</p></article>", f"<div><p>{P}</p></div>"):
        assert html_text.main_text(f"<body>{wrap}{body}{comments}</div></body>") == P.strip()
        assert html_text.main_text(f"<body>{body}{comments}</body>") == P.strip()


def test_link_lists_of_the_article_stay():
    got = html_text.main_text(f'<body><article><p>{P}</p>{REFERENCES}<nav>{REFERENCES}</nav><div class="related">{REFERENCES}</div></article></body>')
    assert got.count("Reference number") == 6 and got.startswith(P.strip())


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("plain <b>text</b> 1 < 2 &amp; 3", "plain text 1 < 2 & 3"), ("<p>open <script>var a", "open"), ("<div>" * 3000 + "x", "x"), ('<a href="x', ""),
    ("<nav>only a menu</nav>", ""), ("<p>a<!-- b --><![CDATA[c]]>&eacute;&#233;&lt;", "aéé<"), ("<table><tr><td>one, cell<td>two, cell</table>", "one, cell\n\ntwo, cell"), ("<svg/><p>after, all", "after, all")])
def test_odd_pages(html, want):
    assert html_text.main_text(html) == want


def test_pages_of_the_table(spark):
    import re
    from html import unescape

    out = html_text.op8_html_text(spark, SF).join(read(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    assert out
    for r in out:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p|ul|li|div|article)[^>]*>", article))
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_page_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (1, "u", PAGE, 5), (None, None, "<p>x", 6)], "page_id long, url string, html string, text long")
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in html_text.extract(rows).collect()) == [("1", 0), ("1", len(html_text.main_text(PAGE))), ("None", 1)]
    assert html_text.extract(rows.limit(0)).isEmpty()
