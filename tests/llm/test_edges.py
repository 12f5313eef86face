"""Null, empty, very long, tied and repeated rows, empty tables and clashing column names, for every operator."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, contamination, exact, html, language, lines, nearjoin, packing, shards, urls

LONG = "many words make a very long text of one line " * 25_000
TEXTS = [(1, "a short text of some words"), (2, None), (3, ""), (None, "a text without a key"), (4, LONG), (5, "A short text of some words"), (5, "A short text of some words"), (None, None), (6, "line one\n\nline two " + "word " * 60 + "\n"), (7, "line one\n\nline two " + "word " * 60 + "\nend")]
PAGES = [(1, "http://h.org/1", "<p>x</p>"), (2, None, None), (3, "", ""), (None, "http://h.org/2", "<p>y</p>"), (4, "http://h.org/" + "p" * 300_000, "<div>" + "<p>z</p>" * 40_000), (5, "http://h.net/", "<p>x"), (5, "http://h.net/", "<p>x")]
TURNS = [(1, 1, "ann", "x"), (1, 1, "ann", "x"), (1, None, None, None), (None, 2, "bob", ""), (None, None, "system", "s"), (2, 1, "ann", LONG), (2, 1, "bob", "y")]
#: Names that operators use inside, and names of what they add.
CLASH = "k t h n v u g c p q r s x row key body root rep place pos first gone drop cell start total turns items spans n_words host rule verdict lang_pred score size slot shard keep_id kept component_id sequence_id text_sha256 _lower _letters _won _cell _best _h trees page tree".split()
MODEL = language.train({"en": ["a short text of some words and lines"] * 5, "de": ["ein kurzer text aus einigen wörtern und zeilen"] * 5})

DOCS_OPS = {
    "op1": nearjoin.jaccard_join,
    "op4": lambda d: shards.shard(d, "doc_id", "text", [1.0, 2.0, 1.0], grown=1.0),
    "op5": lambda d: language.identify(d, MODEL),
    "op6": packing.pack,
    "op8": lambda d: contamination.decontaminate(d, d.sparkSession.createDataFrame([("i", "short text of"), (None, "words"), ("j", None)], "item_id string, text string")),
    "op9": exact.exact_dedup,
    "op9_verdicts": exact.dedup_verdicts,
    "op10": lines.line_dedup,
}
OPS = {
    **{name: (f, "doc_id long, text string", TEXTS) for name, f in DOCS_OPS.items()},
    "op2": (html.extract, "page_id long, url string, html string", PAGES),
    "op3": (lambda d: urls.filter_urls(d, [("block", "net/"), ("allow", "org/1")], ["h.org"]), "page_id long, url string, html string", PAGES),
    "op7": (chat.rotate, "conv_id long, turn long, role string, text string", TURNS),
}


def hashed(rows, columns):
    return sorted(str([zlib.crc32(str(r[c]).encode()) if len(str(r[c])) > 99 else r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", OPS)
def test_edges(spark, name):
    operator, schema, rows = OPS[name]
    df = spark.createDataFrame(rows, schema)
    plain = operator(df)
    got = plain.collect()
    if name not in ("op6", "op7"):
        assert len(got) == len(rows)  # a row each, repeated ones too
    extra = [c for c in CLASH if c not in df.columns]
    wide = operator(df.withColumns({c: F.lit(f"mine {c}") for c in extra}))
    again = wide.collect()
    assert hashed(again, plain.columns) == hashed(got, plain.columns)
    for c in set(wide.columns) - set(plain.columns):  # what passes through is as it was
        assert {r[c] for r in again} == {f"mine {c}"}
    empty = operator(df.limit(0))
    assert empty.collect() == [] and empty.columns == plain.columns


def test_edges_have_their_results(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.jaccard_join(df).collect() if r.doc_id} == {1: (2, 1), 2: (0, 2), 3: (0, 3), 4: (10, 4), 5: (2, 1), 6: (5, 6), 7: (6, 6)}
    kept = {(r.doc_id, r.kept) for r in exact.exact_dedup(df).collect() if r.doc_id}
    assert kept == {(1, False), (2, False), (3, True), (4, True), (5, True), (6, True), (7, True)}
    cut = {r.doc_id: (r.n_removed_lines, r.text) for r in lines.line_dedup(df).collect() if r.doc_id}
    assert cut[7] == (3, "end") and cut[6] == (0, TEXTS[8][1]) and cut[2] == (0, None) and cut[4] == (0, LONG)
    placed = shards.shard(df, "doc_id", "text", [1.0] * 3).collect()
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(3))
    hits = {r.doc_id: (r.n_hit, r["items"]) for r in contamination.decontaminate(df, spark.createDataFrame([("i", "short text of")], "item_id string, text string")).collect() if r.doc_id}
    assert hits[1] == hits[5] == (3, ["i"]) and hits[4] == (0, []) and hits[2] == (0, [])
    none = contamination.decontaminate(df, spark.createDataFrame([], "item_id string, text string")).collect()
    assert len(none) == len(TEXTS) and {r.n_hit for r in none} == {0} and max(r.n_words for r in none) == 250_000


def test_templates_against_a_plain_count(spark):
    """Blocks go where a plain count of pages by host says so."""
    rng = random.Random(11)
    pool = [f"block {i} of the site" for i in range(12)]
    pages = []
    for host, n in (("a.org", 150), ("b.org", 20), ("c.org", 4)):
        for i in range(n):
            blocks = [b for j, b in enumerate(pool) if rng.random() < (j + 1) / 14] + [f"own words {host} {i}"]
            rng.shuffle(blocks)
            pages.append((len(pages), host, blocks))
    pages += [(len(pages) + i, "c.org", pages[-1][2]) for i in range(9)]  # copies count once
    seen, size = {}, {}
    for host in ("a.org", "b.org", "c.org"):
        different = {tuple(b) for _, h, b in pages if h == host}
        size[host] = len(different)
        for b in pool:
            seen[host, b] = sum(b in d for d in different)
    share = lambda host: html.MIN_SHARE * min(size[host], (size[host] * html.FULL_SHARE_PAGES) ** 0.5)
    gone = {x for x, n in seen.items() if n >= html.MIN_PAGES and n >= share(x[0])}
    assert gone and any(h == "b.org" and n >= 1 and (h, b) not in gone for (h, b), n in seen.items())
    rows = [(i, f"http://{host}/{i}", "<body>" + "".join(f"<div><div><p>{b}</p></div></div>" for b in blocks) + "</body>") for i, host, blocks in pages]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, host, blocks in pages:
        assert got[i].text == "\n\n".join(b for b in blocks if (host, b) not in gone)
        assert got[i].n_templates == 3 * sum((host, b) in gone for b in blocks)


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<p a=" + "a" * 1_000_000 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<li>" + "<div>" * 90_000 + "<ul><li>" * 60_000])
def test_html_in_linear_time(page):
    import time

    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 5


def test_html_keeps_running_text_of_any_class():
    page = '<article><h2 id="discussion">Discussion</h2><p class="related-work">Related</p><div class="comments"><p>reader</p></div><div hidden>x</div><p>y</p></article>'
    assert html.main_text(page) == "Discussion\n\nRelated\n\ny"
