"""Every stage of the pipeline against a plain version, and the run as a whole."""

import random
import zlib

import pytest

import corpus_pipeline
from marlstone.llm import contamination, language, packing, queries
from test_llm import DOCS, brute_components, contamination_brute_force, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    base = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(rng, 20)) for i in range(4)] + [(4, "w1 w2")]
    passage = "\n".join(prose(rng, 20) for _ in range(6))
    texts = [prose(rng, rng.randrange(30, 300)) for _ in range(30)]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(5)]
    near = prose(rng, 200).split()
    texts += [" ".join([*near[:i], "changed", *near[i + 1 :]]) for i in range(0, 60, 12)] + texts[:3]
    texts += [prose(rng, 300) + " " + items[2][1] + " " + prose(rng, 300), items[1][1], "12 34", "это совсем другой язык " * 9]
    # What is no language has no label.
    rows = [(i, t, None if i > 44 else "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, "s", None), (901, "", None, "s", 0), (None, prose(rng, 50), None, "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, items, passage


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_language_stage(spark, corpus):
    base, rows, _, _ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, base)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted((i for i, t, *_ in rows if t and any(c.isalpha() for c in t) and "язык" not in t), key=str)
    assert {r.lang for r in kept.collect()} <= {"de", "en"}


def test_line_stage(spark, corpus):
    base, rows, _, passage = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = corpus_pipeline.line_dedup(spark, docs, base)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    holders = [i for i, t, *_ in rows if t and passage in t]
    seen = set()
    for i, t, *_ in rows:
        if i in holders[1:]:
            want = t.replace(passage + "\n", "")
        elif t and i is not None and "\n" not in t and len(t.split()) >= 40 and t in seen:
            assert i not in got  # an exact copy of one long line is left empty
            continue
        else:
            want = t
        seen.add(t)
        assert got[i][0] == want and (want is None or got[i][1] == len(want))


def test_jaccard_stage(spark, corpus):
    base, rows, _, _ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    keyed = [(i, t) for i, t, *_ in rows if i is not None]
    _, roots = brute_components([t for _, t in keyed])
    want = [i for n, (i, _) in enumerate(keyed) if roots[n] == n]
    assert ids(corpus_pipeline.jaccard_join(spark, docs, base)) == sorted([*want, None], key=str)


def test_decontamination_stage(spark, corpus):
    base, rows, items, _ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    whole = [(i, t) for i, t in items if len(t.split()) >= contamination.WINDOW]
    bad = lambda t: contamination_brute_force(t, whole)[1] > 0 or contamination_brute_force(t, items)[4]
    want = [i for i, t, *_ in rows if i is None or not bad(t)]
    assert ids(corpus_pipeline.decontaminate(spark, docs, base)) == sorted(want, key=str)
    assert {i for i, t, *_ in rows if bad(t)} >= {43, 44}  # a passage of a twentieth of its document or less goes, too


def test_run(spark, corpus):
    """The run is its stages one after the other; every token of what is left is packed once."""
    base, *_ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
    encode = packing.encoder(packing.default_tokenizer())
    want = sorted((r.doc_id or -1, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*encode(r.text or ""), 0]))) for r in docs.collect())
    got = corpus_pipeline.run(spark, base).collect()
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == want  # no document here is cut
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_language_query(spark, corpus):
    base, rows, *_ = corpus
    got = {r.doc_id: r for r in queries.op5_language_id(spark, base).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= got[i].score <= 1
    assert language.MAX_LANGS >= 2
