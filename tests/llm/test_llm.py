import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, components, contamination, exact, html, language, lines, nearjoin, packing, shards, shingles, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, words=400):
    return " ".join(rng.choice([f"w{i}" for i in range(words)]) for _ in range(n))


def brute_components(texts):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("knobs", [{}, {"cold": 2, "family": 2, "pivots": 3}])
def test_jaccard_join(spark, knobs):
    rng = random.Random(5)
    texts = [None, "", " \n", "a b", "A  b", "one two three four five", "x" * 300_000 + " y z"]
    for n in (6, 12, 30, 90, 300):
        base = prose(rng, n).split(" ")
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + n // 25)):
                w[rng.randrange(n)] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(w))
    texts += texts[10:14]
    sizes, roots = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.jaccard_join(docs(spark, texts), **knobs).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert nearjoin.jaccard_join(docs(spark, [])).count() == 0


def large_families(rng):
    """Three chains of near copies, of which the ends have nothing in common, and each text's neighbours."""
    texts = []
    for _ in range(3):
        words = prose(rng, 60).split(" ")
        for i in range(40):
            words[(i * 3) % 60] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("together", [nearjoin.TOGETHER, 0])
def test_jaccard_join_of_large_families(spark, monkeypatch, together):
    """Rounds of pivots, joined up in one task and by the edges between components."""
    monkeypatch.setattr(nearjoin, "TOGETHER", together)
    texts = large_families(random.Random(17))
    sizes, roots = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.jaccard_join(docs(spark, texts), cold=2, family=2, pivots=3, dealt=8).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_jaccard_join_asks_little_of_the_driver(spark):
    """The driver's memory follows the stages that it plans and the tasks that it starts, which many partitions multiply."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few stages", "")
    try:
        nearjoin.jaccard_join(docs(spark, large_families(random.Random(17))), family=20, pivots=200).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few stages") for s in tracker.getJobInfo(j).stageIds}
    ran = [i for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert len(ran) < 78 and sum(i.numCompletedTasks for i in ran) < 300


@pytest.mark.parametrize("knobs", [{}, {"cold": 1}])
def test_jaccard_join_in_differing_parts(spark, knobs):
    """Linked sets whose shared shingles all lie in parts in which they differ."""
    rng, texts = random.Random(7), []

    def part(words, n):
        (u,) = shingles.shingle_sets(np.frombuffer(" ".join(words[-5:]).encode(), np.uint8), np.array([0, len(" ".join(words[-5:]))]))
        return int(nearjoin._partition(u, n)[0][0])

    for n in range(4, 21):
        k, m = nearjoin.parts(nearjoin.band(n)), n * 5 // 4
        words = [f"{n}a{i}" for i in range(4)]
        for i in range(m):  # the last m - n shingles are what the longer text has more, one in each of the shared ones' parts
            wanted = [i - n] if i >= n else range(m - n)
            while part([*words, w := f"w{rng.randrange(1 << 40)}"], k) not in wanted:
                pass
            words.append(w)
        texts += [" ".join(words[: n + 4]), " ".join(words)]
    sizes, roots = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.jaccard_join(docs(spark, texts), **knobs).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))} and roots[1::2] == list(range(0, len(texts), 2))


@pytest.mark.parametrize("few", [components.EDGES, 40, 0])
def test_connected_components(spark, few):
    """A chain, stars and random edges: all by stars, all in one task, and begun by the ones and ended in the other."""
    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(1000, 1030)] + [(2000, i) for i in range(2001, 2040)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(5, 5), (7, 3), (3, 7)]
    root = {v: v for e in edges for v in e}
    for a, b in edges:
        a, b = root[a], root[b]
        root = {v: min(a, b) if r in (a, b) else r for v, r in root.items()}
    got = {r.v: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), few).count() == 0


def test_html():
    page = '<body><nav>menu</nav><div class="cookie-notice">x</div><article><h1>T &amp; t</h1><p><b>a\n b<br><p>c<script>var p="</p>"</script></p><section id="comments"><p>reader</p></section></article><footer>f</footer>'
    assert html.main_text(page) == "T & t\n\na b\n\nc"
    assert html.main_text(None) == "" and html.main_text("just  text") == "just text"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_html_templates(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div><span>same words</span></div><div><p>own {i}</p></div></body>") for i in range(8)] + [(9, None, None), (10, "x", "")]
    for most in (html.BROADCAST_TREES, 0):
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_trees=most).collect()}
        assert got == {**{i: f"own {i}" for i in range(8)}, 9: "", 10: ""}


def test_html_dealt_pages_read_alike(spark):
    def page(i: int) -> str:
        return f"<body><div>Site</div><div>Box {i % 2}</div><p>Text {i}</p></body>"

    rows = [(i, f"http://h{i % 3}.org/{i}", page(i)) for i in range(90)] + [(7, "http://h1.org/7", page(7))] * 40 + [(None, None, None), (200, "http://h0.org/x", "")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    read = lambda **kw: sorted(map(str, html.extract(docs, **kw).collect()))
    whole = read()
    assert len(whole) == len(rows) and sum("n_templates=2" in r for r in whole) == 130
    assert read(broadcast_trees=0) == read(broadcast_trees=0, dealt_pages=4) == whole


def test_html_templates_of_a_large_host(spark):
    """A block on 50 of 400 pages is a section's; one on 30 is not."""
    block = lambda i: "<div><p>section words</p></div>" if i < 50 else "<div><p>copied words</p></div>" if i < 80 else ""
    rows = [(i, f"http://h.org/{i}", f"<body>{block(i)}<div><p>own {i}</p></div></body>") for i in range(400)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"copied words\n\nown {i}" if 50 <= i < 80 else f"own {i}" for i in range(400)}


def test_urls(spark):
    rows = [(0, "http://A.example.net/en/1?x"), (1, "http://example.net"), (2, "https://b.example.com/de/"), (3, None), (4, "no scheme"), (5, "x://badexample.com/de/"), (6, "http://spam.org/fr/1"), (7, "http://spam.org/1"), (8, "http://x.spam.org"), (9, "http://net/" + "a" * 100_000)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_best", F.lit("mine"))
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    for hosts in (["spam.org"], spark.createDataFrame([("spam.org",), (None,), ("spam.org",)], "h string")):
        judged = urls.filter_urls(df, rules, hosts).collect()
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged}
        assert len(judged) == 11 and {r["_best"] for r in judged} == {"mine"}
        assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
        assert got[1] == ("example.net", "", None, "allow") and got[2][2:] == ("example.com/de/", "block")
        assert got[3] == got[4] == ("", "", None, "allow") and got[5][2] is None
        assert got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "block") and got[8][2:] == (None, "block")
        assert got[9][1:] == ("/" + "a" * 100_000, "net/", "block")
    assert urls.filter_urls(df.limit(0), rules, ["spam.org"]).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, [], []).collect()} == {"allow"}
    with pytest.raises(ValueError, match="bound"):
        urls.filter_urls(df, rules, ["spam.org"], max_filter_bits=1)


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 37 = 0")
    c = urls.Cascade(listed, universe)
    assert len(c.levels) > 1
    assert universe.where(c.contains(F.col("key")) != (F.col("key").cast("int") % 37 == 0)).count() == 0


def test_cascade_of_a_million_keys(spark):
    """A long list, most of it unseen, is held by the same cascade."""
    listed = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id") * 2, F.lit(".org")).alias("key"))
    pages = spark.range(20_000).select("id", F.concat(F.lit("http://www.host"), F.col("id"), F.lit(".org/x")).alias("url"))
    got = urls.filter_urls(pages, [], listed)
    assert got.where((F.col("verdict") == "block") != (F.col("id") % 2 == 0)).count() == 0


def test_shards(spark):
    df = docs(spark, [None, "", "é"] + [f"t{i}" for i in range(997)])
    got = shards.shard(df, "doc_id", "text", [1.0] * 5 + [3.0], grown=1.0).collect()
    for s in range(6):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 6) for r in got)
    assert 300 < sum(r.shard == 5 for r in got) < 450
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got if r.doc_id < 3} == {0: (8, 0), 1: (8, 0), 2: (10, zlib.crc32("é".encode()))}


def ppm_bits(samples, text, seen, order=language.ORDER, min_seen=language.MIN_SEEN):
    """The exact code length of ``text`` by walking contexts byte by byte; ``seen``: contexts that any language knows."""
    tree = {}
    for t in samples:
        b = t.lower().encode()
        for i in range(len(b)):
            for d in range(min(order, i) + 1):
                node = tree.setdefault(b[i - d : i], {})
                node[b[i]] = node.get(b[i], 0) + 1

    @functools.cache
    def share(context, x):
        node = tree.get(context) if not context or context in seen else None
        shorter = (lambda y: share(context[1:], y)) if context else (lambda y: 1 / 256)
        if not node:
            return shorter(x)
        total, distinct = sum(node.values()), len(node)
        if x in node:
            return node[x] / (total + distinct)
        return distinct / (total + distinct) * shorter(x) / sum(shorter(y) for y in range(256) if y not in node)

    b = text.lower().encode()
    return -sum(math.log2(share(b[max(0, i - order) : i], b[i])) for i in range(len(b)))


def ppm_contexts(samples, order=language.ORDER, min_seen=language.MIN_SEEN):
    seen = set()
    for ts in samples.values():
        n = {}
        for t in ts:
            b = t.lower().encode()
            for i in range(len(b)):
                for d in range(1, min(order, i) + 1):
                    n[b[i - d : i]] = n.get(b[i - d : i], 0) + 1
        seen |= {c for c, k in n.items() if k >= min_seen}
    return seen


def test_ppm_code_lengths_and_prediction(spark):
    samples = {"en": ["the cat sat on the mat and the dog"] * 3, "de": ["die katze lag auf der matte und der hund"] * 3}
    m = language.train(samples)
    contexts = ppm_contexts(samples)
    texts = ["the dog sat", "der hund öß", "", "zz", "the katze und the hund lag on der mat " * 9]
    parts = [t.lower().encode() for t in texts]
    got = m.scores(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    for t, row in zip(texts, got, strict=True):
        for n, g in enumerate(m.langs):
            assert row[n] == pytest.approx(ppm_bits(samples[g], t, contexts), abs=0.001 * (len(t) + 1))
    long = np.frombuffer(("the dog sat " * 60_000).encode(), np.uint8)
    piece = np.frombuffer(("the dog sat " * 1000).encode(), np.uint8)
    whole = m.scores(long, np.array([0, len(long)]))[0]
    assert whole.argmin() == m.langs.index("en") and whole[1] == pytest.approx(60 * m.scores(piece, np.array([0, len(piece)]))[0][1], rel=0.001)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, ["the dog sat on the mat", "der hund und die katze", None, "", "12 !"]), m).collect()}
    assert [got[i][0] for i in range(5)] == ["en", "de", "und", "und", "und"] and got[2][1] == 0


def test_ppm_is_a_code_over_bytes():
    """In every state the probabilities of the 256 bytes add up to one; bytes that no sample has cost more than raw ones."""
    rng = random.Random(8)
    m = language.train({g: [prose(rng, 200) + tail for _ in range(3)] for g, tail in (("a", "éé"), ("b", ""))})
    for g in range(2):
        total = np.exp2(-m.cost[g].astype(float) / language.UNIT)
        assert np.allclose(total[:, 1:].sum(1) + total[:, 0] * (m.symbol == 0).sum(), 1, atol=0.01)
    for text in ("язык", "日本語の文章"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert m.scores(raw, np.array([0, len(raw)])).min() > 8 * len(raw)
    raw = np.frombuffer("ééé".encode(), np.uint8)
    assert m.scores(raw, np.array([0, len(raw)]))[0][0] + 10 < m.scores(raw, np.array([0, len(raw)]))[0][1]


def test_ppm_fit(spark):
    """Held-out rows teach nothing; too many languages are an error; what was learned is told apart on held-out rows."""
    rng = random.Random(12)
    vocabulary = {g: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(60)] for g, letters in (("xx", "abcdefghi"), ("yy", "efghijklmn"))}
    rows = [(n, " ".join(rng.choice(vocabulary[g]) for _ in range(40)), g, None, None) for n, g in enumerate(["xx", "yy"] * 100)]
    out = {n: zlib.crc32(str(n).encode()) % 5 == 0 for n in range(200)}
    wrong = [(n, t, "yy" if out[n] and g == "xx" else g, a, b) for n, t, g, a, b in rows]
    m = language.fit(spark.createDataFrame(wrong, DOCS))
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, DOCS).drop("lang", "source"), m).collect()}
    assert all(got[n] == g for n, _, g, _, _ in rows)
    many = spark.range(10 * language.MAX_LANGS).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("l"), F.col("id")).alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language.fit(many)


def brute_bfd(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(capacity - n)
    return len(bins)


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins: dict[int, list[tuple[int, int]]] = {}
        steps = packing.plan(counts, 40)
        for i, (n, place, first, off) in enumerate(steps):
            later = [s[1] for s in steps[i + 1 :] if s[0] == n]
            for k in range((later[0] if later else counts[n]) - place):
                bins.setdefault(first + k, []).append((off, n))
        for own in bins.values():
            at = 0
            for off, n in sorted(own):
                assert off == at
                at += n
            assert at <= 40
        assert sum(map(len, bins.values())) == len(lengths) and len(bins) == brute_bfd(lengths, 40)


def test_pack(spark):
    texts = [None, "", "Hello there.", "word " * 5000, "a <|endoftext|> b", "Hello there."]
    got = packing.pack(docs(spark, texts), with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer() + ".json")
    for i, x in enumerate(texts):
        ids = [y for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece) for y in r.ids]
        assert ids == [*t.encode(x or "", add_special_tokens=False).ids, 0]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length <= 2048 for r in got)


TURNS = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (None, None, None, "q"), (2, 0, "system", "only"), (3, 0, "bob|>\nhello", "x"), (3, 1, None, "y"), (3, 2, "unknown", "z"), (3, 2, "unknown", "z")]
    got = {(r.conv_id, r.participant): r for r in chat.rotate(spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("clash"))).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, None), (3, "bob| > hello"), (3, None), (3, "unknown")}
    r = got[1, "ann"]
    assert r.text == "<|system|>\ns<|end|>\n<|assistant|>\nhi < |x<|end|>\n<|user name=bob|>\n<|end|>\n"
    a, z = map(int, r.mask_spans.split(":"))
    assert r.text[a:z] == "hi < |x<|end|>"
    assert got[3, "unknown"].text == "<|user name=bob| > hello|>\nx<|end|>\n<|user|>\ny<|end|>\n<|assistant|>\nz<|end|>\n<|assistant|>\nz<|end|>\n"
    assert got[3, None].mask_spans.count(":") == 1 and got[3, "unknown"].n_assistant == 2
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("size", [{}, {"part": 100, "carry": 7}])
def test_chat_of_many_turns(spark, size):
    """Every turn is rendered once, and a later part opens with the scene in force and the turns before it."""
    said = [(1, n * 1000, "system" if n in (0, 150) else "abc"[n % 3], f"t{n}") for n in range(330)] + [(2, n, "ann", f"u{n}") for n in range(5)]
    part, carry = size.get("part", chat.PART), size.get("carry", chat.CARRY)
    got = {(r.conv_id, r.part, r.participant): r for r in chat.rotate(spark.createDataFrame(said, TURNS), **size).collect()}
    want = {}
    for conv in (1, 2):
        own = [(r, t) for c, _, r, t in said if c == conv]
        for p in range(-(-len(own) // part)):
            start = max(0, p * part - carry)
            scene = [x for x in own[:start] if x[0] == "system"][-1:]
            shown = [(*x, True) for x in scene + own[start : p * part]] + [(*x, False) for x in own[p * part : (p + 1) * part]]
            for who in {r for r, _, c in shown if not c} - {"system"}:
                text, spans = "", []
                for r, t, c in shown:
                    text += "<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f"<|user name={r}|>\n"
                    if r == who and not c:
                        spans.append(f"{len(text)}:{len(text) + len(t) + 7}")
                    text += t + "<|end|>\n"
                want[conv, p, who] = text, ";".join(spans), sum(not c for *_, c in shown)
    assert {k: (r.text, r.mask_spans, r.n_turns) for k, r in got.items()} == want


def contamination_brute_force(text, items, window=13):
    """The contract's figures for one document by plain search."""
    fold = lambda t: contamination.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, of = fold(text), set(), []
    for item, t in items:
        w = fold(t)
        n, some = min(window, len(w)), False
        for a in range(len(w) - n + 1 if w else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == w[a : a + n]:
                    hit.update(range(p, p + n))
                    some = True
        if some:
            of.append(str(item))
    return len(own), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [("1", prose(rng, 30)), ("2", "short item Here"), ("3", None), ("4", "w1"), ("5", "!")]
    texts = [None, "", "A Short, item-here!", prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 9), " ".join(items[0][1].split()[5:17]), prose(rng, 300)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (contamination.BLOCK_WORDS, 20):
        got = {r.doc_id: tuple(r)[1:6] for r in contamination.decontaminate(docs(spark, texts), bench, block_words=block).collect()}
        assert got == {i: contamination_brute_force(t, items) for i, t in enumerate(texts)}


def test_exact(spark):
    texts = ["Same", "sAME", None, "", "É", "é", "same "]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs(spark, texts)).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 1, True)}
    assert exact.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 3000, 300])
def test_trie_spills(limit):
    rng = random.Random(3)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(800)]
    trie, want = exact.PatriciaTrie(lambda a, b: a + b, limit), {}
    for k in keys:
        trie.insert(k, 1)
        want[k] = want.get(k, 0) + 1
    assert dict(trie.items()) == want


def test_line_dedup(spark):
    rng = random.Random(4)
    passage = "\n".join(prose(rng, 15) for _ in range(6))
    texts = [None, "", "one line"] + [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(4)]
    got = {r.doc_id: r for r in lines.line_dedup(docs(spark, texts)).collect()}
    assert got[0].text is None and got[1].text == "" and got[2].text == "one line" and got[3].text == texts[3]
    for i in (4, 5, 6):
        assert got[i].text == texts[i].replace(passage + "\n", "") and got[i].n_removed_lines == 6


def test_line_dedup_blank_lines(spark):
    rng = random.Random(6)
    for n, words in ((3, 25), (5, 35)):
        own = [prose(rng, words) for _ in range(n)]
        passage = "\n\n".join(own)
        texts = [f"{prose(rng, 20)}\n\n{passage}\n \n{prose(rng, 20)}" for _ in range(4)]
        got = {r.doc_id: r for r in lines.line_dedup(docs(spark, texts)).collect()}
        assert got[0].text == texts[0]
        for i in (1, 2, 3):
            assert got[i].text == texts[i].replace(passage + "\n", "") and got[i].n_removed_lines == 2 * n - 1
    # A line of few words is no passage for the blank lines around it.
    short = [f"{prose(rng, 20)}\n\n{own[0][:60]}\n\n{prose(rng, 20)}" for _ in range(4)]
    assert {r.doc_id: r.text for r in lines.line_dedup(docs(spark, short)).collect()} == dict(enumerate(short))


def test_ppm_sample_passes_over_long_documents(spark):
    texts = ["long " * 200, "short text here", "other words", "more of it"]
    df = docs(spark, texts * 5).withColumn("doc_id", F.col("doc_id").cast("long"))
    seen = []
    real, language.train = language.train, lambda samples: seen.append(samples) or real(samples)
    try:
        language.fit(df, sample_bytes=100)
        language.fit(docs(spark, texts[:1] * 9), sample_bytes=100)
    finally:
        language.train = real
    assert len(seen[0]["en"]) > 2 and texts[0] not in seen[0]["en"] and sum(map(len, seen[0]["en"])) <= 100
    assert seen[1]["en"] == [texts[0][:100]]


def test_pipeline_rejects_unlearned_languages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = {"en": "the and that committee with budget plans for year people house which", "de": "der und dass ausschuss mit haushalt für jahr menschen häuser welche größe"}
    common = "0123456789 quick brown fox, jumps; over: lazy. dog! vexing?"  # so frequent that other letters share a symbol
    rows = [(n, " ".join([common, "äößüéñ", *(rng.choice(words[g].split()) for _ in range(rng.randrange(8, 80))), common]), g, None, None) for n, g in enumerate(["en", "de"] * 60)]
    strange = ["日本語の文章はここにあります。" * 9, "это предложение написано на русском языке " * 5, "αυτή είναι μια πρόταση στα ελληνικά " * 5, "这是一个没有学习过的语言的句子" * 9, " ".join(f"{rng.getrandbits(128):032x}" for _ in range(9)), "привет мир"]
    rows += [(1000 + n, t, None, None, None) for n, t in enumerate(strange)]
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()}
    assert kept == {n: g for n, _, g, _, _ in rows if n < 1000}
